"""Snapshot commits of a folder of tables.

Data files are written first, each write to a folder of its own, and nobody sees them.  A manifest, named once and last, lists
what a batch adds to each table: readers read the files that manifests list, so a batch is there as a whole or not at all,
and a run that stops anywhere leaves nothing but files that no manifest lists.  A manifest's name is its batch and its
writer, so the same batch of the same writer replaces itself, and two writers of one batch number do not meet.

Compaction rewrites the last change of each key, sorted by key, and names that base in one manifest together with those
that it covers; later changes are laid over the base, which is neither shuffled nor sorted for it where they are few.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE = "base.json"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Writes in this block give up their shuffle files as soon as they end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


@dataclass(frozen=True)
class Manifest:
    """What batch ``seq`` of ``writer`` adds: folders by table."""

    seq: int
    writer: str
    files: dict[str, list[str]]

    @property
    def name(self) -> str:
        return f"{self.seq:015d}-{self.writer}.json"


@dataclass(frozen=True)
class Base:
    """One folder for each table, ``upto`` the last batch in it, and the manifests that it covers."""

    upto: int
    files: dict[str, list[str]]
    covers: tuple[str, ...]


class Commits:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _system(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, name: str, content: dict) -> None:
        """Writes a manifest under another name and renames it, over an older one if there is one: readers see either."""
        jvm = self.spark.sparkContext._jvm
        to, made = self._path(f"manifests/{name}"), self._path(f"manifests/_{uuid.uuid4().hex}")
        out = self._system(made).create(made, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(made, to, over)

    def _content(self, path) -> dict:
        stream = self._system(path).open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # writing

    def stage(self, table: str, rows: DataFrame) -> str:
        """Writes rows where no reader looks, and returns their folder."""
        folder = f"{table}/{uuid.uuid4().hex}"
        with freed(self.spark):
            rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return folder

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes rows to a folder of a batch's own, over those of an earlier run, and reads them from there."""
        with freed(self.spark):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Removes what ``put`` wrote."""
        path = self._path(name)
        self._system(path).delete(path, True)

    def publish(self, seq: int, writer: str, files: dict[str, list[str]]) -> None:
        """Makes staged folders a part of their tables, all at once."""
        base, _ = self.snapshot()
        if base is not None and seq <= base.upto:
            raise ValueError(f"batch {seq} is not after {base.upto}, the last one in the base")
        m = Manifest(seq, writer, files)
        self._named(m.name, {"seq": seq, "writer": writer, "files": files})

    def rebase(self, files: dict[str, list[str]], covered: list[Manifest], upto: int) -> None:
        """Puts a base in the place of what it was made from; its manifests go after that."""
        self._named(BASE, {"upto": upto, "files": files, "covers": [m.name for m in covered]})
        for m in covered:
            path = self._path(f"manifests/{m.name}")
            self._system(path).delete(path, False)

    # reading

    def snapshot(self, before: int | None = None) -> tuple[Base | None, list[Manifest]]:
        """The base and the manifests after it, by batch and writer; of batches before a number only.  One small file each."""
        folder = self._path("manifests")
        if not self._system(folder).exists(folder):
            return None, []
        every = {s.getPath().getName(): s.getPath() for s in self._system(folder).listStatus(folder)}
        base = Base(**self._content(every[BASE])) if BASE in every else None
        gone = set(base.covers) if base else set()
        names = sorted(n for n in every if n.endswith(".json") and n != BASE and n[0] not in "._" and n not in gone)
        found = [Manifest(**self._content(every[n])) for n in names]
        return base, [m for m in found if before is None or m.seq < before]
