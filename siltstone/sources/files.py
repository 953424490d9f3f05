"""Files that people or other systems keep beside the tables: dumps, dimensions, recorded answers, documents."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of recorded answers; readers take any minor version of the same major one.
SCHEMA_VERSION = "1.0"
TEXT_ID, SHA, SOURCE = re.compile(r"[0-9a-f]{16}"), re.compile(r"[0-9a-f]{64}"), re.compile(r"[a-z0-9_]{1,32}")
KINDS = ("raw", "canonical", "quarantine")


# paths and documents


def path_column(kind: str, text_id: Column, source: Column | None = None) -> Column:
    """``kind/source/text_id.md`` (canonical documents have no source), null where a part is malformed: nothing leaves the folder."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    good = F.regexp_like(text_id, F.lit(f"^{(SHA if kind == 'quarantine' else TEXT_ID).pattern}$"))
    if kind == "raw":
        good = good & F.regexp_like(source, F.lit(f"^{SOURCE.pattern}$"))
        return F.when(good, F.concat(F.lit("raw/"), source, F.lit("/"), text_id, F.lit(".md")))
    return F.when(good, F.concat(F.lit(f"{kind}/"), text_id, F.lit(".md")))


def safe_path(base: str | Path, kind: str, text_id: str, source: str | None = None) -> Path:
    """The same for one file; a malformed part is an error."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    if not (SHA if kind == "quarantine" else TEXT_ID).fullmatch(text_id):
        raise ValueError(f"malformed id: {text_id!r}")
    if kind == "raw" and not SOURCE.fullmatch(source or ""):
        raise ValueError(f"malformed source: {source!r}")
    root = Path(base).resolve()
    out = root.joinpath(*([kind, source] if kind == "raw" else [kind]), f"{text_id}.md").resolve()
    if root not in out.parents:
        raise ValueError(f"outside {root}: {out}")
    return out


def write_atomic(path: str | Path, text: str) -> None:
    """All of the text or the old file: a temporary file in the same folder is renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def front_matter(meta: dict[str, str], body: str) -> str:
    return "".join(["---\n", *(f"{k}: {v}\n" for k, v in meta.items()), "---\n", body])


def write_documents(df: DataFrame, path: str) -> None:
    """One line of JSON per document, written by Spark's commit protocol: readers see all of a write or none."""
    df.write.mode("overwrite").json(path)


# dumps


def dump_points(points: DataFrame, path: str) -> None:
    """A point collection as JSON lines in the order of canonical_id and chunk_idx, over files in that order."""
    points.orderBy("canonical_id", "chunk_idx").write.mode("overwrite").json(path)


def restore_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dump's rows; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def fixture_sha256(spark: SparkSession, path: str) -> str:
    """One hash for a dump, whatever its files: sha256 over the sorted sha256s of its lines' (a tree of two levels, so no task holds the lines)."""
    lines = spark.read.text(path).select(F.sha2("value", 256).alias("h"))
    shards = lines.withColumn("s", F.substring("h", 1, 2)).groupBy("s").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("r"))
    return hashlib.sha256("".join(r.r for r in shards.orderBy("s").collect()).encode()).hexdigest()  # 256 rows at most


# dimensions


def read_yaml(path: str) -> object:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def platforms(spark: SparkSession, path: str) -> DataFrame:
    """(domain) of a file with a list under ``domains``."""
    found = read_yaml(path)
    return spark.createDataFrame([(d.lower(),) for d in found["domains"]], "domain string")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(domain, parent): domains that are subsidiaries whatever their name says, from a list under ``overrides``."""
    found = (read_yaml(path) or {}).get("overrides") or []
    return spark.createDataFrame([(x["domain"].lower(), x.get("parent")) for x in found], "domain string, parent string")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(facet, value): every list of the file is a closed facet."""
    found = read_yaml(path)
    return spark.createDataFrame([(k, v) for k, vs in found.items() if isinstance(vs, list) for v in vs], "facet string, value string")


def prices(spark: SparkSession, path: str) -> DataFrame:
    """(model, rate) in dollars a million input tokens, from a mapping of models to mappings with ``input``."""
    found = read_yaml(path)
    return spark.createDataFrame([(k, float(v["input"])) for k, v in found.items() if isinstance(v, dict) and "input" in v], "model string, rate double")


def seeds(items: list) -> list[dict]:
    """A seed list with ``name`` as ``startup_name``; other keys stay, and an item without a name or a URL is an error."""
    out = []
    for i, item in enumerate(items):
        if not isinstance(item, dict) or not item.get("name") or not item.get("url"):
            raise ValueError(f"seed {i} needs a name and a url")
        out.append({("startup_name" if k == "name" else k): v for k, v in item.items()})
    return out


# recorded answers


def check_version(version: object, path: str) -> None:
    major = str(version).split(".")[0] if isinstance(version, str) and "." in version else None
    if major != SCHEMA_VERSION.split(".")[0]:
        raise ValueError(f"{path}: version {version!r}, this reader takes {SCHEMA_VERSION.split('.')[0]}.x")


_RECORD = "schema_version string, key struct<template_sha: string, model: string, prompt_hash: string, text_hash: string>, response struct<text: string, stop_reason: string, cost_usd: double, cache_read_tokens: long, cache_creation_tokens: long, vector: array<double>, indices: array<int>, values: array<double>>"


def read_recorded(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables ``llm``, ``dense`` and ``sparse`` of a folder of recorded answers, one JSON file each.

    Files that begin with ``embed__`` are embeddings, sparse ones if they have indices.  Another major version, an
    embedding without numbers, or a key that stands twice is an error.
    """
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.from_json("value", _RECORD, {"mode": "FAILFAST"}).alias("r")).select("file", "r.*")
    other = files.select("file", "schema_version").where(~F.coalesce(F.regexp_like("schema_version", F.lit(rf"^{SCHEMA_VERSION.split('.')[0]}\.\d+$")), F.lit(False))).orderBy("file").limit(1).collect()
    if other:
        check_version(other[0].schema_version, other[0].file)
    embeddings = F.col("file").startswith("embed__")
    sparse = F.col("response.indices").isNotNull()
    llm = files.where(~embeddings).select("key.template_sha", "key.model", "key.prompt_hash", "response.text", F.coalesce("response.stop_reason", F.lit("stop")).alias("stop_reason"), F.coalesce("response.cost_usd", F.lit(0.0)).alias("cost_usd"), "response.cache_read_tokens", "response.cache_creation_tokens")
    dense = files.where(embeddings & ~sparse).select("key.model", "key.text_hash", F.col("response.vector").alias("embedding"))
    out = {"llm": llm, "dense": dense, "sparse": files.where(embeddings & sparse).select("key.model", "key.text_hash", "response.indices", "response.values")}
    if not dense.where("embedding is null").isEmpty():
        raise ValueError("a recorded embedding has neither a vector nor indices")
    for name, key in (("llm", ["template_sha", "model", "prompt_hash"]), ("dense", ["model", "text_hash"]), ("sparse", ["model", "text_hash"])):
        twice = out[name].groupBy(*key).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{name}: a recorded key stands twice: {tuple(twice[0])[:-1]}")
    return out


def record_name(stage: str, model: str, digest: str) -> str:
    return f"{stage}__{re.sub(r'[^A-Za-z0-9._-]', '_', model)}__{digest}.json"


def write_recorded(folder: str | Path, stage: str, key: dict, response: dict, debug: dict | None = None) -> Path:
    """One recorded answer; ``key`` has model and prompt_hash or text_hash."""
    path = Path(folder) / record_name(stage, key["model"], key.get("prompt_hash") or key["text_hash"])
    record = {"schema_version": SCHEMA_VERSION, "key": key, "response": response} | ({"request_debug": debug} if debug else {})
    write_atomic(path, json.dumps(record, indent=2, sort_keys=True) + "\n")
    return path


def swap_folder(new: str | Path, target: str | Path) -> None:
    """``new`` takes the place of ``target``, which is there or gone at every moment but never half."""
    new, target = Path(new), Path(target)
    old = target.with_name(f".{target.name}.old-{os.getpid()}")
    if target.exists():
        os.replace(target, old)
    os.replace(new, target)
    shutil.rmtree(old, ignore_errors=True)


def sweep_stale(folder: str | Path, suffix: str = ".recording", older_than: float = 86_400) -> list[str]:
    """Removes folders of recordings that never ended; their names."""
    gone = []
    for p in Path(folder).glob(f"*{suffix}"):
        if p.is_dir() and time.time() - p.stat().st_mtime > older_than:
            shutil.rmtree(p)
            gone.append(p.name)
    return sorted(gone)
