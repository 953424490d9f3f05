"""Result pages of a search as a Python data source: one partition for each page, and a stream whose offset is the epoch.

``spark.dataSource.register(SearchPages)``, then ``spark.read.format("search_pages").load(folder)`` or ``readStream``.  A folder holds
one JSON document a file (what the service answers for a page); options: ``since`` (hits from that epoch on).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COLUMNS = "source string, source_id string, url string, markdown_text string, created_at bigint, page string, error string"


@dataclass
class Page(InputPartition):
    """One file, and the epochs of the hits that are wanted: from ``since``, before ``until``."""

    path: str
    since: int | None = None
    until: int | None = None


def _files(folder: str) -> list[tuple[str, object]]:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    names = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    return [(name, system) for name in names]


def _content(folder: str, path: str) -> dict:
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(folder)
    with system.open_input_file(path) as f:
        page = json.loads(f.read())
    if not isinstance(page, dict):
        raise ValueError("a page is an object")
    return page


def _entry(hit: dict, path: str) -> tuple | None:
    """An entry's row, None for a hit without a text id."""
    if not isinstance(hit, dict) or not isinstance(hit.get("objectID"), str):
        return None
    body = f"# {hit.get('title') or ''}\n\n{hit.get('story_text') or hit.get('comment_text') or ''}"
    return "search_hits", hit["objectID"], hit.get("url"), body, hit.get("created_at_i"), path.rsplit("/", 1)[-1], None


def _rows(folder: str, page: Page) -> Iterator[tuple]:
    """The entries of one page; a page that cannot be read is a row with its error, and ends no other."""
    try:
        found = _content(folder, page.path)
        number, pages = found.get("page"), found.get("nbPages")
        hits = [] if number is not None and pages is not None and number >= pages else list(found.get("hits") or [])
        rows = [r for r in (_entry(h, page.path) for h in hits) if r is not None]
    except Exception as error:  # noqa: BLE001
        yield None, None, None, None, None, page.path.rsplit("/", 1)[-1], f"{type(error).__name__}: {error}"
        return
    for r in rows:
        at = r[4]
        if (page.since is None or (at is not None and at >= page.since)) and (page.until is None or at is None or at < page.until):
            yield r


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.since = options["path"], int(options["since"]) if "since" in options else None

    def partitions(self) -> list[Page]:
        return [Page(name, self.since) for name, _ in _files(self.folder)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _rows(self.folder, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are epochs: a batch has the hits from one up to, not including, the next."""

    def __init__(self, options: dict):
        self.folder, self.since = options["path"], int(options.get("since", 0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"epoch": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        last = self.since - 1
        for name, _ in _files(self.folder):
            try:
                hits = _content(self.folder, name).get("hits") or []
            except ValueError:
                continue
            last = max([last, *(h["created_at_i"] for h in hits if isinstance(h, dict) and isinstance(h.get("created_at_i"), int))])
        return {"epoch": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(name, start["epoch"], end["epoch"]) for name, _ in _files(self.folder)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return (r for r in _rows(self.folder, partition) if r[4] is not None or r[6] is not None)

    def commit(self, end: dict) -> None:
        pass


class SearchPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)
