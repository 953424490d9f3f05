"""The data source of result pages against the batch reader over the same pages."""

import json

from siltstone.sources.pages import COLUMNS, SearchPages
from siltstone.sources.readers import hits_to_entries


def pages():
    hit = lambda i: {"objectID": str(i) if i % 7 else None, "title": f"t{i}", "url": None, "story_text": f"s{i}" if i % 2 else "", "comment_text": "c", "created_at_i": 100 + i}
    out = {f"p{k}.json": json.dumps({"page": k, "nbPages": 4, "hits": [hit(5 * k + j) for j in range(5)]}) for k in range(6)}
    return out | {"p9.json": "{broken", "p8.json": "[1]"}


def test_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    every = pages()
    for name in ("p0.json", "p1.json", "p9.json", "p8.json"):
        (folder / name).write_text(every[name])
    spark.dataSource.register(SearchPages)
    read = lambda **o: spark.read.format("search_pages").options(**o).load(f"file://{folder}")
    assert read().rdd.getNumPartitions() == 4
    rows = read().collect()
    assert sorted((r.page, r.error.split(":")[0]) for r in rows if r.error) == [("p8.json", "ValueError"), ("p9.json", "JSONDecodeError")]
    out = f"file://{tmp_path}/out"

    def run():
        stream = spark.readStream.format("search_pages").option("since", 102).load(f"file://{folder}")
        stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").option("path", out).trigger(availableNow=True).start().awaitTermination()

    run()
    first = spark.read.schema(COLUMNS).parquet(out).where("error is null").count()
    for name in every:
        (folder / name).write_text(every[name])
    run()  # from the epoch that the first run came to
    text = spark.createDataFrame([(v,) for v in every.values()], "page string")
    want = sorted((r.source_id, r.markdown_text) for r in hits_to_entries(text, "page", since_epoch=102).collect())
    assert sorted((r.source_id, r.markdown_text) for r in read(since=102).where("error is null").collect()) == want
    assert sorted((r.source_id, r.markdown_text) for r in spark.read.schema(COLUMNS).parquet(out).where("error is null").collect()) == want and 0 < first < len(want)
