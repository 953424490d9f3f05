"""Readers of the supported inputs.  Remote fetches are tables of answers, joined by URL."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import html, urls
from siltstone.functions.text import blank_to_null, first_present

# fixed values: header names of company exports
ID_COLUMNS = ("uuid", "id", "permalink", "cb_url")
NAME_COLUMNS = ("name", "company_name", "organization_name")
URL_COLUMNS = ("homepage_url", "homepage", "url", "website")
TEXT_COLUMNS = ("short_description", "description", "long_description", "about")
ENTRY = "source string, source_id string, url string, raw_html string, markdown_text string"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', multiLine=True)


def company_entries(rows: DataFrame) -> DataFrame:
    """Rows of a company export under whatever header names it has; the id falls back to the name, rows without either go."""
    pick = lambda names: first_present(*[F.col(n).cast("string") for n in names if n in rows.columns]) if set(names) & set(rows.columns) else F.lit(None).cast("string")
    found = rows.select(pick(ID_COLUMNS).alias("id"), pick(NAME_COLUMNS).alias("name"), pick(URL_COLUMNS).alias("url"), pick(TEXT_COLUMNS).alias("about"))
    out = found.withColumn("source_id", F.coalesce("id", "name")).where("source_id is not null")
    return out.select(F.lit("company_csv").alias("source"), "source_id", "name", "url", F.lit(None).cast("string").alias("raw_html"), F.col("about").alias("markdown_text"))


def closed_companies(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'closed'")


_PAGES = "struct<page:int,nbPages:int,hits:array<struct<objectID:string,url:string,title:string,story_text:string,comment_text:string,created_at_i:bigint>>>"


def page_requests(query: str, pages: int, since_epoch: int | None = None) -> list[str]:
    """The URLs of a chronological search's result pages; ``since_epoch`` is filtered by the service."""
    from urllib.parse import urlencode

    since = {} if since_epoch is None else {"numericFilters": f"created_at_i>={since_epoch}"}
    return [f"https://hn.algolia.com/api/v1/search_by_date?{urlencode({'query': query, 'tags': 'story', 'page': n, **since})}" for n in range(pages)]


def hits_to_entries(pages: DataFrame, column: str, since_epoch: int | None = None) -> DataFrame:
    """Search result pages (JSON): one entry for each hit with an id, since an epoch if given; the body is title and text.

    Pages that the service says it does not have (page >= nbPages) are left out.
    """
    found = pages.select(F.from_json(column, _PAGES).alias("p")).where("p.page is null or p.nbPages is null or p.page < p.nbPages")
    hit = found.select(F.explode("p.hits").alias("h")).select("h.*").where("objectID is not null")
    if since_epoch is not None:
        hit = hit.where(F.col("created_at_i") >= since_epoch)
    body = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce(F.nullif("story_text", F.lit("")), "comment_text", F.lit("")))
    return hit.select(F.lit("search_hits").alias("source"), F.col("objectID").alias("source_id"), "url", F.lit(None).cast("string").alias("raw_html"), body.alias("markdown_text"))


def curated_items(items: list) -> list[tuple]:
    """(pos, url, startup_name) of a curated list (parsed YAML): what is no list is an error, items that are no mappings or have no URL are dropped."""
    if not isinstance(items, list):
        raise ValueError("a curated source is a list")
    return [(i, x["url"], x.get("startup_name")) for i, x in enumerate(items) if isinstance(x, dict) and x.get("url")]


def robots_column(robots: Column, url: Column, agent: str) -> Column:
    """Whether the site's robots.txt (null: none) lets ``agent`` read the URL."""

    @F.pandas_udf(T.BooleanType())
    def allowed(files: pd.Series, urls_: pd.Series) -> pd.Series:
        return pd.Series([urls.robots_allowed(f, u, agent) for f, u in zip(files, urls_, strict=True)])

    return allowed(robots, url)


def curated_rows(items: DataFrame, fetched: DataFrame, agent: str = "siltstone") -> DataFrame:
    """Entries of items (pos, url, startup_name) that may be read, were answered with a status under 400 and hold enough text.

    ``fetched``: url, html, and status and robots (the site's robots.txt) if it has them.
    """
    good = urls.url_allowed(F.col("url"))
    if "status" in fetched.columns:
        good = good & (F.col("status") < 400)
    if "robots" in fetched.columns:
        good = good & robots_column(F.col("robots"), F.col("url"), agent)
    out = items.join(fetched, "url").where(good).withColumn("body", html.extract(F.col("html"))).where("body <> ''")
    return out.select(F.lit("curated").alias("source"), F.coalesce(blank_to_null(F.col("startup_name")), "url").alias("source_id"), "url", F.col("html").alias("raw_html"), F.col("body").alias("markdown_text"))


def curated_entries(spark: SparkSession, items: list, fetched: DataFrame) -> DataFrame:
    """The same of a curated list."""
    return curated_rows(spark.createDataFrame(curated_items(items), "pos int, url string, startup_name string"), fetched)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped; a malformed line fails the read."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a front matter of ``key: value`` lines between lines of three hyphens: path, meta (map), body."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    head = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(": ")))
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, ": ", 1), F.regexp_replace(x, r"^[^:]*: ", ""))))
    return files.select("path", meta.alias("meta"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", "").alias("body"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers, one JSON file each; a key that stands twice is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.response").alias("response"), F.get_json_object("value", "$.response.indices").isNotNull().alias("sparse"))
    twice = rows.groupBy("key").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("a recorded key stands twice")
    return rows


def dimension(spark: SparkSession, rows: dict[str, list[str]]) -> DataFrame:
    """(facet, value) of a closed taxonomy."""
    return spark.createDataFrame([(k, v) for k, vs in rows.items() for v in vs], "facet string, value string")


def load_json(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
