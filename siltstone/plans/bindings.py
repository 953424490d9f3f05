"""The engine's data model over the tables of a test directory.

These bindings (which column stands for which facet, date or state) are ours; they only give the operators
data with ties, nulls and duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.dates import cutoff_date
from siltstone.operators import postings, vectorindex
from siltstone.operators.hits import DATES

AS_OF = "2024-02-29"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dated(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds failure and founding dates, with nulls, and their unknown flags."""
    days = lambda a, m: (F.col(key) * a % m).cast("int")
    failure = F.when(F.col(key) % 7 != 0, F.date_add(F.lit("2010-01-01").cast("date"), days(37, 5000)))
    founding = F.when(F.col(key) % 5 != 0, F.date_add(F.lit("2000-01-01").cast("date"), days(53, 3000)))
    df = df.withColumn("failure_date", failure).withColumn("founding_date", founding)
    return df.withColumn("failure_unknown", F.col("failure_date").isNull()).withColumn("founding_unknown", F.col("founding_date").isNull())


DATED_SQL = """
  CASE WHEN doc_id % 7 <> 0 THEN DATE '2010-01-01' + CAST(doc_id * 37 % 5000 AS INTEGER) END AS failure_date,
  CASE WHEN doc_id % 5 <> 0 THEN DATE '2000-01-01' + CAST(doc_id * 53 % 3000 AS INTEGER) END AS founding_date,
  doc_id % 7 = 0 AS failure_unknown, doc_id % 5 = 0 AS founding_unknown"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Chunks: four to a parent, with vector (null for some), text, facets and dates."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    rows = docs.join(vectors, docs.doc_id == vectors.vec_id, "left")
    sector = F.when(F.col("source") == "src19", "other").otherwise(F.col("source"))
    return dated(rows).select(
        F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 4).alias("canonical_id"), (F.col("doc_id") % 4).alias("chunk_idx"),
        "text", "embedding", sector.alias("sector"), F.col("lang").alias("geography"), "failure_date", "founding_date", "failure_unknown", "founding_unknown",
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    """``points`` without vectors and facets, for the index of words.  The join with the vectors would shuffle every text; it only matters if an id of theirs repeats."""
    columns = ["chunk_id", "text", *DATES]
    if not table(spark, d, "embeddings").groupBy("vec_id").count().where("count > 1").isEmpty():
        return points(spark, d).select(*columns)
    return dated(table(spark, d, "documents")).withColumnRenamed("doc_id", "chunk_id").select(*columns)


_BUILT: dict[tuple[str, str], tuple[vectorindex.VectorIndex, postings.PostingIndex]] = {}


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def indexes(spark: SparkSession, d: str) -> tuple[vectorindex.VectorIndex, postings.PostingIndex]:
    """The indexes of ``points``, as an ingest leaves them: built by the first query of an application that asks, then read as long as they are there."""
    key = spark.sparkContext.applicationId, d
    if key not in _BUILT or not all(_there(spark, index.path) for index in _BUILT[key]):
        _BUILT[key] = vectorindex.temporary(points(spark, d)), postings.temporary(texts(spark, d), sharded=False)
    return _BUILT[key]


POINTS_SQL = f"""points AS (
  SELECT doc_id AS chunk_id, doc_id // 4 AS canonical_id, doc_id % 4 AS chunk_idx, text, embedding::DOUBLE[] AS embedding,
    CASE WHEN source = 'src19' THEN 'other' ELSE source END AS sector, lang AS geography, {DATED_SQL}
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""


def pitches(spark: SparkSession, d: str, cutoff: bool = False) -> DataFrame:
    """The query set: every chunk whose id is divisible by 100, asked again; some ask for recent ones only."""
    rows = points(spark, d).where("chunk_id % 100 = 0")
    out = rows.select(F.col("chunk_id").alias("query_id"), "text", "embedding", "sector", "geography")
    if cutoff:
        years = F.when(F.col("query_id") % 3 == 0, 5 + F.floor(F.col("query_id") / 100) % 10)
        out = out.withColumn("cutoff", cutoff_date(F.lit(AS_OF).cast("date"), years))
    return out


def pitches_sql(cutoff: bool = False) -> str:
    years = f", CASE WHEN chunk_id % 3 = 0 THEN CAST(DATE '{AS_OF}' - to_years(CAST(5 + chunk_id // 100 % 10 AS INTEGER)) AS DATE) END AS cutoff" if cutoff else ""
    return f"pitches AS (SELECT chunk_id AS query_id, text, embedding, sector, geography{years} FROM points WHERE chunk_id % 100 = 0)"
