"""Readers of the tables that the registered queries run over, and what they derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch, each with Spark's default and ours.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(4 << 20))}


def bounded(spark: SparkSession) -> None:
    """Bound the batches that Python gets, for the rest of the session: 10,000 pages or books at a time fill an executor. Values that the caller has set stay."""
    for key, (usual, ours) in BATCH.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, ours)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; timestamps without zone are read as UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, source, lang, line_no, line): the lines of each document, from 0."""
    return documents.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def boxes(lineitem: DataFrame) -> DataFrame:
    """A box for each lineitem row, on the page of its order: integer geometry and a confidence from 0 to 100.

    Columns: pno, seq (from 1 within the page), x0, y0, x1, y1, conf, pick (0 to 7, to choose a text by).
    """
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    d = lineitem.withColumn("seq", F.row_number().over(order))
    key = F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")
    d = d.select(
        F.col("l_orderkey").alias("pno"),
        "seq",
        (F.col("l_partkey") % 400).cast("double").alias("x0"),
        (F.col("seq") * 9 + F.col("l_suppkey") % 7).cast("double").alias("y0"),
        (F.col("l_quantity") * 4 + 6).cast("double").alias("w"),
        (F.col("l_partkey") % 19 + 6).cast("double").alias("h"),
        (key % 101).cast("double").alias("conf"),
        (key % 8).cast("int").alias("pick"),
    )
    return d.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h")).drop("w", "h")


BOXES_SQL = """raw AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS seq FROM lineitem),
boxes AS (SELECT l_orderkey AS pno, seq, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(seq * 9 + l_suppkey % 7 AS DOUBLE) AS y0,
    CAST(l_partkey % 400 AS DOUBLE) + l_quantity * 4 + 6 AS x1, CAST(seq * 9 + l_suppkey % 7 + l_partkey % 19 + 6 AS DOUBLE) AS y1,
    CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 101 AS DOUBLE) AS conf, CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 8 AS INTEGER) AS pick FROM raw)"""

LINES_SQL = """lines AS (SELECT doc_id, source, lang, i - 1 AS line_no, p[i] AS line FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS p,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"""
