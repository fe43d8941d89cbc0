"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, own_names

BINS = 1 << 16


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Size, uniform number and tie breaker of each row, from its values alone."""
    return docs.withColumns(
        {
            "_pl_src": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_pl_x": F.length(F.bin(F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(1)))).cast("long"),
            "_pl_h": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        }
    )


def _odds(d: DataFrame) -> DataFrame:
    """Whole copies and the Pareto rank variable of the rest. d: _keyed rows with _pl_n and _pl_sum of their source."""
    u = (F.conv(F.substring("_pl_h", 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(16**13)
    p = F.col("_pl_rem").cast("double") / F.col("_pl_sum").cast("double")
    d = d.withColumn("_pl_whole", F.expr("(_pl_n * _pl_x) div _pl_sum")).withColumn("_pl_rem", F.expr("(_pl_n * _pl_x) % _pl_sum"))
    return d.withColumn("_pl_q", F.when(F.col("_pl_rem") > 0, (u / (1.0 - u)) / (p / (1.0 - p)))).withColumn("_pl_t", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit("")))))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = 0.5, seed: int = 7) -> DataFrame:
    """docs with `copies` (>= 1), the rows that the mix leaves out gone. A column `copies` that docs has is replaced.

    The mix has round(epochs * rows) rows, or none where no source that is there has a weight above 0. Each source gets a whole number of them by its weight: `weights` (those of
    sources that are absent count for nothing), or where none are given its row count to the power `temperature`.
    Within a source of n target rows, a document of size x (bits of its n_chars) is expected n * x / sum(x) times: the
    whole part is allocated for certain, the rest p competes in Pareto order sampling: rank by
    (u / (1 - u)) / (p / (1 - p)), take the smallest until the source has exactly its n rows. u comes from a
    hash of seed and doc_id, so a run can be repeated.

    Null source counts as the source ''; null or negative n_chars as 1; null doc_id as ''; ties in rank go by a
    hash of doc_id and text, and among rows that are equal in all of these any may be taken. An empty table gives an empty
    table.

    Scale: no row moves. Counts per source, then per source and one of 65,536 bins of the rank variable, locate the bin in
    which a source's sample ends; only that bin's keys are sorted. Every row then decides by itself against the cut
    of its source.
    """
    docs, names = own_names(docs)
    spark = docs.sparkSession
    keyed = _keyed(docs.drop("copies"), seed)
    per = keyed.groupBy("_pl_src").agg(F.count(F.lit(1)).alias("_pl_rows"), F.sum("_pl_x").alias("_pl_sum"))
    if weights is None:
        per = per.withColumn("_pl_w", F.pow(F.col("_pl_rows").cast("double"), F.lit(float(temperature))))
    else:
        table = spark.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "_pl_src string, _pl_w double")
        per = per.join(table, "_pl_src", "left").fillna(0.0, ["_pl_w"])
    # Running sums of the weights in the order of sources, by ranges of sources: within each, then what lies before it.
    per = materialize(per.repartitionByRange("_pl_src").withColumn("_pl_part", F.spark_partition_id()), "mix-weights")
    before = W.orderBy("_pl_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    parts = per.groupBy("_pl_part").agg(F.sum("_pl_w").alias("_pl_pw")).withColumn("_pl_before", F.coalesce(F.sum("_pl_pw").over(before), F.lit(0.0)))
    within = W.partitionBy("_pl_part").orderBy("_pl_src")
    total = per.agg(F.sum("_pl_rows").alias("_pl_all"), F.sum("_pl_w").alias("_pl_wall"))
    per = per.join(parts.drop("_pl_pw"), "_pl_part").crossJoin(F.broadcast(total))  # one row
    target = lambda w: F.coalesce(F.floor(F.floor(F.lit(float(epochs)) * F.col("_pl_all") + 0.5) * w / F.nullif("_pl_wall", F.lit(0.0)) + 0.5), F.lit(0)).cast("long")
    upto, lower = (F.coalesce(F.sum("_pl_w").over(within.rowsBetween(W.unboundedPreceding, k)), F.lit(0.0)) for k in (0, -1))
    per = per.withColumn("_pl_n", target(F.col("_pl_before") + upto) - target(F.col("_pl_before") + lower))
    per = materialize(per.select("_pl_src", "_pl_n", "_pl_sum"), "mix-sources")

    slim = _keyed(docs.select("doc_id", "source", "n_chars", "text"), seed).join(per, "_pl_src")
    slim = _odds(slim).withColumn("_pl_bin", F.floor(F.col("_pl_q") / (1.0 + F.col("_pl_q")) * BINS).cast("int"))
    bins = slim.groupBy("_pl_src", "_pl_bin").agg(F.count("_pl_q").alias("c"), F.sum("_pl_rem").alias("r"), F.first("_pl_sum").alias("s"))
    ordered = W.partitionBy("_pl_src").orderBy("_pl_bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("cum", F.sum("c").over(ordered)).withColumn("m", F.expr("sum(r) over (partition by _pl_src) div s"))
    cut = materialize(bins.where("_pl_bin is not null and m > cum - c and m <= cum").select("_pl_src", "_pl_bin", (F.col("m") - F.col("cum") + F.col("c")).alias("k")), "mix-bins")

    rank = W.partitionBy("_pl_src").orderBy("_pl_q", "_pl_t")
    edge = slim.join(cut, ["_pl_src", "_pl_bin"]).withColumn("i", F.row_number().over(rank)).withColumn("same", F.row_number().over(W.partitionBy("_pl_src", "_pl_q", "_pl_t").orderBy("i")))
    edge = materialize(edge.where("i = k").select("_pl_src", F.col("_pl_q").alias("_pl_qc"), F.col("_pl_t").alias("_pl_tc"), F.col("same").alias("_pl_same")), "mix-cuts")

    d = _odds(keyed.join(per, "_pl_src")).join(edge, "_pl_src", "left")
    first = F.col("_pl_q") < F.col("_pl_qc")
    level = (F.col("_pl_q") == F.col("_pl_qc")) & (F.col("_pl_t") <= F.col("_pl_tc"))
    at = level & (F.col("_pl_t") == F.col("_pl_tc"))
    d = d.withColumn("_pl_at", F.coalesce(at, F.lit(False))).withColumn("_pl_in", F.coalesce(first | level, F.lit(False)).cast("long"))
    ties = d.where("_pl_at").withColumn("_pl_in", (F.row_number().over(W.partitionBy("_pl_src").orderBy("_pl_t")) <= F.col("_pl_same")).cast("long"))
    d = d.where("not _pl_at").unionByName(ties).withColumn("copies", F.col("_pl_whole") + F.col("_pl_in"))
    return d.where("copies > 0").select(*[c for c in docs.columns if c.lower() != "copies"], "copies").withColumnsRenamed(names)


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as its copies say."""
    return mixed.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "n_chars", "copies")


SQL = """
WITH k AS (SELECT doc_id, source, n_chars, text, coalesce(source, '') AS src, CAST(length(bin(greatest(coalesce(n_chars, 0), 1))) AS BIGINT) AS x,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
per AS (SELECT src, count(*) AS n_rows, CAST(sum(x) AS BIGINT) AS sx, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM k GROUP BY src),
cum AS (SELECT src, sx, CAST(floor((SELECT CAST(sum(n_rows) AS DOUBLE) FROM per) * sum(w) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) / (SELECT sum(w) FROM per) + 0.5) AS BIGINT) AS upto FROM per),
tgt AS (SELECT src, sx, upto - coalesce(lag(upto) OVER (ORDER BY src), 0) AS n FROM cum),
o AS (SELECT k.*, n, sx, (n * x) // sx AS whole, (n * x) % sx AS rem, (CAST(CAST('0x' || substr(h, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM k JOIN tgt USING (src)),
q AS (SELECT *, CASE WHEN rem > 0 THEN (u / (1.0 - u)) / ((CAST(rem AS DOUBLE) / CAST(sx AS DOUBLE)) / (1.0 - CAST(rem AS DOUBLE) / CAST(sx AS DOUBLE))) END AS q,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS t, CAST(sum(rem) OVER (PARTITION BY src) AS BIGINT) // sx AS m FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY q NULLS LAST, t) AS i FROM q)
SELECT doc_id, source, n_chars, whole + CASE WHEN q IS NOT NULL AND i <= m THEN 1 ELSE 0 END AS copies FROM r
WHERE whole + CASE WHEN q IS NOT NULL AND i <= m THEN 1 ELSE 0 END > 0
"""
