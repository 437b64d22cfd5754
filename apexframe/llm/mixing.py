"""Operator 7 [native]: mixing sources to target weights by capped water-filling.

Sources share all words in proportion to their weights. A source whose share exceeds `max_epochs` times its own words is
clamped there and its excess goes to the others by weight, until none is above: sorted by cap per weight, the clamped
sources are a prefix, so window sums over the (small) source table find the fixed point at once. Every document of a
source is then taken a whole number of times, and a seeded order of its documents is followed for the fraction that is
left. The order is cut by 4096 hash buckets: sums per bucket come first, exact positions are counted within a bucket, so
no source is ever sorted in one task. DataFrame functions only.

Defined results: null or blank texts have size 0 and are taken 0 words; a null source is a source of its own, last in
order; an empty table gives an empty result; repeated rows are sampled as rows of their own; input columns that are
named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source in and out."""
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.select("source", "source_size", F.row_number().over(by_name).alias("rank"), weight.cast("long").alias("w"))
    rows = rows.withColumns({"cap": F.col("source_size") * max_epochs, "total": F.sum("source_size").over(everything)})
    by_fill = W.orderBy(F.col("cap").cast("double") / F.col("w"), "rank")
    rows = rows.withColumns({
        "left": F.col("total") - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "w_left": F.sum("w").over(by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    rows = rows.withColumn("clamped", exact("cap") * exact("w_left") < exact("w") * exact("left"))
    # the first source that is not clamped has what is left for itself and all after it
    first = F.min_by(F.when(~F.col("clamped"), F.struct("left", "w_left")), F.when(~F.col("clamped"), F.col("cap").cast("double") / F.col("w"))).over(everything)
    rows = rows.withColumn("rest", first)
    share = F.col("w").cast("double") * F.col("rest.left").cast("double") / F.col("rest.w_left").cast("double")
    return rows.select("source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and repetitions (how often the mix takes the row)."""
    order = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.withColumns({"size": word_count(F.col("text")), "_ax_order": order})
    rows = rows.withColumn("_ax_bucket", F.substring("_ax_order", 1, 3))
    if set(docs.columns) == {"doc_id", "source", "text"}:
        rows = rows.drop("text")  # narrow rows: both branches below then share one exchange
    rows = rows.repartition("source", "_ax_bucket")
    buckets = rows.groupBy("source", "_ax_bucket").agg(F.sum("size").alias("n"), F.count("doc_id"), F.max("_ax_order"))
    ahead = W.partitionBy("source").orderBy("_ax_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole_source = W.partitionBy("source")
    buckets = buckets.select("source", "_ax_bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ax_ahead"), F.sum("n").over(whole_source).alias("source_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.max("source_size").alias("source_size")), weights, max_epochs)
    plan = buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("_ax_s"), F.col("_ax_bucket").alias("_ax_b"), "_ax_ahead", "t.source_size", "t.target")
    within = W.partitionBy("source", "_ax_bucket").orderBy("_ax_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.drop("source_size", "target", "repetitions").withColumn("_ax_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_ax_s")) & (F.col("_ax_bucket") == F.col("_ax_b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    extra = (F.col("_ax_ahead") + F.col("_ax_before") + F.col("size") / 2.0 < rest).cast("long")
    out = out.withColumn("repetitions", (whole + extra).cast("long"))
    return out.drop("_ax_order", "_ax_bucket", "_ax_before", "_ax_ahead", "_ax_s", "_ax_b")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Every row as often as the mix takes it."""
    return mixed.withColumn("_ax_i", F.explode(F.when(F.col("repetitions") > 0, F.sequence(F.lit(1), F.col("repetitions"))))).drop("_ax_i")


def op7_waterfill_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 5, 2, 1, repeating, none above 3 epochs."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')) AS ord
  FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s
), w AS (
  SELECT *, [5, 2, 1][((rnk - 1) % 3 + 1)::BIGINT] AS wt FROM r
), f AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / wt, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(wt) OVER (ORDER BY cap::DOUBLE / wt, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl
  FROM w
), c AS (
  SELECT *, (cap * wl < wt * lft) AS clamped FROM f
), u AS (
  SELECT arg_min(lft, cap::DOUBLE / wt) AS lft0, arg_min(wl, cap::DOUBLE / wt) AS wl0 FROM c WHERE NOT clamped
), t AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE wt::DOUBLE * lft0::DOUBLE / wl0::DOUBLE END AS target
  FROM c LEFT JOIN u ON true
), q AS (
  SELECT d.doc_id, d.size, t.source_size::BIGINT AS source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size::DOUBLE) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN before + size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q
"""
