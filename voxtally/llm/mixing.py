"""Mixing sources to target weights: repetition rates from word totals, whole copies plus one hash-seeded Bernoulli copy.

The Bernoulli chance is the fraction of the rate, set on the draws themselves so that each source meets its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.shared import documents, stored, text_of

#: A word is a run of other characters than these blanks.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from the columns source and size: one row per source.

    Sources in code-point order, null last, weigh 3, 1, 2, repeating. A target is ``weight * level`` unless that is above twice the source's
    size. The level is the one at which all targets sum to the share: sources are met in the order in which they fill up, and what is
    left is shared by the weights of the rest. Only sources, pre-aggregated, are ordered.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    everything = Window.partitionBy()
    position = F.row_number().over(everything.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (position % len(WEIGHTS) + 1).cast("int"))
    weighed = per.select("source", "source_size", weight.cast("long").alias("weight")).withColumn("cap", F.col("source_size") * MOST)
    filled = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").cast("binary").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "*", F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(filled), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("weight").over(filled), F.lit(0)).alias("weight_before"),
    ).withColumn("level", (F.lit(SHARE) * F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    # the level rises with each source that it fills and falls after the first that it doesn't: the largest one holds
    return levels.withColumn("level", F.max("level").over(everything)).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def step() -> Column:
    """Which of 4,096 steps of [0, 1) the draw falls in (three hexadecimal digits), from id and text alone, so reruns and retried tasks agree."""
    digest = F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text_of()).cast("binary"))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def source_rates(steps: DataFrame) -> DataFrame:
    """source, source_size, target, whole, steps_taken from the columns source, step and size: one row per source.

    A source's documents are taken ``whole`` times, and once more if their step is below ``steps_taken``. That is the fraction of the rate
    as the draws have it: as many steps as bring the words nearest to the target, so a source is off by half a step's words at most.
    """
    words = steps.groupBy("source", "step").agg(F.sum("size").cast("long").alias("size"))
    words = stored(words, "steps")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(words).withColumn("whole", F.floor(rate)).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middles = words.select(F.col("source").alias("of_source"), "step", (F.sum("size").over(up_to) - F.col("size") / F.lit(2.0)).alias("middle"))
    taken = F.max(F.when((F.col("more") > 0) & (F.col("middle") <= F.col("more")), F.col("step") + 1))
    met = targets.join(middles, F.col("source").eqNullSafe(F.col("of_source")))
    return met.groupBy("source", "source_size", "target", "whole").agg(F.coalesce(taken, F.lit(0)).alias("steps_taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """All columns of the documents in ``row``, with size, source_size, target and copies.

    Null texts have size 0; a null source is a source of its own; a source without words has target 0 and keeps nothing. Rows with one id
    and one text share one draw. An empty table gives no rows.
    """
    drawn = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"), word_count().alias("size"), step().alias("step"))
    rates = source_rates(drawn.select("source", "size", "step")).withColumnRenamed("source", "of_source")
    joined = drawn.join(rates, F.col("source").eqNullSafe(F.col("of_source")))
    return joined.withColumn("copies", (F.col("whole") + (F.col("step") < F.col("steps_taken")).cast("long")).cast("int"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    return mixed(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size, its source's size and target, and the words that the mix takes of it; edge cases as in ``mixed``."""
    rows = mixed(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 3))::BIGINT AS step FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM per),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
words AS (SELECT source, step, sum(size)::BIGINT AS size FROM sized GROUP BY 1, 2),
middles AS (SELECT source, step, sum(size) OVER (PARTITION BY source ORDER BY step) - size / 2.0::DOUBLE AS middle FROM words),
taken AS (SELECT r.source, max(step) AS last_step FROM rates r JOIN middles m ON r.source IS NOT DISTINCT FROM m.source WHERE target - whole * source_size > 0 AND middle <= target - whole * source_size GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN step <= coalesce(last_step, -1) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN taken t ON r.source IS NOT DISTINCT FROM t.source"""
