"""Loss audits over tables of logits; sums are per sample or class and combine before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH = 1e-6


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hard_dice(logits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean over samples of the Dice of thresholded probabilities; a sample empty on both sides scores 1."""
    on, hit = sigmoid(F.col("logit")) >= threshold, F.col("target") > 0
    sums = logits.groupBy("sample").agg(F.count_if(on & hit).alias("tp"), (F.count_if(on) + F.count_if(hit)).alias("total"))
    return sums.agg(F.avg(F.when(F.col("total") == 0, 1.0).otherwise(2 * F.col("tp") / F.col("total"))).alias("hard_dice"))


def dice_bce(logits: DataFrame, dice_weight: float = 1.0, bce_weight: float = 2.0) -> DataFrame:
    """Soft Dice loss averaged over samples, cross-entropy averaged over voxels, and their weighted sum."""
    p, t, x = sigmoid(F.col("logit")), F.col("target"), F.col("logit")
    bce = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    sums = logits.groupBy("sample").agg(F.sum(p * t).alias("both"), F.sum(p + t).alias("mass"), F.sum(bce).alias("bce"), F.count(F.lit(1)).alias("n"))
    loss = 1 - (2 * F.col("both") + SMOOTH) / (F.col("mass") + SMOOTH)
    return sums.agg(F.avg(loss).alias("dice_loss"), (F.sum("bce") / F.sum("n")).alias("bce_loss")).withColumn(
        "loss", dice_weight * F.col("dice_loss") + bce_weight * F.col("bce_loss")
    )


def class_ce_dice(scores: DataFrame) -> DataFrame:
    """Cross-entropy over valid voxels and Dice loss over the classes present in each sample, half each.

    ``scores(sample, scores ARRAY, target)``; targets outside the classes are ignored.
    """
    valid = scores.where("target >= 0 AND target < size(scores)").withColumn("top", F.array_max("scores"))
    log_sum = F.col("top") + F.log(F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top"))))
    scored = valid.withColumn("lse", log_sum).withColumn("ce", F.col("lse") - F.expr("scores[target]"))
    classes = scored.select("sample", "target", "lse", "ce", F.posexplode("scores").alias("class", "score")).select(
        "sample", "class", F.exp(F.col("score") - F.col("lse")).alias("p"), (F.col("class") == F.col("target")).cast("int").alias("t"), "ce"
    )
    sums = classes.groupBy("sample", "class").agg(
        F.sum(F.expr("p * t")).alias("both"), F.sum(F.expr("p + t")).alias("mass"), F.sum("t").alias("voxels"), F.sum(F.expr("ce * t")).alias("ce")
    )
    present = F.col("voxels") > 0
    loss = F.when(present, 1 - (2 * F.col("both") + SMOOTH) / (F.col("mass") + SMOOTH))
    return sums.agg(
        F.coalesce(F.sum("ce") / F.sum("voxels"), F.lit(0.0)).alias("ce_loss"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("dice_loss")
    ).withColumn("loss", F.expr("0.5 * ce_loss + 0.5 * dice_loss"))


def weighted_level_mean(levels: DataFrame, weights: tuple[float, ...] = (1.0, 0.5, 0.25, 0.125)) -> DataFrame:
    """Weighted mean of ``loss`` over ``level`` per step; the last weight repeats for deeper levels."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(table, F.least(F.col("level") + 1, F.lit(len(weights))).cast("int"))
    return levels.groupBy("step").agg((F.sum(weight * F.col("loss")) / F.sum(weight)).alias("main_loss"))
