"""Seeded sampling plans: every draw is a hash of its row's key, so a plan is the same wherever its rows are computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.geometry import DIM, ENDS, clip

# 48 bits of a hash as a fraction.
_HEX_DIGITS = 12


def uniform(*key, tag: str = "", seed: int = 13) -> Column:
    """A fraction in [0, 1) from the md5 of the key's parts, a tag and a seed."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(tag), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("bigint") / float(16**_HEX_DIGITS)


def whole(low: int, high: int, draw: Column) -> Column:
    """An integer in [low, high] from a uniform draw."""
    return (F.floor(draw * (high - low + 1)) + low).cast("int")


def jitter_center(df: DataFrame, jitter_zyx: tuple[int, int, int], key: list[str], seed: int = 13) -> DataFrame:
    """Integer jitter per axis as ``jz, jy, jx``."""
    return df.withColumns({
        f"j{a}": whole(-int(j), int(j), uniform(*key, tag=f"jitter_{a}", seed=seed)) if j > 0 else F.lit(0) for a, j in zip("zyx", jitter_zyx)
    })


def plan_training_crops(
    samples: DataFrame, fractions: tuple[float, float, float] = (0.60, 0.30, 0.10), scales: int = 4, key: tuple[str, ...] = ("case_id", "epoch"), seed: int = 13
) -> DataFrame:
    """Crop kind per sample: prompt-centred, wider field of view at one of ``scales`` scales, or fitted to the box.

    The last is only for samples with ``needs_tail``; others fall back to the prompt-centred crop.
    """
    base, wide, tail = fractions
    draw = uniform(*key, tag="crop", seed=seed) * max(base + wide + tail, 1e-6)
    kind = (
        F.when(F.col("needs_tail") & (F.col("draw") >= base + wide) & (F.col("draw") < base + wide + tail), "mixed_recist_bbox_fit_tail")
        .when((F.col("draw") >= base) & (F.col("draw") < base + wide), "mixed_prompt_multifov")
        .otherwise("mixed_prompt_base")
    )
    out = samples.withColumn("draw", draw).withColumn("crop_kind", kind)
    scale = F.when(F.col("crop_kind") == "mixed_prompt_multifov", whole(0, scales - 1, uniform(*key, tag="scale", seed=seed)))
    return out.withColumn("scale_index", scale).drop("draw")


def hard_negatives(plan: DataFrame, fraction: float, weight: float = 0.25, key: tuple[str, ...] = ("case_id", "epoch"), seed: int = 13) -> DataFrame:
    """With probability ``fraction`` a sample loses its target, gets a wrong prompt and a small weight."""
    hard = uniform(*key, tag="hard", seed=seed) < F.lit(min(max(float(fraction), 0.0), 1.0))
    out = plan.withColumn("hard_negative", hard)
    return out.withColumns({
        "crop_kind": F.when(F.col("hard_negative"), F.concat("crop_kind", F.lit("_hard_negative"))).otherwise(F.col("crop_kind")),
        "prompt_mode": F.when(F.col("hard_negative"), "wrong_prompt").otherwise("full"),
        "main_loss_weight": F.when(F.col("hard_negative"), F.lit(max(float(weight), 0.0))).otherwise(1.0),
    })


def perturb_endpoints(
    prompts: DataFrame, probability: float, shift_xy: int = 0, jitter_xy: int = 0, slice_jitter: int = 0,
    scale: tuple[float, float] = (1.0, 1.0), key: tuple[str, ...] = ("case_id", "prompt"), seed: int = 13,
) -> DataFrame:
    """Scale a diameter about its middle, shift it, jitter its ends and its slice; then clip into the frame."""
    low, high = scale
    if low > high:
        raise ValueError("smallest scale exceeds largest")

    def draw(tag: str) -> Column:
        return uniform(*key, tag=tag, seed=seed)

    factor = F.lit(low) + (high - low) * draw("scale")
    moved = {}
    for e in ENDS:
        axis = e[1]
        if axis == "z":
            value = F.col(e) + (whole(-slice_jitter, slice_jitter, draw("slice")) if slice_jitter > 0 else F.lit(0))
        else:
            middle = (F.col(f"a{axis}") + F.col(f"b{axis}")) / 2
            value = middle + (F.col(e) - middle) * factor
            if shift_xy > 0:
                value = value + whole(-shift_xy, shift_xy, draw(f"shift_{axis}"))
            if jitter_xy > 0:
                value = value + whole(-jitter_xy, jitter_xy, draw(f"jitter_{e}"))
        moved[e] = F.when(F.col("hit"), clip(value, 0.0, F.col(DIM[axis]) - 1)).otherwise(F.col(e))
    hit = draw("hit") < F.lit(min(max(float(probability), 0.0), 1.0))
    return prompts.withColumn("hit", hit).withColumns(moved)


def intensity_jitter(lines: DataFrame, scale: float, shift: float, noise: float, key: tuple[str, ...] = ("case_id",), seed: int = 13) -> DataFrame:
    """Per case one scale and one shift, per voxel Gaussian noise (Box-Muller over hash draws)."""
    factor = 1 + (2 * uniform(*key, tag="factor", seed=seed) - 1) * float(max(scale, 0.0))
    offset = (2 * uniform(*key, tag="offset", seed=seed) - 1) * float(max(shift, 0.0))
    out = lines.withColumn("factor", factor).withColumn("offset", offset)
    if noise <= 0:
        return out.withColumn("vals", F.expr("transform(vals, v -> v * factor + offset)")).drop("factor", "offset")

    def voxel_draw(index: Column, tag: str) -> Column:
        parts = [*[F.col(k).cast("string") for k in (*key, "z", "y")], index.cast("string"), F.lit(tag), F.lit(str(seed))]
        digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
        return (F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("bigint") + 1) / float(16**_HEX_DIGITS + 1)

    def noisy(v: Column, i: Column) -> Column:
        gauss = F.sqrt(-2 * F.log(voxel_draw(i, "radius"))) * F.cos(2 * F.pi() * voxel_draw(i, "angle"))
        return v * F.col("factor") + F.col("offset") + gauss * float(noise)

    return out.withColumn("vals", F.transform("vals", noisy)).drop("factor", "offset")


def epoch_shuffle(records: DataFrame, epoch: int, shards: int, seed: int = 13) -> DataFrame:
    """A new order per epoch: a sort key from a hash, and a shard of near equal size from the same hash.

    Shards come from the hash itself, not from a global rank, so no task orders the whole table.
    """
    draw = uniform("case_id", tag=f"epoch_{int(epoch)}", seed=seed)
    return records.withColumn("draw", draw).withColumn("shard", F.floor(F.col("draw") * int(shards)).cast("int"))
