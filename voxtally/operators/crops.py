"""Crops of scanline volumes and sparse masks by windows ``w_z0 .. w_x1``, padding, restoring, flips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.geometry import DIM, ENDS, endpoint_margin
from voxtally.operators.components import packed_stretches, stretches

WINDOW = [f"w_{a}{i}" for a in "zyx" for i in (0, 1)]


def crop_lines(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Scanlines inside each case's window, in window coordinates. Values are sliced, never exploded."""
    joined = lines.join(windows.select("case_id", *WINDOW), "case_id").where("z >= w_z0 AND z < w_z1 AND y >= w_y0 AND y < w_y1")
    return joined.select("case_id", F.expr("z - w_z0").alias("z"), F.expr("y - w_y0").alias("y"), F.expr("slice(vals, w_x0 + 1, w_x1 - w_x0)").alias("vals"))


def _voxels_inside(mask: DataFrame, windows: DataFrame, bounds: dict[str, tuple[str, str]], sign: str) -> DataFrame:
    """Voxels within bounds, moved by the window's start. Voxels meet their window as runs."""
    rest = [c for c in mask.columns if c != "case_id"]
    runs = stretches(mask, ("case_id", *[c for c in rest if c not in ("z", "y", "x")])).where("x0 IS NOT NULL")
    joined = runs.join(windows.select("case_id", *WINDOW), "case_id").where(" AND ".join(f"{a} BETWEEN {low} AND {high}" for a, (low, high) in bounds.items() if a != "x"))
    low, high = bounds["x"]
    cut = joined.withColumns({"x0": F.expr(f"greatest(x0, {low})"), "x1": F.expr(f"least(x1, {high})")}).where(f"x0 <= x1 AND {low} IS NOT NULL AND {high} IS NOT NULL")
    voxels = cut.withColumn("x", F.explode(F.sequence("x0", "x1")))
    return voxels.withColumns({a: F.expr(f"{a} {sign} w_{a}0") for a in "zyx"}).select("case_id", *rest)


def crop_mask(mask: DataFrame, windows: DataFrame) -> DataFrame:
    return _voxels_inside(mask, windows, {a: (f"w_{a}0", f"w_{a}1 - 1") for a in "zyx"}, "-")


def crop_endpoints(prompts: DataFrame) -> DataFrame:
    """Endpoints of prompts with a window, in window coordinates, with the crop's slice index and shape."""
    moved = prompts.withColumns({e: F.col(e) - F.col(f"w_{e[1]}0") for e in ENDS})
    shape = {f"restore_{a}": F.expr(f"w_{a}1 - w_{a}0") for a in "zyx"}
    return moved.withColumns({**shape, "slice": F.expr("cast(rint((az + bz) / 2) AS int)")})


def pad_lines(lines: DataFrame, shapes: DataFrame, size_zyx: tuple, value: float = 0.0) -> DataFrame:
    """Pad at the ends, or trim, to a size: numbers, or names of columns of ``shapes``.

    ``shapes(case_id, restore_z, restore_y, restore_x, ..)`` is the unpadded shape.
    """
    size = [F.col(s) if isinstance(s, str) else F.lit(int(s)) for s in size_zyx]
    sized = shapes.select("case_id", "restore_z", "restore_y", *[s.alias(f"pad_{a}") for a, s in zip("zyx", size)])
    fill = F.array_repeat(F.lit(float(value)), F.greatest(F.col("pad_x") - F.size("vals"), F.lit(0)))
    kept = lines.join(sized, "case_id").where("z < pad_z AND y < pad_y").withColumn("vals", F.slice(F.concat("vals", fill), F.lit(1), F.col("pad_x")))
    added = (
        sized.where("restore_z < pad_z OR restore_y < pad_y")
        .selectExpr("*", "explode(sequence(0, pad_z - 1)) AS z")
        .selectExpr("*", "explode(sequence(0, pad_y - 1)) AS y")
        .where("z >= restore_z OR y >= restore_y")
        .select("case_id", "z", "y", F.array_repeat(F.lit(float(value)), F.col("pad_x")).alias("vals"))
    )
    return kept.select("case_id", "z", "y", "vals").unionByName(added)


def restore_crop(crop: DataFrame, windows: DataFrame) -> DataFrame:
    """Crop voxels back in full-frame coordinates; voxels of the padding are dropped."""
    return _voxels_inside(crop, windows, {a: (str(-(2**31 - 1)), f"w_{a}1 - w_{a}0 - 1") for a in "zyx"}, "+")


def flip_lines(lines: DataFrame, meta: DataFrame, axes: str) -> DataFrame:
    """Mirror scanlines along the named axes."""
    joined = lines.join(meta.select("case_id", "nz", "ny"), "case_id")
    out = {a: F.expr(f"n{a} - 1 - {a}") for a in "zy" if a in axes}
    if "x" in axes:
        out["vals"] = F.reverse("vals")
    return joined.withColumns(out).drop("nz", "ny") if out else lines


def flip_mask(mask: DataFrame, meta: DataFrame, axes: str) -> DataFrame:
    joined = mask.join(meta.select("case_id", *DIM.values()), "case_id")
    return joined.withColumns({a: F.expr(f"n{a} - 1 - {a}") for a in axes}).drop(*DIM.values())


def endpoints_inside(margin_mm: float, frame: dict[str, Column] | None = None) -> Column:
    """Both endpoints at least a margin (at most half the axis) away from every face."""
    checks = []
    for axis in "zyx":
        top = (F.col(DIM[axis]) if frame is None else frame[axis]) - 1
        margin = F.least(endpoint_margin(axis, margin_mm), F.greatest(top, F.lit(0)) * 0.5)
        checks += [F.col(f"{e}{axis}") >= margin for e in "ab"] + [F.col(f"{e}{axis}") <= top - margin for e in "ab"]
    return reduce(Column.__and__, checks)


def needs_bbox_tail(prompts: DataFrame, target: DataFrame, size_zyx: tuple[int, int, int], margin_mm: float = 0.0) -> DataFrame:
    """Whether a prompt crop serves its target badly: the box exceeds the crop, under 95% of voxels are inside, the mask
    touches the crop's faces, or an endpoint lies outside the crop's margin.

    ``prompts`` carry windows, shape and spacing; ``target(case_id, z, y, x)``. A case without target voxels never needs it.
    """
    ends = {"z": ("z", "z"), "y": ("y", "y"), "x": ("x0", "x1")}
    low, high = ({a: f"greatest({ends[a][0]}, w_{a}0)" for a in "zyx"}, {a: f"least({ends[a][1]}, w_{a}1 - 1)" for a in "zyx"})
    inside = F.expr(" AND ".join(f"{ends[a][1]} >= w_{a}0 AND {ends[a][0]} < w_{a}1" for a in "zyx"))
    pieces = packed_stretches(target, ("case_id",), by=("case_id",)).join(prompts.select("case_id", *WINDOW), "case_id")
    facts = pieces.selectExpr("case_id", *WINDOW, "inline(arrays_zip(z, y, x0, x1))").groupBy("case_id").agg(
        F.sum(F.expr("cast(coalesce(x1 - x0, 0) + 1 AS bigint)")).alias("voxels"),
        F.coalesce(F.sum(F.when(inside, F.expr(f"cast({high['x']} - {low['x']} + 1 AS bigint)"))), F.lit(0)).alias("kept"),
        *[(F.max(ends[a][1]) - F.min(ends[a][0]) + 1).alias(f"extent_{a}") for a in "zyx"],
        *[F.min(F.when(inside, F.expr(f"{low[a]} - w_{a}0"))).alias(f"in_{a}0") for a in "zyx"],
        *[F.max(F.when(inside, F.expr(f"{high[a]} - w_{a}0 + 1"))).alias(f"in_{a}1") for a in "zyx"],
    )
    size = {a: int(s) for a, s in zip("zyx", size_zyx)}
    too_big = reduce(Column.__or__, [F.col(f"extent_{a}") > size[a] for a in "zyx"])
    touching = reduce(Column.__or__, [(F.col(f"in_{a}0") <= 0) | (F.col(f"in_{a}1") >= size[a]) for a in "zyx"])
    moved = crop_endpoints(prompts).join(facts, "case_id", "left")
    far = ~endpoints_inside(margin_mm, {a: F.lit(size[a]) for a in "zyx"})
    verdict = F.coalesce(F.col("voxels"), F.lit(0)) > 0
    return moved.select("case_id", (verdict & (too_big | (F.col("kept") / F.col("voxels") < 0.95) | F.coalesce(touching, F.lit(False)) | far)).alias("needs_tail"))
