"""Separable resampling of scanline volumes and sparse masks.

An axis of ``n`` voxels becomes ``m``: output o reads position o*(n-1)/(m-1), linearly or from the nearest voxel. Along
z and y every scanline is sent to the few outputs that read it and those are summed; along x arrays are rebuilt in place. Masks
move voxel by voxel without a shuffle.

``plan`` is one row per case: ``case_id, nz, ny, nx, mz, my, mx`` and ``near_z, near_y, near_x`` (nearest instead of linear).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.geometry import DIM, ENDS, clip

PLAN = ["nz", "ny", "nx", "mz", "my", "mx", "near_z", "near_y", "near_x"]
# Ratio of largest to smallest spacing from which an axis counts as low resolution.
ANISOTROPY = 3.0


def single(value: Column) -> Column:
    """Rounded to single precision, in which zooms are defined, so that sizes round alike."""
    return value.cast("float").cast("double")


def zoom_plan(meta: DataFrame, zoom: dict[str, Column], near: dict[str, Column]) -> DataFrame:
    sizes = {f"m{a}": F.rint(F.col(DIM[a]) * zoom[a]).cast("int") for a in "zyx"}
    return meta.withColumns({**sizes, **{f"near_{a}": near[a] for a in "zyx"}, **{f"zoom_{a}": zoom[a] for a in "zyx"}})


def spacing_plan(meta: DataFrame, target_xyz: tuple[float, float, float], mode: str = "standard") -> DataFrame:
    """Plan from each case's spacing to a common one.

    ``anisotropic`` reads the axis of largest spacing from its nearest voxel when that spacing is at least three times the
    smallest (the first such axis on ties). Cases that already have the spacing keep their size.
    """
    if mode not in ("standard", "anisotropic"):
        raise ValueError(f"unknown resampling mode {mode!r}")
    target = dict(zip("xyz", (float(v) for v in target_xyz)))
    same = F.expr(" AND ".join(f"abs(s{a} - {t}D) <= 1e-6D + 1e-5D * {t}D" for a, t in target.items()))
    zoom = {a: F.when(same, F.lit(1.0)).otherwise(single(single(F.col(f"s{a}")) / single(F.lit(target[a])))) for a in "zyx"}
    low = F.lit(False)
    near = {}
    largest, smallest = F.greatest("sz", "sy", "sx"), F.least("sz", "sy", "sx")
    taken = F.lit(False)
    for a in "zyx":
        hit = (F.col(f"s{a}") == largest) & ~taken & (largest / smallest >= ANISOTROPY) if mode == "anisotropic" else low
        near[a] = hit
        taken = taken | (F.col(f"s{a}") == largest)
    return zoom_plan(meta, zoom, near)


def shape_plan(meta: DataFrame, size_zyx: tuple[int, int, int], nearest: bool = False) -> DataFrame:
    """Plan to an exact shape."""
    sizes = {f"m{a}": F.lit(int(s)) for a, s in zip("zyx", size_zyx)}
    zoom = {f"zoom_{a}": single(F.lit(float(s)) / F.greatest(F.col(DIM[a]), F.lit(1))) for a, s in zip("zyx", size_zyx)}
    return meta.withColumns({**sizes, **zoom, **{f"near_{a}": F.lit(nearest) for a in "zyx"}})


def _position(axis: str, out: str) -> str:
    return f"if(m{axis} > 1, {out} * ((n{axis} - 1) / (m{axis} - 1)), 0D)"


def _targets(axis: str) -> str:
    """Outputs that may read voxel ``<axis>``."""
    scale = f"((m{axis} - 1) / (n{axis} - 1))"
    low = f"greatest(0, cast(floor(({axis} - 1) * {scale}) AS int))"
    high = f"least(m{axis} - 1, cast(ceil(({axis} + 1) * {scale}) AS int))"
    return f"if(n{axis} > 1 AND m{axis} > 1, sequence({low}, greatest({low}, {high})), if(n{axis} > 1, array(0), sequence(0, m{axis} - 1)))"


def _weight(axis: str) -> str:
    at = _position(axis, "o")
    return f"if(near_{axis}, if(floor({at} + 0.5D) = {axis}, 1D, 0D), greatest(0D, 1 - abs({at} - {axis})))"


def _along(lines: DataFrame, axis: str) -> DataFrame:
    other = "y" if axis == "z" else "z"
    sent = lines.selectExpr("*", f"explode({_targets(axis)}) AS o").withColumn("w", F.expr(_weight(axis))).where("w > 0")
    parts = sent.groupBy("case_id", other, "o").agg(F.collect_list(F.struct(axis, "w", "vals")).alias("p"), *[F.first(c).alias(c) for c in PLAN])
    total = """aggregate(slice(array_sort(p), 2, size(p)), transform(array_sort(p)[0].vals, v -> v * array_sort(p)[0].w),
                 (acc, q) -> zip_with(acc, q.vals, (a, v) -> a + v * q.w))"""
    return parts.select("case_id", other, F.col("o").alias(axis), F.expr(total).alias("vals"), *PLAN)


def resample_lines(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Resample scanlines ``(case_id, z, y, vals)`` by a plan."""
    planned = lines.select("case_id", "z", "y", "vals").join(plan.select("case_id", *PLAN), "case_id")
    at = _position("x", "o")
    x = f"""transform(sequence(0, mx - 1), o -> if(near_x, vals[cast(floor({at} + 0.5D) AS int)],
            vals[cast(floor({at}) AS int)] * (1 - ({at} - floor({at}))) + if({at} > floor({at}), vals[cast(floor({at}) AS int) + 1] * ({at} - floor({at})), 0D)))"""
    along_x = planned.withColumn("vals", F.expr(x))
    return _along(_along(along_x, "y"), "z").select("case_id", "z", "y", "vals")


def resample_mask(mask: DataFrame, plan: DataFrame) -> DataFrame:
    """Nearest resampling of sparse voxels; other columns (labels, classes) ride along."""
    rest = [c for c in mask.columns if c not in ("case_id", "z", "y", "x")]
    out = mask.join(plan.select("case_id", *PLAN), "case_id")
    for axis in "zyx":
        out = out.selectExpr("*", f"explode({_targets(axis)}) AS o").where(f"floor({_position(axis, 'o')} + 0.5D) = {axis}")
        out = out.withColumn(axis, F.col("o").cast("int")).drop("o")
    return out.select("case_id", "z", "y", "x", *rest)


def resample_prompts(prompts: DataFrame, plan: DataFrame) -> DataFrame:
    """Endpoints scaled and clipped into the new frame, slice scaled, rounded and clipped."""
    cols = ["mz", "my", "mx", "zoom_z", "zoom_y", "zoom_x"]
    joined = prompts.drop(*cols).join(plan.select("case_id", *cols), "case_id")
    ends = {e: clip(F.col(e) * F.col(f"zoom_{e[1]}"), 0.0, F.col(f"m{e[1]}") - 1) for e in ENDS}
    moved = joined.withColumns(ends).withColumn("slice", clip(F.rint(F.col("slice") * F.col("zoom_z")), 0, F.col("mz") - 1).cast("int"))
    return moved.withColumns({f"n{a}": F.col(f"m{a}") for a in "zyx"}).drop(*cols)


def project_voxels(mask: DataFrame, plan: DataFrame) -> DataFrame:
    """Every voxel's image under the zoom, so that small targets survive shrinking."""
    cols = ["mz", "my", "mx", "zoom_z", "zoom_y", "zoom_x"]
    joined = mask.select("case_id", "z", "y", "x").join(plan.select("case_id", *cols), "case_id")
    out = joined.withColumns({a: clip(F.floor(single((F.col(a) + 0.5) * F.col(f"zoom_{a}"))), 0, F.col(f"m{a}") - 1).cast("int") for a in "zyx"})
    return out.select("case_id", "z", "y", "x").distinct()


def resize_keep_target(mask: DataFrame, plan: DataFrame) -> DataFrame:
    """Nearest resize of a binary mask plus the projection of each of its voxels."""
    return resample_mask(mask.select("case_id", "z", "y", "x"), plan).unionByName(project_voxels(mask, plan)).distinct()
