"""Diameter prompts: rasterised lines, endpoint Gaussians, marker components, endpoints from masks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.functions.geometry import ENDS, clip_to_frame, effective_endpoints, shift_to_wrong_place
from voxtally.functions.grids import changes, group_starts, shares, spread, whole_groups
from voxtally.operators.components import component_runs, merged, runs_to_voxels, stretches, together
from voxtally.session import never_sent

PROMPT_MODES = ("full", "no_prompt", "line_only", "endpoint_only", "wrong_prompt")
# Gaussian level from which a voxel belongs to the prompt region.
REGION_LEVEL = 0.25
# Runs, before they are merged, that prompts make together.
MADE = 1_000_000
# Stands for the size of an axis that is not known.
_NO_END = 2**31


def _prompt_key() -> Column:
    return F.concat(F.col("prompt").cast("bigint").cast("string"), F.lit("#"), F.col("case_id").cast("string"))


def key_by_prompt(prompts: DataFrame) -> DataFrame:
    """Prompts whose ``case_id`` names the prompt as well, ``<prompt>#<case_id>``, so that operators with one prompt per ``case_id`` take every prompt.

    ``prompt`` is a whole number; ``(case_id, prompt)`` is unique.
    """
    return prompts.withColumn("case_id", _prompt_key())


def copy_to_prompts(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """Rows of each case once for every prompt of it, under the key of :func:`key_by_prompt`. ``prompts`` are those without that key."""
    keys = never_sent(prompts.select("case_id", _prompt_key().alias("_key")))
    return rows.join(keys, "case_id").withColumn("case_id", F.col("_key")).drop("_key")


def split_prompt_key(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """``case_id`` and ``prompt`` back from the key, in the types of ``prompts``."""
    kinds = {c: prompts.schema[c].dataType for c in ("case_id", "prompt")}
    parts = {"case_id": F.expr("substring(case_id, instr(case_id, '#') + 1)"), "prompt": F.expr("substring_index(case_id, '#', 1)")}
    return rows.withColumns({c: part.cast(kinds[c]) for c, part in parts.items()})


def _lines(prompts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Clipped endpoints, their slice, single-precision starts and steps of their lines, half a voxel each."""
    return clip_to_frame(prompts).selectExpr(
        *keys, "nz", "ny", "nx", *ENDS, "cast(rint((az + bz) / 2) AS int) AS cz",
        "cast(ay AS float) AS ya", "cast(ax AS float) AS xa", "cast(by - ay AS float) AS dy", "cast(bx - ax AS float) AS dx",
        "greatest(cast(ceil(2 * sqrt(pow(bx - ax, 2) + pow(by - ay, 2))) AS int), 1) AS steps",
    )


def rasterize_line(prompts: DataFrame, radius: int = 2, z_thickness: int = 0, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Voxels of a line between the clipped endpoints, in the slice of their rounded mean z, in steps of half a voxel: at each of its points a disk of
    ``radius`` in the plane, repeated ``z_thickness`` slices up and down."""
    return runs_to_voxels(_runs_of(prompts, keys, _chords(int(radius), int(z_thickness)), None))


def _gauss(sigma: float) -> str:
    spread = 2.0 * max(float(sigma) ** 2, 1e-6)
    one = "exp(-(pow(z - {e}z, 2) + pow(y - {e}y, 2) + pow(x - {e}x, 2)) / %rD)" % spread
    return f"greatest({one.format(e='a')}, {one.format(e='b')})"


def endpoint_gaussian(voxels: DataFrame, prompts: DataFrame, sigma: float = 2.0, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Gaussian channel at the given voxels: the nearer clipped endpoint's value."""
    ends = clip_to_frame(prompts).select(*keys, *ENDS)
    rest = [c for c in voxels.columns if c not in keys]
    runs = stretches(voxels, (*keys, *[c for c in rest if c not in ("z", "y", "x")]))
    met = runs.join(ends, list(keys)).withColumn("x", F.explode_outer(F.sequence("x0", "x1")))
    return met.select(*keys, *rest, F.expr(_gauss(sigma)).alias("gauss"))


def gaussian_support(prompts: DataFrame, sigma: float, level: float, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """All voxels whose Gaussian exceeds ``level``, found inside boxes around the endpoints."""
    reach = math.ceil(math.sqrt(2.0 * max(sigma**2, 1e-6) * math.log(1.0 / level)))
    ends = clip_to_frame(prompts)
    boxes = ends.selectExpr(
        *keys, *ENDS, "nz", "ny", "nx", "inline(array(named_struct('ez', az, 'ey', ay, 'ex', ax), named_struct('ez', bz, 'ey', by, 'ex', bx)))"
    )
    for axis in "zyx":
        low, high = f"greatest(0, cast(floor(e{axis}) AS int) - {reach})", f"least(n{axis} - 1, cast(ceil(e{axis}) AS int) + {reach})"
        boxes = boxes.selectExpr("*", f"explode(sequence({low}, {high})) AS {axis}")
    return boxes.withColumn("gauss", F.expr(_gauss(sigma))).where(F.col("gauss") > level).select(*keys, "z", "y", "x", "gauss").distinct()


def prompt_region(prompts: DataFrame, sigma: float = 2.0, mode: str = "full", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Line voxels and voxels with a Gaussian above the region level, under a prompt mode."""
    return runs_to_voxels(prompt_region_runs(prompts, sigma, mode, keys))


def prompt_channels(lines: DataFrame, prompts: DataFrame, sigma: float = 2.0, mode: str = "full") -> DataFrame:
    """Add the channels ``line`` and ``gauss`` (arrays along x) to scanlines ``(case_id, z, y, vals)``.

    The prompt's frame is the scanlines' own. Values are complete: every voxel of every scanline has both.
    """
    if mode not in PROMPT_MODES:
        raise ValueError(f"unknown prompt mode {mode!r}")
    prompts = shift_to_wrong_place(prompts) if mode == "wrong_prompt" else prompts
    shows_line, shows_ends = mode not in ("no_prompt", "endpoint_only"), mode not in ("no_prompt", "line_only")
    marks = _runs_of(prompts, ("case_id",), _chords(2, 0), None).groupBy("case_id", "z").agg(*[F.collect_list(c).alias(f"_{c}") for c in ("y", "x0", "x1")])
    ends = clip_to_frame(prompts).select("case_id", *[F.col(e).alias(f"_{e}") for e in ENDS], F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("z"))
    # lines stay where they are if they lie by slice; else they are sent once
    slices = never_sent(ends.join(never_sent(marks), ["case_id", "z"], "left"))
    met = lines.join(slices, ["case_id", "z"]).select(*lines.columns, *[f"_{e}" for e in ENDS], "_y", "_x0", "_x1")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return never_sent(met.mapInArrow(_channels(lines.columns, 2.0 * max(float(sigma) ** 2, 1e-6), shows_line, shows_ends), f"{kinds}, line array<double>, gauss array<double>"))


def _channels(columns: list[str], spread_by: float, shows_line: bool, shows_ends: bool):
    """Scanlines with both channels, from the clipped endpoints of their case and the marked runs of their slice."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vals = batch["vals"]
            count = pc.list_value_length(vals).fill_null(0).to_numpy().astype(np.int64)
            starts = np.cumsum(count) - count
            row = np.repeat(np.arange(len(count)), count)
            x = np.arange(len(row)) - starts[row]
            z, y = (batch[c].to_numpy(zero_copy_only=False) for c in ("z", "y"))
            gauss, line = np.zeros(len(row)), np.zeros(len(row))
            if shows_ends:
                at = {c: batch[f"_{c}"].to_numpy(zero_copy_only=False) for c in ENDS}
                rest = {e: (z - at[f"{e}z"]) ** 2 + (y - at[f"{e}y"]) ** 2 for e in "ab"}
                nearer = np.minimum(*(rest[e][row] + (x - at[f"{e}x"][row]) ** 2 for e in "ab"))
                gauss = np.exp(-nearer / spread_by)
            if shows_line:
                runs = batch["_y"]
                n = pc.list_value_length(runs).fill_null(0).to_numpy().astype(np.int64)
                of = np.repeat(np.arange(len(n)), n)
                my, x0, x1 = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("_y", "_x0", "_x1"))
                own = my == y[of]
                of, x0, x1 = of[own], x0[own], np.minimum(x1[own], count[of[own]] - 1)
                line[spread(starts[of] + x0, np.maximum(x1 - x0 + 1, 0))] = 1.0
            offsets = pa.array(np.r_[starts, len(row)].astype(np.int32), mask=np.r_[vals.is_null().to_numpy(zero_copy_only=False), False] if vals.null_count else None)
            made = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (line, gauss)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], *made], names=[*columns, "line", "gauss"])

    return add


def _chords(radius: int, thick: int) -> list[tuple[int, int, int]]:
    """Lines of a disk of ``radius``, for ``thick`` slices up and down: steps in z and y, and half widths."""
    return [(i, j, math.isqrt(radius * radius - j * j)) for i in range(-thick, thick + 1) for j in range(-radius, radius + 1)]


def _along(table: pa.Table, chords: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Runs of disks, as their chords, at all steps of the lines: row, z, y, x0, x1. Positions are single precision, as the measured tool's, so that halves round alike."""
    steps = table["steps"].to_numpy().astype(np.int64)
    row = np.repeat(np.arange(table.num_rows), steps + 1)
    i = np.arange(len(row)) - np.repeat(np.cumsum(steps + 1) - (steps + 1), steps + 1)
    t = (i * (1.0 / steps)[row]).astype(np.float32)
    py, px = (np.rint((table[f"{s}a"].to_numpy()[row] + t * table[f"d{s}"].to_numpy()[row]).astype(np.float64)).astype(np.int64) for s in "yx")
    new = np.r_[True, (np.diff(row) != 0) | (np.diff(py) != 0) | (np.diff(px) != 0)] if len(row) else np.empty(0, bool)
    row, py, px = (c[new][:, None] for c in (row, py, px))
    dz, dy, half = (np.array(c)[None, :] for c in zip(*chords))
    z, y = table["cz"].to_numpy().astype(np.int64)[row] + dz, py + dy
    nz, ny, nx = (table[c].cast(pa.int64()).fill_null(-1 if c != "nx" else _NO_END).to_numpy()[row] for c in ("nz", "ny", "nx"))
    x0, x1 = np.maximum(px - half, 0), np.minimum(px + half, nx - 1)
    kept = (z >= 0) & (z < nz) & (y >= 0) & (y < ny) & (x0 <= x1)
    return [np.broadcast_to(c, kept.shape)[kept] for c in (row, z, y, x0, x1)]


def _around(table: pa.Table, end: str, room: float) -> list[np.ndarray]:
    """Runs of the voxels nearer to an endpoint than the root of ``room``: row, z, y, x0, x1. That distance itself is outside."""
    reach = math.ceil(math.sqrt(room))
    ez, ey, ex = (table[f"{end}{a}"].to_numpy()[:, None, None] for a in "zyx")
    nz, ny, nx = (table[c].cast(pa.int64()).fill_null(_NO_END).to_numpy()[:, None, None] for c in ("nz", "ny", "nx"))
    step = np.arange(-reach, reach + 2)
    z, y = np.floor(ez).astype(np.int64) + step[None, :, None], np.floor(ey).astype(np.int64) + step[None, None, :]
    rest = room - (z - ez) ** 2 - (y - ey) ** 2
    kept = (rest > 0) & (z >= 0) & (y >= 0) & (z < nz) & (y < ny)
    root = np.sqrt(np.where(kept, rest, 0.0))
    x0, x1 = np.maximum(np.floor(ex - root).astype(np.int64) + 1, 0), np.minimum(np.ceil(ex + root).astype(np.int64) - 1, nx - 1)
    kept &= x0 <= x1
    return [np.broadcast_to(c, kept.shape)[kept] for c in (np.arange(table.num_rows)[:, None, None], z, y, x0, x1)]


def _made(keys: list[str], chords: list[tuple[int, int, int]], room: float | None):
    """Disjoint runs of whole prompts, of the disks along their lines and, with ``room``, of the balls around their ends; as many prompts at once as make ``MADE`` runs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys)
            ends = np.r_[starts, table.num_rows]
            each = (table["steps"].to_numpy().astype(np.int64) + 1) * len(chords) + (0 if room is None else 2 * (2 * math.ceil(math.sqrt(room)) + 2) ** 2)
            for first, last in shares(np.add.reduceat(each, starts), MADE):
                part = table.slice(ends[first], ends[last] - ends[first]).combine_chunks()
                parts = ([_along(part, chords)] if chords else []) + ([] if room is None else [_around(part, e, room) for e in "ab"])
                row, z, y, x0, x1 = (np.concatenate(c) for c in zip(*parts))
                if not len(row):
                    continue
                group = np.cumsum(np.r_[False, changes(part, keys)])
                at, x0, x1 = merged([group[row], z, y], x0, x1)
                named = part.select(keys).take(pa.array(row[at])).combine_chunks()
                numbers = [pa.array(c.astype(np.int32)) for c in (z[at], y[at], x0, x1)]
                yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in named.columns], *numbers], names=[*keys, "z", "y", "x0", "x1"])

    return make


def _runs_of(prompts: DataFrame, keys: tuple[str, ...], chords: list[tuple[int, int, int]], room: float | None) -> DataFrame:
    """Runs that whole prompts make in the task that holds them."""
    kinds = ", ".join(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in keys)
    made = _lines(together(prompts, keys), keys).mapInArrow(_made(list(keys), chords, room), f"{kinds}, z int, y int, x0 int, x1 int")
    return never_sent(made)


def prompt_region_runs(prompts: DataFrame, sigma: float = 2.0, mode: str = "full", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """:func:`prompt_region` as disjoint runs: lines of the disk at each step of a prompt's line, and on each line around an endpoint the
    voxels nearer than the radius at which the Gaussian falls to the region's level."""
    if mode not in PROMPT_MODES:
        raise ValueError(f"unknown prompt mode {mode!r}")
    prompts = shift_to_wrong_place(prompts) if mode == "wrong_prompt" else prompts
    room = 2.0 * max(float(sigma) ** 2, 1e-6) * math.log(1.0 / REGION_LEVEL)
    chords, room = [] if mode == "endpoint_only" else _chords(2, 0), None if mode == "line_only" else room
    return _runs_of(prompts.where("false") if mode == "no_prompt" else prompts, keys, chords, room)


def tube_runs(prompts: DataFrame, radius: int = 6, z_thickness: int = 1, prompt_mode: str = "full", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """:func:`tube_region` as disjoint runs."""
    ends = effective_endpoints(prompts, prompt_mode)
    return _runs_of(ends.where("ax IS NOT NULL"), keys, _chords(max(int(radius), 0), max(int(z_thickness), 0)), None)


def tube_region(prompts: DataFrame, radius: int = 6, z_thickness: int = 1, prompt_mode: str = "full", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """A thick line over several slices; empty without endpoints."""
    ends = effective_endpoints(prompts, prompt_mode)
    return rasterize_line(ends.where("ax IS NOT NULL"), max(radius, 0), max(z_thickness, 0), keys)


def marker_components(marker: DataFrame) -> DataFrame:
    """Components of a marker volume as runs with ``label, component_id, suffix``.

    With one positive value the components are those of the union, with several those of each value.
    """
    runs = component_runs(marker)
    ids = runs.select("case_id", "label", "component_id").distinct()
    counts = ids.groupBy("case_id", "label").agg(F.max("component_id").alias("n"))
    values = counts.groupBy("case_id").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("total"))
    named = counts.join(values, "case_id").select(
        "case_id", "label", "total",
        F.concat(F.lit("recist"), F.when(F.col("values") > 1, F.col("label").cast("string")).otherwise("")).alias("stem"),
        (F.col("n") > 1).alias("many"),
    )
    return runs.join(named, ["case_id", "label"]).select(
        *runs.columns,
        F.when(F.col("many"), F.concat("stem", F.lit("_component"), "component_id")).otherwise(F.col("stem")).alias("suffix"),
        F.col("total").alias("component_count"),
    )


def _outline(ys: list[int], xs: list[int], side: int) -> list[tuple[int, int]]:
    """Corners of the convex outline through one point a line, ``ys`` rising; ``side`` 1 follows the smallest x, -1 the largest."""
    corners: list[tuple[int, int]] = []
    for y, x in zip(ys, xs, strict=True):
        while len(corners) > 1:
            (fy, fx), (my, mx) = corners[-2:]
            if side * ((mx - fx) * (y - my) - (x - mx) * (my - fy)) < 0:
                break
            corners.pop()
        corners.append((y, x))
    return corners


def _farthest(corners: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """The farthest pair of a convex polygon's corners by calipers, the first in raster order on ties.

    Every pair of largest distance has parallel supporting lines, so the corners opposite to each edge hold all of them.
    """

    def rank(i: int, j: int) -> tuple[int, ...]:
        a, b = sorted((corners[i], corners[j]))
        return -((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2), *a, *b

    n = len(corners)
    if n < 3:
        return rank(0, n - 1)[1:]

    def height(i: int, k: int, j: int) -> int:
        (iy, ix), (ky, kx), (jy, jx) = corners[i], corners[k], corners[j]
        return abs((ky - iy) * (jx - ix) - (kx - ix) * (jy - iy))

    best, j = rank(0, 1), 1
    for i in range(n):
        k = (i + 1) % n
        while height(i, k, (j + 1) % n) > height(i, k, j):
            j = (j + 1) % n
        best = min(best, rank(i, j), rank(k, j))
        if height(i, k, (j + 1) % n) == height(i, k, j):
            best = min(best, rank(i, (j + 1) % n), rank(k, (j + 1) % n))
    return best[1:]


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in ("ay", "ax", "by", "bx")]))
def _widest(rows: pd.Series) -> pd.DataFrame:
    """The farthest pair of each slice from its lines (y, x0, x1)."""
    pairs = []
    for lines in rows:
        ys, lows, highs = zip(*sorted((r["y"], r["x0"], r["x1"]) for r in lines), strict=True)
        left, right = _outline(ys, lows, 1), _outline(ys, highs, -1)
        pairs.append(_farthest(list(dict.fromkeys(left + right[::-1]))))
    return pd.DataFrame(pairs, columns=["ay", "ax", "by", "bx"], dtype=float)


def derive_endpoints(mask_runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Endpoints of each mask from its runs: the slice with most voxels (lowest on ties), then its farthest pair.

    Slices are first counted; only the runs of the chosen ones travel on. The outermost voxels of their lines form the hull whose opposite
    corners are weighed, so a slice costs as much as it has lines. Ties go to the first pair in raster order.
    """
    areas = mask_runs.groupBy(*keys, "z").agg(F.sum(F.expr("cast(x1 - x0 + 1 AS bigint)")).alias("area"))
    peak = areas.groupBy(*keys).agg(F.max_by("z", F.struct("area", -F.col("z"))).alias("z"), F.sum("area").alias("marker_voxels"))
    lines = mask_runs.join(never_sent(peak), [*keys, "z"]).groupBy(*keys, "z", "marker_voxels", "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    slices = lines.groupBy(*keys, "z", "marker_voxels").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("rows"))
    level = F.col("z").cast("double")
    return slices.withColumn("pair", _widest("rows")).select(
        *keys, F.col("z").alias("slice"), "marker_voxels", "pair.ax", "pair.ay", level.alias("az"), "pair.bx", "pair.by", level.alias("bz")
    )
