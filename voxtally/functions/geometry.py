"""Column expressions for points, boxes, windows and zooms. Axes are named; nothing is positional.

A prompt row holds endpoints ``a`` and ``b`` as ``ax, ay, az, bx, by, bz`` and its frame as ``nz, ny, nx``.
Rounding is half to even throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDS = ["ax", "ay", "az", "bx", "by", "bz"]
DIM = {"z": "nz", "y": "ny", "x": "nx"}
# Border load from which zoom grows with full strength.
FULL_BORDER_LOAD = 0.05


def reverse_axes(point: Column) -> Column:
    """xyz to zyx and back."""
    return F.reverse(point)


def clip(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    return F.greatest(low, F.least(value, high))


def clip_to_frame(df: DataFrame) -> DataFrame:
    """Endpoints moved into their frame."""
    return df.withColumns({e: clip(F.col(e), 0.0, F.col(DIM[e[1]]) - 1) for e in ENDS})


def clip_index(value: Column, size: Column) -> Column:
    """Nearest voxel index inside an axis of ``size`` voxels; 0 for an empty axis."""
    return F.when(size <= 0, F.lit(0)).otherwise(clip(F.rint(value), 0, size - 1)).cast("int")


def shift_to_wrong_place(df: DataFrame) -> DataFrame:
    """Endpoints of a deliberately wrong prompt: shifted by a part of each dimension, then clipped."""
    parts = {"x": ("nx", 4, 2), "y": ("ny", 5, 2), "z": ("nz", 6, 1)}
    shift = {axis: F.greatest(F.floor(F.col(dim) / part), F.lit(least)) for axis, (dim, part, least) in parts.items()}
    return clip_to_frame(df.withColumns({e: F.col(e) + shift[e[1]] for e in ENDS}))


def effective_endpoints(df: DataFrame, prompt_mode: str) -> DataFrame:
    """Endpoints that post-processing uses: shifted, absent or as given."""
    if prompt_mode == "wrong_prompt":
        return shift_to_wrong_place(df)
    if prompt_mode == "no_prompt":
        return df.withColumns({e: F.lit(None).cast("double") for e in ENDS})
    return df


def midpoint(axis: str) -> Column:
    return (F.col(f"a{axis}") + F.col(f"b{axis}")) / 2


def slice_spread() -> Column:
    """Distance of the two endpoints along z."""
    return F.abs(F.col("az") - F.col("bz"))


def endpoint_box(df: DataFrame, margin_zyx: tuple[int, int, int]) -> DataFrame:
    """Half-open box around both endpoints with a margin, cut at the frame."""
    out = {}
    for axis, margin in zip("zyx", margin_zyx):
        margin, dim = max(int(margin), 0), F.col(DIM[axis])
        low = F.floor(F.least(f"a{axis}", f"b{axis}")) - margin
        high = F.ceil(F.greatest(f"a{axis}", f"b{axis}")) + margin + 1
        out[f"box_{axis}0"] = clip(low, 0, dim).cast("int")
        out[f"box_{axis}1"] = clip(high, 0, dim).cast("int")
    return df.withColumns(out)


def endpoint_sets(endpoints: Column, transposed: bool = False) -> Column:
    """Array of (2, 3) endpoint sets from (N, 2, 3), or from (2, N, 3) when ``transposed``.

    An array of two pairs is always read as two sets.
    """
    if not transposed:
        return endpoints
    return F.transform(F.sequence(F.lit(1), F.size(endpoints[0])), lambda i: F.transform(endpoints, lambda side: F.element_at(side, i)))


def set_slice_index(set_xyz: Column, position: Column, given: Column | None = None) -> Column:
    """Slice of an endpoint set: the given one (one for all, or one each), else the rounded mean z."""
    mean_z = F.rint((set_xyz[0][2] + set_xyz[1][2]) / 2).cast("int")
    if given is None:
        return mean_z
    return F.when(F.size(given) == 1, given[0]).otherwise(F.element_at(given, position + 1)).cast("int")


def window_start(center: Column, size: Column, dim: Column) -> tuple[Column, Column]:
    """Start and width of a window of ``size`` around ``center``, kept inside the axis."""
    width = F.least(size, dim)
    start = F.rint(center) - F.floor(width / 2)
    return clip(start, 0, dim - width).cast("int"), width.cast("int")


def crop_window(df: DataFrame, size_zyx: tuple, center: dict[str, Column] | None = None) -> DataFrame:
    """Add ``w_z0, w_z1, ..``: half-open windows around the endpoints' midpoint or a given centre.

    Sizes may be numbers or columns.
    """
    out = {}
    for axis, size in zip("zyx", size_zyx):
        size = size if isinstance(size, Column) else F.lit(int(size))
        middle = midpoint(axis) if center is None else center[axis]
        start, width = window_start(middle, size, F.col(DIM[axis]))
        out[f"w_{axis}0"], out[f"w_{axis}1"] = start, start + width
    return df.withColumns(out)


def endpoint_margin(axis: str, margin_mm: float) -> Column:
    """A margin in mm as voxels of an axis; none for a margin of zero."""
    if margin_mm <= 0:
        return F.lit(0.0)
    return F.lit(float(margin_mm)) / F.greatest(F.col(f"s{axis}"), F.lit(1e-6))


def center_with_margin(axis: str, size: Column, margin_mm: float) -> Column:
    """Window centre moved, where the axis has room, so that both endpoints keep the margin."""
    dim, margin = F.col(DIM[axis]), endpoint_margin(axis, margin_mm)
    width = F.least(size, dim)
    half = F.floor(width / 2)
    high_end, low_end = F.greatest(f"a{axis}", f"b{axis}"), F.least(f"a{axis}", f"b{axis}")
    low = F.greatest(F.lit(0), F.ceil(high_end + margin - (width - 1)))
    high = F.least(dim - width, F.floor(low_end - margin))
    moved = F.greatest(low, F.least(F.rint(midpoint(axis)) - half, high)) + half
    return F.when((width > 0) & (low <= high), moved.cast("double")).otherwise(midpoint(axis))


def bbox_windows(df: DataFrame, widths: dict[str, Column], margins: dict[str, int]) -> DataFrame:
    """Add windows ``w_z0 .. w_x1`` that hold the box ``bb_z0 .. bb_x1`` plus margin if it fits, near the midpoint.

    Built in stages, so that no expression repeats another inside generated code.
    """
    out = df.withColumns({f"_width_{a}": F.least(w, F.col(DIM[a])).cast("int") for a, w in widths.items()})
    out = out.withColumns({
        **{f"_low_{a}": F.greatest(F.lit(0), F.least(F.col(f"bb_{a}1") + margins[a], F.col(DIM[a])) - F.col(f"_width_{a}")) for a in widths},
        **{f"_high_{a}": F.least(F.greatest(F.col(f"bb_{a}0") - margins[a], F.lit(0)), F.col(DIM[a]) - F.col(f"_width_{a}")) for a in widths},
        **{f"_wish_{a}": F.rint(midpoint(a)) - F.floor(F.col(f"_width_{a}") / 2) for a in widths},
    })
    out = out.withColumns({
        f"w_{a}0": F.when(F.col(f"_low_{a}") <= F.col(f"_high_{a}"), clip(F.col(f"_wish_{a}"), F.col(f"_low_{a}"), F.col(f"_high_{a}")))
        .otherwise(clip(F.col(f"_wish_{a}"), 0, F.col(DIM[a]) - F.col(f"_width_{a}"))).cast("int")
        for a in widths
    })
    out = out.withColumns({f"w_{a}1": F.col(f"w_{a}0") + F.col(f"_width_{a}") for a in widths})
    return out.drop(*[f"_{part}_{a}" for part in ("width", "low", "high", "wish") for a in widths])


def flip_endpoints(df: DataFrame, axes: str) -> DataFrame:
    """Mirror endpoints along the named axes."""
    return df.withColumns({e: F.col(DIM[e[1]]) - 1 - F.col(e) for e in ENDS if e[1] in axes})


def zoomed_size(base: int, zoom: Column) -> Column:
    """Crop size of a zoom level, at least one voxel."""
    return F.greatest(F.ceil(F.lit(float(base)) * zoom), F.lit(1)).cast("int")


def grow_zoom(zoom: Column, growth: float, limit: float) -> Column:
    return F.least(zoom * growth, F.lit(float(limit)))


def candidate_zoom(zoom: Column, extent: Column, patch: int, limit: float) -> Column:
    """Zoom at which the mask's extent plus a third of a patch fits; never below the current zoom."""
    wanted = F.greatest(zoom, (extent + F.lit(patch / 3.0)) / patch)
    return F.when(extent.isNull(), zoom).otherwise(F.least(wanted, F.lit(float(limit))))


def next_zoom(
    zoom: Column, triggered: Column, growth: float, limit: float, candidate: Column, border_load: Column, mode: str = "fixed"
) -> Column:
    """Zoom of the next pass along one axis. ``adaptive`` scales growth with the border load."""
    if mode == "adaptive":
        strength = clip(border_load / FULL_BORDER_LOAD, 0.0, F.lit(1.0))
        wanted = F.greatest(candidate, zoom * (1 + (growth - 1) * strength))
    elif mode == "fixed":
        grown = grow_zoom(zoom, growth, limit)
        twice = F.when(border_load >= FULL_BORDER_LOAD, zoom * growth * growth).otherwise(grown)
        wanted = F.greatest(grown, twice, candidate)
    else:
        raise ValueError(f"unknown zoom mode {mode!r}")
    return F.least(F.when(triggered, wanted).otherwise(zoom), F.lit(float(limit)))
