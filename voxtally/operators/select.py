"""Post-processing of predicted masks: prompt-aware component choice, island removal, merging, boxes, border tests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.functions.geometry import DIM, effective_endpoints, endpoint_box, window_start
from voxtally.functions.grids import changes, decoded, whole_groups
from voxtally.operators.components import binary_component_runs, coded_runs, component_stats, mask_runs, parts_of, runs_to_voxels, stretches
from voxtally.operators.overlap import LINE, NOWHERE, paired, spelled_out
from voxtally.operators.prompts import tube_runs
from voxtally.operators.targets import midpoints
from voxtally.session import cut_lineage, never_sent

# Overlaps that rank components, in order, by mode.
RANKED_BY = {
    "prompt_component": ["prompt_overlap"],
    "prompt_tube_component": ["tube_overlap"],
    "prompt_box_component": ["box_overlap"],
    "prompt_hybrid_component": ["tube_overlap", "box_overlap"],
}
COMPONENT = ["case_id", "component_id"]
# Slices of a slab in which components and regions meet.
SHARED_DEPTH = 32
CASE = ("case_id",)
AXES = "zyx"


def region_runs(region: DataFrame, keys: tuple[str, ...] = CASE) -> DataFrame:
    """Runs ``(keys.., z, y, r0, r1)`` of a region given as voxels or as disjoint runs (``x0, x1``)."""
    runs = region if "x0" in region.columns else mask_runs(region, keys)
    return runs.selectExpr(*keys, "z", "y", "x0 AS r0", "x1 AS r1")


def box_runs(boxes: DataFrame, keys: tuple[str, ...] = CASE) -> DataFrame:
    """Lines of half-open boxes as runs."""
    lines = boxes.where(" AND ".join(f"box_{a}0 < box_{a}1" for a in AXES)).selectExpr("*", "explode(sequence(box_z0, box_z1 - 1)) AS z")
    return lines.selectExpr("*", "explode(sequence(box_y0, box_y1 - 1)) AS y").selectExpr(*keys, "z", "y", "box_x0 AS r0", "box_x1 - 1 AS r1")


def _shared(keys: list[str], names: list[str]):
    """Voxels that the component runs of whole slabs share with the runs of regions; ``part`` is the region's place in ``names``, -1 for components."""
    slab = ["case_id", "slab"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, slab):
            for part in parts_of(table, slab):
                yield from share(part.combine_chunks())

    def share(table: pa.Table) -> Iterator[pa.RecordBatch]:
        of, kind = np.cumsum(np.r_[False, changes(table, slab)]), table["part"].to_numpy()
        if kind.max() < 0 or kind.min() >= 0:
            return
        count, (z, y, x0, length) = decoded(table["runs"], 4)
        row = np.repeat(np.arange(table.num_rows), count)
        z = z - table["slab"].to_numpy()[row] * SHARED_DEPTH
        line = (of[row] * SHARED_DEPTH + z) * (int(y.max()) - int(y.min()) + 1) + (y - y.min())
        width = int((x0 + length).max()) - int(x0.min()) + 2
        head = line * width + (x0 - x0.min())
        tail = head + length
        own = np.flatnonzero(kind[row] < 0)
        own = own[np.argsort(head[own], kind="stable")]
        asks = np.flatnonzero(kind[row] >= 0)
        low = np.searchsorted(np.maximum.accumulate(tail[own]), head[asks], side="left")
        met = np.maximum(np.searchsorted(head[own], tail[asks], side="right") - low, 0)
        asks = np.repeat(asks, met)
        own = own[np.arange(len(asks)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(low, met)]
        common = np.minimum(tail[asks], tail[own]) - np.maximum(head[asks], head[own]) + 1
        pair, at = np.unique(row[asks] * table.num_rows + row[own], return_inverse=True)
        total = np.bincount(at, np.maximum(common, 0), len(pair)).astype(np.int64)
        pair, total = pair[total > 0], total[total > 0]
        asked, found = pa.array(pair // table.num_rows), pa.array(pair % table.num_rows)
        columns = [table[c].take(asked).combine_chunks() for c in keys] + [table["component_id"].take(found).combine_chunks()]
        columns += [pa.array(np.where(kind[asked.to_numpy()] == k, total, 0)) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "component_id", *names])

    return meet


def run_overlaps(component_runs: DataFrame, regions: dict[str, DataFrame], keys: tuple[str, ...] = CASE) -> DataFrame:
    """Voxels that components share with regions, ``(keys.., component_id, <name>..)``; a row for each pair that shares any.

    Regions are runs; they meet a case's component runs, labelled once, in slabs of ``SHARED_DEPTH`` slices, whatever number of prompts have regions there.
    Both travel coded, a few bytes a run.
    """
    kinds = {c: next(iter(regions.values())).schema[c].dataType.simpleString() for c in keys} | {"component_id": component_runs.schema["component_id"].dataType.simpleString()}
    columns = ["case_id", "slab", *[c for c in keys if c != "case_id"], "component_id", "part", "runs"]

    def sent(runs: DataFrame, own: tuple[str, ...], part: int) -> DataFrame:
        rows = coded_runs(runs.where("case_id IS NOT NULL"), own, SHARED_DEPTH).withColumn("part", F.lit(part))
        return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])

    parts = [sent(component_runs, tuple(COMPONENT), -1)] + [sent(r.withColumnsRenamed({"r0": "x0", "r1": "x1"}), tuple(keys), k) for k, r in enumerate(regions.values())]
    rows = reduce(DataFrame.unionByName, parts).repartition("case_id", "slab").sortWithinPartitions("case_id", "slab")
    named = ", ".join([*[f"{c} {kinds[c]}" for c in (*keys, "component_id")], *[f"{n} bigint" for n in regions]])
    met = never_sent(rows.mapInArrow(_shared(list(keys), list(regions)), named))
    return met.groupBy(*keys, "component_id").agg(*[F.sum(n).alias(n) for n in regions])


def _prompt_regions(
    region: DataFrame, prompts: DataFrame, prompt_mode: str, tube_radius: int, tube_z: int, box_margin_zyx: tuple[int, int, int], overlaps: tuple[str, ...], keys: tuple[str, ...]
) -> dict[str, DataFrame]:
    ends = effective_endpoints(prompts, prompt_mode).where("ax IS NOT NULL")
    builders = {
        "prompt_overlap": lambda: region_runs(region, keys),
        "tube_overlap": lambda: region_runs(tube_runs(prompts, tube_radius, tube_z, prompt_mode, keys), keys),
        "box_overlap": lambda: box_runs(endpoint_box(ends, box_margin_zyx), keys),
    }
    return {name: builders[name]() for name in overlaps}


def _components(runs: DataFrame, prompts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Components, once for every prompt of their case where prompts are part of the key."""
    found = component_stats(runs).select(*COMPONENT, "voxel_count", "cz", "cy", "cx")
    return found if tuple(keys) == CASE else found.join(prompts.select(*keys).distinct(), "case_id")


def component_prompt_overlap(
    runs: DataFrame, region: DataFrame, prompts: DataFrame, prompt_mode: str = "full",
    tube_radius: int = 6, tube_z: int = 1, box_margin_zyx: tuple[int, int, int] = (1, 8, 8),
    overlaps: tuple[str, ...] = ("prompt_overlap", "tube_overlap", "box_overlap"), keys: tuple[str, ...] = CASE,
) -> DataFrame:
    """Size, centroid and the wanted overlaps of every component of ``binary_component_runs``, for every prompt of its case.

    ``keys`` name a prompt: the case, or the case and ``prompt``.
    """
    shares = run_overlaps(runs, _prompt_regions(region, prompts, prompt_mode, tube_radius, tube_z, box_margin_zyx, overlaps, keys), keys)
    return _components(runs, prompts, keys).join(shares, [*keys, "component_id"], "left").fillna(0, list(overlaps))


def component_audit(runs: DataFrame, region: DataFrame, prompts: DataFrame | None = None, keys: tuple[str, ...] = CASE) -> DataFrame:
    """Components of each case, largest first, with their prompt overlap; for every row of ``prompts`` (the region's own unless given)."""
    found = _components(runs, region if prompts is None else prompts, keys).select(*keys, "component_id", F.col("voxel_count").alias("size"))
    shares = run_overlaps(runs, {"prompt_overlap": region_runs(region, keys)}, keys)
    joined = found.join(shares, [*keys, "component_id"], "left").fillna(0, ["prompt_overlap"])
    return joined.orderBy(*keys, F.desc("size"), "component_id")


def _distance(prefix: str) -> Column:
    """Centroid distance to the point ``<prefix>z, <prefix>y, <prefix>x``, steadied against summation order."""
    return F.round(F.sqrt(sum((F.col(f"c{a}") - F.col(f"{prefix}{a}")) ** 2 for a in AXES)), 9)


def select_prompt_component(
    runs: DataFrame, region: DataFrame, prompts: DataFrame, mode: str = "prompt_component", prompt_mode: str = "full",
    tube_radius: int = 6, tube_z: int = 1, box_margin_zyx: tuple[int, int, int] = (1, 8, 8),
    min_voxels: int = 0, min_fraction: float = 0.0, keys: tuple[str, ...] = CASE,
) -> DataFrame:
    """Components to keep for each prompt, as ``(keys.., component_id)``; ``keys`` are the case, or the case and ``prompt``.

    The plain mode takes the component with most prompt voxels (the first on ties) or, when none has any, the one whose
    centroid is nearest to the centre of the prompt's voxels; without prompt voxels everything stays. Other modes,
    and any mode with island removal, rank by overlap, then nearness to the endpoints' midpoint, size and lowest id.
    Island removal also keeps others of at least max(min_voxels, ceil(min_fraction * selected)) voxels. A case with
    one component keeps it.

    Components that share voxels with a prompt come before all others, so only prompts that meet none are ranked against all of their case.
    """
    if mode not in RANKED_BY:
        raise ValueError(f"unknown mode {mode!r}")
    keys, cleanup = list(keys), min_voxels > 0 or min_fraction > 0
    overlaps = tuple(RANKED_BY[mode])
    sizes = cut_lineage(component_stats(runs).select(*COMPONENT, "voxel_count", "cz", "cy", "cx"))
    shares = cut_lineage(run_overlaps(runs, _prompt_regions(region, prompts, prompt_mode, tube_radius, tube_z, box_margin_zyx, overlaps, tuple(keys)), tuple(keys)))
    counts = sizes.groupBy("case_id").agg(F.count(F.lit(1)).alias("components"))
    centres = midpoints(effective_endpoints(prompts, prompt_mode), region, tuple(keys))
    asked = never_sent(counts.join(centres, "case_id", "left" if keys == ["case_id"] else "inner").fillna(0, ["region_voxels"]))
    missed = asked.join(shares.select(*keys).distinct(), keys, "left_anti").select(*keys).join(sizes, "case_id")
    near = shares.join(sizes, COMPONENT).unionByName(missed.withColumns({n: F.lit(0).cast("bigint") for n in overlaps})).join(asked, keys)
    plain = mode == "prompt_component" and not cleanup
    if plain:
        nearness = F.when(F.col("prompt_overlap") > 0, F.lit(0.0)).otherwise(-_distance("r"))
        order = F.struct("prompt_overlap", nearness, -F.col("component_id"))
    else:
        nearness = -F.coalesce(_distance("m"), F.col("component_id").cast("double"))
        order = F.struct(*overlaps, nearness, "voxel_count", -F.col("component_id"))
    best = near.groupBy(*keys).agg(
        F.max_by("component_id", order).alias("chosen"), F.max_by("voxel_count", order).alias("chosen_size"),
        F.max(F.greatest(*overlaps, F.lit(0))).alias("most"), F.max("components").alias("components"), F.max("region_voxels").alias("region_voxels"),
    )
    blind = (F.col("region_voxels") == 0) & (F.col("most") == 0) if mode == "prompt_component" else F.lit(False)
    best = best.withColumn("all_stay", (F.col("components") <= 1) | blind)
    also = F.col("all_stay")
    if cleanup:
        floor = F.greatest(F.lit(int(min_voxels)), F.ceil(F.lit(float(min_fraction)) * F.col("chosen_size")))
        also = also | (F.col("voxel_count") >= floor)
    others = (best if cleanup else best.where("all_stay")).join(sizes.select(*COMPONENT, "voxel_count"), "case_id").where(also & (F.col("component_id") != F.col("chosen")))
    return best.select(*keys, F.col("chosen").alias("component_id")).unionByName(others.select(*keys, "component_id"))


def keep_prompt_component(mask: DataFrame, region: DataFrame, prompts: DataFrame, keys: tuple[str, ...] = CASE, **options) -> DataFrame:
    """Voxels of the kept components for each prompt; options as in :func:`select_prompt_component`. A case's components are labelled once."""
    runs = binary_component_runs(mask)
    kept = select_prompt_component(runs, region, prompts, keys=keys, **options)
    return runs_to_voxels(runs.join(kept, COMPONENT)).select(*keys, "z", "y", "x")


def _first_wins(batches):
    """Stretches of whole lines that one prompt takes, from the runs of all prompts; nulls come last."""
    for table in whole_groups(batches, LINE):
        line = np.cumsum(np.r_[False, changes(table, LINE)])
        x0, x1 = (table[c].to_numpy().astype(np.int64) for c in ("x0", "x1"))
        rank = np.zeros(table.num_rows, np.int64)
        for c in ("prompt", "label"):
            values = pc.rank(table[c].combine_chunks(), "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
            rank = rank * (int(values.max()) + 1) + values
        count = x1 - x0 + 1
        of = np.repeat(np.arange(table.num_rows), count)
        x = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + x0[of]
        place = line[of] * (int(x1.max()) - int(x0.min()) + 2) + (x - int(x0.min()))
        order = np.lexsort((rank[of], place))
        order = order[np.r_[True, np.diff(place[order]) != 0]]
        place, x, of = place[order], x[order], of[order]
        opens = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(rank[of]) != 0)])
        closes = np.r_[opens[1:], len(place)] - 1
        rows = table.select([*LINE, "label", "prompt"]).take(pa.array(of[opens]))
        for name, values in (("x0", x[opens]), ("x1", x[closes])):
            rows = rows.append_column(name, pa.array(values).cast(table.schema.field(name).type))
        yield from rows.combine_chunks().to_batches()


def merge_prompt_runs(masks: DataFrame) -> DataFrame:
    """:func:`merge_prompt_masks` as runs ``(case_id, z, y, label, prompt, x0, x1)``. Voxels become runs where they lie and meet on the line."""
    placed = masks.withColumn("x", F.coalesce("x", F.lit(NOWHERE)))
    runs = stretches(placed, ("case_id", "label", "prompt"), once=True)
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    columns = [*LINE, "label", "prompt", "x0", "x1"]
    met = runs.repartition(*LINE).sortWithinPartitions(*LINE).mapInArrow(_first_wins, ", ".join(f"{c} {kinds[c]}" for c in columns))
    return never_sent(met.withColumn("label", F.when(F.col("prompt").isNotNull(), F.col("label"))))


def merge_prompt_masks(masks: DataFrame) -> DataFrame:
    """One label per voxel from prompt masks ``(case_id, prompt, label, z, y, x)``: the first prompt wins."""
    return spelled_out(merge_prompt_runs(masks)).select("case_id", "z", "y", "x", "label", "prompt")


def merge_report(masks: DataFrame) -> DataFrame:
    """Predicted, assigned and already taken voxels per prompt."""
    keys = ["case_id", "prompt"]
    predicted = masks.groupBy(*keys).agg(F.count(F.lit(1)).alias("predicted_voxels"))
    assigned = merge_prompt_runs(masks).groupBy(*keys).agg(F.sum(F.expr("cast(x1 - x0 + 1 AS bigint)")).alias("assigned_voxels"))
    joined = predicted.join(assigned, keys, "left").fillna(0, ["assigned_voxels"])
    return joined.withColumn("overlap_voxels", F.expr("predicted_voxels - assigned_voxels"))


def compose_organ_labels(aux: DataFrame, tumour_class: int = 1) -> DataFrame:
    """One class per voxel: higher ids overwrite lower ones, the tumour overwrites all. Background is not stored."""
    rank = F.when(F.col("class_id") == tumour_class, F.lit(2**31 - 1)).otherwise(F.col("class_id"))
    return aux.where("class_id > 0").groupBy("case_id", "z", "y", "x").agg(F.max_by("class_id", rank).alias("class_id"))


def refinement_boxes(
    diff: DataFrame, coarse: DataFrame, meta: DataFrame, size_zyx: tuple[int, int, int],
    margin_zyx: tuple[int, int, int] = (10, 10, 10), max_boxes: int | None = None,
) -> DataFrame:
    """Distinct crop windows around components of a difference mask, best by coarse voxels inside; all of a case unless ``max_boxes`` is given.

    Ties keep component order. Coarse lines meet only the windows of their own case.
    """
    comps = component_stats(binary_component_runs(diff)).join(meta.select("case_id", *DIM.values()), "case_id")
    windows = {}
    for axis, size, margin in zip(AXES, size_zyx, margin_zyx):
        centre = (F.col(f"{axis}_min") - margin + F.col(f"{axis}_max") + margin) / 2.0
        start, width = window_start(centre, F.lit(int(size)), F.col(DIM[axis]))
        windows[f"w_{axis}0"], windows[f"w_{axis}1"] = start, start + width
    cols = list(windows)
    boxes = comps.withColumns(windows).groupBy("case_id", *cols).agg(F.min("component_id").alias("first_component"))
    runs = mask_runs(coarse, ("case_id",))
    inside = boxes.join(runs, "case_id").where(
        "z >= w_z0 AND z < w_z1 AND y >= w_y0 AND y < w_y1 AND x1 >= w_x0 AND x0 < w_x1"
    ).groupBy("case_id", *cols).agg(F.sum(F.expr("cast(least(x1, w_x1 - 1) - greatest(x0, w_x0) + 1 AS bigint)")).alias("score"))
    scored = boxes.join(inside, ["case_id", *cols], "left").fillna(0, ["score"])
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), "first_component")
    ranked = scored.withColumn("box", F.row_number().over(order)).drop("first_component")
    return ranked if max_boxes is None else ranked.where(F.col("box") <= int(max_boxes))


def border_load(crop_mask: DataFrame, frames: DataFrame, margin: int = 0) -> DataFrame:
    """Foreground voxels and their share on both outer bands of each axis, for every frame ``(case_id, nz, ny, nx)``.

    Bands are ``margin + 1`` planes wide. An axis thinner than two bands counts a voxel in both.
    """
    counted = stretches(crop_mask, ("case_id",)).join(frames.select("case_id", *DIM.values()), "case_id")
    sums, out = [], []
    for axis in AXES:
        dim, width = F.col(DIM[axis]), F.least(F.lit(margin + 1), F.col(DIM[axis]))
        if axis == "x":
            on_border = F.greatest(F.least("x1", width - 1) - F.col("x0") + 1, F.lit(0)) + F.greatest(F.col("x1") - F.greatest("x0", dim - width) + 1, F.lit(0))
        else:
            on_border = (F.coalesce(F.col("x1") - F.col("x0"), F.lit(0)) + 1) * ((F.col(axis) < width).cast("int") + (F.col(axis) >= dim - width).cast("int"))
        sums.append(F.sum(on_border).alias(f"count_{axis}"))
        others = [F.col(DIM[a]) for a in AXES if a != axis]
        area = (2 * width * others[0] * others[1]).cast("bigint")
        out += [F.coalesce(f"count_{axis}", F.lit(0)).alias(f"count_{axis}"),
                (F.coalesce(f"count_{axis}", F.lit(0)) / F.greatest(area, F.lit(1))).alias(f"load_{axis}")]
    loads = counted.groupBy("case_id").agg(*sums)
    return frames.join(loads, "case_id", "left").select("case_id", *out)


def touched_axes(loads: DataFrame) -> DataFrame:
    """Axes whose outer planes hold foreground."""
    return loads.select("case_id", *[(F.col(f"count_{a}") > 0).alias(f"touch_{a}") for a in AXES])


def border_change(
    previous: DataFrame, current: DataFrame, windows: DataFrame, ref_patch_zyx: tuple[int, int, int] = (128, 160, 160),
    base_abs: int = 1500, base_min: int = 100, base_rel: float = 0.2,
) -> DataFrame:
    """Per axis: changed voxels on the window's two outer planes, and whether they pass the size-scaled limits."""
    cols = [f"w_{a}{i}" for a in AXES for i in (0, 1)]
    both = paired(previous, current).join(windows.select("case_id", *cols), "case_id").where(
        " AND ".join(f"{a} >= w_{a}0 AND {a} < w_{a}1" for a in AXES)
    )
    changed = ((F.col("g") > 0) != (F.col("p") > 0)).cast("int")
    sums = []
    for axis in AXES:
        planes = (F.col(axis) == F.col(f"w_{axis}0")).cast("int") + (F.col(axis) == F.col(f"w_{axis}1") - 1).cast("int")
        sums += [F.sum(planes * changed).alias(f"changed_{axis}"), F.sum(planes).alias(f"foreground_{axis}")]
    counts = windows.select("case_id", *cols).join(both.groupBy("case_id").agg(*sums), "case_id", "left").fillna(0)
    out = []
    for index, axis in enumerate(AXES):
        sides = [F.col(f"w_{a}1") - F.col(f"w_{a}0") for a in AXES if a != axis]
        ref = [r for i, r in enumerate(ref_patch_zyx) if i != index]
        scale = sides[0] * sides[1] / float(max(ref[0] * ref[1], 1))
        n, rel = F.col(f"changed_{axis}"), F.col(f"changed_{axis}") / F.greatest(F.col(f"foreground_{axis}"), F.lit(1))
        out += [n.alias(f"changed_{axis}"), F.col(f"foreground_{axis}"),
                ((n > base_abs * scale) | ((n > base_min * scale) & (rel > base_rel))).alias(f"trigger_{axis}")]
    return counts.select("case_id", *out)
