"""Voxel overlap between two masks: confusion counts, Dice, binary and per-label statistics, set operations.

A mask is ``(case_id, z, y, x, label)`` with one row per foreground voxel. Masks become runs where they lie, and the runs of
both meet on the slice ``(case_id, z)``, packed in arrays, so voxels never cross the network; every later sum is over
``case_id`` or ``(case_id, label)`` and combines before its shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.grids import changes, whole_groups
from voxtally.operators.components import packed_stretches, runs_to_voxels
from voxtally.session import never_sent

VOXEL = ["case_id", "z", "y", "x"]
LINE = ["case_id", "z", "y"]
SLICE = ["case_id", "z"]
#: Stands for a null ``x`` inside the pairing.
NOWHERE = -(2**31)
_LENGTH = "cast(x1 - x0 + 1 AS bigint)"


def _meet(batches):
    """Stretches of lines of whole slices that hold the same two labels, from the runs of both masks; of several labels the largest counts."""
    for table in whole_groups(batches, SLICE):
        group = np.cumsum(np.r_[False, changes(table, SLICE)])
        y = table["y"].combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        line = np.unique(group * (int(y.max()) + 1) + y, return_inverse=True)[1]
        x0, x1, label, side = (table[c].to_numpy().astype(np.int64) for c in ("x0", "x1", "label", "side"))
        count = x1 - x0 + 1
        of = np.repeat(np.arange(table.num_rows), count)
        x = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + x0[of]
        low, width = int(x0.min()), int(x1.max()) - int(x0.min()) + 2
        place = line[of] * width + (x - low)
        order = np.argsort(place, kind="stable")
        place, of = place[order], of[order]
        starts = np.flatnonzero(np.r_[True, np.diff(place) != 0])
        g, p = (np.maximum.reduceat(np.where(side[of] == s, label[of], 0), starts) for s in (0, 1))
        place, row, x = place[starts], of[starts], x[order][starts]
        opens = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(g) != 0) | (np.diff(p) != 0)])
        closes = np.r_[opens[1:], len(place)] - 1
        named = table.select(LINE).take(pa.array(row[opens])).combine_chunks()
        kinds = [table.schema.field(c).type for c in ("x0", "x1", "label", "label")]
        values = [pa.array(v).cast(k) for v, k in zip((x[opens], x[closes], g[opens], p[opens]), kinds)]
        yield pa.RecordBatch.from_arrays([*[named[c].combine_chunks() for c in LINE], *values], names=[*LINE, "x0", "x1", "g", "p"])


def paired_runs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """:func:`paired` as stretches ``(case_id, z, y, x0, x1, g, p)`` of a line along which both labels stay the same. A task holds a batch and one open slice."""
    side = lambda mask, n: mask.select(*VOXEL, "label").withColumn("side", F.lit(n))
    both = side(gt, 0).unionByName(side(pred, 1)).withColumn("x", F.coalesce("x", F.lit(NOWHERE))).fillna(0, ["label"])
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    packed = packed_stretches(both, ("case_id", "label", "side"), once=True, by=(*SLICE, "side"))
    named = ", ".join(f"{c} {kinds[c]}" for c in LINE)
    runs = packed.repartition(*SLICE).sortWithinPartitions(*SLICE).selectExpr(*SLICE, "side", "inline(arrays_zip(y, x0, x1, label))")
    met = runs.mapInArrow(
        _meet, f"{named}, x0 {kinds['x']}, x1 {kinds['x']}, g {kinds['label']}, p {kinds['label']}"
    )
    return never_sent(met)


def spelled_out(stretched: DataFrame) -> DataFrame:
    """Voxels of stretches in which ``NOWHERE`` stands for a null ``x``."""
    return runs_to_voxels(stretched).withColumn("x", F.nullif("x", F.lit(NOWHERE)))


def paired(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Full outer pairing: one row per voxel of either mask with labels ``g`` and ``p`` (0 = absent)."""
    return spelled_out(paired_runs(gt, pred)).select(*VOXEL, "g", "p")


def _voxels_if(condition: str) -> Column:
    """Voxels of the stretches that meet a condition."""
    return F.coalesce(F.sum(F.expr(f"if({condition}, {_LENGTH}, 0L)")), F.lit(0).cast("bigint"))


def overlap_count(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Voxels that both masks hold, per case."""
    return paired_runs(gt, pred).groupBy("case_id").agg(_voxels_if("g > 0 AND p > 0").alias("overlap"))


def confusion(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """True positive, false positive and false negative voxels per case, labels ignored."""
    return paired_runs(gt, pred).groupBy("case_id").agg(
        _voxels_if("g > 0 AND p > 0").alias("tp"), _voxels_if("NOT g > 0 AND p > 0").alias("fp"), _voxels_if("g > 0 AND NOT p > 0").alias("fn")
    )


def dice_column(tp: Column, gt: Column, pred: Column) -> Column:
    """Dice of counts: 1 when both are empty, 0 when one is."""
    return F.when(gt + pred == 0, F.lit(1.0)).otherwise(2.0 * tp / (gt + pred))


def dice(gt: DataFrame, pred: DataFrame) -> DataFrame:
    c = confusion(gt, pred)
    return c.select("case_id", dice_column(F.col("tp"), F.expr("tp + fn"), F.expr("tp + fp")).alias("dsc"))


def binary_columns(tp: Column, fp: Column, fn: Column, size: Column) -> list[Column]:
    gt, pred = tp + fn, tp + fp
    return [
        dice_column(tp, gt, pred).alias("dsc"),
        F.when(gt > 0, tp / gt).otherwise((pred == 0).cast("double")).alias("recall"),
        F.when(pred > 0, tp / pred).otherwise((gt == 0).cast("double")).alias("precision"),
        (pred / F.greatest(size, F.lit(1))).alias("pred_positive_fraction"),
        gt.alias("gt_positive_voxels"),
        pred.alias("pred_positive_voxels"),
        tp.alias("tp_voxels"),
        fp.alias("fp_voxels"),
        fn.alias("fn_voxels"),
    ]


def binary_stats(gt: DataFrame, pred: DataFrame, meta: DataFrame) -> DataFrame:
    """Every case of ``meta`` gets a row, also those without any voxel."""
    counts = meta.select("case_id", F.expr("cast(nz AS bigint) * ny * nx").alias("size")).join(
        confusion(gt, pred), "case_id", "left"
    )
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    return counts.select("case_id", *binary_columns(tp, fp, fn, F.col("size")))


def label_tallies(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """``(case_id, label, gt_voxels, pred_voxels, tp)`` for the union of both masks' labels."""
    rows = paired_runs(gt, pred).selectExpr("case_id", "g", "p", f"{_LENGTH} AS n").selectExpr(
        "case_id",
        """inline(filter(array(
             named_struct('label', g, 'ing', n, 'inp', if(g = p, n, 0L), 'tp', if(g = p, n, 0L)),
             named_struct('label', if(p = g, 0, p), 'ing', 0L, 'inp', n, 'tp', 0L)), r -> r.label > 0))""",
    )
    return rows.groupBy("case_id", "label").agg(
        F.sum("ing").alias("gt_voxels"), F.sum("inp").alias("pred_voxels"), F.sum("tp").alias("tp")
    )


def label_dice(gt: DataFrame, pred: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Dice per label. ``labels(case_id, label)`` replaces the union of both masks' labels when given."""
    tallies = label_tallies(gt, pred)
    if labels is not None:
        wanted = labels.where("label > 0").select("case_id", "label").distinct()
        tallies = wanted.join(tallies, ["case_id", "label"], "left").fillna(0, ["gt_voxels", "pred_voxels", "tp"])
    return tallies.select(
        "case_id", "label", dice_column(F.col("tp"), F.col("gt_voxels"), F.col("pred_voxels")).alias("dsc"),
        "gt_voxels", "pred_voxels",
    )


def case_means(label_rows: DataFrame, meta: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean over labels per case; a case without labels scores 1 everywhere and has no lesions."""
    means = label_rows.groupBy("case_id").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("lesion_count"))
    out = meta.select("case_id").join(means, "case_id", "left")
    return out.fillna(1.0, metrics).fillna(0, ["lesion_count"])


def cohort_score(case_rows: DataFrame) -> DataFrame:
    """Cohort means and their half sum, zeros for an empty cohort. Rows without metrics do not count."""
    means = case_rows.where("dsc IS NOT NULL AND nsd IS NOT NULL").agg(
        F.coalesce(F.avg("dsc"), F.lit(0.0)).alias("val_dsc"), F.coalesce(F.avg("nsd"), F.lit(0.0)).alias("val_nsd")
    )
    return means.withColumn("val_score", F.expr("0.5 * (val_dsc + val_nsd)"))


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    plain = [m.select(*VOXEL).withColumn("label", F.lit(1)) for m in (a, b)]
    return paired(*plain).select(*VOXEL)


def mask_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return spelled_out(paired_runs(a, b).where("g > 0 AND p > 0")).select(*VOXEL)


def mask_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return spelled_out(paired_runs(a, b).where("g > 0 AND p = 0")).select(*VOXEL)


def mask_symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return spelled_out(paired_runs(a, b).where("(g > 0) <> (p > 0)")).select(*VOXEL)


def union_bbox(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half-open box around both masks, per case."""
    both = a.select(*VOXEL).unionByName(b.select(*VOXEL))
    return both.groupBy("case_id").agg(
        *[F.min(c).alias(f"{c}_min") for c in "zyx"], *[(F.max(c) + 1).alias(f"{c}_max") for c in "zyx"]
    )


def label_set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = a.select("case_id", "label").unionByName(b.select("case_id", "label"))
    return rows.where("label > 0").distinct()


def binarize(prob_voxels: DataFrame, threshold: float) -> DataFrame:
    """Foreground where the probability reaches the threshold."""
    return prob_voxels.where(F.col("prob") >= threshold).select(*VOXEL, F.lit(1).alias("label"))
