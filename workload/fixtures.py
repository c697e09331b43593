"""Volumes, masks, prompts and logs derived from the driver's tables; every builder reads whole tables."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.grids import changes, whole_groups
from voxtally.operators.prompts import copy_to_prompts, key_by_prompt
from voxtally.session import never_sent

# Frame of the ellipsoid fixture (depth, height, width).
FRAME = (24, 50, 50)
# Frame of the scattered fixture.
SCATTER_FRAME = (7, 24, 24)
# Sweep thresholds: 0.35 to 0.75 in steps of 0.05.
THRESHOLDS = [0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75]


# Whether tables of the ellipsoid fixture are built once for every prompt of a case.
_EVERY_PROMPT = False


@contextmanager
def every_prompt():
    """Inside, ``case_prompts`` are all prompts under keys of their own, and ``gt``, ``pred`` and ``meta`` have a copy for each."""
    global _EVERY_PROMPT
    before, _EVERY_PROMPT = _EVERY_PROMPT, True
    try:
        yield
    finally:
        _EVERY_PROMPT = before


def _copies(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_to_prompts(rows, prompts(spark, sf_dir)) if _EVERY_PROMPT else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lesions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ellipsoid per order, ten to a case; the prediction does not find low-priority ones."""
    return never_sent(table(spark, sf_dir, "orders")).selectExpr(
        "o_orderkey div 10 AS case_id",
        "cast(o_orderkey % 10 AS int) AS lesion",
        "cast(1 + o_orderkey % 3 AS int) AS label",
        "o_custkey AS ck",
        "o_orderpriority <> '5-LOW' AS found",
        "cast(3 + o_custkey % 18 AS int) AS cz",
        "cast(5 + (o_orderkey * 7 + o_custkey) % 38 AS int) AS cy",
        "cast(5 + (o_custkey * 13) % 38 AS int) AS cx",
        "cast(1 + o_custkey % 3 AS int) AS rz",
        "cast(2 + o_orderkey % 3 AS int) AS ry",
        "cast(2 + (o_custkey div 3) % 4 AS int) AS rx",
    )


def _fill(batches):
    """Voxels of the ellipsoids of whole cases, in raster order with the smallest label; a line's half width is the integer root of what its offset leaves."""
    for table in whole_groups(batches, ["case_id"]):
        case = np.cumsum(np.r_[False, changes(table, ["case_id"])])
        names = ("label", "cz", "cy", "cx", "rz", "ry", "r", "wanted")
        of = np.arange(table.num_rows)
        label, cz, cy, cx, rz, ry, r, wanted = (table[c].to_numpy().astype(np.int64) for c in names)

        def spread(rows, half):
            """Each row for every offset from -half to half."""
            width = 2 * half + 1
            at = np.repeat(np.arange(len(rows)), width)
            return rows[at], np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width) - half[at], at

        of, i, _ = spread(of, rz)
        of, j, at = spread(of, ry[of])
        i = i[at]
        room = (rz * ry * r)[of] ** 2 - (i * ry[of] * r[of]) ** 2 - (j * rz[of] * r[of]) ** 2
        of, i, j, room = (c[room >= 0] for c in (of, i, j, room))
        half = np.floor(np.sqrt(room // (rz * ry)[of] ** 2)).astype(np.int64)
        of, k, at = spread(of, half)
        z, y, x = cz[of] + i[at], cy[of] + j[at], cx[of] + k
        order = np.lexsort((label[of], x, y, z, case[of]))
        of, z, y, x = of[order], z[order], y[order], x[order]
        new = np.flatnonzero(np.r_[True, (np.diff(case[of]) != 0) | (np.diff(z) != 0) | (np.diff(y) != 0) | (np.diff(x) != 0)]) if len(of) else of
        new = new[wanted[of[new]] > 0]
        columns = [table["case_id"].combine_chunks().take(pa.array(of[new])), *[pa.array(c[new].astype(np.int32)) for c in (z, y, x, label[of])]]
        yield pa.RecordBatch.from_arrays(columns, names=["case_id", "z", "y", "x", "label"])


def _ellipsoids(rows: DataFrame, dy: str, dx: str, radius_x: str, wanted: str = "true") -> DataFrame:
    """Ellipsoids travel to their case's task and are filled there; voxels are never shuffled. Only voxels of ``wanted`` ellipsoids are returned."""
    bodies = rows.selectExpr("case_id", "label", "cz", f"cy + {dy} AS cy", f"cx + {dx} AS cx", "rz", "ry", f"{radius_x} AS r", f"cast({wanted} AS int) AS wanted").dropna()
    kind = bodies.schema["case_id"].dataType.simpleString()
    voxels = bodies.repartition("case_id").sortWithinPartitions("case_id").mapInArrow(_fill, f"case_id {kind}, z int, y int, x int, label int")
    return never_sent(voxels)


def gt(spark: SparkSession, sf_dir: str, labels: DataFrame | None = None) -> DataFrame:
    """Every lesion; where ``labels(case_id, label)`` are given, only the voxels of those labels."""
    rows = _copies(lesions(spark, sf_dir), spark, sf_dir)
    if labels is None:
        return _ellipsoids(rows, "0", "0", "rx")
    named = labels.select("case_id", "label").distinct().withColumn("named", F.lit(True))
    return _ellipsoids(rows.join(named, ["case_id", "label"], "left"), "0", "0", "rx", "coalesce(named, false)")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _copies(lesions(spark, sf_dir).where("found"), spark, sf_dir)
    return _ellipsoids(kept, "cast((ck div 2) % 2 AS int)", "cast(ck % 2 AS int)", "cast(rx + ck % 2 AS int)")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape and spacing, one row per case."""
    nz, ny, nx = FRAME
    cases = lesions(spark, sf_dir).select("case_id").distinct().selectExpr(
        "case_id", f"{nz} AS nz", f"{ny} AS ny", f"{nx} AS nx",
        "cast(1 + case_id % 3 AS double) AS sz", "1D AS sy", "1D AS sx",
    )
    return _copies(cases, spark, sf_dir)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diameter per lesion, along x through its centre."""
    nz, ny, nx = FRAME
    return lesions(spark, sf_dir).selectExpr(
        "case_id", "lesion AS prompt", "label",
        "cast(cx - rx AS double) AS ax", "cast(cy AS double) AS ay", "cast(cz AS double) AS az",
        "cast(cx + rx AS double) AS bx", "cast(cy AS double) AS by", "cast(cz AS double) AS bz",
        "cz AS slice", f"{nz} AS nz", f"{ny} AS ny", f"{nx} AS nx",
    )


def tilted_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prompts, tilted by their ordinals."""
    return prompts(spark, sf_dir).withColumn("by", F.expr("by + prompt % 4"))


def case_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest diameter of every case (lowest ordinal on ties), tilted by its ordinal."""
    if _EVERY_PROMPT:
        return key_by_prompt(tilted_prompts(spark, sf_dir))
    cols = ["label", "ax", "ay", "az", "bx", "by", "bz", "slice", "nz", "ny", "nx"]
    best = prompts(spark, sf_dir).groupBy("case_id").agg(
        F.max_by(F.struct("prompt", *cols), F.struct(F.expr("bx - ax"), -F.col("prompt"))).alias("p")
    )
    return best.select("case_id", "p.*").withColumn("by", F.expr("by + prompt % 4"))


def marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker voxels: the drawn diameters, lowest label where two cross."""
    return (
        lesions(spark, sf_dir)
        .selectExpr("case_id", "cz AS z", "cy AS y", "explode(sequence(cx - rx, cx + rx)) AS x", "label")
        .groupBy("case_id", "z", "y", "x")
        .agg(F.min("label").alias("label"))
    )


def _scatter_keys() -> list[str]:
    return [
        "l_orderkey div 750 AS case_id", "cast(l_linenumber - 1 AS int) AS z",
        "cast(l_partkey % 24 AS int) AS y", "cast(l_orderkey % 24 AS int) AS x",
    ]


def scattered_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_scatter_keys(), "if(l_returnflag = 'R', 2, 1) AS label")
    return rows.groupBy("case_id", "z", "y", "x").agg(F.min("label").alias("label"))


def prob_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_scatter_keys(), "cast(l_quantity AS int) AS q")
    return rows.groupBy("case_id", "z", "y", "x").agg((F.max("q") / 50).alias("prob"))


def scattered_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    nz, ny, nx = SCATTER_FRAME
    cases = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 750 AS case_id").distinct()
    return cases.selectExpr(
        "case_id", f"{nz} AS nz", f"{ny} AS ny", f"{nx} AS nx",
        "cast(1 + case_id % 3 AS double) AS sz", "1D AS sy", "1D AS sx",
    )


def aux_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organ files: several classes may claim a voxel."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_scatter_keys(), "cast(l_suppkey % 29 AS int) AS class_id").distinct()


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4x4x4 intensity volumes, one row per (z, y) line, from the 64-long vectors."""
    return (
        table(spark, sf_dir, "embeddings")
        .selectExpr("vec_id AS case_id", "label AS grp", "embedding", "explode(sequence(0, 15)) AS line")
        .selectExpr(
            "case_id", "grp", "cast(line div 4 AS int) AS z", "cast(line % 4 AS int) AS y",
            "transform(slice(embedding, line * 4 + 1, 4), v -> cast(v AS double)) AS vals",
        )
    )


def scan_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS case_id", "4 AS nz", "4 AS ny", "4 AS nx",
        "cast(1 + vec_id % 4 AS double) AS sz", "1D AS sy", "1D AS sx",
    )


def scan_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of the 4x4x4 volumes above zero; label 2 above 0.1."""
    return (
        scanlines(spark, sf_dir)
        .selectExpr("case_id", "z", "y", "posexplode(vals) AS (x, v)")
        .where("v > 0")
        .selectExpr("case_id", "z", "y", "x", "if(v > 0.1, 2, 1) AS label")
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case records; every source's first half of languages trains; some rows appear twice."""
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr(
        "doc_id AS case_id", "concat('images/', doc_id, '.npz') AS image_path", "source",
        "if(lang = 'en', 'train', 'val') AS split",
        "case when doc_id % 13 = 0 then null when n_chars % 11 = 0 then 0L else n_chars end AS target_voxel_count",
        "if(n_chars % 3 = 0, null, cast(1 + n_chars % 3 AS int)) AS target_label_value",
        "if(doc_id % 10 = 0, 2, 1) AS copies",
    ).selectExpr(
        "*", "explode(sequence(0, copies - 1)) AS copy"
    ).selectExpr("case_id * 2 + copy AS ord", "case_id", "image_path", "source", "split", "target_voxel_count", "target_label_value")


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that exist: those of judged documents."""
    return table(spark, sf_dir, "labels").selectExpr(
        "concat('images/', doc_id, '.npz') AS path", "cast(doc_id * 10 + quality AS bigint) AS length",
        "timestamp_seconds(1700000000 + doc_id) AS modificationTime",
    )


def case_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS case_id",
        "case event_type when 'error' then 'error' when 'signup' then 'timeout' else 'ok' end AS status",
        "if(event_type = 'error', null, value / 10) AS total_seconds",
        "cast(get_json_object(props, '$.k') AS double) AS rss_mb",
        "if(event_type = 'error', null, value * 2) AS cpu_memory_time_mb_seconds",
        "if(event_type in ('click', 'view'), (event_id % 101) / 100, null) AS dsc",
        "if(event_type in ('click', 'view'), (event_id % 97) / 96, null) AS nsd",
    )


def train_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "dayofmonth(ts) AS epoch", "ts", "event_id AS step_key", "value AS loss",
        "(event_id % 101) / 103 AS crop_dice", "event_type",
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs with a 0/1 target per voxel."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey div 750 AS sample", "(l_quantity - 25) / 10 AS logit", "if(l_returnflag = 'R', 1, 0) AS target",
    )


def class_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three class scores per voxel with the true class; -1 is ignored."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey div 750 AS sample",
        "array(l_quantity / 20, l_discount * 30, l_tax * 40) AS scores",
        "case l_returnflag when 'R' then 2 when 'A' then 1 else if(l_linestatus = 'F', 0, -1) end AS target",
    )
