"""Voxels become runs where they lie: the same results as plain groupings, without voxels in a shuffle and without exploded tables in a broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from voxtally.operators import components as cc
from voxtally.operators import crops as cr
from voxtally.operators import overlap as ov
from voxtally.operators import prompts as pr
from voxtally.operators import select as sel
from voxtally.operators import surface as sf
from voxtally.operators import targets as tg
from workload import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_voxels(df):
    return bool(re.search(r"hashpartitioning\([^)]*\bx#", plan(df)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def fx_ends(spark):
    return spark.createDataFrame([(0, *[1.0] * 6, 5, 13, 31)], "case_id bigint, " + ", ".join(f"{e} double" for e in ("ax", "ay", "az", "bx", "by", "bz")) + ", nz int, ny int, nx int")


@pytest.fixture
def masks(spark):
    """Two masks over two cases and a null one; some voxels twice, with two labels."""
    grid = spark.range(0, 4000).selectExpr("id % 3 AS c", "cast(id * 7 % 5 AS int) AS z", "cast(id * 11 % 13 AS int) AS y", "cast(id * 17 % 31 AS int) AS x", "id")
    grid = grid.selectExpr("if(c = 2, null, c) AS case_id", "z", "y", "x", "cast(1 + id % 2 AS int) AS label", "id")
    return grid.where("id % 3 <> 1 AND id % 7 < 4").drop("id"), grid.where("id % 5 < 3").drop("id")


def test_exploded_tables_are_not_broadcast(spark, sf_dir):
    codes = fx.meta(spark, sf_dir).selectExpr("case_id", "explode(sequence(1, 254)) AS code")
    assert plan(sf._areas(codes, sf._spacing(fx.meta(spark, sf_dir)))).count("BroadcastHashJoin") == 1  # the facets
    assert "Broadcast" not in plan(tg.prompt_labels(fx.prompts(spark, sf_dir), cc.mask_runs(fx.gt(spark, sf_dir))))
    runs = cc.component_runs(fx.gt(spark, sf_dir))
    assert "Broadcast" not in plan(runs.join(fx.prompts(spark, sf_dir), "case_id"))


def test_masks_are_filled_in_their_case(spark, sf_dir):
    for mask in (fx.gt(spark, sf_dir), fx.pred(spark, sf_dir)):
        assert not shuffles_voxels(mask)
        assert mask.count() == mask.select("case_id", "z", "y", "x").distinct().count()
    labels = spark.createDataFrame([(3, 2), (4, 1)], "case_id bigint, label int")
    named = fx.gt(spark, sf_dir).where("(case_id = 3 AND label = 2) OR (case_id = 4 AND label = 1)")
    assert rows(fx.gt(spark, sf_dir, labels)) == rows(named)


def test_runs_of_repeated_voxels(spark):
    mask = spark.createDataFrame([(c, 1, 2, x, 1) for c in (1, None) for x in (5, 5, 6, 8)], "case_id bigint, z int, y int, x int, label int").repartition(5)
    want = sorted([(c, 1, 1, 2, a, b) for c in (1, None) for a, b in ((5, 6), (8, 8))], key=repr)
    assert rows(cc.mask_runs(mask)) == want
    far = mask.selectExpr("case_id", "z * 1000000007 AS z", "y * 1000000009 AS y", "x", "label").union(mask.selectExpr("case_id", "-z", "-y", "x", "label"))
    assert cc.mask_runs(far).count() == 8
    assert rows(cc.runs_to_voxels(cc.stretches(mask)).select(*mask.columns)) == rows(mask)


def test_pairs_meet_as_runs(masks):
    gt, pred = masks
    left = gt.selectExpr("case_id", "z", "y", "x", "label AS g", "0 AS p")
    plain = left.unionByName(pred.selectExpr("case_id", "z", "y", "x", "0 AS g", "label AS p")).groupBy("case_id", "z", "y", "x").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    assert not shuffles_voxels(ov.paired(gt, pred))
    assert rows(ov.paired(gt, pred)) == rows(plain)
    counts = plain.groupBy("case_id").agg(F.expr("count_if(g > 0 AND p > 0)"), F.expr("count_if(g = 0)"), F.expr("count_if(p = 0)"))
    assert rows(ov.confusion(gt, pred)) == rows(counts)
    assert rows(ov.mask_union(gt, pred)) == rows(plain.select("case_id", "z", "y", "x"))
    assert rows(ov.mask_symmetric_difference(gt, pred)) == rows(plain.where("(g > 0) <> (p > 0)").select("case_id", "z", "y", "x"))


def test_prompts_merge_as_runs(masks):
    gt, pred = masks
    both = gt.selectExpr("case_id", "label AS prompt", "label", "z", "y", "x").unionByName(pred.selectExpr("case_id", "if(label = 1, null, 3) AS prompt", "label", "z", "y", "x"))
    plain = both.groupBy("case_id", "z", "y", "x").agg(F.min_by("label", "prompt").alias("label"), F.min("prompt").alias("prompt"))
    assert not shuffles_voxels(sel.merge_prompt_masks(both))
    assert rows(sel.merge_prompt_masks(both)) == rows(plain)
    assert not shuffles_voxels(sel.merge_report(both))


def test_voxels_meet_frames_as_runs(spark, masks):
    mask = masks[0]
    windows = spark.createDataFrame([(0, 1, 4, 2, 9, 3, 20), (1, 0, 2, 0, 30, 10, 50)], "case_id bigint, " + ", ".join(f"{w} int" for w in cr.WINDOW))
    inside = mask.join(windows, "case_id").where("z >= w_z0 AND z < w_z1 AND y >= w_y0 AND y < w_y1 AND x >= w_x0 AND x < w_x1")
    cropped = cr.crop_mask(mask, windows)
    assert "MapInArrow" in plan(cropped) and "MapInArrow" in plan(pr.endpoint_gaussian(mask, fx_ends(spark)))
    assert rows(cropped) == rows(inside.selectExpr("case_id", "z - w_z0 AS z", "y - w_y0 AS y", "x - w_x0 AS x", "label"))
    assert rows(cr.restore_crop(cropped, windows)) == rows(inside.select(*mask.columns))
    frames = windows.selectExpr("case_id", "5 AS nz", "13 AS ny", "31 AS nx")
    count = [F.expr(f"sum(int({a} < 3) + int({a} >= n{a} - 3))").alias(a) for a in "zyx"]
    assert rows(sel.border_load(mask, frames, 2).where("case_id = 0").select("case_id", *[f"count_{a}" for a in "zyx"])) == rows(mask.join(frames, "case_id").groupBy("case_id").agg(*count))


def test_region_is_spelled_out_of_runs(spark, sf_dir):
    prompts = fx.tilted_prompts(spark, sf_dir).where("case_id < 5")
    keys = ("case_id", "prompt")
    line, gauss = pr.rasterize_line(prompts, keys=keys), pr.gaussian_support(prompts, 2.0, pr.REGION_LEVEL, keys).drop("gauss")
    assert not shuffles_voxels(line) and not shuffles_voxels(pr.prompt_region(prompts, keys=keys))
    assert rows(pr.prompt_region(prompts, keys=keys)) == rows(line.unionByName(gauss).distinct())
    assert rows(pr.rasterize_line(prompts.union(prompts), keys=keys)) == rows(line)
