"""Regions as runs against regions as voxels, and one labelling for many prompts."""

import random

import pytest
from pyspark.sql import functions as F

from voxtally.operators import components as cc
from voxtally.operators import prompts as pr
from voxtally.operators import select as sel
from voxtally.operators import targets as tg

KEYS = ("case_id", "prompt")
PROMPT = "case_id bigint, prompt int, ax double, ay double, az double, bx double, by double, bz double, slice int, nz int, ny int, nx int"


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(2)
    at = lambda n: rng.choice([-3.0, 0.0, rng.uniform(0, n), float(rng.randrange(n)), n + 5.0])
    rows = [(c, p, at(17), at(14), at(9), at(17), at(14), at(9), 1, 9, 14, 17) for c in range(4) for p in range(8)]
    return spark.createDataFrame(rows, PROMPT)


def voxels(df):
    rows = [tuple(r) for r in df.select(*KEYS, "z", "y", "x").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("mode", pr.PROMPT_MODES)
def test_region_runs_hold_the_voxels_of_the_region(drawn, mode):
    runs = pr.prompt_region_runs(drawn, mode=mode, keys=KEYS)
    assert voxels(cc.runs_to_voxels(runs)) == voxels(pr.prompt_region(drawn, mode=mode, keys=KEYS))


def test_tube_runs_hold_the_voxels_of_the_tube(drawn):
    assert voxels(cc.runs_to_voxels(pr.tube_runs(drawn, 5, 2, keys=KEYS))) == voxels(pr.tube_region(drawn, 5, 2, keys=KEYS))


@pytest.mark.parametrize("options", [{}, {"mode": "prompt_hybrid_component"}, {"min_voxels": 4, "min_fraction": 0.5}, {"prompt_mode": "no_prompt", "mode": "prompt_tube_component"}])
def test_every_prompt_keeps_what_it_would_keep_alone(spark, drawn, options):
    rng = random.Random(6)
    mask = spark.createDataFrame([(c, z, y, x, 1) for c in range(4) for z in range(9) for y in range(14) for x in range(17) if rng.random() < 0.25], "case_id bigint, z int, y int, x int, label int")
    mask = mask.unionByName(spark.createDataFrame([(9, 0, 0, 0, 1)], mask.schema))  # a case without a prompt
    got = sel.keep_prompt_component(mask, pr.prompt_region_runs(drawn, keys=KEYS), drawn, keys=KEYS, **options)
    all_kept = voxels(got)
    for p in range(0, 8, 3):
        one = drawn.where(F.col("prompt") == p)
        alone = sel.keep_prompt_component(mask.where("case_id < 9"), pr.prompt_region(one), one, **options).withColumn("prompt", F.lit(p))
        assert voxels(alone) == {v for v in all_kept if v[1] == p} != set()
    # without keys of its own, a case without a prompt keeps its only component
    assert sel.keep_prompt_component(mask.where("case_id = 9"), pr.prompt_region(drawn.where("prompt = 0")), drawn.where("prompt = 0")).count() == 1


def plain_distance(point, voxels, z):
    d = lambda v: sum((a - b) ** 2 for a, b in zip(point, v)) ** 0.5
    return min(map(d, [v for v in voxels if v[0] == z] or voxels))


def test_target_among_very_many_components(spark):
    """10,000 one-voxel components of one case: few are read as runs, and the choice is that of a plain search."""
    rng = random.Random(9)
    spots = [(2 * z, 2 * y, 2 * x) for z in range(10) for y in range(25) for x in range(40)]
    mask = spark.createDataFrame([(1, *v, 1 + (sum(v) // 2) % 2) for v in spots], "case_id bigint, z int, y int, x int, label int")
    runs = cc.component_runs(mask)
    named = {(r.z, r.y, r.x0): (r.label, r.component_id) for r in runs.collect()}
    odd = lambda n: 2.0 * rng.randrange(n // 2) + 1
    rows = [(1, p, odd(80), odd(50), odd(20), odd(80), odd(50), odd(20), p, 20, 50, 80) for p in range(12)]
    prompts = spark.createDataFrame(rows, PROMPT)
    got = {r.prompt: r for r in tg.select_target_instance(prompts, runs).collect()}
    blind = tg._contenders(prompts, spark.createDataFrame([], _HITS), runs.selectExpr("*", "z AS z_min", "z AS z_max", "y AS y_min", "y AS y_max", "x0 AS x_min", "x1 AS x_max").drop("z", "y", "x0", "x1"), KEYS)
    assert blind.groupBy("prompt").count().agg(F.max("count")).first()[0] < 1000
    assert len(got) == 12 and all(r.component_candidate_count == 10_000 and r.positive_label_count == 2 for r in got.values())
    for _, p, ax, ay, az, bx, by, bz, z, *_ in rows:
        if got[p].used_fallback:
            score = lambda v: (round((plain_distance((az, ay, ax), [v], z) + plain_distance((bz, by, bx), [v], z)) / 2, 9), abs(v[0] - z), *named[v])
            best = min(spots, key=score)
            assert (got[p].label, got[p].component_id) == named[best]


_HITS = "case_id bigint, prompt int, label int, component_id int, line_overlap bigint, endpoint_hits bigint, endpoint_label_hit boolean, line_label_hit boolean"
