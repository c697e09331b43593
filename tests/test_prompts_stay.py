"""Prompts become runs in the task that holds them, and tables with a row for each prompt or case are never broadcast."""

import random
import re

from voxtally.operators import components as cc
from voxtally.operators import prompts as pr
from workload import fixtures as fx

KEYS = ("case_id", "prompt")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_runs_made_in_place_are_merged(spark):
    rng = random.Random(4)
    spans = [(rng.choice([None, 1, 2]), rng.choice([None, 3, 4]), rng.randrange(-2, 3), rng.randrange(3), x, x + rng.randrange(4)) for x in [rng.randrange(-9, 30) for _ in range(400)]]
    runs = spark.createDataFrame(spans, "case_id bigint, prompt int, z int, y int, x0 int, x1 int")
    made = cc.merge_runs_made(cc.together(runs, KEYS), KEYS)
    assert rows(made.select(*KEYS, "z", "y", "x0", "x1")) == rows(cc.merge_runs(runs, KEYS).select(*KEYS, "z", "y", "x0", "x1"))
    assert cc.merge_runs_made(cc.together(runs.where("false"), KEYS), KEYS).count() == 0


def test_regions_are_not_sorted_or_sent_by_line(spark, sf_dir):
    prompts, one = fx.tilted_prompts(spark, sf_dir), fx.case_prompts(spark, sf_dir)
    for made in (pr.prompt_region(one), pr.prompt_region_runs(prompts, keys=KEYS), pr.tube_runs(prompts, keys=KEYS), pr.rasterize_line(prompts, keys=KEYS)):
        assert "Window" not in plan(made)
        assert not re.search(r"hashpartitioning\([^)]*\b[zyx]#", plan(made))


def test_prompts_and_cases_are_not_broadcast(spark, sf_dir):
    keys = fx.prompts(spark, sf_dir)
    plain = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey div 10 AS case_id", "o_orderkey % 10 AS prompt", "o_custkey")
    assert "Broadcast" not in plan(pr.copy_to_prompts(plain.drop("prompt"), plain))
    assert "Broadcast" not in plan(pr.copy_to_prompts(fx.meta(spark, sf_dir), keys))
    assert "Broadcast" not in plan(fx.meta(spark, sf_dir).join(fx.case_prompts(spark, sf_dir), "case_id"))
