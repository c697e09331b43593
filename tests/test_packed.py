"""Runs travel packed, a row for each slice; tables of components are not sent to every task."""

import re

import pytest

from voxtally.operators import components as cc
from voxtally.operators import crops as cr
from voxtally.operators import overlap as ov
from voxtally.operators import prompts as pr
from voxtally.operators import targets as tg

WINDOWED = "case_id bigint, w_z0 int, w_z1 int, w_y0 int, w_y1 int, w_x0 int, w_x1 int, sz double, sy double, sx double, ax double, ay double, az double, bx double, by double, bz double, slice int, nz int, ny int, nx int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def mask(spark):
    """Voxels of three cases, one without a key; some have no z or y, some come twice."""
    grid = spark.range(0, 3000).selectExpr("id % 3 AS c", "id", "cast(id * 7 % 5 AS int) AS z", "cast(id * 11 % 13 AS int) AS y", "cast(id * 17 % 31 AS int) AS x")
    return grid.selectExpr("if(c = 2, null, c) AS case_id", "if(z = 4, null, z) AS z", "if(y = 12, null, y) AS y", "if(id % 97 = 0, null, x) AS x", "cast(1 + id % 2 AS int) AS label")


def test_packed_runs_are_the_runs(mask):
    mask = mask.coalesce(1)
    packed = cc.packed_stretches(mask, ("case_id", "label"))
    assert packed.count() == mask.select("case_id", "z").distinct().count()
    loose = packed.selectExpr("case_id", "z", "inline(arrays_zip(label, y, x0, x1))")
    assert rows(loose.select("case_id", "label", "z", "y", "x0", "x1")) == rows(cc.stretches(mask))


def test_pairs_meet_by_slice(spark, mask):
    other = mask.where("label = 1 OR y < 5").selectExpr("case_id", "z", "y", "(x + 3) % 31 AS x", "label")
    met = ov.paired_runs(mask, other)
    assert not re.search(r"hashpartitioning\([^)]*\by#", plan(met))
    mask.createOrReplaceTempView("packed_a")
    other.createOrReplaceTempView("packed_b")
    plain = spark.sql("""SELECT case_id, z, y, x, max(if(s = 0, label, 0)) AS g, max(if(s = 1, label, 0)) AS p
      FROM (SELECT *, 0 AS s FROM packed_a UNION ALL SELECT *, 1 FROM packed_b) GROUP BY 1, 2, 3, 4""")
    assert rows(ov.paired(mask, other)) == rows(plain)


def test_box_tail_of_packed_targets(spark):
    """Box too large, all well inside, most outside the window, no target; the shuffle before the join carries packed runs."""
    ends = (20.0, 20.0, 8.0, 24.0, 20.0, 8.0, 8, 24, 50, 50)
    windows = spark.createDataFrame([(c, 0, 16, 0, 40, 0, 44, 1.0, 1.0, 1.0, *ends) for c in range(4)], WINDOWED)
    spots = [(0, 8, 10, x) for x in range(2, 48)] + [(1, z, y, x) for z in (7, 8, 9) for y in (18, 20, 22) for x in (20, 21, 25)] + [(2, 8, y, 20) for y in range(10, 48)]
    target = spark.createDataFrame(spots, "case_id bigint, z int, y int, x int").coalesce(1)
    got = cr.needs_bbox_tail(windows, target, (16, 40, 44), 3.0)
    assert rows(got) == [(0, True), (1, False), (2, True), (3, False)]
    assert "arrays_zip" in plan(got)


def test_components_are_not_broadcast(mask):
    mask = mask.dropna()
    runs = cc.component_runs(mask)
    keys = ("case_id", "label", "component_id")
    ends = pr.derive_endpoints(runs, keys)
    records = tg.component_records(runs, ends)
    assert "Broadcast" not in plan(ends) and "Broadcast" not in plan(records)
    assert records.count() == runs.select(*keys).distinct().count()
