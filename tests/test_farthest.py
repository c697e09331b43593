"""Farthest pairs by hull and calipers against all pairs."""

import random

from voxtally.operators import prompts as pr


def all_pairs(points):
    return min((-((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2), *a, *b) for a in points for b in points)[1:]


def runs_of(shape):
    """Runs (y, x0, x1) of a set of (y, x)."""
    return [(y, x, max(e for e in range(x, 60) if all((y, k) in shape for k in range(x, e + 1)))) for y, x in sorted(shape) if (y, x - 1) not in shape]


def shapes():
    rng = random.Random(3)
    yield {(4, 5)}
    yield {(4, 5), (4, 6)}
    yield {(y, 3) for y in range(7)}
    yield {(k, k) for k in range(9)}
    yield {(y, x) for y in range(6) for x in range(6)}  # both diagonals tie
    yield {(y, x) for y in range(40) for x in range(40) if (y - 20) ** 2 + (x - 20) ** 2 <= 169}
    for _ in range(300):
        side = rng.choice([2, 3, 5, 9, 25])
        yield {(rng.randrange(side), rng.randrange(side)) for _ in range(rng.choice([1, 2, 3, 6, 30]))}


def test_outline_and_calipers_against_all_pairs(spark):
    want, rows = {}, []
    for k, shape in enumerate(shapes()):
        want[f"c{k}"] = all_pairs(shape)
        rows += [(f"c{k}", 7, y, x0, x1) for y, x0, x1 in runs_of(shape)] + [(f"c{k}", 9, 0, 0, len(shape) - 1)]  # a tie: the lower slice
    got = pr.derive_endpoints(spark.createDataFrame(rows, "case_id string, z int, y int, x0 int, x1 int"), ("case_id",)).collect()
    assert {r.case_id: (r.ay, r.ax, r.by, r.bx) for r in got} == want
    assert {(r.slice, r.az, r.bz) for r in got} == {(7, 7.0, 7.0)}
    assert all(r.marker_voxels % 2 == 0 for r in got)


def test_slice_of_very_many_lines(spark):
    """A tall disk of 100,000 lines, whose widest pair is the vertical one."""
    runs = spark.range(100_001).selectExpr("'c' AS case_id", "1 AS z", "cast(id AS int) AS y", "cast(sqrt(50000D * 50000 - pow(id - 50000, 2)) / 2 AS int) AS h")
    runs = runs.selectExpr("case_id", "z", "y", "60000 - h AS x0", "60000 + h AS x1")
    (row,) = pr.derive_endpoints(runs, ("case_id",)).collect()
    assert (row.ay, row.ax, row.by, row.bx) == (0, 60000, 100_000, 60000)


def test_no_runs(spark):
    assert pr.derive_endpoints(spark.createDataFrame([], "case_id string, z int, y int, x0 int, x1 int"), ("case_id",)).collect() == []


def test_runs_are_sent_once(spark, sf_dir):
    from voxtally.operators import components as cc
    from workload import fixtures as fx

    ends = pr.derive_endpoints(cc.mask_runs(fx.gt(spark, sf_dir)), ("case_id", "label"))
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "y#" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
