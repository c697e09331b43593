"""Runs travel coded, a few bytes each; what is judged from them is what single runs gave."""

import numpy as np
import pyarrow as pa
import pytest

from voxtally.functions.grids import coded, decoded, nearest_points
from voxtally.operators import components as cc
from voxtally.operators import prompts as pr
from voxtally.operators import select as sel
from voxtally.operators import surface as sf
from voxtally.plans import evaluate as ev
from voxtally.sources import volumes as vo

MASK = "case_id bigint, z int, y int, x int, label int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [3, 300, 2**41])
def test_codes_give_the_numbers_back(most):
    draw = np.random.default_rng(3)
    starts = np.array([0, 1, 40, 41, 200])
    columns = [draw.integers(-most, most, 333) for _ in range(4)]
    values = coded(columns, starts)
    counts, got = decoded(pa.chunked_array([values.slice(0, 2), pa.array([None], pa.binary()), values.slice(2)]), 4)
    assert counts.tolist() == [1, 39, 0, 1, 159, 133] and all((a == b).all() for a, b in zip(got, columns))


def test_runs_of_a_slab_travel_as_one_value(spark, meta_of):
    """no column of a run is in a shuffle; areas are summed in the task that finds them."""
    gt = spark.createDataFrame([(c, z, y, x, 1) for c in (1, None) for z in range(5) for y in range(4) for x in range(6)], MASK)
    pred = gt.where("x > 1").unionByName(gt.where("x > 3")).repartition(3)
    made = sf.surface_within(gt, pred, meta_of({1: (9, 9, 9)}))
    assert "x0#" not in plan(made) and "code#" not in plan(made) and "runs#" in plan(made)
    scores = sf.label_metrics(gt, pred, meta_of({1: (9, 9, 9)}))
    assert [r[:3] + r[4:] for r in rows(scores)] == [(1, 1, 0.8, 120, 80), (None, 1, 0.8, 120, 80)]
    by_case = {r.case_id: r.nsd for r in scores.collect()}
    assert by_case[None] is None and 0.9 < by_case[1] <= 1.0


def test_areas_of_codes(spark, meta_of):
    codes = spark.range(1, 255).selectExpr("7L AS case_id", "cast(id AS int) AS code")
    want = {r.code: r.area for r in sf._areas(codes, meta_of({7: (9, 9, 9)}, (3.0, 0.7, 1.1))).collect()}
    spacing = [np.full(254, s) for s in (3.0, 0.7, 1.1)]
    got = sf.code_areas(np.arange(1, 255), *spacing)
    assert got == pytest.approx([want[c] for c in range(1, 255)])


def test_sweep_of_cases_without_number(spark, meta_of):
    """the threshold is a part of a plain key, whatever the cases are called."""
    voxels = [(c, 1, 1, x, 0.4 + 0.1 * x) for c in ("a", "b#1") for x in range(4)]
    prob = spark.createDataFrame(voxels, "case_id string, z int, y int, x int, prob double")
    meta = meta_of({0: (3, 3, 5)}).drop("case_id").crossJoin(prob.select("case_id").distinct())
    got = ev.threshold_sweep(prob, prob.where("x > 0"), meta, [0.35, 0.45, 0.65])
    assert [(r.ord, round(r.val_dsc, 6)) for r in got.orderBy("ord").collect()] == [(0, round(6 / 7, 6)), (1, 1.0), (2, 0.5)]


def test_ordered_voxels_need_no_sorting(spark):
    mask = spark.createDataFrame([(c, 1, y, x, 1) for c in (3, None, 1) for y in (2, 0) for x in (4, 5, 6, 9)], MASK).coalesce(1)
    want = sorted([(c, 1, 1, y, a, b) for c in (3, None, 1) for y in (0, 2) for a, b in ((4, 6), (9, 9))], key=repr)
    assert rows(cc.stretches(mask)) == want and rows(cc.stretches(mask.orderBy("x"))) == want


@pytest.mark.parametrize("depth", [1, 3, 50])
def test_components_of_slabs(spark, depth):
    """A slab is one coded row; its depth changes nothing, nor do voxels that come twice or have no case."""
    spots = [(z, y, x) for z in range(7) for y in range(6) for x in range(8) if (z * 5 + y * 3 + x * 7) % 4 < 2]
    mask = spark.createDataFrame([(c, *v, 1 + v[1] // 3) for c in ("a", None, "b") for v in spots], MASK.replace("bigint", "string"))
    linked = cc.linked_slabs(mask.union(mask).repartition(4), depth)
    assert linked.count() == 2 * 2 * -(-7 // depth) and "x0" not in linked.columns
    got = cc.component_runs(mask.union(mask).repartition(4), depth)
    whole = cc.component_runs(mask, 100)
    assert rows(got) == rows(whole) and {r.case_id for r in got.collect()} == {"a", "b"}
    assert cc.runs_to_voxels(got).count() == 2 * len(spots)
    stats = cc.component_stats(got)
    assert "Exchange hashpartitioning(case_id" in plan(stats) and plan(stats).count("Exchange") == 1
    assert sum(r.voxel_count for r in stats.collect()) == 2 * len(spots)


def test_regions_meet_components_coded(spark):
    """runs of regions are not sent one by one, by line; shares are those of a plain join, nulls meet nothing."""
    box = lambda c, p, z0, y0, x0, n: [(c, p, z, y, x0, x0 + n) for z in range(z0, z0 + n) for y in range(y0, y0 + n)]
    runs = spark.createDataFrame(box("a", 1, -2, 0, 0, 5) + box("a", 2, 30, 4, 9, 6) + box(None, 1, 0, 0, 0, 3), "case_id string, component_id int, z int, y int, x0 int, x1 int")
    region = spark.createDataFrame(box("a", 7, 0, 2, 3, 40) + box("a", None, 31, 3, 0, 10) + box("b", 7, 0, 0, 0, 4) + box(None, 7, 0, 0, 0, 3), "case_id string, prompt int, z int, y int, x0 int, x1 int")
    region = region.selectExpr("case_id", "prompt", "z", "y", "x0 AS r0", "x1 AS r1")
    other = region.where("prompt IS NULL").withColumn("r1", (region.r0 + 9).cast("int"))
    got = sel.run_overlaps(runs, {"one": region, "two": other}, ("case_id", "prompt"))
    assert "r0#" not in "".join(line for line in plan(got).splitlines() if "Exchange" in line) and "hashpartitioning(case_id#" in plan(got) and " y#" not in "".join(line for line in plan(got).splitlines() if "Exchange" in line)
    shared = lambda r, name: runs.join(r, ["case_id", "z", "y"]).where("r0 <= x1 AND x0 <= r1").selectExpr("case_id", "prompt", "component_id", "cast(least(r1, x1) - greatest(r0, x0) + 1 AS bigint) AS n").groupBy("case_id", "prompt", "component_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", name)
    want = {}
    for k, r in enumerate((region, other)):
        for a, b, c, n in shared(r, "n").collect():
            want.setdefault((a, b, c), [0, 0])[k] = n
    assert {tuple(r)[:3]: list(r)[3:] for r in got.collect()} == want and len(want) == 3


@pytest.mark.parametrize("most", [40, 1_000_000])
@pytest.mark.parametrize("reach", [1, 9, 70])
def test_nearest_points_of_groups(reach, most):
    """as many points as lie near, not all pairs and not all points of a box, and the same distances."""
    draw = np.random.default_rng(reach)
    group, to_group = (np.sort(np.r_[np.arange(6), draw.integers(0, 6, n)]) for n in (300, 200))
    at, to = ([draw.integers(-reach, reach, len(g)) for _ in range(3)] for g in (group, to_group))
    scale = [draw.uniform(0.3, 4, 6) for _ in range(3)]
    got = nearest_points(group, at, to_group, to, scale, most)
    for k, g in enumerate(group):
        assert got[k] == pytest.approx(min(sum(((a[k] - b) * s[g]) ** 2 for a, b, s in zip(at, to, scale))[to_group == g]))


def test_distances_of_whole_labels(spark, meta_of):
    gt = spark.createDataFrame([(c, z, 2, x, label) for c in (1, None, 2) for z in range(-3, 40, 20) for x in range(3) for label in (1, 2)], MASK)
    pred = gt.where("label = 1 AND x > 0").withColumn("z", (gt.z + 1).cast("int")).unionByName(gt.where("label = 1 AND x > 1")).repartition(3)
    made = sf.border_distances(gt, pred, meta_of({1: (50, 4, 4)}, (2.0, 1.0, 0.5)))
    assert "x0#" not in plan(made) and "ys#" not in plan(made)
    got = made.collect()
    assert {(r.case_id, r.label, r.side) for r in got} == {(1, 1, 0), (1, 1, 1)}
    cells = lambda side: sum(r.n for r in got if r.side == side)
    assert cells(0) == 3 * 2 * 2 * 4 and cells(1) == 3 * (2 * 2 * 3 + 2 * 2) and max(r.d2 for r in got) == 4.0 and min(r.d2 for r in got) == 0


def test_files_hold_blocks_of_slices(spark, meta_of, tmp_path, monkeypatch):
    """readers and writers work on blocks of slices and hand on the rows of several files; later runs overwrite, cases without runs are empty."""
    monkeypatch.setattr(vo, "BLOCK_POINTS", 60)
    boxes = [(c, 1 + z % 3, z, y, y, y + 2) for c in (1, 2, 7) for z in (0, 1, 4, 8) for y in (0, 3)] + [(1, 5, 4, 3, 4, 4), (1, 9, 99, 0, 0, 1)]
    runs = spark.createDataFrame(boxes, "case_id bigint, label int, z int, y int, x0 int, x1 int").repartition(3)
    meta = meta_of({c: (9, 4, 6) for c in (1, 2, 3)}).selectExpr("*", "cast(null AS array<double>) AS direction", "cast(null AS array<double>) AS origin")
    want = {}
    for c, label, z, y, x0, x1 in boxes:
        want |= {(str(c), z, y, x): label for x in range(x0, x1 + 1) if c < 3 and z < 9}
    for form in ("nii", "npz"):
        (tmp_path / form).mkdir()
        assert vo.export_predictions(runs, meta, str(tmp_path / form), form).count() == 3
    back = vo.scan_nifti(spark, str(tmp_path / "nii"), "mask")
    assert "MapInArrow" in plan(back) and back.where("kind = 'meta'").count() == 3
    assert {(r.case_id, r.z, r.y, x): r.label for r in back.where("kind = 'mask'").collect() for x in range(r.x0, r.x1 + 1)} == want
    for c in (1, 2, 3):
        volume = np.load(tmp_path / "npz" / f"{c}_prediction.npz")["prediction"]
        assert {(str(c), *map(int, at)): int(volume[tuple(at)]) for at in np.argwhere(volume)} == {k: v for k, v in want.items() if k[0] == str(c)}


def test_channels_of_lines_that_lie_by_slice(spark):
    """scanlines are sent at most once, by slice."""
    prompts = spark.createDataFrame([(c, 2.0, 1.0, 1.0, 6.0, 3.0, 1.0, 1, 3, 5, 9) for c in (1, 2)], "case_id bigint, ax double, ay double, az double, bx double, by double, bz double, slice int, nz int, ny int, nx int")
    lines = prompts.selectExpr("case_id", "nx", "ny", "explode(sequence(0, nz - 1)) AS z").repartition("case_id", "z").selectExpr("case_id", "z", "explode(sequence(0, ny - 1)) AS y", "array_repeat(0D, nx) AS vals")
    made = pr.prompt_channels(lines, prompts)
    assert not [row for row in plan(made).splitlines() if "Exchange" in row and "vals#" in row] and "Broadcast" not in plan(made)
    got = {(r.case_id, r.z, r.y): r for r in made.collect()}
    marked = {tuple(r) for r in pr.rasterize_line(prompts).collect()}
    assert len(got) == 2 * 3 * 5
    for (c, z, y), r in got.items():
        assert r.line == [float((c, z, y, x) in marked) for x in range(9)]
        assert r.gauss == pytest.approx([max(np.exp(-((z - 1) ** 2 + (y - b) ** 2 + (x - a) ** 2) / 8) for a, b in ((2, 1), (6, 3))) for x in range(9)])
