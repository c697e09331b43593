"""Cases with several prompts: every prompt has its own result."""

import duckdb
import numpy as np
import pytest

from voxtally.operators import prompts as pr
from voxtally.plans import autozoom as az
from test_queries import plain
from workload.every_prompt import NAMES
from workload.queries import QUERIES, oracles

FILTERING = [
    "keep_prompt_component", "keep_prompt_tube_component", "keep_prompt_box_component", "keep_prompt_hybrid_component", "remove_small_islands", "component_prompt_overlap", "component_audit",
    "merge_kept_prompts",
]
PROMPT = "case_id bigint, prompt int, ax double, ay double, az double, bx double, by double, bz double, slice int, nz int, ny int, nx int"


@pytest.fixture(scope="module")
def few(sf_dir, tmp_path_factory):
    """The smallest scale with the first 25 cases' orders, so that components and whole grids of every prompt stay small."""
    folder = tmp_path_factory.mktemp("few")
    duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/orders.parquet' WHERE o_orderkey < 250) TO '{folder}/orders.parquet'")
    return str(folder)


@pytest.fixture(scope="module")
def duck(few):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{few}/orders.parquet'")
    return con


@pytest.mark.parametrize("name", [*[f"{n}_every_prompt" for n in NAMES], *FILTERING])
def test_query_matches_sql(spark, duck, few, name):
    df = QUERIES[name](spark, few)
    result = duck.execute(oracles()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(plain(row[names.index(c)]) for c in order) for row in result.fetchall())
    rows = df.collect()
    assert rows and sorted(tuple(plain(row[c]) for c in order) for row in rows) == want
    assert len({(r.case_id, r.prompt) for r in rows}) > len({r.case_id for r in rows})


def test_keys_of_prompts(spark):
    prompts = spark.createDataFrame([("a#1", 2), ("a", 1), ("1#a", 2), (None, 3)], "case_id string, prompt int")
    back = pr.split_prompt_key(pr.key_by_prompt(prompts), prompts)
    assert sorted(map(tuple, back.where("case_id IS NOT NULL").collect())) == [("1#a", 2), ("a", 1), ("a#1", 2)]


def test_autozoom_of_two_prompts_is_that_of_each(spark):
    volume = np.zeros((12, 16, 16))
    volume[3:9, 3:13, 3:8] = 10.0
    volume[2:5, 10:14, 11:14] = 10.0
    lines = spark.createDataFrame([(7, z, y, volume[z, y].tolist()) for z in range(12) for y in range(16)], "case_id bigint, z int, y int, vals array<double>")
    rows = [(7, 1, 4.0, 8.0, 6.0, 6.0, 8.0, 6.0, 6, 12, 16, 16), (7, 4, 11.0, 12.0, 3.0, 13.0, 12.0, 3.0, 3, 12, 16, 16)]
    stats = spark.createDataFrame([(0.0, 10.0, 5.0, 5.0)], "clip_low double, clip_high double, mean double, std double")
    settings = az.Settings(crop_zyx=(6, 8, 8), threshold=0.5, max_passes=2, growth_zyx=(2.0, 2.0, 2.0), base_abs=0, base_min=0, base_rel=0.0, ref_patch_zyx=(6, 8, 8))
    mask, trace = az.autozoom_prompts(lines, spark.createDataFrame(rows, PROMPT), lambda c: 8.0 * c[0], stats, settings)
    got = {p: sorted((r.z, r.y, r.x) for r in mask.where(f"prompt = {p}").collect()) for p in (1, 4)}
    for row in rows:
        one, _ = az.autozoom(lines, spark.createDataFrame([row], PROMPT), lambda c: 8.0 * c[0], stats, settings)
        assert got[row[1]] == sorted((r.z, r.y, r.x) for r in one.collect()) != []
    assert got[1] != got[4] and {(r.case_id, r.prompt) for r in trace.collect()} == {(7, 1), (7, 4)}
