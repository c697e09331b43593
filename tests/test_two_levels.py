"""Ranks, running sums and percentiles when one key or value holds nearly everything, and the stored cache."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.functions.prefix import with_rank
from voxtally.functions.text import run_ids
from voxtally.operators import normalize as nm
from voxtally.operators import runs as rn
from voxtally.session import shared_folder
from voxtally.sources import cache_store as cs


def test_ranks_of_one_hot_key_spread_over_tasks(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("if(id % 50 = 0, if(id % 100 = 0, 'b', null), 'hot') AS key", "pmod(xxhash64(id), 1000003) AS at", "id")
    got = with_rank(rows, ["key"], ["at", "id"], "rank").collect()
    assert len(got) == n and set(got[0].asDict()) == {"key", "at", "id", "rank"}
    for key in ("hot", "b", None):
        own = sorted((r.at, r.id, r.rank) for r in got if r.key == key)
        assert [r for _, _, r in own] == list(range(1, len(own) + 1))
    assert with_rank(rows.where("false"), ["key"], ["at", "id"], "rank").collect() == []


def test_run_ids_of_one_base_name(spark):
    runs = spark.range(3000).selectExpr("'s' AS stamp", "'m' AS model", "'x' AS suffix", "id AS ord")
    got = {r.ord: r.run_id for r in run_ids(runs).collect()}
    assert got == {k: "s_m_x" if k == 0 else f"s_m_x_{k + 1}" for k in range(3000)}


def test_running_means_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(rn, "STRETCH", 7)
    loss = [None if k % 11 == 0 or k < 25 else float(k % 13) for k in range(1003)]
    steps = spark.createDataFrame([(e, k + 1, v) for e in (None, 4) for k, v in enumerate(loss)], "epoch int, step int, loss double")
    got = {(r.epoch, r.step): r.loss_running for r in rn.running_means(steps, ["loss"], 10).collect()}
    assert set(got) == {(e, s) for e in (None, 4) for s in [*range(10, 1001, 10), 1003]}
    for (_, step), value in got.items():
        seen = [v for v in loss[:step] if v is not None]
        assert value is None if not seen else value == pytest.approx(sum(seen) / step)


@pytest.mark.parametrize("few", [0, 5, 100_000])
def test_percentiles_when_half_of_the_rows_are_one_value(spark, monkeypatch, few):
    monkeypatch.setattr(nm, "FEW", few)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=9000), np.full(10_000, 0.25), rng.normal(size=1000) * 1e200, [1e308, -1e308, 5e-324]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 100, "v double")
    shares = [0.0, 0.005, 0.2, 0.5, 0.77, 0.995, 1.0]
    got = {r.share: r.value for r in nm.exact_percentiles(df, "v", shares).collect()}
    ordered = np.sort(values)
    for share in shares:
        at = share * (len(values) - 1)
        a, b = float(ordered[int(np.floor(at))]), float(ordered[int(np.ceil(at))])
        assert got[share] == (a + (b - a) * (at - np.floor(at)) if at % 1 else a)
    assert nm.exact_percentiles(df.where("v IS NULL"), "v", shares).collect() == []
    one = nm.exact_percentiles(spark.createDataFrame([(7.5,)] * 30, "v double"), "v", [0.3]).collect()
    assert [(r.share, r.value) for r in one] == [(0.3, 7.5)]


def test_a_store_takes_only_what_is_missing(spark, tmp_path):
    path = cs.create_store(spark, f"{shared_folder(spark)}/store-{tmp_path.name}-{id(tmp_path)}")
    entries = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").alias("case_id"))
    assert cs.read_entries(spark, path, entries.schema, "key").collect() == []
    odd = entries.where("case_id < 300").unionByName(entries.where("case_id < 50")).unionByName(spark.createDataFrame([(None, 9)], entries.schema))
    assert cs.store_entries(odd, path, "key") == 300
    assert cs.store_entries(odd, path, "key") == 0
    # a run that died before its mark doesn't count, and is written again
    dead = entries.where("case_id >= 400").withColumns({"run": F.lit("dead"), "prefix": F.substring("key", 1, 2)})
    dead.write.mode("append").partitionBy("run", "prefix").parquet(f"{path}/entries")
    assert cs.read_entries(spark, path, entries.schema, "key").count() == 300
    cs.create_store(spark, path)
    assert cs.store_entries(entries, path, "key") == 200
    assert cs.read_entries(spark, path, entries.schema, "key").exceptAll(entries).isEmpty()
    assert {r.entries for r in cs.marks(spark, path).collect()} == {300, 200}
    some = entries.where("case_id IN (3, 450)").select("key").unionByName(spark.createDataFrame([("00nothing",), (None,)], "key string"))
    found = cs.lookup_entries(some, path, entries.schema, "key").collect()
    assert sorted((r.entry.case_id for r in found if r.entry), key=int) == [3, 450] and len(found) == 4
    plan = cs.read_entries(spark, path, entries.schema, "key", ["a0"])._jdf.queryExecution().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "run#" in filters and "prefix#" in filters
