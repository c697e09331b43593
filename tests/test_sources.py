import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.sources import cache as ca
from voxtally.sources import files as fl
from voxtally.sources import volumes as vo


def test_manifest_scan(spark, tmp_path):
    folder = tmp_path / "data" / "x" / "prepared"
    folder.mkdir(parents=True)
    base = {"spacing_xyz": [1, 1, 2.4], "recist_endpoints_xyz": [[1, 2, 3], [4, 5, 3]], "recist_slice_index": 3, "split": "train", "source": "s"}
    records = [
        base | {"case_id": "a", "image_path": "images/a.npz", "label_path": "", "target_label_value": "", "target_voxel_count": 12},
        base | {"case_id": "b", "image_path": "/abs/b.npz", "label_path": "labels/b.nii.gz", "prompt_source": "drawn", "target_label_value": 2, "target_component_id": 1},
    ]
    (folder / "manifest.json").write_text(json.dumps({"records": records}, indent=1))
    a, b = fl.scan_manifest(spark, str(folder / "manifest.json")).orderBy("ord").collect()
    root = str(tmp_path / "data")
    assert (a.image_path, a.label_path, a.target_label_value, a.target_voxel_count, a.prompt_source) == (f"{root}/images/a.npz", None, None, 12, "recist")
    assert (b.image_path, b.label_path, b.target_label_value, b.target_component_id, b.prompt_source) == ("/abs/b.npz", f"{root}/labels/b.nii.gz", 2, 1, "drawn")


def test_class_map(spark, tmp_path):
    good = {"version": "v1", "ignore_index": -1, "classes": {"0": {"name": "background"}, "1": {"name": "lesion", "segmentation": "lesion_file"}, "2": "liver"}}
    path = tmp_path / "map.json"
    path.write_text(json.dumps(good))
    rows = {r.class_id: (r.name, r.segmentation) for r in fl.scan_class_map(spark, str(path)).collect()}
    assert rows == {0: ("background", None), 1: ("lesion", "lesion_file"), 2: ("liver", "liver")}
    assert fl.class_map_metadata(fl.scan_class_map(spark, str(path))).first().num_aux_classes == 3
    for broken in ({"0": "background", "2": "x"}, {"0": "background", "1": "background"}, {"0": "air", "1": "x"}):
        bad = tmp_path / f"bad{len(str(broken))}.json"
        bad.write_text(json.dumps(good | {"classes": broken}))
        with pytest.raises(ValueError):
            fl.scan_class_map(spark, str(bad))


def test_archives_in_and_predictions_out(spark, tmp_path):
    rng = np.random.default_rng(4)
    source, store, out = tmp_path / "in", tmp_path / "store", tmp_path / "out"
    source.mkdir(), out.mkdir()
    volumes = {}
    for name in ("p", "q"):
        image, mask = rng.normal(size=(3, 4, 5)).astype(np.float32), rng.integers(0, 3, (3, 4, 5))
        marker = np.zeros((3, 4, 5), np.uint8)
        marker[1, 2, 1:4] = 1
        volumes[name] = (image, mask)
        np.savez(source / f"{name}.npz", img=image, gts=mask, spacing=np.array([0.5, 0.75, 2.0]), recist=marker, origin=np.array([1.0, 2.0, 3.0]))
    assert [r.path.rsplit("/", 1)[-1] for r in fl.discover_inputs(spark, str(source)).collect()] == ["p.npz", "q.npz"]
    vo.store_volumes(vo.scan_npz(spark, str(source)), str(store))
    lines, runs, meta = vo.read_lines(spark, str(store)), vo.read_runs(spark, str(store)), vo.read_meta(spark, str(store))
    for r in lines.collect():
        assert np.allclose(volumes[r.case_id][0][r.z, r.y], r.vals)
    assert vo.read_runs(spark, str(store), "marker").count() == 2
    row = meta.where("case_id = 'p'").first()
    assert (row.nz, row.ny, row.nx, row.sz, row.sy, row.sx, row.origin) == (3, 4, 5, 2.0, 0.75, 0.5, [1.0, 2.0, 3.0])
    paths = {r.path for r in vo.export_predictions(runs, meta, str(out)).collect()}
    assert len(paths) == 4
    for name, (_, mask) in volumes.items():
        with np.load(out / f"{name}_prediction.npz") as data:
            assert np.array_equal(data["prediction"], mask) and data["spacing"].tolist() == [0.5, 0.75, 2.0]
    back = vo.scan_nifti(spark, str(out), "mask")
    heads = {r.case_id: r for r in back.where("kind = 'meta'").collect()}
    assert heads["p"].spacing_xyz == [0.5, 0.75, 2.0] and heads["p"].origin == [1.0, 2.0, 3.0] and heads["p"].direction == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    columns = ["case_id", "label", "z", "y", "x0", "x1"]
    assert back.where("kind = 'mask'").select(columns).exceptAll(runs.select(columns)).isEmpty()


def test_discovery_prefers_public_folder_and_fails_when_empty(spark, tmp_path):
    (tmp_path / "validation_public_npz").mkdir()
    for name in ("b.npz", "validation_public_npz/a.npz", "validation_public_npz/c.npz"):
        np.savez(tmp_path / name, image=np.zeros((1, 1, 1)))
    assert [r.path.rsplit("/", 1)[-1] for r in fl.discover_inputs(spark, str(tmp_path), 1).collect()] == ["a.npz"]
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        fl.discover_inputs(spark, str(empty))


def test_report_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "report")
    assert fl.materialize_report(spark.range(3), path).count() == 3
    assert fl.materialize_report(spark.range(9), path).count() == 3


def test_cache_falls_back_to_case_id(spark):
    sources = spark.createDataFrame([("s1", ca.SOURCE_VERSION)], "source_key string, cache_version string")
    targets = spark.createDataFrame(
        [("t1", "s1", ca.TARGET_VERSION, "case_1_0123456789abcdef.npz", "case_1", 1, 1, 8)],
        "target_key string, source_key string, cache_version string, file_name string, case_id string, label int, component_id int, voxel_count bigint")
    schema = "ord int, case_id string, target_key string, source_key string, target_label_value int, target_component_id int"
    records = spark.createDataFrame([(0, "case_1", "t1", "s1", 1, 1), (1, "case_1", "moved", "moved", 1, 1), (2, "case_1", "moved", "moved", 2, 1), (3, "other", "x", "x", None, None)], schema)
    got = {r.ord: (r.entry_key, r.used_fallback) for r in ca.cache_lookup(records, sources, targets).collect()}
    assert got == {0: ("t1", False), 1: ("t1", True), 2: (None, None), 3: (None, None)}


def test_cache_key_follows_the_file(spark):
    schema = """ord int, case_id string, source string, image_path string, label_path string, spacing_xyz array<double>, prompt_source string, recist_endpoints_xyz array<array<double>>,
      recist_slice_index int, target_label_value int, target_component_id int"""
    row = (0, "a", "s", "/a.npz", None, [1.0, 1.0, 1.0], "recist", [[0.0, 0.0, 0.0], [1.0, 1.0, 0.0]], 0, None, None)
    records = spark.createDataFrame([row], schema)

    def keys(size):
        files = spark.createDataFrame([("/a.npz", size, 5)], "path string, size bigint, mtime_us bigint")
        r = ca.with_cache_keys(records, files, (1.0, 1.0, 2.4), "anisotropic").first()
        return r.source_key, r.target_key

    assert keys(10) == keys(10) and keys(10)[0] != keys(11)[0] and keys(10)[1] != keys(11)[1]
    plan = ca.cache_plan(spark.createDataFrame([("t", "s", 4)], "target_key string, source_key string, voxel_count int"),
                         spark.createDataFrame([], "source_key string, cache_version string"),
                         spark.createDataFrame([], "target_key string, source_key string, cache_version string"))
    assert plan.select(F.col("status")).first()[0] == "written"
