import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.functions import geometry as geo
from voxtally.operators import crops as cr
from voxtally.operators import normalize as nm
from voxtally.operators import resample as rs
from voxtally.plans import autozoom as az


@pytest.fixture
def lines_of(spark):
    def build(volumes):
        rows = [(c, z, y, [float(v) for v in volume[z, y]]) for c, volume in volumes.items() for z in range(volume.shape[0]) for y in range(volume.shape[1])]
        return spark.createDataFrame(rows, "case_id bigint, z int, y int, vals array<double>")

    return build


def dense(lines, shape):
    out = np.full(shape, np.nan)
    for r in lines.collect():
        out[r.z, r.y, :] = r.vals
    return out


def linear(volume, shape):
    """Axis by axis, output o reads position o*(n-1)/(m-1)."""
    for axis, m in enumerate(shape):
        n = volume.shape[axis]
        at = np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0)
        low = np.minimum(np.floor(at).astype(int), n - 1)
        high = np.minimum(low + 1, n - 1)
        part = (at - low).reshape([-1 if i == axis else 1 for i in range(3)])
        volume = np.take(volume, low, axis) * (1 - part) + np.take(volume, high, axis) * part
    return volume


def test_adaptive_zoom_step(spark):
    row = spark.range(1).select(*[
        geo.next_zoom(F.lit(1.0), F.lit(True), g, m, F.lit(c), F.lit(0.001), "adaptive").alias(a)
        for a, g, m, c in (("z", 1.25, 4.0, 1.05), ("y", 1.15, 2.0, 1.03), ("x", 1.15, 2.0, 1.03))
    ]).first()
    assert list(row) == pytest.approx([1.05, 1.03, 1.03])


@pytest.mark.parametrize("shape", [(3, 6, 5), (1, 4, 9), (7, 2, 1)])
def test_resize_matches_separable_linear(lines_of, meta_of, shape):
    volume = np.random.default_rng(0).random((4, 5, 6))
    out = rs.resample_lines(lines_of({0: volume}), rs.shape_plan(meta_of({0: volume.shape}), shape))
    assert np.allclose(dense(out, shape), linear(volume, shape))


def test_equal_spacing_is_identity(lines_of, meta_of, mask_of):
    volume = np.random.default_rng(1).random((3, 4, 5))
    plan = rs.spacing_plan(meta_of({0: volume.shape}, (2.4, 1.0, 1.0)), (1.0, 1.0, 2.4), "anisotropic")
    assert np.array_equal(dense(rs.resample_lines(lines_of({0: volume}), plan), volume.shape), volume)
    mask = mask_of({0: (volume > 0.5).astype(int)})
    assert rs.resample_mask(mask, plan).exceptAll(mask).isEmpty()


def test_small_target_survives_shrinking(mask_of, meta_of):
    volume = np.zeros((9, 9, 9), int)
    volume[4, 3, 5] = 1
    plan = rs.shape_plan(meta_of({0: volume.shape}), (2, 2, 2))
    assert rs.resize_keep_target(mask_of({0: volume}), plan).count() >= 1


def test_percentiles_are_exact(spark):
    values = np.random.default_rng(2).normal(size=20001)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.share: r.value for r in nm.exact_percentiles(df, "v", [0.005, 0.5, 0.995]).collect()}
    assert [got[s] for s in (0.005, 0.5, 0.995)] == pytest.approx(np.percentile(values, [0.5, 50, 99.5]).tolist(), abs=1e-12)


def test_percentiles_when_a_third_of_rows_are_one_value(spark):
    values = np.concatenate([np.random.default_rng(2).normal(size=6000), np.zeros(3000)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.share: r.value for r in nm.exact_percentiles(df, "v", [0.005, 0.995]).collect()}
    assert [got[0.005], got[0.995]] == pytest.approx(np.percentile(values, [0.5, 99.5]).tolist(), abs=1e-12)


def test_crop_pad_restore(lines_of, meta_of, mask_of, spark):
    volume = np.arange(60.0).reshape(3, 4, 5) + 1
    prompt = spark.createDataFrame([(0, 4.0, 1.0, 0.0, 4.0, 3.0, 0.0, 0, 3, 4, 5)], "case_id bigint, ax double, ay double, az double, bx double, by double, bz double, slice int, nz int, ny int, nx int")
    windows = geo.crop_window(prompt, (2, 2, 8))
    out = cr.pad_lines(cr.crop_lines(lines_of({0: volume}), windows), cr.crop_endpoints(windows), (2, 2, 8))
    want = np.zeros((2, 2, 8))
    want[:, :, :5] = volume[0:2, 1:3, :]
    assert np.array_equal(dense(out, (2, 2, 8)), want)
    mask = mask_of({0: (volume > 20).astype(int)})
    back = cr.restore_crop(cr.crop_mask(mask, windows), windows)
    assert back.count() == int((volume[0:2, 1:3, :] > 20).sum()) and back.exceptAll(mask).isEmpty()


def test_autozoom_grows_until_the_object_fits(lines_of, spark):
    volume = np.zeros((12, 16, 16))
    volume[3:9, 3:13, 3:13] = 10.0
    prompt = spark.createDataFrame([(0, 6.0, 8.0, 6.0, 9.0, 8.0, 6.0, 6, 12, 16, 16)], "case_id bigint, ax double, ay double, az double, bx double, by double, bz double, slice int, nz int, ny int, nx int")
    stats = spark.createDataFrame([(0.0, 10.0, 5.0, 5.0)], "clip_low double, clip_high double, mean double, std double")
    settings = az.Settings(crop_zyx=(6, 8, 8), threshold=0.5, max_passes=4, growth_zyx=(2.0, 2.0, 2.0), base_abs=0, base_min=0, base_rel=0.0, ref_patch_zyx=(6, 8, 8))
    mask, trace = az.autozoom(lines_of({0: volume}), prompt, lambda c: 8.0 * c[0], stats, settings)
    passes = trace.orderBy("pass_index").collect()
    assert passes[0].predicted_voxels == 6 * 8 * 8 and passes[0].continues and all(passes[0][f"trigger_{a}"] for a in "zyx")
    assert not passes[-1].continues and (passes[-1].w_z1, passes[-1].w_y1, passes[-1].w_x1) == (12, 16, 16)
    got = np.zeros(volume.shape, bool)
    for r in mask.collect():
        got[r.z, r.y, r.x] = True
    # the last pass sees the whole frame at half resolution: its mask lies inside the object
    assert got.sum() == passes[-1].predicted_voxels and got.any() and not got[volume == 0].any()
