"""Numpy helpers of the slice work against plain versions."""

import numpy as np
import pyarrow as pa
import pytest

from voxtally.functions import grids


@pytest.mark.parametrize("of", [grids.lower_envelope, grids.nearest_along])
def test_nearest_along_a_column_is_the_least_over_all_parabolas(of):
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(1, 12), rng.integers(1, 9)
        step = rng.choice([0.5, 1.0, 2.3], m)
        f = np.where(rng.random((n, m)) < 0.5, np.inf, rng.integers(0, 40, (n, m)) * 1.0)
        i = np.arange(n)
        want = (f[None] + ((i[:, None] - i[None])[..., None] * step) ** 2).min(1)
        np.testing.assert_allclose(of(f, step), want)


def test_long_columns_use_the_envelope_and_agree():
    f = np.where(np.random.default_rng(1).random((grids.SHORT_COLUMN + 30, 3)) < 0.9, np.inf, 0.0)
    assert np.allclose(grids.nearest_along(f, np.ones(3)), grids.lower_envelope(f, np.ones(3)))


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_groups_are_whole_whatever_the_batches(size):
    table = pa.table({"a": ["x"] * 4 + ["y"] * 7 + ["z"], "b": [1, 1, 2, 2] + [2] * 7 + [2]})
    seen = []
    for part in grids.whole_groups(table.to_batches(max_chunksize=size), ["a", "b"]):
        seen += [tuple(r.values()) for r in part.slice(0, 1).to_pylist()] if not seen or seen[-1] != tuple(part.slice(0, 1).to_pylist()[0].values()) else [None]
    assert None not in seen


def test_packed_numbers_come_back():
    column = pa.chunked_array([grids.packed(np.arange(6, dtype=np.int32), np.array([2, 0, 4])), pa.array([None, b""], pa.binary())])
    values, counts = grids.unpacked(column.slice(1), np.int32)
    assert values.tolist() == [2, 3, 4, 5] and counts.tolist() == [0, 4, 0, 0]
    assert list(grids.shares(np.array([3, 3, 9, 1]), 6)) == [(0, 2), (2, 3), (3, 4)]
