import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from voxtally.session import build_session

    session = build_session("local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def mask_of(spark):
    """Sparse table of labelled arrays, one per case."""
    import numpy as np

    def build(volumes: dict):
        rows = [(case, int(z), int(y), int(x), int(v[z, y, x])) for case, v in volumes.items() for z, y, x in zip(*np.nonzero(v))]
        return spark.createDataFrame(rows, "case_id bigint, z int, y int, x int, label int")

    return build


@pytest.fixture
def meta_of(spark):
    def build(shapes: dict, spacing_zyx=(1.0, 1.0, 1.0)):
        return spark.createDataFrame([(c, *s, *map(float, spacing_zyx)) for c, s in shapes.items()], "case_id bigint, nz int, ny int, nx int, sz double, sy double, sx double")

    return build
