from __future__ import annotations

import os
import sys

import pytest

TESTS = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [TESTS, os.path.dirname(TESTS)]
# Workers import the functions that tests define.
os.environ["PYTHONPATH"] = os.pathsep.join([TESTS, os.path.dirname(TESTS)])

from builders import IMAGE_COLUMNS, image_row  # noqa: E402

from shelfmark.registry import Registry  # noqa: E402
from shelfmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="4g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def registry(spark, tmp_path):
    return Registry(spark, str(tmp_path / "catalogue")).init()


@pytest.fixture
def three_images(spark):
    """Three images whose hashes are 64 times a, b and c."""
    data = [image_row(f"item-{i}.webp", digit) for i, digit in enumerate("abc", 1)]
    return spark.createDataFrame(data, IMAGE_COLUMNS)
