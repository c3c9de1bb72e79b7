"""Every named query against its SQL oracle."""

import pytest

from __spark_entry__ import entry
from compare import compare, duck
from lotwatch.plans.star_oracles import ORACLES
from lotwatch.plans.star_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_an_oracle():
    # An approximate search may miss rows; its recall is measured in test_vectors.py.
    assert set(QUERIES) - {"vector_knn_approx"} == set(ORACLES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name) == ""


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0
