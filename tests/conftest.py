from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from grainwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=8, shuffle_partitions=4, app="grainwise-tests")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    from fixture_tables import raw_tables

    return raw_tables(spark)


@pytest.fixture(scope="session")
def orders(spark, raw):
    from grainwise.plans.marts import build_fct_order

    return {r["order_id"]: r for r in build_fct_order(raw).collect()}


@pytest.fixture(scope="session")
def lines(spark, raw):
    from grainwise.plans.marts import build_fct_order_item

    return build_fct_order_item(raw).collect()
