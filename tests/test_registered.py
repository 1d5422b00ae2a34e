"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest

import compare
from skywake.plans.oracles import ORACLES
from skywake.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Windows without a partition are allowed on results of bounded size only.
SMALL_WINDOWS = {
    "activity_clock", "airline_bars", "airline_race", "band_shares", "congestion_bars", "country_share",
    "country_speed", "density_levels", "recent_runs", "region_scores", "run_metrics", "purge_runs",
    "systematic_sample", "zoom_sample", "page_of", "live_feed", "live_feed_by_runs",
}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql_by_a_plan_that_scales(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "simple")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan
    # A window prints its partition keys and its order as two lists; one list only means no partition.
    alone = re.search(r"\+- Window \[[^\n]*?\)\) AS [\w.#]+L?\](?:, \[[^\]]*\])?\n", plan)
    assert alone is None or name in SMALL_WINDOWS
    assert compare.compare(con, frame, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as registered

    rows = registered.entry(spark).collect()
    assert [row.band for row in rows] == ["Ground", "Low", "Climbing", "Cruise", "High Alt"]
    assert sum(row.flight_count for row in rows) > 100


def test_derived_data_has_the_documented_sizes(spark):
    from skywake.plans.inputs import Inputs

    inputs = Inputs(spark, SF_DIR)
    assert (inputs.states.count(), inputs.history.count(), inputs.live.count()) == (1000, 963, 120)
    assert inputs.anomalies.count() == 531
    assert {row["status"]: row["count"] for row in inputs.runs.groupBy("status").count().collect()} == {
        "success": 658,
        "error": 62,
    }
