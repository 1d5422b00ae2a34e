"""The dashboard's tables, views and function under their SQL names."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame

from skywake.operators import activity, ghosts, runs as run_log

CONGESTION_FUNCTION = """
CREATE OR REPLACE TEMPORARY FUNCTION get_hourly_congestion() RETURNS TABLE (hour STRING, count BIGINT)
RETURN SELECT hour, count FROM hourly_congestion
"""


def views(live: DataFrame, runs: DataFrame, as_of: Column | datetime) -> dict[str, DataFrame]:
    """The views over one snapshot and one run log, at a fixed reference time. Nothing is computed yet."""
    return {
        "airline_activity": activity.airline_activity(live),
        "altitude_distribution": activity.altitude_distribution(live),
        "country_activity": activity.country_activity(live),
        "ghost_flights": ghosts.ghost_flights(live, as_of, runs),
        "dashboard_stats": activity.dashboard_stats(live, as_of, runs),
        "hourly_congestion": run_log.hourly_congestion(runs, as_of),
    }


def register_views(live: DataFrame, runs: DataFrame, anomalies: DataFrame, as_of: Column | datetime) -> None:
    """Make tables and views available to ``spark.sql``, with the congestion function."""
    tables = {"flights_live": live, "pipeline_runs": runs, "anomaly_hourly": anomalies}
    for name, frame in (tables | views(live, runs, as_of)).items():
        frame.createOrReplaceTempView(name)
    live.sparkSession.sql(CONGESTION_FUNCTION)
