"""DuckDB SQL for every registered query, written apart from the Spark code."""

from __future__ import annotations

from skywake.constants import EMPTY_FETCH_MESSAGE

LIVE = (
    "icao24, callsign, origin_country, lon, lat, baro_altitude, geo_altitude, on_ground, "
    "velocity, true_track, vertical_rate, ingested_at"
)
STATE = LIVE.removesuffix(", ingested_at")
AS_OF = "(SELECT as_of FROM fx_now)"
BEFORE = "(SELECT as_of - INTERVAL 180 SECOND FROM fx_now)"
FEET = "geo_altitude * 3.28084e0"
KNOTS = "velocity * 1.94384e0"
MOVING = "velocity IS NOT NULL AND velocity <> 0 AND geo_altitude IS NOT NULL AND geo_altitude <> 0"

# Named parts, each with the parts it reads.
PARTS: dict[str, tuple[list[str], str]] = {
    "fx_now": ([], "SELECT max(epoch_us(ts)) AS now_us, max(ts) AS as_of FROM events"),
    "fx_states": (
        ["fx_now"],
        """
SELECT event_id, ts_us, lower(to_hex(1048576 + aid)) AS icao24,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 53 = 0 THEN ''
       ELSE concat(list_extract(['EK','UAE','RYR','FR','AAL','AA','DAL','DL','UAL','UA','DLH','LH','IGO','IN','BAW','BA',
         'AFR','AF','QTR','QR','SIA','SQ','THY','TK','SVA','SV','AIC','AI','ZZZ','NKS','uae'], (aid % 31) + 1),
         CAST(aid AS VARCHAR)) END AS callsign,
  CASE WHEN aid % 41 = 0 THEN NULL ELSE concat('NATION_', CAST(aid % 25 AS VARCHAR)) END AS origin_country,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 59 = 0 THEN 180e0
       ELSE CAST((aid*7919 + event_id*104729) % 3600001 AS DOUBLE) / 1e4 - 180e0 END AS lon,
  CASE WHEN event_id % 23 = 0 THEN NULL
       ELSE CAST((aid*6007 + event_id*15485863) % 1800001 AS DOUBLE) / 1e4 - 90e0 END AS lat,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id*31 + aid*17) % 14900 AS DOUBLE) END AS baro_altitude,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST((event_id*31 + aid*17) % 15000 AS DOUBLE) - 100e0 END AS geo_altitude,
  (event_id % 7 = 0) AS on_ground,
  CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 0e0
       ELSE CAST((event_id*13 + aid*11) % 400 AS DOUBLE) END AS velocity,
  CAST((event_id*37) % 360 AS DOUBLE) AS true_track,
  CAST(event_id % 41 AS DOUBLE) - 20e0 AS vertical_rate,
  make_timestamp(now_us - ((now_us - ts_us) // 720)) AS ingested_at
FROM (SELECT event_id, epoch_us(ts) AS ts_us, user_id*8 + event_id % 8 AS aid FROM events) a CROSS JOIN fx_now""",
    ),
    "fx_history": (
        ["fx_states"],
        "SELECT * FROM fx_states WHERE on_ground OR (lat IS NOT NULL AND lon IS NOT NULL)",
    ),
    "fx_live": (
        ["fx_history"],
        f"""
SELECT {LIVE} FROM (
  SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY ts_us DESC, event_id DESC) AS rn FROM fx_history) r
WHERE rn = 1""",
    ),
    "fx_live_before": (
        ["fx_history"],
        f"""
SELECT {LIVE} FROM (
  SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY ts_us DESC, event_id DESC) AS rn
  FROM fx_history WHERE ingested_at <= {BEFORE}) r
WHERE rn = 1""",
    ),
    "fx_cycles": (
        ["fx_live", "fx_live_before"],
        f"SELECT {AS_OF} AS cycle, * FROM fx_live UNION ALL SELECT {BEFORE} AS cycle, * FROM fx_live_before",
    ),
    "fx_runs": (
        ["fx_states"],
        """
SELECT row_number() OVER (ORDER BY b) AS id,
  make_timestamp(CASE WHEN (b+1)*1800000000 > now_us THEN now_us ELSE (b+1)*1800000000 END) AS run_at,
  CAST(n AS INT) AS records_fetched,
  CASE WHEN b % 23 = 0 THEN NULL ELSE CAST(u AS INT) END AS records_upserted,
  CAST(200 + (b*37) % 900 AS INT) AS fetch_ms,
  CASE WHEN b % 5 = 0 THEN NULL ELSE CAST(50 + (b*53) % 700 AS INT) END AS upsert_ms,
  CASE WHEN b % 11 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN b % 11 = 0 THEN 'synthetic' END AS error_msg
FROM (SELECT ts_us // 1800000000 AS b, count(*) AS n, count(DISTINCT icao24) AS u FROM fx_states GROUP BY 1) g
CROSS JOIN fx_now""",
    ),
    "fx_anomaly": (
        ["fx_states"],
        """
SELECT make_timestamp(h*3600000000) AS hour_utc,
  CAST(count(CASE WHEN NOT on_ground AND event_id % 5 = 0 THEN 1 END) AS INT) AS ghost_count,
  CAST(count(CASE WHEN NOT on_ground AND geo_altitude*3.28084e0 < 3000 AND geo_altitude*3.28084e0 > 0 THEN 1 END) AS INT)
    AS low_alt_count,
  make_timestamp(h*3600000000) AS updated_at
FROM (SELECT *, ts_us // 3600000000 AS h FROM fx_states) t GROUP BY h""",
    ),
    "fx_points": (
        [],
        """
SELECT c_custkey AS point_id,
  CAST((c_custkey*104729) % 3600000 AS DOUBLE) / 1e4 - 180e0 AS lon,
  CAST((c_custkey*15485863) % 1600000 AS DOUBLE) / 1e4 - 80e0 AS lat
FROM customer""",
    ),
    "fx_regions": (
        [],
        """
SELECT region, south, west, CASE WHEN region % 97 <> 0 THEN south + height END AS north, west + width AS east FROM (
  SELECT o_orderkey AS region, CAST((o_orderkey * 7919) % 1800000 AS DOUBLE) / 1e4 - 90e0 AS south,
    CAST((o_orderkey * 104729) % 3600000 AS DOUBLE) / 1e4 - 180e0 AS west,
    CASE WHEN o_orderkey % 61 = 0 THEN 60e0 WHEN o_orderkey % 7 = 0 THEN 6e0 ELSE CAST(o_orderkey % 13 AS DOUBLE) / 4e0 END AS height,
    CASE WHEN o_orderkey % 67 = 0 THEN 150e0 WHEN o_orderkey % 89 = 0 THEN -1e0 ELSE CAST(o_orderkey % 17 AS DOUBLE) / 3e0 END AS width
  FROM orders) o""",
    ),
    "in_regions": (
        ["flying", "fx_regions"],
        """
SELECT region, icao24 FROM flying f JOIN fx_regions r
  ON f.lat >= r.south AND f.lat <= r.north AND f.lon >= r.west AND f.lon <= r.east""",
    ),
    "threshold": (
        ["fx_runs"],
        "SELECT max(run_at) - INTERVAL 30 SECOND AS threshold FROM fx_runs WHERE status = 'success'",
    ),
    "ghosts": (
        ["fx_live", "threshold"],
        f"""
SELECT icao24, callsign, origin_country, lat, lon, round({FEET}) AS altitude_ft, true_track, ingested_at,
  CAST(epoch_us({AS_OF}) - epoch_us(ingested_at) AS DOUBLE) / 1e6 / 60e0 AS minutes_since_contact
FROM fx_live WHERE NOT on_ground AND ingested_at < (SELECT threshold FROM threshold)""",
    ),
    "recent": (["ghosts"], "SELECT * FROM ghosts WHERE minutes_since_contact <= 15"),
    "health": (
        ["fx_live"],
        f"""
SELECT seconds_since_sync, coalesce(seconds_since_sync, 0) > 3600 AS pipeline_down FROM (
  SELECT CAST(round(CAST(epoch_us({AS_OF}) - epoch_us(max(ingested_at)) AS DOUBLE) / 1e6) AS INT) AS seconds_since_sync
  FROM fx_live) h""",
    ),
    "enriched": (
        ["recent", "health", "fx_live"],
        """
SELECT g.*, f.baro_altitude, f.geo_altitude, f.on_ground, f.velocity, f.vertical_rate
FROM recent g LEFT JOIN (SELECT * FROM fx_live WHERE lat IS NOT NULL AND lon IS NOT NULL) f ON g.icao24 = f.icao24
WHERE g.icao24 <> '' AND NOT (SELECT pipeline_down FROM health)""",
    ),
    "hours": (
        ["fx_runs"],
        f"""
SELECT s.hs, strftime(s.hs, '%H:%M') AS hour, coalesce(a.cnt, 0) AS count
FROM (SELECT unnest(generate_series(date_trunc('hour', {AS_OF} - INTERVAL 23 HOUR), date_trunc('hour', {AS_OF}),
        INTERVAL 1 HOUR)) AS hs) s
LEFT JOIN (
  SELECT CAST(date_trunc('hour', run_at) AS TIMESTAMP) AS hs, CAST(round(avg(records_upserted)) AS BIGINT) AS cnt
  FROM fx_runs WHERE run_at >= {AS_OF} - INTERVAL 24 HOUR AND status = 'success' GROUP BY 1) a ON s.hs = a.hs""",
    ),
    "peaks": (
        ["hours"],
        """
SELECT period, hour, count FROM (
  SELECT *, row_number() OVER (PARTITION BY period ORDER BY count DESC, hs) AS rn FROM (
    SELECT *, CASE WHEN hour(hs) BETWEEN 4 AND 11 THEN 'morning' WHEN hour(hs) >= 18 OR hour(hs) <= 3 THEN 'night' END
      AS period FROM hours) p
  WHERE period IS NOT NULL AND count > 0) r WHERE rn = 1""",
    ),
    "anomaly_window": (
        ["fx_anomaly", "fx_now"],
        f"SELECT hour_utc, ghost_count, low_alt_count FROM fx_anomaly WHERE hour_utc >= {AS_OF} - INTERVAL 24 HOUR",
    ),
    "timeline": (
        ["anomaly_window"],
        """
SELECT printf('%02d:00', CAST(d.h AS INT)) AS hour, coalesce(g, 0) AS ghost, coalesce(l, 0) AS low_alt,
  coalesce(g, 0) + coalesce(l, 0) AS total
FROM (SELECT unnest(generate_series(0, 23)) AS h) d
LEFT JOIN (
  SELECT hour(hour_utc) AS h, arg_max(ghost_count, hour_utc) AS g, arg_max(low_alt_count, hour_utc) AS l
  FROM anomaly_window GROUP BY 1) a ON a.h = d.h""",
    ),
    "airlines": (
        ["fx_live"],
        """
SELECT airline, count(*) AS flight_count FROM (
  SELECT @airline AS airline FROM fx_live WHERE callsign IS NOT NULL AND NOT on_ground) a GROUP BY 1""",
    ),
    "first_ten": (["airlines"], "SELECT * FROM airlines ORDER BY flight_count DESC, airline LIMIT 10"),
    "bands": (["fx_live"], "SELECT @band AS band, count(*) AS flight_count FROM fx_live GROUP BY 1"),
    "band_spine": (
        ["bands"],
        """
SELECT o.ord, o.band, coalesce(b.flight_count, 0) AS flight_count
FROM (VALUES (0, 'Ground'), (1, 'Low'), (2, 'Climbing'), (3, 'Cruise'), (4, 'High Alt')) o(ord, band)
LEFT JOIN bands b ON b.band = o.band""",
    ),
    "countries": (
        ["fx_live"],
        """
SELECT origin_country, count(*) AS flights_now FROM fx_live
WHERE NOT on_ground AND origin_country IS NOT NULL GROUP BY 1 ORDER BY flights_now DESC, origin_country LIMIT 20""",
    ),
    "flying": (["fx_live"], "SELECT * FROM fx_live WHERE NOT on_ground AND lat IS NOT NULL AND lon IS NOT NULL"),
    # Place, name, south, north, west and east of each region.
    "map_regions": (
        [],
        """
SELECT * FROM (VALUES (0, 'North America', 15, 72, -170, -52), (1, 'Europe', 34, 72, -25, 45),
  (2, 'Asia Pacific', -10, 70, 60, 180), (3, 'Middle East', 12, 42, 35, 65), (4, 'South America', -60, 15, -82, -34),
  (5, 'Africa', -35, 38, -20, 52), (6, 'Oceania', -50, -10, 110, 180)) r(ord, region, s, n, w, e)""",
    ),
    "score_regions": (
        [],
        """
SELECT * FROM (VALUES (0, 'N.America', 15, 72, -170, -52), (1, 'Europe', 34, 72, -25, 45),
  (2, 'Asia-Pac', -10, 70, 60, 180), (3, 'Mid-East', 12, 42, 35, 65), (4, 'S.America', -60, 15, -82, -34),
  (5, 'Africa', -35, 38, -20, 52), (6, 'Oceania', -50, -10, 110, 180), (7, 'Russia-CIS', 50, 80, 30, 180))
  r(ord, region, s, n, w, e)""",
    ),
    "density": (
        ["fx_live"],
        """
SELECT d.bin, coalesce(c.n, 0) AS flight_count FROM (SELECT unnest(generate_series(0, 71)) AS bin) d
LEFT JOIN (
  SELECT CAST(floor((lon + 180e0) / 360e0 * 72) AS BIGINT) AS bin, count(*) AS n FROM fx_live
  WHERE NOT on_ground AND lon IS NOT NULL GROUP BY 1) c ON c.bin = d.bin""",
    ),
    "placed_live": (["fx_live"], "SELECT * FROM fx_live WHERE lat IS NOT NULL AND lon IS NOT NULL"),
    "placed_history": (["fx_history"], "SELECT * FROM fx_history WHERE lat IS NOT NULL AND lon IS NOT NULL"),
    "age_ghosts": (
        ["fx_cycles"],
        """
SELECT *, CAST(epoch_us(cycle) - epoch_us(ingested_at) AS DOUBLE) / 1e6 / 60e0 AS minutes_since_contact
FROM fx_cycles WHERE NOT on_ground AND ingested_at < cycle - INTERVAL 2 MINUTE""",
    ),
    # The live table at cycles that are not equally far apart, and its ghosts by either rule.
    "fx_uneven": (
        ["fx_history"],
        f"""
SELECT cycle, {LIVE} FROM (
  SELECT c.cycle, h.*, row_number() OVER (PARTITION BY c.cycle, icao24 ORDER BY ts_us DESC, event_id DESC) AS place
  FROM (SELECT CAST({AS_OF} - INTERVAL 490 SECOND AS TIMESTAMP) AS cycle UNION ALL
    SELECT CAST({AS_OF} - INTERVAL 183 SECOND AS TIMESTAMP) UNION ALL SELECT CAST({AS_OF} AS TIMESTAMP)) c
  JOIN fx_history h ON h.ingested_at <= c.cycle) p WHERE place = 1""",
    ),
    "uneven_recent": (
        ["fx_uneven"],
        "SELECT * FROM fx_uneven WHERE NOT on_ground AND ingested_at < cycle - INTERVAL 2 MINUTE AND ingested_at >= cycle - INTERVAL 15 MINUTE",
    ),
    "uneven_unseen": (
        ["fx_uneven", "fx_runs"],
        """
SELECT * FROM fx_uneven u WHERE NOT on_ground AND ingested_at >= cycle - INTERVAL 15 MINUTE
  AND ingested_at < (SELECT max(run_at) FROM fx_runs r WHERE r.status = 'success' AND r.run_at <= u.cycle) - INTERVAL 30 SECOND""",
    ),
    # Snapshot documents of the streaming queries: latest vector per 180-second cycle and aircraft.
    "wire_all": (
        ["fx_states"],
        """
SELECT *, (on_ground OR (lat IS NOT NULL AND lon IS NOT NULL))
    AND event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 97 <> 0 AS good FROM (
  SELECT *, row_number() OVER (PARTITION BY time, icao24 ORDER BY ts_us DESC, event_id DESC) AS rn FROM (
    SELECT s.*, (now_us - (((now_us - ts_us) // 120) // 180000000) * 180000000) // 1000000 AS time
    FROM fx_states s CROSS JOIN fx_now) t) r
WHERE rn = 1""",
    ),
    "wire": (["wire_all"], "SELECT * FROM wire_all WHERE good"),
    # A row per snapshot, with the last success up to it, and what each one sees of the aircraft.
    "wire_cycles": (
        ["wire_all"],
        """
SELECT time, n, row_number() OVER (ORDER BY time) AS k, max(CASE WHEN n > 0 THEN time END) OVER (ORDER BY time) AS success
FROM (SELECT time, count(*) FILTER (good) AS n FROM wire_all GROUP BY time) g""",
    ),
    "wire_seen": (
        ["wire", "wire_cycles"],
        """
SELECT * FROM (
  SELECT c.time AS t, c.n, c.k, c.success, w.*, row_number() OVER (PARTITION BY c.time, icao24 ORDER BY w.time DESC) AS place
  FROM wire_cycles c JOIN wire w ON w.time <= c.time AND w.time >= c.time - 1800) s WHERE place = 1""",
    ),
    "wire_ghosts": (
        ["wire_seen"],
        "SELECT * FROM wire_seen WHERE NOT on_ground AND time < success - 30 AND t - time <= 900",
    ),
    "wire_now": (["wire"], "SELECT make_timestamp(max(time) * 1000000) AS as_of FROM wire"),
    "wire_live": (
        ["wire", "wire_now"],
        f"""
SELECT {LIVE} FROM (
  SELECT {STATE}, make_timestamp(time * 1000000) AS ingested_at,
    row_number() OVER (PARTITION BY icao24 ORDER BY time DESC) AS latest FROM wire) r
WHERE latest = 1 AND ingested_at >= (SELECT as_of - INTERVAL 30 MINUTE FROM wire_now)""",
    ),
}

PARTS |= {f"wire_{name}": (["wire_live"], PARTS[name][1].replace("fx_live", "wire_live")) for name in ("airlines", "bands", "countries")}

# Airline and its callsign prefixes, first match wins.
AIRLINES = [
    ("Emirates", "EK", "UAE"),
    ("Ryanair", "RYR", "FR"),
    ("American", "AAL", "AA"),
    ("Delta", "DAL", "DL"),
    ("United", "UAL", "UA"),
    ("Lufthansa", "DLH", "LH"),
    ("IndiGo", "IGO", "IN"),
    ("British Airways", "BAW", "BA"),
    ("Air France", "AFR", "AF"),
    ("Qatar Airways", "QTR", "QR"),
    ("Singapore Air", "SIA", "SQ"),
    ("Turkish Airlines", "THY", "TK"),
    ("Saudia", "SVA", "SV"),
    ("Air India", "AIC", "AI"),
]


def _airline(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN callsign LIKE '{p}%' THEN '{n}'" for p, n in rules) + " ELSE 'Other' END"


_RULES = [(prefix, name) for name, *prefixes in AIRLINES for prefix in prefixes]
MACROS = {
    "@airline_longest": _airline(sorted(_RULES, key=lambda rule: -len(rule[0]))),
    "@airline": _airline(_RULES),
    "@band": f"""CASE WHEN on_ground OR geo_altitude IS NULL THEN 'Ground' WHEN {FEET} < 3000 THEN 'Low'
  WHEN {FEET} < 15000 THEN 'Climbing' WHEN {FEET} < 45000 THEN 'Cruise' ELSE 'High Alt' END""",
    "@band3": f"CASE WHEN {FEET} < 3000 THEN 'low' WHEN {FEET} < 15000 THEN 'climbing' ELSE 'cruise' END",
    "@band5": f"""CASE WHEN {FEET} < 1000 THEN 'ground' WHEN {FEET} < 10000 THEN 'low'
  WHEN {FEET} < 25000 THEN 'climbing' WHEN {FEET} < 40000 THEN 'cruise' ELSE 'high' END""",
    "@alt_text": f"""CASE WHEN geo_altitude IS NOT NULL AND geo_altitude <> 0
  THEN format('{{:,}}', CAST(floor({FEET} + 0.5e0) AS BIGINT)) || ' ft' END""",
    "@who": "coalesce(nullif(callsign, ''), icao24)",
}


def sql(body: str, *parts: str) -> str:
    """The body behind the named parts it reads, in order of use."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in PARTS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for part in ("fx_now", *parts):
        add(part)
    text = "WITH " + ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in ordered) + "\n" + body.strip()
    for macro in sorted(MACROS, key=len, reverse=True):
        text = text.replace(macro, MACROS[macro])
    return text


def _sample(key: str, table: str, limit: int, columns: str) -> str:
    """Row ``floor(i * n / limit)`` for every sample number ``i``; all rows if there are no more."""
    return f"""
SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS idx, count(*) OVER () AS n FROM {table}) t
WHERE n <= {limit} OR idx IN (
  SELECT (i * (SELECT count(*) FROM {table})) // {limit} FROM (SELECT unnest(generate_series(0, {limit} - 1)) AS i) s)"""


def _feed(ghosts: str) -> str:
    """The feed over the uneven cycles: ghosts that were none in the cycle before, and picks among the others."""
    return f"""
, lost AS (
  SELECT g.cycle, 'ghost' AS kind, g.icao24, callsign, origin_country, NULL AS geo_altitude, ingested_at, '' AS pick
  FROM {ghosts} g WHERE NOT EXISTS (
    SELECT 1 FROM {ghosts} p WHERE p.icao24 = g.icao24
      AND p.cycle = (SELECT max(x.cycle) FROM (SELECT DISTINCT cycle FROM fx_uneven) x WHERE x.cycle < g.cycle))),
cruising AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY pick, icao24) AS rn FROM (
      SELECT *, md5(icao24 || CAST(epoch_us(cycle) AS VARCHAR)) AS pick FROM fx_uneven c
      WHERE lat IS NOT NULL AND lon IS NOT NULL AND geo_altitude > 9000 AND NOT EXISTS (
        SELECT 1 FROM {ghosts} p WHERE p.icao24 = c.icao24 AND p.cycle = c.cycle)) h) r WHERE rn <= 2)
SELECT cycle, kind, icao24, {_MESSAGE} AS message FROM (
  SELECT * FROM lost UNION ALL
  SELECT cycle, 'cruise', icao24, callsign, origin_country, geo_altitude, ingested_at, pick FROM cruising) e
ORDER BY cycle DESC, kind DESC, CASE WHEN kind = 'ghost' THEN ingested_at END, pick, icao24 LIMIT 28"""


def _region_counts(regions: str) -> str:
    return f"""
SELECT r.ord, r.region, count(f.icao24) AS flight_count FROM {regions} r
LEFT JOIN flying f ON f.lat BETWEEN r.s AND r.n AND f.lon BETWEEN r.w AND r.e GROUP BY r.ord, r.region"""


_MESSAGE = """CASE kind WHEN 'ghost' THEN @who || ' transponder signal lost'
    WHEN 'cruise' THEN @who || ' reached cruise altitude ' || coalesce(@alt_text, 'null')
    ELSE @who || ' (' || coalesce(origin_country, '—') || ') contact established' END"""

ORACLES: dict[str, str] = {
    # Sources and scans
    "scan_state_snapshots": sql(f"SELECT time, {STATE} FROM wire", "wire"),
    "scan_large_documents": sql(f"SELECT time, {STATE} FROM wire", "wire"),
    "scan_live_positions": sql(f"SELECT {LIVE} FROM fx_live WHERE lat IS NOT NULL AND lon IS NOT NULL", "fx_live"),
    "scan_recent_ghosts": sql("SELECT * FROM recent", "recent"),
    "scan_anomaly_window": sql("SELECT * FROM anomaly_window ORDER BY hour_utc", "anomaly_window"),
    "scan_runs_today": sql(
        f"""SELECT records_upserted FROM fx_runs
WHERE run_at >= date_trunc('day', {AS_OF}) AND status = 'success'""",
        "fx_runs",
    ),
    "recent_runs": sql("SELECT * FROM fx_runs ORDER BY run_at DESC, id DESC LIMIT 20", "fx_runs"),
    "altitude_profile": sql(
        """
SELECT icao24, CAST(rn AS INT) AS point, strftime(ingested_at, '%H:%M') AS time,
  CAST(CASE WHEN geo_altitude IS NOT NULL AND geo_altitude <> 0 THEN floor(geo_altitude * 3.28084e0 + 0.5e0)
       WHEN baro_altitude IS NOT NULL AND baro_altitude <> 0 THEN floor(baro_altitude * 3.28084e0 + 0.5e0)
       ELSE 0 END AS BIGINT) AS alt
FROM (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY ingested_at, event_id) AS rn FROM fx_history) h
WHERE rn <= 60""",
        "fx_history",
    ),
    "altitude_profile_of": sql(
        """
SELECT icao24, CAST(rn AS INT) AS point, strftime(ingested_at, '%H:%M') AS time,
  CAST(CASE WHEN geo_altitude IS NOT NULL AND geo_altitude <> 0 THEN floor(geo_altitude * 3.28084e0 + 0.5e0)
       WHEN baro_altitude IS NOT NULL AND baro_altitude <> 0 THEN floor(baro_altitude * 3.28084e0 + 0.5e0)
       ELSE 0 END AS BIGINT) AS alt
FROM (
  SELECT *, row_number() OVER (ORDER BY ingested_at, lon, lat, velocity NULLS FIRST) AS rn FROM fx_history
  WHERE NOT on_ground AND icao24 = (
    SELECT icao24 FROM fx_history WHERE NOT on_ground GROUP BY 1 ORDER BY count(*) DESC, icao24 LIMIT 1)) h
WHERE rn <= 60""",
        "fx_history",
    ),
    "scan_congestion": sql("SELECT hour, count FROM hours ORDER BY hs", "hours"),
    # Sinks and table maintenance
    "upsert_live": sql(
        f"""
SELECT {STATE}, {AS_OF} AS ingested_at FROM (
  SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY ts_us DESC, event_id DESC) AS rn
  FROM fx_history WHERE ingested_at > {BEFORE}) b WHERE rn = 1
UNION ALL
SELECT {LIVE} FROM fx_live_before
WHERE icao24 NOT IN (SELECT icao24 FROM fx_history WHERE ingested_at > {BEFORE})""",
        "fx_live_before",
    ),
    "append_history": sql(
        f"SELECT {LIVE}, CAST(hour(ingested_at) AS INT) AS folder_hour FROM fx_history WHERE NOT on_ground", "fx_history"
    ),
    "log_run": sql(
        f"""
SELECT CAST(1 AS BIGINT) AS id, {AS_OF} AS run_at, CAST(count(*) AS INT) AS records_fetched,
  CAST(count(*) AS INT) AS records_upserted, 120 AS fetch_ms, 340 AS upsert_ms, 'success' AS status,
  CAST(NULL AS VARCHAR) AS error_msg
FROM fx_history WHERE ingested_at > {BEFORE}
UNION ALL SELECT 2, {AS_OF}, 0, 0, 120, 0, 'error', 'Empty response from OpenSky'""",
        "fx_history",
    ),
    "upsert_anomaly_hour": sql(
        f"""
SELECT * FROM fx_anomaly WHERE hour_utc <> date_trunc('hour', {AS_OF})
UNION ALL
SELECT CAST(date_trunc('hour', {AS_OF}) AS TIMESTAMP),
  CAST(count(*) FILTER (NOT on_ground AND ingested_at < {AS_OF} - INTERVAL 2 MINUTE) AS INT),
  CAST(count(*) FILTER (NOT on_ground AND {FEET} < 3000 AND {FEET} > 0) AS INT), {AS_OF}
FROM fx_live WHERE ingested_at >= {AS_OF} - INTERVAL 30 MINUTE""",
        "fx_anomaly",
        "fx_live",
    ),
    "purge_stale_live": sql(
        f"SELECT * FROM fx_live WHERE NOT (ingested_at < {AS_OF} - INTERVAL 30 MINUTE)", "fx_live"
    ),
    "purge_history": sql(
        f"""SELECT event_id, {LIVE} FROM fx_history
WHERE NOT (ingested_at < {AS_OF} + INTERVAL 10 MINUTE - INTERVAL 1 HOUR)""",
        "fx_history",
    ),
    "purge_anomaly_hourly": sql(
        f"SELECT * FROM fx_anomaly WHERE NOT (hour_utc < {AS_OF} - INTERVAL 25 HOUR)", "fx_anomaly"
    ),
    "purge_runs": sql(f"SELECT * FROM fx_runs WHERE NOT (run_at < {AS_OF} - INTERVAL 3 DAY)", "fx_runs"),
    "table_counts": sql(
        """SELECT (SELECT count(*) FROM fx_live) AS live_rows, (SELECT count(*) FROM fx_anomaly) AS anomaly_rows,
  (SELECT count(*) FROM fx_runs) AS run_rows""",
        "fx_live",
        "fx_anomaly",
        "fx_runs",
    ),
    # Parsing, projections, filters
    "parse_states": sql(
        """
SELECT event_id, CASE WHEN event_id % 103 = 0 THEN '' ELSE icao24 END AS icao24, callsign, origin_country, lon, lat,
  baro_altitude, CASE WHEN event_id % 101 = 0 THEN NULL ELSE geo_altitude END AS geo_altitude, on_ground,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE velocity END AS velocity, true_track, vertical_rate,
  CASE WHEN event_id % 101 = 0 THEN 'short_vector' WHEN event_id % 103 = 0 THEN 'empty_icao24'
       WHEN event_id % 97 = 0 THEN 'bad_number'
       WHEN NOT on_ground AND (lat IS NULL OR lon IS NULL) THEN 'no_position' END AS reject_reason
FROM fx_states""",
        "fx_states",
    ),
    "valid_states": sql(
        f"""SELECT event_id, {STATE} FROM fx_history
WHERE event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 97 <> 0""",
        "fx_history",
    ),
    "airborne_only": sql(f"SELECT event_id, {LIVE} FROM fx_history WHERE NOT on_ground", "fx_history"),
    "airborne_positioned": sql("SELECT * FROM flying", "flying"),
    "positioned": sql(
        "SELECT icao24, lat, lon, on_ground FROM fx_live WHERE lat IS NOT NULL AND lon IS NOT NULL", "fx_live"
    ),
    "convert_units": sql(f"SELECT icao24, {FEET} AS altitude_ft, {KNOTS} AS speed_kt FROM fx_live", "fx_live"),
    "airline_name": sql(
        "SELECT icao24, @airline AS airline, @airline_longest AS airline_longest_prefix FROM fx_live", "fx_live"
    ),
    "altitude_band": sql("SELECT icao24, @band AS band FROM fx_live", "fx_live"),
    "performance_band3": sql("SELECT icao24, @band3 AS band FROM fx_live", "fx_live"),
    "performance_band5": sql("SELECT icao24, @band5 AS band FROM fx_live", "fx_live"),
    "is_low_altitude": sql(
        f"""SELECT icao24, (NOT on_ground AND geo_altitude IS NOT NULL AND {FEET} < 3000 AND {FEET} > 0) AS is_low
FROM fx_live""",
        "fx_live",
    ),
    "is_ghost": sql(
        f"""SELECT icao24, (NOT on_ground AND ingested_at < (SELECT threshold FROM threshold)) AS by_run,
  (NOT on_ground AND ingested_at < {AS_OF} - INTERVAL 2 MINUTE) AS by_age FROM fx_live""",
        "fx_live",
        "threshold",
    ),
    "flight_card": sql(
        f"""
SELECT @who AS title, icao24, coalesce(origin_country, '—') AS country, coalesce(@alt_text, '—') AS altitude,
  CASE WHEN velocity IS NOT NULL AND velocity <> 0
    THEN CAST(CAST(floor({KNOTS} + 0.5e0) AS BIGINT) AS VARCHAR) || ' kts' ELSE '—' END AS speed,
  coalesce(CAST(CAST(floor(true_track + 0.5e0) AS BIGINT) AS VARCHAR) || '°', '—') AS heading,
  CASE WHEN icao24 IN (SELECT icao24 FROM enriched) THEN 'SIGNAL LOST' ELSE 'LIVE' END AS status
FROM fx_live WHERE lat IS NOT NULL AND lon IS NOT NULL""",
        "enriched",
    ),
    "ghost_table_rows": sql(
        """
SELECT @who AS id, icao24, coalesce(origin_country, '—') AS country,
  coalesce(printf('%.4f', lat) || '° N', '—') || ', ' || coalesce(printf('%.4f', lon) || '° E', '—') AS position,
  coalesce(CAST(CAST(floor(minutes_since_contact + 0.5e0) AS BIGINT) AS VARCHAR) || 'm ago', '—') AS last_contact,
  CASE WHEN altitude_ft IS NOT NULL AND altitude_ft <> 0 THEN format('{:,}', CAST(altitude_ft AS BIGINT)) ELSE '—' END
    AS altitude
FROM recent""",
        "recent",
    ),
    "feed_message": sql(
        f"""
SELECT icao24, kind, {_MESSAGE} AS message FROM (
  SELECT *, CASE WHEN NOT on_ground AND ingested_at < {AS_OF} - INTERVAL 2 MINUTE THEN 'ghost'
    WHEN geo_altitude > 9000 THEN 'cruise' ELSE 'contact' END AS kind FROM fx_live) k""",
        "fx_live",
    ),
    "hour_label": sql("SELECT event_id, strftime(ingested_at, '%H:%M') AS label FROM fx_history", "fx_history"),
    "bbox_filter": sql(
        "SELECT * FROM fx_live WHERE lat >= 20 AND lat <= 60 AND lon >= -30 AND lon <= 60", "fx_live"
    ),
    "bbox_by_place": sql(
        "SELECT * FROM fx_live WHERE lat >= 20 AND lat <= 60 AND lon >= -30 AND lon <= 60", "fx_live"
    ),
    # Joins and subqueries
    "last_success_threshold": sql("SELECT threshold FROM threshold", "threshold"),
    "region_membership": sql(
        """SELECT f.icao24, r.region FROM flying f
JOIN map_regions r ON f.lat BETWEEN r.s AND r.n AND f.lon BETWEEN r.w AND r.e""",
        "flying",
        "map_regions",
    ),
    "enrich_ghosts": sql("SELECT * FROM enriched", "enriched"),
    "new_ghosts": sql(
        f"""
SELECT icao24, callsign, origin_country, lat, lon, round({FEET}) AS altitude_ft, true_track, ingested_at,
  CAST(epoch_us({AS_OF}) - epoch_us(ingested_at) AS DOUBLE) / 1e6 / 60e0 AS minutes_since_contact
FROM fx_live WHERE NOT on_ground AND ingested_at < {AS_OF} - INTERVAL 2 MINUTE AND icao24 NOT IN (
  SELECT icao24 FROM fx_live_before WHERE NOT on_ground AND ingested_at < {BEFORE} - INTERVAL 2 MINUTE)""",
        "fx_live",
        "fx_live_before",
    ),
    "non_ghost_flights": sql(
        "SELECT * FROM fx_live WHERE icao24 NOT IN (SELECT icao24 FROM recent)", "recent"
    ),
    "ghost_flag": sql(
        """SELECT icao24, icao24 IN (SELECT icao24 FROM recent) AS is_ghost FROM fx_live
WHERE lat IS NOT NULL AND lon IS NOT NULL""",
        "recent",
    ),
    "hour_spine_join": sql("SELECT hs, hour, count FROM hours", "hours"),
    "band_spine_join": sql("SELECT ord, band, flight_count FROM band_spine", "band_spine"),
    "nearest_aircraft": sql(
        """
, pixels AS (
  SELECT icao24, (lon + 180e0) / 360e0 * 2048e0 AS x,
    (0.5e0 - ln((1e0 + sn) / (1e0 - sn)) / (4e0 * pi())) * 2048e0 AS y
  FROM (SELECT *, sin(least(greatest(lat, -85.0511287798e0), 85.0511287798e0) * pi() / 180e0) AS sn FROM fx_live
        WHERE lat <> 0 AND lon IS NOT NULL) a),
clicks AS (
  SELECT point_id, (lon + 180e0) / 360e0 * 2048e0 AS x,
    (0.5e0 - ln((1e0 + sn) / (1e0 - sn)) / (4e0 * pi())) * 2048e0 AS y
  FROM (SELECT *, sin(lat * pi() / 180e0) AS sn FROM fx_points) p)
SELECT point_id, icao24, round(d, 6) AS distance_px FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, icao24) AS rn FROM (
    SELECT c.point_id, p.icao24, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d
    FROM clicks c JOIN pixels p ON p.x BETWEEN c.x - 14 AND c.x + 14 AND p.y BETWEEN c.y - 14 AND c.y + 14) j
  WHERE d < 14) r WHERE rn = 1""",
        "fx_live",
        "fx_points",
    ),
    # Aggregations
    "airline_activity": sql("SELECT * FROM airlines ORDER BY flight_count DESC, airline", "airlines"),
    "altitude_distribution": sql("SELECT * FROM bands", "bands"),
    "country_activity": sql("SELECT * FROM countries", "countries"),
    "ghost_flights": sql("SELECT * FROM ghosts ORDER BY ingested_at, icao24", "ghosts"),
    "ghost_flights_by_age": sql(
        f"""
SELECT icao24, callsign, origin_country, lat, lon, round({FEET}) AS altitude_ft, true_track, ingested_at,
  CAST(epoch_us({AS_OF}) - epoch_us(ingested_at) AS DOUBLE) / 1e6 / 60e0 AS minutes_since_contact
FROM fx_live WHERE ingested_at < {AS_OF} - INTERVAL 2 MINUTE AND NOT on_ground ORDER BY ingested_at, icao24""",
        "fx_live",
    ),
    "dashboard_stats": sql(
        """
SELECT count(*) FILTER (NOT on_ground) AS flights_in_air, count(*) FILTER (on_ground) AS flights_on_ground,
  count(DISTINCT origin_country) AS countries_active, (SELECT count(*) FROM ghosts) AS ghost_count,
  max(ingested_at) AS last_ingested_at, (SELECT seconds_since_sync FROM health) AS seconds_since_sync
FROM fx_live""",
        "ghosts",
        "health",
    ),
    "anomaly_hour_rollup": sql(
        f"""
SELECT CAST(date_trunc('hour', {AS_OF}) AS TIMESTAMP) AS hour_utc,
  CAST(count(*) FILTER (NOT on_ground AND ingested_at < {AS_OF} - INTERVAL 2 MINUTE) AS INT) AS ghost_count,
  CAST(count(*) FILTER (NOT on_ground AND {FEET} < 3000 AND {FEET} > 0) AS INT) AS low_alt_count, {AS_OF} AS updated_at
FROM fx_live WHERE ingested_at >= {AS_OF} - INTERVAL 30 MINUTE""",
        "fx_live",
    ),
    "hourly_congestion": sql("SELECT hour, count FROM hours ORDER BY hs", "hours"),
    "region_table_membership": sql("SELECT region, icao24 FROM in_regions", "in_regions"),
    "region_table_traffic": sql(
        """
SELECT r.region, count(i.icao24) AS flight_count FROM fx_regions r LEFT JOIN in_regions i ON i.region = r.region
GROUP BY 1 ORDER BY flight_count DESC, region""",
        "in_regions",
    ),
    "region_traffic": sql(
        f"SELECT region, flight_count FROM ({_region_counts('map_regions')}) c ORDER BY flight_count DESC, ord",
        "flying",
        "map_regions",
    ),
    "region_scores": sql(
        f"""
SELECT ord, region, CAST(floor(flight_count / greatest(max(flight_count) OVER (), 1) * 100 + 0.5e0) AS BIGINT) AS score
FROM ({_region_counts('score_regions')}) c""",
        "flying",
        "score_regions",
    ),
    "longitude_density": sql("SELECT * FROM density", "density"),
    "density_levels": sql(
        """
SELECT bin, flight_count, ratio, greatest(ratio * 100, 2e0) AS height_pct,
  CASE WHEN ratio > 0.7e0 THEN 'high' WHEN ratio > 0.3e0 THEN 'medium' WHEN ratio > 0.05e0 THEN 'low'
       ELSE 'minimal' END AS level
FROM (SELECT *, flight_count / greatest(max(flight_count) OVER (), 1) AS ratio FROM density) d""",
        "density",
    ),
    "heat_points": sql("SELECT lat, lon, 1 AS weight FROM flying", "flying"),
    "density_grid": sql(
        """SELECT CAST(floor(lat / 5e0) AS BIGINT) AS lat_cell, CAST(floor(lon / 5e0) AS BIGINT) AS lon_cell,
  CAST(count(*) AS BIGINT) AS weight FROM flying GROUP BY 1, 2""",
        "flying",
    ),
    "country_speed": sql(
        f"""
SELECT CAST(row_number() OVER (ORDER BY avg_kt DESC, origin_country) AS INT) AS rank, origin_country, avg_kt, n,
  CAST(floor(avg_kt / greatest(max(avg_kt) OVER (), 1) * 100 + 0.5e0) AS BIGINT) AS width_pct, avg_kt - 460 AS diff_kt
FROM (
  SELECT origin_country, CAST(floor(avg({KNOTS}) + 0.5e0) AS BIGINT) AS avg_kt, count(*) AS n FROM flying
  WHERE velocity IS NOT NULL AND velocity <> 0 AND origin_country <> '' GROUP BY 1 HAVING count(*) >= 3
  ORDER BY avg_kt DESC, origin_country LIMIT 15) c""",
        "flying",
    ),
    "alert_distribution": sql(
        """
SELECT *, greatest(0, 100 - ghost_pct - low_alt_pct) AS deviation_pct FROM (
  SELECT total_ghost, total_low_alt,
    CAST(floor(total_ghost / greatest(total_ghost + total_low_alt, 1) * 100 + 0.5e0) AS BIGINT) AS ghost_pct,
    CAST(floor(total_low_alt / greatest(total_ghost + total_low_alt, 1) * 100 + 0.5e0) AS BIGINT) AS low_alt_pct
  FROM (SELECT CAST(coalesce(sum(ghost_count), 0) AS BIGINT) AS total_ghost,
          CAST(coalesce(sum(low_alt_count), 0) AS BIGINT) AS total_low_alt FROM anomaly_window) s) p""",
        "anomaly_window",
    ),
    "records_today": sql(
        f"""
SELECT nullif(CAST(coalesce(sum(coalesce(records_upserted, 0)), 0) AS BIGINT), 0) AS records_today FROM fx_runs
WHERE run_at >= date_trunc('day', {AS_OF}) AND status = 'success'""",
        "fx_runs",
    ),
    "run_metrics": sql(
        """
SELECT CAST(floor(avg(coalesce(fetch_ms, 0)) FILTER (status = 'success') + 0.5e0) AS BIGINT) AS avg_fetch_ms,
  CAST(floor(avg(coalesce(upsert_ms, 0)) FILTER (status = 'success') + 0.5e0) AS BIGINT) AS avg_upsert_ms,
  arg_max(struct_pack(r := records_upserted), id).r AS total_records, max(run_at) AS last_run_at,
  arg_max(status, id) AS last_status,
  CAST(floor(count(*) FILTER (status = 'success') / count(*) * 100 + 0.5e0) AS BIGINT) AS success_rate
FROM (SELECT * FROM fx_runs ORDER BY run_at DESC, id DESC LIMIT 10) t""",
        "fx_runs",
    ),
    "tracked_flights": sql(
        "SELECT CAST(coalesce(sum(flight_count), 0) AS BIGINT) AS tracked_flights FROM first_ten", "first_ten"
    ),
    "congestion_total": sql("SELECT CAST(sum(count) AS BIGINT) AS total FROM hours", "hours"),
    "snapshot_health": sql("SELECT * FROM health", "health"),
    # Window-like computations
    "band_shares": sql(
        """
SELECT ord, band, flight_count, flight_count / total AS fraction,
  CAST(floor(flight_count / total * 100 + 0.5e0) AS BIGINT) AS percent,
  CAST(upto - flight_count AS BIGINT) / total AS slice_start, CAST(upto AS BIGINT) / total AS slice_end
FROM (SELECT *, CAST(sum(flight_count) OVER () AS BIGINT) AS total,
        sum(flight_count) OVER (ORDER BY ord) AS upto FROM band_spine) b""",
        "band_spine",
    ),
    "country_share": sql(
        """
SELECT CAST(rn AS INT) AS rank, origin_country, flights_now,
  printf('%.1f', CASE WHEN share * 4 = floor(share * 4) THEN floor(share * 10 + 0.5e0) / 10 ELSE share END) AS share_pct
FROM (SELECT *, row_number() OVER (ORDER BY flights_now DESC, origin_country) AS rn,
        flights_now / CAST(sum(flights_now) OVER () AS BIGINT) * 100 AS share FROM countries) c WHERE rn <= 6""",
        "countries",
    ),
    "airline_bars": sql(
        """
SELECT CAST(rn AS INT) AS rank, airline, flight_count,
  CAST(floor(flight_count / leader * 100 + 0.5e0) AS BIGINT) AS width_pct, rn <= 5 AS in_race
FROM (SELECT *, row_number() OVER (ORDER BY flight_count DESC, airline) AS rn, max(flight_count) OVER () AS leader
      FROM first_ten) a WHERE rn <= 7""",
        "first_ten",
    ),
    "airline_race": sql(
        """
SELECT CAST(row_number() OVER (ORDER BY flight_count DESC, airline) AS INT) AS rank, airline, flight_count,
  CAST(floor(flight_count / max(flight_count) OVER () * 100 + 0.5e0) AS BIGINT) AS width_pct
FROM first_ten WHERE airline <> 'Other'""",
        "first_ten",
    ),
    "congestion_peak": sql(
        "SELECT hour, count FROM hours WHERE count > 0 ORDER BY count DESC, hs LIMIT 1", "hours"
    ),
    "morning_night_peaks": sql("SELECT * FROM peaks", "peaks"),
    "congestion_bars": sql(
        """
SELECT hour, count,
  greatest(4, CAST(floor(count / greatest(max(count) OVER (), 1) * 100 + 0.5e0) AS BIGINT)) AS height_pct,
  hour(hs) >= 6 AND hour(hs) < 20 AS is_day, hour IN (SELECT hour FROM peaks) AS is_peak FROM hours""",
        "peaks",
    ),
    "activity_clock": sql(
        f"""
SELECT hour, count, count / greatest(max(count) OVER (), 1) AS intensity,
  hour = strftime(date_trunc('hour', {AS_OF}), '%H:%M') AS is_now,
  count = greatest(max(count) OVER (), 1) AS is_peak FROM hours""",
        "hours",
    ),
    "anomaly_peak": sql("SELECT * FROM timeline WHERE total > 0 ORDER BY total DESC, hour LIMIT 1", "timeline"),
    "latest_by_key": sql("SELECT * FROM fx_live", "fx_live"),
    "anomaly_timeline": sql("SELECT * FROM timeline", "timeline"),
    "region_trend": sql(
        """
SELECT cycle, region, flight_count, previous, change_pct,
  CASE WHEN change_pct > 0 THEN 'up' WHEN change_pct < 0 THEN 'down' ELSE 'flat' END AS direction
FROM (
  SELECT *, CASE WHEN previous > 0
    THEN CAST(floor((flight_count - previous) / previous * 100 + 0.5e0) AS BIGINT) END AS change_pct
  FROM (
    SELECT *, lag(flight_count) OVER (PARTITION BY region ORDER BY cycle) AS previous FROM (
      SELECT t.cycle, r.region, count(f.icao24) AS flight_count
      FROM (SELECT DISTINCT cycle FROM fx_cycles) t CROSS JOIN map_regions r
      LEFT JOIN fx_cycles f ON f.cycle = t.cycle AND NOT f.on_ground AND f.lat BETWEEN r.s AND r.n
        AND f.lon BETWEEN r.w AND r.e
      GROUP BY t.cycle, r.region) c) l) p""",
        "fx_cycles",
        "map_regions",
    ),
    # Sort, limit, pages, samples
    "ghost_alerts": sql(
        "SELECT icao24, callsign, origin_country, ingested_at FROM recent ORDER BY ingested_at, icao24 LIMIT 6", "recent"
    ),
    "page_of": sql(
        """
SELECT icao24, callsign, ingested_at, 3 AS page,
  (SELECT greatest(1, CAST(ceil(count(*) / 20) AS BIGINT)) FROM recent) AS total_pages
FROM recent ORDER BY ingested_at, icao24 LIMIT 20 OFFSET 40""",
        "recent",
    ),
    "page_after": sql(
        """
SELECT * FROM (SELECT callsign, icao24 FROM fx_live WHERE callsign IS NULL OR callsign < 'BA1000' OR (callsign = 'BA1000' AND icao24 > '')
  ORDER BY callsign DESC NULLS LAST, icao24 LIMIT 30) a
UNION ALL SELECT * FROM (SELECT callsign, icao24 FROM fx_live WHERE callsign IS NULL AND icao24 > '100' ORDER BY icao24 LIMIT 30) b""",
        "fx_live",
    ),
    "systematic_sample": sql(_sample("icao24", "placed_live", 500, "icao24"), "placed_live"),
    "zoom_sample": sql(
        f"""SELECT * FROM ({_sample("icao24, event_id", "placed_history", 5000, "3 AS zoom, icao24, event_id")})
UNION ALL SELECT * FROM ({_sample("icao24, event_id", "placed_history", 10000, "5 AS zoom, icao24, event_id")})
UNION ALL SELECT 7, icao24, event_id FROM fx_history WHERE lat BETWEEN 20 AND 60 AND lon BETWEEN -30 AND 60""",
        "fx_history",
        "placed_history",
    ),
    "performance_scatter": sql(
        f"""
SELECT * FROM (
  SELECT icao24, callsign, origin_country, CAST(floor({KNOTS} + 0.5e0) AS BIGINT) AS speed,
    CAST(floor({FEET} + 0.5e0) AS BIGINT) AS altitude, @band3 AS band
  FROM fx_live WHERE NOT on_ground AND {MOVING}) p
WHERE speed > 0 AND speed < 700 AND altitude > 0 AND altitude < 55000""",
        "fx_live",
    ),
    "performance_scatter_wide": sql(
        f"""
SELECT * FROM (
  SELECT icao24, callsign, origin_country, CAST(floor({KNOTS} + 0.5e0) AS BIGINT) AS speed,
    CAST(floor({FEET} + 0.5e0) AS BIGINT) AS altitude, @band5 AS band
  FROM flying WHERE {MOVING}) p
WHERE speed > 0 AND speed < 700 AND altitude > 0""",
        "flying",
    ),
    # Streaming
    "stream_ingest": sql("SELECT * FROM wire_live", "wire_live"),
    "stream_hourly_rollup": sql(
        f"""
SELECT hour_utc, ghost_count, low_alt_count, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY hour_utc ORDER BY updated_at DESC) AS latest FROM (
    SELECT make_timestamp((t // 3600) * 3600000000) AS hour_utc,
      CAST(count(*) FILTER (NOT on_ground AND time < t - 120) AS INT) AS ghost_count,
      CAST(count(*) FILTER (NOT on_ground AND {FEET} < 3000 AND {FEET} > 0) AS INT) AS low_alt_count,
      make_timestamp(t * 1000000) AS updated_at
    FROM wire_seen WHERE n > 0 GROUP BY t) h) r
WHERE latest = 1""",
        "wire_seen",
    ),
    "stream_new_ghosts": sql(
        """
SELECT make_timestamp(t * 1000000) AS cycle, icao24, @who || ' transponder signal lost' AS message FROM wire_ghosts g
WHERE NOT EXISTS (SELECT 1 FROM wire_ghosts p WHERE p.icao24 = g.icao24 AND p.k = g.k - 1)""",
        "wire_ghosts",
    ),
    "stream_runs": sql(
        f"""
SELECT time AS id, make_timestamp(time * 1000000) AS run_at, CAST(n AS INT) AS records_fetched, CAST(n AS INT) AS records_upserted,
  CASE WHEN n > 0 THEN 'success' ELSE 'error' END AS status, CASE WHEN n = 0 THEN '{EMPTY_FETCH_MESSAGE}' END AS error_msg
FROM wire_cycles""",
        "wire_cycles",
    ),
    "kept_airline_activity": sql("SELECT * FROM wire_airlines ORDER BY flight_count DESC, airline", "wire_airlines"),
    "kept_altitude_distribution": sql("SELECT * FROM wire_bands", "wire_bands"),
    "kept_country_activity": sql("SELECT * FROM wire_countries", "wire_countries"),
    "kept_dashboard_stats": sql(
        """
SELECT count(*) FILTER (NOT on_ground) AS flights_in_air, count(*) FILTER (on_ground) AS flights_on_ground,
  count(DISTINCT origin_country) AS countries_active,
  count(*) FILTER (NOT on_ground AND ingested_at < (SELECT as_of FROM wire_now) - INTERVAL 2 MINUTE) AS ghost_count,
  max(ingested_at) AS last_ingested_at, 0 AS seconds_since_sync
FROM wire_live""",
        "wire_live",
    ),
    "live_feed": sql(_feed("uneven_recent"), "uneven_recent"),
    "live_feed_by_runs": sql(_feed("uneven_unseen"), "uneven_unseen"),
    "history_hourly_sketch": sql(
        "SELECT DISTINCT make_timestamp((time // 3600) * 3600000000) AS hs, true AS within FROM wire WHERE NOT on_ground", "wire"
    ),
    "history_hourly": sql(
        """SELECT make_timestamp((ts_us // 3600000000) * 3600000000) AS hs, count(DISTINCT icao24) AS aircraft
FROM fx_history WHERE NOT on_ground GROUP BY 1""",
        "fx_history",
    ),
}
