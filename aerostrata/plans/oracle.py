"""The registered queries as plain SQL, for a side-by-side check in another engine."""

from __future__ import annotations

from aerostrata.schema import (
    CORE_FIELDS, HEALTH_BOUNDS, RANGE_BOUNDS, ROLLING_FIELDS, SCAN_COLUMNS, STATS, SYSTEM_FIELDS,
    feature_names,
)

FEATURES = feature_names()
RANGES = [c for c in FEATURES if c.endswith("_range")]

OBS = """
SELECT station_id, event_id, ts, ts + INTERVAL '2' SECOND AS measured_at,
       concat('s', CAST(station_id AS VARCHAR), '-b', lpad(CAST(CAST(floor(seq / 10) AS BIGINT) AS VARCHAR), 8, '0')) AS batch_id,
       CAST(seq % 10 AS INT) AS row_in_batch,
       CASE WHEN sps_bad THEN NULL ELSE value * 0.04E0 END AS mass_pm1_0,
       CASE WHEN sps_bad THEN NULL ELSE value * 0.05E0 END AS mass_pm2_5,
       CASE WHEN sps_bad THEN NULL ELSE value * 0.07E0 END AS mass_pm4_0,
       CASE WHEN sps_bad THEN NULL ELSE value * 0.1E0  END AS mass_pm10,
       CASE WHEN scd_bad THEN NULL ELSE 600.0E0 + 150 * (day(ts) % 3) + value * 0.5E0 END AS co2_ppm,
       CASE WHEN scd_bad THEN NULL ELSE 20.0E0 + hour(ts) / 8.0E0 + value * 0.004E0 END AS scd_temp_c,
       CASE WHEN scd_bad THEN NULL ELSE 45.0E0 + value * 0.03E0 END AS scd_humidity_pct,
       CASE WHEN bme_bad THEN NULL ELSE 21.0E0 + hour(ts) / 8.0E0 END AS bme_temp_c,
       CASE WHEN bme_bad THEN NULL ELSE 44.0E0 + value * 0.03E0 END AS bme_humidity_pct,
       CASE WHEN bme_bad THEN NULL ELSE 1000.0E0 + day(ts) * 0.5E0 + value * 0.004E0 END AS pressure_hpa,
       CASE WHEN scd_bad THEN 'failed' ELSE 'ok' END AS scd41_status,
       CASE WHEN bme_bad THEN 'failed' ELSE 'ok' END AS bme688_status,
       CASE WHEN outage THEN 'failed' WHEN sps_bad THEN 'data_not_ready' ELSE 'ok' END AS sps30_status
FROM (SELECT event_id, ts, value, user_id % 8 AS station_id,
             floor(event_id / 200) % 25 = 0 AS outage,
             floor(event_id / 200) % 25 = 0 OR (event_type = 'error'  AND event_id % 2 = 0) AS scd_bad,
             floor(event_id / 200) % 25 = 0 OR (event_type = 'signup' AND event_id % 3 = 0) AS sps_bad,
             event_type = 'view' AND event_id % 5 = 0 AS bme_bad,
             row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS seq
      FROM events) e
"""

RTM = """
SELECT ts, station_id, event_id, concat('c', CAST(event_id AS VARCHAR)) AS cycle_id, batch_id, row_in_batch,
       CAST((event_id * 37) % 100 AS DOUBLE) AS cpu_pct,
       CAST(40 + event_id % 20 AS DOUBLE) AS ram_percent,
       CAST(700 + event_id % 90 AS DOUBLE) AS cycle_total_ms,
       3.0E0 + (event_id % 5) * 0.25E0 AS power_w,
       event_id % 29 <> 0 AS success
FROM obs WHERE event_id % 17 <> 0
UNION ALL
SELECT ts, station_id, event_id, concat('d', CAST(event_id AS VARCHAR)), batch_id, row_in_batch,
       CAST((event_id * 37) % 100 + 1 AS DOUBLE), CAST(41 + event_id % 20 AS DOUBLE),
       CAST(710 + event_id % 90 AS DOUBLE), 3.0E0, FALSE
FROM obs WHERE event_id % 41 = 0 AND event_id % 17 <> 0
"""

LATEST_RTM = """
SELECT batch_id, row_in_batch, cpu_pct, ram_percent FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id, row_in_batch ORDER BY ts DESC, cycle_id DESC) AS nth
  FROM rtm) WHERE nth = 1
"""


def fixed(x: str) -> str:
    return f"round({x} + 1e-7, 6)"


def fixed_as(columns: list[str]) -> str:
    return ", ".join(f"{fixed(c)} AS {c}" for c in columns)


def stats_sql(source: str, fields: list[str] = CORE_FIELDS, order: str = "row_in_batch") -> str:
    parts = []
    for f in fields:
        k = f"CASE WHEN {f} IS NOT NULL THEN {order} END"
        parts.append(
            f"avg({f}) AS {f}_mean, min({f}) AS {f}_min, max({f}) AS {f}_max, "
            f"CASE WHEN count({f}) = 1 THEN 0.0 ELSE stddev_samp({f}) END AS {f}_std, "
            f"CASE WHEN count({f}) = 1 THEN 0.0 ELSE max_by({f}, {k}) - min_by({f}, {k}) END AS {f}_delta, "
            f"max({f}) - min({f}) AS {f}_range"
        )
    return (
        f"SELECT batch_id, min(station_id) AS station_id, min(ts) AS batch_ts, count(*) AS n_rows, "
        f"{', '.join(parts)} FROM {source} GROUP BY batch_id"
    )


def share_sql(fields: list[str] = CORE_FIELDS) -> str:
    missing = " + ".join(f"CAST({f}_mean IS NULL AS INT)" for f in fields)
    return f"(({missing}) / {len(fields)}.0E0)"


def health_sql(factor: float = 1.0, prefix: str = "") -> str:
    tests = []
    for f, b in HEALTH_BOUNDS.items():
        if "max" in b:
            tests.append(f"coalesce({prefix}{f}_max > {b['max'] * factor!r}, FALSE)")
        if "min" in b:
            tests.append(f"coalesce({prefix}{f}_min < {b['min'] * factor!r}, FALSE)")
    return f"CAST({' OR '.join(tests)} AS INT)"


def range_sql(factor: float = 1.0) -> str:
    tests = [f"coalesce({c} > {b * factor!r}, FALSE)" for c, b in RANGE_BOUNDS.items()]
    return f"CAST({' OR '.join(tests)} AS INT)"


# Named building blocks; each uses only earlier ones.
BLOCKS = {
    "obs": OBS,
    "rtm": RTM,
    "latest": LATEST_RTM,
    "stats": stats_sql("obs"),
    "features": f"SELECT * FROM stats WHERE n_rows >= 10 AND {share_sql()} <= 0.5",
    "indexed": "SELECT *, row_number() OVER (ORDER BY batch_ts, batch_id) - 1 AS chrono_idx, "
               "count(*) OVER () AS total FROM features",
    "split": "SELECT *, CASE WHEN chrono_idx < floor(0.8E0 * total) THEN 'train' ELSE 'test' END AS split "
             "FROM indexed",
    "means": "SELECT " + ", ".join(f"coalesce(avg({c}), 0.0) AS m_{c}" for c in FEATURES)
             + " FROM split WHERE split = 'train'",
    "filled": "SELECT batch_id, chrono_idx, split, total, "
              + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in FEATURES) + " FROM split, means",
    "spread": "SELECT "
              + ", ".join(
                  f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}"
                  for c in FEATURES)
              + " FROM filled WHERE split = 'train'",
    "scaled": "SELECT batch_id, chrono_idx, "
              + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES) + " FROM filled, spread",
    "predictions": " UNION ALL ".join(
        f"SELECT '{m}' AS model, batch_id, chrono_idx, total, {health_sql()} AS y, {health_sql(k)} AS pred "
        "FROM indexed" for m, k in (("rule", 1.0), ("tight", 0.9), ("loose", 1.1))),
    "folds": "SELECT i.batch_id, i.chrono_idx, f.fold, CASE WHEN i.chrono_idx < i.total - (5 - f.fold) * "
             "(i.total // 6) THEN 'train' ELSE 'validate' END AS role FROM indexed i JOIN "
             "(SELECT unnest([0, 1, 2, 3, 4]) AS fold) f ON i.chrono_idx < i.total - (4 - f.fold) * (i.total // 6)",
}


def query(blocks: str, body: str) -> str:
    """A statement over the named blocks and the blocks they need."""
    needs = {
        "obs": "", "rtm": "obs", "latest": "rtm", "stats": "obs", "features": "stats",
        "indexed": "features", "split": "indexed", "means": "split", "filled": "means",
        "spread": "filled", "scaled": "spread", "predictions": "indexed", "folds": "indexed",
    }
    wanted: set[str] = set()
    todo = blocks.split()
    while todo:
        b = todo.pop()
        wanted.add(b)
        if needs[b] and needs[b] not in wanted:
            todo.append(needs[b])
    ctes = ",\n".join(f"{b} AS ({BLOCKS[b]})" for b in BLOCKS if b in wanted)
    return f"WITH {ctes}\n{body}"


def _p_values() -> str:
    """The tail 1 - erf(z), z = sqrt(statistic / 2), by the series of positive terms of erf."""
    term = (
        "exp(2 * k * ln(2.0E0) + (2 * k + 1) * ln(z) - lgamma(2 * k + 2) + lgamma(k + 1) - z * z)"
    )
    return f"""
SELECT model1, model2, b, c, statistic, {fixed('p')} AS p_value, p < 0.05 AS significant FROM (
  SELECT *, CASE WHEN b + c = 0 THEN 1.0E0 WHEN z = 0 THEN 1.0E0 WHEN z > 6 THEN 0.0E0
    ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(200), lambda k: {term})) END AS p
  FROM (SELECT *, CASE WHEN b + c = 0 THEN 0.0E0 ELSE abs(abs(b - c) - 1) / sqrt(2.0E0 * (b + c)) END AS z
        FROM ({_mcnemar()})))"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / CAST({b} AS DOUBLE) END"


_COUNTS = (
    "count(*) AS n_samples, count(*) FILTER (y = 0 AND pred = 0) AS tn, "
    "count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, "
    "count(*) FILTER (y = 1 AND pred = 1) AS tp"
)
_METRICS = {
    "accuracy": _ratio("tp + tn", "n_samples"),
    "precision": _ratio("tp", "(tp + fp)"),
    "recall": _ratio("tp", "(tp + fn)"),
    "f1": _ratio("2 * tp", "(2 * tp + fp + fn)"),
}


def _scan_columns() -> str:
    present = {"batch_id", "row_in_batch", "ts", "measured_at"}
    out = []
    for c in SCAN_COLUMNS:
        if c in present:
            out.append(f"o.{c}")
        elif c in CORE_FIELDS:
            out.append(f"{fixed('o.' + c)} AS {c}")
        else:
            out.append(f"CAST(NULL AS DOUBLE) AS {c}")
    return ", ".join(out)


def _overall() -> str:
    s = "scd41_status, bme688_status, sps30_status"
    return (
        f"CASE WHEN list_bool_and([x = 'ok' for x in [{s}]]) THEN 'ok' "
        f"WHEN list_bool_and([x IN ('failed', 'data_not_ready') for x in [{s}]]) THEN 'failed' "
        "ELSE 'partial' END"
    )


def _grades() -> str:
    two = {"co2_ppm": (1000.0, 2000.0), "mass_pm2_5": (12.0, 35.4), "mass_pm10": (45.0, 150.0)}
    band = {"scd_temp_c": (10.0, 40.0), "scd_humidity_pct": (20.0, 80.0)}
    out = [
        f"CASE WHEN {f} > {c} THEN 'critical' WHEN {f} > {w} THEN 'warning' "
        f"WHEN {f} IS NOT NULL THEN 'normal' END AS {f}_alert" for f, (w, c) in two.items()
    ] + [
        f"CASE WHEN {f} < {lo} THEN 'low' WHEN {f} > {hi} THEN 'high' "
        f"WHEN {f} IS NOT NULL THEN 'normal' END AS {f}_alert" for f, (lo, hi) in band.items()
    ]
    return ", ".join(out)


def _injected() -> str:
    pick = "CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 10"
    cols = ", ".join(
        fixed(f"CASE WHEN nth <= k AND {pick} = {i} AND sd_{c} > 0 THEN {c} + 3.0 * sd_{c} ELSE {c} END")
        + f" AS {c}" for i, c in enumerate(RANGES)
    )
    sds = ", ".join(f"stddev_samp({c}) AS sd_{c}" for c in RANGES)
    return (
        f"SELECT batch_id, {cols}, CAST(nth <= k AS INT) AS synthetic_anomaly FROM ("
        "SELECT *, row_number() OVER (ORDER BY digest) AS nth, "
        "greatest(1, CAST(floor(count(*) OVER () * 0.02E0) AS BIGINT)) AS k FROM "
        "(SELECT *, md5(batch_id || '|42') AS digest FROM features)) m, "
        f"(SELECT {sds} FROM features) d"
    )


def _rolling(partition: str) -> str:
    w = f"OVER ({partition} ORDER BY batch_ts, batch_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    cols = ", ".join(fixed(f"avg({c}) {w}") + f" AS {c}_roll3" for c in ROLLING_FIELDS)
    return query("features", f"SELECT batch_id, batch_ts, {cols} FROM features")


def _mcnemar() -> str:
    models = ["rule", "tight", "loose"]
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    body = " UNION ALL ".join(
        f"SELECT '{a}' AS model1, '{b}' AS model2, "
        "count(*) FILTER (p.y = p.pred AND q.y <> q.pred) AS b, "
        "count(*) FILTER (p.y <> p.pred AND q.y = q.pred) AS c "
        "FROM predictions p JOIN predictions q USING (batch_id) "
        f"WHERE p.model = '{a}' AND q.model = '{b}'" for a, b in pairs
    )
    stat = fixed("CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c) END")
    return query("predictions", f"SELECT *, {stat} AS statistic FROM ({body})")


def _points(columns: list[str]) -> str:
    """Blocks up to `pts`: filled and scaled features of every batch as a list `v`."""
    vec = ", ".join(f"({c} - m_{c}) / s_{c}" for c in columns)
    means = ", ".join(f"coalesce(avg({c}), 0.0) AS m_{c}" for c in columns)
    full = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in columns)
    stats = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}"
        for c in columns)
    return f"""mu AS (SELECT {means} FROM features),
full_rows AS (SELECT batch_id, {full} FROM features, mu),
sd AS (SELECT {stats} FROM full_rows),
pts AS (SELECT batch_id, [{vec}] AS v FROM full_rows, sd)"""


def _forest(columns: list[str], trees: int = 50, size: int = 256, seed: int = 42) -> str:
    """The isolation forest rebuilt from its keyed hashes, level by level, and walked by every batch."""
    def hex32(text: str, at: int) -> str:
        return f"CAST('0x' || substr(md5({text}), {at}, 8) AS BIGINT)"

    depth = (size - 1).bit_length()
    blocks = [_points(columns), f"""
lots AS (SELECT batch_id, tree, ({hex32(f"batch_id || '|{seed}'", 1)} % 2147483648 * (1 + (7919 * tree + {104729 * seed}) % 2147483646)
         + {hex32(f"batch_id || '|{seed}'", 9)} % 2147483648) % 2147483647 AS h FROM pts, range({trees}) AS t(tree)),
s0 AS (SELECT tree, batch_id, CAST(1 AS BIGINT) AS node FROM lots
       QUALIFY row_number() OVER (PARTITION BY tree ORDER BY h, batch_id) <= {size}),
w0 AS (SELECT batch_id, tree, CAST(1 AS BIGINT) AS node FROM pts, range({trees}) AS t(tree)),
total AS (SELECT least(count(*), {size}) AS n FROM pts)"""]
    key = f"'{seed}|' || tree || '|' || node"
    for k in range(depth):
        blocks.append(f"""
c{k} AS MATERIALIZED (SELECT tree, node, d, lo, hi, row_number() OVER (PARTITION BY tree, node ORDER BY d) - 1 AS r,
       count(*) OVER (PARTITION BY tree, node) AS m
       FROM (SELECT tree, node, d, min(v[d]) AS lo, max(v[d]) AS hi FROM s{k} JOIN pts USING (batch_id), range(1, {len(columns) + 1}) AS f(d)
             GROUP BY ALL HAVING lo < hi)),
x{k} AS MATERIALIZED (SELECT tree, node, d, lo + {hex32(key, 9)} / 4294967296.0E0 * (hi - lo) AS cut FROM c{k}
       WHERE r = {hex32(key, 1)} % m AND {k} < ceil(log2(greatest((SELECT n FROM total), 2)))),
s{k + 1} AS MATERIALIZED (SELECT tree, batch_id, 2 * node + CAST(v[d] > cut AS INT) AS node FROM s{k} JOIN x{k} USING (tree, node) JOIN pts USING (batch_id)),
w{k + 1} AS MATERIALIZED (SELECT batch_id, tree, 2 * node + CAST(v[d] > cut AS INT) AS node FROM w{k} JOIN x{k} USING (tree, node) JOIN pts USING (batch_id))""")
    ends = " UNION ALL ".join(
        f"SELECT batch_id, tree, node, {k} AS depth FROM w{k}" + (f" ANTI JOIN x{k} USING (tree, node)" if k < depth else "")
        for k in range(depth + 1))
    sizes = " UNION ALL ".join(f"SELECT tree, node, count(*) AS n FROM s{k} GROUP BY ALL" for k in range(depth + 1))

    def mean(n: str) -> str:
        return (f"CASE WHEN {n} <= 1 THEN 0.0E0 WHEN {n} = 2 THEN 1.0E0 "
                f"ELSE 2.0E0 * (ln({n} - 1.0E0) + 0.5772156649015329E0) - 2.0E0 * ({n} - 1.0E0) / {n} END")

    return query("features", f"""
, {", ".join(blocks)},
ends AS ({ends}),
sizes AS ({sizes}),
scores AS (SELECT batch_id, 0.5E0 - pow(2.0E0, -avg(depth + {mean('sizes.n')}) / any_value({mean('total.n')})) AS score
           FROM ends JOIN sizes USING (tree, node), total GROUP BY batch_id)
SELECT batch_id, {fixed('score')} AS score, CASE WHEN score < 0 THEN -1 ELSE 1 END AS prediction FROM scores
""").replace("\n\n, mu", ",\nmu", 1)


def _lof(columns: list[str], k: int = 5, novelty: bool = False) -> str:
    """Plain all-pairs density ratio over the scaled training rows; `novelty`: each also finds itself."""
    found = "SELECT * FROM knn"
    if novelty:
        found = f"SELECT p, o, d FROM knn WHERE nth < {k} UNION ALL SELECT batch_id, batch_id, 0.0 FROM pts"
    return query("features", f"""
, {_points(columns)},
pairs AS (SELECT a.batch_id AS p, b.batch_id AS o, list_distance(a.v, b.v) AS d
          FROM pts a JOIN pts b ON a.batch_id <> b.batch_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, o) AS nth FROM pairs) WHERE nth <= {k}),
kd AS (SELECT p, max(d) AS kdist FROM knn GROUP BY p),
lrd AS (SELECT knn.p, 1.0 / (avg(greatest(knn.d, kd.kdist)) + 1e-10) AS lrd FROM knn JOIN kd ON kd.p = knn.o GROUP BY knn.p),
found AS ({found}),
own AS (SELECT found.p, 1.0 / (avg(greatest(found.d, kd.kdist)) + 1e-10) AS lrd FROM found JOIN kd ON kd.p = found.o GROUP BY found.p)
SELECT found.p AS batch_id, {fixed('avg(o.lrd) / any_value(s.lrd)')} AS lof,
       CASE WHEN avg(o.lrd) / any_value(s.lrd) > 1.5 THEN -1 ELSE 1 END AS prediction
FROM found JOIN lrd o ON o.p = found.o JOIN own s ON s.p = found.p GROUP BY found.p
""").replace("\n\n, mu", ",\nmu", 1)


NOW = "2024-01-30 12:30:00"
LATER = "2024-02-03 12:30:00"


def _freshness(now: str) -> str:
    """Status row with the alert's text, which names both times in both zones."""
    def zones(t: str) -> str:
        local = f"timezone('Europe/Kyiv', timezone('UTC', {t}))"
        return f"strftime({t}, '%Y-%m-%d %H:%M') || ' UTC (' || strftime({local}, '%Y-%m-%d %H:%M') || ' Kyiv)'"

    at = f"TIMESTAMP '{now}'"
    age = f"(epoch_us({at}) - epoch_us(last)) / 3600000000.0E0"
    return f"""SELECT last AS last_measured_at, {at} AS checked_at, {fixed(age)} AS age_hours, status,
        CASE status WHEN 'stale' THEN printf('No new row for %.1f hours. Last reading ', {age}) || {zones('last')} || ', checked ' || {zones(at)} || '.'
             WHEN 'no_data' THEN 'No rows at all. Checked ' || {zones(at)} || '.' END AS message
        FROM (SELECT *, CASE WHEN hour(timezone('Europe/Kyiv', timezone('UTC', {at}))) NOT BETWEEN 9 AND 20 THEN 'outside_window'
                 WHEN last IS NULL THEN 'no_data'
                 WHEN epoch_us({at}) - epoch_us(last) > 21600000000 THEN 'stale' ELSE 'fresh' END AS status
            FROM (SELECT max(measured_at) AS last FROM obs))"""


def statements() -> dict[str, str]:
    """SQL by query name."""
    scan = _scan_columns()
    core = fixed_as(CORE_FIELDS)
    indexed_total = "CAST(total // 6 AS BIGINT)"
    return {
        "scan_observations": query("obs", f"SELECT {scan} FROM obs o"),
        "scan_with_metrics": query(
            "rtm", f"SELECT {scan}, m.cpu_pct, m.ram_percent FROM obs o LEFT JOIN rtm m "
                   "USING (batch_id, row_in_batch)"),
        "stream_with_metrics": query(
            "rtm", f"SELECT {scan}, m.cpu_pct, m.ram_percent FROM obs o LEFT JOIN rtm m "
                   "USING (batch_id, row_in_batch)"),
        "scan_with_metrics_dedup": query(
            "latest", f"SELECT {scan}, m.cpu_pct, m.ram_percent FROM obs o LEFT JOIN latest m "
                      "USING (batch_id, row_in_batch)"),
        "csv_roundtrip": query("obs", f"SELECT station_id, batch_id, row_in_batch, ts, measured_at, {core}, "
                                      "scd41_status, bme688_status, sps30_status FROM obs"),
        "json_batch_scan": query("obs", f"SELECT batch_id, row_in_batch, ts, measured_at, {core}, "
                                        "scd41_status, bme688_status, sps30_status FROM obs"),
        "csv_mixed_headers": query("obs", f"SELECT station_id, batch_id, row_in_batch, ts, measured_at, {core}, "
                                          "scd41_status, bme688_status, sps30_status, FALSE AS rejected FROM obs"),
        "json_batch_scan_damaged": query("obs", f"""
            SELECT batch_id, CASE WHEN n = 5 AND row_in_batch = 0 THEN NULL ELSE row_in_batch END AS row_in_batch,
                   ts, measured_at, {core}, scd41_status, bme688_status, sps30_status, FALSE AS rejected
            FROM (SELECT *, CAST(split_part(batch_id, 'b', 2) AS BIGINT) % 7 AS n FROM obs) WHERE n <> 3
            UNION ALL BY NAME
            SELECT NULL AS batch_id, TRUE AS rejected FROM (SELECT DISTINCT batch_id FROM obs)
            WHERE CAST(split_part(batch_id, 'b', 2) AS BIGINT) % 7 = 3"""),
        "decode_frames": """
SELECT event_id,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(a AS DOUBLE) END AS co2_ppm,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(-45.0E0 + 175.0E0 * b / 65536.0E0 + 1e-7, 6) END AS scd_temp_c,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(100.0E0 * c / 65536.0E0 + 1e-7, 6) END AS scd_humidity_pct
FROM (SELECT event_id, event_id * 7 % 65536 AS a, event_id * 1009 % 65536 AS b, user_id * 523 % 65536 AS c
      FROM events)""",
        "decode_frame_files": """
SELECT event_id,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(a AS DOUBLE) END AS co2_ppm,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(-45.0E0 + 175.0E0 * b / 65536.0E0 + 1e-7, 6) END AS scd_temp_c,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(100.0E0 * c / 65536.0E0 + 1e-7, 6) END AS scd_humidity_pct
FROM (SELECT event_id, event_id * 7 % 65536 AS a, event_id * 1009 % 65536 AS b, user_id * 523 % 65536 AS c
      FROM events)""",
        "stream_frames": """
SELECT event_id,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(a AS DOUBLE) END AS co2_ppm,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(-45.0E0 + 175.0E0 * b / 65536.0E0 + 1e-7, 6) END AS scd_temp_c,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(100.0E0 * c / 65536.0E0 + 1e-7, 6) END AS scd_humidity_pct
FROM (SELECT event_id, event_id * 7 % 65536 AS a, event_id * 1009 % 65536 AS b, user_id * 523 % 65536 AS c
      FROM events)""",
        "assign_microbatches": query("obs", "SELECT station_id, event_id, batch_id, row_in_batch FROM obs"),
        "microbatch_headers": query(
            "obs", "SELECT batch_id, min_by(measured_at, row_in_batch) AS start_ts, "
                   "max_by(measured_at, row_in_batch) AS end_ts, CAST(count(*) AS INT) AS record_count, "
                   f"TRUE AS is_closed, TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS closed_at "
                   "FROM obs GROUP BY batch_id HAVING count(*) >= 10"),
        "closed_batches_only": query(
            "obs", "SELECT station_id, event_id, batch_id, row_in_batch FROM obs WHERE batch_id IN "
                   "(SELECT batch_id FROM obs GROUP BY batch_id HAVING count(*) >= 10)"),
        "new_batches_only": query(
            "obs", "SELECT station_id, event_id, batch_id, row_in_batch FROM obs WHERE batch_id NOT IN "
                   "(SELECT batch_id FROM obs WHERE row_in_batch = 0 AND event_id % 3 = 0)"),
        "new_batches_bucketed": query(
            "obs", "SELECT station_id, event_id, batch_id, row_in_batch FROM obs WHERE batch_id NOT IN "
                   "(SELECT batch_id FROM obs WHERE row_in_batch = 0 AND event_id % 3 = 0)"),
        "sensor_status": query(
            "obs", "SELECT event_id, scd41_status, bme688_status, sps30_status, "
                   f"{_overall()} AS sensor_status FROM obs"),
        "status_counts": query(
            "obs", f"SELECT station_id, {_overall()} AS sensor_status, count(*) AS n FROM obs GROUP BY 1, 2"),
        "graded_alerts": query("obs", f"SELECT event_id, {_grades()} FROM obs"),
        "batch_features": query("features", f"SELECT batch_id, batch_ts, {fixed_as(FEATURES)} FROM features"),
        "batch_features_open": query("stats", f"SELECT batch_id, n_rows, {fixed_as(FEATURES)} FROM stats"),
        "batch_features_system": query("latest", f""", both_t AS (
            SELECT o.*, m.cpu_pct, m.ram_percent FROM obs o LEFT JOIN latest m USING (batch_id, row_in_batch)),
            sys AS ({stats_sql('both_t', CORE_FIELDS + SYSTEM_FIELDS)})
            SELECT batch_id, {fixed_as(feature_names(CORE_FIELDS + SYSTEM_FIELDS))} FROM sys
            WHERE {share_sql(CORE_FIELDS + SYSTEM_FIELDS)} <= 0.5""").replace("\n, both_t", ",\nboth_t", 1),
        "batch_features_fanout": query("rtm", f""", both_t AS (
            SELECT o.*, m.cpu_pct, m.ram_percent, m.cycle_id FROM obs o LEFT JOIN rtm m USING (batch_id, row_in_batch)),
            sys AS ({stats_sql('both_t', SYSTEM_FIELDS, "row_in_batch * 2 + CAST(cycle_id LIKE 'd%' AS INT)")})
            SELECT batch_id, n_rows, {fixed_as([f'{f}_{s}' for f in SYSTEM_FIELDS for s in STATS])}
            FROM sys""").replace("\n, both_t", ",\nboth_t", 1),
        "null_share_filter": query(
            "stats", f"SELECT batch_id, {fixed(share_sql())} AS null_share, {share_sql()} <= 0.5 AS kept FROM stats"),
        "sparse_batch_counts": query(
            "stats", f"SELECT count(*) FILTER ({share_sql()} <= 0.5) AS kept, count(*) FILTER ({share_sql()} > 0.5) AS dropped FROM stats"),
        "batch_read_times": query(
            "rtm", f"SELECT batch_id, count(*) AS n_cycles, {fixed('sum(CAST(event_id % 7 + 2 * (event_id % 5) + CASE WHEN event_id % 11 <> 0 THEN event_id % 13 ELSE 0 END AS DOUBLE))')} "
                   "AS total_sensor_read_ms FROM rtm GROUP BY batch_id"),
        "batch_timestamps": query("obs", "SELECT batch_id, min(ts) AS batch_ts FROM obs GROUP BY batch_id"),
        "temporal_features": query(
            "features", f"SELECT batch_id, {fixed('sin(2 * pi() * hour(batch_ts) / 24)')} AS hour_sin, "
                        f"{fixed('cos(2 * pi() * hour(batch_ts) / 24)')} AS hour_cos, "
                        "CAST(isodow(batch_ts) - 1 AS DOUBLE) AS day_of_week FROM features"),
        "rolling_features": _rolling(""),
        "rolling_features_by_station": _rolling("PARTITION BY station_id"),
        "health_labels": query("features", f"SELECT batch_id, {health_sql()} AS health_risk FROM features"),
        "anomaly_labels": query("features", f"SELECT batch_id, {range_sql()} AS anomaly FROM features"),
        "label_counts": query(
            "features", "SELECT task, label, n, count(*) OVER (PARTITION BY task) AS n_classes FROM ("
                        f"SELECT 'health_risk' AS task, {health_sql()} AS label, count(*) AS n FROM features GROUP BY 1, 2 "
                        f"UNION ALL SELECT 'anomaly', {range_sql()}, count(*) FROM features GROUP BY 1, 2)"),
        "inject_anomalies": query("features", _injected()),
        "chrono_index": query("indexed", "SELECT batch_id, batch_ts, chrono_idx FROM indexed"),
        "temporal_split": query("split", "SELECT batch_id, chrono_idx, split FROM split"),
        "time_series_folds": query("folds", "SELECT batch_id, chrono_idx, fold, role FROM folds"),
        "impute_means": query("split", "SELECT " + ", ".join(
            f"{fixed(f'coalesce(avg({c}), 0.0)')} AS {c}" for c in FEATURES) + " FROM split WHERE split = 'train'"),
        "imputed_features": query("filled", f"SELECT batch_id, split, {fixed_as(FEATURES)} FROM filled"),
        "scaled_features": query("scaled", f"SELECT batch_id, {fixed_as(FEATURES)} FROM scaled"),
        "threshold_baseline": query(
            "filled", f"SELECT batch_id, split, {health_sql()} AS prediction FROM filled"),
        "confusion_counts": query("predictions", f"SELECT model, {_COUNTS} FROM predictions GROUP BY model"),
        "classification_metrics": query(
            "predictions", "SELECT model, n_samples, tp + fn AS n_positive, tn + fp AS n_negative, "
            + ", ".join(f"{fixed(x)} AS {m}" for m, x in _METRICS.items())
            + ", concat('[[', tn, ',', fp, '],[', fn, ',', tp, ']]') AS confusion_matrix "
            + f"FROM (SELECT model, {_COUNTS} FROM predictions GROUP BY model)"),
        "cv_summary": query(
            "predictions", "SELECT model, count(*) AS n_folds, "
            + ", ".join(f"{fixed(f'avg({m})')} AS {m}_mean, {fixed(f'stddev_pop({m})')} AS {m}_std" for m in _METRICS)
            + " FROM (SELECT model, fold, " + ", ".join(f"{x} AS {m}" for m, x in _METRICS.items())
            + f" FROM (SELECT model, fold, {_COUNTS} FROM (SELECT p.*, "
            + f"(chrono_idx - (total - 5 * {indexed_total})) // {indexed_total} AS fold FROM predictions p "
            + f"WHERE chrono_idx >= total - 5 * {indexed_total}) GROUP BY model, fold)) GROUP BY model"),
        "mcnemar_pairs": _mcnemar(),
        "mcnemar_p_values": _p_values(),
        "anomaly_metrics": query(
            "features", "SELECT model, n_samples, tp + fp AS n_anomalies_detected, tp + fn AS n_true_anomalies, "
            + ", ".join(f"{fixed(_METRICS[m])} AS {m}" for m in ("precision", "recall", "f1"))
            + f" FROM (SELECT model, {_COUNTS} FROM ("
            + " UNION ALL ".join(
                f"SELECT '{m}' AS model, {range_sql()} AS y, {range_sql(k)} AS pred FROM features"
                for m, k in (("rule", 1.0), ("tight", 0.9), ("loose", 1.1)))
            + ") GROUP BY model)"),
        "freshness_status": query("obs", _freshness(NOW)),
        "freshness_alert": query("obs", _freshness(LATER)),
        "data_gaps": query(
            "obs", f"SELECT station_id, gap_start, gap_end, {fixed('gap_hours')} AS gap_hours FROM (SELECT station_id, "
                   "lag(measured_at) OVER w AS gap_start, measured_at AS gap_end, "
                   "(epoch_us(measured_at) - epoch_us(lag(measured_at) OVER w)) / 3600000000.0E0 AS gap_hours "
                   "FROM obs WINDOW w AS (PARTITION BY station_id ORDER BY measured_at)) WHERE gap_hours > 6"),
        "data_gaps_1h": query(
            "obs", f"SELECT station_id, gap_start, gap_end, {fixed('gap_hours')} AS gap_hours FROM (SELECT station_id, "
                   "lag(measured_at) OVER w AS gap_start, measured_at AS gap_end, "
                   "(epoch_us(measured_at) - epoch_us(lag(measured_at) OVER w)) / 3600000000.0E0 AS gap_hours "
                   "FROM obs WINDOW w AS (PARTITION BY station_id ORDER BY measured_at)) WHERE gap_hours > 1"),
        "stream_outages": query(
            "obs", f"SELECT station_id, gap_start, gap_end, {fixed('gap_hours')} AS gap_hours FROM (SELECT station_id, "
                   "lag(measured_at) OVER w AS gap_start, measured_at AS gap_end, "
                   "(epoch_us(measured_at) - epoch_us(lag(measured_at) OVER w)) / 3600000000.0E0 AS gap_hours "
                   "FROM obs WINDOW w AS (PARTITION BY station_id ORDER BY measured_at)) WHERE gap_hours > 1"),
        # Held-back rows come with the last third of the time; what the rows before it have passed by an hour is late.
        "stream_late_rows": """
WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
p AS (SELECT event_id, user_id % 8 AS station_id, ts,
             CASE WHEN event_id % 97 = 0 THEN 2 ELSE floor((epoch_us(ts) - lo) * 3.0E0 / (hi - lo + 1)) END AS part FROM events, b)
SELECT event_id, station_id, ts FROM p WHERE part = 2 AND ts < (SELECT max(ts) FROM p WHERE part < 2) - INTERVAL 1 HOUR""",
        "batch_energy": query(
            "rtm", f"SELECT batch_id, {fixed('avg(power_w)')} AS avg_power_w, "
                   f"{fixed('sum(power_w * cycle_total_ms / 3600000.0E0)')} AS energy_wh, count(*) AS n_cycles "
                   "FROM rtm GROUP BY batch_id"),
        "cumulative_energy": query(
            "rtm", f"SELECT event_id, {fixed('sum(step) OVER (PARTITION BY station_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} "
                   "AS cumulative_energy_wh FROM (SELECT station_id, event_id, ts, coalesce(power_w * (epoch_us(ts) - "
                   "lag(epoch_us(ts)) OVER (PARTITION BY station_id ORDER BY ts, event_id)) / 1e6 / 3600.0E0, 0.0) AS step "
                   "FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, row_in_batch ORDER BY ts DESC, cycle_id DESC) AS nth "
                   "FROM rtm) WHERE nth = 1)"),
        "ingest_counts": query(
            "obs", "SELECT count(*) AS n_rows, count(DISTINCT batch_id) AS n_batches, "
                   "max(measured_at) AS last_measured_at FROM obs"),
        "registry_latest": """
SELECT model_name, max(saved_at) AS saved_at, max_by(path, saved_at) AS path FROM (
  SELECT CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || '_scaler' END AS model_name,
         ts AS saved_at, 'models/' || CAST(event_id AS VARCHAR) AS path FROM events) GROUP BY model_name""",
        "stream_microbatches": query(
            "obs", "SELECT station_id, event_id, batch_id, row_in_batch FROM obs WHERE batch_id IN "
                   "(SELECT batch_id FROM obs GROUP BY batch_id HAVING count(*) >= 10)"),
        "stream_microbatches_no_station": """
SELECT CAST(CASE WHEN event_id % 2 = 0 THEN 0 ELSE station END AS BIGINT) AS station_id, event_id,
       concat('s', CAST(s AS VARCHAR), '-b', lpad(CAST(seq // 10 AS VARCHAR), 8, '0')) AS batch_id, CAST(seq % 10 AS INT) AS row_in_batch
FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts, event_id) - 1 AS seq, count(*) OVER (PARTITION BY s) AS n
      FROM (SELECT event_id, ts, user_id % 8 AS station, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id % 8 END AS s FROM events))
WHERE (seq // 10 + 1) * 10 <= n""",
        "stream_headers": query(
            "obs", "SELECT batch_id, min_by(measured_at, row_in_batch) AS start_ts, "
                   "max_by(measured_at, row_in_batch) AS end_ts, CAST(count(*) AS INT) AS record_count "
                   "FROM obs GROUP BY batch_id HAVING count(*) >= 10"),
        "stream_metrics": """
SELECT event_id, concat('c', CAST(event_id AS VARCHAR)) AS cycle_id,
       CAST((event_id * 37) % 100 AS DOUBLE) AS cpu_pct, CAST(40 + event_id % 20 AS DOUBLE) AS ram_percent
FROM events WHERE event_id % 17 <> 0""",
        "incremental_microbatches": query("obs", "SELECT station_id, event_id, batch_id, row_in_batch FROM obs"),
        "incremental_energy": query(
            "rtm", f"SELECT event_id, {fixed('sum(step) OVER (PARTITION BY station_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} "
                   "AS cumulative_energy_wh FROM (SELECT station_id, event_id, ts, coalesce(power_w * (epoch_us(ts) - "
                   "lag(epoch_us(ts)) OVER (PARTITION BY station_id ORDER BY ts, event_id)) / 1e6 / 3600.0E0, 0.0) AS step "
                   "FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, row_in_batch ORDER BY ts DESC, cycle_id DESC) AS nth "
                   "FROM rtm) WHERE nth = 1)"),
        "sketch_errors": "SELECT n_rows, unnest(['distinct_event_id', 'distinct_user_id', 'q10_value', 'q50_value', 'q90_value']) AS measure, "
            f"unnest([{', '.join(fixed(x) for x in ('e', 'u', 'a', 'b', 'c'))}]) AS exact, TRUE AS within FROM ("
            "SELECT count(*) AS n_rows, CAST(count(DISTINCT event_id) AS DOUBLE) AS e, CAST(count(DISTINCT user_id) AS DOUBLE) AS u, "
            "quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.9) AS c FROM events)",
        # Studies: what each model was judged on, and the number of its features.
        "classification_final_system": query("latest", f""", both_t AS (
            SELECT o.*, m.cpu_pct, m.ram_percent FROM obs o LEFT JOIN latest m USING (batch_id, row_in_batch)),
            sys AS ({stats_sql('both_t', CORE_FIELDS + SYSTEM_FIELDS)}),
            kept AS (SELECT *, row_number() OVER (ORDER BY batch_ts, batch_id) - 1 AS i, count(*) OVER () AS total FROM sys
                     WHERE n_rows >= 10 AND {share_sql(CORE_FIELDS + SYSTEM_FIELDS)} <= 0.5)
            SELECT unnest(['threshold_baseline', 'logistic_regression', 'decision_tree', 'random_forest']) AS model, n_samples,
                   n_positive, n_samples - n_positive AS n_negative, CAST(72 AS INT) AS n_features
            FROM (SELECT count(*) AS n_samples, CAST(sum({health_sql()}) AS BIGINT) AS n_positive
                  FROM kept WHERE i >= floor(0.8E0 * total))""").replace("\n, both_t", ",\nboth_t", 1),
        "anomaly_rule_temporal": query("features", f"""
            SELECT unnest(['rule_based_baseline', 'isolation_forest', 'local_outlier_factor', 'local_outlier_factor_pca', 'one_class_svm'])
                     AS model, count(*) AS n_samples, CAST(sum({range_sql()}) AS BIGINT) AS n_true_anomalies,
                   CAST({len(FEATURES) + 3 + len([f for f in ROLLING_FIELDS if f in FEATURES])} AS INT) AS n_features FROM features"""),
        # The penalised loss is strictly convex: a zero gradient leaves one answer.
        "logreg_fold_gradients": query("indexed", f"""
SELECT CAST(fold AS INT) AS fold, term, CAST(CASE WHEN fold < 0 THEN n ELSE n - (5 - fold) * (n // 6) END AS BIGINT) AS n_train,
       0.0E0 AS gradient
FROM (SELECT CAST(floor(0.8E0 * any_value(total)) AS BIGINT) AS n FROM indexed) s, range(-1, 5) AS f(fold),
     (SELECT unnest([{', '.join(repr(c) for c in ['intercept', *FEATURES])}]) AS term) t"""),
        "score_iforest": _forest(FEATURES),
        "score_lof": _lof(FEATURES),
        "score_lof_novelty": _lof(FEATURES, novelty=True),
    }
