"""The same results in DuckDB's SQL, for the queries that SQL can express.

Each text is a chain of named parts: ``_with`` puts the parts that a query names, and those that they
need, before its final SELECT. Instants are microseconds (``us``) or epoch seconds.
"""

from __future__ import annotations

import re

from slotwise.plans import bindings as b

DAY, HOUR = 86400, 3600
#: The first and last second of the readings' hours, as subqueries.
T0, T1 = "(SELECT t0 FROM sp)", "(SELECT t1 FROM sp)"
MIDNIGHT = f"({T0} // 86400 * 86400)"
_LOCAL = "(({} AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')"


def _seconds(us: str) -> str:
    return f"({us} // 1000000)::BIGINT"


PARTS: dict[str, str] = {
    "r": "SELECT event_type AS facility, ts, epoch_us(ts) AS us, epoch_us(ts) // 900000000 AS batch, floor(value)::INTEGER AS value, event_id AS pos FROM events",
    "s": f"""SELECT facility, us // {b.CADENCE}000000 AS slot, ts, us, value, {_LOCAL.format("ts")}::DATE AS local_date, hour({_LOCAL.format("ts")})::INTEGER AS local_hour
             FROM r QUALIFY row_number() OVER (PARTITION BY facility, us // {b.CADENCE}000000 ORDER BY us DESC, batch DESC, value DESC) = 1""",
    "reg": """SELECT n_name AS facility, n_nationkey::INTEGER AS pos, r_name AS region, 35 + (n_nationkey % 5) * 0.25::DOUBLE + floor(n_nationkey / 10) * 2.0::DOUBLE AS latitude,
              -90 + floor(n_nationkey / 5) * 0.45::DOUBLE AS longitude FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "er": "SELECT facility, (row_number() OVER (ORDER BY facility) - 1)::INTEGER AS pos FROM (SELECT DISTINCT facility FROM r)",
    "sp": f"""SELECT min(us) // 3600000000 * 3600 AS t0, (max(us) // 3600000000 + 1) * 3600 AS t1, min({_LOCAL.format("ts")}::DATE) AS d0, max({_LOCAL.format("ts")}::DATE) AS d1 FROM r""",
    "sn": f"""SELECT facility, us // {b.CADENCE}000000 AS slot, us, value, {_LOCAL.format("ts")}::DATE AS local_date, hour({_LOCAL.format("ts")})::INTEGER AS local_hour
             FROM r WHERE value >= 0 QUALIFY row_number() OVER (PARTITION BY facility, us // {b.CADENCE}000000 ORDER BY us DESC, batch DESC, value DESC) = 1""",
    "celln": "SELECT facility, local_date AS day, local_hour AS hour, list(value) AS vs, count(*) AS n FROM sn GROUP BY ALL",
    "hcal": f"""SELECT l::DATE AS day, hour(l)::INTEGER AS hour, count(*) AS n_slots FROM (SELECT {_LOCAL.format("t")} AS l
             FROM (SELECT unnest(range((SELECT d0 FROM sp)::TIMESTAMP - INTERVAL 31 DAY, (SELECT d1 FROM sp)::TIMESTAMP + INTERVAL 3 DAY, INTERVAL {b.CADENCE} SECOND)) AS t)) WHERE l::DATE BETWEEN (SELECT d0 FROM sp) - 28 AND (SELECT d1 FROM sp) GROUP BY ALL""",
    "cell": "SELECT facility, local_date AS day, local_hour AS hour, list(value) AS vs, count(*) AS n FROM s GROUP BY ALL",
}


def _models(name: str, samples: int, fallback: int, cell: str = "cell", skip: int = 1) -> None:
    """Models of every facility, local day and hour; days nearer than ``skip`` are not known yet."""
    p = b.HOURLY
    PARTS[f"{name}_sp"] = f"""
      SELECT facility, local_date, local_hour, name, place, radius, count(*) FILTER (ok) AS days, count(*) AS eligible_days, sum(observed) AS observed_slots, sum(expected) AS expected_slots,
             list_sort(flatten(coalesce(list(vs) FILTER (ok AND vs IS NOT NULL), []))) AS vs
      FROM (SELECT *, expected > 0 AND observed >= {p.minimum_day_coverage} * expected AS ok FROM (
        SELECT facility, local_date, local_hour, name, place, radius, day, coalesce(sum(n) FILTER (k >= {skip}), 0) AS observed,
               coalesce(sum(n_slots), 0) AS expected, flatten(list(vs) FILTER (vs IS NOT NULL AND k >= {skip})) AS vs
        FROM (SELECT f.facility, d::DATE AS local_date, h::INTEGER AS local_hour, k, name, place, radius, (d - to_days(k::INTEGER))::DATE AS day, ((h + o + 24) % 24)::INTEGER AS hour
              FROM (SELECT DISTINCT facility FROM s) f, (SELECT unnest(range((SELECT d0 FROM sp), (SELECT d1 FROM sp) + 2, INTERVAL 1 DAY)) AS d) x, range(24) y(h), range(1, {p.lookback_days + 1}) z(k), range(-2, 3) w(o),
                   (VALUES ('weekday_weekend', 0, {p.hour_radius}, true), ('wider_hours', 1, {fallback}, true), ('all_days', 2, {fallback}, false)) g(name, place, radius, alike)
              WHERE abs(o) <= radius AND (NOT alike OR (isodow(d) >= 6) = (isodow(d - to_days(k::INTEGER)) >= 6)))
        LEFT JOIN {cell} USING (facility, day, hour) LEFT JOIN hcal USING (day, hour) GROUP BY facility, local_date, local_hour, name, place, radius, day))
      GROUP BY ALL"""
    PARTS[f"{name}_all"] = f"""SELECT *, len(vs)::BIGINT AS samples, observed_slots / expected_slots AS coverage,
             days >= {p.minimum_days} AND len(vs) >= {samples} AND coalesce(observed_slots / expected_slots, 0) >= {p.minimum_coverage} AS sufficient FROM {name}_sp"""
    PARTS[name] = f"""SELECT facility, local_date, local_hour, name, radius, days, eligible_days, samples, observed_slots, expected_slots, coverage, sufficient, CASE WHEN sufficient THEN vs END AS vs,
             CASE WHEN sufficient THEN list_aggregate(vs, 'quantile_cont', 0.5) END AS median, CASE WHEN sufficient THEN list_aggregate(vs, 'quantile_cont', {p.band_low}) END AS low,
             CASE WHEN sufficient THEN list_aggregate(vs, 'quantile_cont', {p.band_high}) END AS high
      FROM {name}_all QUALIFY row_number() OVER (PARTITION BY facility, local_date, local_hour ORDER BY CASE WHEN sufficient THEN place ELSE 10 - place END) = 1"""


_models("m", b.HOURLY.minimum_samples, b.HOURLY.fallback_hour_radius)
_models("mdefault", 64, b.HOURLY.fallback_hour_radius)
_models("mstrict", 40, 1)
_models("mnear", b.HOURLY.minimum_samples, b.HOURLY.fallback_hour_radius, "celln")
_models("mover", b.HOURLY.minimum_samples, b.HOURLY.fallback_hour_radius, "celln", 2)

_P = b.HOURLY
_T = b.HOURLY_TREND

_HORIZONS = f"(VALUES {', '.join(f'({h})' for h in b.REPLAY.horizons_minutes)}) v(horizon_minutes)"


def _moves(steps: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT facility, {h} AS horizon_minutes, us, local_date, later_date, later - value AS change FROM (
              SELECT *, lead(us, {k}) OVER o AS later_us, lead(value, {k}) OVER o AS later, lead(covered, {k}) OVER o AS later_covered, lead(local_date, {k}) OVER o AS later_date, max(gap) OVER (o ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) AS widest
              FROM {steps} WINDOW o AS (PARTITION BY facility ORDER BY us))
            WHERE covered AND later_covered AND abs(later_us - us - {h * 60000000}) <= {b.MOVES.tolerance_seconds}000000 AND widest <= {b.MOVES.gap_seconds}000000"""
        for h, k in ((h, max(1, h * 60 // b.CADENCE)) for h in b.MOVES.horizons_minutes)
    )


_FAR, _NEAR = (_T.trend_minutes + _T.trend_tolerance_minutes) * 60, (_T.trend_minutes - _T.trend_tolerance_minutes) * 60
PARTS |= {
    "c": f"""SELECT *, CASE WHEN NOT coalesce(sufficient, false) THEN 'insufficient_history' WHEN percentile >= {_P.unusual_high} AND delta >= {_P.meaningful_minutes} THEN 'above_usual'
                    WHEN percentile <= {_P.unusual_low} AND delta <= -{_P.meaningful_minutes} THEN 'below_usual' ELSE 'no_large_departure' END AS unusual,
             CASE WHEN median IS NULL THEN 'no_range' WHEN percentile >= {_P.unusual_high} AND delta >= {_P.meaningful_minutes} THEN 'above' WHEN percentile <= {_P.unusual_low} AND delta <= -{_P.meaningful_minutes} THEN 'below' ELSE 'near' END AS point
      FROM (SELECT s.*, m.name, m.sufficient, m.median, m.low, m.high, m.days, m.coverage, value - median AS delta,
                   100.0 * (len(list_filter(vs, lambda v: v < value)) + 0.5 * len(list_filter(vs, lambda v: v = value))) / len(vs) AS percentile
            FROM s LEFT JOIN m USING (facility, local_date, local_hour))""",
    "tr": f"""SELECT facility, us, value, samples, CASE WHEN fine THEN value - ago END AS delta,
             CASE WHEN NOT fine THEN 'insufficient_recent_history' WHEN value - ago >= 10 THEN 'rising' WHEN value - ago <= -10 THEN 'falling' ELSE 'little_change' END AS state
      FROM (SELECT *, samples >= {_T.trend_minimum_samples} AND coalesce(list_max([points[i + 1] - points[i] for i in range(1, len(points))]), 0) <= {_T.gap_seconds}000000 AS fine
            FROM (SELECT facility, us, value, count(value) OVER w AS samples, median(value) OVER w AS ago, list(us) OVER w AS points FROM s
                  WINDOW w AS (PARTITION BY facility ORDER BY us RANGE BETWEEN {_FAR}000000 PRECEDING AND {_NEAR}000000 PRECEDING)))""",
    "covered": f"SELECT facility, local_date FROM s WHERE value >= 0 GROUP BY ALL HAVING count(*) >= {b.MOVES.minimum_day_coverage} * 24",
    "steps": "SELECT s.*, c.facility IS NOT NULL AS covered, us - lag(us) OVER (PARTITION BY s.facility ORDER BY us) AS gap FROM s LEFT JOIN covered c ON c.facility = s.facility AND c.local_date = s.local_date WHERE value >= 0",
    "mv": _moves("steps"),
    "sr": f"""SELECT * FROM s WHERE local_date >= {_LOCAL.format(f"make_timestamp(({T1} - 1800) * 1000000)")}::DATE - {b.MOVES.lookback_days} AND local_date < {_LOCAL.format(f"make_timestamp(({T1} - 1800) * 1000000)")}::DATE""",
    "coveredr": f"SELECT facility, local_date FROM sr WHERE value >= 0 GROUP BY ALL HAVING count(*) >= {b.MOVES.minimum_day_coverage} * 24",
    "stepsr": "SELECT s.*, c.facility IS NOT NULL AS covered, us - lag(us) OVER (PARTITION BY s.facility ORDER BY us) AS gap FROM sr s LEFT JOIN coveredr c ON c.facility = s.facility AND c.local_date = s.local_date WHERE value >= 0",
    "mvr": _moves("stepsr"),
    "heat": f"""SELECT f.facility, f.bin, coalesce(n, 0) AS readings, delta, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN delta IS NULL THEN 'unsupported' WHEN delta <= -40 THEN 'far_below' WHEN delta <= -20 THEN 'below'
             WHEN delta < -10 THEN 'slightly_below' WHEN delta <= 10 THEN 'near' WHEN delta < 20 THEN 'slightly_above' WHEN delta < 40 THEN 'above' ELSE 'far_above' END AS band
      FROM (SELECT facility, unnest(range({T1} - {72 * HOUR}, {T1}, {HOUR})) AS bin FROM (SELECT DISTINCT facility FROM c)) f
      LEFT JOIN (SELECT facility, us // {HOUR}000000 * {HOUR} AS bin, count(*) AS n, median(delta) AS delta FROM c GROUP BY ALL) x ON x.facility = f.facility AND x.bin = f.bin""",
    "dev": f"SELECT facility, us // {HOUR}000000 * {HOUR} AS bin, median(delta) AS deviation FROM c WHERE delta IS NOT NULL GROUP BY ALL HAVING count(*) >= {b.PAIRS.minimum_slots}",
    "grid": f"""SELECT facility, (us // {b.CADENCE}000000 + 1) * {b.CADENCE} AS slot_end, value, collisions FROM (
              SELECT *, count(*) OVER (PARTITION BY facility, us // {b.CADENCE}000000) - 1 AS collisions FROM r WHERE value >= 0)
            QUALIFY row_number() OVER (PARTITION BY facility, us // {b.CADENCE}000000 ORDER BY us DESC, batch DESC, value DESC) = 1""",
    "near": "SELECT x.facility AS a, y.facility AS b FROM reg x JOIN reg y ON x.facility <> y.facility WHERE {} <= 50",
}


def _km(a: str, o: str, radius: str = "6371.0088") -> str:
    return f"2 * {radius} * asin(sqrt(least(1.0, pow(sin((radians({o}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({o}.latitude)) * pow(sin((radians({o}.longitude) - radians({a}.longitude)) / 2), 2))))"


PARTS["near"] = PARTS["near"].format(_km("x", "y"))
PARTS["reach"] = "SELECT facility, facility AS other FROM reg UNION SELECT r.facility, n.b FROM reach r JOIN near n ON n.a = r.other"
PARTS["grp"] = 'SELECT facility, min(other) AS "group" FROM reach GROUP BY facility'

_START, _STOP = f"({MIDNIGHT} + {15 * DAY})", T1


def _replay(name: str, cut: int) -> None:
    at = lambda alias, key: f"LEFT JOIN grid {alias} ON {alias}.facility = q.facility AND {alias}.slot_end = {key}"
    PARTS[name] = f"""SELECT q.facility, origin, target, horizon_minutes, a.value AS actual, k.value::DOUBLE AS carry_forward,
             CASE WHEN k.value IS NOT NULL AND target - {24 * HOUR} <= origin - {cut} THEN d.value END::DOUBLE AS daily_naive,
             CASE WHEN k.value IS NOT NULL AND target - {168 * HOUR} <= origin - {cut} THEN w.value END::DOUBLE AS weekly_naive, CASE WHEN k.value IS NOT NULL THEN CASE WHEN same THEN mn.median ELSE mo.median END END AS m1_median, coalesce(a.value > p90, false) AS spike
      FROM (SELECT *, {_LOCAL.format("make_timestamp(target * 1000000)")}::DATE AS tday, hour({_LOCAL.format("make_timestamp(target * 1000000)")})::INTEGER AS thour, {_LOCAL.format("make_timestamp(target * 1000000)")}::DATE = {_LOCAL.format(f"make_timestamp((origin - {cut}) * 1000000)")}::DATE AS same
            FROM (SELECT facility, origin, horizon_minutes, origin + 60 * horizon_minutes AS target FROM (SELECT DISTINCT facility FROM grid) g, (SELECT unnest(range({_START}, {_STOP}, {b.REPLAY.origin_seconds})) AS origin) x, {_HORIZONS})) q
      LEFT JOIN mnear mn ON mn.facility = q.facility AND mn.local_date = tday AND mn.local_hour = thour LEFT JOIN mover mo ON mo.facility = q.facility AND mo.local_date = tday AND mo.local_hour = thour
      {at("a", "target")} {at("k", f"origin - {cut}")} {at("d", f"target - {24 * HOUR}")} {at("w", f"target - {168 * HOUR}")}
      LEFT JOIN (SELECT o.facility, o.origin AS "at", quantile_cont(g.value, 0.9) AS p90 FROM (SELECT DISTINCT facility, origin FROM (SELECT DISTINCT facility FROM grid) g, (SELECT unnest(range({_START}, {_STOP}, {b.REPLAY.origin_seconds})) AS origin) x) o
                 JOIN grid g ON g.facility = o.facility AND g.slot_end > o.origin - {b.REPLAY.spike_days * DAY} AND g.slot_end <= o.origin - {cut} GROUP BY ALL HAVING count(*) >= {b.REPLAY.spike_minimum}) t
        ON t.facility = q.facility AND t."at" = q.origin
      WHERE target < {_STOP}"""


_replay("rep", 0)
_replay("repd", b.CADENCE)
PARTS["long"] = " UNION ALL ".join(
    f"SELECT facility, origin, target, horizon_minutes, actual, spike, actual IS NOT NULL AND carry_forward IS NOT NULL AND daily_naive IS NOT NULL AND weekly_naive IS NOT NULL AND m1_median IS NOT NULL AS matched, '{m}' AS model, {k} AS place, {m} AS prediction FROM rep"
    for k, m in enumerate(("carry_forward", "daily_naive", "weekly_naive", "m1_median"))
)


def _metrics(prefix: str = "", only: str = "true") -> str:
    scored, target = f"{only} AND actual IS NOT NULL AND prediction IS NOT NULL", f"{only} AND actual IS NOT NULL"
    e = "(prediction - actual)"
    n, t = f"count(*) FILTER ({scored})", f"count(*) FILTER ({target})"
    p = prefix
    return f"""count(*) FILTER ({only}) AS {p}origins, {t} AS {p}targets, count(*) FILTER ({only} AND actual IS NULL) AS {p}missing_targets, {n} AS {p}scored, {t} - {n} AS {p}abstentions_with_target,
      round({n} / nullif({t}, 0), 9) AS {p}availability_with_target, count(DISTINCT origin // {DAY}) FILTER ({scored}) AS {p}days, round(avg(abs{e}) FILTER ({scored}), 9) AS {p}mae,
      round(sqrt(avg({e} * {e}) FILTER ({scored})), 9) AS {p}rmse, round(avg({e}) FILTER ({scored}), 9) AS {p}bias"""


PARTS["scores"] = f"SELECT facility, horizon_minutes, model, place, {_metrics()}, {_metrics('matched_', 'matched')}, {_metrics('zero_', 'coalesce(actual = 0, false)')}, {_metrics('spike_', 'spike')} FROM long GROUP BY ALL"
PARTS["err"] = "SELECT facility, horizon_minutes, model, target AS t, actual - prediction AS e FROM long WHERE actual IS NOT NULL AND prediction IS NOT NULL"
PARTS["iv"] = f"""SELECT l.*, CASE WHEN qs[1] IS NOT NULL THEN greatest(0.0, prediction + qs[1]) END AS lo_80, CASE WHEN qs[2] IS NOT NULL THEN greatest(0.0, prediction + qs[2]) END AS hi_80, CASE WHEN qs[3] IS NOT NULL THEN greatest(0.0, prediction + qs[3]) END AS lo_95, CASE WHEN qs[4] IS NOT NULL THEN greatest(0.0, prediction + qs[4]) END AS hi_95
   FROM long l LEFT JOIN (
     SELECT a.facility, a.horizon_minutes, a.model, a.origin, quantile_cont(e, [{(1 - 0.8) / 2}, {1 - (1 - 0.8) / 2}, {(1 - 0.95) / 2}, {1 - (1 - 0.95) / 2}]) AS qs
     FROM long a JOIN err ON err.facility = a.facility AND err.horizon_minutes = a.horizon_minutes AND err.model = a.model AND t > a.origin - {b.REPLAY.interval_days * DAY} AND t <= a.origin
     WHERE a.prediction IS NOT NULL GROUP BY ALL HAVING count(*) >= {b.REPLAY.minimum_errors}) q USING (facility, horizon_minutes, model, origin)"""


def _interval(blocks: str, by: str, resamples: int, seed: int) -> str:
    """(by, low, high) of the ratio of sums over drawn blocks; ``blocks`` has by, k, size, top, bottom."""
    return f"""SELECT {by}, quantile_cont(top / bottom, 0.025) AS low, quantile_cont(top / bottom, 0.975) AS high FROM (
      SELECT {", ".join(f"n.{c.strip()}" for c in by.split(","))}, resample, sum(coalesce(top, 0)) AS top, sum(coalesce(bottom, 0)) AS bottom
      FROM (SELECT {by}, max(size) AS size FROM {blocks} GROUP BY ALL) n JOIN (SELECT size, resample, ('0x' || substr(md5('{seed}:' || resample || ':' || j), 1, 8))::BIGINT % size AS k
        FROM (SELECT size, resample, unnest(range(size)) AS j FROM (SELECT DISTINCT size FROM {blocks}) z, range({resamples}) y(resample))) p ON p.size = n.size
      LEFT JOIN {blocks} m ON m.k = p.k AND {" AND ".join(f"m.{c.strip()} = n.{c.strip()}" for c in by.split(","))} GROUP BY ALL) WHERE bottom > 0 GROUP BY ALL"""


PARTS["gained"] = f"""SELECT facility, horizon_minutes, row_number() OVER (PARTITION BY facility, horizon_minutes ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY facility, horizon_minutes) AS size, top, bottom FROM (
   SELECT b.facility, b.horizon_minutes, b.origin // {DAY} AS day, sum(abs(b.prediction - b.actual) - abs(k.prediction - b.actual)) AS top, count(*) AS bottom
   FROM long b JOIN long k ON k.facility = b.facility AND k.horizon_minutes = b.horizon_minutes AND k.origin = b.origin
   WHERE b.model = 'carry_forward' AND k.model = 'm1_median' AND b.actual IS NOT NULL AND b.prediction IS NOT NULL AND k.prediction IS NOT NULL GROUP BY ALL)"""
PARTS["gainb"] = _interval("gained", "facility, horizon_minutes", b.REPLAY.resamples, b.REPLAY.seed)
PARTS["entry"] = f"""SELECT k.facility, CASE WHEN k.facility >= 'f' OR n.us < ({T1} - {5 * HOUR}) * 1000000 THEN n.us ELSE o.us END AS us, CASE WHEN k.facility >= 'f' OR n.us < ({T1} - {5 * HOUR}) * 1000000 THEN n.value ELSE o.value END AS value,
     t.facility IS NOT NULL AND k.facility < 'f' AS failed
   FROM (SELECT DISTINCT facility FROM r UNION ALL SELECT 'absent') k
   LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY facility ORDER BY us DESC, pos) = 1) n USING (facility)
   LEFT JOIN (SELECT * FROM r WHERE us < ({T1} - {5 * HOUR}) * 1000000 QUALIFY row_number() OVER (PARTITION BY facility ORDER BY us DESC, pos) = 1) o USING (facility)
   LEFT JOIN (SELECT DISTINCT facility FROM r WHERE us >= ({T1} - {5 * HOUR}) * 1000000) t USING (facility)"""
PARTS["fresh"] = f"""SELECT facility, us // 1000000 AS "at", value, CASE WHEN failed THEN 'failed' WHEN us IS NULL THEN 'missing' ELSE 'reporting' END AS state, ({T1} * 1000000 - us) / 1000000 AS age,
     coalesce({T1} * 1000000 - us >= 0 AND {T1} * 1000000 - us < {b.FRESH.stale_after_seconds}000000, false) AND NOT failed AS current,
     concat_ws(',', CASE WHEN us > {T1} * 1000000 THEN 'clock_mismatch' END, CASE WHEN {T1} * 1000000 - us >= {b.FRESH.stale_after_seconds}000000 THEN 'stale' END, CASE WHEN failed THEN 'failed_attempt' END, CASE WHEN us IS NULL THEN 'missing' END) AS labels
   FROM entry"""
_M, _R = b.MOVES, b.RULES
_ENOUGH = f"count(*) >= {_M.minimum_pairs} AND count(DISTINCT {{}}local_date) >= {_M.minimum_days}"


def _horizon(drive: str) -> str:
    return "CASE " + " ".join(f"WHEN {drive} <= {h} THEN {h}" for h in _M.horizons_minutes) + " END"


def _reading(alias: str, who: str, seconds: str, how: str = "JOIN") -> str:
    return f"{how} rd {alias} ON {alias}.facility = {who} AND {seconds} < {T1} AND {alias}.slot = floor(({seconds}) / {b.CADENCE})::BIGINT"


PARTS |= {
    "rd": "SELECT facility, slot, value FROM s WHERE value >= 0",
    "newest": "SELECT facility, value FROM r QUALIFY row_number() OVER (PARTITION BY facility ORDER BY us DESC, pos) = 1",
    "screen": f"SELECT facility, horizon_minutes, CASE WHEN {_ENOUGH.format('')} THEN quantile_cont(abs(change), 0.9) END AS p90 FROM mvr GROUP BY ALL",
    "scr": f"""SELECT m.facility, d.day, m.horizon_minutes, quantile_cont(abs(change), 0.9) AS p90 FROM mv m JOIN (SELECT DISTINCT local_date AS day FROM s) d
             ON m.local_date >= d.day - {_M.lookback_days} AND m.later_date < d.day GROUP BY ALL HAVING {_ENOUGH.format("m.")}""",
    "route": """SELECT g.facility AS origin, e.facility AS slug, NOT (g.pos % 3 = 2 AND e.pos = 3) AS ok, 600 + g.pos * 300 + e.pos * 900 AS seconds FROM reg g JOIN er e ON true""",
    "drv": """SELECT g.facility AS origin, e.facility AS slug, k.profile, (900 + (g.pos * 7 + e.pos * 5) % 9 * 600 + extra) / 60 AS drive
             FROM reg g JOIN er e ON true JOIN (VALUES ('night', 0), ('am', 600), ('pm', 300)) k(profile, extra) ON true""",
    "opp": f"""SELECT q.origin, q.slot, q.day, q.profile, closest, alternative, drive_c, drive_a, sc.p90 AS p90_c, sa.p90 AS p90_a, drive_c + wc.value - (drive_a + wa.value) AS D, drive_c + ac.value - (drive_a + aa.value) AS A,
             drive_c + lc.value - (drive_a + la.value) AS A60, drive_c + ac.value - (drive_a * {_R.stress_ratio}::DOUBLE + st.value) AS A_stress
      FROM (SELECT z.*, d.origin, c.slug AS closest, d.slug AS alternative, c.drive AS drive_c, d.drive AS drive_a FROM (
              SELECT slot, t, l::DATE AS day, CASE WHEN isodow(l) < 6 AND hour(l) BETWEEN 6 AND 9 THEN 'am' WHEN isodow(l) < 6 AND hour(l) BETWEEN 15 AND 18 THEN 'pm' ELSE 'night' END AS profile FROM (
                SELECT slot, (slot + 1) * {b.CADENCE} AS t, {_LOCAL.format(f"make_timestamp((slot + 1) * {b.CADENCE}000000)")} AS l FROM (SELECT unnest(range(({MIDNIGHT} + {12 * DAY}) // {b.CADENCE}, {T1} // {b.CADENCE})) AS slot) x WHERE slot % {_R.evaluation_every_slots} = 0)) z
            JOIN drv d ON d.profile = z.profile
            JOIN (SELECT * FROM drv QUALIFY row_number() OVER (PARTITION BY origin, profile ORDER BY drive, slug) = 1) c ON c.origin = d.origin AND c.profile = d.profile
            WHERE d.slug <> c.slug AND d.drive <= {_R.max_drive_minutes}) q
      JOIN rd wc ON wc.facility = closest AND wc.slot = q.slot JOIN rd wa ON wa.facility = alternative AND wa.slot = q.slot
      JOIN scr sc ON sc.facility = closest AND sc.day = q.day AND sc.horizon_minutes = {_horizon("drive_c")} JOIN scr sa ON sa.facility = alternative AND sa.day = q.day AND sa.horizon_minutes = {_horizon("drive_a")}
      {_reading("ac", "closest", "t + drive_c * 60")} {_reading("aa", "alternative", "t + drive_a * 60")}
      {_reading("lc", "closest", f"t + drive_c * 60 + {_R.later_minutes * 60}", "LEFT JOIN")} {_reading("la", "alternative", f"t + drive_a * 60 + {_R.later_minutes * 60}", "LEFT JOIN")}
      {_reading("st", "alternative", f"t + drive_a * {_R.stress_ratio}::DOUBLE * 60", "LEFT JOIN")}""",
}
PARTS["cl"] = f"""SELECT *, CASE WHEN slot * {b.CADENCE} < {MIDNIGHT} + {21 * DAY} THEN 'discovery' ELSE 'confirmation' END AS period, CASE WHEN kind = 'screen' THEN D > 10 + value * (p90_c + p90_a) WHEN value = 0 THEN D > 0 ELSE D >= value END AS y
   FROM opp JOIN (VALUES {", ".join(f"('{n}', '{k}', {float(v)}::DOUBLE)" for n, k, v in _R.rules)}) u(rule, kind, value) ON true"""
PARTS["ruled"] = "SELECT period, rule, kind, value, count(*) FILTER (y) AS claims, count(DISTINCT day) FILTER (y) AS claim_days, round(avg((A > 0)::INTEGER) FILTER (y), 9) AS precision FROM cl GROUP BY ALL"
PARTS["clday"] = "SELECT *, row_number() OVER (PARTITION BY period ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY period) AS size FROM (SELECT DISTINCT period, day FROM cl) d"
PARTS["ruleday"] = """SELECT d.period, rule, k, size, top, bottom FROM (SELECT period, rule, day, count(*) FILTER (y AND A > 0) AS top, count(*) FILTER (y) AS bottom FROM cl GROUP BY ALL) t
   JOIN clday d ON d.period = t.period AND d.day = t.day WHERE bottom > 0"""
PARTS["ruleb"] = _interval("ruleday", "period, rule", _R.draws, _R.seed)
_ORDER = list(PARTS)


def _with(select: str) -> str:
    """``select`` after the parts it names and those that they need."""
    wanted: set[str] = set()
    todo = [select]
    while todo:
        words = set(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", todo.pop()))
        for p in words & PARTS.keys() - wanted:
            wanted.add(p)
            todo.append(PARTS[p])
    parts = []
    done: set[str] = set()

    def put(p: str) -> None:
        if p in done:
            return
        done.add(p)
        for q in _ORDER:
            if q != p and q in wanted and re.search(rf"(?:FROM|JOIN)\s+{q}\b", PARTS[p]):
                put(q)
        parts.append(f"{p} AS ({PARTS[p]})")

    for p in _ORDER:
        if p in wanted:
            put(p)
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select


def _usual(name: str) -> str:  # the days of the readings; models of the day after serve forecasts
    return f"""SELECT facility, local_date::VARCHAR AS local_date, local_hour, CASE WHEN sufficient THEN 'supported' ELSE 'insufficient_history' END AS state, name AS "group", radius::INTEGER AS hour_radius, days, eligible_days, samples,
      observed_slots::BIGINT AS observed_slots, expected_slots::BIGINT AS expected_slots, round(coverage, 9) AS coverage, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high,
      len(list_distinct(vs))::INTEGER AS n_values, len(vs)::BIGINT AS n_distribution FROM {name} WHERE local_date <= (SELECT d1 FROM sp)"""


PARTS |= {
    "ep": "SELECT facility, pos, CASE WHEN pos % 2 = 0 THEN 'North Side' ELSE 'South Side' END AS region FROM er",
    "mem": """SELECT 'all' AS area, facility, pos FROM ep UNION ALL SELECT 'near-' || first_value(facility) OVER (ORDER BY pos), facility, pos FROM ep WHERE pos < 3
              UNION ALL SELECT 'region-' || replace(lower(region), ' ', '-'), facility, pos FROM ep""",
    "st": f"""SELECT area, x.facility, pos, bin, point FROM (SELECT facility, us // {HOUR}000000 * {HOUR} AS bin, point FROM c WHERE us // 1000000 >= {T1} - {168 * HOUR}
              QUALIFY row_number() OVER (PARTITION BY us // {HOUR}000000, facility ORDER BY us DESC, point DESC) = 1) x JOIN mem ON mem.facility = x.facility""",
    "abin": f"""SELECT f.area, f.bin, count(point) AS reporting, count(*) FILTER (point <> 'no_range') AS compared, count(*) FILTER (point = 'above') AS n_above, count(*) FILTER (point = 'below') AS n_below,
      coalesce(string_agg(facility, ',' ORDER BY pos) FILTER (point = 'above'), '') AS above, coalesce(string_agg(facility, ',' ORDER BY pos) FILTER (point = 'below'), '') AS below
      FROM (SELECT area, unnest(range({T1} - {168 * HOUR}, {T1}, {HOUR})) AS bin FROM (SELECT DISTINCT area FROM mem) a) f LEFT JOIN st ON st.area = f.area AND st.bin = f.bin GROUP BY ALL""",
    "last_": "SELECT facility, us, value, point FROM c QUALIFY row_number() OVER (PARTITION BY facility ORDER BY us DESC) = 1",
}
_ORDER += ["ep", "mem", "st", "abin", "last_"]


def _ticks(hours: int, limit: int) -> str:
    size, every, end = (900, 6, f"({T1} - 1800)") if hours <= 24 else (3600, 24, T1)
    return f"""SELECT bin, ((bin - ({end} - {hours * HOUR})) // {size})::INTEGER AS index, hour(l)::INTEGER AS local_hour, {hours}::INTEGER AS hours FROM (
      SELECT *, row_number() OVER (ORDER BY bin) - 1 AS k, count(*) OVER () AS n FROM (
        SELECT bin, {_LOCAL.format("make_timestamp(bin * 1000000)")} AS l FROM (SELECT unnest(range({end} - {hours * HOUR}, {end}, {size})) AS bin) z)
      WHERE bin > {end} - {hours * HOUR} AND minute(l) = 0 AND hour(l) % {every} = 0) WHERE k % ceil(n / {limit}) = 0"""


_CELL = _LOCAL.format("make_timestamp(({} - 1800) * 1000000)")


def _cell(at: str) -> str:
    """Local hour of a slot's midpoint, plus 24 at weekends."""
    here = _CELL.replace("{}", at)
    return f"(hour({here}) + CASE WHEN isodow({here}) >= 6 THEN 24 ELSE 0 END)::INTEGER"


_F = b.REPLAY
_STEPS = tuple(h * 60 // b.CADENCE for h in _F.horizons_minutes)
_N = _F.training_days * DAY // b.CADENCE
PARTS |= {
    "fit": f"SELECT facility, unnest(range({_START}, {_STOP}, {DAY})) AS fit FROM (SELECT DISTINCT facility FROM grid)",
    "win": f"SELECT w.facility, fit, w.slot_end, value::DOUBLE AS value FROM (SELECT facility, fit, unnest(range(fit - {(_N - 1) * b.CADENCE}, fit + 1, {b.CADENCE})) AS slot_end FROM fit) w LEFT JOIN grid g ON g.facility = w.facility AND g.slot_end = w.slot_end",
    "mark": f"""SELECT *, max(CASE WHEN value IS NULL AND slot_end - coalesce(seen, lo - {b.CADENCE}) > {_F.maximum_missing_run * b.CADENCE} THEN slot_end END) OVER (PARTITION BY facility, fit) AS outage FROM (
      SELECT *, max(CASE WHEN value IS NOT NULL THEN slot_end END) OVER (PARTITION BY facility, fit ORDER BY slot_end) AS seen, min(slot_end) OVER (PARTITION BY facility, fit) AS lo FROM win)""",
    "sup": f"""SELECT facility, fit, whole, n >= {_F.minimum_training_slots} AND n >= {_F.minimum_training_coverage} * slots AND last AS supported FROM (
      SELECT facility, fit, bool_and(outage IS NULL) AS whole, count(value) FILTER (outage IS NULL OR slot_end > outage) AS n, count(*) FILTER (outage IS NULL OR slot_end > outage) AS slots, bool_or(slot_end = fit AND value IS NOT NULL) AS last FROM mark GROUP BY ALL)""",
    "kept": f"SELECT m.facility, m.fit, slot_end, value, {_cell('slot_end')} AS cell FROM mark m JOIN sup u ON u.facility = m.facility AND u.fit = m.fit WHERE supported AND (outage IS NULL OR slot_end > outage)",
    "pcell": """SELECT o.facility, o.fit, o.cell, CASE WHEN n >= 8 THEN med ELSE overall END AS usual FROM (SELECT facility, fit, median(value) AS overall, unnest(range(48)) AS cell FROM kept GROUP BY facility, fit) o
      LEFT JOIN (SELECT facility, fit, cell, median(value) AS med, count(value) AS n FROM kept GROUP BY ALL) c ON c.facility = o.facility AND c.fit = o.fit AND c.cell = o.cell""",
    "poff": f"""SELECT facility, fit, d, {", ".join(f"lead(d, {k}) OVER w AS d{k}" for k in _STEPS)} FROM (SELECT k.facility, k.fit, slot_end, value - usual AS d FROM kept k JOIN pcell c ON c.facility = k.facility AND c.fit = k.fit AND c.cell = k.cell)
      WINDOW w AS (PARTITION BY facility, fit ORDER BY slot_end)""",
    "pbeta": " UNION ALL ".join(f"SELECT facility, fit, {k} AS step, greatest(0, least(1, coalesce(sum(d * d{k}) / nullif(sum(d * d) FILTER (d{k} IS NOT NULL), 0), 0))) AS beta FROM poff GROUP BY facility, fit" for k in _STEPS),
    "chg": f"SELECT x.facility, x.bin, x.deviation - y.deviation AS deviation FROM dev x JOIN dev y ON x.facility = y.facility AND x.bin = y.bin + {HOUR}",
    "pairs_": "SELECT x.facility AS a, y.facility AS b FROM er x JOIN er y ON x.pos < y.pos WHERE x.facility IN (SELECT facility FROM dev) AND y.facility IN (SELECT facility FROM dev)",
    "tests_": "SELECT 'co_deviation' AS family, a AS leader, b AS follower, 0 AS lag_hours FROM pairs_ UNION ALL SELECT 'same_time_change', a, b, 0 FROM pairs_ UNION ALL "
    + " UNION ALL ".join(f"SELECT 'lagged_change', a, b, {k} FROM pairs_ UNION ALL SELECT 'lagged_change', b, a, {k} FROM pairs_" for k in b.PAIRS.lags),
}


def _kinds(name: str, select: str) -> None:
    """Values of both kinds of series as one, ``select`` naming the value."""
    PARTS[name] = f"SELECT 'co_deviation' AS kind, facility, bin, {select} AS v FROM dev UNION ALL SELECT 'change', facility, bin, {select} FROM chg"
    PARTS[f"{name}_al"] = f"""SELECT t.family, leader, follower, lag_hours, x.bin, y.bin AS y_bin, x.kind, x.v AS x, y.v AS y FROM tests_ t JOIN {name} x ON x.facility = leader AND x.kind = CASE WHEN family = 'co_deviation' THEN family ELSE 'change' END
      JOIN {name} y ON y.facility = follower AND y.kind = x.kind AND y.bin = x.bin + lag_hours * {HOUR}"""


_kinds("lv", "deviation")
_kinds("dm", f"deviation - avg(deviation) OVER (PARTITION BY facility, hour({_LOCAL.format('make_timestamp(bin * 1000000)')}))")
PARTS["swing_"] = f"""SELECT a.*, swing FROM lv_al a LEFT JOIN (SELECT q.family, q.leader, q.follower, q.lag_hours, q.bin, median(o.v) AS swing FROM lv_al q JOIN lv o ON o.kind = q.kind AND o.bin = q.y_bin AND o.facility NOT IN (q.leader, q.follower)
      GROUP BY ALL HAVING count(*) >= {b.PAIRS.minimum_others}) z ON z.family = a.family AND z.leader = a.leader AND z.follower = a.follower AND z.lag_hours = a.lag_hours AND z.bin = a.bin"""
_TEST = "family, leader, follower, lag_hours"


def _rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY {_TEST} ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {_TEST}, {c}) - 1) / 2.0::DOUBLE"


def _corr(a: str, o: str, only: str = "true") -> str:
    return f"CASE WHEN stddev_pop({a}) FILTER ({only}) > 0 AND stddev_pop({o}) FILTER ({only}) > 0 THEN corr({a}, {o}) FILTER ({only}) END"


def _correlated(rows: str, control: bool) -> str:
    extra = f", {_rank('swing')} AS rc" if control else ""
    more = f", {_corr('rx', 'rc')} AS rxc, {_corr('ry', 'rc')} AS ryc" if control else ""
    r = "CASE WHEN abs(rxc) < 1 AND abs(ryc) < 1 THEN (rxy - rxc * ryc) / sqrt((1 - rxc * rxc) * (1 - ryc * ryc)) END" if control else "rxy"
    lag1 = lambda p, v: f"CASE WHEN count({p}) > 2 THEN coalesce({_corr(p, v, f'{p} IS NOT NULL')}, 0) ELSE 0 END"
    return f"""SELECT {_TEST}, CASE WHEN n >= 4 THEN {r} END AS r, CASE WHEN n >= 4 THEN CASE WHEN ax * ay > -1 THEN least(n, n * (1 - ax * ay) / (1 + ax * ay)) ELSE n END END AS n_eff FROM (
      SELECT {_TEST}, count(*) AS n, {_corr("rx", "ry")} AS rxy, {lag1("px", "rx")} AS ax, {lag1("py", "ry")} AS ay{more} FROM (
      SELECT *, CASE WHEN lag(bin) OVER o = bin - {HOUR} THEN lag(rx) OVER o END AS px, CASE WHEN lag(bin) OVER o = bin - {HOUR} THEN lag(ry) OVER o END AS py FROM (
      SELECT *, {_rank("x")} AS rx, {_rank("y")} AS ry{extra} FROM {rows} {"WHERE swing IS NOT NULL" if control else ""}) WINDOW o AS (PARTITION BY {_TEST} ORDER BY bin)) GROUP BY {_TEST})"""


PARTS |= {
    "cmain": _correlated("lv_al", False),
    "cpart": _correlated("swing_", True),
    "cres": _correlated("dm_al", False),
    "csup": f"SELECT {_TEST}, sum(k)::BIGINT AS bins, count(*) FILTER (k >= {b.PAIRS.minimum_day_bins}) AS days FROM (SELECT {_TEST}, bin // {DAY} AS day, count(*) AS k FROM lv_al GROUP BY ALL) GROUP BY {_TEST}",
    "ctest": f"""SELECT t.*, coalesce(bins, 0) AS bins, coalesce(days, 0) AS days, coalesce(bins >= {b.PAIRS.minimum_bins} AND days >= {b.PAIRS.minimum_days}, false) AS ok, cmain.r AS r, cmain.n_eff AS n_eff, cpart.r AS sr, cpart.n_eff AS sn, cres.r AS rr, cres.n_eff AS rn
      FROM tests_ t LEFT JOIN csup USING ({_TEST}) LEFT JOIN cmain USING ({_TEST}) LEFT JOIN cpart USING ({_TEST}) LEFT JOIN cres USING ({_TEST})""",
}


_L = "lv_al WHERE family = 'co_deviation'"
_SAME = lambda a, o: " AND ".join(f"{a}.{c} = {o}.{c}" for c in _TEST.split(", "))
_OF = lambda a: ", ".join(f"{a}.{c}" for c in _TEST.split(", "))
PARTS |= {
    "cbd": f"SELECT {_TEST}, day, row_number() OVER (PARTITION BY {_TEST} ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY {_TEST}) AS size FROM (SELECT DISTINCT {_TEST}, bin // {DAY} AS day FROM {_L})",
    "cbp": f"""SELECT {_TEST}, resample, k, count(*) AS m FROM (
      SELECT {_TEST}, resample, ('0x' || substr(md5('{b.PAIRS.seed}:' || family || '|' || leader || '|' || follower || '|' || lag_hours || ':' || resample || ':' || j), 1, 8))::BIGINT % size AS k
      FROM (SELECT *, unnest(range(size)) AS j FROM (SELECT DISTINCT {_TEST}, size FROM cbd) z, range({b.PAIRS.resamples}) y(resample))) GROUP BY ALL""",
    "cbr": f"SELECT {_OF('p')}, resample, m, x, y FROM cbp p JOIN cbd d ON d.k = p.k AND {_SAME('d', 'p')} JOIN lv_al l ON l.bin // {DAY} = d.day AND {_SAME('l', 'd')}",
    "cbk": "SELECT *, " + ", ".join(f"sum(m) OVER (PARTITION BY {_TEST}, resample ORDER BY {c}) - (sum(m) OVER (PARTITION BY {_TEST}, resample, {c}) + 1) / 2.0::DOUBLE AS r{c}" for c in "xy") + " FROM cbr",
    "cbc": f"""SELECT {_TEST}, list_sort(list(c / sqrt(va * vb)) FILTER (va > 1e-6 AND vb > 1e-6)) AS v FROM (
      SELECT {_TEST}, sum(m * rx * ry) - sum(m * rx) * sum(m * ry) / sum(m) AS c, sum(m * rx * rx) - sum(m * rx) ** 2 / sum(m) AS va, sum(m * ry * ry) - sum(m * ry) ** 2 / sum(m) AS vb FROM cbk GROUP BY {_TEST}, resample) GROUP BY {_TEST}""",
}


def _z(r: str, n: str, controls: int) -> str:
    """The argument of the error function for the p of a correlation."""
    return f"CASE WHEN ok AND {r} IS NOT NULL AND {n} - 3 - {controls} > 0 THEN abs(atanh(greatest(-0.999999, least(0.999999, {r})))) * sqrt({n} - 3 - {controls}) / sqrt(2.0::DOUBLE) END"


def _erfc(z: str) -> str:
    """One less the series of odd double factorials, or the continued fraction."""
    log_factorial = "(lgamma(2 * k + 2) - k * ln(2.0::DOUBLE) - lgamma(k + 1))"
    series = f"list_sum(list_transform(range(0, 81), lambda k: exp((2 * k + 1) * ln({z}) + k * ln(2.0::DOUBLE) - {log_factorial})))"
    fraction = f"list_reduce(list_transform(range(80, 0, -1), lambda k: k::DOUBLE), lambda f, k: {z} + k / 2.0::DOUBLE / f, {z})"
    scale = f"(exp(-{z} * {z}) / sqrt(pi()))"
    return f"CASE WHEN {z} = 0 THEN 1.0::DOUBLE WHEN {z} < 2.5 THEN 1 - 2 * {scale} * {series} ELSE {scale} / {fraction} END"


PARTS |= {
    "cz": f"SELECT *, {_z('r', 'n_eff', 0)} AS z, {_z('sr', 'sn', 1)} AS sz, {_z('rr', 'rn', 0)} AS rz FROM ctest",
    "cp": f"SELECT *, {_erfc('z')} AS p, {_erfc('sz')} AS sp, {_erfc('rz')} AS rp FROM cz",
    "cb": "SELECT *, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p, concat_ws('|', leader, follower, lag_hours::VARCHAR)) AS k, count(p) OVER (PARTITION BY family) AS m FROM cp",
    "cq": f"""SELECT x.*, CASE WHEN x.p IS NOT NULL THEN least(1.0::DOUBLE, min(x.p * x.m / x.k) OVER (PARTITION BY x.family, x.p IS NULL ORDER BY x.k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q, u.r AS reverse_r,
      coalesce(sign(x.r) * x.sr > 0 AND x.sp < {b.PAIRS.robust_p}, false) AND coalesce(sign(x.r) * x.rr > 0 AND x.rp < {b.PAIRS.robust_p}, false) AS robust, x.family <> 'lagged_change' OR coalesce(abs(x.r) > abs(u.r), false) AS dominant
      FROM cb x LEFT JOIN cb u ON x.family = 'lagged_change' AND u.family = x.family AND u.leader = x.follower AND u.follower = x.leader AND u.lag_hours = x.lag_hours AND u.ok""",
}
_ORDER[:] = list(PARTS)


_REPLAY = "facility, origin, target, horizon_minutes::INTEGER AS horizon_minutes, actual, carry_forward, daily_naive, weekly_naive, m1_median, spike"
_A, _B = f"({T1} - {3 * DAY})", f"({T1} - {DAY})"
_RUNS = f"""SELECT a, b, start, "end", hours, median_a, median_b, place::INTEGER AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY hours DESC, start) AS place FROM (
      SELECT a, b, min(bin) AS start, max(bin) + {HOUR} AS "end", count(*) AS hours, median(da) AS median_a, median(db) AS median_b FROM (
        SELECT *, bin - {HOUR} * row_number() OVER (PARTITION BY a, b ORDER BY bin) AS run FROM (
          SELECT x.facility AS a, y.facility AS b, x.bin, x.deviation AS da, y.deviation AS db FROM dev x JOIN dev y ON x.facility < y.facility AND x.bin = y.bin WHERE x.deviation >= 0 AND y.deviation >= 0)) GROUP BY a, b, run)) WHERE place <= 5"""

SELECTS = {
    "slot_series": f"SELECT facility, slot, {_seconds('us')} AS \"at\", value, local_date::VARCHAR AS local_date, local_hour FROM s",
    "local_calendar_dst": f"""SELECT l::DATE::VARCHAR AS local_date, hour(l)::INTEGER AS local_hour, count(*) AS n_slots FROM (
        SELECT {_LOCAL.format("t")} AS l FROM (SELECT unnest(range(TIMESTAMP '2026-03-06', TIMESTAMP '2026-03-11', INTERVAL 15 MINUTE)) AS t UNION ALL SELECT unnest(range(TIMESTAMP '2026-10-30', TIMESTAMP '2026-11-04', INTERVAL 15 MINUTE))))
        WHERE l::DATE BETWEEN DATE '2026-03-07' AND DATE '2026-03-09' OR l::DATE BETWEEN DATE '2026-10-31' AND DATE '2026-11-02' GROUP BY ALL""",
    "usual_models": _usual("m"),
    "usual_models_default_policy": _usual("mdefault"),
    "compare_readings": f"SELECT facility, {_seconds('us')} AS \"at\", value, name AS \"group\", round(delta, 6) AS delta, round(CASE WHEN sufficient THEN percentile END, 6) AS percentile, unusual FROM c",
    "recent_trend": f"SELECT facility, {_seconds('us')} AS \"at\", value, state, round(delta, 6) AS delta, samples FROM tr",
    "replay_summary": """SELECT facility, count(*) AS comparisons, count(*) FILTER (sufficient) AS supported, round(avg(abs(delta)), 6) AS mean_abs_deviation, round(median(abs(delta)), 6) AS median_abs_deviation,
        count(*) FILTER (sufficient AND value BETWEEN low AND high) AS in_band, count(*) FILTER (unusual IN ('above_usual', 'below_usual')) AS unusual FROM c GROUP BY facility""",
    "threshold_sensitivity": """SELECT tail::INTEGER AS tail, minutes::INTEGER AS minutes, count(*) AS compared, count(*) FILTER ((percentile >= 100 - tail AND delta >= minutes) OR (percentile <= tail AND delta <= -minutes)) AS unusual
        FROM c, (VALUES (5), (10), (20)) t(tail), (VALUES (5), (10), (20)) u(minutes) WHERE percentile IS NOT NULL GROUP BY ALL""",
    "trend_reversals": """SELECT facility, count(*) FILTER (state = 'rising') AS rising, count(*) FILTER (state = 'falling') AS falling, count(*) FILTER (state = 'little_change') AS little_change,
        count(*) FILTER (moving) AS followed, count(*) FILTER (moving AND state <> after) AS reversed FROM (
        SELECT *, coalesce(state IN ('rising', 'falling') AND after IN ('rising', 'falling') AND after_us - us < 7200000000, false) AS moving FROM (
        SELECT *, lead(state) OVER o AS after, lead(us) OVER o AS after_us FROM tr WINDOW o AS (PARTITION BY facility ORDER BY us))) GROUP BY facility""",
    "supported_keys": "SELECT facility, local_date::VARCHAR AS local_date, local_hour FROM m WHERE sufficient AND local_date <= (SELECT d1 FROM sp) INTERSECT SELECT facility, local_date::VARCHAR, local_hour FROM mstrict WHERE sufficient",
    "movement_pairs": f"SELECT facility, horizon_minutes::INTEGER AS horizon_minutes, {_seconds('us')} AS \"at\", change FROM mv",
    "recent_stability": f"""SELECT facility, horizon_minutes::INTEGER AS horizon_minutes, pairs, days, CASE WHEN ok THEN q5 END AS median_abs_change, CASE WHEN ok THEN round(q9, 6) END AS p90_abs_change, CASE WHEN ok THEN round(rise, 6) END AS rise_share, CASE WHEN ok THEN round(fall, 6) END AS fall_share
        FROM (SELECT *, pairs >= {b.MOVES.minimum_pairs} AND days >= {b.MOVES.minimum_days} AS ok FROM (
          SELECT facility, horizon_minutes, count(*) AS pairs, count(DISTINCT local_date) AS days, quantile_cont(abs(change), 0.5) AS q5, quantile_cont(abs(change), 0.9) AS q9, avg((change >= 10)::INTEGER) AS rise, avg((change <= -10)::INTEGER) AS fall
          FROM mvr GROUP BY ALL))""",
    "movement_stability": f"""SELECT facility, horizon_minutes::INTEGER AS horizon_minutes, pairs, days, CASE WHEN ok THEN q5 END AS median_abs_change, CASE WHEN ok THEN round(q9, 6) END AS p90_abs_change, CASE WHEN ok THEN round(rise, 6) END AS rise_share, CASE WHEN ok THEN round(fall, 6) END AS fall_share
        FROM (SELECT *, pairs >= {b.MOVES.minimum_pairs} AND days >= {b.MOVES.minimum_days} AS ok FROM (
          SELECT facility, horizon_minutes, count(*) AS pairs, count(DISTINCT local_date) AS days, quantile_cont(abs(change), 0.5) AS q5, quantile_cont(abs(change), 0.9) AS q9, avg((change >= 10)::INTEGER) AS rise, avg((change <= -10)::INTEGER) AS fall FROM mv GROUP BY ALL))""",
    "heatmap_cells": "SELECT facility, bin, readings, round(delta, 6) AS delta, band FROM heat",
    "heatmap_summary": """SELECT facility, count(*) FILTER (readings > 0) AS observed, count(delta) AS supported, count(*) FILTER (delta > 10) AS above, count(*) FILTER (delta < -10) AS below, round(max(delta) FILTER (delta > 10), 6) AS largest FROM heat GROUP BY facility""",
    "map_snapshot": f"""SELECT heat.facility, pos + 30.0::DOUBLE AS latitude, -90.0::DOUBLE AS longitude, CASE WHEN readings = 0 THEN 'empty' WHEN delta IS NULL THEN 'unsupported' WHEN delta > 10 THEN 'above' WHEN delta < -10 THEN 'below' ELSE 'near' END AS state
        FROM heat JOIN er ON er.facility = heat.facility WHERE bin = {T1} - 7200 AND pos <> 1 UNION ALL SELECT facility, latitude, longitude, 'unpublished' FROM reg WHERE region = 'ASIA'""",
    "area_counts": "SELECT area, bin, reporting, compared, n_above, n_below, above, below FROM abin",
    "area_tallies": """SELECT m.area, m.facility, count(point) AS reporting, count(*) FILTER (point <> 'no_range') AS compared, count(*) FILTER (point = 'above') AS above, count(*) FILTER (point = 'below') AS below
        FROM mem m LEFT JOIN st ON st.area = m.area AND st.facility = m.facility GROUP BY ALL""",
    "typical_area_count": """SELECT area, (list_sort(list(n_above) FILTER (compared > 0)))[(count(*) FILTER (compared > 0) + 1) // 2]::BIGINT AS typical, count(*) FILTER (n_above > 0) AS periods_with_above, count(*) FILTER (compared > 0) AS periods FROM abin GROUP BY area""",
    "area_now": f"""SELECT area, count(*) AS total, count(*) FILTER (now AND point = 'above') AS above, count(*) FILTER (now AND point = 'below') AS below, count(*) FILTER (now AND point <> 'no_range') AS compared,
        count(*) FILTER (now AND point = 'no_range') AS no_range, count(*) FILTER (NOT now) AS not_current, 0::BIGINT AS paused FROM (
        SELECT m.area, point, coalesce({T1} * 1000000 - us < {b.FRESH.stale_after_seconds}000000, false) AS now FROM mem m LEFT JOIN last_ ON last_.facility = m.facility) GROUP BY area""",
    "model_groups": """SELECT facility, name AS "group", CASE WHEN sufficient THEN 'supported' ELSE 'insufficient_history' END AS state, count(*) AS models FROM m WHERE local_date <= (SELECT d1 FROM sp) GROUP BY ALL""",
    "history_points": f"""SELECT facility, {_seconds('us')} AS "at", value, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high, round(delta, 6) AS delta, round(CASE WHEN sufficient THEN percentile END, 6) AS percentile, days, round(coverage, 9) AS coverage, name AS "group"
        FROM c WHERE us BETWEEN ({T1} - 1800 - {7 * DAY}) * 1000000 AND ({T1} - 1800) * 1000000""",
    "collection_latency": f"""SELECT k.facility, count(l) AS samples, round(quantile_cont(l, 0.5), 6) AS median_ms, round(quantile_cont(l, 0.95), 6) AS p95_ms FROM (SELECT facility FROM er UNION ALL SELECT 'absent') k
        LEFT JOIN (SELECT facility, pos % 997 AS l FROM r WHERE us BETWEEN ({T1} - 1800 - {7 * DAY}) * 1000000 AND ({T1} - 1800) * 1000000) x ON x.facility = k.facility GROUP BY k.facility""",
    "batch_gaps": """SELECT before * 900 AS "from", batch * 900 AS "to", ((batch - before) * 900)::DOUBLE AS seconds FROM (SELECT batch, lag(batch) OVER (ORDER BY batch) AS before FROM (SELECT DISTINCT batch FROM r)) WHERE (batch - before) * 900 > 1200""",
    "gap_segments": f"""SELECT facility, {_seconds("min(us)")} AS start, {_seconds("max(us)")} AS "end", count(*) AS readings FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY facility ORDER BY us ROWS UNBOUNDED PRECEDING) AS segment FROM (
        SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY facility ORDER BY us) > {HOUR}000000 THEN 1 ELSE 0 END AS fresh FROM r)) GROUP BY facility, segment""",
    "axis_range": f"""SELECT facility, round(CASE WHEN coalesce(h - l, 0) = 0 THEN 0 WHEN l < 0 THEN floor((l - (h - l) * 0.06) / step) * step ELSE 0 END, 6)::DOUBLE AS low,
        round(CASE WHEN coalesce(h - l, 0) = 0 THEN 10 WHEN h > 0 THEN ceil((h + (h - l) * 0.06) / step) * step ELSE 0 END, 6)::DOUBLE AS high FROM (
        SELECT *, pow(10::DOUBLE, floor(log10(nullif(h - l, 0)))) / 2 AS step FROM (SELECT facility, least(0, min(v)) AS l, greatest(0, max(v)) AS h FROM (
        SELECT facility, unnest([CASE WHEN t BETWEEN {_A} AND {_B} THEN value END, CASE WHEN t - t0 <= 7200 AND t0 < {_A} AND t > {_A} THEN v0 + (value - v0) * ({_A} - t0) / (t - t0) END, CASE WHEN t - t0 <= 7200 AND t0 < {_B} AND t > {_B} THEN v0 + (value - v0) * ({_B} - t0) / (t - t0) END]) AS v
        FROM (SELECT facility, value, us / 1e6 AS t, lag(us) OVER o / 1e6 AS t0, lag(value) OVER o AS v0 FROM s WINDOW o AS (PARTITION BY facility ORDER BY us))) GROUP BY facility))""",
    "axis_ticks": f"{_ticks(168, 4)} UNION ALL {_ticks(24, 4)}",
    "latest_wins": "SELECT user_id, event_type, event_id, floor(value)::INTEGER AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "duplicate_counters": f"""SELECT count(w) AS duplicate_records, count(*) FILTER (w IS NOT NULL AND w.value <> value) AS conflicting_duplicates FROM (
        SELECT value, max({{'us': us, 'pos': pos, 'value': value}}) OVER (PARTITION BY facility, us // {HOUR}000000 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM r)""",
    "first_of_hour": f"SELECT facility, us // {HOUR}000000 * {HOUR} AS hour, {_seconds('us')} AS \"at\", value FROM r QUALIFY row_number() OVER (PARTITION BY facility, us // {HOUR}000000 ORDER BY us, batch, value) = 1",
    "latest_of_bin": f"SELECT facility, us // {4 * HOUR}000000 * {4 * HOUR} AS bin, pos, value FROM r QUALIFY row_number() OVER (PARTITION BY facility, us // {4 * HOUR}000000 ORDER BY us DESC, pos DESC) = 1",
    "live_merge": f"""SELECT facility, us // {HOUR}000000 AS slot, {_seconds("us")} AS "at", value FROM (
        SELECT * FROM (SELECT facility, us, value, 1 AS prepared FROM r WHERE us // 1000000 < {T1} - {DAY} UNION ALL SELECT facility, us, value + 1, 0 FROM r WHERE us // 1000000 >= {T1} - {2 * DAY})
        QUALIFY row_number() OVER (PARTITION BY facility, us ORDER BY prepared DESC, value DESC) = 1) QUALIFY row_number() OVER (PARTITION BY facility, us // {HOUR}000000 ORDER BY us DESC, value DESC) = 1""",
    "registry_coverage": """SELECT coalesce(k.facility, n.facility) AS facility, coalesce(n, 0) AS observations, CASE WHEN k.facility IS NOT NULL THEN (SELECT count(DISTINCT batch) FROM r) - coalesce(n, 0) END AS missing_in_observed_batches, k.facility IS NOT NULL AS known
        FROM (SELECT facility FROM er WHERE pos > 0 UNION ALL SELECT 'absent') k FULL JOIN (SELECT facility, count(*) AS n FROM r GROUP BY facility) n ON n.facility = k.facility""",
    "unknown_facilities": "SELECT facility FROM er WHERE pos <= 1",
    "latest_state": 'SELECT facility, "at", value, state, round(age, 3) AS age_seconds, current, labels FROM fresh',
    "latest_health": """SELECT *, CASE WHEN configured > 0 AND fresh = configured THEN 'ok' WHEN fresh > 0 THEN 'warn' ELSE 'fail' END AS status FROM (SELECT count(*) AS configured, count("at") AS with_reading, count(*) FILTER (state = 'failed') AS failed_latest_attempt,
        count(*) FILTER ("at" IS NULL) AS missing, count(*) FILTER (current) AS fresh, max("at") AS last_success_at FROM fresh)""",
    "place_distances": f"SELECT a, b, round(km, 6) AS km, CASE WHEN km <= 50 THEN 'neighbor' WHEN km <= 150 THEN 'regional' ELSE 'distant' END AS band FROM (SELECT x.facility AS a, y.facility AS b, {_km('x', 'y')} AS km FROM reg x JOIN reg y ON x.pos < y.pos)",
    "place_separation": f"SELECT x.facility, round({_km('x', 'o', '6371000.0')}, 3) AS meters FROM reg x, (SELECT 35.0 AS latitude, -90.0 AS longitude) o",
    "neighbour_groups": 'SELECT facility, "group" FROM grp',
    "area_groups": """SELECT (row_number() OVER (ORDER BY rank, CASE WHEN rank = 1 THEN -members END, first) - 1)::INTEGER AS place, CASE rank WHEN 0 THEN 'all' WHEN 1 THEN 'near-' || names[1] ELSE 'region-' || replace(lower(area), ' ', '-') END AS key,
        CASE rank WHEN 0 THEN 'all' WHEN 1 THEN 'near' ELSE 'region' END AS kind, CASE rank WHEN 0 THEN 'All hospitals' WHEN 1 THEN array_to_string(names, ' / ') ELSE area END AS label, members, array_to_string(names, ',') AS facilities FROM (
        SELECT rank, area, count(*) AS members, min(pos) AS first, list(facility ORDER BY pos) AS names FROM (
          SELECT facility, pos, 0 AS rank, 'all' AS area FROM reg UNION ALL SELECT x.facility, x.pos, 1, y."group" FROM reg x JOIN grp y ON y.facility = x.facility UNION ALL SELECT facility, pos, 2, region FROM reg) GROUP BY rank, area)
        WHERE rank <> 1 OR members >= 3""",
    "order_rank_ties": """SELECT l_returnflag, l_linenumber, count(*) AS n, max(place) AS last, sum(place) AS total FROM (SELECT l_returnflag, l_linenumber, rank() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_quantity) - 1
        + (count(*) OVER (PARTITION BY l_returnflag, l_linenumber, l_quantity) - 1) / 2.0::DOUBLE AS place FROM lineitem) GROUP BY ALL""",
    "false_discovery": """SELECT k, family, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(p * n / rank) OVER (PARTITION BY family, p IS NULL ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) END, 9) AS q FROM (
        SELECT *, count(p) OVER (PARTITION BY family) AS n, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p, k) AS rank FROM (
        SELECT c_custkey AS k, c_nationkey AS family, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey * 7919 % 1000 + 1) / 20000.0::DOUBLE END AS p FROM customer))""",
    "value_spread": "SELECT facility, round_even(quantile_cont(value, 0.5), 2) AS median, round_even(quantile_cont(value, 0.9), 2) AS p90, min(value) AS min, max(value) AS max FROM r GROUP BY facility",
    "lower_medians": f"SELECT facility, {_LOCAL.format('ts')}::DATE::VARCHAR AS local_date, quantile_disc(value, 0.5) AS low, quantile_cont(value, 0.5) AS mid FROM r GROUP BY ALL",
    "argmin_argmax": "SELECT facility, arg_min(pos, (value, pos)) AS least, arg_max(pos, (value, pos)) AS most FROM r GROUP BY facility",
    "value_distribution": "SELECT facility, value, count(*) AS n FROM r GROUP BY ALL",
    "local_parts": f"SELECT hour(l)::INTEGER AS local_hour, isodow(l) >= 6 AS weekend, count(*) AS n FROM (SELECT {_LOCAL.format('ts')} AS l FROM r) GROUP BY ALL",
    "zero_share": "SELECT facility, avg((value // 20 = 0)::INTEGER) AS zero_share, avg((value // 20 = 0)::INTEGER) > 0.1 AS zero_heavy FROM r GROUP BY facility",
    "hourly_deviations": "SELECT facility, bin, round(deviation, 6) AS deviation FROM dev",
    "deviation_changes": f"SELECT x.facility, x.bin, round(x.deviation - y.deviation, 6) AS deviation FROM dev x JOIN dev y ON x.facility = y.facility AND x.bin = y.bin + {HOUR}",
    "demeaned_deviations": f"SELECT facility, bin, round(deviation - avg(deviation) OVER (PARTITION BY facility, hour({_LOCAL.format('make_timestamp(bin * 1000000)')})), 6) AS deviation FROM dev",
    "pair_episodes": _RUNS,
    "pair_correlations": """SELECT leader, follower, n, round(CASE WHEN n >= 4 THEN r END, 6) AS r FROM (SELECT leader, follower, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS r FROM (
        SELECT leader, follower, rank() OVER (PARTITION BY leader, follower ORDER BY x) + (count(*) OVER (PARTITION BY leader, follower, x) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY leader, follower ORDER BY y) + (count(*) OVER (PARTITION BY leader, follower, y) - 1) / 2.0 AS ry
        FROM (SELECT a.facility AS leader, c.facility AS follower, a.deviation AS x, c.deviation AS y FROM dev a JOIN dev c ON a.facility < c.facility AND a.bin = c.bin)) GROUP BY ALL)""",
    "forecast_grid": "SELECT facility, slot_end, value, collisions FROM grid",
    "forecast_replay": f"SELECT {_REPLAY} FROM rep",
    "forecast_replay_delayed": f"SELECT {_REPLAY} FROM repd",
    "forecast_scores": "SELECT * EXCLUDE (place, horizon_minutes), horizon_minutes::INTEGER AS horizon_minutes FROM scores",
    "forecast_winners": "SELECT facility, horizon_minutes::INTEGER AS horizon_minutes, model AS winner FROM scores WHERE matched_mae IS NOT NULL QUALIFY row_number() OVER (PARTITION BY facility, horizon_minutes ORDER BY matched_mae, place) = 1",
    "forecast_intervals": "SELECT facility, origin, horizon_minutes::INTEGER AS horizon_minutes, model, round(lo_80, 6) AS lo_80, round(hi_80, 6) AS hi_80, round(lo_95, 6) AS lo_95, round(hi_95, 6) AS hi_95 FROM iv WHERE lo_80 IS NOT NULL",
    "forecast_interval_scores": f"""SELECT facility, horizon_minutes::INTEGER AS horizon_minutes, model, {_metrics()}, {", ".join(f"round(avg((actual BETWEEN lo_{k} AND hi_{k})::INTEGER) FILTER (actual IS NOT NULL AND lo_{k} IS NOT NULL), 9) AS coverage_{k}, round(quantile_cont(hi_{k} - lo_{k}, 0.5) FILTER (actual IS NOT NULL AND lo_{k} IS NOT NULL), 9) AS width_{k}, count(*) FILTER (actual IS NOT NULL AND lo_{k} IS NOT NULL) AS intervals_{k}" for k in (80, 95))} FROM iv GROUP BY ALL""",
    "seasonal_autocorrelation": " UNION ALL ".join(f"SELECT x.facility, {k}::INTEGER AS lag, count(*) AS pairs, CASE WHEN count(*) > 50 THEN round(corr(x.value, y.value), 6) END AS r FROM grid x JOIN grid y ON y.facility = x.facility AND y.slot_end = x.slot_end + {k * b.CADENCE} GROUP BY x.facility" for k in (1, 4, 24, 168)),
    "seasonal_variance": """SELECT facility, round(1 - var_pop(d) / var_pop(value), 6) AS by_hour, round(1 - var_pop(e) / var_pop(value), 6) AS by_hour_and_day FROM (
        SELECT facility, value, value - avg(value) OVER (PARTITION BY facility, local_hour) AS d, value - avg(value) OVER (PARTITION BY facility, local_hour, isodow(local_date) >= 6) AS e FROM s) GROUP BY facility""",
    "travel_comparison": f"""SELECT origin, slug, drive, value AS wait, round(drive + value, 6) AS total, h::INTEGER AS horizon_minutes, round(p90, 6) AS p90, complete AND slug = nearest AS closest FROM (
        SELECT *, {_horizon("drive")} AS h FROM (SELECT *, CASE WHEN ok THEN seconds / 60 END AS drive, bool_and(ok) OVER (PARTITION BY origin) AS complete, first_value(slug) OVER (PARTITION BY origin ORDER BY seconds, slug) AS nearest FROM route)) x
        LEFT JOIN newest n ON n.facility = slug LEFT JOIN screen p ON p.facility = slug AND p.horizon_minutes = h""",
    "benefit_opportunities": f"SELECT origin, slot, day::VARCHAR AS day, profile, closest, alternative, {', '.join(f'round({c}, 6) AS {c}' for c in ('drive_c', 'drive_a', 'p90_c', 'p90_a', 'D', 'A', 'A60', 'A_stress'))} FROM opp",
    "benefit_rules": f"""SELECT period, coalesce(origin, 'all') AS origin, rule, kind, value, count(*) AS opportunities, count(*) FILTER (y) AS claims, count(DISTINCT day) FILTER (y) AS claim_days, round(avg(y::INTEGER), 9) AS claim_rate,
        round(avg((A > 0)::INTEGER) FILTER (y), 9) AS precision, round(quantile_cont(A, 0.5) FILTER (y), 9) AS median_A, round(quantile_cont(A, 0.1) FILTER (y), 9) AS p10_A, round(avg((A60 > 0)::INTEGER) FILTER (y), 9) AS later_precision,
        round(avg((A_stress > 0)::INTEGER) FILTER (y), 9) AS stress_precision, count(A60) FILTER (y) AS later_n, count(A_stress) FILTER (y) AS stress_n FROM cl GROUP BY GROUPING SETS ((period, rule, kind, value), (period, origin, rule, kind, value))""",
    "forecast_gain": """SELECT q.facility, q.horizon_minutes::INTEGER AS horizon_minutes, round(sum(top) / sum(bottom), 6) AS gain, round(any_value(low) FILTER (size > 1), 6) AS gain_low, round(any_value(high) FILTER (size > 1), 6) AS gain_high
        FROM gained q JOIN gainb g ON g.facility = q.facility AND g.horizon_minutes = q.horizon_minutes GROUP BY ALL""",
    "benefit_intervals": "SELECT t.period, t.rule, t.claims, round(low, 6) AS low, round(high, 6) AS high FROM ruled t LEFT JOIN ruleb v ON v.period = t.period AND v.rule = t.rule",
    "benefit_selection": f"""SELECT s.rule, s.claims AS discovery_claims, s.precision AS discovery_precision, c.claims, c.claim_days, c.precision, round(v.low, 6) AS low, round(v.high, 6) AS high,
        CASE WHEN c.claims IS NULL OR c.claims < {_R.confirmation_claims} OR c.claim_days < {_R.confirmation_days} THEN 'inconclusive' WHEN c.precision >= {_R.confirmation_precision} THEN 'confirmed' ELSE 'failed' END AS outcome
        FROM (SELECT t.* FROM ruled t JOIN ruleb v ON v.period = t.period AND v.rule = t.rule WHERE t.period = 'discovery' AND t.claims >= {_R.minimum_claims} AND t.claim_days >= {_R.minimum_days}
              AND t.precision >= {_R.minimum_precision} AND v.low >= {_R.minimum_lower_bound} ORDER BY t.claims DESC, t.kind <> 'fixed', t.value DESC LIMIT 1) s
        LEFT JOIN (SELECT * FROM ruled WHERE period = 'confirmation') c ON c.rule = s.rule LEFT JOIN (SELECT * FROM ruleb WHERE period = 'confirmation') v ON v.rule = s.rule""",
    "forecast_gate_scores": f"""SELECT q.*, coalesce(matched, 0) AS matched, days, b_mae, b_rmse, c_mae, c_rmse, availability, coverage_80, coverage_95 FROM (SELECT DISTINCT facility, horizon_minutes::INTEGER AS horizon_minutes, 'carry_forward' AS benchmark, 'm1_median' AS candidate FROM long) q
        LEFT JOIN (SELECT b.facility, b.horizon_minutes, count(*) AS matched, count(DISTINCT b.origin // {DAY}) AS days, round(avg(abs(b.prediction - b.actual)), 9) AS b_mae, round(sqrt(avg((b.prediction - b.actual) ** 2)), 9) AS b_rmse,
                          round(avg(abs(k.prediction - b.actual)), 9) AS c_mae, round(sqrt(avg((k.prediction - b.actual) ** 2)), 9) AS c_rmse FROM long b JOIN long k ON k.facility = b.facility AND k.horizon_minutes = b.horizon_minutes AND k.origin = b.origin
                   WHERE b.model = 'carry_forward' AND k.model = 'm1_median' AND b.actual IS NOT NULL AND b.prediction IS NOT NULL AND k.prediction IS NOT NULL GROUP BY ALL) m ON m.facility = q.facility AND m.horizon_minutes = q.horizon_minutes
        LEFT JOIN (SELECT facility, horizon_minutes, round(count(prediction) FILTER (actual IS NOT NULL) / nullif(count(actual), 0), 9) AS availability, {", ".join(f"round(avg((actual BETWEEN lo_{k} AND hi_{k})::INTEGER) FILTER (actual IS NOT NULL AND lo_{k} IS NOT NULL), 9) AS coverage_{k}" for k in (80, 95))}
                   FROM iv WHERE model = 'm1_median' GROUP BY ALL) o ON o.facility = q.facility AND o.horizon_minutes = q.horizon_minutes""",
    "training_support": "SELECT facility, fit, whole, supported FROM sup",
    "profile_forecasts": f"""SELECT q.facility, 'profile_ar' AS model, origin, target, horizon_minutes::INTEGER AS horizon_minutes, round(CASE WHEN g.value IS NOT NULL AND then_.usual IS NOT NULL AND beta IS NOT NULL THEN greatest(0, then_.usual + beta * (g.value - now_.usual)) END, 6) AS prediction
        FROM (SELECT *, {MIDNIGHT} + {15 * DAY} + (origin - {_START}) // {DAY} * {DAY} AS fit, {_cell("origin")} AS now_cell, {_cell("target")} AS then_cell FROM (SELECT facility, origin, horizon_minutes, origin + 60 * horizon_minutes AS target
              FROM (SELECT DISTINCT facility FROM grid) f, (SELECT unnest(range({_START}, {_STOP}, {_F.origin_seconds})) AS origin) x, {_HORIZONS})) q
        LEFT JOIN grid g ON g.facility = q.facility AND g.slot_end = origin LEFT JOIN pcell now_ ON now_.facility = q.facility AND now_.fit = q.fit AND now_.cell = now_cell
        LEFT JOIN pcell then_ ON then_.facility = q.facility AND then_.fit = q.fit AND then_.cell = then_cell LEFT JOIN pbeta p ON p.facility = q.facility AND p.fit = q.fit AND p.step = horizon_minutes * 60 // {b.CADENCE} WHERE target < {_STOP}""",
    "pair_bootstrap": f"SELECT {_TEST.replace('lag_hours', 'lag_hours::INTEGER AS lag_hours')}, " + ", ".join(f"CASE WHEN len(v) >= 20 THEN round(v[floor({q}::DOUBLE * (len(v) - 1))::BIGINT + 1], 6) END AS {n}" for q, n in ((0.025, "low"), (0.975, "high"))) + " FROM cbc",
    "pair_effects": f"""SELECT {_TEST.replace("lag_hours", "lag_hours::INTEGER AS lag_hours")}, bins, days, CASE WHEN ok THEN 'tested' ELSE 'insufficient_support' END AS state, round(CASE WHEN ok THEN r END, 6) AS r, round(CASE WHEN ok THEN n_eff END, 6) AS n_eff, round(CASE WHEN ok THEN sr END, 6) AS system_r, round(CASE WHEN ok THEN rr END, 6) AS residual_r,
        (SELECT round(CASE WHEN u.ok THEN u.r END, 6) FROM ctest u WHERE u.family = 'lagged_change' AND t.family = u.family AND u.leader = t.follower AND u.follower = t.leader AND u.lag_hours = t.lag_hours) AS reverse_r FROM ctest t""",
    "pair_tests": f"""SELECT {_TEST.replace("lag_hours", "lag_hours::INTEGER AS lag_hours")}, bins, days, CASE WHEN ok THEN 'tested' ELSE 'insufficient_support' END AS state, {", ".join(f"round(CASE WHEN ok THEN {v} END, 6) AS {n}" for v, n in (("r", "r"), ("n_eff", "n_eff"), ("p", "p"), ("sr", "system_r"), ("sp", "system_p"), ("rr", "residual_r"), ("rp", "residual_p"), ("q", "q")))},
        round(reverse_r, 6) AS reverse_r, ok AND robust AS robust, CASE WHEN ok THEN dominant ELSE family <> 'lagged_change' END AS dominant, ok AND coalesce(q <= {b.PAIRS.fdr_q} AND abs(r) >= {b.PAIRS.discovery_effect}, false) AND robust AND dominant AS candidate FROM cq""",
    "series_support": f"""SELECT k.facility, coalesce(n, 0) AS bins, round(z, 9) AS zero_share, round(coalesce(l, 0), 6) AS lag1 FROM er k LEFT JOIN (SELECT facility, count(*) AS n FROM dev GROUP BY facility) d ON d.facility = k.facility
        LEFT JOIN (SELECT facility, avg((value = 0)::INTEGER) AS z FROM r GROUP BY facility) y ON y.facility = k.facility
        LEFT JOIN (SELECT x.facility, CASE WHEN count(*) > 2 THEN coalesce({_corr("y.deviation", "x.deviation")}, 0) ELSE 0 END AS l FROM dev x JOIN dev y ON x.facility = y.facility AND x.bin = y.bin + {HOUR} GROUP BY x.facility) q ON q.facility = k.facility""",
    "history_records": "SELECT batch * 900000000 AS batch, facility, us AS observed, value AS wait_minutes, (pos % 997)::INTEGER AS latency_ms FROM r QUALIFY row_number() OVER (PARTITION BY batch, facility ORDER BY us DESC) = 1",
    "history_counters": "SELECT count(*) - count(DISTINCT (batch, facility)) AS duplicate_records, 0::BIGINT AS rejected_records, 0::BIGINT AS issues FROM r",
    "history_partitions": f"""SELECT d::DATE::VARCHAR AS dt, CASE WHEN k IS NULL THEN 'missing' WHEN d::DATE = first AND d::DATE < today THEN 'compacted' ELSE 'raw' END AS source, CASE WHEN k IS NULL THEN 'missing' WHEN d::DATE >= today THEN 'open_day' WHEN d::DATE = first THEN 'snapshot_matches_raw' ELSE 'raw_snapshot' END AS completeness
        FROM (SELECT unnest(range(make_timestamp({MIDNIGHT} * 1000000), make_timestamp({T1} * 1000000), INTERVAL 1 DAY)) AS d) x LEFT JOIN (SELECT DISTINCT make_timestamp(batch * 900000000)::DATE AS k FROM r) y ON k = d::DATE, (SELECT make_timestamp(min(batch) * 900000000)::DATE AS first, make_timestamp({T1} * 1000000)::DATE AS today FROM r) z""",
    "collection_summary": """SELECT count(*) AS expected_facilities, sum(coalesce(n, 0))::BIGINT AS records, count(*) FILTER (bad = 0) AS success, count(*) FILTER (bad > 0 AND bad < n) AS partial, count(*) FILTER (n IS NULL OR bad = n) AS failed
        FROM er LEFT JOIN (SELECT facility, count(*) AS n, count(*) FILTER (value < 0) AS bad FROM r WHERE batch = (SELECT max(batch) FROM r) GROUP BY facility) x ON x.facility = er.facility""",
    "route_changes": """SELECT origin, slug, before, after, after - before AS change, round(after / before, 9) AS ratio FROM (SELECT g.facility AS origin, e.facility AS slug, 600 + g.pos * 300 + e.pos * 900 AS before, 600 + g.pos * 420 + e.pos * 900 AS after FROM reg g JOIN er e ON (g.pos + e.pos) % 5 <> 0 AND (g.pos + e.pos) % 7 <> 0)""",
    "entrance_review": f"""SELECT slug, pos, latitude, method, reviewed_on, CASE WHEN method IS NOT NULL THEN round({_km("c", "e", "6371000.0")}, 3) END AS meters FROM (SELECT facility AS slug, pos, CASE WHEN pos % 5 = 0 THEN round(latitude + pos / 2000, 6) END AS latitude, CASE WHEN pos % 5 = 0 THEN 'site_visit' END AS method, CASE WHEN pos % 5 = 0 THEN '2024-01-02' END AS reviewed_on,
        {{'latitude': latitude, 'longitude': longitude}} AS c, {{'latitude': CASE WHEN pos % 5 = 0 THEN latitude + pos / 2000 END, 'longitude': longitude}} AS e FROM reg)""",
    "destination_eligibility": """SELECT facility AS slug, CASE WHEN pos % 11 = 1 THEN 'No published wait time · map only' WHEN pos % 13 = 2 THEN 'Active emergency service unverified' WHEN pos % 6 = 4 THEN 'Age applicability unverified or unsuitable' WHEN pos % 9 = 5 THEN 'Destination verification missing'
        WHEN pos * 4 > 90 THEN 'Destination verification expired' WHEN pos % 5 = 0 THEN CASE WHEN pos % 7 <> 3 AND pos / 2000 * 6371000 * pi() / 180 > 1000 THEN 'Emergency entrance too far from campus' END WHEN pos % 7 = 3 THEN 'Arrival location unavailable' END AS reason,
        CASE WHEN pos % 5 = 0 THEN 'entrance' WHEN pos % 7 <> 3 THEN 'campus' END AS arrival FROM reg""",
    "place_features": "SELECT facility AS slug, 'campus' AS kind, latitude FROM reg UNION ALL SELECT facility, 'entrance', latitude + pos / 2000 FROM reg WHERE pos % 5 = 0",
    "scraped_numbers": r"""SELECT page_id, CASE WHEN len(f) = 0 THEN 'missing' WHEN len(f) > 1 THEN 'conflict' WHEN f[1] = '-1' THEN 'invalid' ELSE 'ok' END AS status, CASE WHEN len(f) = 1 AND f[1] <> '-1' THEN TRY_CAST(f[1] AS INTEGER) END AS minutes
        FROM (SELECT page_id, list_distinct(regexp_extract_all(url, '\?page=(-?\d+)', 1)) AS f FROM pages)""",
    "json_property": r"SELECT event_id, CASE WHEN regexp_full_match(k, '[+-]?\d+') THEN TRY_CAST(k AS INTEGER) END AS k FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)",
    "top_pairs_by_route": "SELECT c_nationkey, o_orderpriority, count(*) AS orders, min(o_orderkey) AS first FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY orders DESC, c_nationkey, o_orderpriority LIMIT 20",
}
ORACLES: dict[str, str] = {name: _with(select) for name, select in SELECTS.items()}
