"""The queries of the catalogue in DuckDB SQL, as chains of common table expressions."""

from __future__ import annotations

from math import log10

#: Constants of the published definitions, written out here so that the comparison does not rest on the library's own.
COUNTRIES = ["AUS", "DEU", "ESP", "FRA", "GBR", "JPN", "NLD", "SWE", "TWN", "USA"]
SHARES = {
    "USA": 0.416723038548721, "JPN": 0.1600502537374388, "DEU": 0.10440386812912543, "GBR": 0.08347925503431211,
    "FRA": 0.08105224253089227, "ESP": 0.058863593224739726, "AUS": 0.03107225947862733, "TWN": 0.029903041019936665,
    "NLD": 0.02174295481940657, "SWE": 0.012709493476800057,
}
CALIPER = "CASE scope_group WHEN 'all' THEN 1 WHEN 'inactive' THEN 1 WHEN 'moderate' THEN 2 WHEN 'active' THEN 4 END"


def _spaced(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


DISTANCE_KM = [10.0**x for x in _spaced(log10(0.1), log10(300.0), 15)]
DURATION_MIN = [10.0**x for x in _spaced(log10(1.0), log10(4320.0), 15)]
REWARD_LOG = _spaced(log10(0.2 * 30), log10(300 * 30), 30)

K = "useruuid, gender, GID_0, start_month"
UM = "useruuid, start_month"
TIMES, LEAST, SHARE = 10, 2, 0.2
#: Shuffles of match_significance.
SHUFFLES = 1000
PRIME = 2147483647


def km(a: str, b: str, c: str, d: str) -> str:
    """Kilometres between (a, b) and (c, d) in degrees."""
    x, y, dl = f"radians({a})", f"radians({c})", f"radians({b}) - radians({d})"
    cosine = f"sin({x}) * sin({y}) + cos({x}) * cos({y}) * cos({dl})"
    return f"CASE WHEN {a} = {c} AND {b} = {d} THEN 0.0::DOUBLE ELSE 6371.0::DOUBLE * acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {cosine}))) END"


def on(keys: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


def mixed(place: str, turn: str, seed: int = 0) -> str:
    x = f"(({place} * 1103515245 + {turn} * {40503 * 65537} + {seed}) % {PRIME})"
    for r in range(3):
        x = f"(({x} * {x} + {12345 + 7919 * r} + {place} + 31 * {turn}) % {PRIME})"
    return x


def efficiency(cost: str, reward: str) -> str:
    return f"CASE WHEN {reward} > 0 AND {cost} > 0 AND {reward} >= {cost} AND {reward} <> 1 THEN 1 - log10({cost}) / log10({reward}) END"


def upper_edges(x: str, parts: int) -> str:
    """Aggregate: distinct quantiles above the minimum, ascending."""
    cuts = ", ".join(f"{i / parts}::DOUBLE" for i in range(parts + 1))
    q = f"quantile_cont({x}::DOUBLE, [{cuts}])"
    return f"list_sort(list_distinct(list_filter({q}, lambda e: e > min({x}))))"


def bin_of(x: str, edges: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(1 + len(list_filter({edges}, lambda e: e < {x})) AS BIGINT) END"


def fixed_bin(x: str, cuts: list[float]) -> str:
    below = " + ".join(f"({x} > {c!r}::DOUBLE)::BIGINT" for c in cuts)
    return f"CASE WHEN {x} >= {cuts[0]!r}::DOUBLE AND {x} <= {cuts[-1]!r}::DOUBLE THEN greatest({below} - 1, 0) END"


def reward_bin(x: str) -> str:
    return fixed_bin(f"(CASE WHEN {x} > 0 THEN log10({x}) END)", REWARD_LOG)


_COUNTRY = "[" + ", ".join(f"'{c}'" for c in COUNTRIES) + "]"
_SPLIT = f"""
  SELECT {K}, t.s, t.e, t.loc FROM walk t WHERE s IS NOT NULL"""
_PEOPLE = ", ".join(f"('{c}', {n!r}::DOUBLE)" for c, n in SHARES.items())
_NIGHT = "((({t}) // 86400) * 21600 + least(({t}) % 86400, 21600))"


def _night(a: str = "start", b: str = '"end"') -> str:
    return f"({_NIGHT.format(t=b)} - {_NIGHT.format(t=a)})"


def boots(source: str, scope: str, order: str, of: str, seed: int = 0, times: int = TIMES, where: str = "TRUE") -> str:
    """CTEs num, draw, drawn: source resampled within scope; drawn has `b`; value per scope and b in `each_b`."""
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY {order}) - 1 AS place, count(*) OVER (PARTITION BY {scope}) AS nn
  FROM {source} WHERE {where}),
drawn AS (SELECT d.b, r.* FROM (SELECT num.*, t.b, {mixed("num.place", "t.b", seed)} % nn AS goal FROM num, (SELECT unnest(range({times})) AS b) t) d
  JOIN num r ON r.place = d.goal AND {on(scope, "d", "r")}),
each_b AS (SELECT {scope}, b, {of} AS value FROM drawn GROUP BY {scope}, b)"""


#: Name -> body of a common table expression; each may use those before it.
CTE: dict[str, str] = {
    "ev": """SELECT e.event_id, e.user_id, CAST(epoch(date_trunc('second', e.ts)) AS BIGINT) AS st, e.value,
  CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k, CAST(c.c_nationkey AS BIGINT) AS nk
  FROM events e JOIN customer c ON c.c_custkey = e.user_id""",
    "raw0": """SELECT *, CASE WHEN event_id % 97 = 0 THEN -1 WHEN event_id % 89 = 0 THEN NULL ELSE (k * k) // 625 END AS loc,
  least(st + 60 + CAST(floor(value * 600) AS BIGINT), lead(st) OVER (PARTITION BY user_id ORDER BY st, event_id)) AS fin FROM ev""",
    "raw": f"""SELECT CAST(user_id AS VARCHAR) AS useruuid, event_id, CAST(loc AS BIGINT) AS loc, st AS start, fin AS "end",
  nk * 7 % 100 - 50 + (loc * 37 % 101 - 50) * 0.002::DOUBLE AS latitude,
  nk * 13 % 300 - 150 + (loc * 53 % 101 - 50) * 0.003::DOUBLE AS longitude,
  (nk % 10 - 5) * 3600 AS timezone,
  CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'FEMALE' ELSE 'MALE' END AS gender,
  {_COUNTRY}[nk % 10 + 1] AS GID_0, lpad(CAST(user_id % 4 AS VARCHAR), 2, '0') AS user_group FROM raw0""",
    "valid": "SELECT * FROM raw WHERE loc IS NOT NULL AND loc <> -1",
    "loc0": 'SELECT * REPLACE (start + timezone AS start, "end" + timezone AS "end") FROM valid',
    "local": """SELECT *, start // 86400 * 86400 AS start_day, (start - 345600) // 604800 * 604800 + 345600 AS start_week,
  CAST(epoch(date_trunc('month', TIMESTAMP '1970-01-01' + to_seconds(start))) AS BIGINT) AS start_month,
  CAST(start % 86400 // 14400 * 4 AS INTEGER) AS start_hour_bin,
  CASE WHEN dayofweek(TIMESTAMP '1970-01-01' + to_seconds(start)) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS weekday_weekend,
  CAST(dayofmonth(last_day(TIMESTAMP '1970-01-01' + to_seconds(start))) AS INTEGER) AS days FROM loc0""",
    "s": "SELECT * FROM local WHERE gender IS NOT NULL",
    "med": f"SELECT {K}, loc, median(latitude) AS mlat, median(longitude) AS mlon FROM s GROUP BY {K}, loc",
    "st0": f"""SELECT s.*, mlat, mlon, lag(s.loc) OVER w AS prev_loc, lag(s."end") OVER w AS prev_end, lag(mlat) OVER w AS plat, lag(mlon) OVER w AS plon,
  lead(s.loc) OVER w AS next_loc, lead(mlat) OVER w AS nlat, lead(mlon) OVER w AS nlon, row_number() OVER w AS rn
  FROM s JOIN med ON {on(K + ", loc", "s", "med")}
  WINDOW w AS (PARTITION BY s.useruuid, s.gender, s.GID_0, s.start_month ORDER BY s.start, s.event_id)""",
    "st": f"SELECT *, {km('plat', 'plon', 'mlat', 'mlon')} AS km, {km('mlat', 'mlon', 'nlat', 'nlon')} AS next_km FROM st0",
    "mob": f"""SELECT {K}, count(loc) AS visits, count(DISTINCT loc) AS locations, CAST(sum("end" - start) AS BIGINT) AS total_stay_time,
  round(sum("end" - start) / (86400.0::DOUBLE * max(days)), 6) AS coverage_stay_time,
  CAST(coalesce(sum(CASE WHEN start - prev_end >= 0 AND start - prev_end < 43200 THEN start - prev_end END), 0) AS BIGINT) AS total_travel_time,
  round(sum(CASE WHEN prev_loc IS NOT NULL AND prev_loc <> loc THEN km END), 5) AS cost0 FROM st GROUP BY {K}""",
    "mobility": "SELECT *, CASE WHEN cost0 < 0.1 THEN 0.0::DOUBLE ELSE cost0 END AS total_cost_travel_distance FROM mob",
    "nightly": f"SELECT {K}, loc, CAST(sum({_night()}) AS BIGINT) AS night FROM s GROUP BY {K}, loc",
    "night1": f"""SELECT *, sum(night) OVER (PARTITION BY {K}) AS total, row_number() OVER (PARTITION BY {K} ORDER BY night DESC, loc) AS first FROM nightly""",
    "home": f"""SELECT {K}, loc AS home_loc, round(CAST(night AS DOUBLE) / CAST(total AS DOUBLE), 6) AS night_share FROM night1
  WHERE first = 1 AND total > 0 AND night >= total * {SHARE}::DOUBLE""",
    "hw_cut": """SELECT useruuid, loc, d, start - d * 86400 AS a, "end" - d * 86400 AS b
  FROM (SELECT *, unnest(range(start // 86400, ("end" - 1) // 86400 + 1)) AS d FROM s WHERE "end" - start >= 60)""",
    "hw_spent": """SELECT useruuid, d, loc, CAST(sum(greatest(0, least(b, 21600) - greatest(a, 0))) AS BIGINT) AS h,
  CAST(sum(CASE WHEN (d + 3) % 7 < 5 THEN greatest(0, least(b, 64800) - greatest(a, 28800)) ELSE 0 END) AS BIGINT) AS w FROM hw_cut GROUP BY useruuid, d, loc""",
    "hw_h_part": """SELECT useruuid, d, loc, CAST(h AS DOUBLE) / seen AS part
  FROM (SELECT *, sum(h) OVER (PARTITION BY useruuid, d) AS seen FROM hw_spent) WHERE seen >= 0.1::DOUBLE * 21600""",
    "hw_h_days": """SELECT useruuid, d, count(*) OVER (PARTITION BY useruuid ORDER BY d RANGE BETWEEN 14 PRECEDING AND 14 FOLLOWING) AS days
  FROM (SELECT DISTINCT useruuid, d FROM hw_h_part)""",
    "hw_h_mean": """SELECT c.useruuid, c.d, p.loc, c.days, round(sum(part) / c.days, 9) AS mean, count(*) FILTER (part > 0) AS present
  FROM hw_h_days c JOIN hw_h_part p ON c.useruuid = p.useruuid AND p.d BETWEEN c.d - 14 AND c.d + 14
  WHERE c.days >= 0.1::DOUBLE * 28 GROUP BY c.useruuid, c.d, p.loc, c.days""",
    "hw_h_rank": """SELECT useruuid, d, loc, row_number() OVER (PARTITION BY useruuid, d ORDER BY mean DESC, loc) AS first
  FROM hw_h_mean WHERE mean >= 0.2::DOUBLE""",
    "hw_w_part": """SELECT useruuid, d, loc, CAST(w AS DOUBLE) / seen AS part
  FROM (SELECT *, sum(w) OVER (PARTITION BY useruuid, d) AS seen FROM hw_spent) WHERE seen >= 0.1::DOUBLE * 36000""",
    "hw_w_days": """SELECT useruuid, d, count(*) OVER (PARTITION BY useruuid ORDER BY d RANGE BETWEEN 21 PRECEDING AND 21 FOLLOWING) AS days
  FROM (SELECT DISTINCT useruuid, d FROM hw_w_part)""",
    "hw_w_mean": """SELECT c.useruuid, c.d, p.loc, c.days, round(sum(part) / c.days, 9) AS mean, count(*) FILTER (part > 0) AS present
  FROM hw_w_days c JOIN hw_w_part p ON c.useruuid = p.useruuid AND p.d BETWEEN c.d - 21 AND c.d + 21
  WHERE c.days >= 0.05::DOUBLE * 42 GROUP BY c.useruuid, c.d, p.loc, c.days""",
    "hw_w_rank": """SELECT useruuid, d, loc, row_number() OVER (PARTITION BY useruuid, d ORDER BY mean DESC, loc) AS first
  FROM hw_w_mean WHERE mean >= 0.2::DOUBLE AND present >= 0.1::DOUBLE * days""",
    "hw_home": "SELECT useruuid, d, loc AS detect_H_loc FROM hw_h_rank WHERE first = 1",
    "hw_work": """SELECT w.useruuid, w.d, arg_min(w.loc, w.first) AS detect_W_loc FROM hw_w_rank w LEFT JOIN hw_home h ON w.useruuid = h.useruuid AND w.d = h.d
  WHERE detect_H_loc IS NULL OR detect_H_loc <> w.loc GROUP BY w.useruuid, w.d""",
    "hw": """SELECT s.*, detect_H_loc, detect_W_loc, CASE WHEN s.loc = detect_H_loc THEN 'H' WHEN s.loc = detect_W_loc THEN 'W' ELSE 'O' END AS location_type
  FROM s LEFT JOIN hw_home h ON h.useruuid = s.useruuid AND h.d = s.start // 86400 LEFT JOIN hw_work w ON w.useruuid = s.useruuid AND w.d = s.start // 86400""",
    "lhome": f"""SELECT {K}, home_loc, home_lat, home_lon, total_home_time FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY total_home_time DESC, home_loc) AS r
  FROM (SELECT {K}, loc AS home_loc, CAST(sum("end" - start) AS BIGINT) AS total_home_time, median(latitude) AS home_lat, median(longitude) AS home_lon
    FROM hw WHERE location_type = 'H' GROUP BY {K}, loc)) WHERE r = 1""",
    "away": f"""SELECT st.*, h.home_loc, CASE WHEN st.loc <> h.home_loc AND (prev_loc IS NULL OR prev_loc <> st.loc)
  THEN {km("latitude", "longitude", "home_lat", "home_lon")} END AS far FROM st LEFT JOIN lhome h ON {on(K, "st", "h")}""",
    "rewards": f"""SELECT {K}, max(CASE WHEN home_loc IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS has_home, round(sum(far), 5) AS sum_home_distance,
  round(max(far), 5) AS max_home_distance, round(2 * sum(far), 5) AS total_reward_home_distance, round(2 * max(far), 5) AS max_reward_home_distance
  FROM away GROUP BY {K}""",
    "lab": f"""SELECT *, CASE WHEN {_night()} > 0 THEN loc END AS hl,
  CASE WHEN start % 86400 // 3600 >= 8 AND start % 86400 // 3600 < 18 AND weekday_weekend = 'weekday' THEN loc END AS wl FROM s""",
    "mh": f"""SELECT {UM}, hl AS detect_H_loc FROM (SELECT {UM}, hl, row_number() OVER (PARTITION BY {UM} ORDER BY count(*) DESC, hl) AS r
  FROM lab WHERE hl IS NOT NULL GROUP BY {UM}, hl) WHERE r = 1""",
    "mw": f"""SELECT {UM}, wl AS detect_W_loc FROM (SELECT {UM}, wl, row_number() OVER (PARTITION BY {UM} ORDER BY count(*) DESC, wl) AS r
  FROM lab WHERE wl IS NOT NULL GROUP BY {UM}, wl) WHERE r = 1""",
    "mv": "SELECT * FROM st WHERE next_loc IS NOT NULL AND next_loc <> loc",
    "edge": f"SELECT {K}, least(loc, next_loc) AS u, greatest(loc, next_loc) AS v, count(*) AS w FROM mv GROUP BY {K}, least(loc, next_loc), greatest(loc, next_loc)",
    "adj": f"SELECT {K}, u AS a, v AS b, w FROM edge UNION ALL SELECT {K}, v, u, w FROM edge",
    "deg": f"SELECT {K}, a, count(*) AS d FROM adj GROUP BY {K}, a",
    "basic": f"""SELECT {K}, n AS nodes, m AS edges, round(2.0::DOUBLE * m / nullif(n * (n - 1), 0), 6) AS density, CAST(m - n + 1 AS BIGINT) AS n_cycles,
  round(CAST(m - n + 1 AS DOUBLE) / m, 6) AS n_cycles_per_edge FROM (SELECT {K}, count(*) AS n, CAST(sum(d) // 2 AS BIGINT) AS m FROM deg GROUP BY {K})""",
    "edist": f"""SELECT {K}, least(loc, next_loc) AS ei, greatest(loc, next_loc) AS ej, count(*) AS trips, round(avg(next_km), 2) AS km
  FROM mv GROUP BY {K}, least(loc, next_loc), greatest(loc, next_loc)""",
    "ends": f"""SELECT {K}, node, min(lat) AS lat, min(lon) AS lon FROM (SELECT {K}, loc AS node, mlat AS lat, mlon AS lon FROM mv
  UNION ALL SELECT {K}, next_loc, nlat, nlon FROM mv) GROUP BY {K}, node""",
    "ideal": f"""SELECT a.useruuid, a.gender, a.GID_0, a.start_month, a.node AS ei, b.node AS ej, round({km("a.lat", "a.lon", "b.lat", "b.lon")}, 2) AS ideal_km
  FROM ends a JOIN ends b ON {on(K, "a", "b")} AND a.node < b.node""",
    "hop": f"""SELECT useruuid, start_month, a AS src, a AS dst, 0 AS depth FROM deg
  UNION SELECT h.useruuid, h.start_month, h.src, adj.b, h.depth + 1 FROM hop h JOIN adj ON {on(UM, "h", "adj")} AND adj.a = h.dst WHERE h.depth < 15""",
    "dist": f"SELECT {UM}, src, dst, min(depth) AS d FROM hop GROUP BY {UM}, src, dst",
    "people": f"SELECT DISTINCT {K} FROM edge",
    "run0": f"""SELECT *, row_number() OVER w AS rn, CASE WHEN lag(loc) OVER w IS NULL OR lag(loc) OVER w <> loc THEN 1 ELSE 0 END AS fresh FROM s
  WINDOW w AS (PARTITION BY {K} ORDER BY start, event_id)""",
    "run1": f"SELECT *, CAST(sum(fresh) OVER (PARTITION BY {K} ORDER BY rn) AS INTEGER) AS idx FROM run0",
    "vis": f"""SELECT {K}, idx, arg_min(loc, rn) AS loc, arg_min(start, rn) AS arr, arg_max("end", rn) AS dep, arg_min(latitude, rn) AS lat, arg_min(longitude, rn) AS lon
  FROM run1 GROUP BY {K}, idx""",
    "walk": f"""SELECT {K}, idx AS e, [loc] AS sl, [idx] AS si, CAST(NULL AS INTEGER) AS s FROM vis WHERE idx = 1
  UNION ALL SELECT w.useruuid, w.gender, w.GID_0, w.start_month, v.idx,
    CASE WHEN list_contains(w.sl, v.loc) THEN list_append(w.sl[1:list_position(w.sl, v.loc) - 1], v.loc) ELSE list_append(w.sl, v.loc) END,
    CASE WHEN list_contains(w.sl, v.loc) THEN list_append(w.si[1:list_position(w.sl, v.loc) - 1], v.idx) ELSE list_append(w.si, v.idx) END,
    CASE WHEN list_contains(w.sl, v.loc) THEN w.si[list_position(w.sl, v.loc)] END
  FROM walk w JOIN vis v ON {on(K, "w", "v")} AND v.idx = w.e + 1""",
    "tour": f"""SELECT w.useruuid, w.gender, w.GID_0, w.start_month, w.s, w.e, a.loc, a.dep - a.arr AS stay_departure, b.arr - a.dep AS total_duration,
  a.lat AS lat0, a.lon AS lon0, (SELECT string_agg(CAST(x.loc AS VARCHAR), ',' ORDER BY x.idx) FROM vis x WHERE {on(K, "x", "w")} AND x.idx BETWEEN w.s AND w.e) AS tour
  FROM walk w JOIN vis a ON {on(K, "w", "a")} AND a.idx = w.s JOIN vis b ON {on(K, "w", "b")} AND b.idx = w.e WHERE w.s IS NOT NULL""",
    "path": f"""SELECT *, round(1000 * {km("plat", "plon", "lat", "lon")}) AS step
  FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM vis WINDOW w AS (PARTITION BY {K} ORDER BY idx))""",
    "meas": f"""SELECT t.*, m.* FROM tour t, LATERAL (SELECT count(*) AS tour_total_stops,
    CAST(sum(CASE WHEN p.idx > t.s THEN p.step ELSE 0 END) AS BIGINT) AS tour_total_distance,
    CAST(2 * sum(round(1000 * {km("t.lat0", "t.lon0", "p.lat", "p.lon")})) AS BIGINT) AS tour_total_reward,
    CAST(2 * max(round(1000 * {km("t.lat0", "t.lon0", "p.lat", "p.lon")})) AS BIGINT) AS tour_max_reward
  FROM path p WHERE {on(K, "p", "t")} AND p.idx BETWEEN t.s AND t.e) m""",
    "keys_": f"SELECT DISTINCT {K}, loc FROM tour WHERE total_duration < stay_departure",
    "ktour": f"SELECT m.* FROM meas m JOIN keys_ k ON {on(K, 'm', 'k')} AND m.loc = k.loc WHERE len(list_distinct(string_split(m.tour, ','))) > 1",
    "main": f"""SELECT p.useruuid, p.gender, p.GID_0, p.start_month, b.loc AS main_keystone FROM (SELECT DISTINCT {K} FROM vis) p
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY stay DESC, loc) AS r FROM
    (SELECT v.useruuid, v.gender, v.GID_0, v.start_month, v.loc, sum(v.dep - v.arr) AS stay FROM vis v JOIN keys_ k ON {on(K, "v", "k")} AND v.loc = k.loc
     GROUP BY v.useruuid, v.gender, v.GID_0, v.start_month, v.loc)) b ON {on(K, "p", "b")} AND b.r = 1""",
    "um0": "SELECT * FROM mobility WHERE locations >= 2",
    "um1": f"SELECT *, (SELECT {upper_edges('visits', 10)} FROM um0) AS ve, (SELECT {upper_edges('locations', 10)} FROM um0) AS le FROM um0",
    "um2": f"SELECT *, {bin_of('visits', 've')} AS activity_deciles, {bin_of('locations', 'le')} AS repertoire_deciles FROM um1",
    "um": f"""SELECT * EXCLUDE (ve, le), CASE WHEN activity_deciles BETWEEN 1 AND 3 AND repertoire_deciles BETWEEN 1 AND 3 THEN 'inactive'
  WHEN activity_deciles BETWEEN 4 AND 7 AND repertoire_deciles BETWEEN 4 AND 7 THEN 'moderate'
  WHEN activity_deciles BETWEEN 8 AND 10 AND repertoire_deciles BETWEEN 8 AND 10 THEN 'active' ELSE 'other' END AS activity_repertoire_groups FROM um2""",
    "tr": f"""SELECT k.*, um.activity_repertoire_groups, CASE WHEN tour_total_stops = 3 THEN '3' || chr(10) || 'ABA' WHEN tour_total_stops = 4 THEN '4' || chr(10) || 'ABCA'
  WHEN tour_total_stops = 5 THEN '5' || chr(10) || 'ABCDA' WHEN tour_total_stops = 6 THEN '6' WHEN tour_total_stops BETWEEN 7 AND 10 THEN '7-10'
  WHEN tour_total_stops BETWEEN 11 AND 20 THEN '11-20' WHEN tour_total_stops > 20 THEN '20+' END AS leng_bin
  FROM ktour k LEFT JOIN um ON {on(K, "k", "um")} WHERE tour_total_stops >= 3""",
    "umr": f"""SELECT um.*, total_reward_home_distance, round({efficiency("total_cost_travel_distance", "total_reward_home_distance")}, 6) AS tour_efficiency_dist
  FROM um LEFT JOIN rewards ON {on(K, "um", "rewards")}""",
    "br0": "SELECT * FROM umr WHERE total_cost_travel_distance IS NOT NULL AND total_reward_home_distance IS NOT NULL AND tour_efficiency_dist >= 0",
    "br1": f"SELECT *, (SELECT {upper_edges('visits', 5)} FROM br0) AS ed FROM br0",
    "br": f"SELECT * EXCLUDE (ed), {bin_of('visits', 'ed')} - 1 AS q_bin, {reward_bin('total_reward_home_distance')} AS reward_bin FROM br1",
    "el": f"SELECT * FROM um WHERE visits > {LEAST} AND locations > {LEAST} AND total_stay_time > 0 AND total_cost_travel_distance > 0",
    "els": """SELECT *, unnest(CASE WHEN activity_repertoire_groups = 'other' THEN ['all'] ELSE ['all', activity_repertoire_groups] END) AS scope_group
  FROM (SELECT *, unnest(['all', GID_0]) AS scope_country FROM el)""",
    "lhop": """SELECT x.useruuid, x.start_month, x.a AS x, x.b AS src, x.b AS dst, 0 AS depth FROM adj x
  UNION SELECT h.useruuid, h.start_month, h.x, h.src, e.b, h.depth + 1 FROM lhop h JOIN adj e ON e.useruuid = h.useruuid AND e.start_month = h.start_month AND e.a = h.dst
  JOIN adj i ON i.useruuid = h.useruuid AND i.start_month = h.start_month AND i.a = h.x AND i.b = e.b WHERE h.depth < 12""",
    "paths": f"""SELECT useruuid, start_month, a AS src, a AS dst, 0 AS depth FROM deg
  UNION ALL SELECT p.useruuid, p.start_month, p.src, e.b, p.depth + 1 FROM paths p JOIN adj e ON {on(UM, "p", "e")} AND e.a = p.dst
  JOIN dist q ON {on(UM, "p", "q")} AND q.src = p.src AND q.dst = e.b AND q.d = p.depth + 1""",
    "sigma": f"SELECT {UM}, src, dst, any_value(depth) AS d, CAST(count(*) AS DOUBLE) AS n FROM paths GROUP BY {UM}, src, dst",
}


def _near(ask: str, offer: str, scope: str, name: str) -> str:
    """CTEs that end in `name`: scope, a_ and b_ ids, dist2, for nearest offered rows."""
    z = f"""{name}_z AS (SELECT {scope}, avg(visits) AS mv, stddev_pop(visits) AS sv, avg(locations) AS ml, stddev_pop(locations) AS sl FROM {ask} GROUP BY {scope})"""
    d = f"round(coalesce((a.visits - b.visits) / nullif(z.sv, 0), 0.0) ** 2 + coalesce((a.locations - b.locations) / nullif(z.sl, 0), 0.0) ** 2, 9)"
    cols = ", ".join(f"a.{c.strip()}" for c in scope.split(","))
    return f"""{z},
{name}_p AS (SELECT {cols}, a.useruuid AS a_useruuid, a.start_month AS a_start_month, b.useruuid AS b_useruuid, b.start_month AS b_start_month, {d} AS dist2
  FROM {ask} a JOIN {name}_z z ON {on(scope, "a", "z")} JOIN {offer} b ON {on(scope, "a", "b")}),
{name} AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {scope}, a_useruuid, a_start_month ORDER BY dist2, b_useruuid, b_start_month) AS r FROM {name}_p) WHERE r = 1)"""


def _pairs(rows: str, scope: str) -> str:
    """CTEs that end in dl: a row for each matched pair and metric."""
    metrics = ["total_stay_time", "total_cost_travel_distance", "locations", "visits"]
    sc = ", ".join(f"p.{c.strip()}" for c in scope.split(","))
    each = " UNION ALL ".join(
        f"""SELECT {sc}, m_useruuid, m_start_month, f_useruuid, f_start_month, '{m}' AS metric, m.{m}::DOUBLE AS mv, f.{m}::DOUBLE AS fv, m.locations - f.locations AS d_locations
  FROM pr p JOIN {rows} m ON {on(scope, "p", "m")} AND m.useruuid = m_useruuid AND m.start_month = m_start_month
  JOIN {rows} f ON {on(scope, "p", "f")} AND f.useruuid = f_useruuid AND f.start_month = f_start_month"""
        for m in metrics
    )
    return f"""men AS (SELECT * FROM {rows} WHERE gender = 'MALE'), women AS (SELECT * FROM {rows} WHERE gender = 'FEMALE'),
{_near("men", "women", scope, "m2f")},
rest AS (SELECT * FROM women w WHERE NOT EXISTS (SELECT 1 FROM m2f WHERE {on(scope, "m2f", "w")} AND b_useruuid = w.useruuid AND b_start_month = w.start_month)),
{_near("rest", "men", scope, "f2m")},
pr AS (SELECT {scope}, a_useruuid AS m_useruuid, a_start_month AS m_start_month, b_useruuid AS f_useruuid, b_start_month AS f_start_month FROM m2f
  UNION SELECT {scope}, b_useruuid, b_start_month, a_useruuid, a_start_month FROM f2m),
dl AS (SELECT * EXCLUDE (mv, fv), round(mv - fv, 6) AS abs_dif, round((mv - fv) / nullif(mv + fv, 0), 6) AS rel_dif, round(abs(mv - fv), 6) AS abs_abs_dif FROM ({each}))"""


def _summary(scope: str, source: str) -> str:
    return f"""SELECT {scope}, metric, round(avg(rel_dif), 12) AS mean_rel, round(avg(CASE WHEN rel_dif >= 0 THEN rel_dif END), 12) AS mean_pos,
  round(avg(CASE WHEN rel_dif <= 0 THEN rel_dif END), 12) AS mean_neg, count(*) FILTER (rel_dif > 0) AS n_pos, count(*) FILTER (rel_dif < 0) AS n_neg,
  count(*) FILTER (rel_dif = 0) AS n_zero FROM {source} WHERE abs(d_locations) <= {CALIPER} GROUP BY {scope}, metric"""


def _permuted(rows: str, scope: str, order: str, times: int = TIMES) -> str:
    """CTE perm: rows for each b with the genders shuffled within scope."""
    part = f"{scope}, b" if scope else "b"
    cond = f" AND {on(scope, 't', 'x')}" if scope else ""
    by = f"PARTITION BY {scope}" if scope else ""
    return f"""pn AS (SELECT *, row_number() OVER ({by} ORDER BY {order}) - 1 AS place FROM {rows}),
pt AS (SELECT pn.*, t.b FROM pn, (SELECT unnest(range({times})) AS b) t),
px AS (SELECT {part}, gender, row_number() OVER (PARTITION BY {part} ORDER BY {mixed("place", "b")}, place) - 1 AS place FROM pt),
perm AS (SELECT t.* EXCLUDE (gender), x.gender FROM pt t JOIN px x ON t.b = x.b AND t.place = x.place{cond})"""


def _ks(source: str, scope: str) -> str:
    return f"""SELECT {scope}, greatest(max(diff), 0.0) AS d_greater, greatest(max(-diff), 0.0) AS d_less,
  arg_max(x, [diff, -x]) AS loc_greater, arg_max(x, [-diff, -x]) AS loc_less,
  round(exp(-2 * greatest(max(diff), 0.0) ** 2 * any_value(nm * nf / (nm + nf))), 6) AS p_greater,
  round(exp(-2 * greatest(max(-diff), 0.0) ** 2 * any_value(nm * nf / (nm + nf))), 6) AS p_less
FROM (SELECT *, round(CAST(cm AS DOUBLE) / nm - CAST(cf AS DOUBLE) / nf, 9) AS diff FROM (
  SELECT {scope}, x, CAST(sum(m) OVER w AS DOUBLE) AS cm, CAST(sum(f) OVER w AS DOUBLE) AS cf,
    CAST(sum(m) OVER (PARTITION BY {scope}) AS DOUBLE) AS nm, CAST(sum(f) OVER (PARTITION BY {scope}) AS DOUBLE) AS nf
  FROM (SELECT {scope}, total_stay_time::DOUBLE AS x, count(*) FILTER (gender = 'MALE') AS m, count(*) FILTER (gender = 'FEMALE') AS f
        FROM {source} WHERE total_stay_time > 0 GROUP BY {scope}, total_stay_time) WINDOW w AS (PARTITION BY {scope} ORDER BY x))
  WHERE nm > 0 AND nf > 0) GROUP BY {scope}"""


def _gap(source: str, bins: str, within: str, least: int, b: str = "") -> str:
    by = ", ".join(dict.fromkeys(x.strip() for x in f"{b}, {bins}, {within}".split(",") if x.strip()))
    part = f"{b}, {within}" if b else within
    return f"""SELECT {by}, round(CASE WHEN n_m >= {least} AND n_f >= {least} THEN n_m / nullif(sum(n_m) OVER w, 0) - n_f / nullif(sum(n_f) OVER w, 0) END, 6) AS gap,
  round((n_m + n_f) / sum(n_m + n_f) OVER w, 6) AS frac
FROM (SELECT {by}, CAST(count(*) FILTER (gender = 'MALE') AS DOUBLE) AS n_m, CAST(count(*) FILTER (gender = 'FEMALE') AS DOUBLE) AS n_f FROM {source} GROUP BY {by})
WINDOW w AS (PARTITION BY {part})"""


def _counts(by: str) -> str:
    return f"SELECT {by}, count(*) AS stops, count(DISTINCT useruuid) AS users FROM s GROUP BY {by}"


ORDER = f"total_stay_time, {UM}"
_BS = "round(avg(value), 6) AS bs_mean, round(stddev_pop(value), 6) AS bs_std"
_IN_TOUR = f"SELECT {UM}, s, e"
_TOPS = ", ".join("round(coalesce(l[{0}], NULL), 6) AS top{0}_{1}".format(i, "{n}") for i in (1, 2, 3))


def _seq_part(name: str, anchor: str) -> str:
    at = f"SELECT v.useruuid, v.gender, v.GID_0, v.start_month, arg_min(v.lat, v.idx) AS lat0, arg_min(v.lon, v.idx) AS lon0 FROM vis v JOIN ({anchor}) a ON {on(K, 'v', 'a')} AND v.loc = a.anchor GROUP BY ALL"
    return f"""r_{name} AS (SELECT v.useruuid, v.gender, v.GID_0, v.start_month, 2 * sum(round(1000 * {km("lat0", "lon0", "v.lat", "v.lon")})) AS reward
  FROM vis v JOIN ({at}) a ON {on(K, "v", "a")} GROUP BY ALL)"""


SCOPE = "scope_country, scope_group"
_SAME = " AND ".join(f"o.{c} = {{0}}.{c}" for c in ("scope_country", "scope_group", "metric"))


def _significance(times: int) -> str:
    """CTEs that end in judged: observed means against those of shuffles."""
    return f"""seen AS (WITH {_pairs("els", SCOPE)} {_summary(SCOPE, "dl")}),
shuffled AS (WITH {_permuted("els", SCOPE, UM, times)}, {_pairs("perm", SCOPE + ", b")} {_summary(SCOPE + ", b", "dl")}),
cuts AS (SELECT {SCOPE}, metric, quantile_cont(2 * mean_rel, [0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS q FROM shuffled GROUP BY ALL),
judged AS (SELECT o.scope_country, o.scope_group, o.metric, 2 * o.mean_rel AS obs, q[1] AS p5, q[2] AS p50, q[3] AS p95,
  avg(CASE WHEN round(abs(2 * s.mean_rel - q[2]), 9) >= round(abs(2 * o.mean_rel - q[2]), 9) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p_value,
  avg(CASE WHEN 2 * s.mean_rel <= 2 * o.mean_rel THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pct_rank
  FROM seen o JOIN cuts c ON {_SAME.format("c")} JOIN shuffled s ON {_SAME.format("s")} GROUP BY ALL)"""


_JUDGED = f"""SELECT {SCOPE}, metric, round(obs, 6) AS obs, round(p5, 6) AS p5, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p_value, 6) AS p_value, round(pct_rank, 6) AS pct_rank,
  CASE WHEN obs > p95 AND obs > 0 THEN 'MALE' WHEN obs < p5 AND obs < 0 THEN 'FEMALE' ELSE 'none' END AS higher,
  CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '' END AS flag FROM judged"""
_REWARDED = [("t", "tour_efficiency_dist"), ("c", "total_cost_travel_distance")]
_VALUES = "{'t': median(tour_efficiency_dist), 'c': median(total_cost_travel_distance), 'n': count(*)}"
_BY_REWARD = f"""{boots("br", "gender, reward_bin, q_bin", f"total_cost_travel_distance, {UM}", _VALUES, where="reward_bin IS NOT NULL")},
sm AS (SELECT gender, reward_bin, q_bin, max(value.n) AS n, avg(value.t) AS tm, stddev_samp(value.t) AS ts, avg(value.c) AS cm, stddev_samp(value.c) AS cs FROM each_b GROUP BY ALL)"""

#: Query -> (further CTEs, final SELECT).
FINAL: dict[str, tuple[str, str]] = {
    "user_month_density": ("", f"SELECT mobility.useruuid, mobility.gender, mobility.GID_0, mobility.start_month, visits, locations, total_stay_time, total_cost_travel_distance, nodes, edges, density FROM mobility LEFT JOIN basic ON {on(K, 'mobility', 'basic')} WHERE locations >= 2"),
    "invalid_loc_filter": ("", 'SELECT event_id, useruuid, loc, start, "end", round(latitude, 6) AS lat, round(longitude, 6) AS lon FROM valid'),
    "local_time_shift": ("", 'SELECT event_id, start, "end" FROM loc0'),
    "demographic_join": ("", "SELECT gender, GID_0, count(*) AS stops, count(DISTINCT useruuid) AS users FROM valid WHERE gender IS NOT NULL GROUP BY gender, GID_0"),
    "bucket_day": ("", _counts("start_day")),
    "bucket_week": ("", _counts("start_week")),
    "bucket_month": ("", _counts("start_month")),
    "bucket_hourbin": ("", "SELECT start_hour_bin, weekday_weekend, start_week, count(*) AS stops FROM s GROUP BY ALL"),
    "days_in_month": ("", "SELECT start_month, days, count(*) AS stops FROM s GROUP BY ALL"),
    "group_union": ("", f"SELECT {UM}, count(loc) AS visits, user_group FROM s GROUP BY {K}, user_group"),
    "visits_locations": ("", f"SELECT {K}, visits, locations FROM mobility"),
    "min_repertoire": ("", f"SELECT {K}, locations FROM mobility WHERE locations >= 2"),
    "stay_time_coverage": ("", f"SELECT {K}, total_stay_time, coverage_stay_time FROM mobility"),
    "travel_time": ("", f"SELECT {K}, total_travel_time FROM mobility"),
    "travel_cost": ("", f"SELECT {K}, total_cost_travel_distance FROM mobility"),
    "home_anchor": ("", "SELECT * FROM home"),
    "labelled_home_anchor": ("", f"SELECT {K}, home_loc, round(home_lat, 6) AS home_lat, round(home_lon, 6) AS home_lon, total_home_time FROM lhome"),
    "homework_labels": ("", "SELECT useruuid, event_id, loc, detect_H_loc, detect_W_loc, location_type FROM hw"),
    "home_reward": ("", "SELECT * FROM rewards"),
    "tour_efficiency": ("", f"SELECT m.useruuid, m.gender, m.GID_0, m.start_month, total_cost_travel_distance, total_reward_home_distance, round({efficiency('total_cost_travel_distance', 'total_reward_home_distance')}, 6) AS tour_efficiency_dist FROM mobility m JOIN rewards r ON {on(K, 'm', 'r')}"),
    "modal_home_work": ("", "SELECT * FROM mh FULL JOIN mw USING (useruuid, start_month)"),
    "semantic_labels": ("", f"SELECT s.useruuid, s.start_month, CASE WHEN s.loc = detect_H_loc THEN 'H' WHEN s.loc = detect_W_loc THEN 'W' ELSE CAST(s.loc AS VARCHAR) END AS stops, count(*) AS n FROM s LEFT JOIN mh ON {on(UM, 's', 'mh')} LEFT JOIN mw ON {on(UM, 's', 'mw')} GROUP BY ALL"),
    "graph_nodes": ("", f"SELECT {K}, node, CAST(sum(o) AS BIGINT) AS departures FROM (SELECT {K}, loc AS node, 1 AS o FROM mv UNION ALL SELECT {K}, next_loc, 0 FROM mv) GROUP BY {K}, node"),
    "graph_edges": ("", "SELECT * FROM edge"),
    "od_matrix": ("od AS (SELECT " + K + ", loc AS origin_id, next_loc AS destination_id, count(*) AS count_trips_OD, round(avg(next_km), 2) AS mean_km FROM mv GROUP BY ALL), od2 AS (SELECT *, greatest(0, CASE WHEN mean_km > 0 THEN floor(log10(mean_km)) ELSE 0 END) AS p FROM od)",
        "SELECT * EXCLUDE (p), CAST(CAST(10 ** p AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(10 ** (p + 1) AS BIGINT) AS VARCHAR) || ' km' AS distance_bin_OD FROM od2"),
    "graph_basic": ("", "SELECT * FROM basic"),
    "clustering": (f"""top AS (SELECT {K}, max(w) AS top FROM edge GROUP BY {K}),
tri AS (SELECT x.useruuid, x.gender, x.GID_0, x.start_month, x.a, count(*) AS t, sum(cbrt(x.w * y.w * e.w)) AS tw FROM adj x JOIN adj y ON {on(K, "x", "y")} AND x.a = y.a AND x.b < y.b
  JOIN edge e ON {on(K, "x", "e")} AND e.u = x.b AND e.v = y.b GROUP BY ALL),
loc_ AS (SELECT deg.*, coalesce(t, 0) AS t, coalesce(tw, 0.0) AS tw, top.top FROM deg LEFT JOIN tri ON {on(K + ", a", "deg", "tri")} JOIN top ON {on(K, "deg", "top")})""",
        f"""SELECT {K}, round(avg(CASE WHEN d > 1 THEN 2.0 * t / (d * (d - 1)) ELSE 0.0 END), 6) AS avg_unw_cluster,
  round(avg(CASE WHEN d > 1 THEN 2.0 * tw / top / (d * (d - 1)) ELSE 0.0 END), 6) AS avg_weighted_cluster,
  CASE WHEN count(*) > 2 THEN round(coalesce(sum(t) / nullif(sum(d * (d - 1)) / 2.0, 0), 0.0), 6) END AS transitivity FROM loc_ GROUP BY {K}"""),
    "degree_topk": (f"c AS (SELECT {K}, list_sort(list(d), 'DESC') AS l, count(*) AS n FROM deg GROUP BY {K})",
        f"SELECT {K}, " + ", ".join(f"round(CAST(l[{i}] AS DOUBLE) / (n - 1), 6) AS top{i}_degree_centrality" for i in (1, 2, 3)) + " FROM c"),
    "edge_distances": ("", "SELECT * FROM edist"),
    "ideal_edge_distances": ("", "SELECT * FROM ideal"),
    "edge_log_join": ("", f"SELECT i.useruuid, i.gender, i.GID_0, i.start_month, i.ei, i.ej, round(CASE WHEN ideal_km > 0 THEN log10(ideal_km * 1000) END, 6) AS log_ideal, round(CASE WHEN km > 0 THEN log10(km * 1000) END, 6) AS log_observed FROM ideal i LEFT JOIN edist e ON {on(K + ', ei, ej', 'i', 'e')}"),
    "closeness_topk": (f"c0 AS (SELECT {UM}, src, count(*) - 1 AS r, sum(d) AS total FROM dist GROUP BY {UM}, src), c AS (SELECT {UM}, list_sort(list(CASE WHEN total > 0 THEN CAST(r AS DOUBLE) / total * r / (n - 1) ELSE 0.0 END), 'DESC') AS l FROM (SELECT *, count(*) OVER (PARTITION BY {UM}) AS n FROM c0) GROUP BY {UM})",
        f"SELECT p.useruuid, p.gender, p.GID_0, p.start_month, " + ", ".join(f"round(l[{i}], 6) AS top{i}_closeness" for i in (1, 2, 3)) + f" FROM people p JOIN c ON {on(UM, 'p', 'c')}"),
    "eccentricity_diameter": (f"c AS (SELECT {UM}, src, max(d) AS e FROM dist GROUP BY {UM}, src)",
        f"SELECT p.useruuid, p.gender, p.GID_0, p.start_month, CAST(max(e) AS DOUBLE) AS eccentricity_max, round(avg(e), 6) AS eccentricity_mean, CAST(max(e) AS DOUBLE) AS diameter FROM people p JOIN c ON {on(UM, 'p', 'c')} GROUP BY ALL"),
    "global_efficiency_edges": (f"c AS (SELECT {UM}, sum(CASE WHEN d > 0 THEN 1.0::DOUBLE / d ELSE 0.0 END) AS total, count(DISTINCT src) AS n FROM dist GROUP BY {UM})",
        f"SELECT p.useruuid, p.gender, p.GID_0, p.start_month, round(total / (n * (n - 1)), 6) AS global_efficiency_edges FROM people p JOIN c ON {on(UM, 'p', 'c')}"),
    "stop_sequences": ("", f"SELECT {UM}, count(*) AS seq_len, string_agg(CAST(loc AS VARCHAR), ',' ORDER BY start, event_id) AS stops FROM s GROUP BY {K}"),
    "clean_sequences": ("", f"SELECT {UM}, idx, loc, arr, dep, dep - arr AS stop_time FROM vis"),
    "tours_all": ("", f"{_IN_TOUR}, loc, stay_departure, total_duration, tour FROM tour"),
    "tour_measures": ("", f"{_IN_TOUR}, tour_total_stops, tour_total_distance, tour_total_reward, tour_max_reward FROM meas"),
    "keystones": ("", f"SELECT {UM}, loc FROM keys_"),
    "keystone_tours": ("", f"{_IN_TOUR}, tour FROM ktour"),
    "main_keystone": ("", f"SELECT {UM}, main_keystone FROM main"),
    "sequence_efficiency": (
        ",\n".join([
            _seq_part("start", f"SELECT {K}, loc AS anchor FROM vis WHERE idx = 1"),
            _seq_part("home", f"SELECT {K}, home_loc AS anchor FROM lhome"),
            _seq_part("keystone", f"SELECT {K}, main_keystone AS anchor FROM main WHERE main_keystone IS NOT NULL"),
            f"tot AS (SELECT {K}, count(*) AS n, sum(step) AS seq_cost FROM path GROUP BY {K} HAVING count(*) > 1)",
        ]),
        "SELECT tot.*, " + ", ".join(f"r_{n}.reward AS reward_{n}, round({efficiency('seq_cost', f'r_{n}.reward')}, 4) AS efficiency_{n}, r_{n}.reward - seq_cost AS savings_{n}" for n in ("start", "home", "keystone"))
        + " FROM tot " + " ".join(f"LEFT JOIN r_{n} ON {on(K, 'tot', f'r_{n}')}" for n in ("start", "home", "keystone"))),
    "tour_summary": ("", f"SELECT {K}, count(*) AS jrny_total, count(DISTINCT tour) AS jrny_total_unique, CAST(sum(tour_total_distance) AS BIGINT) AS jrny_distance, CAST(sum(tour_total_reward) AS BIGINT) AS jrny_reward, max(tour_max_reward) AS jrny_max_reward, CAST(sum(total_duration) AS BIGINT) AS jrny_duration FROM ktour GROUP BY {K}"),
    "tours_exploded_binned": ("", f"SELECT {UM}, s, tour_total_stops, total_duration, leng_bin, activity_repertoire_groups, tour FROM tr"),
    "deciles_groups": ("", f"SELECT {UM}, visits, locations, activity_deciles, repertoire_deciles, activity_repertoire_groups FROM um"),
    "percentile_alloc": (f"p0 AS (SELECT {UM}, total_stay_time FROM um WHERE total_stay_time > 0), p1 AS (SELECT *, (SELECT {upper_edges('total_stay_time', 20)} FROM p0) AS ed FROM p0)",
        f"SELECT {UM}, total_stay_time, q AS q20_total_stay_time, 100.0::DOUBLE * q / 20 AS perc_total_stay_time FROM (SELECT *, {bin_of('total_stay_time', 'ed')} AS q FROM p1)"),
    "decile_share_gap": ("c AS (SELECT activity_deciles AS quantile, count(*) FILTER (gender = 'MALE') AS n_m, count(*) FILTER (gender = 'FEMALE') AS n_f FROM um GROUP BY ALL)",
        "SELECT *, round(CAST(n_m AS DOUBLE) / (SELECT sum(n_m) FROM c) - CAST(n_f AS DOUBLE) / (SELECT sum(n_f) FROM c), 6) AS gap FROM c"),
    "quintile_reward_bins": (f"p0 AS (SELECT * FROM umr WHERE total_reward_home_distance IS NOT NULL), p1 AS (SELECT *, (SELECT {upper_edges('total_reward_home_distance', 5)} FROM p0) AS ed FROM p0)",
        f"SELECT {UM}, {bin_of('total_reward_home_distance', 'ed')} - 1 AS quintile, {reward_bin('total_reward_home_distance')} AS reward_bin FROM p1"),
    "decile_grid": ("", "SELECT activity_deciles, repertoire_deciles, count(DISTINCT useruuid) AS users, round(100.0::DOUBLE * count(DISTINCT useruuid) / (SELECT count(DISTINCT useruuid) FROM um), 6) AS pct FROM um GROUP BY ALL"),
    "decile_grid_gender_delta": ("tot AS (SELECT gender, count(DISTINCT useruuid) AS total FROM um GROUP BY gender), c AS (SELECT activity_deciles, repertoire_deciles, gender, round(100.0::DOUBLE * count(DISTINCT useruuid) / any_value(total), 6) AS pct FROM um JOIN tot USING (gender) GROUP BY ALL)",
        "SELECT a.i AS activity_deciles, r.i AS repertoire_deciles, round(coalesce(sum(CASE WHEN gender = 'MALE' THEN pct END), 0.0) - coalesce(sum(CASE WHEN gender = 'FEMALE' THEN pct END), 0.0), 6) AS delta FROM (SELECT unnest(range(1, 11)) AS i) a, (SELECT unnest(range(1, 11)) AS i) r LEFT JOIN c ON c.activity_deciles = a.i AND c.repertoire_deciles = r.i GROUP BY ALL"),
    "hist_density": ("h AS (SELECT gender, max(total_stay_time)::DOUBLE / 10 AS width, count(*) AS n FROM um WHERE total_stay_time >= 0 GROUP BY gender), hb AS (SELECT um.gender, width, n, least(CAST(floor(total_stay_time / width) AS BIGINT), 9) AS bin FROM um JOIN h USING (gender) WHERE total_stay_time >= 0)",
        "SELECT gender, bin, round((bin + 0.5::DOUBLE) * width, 6) AS midpoint, round(count(*) / (n * width), 9) AS density FROM hb GROUP BY gender, bin, width, n"),
    "hist_density_log": ("h AS (SELECT gender, max(total_stay_time)::DOUBLE AS top, count(*) AS n FROM um WHERE total_stay_time >= 1 GROUP BY gender HAVING max(total_stay_time) > 1), hb AS (SELECT um.gender, log10(top) / 9 AS step, n, least(CAST(floor(log10(total_stay_time::DOUBLE) / (log10(top) / 9)) AS BIGINT), 8) AS bin FROM um JOIN h USING (gender) WHERE total_stay_time >= 1)",
        "SELECT gender, bin, round((10.0::DOUBLE ** (bin * step) + 10.0::DOUBLE ** ((bin + 1) * step)) / 2, 6) AS midpoint, round(count(*) / (n * (10.0::DOUBLE ** ((bin + 1) * step) - 10.0::DOUBLE ** (bin * step))), 9) AS density FROM hb GROUP BY gender, bin, step, n"),
    "log_km_labels": ("kp AS (SELECT *, 10.0::DOUBLE ** round(log10(total_cost_travel_distance), 1) AS km FROM um WHERE total_cost_travel_distance > 0)",
        f"SELECT {UM}, CASE WHEN km < 1 THEN printf('%.2f', km) WHEN km < 10 THEN printf('%.1f', km) ELSE format('{{:,}}', CAST(floor(km) AS BIGINT)) END AS label FROM kp"),
    "country_resample_weighted": (f"ppl AS (SELECT * FROM (VALUES {_PEOPLE}) p(GID_0, weight)), " + boots("um", "GID_0", ORDER, "count(*)", times=2).replace("FROM num, (", "FROM num JOIN ppl ON num.GID_0 = ppl.GID_0 AND num.place < round_even(num.nn * ppl.weight, 0), ("),
        "SELECT GID_0, b, gender, count(*) AS n, CAST(sum(visits) AS BIGINT) AS visits FROM drawn GROUP BY GID_0, b, gender"),
    "ks_permutation_test": ("ua AS (SELECT *, 'all' AS scope FROM um), " + _permuted("um", "", UM) + f", ko AS ({_ks('ua', 'scope')}), ke AS ({_ks('perm', 'b')})",
        """SELECT scope, ko.d_greater, ko.d_less, round(avg(CASE WHEN ke.d_greater >= ko.d_greater THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS perm_p_greater,
  round(avg(CASE WHEN ke.d_less >= ko.d_less THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS perm_p_less FROM ko, ke GROUP BY scope, ko.d_greater, ko.d_less"""),
    "largest_component": (f"co AS (SELECT {UM}, src, min(dst) AS c FROM dist GROUP BY {UM}, src), sz AS (SELECT {UM}, c, count(*) AS n FROM co GROUP BY {UM}, c), bg AS (SELECT {UM}, arg_min(c, (-n) * 1000000 + c) AS c FROM sz GROUP BY {UM})",
        f"SELECT edge.* FROM edge JOIN co ON {on(UM, 'edge', 'co')} AND co.src = edge.u JOIN bg ON {on(UM, 'edge', 'bg')} AND bg.c = co.c"),
    "local_efficiency": (f"lm AS (SELECT {UM}, x, src, dst, min(depth) AS d FROM lhop GROUP BY {UM}, x, src, dst), le AS (SELECT {UM}, x, sum(CASE WHEN d > 0 THEN 1.0::DOUBLE / d ELSE 0.0 END) AS total, count(DISTINCT src) AS k FROM lm GROUP BY {UM}, x)",
        f"SELECT p.useruuid, p.gender, p.GID_0, p.start_month, round(avg(CASE WHEN k > 1 THEN total / (k * (k - 1)) ELSE 0.0 END), 6) AS local_efficiency FROM people p JOIN le ON {on(UM, 'p', 'le')} GROUP BY ALL"),
    "betweenness_topk": (f"bt AS (SELECT a.useruuid, a.start_month, a.dst AS v, sum(a.n * b.n / w.n) AS s FROM sigma a JOIN sigma b ON {on(UM, 'a', 'b')} AND b.src = a.dst AND a.src <> a.dst AND b.dst <> a.dst AND a.src <> b.dst JOIN sigma w ON {on(UM, 'a', 'w')} AND w.src = a.src AND w.dst = b.dst AND w.d = a.d + b.d GROUP BY ALL), sc AS (SELECT d.useruuid, d.start_month, coalesce(s, 0.0) AS s, count(*) OVER (PARTITION BY d.useruuid, d.start_month) AS n FROM deg d LEFT JOIN bt ON {on(UM, 'd', 'bt')} AND bt.v = d.a), tp AS (SELECT {UM}, list_sort(list(CASE WHEN n > 2 THEN s / ((n - 1) * (n - 2)) ELSE s END), 'DESC') AS l FROM sc GROUP BY {UM})",
        f"SELECT p.useruuid, p.gender, p.GID_0, p.start_month, " + ", ".join(f"round(l[{i}], 6) AS top{i}_betweenness" for i in (1, 2, 3)) + f" FROM people p JOIN tp ON {on(UM, 'p', 'tp')}"),
    "bootstrap_median": (boots("um", "gender, GID_0", ORDER, "median(total_stay_time)"), f"SELECT gender, GID_0, {_BS} FROM each_b GROUP BY gender, GID_0"),
    "country_weighted_agg": (boots("um", "gender, GID_0", ORDER, "median(total_stay_time)") + f", bs AS (SELECT gender, GID_0, {_BS} FROM each_b GROUP BY gender, GID_0), wt AS (SELECT bs.*, p.w / sum(p.w) OVER (PARTITION BY gender) AS w FROM bs JOIN (VALUES {_PEOPLE}) p(GID_0, w) USING (GID_0))",
        "SELECT gender, round(avg(bs_mean), 6) AS equal_mean, round(sqrt(sum(bs_std ** 2)) / sqrt(count(*)), 6) AS equal_se, round(sum(w * bs_mean), 6) AS weighted_mean, round(sqrt(sum(w * bs_std ** 2)), 6) AS weighted_se FROM wt GROUP BY gender"),
    "country_resample": (boots("um", "GID_0", ORDER, "count(*)", times=2), "SELECT GID_0, b, gender, count(*) AS n, CAST(sum(visits) AS BIGINT) AS visits FROM drawn GROUP BY GID_0, b, gender"),
    "rcv": ("m AS (SELECT gender, median(total_stay_time) AS med, 0.75 * (quantile_cont(total_stay_time::DOUBLE, 0.75) - quantile_cont(total_stay_time::DOUBLE, 0.25)) / nullif(median(total_stay_time), 0) AS q FROM um GROUP BY gender)",
        "SELECT gender, round(any_value(q), 6) AS rcvq, round(1.4826 * median(abs(total_stay_time - med)) / nullif(any_value(med), 0), 6) AS rcvm FROM um JOIN m USING (gender) GROUP BY gender"),
    "bootstrap_rcv": (boots("um", "gender", ORDER, "0.75::DOUBLE * ((quantile_cont(total_stay_time::DOUBLE, 0.75) - quantile_cont(total_stay_time::DOUBLE, 0.25)) / nullif(quantile_cont(total_stay_time::DOUBLE, 0.5), 0))", 7),
        "SELECT gender, round(avg(value), 6) AS bs_mean, round(stddev_samp(value), 6) AS bs_std FROM each_b GROUP BY gender"),
    "bootstrap_gap": (boots("um", "GID_0, gender", ORDER, "median(total_stay_time)") + ", g AS (SELECT GID_0, b, max(CASE WHEN gender = 'MALE' THEN value END) AS m, max(CASE WHEN gender = 'FEMALE' THEN value END) AS f FROM each_b GROUP BY GID_0, b)",
        "SELECT GID_0, round(avg((m - f) / nullif((m + f) / 2, 0)), 6) AS gap_mean, round(stddev_samp((m - f) / nullif((m + f) / 2, 0)), 6) AS gap_std FROM g GROUP BY GID_0"),
    "ks_stat": ("", _ks("um", "start_month")),
    "ks_permutation": (_permuted("um", "", UM), _ks("perm", "b")),
    "k_gap_by_n_decile": (boots("um", "activity_deciles, gender", ORDER, "median(locations)") + f", bs AS (SELECT activity_deciles, gender, {_BS} FROM each_b GROUP BY activity_deciles, gender)",
        "SELECT activity_deciles, round(sum(CASE WHEN gender = 'MALE' THEN bs_mean END) - sum(CASE WHEN gender = 'FEMALE' THEN bs_mean END), 6) AS diff, round(sqrt(sum(bs_std * bs_std)), 6) AS se FROM bs GROUP BY activity_deciles"),
    "match_eligible": ("", f"SELECT {SCOPE}, {UM}, gender, visits, locations FROM els"),
    "match_m2f": (_pairs("els", SCOPE), "SELECT * FROM m2f"),
    "match_f2m": (_pairs("els", SCOPE), "SELECT * FROM f2m"),
    "match_pairs_delta": (_pairs("els", SCOPE), f"SELECT * FROM dl WHERE abs(d_locations) <= {CALIPER}"),
    "match_delta_summary": (_pairs("els", SCOPE), _summary(SCOPE, "dl")),
    "permutation_baseline": (_permuted("els", SCOPE, UM) + ",\n" + _pairs("perm", SCOPE + ", b"), _summary(SCOPE + ", b", "dl")),
    "match_significance": (_significance(SHUFFLES), _JUDGED),
    "match_significance_countries": (f"{_significance(TIMES)}, final AS ({_JUDGED})",
        "SELECT scope_group, metric, " + ", ".join(f"count(*) FILTER (higher = '{w}') AS sig_{w}" for w in ("MALE", "FEMALE", "none")) + " FROM final WHERE scope_country <> 'all' GROUP BY scope_group, metric"),
    "efficiency_cost_bootstrap": (_BY_REWARD, "SELECT gender, reward_bin, q_bin, n AS n_user_months, " + ", ".join(
        f"round({v}{k}, 6) AS {name}_{kind}" for v, name in _REWARDED for k, kind in (("m", "median"), ("s", "se"))) + " FROM sm"),
    "efficiency_by_reward": (_BY_REWARD, " UNION ALL ".join(
        f"""SELECT m.reward_bin, m.q_bin, round(2 * (m.{v}m - f.{v}m) / nullif(m.{v}m + f.{v}m, 0), 6) AS rel_gap,
  round(2 * sqrt(m.{v}s * m.{v}s + f.{v}s * f.{v}s) / nullif(m.{v}m + f.{v}m, 0), 6) AS rel_gap_se, '{name}' AS value
FROM sm m JOIN sm f ON m.reward_bin = f.reward_bin AND m.q_bin = f.q_bin AND m.gender = 'MALE' AND f.gender = 'FEMALE'"""
        for v, name in _REWARDED)),
    "anonymise": ("", "SELECT start_month, visits, 'user_' || CAST(dense_rank() OVER (ORDER BY useruuid) AS VARCHAR) AS anon FROM um"),
    "palindrome_share": (
        ",\n".join(
            boots("tr", "gender", f"{UM}, s", "avg(CASE WHEN tour = array_to_string(list_reverse(string_split(tour, ',')), ',') THEN 1.0::DOUBLE ELSE 0.0 END)", where=f"tour_total_stops >= {n}")
            .replace("num AS", f"num{n} AS").replace("num.", f"num{n}.").replace("FROM num", f"FROM num{n}").replace("JOIN num", f"JOIN num{n}")
            .replace("drawn", f"drawn{n}").replace("each_b", f"each{n}")
            for n in (3, 5)
        ),
        " UNION ALL ".join(f"SELECT gender, round(avg(value), 6) AS pal_mean, round(stddev_samp(value), 6) AS pal_std, {n}::INTEGER AS shortest FROM each{n} GROUP BY gender" for n in (3, 5))),
    "tour_length_share": ("", "SELECT leng_bin, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tr), 6) AS share FROM tr GROUP BY leng_bin"),
    "gap_by_length": ("", _gap("tr", "leng_bin", "GID_0", LEAST)),
    "gap_by_length_bootstrap": (boots("tr", "GID_0", f"{UM}, s", "count(*)") + f", gb AS ({_gap('drawn', 'leng_bin', 'GID_0', LEAST, 'b')}), gc AS (SELECT leng_bin, GID_0, round(avg(gap), 9) AS gap_mean, round(stddev_samp(gap), 6) AS gap_std FROM gb GROUP BY leng_bin, GID_0)",
        "SELECT leng_bin, count(*) AS countries, round(avg(gap_mean), 9) AS gap_mean, round(sqrt(sum(gap_std * gap_std)) / count(gap_std), 6) AS gap_se FROM gc WHERE gap_mean IS NOT NULL GROUP BY leng_bin"),
    "gap_by_length_distance": (f"trd AS (SELECT *, {fixed_bin(f'least(greatest(tour_max_reward / 1000.0::DOUBLE, {DISTANCE_KM[0]!r}::DOUBLE), {DISTANCE_KM[-1]!r}::DOUBLE)', DISTANCE_KM)} AS dist_bin FROM tr)",
        _gap("trd", "leng_bin", "dist_bin, GID_0", 1)),
    "gap_by_length_duration": (f"trd AS (SELECT *, {fixed_bin('(total_duration / 60.0::DOUBLE)', DURATION_MIN)} AS dur_bin FROM tr)", _gap("trd", "leng_bin", "dur_bin, GID_0", 1)),
}


def _needed(text: str) -> list[str]:
    """The common table expressions that a text uses, with those they use, in order."""
    import re

    wanted: set[str] = set()
    queue = [text]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        for name in CTE:
            if name in words and name not in wanted:
                wanted.add(name)
                queue.append(CTE[name])
    return [name for name in CTE if name in wanted]


def sql() -> dict[str, str]:
    out = {}
    for name, (more, final) in FINAL.items():
        parts = [f"{n} AS ({CTE[n]})" for n in _needed(f"{more} {final}")]
        out[name] = "WITH RECURSIVE " + ",\n".join([*parts, *([more] if more else [])]) + "\n" + final
    return out
