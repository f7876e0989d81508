"""DuckDB SQL for the correctness gate: the same fixtures and operators written
independently as ANSI-ish SQL over the driver's pre-registered tables."""

from __future__ import annotations

from runwise.sources import fixtures as fx

# The values of the analysed model are stated here once more, so that a wrong constant in the
# operators shows: speeds (m/s), rates ($/s), factors, ellipsoid and link-name patterns.
SLOW_SPEED_MS = 50.0
TAXI_SPEED_MS = 11.83
ROT_BENEFIT = 1.11
FEET_TO_M = 0.3048
M_TO_FEET = 3.28084
PASSENGER_RATE = {"GA": 0.26, "Small": 0.66, "Medium": 2.03, "Large": 3.75, "Super": 6.83}
FUEL_RATE = 0.1796667
CREW_RATE = 0.271
MAINT_RATE = 0.2003333
OWNERSHIP_RATE = 0.132
ENV_RATE = 0.6
OTHER_RATE = 0.0451667
WGS84_A = 6378137.0
WGS84_B = 6356752.314245
WGS84_F = 1 / 298.257223563
RUNWAY_LINK_PATTERN = r"[0-9]+\D?\/[0-9]+\D(\D|\.)?\D?\D?[0-9]+?\D?\_[0-9]+\D?\/[0-9]+\D(\D|\.)?\D?\D?[0-9]+?\D?"
EXIT_LINK_PATTERN = r"[0-9]+\D?\/[0-9]+\D?(\.|\D)\D?\D?[0-9]+"



def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def _name(r: str, c: str) -> str:
    return f"(CASE WHEN {r} = 0 THEN '07L/25R.' || {c} ELSE 'T' || {r} || '.' || {c} END)"


# --- fixture CTEs -------------------------------------------------------------
NETWORK = f"""
grid AS (SELECT rg.r_regionkey AS r, n.n_nationkey AS c FROM nation n, region rg
         WHERE rg.r_regionkey BETWEEN 0 AND {fx.GRID_ROWS - 1}),
nodes AS (SELECT CAST(r * {fx.GRID_COLS} + c AS VARCHAR) AS node_id, {_name('r', 'c')} AS node_name,
                 {d(fx.BASE_LAT)} + {d(fx.STEP_LAT)} * r AS lat, {d(fx.BASE_LONG)} + {d(fx.STEP_LONG)} * c AS long
          FROM grid),
hl AS (SELECT 1000 + a.r * {fx.GRID_COLS} + a.c AS id, {_name('a.r', 'a.c')} AS nf, {_name('b.r', 'b.c')} AS nt,
              {d(fx.H_BASE_FT)} AS base, 0 AS vert
       FROM grid a JOIN grid b ON a.r = b.r AND a.c + 1 = b.c),
vl AS (SELECT 2000 + a.r * {fx.GRID_COLS} + a.c AS id, {_name('a.r', 'a.c')} AS nf, {_name('b.r', 'b.c')} AS nt,
              {d(fx.V_BASE_FT)} AS base, 1 AS vert
       FROM grid a JOIN grid b ON a.r + 1 = b.r AND a.c = b.c WHERE a.r > 0 OR a.c % 3 = 1),
links AS (SELECT CAST(id AS VARCHAR) AS link_id,
                 CASE WHEN vert = 1 THEN nt || '_' || nf ELSE nf || '_' || nt END AS link_name,
                 nf AS node_from, nt AS node_to,
                 round(base * (1 + ((id * 37) % 11) / {d(100.0)}), 3) AS length
          FROM (SELECT * FROM hl UNION ALL SELECT * FROM vl)),
edges AS (SELECT l.link_id, l.link_name, l.node_from, l.node_to, l.length, s.node_id AS src, t.node_id AS dst,
                 CASE WHEN regexp_matches(l.link_name, '{RUNWAY_LINK_PATTERN}') THEN 0
                      WHEN regexp_matches(l.link_name, '{EXIT_LINK_PATTERN}') THEN 1 ELSE 0 END AS is_exit
          FROM links l JOIN nodes s ON l.node_from = s.node_name JOIN nodes t ON l.node_to = t.node_name),
und AS (SELECT src AS a, dst AS b, link_id, length, is_exit FROM edges
        UNION ALL SELECT dst AS a, src AS b, link_id, length, is_exit FROM edges),
ecoord AS (SELECT e.*, s.lat AS src_lat, s.long AS src_long, t.lat AS dst_lat, t.long AS dst_long
           FROM edges e JOIN nodes s ON e.src = s.node_id JOIN nodes t ON e.dst = t.node_id),
sizes AS (SELECT p_brand AS ac_type,
                 ['GA', 'Small', 'Medium', 'Large', 'Super'][CAST(regexp_extract(p_brand, '#(\\d+)$', 1) AS INTEGER) % 5 + 1]
                   AS category
          FROM (SELECT DISTINCT p_brand FROM part)
          WHERE CAST(regexp_extract(p_brand, '#(\\d+)$', 1) AS INTEGER) % 7 <> 0),
boxes AS (SELECT e.link_id AS exit_id, CAST(e.link_id AS INTEGER) AS box_order,
                 s.lat + coalesce([{', '.join(d(x) for x in fx.BOX_LAT_SHIFT)}][(CAST(e.link_id AS INTEGER) - 2001) // 3 + 1], {d(0)}) AS lat,
                 s.long - {d(fx.BOX_HALF_WIDTH)} AS long_upper, s.long + {d(fx.BOX_HALF_WIDTH)} AS long_lower
          FROM edges e JOIN nodes s ON e.src = s.node_id WHERE e.is_exit = 1)"""

FLIGHTS = f"""
ev AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
ch AS (SELECT user_id AS u, (rn - 1) // 10 AS chunk, min(ts) AS t_first, count(*) AS n FROM ev GROUP BY 1, 2),
fl0 AS (SELECT u * 10000000 + chunk AS flight_id, u, chunk, epoch_us(t_first) // 1000 AS t0,
               CASE WHEN n = 10 AND u % 9 = 4 THEN {fx.LONG_LANDING} ELSE n END AS n_pos,
               [{', '.join(d(x) for x in fx.LAT_DRIFT)}][u % {len(fx.LAT_DRIFT)} + 1] AS drift,
               10 + 3 * (u % 3) AS e, 10 + 3 * (u % 3) + 3 + u % 4 AS g, 55 + u % 15 AS v0,
               CASE WHEN u % 10 = 0 THEN {d(0.2)} ELSE {d(1.0)} + {d(0.5)} * (chunk % 3) END AS acc,
               '10' || lpad(CAST(u % 1000 AS VARCHAR), 3, '0') AS unknown
        FROM ch),
fl1 AS (SELECT *, list_concat(list_transform(range(1000, 1000 + e), lambda x: CAST(x AS VARCHAR)),
                              [CAST(2000 + e AS VARCHAR)],
                              list_transform(range(1025 + e, 1025 + g), lambda x: CAST(x AS VARCHAR)),
                              [CAST(2025 + g AS VARCHAR)]) AS route FROM fl0),
fl AS (SELECT f.flight_id, f.u, f.t0, f.e, f.g, f.v0, f.acc, f.n_pos, f.drift,
              ['AAL', 'SWA', 'UAL'][f.u % 3 + 1] || CAST(f.u AS VARCHAR) AS callsign,
              CASE WHEN f.u % 2 = 0 THEN '07L' ELSE '25R' END AS runway,
              n.n_name AS depAirport, 'KPHX' AS arrAirport, 'Brand#' || CAST(f.u % 30 AS VARCHAR) AS aircraftType,
              'T' || CAST(f.u % 4 AS VARCHAR) AS arrGate, CAST(2000 + f.e + 3 AS VARCHAR) AS surrogate_exit,
              CASE WHEN f.u % 30 = 15 AND f.chunk % 3 = 2 THEN [unknown, '2001', '1026', '1027', '1001', '1000'] ELSE
              CASE (f.u + f.chunk) % {fx.VARIANTS}
                   WHEN 2 THEN list_concat(['1000', '2001'], list_transform(range(1026, 1025 + g), lambda x: CAST(x AS VARCHAR)),
                                           [CAST(2025 + g AS VARCHAR), CAST(1050 + g AS VARCHAR), CAST(1051 + g AS VARCHAR)])
                   WHEN 3 THEN list_prepend(unknown, route) WHEN 5 THEN list_append(route, unknown)
                   WHEN 7 THEN route[1:e + 2]
                   WHEN 8 THEN list_transform(range(2025 + f.u % 20, 2031 + f.u % 20), lambda x: CAST(x AS VARCHAR))
                   WHEN 9 THEN route[1:4] ELSE route END END AS link_ids
       FROM fl1 f LEFT JOIN nation n ON n.n_nationkey = f.u % 25),
pos AS (SELECT f.flight_id, s.i AS i, CAST(CAST({d(fx.BASE_LAT)} + f.drift * s.i AS DECIMAL(12,7)) AS DOUBLE) AS lat,
               CAST(CAST({d(fx.BASE_LONG)} + ((f.v0 * (2 * s.i)) - (f.acc / {d(2.0)}) * ((2 * s.i) * (2 * s.i))) / {d(fx.METRES_PER_DEG_LONG)}
                    AS DECIMAL(12,7)) AS DOUBLE) AS long,
               f.t0 + 2000 * s.i AS epoch_ms
        FROM fl f JOIN range({fx.LONG_LANDING}) s(i) ON s.i < f.n_pos),
flinks AS (SELECT flight_id, generate_subscripts(link_ids, 1) - 1 AS idx, unnest(link_ids) AS link_id FROM fl),
pairs AS (SELECT a.flight_id, a.i, a.lat AS lat1, a.long AS lon1, b.lat AS lat2, b.long AS lon2,
                 a.epoch_ms AS t1, b.epoch_ms AS t2
          FROM pos a JOIN pos b ON a.flight_id = b.flight_id AND b.i = a.i + 1)"""


# The same landings read back from packed text with noise: epochs as parsed, other airports and "null" types left out.
_EPOCH = "f.t0 + 2000 * s.i"
FLIGHTS_TEXT = FLIGHTS.replace(
    f"{_EPOCH} AS epoch_ms",
    f"CAST(trunc(CAST(substr(CAST({_EPOCH} AS VARCHAR), 1, 1) || '.' || substr(CAST({_EPOCH} AS VARCHAR), 2) AS DOUBLE) "
    f"* pow(10, CAST(length(CAST({_EPOCH} AS VARCHAR)) - 1 AS DOUBLE))) AS BIGINT) AS epoch_ms")


def vincenty_ctes(name: str, src: str, keys: list[str], rounds: int = 10) -> str:
    """CTE chain computing `dist` (metres) for rows of `src`(keys, lat1, lon1, lat2, lon2)."""
    f = d(WGS84_F)
    k = ", ".join(keys)
    parts = [f"""{name}_0 AS (SELECT {k}, radians(lon2 - lon1) AS vL,
        sin(atan((1 - {f}) * tan(radians(lat1)))) AS su1, cos(atan((1 - {f}) * tan(radians(lat1)))) AS cu1,
        sin(atan((1 - {f}) * tan(radians(lat2)))) AS su2, cos(atan((1 - {f}) * tan(radians(lat2)))) AS cu2,
        radians(lon2 - lon1) AS lam, {d(0)} AS prev, {d(0)} AS ss, {d(0)} AS cs, {d(0)} AS sg, {d(0)} AS csa,
        {d(0)} AS c2m, {d(0)} AS sa, false AS done FROM {src})"""]
    prev = f"{name}_0"
    for r in range(1, rounds + 1):
        a, b, c = f"{name}_{r}a", f"{name}_{r}b", f"{name}_{r}"
        parts.append(f"""{a} AS (SELECT * REPLACE (
            CASE WHEN done THEN ss ELSE sqrt((cu2 * sin(lam)) * (cu2 * sin(lam))
                 + (cu1 * su2 - su1 * cu2 * cos(lam)) * (cu1 * su2 - su1 * cu2 * cos(lam))) END AS ss) FROM {prev})""")
        parts.append(f"""{b} AS (SELECT * REPLACE (
            CASE WHEN done OR ss = 0 THEN cs ELSE su1 * su2 + cu1 * cu2 * cos(lam) END AS cs,
            CASE WHEN done OR ss = 0 THEN sa ELSE cu1 * cu2 * sin(lam) / ss END AS sa) FROM {a})""")
        parts.append(f"""{b}2 AS (SELECT * REPLACE (
            CASE WHEN done OR ss = 0 THEN sg ELSE atan2(ss, cs) END AS sg,
            CASE WHEN done OR ss = 0 THEN csa ELSE 1 - sa * sa END AS csa) FROM {b})""")
        parts.append(f"""{b}3 AS (SELECT * REPLACE (
            CASE WHEN done OR ss = 0 THEN c2m ELSE cs - 2 * su1 * su2 / csa END AS c2m) FROM {b}2)""")
        parts.append(f"""{b}4 AS (SELECT *, {f} / 16 * csa * (4 + {f} * (4 - 3 * csa)) AS cc FROM {b}3)""")
        parts.append(f"""{b}5 AS (SELECT *, CASE WHEN done OR ss = 0 THEN lam ELSE
            vL + (1 - cc) * {f} * sa * (sg + cc * ss * (c2m + cc * cs * (-1 + 2 * c2m * c2m))) END AS nl FROM {b}4)""")
        parts.append(f"""{c} AS (SELECT * EXCLUDE (cc, nl) REPLACE (
            nl AS lam, CASE WHEN done OR ss = 0 THEN prev ELSE lam END AS prev,
            done OR ss = 0 OR abs(nl - lam) <= 1e-12 AS done) FROM {b}5)""")
        prev = c
    a2, b2 = WGS84_A * WGS84_A, WGS84_B * WGS84_B
    parts.append(f"""{name} AS (SELECT {k}, CASE WHEN ss = 0 OR (abs(lam - prev) > 1e-12 AND NOT isnan(abs(lam - prev)))
        THEN {d(0)} ELSE {d(WGS84_B)} * vA * (sg - vB * ss * (c2m + vB / 4 * (cs * (-1 + 2 * c2m * c2m)
             - vB / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)))) END AS dist
        FROM (SELECT *, 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS vA,
                     usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS vB
              FROM (SELECT *, csa * ({d(a2)} - {d(b2)}) / {d(b2)} AS usq FROM {prev})))""")
    return ",\n".join(parts)


# Pair distances and per-landing features.
FEATURES = f"""
{vincenty_ctes('pd', 'pairs', ['flight_id', 'i'])},
pdist AS (SELECT p.*, v.dist FROM pairs p JOIN pd v USING (flight_id, i)),
dec AS (SELECT flight_id, CASE WHEN isfinite(r) THEN round(r, 2) END AS decel
        FROM (SELECT f.flight_id,
                     ((z.dist / (abs(CAST(z.t1 AS DOUBLE) - CAST(z.t2 AS DOUBLE)) / 1000))
                      - (a.dist / (abs(CAST(a.t1 AS DOUBLE) - CAST(a.t2 AS DOUBLE)) / 1000)))
                     / CAST(abs(z.t2 - a.t2) // 1000 AS DOUBLE) AS r
              FROM fl f LEFT JOIN pdist a ON f.flight_id = a.flight_id AND a.i = 0
                   LEFT JOIN pdist z ON f.flight_id = z.flight_id AND z.i = least(f.n_pos, 20) - 2)),
feat AS (SELECT f.flight_id, f.runway, f.depAirport, f.aircraftType, f.arrGate, f.callsign, f.surrogate_exit,
                p0.lat AS touchdownLat, p0.long AS touchdownLong,
                strftime(make_timestamp(p0.epoch_ms * 1000), '%H') AS hour,
                strftime(make_timestamp(p0.epoch_ms * 1000), '%a') AS day,
                dec.decel, regexp_replace(f.callsign, '\\d', '', 'g') AS carrier, p0.epoch_ms AS landingEpoch
         FROM fl f JOIN pos p0 ON p0.flight_id = f.flight_id AND p0.i = 0 JOIN dec ON dec.flight_id = f.flight_id
         WHERE f.arrAirport = 'KPHX' AND len(f.link_ids) > 5 AND f.n_pos > 5),
kept AS (SELECT * FROM feat WHERE decel <= -0.5),
traf AS (SELECT flight_id, count(*) OVER (ORDER BY landingEpoch
                RANGE BETWEEN 899999 PRECEDING AND 899999 FOLLOWING) AS traffic FROM kept),
lab AS (SELECT k.flight_id, arg_min(fl2.link_id, fl2.idx) FILTER (e.is_exit = 1) AS exit
        FROM kept k LEFT JOIN flinks fl2 ON fl2.flight_id = k.flight_id AND fl2.idx >= 1
             LEFT JOIN edges e ON e.link_id = fl2.link_id GROUP BY k.flight_id),
prepared AS (SELECT k.*, t.traffic, l.exit FROM kept k JOIN traf t USING (flight_id) JOIN lab l USING (flight_id)
             WHERE l.exit IS NOT NULL)"""


FEATURES_TEXT = FEATURES.replace("WHERE f.arrAirport = 'KPHX'", "WHERE f.flight_id % 7 NOT IN (0, 1)")


# ... and with malformed numbers, which leave no deceleration.
FEATURES_BROKEN = FEATURES_TEXT.replace("% 7 NOT IN (0, 1)", "% 7 NOT IN (0, 1) AND f.flight_id % 11 <> 3")
# FIXED VALUES: the bits of the reject ledger, in order.
REASONS = ["other_airport", "null_text", "few_items", "no_den_link", "deceleration", "no_exit", "no_vertex", "start_is_goal",
           "adjacent", "no_path", "no_time", "malformed_number", "unknown_link", "unseen_category"]


def with_ctes(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip().rstrip(",") for b in blocks)


def passenger_case(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {d(v)}" for k, v in PASSENGER_RATE.items())
    return f"(CASE {col} {whens} ELSE {d(0)} END)"


COST_RATES = [("FuelCost", FUEL_RATE), ("CrewCost", CREW_RATE), ("MaintCost", MAINT_RATE), ("AOCost", OWNERSHIP_RATE),
              ("EnvCost", ENV_RATE), ("OtherCost", OTHER_RATE)]


def _fold(lst: str) -> str:
    return f"list_reduce(list_transform({lst}, lambda s: s.length), lambda a, b: a + b, {d(0)})"


def _angle(l1: str, t1: str, l2: str, t2: str) -> str:
    dl, dt = f"abs(abs({l1}) - abs({l2}))", f"abs({t1} - {t2})"
    return f"(CASE WHEN {dl} > 0 OR {dt} > 0 THEN degrees(atan({dt} / {dl})) ELSE {d(-999)} END)"


STEP_T = "STRUCT(link_id VARCHAR, from_node VARCHAR, is_exit INTEGER, length DOUBLE)"

# Slow / goal / avoided vertices of every landing.
VERTICES = f"""
slowpos AS (SELECT f.flight_id, coalesce(min(q.i) + 1, any_value(f.n_pos) - 1) AS si
            FROM fl f LEFT JOIN pdist q ON q.flight_id = f.flight_id
                 AND q.dist / (abs(CAST(q.t1 AS DOUBLE) - CAST(q.t2 AS DOUBLE)) / 1000) < {d(SLOW_SPEED_MS)}
            GROUP BY f.flight_id),
slow AS (SELECT s.flight_id, p.lat AS slow_lat, p.long AS slow_long FROM slowpos s JOIN pos p ON p.flight_id = s.flight_id AND p.i = s.si),
lk AS (SELECT l.flight_id, l.idx, l.link_id, e.src, e.dst,
              CASE WHEN e.link_id IS NULL THEN {d(0)} ELSE
                (sqrt((e.src_lat - s.slow_lat) * (e.src_lat - s.slow_lat) + (e.src_long - s.slow_long) * (e.src_long - s.slow_long))
               + sqrt((e.dst_lat - s.slow_lat) * (e.dst_lat - s.slow_lat) + (e.dst_long - s.slow_long) * (e.dst_long - s.slow_long))) / 2
              END AS ld
       FROM flinks l JOIN slow s ON s.flight_id = l.flight_id LEFT JOIN ecoord e ON e.link_id = l.link_id),
svk AS (SELECT a.flight_id, min(a.idx) AS k FROM lk a JOIN lk b ON a.flight_id = b.flight_id AND b.idx = a.idx + 1
        WHERE a.ld <> 0 AND b.ld <> 0 AND b.ld > a.ld GROUP BY a.flight_id),
slowv AS (SELECT f.flight_id, CASE WHEN a.src IS NULL OR b.src IS NULL THEN NULL
                                   WHEN a.src = b.src OR a.src = b.dst THEN a.src ELSE a.dst END AS slowV
          FROM fl f LEFT JOIN svk ON svk.flight_id = f.flight_id
               LEFT JOIN lk a ON a.flight_id = f.flight_id AND a.idx = svk.k
               LEFT JOIN lk b ON b.flight_id = f.flight_id AND b.idx = svk.k + 1),
goalv AS (SELECT f.flight_id, CASE WHEN a.src IS NULL OR b.src IS NULL THEN NULL
                                   WHEN a.src = b.src OR a.src = b.dst THEN a.dst
                                   WHEN a.dst = b.src OR a.dst = b.dst THEN a.src END AS goalV
          FROM fl f JOIN lk a ON a.flight_id = f.flight_id AND a.idx = len(f.link_ids) - 1
               JOIN lk b ON b.flight_id = f.flight_id AND b.idx = len(f.link_ids) - 2),
avoidv AS (SELECT v.flight_id, arg_min(CASE WHEN l.src = v.slowV THEN l.dst ELSE l.src END, l.idx) AS avoidV
           FROM slowv v LEFT JOIN lk l ON l.flight_id = v.flight_id AND (l.src = v.slowV OR l.dst = v.slowV) GROUP BY v.flight_id),
verts AS (SELECT s.flight_id, s.slow_lat, s.slow_long, v.slowV, g.goalV, a.avoidV
          FROM slow s JOIN slowv v ON v.flight_id = s.flight_id JOIN goalv g ON g.flight_id = s.flight_id
               JOIN avoidv a ON a.flight_id = s.flight_id),
nadj AS (SELECT v.* FROM verts v WHERE v.slowV IS NOT NULL AND v.goalV IS NOT NULL AND v.slowV <> v.goalV
         AND NOT EXISTS (SELECT 1 FROM und u WHERE u.a = v.slowV AND u.b = v.goalV))"""


def exit_ends(src: str) -> str:
    """near / far of the surrogate predicted exit for rows of `src` (flight_id, slowV)."""
    return f"""
ends AS (SELECT v.flight_id, e.src, e.dst, e.length AS exit_length, n.lat AS slat, n.long AS slong,
                e.src_lat, e.src_long, e.dst_lat, e.dst_long
         FROM {src} v JOIN fl f ON f.flight_id = v.flight_id JOIN ecoord e ON e.link_id = f.surrogate_exit
              JOIN nodes n ON n.node_id = v.slowV),
endpairs AS (SELECT flight_id, 0 AS w, slat AS lat1, slong AS lon1, src_lat AS lat2, src_long AS lon2 FROM ends
             UNION ALL SELECT flight_id, 1 AS w, slat, slong, dst_lat, dst_long FROM ends),
{vincenty_ctes('ed', 'endpairs', ['flight_id', 'w'])},
nearfar AS (SELECT v.flight_id, CASE WHEN e.flight_id IS NULL THEN NULL WHEN ds.dist < dd.dist THEN e.src ELSE e.dst END AS near,
                   CASE WHEN e.flight_id IS NULL THEN NULL WHEN ds.dist < dd.dist THEN e.dst ELSE e.src END AS far,
                   e.exit_length
            FROM {src} v LEFT JOIN ends e ON e.flight_id = v.flight_id
                 LEFT JOIN ed ds ON ds.flight_id = v.flight_id AND ds.w = 0
                 LEFT JOIN ed dd ON dd.flight_id = v.flight_id AND dd.w = 1)"""


def search(keys_sql: str) -> str:
    """First-touch best paths for the (start, goal, avoid) rows of `keys_sql`: CTE `solved`."""
    return f"""
keys0 AS ({keys_sql}),
kk AS (SELECT DISTINCT k.start || '|' || k.goal || '|' || coalesce(k.avoid, '') AS kid, k.start, k.goal, k.avoid,
              CASE WHEN adj.a IS NULL AND k.start <> coalesce(k.avoid, '') THEN k.avoid END AS avoid_eff
       FROM keys0 k LEFT JOIN (SELECT DISTINCT a, b FROM und) adj ON adj.a = k.start AND adj.b = k.goal),
sp AS (WITH RECURSIVE r(kid, node, g) USING KEY (kid, node) AS (
         SELECT kid, start, {d(0)} FROM kk WHERE start <> goal AND goal <> coalesce(avoid, '')
         UNION
         SELECT c.kid, c.node, c.g FROM (
           SELECT w.kid, u.b AS node, min(w.g + u.length) AS g
           FROM r w JOIN kk ON kk.kid = w.kid JOIN und u ON u.a = w.node
           WHERE w.node <> kk.goal AND u.b <> coalesce(kk.avoid_eff, '') AND u.b <> kk.goal GROUP BY w.kid, u.b) c
         LEFT JOIN recurring.r old ON old.kid = c.kid AND old.node = c.node
         WHERE old.g IS NULL OR c.g < old.g)
       SELECT * FROM r),
toward AS (SELECT s.kid, s.node, s.g, k.start, k.goal, n1.lat AS lat1, n1.long AS lon1, n2.lat AS lat2, n2.long AS lon2
           FROM sp s JOIN kk k ON k.kid = s.kid JOIN nodes n1 ON n1.node_id = s.node JOIN nodes n2 ON n2.node_id = k.goal),
{vincenty_ctes('hv', 'toward', ['kid', 'node'])},
popped AS (SELECT t.kid, t.node, t.g, t.start, t.goal, t.g + h.dist * {d(M_TO_FEET)} AS f FROM toward t JOIN hv h ON h.kid = t.kid AND h.node = t.node),
prior AS (SELECT * FROM (SELECT q.kid, t.node, u.a AS prev, u.link_id, u.is_exit, u.length,
                                row_number() OVER (PARTITION BY q.kid, t.node ORDER BY q.f, u.a, u.link_id) AS rn
                         FROM popped q JOIN und u ON u.a = q.node JOIN popped t ON t.kid = q.kid AND t.node = u.b
                         WHERE q.g + u.length = t.g AND t.node <> t.start) WHERE rn = 1),
last AS (SELECT * FROM (SELECT q.*, u.link_id, u.is_exit, u.length, row_number() OVER (PARTITION BY q.kid ORDER BY q.f, q.node, u.length, u.link_id) AS rn
                        FROM popped q JOIN und u ON u.a = q.node AND u.b = q.goal) WHERE rn = 1),
back AS (WITH RECURSIVE t(kid, node, start, path) AS (
           SELECT kid, node, start, [{{'link_id': link_id, 'from_node': node, 'is_exit': is_exit, 'length': length}}]::{STEP_T}[] FROM last
           UNION ALL
           SELECT t.kid, p.prev, t.start, list_prepend({{'link_id': p.link_id, 'from_node': p.prev, 'is_exit': p.is_exit, 'length': p.length}}, t.path)
           FROM t JOIN prior p ON p.kid = t.kid AND p.node = t.node WHERE t.node <> t.start)
         SELECT * FROM t),
pick AS (SELECT kid, path FROM back WHERE node = start),
solved AS (SELECT k.kid, k.start, k.goal, k.avoid, p.path FROM kk k LEFT JOIN pick p ON p.kid = k.kid)"""


def _kid(start: str, goal: str, avoid: str) -> str:
    return f"{start} || '|' || {goal} || '|' || coalesce({avoid}, '')"


def _flag(path: str) -> str:
    return (f"list_transform({path}, lambda s: {{'link_id': s.link_id, 'is_exit': CASE WHEN s.from_node = b.slowV AND b.slow_on_exit "
            f"THEN 1 ELSE s.is_exit END, 'length': s.length}})")


def _rot(path: str) -> str:
    k = f"coalesce(list_position(list_transform({path}, lambda s: s.is_exit = 1), true), 0)"
    return f"(CASE WHEN {k} > 0 THEN {_fold(f'{path}[1:{k}]')} * {d(FEET_TO_M)} / {d(SLOW_SPEED_MS)} ELSE {d(-1)} END)"


def _tt(path: str) -> str:
    k = f"coalesce(list_position(list_transform({path}, lambda s: s.is_exit = 1), true), 0)"
    return (f"(CASE WHEN len({path}) - {k} > 0 THEN {_fold(f'{path}[{k} + 1:len({path})]')} * {d(FEET_TO_M)} / {d(TAXI_SPEED_MS)} "
            f"ELSE {d(-1)} END)")


def _costs() -> str:
    parts = []
    for side in ("opt", "actual"):
        t = f"({side}ROT + {side}TT)"
        parts.append(f"{t} * {passenger_case('size_class')} AS {side}Pcost")
        for name, rate in COST_RATES:
            parts.append(f"{t} * {d(rate)} AS {side}{name}")
    return ", ".join(parts)


OPTIMISE = f"""
{exit_ends('nadj')},
base AS (SELECT p.flight_id, p.aircraftType, p.surrogate_exit AS predictedExit, v.slowV, v.goalV, v.avoidV,
                nf.near, nf.far, nf.exit_length,
                v.slowV IN (SELECT src FROM edges WHERE is_exit = 1 UNION SELECT dst FROM edges WHERE is_exit = 1) AS slow_on_exit
         FROM prepared p JOIN nadj v ON v.flight_id = p.flight_id JOIN nearfar nf ON nf.flight_id = p.flight_id),
{search('''SELECT slowV AS start, goalV AS goal, avoidV AS avoid FROM base
           UNION ALL SELECT slowV, near, avoidV FROM base WHERE slowV <> near
           UNION ALL SELECT far, goalV, avoidV FROM base WHERE far IS NOT NULL''')},
paths AS (SELECT b.*, {_flag('o.path')} AS optPath,
                 list_concat(CASE WHEN b.slowV = b.near THEN [] ELSE {_flag('l1.path')} END,
                             [{{'link_id': b.predictedExit, 'is_exit': 1, 'length': b.exit_length}}],
                             {_flag('l2.path')}) AS predPath
          FROM base b LEFT JOIN solved o ON o.kid = {_kid('b.slowV', 'b.goalV', 'b.avoidV')}
               LEFT JOIN solved l1 ON l1.kid = {_kid('b.slowV', 'b.near', 'b.avoidV')}
               LEFT JOIN solved l2 ON l2.kid = {_kid('b.far', 'b.goalV', 'b.avoidV')}
          WHERE o.path IS NOT NULL AND (b.slowV = b.near OR l1.path IS NOT NULL) AND l2.path IS NOT NULL AND b.near IS NOT NULL),
timed AS (SELECT * FROM (SELECT *, {_rot('optPath')} AS optROT, {_tt('optPath')} AS optTT,
                                {_rot('predPath')} AS actualROT, {_tt('predPath')} AS actualTT FROM paths)
          WHERE optROT <> -1 AND optTT <> -1 AND actualROT <> -1 AND actualTT <> -1),
sized AS (SELECT t.*, coalesce(s.category, 'GA') AS size_class FROM timed t LEFT JOIN sizes s ON s.ac_type = t.aircraftType),
costed0 AS (SELECT *, {_costs()}, (actualROT - optROT) * {d(0.25)} * {d(ROT_BENEFIT)} AS savings FROM sized),
costed AS (SELECT *, optPcost + optFuelCost + optCrewCost + optMaintCost + optAOCost + optEnvCost + optOtherCost AS totalOptCost,
                  actualPcost + actualFuelCost + actualCrewCost + actualMaintCost + actualAOCost + actualEnvCost + actualOtherCost
                  AS totalActualCost FROM costed0)"""

MEASURES = ["optROT", "optTT", "actualROT", "actualTT",
            "optPcost", "optFuelCost", "optCrewCost", "optMaintCost", "optAOCost", "optEnvCost", "optOtherCost",
            "actualPcost", "actualFuelCost", "actualCrewCost", "actualMaintCost", "actualAOCost", "actualEnvCost",
            "actualOtherCost", "savings", "totalOptCost", "totalActualCost"]
AIRPORTS = {"PHX": "KPHX", "PHOENIX": "KPHX", "ATL": "KATL", "ATLANTA": "KATL", "BWI": "KBWI", "BALTIMORE": "KBWI",
            "DEN": "KDEN", "DENVER": "KDEN"}


def _r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def _impact(items):
    return " UNION ALL ".join(
        f"SELECT '{lab}' AS item, round(avg({o}), 6) AS optimal, round(avg({a}), 6) AS predicted, "
        f"round(avg({a}) - avg({o}), 6) AS difference FROM costed" for lab, o, a in items)


CATEGORICAL = ["runway", "depAirport", "aircraftType", "arrGate", "hour", "day", "carrier"]
CONTINUOUS = ["touchdownLat", "touchdownLong", "decel", "traffic"]
PART = "CASE WHEN ('0x' || substr(md5(flight_id || ':4873'), 1, 8))::BIGINT % 1000 < 700 THEN 'train' ELSE 'test' END"


def _indexed(col: str, src: str) -> str:
    return (f"SELECT '{col}' AS feature, CAST({col} AS VARCHAR) AS value, row_number() OVER (ORDER BY count(*) DESC, {col}) - 1 AS index "
            f"FROM {src} GROUP BY {col}")


def _model_sql(feat: str, opt: str, net: str, describe: str) -> dict[str, str]:
    """Split, indexers, vectors and sinks: what of the model both engines can compute."""
    split = f"{feat}, parts AS (SELECT *, {PART} AS part FROM prepared), train AS (SELECT * FROM parts WHERE part = 'train')"
    cats = " UNION ALL ".join(_indexed(c, "prepared") for c in CATEGORICAL)
    index = f"{split}, ix AS ({cats})"
    order = ["runway", "depAirport", "aircraftType", "arrGate", "touchdownLat", "touchdownLong", "hour", "day", "decel", "carrier", "traffic"]
    kinds = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{'categorical' if c in CATEGORICAL else 'continuous'}' AS kind, count(DISTINCT {c}) AS n_values FROM prepared"
        for c in order)
    vector = " UNION ALL ".join(
        [f"SELECT p.flight_id, CAST({k} AS BIGINT) AS place, CAST(i.index AS DOUBLE) AS value FROM prepared p "
         f"JOIN ix i ON i.feature = '{c}' AND i.value = p.{c}" for k, c in enumerate(CATEGORICAL)]
        + [f"SELECT flight_id, CAST({len(CATEGORICAL) + k} AS BIGINT) AS place, round(CAST({c} AS DOUBLE), 6) AS value FROM prepared"
           for k, c in enumerate(CONTINUOUS)])
    meta = " UNION ALL ".join(
        f"SELECT '{c}' AS featureName, 'categorical' AS featureType, (SELECT list(value ORDER BY index) FROM ix WHERE feature = '{c}') AS categories"
        if c in CATEGORICAL else f"SELECT '{c}' AS featureName, 'continuous' AS featureType, NULL AS categories" for c in CATEGORICAL + CONTINUOUS)
    meta += " UNION ALL SELECT 'exit', 'categorical', (SELECT list(value ORDER BY index) FROM lx)"
    label = f"{index}, lx AS ({_indexed('exit', 'train')})"
    means = ", ".join(f"round(avg({c}), 6) AS {c}" for c in MEASURES[:19])
    return {
        "train_test_split": split + " SELECT flight_id, part FROM parts",
        "split_counts": split + " SELECT coalesce(part, 'total') AS part, count(*) AS count FROM parts GROUP BY ROLLUP (part)",
        "feature_kinds": feat + " " + kinds,
        "index_categories": index + " SELECT feature, value, index FROM ix",
        "index_label": label + " SELECT index AS label, value AS exit FROM lx",
        "assemble": index + " " + vector,
        "accuracy": feat + " SELECT avg(CAST(exit = surrogate_exit AS DOUBLE)) * 100 AS accuracy, count(*) AS scored FROM prepared",
        "sink_feature_json": label + " " + meta,
        "scan_run_artifacts": label + f" SELECT 'KPHX-run' AS run_id, featureName, featureType, CAST(len(categories) AS BIGINT) AS n_categories FROM ({meta})"
                              " UNION ALL SELECT 'KPHX-run', unnest(['runs', 'results', 'samples', 'costed', 'documents']), 'table', NULL",
        "sink_run_info": split + """ SELECT 'KPHX-run' AS run_id, 'KPHX' AS airport_code, count(DISTINCT runway) AS num_runways,
            count(DISTINCT exit) AS num_exits, count(*) FILTER (part = 'train') AS train_count, count(*) FILTER (part = 'test') AS test_count,
            true AS accuracy_is_percent FROM parts""",
        "complete_runs": "SELECT 'KPHX-run' AS run_id, 'KPHX' AS airport_code",
        "list_models": "SELECT 'KPHX-run' AS run_id, 'KPHX' AS airport_code",
        "sink_df_csv": net + " SELECT ac_type, category FROM sizes",
        "sink_describe_csv": opt + " " + describe,
        "sink_result_json": opt + f" SELECT {means}, CAST(least(50, count(*)) AS BIGINT) AS n_samples FROM costed",
        "dropped_rows": opt + """, typed AS (SELECT * FROM fl WHERE len(link_ids) > 5 AND n_pos > 5),
            near AS (SELECT p.flight_id FROM prepared p JOIN nadj v ON v.flight_id = p.flight_id)
            SELECT CAST(0 AS BIGINT) AS step, 'records' AS name, (SELECT count(*) FROM fl) AS n_left
            UNION ALL SELECT 1, 'filters', (SELECT count(*) FROM typed) UNION ALL SELECT 2, 'deceleration', (SELECT count(*) FROM kept)
            UNION ALL SELECT 3, 'exit_label', (SELECT count(*) FROM prepared) UNION ALL SELECT 4, 'adjacent_or_no_vertex', (SELECT count(*) FROM near)
            UNION ALL SELECT 5, 'no_path', (SELECT count(*) FROM paths) UNION ALL SELECT 6, 'no_time', (SELECT count(*) FROM costed)""",
    }


def oracle_sql() -> dict[str, str]:
    from runwise.plans.catalog import AIRPORT_SPELLINGS, FEATURE_SUBSET
    net = with_ctes(NETWORK)
    flt = with_ctes(NETWORK, FLIGHTS)
    feat = with_ctes(NETWORK, FLIGHTS, FEATURES)
    graph = with_ctes(NETWORK, FLIGHTS, FEATURES, VERTICES)
    opt = with_ctes(NETWORK, FLIGHTS, FEATURES, VERTICES, OPTIMISE)
    spell = "[" + ", ".join(f"'{s}'" for s in AIRPORT_SPELLINGS) + "]"
    code_case = "CASE upper(airport) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AIRPORTS.items()) + " END"
    cost_cols = [c for c in MEASURES if c.lower().endswith("cost") and not c.startswith("total")]
    stats = [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("stddev", "stddev_samp({c})"),
             ("min", "min({c})"), ("max", "max({c})")]
    describe = " UNION ALL ".join(
        f"SELECT '{s}' AS summary, " + ", ".join(f"round({e.format(c=c)}, 6) AS {c}" for c in MEASURES) + " FROM costed"
        for s, e in stats)
    txt = f"""{flt}, txt AS (SELECT flight_id, i, CAST(CAST(long AS DECIMAL(12,7)) AS VARCHAR) AS long_t,
                                    CAST(epoch_ms AS VARCHAR) AS s FROM pos),
        parsed AS (SELECT flight_id, i, CAST(long_t AS DOUBLE) AS long,
                          CAST(trunc(CAST(substr(s, 1, 1) || '.' || substr(s, 2) AS DOUBLE) * pow(10, CAST(length(s) - 1 AS DOUBLE))) AS BIGINT) AS epoch_ms
                   FROM txt)"""
    extra = {
        "prune_columns": flt + " SELECT flight_id, callsign, runway, depAirport, arrAirport, "
                               "CASE WHEN flight_id % 7 = 1 THEN 'null' ELSE aircraftType END AS aircraftType, arrGate "
                               "FROM fl WHERE flight_id % 7 <> 0",
        "promote_header": flt + " SELECT callsign, runway, depAirport, arrAirport, aircraftType, arrGate FROM fl",
        "edge_dst_join": net + " SELECT link_id, node_to, dst FROM edges",
        "link_lookup": flt + " SELECT l.flight_id, l.idx, e.src, e.dst FROM flinks l LEFT JOIN edges e ON e.link_id = l.link_id",
        "has_slow_vertex": graph + " SELECT flight_id FROM verts WHERE slowV IS NOT NULL",
        "has_goal_vertex": graph + " SELECT flight_id FROM verts WHERE goalV IS NOT NULL",
        "slow_ne_goal": graph + " SELECT flight_id FROM verts WHERE goalV <> slowV",
        "parse_items": flt + " SELECT flight_id, CAST(n_pos AS BIGINT) AS n_positions, CAST(len(link_ids) AS BIGINT) AS n_links, "
                             "link_ids[1] AS first_link, link_ids[len(link_ids)] AS last_link FROM fl",
        "path_edges": opt + " SELECT flight_id, CAST(generate_subscripts(optPath, 1) - 1 AS BIGINT) AS idx, "
                            "unnest(list_transform(optPath, lambda s: s.link_id)) AS link_id, "
                            "unnest(list_transform(optPath, lambda s: s.length)) AS length FROM costed",
        "concat_paths": opt + " SELECT flight_id, array_to_string(list_transform(predPath, lambda s: s.link_id), ',') "
                              "AS pred_links FROM costed",
    }
    solved_sql = with_ctes(NETWORK, FLIGHTS, FEATURES, VERTICES,
                           search("SELECT slowV AS start, goalV AS goal, avoidV AS avoid FROM nadj"))
    reasons = {
        "other_airport": "f.flight_id % 7 = 0", "null_text": "f.flight_id % 7 = 1", "few_items": "len(f.link_ids) <= 5 OR f.n_pos <= 5",
        "malformed_number": "f.flight_id % 11 = 3", "unseen_category": "f.flight_id % 7 = 1 OR f.aircraftType NOT IN (SELECT ac_type FROM sizes)",
        "unknown_link": "EXISTS (SELECT 1 FROM flinks l WHERE l.flight_id = f.flight_id AND l.link_id NOT IN (SELECT link_id FROM edges))",
        "deceleration": "p.flight_id IS NOT NULL AND f.flight_id NOT IN (SELECT flight_id FROM kept)",
        "no_exit": "p.flight_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM flinks l JOIN edges e ON e.link_id = l.link_id "
                   "WHERE l.flight_id = f.flight_id AND l.idx > 0 AND e.is_exit = 1)",
        "no_vertex": "q.flight_id IS NOT NULL AND (v.slowV IS NULL OR v.goalV IS NULL)", "start_is_goal": "q.flight_id IS NOT NULL AND v.slowV = v.goalV",
        "adjacent": "q.flight_id IS NOT NULL AND v.slowV <> v.goalV AND EXISTS (SELECT 1 FROM und u WHERE u.a = v.slowV AND u.b = v.goalV)",
        "no_path": "f.flight_id IN (SELECT flight_id FROM base) AND f.flight_id NOT IN (SELECT flight_id FROM paths)",
        "no_time": "f.flight_id IN (SELECT flight_id FROM paths) AND f.flight_id NOT IN (SELECT flight_id FROM timed)",
    }
    mask = " + ".join(f"CASE WHEN {cond} THEN {1 << REASONS.index(name)} ELSE 0 END" for name, cond in reasons.items())
    ledger = with_ctes(NETWORK, FLIGHTS_TEXT, FEATURES_BROKEN, VERTICES, OPTIMISE) + f""", ledger AS (
        SELECT f.flight_id, {mask} AS reject_mask FROM fl f LEFT JOIN verts v ON v.flight_id = f.flight_id
        LEFT JOIN prepared q ON q.flight_id = f.flight_id
        LEFT JOIN (SELECT flight_id FROM fl WHERE flight_id % 7 NOT IN (0, 1) AND len(link_ids) > 5 AND n_pos > 5) p ON p.flight_id = f.flight_id)"""
    names = "[" + ", ".join(f"CASE WHEN reject_mask & {1 << k} <> 0 THEN '{name}' END" for k, name in enumerate(REASONS)) + "]"
    extra["reject_ledger"] = ledger + " SELECT flight_id, reject_mask FROM ledger"
    extra["reject_counts"] = ledger + (f" SELECT reject_mask, array_to_string(list_filter({names}, lambda x: x IS NOT NULL), ',') AS reasons, "
                                       "count(*) AS n_records FROM ledger GROUP BY reject_mask")
    extra["min_cost_vertex"] = solved_sql + " SELECT start, goal, avoid, path[len(path)].from_node AS goal_pred FROM solved"
    extra["trace_path"] = solved_sql + (" SELECT start, goal, avoid, CASE WHEN path IS NOT NULL THEN array_to_string("
                                        "list_append(list_transform(path, lambda x: x.from_node), goal), ',') END AS vertices FROM solved")
    base = {
        "scan_nodes": net + " SELECT node_id, node_name, round(lat, 7) AS lat, round(long, 7) AS long FROM nodes",
        "scan_links": net + " SELECT link_id, link_name, node_from, node_to, length FROM edges",
        "edge_src_join": net + " SELECT link_id, src, dst, length FROM edges",
        "is_exit_link": net + " SELECT link_id, link_name, CAST(is_exit AS BIGINT) AS is_exit FROM edges",
        "exit_edges": net + " SELECT link_id, link_name, src, dst FROM edges WHERE is_exit = 1",
        "link_end_coords": net + " SELECT link_id, round(src_lat, 7) AS src_lat, round(src_long, 7) AS src_long, "
                                 "round(dst_lat, 7) AS dst_lat, round(dst_long, 7) AS dst_long FROM ecoord",
        "link_by_id": net + " SELECT link_id, link_name, src, dst, round(src_lat, 7) AS src_lat, round(dst_lat, 7) AS dst_lat "
                            "FROM ecoord WHERE link_id = '2001'",
        "scan_size_classes": net + " SELECT ac_type, category FROM sizes",
        "scan_exit_boxes": net + " SELECT exit_id, row_number() OVER (ORDER BY box_order) AS box_order, round(lat, 7) AS lat, "
                                 "round(long_upper, 7) AS long_upper, round(long_lower, 7) AS long_lower FROM boxes",
        "airport_code": f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, airport, {code_case} AS code FROM "
                        f"(SELECT n_nationkey, {spell}[n_nationkey % {len(AIRPORT_SPELLINGS)} + 1] AS airport FROM nation)",
        "scan_flights": txt + """ SELECT f.flight_id, CAST(f.n_pos AS BIGINT) AS n_positions, CAST(len(f.link_ids) AS BIGINT) AS n_links,
              p0.epoch_ms AS first_epoch, p9.epoch_ms AS last_epoch, round(p1.long, 7) AS second_long,
              f.link_ids[1] AS first_link, f.link_ids[len(f.link_ids)] AS last_link
            FROM fl f JOIN parsed p0 ON p0.flight_id = f.flight_id AND p0.i = 0
                 LEFT JOIN parsed p1 ON p1.flight_id = f.flight_id AND p1.i = 1
                 JOIN parsed p9 ON p9.flight_id = f.flight_id AND p9.i = f.n_pos - 1""",
        "arrivals_only": flt + " SELECT flight_id FROM fl WHERE flight_id % 7 <> 0",
        "drop_null_literals": flt + " SELECT flight_id FROM fl WHERE flight_id % 7 NOT IN (0, 1)",
        "min_items": flt + " SELECT flight_id FROM fl WHERE flight_id % 7 NOT IN (0, 1) AND len(link_ids) > 5 AND n_pos > 5",
        "den_link_patch": flt + " SELECT flight_id FROM fl WHERE len(list_filter(link_ids, lambda x: regexp_full_match(x, '10[0-9]{3}'))) > 0",
        "touchdown": flt + " SELECT flight_id, round(lat, 7) AS touchdownLat, round(long, 7) AS touchdownLong FROM pos WHERE i = 0",
        "hour_day": flt + " SELECT flight_id, strftime(make_timestamp(epoch_ms * 1000), '%H') AS hour, "
                          "strftime(make_timestamp(epoch_ms * 1000), '%a') AS day FROM pos WHERE i = 0",
        "landing_epoch": flt + " SELECT flight_id, epoch_ms AS landingEpoch FROM pos WHERE i = 0",
        "carrier": flt + " SELECT flight_id, regexp_replace(callsign, '\\d', '', 'g') AS carrier FROM fl",
        "decel": feat + " SELECT flight_id, decel FROM dec",
        "decel_filter": feat + " SELECT flight_id, decel FROM dec WHERE decel <= -0.5",
        "traffic": feat + " SELECT k.flight_id, k.landingEpoch, t.traffic FROM kept k JOIN traf t ON t.flight_id = k.flight_id",
        "label_real_exit": feat + " SELECT flight_id, exit FROM lab",
        "labelled_only": feat + " SELECT flight_id, exit FROM lab WHERE exit IS NOT NULL",
        "label_exit_geofence": flt + f""", gf AS (SELECT p.flight_id, p.i, b.exit_id, b.box_order
              FROM pos p JOIN pos p0 ON p0.flight_id = p.flight_id AND p0.i = 0
                   JOIN fl g ON g.flight_id = p.flight_id
                   JOIN pos p3 ON p3.flight_id = p.flight_id AND p3.i = CASE WHEN g.n_pos > 3 THEN 3 ELSE g.n_pos - 1 END, boxes b
              WHERE p.i >= 1 AND abs(abs(p.lat) - abs(b.lat)) < {d(0.00016)} AND abs(p.long) < abs(b.long_upper)
                AND abs(p.long) > abs(b.long_lower)
                AND abs({_angle('p0.long', 'abs(p0.lat)', 'p3.long', 'abs(p3.lat)')}
                        - {_angle('p0.long', 'abs(p0.lat)', 'p.long', 'abs(p.lat)')}) < {d(4.0)})
            SELECT f.flight_id, arg_min(gf.exit_id, (gf.i, gf.box_order)) AS exit
            FROM fl f LEFT JOIN gf ON gf.flight_id = f.flight_id GROUP BY f.flight_id""",
        "prepare_landings": with_ctes(NETWORK, FLIGHTS_TEXT, FEATURES_TEXT) + " SELECT flight_id, exit, runway, depAirport, aircraftType, arrGate, "
                                   "round(touchdownLat, 7) AS touchdownLat, round(touchdownLong, 7) AS touchdownLong, "
                                   "hour, day, decel, carrier, traffic FROM prepared",
        "select_features": feat + f" SELECT flight_id, exit, {', '.join(FEATURE_SUBSET)} FROM prepared",
        "vincenty_m": feat + " SELECT flight_id, i, round(dist, 3) AS dist_m FROM pdist",
        "pair_speed": feat + " SELECT flight_id, i, round(dist / (abs(CAST(t1 AS DOUBLE) - CAST(t2 AS DOUBLE)) / 1000), 3) AS speed_ms FROM pdist",
        "consecutive_pairs": flt + " SELECT a.flight_id, a.idx, a.link_id AS link_a, b.link_id AS link_b FROM flinks a "
                                   "JOIN flinks b ON a.flight_id = b.flight_id AND b.idx = a.idx + 1",
        "first_last_of_array": flt + " SELECT flight_id, link_ids[1] AS first_link, link_ids[2] AS second_link, "
                                     "link_ids[len(link_ids) - 1] AS second_last_link, link_ids[len(link_ids)] AS last_link FROM fl",
        "flat_angle": flt + f" SELECT p0.flight_id, round({_angle('p0.long', 'abs(p0.lat)', 'p3.long', 'abs(p3.lat)')}, 6) AS angle "
                            "FROM pos p0 LEFT JOIN pos p3 ON p3.flight_id = p0.flight_id AND p3.i = 3 WHERE p0.i = 0",
        "slow_vertex": graph + " SELECT flight_id, round(slow_lat, 7) AS slow_lat, round(slow_long, 7) AS slow_long, slowV FROM verts",
        "goal_vertex": graph + " SELECT flight_id, goalV FROM verts",
        "avoid_vertex": graph + " SELECT flight_id, avoidV FROM verts",
        "planar_link_distance": graph + " SELECT flight_id, idx, round(ld, 9) AS link_dist FROM lk",
        "not_adjacent": graph + " SELECT flight_id, slowV, goalV FROM nadj",
        "nearest_exit_end": with_ctes(NETWORK, FLIGHTS, FEATURES, VERTICES, exit_ends('verts')) +
                            " SELECT flight_id, near, far FROM nearfar",
        "heuristic_ft": net + f""", hp AS (SELECT u.a, u.b, n1.lat AS lat1, n1.long AS lon1, n2.lat AS lat2, n2.long AS lon2
              FROM und u JOIN nodes n1 ON n1.node_id = u.a JOIN nodes n2 ON n2.node_id = u.b),
            {vincenty_ctes('hh', 'hp', ['a', 'b'])}
            SELECT a, b, round(dist * {d(M_TO_FEET)}, 3) AS h_ft FROM hh""",
        "best_paths": with_ctes(NETWORK, FLIGHTS, FEATURES, VERTICES,
                                search("SELECT slowV AS start, goalV AS goal, avoidV AS avoid FROM nadj")) +
                      " SELECT start, goal, avoid, array_to_string(list_transform(path, lambda s: s.link_id), ',') AS path_links, "
                      f"round({_fold('path')}, 3) AS path_ft FROM solved",
        "opt_path": opt + " SELECT flight_id, slowV, goalV, array_to_string(list_transform(optPath, lambda s: s.link_id), ',') AS opt_links, "
                          "array_to_string(list_transform(optPath, lambda s: CAST(s.is_exit AS VARCHAR)), '') AS opt_flags FROM costed",
        "predicted_path": opt + " SELECT flight_id, predictedExit, array_to_string(list_transform(predPath, lambda s: s.link_id), ',') "
                                "AS pred_links, array_to_string(list_transform(predPath, lambda s: CAST(s.is_exit AS VARCHAR)), '') "
                                "AS pred_flags FROM costed",
        "rot_seconds": opt + " SELECT flight_id, round(optROT, 6) AS optROT, round(actualROT, 6) AS actualROT FROM costed",
        "taxi_seconds": opt + " SELECT flight_id, round(optTT, 6) AS optTT, round(actualTT, 6) AS actualTT FROM costed",
        "valid_times": opt + " SELECT flight_id FROM costed",
        "size_class_join": flt + " SELECT f.flight_id, f.aircraftType, coalesce(s.category, 'GA') AS size_class "
                                 "FROM fl f LEFT JOIN sizes s ON s.ac_type = f.aircraftType",
        "cost_rate_lookup": flt + f" SELECT flight_id, size_class, {passenger_case('size_class')} AS passenger_rate FROM "
                                  "(SELECT f.flight_id, coalesce(s.category, 'GA') AS size_class FROM fl f "
                                  "LEFT JOIN sizes s ON s.ac_type = f.aircraftType)",
        "cost_columns": opt + f" SELECT flight_id, {_r6(cost_cols)} FROM costed",
        "savings": opt + " SELECT flight_id, round(savings, 6) AS savings FROM costed",
        "cost_totals": opt + " SELECT flight_id, round(totalOptCost, 6) AS totalOptCost, "
                             "round(totalActualCost, 6) AS totalActualCost FROM costed",
        "optimise": opt + f" SELECT flight_id, size_class, {_r6(MEASURES)} FROM costed",
        "mean_measures": opt + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in MEASURES[:19]) + " FROM costed",
        "describe_measures": opt + " " + describe,
        "impact_societal": opt + " " + _impact([("passenger", "optPcost", "actualPcost"),
                                                ("environmental", "optEnvCost", "actualEnvCost")]),
        "impact_airline": opt + " " + _impact([("fuel", "optFuelCost", "actualFuelCost"), ("crew", "optCrewCost", "actualCrewCost"),
                                               ("maintenance", "optMaintCost", "actualMaintCost"),
                                               ("ownership", "optAOCost", "actualAOCost"), ("other", "optOtherCost", "actualOtherCost")])
                          + " UNION ALL SELECT 'rot_benefit' AS item, 0.0::DOUBLE AS optimal, round(avg(savings), 6) AS predicted, "
                            "round(avg(savings), 6) AS difference FROM costed",
        "time_reduction": opt + " " + _impact([("rot", "optROT", "actualROT"), ("taxi", "optTT", "actualTT")]),
        "distinct_counts": feat + " SELECT count(DISTINCT runway) AS num_runways, count(DISTINCT exit) AS num_exits FROM prepared",
        "path_length_sums": opt + f""" SELECT flight_id,
              round({_fold("optPath[1:coalesce(list_position(list_transform(optPath, lambda s: s.is_exit = 1), true), 0)]")}, 3) AS rot_ft,
              round({_fold('optPath')} - {_fold("optPath[1:coalesce(list_position(list_transform(optPath, lambda s: s.is_exit = 1), true), 0)]")}, 3)
                AS taxi_ft FROM costed""",
        "path_overlay": opt + """, smp AS (SELECT * FROM costed ORDER BY md5(CAST(flight_id AS VARCHAR)), flight_id LIMIT 50)
            SELECT s.flight_id, e.link_id,
                   CAST(list_contains(list_transform(s.optPath, lambda x: x.link_id), e.link_id) AS BIGINT) AS on_opt,
                   CAST(list_contains(list_transform(s.predPath, lambda x: x.link_id), e.link_id) AS BIGINT) AS on_pred,
                   CAST(e.is_exit AS BIGINT) AS is_exit, (e.src = s.slowV OR e.dst = s.slowV) AS touches_slow,
                   round(e.src_lat, 7) AS src_lat, round(e.src_long, 7) AS src_long,
                   round(e.dst_lat, 7) AS dst_lat, round(e.dst_long, 7) AS dst_long
            FROM smp s, ecoord e""",
        "node_overlay": opt + """, smp AS (SELECT * FROM costed ORDER BY md5(CAST(flight_id AS VARCHAR)), flight_id LIMIT 50)
            SELECT s.flight_id, n.node_id, n.node_name, round(n.lat, 7) AS lat, round(n.long, 7) AS long, n.node_id = s.slowV AS is_slow
            FROM smp s, nodes n""",
        "top_sample": opt + " SELECT flight_id, aircraftType, slowV, predictedExit, round(optROT, 6) AS optROT, "
                            "round(savings, 6) AS savings FROM costed ORDER BY md5(CAST(flight_id AS VARCHAR)), flight_id LIMIT 50",
    }
    base.update(extra)
    base.update(_model_sql(feat, opt, net, describe))
    base["project_vertices"] = base["scan_nodes"]
    base["project_edges"] = base["scan_links"]
    base["traffic_band_join"] = base["range_frame"] = base["traffic"]
    base["parse_epoch_ms"] = base["scan_flights"].replace(
        "SELECT f.flight_id, CAST(f.n_pos AS BIGINT) AS n_positions, CAST(len(f.link_ids) AS BIGINT) AS n_links,\n"
        "              p0.epoch_ms AS first_epoch, p9.epoch_ms AS last_epoch, round(p1.long, 7) AS second_long,\n"
        "              f.link_ids[1] AS first_link, f.link_ids[len(f.link_ids)] AS last_link",
        "SELECT f.flight_id, p0.epoch_ms AS first_epoch, p9.epoch_ms AS last_epoch")
    return base
