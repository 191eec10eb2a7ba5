"""DuckDB SQL that states each registered query independently of Spark.

The same fixture rules as ``sources.testdata`` are written out in SQL here, so
the comparison checks the Spark operators, not a shared helper.
"""

from __future__ import annotations

import re

from ..schemas import (CATEGORY_FEATURES, DEFAULT_MAX_BINS, LABEL_COL, NUMERIC_FEATURES,
                       PREDICTION_COLUMNS, incident_schema)
from ..sources import testdata as td
from ..sources.spine import SF_LAT, SF_LNG, SUN_URL_TEMPLATE, WEATHER_URL_TEMPLATE
from ..sources.testdata import TEST_POLYGONS

INCIDENTS = r"""
incidents AS (
  SELECT event_id AS Id, ts AS Dates, event_type AS Category,
         dayname(ts) AS DayOfWeek, n_name AS PdDistrict,
         CASE event_id % 4
           WHEN 0 THEN CAST((user_id % 50) * 100 AS VARCHAR) || ' Block of ' || n_name || ' ST'
           WHEN 1 THEN n_name || ' ST / ' || 'NATION_' || CAST(event_id % 25 AS VARCHAR) || ' ST'
           WHEN 2 THEN 'PIER ' || CAST(user_id % 60 AS VARCHAR)
           ELSE n_name || '/X' END AS Address,
         CAST(-122.52 + (event_id % 997) * 0.00017 AS DOUBLE) AS X,
         CAST(37.70 + (event_id % 983) * 0.00015 AS DOUBLE) AS Y
  FROM events JOIN nation ON user_id % 25 = n_nationkey)"""

TIMED = r"""
timed0 AS (
  SELECT *, CAST(hour(Dates) AS INTEGER) AS HourOfDay, CAST(month(Dates) AS INTEGER) AS Month,
         CAST(year(Dates) AS INTEGER) AS Year,
         (Dates AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC' AS "Timestamp"
  FROM incidents),
timed AS (SELECT *, strftime("Timestamp", '%Y-%m-%d') AS Date FROM timed0)"""

DESCRIPT = """'"' || Category || '", no. ' || CAST(Id AS VARCHAR)"""
RESOLUTION = "CASE WHEN Id % 3 <> 0 THEN 'NONE, ' || DayOfWeek END"
WEEKEND = "CAST(CASE WHEN DayOfWeek IN ('Friday', 'Saturday', 'Sunday') THEN 1 ELSE 0 END AS INTEGER)"

_BLOCK = r"regexp_extract(Address, '\d{1,4} Block of (.+)', 1)"
_LEFT = r"regexp_extract(Address, '(.+) / (.+)', 1)"
_RIGHT = r"regexp_extract(Address, '(.+) / (.+)', 2)"
ADDRESS_TYPE = ("CASE WHEN Address IS NULL THEN NULL WHEN contains(Address, '/') "
                "THEN 'Intersection' ELSE 'street' END")
STREET = (f"CASE WHEN Address IS NULL THEN NULL WHEN {_BLOCK} <> '' THEN {_BLOCK} "
          f"WHEN {_LEFT} <> '' THEN least({_LEFT}, {_RIGHT}) ELSE Address END")

DAYS = r"""
days AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
  FROM (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events))"""

SUN = DAYS + r""",
sun AS (
  SELECT d, strftime(d, '%Y-%m-%d') AS date,
         CASE WHEN day(d) % 10 = 0 THEN printf('12:%02d:00 PM', day(d))
              WHEN day(d) % 2 = 1 THEN printf('3:%02d:00 PM', day(d) + 10)
              ELSE printf('6:%02d:00 AM', day(d)) END AS sunrise,
         CASE WHEN day(d) % 10 = 0 THEN '11:59:59 PM'
              WHEN day(d) % 2 = 1 THEN printf('1:%02d:%02d AM', day(d), day(d))
              ELSE printf('6:%02d:00 PM', 30 - day(d)) END AS sunset
  FROM days)"""

_CLOCK = "strftime({}, '%H:%M:%S.%f')"
_PARSE12 = "strftime(try_strptime({}, '%I:%M:%S %p'), '%H:%M:%S.%f')"


def day_night_sql(t: str, sunrise: str, sunset: str) -> str:
    tt, sr, ss = _CLOCK.format(t), _PARSE12.format(sunrise), _PARSE12.format(sunset)
    return (f"CASE WHEN {tt} IS NULL OR {sr} IS NULL OR {ss} IS NULL THEN NULL "
            f"WHEN {sr} > {ss} THEN CASE WHEN {tt} > {ss} AND {tt} < {sr} THEN 'Night' ELSE 'Day' END "
            f"ELSE CASE WHEN {tt} > {sr} AND {tt} < {ss} THEN 'Day' ELSE 'Night' END END")


DAILY_WEATHER = r"""
readings AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, value AS temp, event_type AS weather,
         event_id AS seq
  FROM events),
per_condition AS (
  SELECT date, weather, count(*) AS n, sum(temp) AS s, count(temp) AS c, min(seq) AS f
  FROM readings GROUP BY date, weather),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, f) AS rn FROM per_condition),
daily AS (
  SELECT date, round(sum(s) / sum(c), 9) AS temperatureC,
         max(CASE WHEN rn = 1 THEN weather END) AS weather
  FROM ranked GROUP BY date)"""


# ---- polygons: edges written out as a VALUES table ----

def _ring_edges(text: str) -> list[tuple[str, str, str, str]]:
    pts = [tuple(p.split()) for p in (q.strip() for q in text.split(","))]
    if pts[0] != pts[-1]:
        pts.append(pts[0])
    return [(a[0], a[1], b[0], b[1]) for a, b in zip(pts, pts[1:])]


def polygon_edges_values() -> str:
    rows = []
    for ord_, name, wkt in TEST_POLYGONS:
        for ring in re.findall(r"\(([^()]+)\)", wkt):
            for x1, y1, x2, y2 in _ring_edges(ring):
                rows.append(f"({ord_}, '{name}', CAST({x1} AS DOUBLE), CAST({y1} AS DOUBLE), "
                            f"CAST({x2} AS DOUBLE), CAST({y2} AS DOUBLE))")
    return "edges(ord, name, x1, y1, x2, y2) AS (VALUES " + ", ".join(rows) + ")"


def neighborhood_ctes(points: str) -> str:
    """CTEs ending in ``hood(Id, Neighborhood)`` for every row of ``points``."""
    return polygon_edges_values() + f""",
boxes AS (
  SELECT ord, min(least(x1, x2)) AS min_x, min(least(y1, y2)) AS min_y,
         max(greatest(x1, x2)) AS max_x, max(greatest(y1, y2)) AS max_y
  FROM edges GROUP BY ord),
tests AS (
  SELECT p.Id, e.ord, e.name,
         sum(CASE WHEN ((e.y1 > p.Y) <> (e.y2 > p.Y))
                   AND (p.X < (e.x2 - e.x1) * (p.Y - e.y1) / (e.y2 - e.y1) + e.x1)
                  THEN 1 ELSE 0 END) AS crossings,
         bool_or(((e.x2 - e.x1) * (p.Y - e.y1) - (e.y2 - e.y1) * (p.X - e.x1) = 0)
                 AND p.X >= least(e.x1, e.x2) AND p.X <= greatest(e.x1, e.x2)
                 AND p.Y >= least(e.y1, e.y2) AND p.Y <= greatest(e.y1, e.y2)) AS on_edge
  FROM {points} p
  JOIN boxes b ON p.X >= b.min_x AND p.X <= b.max_x AND p.Y >= b.min_y AND p.Y <= b.max_y
  JOIN edges e ON e.ord = b.ord
  GROUP BY p.Id, e.ord, e.name),
first_hit AS (
  SELECT Id, arg_min(name, ord) AS name FROM tests
  WHERE crossings % 2 = 1 AND NOT on_edge GROUP BY Id),
hood AS (
  SELECT p.Id, coalesce(h.name, 'SF') AS Neighborhood
  FROM {points} p LEFT JOIN first_hit h ON p.Id = h.Id)"""


ENRICHED = (INCIDENTS + "," + TIMED + "," + SUN + "," + DAILY_WEATHER + r""",
featured AS (
  SELECT t.*, """ + WEEKEND + r""" AS Weekend, """ + ADDRESS_TYPE + r""" AS AddressType,
         """ + STREET + r""" AS Street, s.sunrise, s.sunset,
         """ + day_night_sql('t."Timestamp"', "s.sunrise", "s.sunset") + r""" AS DayOrNight,
         w.temperatureC, w.weather
  FROM timed t JOIN sun s ON t.Date = s.date JOIN daily w ON t.Date = w.date),
""" + neighborhood_ctes("featured") + r""",
enriched AS (SELECT f.*, h.Neighborhood FROM featured f JOIN hood h ON f.Id = h.Id)""")

ENRICHED_COLUMNS = ["Id", "Dates", "Category", "DayOfWeek", "PdDistrict", "Address", "X", "Y",
                    "HourOfDay", "Month", "Year", "Timestamp", "Date", "Weekend", "AddressType",
                    "Street", "sunrise", "sunset", "DayOrNight", "temperatureC", "weather",
                    "Neighborhood"]


def _cols(cols: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in cols)


SUN_BODIES = SUN + f""",
bodies AS (
  SELECT date, CASE
    WHEN day(d) = {td.SUN_UNAVAILABLE_DAY} THEN 'Service unavailable'
    WHEN day(d) % {td.SUN_PARTIAL_EVERY} = 0
      THEN CAST(json_object('results', json_object('sunrise', sunrise), 'status', 'OK') AS VARCHAR)
    ELSE CAST(json_object('results', json_object('sunrise', sunrise, 'sunset', sunset),
                          'status', 'OK') AS VARCHAR) END AS body
  FROM sun),
sun_parsed AS (
  SELECT date, body,
         coalesce(CASE WHEN json_valid(body) THEN json_type(body, '$.results') END = 'OBJECT',
                  false) AS ok
  FROM bodies)"""

_W_FIELDS = ("strftime(ts, '%H:%M'), {temp}, '7.0', '80', '1015.0', '10.0', 'West', '5.8', "
             "'-', 'N/A', '', event_type, '270'")
_W_TEMP = (f"CASE WHEN value < {td.WEATHER_NO_TEMP_BELOW} THEN '-' "
           "ELSE printf('%.2f', value) END")
_W_SHORT = ", ".join(_W_FIELDS.format(temp=_W_TEMP).split(", ")[:5])

WEATHER_PARSED = f"""
wresp AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_id AS rid,
         '{td.WEATHER_HEADER}' || chr(10) || '<br />' || chr(10) ||
         CASE WHEN value > {td.WEATHER_SHORT_ABOVE} THEN concat_ws(',', {_W_SHORT})
              ELSE concat_ws(',', {_W_FIELDS.format(temp=_W_TEMP)}) END || chr(10) AS body
  FROM events),
wsplit AS (SELECT date, rid, string_split(body, chr(10)) AS parts FROM wresp),
wlines AS (
  SELECT date, rid, len(parts) AS n, unnest(parts) AS line,
         CAST(unnest(range(len(parts))) AS INTEGER) AS line_no
  FROM wsplit),
wkept AS (
  SELECT *, string_split(regexp_replace(line, ',+$', ''), ',') AS fields FROM wlines
  WHERE line_no >= 2 AND NOT (line_no = n - 1 AND line = '')),
wchecked AS (
  SELECT date, rid, line_no,
         CASE WHEN len(fields) > 11 THEN TRY_CAST(fields[2] AS DOUBLE) END AS temp,
         CASE WHEN len(fields) > 11 THEN fields[12] END AS weather,
         CASE WHEN len(fields) <= 11 THEN 'too few fields'
              WHEN TRY_CAST(fields[2] AS DOUBLE) IS NULL THEN 'temperature is not a number'
         END AS reason
  FROM wkept),
wgood AS (SELECT * FROM wchecked WHERE reason IS NULL),
wper AS (
  SELECT date, weather, count(*) AS n, sum(temp) AS s, count(temp) AS c,
         min(rid * 1000 + line_no) AS f
  FROM wgood GROUP BY date, weather),
wranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, f) AS rn FROM wper),
wdaily AS (
  SELECT date, round(sum(s) / sum(c), 9) AS temperatureC,
         max(CASE WHEN rn = 1 THEN weather END) AS weather
  FROM wranked GROUP BY date)"""

KEY_BUCKET = "((('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT) % 100)"
IN_TRAIN = KEY_BUCKET.format(k="Id") + " < 70"
FOLD = "((('0x' || substr(md5('fold:' || CAST(Id AS VARCHAR)), 1, 8))::BIGINT) % 3)"
INDEXED_COLS = CATEGORY_FEATURES + [LABEL_COL]


def _levels(source: str) -> str:
    parts = [f"SELECT '{c}' AS feature, CAST(\"{c}\" AS VARCHAR) AS value FROM {source}"
             for c in INDEXED_COLS]
    return " UNION ALL ".join(parts)


FREQUENCY = f""",
levels AS ({_levels("enriched")}),
level_counts AS (SELECT feature, value, count(*) AS n FROM levels GROUP BY feature, value),
freq AS (
  SELECT feature, value,
         CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) - 1 AS DOUBLE) AS idx
  FROM level_counts)"""


def _naive_bayes_ctes(smoothing: float = 1.0, fit: str = "in_train", apply: str = "NOT v.in_train") -> str:
    """Closed form of multinomial naive Bayes over indexed features: fitted on
    the rows where ``fit`` holds, applied to those where ``apply`` does.

    pi_c = ln(n_c + 1) - ln(N + C);  theta_cj = ln(S_cj + 1) - ln(sum_j S_cj + D);
    prediction = argmax_c pi_c + sum_j x_j theta_cj, ties to the smaller index.
    """
    feats = CATEGORY_FEATURES
    joins = " ".join(
        f"JOIN freq i{j} ON i{j}.feature = '{c}' AND i{j}.value = CAST(e.\"{c}\" AS VARCHAR)"
        for j, c in enumerate(feats))
    xs = ", ".join(f"i{j}.idx AS x{j}" for j in range(len(feats)))
    sums = ", ".join(f"sum(x{j}) AS s{j}" for j in range(len(feats)))
    total = " + ".join(f"s{j}" for j in range(len(feats)))
    thetas = ", ".join(f"ln(s{j} + {smoothing}) - ln({total} + {smoothing * len(feats)}) AS t{j}"
                       for j in range(len(feats)))
    dot = " + ".join(f"v.x{j} * p.t{j}" for j in range(len(feats)))
    return f""",
vec AS (
  SELECT e.Id, {IN_TRAIN.replace("Id", "e.Id")} AS in_train,
         {FOLD.replace("Id", "e.Id")} AS fold, lab.idx AS y, {xs}
  FROM enriched e {joins}
  JOIN freq lab ON lab.feature = '{LABEL_COL}' AND lab.value = e.{LABEL_COL}),
cls AS (SELECT y, count(*) AS n, {sums} FROM vec WHERE {fit} GROUP BY y),
tot AS (SELECT sum(n) AS big_n, count(*) AS big_c FROM cls),
params AS (
  SELECT y, ln(n + {smoothing}) - ln(big_n + big_c * {smoothing}) AS pi, {thetas} FROM cls, tot),
scores AS (
  SELECT v.Id, v.y AS label, p.y AS cls, p.pi + ({dot}) AS score
  FROM vec v, params p WHERE {apply}),
best AS (
  SELECT Id, label, cls AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY Id ORDER BY score DESC, cls) AS rk FROM scores)
  WHERE rk = 1)"""


def _nb_cross_validation() -> str:
    """(smoothing, mean_accuracy) of the two-map grid over three folds."""
    runs = []
    for smoothing in (1.0, 10.0):
        for fold in range(3):
            nb = _naive_bayes_ctes(smoothing, f"in_train AND fold <> {fold}", f"v.in_train AND v.fold = {fold}")
            runs.append(f"""SELECT {smoothing} AS smoothing, acc FROM (
  WITH {nb.strip().lstrip(",")}
  SELECT CAST(sum(CASE WHEN prediction = label THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS acc FROM best)""")
    return ("WITH " + ENRICHED.replace("enriched AS (", "enriched AS MATERIALIZED (", 1) + FREQUENCY
            + ",\nruns AS (" + " UNION ALL ".join(runs) + "),\n"
            "maps AS (SELECT smoothing, avg(acc) AS mean_accuracy FROM runs GROUP BY smoothing) ")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["time_features"] = ("WITH " + INCIDENTS + "," + TIMED +
                          ' SELECT Id, Dates, HourOfDay, Month, Year, "Timestamp", Date FROM timed')
    q["weekend_feature"] = ("WITH " + INCIDENTS +
                            f" SELECT Id, DayOfWeek, {WEEKEND} AS Weekend FROM incidents")
    q["address_features"] = ("WITH " + INCIDENTS +
                             f" SELECT Id, Address, {ADDRESS_TYPE} AS AddressType, {STREET} AS Street"
                             " FROM incidents")
    q["daily_weather"] = "WITH " + DAILY_WEATHER + " SELECT date, temperatureC, weather FROM daily"
    q["weather_join"] = ("WITH " + INCIDENTS + "," + TIMED + "," + DAILY_WEATHER +
                         " SELECT t.Id, t.Date, w.temperatureC, w.weather"
                         " FROM timed t JOIN daily w ON t.Date = w.date")
    q["day_night"] = ("WITH " + INCIDENTS + "," + TIMED + "," + SUN +
                      ' SELECT t.Id, t."Timestamp", t.Date, s.sunrise, s.sunset, ' +
                      day_night_sql('t."Timestamp"', "s.sunrise", "s.sunset") +
                      " AS DayOrNight FROM timed t JOIN sun s ON t.Date = s.date")
    q["neighborhood"] = ("WITH " + INCIDENTS + "," + neighborhood_ctes("incidents") +
                         " SELECT i.Id, i.X, i.Y, h.Neighborhood FROM incidents i"
                         " JOIN hood h ON i.Id = h.Id")
    q["enriched"] = "WITH " + ENRICHED + f" SELECT {_cols(ENRICHED_COLUMNS)} FROM enriched"
    q["request_list"] = ("WITH " + DAYS + " SELECT strftime(d, '%Y-%m-%d') AS date, "
                         f"printf('{SUN_URL_TEMPLATE}', CAST({SF_LAT} AS DOUBLE), "
                         f"CAST({SF_LNG} AS DOUBLE), strftime(d, '%Y-%m-%d')) AS sun_url, "
                         f"printf('{WEATHER_URL_TEMPLATE}', year(d), month(d), day(d)) AS weather_url"
                         " FROM days")
    q["sun_responses"] = ("WITH " + SUN_BODIES +
                          " SELECT date, json_extract_string(body, '$.results.sunrise') AS sunrise,"
                          " json_extract_string(body, '$.results.sunset') AS sunset"
                          " FROM sun_parsed WHERE ok")
    q["sun_rejected"] = ("WITH " + SUN_BODIES +
                         " SELECT date, 'no results object' AS reason FROM sun_parsed WHERE NOT ok")
    q["weather_readings"] = ("WITH " + WEATHER_PARSED +
                             " SELECT date, rid, line_no, temp, weather FROM wgood")
    q["weather_rejected"] = ("WITH " + WEATHER_PARSED +
                             " SELECT date, rid, line_no, reason FROM wchecked WHERE reason IS NOT NULL")
    q["weather_table"] = "WITH " + WEATHER_PARSED + " SELECT date, temperatureC, weather FROM wdaily"
    q["key_split"] = "WITH " + INCIDENTS + f" SELECT Id, {IN_TRAIN} AS in_train FROM incidents"
    combined = _cols(NUMERIC_FEATURES + CATEGORY_FEATURES)
    q["combined_features"] = "WITH " + ENRICHED + f" SELECT {combined} FROM enriched"
    q["combined_count"] = "WITH " + ENRICHED + " SELECT count(*) AS n FROM enriched"
    q["frequency_index"] = "WITH " + ENRICHED + FREQUENCY + " SELECT feature, value, idx FROM freq"
    q["csv_roundtrip"] = ("WITH " + INCIDENTS +
                          f" SELECT Id, Dates, Category, {DESCRIPT} AS Descript, DayOfWeek, PdDistrict,"
                          f" {RESOLUTION} AS Resolution, Address, X, Y FROM incidents")
    rules = {"Descript": f"{DESCRIPT} AS Descript", "Resolution": f"{RESOLUTION} AS Resolution"}
    training = ", ".join(rules.get(f.name, f.name) for f in incident_schema())
    q["training_csv"] = "WITH " + INCIDENTS + f" SELECT {training} FROM incidents"
    q["csv_accepted"] = ("WITH " + INCIDENTS + " SELECT date_trunc('second', Dates) AS Dates, Category, DayOfWeek,"
                         " PdDistrict, Address, CAST(Id % 180 AS DOUBLE) AS X, CAST(Id % 90 AS DOUBLE) AS Y"
                         " FROM incidents WHERE Id % 7 <> 0 AND Id % 11 <> 0 AND Id % 13 <> 0")
    q["csv_rejected"] = (
        "WITH " + INCIDENTS + " SELECT concat_ws(',', CASE WHEN Id % 7 = 0 THEN 'not a time'"
        " ELSE strftime(Dates, '%Y-%m-%d %H:%M:%S') END, Category, 'none', DayOfWeek, PdDistrict, 'none', Address,"
        " CAST(Id % 180 AS VARCHAR), CASE WHEN Id % 7 = 0 THEN CAST(Id % 90 AS VARCHAR) WHEN Id % 11 <> 0"
        " THEN CAST(Id % 90 AS VARCHAR) || ',more' END) AS line,"
        " CASE WHEN Id % 7 = 0 THEN 'value' ELSE 'fields' END AS reason"
        " FROM incidents WHERE Id % 7 = 0 OR Id % 11 = 0 OR Id % 13 = 0")
    q["sun_json_array"] = "WITH " + SUN + " SELECT date, sunrise, sunset FROM sun"
    q["weather_json_array"] = "WITH " + DAILY_WEATHER + " SELECT date, temperatureC, weather FROM daily"
    q["neighborhood_json_array"] = q["neighborhood"]
    q["key_split_with_nulls"] = (
        "WITH " + INCIDENTS + ", keyed AS (SELECT Id, CASE WHEN Id % 7 <> 0 THEN CAST(Id AS VARCHAR) END AS k FROM incidents)"
        " SELECT Id, k, CASE WHEN coalesce(" + KEY_BUCKET.format(k="k") + ", 0) < 70"
        " THEN 'train' ELSE 'test' END AS part FROM keyed")
    q["random_split"] = ("WITH " + ENRICHED + " SELECT Id, Category, CASE WHEN"
                         " (('0x' || substr(md5('42:' || CAST(Id AS VARCHAR)), 1, 8))::BIGINT) / 4294967296.0 < 0.7"
                         " THEN 'train' ELSE 'test' END AS part FROM enriched")
    q["random_split_rows"] = ("WITH " + ENRICHED + " SELECT Category, DayOfWeek, PdDistrict, count(*) AS n"
                              " FROM enriched GROUP BY ALL")
    q["nb_cv_metrics"] = (_nb_cross_validation() + "SELECT 'smoothing=' || CAST(smoothing AS VARCHAR) AS params,"
                          " round(mean_accuracy, 9) AS mean_accuracy FROM maps")
    q["nb_best_params"] = (_nb_cross_validation() + "SELECT 'smoothing' AS param, CAST(smoothing AS DOUBLE) AS value"
                           " FROM maps ORDER BY mean_accuracy DESC, smoothing LIMIT 1")
    q["json_roundtrip"] = "WITH " + DAILY_WEATHER + " SELECT date, temperatureC, weather FROM daily"
    q["sun_json_roundtrip"] = "WITH " + SUN + " SELECT date, sunrise, sunset FROM sun"
    nb = "WITH " + ENRICHED + FREQUENCY + _naive_bayes_ctes()
    pred_cols = ", ".join(f'e."{c}"' for c in PREDICTION_COLUMNS if c != "PredictedCategory")
    q["nb_predictions"] = (nb + f" SELECT e.Id, {pred_cols}, lab.value AS PredictedCategory"
                           " FROM best b JOIN enriched e ON e.Id = b.Id"
                           f" JOIN freq lab ON lab.feature = '{LABEL_COL}' AND lab.idx = b.prediction")
    plain = ", ".join(f'"{c}"' for c in PREDICTION_COLUMNS if c != "PredictedCategory")
    for kind in ("dt", "rf"):
        q[f"{kind}_scored_rows"] = ("WITH " + ENRICHED + f" SELECT Id, {plain}, true AS known FROM enriched"
                                    f" WHERE NOT {IN_TRAIN}")
        q[f"{kind}_importance_sum"] = (f"SELECT {len(NUMERIC_FEATURES + CATEGORY_FEATURES)} AS n,"
                                       " true AS none_negative, CAST(1.0 AS DOUBLE) AS total")
    # this regression's penalty shrinks every coefficient to zero (a test asserts it),
    # so it predicts the most frequent training label
    usual = (f"(SELECT {LABEL_COL} FROM enriched JOIN freq ON feature = '{LABEL_COL}' AND value = {LABEL_COL}"
             f" WHERE {IN_TRAIN} GROUP BY {LABEL_COL}, idx ORDER BY count(*) DESC, idx LIMIT 1)")
    q["lr_predictions"] = ("WITH " + ENRICHED + FREQUENCY + f" SELECT Id, {plain}, {usual} AS PredictedCategory"
                           f" FROM enriched WHERE NOT {IN_TRAIN}")
    q["lr_accuracy"] = ("WITH " + ENRICHED + FREQUENCY +
                        f" SELECT avg(CASE WHEN {LABEL_COL} = {usual} THEN 1.0 ELSE 0.0 END) AS accuracy"
                        f" FROM enriched WHERE NOT {IN_TRAIN}")
    q["neighborhood_from_file"] = q["neighborhood"]
    q["predictions_csv"] = q["nb_predictions"]
    q["nb_accuracy"] = (nb + " SELECT CAST(sum(CASE WHEN prediction = label THEN 1 ELSE 0 END) AS DOUBLE)"
                        " / count(*) AS accuracy FROM best")
    return q | _tree_sql(plain)


def _tree_sql(plain: str) -> dict[str, str]:
    """Everything a fitted tree says, from a tree grown in SQL."""
    from . import tree_oracles as T
    start = "WITH " + ENRICHED.replace("enriched AS (", "enriched AS MATERIALIZED (", 1) + FREQUENCY
    deep = start + T.tree_ctes(10, DEFAULT_MAX_BINS)
    flat = start + T.tree_ctes(4, DEFAULT_MAX_BINS)
    names = "[" + ", ".join(f"'{c}Indexed'" for c in CATEGORY_FEATURES) + ", " + ", ".join(
        f"'{c}'" for c in NUMERIC_FEATURES) + "]"
    n_cat = len(CATEGORY_FEATURES)

    def splits(depth: int) -> str:
        ranked = " UNION ALL ".join(f"SELECT node, f, v, place FROM ranked{d}" for d in range(depth))
        # the levels that go left: the bits of a two-set cut, or the first in order of impurity
        return f""", lefts AS (
  SELECT s.node, string_agg(v::INT::VARCHAR, ',' ORDER BY v) AS levels FROM (
    SELECT s.node, r.v FROM splits s JOIN ({ranked}) r ON r.node = s.node AND r.f = s.f AND r.place <= s.place
    UNION ALL SELECT node, v FROM (SELECT node, place, unnest(range(31)) AS v FROM splits JOIN few USING (f)
              WHERE place = s) WHERE (place::BIGINT >> v::INT) & 1 = 1) s GROUP BY s.node),
said AS (
  SELECT s.node, {names}[f + 1] AS feature, CASE WHEN f >= {n_cat} THEN cut END AS threshold,
         CASE WHEN f >= {n_cat} THEN '' ELSE levels END AS left_levels, round(gain, 9) AS gain, n::BIGINT AS n
  FROM splits s LEFT JOIN lefts USING (node)) """
    rows = ", ".join(f'e.{c.strip()}' for c in plain.split(","))
    predicted = (f" SELECT e.Id, {rows}, lab.value AS PredictedCategory FROM ends b JOIN enriched e ON e.Id = b.Id"
                 f" JOIN freq lab ON lab.feature = '{LABEL_COL}' AND lab.idx = b.prediction WHERE NOT b.in_train")
    slots = ", ".join(f"x[{j + 1}] AS x{j}" for j in range(n_cat + len(NUMERIC_FEATURES)))
    return {
        "assembled_features": start + T.vector_ctes(DEFAULT_MAX_BINS) + f" SELECT Id, y AS label, {slots} FROM vec",
        "dt_predictions": deep + predicted,
        "dt_accuracy": deep + (" SELECT CAST(sum(CASE WHEN prediction = y THEN 1 ELSE 0 END) AS DOUBLE) / count(*)"
                               " AS accuracy FROM ends WHERE NOT in_train"),
        "dt_importance": deep + T.importance_sql(),
        "dt_importance_from_rows": deep + T.importance_sql(),
        "dt_splits": deep + splits(10) + "SELECT * FROM said",
        # a row's place in the tree that is left when leaves of one prediction are one
        "dt_leaf_rows": deep + f""", way AS (
  SELECT Id, prediction, node >> unnest(range(11)) AS node FROM ends WHERE NOT in_train),
leaf AS (SELECT Id, prediction, max(node) AS node FROM way
         WHERE node = 1 OR (node >> 1) IN (SELECT node FROM splits) GROUP BY Id, prediction)
SELECT l.node, e.{LABEL_COL}, lab.value AS PredictedCategory, count(*) AS n
FROM leaf l JOIN enriched e USING (Id) JOIN freq lab ON lab.feature = '{LABEL_COL}' AND lab.idx = l.prediction
GROUP BY ALL""",
        "rf_plain_splits": flat + splits(4) + "SELECT tree, said.* FROM said, (SELECT unnest([0, 1, 2])::INT AS tree)",
        "rf_plain_predictions": flat + predicted,
    }
