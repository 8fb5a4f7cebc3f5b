"""DuckDB oracle SQL for every registered query.

Each string runs on the driver's pre-registered views (lineitem, orders, ...)
and first re-derives the work-history fixtures with the SQL of FIXTURES.md.
The oracles are written the plain way (LAG / ROW_NUMBER windows, explode via
``unnest``, ``LAST`` over the raw frame); the Spark side uses skew-safe
rewrites, so agreement checks the rewrites.

Conventions shared with the Spark side: as-of date 2002-01-01, origin India,
destination United States, cut-off 1990-01-01, means computed exactly as
CAST(SUM(CAST(salary AS DECIMAL(18,2))) AS DOUBLE) / COUNT(salary).
"""

from __future__ import annotations

# Fixed values shared with the Spark side (see workpanel.plans.queries).
AS_OF = "2002-01-01"
ORIGIN = "India"
DESTINATION = "United States"
CUTOFF = "1990-01-01"

POSITIONS = """
SELECT o_custkey AS user_id,
  concat(CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING),'-',CAST(l_partkey AS STRING),'-',CAST(l_suppkey AS STRING)) AS position_id,
  CASE WHEN (l_orderkey*7+l_linenumber)%10=0 THEN NULL WHEN (l_orderkey+l_linenumber)%29=0 THEN 'empty' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS startdate,
  CASE WHEN (l_orderkey*3+l_linenumber)%9=0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS enddate,
  CASE WHEN n_nationkey%4=1 THEN 'India' WHEN n_nationkey%4=2 THEN 'United States' ELSE n_name END AS country,
  CASE WHEN l_suppkey%13=12 THEN NULL WHEN l_suppkey%13=11 THEN 'empty' ELSE concat('State_',CAST(l_suppkey%13 AS STRING)) END AS state,
  CASE WHEN l_linenumber=7 THEN NULL ELSE concat('Metro_',CAST(n_regionkey AS STRING)) END AS metro_area,
  concat('Loc_',CAST(n_nationkey AS STRING)) AS location_raw,
  CASE WHEN p_size%17=0 THEN NULL ELSE concat(CAST(11+p_size%9 AS STRING),'-',CAST(1000+p_size AS STRING),'.00') END AS onet_code,
  CASE WHEN l_quantity=13 THEN NULL ELSE l_extendedprice END AS salary
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey
  JOIN nation ON s_nationkey=n_nationkey JOIN part ON l_partkey=p_partkey
"""

EDUCATION = """
SELECT o_custkey AS user_id, o_orderkey AS education_id,
  CASE WHEN o_orderkey%31=0 THEN NULL WHEN o_orderkey%29=0 THEN 'empty'
       WHEN o_orderpriority='1-URGENT' THEN 'High School' WHEN o_orderpriority='2-HIGH' THEN 'Associate'
       WHEN o_orderpriority='3-MEDIUM' THEN 'Bachelor' WHEN o_orderpriority='5-LOW' THEN 'Doctor' ELSE 'Master' END AS degree,
  CASE WHEN o_orderkey%11=0 THEN NULL ELSE CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 10 YEAR AS DATE) AS STRING) END AS enddate,
  CASE WHEN o_orderkey%5=0 THEN 'empty' ELSE concat('Uni_',CAST(o_orderkey%50 AS STRING)) END AS university_name,
  CASE WHEN o_orderkey%3=0 THEN 'India' WHEN o_orderkey%3=1 THEN 'United States' ELSE 'empty' END AS university_country,
  CASE WHEN o_orderkey%13=0 THEN NULL ELSE concat('Town_',CAST(o_orderkey%40 AS STRING)) END AS university_location,
  CASE WHEN o_orderkey%6=0 THEN NULL ELSE concat('Field_',CAST(o_orderkey%8 AS STRING)) END AS field
FROM orders
"""

_MAPPER_COLS = """
SELECT concat('Loc_',CAST(n_nationkey AS STRING)) AS location,
  CASE WHEN n_nationkey%6=5 THEN NULL ELSE concat('Metro_',CAST(n_regionkey AS STRING)) END AS metro_area,
  CASE WHEN n_nationkey%7=0 THEN 'empty' WHEN n_nationkey%7=1 THEN NULL ELSE concat('City_',CAST(n_nationkey AS STRING)) END AS city
FROM nation"""

CITY_PART0 = _MAPPER_COLS + " WHERE n_nationkey<15"
CITY_PART1 = (_MAPPER_COLS + " WHERE n_nationkey>=10\nUNION ALL SELECT concat('Loc_',CAST(n_nationkey AS STRING)), "
              "concat('Metro_',CAST(n_regionkey AS STRING)), 'City_4b' FROM nation WHERE n_nationkey=4")

FIXTURES = {
    "positions": POSITIONS,
    "education": EDUCATION,
    "city_mapper_part0": CITY_PART0,
    "city_mapper_part1": CITY_PART1,
}


def with_ctes(ctes: list[tuple[str, str]], body: str) -> str:
    """``WITH`` the fixture views (only those referenced) plus ``ctes``, then ``body``."""
    text = " ".join(sql for _, sql in ctes) + " " + body
    parts = [(n, s) for n, s in FIXTURES.items() if n in text]
    parts += ctes
    inner = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in parts)
    return f"WITH {inner}\n{body}"


# ---- building blocks ---------------------------------------------------------

P_COLS = ("user_id, position_id, startdate, enddate, country, state, metro_area, "
          "location_raw, onet_code, salary")
YEARS3 = "CAST(e0 - INTERVAL 3 YEAR AS DATE)"
DAYS1095 = "CAST(e0 - INTERVAL 1095 DAY AS DATE)"
COLLEGE = f"COALESCE(college_enddate, {YEARS3})"
MEAN = ("CAST(SUM(CAST(salary AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(COUNT(salary), 0) "
        "AS mean_salary, COUNT(salary) AS n_individuals")
SPAN_AS_CODED = ("CASE WHEN sy <= ey - 1 THEN generate_series(sy, ey - 1) "
                 "ELSE generate_series(sy, ey - 1, -1) END")
SPAN_FORWARD = "CASE WHEN sy < ey THEN generate_series(sy, ey - 1) WHEN sy = ey THEN [sy] END"
LOCATED = ("location IS NOT NULL AND location <> 'empty' AND city IS NOT NULL "
           "AND city <> 'empty'")


def clean(src: str, fallback: str, fill: bool = True,
          order: str = "start") -> list[tuple[str, str]]:
    """The cleaning block: parse, LAG fill, close at as-of, flag, fallback."""
    by = ("sd ASC NULLS FIRST, " if order == "start" else "") + "ed ASC NULLS FIRST, position_id ASC"
    lag = f"LAG(ed) OVER (PARTITION BY user_id ORDER BY {by})" if fill else "CAST(NULL AS DATE)"
    return [
        ("src", src),
        ("p", "SELECT *, TRY_CAST(startdate AS DATE) AS sd, TRY_CAST(enddate AS DATE) AS ed FROM src"),
        ("l", f"SELECT *, {lag} AS pe FROM p"),
        ("f", f"SELECT *, COALESCE(sd, pe) AS s0, COALESCE(ed, DATE '{AS_OF}') AS e0 FROM l"),
        ("g", f"SELECT *, COALESCE(s0, {fallback}) AS s1, "
              "CASE WHEN s0 IS NULL THEN 1 ELSE 0 END AS start_date_flag FROM f"),
        ("gy", "SELECT *, CAST(year(s1) AS INTEGER) AS sy, CAST(year(e0) AS INTEGER) AS ey FROM g"),
    ]


def spells_cols(extra: str = "") -> str:
    return (f"{P_COLS}, s1 AS start_date_dt, e0 AS end_date_dt, start_date_flag"
            + (f", {extra}" if extra else ""))


def year_panel(frm: str, span: str = SPAN_AS_CODED, where: str = "TRUE",
               extra: str = "") -> tuple[str, str]:
    return ("panel", f"SELECT {spells_cols(extra)}, sy AS start_year, ey AS end_year, "
                     f"CAST(unnest({span}) AS INTEGER) AS year FROM {frm} WHERE {where}")


def cells(keys: str, frm: str = "panel", people: bool = False) -> str:
    mean = MEAN
    if people:
        mean = mean.replace("COUNT(salary) AS n_individuals",
                            "COUNT(DISTINCT CASE WHEN salary IS NOT NULL THEN user_id END) "
                            "AS n_individuals")
    return f"SELECT {keys}, {mean} FROM {frm} GROUP BY {keys}"


MOVERS = ("SELECT user_id FROM positions WHERE user_id IS NOT NULL GROUP BY user_id "
          f"HAVING bool_or(country = '{ORIGIN}') AND bool_or(country = '{DESTINATION}')")
MOVER_ROWS = "SELECT * FROM positions WHERE user_id IN (SELECT user_id FROM mv)"


def latest_edu(before: bool) -> str:
    cut = f" AND college_enddate < DATE '{CUTOFF}'" if before else ""
    return ("SELECT user_id, college_enddate, university_location FROM ("
            "SELECT user_id, TRY_CAST(enddate AS DATE) AS college_enddate, university_location, "
            "ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY TRY_CAST(enddate AS DATE) DESC NULLS LAST, "
            f"education_id ASC) AS rn FROM education WHERE university_country = '{ORIGIN}') t "
            f"WHERE rn = 1{cut}")


WITH_EDU = ("SELECT m.*, le.college_enddate, le.university_location FROM mp m "
            "LEFT JOIN le ON m.user_id = le.user_id")
LAST_ORIGIN = ("SELECT user_id, state AS last_origin_state FROM (SELECT user_id, state, "
               "ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY e0 DESC NULLS LAST, position_id ASC) "
               f"AS rn FROM gy WHERE country = '{ORIGIN}') t WHERE rn = 1")


def resident(fallback: str) -> list[tuple[str, str]]:
    return clean(f"SELECT * FROM positions WHERE country = '{ORIGIN}'", fallback)


MOVERS_ORDERED = ("SELECT user_id FROM (SELECT *, TRY_CAST(startdate AS DATE) AS sd0 FROM positions) q "
                  "WHERE user_id IS NOT NULL GROUP BY user_id "
                  f"HAVING bool_or(country = '{ORIGIN}') AND bool_or(country = '{DESTINATION}') "
                  f"AND MIN(CASE WHEN country = '{ORIGIN}' THEN sd0 END) < "
                  f"MAX(CASE WHEN country = '{DESTINATION}' THEN sd0 END)")


def movers_clean(fallback: str, src: str = MOVER_ROWS, pre: bool = False,
                 ordered: bool = False) -> list[tuple[str, str]]:
    head = [("mv", MOVERS_ORDERED if ordered else MOVERS)]
    if pre:
        head.append(("le", latest_edu(True)))
    return head + [("mp", src)] + clean("SELECT * FROM mp", fallback)


def origin_rows(pre: bool, ordered: bool = False) -> list[tuple[str, str]]:
    src = MOVER_ROWS + (" AND user_id IN (SELECT user_id FROM le)" if pre else "")
    return movers_clean(DAYS1095, src, pre, ordered) + [
        ("lo", LAST_ORIGIN),
        ("dest", f"SELECT d.*, lo.last_origin_state FROM gy d LEFT JOIN lo ON d.user_id = lo.user_id "
                 f"WHERE d.country = '{DESTINATION}'"),
        year_panel("dest", where="ey >= sy", extra="last_origin_state"),
    ]


def university_rows(pre: bool) -> list[tuple[str, str]]:
    join = "JOIN le ON m.user_id = le.user_id" if pre else "LEFT JOIN le ON m.user_id = le.user_id"
    return ([("mv", MOVERS), ("mp", MOVER_ROWS), ("le", latest_edu(pre)),
             ("pe_", f"SELECT m.*, le.college_enddate, le.university_location FROM mp m {join}")]
            + clean("SELECT * FROM pe_", COLLEGE)
            + [year_panel("gy", where=f"country = '{DESTINATION}'",
                          extra="college_enddate, university_location")])


def month_rows() -> list[tuple[str, str]]:
    return resident(DAYS1095) + [
        ("gm", "SELECT *, CAST(date_trunc('month', s1) AS DATE) AS m0, "
               "CAST(date_trunc('month', e0) AS DATE) AS m1 FROM g"),
        ("pm", "SELECT *, unnest(generate_series(CAST(m0 AS TIMESTAMP), CAST(m1 AS TIMESTAMP), "
               "INTERVAL 1 MONTH)) AS ym_ts FROM gm WHERE m1 >= m0"),
        ("panel", f"SELECT {spells_cols()}, m0 AS start_year_month, m1 AS end_year_month, "
                  "CAST(ym_ts AS DATE) AS year_month FROM pm"),
    ]


# ---- education ---------------------------------------------------------------

LEVEL_SQL = ("CASE WHEN degree IN ('High School', 'Associate', 'Bachelor') THEN degree "
             "ELSE 'Post Graduate' END")
_FOUR = [("location_raw", "university_location"), ("country", "university_country"),
         ("name", "university_name"), ("enddate", "enddate")]
_FIVE = [("location_raw", "university_location"), ("country", "university_country"),
         ("field", "field"), ("name", "university_name"), ("enddate", "enddate")]
_LAYOUT = [("High School", "high_school", _FOUR), ("Associate", "associates", _FOUR),
           ("Bachelor", "college", _FIVE), ("Post Graduate", "post_grad", _FIVE)]
WIDE = [(f"{p}_{s}", lvl, src) for lvl, p, parts in _LAYOUT for s, src in parts]
MARKED = ("SELECT user_id, education_id, enddate, Educ_Level, "
          + ", ".join(f"CASE WHEN Educ_Level = '{lvl}' THEN {src} END AS {name}"
                      for name, lvl, src in WIDE)
          + f" FROM (SELECT *, {LEVEL_SQL} AS Educ_Level FROM education) e")


def wide(clean_first: bool) -> str:
    def one(name):
        v = f"NULLIF({name}, 'empty')" if clean_first else name
        agg = (f"first({v} ORDER BY TRY_CAST(enddate AS DATE) DESC NULLS LAST, education_id ASC) "
               f"FILTER (WHERE {v} IS NOT NULL)")
        return (agg if clean_first else f"NULLIF({agg}, 'empty')") + f" AS {name}"
    return with_ctes([("mk", MARKED)],
                     "SELECT user_id, " + ", ".join(one(n) for n, _, _ in WIDE)
                     + " FROM mk GROUP BY user_id")


# ---- places ----------------------------------------------------------------------

UNION = "SELECT * FROM city_mapper_part0 UNION ALL SELECT * FROM city_mapper_part1"
MERGED = f"SELECT DISTINCT * FROM ({UNION}) u"


def attach(null_safe: bool = True) -> list[tuple[str, str]]:
    eq = "IS NOT DISTINCT FROM" if null_safe else "="
    return [("mg", MERGED),
            ("att", f"SELECT p.*, m.location, m.city FROM positions p LEFT JOIN mg m "
                    f"ON p.location_raw {eq} m.location AND p.metro_area {eq} m.metro_area")]


def _q(ctes, body):
    return with_ctes(ctes, body)


# columns of a cell job by name, nulls first
NO_ID_TIE = ", ".join(f"{c} ASC NULLS FIRST" for c in
                      ["country", "enddate", "onet_code", "salary", "startdate", "state", "user_id"])


def build() -> dict[str, str]:
    panel_year = _q(resident(YEARS3) + [year_panel("gy")], "SELECT * FROM panel")
    cell_state_year = _q(resident(YEARS3) + [year_panel("gy")], cells("onet_code, state, year"))
    cell_state_month = _q(month_rows(),
                          "SELECT split_part(onet_code, '-', 1) AS onet_code_f2, state, "
                          f"strftime(year_month, '%Y-%m') AS year_month, {MEAN} FROM panel "
                          "GROUP BY 1, 2, 3")
    cell_origin_year = _q(origin_rows(False), cells("onet_code, last_origin_state, year"))
    all_rows = lambda fb: _q(clean("SELECT * FROM positions", fb),
                             "SELECT position_id, user_id, s1 AS start_date_dt, "
                             "e0 AS end_date_dt, start_date_flag FROM g")
    o = {
        # scans and sinks
        "scan_positions": _q([], "SELECT * FROM positions"),
        "scan_education": _q([], "SELECT * FROM education"),
        "scan_city_csv": _q([], UNION),
        "scan_old_dates": _q([], "SELECT education_id, user_id, CAST(TRY_CAST(enddate AS DATE) "
                                 "- INTERVAL 500 YEAR AS DATE) AS enddate_dt FROM education"),
        "sink_city_mapper_parquet": _q([], MERGED),
        "sink_located_by_file": _q(attach(), f"SELECT * FROM att WHERE {LOCATED}"),
        "sink_unlocated_text": _q(attach(), f"SELECT user_id FROM att WHERE NOT COALESCE({LOCATED}, FALSE)"),
        "sink_csv_roundtrip": cell_state_year,
        "sink_ignore_roundtrip": panel_year,
        "sink_parquet_roundtrip": cell_state_month,
        "sink_single_csv": cell_origin_year,
        # cleaning steps
        "parse_dates": _q([], "SELECT position_id, TRY_CAST(startdate AS DATE) AS start_date_dt, "
                              "TRY_CAST(enddate AS DATE) AS end_date_dt FROM positions"),
        "fill_start": _q(clean("SELECT * FROM positions", YEARS3),
                         "SELECT position_id, user_id, s0 AS start_date_dt, ed AS end_date_dt FROM f"),
        "fill_start_end_order": _q(
            [("p", "SELECT *, TRY_CAST(startdate AS DATE) AS sd, TRY_CAST(enddate AS DATE) AS ed "
                   "FROM positions")],
            "SELECT position_id, user_id, COALESCE(sd, LAG(ed) OVER (PARTITION BY user_id "
            "ORDER BY ed ASC NULLS FIRST, position_id ASC)) AS start_date_dt, ed AS end_date_dt FROM p"),
        "close_open": _q([], f"SELECT position_id, COALESCE(TRY_CAST(enddate AS DATE), DATE '{AS_OF}') "
                             "AS end_date_dt FROM positions"),
        "backfill_years3": all_rows(YEARS3),
        "backfill_days1095": all_rows(DAYS1095),
        "start_flag": _q(resident(YEARS3), "SELECT position_id, start_date_flag FROM g"),
        "backfill_college": _q([("mv", MOVERS), ("mp", MOVER_ROWS), ("le", latest_edu(False)),
                                ("pe_", WITH_EDU)] + clean("SELECT * FROM pe_", COLLEGE),
                               "SELECT position_id, s1 AS start_date_dt, college_enddate, "
                               "start_date_flag FROM g"),
        "month_floor": _q([], "SELECT position_id, "
                              "CAST(date_trunc('month', TRY_CAST(startdate AS DATE)) AS DATE) AS start_year_month, "
                              "CAST(date_trunc('month', TRY_CAST(enddate AS DATE)) AS DATE) AS end_year_month "
                              "FROM positions"),
        "date_parts": _q([("p", "SELECT position_id, TRY_CAST(startdate AS DATE) AS sd, "
                                "TRY_CAST(enddate AS DATE) AS ed FROM positions")],
                         "SELECT position_id, CAST(year(sd) AS INTEGER) AS start_year, "
                         "CAST(month(sd) AS INTEGER) AS start_month, CAST(year(ed) AS INTEGER) AS end_year, "
                         "CAST(month(ed) AS INTEGER) AS end_month FROM p"),
        "occupation_major": _q([], "SELECT position_id, onet_code, split_part(onet_code, '-', 1) "
                                   "AS onet_code_f2 FROM positions"),
        "filter_country": _q([], f"SELECT * FROM positions WHERE country = '{ORIGIN}'"),
        "blank_sentinel": _q([], "SELECT user_id, education_id, "
                                 + ", ".join(f"NULLIF({c}, 'empty') AS {c}" for c in
                                             ["degree", "enddate", "university_name",
                                              "university_country", "university_location", "field"])
                                 + " FROM education"),
        # panels and cells
        "panel_year": panel_year,
        "panel_year_no_reversed": _q(resident(YEARS3) + [year_panel("gy", where="ey >= sy")],
                                     "SELECT * FROM panel"),
        "panel_year_forward": _q(resident(YEARS3) + [year_panel("gy", span=SPAN_FORWARD)],
                                 "SELECT * FROM panel"),
        "panel_month": _q(month_rows(), "SELECT * FROM panel"),
        "cell_state_year": cell_state_year,
        "cell_state_year_forward": _q(resident(YEARS3) + [year_panel("gy", span=SPAN_FORWARD)],
                                      cells("onet_code, state, year")),
        "cell_state_year_people": _q(resident(YEARS3) + [year_panel("gy")],
                                     cells("onet_code, state, year", people=True)),
        "cell_state_year_fractions": _q(
            resident(YEARS3) + [year_panel("gy")],
            "SELECT onet_code, state, year, AVG(FLOOR(salary) / 8) AS mean_salary, "
            "COUNT(salary) AS n_individuals FROM panel GROUP BY onet_code, state, year"),
        "sql_cell_means": cell_state_year,
        "sql_cell_origin_year": cell_origin_year,
        "cell_state_month": cell_state_month,
        "cell_state_year_end_order": _q(
            clean(f"SELECT * FROM positions WHERE country = '{ORIGIN}'", YEARS3, order="end")
            + [year_panel("gy")], cells("onet_code, state, year")),
        "cell_origin_year_spread": cell_origin_year,
        "cell_university_year_pre_spread": _q(university_rows(True),
                                              cells("onet_code, university_location, year")),
        **dict.fromkeys(("stream_cell_state_year", "stream_cell_state_year_changes"), _q(
            clean(f"SELECT * FROM positions WHERE country = '{ORIGIN}'", YEARS3, fill=False)
            + [year_panel("gy")], cells("onet_code, state, year"))),
        "cell_university_year": _q(university_rows(False),
                                   cells("onet_code, university_location, year")),
        "cell_university_year_pre": _q(university_rows(True),
                                       cells("onet_code, university_location, year")),
        "cell_origin_year": cell_origin_year,
        "cell_origin_year_pre": _q(origin_rows(True), cells("onet_code, last_origin_state, year")),
        "cell_origin_year_ordered": _q(origin_rows(False, ordered=True),
                                       cells("onet_code, last_origin_state, year")),
        "cell_state_month_people": _q(month_rows(),
                                      "SELECT split_part(onet_code, '-', 1) AS onet_code_f2, state, "
                                      "strftime(year_month, '%Y-%m') AS year_month, "
                                      + MEAN.replace("COUNT(salary) AS n_individuals",
                                                     "COUNT(DISTINCT CASE WHEN salary IS NOT NULL "
                                                     "THEN user_id END) AS n_individuals")
                                      + " FROM panel GROUP BY 1, 2, 3"),
        # cohorts
        "movers": _q([], MOVERS),
        "movers_ordered": _q([("p", "SELECT *, TRY_CAST(startdate AS DATE) AS sd FROM positions")],
                             "SELECT user_id FROM p WHERE user_id IS NOT NULL GROUP BY user_id "
                             f"HAVING bool_or(country = '{ORIGIN}') AND bool_or(country = '{DESTINATION}') "
                             f"AND MIN(CASE WHEN country = '{ORIGIN}' THEN sd END) < "
                             f"MAX(CASE WHEN country = '{DESTINATION}' THEN sd END)"),
        "movers_positions": _q([("mv", MOVERS)], MOVER_ROWS),
        "latest_education": _q([], latest_edu(False)),
        "education_before": _q([], latest_edu(True)),
        "positions_with_education": _q([("mv", MOVERS), ("mp", MOVER_ROWS), ("le", latest_edu(False))],
                                       WITH_EDU),
        "last_origin_state": _q(movers_clean(DAYS1095), LAST_ORIGIN),
        "last_origin_state_unfilled": _q(movers_clean(DAYS1095), LAST_ORIGIN),
        "positions_with_origin": _q(movers_clean(DAYS1095) + [("lo", LAST_ORIGIN)],
                                    f"SELECT {spells_cols('last_origin_state')} FROM "
                                    "(SELECT g.*, lo.last_origin_state FROM g "
                                    "LEFT JOIN lo ON g.user_id = lo.user_id "
                                    f"WHERE g.country = '{DESTINATION}') t"),
        "running_last_state": _q(movers_clean(DAYS1095),
                                 "SELECT position_id, user_id, e0 AS end_date_dt, state, "
                                 "LAST_VALUE(state ORDER BY e0 DESC, position_id) OVER ("
                                 "PARTITION BY user_id ORDER BY e0 DESC RANGE BETWEEN UNBOUNDED "
                                 "PRECEDING AND CURRENT ROW) AS running_last_state "
                                 f"FROM g WHERE country = '{ORIGIN}'"),
        # tables without row ids: ties in the order of the other columns
        "cell_state_year_no_ids": _q(
            [(n, s.replace("position_id ASC", NO_ID_TIE) if n == "l" else s) for n, s in resident(YEARS3)]
            + [year_panel("gy")], cells("onet_code, state, year")),
        "cell_origin_year_no_ids": _q(
            [(n, s.replace("position_id ASC", NO_ID_TIE)) for n, s in origin_rows(False)],
            cells("onet_code, last_origin_state, year")),
        # education
        "education_level": _q([], f"SELECT education_id, degree, {LEVEL_SQL} AS Educ_Level FROM education"),
        "education_marked": _q([], MARKED),
        "education_wide": wide(False),
        "education_wide_clean_first": wide(True),
        "distinct_degrees": _q([], "SELECT DISTINCT degree FROM education"),
        # places
        "city_mapper_union": _q([], UNION),
        "city_mapper_merged": _q([], MERGED),
        "mapper_conflicts": _q([("mg", MERGED)], "SELECT location, metro_area, COUNT(*) AS n_rows "
                                                 "FROM mg GROUP BY location, metro_area "
                                                 "HAVING COUNT(*) > 1"),
        "attach_city": _q(attach(), "SELECT * FROM att"),
        "located_rows": _q(attach(), f"SELECT * FROM att WHERE {LOCATED}"),
        "stream_located_rows": _q(attach(), f"SELECT * FROM att WHERE {LOCATED}"),
        "unlocated_users": _q(attach(), f"SELECT user_id FROM att WHERE NOT COALESCE({LOCATED}, FALSE)"),
        "attach_city_plain_eq_located": _q(attach(False), f"SELECT * FROM att WHERE {LOCATED}"),
    }
    return o


ORACLES = build()
