"""The registered queries as plain SQL, written apart from the Spark code.

Every statement reads the given tables through the common table expressions in
`BASE`: `deaths` (all causes), `ev` (homicides) and `xp` (survey persons).
"""

from __future__ import annotations

from ratecube.functions.codes import CAUSE_LABELS
from ratecube.sources.layouts import layout_for


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else repr(v) for v in values) + "]"


STATES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH "
    "NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()
STATE_SET = "(" + ", ".join(f"'{s}'" for s in STATES) + ")"
NATIVE_SET = "(" + ", ".join(f"'{s}'" for s in [*STATES, "PR", "VI", "GU", "AS", "MP"]) + ")"

BASE = f"""
people AS (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
raw_deaths AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, year(o_orderdate) + 23 AS data_year,
    {_list([*STATES[:24], "PR"])}[c_nationkey + 1] AS state,
    {_list([*STATES[:24], "PR"])}[l_suppkey % 25 + 1] AS state_occ,
    {_list("NY CA TX FL OH PA IL GA WA AL PR DC CC MX CU YY YY YY ZZ".split() + [None])}[o_custkey % 20 + 1] AS birth,
    CASE WHEN l_linenumber = 7 THEN '9' ELSE '1' END AS age_type,
    CASE WHEN l_linenumber = 7 THEN 999 ELSE CAST((l_quantity - 1) * 2 AS INTEGER) END AS age_years,
    CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS sex,
    {_list([None, *[f"{i:02d}" for i in range(1, 15)], "15", "21", "99"])}[o_custkey // 20 % 18 + 1] AS race_code,
    100 + o_orderkey % 300 AS origin,
    o_orderpriority[1:1] AS priority,
    {_list(["0", "1", None])}[o_orderkey % 3 + 1] AS education_flag,
    CASE WHEN l_returnflag = 'R' THEN CASE l_linestatus WHEN 'F' THEN '128' ELSE '129' END
         ELSE lpad(CAST(1 + l_partkey % 127 AS VARCHAR), 3, '0') END AS cause
  FROM lineitem JOIN people ON l_orderkey = o_orderkey
),
deaths AS (
  SELECT *,
    CASE WHEN birth IN {NATIVE_SET} THEN 'native' WHEN birth IN ('CC', 'MX', 'CU', 'YY') THEN 'foreign' END AS nativity,
    CASE WHEN birth IN {NATIVE_SET} THEN 'native' WHEN birth = 'CC' THEN 'Canada' WHEN birth = 'MX' THEN 'Mexico'
         WHEN birth = 'CU' THEN 'Cuba' WHEN birth = 'YY' THEN 'Rest of world' END AS birthplace,
    CASE WHEN age_type <> '1' THEN '12' WHEN age_years < 1 THEN '01' WHEN age_years < 5 THEN '02'
         WHEN age_years < 15 THEN '03' WHEN age_years < 25 THEN '04' WHEN age_years < 35 THEN '05'
         WHEN age_years < 45 THEN '06' WHEN age_years < 55 THEN '07' WHEN age_years < 65 THEN '08'
         WHEN age_years < 75 THEN '09' WHEN age_years < 85 THEN '10' ELSE '11' END AS age_group,
    CASE WHEN race_code = '01' THEN 'White' WHEN race_code = '02' THEN 'Black' WHEN race_code = '03' THEN 'AIAN'
         WHEN race_code IN ('04', '05', '06', '07', '08', '09', '10', '11', '12', '13', '14') THEN 'Asian or Pacific Islander'
         WHEN race_code >= '15' THEN 'More than one race' END AS race,
    CASE race_code WHEN '01' THEN 'White' WHEN '02' THEN 'Black' WHEN '03' THEN 'AIAN' WHEN '04' THEN 'Asian Indian'
         WHEN '05' THEN 'Chinese' WHEN '06' THEN 'Filipino' WHEN '07' THEN 'Japanese' WHEN '08' THEN 'Korean'
         WHEN '09' THEN 'Vietnamese' WHEN '10' THEN 'Other or Multiple Asian' WHEN '11' THEN 'Pacific Islander'
         WHEN '12' THEN 'Pacific Islander' WHEN '13' THEN 'Pacific Islander' WHEN '14' THEN 'Pacific Islander'
         ELSE CASE WHEN race_code >= '15' THEN 'More than one race' END END AS race_detail,
    CASE WHEN origin BETWEEN 100 AND 199 THEN 'Non-Hispanic' WHEN origin BETWEEN 200 AND 299 THEN 'Hispanic' END AS ethnicity,
    CASE WHEN origin <= 199 THEN 'Non-Hispanic' WHEN origin <= 209 THEN 'Spaniard' WHEN origin <= 219 THEN 'Mexican'
         WHEN origin <= 230 THEN 'Central American' WHEN origin <= 249 THEN 'South American'
         WHEN origin <= 259 THEN 'Latin American' WHEN origin <= 269 THEN 'Puerto Rican' WHEN origin <= 274 THEN 'Cuban'
         WHEN origin <= 279 THEN 'Dominican' WHEN origin <= 299 THEN 'Other Hispanic' END AS ethnicity_detail,
    CASE priority WHEN '1' THEN 'Never married, single' WHEN '2' THEN 'Married' WHEN '3' THEN 'Widowed'
         WHEN '4' THEN 'Divorced' WHEN '5' THEN 'Unknown' END AS marital,
    CASE cause WHEN '128' THEN 'Firearm' WHEN '129' THEN 'Other assault' END AS method
  FROM raw_deaths WHERE state IN {STATE_SET}
),
ev AS (SELECT * FROM deaths WHERE cause IN ('128', '129')),
raw_xp AS (
  SELECT year(o_orderdate) + 23 AS data_year, c_nationkey,
    CAST(1 + o_orderkey % 200 AS DOUBLE) AS perwt, o_orderstatus, o_orderkey, o_custkey, o_orderpriority[1:1] AS priority,
    CASE WHEN o_orderkey % 97 <> 0 THEN
      [0, 1, 5, 15, 25, 35, 45, 55, 65, 75, 85][(o_orderkey + o_custkey) % 11 + 1]
      + CASE WHEN (o_orderkey + o_custkey) % 11 = 0 THEN 0 ELSE o_orderkey % 4 END END AS age,
    {_list([36, 6, 48, 12, 39, 42, 17, 13, 53, 1, 110, 11, 150, 200, 250, 300, 500, 950, 960, 0])}[o_custkey % 20 + 1] AS bpl,
    {_list([7, 1, 2, 3, 4, 4, 5, 5, 6, 6, 4, 5, 6, 6, 4, 8, 9, 9])}[o_custkey // 20 % 18 + 1] AS race_number
  FROM people
),
xp AS (
  SELECT data_year, perwt,
    CASE WHEN c_nationkey < 24 THEN {_list(STATES[:24])}[c_nationkey + 1] END AS state,
    CASE WHEN bpl BETWEEN 1 AND 56 OR bpl IN (90, 99, 100, 105, 110, 115, 120) THEN 'native'
         WHEN bpl BETWEEN 150 AND 950 THEN 'foreign' END AS nativity,
    CASE WHEN bpl = 150 THEN 'Canada' WHEN bpl = 200 THEN 'Mexico' WHEN bpl = 250 THEN 'Cuba'
         WHEN bpl BETWEEN 150 AND 950 THEN 'Rest of world' END AS birthplace,
    CASE WHEN age < 1 THEN '01' WHEN age BETWEEN 1 AND 4 THEN '02' WHEN age BETWEEN 5 AND 14 THEN '03'
         WHEN age BETWEEN 15 AND 24 THEN '04' WHEN age BETWEEN 25 AND 34 THEN '05' WHEN age BETWEEN 35 AND 44 THEN '06'
         WHEN age BETWEEN 45 AND 54 THEN '07' WHEN age BETWEEN 55 AND 64 THEN '08' WHEN age BETWEEN 65 AND 74 THEN '09'
         WHEN age BETWEEN 75 AND 84 THEN '10' WHEN age >= 85 THEN '11' END AS age_group,
    CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS sex,
    CASE race_number WHEN 1 THEN 'White' WHEN 2 THEN 'Black' WHEN 3 THEN 'AIAN' WHEN 4 THEN 'Asian or Pacific Islander'
         WHEN 5 THEN 'Asian or Pacific Islander' WHEN 6 THEN 'Asian or Pacific Islander'
         WHEN 8 THEN 'More than one race' WHEN 9 THEN 'More than one race' END AS race,
    CASE WHEN o_orderkey % 300 < 100 THEN 'Non-Hispanic' WHEN o_orderkey % 300 < 200 THEN 'Hispanic' END AS ethnicity,
    CASE priority WHEN '1' THEN 'Never married, single' WHEN '2' THEN 'Married' WHEN '3' THEN 'Widowed'
         WHEN '4' THEN 'Divorced' END AS marital
  FROM raw_xp
),
standard(age_group, weight) AS (VALUES
  ('01', CAST(0.013818 AS DOUBLE)), ('02', 0.055317), ('03', 0.145565), ('04', 0.138646), ('05', 0.135573),
  ('06', 0.162613), ('07', 0.134834), ('08', 0.087247), ('09', 0.066037), ('10', 0.044842), ('11', 0.015508))
"""


def _with(body: str, *extra: str) -> str:
    return "WITH " + ",".join([BASE, *extra]) + "\n" + body


def _where(*conditions: str | None) -> str:
    kept = [c for c in conditions if c]
    return " WHERE " + " AND ".join(kept) if kept else ""


def _age_cells(keys: str, where: str | None = None, anchor: str = "events") -> tuple[str, str]:
    """CTE text for age cells joined events-to-population (or the other way round)."""
    names = [k.strip() for k in keys.split(",") if k.strip()]
    both = [*names, "age_group"]
    cols = ", ".join(both)
    on = " AND ".join(f"e.{k} = x.{k}" for k in both)
    e = f"SELECT {cols}, count(*) AS n FROM ev{_where(where, 'age_group <> ' + chr(39) + '12' + chr(39))} GROUP BY ALL"
    x = f"SELECT {cols}, sum(perwt) AS pop FROM xp{_where(where, 'age_group IS NOT NULL')} GROUP BY ALL"
    if anchor == "events":
        pick, frm = "e.", f"({e}) e LEFT JOIN ({x}) x ON {on}"
        n = "e.n"
    else:
        pick, frm = "x.", f"({x}) x LEFT JOIN ({e}) e ON {on}"
        n = "coalesce(e.n, 0)"
    sel = ", ".join(pick + k for k in both)
    return (
        f"age_cells AS (SELECT {sel}, {n} AS n, x.pop, {n} / nullif(x.pop, 0) * 100000 AS rate, weight "
        f"FROM {frm} LEFT JOIN standard s ON s.age_group = {pick}age_group)",
        ", ".join(names),
    )


STRICT_POP = "CASE WHEN count(pop) = count(*) THEN sum(pop) END"
STRICT_ADJ = "CASE WHEN count(rate) = count(*) THEN sum(rate * weight) END"


def _standardised(keys: str, where: str | None = None, anchor: str = "events") -> tuple[str, str]:
    cte, names = _age_cells(keys, where, anchor)
    lead = f"{names}, " if names else ""
    return (
        cte,
        f"std AS (SELECT {lead}CAST(sum(n) AS BIGINT) AS n, {STRICT_POP} AS pop, "
        f"sum(n) / {STRICT_POP} * 100000 AS crude_rate, {STRICT_ADJ} AS age_adjusted_rate "
        f"FROM age_cells GROUP BY ALL)",
    )


def _crude(keys: str, where: str | None = None, name: str = "crude") -> str:
    names = [k.strip() for k in keys.split(",")]
    cols = ", ".join(names)
    on = " AND ".join(f"e.{k} = x.{k}" for k in names)
    return (
        f"{name} AS (SELECT {', '.join('e.' + k for k in names)}, e.n, x.pop, e.n / nullif(x.pop, 0) * 100000 AS rate "
        f"FROM (SELECT {cols}, count(*) AS n FROM ev{_where(where)} GROUP BY ALL) e "
        f"LEFT JOIN (SELECT {cols}, sum(perwt) AS pop FROM xp{_where(where)} GROUP BY ALL) x ON {on})"
    )


RATES = "n, pop, round(crude_rate, 6) AS crude_rate, round(age_adjusted_rate, 6) AS age_adjusted_rate"
KNOWN = "nativity IS NOT NULL"
ABROAD = "birthplace IN ('Canada', 'Cuba', 'Mexico', 'Rest of world')"
TWO = "CASE nativity WHEN 'native' THEN 'Native-born' ELSE 'Foreign-born' END"


def _with_total_birthplace() -> str:
    """ev and xp restricted to foreign birthplaces, each row once more as the total."""
    return (
        f"ev2 AS (SELECT * FROM ev WHERE {ABROAD} UNION ALL SELECT * REPLACE ('Foreign total' AS birthplace) FROM ev WHERE {ABROAD}), "
        f"xp2 AS (SELECT * FROM xp WHERE {ABROAD} UNION ALL SELECT * REPLACE ('Foreign total' AS birthplace) FROM xp WHERE {ABROAD})"
    )


def _with_total_nativity() -> str:
    return (
        "ev2 AS (SELECT * FROM ev UNION ALL SELECT * REPLACE ('total' AS nativity) FROM ev), "
        "xp2 AS (SELECT * FROM xp UNION ALL SELECT * REPLACE ('total' AS nativity) FROM xp)"
    )


def _second(text: str) -> str:
    """The same CTE over the tables with subtotal rows."""
    return text.replace("FROM ev ", "FROM ev2 ").replace("FROM xp ", "FROM xp2 ")


def _slices(layout: list, line: str, names: list[str] | None = None) -> str:
    parts = []
    for f in layout:
        cut = f"substr({line}, {f.start}, {f.end - f.start + 1})"
        trimmed = f"rtrim({cut}, ' ')" if f.packed else f"trim({cut}, ' ' || chr(9))"
        if names is None or f.name in names:
            parts.append(f"CASE WHEN {trimmed} NOT IN ('', 'NA') THEN {trimmed} END AS {f.name}")
    return ", ".join(parts)


DOC_LINES = (
    "doc_lines AS (SELECT doc_id, CAST(unnest(range(len(parts))) AS BIGINT) AS line_no, unnest(parts) AS line "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"
)
SLOTS = (
    "pieces AS (SELECT doc_id, lang, unnest(range(1, len(p) + 1)) AS condition_slot, "
    "trim(unnest(p), ' ' || chr(9) || chr(10) || chr(13)) AS condition_code "
    "FROM (SELECT doc_id, lang, regexp_extract_all(text, '(?s).{1,5}') AS p FROM documents))"
)


def _latin_slices() -> str:
    """Three fields of a line in hexadecimal digits: each byte is the character of its number."""
    out = []
    for name, first, last in (("state_occ_fips", 21, 22), ("state_res_fips", 29, 30), ("detail_age", 71, 73)):
        chars = f"list_transform(range({first - 1}, least({last}, len(h) // 2)), lambda i: chr(CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)))"
        text = f"trim(coalesce(array_to_string({chars}, ''), ''), ' ' || chr(9))"
        out.append(f"CASE WHEN {text} NOT IN ('', 'NA') THEN {text} END AS {name}")
    return ", ".join(out)


def _method(group: str, where: str) -> str:
    return _with(
        f"SELECT *, round(n / sum(n) OVER (PARTITION BY {group}) * 100, 6) AS pct FROM "
        f"(SELECT {group}, method, count(*) AS n FROM ev WHERE {where} GROUP BY ALL)"
    )


def _union_layouts() -> str:
    old, new = layout_for(2014), layout_for(2024)
    names = [f.name for f in old] + [f.name for f in new if f.name not in {g.name for g in old}]

    def one(layout, parity):
        have = {f.name: f for f in layout}
        cols = ", ".join(
            _slices([have[n]], "line") if n in have else f"CAST(NULL AS VARCHAR) AS {n}" for n in names
        )
        return f"SELECT doc_id, line_no, {cols} FROM doc_lines WHERE doc_id % 2 = {parity}"

    return f"WITH {DOC_LINES} {one(old, 0)} UNION ALL {one(new, 1)}"


PANEL_CRUDE = (
    _crude("state, data_year", "nativity = 'native'"),
    "share AS (SELECT state, data_year, coalesce(sum(perwt) FILTER (nativity = 'foreign'), 0) / sum(perwt) * 100 AS foreign_share FROM xp GROUP BY ALL)",
    "panel AS (SELECT c.state, c.data_year, c.rate AS native_rate, foreign_share FROM crude c LEFT JOIN share s ON s.state = c.state AND s.data_year = c.data_year)",
)
PANEL_ADJUSTED = (
    PANEL_CRUDE[1],
    *_standardised("state, data_year", "nativity = 'native'"),
    "panel AS MATERIALIZED (SELECT s.state, s.data_year, age_adjusted_rate AS native_rate, foreign_share FROM std s LEFT JOIN share h ON s.state = h.state AND s.data_year = h.data_year)",
)
# Persons of unknown age have no weight: sums over them are unknown.
UNKNOWN_SHARE = (
    "share AS (SELECT state, data_year, CASE WHEN count(age_group) = count(*) THEN coalesce(sum(perwt) FILTER (nativity = 'foreign'), 0) / sum(perwt) * 100 END AS foreign_share "
    "FROM xp GROUP BY ALL)"
)
PANEL_UNKNOWN = (UNKNOWN_SHARE, *PANEL_ADJUSTED[1:])
PANEL_CRUDE_UNKNOWN = (
    UNKNOWN_SHARE,
    "pops AS (SELECT state, data_year, CASE WHEN count(age_group) = count(*) THEN sum(perwt) END AS pop FROM xp WHERE nativity = 'native' GROUP BY ALL)",
    "counts AS (SELECT state, data_year, count(*) AS n FROM ev WHERE nativity = 'native' GROUP BY ALL)",
    "panel AS (SELECT c.state, c.data_year, n / pop * 100000 AS native_rate, foreign_share FROM counts c "
    "LEFT JOIN pops p ON p.state = c.state AND p.data_year = c.data_year LEFT JOIN share s ON s.state = c.state AND s.data_year = c.data_year)",
)
# Unit and time effects removed by alternating projections, for any panel.
RESIDUALS = (
    "rounds AS (SELECT 0 AS i, *, native_rate AS ry, foreign_share AS rx FROM panel WHERE native_rate IS NOT NULL AND foreign_share IS NOT NULL UNION ALL "
    "SELECT i + 1, state, data_year, native_rate, foreign_share, ry - avg(ry) OVER (PARTITION BY data_year), rx - avg(rx) OVER (PARTITION BY data_year) FROM "
    "(SELECT * REPLACE (ry - avg(ry) OVER (PARTITION BY state) AS ry, rx - avg(rx) OVER (PARTITION BY state) AS rx) FROM rounds WHERE i < 300))",
    "clean AS MATERIALIZED (SELECT * FROM rounds WHERE i = 300)",
)
FIT = (
    "slope AS (SELECT sum(rx * ry) / nullif(sum(rx * rx), 0) AS b, nullif(sum(rx * rx), 0) AS sxx, count(*) AS n, count(DISTINCT state) AS g, count(DISTINCT data_year) AS t FROM clean)",
    "scores AS (SELECT state, sum(rx * (ry - b * rx)) AS u FROM clean, slope GROUP BY state)",
)


def _t_tail(t: str, df: str) -> str:
    """Two-sided tail of Student's t for whole df, by its finite series."""
    c = f"({df} / ({df} + {t} * {t}))"
    theta = f"atan(abs({t}) / sqrt({df}))"
    even = (
        f"sin({theta}) * list_sum([exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * pow({c}, j) "
        f"for j in range(CAST(({df} - 2) // 2 + 1 AS BIGINT))])"
    )
    odd = (
        f"2 / pi() * ({theta} + sin({theta}) * cos({theta}) * list_sum([sqrt(pi()) / 2 * exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * pow({c}, j) "
        f"for j in range(CAST(({df} - 3) // 2 + 1 AS BIGINT))]))"
    )
    return f"1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


IID = ("(SELECT sum(pow(ry - b * rx, 2)) FROM clean) / (n - g - t) / sxx", "n - g - t")
CLUSTERED = (
    "g / (g - 1.0) * (n - 1.0) / (n - 1 - t) * (SELECT sum(u * u) FROM scores) / (sxx * sxx)",
    "g - 1",
)


def _recursive(statement: str) -> str:
    return statement.replace("WITH ", "WITH RECURSIVE ", 1)


def _fit(panel: tuple[str, ...], variance: str, df: str) -> str:
    return _recursive(
        _with(
            "SELECT round(b, 6) AS estimate, round(se, 6) AS std_error, round(b / se, 6) AS t_value, "
            f"round({_t_tail('(b / se)', 'df')}, 6) AS p_value, n AS n_obs, g AS n_units, df FROM fit",
            *panel,
            *RESIDUALS,
            *FIT,
            f"fit AS (SELECT b, n, g, sqrt({variance}) AS se, CAST({df} AS BIGINT) AS df FROM slope)",
        )
    )


def _linear_band(pair: tuple[str, ...]) -> str:
    """Line and 95 % band; the t quantile by bisection of its tail."""
    half = "t * sd * sqrt(1.0 / n + pow(gx - xm, 2) / sxx)"
    statement = _with(
        f"SELECT round(gx, 6) AS x, round(a + b * gx, 6) AS fit, round(a + b * gx - {half}, 6) AS low, round(a + b * gx + {half}, 6) AS high FROM grid",
        *pair,
        "line AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS xm, regr_sxx(y, x) AS sxx, min(x) AS x0, max(x) AS x1, "
        "sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) AS sd FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL)",
        "halving AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(100 AS DOUBLE) AS hi, n - 2 AS df FROM line UNION ALL "
        f"SELECT i + 1, CASE WHEN p > 0.05 THEN m ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE m END, df FROM (SELECT *, {_t_tail('m', 'df')} AS p FROM "
        "(SELECT *, (lo + hi) / 2 AS m FROM halving WHERE i < 60)))",
        "grid AS (SELECT line.*, (SELECT lo FROM halving WHERE i = 60) AS t, x0 + (x1 - x0) / 79.0 * k AS gx FROM line, range(80) r(k))",
    )
    return _recursive(statement)


ADJ_STATE = "n, pop, round(CASE WHEN n >= 10 THEN crude_rate END, 6) AS crude_rate, round(CASE WHEN n >= 10 THEN age_adjusted_rate END, 6) AS age_adjusted_rate"


def _state_year_wide() -> str:
    keys = "state, data_year, nativity"
    where = "data_year IN (2018, 2024)"
    std = [_second(t) for t in _standardised(keys, where)]
    crude = _second(_crude(keys, where))
    pick = ", ".join(
        f"round(max(c.rate) FILTER (c.nativity = '{s}'), 6) AS crude_rate_{s}, "
        f"round(max(s.age_adjusted_rate) FILTER (c.nativity = '{s}'), 6) AS adjusted_rate_{s}"
        for s in ("total", "native", "foreign")
    )
    return _with(
        f"SELECT c.state, c.data_year, {pick} FROM crude c LEFT JOIN std s "
        "ON s.state = c.state AND s.data_year = c.data_year AND s.nativity = c.nativity GROUP BY ALL",
        _with_total_nativity(),
        *std,
        crude,
    )


def _change_summary() -> str:
    std = [_second(t) for t in _standardised("data_year, nativity")]
    metric = lambda name, sql: f"SELECT data_year, '{name}' AS metric, CAST({sql} AS DOUBLE) AS v FROM "
    pop = "(SELECT data_year, sum(perwt) AS tot, sum(perwt) FILTER (nativity = 'foreign') AS f FROM xp GROUP BY ALL)"
    cnt = "(SELECT data_year, count(*) AS tot, count(*) FILTER (nativity = 'native') AS nat, count(*) FILTER (nativity = 'foreign') AS f FROM ev GROUP BY ALL)"
    rows = [
        metric("Foreign-born population share (%)", "f / tot * 100") + pop,
        metric("Foreign-born population (count)", "f") + pop,
        metric("Native-born age-adjusted rate", "age_adjusted_rate") + "std WHERE nativity = 'native'",
        metric("Foreign-born age-adjusted rate", "age_adjusted_rate") + "std WHERE nativity = 'foreign'",
        metric("Total age-adjusted rate", "age_adjusted_rate") + "std WHERE nativity = 'total'",
        metric("Native-born homicide count", "nat") + cnt,
        metric("Foreign-born homicide count", "f") + cnt,
        metric("Total homicide count", "tot") + cnt,
    ]
    return _with(
        "SELECT a.metric, round(a.v, 6) AS value_first, round(b.v, 6) AS value_last, round((b.v - a.v) / a.v * 100, 6) AS pct_change "
        "FROM metrics a JOIN metrics b ON a.metric = b.metric WHERE a.data_year = 2018 AND b.data_year = 2024",
        _with_total_nativity(),
        *std,
        "metrics AS (" + " UNION ALL ".join(rows) + ")",
    )


def _demographic() -> str:
    ctes, parts = [], []
    labels = {
        "sex": "CASE sex WHEN 'M' THEN 'Male' ELSE 'Female' END",
        "race": "race",
        "ethnicity": "ethnicity",
    }
    for d, label in labels.items():
        cells, std = _standardised(f"{d}, nativity", f"{KNOWN} AND data_year = 2024 AND {d} IS NOT NULL")
        ctes += [cells.replace("age_cells", f"cells_{d}"), std.replace("age_cells", f"cells_{d}").replace("std AS", f"std_{d} AS")]
        parts.append(
            f"SELECT {label} || ', ' || {TWO} AS category, n AS homicides, pop AS acs_population, "
            f"round(crude_rate, 6) AS crude_rate, round(age_adjusted_rate, 6) AS age_adjusted_rate FROM std_{d}"
        )
    return _with(" UNION ALL ".join(parts), *ctes)


def _density(where: str = "TRUE") -> str:
    return _with(
        "SELECT nativity, round(x, 6) AS x, round(sum(k.n * exp(-0.5 * pow((x - k.age_years) / bw, 2))) / (any_value(total) * any_value(bw) * sqrt(2 * pi())), 6) AS density "
        "FROM grid JOIN ages k USING (nativity) GROUP BY nativity, x",
        f"rows_ AS (SELECT nativity, age_years FROM ev WHERE {KNOWN} AND age_type = '1' AND {where})",
        "ages AS (SELECT nativity, age_years, count(*) AS n FROM rows_ GROUP BY ALL)",
        "widths AS (SELECT nativity, count(*) AS total, 0.9 * least(stddev_samp(age_years), (quantile_cont(CAST(age_years AS DOUBLE), 0.75) - quantile_cont(CAST(age_years AS DOUBLE), 0.25)) / 1.34) * pow(count(*), -0.2) AS bw FROM rows_ GROUP BY ALL)",
        "limits AS (SELECT min(age_years) AS lo, max(age_years) AS hi FROM rows_)",
        "grid AS (SELECT nativity, total, bw, lo + (hi - lo) / 511.0 * i AS x FROM widths, limits, range(512) r(i))",
    )


def _binned_density() -> str:
    """Each bar shared out between the two grid points around it; then all pairs of grid points."""
    return _with(
        "SELECT nativity, round(lo + step * g.i, 6) AS x, round(sum(share * exp(-0.5 * pow((g.i - point) * step / bw, 2))) / (any_value(total) * any_value(bw) * sqrt(2 * pi())), 6) AS density "
        "FROM cells, limits, range(512) g(i) GROUP BY nativity, g.i, lo, step",
        f"rows_ AS (SELECT nativity, age_years FROM ev WHERE {KNOWN} AND age_type = '1')",
        "widths AS (SELECT nativity, count(*) AS total, 0.9 * least(stddev_samp(age_years), (quantile_cont(CAST(age_years AS DOUBLE), 0.75) - quantile_cont(CAST(age_years AS DOUBLE), 0.25)) / 1.34) * pow(count(*), -0.2) AS bw FROM rows_ GROUP BY ALL)",
        "limits AS (SELECT min(age_years) AS lo, (max(age_years) - min(age_years)) / 511.0 AS step FROM rows_)",
        "places AS (SELECT nativity, (age_years - lo) / step AS place FROM rows_, limits)",
        "halves AS (SELECT nativity, least(floor(place), 510) AS point, 1 - (place - least(floor(place), 510)) AS share FROM places UNION ALL SELECT nativity, least(floor(place), 510) + 1, place - least(floor(place), 510) FROM places)",
        "cells AS (SELECT nativity, total, bw, point, sum(share) AS share FROM halves JOIN widths USING (nativity) GROUP BY ALL)",
    )


def _record_fields(table: str) -> str:
    """All fields of both layouts; those that stand for nothing are digits of the line's keys."""
    known = {
        "data_year": "CAST(data_year AS VARCHAR)", "state_res_fips": "state", "state_occ_fips": "state_occ",
        "state_country_birth_recode": "birth", "sex": "sex", "detail_age_type": "age_type",
        "detail_age": "lpad(CAST(age_years AS VARCHAR), 3, '0')", "age_recode12": "age_group", "race_recode40": "race_code",
        "hispanic_origin": "CAST(origin AS VARCHAR)", "cause_recode113": "cause", "education_flag": "education_flag",
        "marital_status": "CASE priority WHEN '1' THEN 'S' WHEN '2' THEN 'M' WHEN '3' THEN 'W' WHEN '4' THEN 'D' WHEN '5' THEN 'U' END",
    }
    old, new = ({f.name: f for f in layout_for(year)} for year in (2014, 2024))
    columns = []
    for name, f in (old | new).items():
        digits = min(9, f.end - f.start + 1)
        value = known.get(name, f"lpad(CAST((l_orderkey * {f.start} + l_linenumber) % {10**digits} AS VARCHAR), {digits}, '0')")
        if name not in new:
            value = f"CASE WHEN data_year <= 2020 THEN {value} END"
        if name not in old:
            value = f"CASE WHEN data_year > 2020 THEN {value} END"
        columns.append(f"{value} AS {name}")
    return f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {', '.join(columns)} FROM {table}"


CAUSES = "labels_ AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{code}', '{label}')" for code, label in CAUSE_LABELS
) + ") v(cause, label))"
CAUSE_TEXT = "coalesce(label, 'Code ' || c.cause || ' (not in lookup - check codebook)') AS cause_label"
EXT = (
    "status AS (SELECT "
    f"{_list([*STATES[:24], 'PR'])}[s_nationkey + 1] AS state, CASE WHEN s_acctbal < 2500 THEN 'low' ELSE 'other' END AS st, "
    "sum(abs(s_acctbal)) AS population, count(*) AS n FROM supplier GROUP BY ALL)",
    "ext AS (SELECT state, sum(population) FILTER (st = 'low') AS status_pop, CAST(sum(n) FILTER (st = 'low') AS BIGINT) AS status_n, sum(population) AS total_pop FROM status GROUP BY ALL)",
)


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # counts
    sql["events_by_year"] = _with("SELECT data_year, count(*) AS n FROM ev GROUP BY ALL")
    sql["events_by_year_nativity"] = _with("SELECT data_year, nativity, count(*) AS n FROM ev GROUP BY ALL")
    sql["events_by_birthplace"] = _with("SELECT data_year, birthplace, count(*) AS n FROM ev WHERE birthplace IS NOT NULL GROUP BY ALL")
    sql["events_by_birthplace_rollup"] = _with(
        "SELECT data_year, birthplace, count(*) AS n FROM ev2 GROUP BY ALL", _with_total_birthplace()
    )
    sql["events_by_state_of_occurrence"] = _with("SELECT state_occ, count(*) AS n FROM ev WHERE data_year = 2024 GROUP BY ALL")
    sql["events_by_state_of_residence"] = _with("SELECT state, count(*) AS n FROM ev WHERE data_year = 2024 GROUP BY ALL")
    sql["events_by_nativity_one_year"] = _with("SELECT nativity, count(*) AS n FROM ev WHERE data_year = 2024 GROUP BY ALL")
    sql["events_by_birthplace_one_year"] = _with("SELECT birthplace, count(*) AS n FROM ev WHERE data_year = 2024 GROUP BY ALL")
    sql["events_by_sex_nativity"] = _with(f"SELECT data_year, sex, nativity, count(*) AS n FROM ev WHERE {KNOWN} GROUP BY ALL")
    sql["events_by_race_nativity"] = _with(f"SELECT data_year, race, nativity, count(*) AS n FROM ev WHERE {KNOWN} AND race IS NOT NULL GROUP BY ALL")
    sql["events_by_ethnicity_nativity"] = _with(f"SELECT data_year, ethnicity, nativity, count(*) AS n FROM ev WHERE {KNOWN} AND ethnicity IS NOT NULL GROUP BY ALL")
    sql["null_code_audit"] = _with("SELECT data_year, count(*) AS n FROM ev WHERE race_code IS NULL GROUP BY ALL")
    sql["flag_audit"] = _with("SELECT data_year, education_flag, count(*) AS n FROM ev WHERE data_year < 2021 GROUP BY ALL")
    sql["subgroup_composition"] = _with(f"SELECT birthplace, race_detail, count(*) AS n FROM ev WHERE {ABROAD} GROUP BY ALL")
    sql["subgroup_ethnicity_composition"] = _with(f"SELECT birthplace, ethnicity_detail, count(*) AS n FROM ev WHERE {ABROAD} GROUP BY ALL")
    sql["rest_of_world_ethnicity"] = _with("SELECT ethnicity_detail, count(*) AS n FROM ev WHERE birthplace = 'Rest of world' GROUP BY ALL")
    sql["rest_of_world_composition"] = _with("SELECT race_detail, count(*) AS n FROM ev WHERE birthplace = 'Rest of world' GROUP BY ALL")

    # rates by year
    sql["crude_rate"] = _with("SELECT data_year, nativity, n, pop, round(rate, 6) AS rate FROM crude", _crude("data_year, nativity", KNOWN))
    sql["age_specific_rate"] = _with(
        "SELECT data_year, nativity, age_group, n, pop, round(rate, 6) AS rate, weight, round(rate * weight, 6) AS weighted_rate FROM age_cells",
        _age_cells("data_year, nativity", KNOWN)[0],
    )
    sql["age_adjusted_rate"] = _with(f"SELECT data_year, nativity, {RATES} FROM std", *_standardised("data_year, nativity", KNOWN))
    sql["age_adjusted_exposure_anchor"] = _with(f"SELECT data_year, nativity, {RATES} FROM std", *_standardised("data_year, nativity", KNOWN, "exposure"))
    sql["age_adjusted_total"] = _with(f"SELECT data_year, {RATES} FROM std", *_standardised("data_year"))
    sql["crude_vs_adjusted"] = _with(
        "SELECT data_year, nativity, 'Crude' AS rate_type, round(rate, 6) AS rate, CAST(1 AS BIGINT) AS sort_order FROM crude UNION ALL "
        "SELECT data_year, nativity, 'Age-adjusted', round(age_adjusted_rate, 6), 2 FROM std",
        _crude("data_year, nativity", KNOWN),
        *_standardised("data_year, nativity", KNOWN),
    )
    sql["crude_vs_adjusted_from_cubes"] = sql["crude_vs_adjusted"]
    sql["subtotal_rates"] = _with(
        "SELECT data_year, birthplace, n, pop, round(rate, 6) AS rate, CAST(list_position(['Foreign total', 'Canada', 'Cuba', 'Mexico', 'Rest of world'], birthplace) AS BIGINT) AS sort_order FROM crude",
        _with_total_birthplace(),
        _second(_crude("data_year, birthplace", "TRUE")),
    )
    sql["subtotal_adjusted"] = _with(
        f"SELECT data_year, birthplace, {RATES} FROM std",
        _with_total_birthplace(),
        *[_second(t) for t in _standardised("data_year, birthplace", "TRUE")],
    )
    sql["age_specific_birthplace"] = _with(
        "SELECT data_year, birthplace, age_group, n, pop, round(rate, 6) AS rate, weight, round(rate * weight, 6) AS weighted_rate FROM age_cells",
        _age_cells("data_year, birthplace", ABROAD)[0],
    )
    label = "['Under 1 year', '1-4 years', '5-14 years', '15-24 years', '25-34 years', '35-44 years', '45-54 years', '55-64 years', '65-74 years', '75-84 years', '85 years and over'][CAST(age_group AS INTEGER)] AS age_group_label"
    wide = "SELECT age_group, {}, round(max(rate) FILTER (nativity = 'native'), 6) AS native, round(max(rate) FILTER (nativity = 'foreign'), 6) AS \"foreign\" FROM age_cells GROUP BY ALL".format(label)
    sql["pooled_rate"] = _with(f"SELECT nativity, age_group, {label}, n, pop, round(rate, 6) AS rate FROM age_cells", _age_cells("nativity", KNOWN)[0])
    sql["age_specific_rate_wide"] = _with(wide, _age_cells("nativity", KNOWN)[0])
    sql["age_specific_rate_wide_one_year"] = _with(wide, _age_cells("nativity", KNOWN + " AND data_year = 2024")[0])

    # states
    sql["population_by_state"] = _with(f"SELECT state, nativity, sum(perwt) AS pop FROM xp WHERE {KNOWN} GROUP BY ALL")
    sql["state_pooled_suppressed"] = _with(
        "SELECT state, nativity, n, pop, round(CASE WHEN n >= 10 THEN rate END, 6) AS rate FROM crude", _crude("state, nativity", KNOWN)
    )
    sql["state_rate_suppressed"] = _with(
        "SELECT state, age_group, data_year, n, pop, round(CASE WHEN n >= 10 THEN rate END, 6) AS rate, n < 10 AS suppressed FROM age_cells",
        _age_cells("state, data_year")[0],
    )
    sql["state_rates_one_year"] = _with(
        "SELECT c.state, c.n, c.pop, round(CASE WHEN c.n >= 10 THEN c.rate END, 6) AS crude_rate, round(CASE WHEN c.n >= 10 THEN s.age_adjusted_rate END, 6) AS age_adjusted_rate "
        "FROM crude c LEFT JOIN std s ON s.state = c.state",
        _crude("state", "data_year = 2024"),
        *_standardised("state", "data_year = 2024"),
    )
    sql["state_nativity_rates"] = _with(f"SELECT state, nativity, {RATES} FROM std", *_standardised("state, nativity", KNOWN + " AND data_year = 2024"))
    sql["state_nativity_age_specific"] = _with(
        "SELECT state, nativity, age_group, n, pop, round(rate, 6) AS rate, weight, round(rate * weight, 6) AS weighted_rate FROM age_cells",
        _age_cells("state, nativity", KNOWN + " AND data_year = 2024")[0],
    )
    sql["state_map_foreign"] = _with(
        "SELECT state, round(CASE WHEN n >= 10 THEN age_adjusted_rate END, 6) AS age_adjusted_rate FROM std",
        *_standardised("state", "nativity = 'foreign' AND data_year = 2024"),
    )
    sql["state_map_native"] = sql["state_map_foreign"].replace("nativity = 'foreign'", "nativity = 'native'")
    sql["state_adjusted_exposure"] = _with(
        f"SELECT state, {ADJ_STATE}, n < 10 AS suppressed FROM std",
        *_standardised("state", "nativity = 'native' AND data_year = 2024", "exposure"),
    )
    sql["state_adjusted_exposure_foreign"] = sql["state_adjusted_exposure"].replace("nativity = 'native'", "nativity = 'foreign'")
    sql["state_year_nativity"] = _with(
        "SELECT c.state, c.data_year, c.nativity, c.n, c.pop, round(c.rate, 6) AS crude_rate, round(s.age_adjusted_rate, 6) AS age_adjusted_rate "
        "FROM crude c LEFT JOIN std s ON s.state = c.state AND s.data_year = c.data_year AND s.nativity = c.nativity",
        _crude("state, data_year, nativity", KNOWN),
        *_standardised("state, data_year, nativity", KNOWN),
    )
    sql["state_year_wide"] = _state_year_wide()

    # population
    sql["population_series"] = _with(
        "SELECT data_year, 'Total U.S.' AS series, sum(perwt) AS pop, CAST(1 AS BIGINT) AS sort_order FROM xp GROUP BY ALL UNION ALL "
        f"SELECT data_year, {TWO}, sum(perwt), CASE nativity WHEN 'native' THEN 2 ELSE 3 END FROM xp WHERE {KNOWN} GROUP BY ALL"
    )
    share = "coalesce(sum(perwt) FILTER (nativity = 'foreign'), 0) AS foreign_pop, sum(perwt) AS total_pop, round(coalesce(sum(perwt) FILTER (nativity = 'foreign'), 0) / sum(perwt) * 100, 6) AS foreign_share"
    sql["population_share"] = _with(f"SELECT data_year, {share} FROM xp GROUP BY ALL")
    sql["pct_change_summary"] = _change_summary()

    # demographic groups
    sql["race_ethnicity_rates"] = _with(
        f"SELECT race, ethnicity, nativity, {RATES}, race || ', ' || ethnicity || ', ' || {TWO} AS category FROM std",
        *_standardised("race, ethnicity, nativity", f"{KNOWN} AND race IS NOT NULL AND ethnicity IS NOT NULL"),
    )
    sql["white_ethnicity_rates"] = _with(
        f"SELECT 'White, ' || ethnicity || ', ' || {TWO} AS category, {RATES} FROM std",
        *_standardised("ethnicity, nativity", f"{KNOWN} AND race = 'White' AND ethnicity IS NOT NULL AND data_year = 2024"),
    )
    sql["group_gap"] = _with(
        "SELECT race || ', ' || ethnicity AS group_label, round(max(age_adjusted_rate) FILTER (nativity = 'native'), 6) AS native, "
        "round(max(age_adjusted_rate) FILTER (nativity = 'foreign'), 6) AS \"foreign\", "
        "round(max(age_adjusted_rate) FILTER (nativity = 'native') - max(age_adjusted_rate) FILTER (nativity = 'foreign'), 6) AS gap "
        "FROM std GROUP BY race, ethnicity HAVING native IS NOT NULL AND \"foreign\" IS NOT NULL",
        *_standardised("race, ethnicity, nativity", f"{KNOWN} AND race IS NOT NULL AND ethnicity IS NOT NULL"),
    )
    sql["demographic_rates_stacked"] = _demographic()
    married = f"{KNOWN} AND marital IS NOT NULL AND data_year = 2024"
    sql["marital_sex_rates"] = _with(f"SELECT marital, sex, nativity, {RATES} FROM std", *_standardised("marital, sex, nativity", married))
    sql["marital_age_cells"] = _with(
        "SELECT marital, sex, nativity, age_group, n, pop, round(rate, 6) AS rate FROM age_cells",
        _age_cells("marital, sex, nativity", married + " AND marital = 'Widowed'")[0],
    )

    # distributions
    sql["method_pct_by_group"] = _method("nativity", KNOWN)
    sql["method_pct_by_race"] = _method("race, nativity", KNOWN + " AND race IS NOT NULL")
    sql["method_pct_white_ethnicity"] = _method("ethnicity, nativity", KNOWN + " AND race = 'White' AND ethnicity IS NOT NULL")
    sql["marital_pct"] = _with(
        "SELECT *, round(n / sum(n) OVER (PARTITION BY nativity) * 100, 6) AS pct FROM "
        f"(SELECT nativity, marital, count(*) AS n FROM ev WHERE {KNOWN} AND marital IS NOT NULL GROUP BY ALL)"
    )
    ages = f"round(avg(age_years), 6) AS mean_age, median(CAST(age_years AS DOUBLE)) AS median_age, count(*) AS n FROM ev WHERE {KNOWN} AND age_type = '1'"
    sql["age_mean_median"] = _with(f"SELECT nativity, {ages} AND data_year = 2024 GROUP BY ALL")
    sql["age_median_by_sex"] = _with(f"SELECT sex, nativity, {ages} AND data_year = 2024 GROUP BY ALL")
    sql["grouped_density"] = _density()
    sql["grouped_density_one_year"] = _density("data_year = 2024")

    # all causes
    sql["event_share_of_all"] = _with(
        "SELECT data_year, nativity, count(*) AS total_deaths, count(*) FILTER (cause IN ('128', '129')) AS homicide_deaths, "
        f"round(count(*) FILTER (cause IN ('128', '129')) / count(*) * 100, 6) AS pct_homicide FROM deaths WHERE {KNOWN} GROUP BY ALL"
    )
    cells = f"c AS (SELECT nativity, cause, count(*) AS n FROM deaths WHERE {KNOWN} GROUP BY ALL)"
    sql["top_causes_ties"] = _with(
        f"SELECT nativity, c.cause, {CAUSE_TEXT}, n, round(n / total * 100, 6) AS pct FROM "
        "(SELECT *, sum(n) OVER (PARTITION BY nativity) AS total, rank() OVER (PARTITION BY nativity ORDER BY n DESC) AS rk FROM c) c "
        "LEFT JOIN labels_ USING (cause) WHERE rk <= 10",
        cells,
        CAUSES,
    )
    sql["cause_label_fallback"] = _with(
        f"SELECT c.cause, {CAUSE_TEXT}, n FROM (SELECT cause, count(*) AS n FROM deaths GROUP BY ALL) c LEFT JOIN labels_ USING (cause)", CAUSES
    )

    # packed codes
    sql["unpack_codes"] = f"WITH {SLOTS} SELECT doc_id, condition_slot, condition_code FROM pieces WHERE condition_code <> ''"
    sql["code_frequency"] = (
        f"WITH {SLOTS} SELECT condition_code, count(*) AS n, (SELECT count(*) FROM documents) AS total_records, "
        "round(count(*) / (SELECT count(*) FROM documents) * 100, 6) AS pct_of_records FROM pieces WHERE condition_code <> '' GROUP BY ALL"
    )
    sql["code_frequency_head"] = sql["code_frequency"] + " ORDER BY n DESC, condition_code LIMIT 30"
    sql["code_prevalence_by_group"] = (
        f"WITH {SLOTS} SELECT lang, condition_code, count(DISTINCT doc_id) AS n, total AS total_records, round(count(DISTINCT doc_id) / total * 100, 6) AS pct_of_group "
        "FROM pieces JOIN (SELECT lang, count(*) AS total FROM documents GROUP BY ALL) USING (lang) WHERE condition_code <> '' GROUP BY lang, condition_code, total"
    )

    # scans
    sql["fixed_width_scan"] = f"WITH {DOC_LINES} SELECT doc_id, line_no, {_slices(layout_for(2014), 'line', ['state_res_fips', 'state_country_birth_recode', 'data_year', 'cause_recode113'])} FROM doc_lines"
    sql["layout_union"] = _union_layouts()
    sql["record_length_profile"] = f"WITH {DOC_LINES} SELECT doc_id % 2 = 0 AS old_layout, CAST(length(line) AS BIGINT) AS record_length, count(*) AS n FROM doc_lines GROUP BY ALL"
    sql["event_extract"] = _with(_record_fields("ev"))
    all_cause = "data_year AS data_year, state AS state_res_fips, birth AS state_country_birth_recode, cause AS cause_recode113"
    sql["all_cause_extract"] = _with(
        f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {all_cause.replace('data_year AS', 'CAST(data_year AS VARCHAR) AS', 1)} FROM deaths"
    )
    sql["all_cause_rows_by_year"] = _with("SELECT CAST(data_year AS VARCHAR) AS data_year, count(*) AS n FROM deaths GROUP BY ALL")

    sql["binned_density"] = _binned_density()

    # sources and sinks
    sql["codebook_persons"] = _with(
        "SELECT data_year AS year, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 9 END AS sex, "
        "CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' ELSE 'Missing' END AS sex_label, "
        "CASE priority WHEN '2' THEN 1 + o_orderkey % 3 WHEN '1' THEN 6 WHEN '3' THEN 5 WHEN '4' THEN 4 WHEN '5' THEN 7 END AS marst, "
        "CASE WHEN priority = '1' THEN 'Never <married>' WHEN priority = '2' AND o_orderkey % 3 = 0 THEN 'Married & present' END AS marst_label, "
        "race_number AS race, count(*) AS n, round(sum(perwt + 0.25), 6) AS pop, CAST(sum(age) AS BIGINT) AS years, count(age) AS n_age FROM raw_xp GROUP BY ALL"
    )
    sql["byte_scan"] = f"WITH {DOC_LINES}, bytes AS (SELECT doc_id, line_no, hex(encode(line)) AS h FROM doc_lines) SELECT doc_id, line_no, {_latin_slices()} FROM bytes"
    sql["audited_extract"] = _with(
        "SELECT CASE WHEN data_year <= 2020 THEN 2018 ELSE 2021 END AS first_year, count(*) AS n_lines, count(*) FILTER (cause NOT IN ('128', '129')) AS n_other_cause, "
        f"count(*) FILTER (cause IN ('128', '129') AND state NOT IN {STATE_SET}) AS n_other_residence, count(*) FILTER (cause IN ('128', '129')) AS n_kept FROM deaths GROUP BY ALL"
    )
    sql["added_year_rates"] = sql["age_adjusted_rate"]
    sql["rates_off_buckets"] = sql["age_adjusted_rate"]
    sql["checked_csv"] = _with("SELECT data_year, state, count(*) AS n, CAST(3 AS BIGINT) AS n_bad FROM ev GROUP BY ALL")
    sql["weight_coverage"] = _with(
        "SELECT data_year, nativity, count(*) AS n_ages, round(sum(weight), 6) AS weight, abs(sum(weight) - 1) < 1e-6 AS whole "
        "FROM (SELECT DISTINCT data_year, nativity, age_group FROM ev) JOIN standard USING (age_group) GROUP BY ALL"
    )
    sql["ranges_by_table"] = (
        "SELECT c.c_custkey AS centre, CAST(c.c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n "
        "FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 = 0) c ON o_custkey BETWEEN c.c_custkey - 4 AND c.c_custkey + 3 GROUP BY ALL"
    )
    medians = "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, round(quantile_cont(l_orderkey * 1.25::DOUBLE - l_quantity, {0}), 6) AS quantile, count(*) AS n, {0}::DOUBLE AS share FROM lineitem GROUP BY ALL"
    sql["wide_medians"] = f"{medians.format(0.5)} UNION ALL {medians.format(0.9)}"

    # panels
    panel = "SELECT state, data_year, round(native_rate, 6) AS native_rate, round(foreign_share, 6) AS foreign_share FROM panel"
    sql["panel"] = _with(panel, *PANEL_ADJUSTED)
    sql["panel_crude"] = _with(panel, *PANEL_CRUDE)
    for suffix, rows in (("", PANEL_ADJUSTED), ("_crude", PANEL_CRUDE)):
        sql[f"twfe_slope{suffix}"] = _fit(rows, *IID)
        sql[f"twfe_cluster_se{suffix}"] = _fit(rows, *CLUSTERED)
        sql[f"twfe_residuals{suffix}"] = _recursive(
            _with(
                "SELECT state, data_year, round(native_rate, 6) AS native_rate, round(foreign_share, 6) AS foreign_share, round(ry, 6) AS resid_native_rate, round(rx, 6) AS resid_foreign_share FROM clean",
                *rows,
                *RESIDUALS,
            )
        )
    sql["twfe_unbalanced"] = _fit(PANEL_UNKNOWN, *CLUSTERED)
    sql["panel_unknown_weights"] = _with(panel, *PANEL_UNKNOWN)
    sql["panel_crude_unknown_weights"] = _with(panel, *PANEL_CRUDE_UNKNOWN)
    sql["foreign_share_unknown_weights"] = _with(
        "SELECT state, data_year, CASE WHEN count(age_group) FILTER (nativity = 'foreign') = count(*) FILTER (nativity = 'foreign') THEN coalesce(sum(perwt) FILTER (nativity = 'foreign'), 0) END AS foreign_pop, "
        "CASE WHEN count(age_group) = count(*) THEN sum(perwt) END AS total_pop, "
        "CASE WHEN count(age_group) = count(*) THEN round(coalesce(sum(perwt) FILTER (nativity = 'foreign'), 0) / sum(perwt) * 100, 6) END AS foreign_share FROM xp GROUP BY ALL"
    )
    sql["twfe_residual_band"] = _linear_band(
        (*PANEL_ADJUSTED, *RESIDUALS, "pairs AS (SELECT rx AS x, ry AS y FROM clean)")
    )
    pair = (
        *_standardised("state", "nativity = 'native' AND data_year = 2024", "exposure"),
        "share24 AS (SELECT state, coalesce(sum(perwt) FILTER (nativity = 'foreign'), 0) AS foreign_pop, sum(perwt) AS total_pop FROM xp WHERE data_year = 2024 GROUP BY ALL)",
        f"pairs AS (SELECT s.state, {ADJ_STATE}, n < 10 AS suppressed, CASE WHEN n >= 10 THEN age_adjusted_rate END AS y, foreign_pop, total_pop, foreign_pop / total_pop * 100 AS x FROM std s LEFT JOIN share24 h ON s.state IS NOT DISTINCT FROM h.state)",
    )
    sql["native_rate_by_foreign_share"] = _with(
        "SELECT state, n, pop, crude_rate, age_adjusted_rate, suppressed, foreign_pop, total_pop, round(x, 6) AS foreign_share FROM pairs", *pair
    )
    sql["pearson_corr"] = _with("SELECT round(corr(x, y), 6) AS r, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n FROM pairs", *pair)
    sql["linear_fit"] = _with(
        "SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r_squared, round(avg(x), 6) AS x_mean, "
        "round(regr_sxx(y, x), 6) AS sxx, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, "
        "round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)), 6) AS residual_sd FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL",
        *pair,
    )
    sql["linear_band"] = _linear_band(pair)
    sql["external_share"] = _with(
        "SELECT state, round(status_pop, 6) AS status_pop, status_n, round(total_pop, 6) AS total_pop, round(status_pop / total_pop * 100, 6) AS status_share FROM ext WHERE status_pop IS NOT NULL", *EXT
    )
    sql["native_rate_by_external_share"] = _with(
        f"SELECT s.state, {RATES.replace('n, pop', 's.n, s.pop')}, round(status_pop, 6) AS status_pop, status_n, round(total_pop, 6) AS total_pop, round(status_pop / total_pop * 100, 6) AS status_share, round(status_pop / s.pop * 100, 6) AS share_of_native "
        "FROM std s LEFT JOIN (SELECT * FROM ext WHERE status_pop IS NOT NULL) x ON x.state = s.state",
        *EXT,
        *_standardised("state", "nativity = 'native' AND data_year = 2024"),
    )
    sql["native_crude_by_external_share"] = _with(
        "SELECT c.state, c.n, c.pop, round(c.rate, 6) AS rate, round(status_pop, 6) AS status_pop, status_n, round(total_pop, 6) AS total_pop, round(status_pop / total_pop * 100, 6) AS status_share "
        "FROM crude c LEFT JOIN (SELECT * FROM ext WHERE status_pop IS NOT NULL) x ON x.state = c.state",
        *EXT,
        _crude("state", "nativity = 'native' AND data_year = 2024"),
    )
    sql["two_group_compare"] = _with(
        "SELECT a.state, round(a.age_adjusted_rate, 6) AS native_rate, round(b.age_adjusted_rate, 6) AS foreign_rate FROM std a JOIN std b ON a.state = b.state "
        "WHERE a.nativity = 'native' AND b.nativity = 'foreign' AND a.n >= 10 AND b.n >= 10 AND a.age_adjusted_rate IS NOT NULL AND b.age_adjusted_rate IS NOT NULL",
        *_standardised("state, nativity", KNOWN + " AND data_year = 2024", "exposure"),
    )
    return sql
