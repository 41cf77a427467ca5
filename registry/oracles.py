"""SQL the registered queries are checked against, written independently of the library.

The rules are stated in full here (no keyword left out, classic formulas, p-values
by numerical integration), so that agreement says something about the shortcuts.
"""

from __future__ import annotations

from registry import tables as R
from registry.queries import TOPICS
from skewlens import constants as K


def _q(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def _case(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + " END"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _classify(text: str, taxonomy, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(text, ws)} THEN {_q(label)}" for label, ws in taxonomy) + f" ELSE {_q(default)} END"


def _first_code(text: str) -> str:
    tests = " ".join(f"WHEN contains(upper({text}), '{c}') THEN '{c}'" for c in K.STATE_CODES)
    return f"CASE WHEN {text} IS NULL THEN NULL {tests} ELSE 'UNKNOWN' END"


def _r(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name}"


def _shown(x: str, name: str) -> str:
    """Two decimals, decimal ties to even."""
    return f"round_even(round(CAST({x} AS DOUBLE) * 100, 6), 0) / 100 AS {name}"


def _n(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


def _floor_days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


# --- p-values: Simpson's rule on the density's tail, t = s + c*u/(1-u) -------

_STEPS = 2000


def _tail(start: str, scale: str, log_density: str) -> str:
    """Integral of exp(log_density(t)) from ``start`` to infinity."""
    u = f"(i / {_STEPS}.0)"
    t = f"({start} + {scale} * {u} / (1 - {u}))"
    weight = f"CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    body = log_density.replace("$t", t)
    return (
        f"(list_sum(list_transform(range(0, {_STEPS}), lambda i: {weight} * "
        f"exp({body}) * {scale} / ((1 - {u}) * (1 - {u})))) / (3.0 * {_STEPS}))"
    )


def _p_chi2(x: str, k: str) -> str:
    log = f"(({k})/2.0 - 1) * ln($t) - $t / 2 - ({k})/2.0 * ln(2.0) - lgamma(({k})/2.0)"
    return f"CASE WHEN {x} > 2000 THEN 0.0 ELSE " + _tail(x, f"(2.0 * ({k}) + 10)", log) + " END"


def _p_f(f: str, d1: str, d2: str) -> str:
    log = (
        f"({d1})/2.0 * ln(CAST({d1} AS DOUBLE)/({d2})) + (({d1})/2.0 - 1) * ln($t) "
        f"- (({d1}) + ({d2}))/2.0 * ln(1 + CAST({d1} AS DOUBLE) * $t / ({d2})) "
        f"- lgamma(({d1})/2.0) - lgamma(({d2})/2.0) + lgamma((({d1}) + ({d2}))/2.0)"
    )
    return _tail(f, "2.0", log)


def _p_r(r: str, n: str) -> str:
    v = f"(({n}) - 2.0)"
    t = f"(abs({r}) * sqrt({v} / (1 - ({r}) * ({r}))))"
    log = f"lgamma(({v} + 1)/2) - lgamma({v}/2) - 0.5 * ln({v} * pi()) - ({v} + 1)/2 * ln(1 + $t * $t / {v})"
    return f"CASE WHEN abs({r}) >= 1 THEN 0.0 ELSE 2 * {_tail(t, '2.0', log)} END"


# --- derived tables ----------------------------------------------------------

_PLACE = "CASE c_nationkey " + " ".join(f"WHEN {i} THEN {_q(p)}" for i, p in enumerate(R.PLACES)) + " END"

NOTICES = f"""notices AS (
  SELECT 'N' || o_orderkey AS uid, o_orderkey AS k,
    {_case("o_orderstatus || substr(o_orderpriority, 1, 1)", R.TITLES)} AS title,
    {_case("c_mktsegment", R.DESCRIPTIONS)} AS description,
    c_name AS name, {_PLACE} AS place_of_birth,
    o_orderdate AS publication_date,
    o_orderdate + to_seconds((o_orderkey * 104729) % 100000000) AS modified_date,
    CASE WHEN o_totalprice > 250000 THEN '$' || CAST(floor(o_totalprice / 10) AS BIGINT)
         WHEN o_totalprice > 200000 THEN '' END AS reward_text,
    CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS n_img,
    TIMESTAMP '{R.INGESTED}' AS ingestion_date,
    {_floor_days(f"TIMESTAMP '{R.INGESTED}'", "o_orderdate")} AS case_age_days
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_REGION_OF = {s: r for r, ss in K.REGIONS.items() for s in ss}
_POPULATION = "CASE birth_state " + " ".join(f"WHEN '{s}' THEN {p}::DOUBLE" for s, p in K.STATE_POPULATIONS.items()) + " END"
_BUCKET = (
    "CASE WHEN case_age_days IS NULL THEN 'Unknown' WHEN case_age_days < 30 THEN 'Recent (< 1 month)' "
    "WHEN case_age_days < 365 THEN 'Medium (1-12 months)' WHEN case_age_days < 1825 THEN 'Long (1-5 years)' "
    "ELSE 'Very Long (> 5 years)' END"
)

FEATURES = NOTICES + f""", texts AS (
  SELECT *, {_first_code("place_of_birth")} AS birth_state,
    lower(coalesce(title, 'None') || ' ' || coalesce(description, 'None')) AS weapon_raw FROM notices),
labelled AS (
  SELECT *, {_classify("weapon_raw", K.CRIME_FAMILIES, "Other")} AS crime_family,
    {_classify("weapon_raw", K.WEAPONS, "unknown")} AS weapon_category FROM texts),
features AS (
  SELECT *, {_POPULATION} AS birth_state_population,
    coalesce({_case("birth_state", _REGION_OF)}, 'Other') AS birth_region,
    CAST(year(publication_date) AS BIGINT) AS publication_year,
    CAST(quarter(publication_date) AS BIGINT) AS publication_quarter,
    CAST(month(publication_date) AS BIGINT) AS publication_month,
    {_BUCKET} AS case_age_category,
    ({_any("weapon_raw", K.SERIOUS_PHRASES)} OR crime_family IN ('Violent', 'Terrorism')) AS severity_flag,
    {_floor_days("ingestion_date", "modified_date")} AS days_since_modified,
    reward_text IS NOT NULL AS has_reward, coalesce(n_img > 0, false) AS has_images
  FROM labelled)"""

BASELINE = f"""baseline_raw AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS year, l_returnflag AS state,
    {_case("p_type", R.OFFENSES)} AS offense_type, count(*) AS count, sum(l_quantity) / 1000.0 AS rate_per_100k
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
baseline AS (SELECT *, {_classify("lower(offense_type)", K.BASELINE_FAMILIES, "other")} AS own_family FROM baseline_raw),
crossed AS (SELECT *, {_case("own_family", K.BASELINE_CROSSWALK)} AS crime_family FROM baseline)"""

F_ = "WITH " + FEATURES
FB = "WITH " + FEATURES + ", " + BASELINE
SER = F_ + ", serious AS (SELECT * FROM features WHERE severity_flag)"

# Representation of one row per unit in ``per_unit``(unit, o, pop); null units count in the total.
_REPRESENTED = """, totals AS (
  SELECT sum(o) AS n, sum(CASE WHEN unit IS NOT NULL THEN pop END) AS p FROM per_unit),
represented AS (
  SELECT unit, o, pop, pop / p * n AS e, o / (pop / p * n) AS ratio, n FROM per_unit, totals
  WHERE unit IS NOT NULL AND pop > 0 AND n >= 50)"""
_FIT = """, used AS (SELECT * FROM represented WHERE e >= 5),
scale AS (SELECT sum(o) / sum(e) AS f FROM used),
fit AS (SELECT count(*) AS k, sum((o - e * f) * (o - e * f) / (e * f)) AS chi2, max(f) AS f FROM used, scale)"""

NATIONS = """WITH per_unit AS (
  SELECT n_name AS unit, coalesce(c.o, 0) AS o, s.p AS pop FROM nation
  LEFT JOIN (SELECT c_nationkey, count(*) AS o FROM customer GROUP BY 1) c ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT s_nationkey, CAST(count(*) AS DOUBLE) AS p FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey)"""
STATES = F_ + """, per_unit AS (
  SELECT birth_state AS unit, count(*) AS o, max(birth_state_population) AS pop FROM features
  WHERE birth_state IS DISTINCT FROM 'UNKNOWN' GROUP BY 1)""" + _REPRESENTED


def _rep_columns(unit: str) -> str:
    return (
        f"unit AS {unit}, {_n('o', 'observed_cases')}, {_r('pop', 'population_millions')}, {_r('e', 'expected_cases')}, "
        f"{_r('ratio', 'representation_ratio')}, ratio > 1.2 AS over_represented, ratio < 0.8 AS under_represented"
    )


_REP_SUMMARY = (
    f"SELECT {_n('count(*)', 'states_analyzed')}, {_n('count(*) FILTER (ratio > 1.2)', 'over_represented_states')}, "
    f"{_n('count(*) FILTER (ratio < 0.8)', 'under_represented_states')}, {_r('avg(ratio)', 'mean_representation_ratio')}, "
    f"{_r('stddev_samp(ratio)', 'std_representation_ratio')} FROM represented"
)
_LABEL = "CASE WHEN ratio > 1.2 THEN 'over_represented' WHEN ratio < 0.8 THEN 'under_represented' ELSE 'normal' END"

_GEO_TEST_CTE = STATES + _FIT + f""", names AS (
  SELECT string_agg(unit, ', ' ORDER BY o DESC, unit) FILTER (ratio > 1.2) AS over_names,
         string_agg(unit, ', ' ORDER BY o DESC, unit) FILTER (ratio < 0.8) AS under_names FROM represented),
geo AS (SELECT k, chi2, f, {_p_chi2('chi2', '(k - 1)')} AS p FROM fit),
geo_text AS (SELECT geo.*, CASE WHEN p < 1 - 0.95
    THEN 'Significant geographic bias detected (p=' || printf('%.4f', p) || '). '
      || coalesce('Over-represented states: ' || over_names || '. ', '')
      || coalesce('Under-represented states: ' || under_names || '.', '')
    ELSE 'No significant geographic bias detected (p=' || printf('%.4f', p)
      || '). Representation appears proportional to population.' END AS interpretation
  FROM geo, names)"""

# Category comparison and test over ``w``(fam, n) with total ``wn``, and ``b``(fam, n).
_CATEGORIES = """, w AS (SELECT crime_family AS fam, count(*) AS n FROM features GROUP BY 1),
b AS (SELECT crime_family AS fam, sum(count) AS n FROM crossed GROUP BY 1),
both_sides AS (
  SELECT w.fam, w.n AS o, b.n AS e, w.n / (SELECT sum(n) FROM w) AS ws, b.n / (SELECT sum(n) FROM b) AS bs
  FROM w JOIN b ON w.fam = b.fam)"""
_CAT_FIT = f""", cat_scale AS (SELECT sum(o) / sum(e) AS f, sum(o) <> sum(e) AS moved FROM both_sides),
cat_fit AS (SELECT count(*) AS k, sum((o - e * f) * (o - e * f) / (e * f)) AS chi2, any_value(moved) AS moved
  FROM both_sides, cat_scale),
cat AS (SELECT *, {_p_chi2('chi2', '(k - 1)')} AS p FROM cat_fit)"""


def _anova(source: str, key: str, value: str) -> str:
    """CTEs up to ``an`` (groups, n, f, d1, d2, p) in the classic two-pass form."""
    return f""", an_groups AS (
  SELECT {key} AS g, count({value}) AS n, avg({value}) AS m FROM {source} GROUP BY 1 HAVING count(*) > 5),
an_grand AS (SELECT avg({value}) AS gm FROM {source} JOIN an_groups ON g = {key}),
an_b AS (SELECT count(*) AS groups, sum(n) AS n, sum(n * (m - gm) * (m - gm)) AS ssb FROM an_groups, an_grand),
an_w AS (SELECT sum(({value} - m) * ({value} - m)) AS ssw FROM {source} JOIN an_groups ON g = {key}),
an_f AS (SELECT groups, CAST(n AS BIGINT) AS n, (ssb / (groups - 1)) / (ssw / (n - groups)) AS f FROM an_b, an_w),
an AS (SELECT *, groups - 1 AS d1, n - groups AS d2, {_p_f('f', '(groups - 1)', '(n - groups)')} AS p FROM an_f)"""


_ANOVA_COLUMNS = (
    f"{_n('groups', 'groups')}, {_n('n', 'sample_size')}, {_r('f', 'anova_f_statistic')}, {_n('d1', 'df_between')}, "
    f"{_n('d2', 'df_within')}, {_r('p', 'anova_p_value')}, p < 1 - 0.95 AS significant_differences, 'ok' AS status, "
    "CAST(NULL AS VARCHAR) AS note, 0.95::DOUBLE AS confidence_level"
)
_PERS_TEXT = """, means AS (SELECT crime_family AS g, round(avg(case_age_days), 2) AS m FROM features GROUP BY 1),
ends AS (SELECT (SELECT g FROM means ORDER BY m DESC, g LIMIT 1) AS g1, (SELECT m FROM means ORDER BY m DESC, g LIMIT 1) AS m1,
  (SELECT g FROM means ORDER BY m, g LIMIT 1) AS g2, (SELECT m FROM means ORDER BY m, g LIMIT 1) AS m2),
an_text AS (SELECT an.*, CASE WHEN p < 1 - 0.95
   THEN 'Significant differences in case persistence detected (p=' || printf('%.4f', p) || '). ''' || g1
     || ''' cases persist longest (avg: ' || printf('%.0f', m1) || ' days), while ''' || g2
     || ''' cases are resolved fastest (avg: ' || printf('%.0f', m2) || ' days).'
   ELSE 'No significant differences in case persistence across categories (p=' || printf('%.4f', p) || ').' END
   AS interpretation FROM an, ends)"""


def _persistence(source: str, key: str, value: str, whole: bool) -> str:
    end = (lambda x, n: _n(x, n)) if whole else (lambda x, n: _r(x, n))
    return (
        f"SELECT {key}, {_n(f'count({value})', 'count')}, {_r(f'avg({value})', 'mean')}, {_r(f'median({value})', 'median')}, "
        f"{_r(f'stddev_samp({value})', 'std')}, {end(f'min({value})', 'min')}, {end(f'max({value})', 'max')}, "
        + ", ".join(_shown(f"{e}({value})", f"{c}_shown") for e, c in (("avg", "mean"), ("median", "median"), ("stddev_samp", "std")))
        + f" FROM {source} WHERE {key} IS NOT NULL GROUP BY 1"
    )


def _box(source: str, key: str, value: str) -> str:
    names = [("0.0", "min"), ("0.25", "q1"), ("0.5", "median"), ("0.75", "q3"), ("1.0", "max")]
    return f"SELECT {key}, " + ", ".join(
        _r(f"quantile_cont(CAST({value} AS DOUBLE), {p})", n) for p, n in names
    ) + f" FROM {source} WHERE {key} IS NOT NULL GROUP BY 1"


def _trend(source: str, key: str, period: str) -> str:
    """CTEs up to ``trend`` on the full zero-filled grid with the library-free correlation."""
    return f""", tr_cells AS (SELECT {period} AS y, {key} AS g, count(*) AS n FROM {source}
  WHERE {period} IS NOT NULL AND {key} IS NOT NULL GROUP BY 1, 2),
tr_grid AS (SELECT ys.y, gs.g, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT y FROM tr_cells) ys
  CROSS JOIN (SELECT DISTINCT g FROM tr_cells) gs LEFT JOIN tr_cells c ON c.y = ys.y AND c.g = gs.g),
tr_stats AS (SELECT g, count(*) AS m, corr(CAST(y AS DOUBLE), CAST(n AS DOUBLE)) AS r0, sum(n) AS total,
  arg_min(n, y) AS n1, arg_max(n, y) AS n2 FROM tr_grid GROUP BY 1),
tr_r AS (SELECT *, CASE WHEN isnan(r0) THEN NULL WHEN abs(r0) < 1e-12 THEN 0.0 WHEN abs(r0) > 1 - 1e-12 THEN sign(r0) ELSE r0 END AS r FROM tr_stats
  WHERE m > 2 AND total > 0),
trend AS (SELECT *, {_p_r('r', 'm')} AS p FROM tr_r)"""


def _trend_columns(key: str) -> str:
    return (
        f"g AS {key}, {_r('r', 'correlation_with_time')}, {_r('p', 'trend_p_value')}, "
        "coalesce(p < 1 - 0.95, false) AS significant_trend, "
        "CASE WHEN r > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction, "
        f"{_r('CASE WHEN n1 > 0 THEN (n2 - n1) * 100.0 / n1 ELSE 0 END', 'percent_change')}, {_n('total', 'total_cases')}, "
        f"{_n('n1', 'first_cases')}, {_n('n2', 'last_cases')}"
    )


def _grid(source: str, a: str, b: str, share: str | None) -> str:
    """Zero-filled two-way table, optionally with the percentage or share within ``a`` or ``b``."""
    extra = {
        None: "",
        "percentage": f", {_r(f'100.0 * coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY x.{a})', 'percentage')}",
        "row": f", {_r(f'coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY x.{a})', 'share')}",
        "column": f", {_r(f'coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY z.{b})', 'share')}",
    }[share]
    return f""", c AS (SELECT {a}, {b}, count(*) AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)
SELECT x.{a}, z.{b}, CAST(coalesce(c.n, 0) AS BIGINT) AS n{extra}
FROM (SELECT DISTINCT {a} FROM c) x CROSS JOIN (SELECT DISTINCT {b} FROM c) z
LEFT JOIN c ON c.{a} = x.{a} AND c.{b} = z.{b}"""


def _distribution(source: str, key: str, base: str, percent: bool = True) -> str:
    where = f"(SELECT count(*) FROM {source}" + (f" WHERE {key} IS NOT NULL)" if base == "known" else ")")
    return (
        f"SELECT {key}, {_n('count(*)', 'n')}, {_r(f'count(*) / {where}', 'proportion')}"
        + (f", {_r(f'count(*) * 100.0 / {where}', 'percentage')}" if percent else "")
        + f" FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}"
    )


def _subset(source: str, key: str, flag: str, domain, points: float) -> str:
    labels = (
        f"(SELECT unnest([{', '.join(map(_q, domain))}]) AS {key})" if domain
        else f"(SELECT DISTINCT {key} FROM {source} WHERE {key} IS NOT NULL)"
    )
    a = f"100.0 * count(s.{key}) / (SELECT count({key}) FROM {source})"
    b = f"100.0 * count(s.{key}) FILTER (s.{flag}) / (SELECT count({key}) FROM {source} WHERE {flag})"
    return f"""SELECT {key}, {_r('a', 'all_crimes_percentage')}, {_r('b', 'serious_crimes_percentage')}, {_r('b - a', 'difference')},
  b - a > {points} AS over_represented_in_serious, b - a < -{points} AS under_represented_in_serious,
  {_shown('a', 'all_crimes_percentage_shown')}, {_shown('b', 'serious_crimes_percentage_shown')}, {_shown('b - a', 'difference_shown')}
FROM (SELECT d.{key}, {a} AS a, {b} AS b FROM {labels} d LEFT JOIN {source} s ON s.{key} = d.{key} GROUP BY 1)"""


_QUALITY = (
    f"SELECT {_n('count(*)', 'total_records')}, {_n('u', 'unknown_weapons')}".replace("count(*)", "t")
    + f", {_r('u * 100.0 / t', 'unknown_weapon_percentage')}, {_n('m', 'missing_weapon_data')}, "
    f"{_r('m * 100.0 / t', 'missing_data_percentage')}, {_r('(t - u - m) * 100.0 / t', 'data_completeness_score')}"
)


def _quality(source: str, raw: str) -> str:
    return _QUALITY + (
        f" FROM (SELECT count(*) AS t, count(*) FILTER (weapon_category = 'unknown') AS u, "
        f"count(*) FILTER ({raw} IS NULL OR {raw} = '') AS m FROM {source})"
    )


_UNKNOWN = """, unknown_trend AS (SELECT publication_year, 100.0 * count(*) FILTER (weapon_category = 'unknown') / count(*) AS pct
  FROM serious GROUP BY 1 HAVING (SELECT count(*) FROM serious WHERE weapon_category = 'unknown') > 0)"""
_WEAPON_SUMMARY = SER + _UNKNOWN + """
SELECT 'Analyzed ' || s || ' serious crimes out of ' || t || ' total records (' || printf('%.1f', 100.0 * s / t)
  || '%). Most common weapon category in serious crimes: ' || top || '. Unknown weapon information: '
  || printf('%.1f', 100.0 * u / s) || '% of serious crimes. Unknown weapon percentage '
  || CASE WHEN p2 > p1 THEN 'increased' ELSE 'decreased' END || ' from ' || printf('%.1f', p1) || '% to ' || printf('%.1f', p2)
  || '% over time. Note: Analysis is aggregate-only and subject to reporting bias and missing data limitations.' AS summary
FROM (SELECT count(*) AS t, count(*) FILTER (severity_flag) AS s,
        count(*) FILTER (severity_flag AND weapon_category = 'unknown') AS u FROM features),
  (SELECT weapon_category AS top FROM serious GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  (SELECT arg_min(pct, publication_year) AS p1, arg_max(pct, publication_year) AS p2 FROM unknown_trend)"""

_FLAT = """, payload AS (
  SELECT *, CASE k % 50 WHEN 0 THEN NULL ELSE publication_date END AS pub FROM notices)
SELECT uid, title, description, CASE WHEN k % 7 <> 0 THEN name END AS name,
  CASE WHEN k % 7 <> 0 THEN place_of_birth END AS place_of_birth,
  strftime(pub, '%Y-%m-%d %H:%M:%S') AS publication_date, strftime(modified_date, '%Y-%m-%d %H:%M:%S') AS modified_date,
  reward_text, CASE WHEN k % 50 <> 0 THEN case_age_days END AS case_age_days,
  CASE WHEN k % 7 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_subjects, coalesce(n_img, 0)::BIGINT AS n_images,
  CASE WHEN k % 7 <> 0 THEN 1 END::BIGINT AS n_aliases FROM payload"""

_DELAYS = f"""WITH delays AS (SELECT p_type, {_floor_days("l_shipdate", "o_orderdate")} AS delay_days FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
_BY_CUSTOMER = "WITH yearly AS (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS y0 FROM orders)"
_REPEATED = "WITH " + NOTICES + """, doubled AS (
  SELECT *, modified_date AS md FROM notices
  UNION ALL SELECT *, modified_date + INTERVAL 1 DAY FROM notices WHERE k % 4 = 0),
repeated AS (SELECT * REPLACE (CASE WHEN k % 9 <> 0 THEN uid END AS uid) FROM doubled)"""
_TESTS = (
    _GEO_TEST_CTE + ", " + BASELINE + _CATEGORIES + _CAT_FIT + _anova("features", "crime_family", "case_age_days") + _PERS_TEXT
)
_OVERVIEW = (
    f"SELECT {_n('count(*)', 'total_cases')}, {_n('count(DISTINCT crime_family)', 'crime_categories')}, "
    f"{_n('count(DISTINCT birth_state)', 'states_represented')}"
)


def _severity(analysed: str, base: str) -> str:
    return (
        f"SELECT {_n('t', 'total_cases')}, {_n('s', 'serious_cases')}, {_r('100.0 * s / t', 'serious_percentage')}, "
        f"{_n('u', 'unknown_weapons')}, {_r(f'100.0 * u / {base}', 'unknown_percentage')} FROM ("
        "SELECT count(*) AS t, count(*) FILTER (severity_flag) AS s, "
        f"count(*) FILTER ({analysed} AND weapon_category = 'unknown') AS u FROM features)"
    )


ORACLES: dict[str, str] = {
    "nation_representation_test": NATIONS + _REPRESENTED + _FIT + f"""
SELECT {_n('k', 'units_tested')}, {_r('chi2', 'chi_square_statistic')}, {_n('k - 1', 'degrees_of_freedom')},
  abs(f - 1) > 1e-9 AS expected_rescaled, 'ok' AS status, {_r('p', 'p_value')}, p < 1 - 0.95 AS significant_bias
FROM (SELECT *, {_p_chi2('chi2', '(k - 1)')} AS p FROM fit)""",
    "nation_representation": NATIONS + _REPRESENTED + f" SELECT {_rep_columns('unit')} FROM represented",
    "nation_representation_summary": NATIONS + _REPRESENTED + _REP_SUMMARY,
    "notice_payloads": "WITH " + NOTICES + _FLAT,
    "notice_page_files": "WITH " + NOTICES + _FLAT,
    "baseline_families": "WITH " + BASELINE + f"""
SELECT year, state, offense_type, {_n('count', 'count')}, {_r('rate_per_100k', 'rate_per_100k')}, own_family AS crime_family FROM baseline""",
    "baseline_year_folders": "WITH " + BASELINE + f"""
SELECT year, state, offense_type, {_n('count', 'count')}, {_r('rate_per_100k', 'rate_per_100k')}, own_family AS crime_family
FROM baseline WHERE year IN (1997, 1998, 1999)""",
    "baseline_all_years": "WITH " + BASELINE + f"""
SELECT year, state, offense_type, {_n('count', 'count')}, {_r('rate_per_100k', 'rate_per_100k')}, own_family AS crime_family FROM baseline""",
    "notice_pages_of_customers": f"""
SELECT 'u' || o_orderkey AS uid, o_orderpriority AS title, 'about ' || o_orderkey AS description,
  strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS publication_date, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS modified_date,
  'http://x/' || o_orderkey AS url, 'armed ' || o_orderkey AS warning_message, 'reward ' || o_orderkey AS reward_text,
  'caution ' || o_orderkey AS caution, 'details ' || o_orderkey AS details, 'i' || o_orderkey AS images,
  'f' || o_orderkey || '|g' || o_orderkey AS files, 2 AS n_subjects, 'name ' || o_custkey AS name, 'Male' AS sex,
  'race ' || o_orderstatus AS race, 'nation ' || o_orderstatus AS nationality, strftime(o_orderdate, '%Y-%m-%d') AS date_of_birth,
  'place ' || o_custkey AS place_of_birth, 'brown' AS hair, 'blue' AS eyes, '60' AS height_min, '70' AS height_max,
  CAST(o_totalprice AS VARCHAR) AS weight, 'alias ' || o_orderkey || '|also ' || o_orderkey AS aliases,
  '2001-08-02 06:00:00' AS ingestion_date, {_floor_days("TIMESTAMP '2001-08-02 06:00:00'", "CAST(o_orderdate AS TIMESTAMP)")} AS case_age_days
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
    "csv_round_trip": F_ + """
SELECT uid, title, strftime(publication_date, '%Y-%m-%d %H:%M:%S') AS publication_date, case_age_days, birth_state,
  severity_flag, has_reward, has_images, CAST(n_img AS BIGINT) AS n_images, reward_text FROM features""",
    "json_results": F_ + " SELECT weapon_category, n, percentage FROM (" + _distribution("features", "weapon_category", "all") + ")",
    "stored_notices": F_ + """
SELECT uid, title, birth_state, birth_region, crime_family, publication_year, publication_quarter, case_age_category,
  case_age_days, has_reward, has_images FROM features WHERE crime_family = 'Violent' AND publication_year IN (1996, 1999)""",
    "stored_baseline": "WITH " + BASELINE + f"""
SELECT year, state, offense_type, own_family AS crime_family, {_n('count', 'count')}, {_r('rate_per_100k', 'rate_per_100k')}
FROM baseline WHERE state = 'R' AND own_family IN ('cyber_crime', 'other')""",
    "analysis_history": NATIONS + _REPRESENTED + _FIT + ", " + FEATURES + _anova("features", "crime_family", "case_age_days") + f"""
SELECT 'Geographic Representation' AS analysis_type, '2001-08-03 00:00:00' AS analysis_date, 0.95::DOUBLE AS confidence_level,
  {_r('chi2', 'test_statistic')}, {_r('p', 'p_value')}, p < 1 - 0.95 AS significant_bias, 'nations' AS interpretation,
  {_n('k', 'sample_size')}, 'ok' AS status, 3 AS ids FROM (SELECT *, {_p_chi2('chi2', '(k - 1)')} AS p FROM fit)
UNION ALL SELECT 'Case Persistence', '2001-08-04 00:00:00', 0.95, round(f, 6), round(p, 6), p < 1 - 0.95, 'ok', n, 'ok', 3 FROM an
UNION ALL SELECT 'Case Persistence', '2001-08-02 00:00:00', 0.95, NULL, NULL, NULL, 'too_few_groups',
  (SELECT count(case_age_days) FROM features WHERE crime_family = 'Violent'), 'too_few_groups', 3""",
    "combined_sources": """SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment,
  'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, 'supplier' FROM supplier""",
    "birth_places": F_ + f" SELECT uid, birth_state, {_r('birth_state_population', 'birth_state_population')}, birth_region FROM features",
    "state_codes_in_urls": f"SELECT page_id, {_first_code('url')} AS state FROM pages",
    "state_codes_in_part_names": f"SELECT p_partkey, {_first_code('p_name')} AS state FROM part",
    "publication_calendar": F_ + f"""
SELECT uid, publication_year, publication_quarter, publication_month, {_r('case_age_days / 30.44', 'case_age_months')},
  {_r('case_age_days / 365.25', 'case_age_years')}, case_age_category FROM features""",
    "notice_text_rules": F_ + " SELECT uid, weapon_raw, crime_family, weapon_category, severity_flag, true AS public_notice_flag FROM features",
    "document_text_rules": f"""WITH t AS (SELECT doc_id, lower(source || ' ' || text) AS t FROM documents),
l AS (SELECT *, {_classify('t', K.CRIME_FAMILIES, 'Other')} AS crime_family FROM t)
SELECT doc_id, crime_family, {_classify('t', K.WEAPONS, 'unknown')} AS weapon_category,
  ({_any('t', K.SERIOUS_PHRASES)} OR crime_family IN ('Violent', 'Terrorism')) AS severity_flag,
  {_n('length(t)', 'n_searched')} FROM l""",
    "document_topics": f"""SELECT doc_id, {_classify('lower(text)', TOPICS, 'plain')} AS topic,
  {_any('lower(text)', ['license', 'the'])} AS flag FROM documents""",
    "page_topics": f"""SELECT {_classify('lower(html)', [('cookies', ['cookie']), ('links', ['<a href', '<a '])], 'none')} AS topic,
  {_n('count(*)', 'n')} FROM pages GROUP BY 1""",
    "notice_activity": F_ + """
SELECT uid, days_since_modified, days_since_modified < 30 AS recently_updated, has_reward, has_images FROM features""",
    "event_age": f"SELECT event_id, {_floor_days(chr(84) + 'IMESTAMP ' + _q('2024-01-15 12:30:00'), 'ts')} AS days FROM events",
    "engineered_notices": FB + f""", yearly AS (SELECT crime_family, year, sum(count) AS count, avg(rate_per_100k) AS rate
  FROM crossed GROUP BY 1, 2)
SELECT uid, birth_state, birth_region, publication_year, case_age_category, f.crime_family, weapon_category, severity_flag,
  days_since_modified < 30 AS recently_updated, has_reward, has_images, year, {_n('y.count', 'count')},
  {_r('y.rate', 'rate_per_100k')}
FROM features f LEFT JOIN yearly y ON f.crime_family = y.crime_family AND publication_year = y.year""",
    "baseline_without_crosswalk": FB + """
SELECT f.crime_family, count(*) AS n, count(b.own_family) AS matched FROM features f
LEFT JOIN (SELECT DISTINCT own_family, year FROM baseline) b ON f.crime_family = b.own_family AND publication_year = b.year
GROUP BY 1""",
    "known_places": F_ + " SELECT birth_state, count(*) AS n FROM features WHERE birth_state IS NULL OR birth_state <> 'UNKNOWN' GROUP BY 1",
    "selected_years": F_ + " SELECT crime_family, count(*) AS n FROM features WHERE publication_year IN (1996, 1998) GROUP BY 1",
    "available_years": F_ + " SELECT DISTINCT publication_year FROM features",
    "sample_gate": F_ + """ SELECT count(*) AS sample_size, 30::BIGINT AS minimum,
  CASE WHEN count(*) >= 30 THEN 'ok' ELSE 'insufficient_data' END AS status FROM features""",
    "family_counts": F_ + " SELECT crime_family, count(*) AS n FROM features GROUP BY 1",
    "family_proportions": F_ + _distribution("features", "crime_family", "all"),
    "state_proportions": F_ + _distribution("features", "birth_state", "all"),
    "state_proportions_known": F_ + _distribution("features", "birth_state", "known"),
    "yearly_baseline": "WITH " + BASELINE + f"""
SELECT crime_family, year, {_n('sum(count)', 'count')}, {_r('avg(rate_per_100k)', 'rate_per_100k')} FROM crossed GROUP BY 1, 2""",
    "baseline_distribution": "WITH " + BASELINE + f"""
SELECT crime_family, {_n('sum(count)', 'n')}, {_r('sum(count) / (SELECT sum(count) FROM crossed)', 'proportion')}
FROM crossed GROUP BY 1""",
    "case_cube": F_ + f"""
SELECT publication_year, birth_region, birth_state, crime_family, weapon_category, severity_flag, count(*) AS n,
  {_r('max(birth_state_population)', 'birth_state_population')}, false AS weapon_text_missing,
  strftime(min(publication_date), '%Y-%m-%d %H:%M:%S') AS first_publication,
  strftime(max(publication_date), '%Y-%m-%d %H:%M:%S') AS last_publication,
  {_n('sum(case_age_days)', 'case_age_sum')}, count(case_age_days) AS case_age_count
FROM features GROUP BY 1, 2, 3, 4, 5, 6""",
    "year_by_family": F_ + _grid("features", "publication_year", "crime_family", None),
    "year_by_family_from_cube": F_ + _grid("features", "publication_year", "crime_family", None),
    "year_by_weapon": F_ + _grid("features", "publication_year", "weapon_category", "percentage"),
    "region_by_family": F_ + _grid("features", "birth_region", "crime_family", "column"),
    "nation_by_priority": f"""SELECT {_n('c_nationkey', 'c_nationkey')}, o_orderpriority, count(*) AS n,
  {_r('count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey)', 'share')}
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority""",
    "distinct_labels": F_ + """ SELECT count(DISTINCT crime_family) AS crime_family, count(DISTINCT birth_state) AS birth_state,
  count(DISTINCT weapon_category) AS weapon_category FROM features""",
    "distinct_customers": "SELECT count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT o_orderstatus) AS o_orderstatus FROM orders",
    "overview": F_ + _OVERVIEW + f""", strftime(min(publication_date), '%Y-%m-%d %H:%M:%S') AS first_publication,
  strftime(max(publication_date), '%Y-%m-%d %H:%M:%S') AS last_publication,
  {_r('avg(case_age_days)', 'mean_case_age_days')} FROM features""",
    "yearly_counts": F_ + " SELECT publication_year, count(*) AS n FROM features GROUP BY 1",
    "concentration": F_ + f"""
SELECT {_n('b', 'big_state_cases')}, {_r('100.0 * b / t', 'big_state_percentage')}, {_n('r', 'recent_cases')},
  {_r('100.0 * r / t', 'recent_percentage')}
FROM (SELECT count(*) AS t, count(*) FILTER (birth_state IN ('CA', 'TX', 'FL')) AS b,
  count(*) FILTER (publication_year >= 2000) AS r FROM features)""",
    "severity_metrics": F_ + _severity("severity_flag", "s"),
    "severity_metrics_all_rows": F_ + _severity("true", "t"),
    "weapon_completeness": SER + """
SELECT CASE weapon_category WHEN 'unknown' THEN 'Unknown Weapons' WHEN 'none' THEN 'No Weapon' ELSE 'Known Weapons' END AS category,
  count(*) AS n FROM serious GROUP BY 1
UNION ALL SELECT 'No Weapon', 0 WHERE NOT EXISTS (SELECT 1 FROM serious WHERE weapon_category = 'none')""",
    "first_and_last_year": F_ + """
SELECT crime_family, min(y) AS first_period, arg_min(n, y) AS first_value, max(y) AS last_period, arg_max(n, y) AS last_value
FROM (SELECT crime_family, publication_year AS y, count(*) AS n FROM features GROUP BY 1, 2) GROUP BY 1""",
    "example_notices": SER + """ SELECT uid, coalesce(title, '') AS title, substr(weapon_raw, 1, 60) AS description
FROM serious ORDER BY uid LIMIT 3""",
    "geographic_representation": STATES + f" SELECT {_rep_columns('birth_state')} FROM represented",
    "geographic_summary": STATES + _REP_SUMMARY,
    "geographic_test": _GEO_TEST_CTE + f"""
SELECT {_n('k', 'units_tested')}, (SELECT CAST(n AS BIGINT) FROM totals) AS sample_size, {_r('chi2', 'chi_square_statistic')},
  {_n('k - 1', 'degrees_of_freedom')}, abs(f - 1) > 1e-9 AS expected_rescaled, 'ok' AS status, {_r('p', 'p_value')},
  p < 1 - 0.95 AS significant_bias, interpretation, 0.95::DOUBLE AS confidence_level, CAST(NULL AS VARCHAR) AS error
FROM geo_text""",
    "category_comparison": FB + _CATEGORIES + f"""
SELECT fam AS crime_family, {_n('o', 'wanted_cases')}, {_r('ws', 'wanted_proportion')}, {_n('e', 'baseline_cases')},
  {_r('bs', 'baseline_proportion')}, {_r('ws / bs', 'representation_ratio')}, ws / bs > 1.5 AS over_represented,
  ws / bs < 0.5 AS under_represented FROM both_sides WHERE bs > 0""",
    "category_test": FB + _CATEGORIES + _CAT_FIT + f"""
SELECT {_n('k', 'units_tested')}, {_r('chi2', 'chi_square_statistic')}, {_n('k - 1', 'degrees_of_freedom')},
  moved AS expected_rescaled, 'ok' AS status, {_r('p', 'p_value')}, p < 1 - 0.95 AS significant_bias,
  0.95::DOUBLE AS confidence_level, (SELECT count(*) FROM features) AS sample_size FROM cat""",
    "segment_test": """WITH both_sides AS (SELECT * FROM
  (SELECT c_mktsegment AS fam, count(*) AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
  JOIN (SELECT c_mktsegment AS fam, count(*) AS e FROM customer GROUP BY 1) USING (fam))""" + _CAT_FIT + f"""
SELECT {_n('k', 'units_tested')}, {_r('chi2', 'chi_square_statistic')}, {_n('k - 1', 'degrees_of_freedom')},
  moved AS expected_rescaled, 'ok' AS status, {_r('p', 'p_value')}, p < 1 - 0.95 AS significant_bias FROM cat""",
    "family_trends": F_ + _trend("features", "crime_family", "publication_year") + f" SELECT {_trend_columns('crime_family')} FROM trend",
    "priority_trends": "WITH monthly AS (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) AS mth FROM orders)"
    + _trend("monthly", "o_orderpriority", "mth") + f" SELECT {_trend_columns('o_orderpriority')} FROM trend",
    "customer_trends": _BY_CUSTOMER + _trend("yearly", "o_custkey", "y0") + f" SELECT {_trend_columns('o_custkey')} FROM trend",
    "strong_trends": F_ + _trend("features", "crime_family", "publication_year")
    + f" SELECT {_trend_columns('crime_family')} FROM trend WHERE abs(r) >= 0.5",
    "significant_trend_count": _BY_CUSTOMER + _trend("yearly", "o_custkey", "y0")
    + " SELECT count(*) FILTER (p < 1 - 0.95) AS significant_trends FROM trend",
    "case_persistence": F_ + " " + _persistence("features", "crime_family", "case_age_days", True),
    "case_persistence_test": F_ + _anova("features", "crime_family", "case_age_days") + _PERS_TEXT
    + f" SELECT {_ANOVA_COLUMNS}, interpretation FROM an_text",
    "delay_by_part_type": _DELAYS + " " + _persistence("delays", "p_type", "delay_days", True),
    "delay_anova": _DELAYS + _anova("delays", "p_type", "delay_days")
    + _PERS_TEXT.replace("crime_family", "p_type").replace("case_age_days", "delay_days").replace("FROM features", "FROM delays")
    + f" SELECT {_ANOVA_COLUMNS}, interpretation FROM an_text",
    "p_values_of_nations": f"""WITH c AS (
  SELECT c_nationkey AS nation, o_orderpriority AS priority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
), s AS (
  SELECT nation, (1 + nation) * sum((n - e) * (n - e) / e) AS x, count(*) - 1 AS k
  FROM (SELECT *, sum(n) OVER (PARTITION BY nation) / count(*) OVER (PARTITION BY nation) AS e FROM c) GROUP BY 1
)
SELECT nation, round(x, 6) AS statistic, round(log10({_p_chi2('x', 'k')}), 6) AS log10_p FROM s""",
    "price_quantiles": _box("lineitem", "l_returnflag", "l_extendedprice"),
    "event_value_statistics": _persistence("events", "event_type", "value", False),
    "weapon_totals": F_ + f"""
SELECT {_n('s', 'total_serious_crimes')}, {_n('t', 'total_all_crimes')}, {_r('100.0 * s / t', 'serious_crime_percentage')},
  CASE WHEN s = 0 THEN 'No serious crimes found in dataset' END AS error
FROM (SELECT count(*) FILTER (severity_flag) AS s, count(*) AS t FROM features)""",
    "weapon_extremes": SER + """, c AS (SELECT weapon_category AS w, count(*) AS n FROM serious GROUP BY 1)
SELECT (SELECT w FROM c ORDER BY n DESC, w LIMIT 1) AS most_common, (SELECT w FROM c ORDER BY n, w DESC LIMIT 1) AS least_common""",
    "weapon_quality": SER + " " + _quality("serious", "weapon_raw"),
    "weapon_quality_raw": F_ + " " + _quality("features", "reward_text"),
    "weapon_comparison": F_ + " " + _subset("features", "weapon_category", "severity_flag", K.WEAPON_DOMAIN, 5),
    "event_type_comparison": "WITH e AS (SELECT *, value > 50 AS high FROM events) " + _subset("e", "event_type", "high", None, 0.5),
    "toxic_label_comparison": "WITH e AS (SELECT lang, toxic = 1 AS flag FROM documents JOIN labels USING (doc_id)) "
    + _subset("e", "lang", "flag", None, 5),
    "unknown_weapon_trend": SER + _UNKNOWN + f" SELECT publication_year, {_r('pct', 'percentage')} FROM unknown_trend",
    "unknown_weapon_direction": SER + _UNKNOWN + f"""
SELECT periods, {_r('p1', 'first_percentage')}, {_r('p2', 'last_percentage')},
  CASE WHEN p2 > p1 THEN 'increased' ELSE 'decreased' END AS direction
FROM (SELECT count(*) AS periods, arg_min(pct, publication_year) AS p1, arg_max(pct, publication_year) AS p2 FROM unknown_trend)""",
    "years_analyzed": SER + " SELECT DISTINCT publication_year FROM serious",
    "regions_analyzed": SER + " SELECT DISTINCT birth_region FROM serious",
    "weapon_summary": _WEAPON_SUMMARY,
    "audit_results": _TESTS + """
SELECT 'Geographic Representation' AS analysis_type, printf('%.3f', chi2) AS test_statistic, printf('%.4f', p) AS p_value,
  CASE WHEN p < 1 - 0.95 THEN 'Yes' ELSE 'No' END AS significant, interpretation FROM geo_text
UNION ALL SELECT 'Category Distribution', printf('%.3f', chi2), printf('%.4f', p),
  CASE WHEN p < 1 - 0.95 THEN 'Yes' ELSE 'No' END, 'Category distribution differs from baseline' FROM cat
UNION ALL SELECT 'Case Persistence', printf('%.3f', f), printf('%.4f', p),
  CASE WHEN p < 1 - 0.95 THEN 'Yes' ELSE 'No' END, interpretation FROM an_text""",
    "audit_findings": _TESTS + _trend("features", "crime_family", "publication_year") + f"""
SELECT 1::BIGINT AS position, {_q(K.FINDING_GEO)} AS finding FROM geo WHERE p < 1 - 0.95
UNION ALL SELECT 2, {_q(K.FINDING_CATEGORY)} FROM cat WHERE p < 1 - 0.95
UNION ALL SELECT 3, {_q(K.FINDING_TREND)} WHERE (SELECT count(*) FILTER (p < 1 - 0.95) FROM trend) > 0
UNION ALL SELECT 4, {_q(K.FINDING_PERSISTENCE)} FROM an WHERE p < 1 - 0.95""",
    "audit_badges": _TESTS + _trend("features", "crime_family", "publication_year") + """
SELECT (SELECT CASE WHEN p < 1 - 0.95 THEN 'Detected' ELSE 'Not Detected' END FROM geo) AS geographic_bias,
  (SELECT CASE WHEN p < 1 - 0.95 THEN 'Detected' ELSE 'Not Detected' END FROM cat) AS category_bias,
  (SELECT count(*) FILTER (p < 1 - 0.95) FROM trend) AS significant_trends""",
    "audit_weapon_summary": _WEAPON_SUMMARY,
    "report_summary": F_ + """
SELECT format('{:,}', count(*)) AS total_records, strftime(min(publication_date), '%Y-%m-%d') AS first_date,
  strftime(max(publication_date), '%Y-%m-%d') AS last_date, count(DISTINCT crime_family) AS crime_categories,
  count(DISTINCT birth_state) AS states_represented FROM features""",
    "report_trending": _BY_CUSTOMER + _trend("yearly", "o_custkey", "y0") + """
SELECT g AS crime_family, CASE WHEN r > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
  printf('%.4f', p) AS p_value FROM trend WHERE p < 1 - 0.95""",
    "report_weapon_lines": SER + """
SELECT CASE weapon_category WHEN 'blunt_object' THEN 'Blunt Object' ELSE upper(substr(weapon_category, 1, 1))
  || substr(weapon_category, 2) END AS weapon, count(*) AS n, """ + _shown(
        "100.0 * count(*) / (SELECT count(*) FROM serious)", "percentage") + " FROM serious GROUP BY 1",
    "chart_categories": F_ + _distribution("features", "crime_family", "known"),
    "chart_states": F_ + " SELECT birth_state, count(*) AS n FROM features WHERE birth_state IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15",
    "chart_top_states": F_ + " SELECT * FROM (" + _distribution("features", "birth_state", "all") + ") ORDER BY n DESC, birth_state LIMIT 8",
    "chart_scatter": STATES + f""", line AS (SELECT sum(o) / sum(pop) AS slope, max(pop) AS m FROM represented)
SELECT unit AS birth_state, {_r('pop', 'population_millions')}, {_n('o', 'observed_cases')}, {_r('ratio', 'representation_ratio')},
  {_LABEL} AS label, {_r('slope', 'expected_slope')}, {_r('m', 'line_end_population')}, {_r('m * slope', 'line_end_cases')}
FROM represented, line""",
    "chart_category_proportions": FB + _CATEGORIES + f"""
SELECT w.fam AS crime_family, {_r('w.n / (SELECT sum(n) FROM w)', 'wanted_proportion')},
  {_r('coalesce(b.n / (SELECT sum(n) FROM b), 0)', 'baseline_proportion')} FROM w LEFT JOIN b ON w.fam = b.fam""",
    "chart_persistence_box": F_ + " " + _box("features", "crime_family", "case_age_days"),
    "chart_representation_ratios": STATES + f"""
SELECT unit AS birth_state, {_r('ratio', 'representation_ratio')}, {_n('o', 'observed_cases')}, {_r('e', 'expected_cases')},
  {_LABEL} AS label, 1.0::DOUBLE AS parity, 1.2::DOUBLE AS upper_threshold, 0.8::DOUBLE AS lower_threshold FROM represented""",
    "chart_summary_persistence": F_ + """, shown AS (SELECT * FROM features WHERE crime_family IN (
  SELECT crime_family FROM features GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)) """ + _box("shown", "crime_family", "case_age_days"),
    "chart_summary_states": F_ + " SELECT birth_state, count(*) AS n FROM features WHERE birth_state IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "chart_weapons": SER + " SELECT *, " + _shown("percentage", "percentage_shown") + " FROM (" + _distribution("serious", "weapon_category", "all") + ")",
    "chart_weapons_all": F_ + " SELECT *, " + _shown("percentage", "percentage_shown") + " FROM (" + _distribution("features", "weapon_category", "all") + ")",
    "chart_summary_categories": F_ + _distribution("features", "crime_family", "known"),
    "chart_summary_years": F_ + " SELECT publication_year, count(*) AS n FROM features GROUP BY 1",
    "chart_weapon_comparison": F_ + f"""
SELECT weapon_category, {_r('100.0 * count(*) / (SELECT count(*) FROM features)', 'all_crimes_percentage')},
  {_r('100.0 * count(*) FILTER (severity_flag) / (SELECT count(*) FROM features WHERE severity_flag)', 'serious_crimes_percentage')}
FROM features GROUP BY 1""",
    "chart_weapons_by_year": SER + _grid("serious", "publication_year", "weapon_category", "percentage"),
    "chart_unknown_by_year": SER + f"""
SELECT publication_year, {_r("100.0 * count(*) FILTER (weapon_category = 'unknown') / count(*)", 'percentage')},
  {_shown("100.0 * count(*) FILTER (weapon_category = 'unknown') / count(*)", 'percentage_shown')} FROM serious GROUP BY 1""",
    "chart_weapons_by_region": SER + _grid("serious", "birth_region", "weapon_category", "percentage"),
    "chart_geographic_table": STATES + f" SELECT {_rep_columns('birth_state')}, {_LABEL} AS highlight FROM represented",
    "validation": _REPEATED + """
SELECT 'uid not null' AS rule, count(*) FILTER (uid IS NULL) AS violations FROM repeated
UNION ALL SELECT 'title not null', count(*) FILTER (title IS NULL) FROM repeated
UNION ALL SELECT 'publication_date not null', count(*) FILTER (publication_date IS NULL) FROM repeated
UNION ALL SELECT 'uid is text', 0 FROM (SELECT 1)
UNION ALL SELECT 'publication_date is a date', 0 FROM (SELECT 1)
UNION ALL SELECT 'case_age_days is a whole number', 0 FROM (SELECT 1)
UNION ALL SELECT 'case_age_days >= 10', count(*) FILTER (case_age_days < 10) FROM repeated
UNION ALL SELECT 'uid unique', count(uid) - count(DISTINCT uid) FROM repeated""",
    "validation_text_dates": """
SELECT 'uid not null' AS rule, 0 AS violations FROM (SELECT 1)
UNION ALL SELECT 'comment missing', count(*) FROM orders
UNION ALL SELECT 'publication_date is a date', count(*) FILTER (o_orderkey % 50 = 0) FROM orders
UNION ALL SELECT 'price is a whole number', count(*) FILTER (o_orderkey % 7 = 0 OR (o_orderkey % 7 <> 0 AND o_totalprice <> floor(o_totalprice))) FROM orders
UNION ALL SELECT 'priority is text', 0 FROM (SELECT 1)
UNION ALL SELECT 'customer is text', count(*) FROM orders
UNION ALL SELECT 'price >= 1000', count(*) FILTER (o_orderkey % 7 <> 0 AND o_totalprice < 1000) FROM orders
UNION ALL SELECT 'customer unique', count(*) - count(DISTINCT o_custkey) FROM orders""",
    "year_by_customer": """
SELECT year, o_custkey, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share
FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)""",
    "repeated_keys": _REPEATED + " SELECT uid, count(*) AS n FROM repeated WHERE uid IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "latest_notices": _REPEATED + """
SELECT uid, title, strftime(md, '%Y-%m-%d %H:%M:%S') AS modified_date, case_age_days FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY md DESC) AS rn FROM repeated) WHERE rn = 1 OR uid IS NULL""",
    "distinct_documents": """SELECT lang, CAST(length(text) AS BIGINT) AS n, sha256(text) AS digest
FROM (SELECT DISTINCT text, lang FROM documents)""",
    "document_quality": f"""SELECT count(*) AS records, {_r('(count(text) + count(lang)) / (2.0 * count(*))', 'completeness')},
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates FROM documents""",
    "notice_completeness": "WITH " + NOTICES + ", one AS (SELECT count(*) AS t, " + ", ".join(
        f"count({c}) AS {c}" for c in ["title", "description", "place_of_birth", "reward_text", "n_img"]
    ) + " FROM notices)" + " UNION ALL ".join(
        f" SELECT '{c}' AS column_name, {_r(e + ' / t', 'completeness')} FROM one" for c, e in [
            ("uid", "t"), ("title", "title"), ("description", "description"), ("name", "t"),
            ("place_of_birth", "place_of_birth"), ("aliases", "t"), ("publication_date", "t"), ("modified_date", "t"),
            ("reward_text", "reward_text"), ("images", "n_img"), ("ingestion_date", "t"), ("case_age_days", "t"),
        ]),
    "standardized_documents": r"""SELECT doc_id, sha256(t) AS digest, CAST(length(t) AS BIGINT) AS n
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS t FROM documents)""",
    "standardized_states": "SELECT p_partkey, upper(trim(' ' || p_name || ' ')) AS state FROM part",
    "anonymized_notices": "WITH " + NOTICES + " SELECT uid, sha256(name) AS name, sha256('alias ' || name) AS alias FROM notices",
    "retained_notices": "WITH " + NOTICES + " SELECT uid, case_age_days FROM notices WHERE case_age_days <= 365",
}


def _long(chart: str, sql: str, a: str | None, b: str | None, value: str | None) -> str:
    return (
        f"SELECT '{chart}' AS chart, CAST({a or 'NULL'} AS VARCHAR) AS a, CAST({b or 'NULL'} AS VARCHAR) AS b, n, "
        f"CAST({value or 'NULL'} AS DOUBLE) AS value FROM ({sql})"
    )


def _long_grid(chart: str, source: str, a: str, b: str, share: str | None, value: str | None) -> str:
    return _long(chart, "WITH " + _grid(source, a, b, share).removeprefix(", "), a, b, value)


ORACLES["audit_results_of_batches"] = ORACLES["audit_results"]
ORACLES["charts_from_one_pass"] = SER + " " + " UNION ALL ".join([
    _long_grid("temporal_series", "features", "publication_year", "crime_family", None, None),
    _long_grid("region_by_family", "features", "birth_region", "crime_family", "column", "share"),
    _long_grid("weapon_yearly", "serious", "publication_year", "weapon_category", "percentage", "percentage"),
    _long_grid("weapon_by_region", "serious", "birth_region", "weapon_category", "percentage", "percentage"),
    _long("category_distribution", _distribution("features", "crime_family", "known"), "crime_family", None, "proportion"),
    _long("weapon_distribution", _distribution("serious", "weapon_category", "all"), "weapon_category", None, "percentage"),
    *[_long(chart, f"SELECT {key}, count(*) AS n FROM features WHERE {key} IS NOT NULL GROUP BY 1", key, None, None) for chart, key in (
        ("years", "publication_year"), ("regions", "birth_region"), ("families", "crime_family"))],
    _long("total", "SELECT count(*) AS n FROM features", None, None, None),
])

# Orders in the order of their file.
_PLACED = "placed AS (SELECT o_orderkey, o_custkey, row_number() OVER () AS place FROM orders)"
ORACLES["customers_by_appearance"] = f"""WITH {_PLACED}
SELECT o_custkey, count(*) AS n FROM placed GROUP BY 1 ORDER BY min(place) LIMIT 10"""
ORACLES["chart_summary_persistence_by_appearance"] = F_ + f""", {_PLACED}, shown AS (SELECT * FROM features WHERE crime_family IN (
  SELECT crime_family FROM features JOIN placed ON uid = 'N' || o_orderkey GROUP BY 1 ORDER BY min(place) LIMIT 5)) """ + _box(
    "shown", "crime_family", "case_age_days")
ORACLES["customers_from_sketches"] = """SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n,
  count(DISTINCT o_custkey) AS customers, true AS customers_near, true AS orders_near FROM orders GROUP BY 1"""
