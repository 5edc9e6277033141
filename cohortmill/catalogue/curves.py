"""Binned distributions, box summaries, survival curves, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.catalogue import Tables, query
from cohortmill.catalogue.derived import EVENT_DAY_SQL, event_day
from cohortmill.functions.factors import factor
from cohortmill.functions.missing import na_if
from cohortmill.operators import distributions as D
from cohortmill.operators import survival as K
from cohortmill.operators.joins import left_join
from cohortmill.operators.models import glm
from cohortmill.operators.tables import cross_frequency


def _histogram_sql(source: str, x: str, bins: int, facets: str = "") -> str:
    lead = f"{facets}, " if facets else ""
    return f"""
WITH x AS (SELECT {lead}CASE WHEN {x} IS NOT NULL THEN {x} END AS x FROM {source}),
s AS (SELECT min(x) AS lo, (max(x) - min(x)) / {bins - 1}.0::DOUBLE AS w FROM x),
b AS (SELECT {lead}CAST(greatest(0, least({bins - 1}, ceil((x - lo) / w - 0.5::DOUBLE))) AS INTEGER) AS bin, lo, w FROM x, s WHERE x IS NOT NULL)
SELECT {"f.kind AS kind, " if facets else ""}CAST(g.bin AS INTEGER) AS bin, round(lo + (g.bin - 0.5::DOUBLE) * w, 8) AS lower, round(lo + (g.bin + 0.5::DOUBLE) * w, 8) AS upper,
       (SELECT count(*) FROM b WHERE b.bin = g.bin{" AND b.kind IS NOT DISTINCT FROM f.kind" if facets else ""}) AS n
FROM (SELECT unnest(range({bins})) AS bin) g, s{", (SELECT DISTINCT kind FROM b) f" if facets else ""}"""


def _edges(df):
    return df.withColumns({"lower": F.round("lower", 8), "upper": F.round("upper", 8)})


@query("hist_linear", _histogram_sql("orders", "o_totalprice", 20))
def hist_linear(t: Tables):
    return _edges(D.histogram(t.orders, "o_totalprice", 20))


LOG_VALUE = "CASE WHEN event_id % 7 <> 0 AND value > 0 THEN log10(value) END"


@query("hist_log10", _histogram_sql("events", LOG_VALUE, 30))
def hist_log10(t: Tables):
    value = F.when(F.col("event_id") % 7 != 0, F.col("value")).otherwise(0.0)
    return _edges(D.histogram(t.events, value, 30, log10=True))


@query("hist_faceted", _histogram_sql("(SELECT *, nullif(event_type, 'error') AS kind FROM events)", LOG_VALUE, 30, "kind"))
def hist_faceted(t: Tables):
    value = F.when(F.col("event_id") % 7 != 0, F.col("value")).otherwise(0.0)
    x = t.events.select(na_if("event_type", "error").alias("kind"), value.alias("value"))
    return _edges(D.histogram(x, "value", 30, ["kind"], log10=True))


@query("log_axis_dropped", "SELECT count(*) FILTER (WHERE c_acctbal <= 0) AS n_dropped FROM customer")
def log_axis_dropped(t: Tables):
    return D.dropped_by_log(t.customer, "c_acctbal")


# A third of the values are NaN or infinite; both dialects make them from the same rule.
ODD_SQL = "CASE event_id % 9 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE ELSE value END"


def _odd_value():
    case = F.col("event_id") % 9
    odd = F.when(case == 0, F.lit(float("nan"))).when(case == 1, F.lit(float("inf"))).when(case == 2, F.lit(float("-inf")))
    return F.coalesce(odd, F.col("value"))


@query("hist_not_finite", _histogram_sql("events", f"CASE WHEN isfinite({ODD_SQL}) THEN value END", 12))
def hist_not_finite(t: Tables):
    return _edges(D.histogram(t.events, _odd_value(), 12))


@query("hist_log10_not_finite", _histogram_sql("events", f"CASE WHEN isfinite({ODD_SQL}) AND value > 0 THEN log10(value) END", 12))
def hist_log10_not_finite(t: Tables):
    return _edges(D.histogram(t.events, _odd_value(), 12, log10=True))


POINTS = 64


@query(
    "kde_binned",
    f"""
WITH s AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd,
                  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
p AS (SELECT n, lo, (hi - lo) / {POINTS - 1} AS step, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS bw FROM s),
a AS (SELECT least(floor((value - lo) / step), {POINTS - 2}) AS node, (value - lo) / step AS pos FROM events, p),
w AS (SELECT node, sum(1 - (pos - node)) AS w FROM a GROUP BY node UNION ALL SELECT node + 1, sum(pos - node) FROM a GROUP BY node),
v AS (SELECT node, sum(w) AS w FROM w GROUP BY node),
g AS (SELECT unnest(range({POINTS})) AS grid)
SELECT CAST(grid AS INTEGER) AS grid, round(lo + grid * step, 6) AS x,
       round(sum(w * exp(-0.5 * pow((grid - node) * step / bw, 2))) / (bw * sqrt(2 * pi())), 4) AS y
FROM v, g, p GROUP BY grid, lo, step, bw""",
)
def kde_binned(t: Tables):
    curve = D.density_curve(t.events, "value", POINTS)
    return curve.select("grid", F.round("x", 6).alias("x"), F.round("y", 4).alias("y"))


@query(
    "kde_constant",
    f"""
WITH p AS (SELECT count(*) AS n, 0.9 * 5 * pow(count(*), -0.2) AS bw FROM events WHERE event_id % 9 > 2),
g AS (SELECT unnest(range(9)) AS grid)
SELECT CAST(grid AS INTEGER) AS grid, round(5 - 3 * bw + grid * 6 * bw / 8, 6) AS x, round(n * exp(-0.5 * pow((grid - 4) * 6 / 8.0, 2)) / (bw * sqrt(2 * pi())), 4) AS y FROM g, p""",
)
def kde_constant(t: Tables):
    """The curve of one value, NaN and infinite ones left out."""
    value = F.when(_odd_value() == F.col("value"), 5.0).otherwise(_odd_value())
    return D.density_curve(t.events, value, 9).select("grid", F.round("x", 6).alias("x"), F.round("y", 4).alias("y"))


@query(
    "box_summary",
    """
WITH x AS (SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS line, l_extendedprice * l_extendedprice / 1000 AS v FROM lineitem),
q AS (SELECT l_returnflag, line, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3, count(*) AS n FROM x GROUP BY ALL)
SELECT l_returnflag, line, n, round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), 4) AS whisker_low, round(q1, 4) AS q1, round(median, 4) AS median,
       round(q3, 4) AS q3, round(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), 4) AS whisker_high,
       count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM x JOIN q USING (l_returnflag, line) GROUP BY l_returnflag, line, n, q1, median, q3""",
)
def box_summary(t: Tables):
    x = t.lineitem.select(
        "l_returnflag",
        F.col("l_linenumber").cast("string").alias("line"),
        (F.col("l_extendedprice") * F.col("l_extendedprice") / 1000).alias("v"),
    )
    table = D.box_summary(x, "v", ["l_returnflag", "line"])
    return table.withColumns({c: F.round(c, 4) for c in ("whisker_low", "q1", "median", "q3", "whisker_high")})


@query("bar_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def bar_counts(t: Tables):
    return D.bar_counts(t.part, "p_type")


INPUT_SQL = f"""
SELECT DISTINCT user_id, {EVENT_DAY_SQL} AS time, CASE WHEN kind = 'purchase' THEN 1 WHEN kind <> 'purchase' THEN 0 END AS event,
       user_id % 3 AS arm
FROM (SELECT *, nullif(event_type, 'error') AS kind FROM events) WHERE kind IS NOT NULL"""


def _input(t: Tables):
    x = t.events.select(
        "user_id", event_day().alias("day"), na_if("event_type", "error").alias("kind"), (F.col("user_id") % 3).alias("arm")
    )
    return K.survival_input(x, ["user_id"], "day", "kind", "purchase", ["arm"])


@query("km_input", INPUT_SQL)
def km_input(t: Tables):
    return _input(t)


@query(
    "event_by_time",
    f"""
SELECT time, count(*) FILTER (WHERE event = 0) AS "0", count(*) FILTER (WHERE event = 1) AS "1" FROM ({INPUT_SQL}) GROUP BY time""",
)
def event_by_time(t: Tables):
    return cross_frequency(_input(t), "time", "event", [0, 1])


def _km_sql(by: str = "") -> str:
    lead, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""
c AS (SELECT {lead}CAST(time AS DOUBLE) AS time, CAST(sum(event) AS BIGINT) AS n_event, CAST(sum(1 - event) AS BIGINT) AS n_censor
      FROM i WHERE time < 50 GROUP BY ALL),
r AS (SELECT *, CAST(sum(n_event + n_censor) OVER ({part}ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n_risk FROM c),
k AS (SELECT *, product(1 - n_event / n_risk) OVER ({part}ORDER BY time ROWS UNBOUNDED PRECEDING) AS s,
             sum(CASE WHEN n_risk > n_event THEN n_event / (CAST(n_risk AS DOUBLE) * (n_risk - n_event)) END) OVER ({part}ORDER BY time ROWS UNBOUNDED PRECEDING) AS v FROM r)"""


KM_COLUMNS = """time, n_risk, n_event, n_censor, round(s, 8) AS surv, CASE WHEN s > 0 THEN round(s * sqrt(v), 8) END AS std_err,
       CASE WHEN s > 0 THEN round(exp(ln(s) - 1.959963984540054 * sqrt(v)), 8) END AS lower,
       CASE WHEN s > 0 THEN round(least(1.0, exp(ln(s) + 1.959963984540054 * sqrt(v))), 8) END AS upper"""


def _rounded(curve):
    return curve.withColumns({c: F.round(c, 8) for c in ("surv", "std_err", "lower", "upper")})


@query("km_overall", f"WITH i AS ({INPUT_SQL}), {_km_sql()} SELECT {KM_COLUMNS} FROM k")
def km_overall(t: Tables):
    return _rounded(K.kaplan_meier(_input(t).filter("time < 50"), "time", "event"))


@query("km_by_group", f"WITH i AS ({INPUT_SQL}), {_km_sql('arm')} SELECT arm, {KM_COLUMNS} FROM k")
def km_by_group(t: Tables):
    return _rounded(K.kaplan_meier(_input(t).filter("time < 50"), "time", "event", ["arm"]))


@query(
    "km_time_to_event",
    f"""
WITH u AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' AND value > 150 THEN {EVENT_DAY_SQL} END) AS d, max({EVENT_DAY_SQL}) AS l FROM events GROUP BY user_id),
i AS (SELECT coalesce(d, l) AS time, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS event FROM u), {_km_sql()}
SELECT {KM_COLUMNS} FROM k""",
)
def km_time_to_event(t: Tables):
    hit = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    u = t.events.groupBy("user_id").agg(F.min(F.when(hit, event_day())).alias("d"), F.max(event_day()).alias("l"))
    return _rounded(K.kaplan_meier(u, F.coalesce("d", "l"), F.col("d").isNotNull()))


FINE_SQL = _km_sql("arm").replace("i WHERE time < 50", "i")


@query(
    "km_fine_times",
    f"""
WITH i AS (SELECT event_id % 4 AS arm, round(value, 1) AS time, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS event FROM events), {FINE_SQL}
SELECT arm, {KM_COLUMNS} FROM k""",
)
def km_fine_times(t: Tables):
    x = t.events.select((F.col("event_id") % 4).alias("arm"), F.round("value", 1).alias("time"), F.col("event_type") == "purchase")
    return _rounded(K.kaplan_meier(x.toDF("arm", "time", "event"), "time", "event", ["arm"], block_width=20))


@query(
    "km_odd_times",
    f"""
WITH i AS (SELECT event_id % 4 AS arm, round(value, 1) AS time, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS event FROM events WHERE event_id % 9 > 0), {FINE_SQL}
SELECT arm, {KM_COLUMNS} FROM k""",
)
def km_odd_times(t: Tables):
    """Times that are NaN are missing; the curves are taken over ranges of time."""
    time = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.round("value", 1))
    x = t.events.select((F.col("event_id") % 4).alias("arm"), time, F.col("event_type") == "purchase")
    return _rounded(K.kaplan_meier(x.toDF("arm", "time", "event"), "time", "event", ["arm"]))


TIMES = [0, 7, 14, 21, 28, 42]


@query(
    "km_risk_table",
    f"""
WITH i AS ({INPUT_SQL}), t AS (SELECT unnest({TIMES}) AS mark)
SELECT arm, CAST(mark AS DOUBLE) AS time, count(*) FILTER (WHERE time >= mark) AS n_risk, count(*) FILTER (WHERE time <= mark AND event = 1) AS cum_event,
       printf('%d (%d)', count(*) FILTER (WHERE time >= mark), count(*) FILTER (WHERE time <= mark AND event = 1)) AS label
FROM i, t GROUP BY arm, mark""",
)
def km_risk_table(t: Tables):
    return K.risk_table(_input(t), "time", "event", TIMES, ["arm"])


@query(
    "km_survival_at",
    f"WITH i AS ({INPUT_SQL}), {_km_sql('arm')} SELECT arm, 20.0::DOUBLE AS time, round(arg_max(s, time) FILTER (WHERE time <= 20), 8) AS surv FROM k GROUP BY arm",
)
def km_survival_at(t: Tables):
    curve = K.kaplan_meier(_input(t).filter("time < 50"), "time", "event", ["arm"])
    return K.survival_at(curve, 20, ["arm"]).withColumn("surv", F.round("surv", 8))


# With three groups the covariance of two of them is inverted by hand, and a chi-square of two degrees has a closed tail.
LOG_RANK_SQL = f"""
WITH i AS ({INPUT_SQL}),
c AS (SELECT time, arm, sum(event)::DOUBLE AS d, count(*)::DOUBLE AS m FROM i GROUP BY time, arm),
t AS (SELECT time, sum(d) AS d, {", ".join(f"sum(CASE WHEN arm = {g} THEN d ELSE 0 END) AS d{g}, sum(CASE WHEN arm = {g} THEN m ELSE 0 END) AS m{g}" for g in range(3))} FROM c GROUP BY time),
r AS (SELECT *, {", ".join(f"sum(m{g}) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n{g}" for g in range(3))} FROM t),
w AS (SELECT *, n0 + n1 + n2 AS n, CASE WHEN n0 + n1 + n2 > 1 THEN d * (n0 + n1 + n2 - d) / (n0 + n1 + n2 - 1) ELSE 0 END AS w FROM r),
s AS (SELECT sum(d0 - d * n0 / n) AS z0, sum(d1 - d * n1 / n) AS z1, sum(w * n0 / n * (1 - n0 / n)) AS a, sum(-w * n0 / n * n1 / n) AS b,
             sum(w * n1 / n * (1 - n1 / n)) AS e FROM w),
x AS (SELECT (z0 * z0 * e - 2 * z0 * z1 * b + z1 * z1 * a) / (a * e - b * b) AS chi FROM s)
SELECT round(chi, 6) AS chi_square, 2::INT AS degrees, round(exp(-chi / 2), 8) AS p_value FROM x"""


@query("km_logrank", LOG_RANK_SQL)
def km_logrank(t: Tables):
    return K.log_rank(_input(t), "time", "event", "arm").withColumns({"chi_square": F.round("chi_square", 6), "p_value": F.round("p_value", 8)})


# With one two-level factor and one number, least squares has a closed form: the slope from
# the deviations within levels, then the level means.
GLM_SQL = """
WITH x AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'M' END AS sex, c_acctbal / 1000 AS age, o_totalprice / 1000 AS y
           FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT sex, avg(age) AS ma, avg(y) AS my, count(*) AS n FROM x GROUP BY sex),
w AS (SELECT sum((age - ma) * (y - my)) AS sxy, sum((age - ma) * (age - ma)) AS sxx FROM x JOIN g USING (sex)),
c AS (SELECT sxy / sxx AS slope, sxx, f.my - sxy / sxx * f.ma AS a, (m.my - sxy / sxx * m.ma) - (f.my - sxy / sxx * f.ma) AS b,
             f.ma AS fa, m.ma AS mma, f.n AS fn, m.n AS mn FROM w, (SELECT * FROM g WHERE sex = 'F') f, (SELECT * FROM g WHERE sex = 'M') m),
e AS (SELECT sum(power(y - a - CASE WHEN sex = 'M' THEN b ELSE 0 END - slope * age, 2)) / (count(*) - 3) AS s2 FROM x, c),
r AS (SELECT 'age' AS term, slope AS estimate, sqrt(s2 / sxx) AS std_error FROM c, e
      UNION ALL SELECT 'sex_M', b, sqrt(s2 * (1.0 / fn + 1.0 / mn + power(fa - mma, 2) / sxx)) FROM c, e
      UNION ALL SELECT '(Intercept)', a, sqrt(s2 * (1.0 / fn + power(fa, 2) / sxx)) FROM c, e)
SELECT term, round(estimate, 5) AS estimate, round(std_error, 5) AS std_error, round(estimate / std_error, 4) AS statistic FROM r"""


@query("glm_fit", GLM_SQL)
def glm_fit(t: Tables):
    x = left_join(t.orders, t.customer, [("o_custkey", "c_custkey")], na_match=False)
    x = x.select(
        F.when(F.col("o_orderstatus") == "F", "F").otherwise("M").alias("sex"),
        (F.col("c_acctbal") / 1000).alias("age"),
        (F.col("o_totalprice") / 1000).alias("y"),
    )
    fit = glm(x, "y ~ sex + age")
    return fit.select(
        "term",
        F.round("estimate", 5).alias("estimate"),
        F.round("std_error", 5).alias("std_error"),
        F.round("statistic", 4).alias("statistic"),
    )


# With one two-level factor the log odds are those of the counts.
LOGIT_SQL = """
WITH x AS (SELECT o_orderstatus = 'F' AS f, o_totalprice > 250000 AS y FROM orders),
n AS (SELECT count(*) FILTER (WHERE f AND y)::DOUBLE AS f1, count(*) FILTER (WHERE f AND NOT y)::DOUBLE AS f0,
             count(*) FILTER (WHERE NOT f AND y)::DOUBLE AS m1, count(*) FILTER (WHERE NOT f AND NOT y)::DOUBLE AS m0 FROM x),
r AS (SELECT '(Intercept)' AS term, ln(f1 / f0) AS estimate, sqrt(1 / f1 + 1 / f0) AS std_error FROM n
      UNION ALL SELECT 'sex_M', ln(m1 / m0) - ln(f1 / f0), sqrt(1 / m1 + 1 / m0 + 1 / f1 + 1 / f0) FROM n)
SELECT term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error FROM r"""


@query("glm_fit_binomial_two_level", LOGIT_SQL)
def glm_fit_binomial_two_level(t: Tables):
    x = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", "F").otherwise("M").alias("sex"),
        F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0).alias("recurrence"),
    )
    fit = glm(x, "recurrence ~ sex", "binomial")
    return fit.select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))


@query("glm_fit_factor", LOGIT_SQL.replace("sex_M", "sex_other"))
def glm_fit_factor(t: Tables):
    """Declared levels give the indicator columns, and the fit works on the counted patterns."""
    x = factor(t.orders, "o_orderstatus", ["F"], missing="other").withColumnRenamed("o_orderstatus", "sex")
    x = x.select("sex", F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0).alias("recurrence"))
    fit = glm(x, "recurrence ~ sex", "binomial")
    return fit.select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))


@query("glm_fit_binomial", None)
def glm_fit_binomial(t: Tables):
    x = left_join(t.orders, t.customer, [("o_custkey", "c_custkey")], na_match=False)
    x = x.select(
        F.col("c_mktsegment").alias("sex"),
        (F.col("c_acctbal") / 1000).alias("age"),
        F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0).alias("recurrence"),
    )
    return glm(x, "recurrence ~ sex + age", "binomial")
