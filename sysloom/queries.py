"""The engine's queries over the given tables, and the SQL that checks them.

Each query applies one operator to series that Spark derives from the tables (see ``sources.series``): ``h``, hourly values of
every event type with gaps; ``d``, daily shipments of every return flag; ``s``, those of every supplier; ``u``, the events of every
user; ``l``, the lines of every return flag one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sysloom.functions import scalars
from sysloom.operators import affine, arx, cleaning, delay, linear, pivots, profile, quantiles, ranks, regressor, scans, selection
from sysloom.operators.keep import kept, spread
from sysloom.operators.regressor import Structure
from sysloom.plans import ablation, cleanup, study
from sysloom.sources import catalogue, csv, sinks
from sysloom.sources.series import daily, hourly, per_user, supplied, table
from sysloom.streaming import monitor

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

H = """ev AS (SELECT event_type AS series_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0) AS BIGINT) AS t,
 CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS v, count(*) AS n FROM events GROUP BY 1, 2),
grid AS (SELECT series_id, unnest(generate_series((SELECT min(t) FROM ev), (SELECT max(t) FROM ev))) AS t FROM (SELECT DISTINCT event_type AS series_id FROM events)),
h AS (SELECT g.series_id, CAST(g.t AS BIGINT) AS t, e.v, CAST(coalesce(e.n, 0) AS DOUBLE) AS n FROM grid g LEFT JOIN ev e ON g.series_id = e.series_id AND g.t = e.t)"""
D = """days AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS DECIMAL(24,6))) AS DOUBLE) AS q,
 CAST(count(*) AS DOUBLE) AS c, CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS DOUBLE) AS p FROM lineitem GROUP BY 1, 2),
d AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS t, round((q - avg(q) OVER (PARTITION BY series_id)) / 10.0, 4) AS u1,
 round((c - avg(c) OVER (PARTITION BY series_id)) / 10.0, 4) AS u2, round((p - avg(p) OVER (PARTITION BY series_id)) / 100000.0, 4) AS y FROM days)"""
U = """u AS (SELECT user_id AS series_id, event_id AS ord, CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) AS ts, value AS v FROM events)"""
# rows of the ARX regressor of d with one output lag and one lag of each input
X = D + """,
lags AS (SELECT *, -lag(y) OVER w AS a1, lag(u1, 0) OVER w AS b_u1_0, lag(u2, 0) OVER w AS b_u2_0 FROM d WINDOW w AS (PARTITION BY series_id ORDER BY t)),
x AS (SELECT series_id, t, y AS target, a1, b_u1_0, b_u2_0, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS row FROM lags WHERE a1 IS NOT NULL)"""
ONE = Structure.of(["u1", "u2"], 1, 1)
# windows of 60 rows every 30 over x
HELD = X + """,
n AS (SELECT series_id, max(row) + 1 AS n FROM x GROUP BY 1),
k AS (SELECT series_id, unnest(generate_series(0, CAST(floor((n - 60) / 30.0) AS BIGINT))) AS win FROM n WHERE n >= 60),
held AS (SELECT x.*, k.win, d.u1, d.u2, d.y FROM k JOIN x ON x.series_id = k.series_id AND x.row >= k.win * 30 AND x.row < k.win * 30 + 60 JOIN d ON d.series_id = x.series_id AND d.t = x.t)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = "WITH " + sql if not sql.lstrip().upper().startswith(("SELECT", "WITH")) else sql
        return f

    return add


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def with_windows(spark, sf) -> DataFrame:
    d = daily(spark, sf)
    rows = regressor.regressor(d, ONE).join(d, ["series_id", "t"])
    return regressor.window_rows(rows, 60, 30)


def noise(spark, sf) -> DataFrame:
    return profile.noise_sigma(daily(spark, sf), "y")


def quality(spark, sf) -> DataFrame:
    return regressor.window_quality(with_windows(spark, sf), ["u1", "u2"], "y", noise(spark, sf))


# ---- profile ----------------------------------------------------------------------------------------
query("agg_missing", H + " SELECT series_id, count(*) AS n_rows, count(*) - count(v) AS n_missing, round((count(*) - count(v)) / count(*), 6) AS missing_rate FROM h GROUP BY 1")(
    lambda s, f: rounded(profile.missing(hourly(s, f)), 6, "missing_rate")
)
query("agg_longest_missing_run", H + """, m AS (SELECT *, sum(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t) AS run FROM h),
l AS (SELECT series_id, run, count(*) - count(v) AS n FROM m GROUP BY 1, 2) SELECT series_id, max(n) AS longest_missing_run FROM l GROUP BY 1""")(
    lambda s, f: scans.longest_missing_run(hourly(s, f))
)
query("agg_column_stats", H + """ SELECT series_id, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max,
 round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75 FROM h GROUP BY 1""")(
    lambda s, f: profile.statistics(hourly(s, f), places=4)
)
BOUNDS = """b AS (SELECT series_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM h GROUP BY 1),
o AS (SELECT h.*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM h JOIN b ON h.series_id = b.series_id)"""
query("agg_iqr_anomalies", H + ", " + BOUNDS + " SELECT series_id, count(*) FILTER (WHERE v < lo OR v > hi) AS n_anomalies FROM o GROUP BY 1")(lambda s, f: profile.iqr_anomalies(hourly(s, f)))
query("agg_frozen_segments", H + """, m AS (SELECT *, lag(n) OVER (PARTITION BY series_id ORDER BY t) AS p FROM h),
r AS (SELECT *, sum(CASE WHEN p = n THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY t) AS run FROM m)
SELECT series_id, min(t) AS start, max(t) AS stop, count(*) AS length FROM r GROUP BY series_id, run HAVING count(*) >= 5""")(
    lambda s, f: scans.frozen_segments(hourly(s, f), "n")
)
query("agg_constant_columns", H + " SELECT series_id, coalesce(max(v) - min(v) <= 1e-8, false) AS is_constant FROM h GROUP BY 1")(lambda s, f: profile.constant(hourly(s, f)))
STEPS = U + """, s0 AS (SELECT series_id, CAST(ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ord) AS DOUBLE) AS step FROM u),
s AS (SELECT * FROM s0 WHERE step IS NOT NULL), p AS (SELECT series_id, quantile_cont(step, 0.5) AS period FROM s WHERE step > 0 GROUP BY 1)"""
query("agg_irregular_rate", STEPS + """ SELECT s.series_id, round(max(period), 6) AS period, round(avg(CASE WHEN coalesce(step <= 0 OR abs(step - period) > greatest(0.05 * period, 1e-6), true) THEN 1.0 ELSE 0.0 END), 6) AS irregular_rate
FROM s LEFT JOIN p ON s.series_id = p.series_id GROUP BY 1""")(lambda s, f: rounded(profile.irregular_rate(per_user(s, f)), 6, "period", "irregular_rate"))
query("agg_duplicate_timestamps", U + " SELECT series_id, count(*) - count(DISTINCT ts) AS n_duplicates FROM u GROUP BY 1")(lambda s, f: profile.duplicate_timestamps(per_user(s, f)))
query("agg_interval_histogram", STEPS + """, g AS (SELECT series_id, min(step) AS lo, max(step) AS hi, CASE WHEN max(step) - min(step) <= 1e-8 THEN 1 ELSE least(12, greatest(2, CAST(floor(sqrt(count(*))) AS BIGINT))) END AS k FROM s GROUP BY 1),
z AS (SELECT s.series_id, step, lo, (hi - lo) / k AS width, CAST(CASE WHEN k = 1 THEN 0 ELSE least(k - 1, floor((step - lo) / ((hi - lo) / k))) END AS INTEGER) AS bin FROM s JOIN g ON s.series_id = g.series_id)
SELECT series_id, bin, max(round(lo + (bin + 0.5) * width, 6)) AS midpoint, count(*) AS n FROM z GROUP BY 1, 2""")(lambda s, f: profile.interval_histogram(per_user(s, f)))


def profile_sql(source: str, at: str, order: str, second: str) -> str:
    return f"""r0 AS (SELECT series_id, v, {at} AS a, row_number() OVER w AS i, CAST({at} - lag({at}) OVER w AS DOUBLE) AS step, CASE WHEN coalesce(abs(v - lag(v) OVER w) <= greatest(1e-9 * greatest(abs(v), abs(lag(v) OVER w)), 1e-12), false) THEN 0 ELSE 1 END AS fresh
 FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY {order})),
r1 AS (SELECT *, i - max(CASE WHEN fresh = 1 THEN i END) OVER o + 1 AS held, i - coalesce(max(CASE WHEN v IS NOT NULL THEN i END) OVER o, 0) AS gone FROM r0 WINDOW o AS (PARTITION BY series_id ORDER BY i)),
md AS (SELECT series_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, count(v) AS m, quantile_cont(step, 0.5) FILTER (WHERE step > 0) AS period FROM r1 GROUP BY 1),
pf AS (SELECT r1.series_id, count(*) AS n_rows, count(*) - count(v) AS n_missing, (count(*) - count(v)) / count(*) AS missing_rate, max(CASE WHEN v IS NULL THEN gone ELSE 0 END) AS longest_missing_run,
 count(*) FILTER (WHERE m >= 4 AND q3 - q1 > 1e-8 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))) AS n_anomalies, count(*) FILTER (WHERE v IS NOT NULL AND held = 5) AS n_frozen, coalesce(max(v) - min(v) <= 1e-8, false) AS is_constant,
 count(*) - count(DISTINCT a) AS n_duplicates, coalesce(avg(CASE WHEN step IS NULL THEN NULL WHEN coalesce(step <= 0 OR abs(step - period) > greatest(0.05 * period, 1e-6), true) THEN 1.0 ELSE 0.0 END), 0) AS irregular_rate, max(period) / {second} AS sample_period_seconds,
 min(a) AS time_start, max(a) AS time_end, greatest(1, CAST(ceil(count(*) / 10000.0) AS BIGINT)) AS downsample_factor, avg(v) AS mean, CASE WHEN count(v) = 1 THEN 0.0 ELSE stddev_samp(v) END AS std, min(v) AS min, max(q1) AS q25, max(q2) AS q50, max(q3) AS q75, max(v) AS max
 FROM r1 JOIN md ON md.series_id = r1.series_id GROUP BY 1),
sf AS (SELECT *, greatest(0, 100 - least(45, 200 * missing_rate) - least(20, 30 * irregular_rate) - least(15, 100.0 * n_duplicates / n_rows) - least(10, 100.0 * n_anomalies / greatest(n_rows - n_missing, 1)) - least(10, 2.0 * n_frozen)) AS score FROM pf)"""


PARTS_OF = ["missing_rate", "irregular_rate", "sample_period_seconds", "mean", "std", "min", "q25", "q50", "q75", "max", "score"]
WHOLE_OF = ["n_rows", "n_missing", "longest_missing_run", "n_anomalies", "n_frozen", "is_constant", "n_duplicates", "time_start", "time_end", "downsample_factor"]
PROFILE_OUT = " SELECT series_id, " + ", ".join([*WHOLE_OF, *(f"round({c}, 4) AS {c}" for c in PARTS_OF)]) + " FROM sf"
OF_USERS = {"at": "ts", "order": "ord", "second": 1 / 60}
query("agg_quality_profile", H + ", " + profile_sql("h", "t", "t", "1.0") + PROFILE_OUT)(lambda s, f: rounded(profile.quality_profile(hourly(s, f)), 4, *PARTS_OF))
query("agg_quality_profile_users", U + ", " + profile_sql("u", "ts", "ord", "(1.0 / 60)") + PROFILE_OUT)(lambda s, f: rounded(profile.quality_profile(per_user(s, f), **OF_USERS), 4, *PARTS_OF))
FAULTS = {"MISSING_VALUES": ("warning", "n_missing > 0"), "DUPLICATE_TIMESTAMPS": ("warning", "n_duplicates > 0"), "IRREGULAR_SAMPLING": ("warning", "irregular_rate > 0.01"), "FROZEN_SEGMENTS": ("warning", "n_frozen > 0"), "IQR_ANOMALIES": ("info", "n_anomalies > 0")}
query("agg_issues", U + ", " + profile_sql("u", "ts", "ord", "(1.0 / 60)") + " " + " UNION ALL ".join(f"SELECT series_id, '{k}' AS issue, '{level}' AS severity FROM sf WHERE {c}" for k, (level, c) in FAULTS.items()))(
    lambda s, f: profile.issues(profile.quality_profile(per_user(s, f), **OF_USERS))
)
ADVICE = {"interpolate": "n_missing > 0", "resample": "sample_period_seconds IS NOT NULL AND irregular_rate > 0.01", "settle_duplicates": "n_duplicates > 0", "mark_frozen": "n_frozen > 0", "review_anomalies": "n_anomalies > 0"}
query("agg_recommendations", U + ", " + profile_sql("u", "ts", "ord", "(1.0 / 60)") + ", st AS (" + " UNION ALL ".join(f"SELECT series_id, {i} AS k, '{k}' AS step FROM sf WHERE {c}" for i, (k, c) in enumerate(ADVICE.items())) + """)
SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY k) - 1 AS INTEGER) AS place, step FROM st UNION ALL SELECT series_id, 0, 'proceed' FROM sf WHERE series_id NOT IN (SELECT series_id FROM st)""")(
    lambda s, f: profile.recommendations(profile.quality_profile(per_user(s, f), **OF_USERS))
)
query("agg_duplicate_collapse", U + " SELECT series_id, ts, round(avg(v), 6) AS mean, arg_min(v, ord) AS first, count(*) AS n_rows FROM u GROUP BY 1, 2")(
    lambda s, f: rounded(profile.collapse_duplicates(per_user(s, f)), 6, "mean")
)
query("agg_resample_grid", U + """, g AS (SELECT series_id, min(ts) AS t0, max(ts) AS t1 FROM u GROUP BY 1),
b AS (SELECT u.series_id, CAST(floor((ts - t0) / 360.0 + 0.5) AS BIGINT) AS step, avg(v) AS mean FROM u JOIN g ON u.series_id = g.series_id GROUP BY 1, 2),
e AS (SELECT series_id, unnest(generate_series(0, CAST(floor((t1 - t0) / 360.0 + 1e-9) AS BIGINT))) AS step FROM g)
SELECT e.series_id, e.step, round(b.mean, 6) AS mean FROM e LEFT JOIN b ON e.series_id = b.series_id AND e.step = b.step""")(lambda s, f: rounded(profile.resample(per_user(s, f), 360), 6, "mean"))
S = """sd AS (SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS DECIMAL(24,6))) AS DOUBLE) AS u1, CAST(count(*) AS DOUBLE) AS u2, CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS DOUBLE) / 1000 AS y FROM lineitem GROUP BY 1, 2),
s AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS t, u1, u2, y FROM sd)"""
PRINTS = S + """, fl AS (SELECT *, lag(u1) OVER w AS p1, lag(u2) OVER w AS p2, lag(y) OVER w AS py, y - 2 * lag(y) OVER w + lag(y, 2) OVER w AS sec FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)),
fa AS (SELECT series_id, quantile_cont(y, 0.5) AS med, quantile_cont(sec, 0.5) AS cen, count(*) AS m, var_pop(y) AS pw, avg(u1) AS m1, avg(u2) AS m2, avg(y) AS my, 0.05 * quantile_cont(abs(u1 - p1), 0.95) AS s1, 0.05 * quantile_cont(abs(u2 - p2), 0.95) AS s2 FROM fl GROUP BY 1),
fb AS (SELECT fl.series_id, quantile_cont(abs(y - med), 0.5) AS mad, quantile_cont(abs(sec - cen), 0.5) AS nad FROM fl JOIN fa ON fa.series_id = fl.series_id GROUP BY 1),
fc AS (SELECT fl.series_id, max(m) AS m, max(pw) AS pw, max(nad) AS nad, count(*) FILTER (WHERE mad > 0 AND abs(y - med) > 3 * 1.4826 * mad) AS odd, sum((y - my) * (py - my)) / sum((y - my) * (y - my)) AS ry, sum((u1 - m1) * (p1 - m1)) / sum((u1 - m1) * (u1 - m1)) AS r1,
 CASE WHEN sum((u2 - m2) * (u2 - m2)) > 0 THEN sum((u2 - m2) * (p2 - m2)) / sum((u2 - m2) * (u2 - m2)) ELSE 0 END AS r2, CASE WHEN max(s1) > 0 THEN count(*) FILTER (WHERE abs(u1 - p1) > s1) / count(p1) ELSE 0 END AS d1, CASE WHEN max(s2) > 0 THEN count(*) FILTER (WHERE abs(u2 - p2) > s2) / count(p2) ELSE 0 END AS d2,
 coalesce(abs(corr(u1, u2)), 0) AS c FROM fl JOIN fa ON fa.series_id = fl.series_id JOIN fb ON fb.series_id = fl.series_id GROUP BY 1),
fp AS (SELECT series_id, log10(m) / 6 AS f0, 0.25 AS f1, 0.0 AS f2, CASE WHEN m >= 8 THEN odd / m ELSE 0 END AS f3, CASE WHEN nad > 0 AND pw > 0 THEN least(1, greatest(0, 10 * log10(pw / pow(1.4826 * nad / sqrt(6), 2)) / 60)) ELSE 1 END AS f4, (d1 + d2) / 2 AS f5, ry AS f6, (r1 + r2) / 2 AS f7, least(1, c) AS f8 FROM fc)"""
query("agg_fingerprint", PRINTS + " " + " UNION ALL ".join(f"SELECT series_id, '{k}' AS feature, round(f{i}, 6) AS value FROM fp" for i, k in enumerate(profile.FEATURES)))(
    lambda s, f: profile.fingerprint(supplied(s, f), ["u1", "u2"], "y").select("series_id", F.posexplode("features").alias("i", "value")).select("series_id", F.get(F.array(*[F.lit(k) for k in profile.FEATURES]), F.col("i")).alias("feature"), F.round("value", 6).alias("value"))
)
query("agg_experiment_summary", """SELECT o_orderpriority AS strategy, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(stddev_pop(o_totalprice), 2) AS std, round(quantile_cont(o_totalprice, 0.5), 2) AS median, max(o_totalprice) AS worst FROM orders GROUP BY 1""")(
    lambda s, f: table(s, f, "orders").groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 2).alias("std"), F.round(F.percentile("o_totalprice", F.lit(0.5)), 2).alias("median"), F.max("o_totalprice").alias("worst"))
)


@query("agg_win_counts", """m AS (SELECT o_orderstatus AS cell, month(o_orderdate) AS m, o_orderpriority AS strategy, sum(CAST(o_totalprice AS DECIMAL(24,2))) AS v FROM orders GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY cell, m ORDER BY v, strategy) AS k FROM m) SELECT strategy, count(*) AS wins FROM r WHERE k = 1 GROUP BY 1""")
def win_counts(spark, sf):
    """How often each strategy has the least value in a cell."""
    cells = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("cell"), F.month("o_orderdate").alias("m"), F.col("o_orderpriority").alias("strategy")).agg(F.sum(F.col("o_totalprice").cast("decimal(24,2)")).alias("v"))
    best = cells.groupBy("cell", "m").agg(F.min(F.struct("v", "strategy"))["strategy"].alias("strategy"))
    return best.groupBy("strategy").agg(F.count("*").alias("wins"))


query("agg_metric_spread", "SELECT o_orderstatus AS cell, round(max(o_totalprice) - min(o_totalprice), 2) AS one_step, CAST(max(day(o_orderdate)) - min(day(o_orderdate)) AS BIGINT) AS free_run, round((max(day(o_orderdate)) - min(day(o_orderdate))) / (max(o_totalprice) - min(o_totalprice)), 9) AS ratio FROM orders GROUP BY 1")(
    lambda s, f: rounded(rounded(ablation.discrimination(table(s, f, "orders").select(F.col("o_orderstatus").alias("cell"), F.col("o_totalprice").alias("one_step_fit"), F.dayofmonth("o_orderdate").cast("long").alias("free_run_fit")), "cell"), 2, "one_step"), 9, "ratio")
)
query("agg_gram", X + """ SELECT series_id, i, j, round(value, 4) AS value FROM (
SELECT series_id, 0 AS i, 0 AS j, sum(a1 * a1) AS value FROM x GROUP BY 1 UNION ALL SELECT series_id, 0, 1, sum(a1 * b_u1_0) FROM x GROUP BY 1 UNION ALL SELECT series_id, 0, 2, sum(a1 * b_u2_0) FROM x GROUP BY 1
UNION ALL SELECT series_id, 1, 1, sum(b_u1_0 * b_u1_0) FROM x GROUP BY 1 UNION ALL SELECT series_id, 1, 2, sum(b_u1_0 * b_u2_0) FROM x GROUP BY 1 UNION ALL SELECT series_id, 2, 2, sum(b_u2_0 * b_u2_0) FROM x GROUP BY 1)""")(
    lambda s, f: rounded(linear.gram(regressor.regressor(daily(s, f), ONE), ONE.features), 4, "value")
)

# ---- windows ----------------------------------------------------------------------------------------
query("win_lag_matrix", X + " SELECT series_id, t, target, a1, b_u1_0, b_u2_0, row FROM x")(lambda s, f: regressor.regressor(daily(s, f), ONE))
GAPS = H + """, g AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i, count(*) OVER (PARTITION BY series_id) AS c FROM h),
e AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY series_id ORDER BY i) AS pi, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM g),
f AS (SELECT e.*, p.v AS pv, q.v AS nv, coalesce(e.ni, e.c + 1) - coalesce(e.pi, 0) - 1 AS gap FROM e LEFT JOIN g p ON p.series_id = e.series_id AND p.i = e.pi LEFT JOIN g q ON q.series_id = e.series_id AND q.i = e.ni)"""
for _m, _fill in (("linear", "pv + (nv - pv) * (i - pi) / (ni - pi)"), ("ffill", "pv"), ("bfill", "nv")):
    query(f"win_interpolate_{_m}", GAPS + f" SELECT series_id, t, round(CASE WHEN v IS NOT NULL THEN v WHEN gap <= 3 THEN {_fill} END, 6) AS filled FROM f")(
        lambda s, f, m=_m: cleaning.interpolate(hourly(s, f), m, 3).select("series_id", "t", F.round("filled", 6).alias("filled"))
    )
HAMPEL = H + """, w AS (SELECT a.series_id, a.t, a.v, median(b.v) AS m, count(b.v) AS c FROM h a JOIN h b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 3 AND a.t + 3 GROUP BY 1, 2, 3),
k AS (SELECT w.series_id, w.t, w.v, w.m, w.c, median(abs(b.v - w.m)) AS mad FROM w JOIN h b ON w.series_id = b.series_id AND b.t BETWEEN w.t - 3 AND w.t + 3 GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT *, coalesce(c >= 3 AND CASE WHEN mad = 0 THEN abs(v - m) > greatest(1e-9 * greatest(abs(v), abs(m)), 1e-12) ELSE abs(v - m) > 3 * 1.4826 * mad END, false) AS outlier FROM k)"""
query("win_hampel_clean", HAMPEL + " SELECT series_id, t, outlier, round(m, 6) AS local_median FROM o")(lambda s, f: cleaning.hampel(hourly(s, f)).select("series_id", "t", "outlier", F.round("local_median", 6).alias("local_median")))
query("win_hampel_gate", H + """, i AS (SELECT series_id, t, n, unnest(generate_series(-5, 5)) AS o FROM h),
p AS (SELECT i.series_id, i.t, i.n, b.n AS x FROM i JOIN h b ON b.series_id = i.series_id AND b.t = least((SELECT max(t) FROM ev), greatest((SELECT min(t) FROM ev), i.t + i.o))),
m AS (SELECT series_id, t, n, median(x) AS m FROM p GROUP BY 1, 2, 3), k AS (SELECT p.series_id, p.t, p.n, m.m, median(abs(p.x - m.m)) AS mad FROM p JOIN m ON m.series_id = p.series_id AND m.t = p.t GROUP BY 1, 2, 3, 4)
SELECT series_id, t, mad > 0 AND abs(n - m) > 3 * 1.4826 * mad AS anomaly FROM k""")(lambda s, f: cleaning.hampel_gate(hourly(s, f), value="n").select("series_id", "t", "anomaly"))
query("win_iqr_detect", H + ", " + BOUNDS + " SELECT series_id, t, coalesce(v < lo OR v > hi, false) AS outlier FROM o")(lambda s, f: cleaning.global_outliers(hourly(s, f)).select("series_id", "t", "outlier"))
query("win_zscore_detect", H + """, b AS (SELECT series_id, avg(v) AS mu, stddev_samp(v) AS sd FROM h GROUP BY 1) SELECT h.series_id, t, coalesce(v < mu - 2 * sd OR v > mu + 2 * sd, false) AS outlier FROM h JOIN b ON h.series_id = b.series_id""")(
    lambda s, f: cleaning.global_outliers(hourly(s, f), "z_score", 2.0).select("series_id", "t", "outlier")
)
query("win_treat_clip", H + ", " + BOUNDS + " SELECT series_id, t, round(CASE WHEN v < lo OR v > hi THEN least(greatest(v, lo), hi) ELSE v END, 6) AS treated FROM o")(
    lambda s, f: cleaning.treat(cleaning.global_outliers(hourly(s, f)), "clip").select("series_id", "t", F.round("treated", 6).alias("treated"))
)
query("win_treat_set_null", H + ", " + BOUNDS + " SELECT series_id, t, round(CASE WHEN coalesce(v < lo OR v > hi, false) THEN NULL ELSE v END, 6) AS treated FROM o")(
    lambda s, f: cleaning.treat(cleaning.global_outliers(hourly(s, f)), "set_null").select("series_id", "t", F.round("treated", 6).alias("treated"))
)
query("win_treat_local_median", HAMPEL + " SELECT series_id, t, round(CASE WHEN outlier THEN m ELSE v END, 6) AS treated FROM o")(
    lambda s, f: cleaning.treat(cleaning.hampel(hourly(s, f)), "local_median").select("series_id", "t", F.round("treated", 6).alias("treated"))
)


def filled_sql(name: str, source: str, value: str, limit: int) -> str:
    """Gaps of ``value`` filled by lines over at most ``limit`` steps."""
    return f"""{name}g AS (SELECT series_id, t, v AS v0, {value} AS x, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i, count(*) OVER (PARTITION BY series_id) AS c FROM {source}),
{name}e AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY series_id ORDER BY i) AS pi, min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM {name}g),
{name} AS (SELECT e.series_id, e.t, e.v0 AS v, CASE WHEN e.x IS NOT NULL THEN e.x WHEN coalesce(e.ni, e.c + 1) - coalesce(e.pi, 0) - 1 <= {limit} THEN p.x + (q.x - p.x) * (e.i - e.pi) / (e.ni - e.pi) END AS filled FROM {name}e e LEFT JOIN {name}g p ON p.series_id = e.series_id AND p.i = e.pi LEFT JOIN {name}g q ON q.series_id = e.series_id AND q.i = e.ni)"""


CLEAN = H + ", " + filled_sql("c1", "h", "v", 10) + """,
cw AS (SELECT a.series_id, a.t, a.v, a.filled, median(b.filled) AS m, count(b.filled) AS c FROM c1 a JOIN c1 b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 3 AND a.t + 3 GROUP BY 1, 2, 3, 4),
ck AS (SELECT w.series_id, w.t, w.v, w.filled, w.m, w.c, median(abs(b.filled - w.m)) AS mad FROM cw w JOIN c1 b ON w.series_id = b.series_id AND b.t BETWEEN w.t - 3 AND w.t + 3 GROUP BY 1, 2, 3, 4, 5, 6),
co AS (SELECT *, coalesce(c >= 3 AND CASE WHEN mad = 0 THEN abs(filled - m) > greatest(1e-9 * greatest(abs(filled), abs(m)), 1e-12) ELSE abs(filled - m) > 3 * 1.4826 * mad END, false) AS outlier FROM ck),
""" + filled_sql("c2", "co", "CASE WHEN NOT outlier THEN filled END", 10)
query("win_clean_series", CLEAN + " SELECT c2.series_id, c2.t, round(c2.filled, 6) AS cleaned, outlier, c2.filled IS DISTINCT FROM c2.v AS changed FROM c2 JOIN co ON co.series_id = c2.series_id AND co.t = c2.t")(
    lambda s, f: cleaning.clean(hourly(s, f)).select("series_id", "t", F.round("cleaned", 6).alias("cleaned"), "outlier", "changed")
)


def clean_sql(source: str) -> str:
    """Lines over gaps, centred medians, lines again and a moving mean over ``source`` (series_id, t, v), with the mask of each cell."""
    return filled_sql("p1", source, "v", 10) + """,
pw AS (SELECT a.series_id, a.t, a.v, a.filled, median(b.filled) AS m, count(b.filled) AS c FROM p1 a JOIN p1 b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 3 AND a.t + 3 GROUP BY 1, 2, 3, 4),
pk AS (SELECT w.series_id, w.t, w.v, w.filled, w.m, w.c, median(abs(b.filled - w.m)) AS mad FROM pw w JOIN p1 b ON w.series_id = b.series_id AND b.t BETWEEN w.t - 3 AND w.t + 3 GROUP BY 1, 2, 3, 4, 5, 6),
po AS (SELECT *, coalesce(c >= 3 AND CASE WHEN mad = 0 THEN abs(filled - m) > greatest(1e-9 * greatest(abs(filled), abs(m)), 1e-12) ELSE abs(filled - m) > 3 * 1.4826 * mad END, false) AS outlier FROM pk),
""" + filled_sql("p2", "po", "CASE WHEN NOT outlier THEN filled END", 10) + """,
ps AS (SELECT po.series_id, po.t, po.v, po.filled AS one, po.outlier, p2.filled AS two, avg(p2.filled) OVER s AS mean, count(p2.filled) OVER s AS near FROM p2 JOIN po ON po.series_id = p2.series_id AND po.t = p2.t WINDOW s AS (PARTITION BY po.series_id ORDER BY po.t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
pm AS (SELECT *, two IS NOT NULL AND near >= 3 AND abs(mean - two) > greatest(1e-12 * greatest(abs(mean), abs(two)), 1e-12) AS moved FROM ps),
cleaned AS (SELECT series_id, t, v, CASE WHEN moved THEN mean ELSE two END AS cleaned, CAST(CASE WHEN v IS NULL AND one IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN outlier THEN 2 ELSE 0 END
 + CASE WHEN outlier OR (one IS NULL AND two IS NOT NULL) THEN 4 ELSE 0 END + CASE WHEN moved THEN 8 ELSE 0 END AS INTEGER) AS mask FROM pm)"""


SMOOTH = cleanup.Cleaning(smoothing="moving_average")
PER_USER = cleanup.Cleaning(smoothing="moving_average", period=360.0)
query("win_clean_full", U + """, u1 AS (SELECT series_id, ts, avg(v) AS v FROM u GROUP BY 1, 2), t0 AS (SELECT series_id, min(ts) AS lo, CAST(floor((max(ts) - min(ts)) / 360.0 + 1e-9) AS BIGINT) AS n FROM u GROUP BY 1),
u2 AS (SELECT u1.series_id, CAST(floor((ts - lo) / 360.0 + 0.5) AS BIGINT) AS t, avg(v) AS v FROM u1 JOIN t0 ON t0.series_id = u1.series_id GROUP BY 1, 2),
u3 AS (SELECT g.series_id, g.t, u2.v FROM (SELECT series_id, unnest(generate_series(0, n)) AS t FROM t0) g LEFT JOIN u2 ON u2.series_id = g.series_id AND u2.t = g.t),
""" + clean_sql("u3") + " SELECT series_id, t AS i, round(cleaned + 1e-9, 5) AS cleaned, mask FROM cleaned")(  # the nudge keeps halves from falling either way
    lambda s, f: cleanup.cleaned(per_user(s, f), ["v"], PER_USER).select("series_id", "i", F.round(F.col("v") + 1e-9, 5).alias("cleaned"), F.col("v__mask").alias("mask"))
)
query("win_clean_summary", H + ", " + clean_sql("h") + """ SELECT series_id, CAST(0 AS BIGINT) AS n_duplicates, 'v' AS "column", count(*) FILTER (WHERE mask & 1 > 0) AS n_filled, count(*) FILTER (WHERE mask & 2 > 0) AS n_outliers, count(*) FILTER (WHERE mask & 4 > 0) AS n_treated,
 count(*) FILTER (WHERE mask & 8 > 0) AS n_smoothed, count(*) FILTER (WHERE mask & 13 > 0) AS n_changed, count(*) - count(cleaned) AS n_missing FROM cleaned GROUP BY 1""")(
    lambda s, f: cleanup.summary(cleanup.cleaned(hourly(s, f).withColumn("ord", F.col("t")), ["v"], SMOOTH, at="t"), ["v"])
)
query("win_fill_by_scan", GAPS + " SELECT series_id, t, round(CASE WHEN v IS NOT NULL THEN v ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 6) AS filled FROM f")(
    lambda s, f: scans.fill(hourly(s, f), ["v"]).select("series_id", "t", F.round("v", 6).alias("filled"))
)
query("win_moving_average", H + """, w AS (SELECT *, avg(v) OVER o AS a, count(v) OVER o AS c FROM h WINDOW o AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT series_id, t, round(CASE WHEN v IS NULL THEN NULL WHEN c >= 3 THEN a ELSE v END, 6) AS smoothed FROM w""")(lambda s, f: cleaning.moving_average(hourly(s, f)).select("series_id", "t", F.round("smoothed", 6).alias("smoothed")))
query("win_savitzky_golay", H + """, p AS (SELECT a.series_id, a.t, a.v, CAST(b.t - a.t AS DOUBLE) AS k, b.v AS x FROM h a JOIN h b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 2 AND a.t + 2 AND b.v IS NOT NULL),
s AS (SELECT series_id, t, v, CAST(count(*) AS DOUBLE) AS s0, sum(k) AS s1, sum(k*k) AS s2, sum(k*k*k) AS s3, sum(k*k*k*k) AS s4, sum(x) AS b0, sum(k*x) AS b1, sum(k*k*x) AS b2 FROM p GROUP BY 1, 2, 3),
q AS (SELECT series_id, t, CASE WHEN v IS NULL THEN NULL WHEN s0 >= 3 THEN (b0*(s2*s4-s3*s3) - s1*(b1*s4-s3*b2) + s2*(b1*s3-s2*b2)) / nullif(s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2), 0) ELSE v END AS z FROM s)
SELECT h.series_id, h.t, round(q.z, 4) AS smoothed FROM h LEFT JOIN q ON q.series_id = h.series_id AND q.t = h.t""")(lambda s, f: cleaning.savitzky_golay(hourly(s, f)).select("series_id", "t", F.round("smoothed", 4).alias("smoothed")))
NOISE = """z AS (SELECT series_id, y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w AS s FROM d WINDOW w AS (PARTITION BY series_id ORDER BY t)), zc AS (SELECT series_id, quantile_cont(s, 0.5) AS c FROM z GROUP BY 1),
ns AS (SELECT z.series_id, 1.4826 * quantile_cont(abs(s - c), 0.5) / sqrt(6) AS noise_sigma FROM z JOIN zc ON z.series_id = zc.series_id GROUP BY 1)"""
query("win_noise_sigma", D + ", " + NOISE + " SELECT series_id, round(noise_sigma, 6) AS noise_sigma FROM ns")(lambda s, f: rounded(noise(s, f), 6, "noise_sigma"))
query("win_window_grid", HELD + """ SELECT series_id, win AS "window", min(t) AS start, max(t) AS stop, count(*) AS n_rows FROM held GROUP BY 1, 2""")(
    lambda s, f: with_windows(s, f).groupBy("series_id", "window").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("n_rows"))
)
QUALITY = HELD + ", " + NOISE + """,
ch AS (SELECT *, pow(u1 - lag(u1) OVER w, 2) AS du1, pow(u2 - lag(u2) OVER w, 2) AS du2, pow(y - lag(y) OVER w, 2) AS dy, u1 - lag(u1) OVER w AS su1, u2 - lag(u2) OVER w AS su2, y - lag(y) OVER w AS sy FROM held WINDOW w AS (PARTITION BY series_id, win ORDER BY t)),
qu AS (SELECT ch.series_id, win, min(t) AS start, max(t) AS stop, count(*) AS n_rows, avg(du1) + avg(du2) AS input_activity, avg(dy) AS output_activity, 10 * log10(var_pop(y) / pow(max(noise_sigma), 2)) AS snr_db,
 greatest(abs(corr(su1, sy)), abs(corr(su2, sy))) AS association FROM ch JOIN ns ON ns.series_id = ch.series_id GROUP BY 1, 2)"""
query("win_window_quality", QUALITY + """ SELECT series_id, win AS "window", start, stop, n_rows, round(input_activity, 4) AS input_activity, round(output_activity, 4) AS output_activity, round(snr_db, 4) AS snr_db FROM qu""")(
    lambda s, f: rounded(quality(s, f).select("series_id", "window", "start", "stop", "n_rows", "input_activity", "output_activity", "snr_db"), 4, "input_activity", "output_activity", "snr_db")
)
query("win_activity_reference", QUALITY + " SELECT series_id, round(quantile_cont(input_activity, 0.95), 4) AS reference FROM qu WHERE input_activity > 0 GROUP BY 1")(lambda s, f: rounded(regressor.activity_reference(quality(s, f)), 4, "reference"))
GATES = QUALITY + """, rf AS (SELECT series_id, quantile_cont(input_activity, 0.95) AS ref FROM qu WHERE input_activity > 0 GROUP BY 1),
ga AS (SELECT qu.*, snr_db < 5 AS r1, input_activity < 0.5 * ref AS r2 FROM qu JOIN rf ON rf.series_id = qu.series_id)"""
STRICT = regressor.Gate(snr_db=5.0, activity=0.5)
query("win_gate", GATES + """ SELECT series_id, win AS "window", concat_ws(',', CASE WHEN r1 THEN 'snr_below_threshold' END, CASE WHEN r2 THEN 'steady_state_segment' END) AS reasons, NOT (r1 OR r2) AS accepted FROM ga""")(
    lambda s, f: regressor.gated(quality(s, f), STRICT).select("series_id", "window", F.array_join("reasons", ",").alias("reasons"), "accepted")
)
query("agg_rejections", GATES + """ SELECT series_id, reason, count(*) AS n FROM (SELECT series_id, 'snr_below_threshold' AS reason FROM ga WHERE r1 UNION ALL SELECT series_id, 'steady_state_segment' FROM ga WHERE r2) GROUP BY 1, 2""")(
    lambda s, f: regressor.rejections(regressor.gated(quality(s, f), STRICT))
)
#: hours of every event type with values (gaps) and counts, and one series whose input never moves
G = H + """, hh AS (SELECT series_id, t, v AS u, n AS y FROM h UNION ALL SELECT 'idle', t, 1.0, n FROM h WHERE series_id = 'view'),
hr AS (SELECT *, t - min(t) OVER (PARTITION BY series_id) AS row, count(*) OVER (PARTITION BY series_id) AS n FROM hh), lim AS (SELECT min(t) AS lo, max(t) AS hi FROM hh),
fr AS (SELECT a.series_id, a.t, a.u, a.y, b.u AS bu, b.y AS b_y FROM (SELECT *, unnest(generate_series(-5, 5)) AS o FROM hh) a JOIN hh b ON b.series_id = a.series_id AND b.t = least((SELECT hi FROM lim), greatest((SELECT lo FROM lim), a.t + a.o))),
fm AS (SELECT series_id, t, median(bu) AS mu, median(b_y) AS my FROM fr GROUP BY 1, 2),
fd AS (SELECT fr.series_id, fr.t, median(abs(bu - mu)) AS du, median(abs(b_y - my)) AS dy FROM fr JOIN fm ON fm.series_id = fr.series_id AND fm.t = fr.t GROUP BY 1, 2),
an AS (SELECT hr.*, coalesce(du > 0 AND abs(u - mu) > 3 * 1.4826 * du, false) AS xu, coalesce(dy > 0 AND abs(y - my) > 3 * 1.4826 * dy, false) AS xy FROM hr JOIN fm ON fm.series_id = hr.series_id AND fm.t = hr.t JOIN fd ON fd.series_id = hr.series_id AND fd.t = hr.t),
wk AS (SELECT *, unnest(generate_series(0, CAST(floor((n - 60) / 30.0) AS BIGINT))) AS win FROM an), wh AS (SELECT * FROM wk WHERE row >= win * 30 AND row < win * 30 + 60),
nu AS (SELECT series_id, win, pow(u - lag(u) OVER (PARTITION BY series_id, win ORDER BY t), 2) AS s FROM wh WHERE u IS NOT NULL), au AS (SELECT series_id, win, avg(s) AS a FROM nu GROUP BY 1, 2),
z2 AS (SELECT series_id, y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w AS s FROM hh WINDOW w AS (PARTITION BY series_id ORDER BY t)), zc AS (SELECT series_id, median(s) AS c FROM z2 GROUP BY 1),
ns AS (SELECT z2.series_id, 1.4826 * median(abs(s - c)) / sqrt(6) AS noise_sigma FROM z2 JOIN zc ON zc.series_id = z2.series_id GROUP BY 1),
qu AS (SELECT wh.series_id, wh.win, (count(*) - count(u) + count(*) - count(y)) / (2.0 * count(*)) AS missing_ratio, (count(*) FILTER (WHERE xu) + count(*) FILTER (WHERE xy)) / (2.0 * count(*)) AS anomaly_ratio, coalesce(max(a), 0) AS input_activity,
 CASE WHEN var_pop(y) <= 0 THEN '-inf'::DOUBLE ELSE 10 * log10(var_pop(y) / pow(max(noise_sigma), 2)) END AS snr_db FROM wh JOIN ns ON ns.series_id = wh.series_id LEFT JOIN au ON au.series_id = wh.series_id AND au.win = wh.win GROUP BY 1, 2),
rf AS (SELECT series_id, coalesce(quantile_cont(input_activity, 0.95) FILTER (WHERE input_activity > 0), 0) AS ref FROM qu GROUP BY 1),
ga AS (SELECT qu.series_id, win, missing_ratio, anomaly_ratio, missing_ratio > 0.04 AS r1, anomaly_ratio > 0.03 AS r2, snr_db < 0.5 AS r3, ref > 0 AND input_activity < 0.4 * ref AS r4, ref <= 0 AS r5 FROM qu JOIN rf ON rf.series_id = qu.series_id)"""
LIMITS = regressor.Gate(missing=0.04, anomalies=0.03, snr_db=0.5, activity=0.4)


def gates(spark, sf) -> DataFrame:
    h = hourly(spark, sf).select("series_id", "t", F.col("v").alias("u"), F.col("n").alias("y"))
    h = h.unionByName(h.filter("series_id = 'view'").select(F.lit("idle").alias("series_id"), "t", F.lit(1.0).alias("u"), "y"))
    start = h.groupBy("series_id").agg(F.min("t").alias("lo"))
    rows = h.join(start, "series_id").select("series_id", "t", (F.col("t") - F.col("lo")).alias("row"))
    return regressor.gate_windows(h, rows, ["u"], "y", 60, 30, LIMITS)


REASONS = ["missing_ratio_exceeded", "anomaly_ratio_exceeded", "snr_below_threshold", "steady_state_segment", "no_input_excitation"]
query("win_gate_anomalies", G + """ SELECT series_id, win AS "window", round(missing_ratio, 6) AS missing_ratio, round(anomaly_ratio, 6) AS anomaly_ratio, concat_ws(',', """ + ", ".join(f"CASE WHEN r{i + 1} THEN '{k}' END" for i, k in enumerate(REASONS)) + """) AS reasons, NOT (r1 OR r2 OR r3 OR r4 OR r5) AS accepted FROM ga""")(
    lambda s, f: rounded(gates(s, f).select("series_id", "window", "missing_ratio", "anomaly_ratio", F.array_join("reasons", ",").alias("reasons"), "accepted"), 6, "missing_ratio", "anomaly_ratio")
)
query("agg_rejections_all", G + " SELECT series_id, reason, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT series_id, '{k}' AS reason FROM ga WHERE r{i + 1}" for i, k in enumerate(REASONS)) + ") GROUP BY 1, 2")(
    lambda s, f: regressor.rejections(gates(s, f))
)
SCORES = QUALITY + """, en AS (SELECT series_id, quantile_cont(input_activity, 0.05) AS l1, quantile_cont(input_activity, 0.95) AS h1, quantile_cont(output_activity, 0.05) AS l2, quantile_cont(output_activity, 0.95) AS h2,
 quantile_cont(snr_db, 0.05) AS l3, quantile_cont(snr_db, 0.95) AS h3, quantile_cont(association, 0.05) AS l4, quantile_cont(association, 0.95) AS h4 FROM qu GROUP BY 1),
nm AS (SELECT qu.series_id, win, least(1, greatest(0, (input_activity - l1) / (h1 - l1))) AS e, least(1, greatest(0, (output_activity - l2) / (h2 - l2))) AS o, least(1, greatest(0, (snr_db - l3) / (h3 - l3))) AS s, least(1, greatest(0, (association - l4) / (h4 - l4))) AS a FROM qu JOIN en ON en.series_id = qu.series_id),
sc AS (SELECT series_id, win, 0.25 * e + 0.2 * o + 0.2 * s + 0.2 * a + 0.15 * 0.5 - 0.2 * (1 - e) AS score FROM nm)"""


def weighted(spark, sf):
    return regressor.weighted_scores(with_windows(spark, sf), quality(spark, sf), ["u1", "u2"], "y")


query("win_weighted_score", SCORES + """ SELECT series_id, win AS "window", round(score, 4) AS score FROM sc""")(lambda s, f: rounded(weighted(s, f), 4, "score"))
query("srt_weighted_topk", SCORES + """ SELECT series_id, win AS "window", k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, win) AS k FROM sc) WHERE k <= 10""")(
    lambda s, f: regressor.ranked(weighted(s, f), budget=10).select("series_id", "window", "rank")
)
query("srt_energy_topk", QUALITY + """ SELECT series_id, win AS "window", k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY input_activity DESC, win) AS k FROM qu) WHERE k <= 10""")(
    lambda s, f: regressor.ranked(quality(s, f), "input_activity", budget=10).select("series_id", "window", "rank")
)
query("srt_recommendation", QUALITY + """, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY input_activity DESC, win) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM qu)
SELECT series_id, win AS "window", CASE WHEN k <= greatest(1, floor(n / 3)) THEN 'strongly_recommended' WHEN k <= greatest(2, floor(2 * n / 3)) THEN 'recommended' ELSE 'review' END AS advice FROM r""")(
    lambda s, f: regressor.ranked(quality(s, f), "input_activity").select("series_id", "window", regressor.recommendation(F.col("rank"), F.count("*").over(Window.partitionBy("series_id"))).alias("advice"))
)


def greedy_sql(steps: int) -> str:
    """Windows taken one by one by the determinant of the information they add up to, a table a step."""
    sums = ["aa", "ab", "ac", "bb", "bc", "cc"]
    of = dict(zip(sums, ["a1 * a1", "a1 * b_u1_0", "a1 * b_u2_0", "b_u1_0 * b_u1_0", "b_u1_0 * b_u2_0", "b_u2_0 * b_u2_0"], strict=True))
    det = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"
    out = HELD + ", gm AS (SELECT series_id, win, " + ", ".join(f"sum({of[k]}) AS {k}" for k in sums) + " FROM held GROUP BY 1, 2), g0 AS (SELECT DISTINCT series_id, CAST([] AS BIGINT[]) AS chosen, CAST(NULL AS BIGINT) AS win, ln(1e-18) AS level, ln(1e-18) AS before, " + ", ".join(f"{'1e-6' if k[0] == k[1] else '0.0'} AS {k}" for k in sums) + " FROM gm)"
    for i in range(1, steps + 1):
        out += f", j{i} AS (SELECT s.series_id, s.chosen, g.win, s.level AS before, " + ", ".join(f"s.{k} + g.{k} AS {k}" for k in sums) + f" FROM g{i - 1} s JOIN gm g ON g.series_id = s.series_id AND NOT list_contains(s.chosen, g.win))"
        out += f", g{i} AS (SELECT series_id, list_append(chosen, win) AS chosen, win, level, before, {', '.join(sums)} FROM (SELECT *, ln({det}) AS level, row_number() OVER (PARTITION BY series_id ORDER BY {det} DESC, win) AS k FROM j{i}) WHERE k = 1)"
    return out + ", best AS (" + " UNION ALL ".join(f"SELECT series_id, win, {i} AS rank, level, before FROM g{i}" for i in range(1, steps + 1)) + ")"


GREEDY = greedy_sql(10)
query("srt_d_optimal", GREEDY + """ SELECT series_id, win AS "window", rank, round((level - before) / ln(2), 3) AS gain_bits, round(level, 3) AS log_det FROM best WHERE level > before""")(
    lambda s, f: rounded(selection.informative_windows(with_windows(s, f), ONE.features), 3, "gain_bits", "log_det").drop("looked", "speedup")
)
query("srt_lazy_speedup")(lambda s, f: selection.informative_windows(with_windows(s, f), ONE.features).groupBy("series_id").agg(F.max("looked").alias("looked"), F.round(F.max("speedup"), 4).alias("speedup")))


@query("set_selected_rows", GREEDY + """ SELECT DISTINCT held.series_id, t, "row" FROM held JOIN best ON best.series_id = held.series_id AND best.win = held.win""")
def selected_rows(spark, sf):
    """Distinct rows of the windows chosen by information."""
    held = kept(with_windows(spark, sf))
    chosen = selection.informative_windows(held, ONE.features)
    return held.join(chosen, ["series_id", "window"], "left_semi").select("series_id", "t", "row").distinct()


LEVEL = "ln((sum(a1 * a1) + 1e-6) * ((sum(b_u1_0 * b_u1_0) + 1e-6) * (sum(b_u2_0 * b_u2_0) + 1e-6) - pow(sum(b_u1_0 * b_u2_0), 2)) - sum(a1 * b_u1_0) * (sum(a1 * b_u1_0) * (sum(b_u2_0 * b_u2_0) + 1e-6) - sum(b_u1_0 * b_u2_0) * sum(a1 * b_u2_0)) + sum(a1 * b_u2_0) * (sum(a1 * b_u1_0) * sum(b_u1_0 * b_u2_0) - (sum(b_u1_0 * b_u1_0) + 1e-6) * sum(a1 * b_u2_0)))"


@query("srt_selection_metrics", GREEDY + f""", ra AS (SELECT DISTINCT series_id, "row", a1, b_u1_0, b_u2_0 FROM held), rc AS (SELECT DISTINCT h.series_id, "row", a1, b_u1_0, b_u2_0 FROM held h JOIN best ON best.series_id = h.series_id AND best.win = h.win),
la AS (SELECT series_id, count(*) AS n, {LEVEL} AS level FROM ra GROUP BY 1), lc AS (SELECT series_id, count(*) AS n, {LEVEL} AS level FROM rc GROUP BY 1), nb AS (SELECT series_id, count(*) AS m FROM best GROUP BY 1)
SELECT la.series_id, round(lc.n / la.n, 4) AS coverage, round(lc.level / la.level, 4) AS retention, m < 3 AS too_few FROM la JOIN lc ON lc.series_id = la.series_id JOIN nb ON nb.series_id = la.series_id""")
def selection_metrics(spark, sf):
    """Share of all rows and of all information that the chosen windows keep, and whether they are too few (under three)."""
    held = kept(with_windows(spark, sf))
    rows = held.select("series_id", "row", *ONE.features).distinct()
    best = kept(selection.informative_windows(held, ONE.features))
    chosen = held.join(best, ["series_id", "window"], "left_semi").select("series_id", "row", *ONE.features).distinct()
    level = lambda r, n: linear.excitation(linear.gram(r, ONE.features), ONE.features, 1e-6).select("series_id", F.col("log_det").alias(n))
    counts = rows.groupBy("series_id").agg(F.count("*").alias("n")).join(chosen.groupBy("series_id").agg(F.count("*").alias("m")), "series_id")
    few = best.groupBy("series_id").agg((F.count("*") < 3).alias("too_few"))
    out = counts.join(level(rows, "full"), "series_id").join(level(chosen, "kept"), "series_id").join(few, "series_id")
    return out.select("series_id", F.round(F.col("m") / F.col("n"), 4).alias("coverage"), F.round(F.col("kept") / F.col("full"), 4).alias("retention"), "too_few")


LAGS, LONG = 20, 40
CURVE = D + ", l AS (SELECT series_id, y, " + ", ".join(f"lag(u1, {k}) OVER w AS k{k}" for k in range(LAGS + 1)) + " FROM d WINDOW w AS (PARTITION BY series_id ORDER BY t)), c AS (" + " UNION ALL ".join(f"SELECT series_id, {k} AS lag, corr(k{k}, y) AS r FROM l GROUP BY 1" for k in range(LAGS + 1)) + ")"
query("win_cross_correlation", CURVE + " SELECT series_id, lag, round(r, 6) AS r FROM c")(lambda s, f: rounded(delay.cross_correlation(daily(s, f), "u1", "y"), 6, "r"))
query("win_local_peaks", CURVE + """, m AS (SELECT *, lag(abs(r)) OVER w AS a, lead(abs(r)) OVER w AS b FROM c WINDOW w AS (PARTITION BY series_id ORDER BY lag)), n AS (SELECT series_id, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(r) DESC, lag) AS rank FROM m WHERE abs(r) > 0 AND abs(r) >= coalesce(a, -1) AND abs(r) >= coalesce(b, -1))
SELECT p.series_id, lag, round(r, 6) AS r, round(least(1, abs(r) * sqrt(n) / 1.96 / 3), 6) AS confidence, rank FROM p JOIN n ON n.series_id = p.series_id WHERE rank <= 3""")(
    lambda s, f: rounded(delay.peaks(delay.cross_correlation(daily(s, f), "u1", "y"), daily(s, f).groupBy("series_id").agg(F.count("*").alias("n"))), 6, "r", "confidence")
)


def residuals(spark, sf) -> DataFrame:
    """What least squares on two regressors leaves of the target."""
    rows = regressor.regressor(daily(spark, sf), ONE)
    two = ["b_u1_0", "b_u2_0"]
    return arx.predicted(rows, linear.least_squares(rows, two), two).select("series_id", "t", (F.col("target") - F.col("predicted")).alias("e"))


# two centred regressors, so Cramer's rule on sums solves the normal equations
OLS2 = X + """, m AS (SELECT series_id, count(*) AS n, sum(b_u1_0 * b_u1_0) AS p, sum(b_u1_0 * b_u2_0) AS q, sum(b_u2_0 * b_u2_0) AS r, sum(b_u1_0 * target) AS c, sum(b_u2_0 * target) AS e FROM x GROUP BY 1)"""
ACF = OLS2 + ", re AS (SELECT x.series_id, t, target - b_u1_0 * (c * r - q * e) / (p * r - q * q) - b_u2_0 * (p * e - q * c) / (p * r - q * q) AS e FROM x JOIN m ON m.series_id = x.series_id), rc AS (SELECT series_id, t, e - avg(e) OVER (PARTITION BY series_id) AS c FROM re), l AS (SELECT series_id, c, " + ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(LONG + 1)) + " FROM rc WINDOW w AS (PARTITION BY series_id ORDER BY t)), a AS (" + " UNION ALL ".join(f"SELECT series_id, {k} AS lag, sum(c * c{k}) / sum(c * c) AS acf, count(*) AS n FROM l GROUP BY 1" for k in range(LONG + 1)) + ")"
query("win_autocorrelation", ACF + " SELECT series_id, lag, round(acf, 6) AS acf, n FROM a")(lambda s, f: rounded(arx.autocorrelation(residuals(s, f), "e", LONG), 6, "acf"))
query("win_whiteness", ACF + f" SELECT series_id, round(avg(CASE WHEN abs(acf) <= 1.96 / sqrt(n) THEN 1.0 ELSE 0.0 END), 6) AS whiteness FROM a WHERE lag BETWEEN 1 AND {LAGS} GROUP BY 1")(lambda s, f: rounded(arx.whiteness(arx.autocorrelation(residuals(s, f), "e", LAGS)), 6, "whiteness"))
query("win_best_so_far", """SELECT o_orderpriority AS study, o_orderkey AS trial, max(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS best FROM orders""")(
    lambda s, f: ranks.running_max(table(s, f, "orders").select(F.col("o_orderpriority").alias("study"), F.col("o_orderkey").alias("trial"), "o_totalprice"), "study", "trial", "o_totalprice").select("study", "trial", "best")
)

# ---- linear algebra, delays, models ------------------------------------------------------------------
query("dla_pearson", D + """ SELECT series_id, a, b, round(r, 6) AS r FROM (SELECT series_id, 'u1' AS a, 'u2' AS b, corr(u1, u2) AS r FROM d GROUP BY 1 UNION ALL SELECT series_id, 'u1', 'y', corr(u1, y) FROM d GROUP BY 1 UNION ALL SELECT series_id, 'u2', 'y', corr(u2, y) FROM d GROUP BY 1)""")(
    lambda s, f: rounded(linear.pearson(daily(s, f), ["u1", "u2", "y"]), 6, "r")
)
query("dla_spearman", D + """, k AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY u1) + (count(*) OVER (PARTITION BY series_id, u1) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY series_id ORDER BY y) + (count(*) OVER (PARTITION BY series_id, y) - 1) / 2.0 AS r2 FROM d)
SELECT series_id, 'u1' AS a, 'y' AS b, round(corr(r1, r2), 6) AS r FROM k GROUP BY 1""")(lambda s, f: rounded(linear.spearman(daily(s, f), ["u1", "y"]), 6, "r"))
query("dla_vif", D + """, c AS (SELECT series_id, 1 / (1 - pow(corr(u1, u2), 2)) AS v FROM d GROUP BY 1) SELECT series_id, 'u1' AS name, round(v, 4) AS vif FROM c UNION ALL SELECT series_id, 'u2', round(v, 4) FROM c""")(
    lambda s, f: rounded(linear.inflation(daily(s, f), ["u1", "u2"]), 4, "vif")
)
query("set_correlation_groups", D + """, c AS (SELECT series_id, corr(u1, u2) AS a, corr(u1, y) AS b, corr(u2, y) AS c FROM d GROUP BY 1), e AS (SELECT series_id, 'u1' AS x, 'u2' AS z, a AS r FROM c UNION ALL SELECT series_id, 'u1', 'y', b FROM c UNION ALL SELECT series_id, 'u2', 'y', c FROM c),
s AS (SELECT series_id, x, z FROM e WHERE abs(r) >= 0.8), b AS (SELECT * FROM s UNION SELECT series_id, z, x FROM s), q AS (SELECT * FROM b UNION SELECT series_id, x, x FROM b UNION SELECT a.series_id, a.x, c.z FROM b a JOIN b c ON a.series_id = c.series_id AND a.z = c.x)
SELECT series_id, x AS node, min(z) AS grp FROM q GROUP BY 1, 2""")(lambda s, f: linear.correlation_groups(linear.pearson(daily(s, f), ["u1", "u2", "y"]), 0.8))


@query("dla_advice", D + """, c AS (SELECT series_id, abs(corr(u1, u2)) AS r FROM d GROUP BY 1), g AS (SELECT *, r >= 0.8 AS tied, 1 / (1 - r * r) AS vif, sqrt((1 + r) / (1 - r)) AS cond FROM c)
SELECT series_id, 'u1' AS name, CASE WHEN tied THEN 'keep' WHEN vif >= 10 THEN 'review' ELSE 'keep' END AS action FROM g UNION ALL SELECT series_id, 'u2', CASE WHEN tied THEN 'drop' WHEN vif >= 10 THEN 'review' ELSE 'keep' END FROM g
UNION ALL SELECT series_id, '__design__', 'review' FROM g WHERE NOT tied AND cond >= 30""")
def collinearity_advice(spark, sf):
    d = kept(daily(spark, sf))
    present = d.groupBy("series_id").agg(F.count("u1").alias("u1"), F.count("u2").alias("u2")).unpivot("series_id", ["u1", "u2"], "name", "n")
    return linear.advice(linear.inflation(d, ["u1", "u2"]), linear.correlation_groups(linear.pearson(d, ["u1", "u2"]), 0.8), present, condition=linear.design_condition(d, ["u1", "u2"]))


query("dla_design_condition", D + ", c AS (SELECT series_id, abs(corr(u1, u2)) AS r FROM d GROUP BY 1) SELECT series_id, round(sqrt((1 + r) / (1 - r)), 6) AS condition FROM c")(lambda s, f: rounded(linear.design_condition(daily(s, f), ["u1", "u2"]), 6, "condition"))
query("dla_ols", OLS2 + " SELECT series_id, n, 2 AS rank, round((c * r - q * e) / (p * r - q * q), 4) AS b1, round((p * e - q * c) / (p * r - q * q), 4) AS b2 FROM m")(
    lambda s, f: linear.least_squares(regressor.regressor(daily(s, f), ONE), ["b_u1_0", "b_u2_0"]).select("series_id", "n", "rank", F.round(F.get("theta", 0), 4).alias("b1"), F.round(F.get("theta", 1), 4).alias("b2"))
)
query("dla_ridge", OLS2 + " SELECT series_id, n, round((c * (r + 10) - q * e) / ((p + 10) * (r + 10) - q * q), 4) AS b1, round(((p + 10) * e - q * c) / ((p + 10) * (r + 10) - q * q), 4) AS b2 FROM m")(
    lambda s, f: linear.least_squares(regressor.regressor(daily(s, f), ONE), ["b_u1_0", "b_u2_0"], ridge=10.0).select("series_id", "n", F.round(F.get("theta", 0), 4).alias("b1"), F.round(F.get("theta", 1), 4).alias("b2"))
)
query("dla_excitation", X + """, m AS (SELECT series_id, sum(b_u1_0 * b_u1_0) AS p, sum(b_u1_0 * b_u2_0) AS q, sum(b_u2_0 * b_u2_0) AS r FROM x GROUP BY 1)
SELECT series_id, round(ln(p * r - q * q), 6) AS log_det, round(ln(p * r - q * q) / ln(2), 6) AS bits, round((p + r + sqrt(pow(p - r, 2) + 4 * q * q)) / (p + r - sqrt(pow(p - r, 2) + 4 * q * q)), 4) AS condition, 2 AS rank FROM m""")(
    lambda s, f: rounded(rounded(linear.excitation(linear.gram(regressor.regressor(daily(s, f), ONE), ["b_u1_0", "b_u2_0"]), ["b_u1_0", "b_u2_0"]), 6, "log_det", "bits"), 4, "condition").select("series_id", "log_det", "bits", "condition", "rank")
)
query("dla_excitation_order")(lambda s, f: linear.excitation_orders(daily(s, f), "u1", 6))
query("dla_ar_model")(lambda s, f: delay.ar_models(daily(s, f), "u1").select("series_id", "order", F.transform("coefficients", lambda x: F.round(x, 4)).alias("coefficients")))
query("del_prewhitened")(lambda s, f: rounded(delay.prewhitened(daily(s, f), "u1", "y"), 4, "r"))
query("del_refined")(lambda s, f: rounded(delay.refined(kept(daily(s, f)), ["u1", "u2"]), 3, "validation_fit"))
TWO = Structure.of(["u1", "u2"], 2, 2)


def fitted_on(d: DataFrame) -> dict[str, DataFrame]:
    return arx.fit(d, ONE)


def fitted(spark, sf) -> dict[str, DataFrame]:
    return fitted_on(kept(daily(spark, sf)))


# the model of one output lag and one lag of each input: three parameters, so Cramer's rule solves it, and a recursion runs it free
PART = "CASE WHEN {t} < floor(pn.n * CAST(0.6 AS DOUBLE)) - 1 THEN 'train' WHEN {t} >= floor(pn.n * CAST(0.6 AS DOUBLE)) + 1 AND {t} < floor(pn.n * CAST(0.8 AS DOUBLE)) - 1 THEN 'validation' WHEN {t} >= floor(pn.n * CAST(0.8 AS DOUBLE)) + 1 THEN 'test' END"
ARX = "RECURSIVE " + X + f""", pn AS (SELECT series_id, max(t) + 1 AS n FROM d GROUP BY 1), px AS (SELECT x.*, {PART.format(t="x.t")} AS part FROM x JOIN pn ON pn.series_id = x.series_id),
sm AS (SELECT series_id, count(*) AS n, sum(a1 * a1) AS aa, sum(a1 * b_u1_0) AS ab, sum(a1 * b_u2_0) AS ac, sum(b_u1_0 * b_u1_0) AS bb, sum(b_u1_0 * b_u2_0) AS bc, sum(b_u2_0 * b_u2_0) AS cc, sum(a1 * target) AS y1, sum(b_u1_0 * target) AS y2, sum(b_u2_0 * target) AS y3 FROM px WHERE part = 'train' GROUP BY 1),
dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM sm),
th AS (SELECT series_id, n, (y1 * (bb * cc - bc * bc) - ab * (y2 * cc - bc * y3) + ac * (y2 * bc - bb * y3)) / det AS a, (aa * (y2 * cc - y3 * bc) - y1 * (ab * cc - bc * ac) + ac * (ab * y3 - y2 * ac)) / det AS b, (aa * (bb * y3 - bc * y2) - ab * (ab * y3 - y2 * ac) + y1 * (ab * bc - bb * ac)) / det AS c FROM dt),
pe AS (SELECT px.series_id, part, t, target, target - a * a1 - b * b_u1_0 - c * b_u2_0 AS e FROM px JOIN th ON th.series_id = px.series_id),
os AS (SELECT series_id, part, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(target) * count(*)) AS r2, 100 * (1 - sqrt(sum(e * e) / (var_pop(target) * count(*)))) AS fit, sqrt(avg(e * e)) / (quantile_cont(target, 0.95) - quantile_cont(target, 0.05)) AS nrmse, sum(e * e) AS rss FROM pe WHERE part IS NOT NULL GROUP BY 1, 2),
rq AS (SELECT d.series_id, d.t, {PART.format(t="d.t")} AS part, y, b * u1 + c * u2 AS drive, a FROM d JOIN th ON th.series_id = d.series_id JOIN pn ON pn.series_id = d.series_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY series_id, part ORDER BY t) AS k FROM rq WHERE part IS NOT NULL),
si AS (SELECT series_id, part, k, y, y AS s FROM rr WHERE k = 1 UNION ALL SELECT r.series_id, r.part, r.k, r.y, r.drive - r.a * si.s FROM si JOIN rr r ON r.series_id = si.series_id AND r.part = si.part AND r.k = si.k + 1),
fr AS (SELECT series_id, part, greatest(-100, 100 * (1 - sqrt(sum((y - s) * (y - s)) / (var_pop(y) * count(*))))) AS free_run_fit FROM si GROUP BY 1, 2),
ga AS (SELECT series_id, 'u1' AS input, b / (1 + a) AS gain FROM th UNION ALL SELECT series_id, 'u2', c / (1 + a) FROM th)"""
WHITE = ARX + ", rc AS (SELECT series_id, t, e - avg(e) OVER (PARTITION BY series_id) AS c FROM pe WHERE part = 'validation'), rl AS (SELECT series_id, c, " + ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, LAGS + 1)) + " FROM rc WINDOW w AS (PARTITION BY series_id ORDER BY t)), wh AS (SELECT series_id, (" + " + ".join(f"CASE WHEN abs(sum(c * c{k}) / sum(c * c)) <= 1.96 / sqrt(count(*)) THEN 1 ELSE 0 END" for k in range(1, LAGS + 1)) + f") / {LAGS}.0 AS whiteness FROM rl GROUP BY 1)"
query("dla_arx_models", ARX + " SELECT series_id, n, 3 AS rank, round(a, 6) AS a1, round(b, 6) AS b_u1, round(c, 6) AS b_u2 FROM th")(
    lambda s, f: fitted(s, f)["models"].select("series_id", "n", "rank", *[F.round(F.get("theta", i), 6).alias(k) for i, k in enumerate(("a1", "b_u1", "b_u2"))])
)
query("dla_arx_one_step", ARX + " SELECT series_id, part, n, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("rmse", "mae", "r2", "fit", "nrmse")) + " FROM os")(lambda s, f: rounded(fitted(s, f)["one_step"], 4, "rmse", "mae", "r2", "fit", "nrmse"))
query("dla_arx_free_run", ARX + " SELECT series_id, part, round(free_run_fit, 4) AS free_run_fit FROM fr")(lambda s, f: rounded(fitted(s, f)["simulation"], 4, "free_run_fit"))


def run_in_blocks(spark, sf) -> DataFrame:
    """Free-run fits of all parts, each run in blocks of 64 steps."""
    d = kept(daily(spark, sf))
    n = d.groupBy("series_id").agg((F.max("t") + 1).alias("__n"))
    ran = affine.free_run(arx.parts(d, ONE.history, n, arx.Split()), fitted_on(d)["models"], ONE, within="part", size=64)
    return arx.parts(ran, ONE.history, n, arx.Split()).filter("part is not null").groupBy("series_id", "part").agg(F.round(scalars.fit_percent(F.col("y"), F.col("simulated")), 4).alias("free_run_fit"))


query("dla_arx_free_run_blocks", ARX + " SELECT series_id, part, round(free_run_fit, 4) AS free_run_fit FROM fr")(run_in_blocks)
query("dla_arx_gains", ARX + " SELECT series_id, input, round(gain, 4) AS gain FROM ga")(lambda s, f: rounded(fitted(s, f)["gains"], 4, "gain"))
query("dla_arx_summary", WHITE + """ SELECT th.series_id, abs(a) < 1 AS stable, round(abs(a), 4) AS max_pole, round(th.n * ln(tr.rss / th.n) + 6, 3) AS aic, round(th.n * ln(tr.rss / th.n) + 3 * ln(th.n), 3) AS bic, round(va.fit, 4) AS one_step_fit, round(va.rmse, 4) AS validation_rmse, round(free_run_fit, 4) AS free_run_fit, round(whiteness, 4) AS whiteness, round(va.fit - free_run_fit, 4) AS fit_gap
FROM th JOIN os tr ON tr.series_id = th.series_id AND tr.part = 'train' JOIN os va ON va.series_id = th.series_id AND va.part = 'validation' JOIN fr ON fr.series_id = th.series_id AND fr.part = 'validation' JOIN wh ON wh.series_id = th.series_id""")(
    lambda s, f: rounded(rounded(fitted(s, f)["summary"], 4, "max_pole", "one_step_fit", "validation_rmse", "free_run_fit", "whiteness", "fit_gap"), 3, "aic", "bic")
)
query("dla_arx_priors", ARX + """ SELECT series_id, input AS variable, 'gain_sign' AS kind, 'negative' AS expected, round(gain, 4) AS actual FROM ga WHERE input = 'u1' AND gain >= 0 UNION ALL SELECT series_id, input, 'gain_sign', 'positive', round(gain, 4) FROM ga WHERE input = 'u2' AND gain <= 0
UNION ALL SELECT series_id, input, 'gain_bounds', '[0.0, 1.0]', round(gain, 4) FROM ga WHERE input = 'u2' AND (gain < 0 OR gain > 1) UNION ALL SELECT series_id, '__model__', 'stability', 'all poles inside the unit circle', round(abs(a), 4) FROM th WHERE abs(a) >= 1""")(
    lambda s, f: rounded(arx.violations(fitted(s, f), arx.Priors({"u1": "negative", "u2": "positive"}, {"u2": (0.0, 1.0)}, True)), 4, "actual")
)
query("opt_structure_search")(lambda s, f: rounded(arx.search(kept(daily(s, f)), ["u1", "u2"]), 4, "free_run_fit", "one_step_fit", "rmse", "max_pole", "value"))
query("opt_best_trial")(lambda s, f: rounded(arx.best_trials(arx.search(kept(daily(s, f)), ["u1", "u2"])), 4, "free_run_fit", "one_step_fit", "rmse", "max_pole", "value"))
query("opt_study")(lambda s, f: rounded(study.trials(kept(daily(s, f)), ["u1", "u2"]), 3, "free_run_fit", "value"))

# ---- rows, joins, scalars, sources ---------------------------------------------------------------------
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
L = f"""l0 AS (SELECT l_returnflag AS series_id, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY {", ".join(ORDER)}) - 1 AS "row", count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)"""


def lines(spark, sf) -> DataFrame:
    """``series_id, row, n, v``: the price of every line of a return flag, numbered."""
    rows = table(spark, sf, "lineitem")
    n = kept(rows.groupBy("l_returnflag").agg(F.count("*").alias("n")))
    out = ranks.positions(rows.select("l_returnflag", *ORDER), "l_returnflag", ORDER, columns=["l_returnflag", "l_extendedprice"]).join(spread(n), "l_returnflag")
    return out.select(F.col("l_returnflag").alias("series_id"), (F.col("row") - 1).alias("row"), "n", F.col("l_extendedprice").alias("v"))


query("prj_stride_clean", L + """ SELECT series_id, "row", v FROM l0 WHERE "row" % CAST(ceil(n / 10000.0) AS BIGINT) = 0 OR "row" = n - 1""")(lambda s, f: profile.downsampled(lines(s, f), 10_000).select("series_id", "row", "v"))
query("prj_stride_plot", L + """ SELECT series_id, "row", v FROM l0 WHERE "row" % greatest(1, n // 6000) = 0""")(lambda s, f: profile.downsampled(lines(s, f), 6000, last=False).select("series_id", "row", "v"))
query("prj_head", L + """ SELECT series_id, "row", v FROM l0 WHERE "row" < 4000""")(lambda s, f: lines(s, f).filter("row < 4000").select("series_id", "row", "v"))
query("prj_chronological_part", D + ", n AS (SELECT series_id, max(t) + 1 AS n FROM d GROUP BY 1) SELECT d.* FROM d JOIN n ON n.series_id = d.series_id WHERE t >= floor(n * 0.6) AND t < floor(n * 0.8)")(lambda s, f: regressor.chronological(daily(s, f), 0.6, 0.8))
query("prj_page", "SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k > 20 AND k <= 40")(
    lambda s, f: table(s, f, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_orderdate")
)
query("prj_finite", "SELECT event_id, CASE WHEN value > 50 THEN 0.0 ELSE value END AS v FROM events")(
    lambda s, f: table(s, f, "events").select("event_id", scalars.scrubbed(F.when(F.col("value") > 50, F.lit(float("nan"))).otherwise(F.col("value"))).alias("v"))
)
query("joi_selected_rows", D + ", k AS (SELECT series_id, t FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(y) DESC, t) AS r FROM d) WHERE r <= 25) SELECT d.* FROM d JOIN k ON k.series_id = d.series_id AND k.t = d.t")(
    lambda s, f: daily(s, f).join(daily(s, f).withColumn("r", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(F.abs("y")), "t"))).filter("r <= 25"), ["series_id", "t"], "left_semi")
)
query("joi_window_evidence", QUALITY + """, r AS (SELECT series_id, win, row_number() OVER (PARTITION BY series_id ORDER BY input_activity DESC, win) AS rank FROM qu) SELECT r.series_id, r.win AS "window", rank, start, stop FROM r JOIN qu ON qu.series_id = r.series_id AND qu.win = r.win WHERE rank <= 5""")(
    lambda s, f: regressor.ranked(quality(s, f), "input_activity", budget=5).select("series_id", "window", "rank").join(quality(s, f).select("series_id", "window", "start", "stop"), ["series_id", "window"])
)


@query("joi_version_lineage", """RECURSIVE k AS (SELECT o_custkey AS c, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
p AS (SELECT a.id, b.id AS parent FROM k a LEFT JOIN k b ON b.c = a.c AND b.k = a.k // 2), c AS (SELECT id, parent, id AS root, CAST(0 AS BIGINT) AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.id, p.parent, c.root, c.depth + 1 FROM p JOIN c ON p.parent = c.id) SELECT id, parent, root, depth FROM c""")
def version_lineage(spark, sf):
    """Root and depth of every version in its tree; a customer's orders stand for versions, each with up to two children."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("k"))
    up = k.select("o_custkey", F.col("id").alias("parent"), F.col("k").alias("half"))
    edges = k.withColumn("half", F.floor(F.col("k") / 2).cast("int")).join(up, ["o_custkey", "half"], "left").select("id", "parent")
    return catalogue.lineage(edges, "id", "parent").withColumnRenamed("version", "id")


NEAREST = PRINTS + """, nd AS (SELECT a.series_id, b.series_id AS other, sqrt(""" + " + ".join(f"pow(a.f{i} - b.f{i}, 2)" for i in range(9)) + """) AS distance FROM fp a JOIN fp b ON a.series_id <> b.series_id), nr AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY distance, other) AS rank FROM nd WHERE distance <= 0.35)
SELECT series_id, other, round(distance, 6) AS distance, rank FROM nr WHERE rank <= 3"""
query("joi_nearest_fingerprints", NEAREST)(lambda s, f: rounded(profile.nearest(kept(profile.fingerprint(supplied(s, f), ["u1", "u2"], "y"))), 6, "distance"))
query("joi_nearest_by_pivots", NEAREST)(lambda s, f: rounded(pivots.nearest(kept(profile.fingerprint(supplied(s, f), ["u1", "u2"], "y"))), 6, "distance"))




@query("srt_average_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderpriority, o_orderdate) - 1) / 2.0 AS r FROM orders")
def average_rank(spark, sf):
    """Ranks with ties sharing their mean: a running sum over the distinct values, not over the rows."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    sizes = rows.groupBy("o_orderpriority", "o_orderdate").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.withColumn("r", before + (F.col("n") + 1) / 2), ["o_orderpriority", "o_orderdate"]).select("o_orderkey", "r")


query("srt_ordinal_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders")(
    lambda s, f: ranks.positions(table(s, f, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), "o_orderpriority", ["o_orderdate", "o_orderkey"], F.unix_date(F.to_date("o_orderdate")).cast("double"), "r").select("o_orderkey", "r")
)
query("srt_latest_run", "SELECT run_type, user_id, event_id FROM (SELECT event_type AS run_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")(
    lambda s, f: table(s, f, "events").groupBy(F.col("event_type").alias("run_type"), "user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
)
query("srt_row_budget", "RECURSIVE " + QUALITY + """, wr AS (SELECT series_id, win, min("row") AS lo, max("row") AS hi FROM held GROUP BY 1, 2), rk AS (SELECT qu.series_id, qu.win, generate_series(lo, hi) AS own, row_number() OVER (PARTITION BY qu.series_id ORDER BY input_activity DESC, qu.win) AS k FROM qu JOIN wr ON wr.series_id = qu.series_id AND wr.win = qu.win),
rb AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS cov, CAST(NULL AS BIGINT) AS win, false AS taken FROM rk UNION ALL
 SELECT rb.series_id, rk.k, CASE WHEN len(list_distinct(list_concat(cov, own))) <= 600 THEN list_distinct(list_concat(cov, own)) ELSE cov END, rk.win, len(list_distinct(list_concat(cov, own))) <= 600 FROM rb JOIN rk ON rk.series_id = rb.series_id AND rk.k = rb.k + 1)
SELECT series_id, win AS "window", row_number() OVER (PARTITION BY series_id ORDER BY k) AS rank FROM rb WHERE taken""")(lambda s, f: regressor.within_rows(*_budgeted(s, f), rows=600))


def _budgeted(spark, sf):
    held = with_windows(spark, sf)
    return quality(spark, sf).select("series_id", "window", F.col("input_activity").alias("score")), held.groupBy("series_id", "window").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))


@query("srt_best_trial", "SELECT study, trial, value FROM (SELECT o_orderpriority AS study, o_orderkey AS trial, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_trial(spark, sf):
    trials = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("study"), F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("value"))
    return arx.best_trials(trials, "study")


query("opt_importance", """r AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS y, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS a, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS b FROM lineitem),
c AS (SELECT l_returnflag AS study, abs(corr(a, y)) AS a, abs(corr(b, y)) AS b FROM r GROUP BY 1) SELECT study, 'l_quantity' AS parameter, round(a / (a + b), 6) AS importance FROM c UNION ALL SELECT study, 'l_discount', round(b / (a + b), 6) FROM c""")(
    lambda s, f: _importance(s, f)
)


def _importance(spark, sf):
    """Share of each parameter's rank correlation with the value."""
    rest = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    values = {"l_extendedprice": "y", "l_quantity": "a", "l_discount": "b"}
    # one place by all that settles ties stands for it in the three orders
    rows = ranks.positions(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", *rest), "l_returnflag", rest, name="k", columns=["l_returnflag", *values])
    for c, name in values.items():
        rows = ranks.positions(rows, "l_returnflag", [c, "k"], name=name, columns=[x for x in rows.columns if x != c])
    r = rows.groupBy(F.col("l_returnflag").alias("study")).agg(F.abs(F.corr("a", "y")).alias("l_quantity"), F.abs(F.corr("b", "y")).alias("l_discount")).unpivot("study", ["l_quantity", "l_discount"], "parameter", "r")
    return r.select("study", "parameter", F.round(F.col("r") / F.sum("r").over(Window.partitionBy("study")), 6).alias("importance"))


query("sca_fit_percent", X + " SELECT series_id, round(greatest(-100, 100 * (1 - sqrt(sum(pow(target - b_u1_0, 2)) / (var_pop(target) * count(*))))), 4) AS fit, round(sqrt(avg(pow(target - b_u1_0, 2))), 6) AS rmse, round(avg(abs(target - b_u1_0)), 6) AS mae FROM x GROUP BY 1")(
    lambda s, f: regressor.regressor(daily(s, f), ONE).groupBy("series_id").agg(F.round(scalars.fit_percent(F.col("target"), F.col("b_u1_0")), 4).alias("fit"), F.round(scalars.scores(F.col("target"), F.col("b_u1_0"))["rmse"], 6).alias("rmse"), F.round(scalars.scores(F.col("target"), F.col("b_u1_0"))["mae"], 6).alias("mae"))
)
query("sca_number_parse", "SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events")(lambda s, f: table(s, f, "events").select("event_id", scalars.to_number(F.regexp_extract("props", "[0-9]+", 0)).alias("k")))
query("sca_close", "SELECT event_id, abs(value - round(value, 1)) <= greatest(1e-9 * greatest(abs(value), abs(round(value, 1))), 1e-12) AS is_close FROM events")(
    lambda s, f: table(s, f, "events").select("event_id", scalars.close(F.col("value"), F.round("value", 1)).alias("is_close"))
)
query("sca_score_pack", X + """ SELECT series_id, round(1 - sum(pow(target - b_u1_0, 2)) / (var_pop(target) * count(*)), 6) AS r2, round(sqrt(avg(pow(target - b_u1_0, 2))) / (quantile_cont(target, 0.95) - quantile_cont(target, 0.05)), 6) AS nrmse FROM x GROUP BY 1""")(
    lambda s, f: regressor.regressor(daily(s, f), ONE).groupBy("series_id").agg(*[F.round(scalars.scores(F.col("target"), F.col("b_u1_0"))[k], 6).alias(k) for k in ("r2", "nrmse")])
)
query("sca_number_text", r"SELECT event_id, CASE WHEN abs(x) >= 1e5 OR (x <> 0 AND abs(x) < 1e-4) THEN printf('%.4e', x) ELSE regexp_replace(regexp_replace(printf('%.4f', x), '(\.[0-9]*?)0+$', '\1'), '\.$', '') END AS text FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN round(value, 2) * 1048576 WHEN 1 THEN round(value, 2) / 1048576 ELSE round(value, 2) END AS x FROM events)")(
    lambda s, f: table(s, f, "events").withColumn("x", F.when(F.col("event_id") % 3 == 0, F.round("value", 2) * 1048576).when(F.col("event_id") % 3 == 1, F.round("value", 2) / 1048576).otherwise(F.round("value", 2))).select("event_id", scalars.number_text(F.col("x")).alias("text"))
)
query("snk_number", "SELECT event_id, format('{:.12g}', round(value, 2) / 700007) AS text FROM events")(lambda s, f: table(s, f, "events").select("event_id", sinks.number(F.round("value", 2) / 700007).alias("text")))
query("sca_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda s, f: table(s, f, "events").select("event_id", scalars.json_at(F.col("props"), "k").cast("long").alias("k")))
query("qry_numerals", r"SELECT conv_id, turn, len(regexp_extract_all(regexp_replace(text, '\{\{[^}]*\}\}', '', 'g'), '[0-9]+')) AS n_numerals FROM conversations")(
    lambda s, f: table(s, f, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all(F.regexp_replace("text", r"\{\{[^}]*\}\}", ""), F.lit("[0-9]+"), F.lit(0))).cast("long").alias("n_numerals"))
)
query("src_infer_types", """c AS (SELECT 'event_id' AS "column", CAST(event_id AS VARCHAR) AS x FROM events UNION ALL SELECT 'ts', CAST(ts AS VARCHAR) FROM events UNION ALL SELECT 'event_type', event_type FROM events UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events UNION ALL SELECT 'props', CAST(props AS VARCHAR) FROM events)
SELECT "column", CASE WHEN bool_and(TRY_CAST(x AS TIMESTAMP) IS NOT NULL) THEN 'datetime' WHEN bool_and(lower(trim(x)) IN ('true', 'false', '0', '1')) THEN 'boolean' WHEN bool_and(regexp_full_match(trim(x), '[+-]?[0-9]+')) THEN 'integer' WHEN bool_and(TRY_CAST(x AS DOUBLE) IS NOT NULL) THEN 'float' ELSE 'string' END AS type FROM c GROUP BY 1""")(lambda s, f: csv.inferred(table(s, f, "events").select(*[F.col(c).cast("string") for c in ("event_id", "ts", "event_type", "value", "props")])))
query("src_parse_timestamps", "SELECT event_id, epoch_us(ts) AS us FROM events")(
    lambda s, f: table(s, f, "events").select("event_id", F.unix_micros(csv.timestamp(F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))))).alias("us"))
)
query("src_median_period", STEPS + " SELECT series_id, round(period, 6) AS period FROM p")(lambda s, f: profile.intervals(per_user(s, f)).filter("period is not null").groupBy("series_id").agg(F.round(F.max("period"), 6).alias("period")))

# ---- experiments, sinks, streams -----------------------------------------------------------------------
query("ben_selection_ablation")(lambda s, f: rounded(ablation.selection_ablation(kept(daily(s, f)), TWO), 3, "condition", "one_step_fit", "free_run_fit"))
# the same model of two choices of training steps: a copy of each series for either
CHOICES = ARX.replace("d AS (SELECT series_id, row_number()", "d0 AS (SELECT series_id, row_number()").replace(" AS y FROM days)", " AS y FROM days), d AS (SELECT d0.series_id || '|' || choice AS series_id, t, u1, u2, y FROM d0 CROSS JOIN (VALUES ('well_fitted'), ('starved')) AS v(choice))", 1)
CHOICES = CHOICES.replace("WHERE part = 'train' GROUP BY 1)", "WHERE part = 'train' AND (series_id LIKE '%|well_fitted' OR t BETWEEN 20 AND 239) GROUP BY 1)", 1)
query("ben_metric_ablation", CHOICES + """ SELECT split_part(os.series_id, '|', 1) AS series_id, split_part(os.series_id, '|', 2) AS strategy, round(fit, 3) AS one_step_fit, round(free_run_fit, 3) AS free_run_fit, round(fit - free_run_fit, 3) AS fit_gap
FROM os JOIN fr ON fr.series_id = os.series_id AND fr.part = os.part WHERE os.part = 'validation'""")(lambda s, f: rounded(ablation.metric_ablation(kept(daily(s, f)), ONE), 3, "one_step_fit", "free_run_fit", "fit_gap"))
query("ben_sensitivity")(lambda s, f: rounded(ablation.sensitivity(kept(daily(s, f)), ONE), 3, "condition", "free_run_fit"))
query("ben_wins")(lambda s, f: ablation.wins(ablation.sensitivity(kept(daily(s, f)), ONE)))
query("ben_self")(lambda s, f: rounded(ablation.self_benchmark(kept(daily(s, f)), TWO), 3, "full_fit", "energy_fit", "weighted_fit", "information_fit", "discrimination"))
GRID = [(size, size // 2) for size in (30, 40, 60, 80, 120)]
query("win_grams_of_sizes", X + """, nn AS (SELECT series_id, max(row) + 1 AS n FROM x GROUP BY 1), sz AS (SELECT unnest([30, 40, 60, 80, 120]) AS size),
wd AS (SELECT series_id, size, unnest(generate_series(0, CAST(floor((n - size) / (size / 2.0)) AS BIGINT))) AS win FROM nn, sz WHERE n >= size)
SELECT wd.series_id, CAST(size AS BIGINT) AS size, win AS "window", round(sum(a1 * a1) + 1e-9, 4) AS g00, round(sum(a1 * b_u1_0) + 1e-9, 4) AS g01, round(sum(a1 * b_u2_0) + 1e-9, 4) AS g02, round(sum(b_u1_0 * b_u1_0) + 1e-9, 4) AS g11, round(sum(b_u1_0 * b_u2_0) + 1e-9, 4) AS g12, round(sum(b_u2_0 * b_u2_0) + 1e-9, 4) AS g22
FROM wd JOIN x ON x.series_id = wd.series_id AND x.row >= win * (size // 2) AND x.row < win * (size // 2) + size GROUP BY 1, 2, 3""")(
    lambda s, f: selection.window_grams(regressor.regressor(daily(s, f), ONE), ONE.features, GRID).select("series_id", "size", "window", *[F.round(F.get("products", k) + 1e-9, 4).alias(f"g{i}{j}") for k, (i, j) in enumerate(selection.products(ONE.features))])
)
query("ben_delay_peaks")(lambda s, f: ablation.delay_ablation(daily(s, f), ["u1", "u2"]))
query("snk_checksum", H + """ SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(printf('%.6f', n) || '|' || series_id || '|' || CAST(t AS VARCHAR) || '|' || coalesce(printf('%.6f', v), '')), 1, 15) AS BIGINT)) AS VARCHAR) AS checksum FROM h""")(lambda s, f: sinks.checksum(hourly(s, f)))
query("str_windowed_quality", """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(*) - count(value) AS n_missing, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread FROM events GROUP BY 1, 2""")(
    lambda s, f: rounded(monitor.windowed_quality(table(s, f, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")), 6, "mean", "spread")
)


query("set_changed_union", H + ", " + clean_sql("h") + " SELECT series_id, t FROM cleaned WHERE mask & 13 > 0")(
    lambda s, f: cleanup.cleaned(hourly(s, f).withColumn("ord", F.col("t")), ["v"], SMOOTH, at="t").filter(cleanup.changed(F.col("v__mask"))).select("series_id", "t")
)


query("cat_summary", """SELECT event_type AS series_id, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_day, count(*) AS n FROM events GROUP BY 1""")(
    lambda s, f: table(s, f, "events").groupBy(F.col("event_type").alias("series_id")).agg(F.to_date(F.min("ts")).cast("string").alias("first_day"), F.to_date(F.max("ts")).cast("string").alias("last_day"), F.count("*").alias("n"))
)


# ---- groups of any size ---------------------------------------------------------------------------------
L = "l AS (SELECT l_returnflag AS series_id, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem)"
SHARES = {"p05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "p95": 0.95}


def priced(spark, sf) -> DataFrame:
    """``series_id, v``: the price of every line by return flag."""
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_extendedprice").cast("double").alias("v"))


query("agg_exact_quantiles", L + " SELECT series_id, " + ", ".join(f"round(quantile_cont(v, {q}), 4) AS {k}" for k, q in SHARES.items()) + " FROM l GROUP BY 1")(
    lambda s, f: quantiles.exact(priced(s, f), list(SHARES.values())).select("series_id", *[F.round(F.get("q", F.lit(i)), 4).alias(k) for i, k in enumerate(SHARES)])
)
query("agg_long_statistics", L + """ SELECT series_id, count(v) AS n, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS std, min(v) AS min, max(v) AS max,
 round(quantile_cont(v, 0.25), 2) AS q25, round(quantile_cont(v, 0.5), 2) AS q50, round(quantile_cont(v, 0.75), 2) AS q75 FROM l GROUP BY 1""")(lambda s, f: quantiles.statistics(priced(s, f), places=2))
query("agg_long_anomalies", L + """, b AS (SELECT series_id, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS z FROM l GROUP BY 1)
SELECT l.series_id, count(*) FILTER (WHERE v < a - 1.5 * (z - a) OR v > z + 1.5 * (z - a)) AS n_anomalies FROM l JOIN b ON b.series_id = l.series_id GROUP BY 1""")(lambda s, f: quantiles.iqr_anomalies(priced(s, f)))
query("agg_robust_spread", L + """, m AS (SELECT series_id, quantile_cont(v, 0.5) AS median FROM l GROUP BY 1)
SELECT l.series_id, round(max(median), 4) AS median, round(quantile_cont(abs(v - median), 0.5), 4) AS mad FROM l JOIN m ON m.series_id = l.series_id GROUP BY 1""")(
    lambda s, f: rounded(quantiles.robust_spread(priced(s, f)), 4, "median", "mad")
)
query("srt_d_optimal_spread", GREEDY + """ SELECT series_id, win AS "window", rank, round((level - before) / ln(2), 3) AS gain_bits, round(level, 3) AS log_det FROM best WHERE level > before""")(
    lambda s, f: rounded(selection.spread_choice(selection.window_grams(regressor.regressor(daily(s, f), ONE), ONE.features, [(60, 30)]), 3), 3, "gain_bits", "log_det")
)
