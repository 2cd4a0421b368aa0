"""Queries of the stage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import dims
from waymark.functions.checkpoints import settled
from waymark.operators import diff
from waymark.operators import stages as T
from waymark.plans import bindings as B
from waymark.plans.bindings import checkpoints, completion, findings, observations, table, with_sql
from waymark.plans.core import query
from waymark.plans.q_diff import changes, compared, cumulative_introduced, local_introduced, runs, steps

METRICS = [m for _, m, _ in B.METRICS]
_CAT = "regexp_extract(rule_id, '^(BE|FE|CROSS)-([A-Z]+)-', 2)"
_INTRO = "delta_scope = '{}' AND change_type = 'introduced' AND session_id <> 'baseline'"
LOCAL, CUMULATIVE = _INTRO.format("run_local"), _INTRO.format("trajectory_cumulative")


def bounds(spark, d):
    return T.metric_bounds(observations(spark, d))


def cells(spark, d):
    cp, base = steps(spark, d)
    metrics = settled(observations(spark, d, cp))
    return T.silent_decay(cp, local_introduced(spark, d, cp, base), metrics, T.metric_bounds(metrics), dims.concerns(spark))


def files(spark, d):
    return T.file_counts(findings(spark, d))


@query("t01_run_overview", with_sql("runs completion", """SELECT r.evaluation_id, coalesce(c.agent_status = 'success', false) AS task_completed, r.execution_status = 'completed' AS harness_completed, c.test_status, run_local_introduced_count AS constraints_introduced_this_task,
run_local_resolved_count AS constraints_resolved_this_task, trajectory_introduced_count AS cumulative_net_new_violations FROM runs r LEFT JOIN completion c USING (session_id, task_id)"""))
def t01(spark, d):
    cp, base = steps(spark, d)
    return T.run_overview(runs(spark, d, cp, base), completion(spark, d, cp))


@query("t02_scope_breakdown", with_sql("findings", "SELECT evaluation_id, count(*) FILTER (WHERE scope_id = 'backend') AS backend, count(*) FILTER (WHERE scope_id = 'frontend') AS frontend, count(*) FILTER (WHERE scope_id = 'cross-stack') AS cross_stack FROM findings GROUP BY 1"))
def t02(spark, d):
    return findings(spark, d).groupBy("evaluation_id").agg(*[F.count_if(F.col("scope_id") == s).alias(s.replace("-", "_")) for s in ("backend", "frontend", "cross-stack")])


@query("t03_metric_error_rates", with_sql("observations", "SELECT metric_name, regexp_extract(metric_name, '^(BE|FE|CROSS)-([A-Z]+)-', 2) AS category, count(*) AS observations, count(*) FILTER (WHERE status = 'error') AS errors, round(count(*) FILTER (WHERE status = 'error') / count(*), 6) AS error_rate FROM observations GROUP BY 1, 2"))
def t03(spark, d):
    return T.metric_error_rates(observations(spark, d))


@query("t04_run_reliability", with_sql("pairs observations", """SELECT c.evaluation_id, c.execution_status = 'completed' AND b.execution_status = 'completed' AND c.profile_hash = b.profile_hash AND NOT EXISTS (SELECT 1 FROM observations o WHERE o.evaluation_id = c.evaluation_id AND o.status = 'error') AS reliable
FROM checkpoints c JOIN pairs p ON p.evaluation_id = c.evaluation_id AND p.delta_scope = 'run_local' JOIN checkpoints b ON b.evaluation_id = p.pre"""))
def t04(spark, d):
    cp = checkpoints(spark, d)
    errors = observations(spark, d).groupBy("evaluation_id").agg(F.count_if(F.col("status") == "error").alias("scope_errors"))
    return T.run_reliability(cp, diff.comparability(diff.make_pairs(cp), cp), errors)


@query("t05_baseline_debt", with_sql("changes", f"""WITH b AS (SELECT {_CAT} AS category, sum(n) AS x FROM changes WHERE change_type = 'current' AND session_id = 'baseline' GROUP BY 1),
a AS (SELECT category, avg(x) AS x FROM (SELECT evaluation_id, {_CAT} AS category, sum(n) AS x FROM changes WHERE change_type = 'current' AND session_id <> 'baseline' GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT category, avg(x) AS x FROM (SELECT evaluation_id, {_CAT} AS category, sum(n) AS x FROM changes WHERE {CUMULATIVE} GROUP BY 1, 2) GROUP BY 1)
SELECT category, CAST(coalesce(b.x, 0) AS BIGINT) AS baseline_count, round(coalesce(a.x, 0), 6) AS mean_agent_count, round(coalesce(i.x, 0), 6) AS mean_net_new FROM b FULL JOIN a USING (category) FULL JOIN i USING (category)"""))
def t05(spark, d):
    return T.baseline_debt(changes(spark, d))


@query("t06_baseline_self_check", with_sql("runs", "SELECT count(*) AS rows, coalesce(bool_and(run_local_introduced_count = 0 AND run_local_resolved_count = 0 AND trajectory_introduced_count = 0 AND trajectory_resolved_count = 0), false) AS passed FROM runs WHERE session_id = 'baseline'"))
def t06(spark, d):
    return T.baseline_self_check(runs(spark, d))


@query("t07_completion_gate", with_sql("completion", "SELECT session_id, task_id, agent_status IS DISTINCT FROM 'success' AS agent_not_successful, completion_marker_found IS DISTINCT FROM true AS marker_missing, agent_reported_error IS NOT DISTINCT FROM true AS reported_error, test_status IS DISTINCT FROM 'pass' AS tests_not_passed FROM completion"))
def t07(spark, d):
    return T.completion_gate(completion(spark, d))


@query("t08_status_by_task", with_sql("completion", """SELECT task_id, count(*) FILTER (WHERE test_status = 'pass') AS "pass", count(*) FILTER (WHERE test_status = 'fail') AS fail, count(*) FILTER (WHERE test_status = 'error') AS error FROM completion GROUP BY 1"""))
def t08(spark, d):
    return T.status_by_task(completion(spark, d), ["pass", "fail", "error"])


_PROFILE = f"""WITH n AS (SELECT agent, count(*) AS e FROM checkpoints WHERE session_id <> 'baseline' GROUP BY 1), f AS (SELECT agent, regexp_extract(rule_id, '^(.*)-C-001$', 1) AS concern, sum(n) AS x FROM changes WHERE {CUMULATIVE} GROUP BY 1, 2),
m AS (SELECT k.concern, k.layer, avg(coalesce(f.x, 0) / n.e) AS r FROM concerns k CROSS JOIN n LEFT JOIN f ON f.agent = n.agent AND f.concern = k.concern GROUP BY 1, 2),
profile AS (SELECT concern, layer, round(r, 6) AS mean_rate, round(100 * r / nullif(sum(r) OVER (), 0), 6) AS share_percent FROM m)"""


def profile(spark, d):
    cp, base = steps(spark, d)
    return T.concern_profile(cumulative_introduced(spark, d, cp, base), cp, dims.concerns(spark))


@query("t09_concern_profile", with_sql("changes concerns", _PROFILE + " SELECT * FROM profile"))
def t09(spark, d):
    return profile(spark, d)


@query("t10_layer_summary", with_sql("changes concerns", _PROFILE + " SELECT layer, count(*) AS concerns, count(*) FILTER (WHERE mean_rate > 0) AS concerns_hit, round(sum(mean_rate), 4) AS total_rate, round(100 * sum(mean_rate) / nullif(sum(sum(mean_rate)) OVER (), 0), 4) AS share_percent FROM profile GROUP BY 1"))
def t10(spark, d):
    return T.layer_summary(profile(spark, d))


_RULE_DIFF = f"""WITH rd AS (SELECT agent, task_id, rule_id, CAST(coalesce(sum(n) FILTER (WHERE strategy = 'minimal'), 0) AS BIGINT) AS minimal, CAST(coalesce(sum(n) FILTER (WHERE strategy = 'structured'), 0) AS BIGINT) AS structured FROM changes WHERE {LOCAL} GROUP BY 1, 2, 3),
rule_diff AS (SELECT *, structured - minimal AS diff FROM rd)"""


@query("t11_strategy_rule_diff", with_sql("changes", _RULE_DIFF + " SELECT * FROM rule_diff"))
def t11(spark, d):
    return T.strategy_rule_diff(local_introduced(spark, d))


@query("t12_strategy_rule_diff_check", with_sql("runs changes", _RULE_DIFF + """, w AS (SELECT agent, task_id, avg(run_local_introduced_count) FILTER (WHERE strategy = 'structured') - avg(run_local_introduced_count) FILTER (WHERE strategy = 'minimal') AS expected FROM runs WHERE session_id <> 'baseline' GROUP BY 1, 2),
g AS (SELECT agent, task_id, CAST(sum(diff) AS BIGINT) AS found FROM rule_diff GROUP BY 1, 2) SELECT agent, task_id, round(expected, 6) AS expected, found FROM (SELECT * FROM w WHERE expected IS NOT NULL) w FULL JOIN g USING (agent, task_id) WHERE NOT coalesce(abs(expected - found) < 1e-9, false)"""))
def t12(spark, d):
    cp, base = steps(spark, d)
    rows = settled(compared(spark, d, cp, base))
    return T.strategy_rule_diff_check(T.strategy_rule_diff(diff.introduced(rows, "run_local")), runs(spark, d, cp, base, rows))


@query("t13_rule_movement", with_sql("changes", _RULE_DIFF + " SELECT rule_id, count(*) FILTER (WHERE diff > 0) AS up, count(*) FILTER (WHERE diff < 0) AS down FROM rule_diff GROUP BY 1"))
def t13(spark, d):
    return T.rule_movement(T.strategy_rule_diff(local_introduced(spark, d)))


def _rates_sql(by):
    b = ", ".join(by)
    return f"""WITH n AS (SELECT {b}, count(*) AS r FROM checkpoints WHERE session_id <> 'baseline' GROUP BY {b}), f AS (SELECT {b}, {_CAT} AS category, sum(n) AS s FROM changes WHERE {LOCAL} GROUP BY {b}, category),
rates AS (SELECT {', '.join('n.' + x for x in by)}, k.category, round(coalesce(f.s, 0) / n.r, 6) AS rate FROM n CROSS JOIN (SELECT DISTINCT category FROM f) k LEFT JOIN f ON {' AND '.join(f'f.{x} = n.{x}' for x in by)} AND f.category = k.category)"""


@query("t14_violation_rate_matrix", with_sql("changes", _rates_sql(["agent", "strategy"]) + " SELECT * FROM rates"))
def t14(spark, d):
    cp, base = steps(spark, d)
    return T.violation_rates(local_introduced(spark, d, cp, base), cp, ["agent", "strategy"])


@query("t15_agent_profile", with_sql("changes", _rates_sql(["agent"]) + " SELECT *, rank() OVER (PARTITION BY agent ORDER BY rate) + (count(*) OVER (PARTITION BY agent, rate) - 1) / 2 AS rank FROM rates"))
def t15(spark, d):
    cp, base = steps(spark, d)
    return T.agent_profile(T.violation_rates(local_introduced(spark, d, cp, base), cp, ["agent"]))


@query("t16_metric_bounds", with_sql("bounds", "SELECT * FROM bounds"))
def t16(spark, d):
    return bounds(spark, d)


@query("t17_outliers", with_sql("bounds", "SELECT o.evaluation_id, metric_name, coalesce(value < iqr_low OR value > iqr_high, false) AS outlier FROM observations o JOIN bounds b USING (metric_name)"))
def t17(spark, d):
    return observations(spark, d).join(F.broadcast(bounds(spark, d).drop("direction")), "metric_name").select("evaluation_id", "metric_name", T.is_outlier(F.col("value"), F.col("iqr_low"), F.col("iqr_high")).alias("outlier"))


_PAIRS_SQL = """sp AS (SELECT agent, task_id, avg(run_local_introduced_count) FILTER (WHERE strategy = 'minimal') AS minimal, avg(run_local_introduced_count) FILTER (WHERE strategy = 'structured') AS structured FROM runs WHERE session_id <> 'baseline' GROUP BY 1, 2 HAVING minimal IS NOT NULL AND structured IS NOT NULL)"""


@query("t18_strategy_pairs", with_sql("runs", f"WITH {_PAIRS_SQL} SELECT agent, task_id, round(minimal, 6) AS minimal, round(structured, 6) AS structured FROM sp"))
def t18(spark, d):
    return T.strategy_pairs(runs(spark, d)).select("agent", "task_id", F.round("minimal", 6).alias("minimal"), F.round("structured", 6).alias("structured"))


@query("t19_signed_ranks", with_sql("runs", f"""WITH {_PAIRS_SQL}, d AS (SELECT agent, round(structured - minimal, 9) AS d FROM sp UNION ALL SELECT NULL, round(structured - minimal, 9) FROM sp),
r AS (SELECT agent, d, rank() OVER (PARTITION BY agent ORDER BY abs(d)) + (count(*) OVER (PARTITION BY agent, abs(d)) - 1) / 2 AS k FROM d WHERE d <> 0),
w AS (SELECT agent, least(coalesce(sum(k) FILTER (WHERE d > 0), 0), coalesce(sum(k) FILTER (WHERE d < 0), 0)) AS statistic FROM r GROUP BY 1), m AS (SELECT agent, count(*) AS n_pairs, median(d) AS median_diff FROM d GROUP BY 1)
SELECT m.agent, n_pairs, coalesce(statistic, 0) AS statistic, round(median_diff, 6) AS median_diff FROM m LEFT JOIN w ON m.agent IS NOT DISTINCT FROM w.agent"""))
def t19(spark, d):
    return T.signed_ranks(T.strategy_pairs(runs(spark, d))).select("agent", "n_pairs", "statistic", F.round("median_diff", 6).alias("median_diff"))


#: Up to 50 differences the ways to each doubled rank sum, one rank at a time; beyond it the normal approximation, erfc as a series.
_WILCOXON = f"""{_PAIRS_SQL}, d AS (SELECT agent, round(structured - minimal, 9) AS d FROM sp UNION ALL SELECT NULL, round(structured - minimal, 9) FROM sp),
r AS (SELECT coalesce(agent, '*') AS agent, d, rank() OVER (PARTITION BY agent ORDER BY abs(d)) + (count(*) OVER (PARTITION BY agent, abs(d)) - 1) / 2 AS k, count(*) OVER (PARTITION BY agent, abs(d)) AS t, row_number() OVER (PARTITION BY agent ORDER BY abs(d), d) AS i FROM d WHERE d <> 0),
w AS (SELECT agent, count(*) AS n, least(coalesce(sum(k) FILTER (WHERE d > 0), 0), coalesce(sum(k) FILTER (WHERE d < 0), 0)) AS statistic, sum(t * t - 1) AS ties, list(CAST(round(2 * k) AS BIGINT) ORDER BY i) AS halves FROM r GROUP BY 1),
ways(agent, i, s, c) AS (SELECT agent, 0, CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM w WHERE n <= 50 UNION ALL SELECT * FROM (SELECT agent, i, s, sum(c) AS c FROM (SELECT x.agent, x.i + 1 AS i, x.s + f * w.halves[x.i + 1] AS s, c FROM ways x JOIN w ON w.agent = x.agent, (VALUES (0), (1)) y(f) WHERE x.i < w.n) t GROUP BY 1, 2, 3) u),
exact AS (SELECT x.agent, sum(c) FILTER (WHERE least(s, CAST(list_sum(halves) AS BIGINT) - s) <= 2 * statistic + 1e-9) / pow(2, any_value(n)) AS p FROM ways x JOIN w ON w.agent = x.agent WHERE x.i = w.n GROUP BY 1),
z AS (SELECT agent, abs(statistic - n * (n + 1) / 4) / sqrt(2 * (n * (n + 1) * (2 * n + 1) / 24 - ties / 48)) AS x FROM w WHERE n > 50), ser(agent, x, k, t, s) AS (SELECT agent, x, 0, x, x FROM z UNION ALL SELECT agent, x, k + 1, t * 2 * x * x / (2 * k + 3), s + t * 2 * x * x / (2 * k + 3) FROM ser WHERE k < 300),
p AS (SELECT agent, least(1, p) AS p FROM exact UNION ALL SELECT agent, least(1, 1 - 2 / sqrt(pi()) * exp(-x * x) * max(s)) FROM ser GROUP BY agent, x),
m AS (SELECT agent, count(*) AS n_pairs, median(d) AS median_diff FROM d GROUP BY 1)
SELECT m.agent, n_pairs, CASE WHEN n_pairs >= 2 THEN coalesce(statistic, 0) END AS statistic, CASE WHEN n_pairs >= 2 THEN round(coalesce(p, 1), 9) END AS p_value, CASE WHEN n_pairs >= 2 THEN round(median_diff, 6) END AS median_diff,
 CASE WHEN n_pairs < 2 THEN 'fewer than 2 complete pairs' WHEN n IS NULL THEN 'all paired differences are zero' END AS note FROM m LEFT JOIN w ON w.agent = coalesce(m.agent, '*') LEFT JOIN p ON p.agent = w.agent"""


@query("t19_paired_wilcoxon", with_sql("runs", f"WITH {_WILCOXON}").replace("WITH ", "WITH RECURSIVE ", 1))
def t19_p(spark, d):
    out = T.paired_wilcoxon(T.strategy_pairs(runs(spark, d)))
    return out.withColumns({"p_value": F.round("p_value", 9), "median_diff": F.round("median_diff", 6)})


@query("trajectory_totals", with_sql("runs", "SELECT session_id, agent, strategy, task_id, task_order, trajectory_introduced_count AS cumulative_introduced, trajectory_resolved_count AS cumulative_resolved FROM runs WHERE session_id <> 'baseline'"))
def t20(spark, d):
    return T.trajectory_totals(runs(spark, d))


@query("t21_trajectory_by_category", with_sql("changes", f"SELECT agent, strategy, task_id, {_CAT} AS category, CAST(sum(n) AS BIGINT) AS findings FROM changes WHERE {CUMULATIVE} GROUP BY 1, 2, 3, 4"))
def t21(spark, d):
    return T.trajectory_by_category(cumulative_introduced(spark, d))


@query("t22_trajectory_shape", with_sql("runs", """WITH d AS (SELECT session_id, task_order, trajectory_introduced_count AS v, trajectory_introduced_count - lag(trajectory_introduced_count) OVER w AS diff, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session_id) AS points FROM runs WHERE session_id <> 'baseline' WINDOW w AS (PARTITION BY session_id ORDER BY task_order)),
e AS (SELECT session_id, count(*) AS points, arg_max(v, task_order) AS last_value, avg(diff) FILTER (WHERE i >= 1 AND i <= greatest(1, (points - 1) // 2)) AS early, avg(diff) FILTER (WHERE i > greatest(1, (points - 1) // 2)) AS l, coalesce(max(abs(diff)), 0) AS largest FROM d GROUP BY 1), f AS (SELECT *, coalesce(l, early) AS late FROM e)
SELECT session_id, points, last_value, CASE WHEN points < 3 THEN 'insufficient_data' WHEN largest <= 1e-9 THEN 'flat' WHEN late > early + greatest(0.05 * (abs(early) + abs(late)), 1e-9) THEN 'accelerating' WHEN late < early - greatest(0.05 * (abs(early) + abs(late)), 1e-9) THEN 'plateau_or_decline' ELSE 'linear' END AS shape FROM f"""))
def t22(spark, d):
    return T.trajectory_shape(T.trajectory_totals(runs(spark, d)), ["session_id"])


@query("t23_silent_decay", with_sql("cells", "SELECT * FROM cells"))
def t23(spark, d):
    return cells(spark, d)


@query("t24_silent_decay_summary", with_sql("cells", """SELECT evaluation_id, count(*) FILTER (WHERE classification = 'indeterminate_metric_error') AS indeterminate_metric_error, count(*) FILTER (WHERE classification = 'constraints_failed') AS constraints_failed, count(*) FILTER (WHERE classification = 'silent_decay') AS silent_decay,
count(*) FILTER (WHERE classification = 'clean') AS clean, coalesce(string_agg(concern, ' | ' ORDER BY concern) FILTER (WHERE classification = 'silent_decay'), '') AS silent_decay_concerns, bool_or(classification = 'silent_decay') AS any_silent_decay FROM cells GROUP BY 1"""))
def t24(spark, d):
    return T.silent_decay_summary(cells(spark, d))


_CONC = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY n, file) AS i, count(*) OVER (PARTITION BY evaluation_id) AS f FROM files),
conc AS (SELECT evaluation_id, count(*) AS files, CAST(sum(n) AS BIGINT) AS findings, round((count(*) + 1 - 2 * sum((f - i + 1) * n) / sum(n)) / count(*), 6) AS gini, first(file ORDER BY n DESC, file) AS top_file, round(max(n) / sum(n), 6) AS top_file_share FROM r GROUP BY 1)"""


@query("t25_file_concentration", with_sql("files", _CONC + " SELECT * FROM conc"))
def t25(spark, d):
    return T.file_concentration(files(spark, d))


@query("t26_file_blame", with_sql("files", _CONC + " SELECT file, CAST(sum(n) AS BIGINT) AS findings, count(*) AS runs, (SELECT count(*) FROM conc WHERE top_file = x.file) AS times_top, round(100 * sum(n) / (SELECT sum(n) FROM files), 6) AS share_percent FROM files x GROUP BY 1"))
def t26(spark, d):
    return T.file_blame(files(spark, d), T.file_concentration(files(spark, d)))


@query("t27_lorenz_points", with_sql("files", """SELECT evaluation_id, count(*) OVER w AS i, round(count(*) OVER w / count(*) OVER (PARTITION BY evaluation_id), 6) AS file_share, round(sum(n) OVER w / sum(n) OVER (PARTITION BY evaluation_id), 6) AS finding_share FROM files WINDOW w AS (PARTITION BY evaluation_id ORDER BY n, file ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT DISTINCT evaluation_id, 0, 0.0, 0.0 FROM files"""))
def t27(spark, d):
    return T.lorenz_points(files(spark, d))


@query("t28_metric_correlation", with_sql("observations", "WITH s AS (SELECT metric_name FROM observations GROUP BY 1 HAVING min(value) < max(value)), k AS (SELECT metric_name, row_number() OVER (ORDER BY CASE left(metric_name, 6) WHEN 'BE-DUP' THEN 1 WHEN 'FE-STA' THEN 2 WHEN 'BE-SIZ' THEN 3 WHEN 'CROSS-' THEN 4 ELSE 5 END) AS o FROM s) SELECT a.metric_name AS metric_a, b.metric_name AS metric_b, round(corr(x.value, y.value), 6) AS r FROM k a JOIN k b ON a.o <= b.o JOIN observations x ON x.metric_name = a.metric_name JOIN observations y ON y.metric_name = b.metric_name AND x.evaluation_id = y.evaluation_id GROUP BY 1, 2"))
def t28(spark, d):
    return T.metric_correlation(observations(spark, d), METRICS)


#: Metrics that are not named beforehand: the part brands of the line items of a month, each with its mean discount in every nation.
_BRANDS = """bo AS (SELECT c_nationkey || '-' || strftime(l_shipdate, '%Y-%m') AS evaluation_id, p_brand || '-' || l_returnflag AS metric_name, avg(l_discount) AS value FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


def brand_observations(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    cell = F.concat_ws("-", F.col("c_nationkey"), F.date_format("l_shipdate", "yyyy-MM"))
    return rows.groupBy(cell.alias("evaluation_id"), F.concat_ws("-", "p_brand", "l_returnflag").alias("metric_name")).agg(F.avg("l_discount").alias("value"))


@query("t28_brand_correlation", f"WITH {_BRANDS}, s AS (SELECT metric_name FROM bo GROUP BY 1 HAVING min(value) < max(value)) SELECT a.metric_name AS metric_a, b.metric_name AS metric_b, CASE WHEN count(*) > 1 THEN round(corr(a.value, b.value), 6) + 0.0 END AS r FROM bo a JOIN bo b ON a.evaluation_id = b.evaluation_id AND a.metric_name <= b.metric_name WHERE a.metric_name IN (SELECT * FROM s) AND b.metric_name IN (SELECT * FROM s) GROUP BY 1, 2")
def t28_brands(spark, d):
    return T.metric_correlation(brand_observations(spark, d)).withColumn("r", F.col("r") + 0.0)  # no negative zeros


#: Axes by powers of the Gram matrix: squared until only the first axis is left, which is then taken off. Sums of z-scores over complete cases.
_PCA = """ob AS (SELECT evaluation_id, metric_name, avg(value) AS v FROM observations WHERE value IS NOT NULL GROUP BY 1, 2), mk AS (SELECT metric_name, row_number() OVER (ORDER BY CASE left(metric_name, 6) WHEN 'BE-DUP' THEN 1 WHEN 'FE-STA' THEN 2 WHEN 'BE-SIZ' THEN 3 WHEN 'CROSS-' THEN 4 ELSE 5 END) AS i FROM ob GROUP BY metric_name),
cc AS (SELECT evaluation_id, v, i FROM ob JOIN mk USING (metric_name) WHERE evaluation_id IN (SELECT evaluation_id FROM ob GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM mk))),
zs AS (SELECT evaluation_id, i, (v - avg(v) OVER (PARTITION BY i)) / CASE WHEN stddev_pop(v) OVER (PARTITION BY i) = 0 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY i) END AS z FROM cc),
g AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS row FROM (SELECT a.i, b.i AS j, sum(a.z * b.z) / count(*) AS s FROM zs a JOIN zs b USING (evaluation_id) GROUP BY 1, 2) GROUP BY 1)),
sq(c, k, left_, m) AS (SELECT 1, 0, m, m FROM g
 UNION ALL SELECT CASE WHEN k = 40 THEN c + 1 ELSE c END, CASE WHEN k = 40 THEN 0 ELSE k + 1 END, nl, CASE WHEN k = 40 THEN nl ELSE list_transform(m2, lambda r: list_transform(r, lambda x: x / tr)) END
  FROM (SELECT *, list_sum(list_transform(range(1, len(m2) + 1), lambda i: m2[i][i])) AS tr FROM (SELECT *, list_transform(m, lambda r: list_transform(range(1, len(r) + 1), lambda j: list_sum(list_transform(range(1, len(r) + 1), lambda l: r[l] * m[l][j])))) AS m2,
   CASE WHEN k = 40 THEN list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: left_[i][j] - lam * m[i][j])) ELSE left_ END AS nl
   FROM (SELECT *, list_sum(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(range(1, len(m) + 1), lambda j: left_[i][j] * m[j][i])))) AS lam FROM sq)) t WHERE c <= len(m)) u),
ax AS (SELECT c, lam, list_transform(range(1, len(m) + 1), lambda i: m[i][p] / sqrt(m[p][p])) AS v FROM (SELECT *, list_position(diag, list_max(diag)) AS p FROM (SELECT c, m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS diag,
  list_sum(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(range(1, len(m) + 1), lambda j: left_[i][j] * m[j][i])))) AS lam FROM sq WHERE k = 40 AND c <= len(m)) t) u)"""


@query("t29_metric_pca", with_sql("observations", f"WITH {_PCA} SELECT CAST(c AS INTEGER) AS component, round(lam / sum(lam) OVER (), 6) AS explained_share FROM ax").replace("WITH ", "WITH RECURSIVE ", 1))
def t29(spark, d):
    found = T.metric_pca(observations(spark, d), METRICS)
    return spark.createDataFrame([], "component int, explained_share double") if found is None else found[0].withColumn("explained_share", F.round("explained_share", 6))


@query("t29_metric_pca_scores", with_sql("observations", f"WITH {_PCA} SELECT evaluation_id, round(sum(z * v[i]) FILTER (WHERE c = 1), 6) AS pc1, round(sum(z * v[i]) FILTER (WHERE c = 2), 6) AS pc2 FROM zs, ax WHERE c <= 2 GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1))
def t29_scores(spark, d):
    found = T.metric_pca(observations(spark, d), METRICS)
    return spark.createDataFrame([], "evaluation_id string, pc1 double, pc2 double") if found is None else found[2].select("evaluation_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("t30_review_ground_truth", with_sql("runs reviews", "SELECT v.session_id, n_findings, total_findings_absolute, coalesce(n_findings = 0 AND total_findings_absolute > 0, false) AS blind_spot, coalesce(n_findings < total_findings_absolute, false) AS under_reported FROM reviews v LEFT JOIN runs r ON r.session_id = v.session_id AND r.task_id = 'T3'"))
def t30(spark, d):
    return T.review_ground_truth(B.reviews(spark, d), runs(spark, d))


_MATCH = """WITH f AS (SELECT DISTINCT session_id, regexp_extract(file, '([^/]*)/*$', 1) AS name FROM findings WHERE task_id = 'T3'), x AS (SELECT session_id, finding_id, regexp_extract(trim(unnest(string_split(referenced_files, ';'))), '([^/]*)/*$', 1) AS name FROM review_findings),
m AS (SELECT x.session_id, x.finding_id, bool_or(f.name IS NOT NULL) AS hit FROM x LEFT JOIN f USING (session_id, name) GROUP BY 1, 2)"""


@query("t31_review_location_overlap", with_sql("findings review_findings", _MATCH + " SELECT session_id, count(*) FILTER (WHERE hit) AS matches, count(*) AS findings, round(count(*) FILTER (WHERE hit) / count(*), 6) AS overlap FROM m GROUP BY 1"))
def t31(spark, d):
    return T.review_location_overlap(T.location_matches(B.review_findings(spark, d), findings(spark, d)))
