"""Queries of the canonical datasets, audits and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import dims
from waymark.functions.checkpoints import settled
from waymark.operators import datasets as C
from waymark.operators import stages as T
from waymark.plans import bindings as B
from waymark.plans.bindings import completion, findings, observations, with_sql
from waymark.plans.core import query
from waymark.plans.q_diff import FAILURES_SQL, changes, compared, failures, local_introduced, runs, steps
from waymark.plans.q_stages import _MATCH, cells, files

_LABEL = "upper(left(agent, 1)) || substr(agent, 2) || ' ' || upper(left(strategy, 1)) || substr(strategy, 2)"
TASKS = ["T1", "T2", "T3"]

B.SQL["dataset_a"] = f"""dataset_a AS (SELECT r.evaluation_id, {_LABEL.replace('agent', 'r.agent').replace('strategy', 'r.strategy')} AS condition, r.session_id, r.agent, r.strategy, r.task_id AS task, r.task_order, c.test_status AS functional_acceptance, test_cases_total, test_cases_passed, test_cases_failed,
 total_findings_absolute AS absolute_finding_count, run_local_introduced_count AS task_local_introduced_findings, run_local_resolved_count AS task_local_resolved_findings, run_local_net_change AS task_local_net_change, trajectory_introduced_count AS baseline_relative_introduced_findings,
 trajectory_resolved_count AS baseline_relative_resolved_findings, trajectory_net_change AS baseline_relative_net_change FROM runs r LEFT JOIN completion c USING (session_id, task_id) WHERE session_id <> 'baseline')"""
_SUM = "CAST(coalesce(sum(n) FILTER (WHERE delta_scope = '{}' AND change_type = '{}'), 0) AS BIGINT) AS {}"
B.SQL["dataset_b"] = f"""bc AS (SELECT evaluation_id, regexp_extract(rule_id, '^(.*)-C-001$', 1) AS concern, {_SUM.format('absolute', 'current', 'a')}, {_SUM.format('run_local', 'introduced', 'i')}, {_SUM.format('run_local', 'resolved', 'r')}, {_SUM.format('trajectory_cumulative', 'introduced', 'bi')}, {_SUM.format('trajectory_cumulative', 'resolved', 'br')} FROM changes GROUP BY 1, 2),
dataset_b AS (SELECT c.evaluation_id, c.agent, c.strategy, c.task_id, k.concern, coalesce(a, 0) AS absolute_finding_count, coalesce(i, 0) AS task_local_introduced_findings, coalesce(r, 0) AS task_local_resolved_findings, coalesce(bi, 0) AS baseline_relative_introduced_findings, coalesce(br, 0) AS baseline_relative_resolved_findings,
 coalesce(i - r, 0) AS task_local_net_change, coalesce(bi - br, 0) AS baseline_relative_net_change FROM checkpoints c CROSS JOIN concerns k LEFT JOIN bc ON bc.evaluation_id = c.evaluation_id AND bc.concern = k.concern WHERE c.session_id <> 'baseline')"""
B.SQL["dataset_c"] = f"""dc AS (SELECT o.*, regexp_extract(o.metric_name, '^(BE|FE|CROSS)-[A-Z]+') AS concern, b.iqr_low, b.iqr_high, b.n AS n_observations, coalesce(CASE WHEN o.direction = 'higher_is_better' THEN value < iqr_low ELSE value > iqr_high END, false) AS bad,
 (SELECT value FROM observations z WHERE z.session_id = 'baseline' AND z.metric_name = o.metric_name) AS base FROM observations o LEFT JOIN bounds b ON b.metric_name = o.metric_name WHERE session_id <> 'baseline'),
dataset_c AS (SELECT dc.evaluation_id, {_LABEL.replace('agent', 'dc.agent').replace('strategy', 'dc.strategy')} AS condition, dc.task_id AS task, dc.concern, metric_name AS metric_id, status AS metric_status, value AS raw_value, base AS baseline_value, round(value - base, 6) AS baseline_relative_delta, n_observations,
 CASE WHEN direction = 'higher_is_better' THEN iqr_low ELSE iqr_high END AS adverse_fence, bad AS metric_bad_outlier, coalesce(x.task_local_introduced_findings > 0, false) AS constraint_failure, status <> 'error' AND NOT coalesce(x.task_local_introduced_findings > 0, false) AND bad AS silent_decay
 FROM dc LEFT JOIN dataset_b x ON x.evaluation_id = dc.evaluation_id AND x.concern = dc.concern)"""
B.SQL["matches"] = _MATCH[5:].replace("m AS (", "matches AS (")
B.SQL["dataset_e"] = """loc AS (SELECT session_id, count(*) FILTER (WHERE hit) AS location_matches, count(*) AS location_observations FROM matches GROUP BY 1),
spent AS (SELECT session_id, count(DISTINCT task_id) AS development_task_count, round(sum(duration_seconds), 3) AS development_duration_seconds, round(sum(cost_usd), 5) AS development_cost_usd, CASE WHEN count(DISTINCT cost_basis) = 1 THEN min(cost_basis) ELSE 'mixed' END AS cost_basis FROM completion WHERE task_id IN ('T1', 'T2', 'T3') GROUP BY 1),
dataset_e AS (SELECT v.session_id, n_findings AS self_reported_finding_count, r.total_findings_absolute AS absolute_finding_count, round(CASE WHEN r.total_findings_absolute > 0 THEN n_findings / r.total_findings_absolute END, 6) AS self_report_coverage, location_matches, location_observations, round(location_matches / location_observations, 6) AS location_agreement,
 development_task_count, development_duration_seconds, development_cost_usd, cost_basis FROM reviews v LEFT JOIN runs r ON r.session_id = v.session_id AND r.task_id = 'T3' LEFT JOIN loc ON loc.session_id = v.session_id LEFT JOIN spent s ON s.session_id = v.session_id)"""
B._NEEDS |= {"dataset_a": ["runs", "completion"], "dataset_b": ["changes", "concerns"], "dataset_c": ["dataset_b", "bounds"], "matches": ["findings", "review_findings"], "dataset_e": ["matches", "runs", "completion"]}


def dataset_a(spark, d, cp=None, base=None, rows=None):
    cp, base = steps(spark, d) if cp is None else (cp, base)
    return C.dataset_a(runs(spark, d, cp, base, rows), completion(spark, d, cp))


def dataset_b(spark, d, cp=None, base=None, rows=None):
    cp, base = steps(spark, d) if cp is None else (cp, base)
    return C.dataset_b(cp, changes(spark, d, cp, base, rows), dims.concerns(spark))


def both(spark, d):
    """What datasets A and B are made of: checkpoints, the baseline's counts, and the findings beside their neighbours', all settled."""
    cp, base = steps(spark, d)
    return cp, base, settled(compared(spark, d, cp, base))


def with_runs(spark, d):
    """Dataset A and the runs it is made of, which are computed once."""
    cp, base = steps(spark, d)
    made = settled(runs(spark, d, cp, base))
    return C.dataset_a(made, completion(spark, d, cp)), made


def dataset_c(spark, d):
    """Of dataset B only the concerns that a checkpoint's own task failed are needed."""
    cp, base = steps(spark, d)
    metrics = settled(observations(spark, d, cp))
    return C.dataset_c(metrics, T.metric_bounds(metrics), C.failed_concerns(local_introduced(spark, d, cp, base)))


def dataset_e(spark, d, cp=None, base=None, rows=None):
    cp, base = steps(spark, d) if cp is None else (cp, base)
    matches = T.location_matches(B.review_findings(spark, d), findings(spark, d, cp))
    return C.dataset_e(B.reviews(spark, d), runs(spark, d, cp, base, rows), matches, completion(spark, d, cp), TASKS)


@query("c01_dataset_a", with_sql("dataset_a", "SELECT * FROM dataset_a"))
def c01(spark, d):
    return dataset_a(spark, d)


@query("c02_audit_a", with_sql("dataset_a", "SELECT evaluation_id, true AS task_local_net_identity, true AS baseline_relative_net_identity, absolute_finding_count = coalesce(lag(absolute_finding_count) OVER (PARTITION BY session_id ORDER BY task_order), (SELECT total_findings_absolute FROM runs WHERE session_id = 'baseline')) + task_local_net_change AS absolute_from_local_identity, absolute_finding_count = (SELECT total_findings_absolute FROM runs WHERE session_id = 'baseline') + baseline_relative_net_change AS absolute_from_baseline_identity FROM dataset_a"))
def c02(spark, d):
    a, made = with_runs(spark, d)
    return C.audit_a(a, made.where("session_id = 'baseline'").select(F.col("total_findings_absolute").alias("base")))


@query("c03_dataset_b", with_sql("dataset_b", "SELECT * FROM dataset_b"))
def c03(spark, d):
    return dataset_b(spark, d)


@query("c04_audit_b", with_sql("dataset_a dataset_b", "SELECT a.evaluation_id, a.absolute_finding_count = sum(b.absolute_finding_count) AND a.task_local_introduced_findings = sum(b.task_local_introduced_findings) AND a.baseline_relative_resolved_findings = sum(b.baseline_relative_resolved_findings) AS agrees FROM dataset_a a JOIN dataset_b b USING (evaluation_id) GROUP BY a.evaluation_id, a.absolute_finding_count, a.task_local_introduced_findings, a.baseline_relative_resolved_findings"))
def c04(spark, d):
    made = both(spark, d)
    return C.audit_b(dataset_b(spark, d, *made), dataset_a(spark, d, *made))


@query("c05_dataset_c", with_sql("dataset_c", "SELECT * FROM dataset_c"))
def c05(spark, d):
    return dataset_c(spark, d)


@query("c06_dataset_d", with_sql("files", "SELECT evaluation_id, file, n, round(n / sum(n) OVER w, 6) AS file_share, round(max(n) OVER w / sum(n) OVER w, 6) AS top_file_share, n = max(n) OVER w AS is_top_file FROM files WINDOW w AS (PARTITION BY evaluation_id)"))
def c06(spark, d):
    return C.dataset_d(files(spark, d))


@query("c07_dataset_e", with_sql("reviews dataset_e", "SELECT * FROM dataset_e"))
def c07(spark, d):
    return dataset_e(spark, d)


@query("c08_key_audit", with_sql("dataset_a dataset_b", "SELECT 'A' AS dataset, count(*) AS rows, 18 AS columns, CAST(0 AS BIGINT) AS duplicate_keys FROM dataset_a UNION ALL SELECT 'B', count(*), 12, 0 FROM dataset_b UNION ALL SELECT 'E', (SELECT count(*) FROM customer), 11, 0"))
def c08(spark, d):
    made = both(spark, d)
    return C.key_audit(dataset_a(spark, d, *made), "A", ["evaluation_id"]).unionByName(C.key_audit(dataset_b(spark, d, *made), "B", ["evaluation_id", "concern"])).unionByName(C.key_audit(dataset_e(spark, d, *made), "E", ["session_id"]))


_ACCEPT = "CASE WHEN test_cases_passed IS NOT NULL THEN upper(left(functional_acceptance, 1)) || substr(functional_acceptance, 2) || ' (' || test_cases_passed || '/' || test_cases_total || ')' ELSE 'No data' END"


@query("c09_checkpoint_table", with_sql("dataset_a", f"SELECT 'Baseline' AS condition, 'E0' AS checkpoint, '—' AS acceptance, total_findings_absolute AS findings FROM runs WHERE session_id = 'baseline' UNION ALL SELECT condition, 'E' || task_order, {_ACCEPT}, absolute_finding_count FROM dataset_a"))
def c09(spark, d):
    return C.checkpoint_table(*with_runs(spark, d))


@query("c10_silent_cases", with_sql("dataset_c", "SELECT condition, 'E' || substr(task, 2) AS checkpoint, concern, metric_id, raw_value, adverse_fence, CASE WHEN baseline_value <> 0 THEN printf('%+.1f%%', 100 * baseline_relative_delta / baseline_value) ELSE 'n/a' END AS change FROM dataset_c WHERE silent_decay"))
def c10(spark, d):
    return C.silent_cases(dataset_c(spark, d))


@query("c11_calibration", with_sql("reviews dataset_e", "SELECT session_id, concat_ws('/', self_reported_finding_count, absolute_finding_count) AS reported, greatest(absolute_finding_count - self_reported_finding_count, CASE WHEN absolute_finding_count IS NOT NULL THEN 0 END) AS under_reported, round(greatest(absolute_finding_count - self_reported_finding_count, CASE WHEN absolute_finding_count IS NOT NULL THEN 0 END) / nullif(absolute_finding_count, 0), 6) AS under_reporting_rate FROM dataset_e"))
def c11(spark, d):
    return C.calibration(dataset_e(spark, d))


@query("c12_trajectory_with_origin", with_sql("runs", f"WITH r AS (SELECT {_LABEL} AS condition, task_order, trajectory_introduced_count AS v FROM runs WHERE session_id <> 'baseline') SELECT condition, 'E' || task_order AS checkpoint, round(avg(v), 6) AS mean_findings FROM (SELECT * FROM r UNION ALL SELECT DISTINCT condition, 0, 0 FROM r) GROUP BY 1, 2"))
def c12(spark, d):
    return C.trajectory_with_origin(T.trajectory_totals(runs(spark, d)))


@query("c13_concern_totals", with_sql("dataset_b", f"SELECT * FROM (SELECT concern, {_LABEL} AS condition, CAST(sum(task_local_introduced_findings) AS BIGINT) AS introduced, CAST(sum(sum(task_local_introduced_findings)) OVER (PARTITION BY concern) AS BIGINT) AS total FROM dataset_b GROUP BY 1, 2) WHERE total > 0"))
def c13(spark, d):
    cp, base = steps(spark, d)
    return C.concern_totals(C.introduced_by_condition(cp, local_introduced(spark, d, cp, base), dims.concerns(spark)))


@query("c14_prompt_delta", with_sql("dataset_a", "SELECT agent, task, round(avg(task_local_introduced_findings) FILTER (WHERE strategy = 'structured') - avg(task_local_introduced_findings) FILTER (WHERE strategy = 'minimal'), 6) AS delta FROM dataset_a GROUP BY 1, 2 HAVING delta IS NOT NULL"))
def c14(spark, d):
    return C.prompt_delta(dataset_a(spark, d))


@query("c15_flagged_metrics", with_sql("dataset_c", "SELECT concern, metric_id, count(*) FILTER (WHERE metric_bad_outlier) AS flagged, count(*) FILTER (WHERE silent_decay) AS silent, count(*) FILTER (WHERE metric_bad_outlier AND constraint_failure) AS with_failure FROM dataset_c GROUP BY 1, 2"))
def c15(spark, d):
    return C.flagged_metrics(dataset_c(spark, d))


_STATE = "(['Clean', 'Silent', 'Failure'])[max(r) FILTER (WHERE task_id = '{}') + 1] AS {}"


@query("c16_state_matrix", with_sql("cells", f"WITH x AS (SELECT {_LABEL} AS condition, concern, task_id, CASE classification WHEN 'constraints_failed' THEN 2 WHEN 'silent_decay' THEN 1 ELSE 0 END AS r FROM cells) SELECT condition, concern, 'Clean' AS E0, {', '.join(_STATE.format(t, t.replace('T', 'E')) for t in TASKS)} FROM x GROUP BY 1, 2"))
def c16(spark, d):
    return C.state_matrix(cells(spark, d), TASKS)


def _suites(spark, d):
    listed = F.filter(F.array(F.when(F.col("test_cases_failed") > 1, "backend"), F.when(F.col("test_cases_failed") > 2, "frontend")), lambda s: s.isNotNull())
    outcomes = F.when(F.col("test_cases_failed") == 1, "adapted_pass | pass").otherwise("pass")
    return completion(spark, d).withColumns({"failed_suites": listed, "adapter_outcomes": outcomes})


@query("c17_pass_rates", with_sql("completion", "SELECT agent, strategy, round(count(*) FILTER (WHERE test_cases_failed <= 1 AND test_status <> 'error') / count(*), 6) AS backend, round(count(*) FILTER (WHERE test_cases_failed <= 2 AND test_status <> 'error') / count(*), 6) AS frontend FROM completion GROUP BY 1, 2"))
def c17(spark, d):
    return C.pass_rates(C.suite_results(_suites(spark, d), ["backend", "frontend"]), ["backend", "frontend"])


@query("c18_adapted_passes", with_sql("completion", "SELECT agent, strategy, count(*) AS adapted FROM completion WHERE test_cases_failed = 1 GROUP BY 1, 2"))
def c18(spark, d):
    return C.adapted_passes(_suites(spark, d))


_ATTR = ["interface_unresolved", "interface_contract_variance", "requirement_noncompliance_candidate", "infrastructure_error"]


@query("c19_attribution_profile", f"WITH {FAILURES_SQL} SELECT event_type, raw_classification, {', '.join(f'count(*) FILTER (WHERE attribution = {a!r}) AS {a}' for a in _ATTR)} FROM fl GROUP BY 1, 2")
def c19(spark, d):
    return C.attribution_profile(failures(spark, d), ["event_type", "raw_classification"], _ATTR)


@query("c20_problem_summary", f"""WITH {FAILURES_SQL} SELECT CASE WHEN event_type = 'adapter_unresolved' THEN 'Contact-company request-field adapter gap' ELSE 'Other behavioral assertion' END AS problem, count(*) AS events, count(DISTINCT l_orderkey) AS task_runs, count(*) FILTER (WHERE cascade_candidate) AS cascade_events, string_agg(DISTINCT raw_classification, ', ' ORDER BY raw_classification) AS classes FROM fl GROUP BY 1""")
def c20(spark, d):
    return C.problem_summary(failures(spark, d), ["l_orderkey"])


@query("c21_cascade_summary", f"WITH {FAILURES_SQL} SELECT event_type, count(*) AS events, max(suite_failure_rate) AS largest_rate, CAST(NULL AS INTEGER) AS first_checkpoint FROM fl WHERE cascade_candidate GROUP BY 1")
def c21(spark, d):
    return C.cascade_summary(failures(spark, d), ["event_type"])


@query("c22_manual_override", f"WITH {FAILURES_SQL} SELECT l_orderkey, suite_id, failure_id, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND failure_id = 'f1' AND suite_id <> 'all' THEN 'requirement_noncompliance_confirmed' ELSE attribution END AS adjudicated_attribution FROM fl")
def c22(spark, d):
    events = failures(spark, d)
    urgent = B.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    judged = events.where("failure_id = 'f1' and suite_id <> 'all'").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "suite_id", "failure_id").distinct().withColumn("attribution", F.lit("requirement_noncompliance_confirmed"))
    return C.with_overrides(events, judged, ["l_orderkey", "suite_id", "failure_id"]).select("l_orderkey", "suite_id", "failure_id", "adjudicated_attribution")


@query("c23_review_queue", f"WITH {FAILURES_SQL} SELECT l_orderkey, suite_id, failure_id, attribution, cascade_candidate FROM fl ORDER BY CASE attribution WHEN 'interface_unresolved' THEN 0 WHEN 'interface_contract_variance' THEN 1 WHEN 'requirement_noncompliance_candidate' THEN 3 ELSE 4 END, cascade_candidate DESC, l_orderkey, suite_id, failure_id LIMIT 40")
def c23(spark, d):
    return C.review_queue(failures(spark, d), ["l_orderkey", "suite_id", "failure_id"]).select("l_orderkey", "suite_id", "failure_id", "attribution", "cascade_candidate")


@query("c24_busiest_run", f"WITH {FAILURES_SQL} SELECT l_orderkey, suite_id, failure_id, event_type FROM fl WHERE l_orderkey = (SELECT l_orderkey FROM fl GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def c24(spark, d):
    return C.busiest_run(failures(spark, d), ["l_orderkey"]).select("l_orderkey", "suite_id", "failure_id", "event_type")


@query("c25_acceptance_summary", B.with_sql("completion", f"WITH {FAILURES_SQL} SELECT (SELECT count(*) FROM completion) AS selected_task_runs, (SELECT count(*) FROM completion WHERE test_status = 'pass') AS passed_task_runs, (SELECT count(*) FROM completion WHERE test_status = 'fail') AS failed_task_runs, count(*) FILTER (WHERE attribution = 'interface_unresolved') AS unresolved_interface_events, count(*) FILTER (WHERE attribution = 'requirement_noncompliance_candidate') AS requirement_noncompliance_candidates, count(*) FILTER (WHERE cascade_candidate) AS cascade_candidate_events, 0 AS manual_overrides_applied FROM fl"))
def c25(spark, d):
    return C.acceptance_summary(completion(spark, d), failures(spark, d))


@query("c26_cost_totals", with_sql("completion", "SELECT agent, strategy, round(sum(duration_seconds) / 60, 3) AS minutes, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 5) AS cost_usd, count(*) FILTER (WHERE cost_basis LIKE 'estimated%') AS estimated_rows FROM completion GROUP BY ROLLUP (agent, strategy)"))
def c26(spark, d):
    return C.cost_totals(completion(spark, d))


@query("c27_metric_grid", with_sql("dataset_c", "SELECT concern, metric_id, condition, round(avg(raw_value), 6) AS mean_value, count(*) FILTER (WHERE raw_value <> 0) AS non_zero, count(*) FILTER (WHERE metric_bad_outlier) AS bad_outliers FROM dataset_c GROUP BY 1, 2, 3"))
def c27(spark, d):
    return C.metric_grid(dataset_c(spark, d))


@query("c28_status_crosstab", with_sql("completion", f"""SELECT {_LABEL} AS condition, count(*) FILTER (WHERE test_status = 'pass') AS "pass", count(*) FILTER (WHERE test_status = 'fail') AS fail, count(*) FILTER (WHERE test_status = 'error') AS error FROM completion GROUP BY 1"""))
def c28(spark, d):
    return C.status_crosstab(completion(spark, d), ["pass", "fail", "error"])
