"""The driver's tables as checkpoints, findings, metric observations and CRM rows.

Each binding has a Spark form and, for the oracles, a DuckDB form of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.dims import CONCERNS
from waymark.operators.diff import IDENTITY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer in time are a session's checkpoints; the order of the least key is the baseline."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    least = F.broadcast(orders.agg(F.min("o_orderkey").alias("base_key")))  # one row
    agent_rows = orders.crossJoin(least).where("o_orderkey <> base_key").join(customer, "o_custkey").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    session, task = F.concat(F.lit("S"), F.col("o_custkey")), F.concat(F.lit("T"), F.col("n"))
    shared = [
        F.when(F.col("o_orderstatus") == "P", "partial").otherwise("completed").alias("execution_status"),
        F.col("o_orderkey").cast("string").alias("commit_id"),
        F.concat(F.lit("h"), F.col("o_orderkey") % 50 == 0).alias("profile_hash"),
        F.col("o_totalprice").cast("long").alias("duration_ms"),
        F.col("o_orderkey").alias("order_key"),
    ]
    agents = agent_rows.select(
        F.concat(session, F.lit("/"), task).alias("evaluation_id"), session.alias("session_id"), task.alias("task_id"), F.col("n").cast("int").alias("task_order"),
        F.lower("c_mktsegment").alias("agent"), F.when(F.col("o_custkey") % 2 == 0, "minimal").otherwise("structured").alias("strategy"), *shared,
    )
    base = customer.join(F.broadcast(orders.join(least, F.col("o_orderkey") == F.col("base_key"))), "o_custkey").select(
        F.lit("baseline/Base").alias("evaluation_id"), F.lit("baseline").alias("session_id"), F.lit("Base").alias("task_id"), F.lit(0).alias("task_order"),
        F.lit("none").alias("agent"), F.lit("none").alias("strategy"), *shared,
    )
    return agents.unionByName(base)


def findings(spark: SparkSession, sf_dir: str, cp: DataFrame | None = None) -> DataFrame:
    """Line items of an order are its checkpoint's findings; cp: the checkpoints, if a caller has them settled."""
    lines, cp = _lines(spark, sf_dir), checkpoints(spark, sf_dir) if cp is None else cp
    return lines.join(cp, lines.l_orderkey == cp.order_key).select(*[c for c in cp.columns if c != "order_key"], *IDENTITY, "l_linenumber")


def counted(spark: SparkSession, sf_dir: str, cp: DataFrame) -> DataFrame:
    """Findings with all columns of cp, counted by checkpoint and identity: line items are dealt out by order, counted there and then meet their checkpoints."""
    counts = _lines(spark, sf_dir).repartition("l_orderkey").groupBy("l_orderkey", *IDENTITY).agg(F.count("*").alias("n"))
    return counts.join(cp, counts.l_orderkey == cp.order_key).drop("l_orderkey", "order_key")


#: Line items that meet in one task, whatever the number of shuffle partitions.
ROWS_A_TASK = 200_000


def held_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints with `step`, their number within the session, `items`, their counted findings, `before`, those of the checkpoint before, and `cells`, all metrics of the session.

    Line items meet their orders by order key, and one row an order goes on to its session. What is gathered stays in its row, so nothing else is shuffled.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    parts = max((table(spark, sf_dir, "lineitem").count() + orders.count()) // ROWS_A_TASK, 1)
    counts = _lines(spark, sf_dir, parts).groupBy("l_orderkey", *IDENTITY).agg(F.count("*").alias("n"))
    items = counts.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.struct(*IDENTITY).alias("item"), "n")).alias("items"))
    least = F.broadcast(orders.agg(F.min("o_orderkey").alias("base_key")))  # one row
    held = orders.where("o_orderkey is not null").repartition(parts, "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    held = held.crossJoin(least).withColumn("owner", F.concat(F.lit("S"), F.col("o_custkey"))).repartition(parts, "owner")
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey")).alias("owner"), "c_mktsegment").repartition(parts, "owner")
    cells = _cells(spark, sf_dir).repartition(parts, "session_id").groupBy(F.col("session_id").alias("owner")).agg(F.collect_list(F.struct("task_order", "metric_name", "status", "value", "direction")).alias("cells"))
    is_base = F.col("o_orderkey") == F.col("base_key")
    w = Window.partitionBy("owner", "is_base").orderBy("o_orderdate", "o_orderkey")
    rows = held.join(customer, "owner").join(cells, "owner", "left").withColumn("is_base", is_base)
    rows = rows.withColumns({"step": F.row_number().over(w), "before": F.lag("items").over(w)})
    named = lambda agent, base: F.when(F.col("is_base"), base).otherwise(agent)
    session, task = named(F.col("owner"), "baseline"), named(F.concat(F.lit("T"), F.col("step")), "Base")
    return rows.select(
        F.concat_ws("/", session, task).alias("evaluation_id"), session.alias("session_id"), task.alias("task_id"), named(F.col("step"), 0).alias("task_order"), named(F.lower("c_mktsegment"), "none").alias("agent"),
        named(F.when(F.col("o_custkey") % 2 == 0, "minimal").otherwise("structured"), "none").alias("strategy"), F.when(F.col("o_orderstatus") == "P", "partial").otherwise("completed").alias("execution_status"),
        F.col("o_totalprice").cast("long").alias("duration_ms"), "step", "items", "before", named(F.col("cells"), None).alias("cells"))


def _lines(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Line items as findings; parts: dealt out by order key in so many, as numbers, which take less memory than the texts they stand for."""
    at = F.pmod(F.col("l_partkey"), F.lit(len(CONCERNS))).cast("int")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("at"), (F.col("l_suppkey") % 7).alias("module"), "l_returnflag", "l_linenumber")
    lines = lines if parts is None else lines.repartition(parts, "l_orderkey")
    pick = lambda i: F.get(F.array(*[F.lit(c[i]) for c in CONCERNS]), F.col("at"))
    return lines.select(
        "l_orderkey",
        pick(1).alias("scope_id"),
        F.concat(pick(0), F.lit("-C-001")).alias("rule_id"),
        F.concat(F.lit("src/m"), F.col("module"), F.lit(".ts")).alias("file"),
        F.col("l_returnflag").alias("message"),
        "l_linenumber",
    )


#: Metrics by event type: name and direction
METRICS = [
    ("click", "BE-DUP-M-001-clone-ratio", "lower_is_better"),
    ("view", "FE-STATE-M-001-provider-ratio", "lower_is_better"),
    ("purchase", "BE-SIZE-M-001-size", "higher_is_better"),
    ("signup", "CROSS-EP-M-001-miss-ratio", "lower_is_better"),
    ("error", "BE-TEST-M-001-mock-ratio", "lower_is_better"),
]


def observations(spark: SparkSession, sf_dir: str, cp: DataFrame | None = None) -> DataFrame:
    """Events of a user are observations of the same-numbered session's checkpoints, one value by metric.

    Every seventh count of events is an errored metric: status error and no value.
    """
    cp = (checkpoints(spark, sf_dir) if cp is None else cp).select("evaluation_id", "session_id", "task_id", "task_order", "agent", "strategy")
    return cp.join(_cells(spark, sf_dir), ["session_id", "task_order"])


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for t, m, _ in METRICS for x in (t, m)])
    ways = F.create_map(*[F.lit(x) for _, m, d in METRICS for x in (m, d)])
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return (
        events.groupBy(F.concat(F.lit("S"), F.col("user_id")).alias("session_id"), (F.col("event_id") % 8 + 1).cast("int").alias("task_order"), F.element_at(names, F.col("event_type")).alias("metric_name"))
        .agg(F.count("*").alias("n"), F.avg("value").alias("v"))
        .select("session_id", "task_order", "metric_name", F.when(F.col("n") % 7 == 0, "error").otherwise("pass").alias("status"), F.when(F.col("n") % 7 != 0, F.round("v", 6)).alias("value"))
        .withColumn("direction", F.element_at(ways, F.col("metric_name")))
    )


_CONCERN_LIST = "[" + ", ".join(f"'{c}'" for c, _ in CONCERNS) + "]"
_LAYER_LIST = "[" + ", ".join(f"'{layer}'" for _, layer in CONCERNS) + "]"

#: The same bindings for DuckDB, as common table expressions in the order they build on each other.
SQL = {
    "checkpoints": """checkpoints AS (
  SELECT 'S' || o_custkey || '/T' || n AS evaluation_id, 'S' || o_custkey AS session_id, 'T' || n AS task_id, CAST(n AS INTEGER) AS task_order, lower(c_mktsegment) AS agent,
         CASE WHEN o_custkey % 2 = 0 THEN 'minimal' ELSE 'structured' END AS strategy, CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'completed' END AS execution_status,
         CAST(o_orderkey AS VARCHAR) AS commit_id, 'h' || (o_orderkey % 50 = 0) AS profile_hash, CAST(trunc(o_totalprice) AS BIGINT) AS duration_ms, o_orderkey AS order_key
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders)) t
  UNION ALL
  SELECT 'baseline/Base', 'baseline', 'Base', 0, 'none', 'none', CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'completed' END, CAST(o_orderkey AS VARCHAR), 'h' || (o_orderkey % 50 = 0),
         CAST(trunc(o_totalprice) AS BIGINT), o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))""",
    "findings": f"""findings AS (
  SELECT c.* EXCLUDE (order_key), ({_LAYER_LIST})[l_partkey % 19 + 1] AS scope_id, ({_CONCERN_LIST})[l_partkey % 19 + 1] || '-C-001' AS rule_id, 'src/m' || (l_suppkey % 7) || '.ts' AS file, l_returnflag AS message, l_linenumber
  FROM lineitem JOIN checkpoints c ON l_orderkey = c.order_key)""",
    "observations": """observations AS (
  SELECT c.evaluation_id, c.session_id, c.task_id, c.task_order, c.agent, c.strategy, metric_name, status, value, CASE WHEN metric_name = 'BE-SIZE-M-001-size' THEN 'higher_is_better' ELSE 'lower_is_better' END AS direction
  FROM checkpoints c JOIN (
    SELECT 'S' || user_id AS session_id, CAST(event_id % 8 + 1 AS INTEGER) AS task_order,
           CASE event_type WHEN 'click' THEN 'BE-DUP-M-001-clone-ratio' WHEN 'view' THEN 'FE-STATE-M-001-provider-ratio' WHEN 'purchase' THEN 'BE-SIZE-M-001-size' WHEN 'signup' THEN 'CROSS-EP-M-001-miss-ratio' WHEN 'error' THEN 'BE-TEST-M-001-mock-ratio' END AS metric_name,
           CASE WHEN count(*) % 7 = 0 THEN 'error' ELSE 'pass' END AS status, CASE WHEN count(*) % 7 <> 0 THEN round(avg(value), 6) END AS value
    FROM events GROUP BY 1, 2, 3) e ON c.session_id = e.session_id AND c.task_order = e.task_order)""",
    "concerns": "concerns AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{layer}', {i})" for i, (c, layer) in enumerate(CONCERNS)) + ") t(concern, layer, concern_order))",
    "counts": "counts AS (SELECT evaluation_id, scope_id, rule_id, file, message, count(*) AS n FROM findings GROUP BY ALL)",
    "pairs": """pairs AS (
  SELECT 'run_local' AS delta_scope, evaluation_id, coalesce(lag(evaluation_id) OVER (PARTITION BY session_id ORDER BY task_order), 'baseline/Base') AS pre FROM checkpoints WHERE session_id <> 'baseline'
  UNION ALL SELECT 'trajectory_cumulative', evaluation_id, 'baseline/Base' FROM checkpoints WHERE session_id <> 'baseline'
  UNION ALL SELECT 'run_local', evaluation_id, evaluation_id FROM checkpoints WHERE session_id = 'baseline'
  UNION ALL SELECT 'trajectory_cumulative', evaluation_id, evaluation_id FROM checkpoints WHERE session_id = 'baseline')""",
    "deltas": """joined AS (
  SELECT delta_scope, evaluation_id, rule_id, scope_id, file, message, sum(a) AS a, sum(b) AS b FROM (
    SELECT p.delta_scope, p.evaluation_id, c.rule_id, c.scope_id, c.file, c.message, n AS a, 0 AS b FROM pairs p JOIN counts c ON p.evaluation_id = c.evaluation_id
    UNION ALL SELECT p.delta_scope, p.evaluation_id, c.rule_id, c.scope_id, c.file, c.message, 0, n FROM pairs p JOIN counts c ON p.pre = c.evaluation_id) t GROUP BY 1, 2, 3, 4, 5, 6),
deltas AS (
  SELECT p.delta_scope, p.evaluation_id, CAST(coalesce(sum(b), 0) AS BIGINT) AS before_count, CAST(coalesce(sum(a), 0) AS BIGINT) AS after_count, CAST(coalesce(sum(greatest(a - b, 0)), 0) AS BIGINT) AS introduced_count,
         CAST(coalesce(sum(greatest(b - a, 0)), 0) AS BIGINT) AS resolved_count, CAST(coalesce(sum(least(a, b)), 0) AS BIGINT) AS unchanged_count, CAST(coalesce(sum(a - b), 0) AS BIGINT) AS net_change
  FROM pairs p LEFT JOIN joined j USING (delta_scope, evaluation_id) GROUP BY 1, 2)""",
    "runs": """runs AS (
  SELECT c.evaluation_id, c.session_id, c.task_id, c.task_order, c.agent, c.strategy, c.execution_status, c.duration_ms,
         CAST((SELECT 0) + l.after_count AS BIGINT) AS total_findings_absolute, l.introduced_count AS run_local_introduced_count, l.resolved_count AS run_local_resolved_count, l.net_change AS run_local_net_change,
         t.introduced_count AS trajectory_introduced_count, t.resolved_count AS trajectory_resolved_count, t.net_change AS trajectory_net_change
  FROM checkpoints c JOIN deltas l ON l.evaluation_id = c.evaluation_id AND l.delta_scope = 'run_local' JOIN deltas t ON t.evaluation_id = c.evaluation_id AND t.delta_scope = 'trajectory_cumulative')""",
    "changes": """changes AS (
  SELECT j.delta_scope, j.evaluation_id, c.session_id, c.task_id, c.task_order, c.agent, c.strategy, j.scope_id, j.rule_id, j.file, j.message, x.change_type, CAST(CASE x.change_type WHEN 'introduced' THEN a - b ELSE b - a END AS BIGINT) AS n
  FROM joined j JOIN checkpoints c USING (evaluation_id), (VALUES ('introduced'), ('resolved')) x(change_type)
  WHERE CASE x.change_type WHEN 'introduced' THEN a - b ELSE b - a END > 0
  UNION ALL SELECT 'absolute', evaluation_id, session_id, task_id, task_order, agent, strategy, scope_id, rule_id, file, message, 'current', count(*) FROM findings GROUP BY ALL)""",
}

_NEEDS = {"findings": ["checkpoints"], "observations": ["checkpoints"], "counts": ["findings"], "pairs": ["checkpoints"], "deltas": ["counts", "pairs"], "runs": ["deltas"], "changes": ["deltas"]}


def with_sql(names: str, body: str) -> str:
    """`body` after the named bindings and what they build on."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    body = body.strip()
    parts = [SQL[n] for n in order]
    return "WITH " + ",\n".join(parts) + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)


def completion(spark: SparkSession, sf_dir: str, cp: DataFrame | None = None) -> DataFrame:
    """Task completion of every checkpoint; statuses follow the order key (cp: the checkpoints, if a caller has them settled)."""
    k = F.col("order_key")
    return (checkpoints(spark, sf_dir) if cp is None else cp).where("session_id <> 'baseline'").select(
        "session_id", "task_id", "task_order", "agent", "strategy", F.when(k % 7 == 1, "failed").when(k % 7 != 0, "success").alias("agent_status"), F.when(k % 5 != 0, k % 5 != 1).alias("completion_marker_found"),
        (k % 11 == 0).alias("agent_reported_error"), F.when(k % 3 == 0, "pass").when(k % 3 == 1, "fail").otherwise("error").alias("test_status"), (k % 20 + 5).alias("test_cases_total"), (k % 20 + 5 - k % 4).alias("test_cases_passed"),
        (k % 4).alias("test_cases_failed"), (F.col("duration_ms") / 1000).alias("duration_seconds"), F.round(F.col("duration_ms") / 100000, 5).alias("cost_usd"), F.when(F.col("agent") == "building", "estimated").otherwise("reported").alias("cost_basis"),
        (F.col("duration_ms") * 3).alias("tokens"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's session has a self-review, a fifth of them without a finding."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey")).alias("session_id"), (F.col("c_custkey") % 5).alias("n_findings"), "c_custkey")


def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).where("n_findings > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_findings"))))
    return rows.select("session_id", F.concat_ws("-", "session_id", "i").alias("finding_id"), F.concat(F.lit("backend/src/m"), (F.col("c_custkey") + F.col("i")) % 9, F.lit(".ts; x.ts")).alias("referenced_files"))


SQL["completion"] = """completion AS (SELECT session_id, task_id, task_order, agent, strategy, CASE WHEN order_key % 7 = 1 THEN 'failed' WHEN order_key % 7 <> 0 THEN 'success' END AS agent_status, CASE WHEN order_key % 5 <> 0 THEN order_key % 5 <> 1 END AS completion_marker_found,
  order_key % 11 = 0 AS agent_reported_error, CASE order_key % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'error' END AS test_status, order_key % 20 + 5 AS test_cases_total, order_key % 20 + 5 - order_key % 4 AS test_cases_passed, order_key % 4 AS test_cases_failed,
  duration_ms / 1000 AS duration_seconds, round(duration_ms / 100000, 5) AS cost_usd, CASE WHEN agent = 'building' THEN 'estimated' ELSE 'reported' END AS cost_basis, duration_ms * 3 AS tokens FROM checkpoints WHERE session_id <> 'baseline')"""
SQL["reviews"] = "reviews AS (SELECT 'S' || c_custkey AS session_id, c_custkey % 5 AS n_findings, c_custkey FROM customer)"
SQL["review_findings"] = "review_findings AS (SELECT session_id, session_id || '-' || i AS finding_id, 'backend/src/m' || ((c_custkey + i) % 9) || '.ts; x.ts' AS referenced_files FROM (SELECT *, unnest(range(1, n_findings + 1)) AS i FROM reviews))"
SQL["bounds"] = """bounds AS (SELECT metric_name, count(value) AS n, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75), 9) AS q3,
  round(quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 9) AS iqr_low, round(quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 9) AS iqr_high, min(direction) AS direction FROM observations GROUP BY 1)"""
SQL["cells"] = """cells AS (SELECT r.evaluation_id, r.agent, r.strategy, r.task_id, k.concern, CASE WHEN m.status = 'error' THEN 'indeterminate_metric_error' WHEN f.concern IS NOT NULL THEN 'constraints_failed'
  WHEN CASE WHEN m.direction = 'higher_is_better' THEN m.value < b.iqr_low ELSE m.value > b.iqr_high END THEN 'silent_decay' ELSE 'clean' END AS classification
  FROM runs r CROSS JOIN concerns k LEFT JOIN (SELECT DISTINCT evaluation_id, regexp_extract(rule_id, '^(.*)-C-001$', 1) AS concern FROM changes WHERE delta_scope = 'run_local' AND change_type = 'introduced') f ON f.evaluation_id = r.evaluation_id AND f.concern = k.concern
  LEFT JOIN observations m ON m.evaluation_id = r.evaluation_id AND regexp_extract(m.metric_name, '^(BE|FE|CROSS)-[A-Z]+') = k.concern LEFT JOIN bounds b ON b.metric_name = m.metric_name WHERE r.session_id <> 'baseline')"""
SQL["files"] = "files AS (SELECT evaluation_id, file, count(*) AS n FROM findings GROUP BY 1, 2)"
_NEEDS |= {"completion": ["checkpoints"], "review_findings": ["reviews"], "bounds": ["observations"], "cells": ["runs", "changes", "bounds", "concerns"], "files": ["findings"]}
