"""Queries of the artifact readers and of review parsing, over texts derived from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.functions.checkpoints import shared_folder
from waymark.plans.bindings import table
from waymark.plans.core import query
from waymark.sources import artifacts as S


@query("n22_review_parse", """SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'issues_found' WHEN 1 THEN 'issues_found' WHEN 2 THEN 'no_issues_found' ELSE 'parse_incomplete' END AS review_status, CASE (conv_id + turn) % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_findings FROM conversations""")
def n22(spark, d):
    return S.build_reviews(S.parse_reviews(_reviews(spark, d)), ["conv_id", "turn"])[0]


def _reviews(spark, d):
    """Conversation turns as reviews: bullets, a table, the marker, or the bare text."""
    i = (F.col("conv_id") + F.col("turn")) % 4
    plain = F.regexp_replace("text", r"\s+", " ")
    bullets = F.concat(F.lit("# Review\n- `severity`: `high`\n- **location**: `src/a"), "turn", F.lit(".ts:3`, `b.ts`\n- issue: "), plain, F.lit("\n\n- severity: low\n- impact: none\n[TASK_COMPLETED]"))
    tab = F.concat(F.lit("| Severity | location | issue | impact | recommended_improvement |\n|--|--|--|--|--|\n| high | c"), "turn", F.lit(".ts | x | y | z |\n| odd |\n"))
    text = F.when(i == 0, bullets).when(i == 1, tab).when(i == 2, F.concat(plain, F.lit(f"\n{S.NO_ISSUES}"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))


@query("i07_review_findings", """SELECT conv_id, turn, x.severity, x.location, CASE x.severity WHEN 'high' THEN CASE (conv_id + turn) % 4 WHEN 0 THEN 'src/a' || turn || '.ts;b.ts' ELSE 'c' || turn || '.ts' END ELSE '' END AS referenced_files
FROM conversations, LATERAL (SELECT 'high' AS severity, CASE (conv_id + turn) % 4 WHEN 0 THEN '`src/a' || turn || '.ts:3`, `b.ts`' ELSE 'c' || turn || '.ts' END AS location UNION ALL SELECT 'low', '') x WHERE (conv_id + turn) % 4 = 0 OR ((conv_id + turn) % 4 = 1 AND x.severity = 'high')""")
def i07(spark, d):
    return S.build_reviews(S.parse_reviews(_reviews(spark, d)), ["conv_id", "turn"])[1].select("conv_id", "turn", "severity", "location", "referenced_files")


@query("s06_table_round_trip", "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(NULL AS DOUBLE) AS score FROM orders")
def s06(spark, d):
    """Written with a fixed schema and read again, in the folder that a cluster's nodes share."""
    schema = StructType.fromDDL("id long, status string, score double")
    path = _folder(spark)
    S.write_table(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).alias("score")), path, schema)
    return spark.read.schema(schema).parquet(path)


def _folder(spark):
    base = shared_folder(spark).rstrip("/")
    return f"{base if ':/' in base else 'file://' + base}/artifacts-{uuid.uuid4().hex}"


def _sessions(spark, d, texts):
    """Folders of sessions, one for each customer, in shards; texts: file name by column of customer that holds its text."""
    session = F.concat(F.lit("S"), F.col("c_custkey"))
    rows = table(spark, d, "customer").select(F.concat_ws("/", S.shard(session), session).alias("session"), *[t.alias(f"f{i}") for i, (_, t) in enumerate(texts)])
    files = F.array(*[F.struct(F.concat_ws("/", "session", F.lit(name)).alias("path"), F.col(f"f{i}").alias("text")) for i, (name, _) in enumerate(texts)])
    folder = _folder(spark)
    S.write_artifacts(rows.select(F.inline(files)), folder)
    return f"{folder}/*"


def _evaluations(spark, d):
    """Sessions with an evaluation each; where the account is overdrawn the file is cut short."""
    finding = F.struct(F.concat(F.lit("BE-"), "c_mktsegment").alias("rule_id"), F.struct(F.concat(F.lit("src/n"), "c_nationkey", F.lit(".ts")).alias("file")).alias("location"), F.col("c_name").alias("message"))
    layers = F.struct(F.struct(F.lit("completed").alias("status"), F.array_repeat(finding, (F.col("c_custkey") % 3).cast("int")).alias("findings")).alias("constraints"))
    scopes = F.array(F.struct(F.lit("backend").alias("scope_id"), F.lit("completed").alias("status"), layers.alias("layers")))
    whole = F.to_json(F.struct(F.lit("0.3.0").alias("schema_version"), F.concat(F.lit("r"), "c_custkey").alias("run_id"), scopes.alias("scopes"), (F.col("c_custkey") * 10).alias("duration_ms"), F.lit("completed").alias("execution_status")))
    text = F.when(F.col("c_acctbal") < 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    return _sessions(spark, d, [("T1/harness_evaluation.json", text)])


@query("s01_read_evaluations", """SELECT 'S' || c_custkey || '/T1' AS evaluation_id, 1 AS task_order, '0.3.0' AS schema_version, c_custkey * 10 AS duration_ms, CAST(c_custkey % 3 AS INTEGER) AS n_findings, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS message FROM customer WHERE c_acctbal >= 0""")
def s01(spark, d):
    rows, _ = S.read_evaluations(spark, _evaluations(spark, d))
    found = F.col("scopes")[0]["layers"]["constraints"]["findings"]
    return rows.select("evaluation_id", "task_order", "schema_version", "duration_ms", F.size(found).alias("n_findings"), F.get(found, F.lit(0))["message"].alias("message"))


@query("s02_rejects", "SELECT 'S' || c_custkey || '/T1/harness_evaluation.json' AS artifact, c_custkey % 3 AS n_findings FROM customer WHERE c_acctbal < 0")
def s02(spark, d):
    """Malformed files, with as many messages as their text still has."""
    _, rejects = S.read_evaluations(spark, _evaluations(spark, d))
    return rejects.select(F.regexp_extract("path", "/(S[0-9]+/T1/[^/]+)$", 1).alias("artifact"), F.regexp_count("text", F.lit('"message"')).cast("long").alias("n_findings"))


@query("s03_read_executions", "SELECT 'S' || c_custkey AS session_id, 'T2' AS task_id, lower(c_mktsegment) AS agent, c_acctbal AS cost, c_custkey AS input_tokens FROM customer")
def s03(spark, d):
    metrics = F.struct(F.lower("c_mktsegment").alias("agent"), F.col("c_acctbal").alias("total_cost_usd"), F.struct(F.col("c_custkey").alias("input_tokens")).alias("usage"))
    rows, _ = S.read_executions(spark, _sessions(spark, d, [("T2/execution.json", F.to_json(F.struct(metrics.alias("metrics"))))]))
    return rows.select("session_id", "task_id", "metrics.agent", F.col("metrics.total_cost_usd").alias("cost"), F.col("metrics.usage.input_tokens").alias("input_tokens"))


@query("s03_read_test_results", """SELECT 'S' || c_custkey AS session_id, 'T2' AS task_id, x.status, CAST(x.total AS BIGINT) AS total FROM customer, LATERAL (SELECT 'fail' AS status, c_nationkey AS total UNION ALL SELECT 'pass', c_nationkey + 1) x""")
def s03_tests(spark, d):
    """A task's result and that of its acceptance run."""
    text = lambda status, n: F.to_json(F.struct(F.lit(status).alias("status"), F.array(F.struct(F.lit("api").alias("suite_id"), (F.col("c_nationkey") + n).alias("total"))).alias("suites")))
    rows, _ = S.read_test_results(spark, _sessions(spark, d, [("T2/test_result.json", text("fail", 0)), ("T2/acceptance_runs/1/test_result.json", text("pass", 1))]))
    return rows.select("session_id", "task_id", "status", F.col("suites")[0]["total"].alias("total"))


@query("s03_read_test_executions", "SELECT 'S' || c_custkey AS session_id, CAST(c_nationkey AS INTEGER) AS exit_code, 'id ' || c_name AS failed FROM customer")
def s03_executions(spark, d):
    summary = F.struct(F.array(F.struct(F.concat(F.lit("id "), "c_name").alias("id"))).alias("failed_details"))
    suite = F.struct(F.lit("ui").alias("suite_id"), F.struct(F.col("c_nationkey").alias("exit_code")).alias("test"), summary.alias("summary"))
    rows, _ = S.read_test_executions(spark, _sessions(spark, d, [("T3/test_execution.json", F.to_json(F.struct(F.array(suite).alias("suites"))))]))
    return rows.select("session_id", F.col("suites")[0]["test"]["exit_code"].alias("exit_code"), F.col("suites")[0]["summary"]["failed_details"][0]["id"].alias("failed"))


@query("s04_session_config", "SELECT 'S' || c_custkey AS session_id, lower(c_mktsegment) AS agent, 'minimal' AS strategy, CASE WHEN c_acctbal >= 0 THEN 'model ' || c_nationkey END AS model, '2024-01-01T00:00:00Z' AS created_at FROM customer")
def s04(spark, d):
    model = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("  model: 'model "), "c_nationkey", F.lit("'\n"))).otherwise("")
    text = F.concat(F.lit("session:\n  agent: "), F.lower("c_mktsegment"), F.lit("  # as run\n  strategy: \"minimal\"\n"), model, F.lit("created_at: 2024-01-01T00:00:00Z\n"))
    return S.read_session_config(spark, _sessions(spark, d, [("session_manifest.yaml", text)]))


@query("s05_read_reviews", "SELECT 'S' || c_custkey AS session_id, 'n' || c_nationkey AS reviewed_from_tag, CAST(c_custkey AS VARCHAR) AS reviewed_commit, 'issues_found' AS review_status, CAST(1 AS INTEGER) AS n_findings, 'src/' || c_custkey || '.ts' AS referenced_files FROM customer")
def s05(spark, d):
    review = F.concat(F.lit("- severity: low\n- location: src/"), "c_custkey", F.lit(".ts:4\n- issue: "), "c_name", F.lit("\n"))
    manifest = F.concat(F.lit("reviewed_from_tag: n"), "c_nationkey", F.lit("\nreviewed_commit: '"), "c_custkey", F.lit("'\n"))
    read = S.read_reviews(spark, _sessions(spark, d, [("T4/review.md", review), ("T4/task_manifest.yaml", manifest)]))
    keys = ["session_id", "reviewed_from_tag", "reviewed_commit"]
    runs, found = S.build_reviews(S.parse_reviews(read), keys)
    return runs.join(found.select("session_id", "referenced_files"), "session_id", "left").select(*keys, "review_status", "n_findings", "referenced_files")


@query("s07_refresh", """SELECT c_mktsegment AS segment, count(*) AS orders, count(DISTINCT o_custkey) AS customers, 3 AS jobs FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def s07(spark, d):
    """Three tables refreshed in order, each from the one before it, and the last one read."""
    folder = _folder(spark)
    at = lambda name: f"{folder}/{name}"

    def keyed():
        orders, customer = table(spark, d, "orders"), table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
        S.write_table(orders.join(customer, "o_custkey"), at("keyed"), StructType.fromDDL("o_custkey long, c_mktsegment string"))

    def counted():
        S.write_table(spark.read.parquet(at("keyed")).groupBy("c_mktsegment", "o_custkey").agg(F.count("*").alias("n")), at("counted"), StructType.fromDDL("c_mktsegment string, n long"))

    def summed():
        S.write_table(spark.read.parquet(at("counted")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("n").alias("orders"), F.count("*").alias("customers")), at("summed"), StructType.fromDDL("segment string, orders long, customers long"))

    done = S.run_all([("keyed", keyed), ("counted", counted), ("summed", summed)])
    return spark.read.parquet(at("summed")).withColumn("jobs", F.lit(len(done)))


@query("s07_selective_refresh", """SELECT c_mktsegment AS segment, count(*) AS orders, CAST((SELECT count(*) FROM customer c WHERE c.c_mktsegment = x.c_mktsegment) AS BIGINT) AS customers, 'keyed, sized, report' AS first_run, '' AS second_run, 'sized, report' AS third_run FROM orders JOIN customer x ON o_custkey = c_custkey GROUP BY 1""")
def s07_selective(spark, d):
    """Three jobs by what they read: all run, then none, and after a change of customers those that read them."""
    folder = _folder(spark)
    at = lambda name: f"{folder}/{name}"

    def copied():
        S.write_table(table(spark, d, "customer"), at("customers"), StructType.fromDDL("c_custkey long, c_mktsegment string"))

    def keyed():
        S.write_table(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), at("keyed"), StructType.fromDDL("o_custkey long, n long"))

    def sized():
        S.write_table(spark.read.parquet(at("customers")).groupBy("c_mktsegment").agg(F.count("*").alias("customers")), at("sized"), StructType.fromDDL("c_mktsegment string, customers long"))

    def report():
        held = spark.read.parquet(at("keyed")).join(spark.read.parquet(at("customers")), F.col("o_custkey") == F.col("c_custkey"))
        S.write_table(held.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("n").alias("orders")), at("report"), StructType.fromDDL("segment string, orders long"))

    jobs = [S.Job("report", [at("keyed"), at("customers")], [at("report")], report), S.Job("sized", [at("customers")], [at("sized")], sized), S.Job("keyed", [f"{d}/orders.parquet"], [at("keyed")], keyed)]
    runs = []
    for change in (True, False, True):
        if change:
            copied()
        runs.append(", ".join(S.refresh(spark, jobs, at("manifest"))))
    both = spark.read.parquet(at("report")).join(spark.read.parquet(at("sized")), F.col("segment") == F.col("c_mktsegment"))
    return both.select("segment", "orders", "customers", *[F.lit(r).alias(f"{n}_run") for n, r in zip(("first", "second", "third"), runs, strict=True)])
