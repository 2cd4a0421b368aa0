"""Queries of the row-wise normalisations."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import normalize as N
from waymark.functions.dims import CONCERNS, METRICS_OUTSIDE
from waymark.plans.bindings import table
from waymark.plans.core import query


@query("n01_task_order", "SELECT doc_id, CAST(CASE WHEN source = 'src0' THEN 0 ELSE coalesce(TRY_CAST(nullif(regexp_extract(source, '(\\d+)', 1), '') AS INTEGER), 1000000000) END AS INTEGER) AS task_order FROM documents")
def n01(spark, d):
    task = F.when(F.col("source") == "src0", "Base").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", N.task_order(task).cast("int").alias("task_order"))


_PATH = {0: "'C:\\w\\s1\\backend\\src\\m' || l_suppkey || '.ts'", 1: "'/w/s1/frontend/src/m' || l_suppkey || '.ts'", 2: "'/src/m' || l_suppkey || '.ts'", 3: "''"}
_PATH_SQL = "CASE l_linenumber % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _PATH.items()) + " END"


def _paths(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    path = F.expr(_PATH_SQL.replace("\\", "\\\\"))
    return lines.select("l_orderkey", "l_linenumber", path.alias("path"), F.when(F.col("l_returnflag") == "A", "backend").when(F.col("l_returnflag") == "R", "frontend").otherwise("cross-stack").alias("scope"))


_PATHS_SQL = f"WITH p AS (SELECT l_orderkey, l_linenumber, {_PATH_SQL} AS path, CASE l_returnflag WHEN 'A' THEN 'backend' WHEN 'R' THEN 'frontend' ELSE 'cross-stack' END AS scope FROM lineitem), q AS (SELECT *, replace(path, '\\', '/') AS s FROM p) "


@query("n02_finding_file", _PATHS_SQL + """SELECT l_orderkey, l_linenumber, CASE WHEN s = '' THEN '' WHEN contains(s, '/backend/') THEN substr(s, strpos(s, '/backend/') + 1) WHEN contains(s, '/frontend/') THEN substr(s, strpos(s, '/frontend/') + 1)
 WHEN scope IN ('backend', 'frontend') AND NOT starts_with(s, scope || '/') THEN scope || '/' || ltrim(s, '/') ELSE s END AS file FROM q""")
def n02(spark, d):
    return _paths(spark, d).select("l_orderkey", "l_linenumber", N.finding_file(F.col("path"), F.col("scope")).alias("file"))


@query("n03_snapshot_path", _PATHS_SQL + """SELECT l_orderkey, l_linenumber, CASE WHEN starts_with(s, '/w/s1/') THEN substr(s, 7) ELSE coalesce(nullif(regexp_extract(s, '(?:^|/)((?:backend|frontend)/.*)$', 1), ''), s) END AS path FROM q""")
def n03(spark, d):
    return _paths(spark, d).select("l_orderkey", "l_linenumber", N.snapshot_path(F.col("path"), F.lit("\\w\\s1\\")).alias("path"))


@query("n04_message", """SELECT doc_id, replace(trim(regexp_replace(replace(coalesce(text, ''), '\\', '/'), '\\s+', ' ', 'g')), 'the ', '<workspace>') AS message FROM documents""")
def n04(spark, d):
    return table(spark, d, "documents").select("doc_id", N.message(F.col("text"), F.lit("the ")).alias("message"))


@query("n05_metric_value", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS value FROM events""")
def n05(spark, d):
    score = F.expr("CASE event_id % 4 WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN concat('{\"value\":', get_json_object(props, '$.k'), '}') WHEN 2 THEN '{\"value\":\"high\"}' END")
    return table(spark, d, "events").select("event_id", N.metric_value(score).alias("value"))


@query("n06_fingerprint", """SELECT l_orderkey, l_linenumber, sha256('{"scope":"backend","rule_id":"' || coalesce(nullif(l_returnflag, 'N'), 'unknown') || '","source_rule_id":null,"location":{"file":"f' || l_suppkey || '","line":' || l_linenumber || '},"message":"' || l_linestatus || '"}') AS fingerprint FROM lineitem""")
def n06(spark, d):
    location = F.struct(F.concat(F.lit("f"), F.col("l_suppkey")).alias("file"), F.col("l_linenumber").alias("line"))
    rule = F.nullif(F.col("l_returnflag"), F.lit("N"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.fingerprint(F.lit("backend"), rule, F.lit(None).cast("string"), location, F.col("l_linestatus")).alias("fingerprint"))


_IDS = "([" + ", ".join(f"'{c}-C-001-x'" for c, _ in CONCERNS) + ", 'plain', '', 'BE-MOCK-M-001-mock-per-test-case', 'BE-COVERAGE-M-001-test-coverage'])[p_partkey % 23 + 1]"
_RE = "'^(BE|FE|CROSS)-([A-Z]+)-'"


def _ids(spark, d):
    ids = F.array(*[F.lit(f"{c}-C-001-x") for c, _ in CONCERNS], *[F.lit(x) for x in ("plain", "", "BE-MOCK-M-001-mock-per-test-case", "BE-COVERAGE-M-001-test-coverage")])
    return table(spark, d, "part").select("p_partkey", F.get(ids, (F.col("p_partkey") % 23).cast("int")).alias("id"))


@query("n07_subject_category", f"SELECT p_partkey, coalesce(nullif(regexp_extract({_IDS}, {_RE}, 1), ''), 'UNKNOWN') AS subject, coalesce(nullif(regexp_extract({_IDS}, {_RE}, 2), ''), nullif({_IDS}, ''), 'unknown') AS category FROM part")
def n07(spark, d):
    return _ids(spark, d).select("p_partkey", N.subject(F.col("id")).alias("subject"), N.category(F.col("id")).alias("category"))


@query("n08_metric_concern", f"""SELECT p_partkey, CASE WHEN {_IDS} = 'BE-MOCK-M-001-mock-per-test-case' THEN 'BE-TEST' ELSE coalesce(nullif(regexp_extract({_IDS}, {_RE}, 1), ''), 'UNKNOWN') || '-' || coalesce(nullif(regexp_extract({_IDS}, {_RE}, 2), ''), nullif({_IDS}, ''), 'unknown') END AS concern
FROM part WHERE {_IDS} NOT IN ({', '.join(f"'{m}'" for m in METRICS_OUTSIDE)})""")
def n08(spark, d):
    return _ids(spark, d).where(N.is_architectural(F.col("id"))).select("p_partkey", N.metric_concern(F.col("id")).alias("concern"))


#: Line items as agent runs: quantities are token counts, every ninth lacks its output count.
_USAGE_SQL = """u AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 'codex' ELSE 'claude' END AS agent, CAST(l_quantity * 1000 AS BIGINT) AS i, CAST(l_partkey % 700 * 50 AS BIGINT) AS c, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_quantity * 10 AS BIGINT) END AS o,
  CASE WHEN l_suppkey % 3 = 0 THEN round(l_tax, 4) END AS reported FROM lineitem)"""


def _usage(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 2 == 0, "codex").otherwise("claude").alias("agent"), (F.col("l_quantity") * 1000).cast("long").alias("i"), (F.col("l_partkey") % 700 * 50).cast("long").alias("c"),
        F.when(F.col("l_partkey") % 9 != 0, (F.col("l_quantity") * 10).cast("long")).alias("o"), F.when(F.col("l_suppkey") % 3 == 0, F.round("l_tax", 4)).alias("reported"),
    )


def _token_columns():
    c = {"input_tokens": F.col("i"), "cached_input_tokens": F.col("c"), "cache_read_input_tokens": F.col("c"), "cache_write_input_tokens": F.col("c") + 1, "cache_creation_input_tokens": F.col("c") + 2, "output_tokens": F.col("o"), "reasoning_output_tokens": F.col("o") - 1}
    return N.tokens(F.col("agent"), c)


@query("n09_tokens", f"WITH {_USAGE_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN agent = 'codex' THEN greatest(i - c, 0) ELSE i END AS tokens_input_fresh, c AS tokens_input_cached, CASE WHEN agent = 'codex' THEN c + 1 ELSE c + 2 END AS tokens_cache_write, o AS tokens_output, CASE WHEN agent = 'codex' THEN o - 1 END AS tokens_reasoning_output FROM u")
def n09(spark, d):
    return _usage(spark, d).select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in _token_columns().items()])


@query("n10_cost", f"WITH {_USAGE_SQL}, e AS (SELECT *, CASE WHEN agent = 'codex' THEN (greatest(i - c, 0) * 1.75::DOUBLE + c * 0.175::DOUBLE + o * 14.0::DOUBLE) / 1000000 END AS est FROM u) SELECT l_orderkey, l_linenumber, round(coalesce(reported, est), 8) AS cost_usd, CASE WHEN reported IS NOT NULL THEN 'reported' WHEN est IS NOT NULL THEN 'estimated_gpt-5.3-codex_pricing' ELSE 'unknown' END AS cost_basis FROM e")
def n10(spark, d):
    from waymark.functions.dims import prices

    priced = _usage(spark, d).withColumns(_token_columns()).join(F.broadcast(prices(spark)), "agent", "left")
    est = N.estimated_cost(F.col("tokens_input_fresh"), F.col("tokens_input_cached"), F.col("tokens_output"), {k: F.col(k) for k in ("input", "cached", "output")})
    return priced.withColumn("est", est).select("l_orderkey", "l_linenumber", F.round(F.coalesce("reported", "est"), 8).alias("cost_usd"), N.cost_basis(F.col("reported"), F.col("est"), F.col("price_basis")).alias("cost_basis"))


#: Orders as acceptance runs: a line item is a suite, its count of failures missing for every tenth supplier.
@query("n11_acceptance_counts", """WITH s AS (SELECT l_orderkey, l_partkey % 40 AS total, l_partkey % 40 - l_suppkey % 4 AS passed, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey % 4 + CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END END AS failed FROM lineitem),
g AS (SELECT l_orderkey, CAST(sum(total) AS BIGINT) AS total, CAST(sum(passed) AS BIGINT) AS passed, CASE WHEN count(*) = count(failed) THEN CAST(sum(failed) AS BIGINT) END AS failed FROM s GROUP BY 1)
SELECT *, coalesce(passed + failed = total, true) AS reconciles FROM g""")
def n11(spark, d):
    one = F.struct(F.col("l_partkey") % 40, F.col("l_partkey") % 40 - F.col("l_suppkey") % 4, F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey") % 4 + F.when(F.col("l_partkey") % 97 == 0, 1).otherwise(0)))
    suites = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one.cast("struct<total:bigint,passed:bigint,failed:bigint>")).alias("suites"))
    sums = suites.select("l_orderkey", *[N.suite_sum(F.col("suites"), f).alias(f) for f in ("total", "passed", "failed")])
    return sums.withColumn("reconciles", N.reconciles(F.col("total"), F.col("passed"), F.col("failed")))


_RAW = ["route_variance", "selector_variance", "field_variance", "status_variance", "harness_context", "behaviour_or_unclassified", "odd"]
_RAW_SQL = "([" + ", ".join(f"'{r}'" for r in _RAW) + "])[CAST(value * 100 AS BIGINT) % 7 + 1]"


def _raw():
    return F.get(F.array(*[F.lit(r) for r in _RAW]), ((F.col("value") * 100).cast("long") % 7).cast("int"))


@query("n12_failure_attribution", f"""WITH e AS (SELECT event_id, {_RAW_SQL.replace('CAST(value * 100 AS BIGINT)', 'CAST(trunc(value * 100) AS BIGINT)')} AS raw, CASE WHEN event_type = 'error' THEN 'error' ELSE 'fail' END AS status, CASE WHEN user_id % 11 = 0 THEN 'adapter_unresolved' END AS reason, event_id % 13 = 0 AS un FROM events)
SELECT event_id, CASE WHEN status = 'error' THEN 'infrastructure_error' WHEN reason = 'adapter_unresolved' OR un OR raw IN ('route_variance', 'selector_variance', 'field_variance') THEN 'interface_unresolved' WHEN raw = 'status_variance' THEN 'interface_contract_variance'
 WHEN raw = 'harness_context' THEN 'test_harness_context' WHEN raw = 'behaviour_or_unclassified' THEN 'requirement_noncompliance_candidate' ELSE 'unclassified' END AS attribution,
 CASE WHEN status = 'error' THEN 'high' WHEN reason = 'adapter_unresolved' OR un OR raw IN ('route_variance', 'selector_variance', 'field_variance') THEN 'medium' WHEN raw = 'harness_context' THEN 'high' WHEN raw = 'odd' THEN 'low' ELSE 'medium' END AS confidence, status <> 'error' AS review FROM e""")
def n12(spark, d):
    told = N.failure_attribution(_raw(), F.when(F.col("event_type") == "error", "error").otherwise("fail"), F.when(F.col("user_id") % 11 == 0, "adapter_unresolved"), F.col("event_id") % 13 == 0)
    return table(spark, d, "events").select("event_id", told.alias("t")).select("event_id", "t.*")


@query("n13_cascade", "SELECT l_orderkey, l_linenumber, l_suppkey % 5 >= 3 AND l_partkey % 8 > 0 AND (l_suppkey % 5) / (l_partkey % 8) >= 0.5 AS cascade FROM lineitem")
def n13(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.is_cascade(F.col("l_suppkey") % 5, F.col("l_partkey") % 8).alias("cascade"))


@query("n14_checkpoint_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS checkpoint FROM orders")
def n14(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("T2 CheckPoint  "), F.col("o_custkey"), F.lit(": ok"))).otherwise("checkpoint none")
    return table(spark, d, "orders").select("o_orderkey", N.checkpoint_number(text).alias("checkpoint"))


@query("n15_failure_class", """SELECT event_id, CASE event_type WHEN 'click' THEN 'route_variance' WHEN 'view' THEN 'selector_variance' WHEN 'error' THEN 'field_variance' WHEN 'purchase' THEN CASE WHEN user_id < 100 THEN 'status_variance' ELSE 'behaviour_or_unclassified' END ELSE CASE WHEN user_id = 7 THEN 'harness_context' ELSE 'behaviour_or_unclassified' END END AS class FROM events""")
def n15(spark, d):
    """Failure texts that name the event's user: a route, a role, a status of 200 and more, a field, a value."""
    user = F.col("user_id")
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Cannot GET /users/"), user))
        .when(F.col("event_type") == "view", F.concat(F.lit("Unable to find role=row of user "), user))
        .when(F.col("event_type") == "error", F.concat(F.lit("Cannot read properties of undefined (reading user"), user, F.lit(")")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("expected "), user + 200, F.lit(" but got 200")))
        .otherwise(F.concat(F.lit("value "), "value", F.when(user == 7, " of theme.palette").otherwise(" differs")))
    )
    return table(spark, d, "events").select("event_id", N.failure_class(text).alias("class"))


@query("n16_problem", """SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'Runtime connection reset (indeterminate)' WHEN event_type = 'error' THEN 'Contact-company request-field adapter gap' WHEN user_id % 5 = 1 THEN 'Date representation mismatch'
 WHEN user_id % 5 = 2 THEN 'Empty-update validation missing' ELSE 'Other behavioral assertion' END AS problem FROM events""")
def n16(spark, d):
    text = F.get(F.array(*[F.lit(t) for t in ("read ECONNRESET", "expectedCloseDate 2026-12-31T00:00:00.000Z", "PATCH rejects an empty body", "zzz", "yyy")]), (F.col("user_id") % 5).cast("int"))
    kind = F.when(F.col("event_type") == "error", "adapter_unresolved").otherwise("assertion_failure")
    return table(spark, d, "events").select("event_id", N.problem(F.col("props"), F.concat_ws(" ", text, F.col("value")), kind).alias("problem"))


@query("n17_excerpt", "WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 700 THEN s ELSE left(s, 700) || '…' END AS excerpt FROM t")
def n17(spark, d):
    return table(spark, d, "documents").select("doc_id", N.excerpt(F.concat(F.lit("\x1b[31m"), F.col("text"))).alias("excerpt"))


@query("n18_outcome", """WITH s AS (SELECT l_orderkey, CASE WHEN l_shipmode_x = 0 THEN 'error' WHEN l_shipmode_x < 4 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN l_shipmode_x = 0 THEN 'infrastructure_error' WHEN l_partkey % 5 > 3 THEN 'adapter_unresolved' WHEN l_shipmode_x < 4 THEN 'fail' WHEN l_partkey % 3 > 1 THEN 'adapted_pass' ELSE 'pass' END AS outcome
 FROM (SELECT *, l_suppkey % 9 AS l_shipmode_x FROM lineitem))
SELECT l_orderkey, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'fail') THEN 'fail' ELSE 'pass' END AS status FROM s GROUP BY 1""")
def n18(spark, d):
    x = F.col("l_suppkey") % 9
    status = F.when(x == 0, "error").when(x < 4, "fail").otherwise("pass")
    rows = table(spark, d, "lineitem").select("l_orderkey", status.alias("status"), N.suite_outcome(status, F.when(F.col("l_partkey") % 5 > 3, 1).otherwise(0), F.when(F.col("l_partkey") % 3 > 1, 1).otherwise(0)).alias("outcome"))
    overall = F.when(F.bool_or(F.col("status") == "error"), "error").when(F.bool_or(F.col("status") == "fail"), "fail").otherwise("pass")
    return rows.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("outcomes"), overall.alias("status"))


@query("n19_threshold", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'pass' WHEN event_type = 'purchase' THEN CASE WHEN value <= 20 THEN 'fail' WHEN value <= 40 THEN 'warn' ELSE 'pass' END WHEN event_type = 'view' THEN 'pass' ELSE CASE WHEN value >= 90 THEN 'fail' WHEN value >= 70 THEN 'warn' ELSE 'pass' END END AS verdict FROM events""")
def n19(spark, d):
    limits = spark.createDataFrame([("purchase", "higher_is_better", 40.0, 20.0), ("view", "lower_is_better", None, None), *[(t, "lower_is_better", 70.0, 90.0) for t in ("click", "signup", "error")]], "event_type string, direction string, warn double, fail double")
    value = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    return table(spark, d, "events").join(F.broadcast(limits), "event_type").select("event_id", N.threshold_verdict(value, F.col("direction"), F.col("warn"), F.col("fail")).alias("verdict"))


@query("n20_constraint_result", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'indeterminate' WHEN o_custkey % 4 = 0 THEN 'passed' WHEN o_custkey % 4 = 1 THEN 'unknown' ELSE 'failed' END AS result FROM orders")
def n20(spark, d):
    n = F.when(F.col("o_custkey") % 4 != 1, F.col("o_custkey") % 4)
    return table(spark, d, "orders").select("o_orderkey", N.constraint_result(F.when(F.col("o_orderstatus") != "P", "completed"), n).alias("result"))


@query("n21_labels", """SELECT o_orderkey, upper(left(x, 1)) || substr(x, 2) || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Minimal' ELSE 'Structured' END AS condition, 'E' || (o_orderkey % 3 + 1) AS checkpoint,
 CASE WHEN o_custkey % 6 = 0 THEN 'Pass' ELSE 'Pass (' || o_custkey % 6 || '/' || 6 || ')' END AS acceptance FROM (SELECT *, lower(c_mktsegment) AS x FROM orders JOIN customer ON o_custkey = c_custkey)""")
def n21(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    passed = F.when(F.col("o_custkey") % 6 != 0, F.col("o_custkey") % 6)
    return rows.select(
        "o_orderkey", N.condition_label(F.lower("c_mktsegment"), F.when(F.col("o_orderkey") % 2 == 0, "minimal").otherwise("structured")).alias("condition"),
        N.checkpoint_label(F.concat(F.lit("T"), F.col("o_orderkey") % 3 + 1)).alias("checkpoint"), N.acceptance_label(F.lit("pass"), passed, F.lit(6)).alias("acceptance"),
    )


@query("n23_referenced_files", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 'src/a' || l_suppkey || '.ts;src/b.ts' ELSE 'src/c' || l_suppkey || '.ts;d.ts' END AS files FROM lineitem")
def n23(spark, d):
    s = F.col("l_suppkey")
    location = F.when(s % 2 == 0, F.concat(F.lit("see `src/a"), s, F.lit(".ts:12:3` and `src/b.ts:9`, c.ts"))).otherwise(F.concat(F.lit("src/c"), s, F.lit(".ts:7, d.ts ,")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(N.referenced_files(location), ";").alias("files"))


@query("n24_production_file", "SELECT p_partkey, p_size <= 20 AS production FROM part")
def n24(spark, d):
    """Paths named after the part; its size decides on the ending."""
    size = F.col("p_size")
    end = F.when(size > 40, ".test.ts").when(size > 32, ".Stories.jsx").when(size > 26, "/__generated__/c.ts").when(size > 20, ".generated.ts").when(size > 10, "/testing/generate.ts").otherwise(".ts")
    return table(spark, d, "part").select("p_partkey", N.is_production_file(F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), end)).alias("production"))


@query("n25_resource_name", "SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL WHEN p_size > 36 THEN w || 'y' ELSE w END AS resource FROM (SELECT *, string_split(p_name, ' ')[2] AS w FROM part)")
def n25(spark, d):
    """Names made of the part's second word; its size decides on their form."""
    word, size = F.split("p_name", " ")[1], F.col("p_size")
    name = F.when(size > 45, "api").when(size > 36, F.concat(word, F.lit("ies_old"))).when(size > 27, F.concat(F.initcap(word), F.lit("API.ts"))).when(size > 18, F.concat(word, F.lit("s-Detail"))).when(size > 9, F.concat(word, F.lit("sApi.js"))).otherwise(word)
    return table(spark, d, "part").select("p_partkey", N.resource_name(name).alias("resource"))


@query("n26_route_path", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/api' || CASE WHEN p IN ('', '/') THEN '' ELSE rtrim(regexp_replace(p, '/+', '/', 'g'), '/') END WHEN 1 THEN '/api/x/:param' ELSE '/' END AS route
 FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages)""")
def n26(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    i = F.col("page_id") % 3
    return table(spark, d, "pages").select("page_id", N.route_path(F.when(i < 2, "api").otherwise(""), F.when(i == 0, path).when(i == 1, "//x/:id/").otherwise("/")).alias("route"))
