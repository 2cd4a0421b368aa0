"""Tidy tables from nested evaluation documents and acceptance artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import normalize as N

KEYS = ["evaluation_id", "session_id", "task_id", "task_order", "agent", "strategy"]


def build_runs(docs: DataFrame) -> DataFrame:
    """One row by evaluation, from arrays of the same row, so nothing is shuffled.

    docs: keys, execution_status, comparison_status, duration_ms, scopes (scope_id, scope_type, status,
    layers), deltas.
    """
    scopes = F.col("scopes")
    kind = lambda name: F.get(F.filter(scopes, lambda s: s["scope_id"] == name), F.lit(0))
    total = lambda f: F.aggregate(scopes, F.lit(0).cast("long"), lambda a, s: a + F.coalesce(f(s).cast("long"), F.lit(0)))
    size = lambda a: F.greatest(F.size(a), F.lit(0))  # noqa: E731  null arrays count 0
    metrics = lambda s: s["layers"]["metrics"]
    found = lambda name: F.coalesce(size(kind(name)["layers"]["constraints"]["findings"]), F.lit(0)).cast("long")
    out = docs.select(
        *KEYS, "execution_status", "comparison_status", "duration_ms",
        *[F.coalesce(kind(s)["status"], F.lit("missing")).alias(f"{s.split('-')[0]}_status") for s in ("backend", "frontend", "cross-stack")],
        total(lambda s: s["layers"]["constraints"]["rules_evaluated"]).alias("rules_evaluated"),
        *[found(s).alias(f"{s.split('-')[0]}_findings_absolute") for s in ("backend", "frontend", "cross-stack")],
        total(lambda s: size(metrics(s))).alias("metrics_total"),
        total(lambda s: size(F.filter(metrics(s), lambda m: N.metric_value(m["score"]).isNotNull()))).alias("metrics_scored"),
        total(lambda s: size(F.filter(metrics(s), lambda m: m["status"] == "error"))).alias("metric_errors"),
        F.size(F.filter(scopes, lambda s: s["status"] == "error")).cast("long").alias("scope_errors"),
        *[F.col(f"deltas.{a}.constraints.{c}").cast("long").alias(f"{b}_{c}") for a, b in (("run_local", "run_local"), ("trajectory_cumulative", "trajectory")) for c in ("introduced_count", "resolved_count", "net_change")],
    )
    return out.withColumns({
        "constraint_result": N.constraint_result(F.col("execution_status"), F.col("run_local_introduced_count")),
        "total_findings_absolute": F.col("backend_findings_absolute") + F.col("frontend_findings_absolute") + F.col("cross_findings_absolute"),
        "metric_coverage": F.try_divide(F.col("metrics_scored"), F.col("metrics_total")),
    })


def build_constraint_findings(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Current findings of every scope, and what either comparison introduced or resolved; from arrays of the same row, so a document is read once.

    by: columns of findings (scope_id, rule_id, category, file, message); what is equal in them within a document, comparison and
    change is one row with `n`, their number. That is counted in the row as well, so no document is shuffled or held beside another.
    """
    named = lambda f, scope: {"scope_id": scope, "rule_id": f["rule_id"], "category": N.category(f["rule_id"]), "file": N.finding_file(f["location"]["file"], scope), "message": F.coalesce(f["message"], F.lit(""))}
    raw = lambda f, scope: F.struct(scope.alias("scope_id"), f["rule_id"].alias("rule_id"), f["location"]["file"].alias("path"), f["message"].alias("message"))
    row = (lambda f, scope: F.struct(*[named(f, scope)[c].alias(c) for c in by])) if by else raw
    changes = [("absolute", "current"), *[(delta, change) for delta in ("run_local", "trajectory_cumulative") for change in ("introduced", "resolved")]]
    current = F.flatten(F.transform(F.filter("scopes", lambda s: s["layers"]["constraints"]["findings"].isNotNull()), lambda s: F.transform(s["layers"]["constraints"]["findings"], lambda f: row(f, s["scope_id"]))))
    parts = [current, *[F.transform(f"deltas.{delta}.constraints.{change}", lambda f: row(f, f["scope"])) for delta, change in changes[1:]]]
    put = lambda part, what: F.struct(F.lit(what[0]).alias("delta_scope"), F.lit(what[1]).alias("change_type"), part.alias("rows"))
    if by:
        counted = _runs(docs.select(*KEYS, *[F.sort_array(p).alias(f"p{i}") for i, p in enumerate(parts)]), [f"p{i}" for i in range(len(parts))])
        flat = counted.select(*KEYS, F.inline(F.array(*[put(F.col(f"p{i}"), what) for i, what in enumerate(changes)]))).select(*KEYS, "delta_scope", "change_type", F.inline("rows"))
        return flat.select(*KEYS, *[f"item.{c}" for c in by], "delta_scope", "change_type", "n")
    flat = docs.select(*KEYS, F.inline(F.array(*[put(*x) for x in zip(parts, changes, strict=True)]))).select(*KEYS, "delta_scope", "change_type", F.inline("rows"))
    return flat.select(*KEYS, "scope_id", "rule_id", N.category(F.col("rule_id")).alias("category"), N.finding_file(F.col("path"), F.col("scope_id")).alias("file"), F.coalesce("message", F.lit("")).alias("message"), "delta_scope", "change_type")


def _runs(df: DataFrame, arrays: list[str]) -> DataFrame:
    """df with each sorted array as (item, n): equal elements and how many there are."""
    others = [c for c in df.columns if c not in arrays]
    first = lambda a: F.filter(F.transform(a, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(a, i - 1)), i)), lambda i: i.isNotNull())
    starts = df.select(*others, *arrays, *[first(a).alias(f"__{a}") for a in arrays])
    run = lambda a: F.transform(f"__{a}", lambda i, k: F.struct(F.get(a, i).alias("item"), (F.coalesce(F.get(f"__{a}", k + 1), F.size(a)) - i).cast("long").alias("n")))
    return starts.select(*others, *[run(a).alias(a) for a in arrays])


def build_metric_observations(docs: DataFrame) -> DataFrame:
    """Every metric of every scope with its two deltas; the last of repeated deltas counts. Deltas are found in the same row, so nothing is shuffled.

    The outer form keeps Spark from filtering documents by their scopes first, which would make these twice; the second explode drops what has none.
    """
    held = {d: F.filter(F.col(f"deltas.{d}.metrics"), lambda m: m["scope"].isNotNull() & m["name"].isNotNull()) for d in ("run_local", "trajectory_cumulative")}
    named = [x for d, a in held.items() for x in (F.reverse(F.transform(a, lambda m: F.struct(m["scope"].alias("scope"), m["name"].alias("name")))).alias(f"__names_{d}"), F.reverse(F.transform(a, lambda m: m["delta"])).alias(f"__deltas_{d}"))]
    rows = docs.select(*KEYS, "scopes", *named)
    others = [c for c in rows.columns if c not in (*KEYS, "scopes")]
    rows = rows.select(*KEYS, *others, F.explode_outer("scopes").alias("s")).select(*KEYS, *others, F.col("s.scope_id").alias("scope_id"), F.explode("s.layers.metrics").alias("m"))
    own = F.when(F.col("scope_id").isNotNull() & F.col("m.name").isNotNull(), F.struct(F.col("scope_id").alias("scope"), F.col("m.name").alias("name")))
    delta = lambda d: F.get(f"__deltas_{d}", F.nullif(F.array_position(f"__names_{d}", own), F.lit(0)).cast("int") - 1).alias(f"delta_{d}")
    return rows.select(
        "evaluation_id", "scope_id", F.col("m.name").alias("metric_name"), *[c for c in KEYS if c != "evaluation_id"], N.category(F.col("m.name")).alias("category"), F.col("m.status").alias("status"),
        N.metric_value(F.col("m.score")).alias("value"), F.col("m.direction").alias("direction"), *[delta(d) for d in held])


def version_key(version):
    """Numbers of a version, in order; [-1] if there are none."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"(\d+)"), 1), lambda n: n.cast("int"))
    return F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(-1)))


def select_acceptance_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The run of the highest version, then the latest, then the last path; by one aggregate, not a sort."""
    rank = F.struct(version_key(F.col("adapter_version")).alias("v"), F.coalesce("completed_at", "run_id", F.lit("")).alias("t"), F.col("path"))
    others = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("r")).select(*keys, "r.*")


def build_task_completion(executions: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Executions with their selected acceptance run; without one the status is no_data."""
    sums = selected.select(*keys, F.lit(True).alias("has"), F.col("status").alias("s"), F.size("suites").alias("n"), *[N.suite_sum(F.col("suites"), f).alias(f"test_cases_{f}") for f in ("total", "passed", "failed")])
    joined = executions.join(sums, keys, "left")
    out = joined.withColumns({"test_status": F.coalesce("s", F.when(F.col("has"), "unknown").otherwise("no_data")), "test_suite_count": F.coalesce("n", F.lit(0))}).drop("has", "s", "n")
    return out.withColumn("reconciles", N.reconciles(F.col("test_cases_total"), F.col("test_cases_passed"), F.col("test_cases_failed")))


def build_acceptance_failures(suites: DataFrame, unresolved: DataFrame, run_errors: DataFrame, keys: list[str]) -> DataFrame:
    """One row by diagnostic event, of four kinds.

    suites: keys, suite_id, status, reason, total, failed, failed_ids, classes (id, classification),
    details (id, messages). unresolved: keys, suite_id, kind, target, attempted. run_errors: keys, reason.
    """
    base = [*keys, "suite_id"]
    ids = F.array_distinct(F.flatten(F.array(F.coalesce("failed_ids", F.array().cast("array<string>")), F.coalesce("classes.id", F.array().cast("array<string>")), F.coalesce("details.id", F.array().cast("array<string>")))))
    kept = suites.withColumn("ids", F.filter(ids, lambda x: x.isNotNull() & (x != "")))
    kept = kept.withColumns({"suite_failure_rate": N.failure_rate(F.col("failed"), F.col("total")), "cascade_candidate": N.is_cascade(F.col("failed"), F.col("total"))})
    one = lambda array, name: F.get(F.filter(F.coalesce(F.col(array), F.array().cast(kept.schema[array].dataType)), lambda c: c["id"] == F.col("failure_id")), F.lit(0))[name]
    targets = unresolved.groupBy(*base, F.col("target").alias("failure_id")).agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("kind", F.lit("unknown")))), " | ").alias("kinds"))
    asserted = kept.withColumn("failure_id", F.explode("ids")).join(targets, [*base, "failure_id"], "left")
    asserted = asserted.withColumns({"raw_classification": F.coalesce(one("classes", "classification"), F.lit("behaviour_or_unclassified")), "failure_message": F.coalesce(F.array_join(one("details", "messages"), "\n\n"), F.lit(""))})
    told = N.failure_attribution(F.col("raw_classification"), F.col("status"), F.col("reason"), F.col("kinds").isNotNull())
    shared = [*base, "event_type", "failure_id", "raw_classification", "attribution", "suite_failure_rate", "cascade_candidate", "failure_message"]
    events = asserted.withColumns({"event_type": F.lit("assertion_failure"), "attribution": told["attribution"]}).select(*shared)
    with_ids = kept.select(*base, "suite_failure_rate", "cascade_candidate", F.explode("ids").alias("target"))
    alone = unresolved.join(with_ids.select(*base, "target"), [*base, "target"], "left_anti").join(kept.select(*base, "suite_failure_rate", "cascade_candidate"), base)
    events = events.unionByName(alone.withColumns({
        "event_type": F.lit("adapter_unresolved"), "failure_id": F.coalesce("target", F.concat(F.lit("adapter:"), F.coalesce("kind", F.lit("unknown")))), "raw_classification": F.coalesce("kind", F.lit("adapter_unresolved")),
        "attribution": F.lit("interface_unresolved"), "failure_message": F.coalesce("attempted", F.lit("null"))}).select(*shared))
    broken = kept.where((F.col("status") == "error") & (F.size("ids") == 0)).withColumns({
        "event_type": F.lit("suite_error"), "failure_id": F.concat_ws(":", F.lit("suite"), "suite_id", F.coalesce("reason", F.lit("suite_error"))), "raw_classification": F.lit("infrastructure_error"),
        "attribution": F.lit("infrastructure_error"), "cascade_candidate": F.lit(False), "failure_message": F.lit("")})
    failed = run_errors.withColumns({
        "suite_id": F.lit("all"), "event_type": F.lit("run_error"), "failure_id": F.concat(F.lit("run:"), F.coalesce("reason", F.lit("infrastructure_error"))), "raw_classification": F.lit("infrastructure_error"),
        "attribution": F.lit("infrastructure_error"), "suite_failure_rate": F.lit(None).cast("double"), "cascade_candidate": F.lit(False), "failure_message": F.lit("")})
    return events.unionByName(broken.select(*shared)).unionByName(failed.select(*shared))
