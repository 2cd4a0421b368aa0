"""Row-wise normalisation: column expressions without shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.dims import CONCERN_OF_METRIC, METRICS_OUTSIDE, REVIEW_PRIORITY

NO_ORDER = 1_000_000_000


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def task_order(task_id: Column) -> Column:
    """0 for the baseline, else the first digits of the id, else NO_ORDER."""
    digits = _blank_to_null(F.regexp_extract(task_id, r"(\d+)", 1)).try_cast("int")
    return F.when(task_id.isin("Base", "baseline"), 0).otherwise(F.coalesce(digits, F.lit(NO_ORDER)))


def _slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def finding_file(path: Column, scope: Column) -> Column:
    """A finding's file below backend/ or frontend/; null becomes empty."""
    p = _slashes(F.coalesce(path, F.lit("")))
    after = lambda mark: F.substr(p, F.instr(p, f"/{mark}/") + 1)
    prefixed = scope.isin("backend", "frontend") & ~F.startswith(p, F.concat(scope, F.lit("/")))
    return (
        F.when(p == "", "")
        .when(F.contains(p, F.lit("/backend/")), after("backend"))
        .when(F.contains(p, F.lit("/frontend/")), after("frontend"))
        .when(prefixed, F.concat(scope, F.lit("/"), F.ltrim(p, F.lit("/"))))
        .otherwise(p)
    )


def snapshot_path(path: Column, workspace: Column) -> Column:
    """A path below the workspace, else from backend/ or frontend/ on, else as it is."""
    p = _slashes(path)
    root = F.regexp_replace(_slashes(workspace), "/$", "")
    subject = _blank_to_null(F.regexp_extract(p, r"(?:^|/)((?:backend|frontend)/.*)$", 1))
    inside = (root != "") & F.startswith(p, F.concat(root, F.lit("/")))
    return F.when(inside, F.substr(p, F.length(root) + 2)).otherwise(F.coalesce(subject, p))


def message(text: Column, workspace: Column) -> Column:
    """Slashes, single blanks and a placeholder for the workspace."""
    flat = F.trim(F.regexp_replace(_slashes(F.coalesce(text, F.lit(""))), r"\s+", " "))
    root = _slashes(workspace)
    return F.when(root != "", F.replace(flat, root, F.lit("<workspace>"))).otherwise(flat)


def metric_value(score: Column) -> Column:
    """A score that is a JSON number or an object with a numeric value; anything else is null."""
    parsed = F.try_parse_json(score)
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    inner = F.try_variant_get(parsed, "$.value", "variant")
    numeric = lambda v: kind(v).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    return F.when(numeric(parsed), F.try_variant_get(parsed, "$", "double")).when(numeric(inner), F.try_variant_get(parsed, "$.value", "double"))


def fingerprint(scope: Column, rule_id: Column, source_rule_id: Column, location: Column, text: Column) -> Column:
    """A finding's identity: all its fields, in a 256-bit hash of their JSON."""
    parts = F.struct(scope.alias("scope"), F.coalesce(rule_id, F.lit("unknown")).alias("rule_id"), source_rule_id.alias("source_rule_id"), location.alias("location"), text.alias("message"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


_SUBJECT = "^(BE|FE|CROSS)-([A-Z]+)-"


def subject(identifier: Column) -> Column:
    return F.coalesce(_blank_to_null(F.regexp_extract(identifier, _SUBJECT, 1)), F.lit("UNKNOWN"))


def category(identifier: Column) -> Column:
    return F.coalesce(_blank_to_null(F.regexp_extract(identifier, _SUBJECT, 2)), _blank_to_null(identifier), F.lit("unknown"))


def concern(identifier: Column) -> Column:
    """Subject and category; unlike the category alone it keeps both sides' duplication apart."""
    return F.concat_ws("-", subject(identifier), category(identifier))


def metric_concern(metric: Column) -> Column:
    out = concern(metric)
    for name, own in CONCERN_OF_METRIC.items():
        out = F.when(metric == name, own).otherwise(out)
    return out


def is_architectural(metric: Column) -> Column:
    return ~metric.isin(*METRICS_OUTSIDE)


def tokens(agent: Column, usage: dict[str, Column]) -> dict[str, Column]:
    """Common token counts from either family's usage fields."""
    combined = agent == "codex"
    fresh = F.when(usage["input_tokens"].isNotNull() & usage["cached_input_tokens"].isNotNull(), F.greatest(usage["input_tokens"] - usage["cached_input_tokens"], F.lit(0)))
    pick = lambda a, b: F.when(combined, a).otherwise(b)
    return {
        "tokens_input_fresh": pick(fresh, usage["input_tokens"]),
        "tokens_input_cached": pick(usage["cached_input_tokens"], usage["cache_read_input_tokens"]),
        "tokens_cache_write": pick(usage["cache_write_input_tokens"], usage["cache_creation_input_tokens"]),
        "tokens_output": usage["output_tokens"],
        "tokens_reasoning_output": F.when(combined, usage["reasoning_output_tokens"]),
    }


def estimated_cost(fresh: Column, cached: Column, output: Column, price: dict[str, Column]) -> Column:
    """USD; null if a count or the price is missing."""
    return (fresh * price["input"] + cached * price["cached"] + output * price["output"]) / 1_000_000


def cost_basis(reported: Column, estimated: Column, basis: Column) -> Column:
    return F.when(reported.isNotNull(), "reported").when(estimated.isNotNull(), basis).otherwise("unknown")


def suite_sum(suites: Column, field: str) -> Column:
    """Sum of a count over all suites; null unless there are suites and all have it."""
    whole = (F.size(suites) > 0) & F.forall(suites, lambda s: s[field].isNotNull())
    return F.when(whole, F.aggregate(suites, F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s[field].cast("long"), F.lit(0))))


def reconciles(total: Column, passed: Column, failed: Column) -> Column:
    """False only where all counts are known and do not add up."""
    return F.coalesce(passed + failed == total, F.lit(True))


def failure_attribution(raw: Column, status: Column, reason: Column, unresolved: Column) -> Column:
    """struct(attribution, confidence, review) by the first rule that holds."""
    told = lambda a, c, r: F.struct(F.lit(a).alias("attribution"), F.lit(c).alias("confidence"), F.lit(r).alias("review"))
    return (
        F.when(status == "error", told("infrastructure_error", "high", False))
        .when((reason == "adapter_unresolved") | unresolved, told("interface_unresolved", "medium", True))
        .when(raw.isin("route_variance", "selector_variance", "field_variance"), told("interface_unresolved", "medium", True))
        .when(raw == "status_variance", told("interface_contract_variance", "medium", True))
        .when(raw == "harness_context", told("test_harness_context", "high", True))
        .when(raw == "behaviour_or_unclassified", told("requirement_noncompliance_candidate", "medium", True))
        .otherwise(told("unclassified", "low", True))
    )


def failure_rate(failed: Column, total: Column) -> Column:
    return F.when(total > 0, failed / total)


def is_cascade(failed: Column, total: Column) -> Column:
    return F.coalesce((failed >= 3) & (failure_rate(failed, total) >= 0.5), F.lit(False))


def checkpoint_number(text: Column) -> Column:
    return _blank_to_null(F.regexp_extract(text, r"(?i)checkpoint\s+(\d+)", 1))


# Failure families by the expressions that tell them, first hit wins
FAILURE_FAMILIES = [
    ("harness_context", r"theme(?:\.vars)?\.palette|reading ['\"]palette['\"]|must be used (?:within|inside) .*provider|could not find.*context"),
    ("route_variance", r"expected 2\d\d .* got 404|cannot (?:get|post|patch|put)|unexpected .*/api/"),
    ("selector_variance", r"unable to find (?:an element with|role=)|expected .* route-registry entry|expected an accessible .*selector"),
    ("status_variance", r"expected 2\d\d .* got 2\d\d|expected 200 .* got 201"),
    ("field_variance", r"tohaveproperty|expected .* received: undefined|cannot read properties of undefined"),
]


def failure_class(text: Column) -> Column:
    out = F.lit("behaviour_or_unclassified")
    for name, pattern in reversed(FAILURE_FAMILIES):
        out = F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


# Problem summaries by what the lower-cased evidence contains (all of one alternative), first hit wins
ADAPTER_GAP = "Contact-company request-field adapter gap"
PROBLEMS = [
    ([["econnreset"]], "Runtime connection reset (indeterminate)"),
    ([['column "companyid" referenced in foreign key constraint does not exist']], "Database migration / prerequisite cascade"),
    ([["unresolved request_field for contact.companies"], ["could not discover a valid contact link contract"]], ADAPTER_GAP),
    ([["expectedclosedate", "2026-12-31t00:00:00.000z"]], "Date representation mismatch"),
    ([["shows a transition api error inline"]], "Transition error not shown inline"),
    ([["selected deal contact", "removable"]], "Contact-removal UI detection/behavior"),
    ([["rejects an empty body"]], "Empty-update validation missing"),
    ([["contact list and company filtering", "expected 200"]], "Company-filter database query failure"),
    ([["relationship migration", "isprimary"]], "Migrated primary-company response mismatch"),
    ([["demo seed includes a multi-company contact"]], "Required multi-company seed data missing"),
]


def problem(failure_id: Column, text: Column, event_type: Column) -> Column:
    """The problem summary of an event; an unresolved adapter target is the adapter gap unless an earlier rule holds."""
    evidence = F.lower(F.concat_ws(" ", F.coalesce(failure_id, F.lit("")), F.coalesce(text, F.lit(""))))
    out = F.lit("Other behavioral assertion")
    for alternatives, name in reversed(PROBLEMS):
        hit = F.coalesce(event_type == "adapter_unresolved", F.lit(False)) if name == ADAPTER_GAP else F.lit(False)
        for needles in alternatives:
            found = F.lit(True)
            for n in needles:
                found &= F.contains(evidence, F.lit(n))
            hit |= found
        out = F.when(hit, name).otherwise(out)
    return out


def excerpt(text: Column, limit: int = 700) -> Column:
    """One line without terminal colours, cut at `limit` characters."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\x1b\\[[0-?]*[ -/]*[@-~]", ""), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit)), F.lit("…")))


def suite_outcome(status: Column, unresolved: Column, variances: Column) -> Column:
    """error > unresolved > fail > adapted pass > pass."""
    return F.when(status == "error", "infrastructure_error").when(unresolved > 0, "adapter_unresolved").when(status == "fail", "fail").when(variances > 0, "adapted_pass").otherwise("pass")


def threshold_verdict(value: Column, direction: Column, warn: Column, fail: Column) -> Column:
    """fail, warn or pass; a missing value or threshold never fails."""
    beyond = lambda limit: F.coalesce(F.when(direction == "higher_is_better", value <= limit).otherwise(value >= limit), F.lit(False))
    return F.when(beyond(fail), "fail").when(beyond(warn), "warn").otherwise("pass")


def constraint_result(status: Column, introduced: Column) -> Column:
    return F.when(~status.eqNullSafe("completed"), "indeterminate").when(introduced == 0, "passed").when(introduced.isNotNull(), "failed").otherwise("unknown")


def condition_label(agent: Column, strategy: Column) -> Column:
    return F.concat_ws(" ", F.initcap(agent), F.initcap(strategy))


def checkpoint_label(task_id: Column) -> Column:
    return F.regexp_replace(task_id, "^T", "E")


def acceptance_label(status: Column, passed: Column, total: Column) -> Column:
    return F.when(passed.isNotNull() & total.isNotNull(), F.format_string("%s (%d/%d)", F.initcap(status), passed, total)).otherwise(F.coalesce(F.initcap(status), F.lit("No data")))


def referenced_files(location: Column) -> Column:
    """Back-ticked paths, else comma-separated parts, without line and column."""
    text = F.coalesce(location, F.lit(""))
    ticked = F.regexp_extract_all(text, F.lit("`([^`]+)`"), 1)
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    found = F.when(F.size(ticked) > 0, ticked).otherwise(parts)
    return F.transform(found, lambda p: F.regexp_replace(F.trim(p), r":\d+(:\d+)?$", ""))


def is_production_file(path: Column) -> Column:
    """Neither test, story nor generated, by suffix or by a directory on the way."""
    p = _slashes(path)
    suffix = p.rlike(r"(?i)\.(?:test|spec|story|stories|generated)\.[^/]+$")
    segment = p.rlike(r"(?:^|/)(?:test|tests|__tests__|stories|generated|__generated__)(?:/|$)")
    return ~(suffix | segment)


def resource_name(name: Column) -> Column:
    """The singular first word of a file or resource name; null if there is none."""
    n = F.regexp_replace(name, r"(?i)\.(js|jsx|ts|tsx)$", "")
    for tail in ("(?i)api$", "(?i)-detail$", "(?i)detail$"):
        n = F.regexp_replace(n, tail, "")
    word = F.split(F.lower(F.trim(F.regexp_replace(n, "[_-]", " "))), r"\s+")[0]
    single = (
        F.when(F.endswith(word, F.lit("ies")) & (F.length(word) > 3), F.concat(F.substr(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")) & (F.length(word) > 1), F.substr(word, F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )
    return _blank_to_null(single)


def route_path(prefix: Column, path: Column) -> Column:
    """One slash between parts, parameters named alike, no slash at the end."""
    joined = F.concat_ws("/", F.lit(""), _blank_to_null(prefix), _blank_to_null(path))
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "/+", "/"), "/:([^/]+)", "/:param"), "/$", "")
    return F.when(flat == "", "/").otherwise(flat)


def review_priority(attribution: Column) -> Column:
    out = F.lit(9)
    for name, rank in REVIEW_PRIORITY.items():
        out = F.when(attribution == name, rank).otherwise(out)
    return out
