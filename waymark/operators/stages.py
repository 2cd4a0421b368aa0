"""Stage tables: reliability, debt, profiles, fences, pairs, trajectories, silent decay, concentration."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import normalize as N
from waymark.functions.checkpoints import settled
from waymark.functions.stats import EXACT_PAIRS, principal_axes

CLASSES = ["indeterminate_metric_error", "constraints_failed", "silent_decay", "clean"]
_zero = lambda c: F.coalesce(F.col(c), F.lit(0))


def agent_runs(runs: DataFrame) -> DataFrame:
    return runs.where("session_id <> 'baseline'")


def run_overview(runs: DataFrame, completion: DataFrame) -> DataFrame:
    """Runs with their completion; unknown is not completed. `cumulative_net_new_violations` holds what was introduced."""
    joined = runs.join(completion.select("session_id", "task_id", "agent_status", "test_status"), ["session_id", "task_id"], "left")
    return joined.select(
        "evaluation_id", F.coalesce(F.col("agent_status") == "success", F.lit(False)).alias("task_completed"), (F.col("execution_status") == "completed").alias("harness_completed"), "test_status",
        F.col("run_local_introduced_count").alias("constraints_introduced_this_task"), F.col("run_local_resolved_count").alias("constraints_resolved_this_task"), F.col("trajectory_introduced_count").alias("cumulative_net_new_violations"))


def metric_error_rates(observations: DataFrame) -> DataFrame:
    return observations.groupBy("metric_name", N.category(F.col("metric_name")).alias("category")).agg(
        F.count("*").alias("observations"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.count_if(F.col("status") == "error") / F.count("*"), 6).alias("error_rate"))


def run_reliability(runs: DataFrame, gates: DataFrame, scope_errors: DataFrame) -> DataFrame:
    """Reliable: completed, comparable and without scope errors."""
    joined = runs.join(gates.where("delta_scope = 'run_local'").select("evaluation_id", "reason"), "evaluation_id", "left").join(scope_errors, "evaluation_id", "left")
    return joined.select("evaluation_id", ((F.col("execution_status") == "completed") & F.col("reason").isNull() & (_zero("scope_errors") == 0)).alias("reliable"))


def _sized(changes: DataFrame, scope: str, change: str) -> DataFrame:
    return changes.where((F.col("delta_scope") == scope) & (F.col("change_type") == change))


def baseline_debt(changes: DataFrame) -> DataFrame:
    """Per category: baseline findings, and means over the evaluations that have the category at all."""
    cat = N.category(F.col("rule_id")).alias("category")
    base = _sized(changes, "absolute", "current").where("session_id = 'baseline'").groupBy(cat).agg(F.sum("n").alias("baseline_count"))

    def mean(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("session_id <> 'baseline'").groupBy("evaluation_id", cat).agg(F.sum("n").alias("x")).groupBy("category").agg((F.sum("x") / F.count("*")).alias(name))

    out = base.join(mean(_sized(changes, "absolute", "current"), "mean_agent_count"), "category", "full").join(mean(_sized(changes, "trajectory_cumulative", "introduced"), "mean_net_new"), "category", "full")
    return out.select("category", _zero("baseline_count").cast("long").alias("baseline_count"), *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c) for c in ("mean_agent_count", "mean_net_new")])


def baseline_self_check(runs: DataFrame) -> DataFrame:
    """One row: whether there is a baseline and all its deltas are 0."""
    names = ["run_local_introduced_count", "run_local_resolved_count", "trajectory_introduced_count", "trajectory_resolved_count"]
    clean = F.lit(True)
    for n in names:
        clean &= F.col(n) == 0
    return runs.where("session_id = 'baseline'").agg(F.count("*").alias("rows"), F.coalesce(F.bool_and(clean), F.lit(False)).alias("passed"))


def completion_gate(completion: DataFrame) -> DataFrame:
    return completion.select(
        "session_id", "task_id", (~F.col("agent_status").eqNullSafe("success")).alias("agent_not_successful"), (~F.col("completion_marker_found").eqNullSafe(True)).alias("marker_missing"),
        F.col("agent_reported_error").eqNullSafe(True).alias("reported_error"), (~F.col("test_status").eqNullSafe("pass")).alias("tests_not_passed"))


def status_by_task(completion: DataFrame, statuses: list[str]) -> DataFrame:
    return completion.groupBy("task_id").pivot("test_status", statuses).agg(F.count(F.lit(1))).fillna(0)


def concern_profile(changes: DataFrame, runs: DataFrame, concerns: DataFrame) -> DataFrame:
    """Cumulative introductions by evaluation for every concern and agent, the mean over agents, and shares."""
    n = agent_runs(runs).groupBy("agent").agg(F.count("*").alias("evaluations"))
    found = _sized(changes, "trajectory_cumulative", "introduced").where("session_id <> 'baseline'").groupBy("agent", N.concern(F.col("rule_id")).alias("concern")).agg(F.sum("n").alias("introduced"))
    grid = F.broadcast(concerns).crossJoin(n).join(found, ["agent", "concern"], "left")  # 19 concerns by agents
    per = grid.withColumn("rate", _zero("introduced") / F.col("evaluations"))
    mean = per.groupBy("concern", "layer", "concern_order").agg(F.avg("rate").alias("mean_rate"))
    return mean.select("concern", "layer", F.round("mean_rate", 6).alias("mean_rate"), F.round(100 * F.try_divide(F.col("mean_rate"), F.sum("mean_rate").over(Window.partitionBy())), 6).alias("share_percent"))


def layer_summary(profile: DataFrame) -> DataFrame:
    by = profile.groupBy("layer").agg(F.count("*").alias("concerns"), F.count_if(F.col("mean_rate") > 0).alias("concerns_hit"), F.sum("mean_rate").alias("t"))
    return by.select("layer", "concerns", "concerns_hit", F.round("t", 4).alias("total_rate"), F.round(100 * F.try_divide(F.col("t"), F.sum("t").over(Window.partitionBy())), 4).alias("share_percent"))


def strategy_rule_diff(changes: DataFrame) -> DataFrame:
    """Introduced counts of either strategy by agent, task and rule, where there is any."""
    rows = _sized(changes, "run_local", "introduced").where("session_id <> 'baseline'").groupBy("agent", "task_id", "rule_id").pivot("strategy", ["minimal", "structured"]).agg(F.sum("n")).fillna(0, ["minimal", "structured"])
    return rows.withColumn("diff", F.col("structured") - F.col("minimal")).where("minimal <> 0 or structured <> 0")


def strategy_rule_diff_check(diff: DataFrame, runs: DataFrame) -> DataFrame:
    """Pairs whose summed differences are not what the runs' means differ by; replicates make them differ."""
    told = diff.groupBy("agent", "task_id").agg(F.sum("diff").alias("found"))
    want = agent_runs(runs).groupBy("agent", "task_id").pivot("strategy", ["minimal", "structured"]).agg(F.avg("run_local_introduced_count")).where("minimal is not null and structured is not null")
    both = want.select("agent", "task_id", (F.col("structured") - F.col("minimal")).alias("expected")).join(told, ["agent", "task_id"], "full")
    return both.where(~F.coalesce(F.abs(F.col("expected") - F.col("found")) < 1e-9, F.lit(False))).select("agent", "task_id", F.round("expected", 6).alias("expected"), "found")


def rule_movement(diff: DataFrame) -> DataFrame:
    return diff.groupBy("rule_id").agg(F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"))


def violation_rates(changes: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean run-local introductions by run for every group and observed category, zeros included.

    A zero-filled mean is the sum by the number of runs, so the run-by-category grid is never built.
    """
    n = agent_runs(runs).groupBy(*by).agg(F.count("*").alias("runs"))
    found = _sized(changes, "run_local", "introduced").where("session_id <> 'baseline'").groupBy(*by, N.category(F.col("rule_id")).alias("category")).agg(F.sum("n").alias("s"))
    grid = n.crossJoin(F.broadcast(found.select("category").distinct())).join(found, [*by, "category"], "left")  # categories are a few names
    return grid.select(*by, "category", F.round(_zero("s") / F.col("runs"), 6).alias("rate"))


def average_rank(value: Column, within: list[str]) -> Column:
    """Rank from the least value; ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*within).orderBy(value)) + (F.count("*").over(Window.partitionBy(*within, value)) - 1) / 2


def agent_profile(rates: DataFrame) -> DataFrame:
    """Rank 1 is the lowest rate of an agent."""
    return rates.withColumn("rank", average_rank(F.col("rate"), ["agent"]))


def running_counts(counts: DataFrame, by: str, value: str) -> DataFrame:
    """counts (by, value, m; each value once in a group) with `below`, the sum of m over a group's smaller values, and `total`.

    Values are numbered within ranges of (group, value), and ranges by their sums, so no task holds
    or sorts a whole group, whatever its share of the rows.
    """
    ranged = settled(counts.repartitionByRange(by, value).withColumn("range", F.spark_partition_id()))
    group = Window.partitionBy(by)
    earlier = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(by, "range").agg(F.sum("m").alias("in_range")).select(
        F.col(by).alias("__group"), F.col("range").alias("__range"), F.coalesce(F.sum("in_range").over(earlier(group, "range")), F.lit(0)).alias("before"), F.sum("in_range").over(group).alias("total"))
    placed = ranged.join(sums, F.col(by).eqNullSafe(F.col("__group")) & (F.col("range") == F.col("__range")))
    inside = F.coalesce(F.sum("m").over(earlier(Window.partitionBy(by, "range"), value)), F.lit(0))
    return placed.withColumn("below", F.col("before") + inside).drop("range", "__group", "__range", "before")


def quantiles(placed: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """by and q, the exact linear quantiles of the shares, from running counts: only the two values beside each are kept."""
    within = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("m")), F.col(value).cast("double")))
    place = [(F.col("total") - 1) * F.lit(float(s)) for s in shares]
    beside = placed.groupBy(by).agg(F.max("total").alias("total"), *[within(f(p)).alias(f"{f.__name__}{i}") for i, p in enumerate(place) for f in (F.floor, F.ceil)])
    part = [p - F.floor(p) for p in place]
    return beside.select(by, F.array(*[(1 - t) * F.col(f"floor{i}") + t * F.col(f"ceil{i}") for i, t in enumerate(part)]).alias("q"))


def metric_bounds(observations: DataFrame, k: float = 1.5) -> DataFrame:
    """Median, quartiles and fences by metric, exactly, from counts of equal values."""
    whole = observations.groupBy("metric_name").agg(F.count("value").alias("n"), F.mode("direction", True).alias("direction"))
    valued = observations.where("value is not null").groupBy("metric_name", "value").agg(F.count("*").alias("m"))
    q = quantiles(running_counts(valued, "metric_name", "value"), "metric_name", "value", [0.25, 0.5, 0.75])
    out = whole.join(q.withColumnRenamed("metric_name", "__group"), F.col("metric_name").eqNullSafe(F.col("__group")), "left")
    iqr = F.col("q")[2] - F.col("q")[0]
    return out.select("metric_name", "n", F.round(F.col("q")[0], 9).alias("q1"), F.round(F.col("q")[1], 9).alias("median"), F.round(F.col("q")[2], 9).alias("q3"), F.round(F.col("q")[0] - k * iqr, 9).alias("iqr_low"), F.round(F.col("q")[2] + k * iqr, 9).alias("iqr_high"), "direction")


def is_outlier(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce((value < low) | (value > high), F.lit(False))


def is_bad_outlier(value: Column, direction: Column, low: Column, high: Column) -> Column:
    return F.coalesce(F.when(direction == "higher_is_better", value < low).otherwise(value > high) & low.isNotNull() & high.isNotNull(), F.lit(False))


def strategy_pairs(runs: DataFrame, measure: str = "run_local_introduced_count") -> DataFrame:
    wide = agent_runs(runs).groupBy("agent", "task_id").pivot("strategy", ["minimal", "structured"]).agg(F.avg(measure))
    return wide.where("minimal is not null and structured is not null")


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """n, W+ and W-, ties and the median difference for each agent and overall (agent null).

    Ranks of |difference| and the median come from running counts of equal values, so no task sorts
    or holds a group's rows. The few ranks of small groups are kept for the exact test.
    """
    both = pairs.withColumn("d", F.round(F.col("structured") - F.col("minimal"), 9)).select("d", F.explode(F.array(F.col("agent"), F.lit(None).cast("string"))).alias("agent"))
    signed = running_counts(both.where("d is not null").groupBy("agent", "d").agg(F.count("*").alias("m")), "agent", "d")
    middle = quantiles(signed, "agent", "d", [0.5]).select("agent", F.col("q")[0].alias("median_diff"))
    n_pairs = signed.groupBy("agent").agg(F.sum("m").alias("n_pairs"))
    whole = n_pairs.alias("a").join(middle.alias("b"), F.col("a.agent").eqNullSafe(F.col("b.agent"))).select("a.agent", "n_pairs", "median_diff")
    counts = signed.where("d <> 0").groupBy("agent", F.abs("d").alias("a")).agg(F.sum("m").alias("m"), F.sum(F.when(F.col("d") > 0, F.col("m")).otherwise(0)).alias("plus"))
    ranked = running_counts(counts, "agent", "a").withColumn("rank", F.col("below") + (F.col("m") + 1) / 2)
    sums = ranked.groupBy("agent").agg(
        F.sum("m").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("m") - F.col("plus"))).alias("w_minus"), F.sum(F.pow("m", F.lit(3)) - F.col("m")).alias("ties"))
    # the exact test has at most EXACT_PAIRS ranks; groups with more keep none
    small = ranked.join(sums.where(F.col("n") <= EXACT_PAIRS).select("agent"), ranked.agent.eqNullSafe(sums.agent), "left_semi").groupBy("agent").agg(F.flatten(F.collect_list(F.array_repeat("rank", F.col("m").cast("int")))).alias("ranks"))
    out = whole.alias("w").join(sums.alias("s"), F.col("w.agent").eqNullSafe(F.col("s.agent")), "left").join(small.alias("r"), F.col("w.agent").eqNullSafe(F.col("r.agent")), "left")
    return out.select("w.agent", "n_pairs", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.least("w_plus", "w_minus"), F.lit(0.0)).alias("statistic"), F.coalesce("ties", F.lit(0.0)).alias("ties"), "median_diff", "ranks")


def signed_rank_p(statistic: Column, ranks: Column, n: Column, ties: Column) -> Column:
    """Two-sided p of a signed-rank statistic min(W+, W-).

    ranks: those of at most EXACT_PAIRS differences, else null. With them all sign flips are counted: the product of the
    polynomials 1 + x**(2 * rank), whose coefficients are the ways to each doubled sum (ties make halves). For more the
    normal approximation with tie correction is used (ties: sum of t**3 - t over tied ranks).
    """
    doubled = F.transform(ranks, lambda r: F.round(2 * r).cast("int"))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    ways = F.aggregate(doubled, F.array(F.lit(1.0)), lambda w, r: F.zip_with(F.concat(w, zeros(r)), F.concat(zeros(r), w), lambda a, b: a + b))
    low = F.aggregate(F.filter(ways, lambda w, i: F.least(i, F.size(ways) - 1 - i) <= 2 * statistic + 1e-9), F.lit(0.0), lambda t, w: t + w)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    exact = F.least(F.lit(1.0), low / F.pow(F.lit(2.0), n))
    return F.when(n == 0, 1.0).when(ranks.isNotNull(), exact).when(var > 0, F.least(F.lit(1.0), complementary_error(F.abs(statistic - mean) / F.sqrt(2 * var)))).otherwise(1.0)


def complementary_error(x: Column) -> Column:
    """erfc of x >= 0: one less a series of positive terms, and beyond 3 a continued fraction, which keeps small values exact."""
    x = x.cast("double")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("term"), x.alias("sum")), lambda s, k: F.struct((s["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * 2 * x * x / (2 * k + 1)).alias("sum")))["sum"]
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda t, k: x + k / 2 / t)
    scale = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 3, 1 - 2 * scale * terms).otherwise(scale / tail)


def paired_wilcoxon(pairs: DataFrame) -> DataFrame:
    """agent, n_pairs, statistic, p_value, median_diff, note."""
    few = F.col("n_pairs") < 2
    out = signed_ranks(pairs).withColumn("p", signed_rank_p(F.col("statistic"), F.col("ranks"), F.col("n"), F.col("ties")))
    note = F.when(few, "fewer than 2 complete pairs").when(F.col("n") == 0, "all paired differences are zero")
    return out.select("agent", "n_pairs", F.when(~few, F.col("statistic")).alias("statistic"), F.when(~few, F.col("p")).alias("p_value"), F.when(~few, F.col("median_diff")).alias("median_diff"), note.alias("note"))


def trajectory_totals(runs: DataFrame) -> DataFrame:
    return agent_runs(runs).select("session_id", "agent", "strategy", "task_id", "task_order", F.col("trajectory_introduced_count").alias("cumulative_introduced"), F.col("trajectory_resolved_count").alias("cumulative_resolved"))


def trajectory_by_category(changes: DataFrame) -> DataFrame:
    rows = _sized(changes, "trajectory_cumulative", "introduced").where("session_id <> 'baseline'")
    return rows.groupBy("agent", "strategy", "task_id", N.category(F.col("rule_id")).alias("category")).agg(F.sum("n").alias("findings"))


def trajectory_shape(totals: DataFrame, key: list[str], value: str = "cumulative_introduced") -> DataFrame:
    """Points, last value and shape by session, from the means of the early and the late first differences."""
    w = Window.partitionBy(*key).orderBy("task_order")
    d = totals.where(F.col(value).isNotNull()).withColumns({"diff": (F.col(value) - F.lag(value).over(w)).cast("double"), "i": F.row_number().over(w) - 1, "points": F.count("*").over(Window.partitionBy(*key))})
    half = F.greatest(F.lit(1), F.floor((F.col("points") - 1) / 2))
    out = d.groupBy(*key).agg(
        F.count("*").alias("points"), F.max_by(value, "task_order").alias("last_value"), F.avg(F.when((F.col("i") >= 1) & (F.col("i") <= half), F.col("diff"))).alias("early"),
        F.avg(F.when(F.col("i") > half, F.col("diff"))).alias("late"), F.coalesce(F.max(F.abs("diff")), F.lit(0.0)).alias("largest"))
    late = F.coalesce("late", "early")
    tol = F.greatest(0.05 * (F.abs("early") + F.abs(late)), F.lit(1e-9))
    shape = F.when(F.col("points") < 3, "insufficient_data").when(F.col("largest") <= 1e-9, "flat").when(late > F.col("early") + tol, "accelerating").when(late < F.col("early") - tol, "plateau_or_decline").otherwise("linear")
    return out.select(*key, "points", "last_value", shape.alias("shape"))


def silent_decay(runs: DataFrame, changes: DataFrame, observations: DataFrame, bounds: DataFrame, concerns: DataFrame) -> DataFrame:
    """A class for every run and concern: metric error, failed constraint, bad outlier, else clean.

    Failed concerns and metrics are gathered by run, and the grid of runs and concerns is made after the joins, so it is never shuffled.
    """
    failed = _sized(changes, "run_local", "introduced").where("session_id <> 'baseline'").groupBy("evaluation_id").agg(F.collect_set(N.concern(F.col("rule_id"))).alias("failed"))
    metric = observations.where(N.is_architectural(F.col("metric_name"))).join(F.broadcast(bounds.select("metric_name", "iqr_low", "iqr_high")), "metric_name", "left").select(
        "evaluation_id", F.struct(N.metric_concern(F.col("metric_name")).alias("concern"), F.col("status").alias("status"), is_bad_outlier(F.col("value"), F.col("direction"), F.col("iqr_low"), F.col("iqr_high")).alias("bad")).alias("m"))
    metric = metric.groupBy("evaluation_id").agg(F.collect_list("m").alias("metrics"))
    rows = agent_runs(runs).select("evaluation_id", "agent", "strategy", "task_id").join(failed, "evaluation_id", "left").join(metric, "evaluation_id", "left")
    grid = rows.crossJoin(F.broadcast(concerns.select("concern", "concern_order")))  # 19 concerns
    cells = grid.select("evaluation_id", "agent", "strategy", "task_id", "concern", F.array_contains("failed", F.col("concern")).alias("constraint_failed"), F.explode_outer(F.filter("metrics", lambda m: m["concern"] == F.col("concern"))).alias("m"))
    kind = F.when(F.col("m.status") == "error", CLASSES[0]).when(F.col("constraint_failed"), CLASSES[1]).when(F.col("m.bad"), CLASSES[2]).otherwise(CLASSES[3])
    return cells.select("evaluation_id", "agent", "strategy", "task_id", "concern", kind.alias("classification"))


def silent_decay_summary(cells: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("classification") == "silent_decay", F.col("concern")))), " | ")
    return cells.groupBy("evaluation_id").agg(*[F.count_if(F.col("classification") == c).alias(c) for c in CLASSES], names.alias("silent_decay_concerns"), F.bool_or(F.col("classification") == "silent_decay").alias("any_silent_decay"))


def file_counts(findings: DataFrame) -> DataFrame:
    return findings.where("file <> ''").groupBy("evaluation_id", "file").agg(F.count("*").alias("n"))


def file_concentration(counts: DataFrame) -> DataFrame:
    """Files, findings, Gini coefficient, top file (the first of ties) and its share, by run."""
    ranked = counts.withColumns({"i": F.row_number().over(Window.partitionBy("evaluation_id").orderBy("n", "file")), "files": F.count("*").over(Window.partitionBy("evaluation_id"))})
    out = ranked.groupBy("evaluation_id").agg(F.count("*").alias("files"), F.sum("n").alias("findings"), F.sum((F.col("files") - F.col("i") + 1) * F.col("n")).alias("cum"), F.min_by("file", F.struct(-F.col("n"), "file")).alias("top_file"), F.max("n").alias("top"))
    return out.select("evaluation_id", "files", "findings", F.round((F.col("files") + 1 - 2 * F.col("cum") / F.col("findings")) / F.col("files"), 6).alias("gini"), "top_file", F.round(F.col("top") / F.col("findings"), 6).alias("top_file_share"))


def file_blame(counts: DataFrame, concentration: DataFrame) -> DataFrame:
    """By file over all runs: findings, runs, how often it is the top file, share. counts has one row by run and file, so runs need no distinct."""
    tops = concentration.groupBy(F.col("top_file").alias("file")).agg(F.count("*").alias("times_top"))
    total = F.broadcast(counts.agg(F.sum("n").alias("all")))  # one row
    out = counts.groupBy("file").agg(F.sum("n").alias("findings"), F.count("*").alias("runs")).join(tops, "file", "left").crossJoin(total)
    return out.select("file", "findings", "runs", _zero("times_top").cast("long").alias("times_top"), F.round(100 * F.col("findings") / F.col("all"), 6).alias("share_percent"))


def lorenz_points(counts: DataFrame) -> DataFrame:
    """Cumulative shares of files and findings by run, from (0, 0), by ascending count."""
    w = Window.partitionBy("evaluation_id").orderBy("n", "file").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("evaluation_id")
    pts = counts.select("evaluation_id", F.count("*").over(w).alias("i"), (F.count("*").over(w) / F.count("*").over(whole)).alias("file_share"), (F.sum("n").over(w) / F.sum("n").over(whole)).alias("finding_share"))
    zero = counts.select("evaluation_id").distinct().select("evaluation_id", F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("file_share"), F.lit(0.0).alias("finding_share"))
    return pts.unionByName(zero).select("evaluation_id", "i", F.round("file_share", 6).alias("file_share"), F.round("finding_share", 6).alias("finding_share"))


#: Evaluations of a Gram block; metrics may be so many, as their pairs are held by every task.
GRAM_ROWS, MOST_METRICS = 4096, 3000


class MetricCells:
    """Observations as one array by evaluation, with whatever metrics there are.

    metrics: their names, those of `first` in that order, then by name; each with mean and standard deviation. rows:
    evaluation_id and cells, an array of (at, x): the metric's place and the z-score of its mean value there.
    """

    def __init__(self, observations: DataFrame, first: Sequence[str] = ()):
        cells = settled(observations.where("value is not null and not isnan(value)").groupBy("evaluation_id", "metric_name").agg(F.avg("value").alias("value")))
        found = cells.groupBy("metric_name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.min("value") < F.max("value")).alias("varies")).limit(MOST_METRICS + 1).collect()
        if len(found) > MOST_METRICS:
            raise ValueError(f"more than {MOST_METRICS} metrics")
        order = {m: i for i, m in enumerate(first)}
        self.metrics = sorted(found, key=lambda r: (order.get(r.metric_name, len(order)), r.metric_name))
        spark = observations.sparkSession
        places = spark.createDataFrame([(r.metric_name, i, r.mean, r.std or 1.0) for i, r in enumerate(self.metrics)], "metric_name string, at int, mean double, std double")
        scored = cells.join(F.broadcast(places), "metric_name").select("evaluation_id", F.struct("at", ((F.col("value") - F.col("mean")) / F.col("std")).alias("x")).alias("cell"))  # at most MOST_METRICS rows
        self.rows = settled(scored.groupBy("evaluation_id").agg(F.collect_list("cell").alias("cells")))

    @property
    def names(self) -> list[str]:
        return [r.metric_name for r in self.metrics]

    def complete(self) -> DataFrame:
        return self.rows.where(F.size("cells") == len(self.metrics))


def comoments(rows: DataFrame, n_metrics: int) -> DataFrame:
    """a, b (a <= b), n, sx, sy, sxx, syy, sxy over the rows that have both metrics.

    Tasks turn cells into blocks of GRAM_ROWS rows by metrics and add up products of blocks; each task sends one row for every pair of
    metrics that met, and sums are merged by pair.
    """

    def run(batches):
        total = np.zeros((6, n_metrics, n_metrics))
        for batch in batches:
            cells = batch.column(0)
            for lo in range(0, len(cells), GRAM_ROWS):
                part = cells.slice(lo, GRAM_ROWS)
                flat = part.flatten()
                row = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
                x, has = np.zeros((len(part), n_metrics)), np.zeros((len(part), n_metrics))
                at = flat.field("at").to_numpy(zero_copy_only=False)
                x[row, at] = flat.field("x").to_numpy(zero_copy_only=False)
                has[row, at] = 1
                total += [has.T @ has, x.T @ has, has.T @ x, (x * x).T @ has, has.T @ (x * x), x.T @ x]
        a, b = np.nonzero(np.triu(total[0]))
        for lo in range(0, len(a), 100_000):
            i, j = a[lo : lo + 100_000], b[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[i, j]) for t in total]], names=["a", "b", *_MOMENTS])

    sums = rows.select("cells").mapInArrow(run, "a int, b int, " + ", ".join(f"{c} double" for c in _MOMENTS))
    return sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _MOMENTS])


_MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def metric_correlation(observations: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete Pearson correlations of all metrics with more than one value; metric_a comes before metric_b in their order."""
    cells = MetricCells(observations, first)
    spark = observations.sparkSession
    names = spark.createDataFrame([(i, r.metric_name) for i, r in enumerate(cells.metrics) if r.varies], "i int, name string")
    named = lambda c: F.broadcast(names.select(F.col("i").alias(c), F.col("name").alias(f"metric_{c}")))  # noqa: E731  at most MOST_METRICS rows
    cov, var_x, var_y = (F.col("n") * F.col(s) - F.col(p) * F.col(q) for s, p, q in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    flat = (var_x <= 1e-13 * F.col("n") * F.col("sxx")) | (var_y <= 1e-13 * F.col("n") * F.col("syy"))  # but for rounding, one value
    r = F.when((F.col("n") > 1) & ~flat, cov / F.sqrt(var_x * var_y))
    return comoments(cells.rows, len(cells.metrics)).join(named("a"), "a").join(named("b"), "b").select("metric_a", "metric_b", F.round(r, 6).alias("r"))


def metric_pca(observations: DataFrame, first: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(spectrum, loadings, scores) of complete cases' z-scores over all metrics; None below 4 rows or 2 metrics.

    Mean and deviation are those of the complete cases. The Gram matrix comes from blocks; only its k by k numbers reach the driver.
    """
    spark = observations.sparkSession
    whole = MetricCells(observations, first)
    k = len(whole.metrics)
    kept = whole.complete()
    n = kept.count()
    if n < 4 or k < 2:
        return None
    # z-scores again, of the complete cases alone
    cells = MetricCells(observations.join(kept.select("evaluation_id"), "evaluation_id", "left_semi"), whole.names)
    gram = np.zeros((k, k))
    for r in comoments(cells.rows, k).select("a", "b", "sxy").collect():
        gram[r.a, r.b] = gram[r.b, r.a] = r.sxy / n
    values, axes = principal_axes(gram)
    share = values / values.sum()
    spectrum = spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(share)], "component int, explained_share double")
    loadings = spark.createDataFrame([(m, j + 1, float(axes[i, j])) for i, m in enumerate(cells.names) for j in range(k)], "metric_name string, component int, loading double")
    onto = lambda j: F.aggregate("cells", F.lit(0.0), lambda t, c: t + c["x"] * F.get(F.array(*[F.lit(float(x)) for x in axes[:, j]]), c["at"]))
    scores = cells.rows.select("evaluation_id", *[onto(j).alias(f"pc{j + 1}") for j in range(2)])
    return spectrum, loadings, scores


def review_ground_truth(reviews: DataFrame, runs: DataFrame) -> DataFrame:
    t3 = runs.where("task_id = 'T3'").select("session_id", "total_findings_absolute")
    n, t = F.col("n_findings"), F.col("total_findings_absolute")
    return reviews.join(t3, "session_id", "left").select("session_id", "n_findings", "total_findings_absolute", F.coalesce((n == 0) & (t > 0), F.lit(False)).alias("blind_spot"), F.coalesce(n < t, F.lit(False)).alias("under_reported"))


def _basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def location_matches(review_findings: DataFrame, findings: DataFrame) -> DataFrame:
    """review finding id, session_id and whether any referenced file's name is among the session's T3 files."""
    files = findings.where("task_id = 'T3' and file <> ''").select("session_id", _basename(F.col("file")).alias("name")).distinct()
    refs = review_findings.select("session_id", "finding_id", F.explode_outer(F.split("referenced_files", ";")).alias("ref")).select("session_id", "finding_id", _basename(F.trim("ref")).alias("name"))
    return refs.join(files.withColumn("hit", F.lit(True)), ["session_id", "name"], "left").groupBy("session_id", "finding_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("location_match"))


def review_location_overlap(matches: DataFrame) -> DataFrame:
    return matches.groupBy("session_id").agg(F.count_if("location_match").alias("matches"), F.count("*").alias("findings"), F.round(F.count_if("location_match") / F.count("*"), 6).alias("overlap"))
