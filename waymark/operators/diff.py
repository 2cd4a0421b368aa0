"""Checkpoint comparison: pairs, multiset differences of findings, metric deltas, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.checkpoints import settled

#: A checkpoint that more than one in so many pairs looks back to is hot; what hot ones hold is broadcast up to so many rows.
HOT_KEYS, BROADCAST_ROWS = 2000, 200_000
IDENTITY = ["scope_id", "rule_id", "file", "message"]
BASELINE = "baseline"


def finding_counts(findings: DataFrame, identity: list[str] = IDENTITY) -> DataFrame:
    """evaluation_id, identity columns, n: findings are counted once, before any join."""
    return findings.groupBy("evaluation_id", *identity).agg(F.count("*").alias("n"))


def make_pairs(checkpoints: DataFrame) -> DataFrame:
    """delta_scope, evaluation_id, pre: every checkpoint against the one before it and against the baseline.

    The baseline is compared with itself. A session's first checkpoint has the baseline before it.
    """
    base = checkpoints.where(F.col("session_id") == BASELINE).select(F.col("evaluation_id").alias("base"))
    rows = checkpoints.select("evaluation_id", "session_id", "task_order").crossJoin(F.broadcast(base))  # one row
    before = F.lag("evaluation_id").over(Window.partitionBy("session_id").orderBy("task_order"))
    both = F.array(F.struct(F.lit("run_local").alias("delta_scope"), F.coalesce("before", "base").alias("pre")), F.struct(F.lit("trajectory_cumulative").alias("delta_scope"), F.col("base").alias("pre")))
    return rows.withColumn("before", before).select("evaluation_id", F.inline(both)).select("delta_scope", "evaluation_id", "pre")


class PairJoin:
    """Joins of pairs with what their earlier checkpoint holds, whatever share of the pairs looks back to one checkpoint.

    pairs: delta_scope, evaluation_id, pre. Fewer than HOT_KEYS checkpoints are hot, such as the
    baseline, which half of the pairs have as `pre`. What those hold is counted and, up to BROADCAST_ROWS, broadcast;
    beyond that the pairs of a hot checkpoint are salted, and its rows repeated for every salt. All others are
    shuffled. So no exchange is keyed by a hot checkpoint.
    """

    def __init__(self, pairs: DataFrame, broadcast_rows: int = BROADCAST_ROWS):
        pairs, self.broadcast_rows = settled(pairs), broadcast_rows
        share = max(pairs.count() / HOT_KEYS, 1)
        often = pairs.groupBy("pre").agg(F.count("*").alias("m")).where(F.col("m") > share)
        self.hot = settled(often.select("pre", F.ceil(F.col("m") / share).cast("int").alias("__salts")))  # fewer than HOT_KEYS rows
        #: the pairs, with the number of salts where `pre` is hot
        self.pairs = pairs.join(F.broadcast(self.hot), "pre", "left").select(*pairs.columns, "__salts")

    def join(self, post: DataFrame, before: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """post: rows of `pairs` with any columns beside; before: `pre`, those of `on`, and others, which are added. Nulls of `on` are equal."""
        held = settled(before.join(F.broadcast(self.hot), "pre"))
        seldom = self._equal(post.where("__salts is null").drop("__salts"), before, ["pre"], on, how)
        often = post.where("__salts is not null")
        if held.count() <= self.broadcast_rows:
            often = self._equal(often.drop("__salts"), F.broadcast(held.drop("__salts")), ["pre"], on, how)
        else:
            often = often.withColumn("__salt", F.pmod(F.xxhash64("evaluation_id", *on), F.col("__salts")).cast("int")).drop("__salts")
            held = held.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
            often = self._equal(often, held, ["pre", "__salt"], on, how).drop("__salt")
        return often.unionByName(seldom)

    @staticmethod
    def _equal(post: DataFrame, before: DataFrame, keys: list[str], on: list[str], how: str) -> DataFrame:
        a, b = post.alias("a"), before.alias("b")
        same = F.lit(True)
        for c in keys:
            same &= F.col(f"a.{c}") == F.col(f"b.{c}")
        for c in on:
            same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return a.join(b, same, how).select("a.*", *[F.col(f"b.{c}") for c in before.columns if c not in (*keys, *on)])


def multiset_counts(counts: DataFrame, pairs: DataFrame, identity: list[str] = IDENTITY) -> DataFrame:
    """Before, after, introduced, resolved, unchanged and net counts of each pair.

    Unchanged copies need only identities on both sides, so an inner join replaces the full outer
    join; what is introduced or resolved is what the totals leave over.
    """
    counts, joined = settled(counts), PairJoin(pairs)
    totals = counts.groupBy("evaluation_id").agg(F.sum("n").alias("total"))
    pre = counts.select(F.col("evaluation_id").alias("pre"), *identity, F.col("n").alias("b"))
    post = joined.pairs.join(counts.withColumnRenamed("n", "a"), "evaluation_id")
    matched = joined.join(post, pre, identity).groupBy("delta_scope", "evaluation_id").agg(F.sum(F.least("a", "b")).alias("unchanged_count"))
    after = joined.pairs.join(matched, ["delta_scope", "evaluation_id"], "left").join(totals.withColumnRenamed("total", "after_count"), "evaluation_id", "left")
    out = joined.join(after, totals.select(F.col("evaluation_id").alias("pre"), F.col("total").alias("before_count")), [], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    out = out.withColumns({c: zero(c) for c in ("before_count", "after_count", "unchanged_count")})
    return out.select(
        "delta_scope", "evaluation_id", "before_count", "after_count", (F.col("after_count") - F.col("unchanged_count")).alias("introduced_count"),
        (F.col("before_count") - F.col("unchanged_count")).alias("resolved_count"), "unchanged_count", (F.col("after_count") - F.col("before_count")).alias("net_change"),
    )


def surplus(counts: DataFrame, pairs: DataFrame, identity: list[str] = IDENTITY) -> DataFrame:
    """delta_scope, evaluation_id, identity, change_type, n: identities with copies on one side only.

    Both sides are signed and summed by (pair, identity), so what is resolved is what the earlier checkpoint holds less what is matched.
    """
    counts, joined = settled(counts), PairJoin(pairs)
    held = ["delta_scope", "evaluation_id", *identity]
    before = joined.join(joined.pairs, counts.select(F.col("evaluation_id").alias("pre"), *identity, (-F.col("n")).alias("d")), [])
    sides = joined.pairs.join(counts, "evaluation_id").select(*held, F.col("n").alias("d")).unionByName(before.select(*held, "d"))
    net = sides.groupBy(*held).agg(F.sum("d").alias("d")).where("d <> 0")
    return net.select(*held, F.when(F.col("d") > 0, "introduced").otherwise("resolved").alias("change_type"), F.abs("d").alias("n"))


def itemised(changes: DataFrame) -> DataFrame:
    """One row for every surplus copy, numbered from 1."""
    return changes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


#: Keys of a checkpoint that its findings carry.
KEYS = ["evaluation_id", "session_id", "task_id", "task_order", "agent", "strategy"]


def chained(checkpoints: DataFrame) -> DataFrame:
    """checkpoints with `step`, their number within the session, and `next`, the keys of the one after them (null for the last)."""
    w = Window.partitionBy("session_id").orderBy("task_order")
    return checkpoints.withColumns({"step": F.row_number().over(w), "next": F.lead(F.struct(*[c for c in KEYS if c != "session_id"])).over(w)})


def against_base(counts: DataFrame, base: DataFrame, identity: list[str] = IDENTITY) -> DataFrame:
    """counts (identity, n, others) with `base`, the copies that the baseline holds. base: identity, n."""
    held = base.select(*[F.col(c).alias(f"__{c}") for c in identity], F.col("n").alias("base"))
    same = F.lit(True)
    for c in identity:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = counts.join(_small(held), same, "left").drop(*[f"__{c}" for c in identity])
    return out.withColumn("base", F.coalesce("base", F.lit(0).cast("long")))


def along_sessions(counts: DataFrame, base: DataFrame, identity: list[str] = IDENTITY) -> DataFrame:
    """counts of chained checkpoints beside those of their neighbours: `before`, `after` (copies in the session's checkpoint before and after) and `base`.

    A session's first checkpoint has the baseline before it. Rows are dealt out by session once, and what is grouped by session
    afterwards stays where it is; the two comparisons need no join of pairs.
    """
    w = Window.partitionBy("session_id", *identity).orderBy("step")
    beside = lambda f, by: F.when(f("step").over(w) == F.col("step") + by, f("n").over(w))
    rows = against_base(counts, base, identity).repartition("session_id")
    before = F.when(F.col("step") == 1, F.col("base")).otherwise(beside(F.lag, -1))
    return rows.withColumns({"before": F.coalesce(before, F.lit(0)).cast("long"), "after": F.coalesce(beside(F.lead, 1), F.lit(0)).cast("long")})


def session_counts(checkpoints: DataFrame, rows: DataFrame, base: DataFrame) -> DataFrame:
    """checkpoints (chained) with the counts of either comparison: after_count, and before, introduced, resolved, unchanged of `local` and `base`.

    What multiset_counts gives for make_pairs, in one row. rows: of along_sessions.
    """
    held = F.struct("n", F.least("n", "before").alias("local"), F.least("n", "base").alias("base"))
    sums = rows.select("session_id", "step", held.alias("h")).groupBy("session_id", "step").agg(F.sum("h.n").alias("after_count"), *[F.sum(f"h.{c}").alias(f"{c}_unchanged") for c in ("local", "base")])
    out = checkpoints.join(sums, ["session_id", "step"], "left").crossJoin(F.broadcast(base.agg(F.sum("n").alias("base_before"))))  # one row
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("after_count", "local_unchanged", "base_unchanged", "base_before")})
    out = out.withColumn("local_before", F.coalesce(F.lag("after_count").over(Window.partitionBy("session_id").orderBy("step")), F.col("base_before")))
    return out.withColumns({f"{c}_{k}": F.col(whole) - F.col(f"{c}_unchanged") for c in ("local", "base") for k, whole in (("introduced", "after_count"), ("resolved", f"{c}_before"))})


def session_surplus(checkpoints: DataFrame, rows: DataFrame, base: DataFrame, identity: list[str] = IDENTITY, current: bool = False) -> DataFrame:
    """What surplus gives for make_pairs, with the checkpoints' keys; current: with the counts themselves as delta_scope `absolute`.

    rows: of along_sessions. Copies that a session's neighbours differ by are read off each row. What is resolved of the baseline is the
    baseline without what a checkpoint still holds of it; that is gathered by checkpoint, and the rest is made in place.
    """
    keys = [c for c in KEYS if c != "session_id"]
    move = lambda scope, change, n, at="": F.struct(F.lit(scope).alias("delta_scope"), F.lit(change).alias("change_type"), *[F.col(f"{at}{c}").alias(c) for c in keys], n.cast("long").alias("n"))
    moves = F.array(
        move("run_local", "introduced", F.col("n") - F.col("before")), move("trajectory_cumulative", "introduced", F.col("n") - F.col("base")),
        move("run_local", "resolved", F.when(F.col("next").isNotNull(), F.col("n") - F.col("after")), "next."), *([move("absolute", "current", F.col("n"))] if current else []))
    moved = rows.select("session_id", *identity, F.inline(F.filter(moves, lambda m: m["n"] > 0)))
    return moved.unionByName(_base_resolved(checkpoints, rows, base, identity))


def introduced(rows: DataFrame, delta_scope: str, identity: list[str] = IDENTITY) -> DataFrame:
    """The introduced rows of session_surplus of one comparison. rows: of along_sessions, or of against_base for the one with the baseline."""
    was = "before" if delta_scope == "run_local" else "base"
    return rows.where(F.col("n") > F.col(was)).select(*KEYS, *identity, F.lit(delta_scope).alias("delta_scope"), F.lit("introduced").alias("change_type"), (F.col("n") - F.col(was)).alias("n"))


def _base_resolved(checkpoints: DataFrame, rows: DataFrame, base: DataFrame, identity: list[str]) -> DataFrame:
    """Copies of the baseline that checkpoints do not hold, in the comparison with it, and in that with the checkpoint before a session's first."""
    item = F.struct(*identity)
    kept = rows.where("base > 0").groupBy("evaluation_id").agg(F.map_from_entries(F.collect_list(F.struct(item.alias("item"), "n"))).alias("kept"))  # no more entries than the baseline has
    grid = checkpoints.where(F.col("session_id") != BASELINE).select(*KEYS, "step").join(kept, "evaluation_id", "left")
    grid = grid.crossJoin(_small(base.select(*identity, F.col("n").alias("base"))))
    left = grid.withColumn("n", F.col("base") - F.coalesce(F.try_element_at("kept", item), F.lit(0))).where("n > 0")
    scopes = F.when(F.col("step") == 1, F.array(F.lit("trajectory_cumulative"), F.lit("run_local"))).otherwise(F.array(F.lit("trajectory_cumulative")))
    return left.select(*KEYS, *identity, F.explode(scopes).alias("delta_scope"), F.lit("resolved").alias("change_type"), F.col("n").cast("long").alias("n"))


def beside_in_row(df: DataFrame, now: Column, before: Column, base: Column, name: str) -> DataFrame:
    """df with the array `name`: every item of the three with `n`, `before` and `base`, its copies in each. All three are arrays (item, n) of counted items, or null.

    They are sorted together, so equal items lie side by side: work is n log n in a row, and nothing is shuffled. Nulls of items are equal.
    """
    some = lambda a: F.coalesce(a, F.array().cast(df.select(a).schema[0].dataType))
    side = lambda a, i: F.transform(some(a), lambda x: F.struct(x["item"].alias("item"), F.lit(i).alias("side"), x["n"].alias("n")))
    sides = [side(a, i) for i, a in enumerate((now, before, base))]
    kept = [F.col(c) for c in df.columns if c != name]
    at = lambda i: F.get("__sides", i)
    equal = lambda i, j: at(i)["item"].eqNullSafe(at(j)["item"])
    firsts = F.filter(F.transform("__sides", lambda x, i: F.when((i == 0) | ~equal(i, i - 1), i)), lambda i: i.isNotNull())
    copies = lambda group, side: F.aggregate(group, F.lit(0).cast("long"), lambda a, x: a + F.when(x["side"] == side, x["n"]).otherwise(0))
    cut = lambda i, k: F.slice("__sides", i + 1, F.coalesce(F.get("__firsts", k + 1), F.size("__sides")) - i)
    groups = df.select(*kept, F.sort_array(F.concat(*sides)).alias("__sides")).select(*kept, "__sides", firsts.alias("__firsts")).select(*kept, F.transform("__firsts", cut).alias("__groups"))
    return groups.select(*kept, F.transform("__groups", lambda g: F.struct(F.get(g, F.lit(0))["item"].alias("item"), *[copies(g, i).alias(c) for i, c in enumerate(("n", "before", "base"))])).alias(name))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def score_diff(post: DataFrame, pre: DataFrame, keys: list[str]) -> DataFrame:
    """from, to, delta and status of every metric after; a missing side is unavailable."""
    return _with_delta(post.withColumnRenamed("value", "to").join(pre.withColumnRenamed("value", "from"), keys, "left"))


def score_changes(metrics: DataFrame, pairs: DataFrame, name: str = "metric_name") -> DataFrame:
    """score_diff of all pairs: metrics has evaluation_id, the name, value, and columns that stay."""
    joined = PairJoin(pairs)
    before = metrics.select(F.col("evaluation_id").alias("pre"), name, F.col("value").alias("from"))
    return _with_delta(joined.join(joined.pairs.join(metrics.withColumnRenamed("value", "to"), "evaluation_id"), before, [name], "left"))


def _with_delta(joined: DataFrame) -> DataFrame:
    known = F.col("to").isNotNull() & F.col("from").isNotNull()
    return joined.withColumns({"delta": F.when(known, F.col("to") - F.col("from")), "delta_status": F.when(known, "available").otherwise("unavailable")})


def resolve_pre(checkpoints: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, rejected) of wanted (evaluation_id, session_id, pre_commit).

    The baseline's commit maps to the baseline; another must belong to exactly one checkpoint of
    the same session.
    """
    base = checkpoints.where(F.col("session_id") == BASELINE).select(F.col("commit_id").alias("pre_commit"), F.col("evaluation_id").alias("base"))
    own = checkpoints.groupBy("session_id", F.col("commit_id").alias("pre_commit")).agg(F.count("*").alias("n"), F.min("evaluation_id").alias("only"))
    found = wanted.join(F.broadcast(base), "pre_commit", "left").join(own, ["session_id", "pre_commit"], "left")
    found = found.withColumn("pre", F.when(F.col("base").isNotNull(), F.col("base")).when(F.col("n") == 1, F.col("only")))
    reason = F.when(F.col("n").isNull(), "no_checkpoint").otherwise("ambiguous")
    return found.where("pre is not null").select("evaluation_id", "pre"), found.where("pre is null").select("evaluation_id", reason.alias("reason"))


def comparability(pairs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """delta_scope, evaluation_id, reason: the first gate a pair fails, null if it may be compared."""
    side = checkpoints.select("evaluation_id", "execution_status", "profile_hash")
    pre = side.select(F.col("evaluation_id").alias("pre"), *[F.col(c).alias(f"pre_{c}") for c in side.columns[1:]], F.lit(True).alias("found"))
    joined = PairJoin(pairs)
    joined = joined.join(joined.pairs.join(side, "evaluation_id"), pre, [], "left")
    reason = (
        F.when(F.col("found").isNull(), "missing_source")
        .when(F.col("execution_status") != "completed", "target_not_completed")
        .when(F.col("pre_execution_status") != "completed", "source_not_completed")
        .when(F.col("profile_hash").isNull() | F.col("pre_profile_hash").isNull(), "missing_profile")
        .when(F.col("profile_hash") != F.col("pre_profile_hash"), "profile_mismatch")
    )
    return joined.select("delta_scope", "evaluation_id", reason.alias("reason"))


def match_evidence(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of rules from tool events.

    rules: rule_id, adapter, tool_rule_ids, event_type (null: any), message with a {detail} slot.
    """
    flat = rules.withColumn("source_rule_id", F.explode("tool_rule_ids")).withColumnRenamed("event_type", "wanted_type").drop("tool_rule_ids")
    hits = events.join(F.broadcast(flat), ["adapter", "source_rule_id"]).where(F.col("wanted_type").isNull() | (F.col("wanted_type") == F.col("event_type")))
    return hits.withColumn("finding", F.replace("message", F.lit("{detail}"), F.coalesce("detail", F.lit("")))).drop("message", "wanted_type")


def run_status(layers: DataFrame) -> DataFrame:
    """evaluation_id, scope errors, run status and the errors as one text; layers: evaluation_id, scope_id, layer, status."""
    scopes = layers.groupBy("evaluation_id", "scope_id").agg(
        F.bool_or(F.col("status") == "error").alias("bad"), F.array_sort(F.collect_set(F.when(F.col("status") == "error", F.concat_ws(":", "scope_id", "layer")))).alias("errors")
    )
    return scopes.groupBy("evaluation_id").agg(
        F.count_if("bad").alias("scope_errors"), F.when(F.bool_or("bad"), "partial").otherwise("completed").alias("run_status"),
        F.array_join(F.array_sort(F.flatten(F.collect_list("errors"))), " | ").alias("errors"),
    )


def violations_by_scope(findings: DataFrame) -> DataFrame:
    """scope_id, rule_id, violations: by rule, by scope and overall (nulls), with the rules affected."""
    out = findings.rollup("scope_id", "rule_id").agg(F.count("*").alias("violations"), F.count_distinct("rule_id").alias("rules_affected"))
    return out
