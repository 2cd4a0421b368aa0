"""Tool-call linking with DataFrame functions only.

Results are joined to calls by identifier; a call may be answered once, and results without a
call stay as rows of their own. Of an id's results the earliest that does not come before its
first call counts; if all come before it, the earliest (`answered_early`). `n_results` tells how
many there are. Calls are put in a topological order: `level`, then turn, then id. A dependency on an
earlier call agrees with turn order, so levels stay 0 unless a call names a later one; then the
level is the most edges to later calls on any way down the dependencies. Calls on or behind a
cycle have no such number: they are marked and their level is null. Arguments are checked
against the tool's schema and everything is written as canonical JSON: keys sorted, no blanks,
by Spark's variant type.

Null ids join nothing: such calls are unanswered and such results are orphans. Calls that share
an id are all linked and flagged `duplicate_id`; results that repeat an id and a turn are counted,
the least content stands for them. Null or malformed arguments are an error row's `bad_json`.
Empty texts are texts, very long ones are parsed and written whole. Empty tables give no rows;
extra columns are dropped, so they can't clash. Nothing is gathered by conversation, so a
conversation may hold any share of the rows; results are reduced by id and turn before the join
with the calls, and Spark splits a skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import checkpointed

#: Weights on a cycle double each round and stop here; the level of a call is far below it.
ENDLESS = 1 << 40

#: JSON type names by Spark's type of a variant (fixed values)
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


#: Conversations of at most so many needs are ordered in one row each.
SMALL_PART = 400


def argument_errors(arguments: str, tool: str, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted error codes: bad_json, unknown_tool, missing:f, type:f, unknown:f.

    schemas: for each tool, (JSON type, required) by field.
    """
    parsed = F.try_parse_json(F.col(arguments))
    keys = F.coalesce(F.json_object_keys(F.col(arguments)), F.array().cast("array<string>"))
    # brackets take a name with dots or blanks as one field
    field = lambda f: f"$['{f}']" if "'" not in f else f'$["{f}"]'
    kind = lambda f: F.regexp_extract(F.schema_of_variant(F.try_variant_get(parsed, field(f), "variant")), "^[A-Z]+", 0)
    checks = F.when(parsed.isNull() | F.json_object_keys(F.col(arguments)).isNull(), F.array(F.lit("bad_json")))
    for name, fields in schemas.items():
        found = [F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in fields])), lambda k: F.concat(F.lit("unknown:"), k))]
        for f, (json_type, required) in fields.items():
            has = F.array_contains(keys, f)
            wrong = ~kind(f).isin(_TYPES[json_type])
            found.append(F.when(~has & F.lit(required), F.array(F.lit(f"missing:{f}"))).when(has & wrong, F.array(F.lit(f"type:{f}"))).otherwise(F.array().cast("array<string>")))
        checks = checks.when(F.col(tool) == name, F.array_sort(F.flatten(F.array(*found))))
    return checks.otherwise(F.array(F.lit("unknown_tool")))


def canonical_json(column: str) -> Column:
    """The JSON text with sorted keys and no blanks; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(F.col(column)))


def levels(calls: DataFrame, edges: DataFrame, small: int = SMALL_PART) -> DataFrame | None:
    """(id, level, cyclic) of the calls that need another; level is null where cyclic; None if all are 0.

    calls: id, conversation, turn. edges: id, needs. An edge to a later call adds 1, one to an earlier call 0.
    Conversations whose edges stay inside them and are at most `small` are each peeled in one row; the others go
    through rounds of joins together, see `_by_rounds`. Both are exact.
    """
    at = calls.groupBy("id").agg(F.min(F.struct("turn", "conversation")).alias("at")).select("id", "at.*")
    placed = edges.join(at, "id").join(at.select(F.col("id").alias("needs"), F.col("turn").alias("needs_turn"), F.col("conversation").alias("other")), "needs")
    later = (F.struct("needs_turn", "needs") >= F.struct("turn", "id")).cast("long")
    rows = checkpointed(placed.select("id", "needs", later.alias("w"), "conversation", "other").distinct())
    if rows.where("w = 1").isEmpty():
        return None
    sizes = checkpointed(
        rows.select(F.explode(F.array_distinct(F.array("conversation", "other"))).alias("conversation"), (~F.equal_null("conversation", "other")).alias("leaves"))
        .groupBy("conversation").agg(F.count("*").alias("size"), F.bool_or(F.col("leaves") | F.col("conversation").isNull()).alias("open"))
    )
    if sizes.where(f"open or size > {small}").isEmpty():
        return _peeled(rows.select("conversation", "id", "needs", "w"))
    closed = sizes.where(f"not open and size <= {small}").select("conversation", "size")
    # a conversation of at most `small` edges is no hot key; larger ones find no partner
    inside = rows.join(closed, "conversation").select("conversation", "id", "needs", "w")
    return _by_rounds(rows.join(closed, "conversation", "left_anti").select("id", "needs", "w")).unionByName(_peeled(inside))


def _peeled(rows: DataFrame) -> DataFrame:
    """(id, level, cyclic) by conversation, in one row each: a call is settled once all that it needs is; what never is, is on or behind a cycle."""
    parts = rows.groupBy("conversation").agg(F.collect_list(F.struct("id", "needs", "w")).alias("e")).withColumn("ids", F.array_distinct(F.concat("e.id", "e.needs")))
    number = lambda c: F.array_position("ids", c) - 1
    parts = parts.withColumn("e", F.transform("e", lambda x: F.struct(number(x["id"]).alias("a"), number(x["needs"]).cast("int").alias("b"), x["w"].alias("w"))))
    parts = parts.withColumn("out", F.transform("ids", lambda _, i: F.filter("e", lambda x: x["a"] == i)))
    start = F.transform("out", lambda o: F.when(F.size(o) == 0, F.lit(0).cast("long")))

    def step(s, _):
        level = lambda x: F.get(s["levels"], x["b"])
        settled = lambda o: F.when(F.forall(o, lambda x: level(x).isNotNull()), F.array_max(F.transform(o, lambda x: level(x) + x["w"])))
        moved = F.transform("out", lambda o, i: F.coalesce(F.get(s["levels"], i), settled(o)))
        # the same as before: nothing settles any more
        return F.when(F.equal_null(s["levels"], s["before"]), s).otherwise(F.struct(moved.alias("levels"), s["levels"].alias("before")))

    none = F.lit(None).cast("array<bigint>")
    ended = F.aggregate(F.sequence(F.lit(0), F.size("ids")), F.struct(start.alias("levels"), none.alias("before")), step)
    flat = parts.select(F.col("ids"), ended.alias("s"), F.col("e.a").alias("a")).select(F.explode(F.filter(F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.get("s.levels", i).cast("int").alias("level"), F.array_contains("a", i.cast("long")).alias("asks"))), lambda x: x["asks"])).alias("x"))
    return flat.select("x.id", "x.level", F.col("x.level").isNull().alias("cyclic"))


def _by_rounds(rows: DataFrame) -> DataFrame:
    """(id, level, cyclic) from rows (id, needs, w), by rounds of joins.

    A row (id, needs, w) says that the level is at least w above that of `needs`, or at least w
    where `needs` is null. Each round replaces a need that is settled by its level, and one that
    waits for a single other call by that call, so a chain of n calls takes log2(n) rounds; calls
    that wait for several take a round for each step of their depth. As long as any call off the
    cycles waits, one settles in each round: when none does, all that wait are on or behind a cycle.
    """
    waiting = None
    while True:
        state = checkpointed(rows.groupBy("id").agg(F.count("needs").alias("n"), F.max("needs").alias("one"), F.max(F.when(F.col("needs").isNotNull(), F.col("w"))).alias("up"), F.max(F.when(F.col("needs").isNull(), F.col("w"))).alias("least")))
        was, waiting = waiting, state.where("n > 0").count()
        if waiting in (0, was):
            return state.select("id", F.when(F.col("n") == 0, F.col("least")).cast("int").alias("level"), (F.col("n") > 0).alias("cyclic"))
        below = rows.where("needs is not null").join(state.withColumnRenamed("id", "needs"), "needs", "left")
        # a need without a row of its own needs nothing: level 0
        settled, single = F.coalesce("n", F.lit(0)) == 0, F.col("n") == 1
        none = F.lit(None).cast(state.schema["one"].dataType)
        to = lambda needs, w: F.struct(needs.alias("needs"), F.least(w, F.lit(ENDLESS)).alias("w"))
        known = to(none, F.col("w") + F.coalesce("least", F.lit(0)))
        next_rows = F.when(settled, F.array(known)).when(single & F.col("least").isNotNull(), F.array(known, to(F.col("one"), F.col("w") + F.col("up")))).when(single, F.array(to(F.col("one"), F.col("w") + F.col("up")))).otherwise(F.array(to(F.col("needs"), F.col("w"))))
        moved = below.select("id", F.inline(next_rows))
        rows = checkpointed(moved.unionByName(rows.where("needs is null")).groupBy("id", "needs").agg(F.max("w").alias("w")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]], edges: DataFrame | None = None) -> DataFrame:
    """One row for each call, and one for each orphan result id.

    calls: id, conversation, turn, tool, arguments (JSON text). results: id, conversation, turn,
    content. edges: id, needs.
    """
    by_turn = results.groupBy("id", "turn").agg(F.min(F.struct("content", "conversation")).alias("r"), F.count("*").alias("n"))
    called = calls.where("id is not null").groupBy("id").agg(F.min("turn").alias("called"))
    early = F.coalesce(F.col("turn") < F.col("called"), F.lit(False)).alias("early")
    answers = by_turn.join(called, "id", "left").groupBy("id").agg(F.min(F.struct(early, "turn", "r.content", "r.conversation")).alias("first"), F.sum("n").alias("n_results"))
    counted = calls.select("id", "conversation", "turn", "tool", "arguments")
    copies = counted.where("id is not null").groupBy("id").agg(F.count("*").alias("copies"))
    answered = copies.join(answers.where("id is not null"), "id", "full").unionByName(answers.where("id is null").withColumn("copies", F.lit(None).cast("long")))
    linked = counted.withColumn("is_call", F.lit(True)).join(answered.where("copies is not null"), "id", "left").unionByName(
        answered.where("copies is null").select("id", F.col("first.conversation").alias("conversation"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("arguments"), F.lit(False).alias("is_call"), "copies", "first", "n_results")
    )
    ordered = levels(calls, edges) if edges is not None else None
    if ordered is None:
        linked = linked.withColumns({"level": F.lit(0), "cyclic": F.lit(False)})
    else:
        linked = linked.join(ordered, "id", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
        linked = linked.withColumn("level", F.when(~F.col("cyclic"), F.coalesce("level", F.lit(0))))
    errors = F.when(F.col("is_call"), argument_errors("arguments", "tool", schemas)).otherwise(F.array().cast("array<string>"))
    linked = linked.withColumn("errors", errors)
    status = (
        F.when(~F.col("is_call"), "orphan_result")
        .when(F.col("copies") > 1, "duplicate_id")
        .when(F.col("cyclic"), "cyclic")
        .when(F.col("first").isNull(), "unanswered")
        .when(F.col("first.turn") < F.col("turn"), "answered_early")
        .otherwise("linked")
    )
    message = F.to_json(
        F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("id"), F.col("tool").alias("name"), F.col("first.content").alias("result"))
    )
    return linked.select(
        "conversation", "id", "level", "turn", F.col("tool"), F.col("first.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        status.alias("status"), F.array_join("errors", ",").alias("errors"), message.alias("canonical_json"),
    )
