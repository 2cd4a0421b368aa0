"""Table work of a small CRM: search, paging, references, stages and link migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.checkpoints import settled
from waymark.functions.dims import OLD_STAGES, STAGE_MOVES, STAGES

DEFAULT_LIMIT, MAX_LIMIT = 10, 100


def _whole(value, default: int) -> int:
    """A whole number of at least 1, else the default."""
    try:
        n = int(str(value))
    except (TypeError, ValueError):
        return default
    return n if n >= 1 else default


def page_bounds(page=None, limit=None) -> tuple[int, int]:
    """(page, limit): page from 1, limit 10 by default and 100 at most; what is no number counts as missing."""
    return _whole(page, 1), min(_whole(limit, DEFAULT_LIMIT), MAX_LIMIT)


def paginate(rows: DataFrame, order: list[Column], page=None, limit=None) -> DataFrame:
    """One page's rows in order, as the first rows up to the page's end; for pages far behind, or many of them, see PageDirectory."""
    page, limit = page_bounds(page, limit)
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit)


class PageDirectory:
    """Pages of ordered rows: the rows are dealt once into ranges of the order, and a page reads the ranges it lies in.

    order: sort orders that tell all rows apart. The ranges' counts, at most `ranges` of them, are the directory; a page's
    first rank gives its range, and its place there. Nothing before that range is read or sorted.
    """

    def __init__(self, rows: DataFrame, order: list[Column], ranges: int | None = None):
        n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.order = order
        self.rows = settled(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), by="__range")
        self.counts = sorted((r[0], r["count"]) for r in self.rows.groupBy("__range").count().collect())

    def page(self, page=None, limit=None) -> DataFrame:
        """The page's rows in order; past the end there are none."""
        page, limit = page_bounds(page, limit)
        first, before, wanted, skipped = (page - 1) * limit, 0, [], 0
        for at, n in self.counts:
            if before < first + limit and before + n > first:
                skipped = skipped if wanted else before
                wanted.append(at)
            before += n
        some = self.rows.where(F.col("__range").isin(wanted)) if wanted else self.rows.limit(0)
        return some.orderBy(*self.order).offset(first - skipped if wanted else 0).limit(limit).drop("__range")

    def meta(self, page=None, limit=None) -> dict[str, int]:
        page, limit = page_bounds(page, limit)
        total = sum(n for _, n in self.counts)
        return {"page": page, "limit": limit, "total": total, "total_pages": -(-total // limit)}


def page_meta(rows: DataFrame, page=None, limit=None) -> DataFrame:
    """page, limit, total and total_pages (0 on empty)."""
    page, limit = page_bounds(page, limit)
    return rows.agg(F.count("*").alias("total")).select(F.lit(page).alias("page"), F.lit(limit).alias("limit"), "total", F.ceil(F.col("total") / limit).cast("long").alias("total_pages"))


def live(rows: DataFrame) -> DataFrame:
    return rows.where("deleted_at is null")


def _like(term: str, columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return out


def _equal(rows: DataFrame, wanted: dict) -> DataFrame:
    for c, v in wanted.items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    return rows


def company_search(companies: DataFrame, q: str | None = None, status: int | None = None, industry: str | None = None) -> DataFrame:
    """Live companies whose name, email or phone has q (trimmed), with exact status and industry."""
    rows = _equal(live(companies), {"status": status, "industry": industry})
    return rows.where(_like(q.strip(), ["name", "email", "phone"])) if q and q.strip() else rows


def contact_search(contacts: DataFrame, q: str | None = None, company_id: int | None = None, role: str | None = None) -> DataFrame:
    """Live contacts whose name, email, phone or role has q as it is, with exact company and role."""
    rows = _equal(live(contacts), {"company_id": company_id, "role": role})
    return rows.where(_like(q, ["name", "email", "phone", "role"])) if q else rows


def contact_order(sort: str = "createdAt", way: str = "desc") -> list[Column]:
    c = {"name": "name", "createdAt": "created_at"}.get(sort, "created_at")
    return [F.asc(c) if way == "asc" else F.desc(c), F.asc("id")]


def with_company(contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """Contacts with their live company as a struct, and an error where it is missing."""
    c = live(companies).select(F.col("id").alias("company_id"), F.struct("id", "name").alias("company"))
    out = live(contacts).join(c, "company_id", "left")
    return out.withColumn("error", F.when(F.col("company_id").isNotNull() & F.col("company").isNull(), "company_not_found"))


def delete_guard(companies: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Counts of live children by kind and whether the company may go. children: frames with company_id, deleted_at."""
    out, total = live(companies).select("id"), F.lit(0)
    for name, rows in children.items():
        counts = live(rows).groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias(f"n_{name}"))
        out = out.join(counts, "id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
        total += F.col(f"n_{name}")
    return out.withColumn("deletable", total == 0)


def interaction_feed(rows: DataFrame, company_id=None, contact_id=None, kind: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Interactions of an inclusive time range, to be sorted newest first; since after until is an error."""
    if since is not None and until is not None and since > until:
        raise ValueError("since is after until")
    rows = _equal(rows, {"company_id": company_id, "contact_id": contact_id, "type": kind})
    if since is not None:
        rows = rows.where(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    return rows if until is None else rows.where(F.col("occurred_at") <= F.lit(until).cast("timestamp"))


def latest_interaction(companies: DataFrame, interactions: DataFrame) -> DataFrame:
    last = interactions.groupBy("company_id").agg(F.max("occurred_at").alias("last_at"))
    return companies.select(F.col("id").alias("company_id")).join(last, "company_id", "left")


def deal_order(sort: str = "createdAt", way: str = "desc") -> list[Column]:
    """Nulls come last either way."""
    c = {"value": "value", "stage": "stage", "expectedCloseDate": "expected_close_date"}.get(sort, "created_at")
    return [F.asc_nulls_last(c) if way == "asc" else F.desc_nulls_last(c), F.asc("id")]


def deals(rows: DataFrame, company_id=None, stage: str | None = None) -> DataFrame:
    return _equal(rows, {"company_id": company_id, "stage": stage})


def deal_with_company(rows: DataFrame, companies: DataFrame) -> DataFrame:
    return rows.join(companies.select(F.col("id").alias("company_id"), F.struct("id", "name").alias("company")), "company_id", "left")


def canonical_stage(stage: Column) -> Column:
    """The canonical stage, by case-blind match or old name; anything else is lead. Applying it again changes nothing."""
    low = F.lower(stage)
    out = F.when(low.isin(*STAGES), low)
    for old, new in OLD_STAGES.items():
        out = out.when(low == old, new)
    return out.otherwise("lead")


def stage_requests(requests: DataFrame, moves: DataFrame) -> DataFrame:
    """code of every request: null if it may pass. requests: id, deal_found, creating, from_stage, to_stage, n_contacts, close_date."""
    allowed = F.broadcast(moves.withColumn("allowed", F.lit(True)))
    rows = requests.join(allowed, ["from_stage", "to_stage"], "left")
    code = (
        F.when(~F.col("creating") & ~F.col("deal_found"), "DEAL_NOT_FOUND")
        .when(F.col("creating") & F.col("to_stage").isNull(), None)
        .when(~F.coalesce(F.col("to_stage").isin(*STAGES), F.lit(False)), "UNKNOWN_STAGE")
        .when(F.col("creating"), F.when(~F.col("to_stage").isin("lead", "qualified"), "INVALID_INITIAL_STAGE"))
        .when(F.col("from_stage") == F.col("to_stage"), None)
        .when(F.col("allowed").isNull(), "INVALID_STAGE_TRANSITION")
        .when((F.col("to_stage") == "active") & (F.col("n_contacts") < 1), "TRANSITION_PRECONDITION_UNMET")
        .when((F.col("to_stage") == "negotiation") & F.col("close_date").isNull(), "TRANSITION_PRECONDITION_UNMET")
    )
    return rows.select("id", code.alias("code"))


#: Requests of a deal whose numbers fall into one range of this width are replayed together; so many neighbouring ranges are composed at once.
REPLAY_RANGE, COMPOSED = 10_000, 64


def replay_stages(requests: DataFrame, width: int = REPLAY_RANGE) -> DataFrame:
    """Each deal's moves in order of seq, from lead: deal_id, moves, rejected, stage. A rejected move changes nothing.

    requests: deal_id, seq (distinct in a deal), to_stage, n_contacts, has_close_date. A range of
    requests is a map from the stage before it to the stage after it, with the rejections on the way: six places each. Such maps
    compose associatively, so ranges are folded apart from each other, then neighbours are composed in a tree. No
    row or task holds all requests of a busy deal, or all its ranges.
    """
    here = F.array(*[F.lit(i) for i in range(len(STAGES))])
    place = lambda stage: F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage).cast("int") - 1
    may = F.array(*[F.lit((a, b) in set(STAGE_MOVES)) for a in STAGES for b in STAGES])
    identity = F.struct(here.alias("after"), F.array_repeat(F.lit(0).cast("long"), len(STAGES)).alias("rejected"))

    def moved(state: Column, ask: Column) -> Column:
        goes = lambda at: ask["met"] & F.get(may, at * len(STAGES) + ask["to"])
        known = ask["to"] >= 0
        return F.struct(
            F.transform(state["after"], lambda at: F.when(known & goes(at), ask["to"]).otherwise(at)).alias("after"),
            F.zip_with(state["rejected"], state["after"], lambda n, at: n + F.when((known & goes(at)) | (at == ask["to"]), 0).otherwise(1)).alias("rejected"),
        )

    def composed(first: Column, then: Column) -> Column:
        return F.struct(
            F.transform(first["after"], lambda at: F.get(then["after"], at)).alias("after"),
            F.zip_with(first["rejected"], first["after"], lambda n, at: n + F.get(then["rejected"], at)).alias("rejected"),
        )

    to = F.col("to_stage")
    met = F.coalesce(((to != "active") | (F.col("n_contacts") >= 1)) & ((to != "negotiation") | F.col("has_close_date")), F.lit(False))
    low, high = requests.agg(F.floor(F.min("seq") / width), F.floor(F.max("seq") / width)).first()
    asks = requests.select("deal_id", (F.floor(F.col("seq") / width) - F.lit(low or 0)).alias("part"), F.struct("seq", F.coalesce(place(to), F.lit(-1)).alias("to"), met.alias("met")).alias("ask"))
    maps = asks.groupBy("deal_id", "part").agg(F.count("*").alias("moves"), F.array_sort(F.collect_list("ask")).alias("asks")).select("deal_id", "part", "moves", F.aggregate("asks", identity, moved).alias("map"))
    span = (high or 0) - (low or 0)
    while span:
        span //= COMPOSED
        grouped = maps.groupBy("deal_id", F.floor(F.col("part") / COMPOSED).alias("part")).agg(F.sum("moves").alias("moves"), F.array_sort(F.collect_list(F.struct("part", "map"))).alias("maps"))
        maps = grouped.select("deal_id", "part", "moves", F.aggregate("maps", identity, lambda s, m: composed(s, m["map"])).alias("map"))
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), F.col("map.after")[0])
    return maps.select("deal_id", "moves", F.col("map.rejected")[0].alias("rejected"), stage.alias("stage"))


def migrate_links(contacts: DataFrame, existing: DataFrame) -> DataFrame:
    """Primary links that contacts' company keys still lack, of a repeated contact the least; running it again adds none."""
    wanted = contacts.where("company_id is not null").groupBy(F.col("id").alias("contact_id")).agg(F.min("company_id").alias("company_id")).withColumn("is_primary", F.lit(True))
    return wanted.join(existing.select("contact_id").distinct(), "contact_id", "left_anti")


def primary_violations(contacts: DataFrame, links: DataFrame) -> DataFrame:
    """Contacts with links but not exactly one primary."""
    counts = links.groupBy("contact_id").agg(F.count_if("is_primary").alias("primaries"))
    return contacts.select(F.col("id").alias("contact_id")).join(counts, "contact_id").where("primaries <> 1")


def foreign_primaries(deal_links: DataFrame, deals_: DataFrame) -> DataFrame:
    """Deals whose primary contact is not among their links."""
    return deals_.where("primary_contact_id is not null").join(deal_links.select("deal_id", F.col("contact_id").alias("primary_contact_id")).distinct(), ["deal_id", "primary_contact_id"], "left_anti")


def contact_companies(links: DataFrame, companies: DataFrame, company_id=None) -> DataFrame:
    """Contacts with their companies, the primary first; filtered by any link."""
    named = links.join(companies.select(F.col("id").alias("company_id"), "name"), "company_id")
    if company_id is not None:
        named = named.join(links.where(F.col("company_id") == company_id).select("contact_id").distinct(), "contact_id", "left_semi")
    rows = named.groupBy("contact_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("secondary"), "company_id", "name"))).alias("c"))
    return rows.select("contact_id", F.transform("c", lambda x: x["company_id"]).alias("company_ids"), F.array_join(F.transform("c", lambda x: x["name"]), ", ").alias("companies"))


def company_mismatches(rows: DataFrame, contacts: DataFrame) -> DataFrame:
    """Rows (id, company_id, contact_id) whose contact belongs to another company."""
    c = contacts.select(F.col("id").alias("contact_id"), F.col("company_id").alias("contact_company_id"))
    return rows.join(c, "contact_id").where("company_id <> contact_company_id")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key names no live parent."""
    return rows.where(F.col(key).isNotNull()).join(live(parents).select(F.col("id").alias(key)), key, "left_anti")


def in_future(occurred_at: Column, now: str) -> Column:
    """More than a minute after now."""
    return occurred_at > F.lit(now).cast("timestamp") + F.expr("interval 60 seconds")
