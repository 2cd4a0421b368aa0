"""Queries of the CRM table work: customers are companies, suppliers contacts, orders deals, events interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import dims
from waymark.operators import crm
from waymark.plans.bindings import table
from waymark.plans.core import query

_CO = """co AS (SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '')) || '@x.com' AS email, CAST(1000 + c_custkey AS VARCHAR) AS phone, CAST(c_custkey % 3 AS INTEGER) AS status, c_mktsegment AS industry, c_custkey % 17 = 0 AS gone FROM customer)"""
_CT = """ct AS (SELECT s_suppkey AS id, s_suppkey * 7 % 1601 AS company_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Buyer' WHEN 1 THEN 'CTO' END AS role, s_suppkey % 13 = 0 AS gone FROM supplier)"""
_DE = """de AS (SELECT o_orderkey AS id, o_custkey AS company_id, o_orderkey % 110 AS contact_id, CASE o_orderkey % 9 WHEN 0 THEN 'WON' WHEN 1 THEN 'Lead' WHEN 2 THEN 'proposal_sent' WHEN 3 THEN '' WHEN 4 THEN 'closed_LOST' WHEN 5 THEN 'other' WHEN 6 THEN 'prospect' WHEN 7 THEN 'active' END AS stage, o_totalprice AS v, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS expected FROM orders)"""
_CANON = "CASE lower(stage) WHEN 'won' THEN 'closed_won' WHEN 'lost' THEN 'closed_lost' WHEN 'prospect' THEN 'lead' WHEN 'proposal_sent' THEN 'negotiation' ELSE CASE WHEN lower(stage) IN ('lead', 'qualified', 'active', 'negotiation', 'closed_won', 'closed_lost') THEN lower(stage) ELSE 'lead' END END"


def companies(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@x.com")).alias("email"), (k + 1000).cast("string").alias("phone"), (k % 3).cast("int").alias("status"), F.col("c_mktsegment").alias("industry"), F.when(k % 17 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))


def contacts(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (k * 7 % 1601).alias("company_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("phone"), F.when(k % 3 == 0, "Buyer").when(k % 3 == 1, "CTO").alias("role"), k.alias("created_at"), F.when(k % 13 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))


def deals(spark, d):
    k = F.col("o_orderkey")
    names = ["WON", "Lead", "proposal_sent", "", "closed_LOST", "other", "prospect", "active", None]
    return table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("company_id"), (k % 110).alias("contact_id"), F.get(F.array(*[F.lit(n) for n in names]), (k % 9).cast("int")).alias("stage"), F.col("o_totalprice").alias("value"), F.when(k % 4 != 0, F.col("o_orderdate")).alias("expected_close_date"), k.alias("created_at"))


def interactions(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("company_id"), (F.col("event_id") % 110).alias("contact_id"), F.col("event_type").alias("type"), F.col("ts").alias("occurred_at"))


@query("r01_company_search", f"WITH {_CO} SELECT id, name FROM co WHERE NOT gone AND status = 1 AND (name ILIKE '%mer#00000%7%' OR email ILIKE '%mer#00000%7%' OR phone ILIKE '%mer#00000%7%') ORDER BY id DESC LIMIT 20 OFFSET 20")
def r01(spark, d):
    return crm.PageDirectory(crm.company_search(companies(spark, d), " mer#00000%7 ", status=1), [F.desc("id")]).page(2, 20).select("id", "name")


@query("r02_contact_search", f"WITH {_CT} SELECT id, name, role FROM ct WHERE NOT gone AND role ILIKE '%uye%' ORDER BY name, id LIMIT 10")
def r02(spark, d):
    return crm.PageDirectory(crm.contact_search(contacts(spark, d), "uye"), crm.contact_order("name", "asc")).page().select("id", "name", "role")


@query("r03_page_meta", f"WITH {_CO} SELECT 1 AS page, 100 AS \"limit\", count(*) AS total, CAST(ceil(count(*) / 100) AS BIGINT) AS total_pages FROM co WHERE NOT gone")
def r03(spark, d):
    return crm.page_meta(crm.live(companies(spark, d)), "x", "1000")


@query("r04_live", f"WITH {_CO} SELECT id FROM co WHERE NOT gone")
def r04(spark, d):
    return crm.live(companies(spark, d)).select("id")


@query("r05_contact_with_company", f"WITH {_CO}, {_CT} SELECT ct.id, co.name AS company, CASE WHEN co.id IS NULL THEN 'company_not_found' END AS error FROM ct LEFT JOIN co ON co.id = ct.company_id AND NOT co.gone WHERE NOT ct.gone")
def r05(spark, d):
    return crm.with_company(contacts(spark, d), companies(spark, d)).select("id", F.col("company.name").alias("company"), "error")


@query("r06_delete_guard", f"WITH {_CO}, {_CT} SELECT id, (SELECT count(*) FROM ct WHERE ct.company_id = co.id AND NOT ct.gone) AS n_contacts, (SELECT count(*) FROM orders WHERE o_custkey = co.id) AS n_deals, NOT EXISTS (SELECT 1 FROM ct WHERE ct.company_id = co.id AND NOT ct.gone) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = co.id) AS deletable FROM co WHERE NOT gone")
def r06(spark, d):
    return crm.delete_guard(companies(spark, d), {"contacts": contacts(spark, d), "deals": deals(spark, d).withColumn("deleted_at", F.lit(None).cast("timestamp"))})


@query("r07_interaction_feed", "SELECT event_id AS id, user_id AS company_id, ts AS occurred_at FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-10' ORDER BY ts DESC, id LIMIT 50")
def r07(spark, d):
    rows = crm.interaction_feed(interactions(spark, d), kind="click", since="2024-01-02 00:00:00", until="2024-01-10 00:00:00")
    return crm.paginate(rows, [F.desc("occurred_at"), F.asc("id")], 1, 50).select("id", "company_id", "occurred_at")


@query("r08_latest_interaction", "SELECT c_custkey AS company_id, max(ts) AS last_at FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def r08(spark, d):
    return crm.latest_interaction(companies(spark, d), interactions(spark, d))


@query("r09_deals", f"WITH {_DE} SELECT id, expected AS expected_close_date FROM de WHERE stage = 'active' ORDER BY expected DESC NULLS LAST, id LIMIT 100 OFFSET 100")
def r09(spark, d):
    return crm.PageDirectory(crm.deals(deals(spark, d), stage="active"), crm.deal_order("expectedCloseDate")).page(2, 100).select("id", "expected_close_date")


@query("r03_far_page", f"WITH {_DE} SELECT id, expected AS expected_close_date, (SELECT CAST(ceil(count(*) / 100) AS BIGINT) FROM de) AS total_pages FROM de ORDER BY expected DESC NULLS LAST, id LIMIT 100 OFFSET (SELECT 100 * (CAST(ceil(count(*) / 100) AS BIGINT) - 2) FROM de)")
def r03_far(spark, d):
    """The last page but one of all deals by close date: only the ranges it lies in are read."""
    pages = crm.PageDirectory(deals(spark, d), crm.deal_order("expectedCloseDate"), ranges=32)
    last = pages.meta(1, 100)["total_pages"]
    return pages.page(last - 1, 100).select("id", "expected_close_date", F.lit(last).cast("long").alias("total_pages"))


@query("r10_deal_with_company", "SELECT o_orderkey AS id, c_custkey AS company_id, c_name AS company FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def r10(spark, d):
    return crm.deal_with_company(deals(spark, d), companies(spark, d)).select("id", F.col("company.id").alias("company_id"), F.col("company.name").alias("company"))


@query("r11_canonical_stage", f"WITH {_DE} SELECT id, {_CANON} AS stage FROM de")
def r11(spark, d):
    once = deals(spark, d).withColumn("stage", crm.canonical_stage(F.col("stage")))
    return once.select("id", crm.canonical_stage(F.col("stage")).alias("stage"))


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in dims.STAGE_MOVES)


@query("r12_stage_requests", f"""WITH {_DE}, q AS (SELECT id, id % 10 <> 0 AS found, id % 12 = 0 AS creating, {_CANON} AS f, (['lead', 'qualified', 'active', 'negotiation', 'closed_won', 'closed_lost', 'odd'])[company_id % 7 + 1] AS t, contact_id % 3 AS n, expected FROM de)
SELECT id, CASE WHEN NOT creating AND NOT found THEN 'DEAL_NOT_FOUND' WHEN t = 'odd' THEN 'UNKNOWN_STAGE' WHEN creating THEN CASE WHEN t NOT IN ('lead', 'qualified') THEN 'INVALID_INITIAL_STAGE' END WHEN f = t THEN NULL WHEN (f, t) NOT IN ({_ALLOWED}) THEN 'INVALID_STAGE_TRANSITION'
WHEN t = 'active' AND n < 1 THEN 'TRANSITION_PRECONDITION_UNMET' WHEN t = 'negotiation' AND expected IS NULL THEN 'TRANSITION_PRECONDITION_UNMET' END AS code FROM q""")
def r12(spark, d):
    to = F.get(F.array(*[F.lit(s) for s in [*dims.STAGES, "odd"]]), (F.col("company_id") % 7).cast("int"))
    requests = deals(spark, d).select("id", (F.col("id") % 10 != 0).alias("deal_found"), (F.col("id") % 12 == 0).alias("creating"), crm.canonical_stage(F.col("stage")).alias("from_stage"), to.alias("to_stage"), (F.col("contact_id") % 3).alias("n_contacts"), F.col("expected_close_date").alias("close_date"))
    return crm.stage_requests(requests, dims.stage_moves(spark))


_MOVES = ", ".join(f"('{a}', '{b}')" for a, b in dims.STAGE_MOVES)


@query("r13_replay_stages", f"""WITH RECURSIVE q AS (SELECT user_id AS deal_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, ([{', '.join(repr(x) for x in dims.STAGES)}])[event_id % 6 + 1] AS t, event_id % 5 AS n, event_id % 7 <> 0 AS dated FROM events),
r AS (SELECT DISTINCT deal_id, CAST(0 AS BIGINT) AS k, '{dims.STAGES[0]}' AS stage, CAST(0 AS BIGINT) AS rejected FROM q
 UNION ALL SELECT r.deal_id, q.k, CASE WHEN (t <> 'active' OR n >= 1) AND (t <> 'negotiation' OR dated) AND (stage, t) IN ({_MOVES}) THEN t ELSE stage END,
  rejected + CASE WHEN t = stage OR ((t <> 'active' OR n >= 1) AND (t <> 'negotiation' OR dated) AND (stage, t) IN ({_MOVES})) THEN 0 ELSE 1 END FROM r JOIN q ON q.deal_id = r.deal_id AND q.k = r.k + 1)
SELECT deal_id, max(k) AS moves, arg_max(rejected, k) AS rejected, arg_max(stage, k) AS stage FROM r GROUP BY 1""")
def r13(spark, d):
    to = F.get(F.array(*[F.lit(s) for s in dims.STAGES]), (F.col("event_id") % 6).cast("int"))
    return crm.replay_stages(table(spark, d, "events").select(F.col("user_id").alias("deal_id"), F.col("event_id").alias("seq"), to.alias("to_stage"), (F.col("event_id") % 5).alias("n_contacts"), (F.col("event_id") % 7 != 0).alias("has_close_date")))


_LINKS = f"{_CT}, {_DE}, ex AS (SELECT contact_id, company_id, bool_or(coalesce(stage = 'WON', false)) AS is_primary FROM de JOIN (SELECT id FROM ct WHERE NOT gone) c ON c.id = de.contact_id WHERE v > 150000 GROUP BY 1, 2)"


def _links(spark, d):
    """Live contacts are linked to the companies of their large deals; a won deal makes the link primary."""
    large = deals(spark, d).where("value > 150000").join(crm.live(contacts(spark, d)).select(F.col("id").alias("contact_id")), "contact_id", "left_semi")
    return large.groupBy("contact_id", "company_id").agg(F.bool_or(F.coalesce(F.col("stage") == "WON", F.lit(False))).alias("is_primary"))


@query("r14_migrate_links", f"WITH {_LINKS} SELECT id AS contact_id, company_id, true AS is_primary FROM ct WHERE id NOT IN (SELECT contact_id FROM ex)")
def r14(spark, d):
    return crm.migrate_links(contacts(spark, d), _links(spark, d))


@query("r15_primary_violations", f"WITH {_LINKS} SELECT contact_id, coalesce(count(*) FILTER (WHERE is_primary), 0) AS primaries FROM ex GROUP BY 1 HAVING primaries <> 1")
def r15(spark, d):
    return crm.primary_violations(contacts(spark, d), _links(spark, d))


@query("r15_foreign_primaries", "SELECT o_orderkey AS deal_id, o_orderkey % 5 AS primary_contact_id FROM orders WHERE o_orderkey % 5 <> o_custkey % 5")
def r15_foreign(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("deal_id"), (F.col("o_custkey") % 5).alias("contact_id"), (F.col("o_orderkey") % 5).alias("primary_contact_id"))
    return crm.foreign_primaries(rows, rows.drop("contact_id")).select("deal_id", "primary_contact_id")


@query("r16_contact_companies", f"WITH {_LINKS} SELECT contact_id, list(company_id ORDER BY NOT is_primary, company_id) AS company_ids, string_agg(c_name, ', ' ORDER BY NOT is_primary, company_id) AS companies FROM ex JOIN customer ON c_custkey = company_id GROUP BY 1")
def r16(spark, d):
    return crm.contact_companies(_links(spark, d), companies(spark, d))


@query("r17_company_mismatches", f"WITH {_CT}, {_DE} SELECT de.id, de.company_id, ct.company_id AS contact_company_id FROM de JOIN ct ON ct.id = de.contact_id WHERE de.company_id <> ct.company_id")
def r17(spark, d):
    return crm.company_mismatches(deals(spark, d), contacts(spark, d)).select("id", "company_id", "contact_company_id")


@query("r18_orphans", f"WITH {_CO}, {_CT} SELECT id, company_id FROM ct WHERE company_id NOT IN (SELECT id FROM co WHERE NOT gone)")
def r18(spark, d):
    return crm.orphans(contacts(spark, d), companies(spark, d), "company_id").select("id", "company_id")


@query("r19_future", "SELECT event_id, ts > TIMESTAMP '2024-01-15 00:01:00' AS future FROM events")
def r19(spark, d):
    return table(spark, d, "events").select("event_id", crm.in_future(F.col("ts"), "2024-01-15 00:00:00").alias("future"))
