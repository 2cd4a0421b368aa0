"""The registered query of each operator, over its whole table, with its oracle where SQL has one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import divergence, language_id, lexical_search, pii, quality, warc_zst
from waymark.llm.chosen_path import similar_texts
from waymark.llm.decontaminate import contaminated, decontaminate
from waymark.llm.order_minhash import as_text, likeness, with_next, with_signature
from waymark.llm.rendezvous import shard
from waymark.llm.sentencepiece_codec import MODEL, encode_decode
from waymark.llm.token_counts import VOCABULARY, count_tokens
from waymark.llm.tool_calls import link


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a user turn asks of the assistant; `configure`, which system turns call, has no schema.
CHAT_SCHEMAS = {"reply": {"chars": ("integer", True), "prompt": ("string", True), "turn": ("integer", True)}}
#: Arguments are cut after so many characters, as a model's output limit does; the rest can't be parsed.
ARGUMENT_CHARS = 300


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation: user turns call `reply`, system turns `configure`, assistant turns answer the turn before.

    The tables hold no tool calls, so arguments and dependencies are derived from the texts, faults
    among them: a text of several lines gives its length as text, one under 60 characters is not
    passed on, one with commas adds a field. A call needs the calls of its conversation whose
    turns are its numbers of characters and of blanks, both modulo 8; they may come later, and may form cycles.
    """
    turns = _table(spark, sf_dir, "conversations")
    name = lambda t: F.concat("conv_id", F.lit("-"), t)
    asked = turns.where("role <> 'assistant'").select(
        name(F.col("turn")).alias("id"), F.col("conv_id").alias("conversation"), "turn", "text", F.when(F.col("role") == "user", "reply").otherwise("configure").alias("tool"), "conv_id"
    )
    quoted = F.to_json(F.struct(F.col("text").alias("prompt")))
    chars = F.length("text").cast("string")
    commas = F.length("text") - F.length(F.replace("text", F.lit(",")))
    fields = [
        F.concat(F.lit('"turn":'), "turn"),
        F.concat(F.lit('"chars":'), F.when(F.col("text").contains("\n"), F.concat(F.lit('"'), chars, F.lit('"'))).otherwise(chars)),
        F.when(F.length("text") >= 60, F.substring(quoted, F.lit(2), F.length(quoted) - 2)),
        F.when(commas > 0, F.concat(F.lit('"commas":'), commas)),
    ]
    arguments = F.left(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")), F.lit(ARGUMENT_CHARS))
    calls = asked.select("id", "conversation", "turn", "tool", arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("id"), F.col("conv_id").alias("conversation"), "turn", F.col("text").alias("content"))
    named = F.array(F.length("text") % 8, (F.length("text") - F.length(F.replace("text", F.lit(" ")))) % 8)
    edges = asked.select("id", "conv_id", "turn", F.explode(named).alias("other")).where("other <> turn").select("id", name(F.col("other")).alias("needs"))
    return link(calls, results, CHAT_SCHEMAS, edges)


_OP1_SQL = """
WITH RECURSIVE t AS (SELECT conv_id || '-' || turn AS id, *, length(text) - length(replace(text, ',', '')) AS commas, length(text) - length(replace(text, ' ', '')) AS blanks FROM conversations),
c AS (SELECT *, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS tool,
        1 + 7 + length(CAST(turn AS VARCHAR)) + 9 + length(CAST(length(text) AS VARCHAR)) + CASE WHEN contains(text, chr(10)) THEN 2 ELSE 0 END
        + CASE WHEN length(text) >= 60 THEN 10 + length(CAST(to_json(text) AS VARCHAR)) ELSE 0 END + CASE WHEN commas > 0 THEN 10 + length(CAST(commas AS VARCHAR)) ELSE 0 END + 1 > 300 AS bad
      FROM t WHERE role <> 'assistant'),
r AS (SELECT conv_id || '-' || (turn - 1) AS id, min(conv_id) AS conv_id, min(turn) AS turn, count(*) AS n, first(text ORDER BY turn, text) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1),
e AS (SELECT DISTINCT c.id, o.id AS needs, CAST(o.turn > c.turn AS INTEGER) AS up FROM c JOIN c o ON o.conv_id = c.conv_id AND o.turn <> c.turn AND o.turn IN (length(c.text) % 8, c.blanks % 8)),
sizes AS (SELECT conv_id, count(DISTINCT id) AS m FROM c GROUP BY 1),
walks AS (SELECT id, needs AS reached, up, 1 AS steps FROM e
          UNION SELECT w.id, e.needs, w.up + e.up, w.steps + 1 FROM walks w JOIN e ON w.reached = e.id WHERE w.steps < (SELECT max(m) FROM sizes)),
lv AS (SELECT id, max(up) AS level, max(steps) >= (SELECT max(m) FROM sizes) AS cyclic FROM walks GROUP BY 1)
SELECT coalesce(c.conv_id, r.conv_id) AS conversation, coalesce(c.id, r.id) AS id, CAST(CASE WHEN NOT coalesce(lv.cyclic, false) THEN coalesce(lv.level, 0) END AS INTEGER) AS level, c.turn AS turn,
       c.tool AS tool, r.turn AS result_turn, coalesce(r.n, 0) AS n_results,
       CASE WHEN c.id IS NULL THEN 'orphan_result' WHEN count(*) OVER (PARTITION BY c.id) > 1 THEN 'duplicate_id' WHEN coalesce(lv.cyclic, false) THEN 'cyclic' WHEN r.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       CASE WHEN c.id IS NULL THEN '' WHEN c.bad THEN 'bad_json' WHEN c.tool = 'configure' THEN 'unknown_tool'
            ELSE concat_ws(',', CASE WHEN length(c.text) < 60 THEN 'missing:prompt' END, CASE WHEN contains(c.text, chr(10)) THEN 'type:chars' END, CASE WHEN c.commas > 0 THEN 'unknown:commas' END) END AS errors,
       '{' || CASE WHEN NOT c.bad THEN '"arguments":{"chars":' || CASE WHEN contains(c.text, chr(10)) THEN '"' || length(c.text) || '"' ELSE CAST(length(c.text) AS VARCHAR) END || CASE WHEN c.commas > 0 THEN ',"commas":' || c.commas ELSE '' END
                || CASE WHEN length(c.text) >= 60 THEN ',"prompt":' || CAST(to_json(c.text) AS VARCHAR) ELSE '' END || ',"turn":' || c.turn || '},' ELSE '' END
           || '"id":' || CAST(to_json(coalesce(c.id, r.id)) AS VARCHAR) || CASE WHEN c.id IS NOT NULL THEN ',"name":"' || c.tool || '"' ELSE '' END
           || CASE WHEN r.id IS NOT NULL THEN ',"result":' || CAST(to_json(r.content) AS VARCHAR) ELSE '' END || '}' AS canonical_json
FROM c FULL OUTER JOIN r ON c.id = r.id LEFT JOIN lv ON lv.id = c.id
"""


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ringed = with_next(with_signature(docs, "text", "sig"), "doc_id", ["text", "sig"], F.xxhash64("text"))
    third = F.expr("int(length(text) div 3)")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring(F.col("next.text"), F.lit(1), third))
    signed = with_signature(ringed.withColumn("next_sig", F.col("next.sig")).withColumn("edited", edited).drop("next"), "edited", "edited_sig")
    return signed.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sig").alias("fingerprint"),
        as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


_OP3_SQL = r"""
WITH lower_ab AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lower_ab),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
b1 AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS ww FROM b1),
sizes AS (SELECT DISTINCT len(ww) AS n FROM win),
d1 AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
m AS (SELECT d1.doc_id, d1.s, d1.n, win.item_id FROM d1 JOIN win ON list_slice(d1.w, d1.s, d1.s + d1.n - 1) = win.ww),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL)).select(
        "doc_id",
        F.expr("cast(length(ids_le) div 4 as long)").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal weight; `key` is the law of rendezvous hashing."""
    return shard(_table(spark, sf_dir, "documents"), [1.0] * 8).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 2048 tokens are flagged."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)).withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_zst.new_folder(spark)
    return warc_zst.read_archives(warc_zst.write_archives(_table(spark, sf_dir, "pages"), folder), folder)


_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS leader, count(*) OVER (PARTITION BY coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, sha1(h) AS x FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN n > 1 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n > 1 AND page_id <> leader THEN leader END AS refers_to, true AS intact
FROM q
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    n_added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *[count(k) for k in pii.BASE_KINDS], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), n_added, (F.size("spans") > 0).alias("has_personal_data"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.7 are predicted to be of label 1."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_OP12_SQL = r"""
WITH lower_ab AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM lower_ab WHERE t IS NOT NULL),
all_n AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, all_n GROUP BY term),
s AS (SELECT q.item_id, tf.k, tf.doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN df USING (term), all_n GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM w GROUP BY 1, 2 HAVING count(*) >= 10),
langs AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS lang_n FROM kept GROUP BY 1),
c AS (SELECT w.lang, source, w.term, CAST(sum(n) AS BIGINT) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY 1, 2, 3),
g AS (SELECT d.lang, d.source, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS big_n FROM (SELECT DISTINCT lang, source FROM d) d),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (big_n + 2 * v) AS p, 1 + (1000000000 * (total + 2)) // (lang_n + 2 * v) AS q
      FROM g JOIN kept ON g.lang = kept.lang JOIN langs ON g.lang = langs.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr) QUALIFY part = 'pair' OR rank <= 10
"""


QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_order_minhash": op2_order_minhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_rendezvous": op5_rendezvous,
    "op6_chosen_path": op6_chosen_path,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_pii": op10_pii,
    "op11_quality": op11_quality,
    "op12_maxscore": op12_maxscore,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op1_tool_calls": _OP1_SQL,
    "op3_decontaminate": _OP3_SQL,
    "op8_warc": _OP8_SQL,
    "op12_maxscore": _OP12_SQL,
    "op13_divergence": _OP13_SQL,
}
