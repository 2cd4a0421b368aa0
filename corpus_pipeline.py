"""The corpus pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; its result is written
as Parquet and read again as the next stage's documents. Rows are judged one by one, so null or
repeated ids take no other row along. Null, empty and letterless texts go in the first stage; the others would
keep them. Of repeated rows the second stage keeps one. Very long texts are handled whole, and an empty
table gives an empty result. Other columns than those of documents are left out.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import language_id, pii
from waymark.llm.chosen_path import one_of_each
from waymark.llm.decontaminate import contaminated, decontaminate
from waymark.llm.sentencepiece_codec import MODEL, encode_decode
from waymark.llm.shared import checkpointed, ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; they stay as they are."""
    found = language_id.identify(docs, language_id.fit(docs), carry=COLUMNS[1:])
    return found.where("not rejected").select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the least id."""
    return one_of_each(docs).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    body = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"k1": F.xxhash64(body), "k2": F.xxhash64(F.lit(7), body)})
    found = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["k1", "k2"])
    return _without(keyed, found.where(contaminated()))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text."""
    return pii.redact(docs, pii.fit(docs)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and how many there are; the decoded text proves the round trip."""
    coded = encode_decode(docs, public_tokenizers.path(MODEL))
    return coded.select(
        "doc_id", F.expr("cast(length(ids_le) div 4 as long)").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids_le"
    )


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose text (128 bits, k1 and k2, stand for it) is not in `gone`.

    Words alone decide whether a row is contaminated, so rows of equal texts go together, and
    null or repeated ids take no other row along.
    """
    gone = checkpointed(gone.select("k1", "k2").distinct())
    if gone.count() <= 1_000_000:  # 16 MB of keys; more are shuffled
        gone = F.broadcast(gone)
    return keyed.join(gone, ["k1", "k2"], "left_anti").select(COLUMNS)


STAGES = [
    ("language_id", keep_identified),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the cluster's shared folder."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification, personal data and encoding have no SQL form; tests compare run()'s ids with the library's over the rows that should stay.
ORACLE_SQL = None
