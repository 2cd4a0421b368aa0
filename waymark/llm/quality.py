"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, and runs of other characters that aren't white space, as they
are written. Their 1- and 2-grams are hashed into `BUCKETS` weights, and beside them the 1- to
4-grams of the words' forms: how a word is cased, whether it has digits, whether it repeats the word
before it; other runs keep their characters. A text's value for a bucket is the share of its grams there, times
`SCALE`; its score is the logistic function of the sparse dot product of values and weights.

`fit` learns from at most `PER_LABEL` rows of either label, those of the least hash of id and text,
and from at most `SAMPLE_CHARS` characters of each, from a start drawn by hash; the executors send
their hashed grams, and numpy makes `EPOCHS` passes of the per-coordinate updates over them. What that sample
changes in the labels' ratio is put back into the bias. Scores are of whole texts.

Rows without id or text, held-out rows, and ids whose labels differ or are neither 0 nor 1 are not
learned from; repeated rows count once. With one label alone, or none, the score is its smoothed share.
Empty and null texts have no grams: their score is that of the bias. Repeated rows give a row each, an
empty table gives none, and columns but the named ones are dropped or carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import checkpointed, mix, raw_text, slices

BUCKETS = 1 << 18
#: The training sample's bounds: rows of each label and characters of each row.
PER_LABEL, SAMPLE_CHARS = 3000, 8000
EPOCHS, SCALE = 6, 8.0
#: Of the updates: learning rate, its smoothing, and the penalties on absolute and squared weights.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.02
WORD_GRAMS, FORM_GRAMS = 2, 4

_SPACE, _LOWER, _UPPER, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[97:123] = _KIND[128:] = _LOWER
_KIND[65:91] = _UPPER
_KIND[48:58] = _DIGIT
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and form of each word, and the words' offsets by text."""
    kind = _KIND[data]
    group = np.where((kind >= _LOWER) & (kind <= _DIGIT), 1, np.where(kind == _OTHER, 2, 0))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    first = group > 0
    first[1:] &= (group[1:] != group[:-1]) | edge[1:-1]
    starts = np.flatnonzero(first)
    woffs = np.searchsorted(starts, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), woffs
    inside = group > 0
    at = np.concatenate([[0], np.cumsum(inside)])
    begin = at[starts]
    length = np.diff(np.append(begin, at[-1]))
    place = np.arange(at[-1]) - np.repeat(begin, length)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max()), _BASE, np.uint64)]))
    hashes = mix(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * power[place], begin))
    has = lambda k: np.maximum.reduceat((kind[inside] == k).astype(np.uint64), begin)
    inner = np.maximum.reduceat(((kind[inside] == _UPPER) & (place > 0)).astype(np.uint64), begin)
    again = np.zeros(len(starts), np.uint64)
    again[1:] = hashes[1:] == hashes[:-1]
    again[woffs[:-1][woffs[:-1] < len(starts)]] = 0
    cased = has(_LOWER) | has(_UPPER) << np.uint64(1) | inner << np.uint64(2) | has(_DIGIT) << np.uint64(3) | (length == 1).astype(np.uint64) << np.uint64(4)
    forms = np.where(group[starts] == 1, cased + np.uint64(1), hashes) * np.uint64(2) + again
    return hashes, forms, woffs


def grams(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every family and size of grams: the bucket of the gram at each word, and the texts' offsets; grams stay within their text."""
    hashes, forms, woffs = tokens(data, offs)
    n = np.diff(woffs)
    for family, (words, most) in enumerate(((hashes, WORD_GRAMS), (forms, FORM_GRAMS))):
        value = np.zeros(len(words), np.uint64)
        for size in range(1, most + 1):
            shifted = words[size - 1 :]
            value = mix(value[: len(shifted)] * _BASE + shifted + np.uint64(size))
            count = np.maximum(n - size + 1, 0)
            goffs = np.concatenate([[0], np.cumsum(count)])
            at = np.arange(goffs[-1]) + np.repeat(woffs[:-1] - goffs[:-1], count)
            yield (mix(value[at] + np.uint64(family * 16 + size)) % np.uint64(BUCKETS)).astype(np.int32), goffs


class Model:
    """Weights by bucket and the bias, which is all where nothing could be learned."""

    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = np.full(len(offs) - 1, self.bias)
        if self.weights is not None:
            for bucket, goffs in grams(data, offs):
                run = np.concatenate([[0.0], np.cumsum(self.weights[bucket])])
                size = np.diff(goffs)
                z += SCALE * (run[goffs[1:]] - run[goffs[:-1]]) / np.maximum(size, 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Per-coordinate follow-the-regularised-leader over (buckets, values) of each example; prior: the log ratio of labels to restore."""
    rng = np.random.default_rng(seed)
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the last is the bias
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at = np.append(examples[i][0], BUCKETS)
            x = np.append(examples[i][1], 1.0)
            w = _weights(z[at], n[at])
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x)))))
            g = (p - labels[i]) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = _weights(z, n)
    sampled = math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    return Model(w[:BUCKETS].astype(np.float32), float(w[BUCKETS]) + prior - sampled)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights: 0 where the gradients' sum is within the absolute penalty."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> Model:
    """A model of the learnable rows' sample. docs: doc_id, text; labels: doc_id, label 0 or 1."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64(F.lit("sample"), "doc_id", "text"))
    truth = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("most"))
    marked = checkpointed(rows.select("doc_id", "h").distinct().join(truth.where("label = most and label in (0, 1)"), "doc_id").select("h", "label"))
    size = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    ones, zeros = size.get(1, 0), size.get(0, 0)
    prior = math.log((ones + 1) / (zeros + 1))
    if not ones or not zeros:
        return Model(None, prior)
    least = [marked.where(F.col("label") == v).orderBy("h").limit(per_label) for v in (0, 1)]
    chosen = F.broadcast(least[0].unionByName(least[1]))  # at most 2 * per_label rows
    start = F.pmod("h", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    taken = rows.join(chosen, "h").dropDuplicates(["h"]).select("h", "label", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text"))
    found = sorted((r.h, r.label, r.at, r.x) for r in taken.mapInArrow(_examples, "h long, label int, at binary, x binary").collect())
    examples = [(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32).astype(np.float64)) for _, _, at, x in found]
    return train(examples, np.array([y for _, y, _, _ in found], np.float64), prior)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = raw_text(batch.column(2))
        found = list(grams(data, offs))
        at, value = [], []
        for i in range(batch.num_rows):
            own = [b[o[i] : o[i + 1]] for b, o in found]
            share = np.concatenate([np.full(len(b), SCALE / max(len(b), 1)) for b in own])
            bucket, to = np.unique(np.concatenate(own), return_inverse=True)
            at.append(bucket.astype(np.int32).tobytes())
            value.append(np.bincount(to, share, len(bucket)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["h", "label", "at", "x"])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to carry, and the score (0 to 1) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *[c for c in carry if c not in ("doc_id", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw_text(batch.column(1))
            scores = [shared.value.scores(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in slices(offs)]
            beside = [batch.column(batch.schema.get_field_index(c)) for c in ["doc_id", *carry]]
            yield pa.RecordBatch.from_arrays([*beside, pa.array(np.concatenate([np.zeros(0), *scores]))], names=["doc_id", *carry, "score"])

    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in ["doc_id", *carry])
    return rows.mapInArrow(run, f"{kept}score double")
