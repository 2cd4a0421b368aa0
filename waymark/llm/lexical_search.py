"""Ranked lexical search: MaxScore whose bounds are tightened by pairs of terms.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased, of whole
texts. `postings` numbers the items' terms and keeps, for each document, its number of terms and how often
it has each of them; `statistics` sums them up. `search` cuts the documents of a task into segments of
`SEGMENT` and gives each an index: a list of documents and impacts for every term with the list's
greatest impact, and for the pairs of terms that items ask for, the intersection of their two lists
with its greatest joint impact. An item's bound over some terms is the sum of the terms' greatest impacts;
where two are a pair, no document has more of them than the greater of the joint impact
and either impact alone, which is less than their sum. Pairs are combined at query time, those that save most
first. Terms (alone or in pairs) whose bounds together stay below the item's tenth best score so far can't
bring a document in by themselves: only the documents in the other lists are scored, and are dropped as
soon as what is left can't lift them to that score. The best of each task are merged by a window.

Items are read in blocks of at most about `BLOCK_ENTRIES` (item, term) entries, which are broadcast; every
block meets all documents. All arithmetic is in integers, so results are exact: equal scores are ordered by id.

Documents with null texts or without terms are found by no item and don't count. Rows of documents with an equal
id are ranked each; null ids come last among equal scores. Items of equal id (null, too) are one item with
the terms of all of them, once each; an item without terms finds nothing. Empty tables give an empty result; other
columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.shared import WORD_BYTES, checkpointed, raw_text, slices, word_strings

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
#: Documents of a segment, documents that a task should have at least, and the most tasks.
SEGMENT, TASK_DOCUMENTS, MOST_TASKS = 1 << 13, 1 << 14, 20_000
#: (item, term) entries that are broadcast at once.
BLOCK_ENTRIES = 1_000_000
#: A term is paired with so many of the item's terms that are next to it in weight.
NEIGHBOURS = 3


class Items:
    """A block of items: their ids, the sorted distinct terms, and each item's terms as numbers."""

    def __init__(self, ids: list, offs: np.ndarray, numbers: np.ndarray, vocabulary: pa.Array):
        self.ids, self.offs, self.numbers, self.vocabulary = ids, offs, numbers, vocabulary


class Statistics:
    """N and L of all documents, the terms' weights, and the pairs of terms that items ask for (of neighbours by weight)."""

    def __init__(self, items: Items, n_docs: int, n_terms: int, df: np.ndarray):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        self.weight[df == 0] = 0  # no document has them
        pairs = []
        for i in range(len(items.ids)):
            own = items.numbers[items.offs[i] : items.offs[i + 1]]
            own = own[np.lexsort((own, self.weight[own]))]
            pairs += [np.sort(np.stack([own[:-d], own[d:]], axis=1), axis=1) for d in range(1, NEIGHBOURS + 1) if len(own) > d]
        self.pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term: every term of an item once."""
    lower = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col(item_id).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERMS), F.lit(0)))).alias("term")).distinct()


def blocks(terms: DataFrame, most: int = BLOCK_ENTRIES) -> Iterator[Items]:
    """The items in blocks of about `most` entries; an item is never split."""
    terms = checkpointed(terms)
    n = -(-terms.count() // most)
    for b in range(n):
        some = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "term").toArrow()
        if not some.num_rows:
            continue
        words = some["term"].combine_chunks()
        words = words.cast(pa.string())
        vocabulary = pc.unique(words)
        ids = some["item_id"].to_pylist()
        heads = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        yield Items([ids[i] for i in heads], np.array([*heads, len(ids)]), pc.index_in(words, vocabulary).to_numpy(zero_copy_only=False).astype(np.int64), vocabulary)


def postings(docs: DataFrame, shared, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, terms and counts (little-endian 32-bit integers) of every document with a term; shared: the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        for batch in batches:
            data, offs = raw_text(batch.column(1))
            for lo, hi in slices(offs):
                words, woffs = word_strings(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], WORD_BYTES)
                coded = words.dictionary_encode()
                number = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                number = number[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(hi - lo), np.diff(woffs))
                key, count = np.unique(doc[number >= 0] * (len(vocabulary) + 1) + number[number >= 0], return_counts=True)
                cut = np.searchsorted(key, np.arange(hi - lo + 1) * (len(vocabulary) + 1))
                term, count = (key % (len(vocabulary) + 1)).astype("<i4"), count.astype("<i4")
                some = np.flatnonzero(np.diff(woffs))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(some)),
                        pa.array(np.diff(woffs)[some].astype(np.int64)),
                        pa.array([term[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                        pa.array([count[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms binary, counts binary")


def statistics(posted: DataFrame, items: Items) -> Statistics:
    """Counts over all documents; a row for each task and term comes together, and at most one for each of the block's terms to the driver."""
    size = len(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(_numbers(batch.column(0)), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    total = posted.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(size, np.int64)
    for r in posted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    return Statistics(items, total.n, total.l, df)


def _numbers(column: pa.Array) -> np.ndarray:
    """A binary column of 32-bit integers, one row after the other."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "<i4", (offs[-1] - offs[0]) // 4, offs[0]).astype(np.int64) if data is not None and len(column) else np.zeros(0, np.int64)


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4


class Segment:
    """The index of some documents: lists and greatest impacts of terms, intersections and greatest joint impacts of pairs."""

    def __init__(self, stats: Statistics, n: np.ndarray, term: np.ndarray, count: np.ndarray, held: np.ndarray):
        m = 100 - 90 + (90 * n * stats.n_docs) // stats.n_terms
        doc = np.repeat(np.arange(len(n)), held)
        impact = stats.weight[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.n, self.doc, self.impact = len(n), doc[order], impact[order]
        self.offs = np.searchsorted(term[order], np.arange(len(stats.weight) + 1))
        self.most = np.zeros(len(stats.weight), np.int64)
        some = np.flatnonzero(np.diff(self.offs))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact, self.offs[some])
        self.joint: dict[tuple[int, int], int] = {}
        self.partners: dict[int, list[int]] = {}
        dense = np.zeros(self.n, np.int64)
        last = -1
        for a, b in stats.pairs.tolist():
            if self.most[a] and self.most[b]:
                if a != last:  # pairs are sorted by their first term
                    if last >= 0:
                        dense[self.docs(last)] = 0
                    dense[self.docs(a)] = self.impacts(a)
                    last = a
                met = dense[self.docs(b)]
                self.joint[a, b] = int(np.max(met + self.impacts(b), where=met > 0, initial=0))
                self.partners.setdefault(a, []).append(b)
                self.partners.setdefault(b, []).append(a)

    def docs(self, t: int) -> np.ndarray:
        return self.doc[self.offs[t] : self.offs[t + 1]]

    def impacts(self, t: int) -> np.ndarray:
        return self.impact[self.offs[t] : self.offs[t + 1]]

    def bounds(self, terms: np.ndarray) -> tuple[list[int], list[int]]:
        """The terms by ascending greatest impact, and the bound of each prefix of them (from none on).

        A term that joins a prefix is combined with the free one there with which it saves most: the pair's bound replaces the sum.
        """
        own = sorted((int(t) for t in terms if self.most[t]), key=lambda t: (self.most[t], t))
        out, free = [0], set()
        for t in own:
            gain, partner = 0, -1
            for s in self.partners.get(t, ()):
                if s in free:
                    both = (s, t) if s < t else (t, s)
                    saved = int(self.most[s] + self.most[t] - max(self.joint[both], self.most[s], self.most[t]))
                    if saved > gain:
                        gain, partner = saved, s
            out.append(out[-1] + int(self.most[t]) - gain)
            if gain:
                free.discard(partner)
            else:
                free.add(t)
        return own, out

    def best(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents whose scores are at least `least` and above 0, the scores, and how many documents were scored."""
        own, bound = self.bounds(terms)
        cheap = max(bisect.bisect_left(bound, least) - 1, 0)  # the longest prefix that stays below
        if cheap == len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        # sums are below 2 ** 53, so they are exact in doubles
        score = np.bincount(np.concatenate([self.docs(t) for t in own[cheap:]]), np.concatenate([self.impacts(t) for t in own[cheap:]]), self.n).astype(np.int64)
        found = np.flatnonzero(score)
        total, scored = score[found], len(found)
        for i in range(cheap - 1, -1, -1):
            keep = total + bound[i + 1] >= least
            found, total = found[keep], total[keep]
            docs = self.docs(own[i])
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            total = total + np.where(docs[at] == found, self.impacts(own[i])[at], 0)
        keep = total >= max(least, 1)
        return found[keep], total[keep], scored


class Best:
    """The best rows of an item so far: highest score first, then the least id, nulls last."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, bool, object]] = []

    @property
    def least(self) -> int:
        return -self.rows[BEST - 1][0] if len(self.rows) >= BEST else 0

    def add(self, rows: list[tuple[int, bool, object]]) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:BEST]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, SEGMENT - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == SEGMENT:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def search(posted: DataFrame, shared) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents of each item; shared: the broadcast (items, item type, statistics)."""
    id_type = posted.schema["doc_id"].dataType.simpleString()
    item_type = shared.value[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, _, stats = shared.value
        best, kinds = [Best() for _ in items.ids], None
        asked = []
        for i in range(len(items.ids)):
            own = items.numbers[items.offs[i] : items.offs[i + 1]]
            asked.append(own[np.lexsort((own, stats.weight[own]))])
        for table in _segments(batches):
            ids, _, terms, counts = (c.combine_chunks() for c in table.columns)
            kinds = ids.type
            index = Segment(stats, table.column(1).to_numpy(), _numbers(terms), _numbers(counts), _sizes(terms))
            for own, top in zip(asked, best, strict=True):
                found, score, _ = index.best(own, top.least)
                if len(found) > BEST:  # of equal scores all stay, the ids decide
                    keep = score >= np.partition(score, -BEST)[-BEST]
                    found, score = found[keep], score[keep]
                if len(found):
                    top.add([(-s, d is None, d) for s, d in zip(score.tolist(), ids.take(pa.array(found)).to_pylist(), strict=True)])
        if kinds is not None:
            rows = [(i, d, -s) for i, top in enumerate(best) for s, _, d in top.rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kinds), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    found = posted.mapInArrow(run, f"item long, doc_id {id_type}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
    names = posted.sparkSession.createDataFrame(list(enumerate(shared.value[0].ids)), f"item long, item_id {item_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most a block's items


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", entries: int = BLOCK_ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: the `BEST` documents of each item."""
    spark = docs.sparkSession
    item_type = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {docs.schema[doc_id].dataType.simpleString()}, score long")
    for block in blocks(item_terms(items, item_id, text), entries):
        posted = checkpointed(postings(docs, spark.sparkContext.broadcast(block), doc_id, text))
        stats = statistics(posted, block)
        if stats.n_docs:
            tasks = min(max(stats.n_docs // TASK_DOCUMENTS, spark.sparkContext.defaultParallelism), MOST_TASKS)
            out = out.unionByName(search(posted.coalesce(tasks), spark.sparkContext.broadcast((block, item_type, stats))))
    return out
