"""Benchmark decontamination by a prefix-filtered set join.

A window (13 consecutive words of a benchmark item) is a set of word shingles. A document
contains the window only if it has all of its shingles, so for containment 1 the necessary
prefix of a window, with its shingles ordered by rarity, is the one rarest shingle. The steps:

1. benchmark windows and their shingles, both as tables;
2. one scan of the documents keeps, per document, the positions of words that start a
   benchmark shingle. Workers pre-filter with a bitmap of `BITS_EACH` bits for each shingle, at most
   2**MOST_BITS (16 million shingles, more than any benchmark has); a false positive only costs a row;
3. corpus frequencies of the kept shingles order each window's shingles by rarity;
4. document shingles join the windows' prefix shingles; the place of the shingle in the window
   gives where the window must start, which bounds position and length;
5. the words over the whole window are compared, so hash collisions cannot add a hit.

Texts without words (null, empty, punctuation) have n_words 0 and are never contaminated.
Repeated rows each get their own result row; ids may be null or repeated. Items with fewer
words than a window are one window; items without words match nothing. An empty benchmark
contaminates nothing. Extra columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.shared import checkpointed, hashed_words, raw_text, shingles, slices

WINDOW, SHINGLE = 13, 5
#: Size of the workers' pre-filter: bits for each shingle, and its least and largest size as powers of two (128 kB, 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 28
#: Up to so many rows of item, window and shingle, windows are broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 500_000
#: Places of a region of neighbouring hits.
REGION = 64

_ITEM_SCHEMA = "item_id string, win_words array<string>, shingle_at int, shingle long"
_DOC_SCHEMA = "row_id long, doc_id long, n_words long, at array<int>, shingle array<long>, region array<int>, region_start array<int>, region_words array<array<string>>"


def _item_windows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw_text(batch.column(1))
            ids, out = batch.column(0).to_pylist(), {"item_id": [], "win_words": [], "shingle_at": [], "shingle": []}
            for lo, hi in slices(offs):
                h, s, e, woffs = hashed_words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                sh, soffs = shingles(h, woffs, k)
                part = data[offs[lo] : offs[hi]]
                for i in range(hi - lo):
                    words = _words(part, s[woffs[i] : woffs[i + 1]], e[woffs[i] : woffs[i + 1]])
                    own = sh[soffs[i] : soffs[i + 1]]
                    if 0 < len(words) < k:  # documents look it up at its own width
                        own, _ = shingles(h[woffs[i] : woffs[i + 1]], np.array([0, len(words)]), len(words))
                    own = own.view(np.int64).tolist()
                    for w in range(max(len(words) - window + 1, min(len(words), 1))):
                        win = words[w : w + window]
                        for j in range(max(len(win) - k + 1, 1)):
                            for name, v in zip(out, (ids[lo + i], win, j, own[w + j]), strict=True):
                                out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item_id", pa.string()), ("win_words", pa.list_(pa.string())), ("shingle_at", pa.int32()), ("shingle", pa.int64())]))

    return run


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The words as text; only A-Z are lower-cased."""
    return [bytes(data[a:b]).lower().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _marked_documents(bitmap, short: frozenset, window: int, k: int, carry: list[str]):
    """Per document its word count and where benchmark shingles may start, with the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        mask = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            data, offs = raw_text(batch.column(2))
            for lo, hi in slices(offs):
                part = data[offs[lo] : offs[hi]]
                h, s, e, woffs = hashed_words(part, offs[lo : hi + 1] - offs[lo])
                places, found = [], []
                for width in sorted(short | {k}):  # items shorter than a shingle are looked up at their own width
                    sh, soffs = shingles(h, woffs, width)
                    full = np.repeat(np.diff(woffs) >= width, np.diff(soffs))
                    low = sh & mask
                    hit = np.flatnonzero(full & ((bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1).astype(bool))
                    places.append(hit + np.repeat(woffs[:-1] - soffs[:-1], np.diff(soffs))[hit])
                    found.append(sh[hit])
                place, hashes = np.concatenate(places), np.concatenate(found)
                order = np.argsort(place, kind="stable")
                place, hashes = place[order], hashes[order].view(np.int64)
                cut = np.searchsorted(place, woffs)
                doc = np.repeat(np.arange(hi - lo), np.diff(cut))
                # places near each other share a region of at most REGION places, so that a hit carries few words; ends rise with the places
                begin, end = np.maximum(place - (window - 1), woffs[doc]), np.minimum(place + window, woffs[doc + 1])
                new = np.ones(len(place), bool)
                tile = (place - woffs[doc]) // REGION
                new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1]) | (tile[1:] != tile[:-1])
                heads = np.flatnonzero(new)
                first, last = begin[heads], end[np.append(heads[1:], len(place)) - 1] if len(heads) else heads
                rcut = np.searchsorted(doc[heads], np.arange(hi - lo + 1))
                words = [_words(part, s[x:y], e[x:y]) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                listed = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(j).slice(lo, hi - lo).cast(pa.int64()) for j in (0, 1)), pa.array(np.diff(woffs), pa.int64()),
                        listed(cut, place - woffs[doc], pa.int32()), listed(cut, hashes, pa.int64()), listed(cut, np.cumsum(new) - 1 - rcut[doc], pa.int32()),
                        listed(rcut, first - woffs[doc[heads]], pa.int32()), listed(rcut, words, pa.list_(pa.string())),
                        *(batch.column(3 + j).slice(lo, hi - lo) for j in range(len(carry))),
                    ],
                    names=[*_DOC_COLUMNS, *carry],
                )

    return run


_DOC_COLUMNS = ["row_id", "doc_id", "n_words", "at", "shingle", "region", "region_start", "region_words"]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = SHINGLE, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings) of each document; columns to carry stand beside their row's figures."""
    spark = docs.sparkSession
    windows = checkpointed(
        items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_item_windows(window, k), _ITEM_SCHEMA).distinct()
    )
    n_rows, n_shingles, short = windows.agg(F.count("*"), F.count_distinct("shingle"), F.collect_set(F.when(F.size("win_words") < k, F.size("win_words")))).first()
    # the shared shingle filter: bits set by an aggregate, so at most 2**MOST_BITS / 64 rows come back
    n_bits = min(max((BITS_EACH * n_shingles - 1).bit_length(), LEAST_BITS), MOST_BITS)
    words64 = windows.select(F.expr(f"shingle & {(1 << n_bits) - 1}").alias("b")).groupBy(F.expr("shiftright(b, 6)").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, int(b & 63)))").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (n_bits - 6), np.uint64)
    bitmap[words64["slot"].to_numpy(np.int64)] = words64["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint8))

    # row_id tells repeated ids apart; it is only made once, before the checkpoint
    marked = checkpointed(
        docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)
        .mapInArrow(_marked_documents(shared, frozenset(short), window, k, list(carry)), _DOC_SCHEMA + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry))
    )
    shared.unpersist()
    hits = marked.where(F.size("at") > 0).select("row_id", F.explode(F.arrays_zip("at", "shingle", "region")).alias("m"), "region_start", "region_words").select(
        "row_id", "m.at", "m.shingle", F.get("region_start", "m.region").alias("start"), F.get("region_words", "m.region").alias("words")
    )
    # rarity: rows that have the shingle, over the whole corpus; a shingle that never occurs rules its window out
    rarity = hits.select("shingle").groupBy("shingle").agg(F.count("*").alias("n"))
    rarest = windows.join(rarity, "shingle", "left").groupBy("win_words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "shingle_at")).alias("rarest")).where("rarest.n > 0")
    # windows of the same items share a number (`owners`), so a document's windows meet each item once; sets are known by hashes, not collected
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), "item_id")).alias(f"h{i}") for i in (1, 2)]
    of_window = checkpointed(windows.select("win_words", "item_id").distinct().groupBy("win_words").agg(F.count("*").alias("n_items"), *hashes))
    prefix = checkpointed(rarest.join(of_window, "win_words").select("rarest.shingle", "rarest.shingle_at", "win_words", F.xxhash64("n_items", "h1", "h2").alias("owners")))
    heads = of_window.withColumn("owners", F.xxhash64("n_items", "h1", "h2")).groupBy("owners").agg(F.min("win_words").alias("win_words"))
    owned = checkpointed(windows.select("win_words", "item_id").distinct().join(heads, "win_words").select("owners", "item_id"))
    begin = F.col("at") - F.col("shingle_at")
    place = begin - F.col("start")
    verified = (
        hits.join(_small(prefix, n_rows), "shingle")
        .where((begin >= 0) & (place >= 0) & (place + F.size("win_words") <= F.size("words")))
        .where(F.slice("words", place + 1, F.size("win_words")) == F.col("win_words"))
        .select("row_id", begin.alias("begin"), (begin + F.size("win_words")).alias("end"), "owners")
    )
    verified = checkpointed(verified.groupBy("row_id", "begin", "owners").agg(F.max("end").alias("end")))
    # windows that start at one word: the longest covers the others; then union of intervals
    spans = verified.groupBy("row_id", "begin").agg(F.max("end").alias("end"))
    before = Window.partitionBy("row_id").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(before), F.lit(0)))))
    met = verified.select("row_id", "owners").distinct().join(_small(owned, n_rows), "owners").select("row_id", "item_id").distinct()
    found = covered.groupBy("row_id").agg(F.sum("new").cast("long").alias("n_hit")).join(met.groupBy("row_id").agg(F.array_sort(F.collect_list("item_id")).alias("items")), "row_id")
    return marked.select("row_id", "doc_id", "n_words", *carry).join(found, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *carry
    )


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A document is contaminated if it has a hit and at least a twentieth of its words is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
