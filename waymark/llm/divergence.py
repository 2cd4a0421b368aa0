"""Source divergence audit: how the sources of a language differ in their terms.

Terms are the matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased, of whole texts; null texts, languages
and sources are ''. A language keeps the V terms that at least `LEAST_DOCS` of its documents hold.
A group is an occurring (lang, source), also without terms. Over its kept terms, a group gives each
`p = 1 + floor(1e9 * (count + 2) / (N + 2 * V))`, N being the sum of its counts; so does the language as a whole.
Two groups differ in a term by `f = floor((p - q)**2 / (p + q))`.

`term_counts` counts texts in tasks and sums by (lang, source, term), so no task holds a group or a
term's rows. For `pairs` the matrix of a language, groups by kept terms, is dealt out in blocks of about
`BLOCK_TERMS` hashed terms and, beyond `TILE` groups, in pairs of row tiles. In each block a K-squared quadtree (K = 2)
over which counts are not zero is traversed jointly for pairs of groups, from the root: a pair of quadrants that
are both without counts is priced at once, as its number of terms times the price of two zeros; others are split,
down to single cells, where f is taken. Terms of a block are ordered by who has them, so that zeros lie together.
Blocks' sums are added up by pair. All arithmetic is in 64-bit integers, quotients by long division.

Repeated rows count each; null columns are '', and ids play no part. An empty table gives an empty result; where
V is 0 pairs have the value 0. Very long texts are counted whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.shared import BROADCAST_ROWS, LETTER_BYTES, checkpointed, raw_text, slices, word_strings

LEAST_DOCS, BEST = 10, 10
UNIT = 1_000_000_000
#: Terms of a block, about; groups of a row tile; cells of pairs that are traversed at once.
BLOCK_TERMS, TILE, AT_ONCE = 4096, 128, 1 << 20


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, count, n_docs: occurrences and documents of each term in a group."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.col(text).cast("string").alias("text")).where("text is not null")
    counted = rows.mapInArrow(_count, "lang string, source string, term string, count long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("n_docs").alias("n_docs"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = raw_text(batch.column(2))
        names = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        heads, group = _number(names)
        for lo, hi in slices(offs):
            words, woffs = word_strings(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], LETTER_BYTES)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            size = len(coded.dictionary)
            doc = np.repeat(np.arange(hi - lo), np.diff(woffs))
            held, times = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
            key, first = np.unique(group[lo + held // size] * size + held % size, return_inverse=True)
            of = pa.array(heads[key // size])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), coded.dictionary.take(pa.array(key % size)), pa.array(np.bincount(first, times, len(key)).astype(np.int64)), pa.array(np.bincount(first, minlength=len(key)))],
                names=["lang", "source", "term", "count", "n_docs"],
            )


def _number(names: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct pair of names, and the pair's number of every row."""
    a, b = (names.field(i).dictionary_encode() for i in (0, 1))
    both = a.indices.to_numpy().astype(np.int64) * max(len(b.dictionary), 1) + b.indices.to_numpy()
    _, heads, group = np.unique(both, return_index=True, return_inverse=True)
    return heads, group


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)) by long division in three steps of 1000, each within 64 bits."""
    of = total + 2 * kept
    rest, out = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        rest, out = rest % of, out * 1000 + F.call_function("div", rest, of)
    return 1 + out


def _price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _beside(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Cells with their group's row: one group may hold a third of the cells, so groups are broadcast up to BROADCAST_ROWS; more of them are shuffled, where Spark splits what is skewed."""
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return cells.join(F.broadcast(groups) if few else groups, ["lang", "source"])


class Audit:
    """The tables of an audit: groups (lang, source, n, v, zero), and cells (lang, source, term, count, p) of kept terms."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS):
        counts = checkpointed(term_counts(docs, text, lang, source))
        self.terms = checkpointed(counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("n_docs").alias("held")).where(F.col("held") >= least_docs).select("lang", "term", "total"))
        kept = counts.join(self.terms, ["lang", "term"])
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        named = docs.select(blank(lang).alias("lang"), blank(source).alias("source")).distinct()
        langs = self.terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
        sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        groups = named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
        zero = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(0)
        self.groups = checkpointed(groups.withColumn("zero", zero))
        cells = _beside(kept, self.groups)
        self.cells = cells.select("lang", "source", "term", "count", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"), "v")

    def leading_terms(self, best: int = BEST) -> DataFrame:
        """lang, source, item, value, rank: the terms that a group has more of than its language, by what they cost."""
        over = self.cells.where("p > q").select("lang", "source", F.col("term").alias("item"), _price(F.col("p"), F.col("q")).alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)

    def pairs(self) -> DataFrame:
        """lang, source, item, value, rank: every other source of the language, by its distance."""
        numbered = self.groups.withColumn("row", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        numbered = checkpointed(numbered.withColumns({"blocks": F.expr(f"(v + {BLOCK_TERMS - 1}) div {BLOCK_TERMS}"), "tiles": F.expr(f"(max(row) over (partition by lang)) div {TILE} + 1")}))
        place = ["lang", "source", "row", "blocks", "tiles"]
        cells = _beside(self.cells, numbered.select(*place)).select("lang", "row", "tiles", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "p")
        zeros = numbered.where("blocks > 0").select("lang", "row", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"))
        own = F.expr(f"row div {TILE}")
        dealt = cells.unionByName(zeros).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)))
        dealt = dealt.select("lang", "block", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), F.col("row").cast("int").alias("row"), "term", "p")
        summed = dealt.groupBy("lang", "block", "low", "high").applyInPandas(_block, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = summed.unionByName(summed.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        left = numbered.select("lang", "source", F.col("row").alias("a"))
        right = numbered.select("lang", F.col("source").alias("item"), F.col("row").alias("b"))
        grid = left.join(right, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return grid.select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")).withColumn("rank", F.row_number().over(order))

    def report(self) -> DataFrame:
        """Both parts: lang, source, part, item, value, rank."""
        columns = ["lang", "source", "part", "item", "value", "rank"]
        return self.pairs().withColumn("part", F.lit("pair")).select(columns).unionByName(self.leading_terms().withColumn("part", F.lit("term")).select(columns))


def _block(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    lang, _, low, high = keys
    zeros = rows[rows["term"].isna()].sort_values("row")
    cells = rows[rows["term"].notna()]
    number = zeros["row"].to_numpy()
    row = np.searchsorted(number, cells["row"].to_numpy())
    _, term = np.unique(cells["term"].to_numpy(dtype=object), return_inverse=True) if len(cells) else (None, np.zeros(0, np.int64))
    a, b, value = priced(row, term, cells["p"].to_numpy(np.int64), zeros["p"].to_numpy(np.int64))
    if low != high:  # pairs within a tile come from the tile's own block
        apart = number[a] // TILE != number[b] // TILE
        a, b, value = a[apart], b[apart], value[apart]
    return pd.DataFrame({"lang": lang, "a": number[a], "b": number[b], "value": value})


def priced(row: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum of f over all terms) of every pair a < b of rows; cells that aren't given have their row's zero.

    The levels of the quadtree say which quadrants hold a cell, leaves first. The traversal keeps a
    list of (upper quadrant row, lower quadrant row, quadrant column) for each level.
    """
    n_rows, n_terms = len(zero), int(term.max(initial=-1)) + 1
    a, b = np.triu_indices(n_rows, 1)
    if not n_terms or not len(a):
        return a, b, np.zeros(len(a), np.int64)
    held = np.zeros((n_rows, n_terms), bool)
    held[row, term] = True
    order = np.lexsort(held[::-1])  # terms of the same rows lie together
    held = held[:, order]
    share = np.broadcast_to(zero[:, None], held.shape).copy()
    place = np.empty(n_terms, np.int64)
    place[order] = np.arange(n_terms)
    share[row, place[term]] = p
    levels = [held]
    while max(levels[-1].shape) > 1:
        x = levels[-1]
        x = np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2)))
        levels.append(x[::2, ::2] | x[1::2, ::2] | x[::2, 1::2] | x[1::2, 1::2])
    total = np.zeros((n_rows, n_rows), np.int64)
    both_zero = np.zeros((n_rows, n_rows), np.int64)
    top, strip = len(levels) - 1, (2 * AT_ONCE // n_rows**2).bit_length()
    frontier = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), top)]
    while frontier:
        u, v, j, level = frontier.pop()
        full = levels[level]
        some = full[u, j] | full[v, j]
        width = np.minimum((j + 1) << level, n_terms) - (j << level)
        if (~some).any():  # uniform quadrants: their number of terms for all pairs of their rows
            counts = np.zeros((full.shape[0], full.shape[0]), np.int64)
            np.add.at(counts, (u[~some], v[~some]), width[~some])
            spread = np.minimum(np.arange(n_rows) >> level, full.shape[0] - 1)
            both_zero += counts[np.ix_(spread, spread)]
        u, v, j = u[some], v[some], j[some]
        if level == 0:
            x, y = share[u, j], share[v, j]
            np.add.at(total, (u, v), (x - y) * (x - y) // (x + y))
            continue
        rows_below, terms_below = levels[level - 1].shape
        du, dv, dj = (np.array(d).ravel()[None, :] for d in np.meshgrid([0, 1], [0, 1], [0, 1], indexing="ij"))
        u, v, j = ((2 * x[:, None] + d).ravel() for x, d in ((u, du), (v, dv), (j, dj)))
        keep = (u <= v) & (v < rows_below) & (u < rows_below) & (j < terms_below)
        if level == 1:
            keep &= u < v
        u, v, j = u[keep], v[keep], j[keep]
        if level > strip:
            for part in np.unique(j):  # wide levels go one quadrant column at a time
                frontier.append((u[j == part], v[j == part], j[j == part], level - 1))
        elif len(u):
            frontier.append((u, v, j, level - 1))
    total += both_zero * ((zero[:, None] - zero[None, :]) ** 2 // (zero[:, None] + zero[None, :]))
    return a, b, total[a, b]


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank of the whole audit."""
    return Audit(docs, text, lang, source).report()
