"""Similarity self-join of texts' word-shingle sets by chosen paths.

Every distinct text is a set of five-word shingles, embedded by `SKETCH` minhashes. A run starts
with all sets in one node and splits nodes by sampled coordinates, so that two sets stay together
where they share the sampled token; each node samples 1.25 coordinates on average, the inverse
of the threshold. A node of at most `LIMIT` sets is compared by brute force on sketches; larger
ones are split again, `LEVELS` times at most, and what is then still large keeps together whole.
All runs sample the same minhashes, so a pair whose sketch happens to agree less is missed by all
of them together: there are as many runs as keep the expected share of missed pairs at the
threshold, over the sketches they can have, within 1 - `RECALL`. Pairs above it are missed less.

Sets that met form candidate groups. Each group is then compared exactly: its texts are dealt into
blocks of bounded size and every pair of blocks is one small job, so no group, however large, lands
in one task, and only counts and a spanning forest come out of it, never all pairs.

Equal texts are one node and are not compared. Null and empty texts, and texts without words, are
in a class with their equals and have no links. Texts of fewer than five words are one shingle.
Repeated rows and repeated or null ids are fine: rows are told apart by their own numbers. An
empty table gives no rows; other columns are ignored. A class's id is the least id in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.components import connected_components
from waymark.llm.shared import BROADCAST_ROWS, checkpointed, hashed_words, join_counted, raw_text, shingles, slices

K, THRESHOLD = 5, 0.8
SKETCH, LEVELS, LIMIT, RECALL = 64, 3, 64, 0.9999
#: Sketches that agree less are not compared exactly: 4.5 standard deviations under the threshold.
LEAST_AGREED = math.floor(SKETCH * THRESHOLD - 4.5 * math.sqrt(SKETCH * THRESHOLD * (1 - THRESHOLD)))


def missed(similarity: float, runs: int) -> float:
    """Expected share of pairs of a similarity that no run keeps together through all levels."""
    total = 0.0
    for agreed in range(SKETCH + 1):
        differ = 1 - agreed / SKETCH
        # a quarter of nodes draws two coordinates, which are seldom the same one
        two = 0.25 * (SKETCH - 1) / SKETCH
        share = (1 - two) * (1 - differ) + two * (1 - differ * (SKETCH - agreed - 1) / (SKETCH - 1))
        chance = math.comb(SKETCH, agreed) * similarity**agreed * (1 - similarity) ** (SKETCH - agreed)
        total += chance * ((1 - share**LEVELS) ** runs if agreed >= LEAST_AGREED else 1)
    return total


RUNS = next(r for r in range(1, 1000) if missed(THRESHOLD, r) <= 1 - RECALL)
#: Tokens (about 1 MB of text) and sets of a block in the exact comparison; a job compares two blocks.
BLOCK_TOKENS, BLOCK_SETS = 150_000, 2048

_SIGNED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("coords", pa.list_(pa.int32()))])
_SEEDS = np.random.default_rng(64).integers(1, 1 << 63, (SKETCH, 2), dtype=np.uint64) | np.uint64(1)


def token_sets(data: np.ndarray, offs: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    h, _, _, woffs = hashed_words(data, offs)
    sh, soffs = shingles(h, woffs, k)
    sets = [np.unique(sh[a:b]) for a, b in zip(soffs[:-1].tolist(), soffs[1:].tolist(), strict=True)]
    return np.concatenate(sets) if sets else sh, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = raw_text(batch.column(4))
        for lo, hi in slices(offs):
            tokens, toffs = token_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            sizes = np.diff(toffs)
            some = np.flatnonzero(sizes)
            coords = np.zeros((SKETCH, hi - lo), np.uint32)
            if len(some):
                for j, (a, b) in enumerate(_SEEDS):
                    coords[j, some] = np.minimum.reduceat(((tokens * a + b) >> np.uint64(32)).astype(np.uint32), toffs[some])
            flat = pa.array(np.ascontiguousarray(coords.T).view(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * SKETCH, SKETCH), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(4)), pa.array(sizes, pa.int32()), lists], schema=_SIGNED)


def _text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, doc_id, k1, k2, n, coords of every row; rid numbers the rows."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), *_text_keys(body), body.alias("text"))
    return checkpointed(rows.mapInArrow(_signed, "rid long, doc_id long, k1 long, k2 long, n int, coords array<int>"))


def _children(path: Column, coords: str) -> Column:
    """The paths of a node's children that a set belongs to: one sampled coordinate, or two."""
    first, second = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(SKETCH)).cast("int"), F.pmod(F.xxhash64(path, F.lit(2)), F.lit(SKETCH)).cast("int")
    child = lambda i: F.xxhash64(path, i, F.get(F.col(coords), i))
    twice = (F.pmod(F.xxhash64(path, F.lit(3)), F.lit(4)) == 0) & (first != second)
    return F.when(twice, F.array(child(first), child(second))).otherwise(F.array(child(first)))


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the sketches that agree, by bucket; rows come sorted by path."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SKETCH), np.uint8)]

    def edges(path: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        us, vs, step = [], [], 1
        at = np.arange(len(path))
        while len(at := at[at + step < len(path)]) and len(at := at[path[at] == path[at + step]]):
            for lo in range(0, len(at), 1 << 16):
                i = at[lo : lo + (1 << 16)]
                close = i[(sketch[i] == sketch[i + step]).sum(axis=1) >= LEAST_AGREED]
                us.append(close)
                vs.append(close + step)
            step += 1
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        out = []
        for u, v in zip(np.concatenate(us).tolist(), np.concatenate(vs).tolist(), strict=True) if us else ():
            if (a := root(u)) != (b := root(v)):
                parent[max(a, b)] = min(a, b)
                out.append((u, v))
        pick = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[pick[:, 0]]), pa.array(node[pick[:, 1]])], schema=schema)

    for batch in batches:
        path, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, SKETCH)
        path, node, sketch = (np.concatenate([a, b]) for a, b in zip(held, (path, node, sketch), strict=True))
        if len(path):
            whole = np.searchsorted(path == path[-1], True) if path[0] != path[-1] else 0
            yield edges(path[:whole], node[:whole], sketch[:whole])
            held = [path[whole:], node[whole:], sketch[whole:]]
    yield edges(*held)


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """nodes (node, coords, sketch): edges (u, v) that join all sets which met and look alike."""
    runs = F.array(*[F.xxhash64(F.lit("run"), F.lit(r)) for r in range(RUNS)])
    state = nodes.select("node", F.explode(F.flatten(F.transform(runs, lambda r: _children(r, "coords")))).alias("path"))
    found = None
    for level in range(1, LEVELS + 1):
        state = checkpointed(state)
        sizes = state.groupBy("path").agg(F.count("*").alias("size"), F.min("node").alias("head")).where("size > 1")
        sized = join_counted(state, sizes, "path", "size", state.count())
        leaves = sized.where(F.col("size") <= LIMIT).join(nodes.select("node", "sketch"), "node").select("path", "node", "sketch")
        met = leaves.repartition(F.col("path")).sortWithinPartitions("path").mapInArrow(_agreeing, "u long, v long")
        found = met if found is None else found.unionByName(met)
        large = sized.where(F.col("size") > LIMIT)
        if level == LEVELS:
            return found.unionByName(large.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))).distinct()
        state = large.join(nodes.select("node", "coords"), "node").select("node", F.explode(_children(F.col("path"), "coords")).alias("path"))
    return found


def _overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of token sets, by products of 0/1 matrices."""
    (ta, oa), (tb, ob) = a, b
    shared = np.intersect1d(ta, tb)
    total = np.zeros((len(oa) - 1, len(ob) - 1), np.float32)

    def places(t: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, t)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == t[hit]
        return np.repeat(np.arange(len(o) - 1), np.diff(o))[hit], at[hit]

    (ra, ca), (rb, cb) = places(ta, oa), places(tb, ob)
    for lo in range(0, len(shared), 4096):
        width = min(4096, len(shared) - lo)
        parts = []
        for r, c, n in ((ra, ca, len(oa) - 1), (rb, cb, len(ob) - 1)):
            x = np.zeros((n, width), np.float32)
            hit = (c >= lo) & (c < lo + width)
            x[r[hit], c[hit] - lo] = 1
            parts.append(x)
        total += parts[0] @ parts[1].T
    return total


def _linked(a, b, threshold: float) -> np.ndarray:
    """Which pairs of two lists of sets have a Jaccard similarity of at least the threshold."""
    inter = _overlaps(a, b).astype(np.float64)
    union = np.diff(a[1])[:, None] + np.diff(b[1])[None, :] - inter
    return (inter >= threshold * union - 1e-9) & (inter > 0)


def _take(sets: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, o = sets
    return np.concatenate([t[o[i] : o[i + 1]] for i in rows]) if len(rows) else t[:0], np.concatenate([[0], np.cumsum(np.diff(o)[rows])]).astype(np.int64)


def _least(near: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The least label among each row's links, in strips so that memory stays small."""
    none = np.iinfo(np.int64).max
    strips = [np.where(near[i : i + 256], labels[None, :], none).min(axis=1, initial=none) for i in range(0, len(near), 256)]
    return np.concatenate(strips)


def _compare(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """One job: whole small groups, or one pair of blocks of a large one."""
        data, offs = raw_text(pa.array(group["text"], pa.string()))
        parts, shift, sizes = [], 0, []
        for lo, hi in slices(offs):
            t, o = token_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            parts.append(t)
            sizes.append(np.diff(o))
        sets = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        node, comp, block, pair = (group[c].to_numpy(np.int64) for c in ("node", "comp", "block", "pair"))
        order = np.lexsort((node, block, comp))
        cuts = np.flatnonzero(np.concatenate([[True], comp[order][1:] != comp[order][:-1], [True]]))
        nodes, links, roots = [], [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = order[lo:hi]
            if pair[rows[0]] >= 0:  # two different blocks: only links across count
                left = rows[block[rows] == block[rows].min()]
                right = rows[block[rows] != block[rows].min()]
            else:
                left = right = rows
            near = np.zeros((len(left), len(right)), bool)
            for i in range(0, len(left), 1024):
                for j in range(0, len(right), 1024):
                    near[i : i + 1024, j : j + 1024] = _linked(_take(sets, left[i : i + 1024]), _take(sets, right[j : j + 1024]), threshold)
            if left is right:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            ll, lr = np.arange(len(left)), np.arange(len(right)) + (0 if left is right else len(left))
            while True:  # least labels over the links
                new = np.minimum(ll, _least(near, lr))
                newr = np.minimum(lr, _least(near.T, new))
                if left is right:
                    new = newr = np.minimum(new, newr)
                if (new == ll).all() and (newr == lr).all():
                    break
                ll, lr = new, newr
            members = left if left is right else np.concatenate([left, right])
            for rows_, count, label in ((left, near.sum(axis=1), ll), *([] if left is right else [(right, near.sum(axis=0), lr)])):
                some = count > 0
                nodes.append(node[rows_[some]])
                links.append(count[some])
                roots.append(node[members[label[some]]])
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return pd.DataFrame({"node": cat(nodes), "links": cat(links), "root": cat(roots)}, dtype="int64")

    return run


def _exact(docs: DataFrame, nodes: DataFrame, labels: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """(node, links, root): exact links within the candidate groups."""
    grouped = labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "comp")
    grouped = checkpointed(grouped.join(nodes.select("node", "rep_id", "k1", "k2", "n"), "node"))
    size = grouped.groupBy("comp").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets"))
    n_rows, tokens = grouped.agg(F.count("*"), F.sum("n")).first()
    packs = max(1, math.ceil((tokens or 0) / BLOCK_TOKENS), math.ceil(n_rows / BLOCK_SETS))
    blocks = F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")
    # groups of one block are packed together; a larger one gets a job for each pair of its blocks
    dealt = join_counted(grouped, size, "comp", "sets", n_rows).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    if n_rows <= BROADCAST_ROWS:
        dealt = F.broadcast(dealt)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("rep_id"), *_text_keys(body), body.alias("text"))
    carried = ["rep_id", "k1", "k2", "node", "comp", "blocks", "block"]
    texts = keyed.join(dealt, ["rep_id", "k1", "k2"]).groupBy(*carried).agg(F.first("text").alias("text"))
    others = F.when(F.col("blocks") == 1, F.array(F.col("block"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    jobs = texts.withColumn("other", F.explode(others)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    jobs = jobs.withColumn("pair", F.when(F.col("low") == F.col("high"), -1).otherwise(F.col("high")).cast("long"))
    jobs = jobs.withColumn("job", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.xxhash64("comp", "low", "high")))
    return jobs.select("job", "node", "comp", F.col("block").cast("long").alias("block"), "pair", "text").groupBy("job").applyInPandas(_compare(threshold), "node long, links long, root long")


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For every row: rid, doc_id, k1, k2, class_id, n_links, n_copies, first.

    class_id is the least id of the texts connected by links, n_links the number of other texts
    with a similarity of at least the threshold, n_copies that of rows with an equal text, and
    `first` marks one row of each class.
    """
    rows = signed(docs, doc_id, text)
    lowest = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    texts = checkpointed(rows.groupBy("k1", "k2").agg(F.min(F.struct(lowest.alias("rep_id"), F.col("rid").alias("node"))).alias("m"), F.count("*").alias("n_copies")).select("k1", "k2", "m.*", "n_copies"))
    sketch = F.unhex(F.array_join(F.transform("coords", lambda c: F.lpad(F.hex(c.bitwiseAND(F.lit(255))), 2, "0")), ""))
    nodes = checkpointed(texts.join(rows.select(F.col("rid").alias("node"), "n", "coords"), "node").where("n > 0").withColumn("sketch", sketch))
    labels = connected_components(candidate_edges(nodes))
    linked = checkpointed(_exact(docs, nodes, labels, doc_id, text, threshold))
    counts = linked.groupBy("node").agg(F.sum("links").alias("n_links"))
    joined = connected_components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = checkpointed(texts.join(counts, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # the least id of a class decides; ties go to the earliest row
    heads = placed.groupBy("root").agg(F.min(F.struct("rep_id", "node")).alias("head"), F.count("*").alias("size"))
    classes = placed.join(heads, "root").select("k1", "k2", F.col("head.rep_id").alias("class_id"), F.col("head.node").alias("head"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies")
    low = F.lit(-(1 << 63)).cast("long")
    return rows.select("rid", "doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select(
        "rid", "doc_id", "k1", "k2", F.nullif("class_id", low).alias("class_id"), "n_links", "n_copies", (F.col("rid") == F.col("head")).alias("first")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of every class, the one of the least id; all columns stay."""
    found = similar_texts(docs, doc_id, text, threshold)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.lit(-(1 << 63)).cast("long")
    key = lambda c: F.coalesce(c.cast("long"), low).alias("__id")
    keep = checkpointed(found.where("first").select(key(F.col("doc_id")), F.col("k1").alias("__k1"), F.col("k2").alias("__k2")))
    k1, k2 = _text_keys(body)
    keyed = docs.withColumns({"__id": key(F.col(doc_id)), "__k1": k1, "__k2": k2})
    kept = keyed.join(keep, ["__id", "__k1", "__k2"], "left_semi")
    # only rows that repeat both id and text can come more than once
    return kept.dropDuplicates(["__id", "__k1", "__k2"]).select(*docs.columns)
