"""What several operators share: checkpoints, Arrow text access, hashed words and shingles."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes, so that memory does not follow the batch.
SLICE_BYTES = 1 << 19
#: A key with more than one in so many rows is broadcast instead of shuffled; there are fewer than so many of them.
HOT_KEYS = 2000
#: Tables of numbers of at most so many rows (some 8 MB) are broadcast whole; beyond it they are shuffled.
BROADCAST_ROWS = 150_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the cluster's shared checkpoint folder.

    The folder is the session's spark.checkpoint.dir; only where that is unset and Spark runs in
    this one process (tests, notebooks) a folder of its own is made.
    """
    return ensure_checkpoint_dir(df.sparkSession) and df.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if (given := sc.getConf().get("spark.checkpoint.dir", "")) != "":
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given
    if sc.getCheckpointDir() is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
    return sc.getCheckpointDir()


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of `rows` (n_rows of them, checkpointed) with `keyed`: one row a key, `size` rows have it.

    Fewer than HOT_KEYS keys can each hold more than that share of the rows; those are broadcast, so
    no key sends more than that share to one task of the shuffle. `keyed` has at most n_rows rows, so it is
    broadcast whole up to BROADCAST_ROWS.
    """
    if n_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), key)
    hot = F.col(size) > max(n_rows / HOT_KEYS, 1)
    often = F.broadcast(keyed.where(hot))
    seldom = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(often, key).unionByName(seldom)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective, so distinct values stay distinct."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets, without a copy per row; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one longer text."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of A-Z lower-cased texts.

    Returns (64-bit hash, start byte, end byte) of each word and the word offsets of each
    text. Every byte of a non-ASCII character belongs to a word, so bytes suffice.
    """
    n = len(offs) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(n + 1, np.int64)
    low = _LOWER[data]
    inside = _IN_WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(n + 1, np.int64)
    # sum of byte * base**(place in the word): places restart at each word
    place = np.arange(len(low), dtype=np.int64)
    lengths = ends - starts
    place = place[inside] - np.repeat(starts, lengths)
    powers = _powers(int(lengths.max()))
    values = (low[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = mix(np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)[:-1]])))
    return hashes, starts, ends, np.searchsorted(starts, offs)


_POWERS = np.ones(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        factors = np.full(2 * n, _BASE, np.uint64)
        factors[0] = 1
        _POWERS = np.cumprod(factors)
    return _POWERS


def shingles(hashes: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their offsets by text.

    A text of fewer words, but not none, is one shingle. Shingle i of a text starts at its word i.
    """
    counts = np.diff(woffs)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    soffs = np.concatenate([[0], np.cumsum(n)])
    if not soffs[-1]:
        return np.zeros(0, np.uint64), soffs
    begin = np.arange(soffs[-1]) - np.repeat(soffs[:-1] - woffs[:-1], n)
    end = np.repeat(woffs[1:], n)
    out = np.zeros(len(begin), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        at = begin + j
        out = mix(out * np.uint64(_BASE) + np.where(at < end, padded[at], np.uint64(0)) + np.uint64(j))
    return out, soffs


def word_strings(data: np.ndarray, offs: np.ndarray, members: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of A-Z lower-cased texts as strings, and their offsets by text; `members` marks the bytes of words."""
    low = _LOWER[data]
    inside = members[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(inside)])
    ends = np.append(before[starts], before[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])])
    return words, np.searchsorted(starts, offs)


#: Bytes of words of letters and digits, and of words of letters alone.
WORD_BYTES = _IN_WORD
LETTER_BYTES = _IN_WORD.copy()
LETTER_BYTES[48:58] = False
