"""Token counts of a byte-level BPE vocabulary with word ends, by rank-synchronous merging.

White space separates pre-tokens and is dropped, so a text's count is the sum over its words.
New words of a batch are normalised (NFC, lower case), cut into pre-tokens and laid out as
one ragged numpy array of byte symbols. In each round every sequence's lowest-rank pair is
merged at all its places at once; sequences without a pair are finished, and the symbols that
survive are counted. A round costs as much as its sequences are long, so pre-tokens of more than
`LONG` bytes (a page without blanks) are merged in the same order from a heap of ranks and
places instead, which takes n log n steps. Counts of words stay in the worker for later batches.

Special strings inside a text count as one token each, which is the tokenizers library's
default. Null and empty texts count 0. Long texts are counted whole; repeated rows and ids give
one row each; an empty table gives none; other columns are dropped.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import raw_text, slices

VOCABULARY = "word_bpe_49k.json"
#: Words kept by a worker before it starts anew; this bounds memory, not results.
CACHE_WORDS = 300_000
#: Pre-tokens of more bytes than this are merged from a heap.
LONG = 1024
# White space as the tokenizers library's expressions see it (fixed values)
_SPACE = "\t-\r \x85\xa0  -     　"
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # split() takes these for white space, the library doesn't
_SPLIT = re.compile(f"[{_SPACE}]+")
_NONE = np.iinfo(np.int64).max

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def byte_symbols() -> list[str]:
    """Byte-level BPE's printable symbol of each byte: itself if visible Latin-1, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Counter:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        self.inner = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.last = np.array([vocab[s + end] for s in byte_symbols()], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.rank_of: dict[tuple[int, int], tuple[int, int]] | None = None
        self.byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.path, self.library = path, None

    def newer(self, part: str) -> list[bytes]:
        """Pre-tokens of a word with characters newer than Python's tables, as the library cuts them."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(self.byte_of[c] for c in t) for t, _ in cut]

    def by_heap(self, token: bytes) -> int:
        """The number of symbols of one long pre-token: pairs are merged by rank, from the left on ties.

        A merged symbol's own pairs have higher ranks than the pair it came from, so this is the
        order of the synchronous rounds.
        """
        if self.rank_of is None:
            self.rank_of = {divmod(k, self.width): (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist(), strict=True)}
        rank_of, n = self.rank_of, len(token)
        ids = self.inner[np.frombuffer(token, np.uint8)].tolist()
        ids[-1] = int(self.last[token[-1]])
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(found[0], i, pair) for i, pair in enumerate(itertools.pairwise(ids)) if (found := rank_of.get(pair))]
        heapq.heapify(waiting)
        left = n
        while waiting:
            _, i, pair = heapq.heappop(waiting)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], left = rank_of[pair][1], -1, left - 1
            after[i] = to = after[j]
            if to < n:
                prior[to] = i
            for a, b in ((prior[i], i), (i, to)):
                if a >= 0 and b < n and (found := rank_of.get((ids[a], ids[b]))):
                    heapq.heappush(waiting, (found[0], a, (ids[a], ids[b])))
        return left

    def survivors(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols each pre-token ends with."""
        long = [i for i, t in enumerate(tokens) if len(t) > LONG]
        if long:
            out = np.zeros(len(tokens), np.int64)
            out[long] = [self.by_heap(tokens[i]) for i in long]
            short = [i for i, t in enumerate(tokens) if len(t) <= LONG]
            if short:
                out[short] = self.survivors([tokens[i] for i in short])
            return out
        sizes = np.array([len(t) for t in tokens], np.int64)
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        ids = self.inner[flat]
        ids[np.cumsum(sizes) - 1] = self.last[flat[np.cumsum(sizes) - 1]]
        seq, out = np.repeat(np.arange(len(tokens)), sizes), np.zeros(len(tokens), np.int64)
        while len(seq):
            key = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(ids), _NONE)
            rank[:-1] = np.where((self.keys[at] == key) & (seq[1:] == seq[:-1]), self.ranks[at], _NONE)
            heads = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            counts = np.diff(np.append(heads, len(seq)))
            lowest = np.minimum.reduceat(rank, heads)
            done = lowest == _NONE
            out[seq[heads[done]]] = counts[done]
            least = np.repeat(lowest, counts)
            hit = np.flatnonzero((rank == least) & (least < _NONE))
            # in a run of overlapping places (aaa) every second one is merged, from the left
            run = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1])) if len(hit) else hit
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]
            ids[hit] = self.merged[at[hit]]
            stay = ~np.repeat(done, counts)
            stay[hit + 1] = False
            ids, seq = ids[stay], seq[stay]
        return out

    def pre_tokens(self, word: str) -> tuple[int, list[bytes]]:
        """Special strings in a word, and the pre-tokens of what lies between."""
        specials = len(self.special.findall(word))
        out: list[bytes] = []
        for part in self.special.split(word) if specials else [word]:
            if not part.isascii() and any(unicodedata.category(c) == "Cn" for c in part):
                out.extend(self.newer(part))
                continue
            # lower() knows a final sigma; the library lowers each character by itself
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out.extend(t.encode() for t in self.pattern.findall(part))
        return specials, out

    def learn(self, words: list[str]) -> None:
        tokens: dict[bytes, int] = {}
        uses = []
        for word in words:
            specials, own = self.pre_tokens(word)
            uses.append((specials, [tokens.setdefault(t, len(tokens)) for t in own]))
        counts = self.survivors(list(tokens)) if tokens else np.zeros(0, np.int64)
        counts = counts.tolist()
        for word, (specials, own) in zip(words, uses, strict=True):
            self.known[word] = specials + sum(counts[i] for i in own)

    def run(self, texts: list[str]) -> list[int]:
        words = [_SPLIT.split(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if new := set().union(*words) - self.known.keys():
            self.learn(list(new))
        return [sum(map(self.known.__getitem__, w)) for w in words]


_COUNTERS: dict[str, Counter] = {}


def _counting(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            _, offs = raw_text(batch.column(1))
            counts: list[int] = []
            for lo, hi in slices(offs):
                counts += counter.run([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(offs), pa.int64()), pa.array(counts, pa.int64())], schema=_SCHEMA)

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_counting(vocabulary_path), "doc_id long, n_bytes long, n_tokens long")
