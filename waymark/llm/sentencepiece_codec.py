"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A score-ordered agenda holds the adjacent symbol pairs whose union is a piece; the pair of the
highest score, leftmost on ties, is merged until none is left; symbols that are no piece fall
back to byte pieces. No piece of such a vocabulary has a word mark after another character, and
none mixes letters with signs or digits, so no merge crosses those places: texts are cut
there (the model is checked for it) and every distinct chunk goes through the agenda once for
each worker. In each Arrow batch the new chunks are checked against the sentencepiece library,
and so is the decoding of every text; where the two differ, the job fails, since the vocabulary
is then none that this method encodes.

Null and empty texts give just the begin and end ids and decode to an empty text. Very long
texts and chunks are handled whole (an agenda takes n log n steps). Repeated rows and ids give
one row each; an empty table gives no rows; other columns are dropped, so they can't clash.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import raw_text, slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: A worker keeps at most so many chunks' ids; then it starts anew. This bounds memory, not results.
CACHE_CHUNKS = 300_000
#: Chunks of at most so many characters use a list as their agenda, longer ones a heap.
SHORT = 48
_SIGN = r"\x0B-\x40\x5B-\x60\x7B-\xA9\xAB-\xB4\xB6-\xB9\xBB-\xBF\u2000-\u206F"
_CUT = re.compile(rf"{MARK}*[^\x00-\x0A{_SIGN}{MARK}]+|{MARK}*[\x00-\x09{_SIGN}]+|{MARK}+|\n+")
_NO = float("inf")
_BEFORE = "a\n"  # checked chunks stand behind this, where nothing merges with them

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids_le", pa.binary()), ("decoded", pa.string())])


class Codec:
    """The vocabulary of one model file, read through the library's own accessors."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(sp.vocab_size())]
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.rank = {p: (-sp.get_score(i), i) for i, p in enumerate(pieces) if not special[i]}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(len(_CUT.findall(p)) != 1 for p in self.rank):
            raise ValueError("pieces cross word marks, lines or signs; this vocabulary can't be cut there")
        self.cost = {p: c for p, (c, _) in self.rank.items()}
        surface = {i: p.replace(MARK, " ").encode() for p, (_, i) in self.rank.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.surface = [surface.get(i, b"") for i in range(sp.vocab_size())]
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        self.before = sp.encode(_BEFORE)
        self.known: dict[str, bytes] = {}

    def agenda(self, chunk: str) -> list[int]:
        """The ids of a chunk."""
        symbols = self._by_list(chunk) if len(chunk) <= SHORT else self._by_heap(chunk)
        out = []
        for s in symbols:
            if s in self.rank:
                out.append(self.rank[s][1])
            else:
                out.extend(self.bytes[b] for b in s.encode())
        return out

    def _by_list(self, chunk: str) -> list[str]:
        """The agenda as a list beside the symbols: the first of the least costs is the next merge."""
        symbols, cost = list(chunk), self.cost.get
        waiting = [cost(a + b, _NO) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        while waiting:
            if (least := min(waiting)) == _NO:
                break
            i = waiting.index(least)
            symbols[i] += symbols.pop(i + 1)
            del waiting[i]
            if i < len(waiting):
                waiting[i] = cost(symbols[i] + symbols[i + 1], _NO)
            if i:
                waiting[i - 1] = cost(symbols[i - 1] + symbols[i], _NO)
        return symbols

    def _by_heap(self, chunk: str) -> list[str]:
        cost, symbols = self.cost, list(chunk)
        n = len(symbols)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(cost[both], i, both) for i in range(n - 1) if (both := symbols[i] + symbols[i + 1]) in cost]
        heapq.heapify(waiting)
        while waiting:
            _, left, both = heapq.heappop(waiting)
            if symbols[left] is None or (right := after[left]) >= n or symbols[left] + symbols[right] != both:
                continue  # one of the two was merged meanwhile
            symbols[left], symbols[right] = both, None
            after[left] = to = after[right]
            if to < n:
                prior[to] = left
            for a, b in ((prior[left], left), (left, to)):
                if a >= 0 and b < n and (grown := symbols[a] + symbols[b]) in cost:
                    heapq.heappush(waiting, (cost[grown], a, grown))
        return [s for s in symbols if s is not None]

    def learn(self, chunks: set[str]) -> None:
        """Adds chunks to `known`, each checked against the library."""
        todo = list(chunks)
        theirs = self.library.encode([_BEFORE + c.replace(MARK, " ") for c in todo], num_threads=1)
        for chunk, ids in zip(todo, theirs, strict=True):
            own = self.agenda(chunk)
            if own != ids[len(self.before) :]:
                raise ValueError(f"the library encodes {chunk[:80]!r} as {ids[len(self.before) :][:80]}, not as {own[:80]}")
            self.known[chunk] = array("I", own).tobytes()

    def run(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        cuts = [_CUT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        self.learn(set().union(*cuts) - self.known.keys())
        packed = [b"".join([self.begin, *map(self.known.__getitem__, c), self.end]) for c in cuts]
        ids = [np.frombuffer(p, "<u4").tolist() for p in packed]
        decoded = [b"".join(map(self.surface.__getitem__, i))[1:].decode("utf-8", "replace") for i in ids]
        for k, theirs in enumerate(self.library.decode(ids, num_threads=1)):
            if theirs != decoded[k]:
                raise ValueError(f"the library decodes {ids[k][:80]} differently")
        return packed, decoded


_CODECS: dict[str, Codec] = {}


def _coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CODECS:
            _CODECS[path] = Codec(path)
        codec = _CODECS[path]
        for batch in batches:
            _, offs = raw_text(batch.column(1))
            for lo, hi in slices(offs, 1 << 20):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                packed, decoded = codec.run(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], schema=_SCHEMA)

    return run


def encode_decode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids_le (begin, ids, end as little-endian 32-bit integers) and decoded.

    numpy.frombuffer(ids_le, "<u4") gives the ids.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _coder(model_path), "doc_id long, ids_le binary, decoded string"
    )
