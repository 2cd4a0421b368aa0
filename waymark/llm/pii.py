"""Personal data in texts: patterns first, then a character-level tagger that adds spans.

The base spans are the leftmost non-overlapping matches of each kind's pattern that pass its
check. The tagger is trained on windows of a bounded sample of rows (`SAMPLE_ROWS`, at most
`TRAIN_WINDOWS` windows of either sort; texts with spans are taken in several versions, so that few suffice), whose labels are the patterns' matches before the check
and those of well-known forms of keys and passwords (kind `secret`, which has no base spans). Half of the
labelled spans are respelled as people write them to be read but not matched: bracketed at and
dot signs, blanks around the @, defanged addresses, phone numbers without the plus, cards with other
separators; so the tagger finds forms that no pattern has. Texts are cut into overlapping windows.
Every kind needs an @, a digit, a bracketed "at" or a long run of capitals, so windows without any hold
no span and are not scored; that is a rule for all texts, not a cap. Scores of overlapping
windows are averaged with weights that fall towards a window's edge, and each stretch of windows is
then decoded as a whole, so a span is never judged by a cut. An added span must be confident,
plausible and clear of base spans.

Null and empty texts have no spans. Long texts are handled whole and in linear time. Repeated
rows and ids give one row each; an empty table gives none. Without any labelled span the base
spans are the result. `find` drops other columns and `redact` keeps them all, so none can clash.
Places are code points, the end exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.pii_tagger import BASE_KINDS, KINDS, STRIDE, TAGS, WINDOW, Tagger, classes
from waymark.llm.shared import checkpointed

#: Bounds of the training sample: rows that are looked at, and windows of either sort (with spans, as many of each kind, and without).
SAMPLE_ROWS, TRAIN_WINDOWS = 20_000, 1500
#: Versions of each text with spans: respelled anew, and shifted against the windows.
VERSIONS = 8
#: Passes over the windows, and steps of 64 windows at least.
EPOCHS, LEAST_STEPS = 14, 500
#: Least mean and least single probability of an added span's tags.
SURE, LEAST = 0.95, 0.5
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
# possessive and guarded at a run's start, which keeps them linear; the matches are the same
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|[A-Z]{16}|[(\[]at[)\]]")
#: Well-known forms of secrets, which label the sample (fixed values): key ids, tokens of code hosts, and assigned values.
_SECRETS = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bsk-[A-Za-z0-9]{20,}\b|(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s?[=:]\s?[\"']?([^\s\"',;]{8,})", re.I)
_AT = r"\s?(?:@|\(at\)|\[at\])\s?"
_DOT = r"\s?(?:\.|\(dot\)|\[dot\])\s?"
_SPELLED_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards: forward over the domain, back over the local part to the last match's end."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at - len(_LOCAL_BACK.match(text[floor:at][::-1])[0])
            if start < at:
                out.append((start, domain.end()))
                floor = domain.end()
        if not domain or start == at:
            # no address here; the next one's local part can't reach over this @
            floor = max(floor, at + 1)
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str, checked: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start. Unchecked: shapes only, whatever the digits' values."""
    if not _HINT.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if not checked or all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and (luhn(d) or not checked):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """Matches of the well-known forms, as labels: (kind, start, end)."""
    at = len(BASE_KINDS)
    return [(at, *m.span(1 if m[1] else 0)) for m in _SECRETS.finditer(text)] if _HINT.search(text) else []


def plausible(kind: int, s: str) -> bool:
    """What an added span must have, whatever the tagger says."""
    d = _digits(s)
    if kind == 0:
        return bool(_SPELLED_EMAIL.fullmatch(s))
    if kind == 1:
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(d) <= 19 and luhn(d) and s[0].isdigit() and s[-1].isdigit()
    if kind == 3:
        return 8 <= len(d) <= 15 and len(re.findall(r"[^0-9]+", s)) >= 2 and not re.search("[A-Za-z]", s)
    return not re.search(r"\s", s) and (len(s) >= 8 and bool(d) and re.search("[A-Za-z]", s) is not None or re.fullmatch("[0-9A-Z]{16,}", s) is not None)


def _windows(points: np.ndarray) -> np.ndarray:
    """Starts of the windows that have an @, a digit, a bracketed "at" or 16 capitals or digits in a row."""
    starts = np.arange(0, max(len(points) - STRIDE, 1), STRIDE)
    ends = np.minimum(starts + WINDOW, len(points))
    digit = (points >= 48) & (points < 58)
    hint = digit | (points == 64)
    if len(points) >= 3:
        hint[2:] |= ((points[2:] == 41) | (points[2:] == 93)) & (points[1:-1] == 116) & (points[:-2] == 97)
    if len(points) >= 16:
        long = np.concatenate([[0], np.cumsum(digit | ((points >= 65) & (points < 91)))])
        hint[15:] |= long[16:] - long[:-16] == 16
    count = np.concatenate([[0], np.cumsum(hint)])
    return starts[count[ends] > count[starts]]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _cut(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([x, np.zeros(WINDOW, x.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW)]


_WEIGHT = (np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)) / (WINDOW / 2)).astype(np.float32)


class Finder:
    """Spans of texts, with the tagger's additions if there is one."""

    def __init__(self, tagger: Tagger | None):
        self.tagger = tagger

    def added(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        out: list[list] = [[] for _ in texts]
        cut, owner, starts, sizes = [], [], [], {}
        for k, text in enumerate(texts):
            if _HINT.search(text) and len(own := _windows(points := _points(text))):
                cut.append(_cut(classes(points), own))
                owner += [k] * len(own)
                starts += own.tolist()
                sizes[k] = len(points)
        if not cut or self.tagger is None:
            return out
        x = np.concatenate(cut)
        scores = np.concatenate([self.tagger.emissions(x[i : i + 1024]) for i in range(0, len(x), 1024)], axis=1)
        regions, where, lo = [], [], 0
        for hi in range(1, len(starts) + 1):
            if hi == len(starts) or owner[hi] != owner[lo] or starts[hi] > starts[hi - 1] + WINDOW:
                first, end = starts[lo], min(starts[hi - 1] + WINDOW, sizes[owner[lo]])
                total, weight = np.zeros((starts[hi - 1] + WINDOW - first, TAGS), np.float32), np.zeros(starts[hi - 1] + WINDOW - first, np.float32)
                for w in range(lo, hi):
                    at = slice(starts[w] - first, starts[w] - first + WINDOW)
                    total[at] += scores[:, w] * _WEIGHT[:, None]
                    weight[at] += _WEIGHT
                regions.append((total / np.maximum(weight, 1e-6)[:, None])[: end - first])
                where.append((owner[lo], first))
                lo = hi
        for tags, e, (k, first) in zip(self.tagger.decode(regions), regions, where, strict=True):
            if not tags.any():
                continue
            prob = self.tagger.marginals(e)[np.arange(len(tags)), tags]
            for kind, a, b in _runs(tags):
                s, t = a + first, b + first
                if prob[a:b].mean() >= SURE and prob[a:b].min() >= LEAST and plausible(kind, texts[k][s:t]) and all(t <= y or s >= z for _, y, z in base[k]):
                    out[k].append((kind, s, t))
        return out

    def find(self, texts: list[str]) -> tuple[list, list]:
        base = [base_spans(t) for t in texts]
        return base, self.added(texts, base)


def _runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of a tag sequence: a begin tag, or an inside tag of another kind, opens one."""
    out, kind, start = [], -1, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        own = (t - 1) // 2 if t else -1
        if own != kind or (t and t % 2):
            if kind >= 0:
                out.append((kind, start, i))
            kind, start = own, i
    return out


def _respell(kind: int, s: str, rng: np.random.Generator) -> str:
    """A form of a span that no pattern matches, or the span itself."""
    if kind == 0:
        local, _, domain = s.partition("@")
        dot = rng.choice([".", ".", "[dot]", "(dot)", " . "])
        return local + rng.choice([" @", "@ ", " @ ", "[at]", "(at)", " (at) "]) + domain.replace(".", dot)
    if kind == 1:
        return s.replace(".", rng.choice(["[.]", "(.)", " . ", "-"]))
    if kind == 2:
        mark = rng.choice([".", "/", "_", " - "])
        return re.sub(r"[\x20-]", mark, s) if re.search(r"[\x20-]", s) else mark.join(s[i : i + 4] for i in range(0, len(s), 4))
    if kind == 3:
        plain = s[1:].lstrip()
        return rng.choice([plain, "00" + plain, plain.replace("-", ".").replace(" ", "."), plain.replace("-", "/")])
    return s


def respelled(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator, share: float) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The text with a share of its spans respelled, all spans of the new text, and those that have changed."""
    out, done, size, kept, changed = [], 0, 0, [], []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < done:
            continue
        new = _respell(kind, text[a:b], rng) if rng.random() < share else text[a:b]
        start = size + a - done
        out += [text[done:a], new]
        size, done = start + len(new), b
        kept.append((kind, start, size))
        if new != text[a:b]:
            changed.append(kept[-1])
    return "".join([*out, text[done:]]), kept, changed


def _labelled(seed: int):
    """Training windows (raw code points and tags) of a batch's texts, with the kind of each window's first span (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, kinds = [], [], []
            for text in batch.column(0).to_pylist():
                # shapes only: a sum of digits is nothing to learn
                spans = base_spans(text, checked=False) + secret_spans(text)
                rng = np.random.default_rng([seed, zlib.crc32(text.encode("utf-8", "surrogatepass"))])  # the same wherever the row is read
                for version in range(VERSIONS if spans else 1):
                    new, kept, _ = respelled(text, spans, rng, 0.5)
                    shift = int(rng.integers(STRIDE)) if version else 0
                    points = np.concatenate([np.full(shift, 32, np.uint32), _points(new)])
                    tags = np.zeros(len(points), np.uint8)
                    for kind, a, b in kept:
                        tags[a + shift : b + shift], tags[a + shift] = 2 + 2 * kind, 1 + 2 * kind
                    starts = _windows(points)
                    for x, y in zip(_cut(classes(points).astype(np.uint8), starts), _cut(tags, starts), strict=True):
                        if version and not y.any():
                            continue
                        xs.append(x.tobytes())
                        ys.append(y.tobytes())
                        kinds.append((int(y[y > 0].max()) - 1) // 2 if y.any() else -1)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary()), pa.array(kinds, pa.int32())], names=["x", "y", "kind"])

    return run


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, windows: int = TRAIN_WINDOWS) -> Tagger | None:
    """A tagger trained on a bounded sample's pattern spans; None if there is none."""
    n = docs.count()
    # the text is hashed too: rows of one much repeated or null id are sampled one by one
    near = F.pmod(F.xxhash64(F.lit("pii"), F.col(doc_id), F.col(text)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / max(n, 1))) + 1
    rows = docs.where(near & F.col(text).rlike("[0-9@]")).select(F.col(text).cast("string").alias("text")).mapInArrow(_labelled(11), "x binary, y binary, kind int")
    rows = checkpointed(rows.withColumn("h", F.xxhash64("x", "y")).dropDuplicates(["h"]))  # read once for each kind, scanned once
    # windows of each kind and without spans, each the least by hash: a top-k, so only 2 * windows rows come back
    least = lambda kind, most: rows.where(F.col("kind") == kind).orderBy("h").limit(most)
    chosen = least(-1, windows)
    for kind in range(len(KINDS)):
        chosen = chosen.unionByName(least(kind, windows // len(KINDS)))
    ranked = chosen.toPandas().sort_values("h")
    if not (ranked["kind"] >= 0).any():
        return None
    stack = lambda c: np.stack([np.frombuffer(b, np.uint8) for b in ranked[c]]).astype(np.int64)
    tagger = Tagger()
    tagger.train(stack("x"), stack("y"), epochs=max(EPOCHS, LEAST_STEPS * 64 // len(ranked)))
    return tagger


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _finding(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                base, more = finder.find([t or "" for t in part.column(1).to_pylist()])
                spans = [sorted([(*s, True) for s in b] + [(*s, False) for s in m], key=lambda s: s[:3]) for b, m in zip(base, more, strict=True)]
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in s] for s in spans]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(rows, pa.list_(_SPAN))], schema=_SCHEMA)

    return run


def find(docs: DataFrame, tagger: Tagger | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base; by kind and start)."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _finding(shared), "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    )


def _redacting(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                raw = part.column(text_at).to_pylist()
                base, more = finder.find([t or "" for t in raw])
                clean = [None if t is None else redacted(t, b + m) for t, b, m in zip(raw, base, more, strict=True)]
                yield part.set_column(text_at, part.schema.field(text_at), pa.array(clean, part.schema.field(text_at).type))

    return run


def redact(docs: DataFrame, tagger: Tagger | None, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with every span in the text replaced by its kind, and n_chars (if there) that of the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    out = docs.mapInArrow(_redacting(shared, docs.columns.index(text)), docs.schema)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out
