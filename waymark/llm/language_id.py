"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 2-, 3- and 4-grams of a text's bytes (A-Z lower-cased, what is neither letter
nor non-ASCII counted as a space), hashed into `BUCKETS` embeddings. A text is the mean of its
subwords' embeddings; a softmax over a linear layer gives the language. Training is stochastic
gradient descent in numpy on a bounded sample of labelled rows (`PER_LANGUAGE` texts of
`SAMPLE_CHARS` characters each); a fifth of it is held back and calibrates a temperature and the
confidence under which a text is rejected. That bound is the one that best parts texts to keep, the held
texts and joins of two of them in different languages, from texts in no learned language: words of
random letters, and of letters of a script that the sample hardly has. It rejects at most `CLEAN_LOSS` of the
held texts, whatever that costs. `Model.report` has the rates. For prediction the two layers are multiplied into one table
by bucket and language, and every whole text is scored in Arrow batches.

Null texts and texts without a letter are `und` with score 0 and are rejected. Without any
labelled row every text is `und`. Long texts are handled whole; repeated rows and ids give one
row each; an empty table gives none; columns but the named ones are dropped. Rows without id
or label are predicted but not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.shared import raw_text, slices

BUCKETS, WIDTH = 1 << 15, 12
#: The training sample's bounds: texts for each language, characters of each, bytes of a training piece.
PER_LANGUAGE, SAMPLE_CHARS, PIECE = 300, 1200, 120
#: The largest share of held texts that calibration lets be rejected, and built texts of each kind.
CLEAN_LOSS, BUILT = 0.005, 400
#: More labels than these are an error: models of languages are small, labels of rows may be anything.
MOST_LANGUAGES = 1000
_GRAMS = (2, 3, 4)
_PAD = 3
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids (BUCKETS for none) for the grams of every size and start, and the starts' offsets."""
    sizes = np.diff(offs)
    begin = offs[:-1] + np.arange(len(sizes)) * (_PAD + 1)
    x = np.full(int(offs[-1]) + len(sizes) * (_PAD + 1) + _PAD, 32, np.uint32)
    x[np.arange(int(offs[-1])) + np.repeat(np.arange(len(sizes)) * (_PAD + 1) + 1, sizes)] = _FOLD[data]
    n = len(x) - _PAD
    pad = np.zeros(n, bool)
    for j in range(_PAD):
        pad[begin + sizes + 1 + j] = True
    gram, blank, out = x[:n].copy(), np.uint32(32), []
    for j in range(1, max(_GRAMS)):
        gram |= x[j : n + j] << np.uint32(8 * j)
        blank |= np.uint32(32 << (8 * j))
        if j + 1 in _GRAMS:
            mixed = (gram ^ np.uint32(j * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            bucket = (mixed >> np.uint32(17)).astype(np.int32)
            bucket[pad | (gram == blank)] = BUCKETS
            out.append(bucket)
    return np.stack(out), begin


class Model:
    """The folded layers: a table of scores by bucket and language, a bias, and the calibration."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, doubt: float):
        self.languages, self.bias, self.temperature, self.doubt = languages, bias, temperature, doubt
        self.report: dict[str, float] = {}
        self.table = [np.ascontiguousarray(t) for t in np.vstack([table, np.zeros((1, table.shape[1]))]).astype(np.float32).T]

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        grams, begin = subwords(data, offs)
        total = np.zeros((len(begin), len(self.languages)))
        count = np.zeros(len(begin))
        for g in grams:
            count += np.add.reduceat((g < BUCKETS).astype(np.int32), begin)
            for j, t in enumerate(self.table):
                total[:, j] += np.add.reduceat(t[g], begin)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def confidence(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 40.0, seed: int = 7) -> Model:
    """Fits the embeddings and the linear layer by minibatch descent on pieces of the texts."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y_text = np.array([languages.index(v) for v in labels])
    held = rng.permutation(len(texts)) % 5 == 0
    if held.all() or len(texts) < 10:
        held[:] = False
    raw = [t.encode() for t in texts]
    pieces = [(r[i : i + PIECE], y) for r, y, h in zip(raw, y_text, held, strict=True) if not h for i in range(0, max(len(r), 1), PIECE)]
    y = np.array([p[1] for p in pieces])
    weight = np.bincount(y, minlength=len(languages))
    weight = (len(y) / np.maximum(weight, 1) / len(languages))[y]  # languages count alike
    emb = rng.normal(0, 0.1, (BUCKETS + 1, WIDTH)).astype(np.float32)
    emb[BUCKETS] = 0
    lin, bias = rng.normal(0, 0.3, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(pieces))
        for lo in range(0, len(order), 256):
            pick = order[lo : lo + 256]
            text = [pieces[i][0] for i in pick]
            offs = np.concatenate([[0], np.cumsum([len(t) for t in text])])
            grams, begin = subwords(np.frombuffer(b"".join(text), np.uint8), offs)
            doc = np.searchsorted(begin, np.arange(grams.shape[1]), side="right") - 1
            use = grams < BUCKETS
            bucket, doc = grams[use], np.broadcast_to(doc, grams.shape)[use]
            n = np.maximum(np.bincount(doc, minlength=len(pick)), 1)
            near = np.argsort(doc, kind="stable")
            bucket, doc = bucket[near], doc[near]
            mean = _segment_sum(emb[bucket], doc, len(pick)) / n[:, None]
            grad = _softmax(mean @ lin + bias)
            grad[np.arange(len(pick)), y[pick]] -= 1
            grad *= weight[pick, None] / len(pick)
            back = (grad @ lin.T) / n[:, None]
            lin -= (step * 0.1 * (mean.T @ grad)).astype(np.float32)
            bias -= (0.05 * grad.sum(axis=0)).astype(np.float32)
            near = np.argsort(bucket, kind="stable")
            b = bucket[near]
            heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            emb[b[heads]] -= (step * np.add.reduceat(back[doc[near]], heads, axis=0)).astype(np.float32)
    model = Model(languages, emb[:BUCKETS] @ lin, bias, 1.0, 0.0)
    _calibrate(model, [r for r, h in zip(raw, held, strict=True) if h], y_text[held])
    return model


def _segment_sum(rows: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(seg):
        heads = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        out[seg[heads]] = np.add.reduceat(rows, heads, axis=0)
    return out


def _calibrate(model: Model, texts: list[bytes], y: np.ndarray, seed: int = 17) -> None:
    """The temperature of least log loss on held texts, and the doubt that parts texts to keep from built ones to reject.

    The targets are smoothed by a hundredth: on separable texts the plain loss has no least temperature.
    """
    if not texts:
        return
    logits = _logits(model, texts)

    def loss(t: float) -> float:
        log_p = np.log(np.maximum(_softmax(logits / t), 1e-12))
        return -(0.99 * log_p[np.arange(len(y)), y] + 0.01 * log_p.mean(axis=1)).mean()

    model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=loss)
    sure = {"clean": model.confidence(logits).max(axis=1)}
    for kind, built in _built(texts, y, np.random.default_rng(seed)).items():
        sure[kind] = model.confidence(_logits(model, built)).max(axis=1) if built else np.zeros(0)
    keep, drop = np.sort(np.concatenate([sure["clean"], sure["mixed"]])), np.sort(np.concatenate([sure["random"], sure["foreign"]]))
    bounds = np.concatenate([keep, drop])
    lost = np.searchsorted(keep, bounds) / len(keep) - np.searchsorted(drop, bounds) / len(drop)
    best = bounds[lost <= lost.min() + 1e-9]
    # the middle of the gap, where there is one
    model.doubt = float(min(np.median(best), np.quantile(sure["clean"], CLEAN_LOSS)))
    model.report = {f"rejected_{k}": float((v < model.doubt).mean()) if len(v) else 0.0 for k, v in sure.items()}
    model.report |= {"accuracy": float((logits.argmax(axis=1) == y).mean()), "doubt": model.doubt, "temperature": model.temperature}


def _logits(model: Model, texts: list[bytes]) -> np.ndarray:
    return model.logits(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def _built(texts: list[bytes], y: np.ndarray, rng: np.random.Generator) -> dict[str, list[bytes]]:
    """Texts built from the held ones: two languages in one, random letters, letters of a rare script."""
    one, two = rng.integers(0, len(texts), (2, 4 * BUILT))
    sizes = rng.integers(40, 600, 4 * BUILT)
    mixed = [texts[i][:n] + b" " + texts[j][:n] for i, j, n in zip(one, two, sizes, strict=True) if y[i] != y[j]]
    seen = b"".join(texts)
    rare = min((0x0370, 0x0430, 0x05D0, 0x4E00), key=lambda c: seen.count(chr(c + 5).encode()))

    def words(first: int) -> bytes:
        return " ".join("".join(chr(first + i) for i in rng.integers(0, 26, n)) for n in rng.integers(2, 10, rng.integers(8, 150))).encode()

    return {"mixed": mixed[:BUILT], "random": [words(97) for _ in range(BUILT)], "foreign": [words(rare) for _ in range(BUILT)]}


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the learnable rows' sample; None if no row is labelled."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    # the text is hashed too: rows of one much repeated id are sampled one by one, copies of a row count once
    hashed = rows.select(F.col(lang).alias("l"), F.xxhash64(F.lit("sample"), F.col(doc_id), F.col(text)).alias("h"), F.col(text).alias("t"))
    unit = F.shiftrightunsigned("h", 11) / float(1 << 53)
    start = F.pmod(F.xxhash64(F.lit("start"), "h"), F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    share = {k: min(1.0, (1.5 * per_language + 50) / n) for k, n in sizes.items()}
    first = Window.partitionBy("l").orderBy("h")
    found, wanted = {}, set(sizes)
    while wanted:
        bound = F.create_map(*[F.lit(x) for k in sorted(wanted) for x in (k, share[k])])
        drawn = hashed.where(F.col("l").isin(list(wanted)) & (unit <= F.element_at(bound, F.col("l")))).select("l", "h", F.substring("t", start, F.lit(SAMPLE_CHARS)).alias("t"))
        # those of the least hashes; the bound keeps a language's rows few before they are ranked
        best = drawn.dropDuplicates(["l", "h"]).withColumn("i", F.row_number().over(first)).where(F.col("i") <= per_language).select("l", "h", "t").collect()
        for k in wanted:
            found[k] = sorted((r.h, r.t) for r in best if r.l == k)
        # where copies of few rows take the share, a larger one is drawn
        wanted = {k for k in wanted if len(found[k]) < per_language and share[k] < 1}
        share |= {k: min(1.0, 8 * share[k]) for k in wanted}
    sample = [(k, t) for k in sorted(found) for _, t in found[k]]
    return train([t for _, t in sample], [k for k, _ in sample])


def _predictor(shared, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offs = raw_text(batch.column(1))
            names, scores, no = [], [], []
            for lo, hi in slices(offs):
                part, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                if model is None:
                    best, sure = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                else:
                    p = model.confidence(model.logits(part, at))
                    best, sure = p.argmax(axis=1), p.max(axis=1)
                ascii_letter = np.zeros(len(part) + 1, np.int64)
                np.cumsum((_FOLD[part] >= 97) & (part < 128), out=ascii_letter[1:])
                some = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
                for i in range(hi - lo):
                    letter = model is not None and (some[i] or any(c.isalpha() for c in bytes(part[at[i] : at[i + 1]]).decode("utf-8", "replace")))
                    names.append(model.languages[best[i]] if letter else "und")
                    scores.append(float(sure[i]) if letter else 0.0)
                    no.append(not letter or bool(sure[i] < model.doubt))
            beside = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(no, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *beside, *found], names=["doc_id", *carry, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score (calibrated, 0 to 1) and rejected of each text; columns to carry stand beside their row's verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text).cast("string")}
    rows = docs.select(*[c.alias(n) for n, c in taken.items()], *[c for c in carry if c not in taken])
    beside = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carry)
    return rows.mapInArrow(_predictor(shared, list(carry)), f"doc_id long, {beside}lang_pred string, score double, rejected boolean")
