"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased code points; n-grams of two and three of them are hashed to `DIM` buckets. A document's
feature is (share of its n-grams in the bucket) * idf. Document frequencies cover all rows to learn from. Weights are
trained by follow-the-regularised-leader with elastic-net penalties on a sample of about `per_class` rows of each
language (the documented bound), and a temperature is fitted on a fifth of that sample kept aside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out

DIM_BITS = 15
DIM = 1 << DIM_BITS
ORDERS = (2, 3)
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: About so many characters are handled at once (a longer text is handled whole).
PIECE = 1 << 16


def pieces(texts: list[str | None]):
    """(first, last, list of arrays of buckets per order, starts of the texts) for runs of texts.

    Each text is lower-cased and preceded by a space, so that one character already gives an n-gram. Buckets of n-grams
    that would cross texts are DIM.
    """
    i = 0
    while i < len(texts):
        run, size, j = [], 0, i
        while j < len(texts) and (j == i or size + len(texts[j] or "") < PIECE):
            run.append(" " + (texts[j] or "").lower())
            size += len(run[-1])
            j += 1
        c = np.frombuffer("".join(run).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([0, *map(len, run)])
        got, h = [], c * _MULT[0]
        for k in range(2, max(ORDERS) + 1):
            part = c[k - 1 :] * _MULT[k - 1]
            h = (h[: len(part)] ^ part) * np.uint32(0x27D4EB2F)
            g = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - DIM_BITS)).astype(np.int32)
            out = np.full(len(c), DIM, np.int32)
            out[: len(g)] = g
            for back in range(1, k):
                out[np.maximum(starts[1:] - back, starts[:-1])] = DIM
            got.append(out)
        yield i, j, got, starts
        i = j


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows (with a text) each bucket occurs, over all rows; and how many rows there are."""

    def run(batches):
        df, n = np.zeros(DIM, np.int64), 0
        seen = np.zeros((64, DIM + 1), bool)
        for b in batches:
            for i, j, got, starts in pieces(b.column("text").to_pylist()):
                n += j - i
                for lo in range(0, j - i, 64):
                    hi = min(lo + 64, j - i)
                    seen[: hi - lo] = False
                    a, z = starts[lo], starts[hi]
                    of = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(starts[lo : hi + 1])) * np.int32(DIM + 1)
                    for g in got:
                        seen.ravel()[of + g[a:z]] = True
                    df += np.add.reduce(seen[: hi - lo, :DIM], axis=0, dtype=np.uint8)
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["bucket", "df"])

    got = rows.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df")).collect()  # at most DIM + 1 rows
    df, n = np.zeros(DIM), 0
    for k, v in got:
        if k < 0:
            n = v
        else:
            df[k] = v
    return df, n


def counts(text: str) -> np.ndarray:
    _, _, got, _ = next(pieces([text]))
    return np.bincount(np.concatenate(got), minlength=DIM + 1)[:DIM]


class Model:
    """Weights (DIM x classes), bias, temperature and idf."""

    def __init__(self, classes: list[str], idf: np.ndarray):
        self.classes, self.idf = classes, idf
        self.w, self.bias, self.temperature = np.zeros((DIM, len(classes))), np.zeros(len(classes)), 1.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], alpha=0.8, beta=1.0, l1=0.02, l2=0.02, epochs=4) -> Model:
        """rows: (buckets, features, class). FTRL-proximal; every fifth row is kept for the temperature."""
        k = len(self.classes)
        z, n, zb, nb = np.zeros((DIM, k)), np.zeros((DIM, k)), np.zeros(k), np.zeros(k)
        learn, aside = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]

        def solve(z, n, l1, l2):
            w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
            return np.where(np.abs(z) <= l1, 0.0, w)

        order = np.random.default_rng(5)
        for _ in range(epochs):
            for i in order.permutation(len(learn)):
                at, x, y = learn[i]
                w, wb = solve(z[at], n[at], l1, l2), solve(zb, nb, 0, 0)
                p = _softmax(x @ w + wb)
                p[y] -= 1
                g = x[:, None] * p
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
                zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * wb
                nb += p * p
        self.w, self.bias = solve(z, n, l1, l2), solve(zb, nb, 0, 0)
        if aside:
            logits, ys = np.array([x @ self.w[at] + self.bias for at, x, _ in aside]), np.array([y for _, _, y in aside])
            loss = lambda t: -np.mean(np.log(np.maximum(_softmax(logits / t)[np.arange(len(ys)), ys], 1e-12)))
            self.temperature = min(np.geomspace(0.2, 5, 60), key=loss)
        return self

    def table(self) -> np.ndarray:
        return (self.w * (self.idf * SCALE)[:, None]).astype(np.float32)


#: Shares are small numbers; features are given in hundredths.
SCALE = 100.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(docs: DataFrame, per_class: int = 500) -> Model | None:
    """Learns from rows with text and non-null lang that are not held out. None without such rows."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    classes = sorted(sizes)
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    rate = F.create_map(*[F.lit(x) for c in classes for x in (c, min(1.0, per_class / sizes[c]))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30))
    where = {c: i for i, c in enumerate(classes)}

    def features(batches):
        for b in batches:
            at, xs, ys, ids = [], [], [], []
            for i, t, lang in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                c = counts(t)
                k = np.flatnonzero(c)
                at.append(k.astype(np.int32))
                xs.append((c[k] / c.sum() * idf[k] * SCALE).astype(np.float32))
                ys.append(where[lang])
                ids.append(i)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float32())), pa.array(ys, pa.int32())], names=["doc_id", "at", "x", "y"])

    got = sample.mapInArrow(features, "doc_id long, at array<int>, x array<float>, y int").toArrow()
    data = sorted(((i if i is not None else -1, np.array(a, np.int64), np.array(x, np.float64), y) for i, a, x, y in zip(*(got.column(c).to_pylist() for c in ("doc_id", "at", "x", "y")), strict=True)), key=lambda r: (r[0], r[3], len(r[1])))
    return Model(classes, idf).fit([r[1:] for r in data])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    Texts that are null or have no letter are `und` with score 1 (score 0 where nothing could be learned). Repeated rows
    and null ids keep a row each; lang, source and doc_id never enter a prediction.
    """
    table = model.table() if model else None
    bias, temperature, classes = (model.bias, model.temperature, model.classes) if model else (None, None, None)

    def run(batches):
        columns = [np.append(table[:, k], np.float32(0)) for k in range(len(classes))] if model else []
        for b in batches:
            texts = b.column("text").to_pylist()
            known = [t is not None and any(map(str.isalpha, t)) for t in texts]  # Unicode letters, not numerals such as ½
            lang, score = np.full(len(texts), "und", object), np.array([0.0 if k else 1.0 for k in known])
            for i, j, got, starts in pieces(texts) if columns else ():
                n = sum(np.add.reduceat(g < DIM, starts[:-1], dtype=np.int64) for g in got)
                x = np.stack([sum(np.add.reduceat(w[g], starts[:-1], dtype=np.float64) for g in got) for w in columns], 1)
                p = _softmax((x / np.maximum(n, 1)[:, None] + bias) / temperature)
                ok = np.array(known[i:j])
                lang[i:j][ok] = np.array(classes, object)[p.argmax(1)][ok]
                score[i:j][ok] = p.max(1)[ok]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_class: int = 500) -> DataFrame:
    """Trains on the rows that are not held out and predicts the language of every row."""
    return predict(docs, train(docs, per_class))
