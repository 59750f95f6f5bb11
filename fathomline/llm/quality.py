"""Quality classifier: a weak-label model over overlapping heuristics, and a hashed linear scorer.

Each heuristic labeller votes good (1), bad (0) or abstains (2). The votes of all documents are counted by pattern (at
most 3 ** labellers of them), expectation-maximisation estimates how each labeller votes on good and bad documents, and
the posterior labels train a logistic scorer on hashed shapes of characters, over about `per_class` documents of each
label (the documented bound). A document is kept if its score is at least 0.5.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import raw

# Frequent function words.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on with as was by are this be from or an at "
    "de la le les et des en un une que du dans pour qui par sur il est pas ne "
    "der die und das den von zu mit sich ist ein eine nicht auf dem im für als auch "
    "el los las del y por con para se su al lo no es una".split()
)
LABELLERS = ("symbols", "shouting", "echo", "variety", "sentences", "function_words", "word_length")
BAD, GOOD, ABSTAIN = 0, 1, 2
_ODD = "|#$%&*!<>{}=~^_\\"


def _vote(value: float, good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(text: str | None) -> tuple[int, ...]:
    return judged(text)[0]


def judged(text: str | None) -> tuple[tuple[int, ...], float, float]:
    """The labellers' votes on a whole text, its share of echoes and its lack of variety.

    Without words all abstain but `word_length`, which says bad.
    """
    words = (text or "").split()
    n = len(words)
    if not n:
        return (ABSTAIN,) * 6 + (BAD,), 0.0, 0.0
    size = sum(map(len, words))
    odd = sum(text.count(c) for c in _ODD) / n
    upper = sum(map(str.isupper, words)) / n
    echo = sum(map(operator.eq, words, words[1:])) / n
    distinct = len(set(words))
    variety = distinct / n**0.5
    ends = sum(w[-1] in ".,;:?!" for w in words) / n
    common = sum(map(FUNCTION_WORDS.__contains__, text.lower().split())) / n
    mean = size / n
    found = (
        _vote(odd, odd < 0.05, odd > 0.3),
        _vote(upper, upper < 0.15, upper > 0.5 and n > 5),
        _vote(echo, echo < 0.03, echo > 0.2),
        ABSTAIN if n < 30 else _vote(variety, variety > 4, variety < 2.5),
        ABSTAIN if n < 30 else _vote(ends, 0.03 < ends < 0.4, ends < 0.01 or ends > 0.6),
        ABSTAIN if n < 20 else _vote(common, common > 0.15, common < 0.06),
        _vote(mean, 2.5 < mean < 11, mean > 20 or mean < 1.5),
    )
    return found, echo, max(0.0, 1 - variety / 4) if n >= 30 else 0.0


def vote_patterns(docs: DataFrame) -> dict[tuple[int, ...], int]:
    """How many documents have each pattern of votes, over all documents."""

    def run(batches):
        seen: dict = {}
        for b in batches:
            for t in b.column("text").to_pylist():
                v = votes(t)
                seen[v] = seen.get(v, 0) + 1
        if seen:
            yield pa.record_batch([pa.array(["".join(map(str, v)) for v in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    got = docs.select("text").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n")).collect()  # at most 3 ** 8 rows
    return {tuple(map(int, p)): n for p, n in sorted(got)}


TIMID = 0.3


class WeakLabels:
    """P(vote | label, it votes) of each labeller and P(good), by expectation-maximisation over counted patterns.

    An abstention says nothing. That a good document is called bad is held to be rare: that prior weighs half as much as
    the data. A labeller's votes on bad documents are held between TIMID and 1 - TIMID, as bad documents are of several
    kinds and each labeller sees few of them.
    """

    def __init__(self, patterns: dict[tuple[int, ...], int], rounds: int = 100):
        k = len(LABELLERS)
        self.prior, self.table = 0.85, np.tile(np.array([[0.5, 0.5, 1.0], [0.01, 0.99, 1.0]])[:, None, :], (1, k, 1))
        pats, n = np.array(list(patterns) or np.empty((0, k)), int).reshape(-1, k), np.array(list(patterns.values()), float)
        onehot = np.eye(3)[pats][:, :, :2]
        for _ in range(rounds if len(pats) else 0):
            good = self._posterior(pats)
            self.prior = float(np.clip((n @ good + 8.5) / (n.sum() + 10), 1e-4, 1 - 1e-4))
            for y, weight, start in ((BAD, n * (1 - good), np.array([2.0, 2.0])), (GOOD, n * good, np.array([0.01, 0.99]) * max(10, n.sum() / 2))):
                c = np.einsum("p,pkv->kv", weight, onehot) + start
                c /= c.sum(1, keepdims=True)
                self.table[y, :, :2] = np.clip(c, TIMID, 1 - TIMID) if y == BAD else np.clip(c, 0.002, 0.998)

    def _posterior(self, pats: np.ndarray) -> np.ndarray:
        at = np.arange(pats.shape[1])
        bad, good = (np.log(self.table[y][at, pats]).sum(1) for y in (BAD, GOOD))
        return 1 / (1 + np.exp(np.clip(bad + np.log(1 - self.prior) - good - np.log(self.prior), -500, 500)))

    def posterior(self, vote: tuple[int, ...]) -> float:
        return float(self._posterior(np.array([vote]))[0])


BITS = 15
#: Coordinates of the share of echoes and the lack of variety, after those of the shapes.
ECHO, MONOTONE, DIM = 1 << BITS, (1 << BITS) + 1, (1 << BITS) + 2
_CLASS = np.zeros(256, np.uint16)
for _i, _group in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\v\f", ".,;:?", "!", "|", "#", "$", "%", "&", "*", "'\"`", "()[]{}", "<>", "=", "+-_/\\~^@")):
    _CLASS[[ord(c) for c in _group]] = _i + 1
_CLASS[128:] = 20


def shapes(buf: np.ndarray) -> np.ndarray:
    """A code for each run of three characters of a text, by their kinds."""
    c = _CLASS[buf]
    return (c[:-2] << np.uint16(10)) | (c[1:-1] << np.uint16(5)) | c[2:] if len(c) > 2 else np.empty(0, np.uint16)


class Scorer:
    def __init__(self):
        self.w, self.bias = np.zeros(DIM), 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> Scorer:
        """rows: (codes, shares of them, posterior of good). Full-batch gradient steps with per-coordinate rates."""
        if not rows:
            return self
        at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        of, y = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), np.array([r[2] for r in rows])
        seen, seen_bias = np.full(DIM, 1e-8), 1e-8
        for _ in range(rounds):
            s = np.bincount(of, x * self.w[at], len(rows)) + self.bias
            d = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(rows)
            g = np.bincount(at, x * d[of], DIM) + l2 * self.w / len(rows)
            seen += g * g
            seen_bias += d.sum() ** 2
            self.w -= rate * g / np.sqrt(seen)
            self.bias -= rate * d.sum() / seen_bias**0.5
        return self


def train(docs: DataFrame, per_class: int = 3000) -> tuple[WeakLabels, Scorer]:
    patterns = vote_patterns(docs)
    weak = WeakLabels(patterns)
    n = {True: 0, False: 0}
    for p, k in patterns.items():
        n[weak.posterior(p) >= 0.5] += k
    rates = {y: min(1.0, per_class / max(k, 1)) for y, k in n.items()}
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(1 << 30)

    def run(batches):
        for b in batches:
            at, xs, ys = [], [], []
            for t, chance in zip(b.column("text").to_pylist(), b.column("chance").to_pylist(), strict=True):
                v, echo, monotone = judged(t)
                y = weak.posterior(v)
                if chance < rates[y >= 0.5]:
                    k, c = np.unique(shapes(np.frombuffer((t or "").encode(), np.uint8)), return_counts=True)
                    at.append(np.append(k.astype(np.int32), (ECHO, MONOTONE)))
                    xs.append(np.append(c / max(c.sum(), 1) * 10, (echo * 10, monotone * 10)))
                    ys.append(y)
            yield pa.record_batch([pa.array(at, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], names=["at", "x", "y"])

    rows = docs.select("text", chance.alias("chance")).where(F.col("chance") < max(rates.values()))
    got = rows.mapInArrow(run, "at array<int>, x array<double>, y double").toArrow()
    data = sorted(zip(*(got.column(c).to_pylist() for c in ("at", "x", "y")), strict=True), key=lambda r: (r[2], len(r[0]), r[0][:8], r[1][:8]))
    return weak, Scorer().fit([(np.array(a, np.int64), np.array(x), y) for a, x, y in data])


NAMES = ("quality_posterior", "quality_score", "quality_keep")


def classify(docs: DataFrame, per_class: int = 3000) -> DataFrame:
    """docs with more columns: quality_posterior (weak label), quality_score (of the scorer), quality_keep (score >= 0.5).

    A text without words scores 0 and is rejected. Null ids, repeated rows and other columns pass through as they are
    (columns of these three names are replaced).
    """
    names = NAMES
    docs = docs.drop(*names)
    weak, scorer = train(docs, per_class)
    w, bias = scorer.w, scorer.bias

    def run(batches):
        for b in batches:
            buf, offs = raw(b.column("text"))
            score, post = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for i, t in enumerate(b.column("text").to_pylist()):
                v, echo, monotone = judged(t)
                post[i] = weak.posterior(v)
                if t and t.split(None, 1):
                    s = shapes(buf[offs[i] : offs[i + 1]])
                    x = (w[s].mean() if len(s) else 0.0) * 10 + (echo * w[ECHO] + monotone * w[MONOTONE]) * 10 + bias
                    score[i] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            yield pa.record_batch([*b.columns, pa.array(post), pa.array(score), pa.array(score >= 0.5)], names=[*b.schema.names, *names])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return docs.mapInArrow(run, schema)
