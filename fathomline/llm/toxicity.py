"""Toxicity by class-conditional Kneser-Ney bigram models that share their backoff.

Words are lower-cased runs of letters and digits. The lower orders count contexts rather than occurrences, as Kneser-Ney
models do; here a context is a document, so that a text that repeats itself does not stand for many. Of copies (equal
texts with the same label) one is learned from.

An expression (the first 5 bytes of a word, its first 7, the word, two words in a row) that o ordinary and t toxic
documents have is modelled in each class by the count that the next lower order, shared by the classes but for what that
order itself has learned, expects there, and by what the class has beyond that after a discount:

    e   = n * p,   n = o + t,   p / (1 - p) = T / O * R(lower)       T, O: documents of the classes
    d   = sign(t - e) * max(|t - e| - z * sqrt(n * p * (1 - p) + 1/4), 0)
    P_t = (e + d + p / 2) / T,   P_o = (n - e - d + (1 - p) / 2) / O,   R = P_t / P_o

The discount is z standard errors, so that rare expressions keep only the counts that back off to both classes alike
(R = R(lower), in the end 1), however many of them there are. The lower order of two words is the product of both words'
ratios, and R of the second word after the first is R of the pair over R of the first.

A text's log-likelihood ratio over its distinct bigrams, per bigram and per square root of their number, goes through a
logistic calibration. It is fitted on about `calibrate` rows of each class (the documented bound; at most a quarter of
the class), which the counts leave out. z is the one of `DISCOUNTS` with the least log-loss on these rows. All of this
is taken from learning rows alone.

Only expressions with d != 0 are in the model, as all others have their lower order's ratio. Their number grows with the
corpus. Those of words go to every task; those of bigrams stay in a table and go to the tasks in slices, one pass over
the texts for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, discard, hash_spans, held_out, saved, slices, squeezed, words

_CHAR = np.zeros(256, bool)
_CHAR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Discounts to choose from, in standard errors.
DISCOUNTS = (3.0, 4.0, 5.0, 6.0)
PREFIXES = (7, 5)
_HALF = np.uint64(32)
#: The context of a text's first word.
_START = np.uint64(0x5BD1E995)


def hashed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (a row of the array for words as they are, then for each prefix), and each text's range."""
    starts, ends, at = words(buf, offs, _CHAR)
    if not len(starts):
        return np.empty((1 + len(PREFIXES), 0), np.uint64), at
    buf = LOWER[buf]
    return np.stack([hash_spans(buf, starts, ends), *(hash_spans(buf, starts, np.minimum(ends, starts + k)) + np.uint64(k) for k in PREFIXES)]), at


def pair_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key for each word with the word before it in its text: 32 bits of each."""
    before = np.concatenate([[_START], h[0, :-1]]) if h.shape[1] else h[0]
    before[at[:-1][at[:-1] < at[1:]]] = _START
    return (before << _HALF) | (h[0] & np.uint64(0xFFFFFFFF))


def tilted(o: np.ndarray, t: np.ndarray, lower: np.ndarray | float, documents: tuple[int, int], z: float) -> tuple[np.ndarray, np.ndarray]:
    """log R of expressions, and d, from their counts, log R of their lower order and the classes' documents."""
    o, t = o.astype(float), t.astype(float)
    n, prior = o + t, np.log(documents[1]) - np.log(documents[0])
    p = 1 / (1 + np.exp(-np.clip(prior + lower, -30, 30)))
    over = t - n * p
    d = np.sign(over) * np.maximum(np.abs(over) - z * np.sqrt(n * p * (1 - p) + 0.25), 0)
    got = np.log(n * p + d + p / 2) - np.log(n * (1 - p) - d + (1 - p) / 2) - prior
    return np.where(d == 0, lower, got), d


class Table:
    """Log ratios by key: sorted keys, looked up all at once; a key that is not there has the value given for it."""

    def __init__(self, key: np.ndarray, ratio: np.ndarray):
        order = np.argsort(key)
        self.key, self.ratio = key[order], ratio[order]

    def of(self, key: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        if not len(self.key):
            return np.broadcast_to(np.asarray(other, float), key.shape)
        k = np.searchsorted(self.key, key)
        k[k == len(self.key)] = 0
        return np.where(self.key[k] == key, self.ratio[k], other)


class Words:
    """Log ratios of words, from the word itself or else its longest prefix with a ratio of its own."""

    def __init__(self, short: Table, long: Table, word: Table):
        self.short, self.long, self.word = short, long, word

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.word.of(h[0], self.long.of(h[1], self.short.of(h[2], 0.0)))


class Model:
    """Ratios of words; those of bigrams are fetched in slices."""

    def __init__(self, of: Words, parts: int, fetch):
        self.of, self.parts, self.fetch = of, parts, fetch
        self.a, self.b, self.c = 1.0, 0.0, -2.0


def _ratio_sums(h: np.ndarray, at: np.ndarray, of: Words, pairs: Table, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio and number of distinct bigrams of each text; unless it is the first slice of bigrams, only
    what its bigrams add to the ratio of their words."""
    out, n = np.zeros(len(at) - 1), np.zeros(len(at) - 1, np.int64)
    if not h.shape[1]:
        return out, n
    row, key = np.repeat(np.arange(len(at) - 1), np.diff(at)), pair_keys(h, at)
    order = np.lexsort((key, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])
    pick = order[new]
    own = of.of(h[:, pick])
    x = pairs.of(key[pick], own)
    out += np.bincount(row[pick], x if first else x - own, len(out))
    return out, np.bincount(row[pick], minlength=len(n)) if first else n


def _summed(rows: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """The columns `keep` of each row with llr and n of its text, over all slices of the model's bigrams."""
    of = model.of
    state = rows.select(*keep, "text", F.lit(0.0).alias("llr"), F.lit(0).cast("long").alias("n"))
    for k in range(model.parts):
        last = k == model.parts - 1

        def run(batches, pairs=model.fetch(k), first=k == 0, last=last):
            for b in batches:
                for piece, buf, offs in slices(b, "text"):
                    llr, n = _ratio_sums(*hashed(buf, offs), of, pairs, first)
                    names = keep if last else [*keep, "text"]
                    llr, n = llr + piece.column("llr").to_numpy(), n + piece.column("n").to_numpy()
                    yield pa.record_batch([*(piece.column(c) for c in names), pa.array(llr), pa.array(n)], names=[*names, "llr", "n"])

        out = state.drop("text") if last else state
        state = state.mapInArrow(run, out.schema)
        if not last:
            state = saved(state)
    return state


def _aside(sizes: dict[int, int], calibrate: int):
    """Rows for the calibration: about `calibrate` of each class, but not over a quarter of it."""
    rate = F.when(F.col("toxic") == 1, min(0.25, calibrate / sizes[1])).otherwise(min(0.25, calibrate / sizes[0]))
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30)


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """(key, parent, ordinary, toxic): how many texts of each class have the key. keys_of(h, at): keys and parents of each
    text's expressions, in lists of pairs of arrays."""

    def run(batches):
        held: list = []
        size = 0

        def flush():
            k, parent, y = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key, at, of = np.unique(k, return_index=True, return_inverse=True)
            t = np.bincount(of, y, len(key)).astype(np.int64)
            return pa.record_batch([pa.array(key.view(np.int64)), pa.array(parent[at].view(np.int64)), pa.array(np.bincount(of, minlength=len(key)) - t), pa.array(t)], names=["key", "parent", "ordinary", "toxic"])

        for b in batches:
            for piece, buf, offs in slices(b, "text"):
                for y, (k, parent) in zip(piece.column("toxic").to_pylist(), keys_of(*hashed(buf, offs)), strict=True):
                    held.append((k, parent, np.full(len(k), float(y))))
                    size += len(k)
            if size > 1 << 20:
                yield flush()
                size = 0
        if held:
            yield flush()

    out = rows.select("text", "toxic").mapInArrow(run, "key long, parent long, ordinary long, toxic long")
    return out.groupBy("key").agg(F.max("parent").alias("parent"), F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _word_keys(h: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its words, whose parents are their longer prefixes, these, and the shorter prefixes without parent."""
    out = []
    for a, z in zip(at[:-1], at[1:], strict=True):
        keys, parents = [], []
        for k in range(len(h)):
            u, i = np.unique(h[k, a:z], return_index=True)
            keys.append(u)
            parents.append(h[k + 1, a:z][i] if k + 1 < len(h) else np.zeros(len(u), np.uint64))
        out.append((np.concatenate(keys), np.concatenate(parents)))
    return out


def _bigram_keys(h: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    key = pair_keys(h, at)
    sets = [np.unique(key[a + 1 : z]) for a, z in zip(at[:-1], at[1:], strict=True)]
    return [(u, np.zeros(len(u), np.uint64)) for u in sets]


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """Columns of a table, keys as unsigned numbers."""
    got = df.toArrow()
    return [got.column(c).to_numpy().view(np.uint64) if c in ("key", "parent") else got.column(c).to_numpy() for c in got.column_names]


def _skewed(single: DataFrame, documents: tuple[int, int]) -> list[np.ndarray]:
    """Key, parent and counts of the expressions of words that may have a ratio of their own: all that stand out against
    the classes' documents, and all below them (whose lower order so is not 1)."""

    def stand_out(batches):
        for b in batches:
            _, d = tilted(b.column("ordinary").to_numpy(), b.column("toxic").to_numpy(), 0.0, documents, min(DISCOUNTS))
            yield b.filter(pa.array(d != 0))

    top = saved(single.mapInArrow(stand_out, single.schema))
    for _ in PREFIXES:
        below = single.join(top.select(F.col("key").alias("up")), single.parent == F.col("up"), "left_semi")
        more = saved(top.unionByName(below).distinct())
        discard(top)
        top = more
    out = _arrays(top)
    discard(top)
    return out


def _words(skewed: list[np.ndarray], documents: tuple[int, int], z: float) -> Words:
    key, parent, o, t = skewed
    none, level = Table(np.empty(0, np.uint64), np.empty(0)), []
    inner = np.isin(key, parent)
    top = parent == 0
    for part in (top, ~top & inner | ~top & np.isin(parent, key[top]), ~top):
        lower = level[-1].of(parent[part], 0.0) if level else np.zeros(int(part.sum()))
        r, d = tilted(o[part], t[part], lower, documents, z)
        level.append(Table(key[part][d != 0], r[d != 0]) if part.any() else none)
    return Words(*level)


def _fit(llr: np.ndarray, n: np.ndarray, y: np.ndarray, sizes: dict[int, int]) -> tuple[np.ndarray, float]:
    """Weights of llr / n, llr / sqrt(n) and 1 in a logistic calibration, and its log-loss, by class sizes.

    The first two are not negative, so that no text gets less toxic by a greater ratio: one that would be is left out.
    """
    n = np.maximum(n, 1)
    x = np.stack([llr / n, llr / np.sqrt(n), np.ones(len(n))], 1)
    weight = np.where(y == 1, sizes[1] / max(y.sum(), 1), sizes[0] / max((1 - y).sum(), 1))

    def newton(used: np.ndarray) -> np.ndarray:
        beta, own = np.zeros(3), x * used
        for _ in range(50):  # steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(own @ beta, -30, 30)))
            h = (own * (weight * p * (1 - p))[:, None]).T @ own + 1e-3 * np.eye(3)
            beta += np.clip(np.linalg.solve(h, own.T @ (weight * (y - p)) - 1e-3 * beta), -5, 5)
        return beta

    def loss(beta: np.ndarray) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum() / weight.sum())

    fits = [newton(np.array(used)) for used in ((1, 1, 1), (0, 1, 1), (1, 0, 1), (0, 0, 1))]
    return min(((beta, loss(beta)) for beta in fits if beta[0] >= 0 and beta[1] >= 0), key=lambda f: f[1])


def train(docs: DataFrame, labels: DataFrame, slice_pairs: int = 1 << 22, calibrate: int = 2000) -> Model | None:
    """The model of all labelled rows that are not held out; None unless both classes occur.

    A slice of the bigrams that goes to the tasks has about `slice_pairs`. A doc_id with both labels counts as toxic.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & ~held_out())

    def open_(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([unpack(x).decode() for x in b.column("packed").to_pylist()], pa.string()), b.column("toxic")], names=["doc_id", "text", "toxic"])

    # one of each group of copies is chosen by keys alone, so that texts are moved once
    keys = rest.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key")).join(known, "doc_id")
    one = keys.groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct()
    rows = saved(squeezed(rest).join(one, "doc_id").mapInArrow(open_, "doc_id long, text string, toxic long"))
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    aside = _aside(sizes, calibrate)
    counted = rows.where(~aside)
    per = {r[0]: r[1] for r in counted.groupBy("toxic").count().collect()}
    documents = max(1, per.get(0, 0)), max(1, per.get(1, 0))
    single = saved(_counted(counted, _word_keys))
    skewed = _skewed(single, documents)
    discard(single)
    choices = [_words(skewed, documents, z) for z in DISCOUNTS]
    none = Table(np.empty(0, np.uint64), np.empty(0))

    def tried(batches):
        for b in batches:
            for piece, buf, offs in slices(b, "text"):
                h, at = hashed(buf, offs)
                got = [_ratio_sums(h, at, of, none, True) for of in choices]
                yield pa.record_batch([piece.column("toxic"), pa.array(got[0][1]), *(pa.array(llr) for llr, _ in got)], names=["toxic", "n", *(f"z{k}" for k in range(len(choices)))])

    y, n, *llrs = _arrays(rows.where(aside).select("text", "toxic").mapInArrow(tried, "toxic long, n long, " + ", ".join(f"z{k} double" for k in range(len(choices)))))
    best = min(range(len(choices)), key=lambda k: (_fit(llrs[k], n, y, sizes)[1], k))
    z, of = DISCOUNTS[best], choices[best]
    # ratios of words by the 32 bits that stand for them in keys of bigrams; prefixes are found through their words
    halves = saved(counted.select("text").mapInArrow(_halves(of), "half long, ratio double").groupBy("half").agg(F.max_by("ratio", F.abs("ratio")).alias("ratio")))
    half, ratio = (c.to_numpy() for c in halves.toArrow().columns)
    by_half = Table(half.astype(np.uint64), ratio)
    discard(halves)

    def beyond(batches):
        for b in batches:
            key = b.column("key").to_numpy().view(np.uint64)
            left, right = by_half.of(key >> _HALF, 0.0), by_half.of(key & np.uint64(0xFFFFFFFF), 0.0)
            r, d = tilted(b.column("ordinary").to_numpy(), b.column("toxic").to_numpy(), left + right, documents, z)
            yield pa.record_batch([b.column("key"), pa.array(r - left)], names=["key", "ratio"]).filter(pa.array(d != 0))

    own = saved(_counted(counted, _bigram_keys).select("key", "ordinary", "toxic").mapInArrow(beyond, "key long, ratio double"))
    parts = max(1, -(-own.count() // slice_pairs))

    def fetch(k):
        """A slice of the bigrams with ratios of their own, about slice_pairs of them."""
        return Table(*_arrays(own.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)))

    model = Model(of, parts, fetch)
    y, llr, n = _arrays(_summed(rows.where(aside), ["toxic"], model))
    model.a, model.b, model.c = _fit(llr, n, y, sizes)[0].tolist()
    return model


def _halves(of: Words):
    """Batches of texts to (32 bits of a word, its log ratio), for words with one."""

    def run(batches):
        for b in batches:
            key, ratio = np.empty(0, np.uint64), np.empty(0)
            for _, buf, offs in slices(b, "text"):
                h, _ = hashed(buf, offs)
                _, i = np.unique(h[0], return_index=True)
                r = of.of(h[:, i])
                some = r != 0
                key, at = np.unique(np.concatenate([key, h[0, i][some] & np.uint64(0xFFFFFFFF)]), return_index=True)
                ratio = np.concatenate([ratio, r[some]])[at]
            yield pa.record_batch([pa.array(key.astype(np.int64)), pa.array(ratio)], names=["half", "ratio"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) for each row.

    Null and empty texts have no words and get the calibration's constant; without both classes to learn from all scores
    are 0. Repeated rows and null ids keep a row each; labels, lang, source and doc_id never enter a score.
    """

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    n = F.greatest("n", F.lit(1))
    z = model.a * F.col("llr") / n + model.b * F.col("llr") / F.sqrt(n) + model.c
    s = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return _summed(rows, ["doc_id", "held_out"], model).select("doc_id", "held_out", s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))
