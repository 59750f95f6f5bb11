"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman scores the candidates.

Words are lower-cased runs of letters and digits. Every run of `seed` words of an item is a seed. One pass over all
documents finds the places of all seeds. The passages around them are aligned with the item, however many documents hold
a seed, so that no group of copies hides itself; only a passage that shares too few words with the item to reach the
threshold is not aligned. The score is the best local alignment's share of a perfect one.

Test items are taken in slices of at most `slice_items`, so that what goes to every task is bounded; a larger benchmark
takes more passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, hash_spans, ngrams, raw, saved, slices, words

_CHAR = np.zeros(256, bool)
_CHAR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SEED = 4
MATCH, MISMATCH, GAP = 2, -1, -1
_FILTER_BITS = 20


def hashed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = words(buf, offs, _CHAR)
    return (hash_spans(LOWER[buf], starts, ends) if len(starts) else np.empty(0, np.uint64)), at


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences (linear gaps), and the passage word at which it ends."""
    n = len(passage)
    j = np.arange(1, n + 1)
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for w in item:
        diagonal = row[:-1] + np.where(passage == w, MATCH, MISMATCH)
        top = np.maximum(np.maximum(diagonal, row[1:] + GAP), 0)
        # gaps along the passage: H[j] = max over k <= j of top[k] + GAP * (j - k)
        run = np.maximum.accumulate(top - GAP * j) + GAP * j
        row[1:] = np.maximum(run, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def shared_words(item: np.ndarray, passage: np.ndarray) -> int:
    """Number of words that both have (with repeats): no alignment has more matches."""
    w, n = np.unique(item, return_counts=True)
    passage = np.sort(passage)
    return int(np.minimum(n, np.searchsorted(passage, w, "right") - np.searchsorted(passage, w, "left")).sum())


class Seeds:
    """The seeds of a slice of items, sorted, with the items and places they come from."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.ids = [i for i, _ in items]
        buf, offs = raw(pa.array([t for _, t in items], pa.large_string()))
        h, at = hashed(buf, offs)
        self.words = [h[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
        key, item = [], []
        for k, w in enumerate(self.words):
            g = ngrams(w, seed) if len(w) >= seed else ngrams(w, len(w))  # a shorter item is one seed
            key.append(g)
            item.append(np.full(len(g), k))
        key, item = np.concatenate(key), np.concatenate(item)
        order = np.lexsort((item, key))
        self.key, self.item = key[order], item[order]
        first = np.ones(len(order), bool)
        first[1:] = (self.key[1:] != self.key[:-1]) | (self.item[1:] != self.item[:-1])
        self.key, self.item = self.key[first], self.item[first]
        self.lengths = sorted({min(seed, len(w)) for w in self.words if len(w)})
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.key & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the slice's words, number of the seed) of every hit."""
        place, which = [], []
        for k in self.lengths:
            g = ngrams(h, k)
            p = np.flatnonzero(self.maybe[(g & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            p = p[np.searchsorted(at, p, "right") == np.searchsorted(at, p + k - 1, "right")]
            lo, hi = np.searchsorted(self.key, g[p], "left"), np.searchsorted(self.key, g[p], "right")
            n = hi - lo
            place.append(np.repeat(p, n))
            which.append(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return (np.concatenate(place), np.concatenate(which)) if place else (np.empty(0, np.int64), np.empty(0, np.int64))


def _slice(docs: DataFrame, items: list[tuple[int, str]], seed: int, threshold: float) -> DataFrame:
    seeds = Seeds(items, seed)

    def search(batches):
        for b in batches:
            for piece, buf, offs in slices(b, "text"):
                h, at = hashed(buf, offs)
                place, which = seeds.find(h, at)
                row = np.searchsorted(at, place, "right") - 1
                item = seeds.item[which]
                order = np.lexsort((place, item, row))
                place, which, row, item = place[order], which[order], row[order], item[order]
                # hits of one item that lie further apart than twice its length belong to passages of their own
                reach = np.array([2 * len(w) + 8 for w in seeds.words])[item] if len(item) else item
                new = np.ones(len(place), bool)
                new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > reach[1:])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(place)) - 1 if len(first) else first
                out_row, out_item, out_start, out_words = [], [], [], []
                for a, z in zip(first.tolist(), last.tolist(), strict=True):
                    length = len(seeds.words[item[a]])
                    lo, hi = max(at[row[a]], place[a] - length - 4), min(at[row[a] + 1], place[z] + length + 4)
                    if shared_words(seeds.words[item[a]], h[lo:hi]) < threshold * length:
                        continue  # no alignment can score enough
                    out_row.append(int(row[a]))
                    out_item.append(int(item[a]))
                    out_start.append(int(lo - at[row[a]]))
                    out_words.append(h[lo:hi].tobytes())
                cols = [piece.column("doc_id").take(pa.array(out_row, pa.int64())), pa.array(out_item, pa.int32()), pa.array(out_start, pa.int64()), pa.array(out_words, pa.binary())]
                yield pa.record_batch(cols, names=["doc_id", "item", "start", "words"])

    hits = saved(docs.mapInArrow(search, "doc_id long, item int, start long, words binary"))

    def score(batches):
        for b in batches:
            out: list = []
            for doc, k, start, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item", "start", "words")), strict=True):
                item = seeds.words[k]
                best, end = align(item, np.frombuffer(data, np.uint64))
                if best >= threshold * MATCH * len(item):
                    out.append((doc, seeds.ids[k], best / (MATCH * len(item)), start + end))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "end"])

    return hits.repartition(F.xxhash64("doc_id", "item", "start")).mapInArrow(score, "doc_id long, item_id long, score double, end long")


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = 0.5, slice_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, n_passages, end_word) of documents that hold a copy, exact or edited, of a test item.

    score: best alignment's share of a perfect one (1: word for word); end_word: the word after its end. Null or empty
    texts on either side match nothing; repeated rows count as one; null ids match under the id null; other columns are
    ignored; without documents or items there are no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9A-Za-z\\x{80}-\\x{10ffff}]")).distinct()
    n_items = items.count()
    parts = -(-n_items // slice_items)
    out = None
    for k in range(parts):
        mine = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]  # about slice_items rows
        if mine:
            got = _slice(docs, sorted(mine, key=lambda r: (r[0] is None, r)), seed, threshold)
            out = got if out is None else out.unionByName(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, n_passages long, end_word long")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.countDistinct("end").alias("n_passages"), F.max_by("end", F.struct("score", -F.col("end"))).alias("end_word"))
