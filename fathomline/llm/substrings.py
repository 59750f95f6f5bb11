"""Substring dedup: suffix automata of reference shards, matching statistics, removal of long repeated spans.

A window is `width` consecutive words of one document. The least hash among its runs of `anchor` words (the leftmost at
ties) is its anchor, so that equal windows have equal anchors at the same place. Consecutive windows with one anchor
form a segment; each window lies in one segment.

1. Segments whose anchor occurs once hold no repeated window and go.
2. Equal segments are counted; one of each is fetched with its words. All segments of an anchor are a reference shard.
3. Each shard gets a suffix automaton with counts of occurrences. Every segment is streamed through it; a window is
   repeated if its matched state occurs more than once. An anchor with more than `shard_segments` different segments
   would be an unbounded shard. It is dealt again by halves of its windows, told apart by the words before the anchor:
   all windows of a half share the least of those words and of the words after it, and these words name the new shard.
   A shard with one occurrence goes; a crowded one is halved again, at last to single windows, which name themselves.
4. Repeated windows come back to their documents, and the words under them are removed.

Automata are sent to the shard's segments by the shuffle rather than broadcast to all documents: what is repeated grows
with the corpus and has no bound to broadcast under.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import coefficients, discard, hash_spans, mix, ngrams, numbered, pieces, saved, slices, squeezed, within, words

WIDTH, ANCHOR, SHARD_SEGMENTS = 35, 8, 1000


def segments(buf: np.ndarray, offs: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR):
    """(anchor hash, segment hash, row, first window's word in its row, windows, anchor's place) of all segments of a slice."""
    starts, ends, at = words(buf, offs)
    total = len(starts)
    none = np.empty(0, np.int64)
    if total < width:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    h = hash_spans(buf, starts, ends)
    g = ngrams(h, anchor)
    span = width - anchor + 1
    n = total - width + 1
    best = np.arange(len(g))
    reach = 1
    while reach < span:  # best[i]: place of the leftmost least hash in g[i : i + reach]
        step = min(reach, span - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(g[right] < g[left], right, left)
        reach += step
    best = best[:n]
    ok = within(at, width)
    cut = np.ones(n, bool)
    cut[1:] = (best[1:] != best[:-1]) | ~ok[:-1]
    first = np.flatnonzero(cut & ok)
    ends_at = np.append(np.flatnonzero(cut | ~ok), n)
    count = ends_at[np.searchsorted(ends_at, first, "right")] - first
    row = np.searchsorted(at, first, "right") - 1
    # A hash of a segment's words, and of where in it the anchor stands.
    weight = h * _PLACE[0]
    power = np.empty(total, np.uint64)
    power[0] = 1
    power[1:] = _PLACE[1]
    power = np.cumprod(power, dtype=np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(weight) * power, dtype=np.uint64)])
    inverse = pow(int(_PLACE[1]), -1, 1 << 64)
    back = np.empty(total, np.uint64)
    back[0] = 1
    back[1:] = np.uint64(inverse)
    back = np.cumprod(back, dtype=np.uint64)
    seg = mix((prefix[first + count + width - 1] - prefix[first]) * back[first] + count.astype(np.uint64) * _PLACE[2] + (best[first] - first).astype(np.uint64))
    return g[best[first]], seg, row, first - at[row], count, best[first] - first


_PLACE = coefficients(3, 23)


class Automaton:
    """A suffix automaton of several word sequences, with how often each state's strings occur in them."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def add(self, sequence: list, times: int) -> None:
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                count[q] += times
                continue
            if q is not None:  # the sequence so far is known, but its state also stands for longer strings
                last = self._split(last, q, c)
                count[last] += times
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(times)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = cur

    def _split(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def finish(self) -> Automaton:
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]
        return self

    def repeated(self, sequence: list, width: int) -> int:
        """Bits of the windows (by their first word) that occur more than once, from the matching statistics."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        bits, v, l = 0, 0, 0
        for i, c in enumerate(sequence):
            while v and c not in nxt[v]:
                v = link[v]
                l = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                l += 1
            while length[link[v]] >= width:
                v = link[v]
                l = length[v]
            if l >= width and count[v] > 1:
                bits |= 1 << (i - width + 1)
        return bits


def repeated_windows(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """(row, lo, bits): windows that start at word lo + i of a document, for each bit i, occur elsewhere too.

    docs: (row long, unique; text; and anything else).
    """
    if width - anchor + 1 > 60:
        raise ValueError("width - anchor must be under 60")

    def anchors(batches):
        for b in batches:
            for piece, buf, offs in slices(b, "text"):
                a, s, row, lo, n, place = segments(buf, offs, width, anchor)
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), piece.column("row").take(pa.array(row)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(place.astype(np.int16))], names=["anchor", "seg", "row", "lo", "n", "place"])

    found = saved(docs.select("row", "text").mapInArrow(anchors, "anchor long, seg long, row long, lo int, n short, place short"))
    # tables on the one side of a join are saved first, so that a hot anchor on the other side can be split
    twice = saved(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    occurrences = saved(found.join(twice, "anchor"))
    discard(found, twice)
    distinct = occurrences.groupBy("anchor", "seg", "n", "place").agg(F.count("*").alias("times"), F.min(F.struct("row", "lo")).alias("at"))
    distinct = saved(distinct)
    crowd = saved(distinct.groupBy("anchor").agg(F.count("*").alias("k")))
    distinct = distinct.join(crowd, "anchor").select("anchor", "seg", "n", "place", "times", (F.col("k") > shard_segments).alias("hot"), "at.row", "at.lo")
    by_doc = distinct.groupBy("row").agg(F.collect_list(F.struct("anchor", "seg", "n", "place", "times", "hot", "lo")).alias("want"))
    fetched = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("n", pa.int16()), ("place", pa.int16()), ("times", pa.int64()), ("hot", pa.bool_()), ("words", pa.binary())])

    def fetch(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in pieces(batches):
            out: list = []
            for packed, want in zip(b.column("packed").to_pylist(), b.column("want").to_pylist(), strict=True):
                w = unpack(packed).split() if packed else []
                out += [(x["anchor"], x["seg"], x["n"], x["place"], x["times"], x["hot"], b" ".join(w[x["lo"] : x["lo"] + x["n"] + width - 1])) for x in want]
            yield _batch(out, fetched)

    shards = saved(squeezed(docs, "row").join(by_doc, "row").select("packed", "want").mapInArrow(fetch, "anchor long, seg long, n short, place short, times long, hot boolean, words binary"))
    masked = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("bits", pa.int64())])

    def stream(batches):
        open_: list = []
        out: list = []

        def close():
            if open_:
                sam = Automaton()
                sequences = [w.split() for *_, w in open_]
                for s, (*_, times, _) in zip(sequences, open_, strict=True):
                    sam.add(s, times)
                sam.finish()
                out.extend((a, seg, bits << base) for s, (_, a, seg, base, _, _) in zip(sequences, open_, strict=True) if (bits := sam.repeated(s, width)))
                open_.clear()

        for b in pieces(batches, 2048):
            for row in zip(*(b.column(c).to_pylist() for c in ("shard", "anchor", "seg", "base", "times", "words")), strict=True):
                if open_ and open_[0][0] != row[0]:
                    close()
                open_.append(row)
            if len(out) > 10_000:
                yield _batch(out, masked)
                out.clear()
        close()
        yield _batch(out, masked)

    def through_automata(rows: DataFrame) -> DataFrame:
        rows = rows.select("shard", "anchor", "seg", "base", "times", "words").repartition("shard").sortWithinPartitions("shard")
        return rows.mapInArrow(stream, "anchor long, seg long, bits long")

    halved = pa.schema([("shard", pa.binary()), ("anchor", pa.int64()), ("seg", pa.int64()), ("base", pa.int32()), ("times", pa.int64()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("words", pa.binary())])

    def halve(batches):
        """Of windows with low to high words before the anchor, those of each half, with the words that they cover."""
        for b in pieces(batches, 2048):
            out: list = []
            for a, seg, base, times, place, low, high, text in zip(*(b.column(c).to_pylist() for c in ("anchor", "seg", "base", "times", "place", "low", "high", "words")), strict=True):
                w = text.split()
                middle = (low + high + 1) // 2
                for p, q in ((low, middle - 1), (middle, high)):
                    i, j = max(0, place - q), min(len(w) - width, place - p)  # its first and last window
                    if i <= j:
                        name = hashlib.blake2b(b"%d " % p + b" ".join(w[place - p : place + width - q]), digest_size=16).digest()
                        out.append((name, a, seg, base + i, times, place - i, p, q, b" ".join(w[i : j + width])))
            yield _batch(out, halved)

    masks = through_automata(shards.where(~F.col("hot")).select(F.col("anchor").cast("string").cast("binary").alias("shard"), "anchor", "seg", F.lit(0).alias("base"), "times", "words"))
    crowded = shards.where("hot").select("anchor", "seg", F.lit(0).alias("base"), "times", F.col("place").cast("int").alias("place"), F.lit(0).alias("low"), F.lit(width - anchor).alias("high"), "words")
    more = []
    while not crowded.isEmpty():  # as often as `width - anchor` can be halved
        parts = saved(crowded.mapInArrow(halve, "shard binary, anchor long, seg long, base int, times long, place int, low int, high int, words binary"))
        per = parts.groupBy("shard").agg(F.sum("times").alias("total"), F.count("*").alias("k")).where("total > 1")
        parts = saved(parts.join(per, "shard"))
        one = F.col("low") == F.col("high")
        more.append(parts.where(one).select("anchor", "seg", F.expr("shiftleft(1L, base)").alias("bits")))
        more.append(through_automata(parts.where(~one & (F.col("k") <= shard_segments))))
        crowded = parts.where(~one & (F.col("k") > shard_segments))
    if more:
        masks = masks.unionByName(functools.reduce(DataFrame.unionByName, more).groupBy("anchor", "seg").agg(F.bit_or("bits").alias("bits")))
    return occurrences.join(masks, ["anchor", "seg"]).select("row", "lo", "bits")


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _covered(n: int, spans, width: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for x in spans or ():
        lo, bits = x["lo"], x["bits"]
        while bits:
            low = bits & -bits
            i = lo + low.bit_length() - 1
            edge[i] += 1
            edge[i + width] -= 1
            bits ^= low
    return np.cumsum(edge[:-1]) > 0


def kept_by_row(docs: DataFrame, width: int = WIDTH, **more) -> DataFrame:
    """row, n_words, n_removed, kept_sha256 and kept for each of docs (row long, unique; text; ...): see kept_words."""
    spans = repeated_windows(docs, width, **more).groupBy("row").agg(F.collect_list(F.struct("lo", "bits")).alias("spans"))

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in pieces(batches):
            n, gone, sha, kept = [], [], [], []
            for packed, spans in zip(b.column("packed").to_pylist(), b.column("spans").to_pylist(), strict=True):
                w = unpack(packed).split() if packed else []
                n.append(len(w))
                if spans:
                    c = _covered(len(w), spans, width)
                    w = [x for x, y in zip(w, c.tolist(), strict=True) if not y]
                gone.append(n[-1] - len(w))
                left = b" ".join(w)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            yield pa.record_batch([b.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept_sha256", "kept"])

    return squeezed(docs, "row").join(spans, "row", "left").select("row", "packed", "spans").mapInArrow(run, "row long, n_words long, n_removed long, kept_sha256 string, kept string")


def kept_words(docs: DataFrame, width: int = WIDTH, **more) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space) for each row of docs.

    A word is removed when some window over it starts elsewhere too (in the same document as well), judged on the input.
    Null texts have no words; repeated rows and null ids are documents of their own; other columns are ignored; an empty
    table gives no rows.
    """
    named, ids = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = kept_by_row(named, width, **more)
    if ids is None:
        return out.withColumnRenamed("row", "doc_id")
    return out.join(ids, "row").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
