"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, components.

1. Each document's set of word shingles (64-bit hashes) gives `bands * rows` minima of universal hashes a*x+b mod 2^64.
   Documents with equal sets become one class.
2. Classes that share a band meet in a bucket. Each is compared with one leader of the bucket only, the one in the
   largest buckets, which makes no more pairs than there are rows in buckets, however large a bucket is.
3. Pairs whose one-bit signatures are too far apart are dropped; the others are confirmed on their full sets.
4. Components of confirmed links. Rows of buckets that still hold several components are searched once more for links
   across components, on prefixes of their sets with the rarest shingles first, so that no connection between members of
   a bucket is lost and a group of texts that are alike, but under the threshold, does not give all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, _NGRAM, coefficients, discard, hash_spans, mix, ngrams, numbered, row_filter, saved, slices, squeezed, words
from .components import connected


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k-word shingles of each row; a shorter row is one shingle, a row without words none."""
    starts, ends, at = words(buf, offs)
    h = hash_spans(LOWER[buf], starts, ends) if len(starts) else np.empty(0, np.uint64)
    g = ngrams(h, k)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = z - a
        if n >= k:
            out.append(np.unique(g[a : z - k + 1]))
        elif n:
            out.append(mix((h[a:z] * _NGRAM[:n]).sum(dtype=np.uint64)[None] + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], hashes: int, seed: int = 3) -> np.ndarray:
    """Minima of `hashes` universal hashes over each set (no set may be empty): the high halves, sets x hashes."""
    a, b = coefficients(hashes, seed), coefficients(hashes, seed + 1)
    sizes = [len(s) for s in sets]
    out = np.empty((len(sets), hashes), np.uint32)
    i = 0
    while i < len(sets):  # about 32,000 values at once stay in the cache
        j, n = i, 0
        while j < len(sets) and (j == i or n + sizes[j] <= 1 << 15):
            n += sizes[j]
            j += 1
        x = np.concatenate(sets[i:j])
        at = np.concatenate([[0], np.cumsum(sizes[i : j - 1], dtype=np.int64)]).astype(np.int64)
        y = np.empty_like(x)
        for k in range(hashes):
            np.multiply(x, a[k], out=y)
            np.add(y, b[k], out=y)
            out[i:j, k] = np.minimum.reduceat(y, at) >> np.uint64(32)
        i = j
    return out


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """row, n_shingles, fingerprint (f1, f2) of the set, one-bit signature (s1, s2), band keys."""
    weights = coefficients(rows, 7)

    def run(batches):
        for b in batches:
            for piece, buf, offs in slices(b, "text"):
                sets = shingle_sets(buf, offs, shingle)
                some = [i for i, s in enumerate(sets) if len(s)]
                n = np.array([len(s) for s in sets], np.int64)
                f1, f2, s1, s2 = (np.zeros(len(sets), np.uint64) for _ in range(4))
                keys = [[]] * len(sets)
                if some:
                    sig = signatures([sets[i] for i in some], bands * rows)
                    for i in some:
                        f1[i], f2[i] = sets[i].sum(dtype=np.uint64), mix(sets[i] ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    bits = (sig & 1).astype(np.uint64)
                    half = np.uint64(1) << np.arange(64, dtype=np.uint64)
                    s1[some] = (bits[:, :64] * half[: min(64, bits.shape[1])]).sum(1, dtype=np.uint64)
                    s2[some] = (bits[:, 64:128] * half[: max(0, min(64, bits.shape[1] - 64))]).sum(1, dtype=np.uint64)
                    by_band = sig.reshape(len(some), bands, rows).astype(np.uint64)
                    band = mix((by_band * weights).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    keys = list(keys)
                    for i, row in zip(some, band.view(np.int64).tolist(), strict=True):
                        keys[i] = row
                yield pa.record_batch([piece.column("row"), pa.array(n), *(pa.array(x.view(np.int64)) for x in (f1, f2, s1, s2)), pa.array(keys, pa.list_(pa.int64()))], names=["row", "n_shingles", "f1", "f2", "s1", "s2", "bands"])

    return docs.select("row", "text").mapInArrow(run, "row long, n_shingles long, f1 long, f2 long, s1 long, s2 long, bands array<long>")


def _texts(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of compressed texts."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    texts = [unpack(x) if x else b"" for x in batch.column(column).to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _confirmed(pairs: DataFrame, crowd: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose full sets have den * |intersection| >= num * |union|. crowd: (row, packed text).

    The text of b moves once for a pair and that of a once for all its pairs; rows come sorted by a.
    """
    second = pairs.join(crowd.withColumnsRenamed({"row": "b", "packed": "tb"}), "b")
    texts = second.join(crowd.withColumnsRenamed({"row": "a", "packed": "ta"}), "a").select("a", "b", "ta", "tb")

    def run(batches):
        last, x = None, np.empty(0, np.uint64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                sets = shingle_sets(*_texts(piece, "tb"), shingle)
                ok = []
                for k, (i, y) in enumerate(zip(piece.column("a").to_pylist(), sets, strict=True)):
                    if i != last:
                        last, x = i, shingle_sets(*_texts(piece.slice(k, 1), "ta"), shingle)[0]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
                yield pa.record_batch([piece.column("a"), piece.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return texts.sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def _alike(num: int, den: int, bits: int):
    """For rows x and y: sizes within reach of the threshold, and one-bit signatures that agree well enough.

    Such signatures agree in a share of (1 + similarity) / 2; as many as this differ only far below the threshold.
    """
    miss = (1 - num / den) / 2
    most = int(bits * miss + 7 * (bits * miss * (1 - miss)) ** 0.5) + 1
    differ = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) + F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2")))
    return (differ <= most) & (den * F.least("x.n_shingles", "y.n_shingles") >= num * F.greatest("x.n_shingles", "y.n_shingles"))


def _across(open_: DataFrame, crowd: DataFrame, shingle: int, num: int, den: int, alike) -> DataFrame:
    """Candidate pairs (a, b) of open rows in different components: no pair at or above the threshold is missing.

    open_: (row, n_shingles, s1, s2, component). Shingles are ordered by how many open rows have them, rarest first. Of
    two sets with an overlap of o, of n and m shingles, the first n - o + 1 and m - o + 1 in that order share one. So
    rows meet only on rare shingles, and what a whole group has in common comes last and gives no pairs.
    """

    def sets(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                got = shingle_sets(*_texts(piece, "packed"), shingle)
                offs = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                flat = np.concatenate(got).view(np.int64) if len(got) else np.empty(0, np.int64)
                yield pa.record_batch([piece.column("row"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["row", "shingles"])

    own = saved(crowd.join(open_.select("row"), "row", "left_semi").select("row", "packed").mapInArrow(sets, "row long, shingles array<long>"))
    each = own.select("row", F.explode("shingles").alias("token"))
    common = saved(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    shared = each.join(common, "token").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    # unique shingles come first of all in the order and meet nobody
    n, fewest = F.col("n_shingles"), F.ceil(F.lit(num) * F.col("n_shingles") / F.lit(den))
    reach = n - F.ceil(F.lit(num) * (n + fewest) / F.lit(num + den)) + 1
    prefix = F.greatest(reach - (n - F.size("tokens")), F.lit(0)).cast("int")
    first = shared.join(open_, "row").select("row", "n_shingles", "s1", "s2", "component", (n - F.size("tokens")).alias("alone"), F.slice("tokens", 1, prefix).alias("tokens"))
    keyed = saved(first.select("row", "n_shingles", "s1", "s2", "component", "alone", F.posexplode("tokens").alias("at", "token")).select("row", "n_shingles", "s1", "s2", "component", (F.col("alone") + F.col("at")).alias("at"), "token.token"))
    twice = saved(keyed.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("token"))
    keyed = keyed.join(twice, "token")
    overlap = F.ceil(F.lit(num) * (F.col("x.n_shingles") + F.col("y.n_shingles")) / F.lit(num + den))
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.row") < F.col("y.row")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.at") <= F.col("x.n_shingles") - overlap) & (F.col("y.at") <= F.col("y.n_shingles") - overlap) & alike
    out = saved(keyed.alias("x").join(keyed.alias("y"), meet).select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct())
    discard(own, common, twice)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 30, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text, ...).

    Documents are linked when den * |intersection| >= num * |union| of their shingle sets (A-Z lower-cased). Null, empty
    and blank texts have no shingles and no links. A row without doc_id takes no part and is kept; rows that repeat a
    doc_id are one document (a link of any of them counts). Other columns are ignored; an empty table gives no rows.
    """
    named, ids = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    signed = saved(_signed(named.select("row", "text"), shingle, bands, rows))
    some = signed.where(F.col("n_shingles") > 0)
    if ids is not None:
        some = some.join(ids.where(F.col("doc_id").isNotNull()), "row", "left_semi")
    key = ["f1", "f2", "n_shingles"]
    classes = saved(some.groupBy(*key).agg(F.min("row").alias("rep")))
    first = some.join(classes.select("rep"), some.row == F.col("rep"), "left_semi").select("row", "n_shingles", "s1", "s2", F.explode("bands").alias("key"))
    sizes = saved(first.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"))
    members = saved(first.join(sizes, "key"))
    # a row with all the common minima of its group is in the largest buckets: it leads, being most alike to the others
    weight = members.groupBy("row").agg(F.sum("many").alias("weight"))
    leaders = saved(members.join(weight, "row").groupBy("key").agg(F.max_by(F.struct("row", "n_shingles", "s1", "s2"), F.struct("weight", -F.col("row"))).alias("h")).select("key", "h.*"))
    alike = _alike(num, den, min(128, bands * rows))
    star = leaders.alias("x").join(members.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.row") != F.col("y.row")) & alike)
    star = saved(star.select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct())
    met = members.select("row").distinct()
    crowd = saved(squeezed(named, "row", row_filter(met, "row")).join(met, "row", "left_semi"))
    links = saved(_confirmed(star, crowd, shingle, num, den))
    component = connected(links)
    # rows of buckets that still hold several components
    placed = members.join(component, members.row == component.node, "left").select("key", "row", "n_shingles", "s1", "s2", F.coalesce("component", "row").alias("component"))
    mixed = saved(placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key"))
    open_ = saved(placed.join(mixed, "key", "left_semi").drop("key").distinct())
    discard(sizes, leaders, star)
    across = _across(open_, crowd, shingle, num, den, alike)
    more = saved(_confirmed(across, crowd, shingle, num, den))
    if not more.isEmpty():
        component, before = connected(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), component
        discard(before)
    place = saved(signed.select("row", *key).join(classes, key, "left").join(component, F.col("rep") == F.col("node"), "left").select("row", "n_shingles", F.coalesce("component", "rep").alias("c")))
    discard(signed, classes, members, mixed, open_, crowd, links, across, more, component)
    if ids is None:
        own = F.coalesce("c", "row")
        return place.select(F.col("row").alias("doc_id"), "n_shingles", own.alias("component_id"), (F.col("row") == own).alias("kept"))
    # rows of one doc_id are one node: its rows' components are joined, and the least doc_id names what they make
    of = place.join(ids, "row")
    same = of.where("c is not null and doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("b"))
    joined = connected(of.where("c is not null").join(same, "doc_id").select(F.col("c").alias("a"), "b"))
    of = of.join(joined, F.col("c") == F.col("node"), "left").select("row", "doc_id", "n_shingles", F.coalesce("component", "c").alias("c"))
    least = of.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of = of.join(least, "c", "left")
    # a row without shingles belongs where another row of its doc_id does
    by_id = of.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("other"))
    of = of.join(by_id, "doc_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "other", "doc_id"))
    return of.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
