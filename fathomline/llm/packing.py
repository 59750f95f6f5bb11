"""Packing tokenised documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are dealt into random groups by a hash, so that groups are bounded and any of them can be run again with the
same result. In a group, documents are cut into pieces of at most `length` ids, pieces go to the first bin that still
holds them, longest first, and what is then left of the emptiest bins is cut to fill the gaps of the others. At most
one bin of a group stays short; it is cut at powers of two, as such sequences need no padding.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import hash_spans, raw, words

LENGTH = 2048
END = 1
#: Bytes of text tokenised at once, about.
PIECE = 8 << 20


class Tournament:
    """First bin with enough room, in O(log bins): each inner node holds the larger room of its two children."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.tree = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        tree, i = self.tree, 1
        if tree[1] < need:
            return -1
        while i < self.size:
            i *= 2
            if tree[i] < need:
                i += 1
        return i - self.size

    def take(self, at: int, n: int) -> None:
        tree, i = self.tree, at + self.size
        tree[i] -= n
        i //= 2
        while i:
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
            i //= 2


def pack(sizes: list[int], length: int = LENGTH, smallest: int = 8) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece; items with no ids give none.

    Gaps under `smallest` ids are left as padding rather than filled with slivers.
    """
    pieces = []
    for i, n in enumerate(sizes):
        pieces += [(length, i, s) for s in range(0, n - length + 1, length)]
        if n % length:
            pieces.append((n % length, i, n - n % length))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    tree = Tournament(max(1, len(pieces)), length)
    bins: list[list] = []
    for n, i, s in pieces:
        b = tree.first(n)
        while b >= len(bins):
            bins.append([])
        bins[b].append((i, s, n))
        tree.take(b, n)
    room = [length - sum(x[2] for x in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (room[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, source = order[lo], order[hi]
        if room[to] < smallest:
            lo += 1
            continue
        if not bins[source]:
            hi -= 1
            continue
        i, s, n = bins[source].pop()
        k = min(n, room[to])
        bins[to].append((i, s, k))
        room[to] -= k
        room[source] += n
        if k < n:
            bins[source].append((i, s + k, n - k))
            room[source] -= n - k
    out, seq = [], 0
    for b in bins:
        if not b:
            continue
        total = sum(x[2] for x in b)
        cuts = [total] if length - total < smallest else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        left, at = cuts.pop(0), 0
        for i, s, n in b:
            while n:
                if not left:
                    seq, left, at = seq + 1, cuts.pop(0), 0
                k = min(n, left)
                out.append((i, s, k, seq, at))
                s, n, left, at = s + k, n - k, left - k, at + k
        seq += 1
    return out


class Ids:
    """Token ids of texts by the vocabulary of a tokenizer file (byte-level BPE).

    A run of ASCII white space and the word after it are always tokenised apart from what stands around them, so each
    distinct such unit of a batch is encoded once. Texts with other white space or special tokens are encoded whole.
    """

    #: White space outside \x20 and \x09-\x0D.
    OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}
        byte = {c: b for b, c in chars.items()}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        # Fixed value: the published pattern of byte-level pre-tokenisation.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.special = tuple(special)
        self.newline = ranks[b"\n"]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, data: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(data.decode()), np.uint32)

    def units(self, data: bytes, heads: np.ndarray, ends: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units in one array; where each unit's ids begin there, and how many it has.

        Simple units (one space and a word) are encoded in one go: a newline between them stays a token of its own.
        """
        sizes, at, rest = np.zeros(len(heads), np.int64), np.flatnonzero(simple), np.flatnonzero(~simple)
        got = self.encode(b"\n".join([data[a:b] for a, b in zip(heads[at].tolist(), ends[at].tolist(), strict=True)]))
        cut = np.flatnonzero(got == self.newline)
        if len(cut) != max(0, len(at) - 1):
            raise ValueError("a unit holds a newline")
        if len(at):
            sizes[at] = np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1
        more = [self.encode(data[a:b]) for a, b in zip(heads[rest].tolist(), ends[rest].tolist(), strict=True)]
        sizes[rest] = [len(x) for x in more]
        order = np.concatenate([at, rest])
        begin = np.empty(len(heads), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([np.delete(got, cut), *more]), begin, sizes

    def batch(self, column: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text with `end` after them."""
        texts = column.to_pylist()
        odd = {r: self.whole(t) for r, t in enumerate(texts) if t and (self.OTHER_SPACE.search(t) or any(s in t for s in self.special))}
        buf, offs = raw(pa.array([None if r in odd else t for r, t in enumerate(texts)], pa.large_string()) if odd else column)
        starts, ends, at = words(buf, offs)
        data = buf.tobytes()
        # A unit goes from the end of the word before it in its row (or the row's start) to its own end.
        heads = np.empty(len(starts), np.int64)
        heads[1:] = ends[:-1]
        some = at[:-1] < at[1:]
        heads[at[:-1][some]] = offs[:-1][some]
        h = hash_spans(buf, heads, ends) if len(starts) else np.empty(0, np.uint64)
        _, pick, of = np.unique(h, return_index=True, return_inverse=True)
        for r in np.unique(np.searchsorted(at, unlike(buf, heads, ends, pick[of]), "right") - 1).tolist():
            odd[r] = self.whole(texts[r])  # another unit has the same hash
        simple = (starts[pick] - heads[pick] == 1) & (buf[heads[pick]] == 32)
        flat, begin, sizes = self.units(data, heads[pick], ends[pick], simple)
        n = sizes[of]
        stop = np.cumsum(n)
        ids = flat[np.repeat(begin[of] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        bound = np.concatenate([[0], stop])[at]
        out = []
        for r in range(len(texts)):
            if r in odd:
                own = odd[r]
            else:
                own = ids[bound[r] : bound[r + 1]]
                tail = ends[at[r + 1] - 1] if some[r] else offs[r]
                if tail < offs[r + 1]:
                    own = np.append(own, self.encode(data[tail : offs[r + 1]]))
            out.append(np.append(own, np.uint32(end)).astype("<u4"))
        return out


def unlike(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Numbers of the spans whose bytes are not those of the span other[i]."""
    lens = ends - starts
    bad = [np.flatnonzero(lens != lens[other])]
    same = np.flatnonzero((lens == lens[other]) & (other != np.arange(len(other))))
    for lo in range(0, len(same), block):
        i = same[lo : lo + block]
        n = lens[i]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = buf[np.repeat(starts[i], n) + step] != buf[np.repeat(starts[other[i]], n) + step]
        bad.append(np.unique(np.repeat(i, n)[differ]))
    return np.concatenate(bad)


_ids: dict[str, Ids] = {}


def tokeniser(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, group_rows: int = 2048, group_bytes: int = 24 << 20, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: (doc_id, text, ...); each row is a document (null and empty texts are the id `end` alone), repeated rows and
    null ids included; other columns are ignored; an empty table gives no rows. About `group_rows`
    documents, and not over about `group_bytes` bytes of text unless one text is longer, are packed together in a task. sequence_id: group * 2 ** 32 + number in the group.
    """
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    groups = max(1, -(-n // group_rows), -(-size // group_bytes))

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("doc_id", "ascending"), ("order", "ascending")])
        ids = []
        text = rows.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks)
        at = 0
        while at < len(text):  # about PIECE bytes of text at once
            n = max(1, min(len(text) - at, PIECE * (len(text) - at) // max(1, text.slice(at).nbytes)))
            ids += tokeniser(path).batch(text.slice(at, n), end)
            at += n
        base, doc = rows.column("grp")[0].as_py() << 32, rows.column("doc_id").to_pylist()
        got = pack([len(x) for x in ids], length)
        cols = [
            pa.array([doc[i] for i, *_ in got], pa.int64()),
            pa.array([s for _, s, *_ in got], pa.int64()),
            pa.array([n for _, _, n, *_ in got], pa.int64()),
            pa.array([zlib.crc32(ids[i][s : s + n].tobytes()) for i, s, n, *_ in got], pa.int64()),
            pa.array([len(ids[i]) for i, *_ in got], pa.int64()),
            pa.array([base + q for *_, q, _ in got], pa.int64()),
            pa.array([at for *_, at in got], pa.int64()),
        ]
        return pa.table(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "text", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))  # equal rows are dealt out, too
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order.alias("order"), F.pmod(order, F.lit(groups)).alias("grp"))
    return rows.groupBy("grp").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
