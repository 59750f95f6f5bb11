"""Shared helpers: vectorised words and hashes over Arrow text, and tables in the shared folder.

Words are maximal runs of bytes other than \\x20 and \\x09-\\x0D. All separators are ASCII, so
splitting UTF-8 bytes and splitting characters give the same words.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

MASK = (1 << 64) - 1
#: Separators of words.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

_WORD = np.ones(256, bool)
_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
def coefficients(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same on every machine."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_NGRAM = coefficients(64, 11)
_STEP = coefficients(2, 13)
#: Masks of the first n of eight bytes, and the length of span in bytes beyond which xxh3 takes over.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 64

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_array(column: pa.Array) -> pa.Array:
    """Large strings without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and where each row starts and ends in them."""
    column = text_array(column)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19):
    """Pieces of a batch with at most `limit` bytes of text, or a single row: (piece, bytes, offsets)."""
    buf, offs = raw(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = _WORD):
    """Starts and ends of all words, and each row's range in those lists. No word crosses rows."""
    n = len(buf)
    w = is_word[buf]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    first = offs[:-1][offs[:-1] < n]
    s[first] = w[first]
    last = offs[1:][offs[1:] > 0] - 1
    e[last] = w[last]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, offs)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (no span may be empty), eight bytes a step; long spans by xxh3."""
    lens = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix((eight[starts] & _FIRST[np.minimum(lens, 8)]) + lens.astype(np.uint64) * _STEP[0])
    for k in range(8, _LONG, 8):
        more = np.flatnonzero(lens > k)
        if not len(more):
            break
        part = eight[starts[more] + k] & _FIRST[np.minimum(lens[more] - k, 8)]
        out[more] = mix(out[more] * _STEP[1] + part)
    for i in np.flatnonzero(lens > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed=_LONG)
    return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m] * _NGRAM[0]
    for k in range(1, n):
        out += h[k : k + m] * _NGRAM[k]
    return mix(out + np.uint64(n))


def within(word_offs: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words lie in one row (a mask over the runs of all words)."""
    total = int(word_offs[-1])
    ok = np.ones(max(total - n + 1, 0), bool)
    for k in range(1, n):
        cut = word_offs[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def held_out(column="doc_id"):
    """Rows kept away from learning: crc32 of the id as text, mod 5, is 0 (null ids count as the text '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


# ---- tables in the shared folder ---------------------------------------------------------------

#: Path of each saved table that is still there: its session.
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints. Only a local session, whose executors are this machine, may do without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file:///tmp/checkpoints"
    return named


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them again. They outlive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathomline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(_sweep)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    _made[path] = spark
    return out


def discard(*tables: DataFrame) -> None:
    """Removes saved tables from which everything has been made (and saved) that was to be made."""
    for df in tables:
        _remove(_made.pop(df.saved_at), df.saved_at)


#: Rows of one long column that may be broadcast: 16 MB of them.
SMALL = 1 << 20


def sized(rows: DataFrame) -> DataFrame:
    """A saved table of keys, marked for broadcast if it has no more than SMALL rows; a join with a larger one shuffles."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def pieces(batches, rows: int = 512):
    """Record batches in parts of a few rows, so that only so many are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def numbered(docs: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """(docs with a long column `row` that tells rows apart, (row, id) or None if `row` is the id itself).

    Ids that are unique and not null serve as they are. Else rows get numbers, in a table that keeps them if a task runs
    again, and the second frame leads back from the numbers to the ids.
    """
    ids = docs.select(F.col(id_column).cast("long").alias("row"))
    if ids.groupBy("row").count().where("count > 1 or row is null").isEmpty():
        return docs.withColumn("row", F.col(id_column).cast("long")), None
    docs = saved(docs.withColumn("row", F.monotonically_increasing_id()))
    return docs, docs.select("row", F.col(id_column).cast("long").alias(id_column))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path, spark in _made.items():
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone already; the folder is scratch space
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a filter of rows; 4 MB, whatever it holds.
_FILTER_BITS = 25


def row_filter(rows: DataFrame, key: str) -> np.ndarray:
    """Bits, by the hash of a row's key, of all keys that occur. A filter of fixed size: with more keys it lets more of
    the others through, and never holds one back that occurs."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << _FILTER_BITS)) + 1
    parts = rows.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(1 << _FILTER_BITS - 3, np.uint8)
    for at, bits in parts.collect():  # at most 2 ** (_FILTER_BITS - 15) rows of 4 KB
        out[(at - 1) << 12 : at << 12] = np.frombuffer(bits, np.uint8)
    return out


def squeezed(df: DataFrame, key: str = "doc_id", some: np.ndarray | None = None) -> DataFrame:
    """(key, text) with the text compressed, for shuffles of whole texts; only rows that a row_filter lets through, if one
    is given. Null texts stay null."""
    import zstandard

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in pieces(batches):
            if some is not None:
                slot = b.column("slot").to_numpy()
                b = b.filter(pa.array(some[slot >> 3] >> (slot & 7) & 1 == 1))
            texts = [None if t is None else pack(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column(key), pa.array(texts, pa.binary())], names=[key, "packed"])

    slot = [] if some is None else [F.pmod(F.xxhash64(key), F.lit(1 << _FILTER_BITS)).alias("slot")]
    return df.select(key, "text", *slot).mapInArrow(run, f"{key} long, packed binary")
