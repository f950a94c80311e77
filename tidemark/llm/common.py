"""Shared pieces of the corpus operators: shared-folder scratch tables, vectorised
text scanning over Arrow batches, word and byte hashes.

Everything here works on bounded slices of a batch (``CHUNK_BYTES`` of text, or one
document when that alone is longer), so a worker's memory does not depend on how many
rows Spark puts into a record batch.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
U = np.uint64

# --------------------------------------------------------------------------- scratch

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables, under ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder (tests); on a
    cluster that would scatter tables over the executors' own disks and is refused."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _roots[app] = f"{base.rstrip('/')}/tidemark-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, _roots[app])
    return _roots[app]


def _drop(spark: SparkSession, path: str) -> None:
    """Best effort: the folder may be gone, or the JVM stopped, by then."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001
        pass


#: Rows and bytes of a record batch while an operator writes a table.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python in small batches, so that neither side holds many at a time."""
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Scratch:
    """Intermediate Parquet tables in the shared folder.

    A written table cuts the lineage and survives the loss of any executor; ``drop``
    frees tables that nothing downstream reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        self.names: set[str] = set()

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        with small_batches(self.spark):
            df.write.options(**options).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """``df`` as a table; all others of this operator are dropped."""
        out = self.table(df, name, **options)
        self.drop(*(self.names - {name}))
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            _drop(self.spark, f"{self.root}/{name}")


def utf8_text(name: str = "text") -> Column:
    """A text column as bytes; null counts as empty."""
    return F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8").alias(name)


# ----------------------------------------------------------------------- text slices


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with at most ``limit`` bytes of text, or
    for one row if it alone has more. ``offsets`` has one entry more than there are rows."""
    col = batch.column(batch.schema.get_field_index(column))
    if not (pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_binary())
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(word: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of true bytes, none across rows."""
    n = len(word)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:n]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


# ----------------------------------------------------------------------------- hashes

BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Strings up to so many bytes are hashed together, eight bytes a turn; longer ones one by one.
LONG = 96
#: Strings of one length up to this are equal if their hashes are.
EXACT = 8
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as words (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def string_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes s..e. Every eight bytes go through a non-linear bijection
    of the state (strings of one length up to ``EXACT`` bytes never collide); strings over
    ``LONG`` bytes go through XXH3. Hashes of different seeds are independent."""
    n = e - s
    h = mix(n.astype(U) * U(BASE) + U(seed + 1))
    at, here = lanes(data), np.flatnonzero((n > 0) & (n <= LONG))
    place, left = s[here], n[here]
    while len(here):
        h[here] = mix((h[here] ^ (at[place] & _MASKS[np.minimum(left, 8)])) * U(0xD6E8FEB86659FD93))
        more = left > 8
        here, place, left = here[more], place[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[s[i] : e[i]], seed)
    return h


def same_strings(a: np.ndarray, s: np.ndarray, b: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes of ``a`` from s are the n bytes of ``b`` from t, for each n."""
    same = np.ones(len(n), bool)
    x, here = lanes(a), np.flatnonzero((n > 0) & (n <= LONG))
    y = x if b is a else lanes(b)
    p, q, left = s[here], t[here], n[here]
    while len(here):
        mask = _MASKS[np.minimum(left, 8)]
        equal = (x[p] & mask) == (y[q] & mask)
        same[here[~equal]] = False
        more = equal & (left > 8)
        here, p, q, left = here[more], p[more] + 8, q[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > LONG).tolist():
        same[i] = np.array_equal(a[s[i] : s[i] + n[i]], b[t[i] : t[i] + n[i]])
    return same


SHINGLE = 5
_ROLL = [U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(SHINGLE)]


class Shingles:
    """Where the word shingles of a slice's rows stand: every run of ``size`` words, or the
    whole sequence of a row with fewer words; a row without words has none."""

    def __init__(self, row: np.ndarray, n_rows: int, size: int = SHINGLE):
        self.size, self.n = size, len(row)
        first = np.searchsorted(row, np.arange(n_rows), "left")
        self.counts = np.searchsorted(row, np.arange(n_rows), "right") - first
        self.whole = row[: max(0, self.n - size + 1)] == row[size - 1 :] if self.n >= size else np.zeros(0, bool)
        self.short = np.flatnonzero((self.counts > 0) & (self.counts < size))
        self.first = first[self.short]
        self.row = np.concatenate([row[: len(self.whole)][self.whole], self.short]).astype(np.int64)

    def hashes(self, word_hash: np.ndarray) -> np.ndarray:
        """The shingles' hashes: a combination of the words' hashes with fixed odd factors, mixed."""
        v = np.zeros(len(self.whole), U)
        for k in range(self.size if len(v) else 0):
            v += word_hash[k : len(v) + k] * _ROLL[k % SHINGLE] + U(k)
        many = self.counts[self.short]
        extra = many.astype(U) * U(0xA24BAED4963EE407)
        for k in range(self.size - 1):
            has = many > k
            extra[has] += word_hash[self.first[has] + k] * _ROLL[k % SHINGLE] + U(k)
        return mix(np.concatenate([v[self.whole], extra]))

    def distinct(self, hashes: np.ndarray) -> np.ndarray:
        """Places of one shingle of each hash in its row, in order of row, then hash."""
        order = np.lexsort((hashes, self.row))
        keep = np.ones(len(order), bool)
        h, of = hashes[order], self.row[order]
        keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        return order[keep]


def text_shingles(data: np.ndarray, offs: np.ndarray, seeds: tuple[int, ...] = (0,), size: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(hashes..., rows) of the distinct word shingles of lower-cased (A-Z) text split at
    ASCII white space, in order of row, then of the first seed's hash; a column of
    independent hashes for each seed."""
    low = lower_ascii(data)
    s, e, row = word_bounds(~SPACE[low], offs)
    at = Shingles(row, len(offs) - 1, size)
    hashes = [at.hashes(string_hash(low, s, e, seed)) for seed in seeds]
    one = at.distinct(hashes[0])
    return *(h[one] for h in hashes), at.row[one]


def row_bounds(of: np.ndarray, n_rows: int) -> np.ndarray:
    return np.searchsorted(of, np.arange(n_rows + 1), "left")


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
