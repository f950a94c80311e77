"""Operator 5: token ids in binary shards with a minimal perfect hash index.

File format: a Parquet table of segments in ascending key order, or, shuffled, in the
order of the keys' hashes, which interleaves sources. A segment's ``ids`` are
the raw little-endian unsigned 32-bit ids of its documents, one after the other; its
``index`` is a minimal perfect hash over its keys (compress, hash, displace): for every
slot the key's 32-bit fingerprint, the first id and the number of ids. Looking a key up
takes two array reads in the segment whose range of keys (or hashes) holds it (the ranges
are columns, so readers skip other segments by Parquet's statistics); the fingerprint turns absent
keys down. ``keys`` lists the keys in order for sequential reads.

A document's key is its doc_id and, for the second and later rows with that doc_id, a
running number, so repeated rows keep their own ids.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, EXACT, U, lower_ascii, mix, same_strings, slices, small_batches, string_hash, utf8_text

#: Ids of a segment, from which the next one begins (1 MB); a longer document has one alone.
SEGMENT_IDS = 250_000
#: Encoded pieces that a worker remembers, in each of two generations (about 20 MB).
MEMORY = 600_000
SEGMENTS = "part int, segment int, first_key long, last_key long, n_docs int, n_ids long, start long, keys binary, ids binary, index binary"
DOCS = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"


# ------------------------------------------------------------------------- encoding


# Byte classes: white space, letter, digit, other ASCII sign, and what may combine with its neighbours.
BLANK, LETTER, DIGIT, SIGN, OPEN = range(5)
CLASS = np.full(256, OPEN, np.uint8)
CLASS[[0x20, 9, 10, 11, 12, 13]] = BLANK
CLASS[33:127] = SIGN
CLASS[48:58] = DIGIT
CLASS[65:91] = LETTER
CLASS[97:123] = LETTER
CLASS[39] = OPEN  # an apostrophe begins contractions


# The normaliser and the splitter that the fast path models.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Encodes texts as the library's tokenizer does, each distinct piece once.

    What is relied on: the tokenizer drops white space, splits between letters, single digits
    and runs of other signs, and no normalisation reaches over a border between two ASCII
    characters of different kinds. So a text's ids are those of its pieces, cut at white
    space and at such borders (apostrophes and all beyond ASCII are left joined to their
    neighbours). The tokenizer composes characters (NFC) before it lower-cases and the two do
    not commute, so only pieces that are all ASCII are lower-cased here; others keep their
    bytes. Pieces of ASCII letters go to the tokenizer's model directly, all others through
    the whole tokenizer. Texts that hold a special token's opening are encoded
    as a whole, and so is every text if the tokenizer's normaliser or splitter is not the
    one described. Pieces are found by a 64-bit hash and remembered with their bytes, in
    generations; bytes decide, so pieces whose hashes collide get their own ids."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        made_of = json.loads(self.tokenizer.to_str())
        self.known = (made_of["normalizer"], made_of["pre_tokenizer"], made_of["truncation"], made_of["padding"]) == (NORMALIZER, SPLITTER, None, None)
        self.model = self.tokenizer.model
        self.special = tuple({t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.memory = [NOTHING] * 3  # new, young, old

    def _encoded(self, pieces: list[bytes], plain: np.ndarray) -> list[list[int]]:
        tokenize = self.model.tokenize
        out = [[t.id for t in tokenize(p.decode())] if easy else None for p, easy in zip(pieces, plain.tolist(), strict=True)]
        hard = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(hard, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in hard], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(starts, ends, rows, bytes with ASCII pieces in lower case, running number of ASCII letters)."""
        low = lower_ascii(data)
        kind = CLASS[low]
        start = kind != BLANK
        if len(kind):
            start[1:] &= (kind[:-1] == BLANK) | ((kind[1:] != kind[:-1]) & (kind[1:] != OPEN) & (kind[:-1] != OPEN)) | ((kind[1:] == DIGIT) & (kind[:-1] == DIGIT))
            edge = offs[:-1][offs[:-1] < offs[1:]]
            start[edge] = kind[edge] != BLANK
        s = np.flatnonzero(start)
        row = np.searchsorted(offs, s, "right") - 1
        blank = np.append(np.flatnonzero(kind == BLANK), len(kind))
        e = np.minimum(np.append(s[1:], len(kind)), blank[np.searchsorted(blank, s)]) if len(s) else s
        e = np.minimum(e, offs[row + 1])
        beyond = np.append(0, np.cumsum(data >= 128))
        mixed = np.flatnonzero(beyond[e] > beyond[s])
        at = _ranges(s[mixed], e[mixed] - s[mixed])
        low[at] = data[at]
        return s, e, row, low, np.append(0, np.cumsum(kind == LETTER))

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a slice, each with the end id, and the texts' counts."""
        n = len(offs) - 1
        if not self.known:
            return self._whole(data, offs)
        s, e, row, low, letters = self.pieces(data, offs)
        h, first, inverse = np.unique(string_hash(low, s, e), return_index=True, return_inverse=True)
        size, model = e - s, first[inverse]
        odd = size != size[model]
        doubt = np.flatnonzero(~odd & (size > EXACT))
        odd[doubt] = ~same_strings(low, s[doubt], low, s[model[doubt]], size[doubt])
        if odd.any():  # pieces that share a hash with another one: each gets a number of its own
            at = np.flatnonzero(odd)
            number: dict[bytes, int] = {}
            for i in at.tolist():
                inverse[i] = len(h) + number.setdefault(low[s[i] : e[i]].tobytes(), len(number))
            first = np.append(first, [at[np.argmax(inverse[at] == len(h) + k)] for k in range(len(number))])
        known = np.arange(len(first)) < len(h)
        h = np.append(h, np.zeros(len(first) - len(h), U))
        a, b = s[first], e[first]
        places = [_found(m, h, low, a, b, known) for m in self.memory]
        size = np.zeros(len(h), np.int64)
        for memory, (at, _) in zip(self.memory[::-1], places[::-1], strict=True):
            has = at >= 0
            size[has] = memory[2][at[has]]
        new = np.flatnonzero(np.maximum.reduce([at for at, _ in places]) < 0)
        raw = low.tobytes()
        fresh = self._encoded([raw[i:j] for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True)], letters[b[new]] - letters[a[new]] == b[new] - a[new])
        size[new] = [len(x) for x in fresh]
        bounds = np.append(0, np.cumsum(size))
        pool = np.empty(bounds[-1], "<u4")
        for memory, (at, _) in zip(self.memory[::-1], places[::-1], strict=True):
            has = np.flatnonzero(at >= 0)
            pool[_ranges(bounds[has], size[has])] = memory[3][_ranges(memory[1][at[has]], size[has])]
        if len(new):
            pool[_ranges(bounds[new], size[new])] = np.fromiter((t for x in fresh for t in x), np.uint32)
        late = np.flatnonzero((np.maximum(places[0][0], places[1][0]) < 0) & known & ~places[0][1] & ~places[1][1])
        n_ids, n_bytes = size[late], b[late] - a[late]
        self._remember((h[late], np.cumsum(n_ids) - n_ids, n_ids, pool[_ranges(bounds[late], n_ids)], np.cumsum(n_bytes) - n_bytes, n_bytes, low[_ranges(a[late], n_bytes)]))
        many = size[inverse]
        per = np.bincount(row, many, n).astype(np.int64)
        out = np.full(per.sum() + n, self.end, "<u4")
        out[_ranges(np.append(0, np.cumsum(many))[:-1] + row, many)] = pool[_ranges(bounds[:-1][inverse], many)]
        return self._with_specials(data, offs, out, per + 1)

    def _whole(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[x:y].decode() for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        parts = [[*e.ids, self.end] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([t for p in parts for t in p], "<u4"), np.array([len(p) for p in parts], np.int64)

    def _with_specials(self, data: np.ndarray, offs: np.ndarray, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if not any(x in raw for x in self.special):
            return ids, count
        at = np.append(0, np.cumsum(count))
        parts = []
        for i, (x, y) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            part = ids[at[i] : at[i + 1]]
            if any(t in raw[x:y] for t in self.special):
                part = np.array([*self.tokenizer.encode(raw[x:y].decode(), add_special_tokens=False).ids, self.end], "<u4")
            parts.append(part)
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def _remember(self, more: tuple[np.ndarray, ...]) -> None:
        """Adds pieces to the new ones; those are merged into the young ones when they are
        many, and the young ones become the old ones when they are full."""
        new, young, old = self.memory
        new = _merged(new, more)
        if len(new[0]) > MEMORY // 12:
            new, young = NOTHING, _merged(young, new)
            if len(young[0]) > MEMORY:
                young, old = NOTHING, young
        self.memory = [new, young, old]


#: Remembered pieces in order of hash: hashes; starts, numbers and a pool of ids; the same of bytes.
_none = np.zeros(0, np.int64)
NOTHING = (np.zeros(0, U), _none, _none, np.zeros(0, "<u4"), _none, _none, np.zeros(0, np.uint8))
_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """This process's encoder: what it remembers serves all tasks of a worker."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _found(memory: tuple[np.ndarray, ...], h: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pieces low[a:b] in ``memory`` (-1: not there), and whether another
    piece with the same hash is there."""
    if not len(memory[0]):
        return np.full(len(h), -1), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(memory[0], h), len(memory[0]) - 1)
    hit = np.flatnonzero((memory[0][at] == h) & known)
    there, size = memory[4][at[hit]], (b - a)[hit]
    same = memory[5][at[hit]] == size
    doubt = np.flatnonzero(same & (size > EXACT))
    if len(doubt):
        n = size[doubt]
        same[doubt] = np.logical_and.reduceat(low[_ranges(a[hit][doubt], n)] == memory[6][_ranges(there[doubt], n)], np.cumsum(n) - n)
    out, clash = np.full(len(h), -1), np.zeros(len(h), bool)
    out[hit[same]], clash[hit[~same]] = at[hit[same]], True
    return out, clash


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two sorted tables of remembered pieces as one; pools are only appended."""
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    out = [np.concatenate([a[0], b[0]])[order]]
    for start, size, pool in ((1, 2, 3), (4, 5, 6)):
        out += [np.concatenate([a[start], len(a[pool]) + b[start]])[order], np.concatenate([a[size], b[size]])[order], np.concatenate([a[pool], b[pool]])]
    return tuple(out)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each range, one after the other."""
    if not len(size):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - ends + size, size)


# ------------------------------------------------------------- minimal perfect hash


def key_hashes(keys: np.ndarray, copies: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """Bucket, position, step and fingerprint hashes of (key, running number)."""
    x = mix(keys.astype(np.int64).view(U) ^ mix(copies.astype(U) * U(BASE) + U(seed)))
    return mix(x + U(1)), mix(x + U(2)), mix(x + U(3)), (mix(x + U(4)) >> U(32)).astype(np.uint32)


def build_index(keys: np.ndarray, copies: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """Index of distinct (key, running number) pairs."""
    n = len(keys)
    r = max(1, n // 4)
    for seed in range(1 << 16):
        h1, h2, h3, fp = key_hashes(keys, copies, seed)
        bucket = (h1 % U(r)).astype(np.int64)
        pos, step = (h2 % U(n)).astype(np.int64), (h3 % U(max(1, n - 1))).astype(np.int64) + 1
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(r + 1))
        sizes = bounds[1:] - bounds[:-1]
        taken = np.zeros(n, bool)
        slot = np.zeros(n, np.int64)
        d0, d1 = np.zeros(r, np.uint32), np.zeros(r, np.uint32)
        free = None
        done = True
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[bounds[b] : bounds[b + 1]]
            if not len(mine):
                break
            if len(mine) == 1:
                free = iter(np.flatnonzero(~taken)) if free is None else free
                at = int(next(free))
                d1[b] = (at - pos[mine[0]]) % n
                slot[mine[0]] = at
                continue
            for t in range(0, 64 * (n + 64), 64):
                u = np.arange(t, t + 64)
                a0, a1 = u // n, u % n
                if a0[0] >= n:
                    t = -1
                    break
                at = (pos[mine][None, :] + a0[:, None] * step[mine][None, :] + a1[:, None]) % n
                ok = ~taken[at].any(axis=1) & (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1) & (a0 < n)
                if ok.any():
                    w = int(np.argmax(ok))
                    d0[b], d1[b] = a0[w], a1[w]
                    taken[at[w]] = True
                    slot[mine] = at[w]
                    break
            else:
                t = -1
            if t < 0:
                done = False
                break
        if done:
            break
    else:
        raise ValueError("no perfect hash: keys repeat")
    f, o, c = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u4")
    f[slot], o[slot], c[slot] = fp, first, count
    return struct.pack("<III", seed, n, r) + b"".join(x.tobytes() for x in (d0.astype("<u4"), d1.astype("<u4"), f, o, c))


def look_up(index: bytes, keys: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First id and number of ids of each key; -1 and 0 for keys that the fingerprint denies."""
    seed, n, r = struct.unpack_from("<III", index)
    parts, at = [], 12
    for kind, m in (("<u4", r), ("<u4", r), ("<u4", n), ("<u8", n), ("<u4", n)):
        parts.append(np.frombuffer(index, kind, m, at))
        at += parts[-1].nbytes
    d0, d1, f, o, c = parts
    h1, h2, h3, fp = key_hashes(keys, copies, seed)
    b = (h1 % U(r)).astype(np.int64)
    slot = ((h2 % U(n)).astype(np.int64) + d0[b].astype(np.int64) * ((h3 % U(max(1, n - 1))).astype(np.int64) + 1) + d1[b]) % n
    here = f[slot] == fp
    return np.where(here, o[slot].astype(np.int64), -1), np.where(here, c[slot].astype(np.int64), 0)


# ------------------------------------------------------------------- write and read

#: Stands for a null doc_id among the keys.
NULL_KEY = -(1 << 63)


def place(key: Column, shuffled: bool) -> Column:
    """What files are ordered by: the key (null first) or its hash."""
    return F.xxhash64(key) if shuffled else F.coalesce(key, F.lit(NULL_KEY))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shuffled: bool = False) -> None:
    """Encode ``docs(doc_id, text)`` and write segments to ``path`` in ascending doc_id
    order (null first; rows with equal doc_id by text), or ``shuffled`` by the doc_id's hash.
    Null texts count as empty and have the end id alone. Other columns are not read. An
    empty table gives no segments."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, end_id)
        part = TaskContext.get().partitionId()
        keys: list[int] = []
        places: list[int] = []
        copies: list[int] = []
        blobs: list[bytes] = []
        count = start = segment = 0
        last: tuple[int, int] | None = None

        def flush() -> pa.RecordBatch:
            k, c = np.array(keys, np.int64), np.array(copies, np.int64)
            size = np.array([len(b) // 4 for b in blobs], np.int64)
            row = [part, segment, places[0], places[-1], len(keys), count, start, k.astype("<i8").tobytes() + c.astype("<u4").tobytes(), b"".join(blobs), build_index(k, c, np.cumsum(size) - size, size)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in SEGMENTS.split(", ")])

        for batch in batches:
            for rows, data, offs in slices(batch):
                ids, many = coder.ids(data, offs)
                ids, cut = memoryview(ids.tobytes()), np.append(0, np.cumsum(many) * 4).tolist()
                for key, at, a, b in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), cut[:-1], cut[1:], strict=True):
                    blob = ids[a:b]
                    key = NULL_KEY if key is None else key
                    copy = last[1] + 1 if last and last[0] == key else 0
                    last = key, copy
                    keys.append(key)
                    places.append(at)
                    copies.append(copy)
                    blobs.append(blob)
                    count += len(blob) // 4
                    if count >= SEGMENT_IDS:
                        yield flush()
                        start, segment, count = start + count, segment + 1, 0
                        keys, places, copies, blobs = [], [], [], []
        if keys:
            yield flush()

    key = F.col("doc_id").cast("long")
    text = docs.select(key.alias("doc_id"), utf8_text(), place(key, shuffled).alias("place"))
    ordered = text.repartitionByRange("place").sortWithinPartitions("place", F.col("doc_id").asc_nulls_first(), "text")
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(pack, SEGMENTS).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files at ``path``,
    each found through its segment's index; ``start``: the ids of all documents before."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, n, keys, ids, index in zip(*(batch.column(i) for i in range(6)), strict=True):
                n, raw, ids = n.as_py(), keys.as_py(), memoryview(ids.as_buffer())
                key, copy = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u4", n, 8 * n)
                first, count = look_up(index.as_py(), key, copy)
                if (first < 0).any():
                    raise ValueError("a key is missing in its segment's index")
                crc = [zlib.crc32(ids[4 * f : 4 * (f + c)]) for f, c in zip(first.tolist(), count.tolist(), strict=True)]
                yield pa.record_batch([pa.array(key, mask=key == NULL_KEY), pa.array(np.full(n, part.as_py(), np.int32)), pa.array(start.as_py() + first), pa.array(count), pa.array(crc, pa.int64())], names=[c.split()[0] for c in DOCS.split(", ")])

    seg = segments(spark, path)
    totals = seg.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per shard
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = seg.select("part", "start", "n_docs", "keys", "ids", "index").mapInArrow(unpack, DOCS)
    return rows.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def ids_of(spark: SparkSession, path: str, doc_id: int | None, copy: int = 0, shuffled: bool = False) -> list[int] | None:
    """The ids of one document by key, or None; reads only the segments whose range holds it."""
    key = NULL_KEY if doc_id is None else doc_id
    at = place(F.lit(doc_id).cast("long"), shuffled)
    for row in segments(spark, path).where((F.col("first_key") <= at) & (F.col("last_key") >= at)).select("ids", "index").toLocalIterator():
        first, count = look_up(bytes(row["index"]), np.array([key]), np.array([copy]))
        if first[0] >= 0:
            return np.frombuffer(row["ids"], "<u4", int(count[0]), 4 * int(first[0])).tolist()
    return None
