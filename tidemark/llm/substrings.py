"""Operator 10: removal of repeated 50-byte strings by hash-compared suffix sorting.

Suffixes are sorted where strings can repeat, not everywhere. In every window of
``WINDOW`` bytes the ``ANCHOR``-byte string with the smallest hash is its anchor, so equal
windows have equal anchors at the same place; one anchor serves a run of windows, and the
run with all its bytes is the anchor's context (at most 80 bytes).

1. Texts that a smaller doc_id has too as a whole are found by their SHA-256; they go, and
   take no further part.
2. Every other document gives its anchors with hashes of their contexts. Dealt by anchor
   and sorted, they show which contexts a smaller doc_id has too (covered as a whole) and
   which first contexts stand beside different ones of the same anchor. A context that a
   task has met before under a smaller doc_id is decided there: it travels, but by its
   document, so an anchor that very many documents share is no one task's work.
3. The first contexts' bytes are dealt by anchor, or, if an anchor has more than ``GROUP``,
   window by window. Their windows are suffixes of a block's text: a mergesort orders them,
   comparing two suffixes by the longest common extension, which prefix polynomial hashes
   and a binary search give in six probes. Neighbours that agree in 50 bytes are verified
   byte by byte; the smallest doc_id of a run of equal suffixes decides. A window that a
   task has met before (verified byte by byte as well) is decided there.
4. Documents meet what was found, cut the covered bytes and hash the rest.

The texts are exchanged once, by doc_id, for all steps. Every step streams sorted rows in
bounded blocks, so no group is held in memory as a whole; long texts are worked through
piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, CHUNK_BYTES, U, as_long, mix, slices, string_hash, utf8_text

WINDOW, ANCHOR = 50, 20
SPAN = WINDOW - ANCHOR + 1
#: Rows that are handled together; first contexts of one anchor up to which they are dealt together.
BLOCK, GROUP = 16_384, 2_048
#: Starts of windows that are worked through at a time (at least a slice of several texts).
PIECE = CHUNK_BYTES
#: Strings that a task remembers to decide on later ones: contexts (24 bytes each), windows (66 bytes each).
SEEN_CONTEXTS, SEEN_WINDOWS = 1 << 19, 1 << 16
#: Whole texts with the most copies, which are sent to all executors (50 KB) as their copies may be a third of all rows.
HOT = 1_000
NO_ID = (1 << 63) - 1
PLACE = U((1 << 28) - 1)
#: The windows of a context as bits; all of them.
WHOLE = -1
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, _INVERSE)):
            p = np.full(max(n, PIECE + WINDOW + 1), b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j]-h[i] == sum of (byte+1)*BASE**position over i <= position < j."""
    p, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[:-1], out=h[1:])
    return h


def anchors(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, anchor place, first window, last window, row) of each run of windows
    with the same anchor, piece by piece. Ties go to the leftmost place. Only a text that
    is alone in its slice has several pieces, so a text's runs are always the same."""
    for p in range(0, max(0, len(data) - WINDOW + 1), PIECE):
        part = data[p : p + PIECE + WINDOW - 1]
        h = prefix_hash(part)
        _, inv = powers(len(h))
        v = h[ANCHOR:] - h[:-ANCHOR]
        v *= inv[: len(v)]
        v ^= v >> U(32)
        v *= U(0x94D049BB133111EB)
        m = v & ~PLACE
        m |= np.arange(len(v), dtype=U)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])  # after it, the least of 2 * step places
        n = len(part) - WINDOW + 1
        m = np.minimum(m[:n], m[SPAN - 16 :][:n])
        ends = np.repeat(offs[1:], np.diff(np.clip(offs, p, p + n)))  # of the texts that the windows start in
        starts = np.flatnonzero(np.arange(p + WINDOW, p + WINDOW + n) <= ends)
        if not len(starts):
            continue
        at = (m[starts] & PLACE).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = at[1:] != at[:-1]  # anchors of two texts differ in place
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        begin = starts[first] + p
        yield v[at[first]], at[first] + p, begin, starts[last] + p, np.searchsorted(offs, begin, "right") - 1


def context_hash(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """48 bits, used beside the 64 of the anchor; shorter values travel better."""
    return mix(string_hash(data, first, last + WINDOW, 2) + (at - first).astype(U)) >> U(16)


class Seen:
    """The smallest ids of strings that a task has met, in a table of bounded size in which
    a string has one place (so what returns often is there). Strings are known by two
    hashes and, with ``width``, by their bytes."""

    def __init__(self, slots: int, width: int = 0):
        self.a, self.b, self.id = np.zeros(slots, U), np.zeros(slots, U), np.full(slots, NO_ID)
        self.bytes = np.zeros((slots, width), np.uint8)

    def decided(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, text: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Of strings (a, b): an order of them; in it, which ones a smaller id has too, here
        or earlier in the task, and which repeat string and id of the one before."""
        order = np.argsort(mix(a + mix(b)), kind="stable")
        x, y, d = a[order], b[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(d, first) if len(d) else d
        slot = ((x[first] ^ y[first]) % U(len(self.id))).astype(np.int64)
        known = (self.a[slot] == x[first]) & (self.b[slot] == y[first]) & (self.id[slot] < NO_ID)
        before = np.where(known, self.id[slot], NO_ID)
        out = d > np.minimum(least, before)[group]
        if text is not None:
            t = text[order]
            inside = (t == t[first][group]).all(1)
            of_first = np.where(inside, d, NO_ID)
            earlier = (t == self.bytes[slot][group]).all(1)
            out = (inside & (d > np.minimum.reduceat(of_first, first)[group])) | (earlier & (d > before[group]))
        repeat = ~new
        repeat[1:] &= d[1:] == d[:-1]
        if text is not None:
            least = np.minimum.reduceat(of_first, first) if len(d) else d
        put = least < before
        self.a[slot[put]], self.b[slot[put]], self.id[slot[put]] = x[first][put], y[first][put], least[put]
        if text is not None:
            self.bytes[slot[put]] = t[first][put]
        return order, out, repeat


def once(*keys: np.ndarray) -> np.ndarray:
    """Places of the first of equal rows, in sorted order."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order[new]


ASKED = "anchor long, id long, context long"
VERDICTS = "id long, kind byte, context long"
COVERED, SORT, DEAL = 0, 1, 2
#: Added to a context that is covered for certain; such rows are dealt by document.
SURE = 1 << 62


def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, in documents: anchors with their contexts, each once."""
    seen = Seen(SEEN_CONTEXTS)
    for batch in batches:
        for rows, data, offs in slices(batch):
            ids = rows.column(0).to_numpy()
            for v, at, first, last, row in anchors(data, offs):
                c = context_hash(data, at, first, last)
                order, sure, repeat = seen.decided(v, c, ids[row])
                order, sure = order[~repeat], sure[~repeat]
                v, c, d = v[order], c[order], ids[row][order]
                key = np.where(sure, mix(d.view(U)), v)
                yield pa.record_batch([pa.array(as_long(key)), pa.array(d), pa.array(as_long(c) + np.where(sure, SURE, 0))], names=["anchor", "id", "context"])


def by_key(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Runs of rows in which no key (column 0, sorted) is broken off, or, of a key with
    more than twice ``size`` rows, parts; and whether the last key has no more rows."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            rows = pa.Table.from_batches([held, part] if held is not None else [part]).combine_chunks().to_batches()[0]
            a = rows.column(0).to_numpy()
            cut = int(np.searchsorted(a, a[-1], "left"))  # where the last key begins
            if cut and len(a) >= size // 2:
                yield rows.slice(0, cut), True
                held = rows.slice(cut)
            elif not cut and len(a) > 2 * size:
                yield rows, False
                held = None
            else:
                held = rows
    if held is not None and held.num_rows:
        yield held, True


def judge(batches: Iterator[pa.RecordBatch], size: int, group: int) -> Iterator[pa.RecordBatch]:
    """Step 2, over rows sorted by (anchor, context, id)."""
    last: tuple[int, int, int] | None = None  # anchor and context of the last row, and the context's smallest id
    wide: int | None = None  # an anchor of several blocks
    for rows, ended in by_key(batches, size):
        a, d, c = (rows.column(i).to_numpy() for i in range(3))
        sure = c >= SURE
        if sure.any():
            yield pa.record_batch([pa.array(d[sure]), pa.array(np.full(int(sure.sum()), COVERED, np.int8)), pa.array(c[sure] - SURE)], names=["id", "kind", "context"])
            a, d, c = a[~sure], d[~sure], c[~sure]
            if not len(a):
                continue
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        if last and last[:2] == (int(a[0]), int(c[0])):
            new[0] = False
        first = np.flatnonzero(new)
        low = np.append(d[first], last[2] if last else 0)[np.cumsum(new) - 1]
        begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        count = np.add.reduceat(new, begin)
        many = count > group
        several = count > 1
        if wide == int(a[0]):
            several[0] = many[0] = True
        if not ended:
            several[-1] = many[-1] = True
            wide = int(a[-1])
        which = np.searchsorted(begin, first, "right") - 1
        later = np.flatnonzero(d > low)
        ask_for = first[several[which]]
        kind = np.where(many[which], DEAL, SORT)[several[which]]
        last = int(a[-1]), int(c[-1]), int(low[-1])
        yield pa.record_batch(
            [pa.array(np.append(d[later], d[ask_for])), pa.array(np.append(np.full(len(later), COVERED), kind).astype(np.int8)), pa.array(np.append(c[later], c[ask_for]))], names=["id", "kind", "context"]
        )


DEALT = "key long, id long, context long, bytes binary"
MASKS = "id long, context long, windows long"
#: The first byte of a row's bytes: the anchor's place in a context; or, plus this, the step of a
#: single window; or the step of a window that is covered for certain.
SINGLE, CERTAIN = 64, 128


def listed(column: pa.Array, n_rows: int) -> tuple[np.ndarray, ...]:
    """(row, fields...) of a column of arrays of structs."""
    size = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    return np.repeat(np.arange(n_rows), size), *(flat.field(i).to_numpy() for i in range(flat.type.num_fields))


def binary(parts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(parts)])


def cut_out(data: np.ndarray, tag: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """For each row its tag and ``size`` bytes from ``start``."""
    ends = np.cumsum(size + 1)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size + 1)
    text = data[np.maximum(where, 0)]
    text[ends - size - 1] = tag
    return binary(text, ends)


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, in documents: for SORT, the anchor with place and bytes of the context; for
    DEAL, every window's hash with the window's step and bytes."""
    seen = Seen(SEEN_WINDOWS, WINDOW)
    names = ["key", "id", "context", "bytes"]
    for batch in batches:
        for rows, data, offs in slices(batch):
            of, kind, name = listed(rows.column(2), rows.num_rows)
            if not len(of):
                continue
            ids = rows.column(0).to_numpy()
            asked = {k: mix(name[kind == k].view(U) + mix(of[kind == k].astype(U))) for k in (SORT, DEAL)}
            for v, at, first, last, row in anchors(data, offs):
                c = context_hash(data, at, first, last)
                own = mix(c + mix(row.astype(U)))
                for k in (SORT, DEAL):
                    if not len(asked[k]):
                        continue
                    keep = np.flatnonzero(np.isin(own, asked[k]))
                    keep = keep[once(row[keep], c[keep])]
                    if not len(keep):
                        continue
                    f, l, d, own_c = first[keep], last[keep], ids[row[keep]], as_long(c[keep])
                    if k == SORT:
                        yield pa.record_batch([pa.array(as_long(v[keep])), pa.array(d), pa.array(own_c), cut_out(data, at[keep] - f, f, l + WINDOW - f)], names=names)
                        continue
                    n = l - f + 1
                    which = np.repeat(np.arange(len(keep)), n)
                    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    w = f[which] + step
                    text = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[w]
                    key = string_hash(data, w, w + WINDOW)
                    order, sure, _ = seen.decided(key, np.zeros(len(key), U), d[which], text)
                    which, step, w, key = which[order], step[order], w[order], key[order]
                    key = np.where(sure, mix(d[which].view(U) + key), key)
                    yield pa.record_batch([pa.array(as_long(key)), pa.array(d[which]), pa.array(own_c[which]), cut_out(data, np.where(sure, CERTAIN, SINGLE) + step, w, np.where(sure, 0, WINDOW))], names=names)


class Suffixes:
    """Suffixes of a block of text, compared in their first ``WINDOW`` bytes."""

    def __init__(self, text: np.ndarray):
        self.text, self.h = text, prefix_hash(text)
        self.inv = powers(len(self.h))[1]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common extension, WINDOW at most: a binary search."""
        size = np.zeros(len(x), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            to = np.minimum(size + step, WINDOW)
            same = (self.h[x + to] - self.h[x]) * self.inv[x] == (self.h[y + to] - self.h[y]) * self.inv[y]
            size = np.where(same, to, size)
        return size

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether x's suffix comes before y's; whether they are equal."""
        n = self.common(x, y)
        equal = n >= WINDOW
        n = np.minimum(n, WINDOW - 1)
        return ~equal & (self.text[x + n] < self.text[y + n]), equal

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes at ``at`` by (group, suffix): a bottom-up mergesort in
        which every element finds its rank in the neighbouring run by binary search, all
        elements and groups together."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        base = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
        size = np.diff(np.append(base, len(g)))
        base, size = np.repeat(base, size), np.repeat(size, size)
        local = np.arange(len(g)) - base
        width = 1
        while width < (size.max() if len(size) else 0):
            busy = np.flatnonzero(size > width)
            b, n, i = base[busy], size[busy], local[busy]
            run = i // width
            other = np.minimum((run ^ 1) * width, n)
            low, high = other.copy(), np.minimum(other + width, n)
            right = (run & 1) == 1
            p = at[order[busy]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                q = at[order[b[open_] + mid]]
                before, equal = self.less(q, p[open_])
                up = before | (equal & right[open_])  # equal ones keep the left run's first
                low[open_] = np.where(up, mid + 1, low[open_])
                high[open_] = np.where(up, high[open_], mid)
            place = b + (run // 2) * 2 * width + (i - run * width) + (low - other)
            new = order.copy()
            new[place] = order[busy]
            order = new
            width *= 2
        return order

    def runs(self, at: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Whether each suffix in ``order`` begins a new run of equal ones, verified."""
        new = np.ones(len(order), bool)
        x, y = at[order[:-1]], at[order[1:]]
        same = (group[order[1:]] == group[order[:-1]]) & (self.common(x, y) >= WINDOW)
        hit = np.flatnonzero(same)
        step = np.arange(WINDOW)
        for i in range(0, len(hit), 1 << 15):
            k = hit[i : i + (1 << 15)]
            same[k] = (self.text[x[k][:, None] + step] == self.text[y[k][:, None] + step]).all(1)
        new[1:] = ~same
        return new


def masks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Step 3, over rows sorted by (key, id): which windows of a context a smaller doc_id has
    too, as bits. Of a key with several blocks of rows, the first row of every window met so
    far goes into the next block."""
    before: pa.RecordBatch | None = None
    for rows, _ in by_key(batches, size):
        tag = tags(rows)
        sure = np.flatnonzero(tag >= CERTAIN)
        if len(sure):
            yield pa.record_batch([rows.column(1).take(pa.array(sure)), rows.column(2).take(pa.array(sure)), pa.array(np.int64(1) << (tag[sure] - CERTAIN))], names=["id", "context", "windows"])
            rows = rows.take(pa.array(np.flatnonzero(tag < CERTAIN)))
            if not rows.num_rows:
                continue
        if before is not None and before.num_rows and before.column(0)[0] == rows.column(0)[0]:
            rows = pa.Table.from_batches([before, rows]).combine_chunks().to_batches()[0]
        found, first = sort_block(rows)
        last = rows.column(0).to_numpy()
        before = rows.take(pa.array(first[last[first] == last[-1]]))
        if found.num_rows:
            yield found


def byte_rows(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = rows.column(3)
    offs = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset).astype(np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def tags(rows: pa.RecordBatch) -> np.ndarray:
    data, offs = byte_rows(rows)
    return data[offs[:-1]].astype(np.int64)


def sort_block(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The bits of the rows' windows, and the rows of single windows that begin a run."""
    key, d = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    data, offs = byte_rows(rows)
    tag, start, end = data[offs[:-1]].astype(np.int64), offs[:-1] + 1, offs[1:]
    alone = tag >= SINGLE
    n = end - start - WINDOW + 1
    which = np.repeat(np.arange(len(key)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = start[which] + step
    group = (np.cumsum(np.append(True, key[1:] != key[:-1])) - 1)[which] * 64 + np.where(alone, 0, tag)[which] - step + 32
    s = Suffixes(data)
    order = s.sort(at, group)
    begin = np.flatnonzero(s.runs(at, group, order))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(d[which][order], begin), np.diff(np.append(begin, len(order))))
    step += np.where(alone, tag - SINGLE, 0)[which]
    bits = np.bincount(which, np.where(least < d[which], 2.0 ** step.astype(float), 0), len(key)).astype(np.int64)
    hit = pa.array(np.flatnonzero(bits))
    first = which[order[begin]]  # the sort is stable and rows come by id: the smallest id's
    return pa.record_batch([rows.column(1).take(hit), rows.column(2).take(hit), pa.array(bits[bits != 0])], names=["id", "context", "windows"]), np.sort(first[alone[first]])


def cover(data: np.ndarray, offs: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
    """Which bytes of a slice are covered (step 4). Columns: id, text, whether the text is a
    copy, verdicts, masks."""
    of, kind, con = listed(rows.column(3), rows.num_rows)
    of2, con2, win2 = listed(rows.column(4), rows.num_rows)
    whole = kind == COVERED
    of, con, win = np.append(of[whole], of2), np.append(con[whole], con2), np.append(np.full(int(whole.sum()), WHOLE), win2)
    edge = np.zeros(len(data) + 1, np.int32)
    copy = np.flatnonzero(np.asarray(rows.column(2).fill_null(False)) & (offs[1:] - offs[:-1] >= WINDOW))
    np.add.at(edge, offs[:-1][copy], 1)
    np.add.at(edge, offs[1:][copy], -1)
    if not len(of):
        return np.cumsum(edge[:-1]) > 0
    name = mix(con.view(U) + mix(of.astype(U)))
    order = np.argsort(name)
    name, win = name[order], win[order]
    begin = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    win, name = np.bitwise_or.reduceat(win, begin), name[begin]
    for _, at, first, last, row in anchors(data, offs):
        own = mix(context_hash(data, at, first, last) + mix(row.astype(U)))
        place = np.minimum(np.searchsorted(name, own), len(name) - 1)
        hit = np.flatnonzero(name[place] == own)
        mask = win[place[hit]]
        whole = hit[mask == WHOLE]
        np.add.at(edge, first[whole], 1)
        np.add.at(edge, last[whole] + WINDOW, -1)
        hit, mask = hit[mask != WHOLE], mask[mask != WHOLE]
        for j in range(SPAN):
            f = first[hit[(mask >> j) & 1 == 1]] + j
            np.add.at(edge, f, 1)
            np.add.at(edge, f + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def doc_ids(rows: pa.RecordBatch) -> pa.Array:
    id_ = rows.column(0).to_numpy()
    return pa.array(id_, mask=id_ == NO_ID)


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: counts and hash of what is left."""
    for batch in batches:
        for rows, data, offs in slices(batch):
            gone = cover(data, offs, rows)
            total = np.append(0, np.cumsum(gone))
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inside = offs[:-1][offs[:-1] < offs[1:]]
            begins[inside] = gone[inside]
            spans = np.append(0, np.cumsum(begins))
            left = []
            for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                left.append(hashlib.sha256((data[s:e] if total[e] == total[s] else data[s:e][~gone[s:e]]).tobytes()).hexdigest())
            yield pa.record_batch([doc_ids(rows), pa.array(offs[1:] - offs[:-1]), pa.array(total[offs[1:]] - total[offs[:-1]]), pa.array(spans[offs[1:]] - spans[offs[:-1]]), pa.array(left)], names=[x.split()[0] for x in RESULT.split(", ")])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4 for those who want the bytes that are left."""
    for batch in batches:
        for rows, data, offs in slices(batch):
            gone = cover(data, offs, rows)
            left = [data[s:e][~gone[s:e]].tobytes() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.record_batch([doc_ids(rows), pa.array(left, pa.binary())], names=["doc_id", "kept"])


def repeated_strings(docs: DataFrame, bytes_left: bool = False, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 (or doc_id, kept with ``bytes_left``).

    Removed is each byte of the UTF-8 text covered by a 50-byte string that also starts in
    a row with a smaller doc_id, judged on the input. Null texts count as empty; texts
    under 50 bytes lose nothing. Rows that share a doc_id do not cover each other; null
    doc_ids count as the largest. Other columns are not read."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), utf8_text())
    marks = keyed.select("id", F.unhex(F.sha2("text", 256)).alias("h"))
    first = marks.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("most"), F.count("*").alias("n")).where("first < most")
    hot = F.broadcast(first.orderBy(F.desc("n"), "h").limit(HOT).select("h", F.col("first").alias("known")))
    marks = marks.join(hot, "h", "left")  # what is known needs no partner: dealt by id
    marks = marks.select("id", "known", F.when(F.col("known").isNull(), F.col("h")).otherwise(F.col("id").cast("string").cast("binary")).alias("h"))
    copy = F.coalesce(F.col("known") < F.col("id"), F.col("first") < F.col("id"), F.lit(False))
    copies = marks.join(first.select("h", "first"), "h", "left").groupBy("id").agg(F.min(copy).alias("copy")).where("copy")
    rows = keyed.join(copies, "id", "left")
    asked = rows.where("copy is null").select("id", "text").mapInArrow(ask, ASKED).repartition("anchor").sortWithinPartitions("anchor", "context", "id")
    verdicts = asked.mapInArrow(lambda batches: judge(batches, block, group), VERDICTS).groupBy("id").agg(F.collect_list(F.struct("kind", "context")).alias("verdicts"))
    wanted = F.filter("verdicts", lambda x: x["kind"] > F.lit(COVERED))
    met = keyed.join(verdicts, "id").select("id", "text", wanted.alias("wanted")).where(F.size("wanted") > 0)
    dealt = met.mapInArrow(contexts, DEALT).repartition("key").sortWithinPartitions("key", "id")
    found = dealt.mapInArrow(lambda batches: masks(batches, block), MASKS).groupBy("id").agg(F.collect_list(F.struct("context", "windows")).alias("masks"))
    rows = rows.join(verdicts, "id", "left").join(found, "id", "left").select("id", "text", "copy", "verdicts", "masks")
    return rows.mapInArrow(cut, "doc_id long, kept binary") if bytes_left else rows.mapInArrow(remove, RESULT)
