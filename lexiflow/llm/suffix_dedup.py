"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that starts twice or more.

Column-wise construction over a collection. The strings of a collection stand under each
other; every round inserts one symbol of each string, from the last column to the first,
and updates the order of the suffixes that begin there (the collection's Burrows-Wheeler
transform: the symbol before each suffix, in order) and their common prefixes. The order
of a column is a stable distribution of the order of the column behind it by the inserted
symbols; a common prefix is one more than the least of those between the same two suffixes
one column further. Suffixes next to each other with a common prefix of ``LENGTH`` are
repeated strings.

How it runs on Spark. A window is ``LENGTH`` bytes of one text; its anchor is the leftmost
run of ``GRAM`` bytes with the smallest hash in it. Consecutive windows with one anchor
travel as one string to the bucket of the anchor's hash, so equal windows meet there, each
at the same distance from its anchor. Strings of a bucket are therefore laid under each
other by their anchors: suffixes are only compared with those of their own column and
anchor, the transform falls into one segment a column, and a round reads just the segment
of the round before. So nothing larger than the strings of a few anchors and one segment
is held, and no file is read a second time; the shuffled blocks are the external files,
written and read once in sequence.

Before the shuffle, equal strings of a group of documents become one, marked as repeated;
their places are already decided. The number of buckets follows the bytes of the table. A
bucket that would get over ``HOT`` times its share (an anchor in a passage of very many
documents, each with another text around it) is not packed by anchors: its windows travel
singly, as two 64-bit hashes, dealt out by hash, and equal ones meet; windows that differ
never gather, however many share the anchor. Fewer than a third of all bucket numbers can
be in the list of such buckets.

Defined cases: null text counts as empty; a null id is an id; rows with equal id and text
repeat each other, as all equal texts do; texts under ``LENGTH`` bytes have no windows; a
text is read whole, groups of texts are at most ``GROUP_BYTES`` or a single text; an empty
table gives an empty result; extra columns are not read by the report and kept by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import words as W

LENGTH = 200
GRAM = 32  # a power of two
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
BATCH_STRINGS = 1 << 14
HOT = 4
BLOCK = 1 << 17
LAST_ID = np.iinfo(np.int64).max
_ID, _KEY, _SPANS = "__sfx_id", "__sfx_key", "__sfx_spans"
_SECOND = 0xD6E8FEB86659FD93  # odd base of the second hash
STRINGS, DECIDED, WINDOWS = 0, 1, 2


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the runs of ``gram`` bytes at every place."""
    h, size, power = b.astype(np.uint64) + np.uint64(1), 1, W.BASE
    while size < gram:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 64)
    return W.mix(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchored(b: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first byte, end, anchor, hash of the anchor) of the strings of consecutive windows with one anchor."""
    n = len(b) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    bits = (BLOCK + length).bit_length()
    anchor, keys = np.empty(n, np.int32), []  # a group is a few MB, or one text, of 2 GB at most
    for s in range(0, n, BLOCK):
        h = _gram_hashes(b[s:s + BLOCK + length - 1], gram)
        place = np.arange(len(h), dtype=np.uint64)
        least = _least(((h >> np.uint64(bits)) << np.uint64(bits)) | place, length - gram + 1)
        at = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
        anchor[s:s + len(at)] = at + s
        keys.append(h[at[np.flatnonzero(np.append(True, at[1:] != at[:-1]))]])
    new = np.append(True, anchor[1:] != anchor[:-1])
    starts_of_block = np.zeros(n, bool)
    starts_of_block[::BLOCK] = True
    key_no = np.cumsum(new | starts_of_block, dtype=np.int32) - 1
    edge = np.zeros(n + 1, np.int32)
    full = offsets[1:] > offsets[:-1]
    low, high = np.maximum(offsets[:-1], offsets[1:] - length + 1)[full], offsets[1:][full]
    np.add.at(edge, np.minimum(low, n), 1)
    np.add.at(edge, np.minimum(high, n), -1)
    valid = np.cumsum(edge[:n], dtype=np.int32) == 0
    new[1:] |= ~valid[:-1]
    first = np.flatnonzero(new & valid)
    last = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid)
    return first, last + length, anchor[first].astype(np.int64), np.concatenate(keys)[key_no[first]]


def _pack(arrays: list[np.ndarray], data: bytes = b"") -> bytes:
    """A compressed block of arrays of one length, and bytes."""
    import zstandard
    parts = [struct.pack("<BQ", len(arrays), len(arrays[0]))]
    for a in arrays:
        parts += [a.dtype.str.encode().ljust(4), a.tobytes()]
    return zstandard.ZstdCompressor(level=6).compress(b"".join(parts) + data)


def _unpack(block: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(block)
    k, n = struct.unpack_from("<BQ", raw)
    at, arrays = 9, []
    for _ in range(k):
        kind = np.dtype(raw[at:at + 4].decode().strip())
        arrays.append(np.frombuffer(raw, kind, n, at + 4))
        at += 4 + n * kind.itemsize
    return arrays, np.frombuffer(raw, np.uint8, offset=at)


def _key_arrays(doc: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    """Ids as differences, 40-bit keys."""
    return [np.diff(doc, prepend=np.int64(0)), (key & 0xFFFFFFFF).astype("<u4"), (key >> 32).astype("u1")]


def _keys_back(arrays) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(arrays[0]), arrays[1].astype(np.int64) + (arrays[2].astype(np.int64) << 32)


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans of each row that touch or overlap as one; the input is sorted by row and start."""
    if not len(row):
        return row, start, end
    reach = np.maximum.accumulate(end + row * (1 << 40)) - row * (1 << 40)
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return row[at], start[at], np.maximum.reduceat(end, at)


def _by_bucket(bucket: np.ndarray, rows: np.ndarray):
    """(bucket, its rows) pairs."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for i, j in zip(edges, [*edges[1:], len(bucket)]):
        yield int(bucket[i]), rows[i:j]


def _copies(*hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its kind, has equals) of rows compared by some hashes."""
    order = np.lexsort(hashes)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([h[order][1:] != h[order][:-1] for h in hashes])
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    first, several = np.empty(len(order), bool), np.empty(len(order), bool)
    first[order], several[order] = new, np.repeat(size > 1, size)
    return first, several


class _Cutter:
    """Turns groups of texts into blocks for the buckets."""

    def __init__(self, n_buckets: int, length: int, gram: int, hot: np.ndarray | None = None):
        self.n, self.length, self.gram = n_buckets, length, gram
        self.hot = hot if hot is not None else np.zeros(0, np.int64)
        self.one, self.two = W.Hasher(), W.Hasher(_SECOND)

    def strings(self, b, offsets):
        first, end, anchor, key = anchored(b, offsets, self.length, self.gram)
        only, several = _copies(self.one.spans(b, first, end), self.two.spans(b, first, end))
        bucket = (W.mix(key) % np.uint64(self.n)).astype(np.int64)
        return first, end, anchor, key, bucket, only, several

    def load(self, b, offsets) -> np.ndarray:
        """Strings that each bucket would get."""
        *_, bucket, only, _ = self.strings(b, offsets)
        return np.bincount(bucket[only], minlength=self.n)

    def blocks(self, b, offsets, ids, keys):
        """(bucket, kind, block) rows."""
        first, end, anchor, key, bucket, only, several = self.strings(b, offsets)
        text = np.searchsorted(offsets, first, "right") - 1
        start = first - offsets[text]
        yield from self._decided(text[several], start[several], (end - first + start)[several], ids, keys)
        single = np.isin(bucket, self.hot)
        if (single & only).any():
            yield from self._singly(b, offsets, first, end, several, np.flatnonzero(single & only), ids, keys)
        for x, rows in _by_bucket(bucket[only & ~single], np.flatnonzero(only & ~single)):
            own = text[rows]
            data, _ = W.gather_spans(b, first[rows], end[rows])
            yield x, STRINGS, _pack([*_key_arrays(ids[own], keys[own]), start[rows].astype("<u4"),
                                     (anchor - first)[rows].astype("<u2"), (end - anchor)[rows].astype("<u2"),
                                     key[rows], several[rows]], data.tobytes())

    def _decided(self, row, start, end, ids, keys):
        row, start, end = _merged(row, start, end)
        bucket = (W.mix(keys[row].view(np.uint64)) % np.uint64(self.n)).astype(np.int64)
        for x, at in _by_bucket(bucket, np.arange(len(row))):
            yield x, DECIDED, _pack([*_key_arrays(ids[row[at]], keys[row[at]]), start[at], end[at]])

    def _singly(self, b, offsets, first, end, several, rows, ids, keys):
        """Each window of the strings by itself; those of repeated strings are marked."""
        count = end[rows] - first[rows] - self.length + 1
        at = np.repeat(first[rows] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        marked = np.repeat(several[rows], count)
        one, two = self.one.spans(b, at, at + self.length), self.two.spans(b, at, at + self.length)
        only, again = _copies(one, two)
        text = np.searchsorted(offsets, at, "right") - 1
        start = at - offsets[text]
        yield from self._decided(text[again], start[again], start[again] + self.length, ids, keys)
        # a mark on any of some equal windows holds for the one that goes on: they have equals
        bucket = self.n + (one % np.uint64(self.n)).astype(np.int64)
        for x, r in _by_bucket(bucket[only], np.flatnonzero(only)):
            own = text[r]
            yield x, WINDOWS, _pack([*_key_arrays(ids[own], keys[own]), start[r].astype("<u4"), one[r], two[r],
                                     (again | marked)[r]])


def columns(symbols: np.ndarray, group: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Insert the columns of a collection from the last to the first.

    ``symbols`` (columns, strings) has 0 where a string has no symbol, ``group`` the
    ascending numbers of the groups of strings that are compared. Yields, per column, its
    number, the order of the suffixes that begin there, the common prefix of each with the
    one before (at most ``limit``, 0 at the start of a group) and the inserted symbols in
    the order of the column behind: that column's segment of the transform.
    """
    n = symbols.shape[1]
    order, common = np.arange(n), np.zeros(n + 1, np.int16)  # one more, so that ranges may end there
    group = group.astype(np.uint16)
    inside = np.append(False, group[1:] == group[:-1])
    for c in range(len(symbols) - 1, -1, -1):
        segment = symbols[c][order]
        by_symbol = np.argsort(segment, kind="stable")  # 16 bits: distributed, not compared
        moved = by_symbol[np.argsort(group[by_symbol], kind="stable")]
        sorted_symbols = segment[moved]
        same = inside.copy()
        same[1:] &= (sorted_symbols[1:] == sorted_symbols[:-1]) & (sorted_symbols[1:] > 0)
        at = np.flatnonzero(same)
        low, high = moved[at - 1] + 1, moved[at]
        least = common[high]
        far = np.flatnonzero(low != high)
        if len(far):
            ranges = np.empty(2 * len(far), np.int64)
            ranges[::2], ranges[1::2] = low[far], high[far] + 1
            least[far] = np.minimum.reduceat(common, ranges)[::2]
        common = np.zeros(n + 1, np.int16)
        common[at] = np.minimum(least + 1, limit)
        order = order[moved]
        yield c, order, common[:n], segment


def _repeated(data, cut, left, right, group, length: int, width: int) -> np.ndarray:
    """(strings, windows' first column): windows of a few anchors' strings that occur twice or more."""
    n, middle = len(left), width - 1  # the anchor's column
    symbols = np.zeros((middle + length, n), np.uint16)
    size = left + right
    own = np.repeat(np.arange(n), size)
    column = np.repeat(middle - left - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    from_byte = np.repeat(cut - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    symbols[column, own] = data[from_byte].astype(np.uint16) + 1
    found = np.zeros((width, n), bool)
    for c, order, common, _ in columns(symbols, group, length):
        if c < width:
            full = common >= length
            full[:-1] |= full[1:]
            found[c, order[full]] = True
    return found.T


def _bucket_spans(kinds, blocks, length: int, gram: int):
    """(doc, key, start, end) arrays of the spans that a bucket decides."""
    out, strings, windows = [], [], []
    for kind, block in zip(kinds, blocks):
        arrays, data = _unpack(block)
        doc, key = _keys_back(arrays)
        if kind == DECIDED:
            out.append((doc, key, arrays[3], arrays[4]))
        elif kind == WINDOWS:
            windows.append((doc, key, *arrays[3:]))
        else:
            strings.append((doc, key, *arrays[3:], data))
    if windows:
        doc, key, start, one, two, marked = (np.concatenate(x) for x in zip(*windows))
        again = (_copies(one, two)[1] & ~marked).nonzero()[0]
        start = start.astype(np.int64)
        out.append((doc[again], key[again], start[again], start[again] + length))
    if strings:
        out += _string_spans(strings, length, gram)
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def _string_spans(strings, length: int, gram: int):
    data = np.concatenate([s[-1] for s in strings])
    doc, key, start, left, right, anchor, marked = (np.concatenate(x) for x in list(zip(*strings))[:-1])
    start, left, right = start.astype(np.int64), left.astype(np.int64), right.astype(np.int64)
    cut = np.cumsum(left + right) - left - right
    order = np.argsort(anchor, kind="stable")
    edges = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1]))
    sizes = np.diff(np.append(edges, len(order)))
    edges, sizes = edges[sizes > 1], sizes[sizes > 1]  # a string that is alone with its anchor has no equals
    width, i = length - gram + 1, 0
    while i < len(edges):
        fits = np.searchsorted(np.cumsum(sizes[i:]), BATCH_STRINGS, "right")
        j = i + max(int(fits), 1)
        rows = order[np.concatenate([np.arange(e, e + s) for e, s in zip(edges[i:j], sizes[i:j])])]
        group = np.repeat(np.arange(j - i), sizes[i:j])
        found = _repeated(data, cut[rows], left[rows], right[rows], group, length, width)
        found[marked[rows]] = False  # decided where they were cut
        padded = np.zeros((len(rows), width + 2), bool)
        padded[:, 1:-1] = found
        row, begin = np.nonzero(padded[:, 1:] & ~padded[:, :-1])
        _, stop = np.nonzero(~padded[:, 1:] & padded[:, :-1])
        r = rows[row]
        base = start[r] + left[r] - (width - 1)
        yield doc[r], key[r], base + begin, base + stop - 1 + length
        i = j


def _row_key(id_col: str, text_col: str) -> list:
    """Columns that name a row: its id (null: the largest) and 40 bits of its hash. Equal rows have
    equal keys, and equal spans."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST_ID))).alias(_ID),
            F.shiftrightunsigned(F.xxhash64(id_col, text_col), 24).alias(_KEY)]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(__sfx_id, __sfx_key, start, end): byte spans covered by strings of ``length`` bytes that start twice or more."""
    rows = (docs.select(*_row_key(id_col, text_col), F.col(text_col).cast("string").alias("__sfx_text"))
            .where(F.octet_length("__sfx_text") >= length))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    packed = 2 + 2 * length // (length - gram + 1)  # bytes of strings for a byte of text, about
    n_buckets = max(1, total * packed // bucket_bytes)

    def groups_of(batches):
        for batch in batches:
            b, offsets = W.text_buffer(batch.column("__sfx_text"))
            for i, j in W.groups(offsets, GROUP_BYTES):
                yield batch, i, j, b[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]

    def load(batches):
        cutter, sums = _Cutter(n_buckets, length, gram), np.zeros(n_buckets, np.int64)
        for *_, b, offsets in groups_of(batches):
            sums += cutter.load(b, offsets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    share = bucket_bytes // (2 * length)  # strings, about
    hot = np.array(sorted(r.bucket for r in rows.mapInArrow(load, "bucket long, n long").groupBy("bucket")
                          .agg(F.sum("n").alias("n")).where(F.col("n") > HOT * share).select("bucket").collect()), np.int64)

    def cut(batches):
        cutter = _Cutter(n_buckets, length, gram, hot)
        for batch, i, j, b, offsets in groups_of(batches):
            ids = np.asarray(batch.column(_ID), dtype=np.int64)[i:j]
            keys = np.asarray(batch.column(_KEY), dtype=np.int64)[i:j]
            got = list(zip(*cutter.blocks(b, offsets, ids, keys)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int32()),
                                                  pa.array(got[2], pa.binary())], names=["bucket", "kind", "block"])

    def decide(table: pa.Table) -> pa.Table:
        doc, key, start, end = _bucket_spans(table.column("kind").to_pylist(), table.column("block").to_pylist(), length, gram)
        order = np.lexsort((start, key, doc))
        doc, key, start, end = doc[order], key[order], start[order], end[order]
        row = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else doc
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(doc) else row
        row, start, end = _merged(row, start, end)
        return pa.table({_ID: pa.array(doc[at][row], pa.int64()), _KEY: pa.array(key[at][row], pa.int64()),
                         "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})

    return (rows.mapInArrow(cut, "bucket long, kind int, block binary").groupBy("bucket")
            .applyInArrow(decide, f"{_ID} long, {_KEY} long, start long, end long"))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    spans = (repeated_spans(docs, id_col, text_col, **options).groupBy(_ID, _KEY)
             .agg(F.collect_list(F.struct("start", "end")).alias(_SPANS)))  # bounded by the document's bytes
    return docs.select("*", *_row_key(id_col, text_col)).join(spans, [_ID, _KEY], "left")


def _kept(text: str | None, spans) -> tuple[int, int, bytes]:
    """(bytes, maximal removed runs, kept bytes) of a text."""
    raw = (text or "").encode()
    runs: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    at, parts = 0, []
    for start, end in runs:
        parts.append(raw[at:start])
        at = end
    return len(raw), len(runs), b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the kept bytes of each text; what is left of a character that was cut is dropped,
    texts without repeats stay as they are."""
    names = docs.columns
    rows = _with_spans(docs, id_col, text_col, **options).select(*names, _SPANS)
    schema, k = T.StructType(docs.schema.fields), names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t if not s else _kept(t, s)[2].decode("utf-8", "ignore")
                     for t, s in zip(batch.column(k).to_pylist(), batch.column(len(names)).to_pylist())]
            cols = [batch.column(c) for c in range(len(names))]
            cols[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, schema)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _with_spans(docs, id_col, text_col, **options).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__sfx_text"), _SPANS)
    schema = T.StructType([rows.schema.fields[0], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
                           T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            got = [_kept(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [pa.array([n for n, _, _ in got], pa.int64()), pa.array([n - len(k) for n, _, k in got], pa.int64()),
                    pa.array([r for _, r, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for _, _, k in got], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=schema.names)

    return rows.mapInArrow(run, schema)
