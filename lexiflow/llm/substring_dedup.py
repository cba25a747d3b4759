"""Substring dedup: windows of consecutive words that an earlier document has as well.

Super-k-mer partitioning. Every window of ``WINDOW`` words has a minimiser, the smallest
hashed run of ``MINIMISER`` words in it. Consecutive windows with the same minimiser
travel as one packed string to the bucket of that minimiser, so all equal windows meet
there; the bucket cuts the strings into windows again and sorts them, which finds the
smallest doc_id of each exactly.

Map side combining keeps hot passages out of the buckets: of equal strings in a group of
documents only those of the smallest doc_id travel, because the others are already known
to repeat an earlier document. A passage that a third of all documents share thus sends
one string for each group of documents, not one for each document. Strings travel
compressed, one block for each group and bucket.

Windows are compared by two independent 64-bit hashes of their words.

Defined cases: null or empty text has no words; a null doc_id counts as larger than all;
rows with the same doc_id are the same document, so they never repeat each other; very
long texts and runs are cut into strings of at most ``MAX_RUN`` windows, which overlap so
that none is lost; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import words as W

WINDOW = 13
MINIMISER = 3
MAX_RUN = 4096
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20
#: Bytes of strings for a byte of text, and of a string, about.
EXPANSION, STRING_BYTES = 3, 120
HOT = 4
LAST_ID = np.iinfo(np.int64).max
_ID, _KEY = "__sub_id", "__sub_key"
_SECOND = 0xD6E8FEB86659FD93  # odd base of the second hash


def _second(h: np.ndarray, k: int) -> np.ndarray:
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(_SECOND) + W.mix(h[j:j + n])
    return W.mix(out)


def _runs(h: np.ndarray, text: np.ndarray, window: int, m: int):
    """(first word, last word + 1, minimiser) of the super-k-mers."""
    n = len(h) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    mini = np.lib.stride_tricks.sliding_window_view(W.window_hashes(h, m), window - m + 1).min(axis=1)
    valid = text[:n] == text[window - 1:]
    new = np.ones(n, dtype=bool)
    new[1:] = (mini[1:] != mini[:-1]) | (text[1:n] != text[:n - 1])
    run = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    new |= (np.arange(n) - begins[run]) % MAX_RUN == 0
    starts = np.flatnonzero(new & valid)
    ends = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid)
    return starts, ends + window, mini[starts]


def _pack(doc: np.ndarray, key: np.ndarray, *arrays: np.ndarray, data: bytes = b"") -> bytes:
    """A compressed block: doc ids as differences, 40-bit keys, 32-bit arrays and bytes."""
    import zstandard
    parts = [struct.pack("<IQ", len(arrays), len(doc)), np.diff(doc, prepend=np.int64(0)).astype("<i8").tobytes(),
             (key & 0xFFFFFFFF).astype("<u4").tobytes(), (key >> 32).astype("u1").tobytes()]
    parts += [a.astype("<u4").tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=6).compress(b"".join(parts) + data)


def _unpack(block: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(block)
    k, n = struct.unpack_from("<IQ", raw)
    doc = np.cumsum(np.frombuffer(raw, "<i8", n, 12))
    key = np.frombuffer(raw, "<u4", n, 12 + 8 * n).astype(np.int64) \
        + (np.frombuffer(raw, "u1", n, 12 + 12 * n).astype(np.int64) << 32)
    at = 12 + 13 * n
    rest = [np.frombuffer(raw, "<u4", n, at + 4 * n * i).astype(np.int64) for i in range(k)]
    return [doc, key, *rest], np.frombuffer(raw, dtype=np.uint8, offset=at + 4 * n * k)


def _strings(b, offsets, ids, hasher, window, m):
    """The super-k-mers of some texts and which of them a smaller doc_id of the group has as well."""
    starts, ends, text = W.word_spans(b, offsets)
    h = hasher.spans(b, starts, ends)
    first, last, mini = _runs(h, text, window, m)
    own = text[first]
    same = hasher.spans(h, first, last)
    check = W.mix(hasher.spans(W.mix(h), first, last) + (last - first).astype(np.uint64))
    return starts, ends, h, first, last, mini, own, _decided(ids[own], same, check)


def _decided(doc, one, two):
    """Has a smaller doc the same two hashes?"""
    order = np.lexsort((doc, two, one))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    decided = np.zeros(len(order), dtype=bool)
    if len(order):
        decided[order] = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return decided


def _bucket(mini, n_buckets):
    return (W.mix(mini) % np.uint64(n_buckets)).astype(np.int64)


def _known(doc, key, start, end, n_buckets):
    """Blocks of spans that are decided."""
    bucket = _bucket(key.view(np.uint64), n_buckets)
    for x in np.unique(bucket):
        at = bucket == x
        yield int(x), 1, _pack(doc[at], key[at], start[at], end[at])


def _halves(h):
    return h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)


def _packets(b, offsets, ids, keys, hasher, n_buckets, window, m, hot=()):
    """(bucket, kind, block) rows of some texts: kind 0 strings, 1 spans already decided, 2 windows."""
    starts, ends, h, first, last, mini, own, decided = _strings(b, offsets, ids, hasher, window, m)
    if not len(first):
        return
    begin = np.searchsorted(starts, offsets[:-1])  # first word of each text
    doc, key, pos = ids[own], keys[own], first - begin[own]
    if decided.any():
        yield from _known(doc[decided], key[decided], pos[decided], (pos + last - first)[decided], n_buckets)
    bucket = _bucket(mini, n_buckets)
    single = np.isin(bucket, hot) & ~decided
    if single.any():
        rows = np.flatnonzero(single)
        count = last[rows] - first[rows] - window + 1
        at = np.repeat(first[rows] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        row = np.repeat(rows, count)
        one, two = W.window_hashes(h, window)[at], _second(h, window)[at]
        place = at - begin[own[row]]
        again = _decided(doc[row], one, two)
        if again.any():
            yield from _known(doc[row][again], key[row][again], place[again], place[again] + window, n_buckets)
        go = np.flatnonzero(~again)
        there = _bucket(one[go], n_buckets)
        go = go[np.argsort(there, kind="stable")]
        there.sort()
        edges = np.flatnonzero(np.append(True, there[1:] != there[:-1]))
        for i, j in zip(edges, np.append(edges[1:], len(there))):
            k = go[i:j]
            yield n_buckets + int(there[i]), 2, _pack(doc[row[k]], key[row[k]], place[k], *_halves(one[k]), *_halves(two[k]))
    go = np.flatnonzero(~decided & ~single)
    joined, at = W.gather_spans(np.append(b, np.uint8(0x20)), starts, ends + 1)  # words, each with a space
    joined[at[1:] - 1] = 0x20
    bucket = bucket[go]
    go = go[np.argsort(bucket, kind="stable")]
    bucket.sort()
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(go) else []
    for i, j in zip(edges, [*edges[1:], len(bucket)]):
        k = go[i:j]
        data, cut = W.gather_spans(joined, at[first[k]], at[last[k]])
        yield int(bucket[i]), 0, _pack(doc[k], key[k], pos[k], np.diff(cut), data=data.tobytes())


def _bucket_spans(kinds, blobs, hasher, window):
    """(doc, key, start, end) arrays of the spans that a bucket's windows decide."""
    found, parts, data, windows = [], [], [], []
    for kind, blob in zip(kinds, blobs):
        arrays, raw = _unpack(blob)
        if kind == 1:
            found.append(tuple(arrays))
        elif kind == 2:
            windows.append(arrays)
        else:
            parts.append(arrays)
            data.append(raw)
    if parts:
        doc, key, pos, size = (np.concatenate(x) for x in zip(*parts))
        b = np.concatenate(data)
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        starts, ends, text = W.word_spans(b, offsets)
        h = hasher.spans(b, starts, ends)
        n = len(h) - window + 1
        at = np.flatnonzero(text[:n] == text[window - 1:])
        one, two = W.window_hashes(h, window)[at], _second(h, window)[at]
        order = np.argsort(one, kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = one[order][1:] != one[order][:-1]
        if ((two[order][1:] != two[order][:-1]) & ~new[1:]).any():  # a collision of the first hash
            order = np.lexsort((two, one))
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        owner = doc[text[at]]
        smallest = np.minimum.reduceat(owner[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        repeated = np.zeros(len(order), dtype=bool)
        repeated[order] = owner[order] > smallest
        at = at[repeated]
        if len(at):
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at)) - 1
            row = text[at[begin]]
            word = pos[row] - np.searchsorted(starts, offsets[:-1])[row]
            found.append((doc[row], key[row], word + at[begin], word + at[end] + window))
    if windows:
        doc, key, pos, *halves = (np.concatenate(x) for x in zip(*windows))
        one, two = (low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)) for low, high in (halves[:2], halves[2:]))
        again = _decided(doc, one, two)
        found.append((doc[again], key[again], pos[again], pos[again] + window))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    return [np.concatenate(x) for x in zip(*found)]


def _row_key(id_col: str, text_col: str) -> list:
    """Columns that name a row: its id (null: the largest) and 40 bits of its hash. Equal rows have
    equal keys, and equal spans."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST_ID))).alias(_ID),
            F.shiftrightunsigned(F.xxhash64(id_col, text_col), 24).alias(_KEY)]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   minimiser: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(__sub_id, __sub_key, start, end): word spans covered by windows that a smaller doc_id has as well."""
    rows = docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("__sub_text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n_buckets = max(1, total * EXPANSION // bucket_bytes)

    def groups_of(batches):
        for batch in batches:
            ids = np.asarray(batch.column(_ID), dtype=np.int64)
            keys = np.asarray(batch.column(_KEY), dtype=np.int64)
            b, offsets = W.text_buffer(batch.column("__sub_text"))
            for i, j in W.groups(offsets, GROUP_BYTES):
                yield b[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ids[i:j], keys[i:j]

    def load(batches):
        hasher, sums = W.Hasher(), np.zeros(n_buckets, np.int64)
        for b, offsets, ids, _ in groups_of(batches):
            *_, mini, _, decided = _strings(b, offsets, ids, hasher, window, minimiser)
            sums += np.bincount(_bucket(mini[~decided], n_buckets), minlength=n_buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    hot = np.array([r.bucket for r in rows.mapInArrow(load, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
                    .where(F.col("n") > HOT * (bucket_bytes // STRING_BYTES)).select("bucket").collect()], np.int64)

    def cut(batches):
        hasher = W.Hasher()
        for b, offsets, ids, keys in groups_of(batches):
            got = list(zip(*_packets(b, offsets, ids, keys, hasher, n_buckets, window, minimiser, hot)))
            if got:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[0], pa.int64()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.binary())],
                    names=["bucket", "kind", "block"])

    def sort(table: pa.Table) -> pa.Table:
        doc, key, start, end = _bucket_spans(table.column("kind").to_pylist(), table.column("block").to_pylist(),
                                        W.Hasher(), window)
        return pa.table({_ID: pa.array(doc, pa.int64()), _KEY: pa.array(key, pa.int64()), "start": pa.array(start, pa.int64()),
                         "end": pa.array(end, pa.int64())})

    return (rows.mapInArrow(cut, "bucket long, kind int, block binary").groupBy("bucket")
            .applyInArrow(sort, f"{_ID} long, {_KEY} long, start long, end long"))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    spans = (repeated_spans(docs, id_col, text_col, **options).groupBy(_ID, _KEY)
             .agg(F.collect_list(F.struct("start", "end")).alias("__sub_spans")))  # bounded by the document's words
    return docs.select("*", *_row_key(id_col, text_col)).join(spans, [_ID, _KEY], "left")


def _kept(text: str | None, spans) -> tuple[int, list[bytes]]:
    """(words, kept words) of a text."""
    all_words = (text or "").encode().split()
    if not spans:
        return len(all_words), all_words
    stay = np.ones(len(all_words), dtype=bool)
    for s in spans:
        stay[s["start"]:s["end"]] = False
    return len(all_words), [all_words[i] for i in np.flatnonzero(stay)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the kept words of each text, joined by one space; texts without repeats stay as they are."""
    columns = docs.columns
    rows = _with_spans(docs, id_col, text_col, **options).select(*columns, "__sub_spans")
    schema = T.StructType(docs.schema.fields)
    k = columns.index(text_col)

    def run(batches):
        for batch in batches:
            spans = batch.column(len(columns)).to_pylist()
            texts = [t if not s else b" ".join(_kept(t, s)[1]).decode()
                     for t, s in zip(batch.column(k).to_pylist(), spans)]
            cols = [batch.column(c) for c in range(len(columns))]
            cols[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return rows.mapInArrow(run, schema)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    rows = _with_spans(docs, id_col, text_col, **options).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("__sub_text"), "__sub_spans")
    schema = T.StructType([rows.schema.fields[0], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            n, removed, sha = [], [], []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                count, kept = _kept(t, s)
                n.append(count)
                removed.append(count - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(sha, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
