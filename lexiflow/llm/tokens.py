"""Byte-level BPE over whole texts, with each distinct stretch encoded once.

Texts are cut where the tokenizer's own pre-tokenisation always cuts: before a single
space between two other characters, and around a single line feed between two others.
The stretches between are encoded alone, so each distinct one of a task is encoded once
and the ids of the texts are gathered by number. Cutting at these places never changes
the ids; where a place is in doubt there is no cut.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import words as W

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
CACHE = 1 << 21
GROUP_BYTES = 4 << 20

#: Bytes that may end or begin a white-space character of several bytes.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_ranks_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """ids of byte_bpe_50k for many texts at a time."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={})
        self.hasher = W.Hasher()
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode_one(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        for i, part in enumerate(text.split(SPECIAL)):
            out += [SPECIAL_ID] * (i > 0) + self.bpe.encode_ordinary(part)
        return out

    def _cuts(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the stretches."""
        n = len(b)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        if n >= 3:
            plain = ~W.SPACE[b]
            left = plain.copy()  # the character that ends here is surely no white space
            left[1:] &= ~((b[:-1] == 0xC2) & (b[1:] >= 0x80))
            left[2:] &= ~(_LEAD[b[:-2]] & (b[2:] >= 0x80))
            right = plain & ~_LEAD[b]
            mid = left[:-2] & right[2:] & ~cut[1:n - 1] & ~cut[2:n]
            cut[1:n - 1] |= mid & ((b[1:-1] == 0x20) | (b[1:-1] == 0x0A))
            cut[2:n] |= mid & (b[1:-1] == 0x0A)
        return np.flatnonzero(cut[:n])

    def encode(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids) of texts b[offsets[i]:offsets[i + 1]]."""
        starts = self._cuts(b, offsets)
        ends = np.append(starts[1:], len(b)) if len(starts) else starts
        h = self.hasher.spans(b, starts, ends)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        seen = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.known)
        seen[inside] = self.known[at[inside]] == unique[inside]
        new = np.flatnonzero(~seen)
        if len(new):
            raw = b.tobytes()
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            got = [self.encode_one(raw[x:y].decode("utf-8", "replace")) for x, y in zip(s, e)]
            if len(self.known) + len(new) > CACHE:  # forget; what this call needs comes again
                self.known, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
                if seen.any():
                    return self.encode(b, offsets)
            size = np.fromiter(map(len, got), np.int64, len(got))
            start = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))])
            known = np.concatenate([self.known, unique[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.start = np.concatenate([self.start, start])[order]
            self.size = np.concatenate([self.size, size])[order]
        at = np.searchsorted(self.known, unique)[inverse]
        size, start = self.size[at], self.start[at]
        total = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        index = np.arange(total[-1], dtype=np.int64) + np.repeat(start - total[:-1], size)
        return self.ids[index], total[np.searchsorted(starts, offsets)]


def token_table(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None,
                piece_size: int = 0, end_id: int | None = None, with_ids: bool = False,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, n_tokens and, for a piece size, the CRC-32 (and ids) of each piece.

    A text over ``piece_size`` ids is cut in pieces of that size, the first takes the
    rest. ``end_id`` is appended to every text. Null text counts as empty.
    """
    path = ranks_path or default_ranks_path()
    taken = docs.select(*keep, F.col(text_col).alias("__tok_text"))
    schema = [f for f in taken.schema.fields if f.name != "__tok_text"]
    schema = T.StructType(schema + [T.StructField("n_tokens", T.LongType())]
                          + [T.StructField("crcs", T.ArrayType(T.LongType()))] * bool(piece_size)
                          + [T.StructField("ids", T.ArrayType(T.BinaryType()))] * with_ids)

    def run(batches):
        enc = Encoder(path)
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        for batch in batches:
            b, offsets = W.text_buffer(batch.column(len(batch.schema) - 1))
            counts, crcs, ids = [], [], []
            for i, j in W.groups(offsets, GROUP_BYTES):
                part, at = enc.encode(b[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                counts.append(at[1:] - at[:-1] + len(tail))
                for x, y in zip(at[:-1].tolist(), at[1:].tolist()) if piece_size else ():
                    own = np.concatenate([part[x:y].astype("<u4"), tail])
                    head = len(own) % piece_size or min(len(own), piece_size)
                    cuts = [0, *range(head, len(own) + 1, piece_size)]
                    pieces = [own[p:q].tobytes() for p, q in zip(cuts[:-1], cuts[1:])]
                    crcs.append([zlib.crc32(p) for p in pieces])
                    if with_ids:
                        ids.append(pieces)
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            cols = [batch.column(k) for k in range(len(batch.schema) - 1)] + [pa.array(n, pa.int64())]
            if piece_size:
                cols.append(pa.array(crcs, pa.list_(pa.int64())))
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.binary())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return taken.mapInArrow(run, schema)
