"""Fill-in-the-middle transformation with a learned index from token ranks to offsets.

A text is cut at two of its token boundaries. The boundary offsets of a text grow with
their rank, so they are kept as a piecewise-linear function: every segment is a line
through its first and last boundary, no boundary of it lies further than ``ERROR`` from the
line, and the distance of each is stored as one residual. A segment over the error is cut
at its middle, for all texts of a group at a time, until none is. The byte offset of a cut
is the line's value at its rank, put right by the stored residual, so cuts are exact.

Tokens are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` from left to
right. Cuts and form come from the SHA-256 of ``seed:id``, on the JVM.

One pass over the rows, nothing is shuffled: each row is rewritten by itself.

Defined cases: null text counts as empty, an empty text stays plain; a null id hashes as the
empty string; texts that contain a marker stay plain; texts of white space alone have one
token; very long texts are a group by themselves; rows with the same id are cut by the same
hash; an empty table gives an empty result; of extra columns those named like the results
are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import words as W

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Largest distance in bytes of a boundary from its segment's line; residuals fit in 8 bits.
ERROR = 64
GROUP_BYTES = 8 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


class RankIndex:
    """Byte offset of every boundary of many texts, by text and rank.

    ``offsets`` are the boundaries of all texts one after the other, ascending within a
    text; text i has boundaries ``first[i]:first[i + 1]``.
    """

    def __init__(self, offsets: np.ndarray, first: np.ndarray, error: int = ERROR):
        begin, end = first[:-1].astype(np.int64), first[1:].astype(np.int64) - 1
        done = []
        residuals = np.zeros(len(offsets), dtype=np.int64)
        while len(begin):
            sizes = end - begin + 1
            at = np.cumsum(sizes) - sizes
            own = np.repeat(np.arange(len(begin)), sizes)
            rank = np.arange(int(sizes.sum())) - at[own]
            rows = begin[own] + rank
            off = offsets[rows] - self._line(offsets[begin][own], offsets[end][own], sizes[own], rank)
            good = np.maximum.reduceat(np.abs(off), at) <= error
            fits = good[own]
            residuals[rows[fits]] = off[fits]
            done.append((begin[good], end[good]))
            begin, end = begin[~good], end[~good]
            middle = (begin + end) // 2  # a segment of two boundaries fits, so both halves are shorter
            begin, end = np.concatenate([begin, middle + 1]), np.concatenate([middle, end])
        starts = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        ends = np.concatenate([d[1] for d in done]) if done else starts
        order = np.argsort(starts)
        self.starts, ends = starts[order], ends[order]
        self.low, self.high = offsets[self.starts], offsets[ends]
        self.sizes = ends - self.starts + 1
        self.residuals = residuals.astype(np.int8 if error <= 127 else np.int64)
        self.first = first

    @staticmethod
    def _line(low, high, sizes, rank):
        return low + (high - low) * rank // np.maximum(sizes - 1, 1)

    def __len__(self) -> int:
        """Number of segments."""
        return len(self.starts)

    def offset(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Offsets of boundary ``rank[i]`` of text ``text[i]``."""
        row = self.first[text] + rank
        s = np.searchsorted(self.starts, row, "right") - 1
        return self._line(self.low[s], self.high[s], self.sizes[s], row - self.starts[s]) + self.residuals[row]


def boundaries(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries of all texts, their first row by text): the start, then the end of each token."""
    starts, ends, text = W.word_spans(b, offsets)
    n = len(offsets) - 1
    tail = np.zeros(n, dtype=bool)  # white space after the last word is a token of its own
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    tail[full] = W.SPACE[b[offsets[full + 1] - 1]]
    count = np.bincount(text, minlength=n).astype(np.int64) + tail + 1
    first = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(count, out=first[1:])
    out = np.empty(int(first[-1]), dtype=np.int64)
    out[first[:-1]] = 0
    rank = np.arange(len(ends)) - np.searchsorted(text, np.arange(n))[text] + 1
    out[first[text] + rank] = ends - offsets[text]
    last = np.flatnonzero(tail)
    out[first[last + 1] - 1] = offsets[last + 1] - offsets[last]
    return out, first


def hash_parts(id_col: Column, seed: int = SEED) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:id`` as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, h3: Column, h4: Column, rate: int = 50, spm_rate: int = 80) -> Column:
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(m))
    return (F.when((text == "") | marked | (h3 % 100 >= rate), PLAIN)
            .when(h4 % 100 < spm_rate, SPM).otherwise(PSM))


def assemble(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == PSM:
        return b"".join((p, prefix, s, suffix, m, middle))
    return b"".join((s, suffix, p, prefix, m, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made from. Parts contain no marker, and no marker can begin
    within a part and end behind it, so the first one found is the one written."""
    if form == PLAIN:
        return output
    one, two = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    if not output.startswith(one.encode()):
        raise ValueError(f"a {form} text begins with {one}")
    head, rest = output[len(one):].split(two.encode(), 1)
    second, middle = rest.split(MIDDLE.encode(), 1)
    return head + middle + second if form == PSM else second + middle + head


def _cut(batch: pa.RecordBatch, error: int):
    """(n, prefix, middle, suffix, form) of each row of (text, h1, h2, form)."""
    b, offsets = W.text_buffer(batch.column("__fim_text"))
    h1, h2 = (np.asarray(batch.column(c), dtype=np.int64) for c in ("__fim_1", "__fim_2"))
    forms = batch.column("form").to_pylist()
    for i, j in W.groups(offsets, GROUP_BYTES):
        own, raw = offsets[i:j + 1] - offsets[i], b[offsets[i]:offsets[j]]
        index = RankIndex(*boundaries(raw, own), error=error)
        n = np.diff(index.first) - 1
        a, c = h1[i:j] % (n + 1), h2[i:j] % (n + 1)
        text = np.arange(j - i)
        low, high = index.offset(text, np.minimum(a, c)), index.offset(text, np.maximum(a, c))
        data = raw.tobytes()
        for k in range(j - i):
            x, y = int(own[k]), int(own[k + 1])
            p, q = x + int(low[k]), x + int(high[k])
            yield int(n[k]), data[x:p], data[p:q], data[q:y], forms[i + k]


def _prepared(docs: DataFrame, id_col: str, text_col: str, seed: int, rate: int, spm_rate: int, keep: list) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2, h3, h4 = hash_parts(F.col(id_col), seed)
    return docs.select(*keep, text.alias("__fim_text"), h1.alias("__fim_1"), h2.alias("__fim_2"),
                       form_of(text, h3, h4, rate, spm_rate).alias("form"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = 50,
                   spm_rate: int = 80, error: int = ERROR) -> DataFrame:
    """``docs`` with the transformed texts and their ``form``. ``rate`` per cent of the texts are
    cut, ``spm_rate`` per cent of those put the suffix first."""
    kept = [c for c in docs.columns if c not in (text_col, "form")]
    rows = _prepared(docs, id_col, text_col, seed, rate, spm_rate, [F.col(c) for c in kept])
    fields = [f for f in rows.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField(text_col, T.StringType()), T.StructField("form", T.StringType())])

    def run(batches):
        for batch in batches:
            out = [(p + m + s if form == PLAIN else assemble(form, p, m, s)).decode() for _, p, m, s, form in _cut(batch, error)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(kept))), pa.array(out, pa.string()),
                                              batch.column("form")], names=schema.names)

    return rows.mapInArrow(run, schema)


def transformation_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = 50,
                          spm_rate: int = 80, error: int = ERROR) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    rows = _prepared(docs, id_col, text_col, seed, rate, spm_rate, [F.col(id_col).alias("doc_id")])
    schema = T.StructType([rows.schema.fields[0], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            cols = [[], [], [], [], [], []]
            for n, p, m, s, form in _cut(batch, error):
                plain = form == PLAIN
                out = p + m + s if plain else assemble(form, p, m, s)
                row = (n, form, None if plain else len(p.decode()), None if plain else len(m.decode()),
                       hashlib.sha256(out).hexdigest(), hashlib.sha256(restore(out, form)).hexdigest())
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)
