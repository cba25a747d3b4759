"""Language ID by prediction by partial matching (PPM) with frozen statistics.

For each language, a byte context tree of variable order (0 to ``order`` bytes) holds how
often each byte followed each context in the training texts. A byte costs -log2 of its
share in the longest context that has seen it; each longer context that was seen, but
not with this byte, adds the cost of an escape (method C: distinct successors / (uses +
distinct successors)); a byte that no context has seen costs 8 bits. The statistics stay
frozen while scoring, so the code length of a text is the exact sum over its bytes. The
language with the shortest code wins; the score is its share in 2 ** -length.

Training reads whole texts of a bounded sample: the ``per_language`` documents of each
language whose hashed id comes first. The trees are bounded by that sample, not by the
table. Scoring reads every byte of every text, in blocks.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without
any training document all texts are ``und``; equal code lengths go to the language that
sorts first; null ids and null languages never train; repeated rows and extra columns
change nothing for the other rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import words as W

ORDER = 4
PER_LANGUAGE = 400
PAD = b"\n"
GROUP_BYTES = 1 << 20
UNDETERMINED = "und"
#: Bits per byte, over those of the dearest training text, and bits in all, that a text may cost.
MARGIN = 1.25
SLACK_BITS = 64.0
COUNTS_SCHEMA = "lang string, gram_order int, gram long, n long"


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of the first documents of each language by hashed id, none held out."""
    ok = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    rows = docs.where(ok).select(F.col(id_col).alias("__ppm_id"), F.col(lang_col).cast("string").alias("lang"),
                                 F.xxhash64(id_col).alias("__ppm_hash"))
    # about twice as many as wanted pass by their hash, so no task ranks a whole language
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each tree
    tops = docs.sparkSession.createDataFrame(
        [(r["lang"], -2.0 ** 63 + 2.0 ** 64 * min(1.0, 2.0 * per_language / r["n"])) for r in sizes],
        "lang string, __ppm_top double")
    some = rows.join(F.broadcast(tops), "lang").where(F.col("__ppm_hash").cast("double") <= F.col("__ppm_top"))
    order = Window.partitionBy("lang").orderBy("__ppm_hash", "__ppm_id")
    chosen = (some.withColumn("__ppm_rank", F.row_number().over(order)).where(F.col("__ppm_rank") <= per_language)
              .select("__ppm_id").distinct())  # per_language ids for each language at most
    return (docs.where(ok).join(F.broadcast(chosen), F.col(id_col) == F.col("__ppm_id"))
            .select(F.col(lang_col).cast("string").alias("lang"), F.lower(text_col).alias("text")))


def _grams(b: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams of order + 1 bytes that end at each byte, text number); texts start after padding."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    at = np.arange(len(b), dtype=np.int64) + np.repeat((np.arange(n) + 1) * order, lens)
    padded = np.full(len(b) + n * order, PAD[0], dtype=np.uint8)
    padded[at] = b
    gram = np.zeros(len(b), dtype=np.int64)
    for j in range(order + 1):
        gram |= padded[at - j].astype(np.int64) << (8 * j)
    return gram, np.repeat(np.arange(n), lens)


def count_grams(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram_order, gram, n): how often each byte follows each context."""
    def run(batches):
        for batch in batches:
            b, offsets = W.text_buffer(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for i, j in W.groups(offsets, 4 * GROUP_BYTES):
                gram, text = _grams(b[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], order)
                for lang in sorted(set(langs[i:j])):
                    own = gram[(langs[i:j] == lang)[text]]
                    for k in range(order + 1):
                        g, n = np.unique(own & ((1 << (8 * (k + 1))) - 1), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), k, np.int32)),
                             pa.array(g), pa.array(n.astype(np.int64))], names=["lang", "gram_order", "gram", "n"])

    return (sample.mapInArrow(run, COUNTS_SCHEMA).groupBy("lang", "gram_order", "gram").agg(F.sum("n").alias("n")))


class ContextTrees:
    """Costs in bits from the counted grams of each language, orders ``order`` to 0."""

    def __init__(self, counts, order: int = ORDER):
        self.order, self._shared = order, None
        self.langs = sorted(counts["lang"].unique())
        self.levels = []
        for lang in self.langs:
            own = counts[counts["lang"] == lang]
            levels = []
            for k in range(order, -1, -1):
                at = own[own["gram_order"] == k].sort_values("gram")
                grams, n = at["gram"].to_numpy(np.int64), at["n"].to_numpy(np.float64)
                contexts, first = np.unique(grams >> 8, return_index=True)
                uses = np.add.reduceat(n, first) if len(n) else n
                kinds = np.diff(np.append(first, len(grams))).astype(np.float64)
                of = np.searchsorted(contexts, grams >> 8)
                levels.append((k, grams, np.log2((uses + kinds)[of] / n), contexts, np.log2((uses + kinds) / kinds)))
            self.levels.append(levels)
        whole = counts[counts["gram_order"] == order]["gram"]
        self.seen = np.unique(whole.to_numpy(np.int64))
        self.costs = self.cost(self.seen)

    def shared(self, spark):
        """The arrays as one broadcast variable (bounded by the training sample), however many scans use them."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast({k: v for k, v in vars(self).items() if k != "_shared"})
        return self._shared

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram, one column for each language."""
        out = np.zeros((len(grams), len(self.langs)))
        for c, levels in enumerate(self.levels):
            todo = np.arange(len(grams))
            for k, keys, bits, contexts, escape in levels:
                g = grams[todo] & ((1 << (8 * (k + 1))) - 1)
                hit, at = _find(keys, g)
                out[todo[hit], c] += bits[at[hit]]
                todo, g = todo[~hit], g[~hit]
                met, at = _find(contexts, g >> 8)
                out[todo[met], c] += escape[at[met]]
            out[todo, c] += 8.0
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)), at


def fit(docs: DataFrame, order: int = ORDER, **sample) -> ContextTrees | None:
    """Trees of the training sample; None if there is none."""
    counts = count_grams(training_sample(docs, **sample), order).toPandas()  # bounded by the sample
    return ContextTrees(counts, order) if len(counts) else None


def identify(docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = (), names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """``keep`` columns and, under ``names``, the language, score (0 to 1) and bits per byte of every row."""
    out = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()))]
    taken = docs.select(*keep, F.col(text_col).rlike("\\p{L}").alias("__ppm_letter"),
                        F.lower(text_col).alias("__ppm_text"))
    schema = T.StructType(taken.schema.fields[:len(keep)] + out)
    if trees is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias(names[0]), F.lit(0.0).alias(names[1]),
                           F.lit(None).cast("double").alias(names[2]))
    shared = trees.shared(docs.sparkSession)

    def run(batches):
        import pandas as pd
        model = ContextTrees.__new__(ContextTrees)
        vars(model).update(shared.value)
        index = pd.Index(model.seen)
        langs = np.array([*model.langs, UNDETERMINED], dtype=object)
        for batch in batches:
            letter = np.array(batch.column(len(batch.schema) - 2).fill_null(False).to_pylist(), dtype=bool)
            b, offsets = W.text_buffer(batch.column(len(batch.schema) - 1))
            bits = np.zeros((len(letter), len(model.langs)))
            for i, j in W.groups(offsets, GROUP_BYTES):
                _add_bits(model, index, b[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], bits[i:j])
            best = bits.argmin(axis=1)
            gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
            score = np.where(letter, 1.0 / np.exp2(-gap).sum(axis=1), 0.0)
            size = np.maximum(np.diff(offsets), 1)
            cols = [batch.column(k) for k in range(len(batch.schema) - 2)]
            cols += [pa.array(langs[np.where(letter, best, len(model.langs))], pa.string()), pa.array(score),
                     pa.array(bits.min(axis=1) / size)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return taken.mapInArrow(run, schema)


def _add_bits(model, index, b, offsets, out) -> None:
    """Add the code lengths of some texts to ``out``; a very long text goes block by block."""
    if len(offsets) == 2 and len(b) > 2 * GROUP_BYTES:
        for at in range(0, len(b), GROUP_BYTES):
            low = max(at - model.order, 0)
            part = b[low:at + GROUP_BYTES]
            costs = _costs(model, index, _grams(part, np.array([0, len(part)]), model.order)[0])
            out[0] += costs[at - low:].sum(axis=0)
        return
    gram, _ = _grams(b, offsets, model.order)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] += np.add.reduceat(_costs(model, index, gram), offsets[some], axis=0)


def _costs(model, index, gram):
    at = index.get_indexer(gram)
    costs = model.costs[at]
    miss = np.flatnonzero(at < 0)
    if len(miss):
        unique, inverse = np.unique(gram[miss], return_inverse=True)
        costs[miss] = model.cost(unique)[inverse]
    return costs


def language_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every document."""
    rows = docs.withColumn("doc_id", F.col(id_col)).withColumn("held_out", held_out(id_col))
    return identify(rows, fit(docs, id_col=id_col, **options), keep=("doc_id", "held_out"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    margin: float = MARGIN, slack_bits: float = SLACK_BITS, **sample) -> DataFrame:
    """The documents that are in a learned language, with the columns of ``docs``.

    Texts without a letter go, and those that no language's tree explains: a text may cost
    ``margin`` times the bits per byte of the dearest training text (8, what bytes cost
    without a model, at least), and ``slack_bits`` more, so that short texts are not judged by
    a few rare letters. All texts with a language that are not held out set that bound; they
    stay, whatever they contain. Without training texts no text is identified.
    """
    columns = tuple(docs.columns)
    names = ("__ppm_lang", "__ppm_score", "__ppm_bits")
    trees = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **sample)
    scored = identify(docs, trees, id_col, text_col, keep=columns, names=names)
    # known texts are scored twice: a table of all texts with their scores would be the larger cost
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    dearest = (identify(known, trees, id_col, text_col, names=names).where(F.col(names[0]) != UNDETERMINED)
               .agg(F.max(names[2])).first()[0] or 0.0)
    size = F.octet_length(F.lower(text_col))
    explained = F.col(names[2]) * size <= max(8.0, margin * dearest) * size + slack_bits
    return scored.where((F.col(names[0]) != UNDETERMINED) & explained).select(*columns)
