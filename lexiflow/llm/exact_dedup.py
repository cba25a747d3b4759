"""Exact dedup by two-pass Bloom filtering, all in DataFrame operations.

Pass 1 reads the rows' hashes, sets bits in a blocked Bloom filter and keeps the bits
that two or more rows have set. Pass 2 probes it: a row with a bit that no other row
has set is unique and passes straight through; only the others ("suspects", true
repeats and a few false positives) shuffle and are grouped by their whole SHA-256.

The filter has eight bits for each row, cut in blocks of 2**13 bits (1 KB). Pass 2 runs
slice by slice: ``SLICE_BYTES`` of blocks are broadcast and meet the rows of these blocks
alone, which lie in a folder of their own, so neither the broadcast nor the shuffle grows
beyond that bound or those rows. Equal texts are in one slice. A filter of a single slice
needs no folders: then whole rows are not written, only read again.

Defined cases: null text counts as empty; of equal texts the largest doc_id stays, a
null doc_id counts as smallest; rows equal in text and doc_id count each and exactly one
stays; an empty table gives an empty result; other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import fold_ascii, shared_path, written

BLOCK_BITS = 13
BITS_PER_ROW = 8
SLICE_BYTES = 64 << 20
SHA, HASH, BLOCK, WORDS, SLICE = "__dedup_sha", "__dedup_hash", "__dedup_block", "__dedup_words", "__dedup_slice"


def _sha(text):
    return F.sha2(fold_ascii(F.coalesce(text, F.lit(""))), 256)


def _bit(hash_col, k: int):
    """The k-th bit (0 .. 2**13-1) of a row within its block."""
    return F.shiftrightunsigned(hash_col, 8 + BLOCK_BITS * k).bitwiseAND((1 << BLOCK_BITS) - 1)


def _block(sha_col, n_blocks: int):
    return F.pmod(F.xxhash64(sha_col, F.lit(7)), F.lit(n_blocks).cast("long"))


class Size(NamedTuple):
    """Blocks of a filter, and blocks of one of its slices."""

    n_blocks: int
    per_slice: int

    @property
    def n_slices(self) -> int:
        return -(-self.n_blocks // self.per_slice)


def filter_size(n_rows: int) -> Size:
    n_blocks = max(1, -(-n_rows * BITS_PER_ROW // (1 << BLOCK_BITS)))
    return Size(n_blocks, max(1, SLICE_BYTES // ((1 << BLOCK_BITS) // 8 + 64)))


def keyed_rows(rows: DataFrame, size: Size) -> DataFrame:
    """Rows that have a SHA with their block and slice of the filter."""
    return rows.withColumn(BLOCK, _block(F.col(SHA), size.n_blocks)) \
        .withColumn(SLICE, F.floor(F.col(BLOCK) / size.per_slice).cast("int"))


def sliced(keyed: DataFrame, tag: str) -> DataFrame:
    """Write keyed rows, each slice in a folder of its own."""
    rows, path = keyed, shared_path(keyed.sparkSession, tag)
    keyed.write.partitionBy(SLICE).parquet(path)
    return rows.sparkSession.read.schema(keyed.schema).parquet(path)


def repeat_filter(hashes: DataFrame, size: Size) -> DataFrame:
    """The filter of a table with SHA and block: a row (block, 128 words of 64 bits) for each
    block with a bit that at least two rows set; bits are counted with map-side partial
    aggregation.
    """
    h = F.xxhash64(SHA)
    bits = (hashes.select(BLOCK, F.explode(F.array_distinct(F.array(_bit(h, 0), _bit(h, 1)))).alias("bit"))
            .groupBy(BLOCK, "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    words = (bits.groupBy(BLOCK, F.shiftright("bit", 6).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")))
    packed = (words.groupBy(BLOCK)
              .agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
              .select(BLOCK, F.expr(f"transform(sequence(0, {(1 << BLOCK_BITS) // 64 - 1}), "
                                    "i -> coalesce(m[i], 0L))").alias(WORDS)))
    return written(packed, "bloom")


def probe(keyed: DataFrame, packed: DataFrame, size: Size, part: int) -> DataFrame:
    """The rows of a slice with ``__dedup_suspect``: may another row have the same SHA?"""
    low = part * size.per_slice
    side = F.broadcast(packed.where(F.col(BLOCK).between(low, low + size.per_slice - 1)))  # SLICE_BYTES
    out = keyed.where(F.col(SLICE) == part).withColumn(HASH, F.xxhash64(SHA)).join(side, BLOCK, "left")
    out = out.withColumns({f"__dedup_b{k}": _bit(F.col(HASH), k) for k in (0, 1)})
    is_set = " AND ".join(
        f"shiftrightunsigned({WORDS}[cast(__dedup_b{k} >> 6 as int)], cast(__dedup_b{k} & 63 as int)) & 1 = 1"
        for k in (0, 1))
    return (out.withColumn("__dedup_suspect", F.expr(f"coalesce({WORDS} is not null AND {is_set}, false)"))
            .drop(HASH, BLOCK, SLICE, WORDS, "__dedup_b0", "__dedup_b1"))


def in_slices(keyed: DataFrame, size: Size, decide: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """``decide`` on the probed rows of each slice; more than one slice are run and written one after the other."""
    packed = repeat_filter(keyed, size)
    if size.n_slices == 1:
        return decide(probe(keyed, packed, size, 0))
    path = shared_path(keyed.sparkSession, tag)
    for part in range(size.n_slices):
        out = decide(probe(keyed, packed, size, part))
        out.write.mode("append").parquet(path)
    return keyed.sparkSession.read.schema(out.schema).parquet(path)


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    size = filter_size(docs.count())
    rows = sliced(keyed_rows(docs.select(F.col(id_col).alias("doc_id"), _sha(F.col(text_col)).alias(SHA))
                             .withColumn("__dedup_row", F.monotonically_increasing_id()), size), "digests")
    return in_slices(rows, size, _reported, "report")


def _reported(probed: DataFrame) -> DataFrame:
    suspects = probed.where("__dedup_suspect").drop("__dedup_suspect")
    groups = written(suspects.groupBy(SHA)
                     .agg(F.count(F.lit(1)).alias("__dedup_n"),
                          F.max(F.struct("doc_id", "__dedup_row")).alias("__dedup_top"))
                     .where("__dedup_n > 1"), "groups")
    single = [F.col("doc_id"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
              F.lit(True).alias("kept"), F.col(SHA).alias("text_sha256")]
    straight = probed.where("NOT __dedup_suspect").select(*single)
    met = F.col("__dedup_n").isNotNull()
    grouped = suspects.join(groups, SHA, "left").select(
        "doc_id", F.when(met, F.col("__dedup_top.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("__dedup_n", F.lit(1).cast("long")).alias("group_size"),
        (~met | (F.col("__dedup_top.__dedup_row") == F.col("__dedup_row"))).alias("kept"),
        F.col(SHA).alias("text_sha256"))
    return straight.unionByName(grouped)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``.

    Rows that the filter clears never shuffle; of the suspects, one row of each SHA is
    kept by a partial (map-side) aggregation, so a hot group is reduced before it moves.
    """
    size = filter_size(docs.count())
    keyed = keyed_rows(docs.withColumn(SHA, _sha(F.col(text_col))), size)
    keyed = sliced(keyed, "keyed") if size.n_slices > 1 else keyed
    return in_slices(keyed, size, lambda probed: _best(probed, docs.columns, id_col, text_col), "kept")


def _best(probed: DataFrame, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    straight = probed.where("NOT __dedup_suspect").select(*columns)
    row = F.struct(*[F.col(c) for c in columns])
    best = (probed.where("__dedup_suspect").groupBy(SHA)
            .agg(F.max_by(row, F.struct(F.col(id_col), F.xxhash64(text_col))).alias("__dedup_best")))
    return straight.unionByName(best.select("__dedup_best.*"))
