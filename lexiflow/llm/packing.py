"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only the lengths matter for the packing, and there are at most ``capacity`` of them. So
Spark counts the documents of each length, the driver matches lengths (never documents),
and Spark gives each document the slot that belongs to its length and its rank among the
documents of that length:

* items above a third of the capacity pair at most twice per sequence: longest first,
  each with the longest partner that still fits;
* the smaller items, longest first, go to the tightest gap that takes them; new
  sequences are opened only when no gap does.

Work on the driver is bounded by the capacity (lengths x distinct gaps). Ranks come from
(salt, length) groups and running totals over the salts, so that a length with a third
of all documents is no hot task.

Defined cases: null text counts as empty and packs as the end id alone; repeated rows and
null ids are packed each; very long texts give many full pieces; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import ROW_ORDER, row_order, shuffle_partitions, written
from lexiflow.llm.tokens import token_table

CAPACITY = 2048
END_ID = 0
#: Documents that ``pack_in_order`` packs together.
WINDOW_ROWS = 4096
_RANK_BITS = 44
_WINDOW_BITS = 32


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of equal bins, [(length, copies in each bin), ...]), ...] for all items."""
    left = {n: c for n, c in histogram.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    small = sorted((n for n in left if 3 * n <= capacity), reverse=True)
    open_bins: dict[int, list] = {}  # gap -> [(bins, contents)]
    gaps: list[int] = []

    def put(gap: int, bins: int, contents: list) -> None:
        if gap not in open_bins:
            open_bins[gap] = []
            insort(gaps, gap)
        open_bins[gap].append((bins, contents))

    while large:
        a = large[-1]
        k = bisect_right(large, capacity - a) - 1
        b = large[k] if k >= 0 else 0
        if b == a and left[a] < 2:
            b = large[k - 1] if k >= 1 else 0
        if not b:
            put(capacity - a, left[a], [(a, 1)])
            left[a] = 0
        elif b == a:
            put(capacity - 2 * a, left[a] // 2, [(a, 2)])
            left[a] %= 2
        else:
            n = min(left[a], left[b])
            put(capacity - a - b, n, [(a, 1), (b, 1)])
            left[a] -= n
            left[b] -= n
        large = [n for n in large if left[n]]
    for s in small:
        n = left[s]
        while n:
            k = bisect_left(gaps, s)
            if k == len(gaps):
                put(capacity, -(-n // (capacity // s)), [])
                k = len(gaps) - 1
            gap = gaps[k]
            bins, contents = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap], gaps[k]
            each = gap // s
            full = min(bins, n // each)
            if full:
                put(gap - each * s, full, [*contents, (s, each)])
                bins, n = bins - full, n - full * each
            if bins and 0 < n < each:
                put(gap - n * s, 1, [*contents, (s, n)])
                bins, n = bins - 1, 0
            if bins:
                put(gap, bins, contents)
    return [x for g in sorted(open_bins) for x in open_bins[g]]


def slot_table(plan, lengths) -> dict[str, np.ndarray]:
    """Arrays sorted by (length, first rank): who sits in which bin at which offset."""
    rows, used, bin_no = [], dict.fromkeys(lengths, 0), 0
    for bins, contents in plan:
        offset = 0
        for n, copies in contents:
            rows.append(((n << _RANK_BITS) + used[n], bin_no, copies, offset))
            used[n] += bins * copies
            offset += n * copies
        bin_no += bins
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": a[:, 0].copy(), "bin": a[:, 1].copy(), "copies": a[:, 2].copy(), "offset": a[:, 3].copy()}


def _piece_schema(docs: DataFrame, id_col: str, with_ids: bool) -> T.StructType:
    return T.StructType([docs.select(F.col(id_col).alias("doc_id")).schema.fields[0]]
                        + [T.StructField(n, T.IntegerType() if n == "piece" else T.LongType())
                           for n in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")]
                        + [T.StructField("ids", T.BinaryType())] * with_ids)


def _piece_rows(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number in its row) of each piece."""
    row = np.repeat(np.arange(len(pieces)), pieces)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)


def _piece_columns(batch: pa.RecordBatch, row, piece, start, length, seq, offset, with_ids: bool) -> list[pa.Array]:
    cols = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), batch.column("crcs").flatten().cast(pa.int64()),
            pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
    return cols + ([batch.column("ids").flatten()] if with_ids else [])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    table = written(
        token_table(docs.withColumn("doc_id", F.col(id_col)), text_col, ranks_path, capacity, END_ID, with_ids, ("doc_id",))
        .withColumn("__pack_row", F.monotonically_increasing_id())
        .withColumn("__pack_len", F.expr(f"((n_tokens - 1) % {capacity}) + 1")), "tokens")
    salts = 2 * shuffle_partitions(spark)
    items = table.withColumn("__pack_salt", F.pmod(F.xxhash64("__pack_row"), F.lit(salts)))
    sizes = written(items.groupBy("__pack_salt", "__pack_len").agg(F.count(F.lit(1)).alias("__pack_n")), "lengths")
    histogram = {r[0]: r[1] for r in sizes.groupBy("__pack_len").agg(F.sum("__pack_n")).collect()}  # <= capacity rows
    slots = slot_table(plan_bins(histogram, capacity), histogram)
    first, total = {}, 0
    for n in sorted(histogram):
        first[n], total = total, total + histogram[n]
    slots["first"] = np.array([first.get(n, 0) for n in range(capacity + 1)], dtype=np.int64)
    before = Window.partitionBy("__pack_len").orderBy("__pack_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__pack_salt", "__pack_len",
                         F.coalesce(F.sum("__pack_n").over(before), F.lit(0)).alias("__pack_base"))
    inner = Window.partitionBy("__pack_salt", "__pack_len").orderBy("__pack_row")
    ranked = (items.withColumn("__pack_rank", F.row_number().over(inner) - 1)
              .join(bases, ["__pack_salt", "__pack_len"])
              .select("doc_id", "n_tokens", "crcs", *["ids"] * with_ids, F.col("__pack_len").alias("len"),
                      (F.col("__pack_rank") + F.col("__pack_base")).alias("rank")))
    shared = spark.sparkContext.broadcast(slots)  # at most capacity lengths x distinct gaps
    schema = _piece_schema(docs, id_col, with_ids)

    def place(batches):
        s = shared.value
        for batch in batches:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            head = batch.column("len").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(s["key"], (head << _RANK_BITS) + rank, "right") - 1
            inside = rank - (s["key"][k] & ((1 << _RANK_BITS) - 1))
            seq = s["bin"][k] + inside // s["copies"][k]
            offset = s["offset"][k] + inside % s["copies"][k] * head
            pieces = (n + capacity - 1) // capacity
            row, piece = _piece_rows(pieces)
            is_head = piece == 0
            start = np.where(is_head, 0, head[row] + (piece - 1) * capacity)
            # whole pieces: a sequence of their own, numbered below zero by document and piece
            own = -(((s["first"][head] + rank)[row] << 20) + piece) - 1
            cols = _piece_columns(batch, row, piece, start, np.where(is_head, head[row], capacity),
                                  np.where(is_head, seq[row], own), np.where(is_head, offset[row], 0), with_ids)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  ranks_path: str | None = None, with_ids: bool = False, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """The columns of ``pack_documents``; sequences in order of sequence_id follow the rows of ``docs``.

    Whole pieces have sequences of their own, numbered among the others. The order is that
    of ``common.row_order``; the driver gets one row of each file or partition.
    """
    spark = docs.sparkSession
    schema = _piece_schema(docs, id_col, with_ids)
    table = written(token_table(row_order(docs.withColumn("doc_id", F.col(id_col))), text_col, ranks_path, capacity, END_ID,
                                with_ids, ("doc_id", *ROW_ORDER)), "tokens")
    part, at = ROW_ORDER
    sizes = sorted(((r[0], r[1]) for r in table.groupBy(part).agg(F.count(F.lit(1))).collect()),
                   key=lambda x: (len(x[0]), x[0]))  # part-100000 comes after part-99999
    first, total = [], 0
    for name, n in sizes:
        first.append((name, total))
        total += n
    bases = spark.createDataFrame(first, f"{part} string, __pack_base long")
    placed = (table.join(F.broadcast(bases), part).withColumn("__pack_at", F.col("__pack_base") + F.col(at))
              .withColumn("__pack_window", F.expr(f"__pack_at div {window_rows}"))
              .select("__pack_window", "__pack_at", "doc_id", "n_tokens", "crcs", *["ids"] * with_ids))

    def pack(rows: pa.Table) -> pa.Table:
        batch = rows.sort_by("__pack_at").combine_chunks().to_batches()[0]
        n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
        head = (n - 1) % capacity + 1
        lengths, counts = np.unique(head, return_counts=True)
        histogram = dict(zip(lengths.tolist(), counts.tolist()))
        s = slot_table(plan_bins(histogram, capacity), histogram)
        by_length = np.argsort(head, kind="stable")
        rank = np.empty(len(n), dtype=np.int64)
        rank[by_length] = np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts)
        k = np.searchsorted(s["key"], (head << _RANK_BITS) + rank, "right") - 1
        inside = rank - (s["key"][k] & ((1 << _RANK_BITS) - 1))
        seq = s["bin"][k] + inside // s["copies"][k]
        offset = s["offset"][k] + inside % s["copies"][k] * head
        row, piece = _piece_rows((n + capacity - 1) // capacity)
        is_head = piece == 0
        start = np.where(is_head, 0, head[row] + (piece - 1) * capacity)
        bins = int(seq.max()) + 1
        local = np.where(is_head, seq[row], bins + np.cumsum(~is_head) - 1)
        least = np.full(int(local.max()) + 1, len(n), dtype=np.int64)
        np.minimum.at(least, local, row)  # the first document of each sequence
        number = np.empty(len(least), dtype=np.int64)
        number[np.argsort(least, kind="stable")] = np.arange(len(least))
        window = batch.column("__pack_window")[0].as_py() << _WINDOW_BITS
        cols = _piece_columns(batch, row, piece, start, np.where(is_head, head[row], capacity),
                              window + number[local], np.where(is_head, offset[row], 0), with_ids)
        return pa.Table.from_arrays(cols, names=schema.names)

    return placed.groupBy("__pack_window").applyInArrow(pack, schema)


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of each sequence in order, from pieces with ids."""
    return (pieces.groupBy("sequence_id")
            .agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", "n_tokens", F.expr("transform(p, x -> x.ids)").alias("ids")))
