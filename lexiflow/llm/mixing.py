"""Mixing sources to target weights by Pfair scheduling, all in DataFrame operations.

Every source's documents are put in a pseudo-random order and cut in blocks of equal
size. Block ``j`` of a source with weight ``w`` may not start before ``floor(j / w)`` (its
release) and has to start before ``ceil((j + 1) / w)`` (its deadline); in each time slot
the released block with the earliest deadline runs. After any number of slots each
source is then less than one block away from its share.

Weights are whole shares of a period, and the schedule repeats after one period. The
driver lays out one period only (as many slots as the sum of the shares, a parameter and
the number of sources bound it, never the rows); Spark gives all blocks their slot from
that small table. Slots of a source that has run out stay empty, no document is left out.

Defined cases: a null source is a source of its own; a null doc_id is ordered by its
text; repeated rows are placed each; an empty table gives an empty result; extra columns
stay as they are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1000
BLOCK_ROWS = 64
NULL_SOURCE = "\x00null"
MIXED = ("__mix_block", "__mix_release", "__mix_deadline", "__mix_slot", "__mix_position")
KEY, ORDER, SALT, RANK = "__mix_source", "__mix_order", "__mix_salt", "__mix_rank"


def target_shares(docs: DataFrame, source_col: str = "source", temperature: float = 0.5,
                  slots: int = SLOTS) -> dict[str, int]:
    """Whole shares of about ``slots``, in proportion to rows ** temperature, one at least.

    Sources are the entries of a mixing configuration: the driver gets one row of each.
    """
    n = (docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit(NULL_SOURCE)).alias(KEY))
         .agg(F.count(F.lit(1)).alias("n"))
         .select(KEY, F.pow(F.col("n").cast("double"), F.lit(temperature)).alias("v")))
    rows = {r[0]: r[1] for r in n.collect()}
    total = sum(rows[k] for k in sorted(rows))
    return {k: max(1, int(slots * rows[k] / total + 0.5)) for k in sorted(rows)}


def period_schedule(shares: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block in the period, slot) for one period, earliest deadline first."""
    period = sum(shares.values())
    waiting = [(0, s, 0) for s in sorted(shares)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        if j + 1 < shares[s]:
            heapq.heappush(waiting, ((j + 1) * period // shares[s], s, j + 1))
    return out


def _schedule(docs: DataFrame, shares: dict[str, int] | None = None, id_col: str = "doc_id",
              source_col: str = "source", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with the columns of ``MIXED``.

    The rank of a row in its source comes from (source, three hex digits) groups and
    running totals over them, so that no task holds a whole source.
    """
    spark = docs.sparkSession
    shares = target_shares(docs, source_col) if shares is None else shares
    period = sum(shares.values())
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    keyed = (docs.withColumn(KEY, F.coalesce(F.col(source_col).cast("string"), F.lit(NULL_SOURCE)))
             .withColumn(ORDER, digest).withColumn(SALT, F.substring(ORDER, 1, 3)))
    sizes = keyed.groupBy(KEY, SALT).agg(F.count(F.lit(1)).alias("__mix_n"))
    before = Window.partitionBy(KEY).orderBy(SALT).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(KEY, SALT, F.coalesce(F.sum("__mix_n").over(before), F.lit(0)).alias("__mix_base"))
    inner = Window.partitionBy(KEY, SALT).orderBy(ORDER, id_col, F.xxhash64(text_col))
    ranked = (keyed.withColumn(RANK, F.row_number().over(inner) - 1).join(bases, [KEY, SALT])
              .withColumn(RANK, F.col(RANK) + F.col("__mix_base"))
              .withColumn("__mix_block", F.floor(F.col(RANK) / block_rows)))
    layout = spark.createDataFrame(
        [(s, j, slot, shares[s]) for s, j, slot in period_schedule(shares)],
        f"{KEY} string, __mix_j long, __mix_at long, __mix_share long")
    placed = (ranked.join(F.broadcast(layout.select(KEY, "__mix_share").distinct()), KEY)
              .withColumn("__mix_j", F.col("__mix_block") % F.col("__mix_share")).drop("__mix_share"))
    return (placed.join(F.broadcast(layout), [KEY, "__mix_j"])
            .withColumn("__mix_release", F.expr(f"(__mix_block * {period}) div __mix_share"))
            .withColumn("__mix_deadline", F.expr(f"((__mix_block + 1) * {period} + __mix_share - 1) div __mix_share"))
            .withColumn("__mix_slot", F.expr(f"(__mix_block div __mix_share) * {period} + __mix_at"))
            .withColumn("__mix_position", F.col("__mix_slot") * block_rows + F.col(RANK) % block_rows)
            .select(*docs.columns, *MIXED))


def pfair_mix(docs: DataFrame, **options) -> DataFrame:
    """Add mix_block, mix_release, mix_deadline, mix_slot and mix_position to ``docs``.

    Columns of ``docs`` that have one of these names give way.
    """
    names = [c.removeprefix("__") for c in MIXED]
    return (_schedule(docs, **options)
            .select(*[c for c in docs.columns if c not in names],
                    *[F.col(c).alias(n) for c, n in zip(MIXED, names)]))


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The documents in mixed order: range partitions by position, sorted within.

    Files and rows of a write follow the schedule; the columns are those of ``docs``.
    """
    return (_schedule(docs, **options).repartitionByRange("__mix_position")
            .sortWithinPartitions("__mix_position").select(*docs.columns))
