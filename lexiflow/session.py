"""Session helpers: a SparkSession with the settings the operators expect."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "lexiflow", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE, UTC time zone and the UI off.

    On a cluster, ``master`` stays None and the cluster manager's settings apply;
    ``spark.sql.shuffle.partitions`` is set only when ``shuffle_partitions`` is given. It
    should be sized to the data (about 128-256 MB per partition after the first
    exchange), AQE coalesces the rest at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when it is unset and the master is a single
    local process (tests, bench) a fresh scratch folder is created and registered;
    elsewhere an unset folder is an error, since executors could not share one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="lexiflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        os.makedirs(path, exist_ok=True) if path.startswith("/") else None
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Unlike a checkpoint the files are compressed and read by column, and joins see their
    size."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/lexiflow-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deal_parts(spark: SparkSession) -> int:
    """Partitions of rows dealt out by a key for costly work: those of a shuffle, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def materialise_by(df: DataFrame, tag: str, key: str) -> DataFrame:
    """Like :func:`materialise`, as a table with buckets of ``key``: joins and counts by the key read it without a shuffle."""
    spark = df.sparkSession
    name = f"lexiflow_{tag}_{uuid.uuid4().hex}".replace("-", "_")
    parts = deal_parts(spark)
    # rows already dealt out by the key stay where they are; a bucket is one file
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


@contextlib.contextmanager
def joined_in_place(spark: SparkSession):
    """Within, a join by a key and more columns leaves sides that lie in buckets of the key where they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def own_exchange(df: DataFrame) -> DataFrame:
    """Give an aggregated join side an exchange of its own (a small shuffle, still lazy).

    An aggregate directly under a join shares its hash partitioning with the join, and
    then AQE cannot split a hot key of the other side. After a rebalance both sides get
    the join's own exchange, which the skew join may split.
    """
    return df.hint("rebalance")


SMALL_SIDE = 64 << 20  # bytes of a join side that goes whole to every task


def small_side(df: DataFrame, tag: str, limit: int = SMALL_SIDE) -> DataFrame:
    """A join side written once and measured: broadcast up to ``limit`` bytes in memory, so that the
    other side stays where it is, else with an exchange of its own (:func:`own_exchange`).

    Unmeasured, an aggregated side is planned as a shuffled join, and the other side has been
    written by key before AQE sees how small this one is."""
    side = materialise(df, tag)
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in side.dtypes if kind in ("string", "binary")]
    size = sum(text, F.lit(64 + 8 * len(side.columns)))  # a row of a hashed relation
    if str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")).startswith("-"):  # switched off
        return own_exchange(side)
    return F.broadcast(side) if (side.agg(F.sum(size)).first()[0] or 0) <= limit else own_exchange(side)


def dense_index(df: DataFrame, order: str, name: str = "index") -> DataFrame:
    """Number the rows 0, 1, 2 ... in the order of the column ``order`` (distinct values or any order of equals).

    A range partitioning sorts; the driver sees one count per partition, no rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, order).sortWithinPartitions(order) \
        .withColumn("_at", F.monotonically_increasing_id())  # partition above 33 bits, row below
    placed = materialise(placed.withColumn("_part", F.shiftright("_at", 33).cast("int")), "indexed")
    counts = {r[0]: r[1] for r in placed.groupBy("_part").agg(F.count(F.lit(1))).collect()}
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    offsets = F.create_map(*[F.lit(x) for pair in starts for x in pair]) if starts else F.lit(None).cast("map<int,bigint>")
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (offsets[F.col("_part")] + row).cast("long").alias(name))
