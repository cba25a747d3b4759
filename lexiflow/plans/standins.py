"""Logical inputs built from the driver's test tables.

These builders only reshape driver tables into the schemas the operators expect
(messages with raw headers, a corpus, raw keyterms, an organisation table). They do
none of the operators' work: addresses, dates, counts, joins to dimensions and all
statistics are computed by the operators from these raw strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiflow.functions.text import ngrams, tokenize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# The test tables are files of one row group; those that get per-row text work are dealt out.
TEXT_TABLES = ("documents", "lineitem", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from lexiflow.sources.tables import read_parquet
    spread = spark.sparkContext.defaultParallelism if name in TEXT_TABLES else None
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", spread)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document corpus ``(doc_id, text)``, dealt out by id: counts per document and joins by id
    then need no shuffle of terms."""
    from lexiflow.session import deal_parts
    from lexiflow.sources.tables import read_parquet
    docs = read_parquet(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.repartition(deal_parts(spark), "doc_id")


def raw_keyterms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw keyterm strings ``(query)``: every distinct pair of adjacent whitespace tokens
    of every benchmark passage, whole passages (the passages are planted in the
    documents)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.explode(ngrams(tokenize(F.col("text")), 2)).alias("query")).distinct()


def _mailbox(name_col: str, nation_col: str):
    local = F.lower(F.translate(F.col(name_col), "#", "."))
    return F.concat(F.col(name_col), F.lit(" <"), local, F.lit("@"),
                    F.lower(F.col(nation_col)), F.lit(".example>"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message table, one message per line item.

    ``from`` = supplier mailbox (domain = supplier nation), ``comments_to`` = customer
    mailbox (domain = customer nation), ``date_raw`` = RFC-2822 text of the order date,
    ``is_target`` = urgent order priority.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                               "o_orderpriority")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation"))
    cn = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_nation"))
    m = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(s, li.l_suppkey == s.s_suppkey)
         .join(c, o.o_custkey == c.c_custkey)
         .join(sn, "s_nationkey").join(cn, "c_nationkey"))
    return m.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("msg_id"),
        _mailbox("s_name", "s_nation").alias("from"),
        _mailbox("c_name", "c_nation").alias("comments_to"),
        F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"),
                 F.lit(" +0000")).alias("date_raw"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_target"),
    )


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation table in the reference's CSV shape, one row per nation.

    name/nationality = nation, category = region, stakeholder group = region name in
    lower case, two e-mail domains as a comma list, parent = the region's first nation
    (none for that nation itself); ``row_no`` keeps the file order.
    """
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    w = Window.partitionBy("n_regionkey")  # 25 rows: a fixed-size dimension
    dom = F.lower(F.col("n_name"))
    first = F.min("n_name").over(w)
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("int").alias("row_no"),
        F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")).alias("name"),
        F.concat(F.col("n_name"), F.lit(" org")).alias("full_name"),
        F.col("n_name").alias("nationality"),
        F.col("r_name").alias("category"),
        F.lower("r_name").alias("stakeholdergroup"),
        F.concat(dom, F.lit(".example, mail."), dom, F.lit(".example")).alias("email_domains"),
        F.when(first != F.col("n_name"), first).alias("subsidiary_of"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per conversation: ``body`` = user/assistant turns in turn order,
    ``attachments`` = texts of system turns (array, turn order)."""
    c = table(spark, sf_dir, "conversations")
    part = F.struct("turn", "text")
    g = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") != "system", part))).alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "system", part))).alias("a"))
    return g.select(F.col("conv_id").alias("msg_id"),
                    F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("body"),
                    F.transform("a", lambda x: x["text"]).alias("attachments"))
