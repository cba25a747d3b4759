"""Actor analytics: message parsing, organisation dimension, first-match enrichment,
zero-filled yearly series, shares, stacked bands, activity periods and member counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from lexiflow.functions.mail import (
    address_match, domain_of, email_of, parse_mail_date, year_of,
)
from lexiflow.session import cut_lineage, own_exchange

# --- messages -----------------------------------------------------------------------------

def parse_messages(messages: DataFrame, sender_col: str = "from",
                   receiver_col: str = "comments_to", date_col: str = "date_raw") -> DataFrame:
    """Add ``sender_email``, ``sender_domain``, ``receiver_domain``, ``sent_at`` (UTC) and
    ``sent_year`` (sender's wall clock) to a message table.

    Each header is matched once (first projection); the parts are derived from the
    matches in the second projection, which Catalyst keeps separate because the
    matches are referenced several times."""
    cols = messages.columns
    step = messages.select(
        "*",
        address_match(F.col(sender_col)).alias("_sm"),
        address_match(F.col(receiver_col)).alias("_rm"),
        parse_mail_date(F.col(date_col)).alias("sent_at"),
    )
    return step.select(
        *cols,
        email_of(F.col("_sm")).alias("sender_email"),
        domain_of(F.col("_sm")).alias("sender_domain"),
        domain_of(F.col("_rm")).alias("receiver_domain"),
        "sent_at",
        year_of(F.col(date_col), F.col("sent_at")).alias("sent_year"),
    )


def with_valid_date(messages: DataFrame, col: str = "sent_at") -> DataFrame:
    return messages.where(F.col(col).isNotNull())


def activity_period(messages: DataFrame, ts_col: str = "sent_at", year_col: str = "sent_year") -> DataFrame:
    """First/last message time and year over messages with a valid date."""
    m = with_valid_date(messages, ts_col)
    return m.agg(F.min(ts_col).alias("first_at"), F.max(ts_col).alias("last_at"),
                 F.min(year_col).alias("first_year"), F.max(year_col).alias("last_year"))


def crop_by_year(messages: DataFrame, lo: int, hi: int, inclusive: bool = False,
                 year_col: str = "sent_year") -> DataFrame:
    """Messages with ``lo <= year < hi`` (``inclusive=True``: ``<= hi``)."""
    upper = F.col(year_col) <= hi if inclusive else F.col(year_col) < hi
    return messages.where((F.col(year_col) >= lo) & upper)


def crop_by_domain(messages: DataFrame, domains: Sequence[str], col: str = "sender_domain") -> DataFrame:
    return messages.where(F.col(col).isin(list(domains)))


def messages_per_address(messages: DataFrame, col: str = "sender_email") -> DataFrame:
    """Members by message count, descending (unparsable addresses excluded)."""
    return (messages.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("email"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "email"))


def member_totals(messages: DataFrame, col: str = "sender_email") -> DataFrame:
    """Total messages, messages with a parsed address, distinct members, unparsable."""
    return messages.agg(F.count(F.lit(1)).alias("n_messages"),
                        F.count(col).alias("n_attributed"),
                        F.count_distinct(col).alias("n_members"),
                        F.count_if(F.col(col).isNull()).alias("n_unparsable"))


def most_active_members(per_member: DataFrame, q: float = 0.9) -> DataFrame:
    """Members with a count above the truncated q-th percentile of counts.

    ``percentile`` keeps one counter per distinct count value, so its state is bounded
    by the number of distinct counts, not by the number of members."""
    p = per_member.agg(F.percentile("n", q).alias("p")).first()["p"]
    return per_member.where(F.col("n") > int(p or 0))


def messages_per_domain(messages: DataFrame, col: str = "sender_domain") -> DataFrame:
    return (messages.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("domain"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("n", "domain"))


def domain_year_counts(messages: DataFrame, col: str = "sender_domain",
                       year_col: str = "sent_year", by: Sequence[str] = ()) -> DataFrame:
    return (messages.where(F.col(col).isNotNull() & F.col(year_col).isNotNull())
            .groupBy(*by, F.col(col).alias("domain"), F.col(year_col).alias("year"))
            .agg(F.count(F.lit(1)).alias("n")))


def distinct_domains(messages: DataFrame, cols: Sequence[str] = ("sender_domain", "receiver_domain")) -> DataFrame:
    parts = [messages.select(F.col(c).alias("domain")) for c in cols]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(F.count_distinct("domain").alias("n_domains"))


# --- organisation dimension -------------------------------------------------------------

def trim_all(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    return df.select([F.trim(F.col(c)).alias(c) if isinstance(t, StringType) else F.col(c)
                      for c, t in ((f.name, f.dataType) for f in df.schema.fields)])


def expand_multi_entries(df: DataFrame, column: str, pos_col: str | None = None) -> DataFrame:
    """One row per comma-separated entry of ``column`` (entries trimmed); NULL rows are
    kept. ``pos_col`` records the entry position for first-match ordering."""
    parts = F.split(F.col(column), ",")
    others = [c for c in df.columns if c != column]
    if pos_col:
        out = df.select(*others, F.posexplode_outer(parts).alias(pos_col, column))
    else:
        out = df.select(*others, F.explode_outer(parts).alias(column))
    return out.withColumn(column, F.trim(F.col(column)))


def parent_nationality(org: DataFrame, name_col: str = "name", parent_col: str = "subsidiary_of",
                       nat_col: str = "nationality") -> DataFrame:
    """A child takes its parent's nationality when the parent name matches exactly one
    row (a NULL parent nationality is copied as well)."""
    parents = (org.groupBy(F.col(name_col).alias("_pname"))
               .agg(F.count(F.lit(1)).alias("_n"), F.first(nat_col).alias("_pnat"))
               .where(F.col("_n") == 1).select("_pname", "_pnat", F.lit(True).alias("_hit")))
    j = org.join(parents, org[parent_col] == parents["_pname"], "left")
    return j.select(*[F.when(F.col("_hit"), F.col("_pnat")).otherwise(F.col(nat_col)).alias(c)
                      if c == nat_col else F.col(c) for c in org.columns])


def org_dimension(org_raw: DataFrame, domain_col: str = "email_domains") -> DataFrame:
    """trim -> parent nationality -> one row per e-mail domain (``domain``, ``domain_pos``)."""
    o = parent_nationality(trim_all(org_raw))
    o = expand_multi_entries(o, domain_col, pos_col="domain_pos")
    return o.withColumnRenamed(domain_col, "domain").withColumn("domain", F.lower("domain"))


def first_match(dim: DataFrame, attr: str, key: str = "domain",
                order: Sequence[str] = ("row_no", "domain_pos")) -> DataFrame:
    """Per key, the attribute of the first dimension row in file order (``order``)."""
    d = dim.where(F.col(key).isNotNull() & F.col(attr).isNotNull())
    o = F.struct(*[F.col(c) for c in order])
    return d.groupBy(key).agg(F.min_by(F.col(attr), o).alias(attr))


def enrich(messages: DataFrame, lookup: DataFrame, attr: str, out_col: str,
           key_col: str = "sender_domain", key: str = "domain", default: str = "Unknown",
           strip: bool = True) -> DataFrame:
    """Left join a first-match lookup ``(key, attr)``; unmatched rows get ``default``.

    The join has no hint: AQE broadcasts the lookup by its measured bytes or, beyond
    that, splits hot domains of the messages."""
    lk = own_exchange(lookup.select(F.col(key).alias("_k"), F.col(attr).alias("_v")))
    j = messages.join(lk, messages[key_col] == lk["_k"], "left")
    v = F.trim(F.col("_v")) if strip else F.col("_v")
    return j.select(*[F.col(c) for c in messages.columns], F.coalesce(v, F.lit(default)).alias(out_col))


def map_labels(df: DataFrame, col: str, mapping: DataFrame, on_missing: str = "error",
               key: str = "key", value: str = "label") -> DataFrame:
    """Replace ``col`` by its label from a mapping table. ``on_missing``: ``error`` raises
    at run time, ``keep`` keeps the value, ``null`` sets NULL."""
    m = mapping.select(F.col(key).alias("_mk"), F.col(value).alias("_mv"))
    j = df.join(m, df[col] == m["_mk"], "left")
    if on_missing == "error":
        v = F.when(F.col(col).isNull() | F.col("_mk").isNotNull(), F.col("_mv")).otherwise(
            F.raise_error(F.concat(F.lit("no label for "), F.col(col).cast("string"))))
    elif on_missing == "keep":
        v = F.coalesce(F.col("_mv"), F.col(col))
    elif on_missing == "null":
        v = F.col("_mv")
    else:
        raise ValueError("on_missing must be error, keep or null")
    return j.select(*[v.cast("string").alias(c) if c == col else F.col(c) for c in df.columns])


# --- yearly series --------------------------------------------------------------------------

def year_range(messages: DataFrame, year_col: str = "sent_year") -> tuple[int, int] | None:
    """First and last year, None without any."""
    r = messages.agg(F.min(year_col), F.max(year_col)).first()
    return None if r[0] is None else (int(r[0]), int(r[1]))


def yearly_counts(messages: DataFrame, group_col: str | None, years: tuple[int, int] | None = None,
                  year_col: str = "sent_year") -> DataFrame:
    """Messages per (group, year) for every group and every year of ``years``
    (inclusive range), zero filled. Groups are all group values of the messages; without
    ``years`` the range is first..last year with a valid date.

    One pass over the messages: counts per (group, year) - a partial aggregation whose
    result has groups × years rows - are checkpointed; the year range, the groups and
    the scaffold (``explode(sequence(lo, hi))`` per group, no join of unrelated tables)
    all come from that small table.
    """
    grp = F.col(group_col) if group_col else F.lit(None).cast("string")
    counts = cut_lineage(messages.groupBy(grp.alias("grp"), F.col(year_col).alias("year"))
                         .agg(F.count(F.lit(1)).alias("n")))
    if years is None:
        years = year_range(counts, "year")
    if years is None:  # no message with a year: no group has a series
        out = counts.where(F.lit(False)).select("grp", "year", "n")
        return out if group_col else out.select("year", "n")
    lo, hi = years
    inside = counts.where(F.col("year").between(lo, hi))
    groups = counts.select("grp").distinct()
    scaffold = groups.select("grp", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("year"))
    i = inside.select(F.col("grp").alias("_g"), F.col("year").alias("_y"), "n")
    on = scaffold["grp"].eqNullSafe(i["_g"]) & (scaffold["year"] == i["_y"])  # NULL is a group too
    out = (scaffold.join(i, on, "left")
           .select("grp", "year", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
    return out if group_col else out.select("year", "n")


def target_share(target_yearly: DataFrame, all_yearly: DataFrame) -> DataFrame:
    """Per year ``n_t``, ``n_s`` and ``share = n_t / n_s - 1`` (NULL when n_s = 0)."""
    t = target_yearly.select("year", F.col("n").alias("n_t"))
    s = all_yearly.select("year", F.col("n").alias("n_s"))
    return t.join(s, "year").select("year", "n_t", "n_s",
                                    (F.try_divide(F.col("n_t"), F.col("n_s")) - 1).alias("share"))


def group_totals(yearly: DataFrame) -> DataFrame:
    """Totals per group over all years, ascending."""
    return yearly.groupBy("grp").agg(F.sum("n").alias("total")).orderBy("total", "grp")


def rank_by_last_year(yearly: DataFrame) -> DataFrame:
    """Groups ranked by their count in the last year (ascending, ties by group name).

    A group's rank is its place among equal counts plus the number of groups with a
    smaller count; only the distinct counts are put in one order."""
    last = yearly.agg(F.max("year").alias("_last"))
    g = yearly.join(F.broadcast(last), F.col("year") == F.col("_last")).select("grp", F.col("n").alias("n_last"))  # one row
    same = Window.partitionBy("n_last").orderBy("grp")
    below = Window.orderBy("n_last").rowsBetween(Window.unboundedPreceding, -1)
    counts = g.groupBy("n_last").agg(F.count(F.lit(1)).alias("_c")) \
        .select(F.col("n_last").alias("_v"), F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_below"))
    return (g.withColumn("_place", F.row_number().over(same)).join(counts, F.col("n_last") == F.col("_v"))
            .select("grp", "n_last", (F.col("_place") + F.col("_below")).cast("int").alias("rank")))


def stacked_bands(yearly: DataFrame) -> DataFrame:
    """Per year, cumulative lower/upper band of each group stacked in last-year rank
    order (window partitioned by year). NULL is a group like any other."""
    last = yearly.agg(F.max("year").alias("_last"))
    key = (yearly.join(F.broadcast(last), F.col("year") == F.col("_last"))  # one row
           .select(F.col("grp").alias("_g"), F.col("n").alias("n_last")))
    w = Window.partitionBy("year").orderBy("n_last", "grp") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = yearly.join(key, yearly["grp"].eqNullSafe(key["_g"]))
    upper = F.sum("n").over(w)
    return j.select("grp", "year", "n", (upper - F.col("n")).alias("lower"), upper.alias("upper"))
