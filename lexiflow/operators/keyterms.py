"""Keyterm search: query preparation, query profile and per-text query counts.

Counting plan (one plan for every number and length of queries): the queries form a trie
whose steps double, from depth 0 to 1, 2, 4, 8 ... tokens or to the end of a query, kept as
an edge table (node, tokens of the step, next node or query). Token positions carry their
own and the next token, and take the first two steps by two joins; most end there. Only
positions that are still on a path get the tokens of their next step, from their text's
token array, one join a doubling. All joins are unhinted, so AQE broadcasts a small side by
its measured bytes and shuffles a large one. Hits are aggregated per (text, field, query);
only overlapping or adjacent hits need their positions, those are folded greedily in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.text import (
    DEFAULT_STOPWORDS, clean_text, has_digits, non_alphanumeric_chars, substring_count, tokenize,
)
from lexiflow.operators.substrings import PhraseSearch
from lexiflow.session import materialise, own_exchange


def prepare_queries(raw: DataFrame, col: str = "query", min_len: int = 1, max_len: int = 30,
                    keep_nonalphanumerics=True, remove_numbers: bool = False,
                    stopwords: Sequence[str] = DEFAULT_STOPWORDS,
                    lemmas: Mapping[str, str] | None = None, do_stemming: bool = False) -> DataFrame:
    """Clean raw query strings like texts, drop empty ones, deduplicate.

    Returns ``(query string, n_tokens int)``; ``query`` is unpadded, tokens are joined by
    one space.
    """
    q = clean_text(F.col(col), min_len=min_len, max_len=max_len,
                   keep_nonalphanumerics=keep_nonalphanumerics,
                   remove_numbers=remove_numbers, stopwords=stopwords,
                   lemmas=lemmas, do_stemming=do_stemming)
    return (raw.select(q.alias("query")).where(F.col("query") != "").distinct()
            .withColumn("n_tokens", F.size(F.split("query", " "))))


def query_profile(queries: DataFrame) -> DataFrame:
    """One row describing the query list: digits present, non-alphanumeric characters
    (sorted, space excluded), shortest and longest term length, number of queries."""
    terms = queries.select("query", F.explode(F.split("query", " ")).alias("term"))
    terms = terms.select("query", "term",
                         F.explode_outer(non_alphanumeric_chars(F.col("term"))).alias("ch"))
    # collect_set holds at most the ~33 ASCII punctuation characters
    return terms.agg(
        F.coalesce(F.max(has_digits(F.col("term")).cast("int")), F.lit(0))
        .cast("boolean").alias("has_digits"),
        F.min(F.length("term")).alias("min_term_len"),
        F.max(F.length("term")).alias("max_term_len"),
        F.count_distinct("query").alias("n_queries"),
        F.array_sort(F.collect_set("ch")).alias("non_alphanumerics"),
    )


def search_options(profile_row, legacy_digits: bool = False) -> dict:
    """Text options for the search set derived from a ``query_profile`` row.

    Digits are kept iff the queries contain digits (``legacy_digits=True`` reproduces the
    reference, which removes them exactly then). Non-alphanumerics used by queries are
    kept, every other punctuation character becomes a space.
    """
    has_d = bool(profile_row["has_digits"])
    return dict(
        min_len=int(profile_row["min_term_len"] or 1),
        max_len=int(profile_row["max_term_len"] or 1),
        keep_nonalphanumerics=list(profile_row["non_alphanumerics"] or []),
        remove_numbers=has_d if legacy_digits else not has_d,
    )


def _greedy_count(sorted_positions: Column, gap: Column) -> Column:
    """Count hits keeping a hit only if it starts >= previous kept hit + gap."""
    init = F.struct(F.lit(-(1 << 40)).cast("bigint").alias("last"),
                    F.lit(0).cast("bigint").alias("c"))
    return F.aggregate(
        sorted_positions, init,
        lambda acc, p: F.when(p >= acc["last"] + gap,
                              F.struct(p.cast("bigint").alias("last"),
                                       (acc["c"] + 1).alias("c"))).otherwise(acc),
        lambda acc: acc["c"],
    )


def _overlap_free(query: Column) -> Column:
    """True when no proper prefix of the token sequence equals a suffix (two hits of the
    query can then never overlap)."""
    toks = F.split(query, " ")
    n = F.size(toks)
    border = F.exists(F.sequence(F.lit(1), n - 1),
                      lambda k: F.slice(toks, 1, k) == F.slice(toks, n - k + 1, k))
    return F.when(n <= 1, F.lit(True)).otherwise(~border)


def query_trie(queries: DataFrame) -> DataFrame:
    """``(depth, node, step, tokens, query, next)``: the edges of the queries' trie.

    ``node`` is the path so far (the tokens up to depth 2, their MD5 below), ``step`` the
    number of tokens to go and ``tokens`` those; ``query`` is set where a query ends and
    ``next`` where longer ones go on.
    """
    def path(n):
        own = F.array_join(F.slice("qt", F.lit(1), n), " ")
        return F.when(n <= 2, own).otherwise(F.md5(own))

    size = F.size("qt")
    depth = F.col("depth")
    steps = queries.select("query", F.split("query", " ").alias("qt")).select(
        "query", "qt", F.explode(F.expr("concat(array(0), transform(filter(sequence(0, 31), e -> shiftleft(1L, e) < size(qt)), "
                                        "e -> cast(shiftleft(1L, e) as int)))")).alias("depth"))
    to = F.least(F.when(depth == 0, 1).otherwise(depth * 2), size)
    return (steps.select("depth", path(depth).alias("node"), (to - depth).alias("step"),
                         F.array_join(F.slice("qt", depth + 1, to - depth), " ").alias("tokens"),
                         F.when(to == size, F.col("query")).alias("query"), F.when(to < size, path(to)).alias("next"))
            .groupBy("depth", "node", "step", "tokens").agg(F.max("query").alias("query"), F.max("next").alias("next")))


def token_positions(long: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, field, text, size, pos, first, second)``: one narrow row per token."""
    at = F.expr("element_at(transform(array(toks), t -> transform(t, (x, i) -> named_struct("
                "'pos', i, 'first', x, 'second', get(t, i + 1)))), 1)")
    return long.select(id_col, "field", "text", F.size("toks").alias("size"), F.explode(at).alias("p")) \
        .select(id_col, "field", "text", "size", "p.*")


def trie_hits(positions: DataFrame, long: DataFrame, trie: DataFrame, queries: DataFrame,
              id_col: str = "doc_id") -> DataFrame:
    """``(id, field, size, pos, query, n)``: every position at which a query's tokens stand."""
    longest = queries.agg(F.max("n_tokens")).first()[0] or 0  # a scalar: how often to double
    def edges(depth, **names):
        e = trie.where(F.col("depth") == depth)
        return own_exchange(e.select(*(F.col(c).alias(n) for c, n in names.items())))

    place = [id_col, "field", "text", "size", "pos"]
    # edges have an exchange of their own: a frequent first token may be split by AQE
    two = (positions.join(edges(0, tokens="first", query="q1", next="n1"), "first")
           .join(edges(1, node="n1", tokens="second", query="q2", next="n2"), ["n1", "second"], "left")
           .select(*place, "q1", "q2", "n2").where("q1 is not null or q2 is not null or n2 is not null"))
    if longest > 2:
        two = materialise(two, "positions")  # read for the hits and for the next step
    ended = F.filter(F.array(F.struct(F.col("q1").alias("query"), F.lit(1).alias("n")),
                             F.struct(F.col("q2").alias("query"), F.lit(2).alias("n"))), lambda h: h["query"].isNotNull())
    hits = two.select(*place, F.explode(ended).alias("h")).select(id_col, "field", "size", "pos", "h.query", "h.n")
    on, depth = two.where("n2 is not null").select(*place, F.col("n2").alias("node")), 2
    while depth < longest:
        steps = trie.where(F.col("depth") == depth)
        lengths = steps.groupBy("node").agg(F.collect_set("step").alias("steps"))  # at most depth of them
        key = [id_col, "field", "text"]
        near = (on.join(own_exchange(lengths), "node").groupBy(*key)
                .agg(F.collect_set(F.struct("pos", "node", "steps")).alias("near"))  # bounded by the text's tokens
                .select(F.col(id_col).alias("_id"), F.col("field").alias("_field"), F.col("text").alias("_text"), "near"))
        met = long.join(near, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("field") == F.col("_field"))
                        & (F.col("text") == F.col("_text")))
        ahead = met.select(id_col, "field", "text", F.size("toks").alias("size"), F.explode(F.expr(f"""
            element_at(transform(array(toks), t -> flatten(transform(near, x -> transform(
                filter(x.steps, s -> x.pos + {depth} + s <= size(t)),
                s -> named_struct('pos', x.pos, 'node', x.node, 'step', s,
                                  'tokens', array_join(slice(t, x.pos + {depth} + 1, s), ' ')))))), 1)""")).alias("a")) \
            .select(id_col, "field", "text", "size", "a.*")
        # read for the hits and for the next step
        met = materialise(ahead.join(own_exchange(steps.select("node", "step", "tokens", "query", "next")), ["node", "step", "tokens"])
                          .select(*place, "step", "query", "next"), "positions")
        hits = hits.unionByName(met.where("query is not null").select(
            id_col, "field", "size", "pos", "query", (F.col("step") + depth).alias("n")))
        on, depth = met.where("next is not null").select(*place, F.col("next").alias("node")), 2 * depth
    return hits


def keyterm_hits(texts: DataFrame, queries: DataFrame, id_col: str = "doc_id",
                 fields: Sequence[str] = ("body",), mode: str = "token") -> DataFrame:
    """Count every query in every cleaned text field.

    ``texts`` holds ``id_col`` and one cleaned, single-space joined string per field.
    ``queries`` is the output of :func:`prepare_queries`.

    ``mode='token'``: greedy non-overlapping token-sequence matches (a hit at the start
    or end of the text counts). ``mode='padded'``: the reference's count of the query
    padded with one space, i.e. hits touching either end are dropped and adjacent
    repeats share a separator.

    Returns ``(id_col, field string, query string, cnt bigint)`` with only ``cnt > 0``.
    """
    if mode not in ("token", "padded"):
        raise ValueError("mode must be 'token' or 'padded'")
    long = None
    for field in fields:
        part = texts.select(F.col(id_col), F.lit(field).alias("field"),
                            tokenize(F.col(field)).alias("toks"))
        long = part if long is None else long.unionByName(part)
    long = long.withColumn("text", F.xxhash64("toks"))  # tells texts of one id apart
    found = trie_hits(token_positions(long, id_col), long, query_trie(queries), queries, id_col)
    if mode == "padded":
        found = found.where((F.col("pos") > 0) & (F.col("pos") + F.col("n") < F.col("size")))
    free = _overlap_free(F.col("query"))
    # hits are dealt out by (text, field, query) before they are counted, so that the
    # join's partitioning by query is not reused and a frequent query can be split
    matched = found.repartition(id_col, "field", "query")
    need_fold = F.lit(True) if mode == "padded" else ~free
    gap = F.col("n") + (1 if mode == "padded" else 0)
    agg = matched.groupBy(id_col, "field", "query").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.first("n").alias("n"),
        F.first(need_fold).alias("fold"),
        F.collect_list(F.when(need_fold, F.col("pos"))).alias("ps"),
    )
    cnt = F.when(F.col("fold"), _greedy_count(F.array_sort("ps"), gap)).otherwise(F.col("n_hits"))
    return agg.select(id_col, "field", "query", cnt.cast("bigint").alias("cnt"))


def texts_with_query(texts: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Keep texts with at least one non-zero query count."""
    return texts.join(hits.where(F.col("cnt") != 0).select(id_col), id_col, "left_semi")


def queries_with_text(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Keep queries that hit at least one text."""
    return queries.join(hits.where(F.col("cnt") != 0).select("query"), "query", "left_semi")


def texts_per_query(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of distinct texts each query occurs in, ascending."""
    return (hits.where(F.col("cnt") > 0).groupBy("query")
            .agg(F.count_distinct(id_col).alias("n_texts"))
            .orderBy("n_texts", "query"))


def hits_wide(hits: DataFrame, queries: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """Optional wide view ``<field>-<query>`` columns (explicit, bounded pivot values)."""
    key = F.concat_ws("-", "field", "query")
    values = [f"{f}-{q}" for f in ("body", "attachment") for q in queries]
    return (hits.withColumn("key", key).groupBy(id_col).pivot("key", values)
            .agg(F.sum("cnt")).na.fill(0))


def raw_keyword_counts(texts: DataFrame, keywords: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text", keyword_col: str = "query",
                       keep: Sequence[str] = ()) -> DataFrame:
    """Raw keyword matrix in long form: plain substring counts of each keyword in the
    uncleaned text, rows with a non-zero count only, with the text's ``keep`` columns
    (date, URL, ...).

    Texts and keywords are cut at single blanks; :class:`PhraseSearch` finds the pieces that
    hold a keyword without a blank and the runs of pieces that hold one with blanks. Counts
    in a piece are summed per text; runs that share characters are folded from left to
    right. There is no limit on the keywords.
    """
    found = PhraseSearch(texts.select(id_col, F.split(F.col(text_col), " ").alias("pieces")), keywords, keyword_col, id_col)
    in_piece = found.in_pieces().select(
        id_col, F.col("phrase").alias("keyword"), (F.col("times") * substring_count(F.col("piece"), F.col("phrase"))).alias("cnt"))
    # two hits share characters if they share more than the piece between them has room for
    hit = F.struct("pos", F.expr("length(a) + length(b) > length(last)").alias("tight"))
    fold = F.expr("""aggregate(array_sort(hits), named_struct('free', 0, 'edge', -1, 'tight', false, 'c', 0L),
        (acc, h) -> if(h.pos > acc.edge OR (h.pos = acc.edge AND NOT acc.tight),
            named_struct('free', 0, 'edge', h.pos + k - 1, 'tight', h.tight, 'c', acc.c + 1L), acc),
        acc -> acc.c)""")
    across = (found.phrase_runs().groupBy(id_col, F.col("phrase").alias("keyword"), "k").agg(F.collect_list(hit).alias("hits"))
              .select(id_col, "keyword", fold.alias("cnt")))
    out = in_piece.unionByName(across).groupBy(id_col, "keyword").agg(F.sum("cnt").alias("cnt"))
    return out.join(texts.select(id_col, *keep), id_col) if keep else out


def observe_counts(df: DataFrame, name: str):
    """Row count of ``df`` collected as a side metric of the next action that runs over
    it (Spark ``Observation``; no extra job). Returns ``(df, observation)``;
    ``observation.get["rows"]`` is available after that action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
