"""Correspondence graphs as edge tables ``(src, dst, weight)``: construction,
contraction, periods, degree / closeness / betweenness centrality, reciprocity,
foreground selection, induced subgraphs, thickness and node weight.

Path-based measures run over batches of sources, so their state is bounded whatever the
graph: closeness keeps one row (64 sources, node) with the sources that reached the node as
the bits of a number, betweenness one row (source, node) with its path count, and a batch has
as many sources as ``STATE_ROWS`` rows allow. Each BFS level is one join and one aggregation;
levels are checkpointed into the shared folder, so lineage stays short and lost executors
recompute little. Only sums per node go from batch to batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiflow.session import cut_lineage, dense_index, materialise

CHECKPOINT_EVERY = 4
#: Most rows of state of one batch of sources (a single source needs a row for each node in any case).
STATE_ROWS = 100_000_000
WORD = 64  # sources that share a row in closeness


def digraph(messages: DataFrame, src_col: str = "sender_domain", dst_col: str = "receiver_domain",
            by: Sequence[str] = ()) -> DataFrame:
    """Sender -> receiver digraph, weight = number of messages; rows missing an end are
    dropped. A receiver column holding an array is exploded first."""
    dst = F.col(dst_col)
    if dict(messages.dtypes).get(dst_col, "").startswith("array"):
        messages = messages.withColumn(dst_col, F.explode(dst))
    m = messages.where(F.col(src_col).isNotNull() & F.col(dst_col).isNotNull())
    return m.groupBy(*by, F.col(src_col).alias("src"), F.col(dst_col).alias("dst")) \
        .agg(F.count(F.lit(1)).alias("weight"))


def contract(edges: DataFrame, node_attr: DataFrame, keep_unmapped: bool = False,
             node: str = "node", attr: str = "attr", by: Sequence[str] = ()) -> DataFrame:
    """Contract nodes by an attribute ``(node, attr)``; weights of merged edges are
    summed. Nodes without attribute are dropped (``keep_unmapped=True`` keeps them
    under their own name)."""
    na = node_attr.select(F.col(node).alias("_n"), F.col(attr).alias("_a")).distinct()
    how = "left" if keep_unmapped else "inner"
    s = na.select(F.col("_n").alias("_sn"), F.col("_a").alias("_sa"))
    d = na.select(F.col("_n").alias("_dn"), F.col("_a").alias("_da"))
    j = edges.join(s, edges["src"] == s["_sn"], how).join(d, F.col("dst") == d["_dn"], how)
    sa = F.coalesce("_sa", "src") if keep_unmapped else F.col("_sa")
    da = F.coalesce("_da", "dst") if keep_unmapped else F.col("_da")
    return j.groupBy(*by, sa.alias("src"), da.alias("dst")).agg(F.sum("weight").alias("weight"))


def with_period(messages: DataFrame, periods: Sequence[tuple[int, int]], year_col: str = "sent_year") -> DataFrame:
    """Label each message with the first half-open period ``[lo, hi)`` containing its
    year (``"lo-hi"``); messages outside every period are dropped."""
    label = None
    for lo, hi in periods:
        cond = (F.col(year_col) >= lo) & (F.col(year_col) < hi)
        label = (F.when(cond, F.lit(f"{lo}-{hi}")) if label is None
                 else label.when(cond, F.lit(f"{lo}-{hi}")))
    return messages.withColumn("period", label).where(F.col("period").isNotNull())


def nodes(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (edges.select(*by, F.col("src").alias("node"))
            .unionByName(edges.select(*by, F.col("dst").alias("node"))).distinct())


def degree_centrality(edges: DataFrame) -> DataFrame:
    """``(in + out) / (n - 1)``; a self-loop adds 2."""
    n = nodes(edges).count()
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    deg = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    scale = 1.0 / (n - 1) if n > 1 else 1.0
    return deg.select("node", (F.col("degree") * F.lit(scale)).alias("centrality"))


def out_edges(edges: DataFrame) -> DataFrame:
    """Number of out-edges per node (exact node match), 0 for sinks."""
    cnt = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    return nodes(edges).join(cnt, "node", "left").select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"))


def node_weight(edges: DataFrame) -> DataFrame:
    """Weighted degree (sum of in- and out-edge weights)."""
    ends = edges.select(F.col("src").alias("node"), "weight") \
        .unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("node_weight"))


def edge_thickness(edges: DataFrame, exponent: float = 1 / 3) -> DataFrame:
    t = F.cbrt("weight") if abs(exponent - 1 / 3) < 1e-12 else F.pow("weight", exponent)
    return edges.withColumn("thickness", t)


def reciprocal_edges(edges: DataFrame) -> DataFrame:
    """Flag edges whose reverse edge exists (a self-loop is its own reverse)."""
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("_r", F.lit(True))
    return (edges.join(rev, ["src", "dst"], "left")
            .withColumn("reciprocal", F.coalesce("_r", F.lit(False))).drop("_r"))


def foreground_edges(edges: DataFrame, k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Flag edges whose thickness is at least the k-th largest thickness (ties kept).

    Without groups the threshold is a distributed top-k (TakeOrderedAndProject); with
    groups (e.g. periods) a window partitioned by the group ranks the edges."""
    t = edge_thickness(edges)
    if not by:
        thr = t.orderBy(F.desc("thickness")).limit(k).agg(F.min("thickness")).first()[0]
        return t.withColumn("foreground", F.col("thickness") >= F.lit(thr))
    w = Window.partitionBy(*by).orderBy(F.desc("thickness"))
    thr = (t.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
           .groupBy(*by).agg(F.min("thickness").alias("_thr")))
    return (t.join(thr, list(by)).withColumn("foreground", F.col("thickness") >= F.col("_thr"))
            .drop("_thr"))


def induced_subgraph(edges: DataFrame, node_set: DataFrame) -> DataFrame:
    """Edges with both ends in ``node_set`` (column ``node``)."""
    ns = node_set.select("node").distinct()
    return (edges.join(ns.withColumnRenamed("node", "src"), "src", "left_semi")
            .join(ns.withColumnRenamed("node", "dst"), "dst", "left_semi"))


def edges_of_node(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("src") == node) | (F.col("dst") == node))


def edges_excluding(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    return edges.join(excluded.select("src", "dst"), ["src", "dst"], "left_anti")


def edge_weight_limits(edges: DataFrame) -> DataFrame:
    """Min and max weight over all given edges and their cube roots."""
    return edges.agg(F.min("weight").alias("w_min"), F.max("weight").alias("w_max")) \
        .select("w_min", "w_max", F.cbrt("w_min").alias("t_min"), F.cbrt("w_max").alias("t_max"))


# --- shortest paths ----------------------------------------------------------------------

def shortest_paths(edges: DataFrame, max_levels: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """BFS on the unweighted digraph from all nodes or from ``sources`` (column ``node``):
    ``(s, v, d, sigma)`` with ``sigma`` the number of shortest s->v paths (``(s, s, 0, 1)``
    included).

    One join + aggregation per level: the frontier (pairs at distance d) is joined with
    the edges, path counts are summed per (s, v), and pairs already reached are removed
    with an anti join against the visited table.
    """
    edges = cut_lineage(edges.select("src", "dst"))  # small edge table, materialised once
    e = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    nd = nodes(edges) if sources is None else sources
    frontier = nd.select(F.col("node").alias("s"), F.col("node").alias("v"),
                         F.lit(0).alias("d"), F.lit(1).cast("bigint").alias("sigma"))
    frontier = cut_lineage(frontier)
    visited = frontier
    level = 0
    while True:
        level += 1
        if max_levels is not None and level > max_levels:
            break
        nxt = (frontier.join(e, frontier["v"] == e["src"])
               .groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
               .join(visited.select("s", "v"), ["s", "v"], "left_anti")
               .select("s", "v", F.lit(level).alias("d"), "sigma"))
        nxt = cut_lineage(nxt)
        if nxt.isEmpty():
            break
        visited = visited.unionByName(nxt)
        if level % CHECKPOINT_EVERY == 0:
            visited = cut_lineage(visited)
        frontier = nxt
    return visited


def _batches(n_nodes: int, per_row: int, state_rows: int):
    """(first, end) numbers of the sources of each batch: ``state_rows`` rows of state with ``per_row`` sources each."""
    size = max(1, state_rows // max(n_nodes, 1)) * per_row
    return [(i, min(i + size, n_nodes)) for i in range(0, n_nodes, size)]


def _added(total: DataFrame | None, part: DataFrame, columns: Sequence[str], tag: str) -> DataFrame:
    """Sums per node so far and of one more batch, written."""
    both = part if total is None else total.unionByName(part)
    return materialise(both.groupBy("node").agg(*[F.sum(c).alias(c) for c in columns]), tag)


def reach_counts(edges: DataFrame, state_rows: int = STATE_ROWS) -> DataFrame:
    """``(node, r, tot)``: nodes that reach the node (itself included) and the sum of their distances.

    Sources are numbered; 64 of them are the bits of one number. A level joins the rows whose
    bits are new with the edges, ors the bits per (word, node) and takes off those seen.
    """
    edges = cut_lineage(edges.select("src", "dst"))
    e = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    numbered = dense_index(nodes(edges), "node", "no")
    total = None
    for first, end in _batches(numbered.count(), WORD, state_rows):
        own = numbered.where((F.col("no") >= first) & (F.col("no") < end))
        new = own.select(F.floor(F.col("no") / WORD).alias("word"), "node",
                         F.expr(f"shiftleft(1L, cast(no % {WORD} as int))").alias("bits"))
        new = seen = cut_lineage(new)
        reached = new.select("node", F.lit(1).cast("long").alias("r"), F.lit(0).cast("long").alias("tot"))
        level = 0
        while True:
            level += 1
            met = (new.join(e, new["node"] == e["src"]).groupBy("word", F.col("dst").alias("node"))
                   .agg(F.bit_or("bits").alias("bits")))
            after = (met.join(seen.withColumnRenamed("bits", "old"), ["word", "node"], "left")
                     .withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))))
                     .where("bits != 0").select("word", "node", "bits"))
            new = cut_lineage(after)
            if new.isEmpty():
                break
            n = F.bit_count("bits").cast("long")
            reached = reached.unionByName(new.select("node", n.alias("r"), (n * level).alias("tot")))
            seen = seen.unionByName(new).groupBy("word", "node").agg(F.bit_or("bits").alias("bits"))
            if level % CHECKPOINT_EVERY == 0:
                seen = cut_lineage(seen)
                reached = cut_lineage(reached.groupBy("node").agg(F.sum("r").alias("r"), F.sum("tot").alias("tot")))
        total = _added(total, reached, ("r", "tot"), "reach")
    return total if total is not None else numbered.select("node", F.lit(1).cast("long").alias("r"), F.lit(0).cast("long").alias("tot"))


def closeness_centrality(edges: DataFrame, paths: DataFrame | None = None, state_rows: int = STATE_ROWS) -> DataFrame:
    """Closeness with incoming distances, scaled by the reachable share:
    ``((r-1)/Σd) · ((r-1)/(n-1))``; 0 when nothing reaches the node."""
    edges = cut_lineage(edges.select("src", "dst"))
    n = nodes(edges).count()
    g = (reach_counts(edges, state_rows) if paths is None else
         paths.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("r"), F.sum("d").alias("tot")))
    scale = F.lit(float(n - 1) if n > 1 else 1.0)
    c = F.when(F.col("tot") > 0, ((F.col("r") - 1) / F.col("tot")) * ((F.col("r") - 1) / scale)) \
        .otherwise(F.lit(0.0))
    return g.select("node", c.alias("centrality"))


def betweenness_centrality(edges: DataFrame, paths: DataFrame | None = None, normalized: bool = True,
                           state_rows: int = STATE_ROWS) -> DataFrame:
    """Directed, unweighted betweenness, summed over batches of sources.
    Normalised by ``1/((n-1)(n-2))`` when n > 2."""
    edges = cut_lineage(edges.select("src", "dst"))
    nd = nodes(edges)
    if paths is not None:
        n, total = nd.count(), path_dependencies(edges, paths)
    else:
        numbered = dense_index(nd, "node", "no")
        n, total = numbered.count(), None
        batches = _batches(n, 1, state_rows)
        for first, end in batches:
            own = numbered.where((F.col("no") >= first) & (F.col("no") < end)).select("node")
            part = path_dependencies(edges, shortest_paths(edges, sources=own))
            total = part if len(batches) == 1 else _added(total, part, ("b",), "betweenness")
    scale = 1.0 / ((n - 1) * (n - 2)) if (normalized and n > 2) else 1.0
    if total is None:
        return nd.select("node", F.lit(0.0).alias("centrality"))
    return (nd.join(total, "node", "left")
            .select("node", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("centrality")))


def path_dependencies(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """``(node, b)``: the shares of the shortest paths of ``paths`` that pass through each node.

    Brandes' dependency accumulation, one level at a time from the farthest level back to
    the sources: ``δ_s(v) = Σ_{v->w, d(s,w) = d(s,v)+1} σ_sv/σ_sw · (1 + δ_s(w))``."""
    paths = cut_lineage(paths)
    e = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    max_d = paths.agg(F.max("d")).first()[0] or 0
    delta = None  # (s, w, sigma_w, delta_w) for the level above
    contribs = []
    for lvl in range(max_d, 0, -1):
        at = paths.where(F.col("d") == lvl).select("s", F.col("v").alias("w"), F.col("sigma").alias("sw"))
        if delta is not None:
            at = at.join(delta, ["s", "w"], "left").select("s", "w", "sw", F.coalesce("dw", F.lit(0.0)).alias("dw"))
        else:
            at = at.withColumn("dw", F.lit(0.0))
        prev = paths.where(F.col("d") == lvl - 1).select("s", F.col("v").alias("v"), F.col("sigma").alias("sv"))
        back = (at.join(e, at["w"] == e["dst"]).select("s", F.col("src").alias("v"), "sw", "dw")
                .join(prev, ["s", "v"])
                .groupBy("s", "v").agg(F.sum(F.col("sv") / F.col("sw") * (1 + F.col("dw"))).alias("dw")))
        back = cut_lineage(back)
        contribs.append(back.where(F.col("s") != F.col("v")).select("v", "dw"))
        delta = back.select("s", F.col("v").alias("w"), "dw")
    none = paths.select(F.col("v").alias("node"), F.lit(0.0).alias("b")).limit(0)
    for c in contribs:
        none = none.unionByName(c.select(F.col("v").alias("node"), F.col("dw").alias("b")))
    return none.groupBy("node").agg(F.sum("b").alias("b"))
