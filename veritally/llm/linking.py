"""Connected groups from posting lists, without all pairs of any list.

Nodes that share a key are candidates; ``verify`` says which candidate pairs are links. The
components equal those of verifying every pair of every list, yet a list of n nodes that
belong together costs n candidates:

1. each list proposes its members against one hub, the member of the highest priority (a list
   of two is its pair, told from sums over the list);
2. components of the verified links are found;
3. lists that still hold several components propose a second hub to the members of other
   components; and
4. what is then still open is paired across components only. A pair within one component can
   add nothing, so leaving it out is exact. Nodes have sizes, and linked ones differ by a
   ratio at most, so a list is first cut into bands of size, of which neighbours alone meet:
   this spreads a hot list over tasks and spares most of its pairs; a sketch of each node,
   compared within the join, lets out only those pairs that can be links. Or ``rest`` takes
   the members that are left, a list at a time, and gives links that join their components.

Only keys and nodes are shuffled with the posts. What a cheap condition, which every link meets,
needs to know of the nodes is fetched for distinct pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.tables import bloom_filters, drop, free, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b); component is the smallest node.

    Each step takes the least label around a node and then the label of that label, so
    chains shorten by halves. Labels only fall, so their sum tells the end. All joins read
    written tables, so Spark can split hot nodes. Empty edges give an empty table.
    """
    pairs = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])).alias("p")
    both = materialise(edges.select(pairs).select("p.a", "p.b").distinct(), "edges")
    labels, total = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "labels"), None
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("component"))
        near = materialise(near, "near")
        up = near.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = materialise(near.join(up, "component").select("node", F.least("component", "above").alias("component")), "labels")
        drop(labels, near)
        labels, was, total = new, total, new.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == was:
            drop(both)
            return labels


def band_of(ratio: float) -> Column:
    """Nodes of sizes within the ratio are in one band or in neighbouring ones."""
    return F.floor(F.log("size") / -log(ratio))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found with the components that new links (a, b) join, by a graph of components alone."""
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    ends = [F.coalesce(f"of_{x}", x).alias(x) for x in "ab"]
    merged = components(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(*ends).where("a <> b").distinct())
    old = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    out = materialise(old.unionByName(merged.join(found.select("node"), "node", "left_anti")), "labels")
    drop(merged)
    return out


def link(posts: DataFrame, verify: Callable[[DataFrame], DataFrame], ratio: float, near: Callable[[DataFrame], DataFrame] | None = None, sketches: DataFrame | None = None, close: Column | None = None, hubs: int = 2, keyed: bool = False, rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of all nodes with a link.

    posts: (key, node, pri, size), from a written table, without repeated (key, node); a higher
    pri (from 0) makes a likelier hub; the smaller of two linked nodes has ``ratio`` of the other's
    size (an integer from 1) at least. near may thin out distinct pairs (a, b) by what every link
    meets; sketches (node, sketch, ...) and close, a condition over size, sketch, other_size and other_sketch, do so
    within the join of step 4. verify takes such pairs, materialised, and returns the links;
    if keyed, each comes with one key that it shares and with both sizes' sum (a, b, key, sizes). rest does step 4
    instead: of members (key, node, component, size) it gives pairs (a, b, key, size, other_size) that join all
    components which any link of two members of a list joins.
    """
    ratio = 0.999 * ratio  # sizes at the very ratio stay in
    more = ["key", (F.col("size").cast("long") + F.col("other_size")).alias("sizes")] if keyed else []

    def links(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)
        pairs = pairs.groupBy("a", "b").agg(F.min("key").alias("key"), F.max("sizes").alias("sizes")) if keyed else pairs.distinct()
        pairs = materialise(near(pairs) if near else pairs, "near-pairs")
        found = materialise(verify(pairs), "links")
        drop(pairs)
        free(posts.sparkSession)
        return found

    like = f"least(size, other_size) >= {ratio} * greatest(size, other_size)"
    # a hub is told by 15 bits of its priority and 48 of its node
    rank = F.expr("(least(cast(512 * log2(1 + pri) as bigint), 32767L) * 281474976710656L) + (node & 281474976710655L)")
    lists = posts.groupBy("key").agg(F.count("*").alias("n"), F.max(rank).alias("top"), F.min("node").alias("low"), F.bit_xor("node").alias("both"), F.min("size").alias("size"), F.max("size").alias("other_size")).where("n > 1")
    lists = materialise(lists, "lists")
    twos = lists.where("n = 2").where(like).select(F.col("low").alias("a"), F.expr("low ^ both").alias("b"), "key", "size", "other_size")
    # a list of two is done; longer ones can hold links that their hub has no part in
    with bloom_filters(posts.sparkSession):
        members = posts.join(lists.where("n > 2").select("key", "top").hint("merge"), "key").select("key", "node", "pri", "size", (rank == F.col("top")).alias("hub"))
        members = materialise(members, "members")
    hub = members.where("hub").select("key", F.col("node").alias("b"), F.col("size").alias("other_size"))
    star = members.select("key", F.col("node").alias("a"), "size").join(hub, "key").where("a <> b").where(like).select("a", "b", "key", "size", "other_size")
    edges = links(twos.unionByName(star))
    drop(lists)
    found = components(edges)
    drop(edges)
    best_of = F.max(F.struct("pri", "node", "component", "size"))
    top = [F.col("top.node").alias("b"), F.col("top.component").alias("other"), F.col("top.size").alias("other_size")]
    for step in range(1, hubs + 1):  # the last one pairs what is still open
        of = materialise(members.select("key", "node", "pri", "size").join(found, "node", "left").select("key", "node", "pri", "size", F.coalesce("component", "node").alias("component")), "of")
        state = of.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("pri", "node", "component")).alias("top")).where("low < high")
        state = materialise(state.select("key", F.col("top.component").alias("main")), "open")
        if not state.limit(1).count():
            drop(of, state)
            break
        left = materialise(of.join(state, "key").withColumn("band", band_of(ratio)), "left")
        mine = left.select("key", F.col("node").alias("a"), "component", "size", "band")
        if step < hubs:  # the best member outside the first hub's component meets those of others
            best = left.where("component <> main").groupBy("key").agg(best_of.alias("top")).select("key", *top)
            pairs = mine.join(best, "key").where("component <> other")
        elif rest is not None:
            pairs = rest(left.select("key", "node", "component", "size"))
        else:
            more_of = []
            if sketches is not None:
                left, plain = materialise(left.join(sketches, "node"), "left"), left
                drop(plain)
                more_of = [c for c in sketches.columns if c != "node"]
            mine = left.select("key", F.col("node").alias("a"), "component", "size", "band", *more_of)
            bands = F.explode(F.array(F.struct("band", F.lit(True).alias("own")), F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("own")))).alias("x")
            best = left.select("key", F.col("node").alias("b"), F.col("component").alias("other"), F.col("size").alias("other_size"), *[F.col(c).alias(f"other_{c}") for c in more_of], bands).select("key", "b", "other", "other_size", *[f"other_{c}" for c in more_of], "x.band", "x.own")
            pairs = mine.join(best, ["key", "band"]).where("component < other or (component <> other and not own)").where(like)
            pairs = pairs if close is None else pairs.where(close)
        new = links(pairs.where(like))
        drop(of, state, left)
        if new.limit(1).count():
            found, old = _joined(found, new), found
            drop(old)
        drop(new)
    drop(members)
    return found
