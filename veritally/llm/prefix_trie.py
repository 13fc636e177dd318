"""Prefix trie of conversations, rolled up by centroid decomposition.

Turns are digested where they are read; the prefix of each conversation and depth is told by the
exclusive or of hashes of (depth, digest) up to it (128 bits), so prefixes are had by windows
over ranges, without a conversation in one task, and the parent's key from a node's own. A node
is named by its smallest member and its depth: the ancestors of (c, d) are on c's path.

The parent-edge forest is one component at first. A component of more than ``local`` nodes is
split at its centroid, the deepest node that holds more than half of it: each of the centroid's children
tops a component, the rest is one, and none has more than half. The totals of the centroid's
part are added along the path from it to its component's top, which is then that much smaller. So each node
is touched once a level, and there are no more levels than halvings, whatever the depth of the trie. Components
of at most ``local`` nodes are summed locally, many in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm.places import ranked
from veritally.llm.sqltext import crc32_sql
from veritally.llm.tables import drop, materialise

#: Conversations of one family of SHARE take their first turns, up to HEADS - 1 of them, from its first one.
SHARE, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Nodes of a component that is summed in a task, nodes of such a task, ids of a chunk that is hashed at once, depths of a stretch of a path.
LOCAL, TASK, CHUNK, STRETCH = 4096, 50_000, 4096, 256
NODE, TOP = ["conv_id", "depth"], ["top_conv", "top_depth"]


def heads(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: (conv_id, depth, digest, words, block), the rebuilt turns from depth 1, and (conv_id, len) of all conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    turns = materialise(turns, "turns")
    own = ranked(turns, ["conv_id"], ["turn", "digest", "row"], "turns")
    first = materialise(own.where(f"conv_id % {SHARE} = 0 and pos < {HEADS - 1}").select(F.col("conv_id").alias("base"), "pos", "digest", "words"), "heads")
    given = first.groupBy("base").agg(F.count("*").alias("n_base"))
    chats = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", heads(F.col("conv_id"))).withColumn("base", F.expr(f"conv_id - conv_id % {SHARE}"))
    chats = chats.join(given, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    chats = materialise(chats.select("conv_id", "base", "h", "m", F.expr("m + greatest(n - h, 0)").alias("len")), "chats")
    lead = chats.where("m > 0").join(first, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "words", F.lit(-1).cast("long").alias("block"))
    rest = own.where(F.col("pos") >= heads(F.col("conv_id"))).join(chats.select("conv_id", "h", "m"), "conv_id").select("conv_id", F.expr("pos - h + m + 1").alias("depth"), "digest", "words", "block")
    out = materialise(lead.unionByName(rest), "rebuilt")
    drop(turns, own, first)
    return out, chats


def members(turns: DataFrame, chats: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, last): the node of every conversation at every depth by key, and its parent's key."""
    turns = turns.withColumn("t1", F.xxhash64("depth", "digest")).withColumn("t2", F.xxhash64("digest", "depth")).drop("digest")
    blocks = turns.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = turns.join(blocks, ["conv_id", "block"])
    keyed = keyed.select("conv_id", "depth", "words", "t1", "t2", *[F.bit_xor(f"t{i}").over(upto).bitwiseXOR(F.col(f"b{i}")).alias(f"k{i}") for i in (1, 2)])
    keyed = keyed.join(chats.select("conv_id", "len"), "conv_id")
    keyed = keyed.select("conv_id", "depth", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"t{i}")).alias(f"p{i}") for i in (1, 2)], "words", (F.col("depth") == F.col("len")).alias("last"))
    zero = F.lit(0).cast("long")
    roots = chats.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"), (F.col("len") == 0).alias("last"))
    return materialise(keyed.unionByName(roots), "members")


def forest(of: DataFrame, chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: the nodes (conv_id, depth, parent_conv_id, n_convs, n_children, size, leaves, saved), and the
    paths (conv_id, depth, first, above, last): the name of each conversation's node at each depth and of its parent.

    size, the nodes of a subtree, comes from the members: conversation m owns the nodes it names, all in one
    piece of its path, and those are in the subtree of each other node that it passes through.
    """
    nodes = of.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = materialise(nodes, "nodes")
    key = ["depth", "k1", "k2"]
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = materialise(nodes.join(parent, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "named")
    paths = of.select("conv_id", *key, "last").join(named.select(*key, F.col("conv_id").alias("first"), F.col("parent_conv_id").alias("above")), key)
    paths = materialise(paths.select("conv_id", "depth", "first", "above", "last"), "paths")
    owns = named.groupBy("conv_id").agg(F.count("*").alias("owns"))
    other = paths.join(owns, "conv_id").groupBy(F.col("first").alias("conv_id"), "depth").agg(F.sum("owns").alias("others"))
    children = named.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = named.join(other, NODE).join(children, NODE, "left").join(owns, "conv_id").join(chats.select("conv_id", "len"), "conv_id")
    tree, zero = tree.withColumn("n_children", F.coalesce("n_children", F.lit(0))), F.lit(0).cast("long")
    tree = tree.select(*NODE, "parent_conv_id", "n_convs", "n_children", F.expr("len - depth + 1 + others - owns").alias("size"), F.expr("cast(n_children = 0 as bigint)").alias("leaves"), F.expr("(n_convs - 1) * words").alias("saved"), zero.alias("top_conv"), zero.alias("top_depth"))
    tree = materialise(tree, "tree")
    drop(nodes, named)
    return tree, paths


def _locally(small: DataFrame, task: int) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of the nodes of small components: sums of their subtrees there, and what was added."""
    schema = "conv_id long, depth long, n_leaves long, saved_tokens long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("depth", kind="stable", ignore_index=True)
        at = pd.MultiIndex.from_frame(pdf[[*TOP, *NODE]])
        up = at.get_indexer(pd.MultiIndex.from_arrays([pdf["top_conv"], pdf["top_depth"], pdf["parent"], pdf["depth"] - 1]))
        values, depth = pdf[["leaves", "saved"]].to_numpy(np.int64, copy=True), pdf["depth"].to_numpy()
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for a, b in reversed(list(zip([0, *cuts], [*cuts, len(depth)], strict=True))):
            mine = np.arange(a, b)[up[a:b] >= 0]
            np.add.at(values, up[mine], values[mine])
        values += pdf[["add_leaves", "add_saved"]].to_numpy(np.int64)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "depth": depth, "n_leaves": values[:, 0], "saved_tokens": values[:, 1]})

    tasks = max(1, -(-small.count() // task))
    small = small.withColumn("task", F.pmod(F.xxhash64(*TOP), F.lit(tasks))).select("task", *TOP, *NODE, F.coalesce("parent_conv_id", "conv_id").alias("parent"), "leaves", "saved", "add_leaves", "add_saved")
    return small.groupBy("task").applyInPandas(run, schema)


def roll_up(tree: DataFrame, paths: DataFrame, local: int = LOCAL, task: int = TASK) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): leaves and saved summed over every node's subtree, by centroid decomposition."""
    zero = F.lit(0).cast("long")
    live = tree.select(*NODE, "parent_conv_id", "size", "leaves", "saved", zero.alias("add_leaves"), zero.alias("add_saved"), *TOP)
    tables, done = [], []
    while True:
        totals = live.groupBy(*TOP).agg(F.max("size").alias("total"))  # a component's top holds all of it
        live = materialise(live.join(totals, TOP), "components")
        tables.append(live)
        done.append(("small", live.where(F.col("total") <= local)))
        live = live.where(F.col("total") > local)
        cents = live.where("2 * size > total").groupBy(*TOP).agg(F.min(F.struct("size", "conv_id", "depth")).alias("z"))
        cents = materialise(cents.select(*TOP, F.col("z.conv_id").alias("z_conv"), F.col("z.depth").alias("z_depth"), F.col("z.size").alias("z_size")), "centroids")
        tables.append(cents)
        if not cents.limit(1).count():
            break
        # the child of the centroid on a node's path, if it is below the centroid
        child = paths.select("conv_id", (F.col("depth") - 1).alias("z_depth"), F.col("first").alias("child"), F.col("above").alias("z_conv"))
        placed = live.drop("total").join(cents, TOP).join(child, ["conv_id", "z_depth", "z_conv"], "left")
        placed = placed.withColumn("is_z", F.expr("conv_id = z_conv and depth = z_depth")).withColumn("below", F.expr("is_z or (child is not null and depth > z_depth)"))
        placed = materialise(placed, "placed")
        parts = materialise(placed.where("below").groupBy(*TOP).agg(F.sum("leaves").alias("part_leaves"), F.sum("saved").alias("part_saved")), "parts")
        stretch = lambda c: F.floor(F.col(c) / STRETCH)
        spans = cents.where("z_depth > top_depth").withColumn("stretch", F.explode(F.sequence(stretch("top_depth"), F.floor((F.col("z_depth") - 1) / STRETCH))))
        steps = paths.select(F.col("conv_id").alias("z_conv"), "depth", "first", stretch("depth").alias("stretch"))
        upward = spans.join(steps, ["z_conv", "stretch"]).where("depth >= top_depth and depth < z_depth")
        upward = upward.join(parts, TOP).select(F.col("first").alias("conv_id"), "depth", F.col("z_size").alias("less"), "part_leaves", "part_saved")
        sunk = placed.where("is_z").join(parts, TOP).select(*NODE, (F.col("add_leaves") + F.col("part_leaves")).alias("n_leaves"), (F.col("add_saved") + F.col("part_saved")).alias("saved_tokens"))
        done.append(("sum", materialise(sunk, "sunk")))
        rest = placed.where("not is_z").join(upward, NODE, "left")
        plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
        new = F.when(F.col("below"), F.struct(F.col("child").alias("c"), (F.col("z_depth") + 1).alias("d"))).otherwise(F.struct(F.col("top_conv").alias("c"), F.col("top_depth").alias("d")))
        rest = rest.select(*NODE, "parent_conv_id", (F.col("size") - F.coalesce("less", F.lit(0))).alias("size"), "leaves", "saved", plus("add_leaves", "part_leaves").alias("add_leaves"), plus("add_saved", "part_saved").alias("add_saved"), new["c"].alias("top_conv"), new["d"].alias("top_depth"))
        live = materialise(rest, "split")
        tables += [placed, parts, live]
    small = done[0][1]
    for kind, t in done[1:]:
        small = small.unionByName(t) if kind == "small" else small
    out = _locally(small, task)
    for kind, t in done:
        out = out.unionByName(t) if kind == "sum" else out
    out = materialise(out, "rolled")
    drop(*tables, *[t for kind, t in done if kind == "sum"])
    return out


def ends(paths: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes where conversations end: SHA-256 of their ids, ascending, joined by commas.

    Ids are dealt by ranges and joined to chunks of at most ``chunk``. A node of one chunk is
    hashed as it is; of larger ones a task reads the chunks one after another and holds one.
    """
    by = ["first", "depth", "conv_id"]
    rows = paths.where("last").select(*by).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("chunk", F.floor(F.monotonically_increasing_id() / chunk))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = materialise(rows.groupBy("first", "depth", "chunk").agg(ids.alias("ids")), "chunks")
    per = chunks.groupBy(F.col("first").alias("conv_id"), "depth").agg(F.count("*").alias("n"), F.max_by("ids", "chunk").alias("ids"))
    per = materialise(per.select(*NODE, "n", F.when(F.col("n") == 1, F.sha2("ids", 256)).alias("ends_sha256")), "ends")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in frames:
            out = []
            for key in zip(pdf["conv_id"], pdf["depth"], pdf["ids"], strict=True):
                if key[:2] != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = key[:2], hashlib.sha256(key[2].encode())
                else:
                    state.update(b"," + key[2].encode())
            yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])

    large = chunks.withColumnRenamed("first", "conv_id").join(per.where("n > 1").select(*NODE), NODE).repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    large = large.select(*NODE, "ids").mapInPandas(run, "conv_id long, depth long, ends_sha256 string")
    out = materialise(per.where("n = 1").drop("n").unionByName(large), "ends")
    drop(chunks, per)
    return out


def prefix_trie(rows: DataFrame, local: int = LOCAL, task: int = TASK, chunk: int = CHUNK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie.

    rows (conv_id, turn, role, text, ...) are turns, in order of turn (null first; equal ones by the SHA-256 of
    their role and text); null roles and texts are empty, and repeated rows are turns of
    their own. Rows without conv_id belong to no conversation. conv_id is an integer. Every conversation c
    is rebuilt: the first h = crc32(c) % 4 turns of conversation c - c % 20 (as % truncates), then its own
    from h on. Other columns are ignored. An empty table gives an empty result, without a root.
    """
    turns, chats = rebuilt(rows)
    of = members(turns, chats)
    drop(turns)
    tree, paths = forest(of, chats)
    drop(of, chats)
    rolled, closed = roll_up(tree, paths, local, task), ends(paths, chunk)
    out = tree.join(rolled, NODE).join(closed, NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = materialise(out.select(*NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")), "trie")
    drop(tree, paths, rolled, closed)
    return out


#: The same nodes by comparing whole prefixes, for DuckDB.
ORACLE_SQL = f"""
with t as (select *, row_number() over (partition by conv_id order by turn nulls first, g) as pos from (select conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as g,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as words from conversations where conv_id is not null) x),
c as (select conv_id, conv_id - conv_id % {SHARE} as base, {crc32_sql("conv_id")} % {HEADS} as h from (select distinct conv_id from t) x),
r as (select c.conv_id, 0 as part, pos, g, words from c join t on t.conv_id = c.base and pos <= h union all select c.conv_id, 1, pos, g, words from c join t on t.conv_id = c.conv_id and pos > h),
s as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, g, words from r),
m as (select conv_id, depth, words, string_agg(g, '') over (partition by conv_id order by depth) as k from s union all select conv_id, 0, 0, '' from c),
n as (select depth, k, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words from m group by 1, 2),
p as (select m.conv_id as member, m.depth, n.conv_id as first from m join n using (depth, k)),
v as (select n.conv_id, n.depth, n.n_convs, n.words, p.first as parent_conv_id from n left join p on p.member = n.conv_id and p.depth = n.depth - 1),
ch as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from v where depth > 0 group by 1, 2),
w as (select v.*, coalesce(n_children, 0) as n_children from v left join ch using (conv_id, depth)),
sub as (select p.first as conv_id, p.depth, sum(cast(w.n_children = 0 as int)) as n_leaves, sum((w.n_convs - 1) * w.words) as saved_tokens from w join p on p.member = w.conv_id and p.depth <= w.depth group by 1, 2),
e as (select first as conv_id, depth, sha256(string_agg(cast(member as varchar), ',' order by member)) as ends_sha256 from p join (select member, max(depth) as depth from p group by 1) x using (member, depth) group by 1, 2)
select conv_id, depth, parent_conv_id, n_convs, n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from w join sub using (conv_id, depth) left join e using (conv_id, depth)
"""
