"""Merkle manifest of a dataset by cogrouped subtree exchange.

Leaves are digests of rows, taken in the JVM where the rows are read; texts are never shuffled.
Leaves of a source are numbered by ranges (``places.ranked``) and cut into superblocks of
FANOUT ** LEVELS consecutive ones, each a whole subtree. Upwards, a superblock becomes one
node, and the nodes are numbered and cut again, until each source has its subroot and the
subroots, as leaves of one more tree, the root: a table shrinks 4,096 times a step. Downwards,
every node gets the siblings outside its own superblock from its parent; at last the leaves and
those required outer nodes are cogrouped by superblock, where the local reduction, the joining
of proofs and the folding are finished together. Small trees share a superblock's task.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.places import ranked
from veritally.llm.sqltext import crc32_sql
from veritally.llm.tables import drop, materialise

FANOUT, LEVELS = 16, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 (lower-case hex) of the fields one after another: ``-`` for null, else byte count, ``:`` and value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[field(v.cast("string")) for v in values]), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str], total: int, fanout: int, most: int) -> list[list[str]]:
    """nodes and what they become, level by level; ``total`` nodes in the whole tree say when it has one left."""
    out = [nodes]
    while total > 1 and len(out) <= most:
        below = out[-1]
        out.append([h(below[i : i + fanout]) for i in range(0, len(below), fanout)])
        total = -(-total // fanout)
    return out


def siblings(tree: list[list[str]], at: int, fanout: int) -> tuple[list[str], list[str]]:
    """Of each level, the nodes left and right of the one at ``at`` in its run, joined."""
    left, right = [], []
    for level in tree[:-1]:
        run = at // fanout * fanout
        left.append("".join(level[run:at]))
        right.append("".join(level[at + 1 : run + fanout]))
        at //= fanout
    return left, right


def fold(leaf: str, left: list[str], right: list[str]) -> str:
    for a, b in zip(left, right, strict=True):
        leaf = h([a, leaf, b])
    return leaf


def _units(nodes: DataFrame, span: int) -> DataFrame:
    """nodes (tree, pos, total, ...) with sb, the superblock in the tree, and unit, the task's key.

    Trees of more than one superblock have units of their own (a collision only shares a task);
    the others are dealt by hash to as many units as their nodes fill.
    """
    small = nodes.where(F.col("total") <= span).agg(F.count("*").alias("n")).first().n
    few = F.pmod(F.xxhash64("tree"), F.lit(max(1, -(-small // span))))
    nodes = nodes.withColumn("sb", F.floor(F.col("pos") / span))
    return nodes.withColumn("unit", F.when(F.col("total") <= span, few).otherwise(F.xxhash64("tree", "sb")))


def _up(nodes: DataFrame, fanout: int, most: int) -> DataFrame:
    """(tree, pos, total, node) of the next step: one node of each superblock of (unit, tree, sb, pos, total, node)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (tree, sb), g in pdf.sort_values("pos").groupby(["tree", "sb"], sort=False):
            total = int(g["total"].iloc[0])
            got = levels(g["node"].tolist(), total, fanout, most)
            for _ in got[1:]:
                total = -(-total // fanout)
            out.append((tree, sb, total, got[-1][0]))
        return pd.DataFrame(out, columns=["tree", "pos", "total", "node"])

    return nodes.select("unit", "tree", "sb", "pos", "total", "node").groupBy("unit").applyInPandas(run, "tree string, pos long, total long, node string")


def _down(nodes: DataFrame, outer: DataFrame, fanout: int, most: int) -> DataFrame:
    """(tree, pos, left, right): all siblings of a step's nodes up to the root, outer ones by (tree, sb) from the step above."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        above = {(t, s): (le, ri) for t, s, le, ri in zip(b["tree"], b["sb"], b["left"], b["right"], strict=True)}
        out = []
        for key, g in a.sort_values("pos").groupby(["tree", "sb"], sort=False):
            tree = levels(g["node"].tolist(), int(g["total"].iloc[0]), fanout, most)
            for i, pos in enumerate(g["pos"]):
                left, right = siblings(tree, i, fanout)
                out.append((key[0], pos, left + list(above[key][0]), right + list(above[key][1])))
        return pd.DataFrame(out, columns=["tree", "pos", "left", "right"])

    return _exchange(nodes.select("unit", "tree", "sb", "pos", "total", "node"), outer, run, "tree string, pos long, left array<string>, right array<string>")


def _exchange(nodes: DataFrame, outer: DataFrame, run, schema: str) -> DataFrame:
    """Cogroup nodes with the outer siblings (tree, pos, left, right) of their superblocks, by unit."""
    where = nodes.groupBy("tree", "sb").agg(F.min("unit").alias("unit"))
    outer = materialise(where.join(outer.withColumnRenamed("pos", "sb"), ["tree", "sb"]).select("unit", "tree", "sb", "left", "right"), "required")
    return nodes.groupBy("unit").cogroup(outer.groupBy("unit")).applyInPandas(run, schema)


def manifest(docs: DataFrame, fanout: int = FANOUT, most: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs.

    H is the lower-case hex SHA-256 of its inputs, joined. A leaf is H of doc_id, source, lang,
    n_chars and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself. Leaves of
    a source stand by doc_id (null first) and equal ids by leaf; runs of ``fanout`` become their
    H until one node is left, the subroot. Subroots stand by source (null first, then bytewise)
    and give the root likewise. A proof is H of the siblings, level by level, left to right (of none: of
    nothing). folded_root is the root that a row's leaf and siblings give, where the leaf of every
    row whose unsigned crc32(doc_id) 5 divides is that of its text with A-Z in lower case; rows
    without doc_id and null texts are not tampered with. verified says whether it is the root.

    All columns of documents are needed, and others ignored, whatever their names. Repeated rows are
    leaves each. An empty table gives an empty result. No text is too long for a row: it is
    hashed where it is read.
    """
    span = fanout**most
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & (F.col("text") != tampered_text(F.col("text")))
    values = [F.col(c) for c in FIELDS]
    leaves = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"), leaf_digest(values).alias("node"),
        F.when(changed, leaf_digest([*values[:-1], tampered_text(F.col("text"))])).alias("other"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialise(leaves, "leaves")
    placed = ranked(leaves, ["tree"], ["doc_id", "node", "row"], "leaves")
    # ids go through pandas as text, since it has no integers beside nulls
    steps = [_step(placed.select("tree", "pos", F.col("doc_id").cast("string").alias("doc_id"), "node", "other"), fanout, most, "numbered")]
    subroots, height = None, 0
    while True:  # to the subroots, then to the root: 4,096 times fewer rows each time
        nodes = materialise(_up(steps[-1], fanout, most), "nodes")
        if nodes.where("total > 1").limit(1).count():
            steps.append(materialise(_units(nodes, span), "nodes"))
        elif subroots is None:
            subroots = nodes.select(F.lit("").alias("tree"), "node", F.col("tree").alias("source"))
            top = ranked(materialise(subroots, "subroots"), ["tree"], ["source"], "subroots")
            steps.append(_step(top.select("tree", "pos", "node", "source"), fanout, most, "sources"))
            height = len(steps) - 1
        else:
            root = nodes
            break
    root_digest = getattr(root.first(), "node", None)  # of one row
    outer = root.select("tree", "pos", F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"))
    for i in range(len(steps) - 1, 0, -1):
        outer = materialise(_down(steps[i], outer, fanout, most), "outer")
        if i == height:  # from the tree of sources to the trees of leaves
            outer = materialise(outer.join(steps[i].select("tree", "pos", "source", F.col("node").alias("subroot")), ["tree", "pos"]).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "left", "right"), "outer")
    out = _proved(steps[0], outer, fanout, most)
    sub = steps[height].select(F.col("source").alias("tree"), F.col("node").alias("subroot"))
    out = out.join(sub, "tree").withColumn("root", F.lit(root_digest).cast("string")).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    out = out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    out = materialise(out, "manifest")
    drop(leaves, *steps)
    return out


def _step(placed: DataFrame, fanout: int, most: int, name: str) -> DataFrame:
    """Numbered nodes with the size of their tree and their superblock, written."""
    totals = placed.groupBy("tree").agg(F.count("*").alias("total"))
    counted = materialise(placed.join(totals, "tree"), name)
    out = materialise(_units(counted, fanout**most), name)
    drop(counted)
    return out


def _proved(leaves: DataFrame, outer: DataFrame, fanout: int, most: int) -> DataFrame:
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        above = {(t, s): (list(le), list(ri)) for t, s, le, ri in zip(b["tree"], b["sb"], b["left"], b["right"], strict=True)}
        parts = []
        for key, g in a.sort_values("pos").groupby(["tree", "sb"], sort=False):
            nodes = g["node"].tolist()
            tree = levels(nodes, int(g["total"].iloc[0]), fanout, most)
            proofs, folded = [], []
            for i, (leaf, other) in enumerate(zip(nodes, g["other"], strict=True)):
                left, right = siblings(tree, i, fanout)
                left, right = left + above[key][0], right + above[key][1]
                proofs.append(h([x for pair in zip(left, right, strict=True) for x in pair]))
                folded.append(fold(other if isinstance(other, str) else leaf, left, right))
            parts.append(pd.DataFrame({"doc_id": g["doc_id"], "tree": key[0], "leaf": nodes, "proof_sha256": proofs, "folded_root": folded}))
        return pd.concat(parts)

    return _exchange(leaves, outer, run, "doc_id string, tree string, leaf string, proof_sha256 string, folded_root string")


def oracle_sql(deep: int = 4) -> str:
    """The same rows in SQL for DuckDB, for up to FANOUT ** deep leaves of a source, and sources."""
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in [*FIELDS[:-1], text]) + ")"
    ctes = [f"""leaves as (select doc_id, coalesce('=' || source, '') as tree, {leaf("text")} as leaf,
 case when doc_id is not null and text is not null and {crc32_sql("doc_id")} % 5 = 0 then {leaf(low)} else {leaf("text")} end as given from documents)""",
        "placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from leaves)",
        "a0 as (select tree, pos, leaf as d, count(*) over (partition by tree) as n from placed)"]

    def tree(x: str) -> None:
        for k in range(deep):
            ctes.append(f"""{x}s{k} as (select tree, pos, n, coalesce(string_agg(d, '') over (partition by tree, pos // {FANOUT} order by pos rows between unbounded preceding and 1 preceding), '') as l,
 coalesce(string_agg(d, '') over (partition by tree, pos // {FANOUT} order by pos rows between 1 following and unbounded following), '') as r from {x}{k})""")
            ctes.append(f"{x}{k + 1} as (select tree, pos // {FANOUT} as pos, case when max(n) > 1 then sha256(string_agg(d, '' order by pos)) else max(d) end as d, (max(n) + {FANOUT - 1}) // {FANOUT} as n from {x}{k} group by 1, 2)")

    tree("a")
    ctes.append(f"sources as (select tree as source, d, row_number() over (order by tree) - 1 as nth from a{deep})")
    ctes.append("b0 as (select '' as tree, nth as pos, d, count(*) over () as n from sources)")
    tree("b")
    ctes.append("f0 as (select placed.doc_id, leaf, placed.tree, placed.pos, nth, sources.d as subroot, given as f, '' as proof from placed join sources on placed.tree = sources.source)")
    for i in range(2 * deep):
        x, k = ("a", i) if i < deep else ("b", i - deep)
        on = f"s.tree = f.tree and s.pos = f.pos // {FANOUT**k}" if x == "a" else f"s.pos = f.nth // {FANOUT**k}"
        ctes.append(f"f{i + 1} as (select doc_id, leaf, f.tree, f.pos, nth, subroot, case when s.n > 1 then sha256(s.l || f.f || s.r) else f.f end as f, proof || s.l || s.r as proof from f{i} f join {x}s{k} s on {on})")
    last = f"select doc_id, leaf, subroot, (select d from b{deep}) as root, sha256(proof) as proof_sha256, f as folded_root, f = (select d from b{deep}) as verified from f{2 * deep}"
    return "with " + ",\n".join(ctes) + "\n" + last
