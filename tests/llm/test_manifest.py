"""The Merkle manifest against one built in a plain loop, and proofs that hold or fail."""

import hashlib
import random
import zlib

import duckdb
import pytest

from veritally.llm import merkle
from veritally.llm.places import ranked
from veritally.llm.tables import materialise

DOC = "doc_id long, source string, lang string, n_chars int, text string, tree string, pos int, node string, total int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    out = ""
    for v in (r[0], r[1], r[2], r[3], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h([out])


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes, fanout):
    """The top of a tree, and of each leaf the (left, right) siblings of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            run = at[i] // fanout * fanout
            path.append((nodes[run : at[i]], nodes[at[i] + 1 : run + fanout]))
            at[i] //= fanout
        nodes = [h(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(("" if r[1] is None else "=" + r[1]).encode(), []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    trees = {s: sorted(v, key=lambda x: x[:3]) for s, v in by.items()}
    names = sorted(trees)
    tops = {s: climb([x[2] for x in trees[s]], fanout) for s in names}
    root, above = climb([tops[s][0] for s in names], fanout)
    out = []
    for j, s in enumerate(names):
        for (_, _, digest, r), path in zip(trees[s], tops[s][1], strict=True):
            path = path + above[j]
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            got = leaf(r, low(r[4])) if bad else digest
            for a, b in path:
                got = h([*a, got, *b])
            out.append((r[0], digest, tops[s][0], root, h([x for a, b in path for x in a + b]), got, got == root))
    return sorted(out, key=str)


def rows_of(n, sources, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(sources) if rng.random() > 0.4 else sources[0]
        out.append((i, source, rng.choice(["en", None]), rng.choice([None, i]), rng.choice(["Some Text", "no capitals", "", None, "ÄÖ Ünï " * 9])))
    out += [out[3], out[3], (None, "a", None, None, "Text Without an Id"), (None, None, None, None, None), (7, "a", None, None, "X" * 200_000), (2**60 + 1, "a", "en", 1, "Large")]
    return out


@pytest.mark.parametrize(("fanout", "most", "n"), [(16, 3, 400), (2, 2, 90), (2, 3, 5)])
def test_manifest_equals_the_plain_one(spark, in_parts, fanout, most, n):
    """Superblocks of 4,096, 4 and 8 leaves, so that trees have one to many steps."""
    rows = rows_of(n, ["hot", "a", "b", None, "ä", "", *[f"s{i}" for i in range(20)]])
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOC).repartition(3)
    got = merkle.manifest(docs, fanout, most)
    assert got.schema["doc_id"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, fanout)


def test_tampering_is_found(spark):
    rows = [(i, "s", "en", 1, "Text") for i in range(40)]
    got = {r.doc_id: r for r in merkle.manifest(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOC)).collect()}
    bad = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert bad and {i for i, r in got.items() if not r.verified} == bad


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).collect() == []


def test_ranks_are_global(spark, in_parts):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), rng.randrange(50), i) for i in range(3000)]
    df = materialise(spark.createDataFrame(rows, "k string, v long, row long"), "rows")
    got = {(r.k, r.row): r.pos for r in ranked(df, ["k"], ["v", "row"], "t").collect()}
    for k in "ab":
        mine = sorted((v, i) for x, v, i in rows if x == k)
        assert [got[k, i] for _, i in mine] == list(range(len(mine)))


def test_sql_equals_the_plain_one():
    con = duckdb.connect()
    rows = rows_of(300, ["hot", "a", None, "ä"])
    con.execute("create table documents (doc_id bigint, source varchar, lang varchar, n_chars int, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(merkle.oracle_sql()).fetchall(), key=str) == plain(rows, 16)
