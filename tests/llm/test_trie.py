"""The prefix trie against one built conversation by conversation."""

import hashlib
import random
import zlib

import duckdb
import pytest

from veritally.llm import prefix_trie as pt

ROW = "conv_id long, turn long, role string, text string, depth int, top_conv string, size int"


def plain(rows):
    chats = {}
    for c, turn, role, text in (r[:4] for r in rows):
        if c is not None:
            role, text = role or "", text or ""
            g = hashlib.sha256((str(len(role.encode())) + ":" + role + text).encode()).hexdigest()
            chats.setdefault(c, []).append((turn is not None, turn or 0, g, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in chats.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(tuple(built[c][:d]), []).append(c)
    out = {k: [v[0], len(k), nodes[k[:-1]][0] if k else None, len(v), 0, 0, 0, hashlib.sha256(",".join(str(c) for c in v if len(built[c]) == len(k)).encode()).hexdigest()] for k, v in nodes.items()}
    for k in nodes:
        if k:
            out[k[:-1]][4] += 1
    for k in nodes:
        words = len(k[-1][1].translate({i: " " for i in (9, 10, 11, 12, 13, 32)}).split(" ")) - k[-1][1].translate({i: " " for i in (9, 10, 11, 12, 13, 32)}).split(" ").count("") if k else 0
        for d in range(len(k) + 1):
            out[k[:d]][5] += out[k][4] == 0
            out[k[:d]][6] += (len(nodes[k]) - 1) * words
    return sorted(map(tuple, out.values()))


def chats_of(n, deep=0):
    rng, rows = random.Random(8), []
    for c in range(n):
        for t in range(rng.randrange(0, 7)):
            rows.append((c * rng.choice([1, 1, 1, -1]) if c % 9 == 0 else c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "", None, " \x0b d e\t"])))
    for c in range(deep):  # a long conversation, and others that leave it at every few turns
        rows += [(1000 + 20 * c + 4, t, "user", f"t{t} of the chain" if t < 60 - 4 * c else f"x{c} {t}") for t in range(60)]
    return [*rows, (7, None, "user", "no turn"), (7, 1, "user", "same turn"), (7, 1, "user", "same turn"), (None, 0, "user", "lost"), (5000, 0, "user", "alone"), (5008, 0, "user", "w " * 50_000)]


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROW).repartition(3)
    return sorted(map(tuple, pt.prefix_trie(df, **how).collect()))


@pytest.mark.parametrize("how", [{}, {"local": 5, "task": 40, "chunk": 2}])
def test_trie_equals_the_plain_one(spark, in_parts, how):
    """Without a split, and split down to a few nodes."""
    rows = chats_of(60, deep=12)
    assert got(spark, rows, **how) == plain(rows)


def test_one_conversation_and_none(spark):
    assert got(spark, []) == []
    for rows in ([(4, 0, "user", "a b")], [(5008, t, "user", "a b") for t in range(40)], [(20, 0, "user", "a"), (22, 0, "user", "b")]):
        assert got(spark, rows, local=3) == plain(rows)


def test_levels_are_few(spark, monkeypatch):
    """A chain of 150 nodes is halved, not walked, down to single nodes, and its sums are right."""
    names = []
    keep = pt.materialise
    monkeypatch.setattr(pt, "materialise", lambda df, name, *a: names.append(name) or keep(df, name, *a))
    rows = [(5000 + 20 * i, t, "user", "same words") for i in range(2) for t in range(150)]
    assert got(spark, rows, local=1) == plain(rows)
    assert 5 <= names.count("placed") <= 8


def test_sql_equals_the_plain_one():
    con, rows = duckdb.connect(), chats_of(40, deep=5)
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(pt.ORACLE_SQL).fetchall(), key=str) == sorted(plain(rows), key=str)
