"""Near duplicates, lines and test items against brute force, and the edge cases."""

import os
import random
import time

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritally.llm import decontam, edits, line_dedup, linking, near_dup, tables
from veritally.llm import textnum as tn
from veritally.llm.tables import materialise

DOC = "doc_id long, text string"


def test_near_duplicates_equal_brute_force(docs, corpus):
    sets, want = brute.near_groups(corpus)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    assert len(got) == len(corpus)
    for d, _ in corpus:
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(sets[d]), want[d], want[d] == d)


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], DOC)
    assert near_dup.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (3, None)]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect())
    assert got == [(0, None, True), (0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_large_group_of_copies_costs_a_star(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows.append((300, " ".join(base)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert {r.component_id for r in got} == {0}


def test_link_equals_all_pairs(spark):
    """Random posts and links: hubs, second hubs and the rest find the same components."""
    rng = random.Random(8)
    posts = {(rng.randrange(12), rng.randrange(60)) for _ in range(160)}
    size = {n: 100 + n for n in range(60)}
    links = {(a, b) for a in range(60) for b in range(a + 1, 60) if (a * 7 + b * 13) % 5 == 0 and size[a] >= 0.8 * size[b]}
    shared = {(a, b) for k, a in posts for j, b in posts if k == j and a < b}
    want = {n: c for n, c in brute.groups(range(60), shared & links).items()}
    df = materialise(spark.createDataFrame([(k, n, n % 5, size[n]) for k, n in posts], "key long, node long, pri long, size long"), "posts")
    is_link = spark.createDataFrame(sorted(links), "a long, b long")
    got = {r.node: r.component for r in linking.link(df, lambda p: p.join(is_link, ["a", "b"]), 0.8).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())


def test_edits_equal_brute_force():
    rng = random.Random(1)
    first, second, most = [], [], []
    for t in range(1200):
        a = "".join(rng.choice("ab é😀" if t % 50 == 0 else "abcé ") for _ in range(rng.randrange(0, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "a"])
        first.append(a)
        second.append("".join(b))
        most.append(rng.randrange(0, 9))
    want = [brute.distance(a, b) <= m for a, b, m in zip(first, second, most, strict=True)]
    assert edits.within(first, second, np.array(most)).tolist() == want and 100 < sum(want) < 1100
    assert edits.within([], [], np.array([])).tolist() == []


def test_edits_of_very_long_texts():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    b, other = list(a), "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    for _ in range(200):
        b[rng.randrange(len(b))] = "z"
    began = time.time()
    assert edits.within([a, a, a], ["".join(b), other, a[:-5]], np.array([100_000] * 3)).tolist() == [True, False, True]
    assert edits.within([a], ["".join(b)], np.array([100])).tolist() == [False]
    assert time.time() - began < 60


def _far_copies(rng, n, length, edited):
    """Pairs of texts that are so many changes apart, or a few less."""
    first = ["".join(rng.choice("abcdefgh éß日") for _ in range(length)) for _ in range(n)]
    second = []
    for t in first:
        t = list(t)
        for k in range(edited):
            at = rng.randrange(len(t))
            t[at : at + rng.choice([0, 1, 1])] = [rng.choice("xyz")] * rng.choice([0, 1, 1])
        second.append("".join(t))
    return first, second


def test_edits_of_several_words_equal_brute_force():
    """Bounds at, below and above the distance, where the diagonals take one word of bits to five."""
    rng, first, second, most, want = random.Random(12), [], [], [], []
    for length, edited in ((30, 6), (260, 62), (330, 70), (420, 140), (900, 290)):
        for a, b in zip(*_far_copies(rng, 8 if length > 400 else 30, length, edited), strict=True):
            d = brute.distance(a, b)
            for k in (d - 1, d, d + 1, d + 60):
                first, second, most, want = [*first, a], [*second, b], [*most, k], [*want, d <= k]
    assert edits.within(first, second, np.array(most)).tolist() == want and max(most) > 256
    assert edits.within(second, first, np.array(most)).tolist() == want


def test_pairs_just_over_their_bound_are_cheap():
    """Copies of lists that are still open are mostly a little too far apart: no counts tell those, and their furthest-reaching points are many."""
    first, second = _far_copies(random.Random(13), 2000, 400, 60)
    texts, x, most = [*first, *second], np.arange(2000), np.full(2000, 40)
    code, at = edits._codes(texts)
    size = np.diff(at) - 4
    began = time.process_time()
    want = edits._reach(code, code, at[x], at[x + 2000], size[x], size[x + 2000], most)
    before, began = time.process_time() - began, time.process_time()
    assert (edits.among(texts, x, x + 2000, most, ()) == want).all()
    after = time.process_time() - began
    print(f"{before:.3f} s by furthest-reaching points, {after:.3f} s now")
    assert after < before / 2


def test_long_pairs_over_their_bound_are_cheap():
    """Nothing but their distance tells long copies apart that are a little too far; their furthest-reaching points are too many."""
    first, second = _far_copies(random.Random(14), 12, 5200, 620)
    texts, x, most = [*first, *second], np.arange(12), np.array([500, 520, 560, 600, 640, 700] * 2)
    code, at = edits._codes(texts)
    size = np.diff(at) - 4
    began = time.process_time()
    want = edits._reach(code, code, at[x], at[x + 12], size[x], size[x + 12], most)
    before, began = time.process_time() - began, time.process_time()
    assert (edits.among(texts, x, x + 12, most, ()) == want).all() and 0 < want.sum() < 12
    after = time.process_time() - began
    print(f"{before:.3f} s by furthest-reaching points, {after:.3f} s now")
    assert after < 0.7 * before


def test_bands_of_integers_and_of_words_agree():
    """Lone pairs, and pairs of more than 250 characters in all, give what the furthest-reaching points give."""
    rng, texts, most = random.Random(15), [], []
    wide = [chr(0x4E00 + k) for k in range(600)]
    for length, edited in ((0, 0), (1, 1), (70, 4), (300, 35), (900, 80), (4100, 30), (8300, 320)):
        for letters in ("abc é", wide):
            for _ in range(6):
                a = [rng.choice(letters) for _ in range(length)]
                b = list(a)
                for _ in range(rng.randrange(edited + 1)):
                    at = rng.randrange(len(b) + 1)
                    b[at : at + rng.choice([0, 1, 1])] = [rng.choice(letters)] * rng.choice([0, 1, 1])
                texts += ["".join(a), "".join(b)]
                most.append(rng.randrange(edited + 1))
    x, most = 2 * np.arange(len(texts) // 2), np.array(most)
    code, at = edits._codes(texts)
    size = np.diff(at) - 4
    some = np.abs(size[x + 1] - size[x]) <= most
    want = np.zeros(len(x), bool)
    want[some] = [edits._reach(code, code, *(z[[k]] for z in (at[x], at[x + 1], size[x], size[x + 1], most)))[0] for k in np.flatnonzero(some)]
    assert 20 < want.sum() < len(x) - 20
    assert (edits._alone(code, at[x], at[x + 1], size[x], size[x + 1], most) == want).all()
    for kind in (code.astype(np.uint32), np.unique(code, return_inverse=True)[1].astype(np.uint32) + 2):
        for words in range(1, 7):
            own = np.flatnonzero(some & (most // 64 + 1 == words))
            own = own[np.argsort(-size[x[own] + 1], kind="stable")]
            if len(own):
                assert (edits._banded(kind + 2, at[x[own]], at[x[own] + 1], size[x[own]], size[x[own] + 1], most[own], words) == want[own]).all()
    latin = np.flatnonzero(some & ((np.arange(len(x)) // 6) % 2 == 0))  # a table of bits
    kinds = np.unique(code[np.concatenate([np.arange(at[k], at[k] + size[k]) for k in [*x[latin], *(x[latin] + 1)]])])
    small = np.where(np.isin(code, kinds), np.searchsorted(kinds, code) + 2, 2).astype(np.uint8)
    for words in range(1, 7):
        own = latin[most[latin] // 64 + 1 == words]
        own = own[np.argsort(-size[x[own] + 1], kind="stable")]
        if len(own):
            assert (edits._banded(small, at[x[own]], at[x[own] + 1], size[x[own]], size[x[own] + 1], most[own], words) == want[own]).all()
    edits_rows, edits.ROWS = edits.ROWS, 1  # too many rows of bits: by points
    try:
        assert (edits._alone(code, at[x], at[x + 1], size[x], size[x + 1], most) == want).all()
    finally:
        edits.ROWS = edits_rows


def test_marked_tables_keep_rows_out_of_shuffles(spark):
    """Spark takes the mark for a condition that selects rows, and filters the other side by a table's keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = tables.materialise(spark.range(5000).withColumn("text", F.lit("x")), "large")
        small = tables.marked(spark.range(0, 5000, 100), "small")
        with tables.bloom_filters(spark):
            joined = large.join(small.hint("merge"), "id")
            assert "might_contain" in joined._jdf.queryExecution().optimizedPlan().toString()
            assert joined.count() == 50
        tables.drop(large, small)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_normal_forms_of_some_lines():
    """Rows may begin and end in the midst of a run of words: nothing is between them."""
    texts = ["A  b\tc\n\n d e \nÉF", "g", "", "h i\n", " \n", "j"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    low, _, _, _, s, e, ptr = line_dedup._lines(buf, off)
    has = np.diff(ptr) > 0
    ptr, want = np.append(ptr[:-1][has], ptr[-1]), ["a b c", "d e", "éf", "g", "h i", "j"]
    for own in ([0, 1, 2, 3, 4, 5], [2, 3], [0, 3, 5], [1], []):
        form, at = line_dedup._forms(low, s, e, ptr, np.array(own, np.int64))
        assert [form[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == [want[k] + " " for k in own]


def _brute_lines(docs):
    """Texts without repeated lines: by edit similarity of all pairs of normal forms alone."""
    forms = {(d, i): " ".join(x.lower().split()) for d, t in docs for i, x in enumerate((t or "").split("\n")) if x.strip()}
    nodes = sorted(set(forms.values()))
    links = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if min(len(a), len(b)) >= 0.9 * max(len(a), len(b)) and brute.distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9)]
    of, first = brute.groups(nodes, links), {}
    for k in sorted(forms):
        first.setdefault(of[forms[k]], k)
    return links, {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in forms or first[of[forms[d, i]]] == (d, i)) if t is not None else None for d, t in docs}


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 70))) for _ in range(30)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base)
            kind = rng.randrange(5)
            if kind == 1:
                line = line.upper() + "!"
            elif kind == 2 and len(line) > 100:  # a small edit in a long line
                at = rng.randrange(len(line))
                line = line[:at] + "q" + line[at:]
            elif kind == 3:
                line = "  " + line.replace(" ", "  ", 1)
            lines.append(line)
        docs.append((d, "\n".join(lines + (["", "123 --"] if d % 3 == 0 else []))))
    docs += [(40, None), (41, ""), (42, "\n\n"), (43, base[0]), (44, "é à ü\nÉ À Ü"), (45, "z" * 20_000), (46, "z" * 19_000)]
    links, want = _brute_lines([(d, t) for d, t in docs if d < 45] + [(45, "z" * 200), (46, "z" * 190)])
    assert links  # the fuzzy part is exercised
    want[45], want[46] = "z" * 20_000, "z" * 19_000  # one word each: nothing in common to find them by
    df = spark.createDataFrame([(d, t, "x", 9, 1) for d, t in docs], "doc_id long, text string, line string, n_lines long, node int")
    out = line_dedup.dedup_lines(df.repartition(3)).collect()
    assert {r.doc_id: r.text for r in out} == want and len(out) == len(docs)
    for r in out:
        before = dict(docs)[r.doc_id]
        assert r.n_lines == (0 if before is None else len(before.split("\n"))) and (before is None or r.n_lines - r.n_removed in (0, len(r.text.split("\n"))))


def test_query_finds_lines_by_edit_similarity_alone(spark, tmp_path):
    """One changed word or typo a line, at all lengths: the reference knows no SimHash."""
    from veritally.llm.queries import op1_line_dedup

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    lines = []
    for n in [2, 3, 4, 5, 8, 10, 11, 14, 20, 30, 45] * 3:
        base = [word() for _ in range(n)]
        changed, typo, less = list(base), " ".join(base), list(base)
        changed[rng.randrange(n)] = word()
        at = rng.randrange(len(typo))
        del less[rng.randrange(n)]
        lines += [" ".join(base), " ".join(changed), typo[:at] + "é" + typo[at + 1 :], " ".join(less)]
    rng.shuffle(lines)
    links = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if brute.distance(lines[a], lines[b]) <= int(0.1 * max(len(lines[a]), len(lines[b])) + 1e-9)]
    of = brute.groups(range(len(lines)), links)
    assert len(links) > 80
    spark.createDataFrame(list(enumerate(lines)), DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: int(of[d] != d) for d in range(len(lines))}


def _near_lines(forms):
    """All pairs at the similarity. Counts of character pairs leave out only what can't be one."""
    forms = sorted(forms, key=len)
    n = np.array([len(x) for x in forms])
    bags = np.zeros((len(forms), 256), np.int32)
    for i, x in enumerate(forms):
        c = np.frombuffer(x.encode("utf-32-le"), "<u4").astype(np.int64)
        bags[i] = np.bincount((c[:-1] * 31 + c[1:]) * 2654435761 >> 7 & 255, minlength=256)
    pairs = []
    for i in range(len(forms)):
        to = int(np.searchsorted(n, int(n[i] / 0.9) + 1, "right"))
        apart = np.abs(bags[i + 1 : to] - bags[i]).sum(axis=1)
        pairs += [(i, i + 1 + int(j)) for j in np.flatnonzero(apart <= 4 * (0.1 * n[i + 1 : to] + 1e-9).astype(int))]
    most = np.array([int(0.1 * n[j] + 1e-9) for _, j in pairs])
    ok = np.concatenate([edits.within([forms[i] for i, _ in pairs[k : k + 9000]], [forms[j] for _, j in pairs[k : k + 9000]], most[k : k + 9000]) for k in range(0, len(pairs), 9000)])
    return [(forms[i], forms[j]) for (i, j), x in zip(pairs, ok, strict=True) if x]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are not here")
def test_recall_of_near_lines(spark):
    """Of all pairs of lines of sf0.01 at the similarity, nine in ten or more share a block."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    blocks = line_dedup.line_blocks(docs.select("doc_id", "text")).where("keys is not null").dropDuplicates(["node"]).collect()
    text = {r.doc_id: (r.text or "").split("\n") for r in docs.collect()}
    keys = {" ".join(text[r.doc_id][r.line].lower().split()): set(r["keys"]) for r in blocks}
    pairs = _near_lines(keys)
    found = sum(not keys[a].isdisjoint(keys[b]) for a, b in pairs)
    print(f"{found} of {len(pairs)} near pairs among {len(keys)} lines")
    assert len(pairs) > 250 and found >= 0.9 * len(pairs)


def _changed(rng, line, rate):
    out = []
    for c in line:
        if c != " " and rng.random() < rate:
            out.append(rng.choice(["", rng.choice("abcdefgh"), c + rng.choice("abcdefgh")]))
        else:
            out.append(c)
    return "".join(out)


def test_forms_meet_their_pairs_in_cells(spark):
    """A hub, a list of all pairs and single pairs: however small the cells, the links are those of the edit distance."""
    rng = random.Random(12)
    base = "".join(rng.choice("abcdef ") for _ in range(120))
    form = {0: base}
    for i in range(1, 90):
        t = list(base)
        for _ in range(rng.randrange(30)):
            t[rng.randrange(len(t))] = rng.choice("abcdefxyz")
        form[i] = "".join(t)
    pairs = [(0, i, 1) for i in range(1, 90)] + [(i, j, 2) for i in range(1, 30) for j in range(i + 1, 30)] + [(i, i + 1, i) for i in range(40, 80)]
    most = np.full(len(pairs), 12)
    ok = edits.within([form[a] for a, _, _ in pairs], [form[b] for _, b, _ in pairs], most)
    want = {p[:2] for p, x in zip(pairs, ok, strict=True) if x}
    df = spark.createDataFrame([(*p, 240) for p in pairs], "a long, b long, key long, sizes long")
    forms = spark.createDataFrame(list(form.items()), "node long, form string")
    assert 20 < len(want) < len(pairs) - 20
    for chars in (2000, 1 << 23):
        assert {(r.a, r.b) for r in line_dedup._similar(df, forms, 0.9, chars).collect()} == want
    assert line_dedup._similar(df.limit(0), forms, 0.9).count() == 0


def test_open_lists_meet_their_texts_in_cells(spark):
    """However small the cells, a list's components are those of all its pairs, and no more links come out than join them."""
    rng, rows, form = random.Random(15), [], {}
    for k in range(6):  # lists of a few and of hundreds, in clusters of near lines; some nodes are in two lists
        for c in range((2, 3, 5, 9, 14, 20)[k]):
            base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(40, 160)))
            for _ in range(rng.randrange(1, 9)):
                t = list(base)
                for _ in range(rng.randrange(len(base) // 12)):
                    t[rng.randrange(len(t))] = rng.choice("xyz")
                node = len(form)
                form[node] = "".join(t)
                rows += [(key, node, node - node % 3 if node % 2 else node, len(t)) for key in {k, rng.choice([k, 0])}]
    component = {n: c for _, n, c, _ in rows}
    most = lambda a, b: int(0.1 * max(len(form[a]), len(form[b])) + 1e-9)
    lists = [[n for k, n, _, _ in rows if k == key] for key in range(6)]
    links = {(a, b) for own in lists for a in own for b in own if a < b and brute.distance(form[a], form[b]) <= most(a, b)}
    given = [(n, c) for n, c in component.items() if n != c]
    want = brute.groups([*form, *component.values()], links | set(given))
    left = materialise(spark.createDataFrame(rows, "key long, node long, component long, size int"), "left")
    forms = spark.createDataFrame(list(form.items()), "node long, form string")
    for members, chars in ((512, 1 << 23), (7, 1 << 23), (512, 900)):
        got = line_dedup._open_links(left, forms, 0.9, members, chars).collect()
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} <= links and all((r.size, r.other_size) == (len(form[r.a]), len(form[r.b])) for r in got)
        assert brute.groups([*form, *component.values()], {(r.a, r.b) for r in got} | set(given)) == want
        if members == 512 and chars > 900:  # all lists are in one task
            assert len(got) == len(set(brute.groups([*form, *component.values()], set(given)).values())) - len(set(want.values()))
    assert line_dedup._open_links(left.limit(0), forms, 0.9).count() == 0


def test_template_lines_lose_no_link(spark):
    """Lines of which most is one template, so that lists hold hundreds; two words of each pair are changed. End to end."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 10)))
    template, rows = [word() for _ in range(15)], []
    for i in range(200):
        line = list(template)
        for k in range(9):
            line.insert(2 * k + 1, word())
        copy = list(line)
        for k in rng.sample(range(24), 2):
            copy[k] = copy[k][:-1] + "z"
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(copy))]
    assert all(brute.distance(a[1], b[1]) <= 0.1 * len(a[1]) for a, b in zip(rows[::2], rows[1::2], strict=True))
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert sum(got[2 * i + 1] for i in range(200)) >= 198 and sum(got[2 * i] for i in range(200)) == 0


def test_recall_under_scattered_typos(spark):
    """End to end, of pairs at the similarity: about three in four at 5 % of the characters; what the README states."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 10)))
    pairs = []
    for n in (12, 24, 60):
        for _ in range(60):
            a = " ".join(word() for _ in range(n))
            b = _changed(rng, a, 0.05)
            if a != b and 10 * brute.distance(a, b) <= max(len(a), len(b)):
                pairs.append((a, b))
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).where("n_removed > 0").count()
    print(f"{got} of {len(pairs)} pairs with typos")
    assert got >= 0.65 * len(pairs)


def test_long_lines_of_a_hot_list_are_told_apart_in_its_join(spark, monkeypatch):
    """Long lines of few syllables share most runs of three characters: none may come out as a pair to verify."""
    r, verified, similar = random.Random(5), [], line_dedup._similar
    syllables = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(40)]
    lines = ["a rare opening run " + " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(85)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_similar", counted)
    # a block that all lines share: that of their first word
    monkeypatch.setattr(line_dedup, "_keys", lambda low, s, e, word, ptr: (word[ptr[:-1]].copy(), np.arange(len(ptr))))
    gone = {(x.doc_id, k) for x in line_dedup.duplicate_lines(docs).collect() for k in x.lines}
    want = [(i, j) for i in range(150) for j in range(i + 1, 150) if edits.within([lines[i]], [lines[j]], np.array([int(0.1 * max(len(lines[i]), len(lines[j])) + 1e-9)]))[0]]
    assert not want and not gone and verified[1:] == [0]


def test_finer_sketches_differ_in_few_bits_an_edit(spark):
    r, rows = random.Random(6), []
    for n in (3, 20, 84, 86, 170, 172, 340, 342, 700, 3000):
        x = [r.choice("abcdeé 語") for _ in range(n)]
        for d in (0, 1, 2, n // 20):
            y = list(x)
            for _ in range(d):
                at = r.randrange(len(y) + 1)
                y[at : at + r.randrange(2)] = r.choice(["", "q"])
            rows.append(("".join(x), "".join(y), d))
    x, y = ([a[k] for a in rows] for k in (0, 1))
    sketch = [line_dedup._fine_sketches(*next(iter(tn.slices(pa.array(z))))[1:]).to_pylist() for z in (x, y)]
    df = spark.createDataFrame([(*z, a[2]) for z, a in zip(zip(*sketch, strict=True), rows, strict=True)], "x array<long>, y array<long>, d int").selectExpr("d", "size(x) <> size(y) as folded", f"{line_dedup._fine_apart('x', 'y')} as apart").collect()
    assert any(z.folded for z in df) and all(z.apart <= 2 * line_dedup.FINE * z.d for z in df)


def test_sketches_differ_in_few_bits_an_edit(spark):
    """On both sides of the length where sketches grow, and across it."""
    rng, rows = random.Random(3), []
    for i in range(120):
        a = "".join(rng.choice("abc dé漢") for _ in range(rng.choice([40, 155, 166, 600])))
        rows.append((i, " ".join(a.split()), " ".join(_changed(rng, a, 0.03).split())))
    rows = [r for r in rows if r[1] and r[2]]
    line = lambda k: {r.doc_id: r.sketch for r in line_dedup.line_blocks(spark.createDataFrame([(r[0], r[k]) for r in rows], DOC).coalesce(1)).collect()}
    a, b = line(1), line(2)
    both = [(i, a[i], b[i], brute.distance(x, y)) for i, x, y in rows if a[i] is not None and b[i] is not None]
    df = spark.createDataFrame(both, "i int, x array<long>, y array<long>, d int").selectExpr("d", "size(x) + size(y) as n", f"{line_dedup._bits_apart('x', 'y')} as apart").collect()
    assert {r.n for r in df} == {8, 20, 32} and all(r.apart <= line_dedup.FLIPS * r.d for r in df)


def test_figures_and_marks_count(spark):
    """Lines that differ in figures or marks are as far apart as their edits; equal lines always go."""
    lines = ["Chapter 1", "Chapter 27", "chapter  1", "total 19 37 233", "total 4 815", "12 34", "12 34", "a long line of many words in section 14 here", "a long line of many words in section 15 here", "2024\nx1 + 20\nx1 * 20", "-----\n2024\n\n-----", "Order 18273645 total 12 EUR", "Order 99 total 7000 EUR"]
    df = spark.createDataFrame(list(enumerate(lines)), DOC)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == dict(enumerate(lines)) | {2: "", 6: "", 8: "", 10: "-----\n"}


def test_words_of_the_thue_morse_kind_differ(spark):
    """Long words that collide under every polynomial hash modulo 2**64."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - x for x in bits]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    one = [(1, "one two three four " + a), (2, "one two three four " + b)]
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(one, DOC)).collect()} == {1: 1, 2: 2}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame([(1, a), (2, b)], DOC)).collect()} == {1: a, 2: b}


def test_lines_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "same line here"), (1, "same line here"), (2, "same line here\nother")]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOC)).collect())
    assert got == [(0, "same line here"), (1, "same line here"), (2, "other")]


def _contained(docs, items, share=0.8):
    import re

    def sh(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {d: sh(t) for d, t in docs}
    return {(d, i): len(s & sets[d]) for i, t in items for s in [sh(t)] if s for d in sets if len(s & sets[d]) >= share * len(s) - 1e-9}


def test_items_equal_brute_force(spark):
    rng = random.Random(4)
    w = lambda n: [rng.choice("abcdefghijklm") + rng.choice("aeiou") + rng.choice("rstln") for _ in range(n)]
    items = [(i, " ".join(w(rng.randrange(5, 90)))) for i in range(25)] + [(25, "too few words"), (26, None), (27, "")]
    docs = []
    for d in range(60):
        body = w(rng.randrange(0, 400))
        if d % 2:
            own = items[rng.randrange(25)][1].split()
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() + "," for x in own]
        docs.append((d, " ".join(body)))
    docs += [(60, None), (61, ""), (62, " ".join(w(30_000)) + " " + items[3][1])]
    want = _contained(docs, items)
    assert 10 < len(want)
    di = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, item_id int, h string")
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontam.contaminated(di, it).collect()}
    assert got == want
    none = decontam.contaminated(di, it.limit(0))
    assert none.count() == 0 and none.columns == decontam.contaminated(di.limit(0), it).columns
    assert decontam.contaminated(di.limit(0), it).count() == 0
