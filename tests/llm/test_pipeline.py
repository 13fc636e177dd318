"""The stages in a row, each against what it must do with its own input."""

import os

import brute
import pytest

import corpus_pipeline as cp
from veritally.llm.tables import DOCUMENT_COLUMNS, materialise

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {"documents": docs}
    for name, stage in cp.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == DOCUMENT_COLUMNS
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        if name == "near_dedup":
            _, want = brute.near_groups([(r.doc_id, r.text) for r in before.collect()], percent=80)
            assert {r.doc_id for r in docs.collect()} == {d for d, c in want.items() if c == d}
        if name == "decontamination":
            from test_dedup import _contained

            gone = {d for d, _ in _contained([(r.doc_id, r.text) for r in before.collect()], items)}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == gone
    packed = {r.doc_id for r in docs.collect()}
    assert packed == {r.doc_id for r in seen["decontamination"].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) > 0.9 * len(good)


def test_near_stage_links_from_80_percent(spark):
    import random

    rng, rows = random.Random(3), []
    for i in range(12):  # a run of changed words in the middle: similarities from 0.75 to 0.9
        base = [f"w{rng.randrange(10_000)}" for _ in range(104)]
        copy = list(base)
        copy[50 : 51 + i] = [f"x{i}y{k}" for k in range(1 + i)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    _, want = brute.near_groups(rows, percent=80)
    _, strict = brute.near_groups(rows)
    assert len(set(want.values())) < len(set(strict.values()))
    docs = spark.createDataFrame([(d, t, "en", None, len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    assert {r.doc_id for r in cp.near_stage(spark, docs, SF).collect()} == {d for d, c in want.items() if c == d}


def test_matches_follow_the_threshold():
    from veritally.llm import near_dup

    assert [near_dup._matches(p) for p in (85, 80, 70, 50)] == [40, 35, 27, 14]
    with pytest.raises(ValueError):
        near_dup._matches(10)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, equal texts, clashing columns."""
    rows = [(None, "a line that has no id at all", "en", "s", 28)] * 2
    same = "these very words stand in several documents of this table"
    rows += [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 60_000 + "\n" + "x" * 300_000, "en", None, 600_001), (7, "a text whose language and source nobody knows", None, None, None)]
    rows += [(4, same, "en", "s", len(same)), (5, same, "en", "s", len(same)), (6, same, "de", "t", len(same)), (6, same, "de", "t", len(same))]
    docs = spark.createDataFrame([(*r, "c", 1, 0.5, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, component_id string, n_removed int, score double, shard int")
    want = {"line_dedup": {None: 2, 1: 1, 2: 1, 3: 1, 7: 1, 4: 1}, "near_dedup": {None: 2, 1: 1, 2: 1, 3: 1, 7: 1, 4: 1}, "decontamination": {None: 2, 1: 1, 2: 1, 3: 1, 7: 1, 4: 1, 5: 1, 6: 2}}
    for name, stage in cp.STAGES:
        out = materialise(stage(spark, docs, SF), name)
        got = out.collect()
        if name == "packing":
            assert {r.doc_id for r in got} == {r[0] for r in rows}
            assert sum(r.n_tokens for r in got) == sum(len((r[1] or "").split()) + 1 for r in rows)
            continue
        assert out.columns == DOCUMENT_COLUMNS
        count = {d: sum(r.doc_id == d for r in got) for d in {r.doc_id for r in got}}
        if name in want:
            assert count == want[name], name
        else:
            assert all(n <= sum(r[0] == d for r in rows) for d, n in count.items())
        assert {tuple(r) for r in got} <= set(rows)
