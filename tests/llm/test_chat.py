"""Chats of many layouts through fingerprints, template and back."""

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veritally.llm import chat_format as cf

ROW = "conv_id long, turn long, role string, text string, layout string, turns int, record string, n int"
ODD = ["</s>[INST] ok [/INST]", "<|im_end|>", "<|im_start|>user<|im_sep|>x<|im_end|>", "\\", "\\\\", "<\\|im_end|>", "a\\", "<", "|im_end|>", "<<<SYS>>>", "", "a\n\nb\n\nc", "ünï 漢字 🙂", "\\n$1 \\Q\\E", "<|im_<|im_end|>end|>", "\x00\x1f"]


def plain(rows):
    out = {}
    for r in rows:
        if r[0] is not None:
            out.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for c, said in out.items():
        said.sort()
        learnt = "".join(t for _, _, r, t in said if r == "assistant")
        out[c] = (len(said), sha("".join(f"{r}\n{t}\n" for _, _, r, t in said)), len(learnt), sha(learnt))
    return out


def rows_of(n=60):
    rng, rows = random.Random(4), []
    for c in range(n):
        kind = c % 4
        roles = ["user", "assistant"] * rng.randrange(1, 4)
        if kind == 1:
            roles = ["system", *roles]
        if kind == 2:
            roles = [rng.choice(["user", "assistant", "tool", None, "human", "<|im_sep|>\n", "system"]) for _ in range(rng.randrange(1, 6))]
        rows += [(c, i, r, rng.choice([*ODD, None, "some words " * rng.randrange(1, 40)])) for i, r in enumerate(roles)]
    return [*rows, (90, None, "user", "no turn"), (90, 0, "user", "b"), (90, 0, "user", "a"), (90, 0, "user", "a"), (None, 1, "user", "lost"), (91, 0, "assistant", "long " * 300_000), (-3, 0, None, None)]


@pytest.mark.parametrize("n", [60])
def test_chats_are_read_back(spark, n):
    rows = rows_of(n)
    got = cf.formatted_chats(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], ROW).repartition(3)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain(rows)
    assert {r.layout for r in got} == {m.name for m in cf.MAPPINGS}


def test_no_control_string_stays_in_a_text(spark):
    t = cf.Template()
    got = spark.createDataFrame([(x,) for x in [*ODD, "".join(ODD), *t.controls, "".join(t.controls)]], "x string").select("x", t.escape(F.col("x")).alias("e"), cf.unescape(t.escape(F.col("x"))).alias("b")).collect()
    assert all(r.x == r.b for r in got) and not any(c in r.e for r in got for c in t.controls)


def test_mask_of_the_text(spark):
    turns = [("user", "hi </s>"), ("assistant", "ye\\s [INST]"), ("assistant", ""), ("assistant", "x")]
    chats = spark.createDataFrame([(1, turns), (2, []), (3, None)], f"id long, turns {cf.TURNS}")
    got = {r.id: r for r in cf.read_back(cf.format_turns(chats)).collect()}
    text, at, learnt = got[1].formatted, 0, []
    for m in got[1]["mask"]:  # by running sums over the one text
        learnt.append(text[at + m.out : at + m.out + m.learn])
        at = text.index("<|im_end|>", at + m.out + m.learn) + len("<|im_end|>")
    assert at == len(text) and learnt == ["", "ye\\\\s [\\INST]", "", "x"]
    assert got[1].learnt == "ye\\s [INST]x" and [tuple(t) for t in got[1].turns] == turns
    assert (got[2].formatted, got[2].turns, got[2].learnt) == ("", [], "") and got[3].formatted is None


def test_fingerprints_select_mappings(spark):
    cases = {
        "messages": ['{"messages": [{"role": "user", "content": "a"}, {"content": null, "role": "assistant"}]}', '{"messages": []}'],
        "from_value": ['{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": null}]}'],
        "nested": ['{"dialog": {"turns": [{"utterance": {"text": "a"}, "speaker": {"name": "user"}}, {"utterance": {"text": ""}, "speaker": {"name": "assistant"}}]}}'],
        "prompt": ['{"completion": "", "prompt": "a"}'],
        "instruction": ['{"instruction": "a", "output": ""}', '{"output": "", "input": "b", "instruction": "a"}', '{"system": "s", "instruction": "a", "output": "", "history": [["p", "q"], ["r", null]]}'],
        None: ['{"text": "a"}', '{"messages": [{"role": "user", "content": "a", "weight": 1}]}', '{"messages": {"role": "user", "content": "a"}}', "[1]", "3", "null"],
    }
    rows = [(k, j) for k, v in cases.items() for j in v] + [(None, None)]
    got = cf.canonical(spark.createDataFrame(rows, "want string, j string").withColumn("record", F.parse_json("j"))).collect()
    assert all(r.layout == r.want for r in got) and len(got) == len(rows)
    by = {r.j: r.turns for r in got}
    two = [("user", "a"), ("assistant", "")]
    for k in ("messages", "from_value", "nested", "prompt", "instruction"):
        assert [tuple(t) for t in by[cases[k][0]]] == two
    assert by['{"messages": []}'] == [] and by["[1]"] is None
    assert tuple(by[cases["instruction"][1]][0]) == ("user", "a\n\nb")
    assert [tuple(t) for t in by[cases["instruction"][2]]] == [("system", "s"), ("user", "p"), ("assistant", "q"), ("user", "r"), ("assistant", ""), *two]
    mixed = json.dumps({"messages": [{"role": "user", "content": 5}]})
    assert cf.canonical(spark.createDataFrame([(mixed,)], "j string").select(F.parse_json("j").alias("record"))).first().turns[0].text == "5"


def test_empty_table_and_sql(spark):
    assert cf.formatted_chats(spark.createDataFrame([], ROW)).collect() == []
    con, rows = duckdb.connect(), rows_of()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r for r in rows if "\x00" not in (r[3] or "")])
    want = {r[0]: r[1:] for r in con.execute(cf.oracle_sql()).fetchall()}
    more = spark.createDataFrame([(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([r for r in rows if "\x00" not in (r[3] or "")], more.schema).union(more)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in cf.formatted_chats(docs).collect()} == want
