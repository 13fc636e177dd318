"""Edge cases of the jobs, on rows made by hand."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veritally.functions import text as tx
from veritally.functions import verdicts as vd
from veritally.operators import catalog, human, metrics, ranges, sampling, store, tasks, turns
from veritally.sources import files
from veritally.streaming import streams

G = ["g1", "g2"]
FACT = "mode string, category string, detector string, label string, generator string, num_images long, status string, error string, is_ai_modified boolean, confidence double"


def one(df):
    return {tuple(r[:-1]): r[-1] for r in df.collect()}


@pytest.mark.parametrize(
    ("raw", "fake", "conf", "reason", "bad"),
    [
        ('{"is_ai_modified": true, "confidence": 0.5, "reason": " a "}', True, 0.5, "a", False),
        ('```json\n{"is_ai_modified": false}\n```', False, None, None, False),
        ('```json{"is_ai_modified": "Yes", "confidence": "0.25"}```', True, 0.25, None, False),
        ('Well: {"is_ai_generated": " TRUE ", "reason": ["a", " ", "b "]} bye', True, None, "a b", False),
        ('{"is_ai_modified": "no"}', False, None, None, False),
        ('{"is_ai_modified": "2"}', False, None, None, False),
        ('{"is_ai_modified": 2, "confidence": true}', True, 1.0, None, False),
        ('{"is_ai_modified": 0, "reason": "", "reasoning": "r"}', False, None, "r", False),
        ('{"is_ai_modified": null, "is_ai_generated": true}', True, None, None, False),
        ('{"is_ai_modified": null, "confidence": "high"}', None, None, None, False),
        ('{"is_ai_modified": [], "explanation": {"x": 1}}', False, None, '{"x":1}', False),
        ('{"is_ai_modified": true, "confidence": 0.9', None, None, None, True),
        ("", None, None, None, True),
        (None, None, None, None, True),
        ("[1, 2]", None, None, None, True),
        ("null", None, None, None, True),
    ],
)
def test_replies(spark, raw, fake, conf, reason, bad):
    df = spark.createDataFrame([(raw,)], "raw string").select(vd.parse_reply("raw").alias("v")).select(*vd.verdict_columns("v"))
    r = df.first()
    assert (r.is_ai_modified, r.confidence, r.reason, r.error is not None) == (fake, conf, reason, bad)


@pytest.mark.parametrize("allowed", ["false", "true"])
def test_replies_with_repeated_keys(spark, allowed):
    """The last value of a key counts, whatever the session sets; text around an object is judged as ever."""
    cases = [
        ('{"is_ai_modified": false, "confidence": 0.1, "is_ai_modified": "yes"}', True, 0.1, None, False),
        ('Well: {"confidence": 0.1, "is_ai_modified": true, "confidence": 0.75, "reason": "a", "reason": "b"} bye', True, 0.75, "b", False),
        ('```json\n{"is_ai_generated": true, "is_ai_generated": null}\n```', None, None, None, False),
        ('{"is_ai_modified": true, "is_ai_modified": false} and {"is_ai_modified": true}', None, None, None, True),
        ('{"is_ai_modified": true, "is_ai_modified": false', None, None, None, True),
        ("{'is_ai_modified': true, 'is_ai_modified': false}", None, None, None, True),
        ('{"other": 1, "other": 2}', None, None, None, False),
    ]
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
    try:
        got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string").select("i", vd.parse_reply("raw").alias("v")).select("i", *vd.verdict_columns("v")).orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    assert [(r.is_ai_modified, r.confidence, r.reason, r.error is not None) for r in got] == [c[1:] for c in cases]


def test_documents_of_a_hot_group_are_cut(spark, in_parts, tmp_path):
    """No document has more than the stated rows, however many a group has, and the readers put them together."""
    recs = [("m", "hot" if i % 10 else "cold", "d", "b", f"r{i:04}", 1, True, 0.5, None) for i in range(1000)]
    df = spark.createDataFrame(recs, "mode string, category string, detector string, bucket string, ident string, num_images long, is_ai_modified boolean, confidence double, error string")
    docs = store.to_bundles(df, ["mode", "category", "detector", "bucket"], 64)
    sizes = sorted((r.category, r.n) for r in docs.select("category", F.size("results").alias("n")).collect())
    assert [n for c, n in sizes if c == "hot"] == [4] + [64] * 14 and [n for c, n in sizes if c == "cold"] == [36, 64]
    docs.drop("shard").write.partitionBy("mode", "category").json(str(tmp_path / "b"))
    assert {(r.mode, r.category, r.detector, r.ident) for r in files.read_bundles(spark, str(tmp_path / "b")).collect()} == {(*r[:3], r[4]) for r in recs}
    jobs = df.withColumn("label", F.lit("Negative")).withColumn("generator", F.lit(None).cast("string")).withColumn("status", F.lit("ok"))
    rolled = store.to_documents(jobs, ["mode", "category"], 100)
    assert max(r.n for r in rolled.select(F.size("rows").alias("n")).collect()) == 100
    files.write_summaries(rolled, str(tmp_path / "s"))
    assert files.read_summaries(spark, str(tmp_path / "s")).count() == 1000
    items = spark.createDataFrame([("x", None, {"n": str(i % 7)}) for i in range(50)], "detector string, generator string, item map<string,string>")
    arrays = store.to_item_arrays(items, ["detector", "generator"], 20).collect()
    assert sorted(r.value.count("{") for r in arrays) == [10, 20, 20]


def test_metric_tables_are_replaced_by_mode(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "category string, x double, mode string"
    put = lambda rows: files.write_metric_tables(spark.createDataFrame(rows, schema), path)
    put([("a", 1.0, "m1"), ("b", 2.0, "m1"), ("a", 3.0, "m 2/x")])
    put([("a", 9.0, "m1")])
    put([])
    assert sorted(map(tuple, files.read_metric_tables(spark, path, schema).collect())) == [("a", 3.0, "m 2/x"), ("a", 9.0, "m1")]
    one = files.read_metric_tables(spark, path, schema, ["m1"])
    assert one.count() == 1 and "PartitionFilters: [isnotnull(mode" in one._jdf.queryExecution().toString()


def test_platforms_and_names(spark):
    rows = spark.createDataFrame([("c1", "m", "d"), ("c2", "m", None), ("c2", "n", "d"), ("c9", "m", "d"), (None, "m", "d")], "category string, mode string, detector string")
    dims = spark.createDataFrame([("c1", "p"), ("c2", "q"), ("c3", "q")], "category string, platform string")
    assert sorted((r.category, r.platform) for r in catalog.with_platform(rows, dims).collect()) == [("c1", "p"), ("c2", "q"), ("c2", "q")]
    assert {r.category for r in catalog.with_platform(rows, dims, ["q"]).collect()} == {"c2"}
    report = catalog.shape_report(catalog.with_platform(rows, dims), "platform", ["mode", "detector"])
    assert report._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") == 2  # the rows once, the dimension once
    assert {tuple(r) for r in report.collect()} == {("mode", "p", "m", 1), ("mode", "q", "m", 1), ("mode", "q", "n", 1), ("detector", "p", "d", 1), ("detector", "q", None, 1), ("detector", "q", "d", 1)}
    wanted = spark.createDataFrame([("category", "c1"), ("category", "c7"), ("mode", "n"), ("detector", "D")], "kind string, name string")
    assert sorted(map(tuple, catalog.unknown_names(rows, wanted).collect())) == [("category", "c7"), ("detector", "D")]


def test_listing_of_a_tree(spark, tmp_path):
    for name in ("category=c a/label=DeepFake/generator=g1/x.JPG", "category=c a/label=DeepFake/generator=g1/y.txt", "category=c a/label=Negative/generator=none/z.png", "category=d/label=DeepFake/w.gif"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"1")
    got = catalog.image_catalog(catalog.listed(files.list_images(spark, str(tmp_path)))).collect()
    assert sorted((r.category, r.label, r.bucket, r.generator or "") for r in got) == [("c a", "DeepFake", "DeepFake/g1", "g1"), ("c a", "Negative", "Negative", ""), ("d", "DeepFake", "DeepFake", "")]


def test_nan_confidence_and_findings(spark):
    df = spark.createDataFrame([('{"is_ai_modified": true, "confidence": NaN, "per_image": [{"index": 1}, 2]}',), ('{"per_image": "none"}',)], "raw string").select(vd.parse_reply("raw").alias("v"))
    got = df.select(F.isnan(vd.confidence("v")).alias("nan"), F.size(vd.findings("v")).alias("n")).collect()
    assert (got[0].nan, got[0].n) == (True, 2) and got[1].n in (None, -1)


def test_flags(spark):
    df = spark.createDataFrame([(None, None), ("", None), ("missing", None), ("ok", None), ("error", "x"), ("ok", "x")], "status string, error string")
    assert [tuple(r) for r in df.select(*vd.flags("status", "error")).collect()] == [(False, False), (False, False), (False, False), (True, True), (True, False), (True, False)]


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT)


BASE = ("MultiTurn-x", "c", "d")


def test_main_and_ablation_policies_differ(spark):
    rows = [
        (*BASE, "Negative", None, 2, "ok", None, False, 0.5), (*BASE, "Negative", None, 2, "error", "x", None, None), (*BASE, "Negative", None, 2, "ok", None, None, 0.9),
        (*BASE, "Negative", None, 2, "missing", None, None, None), (*BASE, "Negative", None, 2, None, None, None, None), (*BASE, "Negative", None, 1, "ok", None, False, 0.1),
        (*BASE, "DeepFake", "g1", 2, "ok", None, True, float("nan")), (*BASE, "DeepFake", "g1", 2, "ok", None, None, 0.3), (*BASE, "DeepFake", "other", 2, "ok", None, True, 0.3),
    ]
    key = lambda df: {r.bucket: (r.correct, r.total, r.conf_n) for r in df.collect()}
    assert key(metrics.confusion_counts(facts(spark, rows), G)) == {"Negative": (1, 3, 1), "g1": (1, 2, 0)}
    assert key(metrics.confusion_counts(facts(spark, rows), G, "ok_only", False)) == {"Negative": (3, 3, 3), "g1": (1, 2, 1)}


def test_metrics_undefined_and_macro(spark):
    rows = [("S", "a", "d", "Negative", None, 1, "ok", None, False, 0.5), ("S", "b", "d", "DeepFake", "g1", 1, "ok", None, False, 0.5), ("S", "c", "d", "DeepFake", "g1", 1, "ok", None, True, 0.7)]
    cat = {r.category: r for r in metrics.category_metrics(metrics.confusion_counts(facts(spark, rows), G), G).collect()}
    assert cat["a"].neg_tnr == 1 and cat["a"].overall_bal_acc is None and cat["a"].overall_f1 is None and cat["a"].g1_tpr is None
    assert cat["b"].neg_tnr is None and cat["b"].g1_tpr == 0 and cat["b"].neg_precision == 0
    m = metrics.macro_metrics(metrics.category_metrics(metrics.confusion_counts(facts(spark, rows), G), G), G, spark.createDataFrame([("d", 0), ("none", 1)], "detector string, pos int"))
    by = {r.detector: r for r in m.collect()}
    assert by["d"].g1_tpr == 0.5 and by["d"].neg_tnr == 1 and by["none"].neg_tnr is None


def test_never_run_jobs_leave_metrics(spark):
    rows = [(*BASE, "Negative", None, 2, "ok", None, i % 3 == 0, 0.5) for i in range(9)]
    more = [(*BASE, "Negative", None, 2, "missing", None, None, None)] * 20
    get = lambda r: metrics.category_metrics(metrics.confusion_counts(facts(spark, r), G), G).first()
    assert get(rows) == get(rows + more)


def test_classic_rules(spark):
    items = [
        ("x", "c", "Negative", None, {"no": "1"}), ("x", "c", "Negative", None, {"p": " fake ", "s": "0.2"}), ("x", "c", "Negative", None, {"p": "real", "s": "bad"}),
        ("x", "c", "Deepfake", "g1", {"p": "fake", "s": "0.9"}), ("x", "c", "DeepFake", "g1", {"p": "real"}), ("x", "c", "DeepFake", "g1", {"p": "real"}), ("x", "c", "DeepFake", "g2", {"p": "fake"}),
    ]
    df = spark.createDataFrame(items, "detector string, category string, folder string, generator string, item map<string,string>")
    config = spark.createDataFrame([("x", "p", ["fake"], "s")], "detector string, pred_field string, fake_values array<string>, score_field string")
    got = {r.bucket: (r.correct, r.total, r.conf_n) for r in metrics.classic_counts(df, config).collect()}
    assert got == {"Negative": (2, 3, 0), "g1": (1, 1, 1), "g2": (1, 1, 0)}


REC = "mode string, category string, bucket string, ident string, detector string, status string, is_ai_modified boolean, confidence double, error string, num_images long"


def test_merge_truth_table(spark):
    states = [None, "missing", "error", "ok"]
    row = lambda i, s, n: ("m", "c", "b", str(i), "d", s, s == "ok", None, "x" if s == "error" else None, n)
    pairs = [(a, b) for a in states for b in states]
    old = spark.createDataFrame([row(i, a, 1) for i, (a, _) in enumerate(pairs) if a], REC)
    new = spark.createDataFrame([row(i, b, 2) for i, (_, b) in enumerate(pairs) if b], REC)
    got = {int(r.ident): (r.status, r.num_images) for r in store.merge_summary(old, new).collect()}
    for i, (a, b) in enumerate(pairs):
        want = b if b and not (b == "missing" and a not in (None, "missing")) else a
        assert got.get(i) == ((want, 2 if b else 1) if want else None), (a, b)


def test_same_path_in_seven_buckets(spark):
    recs = spark.createDataFrame([("m", "c", f"b{i}", "r/x.jpg", "d", "ok", True, 0.1, None, 1) for i in range(7)] * 2, REC).withColumn("t", F.monotonically_increasing_id())
    assert store.latest_records(recs, ["mode", "category", "bucket", "ident", "detector"], ["t"]).count() == 7


def test_rebuild_equals_merge_of_itself(spark):
    recs = spark.createDataFrame([("m", "c", "b", "1", "d1", "ok", True, 0.1, None, 1), ("m", "c", "b", "2", "d2", "error", None, None, "x", 1)], REC)
    jobs = recs.select("mode", "category", "bucket", "ident", "num_images").distinct()
    full = store.rebuild_summary(jobs, spark.createDataFrame([("d1",), ("d2",)], "detector string"), recs)
    assert {(r.ident, r.detector): r.status for r in full.collect()} == {("1", "d1"): "ok", ("1", "d2"): "missing", ("2", "d1"): "missing", ("2", "d2"): "error"}
    merged = store.merge_summary(full, recs)
    cols = ["ident", "detector", "status"]
    assert sorted(map(tuple, merged.select(cols).collect())) == sorted(map(tuple, full.select(cols).collect()))


def test_pending_and_done_are_the_grid(spark):
    grid = spark.createDataFrame([(i, d) for i in range(5) for d in "ab"], "ident int, detector string")
    recs = spark.createDataFrame([(0, "a", None, "ok"), (1, "a", "x", "error"), (2, "b", None, "missing")], "ident int, detector string, error string, status string")
    done = tasks.done_tasks(recs, ["ident", "detector"])
    left = tasks.pending_tasks(grid, done, ["ident", "detector"])
    assert left.count() == 8 and left.join(done, ["ident", "detector"]).count() == 0
    assert tasks.done_tasks(recs, ["ident"], "ok").count() == 1


def _shuffled(spark, before: int = 0) -> tuple[int, int]:
    """The newest stage, and the rows that stages after ``before`` have shuffled."""
    jvm, sc = spark._jvm, spark._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return max((x.stageId() for x in stages), default=0), sum(x.shuffleWriteRecords() for x in stages if x.stageId() > before)


def test_run_plan_counts_the_grid_and_does_not_make_it(spark):
    of, keys = "mode string, ident string, num_images int", ["mode", "ident", "detector"]
    jobs = spark.createDataFrame([(f"m{i % 2}", str(i), i % 3 or None) for i in range(200)] + [("m0", None, 2)], of)
    roster = spark.createDataFrame([(f"d{i}",) for i in [*range(50), 3]], "detector string")  # a row of the roster twice
    done = [("m0", "0", "d0"), ("m0", "0", "d0"), ("m0", "0", "d3"), ("m1", "1", "d3"), ("m0", None, "d1"), ("m1", "1", "d77"), ("m1", "9999", "d1"), ("m9", "1", "d1")]
    before, _ = _shuffled(spark)
    for per_image in (False, True):
        got = {r.mode: tuple(r)[1:] for r in tasks.run_plan(jobs, roster, spark.createDataFrame(done, "mode string, ident string, detector string"), keys, keys[:2], ["mode"], per_image).collect()}
        images = {m: [i % 3 or 1 if per_image else 1 for i in range(200) if i % 2 == int(m[1])] for m in ("m0", "m1")}
        images["m0"].append(2 if per_image else 1)
        assert got["m0"] == (101, 101 * 51, 3, 101 * 51 - 3, 51 * sum(images["m0"]) - 3)
        assert got["m1"] == (100, 100 * 51, 2, 100 * 51 - 2, 51 * sum(images["m1"]) - 2)
        assert len(got) == 2
    assert _shuffled(spark, before)[1] < 2000  # of 10,251 pairs each time


def test_run_plan_query_equals_sql_and_shuffles_no_pairs(spark, tmp_path):
    from veritally.plans.oracle import ORACLE_SQL
    from veritally.plans.queries import QUERIES

    con = duckdb.connect()
    con.execute("create table lineitem as select (i // 4)::bigint as l_orderkey, i::bigint as l_partkey, (case when i % 40 > 1 then i * 7 % 23 end)::bigint as l_suppkey, (i % 4)::int as l_linenumber, timestamp '1995-01-01' + to_days((i * 13 % 900)::int) as l_shipdate from range(8000) t(i)")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    want = sorted(con.execute(ORACLE_SQL["run_plan"]).fetchall())
    before, _ = _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        got = QUERIES["run_plan"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(tuple(r[c] for c in ("mode", "jobs", "pairs", "skipped", "to_run", "calls")) for r in got) == want
    assert _shuffled(spark, before)[1] < 20_000  # records, jobs and done tasks, and none of the 20,000 pairs


def test_sample_size_and_determinism(spark):
    sizes = {"a": 1, "b": 4, "c": 15, "d": 25, "e": 35}
    rows = spark.createDataFrame([(s, f"{s}{i}") for s, n in sizes.items() for i in range(n)], "stratum string, path string")
    draw = lambda df: sorted(r.path for r in sampling.stratified_sample(df, ["stratum"], "path", 0.1, 42).collect())
    first = draw(rows)
    assert [sum(p[0] == s for p in first) for s in sizes] == [1, 1, 2, 2, 4]
    assert first == draw(rows.repartition(7)) == draw(rows.orderBy(F.desc("path")))
    kept = catalog.keep_generators(spark.createDataFrame([("x", None), ("y", "g1"), ("z", "g9")], "path string, generator string"), ["g1"])
    assert sorted(r.path for r in kept.collect()) == ["x", "y"]


def test_pairs_cross_categories_evenly(spark):
    pool = spark.createDataFrame([(c, f"{c}{i}") for c, n in (("a", 50), ("b", 30), ("c", 20)) for i in range(n)], "category string, review string")
    sample = spark.createDataFrame([("a", f"s{i}") for i in range(2000)] + [("new", "t")], "category string, image string")
    got = sampling.mismatch_pairs(sample, pool, "category", "image", "review", 1).collect()
    assert len(got) == 2001 and all(r.category != r.review_source_category for r in got)
    b = sum(r.review_source_category == "b" for r in got if r.category == "a") / 2000
    assert 0.54 < b < 0.66
    alone = spark.createDataFrame([("a", "r1")], "category string, review string")
    assert sampling.mismatch_pairs(sample.where("category = 'a'"), alone, "category", "image", "review", 1).count() == 0


def test_comments(spark):
    images = spark.createDataFrame([("c", "1", "x.jpg", "Negative"), ("c", "1", "x.jpg", "DeepFake"), ("c", "2", "y.jpg", "DeepFake"), ("c", None, "z.jpg", "Negative"), ("c", "1", "x.jpg", None)], "category string, number string, image string, label string")
    reviews = spark.createDataFrame([("c", "1", " title ", "body")], "category string, number string, title string, body string")
    edits = spark.createDataFrame([("c", "1", "x.jpg", 0, "first"), ("c", "1", "x.jpg", 1, "last"), ("c", "2", "y.jpg", 0, "")], "category string, number string, image string, pos int, reviewer_comment string")
    got = sorted((r.label or "", r.number or "", r.comment or "") for r in catalog.attach_comments(images, reviews, edits).collect())
    assert got == [("", "1", ""), ("DeepFake", "1", "last"), ("DeepFake", "2", ""), ("Negative", "", ""), ("Negative", "1", "title. body")]


def test_review_meta_shapes(spark, tmp_path):
    for number, line in (("1", '{"title": "t", "text": "b"}'), ("2", '{"content": "only"}'), ("3", '{"review_text": "food"}'), ("4", "not json")):
        (tmp_path / f"category=c/number={number}").mkdir(parents=True)
        (tmp_path / f"category=c/number={number}/m.json").write_text(line)
    df = files.read_review_meta(spark, str(tmp_path)).select("number", tx.review_text("title", "body").alias("t"))
    assert {k: v for k, v in one(df).items() if k[0] != "4"} == {("1",): "t. b", ("2",): "only", ("3",): "food"}


def test_catalog_paths(spark):
    paths = [("r/a.JPG", 0, "c", "DeepFake", "g1/R_1/a.JPG"), ("r/a.JPG", 1, "c", "Negative", "a.JPG"), ("r/b.txt", 0, "c", "Negative", "b.txt"), ("r/c.png", 0, "c", "DeepFake", "c.png"), ("r/d.png", 0, "c", None, "R_2/d.png")]
    got = {r.path: (r.bucket, r.generator, r.rel) for r in catalog.image_catalog(spark.createDataFrame(paths, "path string, input_pos int, category string, label string, rel string")).collect()}
    assert got == {"r/a.JPG": ("DeepFake/g1", "g1", "R_1/a.JPG"), "r/c.png": ("DeepFake", None, "c.png"), "r/d.png": ("unlabeled", None, "R_2/d.png")}
    rows = [("c/Negative/Review_1/a.jpg",), ("c/Negative/x/a.jpg",), ("c/DeepFake/g1/Review_1/.a.jpg",), ("c/DeepFake/g9/Review_1/a.jpg",), ("c/DeepFake/g1/Review_1/a.gif",), ("c/DeepFake/g1/Review_1/a.png",)]
    assert sorted(r.rel_path for r in catalog.human_catalog(spark.createDataFrame(rows, "path string"), ["g1"]).collect()) == ["c/DeepFake/g1/Review_1/a.png", "c/Negative/Review_1/a.jpg"]


def test_turns(spark):
    t = spark.createDataFrame([(1, 0, "a", True), (1, 1, "a", False), (1, 2, "b", None), (1, 3, None, True), (2, 0, "", True)], "conv_id int, turn int, comment string, is_ai_modified boolean")
    assert sorted((r.conv_id, r.turn) for r in turns.first_comment_turns(t).collect()) == [(1, 0), (1, 2)]
    assert [(r.turn, r.flipped) for r in turns.verdict_trajectory(t).orderBy("turn").collect()] == [(0, False), (1, True), (2, False)]


def test_fold_of_a_log(spark):
    acts = [(1, "undo", None, None), (2, "submit", 5, "real"), (3, "submit", 5, "fake"), (4, "submit", 6, "fake"), (5, "undo", None, None), (6, "undo", None, None), (7, "undo", None, None), (8, "submit", 6, "real")]
    assert human.fold(acts) == [(6, "real", 8)]
    rng = random.Random(3)
    rows = [(e, i, rng.choice(["submit", "submit", "undo"]), rng.randrange(9), "real") for e in (1, 2) for i in range(80)]
    log = spark.createDataFrame(rows, "evaluator long, seq long, action string, image_no long, choice string")
    want = sorted((e, *s) for e in (1, 2) for s in human.fold([r[1:] for r in rows if r[0] == e]))
    assert sorted(map(tuple, human.human_standing(log.repartition(5)).collect())) == want


def folded(rows, by=1):
    logs = {}
    for r in sorted(rows, key=lambda r: r[by]):
        logs.setdefault(r[:by], []).append(r[by:])
    return sorted(((*k, *s) for k, v in logs.items() for s in human.fold(v)), key=str)


@pytest.mark.parametrize("rounds", [0, 2])
def test_standing_of_hard_logs(spark, in_parts, rounds):
    """Random logs with many repeats, and one evaluator with most rows, so spread over tasks; whatever the rounds, the fold's result."""
    rng = random.Random(rounds)
    rows = [(("hot", "ann", None)[rng.choice([0, 0, 0, 0, 1, 2])], rng.choice(["All", None]), i, rng.choice(["submit", "submit", "undo"]), rng.choice([*range(12), None]), rng.choice(["real", "fake"])) for i in range(900)]
    log = spark.createDataFrame([(*r, "x", 1) for r in rows], "evaluator string, scope string, seq long, action string, image_no long, choice string, row string, depth int").repartition(3)
    got = human.human_standing(log, ["evaluator", "scope"], rounds)
    assert sorted(map(tuple, got.collect()), key=str) == folded(rows, 2)


def test_accepted_logs_need_one_round(spark, in_parts, monkeypatch):
    """No submit of a standing image: undos are matched by depth alone, over ranges of one long log."""
    rng, rows, standing = random.Random(5), [], []
    for i in range(2000):
        if standing and rng.random() < 0.48:
            standing.pop()
            rows.append((1, i, "undo", None, None))
        else:
            standing.append(i)
            rows.append((1, i, "submit", i, "real"))
    names = []
    monkeypatch.setattr(human, "written", lambda df, name, keep=human.written: names.append(name) or keep(df, name))
    log = spark.createDataFrame(rows, "evaluator long, seq long, action string, image_no long, choice string")
    got = human.human_standing(log)
    assert sorted(r.image_no for r in got.collect()) == standing and names.count("turns") == 1
    assert human.human_standing(log.limit(0)).collect() == []


def test_ranges_over_a_hot_key(spark, in_parts):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", None]), i, rng.choice([1, -1, -1, 0]), rng.randrange(99)) for i in range(1500)]
    df = files.written(spark.createDataFrame(rows, "k string, i long, step int, v long"), "ranges")
    at = ranges.placed(df, ["k"], ["i"], "ranges")
    assert at.where("k = 'hot'").select("block").distinct().count() > 1
    deep = {r.i: (r.depth, r.taken) for r in ranges.stack_depth(at, ["k"], F.col("step")).collect()}
    top = {r.i: r.top for r in ranges.max_before(at, ["k"], "v", "top").collect()}
    pos = {r.i: r.pos for r in ranges.numbered(at, ["k"], "ranges").collect()}
    for k in ("hot", None):
        depth, most = 0, None
        for n, (_, i, step, v) in enumerate(r for r in rows if r[0] == k):
            taken = step >= 0 or depth > 0
            depth = max(0, depth + step)
            assert deep[i] == (depth, taken) and top[i] == most and pos[i] == n
            most = max(v, most if most is not None else v)


def test_unseen_pools(spark):
    catalog = spark.createDataFrame([(i, f"c{i % 2}", "real" if i % 4 == 0 else "fake", "x") for i in (*range(40), 70_000)], "image_no long, category string, true_label string, seen string")
    standing = spark.createDataFrame([("ann", "All", 4), ("ann", "All", 5), ("ann", "All", 70_000), ("ann", "All", 999), ("bob", "c1", 3), ("bob", "c1", 4)], "evaluator string, scope string, image_no long")
    logs = standing.select("evaluator", "scope").unionByName(spark.createDataFrame([("cy", "c0"), ("cy", "none")], "evaluator string, scope string"))
    got = {tuple(r[:2]): tuple(r[2:]) for r in human.unseen_pools(catalog, standing, logs).collect()}
    assert got == {("ann", "All"): (3, 41, 9, 29), ("bob", "c1"): (1, 20, 0, 19), ("cy", "c0"): (0, 21, 11, 10), ("cy", "none"): (0, 0, 0, 0)}
    plan = human.unseen_pools(catalog, standing, logs)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_accuracy_in_one_pass(spark):
    rows = [("a", "All", "Negative", None, "real", "real"), ("a", "All", "Negative", None, "fake", "real"), ("a", "c", "DeepFake", "g", "fake", "fake"), ("a", "c", None, None, None, "fake")]
    df = human.human_accuracy(spark.createDataFrame(rows, "evaluator string, scope string, bucket string, gen_model string, choice string, true_label string"), ["evaluator", "scope"])
    got = {tuple(r[:4]): tuple(r[4:]) for r in df.collect()}
    assert got == {("a", "All", "Negative", None): (2, 1, 0.5), ("a", "All", "all", None): (2, 1, 0.5), ("a", "c", "DeepFake", "g"): (1, 1, 1.0), ("a", "c", None, None): (1, 0, 0.0), ("a", "c", "all", None): (2, 1, 0.5)}
    assert df.select("*")._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_queue_is_balanced(spark):
    cat = spark.createDataFrame([(f"i{i}", "real" if i % 4 == 0 else "fake", f"r{i % 9}") for i in range(200)], "image_id string, true_label string, review string")
    queue = human.labelling_queue(cat, spark.createDataFrame([("ann",), ("bob",)], "evaluator string"), 1, 60)
    q = queue.where("evaluator = 'ann'").orderBy("pos").collect()
    assert [r.pos for r in q] == list(range(1, 61)) and sum(r.true_label == "real" for r in q) == 30 and len({r.image_id for r in q}) == 60
    assert {r.image_id for r in q} != {r.image_id for r in queue.where("evaluator = 'bob'").collect()}
    plan = queue._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    all_of = human.labelling_queue(cat, spark.createDataFrame([("ann",)], "evaluator string"), 1, 500).orderBy("pos").collect()
    assert sorted(r.image_id for r in all_of) == sorted(f"i{i}" for i in range(200)) and [r.pos for r in all_of] == list(range(1, 201))


def _queue_by_hand(catalog, evaluator, seed, per_evaluator):
    h = lambda x: int(hashlib.md5(f"{seed}|{evaluator}|{x}".encode()).hexdigest()[:15], 16)
    sides = [sorted((h(i), i) for i, label, _ in catalog if label == side)[:per_evaluator] for side in ("fake", "real")]
    ranked = sorted((r, k, i) for k, side in enumerate(sides) for r, (_, i) in enumerate(side))
    return [i for _, _, i in ranked][:per_evaluator]


@pytest.mark.parametrize("per_evaluator", [7, 60, 500])
def test_queue_is_ordered_for_each_evaluator_alone(spark, in_parts, per_evaluator):
    rows = [(f"i{i}", "real" if i % 4 == 0 else "fake", f"r{i % 9}") for i in range(2000)]
    cat = spark.createDataFrame(rows, "image_id string, true_label string, review string")
    queue = human.labelling_queue(cat, spark.createDataFrame([("ann",), ("bob",), ("cy",)], "evaluator string"), 7, per_evaluator)
    got = {}
    for r in queue.orderBy("evaluator", "pos").collect():
        got.setdefault(r.evaluator, []).append(r.image_id)
    assert got == {e: _queue_by_hand(rows, e, 7, per_evaluator) for e in ("ann", "bob", "cy")}


def test_queue_fills_sides_whose_least_hashes_are_too_few(spark, in_parts, monkeypatch):
    rows = [(f"i{i}", "real" if i % 4 == 0 else "fake", f"r{i % 9}") for i in range(2000)]
    cat = spark.createDataFrame(rows, "image_id string, true_label string, review string")
    hashed = human.keyed_hash
    # hashes in the upper half alone, in the same order: far fewer than expected lie below the bound
    monkeypatch.setattr(human, "keyed_hash", lambda *parts: F.shiftright(hashed(*parts), 1) + F.lit(2**59))
    queue = human.labelling_queue(cat, spark.createDataFrame([("ann",), ("bob",)], "evaluator string"), 7, 40)
    got = {}
    for r in queue.orderBy("evaluator", "pos").collect():
        got.setdefault(r.evaluator, []).append(r.image_id)
    assert got == {e: _queue_by_hand(rows, e, 7, 40) for e in ("ann", "bob")}


def test_repeats_come_from_each_evaluators_own_order(spark):
    rows = [(f"i{i}", "real" if i % 4 == 0 else "fake", f"r{i % 9}") for i in range(2000)]
    cat = spark.createDataFrame(rows, "image_id string, true_label string, review string")
    queue = human.labelling_queue(cat, spark.createDataFrame([("ann",), ("bob",)], "evaluator string"), 7, 100)
    got = {(r.evaluator, r.pos, r.review, r.gap) for r in human.recency_repeats(queue, ["review"], 5).collect()}
    review, want = {i: r for i, _, r in rows}, set()
    for e in ("ann", "bob"):
        last = {}
        for pos, i in enumerate(_queue_by_hand(rows, e, 7, 100), 1):
            gap = pos - last.get(review[i], -100)
            want |= {(e, pos, review[i], gap)} if gap <= 5 else set()
            last[review[i]] = pos
    assert got == want


def test_names_and_errors(spark):
    df = spark.createDataFrame([("  a b/c ",), ("   ",), (None,)], "x string").select(tx.safe_name("x").alias("n"))
    assert [r.n for r in df.collect()] == ["a_b_c", "anonymous", "anonymous"]
    cases = [
        ("HTTP 413: x", "too_large"), ("HTTP 400: maximum request size", "too_large"), ("HTTP 400: payload is large", "too_large"), ("HTTP 404: image size", "other_4xx"),
        ("HTTP 400: Download multimodal file timed out", "upstream_transient"), ("HTTP 400: download timed out", "other_4xx"), ("HTTP 400: failed to fetch the file", "upstream_transient"),
        ("HTTP 500: failed to fetch the file", "other"), ("HTTP 429: slow", "rate_limit"), ("HTTP 404", "other_4xx"), ("Broken pipe", "connection_dropped"), ("?", "other"), (None, None),
    ]
    e = spark.createDataFrame(cases, "e string, k string").select("k", tx.error_class("e").alias("got"))
    assert [r.got for r in e.collect()] == [r.k for r in e.collect()]
    cells = spark.createDataFrame([(0.5,), (None,)], "x double").select(tx.metric_cell("x").alias("c"))
    assert [r.c for r in cells.collect()] == ["0.500", "—"]


def test_cells_round_doubles_as_the_sql_does(spark):
    import duckdb

    values = [k / 80 for k in range(81)] + [k / 2000 for k in range(2001)] + [0.5025, 0.5075, 0.0625, 0.0078125, 1.0, -0.5025]
    got = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", tx.metric_cell(tx.rounded_double("x", 6)).alias("c")).orderBy("i").collect()
    want = duckdb.sql(f"select printf('%.3f', round(round(x, 6), 3)) from (select unnest({values!r}::double[]) as x, unnest(range({len(values)})) as i) order by i").fetchall()
    assert [r.c for r in got] == [w[0] for w in want]
    assert got[2082].c == "0.502" and got[2083].c == "0.507"


def test_streams_stop_and_go_on(spark, tmp_path):
    """Runs over a growing folder, of several micro-batches each, give what one batch gives, and read each row once."""
    schema = "evaluator long, seq long, action string, image_no long, choice string, detector string, error string, is_ai_modified boolean, label string"
    rng = random.Random(9)
    rows = [(rng.randrange(3), i, rng.choice(["submit", "submit", "undo"]), rng.randrange(9), "real", f"d{i % 2}", None if i % 3 else "x", i % 4 > 0, "Negative" if i % 5 else "DeepFake") for i in range(120)]
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: (
        streams.stream_upsert(source().select("evaluator", "seq", "choice"), ["evaluator"], ["seq"], str(tmp_path / "a")).collect(),
        streams.stream_progress(source(), ["detector"], str(tmp_path / "b"), str(tmp_path / "elsewhere")).collect(),
        streams.stream_human(source(), str(tmp_path / "c")).collect(),
    )
    for part in (rows[:70], rows[70:100], rows[100:]):
        for i in range(0, len(part), 40):
            spark.createDataFrame(part[i : i + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upserts, progress, standing = run()
    assert {r.evaluator: r.seq for r in upserts} == {e: max(r[1] for r in rows if r[0] == e) for e in range(3)}
    good = lambda d, n: sum(r[5] == d and (r[6] is None, r[6] is not None, r[6] is None and r[7] == (r[8] != "Negative"))[n] for r in rows)
    assert {r.detector: (r.ok, r.fail, r.right, r.accuracy) for r in progress} == {d: (*[good(d, n) for n in range(3)], good(d, 2) / 60) for d in ("d0", "d1")}
    assert sorted((r.evaluator, r.image_no, r.choice, r.seq) for r in standing) == sorted((e, *s) for e in range(3) for s in human.fold([r[1:5] for r in rows if r[0] == e]))
    assert {tuple(x) for part in run() for x in part} == {tuple(x) for part in (upserts, progress, standing) for x in part}
    assert (tmp_path / "elsewhere").is_dir() and len(list((tmp_path / "a/rows").glob("v=*"))) >= 2


def test_states_tell_changes_only(spark, tmp_path):
    """A batch of a log writes the images whose standing it changed, not the stack."""
    schema = "evaluator long, seq long, action string, image_no long, choice string"
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, i, "submit", i, "real") for i in range(200)])
    assert len(streams.stream_human(source(), str(tmp_path / "s")).collect()) == 200
    seen = []
    merge = streams.Store.merge
    streams.Store.merge = lambda self, batch, n, combine: seen.append(sorted((r.image_no, r.stands) for r in batch.collect())) or merge(self, batch, n, combine)
    try:
        put([(1, 200, "undo", None, None), (1, 201, "submit", 5, "fake"), (1, 202, "submit", 900, None), (1, 203, "undo", None, None)])
        assert {r.image_no for r in streams.stream_human(source(), str(tmp_path / "s")).collect()} == set(range(199))
    finally:
        streams.Store.merge = merge
    assert [x for x in seen if x] == [[(199, False), (900, False)]]


def test_store_grows_and_rewrites_what_a_batch_touches(spark, tmp_path):
    rng = random.Random(12)
    kept = streams.Store(str(tmp_path / "s"), ("g", "k"), ("g",), families=8, max_rows=50, rollup=lambda df: df.groupBy(*streams.PLACE, "g").agg(F.count("*").alias("n"), F.sum("v").alias("v")))
    schema, want, files_of = "g string, k long, v long, t long", {}, lambda: {str(p) for p in (tmp_path / "s/rows").rglob("part-*.parquet")}
    family = {r.g: r.f for r in spark.createDataFrame([(g,) for g in "abcdef"], "g string").select("g", kept.family().alias("f")).collect()}
    for n in range(5):
        groups = "abcdef" if n == 0 else "a"
        rows = [(rng.choice(groups), rng.randrange(400), rng.randrange(9), 1000 * n + i) for i in range(300)]
        before = files_of()
        kept.merge(spark.createDataFrame(rows, schema), n, lambda df: store_latest(df))
        want |= {r[:2]: r[2:] for r in sorted(rows, key=lambda r: r[3])}
        new = files_of() - before
        assert n == 0 or all(f"family={family['a']}/" in p for p in new)
        assert {(r.g, r.k): (r.v, r.t) for r in kept.read(spark, schema).collect()} == want
        rolled = {r.g: (r.n, r.v) for r in kept.read(spark, "g string, n long, v long", "rollup").groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
        assert rolled == {g: (sum(k[0] == g for k in want), sum(v[0] for k, v in want.items() if k[0] == g)) for g in {k[0] for k in want}}
    versions = kept.versions(spark)
    depth = kept.depths(versions)
    assert depth[family["a"]] >= 3 and all(len(v) <= 2 for v in versions.values())
    sizes = spark.read.parquet(*kept.newest(versions).values()).count()
    assert sizes == len(want)
    one = spark.createDataFrame([("a", 7, 1, 10**6)], schema)
    before = files_of()
    kept.merge(one, 5, lambda df: store_latest(df))
    kept.merge(one, 5, lambda df: store_latest(df))  # a batch that runs twice
    assert len({p.rsplit("/", 1)[0] for p in files_of() - before}) == 1
    assert {(r.g, r.k): r.t for r in kept.read(spark, schema).collect()} == {k: v[1] for k, v in want.items()} | {("a", 7): 10**6}


def store_latest(df):
    return store.latest_records(df, ["g", "k"], ["t"]).select("g", "k", "v", "t")


def test_edit_meta_and_listing(spark, tmp_path):
    (tmp_path / "category=c/number=1").mkdir(parents=True)
    (tmp_path / "category=c/number=1/e.json").write_text('{"per_image": [{"image": "a.jpg", "reviewer_comment": "x"}, {"image": "b.jpg"}]}')
    assert sorted((r.number, r.pos, r.image, r.reviewer_comment) for r in files.read_edit_meta(spark, str(tmp_path)).collect()) == [("1", 0, "a.jpg", "x"), ("1", 1, "b.jpg", None)]
    (tmp_path / "x.PNG").write_bytes(b"123")
    (tmp_path / "x.txt").write_bytes(b"12")
    listed = files.list_images(spark, str(tmp_path)).select("path", F.lit(0).alias("input_pos"), F.lit("c").alias("category"), F.lit("Negative").alias("label"), F.element_at(F.split("path", "/"), -1).alias("rel"))
    assert [r.rel for r in catalog.image_catalog(listed).collect()] == ["x.PNG"]
    old = spark.createDataFrame([(1,)], "a int")
    assert store.same_shape(old, "review", "image").count() == 0 and store.same_shape(old, "review", "review").count() == 1
