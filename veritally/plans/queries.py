"""Every job of the library over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions import requests as rq
from veritally.functions import text as tx
from veritally.functions import verdicts as vd
from veritally.operators import catalog as ct
from veritally.operators import human as hm
from veritally.operators import metrics as mt
from veritally.operators import sampling as sm
from veritally.operators import store as st
from veritally.operators import tasks as tk
from veritally.operators import turns as tu
from veritally.plans.fixtures import CLASSIC, DETECTORS, GENERATORS, MODES, PLATFORMS, view
from veritally.sources import files as fl
from veritally.streaming import streams as sr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY_DET = ["mode", "category", "bucket", "ident", "detector"]
ORDER = ["written_at", "ln", "s"]
#: Templates of the stand-in requests; the jobs take any.
TEMPLATES = {
    "head": "Look at this photo.", "tail": "Answer in JSON.", "packed_head": "Look at these {n} photos.", "packed_tail": "Answer in JSON for all {n}.",
    "step": "That was photo {i} of {n}.", "step_head": "Those were all {n} photos.", "step_tail": "Answer in JSON.",
    "first": "Photo {i} of {n}.", "middle": "Now photo {i} of {n}.", "final": "The last of {n}. Answer in JSON.", "running": "Say what you think so far.", "single": "Look at this photo. Answer in JSON.",
}
ONE, MANY = '\n\nThe buyer wrote: "{c}"\n\n', "\n\nThe buyer wrote:\n{lines}\n\n"
VARIANTS = [("v0", "Judge photos.", "Is it real? Return ONLY JSON."), ("v1", None, "Is it made by a machine?"), ("v2", "Be brief.", "Real or not? Return ONLY JSON.")]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def dim(spark: SparkSession, name: str, values: list) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, pos int")


def facts(spark: SparkSession, d: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    f = view(spark, d, "fx_facts", tables)
    bucket = F.when(F.col("label") == "Negative", "Negative").otherwise(F.concat(F.lit("DeepFake/"), F.col("generator")))
    return f.withColumn("bucket", bucket).withColumn("ident", F.col("review_id"))


def latest(spark: SparkSession, d: str) -> DataFrame:
    return st.latest_records(facts(spark, d), KEY_DET, ORDER)


def jobs(f: DataFrame) -> DataFrame:
    return f.groupBy("mode", "category", "bucket", "ident").agg(F.max("label").alias("label"), F.max("generator").alias("generator"), F.max("num_images").alias("num_images"))


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    """To nine places: sums differ in their last bits by the order of rows, and few means end there."""
    return df.withColumns({c: F.round(c, 9) for c in names})


def images(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "fx_paths")
    parts = F.split("path", "/")
    label = parts[1]
    return ct.image_catalog(p.select("path", F.lit(0).alias("input_pos"), parts[0].alias("category"), label.alias("label"), F.array_join(F.slice(parts, 3, 1000), "/").alias("rel")))


# sources and sinks


def platforms(spark):
    return spark.createDataFrame(PLATFORMS, "category string, platform string")


@query
def load_results(spark, d):
    """Roll-ups written, and read again by platform and mode: all of the small platforms' first modes, one mode of the large one."""
    path = fl.scratch(spark, "summaries")
    fl.write_summaries(st.to_documents(latest(spark, d), ["mode", "category"]), path)
    rows = fl.read_summaries(spark, path).where("status is not null")
    kept = ct.with_platform(rows, platforms(spark), ["hotel", "grabfood"]).where(F.col("mode").isin(MODES[:4])).unionByName(ct.with_platform(rows, platforms(spark), ["amazon"]).where(F.col("mode").isin(MODES[:1])))
    return kept.select("platform", "mode", "category", "bucket", "ident", "detector", "status", "is_ai_modified", F.round("confidence", 6).alias("confidence"), "error")


@query
def read_bundles(spark, d):
    path = fl.scratch(spark, "bundles")
    st.to_bundles(latest(spark, d), ["mode", "category", "detector", "bucket"]).drop("shard").write.partitionBy("mode", "category").json(path)
    return fl.read_bundles(spark, path).select("mode", "category", "detector", "bucket", "ident", "num_images", "is_ai_modified", F.round("confidence", 6).alias("confidence"), "error")


def classic(spark, d):
    c = view(spark, d, "fx_classic")
    item = F.map_from_arrays(F.array(F.lit("no"), F.lit("pred"), F.lit("score")), F.array(F.col("item_no").cast("string"), "prediction", "score"))
    return c.select("detector", "category", "folder", "generator", F.map_filter(item, lambda k, v: v.isNotNull()).alias("item"))


def classic_config(spark):
    return spark.createDataFrame([(c, "pred", ["fake"], "score") for c in CLASSIC], "detector string, pred_field string, fake_values array<string>, score_field string")


@query
def classic_scores(spark, d):
    parts = ["detector", "category", "folder", "generator"]
    docs = st.to_item_arrays(classic(spark, d), parts)
    path = fl.scratch(spark, "classic")
    docs.select(F.coalesce("generator", F.lit("none")).alias("generator"), "detector", "category", "folder", "value").write.partitionBy(*parts).text(path)
    rows = fl.read_classic(spark, path).withColumn("generator", F.nullif("generator", F.lit("none")))
    return mt.classic_counts(rows, classic_config(spark)).select("category", "detector", "bucket", "correct", "total", F.round("conf_sum", 4).alias("conf_sum"), "conf_n")


@query
def image_catalog(spark, d):
    return images(spark, d).select("path", "category", "label", "bucket", "generator", "rel")


@query
def listed_images(spark, d):
    """From files to catalogue to platforms: one image and one note of every folder are written, the listing finds them again."""
    path, p = fl.scratch(spark, "images"), images(spark, d).where("bucket is not null")
    folders = p.groupBy("category", "label", F.coalesce("generator", F.lit("none")).alias("generator")).agg(F.count("*").alias("n"))
    by = ["category", "label", "generator"]
    for extension in ("jpg", "txt"):
        folders.repartition(*by).write.mode("append").option("extension", extension).partitionBy(*by).csv(path)
    found = ct.image_catalog(ct.listed(fl.list_images(spark, path)))
    found = ct.with_platform(found.withColumn("generator", F.nullif("generator", F.lit("none"))), platforms(spark))
    bucket = F.when(F.col("generator").isNull(), F.col("label")).otherwise(F.col("bucket"))
    return found.groupBy("platform", "category", bucket.alias("bucket"), "generator").agg(F.count("*").alias("files"))


@query
def review_texts(spark, d):
    """Metadata of the three shapes, by number, written and read again."""
    path, pick = fl.scratch(spark, "reviews"), F.col("num") % 3
    shapes = [F.when(pick == i, F.col("body")).alias(c) for i, c in enumerate(("text", "content", "review_text"))]
    view(spark, d, "fx_reviews").select(F.coalesce("category", F.lit("none")).alias("category"), F.col("num").cast("string").alias("number"), "title", *shapes).write.partitionBy("category").json(path)
    read = fl.read_review_meta(spark, path)
    return read.select(F.nullif("category", F.lit("none")).alias("category"), F.concat(F.lit("Review_"), F.col("number")).alias("review_id"), tx.review_text("title", "body").alias("review_text"))


@query
def export_wide(spark, d):
    path = fl.scratch(spark, "wide")
    fl.write_table(fl.export_wide(latest(spark, d), ["mode", "category", "bucket", "ident"], DETECTORS), path, "csv")
    names = [f"{x}_{c}" for x in DETECTORS for c in ("status", "verdict", "confidence")]
    kinds = "mode string, category string, bucket string, ident string, " + ", ".join(f"{n} {'string' if n.endswith('status') else 'boolean' if n.endswith('verdict') else 'double'}" for n in names)
    return rounded(spark.read.schema(kinds).option("header", True).csv(path), [n for n in names if n.endswith("confidence")])


# scalar functions


@query
def bucket_parse(spark, d):
    parts = F.split("path", "/")
    p = view(spark, d, "fx_paths").select("path", tx.bucket_of(parts[1], F.array_join(F.slice(parts, 3, 1000), "/")).alias("b"))
    return p.select("path", "b.bucket", "b.generator", "b.rel")


@query
def review_id(spark, d):
    parts = F.split("path", "/")
    rel = F.array_join(F.slice(parts, 3, 1000), "/")
    p = view(spark, d, "fx_paths").withColumn("rel", rel)
    given = F.when(F.length("path") % 3 == 0, F.lit("")).when(F.length("path") % 3 == 1, F.lit("given"))
    return p.select("path", tx.review_id_of(given, F.when(F.length("path") % 2 == 0, F.col("rel")), F.array("rel")).alias("review_id"))


@query
def record_identity(spark, d):
    f = facts(spark, d).select("k", "ln", "s", "bucket", F.when(F.col("k") % 3 == 0, "").otherwise(F.col("review_id")).alias("r"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("img"), F.col("k").cast("string"))).alias("i"))
    ident = tx.identity("r", "i", F.concat(F.lit("key"), F.col("k").cast("string")), F.lit(None).cast("string"))
    return f.select("k", "ln", "s", ident.alias("ident"), tx.row_key("bucket", ident).alias("row_key"))


@query
def platform_counts(spark, d):
    return ct.shape_report(ct.with_platform(facts(spark, d).drop("platform"), platforms(spark)), "platform", ["mode", "label"])


@query
def image_ids(spark, d):
    return view(spark, d, "fx_paths").select("path", tx.image_id("path").alias("image_id"))


@query
def safe_names(spark, d):
    name = F.concat(F.lit("  "), F.col("text"), F.lit(" "))
    return view(spark, d, "fx_turns").select("conv_id", "turn", tx.safe_name(F.when(F.col("turn") % 5 == 4, F.lit(" ")).otherwise(name)).alias("name"))


def with_comments(spark, d):
    c = view(spark, d, "fx_edit_comments")
    return c.groupBy("category", "num").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "reviewer_comment"))), lambda x: x["reviewer_comment"]).alias("comments"))


@query
def comment_block(spark, d):
    return with_comments(spark, d).select("num", rq.comment_block("comments", ONE, MANY).alias("block"))


@query
def request_text(spark, d):
    j = with_comments(spark, d).withColumn("n", F.size("comments")).withColumn("mode", F.when(F.col("num") % 2 == 0, "MultiImage-withReview").otherwise("MultiStep-withReview"))
    first = F.coalesce(rq.one_comment(tx.filled(F.get("comments", 0)), ONE), F.lit("\n\n"))
    j = j.withColumn("block", rq.comment_block("comments", ONE, MANY)).withColumn("first_block", first)
    text = rq.request_text("mode", "n", "block", "first_block", TEMPLATES)
    return j.select("num", F.length(text).alias("chars"), F.md5(text).alias("text_md5"))


@query
def variant_requests(spark, d):
    v = spark.createDataFrame(VARIANTS, "variant string, system string, user string")
    j = images(spark, d).where("generator is null").select("path")
    return tk.task_grid(j, v).select("path", "variant", "system", "user")


@query
def mismatch_requests(spark, d):
    v = spark.createDataFrame(VARIANTS, "variant string, system string, user string")
    r = view(spark, d, "fx_reviews").select("num", tx.review_text("title", "body").alias("t"))
    text = rq.inserted(F.col("user"), rq.one_comment("t", ONE), " Return ONLY")
    return tk.task_grid(r, v).select("num", "variant", F.length(text).alias("chars"), F.md5(text).alias("text_md5"))


@query
def turn_prompts(spark, d):
    t = view(spark, d, "fx_turns")
    n = t.groupBy("conv_id").agg(F.count("*").alias("n"))
    text = rq.turn_prompt(F.col("turn") + 1, "n", TEMPLATES, running=True)
    return t.join(n, "conv_id").select("conv_id", "turn", text.alias("prompt"))


# replies


def parsed(spark, d):
    return view(spark, d, "fx_replies").select("doc_id", vd.parse_reply("raw_response").alias("v"))


@query
def parse_replies(spark, d):
    return parsed(spark, d).select("doc_id", F.col("v").isNotNull().alias("parsed"), vd.is_object("v").alias("is_object"))


@query
def normalize_verdicts(spark, d):
    c = vd.verdict_columns("v")
    return parsed(spark, d).select("doc_id", c[0], F.round(c[1], 6).alias("confidence"), c[3])


@query
def normalize_reasons(spark, d):
    return parsed(spark, d).select("doc_id", vd.verdict_columns("v")[2])


@query
def per_image_findings(spark, d):
    x = parsed(spark, d).select("doc_id", F.posexplode(vd.findings("v")).alias("pos", "x"))
    return x.select("doc_id", "pos", F.try_variant_get("x", "$.index", "long").alias("image_index"), F.try_variant_get("x", "$.is_ai_modified", "boolean").alias("is_ai_modified"), F.round(F.try_variant_get("x", "$.confidence", "double"), 6).alias("confidence"), F.try_variant_get("x", "$.notes", "string").alias("notes"))


@query
def verdict_flags(spark, d):
    return facts(spark, d).select("k", "ln", "s", *vd.flags("status", "error"))


@query
def error_classes(spark, d):
    return facts(spark, d).where("error is not null").groupBy("detector", tx.error_class("error").alias("error_class")).agg(F.count("*").alias("n"))


# filters


@query
def generator_filter(spark, d):
    kept = ct.keep_generators(jobs(facts(spark, d)), GENERATORS[:2])
    return kept.groupBy("mode", "generator").agg(F.count("*").alias("jobs"))


@query
def unknown_generators(spark, d):
    wanted = spark.createDataFrame([(g,) for g in [*GENERATORS, "gen77", "gen88"]], "generator string")
    return ct.unknown_generators(jobs(facts(spark, d)), wanted)


@query
def unknown_names(spark, d):
    """A selection with one misspelt name of each kind."""
    rosters = {"detector": [*DETECTORS, "det77"], "category": [*[c for c, _ in PLATFORMS], "cat77"], "generator": [*GENERATORS, "gen77"], "mode": [*MODES, "MultiVideo-NoReview"]}
    wanted = spark.createDataFrame([(k, n) for k, v in rosters.items() for n in v], "kind string, name string")
    return ct.unknown_names(facts(spark, d), wanted)


@query
def multi_image_only(spark, d):
    return mt.multi_image_only(jobs(facts(spark, d))).groupBy("mode", "num_images").agg(F.count("*").alias("jobs"))


@query
def flat_images(spark, d):
    return ct.flat_images(images(spark, d)).groupBy("category", "bucket").agg(F.count("*").alias("flat"))


def labelled(spark, d):
    return ct.human_catalog(view(spark, d, "fx_paths"), GENERATORS[:4])


@query
def human_catalog(spark, d):
    return labelled(spark, d)


# metrics


@query
def confusion_counts(spark, d):
    return rounded(mt.confusion_counts(facts(spark, d), GENERATORS), ["conf_sum"])


@query
def conf_on_correct(spark, d):
    c = mt.confusion_counts(facts(spark, d), GENERATORS)
    return c.select("mode", "category", "detector", "bucket", F.round(F.try_divide("conf_sum", "conf_n"), 9).alias("mean_conf"))


def _metrics(spark, d, policy="ran", several=True):
    return mt.category_metrics(mt.confusion_counts(facts(spark, d), GENERATORS, policy, several), GENERATORS)


@query
def category_metrics(spark, d):
    return rounded(_metrics(spark, d), mt.metric_names(GENERATORS))


@query
def metric_tables(spark, d):
    """Metric tables by mode: first over some categories alone, then all modes but one replaced by those over all, and that one last."""
    rows, path = rounded(_metrics(spark, d), mt.metric_names(GENERATORS)), fl.scratch(spark, "metrics")
    fl.write_metric_tables(rows.where("category < 'cat10'"), path)
    fl.write_metric_tables(rows.where(F.col("mode") != MODES[0]), path)
    fl.write_metric_tables(rows.where(F.col("mode") == MODES[0]), path)
    return fl.read_metric_tables(spark, path, rows.schema).select(*rows.columns)


@query
def macro_metrics(spark, d):
    out = mt.macro_metrics(_metrics(spark, d), GENERATORS, dim(spark, "detector", [*DETECTORS, "unheard"]))
    return rounded(out, mt.metric_names(GENERATORS)).orderBy("mode", "pos")


@query
def ablation_metrics(spark, d):
    """A run of the ablation is a prompt variant of a mode: the variant stands in the mode's place."""
    f = facts(spark, d).withColumn("mode", F.concat("mode", F.lit("/v"), (F.col("k") % 5).cast("string")))
    rows = mt.category_metrics(mt.confusion_counts(f, GENERATORS, "ok_only", False), GENERATORS)
    return rounded(mt.macro_metrics(rows, GENERATORS), mt.metric_names(GENERATORS))


@query
def classic_metrics(spark, d):
    rows = mt.category_metrics(mt.classic_counts(classic(spark, d), classic_config(spark)), GENERATORS)
    return rounded(mt.macro_metrics(rows, GENERATORS), mt.metric_names(GENERATORS))


@query
def combined_table(spark, d):
    single = facts(spark, d).where("mode = 'SingleImage-NoReview'")
    llm = mt.macro_metrics(mt.category_metrics(mt.confusion_counts(single, GENERATORS), GENERATORS), GENERATORS)
    other = mt.macro_metrics(mt.category_metrics(mt.classic_counts(classic(spark, d), classic_config(spark)), GENERATORS), GENERATORS)
    return rounded(llm.unionByName(other), mt.metric_names(GENERATORS))


@query
def format_cells(spark, d):
    return _metrics(spark, d).select("mode", "category", "detector", *[tx.metric_cell(tx.rounded_double(c, 6)).alias(c) for c in mt.metric_names(GENERATORS)])


# store


@query
def latest_records(spark, d):
    return latest(spark, d).select(*KEY_DET, "status", "is_ai_modified", F.round("confidence", 6).alias("confidence"), "error")


@query
def rebuild_summary(spark, d):
    f = latest(spark, d)
    return st.rebuild_summary(jobs(f), dim(spark, "detector", DETECTORS), f).select(*KEY_DET, "num_images", "status", "is_ai_modified", F.round("confidence", 6).alias("confidence"), "error")


@query
def merge_summary(spark, d):
    f = facts(spark, d)
    old = st.latest_records(f.where("written_at < date '1995-06-17'"), KEY_DET, ORDER)
    new = st.latest_records(f.where("written_at >= date '1995-06-17'"), KEY_DET, ORDER).withColumn("num_images", F.col("num_images") + 1)
    old = st.same_shape(old, "review", "review")
    return st.merge_summary(old, new).select(*KEY_DET, "status", "is_ai_modified", F.round("confidence", 6).alias("confidence"), "error", "num_images")


@query
def summary_header(spark, d):
    rows = latest(spark, d).withColumn("num_images", F.nullif("num_images", F.lit(3))).withColumn("is_review", F.col("mode").startswith("Multi"))
    return st.summary_header(rows, ["mode", "category"])


# tasks


@query
def task_grid(spark, d):
    return tk.task_grid(jobs(facts(spark, d)), dim(spark, "detector", DETECTORS), dim(spark, "variant", ["v0", "v1"]).drop("pos")).groupBy("mode", "detector", "variant").agg(F.count("*").alias("tasks"))


@query
def pending_tasks(spark, d):
    f = latest(spark, d)
    grid = tk.task_grid(jobs(f), dim(spark, "detector", DETECTORS))
    return tk.pending_tasks(grid, tk.done_tasks(f, KEY_DET), KEY_DET).select(*KEY_DET)


@query
def run_plan(spark, d):
    f = facts(spark, d)
    j = jobs(f).withColumn("num_images", F.coalesce("num_images", F.lit(0)))
    done = tk.done_tasks(st.latest_records(f, KEY_DET, ORDER, ["error"]), KEY_DET)
    return tk.run_plan(j, dim(spark, "detector", DETECTORS), done, KEY_DET, KEY_DET[:4], ["mode"], per_image=True)


@query
def run_progress(spark, d):
    return rounded(tk.run_progress(facts(spark, d), ["detector"]), ["accuracy"])


@query
def ablation_completion(spark, d):
    want = tk.task_grid(dim(spark, "detector", DETECTORS).drop("pos"), dim(spark, "category", [f"cat{i:02d}" for i in range(29)]).drop("pos"))
    done = facts(spark, d).where("status = 'ok' and mode = 'MultiTurn-withReview'")
    return tk.completion(want, done, ["detector", "category"], ["detector"])


@query
def model_drift(spark, d):
    served = facts(spark, d).withColumn("api_model", F.concat("detector", F.lit("-"), F.year("written_at").cast("string")))
    roster = dim(spark, "detector", DETECTORS).withColumn("model_id", F.concat("detector", F.lit("-1995")))
    return tk.model_drift(served, roster)


@query
def missing_modes(spark, d):
    return tk.missing_values(dim(spark, "mode", [*MODES, "MultiVideo-NoReview"]), facts(spark, d), "mode")


# catalogue


@query
def review_jobs(spark, d):
    j = ct.review_jobs(images(spark, d))
    return j.select("category", "bucket", "review_id", "num_images", F.md5(F.array_join("images.path", "|")).alias("images_md5"))


@query
def first_jobs(spark, d):
    j = ct.review_jobs(images(spark, d)).select("category", "bucket", "review_id", "num_images")
    return j.orderBy("bucket", "review_id", "category").limit(50)


def commented(spark, d):
    e = view(spark, d, "fx_edit_comments").select("category", F.col("num").cast("string").alias("number"), "image", "pos", "reviewer_comment")
    r = view(spark, d, "fx_reviews").select("category", F.col("num").cast("string").alias("number"), "title", "body")
    docs = view(spark, d, "fx_edit_comments").select("category", "num", "image", "pos")
    label = F.when(F.col("num") % 4 == 0, "Negative").when(F.col("num") % 4 == 3, None).otherwise("DeepFake")
    i = docs.select("category", F.when(F.col("num") % 10 != 9, F.col("num").cast("string")).alias("number"), "image", "pos", "num", label.alias("label"))
    return ct.attach_comments(i, r, e.unionByName(e.where("pos = 1").withColumn("pos", F.lit(9)).withColumn("reviewer_comment", F.lit("second thoughts"))))


@query
def attach_comments(spark, d):
    return commented(spark, d).select("category", "num", "image", "label", "comment")


@query
def review_numbers(spark, d):
    i = images(spark, d).select("path", F.split_part("rel", F.lit("/"), F.lit(1)).alias("review_id"), F.get(F.split("rel", "/"), F.size(F.split("rel", "/")) - 2).alias("folder"))
    return i.select("path", ct.review_number("review_id").alias("by_review"), ct.review_number("review_id", "folder").alias("by_folder"))


@query
def edit_comments(spark, d):
    c = view(spark, d, "fx_edit_comments").where(tx.filled("category").isNotNull())
    path = fl.scratch(spark, "edits")
    per_image = F.transform(F.array_sort(F.collect_list(F.struct("pos", "image", "reviewer_comment"))), lambda x: F.struct(x["image"].alias("image"), x["reviewer_comment"].alias("reviewer_comment")))
    c.groupBy("category", F.col("num").cast("string").alias("number")).agg(per_image.alias("per_image")).write.partitionBy("category").json(path)
    return fl.read_edit_meta(spark, path).select(F.col("number").cast("long").alias("num"), "pos", "image", "reviewer_comment")


@query
def comment_coverage(spark, d):
    return ct.comment_coverage(commented(spark, d), "comment", ["label"])


@query
def uncommented_head(spark, d):
    return commented(spark, d).where(tx.filled("comment").isNull()).select("category", "num", "image").orderBy("category", "num", "image").limit(10)


# ablations


def sampled(spark, d):
    return sm.stratified_sample(ct.keep_generators(images(spark, d), GENERATORS[:5]).select("path", "category", "bucket", "generator"), ["category", "bucket"], "path", 0.1, 42)


@query
def stratified_sample(spark, d):
    path = fl.scratch(spark, "sample")
    fl.write_table(sampled(spark, d), path, partition_by=["category"])
    return spark.read.schema("path string, bucket string, generator string, category string").parquet(path).select("category", "bucket", "path")


@query
def index_report(spark, d):
    return sm.index_report(ct.keep_generators(images(spark, d), GENERATORS[:5]), sampled(spark, d), "category")


def paired(spark, d):
    """The mismatch index, written and read again."""
    r = view(spark, d, "fx_reviews").withColumn("review_text", tx.review_text("title", "body")).where("review_text is not null")
    s = view(spark, d, "fx_reviews").select("category", F.col("review_id").alias("image"))
    path = fl.scratch(spark, "mismatch")
    fl.write_table(sm.mismatch_pairs(s, r.select("category", "review_id"), "category", "image", "review_id", 42), path, partition_by=["category"])
    return spark.read.schema("image string, review_source_category string, review_source_review_id string, category string").parquet(path)


@query
def mismatch_report(spark, d):
    return sm.mismatch_report(paired(spark, d), "category")


@query
def mismatch_pairs(spark, d):
    return paired(spark, d).select("category", "image", "review_source_category", "review_source_review_id")


@query
def mismatch_delta(spark, d):
    f = latest(spark, d)
    side = lambda mode: f.where(f"mode = '{mode}'").select("category", "detector", "num_images", F.regexp_replace("ident", ".*_", "").cast("long").alias("no"), "bucket", "is_ai_modified")
    a, b = side("SingleImage-NoReview"), side("SingleImage-withReview").withColumn("no", F.col("no") - 203)
    one = lambda x: x.groupBy("category", "detector", "no").agg(F.bool_or("is_ai_modified").alias("is_ai_modified"))
    return rounded(sm.mismatch_delta(one(a), one(b), ["category", "detector", "no"], ["detector"]), ["delta"])


@query
def index_missing(spark, d):
    i = images(spark, d).select("category", "path")
    gone = F.length("path") % 5 == 0
    return sm.index_missing(sampled(spark, d).select("category", "path"), i.where(~gone), ["category", "path"])


# turns


@query
def first_comment_turns(spark, d):
    return tu.first_comment_turns(view(spark, d, "fx_turn_verdicts")).select("conv_id", "turn", "comment")


@query
def turn_history(spark, d):
    return tu.turn_history(view(spark, d, "fx_turns"))


@query
def verdict_trajectory(spark, d):
    return tu.verdict_trajectory(view(spark, d, "fx_turn_verdicts"))


@query
def conversation_totals(spark, d):
    return tu.conversation_totals(view(spark, d, "fx_turn_verdicts"))


# human labels


def log(spark, d, tables=None):
    return view(spark, d, "fx_human_log", tables)


def truth(x: str):
    return F.when(F.col(x) % 7 == 0, "real").otherwise("fake")


LOG = ["evaluator", "scope"]


def judged(spark, d):
    """Standing submits with the truth about their images."""
    made = F.col("image_no") % 7
    return hm.human_standing(log(spark, d), LOG).withColumn("true_label", truth("image_no")).withColumn("bucket", F.when(made == 0, "Negative").otherwise("DeepFake")).withColumn("gen_model", F.when(made > 0, F.concat(F.lit("gen"), made.cast("string"))))


@query
def human_accuracy(spark, d):
    return rounded(hm.human_accuracy(judged(spark, d), LOG), ["accuracy"])


@query
def human_catalog_stats(spark, d):
    return ct.human_catalog_stats(labelled(spark, d))


@query
def human_progress(spark, d):
    return hm.human_progress(view(spark, d, "fx_human_images"), judged(spark, d).drop("true_label"), log(spark, d))


@query
def unseen_pools(spark, d):
    return hm.unseen_pools(view(spark, d, "fx_human_images"), judged(spark, d).drop("true_label"), log(spark, d))


def queue(spark, d):
    cat = labelled(spark, d).select("image_id", "category", "review_id", "true_label")
    who = spark.createDataFrame([("ann",), ("bob",)], "evaluator string")
    return hm.labelling_queue(cat, who, 7, 500)


@query
def labelling_queue(spark, d):
    return queue(spark, d).select("evaluator", "pos", "image_id", "true_label")


@query
def recency_repeats(spark, d):
    return hm.recency_repeats(queue(spark, d), ["category"], 30).select("evaluator", "pos", "category", "gap")


@query
def human_standing(spark, d):
    return hm.human_standing(log(spark, d), LOG)


# streams


def stream(spark, d, table):
    schema = spark.read.parquet(f"{d}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{table}.parque[t]")


def arriving(spark, d):
    return facts(spark, d, {"lineitem": stream(spark, d, "lineitem")}).select(*KEY_DET, *ORDER, "status", "is_ai_modified", "confidence", "error")


@query
def stream_upsert(spark, d):
    out = sr.stream_upsert(arriving(spark, d), KEY_DET, ORDER, fl.scratch(spark, "upsert"), groups=["mode", "category"])
    return out.select(*KEY_DET, "status", "is_ai_modified", F.round("confidence", 6).alias("confidence"), "error")


@query
def stream_rollup(spark, d):
    """What stands in every roll-up while results stream: the roll-ups' parts of touched buckets are made anew."""
    return sr.stream_rollup(arriving(spark, d), KEY_DET, ORDER, ["mode", "category", "detector"], fl.scratch(spark, "rollup"))


@query
def stream_progress(spark, d):
    return rounded(sr.stream_progress(facts(spark, d, {"lineitem": stream(spark, d, "lineitem")}), ["detector"], fl.scratch(spark, "progress")), ["accuracy"])


@query
def stream_human(spark, d):
    return sr.stream_human(log(spark, d, {"events": stream(spark, d, "events")}), fl.scratch(spark, "human"), by=LOG)
