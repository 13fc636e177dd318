"""Image listings, review jobs, comments, and the labelling catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions.text import bucket_of, filled, image_id, review_text

IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "gif"]
LABEL_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]


def _extension(path: str):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def image_catalog(paths: DataFrame, extensions: list[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Images of a listing (path, input_pos, category, label, rel), each path once, by its first input."""
    images = paths.where(_extension("path").isin(extensions))
    one = images.groupBy("path").agg(F.min_by(F.struct("category", "label", "rel", "input_pos"), "input_pos").alias("x"))
    return one.select("path", "x.category", "x.label", bucket_of("x.label", "x.rel").alias("b")).select("path", "category", "label", "b.bucket", "b.generator", "b.rel")


def review_jobs(images: DataFrame) -> DataFrame:
    """Images in folders become one job for each (category, bucket, first folder), sorted by path."""
    deep = images.where(F.size(F.split("rel", "/")) > 1).withColumn("review_id", F.split_part("rel", F.lit("/"), F.lit(1)))
    jobs = deep.groupBy("category", "bucket", "review_id").agg(F.max("label").alias("label"), F.max("generator").alias("generator"), F.sort_array(F.collect_list(F.struct("path", "rel"))).alias("images"))
    return jobs.withColumn("num_images", F.size("images"))


def flat_images(images: DataFrame) -> DataFrame:
    """Images outside any folder, which review jobs leave out."""
    return images.where(F.size(F.split("rel", "/")) < 2)


def keep_generators(jobs: DataFrame, wanted: list[str]) -> DataFrame:
    """Jobs of these generators, and all without a generator."""
    return jobs.where(F.col("generator").isNull() | F.col("generator").isin(wanted))


def unknown_generators(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("generator").join(jobs.select("generator").where("generator is not null").distinct(), "generator", "left_anti")


def unknown_names(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, name) of wanted that no row has: detectors, generators, categories and the like, all kinds in one pass.

    A kind is a column of rows. A selection is checked with this before it runs, so that a
    misspelt name doesn't run nothing.
    """
    kinds = [r.kind for r in wanted.select("kind").distinct().collect()]  # columns
    met = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("name")) for k in kinds])).alias("x")).select("x.*").distinct()
    return wanted.select("kind", "name").join(met, ["kind", "name"], "left_anti")


def with_platform(rows: DataFrame, platforms: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """rows of the categories that a platform has, with it; platforms (category, platform) is a small dimension. Of ``wanted`` platforms only."""
    if wanted is not None:
        platforms = platforms.where(F.col("platform").isin(wanted))
    return rows.join(F.broadcast(platforms.select("category", "platform")), "category")


def shape_report(rows: DataFrame, group: str, kinds: list[str]) -> DataFrame:
    """kind, group, name, n: rows by group and each of ``kinds``, in one pass by grouping sets."""
    sets = rows.groupingSets([[group, k] for k in kinds], group, *kinds).agg(F.count("*").alias("n"), *[F.grouping(k).alias(f"_{k}") for k in kinds])
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in kinds:
        kind, name = F.when(F.col(f"_{k}") == 0, k).otherwise(kind), F.when(F.col(f"_{k}") == 0, F.col(k)).otherwise(name)
    return sets.select(kind.alias("kind"), group, name.alias("name"), "n")


def listed(files: DataFrame) -> DataFrame:
    """A listing (path, ...) of a tree category=.../label=.../[generator=...]/... in the shape that ``image_catalog`` takes."""
    parts = F.split(F.col("path"), "/")
    value = lambda name: F.nullif(F.regexp_extract("path", f"/{name}=([^/]*)/", 1), F.lit(""))
    rel = F.array_join(F.transform(F.filter(F.slice(parts, F.size(parts) - 2, 3), lambda x: ~x.startswith("category=") & ~x.startswith("label=")), lambda x: F.regexp_replace(x, "^generator=", "")), "/")
    return files.select("path", F.lit(0).alias("input_pos"), value("category").alias("category"), value("label").alias("label"), rel.alias("rel"))


def review_number(review_id: str, folder: str | None = None):
    """What follows the last underscore of the review id; of a folder only if it is Review_<digits>."""
    if folder is not None:
        return filled(F.regexp_extract(folder, r"^Review_(\d+)$", 1))
    return filled(F.regexp_extract(review_id, r"_([^_]*)$", 1))


def attach_comments(images: DataFrame, reviews: DataFrame, edits: DataFrame) -> DataFrame:
    """images (category, label, number, image, ...) with ``comment``.

    Originals take their review's text (category, number, title, bodies); fakes the comment of
    the edit of (category, number, image file), shared by all generators, the last of repeated
    ones. A row without a number meets nothing: it isn't sent through either join.
    """
    texts = reviews.where("number is not null").groupBy("category", "number").agg(F.max(review_text("title", "body")).alias("review_comment"))
    notes = edits.where(filled("reviewer_comment").isNotNull() & filled("image").isNotNull()).groupBy("category", "number", "image").agg(F.max_by("reviewer_comment", "pos").alias("edit_comment"))
    original, fake = F.col("label") == "Negative", F.col("label") == "DeepFake"
    known = F.col("number").isNotNull()
    some = lambda cond: images.where(cond & known)
    a = some(original).join(texts, ["category", "number"], "left").withColumnRenamed("review_comment", "comment")
    b = some(fake).join(notes, ["category", "number", "image"], "left").withColumnRenamed("edit_comment", "comment")
    rest = images.where(~(known & F.coalesce(original | fake, F.lit(False)))).withColumn("comment", F.lit(None).cast("string"))
    names = [*images.columns, "comment"]
    return a.select(*names).unionByName(b.select(*names)).unionByName(rest.select(*names))


def comment_coverage(jobs: DataFrame, comment: str, by: list[str]) -> DataFrame:
    has = filled(comment).isNotNull()
    return jobs.groupBy(*by).agg(F.count_if(has).alias("with_comment"), F.count_if(~has).alias("without_comment"))


def human_catalog(paths: DataFrame, generators: list[str]) -> DataFrame:
    """Images for labelling: <category>/Negative/... or <category>/DeepFake/<known generator>/...,
    in a folder Review_*, with one of four extensions and no leading dot."""
    p = F.split("path", "/")
    name, folder = F.element_at(p, -1), F.get(p, F.size(p) - 2)
    fake = p[1] == "DeepFake"
    rows = paths.where(_extension("path").isin(LABEL_EXTENSIONS) & (F.size(p) >= 4) & ~name.startswith(".") & folder.startswith("Review_"))
    rows = rows.where((p[1] == "Negative") | (fake & p[2].isin(generators) & (F.size(p) >= 5)))
    entry = [image_id("path").alias("image_id"), F.col("path").alias("rel_path"), p[0].alias("category"), p[1].alias("bucket"), F.when(fake, p[2]).alias("gen_model"), folder.alias("review_id"), name.alias("filename"), F.when(fake, "fake").otherwise("real").alias("true_label")]
    return rows.select(*entry)


def human_catalog_stats(catalog: DataFrame) -> DataFrame:
    """kind, name, n: total, real, fake, each generator, and the number of categories."""
    by = catalog.groupBy("bucket", "gen_model").agg(F.count("*").alias("n"))
    kinds = F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")), F.struct(F.when(F.col("bucket") == "Negative", "real").otherwise("fake").alias("kind"), F.lit("").alias("name")), F.struct(F.when(F.col("gen_model").isNotNull(), "generator").alias("kind"), F.coalesce("gen_model", F.lit("")).alias("name"))))
    counts = by.select(kinds.alias("k"), "n").select("k.kind", "k.name", "n").where("kind is not null").groupBy("kind", "name").agg(F.sum("n").alias("n"))
    return counts.unionByName(catalog.agg(F.count_distinct("category").alias("n")).select(F.lit("categories").alias("kind"), F.lit("").alias("name"), "n"))
