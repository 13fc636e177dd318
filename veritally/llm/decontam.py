"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions.

A test item is a set of distinct word shingles; a document contains it where at least ``share``
of them occur in the document. Items are partitioned by size (powers of two), and each is
sketched by its k least shingle hashes, k following from the greatest size u of its partition:
k = u - ceil(share * u) + 1. Any document that holds ``share`` of an item lacks at most k - 1 of
its shingles, so it has one of the k least: the search loses nothing. Documents post only
hashes up to the greatest hash in any sketch. Long items alone keep that low; with short ones it
nears the top, and most shingles are posted. So sketches that are too large to be broadcast meet
posts behind a Bloom filter of their hashes, and what no sketch holds isn't shuffled. Candidates
are confirmed on the exact shingle sets of the whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.tables import bloom_filters, drop, marked, materialise, only_ids

SHINGLE, SHARE = 5, 0.8


def shingles(text: Column | str, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words (letters and digits, lower case), with repeats; fewer words, none."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) < size, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))))[0]


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, size: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every pair at or above ``share``.

    docs (doc_id, text, ...), items (item_id, text, ...). Words are runs of letters and digits,
    lower-cased. A text that is null, empty or shorter than ``size`` words has no shingle: such
    an item is found in no document (so few words say too little), such a document holds none.
    Rows without an id are left out. Repeated rows count once. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    own = items.where("item_id is not null").select("item_id", F.array_distinct(shingles(F.col("text").cast("string"), size)).alias("own")).where(F.size("own") > 0)
    own = own.select("item_id", "own", F.size("own").alias("n_item"))
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_item")))).cast("int")
    own = own.withColumn("k", F.greatest(upper - F.ceil(upper * F.lit(share) - 1e-9) + 1, F.lit(1)).cast("int"))
    own = materialise(own.withColumn("need", F.ceil(F.col("n_item") * F.lit(share) - 1e-9).cast("int")).dropDuplicates(["item_id"]), "items")
    sketch = marked(own.select("item_id", "n_item", F.explode(F.slice(F.array_sort("own"), 1, F.col("k"))).alias("h")), "sketch")
    top = sketch.agg(F.max("h").alias("h")).first()
    if top.h is None:
        item_id = F.lit(None).cast(own.schema["item_id"].dataType).alias("item_id")
        return docs.limit(0).select("doc_id", item_id, *[F.lit(0).cast(kind).alias(c) for c, kind in (("n_item", "int"), ("n_shared", "int"), ("containment", "double"))])
    posts = docs.select("doc_id", F.explode(F.filter(shingles("text", size), lambda h: h <= F.lit(top.h))).alias("h"))
    with bloom_filters(spark):
        pairs = materialise(posts.join(sketch, "h").select("doc_id", "item_id").distinct(), "pairs")
    texts = only_ids(docs, pairs.select("doc_id").distinct(), ["doc_id", "text"], "texts")
    sets = texts.select("doc_id", shingles("text", size).alias("all_of"))
    out = pairs.join(sets, "doc_id").join(own.select("item_id", "own", "n_item", "need"), "item_id")
    out = out.select("doc_id", "item_id", "n_item", "need", F.size(F.array_intersect("own", "all_of")).alias("n_shared")).where("n_shared >= need")
    out = out.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    found = materialise(out.withColumn("containment", F.col("n_shared") / F.col("n_item")), "found")
    drop(own, sketch, pairs, texts)
    return found


#: The same pairs by brute force over all shingles, for DuckDB.
ORACLE_SQL = """
with d as (select doc_id as id, 0 as side, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents
  union all select item_id, 1, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') from benchmark),
s as (select distinct side, id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) as g from d where len(w) >= 5),
n as (select id, count(*) as n_item from s where side = 1 group by id),
p as (select a.id as doc_id, b.id as item_id, count(*) as n_shared from s a join s b on a.g = b.g and a.side = 0 and b.side = 1 group by 1, 2)
select doc_id, item_id, cast(n_item as int) as n_item, cast(n_shared as int) as n_shared, n_shared / n_item as containment
from p join n on n.id = item_id where n_shared >= ceil(n_item * 0.8e0 - 1e-9)
"""
