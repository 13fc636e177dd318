"""Column sets and types. Rosters and category lists are parameters; these are defaults for shapes only."""

from __future__ import annotations

from pyspark.sql import types as T

#: The identity of a result record: no two buckets share a key.
KEY = ["mode", "category", "bucket", "ident"]

VERDICT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("is_ai_modified", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
#: One roll-up document; verdicts is a map, so that detector names with dots stay data.
SUMMARY = T.StructType(
    [
        T.StructField("mode", T.StringType()),
        T.StructField("num_jobs", T.LongType()),
        T.StructField("num_images", T.LongType()),
        T.StructField("buckets", T.ArrayType(T.StringType())),
        T.StructField("models", T.ArrayType(T.StringType())),
        T.StructField(
            "rows",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("key", T.StringType()),
                        T.StructField("bucket", T.StringType()),
                        T.StructField("label", T.StringType()),
                        T.StructField("generator", T.StringType()),
                        T.StructField("num_images", T.LongType()),
                        T.StructField("review_id", T.StringType()),
                        T.StructField("image_rel", T.StringType()),
                        T.StructField("image_rels", T.ArrayType(T.StringType())),
                        T.StructField("verdicts", T.MapType(T.StringType(), VERDICT)),
                    ]
                )
            ),
        ),
    ]
)
#: One file of records of a bucket and detector.
BUNDLE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("key", T.StringType()),
                        T.StructField("review_id", T.StringType()),
                        T.StructField("image_rel", T.StringType()),
                        T.StructField("image_path", T.StringType()),
                        T.StructField("num_images", T.LongType()),
                        T.StructField("is_ai_modified", T.BooleanType()),
                        T.StructField("confidence", T.DoubleType()),
                        T.StructField("error", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
#: Raw classic-detector items: keys differ by detector.
CLASSIC_ITEMS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
REVIEW_META = "number string, title string, text string, content string, review_text string"
EDIT_META = "number string, per_image array<struct<image: string, reviewer_comment: string>>"
