"""Paths, identities, names and review texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    """Null for the empty string: the first truthy value is then coalesce."""
    return F.nullif(col(x), F.lit(""))


def stripped(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def bucket_of(label: Column | str, rel: Column | str) -> Column:
    """struct(bucket, generator, rel): a fake's first folder is its generator; no label, unlabeled."""
    label, rel = filled(label), col(rel)
    parts = F.split(rel, "/")
    made = (label == "DeepFake") & (F.size(parts) > 1)
    return F.struct(
        F.when(made, F.concat(F.lit("DeepFake/"), parts[0])).otherwise(F.coalesce(label, F.lit("unlabeled"))).alias("bucket"),
        F.when(made, parts[0]).alias("generator"),
        F.when(made, F.array_join(F.slice(parts, 2, 100_000), "/")).otherwise(rel).alias("rel"),
    )


def review_id_of(given: Column | str, image_rel: Column | str, image_rels: Column | str) -> Column:
    """The given id, else the first folder of image_rel, else of the first of image_rels, else empty."""
    first = lambda x: filled(F.split_part(x, F.lit("/"), F.lit(1)))
    return F.coalesce(filled(given), first(col(image_rel)), first(F.get(col(image_rels), 0)), F.lit(""))


def identity(review_id: Column | str, image_rel: Column | str, key: Column | str, image_path: Column | str) -> Column:
    """The first that isn't empty; null if all are."""
    return F.coalesce(*[filled(x) for x in (review_id, image_rel, key, image_path)])


def row_key(bucket: Column | str, ident: Column | str) -> Column:
    return F.concat_ws("::", F.coalesce(col(bucket), F.lit("")), col(ident))


def image_id(rel_path: Column | str) -> Column:
    return F.substring(F.sha1(col(rel_path)), 1, 16)


def safe_name(x: Column | str) -> Column:
    kept = F.regexp_replace(stripped(F.coalesce(col(x), F.lit(""))), "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(filled(kept), F.lit("anonymous"))


def review_text(title: Column | str, *bodies: Column | str) -> Column:
    """Stripped title and first filled body, joined by a full stop; null if both are empty."""
    body = F.coalesce(*[filled(b) for b in bodies]) if len(bodies) > 1 else col(bodies[0])
    return filled(F.concat_ws(". ", filled(stripped(title)), filled(stripped(body))))


def keyed_hash(*parts: Column | str) -> Column:
    """60 bits of MD5 of the parts: the source of all choices that must not depend on row order."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


# What a body of an oversized request, of a failed fetch, and a dropped connection say.
TOO_LARGE = r"image size|too large|exceeds?\s+the\s+maximum|payload.{0,20}(large|limit)|request entity too large|maximum.{0,20}size"
FETCH_FAILED = r"download .{0,30}file .{0,20}timed out|provided url does not appear to be valid|failed to (download|fetch) .{0,30}(image|file)"
CONNECTION_DROPPED = r"connection reset|broken pipe|connection aborted|errno 104|errno 32"


def error_class(error: Column | str) -> Column:
    """The class of an error text, ``HTTP <status>: <body>`` or that of an exception; null for none.

    too_large: status 413, or 400 with such a body; upstream_transient: 400 with a failed fetch;
    connection_dropped: no status; rate_limit: 429; other_4xx; other.
    """
    error = col(error)
    status = F.regexp_extract(error, r"^HTTP (\d+)", 1)
    says = lambda pattern: error.rlike(f"(?i){pattern}")
    return (
        F.when(error.isNull(), None)
        .when((status == "413") | ((status == "400") & says(TOO_LARGE)), "too_large")
        .when((status == "400") & says(FETCH_FAILED), "upstream_transient")
        .when((status == "") & says(CONNECTION_DROPPED), "connection_dropped")
        .when(status == "429", "rate_limit")
        .when(status.rlike("^4..$"), "other_4xx")
        .otherwise("other")
    )


def rounded_double(x: Column | str, digits: int) -> Column:
    """A double rounded as doubles are: the product with 10^digits to the next integer, half away from zero.

    ``F.round`` rounds the decimal digits that a double is written with: 0.5025 to 0.503, where the
    product is 502.49999999999994 and so gives 0.502.
    """
    power = 10.0**digits
    return F.round(col(x) * power, 0) / power


def metric_cell(x: Column | str) -> Column:
    """Three decimals, or a dash where the metric is undefined."""
    return F.when(col(x).isNull(), "—").otherwise(F.format_string("%.3f", rounded_double(x, 3)))
