"""From free-text replies to typed verdicts, without Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritally.functions.text import col, stripped

#: The fields of a reply, under all names.
FIELDS = ["is_ai_modified", "is_ai_generated", "confidence", "reason", "reasoning", "explanation", "per_image", "per_image_analysis", "images"]
YES = ["true", "yes", "1", "ai", "ai-modified", "ai-generated"]


def parse_reply(raw: Column | str) -> Column:
    """The reply's JSON as a variant: all of it, without a code fence, or from the first brace to
    the last. Null if neither parses. Bare NaN and Infinity, which many writers emit, are read
    as strings. Of a repeated key of the object the last value is kept, whatever the session sets: what
    the variant parser refuses is read by schema, with the fields that verdicts are made of."""
    s = stripped(raw)
    bare = F.regexp_replace(s, "^`+|`+$", "")
    tagged = F.lower(F.ltrim(bare)).startswith("json")
    after = F.when(F.instr(bare, "\n") > 0, F.expr("null")).otherwise(F.substr(bare, F.lit(5)))
    untagged = F.coalesce(after, F.regexp_replace(bare, r"^[^\n]*\n", ""))
    s = F.when(s.startswith("```"), F.when(tagged, untagged).otherwise(bare)).otherwise(s)
    quoted = lambda x: F.regexp_replace(x, r":\s*(NaN|-?Infinity)\b", ': "$1"')
    inner = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    tries = (s, quoted(s), inner, quoted(inner))
    return F.coalesce(*[f(x) for x in tries for f in (whole, repeated_keys)])


def whole(text: Column) -> Column:
    """One JSON value as a variant; null if it is none, or if more text follows it, which the parser alone would ignore."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def repeated_keys(text: Column) -> Column:
    """A JSON object with repeated keys as a variant of its FIELDS; null if it is anything else."""
    # in an array, as in whole
    several = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{', '.join(f'{x}: variant' for x in FIELDS)}>>", {"allowSingleQuotes": "false"})
    one = F.when((F.size(several) == 1) & text.startswith("{"), several[0])
    return F.when(one.isNotNull(), F.to_variant_object(one))


def is_object(v: Column | str) -> Column:
    return F.coalesce(F.schema_of_variant(col(v)).startswith("OBJECT"), F.lit(False))


def field(v: Column | str, name: str) -> Column:
    """A field as a variant; null if it is missing or JSON null."""
    x = F.try_variant_get(col(v), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(x) != "VOID", x)


def truthy(x: Column) -> Column:
    """A present value that isn't false, zero or empty."""
    text = x.try_cast("string") if hasattr(x, "try_cast") else x.cast("string")
    kind = F.schema_of_variant(x)
    flat = F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean")).when(kind == "STRING", text != "")
    flat = flat.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(x).isin("[]", "{}"))
    return F.coalesce(flat.otherwise(F.try_variant_get(x, "$", "double") != 0), F.lit(False))


def is_fake(v: Column | str) -> Column:
    """is_ai_modified, else is_ai_generated: words for yes, otherwise truth; null stays null."""
    x = F.coalesce(field(v, "is_ai_modified"), field(v, "is_ai_generated"))
    word = F.lower(stripped(F.try_variant_get(x, "$", "string")))
    return F.when(x.isNull(), None).when(F.schema_of_variant(x) == "STRING", word.isin(YES)).otherwise(truthy(x))


def confidence(v: Column | str) -> Column:
    """A number, a numeric text or a boolean as 1 or 0; else null."""
    x = field(v, "confidence")
    text = F.try_variant_get(x, "$", "string")
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double")).otherwise(stripped(text).try_cast("double"))


def reason(v: Column | str) -> Column:
    """The first of reason, reasoning, explanation that isn't empty: trimmed text, a list's filled
    items joined by blanks, other values as JSON text."""
    first = F.coalesce(*[F.when(truthy(field(v, k)), field(v, k)) for k in ("reason", "reasoning", "explanation")])
    kind = F.schema_of_variant(first)
    items = F.transform(F.try_variant_get(first, "$", "array<string>"), stripped)
    joined = F.array_join(F.filter(items, lambda t: t != ""), " ")
    text = stripped(F.try_variant_get(first, "$", "string"))
    return F.when(kind == "STRING", text).when(kind.startswith("ARRAY"), joined).otherwise(F.to_json(first))


def findings(v: Column | str) -> Column:
    """The per-image list under one of its three names; null if the first that isn't empty is no list."""
    first = F.coalesce(*[F.when(truthy(field(v, k)), field(v, k)) for k in ("per_image", "per_image_analysis", "images")])
    return F.try_variant_get(first, "$", "array<variant>")


def verdict_columns(v: Column | str) -> list[Column]:
    """is_ai_modified, confidence, reason, error. No JSON, or JSON that is no object, is an error."""
    bad = ~is_object(v)
    keep = lambda c: F.when(is_object(v), c)
    return [keep(is_fake(v)).alias("is_ai_modified"), keep(confidence(v)).alias("confidence"), keep(reason(v)).alias("reason"), F.when(bad, F.lit("failed to parse JSON reply")).alias("error")]


def flags(status: Column | str, error: Column | str) -> list[Column]:
    """ran: a verdict that isn't missing; ok: status ok without an error."""
    status = col(status)
    return [F.coalesce((status != "") & (status != "missing"), F.lit(False)).alias("ran"), F.coalesce((status == "ok") & col(error).isNull(), F.lit(False)).alias("ok")]
