"""The text of requests: templates are parameters, with {n} and {i} for counts and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritally.functions.text import col, filled


def one_comment(comment: Column | str, template: str) -> Column:
    """The block of one comment; template holds {c}."""
    return F.replace(F.lit(template), F.lit("{c}"), col(comment))


def comment_block(comments: Column | str, one: str, many: str, line: str = '  Image {i}: "{c}"', blank: str = "\n\n") -> Column:
    """Of a job's comments (array): blank without any, one block if all are the same, else a list
    that keeps each comment's position. ``many`` holds {lines}."""
    placed = F.filter(F.transform(col(comments), lambda c, i: F.struct((i + 1).alias("i"), c.alias("c"))), lambda x: filled(x["c"]).isNotNull())
    texts = F.array_distinct(F.transform(placed, lambda x: x["c"]))
    lines = F.array_join(F.transform(placed, lambda x: F.replace(F.replace(F.lit(line), F.lit("{i}"), x["i"].cast("string")), F.lit("{c}"), x["c"])), "\n")
    return F.when(F.coalesce(F.size(placed), F.lit(0)) <= 0, F.lit(blank)).when(F.size(texts) == 1, one_comment(texts[0], one)).otherwise(F.replace(F.lit(many), F.lit("{lines}"), lines))


def rendered(template: Column | str, n: Column | str, i: Column | None = None) -> Column:
    """A template text with {n}, and {i} where i is given."""
    out = F.replace(F.lit(template) if isinstance(template, str) else template, F.lit("{n}"), col(n).cast("string"))
    return out if i is None else F.replace(out, F.lit("{i}"), i.cast("string"))


def request_text(mode: Column | str, n: Column | str, block: Column | str, first_block: Column | str, t: dict[str, str]) -> Column:
    """A job's whole request text. One image: single head, its comment, single tail. Packed
    (MultiImage) and stepwise modes have a head and tail of their own; stepwise ones also a text
    after each image but the last."""
    mode, n = col(mode), col(n)
    packed = F.concat(rendered(t["packed_head"], n), col(block), rendered(t["packed_tail"], n))
    steps = F.array_join(F.transform(F.sequence(F.lit(1), n - 1), lambda i: rendered(t["step"], n, i)), "\n")
    stepwise = F.concat(steps, F.lit("\n"), rendered(t["step_head"], n), col(block), rendered(t["step_tail"], n))
    single = F.concat(F.lit(t["head"]), col(first_block), F.lit(t["tail"]))
    return F.when(n <= 1, single).when(mode.startswith("MultiImage"), packed).otherwise(stepwise)


def inserted(body: Column | str, block: Column | str, marker: str) -> Column:
    """body with block before the first marker, or after the body where there is none."""
    body = F.lit(body) if isinstance(body, str) else body
    at = F.locate(marker, body)
    return F.when(col(block).isNull(), body).when(at > 0, F.concat(F.substr(body, F.lit(1), at - 1), col(block), F.substr(body, at))).otherwise(F.concat(body, col(block)))


def turn_prompt(idx: Column | str, n: Column | str, t: dict[str, str], running: bool) -> Column:
    """First, middle or final text of a conversation by position; the running-verdict tail on all but the final."""
    idx, n = col(idx), col(n)
    tail = F.lit("\n\n" + t["running"] if running else "")
    plain = F.concat(F.when(idx == 1, rendered(t["first"], n, idx)).otherwise(rendered(t["middle"], n, idx)), tail)
    return F.when(n == 1, F.lit(t["single"])).when(idx == n, rendered(t["final"], n)).otherwise(plain)
