"""Chat formatting by schema fingerprints, in DataFrame functions.

Records of chats come in many layouts: lists of messages, prompt and completion, instructions
with input and history, nested turns. The nested field paths of a record, without types and
values, are hashed to its fingerprint; the fingerprint selects a declarative mapping, which says
where turns, roles and texts lie; the mapping makes canonical turns of the record. A template
then joins the turns to one text with a loss mask. Control strings inside roles and texts are
escaped with a backslash, so the turns can be read back from the text as they were.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role: string, text: string>>"
ROLES = ("system", "user", "assistant")


@dataclass(frozen=True)
class Each:
    """A turn of every element of the list at ``path``: role and text at paths within it, roles renamed by ``names``."""

    path: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()

    def turns(self, record: str) -> Column:
        role = "coalesce(try_variant_get(x, '{}', 'string'), '')".format(self.role)
        if self.names:
            role = f"case {role} " + " ".join(f"when '{a}' then '{b}'" for a, b in self.names) + f" else {role} end"
        return F.expr(f"transform(try_variant_get({record}, '{self.path}', 'array<variant>'), x -> struct({role} as role, coalesce(try_variant_get(x, '{self.text}', 'string'), '') as text))")


@dataclass(frozen=True)
class Pairs:
    """Two turns of every element of the list of pairs at ``path``."""

    path: str
    roles: tuple[str, str] = ("user", "assistant")

    def turns(self, record: str) -> Column:
        two = ", ".join(f"struct('{r}' as role, coalesce(get(x, {i}), '') as text)" for i, r in enumerate(self.roles))
        return F.expr(f"flatten(transform(try_variant_get({record}, '{self.path}', 'array<array<string>>'), x -> array({two})))")


@dataclass(frozen=True)
class One:
    """One turn: the texts at ``paths``, joined by blank lines."""

    role: str
    paths: tuple[str, ...]

    def turns(self, record: str) -> Column:
        texts = ", ".join(f"coalesce(try_variant_get({record}, '{p}', 'string'), '')" for p in self.paths)
        return F.expr(f"array(struct('{self.role}' as role, concat_ws('\\n\\n', {texts}) as text))")


@dataclass(frozen=True)
class Mapping:
    """A layout: example records, one for every set of field paths it covers, and the parts of its turns in order."""

    name: str
    examples: tuple[str, ...]
    parts: tuple[Each | Pairs | One, ...]


def _listed(name: str, wrap, item: dict, part: Each) -> Mapping:
    """A layout of a list of like elements, which may be empty."""
    return Mapping(name, tuple(json.dumps(wrap(x)) for x in ([item], [])), (part,))


def _instruction(system: bool, given: bool, history: bool) -> Mapping:
    example = {"instruction": "", "output": ""} | ({"system": ""} if system else {}) | ({"input": ""} if given else {}) | ({"history": [["", ""]]} if history else {})
    parts = [One("system", ("$.system",))] * system + [Pairs("$.history")] * history
    parts += [One("user", ("$.instruction", "$.input") if given else ("$.instruction",)), One("assistant", ("$.output",))]
    return Mapping("instruction", (json.dumps(example),), tuple(parts))


MAPPINGS = (
    _listed("messages", lambda x: {"messages": x}, {"role": "", "content": ""}, Each("$.messages", "$.role", "$.content")),
    _listed("from_value", lambda x: {"conversations": x}, {"from": "", "value": ""}, Each("$.conversations", "$.from", "$.value", (("human", "user"), ("gpt", "assistant")))),
    _listed("nested", lambda x: {"dialog": {"turns": x}}, {"speaker": {"name": ""}, "utterance": {"text": ""}}, Each("$.dialog.turns", "$.speaker.name", "$.utterance.text")),
    Mapping("prompt", ('{"prompt": "", "completion": ""}',), (One("user", ("$.prompt",)), One("assistant", ("$.completion",)))),
    *(_instruction(*x) for x in product((False, True), repeat=3)),
)


@dataclass(frozen=True)
class Template:
    """start, role, sep, text, end of every turn. ``foreign`` strings mean something to other templates and are escaped too."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learnt: str = "assistant"

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.sep, self.end, *self.foreign)

    def escape(self, text: Column) -> Column:
        """Backslashes doubled, then one behind the first character of every control string."""
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
        return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def field_paths(record: Column) -> Column:
    """The nested fields of a variant, by name, without types and values."""
    return F.regexp_replace(F.schema_of_variant(record), r"(^|: |<)(?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9,]*\))?", "$1*")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with fingerprint, layout and turns (array of role, text).

    record is a variant column (of JSON text: ``parse_json``). Null roles and texts become empty.
    A record that is null or whose field paths no mapping covers stays, with null layout and turns.
    """
    out, print_ = records.withColumn("fingerprint", fingerprint(F.col(record))), F.col("fingerprint")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        known = print_.isin(*[fingerprint(F.parse_json(F.lit(e))) for e in m.examples])
        parts = [p.turns(record) for p in m.parts]
        layout, turns = F.when(known, m.name).otherwise(layout), F.when(known, F.concat(*parts) if len(parts) > 1 else parts[0]).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", F.coalesce(turns, F.when(F.col("layout").isNotNull(), F.array().cast(TURNS))))


def format_turns(chats: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """chats (turns, ...) with formatted and mask, without turns.

    formatted is one text; mask has a pair for every turn: how many characters, from its start
    marker on, are outside the loss (``out``), and how many after them are in it (``learn``). Its
    end marker is outside. Null turns give nulls; no turns give an empty text.
    """
    head = lambda t: F.concat(F.lit(template.start), template.escape(t["role"]), F.lit(template.sep))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), template.escape(t["text"]).alias("body"), (t["role"] == template.learnt).alias("learn")))
    size = lambda p: F.length(p["head"]) + F.when(p["learn"], 0).otherwise(F.length(p["body"]))
    mask = F.transform("_pieces", lambda p: F.struct(size(p).alias("out"), F.when(p["learn"], F.length(p["body"])).otherwise(0).alias("learn")))
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(template.end))), "")
    return chats.withColumn("_pieces", pieces).withColumn("formatted", text).withColumn("mask", mask).drop("_pieces", "turns")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """formatted (formatted, mask, ...) with turns as they were, and learnt: the texts under the loss mask, joined."""
    quoted = lambda c: rf"\Q{c}\E"
    cut = F.split("formatted", quoted(template.end), -1)
    out = formatted.withColumn("_pieces", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))))
    part = lambda p, i: unescape(F.split_part(F.substr(p, F.lit(len(template.start) + 1)), F.lit(template.sep), F.lit(i)))
    turns = F.transform("_pieces", lambda p: F.struct(part(p, 1).alias("role"), part(p, 2).alias("text")))
    learnt = F.zip_with("_pieces", "mask", lambda p, m: unescape(F.substr(p, m["out"] + 1, m["learn"])))
    return out.withColumn("turns", turns).withColumn("learnt", F.array_join(learnt, "")).drop("_pieces")


def laid_out(rows: DataFrame) -> DataFrame:
    """(conv_id, record): conversations, from rows (conv_id, turn, role, text), in the layouts that mixed sources bring.

    Turns stand by turn (null first; equal ones by role, then text). Rows without conv_id belong to no
    conversation. A layout is drawn by conv_id among those that can hold the conversation.
    """
    said = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    chats = rows.where("conv_id is not null").groupBy("conv_id").agg(said.alias("said"))
    chats = chats.withColumn("roles", F.expr("transform(said, x -> x.role)")).withColumn("texts", F.expr("transform(said, x -> x.text)"))
    chats = chats.withColumn("sys", F.expr("cast(roles[0] = 'system' as int)")).withColumn("n", F.size("roles")).withColumn("draw", F.expr("pmod(conv_id, 5)"))
    by_turns = "n > sys + 1 and pmod(n - sys, 2) = 0 and forall(sequence(sys, n - 1), i -> roles[i] = if(pmod(i - sys, 2) = 0, 'user', 'assistant'))"
    chats = chats.withColumn("by_turns", F.expr(by_turns)).withColumn("standard", F.expr("forall(roles, r -> r in ('system', 'user', 'assistant'))"))
    asked = "texts[n - 2]"
    where = f"locate('\\n\\n', {asked})"
    listed = lambda a, b, role: f"transform(said, x -> named_struct('{a}', {role}, '{b}', x.text))"
    messages = f"to_variant_object(named_struct('messages', {listed('role', 'content', 'x.role')}))"
    renamed = "case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end"
    from_value = f"to_variant_object(named_struct('conversations', {listed('from', 'value', renamed)}))"
    nested = "to_variant_object(named_struct('dialog', named_struct('turns', transform(said, x -> named_struct('speaker', named_struct('name', x.role), 'utterance', named_struct('text', x.text))))))"
    prompt = "to_variant_object(named_struct('prompt', texts[0], 'completion', texts[1]))"
    record = f"case when draw = 1 and standard then {from_value} when draw = 2 and by_turns and n = 2 then {prompt} "
    for system, given, history in product((False, True), repeat=3):
        fields = ["'output', texts[n - 1]", f"'instruction', if({where} > 0, left({asked}, {where} - 1), {asked})"]
        fields += ["'system', texts[0]"] * system + [f"'input', substr({asked}, {where} + 2)"] * given
        fields += ["'history', transform(sequence(sys, n - 4, 2), i -> array(texts[i], texts[i + 1]))"] * history
        when = f"draw = 3 and by_turns and sys = {int(system)} and {where} {'>' if given else '='} 0 and n {'>' if history else '='} sys + 2"
        record += f"when {when} then to_variant_object(named_struct({', '.join(fields)})) "
    record += f"when draw in (2, 4) then {nested} else {messages} end"
    return chats.select("conv_id", F.expr(record).alias("record"))


def formatted_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, layout, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read back from its formatted text.

    rows (conv_id, turn, role, text, ...): see ``laid_out`` for nulls, ties and repeats (a repeated row is a turn
    of its own). turns_sha256 is of role, \\n, text, \\n of each turn. Other columns are ignored. An
    empty table gives an empty result. A conversation is one record of at most 128 MiB (Spark's bound of a variant).
    """
    chats = format_turns(canonical(laid_out(rows)), template)
    back = read_back(chats.select("conv_id", "layout", "formatted", "mask"), template)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", "layout", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(text: str, template: Template) -> str:
    text = f"replace({text}, '\\', '\\\\')"
    for c in template.controls:
        text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
    return text


def oracle_sql(template: Template = Template()) -> str:  # noqa: B008
    """What the digests must be, from the rows alone, for DuckDB; layouts have no part in it."""
    marks = sum(map(len, (template.start, template.sep, template.end)))
    return f"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = '{template.learnt}'), '') as learnt,
  cast(sum({marks} + length({_sql_escape("role", template)}) + length({_sql_escape("text", template)})) as bigint) as formatted_chars from r group by conv_id)
select conv_id, n_turns, turns_sha256, length(learnt) as loss_chars, sha256(learnt) as loss_sha256, formatted_chars from t
"""
