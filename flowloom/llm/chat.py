"""Chat formatting by schema fingerprints, in DataFrame and SQL functions only.

A record (a struct, a JSON string or a variant) is fingerprinted by a hash of its
nested field paths, whatever the types of its values.  The fingerprint selects
a declarative layout, which says where turns, roles and texts are, and records of
any registered layout become the same canonical turns.  ``format_turns`` writes
turns with a template and a loss mask over the assistant's texts, and
``read_turns`` and ``masked_text`` read both back.

The template marks a turn as ``<s>[role]text</s>``.  Inside roles and texts the
characters that marks are made of are escaped (``~0`` to ``~3``), so no text can
hold a mark, and every text is read back as it was.

Defined results: a record whose fingerprint is not registered has null turns and
null layout, as have null and malformed records; null roles and texts are
empty; equal records each give a row; a record without turns formats as an
empty string; an empty table gives an empty result; other columns are kept.
The formatted text of one conversation is one string, so a conversation must
fit a row; JSON text beyond Spark's size limit of a variant has null turns and
null layout, as malformed text has, and such a struct is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import unused

TURN = "array<struct<role:string,text:string>>"
_TYPES = r": (?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP(?:_NTZ)?|BINARY|UUID|VARIANT|DECIMAL\([0-9]+,[0-9]+\))"


@dataclass(frozen=True)
class Layout:
    """Where a record's turns are.

    paths: the field paths, nested ones with ``[]`` and ``.``, that make the
    fingerprint (one layout may have several sets of optional fields).
    turns: path of an array of messages with the fields ``role`` and ``text``;
    or else ``fixed``: (role, paths that are joined by an empty line) in order,
    where a turn all of whose paths are missing or empty is left out unless it
    is the last.
    roles: other names of the canonical roles.
    """

    name: str
    paths: tuple[tuple[str, ...], ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict = field(default_factory=dict)


_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("messages", (("messages[].role", "messages[].content"), ("messages[]",)), turns="messages"),
    Layout("numbered messages", (("messages[].turn", "messages[].role", "messages[].text"),), turns="messages", text="text"),
    Layout("from and value", (("conversations[].from", "conversations[].value"),), turns="conversations", role="from", text="value", roles=_ALIASES),
    Layout("instruction", (("instruction", "input", "output"), ("instruction", "output")), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt and completion", (("prompt", "completion"),), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", (("system", "prompt", "response"), ("prompt", "response")), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", (("question", "answer"),), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)


def shape_of(paths: tuple[str, ...]) -> str:
    """The shape that ``shape`` gives for records with these field paths."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.replace("[]", ".[]").split("."):
            at = at.setdefault(step, {})

    def write(node: dict) -> str:
        if not node:
            return ""
        if "[]" in node:
            inside = write(node["[]"])
            return f": ARRAY<{inside.removeprefix(': ')}>"
        return ": OBJECT<" + ", ".join(f"{k}{write(node[k])}" for k in sorted(node)) + ">"

    return write(tree).removeprefix(": ")


def shape(record: Column) -> Column:
    """The nested field paths of a variant, in order of their names, without types."""
    schema = F.schema_of_variant(record)
    bare = F.regexp_replace(F.regexp_replace(schema, r"ARRAY<(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|VARIANT)>", "ARRAY<>"), _TYPES, "")
    return bare


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape(record))


def as_variant(df: DataFrame, record: str) -> Column:
    """A record column as a variant; malformed JSON is null."""
    kind = df.schema[record].dataType
    col = F.col(f"`{record}`")
    if isinstance(kind, T.StringType):
        return F.try_parse_json(col)
    return col if isinstance(kind, T.VariantType) else F.to_variant_object(col)


def _turns(v: Column, layout: Layout) -> Column:
    empty = F.lit("")
    if layout.turns:
        kind = f"array<struct<{layout.role}:string,{layout.text}:string>>"
        role = lambda m: F.coalesce(m[layout.role], empty)

        def named(m):
            out = role(m)
            for old, new in layout.roles.items():
                out = F.when(role(m) == old, F.lit(new)).otherwise(out)
            return out

        messages = F.try_variant_get(v, f"$.{layout.turns}", kind)
        return F.transform(messages, lambda m: F.struct(named(m).alias("role"), F.coalesce(m[layout.text], empty).alias("text")))
    turns = []
    for i, (role, paths) in enumerate(layout.fixed):
        got = [F.try_variant_get(v, f"$.{p}", "string") for p in paths]
        text = F.array_join(F.filter(F.array(*got), lambda x: F.coalesce(x, empty) != ""), "\n\n")
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        optional = role == "system" and i == 0
        turns.append(F.when(F.lit(not optional) | (text != ""), turn))
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout`` (name) and ``turns`` (array of role and text) from the record in column ``record``."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("layout", "turns")]
    v_, fp_ = unused([*df.columns, "layout", "turns"], "variant", "fingerprint")
    with_variant = df.select(*keep, as_variant(df, record).alias(v_))
    with_print = with_variant.withColumn(fp_, F.when(F.col(v_).isNotNull(), fingerprint(F.col(v_))))
    name = turns = None
    for layout in layouts:
        for paths in layout.paths:
            test = F.col(fp_) == F.xxhash64(F.lit(shape_of(paths)))
            one = _turns(F.col(v_), layout).cast(TURN)
            name = F.when(test, layout.name) if name is None else name.when(test, layout.name)
            turns = F.when(test, one) if turns is None else turns.when(test, one)
    return with_print.select(*keep, name.alias("layout"), turns.alias("turns"))


#: What is escaped, and by what; the escape itself comes first.
_ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))


def escape(text: Column) -> Column:
    for a, b in _ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(_ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def format_turns(df: DataFrame, turns: str = "turns", *, learn: str = "assistant") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans``: bytes of the UTF-8 form, from and length, of the texts of role ``learn``."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("formatted", "loss_spans")]
    coalesced = lambda c: F.coalesce(c, F.lit(""))
    parts = F.transform(F.col(f"`{turns}`"), lambda t: F.struct(F.concat(F.lit("<s>["), escape(coalesced(t["role"])), F.lit("]")).alias("head"), escape(coalesced(t["text"])).alias("body"), (coalesced(t["role"]) == learn).alias("learn")))
    parts_ = unused([*df.columns, "formatted", "loss_spans"], "parts")[0]
    one = df.select(*keep, parts.alias(parts_))
    none = F.array().cast("array<struct<from:int,length:int>>")

    def step(s, p):
        start = s["at"] + F.octet_length(p["head"])
        end = start + F.octet_length(p["body"])
        span = F.array(F.struct(start.alias("from"), (end - start).alias("length")))
        return F.struct((end + 4).alias("at"), F.when(p["learn"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate(parts_, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    text = F.array_join(F.transform(parts_, lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), "")
    return one.select(*keep, text.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    marked = F.filter(F.split(formatted, "<s>", -1), lambda x: x != "")

    def one(x):
        role = F.substring(F.substring_index(x, "]", 1), F.lit(2), F.length(x))
        text = F.substring_index(F.substring_index(x, "]", -1), "</s>", 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(marked, one)


def masked_text(formatted: str, spans: str) -> Column:
    """The text under a loss mask, unescaped; both arguments name columns."""
    cut = lambda s: F.decode(F.substring(F.col(formatted).cast("binary"), s["from"] + 1, s["length"]), "UTF-8")
    return unescape(F.array_join(F.transform(F.col(spans), cut), ""))


def conversations_as_records(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record): the rows of each conversation in order of turn (null first; ties by role and text)."""
    message = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(F.struct(F.array_sort(F.collect_list(message)).alias("messages")).alias("record"))
