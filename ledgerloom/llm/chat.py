"""Chat formatting: schema fingerprints select declarative mappings to canonical turns. DataFrame functions only.

A layout is known by its *fingerprint*: a hash of the sorted nested field paths of the record, so
frames (or JSON records) that carry the same layout always meet the same mapping. Each mapping is
data: where the list of turns lies and which paths hold role and text.

The template writes a turn as ``<|im_start|>role NEWLINE text<|im_end|>NEWLINE``. Backslashes in
texts are doubled and a backslash is put behind the first character of every control string
(those of this template and of other common ones), which one left-to-right pass undoes.

Defined cases: null text and null role are empty; a null ``conv_id`` is a conversation of its own;
rows that share a turn number are ordered by role, then text; repeated rows are repeated turns; other
columns are ignored; an empty table gives no rows; a conversation is one text in the end, so it must fit a
task's memory, however long its turns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings that texts must not contain unescaped.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: ``turns`` names an array of records with the fields ``role`` and
    ``text``; or ``parts`` lists (role, path) pairs of one record; or the rows themselves are turns."""

    paths: tuple[str, ...]
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    parts: tuple[tuple[str, str], ...] = ()


#: The declared layouts. Order and identity columns are named by the caller, so they are no part of the paths.
MAPPINGS = (
    Mapping(("role", "text"), role="role", text="text"),
    Mapping(("role", "content"), role="role", text="content"),
    Mapping(("messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Mapping(("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Mapping(("prompt", "response"), parts=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("completion", "prompt"), parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("instruction", "output"), parts=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output"), parts=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("prompt", "response", "system"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)
#: Role names of other layouts and their canonical form.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(m.paths): m for m in MAPPINGS}


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """The nested field paths of a schema; an array level is written ``[]``."""
    out = []
    for f in schema.fields:
        path, kind = f"{prefix}{f.name}", f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        out += field_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return out


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of each JSON record, from the nested field names of its variant schema."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    tokens = F.regexp_extract_all(shape, F.lit(r"(`[^`]+`: |\w+: |ARRAY<|OBJECT<|>|[A-Z_]+(?:\([0-9,]+\))?)"), F.lit(1))
    state = "struct<stack:array<string>,name:string,paths:array<string>>"
    make = lambda stack, name, paths: F.struct(stack.alias("stack"), name.alias("name"), paths.alias("paths")).cast(state)
    none, blank = F.array().cast("array<string>"), F.lit("")

    def step(acc: Column, token: Column) -> Column:
        stack, name, paths = acc["stack"], acc["name"], acc["paths"]
        return (
            F.when(token.endswith(": "), make(stack, F.replace(F.replace(token, F.lit(": "), blank), F.lit("`"), blank), paths))
            .when(token == "ARRAY<", make(F.concat(stack, F.array(blank)), F.concat(name, F.lit("[]")), paths))
            .when(token == "OBJECT<", make(F.concat(stack, F.array(F.when(name == "", blank).otherwise(F.concat(name, F.lit("."))))), blank, paths))
            .when(token == ">", make(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))), blank, paths))
            .otherwise(make(stack, blank, F.concat(paths, F.array(F.concat(F.array_join(stack, ""), name)))))
        )

    paths = F.aggregate(tokens, make(none, blank, none), step)["paths"]
    return F.substring(F.sha2(F.array_join(F.sort_array(F.array_distinct(paths)), "\n"), 256), 1, 16)


def canonical_role(role: Column) -> Column:
    out = F.coalesce(role.cast("string"), F.lit(""))
    for known, name in ROLES.items():
        out = F.when(role == known, F.lit(name)).otherwise(out)
    return out


def _turn_array(mapping: Mapping, read) -> Column:
    """array<struct<pos, role, text>> of one record; ``read(path)`` gives a field of it."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if mapping.parts:
        return F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(role).alias("role"), text(read(path)).alias("text")) for i, (role, path) in enumerate(mapping.parts)))
    if mapping.turns:
        return F.transform(read(mapping.turns), lambda t, i: F.struct(i.alias("pos"), canonical_role(t[mapping.role]).alias("role"), text(t[mapping.text]).alias("text")))
    return F.array(F.struct(F.lit(0).alias("pos"), text(read(mapping.role)).alias("role"), text(read(mapping.text)).alias("text")))


def to_turns(df: DataFrame, key: str, order: str | None = None, registry: dict[str, Mapping] = REGISTRY) -> DataFrame:
    """Canonical turns (key, turn, pos, role, text) of a typed frame, by the mapping its schema's fingerprint selects.

    A frame with other columns beside a layout's is read by the layout with the most paths among those it
    holds. Raises ``ValueError`` for an unknown layout, naming its paths.
    """
    record = [c for c in df.columns if c not in (key, order)]
    paths = field_paths(df.select(*record).schema)
    mapping = registry.get(fingerprint(paths))
    if mapping is None:
        mapping = max((m for m in registry.values() if set(m.paths) <= set(paths)), key=lambda m: len(m.paths), default=None)
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    turns = df.select(F.col(key), (F.col(order) if order else F.lit(0)).cast("long").alias("turn"), F.explode(_turn_array(mapping, lambda p: F.col(p))).alias("t"))
    return turns.select(key, "turn", "t.pos", "t.role", "t.text")


def json_to_turns(df: DataFrame, key: str, record: str = "record", registry: dict[str, Mapping] = REGISTRY) -> DataFrame:
    """Canonical turns of a frame whose JSON text column mixes layouts row by row; unknown layouts give
    one turn with role ``unmapped`` that holds the record itself, so that no row is lost."""
    v = F.try_parse_json(F.col(record))
    one = "array<struct<pos:int,role:string,text:string>>"
    turns = F.array(F.struct(F.lit(0).alias("pos"), F.lit("unmapped").alias("role"), F.coalesce(F.col(record), F.lit("")).alias("text"))).cast(one)
    mark = F.col("__layout")
    for known, m in registry.items():
        if m.turns:
            items = F.try_variant_get(v, f"$.{m.turns}", f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
            made = _turn_array(m, lambda p, items=items: items)
        else:
            made = _turn_array(m, lambda p: F.try_variant_get(v, f"$.{p}", "string"))
        turns = F.when(mark == known, made.cast(one)).otherwise(turns)
    out = df.withColumn("__layout", json_fingerprint(F.col(record)))
    return out.select(F.col(key), F.lit(0).cast("long").alias("turn"), F.explode(turns).alias("t")).select(key, "turn", "t.pos", "t.role", "t.text")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, key: str, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` text and ``loss_spans`` (start, length in code points)."""
    turns = turns.select(
        F.col(key),
        F.col("turn"),
        F.col("pos"),
        F.col("role"),
        F.col("text"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    ).withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    by = Window.partitionBy(key).orderBy(F.asc_nulls_first("turn"), "pos", "role", "text")
    placed = turns.select(
        key,
        F.row_number().over(by).alias("at"),
        "segment",
        F.when(F.col("role") == loss_role, F.struct((F.sum(F.length("segment")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.length("segment") + F.length("head")).alias("start"), F.length("body").alias("length"))).alias("loss"),
    )
    packed = placed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "segment", "loss"))).alias("parts"))
    return packed.select(
        key,
        F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("formatted"),
        F.filter(F.transform("parts", lambda p: p["loss"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from formatted text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    head = r"(?s)^<\|im_start\|>((?:[^\n\\]++|\\.)*+)\n"
    return F.transform(
        turns,
        lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"]))), "")


PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    done = format_turns(to_turns(rows.unionByName(probe), "conv_id", "turn"), "conv_id")
    read = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP6_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), named AS (
  SELECT conv_id, turn, text, role FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length({_sql_escape('role')}) + length({_sql_escape('text')}))::BIGINT AS formatted_chars
FROM named GROUP BY conv_id
"""
