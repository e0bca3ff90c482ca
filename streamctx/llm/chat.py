"""Chat formatting by schema fingerprints, in DataFrame functions only.

The nested field paths of a frame (names only, sorted; arrays as []) are hashed. The
hash selects a declarative mapping, which turns that layout into canonical turns:
array<struct<role, text>>. A mapping is data: SQL expressions over the layout's columns.
Further columns, and further fields of nested turns, are left aside: then the mapping that reads all that another one does
and more is taken, and a layout that fits two mappings of which neither does so is an error, as is one that fits none.

Template: each turn is TURN, the role, MID, the text, END, a line break. Control
strings (CONTROL) inside a role or text are broken up by an escape, which `unescape`
takes out again, so every role and text comes back as it was.

Null texts and roles count as empty; rows of one conversation are ordered by turn
(nulls first), then role, then text; repeated rows stay. An empty table gives an
empty result. Texts are formatted whole, however long. One conversation is one row of the result, so the turns of one
conversation must fit in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, MID, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Control strings of public chat templates, escaped inside texts.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>")


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ddl: the layout, of which the fingerprint is taken. turns: SQL for array<struct<role, text>>.
    group_by, order: for layouts with a row for each turn; `turns` is then SQL for one turn's struct.
    """

    name: str
    ddl: str
    turns: str
    group_by: tuple[str, ...] = ()
    order: tuple[str, ...] = field(default=())


_PAIR = "transform({list}, m -> named_struct('role', {role}, 'text', {text}))"
_ROLES = "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END"
_TASK = r"concat_ws('\n', instruction, nullif(input, ''))"


def _turns(**texts: str) -> str:
    """SQL for a turn of each role, in order."""
    return "array(" + ", ".join(f"named_struct('role', '{role}', 'text', {text})" for role, text in texts.items()) + ")"


MAPPINGS = (
    Mapping("turn rows", "conv_id bigint, turn bigint, role string, text string", "named_struct('role', role, 'text', text)", ("conv_id",), ("turn", "role", "text")),
    Mapping("messages", "messages array<struct<role: string, content: string>>", _PAIR.format(list="messages", role="m.role", text="m.content")),
    Mapping("from and value", "conversations array<struct<`from`: string, value: string>>", _PAIR.format(list="conversations", role=_ROLES, text="m.value")),
    Mapping("messages with tool calls", "messages array<struct<role: string, content: string, tool_calls: string>>", _PAIR.format(list="messages", role="m.role", text=r"concat_ws('\n', nullif(m.content, ''), m.tool_calls)")),
    Mapping("prompt and response", "prompt string, response string", _turns(user="prompt", assistant="response")),
    Mapping("prompt and completion", "prompt string, completion string", _turns(user="prompt", assistant="completion")),
    Mapping("preference", "prompt string, chosen string, rejected string", _turns(user="prompt", assistant="chosen")),
    Mapping("preference of messages", "chosen array<struct<role: string, content: string>>, rejected array<struct<role: string, content: string>>", _PAIR.format(list="chosen", role="m.role", text="m.content")),
    Mapping("instruction and output", "instruction string, output string", _turns(user="instruction", assistant="output")),
    Mapping("instruction", "instruction string, input string, output string", _turns(user=_TASK, assistant="output")),
    Mapping("system, instruction", "system string, instruction string, output string", _turns(system="system", user="instruction", assistant="output")),
    Mapping("system, instruction, input", "system string, instruction string, input string, output string", _turns(system="system", user=_TASK, assistant="output")),
)


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all leaves."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(leaves: list[str]) -> int:
    """A hash of the sorted leaf paths: types and the order of columns don't matter."""
    value = 0xCBF29CE484222325
    for byte in "\n".join(sorted(leaves)).encode():
        value = (value ^ byte) * 0x100000001B3 % (1 << 64)
    return value


def known(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[int, tuple[Mapping, set[str]]]:
    """The mappings, and the leaf paths they read, by fingerprint."""
    out = {}
    for m in mappings:
        leaves = paths(T.StructType.fromDDL(m.ddl))
        out[fingerprint(leaves)] = (m, set(leaves))
    return out


def select_mapping(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping of df's fingerprint; with other leaves besides, the one contained in df that reads all that the others contained do."""
    by_print, own = known(mappings), paths(df.schema)
    if (code := fingerprint(own)) in by_print:
        return by_print[code][0]
    fits = [(m, read) for code, (m, read) in by_print.items() if fingerprint([p for p in own if p in read]) == code]
    most = [m for m, read in fits if not any(read < other for _, other in fits)]
    if len(most) != 1:
        found = f"mappings {[m.name for m in most]} all fit" if most else "no mapping for"
        raise ValueError(f"{found} the layout {sorted(own)}")
    return most[0]


def to_turns(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep (for row layouts: the grouping columns) and turns, an array of (role, text) in order without nulls."""
    m = select_mapping(df, mappings)
    clean = lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    if m.group_by:
        one = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(m.order)], F.expr(m.turns).alias("t"))
        lists = df.groupBy(*m.group_by).agg(F.array_sort(F.collect_list(one)).alias("turns"))
        return lists.select(*m.group_by, F.transform("turns", lambda x: clean(x["t"])).alias("turns"))
    return df.select(*keep, F.transform(F.coalesce(F.expr(m.turns), F.array()), clean).alias("turns"))


def escape(text: Column) -> Column:
    r"""A backslash becomes two; a control string gets \! after its first character."""
    quoted = "|".join(f"\\Q{c[1:]}\\E" for c in sorted(CONTROL, key=len, reverse=True) if c[0] == "<")
    square = "|".join(f"\\Q{c[1:]}\\E" for c in CONTROL if c[0] == "[")
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"(<)(?={quoted})|(\[)(?={square})", r"$1$2\\!")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|!)", "$1")


def format_turns(df: DataFrame) -> DataFrame:
    """df with `formatted`, and `loss`: the places (start from 0, length) of the assistant's escaped texts in it."""
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(MID)).alias("head"), escape(t["text"]).alias("body")))
    df = df.withColumn("_parts", parts)
    step = F.aggregate(
        "_parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(END))).alias("at"),
            F.when(p["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return df.withColumn("formatted", text).withColumn("loss", step).drop("_parts")


def read_turns(formatted: Column) -> Column:
    """The turns, from the formatted text alone."""
    pieces = F.slice(F.split(formatted, f"\\Q{TURN}\\E"), 2, 1_000_000_000)
    role = lambda p: F.substring_index(p, MID, 1)
    text = lambda p: F.substr(p, F.length(role(p)) + len(MID) + 1, F.length(p) - F.length(role(p)) - len(MID) - len(END))
    turn = lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text"))
    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
