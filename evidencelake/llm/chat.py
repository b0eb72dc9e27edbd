"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is ``### role: `` text ``\\n</turn>\\n``. The marks ``### `` and ``</turn>`` are control strings. Escaping
puts one backslash before every control string together with the backslashes already before it, and reading takes
one away, so any text comes back. A turn is first rendered as it is and read back by the parser; where that differs
from the source, conflicting content is escaped and the turn is rendered again, until it is identical. One
escape is enough, as then no control string in the text is bare: ``assert_true`` holds every row to that.

Rows of one conversation are ordered by turn (nulls first), then role and text, so ties have one order; repeated
rows are repeated turns. A null role or text is empty; rows with a null conv_id make one conversation. An empty
table gives no row; extra columns are not read. A conversation is one row of the result, as the formatted text is
one value; identical conversations stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TURN_END = "### ", "\n</turn>\n"
_CONTROL, _ESCAPED = r"(\\*)(### |</turn>)", r"\\(\\*)(### |</turn>)"
# What a role may not hold as it is, and how it is written.
_ROLE = (("\\", "\\\\"), (":", "\\c"), ("\n", "\\n"), ("\0", "\\0"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def escape_role(role: Column) -> Column:
    for plain, written in _ROLE:
        role = F.replace(role, F.lit(plain), F.lit(written))
    return role


def unescape_role(role: Column) -> Column:
    role = F.replace(role, F.lit("\\\\"), F.lit("\0"))  # the written form never holds this character
    for plain, written in _ROLE[1:3]:
        role = F.replace(role, F.lit(written), F.lit(plain))
    role = F.replace(role, F.lit("\\0"), F.lit("\1\1"))
    return F.replace(F.replace(role, F.lit("\0"), F.lit("\\")), F.lit("\1\1"), F.lit("\0"))


def render_turn(role: Column, written: Column) -> Column:
    return F.concat(F.lit(HEAD), escape_role(role), F.lit(": "), written, F.lit(TURN_END))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text, head, written).

    Deterministic: a turn ends at the first end mark on a line of its own, its header at the first ``: ``. ``head``
    is the header's length, ``written`` the text as it stands there.
    """
    parts = F.split(formatted, TURN_END)

    def read(turn: Column) -> Column:
        at = F.instr(turn, ": ")
        written = F.substring(turn, at + 2, F.length(turn))
        role = unescape_role(F.substring(turn, F.lit(len(HEAD) + 1), at - len(HEAD) - 1))
        return F.struct(role.alias("role"), unescape(written).alias("text"), (at + 1).alias("head"), written.alias("written"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), read)


def comes_back(rendered: Column, role: Column, text: Column) -> Column:
    turns = parse(rendered)
    first = F.get(turns, F.lit(0))
    return (F.size(turns) == 1) & (first["role"] == role) & (first["text"] == text)


def render(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered) of each row."""
    df = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = render_turn(F.col("role"), F.col("text"))
    escaped = render_turn(F.col("role"), escape(F.col("text")))
    bare = F.contains(F.col("text"), F.lit(HEAD)) | F.contains(F.col("text"), F.lit("</turn>"))
    return df.withColumn("rendered", F.when(bare | ~comes_back(plain, F.col("role"), F.col("text")), escaped).otherwise(plain))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, source): one text for each conversation, and the source turns that it must give back."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered")))
    return render(rows).groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id", F.array_join("t.rendered", "").alias("formatted"), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source")
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_spans, loss_text), read back from the text alone.

    ``loss_spans`` are (start, length) in code points of the formatted text: the assistant's texts as written;
    ``loss_text`` is what they say, unescaped. Fails if the turns are not the source's.
    """
    state = "struct<at:int,spans:array<struct<start:int,length:int>>>"

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + t["head"]
        own = F.array(F.struct(start.alias("start"), F.length(t["written"]).alias("length")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct((start + F.length(t["written"]) + len(TURN_END)).alias("at"), spans.alias("spans")).cast(state)

    empty = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(state)
    said = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    back = formatted.withColumn("turns", parse(F.col("formatted")))
    same = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.col("source")
    back = back.where(F.assert_true(same, F.lit("a conversation did not come back identical")).isNull())
    return back.select("conv_id", "formatted", "turns", F.aggregate("turns", empty, step, lambda acc: acc["spans"]).alias("loss_spans"), F.array_join(said, "").alias("loss_text"))
