"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>"
#: Turns (and loss spans) that are folded or cut together: growing an array and cutting a text cost as much as is there
#: already, so both are done in two steps, inside groups and over groups.
GROUP = 256


def _escape(text: Column) -> Column:
    """One more backslash in every control string of a text: `</turn` becomes `<\\/turn`, and `<\\turn` `<\\\\turn`."""
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def _name(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))


def _role(name: Column) -> Column:
    return F.replace(F.replace(F.replace(name, F.lit("%3C"), F.lit("<")), F.lit("%3E"), F.lit(">")), F.lit("%25"), F.lit("%"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of the value, which is found once however often a lambda below asks for it."""
    return F.get(F.transform(F.array(value), use), 0)


def _groups(items: Column, use: Callable[[Column], Column]) -> Column:
    """An array with what `use` makes of each GROUP items in a row."""
    n = F.ceil(F.size(items) / GROUP).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda g: use(F.slice(items, g * GROUP + 1, F.lit(GROUP))))


def _loss_spans(pieces: Column) -> Column:
    """Start and length of the texts under loss: running sums inside groups, then over groups."""
    long = lambda x: x.cast("long")
    spans = lambda a: a.cast("array<struct<start:bigint,length:bigint>>")
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p["head"]) + F.length(p["text"]) + len(CLOSE)).alias("at"),
        F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(long(a["at"] + F.length(p["head"])).alias("start"), long(F.length(p["text"])).alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    inside = _groups(pieces, lambda g: F.aggregate(g, F.struct(long(F.lit(0)).alias("at"), spans(F.array()).alias("spans")), step))
    shift = lambda a, g: F.struct(
        (a["at"] + g["at"]).alias("at"),
        F.concat(a["spans"], F.array(F.transform(g["spans"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), s["length"].alias("length"))))).alias("spans"),
    )
    none = F.array().cast("array<array<struct<start:bigint,length:bigint>>>")
    return F.flatten(F.aggregate(inside, F.struct(long(F.lit(0)).alias("at"), none.alias("spans")), shift, lambda a: a["spans"]))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start and length in code points).

    turns: (conv_id, turn, role, text). The template writes a block `<turn ROLE>` for each run of turns of one
    role, and ends every turn's text with `</turn>`, so turns that were merged can still be told apart. Control
    strings in texts get a backslash, reversibly. The loss spans cover the texts of `loss_role`, not the marks.

    The turns of a conversation are collected and sorted; a turn that goes on with the role before it joins that
    block. A long conversation takes time in proportion to its text: nothing is copied or cut turn by turn.

    Null texts and roles count as empty; a null conv_id is a conversation of its own; turns go by number (null
    first), ties by role and text; repeated rows are turns of their own; other columns are ignored; no rows
    give no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(all_: Column) -> Column:
        goes_on = lambda x, i: (i > 0) & (F.get(all_, i - 1)["role"] == x["role"])
        head = lambda x, i: F.when(goes_on(x, i), "").otherwise(F.concat(F.lit(OPEN), _name(x["role"]), F.lit(">")))
        return F.transform(all_, lambda x, i: F.struct(head(x, i).alias("head"), _escape(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss")))

    t = t.select("conv_id", _let(F.col("turns"), piece).alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "")
    return t.select("conv_id", formatted.alias("formatted"), _let(F.col("pieces"), _loss_spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text); the inverse of the template."""
    blocks = _let(F.split(formatted, OPEN), lambda parts: F.slice(parts, 2, F.size(parts)))

    def turns(b: Column) -> Column:
        role = F.substring_index(b, ">", 1)
        texts = _let(F.split(F.substr(b, F.length(role) + 2), CLOSE), lambda x: F.slice(x, 1, F.size(x) - 1))
        return _let(_role(role), lambda name: F.transform(texts, lambda x: F.struct(name.alias("role"), _unescape(x).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. Spans are cut from the text that their group covers."""
    cut = lambda text, start, n: F.substr(text, (start + 1).cast("int"), n.cast("int"))

    def texts(text: Column, group: Column) -> Column:
        first, last = F.get(group, 0)["start"], F.element_at(group, -1)
        covered = cut(text, first, last["start"] + last["length"] - first)
        return _let(covered, lambda c: F.array_join(F.transform(group, lambda s: _unescape(cut(c, s["start"] - first, s["length"]))), ""))

    return _let(formatted, lambda text: _let(spans, lambda all_: F.array_join(_groups(all_, lambda g: _let(g, lambda group: texts(text, group))), "")))
