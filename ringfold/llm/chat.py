"""Chat formatting with a grammar that is read back and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Control strings of the template (fixed values). A turn is BOS, the mark of its role, the text, EOS.
BOS, EOS = "<s>", "</s>"
MARKS = {"user": "[INST]", "assistant": "[/INST]", "system": "<<SYS>>"}
ROLE, END_ROLE = "[ROLE]", "[/ROLE]"
#: A control string as its first character and the rest; an escaped one has backslashes between.
_HEAD, _TAIL = "([<\\[])", "(/?s>|<SYS>>|/?INST\\]|/?ROLE\\])"
CONTROL = _HEAD + _TAIL
_ANY, _ESCAPED = _HEAD + "(\\\\*)" + _TAIL, _HEAD + "\\\\(\\\\*)" + _TAIL


def escape(text: Column) -> Column:
    """Puts one more backslash into each control string and each escaped one: reversible for every text."""
    return F.regexp_replace(text, _ANY, "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    """Takes one backslash out of each escaped control string."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render_turn(role: Column, text: Column) -> Column:
    mark = F.coalesce(*(F.when(role == r, F.lit(m)) for r, m in MARKS.items()), F.concat(F.lit(ROLE), role, F.lit(END_ROLE)))
    return F.concat(F.lit(BOS), mark, text, F.lit(EOS))


def _head(piece: Column) -> Column:
    """BOS and mark with which a turn begins; empty where it isn't one."""
    fixed = "|".join(m.replace("[", "\\[").replace("]", "\\]") for m in MARKS.values())
    return F.regexp_extract(piece, f"^{BOS}({fixed}|\\[ROLE\\][^\\[<]*(?:[\\[<](?!{_TAIL})[^\\[<]*)*+\\[/ROLE\\])", 0)


def parse_turn(piece: Column) -> Column:
    """The turn, as a struct of role and text, that a rendered one without its EOS means; null if the
    grammar has no such turn, as when a control string stands inside its text."""
    head = _head(piece)
    body = F.substring(piece, F.length(head) + 1, F.length(piece))
    mark = F.substring(head, len(BOS) + 1, F.length(head))
    role = F.coalesce(*(F.when(mark == m, F.lit(r)) for r, m in MARKS.items()), unescape(F.substring(mark, len(ROLE) + 1, F.length(mark) - len(ROLE) - len(END_ROLE))))
    return F.when((head != "") & ~body.rlike(CONTROL), F.struct(role.alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """All turns of a formatted conversation, in order; a piece outside the grammar gives a null turn."""
    pieces = F.split(formatted, EOS, -1)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), parse_turn)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rounds: int = 2, train_role: str = "assistant") -> DataFrame:
    """Formats conversations; a row each with conv_id, formatted, parsed (array of role and text, read
    back from the output), loss_spans (array of start and end in code points of formatted, end exclusive: what a
    trainer's loss covers) and round_trip (parsed equals the source).

    Each turn is rendered as it is, parsed and compared with its source; where they differ, its text
    and role are escaped once more and tried again, ``rounds`` times at most; one round always suffices, and a
    turn that none fits (with rounds=0) is an error.
    The whole conversation is then parsed once more and compared. DataFrame functions only.

    Null role and text: empty. Turns of one number are ordered by role, then text; null numbers come
    first; null conversation ids form one conversation; repeated rows are repeated turns. Extra columns
    are ignored; an empty table gives no rows. A conversation is one string, and so at most 2 GB.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    source = F.struct("role", "text")
    role, text = F.col("role"), F.col("text")
    tries = []
    for _ in range(rounds + 1):
        tries.append((render_turn(role, text), text))
        role, text = escape(role), escape(text)
    same = lambda shown: F.size(F.split(shown, EOS, -1)) == 2, lambda shown: parse(shown)[0] == source
    shown = F.coalesce(*(F.when(same[0](t) & same[1](t), F.struct(t.alias("shown"), F.length(x).alias("n"))) for t, x in tries), F.raise_error(F.lit("a turn doesn't fit the grammar, however often it is escaped")).cast("struct<shown:string,n:int>"))
    rows = rows.withColumn("out", shown).select("conv_id", "turn", "role", "text", "out.shown", "out.n")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    end = F.sum(F.length("shown").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("end", end - len(EOS))
    span = F.when(F.col("role") == train_role, F.struct((F.col("end") - F.col("n")).alias("start"), F.col("end").alias("end")))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "shown", span.alias("span")))).alias("turns"))
    chats = chats.select(
        "conv_id",
        F.array_join(F.col("turns.shown"), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )
    chats = chats.withColumn("parsed", parse(F.col("formatted")))
    return chats.select("conv_id", "formatted", "parsed", "loss_spans", (F.col("parsed") == F.col("source")).alias("round_trip"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss covers, unescaped, one span after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
