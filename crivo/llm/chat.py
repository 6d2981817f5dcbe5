"""Chat formatting with a grammar that is read back, with DataFrame operations alone.

    conversation := turn*
    turn         := "### " role ": " text "</turn>\\n"

No field may hold ``</turn>`` or a ``###`` without a backslash before it, and no role
``: ``. A field is rendered as it is and read back by that grammar; where the reading
differs from the field, or there is none, its control strings get one backslash more
than they have: ``</turn>`` becomes ``<\\/turn>``, ``###`` becomes ``\\###``, and in a
role ``: `` becomes ``:\\ ``; strings that already look so get one more, so that taking
one away gives the source again. The escaped field is read back, too, and must be the
field. A conversation is the turns one after the other, and as each ends at the first
end of its own, its reading is the turns that were read.

Turns of a conversation stand by turn, then role, then text, nulls first; rows
that repeat are turns that repeat. Null texts and roles are empty ones. Rows
with a null conversation form one conversation of their own. A conversation is
one row of output, so the longest one must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

END, MARK, AFTER_ROLE = "</turn>\n", "### ", ": "
#: A mark with backslashes before it, the only one that a field may hold.
ESCAPED_MARK = r"\\+###"


def _escape(s: Column, role: bool) -> Column:
    s = F.regexp_replace(s, r"<(\\*)/turn>", r"<\\$1/turn>")
    s = F.regexp_replace(s, r"(\\*)###", r"\\$1###")
    return F.regexp_replace(s, r":(\\*) ", r":\\$1 ") if role else s


def _unescape(s: Column, role: bool = False) -> Column:
    if role:
        s = F.regexp_replace(s, r":\\(\\*) ", r":$1 ")
    s = F.regexp_replace(s, r"\\(\\*)###", r"$1###")
    return F.regexp_replace(s, r"<\\(\\*)/turn>", r"<$1/turn>")


def _bare_mark(rendered: Column) -> Column:
    return F.contains(F.regexp_replace(rendered, ESCAPED_MARK, " "), F.lit("###"))


def read_text(rendered: Column) -> Column:
    """The text that the grammar reads from what stands between a turn's head and its end; null where it can't be read."""
    closed = F.concat(rendered, F.lit(END))
    # it ends at the first end, and what is left must be nothing
    one = F.locate(END, closed) == F.length(rendered) + 1
    legal = one & ~F.contains(rendered, F.lit("</turn>")) & ~_bare_mark(rendered)
    return F.when(legal, _unescape(rendered))


def read_role(rendered: Column) -> Column:
    """The role that the grammar reads from a turn's head; null where it can't be read."""
    head = F.concat(rendered, F.lit(AFTER_ROLE))
    legal = (F.locate(AFTER_ROLE, head) == F.length(rendered) + 1) & ~F.contains(rendered, F.lit("</turn>")) & ~_bare_mark(rendered)
    return F.when(legal, _unescape(rendered, True))


def render_field(s: Column, role: bool = False) -> Column:
    """The field as it is if that is read back as the field, else escaped if that is; one of both always is."""
    s = F.coalesce(s, F.lit(""))
    read, escaped = read_role if role else read_text, _escape(s, role)
    return F.when(read(s).eqNullSafe(s), s).when(read(escaped).eqNullSafe(s), escaped).otherwise(
        F.raise_error(F.lit("a field is not read back from its escaped form")).cast("string"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def turn(block):
        role = F.substring_index(F.substr(block, F.lit(len(MARK) + 1)), AFTER_ROLE, 1)
        text = F.substr(block, F.length(role) + len(MARK) + len(AFTER_ROLE) + 1)
        return F.struct(_unescape(role, True).alias("role"), _unescape(text).alias("text"))

    return F.transform(blocks, turn)


def format_conversations(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: the id, ``formatted``, and ``loss_mask``, spans (from, length, in code points) of it to learn from."""
    rows = df.select(common.col(conversation).alias("c"), common.col(turn).alias("t"),
                     F.coalesce(common.col(role), F.lit("")).alias("r"), F.coalesce(common.col(text), F.lit("")).alias("x"))
    head = F.concat(F.lit(MARK), render_field(F.col("r"), True), F.lit(AFTER_ROLE))
    rows = rows.withColumn("head", head).withColumn("body", render_field(F.col("x")))
    order = Window.partitionBy("c").orderBy("t", "r", "x")
    length = F.length("head") + F.length("body") + len(END)
    until = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select(
        "c", F.row_number().over(order).alias("n"), F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("r").isin(*learn), F.struct((until - len(END) - F.length("body") + 1).alias("from"), F.length("body").cast("long").alias("length"))).alias("span"),
    )
    out = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "span"))).alias("turns"))
    return out.select(
        F.col("c").alias(conversation),
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_mask"),
    )


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the formatted text holds, read back from it."""
    out = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn(
        "learned", F.array_join(F.transform("loss_mask", lambda s: _unescape(F.substr(F.col("formatted"), s["from"].cast("int"), s["length"].cast("int")))), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        common.col(conversation), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
