"""Chat formatting of typed content parts, by DataFrame functions alone.

A message is a list of parts (text, image, audio, document). A visitor flattens it: text is escaped, every other
part becomes an ordered placeholder `<|kind:n|>`, n counting a conversation's attachments from 0, and an
attachment reference with the token count into which the placeholder expands. Turns are wrapped in
`<|im_start|>role\\n ... <|im_end|>\\n`. No text can forge a control string: `\\` is doubled and `<|` becomes
`<\\|`, so `<|` stands only where the template put it, and both steps can be undone. Neighbouring text parts are joined
before they are escaped, so that no control string comes about between them. The loss mask covers the texts of
the chosen roles, as spans over the formatted text.

A window over each conversation gives ordinals and offsets, and the grouping that follows uses the same
partitioning: one shuffle in all. A conversation is one value of the result, so its turns meet in one row; no
other group is ever collected.

Defined cases: null texts, roles and part lists are empty; a null turn sorts first, equal turns by role and
then by content; rows with a null conversation form one conversation; repeated rows stay repeated turns; parts of an unknown
kind become placeholders of that kind; a null token count is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("tokens")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def flattened(parts: Column, seen: Column) -> Column:
    """The visitor: texts gather until another kind of part (or the end) closes them; then they are escaped as one."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"), seen.cast("bigint").alias("n"))

    def visit(state: Column, p: Column) -> Column:
        mark = F.concat(F.lit("<|"), F.replace(escape(p["kind"]), F.lit("|>"), F.lit("|\\>")), F.lit(":"), state["n"].cast("string"), F.lit("|>"))
        text = F.struct(state["done"].alias("done"), F.concat(state["open"], F.coalesce(p["text"], F.lit(""))).alias("open"), state["n"].alias("n"))
        other = F.struct(F.concat(state["done"], escape(state["open"]), mark).alias("done"), F.lit("").alias("open"), (state["n"] + 1).alias("n"))
        return F.when(_is_text(p), text).otherwise(other)

    several = F.aggregate(parts, start, visit, lambda s: F.concat(s["done"], escape(s["open"])))
    one = F.get(parts, F.lit(0))
    return F.when(F.size(parts) == 0, F.lit("")).when((F.size(parts) == 1) & _is_text(one), escape(F.coalesce(one["text"], F.lit("")))).otherwise(several)


def format_chat(messages: DataFrame, parts: Column, conv: Column, turn: Column, role: Column, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, loss_spans (start, length; code points from 0) and
    attachments (ordinal, kind, ref, tokens), with expanded_tokens, their sum."""
    rows = messages.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.col("parts").cast("string"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    others = F.filter("parts", lambda p: ~_is_text(p))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("others", others).withColumn("seen", F.coalesce(F.sum(F.size("others")).over(before), F.lit(0)))
    # the ordinal of a part is the conversation's count so far plus the attachments before it in its own message
    rows = rows.withColumn("refs", F.transform("others", lambda p, k: F.struct((F.col("seen") + k).alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"))))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", flattened(F.col("parts"), F.col("seen")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("piece").cast("bigint")).over(before), F.lit(0)))
    span = F.when(F.col("role").isin(*loss_roles), F.struct((F.col("at") + F.char_length("head")).alias("start"), F.char_length("body").cast("bigint").alias("length")))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece", span.alias("span"), "refs"))).alias("t"))
    return turns.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten("t.refs").alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation of text parts, unescaped."""
    pieces = F.filter(F.split(formatted, r"\Q" + START + r"\E"), lambda p: p != "")
    ends = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.instr(p, "\n").alias("n")))
    return F.transform(
        ends,
        lambda e: F.struct(
            unescape(F.replace(F.substr(e["p"], F.lit(1), e["n"] - 1), F.lit(BREAK), F.lit("\n"))).alias("role"),
            unescape(F.substr(e["p"], e["n"] + 1, F.char_length(e["p"]) - e["n"] - len(END))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
