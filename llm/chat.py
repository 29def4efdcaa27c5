"""Chat formatting with a grammar round trip (operator 9, native).

Grammar::

    conversation := turn*
    turn         := "<s>" role "[INST]" body "[/INST]" "</s>"

Control strings are ``<s> </s> [INST] [/INST] <<SYS>> <</SYS>>``.  The parser
splits at ``</s>``, reads each part by one pattern and undoes the escapes
``~2`` = ``[``, ``~1`` = ``<``, ``~0`` = ``~`` (in this order); it is the same
whether a turn was escaped or not.  A turn is first rendered as it is and
parsed; only if the parser's answer differs from the source is its content
escaped (``~``, and the first character of every control string).  The whole
rendered conversation is parsed again and compared with the source; if it
still differs, all its turns are escaped.

Loss mask: spans (start, length in code points of the rendered text) of the
assistant bodies.

Turns are ordered by (turn, role, text).  A rendered conversation is one value,
so the turns of one conversation meet in one row; that is the format itself.

Defined cases: null text and null role are empty; a null turn comes first;
rows with a null conv_id form one conversation; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"
TURN = r"(?s)^<s>(.*?)\[INST\](.*)\[/INST\]$"


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("~"), F.lit("~0"))
    x = F.regexp_replace(x, r"<(s>|/s>|<SYS>>|</SYS>>)", "~1$1")
    return F.regexp_replace(x, r"\[(INST\]|/INST\])", "~2$1")


def unescape(x: Column) -> Column:
    for code, char in (("~2", "["), ("~1", "<"), ("~0", "~")):
        x = F.replace(x, F.lit(code), F.lit(char))
    return x


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit("<s>"), role, F.lit("[INST]"), body, F.lit("[/INST]</s>"))


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a rendered conversation."""
    parts = F.split(formatted, "</s>", -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, TURN, 1)).alias("role"),
                                                 unescape(F.regexp_extract(p, TURN, 2)).alias("text")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans, n_escaped``, one row a conversation."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = render_turn(F.col("role"), F.col("text"))
    source = F.array(F.struct("role", "text"))
    rows = rows.withColumn("same", parse(plain) == source)
    strict = render_turn(escape(F.col("role")), escape(F.col("text")))
    rows = rows.withColumns(
        {"strict": strict, "first": F.when(F.col("same"), plain).otherwise(strict)})
    head = lambda role: F.length(role) + 9  # noqa: E731  <s> and [INST]
    lead = F.when(F.col("same"), head(F.col("role"))).otherwise(head(escape(F.col("role"))))
    rows = rows.withColumns({"lead": lead, "strict_lead": head(escape(F.col("role"))), "assistant": F.col("role") == "assistant"})
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "n": F.row_number().over(w),
        "at": F.coalesce(F.sum(F.length("first")).over(before), F.lit(0)),
        "strict_at": F.coalesce(F.sum(F.length("strict")).over(before), F.lit(0))})

    def span(at: str, lead_: str, piece: str) -> Column:
        return F.struct((F.col(at) + F.col(lead_)).alias("start"), (F.length(piece) - F.col(lead_) - 11).cast("long").alias("length"))

    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "n", "role", "text", "first", "strict", "same", "assistant",
        span("at", "lead", "first").alias("span"), span("strict_at", "strict_lead", "strict").alias("strict_span")))).alias("t"))

    def joined(piece: str) -> Column:
        return F.array_join(F.transform("t", lambda x: x[piece]), "")

    def spans(name: str) -> Column:
        return F.transform(F.filter("t", lambda x: x["assistant"]), lambda x: x[name])

    whole = whole.withColumn("formatted", joined("first"))
    agrees = parse(F.col("formatted")) == F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    whole = whole.withColumn("agrees", agrees)
    return whole.select(
        "conv_id", F.when(F.col("agrees"), F.col("formatted")).otherwise(joined("strict")).alias("formatted"),
        F.when(F.col("agrees"), spans("span")).otherwise(spans("strict_span")).alias("loss_spans"),
        F.when(F.col("agrees"), F.size(F.filter("t", lambda x: ~x["same"]))).otherwise(F.size("t")).alias("n_escaped"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
