"""Chat formatting with Spark expressions only: ordered turn structs, merged blocks, a reversible template."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Blocks ``<|:role|>text<|more|>text<|end|>``; every mark starts with ``<|`` and ends with ``|>``.

    ``control`` are further strings that a text must not hold as they are, as other templates use them.
    """

    more: str = "more"
    end: str = "end"
    control: tuple[str, ...] = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column, t: Template) -> Column:
    """Double every backslash, then put one behind the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in t.control:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """The exact inverse of :func:`escape`: a backslash gives way to the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per ``conv_id``: ``formatted``, the conversation as one string, and ``loss_spans``, where assistants' texts stand in it.

    Turns are ordered by ``(turn, role, text)``, nulls first, so ties and repeated rows give one defined
    order. Adjacent turns of one role are aggregated into a block, with a mark between their texts, so that
    :func:`read_back` finds every turn again. Null text and
    null role count as empty; null ``conv_id`` rows form one conversation; an empty table gives no
    rows; other columns are not read. A conversation is one output row, so it is as large as that.
    """
    t = template
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), escape(text, t).alias("text"), escape(role, t).alias("mark"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    opens = F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True)).cast("int")
    rows = rows.withColumns({"opens": opens, "n": F.row_number().over(w)}).withColumn("block", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    blocks = rows.groupBy("conv_id", "block").agg(F.first("role").alias("role"), F.first("mark").alias("mark"), texts.alias("texts"))
    blocks = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "role", "mark", "texts"))).alias("b"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    fixed = lambda *parts: piece(F.concat(F.lit("<|"), *parts, F.lit("|>")), F.lit(False))
    said = lambda b: F.transform(b["texts"], lambda x, i: F.array(F.when(i == 0, fixed(F.lit(":"), b["mark"])).otherwise(fixed(F.lit(t.more))), piece(x, b["role"] == "assistant")))
    pieces = F.flatten(F.transform("b", lambda b: F.array_append(F.flatten(said(b)), fixed(F.lit(t.end)))))
    return blocks.select("conv_id", pieces.alias("pieces")).select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), loss_spans("pieces").alias("loss_spans")
    )


def loss_spans(pieces: str) -> Column:
    """``array<struct<start, length, byte, bytes>>``: places of the pieces marked for the loss in their concatenation, in characters and in UTF-8 bytes."""
    zero = F.expr("struct(0L as at, 0L as byte, cast(array() as array<struct<start:bigint,length:bigint,byte:bigint,bytes:bigint>>) as spans)")
    size = lambda p: (F.length(p["text"]).cast("long"), F.octet_length(p["text"]).cast("long"))
    span = lambda acc, p: F.struct(acc["at"].alias("start"), size(p)[0].alias("length"), acc["byte"].alias("byte"), size(p)[1].alias("bytes"))
    step = lambda acc, p: F.struct(
        (acc["at"] + size(p)[0]).alias("at"), (acc["byte"] + size(p)[1]).alias("byte"),
        F.when(p["loss"], F.array_append(acc["spans"], span(acc, p))).otherwise(acc["spans"]).alias("spans"),
    )
    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, cut out of the formatted string by bytes and unescaped, in order and with nothing between."""
    cut_out = lambda raw: F.array_join(F.transform(spans, lambda s: F.substr(raw, (s["byte"] + 1).cast("int"), s["bytes"].cast("int")).cast("string")), "")
    return unescape(F.transform(F.array(F.col(formatted).cast("binary")), cut_out)[0])


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns again, from ``formatted`` alone: ``turns`` array of ``(role, text)`` beside the given columns.

    The string is cut into blocks at role marks and each block at ``more`` marks. A role ends at the first ``|>``, as roles hold none unescaped.
    """
    t = template
    blocks = F.filter(F.split("formatted", r"<\|:", -1), lambda b, i: i > 0)
    role = lambda b: F.substring_index(b, "|>", 1)
    body = lambda b: F.substr(b, F.length(role(b)) + 3, F.length(b) - F.length(role(b)) - 2 - len(f"<|{t.end}|>"))
    turns = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(body(b), rf"<\|{t.more}\|>", -1), lambda x: F.struct(unescape(role(b)).alias("role"), unescape(x).alias("text"))
        ),
    )
    return formatted.withColumn("turns", F.flatten(turns))
