"""Chat formatting with relational operations only: sort turn structs, merge adjacent turns of a role, concatenate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import let

START, END, PART = "<|im_start|>", "<|im_end|>", "<|im_part|>"
CHUNK = 64  # turns that are sorted and collected together before a conversation's chunks meet


def escape(text: Column) -> Column:
    """Escaped text never holds `<|`: backslashes double, and `<|` becomes `<\\|`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted text, loss_spans (code-point offset and length of each trained text), n_turns.

    Rows of a conversation are ordered by turn (nulls first), then role, then text, so ties and repeated rows have one
    order; all are kept. Null role or text: empty. Null conv_id: a conversation of its own. Adjacent rows of one role
    share a block and are parted by a mark, so every row can be read back. Other columns are ignored. No rows: no rows.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = escape(F.coalesce(F.col("text"), F.lit("")))
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / CHUNK).alias("chunk"),
        F.struct(
            F.col("turn"),
            F.replace(escape(role), F.lit("\n"), F.lit("\\\n")).alias("role"),
            text.alias("text"),
            (role == loss_role).alias("loss"),
        ).alias("row"),
    )
    # Long conversations are sorted chunk by chunk in parallel; only their sorted chunks meet.
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    gathered = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "rows"))).alias("chunks"))
    rows_of = F.flatten(F.transform("chunks", lambda c: c["rows"]))
    return gathered.select("conv_id", let(rows_of, lambda rows: let(_pieces(rows), _assembled)).alias("out")).select("conv_id", "out.*")


def _pieces(rows: Column) -> Column:
    """Each row with the marks before and after its text: blocks open and close where the role changes."""
    first = lambda x, i: (i == 0) | (F.get(rows, i - 1)["role"] != x["role"])
    last = lambda x, i: (i == F.size(rows) - 1) | (F.get(rows, i + 1)["role"] != x["role"])

    def marked(x: Column, i: Column) -> Column:
        head = F.when(first(x, i), F.concat(F.lit(START), x["role"], F.lit("\n"))).otherwise(F.lit(PART))
        whole = F.concat(head, x["text"], F.when(last(x, i), F.lit(END + "\n")).otherwise(F.lit("")))
        return F.struct(
            whole.alias("whole"),
            F.length(whole).cast("long").alias("length"),
            F.length(head).cast("long").alias("skip"),
            F.length(x["text"]).cast("long").alias("text"),
            x["loss"].alias("loss"),
        )

    return F.transform(rows, marked)


def _assembled(pieces: Column) -> Column:
    """Concatenate the pieces; offsets are summed in blocks of blocks, so the work stays near the number of turns."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, p: s + p["length"])
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")), lambda b: F.slice(pieces, b * CHUNK + 1, CHUNK)
    )

    def spans(sized: Column) -> Column:
        return F.flatten(
            F.transform(
                sized,
                lambda b, i: let(
                    total(F.slice(sized, F.lit(1), i)),
                    lambda before: F.transform(
                        b["rows"],
                        lambda p, j: F.struct(
                            (before + total(F.slice(b["rows"], F.lit(1), j)) + p["skip"]).alias("start"), p["text"].alias("length"), p["loss"].alias("loss")
                        ),
                    ),
                ),
            )
        )

    sized = F.transform(blocks, lambda b: F.struct(total(b).alias("length"), b.alias("rows")))
    trained = F.transform(F.filter(let(sized, spans), lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"]))
    return F.struct(
        F.array_join(F.transform(pieces, lambda p: p["whole"]), "").alias("formatted"),
        trained.alias("loss_spans"),
        F.size(pieces).cast("long").alias("n_turns"),
    )


def parse_chats(chats: DataFrame) -> DataFrame:
    """Read the turns back from formatted text alone: conv_id, turns array<struct<role, text>>; loss_texts from the spans."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    # A block is the start mark, the role up to the first newline that no backslash escapes, and the parts.
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n"
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(b, head, ""), r"<\|im_part\|>"),
                lambda t: F.struct(unescape(F.regexp_extract(b, head, 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    # Four bytes a code point: each span is cut at its offset without a scan from the start.
    cut = lambda wide, s: F.substring(wide, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int"))
    loss = let(F.encode("formatted", "UTF-32"), lambda wide: F.transform("loss_spans", lambda s: unescape(F.decode(cut(wide, s), "UTF-32"))))
    return chats.select("*", turns.alias("turns"), loss.alias("loss_texts"))
