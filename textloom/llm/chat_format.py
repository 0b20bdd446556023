r"""Chat formatting as a relational plan: sort turn structs, merge adjacent same-role turns, concatenate.

A conversation becomes blocks ``### role: text</turn>`` and a line end. Adjacent
turns of one role share a block, their texts parted by ``</turn>+ ``. Inside
texts and roles a backslash becomes ``\b``, a pair of ``#`` becomes ``#\h`` and
``</turn>`` becomes ``<\s/turn>`` (in roles a colon also becomes ``\c``), so no
text can forge a mark and the escapes can be undone.

The loss mask is run-length coded over the formatted text: (length, loss) for
each mark and each text in turn, with loss true on texts of the assistant.

Defined results: null texts and roles are empty; turns with equal numbers are
ordered by role, then text, and null turn numbers come first; rows with a null
conv_id form one conversation; repeated rows are turns of their own; an empty
table gives no rows; other columns, whatever their names, are ignored. A conversation is one output string, so it is gathered by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick

HEAD, END, MORE = "### ", "</turn>", "+ "
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.replace(text, F.lit("##"), F.lit("#\\h"))
    return F.replace(text, F.lit(END), F.lit("<\\s/turn>"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\s"), F.lit(""))
    text = F.replace(text, F.lit("\\h"), F.lit("#"))
    text = F.replace(text, F.lit("\\c"), F.lit(":"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask: array of (length, loss)."""
    rows = pick(turns, "conv_id", "turn", "role", "text")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segment(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        head = F.concat(F.when(i > 0, F.lit(END + "\n")).otherwise(F.lit("")), F.lit(HEAD), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(": "))
        return F.struct(F.when(same, F.lit(END + MORE)).otherwise(head).alias("mark"), escape(t["text"]).alias("text"), (t["role"] == ASSISTANT).alias("loss"))

    run = lambda length, loss: F.struct(length.alias("length"), loss.alias("loss"))
    no = F.lit(False)
    merged = sorted_turns.select("conv_id", F.transform("turns", segment).alias("segments"))
    return merged.select(
        "conv_id",
        F.concat(F.array_join(F.transform("segments", lambda s: F.concat(s["mark"], s["text"])), ""), F.lit(END + "\n")).alias("formatted"),
        F.concat(
            F.flatten(F.transform("segments", lambda s: F.array(run(F.length(s["mark"]), no), run(F.length(s["text"]), s["loss"])))),
            F.array(run(F.lit(len(END) + 1), no)),
        ).alias("loss_mask"),
    )


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once: inside lambdas an expression would be worked out for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def starts(lengths: Column, block: int = 256) -> Column:
    """Where each of an array of lengths begins, from 0: the sums of whole blocks before it, and of its own block's part."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda acc, n: acc + n)
    whole = lambda i: F.floor(i / block).cast("int")
    blocks = lambda own: F.transform(F.sequence(F.lit(0), whole(F.size(own))), lambda k: add(F.slice(own, k * block + 1, block)))
    before = lambda sums: F.transform(sums, lambda _, k: add(F.slice(sums, 1, k)))
    each = lambda own, past: F.transform(own, lambda _, i: F.get(past, whole(i)) + add(F.slice(own, whole(i) * block + 1, F.pmod(i, F.lit(block)))))
    return _let(lengths, lambda own: _let(blocks(own), lambda sums: _let(before(sums), lambda past: each(own, past))))


def loss_text(formatted: Column, mask: Column, few: int = 64) -> Column:
    """All text under the mask, cut out of the formatted text by the mask's lengths, each piece unescaped.

    A cut walks the text from its beginning; a mask of more than few runs cuts
    an array of the text's characters instead, which is walked once.
    """
    placed = F.arrays_zip(mask.alias("mask"), starts(F.transform(mask, lambda m: m["length"])).alias("at"))
    marked = F.filter(placed, lambda m: m["mask"]["loss"])
    cut = F.transform(marked, lambda m: unescape(F.substring(formatted, m["at"] + 1, m["mask"]["length"])))
    sliced = lambda chars: F.transform(marked, lambda m: unescape(F.array_join(F.slice(chars, m["at"] + 1, m["mask"]["length"]), "")))
    return F.array_join(F.when(F.size(mask) <= few, cut).otherwise(_let(F.split(formatted, "", -1), sliced)), "")


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: array of (role, text) from the formatted text alone, loss: the text under the mask."""

    def block(b: Column) -> Column:
        colon = F.instr(b, ": ")
        role = unescape(F.substring(b, F.lit(len(HEAD) + 1), colon - (len(HEAD) + 1)))
        texts = F.split(F.substring(b, colon + 2, F.length(b)), "</turn>\\+ ", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split("formatted", "</turn>\n", -1), lambda b: b != "")
    read = F.flatten(F.transform(blocks, block)).alias("turns")
    return formatted.select("conv_id", "formatted", read, loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
