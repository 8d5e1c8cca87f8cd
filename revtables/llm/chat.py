"""Chat formatting as Spark expressions: one training text and its loss mask a conversation.

    <|im_start|>role
    text<|im_sep|>text<|im_end|>

A block holds adjacent turns of one role, parted by ``<|im_sep|>``, so turns can be told
apart again. Every control string begins with ``<|``; inside texts one backslash more is
put between the two characters, and taken out again when the text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtables.llm.arrays import bound, chunks, cut, running_sum

START, SEPARATOR, END, LINE_IN_ROLE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"
#: Roles whose texts the loss is taken on.
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE_IN_ROLE))


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one: role, texts."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))
    return bound(
        starts,
        lambda s: F.transform(
            s,
            lambda at, k: F.struct(
                turns[at]["role"].alias("role"),
                F.transform(
                    F.slice(turns, at + 1, F.when(k + 1 < F.size(s), F.get(s, k + 1)).otherwise(n) - at), lambda t: t["text"]
                ).alias("texts"),
            ),
        ),
    )


def _pieces(blocks: Column, learned: tuple[str, ...]) -> Column:
    """The parts of the training text in order, and whether the loss is taken on each."""

    def of_block(b: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        texts = F.flatten(
            F.transform(
                b["texts"],
                lambda t, i: F.array(
                    part(F.when(i > 0, F.lit(SEPARATOR)).otherwise(F.lit("")), F.lit(False)), part(escape(t), b["role"].isin(*learned))
                ),
            )
        )
        head = F.array(part(F.concat(F.lit(START), _role(b["role"]), F.lit("\n")), F.lit(False)))
        return F.concat(head, texts, F.array(part(F.lit(END + "\n"), F.lit(False))))

    return F.flatten(F.transform(blocks, of_block))


def _mask(pieces: Column) -> Column:
    """Start and end (exclusive, code points) of every part that the loss is taken on."""

    def spans(lengths: Column) -> Column:
        rows = F.arrays_zip(lengths.alias("n"), running_sum(lengths).alias("end"), pieces.alias("p"))
        return F.transform(
            F.filter(rows, lambda x: x["p"]["loss"]), lambda x: F.struct((x["end"] - x["n"]).alias("start"), x["end"].alias("end"))
        )

    return bound(F.transform(pieces, lambda p: F.length(p["text"])), spans)


def formatted(conversations: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """conv_id, formatted and loss_mask of each conversation (conv_id, turn, role, text).

    Turns stand by turn, equal turns by role and text; a null turn comes first. Null roles
    and texts count as empty, and an empty text is a turn like any other. Rows without a
    conv_id are one conversation. Repeated rows are repeated turns. Other columns are ignored.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_conversation = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = bound(bound(F.col("turns"), _blocks), lambda b: _pieces(b, learned))
    out = bound(
        pieces,
        lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["text"]), "").alias("formatted"), _mask(p).alias("loss_mask")),
    )
    return by_conversation.select("conv_id", out.alias("out")).select("conv_id", "out.*")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.array_remove(F.split(text, r"<\|im_end\|>\n", -1), "")

    def of_block(block: Column) -> Column:
        cut = F.instr(block, "\n")
        role = unescape(F.replace(F.substring(block, F.lit(len(START) + 1), cut - len(START) - 1), F.lit(LINE_IN_ROLE), F.lit("\n")))
        body = F.substring(block, cut + 1, F.length(block))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def read_loss(text: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    return bound(chunks(text), lambda pieces: F.transform(mask, lambda s: unescape(cut(pieces, s["start"], s["end"]))))
