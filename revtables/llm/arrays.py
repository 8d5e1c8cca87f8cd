"""Expressions over long arrays and texts whose time does not grow with the square of their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts are cut into chunks of so many characters, so that a cut counts from its chunk's start.
CHUNK = 1000
#: Elements are combined in blocks of so many, blocks in blocks of them, and so on; all levels hold any array.
BLOCK_BITS, LEVELS = 5, 6


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element combined with all before it, such as running sums; ``combine`` is associative and takes 0 as nothing.

    Blocks of elements are combined, then blocks of blocks. An element takes the whole blocks
    before it of each level, fewer than a block's size of them, so the work for an element
    does not depend on its place, and no array is copied for it.
    """
    size = 1 << BLOCK_BITS
    whole = lambda some: F.aggregate(some, F.lit(0), combine)

    def upward(below: list[Column]) -> Column:
        if len(below) == LEVELS:
            def of_element(x: Column, i: Column) -> Column:
                out = x
                for level, sums in enumerate(below):
                    at = F.shiftright(i, BLOCK_BITS * level)
                    within = at.bitwiseAND(size - 1)
                    out = combine(whole(F.slice(sums, at - within + 1, within)), out)
                return out

            return F.transform(below[0], of_element)
        last = below[-1]
        blocks = F.sequence(F.lit(0), F.shiftright(F.size(last) - 1, BLOCK_BITS))
        sums = F.transform(blocks, lambda b: whole(F.slice(last, F.shiftleft(b, BLOCK_BITS) + 1, F.lit(size))))
        return bound(sums, lambda more: upward([*below, more]))

    return F.when(F.size(values) > 0, bound(values, lambda v: upward([v]))).otherwise(values)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` characters, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to before ``end`` (from 0) of a text given by its ``chunks``."""
    first = F.floor(start / CHUNK).cast("int")
    some = F.slice(pieces, first + 1, F.floor(F.greatest(start, end - 1) / CHUNK).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(some, ""), start - first * CHUNK + 1, end - start)).otherwise("")
