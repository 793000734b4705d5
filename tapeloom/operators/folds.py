"""Ordered folds over the rows of one recording, gathered in an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def folded(rows: Column, zero: Column, step: Callable[[Column, Column], Column], block: int = BLOCK) -> Column:
    """The last state of step(state, row) over rows; a state is a struct with an array out, to which a step appends.

    Appending copies an array, so blocks of rows append to an array of their own, and only whole
    blocks are joined: a hundred thousand rows copy some hundred times what they keep, not half of it every row.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / block).cast("int")), lambda b: F.slice(rows, b * block + 1, block))

    def one_block(state: Column, own: Column) -> Column:
        begun = state.withField("out", F.slice(state["out"], 1, 0))
        done = F.aggregate(own, begun, step)
        return F.transform(F.array(done), lambda x: x.withField("out", F.concat(state["out"], x["out"])))[0]

    return F.aggregate(F.when(F.size(rows) > 0, blocks).otherwise(F.slice(F.array(rows), 1, 0)), zero, one_block)
