"""Small helpers on column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often (and in whatever lambda) it is used.

    An expression that stands inside a lambda is worked out anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Values gathered before what is there already is copied.
GATHERED = 256


def gathered(
    values: Column,
    start: Column,
    step: Callable[[Column, Column], tuple[Column, Column]],
    kind: str,
    last: Callable[[Column], Column] | None = None,
) -> Column:
    """Walk over an array and gather an array of ``kind`` on the way.

    ``step`` takes the state and a value and gives the next state and an array of what
    is added; ``last`` adds to the end from the final state.  Each step of an aggregate
    copies all it has gathered, so this is done block by block.
    """

    def pair(state: Column, out: Column) -> Column:
        return F.struct(state.alias("state"), out.alias("out"))

    def add(own: Column, value: Column) -> Column:
        state, more = step(own["state"], value)
        return pair(state, F.concat(own["out"], more))

    def add_block(own: Column, block: Column) -> Column:
        done = F.aggregate(block, pair(own["state"], F.array().cast(kind)), add)
        return bound(done, lambda d: pair(d["state"], F.concat(own["out"], F.array(d["out"]))))

    def blocks(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / GATHERED).cast("int"))
        return F.when(F.size(values) > 0, F.transform(numbers, lambda b: F.slice(values, b * GATHERED + 1, F.lit(GATHERED))))

    def finish(own: Column) -> Column:
        out = F.flatten(own["out"])
        return F.concat(out, last(own["state"])) if last is not None else out

    first = pair(start, F.array().cast(f"array<{kind}>"))
    return F.coalesce(F.aggregate(bound(values, blocks), first, add_block, finish), F.array().cast(kind))
