"""Character spans of regular expressions, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,value:string,before:string>>"
#: Blocks of this many elements, and blocks of so many blocks, are gathered before they are put behind those before them.
BLOCK, LEVELS = 64, 4


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def gather(
    items: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]], last: Callable | None = None
) -> Column:
    """An array of what ``step`` gives for each item in order, in time linear in the items.

    ``step(state, item)`` returns the next state, with the same names, and an array of ``kind`` to add; ``last(state)`` an
    array to add in the end. Growing one array item by item would copy it each time, so items are taken in blocks of
    blocks, and each is copied a bounded number of times on every level.
    """
    none = F.array().cast(kind)
    struct = lambda values, out: F.struct(*[v.alias(n) for n, v in values.items()], out.alias("out"))
    only = lambda s: {n: s[n] for n in state}

    def cut(r: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / size).cast("int")), lambda b: F.slice(r, b * size + 1, F.lit(size)))

    def add(s: Column, x: Column) -> Column:
        after, made = step(s, x)
        return struct(after, F.concat(s["out"], made))

    def fold(r: Column, start: dict[str, Column], level: int) -> Column:
        if not level:
            return F.aggregate(r, struct(start, none), add)
        joined = lambda s, x: bound(fold(x, only(s), level - 1), lambda d: struct(only(d), F.concat(s["out"], d["out"])))
        return F.aggregate(cut(r, BLOCK**level), struct(start, none), joined)

    def whole(r: Column) -> Column:
        few = F.when(F.size(r) > BLOCK, fold(r, state, LEVELS - 1)).otherwise(fold(r, state, 0))
        return bound(few, lambda d: F.concat(d["out"], last(only(d)))) if last else few["out"]

    return bound(items, lambda r: F.when(F.size(r) > 0, whole(r)).otherwise(last(state) if last else none))


def find_spans(
    text: Column, pattern: str, keep: Callable[[Column, Column], Column] | None = None, *, group: int = 0, before: int = 0
) -> Column:
    """All leftmost non-overlapping matches as structs: start and stop (code points, stop exclusive), the match, and up to
    ``before`` code points of the text in front of it, other matches among them.

    ``keep(match, group)`` drops matches afterwards; their text is not searched again. The pattern must never match the
    empty string. Java splits a text at just the matches that it extracts, so the lengths of what lies between them and of
    the matches give their places.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("g"), inner.alias("v")), lambda x: x["m"].isNotNull())

    def tail(front: Column, back: Column) -> Column:
        return F.substring(F.concat(front, F.substring(back, -before, before)), -before, before) if before else F.lit("")

    none = F.array().cast(SPAN)

    def step(state: Column, x: Column) -> tuple[dict[str, Column], Column]:
        start = state["at"] + F.char_length(x["g"])
        stop = start + F.char_length(x["m"])
        left = tail(state["tail"], x["g"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("value"), left.alias("before"))).cast(SPAN)
        made = F.when(keep(x["m"], x["v"]), span).otherwise(none) if keep else span
        return {"at": stop, "tail": tail(left, x["m"])}, made

    spans = gather(rows, {"at": F.lit(0), "tail": F.lit("")}, SPAN, step)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def spans_text(spans: Column) -> Column:
    """``kind:start:stop`` of an array of structs in its order, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
