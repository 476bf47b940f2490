"""Places of regular expressions in texts, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start and end in code points (end exclusive), the match, one of its groups, and what stands
#: next to it: at most NEAR code points before (the match before included) and behind (up to the next match).
FOUND = "array<struct<start:long,end:long,text:string,part:string,before:string,after:string>>"
NEAR = 32
#: Elements of an array that are worked on at once. Arrays don't grow in place: appending to one
#: is quadratic, so that it is only done within such a block and over the number of blocks.
STEP = 256


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: what a lambda holds of an outer expression is computed
    anew for each element, but its own variable isn't."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blocks(values: Column) -> Column:
    """An array cut into arrays of STEP elements; values should be a variable or a column."""
    last = F.floor((F.size(values) - 1) / STEP).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * STEP + 1, F.lit(STEP)))).otherwise(F.array(values))


def _append(zero: Column, add: Callable[[Column, Column], Column]):
    def of(values: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    return of


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs, add over those before it, from 0; in linear time."""

    def over(parts: Column) -> Column:
        zero = F.lit(0).cast("long")
        before = _append(zero, add)(F.transform(parts, lambda part: F.aggregate(part, zero, add)))
        return F.flatten(F.zip_with(parts, before, lambda part, at: _append(at, add)(part)))

    return bind(values, lambda v: bind(blocks(v), over))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a Java regular expression that never matches nothing.

    The text is split at the matches; lengths of what lies between and of the matches add up to
    their places, in time linear in the text. Texts without a match cost one search."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def placed(x: Column) -> Column:
        gaps, found = x["between"], x["found"]
        widths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda b, m: (F.length(b) + F.length(m)).cast("long"))
        parts = F.arrays_zip(running(widths, lambda a, b: a + b).alias("at"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), F.slice(gaps, F.lit(2), F.size(found)).alias("next"), found.alias("m"), x["part"].alias("g"), F.concat(F.array(F.lit("")), found).alias("last"))
        return F.transform(F.filter(parts, lambda p: p["m"].isNotNull()), _span)

    whole = bind(F.struct(between.alias("between"), found.alias("found"), part.alias("part")), placed)
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast(FOUND))


def _span(p: Column) -> Column:
    begin = p["at"] + F.length(p["gap"])
    close = F.when(F.length(p["gap"]) < NEAR, F.concat(p["last"], p["gap"])).otherwise(p["gap"])
    return F.struct(begin.alias("start"), (begin + F.length(p["m"])).alias("end"), p["m"].alias("text"), p["g"].alias("part"), F.substring(close, -NEAR, NEAR).alias("before"), F.substring(p["next"], 1, NEAR).alias("after"))


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of spans (structs with kind, start, end) by start, then kind as listed in
    kinds (others behind, by name), then end; comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    rank = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.coalesce(F.nullif(F.array_position(names, x["kind"]), F.lit(0)), F.lit(len(kinds) + 1).cast("long")).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(rank), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def apart(spans: Column, base: Column) -> Column:
    """The spans (structs with start and end) that overlap none of base. One sort instead of all
    pairs: of all that start before a span, the furthest end of base tells, and so from behind."""
    shape = "array<struct<start:long,end:long,own:boolean,at:int>>"
    told = F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(False).alias("own"), F.lit(-1).alias("at"))).cast(shape), F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("own"), i.alias("at"))).cast(shape))

    def clear(x: Column) -> Column:
        # base starts sort before spans of the same start, so that a span sees them
        ahead = running(F.transform(x["order"], lambda s: F.when(s["own"], 0).otherwise(s["end"]).cast("long")), lambda a, b: F.greatest(a, b))
        far = F.lit(1 << 60).cast("long")
        behind = F.reverse(running(F.transform(F.reverse(x["order"]), lambda s: (far - F.when(s["own"], far).otherwise(s["start"])).cast("long")), lambda a, b: F.greatest(a, b)))
        free = F.filter(F.arrays_zip(x["order"].alias("s"), ahead.alias("e"), behind.alias("b")), lambda z: z["s"]["own"] & (z["e"] <= z["s"]["start"]) & (far - z["b"] >= z["s"]["end"]))
        return F.transform(F.array_sort(F.transform(free, lambda z: z["s"]["at"])), lambda i: F.get(x["spans"], i))

    some = bind(F.struct(spans.alias("spans"), F.array_sort(F.transform(told, lambda s: F.struct(s["start"].alias("start"), s["own"].alias("own"), s["end"].alias("end"), s["at"].alias("at")))).alias("order")), clear)
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(some)
