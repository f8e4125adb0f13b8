"""Spans of pattern matches inside texts as column expressions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,part:string>"


def spans(text: Column, kind: str, pattern: Column, part: int = 0) -> Column:
    """Leftmost non-overlapping matches of pattern (never empty) as an array of (kind, start, end, value, part) with
    positions in code points from 0, end exclusive; part is a capture group. Text between matches gives the positions:
    the k-th match follows k pieces between matches and k - 1 matches. Null text gives an empty array."""
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = values if part == 0 else F.regexp_extract_all(text, pattern, F.lit(part))
    steps = F.zip_with(F.zip_with(values, parts, lambda v, p: F.struct(v.alias("value"), p.alias("part"))),
                       F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(values)), lambda g: F.length(g).cast("long")),
                       lambda vp, gap: F.struct(vp["value"].alias("value"), vp["part"].alias("part"), gap.alias("gap")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        end = begin + F.length(step["value"])
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(F.struct(
            F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), step["value"].alias("value"), step["part"].alias("part")))).alias("found"))

    found = F.aggregate(steps, start, add, lambda s: s["found"])
    none = F.array().cast(f"array<{SPAN}>")
    return F.coalesce(F.when(F.size(values) > 0, found).otherwise(none), none)


def in_order(found: Column, kinds: list[str]) -> Column:
    """Spans by start, then by place of their kind in kinds, then by end."""
    ranked = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.lit(kinds), s["kind"]).alias("rank"),
                                                   s["end"].alias("end"), s.alias("span")))
    return F.transform(F.array_sort(ranked), lambda r: r["span"])


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")
