"""Secrets in texts: patterns that stand alone, and credentials that only show by their parts together.

Strong patterns (assignments to secret names, access keys, long hex) are the base spans. Weak candidates (long tokens of
mixed letters and digits, user or client names, hosts and URLs) mean nothing alone. A credential has parts that
complement each other: an identifier, a secret, an endpoint. Parts become intervals, widened by a reach, and an interval
join inside a scope (a paragraph of a text) links those of different roles; a weak candidate is reported only where
parts of another role are near, of which one is a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.llm.common import written
from stratacloud.llm.spans import SPAN, in_order, spans

KINDS = ["assign", "access", "hex"]
WEAK_KINDS = ["ident", "endpoint", "token"]
#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"       # with fewer characters after AKIA the whole run is too short
HEX = r"[0-9a-f]{16,}"
#: Weak candidates of this library.
IDENT = r"(?i)(?:user(?:name)?|login|client_?id|account|access_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})"
ENDPOINT = r"(?i)(?:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{3,}|(?:host(?:name)?|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}(?::[0-9]{1,5})?)"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,40}[0-9])(?=[a-z0-9+/_-]{0,40}[A-Z])[A-Za-z0-9+/_-]{20,}"
ROLE = {"assign": "secret", "hex": "secret", "token": "secret", "access": "identifier", "ident": "identifier", "endpoint": "endpoint"}
REACH = 400     # code points between parts of one credential, at most


def base_spans(text: Column) -> Column:
    assign = F.filter(spans(text, "assign", F.lit(ASSIGN), 2), lambda s: F.length(s["part"]) >= 12)
    return in_order(F.concat(assign, spans(text, "access", F.lit(ACCESS)), spans(text, "hex", F.lit(HEX))), KINDS)


def weak_spans(text: Column) -> Column:
    return F.concat(spans(text, "ident", F.lit(IDENT)), spans(text, "endpoint", F.lit(ENDPOINT)), spans(text, "token", F.lit(TOKEN)))


def _paragraphs(text: Column) -> Column:
    """Where the blank lines of a text stand."""
    return F.transform(spans(text, "gap", F.lit(r"\n[ \t\r]*\n\s*")), lambda s: s["start"])


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Of parts (scope columns _tkey, _scope; kind, role, start, end) those with a part of another role within reach, of
    which one is a secret.

    The interval join needs no pairs: inside a scope, in order of start, the last end seen so far and the next start of
    each role bound the gap to the nearest part of that role. Scopes are split into stretches of 64 reaches with an
    overlap of one, so no window holds more than one stretch of one text."""
    width = 64 * reach
    own = F.floor(F.col("start") / width)
    spread = (parts.withColumn("_own", own)
              .withColumn("_part", F.explode(F.array_distinct(F.array(own, F.floor(F.greatest(F.col("start") - reach, F.lit(0)) / width),
                                                                      F.floor((F.col("end") + reach) / width))))))
    key = Window.partitionBy("_tkey", "_scope", "_part").orderBy("start", "end", "kind")
    before, after = key.rowsBetween(Window.unboundedPreceding, -1), key.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for role in ("secret", "identifier", "endpoint"):
        last = F.max(F.when(F.col("role") == role, F.col("end"))).over(before)
        following = F.min(F.when(F.col("role") == role, F.col("start"))).over(after)
        near[role] = F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(following - F.col("end") <= reach, F.lit(False))
    spread = spread.withColumns({f"_{r}": c for r, c in near.items()}).filter("_own = _part")
    beside = F.when(F.col("role") == "secret", F.col("_identifier") | F.col("_endpoint")).otherwise(F.col("_secret"))
    return spread.filter(beside).drop("_own", "_part", "_secret", "_identifier", "_endpoint")


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs (doc_id, text) with base (base spans) and found (base spans and linked weak candidates, in order).

    A weak candidate that overlaps a base span is not listed again. Null text counts as empty. Copies of a text are
    linked once; repeated rows get equal answers. Returns doc_id, base, found; other columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text")).withColumn("_tkey", F.xxhash64("_text"))
    rows = rows.withColumn("_base", base_spans(F.col("_text"))).withColumn("_weak", weak_spans(F.col("_text")))
    clear = F.filter("_weak", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("_weak", clear).withColumn("_gaps", F.when(F.size("_weak") > 0, _paragraphs(F.col("_text"))))
    rows = written(rows.select("doc_id", "_tkey", "_base", "_weak", "_gaps"), "secret-parts")
    parts = rows.filter(F.size("_weak") > 0).select("_tkey", "_gaps", F.explode(F.concat("_base", "_weak")).alias("s"))
    scope = F.size(F.filter("_gaps", lambda g: g <= F.col("s.start")))
    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair]), F.col("s.kind"))
    # copies of a text have equal parts: one of each goes on
    parts = (parts.select("_tkey", scope.alias("_scope"), "s.kind", role.alias("role"), "s.start", "s.end").distinct())
    weak = linked(parts, reach).filter(F.col("kind").isin(WEAK_KINDS))
    none = F.lit("")
    extra = weak.groupBy("_tkey").agg(F.collect_list(F.struct("kind", "start", "end", none.alias("value"), none.alias("part"))).alias("_extra"))
    out = rows.join(written(extra, "linked-parts"), "_tkey", "left")
    found = F.concat("_base", F.coalesce("_extra", F.array().cast(f"array<{SPAN}>")))
    return out.select("doc_id", F.col("_base").alias("base"), in_order(found, KINDS + WEAK_KINDS).alias("found"))
