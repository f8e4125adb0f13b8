"""Personal data and the terms that give it away, as DataFrame operations only.

Base spans (e-mail, IP, card, phone) are patterns. The method then asks which other terms disclose a protected entity: a
value, or a class it belongs to (mail domain, name part of the address, IP network, first digits of a card or phone).
Over the whole corpus and whole texts, pointwise mutual information of a term and an entity, as a share of the entity's
own information, says how much of it the term reveals: a term that (almost) only occurs with one entity reveals all of
it. Terms beyond the upper threshold are removed from the documents that hold the entity, terms beyond the lower one are
generalised. Exact copies of a text count as one text, so a copied document does not look like evidence.

Chance gives such shares too: each rare word of a single text goes with that text's values alone. One common text
proposes a pair, the others must confirm it: their information together has to exceed that of choosing one of all the
words beside the entity. A term that is itself a name part of an address in the text needs no such evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacloud.llm.common import written
from stratacloud.llm.spans import SPAN, digits, in_order, spans

KINDS = ["email", "ip", "card", "phone"]
TERM_KINDS = ["term", "hint"]       # removed, generalised
#: The base patterns. A match may begin only where a run of its first characters begins, or where the
#: match before it ended, and never gives characters back: the same matches, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
REMOVE, GENERALISE = 0.9, 0.75
TERM = r"(?<![\p{L}\p{N}])(\p{L}{3,}+)(?!\p{N})"       # a whole word, as it is looked for when texts are sanitised
PREFIX = 6              # first digits of a card (its issuer) or phone (country and area)
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "hint": "[WORD]"}


def _luhn(number: Column) -> Column:
    """Luhn check of a string of digits: from the right, every second digit doubled, less 9 if above 9."""
    back = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    each = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base spans of a text in order; part holds the value in one spelling (lower case, digits only)."""
    def kept(column: str, kind: str, pattern: str, gate: Column, valid, plain) -> Column:
        found = F.when(gate, spans(text, kind, F.lit(pattern)))
        found = F.transform(F.filter(found, valid), lambda s: s.withField("part", plain(s["value"])))
        return F.coalesce(found, F.array().cast(f"array<{SPAN}>"))

    email = kept("email", "email", EMAIL, text.contains("@"), lambda s: F.lit(True), F.lower)
    ip = kept("ip", "ip", IP, text.rlike(IP), lambda s: s["value"].rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"), lambda v: v)
    card = kept("card", "card", CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
                lambda s: F.when(F.length(digits(s["value"])).between(14, 19), _luhn(digits(s["value"]))).otherwise(F.lit(False)), digits)
    phone = kept("phone", "phone", PHONE, text.contains("+"), lambda s: F.length(digits(s["value"])).between(10, 15), digits)
    return in_order(F.concat(email, ip, card, phone), KINDS)


def marked(docs: DataFrame) -> DataFrame:
    """docs with _text (null: empty), _tkey (hash of the text) and _base (base spans)."""
    return (docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_tkey", F.xxhash64("_text"))
            .withColumn("_base", base_spans(F.col("_text"))))


def entities(base: Column) -> Column:
    """The protected entities of base spans: their values and the classes these belong to, each once."""
    def of(span: Column) -> Column:
        part, kind = span["part"], span["kind"]
        named = lambda prefix, value: F.concat(F.lit(prefix), value)
        value = F.concat(kind, F.lit(":"), part)
        names = F.transform(F.regexp_extract_all(F.substring_index(part, "@", 1), F.lit("([a-z]{3,}+)"), F.lit(1)), lambda n: named("name:", n))
        return (F.when(kind == "email", F.concat(F.array(value, named("domain:", F.substring_index(part, "@", -1))), names))
                .when(kind == "ip", F.array(value, named("net:", F.substring_index(part, ".", 3))))
                .when(kind == "card", F.array(value, named("issuer:", F.left(part, F.lit(PREFIX)))))
                .otherwise(F.array(value, named("dial:", F.left(part, F.lit(PREFIX))))))

    return F.array_distinct(F.flatten(F.transform(base, of)))


def occurring(rows: DataFrame) -> DataFrame:
    """Of marked rows, one for each different text: _tkey, _entities, and _terms, the distinct words outside addresses,
    joined by spaces: as a list each word would take 16 bytes more where texts are shuffled."""
    # the other kinds of base spans hold no letters
    plain = F.when(F.col("_text").contains("@"), F.regexp_replace("_text", EMAIL, " ")).otherwise(F.col("_text"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(1)))
    return rows.select("_tkey", entities(F.col("_base")).alias("_entities"), F.array_join(words, " ").alias("_terms")).dropDuplicates(["_tkey"])


def _listed(terms: str = "_terms") -> Column:
    """The words of a joined list."""
    return F.filter(F.split(terms, " "), lambda t: t != "")


def disclosing_terms(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Terms that disclose an entity: value, term, action (term or hint), share (of the entity's information), support.

    texts gives, per different text of docs, _tkey, _entities and _terms (occurring), if they are at hand."""
    texts = texts if texts is not None else written(occurring(marked(docs)), "texts")
    held = texts.filter(F.size("_entities") > 0)
    terms = texts.select(F.explode(_listed()).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    total = texts.agg(F.count("*").alias("n"))      # one row
    own = F.log2(F.col("n") / F.col("with_value"))
    of_name = F.col("value") == F.concat(F.lit("name:"), F.col("term"))
    values = (held.select(F.size(_listed()).alias("words"), F.explode("_entities").alias("value")).groupBy("value")
              .agg(F.count("*").alias("with_value"), F.log2(F.sum("words")).alias("needed")))
    values = written(values, "values")
    # a term's support is at most with_value and its bits at most own: where these are too little, none need be counted
    able = values.crossJoin(F.broadcast(total)).filter((F.col("with_value") - 1) * own > F.col("needed")).select("value")
    counted = (held.select("_terms", F.explode("_entities").alias("value")).join(able, "value", "left_semi")
               .select("value", F.explode(_listed()).alias("term")))
    named = F.array_intersect(F.transform(_listed(), lambda t: F.concat(F.lit("name:"), t)), F.col("_entities"))
    names = held.select(F.explode(named).alias("value")).join(able, "value", "left_anti").select("value", F.substring_index("value", ":", -1).alias("term"))
    # partial counts by pair: no task meets all texts of a common entity or term
    pairs = counted.unionByName(names).groupBy("value", "term").agg(F.count("*").alias("support"))
    # without a second common text nothing is confirmed
    pairs = pairs.filter((F.col("support") > 1) | of_name)
    scored = pairs.join(terms, "term").join(values, "value").crossJoin(F.broadcast(total))
    bits = F.log2(F.col("n") * F.col("support") / (F.col("with_term") * F.col("with_value")))
    return (scored.filter(own > 0).filter(of_name | ((F.col("support") - 1) * bits > F.col("needed")))
            .select("value", "term", (bits / own).alias("share"), "support").filter(F.col("share") >= GENERALISE)
            .withColumn("action", F.when(F.col("share") >= REMOVE, "term").otherwise("hint")))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs (text) with base (base spans), found (base and term spans in order) and sanitised (the text with every span
    replaced by a mask) added; columns of these names are replaced.

    Null text counts as empty and has no spans; its sanitised text is null. Terms are whole words (letters and digits
    around them end a match), in any case. A term that overlaps a base span keeps it: the base span alone is masked.
    Repeated rows get equal answers, an empty table gives no rows."""
    columns = [c for c in docs.columns if c not in ("base", "found", "sanitised")]
    rows = marked(docs)
    texts = written(occurring(rows), "texts")
    # one row per entity; the texts of a common entity meet it in a join, which adaptive execution can split
    terms = written(disclosing_terms(docs, texts).groupBy("value")
                    .agg(*[F.collect_list(F.when(F.col("action") == a, F.col("term"))).alias(f"_{a}") for a in TERM_KINDS]), "terms")
    per_text = texts.filter(F.size("_entities") > 0).select("_tkey", "_terms", F.explode("_entities").alias("value")).join(terms, "value")
    per_text = (per_text.select("_tkey", *[F.array_intersect(_listed(), f"_{a}").alias(f"_{a}") for a in TERM_KINDS])
                .groupBy("_tkey").agg(*[F.array_distinct(F.flatten(F.collect_list(f"_{a}"))).alias(f"_{a}") for a in TERM_KINDS]))
    # a word that one entity has removed is not generalised for another
    per_text = per_text.withColumn("_hint", F.array_except("_hint", "_term")).filter((F.size("_term") > 0) | (F.size("_hint") > 0))
    per_text = per_text.select("_tkey", *[F.array_join(F.transform(F.array_sort(f"_{a}"), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|").alias(f"_{a}")
                                          for a in TERM_KINDS])
    per_text = written(per_text, "text-terms")
    # only texts with base spans can have terms: the others are read again and stay where they are
    bare = rows.where(F.size("_base") == 0).withColumns({f"_{a}": F.lit(None).cast("string") for a in TERM_KINDS})
    rows = rows.where(F.size("_base") > 0).join(per_text, "_tkey", "left").unionByName(bare)
    none = F.array().cast(f"array<{SPAN}>")

    def word_spans(action: str) -> Column:
        listed = F.col(f"_{action}")
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), listed, F.lit(r")(?![\p{L}\p{N}])"))
        return F.when(F.coalesce(F.length(listed), F.lit(0)) > 0, spans(F.col("_text"), action, pattern)).otherwise(none)

    clear = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    extra = F.filter(F.concat(*[word_spans(a) for a in TERM_KINDS]), clear)
    extra = F.when(F.col("_term").isNotNull(), extra).otherwise(none)
    rows = rows.withColumn("_found", in_order(F.concat("_base", extra), KINDS + TERM_KINDS))
    return rows.select(*columns, F.col("_base").alias("base"), F.col("_found").alias("found"),
                       F.when(F.col("text").isNotNull(), _masked()).alias("sanitised"))


def _masked() -> Column:
    """_text with the spans of _found replaced; where spans of different kinds overlap, the first covers the other."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def add(state: Column, span: Column) -> Column:
        gap = F.substring(F.col("_text"), state["at"].cast("int") + 1, F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        mask = F.element_at(F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair]), span["kind"])
        covered = span["end"] <= state["at"]
        return F.when(covered, state).otherwise(F.struct(F.greatest(state["at"], span["end"]).alias("at"),
                                                         F.concat(state["done"], gap, F.when(span["start"] < state["at"], F.lit("")).otherwise(mask)).alias("done")))

    whole = F.aggregate("_found", start, add,
                        lambda s: F.concat(s["done"], F.substring(F.col("_text"), s["at"].cast("int") + 1, F.length("_text"))))
    return F.when(F.size("_found") == 0, F.col("_text")).otherwise(whole)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with their text sanitised; all columns and rows stay."""
    row = F.struct(*[F.col(c).alias(c) for c in docs.columns])
    found = find_personal_data(docs.select("text", row.alias("_row")))
    return found.select(*[F.col("sanitised").alias(c) if c == "text" else F.col(f"_row.{c}").alias(c) for c in docs.columns])
