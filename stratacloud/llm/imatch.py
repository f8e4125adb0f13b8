"""I-Match document fingerprints with randomised lexicon subsets, as DataFrame operations only.

The lexicon holds the terms whose inverse document frequency lies in a band: common enough to be no typing error, rare
enough to tell documents apart. A document keeps its distinct lexicon terms; each of several random subsets of the
lexicon selects some of them, which are sorted and hashed. An edit changes only those hashes whose subset holds a
changed term. The subsets come in levels, each half as dense as the one before; subsets of a level share no term, but
for the densest levels. A document uses the two levels next to where a subset keeps about one or two of its terms: long
and short documents alike have many subsets an edit spares.

Document frequencies count different texts, not rows: copies of a text make none of its terms common. A text with fewer
than FEW lexicon terms is filled up to FEW with others of its terms: first those rarer than the band, then the common
ones, the rarest first. Frequencies beyond the band are not kept, so the rarer terms are taken by hash, which an edit
elsewhere does not change.

A lexicon of terms in at least one of 2**HIGH documents has at most 2**HIGH times as many terms as a document has on
average, however large the corpus: it is broadcast as one row, an array of small arrays by hash; so are the terms more
common than the band, of which there are still fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.llm.common import written

LOW, HIGH = 3.0, 9.0       # the band of inverse document frequency, in bits
SUBSETS = 16                # random subsets of a level
KEPT = 1                    # terms of a document that a subset keeps, about
FEW = 8                     # terms a text is known by, at least, if it has so many
LEVELS = 24
SLOTS = 1 << 14
NONE = "-"                  # the hash of no term


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's terms (runs of letters and digits, lower case)."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row with the terms whose idf over the different texts of docs is at most high, as SLOTS arrays each by the low
    bits of their hash: _band (hashes of terms in the band) and _common (hash, and excess: by how many bits too common)."""
    text = F.coalesce("text", F.lit(""))
    # copies meet already where they are read: a text's terms are moved once from each part of the table, and not written
    each = docs.select(F.xxhash64(text).alias("key"), terms(text).alias("terms")).dropDuplicates(["key"])
    total = docs.agg(F.count_distinct(F.xxhash64(text)).alias("n"))
    counted = each.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log2(F.col("n") / F.col("df"))
    band = counted.crossJoin(F.broadcast(total)).filter(idf <= high)     # one row
    band = band.select("term", F.greatest(F.lit(low) - idf, F.lit(0.0)).cast("float").alias("excess"))
    slots = band.groupBy(_slot(F.col("term")).alias("slot")).agg(
        F.array_sort(F.collect_list(F.when(F.col("excess") == 0, F.col("term")))).alias("band"),
        F.array_sort(F.collect_list(F.when(F.col("excess") > 0, F.struct("term", "excess")))).alias("common"))
    every = docs.sparkSession.range(SLOTS).withColumn("slot", F.col("id").cast("int")).join(slots, "slot", "left")
    held = F.struct("slot", F.coalesce("band", F.array().cast("array<bigint>")).alias("band"),
                    F.coalesce("common", F.array().cast("array<struct<term:bigint,excess:float>>")).alias("common"))
    # SLOTS small rows become one
    row = every.agg(F.array_sort(F.collect_list(held)).alias("all"))
    return written(row.select(F.col("all.band").alias("_band"), F.col("all.common").alias("_common")), "lexicon")


def _slot(term: Column) -> Column:
    return term.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _draw(term: Column, mask: Column) -> Column:
    """A term's lot among mask + 1 equally likely ones: bits of its hash that neither its slot nor its rank rests on."""
    return F.shiftrightunsigned(term, 24).bitwiseAND(mask)


def with_prints(rows: DataFrame, book: DataFrame, text: str, name: str) -> DataFrame:
    """rows with name added: the prints of column text, an array of (level, hashes), and no lexicon left behind.

    At level n a subset holds one lexicon term in 2**n. From SUBSETS lots on a term draws one lot and belongs to the
    subset of that number, if there is one; at lower levels each subset draws by itself."""
    def ranked(t: Column) -> Column:
        excess = F.get(F.filter(F.get("_common", _slot(t)), lambda h: h["term"] == t), F.lit(0))["excess"]
        rank = F.when(F.array_contains(F.get("_band", _slot(t)), t), F.lit(0)).when(excess.isNull(), F.lit(1)).otherwise(F.lit(2))
        return F.struct(rank.alias("rank"), F.coalesce(excess, F.lit(0).cast("float")).alias("excess"), t.alias("term"))

    rows = rows.crossJoin(F.broadcast(book)).withColumn("_terms", terms(F.col(text)))      # one row
    rows = rows.withColumn("_held", F.filter("_terms", lambda t: F.array_contains(F.get("_band", _slot(t)), t)))
    filled = F.transform(F.slice(F.array_sort(F.transform("_terms", ranked)), 1, FEW), lambda r: r["term"])
    rows = rows.withColumn("_kept", F.array_sort(F.when(F.size("_held") >= FEW, F.col("_held")).otherwise(filled)))
    rows = rows.drop("_band", "_common", "_terms", "_held")
    size = F.greatest(F.size("_kept"), F.lit(1))
    rows = rows.withColumn("_level", F.least(F.greatest(F.floor(F.log2(size / KEPT)), F.lit(0)), F.lit(LEVELS)).cast("int"))
    lots = [F.expr(f"shiftleft(1L, _level + {k})") for k in (0, 1)]
    rows = rows.withColumns({f"_mask{k}": n - 1 for k, n in enumerate(lots)})
    drawn = lambda mask: F.filter("_kept", lambda t: _draw(t, mask) < SUBSETS)
    rows = rows.withColumns({f"_drawn{k}": drawn(F.col(f"_mask{k}")) for k in (0, 1)})

    def hashes(k: int) -> Column:
        mask = F.col(f"_mask{k}")

        def subset(number: Column) -> Column:
            mine = F.when(mask + 1 >= SUBSETS, F.filter(f"_drawn{k}", lambda t: _draw(t, mask) == number)).otherwise(
                F.filter("_kept", lambda t: F.xxhash64(t, number).bitwiseAND(mask) == 0))
            return F.transform(F.array(mine), lambda m: F.when(F.size(m) == 0, F.lit(NONE)).otherwise(F.hex(F.xxhash64(m))))

        numbers = F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long"))
        return F.struct((F.col("_level") + k).alias("level"), F.flatten(F.transform(numbers, subset)).alias("hashes"))

    # a text without any term has only itself to be known by
    alone = F.array(F.struct(F.lit(-1).alias("level"), F.array(F.sha2(F.col(text), 256)).alias("hashes")))
    both = F.when(F.size("_kept") == 0, alone).otherwise(F.array(hashes(0), hashes(1)))
    return rows.withColumn(name, both).drop("_kept", "_level", "_mask0", "_mask1", "_drawn0", "_drawn1")


def as_text(prints: Column) -> Column:
    """level:hash,hash,...;level:hash,hash,..."""
    return F.array_join(F.transform(prints, lambda p: F.concat(p["level"].cast("string"), F.lit(":"), F.array_join(p["hashes"], ","))), ";")


def likeness(one: Column, other: Column) -> Column:
    """Share of equal hashes at a level both have, among subsets where either has terms; the better of two levels."""
    def rate(a: Column, b: Column) -> Column:
        each = F.zip_with(a["hashes"], b["hashes"], lambda x, y: F.when((x == NONE) & (y == NONE), F.lit(0)).when(x == y, F.lit(2)).otherwise(F.lit(1)))
        used = F.size(F.filter(each, lambda e: e > 0))
        return F.when(used > 0, F.size(F.filter(each, lambda e: e == 2)) / used).otherwise(F.lit(0.0))

    pairs = F.flatten(F.transform(one, lambda a: F.transform(F.filter(other, lambda b: b["level"] == a["level"]), lambda b: rate(a, b))))
    return F.when(one == other, F.lit(1.0)).otherwise(F.coalesce(F.array_max(pairs), F.lit(0.0)))


def _bucket(order: Column, bounds: Column) -> Column:
    """Number of bounds below order, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(bounds, middle) < order
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.when(below, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi")))
                                                       .otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi"))))

    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve, lambda s: s["lo"]), F.lit(0))


def with_next(rows: DataFrame, prints_of, buckets: int) -> DataFrame:
    """rows (doc_id, text) with their prints and next_text and next_prints, those of the row after it by doc_id and text;
    after the last comes the first. prints_of gives prints to rows that have text; only texts are moved, not prints.

    Rows are cut into buckets of doc_id at quantiles; each row finds its successor inside its bucket, and a bucket's
    last row takes the first row of the bucket after it. Only one slim row per bucket meets in one task."""
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = rows.select("doc_id").agg(F.array_distinct(F.coalesce(F.percentile_approx("doc_id", cuts, 10_000), F.array().cast("array<bigint>"))).alias("_bounds"))
    bounds = written(bounds, "bounds")
    # one row
    placed = rows.crossJoin(F.broadcast(bounds)).withColumn("_bucket", _bucket(F.col("doc_id"), F.col("_bounds"))).drop("_bounds")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text")
    heads = (placed.select("_bucket", first.alias("_first")).groupBy("_bucket").agg(F.min("_first").alias("_first"))
             .select("_bucket", "_first.doc_id", "_first.text"))
    heads = written(heads, "heads")
    slim = Window.orderBy("_bucket")
    after = heads.select("_bucket", F.coalesce(F.lead("_bucket").over(slim), F.min("_bucket").over(Window.partitionBy())).alias("_after"))
    heads = prints_of(heads.withColumnRenamed("_bucket", "_after")).select("_after", F.struct("text", "prints").alias("_head"))
    heads = after.join(heads, "_after").select("_bucket", "_head")
    inside = Window.partitionBy("_bucket").orderBy(*order)
    led = prints_of(placed.repartition("_bucket")).withColumn("_next", F.lead(F.struct("text", "prints")).over(inside))
    return (led.join(heads, "_bucket", "left").withColumn("_next", F.coalesce("_next", "_head"))
            .select("doc_id", "text", "prints", F.col("_next.text").alias("next_text"), F.col("_next.prints").alias("next_prints")))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts, the last quarter replaced by the start of the next
    document's text: doc_id, n_chars, text, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty. The next document is the next row by doc_id (null first) and text; the last row's is the
    first row, and a lone row's is itself. Rows with equal texts have equal fingerprints. Other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    book = lexicon(rows, low, high)
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints_of = lambda part: with_prints(part, book, "text", "prints")
    rows = with_next(rows, prints_of, buckets)
    cut = F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 4)))"), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = with_prints(rows, book, "edited", "edited_prints")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", "edited", as_text(F.col("prints")).alias("fingerprint"),
                       as_text(F.col("edited_prints")).alias("edited_fingerprint"), likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
                       likeness(F.col("prints"), F.col("next_prints")).alias("near_next"))
