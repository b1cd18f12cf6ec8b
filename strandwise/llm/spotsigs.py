"""Document fingerprints from spot signatures, with DataFrame functions only.

Wherever a common word (an anchor) stands, it and the ``CHAIN`` content words
that follow form a signature. A text's fingerprint is its set of signatures,
named by set size and a 128-bit digest; likeness of fingerprints is the Jaccard
share of their sets. A text without such signatures is anchored at every word
instead, and one of fewer than ``CHAIN`` words is one signature of its whole,
so different texts do not meet in an empty set.

``near_pairs`` joins fingerprints at a threshold: sets are partitioned by
length, as sets of too different lengths can't be alike, and meet only over
the few smallest signatures of which alike sets must share one; what meets is
compared, with the lengths and positions as bounds first.

Null texts are empty; two empty texts are alike (1.0). Rows that repeat an id
follow one another in the order of their texts; null ids come after
all others. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

CHAIN = 2
ROWS_IN_GROUP = 256
COARSE = 4096
#: Anchors: common words of the corpus languages.
ANCHORS = tuple(
    sorted(
        set(
            "a an the is was are were be been of and to in for on that this it with as by at from or not "
            "der die das den dem ein eine einer ist war und zu von mit auf im für nicht sich des auch "
            "le la les un une est et des du de que qui dans en pour par sur il au aux pas "
            "el los las una es y del al por con para se lo su como más no".split()
        )
    )
)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signature hashes of a text (array of long)."""
    lower = F.lower(text)

    def anchored(words):
        is_anchor = lambda w: w.isin(*ANCHORS)
        places = F.filter(F.transform(words, lambda w, i: F.when(is_anchor(w), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        content = F.filter(words, lambda w: ~is_anchor(w))
        return F.struct(words.alias("words"), places.alias("places"), content.alias("content"))

    def chains(s):
        # the k-th anchor, at word i, has i - k content words before it
        whole = F.filter(s["places"], lambda i, k: i - k + chain <= F.size(s["content"]))
        return F.transform(whole, lambda i, k: F.xxhash64(F.get(s["words"], i), *(F.get(s["content"], i - k + j) for j in range(chain))))

    def dense(s):
        n = F.size(s["words"]) - chain + 1
        every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(F.lit("*"), *(F.get(s["words"], i + j) for j in range(chain))))
        return F.when(n >= 1, every).otherwise(F.array(F.xxhash64(F.lit("="), F.array_join(s["words"], " "), lower)))

    def pick(s):
        return let(chains(s), lambda got: F.when(F.size(got) > 0, got).otherwise(dense(s)))

    words = F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(let(words, lambda ws: let(anchored(ws), pick))))


def digest(signs: Column) -> Column:
    """Set size and 128 bits of digest in hex."""
    part = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), signs))), 16, "0")
    return F.concat(F.size(signs).cast("string"), F.lit("-"), part(1), part(2))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard share of two sets."""
    return let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def following(ids: DataFrame, alone: int = 50_000, width: int = 4096) -> DataFrame:
    """g, next_g: the next smaller of the distinct values ``g``; after the smallest comes the largest.

    Values are ordered within ranges of ``width``; the ranges are ordered the
    same way, until few enough are left for one task.
    """
    ids = cut(ids.select("g").distinct())
    least, most, n = ids.agg(F.min("g"), F.max("g"), F.count("g")).first()
    if n <= alone or most - least < width:
        w = Window.orderBy(F.desc("g"))
        return ids.select("g", F.coalesce(F.lead("g").over(w), F.lit(most)).alias("next_g"))
    step = max(2, (most - least) // max(1, n // width))
    ids = ids.withColumn("h", F.expr(f"(g - {least}) div {step}"))
    tops = ids.groupBy("h").agg(F.max("g").alias("top"))
    after = following(tops.select(F.col("h").alias("g")), alone, width).withColumnsRenamed({"g": "h", "next_g": "next_h"})
    after = after.join(tops.withColumnRenamed("h", "next_h"), "next_h").select("h", "top")
    inside = ids.withColumn("next_g", F.lead("g").over(Window.partitionBy("h").orderBy(F.desc("g"))))
    return inside.join(after, "h").select("g", F.coalesce("next_g", "top").alias("next_g"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text, g: ranges of ids with about ROWS_IN_GROUP rows each, numbered in the order of ids.

    The span of all ids is cut into COARSE ranges, and each of those evenly
    between its own least and largest id, so ids that stand in clusters far
    apart spread as well. The table of ranges that is broadcast has COARSE + 2
    rows at most.
    """
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = ((most or 0) - (least or 0)) // COARSE + 1
    h = F.expr(f"doc_id div {step}L")
    ranges = docs.where("doc_id is not null").groupBy(h.alias("h")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    first = (least or 0) // step - 1
    ranges = ranges.select("h", "lo", F.expr(f"greatest((hi - lo + 1) * {ROWS_IN_GROUP}L div n, 1L)").alias("width"), ((F.col("h") - F.lit(first)) * F.lit(1 << 40)).alias("base"))
    placed = docs.withColumn("h", h).join(F.broadcast(ranges), "h", "left")
    return placed.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.expr("base + (doc_id - lo) div width"), F.lit(-1)).alias("g"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each row with the next in descending order of ids.

    Texts are shuffled once, by ranges of ids; only the last row of a range
    takes its next from another. All three branches read the same exchange.
    """
    flat = grouped(docs)
    groups = following(flat.select("g"))
    w = Window.partitionBy("g").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    dealt = flat.repartition("g").withColumns({"_next": F.lead("text").over(w), "_before": F.lag(F.lit(True)).over(w)})
    last = dealt.where(F.col("_next").isNull()).drop("_next", "_before").join(groups, "g")
    first = dealt.where(F.col("_before").isNull()).select(F.col("g").alias("next_g"), F.col("text").alias("next_text"))
    inner = dealt.where(F.col("_next").isNotNull()).select("doc_id", "text", F.col("_next").alias("next_text"))
    return inner.unionByName(last.join(first, "next_g").select("doc_id", "text", "next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row: fingerprints of the text and of its edited text, and likenesses."""
    rows = with_next(docs.select("doc_id", "text"))
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), signatures(F.col("text")).alias("signs"), signatures(F.col("next_text")).alias("next_signs"))
    rows = rows.withColumn("edited_signs", signatures(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest(F.col("signs")).alias("fingerprint"), digest(F.col("edited_signs")).alias("edited_fingerprint"), likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): class of each row, and a, b, likeness for classes at ``threshold`` or more.

    A class is the rows of one fingerprint, named by its smallest id. Sets a, b
    with size(a) <= size(b) can be alike only if size(a) >= threshold * size(b),
    and then share one of the first size - ceil(threshold * size) + 1
    signatures in the order of their hashes. Lengths are cut into ranges that
    grow by 1 / threshold, so a set meets its own and the next range only.
    """
    rows = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("signs")).withColumn("print", digest(F.col("signs")))
    rows = cut(rows)
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("class"), F.min("signs").alias("signs"))
    members = rows.join(classes.select("print", "class"), "print").select("doc_id", "class")
    size = F.size("signs")
    band = F.floor(F.log(size) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    prefix = F.slice("signs", F.lit(1), (size - F.ceil(size * threshold) + 1).cast("int"))
    sets = classes.select("class", "signs", size.alias("size"), band.alias("band"), F.posexplode(prefix).alias("place", "sign"))
    a = sets.select(*(F.col(c).alias(f"a_{c}") for c in sets.columns), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("sign"))
    b = sets.select(*(F.col(c).alias(f"b_{c}") for c in sets.columns), "band", "sign")
    met = a.join(b, ["band", "sign"]).where("a_size < b_size or a_size = b_size and a_class < b_class")
    # bounds before the sets are compared: lengths, then what can follow the shared place
    need = (F.col("a_size") + F.col("b_size")) * F.lit(threshold / (1 + threshold))
    met = met.where((F.col("a_size") >= threshold * F.col("b_size") - 1e-9) & (F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place")) + F.least("a_place", "b_place") >= need - 1e-9))
    # a pair meets at several signatures; it counts at the first that both have
    met = met.where(F.get(F.array_intersect("a_signs", "b_signs"), F.lit(0)) == F.col("sign"))
    pairs = met.select(F.col("a_class").alias("a"), F.col("b_class").alias("b"), likeness(F.col("a_signs"), F.col("b_signs")).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= threshold - 1e-12)


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
