"""Set algebra over k-mer sets.

A set is a table with one column ``key`` without repeats. One shuffle brings
both sets together as (key, in_a, in_b); every relation is a filter of that
table and every size a sum over it. The single relations use the same table,
as one aggregation with map-side combine is one shuffle of 9 bytes a key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import kmers as K
from .membership import BROADCAST_KEYS

RELATIONS = {"intersection": "in_a and in_b", "union": "true", "diff_ab": "in_a and not in_b", "diff_ba": "in_b and not in_a", "xor": "in_a <> in_b"}
SIZES = (*RELATIONS, "A", "B")


def flagged(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """key, in_a, in_b. Users attach any aggregation to it."""
    both = a.select(key, F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionByName(b.select(key, F.lit(False).alias("in_a"), F.lit(True).alias("in_b")))
    return both.groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def relation(a: DataFrame, b: DataFrame, name: str, key: str = "key") -> DataFrame:
    """The keys of one relation: intersection, union, diff_ab, diff_ba or xor."""
    if name not in RELATIONS:
        raise ValueError(f"no relation {name!r}; there are {', '.join(RELATIONS)}")
    return flagged(a, b, key).where(RELATIONS[name]).select(key)


#: What a relation takes of two sets.
PARTS = {"intersection": ("both",), "union": ("both", "only_a", "only_b"), "diff_ab": ("only_a",), "diff_ba": ("only_b",), "xor": ("only_a", "only_b")}


def flagged_of(a: DataFrame, b: DataFrame, k: int, parts: tuple[str, ...] = PARTS["union"]) -> DataFrame:
    """``flagged`` of the k-mers of two tables of records; sorted blocks meet, and only the ``parts`` asked for become rows."""
    if k <= 31:
        return K.pair_flags(a, b, k, parts)
    marked = flagged(K.key_set(a, k), K.key_set(b, k))
    return marked.where(" or ".join(f"({RELATIONS[n]})" for n, x in (("intersection", "both"), ("diff_ab", "only_a"), ("diff_ba", "only_b")) if x in parts))


def relation_of(a: DataFrame, b: DataFrame, name: str, k: int) -> DataFrame:
    """The keys of one relation of the k-mers of two tables of records."""
    return flagged_of(a, b, k, PARTS[name]).select("key")


def intersection(a, b, key="key"):
    return a.select(key).join(b.select(key), key, "left_semi")


def union(a, b, key="key"):
    return a.select(key).unionByName(b.select(key)).distinct()


def difference(a, b, key="key"):
    return a.select(key).join(b.select(key), key, "left_anti")


def symmetric_difference(a, b, key="key"):
    return relation(a, b, "xor", key)


def counts(marked: DataFrame) -> DataFrame:
    """One row: both, only_a, only_b."""
    n = lambda c: F.coalesce(F.sum(F.when(F.expr(c), 1).otherwise(0)), F.lit(0)).cast("long")
    return marked.agg(n("in_a and in_b").alias("both"), n("in_a and not in_b").alias("only_a"), n("in_b and not in_a").alias("only_b"))


def common_of(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """key: k-mers that two tables of records share; the larger one is filtered where it is read if ``b`` has few."""
    own = K.collected(b, k, BROADCAST_KEYS) if k <= 31 else None
    if own is None:
        return relation_of(a, b, "intersection", k)
    return K.code_set(a, k, only=own).select(F.col("code").alias("key"))


def difference_of(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """key: k-mers of records ``a`` that records ``b`` lack."""
    own = K.collected(a, k, BROADCAST_KEYS) if k <= 31 else None
    if own is None:
        return relation_of(a, b, "diff_ab", k)
    return K.code_set(a, k, without=K.collected(b, k, BROADCAST_KEYS, own)).select(F.col("code").alias("key"))


def counts_of(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``counts`` of two tables of records, without a row for each key."""
    return K.pair_counts(a, b, k) if k <= 31 else counts(flagged(K.key_set(a, k), K.key_set(b, k)))


#: A relation's size from ``counts``.
SIZE = {"intersection": "both", "union": "both + only_a + only_b", "diff_ab": "only_a", "diff_ba": "only_b", "xor": "only_a + only_b"}


def size_of(a: DataFrame, b: DataFrame, name: str, k: int) -> DataFrame:
    """One row: n of a relation of two tables of records."""
    return counts_of(a, b, k).select(F.expr(SIZE[name]).alias("n"))


def sizes(marked: DataFrame) -> DataFrame:
    """relation, n: all seven sizes in the order of SIZES, from one pass; ``marked``: flagged keys, or their counts."""
    e = "stack(7, 'intersection', both, 'union', both + only_a + only_b, 'diff_ab', only_a, 'diff_ba', only_b, 'xor', only_a + only_b, 'A', both + only_a, 'B', both + only_b) as (relation, n)"
    return (marked if "both" in marked.columns else counts(marked)).selectExpr(e)


def size(a: DataFrame, b: DataFrame, name: str, key: str = "key") -> DataFrame:
    """One row: n of a relation, nothing materialized."""
    if name == "intersection":
        return intersection(a, b, key).agg(F.count("*").alias("n"))
    return relation(a, b, name, key).agg(F.count("*").alias("n"))


def overlap(marked: DataFrame) -> DataFrame:
    """One row: jaccard, and containment of either set in the other; null for empty sets."""
    c = marked if "both" in marked.columns else counts(marked)
    ratio = lambda x, y: F.try_divide(x.cast("double"), y)
    both, a, b = F.col("both"), F.col("both") + F.col("only_a"), F.col("both") + F.col("only_b")
    return c.select(ratio(both, a + b - both).alias("jaccard"), ratio(both, a).alias("containment_a"), ratio(both, b).alias("containment_b"))


@dataclass
class Request:
    """Where to write which relations (name to path), and whether sizes are wanted."""

    outputs: dict[str, str] = field(default_factory=dict)
    sizes: bool = True

    def validate(self, inputs: tuple[str, ...] = ()) -> None:
        bad = [x for x in self.outputs if x not in RELATIONS]
        if bad:
            raise ValueError(f"no such relations: {', '.join(bad)}")
        paths = [p.rstrip("/") for p in self.outputs.values()]
        if len(set(paths)) < len(paths):
            raise ValueError("two outputs have the same path")
        if set(paths) & {p.rstrip("/") for p in inputs}:
            raise ValueError("an output would overwrite an input")
        if not self.outputs and not self.sizes:
            raise ValueError("nothing is asked for")


def multi(a: DataFrame, b: DataFrame, request: Request, write, inputs: tuple[str, ...] = (), key: str = "key") -> dict[str, int]:
    """All asked relations and sizes from one shared table; ``write(df, path)`` stores one."""
    request.validate(inputs)
    return multi_of(flagged(a, b, key), request, write, key)


def multi_of(marked: DataFrame, request: Request, write, key: str = "key") -> dict[str, int]:
    """``multi`` of a table of flagged keys."""
    request.validate()
    if not request.outputs:
        return {r["relation"]: r["n"] for r in sizes(marked).collect()}
    marked = marked.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for name, path in request.outputs.items():
            write(marked.where(RELATIONS[name]).select(key), path)
        found = {r["relation"]: r["n"] for r in sizes(marked).collect()}
    finally:
        marked.unpersist()
    return found if request.sizes else {k: found[k] for k in request.outputs}
