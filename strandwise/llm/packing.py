"""Packing by cutting-stock column generation.

Every document becomes token ids and one end id. Whole blocks of the sequence
length stand alone; what is left of each document, shorter than a sequence, is
an item. The histogram of item lengths (in units of a few tokens, so that its
size never depends on the corpus) feeds a linear program over patterns. Its
columns are priced by a knapsack dynamic program; the basis is kept as an
explicit inverse. Pattern counts are rounded down, and the ranked items of each
length class are dealt to the pattern slots by arithmetic on their rank.

Rounding leaves at most one sequence of items for each length class. Those are
laid end to end and cut at sequence boundaries; the last, partly filled stretch
is cut at powers of two, where no padding is needed. So padding is only what
rounding lengths up to a unit costs: under ``UNIT`` tokens an item.

Null and empty texts are the end id alone. Repeated rows are documents of their
own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_texts, spread, table, texts

CAPACITY = 2048
UNIT = 4
END_ID = 1
#: Words kept with their ids in each Python worker (about 100 MB at most); others are encoded anew.
CACHE_WORDS = 400_000
RANK_BUCKETS = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- token ids


def _chars(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if test(unicodedata.category(chr(c))))


#: Characters for which the shortcut below is exact: up to Latin Extended-A without the dotted I.
_UNSAFE = re.compile("[^\x00-įı-ſ‐-‧‰-⁞]")
_LETTER, _NUMBER = _chars(lambda k: k[0] == "L"), _chars(lambda k: k[0] == "N")
_SPACE = r"\t-\r \x85\xa0"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class WordEncoder(dict):
    """Ids of white-space-delimited words as little-endian 32-bit bytes.

    The vocabulary ends words with a mark and never joins across white space,
    so a text's ids are those of its words. Words of common Latin characters go
    through a rank-based byte-pair coder over the same vocabulary, in which a
    line feed stands for the mark; all others go through the tokenizer itself.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {}
        for token, rank in vocabulary.items():
            if token not in ("<|startoftext|>", "<|endoftext|>"):
                body = token.removesuffix("</w>")
                ranks[bytes(byte[c] for c in body) + b"\n" * (body != token)] = rank
        self.coder = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})

    def ids(self, word: str) -> list[int]:
        if _UNSAFE.search(word) or "<|" in word:
            return self.full.encode(word, add_special_tokens=False).ids
        pieces = _PIECE.findall(unicodedata.normalize("NFC", word).lower())
        return self.coder.encode_ordinary("\n".join(pieces) + "\n") if pieces else []

    def __missing__(self, word: bytes) -> bytes:
        out = np.array(self.ids(word.decode()), dtype="<u4").tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out

    def text(self, text: bytes) -> bytes:
        if b"<|" in text:  # a special token's name may hold or touch anything
            return np.array(self.full.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_END = np.array([END_ID], dtype="<u4").tobytes()


def pieces_of(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Blocks of ``capacity`` ids of each document, the last one shorter."""

    def work(batch):
        code, step = encoder(path), 4 * capacity
        ids, start, length, crc, total = [], [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            data = code.text(text) + _END
            for at in range(0, len(data), step):
                piece = data[at : at + step]
                ids.append(doc)
                start.append(at // 4)
                length.append(len(piece) // 4)
                crc.append(zlib.crc32(piece))
                total.append(len(data) // 4)
        return ids, start, length, crc, total

    return map_texts(docs, "text", PIECES, work)


# ---------------------------------------------------------- the linear program


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern: value[i] for each item of i + 1 units, any number of each."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        got = value[:c] + best[c - 1 :: -1][:c]
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], took[c] = got[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern = np.zeros(capacity, dtype=np.int64)
    c = capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def first_basis(d: np.ndarray, rows: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A feasible basis of nearly full patterns, one for each class.

    Each step takes the fullest pattern of the classes that are left, those with
    much demand first, as often as demand allows; the class that runs out first
    owns it. So the basis is triangular. Columns are in the order of ``rows``.
    """
    left, columns, x = d.copy(), [None] * len(rows), np.zeros(len(rows))
    for _ in rows:
        value = np.zeros(capacity)
        live = left > 0
        value[rows[live]] = (rows[live] + 1) * (1 + 0.02 * (left * (rows + 1) / (left * (rows + 1)).max())[live])
        pattern = knapsack(value, capacity)[1][rows]
        ratio = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        own = int(ratio.argmin())
        columns[own], x[own] = pattern, ratio[own]
        left = np.maximum(left - ratio[own] * pattern, 0)
        left[own] = 0
        if not (left > 0).any():
            break
    for i in range(len(rows)):  # classes that ran out together with another
        if columns[i] is None:
            columns[i] = np.where(np.arange(len(rows)) == i, capacity // (rows[i] + 1), 0)
    return columns, x


def column_generation(demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 600) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often to cut each, never more than the demand.

    demand[i]: items of i + 1 units. Revised simplex on equality rows; stops at
    optimality or where Farley's bound shows less than ``gap`` to gain.
    """
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    d = demand[rows].astype(float)
    columns, x = first_basis(d, rows, capacity)
    inverse = np.linalg.inv(np.stack(columns, axis=1).astype(float))
    for k in range(rounds):
        dual = inverse.sum(axis=0)
        value = np.zeros(capacity)
        value[rows] = dual
        best, pattern = knapsack(value, capacity)
        if best <= 1 + max(gap, 1e-9):
            break
        entering = pattern[rows].astype(float)
        way = inverse @ entering
        ok = way > 1e-9
        ratio = np.full(len(rows), np.inf)
        ratio[ok] = x[ok] / way[ok]
        out = int(ratio.argmin())
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        columns[out] = pattern[rows]
        x = inverse @ d if k % 200 == 199 else x - way * ratio[out]
        x[out] = ratio[out] if k % 200 != 199 else x[out]
    left, out_ = demand[rows].astype(np.int64).copy(), []
    for count, column in sorted(((int(np.floor(c + 1e-7)), i) for i, c in enumerate(x)), reverse=True):
        a = np.asarray(columns[column])
        used = a > 0
        count = min([count, *(left[used] // a[used])])
        if count > 0:
            left -= count * a
            full = np.zeros(capacity, dtype=np.int64)
            full[rows] = a
            out_.append((int(count), full))
    return out_


def slots(patterns: list[tuple[int, np.ndarray]]) -> tuple[dict[int, np.ndarray], int]:
    """For each length class the rank intervals that its pattern slots take.

    Rows of the arrays: first rank, first sequence, slot number in the sequence.
    """
    taken: dict[int, list] = {}
    rank: dict[int, int] = {}
    first = 0
    for count, pattern in patterns:
        slot = 0
        for i in np.flatnonzero(pattern):
            u = int(i) + 1
            for _ in range(pattern[i]):
                taken.setdefault(u, []).append((rank.get(u, 0), first, slot))
                rank[u] = rank.get(u, 0) + count
                slot += 1
        first += count
    return {u: np.array([*rows, (rank[u], -1, -1)], dtype=np.int64) for u, rows in taken.items()}, first


def ranked(items: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rank`` from 0 within ``group`` without bringing a group into one task.

    Rows are ranked within hashed parts of a group and moved up by the parts
    before; that table has RANK_BUCKETS rows a group at most.
    """
    items = items.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = items.groupBy(group, "_part").count().select(group, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(group, "_part").orderBy(*order)
    return items.withColumn("_row", F.row_number().over(inner) - 1).join(base, [group, "_part"]).withColumn("rank", F.col("_base") + F.col("_row")).drop("_base", "_row", "_part")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """One row for each piece: where it comes from and where it goes.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and kind:
    'block' (a sequence of its own), 'pattern' or 'rest'.
    """
    spark = docs.sparkSession
    path = path or default_tokenizer()
    docs = spread(docs.select("doc_id", "text"))
    pieces = cut(pieces_of(docs, path, capacity))
    blocks = pieces.where(F.col("length") == capacity)
    items = pieces.where(F.col("length") < capacity).withColumn("size", F.ceil(F.col("length") / unit).cast("int"))
    units = capacity // unit
    demand = np.zeros(units, dtype=np.int64)
    for size, n in items.groupBy("size").count().collect():  # one row for each class
        demand[size - 1] = n
    ruled, n_patterns = slots(column_generation(demand, units))
    items = ranked(items, "size", ["doc_id", "start", "ids_crc32", "length"])

    schema = f"{PIECES}, sequence_id long, slot int"

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
            sequence, slot = np.full(len(size), -1, dtype=np.int64), np.full(len(size), -1, dtype=np.int32)
            for u in np.unique(size):
                if (rows := ruled.get(int(u))) is not None:
                    own = np.flatnonzero(size == u)
                    k = np.searchsorted(rows[:, 0], rank[own], side="right") - 1
                    fits = rows[k, 1] >= 0
                    sequence[own] = np.where(fits, rows[k, 1] + rank[own] - rows[k, 0], -1)
                    slot[own] = np.where(fits, rows[k, 2], -1)
            out = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    dealt = cut(items.mapInArrow(deal, schema))
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    filled = dealt.where("sequence_id >= 0").withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    filled = filled.select(*names, F.lit("pattern").alias("kind"))

    # Rounding leaves fewer items than one sequence for each length class: bounded by units * capacity ids.
    rest = sorted(map(tuple, dealt.where("sequence_id < 0").select(*names[:5]).collect()), key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[3]))
    tail, used = _rest(docs, rest, path, capacity, n_patterns)
    out = filled
    if tail:
        out = out.unionByName(spark.createDataFrame([(*r, "rest") for r in tail], f"{PIECES}, sequence_id long, offset long, kind string"))
    # Whole blocks are numbered after the others: distinct and fixed by their document and start.
    numbered = _numbered(blocks, n_patterns + used)
    return out.unionByName(numbered.select(*names, F.lit("block").alias("kind")))


def _numbered(blocks: DataFrame, first: int) -> DataFrame:
    """sequence_id for whole blocks: gapless, ranked in hashed parts."""
    parts = 4096
    order = ["doc_id", "start", "ids_crc32"]
    blocks = blocks.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    base = blocks.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return blocks.withColumn("_row", row).join(base, "_part").withColumn("sequence_id", F.lit(first) + F.col("_base") + F.col("_row")).withColumn("offset", F.lit(0).cast("long"))


def _rest(docs: DataFrame, rest: list[tuple], path: str, capacity: int, first: int) -> tuple[list[tuple], int]:
    """Lay the items end to end; cut at sequence ends, the last stretch at powers of two."""
    total = sum(r[2] for r in rest)
    edges = list(range(0, total - total % capacity + 1, capacity))
    for k in reversed(range(capacity.bit_length())):
        if total % capacity & 1 << k:
            edges.append(edges[-1] + (1 << k))
    plan, at, sequence, wanted = [], 0, 0, {}
    for doc, start, length, crc, tokens in rest:
        end, done = at + length, start
        while at < end:
            while edges[sequence + 1] <= at:
                sequence += 1
            n = min(end, edges[sequence + 1]) - at
            plan.append([doc, done, n, crc if n == length else (doc, start, length, crc, tokens), tokens, first + sequence, at - edges[sequence]])
            if n < length:
                wanted.setdefault((doc, start, length, crc, tokens), set()).add((done, n))
            at, done = at + n, done + n
    if wanted:  # at most one document for each edge: encode those again
        chosen = {w[0] for w in wanted}
        known = [d for d in chosen if d is not None]
        some = docs.where(F.col("doc_id").isin(known) | (F.col("doc_id").isNull() if None in chosen else F.lit(False)))
        cuts = {k: sorted(v) for k, v in wanted.items()}

        def work(batch):
            code, out = encoder(path), []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                data = code.text(text) + _END
                for key, parts in by_doc.get(doc, ()):
                    if len(data) // 4 == key[4] and zlib.crc32(data[4 * key[1] : 4 * (key[1] + key[2])]) == key[3]:
                        out += [(doc, key[1], key[2], key[3], key[4], a, n, zlib.crc32(data[4 * a : 4 * (a + n)])) for a, n in parts]
            return tuple(zip(*out, strict=True)) or None

        by_doc: dict = {}
        for key, parts in cuts.items():
            by_doc.setdefault(key[0], []).append((key, parts))
        got = map_texts(some, "text", "doc_id long, start long, length long, crc long, tokens long, at long, n long, part long", work).distinct().collect()
        sums = {(tuple(r[:5]), r[5], r[6]): r[7] for r in got}
        for row in plan:
            if isinstance(row[3], tuple):
                row[3] = sums[row[3], row[1], row[2]]
    return [tuple(r) for r in plan], max(0, len(edges) - 1)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
