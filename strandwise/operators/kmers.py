"""k-mers of records: enumeration, counts and sets.

Two forms of the same plan. ``strings`` cuts a sequence into chunks that
overlap by k - 1 and cuts those into k-mers, all as expressions, for any k.
``codes`` holds k <= 31 bases in a long, computed by numpy over Arrow batches:
a third of the bytes in a shuffle, and no k-character string is ever made.

Records longer than ``PIECE`` are cut into overlapping pieces by their bytes
before they are dealt, so one chromosome is work for all tasks. Sets are made
of blocks: a task gathers up to ``HELD`` codes, sorts them in the order of a
scrambled code, and sends ranges of them as one binary each, in which a code is
its distance from the one before, in as few bytes as the block's largest takes;
whoever gets a range merges what all tasks found. So no code is a row of its own
until the set is read, and a task's memory depends on the constants below.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet
from ..functions.batches import sliced

CHUNK = 256
#: Longer records are cut into pieces of so many k-mers.
PIECE = 1 << 20
#: Codes of a range of a set, about; a task merges one range.
RANGE = 8 << 20
#: Codes that a task gathers before it sends them, or merges what it got.
HELD = 4 << 20
#: Codes in a batch of rows.
ROWS = 1 << 18
_CODE = np.array([{0: 0, 1: 1, 2: 3, 3: 2}[(b >> 1) & 3] for b in range(256)], dtype=np.uint8)


def check_k(k: int, m: int | None = None) -> None:
    if k < 1 or m is not None and not 1 <= m <= k:
        raise ValueError(f"need 1 <= m <= k, not k = {k}, m = {m}")


def kmer_strings(records: DataFrame, k: int) -> DataFrame:
    """record_id, pos (from 0), kmer (canonical), forward: every k-mer, any k, expressions only."""
    check_k(k)
    long = pieces(records, k).select("record_id", "at", alphabet.bases(F.col("seq").cast("string")).alias("seq"))
    starts = F.sequence(F.lit(0), F.length("seq") - k, F.lit(CHUNK))
    chunks = long.select("record_id", "at", F.explode(F.transform(starts, lambda s: F.struct(s.alias("from"), F.substring(F.col("seq"), s + 1, F.lit(CHUNK + k - 1)).alias("part")))).alias("c"))
    each = F.transform(F.sequence(F.lit(0), F.length("c.part") - k), lambda i: F.struct((F.col("at") + F.col("c.from") + i).alias("pos"), F.substring(F.col("c.part"), i + 1, F.lit(k)).alias("raw")))
    rows = chunks.select("record_id", F.explode(each).alias("e")).select("record_id", "e.pos", "e.raw")
    return rows.select("record_id", "pos", alphabet.canonical("raw").alias("kmer"), alphabet.is_forward("raw").alias("forward"))


def pieces(records: DataFrame, k: int, lead: int = 0, tail: int = 0, keep: tuple = ("record_id",)) -> DataFrame:
    """record_id, at, seq (bytes): records of k bases or more, in pieces of ``PIECE`` k-mers, the first of which is k-mer ``at``.

    Pieces have ``lead`` k-mers before and ``tail`` after their own, where the
    record has them. Cutting bytes costs what is cut, wherever it stands.
    """
    data, n = F.col("seq").cast("binary"), F.octet_length("seq")

    def piece(s):
        first = F.greatest(s - lead, F.lit(0))
        return F.struct(s.alias("at"), F.substring(data, first + 1, s - first + F.lit(PIECE + tail + k - 1)).alias("seq"))

    cut = F.when(n - k < PIECE, F.array(F.struct(F.lit(0).alias("at"), data.alias("seq")))).otherwise(F.transform(F.sequence(F.lit(0), n - k, F.lit(PIECE)), piece))
    return records.where(n >= k).select(*keep, F.explode(cut).alias("_p")).select(*keep, "_p.at", "_p.seq")


def base_codes(data: bytes) -> np.ndarray:
    return _CODE[np.frombuffer(data, dtype=np.uint8)]


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of all k-base spans by doubling: about 2 log2(k) passes."""
    out, width = None, 0
    power, size = codes.astype(np.uint64), 1
    left = k
    while left:
        if left & 1:
            out, width = (power, size) if out is None else (_joined(out, width, power, size), width + size)
        left >>= 1
        if left:
            power, size = _joined(power, size, power, size), 2 * size
    return out


def _joined(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Codes of n + m bases from those of n and of m."""
    count = max(0, min(len(a), len(b) - n))
    return a[:count] << np.uint64(2 * m) | b[n : n + count]


def canonical_codes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(canonical codes, whether the read strand is the smaller) of all k-base spans."""
    forward = rolling(codes, k)
    back = rolling((3 - codes)[::-1], k)[::-1]
    return np.minimum(forward, back), forward <= back


def laid(batch: pa.RecordBatch, k: int):
    """Pieces of k bases or more in slices: (rows, lengths, joined codes)."""
    begun = 0
    for part in sliced(batch, "seq"):
        own = [(i, seq) for i, seq in enumerate(part.column("seq").cast(pa.binary()).to_pylist(), begun) if seq is not None and len(seq) >= k]
        begun += part.num_rows
        if own:
            yield np.array([i for i, _ in own]), np.array([len(seq) for _, seq in own]), base_codes(b"".join(seq for _, seq in own))


def inside(lengths: np.ndarray, k: int) -> np.ndarray:
    """Starts of spans that stay in their record."""
    first = np.cumsum(lengths) - lengths
    n = lengths - k + 1
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def dealt(records: DataFrame) -> DataFrame:
    """More partitions for a table of few splits.

    What a shuffle made is dealt already, and asking for its partitions would run it.
    """
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    if any(x in plan for x in ("Repartition", "Rebalance", "Aggregate", "Join", "Sort", "Window")):
        return records
    want = records.sparkSession.sparkContext.defaultParallelism
    return records.repartition(want) if records.rdd.getNumPartitions() * 2 < want else records


class Known:
    """Which codes are in a set of bounded size: a table of bits first, then a search."""

    def __init__(self, codes: np.ndarray):
        self._hold(np.sort(np.asarray(codes).view(np.uint64)))

    def _hold(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.shift = np.uint64(64 - min(28, max(10, int(len(codes)).bit_length() + 4)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.bits[self.codes * SCRAMBLE >> self.shift] = True

    def __getstate__(self):
        return (self.codes,)  # the table of bits is made again where the set arrives

    def __setstate__(self, state):
        self._hold(*state)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        found = self.bits[codes * SCRAMBLE >> self.shift]
        at = np.flatnonzero(found)
        if len(at):
            some = codes[at]
            found[at] = self.codes[np.minimum(np.searchsorted(self.codes, some), len(self.codes) - 1)] == some
        return found


#: An odd number: multiplying by it is a bijection of 64-bit codes, whose leading bits then are even.
SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _check_codes(k: int) -> None:
    check_k(k)
    if k > 31:
        raise ValueError("codes hold 31 bases at most")


def kmer_codes(records: DataFrame, k: int, known: Known | None = None) -> DataFrame:
    """record_id, pos, code, forward (and, with ``known``, present): every k-mer, k <= 31."""
    _check_codes(k)
    names = ["record_id", "pos", "code", "forward"] + ["present"] * (known is not None)

    def run(batches):
        for batch in batches:
            start = batch.column("at").to_numpy()
            for rows, lengths, codes in laid(batch, k):
                at = inside(lengths, k)
                code, forward = canonical_codes(codes, k)
                n = lengths - k + 1
                pos = at + np.repeat(start[rows] - (np.cumsum(lengths) - lengths), n)
                ids = batch.column("record_id").take(pa.array(np.repeat(rows, n)))
                out = [ids, pa.array(pos.astype(np.int32)), pa.array(code[at].view(np.int64)), pa.array(forward[at])]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(known(code[at]))] if known is not None else []), names=names)

    return dealt(pieces(records, k)).mapInArrow(run, "record_id string, pos int, code long, forward boolean" + ", present boolean" * (known is not None))


def kmers(records: DataFrame, k: int) -> DataFrame:
    """record_id, pos, kmer, forward for any k."""
    if k > 31:
        return kmer_strings(dealt(records), k)
    return kmer_codes(records, k).select("record_id", "pos", alphabet.decode("code", k).alias("kmer"), "forward")


# ------------------------------------------------------------ sets by blocks


def _scrambled(codes: np.ndarray, k: int) -> np.ndarray:
    """A bijection of 2k-bit codes, so that they spread evenly over their range."""
    return codes * SCRAMBLE & np.uint64((1 << 2 * k) - 1)


def _unscrambled(mixed: np.ndarray, k: int) -> np.ndarray:
    return mixed * _BACK & np.uint64((1 << 2 * k) - 1)


def packed(x: np.ndarray, low: int) -> bytes:
    """Ascending numbers from ``low`` on: bytes of a distance, then distances."""
    gaps = np.diff(x, prepend=np.uint64(low)).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, low: int) -> np.ndarray:
    width = data[0]
    gaps = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(low)


class Gathered:
    """Distinct numbers, ascending, of arrays that come one by one, by sorting (``np.unique`` hashes, which takes many times as long); holds the distinct ones and ``HELD`` more at most before they are merged."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.n = self.most = 0

    def add(self, x: np.ndarray) -> bool:
        """Whether they were merged."""
        self.parts.append(x)
        self.n += len(x)
        if full := self.n > max(self.most, HELD):
            self.merge()
        return full

    def merge(self) -> np.ndarray:
        x = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        self.parts.clear()  # or they stand beside the sorted ones
        x.sort()
        if len(x):
            x = x[np.r_[True, x[1:] != x[:-1]]]
        self.parts.append(x)
        self.n, self.most = len(x), 2 * len(x) + HELD // 2
        return x


def _blocks(records: DataFrame, k: int, bits: int, side: int = 0, only: Known | None = None, without: Known | None = None) -> DataFrame:
    """side, range, n, codes (scrambled, ascending, packed); n: how many k-mers, with repeats, on one row for all ranges sent with it."""
    _check_codes(k)
    bits = min(bits, 2 * k)
    shift = 2 * k - bits

    def sent(mixed, n):
        bounds = np.r_[0, np.searchsorted(mixed, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(shift)), len(mixed)]
        own = np.flatnonzero(np.diff(bounds))
        for some in np.split(own, range(256, len(own), 256)):
            data = [packed(mixed[bounds[i] : bounds[i + 1]], int(i) << shift) for i in some]
            counts = np.zeros(len(some), np.int64)
            counts[:1], n = n, 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), side, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts), pa.array(data, pa.binary())], names=["side", "range", "n", "codes"])

    def run(batches):
        held, n = Gathered(), 0
        for batch in batches:
            for _, lengths, codes in laid(batch, k):
                code = canonical_codes(codes, k)[0][inside(lengths, k)]
                if only is not None:
                    code = code[only(code)]
                if without is not None:
                    code = code[~without(code)]
                n += len(code)
                if held.add(_scrambled(code, k)) and held.n > HELD // 2:  # few are repeats
                    yield from sent(held.parts.pop(), n)
                    held, n = Gathered(), 0
        if n:
            yield from sent(held.merge(), n)

    return dealt(pieces(records, k, keep=())).mapInArrow(run, "side int, range int, n long, codes binary")


def _bytes(records: DataFrame) -> int:
    """The planner's estimate; where it has none, or one beyond a terabyte (joins multiply), bases are counted."""
    size = int(str(records._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 40 else records.agg(F.sum(F.octet_length("seq"))).first()[0] or 0


def _bits(*records: DataFrame) -> int:
    """Binary logarithm of the number of ranges: at least one a shuffle partition, and more as the input grows."""
    spark = records[0].sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * sum(map(_bytes, records)) // RANGE)
    return min(22, max(0, (ranges - 1).bit_length()))


def _merged(blocks: DataFrame, k: int, bits: int, work, schema: str) -> DataFrame:
    """``work(a, b, n)`` on the ascending scrambled codes of both sides, and how many there were with repeats, for each range."""
    names = [c.split()[0] for c in schema.split(", ")]
    bits = min(bits, 2 * k)
    shift = 2 * k - bits

    def run(batches):
        held: dict = {}
        n: dict = {}
        for batch in batches:
            for part in sliced(batch, "codes"):
                for side, at, some, data in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    held.setdefault((at, side), Gathered()).add(unpacked(data, at << shift))
                    n[at] = n.get(at, 0) + some
        for at in sorted(n):
            for out in work(*(held.pop((at, side), Gathered()).merge() for side in (0, 1)), n[at]):
                yield pa.RecordBatch.from_arrays(out, names=names)

    return blocks.repartitionById(1 << bits, "range").mapInArrow(run, schema)


def code_set(records: DataFrame, k: int, only: Known | None = None, without: Known | None = None) -> DataFrame:
    """code: distinct canonical k-mers, k <= 31; of ``only`` these, or none of ``without``."""

    def work(a, _, __):
        for i in range(0, len(a), ROWS):
            yield [pa.array(_unscrambled(a[i : i + ROWS], k).view(np.int64))]

    bits = _bits(records)
    return _merged(_blocks(records, k, bits, 0, only, without), k, bits, work, "code long")


def totals(records: DataFrame, k: int) -> DataFrame:
    """One row: n_kmers with repeats, and n_distinct of them; k <= 31."""
    bits = _bits(records)
    found = _merged(_blocks(records, k, bits), k, bits, lambda a, _, n: [[pa.array([n], pa.int64()), pa.array([len(a)], pa.int64())]], "n_kmers long, n_distinct long")
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in found.columns))


def distinct_count(records: DataFrame, k: int) -> DataFrame:
    """One row: n distinct canonical k-mers."""
    if k > 31:
        return key_set(records, k).agg(F.count("*").alias("n"))
    return totals(records, k).select(F.col("n_distinct").alias("n"))


def among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the ascending ``x`` are in the ascending ``y``."""
    found = np.zeros(len(x), dtype=bool)
    for i in range(0, len(x) if len(y) else 0, ROWS):
        some = x[i : i + ROWS]
        found[i : i + ROWS] = y[np.minimum(np.searchsorted(y, some), len(y) - 1)] == some
    return found


def _of_two(a: DataFrame, b: DataFrame, k: int, work, schema: str) -> DataFrame:
    bits = _bits(a, b)
    return _merged(_blocks(a, k, bits, 0).unionByName(_blocks(b, k, bits, 1)), k, bits, work, schema)


def pair_counts(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row: both, only_a, only_b of the k-mer sets of two tables of records; k <= 31."""

    def work(x, y, _):
        both = int((among(x, y) if len(x) < len(y) else among(y, x)).sum())
        yield [pa.array([n], pa.int64()) for n in (both, len(x) - both, len(y) - both)]

    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return _of_two(a, b, k, work, "both long, only_a long, only_b long").agg(total("both"), total("only_a"), total("only_b"))


def pair_flags(a: DataFrame, b: DataFrame, k: int, wanted=("both", "only_a", "only_b")) -> DataFrame:
    """key, in_a, in_b of the k-mer sets of two tables of records; k <= 31. What is not ``wanted`` never becomes rows."""

    def work(x, y, _):
        for own, other, only, flags in ((x, y, "only_a", (True, False)), (y, x, "only_b", (False, True))):
            for i in range(0, len(own) if only in wanted or own is x else 0, ROWS):
                some = own[i : i + ROWS]
                shared = among(some, other)
                for keep, fits, (in_a, in_b) in ((only, ~shared, flags), ("both", shared, (True, True))):
                    if keep in wanted and (keep != "both" or own is x):
                        key = _unscrambled(some[fits], k).view(np.int64)
                        yield [pa.array(key), pa.array(np.full(len(key), in_a)), pa.array(np.full(len(key), in_b))]

    return _of_two(a, b, k, work, "key long, in_a boolean, in_b boolean")


def collected(records: DataFrame, k: int, most: int, only: Known | None = None) -> Known | None:
    """The k-mer set of ``records`` as a set for executors, if it has ``most`` keys at most; they are counted first."""
    if only is None and distinct_count(records, k).first()["n"] > most:
        return None
    return Known(code_set(records, k, only).toArrow().column("code").to_numpy())


def key_set(records: DataFrame, k: int) -> DataFrame:
    """key: distinct canonical k-mers as the shortest key type for k."""
    if k <= 31:
        return code_set(records, k).select(F.col("code").alias("key"))
    return kmer_strings(dealt(records), k).select(F.col("kmer").alias("key")).distinct()


def as_kmer(key, k: int):
    key = F.col(key) if isinstance(key, str) else key
    return alphabet.decode(key, k) if k <= 31 else key


def as_key(kmer, k: int):
    kmer = F.col(kmer) if isinstance(kmer, str) else kmer
    return alphabet.code(kmer, k) if k <= 31 else kmer


def kmer_set(records: DataFrame, k: int) -> DataFrame:
    """kmer: distinct canonical k-mers."""
    return key_set(records, k).select(as_kmer("key", k).alias("kmer"))


def count_kmers(records: DataFrame, k: int) -> DataFrame:
    """One row: k-mers with repeats."""
    check_k(k)
    return records.agg(F.coalesce(F.sum(F.greatest(F.octet_length("seq") - k + 1, F.lit(0))), F.lit(0)).cast("long").alias("n"))
