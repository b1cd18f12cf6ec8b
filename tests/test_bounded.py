"""What a task of the k-mer queries holds, and what it sends, does not grow with its input."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from strandwise.functions import batches
from strandwise.operators import kmers, membership, minimizers, setops
from strandwise.plans import catalogue
from strandwise.sources import sequences

DATA = "/root/testdata/sf0.001"


class Taken:
    """Stands for a table, and gives the function that would map it."""

    def same(self, *_):
        return self

    select = where = repartitionById = same

    def mapInArrow(self, run, _):
        return run


def peak(run, given):
    """(MB of Python and numpy at most, rows' batches)."""
    tracemalloc.start()
    n = sum(1 for _ in run(iter(given)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6, n


def bases(n, seed=1):
    return np.random.default_rng(seed).choice(np.frombuffer(b"ACGT", np.uint8), n).tobytes()


def plan(name, spark):
    return catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


#: A join, or an aggregation by a key, of rows that hold one k-mer each.
BY_ROWS = r"Join \w|Aggregate \[[^\n]*\], \["


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(kmers, "HELD", 1 << 17)
    monkeypatch.setattr(batches, "SLICE", 1 << 15)


def blocks_of(spark, monkeypatch, only=None):
    records = sequences.from_strings(spark, ["ACGT"])
    with monkeypatch.context() as m:
        m.setattr(kmers, "dealt", lambda _: Taken())
        return kmers._blocks(records, 21, 4, 0, only)


def test_blocks_hold_as_much_for_any_input(spark, monkeypatch, small):
    """what is read to be filtered or counted."""
    run = blocks_of(spark, monkeypatch)
    batch = lambda n: pa.RecordBatch.from_arrays([pa.array([bases(1 << 14, i) for i in range(n)], pa.binary())], names=["seq"])
    few, many = (peak(run, [batch(n)])[0] for n in (32, 256))
    assert few < 12 and many < 1.2 * few
    few_keys = kmers.Known(np.arange(100, dtype=np.uint64))
    assert peak(blocks_of(spark, monkeypatch, few_keys), [batch(256)])[0] < 8


@pytest.mark.parametrize("k", [1, 3, 21, 31])
def test_packed_codes(k):
    x = np.unique(np.random.default_rng(k).integers(0, 1 << 2 * k, 5000, dtype=np.uint64))
    assert np.array_equal(kmers.unpacked(kmers.packed(x, 0), 0), x)
    assert np.array_equal(kmers.unpacked(kmers.packed(x[-9:], int(x[-9])), int(x[-9])) if len(x) > 9 else x, x[-9:] if len(x) > 9 else x)
    assert len(np.unique(kmers._scrambled(x, k))) == len(x) and np.array_equal(kmers._unscrambled(kmers._scrambled(x, k), k), x)


def test_a_set_travels_as_its_codes():
    import pickle

    x = kmers.Known(np.arange(1 << 16, dtype=np.uint64))
    sent = pickle.dumps(x)
    assert len(sent) < 9 << 16 and np.array_equal(pickle.loads(sent).bits, x.bits)


def test_diff_ba_makes_no_row_of_the_larger_set(spark):
    """F2"""
    assert not re.search(BY_ROWS, plan("setop_diff_ba", spark))


def test_merging_holds_as_much_for_any_repeats(spark, monkeypatch, small):
    """a set of many blocks is merged as they come, and leaves in batches of bounded rows."""
    monkeypatch.setattr(kmers, "ROWS", 1 << 10)
    with monkeypatch.context() as m:
        m.setattr(kmers, "dealt", lambda _: Taken())
        m.setattr(kmers, "_blocks", lambda *_: Taken())
        run = kmers.code_set(sequences.from_strings(spark, ["ACGT"]), 21)
    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 36, 1 << 14, dtype=np.uint64))
    rows = [pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([len(codes)]), pa.array([kmers.packed(codes, 0)], pa.binary())], names=["side", "range", "n", "codes"])]
    few, many = (peak(run, rows * n) for n in (20, 200))
    assert many[0] < 1.2 * few[0] and few[1] == many[1] == -(-len(codes) // 1024)


def test_roundtrip_aggregates_no_strings(spark):
    """k-mers inside super-k-mers meet as blocks of codes and not as rows of a hash aggregation."""
    assert not re.search(BY_ROWS, plan("superkmer_kmers_roundtrip", spark))
    r = sequences.from_strings(spark, ["ACGTTGCATTACGGA" * 4, "ACGTTGCATTACGGA" * 4, "CCC"])
    found = kmers.totals(minimizers.superkmers(r, 7, 3).select("record_id", "seq"), 7).first()
    assert tuple(found) == (2 * 54, len({x.kmer for x in kmers.kmers(r, 7).collect()}))
    assert tuple(kmers.totals(sequences.from_strings(spark, ["CC"]), 7).first()) == (0, 0)


def test_superkmers_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(batches, "SLICE", 1 << 12)
    with monkeypatch.context() as m:
        m.setattr(minimizers, "dealt", lambda _: Taken())
        run = minimizers.superkmers(sequences.from_strings(spark, ["ACGT"]), 21, 11)
    n = 64
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(n))), pa.array([0] * n, pa.int32()), pa.array([bases(1 << 12, i) for i in range(n)], pa.binary())], names=["record_id", "at", "seq"])
    assert peak(run, [batch])[1] == n


@pytest.mark.parametrize("name", ["setop_xor", "setop_union"])
def test_relations_meet_in_blocks(spark, name):
    """F5, F15"""
    assert not re.search(BY_ROWS, plan(name, spark))


@pytest.mark.parametrize("k", [15, 40])
def test_relations_of_records(spark, k):
    r = [sequences.from_strings(spark, x) for x in (["ACGTTGCATTACGGA" * 4, "C" * 60], ["ACGTTGCATTACGGA" * 4, "ACAC" * 15])]
    a, b = ({x.kmer for x in kmers.kmer_set(y, k).collect()} for y in r)
    for name, want in {"intersection": a & b, "union": a | b, "diff_ab": a - b, "diff_ba": b - a, "xor": a ^ b}.items():
        got = [x[0] for x in setops.relation_of(*r, name, k).select(kmers.as_kmer("key", k)).collect()]
        assert sorted(got) == sorted(want)
    flags = {x.kmer: (x.in_a, x.in_b) for x in setops.flagged_of(*r, k).select(kmers.as_kmer("key", k).alias("kmer"), "in_a", "in_b").collect()}
    assert flags == {x: (x in a, x in b) for x in a | b}


def test_multi_shares_a_table_of_blocks(spark, monkeypatch):
    """F6"""
    seen = []
    monkeypatch.setattr(setops, "multi_of", lambda marked, *_: seen.append(marked) or dict.fromkeys(setops.SIZES, 0))
    monkeypatch.setattr(catalogue.store, "read_meta", lambda *_: {"n_kmers": 0})
    catalogue.QUERIES["setop_multi"](spark, DATA)
    assert not re.search(BY_ROWS, seen[0]._jdf.queryExecution().optimizedPlan().toString())


def test_lookup_takes_what_both_share(spark, monkeypatch):
    """large sets that share little are looked up where records are read, without a row for each position or key."""
    a, b = (sequences.from_strings(spark, [bases(400, s).decode() for s in seeds]) for seeds in ((1, 2), (2, 3)))
    want = sorted(map(tuple, membership.summary_among(a, b, 21).collect()))
    monkeypatch.setattr(membership, "BROADCAST_KEYS", 500)
    assert isinstance(membership.known(a, b, 21), kmers.Known)
    assert sorted(map(tuple, membership.summary_among(a, b, 21).collect())) == want
    monkeypatch.setattr(membership, "BROADCAST_KEYS", 100)
    assert membership.known(a, b, 21).count() == 380
    assert sorted(map(tuple, membership.summary_among(a, b, 21).collect())) == want


@pytest.mark.parametrize("f", [setops.difference_of, setops.common_of])
def test_large_sets_meet_in_blocks(spark, monkeypatch, f):
    """F8, and the other operation that shares the step."""
    monkeypatch.setattr(setops, "BROADCAST_KEYS", 10)
    a, b = (sequences.from_strings(spark, [bases(400, s).decode() for s in seeds]) for seeds in ((1, 2), (2, 3)))
    found = f(a, b, 21)
    assert found.count() == 380
    assert not re.search(BY_ROWS, found._jdf.queryExecution().optimizedPlan().toString())


def test_letters_in_slices(spark):
    """F9, F16: 16 MB of texts in one batch; each is translated on its own."""
    texts = [f"{i}é-".encode() + b"abcXYZ 12" * 1000 for i in range(1800)]
    run = sequences.from_letters(Taken(), "id", "text")
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(len(texts)))), pa.array(texts, pa.binary())], names=["record_id", "text"])
    most, n = peak(run, [batch])
    assert most < 6 and 10 < n < 40
    first = next(run(iter([batch]))).column("seq")[0].as_py()
    assert first == "".join("ACTG"[(ord(c) >> 1) & 3] for c in "abcXYZ" * 1000)


def test_blocks_take_few_bytes(spark, monkeypatch):
    """half of what codes of 8 bytes take, at most."""
    run = blocks_of(spark, monkeypatch)
    batch = pa.RecordBatch.from_arrays([pa.array([bases(1 << 20)], pa.binary())], names=["seq"])
    sent = [x for b in run(iter([batch])) for x in b.column("codes").to_pylist()]
    assert sum(map(len, sent)) <= 4.01 * (1 << 20) and len(sent) == 16
