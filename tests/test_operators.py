"""k-mer operators against plain Python sets and second implementations."""

import gzip
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise import cli
from strandwise.functions import alphabet, hashing
from strandwise.operators import compaction, generators, kmers, membership, minimizers, setops
from strandwise.sources import sequences, store

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def canon(s):
    return min(s, rc(s))


def as_bases(s):
    return "".join("ACTG"[(b >> 1) & 3] for b in s.encode("latin-1"))


def kmer_set(seqs, k):
    return {canon(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1)}


FIXTURES = {"CCCCAAAAA": (5, 5), "ATCGACTGTGTACACT": (12, 10), "CAACACACAAACCC": (10, 9), "ACAACACACCACAA": (10, 10)}


@pytest.mark.parametrize("seq", FIXTURES)
def test_fixture_counts(spark, seq):
    r = sequences.from_strings(spark, [seq, "AC", ""])
    rows = kmers.kmers(r, 5).collect()
    assert (len(rows), len({x.kmer for x in rows})) == FIXTURES[seq]
    assert kmers.count_kmers(r, 5).first().n == len(rows)


@pytest.mark.parametrize("k", [1, 2, 15, 21, 31, 32, 63])
def test_sets_and_positions(spark, k):
    seqs = [generators.random_dna(n, n) for n in (0, k - 1, k, k + 1, 300, 700)] + ["A" * 80, "ACGT" * 30]
    r = sequences.from_strings(spark, seqs)
    want = sorted((str(i), p, canon(s[p : p + k]), s[p : p + k] <= rc(s[p : p + k])) for i, s in enumerate(seqs) for p in range(len(s) - k + 1))
    assert sorted(map(tuple, kmers.kmers(r, k).collect())) == want
    assert sorted(map(tuple, kmers.kmer_strings(r, k).collect())) == want
    assert {x.kmer for x in kmers.kmer_set(r, k).collect()} == kmer_set(seqs, k)


def test_any_byte_is_a_base(spark):
    text = "acgtuNnRYKM-.*xyz \x00~"
    got = spark.createDataFrame([(text,)], "t string").select(alphabet.bases("t")).first()[0]
    assert got == as_bases(text)
    assert as_bases("NUnu") == "GTGT"


def test_codes(spark):
    words = ["".join(p) for p in itertools.product("ACGT", repeat=4)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", alphabet.code("w", 4).alias("c"))
    df = df.select("w", "c", alphabet.decode("c", 4).alias("back"))
    rows = df.collect()
    assert all(r.back == r.w for r in rows) and [r.w for r in sorted(rows, key=lambda r: r.c)] == sorted(words)


@pytest.mark.parametrize("m", range(1, 9))
def test_phi_is_a_bijection(spark, m):
    x = np.arange(1 << 2 * m, dtype=np.uint64)
    y = hashing.phi(x, m)
    assert len(np.unique(y)) == len(x) and y[0] != 0 and y.max() < 1 << 2 * m
    assert np.array_equal(hashing.phi_inverse(y, m), x)
    if m < 6:
        got = spark.range(1 << 2 * m).select(hashing.phi(F.col("id"), m), hashing.psi(F.col("id"), m)).collect()
        assert [r[0] for r in got] == y.tolist()
        assert [r[1] for r in got] == [int(f"{v:0{2 * m}b}"[::-1], 2) for v in y.tolist()]


@pytest.mark.parametrize("m", [16, 21, 31])
def test_phi_inverse_of_wide_codes(m):
    x = np.random.default_rng(m).integers(0, 1 << 2 * m, 5000, dtype=np.uint64)
    assert np.array_equal(hashing.phi_inverse(hashing.phi(x, m), m), x)


SETS = {
    "empty": ([], []),
    "one empty": ([], ["x300"]),
    "identical": (["x400"], ["x400"]),
    "disjoint": (["x500"], ["y501"]),
    "partial": (["x300", "y250"], ["x300", "z251"]),
    "inclusion": (["x300", "y300"], ["x300"]),
    "repeats": (["x200", "x200"], ["x200"]),
}


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("k", [15, 40])
def test_set_algebra(spark, name, k, tmp_path):
    a, b = ([generators.random_dna(int(s[1:]), ord(s[0])) for s in side] for side in SETS[name])
    x, y = kmer_set(a, k), kmer_set(b, k)
    one, two = (kmers.key_set(sequences.from_strings(spark, s), k) for s in (a, b))
    want = {"intersection": x & y, "union": x | y, "diff_ab": x - y, "diff_ba": y - x, "xor": x ^ y}
    read = lambda df: sorted(r[0] for r in df.select(kmers.as_kmer("key", k)).collect())
    for rel, keys in want.items():
        assert read(setops.relation(one, two, rel)) == sorted(keys)
        assert setops.size(one, two, rel).first().n == len(keys)
    assert read(setops.union(one, two)) == sorted(x | y) and read(setops.difference(one, two)) == sorted(x - y)
    sizes = {n: len(v) for n, v in want.items()} | {"A": len(x), "B": len(y)}
    assert {r.relation: r.n for r in setops.sizes(setops.flagged(one, two)).collect()} == sizes
    o = setops.overlap(setops.flagged(one, two)).first()
    assert o.jaccard == (len(x & y) / len(x | y) if x | y else None)
    if name == "partial":
        request = setops.Request({"union": f"{tmp_path}/u", "xor": f"{tmp_path}/x"})
        found = setops.multi(one, two, request, lambda df, p: store.write_set(df, p, k))
        assert found == sizes and read(store.read_set(spark, f"{tmp_path}/x")[0]) == sorted(x ^ y)


def test_requests_are_checked(tmp_path):
    for outputs, inputs in (({"nothing": "a"}, ()), ({"union": "a", "xor": "a/"}, ()), ({"union": "a/"}, ("a",))):
        with pytest.raises(ValueError):
            setops.Request(outputs).validate(inputs)
    with pytest.raises(ValueError):
        setops.Request({}, sizes=False).validate()


@pytest.mark.parametrize("k", [15, 33])
def test_membership(spark, k):
    ref, other = generators.random_dna(800, 1), generators.random_dna(400, 2)
    keys = kmers.key_set(sequences.from_strings(spark, [ref]), k)
    queries = [ref[100:300], rc(ref[50:90]), other, ref[: k - 1]]
    r = sequences.from_strings(spark, queries)
    s = kmer_set([ref], k)
    want = sorted((str(i), p, canon(q[p : p + k]), canon(q[p : p + k]) in s) for i, q in enumerate(queries) for p in range(len(q) - k + 1))
    for n in (None, len(s)):
        found = membership.presence(r, keys, k, n)
        assert sorted(map(tuple, found.collect())) == want
    lines = {x.record_id: x.line for x in membership.lines(found).collect()}
    assert set(lines["0"].split(",")) == {"1"} and set(lines["1"].split(",")) == {"1"} and set(lines["2"].split(",")) == {"0"} and "3" not in lines
    assert {x.record_id: (x.n_kmers, x.n_present) for x in membership.summary(found).collect()}["2"] == (400 - k + 1, 0)


PAIRS = [(5, 2), (7, 3), (9, 4), (11, 5), (5, 5), (1, 1), (4, 1), (21, 11), (40, 15)]
WORDS = ["CGCGCGCG", "ATATATATA", "GCGCGCGCGC", "ACGTACGTACGT", "ACGTTGCAACGTTGCA", "CCCCCC", "AAAAAA", "AACAATAAGGGGGGG", "GGAGCCAAACAGGAGGAAAAGAGG", "GCGCGA"]


@pytest.mark.parametrize(("k", "m"), PAIRS)
def test_superkmers(spark, k, m):
    seqs = WORDS + [generators.random_dna(n, 77 + n) for n in (k, k + 3, 200)] + ["ACAC" * 20]
    r = sequences.from_strings(spark, seqs)
    sk = minimizers.superkmers(r, k, m)
    back = sorted(map(tuple, minimizers.explode_superkmers(sk, k).collect()))
    assert back == sorted((str(i), p, canon(s[p : p + k])) for i, s in enumerate(seqs) for p in range(len(s) - k + 1))
    for x in sk.collect():
        word = x.seq[x.pref : x.pref + m]
        assert canon(word) == x.minimizer and x.pref + m + x.suff == len(x.seq) <= 2 * k - m and x.n_kmers == len(x.seq) - k + 1
    # the strand does not change which m-mer frames a k-mer
    turned = minimizers.superkmers(sequences.from_strings(spark, list(map(rc, seqs))), k, m)
    frame = lambda df: sorted({(canon(x.seq[i : i + k]), x.minimizer) for x in df.collect() for i in range(x.n_kmers)})
    assert frame(sk) == frame(turned)


def test_long_records_in_pieces(spark, monkeypatch):
    seqs = [generators.random_dna(3000, 5), "A" * 500, generators.random_dna(57, 6), "ACGT"]
    r = sequences.from_strings(spark, seqs)
    other = sequences.from_strings(spark, [seqs[0][700:1500], seqs[2]])
    views = {
        "superkmers": lambda: minimizers.superkmers(r, 21, 11),
        "codes": lambda: kmers.kmer_codes(r, 21),
        "strings": lambda: kmers.kmer_strings(r, 21),
        "long": lambda: kmers.kmers(r, 41),
        "set": lambda: kmers.code_set(r, 21),
        "pairs": lambda: kmers.pair_counts(r, other, 21),
        "presence": lambda: membership.presence_among(r, other, 21),
        "lines": lambda: membership.lines_among(r, other, 21),
        "summary": lambda: membership.summary_among(r, other, 21),
    }
    rows = lambda: {n: sorted(map(tuple, f().collect())) for n, f in views.items()}
    whole = rows()
    monkeypatch.setattr(kmers, "PIECE", 37)
    assert rows() == whole
    monkeypatch.setattr(membership, "BROADCAST_KEYS", 0)  # joins instead of filters
    for n in ("presence", "lines", "summary"):
        assert sorted(map(tuple, views[n]().collect())) == whole[n]
    held = {canon(seqs[0][i : i + 21]) for i in range(700, 1480)} | {canon(seqs[2][i : i + 21]) for i in range(37)}
    assert whole["summary"][0] == ("0", 2980, 780) and {x[2] for x in whole["presence"] if x[3]} == held


def test_sets_of_two_tables_of_records(spark):
    a, b = ([generators.random_dna(400, s) for s in seeds] for seeds in ((1, 2, 3), (2, 3, 4, 4)))
    ra, rb = sequences.from_strings(spark, a), sequences.from_strings(spark, b)
    sa, sb = ({canon(x[i : i + 15]) for x in y for i in range(len(x) - 14)} for y in (a, b))
    got = lambda df: {r[0] for r in df.select(kmers.as_kmer("key", 15)).collect()}
    assert got(setops.common_of(ra, rb, 15)) == sa & sb and got(setops.difference_of(ra, rb, 15)) == sa - sb
    assert tuple(setops.counts_of(ra, rb, 15).first()) == (len(sa & sb), len(sa - sb), len(sb - sa))
    assert setops.size_of(ra, rb, "xor", 15).first()["n"] == len(sa ^ sb) and kmers.distinct_count(ra, 15).first()["n"] == len(sa)
    none = sequences.from_strings(spark, ["ACG"])
    assert got(setops.common_of(ra, none, 15)) == set() and got(setops.difference_of(ra, none, 15)) == sa
    assert tuple(setops.counts_of(none, none, 15).first()) == (0, 0, 0)


def test_known_codes():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 42, 5000, dtype=np.uint64)
    some = rng.permutation(np.r_[codes[:2000], rng.integers(0, 1 << 42, 3000, dtype=np.uint64)])
    assert np.array_equal(kmers.Known(codes)(some), np.isin(some, codes))
    assert not kmers.Known(codes[:0])(some).any()



def test_chains():
    rng = random.Random(8)
    for _ in range(200):
        pairs = list({(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randint(0, 25))})
        best = 0
        ordered = sorted(pairs)
        length = {}
        for p in ordered:
            length[p] = 1 + max((n for q, n in length.items() if q[0] < p[0] and q[1] < p[1]), default=0)
            best = max(best, length[p])
        for f in (compaction.longest_chain, compaction.chain_by_tree):
            out = f(pairs)
            assert len(out) == best and set(out) <= set(pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(out))


@pytest.mark.parametrize(("k", "m"), [(5, 2), (21, 11)])
def test_compaction_keeps_the_set(spark, k, m):
    s = kmers.kmer_set(sequences.from_strings(spark, [*WORDS, generators.random_dna(500, 3)]), k)
    c = compaction.compact(s, k, m)
    out = sorted(r.kmer for r in compaction.kmers_of(c, k).collect())
    assert out == sorted(r.kmer for r in s.collect())
    assert all(canon(x.seq[x.pref : x.pref + m]) == canon(x.minimizer) for x in c.collect())
    assert c.count() < s.count()


def test_fasta(spark, tmp_path):
    text = ">one first\nACGT\nacgt\r\n>two\n\nGG\n>three\nTTTT"
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(text)
    want = [("one", "ACGTacgt"), ("three", "TTTT"), ("two", "GG")]
    for name in ("a.fa", "b.fa.gz"):
        assert sorted(map(tuple, sequences.read_fasta(spark, str(tmp_path / name)).collect())) == want
    s = sequences.sanitize(sequences.from_strings(spark, ["NNacgtNNGGn", "nnn"]))
    assert sorted(map(tuple, s.collect())) == [("0_0", "ACGT"), ("0_1", "GG")]


def test_prefix(spark):
    r = spark.createDataFrame([("b", "CCCC"), ("a", "AAAA"), ("c", "GGGG")], sequences.SCHEMA)
    assert sorted(map(tuple, sequences.prefix(r, 6).collect())) == [("a", "AAAA"), ("b", "CC")]


def test_store(spark, tmp_path):
    keys = kmers.key_set(sequences.from_strings(spark, [generators.random_dna(300, 4)]), 15)
    n = store.write_set(keys, f"{tmp_path}/s", 15, 5, buckets=4)
    found, meta = store.read_set(spark, f"{tmp_path}/s")
    assert n == meta["n_kmers"] == found.count() and sorted(found.collect()) == sorted(keys.collect())
    assert sum(store.read_set(spark, f"{tmp_path}/s", b)[0].count() for b in range(4)) == n
    for bad in (f"{tmp_path}/none", f"{tmp_path}/s/keys"):
        with pytest.raises(ValueError):
            store.read_meta(spark, bad)
    with pytest.raises(ValueError):
        store.read_set(spark, f"{tmp_path}/s", 9)
    store.check_compatible(meta, meta | {"m": 7})
    for other, strict in ((meta | {"k": 17}, False), (meta | {"m": 7}, True), (meta | {"n_buckets": 16}, True)):
        with pytest.raises(ValueError):
            store.check_compatible(meta, other, strict)


def test_cli(spark, tmp_path, capsys):
    seqs = {"a": generators.random_dna(300, 5), "b": generators.random_dna(300, 5)[:200]}
    for n, s in seqs.items():
        (tmp_path / f"{n}.fa").write_text(f">{n}\n{s}\n")
        args = cli.parser().parse_args(["construct", "-f", f"{tmp_path}/{n}.fa", "-o", f"{tmp_path}/{n}", "-k", "21", "-m", "11", "--buckets", "2"])
        cli.validate(args)
        cli.construct(spark, args)
    args = cli.parser().parse_args(["setop", "-a", f"{tmp_path}/a", "-b", f"{tmp_path}/b", "--sizes", "--union", f"{tmp_path}/u"])
    cli.validate(args)
    cli.setop(spark, args)
    out = dict(x.split("\t") for x in capsys.readouterr().out.split("\n") if x)
    assert out == {"intersection": "180", "union": "280", "diff_ab": "100", "diff_ba": "0", "xor": "100", "A": "280", "B": "180"}
    args = cli.parser().parse_args(["query", "-i", f"{tmp_path}/u", seqs["b"][:30] + "A" * 21])
    cli.validate(args)
    cli.query(spark, args)
    assert capsys.readouterr().out.startswith("1,1,1,1,1,1,1,1,1,1,")
    args = cli.parser().parse_args(["construct", "-f", f"{tmp_path}/a.fa", "-o", f"{tmp_path}/d", "-k", "21", "-m", "11", "--ascii"])
    cli.construct(spark, args)
    assert spark.read.text(f"{tmp_path}/d").first()[0].startswith("21 11 ")
    for bad in (["construct", "-f", "x", "-o", "y", "-k", "5", "-m", "9"], ["construct", "-f", "x", "-o", "y", "-k", "5", "--buckets", "2", "--max-ram", "1G"], ["query", "-i", "x"], ["setop", "-a", "x", "-b", "y"], ["setop", "-a", "x", "-b", "y", "--union", "x"]):
        with pytest.raises(ValueError):
            cli.validate(cli.parser().parse_args(bad))


def test_sizes_and_bits():
    assert [hashing.parse_size(x) for x in ("2G", "512M", "64k", "1t", "100", "", "x", "-1")] == [2 << 30, 512 << 20, 64 << 10, 1 << 40, 100, 0, 0, 0]
    assert [hashing.bucket_bits(3, b) for b in (1, 2, 3, 4, 1024)] == [0, 1, 1, 2, 6]
    assert hashing.fnv1a([]) == 0xCBF29CE484222325 and hashing.fnv1a(["a"]) == 0xAF63DC4C8601EC8C


def test_generators(spark):
    r = sequences.from_strings(spark, [generators.random_dna(5000, 1)])
    assert {len(x.seq) for x in generators.simulated_reads(r, 20, 50, 0.0).collect()} == {50}
    old, new = r.first().seq, generators.mutate(r, 0.1).first().seq
    assert 0.07 < sum(a != b for a, b in zip(old, new, strict=True)) / 5000 < 0.13
    assert generators.mutate(r, 0.0).first().seq == old
    assert generators.rate_for_jaccard(1.0, 21) == 0
    assert generators.query_mix(kmers.kmers(r, 21), 100, 0.3, 21).count() == 100
