"""Small tables of documents with every odd case, and a place to put them."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMA = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
#: Names that operators use inside, as columns of the input.
CLASHES = ["_spans", "_row", "_id", "fp", "key", "node", "component_id", "score", "h", "uid", "size", "signs", "rank", "_p", "_topic", "_source", "n_tokens", "spans", "gram", "digest", "start", "length", "kept"]


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def odd_rows(seed=5):
    """(doc_id, text): nulls, empties, white space, ties, copies, repeated rows, one very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)] + ["The", "of", "and", "ÜBER", "naïve", "日本語", "x,y", "don't", "CC BY", "1999"]
    out = [(i, words(rng, rng.randint(0, 120), vocabulary)) for i in range(60)]
    passage = words(rng, 60, vocabulary)
    out += [(60 + i, words(rng, 30, vocabulary) + " " + passage + " " + words(rng, 10 * i, vocabulary)) for i in range(6)]
    copied = words(rng, 80, vocabulary)
    out += [(70 + i, copied) for i in range(40)]
    near = copied.split()
    out += [(120 + i, " ".join([*near[: 10 + i], "changed", *near[11 + i :]])) for i in range(5)]
    out += [(130, None), (131, ""), (132, " \t\n"), (133, "one"), (134, "two words"), (135, "a b c"), (136, "the the the the the the the the the the the the the the the the the the the the the the the the")]
    out += [(140, words(rng, 30_000, vocabulary)), (141, "x" * 200_000), (None, copied), (None, "no id here"), (150, "tie one two three"), (151, "tie one two three"), (-3, "a negative id"), (2**40, "a large id")]
    # repeated rows with an id, and rows of one id that differ
    out += [out[60], out[3], out[3], (61, words(rng, 50, vocabulary)), (71, copied + " " + words(rng, 40, vocabulary))]
    return out


def rows_of(pairs, clashes=()):
    columns = {"doc_id": [p[0] for p in pairs], "text": [p[1] for p in pairs]}
    columns["lang"] = [None if i % 7 == 0 else ("en", "de")[i % 2] for i in range(len(pairs))]
    columns["source"] = [None if i % 11 == 0 else "big" if i % 3 else f"s{i % 5}" for i in range(len(pairs))]
    columns["n_chars"] = [None if p[1] is None else len(p[1]) for p in pairs]
    data = {k: pa.array(v, SCHEMA[k]) for k, v in columns.items()}
    return pa.table(data | {c: pa.array([f"{c}{i}" for i in range(len(pairs))]) for c in clashes})


@pytest.fixture
def put(tmp_path):
    """put(pairs, clashes=(), **other tables) -> the folder of the tables."""

    def go(pairs, clashes=(), parts=1, **others):
        if parts == 1:
            pq.write_table(rows_of(pairs, clashes), tmp_path / "documents.parquet")
        else:
            (tmp_path / "documents.parquet").mkdir()
            for k in range(parts):
                pq.write_table(rows_of(pairs[k::parts], clashes), tmp_path / f"documents.parquet/part-{k}.parquet")
        for name, table in others.items():
            pq.write_table(table, tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return go


@pytest.fixture(params=["plain", "clashing", "empty"])
def case(request, put):
    """(folder, pairs): odd rows, the same with clashing columns, and no rows."""
    pairs = [] if request.param == "empty" else odd_rows()
    clashes = CLASHES if request.param == "clashing" else ()
    labels = pa.table({"doc_id": pa.array([p[0] for p in pairs] + [None], pa.int64()), "quality": pa.array([1] * (len(pairs) + 1), pa.int64()), "toxic": pa.array([None if i % 9 == 0 else int(i % 4 == 0) for i in range(len(pairs) + 1)], pa.int64())})
    return put(pairs, clashes, labels=labels), pairs
