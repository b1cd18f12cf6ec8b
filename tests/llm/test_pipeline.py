import corpus_pipeline as C

from strandwise.llm.common import table


def test_stages_follow_one_another(spark, case):
    folder, pairs = case
    docs = table(spark, folder, "documents")
    before, rows = docs.columns, len(pairs)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == before, name
        n = out.count()
        assert n <= rows, name
        docs, rows = out, n
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]


def test_run(spark, case):
    folder, pairs = case
    got = C.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= {i for i, _ in pairs}
    if pairs:
        assert got


def test_llm_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11))
