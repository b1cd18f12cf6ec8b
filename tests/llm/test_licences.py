import random
import re
from collections import Counter

import pytest

from strandwise.llm import licences as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(text):
    ws = WORD.findall(lower(text or ""))
    places = []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_query(spark, put):
    from .conftest import odd_rows

    extra = [(900, "CC BY cc by-CC by All Rights reserved. general PUBLIC license GENERAL public/license"), (901, "occ by cc bya all rights  reserved"), (902, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0"), (903, "license: MIT AND (")]
    pairs = odd_rows() + extra
    got = L.op2_licences(spark, put(pairs, ("score", "labels"))).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *brute(t)) for i, t in pairs)
    by = {r.doc_id: r for r in got}
    assert set(by[902].labels.split(",")) == {"apache", "gpl", "mit"} and by[902].open
    assert by[903].labels == "mit"
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_empty_table(spark, put):
    assert L.op2_licences(spark, put([])).count() == 0


def test_random_phrases_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        ws = rng.choices(["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC-BY", "ß", "x"], k=rng.randint(0, 40))
        text = rng.choice([" ", ", ", "\n"]).join(ws)
        assert L.scan(text.encode())[:5] == brute(text)


@pytest.mark.parametrize(("text", "order"), [("a or b and c", "a b c and or"), ("(a or b) and c", "a b or c and"), ("a with x and b", "a x with b and"), ("a and b and c", "a b and c and")])
def test_postfix(text, order):
    assert L.postfix(text) == order.split()


@pytest.mark.parametrize("text", ["", "and", "a b", "(a", "a)", "a or", "( )"])
def test_malformed(text):
    with pytest.raises(ValueError):
        L.postfix(text)


def test_open_against_truth_tables():
    rng = random.Random(1)
    names = {"mit": True, "isc": True, "gpl-3.0": False, "epl-2.0": False}

    def build(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(list(names)) + rng.choice(["", "", " with some-exception"])
        return f"({build(depth - 1)} {rng.choice(['and', 'or'])} {build(depth - 1)})"

    for _ in range(200):
        e = build(4)
        plain = e.replace(" with some-exception", "")
        truth = eval(re.sub(r"[a-z][a-z0-9.-]*", lambda m: m[0] if m[0] in ("and", "or") else str(names[m[0]]), plain))
        assert L.evaluate(e) == (truth, [n for n in re.findall(r"[a-z][a-z0-9.-]*", plain) if n in names])


def test_long_expressions():
    many = " and ".join(["(mit or gpl-2.0)"] * 400)
    assert L.evaluate(many)[0] and not L.evaluate(many + " and gpl-2.0")[0]
    assert L.evaluate(" or ".join(["gpl-2.0"] * 3000 + ["mit"]))[0]
    assert L.evaluate("mit or (mit and gpl-2.0)") == (True, ["mit", "mit", "gpl-2.0"])
    got = L.scan(f"License: {many}".encode())
    assert got[7] and got[5] == "gpl,mit"


def test_score_follows_the_evidence():
    score = lambda t: L.scan(t.encode())[6]
    assert score("nothing here") == 0
    assert 0 < score("license: whatever") < score("mit license") < score("mit license. " * 10) < score("mit license. " * 1000) < 1
    assert score("all rights reserved " * 60) < score("all rights reserved " * 61)
