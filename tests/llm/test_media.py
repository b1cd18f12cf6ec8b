import hashlib
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandwise.llm import media


def expected(text):
    raw = (text or "").encode()
    body = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
    return len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])


def test_query(spark, case):
    folder, pairs = case
    got = media.op1_media(spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == Counter((i, *expected(t)) for i, t in pairs)
    assert all(r.feature.startswith("24x") and r.caption == (None if r.doc_id is None else str(r.doc_id)) for r in got)
    # the stored form by hand: a greymap of 24 columns
    by = {expected(t)[2]: (t or "").encode() for _, t in pairs}
    for r in got:
        body = by[r.payload_sha256] + b"\xff" * (r.payload_bytes - r.n_bytes)
        stored = f"P5\n24 {len(body) // 24}\n255\n".encode() + body
        x = np.frombuffer(body, np.uint8).astype(float)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == f"24x{len(body) // 24};mean={x.mean():.4f};std={x.std():.4f};white={(x == 255).mean():.6f}"
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_round_trip():
    for n in (0, 1, 575, 576, 577, 100_000):
        text = bytes(i * 7 % 251 for i in range(n))
        body = media.payload(text)
        assert len(body) % 576 == 0 and body.startswith(text) and set(body[n:]) <= {255}
        assert media.decode(media.encode(body)) == body


def test_parse_keeps_order_and_captions():
    html = '<p>one</p><figure><img src="a.png" alt="alt"><figcaption>cap <b>bold</b></figcaption></figure>two<img src="b.png" alt="x"><script>no</script><p>three'
    got = media.parse(html)
    assert [e["position"] for e in got] == list(range(5))
    assert [(e["kind"], e["text"], e["caption"]) for e in got] == [("text", "one", None), ("image", None, "cap bold"), ("text", "two", None), ("image", None, "x"), ("text", "three", None)]
    assert (got[1]["digest"], got[1]["source"]) == (None, "a.png")
    assert media.parse('<img src="sha256:AB">')[0]["digest"] == media.parse('<img data-digest="ab">')[0]["digest"] == "ab"
    assert media.parse(None) == media.parse("") == []


def test_caption_before_media_and_two_media():
    got = media.parse('<figure><figcaption>c</figcaption><img src="1"><img src="2"></figure>')
    assert [(e["kind"], e["caption"]) for e in got] == [("image", "c"), ("image", "c")]


def test_open_captions_and_nested_figures():
    brief = lambda html: [(e["kind"], e["text"], e["caption"]) for e in media.parse(html)]
    assert brief('<figure><img src=1><figcaption>cap</figure>after<p>more') == [("image", None, "cap"), ("text", "after", None), ("text", "more", None)]
    assert brief('<figure><img src=1 alt=a><figcaption>cap <p>two') == [("image", None, "cap two")]
    nested = "<figure><figure><img src=1><figcaption>in</figcaption></figure><figure><img src=2></figure><img src=3><figcaption>out</figcaption></figure>end"
    assert brief(nested) == [("image", None, "in"), ("image", None, "out"), ("image", None, "out"), ("text", "end", None)]
    assert brief("<figure><figcaption>alone</figcaption></figure>") == [("text", "alone", None)]
    assert brief("<figcaption>no figure</figcaption>x") == [("text", "no figure", None), ("text", "x", None)]


def test_resolve_in_positions(spark):
    digest = hashlib.sha256(b"a").hexdigest()
    pages = spark.createDataFrame([(1, f'x<img src="sha256:{digest}">y<img src="lost">'), (2, None), (1, "again"), (None, "z")], "page_id long, html string")
    store = spark.createDataFrame([(digest, 10), (digest, 10)], "digest string, n_bytes long")
    out = media.resolve(media.sequences(pages), store, "page_id", ["n_bytes"]).collect()
    by = Counter((r.page_id, tuple((e.position, e.text, e.media.n_bytes if e.media else None) for e in r.elements)) for r in out)
    assert by == Counter([(1, ((0, "x", None), (1, None, 10), (2, "y", None), (3, None, None))), (2, ()), (1, ((0, "again", None),)), (None, ((0, "z", None),))])
