"""Interleaved documents with media columns.

``parse`` reads HTML into one ordered list of elements: text, and references to
media by digest with their captions. ``resolve`` joins references with a store
by digest and puts the sequence together again in its positions. Which columns
of the store go along is the caller's choice: payloads, or what is known of
them, so that bytes which thousands of documents share need not be copied.

``stored`` keeps a payload as a binary greymap: 8-bit samples in rows of 24, so
a payload is a multiple of 576 bytes; the sample bytes are read back from the
stored form, and all features come from what is read.

Null and empty HTML has no elements. A reference whose digest is not in the
store, or that names none, stays in its place with a null payload. A figure's
caption is that of the innermost figure; media of inner figures without one
take it too. A caption that is left open ends with its figure, or with the
page. Repeated rows are sequences of
their own; a digest stored twice resolves once, as equal digests are equal
payloads. Empty tables give no rows. Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, spread, table, texts

SIDE = 24
UNIT = SIDE * SIDE
ELEMENT = "position int, kind string, text string, digest string, source string, caption string"
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr td th section article blockquote pre br hr figure main".split())
_MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "source", "embed": "embed"}
_SILENT = frozenset(("script", "style", "template", "noscript"))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.said: list[str] = []
        self.silent = 0
        #: Open figures: the first of their elements, what their caption says so far, and whether it is open.
        self.figures: list[list] = []

    def flush(self):
        text, self.said = " ".join("".join(self.said).split()), []
        if not text:
            return
        if self.figures and self.figures[-1][2]:
            self.figures[-1][1].append(text)
        else:
            self.out.append({"kind": "text", "text": text, "digest": None, "source": None, "caption": None})

    def end_caption(self):
        self.flush()
        if self.figures:
            self.figures[-1][2] = False

    def end_figure(self):
        self.end_caption()
        first, said, _ = self.figures.pop()
        caption = " ".join(said)
        media = [e for e in self.out[first:] if e["kind"] != "text"]
        for e in media:
            if caption and not e.pop("captioned", False):
                e["caption"] = caption
            e["captioned"] = bool(caption) or e.get("captioned", False)
        if caption and not media:
            self.out.append({"kind": "text", "text": caption, "digest": None, "source": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCKS or tag in _MEDIA or tag == "figcaption":
            self.flush()
        if tag == "figcaption" and self.figures:
            self.figures[-1][2] = True
        if tag == "figure":
            self.end_caption()
            self.figures.append([len(self.out), [], False])
        if tag in _MEDIA:
            a = {k: v or "" for k, v in attrs}
            source = a.get("src", "")
            digest = a.get("data-digest") or (source if source.startswith("sha256:") else "")
            self.out.append({"kind": _MEDIA[tag], "text": None, "digest": digest.removeprefix("sha256:").lower() or None, "source": source or None, "caption": a.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            self.said.append(data)

    def close(self):
        super().close()
        while self.figures:
            self.end_figure()
        self.flush()


def parse(html: str | None) -> list[dict]:
    """Elements of a page in order; a figure's caption belongs to each of its media."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return [{"position": i, **{k: v for k, v in x.items() if k != "captioned"}} for i, x in enumerate(reader.out)]


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, elements: one ordered array for each row."""
    kind = pages.schema[key].dataType.simpleString()

    def work(batch):
        return batch.column(key), [parse(x) for x in batch.column(html).to_pylist()]

    return map_texts(spread(pages.select(key, html)), html, f"{key} {kind}, elements array<struct<{', '.join(c.replace(' ', ': ') for c in ELEMENT.split(', '))}>>", work)


def resolve(found: DataFrame, store: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row's elements with the store's ``columns`` in a struct ``media``, in their order.

    store: ``digest`` and the columns. The join is on digests alone; a digest
    that a third of all references name is split by adaptive execution, as the
    store's side has one row for it.
    """
    rows = found.withColumn("_row", F.monotonically_increasing_id()).select(key, "_row", F.explode_outer("elements").alias("e")).select(key, "_row", "e.*")
    # dealt by another column, so that the join deals both sides itself and Spark can split a digest that many rows name
    single = store.groupBy("digest").agg(*(F.min(c).alias(c) for c in columns)).repartition(columns[0]).select(F.col("digest").alias("_digest"), F.struct(*columns).alias("media"))
    joined = rows.join(single, rows["digest"] == single["_digest"], "left")
    element = F.struct("position", "kind", "text", "digest", "source", "caption", "media")
    packed = joined.groupBy(key, "_row").agg(F.sort_array(F.collect_list(F.when(F.col("position").isNotNull(), element))).alias("elements"))
    return packed.drop("_row")


# ------------------------------------------------------------- the stored form


def payload(text: bytes) -> bytes:
    """UTF-8 padded with bytes 255 to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def encode(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (SIDE, len(samples) // SIDE) + samples


def decode(stored: bytes) -> bytes:
    """The samples of a greymap that ``encode`` wrote."""
    magic, size, most, body = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(body) != width * height:
        raise ValueError("not a stored payload")
    return body


def features(samples: bytes) -> str:
    """Width, height, and mean, spread and share of white samples."""
    x = np.frombuffer(samples, dtype=np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.uint32) ** 2).sum(dtype=np.int64))
    mean = total / len(x)
    return f"{SIDE}x{len(x) // SIDE};mean={mean:.4f};std={max(0.0, square / len(x) - mean * mean) ** 0.5:.4f};white={np.count_nonzero(x == 255) / len(x):.6f}"


def stored(docs: DataFrame, keep: bool = False) -> DataFrame:
    """What the store holds for each row's text, read back; ``keep`` adds the stored bytes as ``media``."""

    def work(batch):
        out = []
        for text in texts(batch):
            media = encode(payload(text))
            read = decode(media)
            out.append((hashlib.sha256(read).hexdigest(), len(text), len(read), zlib.crc32(read[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(read)) + ((media,) if keep else ()))
        return batch.column("doc_id"), *zip(*out, strict=True)

    schema = "doc_id long, digest string, n_bytes long, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if keep else "")
    return map_texts(docs.select("doc_id", "text"), "text", schema, work)


def as_pages(docs: DataFrame) -> DataFrame:
    """doc_id, html: a page for each row that tells its length and shows one figure, whose payload is its text and whose caption its id."""

    def work(batch):
        ids = batch.column("doc_id")
        own = texts(batch)
        html = [f'<p>{len(t)}</p><figure><img src="sha256:{hashlib.sha256(payload(t)).hexdigest()}"><figcaption>{"" if i is None else i}</figcaption></figure>' for i, t in zip(ids.to_pylist(), own, strict=True)]
        return ids, html

    return map_texts(docs, "text", "doc_id long, html string", work)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page of text and a captioned figure, parsed to its sequence and resolved by digest.

    What the store knows of a payload goes along and not its bytes: they would
    cross two shuffles more, and a payload that a third of all documents share
    would be copied as often.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["media_sha256", "payload_bytes", "tail_crc32", "media_bytes", "feature"]
    found = resolve(sequences(as_pages(docs), "doc_id", "html"), stored(docs), "doc_id", names)
    text, figure = F.get("elements", F.lit(0)), F.get("elements", F.lit(1))
    return found.select("doc_id", text["text"].cast("long").alias("n_bytes"), figure["digest"].alias("payload_sha256"), *(figure["media"][c].alias(c) for c in names), figure["caption"].alias("caption"))
