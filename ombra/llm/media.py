"""Media columns: interleaved documents of text and media, with payloads stored by digest.

``sequences`` parses HTML into the ordered parts of a document: text structs, and media structs
with reference, position and caption (a figure's caption or an image's alternative text).
``store`` keeps each distinct payload once, as a lossless 8-bit grey PNG 64 samples wide, under
its digest; ``resolve`` joins references with the store by digest, so positions and captions stay
with what they belong to.

Defined results: a null text or page is empty; an empty payload is padded to 64 zero bytes; equal
payloads have one stored form; a reference without a stored payload resolves to nulls and keeps
its place; a page without parts gives an empty sequence; equal rows give equal rows; other columns
of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from hashlib import sha256
from html import escape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ombra.llm.common import documents, map_rows, text_bytes, written

WIDTH = 64
SCHEME = "sha256:"
PNG = b"\x89PNG\r\n\x1a\n"
PART = "struct<kind:string,position:int,text:string,ref:string,caption:string>"
#: Elements that end a run of text, and elements whose content isn't text.
BLOCKS = frozenset("p div section article header footer figure figcaption h1 h2 h3 h4 h5 h6 ul ol li table tr td th br hr pre blockquote main nav".split())
SKIPPED = frozenset(("script", "style", "noscript", "template"))
MEDIA = frozenset(("img", "video", "audio", "source"))


class Sequence(HTMLParser):
    """Ordered parts of a page. A figure's media get its caption, wherever in the figure it stands.

    A caption left open ends with its figure, or with the page; the first of two captions counts.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        #: Open figures: their media, and their caption once it is known.
        self.figures: list[tuple[list[dict], list[str]]] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.parts.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def captioned(self) -> None:
        if self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            if text and self.figures:
                self.figures[-1][1].append(text)

    def closed(self) -> None:
        """The end of the innermost figure."""
        self.captioned()
        media, captions = self.figures.pop()
        for part in media if captions else ():
            part["caption"] = captions[0]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip += 1
        if tag in BLOCKS or tag in MEDIA:
            self.flush()
        if tag == "figure":
            self.captioned()
            self.figures.append(([], []))
        elif tag == "figcaption" and self.figures:
            self.captioned()
            self.caption = []
        elif tag in MEDIA and (ref := dict(attrs).get("src")):
            part = {"kind": "media", "text": None, "ref": ref, "caption": dict(attrs).get("alt") or None}
            self.parts.append(part)
            if self.figures:
                self.figures[-1][0].append(part)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption":
            self.captioned()
        if tag in BLOCKS:
            self.flush()
        if tag == "figure" and self.figures:
            self.closed()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)

    def ended(self) -> list[dict]:
        self.close()
        while self.figures:
            self.closed()
        self.flush()
        return [p | {"position": n} for n, p in enumerate(self.parts)]


def parse(html: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(html or "")
    return parser.ended()


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows (id, parts): the ordered text and media parts of each page."""

    def rows(ids: list, pages: list) -> Iterable[tuple]:
        for i, html in zip(ids, pages, strict=True):
            yield i, parse(html)

    return map_rows(pages, [F.col(id_col).cast("long"), F.col(html_col)], f"id long, parts array<{PART}>", rows)


def padded(data: bytes) -> bytes:
    """With zero bytes up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, without filters."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; anything else, or damage, is an error."""
    if stored[:8] != PNG:
        raise ValueError("not a PNG")
    at, head, data = 8, None, []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[0] != WIDTH or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of this store")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean and spread of the samples, and a 64-bit hash of which columns are over the mean."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    total, squares = int(rows.sum(dtype=np.int64)), int(np.bincount(rows.ravel(), minlength=256) @ np.arange(256, dtype=np.int64) ** 2)
    columns = rows.sum(axis=0, dtype=np.int64)
    bits = np.packbits(columns * WIDTH > total).tobytes().hex()
    spread = squares * rows.size - total * total
    return f"rows={len(rows)};mean={total / rows.size:.6f};var={spread / rows.size**2:.6f};columns={bits}"


STORED = "digest string, media binary, n_bytes long"


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (digest, media, n_bytes): the stored form of each text's payload, named by the digest of the unpadded bytes."""

    def rows(texts: list) -> Iterable[tuple]:
        for data in texts:
            yield sha256(data).hexdigest(), to_png(padded(data)), len(data)

    return map_rows(docs, [text_bytes(text_col)], STORED, rows)


def features(media: DataFrame) -> DataFrame:
    """Rows (digest, n_bytes, payload_bytes, ...): what the stored bytes give when read back, one for each digest."""

    def rows(digests: list, stored: list, sizes: list) -> Iterable[tuple]:
        for digest, png, size in zip(digests, stored, sizes, strict=True):
            payload = from_png(png)
            yield digest, size, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), sha256(png).hexdigest(), feature(payload)

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(media, ["digest", "media", "n_bytes"], schema, rows).dropDuplicates(["digest"])


def resolve(parts: DataFrame, media: DataFrame) -> DataFrame:
    """Rows (id, position, caption, digest, and the columns of ``media``): every media part of ``parts`` with what the store has of it."""
    refs = parts.select("id", F.explode("parts").alias("part")).where("part.kind = 'media'")
    digest = F.when(F.col("part.ref").startswith(SCHEME), F.substring("part.ref", len(SCHEME) + 1, 64))
    refs = refs.select("id", F.col("part.position").alias("position"), F.col("part.caption").alias("caption"), digest.alias("digest"))
    return refs.join(media, "digest", "left").select("id", "position", "caption", "digest", *(c for c in media.columns if c != "digest"))


def interleaved(parts: DataFrame, media: DataFrame) -> DataFrame:
    """``parts`` (id, parts, and any others) with ``media``: the resolved parts in order, structs of (position, caption, digest, and the columns of the store)."""
    numbered, _ = written(parts.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("page")), "media")
    found = resolve(numbered.select(F.col("row").alias("id"), "page.parts"), media)
    lists = found.groupBy(F.col("id").alias("row")).agg(F.sort_array(F.collect_list(F.struct(*(c for c in found.columns if c != "id")))).alias("media"))
    whole = numbered.join(lists, "row", "left")
    return whole.select("page.*", F.coalesce("media", F.array().cast(lists.schema["media"].dataType)).alias("media"))


def page_of(text: str, refs: list[tuple[str, str]]) -> str:
    """A page of all lines of a text as paragraphs, with figures (digest, caption) dealt out between them and the last one at the end."""
    lines = text.split("\n")
    figures = [f'<figure><img src="{SCHEME}{d}" alt="none"><figcaption>{escape(c)}</figcaption></figure>' for d, c in refs]
    step = max(1, len(lines) // max(1, len(figures)))
    body = [f"<p>{escape(line)}</p>" for line in lines]
    for n in range(len(figures) - 1, -1, -1):
        body.insert(len(lines) if n == len(figures) - 1 else min(len(lines), (n + 1) * step), figures[n])
    return f"<html><body>{''.join(body)}</body></html>"


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Each document becomes a page of its whole text with its payload shown twice, in the middle and at the end; one row for each.

    The payload's columns come from the stored form that the references resolve to. ``positions`` and
    ``captions`` are those of the resolved media, ``n_parts`` counts all parts of the page, and
    ``text_sha256`` is of the text parts joined by line ends. Odd rows as at the top.
    """
    docs = documents(spark, sf_dir)

    def rows(ids: list, texts: list) -> Iterable[tuple]:
        for i, data in zip(ids, texts, strict=True):
            digest, size = sha256(data).hexdigest(), len(data)
            yield i, page_of(data.decode(), [(digest, f"payload of {size} bytes"), (digest, f"end of {i}")])

    pages = map_rows(docs, [F.col("doc_id").cast("long"), text_bytes()], "page_id long, html string", rows)
    # written, so that adaptive execution may split the join where a payload has many copies
    made, _ = written(features(store(docs)), "media")
    # what is asked of the text is worked out beside it; only the media parts go on
    texts = F.transform(F.filter("parts", lambda p: p["kind"] == "text"), lambda p: p["text"])
    pages = sequences(pages).select("id", F.size("parts").cast("long").alias("n_parts"), F.sha2(F.array_join(texts, "\n").cast("binary"), 256).alias("text_sha256"), F.filter("parts", lambda p: p["kind"] == "media").alias("parts"))
    found = interleaved(pages, made)
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    resolved = F.filter("media", lambda m: m["n_bytes"].isNotNull())
    return found.select(
        F.col("id").alias("doc_id"),
        *(F.get(F.col(f"media.{n}"), F.lit(0)).alias(n) for n in names),
        F.array_join(F.transform(resolved, lambda m: m["position"].cast("string")), ",").alias("positions"),
        F.array_join(F.transform(resolved, lambda m: m["caption"]), "|").alias("captions"),
        "n_parts",
        "text_sha256",
    )
