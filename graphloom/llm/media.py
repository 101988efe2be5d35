"""Media columns: interleaved document sequences.

HTML parses into an ordered sequence of elements: text, or a reference to a medium with its caption.  References name
payloads by digest.  A store holds each payload once per digest, as 8-bit mono PCM in a WAV container (lossless: one
sample per byte) with features computed from the stored samples.  A join by digest resolves the references; positions
and captions stay aligned because the sequence itself never changes, only its references gain columns.
"""

from __future__ import annotations

import hashlib
import io
import re
import wave
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed
from .html import RAW, RAW_END, SHOWN_RAW, TAG

PAD = 64
RATE = 8000  # samples a second that the container states
SCHEME = "sha256:"
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
MEDIA_TAGS = frozenset(("img", "audio", "video", "source", "embed"))
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def sequence(page: str | None) -> list[dict]:
    """Elements in page order.  Text runs are one element up to the next medium or block; a figure's caption, else the
    alternative text, is its medium's caption.  Scripts, styles and the like are no text; a tag that is never closed ends with
    the page.  Time grows in proportion to the page, however malformed.  Null or empty: no elements."""
    out: list[dict] = []
    text: list[str] = []
    figure: dict | None = None
    caption: list[str] | None = None

    def flush() -> None:
        s = " ".join(unescape("".join(text)).split())
        text.clear()
        if s:
            out.append({"position": len(out), "kind": "text", "text": s, "digest": None, "caption": None})

    at, page = 0, page or ""
    while at < len(page):
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        (text if caption is None else caption).append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in RAW and tag not in SHOWN_RAW and not m[1]:
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else len(page)
        elif tag in MEDIA_TAGS and not m[1]:
            a = {k.lower(): unescape(x or y or z) for k, x, y, z in _ATTR.findall(m[3])}
            src = a.get("src", "")
            if src:
                flush()
                figure = {"position": len(out), "kind": "media", "text": None, "digest": src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, "caption": a.get("alt")}
                out.append(figure)
        elif tag == "figcaption":
            if not m[1]:
                flush()
                caption = []
            elif caption is not None:
                if figure is not None:
                    figure["caption"] = " ".join(unescape("".join(caption)).split())
                caption = None
        elif tag in ("p", "div", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "li", "section", "article", "br", "td", "tr"):
            flush()
            if tag == "figure":
                figure = None
    flush()
    return out


def sequences(pages: DataFrame, html_col: str = "html", out_col: str = "sequence") -> DataFrame:
    """``pages`` with ``out_col`` in place of ``html_col``; all other columns and rows stay."""
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep) + f"`{out_col}` {SEQUENCE}"
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([sequence(h) for h in b.column(len(keep)).to_pylist()], kind)], names=[*keep, out_col])

    return pages.select(*keep, html_col).mapInArrow(run, schema)


def encode(payload: bytes) -> bytes:
    """The payload with zeros up to a positive multiple of ``PAD`` bytes, as a WAV file of unsigned 8-bit samples."""
    size = max(PAD, -(-len(payload) // PAD) * PAD)
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload.ljust(size, b"\0"))
    return f.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def feature(samples: bytes) -> str:
    """Mean, root mean square around the mid level, share of crossings of it, and entropy of the samples' histogram."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    v = np.arange(256)
    mean, power = float((n * v).sum()) / len(x), float((n * (v - 128) ** 2).sum()) / len(x)
    p = n[n > 0] / len(x)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"mean={mean:.4f};rms={power**0.5:.4f};zcr={crossings / len(x):.6f};entropy={float(-(p * np.log2(p)).sum()):.4f}"


MEASURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(payloads: DataFrame, payload_col: str) -> DataFrame:
    """A row per payload: digest, n_bytes (unpadded) and media, the stored form.  Null payloads count as empty ones."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                raw = [x or b"" for x in b.column(0).slice(at, 256).to_pylist()]
                cols = [pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(x) for x in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["digest", "n_bytes", "media"])

    return payloads.select(F.col(payload_col).cast("binary")).mapInArrow(run, "digest string, n_bytes long, media binary")


def measured(stored: DataFrame) -> DataFrame:
    """``stored`` (digest, n_bytes, media) with the measures of the media, all taken from the stored bytes as they are
    read back, in place of the media."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                for media in part.column(2).to_pylist():
                    back = decode(media)
                    out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["digest", *(x.split()[0] for x in MEASURES.split(", "))])

    return stored.select("digest", "n_bytes", "media").mapInArrow(run, f"digest string, {MEASURES}")


def resolve(pages: DataFrame, stored: DataFrame, sequence_col: str = "sequence", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per media reference: ids, position, caption, digest and the stored payload's other columns (null if the
    store lacks the digest).  ``stored`` may repeat digests; equal digests are equal payloads, so one row of them counts."""
    # Written down, so that the join's sides come straight from their shuffles and a hot digest's partition can be split.
    once = materialise(stored.dropDuplicates(["digest"]).withColumnRenamed("digest", "s_digest_"), "store")
    refs = pages.select(*id_cols, F.explode(sequence_col).alias("x")).where("x.kind = 'media'").select(*id_cols, "x.position", "x.caption", "x.digest")
    return refs.join(once, F.col("digest") == F.col("s_digest_"), "left").drop("s_digest_")
