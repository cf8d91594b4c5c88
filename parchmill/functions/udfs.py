"""Arrow functions for what Spark has no expression for: decoding, MIME parts, HTML trees, hashed embeddings.

Tokenizers, sentence splitters, scorers and embedders are plug-ins: a function on a pandas Series each.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable
from email import message_from_bytes, policy

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from . import html

#: What C1 controls stand for in text from Windows.
WINDOWS = {0xA0: " ", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x96: "–", 0x97: "—"}

MIME = StructType(
    [
        StructField("html", StringType()),
        StructField("has_images", BooleanType()),
        StructField("parts", ArrayType(StructType([StructField("content_type", StringType()), StructField("data", BinaryType())]))),
        StructField("error", StringType()),
    ]
)


def _read(data: bytes, charset: str) -> str | None:
    """The text, None where the charset lacks a byte or much is lost."""
    text = data.decode(charset, "replace")
    bad = text.count("�")
    was = data.count("�".encode()) if charset == "utf-8" else 0  # such characters may be in the file itself
    return text if bad == was and bad <= len(text) / 100 else None


def decode(data: bytes | None) -> str | None:
    """UTF-8 or, where that fails or more than 1 % is lost, Windows-1252; UTF-8 with losses where neither fits. Line ends and composed characters made uniform."""
    if data is None:
        return None
    fits = next((t for t in (_read(bytes(data), c) for c in ("utf-8", "cp1252")) if t is not None), None)
    text = bytes(data).decode("utf-8", "replace") if fits is None else fits
    return unicodedata.normalize("NFC", re.sub("\r\n?", "\n", text.translate(WINDOWS)))


def mime_parts(data: bytes | None) -> dict | None:
    """First HTML part, whether there are images, and the parts that may be images; an error is kept as text."""
    if data is None:
        return None
    try:
        message = message_from_bytes(bytes(data), policy=policy.default)
        page, images, parts = None, False, []
        for part in message.walk():
            kind = part.get_content_type()
            if kind == "text/html" and page is None:
                charset = part.get_content_charset() or "utf-8"
                body = part.get_payload(decode=True) or b""
                try:
                    page = body.decode(charset)
                except (LookupError, UnicodeDecodeError):
                    page = decode(body)
            elif kind.startswith("image/") or kind == "application/octet-stream":
                images = images or kind.startswith("image/")
                parts.append({"content_type": kind, "data": part.get_payload(decode=True)})
        if page is None:
            page = bytes(data).decode("utf-8", "ignore")
        return {"html": page, "has_images": images or html.has_images(page), "parts": parts, "error": None}
    except Exception as e:  # a broken file is a row with an error, not the end of the job
        return {"html": None, "has_images": None, "parts": [], "error": f"{type(e).__name__}: {e}"}


def _each(function: Callable, kind):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else function(x))

    return run


composed = _each(lambda x: unicodedata.normalize("NFC", x), StringType())
starts = _each(lambda sizes: np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)[:-1])) if len(sizes) else [], ArrayType(LongType()))
cleaned = _each(html.clean, StringType())
visible_text = _each(html.visible_text, StringType())
text_lines = _each(html.text_lines, StringType())
marked_text = _each(html.marked_text, StringType())
tables = _each(html.tables, ArrayType(ArrayType(ArrayType(StringType()))))
inline_images = _each(html.inline_images, ArrayType(StringType()))


@F.pandas_udf(MIME)
def parsed_mime(s: pd.Series) -> pd.DataFrame:
    rows = [mime_parts(x) or {} for x in s]
    return pd.DataFrame({f.name: [r.get(f.name) for r in rows] for f in MIME.fields})


#: What the bytes 80 to 9F are in Windows-1252, in order; five are undefined.
WINDOWS_HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def decoded(content: Column | str) -> Column:
    """decode() by expressions: validity and charset are tested on the JVM side; only texts with combining marks go to Python."""
    content = F.col(content) if isinstance(content, str) else content
    raw = content.cast("string")
    whole = F.when(F.is_valid_utf8(raw), raw)
    lost = F.length(whole) - F.length(F.replace(whole, F.lit("\ufffd"), F.lit("")))
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), WINDOWS_HIGH)
    windows = F.when(~latin.rlike("[\x81\x8d\x8f\x90\x9d]"), latin)
    text = F.coalesce(F.when(lost * 100 <= F.length(whole), whole), windows, F.make_valid_utf8(raw))
    named = F.translate(text, "".join(map(chr, WINDOWS)), "".join(WINDOWS.values()))
    plain = F.regexp_replace(named, "\r\n?", "\n")
    return F.coalesce(composed(F.when(plain.rlike(r"\p{M}"), plain)), plain)


def latin_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are none."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """Column function from a tokenizer's counting function; an error counts as 0."""

    @F.pandas_udf(IntegerType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return count(x) if x else 0
            except Exception:
                return 0

        return s.map(one).astype("int32")

    return run


def hashed_embedding(text: str, dimensions: int) -> np.ndarray:
    """Unit vector of hashed word counts, log-damped: the embedder where no model is given."""
    v = np.zeros(dimensions, dtype=np.float32)
    for w in re.findall(r"[^\W_]+", text.lower()):
        h = zlib.crc32(w.encode())
        v[h % dimensions] += 1 if h & 0x80000000 else -1
    v = np.sign(v) * np.log1p(np.abs(v))
    n = np.linalg.norm(v)
    return v / n if n else v


def embedder(dimensions: int = 64, embed: Callable[[str, int], np.ndarray] = hashed_embedding) -> Callable[[Column], Column]:
    @F.pandas_udf(ArrayType(FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: embed(x or "", dimensions))

    return run
