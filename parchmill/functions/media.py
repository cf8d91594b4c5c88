"""Images, tables and code in text: counts, positions and context; types of image data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import udfs

#: Patterns of marks. Image marks have both spellings, [IMAGE_12] and [IMAGE: name]. A character other than a line feed is a class, as the dot
#: leaves out more line ends on the JVM side.
IMAGE = r"!\[[^\n]*?\]\([^\n]*?\)|<img[^>]*>|\[IMAGE[^\]]*\]|\[IMG[_\d]*\]|<IMAGE[^>]*>"
TABLE_ROW = r"\|[^\n]+\|[^\n]+\|"
CODE = r"```[\s\S]*?```|`[^`\n]+`"

#: Extensions of image media types.
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp", "image/svg+xml": "svg"}
#: Media type of each extension.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml"}
#: Least size of image data.
LEAST_BYTES = 100


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def features(text: Column) -> Column:
    """Struct of counts and of the first marks, rows and code blocks."""
    images, rows, code = _all(text, "(?i)" + IMAGE), _all(text, TABLE_ROW), _all(text, CODE)
    return F.struct(
        F.size(images).alias("total_images"), F.size(rows).alias("total_tables"), F.size(code).alias("total_code_blocks"),
        ((F.size(images) > 0) | (F.size(rows) > 0)).alias("has_media"),
        F.slice(images, 1, 20).alias("image_summary"), F.slice(rows, 1, 10).alias("table_summary"),
        F.transform(code, lambda c: F.substring(c, 1, 200)).alias("code_blocks"),
    )


def positions(text: Column, pattern: str, start: Column | None = None, context: int = 60) -> Column:
    """Array of (marker, ordinal, char_in_chunk, char_absolute, line_number, before, after, marker_length), in order.

    Offsets are those of each occurrence, not of the first equal one: the text between the occurrences and their lengths are added up.
    The pattern must have no group.
    """
    found = _all(text, pattern)
    between = F.split(text, pattern, -1)
    start = F.coalesce(start, F.lit(0)) if start is not None else F.lit(0)

    # Each occurrence begins after the texts and marks before it: one running sum of both.
    steps = F.transform(found, lambda m, i: F.length(F.element_at(between, i + 1)) + F.when(i > 0, F.length(F.element_at(found, i))).otherwise(0))
    at_each = F.zip_with(udfs.starts(steps), steps, lambda s, n: (s + n).cast("int"))

    def item(m: Column, i: Column) -> Column:
        marker, at = m["marker"], m["at"]
        head = F.substring(text, F.lit(1), at)
        return F.struct(
            marker.alias("marker"), (i + 1).alias("ordinal"), at.alias("char_in_chunk"), (start + at).cast("long").alias("char_absolute"),
            (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("line_number"),
            F.substring(text, F.greatest(at - context, F.lit(0)) + 1, F.least(at, F.lit(context))).alias("before"),
            F.substring(text, at + F.length(marker) + 1, F.lit(context)).alias("after"), F.length(marker).alias("marker_length"),
        )

    return F.transform(F.arrays_zip(found.alias("marker"), at_each.alias("at")), item)


def mark_id(marker: Column, kind: str, ordinal: Column) -> Column:
    """Name within a mark such as [IMAGE: a.png], else kind and number."""
    own = F.trim(F.regexp_extract(marker, rf"(?i)\[{kind}[:\s_]+([^\]]+)\]", 1))
    return F.when(own != "", own).otherwise(F.concat(F.lit(f"{kind.lower()}_"), ordinal.cast("string")))


def data_type(data: Column) -> Column:
    """Extension by the first bytes: png, jpg, gif, bmp, webp or svg; null for other or fewer than eight bytes."""
    h = F.hex(F.substring(data, 1, 12))
    text = F.substring(data, 1, 200).cast("string")
    return F.when(
        F.octet_length(data) >= 8,
        F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpg").when(h.startswith("474946383761") | h.startswith("474946383961"), "gif")
        .when(h.startswith("424D"), "bmp").when(h.startswith("52494646") & h.contains("57454250"), "webp")
        .when(text.startswith("<svg") | (text.startswith("<?xml") & text.contains("<svg")), "svg"),
    )


def extension_of(content_type: Column, data: Column) -> Column:
    """By the media type, else by the data."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(content_type)), data_type(data))


def is_image(content_type: Column, data: Column) -> Column:
    """Large enough, and of an image's type or, as plain octets, with an image's first bytes."""
    octets = F.lower(content_type) == "application/octet-stream"
    ok = F.when(octets, data_type(data).isNotNull()).otherwise(F.lower(content_type).startswith("image/") & extension_of(content_type, data).isNotNull())
    return F.coalesce((F.octet_length(data) >= LEAST_BYTES) & ok, F.lit(False))


def data_uri(src: Column) -> Column:
    """Struct (format, data, extension) of an inline image; null where it is none, can't be decoded or is too small."""
    fmt = F.lower(F.regexp_extract(src, r"data:image/([^;,]+)(?:;base64)?,([A-Za-z0-9+/=\s]+)", 1))
    body = F.regexp_replace(F.regexp_extract(src, r"data:image/([^;,]+)(?:;base64)?,([A-Za-z0-9+/=\s]+)", 2), r"\s", "")
    data = F.try_to_binary(body, F.lit("base64"))
    return F.when((fmt != "") & (F.octet_length(data) >= LEAST_BYTES), F.struct(fmt.alias("format"), data.alias("data"), F.coalesce(data_type(data), fmt).alias("extension")))
