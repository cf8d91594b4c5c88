"""Scalar derivations on text, Column -> Column, all on the JVM side.

White space is ASCII unless a function says otherwise; lengths and offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Windows forbids in file names.
FORBIDDEN_IN_NAMES = '<>:"/|?*\\'
#: Closing marks that can't begin a sentence.
CLOSING_MARKS = ",.;:!?)]}"


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_key(text: Column) -> Column:
    """SHA-256 of the lower-cased, collapsed text."""
    return F.sha2(collapse(F.lower(text)), 256)


def text_md5(text: Column) -> Column:
    return F.md5(text)


def pair_key(original: Column, piece: Column) -> Column:
    """Key of a scored piece: head of its original and the piece itself."""
    return F.md5(F.concat(F.substring(original, 1, 500), F.lit("|||"), piece))


def word_list(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    t = collapse(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_count(text: Column) -> Column:
    t = collapse(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def token_estimate(text: Column) -> Column:
    """Four characters a token."""
    return F.floor(F.length(text) / 4).cast("long")


def long_word_count(text: Column) -> Column:
    """Words of three or more characters."""
    return F.size(F.filter(word_list(text), lambda w: F.length(w) > 2))


def url_share(text: Column) -> Column:
    """Share of the characters that belong to web addresses; 0 for an empty text."""
    urls = F.regexp_extract_all(text, F.lit(r"(?i)(https?://\S+)"), 1)
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.aggregate(urls, F.lit(0), lambda s, u: s + F.length(u)) / F.length(text))


def visible_text(html: Column) -> Column:
    """Text of a page by expressions: without scripts, styles, comments and tags. udfs.visible_text parses instead."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return collapse(t)


def human_size(n: Column) -> Column:
    """Bytes with a unit, in steps of 1,024."""
    out = F.format_string("%.2f TB", n / F.lit(1024.0**4))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", n / F.lit(1024.0**k))).otherwise(out)
    return out


def safe_name(name: Column) -> Column:
    """File name without forbidden characters, at most 100 long."""
    return F.substring(F.translate(name, FORBIDDEN_IN_NAMES, "_" * len(FORBIDDEN_IN_NAMES)), 1, 100)


def path_parts(path: Column) -> dict[str, Column]:
    """file, folder_path, folder_name, folder_depth, space (first folder, or root), stem and extension of a relative path."""
    p = F.translate(path, "\\", "/")
    parts = F.split(p, "/")
    depth = F.size(parts) - 1
    file = F.element_at(parts, -1)
    return {
        "file": file,
        "folder_path": F.array_join(F.slice(parts, 1, depth), "/"),
        "folder_name": F.when(depth > 0, F.element_at(parts, -2)).otherwise(""),
        "folder_depth": depth,
        "space": F.when(depth > 0, F.element_at(parts, 1)).otherwise("root"),
        "stem": F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""),
        "extension": F.lower(F.regexp_extract(file, r".(\.[^.]*)$", 1)),
    }


def boundary_issue(piece: Column) -> Column:
    """The piece begins in mid-sentence: with a lower-case letter or a closing mark."""
    head = F.substring(F.regexp_replace(piece, r"^\s+", ""), 1, 1)
    lower = (F.lower(head) == head) & (F.upper(head) != head)
    return F.when(head == "", F.lit(False)).otherwise(lower | F.lit(CLOSING_MARKS).contains(head))


def start_in(original: Column, piece: Column) -> Column:
    """Offset of the piece's head (60 characters) in the original, 0 where it isn't found."""
    return F.greatest(F.instr(original, F.substring(piece, 1, 60)) - 1, F.lit(0))


def line_number(text: Column, offset: Column) -> Column:
    """Number, from 1, of the line that holds the offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def content_type(code_blocks: Column, tables: Column, images: Column) -> Column:
    """From counts: code before table before image_section before text."""
    return F.when(code_blocks > 0, "code").when(tables > 0, "table").when(images > 0, "image_section").otherwise("text")


def block_type(text: Column) -> Column:
    """From the text: code, table, bullet_list, numbered_list, image_section or prose."""
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(text.contains("[CODE") | text.contains("```") | text.rlike(r"(?m)^[ \t]{4,}\S"), "code")
        .when(text.contains("[TABLE") | (pipes >= 4), "table")
        .when(text.rlike(r"(?m)^[ \t]*[-*•][ \t]"), "bullet_list")
        .when(text.rlike(r"(?m)^[ \t]*\d+[.)][ \t]"), "numbered_list")
        .when(text.contains("[IMAGE"), "image_section")
        .otherwise("prose")
    )


def only_marker(text: Column) -> Column:
    """Nothing but an image or table mark, so nothing to score."""
    return text.rlike(r"(?i)^\s*(\[(IMAGE|TABLE|IMG)[^\]]*\]|<IMAGE[^>]*>)\s*$")


def shortened(text: Column, most: int, mark: str = "...") -> Column:
    """Cut to most characters, the mark included, where the text is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def preview(text: Column, most: int) -> Column:
    """The first characters, with a mark after them where more follow."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def title_of(text: Column, default: str) -> Column:
    """Title from an answer: quotes around it stripped, at most 60 characters, the default for a blank one."""
    t = F.trim(F.regexp_replace(F.trim(text), "^[\"'`]+|[\"'`]+$", ""))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(default)).otherwise(shortened(t, 60))


def model_role(role: Column) -> Column:
    """The assistant goes by another name in some interfaces."""
    return F.when(role == "assistant", "model").otherwise(role)


def slug(path: Column) -> Column:
    """Path of a page below its content folder, without index.md or .md."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"^.*/content/", "")
    return F.regexp_replace(F.regexp_replace(p, r"/index\.md$", ""), r"\.md$", "")


def title_from_slug(s: Column) -> Column:
    """Words between hyphens, each with its first letter as a capital."""
    parts = F.filter(F.split(s, "-"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 10_000))), " ")


def description_of(markdown: Column) -> Column:
    """The first 160 characters of a page's plain text."""
    t = F.regexp_replace(F.regexp_replace(markdown, r"(?m)^#+\s+", ""), r"(?s)```.*?```", "")
    return F.substring(collapse(F.regexp_replace(t, r"[*_`>#-]", " ")), 1, 160)


def route(path: Column) -> Column:
    """One leading slash, none at the end but for the root."""
    p = F.regexp_replace(F.concat(F.lit("/"), F.trim(path)), r"/{2,}", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/+$", ""))


def first_of(*values: Column) -> Column:
    """The first value that isn't null or blank: chains of metadata with fallbacks, messages out of error bodies."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))


def epoch_millis(iso: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(iso))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, 0 where the whole is nothing."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100, whole), F.lit(0.0)), digits)


#: Entities that help pages use, and the characters they stand for.
ENTITIES = (("&nbsp;", " "), ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"), ("&ccedil;", "ç"), ("&uuml;", "ü"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def entities_decoded(text: Column) -> Column:
    """The usual entities decoded, special blanks and characters without width made plain, by expressions; udfs.cleaned knows all entities."""
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return collapse(F.regexp_replace(F.regexp_replace(text, "[\u00a0\u2009\u202f]", " "), "[\u200b-\u200d\ufeff]", ""))


def error_message(body: Column) -> Column:
    """What an error body says: its detail, or else its first entry as `field: message`, of a list the first; null for no object."""
    fields = F.from_json(body, "map<string,string>")
    first = F.element_at(F.map_entries(fields), 1)
    said = F.coalesce(F.get_json_object(first["value"], "$[0]"), first["value"])
    return F.when(F.size(fields) > 0, F.coalesce(F.element_at(fields, "detail"), F.concat(first["key"], F.lit(": "), said)))


def prepended(values: Column, item: Column, most: int) -> Column:
    """The item before the values, at most so many of them."""
    return F.slice(F.concat(F.array(item), values), 1, most)
