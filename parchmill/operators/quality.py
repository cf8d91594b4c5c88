"""Useless pages, exact duplicates, and what becomes of each page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from .profile import running_total

LEAST_CHARS = 50
LEAST_WORDS = 10
MOST_URL = 0.8
#: Pages that only greet.
GREETINGS = r"^(bienvenue\s*!?|welcome\s*!?|accueil|home)\s*$"


def useless_reason(collapsed: Column, has_images: Column | None = None) -> Column:
    """empty, too_short, too_few_words or greeting, the first that applies; null for a page of use. Pages with images always are.

    collapsed is the text after functions.text.collapse, null counting as empty: a column of its own, so that it is made once.
    """
    images = F.coalesce(has_images, F.lit(False)) if has_images is not None else F.lit(False)
    t = F.coalesce(collapsed, F.lit(""))
    words = F.size(F.filter(F.split(t, " "), lambda w: F.length(w) > 2))
    return F.when(images, F.lit(None)).when(t == "", "empty").when(F.length(t) < LEAST_CHARS, "too_short").when(words < LEAST_WORDS, "too_few_words").when(F.lower(t).rlike(GREETINGS), "greeting")


def url_only(text: Column, has_images: Column | None = None) -> Column:
    images = F.coalesce(has_images, F.lit(False)) if has_images is not None else F.lit(False)
    return ~images & (F.coalesce(tx.url_share(text), F.lit(0.0)) > MOST_URL)


def has_image(html: Column) -> Column:
    """An image element, an inline image or the word base64."""
    return html.rlike(r"(?i)<img\b|data:image/|base64")


def first_occurrences(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """original: the least id of the rows with the same key.

    It is found by an aggregate, which combines on the map side, and joined; rows of a key that a third of all share aren't
    sorted in one task, and AQE splits them in the join.
    """
    return df.join(df.groupBy(key).agg(F.min(id_col).alias("original")), key)


def dispositions(pages: DataFrame, text: str, id_col: str, has_images: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..., disposition, reason, original): disposition is kept, kept_with_images, useless, url_only or duplicate.

    Rules in this order: useless, then addresses only, then duplicates; a page that is removed is never an original. Texts are read once:
    what is judged of them is written before the duplicates are looked for. Ids are unique; null texts count as empty.
    """
    images = F.coalesce(F.col(has_images), F.lit(False)) if has_images else F.lit(False)
    once = pages.select(id_col, *keep, images.alias("_images"), text, tx.collapse(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    reasons = once.withColumn("reason", useless_reason(F.col("_t"), F.col("_images"))).withColumn("_url", url_only(F.col(text), F.col("_images")))
    out = F.when(F.col("reason").isNotNull(), "useless").when(F.col("_url"), "url_only")
    # A removed page has a key of its own, so that the rest is one pass over all.
    key = F.when(F.col("reason").isNull() & ~F.col("_url"), F.sha2(F.lower("_t"), 256)).otherwise(F.concat(F.lit("-"), F.col(id_col).cast("string")))
    narrow = cut_lineage(reasons.select(id_col, *keep, "_images", "reason", out.alias("_out"), key.alias("_key")))
    found = first_occurrences(narrow, "_key", id_col)
    copy = F.col("original") != F.col(id_col)
    label = F.coalesce(F.col("_out"), F.when(copy, "duplicate").when(F.col("_images"), "kept_with_images").otherwise("kept"))
    return found.select(id_col, *keep, label.alias("disposition"), "reason", F.when(F.col("_out").isNull() & copy, F.col("original")).alias("original"))


def disposition_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def duplicate_map(judged: DataFrame, id_col: str) -> DataFrame:
    """original and its duplicates, a row each, numbered in order by ranges: a page copied a million times is in no single task."""
    copies = judged.filter("disposition = 'duplicate'").select("original", F.col(id_col).alias("duplicate"), F.lit(1).alias("_1"))
    return running_total(copies, ["original"], ["duplicate"], "_1", "ordinal").drop("_1")


def size_reduction(judged: DataFrame, size: Column) -> DataFrame:
    """Bytes before and after, and the reduction in percent."""
    kept = F.col("disposition").startswith("kept")
    sums = judged.select(size.alias("b"), kept.alias("k")).agg(F.sum("b").alias("bytes_before"), F.sum(F.when(F.col("k"), F.col("b")).otherwise(0)).alias("bytes_after"))
    return sums.select("bytes_before", "bytes_after", tx.human_size(F.col("bytes_before")).alias("size_before"), tx.percent(F.col("bytes_before") - F.col("bytes_after"), F.col("bytes_before"), 2).alias("reduction_percent"))
