"""Companion files, incremental work lists, and rows replaced by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_companion(texts: DataFrame, companions: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Each text with the path of its companion on the keys (folder and stem), null where there is none; of several the least path."""
    one = companions.groupBy(*keys).agg(F.min(path).alias("companion"))
    return texts.join(one, list(keys), "left")


def standalone(companions: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Companions of no text."""
    return companions.join(texts.select(*keys).distinct(), list(keys), "left_anti")


def paired_with_fallback(metas: DataFrame, first: DataFrame, second: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Metadata files with their text file, of the first kind or else of the second; those without either are left out."""
    a = first.groupBy(*keys).agg(F.min(path).alias("_a"))
    b = second.groupBy(*keys).agg(F.min(path).alias("_b"))
    return metas.join(a, list(keys), "left").join(b, list(keys), "left").withColumn("text_path", F.coalesce("_a", "_b")).filter("text_path is not null").drop("_a", "_b")


def chunk_texts(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(file, chunk_id, text, whole): the chunks of files with `--- Chunk n … ---` headers, and every file whole with a null chunk_id if it has none."""
    header = r"(?m)^---\s*Chunk\s+\d+.*?---[ \t]*$"
    ids = F.regexp_extract_all(text_col, F.lit(r"(?m)^---\s*Chunk\s+(\d+).*?---[ \t]*$"), 1)
    bodies = F.slice(F.split(text_col, header, -1), F.lit(2), F.size(ids))
    clean = F.transform(bodies, lambda b: F.regexp_replace(F.regexp_replace(b, r"^\s+|\s+$", ""), r"\s*---$", ""))
    zipped = F.arrays_zip(ids.alias("i"), clean.alias("t"))
    rows = files.select(F.col(id_col).alias("file"), F.explode_outer(zipped).alias("z"), F.regexp_replace(text_col, r"^\s+|\s+$", "").alias("whole"))
    return rows.select("file", F.col("z.i").cast("long").alias("chunk_id"), F.col("z.t").alias("text"), F.when(F.col("z").isNull(), F.col("whole")).alias("whole"))


def match_texts(metas: DataFrame, texts: DataFrame) -> DataFrame:
    """Metadata rows (file, chunk_id, ...) with their text: by chunk id, or the whole file if it has no headers and one row of metadata."""
    counts = metas.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    by_id = texts.filter("chunk_id is not null").select("file", "chunk_id", "text")
    whole = texts.filter("chunk_id is null").select("file", "whole")
    joined = metas.join(counts, "file").join(by_id, ["file", "chunk_id"], "left").join(whole, "file", "left")
    return joined.withColumn("text", F.coalesce("text", F.when(F.col("_n") == 1, F.col("whole")))).filter("text is not null").drop("_n", "whole")


def changes(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """change (new, changed, unchanged) of each row of now."""
    old = before.select(key, F.col(digest).alias("_old")).distinct()
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col(digest), "unchanged").otherwise("changed")
    return now.join(old, key, "left").withColumn("change", state).drop("_old")


def pending(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows that are new or changed."""
    return now.join(before.select(key, digest).distinct(), [key, digest], "left_anti")


def replaced(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows without those of the fresh keys, and the fresh rows."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def memoised(wanted: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """(all results, those computed now): looked up in the cache, computed only where missing. compute: DataFrame -> DataFrame with the cache's columns."""
    missing = wanted.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    fresh = compute(missing)
    return wanted.select(key).distinct().join(cache.unionByName(fresh), key), fresh


def with_descendants(roots: DataFrame, children: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent is among the roots: what a cascading delete takes away."""
    return children.join(roots.select(parent_key).distinct(), parent_key, "left_semi")


def matched_media(marks: DataFrame, companions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks with the companion's record of the same mark, null where it has none."""
    return marks.join(companions.dropDuplicates(list(keys)), list(keys), "left")
