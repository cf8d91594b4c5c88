"""Chunk entries of whole files: small texts pass through, others are cut and scored, then described."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media
from ..functions import text as tx
from .chunking import rechunk
from .pairing import matched_media
from .profile import global_rank

#: Texts of fewer tokens are one chunk as they are.
PASSTHROUGH = 400
LOW_CONTENT = 20
#: Scores of a chunk that wasn't judged.
UNJUDGED = 1.0


def validation_status(status: Column) -> Column:
    """accepted_max_depth keeps its name; every other way of being kept is accepted."""
    return F.when(status == "accepted_max_depth", status).otherwise("accepted")


def chunk_entries(files: DataFrame, id_col: str, text_col: str, scorer: Callable[[Column, Column], Column], first_id: int = 1, passthrough: int = PASSTHROUGH) -> DataFrame:
    """A row for each chunk: chunk_id (over all files, from first_id), chunk_no, total_chunks, text, counts, flags, media and status.

    Files are in order of id. Null and blank texts give no row.
    """
    rows = files.select(F.col(id_col).alias("id"), F.col(text_col).alias("original")).filter(F.trim("original") != "").withColumn("_n", tx.word_count(F.col("original")))
    small = rows.filter(F.col("_n") < passthrough).select(
        "id", F.array(F.lit(0)).alias("path"), F.col("original").alias("text"), F.lit(UNJUDGED).alias("score"), F.lit("original_untouched").alias("status"), F.lit("none").alias("method"), F.lit(0).alias("retry_depth"), F.lit(0).alias("start")
    )
    kept = rechunk(rows.filter(F.col("_n") >= passthrough), "id", "original", scorer)
    cut = kept.join(rows.select("id", "original"), "id").select(
        "id", "path", F.col("chunk").alias("text"), "score", "status", "method", "retry_depth", tx.start_in(F.col("original"), F.col("chunk")).alias("start")
    )
    ranked = global_rank(small.unionByName(cut), "id", "path", name="_rank")
    sizes = ranked.groupBy("id").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("total_chunks"))
    f = media.features(F.col("text"))
    out = ranked.join(sizes, "id").withColumn("_f", f)
    return out.select(
        (F.col("_rank") + first_id - 1).alias("chunk_id"), "id", (F.col("_rank") - F.col("_first") + 1).alias("chunk_no"), "total_chunks", "text", tx.word_count(F.col("text")).alias("token_count"), F.length("text").alias("char_count"),
        F.col("start").alias("chunk_start_position"), "method", "status", "retry_depth", (tx.word_count(F.col("text")) < LOW_CONTENT).alias("low_content"), tx.boundary_issue(F.col("text")).alias("boundary_issue"),
        validation_status(F.col("status")).alias("validation_status"), "score", "_f.total_images", "_f.total_tables", "_f.total_code_blocks", "_f.has_media", "_f.image_summary",
        tx.content_type(F.col("_f.total_code_blocks"), F.col("_f.total_tables"), F.col("_f.total_images")).alias("content_type"),
    )


def media_details(entries: DataFrame, companions: DataFrame) -> DataFrame:
    """(chunk_id, kind, ordinal, marker, position, item): images and table rows of chunk entries, with what a companion file knows of the same mark.

    entries(chunk_id, id, text, chunk_start_position); companions(id, kind, ordinal, marker, item) as of sources.companion_media. An image without a record
    has a null item. A chunk's table rows get the record of the first table whose mark stands in the chunk.
    """
    images = entries.select("chunk_id", "id", F.explode(media.positions(F.col("text"), r"\[(?:IMAGE|IMG)[^\]]*\]", F.col("chunk_start_position"))).alias("position"))
    known = companions.select("id", "kind", "ordinal", "marker", "item")
    marks = images.select("chunk_id", "id", F.col("position.marker").alias("marker"), F.col("position.ordinal").alias("ordinal"), "position")
    image_items = known.filter("kind = 'image'").groupBy("id", "marker").agg(F.min_by("item", "ordinal").alias("item"))
    a = matched_media(marks, image_items, ["id", "marker"]).select("chunk_id", F.lit("image").alias("kind"), "ordinal", "marker", "position", "item")
    rows = entries.select("chunk_id", "id", "text", F.posexplode(media.features(F.col("text"))["table_summary"]).alias("n", "row"))
    tables = known.filter("kind = 'table'").select("id", F.col("ordinal").alias("k"), F.col("marker").alias("mark"), "item")
    held = entries.select("chunk_id", "id", "text").join(tables, "id").filter(F.col("text").contains(F.col("mark"))).groupBy("chunk_id").agg(F.min_by(F.struct("mark", "item"), "k").alias("m"))
    b = rows.join(held, "chunk_id", "left").select("chunk_id", F.lit("table").alias("kind"), (F.col("n") + 1).alias("ordinal"), F.coalesce("m.mark", "row").alias("marker"), "m.item")
    return a.unionByName(b, allowMissingColumns=True)


def json_entries(files: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """A row for each JSON file without text: the file as it is, as structured_json."""
    rows = files.filter(F.col(json_col).isNotNull())
    return rows.select(
        F.col(id_col).alias("id"), F.col(json_col).alias("text"), tx.word_count(F.col(json_col)).alias("token_count"), F.length(json_col).alias("char_count"), F.lit("structured_json").alias("content_type"),
        F.lit("none").alias("method"), F.lit("original_untouched").alias("status"), F.lit("accepted").alias("validation_status"), F.lit(UNJUDGED).alias("score"), F.try_parse_json(json_col).alias("raw"),
    )


def is_page(kind: Column, page_id: Column) -> Column:
    """Pages and posts, but no attachments."""
    return F.lower(kind).isin("page", "blogpost") & ~page_id.startswith("att")
