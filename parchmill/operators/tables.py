"""Tables and images out of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media, udfs


def table_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_no, row_no, cells) of the valid tables; tables count from 1."""
    t = pages.select(F.col(id_col).alias("id"), F.posexplode(udfs.tables(html_col)).alias("t", "rows"))
    return t.select("id", (F.col("t") + 1).alias("table_no"), F.posexplode("rows").alias("row_no", "cells"))


def valid_tables(cells: DataFrame, keys: list[str], row: str, cell: str, header: str) -> DataFrame:
    """Keys of the tables, given cell by cell, that have two rows with text and two columns, and a header or one width."""
    rows = cells.groupBy(*keys, row).agg(F.count(F.lit(1)).alias("w"), F.bool_or(F.trim(cell) != "").alias("full"), F.bool_or(header).alias("h")).filter("full")
    one = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("most"), F.min("w").alias("least"), F.bool_or("h").alias("h"))
    return one.filter("n >= 2 and most >= 2 and (h or most = least)").select(*keys)


def table_statistics(rows: DataFrame, pages: DataFrame) -> DataFrame:
    t = rows.agg(F.countDistinct("id").alias("pages_with_tables"), F.countDistinct("id", "table_no").alias("tables"), F.count(F.lit(1)).alias("rows"))
    return t.crossJoin(pages.agg(F.count(F.lit(1)).alias("pages")))  # one row each


def images(files: DataFrame, path_col: str, content_col: str) -> DataFrame:
    """(path, order_in_doc, image_id, content_type, extension, size_bytes, source, data): images of MIME parts, then inline ones."""
    m = files.select(F.col(path_col).alias("path"), udfs.parsed_mime(content_col).alias("m"))
    parts = m.select("path", F.posexplode("m.parts").alias("i", "p")).filter(media.is_image(F.col("p.content_type"), F.col("p.data")))
    a = parts.select("path", F.lit(0).alias("k"), "i", F.col("p.content_type").alias("original_content_type"), media.extension_of(F.col("p.content_type"), F.col("p.data")).alias("extension"), F.col("p.data").alias("data"), F.lit("mime_part").alias("source"))
    inline = m.select("path", F.posexplode(udfs.inline_images("m.html")).alias("i", "src")).withColumn("u", media.data_uri(F.col("src"))).filter("u is not null")
    b = inline.select("path", F.lit(1).alias("k"), "i", F.col("u.extension").alias("extension"), F.col("u.data").alias("data"), F.lit("base64_html").alias("source"))
    both = a.unionByName(b, allowMissingColumns=True)
    from pyspark.sql import Window as W

    types = F.create_map(*[F.lit(x) for kv in media.MEDIA_TYPES.items() for x in kv])
    n = F.row_number().over(W.partitionBy("path").orderBy("k", "i"))
    return both.withColumn("order_in_doc", n).select(
        "path", "order_in_doc", F.format_string("img_%03d", F.col("order_in_doc")).alias("image_id"), F.coalesce(F.element_at(types, F.col("extension")), F.concat(F.lit("image/"), F.col("extension"))).alias("content_type"),
        "original_content_type", "extension", F.octet_length("data").alias("size_bytes"), "source", "data",
    )
