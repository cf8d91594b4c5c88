"""File scans and the records read from files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udfs

LOG_SCHEMA = "asctime string, name string, levelname string, message string"


def scan(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """All files below root, or those of a glob such as *.{txt,doc}: path, relative_path, parts of it, time, length, content.

    Columns that a query doesn't use are not read: listing paths doesn't load contents.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root)
    base = re.escape(root.rstrip("/").removeprefix("file://"))
    relative = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), rf"^(file:/*)?/?{base.lstrip('/')}/", "")
    parts = tx.path_parts(relative)
    return files.select("path", relative.alias("relative_path"), *[c.alias(n) for n, c in parts.items()], "modificationTime", "length", "content")


def descriptors(spark: SparkSession, root: str) -> DataFrame:
    """Texts with their companion JSON, and JSON files by themselves: type, relative_path, folder_path, folder_name, folder_depth, companion."""
    from ..operators.pairing import standalone, with_companion

    files = scan(spark, root, "*.{txt,json}").drop("content")
    txt, js = files.filter("extension = '.txt'"), files.filter("extension = '.json'")
    keys = ["folder_path", "stem"]
    columns = ["relative_path", "folder_path", "folder_name", "folder_depth"]
    a = with_companion(txt, js, keys, "relative_path").select(F.lit("txt").alias("type"), *columns, "companion")
    b = standalone(js, txt, keys).select(F.lit("json").alias("type"), *columns, F.lit(None).cast("string").alias("companion"))
    return a.unionByName(b)


def texts(files: DataFrame) -> DataFrame:
    """Files with text: decoded by content; of pages in MIME form the visible text, marks in place of media, and whether there are images."""
    is_page = F.col("extension").isin(".doc", ".mht", ".mhtml")
    plain = files.filter(~is_page).withColumn("text", udfs.decoded("content")).withColumn("has_images", F.lit(False)).withColumn("error", F.lit(None).cast("string"))
    pages = files.filter(is_page).withColumn("m", udfs.parsed_mime("content"))
    pages = pages.withColumn("text", udfs.marked_text("m.html")).withColumn("has_images", F.col("m.has_images")).withColumn("error", F.col("m.error")).drop("m")
    return plain.drop("content").unionByName(pages.drop("content"))


def chunk_records(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Records of JSON files that hold an array of chunks or one chunk; records without chunk_id are left out. Unknown fields are dropped."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root).filter("chunk_id is not null")


#: Names of lists, and of fields of their items, by kind.
MEDIA_LISTS = {
    "image": (("images", "image_list", "imgs", "figures", "image_data", "img_list"), ("marker", "image_id", "img_id", "src", "image_path", "figure_id")),
    "table": (("tables", "table_list", "tbls", "table_data", "tbl_list"), ("marker", "table_id", "headers", "rows", "columns", "tbl_id")),
    "code": (("code_blocks", "codes", "snippets", "code_list"), ()),
}


def companion_media(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, kind, ordinal, marker, item): images, tables and code of companion JSON, whatever its layout; items without marker get one.

    Lists are found one and two levels deep, by their name or by the fields of their items, and an array at the top by its items.
    """
    import json
    from collections.abc import Iterator

    import pandas as pd

    def lists(value):
        if isinstance(value, list):
            yield "", value
        elif isinstance(value, dict):
            for key, inner in value.items():
                if isinstance(inner, list):
                    yield key.lower(), inner
                elif isinstance(inner, dict):
                    yield from ((k.lower(), x) for k, x in inner.items() if isinstance(x, list))

    def kind_of(name: str, items: list) -> str | None:
        for kind, (names, _) in MEDIA_LISTS.items():
            if name in names:
                return kind
        first = next((x for x in items if isinstance(x, dict)), None)
        for kind, (_, fields) in MEDIA_LISTS.items():
            if first and set(fields) & set(first):
                return kind
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, raw in zip(batch["id"], batch["raw"], strict=True):
                try:
                    value = json.loads(raw)
                except (TypeError, ValueError):
                    continue
                n: dict[str, int] = {}
                for name, items in lists(value):
                    kind = kind_of(name, items)
                    for item in items if kind else ():
                        n[kind] = n.get(kind, 0) + 1
                        fields = item if isinstance(item, dict) else {}
                        own = next((str(fields[f]) for f in (f"{kind}_id", "img_id", "tbl_id", "id") if fields.get(f)), str(n[kind]))
                        marker = fields.get("marker") or f"[{kind.upper()}_{own}]"
                        out.append((key, kind, n[kind], str(marker), json.dumps(item, ensure_ascii=False, sort_keys=True)))
            yield pd.DataFrame(out, columns=["id", "kind", "ordinal", "marker", "item"])

    id_kind = rows.schema[id_col].dataType.simpleString()
    source = rows.select(F.col(id_col).alias("id"), F.col(json_col).alias("raw")).filter("raw is not null")
    return source.mapInPandas(run, f"id {id_kind}, kind string, ordinal int, marker string, item string")


def markdown_posts(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files: slug, title, description, date, tags, frontmatter map, markdown. Keys of the head are `key: value` lines or lists."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).withColumn("path", F.input_file_name())
    head = F.regexp_extract("value", r"^---\n([\s\S]*?)\n---\n?", 1)
    body = F.regexp_replace("value", r"^---\n[\s\S]*?\n---\n?", "")
    entries = F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_][\w-]*\s*:.*)$"), 1)
    unquote = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    pairs = F.transform(entries, lambda e: F.struct(F.trim(F.substring_index(e, ":", 1)).alias("k"), unquote(F.regexp_replace(e, r"^[^:]*:", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    front = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda x: x["k"] == n), -1)["v"]))  # the last of several
    inline = F.regexp_extract(head, r"(?m)^tags\s*:\s*\[(.*)\]", 1)
    listed = F.regexp_extract(head, r"(?m)^tags\s*:\s*\n((?:\s*-\s+.*\n?)+)", 1)
    tags = F.filter(F.transform(F.split(F.when(inline != "", inline).otherwise(F.regexp_replace(listed, r"\s*-\s+", ",")), ","), unquote), lambda t: t != "")
    posts = files.select(tx.slug(F.col("path")).alias("slug"), body.alias("markdown"), front.alias("frontmatter"), tags.alias("tags"))
    get = lambda k: F.element_at("frontmatter", F.lit(k))
    return posts.select(
        "slug", tx.first_of(get("seo_title"), get("title"), tx.title_from_slug(F.element_at(F.split("slug", "/"), -1))).alias("title"),
        tx.first_of(get("seo_description"), get("description"), tx.description_of(F.col("markdown"))).alias("description"), F.try_to_timestamp(get("date")).alias("date"), "tags", "frontmatter", "markdown",
    )


def posts_in_order(posts: DataFrame) -> DataFrame:
    """By date, the newest first, those without date last, then by slug."""
    return posts.orderBy(F.desc_nulls_last("date"), "slug")


def post_by_slug(posts: DataFrame, slug: str) -> DataFrame:
    """The post of a slug, no row where there is none."""
    return posts.filter(F.col("slug") == slug).limit(1)


def latest_change(files: DataFrame) -> DataFrame:
    """Routes with their last change, and the start page with the last of all."""
    each = files.select(tx.route(F.col("relative_path")).alias("route"), F.col("modificationTime").alias("changed"))
    return each.groupBy("route").agg(F.max("changed").alias("changed")).unionByName(each.agg(F.max("changed").alias("changed")).select(F.lit("/").alias("route"), "changed"))


def log_events(lines: DataFrame) -> DataFrame:
    """(time, level, event, seconds) of log lines in JSON form; seconds is the first duration a message names."""
    return lines.select(
        F.try_to_timestamp(F.substring("asctime", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("time"), F.col("levelname").alias("level"), F.regexp_extract("message", r"^([A-Za-z][A-Za-z _-]*)", 1).alias("event"),
        F.regexp_extract("message", r"([0-9]+(?:\.[0-9]+)?)\s*s\b", 1).try_cast("double").alias("seconds"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return log_events(spark.read.schema(LOG_SCHEMA).json(path))


def service_table(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """A service's table: Parquet, or a database where a JDBC url is given with its options."""
    if "url" in options:
        return spark.read.format("jdbc").options(dbtable=source, **options).load()
    return spark.read.parquet(source)
