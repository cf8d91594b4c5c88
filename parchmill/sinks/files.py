"""Writers: CSV, JSON and text reports, routed and mirrored outputs, stores that are added to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def csv_line(cells: Column, sep: str = ";") -> Column:
    """A CSV line of an array of cells, quoted only where needed; rows may differ in width."""
    quoted = F.transform(cells, lambda c: F.when(c.rlike(rf'[{sep}"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))))
    return F.array_join(quoted, sep)


def write_tables(rows: DataFrame, path: str, keys: Sequence[str] = ("id", "table_no"), sep: str = ";") -> None:
    """A folder for each table, with one CSV file that begins with a byte order mark. rows: keys, row_no, cells."""
    first = F.when(F.col("row_no") == 0, F.concat(F.lit(BOM), csv_line(F.col("cells"), sep))).otherwise(csv_line(F.col("cells"), sep))
    lines = rows.select(*keys, "row_no", first.alias("value"))
    # A table is one file, so its rows go to one task; tables of one page are spread.
    lines.repartition(*keys).sortWithinPartitions(*keys, "row_no").drop("row_no").write.mode("overwrite").partitionBy(*keys).text(path)


def readable(spark, path: str, sep: str = ";") -> bool:
    """The written CSV can be read and isn't empty."""
    return len(spark.read.option("sep", sep).option("recursiveFileLookup", "true").csv(path).limit(1).take(1)) == 1


def samples(df: DataFrame, n: int = 5, seed: int = 1) -> DataFrame:
    """n rows at random, the same for the same seed and rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(n)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header. One file is for reports of a few rows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", "true").csv(path)


def write_json_report(row: DataFrame, path: str) -> None:
    """A report, one row, as indented JSON."""
    row.select(F.to_json(F.struct(*row.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_text_report(df: DataFrame, template: str, columns: Sequence[str], order: Sequence[str], path: str) -> None:
    """A line for each row, in order over all files."""
    df.orderBy(*order).select(F.format_string(template, *columns).alias("value")).write.mode("overwrite").text(path)


def banner(title: str, width: int = 70) -> list[str]:
    return ["=" * width, title, "=" * width]


def unified_lines(chunks: DataFrame, folder: str = "folder_path", key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Lines of one output in order of folder and chunk, with a banner before each folder: (folder, key, part, value). No folder is collected."""
    head = chunks.groupBy(folder).agg(F.count(F.lit(1)).alias("n")).select(F.col(folder), F.lit(None).cast(chunks.schema[key].dataType).alias(key), F.lit(0).alias("part"), F.format_string("==== %s (%d) ====", folder, "n").alias("value"))
    body = chunks.select(folder, key, F.lit(1).alias("part"), F.concat(F.format_string("--- Chunk %d ---\n", key), F.col(text), F.lit("\n")).alias("value"))
    return head.unionByName(body).orderBy(folder, "part", key)


def write_mirrored(chunks: DataFrame, path: str, folder: str = "folder_path") -> None:
    """Chunks below the folder they came from."""
    chunks.write.mode("overwrite").partitionBy(folder).parquet(path)


def write_routed(pages: DataFrame, path: str, route: str = "disposition") -> None:
    """Pages below the label that says what became of them."""
    pages.write.mode("overwrite").partitionBy(route).parquet(path)


def write_payloads(images: DataFrame, path: str) -> None:
    """Image data stays a column of a table: millions of small files serve nobody."""
    images.write.mode("overwrite").partitionBy("extension").parquet(path)


def create_if_absent(empty: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """An empty store of the schema, unless there is one; keys become partitions, the index that a scan can use."""
    writer = empty.write.mode("ignore")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def point_id(*parts: Column) -> Column:
    """The same id each time a point is written, so that writing again doesn't double it."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def upsert(spark, fresh: DataFrame, path: str, key: str) -> DataFrame:
    """The store at path with fresh rows in place of those of the same key. Written beside the old store and swapped by the caller."""
    from ..operators.pairing import replaced

    return replaced(spark.read.parquet(path), fresh, key)


def write_upsert(spark, fresh: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """Fresh rows in place of those of the same key, in a store cut into parts by hash of the key: only the parts that fresh rows fall into are
    read and written. A store that isn't there yet is made. A write that fails before the parts are swapped leaves the old store."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    marked = fresh.withColumn("part", part)
    if not fs.exists(at(path)):
        marked.write.partitionBy("part").parquet(path)
        return
    touched = sorted(r[0] for r in marked.select("part").distinct().collect())  # at most `parts`
    old = spark.read.parquet(path).filter(F.col("part").isin(touched)).drop("part")
    aside = f"{path.rstrip('/')}.new"
    old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(aside)
    for n in touched:
        here, there = at(f"{path}/part={n}"), at(f"{path}/_part={n}.old")
        if fs.exists(here):
            fs.rename(here, there)
        fs.rename(at(f"{aside}/part={n}"), here)
        fs.delete(there, True)
    fs.delete(at(aside), True)


def write_per_file(chunks: DataFrame, path: str, folder: str = "folder_path", file: str = "source_file", key: str = "chunk_id", text: str = "text") -> None:
    """For each file, below its folder, its chunks as text with a header each and their fields as JSON lines: chunks/ and meta/, partitioned by folder and file."""
    keys = [folder, file]
    body = F.concat(F.format_string("--- Chunk %d ---\n", key), F.col(text), F.lit("\n"))
    fields = F.to_json(F.struct(*[c for c in chunks.columns if c not in (*keys, text)]))
    for name, value in (("chunks", body), ("meta", fields)):
        # Sorted within the tasks, which take ranges of (file, chunk): a file with a third of all chunks is several parts in order.
        chunks.select(*keys, key, value.alias("value")).repartitionByRange(*keys, key).sortWithinPartitions(*keys, key).drop(key).write.mode("overwrite").partitionBy(*keys).text(f"{path}/{name}")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
