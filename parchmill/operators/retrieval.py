"""Keyword search (BM25) and its mix with vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .vectors import cosine, top_k

K1, B = 1.5, 0.75
DENSE, SPARSE = 0.7, 0.3
#: Queries are a set of known size; more distinct terms than this are joined by shuffle instead of broadcast.
BROADCAST_TERMS = 100_000


def words_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, w): lower-cased runs of letters and digits of each text; null texts give no row."""
    t = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return spread(t, "id").select("id", F.filter(F.split(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "").alias("w"))


def bm25(documents: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_id: str, query_text: str, k: int | None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query, ties by id; scores rounded to 4 digits before ranking.

    With k None all documents that hold a word of the query, without rank. Texts are read once: what is kept of a document is its size and the number of each word asked for.
    """
    asked = cut_lineage(words_of(queries, query_id, query_text).select(F.col("id").alias("query_id"), F.explode("w").alias("term")).distinct())
    vocabulary = asked.select("term").distinct()
    few = vocabulary.count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda x: x)
    # Words that nobody asks for leave at once; an empty word stands for the document itself and keeps its size.
    sized = words_of(documents, id_col, text_col).select("id", F.size("w").alias("size"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("term"))
    wanted = vocabulary.union(documents.sparkSession.createDataFrame([("",)], "term string"))
    counted = cut_lineage(sized.join(small(wanted), "term").groupBy("id", "size", "term").agg(F.count(F.lit(1)).alias("tf")))
    size = counted.filter("term = ''").agg(F.count(F.lit(1)).alias("N"), F.avg("size").alias("mean"))
    held = counted.filter("term <> ''")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(small(df), "term").crossJoin(F.broadcast(size)).select("query_id", "term", F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")  # size: one row
    scored = held.join(small(weights), "term").select("query_id", F.col("id").alias("doc_id"), (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))).alias("s"))
    total = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 4).alias("score"))
    if k is None:
        return total
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return total.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hybrid(vectors: DataFrame, queries: DataFrame, sparse: DataFrame, k: int, near: int = 20) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best by DENSE x cosine + SPARSE x (keyword score / the query's best), over all documents.

    vectors(doc_id, v), queries(query_id, v), sparse(query_id, doc_id, score) of all documents that hold a word of the query. The nearest
    documents of each query are scored first. What isn't among them has at most the cosine of the last of them, so that only documents whose keywords can
    still lift them to the k-th score are compared with their query; documents with neither can't be among the best.
    """
    best = F.max("score").over(W.partitionBy("query_id"))
    s = cut_lineage(sparse.withColumn("sparse", F.coalesce(F.try_divide(F.col("score"), best), F.lit(0.0))).select("query_id", "doc_id", "sparse"))
    dense = cut_lineage(nearest(vectors, queries, max(near, k)))
    mixed = lambda d, x: F.round(DENSE * d + SPARSE * F.coalesce(x, F.lit(0.0)), 4)
    first = dense.join(s, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "similarity", mixed(F.col("similarity"), F.col("sparse")).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    kth = first.withColumn("r", F.row_number().over(order)).groupBy("query_id").agg(F.min(F.when(F.col("r") <= k, F.col("score"))).alias("kth"), F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n"))
    open_ = s.join(kth, "query_id").filter((F.col("n") < k) | (DENSE * F.col("least") + SPARSE * F.col("sparse") >= F.col("kth") - 1e-4)).join(dense.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    more = open_.join(vectors.select("doc_id", F.col("v").alias("a")), "doc_id").join(queries.select("query_id", F.col("v").alias("b")), "query_id")
    rest = more.select("query_id", "doc_id", F.coalesce(F.round(cosine(F.col("a"), F.col("b")), 6), F.lit(0.0)).alias("similarity"), "sparse").select("query_id", "doc_id", mixed(F.col("similarity"), F.col("sparse")).alias("score"))
    return first.select("query_id", "doc_id", "score").unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, similarity) of each query's k nearest. Ids of queries and documents are told apart by number of their own."""
    numbered = vectors.select(F.struct(F.lit(0).alias("side"), F.col("doc_id").cast("string").alias("key")).alias("id"), "doc_id", "v")
    asked = queries.select(F.struct(F.lit(1).alias("side"), F.col("query_id").cast("string").alias("key")).alias("id"), "query_id", "v")
    as_id = lambda c: F.concat(F.col(f"{c}.side").cast("string"), F.lit(":"), F.col(f"{c}.key"))
    found = top_k(numbered.select(as_id("id").alias("id"), "v"), asked.select(as_id("id").alias("id"), "v"), k, "id", "v")
    kinds = queries.schema["query_id"].dataType, vectors.schema["doc_id"].dataType
    key = lambda c: F.substring(c, 3, 2**31 - 1)
    return found.select(key("query_id").cast(kinds[0]).alias("query_id"), key("match_id").cast(kinds[1]).alias("doc_id"), "similarity")
