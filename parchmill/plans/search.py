"""Queries over vectors, keyword search, and the star-shaped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import retrieval, vectors
from ..session import cut_lineage, spread

K = 5


def _embeddings(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _queries(v: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return v.filter("vec_id % 100 = 0")


def vector_topk(spark, d):
    v = _embeddings(spark, d)
    return vectors.top_k(v, _queries(v), K)


def vector_topk_indexed(spark, d):
    v = _embeddings(spark, d)
    return vectors.indexed_top_k(v, _queries(v), K, vectors.fit_centres(v))


def index_recall(spark, d):
    """Share of the exact matches that the index finds."""
    v = _embeddings(spark, d)
    exact, found = vector_topk(spark, d), vectors.indexed_top_k(v, _queries(v), K, vectors.fit_centres(v))
    hit = found.select("query_id", "match_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "match_id"], "left").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def near_duplicate_pairs(spark, d):
    """All unordered pairs at 0.4 or more, of all rows."""
    return vectors.all_near_pairs(_embeddings(spark, d), 0.4)


#: Least similarity of each category in these vectors, which are less alike than those of real texts.
CATEGORIES = ((0.48, "exact"), (0.45, "high"), (0.35, "borderline"))


def duplicate_vs_clean_class(spark, d):
    """The nearest other row of each query and its category."""
    v = _embeddings(spark, d)
    best = vectors.top_k(v, _queries(v), 1).select("query_id", "match_id", "similarity")
    return best.withColumn("category", vectors.similarity_category(F.col("similarity"), CATEGORIES))


def dedup_audit(spark, d):
    a = vectors.audit(duplicate_vs_clean_class(spark, d), CATEGORIES)
    return a.withColumn("recommendation", vectors.recommendation(F.col("accuracy_percent")))


def cosine_to_first(spark, d):
    v = _embeddings(spark, d)
    one = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))  # a row for each label
    return v.join(F.broadcast(one), "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("first")), 6).alias("similarity"))


def _asked(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "question")


def bm25_topk(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return retrieval.bm25(docs, "doc_id", "text", _asked(spark, d), "item_id", "question", K)


def hybrid_topk(spark, d):
    """Keyword scores mixed with those of hashed vectors, over all documents; the given items are the queries."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    embed = udfs.embedder(128)
    stored = cut_lineage(spread(docs.filter("text is not null").select("doc_id", "text"), "doc_id").select("doc_id", embed("text").alias("v")))
    asked = cut_lineage(_asked(spark, d).select(F.col("item_id").alias("query_id"), embed("question").alias("v")))
    sparse = retrieval.bm25(docs, "doc_id", "text", _asked(spark, d), "item_id", "question", None)
    return retrieval.hybrid(stored, asked, sparse, K)


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def revenue_by_nation(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    li = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    per_order = li.groupBy("l_orderkey").agg(F.sum("net").alias("net"), F.count(F.lit(1)).alias("lines"))
    j = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    per = j.groupBy("c_nationkey").agg(F.sum("net").alias("net"), F.sum("lines").alias("lines"))
    return per.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "lines", F.round("net", 2).alias("revenue"))


def pricing_summary(spark, d):
    li = _t(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order")
    )


def customers_without_orders(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def order_counts(spark, d):
    n = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = _t(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy(F.coalesce("n", F.lit(0)).alias("orders")).agg(F.count(F.lit(1)).alias("customers"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_indexed, index_recall, near_duplicate_pairs, duplicate_vs_clean_class, dedup_audit, cosine_to_first, bm25_topk, hybrid_topk, revenue_by_nation, pricing_summary,
        customers_without_orders, order_counts,
    )
}

_S = """with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 100 = 0), v as (select vec_id, embedding::double[] as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id as match_id, round(list_cosine_similarity(q.e, v.e), 6) as similarity from q, v where q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by similarity desc, match_id) as rank from s) """
_CLASS = _S + """, k as (select query_id, match_id, similarity from r where rank = 1),
l as (select *, case when similarity >= 0.48 then 'exact' when similarity >= 0.45 then 'high' when similarity >= 0.35 then 'borderline' else 'false_positive' end as category from k) """
SQL = {
    "vector_topk": _S + "select query_id, match_id, similarity, rank from r where rank <= 5",
    "near_duplicate_pairs": """with v as (select vec_id, embedding::double[] as e from embeddings)
select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.e, b.e), 6) as similarity from v a join v b on a.vec_id < b.vec_id where round(list_cosine_similarity(a.e, b.e), 6) >= 0.4""",
    "duplicate_vs_clean_class": _CLASS + "select query_id, match_id, similarity, category from l",
    "dedup_audit": _CLASS + """, t as (select count(*) filter (category = 'exact') as exact, count(*) filter (category = 'high') as high, count(*) filter (category = 'borderline') as borderline, count(*) filter (category = 'false_positive') as false_positive, count(*) as total from l)
select *, round((exact + high) * 100 / total, 2) as accuracy_percent, case when round((exact + high) * 100 / total, 2) >= 95 then 'duplicates can be removed' when round((exact + high) * 100 / total, 2) >= 85 then 'check borderline cases first' else 'revise the cleaning rules' end as recommendation from t""",
    "cosine_to_first": "with f as (select label, arg_min(embedding, vec_id)::double[] as f from embeddings group by 1) select vec_id, round(list_cosine_similarity(embedding::double[], f), 6) as similarity from embeddings join f using (label)",
    "bm25_topk": r"""with d as (select doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents where text is not null),
n as (select count(*) as n, avg(len(w)) as mean from d), t as (select doc_id, len(w) as size, unnest(w) as term from d), f as (select doc_id, size, term, count(*) as tf from t group by all),
q as (select distinct item_id, unnest(list_filter(string_split(regexp_replace(lower(question), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) as term from eval_items where question is not null),
df as (select term, count(*) as df from f group by 1),
s as (select item_id as query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * size / mean))), 4) as score from q join f using (term) join df using (term), n group by 1, 2)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from s qualify rank <= 5""",
    "revenue_by_nation": """select r_name, n_name, count(*) as lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
    "pricing_summary": "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order from lineitem group by 1, 2",
    "customers_without_orders": "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders)",
    "order_counts": "with n as (select c_custkey, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey group by 1) select orders, count(*) as customers from n group by 1",
}
