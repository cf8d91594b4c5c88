"""Cosine similarity, exact and indexed search, and audits of duplicates by vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

#: Queries that are matched in one pass; a larger set is taken block by block, each against all rows.
BLOCK_QUERIES = 4_096
#: Rows the index is fitted on at most, and its default shape.
SAMPLE_ROWS = 20_000
LISTS = 16
#: Share of the lists that a query goes to.
PROBE_SHARE = 0.8
#: Rows of a list that one task takes on; longer lists are split.
LIST_ROWS = 50_000
#: Rows of a block of the self-join; each pair of blocks is a task.
PAIR_ROWS = 8_192
#: Least similarity of each category of a duplicate.
CATEGORIES = ((0.98, "exact"), (0.95, "high"), (0.85, "borderline"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(rows: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """The k best of each query out of partial results, ties by id."""
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    out = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out if threshold is None else out.filter(F.col("similarity") >= threshold)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float | None = None) -> DataFrame:
    """(query_id, match_id, similarity, rank): the k most similar rows of each query, itself excluded.

    The stated queries go to the tasks in blocks and every block against all rows, a matrix product per batch; each task keeps k
    rows a query, so only partial results are shuffled. Null vectors are left out; similarities are rounded to 6 digits before ranking.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")

    def runner(ids: list, matrix: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                own = batch["id"].to_numpy()
                sims = np.round(matrix @ _unit(batch["v"]).T, 6)
                sims[np.array(ids)[:, None] == own[None, :]] = -np.inf
                take = min(k, sims.shape[1])
                # Ties at the edge are all kept; the ranking after it decides by id.
                edge = np.partition(sims, sims.shape[1] - take, axis=1)[:, sims.shape[1] - take]
                q, m = np.nonzero((sims >= edge[:, None]) & np.isfinite(sims))
                yield pd.DataFrame({"query_id": np.array(ids)[q], "match_id": own[m], "similarity": sims[q, m]})

        return run

    out, block = None, []
    schema = f"query_id {kind}, match_id {kind}, similarity double"

    def add(block: list, out: DataFrame | None) -> DataFrame:
        part = rows.mapInPandas(runner([r[0] for r in block], _unit([r[1] for r in block])), schema)
        return part if out is None else out.unionByName(part)

    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK_QUERIES:
            out, block = add(block, out), []
    if block or out is None:
        out = add(block, out) if block else rows.sparkSession.createDataFrame([], schema)
    return _best(out, k, threshold)


def fit_centres(vectors: DataFrame, vector_col: str = "embedding", lists: int | None = None, rows: int = SAMPLE_ROWS, seed: int = 7) -> np.ndarray:
    """Centres of the index by k-means, on a sample of at most rows rows. Without a number, lists grow as the square root of the number of vectors, up to
    a fifth of the sample, and are LISTS at least."""
    if lists is None:
        lists = max(LISTS, min(math.isqrt(vectors.count()), rows // 5))
    sample = vectors.select(vector_col).filter(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(F.col(vector_col))).limit(rows).collect()
    m = _unit([r[0] for r in sample])
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(lists, len(m)), replace=False)]
    for _ in range(12):
        own = (m @ centres.T).argmax(1)
        centres = np.stack([m[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = _unit(centres)
    return centres


def indexed_top_k(vectors: DataFrame, queries: DataFrame, k: int, centres: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """As top_k, but each query against the lists of its nearest centres only. Every row is in the index; long lists are split, and
    a query goes to all parts of its lists. probes: lists a query, PROBE_SHARE of them if none is given."""
    probes = probes or math.ceil(PROBE_SHARE * len(centres))
    kind = vectors.schema[id_col].dataType.simpleString()

    def assigner(n: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    near = np.argsort(-(_unit(batch["v"]) @ centres.T), axis=1)[:, :n]
                    yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "lists": [[int(i) for i in row] for row in near]})

        return run

    def listed(df: DataFrame, n: int) -> DataFrame:
        rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
        return rows.mapInPandas(assigner(n), f"id {kind}, v array<float>, lists array<int>").select("id", "v", F.explode("lists").alias("list"))

    stored = listed(vectors, 1)
    parts = stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("parts"))  # a row for each list
    left = stored.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    right = listed(queries, probes).join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "match_id": [], "similarity": []}, dtype=object)
        out, stored_, own = [], _unit(a["v"]), a["id"].to_numpy()
        asked, ids = _unit(b["v"]), b["id"].to_numpy()
        for i in range(0, len(b), 256):
            sims = np.round(asked[i : i + 256] @ stored_.T, 6)
            sims[ids[i : i + 256][:, None] == own[None, :]] = -np.inf
            take = min(k, sims.shape[1])
            edge = np.partition(sims, sims.shape[1] - take, axis=1)[:, sims.shape[1] - take]
            q, m = np.nonzero((sims >= edge[:, None]) & np.isfinite(sims))
            out.append(pd.DataFrame({"query_id": ids[i + q], "match_id": own[m], "similarity": sims[q, m]}))
        return pd.concat(out)

    found = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInPandas(match, f"query_id {kind}, match_id {kind}, similarity double")
    return _best(found, k, None)


def similarity_category(s: Column, categories: Sequence[tuple[float, str]] = CATEGORIES) -> Column:
    out = F.lit("false_positive")
    for least, name in reversed(categories):
        out = F.when(s >= least, name).otherwise(out)
    return out


def all_near_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = PAIR_ROWS) -> DataFrame:
    """(a, b, similarity): every unordered pair of rows at or above the threshold, however many a row has.

    Equal vectors are compared once, as a class, and the pairs of classes go back to their members. The classes are cut into blocks by hash
    and every two blocks, as every block with itself, meet in one task. Null vectors are left out; similarities have 6 digits. The output
    grows with the square of a group's size, the comparisons with that of the number of classes.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    classes = rows.groupBy("v").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
    blocks = max(1, -(-rows.count() // block_rows))
    own = classes.withColumn("own", F.pmod(F.xxhash64("class"), F.lit(blocks)))
    meet = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    meet = meet.select("class", "v", "n", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def match(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left, right = group[group["own"] == i], group[group["own"] == j]
        a, b = _unit(left["v"]), _unit(right["v"])
        a_ids, b_ids, copies = left["class"].to_numpy(), right["class"].to_numpy(), left["n"].to_numpy() > 1
        out = []
        for k in range(0, len(left) if len(right) else 0, 256):
            sims = np.round(a[k : k + 256] @ b.T, 6)
            hit = sims >= threshold
            if i == j:  # each pair once; a class with itself where it has copies
                at = np.arange(k, k + len(sims))
                hit &= at[:, None] <= np.arange(len(b))[None, :]
                hit[at - k, at] &= copies[at]
            q, m = np.nonzero(hit)
            out.append(pd.DataFrame({"class_a": a_ids[k + q], "class_b": b_ids[m], "similarity": sims[q, m]}))
        return pd.concat(out) if out else pd.DataFrame({"class_a": [], "class_b": [], "similarity": []}, dtype=object)

    found = meet.groupBy("i", "j").applyInPandas(match, f"class_a {kind}, class_b {kind}, similarity double")
    members = rows.join(classes.select("v", "class"), "v").select("class", "id")
    a, b = members.select(F.col("class").alias("class_a"), F.col("id").alias("query_id")), members.select(F.col("class").alias("class_b"), F.col("id").alias("match_id"))
    return near_pairs(found.join(a, "class_a").join(b, "class_b").filter("query_id <> match_id"), threshold)


def near_pairs(matches: DataFrame, threshold: float) -> DataFrame:
    """Unordered pairs of matches at or above the threshold."""
    pairs = matches.filter(F.col("similarity") >= threshold).select(F.least("query_id", "match_id").alias("a"), F.greatest("query_id", "match_id").alias("b"), "similarity")
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def audit(best: DataFrame, categories: Sequence[tuple[float, str]] = CATEGORIES) -> DataFrame:
    """One row: matches by category, and the accuracy of the cleaning in percent (exact and high)."""
    c = similarity_category(F.col("similarity"), categories)
    t = best.select(c.alias("c")).agg(*[F.count_if(F.col("c") == n).alias(n) for n in ("exact", "high", "borderline", "false_positive")], F.count(F.lit(1)).alias("total"))
    return t.withColumn("accuracy_percent", tx.percent(F.col("exact") + F.col("high"), F.col("total"), 2))


def recommendation(accuracy: Column) -> Column:
    """What to do after an audit, by accuracy in percent."""
    return F.when(accuracy >= 95, "duplicates can be removed").when(accuracy >= 85, "check borderline cases first").otherwise("revise the cleaning rules")
