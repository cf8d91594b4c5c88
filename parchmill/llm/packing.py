"""Problem 6: containers of fixed capacity filled by the sum-of-squares rule.

A document goes where the sum, over the residual gaps of open containers, of the squared number of containers with that gap
becomes least: gaps stay varied, and there is a fitting one for what comes next. Items are
spread by hash over shards of bounded size, large ones first within a shard; the containers a shard leaves with much room are emptied
and filled anew together with those of other shards, twice, whatever the number of shards.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread

#: Where the public tokenizers are, and which is used.
TOKENIZER_DIR = os.environ.get("PARCHMILL_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how text is cut before byte pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_ITEMS = 40_000
#: Containers filled less than this are filled again.
REFILL_BELOW = 0.985
REFILL_ROUNDS = 2
#: A list of capacities longer than this is refused.
MOST_CAPACITIES = 1_000


@lru_cache(4)
def load_tokenizer(path: str, name: str = TOKENIZER):
    """The tokenizer of a vocabulary file; a worker reads it once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str, text_col: str, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(id, tokens) in tokens of a public tokenizer, once for each id and text; null ids and texts are left out.

    The vocabulary file is sent to the executors. Only ids, counts and hashes of texts are shuffled.
    """
    documents.sparkSession.sparkContext.addFile(os.path.join(directory, name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load_tokenizer(SparkFiles.get(name), name).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "tokens": [len(encode(t)) for t in batch["text"]], "version": [xxhash.xxh3_64_intdigest(t) - 2**63 for t in batch["text"]]})

    rows = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null"), "id")
    kind = documents.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, tokens long, version long").dropDuplicates(["id", "version"]).select("id", "tokens")


class SumOfSquares:
    """Open containers of one capacity, by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, dtype=np.int64)
        self.at: dict[int, list[int]] = {}
        self.containers = 0

    def place(self, size: int) -> int:
        """Container of an item of 1 to capacity tokens."""
        c = self.capacity
        n = self.open[size:c]
        # Moving a container from gap g to g - size changes the sum by 2 (N[g - size] - N[g]) + 2, or by 1 - 2 N[g] if it is full then.
        change = 2 * (self.open[: c - size] - n) + 2
        if c > size:
            change[0] = 1 - 2 * n[0]
        change[n == 0] = np.iinfo(np.int64).max
        new = 2 * self.open[c - size] + 1 if c > size else 0
        k = int(change.argmin()) if len(change) else -1  # the narrowest of equally good gaps
        if k < 0 or change[k] > new:
            container, gap = self.containers, c
            self.containers += 1
        else:
            gap = size + k
            container = self.at[gap].pop()
            self.open[gap] -= 1
        if gap > size:
            self.at.setdefault(gap - size, []).append(container)
            self.open[gap - size] += 1
        return container


def split_items(sizes: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(capacity_id, capacity, id, piece, start, tokens): an item above the capacity in pieces, all but the last of them full."""
    each = F.array(*(F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in capacities))
    pairs = sizes.filter("tokens > 0").withColumn("c", F.explode(each)).select("id", "tokens", "c.capacity_id", "c.capacity")
    c = F.col("capacity")
    pieces = pairs.select("capacity_id", "capacity", "id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(tokens - 1) div capacity"))).alias("piece"))
    return pieces.select("capacity_id", "capacity", "id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * c).alias("start"), F.least(c, F.col("tokens") - F.col("piece") * c).alias("tokens"))


def _fill(items: DataFrame, shards: int, round_: int, kind: str) -> DataFrame:
    """Items with container and room, the tokens left free in it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        capacity = int(group["capacity"].iloc[0])
        state = SumOfSquares(capacity)
        placed = np.fromiter((state.place(int(s)) for s in group["tokens"]), dtype=np.int64, count=len(group))
        used = np.bincount(placed, weights=group["tokens"].to_numpy(), minlength=state.containers).astype(np.int64)
        prefix = f"{group['capacity_id'].iloc[0]}-{round_}-{group['shard'].iloc[0]}-"
        return group.drop(columns="shard").assign(container=[prefix + str(k) for k in placed], room=capacity - used[placed])

    schema = f"capacity_id int, capacity int, id {kind}, piece int, start long, tokens int, container string, room long"
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int"))
    return sharded.groupBy("capacity_id", "shard").applyInPandas(run, schema)


def pack(documents: DataFrame, id_col: str, text_col: str, capacities: DataFrame, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(capacity_id, container, id, piece, start, tokens), a row for each piece placed.

    capacities(capacity_id, capacity_tokens). No text is split unless it exceeds the capacity. Texts of no token, null ids and
    null texts take no room and give no row; repeated rows are placed once per row's id and text. Null or non-positive capacities are left out.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    sizes = cut_lineage(token_counts(documents, id_col, text_col, directory, name))
    caps = capacities.filter("capacity_id is not null and capacity_tokens > 0").select(F.col("capacity_id").cast("int"), F.col("capacity_tokens").cast("int").alias("capacity")).distinct().limit(MOST_CAPACITIES + 1).collect()
    if len(caps) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    items = split_items(sizes, sorted((r[0], r[1]) for r in caps) or [(None, 1)]).filter("capacity_id is not null").withColumn("tokens", F.col("tokens").cast("int"))
    full = items.filter("tokens = capacity").select("capacity_id", F.concat_ws("-", F.col("capacity_id").cast("string"), F.lit("full"), F.col("id").cast("string"), F.col("piece").cast("string")).alias("container"), "id", "piece", "start", "tokens")
    left, done = cut_lineage(items.filter("tokens < capacity")), [full]
    for round_ in range(REFILL_ROUNDS + 1):
        most = left.groupBy("capacity_id").count().agg(F.max("count")).first()[0] or 0
        filled = cut_lineage(_fill(left, max(1, math.ceil(most / SHARD_ITEMS)), round_, kind))
        keep = F.lit(True) if round_ == REFILL_ROUNDS else F.col("room") <= (1 - REFILL_BELOW) * F.col("capacity")
        done.append(filled.filter(keep).select("capacity_id", "container", "id", "piece", "start", "tokens"))
        left = filled.filter(~keep).drop("container", "room")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def p6_containers(spark, sf_dir: str) -> DataFrame:
    """All documents in containers of each capacity."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{sf_dir}/capacities.parquet"))
    return packed.withColumnRenamed("id", "doc_id")


def p6_fill(spark, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of room used, by capacity."""
    caps = spark.read.parquet(f"{sf_dir}/capacities.parquet").select("capacity_id", "capacity_tokens")
    by = p6_containers(spark, sf_dir).groupBy("capacity_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return by.join(caps, "capacity_id").select("capacity_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill"))


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill}
SQL: dict[str, str] = {}
