"""Problem 2: near-duplicate records by multi-index hashing.

A text is the set of its distinct runs of `shingle` words. Its fingerprint has one 16-bit min-hash symbol
per position; two fingerprints differ at a position with probability 1 - Jaccard, so their Hamming
distance (number of unequal symbols) estimates it. The positions are cut into segments. Two fingerprints
fall into the same Hamming ball of radius 1 around a segment exactly if they agree on all but one
of its positions, so the ball is enumerated by leaving out each position in turn: one key stands for all
2^16 values of the symbol left out. Keys are looked up in one table per segment and position (the table's number is mixed into the
key), then the complete Hamming distance and last the exact Jaccard similarity are verified.

A bit-wise SimHash fingerprint is no choice here: at Jaccard 0.6 its bits differ with probability 0.23, and no
segmentation into balls of small radius is both selective and complete.

Exact copies (the same words) are one class before any of this; links are between representatives of classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ..session import cut_lineage, spread
from .words import words

SHINGLE_WORDS = 3
MIN_WORDS = 40
THRESHOLD = 0.6
SEGMENTS = 10
SEGMENT_SYMBOLS = 5
#: Rows of one block of a hot table entry; larger entries are joined block by block.
BLOCK_ROWS = 2_000
#: Hot entries are known from one in so many records, if that many of these share the entry. They only decide on the layout of the work.
HOT_SHARE, HOT_ROWS = 64, 16
#: Hot entries that are sent along with a join; more of them are joined by shuffle.
BROADCAST_ENTRIES = 100_000


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def shingle_hashes(tokens: list[str], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of width words."""
    digest = xxhash.xxh3_64_intdigest
    n = len(tokens) - width + 1
    return np.unique(np.fromiter((digest(" ".join(tokens[i : i + width])) for i in range(n)), dtype=np.uint64, count=max(n, 0)))


def fingerprint(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 16-bit min-hash symbol per constant."""
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 512):  # bounds the matrix, whatever the length of the text
        np.minimum(low, _mix(shingles[i : i + 512, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(40)).astype(np.uint16)


def probe_keys(symbols: np.ndarray, segments: int, width: int) -> np.ndarray:
    """(rows, segments * width) keys: each segment without each of its positions in turn."""
    parts = symbols.reshape(len(symbols), segments, width).astype(np.uint64)
    keys = np.empty((len(symbols), segments, width), dtype=np.uint64)
    for out in range(width):
        code = np.zeros(parts.shape[:2], dtype=np.uint64)
        for i in range(width):
            if i != out:
                code = _mix(code * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i] + np.uint64(1))
        keys[:, :, out] = code
    table = np.arange(segments * width, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    return _mix(keys.reshape(len(symbols), -1) ^ table).view(np.int64)


def fingerprints(records: DataFrame, shingle: int, min_words: int, symbols: int) -> DataFrame:
    """(id, high, low, symbols): high and low are a 128-bit hash of the words, symbols the fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _constants(symbols)
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                tokens = words(text)
                if len(tokens) >= max(min_words, shingle):
                    copy = xxhash.xxh3_128_intdigest(" ".join(tokens))
                    rows.append((key, (copy >> 64) - 2**63, (copy & (2**64 - 1)) - 2**63, fingerprint(shingle_hashes(tokens, shingle), a, b).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "high", "low", "symbols"])

    kind = records.schema["id"].dataType.simpleString()
    return spread(records.filter("id is not null and text is not null"), "id").mapInPandas(run, f"id {kind}, high long, low long, symbols binary")


def candidate_pairs(representatives: DataFrame, segments: int, width: int) -> DataFrame:
    """Distinct (a, b), a < b, that share a table entry. representatives: (id, symbols)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                symbols = np.frombuffer(b"".join(batch["symbols"]), dtype=np.uint16).reshape(len(batch), -1)
                yield pd.DataFrame({"id": batch["id"], "keys": list(probe_keys(symbols[:, : segments * width], segments, width))})

    kind = representatives.schema["id"].dataType.simpleString()
    postings = representatives.mapInPandas(run, f"id {kind}, keys array<long>").select(F.explode("keys").alias("key"), "id")
    # An entry may hold a third of all records: those that hold many are cut into parts, so that no task counts or joins one whole.
    seen = representatives.filter(F.pmod(F.xxhash64("id"), F.lit(HOT_SHARE)) == 0).mapInPandas(run, f"id {kind}, keys array<long>").select(F.explode("keys").alias("key"))
    hot = cut_lineage(seen.groupBy("key").count().filter(F.col("count") >= HOT_ROWS).select("key", F.ceil(F.col("count") * HOT_SHARE / BLOCK_ROWS).alias("parts")))
    small = F.broadcast if hot.count() <= BROADCAST_ENTRIES else (lambda x: x)
    marked = postings.join(small(hot), "key", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0)))
    # Most entries hold one record; they leave before anything is joined.
    shared = cut_lineage(marked.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key", "part"))).filter("n > 1 or parts is not null").select("key", "id", "n", "parts"))
    blocks = F.coalesce("parts", F.ceil(F.col("n") / BLOCK_ROWS))
    left = shared.select("key", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), blocks).alias("block"))
    right = shared.select("key", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    return left.join(right, ["key", "block"]).filter("a < b").select("a", "b").distinct()


@F.pandas_udf(IntegerType())
def hamming(x: pd.Series, y: pd.Series) -> pd.Series:
    """Number of unequal symbols of two fingerprints."""
    if not len(x):
        return pd.Series([], dtype="int32")
    p, q = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), -1) for s in (x, y))
    return pd.Series((p != q).sum(axis=1).astype("int32"))


def _jaccard(shingle: int):
    @F.pandas_udf(DoubleType())
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y, strict=True):
            p, q = shingle_hashes(words(s), shingle), shingle_hashes(words(t), shingle)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / max(len(p) + len(q) - both, 1))
        return pd.Series(out, dtype="float64")

    return jaccard


def near_duplicates(
    records: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, shingle: int = SHINGLE_WORDS, min_words: int = MIN_WORDS,
    segments: int = SEGMENTS, width: int = SEGMENT_SYMBOLS, spare: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Links between representatives and the membership of all records.

    links(a, b, similarity), a < b; members(id, representative). Null ids or texts and texts of fewer than min_words
    words are no members. Repeated rows count once. An id that bears two texts is a member of two classes.
    Links of texts that differ only in the order of their words' runs have similarity 1.

    A pair of similarity s is a candidate with probability 1 - (1 - s^w - w s^(w-1) (1-s))^segments, w being width;
    the complete distance is then allowed the expected number of unequal symbols plus four standard deviations. spare symbols beyond the
    segments make that distance sharper without more keys.
    """
    n = segments * width + spare
    base = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = cut_lineage(fingerprints(base, shingle, min_words, n))
    classes = prints.groupBy("high", "low").agg(F.min("id").alias("representative"))
    members = prints.select("id", "high", "low").distinct().join(classes, ["high", "low"]).select("id", "representative")
    # The classes carry no fingerprints: those of the representatives are fetched by id, which is the order in which pairs are verified too.
    reps = prints.join(classes.select(F.col("representative").alias("id")), "id", "left_semi").dropDuplicates(["id", "high", "low"]).select("id", "symbols")
    # A representative that stands for two classes (an id with two texts) would meet itself; a < b drops that.
    farthest = math.ceil(n * (1 - threshold) + 4 * math.sqrt(n * threshold * (1 - threshold)))
    pairs = candidate_pairs(reps, segments, width)
    a, b = (reps.select(F.col("id").alias(x), F.col("symbols").alias(f"s{x}")) for x in "ab")
    close = cut_lineage(pairs.join(a, "a").join(b, "b").filter(hamming("sa", "sb") <= farthest).select("a", "b").distinct())
    # The texts are fetched for the few representatives in a close pair only.
    wanted = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
    texts = cut_lineage(base.filter("id is not null and text is not null").join(wanted, "id", "left_semi").distinct())
    ta, tb = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    scored = close.join(ta, "a").join(tb, "b").select("a", "b", _jaccard(shingle)("ta", "tb").alias("similarity"))
    links = scored.filter(F.col("similarity") >= threshold).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return links, members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Each pair of different records in linked classes or in the same class: (id_a, id_b), smaller first."""
    ma = members.select(F.col("representative").alias("a"), F.col("id").alias("ida"))
    mb = members.select(F.col("representative").alias("b"), F.col("id").alias("idb"))
    crossed = links.select("a", "b").join(ma, "a").join(mb, "b")
    # Only classes of two or more records meet themselves.
    copies = members.groupBy("representative").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select(F.col("representative").alias("a"))
    within = copies.join(ma, "a").join(mb.withColumnRenamed("b", "a"), "a").filter("ida < idb")
    both = crossed.select("ida", "idb").union(within.select("ida", "idb")).filter("ida <> idb")
    return both.select(F.least("ida", "idb").alias("id_a"), F.greatest("ida", "idb").alias("id_b")).distinct()


def groups(links: DataFrame, members: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, group): members of linked classes have the same group, the least representative among them.

    Each round takes the least label among the neighbours, then the label of that label, so a chain of n classes takes about log2(n) rounds.
    Labels are written every round; only classes with links take part.
    """
    edges = cut_lineage(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")))
    labels = edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label"))
    labels = cut_lineage(labels)
    for _ in range(most_rounds):
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        met = labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = met.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut_lineage(met.join(up, "label", "left").select("node", "old", F.coalesce("up", "label").alias("label")))
        labels = new.select("node", "label")
        if not new.filter("label <> old").take(1):
            break
    else:
        raise RuntimeError("groups haven't settled")
    joined = members.join(labels, F.col("representative") == F.col("node"), "left")
    return joined.groupBy("id").agg(F.min(F.coalesce("label", "representative")).alias("group"))


def p2_groups(spark, sf_dir: str) -> DataFrame:
    """One row per chunk in scope with its group of near-duplicates."""
    return groups(*near_duplicates(spark.read.parquet(f"{sf_dir}/chunks.parquet"), "chunk_id", "text")).select(F.col("id").alias("chunk_id"), F.col("group").alias("group_id"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose runs of three words are at least 60 % in common."""
    links, members = near_duplicates(spark.read.parquet(f"{sf_dir}/chunks.parquet"), "chunk_id", "text")
    return all_pairs(links, members).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_links(spark, sf_dir: str) -> DataFrame:
    """One row per chunk in scope: the chunk that represents its copies, and that chunk's number of links."""
    links, members = near_duplicates(spark.read.parquet(f"{sf_dir}/chunks.parquet"), "chunk_id", "text")
    degree = links.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(degree, "representative", "left").select(F.col("id").alias("chunk_id"), "representative", F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p2_found": p2_found, "p2_links": p2_links, "p2_groups": p2_groups}
SQL: dict[str, str] = {}
