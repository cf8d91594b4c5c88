"""Problem 7: passages of evaluation items in corpus documents, by pigeonhole matching.

An item of n words is split into k + 1 pieces of `min_run / 2` words, k being its error budget: a text that
holds the item with at most k word errors holds a piece unharmed. As any min_run words in a row
contain a whole piece too, the exact hits of pieces miss neither edited, full nor partial copies.

Items stay a table. Their pieces are hashed; a bitmap of fixed size, made of these hashes, tells each task which of a document's word runs may
be a piece, so that documents are read once however many items there are, and only possible hits meet the pieces in a join. Around the hits Myers'
bit-parallel algorithm gives the edit distance, in words, of the item to the document: within the budget it is a leak. Otherwise a run of
min_run words in common makes it a partial one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread

MIN_RUN = 12
#: Bits of the bitmap of pieces, as a power of two: 2 MB, whatever the number of items. False hits go in the join.
BITMAP_POWER = 24
#: Pieces that are sent along with the join; more of them are joined by shuffle.
BROADCAST_PIECES = 200_000

_APART = re.compile(r"[\W_]+")
_MARKS = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯]+")


def normalized(text: str) -> str:
    """Words without case and accents, each followed by one blank, the first preceded by one."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text.casefold()))
    return f" {_APART.sub(' ', text.lower()).strip()} "


def word_hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words, by the place where it begins."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def error_budget(words: int, min_run: int) -> int:
    """Word errors that leave at least one of the item's pieces unharmed."""
    return words // max(min_run // 2, 1) - 1


def myers_distance(pattern: list[str], text: list[str]) -> int:
    """Least edit distance, in words, of the pattern to any stretch of the text."""
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = mask, 0, m, m
    for w in text:
        eq = where.get(w, 0)
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hp, hn = vn | ~(d0 | vp), vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        best = min(best, score)
        hp, hn = (hp << 1) & mask, (hn << 1) & mask
        vp, vn = (hn | ~(d0 | hp)) & mask, hp & d0
    return best


def longest_run(item: list[str], text: list[str]) -> int:
    """Most words in a row that both have."""
    places = defaultdict(list)
    for i, w in enumerate(item):
        places[w].append(i)
    best, ending = 0, {}
    for w in text:
        ending = {i: ending.get(i - 1, 0) + 1 for i in places.get(w, ())}
        if ending:
            best = max(best, max(ending.values()))
    return best


def compared(item: list[str], text: list[str], starts: list[int], min_run: int) -> tuple[int, int]:
    """(distance, longest run) of an item to a text that holds pieces of it, where the item would begin at starts."""
    distance, run = len(item), 0
    for a, b in _stretches(starts, len(item)):
        near = text[max(a, 0) : max(b, 0)]
        d = myers_distance(item, near)
        distance = min(distance, d)
        if d <= len(item) - min_run:  # a shared run bounds the distance
            run = max(run, longest_run(item, near))
    return distance, run


def _stretches(starts: list[int], n: int) -> list[tuple[int, int]]:
    """Stretches of the document, each an item's length around the hits; overlapping ones are joined."""
    out: list[list[int]] = []
    for s in starts:
        a, b = s - n, s + 2 * n
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _pieces(items: DataFrame, width: int) -> DataFrame:
    """(item, piece, offset): hash and place of each whole piece of the items; the words left over at an item's end need none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["item"], batch["item_text"], strict=True):
                own = run_hashes(word_hashes(normalized(text).split()), width)[::width]
                rows += [(key, int(h), k * width) for k, h in enumerate(own.view(np.int64))]
            yield pd.DataFrame(rows, columns=["item", "piece", "offset"])

    return items.select("item", "item_text").mapInPandas(run, "item long, piece long, offset int")


def _bitmap(pieces: DataFrame, power: int) -> bytes:
    """Bits of the pieces' hashes. Only the distinct bytes that aren't zero come to the driver, at most as many as the bitmap has."""
    bit = F.shiftrightunsigned("piece", 64 - power)
    shifted = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(bit, F.lit(8)).cast("int") + 1)
    got = pieces.groupBy(F.shiftright(bit, 3).alias("at")).agg(F.bit_or(shifted).alias("bits")).toPandas()
    out = np.zeros(1 << max(power - 3, 0), dtype=np.uint8)
    out[got["at"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.uint8)
    return out.tobytes()


def find_leaks(
    documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str, min_run: int = MIN_RUN, power: int = BITMAP_POWER
) -> DataFrame:
    """(doc_id, item_id, distance, longest_run, item_words, within_budget): documents that hold an item with no more word errors than its budget, or
    min_run words in a row of it.

    Documents without a hit are never shuffled. Null ids and texts and items of fewer than min_run words match nothing;
    repeated rows count once; an item id that bears several texts stands for each of them. longest_run is 0 where the distance rules out a run of
    min_run words.
    """
    width = max(min_run // 2, 1)
    asked = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text")).filter("item_id is not null and item_text is not null").distinct()
    asked = cut_lineage(asked.withColumn("item", F.xxhash64("item_id", "item_text")))
    pieces = cut_lineage(_pieces(asked, width))
    bits = _bitmap(pieces, power)
    docs = spread(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null"), "doc_id")

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = np.frombuffer(bits, dtype=np.uint8)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = normalized(text).split()
                runs = run_hashes(word_hashes(words), width)
                at = runs >> np.uint64(64 - power)
                found = np.nonzero(bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)[0]
                if len(found):
                    rows.append((key, xxhash.xxh3_64_intdigest(text) - 2**63, " ".join(words), runs[found].view(np.int64).tolist(), found.tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "version", "words", "pieces", "places"])

    kind = documents.schema[id_col].dataType.simpleString()
    held = cut_lineage(docs.mapInPandas(hits, f"doc_id {kind}, version long, words string, pieces array<long>, places array<int>"))
    each = held.select("doc_id", "version", F.explode(F.arrays_zip("pieces", "places")).alias("h")).select("doc_id", "version", F.col("h.pieces").alias("piece"), F.col("h.places").alias("place"))
    small = F.broadcast if pieces.count() <= BROADCAST_PIECES else (lambda x: x)
    met = each.join(small(pieces), "piece").groupBy("doc_id", "version", "item").agg(F.collect_set(F.col("place") - F.col("offset")).alias("starts"))
    pairs = met.join(held.select("doc_id", "version", "words").dropDuplicates(["doc_id", "version"]), ["doc_id", "version"]).join(asked, "item")

    @F.pandas_udf("distance int, longest_run int, item_words int")
    def verified(item_text: pd.Series, words: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for i, w, s in zip(item_text, words, starts, strict=True):
            item = normalized(i).split()
            rows.append((*compared(item, w.split(), sorted(s), min_run), len(item)))
        return pd.DataFrame(rows, columns=["distance", "longest_run", "item_words"])

    judged = pairs.select("doc_id", "item_id", verified("item_text", "words", "starts").alias("v")).select("doc_id", "item_id", "v.*")
    within = F.col("distance") <= F.expr(f"item_words div {width}") - 1
    leaks = judged.filter(F.col("item_words") >= min_run).withColumn("within_budget", within).filter(F.col("within_budget") | (F.col("longest_run") >= min_run))
    return leaks.groupBy("doc_id", "item_id").agg(
        F.min("distance").alias("distance"), F.max("longest_run").alias("longest_run"), F.max("item_words").alias("item_words"), F.bool_or("within_budget").alias("within_budget")
    )


def p7_leaks(spark, sf_dir: str) -> DataFrame:
    """Each leak, edited ones included, with the item's distance in words and the longest run."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{sf_dir}/eval_items.parquet"), "item_id", "text")


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Documents with at least twelve words in a row of an item: the leaks whose longest run shows it."""
    return p7_leaks(spark, sf_dir).filter(F.col("longest_run") >= MIN_RUN).select("doc_id", "item_id")


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
SQL = {
    "p7_found": r"""
with d as (select doc_id, string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from documents where text is not null),
i as (select item_id, string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from eval_items where text is not null),
dr as (select distinct doc_id, array_to_string(w[k:k+11], ' ') as run from d, unnest(range(1, len(w) - 10)) as u(k)),
ir as (select distinct item_id, array_to_string(w[k:k+11], ' ') as run from i, unnest(range(1, len(w) - 10)) as u(k))
select distinct doc_id, item_id from dr join ir using (run)"""
}
