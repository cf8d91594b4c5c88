"""Problem 5: cut oversized items at natural boundaries, with an overlap.

A text is split by sections; a section that is still too long by paragraphs, then lines, sentences, words and last characters.
The parts are packed greedily; each piece but the first begins with the last `overlap` tokens of the one
before, wherever these begin. A token is four characters, so a piece of at most n tokens has at most 4n + 3 characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS = 300
OVERLAP_TOKENS = 20
TOKEN_CHARS = 4

#: Ends of the parts at each level, from the widest; the separator stays with the part before it.
LEVELS = (
    ("section", re.compile(r"\s*\n(?=#{1,6} )|\n[ \t\r]*\n[ \t\r]*\n\s*")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"[ \t\r]*\n[\n\r]*")),
    ("sentence", re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+")),
    ("word", re.compile(r"\s+")),
)
CHARACTER = len(LEVELS)
WORD_LEVEL = [name for name, _ in LEVELS].index("word")

_ENDED = re.compile(r"[.!?…][\"'»”’)\]]*$")

#: Closing marks that can't begin a sentence.
CLOSING = set(".,;:!?)]}»”’%")


def parts(text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, level of the boundary at start) covering the text, none longer than most."""
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(text), 0, 0)]  # start, end, level to split at, level of the start
    while todo:
        start, end, level, began = todo.pop()
        if end - start <= most:
            out.append((start, end, began))
        elif level == CHARACTER:
            out.extend((i, min(i + most, end), began if i == start else CHARACTER) for i in range(start, end, most))
        else:
            cuts = [start, *(m.end() for m in LEVELS[level][1].finditer(text, start, end) if start < m.end() < end), end]
            todo.extend((a, b, level + 1, began if a == start else level) for a, b in reversed(list(zip(cuts, cuts[1:]))))
    return out


def mid_sentence(text: str) -> bool:
    """The first character that isn't blank is a lower-case letter or a closing mark."""
    head = text.lstrip()[:1]
    return bool(head) and (head.islower() or head in CLOSING)


def split_text(text: str, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int, int, bool]]:
    """(start, start of the part not shared, end, boundary_issue) of each piece.

    boundary_issue: the piece as it comes out, the shared part included, begins or ends within a sentence. A text within the limit is one piece, an
    empty text none.
    """
    if not text:
        return []
    most, shared = limit * TOKEN_CHARS + TOKEN_CHARS - 1, overlap * TOKEN_CHARS
    if len(text) <= most:
        return [(0, 0, len(text), mid_sentence(text))]
    if most <= shared:
        raise ValueError("the limit must exceed the overlap")
    cores: list[list[int]] = []
    for start, end, level in parts(text, most - shared):
        room = most - (shared if len(cores) > 1 else 0)
        if cores and end - cores[-1][0] <= room:
            cores[-1][1] = end
        else:
            cores.append([start, end, level])
    out = []
    for k, (start, end, level) in enumerate(cores):
        first = max(start - shared, 0) if k else 0
        ends = k + 1 < len(cores) and cores[k + 1][2] >= WORD_LEVEL
        out.append((first, start, end, begins_inside(text, first) or ends))
    return out


def begins_inside(text: str, at: int) -> bool:
    """The place is within a sentence: no boundary of a sentence, line or paragraph is before it but for blanks, or what follows can't begin a sentence."""
    if at == 0:
        return mid_sentence(text)
    after = at
    while after < len(text) and text[after].isspace():
        after += 1
    before = after
    while before > 0 and text[before - 1].isspace():
        before -= 1
    if before == 0:
        return mid_sentence(text)
    blanks = text[before:after]
    ended = "\n" in blanks or bool(blanks) and bool(_ENDED.search(text, max(before - 8, 0), before))
    return not ended or mid_sentence(text[after : after + 1])


def split_oversized(records: DataFrame, id_col: str, text_col: str, position_col: str | None = None, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Pieces of the records above the limit, a row each.

    (id, piece, text, token_count, chunk_start_position, own_start, boundary_issue); own_start is the offset within the
    record of the part not shared with the piece before. chunk_start_position continues the record's own position
    (null counts as 0). Null texts and texts within the limit give no row; equal (id, text, position) rows count once.
    Only oversized texts reach Python.
    """
    start = F.coalesce(F.col(position_col), F.lit(0)).cast("long") if position_col else F.lit(0).cast("long")
    big = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), start.alias("at")).filter(
        F.expr(f"length(text) div {TOKEN_CHARS}") > limit
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "piece", "text", "token_count", "chunk_start_position", "own_start", "boundary_issue"]
        for batch in batches:
            rows = [
                (key, k, text[a:c], (c - a) // TOKEN_CHARS, at + a, b, issue)
                for key, text, at in zip(batch["id"], batch["text"], batch["at"], strict=True)
                for k, (a, b, c, issue) in enumerate(split_text(text, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=columns)

    kind = records.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, text string, token_count int, chunk_start_position long, own_start long, boundary_issue boolean"
    return big.distinct().mapInPandas(run, schema)


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Chunks of more than 300 tokens, whatever token_count says: those that come out in more than one piece."""
    pieces = split_oversized(spark.read.parquet(f"{sf_dir}/chunks.parquet"), "chunk_id", "text", "chunk_start_position")
    return pieces.filter("piece = 1 and id is not null").select(F.col("id").alias("chunk_id")).distinct()


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    """The pieces."""
    return split_oversized(spark.read.parquet(f"{sf_dir}/chunks.parquet"), "chunk_id", "text", "chunk_start_position").withColumnRenamed("id", "chunk_id")


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
SQL = {"p5_found": "select distinct chunk_id from chunks where length(text) // 4 > 300"}
