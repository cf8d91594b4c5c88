"""Scores of a judge out of its raw answer, and their weighting: P18 of the survey, without Python."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the criteria.
WEIGHTS = {"completeness": 0.20, "coherence": 0.15, "relevance": 0.15, "boundary": 0.10, "fidelity": 0.40}
CRITERIA = tuple(WEIGHTS)
#: Criteria that must be present for a truncated answer to count.
LEAST_CRITERIA = 4


def weighted(scores: dict[str, Column]) -> Column:
    return F.round(sum((F.coalesce(scores[c], F.lit(0.0)) * w for c, w in WEIGHTS.items()), F.lit(0.0)), 4)


def _clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def with_scores(df: DataFrame, raw: str, name: str = "scores") -> DataFrame:
    """Struct of the criteria, final_score (always recomputed) and llm_final_score; null where too little can be read.

    A complete JSON object with all criteria is read as such. Otherwise each criterion is looked for by itself: a missing fidelity
    is the mean of the others, any other missing one 0. Values are held within [0, 1]. The column is added in steps, so that each part of the answer is
    looked for once a row.
    """
    body = F.regexp_extract(F.col(raw), r"(?s)(\{.*)", 1)
    out = df.withColumn("_part", body).withColumn("_whole", F.from_json(F.regexp_extract("_part", r"(?s)(\{.*\})", 1), "struct<" + ",".join(f"{c}:double" for c in (*CRITERIA, "final_score")) + ">"))
    found = F.struct(*(_clamp(F.regexp_extract("_part", rf'"{c}"\s*:\s*([0-9]*\.?[0-9]+)', 1).try_cast("double")).alias(c) for c in (*CRITERIA, "final_score")))
    whole = F.struct(*(_clamp(F.col(f"_whole.{c}")).alias(c) for c in (*CRITERIA, "final_score")))
    complete = F.lit(True)
    for c in CRITERIA:
        complete = complete & F.col(f"_whole.{c}").isNotNull()
    out = out.withColumn("_complete", F.coalesce(complete, F.lit(False))).withColumn("_s", F.when(F.col("_complete"), whole).otherwise(found))
    n = sum((F.col(f"_s.{c}").isNotNull().cast("int") for c in CRITERIA), F.lit(0))
    out = out.withColumn("_n", n)
    mean = F.round(F.try_divide(sum((F.coalesce(F.col(f"_s.{c}"), F.lit(0.0)) for c in CRITERIA), F.lit(0.0)), F.col("_n")), 3)
    filled = {c: F.coalesce(F.col(f"_s.{c}"), mean if c == "fidelity" else F.lit(0.0)) for c in CRITERIA}
    out = out.withColumn("_f", F.struct(*(v.alias(c) for c, v in filled.items())))
    own = {c: F.col(f"_f.{c}") for c in CRITERIA}
    result = F.struct(*(own[c].alias(c) for c in CRITERIA), weighted(own).alias("final_score"), F.coalesce(F.col("_s.final_score"), F.lit(0.0)).alias("llm_final_score"))
    return out.withColumn(name, F.when(F.col("_n") >= LEAST_CRITERIA, result)).drop("_part", "_whole", "_complete", "_s", "_n", "_f")


#: Characters of the original and of the chunk that a judge is shown, and how often it is asked for an answer that can be read.
SHOWN_ORIGINAL, SHOWN_CHUNK, ATTEMPTS = 1_200, 1_000, 3


def final_score(answer: str) -> float | None:
    """final_score of a judge's raw answer by the rules of with_scores, on one text; None where too little can be read."""
    start = answer.find("{")
    found = {c: re.search(rf'"{c}"\s*:\s*([0-9]*\.?[0-9]+)', answer[start:]) for c in CRITERIA} if start >= 0 else {}
    values = {c: min(max(float(m.group(1)), 0.0), 1.0) for c, m in found.items() if m}
    if len(values) < LEAST_CRITERIA:
        return None
    values.setdefault("fidelity", round(sum(values.values()) / len(values), 3))
    return round(sum(values.get(c, 0.0) * w for c, w in WEIGHTS.items()), 4)


def judged(ask: Callable[[str, str], str], attempts: int = ATTEMPTS) -> Callable[[Column, Column], Column]:
    """A scorer for rechunk out of a judge, ask(original, chunk) -> raw answer.

    The judge is shown the beginnings only, blank chunks aren't scored, an answer that can't be read or an error is asked for again, and where all
    attempts fail the score is null: none is invented. A pair that comes again in a batch is asked once; pairing.memoised keeps scores over runs.
    """

    @F.pandas_udf("double")
    def run(chunks: pd.Series, originals: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float | None] = {}

        def one(chunk: str | None, original: str | None) -> float | None:
            if not chunk or not chunk.strip():
                return None
            shown = (original or "")[:SHOWN_ORIGINAL].strip(), chunk[:SHOWN_CHUNK].strip()
            if (shown[0], chunk) not in known:
                score = None
                for _ in range(attempts):
                    try:
                        score = final_score(ask(*shown))
                    except Exception:
                        continue
                    if score is not None:
                        break
                known[shown[0], chunk] = score
            return known[shown[0], chunk]

        return pd.Series([one(c, o) for c, o in zip(chunks, originals, strict=True)], dtype="float64")

    return lambda chunk, original: F.nanvl(run(chunk, original), F.lit(None).cast("double"))
