"""Problem 4: defective question and answer pairs.

Answers are cut into clauses, names and numbers masked. Each clause is clustered with labelled refusals by verified MinHash
over runs of characters. A clause that recurs across unrelated prompts, in answers that say nothing else, is a refusal template
whether or not it is like a labelled one. Copy, language and termination checks label what remains. One defect a
message, the first of empty, copy, refusal, language, truncated that applies.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .conversations import answer_pairs, latest_messages
from .encoding import language_samples
from .neardup import _constants, _mix, probe_keys
from .pair_exemplars import COURTESY, REFUSALS
from .words import WORD, folded_words, has_word

#: Words of a clause that says something.
CLAUSE_WORDS = 3
#: Likeness, by runs of so many characters, of a clause to a labelled refusal.
SIMILARITY = 0.5
RUN_CHARS = 4
#: Fingerprint of a clause: a pair at the least likeness is a candidate with probability 0.989.
SEGMENTS, SEGMENT_SYMBOLS = 12, 4
#: Clauses that a worker remembers.
KNOWN_CLAUSES = 200_000
#: Templates that are sent along with a join; more of them are joined by shuffle.
BROADCAST_TEMPLATES = 200_000
#: Different prompts that make a clause a template at least, the share of all prompts that they must be, and the share of its answers
#: that may say anything else.
RECURRING_PROMPTS = 8
RECURRING_SHARE = 1e-4
CONTENT_SHARE = 0.1
#: Times that words stand within items at least, and the share of their places that may close one, for an end with them to be unfinished.
WITHIN_ITEMS = 3
CLOSING_SHARE = 0.02
#: Likeness, by characters, of an answer to its question.
COPY_RATIO = 0.84
#: Log-odds that a text is in one language rather than another.
LANGUAGE_MARGIN = 4.0

_CLAUSE = re.compile(r"[.!?;:,…]+(?=\s|$)|\n+|\s[–—-]\s|[«»\"“”]")
_VALUE = re.compile(r"(?P<code>\b[A-Z]{2,5}_?\d+\b|\b\d+(?:[.,]\d+)*\b)|(?<!^)(?<![.!?] )\b[^\W\d_a-zà-ÿ][^\W\d_]+")
_MARKS = re.compile(r"(?:[@#] ?)+")
_GREETING = re.compile(r"^\s*(?:bonjour|hello|hi|guten tag|hallo|hola|buenos días)\s*,\s*", re.IGNORECASE)
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+(\S.*)$")
_PATH = re.compile(r"(?:^|\s)(?:[A-Za-z]:\\|/)\S*\.\w{1,5}$")
_DONE = re.compile(r"[.!?][\"'»”’)\]*_]*$")
_VERSION = re.compile(r"(?:version|versión|release)\s+\d+\.$", re.IGNORECASE)
_LABEL = re.compile(r"^\W*(?:a|q|r|answer|question|réponse|frage|antwort|pregunta|respuesta)\s*:\s*", re.IGNORECASE)
_QUOTED = re.compile(r"«[^»]*»|\"[^\"\n]*\"|“[^”]*”|„[^“”]*[“”]|```.*?(?:```|$)|(?:[A-Za-z]:\\|/)\S+", re.DOTALL)


def valued_clauses(text: str) -> list[tuple[str, list[str]]]:
    """Clauses in lower case without accents, in which names are @, numbers and codes #; and what the marks stand for."""
    out = []
    for sentence in re.split(r"(?<=[.!?…])\s+|\n+", _GREETING.sub("", text)):
        values: list[str] = []

        def mask(m: re.Match) -> str:
            values.append(" ".join(folded_words(m.group())))  # noqa: B023
            return " zzcode " if m.lastgroup == "code" else " zzname "

        at = 0
        for part in _CLAUSE.split(_VALUE.sub(mask, sentence)):
            words = ["@" if w == "zzname" else "#" if w == "zzcode" else w for w in folded_words(part)]
            marks = sum(w in "@#" for w in words)
            if words:
                out.append((" ".join(words), values[at : at + marks]))
            at += marks
    return out


def clauses(text: str) -> list[str]:
    return [c for c, _ in valued_clauses(text)]


def _plain(clause: str) -> str:
    """For the fingerprints, whose words are letters and digits."""
    return clause.replace("@", "zzname").replace("#", "zzcode")


def clause_id(clause: str) -> int:
    return xxhash.xxh3_64_intdigest(clause) - 2**63


def finished(text: str) -> tuple[bool, str | None]:
    """(whether the text comes to an end, the last item's closing words if only they can tell)."""
    text = text.rstrip()
    if text.count("```") % 2:
        return False, None
    if text.endswith("```"):
        return True, None
    last = text.rsplit("\n", 1)[-1]
    if last.lstrip().startswith("|"):
        return last.endswith("|"), None
    if text.endswith(("…", "...")):
        return False, None
    path = _PATH.search(text)
    if path:
        before = text[: path.start()].rstrip()
        head = text[: path.start()].rsplit("\n", 1)[-1]
        return not before or before.endswith("```") or bool(_DONE.search(before)) or bool(_ITEM.match(head)) or not head.strip(), None
    item = _ITEM.match(last)
    if item:
        if _DONE.search(last):
            return True, None
        return (False, None) if last[-1] in ",:;(«–-" else (True, ending(item.group(1)))
    if re.fullmatch(r"\s*(?:[-*•]|\d+[.)]?)\s*", last):
        return False, None
    return bool(_DONE.search(text)) and not _VERSION.search(text), None


def masked_words(line: str) -> list[str]:
    return _plain(" ".join(clauses(line))).split()


def ending(line: str) -> str | None:
    """The closing two words of a list item, masked."""
    words = masked_words(line)
    return " ".join(words[-2:]) if len(words) > 1 else None


def item_places(text: str) -> list[tuple[str, int]]:
    """(two words, 1 if they close an item, else 0) of all items but one that ends the text."""
    out, lines = [], text.rstrip().split("\n")
    for line in lines[:-1]:
        item = _ITEM.match(line)
        if item:
            words = masked_words(item.group(1))
            out += [(f"{a} {b}", int(k == len(words) - 2)) for k, (a, b) in enumerate(zip(words, words[1:]))]
    return out


def is_copy(question: str, answer: str) -> bool:
    """The answer gives back the question, once or twice, perhaps cut, labelled or in other spelling."""
    q = "".join(folded_words(question))
    a = "".join(folded_words(_LABEL.sub("", answer.strip().lstrip("> "))))
    if q and a in (q, q + q):
        return True
    if len(q) < 8 or not a or len(a) > 2.3 * len(q) + 12 or len(a) < 0.55 * len(q):
        return False
    if a in q or a in q + q:
        return True
    m = difflib.SequenceMatcher(None, q + q if len(a) > 1.4 * len(q) else q, a, autojunk=False)
    return m.quick_ratio() >= COPY_RATIO and m.ratio() >= COPY_RATIO


class LanguageModel:
    """Word frequencies by language, from labelled texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.logs: dict[str, dict[str, float]] = {}
        counts = {lang: Counter(w for t in texts for w in WORD.findall(t.lower()) if w.isalpha()) for lang, texts in samples.items()}
        vocabulary = {w for c in counts.values() for w, n in c.items() if n > 2}
        for lang, c in counts.items():
            total = sum(c[w] for w in vocabulary) + len(vocabulary)
            self.logs[lang] = {w: math.log((c[w] + 1) / total) for w in vocabulary}

    def score(self, text: str) -> dict[str, float]:
        words = [w for w in WORD.findall(text.lower()) if w.isalpha()]
        return {lang: sum(logs[w] for w in words if w in logs) for lang, logs in self.logs.items()}

    def differs(self, question: str, answer: str) -> bool:
        """Both languages are clear and not the same; quotations, code and paths don't count."""
        if len(self.logs) < 2:
            return False
        q, a = self.score(question), self.score(_QUOTED.sub(" ", answer))
        own, other = max(q, key=q.get), max(a, key=a.get)
        return own != other and q[own] - q[other] >= LANGUAGE_MARGIN and a[other] - a[own] >= LANGUAGE_MARGIN


def clause_runs(clause: str) -> list[int]:
    """Distinct hashes of a clause's runs of characters, in order; names and codes are one mark."""
    t = f" {_MARKS.sub('@ ', clause).strip()} "
    return sorted({xxhash.xxh3_64_intdigest(t[i : i + RUN_CHARS]) for i in range(max(len(t) - RUN_CHARS + 1, 1))})


def fingerprints_of(runs: list[list[int]]) -> np.ndarray:
    """A fingerprint for each set of runs, all sets at once."""
    a, b = _constants(SEGMENTS * SEGMENT_SYMBOLS)
    flat = np.fromiter((h for own in runs for h in own), dtype=np.uint64, count=sum(map(len, runs)))
    first = np.cumsum([0, *map(len, runs[:-1])])
    return (np.minimum.reduceat(_mix(flat[:, None] * a + b), first, axis=0) >> np.uint64(40)).astype(np.uint16)


class Refusals:
    """Labelled refusals under the table entries of their fingerprints."""

    def __init__(self, texts: tuple[str, ...], courtesy: tuple[str, ...]):
        self.courtesy = _labelled(courtesy)
        self.openings: dict[str, list[str]] = defaultdict(list)
        for c in sorted(self.courtesy, key=lambda c: (-len(c), c)):
            self.openings[c.split(" ", 1)[0]].append(c + " ")
        self.runs = [clause_runs(c) for c in sorted({self.stripped(c) for c in _labelled(texts)} - self.courtesy) if c.count(" ") + 1 >= CLAUSE_WORDS]
        self.table: dict[int, list[int]] = defaultdict(list)
        for k, keys in enumerate(self._keys(self.runs)):
            for key in keys:
                self.table[key].append(k)
        self.known: dict[str, bool] = {}

    @staticmethod
    def _keys(runs: list[list[int]]) -> list[list[int]]:
        return probe_keys(fingerprints_of(runs), SEGMENTS, SEGMENT_SYMBOLS).tolist() if runs else []

    def stripped(self, clause: str) -> str:
        """The clause without a courtesy that it begins with, where enough is left."""
        for opening in self.openings.get(clause.split(" ", 1)[0], ()):
            if clause.startswith(opening) and clause.count(" ", len(opening)) + 1 >= CLAUSE_WORDS:
                return clause[len(opening) :]
        return clause

    def look_up(self, clauses_: set[str]) -> dict[str, bool]:
        """Whether each clause is like a labelled refusal: candidates by shared entries, verified by complete similarity."""
        if len(self.known) > KNOWN_CLAUSES:
            self.known.clear()
        new = sorted(clauses_ - self.known.keys())
        for i in range(0, len(new), 2_000):  # bounds the matrix
            part = new[i : i + 2_000]
            runs = [clause_runs(c) for c in part]
            for c, own, keys in zip(part, runs, self._keys(runs), strict=True):
                self.known[c] = any(self._alike(own, k) for k in {k for key in keys if key in self.table for k in self.table[key]})
        return {c: self.known[c] for c in clauses_}

    def _alike(self, runs: list[int], k: int) -> bool:
        both = len(set(runs) & set(self.runs[k]))
        return both >= SIMILARITY * (len(runs) + len(self.runs[k]) - both)

    def declines(self, clause: str) -> bool:
        return self.look_up({clause})[clause]


def answer_clauses(pairs: DataFrame, refusals: tuple[str, ...] = REFUSALS, courtesy: tuple[str, ...] = COURTESY) -> DataFrame:
    """(message_id, prompt, clause_id, words, declines): the clauses of each answer but courtesies and those of too few words.

    prompt is a hash of the question's words, clause_id one of the clause in which only names and codes that the question holds are masked: a template
    gives back what it was asked for, an answer says something else each time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Refusals(refusals, courtesy)
        for batch in batches:
            rows = []
            for key, q, a in zip(batch["message_id"], batch["question"], batch["answer"], strict=True):
                asked = folded_words(q or "")
                prompt, given = clause_id(" ".join(asked)), f" {' '.join(asked)} "
                for c, values in valued_clauses(a or ""):
                    c = known.stripped(c)
                    n = c.count(" ") + 1
                    if n >= CLAUSE_WORDS and c not in known.courtesy:
                        own = [v for v in values if f" {v} " not in given]
                        rows.append((key, prompt, clause_id(" ".join([c, *own])), n, c))
            out = pd.DataFrame(rows, columns=["message_id", "prompt", "clause_id", "words", "declines"])
            out["declines"] = out["declines"].map(known.look_up(set(out["declines"]))).astype(bool)
            yield out

    return pairs.select("message_id", "question", "answer").mapInPandas(run, "message_id string, prompt long, clause_id long, words int, declines boolean")


def _labelled(texts: tuple[str, ...]) -> set[str]:
    return {c for t in texts for x in ("Zanelor", "ABC_123") for c in clauses(re.sub(r"\bX\b", x, t))}


def refusal_messages(pairs: DataFrame, refusals: tuple[str, ...] = REFUSALS, courtesy: tuple[str, ...] = COURTESY) -> DataFrame:
    """message_id of the answers that decline: what is like a labelled refusal outweighs what is said, or nothing is said but templates, and one of
    these hardly ever goes with anything said."""
    told = cut_lineage(answer_clauses(pairs, refusals, courtesy))
    asked = told.agg(F.countDistinct("prompt").alias("asked"))  # one row
    counted = told.filter("not declines").groupBy("clause_id").agg(F.countDistinct("prompt").alias("prompts"))
    templates = cut_lineage(
        counted.filter(F.col("prompts") >= RECURRING_PROMPTS).crossJoin(F.broadcast(asked)).filter(F.col("prompts") >= F.col("asked") * RECURRING_SHARE)
        .select("clause_id", F.lit(True).alias("template"))
    )
    small = F.broadcast if templates.count() <= BROADCAST_TEMPLATES else (lambda x: x)
    known = told.join(small(templates), "clause_id", "left").withColumn("template", F.coalesce("template", F.lit(False)))
    words = F.col("words")
    by_message = cut_lineage(
        known.groupBy("message_id").agg(
            F.sum(F.when(F.col("declines"), words).otherwise(0)).alias("declining"), F.sum(F.when(F.col("declines") | F.col("template"), 0).otherwise(words)).alias("saying"),
            F.bool_or("template").alias("templated"),
        )
    )
    # Templates whose answers hardly ever say anything else reveal refusals that no exemplar names.
    recurring = known.filter("template").select("message_id", "clause_id").join(by_message.filter("templated").select("message_id", "saying"), "message_id")
    bare = recurring.groupBy("clause_id").agg(F.avg((F.col("saying") > 0).cast("int")).alias("share")).filter(F.col("share") <= CONTENT_SHARE).select("clause_id")
    revealed = recurring.filter("saying = 0").join(small(bare), "clause_id", "left_semi").select("message_id")
    declined = by_message.filter(F.col("declining") >= F.greatest(F.lit(1), F.col("saying"))).select("message_id")
    return declined.union(revealed).distinct()


def unfinished_endings(pairs: DataFrame) -> DataFrame:
    """Closing words that, over all list items, stand within items (three times or more) and hardly ever close one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["answer"]:
                counts.update(item_places(text))
            yield pd.DataFrame([(w, end, n) for (w, end), n in counts.items()], columns=["ending", "closes", "n"])

    places = pairs.select("answer").filter("answer is not null").mapInPandas(run, "ending string, closes int, n long")
    sums = places.groupBy("ending").agg(F.sum(F.col("n") * F.col("closes")).alias("closing"), F.sum(F.col("n") * (1 - F.col("closes"))).alias("within"))
    return sums.filter((F.col("within") >= WITHIN_ITEMS) & (F.col("closing") <= CLOSING_SHARE * (F.col("closing") + F.col("within")))).select("ending")


def defective_pairs(messages: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(message_id, defect) of the assistant messages that answer the user message before them badly.

    pages are labelled with their language; the language check is trained on a bounded sample of them and left out without
    them. Null contents are empty. Each message comes once, as last delivered; messages whose place in the
    conversation is unknown (no time) are no pair.
    """
    pairs = cut_lineage(answer_pairs(latest_messages(messages)))
    model = LanguageModel(language_samples(pages, id_col, text_col, lang_col) if pages is not None else {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, q, a in zip(batch["message_id"], batch["question"], batch["answer"], strict=True):
                q, a = q or "", a or ""
                done, end = finished(a)
                rows.append((key, is_copy(q, a), model.differs(q, a), not done, end))
            yield pd.DataFrame(rows, columns=["message_id", "copy", "other", "cut", "ending"])

    speaking = pairs.filter(has_word(F.col("answer")))
    checked = speaking.select("message_id", "question", "answer").mapInPandas(run, "message_id string, copy boolean, other boolean, cut boolean, ending string")
    declined = refusal_messages(speaking).withColumn("declined", F.lit(True))
    ends = unfinished_endings(speaking).withColumn("open", F.lit(True))
    defect = F.when(F.col("copy"), "copy").when(F.col("declined"), "refusal").when(F.col("other"), "language").when(F.col("cut") | F.col("open"), "truncated")
    labelled = checked.join(declined, "message_id", "left").join(ends, "ending", "left").select("message_id", defect.alias("defect")).filter("defect is not null")
    empty = pairs.filter(~has_word(F.col("answer"))).select("message_id", F.lit("empty").alias("defect"))
    return labelled.unionByName(empty)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Defective answers."""
    return defective_pairs(spark.read.parquet(f"{sf_dir}/chat_messages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p4_opinions(spark, sf_dir: str) -> DataFrame:
    """How often each opinion of the users goes with each defect found."""
    issue = F.coalesce(F.nullif(F.lower(F.trim("issue_type")), F.lit("")), F.lit("none"))
    opinions = spark.read.parquet(f"{sf_dir}/feedback.parquet").select("message_id", issue.alias("issue_type"))
    return (
        opinions.join(p4_found(spark, sf_dir), "message_id", "left")
        .groupBy("issue_type", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("n"))
    )


QUERIES = {"p4_found": p4_found, "p4_opinions": p4_opinions}
SQL: dict[str, str] = {}
