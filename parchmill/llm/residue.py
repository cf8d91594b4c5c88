"""Problem 8: pages with template residue, filler, or an error page or notice instead of content.

Pages are cut into passages: sentences, lines, and what stands between brackets or template marks. Labelled exemplars are
retrieved for each passage through an inverted index and scored by TF-IDF containment: the weight of the
exemplar's words that the passage holds in their order and near each other, over its whole weight. Document frequencies are counted over
all documents. The index lists an exemplar under its heaviest words only, as many as any passage with the least containment
must hold one of, so retrieval misses nothing. A match counts only where it also covers most of its passage, so that the words of an
exemplar within ordinary prose are none; exemplars that explain placeholders, messages or settings compete with the others.

What has no wording is normalised before that: names between template marks, numbers, codes, dotted names and blanks are one word each.
Repetition and keyboard mashing share no word with any exemplar, so no containment finds them; they are measured directly.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .residue_exemplars import EXEMPLARS

#: Least share of an exemplar's weight in a passage.
CONTAINMENT = 0.75
#: Least share of the passage's words that matches of notes and filler must cover, if the exemplar is a short one.
PASSAGE_COVERAGE = 0.6
#: Words of four or more letters that make an exemplar a long one: it counts wherever it stands.
LONG_EXEMPLAR = 4
#: Words between two successive words of a match, at most: for exemplars of up to five words, and for longer ones.
SHORT_GAP, GAP = 1, 8
#: Share of a passage's words that matches of messages and notices cover at least, for the passage to be one.
MESSAGE_COVERAGE = 0.3
#: Messages and notices are a case where their passages have this share of the page's words.
COVERAGE = 0.5
#: The same for a page that came as raw markup with a head of its own.
RAW_COVERAGE = 0.25
#: A passage is keyboard mashing if its lower-case words' letter pairs tell less of each other, in nats a pair, than this.
MASH = 0.08

#: Labels that count wherever they stand, and those that must make up the page.
ANYWHERE, INSTEAD = ("placeholder", "todo", "filler"), ("trace", "error", "notice", "frame")

_MARKS = re.compile("[̀-ͯ]+")
_TAG = re.compile(r"</?(?:html|head|title|body|h[1-6]|hr|p|br|div|span|b|i|ul|ol|li|table|tr|td|th|a|pre|code|em|strong)(?:\s+[\w-]+\s*=[^<>]*|\s*/?)>", re.IGNORECASE)
_HTML = re.compile(r"<(?:html|body)\b", re.IGNORECASE)
_NAME = r"[A-Za-z]\w*(?:[._]\w+)*"
#: What stands between brackets or between template marks that fit each other.
_SPAN = re.compile(
    rf"(?=[{{$\[<%#~@&_(])(?:\{{\{{[^{{}}\n]+\}}\}}|\$\{{[^{{}}\n]+\}}|\{{%[^{{}}\n]+%\}}|\{{[^{{}}\n]+\}}|\[\[[^\[\]\n]+\]\]|\[[^\[\]\n]+\]|<<[^<>\n]+>>|<%[^<>\n]+%>|<!--[^<>\n]+-->|<[^<>\n]+>"
    rf"|(?P<m>%%?|##?|~|\$\$?|@@?){_NAME}(?P=m)|&{_NAME};|(?<!\w)__[A-Za-z](?:\w*[A-Za-z])?__(?!\w)|\([^()\n]+\))"
)
#: Marks of templates, which hold a name or an expression.
_TEMPLATE = ("{{", "{%", "<%", "<<", "[[", "<!--")
#: Names between angle brackets or & and ; that are no placeholders.
_MARKUP = set("html head title body h1 h2 h3 h4 h5 h6 hr p br div span b i u ul ol li table tr td th thead tbody a pre code em strong small sup sub img".split())
_ENTITIES = set("amp lt gt quot apos nbsp eacute egrave agrave ccedil ecirc ocirc icirc ucirc acirc ugrave euml iuml ouml uuml auml szlig ntilde aacute iacute oacute uacute laquo raquo rsquo lsquo ldquo rdquo hellip ndash mdash euro copy reg trade deg times middot bull iexcl iquest sect para oelig aelig Eacute Egrave Agrave Ccedil Ouml Uuml Auml Ecirc Ocirc".split())
_BLANK = r"_{4,}|(?<!\w)[Xx]{3,}(?!\w)|(?<!\w)n/n/n(?!\w)|(?<![.\w])\.{8,}(?!\w)|(?<!\w)\?{3,}(?!\w)"
_DOTTED = r"\w++(?:[.$]\w++)+"
_TOKEN = re.compile(rf"(?P<blank>{_BLANK})|(?P<dotted>{_DOTTED})|(?P<word>\w++)|[:()|\"]")
_CODE = re.compile(r"[A-Z]{2,}_?\d+")
#: With underscores, so that parts of a code such as TBD_137 are no words.
_TERM = re.compile(r"\w+")
_BREAKS = re.compile(r"\n+|(?<=[.!?…])\s+")
_LOWER = re.compile(r"(?<![^\s(\"'«])[a-z]{3,}(?![^\s.,;:!?)\"'»])")
#: What a passage must have to hold a mark that is no word; words in brackets are found by themselves.
_MARKED = re.compile(r"[{}$%#~@<&]|\[\[|\[[a-z]|__|\.{8}|[Xx]{3}|n/n/n|\?{3}|\bat [\w$]+[.(]|File \"")
_HAS_SPAN = re.compile(r"[{$\[<%#~@&(]|__")
_STATUS = re.compile(r"(?<!\d)[45]\d\d(?!\d)")
_DIGIT = re.compile(r"\d")
#: Marks that aren't words, for their document frequencies.
_MASKS = re.compile(rf"(?<!\w)(?:{_BLANK}|[45]\d\d(?!\w)|[A-Z]{{2,}}_?\d+(?!\w)|{_DOTTED})")


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFD", text)).lower()


def _plain_tokens(text: str) -> list[str]:
    """Words without case and accents; numbers, codes, dotted names and blanks as one word each."""
    out = []
    for m in _TOKEN.finditer(text):
        w, kind = m.group(), m.lastgroup
        if kind == "blank":
            out.append("____")
        elif kind == "dotted":
            out.append("#" if w.replace(".", "").isdigit() else "id")
        elif kind is None:
            out.append(w)
        elif w.isdigit():
            out.append("4xx" if len(w) == 3 and w[0] in "45" else "#")
        else:
            out.append("@" if _CODE.fullmatch(w) else folded(w))
    if "____" in out:  # a form's line: whatever the label is
        out = ["id" if t not in ("____", ":") else t for t in out]
        out = [t for k, t in enumerate(out) if t != "id" or not k or out[k - 1] != "id"]
    return out


def _span_tokens(span: str, closed: bool) -> list[str]:
    """A placeholder as ‹ id › (as [ id ] and ${ id } where its marks have other uses too), other spans as the words within; markup and entities are nothing.

    closed: the text holds an end tag of the span's first word.
    """
    inner = span.strip("{}[]<>$%#~@&;!_-/() \t")
    name = re.fullmatch(_NAME, inner)
    if span[0] == "&":
        return [] if inner in _ENTITIES else ["‹", "id", "›"]
    if span.startswith(_TEMPLATE):
        return ["‹", "id", "›"] if re.match(r"[A-Za-z_]", inner) else _plain_tokens(inner)
    if span[0] == "<":
        words = inner.split()
        if span[1] == "/" or not words or words[0].lower() in _MARKUP and not (words[0].lower() == "a" and len(words) > 1 and "=" not in inner):
            return []
        if not closed and (name or 2 <= len(words) <= 6 and all(re.fullmatch(r"[\w'’-]+", w) for w in words) and not words[0][0].isdigit()):
            return ["‹", "id", "›"]
        return _plain_tokens(inner)
    if span.startswith("${"):
        return ["${", "id", "}"] if name and inner.isupper() else ["‹", "id", "›"]
    if span[0] == "{":
        return ["‹", "id", "›"] if name else _plain_tokens(inner)
    if span[0] == "[":
        return ["[", *(["id"] if name and inner[0].islower() else _plain_tokens(inner)), "]"]
    return _plain_tokens(inner) if span[0] == "(" else ["‹", "id", "›"]


def tokens(passage: str, text: str = "") -> tuple[list[str], list[list[str]]]:
    """(the passage's words, the words of each span in it)."""
    if not _HAS_SPAN.search(passage):
        return _plain_tokens(passage), []
    out, spans, at = [], [], 0
    for m in _SPAN.finditer(passage):
        span = m.group()
        first = span[1:].split()
        own = _span_tokens(span, bool(first) and span[0] == "<" and f"</{first[0]}" in text)
        out += _plain_tokens(passage[at : m.start()])
        if span[0] == "(":  # a call, or words in parentheses
            out += ["(", *own, ")"]
        else:
            out += own
        if own:
            spans.append(own)
        at = m.end()
    return out + _plain_tokens(passage[at:]), spans


#: Code of each byte: 1 to 26 for a letter of either case, 0 for the rest.
_CODES = np.array([(c | 32) - 96 if 97 <= (c | 32) <= 122 and c < 128 else 0 for c in range(256)], dtype=np.int32)


class Pairs:
    """How usual the letter pairs of a word are in the corpus."""

    def __init__(self, counts: np.ndarray):
        p = counts.reshape(27, 27).astype(float) + 0.5
        # Pointwise information of a pair: how much more often its letters meet than by chance.
        total = p.sum()
        self.info = np.log(p * total / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))

    def usual(self, words: list[str]) -> float:
        codes = np.frombuffer((" " + " ".join(words) + " ").encode(), dtype=np.uint8).astype(int)
        codes = np.where(codes == 32, 0, codes - 96)
        return float(self.info[codes[:-1], codes[1:]].mean())


def letter_pairs(text: str) -> np.ndarray:
    """729 counts of letter pairs, words edged by blanks."""
    codes = _CODES[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)]
    return np.bincount(codes[:-1] * 27 + codes[1:], minlength=729)


def repeated(words: list[str]) -> bool:
    """One word, or very few, over and over."""
    return len(words) > 3 and len(set(words)) * 4 <= len(words) and sum(map(str.isalpha, words)) * 2 > len(words)


def mashed(passage: str, words: list[str], pairs: Pairs) -> bool:
    """Nothing but lower-case words made of letters that don't go together."""
    if len(words) < 3:
        return False
    low = _LOWER.findall(passage)
    return len(low) >= 3 and len(low) >= 0.8 * len(words) and pairs.usual(low) < MASH


@lru_cache(None)
def exemplar_tokens(text: str) -> tuple[str, ...]:
    return tuple(t for t in tokens(text)[0] if t not in ("(", ")", '"', "|") or text.startswith(("at ", "File ")))


def _is_word(token: str) -> bool:
    return token[0].isalnum() or token[0] in "_@#"


class Index:
    """Exemplars under their heaviest words."""

    def __init__(self, frequencies: dict[str, int], documents: int, containment: float = CONTAINMENT, exemplars: dict[str, tuple[str, ...]] | None = None):
        self.containment = containment
        self.exemplars = [(label, exemplar_tokens(x)) for label, texts in (exemplars or EXEMPLARS).items() for x in texts]
        self.weight = {t: math.log((documents + 1) / (min(frequencies.get(t, 0), documents) + 0.5)) for _, own in self.exemplars for t in own}
        self.totals = [sum(self.weight[t] for t in own) for _, own in self.exemplars]
        self.long = [sum(len(t) > 3 and t.isalpha() for t in set(own)) >= LONG_EXEMPLAR for _, own in self.exemplars]
        self.postings: dict[str, list[int]] = defaultdict(list)
        for k, (_, own) in enumerate(self.exemplars):
            left = 0.0
            for t in sorted(dict.fromkeys(own), key=lambda t: (-self.weight[t], t)):
                self.postings[t].append(k)
                left += self.weight[t] * own.count(t)
                if left > (1 - containment) * self.totals[k]:
                    break  # a passage without any of these holds too little of the exemplar

    def _in_order(self, k: int, words: list[str]) -> tuple[float, tuple[int, ...]]:
        """Greatest weight of exemplar k's words that stand in order and near each other, and their places."""
        own = self.exemplars[k][1]
        gap = SHORT_GAP if len(own) <= 5 else GAP
        best: list[tuple[int, int, float, tuple[int, ...]]] = []
        top: tuple[float, tuple[int, ...]] = (0.0, ())
        for at, w in enumerate(words):
            if w in own:
                new = []
                for a, t in enumerate(own):
                    if t == w:
                        held, path = max(((h, p) for q, b, h, p in best if b < a and at - q - 1 <= gap), default=(0.0, ()))
                        new.append((at, a, held + self.weight[t], (*path, at)))
                best = [x for x in best if at - x[0] <= gap + 1] + new
                top = max([top, *((h, p) for _, _, h, p in new)])
        return top

    def matches(self, words: list[str]) -> list[tuple[str, float, tuple[int, ...], bool]]:
        """(label, weight, places, whether it covers the passage) of each exemplar that the words hold."""
        found, out = set(words), []
        size = sum(map(_is_word, words))
        for k in {k for t in found if t in self.postings for k in self.postings[t]}:
            label, own = self.exemplars[k]
            if sum(self.weight[t] for t in own if t in found) < self.containment * self.totals[k]:
                continue
            if label == "filler":  # filler is shuffled text: in any order
                held, places = sum(self.weight[t] for t in own if t in found), tuple(i for i, w in enumerate(words) if w in own)
            else:
                held, places = self._in_order(k, words)
            least = 1 - 1e-9 if label == "explanation" and len(own) <= 5 else self.containment
            if held >= least * self.totals[k]:
                covers = self.long[k] or sum(_is_word(words[i]) for i in places) >= PASSAGE_COVERAGE * size
                out.append((label, held, places, covers))
        return out


def masks_of(text: str) -> set[str]:
    """The marks that stand for something else than a word, of a whole text."""
    out = {x for x in ":()|\"" if x in text}
    if _DIGIT.search(text):
        out.add("#")
    for x in _MASKS.findall(text):
        out.add("4xx" if len(x) == 3 and x[0] in "45" else "@" if _CODE.fullmatch(x) else "id" if x[0].isalpha() and "." in x else "____" if not x[0].isalnum() or x.lower().startswith(("xxx", "n/n")) else "#")
    if _MARKED.search(text):
        for m in _SPAN.finditer(text):
            if m.group()[0] != "(":
                out.update(_span_tokens(m.group(), False))
    return out


VOCABULARY = frozenset(t for texts in EXEMPLARS.values() for x in texts for t in exemplar_tokens(x))


def judge(text: str, index: Index, pairs: Pairs) -> tuple[str, float] | None:
    """(kind, coverage) of a page with residue, None for any other."""
    raw = "<" in text and bool(_HTML.search(text))
    plain = _TAG.sub("\n", text) if "<" in text else text
    passages = _BREAKS.split(plain)
    low = _BREAKS.split(folded(plain))
    words = [_TERM.findall(x) for x in low]
    marked, status, posted = bool(_MARKED.search(plain)), bool(_STATUS.search(plain)), index.postings.keys()
    seen: dict[int, tuple[list[str], list, set[str]]] = {}

    def look(k: int) -> tuple[list[str], list, set[str]]:
        """Words, matches, and labels that count of passage k by itself."""
        if k not in seen:
            own, matches, labels = words[k], [], set()
            if not posted.isdisjoint(own) or marked and _MARKED.search(passages[k]) or status and "4xx" in posted and _STATUS.search(passages[k]):
                own, spans = tokens(passages[k], text)
                matches = index.matches(own)
                labels = {label for label, _, _, covers in matches if label in ANYWHERE and covers}
                for span in spans:
                    labels |= {label for label, _, _, covers in index.matches(span) if label in ANYWHERE and covers}
                if labels and any(label == "explanation" for label, *_ in matches):
                    labels = set()
            if not labels and (repeated(words[k]) or not matches and mashed(passages[k], words[k], pairs)):
                labels = {"filler"}
            seen[k] = own, matches, labels
        return seen[k]

    any_message = False
    for k in range(len(passages)):
        _, matches, labels = look(k)
        any_message = any_message or any(label in INSTEAD for label, *_ in matches)
    if not any_message and not any(labels for _, _, labels in seen.values()):
        return None
    total, covered, kinds = 0, 0, Counter()
    for k in range(len(passages)):
        own, matches, labels = look(k)
        size = sum(not w.isdigit() for w in words[k]) or bool(passages[k].strip()) * bool(own)
        total += size
        if not labels.isdisjoint(("placeholder", "todo")) and _explained(k, passages, text, look, index):
            labels = set()
        for label in labels:
            kinds[label] += max(size, 1)
        if any(label == "explanation" for label, *_ in matches):
            continue
        places = {i for label, _, at, _ in matches if label in INSTEAD for i in at}
        if places and sum(_is_word(own[i]) and own[i] != "#" for i in places) >= MESSAGE_COVERAGE * sum(_is_word(w) and w != "#" for w in own):
            covered += size
            for label in {label for label, *_ in matches if label in INSTEAD}:
                kinds[label] += max(size, 1)
    for kind in ANYWHERE:
        if kinds[kind]:
            return kind, min(kinds[kind] / max(total, 1), 1.0)
    for kind in ("trace", "error", "notice"):
        if kinds[kind] and covered >= (RAW_COVERAGE if raw else COVERAGE) * total:
            return kind, covered / max(total, 1)
    return None


def _explained(k: int, passages: list[str], text: str, look, index: Index) -> bool:
    """An explanation cut by a line end: the window of passage k and its neighbours holds it, though none of them does alone."""
    window: list[str] = []
    for j in (k - 1, k, k + 1):
        if 0 <= j < len(passages) and (j == k or not look(j)[2]):
            window += tokens(passages[j], text)[0]
    return any(label == "explanation" for label, *_ in index.matches(window))


def corpus_statistics(documents: DataFrame, text_col: str) -> tuple[dict[str, int], int, np.ndarray]:
    """Document frequencies of the exemplars' words, number of documents, letter pairs: over all documents.

    What comes to the driver is bounded by the exemplars' vocabulary and the 729 letter pairs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n, letters = Counter(), 0, np.zeros(729, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                plain = folded(text)
                letters += letter_pairs(plain)
                seen.update(VOCABULARY.intersection(_TERM.findall(plain)) | VOCABULARY.intersection(masks_of(text)))
            n += len(batch)
        rows = [("\0n", n), *seen.items(), *((f"\0{i}", int(c)) for i, c in enumerate(letters) if c)]
        yield pd.DataFrame(rows, columns=["term", "n"])

    texts = spread(documents.select(F.col(text_col).alias("text")).filter("text is not null"), "text")
    counts = {r["term"]: r["n"] for r in texts.mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    letters = np.zeros(729, dtype=np.int64)
    for term, n in counts.items():
        if term[0] == "\0" and term != "\0n":
            letters[int(term[1:])] = n
    return {t: n for t, n in counts.items() if t[0] != "\0"}, counts.get("\0n", 0), letters


def find_residue(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, coverage), a row per document with residue; kind is placeholder, todo, filler, trace, error or notice.

    Placeholders, notes to do and filler count wherever they stand; messages and notices only where they
    make up most of the page. Null ids and texts, empty texts and texts without a word are no case. Repeated rows give one row.
    Documents are not shuffled, unless their files are fewer than the cores; one small aggregation comes before the pass.
    """
    frequencies, n, letters = corpus_statistics(documents, text_col)
    rows = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, pairs = Index(frequencies, n), Pairs(letters)
        for batch in batches:
            out = [(key, *found) for key, text in zip(batch["id"], batch["text"], strict=True) if (found := judge(text, index, pairs))]
            yield pd.DataFrame(out, columns=["id", "kind", "coverage"])

    kind = documents.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, kind string, coverage double").dropDuplicates(["id"])


def p8_kinds(spark, sf_dir: str) -> DataFrame:
    """Documents with residue and its kind."""
    return find_residue(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_found(spark, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler or a message in place of content."""
    return p8_kinds(spark, sf_dir).select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_kinds": p8_kinds}
SQL: dict[str, str] = {}
