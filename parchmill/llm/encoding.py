"""Problem 3: text decoded with the wrong character encoding.

A chain is a series of steps (read as, should have been read as). Every chain that can have made a sentence is
undone, and what it gives is compressed with a zstandard dictionary of the text's language; the chain with the least
description length, its own cost included, is chosen, and none if nothing pays for its cost. Dictionaries
are trained on a bounded sample of pages labelled with their language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread

#: Pages of each language that the dictionaries are trained on.
SAMPLE_PAGES = 300
SAMPLE_CHARS = 12_000
DICTIONARY_BYTES = 48_000
LEVEL = 16
#: Bytes that a step of a chain costs, once a text.
STEP_COST = 1
#: Bytes that a second chain between single-byte encodings costs a text besides: a sequence of UTF-8 hardly comes about by chance, a single letter does.
SWITCH_COST = 3

#: Encodings that bytes were read as, and that single-byte text should have been read as.
READ_AS = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859_15", "cp1254", "cp1253", "iso8859_2", "cp852", "cp866", "koi8_r", "iso8859_7", "iso8859_5")
MEANT = ("cp1252", "cp437", "cp850", "mac_roman")
DEPTH = 3

#: Characters at home in French, German, Spanish and English text.
LOWER = "àâäæçèéêëîïñóôöùûüœßáíú"
UPPER = "ÀÂÄÆÇÈÉÊËÎÏÑÓÔÖÙÛÜŒÁÍÚ"
SIGNS = "’‘“”„«»–—…€°·•§№¿¡ºª²³   ​﻿"

_HOME = set(LOWER + UPPER + SIGNS)
_MENDED = set(LOWER + UPPER + "’")
#: Characters that a text is likely to have had where it now holds a sequence of characters at home.
WANTED = [chr(c) for a, z in ((0xA0, 0x17F), (0x2010, 0x2044), (0x2190, 0x2193)) for c in range(a, z + 1)] + ["€", "™", "−", "≤", "≥", "✓", "\ufeff"]
_SENTENCES = re.compile(r"(?<=\n)|(?<=[.!?…] )")
_OUTSIDE = re.compile(r"[^\x00-\x7f]")


@lru_cache(None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Byte of each character beyond ASCII; undefined bytes are read as controls, as most programs do."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


def _read_as(codec: str, c: str) -> str | None:
    """The character's UTF-8 bytes read in a codec, None where the codec lacks one of them."""
    chars = {b: x for x, b in reversed(_bytes_of(codec).items())}
    got = [chars.get(b) for b in c.encode("utf-8")]
    return None if None in got else "".join(got)


def _at_home() -> str:
    """Pattern of the UTF-8 sequences that read wrongly as nothing but characters at home."""
    tails: dict[str, set[str]] = {}
    for wrong in {_read_as(codec, c) for codec in READ_AS for c in WANTED} - {None}:
        if set(wrong) <= _HOME:
            tails.setdefault(wrong[:-1], set()).add(wrong[-1])
    return "|".join(f"{front}[{''.join(sorted(own))}]" for front, own in sorted(tails.items()))


#: What a text must hold to be looked at (also in Java's syntax): a character that isn't at home, a capital with an accent within or
#: instead of a word, a sign inside a word, or a sequence that UTF-8 gives. Everything else is as good as any decoding of it.
#: It begins with the character itself, so that plain text is passed over at one test a character.
SUSPECT = (
    rf"(?=[^\x00-\x7f])(?:[^{LOWER}{UPPER}{SIGNS}]|(?<=[a-z{LOWER}])[{UPPER}]|(?<![^\s])[{UPPER[1:]}ßæœ](?![^\s])|(?<=[a-z{LOWER}])[“”„–—…‘¡¿ºª²³°§·•«»€](?=[a-z{LOWER}])"
    rf"|(?<=[{UPPER}])[«»¡¿°§²³·•ºª€“”„‘–—…]|(?<![^\s])[“”„–—…‘¡¿§·•«»](?= [a-z])|{_at_home()})"
)
_SUSPECT = re.compile(SUSPECT)
#: Replacement characters and controls that no text has on purpose.
_LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f]")
#: A replacement character read wrongly itself; Russian letters alone may be a word.
_LOST_READ = re.compile("|".join(sorted({w for codec in READ_AS if (w := _read_as(codec, "\ufffd")) and not re.fullmatch("[а-яА-Я]+", w)})))


@lru_cache(None)
def _sequences(codec: str) -> re.Pattern:
    """Characters that are a UTF-8 sequence read in this codec."""
    by_byte: dict[int, str] = {}
    for c, b in _bytes_of(codec).items():
        by_byte[b] = by_byte.get(b, "") + c
    def group(a: int, z: int) -> str:
        return "[" + re.escape("".join(by_byte.get(b, "") for b in range(a, z + 1))) + "]"
    tail = group(0x80, 0xBF)
    return re.compile(f"{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}}")


def _undo_utf8(codec: str, text: str) -> str:
    table = _bytes_of(codec)

    def back(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _sequences(codec).sub(back, text)


@lru_cache(None)
def _translation(read_as: str, meant: str) -> dict[int, str]:
    meant_of = {b: c for c, b in reversed(_bytes_of(meant).items())}
    return {ord(c): meant_of[b] for c, b in _bytes_of(read_as).items() if b in meant_of}


@lru_cache(None)
def _leads(codec: str) -> frozenset[str]:
    return frozenset(c for c, b in _bytes_of(codec).items() if 0xC2 <= b <= 0xF4)


@lru_cache(200_000)
def _strange(before: str, c: str, after: str) -> int:
    """How much out of place a character is between its neighbours; up to 3 is in place."""
    if c in LOWER:
        return 1 if before.isalpha() or after.isalpha() or c in "àó" else 6
    if c in UPPER:
        letters = any(x in LOWER or x.isascii() and x.isalpha() for x in (before, after) if x)
        return 6 if before.islower() else 3 if letters or c == "À" and not before.isalpha() + after.isalpha() else 6
    if "\u00c0" <= c <= "\u017f":
        return 3 if any(x.isalpha() and x < "\u0180" for x in (before, after) if x) else 9
    if c in SIGNS:
        return 8 if before.isalpha() and after.isalpha() and c not in "’–" and not c.isspace() else 2
    return 12 if c < " " else 9


def oddities(text: str) -> list[tuple[str, int]]:
    """Each character beyond ASCII and how much it is out of place."""
    return [(m.group(), _strange(text[m.start() - 1 : m.start()] if m.start() else "", m.group(), text[m.end() : m.end() + 1])) for m in _OUTSIDE.finditer(text)]


def candidates(sentence: str) -> list[tuple[str, tuple, bool]]:
    """Decodings of a sentence other than itself: (text, chain, evidence), the shortest chain for each text.

    A decoding from UTF-8 sequences is evidence if all that is new in it is at home, or a Latin letter, and in place, or if there are several letters or symbols; one through a
    single-byte chain if it also mends a letter and the chain accounts for all characters beyond ASCII. Other decodings are open to a sentence where the rest of the text speaks for their chain.
    """
    odd = oddities(sentence)
    strangers = {c for c, _ in odd}
    out: dict[str, tuple[tuple, bool]] = {}

    def add(text: str, chain: tuple) -> bool:
        if text == sentence or text in out:
            return False
        new = [(c, n) for c, n in oddities(text) if c not in strangers]
        if chain[-1][1] == "utf_8":
            # Two or more sequences that give letters or symbols of whatever script don't come about by chance.
            sure = all(n <= 3 and (c in _HOME or "\u00c0" <= c <= "\u017f") for c, n in new) or len(new) > 1 and all(unicodedata.category(c)[0] in "LS" or c in _HOME for c, _ in new)
        else:
            sure = all(n <= 3 for _, n in new)
        out[text] = chain, sure
        return True

    front = [(sentence, (), strangers)]
    for _ in range(DEPTH):
        new = []
        for text, chain, own in front:
            for codec in READ_AS if not chain else dict.fromkeys((chain[-1][0], "cp1252")):
                if not own.isdisjoint(_leads(codec)):
                    undone = _undo_utf8(codec, text)
                    step = (*chain, (codec, "utf_8"))
                    if undone != text and add(undone, step):
                        new.append((undone, step, set(_OUTSIDE.findall(undone))))
        front = new
    for codec in READ_AS:
        if strangers <= _bytes_of(codec).keys():
            for meant in MEANT:
                if codec != meant:
                    table = _translation(codec, meant)
                    mended = {table.get(ord(c), c) for c in strangers} - strangers
                    if mended and mended <= _HOME and not mended.isdisjoint(_MENDED):
                        add(sentence.translate(table), ((codec, meant),))
    return [(text, chain, evidence) for text, (chain, evidence) in out.items()]


class Languages:
    """Compressors with a dictionary for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.own = {}
        for language, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.own[language] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
        if not self.own:
            self.own[""] = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def of(self, text: str) -> zstandard.ZstdCompressor:
        """The language in which the text's plain part is shortest."""
        plain = _OUTSIDE.sub("", text).encode("ascii", "replace")
        return min(self.own.values(), key=lambda z: len(z.compress(plain)))


def restore(text: str, languages: Languages) -> tuple[str, list[tuple]] | None:
    """(text with the chosen chains undone, the chains), None where no chain pays.

    A text with replacement characters or C1 controls and nothing to undo comes back as it is, with the chain ("lost",).
    """
    lost = ("lost",) if _LOST.search(text) or _LOST_READ.search(text) else None
    if not lost and not _SUSPECT.search(text):
        return None
    parts = _SENTENCES.split(text)
    choices = [candidates(part) if _SUSPECT.search(part) else [] for part in parts]
    if any(evidence for options in choices for _, _, evidence in options):
        z = languages.of(text)
        gains: dict[tuple, int] = {}
        scored = []
        for part, options in zip(parts, choices, strict=True):
            before = _size(z, part) if options else 0
            scored.append([(before - _size(z, other), other, chain) for other, chain, _ in options])
            for (gain, _, chain), (_, _, evidence) in zip(scored[-1], options, strict=True):
                if evidence and gain > 0:
                    gains[chain] = gains.get(chain, 0) + gain
        # A chain's cost is paid once: those that pay for it over the whole text are open to each sentence. One sequence of two characters saves
        # a byte, so that a chain of UTF-8 sequences need only come out even.
        pays = [chain for chain, gain in gains.items() if gain > STEP_COST * len(chain) - (chain[-1][1] == "utf_8")]
        # The one that saves most comes first; another must pay for itself and for the switch by what it saves beyond those before it.
        open_: set[tuple] = set()
        for chain in sorted(pays, key=lambda c: (-gains[c], len(c), c)):
            more = sum(max(0, _best(options, {chain}) - _best(options, open_)) for options in scored)
            if not open_ or more > STEP_COST * len(chain) + (-1 if chain[-1][1] == "utf_8" else SWITCH_COST):
                open_.add(chain)
        out, used = [], {}
        for part, options in zip(parts, scored, strict=True):
            best = max(((gain, -len(chain), gains[chain], other, chain) for gain, other, chain in options if gain > 0 and chain in open_), default=None)
            if not best and open_ and _SUSPECT.search(part):
                best = _follow(part, open_)
            if best:
                used[best[4]] = None
            out.append(best[3] if best else part)
        if used:
            return "".join(out), list(used)
    return (text, [lost]) if lost else None


def _best(options: list[tuple], chains: set[tuple]) -> int:
    """What the best of the chains saves on a sentence."""
    return max((gain for gain, _, chain in options if chain in chains), default=0)


def _follow(part: str, chains: set[tuple]) -> tuple | None:
    """A sentence that speaks for no chain by itself goes the way of the text's, if that leaves less out of place."""
    here, best = sum(n for _, n in oddities(part)), None
    for chain in sorted(chains):
        if len(chain) == 1 and chain[0][1] != "utf_8":
            other = part.translate(_translation(*chain[0]))
            if (then := sum(n for _, n in oddities(other))) < here:
                here, best = then, (0, 0, 0, other, chain)
    return best


#: ESC and a number name another block of 128 characters and switch to it; SO switches to it again, SI back to Windows-1252.
_ESC, _SO, _SI = 0x1B, 0x0E, 0x0F
_ASCII_RUN = re.compile(r"[\x00-\x0d\x10-\x1a\x1c-\x7f]+")
_CP1252 = {chr(c): chr(c).encode("cp1252")[0] for c in range(0x80, 0x2123) if chr(c).encode("cp1252", "ignore")}


def plain_bytes(text: str) -> bytes:
    """A byte for each character, so that a decoding doesn't win by the length of its encoding.

    Bytes from 0x80 are Windows-1252 or, after a switch, of another block. The text can be had back, which makes the compressed length a
    description length.
    """
    if "\x1b" not in text and "\x0e" not in text and "\x0f" not in text:
        try:
            return text.encode("cp1252")
        except UnicodeEncodeError:
            pass
    out, other, away, at = bytearray(), 0, False, 0
    while at < len(text):
        run = _ASCII_RUN.match(text, at)
        if run:
            out += run.group().encode("ascii")
            at = run.end()
            continue
        c = text[at]
        at += 1
        if c < "\x20":
            out += bytes([_ESC, 0xFF, ord(c)])
        elif c in _CP1252:
            if away:
                out.append(_SI)
            away = False
            out.append(_CP1252[c])
        else:
            block = ord(c) >> 7
            if block != other:
                out += bytes([_ESC, block]) if block < 0xFE else bytes([_ESC, 0xFE]) + block.to_bytes(2, "big")
            elif not away:
                out.append(_SO)
            other, away = block, True
            out.append(0x80 | ord(c) & 0x7F)
    return bytes(out)


def text_of(data: bytes) -> str:
    """The text of plain_bytes."""
    latin, out, other, away, at = {b: c for c, b in _CP1252.items()}, [], 0, False, 0
    while at < len(data):
        b = data[at]
        at += 1
        if b == _ESC and data[at] == 0xFF:
            out.append(chr(data[at + 1]))
            at += 2
        elif b == _ESC:
            wide = data[at] == 0xFE
            other, away = int.from_bytes(data[at + 1 : at + 3], "big") if wide else data[at], True
            at += 3 if wide else 1
        elif b in (_SO, _SI):
            away = b == _SO
        else:
            out.append(chr(b) if b < 0x80 else chr(other << 7 | b & 0x7F) if away else latin[b])
    return "".join(out)


def _size(z: zstandard.ZstdCompressor, text: str) -> int:
    return len(z.compress(plain_bytes(text)))


def train_dictionaries(samples: dict[str, list[str]]) -> dict[str, bytes]:
    """A dictionary for each language; of very few samples zstandard makes none, there they serve as they are."""
    out = {}
    for language, texts in sorted(samples.items()):
        data = [plain_bytes(t) for t in texts if t]
        try:
            out[language] = zstandard.train_dictionary(DICTIONARY_BYTES, data, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            if data:
                out[language] = b"".join(data)[:DICTIONARY_BYTES]
    return out


def language_samples(pages: DataFrame, id_col: str, text_col: str, lang_col: str, pages_each: int = SAMPLE_PAGES) -> dict[str, list[str]]:
    """At most pages_each pages of each language, those with the least hash of their id; pages that look wrong are left out.

    Only ids take part in the ranking; the texts of the chosen few are read after it.
    """
    lang = F.lower(F.substring(F.trim(F.col(lang_col)), 1, 2))
    ranked = (
        pages.select(F.col(id_col).alias("id"), lang.alias("lang")).filter("id is not null and lang in ('fr', 'en', 'de', 'es')")
        .withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).filter(F.col("k") <= pages_each)
    )
    ids = [r["id"] for r in ranked.select("id").collect()]
    rows = pages.filter(F.col(id_col).isin(ids)).select(lang.alias("lang"), F.col(text_col).alias("text")).filter(F.length("text").between(80, SAMPLE_CHARS)).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        if not _SUSPECT.search(r["text"]) and "�" not in r["text"]:
            out.setdefault(r["lang"], []).append(r["text"])
    return out


def find_wrong_encoding(records: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of records that were decoded wrongly, with restored and chain added.

    restored is the original as far as it can be had (where characters are lost, the text as it is); chain names the steps. Null
    and empty texts, HTML entities and rightly decoded unusual characters are no case. All columns are kept; records may have no
    columns restored and chain. Nothing is shuffled.
    """
    names = records.columns
    kept = spread(records.filter(F.col(text_col).rlike(SUSPECT + "|�")), text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages = Languages(dictionaries)
        for batch in batches:
            found = [restore(t, languages) for t in batch[text_col]]
            keep = np.array([f is not None for f in found], dtype=bool)
            out = pd.DataFrame({n: pd.Series(batch[n].to_numpy(dtype=object)[keep], dtype=object) for n in names})
            out["restored"] = pd.Series([f[0] for f in found if f], dtype=object)
            out["chain"] = pd.Series([" + ".join("|".join(" < ".join(step) if isinstance(step, tuple) else step for step in chain) for chain in f[1]) for f in found if f], dtype=object)
            yield out[[*names, "restored", "chain"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", restored string, chain string"
    return kept.mapInPandas(run, schema)


def texts_of(spark, sf_dir: str) -> DataFrame:
    """(table_name, record_id, text) of the three tables."""
    parts = (("chunks", "chunk_id", "text"), ("documents", "doc_id", "text"), ("retrieved_chunks", "retrieved_id", "texte"))
    out = None
    for table, key, text in parts:
        t = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
        out = t if out is None else out.unionByName(t)
    return out


def p3_restored(spark, sf_dir: str) -> DataFrame:
    """Wrongly decoded records with the original where it can be had."""
    dictionaries = train_dictionaries(language_samples(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang"))
    found = find_wrong_encoding(texts_of(spark, sf_dir).filter("record_id is not null"), dictionaries)
    return found.select("table_name", "record_id", "restored", "chain").dropDuplicates(["table_name", "record_id"])


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Records that were decoded wrongly, wholly or in places."""
    return p3_restored(spark, sf_dir).select("table_name", "record_id")


QUERIES = {"p3_found": p3_found, "p3_restored": p3_restored}
SQL: dict[str, str] = {}
