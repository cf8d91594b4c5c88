"""Words and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is an unbroken run of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: The same test for one letter or digit on the JVM side.
HAS_WORD_CHAR = r"[\p{L}\p{N}]"

_MARKS = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯]+")


def words(text: str) -> list[str]:
    """Lower-cased words of a text."""
    return WORD.findall(text.lower())


def folded_words(text: str) -> list[str]:
    """Words without case and accents."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return WORD.findall(text.lower())


def has_word(text: Column) -> Column:
    """True where the text holds a letter or digit; false for null."""
    return F.coalesce(text.rlike(HAS_WORD_CHAR), F.lit(False))
