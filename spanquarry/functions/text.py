"""Text normalisation and phrase matching for the security scans."""
from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from spanquarry.functions.common import as_col

# Ship this module's Python function with the job instead of importing it on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Zero-width and invisible characters that are dropped.
ZERO_WIDTH = ("\u200b\u200c\u200d\u2060\ufeff\u180e\u00ad\u034f\u061c"
              "\u115f\u1160\u17b4\u17b5\u3164\uffa0\u200e\u200f")
CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f"
# Characters that compatibility normalisation leaves alone: text made of these skips Python.
STABLE = (r"\x00-\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e"
          r"\u0141-\u0148\u014a-\u017e\u0400-\u0482\u048a-\u04ff\u2010\u2012-\u2016\u2018-\u2023\u20a0-\u20a7"
          r"\u20a9-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3")

SEPARATOR = "\u0001"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def is_ascii(text) -> Column:
    return F.octet_length(as_col(text)) == F.char_length(as_col(text))


def nfkc(text) -> Column:
    """Compatibility normalisation; rows that cannot change send a null to Python, not text."""
    t = as_col(text)
    return F.coalesce(_nfkc(F.when(~is_ascii(t) & t.rlike(f"[^{STABLE}]"), t)), t)


def strip_markup(text) -> Column:
    """Drop invisible and control characters, comments and tags."""
    t = as_col(text)
    plain = F.regexp_replace(t, f"[{CONTROL}]", "")
    clean = F.when(is_ascii(t), plain).otherwise(F.regexp_replace(t, f"[{CONTROL}{ZERO_WIDTH}]", ""))
    tags = F.regexp_replace(F.regexp_replace(clean, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return F.when(F.contains(t, F.lit("<")), tags).otherwise(clean)


def collapse_space(text) -> Column:
    return F.trim(F.regexp_replace(as_col(text), r"[\t-\r\x85\p{Z}]+", " "))


def normalize_text(text) -> Column:
    return collapse_space(strip_markup(nfkc(text)))


class PhraseBook:
    """One automaton over all phrases: every occurrence in a text in one pass, overlapping ones included.

    A phrase counts as whole words where it starts or ends with a letter or digit.  Case is ignored except for the
    phrases listed as ``exact``.
    """

    def __init__(self, phrases: list[str], exact: list[str]) -> None:
        import ahocorasick

        entries: dict[str, list] = {}
        for number, phrase in enumerate([*phrases, *exact]):
            entries.setdefault(phrase.lower(), []).append(
                (number, phrase, number >= len(phrases), phrase[0].isalnum(), phrase[-1].isalnum()))
        self.automaton = ahocorasick.Automaton()
        for word, found in entries.items():
            self.automaton.add_word(word, found)
        self.automaton.make_automaton()

    @staticmethod
    def _lower(text: str) -> str:
        """Lower case with as many characters, and the two letters that only match by case folding."""
        low = text.lower()
        if text.isascii():
            return low
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        return low.replace("\u017f", "s").replace("\u212a", "k")

    @staticmethod
    def _in_word(c: str) -> bool:
        return c == "_" or (c.isalnum() if c.isascii() else unicodedata.category(c)[0] in "LN")

    def numbers(self, text: str) -> set[int]:
        """Numbers of the phrases that occur; the exact ones follow the others."""
        out: set[int] = set()
        for end, entries in self.automaton.iter(self._lower(text)):
            for number, phrase, exact, left, right in entries:
                start, after = end + 1 - len(phrase), end + 1
                if (
                    number not in out
                    and not (left and start > 0 and self._in_word(text[start - 1]))
                    and not (right and after < len(text) and self._in_word(text[after]))
                    and (not exact or text[start:after] == phrase)
                ):
                    out.add(number)
        return out


_DROPPED = re.compile(f"[{CONTROL}{ZERO_WIDTH}]")
_COMMENT, _TAG = re.compile(r"<!--.*?-->", re.DOTALL), re.compile(r"<[^>]+>")


def searched(text: str) -> str:
    """What phrases are searched in: the raw and the normalised text, parted by a character that no phrase holds.

    Where normalising only changed white space, the normalised text alone holds every match.
    """
    stable = text if text.isascii() else unicodedata.normalize("NFKC", text)
    clean = _DROPPED.sub("", stable) if _DROPPED.search(stable) else stable
    if "<" in stable:
        clean = _TAG.sub(" ", _COMMENT.sub(" ", clean))
    plain = " ".join(clean.split())
    return plain if clean == text else text + SEPARATOR + plain


def found_phrases(text, phrases: list[str], exact: list[str] = ()) -> Column:
    """Numbers (array<int>, ascending) of the phrases that occur in the raw or in the normalised text.

    Whole texts go to Python in Arrow batches and meet one automaton there: a pass in native code, several times faster
    than the expressions of the JVM over the same texts.  Null counts as empty.
    """
    phrases, exact = list(phrases), list(exact)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        book = PhraseBook(phrases, exact)
        for texts in batches:
            yield pd.Series([sorted(book.numbers(searched(t or ""))) for t in texts], dtype=object)

    return numbers(as_col(text))
