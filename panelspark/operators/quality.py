"""Response quality: which questions to look at, careless answers, their removal.

Only the names of these tools are given; what they do here is this library's own design.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import is_missing


def natural_order(name: str) -> list[tuple[str, int, str]]:
    """The natural key of one name, for column lists on the driver."""
    parts = re.findall(r"(\D*)(\d*)", name)
    return [(t, len(d.lstrip("0")) if d else -1, d.lstrip("0")) for t, d in parts if t or d]


def question_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Columns between two names in natural order, both included, in the table's order: Q2 to Q10 has Q9."""
    low, high = sorted((natural_order(first), natural_order(last)))
    return [c for c in df.columns if low <= natural_order(c) <= high]


def straight_line(df: DataFrame, names: list[str]) -> Column:
    """Whether all the named answers are there and equal; two at least."""
    if len(names) < 2:
        return F.lit(False)
    there = ~reduce(Column.__or__, [is_missing(df, n) for n in names])
    same = reduce(Column.__and__, [F.col(f"`{n}`") == F.col(f"`{names[0]}`") for n in names[1:]])
    return there & F.coalesce(same, F.lit(False))


#: What words are made of, for the bounds of keywords; and the letters whose words take particles behind them.
WORD_CHAR, HANGUL = r"[\p{L}\p{N}_]", re.compile("[가-힣]")


def _bounds(word: str) -> tuple[bool, bool]:
    """Whether a keyword must begin where a word does, and end where one does: not at a sign, nor, at the end, behind Hangul, where particles follow."""
    part = lambda c: c.isalnum() or c == "_"
    return part(word[0]), part(word[-1]) and not HANGUL.match(word[-1])


def has_keyword(text: Column, words: list[str]) -> Column:
    """Whether the text has one of a few words, in any case of any script, as whole words; false for null.

    A keyword that ends in Hangul may have a particle behind it; one of signs
    stands anywhere. Many keywords go to keyword_hits. Empty keywords are left out.
    """
    patterns = []
    for word in filter(None, words):
        begins, ends = _bounds(word)
        patterns.append((f"(?<!{WORD_CHAR})" if begins else "") + re.escape(word) + (f"(?!{WORD_CHAR})" if ends else ""))
    if not patterns:
        return F.lit(False)
    return F.coalesce(text.rlike("(?iu)(?:" + "|".join(patterns) + ")"), F.lit(False))


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def keyword_hits(df: DataFrame, ident: str, text: str, words: list[str]) -> DataFrame:
    """Rows (ident, keyword, hits): how often each keyword stands in the text, by the rules of has_keyword; one pass over the texts for any number of keywords.

    Text and keywords are compared without regard to case and to compatibility
    forms, such as of full width. A task builds one automaton of all keywords,
    which travel with it: some 50 bytes a character. Keywords that fold alike
    have the same hits; null texts have none.
    """
    given = sorted({w for w in words if w})
    kind = df.schema[ident].dataType.simpleString()

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        spelled: dict[str, list[str]] = defaultdict(list)
        for word in given:
            spelled[folded(word)].append(word)
        automaton = ahocorasick.Automaton()
        for word in spelled:
            automaton.add_word(word, (word, *_bounds(word)))
        automaton.make_automaton()
        part = lambda c: c.isalnum() or c == "_"
        for batch in batches:
            at, keywords, counts = [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                value = folded(value or "")
                found: Counter = Counter()
                for end, (word, begins, ends) in automaton.iter(value):
                    start = end - len(word)
                    if not (begins and start >= 0 and part(value[start])) and not (ends and end + 1 < len(value) and part(value[end + 1])):
                        found[word] += 1
                for word, n in found.items():
                    for spelling in spelled[word]:
                        at.append(row)
                        keywords.append(spelling)
                        counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keywords, pa.string()), pa.array(counts, pa.int64())], [ident, "keyword", "hits"])

    rows = df.select(F.col(ident), F.col(text).alias("_text"))
    return rows.mapInArrow(hits, f"`{ident}` {kind}, keyword string, hits long") if given else rows.select(ident, F.lit("").alias("keyword"), F.lit(0).cast("long").alias("hits")).filter("false")


def remove_flagged(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not among the flagged ones; null keys stay."""
    return df.join(flagged.select(key).distinct(), key, "left_anti")
