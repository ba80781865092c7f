"""Which charset a text file has: byte-order marks, validity, and scores of what its bytes decode to, summed per file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Byte-order marks in hexadecimal and the charsets that they tell, longest first; fixed values.
MARKS = {"FFFE0000": "utf-32-le", "0000FEFF": "utf-32-be", "EFBBBF": "utf-8", "FFFE": "utf-16-le", "FEFF": "utf-16-be"}
#: Charsets whose bytes below 128 are not all ASCII: their files are read whole.
WIDE = ("utf-32-le", "utf-32-be", "utf-16-le", "utf-16-be")
#: Charsets beside UTF-8, in the order that settles ties, each with classes of characters and how much one of a class speaks for it.
LEGACY: dict[str, tuple[tuple[str, float], ...]] = {
    "cp949": ((r"[가-힣]", 1.0), (r"[一-鿿ぁ-ヿ]", 0.1), (r"[　-〿！-｠]", 0.5)),
    "gb18030": ((r"[一-鿿]", 0.9), (r"[　-〿！-｠]", 0.5)),
    "shift_jis": ((r"[ぁ-ん]", 1.0), (r"[ァ-ヿ]", 0.9), (r"[一-鿿]", 0.7), (r"[　-〿！-｠]", 0.5)),
    "euc_jp": ((r"[ぁ-ん]", 1.0), (r"[ァ-ヿ]", 0.9), (r"[一-鿿]", 0.7), (r"[　-〿！-｠]", 0.5)),
    "cp1252": ((r"(?:(?<=[A-Za-z])|(?<![^\x00-\x7F]))[À-ÖØ-öø-ÿŒœŠšŽžŸ](?![^\x00-\x7F])", 1.0), (r"(?<![^\x00-\x7F])[€‘’“”–—…«»¿¡°](?![^\x00-\x7F])", 0.8)),
}
#: The smaller sets of the most used characters; those outside of them speak less for a charset.
USUAL = {"cp949": "euc_kr", "gb18030": "gb2312"}
UNUSUAL = 0.2


def first_level(char: str, charset: str) -> bool:
    """Whether a Chinese or Japanese standard has the character in its first level of usual ones, by its lead byte."""
    lead = char.encode(charset, "ignore")[:1]
    low, high = {"gb18030": (0xB0, 0xD7), "shift_jis": (0x88, 0x98), "euc_jp": (0xB0, 0xCF)}[charset]
    return bool(lead) and low <= lead[0] <= high


def score(text: str, charset: str) -> float:
    """How much the characters beyond ASCII of a decoded text speak for its charset."""
    total = 0.0
    usual = USUAL.get(charset)
    for pattern, weight in LEGACY[charset]:
        for char in re.findall(pattern, text):
            # Hangul outside of the standard's set has a spelling of eight bytes in it.
            rare = usual is not None and len(char.encode(usual, "ignore")) != 2
            if not rare and charset in ("gb18030", "shift_jis", "euc_jp") and "一" <= char <= "鿿":
                rare = not first_level(char, charset)
            total += weight * (UNUSUAL if rare else 1.0)
    return total


def legacy_counts(lines: DataFrame) -> DataFrame:
    """lines (file, value) -> rows (file, charset, bad, said, chars): lines that the charset cannot decode, the score, and characters beyond ASCII."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, value in zip(batch["file"], batch["value"], strict=True):
                for charset in LEGACY:
                    try:
                        text = value.decode(charset)
                        rows.append((name, charset, 0, score(text, charset), sum(c > "\x7f" for c in text)))
                    except UnicodeDecodeError:
                        rows.append((name, charset, 1, 0.0, 0))
            frame = pd.DataFrame(rows, columns=["file", "charset", "bad", "said", "chars"])
            yield frame.groupby(["file", "charset"], as_index=False).sum()

    schema = "file string, charset string, bad long, said double, chars long"
    parts = lines.select("file", F.col("value").cast("binary").alias("value")).mapInPandas(counts, schema)
    return parts.groupBy("file", "charset").agg(F.sum("bad").alias("bad"), F.sum("said").alias("said"), F.sum("chars").alias("chars"))


def wide_charset(first: Column, zeros: Column) -> Column:
    """The charset that a file's first line tells by its mark, or by where zero bytes are; null where neither does."""
    head = F.hex(F.substring(first.cast("binary"), 1, 4))
    told = F.when(zeros > 0, F.when(F.substring(head, 3, 2) == "00", "utf-16-le").otherwise("utf-16-be"))
    for mark, charset in reversed(MARKS.items()):
        told = F.when(head.startswith(mark), charset).otherwise(told)
    return told


def charsets_of(lines: DataFrame, facts: list[dict]) -> dict[str, str]:
    """The charset of each file: facts are rows (file, told, valid) of wide_charset and of whether all lines are UTF-8.

    Files that are neither marked nor UTF-8 are scored over all their lines beyond
    ASCII. A file that no charset can decode strictly is an error.
    """
    found = {f["file"]: f["told"] or "utf-8" for f in facts if f["told"] or f["valid"]}
    open_ = [f["file"] for f in facts if f["file"] not in found]
    if not open_:
        return found
    some = lines.filter(F.col("file").isin(open_) & F.col("value").rlike(r"[^\x00-\x7F]"))
    best: dict[str, tuple] = {}
    order = list(LEGACY)
    for r in legacy_counts(some).collect():  # a row for each file and charset
        if not r["bad"]:
            key = (round(r["said"] / max(1, r["chars"]), 6), -order.index(r["charset"]))
            if r["file"] not in best or key > best[r["file"]][0]:
                best[r["file"]] = key, r["charset"]
    lost = sorted(set(open_) - set(best))
    if lost:
        raise ValueError(f"no known charset decodes {lost[0]}")
    return found | {name: charset for name, (_, charset) in best.items()}
