"""Token counts by the whole-token shortcut.

Byte-pair merging works on pre-tokens one by one. A pre-token that the
vocabulary holds and that provably encodes alone as one token counts 1 without
merging. The proof is made once, on the driver, by encoding every vocabulary
string; the proven set is bounded by the vocabulary. All other pre-tokens go to
the library's merge, and their counts are remembered up to a bound.
"""

from __future__ import annotations

import functools
import os
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm.common import Memo, map_batches, prepare

#: White space as Unicode's property has it, and the pre-token pattern of byte-level vocabularies, fixed values.
SPACE = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters whose classes no Unicode version in use changes, the most frequent of those that agreed() proves.
SETTLED = regex.compile(f"[{chr(0)}-{chr(0x36F)}{chr(0x2000)}-{chr(0x206F)}{chr(0x20AC)}]*+")
#: Remembered counts of merged pre-tokens in a worker.
MEMO = 400_000


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def agreed(path: str) -> frozenset[str]:
    """All assigned characters that the pattern here and the library part alike from letters, digits and signs: texts of them have the same pre-tokens.

    The pattern asks only for a character's class, so it is enough to see each
    one between a letter and a sign, and between a digit and a sign. Characters
    that the two know in different classes, of different Unicode versions, are
    left out, as are those without a class of their own.
    """
    tok, pattern = tokenizer(path), regex.compile(PRETOKEN)
    chars = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    same = set(chars)
    for before in "a1":
        for at in range(0, len(chars), 20_000):
            some = chars[at : at + 20_000]
            probe = "".join(f"{before}{c}!" for c in some)
            here = {m.start() for m in pattern.finditer(probe)}
            there = {a for _, (a, _) in tok.pre_tokenizer.pre_tokenize_str(probe)}
            same.difference_update(some[k // 3] for k in here ^ there)
    return frozenset(same)


@functools.lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    tok, pattern, known = tokenizer(path), regex.compile(PRETOKEN), agreed(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    strings = [tok.decode([i], skip_special_tokens=False) for i in tok.get_vocab(with_added_tokens=False).values()]
    strings = [s for s in strings if s and "\ufffd" not in s and s not in special and known.issuperset(s)]
    coded = tok.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, c in zip(strings, coded, strict=True) if len(c.ids) == 1 and pattern.fullmatch(s))


class Counter:
    """Tokens of texts: proven pre-tokens count 1, the rest are merged by the library and remembered.

    whole: texts that went to the library whole, for a character that is not
    agreed on or for a special string.
    """

    def __init__(self, path: str, proven: frozenset[str], known: frozenset[str]):
        self.known, self.whole = known, 0
        self.tok, self.pattern = tokenizer(path), regex.compile(PRETOKEN)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.proven, self.memo = dict.fromkeys(proven, 1), Memo(self.merged, MEMO)

    def merged(self, pretoken: str) -> int:
        return len(self.tok.encode(pretoken, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not (SETTLED.fullmatch(text) or self.known.issuperset(text)) or any(s in text for s in self.special):
            self.whole += 1
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        one, found = self.proven, self.pattern.findall(text)
        rest = [t for t in found if t not in one]
        return len(found) - len(rest) + sum(map(self.memo.__getitem__, rest))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: id, UTF-8 bytes, tokens without added special ones, whether over the limit.

    A null text counts as empty: no bytes, no tokens. Special strings inside a
    text are handled as the library does by default. Whole texts are read;
    repeated rows stay; an empty table gives an empty result; other columns do
    not matter, whatever their names. No step shuffles.
    """
    spark = docs.sparkSession
    prepare(spark)
    # Bounded by the vocabulary and by Unicode: some 50,000 strings, 160,000 characters.
    proven = spark.sparkContext.broadcast((whole_tokens(path), "".join(sorted(agreed(path)))))
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        counter = _counter(path, proven)
        counter.memo.use()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = pa.array([counter.count(x.as_py() or "") for x in batch.column(2)], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], [doc_id, "n_bytes", "n_tokens"])

        return each

    size = F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long"))
    counted = map_batches(docs.select(F.col(doc_id), size.alias("n_bytes"), F.col(text)), start, f"`{doc_id}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str, proven) -> Counter:
    """One for each worker and vocabulary; workers are used again by later tasks."""
    if path not in _COUNTERS:
        tokens, known = proven.value
        _COUNTERS[path] = Counter(path, tokens, frozenset(known))
    return _COUNTERS[path]
