"""Periodic runs of words: tandem repeats from suffix trees, after Stoye and Gusfield.

A run is a stretch of words with smallest period q, four periods and six words
long at least, that no neighbouring word extends keeping q. Each text has a
suffix tree of its words; a task builds those of a batch together, as intervals
of one suffix array whose ranks begin with the text's number. For each inner node
of depth D the leaf lists of all children but the largest are walked: a leaf i
pairs with i + D and with i - D where these stand below the node in another
child, which is a branching tandem repeat of period D. Each leaf is walked once
for each halving above it, so n log n times in all. Repeats are rotated to the
left as far as their period holds, by blocks of two, four, ... words that have
equal ranks; those that end in one stretch are one run, of their least period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import prepare

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Words whose trees are built together, and leaves that are walked at once.
TREE_WORDS, LEAF_BLOCK = 400_000, 1_000_000


def sorted_suffixes(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of many texts, by text first, and the ranks of blocks of 1, 2, 4, ... words until all differ.

    words are numbers from 0; doc ascends. Two places of one text have equal
    ranks in the k-th list exactly if the 2^k words from there agree and the text
    does not end before. Only suffixes that are not yet told apart are sorted again.
    """
    n = len(words)
    place = np.arange(n)
    length = int(words.max()) + 1
    order = np.argsort(doc * length + words, kind="stable")
    key = (doc * length + words)[order]
    rank = np.empty(n, np.int32)
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    starts = np.flatnonzero(fresh)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))  # a rank is the first place of its group
    ends = np.append(np.flatnonzero(np.diff(doc)) + 1, n)
    end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    ranks, span = [rank], 1
    while True:
        tied = np.concatenate((~fresh[1:], [False])) | ~fresh  # in order: shares its group
        at = np.flatnonzero(tied)
        if not len(at):
            return order, ranks
        open_ = order[at]
        group, nxt = rank[open_].astype(np.int64), open_ + span
        after = np.where(nxt < end[open_], rank[np.minimum(nxt, n - 1)].astype(np.int64) + 1, 0)
        # A text's end is less than all words; the same text has one such suffix only in a group.
        both = group * (n + 1) + after
        again = np.argsort(both, kind="stable")
        order[at] = open_[again]
        both = both[again]
        fresh = np.ones(n, bool)
        fresh[at[1:]] = both[1:] != both[:-1]
        fresh[at[0]] = True
        rank = rank.copy()
        starts = np.flatnonzero(fresh[at])
        rank[order[at]] = np.repeat(at[starts], np.diff(np.append(starts, len(at))))
        ranks.append(rank)
        span *= 2


def extended(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """How many words from places a and b on agree, or, with the texts' first places, before them; a is before b."""
    n, got = len(ranks[0]), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in reversed(range(len(ranks))):
        x, y = a[live], b[live]
        if first is None:
            there = y + got[live] < n
            same = there & (ranks[k][np.minimum(x + got[live], n - 1)] == ranks[k][np.minimum(y + got[live], n - 1)])
        else:
            back = got[live] + (1 << k)
            there = x - back >= first[live]
            same = there & (ranks[k][np.maximum(x - back, 0)] == ranks[k][np.maximum(y - back, 0)])
        got[live[same]] += 1 << k
    return got


def inner_nodes(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """The suffix tree's inner nodes and, for each, the leaves outside of its largest child.

    lcp[i] is what the suffixes at i - 1 and i share; -1 parts two texts. Gives
    depth, first and last leaf of each node and arrays (node, first, last) of the
    leaf ranges to walk. One pass with a stack of open intervals.
    """
    depth, low, high, of, start, stop = [], [], [], [], [], []
    stack: list[list] = []  # [depth, first leaf, start of the open child, largest child's bounds, its size, ranges]
    values = lcp.tolist()
    n = len(values)
    for i in range(1, n + 1):
        now = values[i] if i < n else -1
        left = i - 1  # a child that ends at leaf i - 1 begins here
        while stack and stack[-1][0] > now:
            d, first, children = stack.pop()
            children.append(left)
            node = len(depth)
            depth.append(d)
            low.append(first)
            high.append(i - 1)
            children.append(i)
            best = max(range(len(children) - 1), key=lambda c: children[c + 1] - children[c])
            if children[best] > first:
                of.append(node), start.append(first), stop.append(children[best])
            if children[best + 1] < i:
                of.append(node), start.append(children[best + 1]), stop.append(i)
            left = first
        if now > 0:
            if stack and stack[-1][0] == now:
                stack[-1][2].append(left)
            else:
                stack.append([now, left, [left]])
    return tuple(np.array(x, np.int64) for x in (depth, low, high, of, start, stop))


def branching_repeats(order: np.ndarray, ranks: list[np.ndarray], doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first place, period) of branching tandem repeats: i and i + D below one node of depth D, in different children."""
    n = len(order)
    if n < 2:
        return
    a, b = np.minimum(order[:-1], order[1:]), np.maximum(order[:-1], order[1:])
    lcp = np.full(n, -1, np.int64)
    same = doc[a] == doc[b]
    lcp[1:][same] = extended(ranks, a[same], b[same])
    depth, low, high, of, start, stop = inner_nodes(lcp)
    place = np.empty(n, np.int64)  # of a suffix among the leaves
    place[order] = np.arange(n)
    sizes = stop - start
    upto = np.cumsum(sizes)
    done = 0
    while done < len(sizes):
        last = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + LEAF_BLOCK, side="right")))
        count = sizes[done:last]
        node = np.repeat(of[done:last], count)
        leaf = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[done:last], count)
        i, d = order[leaf], depth[node]
        for step in (d, -d):
            j = i + step
            inside = (j >= 0) & (j < n)
            where = place[np.where(inside, j, 0)]
            hit = inside & (where >= low[node]) & (where <= high[node])
            x, period = np.minimum(i[hit], j[hit]), d[hit]
            y = x + period
            exact = extended(ranks, x, y) == period  # below different children
            yield x[exact], period[exact]
        done = last


def runs_of(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, end, smallest period) of all runs of many texts, by place, then period; doc ascends."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    order, ranks = sorted_suffixes(words, doc)
    heads = np.searchsorted(doc, doc)  # first place of each word's text
    found = []
    for x, period in branching_repeats(order, ranks, doc):
        begin = x - extended(ranks, x, x + period, heads[x])
        end = x + 2 * period
        long = end - begin >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
        found.append(np.stack([begin[long], end[long], period[long]]))
    begin, end, period = np.concatenate(found, axis=1) if found else (none, none, none)
    by = np.lexsort((period, end, begin))
    begin, end, period = begin[by], end[by], period[by]
    first = np.ones(len(begin), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[first], end[first], period[first]
    by = np.lexsort((period, begin))
    return begin[by], end[by], period[by]


def collapsed(texts: list[str | None]) -> Iterator[tuple[list[dict], str]]:
    """For each text its runs, with places and lengths in words, and its words without all periods of a run but the first, joined by spaces."""
    at = 0
    while at < len(texts):
        words: list[list[bytes]] = []
        total = 0
        # bytes.split parts at the six ASCII spaces alone.
        while at < len(texts) and (not words or total < TREE_WORDS):
            words.append((texts[at] or "").encode().split())
            total += len(words[-1])
            at += 1
        flat = np.empty(total, object)
        flat[:] = [w for ws in words for w in ws]
        sizes = np.array([len(w) for w in words], np.int64)
        heads = np.cumsum(sizes) - sizes
        numbers = pd.factorize(flat)[0].astype(np.int64) if total else np.zeros(0, np.int64)
        begin, end, period = runs_of(numbers, np.repeat(np.arange(len(words)), sizes))
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, begin + period, 1)
        np.add.at(cover, end, -1)
        kept = np.cumsum(cover)[:total] == 0
        of = np.searchsorted(heads, begin, side="right") - 1 if len(begin) else np.zeros(0, np.int64)
        # Wordless texts share their head with the next one; the last text of a head has the words.
        bounds = np.searchsorted(of, np.arange(len(words) + 1))
        for t, (ws, head) in enumerate(zip(words, heads.tolist(), strict=True)):
            span = slice(bounds[t], bounds[t + 1])
            runs = [{"start": b - head, "length": e - b, "period": p} for b, e, p in zip(begin[span].tolist(), end[span].tolist(), period[span].tolist(), strict=True)]
            stay = [w for w, k in zip(ws, kept[head : head + len(ws)].tolist(), strict=True) if k] if runs else ws
            yield runs, b" ".join(stay).decode()


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, runs array<struct<start, length, period>> by start and period, collapsed.

    Words are what stands between ASCII spaces. collapsed is the text without the
    words that a run holds after its first period, joined by single spaces. A
    null text is empty and has no run; repeated rows are each a document of their
    own; null ids stay; other columns do not matter; an empty table gives an
    empty result. No shuffle. A text's tree is built in one task, some 300 bytes
    a word at the peak; texts are whole.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made = list(collapsed(texts))
            counts = [len((t or "").encode().split()) for t in texts]
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array([r for r, _ in made], run), pa.array([c for _, c in made], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(each, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
