"""Secret scans: known shapes, and sliding-window Shannon entropy over candidate strings.

Candidate strings are runs of key characters. Each has a character class (hex,
alnum, base64; letters, where it has no digit) with its own entropy threshold. A
window slides over the run; its entropy follows from sum(c * log2 c) over
character counts, which one leaving and one entering character change in
constant time. Windows over the threshold join to spans. A run's segments between
signs can be scanned by their own classes too, so a key is found behind a prefix or
a path. What the allow-list matches takes the windows with it that touch it or are
near, not the whole run; words joined to paths and slugs take those that touch them.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_batches, prepare

#: Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("assign", "access", "hex")
ENTROPY_KINDS = ("entropy_hex", "entropy_alnum", "entropy_base64", "entropy_letters")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")


LETTERS = re.compile(r"[A-Za-z]{20,}")
#: Parts of a run between signs that join names and paths.
SEGMENT = re.compile(r"[A-Za-z0-9]+")
#: A word of a path, a slug or a name of parts: letters of one case, perhaps with a number behind, or a short number.
_WORD = r"(?:(?:[a-z]+|[A-Z][a-z]*|[A-Z]+)[0-9]{0,2}|[0-9]{1,4})(?![A-Za-z0-9])"


@dataclass(frozen=True)
class EntropyRules:
    """window: characters of a window. thresholds: bits a character, by class. allowed: what is no secret, within `near` characters of which no window counts. paths: words joined to paths and slugs, which no window touches. segments: whether a run's segments between signs are scanned by their own classes as well."""

    window: int = 20
    near: int = 20
    thresholds: tuple[tuple[str, float], ...] = (("hex", 2.9), ("alnum", 3.6), ("base64", 3.7), ("letters", 3.9))
    allowed: tuple[str, ...] = (
        r"(?i)example|sample|dummy|placeholder|changeme",
        r"(.)\1{7,}",
        r"(?i)0123456789abcdef|abcdefghijklmnop",
        r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    )
    segments: bool = False
    paths: str = rf"(?<![A-Za-z0-9]){_WORD}(?:[-_/+]+{_WORD}){{3,}}"


def run_class(run: str) -> str:
    """The narrowest of the classes that holds all characters."""
    if run.isalpha():
        return "letters"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


def hot_windows(run: str, window: int, least: float, closed: tuple[tuple[int, int], ...] = ()) -> list[tuple[int, int]]:
    """Joined spans of the windows with at least so many bits a character, but for those that touch closed stretches; counts change by one character a step."""
    if len(run) < window:
        return []
    term = [0.0, *(n * math.log2(n) for n in range(1, window + 2))]  # one more enters before one leaves
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2 c
    most = (math.log2(window) - least) * window + 1e-9
    found: list[tuple[int, int]] = []
    ahead = list(reversed(closed))
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            total += term[n - 1] - term[n]
            counts[gone] = n - 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            while ahead and ahead[-1][1] <= start:
                ahead.pop()
            if ahead and ahead[-1][0] <= i:
                continue
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the known shapes: leftmost, non-overlapping within a kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


class EntropyScan:
    def __init__(self, rules: EntropyRules):
        self.rules = rules
        self.least = dict(rules.thresholds)
        self.allowed = [(re.compile(x), rules.near) for x in rules.allowed] + [(re.compile(rules.paths), 0)]

    def closed(self, run: str) -> tuple[tuple[int, int], ...]:
        """Stretches of the run within `near` characters of what the allow-list matches, and paths, joined, in order."""
        found: list[tuple[int, int]] = []
        for a, b in sorted((m.start() - near, m.end() + near) for x, near in self.allowed for m in x.finditer(run)):
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], max(b, found[-1][1]))
            else:
                found.append((a, b))
        return tuple(found)

    def hot(self, piece: str, at: int, closed: tuple[tuple[int, int], ...]) -> list[tuple[str, int, int]]:
        """Spans of a piece that begins at a place of its run, by its own class and with a digit unless it is letters."""
        kind = run_class(piece)
        own = tuple((a - at, b - at) for a, b in closed)
        spans = hot_windows(piece, self.rules.window, self.least[kind], own)
        return [(f"entropy_{kind}", at + a, at + b) for a, b in spans if kind == "letters" or re.search(r"[0-9]", piece[a:b])]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Spans of whole runs, or of their letters where they have no digit; then, if the rules say so, of a run's segments by the class of each, as far as no span of the run holds them."""
        found = []
        for m in CANDIDATE.finditer(text):
            run = m[0]
            digits = re.search(r"[0-9]", run) is not None
            if digits and not re.search(r"[A-Za-z]", run):
                continue
            closed = self.closed(run)
            pieces = [(run, 0)] if digits else [(x[0], x.start()) for x in LETTERS.finditer(run)]
            own = [s for piece, at in pieces for s in self.hot(piece, at, closed)]
            if self.rules.segments and digits and not run.isalnum():
                parts = [(x[0], x.start()) for x in SEGMENT.finditer(run) if len(x[0]) >= self.rules.window]
                more = [s for piece, at in parts if re.search(r"[0-9]", piece) and re.search(r"[A-Za-z]", piece) for s in self.hot(piece, at, closed)]
                own += [s for s in more if not any(a <= s[1] and s[2] <= b for _, a, b in own)]
            found += [(k, m.start() + a, m.start() + b) for k, a, b in own]
        return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate((*BASE_KINDS, *ENTROPY_KINDS))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """A row per document: id, counts of the known shapes, digest of their spans, all spans (code points, end exclusive).

    A null text counts as empty: no spans, the digest of the empty text. Whole
    texts are read, however long; repeated rows stay repeated; an empty table
    gives an empty result; other columns do not matter, whatever their names.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        scan = EntropyScan(rules)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(5)]
            for value in batch.column(1):
                body = value.as_py() or ""
                base = base_spans(body)
                kinds = [k for k, _, _ in base]
                for column, k in zip(out, BASE_KINDS, strict=False):
                    column.append(kinds.count(k))
                out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[4].append(joined(base + scan.spans(body)))
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.string()) for x in out[3:])]
            return pa.RecordBatch.from_arrays(arrays, [doc_id, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        return each

    rows = docs.select(F.col(doc_id), F.col(text))
    return map_batches(rows, start, f"`{doc_id}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
