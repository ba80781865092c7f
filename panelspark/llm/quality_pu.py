"""Quality classifier by positive-unlabelled learning.

Trusted positives and all unlabelled web text train an additive logistic model
over binned text statistics by minimising the non-negative unbiased risk

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)]).

With logistic loss the unbiased risk is convex, so Newton steps do; each is one
Spark pass that sums gradients over all rows. Where the second term would be
negative, its multiplier falls so far that it is zero. The class prior is
estimated from the least ratio of unlabelled to positive mass over upper score
tails, on a fold that a first fit leaves out. Negative labels are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import free_name, map_batches, prepare, written

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:'\"()-?"
SPACES = b" \t\n\r\x0b\x0c"
SIGNS = bytes(c for c in range(33, 127) if bytes([c]) not in LETTERS + DIGITS and bytes([c]) not in STOPS)

FEATURES = (
    "log_words", "word_length", "distinct", "repeated_next", "upper", "digits", "stops", "signs",
    "sign_words", "line_words", "repeated_lines", "long_words", "short_lines", "letters",
)


@dataclass(frozen=True)
class PuSettings:
    """How the classifier is fitted and used.

    bins: of each statistic. passes: over the rows for a fit, at most. longest,
    least_step: of a change of weights. ridge: weight of the squared norm, to
    which one over the number of positives is added. tails: shares of the
    positives in the tails that give the prior. prior_fold: the remainder of crc32(id as text) mod 4
    that is held back for the prior; held_out: the one whose labels are never
    read. threshold: least score of a kept document.
    """

    bins: int = 10
    passes: int = 14
    longest: float = 2.0
    least_step: float = 0.02
    ridge: float = 1e-3
    first_prior: float = 0.5
    tails: tuple[float, float] = (0.8, 0.97)
    prior_fold: int = 3
    threshold: float = 0.7
    held_out: int = 2


@dataclass
class PuModel:
    edges: np.ndarray
    weights: np.ndarray
    prior: float
    history: list[tuple[float, float]] = field(default_factory=list)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(binned(features, self.edges) @ self.weights, -40, 40)))


def text_features(text: bytes) -> list[float]:
    """Statistics of a whole text; all are defined for an empty one."""
    words, lines = text.split(), text.split(b"\n")
    n, size = len(words), len(text)
    one = max(n, 1)
    count = lambda kind: size - len(text.translate(None, kind))
    inner = max(size - count(SPACES), 1)
    letters = count(LETTERS)
    signs = count(SIGNS)
    return [
        math.log1p(n),
        inner / one,
        len(set(words)) / one ** 0.9,
        sum(map(bytes.__eq__, words, words[1:])) / one,
        count(UPPER) / max(letters, 1),
        count(DIGITS) / inner,
        count(STOPS) / inner,
        signs / inner,
        signs / one,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(len(w) > 24 for w in words) / one,
        sum(len(x) < 20 for x in lines) / len(lines),
        letters / inner,
    ]


def binned(features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot bins of each statistic, and a constant."""
    n, k, bins = len(features), edges.shape[0], edges.shape[1] + 1
    out = np.zeros((n, k * bins + 1))
    rows = np.arange(n)
    for i in range(k):
        out[rows, i * bins + np.searchsorted(edges[i], features[:, i], side="right")] = 1
    out[:, -1] = 1
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def features_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, features) of all whole texts; a null text counts as empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [text_features(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

        return each

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), start, f"doc_id {kind}, features array<double>")


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def sums(train: DataFrame, edges: np.ndarray, weights: np.ndarray, bins: int = 0) -> dict[str, np.ndarray]:
    """One pass over all rows: counts, losses, gradient and curvature sums; with bins, score histograms instead."""

    width = 2 * bins if bins else 5 + 3 * len(weights) + 2 * len(weights) ** 2

    def part(features: pa.ListArray, positive: pa.Array) -> np.ndarray:
        x = binned(matrix(features), edges)
        p = positive.to_numpy(zero_copy_only=False).astype(bool)
        g = np.clip(x @ weights, -40, 40)
        s = 1 / (1 + np.exp(-g))
        if bins:
            at = np.minimum((s * bins).astype(int), bins - 1)
            parts = [np.bincount(at, minlength=bins), np.bincount(at[p], minlength=bins)]
        else:
            up, curve = np.logaddexp(0, g), (s * (1 - s))[:, None]
            parts = [[len(g), p.sum(), up.sum(), up[p].sum(), np.logaddexp(0, -g[p]).sum()]]
            parts += [x.T @ s, x[p].T @ s[p], x[p].sum(0), (x * curve).T @ x, (x[p] * curve[p]).T @ x[p]]
        return np.concatenate([np.asarray(v, float).ravel() for v in parts])

    def one_row(vectors) -> pa.RecordBatch:
        total = np.zeros(width)
        for v in vectors:
            total += v
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add_rows(batches):
        yield one_row(part(batch.column(0), batch.column(1)) for batch in batches if batch.num_rows)

    def add_sums(batches):
        yield one_row(np.frombuffer(value.as_py()) for batch in batches for value in batch.column(0))

    # A row of sums for each partition, then for each of about the square root of so many, then one, which the driver gets.
    parts = train.select("features", "positive").mapInArrow(add_rows, "sums binary")
    few = math.isqrt(train.rdd.getNumPartitions())
    if few > 3:
        parts = parts.repartition(few).mapInArrow(add_sums, "sums binary")
    total = np.frombuffer(parts.repartition(1).mapInArrow(add_sums, "sums binary").collect()[0]["sums"])
    if bins:
        return {"u": total[:bins], "p": total[bins:]}
    d = len(weights)
    head, grad_u, grad_p, x_p, hess, hess_p = np.split(total, np.cumsum([5, d, d, d, d * d]))
    return {"head": head, "grad_u": grad_u, "grad_p": grad_p, "x_p": x_p, "hess": hess.reshape(d, d), "hess_p": hess_p.reshape(d, d)}


def bin_edges(train: DataFrame, bins: int) -> np.ndarray:
    """For each statistic the values at which bins begin, of about as many rows each.

    All values count, cut down to eleven significant bits: there are few of
    these, and their counts, unlike a sketch of quantiles, do not depend on the
    order in which tasks end.
    """
    unit = F.pow(F.lit(2.0), F.floor(F.log2("value")) - 10)
    cut = F.when(F.col("value") > 0, F.floor(F.col("value") / unit) * unit).otherwise(0.0)
    counts = train.select(F.posexplode("features").alias("at", "value")).groupBy("at", cut.alias("value")).agg(F.count("*").alias("n"))
    upto, whole = F.sum("n").over(Window.partitionBy("at").orderBy("value")), F.sum("n").over(Window.partitionBy("at"))
    last = F.floor(upto * bins / whole)
    ranked = counts.select("at", "value", (F.floor((upto - F.col("n")) * bins / whole) + 1).alias("low"), F.least(last, F.lit(bins - 1)).alias("high"))
    edges = np.zeros((len(FEATURES), bins - 1))
    for r in ranked.filter("low <= high").collect():
        edges[r["at"], r["low"] - 1 : r["high"]] = r["value"]
    return edges


def newton(train: DataFrame, edges: np.ndarray, weights: np.ndarray, prior: float, s: PuSettings) -> tuple[np.ndarray, list]:
    """Newton steps on prior * E_p[loss(g)] + hold * (E_u[loss(-g)] - prior * E_p[loss(-g)]), convex for each hold of 0 to 1.

    hold is the multiplier of the second term in the saddle form of max(0, .):
    1 while that term stays positive, else such that the step brings it to zero.
    Weights have six decimals after each step, so that the order in which Spark
    adds sums does not show and reruns agree.
    """
    history, hold = [], 1.0
    for _ in range(s.passes):
        t = sums(train, edges, weights)
        n, n_p, up_u, up_p, down_p = t["head"]
        second = up_u / n - prior * up_p / n_p
        history.append((float(prior * down_p / n_p + max(0.0, second)), float(second)))
        ridge = s.ridge + 1 / n_p
        first_gradient = prior * (t["grad_p"] - t["x_p"]) / n_p + 2 * ridge * weights
        second_gradient = t["grad_u"] / n - prior * t["grad_p"] / n_p
        curve = hold * t["hess"] / n + (1 - hold) * prior * t["hess_p"] / n_p + 2 * ridge * np.eye(len(weights))
        to_first, to_second = np.linalg.solve(curve, np.array([first_gradient, second_gradient]).T).T
        hold = float(np.clip((second - second_gradient @ to_first) / max(second_gradient @ to_second, 1e-12), 0.0, 1.0))
        step = to_first + hold * to_second
        longest = float(np.abs(step).max())
        weights = np.round(weights - step * min(1.0, s.longest / max(longest, 1e-12)), 6)
        if longest < s.least_step:
            break
    return weights, history


def tail_prior(u: np.ndarray, p: np.ndarray, tails: tuple[float, float]) -> float:
    """The least ratio of unlabelled to positive mass over upper tails that hold such shares of the positives."""
    above_u, above_p = u[::-1].cumsum()[::-1] / max(u.sum(), 1), p[::-1].cumsum()[::-1] / max(p.sum(), 1)
    at = np.unique(np.searchsorted(-above_p, -np.linspace(*tails, 18), side="right") - 1)
    return float(np.clip((above_u[at] / np.maximum(above_p[at], 1e-9)).min(), 0.01, 0.99))


def fit(features: DataFrame, labels: DataFrame, settings: PuSettings = PuSettings()) -> PuModel:
    """features: (doc_id, features) of all documents. labels: (doc_id, quality); only quality 1 outside the held-out fold is read.

    Without positives in both parts the model scores every document with the first prior.
    """
    prepare(features.sparkSession)
    trusted = labels.filter((F.col("quality") == 1) & (fold(F.col("doc_id")) != settings.held_out)).select(F.col("doc_id").alias("label_id")).distinct()
    marked = features.join(trusted, F.col("doc_id") == F.col("label_id"), "left").select("features", F.col("label_id").isNotNull().alias("positive"), fold(F.col("doc_id")).eqNullSafe(settings.prior_fold).alias("back"))
    train = written(marked, "pu-train")
    edges = bin_edges(train, settings.bins)
    weights = np.zeros(len(FEATURES) * settings.bins + 1)
    if not train.filter("positive AND NOT back").take(1) or not train.filter("positive AND back").take(1):
        weights[-1] = math.log(settings.first_prior / (1 - settings.first_prior))
        return PuModel(edges, weights, settings.first_prior)
    weights, history = newton(train.filter("NOT back"), edges, weights, settings.first_prior, settings)
    found = sums(train.filter("back"), edges, weights, 2000)
    prior = tail_prior(found["u"], found["p"], settings.tails)
    weights[-1] += math.log(prior / (1 - prior)) - math.log(settings.first_prior / (1 - settings.first_prior))
    weights, more = newton(train, edges, weights, prior, settings)
    return PuModel(edges, weights, prior, history + more)


def scored(features: DataFrame, model: PuModel) -> DataFrame:
    """Rows (doc_id, score) of rows (doc_id, features)."""
    kind = features.schema["doc_id"].dataType.simpleString()

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(matrix(batch.column(1))))], ["doc_id", "score"])

        return each

    return map_batches(features, start, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, settings: PuSettings = PuSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    A null text scores as an empty one; a null id is not held out and has no
    label; repeated rows stay; an empty table gives an empty result; other
    columns never enter a score, whatever their names.
    """
    prepare(docs.sparkSession)
    features = written(features_of(docs, doc_id, text), "pu-features")
    rows = scored(features, fit(features, labels, settings))
    held = F.coalesce(fold(F.col("doc_id")) == settings.held_out, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: PuSettings = PuSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that score at least the threshold.

    The rows are written once with their statistics, so that texts are read once
    and no shuffle moves them; as in any table read from Parquet, all columns
    may then be null by the schema. Null and empty texts, null ids, repeated rows and
    empty tables as in classify.
    """
    prepare(docs.sparkSession)
    held = free_name(docs)("features")

    @F.pandas_udf("array<double>")
    def statistics(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: text_features((x or "").encode()))

    table = written(docs.withColumn(held, statistics(F.col(text))), "pu-docs")
    model = fit(table.select(F.col(doc_id).alias("doc_id"), F.col(held).alias("features")), labels, settings)

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(features.tolist()).reshape(-1, len(FEATURES))))

    return table.filter(score(F.col(held)) >= settings.threshold).drop(held)
