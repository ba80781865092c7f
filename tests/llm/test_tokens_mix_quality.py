"""Token files against the library, mixing against a plain queue, the classifier against held-out labels."""

import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import mixing, quality_pu, token_files
from panelspark.llm.common import fresh_path, written

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \t\n", "Hello, WORLD. don't I'LL we've a.b, c..., 12,000.5 x_y—z", "É́ é à ﬁ İ ΑΣ ß", "<|endoftext|> A <|STARTOFTEXT|>b<|startoftext|>",
    "漢字 かな 🙂🙂 \x1c\x85\xa0x y", "The the THE. the, " * 500, "same", "same",
]


def test_token_files_equal_library(spark):
    tok = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(len(TEXTS) - i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "x y", 1)], "doc_id long, text string, start int")
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "1 as start"))
    out = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, out, PATH, 2)
    rows = token_files.token_index(spark, out).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [r.doc_id for r in rows] == sorted(texts, key=lambda i: (i is not None, i))
    start = 0
    for r in rows:
        ids = [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[r.doc_id]
        start += len(ids)
    plan = token_files.read_tokens(spark, out).filter("doc_id = 120").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,120)" in plan and "tokens:array" not in plan.split("ReadSchema")[-1]


def test_token_file_format(spark):
    out = fresh_path(spark, "tokens")
    token_files.write_tokens(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), out, PATH, 2)
    for file in Path(out.removeprefix("file:")).glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_token_files_empty(spark):
    out = fresh_path(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), out, PATH, 2)
    assert token_files.token_index(spark, out).collect() == []


def plain_mix(docs, weights=(3, 1, 2), budget=1.5):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = {i: words(t) for i, t, _ in docs}
    of = {i: s for i, _, s in docs}
    order = sorted(set(of.values()), key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    own = {s: sum(size[i] for i in of if of[i] == s) for s in order}
    target, free = dict.fromkeys(order, 0.0), set(order)
    left = budget * sum(own.values())
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * own[s] < weight[s] * rate}
        for s in full or free:
            target[s] = 2 * own[s] if full else weight[s] * rate
            left -= target[s]
        free -= full or free
    passes = []
    for s in order:
        ids = sorted((i for i in of if of[i] == s), key=lambda i: hashlib.md5(f"{i}:mix".encode()).hexdigest())
        upto = 0
        for i in ids * 2:
            upto += size[i]
            if target[s] and size[i]:
                passes.append((upto / target[s], i))
    taken, spent = dict.fromkeys(of, 0), 0
    for at in sorted({p for p, _ in passes}):
        here = [i for p, i in passes if p == at]
        if spent + sum(size[i] for i in here) > budget * sum(own.values()):
            break
        for i in here:
            spent += size[i]
            taken[i] += size[i]
    return {i: (size[i], own[of[i]], pytest.approx(target[of[i]]), taken[i]) for i in of}


@pytest.mark.parametrize("bucket_rows", [5, 20_000])
def test_mix_equals_plain_queue(spark, bucket_rows):
    docs = [(i, " w" * (i * 7 % 23), ["a", "b", None, "É", "Z", "hot"][min(i % 9, 5)]) for i in range(300)] + [(999, None, "b"), (1000, "", "empty")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as taken")
    mix = mixing.Mix(bucket_rows=bucket_rows)
    rows, _ = mixing.mix_documents(frame, mix)
    want = plain_mix(docs)
    assert {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in rows.collect()} == want
    out = mixing.mixed_rows(frame, mix)
    assert out.columns == frame.columns
    times = {i: 0 for i in want}
    for r in out.collect():
        times[r.doc_id] += 1
    assert {i: n * want[i][0] for i, n in times.items()} == {i: w[3] for i, w in want.items()}


def test_mix_corner_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_documents(empty)[0].collect() == [] and mixing.mixed_rows(empty).collect() == []
    same = spark.createDataFrame([(None, "a b", None)] * 4 + [(1, None, None)], "doc_id long, text string, source string")
    assert sorted(r.taken for r in mixing.mix_documents(same)[0].collect()) in ([0, 0, 0, 0, 0], [0, 2, 2, 2, 2])


def test_mixed_rows_keep_columns_of_any_type_and_name(spark):
    docs = spark.sql("SELECT id AS doc_id, 'a b' AS text, 's' AS source, map('k', id) AS m, 1 AS `a.b`, 2 AS _id, 3 AS _of, 4 AS _at, 5 AS at, 6 AS tie, 7 AS of_id, map('x', 1) AS `c``d` FROM range(6)")
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert {(r.m["k"], r["a.b"], r["at"], r["_at"]) for r in out.collect()} <= {(i, 1, 5, 4) for i in range(6)} and out.count() == 9


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality_pu.classify(docs, labels)
    both = found.join(labels, "doc_id").filter("held_out").toPandas()
    assert (both.predicted == both.quality).mean() > 0.98
    assert (both.predicted[both.quality == 1] == 1).mean() > 0.99
    assert found.count() == docs.count() and found.filter("score < 0 or score > 1 or score is null").count() == 0


def plain_risk(x, positive, weights, prior, ridge, hold=None):
    """The non-negative risk, or with hold its second term multiplied by that, and that term."""
    g = x @ weights
    loss = lambda z: np.logaddexp(0, -z)
    second = loss(-g).mean() - prior * loss(-g[positive]).mean()
    return prior * loss(g[positive]).mean() + (max(0.0, second) if hold is None else hold * second) + ridge * weights @ weights, second


def plain_minimum(x, positive, prior, ridge):
    """For a hold the convex risk is minimised by plain Newton steps with halving; the hold is found by bisection, as the second term rises with it."""

    def least(hold, w):
        for _ in range(60):
            s = 1 / (1 + np.exp(-(x @ w)))
            xp, sp = x[positive], s[positive]
            gradient = hold * (x.T @ s / len(x) - prior * xp.T @ sp / len(xp)) + prior * xp.T @ (sp - 1) / len(xp) + 2 * ridge * w
            curve = (x * (s * (1 - s))[:, None]).T @ x * hold / len(x) + (1 - hold) * prior * (xp * (sp * (1 - sp))[:, None]).T @ xp / len(xp)
            step, size = np.linalg.solve(curve + 2 * ridge * np.eye(len(w)), gradient), 1.0
            now = plain_risk(x, positive, w, prior, ridge, hold)[0]
            while size > 1e-6 and plain_risk(x, positive, w - size * step, prior, ridge, hold)[0] > now:
                size /= 2
            w = w - size * step
            if np.abs(gradient).max() < 1e-10:
                break
        return w

    w = least(1.0, np.zeros(x.shape[1]))
    if plain_risk(x, positive, w, prior, ridge)[1] >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        w = least(mid, w)
        low, high = (mid, high) if plain_risk(x, positive, w, prior, ridge)[1] > 0 else (low, mid)
    return w


@pytest.mark.parametrize("prior", [0.3, 0.5, 0.9])
def test_fit_minimises_the_non_negative_risk(spark, prior):
    """Sums against plain ones, and the risk of the weights found against the plain minimum; at a prior of 0.9 the second term is held at zero."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = labels.filter("quality = 1").selectExpr("doc_id", "true as positive")
    rows = quality_pu.features_of(docs, "doc_id", "text").join(good, "doc_id", "left").selectExpr("features", "coalesce(positive, false) as positive")
    held = rows.toPandas()
    features, positive = np.array(held.features.tolist()), held.positive.to_numpy()
    edges = np.quantile(features, [i / 10 for i in range(1, 10)], axis=0).T
    x, s = quality_pu.binned(features, edges), quality_pu.PuSettings(passes=40, least_step=1e-4)
    train = spark.createDataFrame(held[["features", "positive"]], "features array<double>, positive boolean").repartition(20)
    w = np.linspace(-1, 1, x.shape[1])
    found, p = quality_pu.sums(train, edges, w), 1 / (1 + np.exp(-(x @ w)))
    assert found["head"][:2] == pytest.approx([len(x), positive.sum()])
    assert found["grad_u"] == pytest.approx(x.T @ p) and found["grad_p"] == pytest.approx(x[positive].T @ p[positive])
    assert found["hess"] == pytest.approx((x * (p * (1 - p))[:, None]).T @ x)
    weights, _ = quality_pu.newton(train, edges, np.zeros(x.shape[1]), prior, s)
    ridge = s.ridge + 1 / positive.sum()
    best = plain_risk(x, positive, plain_minimum(x, positive, prior, ridge), prior, ridge)
    mine = plain_risk(x, positive, weights, prior, ridge)
    assert mine[0] <= best[0] + 1e-6


def test_fits_agree_whatever_the_partitions(spark):
    """Bins against a plain count of all values cut to eleven bits; weights of rows in other partitions and orders."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = written(quality_pu.features_of(docs, "doc_id", "text"), "features")
    edges = quality_pu.bin_edges(rows, 10)
    values = np.array(rows.toPandas().features.tolist())
    unit = 2.0 ** (np.floor(np.log2(np.where(values > 0, values, 1))) - 10)
    plain = np.sort(np.where(values > 0, np.floor(values / unit) * unit, 0), axis=0)
    assert (edges.T == plain[[-(-len(plain) * i // 10) - 1 for i in range(1, 10)]]).all()
    found = [quality_pu.fit(rows.repartition(n).sortWithinPartitions(F.rand(n)), labels) for n in (3, 8)]
    assert (found[0].edges == found[1].edges).all() and (found[0].weights == found[1].weights).all() and found[0].prior == found[1].prior
    assert (quality_pu.bin_edges(rows.limit(0), 10) == 0).all()


def test_classifier_never_reads_held_out_or_negative_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    hidden = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    hidden = hidden.filter("quality = 1 or crc32(cast(doc_id as string)) % 4 = 2")
    a, b = ({r.doc_id: r.score for r in quality_pu.classify(docs, x).collect()} for x in (labels, hidden))
    assert a == pytest.approx(b, abs=1e-9)


def test_classifier_corner_rows(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 30000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(None, 1), (1, None), (5, 1)], "doc_id long, quality int")
    rows = quality_pu.classify(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert quality_pu.keep_good(docs, labels).columns == docs.columns
    odd = docs.selectExpr("*", "1 as features", "map('a', 1) as m", "2 as `a.b`")
    assert quality_pu.keep_good(odd, labels).dtypes == odd.dtypes and quality_pu.keep_good(odd, labels).count() == quality_pu.keep_good(docs, labels).count()
    assert quality_pu.classify(docs.limit(0), labels).collect() == []
