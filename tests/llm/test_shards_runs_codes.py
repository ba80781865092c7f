"""Sharding, runs of words and vector codes: against plain versions, their SQL, and corner rows."""

import hashlib
import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import queries, shard_tree, tandem_runs, vector_codes
from panelspark.llm.shard_tree import Leaf

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_shard_tree", "op13_vector_codes"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in df.collect())


# Sharding

TREE = tuple(Leaf(f"r{r}", f"k{k}", 100 * r + 10 * k + s, 1.0 + s) for r in range(3) for k in range(3) for s in range(2))


def plain_leaf(key, leaves):
    parts = []
    for level in range(3):
        weights = Counter()
        for x in leaves:
            path = (x.region, x.rack, str(x.shard))
            if path[:level] == tuple(parts):
                weights[path[level]] += x.weight

        def score(name):
            digest = hashlib.md5(f"{key}@{'/'.join([*parts, name])}".encode()).hexdigest()
            return -math.log((int(digest[:13], 16) + 0.5) / 2**52) / weights[name]

        parts.append(min((n for n in weights if weights[n]), key=score))
    return "/".join(parts)


def leaves_of(spark, leaves, n=6_000):
    return [r.leaf.split("/") for r in spark.range(n).select("id", shard_tree.leaf_of(F.col("id"), leaves).alias("leaf")).orderBy("id").collect()]


def test_descent_equals_plain(spark):
    found = leaves_of(spark, TREE, 400)
    assert ["/".join(x) for x in found] == [plain_leaf(i, TREE) for i in range(400)]


def test_weights_and_movement(spark):
    """Shares follow weights; a weight that grows or falls moves keys only where the weights above it change."""
    before = leaves_of(spark, TREE)
    total = sum(x.weight for x in TREE)
    share = Counter(int(x[2]) for x in before)
    for x in TREE:
        want = len(before) * x.weight / total
        assert abs(share[x.shard] - want) < 5 * math.sqrt(want)
    for weight in (6.0, 0.0):
        changed = tuple(replace(x, weight=weight) if x.shard == 110 else x for x in TREE)
        moved = 0
        for old, new in zip(before, leaves_of(spark, changed), strict=True):
            # Read in the direction in which the weight grows.
            a, b = (old, new) if weight else (new, old)
            for level, at in enumerate(("r1", "k1", "110")):
                if a[:level] == b[:level]:
                    assert a[level] == b[level] or b[level] == at
            moved += old != new
        assert moved


@pytest.mark.parametrize("count", range(8, 14))
def test_one_more_shard_takes_only_into_itself(spark, count):
    keys = spark.range(3_000)
    rows = keys.select(shard_tree.shard_of(F.col("id"), shard_tree.tree_of(count)).alias("a"), shard_tree.shard_of(F.col("id"), shard_tree.tree_of(count + 1)).alias("b")).collect()
    assert all(r.a == r.b or r.b == count for r in rows)
    new = sum(r.b == count for r in rows)
    assert abs(new - 3_000 / (count + 1)) < 5 * math.sqrt(3_000 / (count + 1))


def test_shard_rows(spark, tmp_path, monkeypatch):
    """Corner rows, many copies of one row, clashing names; slots are gapless with buckets of any size."""
    schema = "doc_id long, text string, shard int, law string, n map<string, int>, region string"
    given = [(None, None), (None, ""), (1, None), (1, ""), (2, "é" * 1000), (3, "x")] + [(7, "same")] * 300 + [(i, f"t{i % 5}") for i in range(10, 700)]
    docs = spark.createDataFrame([(*r, 1, "x", {"a": 1}, "x") for r in given], schema)
    monkeypatch.setattr(shard_tree, "BUCKET_ROWS", 10)
    monkeypatch.setattr(shard_tree, "ALIKE_ROWS", 40)
    rows = shard_tree.with_slots(shard_tree.assign(docs, shard_tree.tree_of(8), shard_tree.tree_of(9))).collect()
    key = lambda i: "" if i is None else i
    want = Counter()
    for i, t in given:
        b = (t or "").encode()
        want[i, len(b) + 1, zlib.crc32(b), "key", *(int(plain_leaf(key(i), shard_tree.tree_of(n)).split("/")[2]) for n in (8, 9))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    empty = docs.filter("false")
    assert shard_tree.with_slots(shard_tree.assign(empty, shard_tree.tree_of(8), shard_tree.tree_of(9))).collect() == []
    names = shard_tree.write_shards(docs, str(tmp_path / "shards"), shard_tree.tree_of(8))
    assert names == ("region_", "rack", "shard_")
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(given)
    assert all(r.shard_ == int(plain_leaf(key(r.doc_id), shard_tree.tree_of(8)).split("/")[2]) for r in back.collect())


def test_tree_errors():
    for bad in ((), (Leaf("a", "b", 1, 0.0),), (Leaf("a", "b", 1), Leaf("a", "c", 1)), (Leaf("a", "b", 1), Leaf("a", "c", 2, -1.0)), (Leaf("a", "b", 1), Leaf("a", "c", 2, float("nan")))):
        with pytest.raises(ValueError):
            shard_tree.checked(bad)


# Runs


def plain_runs(words):
    """Every period in turn: stretches of places whose word stands again a period later."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    v, found = np.array([numbers[w] for w in words], np.int64), []
    for q in range(1, len(v) // 4 + 1):
        same = np.concatenate(([0], v[:-q] == v[q:], [0])).astype(int)
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            long = j - i + q
            if long >= max(6, 4 * q) and not any((v[i : i + long - p] == v[i + p : i + long]).all() for p in range(1, q)):
                found.append((i, long, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def invented(rng):
    kinds = rng.choice([1, 2, 3, 5])
    words = [rng.randrange(kinds) for _ in range(rng.choice([0, 1, 5, 6, 10, 40, 90]))]
    if words and rng.random() < 0.5:
        start = rng.randrange(len(words))
        p = rng.randint(1, len(words) - start)
        words = [words[i] if i < start else words[start + (i - start) % p] for i in range(len(words))]
    return [f"w{x}" for x in words * rng.choice([1, 1, 2, 5])]


@pytest.mark.parametrize("leaves", [1_000_000, 7])
def test_runs_equal_plain(spark, monkeypatch, leaves):
    rng = random.Random(3)
    monkeypatch.setattr(tandem_runs, "LEAF_BLOCK", leaves)
    monkeypatch.setattr(tandem_runs, "TREE_WORDS", 300)
    texts = [invented(rng) for _ in range(600)]
    for words, (runs, text) in zip(texts, tandem_runs.collapsed([" ".join(w) for w in texts]), strict=True):
        want = plain_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert text == plain_collapsed(words, want)


def test_run_rows(spark):
    """Corner rows, clashing names, ASCII spaces alone between words, a long text of one word and one of a long period."""
    period = " ".join(f"p{i}" for i in range(3_000))
    given = [(None, None), (1, ""), (1, " \t\n"), (2, "a\x0ba\x0ca\ra\na\ta a"), (3, "a a " * 3), (4, "b " * 50_000), (5, ("x " + period + " ") + " ".join([period] * 4)), (5, "a b a b a b a b"), (5, "a b a b a b a b")]
    docs = spark.createDataFrame([(i, t, [1], "x") for i, t in given], "doc_id long, text string, runs array<int>, n_words string")
    rows = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in tandem_runs.find_runs(docs).collect()]
    assert rows[:5] == [(None, 0, [], ""), (1, 0, [], ""), (1, 0, [], ""), (2, 7, [(0, 7, 1)], "a"), (3, 3, [], "a a a a a a")]
    assert rows[5] == (4, 50_000, [(0, 50_000, 1)], "b")
    assert rows[6] == (5, 15_001, [(1, 15_000, 3_000)], "x " + period)
    assert rows[7:] == [(5, 8, [(0, 8, 2)], "a b")] * 2
    assert tandem_runs.find_runs(docs.filter("false")).collect() == []


def test_run_query_equals_plain(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op12_tandem_runs(spark, SF).collect()}
    assert rows.keys() == texts.keys() and any(r.n_runs > 0 for r in rows.values())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, text in texts.items():
        words = [w.decode() for w in (text or "").encode().split()]
        h = zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = plain_runs(words)
        r = rows[i]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(plain_collapsed(words, runs))


# Vector codes


def plain_codes(given, parts=8, entries=16, rounds=6):
    """given: (id, label, vector) in any order; exact integers of any size."""
    kept = [(i, b, [math.floor(4096 * x) for x in v]) for i, b, v in given if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = -(-len(kept[0][2]) // parts)
    cut = [[(v + [0] * width * parts)[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, z, strict=True)), e) for e, z in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            taken = [nearest(p, c[p])[1] for c in cut]
            for e in set(taken):
                mine = [c[p] for c, t in zip(cut, taken, strict=True) if t == e]
                books[p][e] = [sum(k) // len(mine) for k in zip(*mine, strict=True)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    return [(i, b, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (i, b, _), f in zip(kept, found, strict=True)], books


@pytest.mark.parametrize(("block", "leaf"), [(4_096, 16), (50, 4), (7, 1)])
def test_codes_equal_plain(spark, block, leaf):
    """Clusters, copies, ties of distance, corner vectors; blocks and leaves of any size give the same."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 24))
    vectors = [c + rng.normal(size=24) * 0.1 for c in centres for _ in range(40)] + [np.zeros(24)] * 30 + [rng.integers(-1, 2, 24) / 4096 for _ in range(60)]
    given = [(int(i), int(i) % 3 or None, [float(x) for x in v]) for i, v in zip(rng.permutation(1_000), vectors, strict=False)]
    given += [(2_000, 1, None), (2_001, 1, [None] * 24), (2_002, 1, [float("nan")] * 24), (2_003, 1, [float("inf")] * 24), (2_004, 1, []), (2_005, 1, [1.0] * 3), (None, 2, [0.5] * 24), (3, 1, [0.25] * 24), (3, 1, [0.25] * 24)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in given], "vec_id long, label int, embedding array<double>, code string, v int")
    coded, books = vector_codes.encode_vectors(frame, vector_codes.CodeSettings(block=block, leaf=leaf))
    want, want_books = plain_codes(given)
    assert books.tolist() == want_books
    rows = vector_codes.with_label_errors(coded).collect()
    assert Counter((r.vec_id, r.label, r.code, r.error) for r in rows) == Counter(want)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert all(r.label_error == sums[r.label] for r in rows)


def test_code_corners(spark):
    schema = "vec_id long, label int, embedding array<float>"
    for given in ([], [(1, 1, None)], [(1, 1, [float("nan")])]):
        coded, books = vector_codes.encode_vectors(spark.createDataFrame(given, schema))
        assert vector_codes.with_label_errors(coded).collect() == [] and books.size == 0
    few = [(2, None, [1.0, 2.0, 3.0]), (1, None, [0.5, -2.0, 9.0])]
    coded, books = vector_codes.encode_vectors(spark.createDataFrame(few, schema))
    assert sorted(tuple(r) for r in coded.collect()) == [(1, None, "00" * 8, 0), (2, None, "01" * 3 + "00" * 5, 0)] and books.shape == (8, 2, 1)
    with pytest.raises(Exception, match="beyond"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, 1, [1e6])], schema))
    big = [(i, 0, [30_000.0 * math.sin(i * k + k) for k in range(1, 17)]) for i in range(60)]
    coded, books = vector_codes.encode_vectors(spark.createDataFrame(big, "vec_id long, label int, embedding array<double>"))
    want, want_books = plain_codes(big)
    assert books.tolist() == want_books and Counter(tuple(r) for r in coded.collect()) == Counter(want)


def test_filter_equals_distances():
    rng = np.random.default_rng(1)
    for _ in range(60):
        positions, n, width, span = (int(x) for x in (rng.integers(1, 4), rng.integers(1, 300), rng.integers(1, 5), rng.choice([1, 3, 50, 4_000, 1 << 26])))
        cut = rng.integers(-span, span + 1, (positions, n, width))
        books = rng.integers(-span, span + 1, (positions, min(16, n), width))
        trees = vector_codes.build_trees(cut, int(rng.choice([1, 4, 16])))
        far = ((cut[:, :, None, :] - books[:, None]) ** 2).sum(3)
        codes, error = vector_codes.entry_of(trees, books, n)
        assert (codes == far.argmin(2).T).all() and (error == far.min(2).sum(0)).all()
        sums, counts = vector_codes.entry_sums(trees, books)
        for p, z in np.ndindex(*counts.shape):
            mine = cut[p][far[p].argmin(1) == z]
            assert counts[p, z] == len(mine) and (sums[p, z] == mine.sum(0)).all()
