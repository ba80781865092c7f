"""Near-duplicate components against brute force over all pairs."""

import random

import pytest

from panelspark.llm import graph, minhash


def plain_sets(texts, size):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    return out


def plain_components(ids, sets):
    root = {}
    for k, i in enumerate(ids):
        root[k] = k

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    of: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            of.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        near: dict = {}
        for x in s:
            for j in of[x]:
                near[j] = near.get(j, 0) + 1
        for j, n in near.items():
            if j > k and 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    least: dict = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def check(spark, texts, settings):
    ids = [3 * i + 1 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_shingles long, key string")
    rows = minhash.near_components(docs, settings).collect()
    sets = plain_sets(texts, settings.words)
    want = plain_components(ids, sets)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in zip(ids, sets, strict=True)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("group_rows", [8, 128])
def test_components_equal_brute_force(spark, group_rows):
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "One ", "one two three", "ONE two\tthree", "é É", "É É"]
    for size in (6, 40, 200):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [edited(rng, base, rng.randrange(0, 1 + size // 25)) for _ in range(40)] + [" ".join(base)] * 9
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts.append("long " * 30000)
    check(spark, texts, minhash.NearSettings(words=4, group_rows=group_rows))


@pytest.mark.parametrize("words", [4, 5])
def test_test_data_equal_brute_force(spark, words):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, texts, minhash.NearSettings(words=words))


def test_open_members_of_a_large_bucket(spark, monkeypatch):
    """Some 12,000 texts that are linked with each other and 3,000 that share bands with them, linked with none: few rows are dealt."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(104)]
    texts, near = [" ".join(base)], 12_000
    for k in range(15_000):
        words = list(base)
        for at in rng.sample(range(4, 100, 5), 1 if k < near else 3):  # five shingles each
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    dealt, askers = [], []
    real, rare = minhash.dealt_by_shingles, minhash.rare_shingles
    monkeypatch.setattr(minhash, "rare_shingles", lambda there, *a: (askers.append(there.filter("asker").count()), rare(there, *a))[1])
    monkeypatch.setattr(minhash, "dealt_by_shingles", lambda *a: (out := minhash.cut(real(*a)), dealt.append(out.count()))[0])
    found = minhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 0 if i <= near else i for i in range(len(texts))}
    assert askers[0] > 2000 and dealt[0] < len(texts)


@pytest.mark.parametrize("percent", [60, 80])
def test_open_members_equal_brute_force(spark, monkeypatch, percent):
    """Sets of many sizes around the bound, compared by their rare shingles alone."""
    rng = random.Random(percent)
    s = minhash.NearSettings(words=1, percent=percent, group_rows=4)
    base = [f"w{i}" for i in range(60)]
    sets = {}
    for k in range(250):
        words = rng.sample(base, rng.randrange(30, 60)) + [f"x{rng.randrange(40)}" for _ in range(rng.randrange(6))]
        held = minhash.shingles(" ".join(words).encode(), 1)
        sets[minhash.set_class(held)] = held
    askers = {c for c in sets if rng.random() < 0.5}
    there = spark.createDataFrame([(c, c, c in askers) for c in sets], "cls long, root long, asker boolean")
    table = spark.createDataFrame([(c, x.tobytes()) for c, x in sets.items()], "cls long, shingles binary")
    dealt = minhash.dealt_by_shingles(minhash.rare_shingles(there, table, s), s)
    links = {tuple(sorted(e)) for e in minhash.block_links(dealt.join(table, "cls"), s).collect()}
    plain = {c: set(x.tolist()) for c, x in sets.items()}
    want = {(a, b) for a in plain for b in plain if a < b and (a in askers or b in askers) and 100 * len(plain[a] & plain[b]) >= percent * len(plain[a] | plain[b])}
    assert links == want and len(want) > 100


def test_keep_one_and_corner_rows(spark):
    schema = "doc_id long, text string, cls string"
    rows = [(5, "a b c d e f", "p"), (2, "a b c d e f", "q"), (2, "a b c d e f", "q"), (None, "a b c d e f", "r"), (None, "k l m n o p", "s"), (9, None, "t")]
    kept = minhash.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.cls) for r in kept) == [(0, "s"), (2, "q"), (2, "q"), (9, "t")]
    assert minhash.near_components(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("most", [0, 100_000])
def test_graph_components(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_PAIRS", most)  # 0: all joins by shuffle
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(300)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, {a}), root.setdefault(b, {b})
            if root[a] is not root[b]:
                root[a] |= root[b]
                for x in root[a]:
                    root[x] = root[a]
    assert found == {x: min(s) for x, s in root.items()}


def test_texts_of_repeated_ids_are_fetched_once(spark, monkeypatch):
    """40 classes in pairs, all of a null id: a text is fetched for its own class, not for each."""
    base = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(20)]
    rows = [(None, t + end) for t in base for end in ("", " more")]
    fetched = []
    real = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: (out := real(df, name), fetched.append(out.count()) if name == "near-texts" else None)[0])
    found = minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 40 and fetched == [40]


def test_many_rows_of_a_null_id(spark):
    rows = [(None, f"text number {i} of a null id with words enough {i}") for i in range(5000)] + [(7, "text number 3 of a null id with words enough 3"), (None, "text number 4 of a null id with words enough 4")]
    found = minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5002 and sum(r.component_id == 7 for r in found) == 2 and sum(r.component_id is None for r in found) == 5000
    assert minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5001


def test_keep_one_with_clashing_names(spark):
    names = ("gone", "Body", "gone_", "root", "_gone", "_body", "cls", "a.b")
    rows = [(1, "a b c d e f", *names), (2, "a b c d e f", *names), (3, "k l m n", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
