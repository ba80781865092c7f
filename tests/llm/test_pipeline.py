"""The pipeline on test data: every stage against what it must do with its own input."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelspark.llm import quality_pu, queries, templates
from panelspark.llm.common import written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    outputs = []
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, SF), name.replace(" ", "-"))
        outputs.append(now)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    good, single, clean, mixed, tokens = outputs
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(good) == {r.doc_id for r in quality_pu.classify(docs, labels).filter("predicted = 1").collect()}

    def grams(t):
        words = t.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets = {i: grams(texts[i]) for i in ids(good)}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    of = {}
    for i, s in sets.items():
        for g in s:
            of.setdefault(g, []).append(i)
    pairs = {(a, b) for i in sets for a in [i] for b in {x for g in sets[i] for x in of[g]} if a < b and near(a, b)}
    kept = ids(single)
    assert not any(a in kept and b in kept for a, b in pairs)
    assert ids(good) - kept <= {x for p in pairs for x in p}
    assert kept - ids(clean) == {r.doc_id for r in templates.contaminated(single, items).collect()}
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) for i in ids(clean)}
    total = sum(words.values())
    assert set(times) <= ids(clean) and max(times.values()) <= 2
    assert 1.4 * total < sum(words[i] * n for i, n in times.items()) <= 1.5 * total
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(tokens.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(times.elements())
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert all(r.n_tokens == len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1 for r in rows)


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None


EXTRA = ("size", "key", "cls", "rank", "score", "grp", "order", "tie", "root", "tokens", "body", "features", "_id", "_of", "_at", "_gone", "_body", "gone", "at", "of_id", "a.b")
ROWS = [(None, None, None, None, None), (None, "a null id " * 9, "en", "s", 1), (1, "", "en", None, 0), (2, "word", None, "s", 4), (3, "same text here for all of us", "en", "s", 2),
        (4, "same text here for all of us", "en", "t", 2), (4, "same text here for all of us", "en", "t", 2), (5, "long words " * 40000, "en", "hot", None)]


def test_stages_on_corner_rows(spark):
    """Nulls, repeated rows, empty and long texts, extra columns with clashing names, empty tables."""
    docs = spark.createDataFrame([(*r, *range(len(EXTRA))) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)).selectExpr("*", "map('k', n_chars) as m")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SF)
            rows = out.collect()
            if name != "token output":
                assert out.columns == docs.columns and len(rows) <= 2 * len(ROWS)
            else:
                assert len(rows) == given.count()
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert 3 in kept and 4 not in kept and kept.count(None) == 2


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    plain = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
    assert sorted(map(plain, df.select(*names).collect())) == sorted(map(plain, found.fetchall()))
