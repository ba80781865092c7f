"""Template decontamination against brute force and on re-parameterised questions."""

import random
import re

import pytest

from panelspark.llm import templates

QUESTION = "A farmer named Tom has 12 apples and gives 5 apples to Anna before Tom walks 3 km home with 12 bags in the rain. How many are left?"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id int, window string")


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")


def hits(rows):
    return {(r.doc_id, r.item_id): r for r in rows.collect()}


def test_reparameterised_questions(spark):
    other = QUESTION.replace("Tom", "Ben").replace("Anna", "Eve").replace("12", "40").replace("5", "7").replace("km", "miles")
    mixed = other.replace("40 bags", "41 bags")  # 12 would be both 40 and 41
    texts = [f"some words before it. {t} and more words after" for t in (QUESTION, other, mixed)] + [None, "", QUESTION[:60], " word" * 60000 + " " + QUESTION]
    found = hits(templates.contaminated(docs_of(spark, texts), items_of(spark, [QUESTION, None, ""])))
    assert {k: r.exact for k, r in found.items()} == {(0, 0): True, (1, 0): False, (6, 0): True}


def test_one_edited_occurrence_leaves_the_other_windows(spark):
    edited = QUESTION.replace("12 bags", "13 bags")
    other = QUESTION.replace("5 apples", "7 apples").replace("Anna before Tom", "Anna before Ben")
    once = QUESTION + " The 12 bags of apples are heavy and he needs 12 hours to carry all of them to the cellar behind the house."
    texts = [f"some words before it. {t} and more words after" for t in (edited, other)] + [once.replace("12", "40").replace("40 hours", "41 hours")]
    found = hits(templates.contaminated(docs_of(spark, texts), items_of(spark, [QUESTION, once])))
    assert {(0, 0), (1, 0), (2, 0), (2, 1)} == set(found)
    assert not found[0, 0].exact and found[0, 0].matched == found[0, 0].n_windows - 5


def test_long_quotation_of_a_longer_item(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    quote, short = " ".join(words[20:80]), " ".join(words[20:45])
    broken = " ".join(w if i % 20 else "other" for i, w in enumerate(words))
    texts = [f"before that {quote} and after", f"before that {short} and after", f"x {broken} y"]
    found = hits(templates.contaminated(docs_of(spark, texts), items_of(spark, [" ".join(words)])))
    assert {k: r.matched for k, r in found.items() if k != (2, 0)} == {(0, 0): 56}
    assert templates.keep_clean(docs_of(spark, texts[:2]), items_of(spark, [" ".join(words)])).count() == 1


NAMES = "Tom Anna Ben Eve Carlos Mina Priya Otto Ruth Ivan Lucy Omar Greta Noah Zoe Felix".split()
THINGS = "apples pears books stamps coins pencils ribbons marbles tickets bottles buttons shells".split()
#: Sentences of word problems; names stand at their starts as well as inside, 0 to 3 are numbers, A and B names, X and Y things, U a unit.
SENTENCES = (
    "A buys 0 X at the market on the corner.", "B has 1 more X than A had before lunch.", "A then gives 2 of these X to B for the garden.",
    "Every day A walks 3 U to the school near the river.", "B puts 1 X in each of 2 old boxes.", "After that A sells 0 Y for a price of 3 each.",
    "While waiting, B counts 2 Y and loses 1 on the way home.", "Together A and B keep the Y in a drawer that holds 3 of them.",
)
ASKED = ("How many X does A have in the end?", "What is the number of Y that B still owns?", "How far does A walk in 2 weeks?", "Who has more X now, and by how many?")
NUMERALS = "two three four five six seven eight nine ten twelve twenty".split()


def problem(rng, sentences, things, words=False):
    a, b = rng.sample(NAMES, 2)
    numbers = [rng.choice(NUMERALS) if words and rng.random() < 0.5 else str(rng.randrange(2, 900)) for _ in range(4)]
    put = {"A": a, "B": b, "X": things[0], "Y": things[1], "U": rng.choice(["km", "miles", "meters"]), **{str(i): n for i, n in enumerate(numbers)}}
    return " ".join(re.sub(r"\b([ABXYU0-3])\b", lambda m: put[m[1]], x) for x in sentences)


def test_recall_on_reparameterised_items(spark):
    """240 items of three to five sentences; each document holds one with other names, numbers and units, or the item's sentences mixed up or reworded."""
    rng = random.Random(11)
    items, docs, want = [], [], set()
    seen = set()
    while len(items) < 240:
        sentences, things = [*rng.sample(SENTENCES, rng.randrange(3, 6)), rng.choice(ASKED)], rng.sample(THINGS, 2)
        if (key := (*sentences, *things)) in seen:
            continue
        seen.add(key)
        items.append((sentences, things))
    texts = [problem(rng, *x) for x in items]
    for i, (sentences, things) in enumerate(items):
        want.add((len(docs), i))
        docs.append(f"some filler here, then: {problem(rng, sentences, things, words=True)} and filler after it")
        docs.append(problem(rng, [sentences[0]], rng.sample(THINGS, 2)) + " A story goes on with other words than those, and no question is asked.")
    found = set(hits(templates.contaminated(docs_of(spark, docs), items_of(spark, texts))))
    # Items share sentences, so a document may hold most or a run of another item as well; false is what shares sentences of fewer words than 0.6 of it and than 24.
    filled = [{re.sub(r"\b[XY]\b", lambda m: things["XY".index(m[0])], x) for x in sentences} for sentences, things in items]
    size = lambda sentences: sum(len(x.split()) for x in sentences)
    shared = lambda d, i: size(filled[i] & filled[d // 2]) if d % 2 == 0 else 0
    recall, false = len(found & want) / len(want), [(d, i) for d, i in found if shared(d, i) < min(0.6 * size(filled[i]), 24)]
    print(f"recall {recall:.3f}, precision {1 - len(false) / len(found):.3f} of {len(found)}")
    assert recall >= 0.9 and len(false) <= 0.05 * len(found)


def test_hits_by_share_or_run_meet_by_their_rarest_windows(spark):
    """Common windows first: with and without the rarest windows' choice the same hits."""
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + k)}" for i in range(9) for k in range(9)]
    common = " ".join(words[:12])
    items = [f"{common} {' '.join(rng.choice(words) for _ in range(rng.randrange(3, 70)))}" for _ in range(30)]
    cut_of = lambda t: " ".join(w for w in t.split() if rng.random() > 0.04)
    docs = [common] * 20 + [cut_of(t) for t in items] + [" ".join(t.split()[5:50]) for t in items]
    plain = {}
    for d, doc in enumerate(docs):
        w = doc.split()
        held = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, item in enumerate(items):
            x = item.split()
            places = [k for k in range(len(x) - 4) if tuple(x[k : k + 5]) in held]
            run = first = last = 0
            for k in places:
                first = k if not run or k - last > 5 else first
                run, last = max(run, k - first + 5), k
            if len(places) >= 0.8 * (len(x) - 4) or run >= 30:
                plain[d, i] = len(places)
    found = {k: r.matched for k, r in hits(templates.contaminated(docs_of(spark, docs), items_of(spark, items))).items()}
    # A run is one along a diagonal, so the plain rule above may find a few more.
    assert found.keys() <= plain.keys() and all(plain[k] == n for k, n in found.items()) and len(plain) - len(found) <= 2


def test_item_inside_a_sentence_and_short_items(spark):
    items = ["Green apples fall from old trees", "only three words", "The one"]
    texts = ["we saw Green apples fall from old trees again", "there are only three words here", "only three", "words three only"]
    found = hits(templates.contaminated(docs_of(spark, texts), items_of(spark, items)))
    assert set(found) == {(0, 0), (1, 1)}


def test_join_by_shuffle_equals_broadcast(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    a = templates.contaminated(docs, items).collect()
    b = templates.contaminated(docs, items, templates.TemplateSettings(broadcast_windows=0)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_planted_passages_are_found_and_no_others(spark, sf):
    docs, items = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    windows = {r.item_id: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in items.collect() if (w := words(r.text))}
    want = set()
    for r in docs.collect():
        w = words(r.text)
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        want |= {(r.doc_id, i) for i, x in windows.items() if len(x & own) >= 0.8 * len(x)}
    assert set(hits(templates.contaminated(docs, items))) == want and want
    kept = {r.doc_id for r in templates.keep_clean(docs, items).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _ in want}


def test_corner_tables(spark):
    docs, items = docs_of(spark, [QUESTION, None]), items_of(spark, [QUESTION])
    assert templates.contaminated(docs.limit(0), items).collect() == []
    assert templates.contaminated(docs, items.limit(0)).collect() == []
    assert templates.keep_clean(docs, items.limit(0)).count() == 2
    twice = docs.unionByName(docs.selectExpr("cast(null as long) as doc_id", "text", "item_id", "window")).unionByName(docs)
    assert sorted((r.doc_id is None, r.item_id) for r in templates.contaminated(twice, items).collect()) == [(False, 0), (True, 0)]
    assert templates.keep_clean(twice, items).filter("text is not null").count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_items_are_ids_and_texts(spark, kind):
    """Two texts under one id, a null id, ids that are text: a copy of each is found and taken away."""
    texts = [" ".join(f"{w}{c}" for w in "alpha beta gamma delta omega kappa sigma theta lambda".split()) for c in "xyzq"]
    ids = [1, 1, None, 2] if kind == "long" else ["q-1", "q-1", None, "q 2"]
    items = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"item_id {kind}, text string")
    docs = spark.createDataFrame([(i, f"so {t} it goes") for i, t in enumerate(texts)] + [(9, "nothing of the sort stands in here at all")], "doc_id long, text string")
    found = templates.contaminated(docs, items)
    assert {(r.doc_id, r.item_id, r.exact) for r in found.collect()} == {(i, x, True) for i, x in enumerate(ids)}
    assert dict(found.dtypes)["item_id"] == ("bigint" if kind == "long" else "string")
    assert [r.doc_id for r in templates.keep_clean(docs, items).collect()] == [9]
    both = spark.createDataFrame([(5, f"{texts[0]} and {texts[1]}")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in templates.contaminated(both, items).collect()] == [(5, ids[0])]
