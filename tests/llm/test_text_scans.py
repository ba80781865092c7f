"""Secret scans, URL filters and token counts against brute force."""

import math
import random
import re
import string
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelspark.llm import secrets, token_counts, url_rules

TEXTS = [
    None, "", " ", "a", "Token = 'abcdefghijkl' token=token=short secret: zzzzzzzzzzzz.yy", "AKIAABCDEFGHIJKLMN AKIA123",
    "deadbeefdeadbeef0 0123456789abcdef", "x" * 5000, "aZ9+kQ2/pL7mN4vB8cX1dF6gH3jK5 " * 40,
    "don't we'll I'D  two  spaces\n\n\ttab end ", "<|endoftext|>a<|endoftext|>", "naïve café—“quotes” 12345 ½ ① 漢字 🙂\x1c\x85x",
]


def entropy(s):
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def test_windows_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        run = "".join(rng.choice("ab1ZqX9+/k") for _ in range(rng.randrange(0, 70)))
        hot = {i for i in range(len(run) - 19) if entropy(run[i : i + 20]) >= 2.9 - 1e-10}
        covered = {k for i in hot for k in range(i, i + 20)}
        assert {k for a, b in secrets.hot_windows(run, 20, 2.9) for k in range(a, b)} == covered


def test_base_spans_equal_plain_patterns():
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for text in filter(None, TEXTS):
        want = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 12]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert secrets.base_spans(text) == want


def key(n, letters):
    """A fixed random key."""
    rng = random.Random(n)
    return "".join(rng.choice(letters) for _ in range(n))


BASE64 = string.ascii_letters + string.digits + "+/"


def test_allow_list_and_long_run():
    scan = secrets.EntropyScan(secrets.EntropyRules())
    assert scan.spans("key aZ9+kQ2/pL7mN4vB8cX1dF6gH3jK5 end") == [("entropy_base64", 4, 33)]
    assert not scan.spans("EXAMPLEaZ9+kQ2/pL7mN4vB8cX1dF6gH3jK5 " + "a" * 99 + " 123e4567-e89b-12d3-a456-426614174000 usr/local/share/applications/mimetypes")
    long = key(300, BASE64)
    for text in (long, "AAAAAAAA" + long, long + "/sample"):
        assert sum(b - a for _, a, b in scan.spans(text)) >= 270, text
    assert [k for k, _, _ in scan.spans(key(60, string.ascii_letters))] == ["entropy_letters"]


def brute_spans(text, rules):
    """Entropy spans by counting every window anew."""
    covered = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text):
        run = m[0]
        closed = {k for x in rules.allowed for y in re.finditer(x, run) for k in range(y.start() - rules.near, y.end() + rules.near)}
        digits = any(c in string.digits for c in run)
        if digits and not any(c in string.ascii_letters for c in run):
            continue
        for p in [re.match("(?s).*", run)] if digits else re.finditer("[A-Za-z]{20,}", run):
            text_ = p[0]
            kind = "letters" if text_.isalpha() else "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", text_) else "alnum" if text_.isalnum() else "base64"
            hot = [i for i in range(len(text_) - rules.window + 1) if entropy(text_[i : i + rules.window]) >= dict(rules.thresholds)[kind] - 1e-9]
            hot = [i for i in hot if not closed & set(range(p.start() + i, p.start() + i + rules.window))]
            spans = []
            for i in hot:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + rules.window
                else:
                    spans.append([i, i + rules.window])
            covered += [(f"entropy_{kind}", m.start() + p.start() + a, m.start() + p.start() + b) for a, b in spans if kind == "letters" or re.search("[0-9]", text_[a:b])]
    return covered


KEYS = {"hex": (string.digits + "abcdef", (32, 40, 64)), "alnum": (string.ascii_letters + string.digits, (24, 32, 40)), "base64": (BASE64, (40, 64, 88)), "letters": (string.ascii_letters, (32, 40, 64))}


def test_planted_keys_and_whole_rows(spark):
    """Keys of each class in the test documents: whole rows against brute force, recall of keys, spans elsewhere."""
    rng, rules = random.Random(9), secrets.EntropyRules()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(600).collect()]
    planted, given = [], []
    for i, text in enumerate(texts):
        kind = list(KEYS)[i % 4]
        secret = "".join(rng.choice(KEYS[kind][0]) for _ in range(rng.choice(KEYS[kind][1])))
        words = (text or "").split(" ")
        at = rng.randrange(len(words) + 1)
        before = " ".join([*words[:at], ""])
        planted.append((kind, len(before), len(before) + len(secret)))
        given.append(" ".join([before + secret, *words[at:]]))
    rows = {r.doc_id: r.spans for r in secrets.find_secrets(frame(spark, given)).collect()}
    caught, elsewhere = Counter(), 0
    for i, text in enumerate(given):
        want = brute_spans(text, rules)
        assert rows[i] == secrets.joined(secrets.base_spans(text) + want)
        kind, a, b = planted[i]
        caught[kind] += any(x < b and y > a for _, x, y in want)
        elsewhere += sum(y <= a or x >= b for _, x, y in want) - len([s for s in brute_spans(texts[i] or "", rules) if any(p[1] < s[2] and p[2] > s[1] for p in secrets.base_spans(texts[i] or ""))])
    print(dict(caught), "elsewhere, beside base spans:", elsewhere)
    assert all(caught[k] >= 0.97 * 150 for k in KEYS)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, spans string")


def test_secrets_rows(spark):
    rows = {r.doc_id: r for r in secrets.find_secrets(frame(spark, TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    assert rows[0].spans == "" and rows[0].base_sha256 == rows[1].base_sha256
    assert (rows[4].n_assign, rows[5].n_access, rows[6].n_hex) == (2, 1, 2)
    assert secrets.find_secrets(frame(spark, TEXTS).limit(0)).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_counts_equal_library(spark, name):
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = TEXTS + [r.text for r in docs.select("text").collect()]
    for r in token_counts.count_tokens(frame(spark, texts), path).collect():
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(tok.encode(text, add_special_tokens=False).ids)), text[:50]
        assert r.over_limit == (r.n_tokens > 1024)
    assert token_counts.count_tokens(frame(spark, texts).limit(0), path).collect() == []


def test_proven_tokens_are_single():
    path = public_tokenizers.path("byte_bpe_50k.json")
    proven, tok = token_counts.whole_tokens(path), Tokenizer.from_file(path)
    assert len(proven) > 40_000
    assert all(len(tok.encode(s, add_special_tokens=False).ids) == 1 for s in list(proven)[::37])


URLS = [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/en/", "", "", None, "allow"),
    ("http://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
    ("http://x.com/en/1", "x.com", "/en/1", "com/en/", "block"), ("http://x.com/EN/1", "x.com", "/EN/1", None, "allow"),
    ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://telecom/en/", "telecom", "/en/", None, "allow"), ("s://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    ("s://example.net/de/71", "example.net", "/de/71", "net/de/", "allow"), ("s://a.org?/es/", "a.org", "", None, "allow"),
    ("s://a.org/es/#", "a.org", "/es/", "org/es/", "block"), ("https://ads.x.de/1", "ads.x.de", "/1", None, "block"),
    ("https://x.de/wp-login.php", "x.de", "/wp-login.php", None, "block"), ("http://a\n.com/en/1", "a\n.com", "/en/1", "com/en/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    rows = url_rules.judge_urls(pages).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert tuple(r)[1:] == URLS[r.page_id][1:], URLS[r.page_id]
    assert url_rules.judge_urls(pages.limit(0)).collect() == []


@pytest.mark.parametrize(("pattern", "tokens"), [
    ("com/en/", ("en",)), (r"/en/7", ("en",)), (r"^(?:[^/]*\.)?example\.com/en/7", ("example", "com", "en")), (r"^(?:x)?com/", ()), (r"/(wp-)?login\.(php|aspx)", ("login",)),
    (r"[./-]casino[./-]", ("casino",)), (r"/a+b/", ()), (r"/a|b/", ()), (r"\bads\b", ("ads",)), (r"/x[a-z]/y.z/", ()), (r"/AB/", ("ab",)), (r"/(?:one/)+two/", ("two",)), (r"/(?:one)*/two$", ("two",)),
])
def test_forced_tokens(pattern, tokens):
    assert url_rules.forced_tokens(pattern) == tokens


def test_rules_of_a_table(spark):
    table = spark.createDataFrame([("block", "com/en/", True), ("block", "com/en/", True), ("allow", "x.com/en/", True), ("block", "/ads/", None), (None, "a", False)], "action string, rule string, site boolean")
    sites, others = url_rules.rules_of(table)
    assert [r.name for r in sites] == ["com/en/", "x.com/en/"] and [r.name for r in others] == ["/ads/"]
    urls = spark.createDataFrame([(1, "http://x.com/en/1"), (2, "http://y.com/en/"), (3, "http://y.de/ads/1"), (4, "http://y.de/bads/1")], "page_id long, url string")
    found = url_rules.judge_urls(urls, site_rules=sites, page_rules=others)
    assert {r.page_id: r.verdict for r in found.collect()} == {1: "allow", 2: "block", 3: "block", 4: "allow"}
    assert {r.verdict for r in url_rules.judge_urls(urls, site_rules=(), page_rules=()).collect()} == {"allow"}


def test_rules_filed_under_rarest_literal():
    rules = (url_rules.site_rule("block", "com/en/"), url_rules.site_rule("allow", "example.com/en/7"))
    index = url_rules.rule_index(rules, {"com": 5, "en": 9, "example": 3})
    assert {k: [r.name for r in v] for k, v in index.items()} == {"com": ["com/en/"], "example": ["example.com/en/7"]}


def test_token_shortcut_in_all_scripts():
    """Texts of all scripts have the library's counts, and none of assigned characters goes to it whole."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, known = token_counts.tokenizer(path), token_counts.agreed(path)
    counter = token_counts.Counter(path, token_counts.whole_tokens(path), known)
    rng, chars = random.Random(12), sorted(known)
    parts = ["αβγδε ζη", "где жить хорошо", "안녕 하세요 ", "今日は良い天気", "😀😁👍🏽 ok", "مرحبا ", "हिन्दी ", " \t\n　 ", "abc 123 '", "१२३ ①②", "é̂ x́ "]
    for _ in range(4_000):
        text = "".join(rng.choice(rng.choice(parts)) if rng.random() < 0.8 else rng.choice(chars) for _ in range(rng.randrange(30)))
        assert counter.count(text) == len(tok.encode(text, add_special_tokens=False).ids), repr(text)
    assert counter.whole == 0 and len(known) > 100_000
    for text in ("\U000e0fff", "a<|endoftext|>b", "xy"):
        assert counter.count(text) == len(tok.encode(text, add_special_tokens=False).ids)
    assert counter.whole == 3


@pytest.mark.parametrize(("alphabet", "kind"), [("0123456789ABCDEF", "hex"), ("0123456789abcdef", "hex"), (string.ascii_letters + string.digits, "alnum")])
@pytest.mark.parametrize("around", ["{}", "prod-{}", "svc_live_{}_eu", "/srv/app/keys/v2/{}", "https://host.org/en/blog/how-to-do-it/{}/edit"])
def test_keys_behind_prefixes_and_paths(alphabet, kind, around):
    """A key's class is that of its segment: prefixes and paths before it do not hide it. The class may be that of the whole run."""
    rng, scan, found = random.Random(4), secrets.EntropyScan(secrets.EntropyRules(segments=True)), 0
    for _ in range(500):
        text = around.format("".join(rng.choice(alphabet) for _ in range(32)))
        at = around.index("{}")
        spans = scan.spans(text)
        found += any(a < at + 32 and b > at and min(b, at + 32) - max(a, at) >= 20 for _, a, b in spans)
    assert found >= 498


def test_segments_add_to_whole_runs():
    """Spans of whole runs stay; those of segments, counted anew, come where no span of the run holds them."""
    rng, some = random.Random(5), secrets.EntropyScan(secrets.EntropyRules())
    more = secrets.EntropyScan(secrets.EntropyRules(segments=True))
    added = 0
    for _ in range(400):
        text = "".join(rng.choice(["-", "_", "/", " ", "xy", *("".join(rng.choice(rng.choice(["0123456789abcdef", BASE64])) for _ in range(26)) for _ in range(3))]) for _ in range(12))
        whole, found = some.spans(text), more.spans(text)
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text):
            mine = [s for s in whole if m.start() <= s[1] < m.end()]
            parts = [(x[0], m.start() + x.start()) for x in re.finditer("[A-Za-z0-9]{20,}", m[0])] if re.search("[-+/_=]", m[0]) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) else []
            parts = [(p, at) for p, at in parts if re.search("[0-9]", p) and re.search("[A-Za-z]", p)]
            new = [(k, a + at, b + at) for p, at in parts for k, a, b in brute_spans(p, secrets.EntropyRules())]
            want += mine + [s for s in new if not any(a <= s[1] and s[2] <= b for _, a, b in mine)]
        assert found == want
        added += len(found) - len(whole)
    assert added > 20


def test_paths_and_slugs_are_no_secrets():
    scan = secrets.EntropyScan(secrets.EntropyRules(segments=True))
    clean = [
        "/usr/lib/python3/dist-packages/numpy/core", "see https://blog.example.org/2024/05/how-to-train-your-dragon-in-10-easy-steps for more", "path/To/Some_Module/With_Parts_2/and-more",
        "org/apache/spark/sql/catalyst/expressions/codegen/v2", "en/7/jobs-in-berlin-and-hamburg-from-2023", "CONFIG_MAX_RETRY_COUNT_FOR_WORKER_12",
    ]
    assert [t for t in clean if scan.spans(t)] == []
    words = "about account archive blog career company contact data events forum gallery help image index info jobs legal login media news page post press product search service shop support terms user video".split()
    rng, wrong = random.Random(8), 0
    for _ in range(2_000):
        parts = [rng.choice(words) + rng.choice(["", "", "", str(rng.randrange(99))]) for _ in range(rng.randrange(5, 9))]
        wrong += bool(scan.spans("https://site.org/" + "".join(p + rng.choice("/-_") for p in parts)))
    assert wrong == 0
