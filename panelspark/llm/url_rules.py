"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression; the literal tokens that any URL it matches must
hold follow from the expression itself. Spark counts those tokens over all URLs;
each rule is then filed under its rarest one. A URL's tokens fetch candidate rules, and only those run
their regular expression. No step shuffles URLs, so a hot host costs nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_batches, prepare

TOKEN = "[a-z0-9]+"
#: Rules go to every task, so no more than this are taken from a table.
MOST_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """name: shown in results. pattern: searched in the lower-cased URL, or for a site rule in host and path as they stand."""

    name: str
    action: str
    pattern: str
    site: bool = False

    @property
    def literals(self) -> tuple[str, ...]:
        """Lower-case tokens that each URL matched has as whole tokens; without any the rule is a candidate for every URL."""
        return forced_tokens(self.pattern)


def forced_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that whatever the pattern matches must have, whole: runs of its literal letters and digits with a literal other character on both sides.

    What is optional, repeated, alternative or of a class breaks a run, as do
    the ends of the pattern; `^`, `$` and classes without letters and digits
    bound it, as does what is optional but ends so. Tokens are lower-cased, as
    URLs are.
    """
    runs: list[str] = []
    now: list[str] = []  # empty: no run may start here; a first "": one may

    def stop(bounded: bool):
        if bounded and now:
            runs.append("".join(now))
        now.clear()
        if bounded:
            now.append("")

    def read(parts):
        for op, value in parts:
            if op is sre.LITERAL and re.fullmatch("[a-z0-9]", chr(value).lower()):
                if now:
                    now.append(chr(value).lower())
            elif op is sre.SUBPATTERN and not value[1] and not value[2]:
                read(value[3])
            elif op is sre.MAX_REPEAT and len(value[2]) and bounds(value[2][-1]):
                free = now == [""] or value[0] > 0
                stop(False)
                now.extend([""] if free else [])
            else:
                stop(bounds((op, value)))

    def bounds(part) -> bool:
        op, value = part
        if op is sre.SUBPATTERN:
            return len(value[3]) > 0 and bounds(value[3][-1])
        signs = value if op is sre.IN else [part]
        return op is sre.AT and value is not sre.AT_NON_BOUNDARY or all(o is sre.LITERAL and not re.fullmatch("[a-z0-9]", chr(v).lower()) for o, v in signs)

    read(_parser.parse(pattern))
    return tuple(dict.fromkeys(r for r in runs if r))


def site_rule(action: str, text: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the URL's path starts with the rule's path."""
    host, _, path = text.partition("/")
    return Rule(text, action, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", True)


#: The rules of the contract, then patterns that judge the rest of the web.
SITE_RULES = (
    site_rule("block", "com/en/"),
    site_rule("allow", "example.com/en/7"),
    site_rule("allow", "net/de/"),
    site_rule("block", "example.net/de/8"),
    site_rule("block", "org/es/"),
)
PAGE_RULES = (
    Rule("ads", "block", r"://ads\."),
    Rule("casino", "block", r"[./-]casino[./-]"),
    Rule("login", "block", r"/(wp-)?login\.(php|aspx)"),
    Rule("tracker", "block", r"[?&]redirect=https?%3a"),
    Rule("calendar", "block", r"/calendar/[0-9]{4}/[0-9]{2}/"),
)


def rules_of(table: DataFrame) -> tuple[tuple[Rule, ...], tuple[Rule, ...]]:
    """Site and page rules of a table (action, rule, site): `host/path` for site rules, a regular expression that names itself for the others.

    Rows without an action or a rule are left out, repeated ones count once; more than MOST_RULES are an error.
    """
    table = table.filter("action IS NOT NULL AND rule IS NOT NULL").select("action", "rule", F.coalesce("site", F.lit(False)).alias("site")).distinct()
    rows = table.orderBy("rule", "action", "site").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(site_rule(r["action"], r["rule"]) for r in rows if r["site"]), tuple(Rule(r["rule"], r["action"], r["rule"]) for r in rows if not r["site"])


def url_tokens(url: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def literal_counts(urls: DataFrame, url: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """URLs that hold each literal, over the whole table. The result has a row for a literal of the rules at most, and these are bounded."""
    wanted = sorted({x for rule in rules for x in rule.literals})
    if not wanted:
        return {}
    literals = urls.sparkSession.createDataFrame([(x,) for x in wanted], "token string")
    held = urls.select(F.explode(url_tokens(F.col(url))).alias("token")).join(F.broadcast(literals), "token")
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal; under the empty text those without one."""
    found: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.literals, key=lambda x: (counts.get(x, 0), x), default="")
        found.setdefault(rarest, []).append(rule)
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    site_rules: tuple[Rule, ...] = SITE_RULES,
    page_rules: tuple[Rule, ...] = PAGE_RULES,
) -> DataFrame:
    """Each row's kept columns with host, path, rule and verdict.

    The longest fitting site rule decides (block, where two are the same text);
    else any page rule that matches blocks; else the URL is allowed. A null URL or one without `://` has empty
    host and path, and the page rules judge its text (null: allow). Rows stay
    as they are, repeats included; an empty table gives an empty result; other
    columns do not matter, whatever their names.
    """
    spark = pages.sparkSession
    prepare(spark)
    rules = (*site_rules, *page_rules)
    filed = spark.sparkContext.broadcast(rule_index(rules, literal_counts(pages, url, rules)))
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def start():
        index, words = filed.value, re.compile(TOKEN)
        compiled: dict[Rule, re.Pattern] = {}
        always = index.get("", [])

        def fits(rule: Rule, text: str) -> bool:
            if rule not in compiled:
                compiled[rule] = re.compile(rule.pattern)
            return compiled[rule].search(text) is not None

        def judged(text: str | None) -> tuple[str, str, str | None, str]:
            host, path = split_url(text)
            whole = (text or "").lower()
            candidates = [*always, *(r for t in set(words.findall(whole)) for r in index.get(t, ()))]
            found = [r for r in candidates if fits(r, host + path if r.site else whole)]
            if sites := [r for r in found if r.site]:
                best = max(sites, key=lambda r: (len(r.name), r.name, r.action))
                return host, path, best.name, best.action
            return host, path, None, "block" if any(r.action == "block" for r in found) else "allow"

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [judged(x) for x in batch.column("_url").to_pylist()]
            columns = [batch.column(c) for c in keep] + [pa.array([x[i] for x in found], pa.string()) for i in range(4)]
            return pa.RecordBatch.from_arrays(columns, [*keep, "host", "path", "rule", "verdict"])

        return each

    rows = pages.select(*keep, F.col(url).alias("_url"))
    return map_batches(rows, start, f"{fields}, host string, path string, rule string, verdict string")
