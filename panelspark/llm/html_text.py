"""HTML extraction: main text of pages, with site templates removed.

A page is parsed to a tree of elements; each container's subtree is hashed over
its tags and text, and, as a slot, over its place and its tags alone where it
is the only one of its kind, holds links or little text, and is no part of the
page's main text. Spark counts, per host, on how many different pages a hash
occurs; subtrees that recur across many pages of the host, and slots of most of
them whatever their text, are its template and are deleted, as are elements
that are boilerplate by tag, role or class. What is left of the article gives
the text, block by block.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut, map_batches, prepare

#: Fixed values of HTML: elements without end tags, with raw text, and those that break the flow of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An open element of the first kind ends where a tag of the second kind starts.
ENDS = {
    "p": BLOCK - frozenset("body caption head html tbody td tfoot th thead title tr legend option".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "head": frozenset(["body"]),
}
#: The open elements that a tag ends.
ENDED_BY = {tag: [inner for inner, tags in ENDS.items() if tag in tags] for tag in BLOCK}
#: A tag that ends others looks no further up than these.
SCOPE = frozenset("article aside blockquote body button dd div dl fieldset figure footer form header li main menu nav ol section table td th ul".split())

#: Boilerplate by tag, by ARIA role, and by a word of class or id.
DROP_TAGS = frozenset("nav footer aside form button select script style noscript iframe template svg canvas object title head textarea menu dialog".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer notice notices cookie cookies consent gdpr newsletter subscribe subscription social share sharing related recommended "
    "comment comments disqus respond replies popup modal overlay masthead skip toolbar widget".split()
)
#: A compound counts as a drop word if its other words are of the first kind (share-buttons, not share-price). Beside one of
#: the second kind it says nothing (has-sidebar); beside one of the third (page-widget) it may name what stands around the page.
PLAIN = frozenset(
    "area bar bars block blocks bottom box boxes button buttons center code col column container entry footer form global group header "
    "holder icon icons id inner item items large left link links list main media mobile module news panel post posts primary right row secondary section "
    "site small social stories story sub text thread title top unit view wrap article articles s x"
    .split()
)
MODIFIERS = frozenset("has with no not without hide".split())
AROUND = frozenset("page layout wrapper free content".split())
#: Why an element is dropped. A form or a name of the page's surroundings is weak: not where the page's parts stand in it. Class and id are stronger.
WEAK, NAMED, ALWAYS = 1, 2, 3
LANDMARKS = frozenset("nav aside footer h1".split())
#: Containers that can be template; the article itself and its text blocks cannot.
TEMPLATE_TAGS = frozenset("div section header footer nav aside ul ol dl table form figure menu fieldset details center".split())
ARTICLE = "article", "main"
#: What can hold the main text of a page.
HOLDERS = TEMPLATE_TAGS | frozenset(["article", "main", "body", "td", "html"])

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL
)
#: The same without quotes, for what follows so many tags whose quotes never end: each of these was read to the page's end.
LOOSE_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.DOTALL)
UNENDED = 100
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


#: Template hashes of 8 bytes, with some 32 bytes a host, up to so many of 8 bytes are broadcast.
BROADCAST_TEMPLATES = 1_000_000


@dataclass(frozen=True)
class Templates:
    """A subtree is template where n different pages of the host have it: `pages` at least, and n * n >= pages * share * (the host's pages).

    Up to pages / share pages (40), `pages` are enough; beyond, the number asked
    for grows with the root of the host's pages, so that what stands in one
    section of a large host, or in turn with others, is template as well. A
    slot is so with `slot_share` of the host's pages besides, if it is mostly
    links, or has no more text than `short`; beside the page's h1 and main text
    it must have few texts as well, as many pages as `pages` for each. lists: whether tags, roles,
    classes and ids drop elements too.
    """

    pages: int = 8
    share: float = 0.2
    slot_share: float = 0.5
    short: int = 300
    lists: bool = True


class Element:
    """up: what it stands in. drop: why it is dropped, 0 if it is not. start: the article or main around it. parts: what its hash is made of.

    zone: the least element that has the page's h1 and its main text. name: tag and classes. kinds: its children's forms. chars, links: its text and the part in links. headed: has an h1.
    """

    __slots__ = ("tag", "drop", "article", "start", "in_main", "parts", "hash", "up", "name", "kinds", "form", "chars", "links", "headed", "zone")

    def __init__(self, tag: str, attributes: str, up: Element | None):
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        role = found.get("role", "")
        article = tag in ARTICLE or role in ARTICLE
        if tag in DROP_TAGS and tag != "form" or role in DROP_ROLES or tag == "header" and not (up and up.article):
            self.drop = ALWAYS
        else:
            named = 0 if not found or article or tag in ("html", "body") else named_by(f"{found.get('class', '')} {found.get('id', '')}")
            self.drop = max(named, WEAK if tag == "form" else 0)
        self.tag, self.up, self.parts, self.hash = tag, up, [f"<{tag} {found.get('class', '')}>"], None
        self.start = self if article else up.start if up else None
        self.article = ("article" if "article" in (tag, role) else "main") if article else up.article if up else ""
        self.in_main = "main" in (tag, role) or bool(up and up.in_main)
        self.name = f"{tag} {NUMBERS.sub('', found.get('class', ''))}" if found else tag
        self.kinds, self.form, self.chars, self.links, self.headed, self.zone = set(), 0, 0, 0, tag == "h1", False


NUMBERS = re.compile("[0-9]+")


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def named_by(names: str) -> int:
    """How strongly class and id name boilerplate: by a drop word, as a token or in a compound of plain words."""
    found = 0
    for name in names.split():
        words = set(re.findall(r"[a-z]+", name))
        if words & DROP_WORDS and not words & MODIFIERS:
            rest = words - DROP_WORDS - PLAIN
            if not rest:
                found = NAMED
            elif rest <= AROUND:
                found = max(found, WEAK)
    return found


def parse(text: str) -> tuple[list[tuple[str, Element]], list[Element]]:
    """Blocks of text with the element that each stands in, and all elements in the order of their ends, hashed. Time is linear, however broken the page."""
    root = Element("html", "", None)
    open_, blocks, done_, words = [root], [], [], []
    #: Depths of the open elements by tag, of those that bound a tag's reach, and of articles.
    depths: dict[str, list[int]] = defaultdict(list)
    bounds, articles = [0], [0]
    at, n, last, unended, linked = 0, len(text), text.rfind(">"), 0, 0

    def flush():
        nonlocal linked
        if words:
            block = " ".join("".join(words).split())
            words.clear()
            if block:
                into = open_[-1]
                blocks.append((block, into))
                into.parts.append(block)
                into.chars += len(block)
                into.links += min(linked, len(block))
        linked = 0

    def close(depth: int):
        while len(open_) > depth:
            if open_[-1].tag in BLOCK:
                flush()
            done = open_.pop()
            at = len(open_)
            if at:
                depths[done.tag].pop()
            for held in (bounds, articles):
                if len(held) > 1 and held[-1] == at:
                    held.pop()
            done_.append(done)
            if done.tag in BLOCK or len(done.parts) > 1:
                done.hash = hash64("\n".join(done.parts))
            if open_:
                up = open_[-1]
                if done.hash is not None:
                    up.parts.append(str(done.hash))
                up.chars, up.links, up.headed = up.chars + done.chars, up.links + done.links, up.headed or done.headed
                if done.tag in BLOCK or done.tag == "a":
                    done.form = hash64(f"{done.name} {sorted(done.kinds)}")
                    up.kinds.add(done.form)
                else:  # the smaller set goes into the larger one
                    few, up.kinds = sorted((up.kinds, done.kinds), key=len)
                    up.kinds |= few

    def say(raw: str):
        nonlocal linked
        raw = html.unescape(raw) if "&" in raw else raw
        words.append(raw)
        if depths["a"]:
            linked += len(raw)

    while at < n:
        mark = text.find("<", at)
        if mark < 0 or mark > last and not text.startswith(("<!--", "<![CDATA["), mark):
            say(text[at:])
            break
        if mark > at:
            say(text[at:mark])
        m = (TAG if unended < UNENDED else LOOSE_TAG).match(text, mark)
        if not m:
            unended += text[mark + 1 : mark + 2].isalpha()
            say("<")
            at = mark + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                words.append(" ")
                continue
            depth = depths[tag][-1] if depths[tag] else 0
            if depth and (depth >= articles[-1] or tag in SCOPE or tag in ("body", "html", *ARTICLE)):
                if tag in BLOCK:
                    flush()
                close(depth)
            elif not depth and tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            depth = max((depths[inner][-1] for inner in ENDED_BY[tag] if depths[inner]), default=0)
            if depth > bounds[-1]:
                close(depth)
        if tag == "br":
            words.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW_ENDS[tag].search(text, at)
            at = end.end() if end else n
            continue
        if tag in ("html", "body") and depths[tag]:
            continue
        depth = len(open_)
        open_.append(Element(tag, m[3], open_[-1]))
        depths[tag].append(depth)
        if tag in SCOPE and tag not in ENDS:
            bounds.append(depth)
        if tag in ARTICLE:
            articles.append(depth)
    flush()
    close(0)
    return blocks, done_


RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}


def along(step: Callable[[int, Element], int]) -> Callable[[Element], int]:
    """step folded over all that an element stands in, from the root to itself; each element is visited once, however deep."""
    known: dict[Element | None, int] = {None: 0}

    def value(e: Element) -> int:
        line = []
        while e not in known:
            line.append(e)
            e = e.up
        at = known[e]
        for x in reversed(line):
            at = known[x] = step(at, x)
        return at

    return value


def kept(blocks: list[tuple[str, Element]], soft: int) -> list[tuple[str, Element]]:
    """Blocks outside of dropped elements. Reasons up to `soft` do not count for what stands around an article or main that has text, nor for what holds an h1; weak ones do not around landmarks."""
    worst = along(lambda at, x: max(at, x.drop))
    inner = along(lambda at, x: x.drop if x.start is x else max(at, x.drop))  # within the article
    held: set[Element] = set()
    page: set[Element] = set()
    seen: set[Element] = set()

    def hold(e: Element | None, into: set[Element]):
        while e and e not in into:
            into.add(e)
            e = e.up

    for _, e in blocks:
        x = e
        while x and x not in seen:
            seen.add(x)
            if x.tag in LANDMARKS:
                hold(x.up, page)
            if x.tag == "h1":
                hold(x.up, held)
            x = x.up
        if e.article and worst(e) <= soft and not inner(e):
            hold(e.start.up, held)
    out = along(lambda at, x: at or int(x.drop > 0 and not (x.drop <= soft and x in held or x.drop == WEAK and x in page)))
    return [(b, e) for b, e in blocks if not out(e)]


def chosen(blocks: list[tuple[str, Element]]) -> list[str]:
    """Text of the article, else of main, else of the page, among the blocks that are not dropped.

    What stands under a comment's or side box's name counts where no other text
    is left, or where it has the page's h1. All of main is taken where it has
    more text outside of its articles than in them, and no h1 in these: they
    are teasers. Where nothing is left, weak reasons do not count.
    """
    left = kept(blocks, WEAK)
    if not any(e.article == "article" for _, e in left):
        under = kept(blocks, NAMED)
        under = [(b, e) for b, e in under if e.article] or (under if headed(under) else [])
        if under and (not left or (headed(under) and not headed(left))):
            left = under
    if not left:
        worst = along(lambda at, x: max(at, x.drop))
        left = [(b, e) for b, e in blocks if worst(e) <= WEAK]
    inside = [(b, e) for b, e in left if e.article == "article"]
    own = sum(len(b) for b, e in left if e.article == "main")
    if own > sum(len(b) for b, _ in inside) and all(e.in_main for _, e in inside) and not headed(inside):
        return [b for b, e in left if e.in_main]
    wanted = next((a for a in ARTICLE if any(e.article == a for _, e in left)), None)
    return [b for b, e in left if wanted is None or e.article == wanted]


def headed(blocks: list[tuple[str, Element]]) -> bool:
    """Whether an h1 is among the blocks."""
    in_h1 = along(lambda at, x: int(x.tag == "h1" or (at and x.tag not in BLOCK)))
    return any(in_h1(e) for _, e in blocks)


def slots(elements: list[Element], short: int) -> dict[int, Element]:
    """Elements that their place and form on the page name alone, by a hash of these: with links for the most part, or with little text and no part of the main text.

    The main text is in articles and in the least element that holds half of the
    page's text; what stands around it is no slot, nor is what has an h1.
    """
    own = lambda e: e.chars - e.links
    main = next((e for e in elements if e.tag in HOLDERS and 2 * own(e) >= own(elements[-1])), elements[-1])
    around, up = set(), main
    while up:
        around.add(up)
        up = up.up
    zone = next((e for e in elements if e.tag == "h1" and e.chars), elements[-1])
    while zone.up and zone not in around:
        zone = zone.up
    zone.zone = True
    inside = along(lambda at, x: int(at or x.start is x or (x is main and x.tag not in ("body", "html"))))
    place = along(lambda at, x: hash64(f"{at} {x.name}"))
    named = [(f"{place(e)} {e.form}", e) for e in elements if e.tag in TEMPLATE_TAGS]
    alone = Counter(name for name, _ in named)
    found = {}
    for name, e in named:
        if e.chars and not e.headed and e not in around and alone[name] == 1:
            if 2 * e.links >= e.chars:
                found[hash64(f"links {name}")] = e
            elif e.chars <= short and not inside(e):
                found[hash64(f"short {name}")] = e
    return found


def main_blocks(text: str, template: frozenset[int] = frozenset(), rule: Templates = Templates()) -> list[str]:
    """Text blocks of the article (else of main, else of the page) outside of boilerplate and template subtrees. Slots do not count where nothing else is left."""
    blocks, elements = parse(text)
    slot = {e for key, e in slots(elements, rule.short).items() if key in template}
    for e in elements:
        if e.tag in TEMPLATE_TAGS and e.hash in template:
            e.drop = ALWAYS
        elif not rule.lists:
            e.drop = 0
    before = {e: e.drop for e in slot}
    for e in slot:
        e.drop = ALWAYS
    found = chosen(blocks)
    if not found and slot:
        for e, drop in before.items():
            e.drop = drop
        found = chosen(blocks)
    return found


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def said_in(blocks: list[tuple[str, Element]], slot: dict[int, Element]) -> dict[int, int]:
    """What the text of each slot hashes to; 0 for those that are mostly links, and for those outside of the least element that has the page's h1 and its main text.

    On a page without h1 every slot's text counts.
    """
    zone = along(lambda at, x: int(at or x.zone))
    texts: dict[Element, list[str]] = {e: [] for e in slot.values() if 2 * e.links < e.chars and zone(e)}
    for text, e in blocks:
        up = e
        while up:
            if up in texts:
                texts[up].append(text)
            up = up.up
    return {key: hash64("\n".join(texts[e])) if e in texts else 0 for key, e in slot.items()}


def subtree_hashes(pages: DataFrame, rule: Templates, url: str, page: str) -> DataFrame:
    """Rows (host, body, hashes, slots, said): for each page what its text hashes to, its containers' and slots' distinct hashes, and what each slot's text hashes to."""

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            bodies, hashes, held, said = [], [], [], []
            for value in batch.column(1):
                blocks, elements = parse(value.as_py() or "")
                hashes.append(sorted({e.hash for e in elements if e.tag in TEMPLATE_TAGS and len(e.parts) > 1}))
                slot = said_in(blocks, slots(elements, rule.short))
                held.append(sorted(slot))
                said.append([slot[key] for key in held[-1]])
                body = chosen(blocks) or [b for b, _ in blocks]
                bodies.append(hash64("\n".join(body)))
            columns = [batch.column(0), pa.array(bodies, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (hashes, held, said))]
            return pa.RecordBatch.from_arrays(columns, ["host", "body", "hashes", "slots", "said"])

        return each

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page"))
    return map_batches(rows, start, "host string, body long, hashes array<long>, slots array<long>, said array<long>")


def site_templates(pages: DataFrame, rule: Templates = Templates(), url: str = "url", page: str = "html") -> DataFrame:
    """Rows (host, template): the hashes that recur on the host. Pages with the same article count once, so copies make no template.

    A page has few containers, and a template stands on at least the root of
    pages * share * the host's pages, so a host has no more templates than a page
    has containers, times the root of its pages over that of pages * share.
    """
    seen = cut(subtree_hashes(pages, rule, url, page))
    sizes = seen.select("host", "body").distinct().groupBy("host").count()
    none = F.lit(0).cast("long").alias("said")
    trees = F.transform("hashes", lambda x: F.struct(x.alias("hash"), F.lit(False).alias("slot"), none))
    held = F.transform(F.arrays_zip("slots", "said"), lambda x: F.struct(x["slots"].alias("hash"), F.lit(True).alias("slot"), x["said"].alias("said")))
    each = seen.select("host", "body", F.inline(F.concat(trees, held))).groupBy("host", "hash", "slot", "body").agg(F.max("said").alias("said"))
    texts = each.groupBy("host", "hash", "slot", "said").agg(F.count(F.lit(1)).alias("n"))
    counts = texts.groupBy("host", "hash", "slot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    often = counts.filter(F.col("n") >= rule.pages).join(sizes.filter(F.col("count") >= rule.pages), "host")
    many = (F.col("n") * F.col("n") >= rule.pages * rule.share * F.col("count")) & (~F.col("slot") | (F.col("n") >= rule.slot_share * F.col("count")) & (F.col("texts") * rule.pages <= F.col("n")))
    return often.filter(many).groupBy("host").agg(F.sort_array(F.collect_set("hash")).alias("template"))


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), rule: Templates = Templates(), url: str = "url", page: str = "html") -> DataFrame:
    """Each row's kept columns with text (blocks joined by two newlines; empty if there is none) and n_chars, its code points.

    A null page counts as empty; a null URL, or one without a host, shares the
    empty host. Whole pages are parsed, however long or broken; repeated rows
    stay; an empty table gives an empty result; other columns do not matter.
    Templates are broadcast while they are few; beyond, pages are shuffled by
    host, where Spark splits a hot one.
    """
    prepare(pages.sparkSession)
    templates = cut(site_templates(pages, rule, url, page)).withColumnRenamed("host", "of_host")
    few = templates.agg(F.coalesce(F.sum(F.size("template") + 4), F.lit(0))).first()[0] <= BROADCAST_TEMPLATES
    rows = pages.select(*[F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)], F.col(page).alias("page"), host_of(F.col(url)).alias("host"))
    rows = rows.join(F.broadcast(templates) if few else templates, F.col("host") == F.col("of_host"), "left")
    rows = rows.select(*[F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)], F.col("page").alias("html_"), F.col("template").alias("template_"))
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = len(keep)
            texts = ["\n\n".join(main_blocks(p.as_py() or "", frozenset(t.as_py() or ()), rule)) for p, t in zip(batch.column(at), batch.column(at + 1), strict=True)]
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_chars"])

        return each

    return map_batches(rows, start, f"{fields}, text string, n_chars long")
