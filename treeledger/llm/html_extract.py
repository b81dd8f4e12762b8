"""HTML main text by union-free wrappers inferred per host.

A page is parsed, tolerantly, to a tree of block elements with text slots. Runs of alike siblings
(also of two or three taking turns) are folded to repeated groups. The trees of one host are then
aligned one after another: children that only one side has become optional, alike ones are
merged, and texts that differ become slots. What comes out is a union-free expression, a tree of
elements, optional and repeated groups, constants and slots: the host's wrapper. It carries for
each node how many pages and characters, and how many characters of links, it has taken in, and the texts that were the same
on all of these pages. (A row of children is the token stream of its level: opening and closing tokens always pair up in a parsed page, so
levels are aligned one by one.)

From the wrapper the rules of the host are read: which paths hold the article (article elements,
main elements, and the node that holds most unlinked text outside of both), and which paths in it
are menus, headers, footers, sidebars, notices, adverts, forms or reader comments. What class words say is only a prior: a node that
holds most of what the host has to say, in or around its articles, is no sidebar, whatever its words. Constants of ``CONSTANT_PAGES`` or
more pages belong to the template, so they are left out of an article that has slots as well. Every page of the
host is then read by these rules: by the first of the three in which it has text itself, so that hosts can mix
templates. Where a page has none of them, its own tree gives the rules.

Wrappers are folded in each batch of rows, then merged in two steps of groups (host and salt, then
host), so the pages of a hot host are spread and only small wrappers are shuffled. Rules are
broadcast only if they are small; else they are joined by host, which adaptive execution can
split.

Defined cases: null html has the empty text; a null url belongs to the empty host; a page without
an article has the empty text, n_chars 0; pages cut off anywhere are read as far as they go;
repeated rows stay repeated; an empty table gives an empty table; other columns are ignored.
Line breaks (br) are white space inside a block.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch
from treeledger.llm.url_filter import url_parts

#: Bytes of all rules together that may be broadcast.
BROADCAST_BYTES = 8_000_000
SALTS, PERIODS = 64, (1, 2, 3)
#: Paths and wrappers go so deep; what is nested deeper belongs to the element at that depth, but for what is aside.
DEEPEST = 60
#: Pages that a text has to be the same on, all that have its element, to be the template's; and the share of a host's text that no aside has.
CONSTANT_PAGES, MOST_ASIDE = 5, 0.7

# Elements by how they take part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math xmp noembed".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes, if it is open inside the nearest of the elements that hold it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
NO_PARAGRAPH = BLOCKS - {"button", "option", "optgroup", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body"}
# Elements, and words in class, id and role, that stand for what is not the article.
ASIDE_TAGS = frozenset("nav footer aside form button select menu dialog search fieldset head".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adbox sponsor sponsored promo promotion banner sidebar side aside menu navigation nav navbar topbar breadcrumb breadcrumbs masthead footer foot comment comments reply replies discussion disqus respond cookie cookies consent notice notices alert warning newsletter subscribe subscription signup login share sharing social related recommended recommendations popup modal overlay widget toolbar pagination pager search form tags legal copyright disclaimer contentinfo complementary".split()
)
MAIN_WORDS = frozenset("content article post entry story main text body articlebody postbody maincontent".split())
COMMENT_STARTS = ("comment", "repl", "discuss", "respons")
#: Words of class, id and role that a node keeps; those that rules ask for are kept beyond.
MOST_WORDS = 8
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody tr td th figure figcaption".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^>"'])*+[^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-label|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


@dataclass
class Node:
    """A block element of a page. ``items`` has its texts and elements in order."""

    tag: str
    words: tuple[str, ...] = ()
    items: list = field(default_factory=list)

    @property
    def key(self) -> str:
        return ".".join((self.tag, *self.words))


def attribute_words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes and "hidden" not in attributes:
        return ()
    found = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden":
            found.add("hidden")
        elif name != "aria-label":
            found.update(w.lower() for w in WORDS.findall(value))
    deciding = {w for w in found if decides(w)}
    rest = sorted(found - deciding)[: max(0, MOST_WORDS - len(deciding))]
    return tuple(sorted([*deciding, *rest]))


def decides(word: str) -> bool:
    """Whether rules ask for a word."""
    return word in ("hidden", "header") or word in MAIN_WORDS or word in ASIDE_WORDS or word.rstrip("s") in ASIDE_WORDS or word.startswith(COMMENT_STARTS)


class Text(str):
    """A piece of text in a block; ``linked`` characters of it are in links."""

    linked = 0


def parse(html: str | None) -> Node:
    """The tree of block elements of a page."""
    root = Node("#page")
    stack: list[Node] = [root]
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = depth_a = at = 0

    def flush() -> None:
        nonlocal linked
        said = Text(" ".join(entities.unescape("".join(text)).split()))
        if said:
            said.linked = min(linked, len(said))
            stack[-1].items.append(said)
        text.clear()
        linked = 0

    def close(names: frozenset[str] | set[str], holders: set[str]) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                opened.subtract(n.tag for n in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in holders:
                return

    html = html or ""
    end, last = len(html), html.rfind(">") + 1 if html else 0
    while at < end:
        m = TOKEN.search(html, at, last) if at < last else None
        said = html[at : m.start()] if m else html[at:]
        if said:
            text.append(said)
            if depth_a:
                linked += len(said.strip())
        if not m:
            break
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                depth_a = 0
            elif tag in BLOCKS and opened[tag]:
                flush()
                while True:
                    opened[last_tag := stack.pop().tag] -= 1
                    if last_tag == tag:
                        break
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag in ("script", "style", "textarea", "title"):
                stop = re.compile(f"</{tag}", re.I).search(html, at)
                at = end if not stop else (html.find(">", stop.end()) + 1 or end)
            continue
        if tag == "a":
            depth_a = 1
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        depth_a = 0
        if tag in CLOSES:
            close(CLOSES[tag], HOLDS[tag])
        if tag in NO_PARAGRAPH:
            close({"p"}, {"td", "th", "button", "li", "table", "article", "section", "div", "blockquote", "body"})
            if tag in HEADINGS:
                close(HEADINGS, {"td", "th", "li", "table", "article", "section", "div", "blockquote", "body"})
        if tag in ("article", "main", "body", "footer"):
            close({"nav"}, {"body"})
        if tag in VOID or tag in ("html", "head") and opened[tag]:
            continue
        if tag == "body":
            close({"head"}, {"html"})
        opened[tag] += 1
        node = Node(tag, attribute_words(m[3]))
        stack[-1].items.append(node)
        stack.append(node)
    flush()
    return root


# A wrapper node is [key, pages, characters, linked characters, children, text]; a child is [node, optional,
# repeated]; text is None, or says whether it is a slot (1) and then the hashes of what was the same on all pages. A
# repeated group of several has the key "(a|b)".


def text_hash(said: str) -> str:
    return f"{zlib.crc32(said.encode()):08x}{len(said):x}"


def wrapper_of(node: Node) -> list:
    """The wrapper of one page."""
    texts = [x for x in node.items if isinstance(x, Text)]
    children = [[wrapper_of(x), False, False] for x in node.items if isinstance(x, Node)]
    text = [0, *sorted(set(map(text_hash, texts)))] if texts else None
    return [node.key, 1, sum(map(len, texts)), sum(t.linked for t in texts), fold(children), text]


def fold(children: list) -> list:
    """Runs of alike children become repeated groups."""
    for period in PERIODS:
        out: list = []
        i = 0
        while i < len(children):
            keys = [c[0][0] for c in children[i : i + period]]
            n = 1
            while keys == [c[0][0] for c in children[i + n * period : i + (n + 1) * period]] and len(keys) == period:
                n += 1
            if n == 1:
                out.append(children[i])
                i += 1
                continue
            run = [children[i + k * period : i + (k + 1) * period] for k in range(n)]
            merged = run[0]
            for more in run[1:]:
                merged = [[merge(a[0], b[0], False), a[1] or b[1], a[2] or b[2]] for a, b in zip(merged, more, strict=True)]
            if period == 1:
                out.append([merged[0][0], merged[0][1], True])
            else:
                out.append([[f"({'|'.join(keys)})", 1, 0, 0, merged, None], False, True])
            i += n * period
        children = out
    return children


def fold_like(children: list, group: list) -> list:
    """Children with those in a row that a group of the other side has folded to that group."""
    keys = [c[0][0] for c in group[0][4]]
    for i in range(len(children) - len(keys) + 1):
        if [c[0][0] for c in children[i : i + len(keys)]] == keys:
            return [*children[:i], [[group[0][0], 1, 0, 0, children[i : i + len(keys)], None], False, True], *children[i + len(keys) :]]
    return children


def merge(a: list, b: list, pages: bool = True) -> list:
    """The wrapper of all that two wrappers of one key have taken in."""
    left, right = a[4], b[4]
    for x in [c for c in right if c[0][0][0] == "(" and c[0][0] not in {d[0][0] for d in left}]:
        left = fold_like(left, x)
    for x in [c for c in left if c[0][0][0] == "(" and c[0][0] not in {d[0][0] for d in right}]:
        right = fold_like(right, x)
    text = a[5] if a[5] == b[5] else merged_text(a[5] or [1], b[5] or [1], pages)
    return [a[0], a[1] + b[1] if pages else max(a[1], b[1]), a[2] + b[2], a[3] + b[3], align(left, right, pages), text]


def merged_text(a: list, b: list, pages: bool) -> list:
    """A slot, with what both pages have; or, of alike siblings on one page, with what any has."""
    return [1, *(sorted(set(a[1:]) & set(b[1:])) if pages else sorted({*a[1:], *b[1:]}))]


def align(left: list, right: list, pages: bool) -> list:
    """Children aligned by their longest common row of keys; what has no partner is optional."""
    a, b = [c[0][0] for c in left], [c[0][0] for c in right]
    both = lambda x, y: [merge(x[0], y[0], pages), x[1] or y[1], x[2] or y[2]]
    if a == b:
        return list(map(both, left, right))
    # A longest common row can always begin and end with what both have there.
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(a[head:][::-1], b[head:][::-1], strict=False)) if x != y), min(len(a), len(b)) - head)
    front = list(map(both, left[:head], right[:head]))
    back = list(map(both, left[len(left) - tail :], right[len(right) - tail :]))
    left, right = left[head : len(left) - tail], right[head : len(right) - tail]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(both(left[i], right[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([left[i][0], True, left[i][2]])
            i += 1
        else:
            out.append([right[j][0], True, right[j][2]])
            j += 1
    return fold([*front, *out, *back])


def expression(wrapper: list, optional: bool = False, repeated: bool = False) -> str:
    """The wrapper as a union-free regular expression."""
    key = wrapper[0]
    inner = "".join(([] if wrapper[5] is None else ["#text" if wrapper[5][0] else "#const"]) + [expression(*c) for c in wrapper[4]])
    said = inner if key[0] == "(" else f"<{key}>{inner}</>"
    return f"({said}){'+' if repeated else ''}{'?' if optional else ''}" if optional or repeated else said


def is_aside(key: str) -> bool:
    """Whether a key speaks for something that is never part of an article."""
    tag = key.split(".")[0]
    return tag in ASIDE_TAGS or never(key) or has_aside_words(key) and tag not in ("html", "body", "#page", "article", "main")


def has_aside_words(key: str) -> bool:
    return any(w in ASIDE_WORDS or w.rstrip("s") in ASIDE_WORDS for w in key.split(".")[1:])


def never(key: str) -> bool:
    """Whether a key stands for what no amount of text makes an article: what is hidden, and reader comments."""
    return any(w == "hidden" or w.startswith(COMMENT_STARTS) for w in key.split(".")[1:])


def has_article(node: list) -> bool:
    return any(c[0][0].split(".")[0] in ("article", "main") or has_article(c[0]) for c in node[4])


def rules_of(wrapper: list) -> dict:
    """Paths of the article, paths inside it that aren't part of it, and constants of paths.

    ``main`` has all article paths, then all main paths, if there are any. ``container`` is the path that holds the
    most of what is outside of both; ``mass`` is the number of unlinked characters outside of what is aside.
    """
    nodes: list[tuple[str, list, bool]] = []

    def said(node: list) -> int:
        """Unlinked characters below a node, but for what its element alone puts aside."""
        if node[0].split(".")[0] in ASIDE_TAGS or never(node[0]):
            return 0
        return node[2] - node[3] + sum(said(c[0]) for c in node[4])

    all_said = said(wrapper)

    def put_aside(node: list, in_article: bool) -> bool:
        key = node[0]
        tag, *words = key.split(".")
        if tag in ASIDE_TAGS or never(key):
            return True
        if not (is_aside(key) or not in_article and (tag == "header" or "header" in words)):
            return False
        around = in_article or bool(MAIN_WORDS & set(words)) or has_article(node)
        return not (around and said(node) >= MOST_ASIDE * all_said > 0)

    def walk(node: list, path: str, aside: bool, in_article: bool) -> tuple[int, int]:
        """Unlinked characters below a node outside of what is aside; and those that are in no article or main element either."""
        key = node[0]
        if key[0] != "(":
            path = f"{path}/{key}"
            aside = aside or put_aside(node, in_article)
            in_article = in_article or key.split(".")[0] in ("article", "main")
        at = len(nodes)
        nodes.append((path, node, aside))
        mass = 0 if aside else node[2] - node[3]
        rest = 0 if in_article else mass
        for c in node[4]:
            below = walk(c[0], path, aside, in_article)
            mass, rest = mass + below[0], rest + below[1]
        masses[at], rests[at] = mass, rest
        return mass, rest

    masses: dict[int, int] = {}
    rests: dict[int, int] = {}
    walk(wrapper, "", False, False)
    real = [(i, *n) for i, n in enumerate(nodes) if n[1][0][0] != "("]

    def named(tag: str) -> list[str]:
        return sorted({path for i, path, node, aside in real if not aside and node[0].split(".")[0] == tag and masses[i] > 0})

    container = None
    marked = [(rests[i], path) for i, path, node, aside in real if not aside and rests[i] > 0 and MAIN_WORDS & set(node[0].split(".")[1:])]
    total = rests[0]
    if marked and max(marked)[0] >= 0.3 * total:
        container = max(marked, key=lambda x: (x[0], len(x[1])))[1]
    elif total > 0:  # the deepest node with most of the text that isn't itself a part of a text
        container = max((len(path), path) for i, path, node, aside in real if not aside and rests[i] >= 0.7 * total and node[0].split(".")[0] not in PARTS)[1]
    main = [paths for paths in (named("article"), named("main")) if paths]
    drop = [path for _, path, _, aside in real if aside]
    constant: dict[str, list[str]] = {}
    for _, path, node, aside in real:
        if not aside and node[1] >= CONSTANT_PAGES and node[5] and len(node[5]) > 1:
            constant.setdefault(path, []).extend(node[5][1:])
    return {"main": main, "container": container, "drop": sorted(set(drop)), "mass": masses[0], "constant": constant}


def read(page: Node, main: list[str], drop: list[str], constant: dict[str, list[str]]) -> str:
    """The text below some paths of a page: its blocks joined by line breaks. Where all of it is constant, it is the text."""
    inner, outer = set(main), set(drop)
    out: list[str] = []
    fixed: list[bool] = []
    stack = [(page, "", False)]
    while stack:  # what is still to be read
        item, path, inside = stack.pop()
        if isinstance(item, Text):
            if inside:
                out.append(item)
                fixed.append(path in constant and text_hash(item) in constant[path])
            continue
        path = f"{path}/{item.key}"
        if path in outer:
            continue
        inside = inside or path in inner
        stack.extend((x, path, inside) for x in reversed(item.items))
    return "\n".join(out if all(fixed) else [x for x, f in zip(out, fixed, strict=True) if not f])


def extract(html: str | None, rules: dict) -> str:
    """The text of a page by the rules of its host, or by its own where it has no text in any path that they name."""
    page = shallow(parse(html))
    for paths in rules["main"]:
        if text := read(page, paths, rules["drop"], rules["constant"]):
            return text
    text = read(page, [rules["container"]], rules["drop"], rules["constant"]) if rules["container"] else ""
    if text and not rules["main"]:
        return text
    own = rules_of(wrapper_of(page))
    # Of a host with articles, the container may be what stands beside them; it counts where it has much of the page.
    if text and len(text) >= 0.3 * own["mass"]:
        return text
    for paths in [*own["main"], *([[own["container"]]] if own["container"] else [])]:
        if text := read(page, paths, own["drop"], {}):
            return text
    return ""


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper: the wrapper of each host as JSON, from url and html."""
    host, _ = url_parts(F.col("url"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            got: dict[str, list] = {}
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = wrapper_of(shallow(parse(html)))
                got[h] = merge(got[h], page) if h in got else page
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([json.dumps(w) for w in got.values()], pa.string())], ["host", "wrapper"])

    def merged(table: pa.Table) -> pa.Table:
        found = sorted(table.column("wrapper").to_pylist())
        out = json.loads(found[0])
        for more in found[1:]:
            out = merge(out, json.loads(more))
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([json.dumps(out)], pa.string())})

    parts = pages.select(host.alias("host"), "html").mapInArrow(batches, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    first = salted.groupBy("host", "salt").applyInArrow(lambda t: merged(t.select(["host", "wrapper"])), "host string, wrapper string")
    return first.groupBy("host").applyInArrow(merged, "host string, wrapper string")


def shallow(node: Node, depth: int = 0) -> Node:
    """The tree with what is nested deeper than ``DEEPEST`` lifted to that depth, so that wrappers can be merged by recursion.

    What is aside there stays an element, so that its text is not taken in.
    """
    if depth < DEEPEST:
        return Node(node.tag, node.words, [x if isinstance(x, Text) else shallow(x, depth + 1) for x in node.items])
    top = Node(node.tag, node.words)
    stack = [(x, top) for x in reversed(node.items)]
    while stack:
        x, under = stack.pop()
        if isinstance(x, Text):
            under.items.append(x)
            continue
        if under is top and (is_aside(x.key) or x.tag == "header"):
            under = Node(x.tag, x.words)
            top.items.append(under)
        stack.extend((y, under) for y in reversed(x.items))
    return top


def extract_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    scratch = Scratch(pages.sparkSession, "html-extract")

    def rule_rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rules = [json.dumps(rules_of(json.loads(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, pa.string())], ["host", "rules"])

    rules = scratch.keep(infer(pages).mapInArrow(rule_rows, "host string, rules string"))
    total = rules.agg(F.sum(F.octet_length("host") + F.octet_length("rules"))).first()[0] or 0
    host, _ = url_parts(F.col("url"))
    keyed = pages.select("page_id", "url", "html", host.alias("host"))
    joined = keyed.join(F.broadcast(rules) if total <= BROADCAST_BYTES else rules, "host").select("page_id", "url", "html", "rules")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in found:
            texts = []
            for html, said in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if len(known) > 5000:
                    known.clear()
                if said not in known:
                    known[said] = json.loads(said)
                texts.append(extract(html, known[said]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
