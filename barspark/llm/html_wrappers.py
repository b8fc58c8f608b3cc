"""HTML extraction by inferred wrappers: union-free regular expressions over a host's tag streams.

Every page is read as a stream of tags and texts. The streams of a host are aligned one after the
other: equal tags match; a tag that only one side has becomes optional; adjacent equal siblings
become one repeated group; a sibling list that stays too varied becomes a repeated group of
optionals; texts that differ become slots, texts that never differ stay template text. The result is
the host's wrapper. Pages are folded into wrappers inside each task, and the partial wrappers of a
host are merged in rounds of at most ``FAN_IN``, so no task holds more than that, whatever a host has.

A wrapper says where the main text is: the ``article`` (else ``main``) element if it holds a fair
part of the host's running text, else the body without the wrapper's template texts and link lists.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are left out by element, role and the words of class and id. A word of class or id leaves out no
element that holds the page's main text (``resolved``).

Defined cases: null, empty or text-less html gives an empty text; urls without host share the empty
host; unclosed or stray tags are read as browsers do (roughly); elements nested
deeper than ``DEEPEST`` are text of the wrapper's deepest node, and their text is extracted as any other; a page without its host's main
element falls back to ``main``, then the body; repeated rows are all returned; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import cut, drop, packed, unpacked
from barspark.llm.url_rules import host_and_path

FAN_IN = 32            # partial wrappers merged by one task
WIDEST = 48            # siblings a wrapper node lists before they become one repeated group
DEEPEST = 64           # nested elements a wrapper lists; what lies deeper counts as their text
FOLDED_TAGS = 8        # of them for labels over that, folded by their tag names
FAIR_SHARE = 0.3       # of the running text, for an article or main element to be the main text
LEAST_PAGES = 10       # different pages a template text must be seen on
LINKED = 0.8           # part of a node's text in links that makes it a link list

MAINS = ("article", "main")  # elements of main text, the first choice first

# Element classes of HTML, and words that name what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section "
                  "select summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCK - frozenset("body html option legend tbody td tfoot th thead title tr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
CLOSE_LIMIT = frozenset("ul ol dl table select div section article main body".split())
LEFT_OUT = frozenset("head script style noscript template iframe object svg canvas nav menu header footer aside form button "
                     "input select textarea dialog title".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment "
    "comments commentlist disqus respond replies reply discussion related recommended widget widgets pagination pager copyright".split())

READER_WORDS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
# Of these, an article element itself can be: a reader's comment or a lead to another page.
ARTICLE_WORDS = READER_WORDS | frozenset("teaser teasers related recommended promo".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noframes|xmp)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|</?[a-z][^>]*>|<[!?/][^>]*>|[^<]+|<""", re.I | re.S)
ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw else {}


HARD, BY_WORD, READERS = 1, 2, 3  # left out by element or role; by a class or id word; by one of reader comments
_NAMES: dict[tuple[str, str], tuple[str, int]] = {}


def element(tag: str, raw: str) -> tuple[str, int]:
    """(label, how it is left out or 0) of an opening tag; the label is the tag with its class and id words."""
    known = _NAMES.get((tag, raw)) if len(raw) < 200 else None
    if known:
        return known
    attrs = attributes(raw)
    words = [w.lower() for w in NAME_WORD.findall(attrs.get("class", "") + " " + attrs.get("id", ""))]
    out = 0
    if tag in LEFT_OUT or attrs.get("role", "").lower() in LEFT_OUT_ROLES or "hidden" in attrs:
        out = HARD
    elif tag not in ("body", "html", "main") and not (ARTICLE_WORDS if tag == "article" else LEFT_OUT_WORDS).isdisjoint(words):
        out = BY_WORD if READER_WORDS.isdisjoint(words) else READERS
    found = ".".join([tag, *dict.fromkeys(words)]), out
    if len(_NAMES) < 50_000 and len(raw) < 200:
        _NAMES[tag, raw] = found
    return found


def events(page: str) -> list[tuple[str, str, int]]:
    """(kind, value, left out): kind "open" / "close" with a label, "text" with its raw text, "break"."""
    found = list(raw_events(page))
    return resolved(found) if any(out > HARD for _, _, out in found) else found


def resolved(found: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The events of a page with class and id words overruled, outermost first, where an element holds

    * most of the page's running text, or all of it if a word is of reader comments, while no article or
      main element is outside of what is left out, or inside such an element;
    * the page's main or only article, or articles of a fair part of its running text, while none is
      outside of what is left out;
    * a first-level headline in an article or main element.

    An article element with such a word of its own stays left out if the page has another article or main
    element; without one it is kept, but for a reader comment that isn't all of the running text.
    """
    # Per element left out by word, or root: [how, running text, mains, outermost articles, headlines,
    # article text, article and main elements in no deeper such element].
    spans: dict[int, list[int]] = {-1: [0] * 7}
    stack: list[tuple[int, str, bool]] = []  # event, tag, is it in an article
    words: list[int] = [-1]
    hard = links = 0
    for i, (kind, value, out) in enumerate(found):
        if kind == "open":
            tag = value.split(".", 1)[0]
            in_article = bool(stack) and stack[-1][2]
            hard += out == HARD
            if out > HARD:
                spans[i] = [out, *[0] * 6]
                words.append(i)
            links += tag == "a"
            if not hard and (tag in MAINS or tag == "h1"):
                for k in words:
                    spans[k][2] += tag == "main"
                    spans[k][3] += tag == "article" and not in_article
                    spans[k][4] += tag == "h1"
                spans[words[-1]][6] += tag in MAINS
            stack.append((i, tag, in_article or tag == "article"))
        elif kind == "close":
            i, tag, _ = stack.pop()
            hard -= found[i][2] == HARD
            links -= tag == "a"
            if words[-1] == i:
                words.pop()
        elif kind == "text" and not hard and not links:
            n = len("".join(value.split()))
            for k in words:
                spans[k][1] += n
                spans[k][5] += n if stack and stack[-1][2] else 0
    whole, free = spans[-1][1], spans[-1][6]
    others = free > 0
    out_list, open_tags, left = list(found), [], 0  # open_tags: (tag, does it leave out)
    mains = 0
    for i, (kind, value, out) in enumerate(found):
        if kind == "open":
            tag = value.split(".", 1)[0]
            if out > HARD and not left:
                how, mass, main, articles, headlines, article_mass, direct = spans[i]
                most = mass > 0 and (mass == whole if how == READERS else 2 * mass > whole)
                holds = main or articles == 1 or (articles and article_mass >= FAIR_SHARE * whole)
                if tag == "article":
                    if (most and not others) if how == READERS else not others:
                        out = 0
                        out_list[i] = kind, value, 0
                        free += direct
                elif (not free or mains) and most or (not free and holds) or (mains and headlines and how == BY_WORD):
                    out = 0
                    out_list[i] = kind, value, 0
                    free += direct
            mains += tag in MAINS and not left
            open_tags.append((tag, bool(out), tag in MAINS and not left))
            left += bool(out)
        elif kind == "close":
            _, was_out, was_main = open_tags.pop()
            left -= was_out
            mains -= was_main
    return out_list


def raw_events(page: str) -> Iterator[tuple[str, str, int]]:
    """``events`` with an element's own mark: how it would be left out."""
    stack: list[str] = []

    def closed(to: int) -> Iterator[tuple[str, str, int]]:
        while len(stack) > to:
            yield "close", stack.pop(), 0

    for m in TOKEN.finditer(page):
        tag = m.group(3)
        if tag is None:
            if m.group(1) is None and (m.group().isspace() or m.group()[0] != "<" or m.group() == "<"):
                yield "text", m.group(), 0
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in VOID:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == tag:
                    yield from closed(k)
                    break
                if tag not in BLOCK and stack[k] in BLOCK:
                    break  # a stray inline end tag closes no block
            continue
        if tag in ENDS_P and "p" in stack:
            yield from closed(len(stack) - 1 - stack[::-1].index("p"))
        ends = CLOSED_BY.get(tag)
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in ends:
                    yield from closed(k)
                    break
                if stack[k] in CLOSE_LIMIT:
                    break
        if tag in VOID:
            yield "break", tag, 0
            continue
        label, out = element(tag, m.group(4))
        stack.append(tag)
        yield "open", label, out
    yield from closed(0)


# ---- wrappers: nodes [label, quantifier, pages, text mass, link mass, template text, children, seen] ----
# seen: hashes of the texts of LEAST_PAGES different pages, or all if fewer, that hold the template text.

LABEL, QUANT, PAGES, MASS, LINKS, TEXT, KIDS, SEEN = range(8)
SLOT = 0  # value of TEXT where texts differ; None: no text so far


def quant(a: str, b: str, repeated: bool = False) -> str:
    some = a in "?*" or b in "?*"
    many = repeated or a in "+*" or b in "+*"
    return ("*" if some else "+") if many else ("?" if some else "1")


def merge(a: list, b: list, same_page: bool = False) -> list:
    """Align node b with node a of the same label. ``same_page``: adjacent siblings of one page."""
    text = a[TEXT] if b[TEXT] is None else b[TEXT] if a[TEXT] is None else a[TEXT] if a[TEXT] == b[TEXT] and not same_page else SLOT
    if not isinstance(text, str):
        seen = []
    elif a[TEXT] is None or b[TEXT] is None:
        seen = b[SEEN] if a[TEXT] is None else a[SEEN]
    else:
        seen = sorted({*a[SEEN], *b[SEEN]})[:LEAST_PAGES]
    return [a[LABEL], quant(a[QUANT], b[QUANT], same_page), max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES],
            a[MASS] + b[MASS], a[LINKS] + b[LINKS], text, align(a[KIDS], b[KIDS], same_page), seen]


def optional(n: list) -> list:
    return [n[LABEL], quant(n[QUANT], "?"), *n[PAGES:]]


def align(a: list, b: list, same_page: bool = False) -> list:
    """Longest common subsequence of two sibling lists by label; the rest becomes optional."""
    if [n[LABEL] for n in a] == [n[LABEL] for n in b]:
        return [merge(x, y, False) if not same_page else _same(x, y) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][LABEL] == b[j][LABEL] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][LABEL] == b[j][LABEL]:
            out.append(merge(a[i], b[j]) if not same_page else _same(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return folded(out)


def _same(x: list, y: list) -> list:
    """Nodes at one place of two adjacent siblings: one page, one place, not a repetition."""
    n = merge(x, y, True)
    n[QUANT] = quant(x[QUANT], y[QUANT])
    return n


def folded(kids: list) -> list:
    """Adjacent equal siblings as one repeated node; a list still too long as a repeated group of optionals."""
    out: list = []
    for n in kids:
        if out and out[-1][LABEL] == n[LABEL]:
            out[-1] = merge(out[-1], n, True)
        else:
            out.append(n)
    if len(out) > WIDEST:
        by_label: dict[str, list] = {}
        for n in out:
            by_label[n[LABEL]] = merge(by_label[n[LABEL]], n, True) if n[LABEL] in by_label else n
        out = [[n[LABEL], "*", *n[PAGES:]] for n in by_label.values()]
        if len(out) > WIDEST:  # more labels than that: the slightest are folded by tag name
            out = _by_tag(out)
    return out


def _by_tag(nodes: list) -> list:
    """The heaviest labels; the others as one node ``tag.*`` per tag name, with their masses and children."""
    heavy = sorted(nodes, key=lambda n: (n[LABEL].endswith(".*") or n[LABEL] == "#any", -total(n, MASS)))
    kept, by_tag = heavy[:WIDEST - FOLDED_TAGS], {}
    for n in heavy[WIDEST - FOLDED_TAGS:]:
        label = n[LABEL] if n[LABEL] == "#any" else n[LABEL].split(".", 1)[0] + ".*"
        n = [label, "*", *n[PAGES:]]
        by_tag[label] = merge(by_tag[label], n, True) if label in by_tag else n
    slight = [by_tag.pop("#any")] if "#any" in by_tag else []
    tags = sorted(by_tag.values(), key=lambda n: -total(n, MASS))
    slight += tags[FOLDED_TAGS:]  # more tag names than that: one nameless optional
    nameless = [["#any", "*", 1, sum(total(n, MASS) for n in slight), sum(total(n, LINKS) for n in slight), SLOT, [], []]] if slight else []
    listed = {n[LABEL] for n in kept}
    return [n for n in nodes if n[LABEL] in listed] + tags[:FOLDED_TAGS] + nameless


def whole_text(text: str, content) -> str:
    """A text to compare with others: itself, or its start and a hash of all of it. Adds it to ``content``."""
    raw = text.encode("utf-8", "surrogatepass")
    content.update(raw + b"\0")
    return text if len(text) <= 64 else f"{text[:64]}...{hashlib.blake2b(raw, digest_size=16).hexdigest()}"


def page_tree(page: str | None) -> list:
    """The wrapper of one page: what is left out holds no text and no children."""
    return tree_and_masses(page)[0]


def tree_and_masses(page: str | None) -> tuple[list, list[int]]:
    """``page_tree``, and the mass of all text, of the text in article and of that in main elements."""
    seen: list[int] = []  # shared by the nodes of this page; filled when all its text is known
    content = hashlib.blake2b(digest_size=6)
    root = ["", "1", 1, 0, 0, None, [], seen]
    masses, within = [0, 0, 0], [1, 0, 0]  # within: open elements of each kind
    path, out_depth, links = [root], 0, 0
    for kind, value, out in events(page or ""):
        if kind == "open":
            node = [value, "1", 1, 0, 0, None, [], seen]
            if out_depth:
                out_depth += 1
            else:
                if len(path) > DEEPEST:
                    node = path[-1]  # so deep a subtree counts as text of the element above it
                else:
                    path[-1][KIDS].append(node)
                out_depth = int(out > 0)
            path.append(node)
            for k, tag in enumerate(MAINS, 1):
                within[k] += value.split(".", 1)[0] == tag
            links += value == "a" or value.startswith("a.")
        elif kind == "close":
            node = path.pop()
            for k, tag in enumerate(MAINS, 1):
                within[k] -= value == tag
            links -= value == "a"
            if out_depth:
                out_depth -= 1
            if len(node[KIDS]) > 1 and path[-1] is not node:
                node[KIDS] = folded(node[KIDS])
        elif kind == "text" and not out_depth and not value.isspace():
            node = path[-1]
            node[MASS] += len(value)
            for k in range(3):
                masses[k] += len(value) if within[k] else 0
            node[LINKS] += len(value) if links else 0
            text = whole_text(value.strip(), content)
            node[TEXT] = text if node[TEXT] is None and len(path) <= DEEPEST + 1 else SLOT
    root[KIDS] = folded(root[KIDS])
    seen.append(int.from_bytes(content.digest(), "big"))
    return root, masses


def total(n: list, k: int) -> int:
    return n[k] + sum(total(c, k) for c in n[KIDS])


def expression(n: list) -> str:
    """The wrapper as a union-free regular expression over tags, with #text slots."""
    inner = (repr(n[TEXT]) if n[TEXT] else "#text" if n[TEXT] == SLOT and n[TEXT] is not None else "") + "".join(map(expression, n[KIDS]))
    body = f"<{n[LABEL]}>{inner}</>" if n[LABEL] else inner
    return body if n[QUANT] == "1" else f"({body}){n[QUANT]}"


def rule_of(wrapper: list, masses: tuple[int, int, int]) -> tuple[str, list[str]]:
    """(main element, paths left out) of a host; ``masses``: sums of its pages' ``tree_and_masses``."""
    for tag, mass in zip(MAINS, masses[1:]):
        if masses[0] and mass >= FAIR_SHARE * masses[0]:
            return tag, []
    left_out: list[str] = []

    def visit(n: list, path: str) -> None:
        mass, links = total(n, MASS), total(n, LINKS)
        template = isinstance(n[TEXT], str) and len(n[SEEN]) >= LEAST_PAGES and not n[KIDS]
        if path.count("/") > 1 and mass and (template or (links > LINKED * mass and n[LABEL].split(".")[0] in ("ul", "ol", "div", "table", "p"))):
            left_out.append(path)
            return
        for c in n[KIDS]:
            visit(c, f"{path}/{c[LABEL]}")

    visit(wrapper, "")
    return "body", left_out


def main_text(page: str | None, main: str, left_out: frozenset[str]) -> str:
    """Blocks of the main element, in page order, joined by one space."""
    for tag in dict.fromkeys((main, "main", "body", "")):
        found = _text_inside(page or "", tag, left_out if tag in ("body", "") else frozenset())
        if found is not None:
            return found
    return ""


def _text_inside(page: str, main: str, left_out: frozenset[str]) -> str | None:
    """Text of the elements ``main`` (empty: the whole page); None if there is no such element."""
    parts: list[str] = []
    paths, inside, out_depth = [""], int(main == ""), 0
    there = main == ""
    mains: list[bool] = []
    for kind, value, out in events(page):
        if kind == "text":
            if inside and not out_depth:
                parts.append(value)
        elif kind == "open":
            tag = value.split(".", 1)[0]
            paths.append(f"{paths[-1]}/{value}" if left_out and len(paths) <= DEEPEST else "")
            if out_depth:
                out_depth += 1
            elif out or (left_out and paths[-1] in left_out):
                out_depth = 1
            is_main = tag == main and not out_depth
            mains.append(is_main)
            inside += is_main
            there |= is_main
            if tag in BLOCK:
                parts.append(" ")
        elif kind == "close":
            paths.pop()
            inside -= mains.pop()
            if out_depth:
                out_depth -= 1
            if value in BLOCK:
                parts.append(" ")
        elif inside and not out_depth and value in ("br", "hr"):
            parts.append(" ")
    return " ".join(entities.unescape("".join(parts)).split()) if there else None


# ---- Spark jobs ----

COLUMNS = ["host", "part", "pages", "wrapper", "mass", "article_mass", "main_mass"]
WRAPPERS = "host string, part long, pages long, wrapper string, mass long, article_mass long, main_mass long"


def infer_wrappers(df: DataFrame, url: str = "url", html: str = "html", fan_in: int = FAN_IN) -> DataFrame:
    """(host, pages, wrapper, mass, article_mass, main_mass): one wrapper per host, as a written table. The
    masses are sums over all pages of a host, so they are exact whatever the wrapper folds."""
    rows = df.select(host_and_path(F.col(url))[0].alias("host"), F.col(html).alias("html"))
    rows = rows.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("part", F.spark_partition_id().cast("long"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, tuple[list, list[int]]] = {}
        part = 0
        for pdf in batches:
            for host, page, part in zip(pdf["host"], pdf["html"], pdf["part"]):
                tree, masses = tree_and_masses(page)
                if host in found:
                    tree, masses = merge(found[host][0], tree), [x + y for x, y in zip(found[host][1], masses)]
                found[host] = tree, masses
            if len(found) > 2000:
                yield partial(found, part)
                found = {}
        yield partial(found, part)

    def partial(found: dict[str, tuple[list, list[int]]], part: int) -> pd.DataFrame:
        return pd.DataFrame([(h, part, w[PAGES], json.dumps(w), *m) for h, (w, m) in found.items()], columns=COLUMNS)

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "wrapper"])
        whole = None
        for text in pdf["wrapper"]:
            w = json.loads(text)
            whole = merge(whole, w) if whole else w
        masses = (int(pdf[c].sum()) for c in COLUMNS[4:])
        return pd.DataFrame([(key[0], key[1], int(pdf["pages"].sum()), json.dumps(whole), *masses)], columns=COLUMNS)

    parts = cut(rows.mapInPandas(fold, WRAPPERS), "wrappers")
    while (parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        deal = F.floor(F.col("n") / fan_in).cast("long")
        per_host = parts.groupBy("host").agg(F.count(F.lit(1)).alias("parts"))
        # Enough groups that each holds about fan_in partial wrappers; a host of few parts has one group.
        grouped = parts.join(per_host, "host").withColumn("n", F.col("parts")).withColumn(
            "part", F.pmod(F.xxhash64("host", "part", "wrapper"), F.greatest(F.lit(1), F.when(F.col("n") <= fan_in, 1).otherwise(deal + 1))))
        merged = cut(grouped.select(*COLUMNS).groupBy("host", "part").applyInPandas(combine, WRAPPERS), "wrappers")
        drop(parts)
        parts = merged
    return parts.drop("part")


def rules(wrappers: DataFrame) -> DataFrame:
    """(host, main, left_out) of each wrapper."""
    @F.pandas_udf("struct<main:string,left_out:array<string>>")
    def rule(texts: pd.Series, whole: pd.Series, article: pd.Series, main: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule_of(json.loads(t), m) for t, *m in zip(texts, whole, article, main)], columns=["main", "left_out"])

    return wrappers.withColumn("rule", rule("wrapper", *COLUMNS[4:])).select(F.col("host").alias("rule_host"), "rule.main", "rule.left_out")


def extract(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Input rows with ``text`` (main text) and ``n_chars`` (its code points)."""
    by_host = cut(rules(infer_wrappers(df, url, html)), "rules")
    host = F.coalesce(host_and_path(F.col("row").getField(url))[0], F.lit(""))
    rows = packed(df).withColumn("host", host).join(by_host, F.col("host") == F.col("rule_host"), "left")

    @F.pandas_udf("string")
    def text(pages: pd.Series, mains: pd.Series, left_out: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, m or "body", frozenset(o if o is not None else ())) for p, m, o in zip(pages, mains, left_out)], dtype=object)

    out = rows.withColumn("text", text(F.col("row").getField(html), F.col("main"), F.col("left_out")))
    return unpacked(out.withColumn("n_chars", F.length("text").cast("long")), "text", "n_chars")
