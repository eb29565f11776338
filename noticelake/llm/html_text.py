"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each with the path of tags and classes from the root to it. Per path
the lengths and the punctuation of its nodes are summed and divided by the number of nodes; links count
against a path. Both ratios are smoothed along the page, fused into one score, and nodes whose score
passes a threshold set by the page's own scores are content; a heading goes with what follows it. The element that holds
nearly all content is the content's subtree, and in it lists, tables and paragraphs of one link belong to the text, however short.

Some parts are left out whatever their ratios, since a reader's comment has the ratios of an article. What HTML itself
sets apart (scripts, menus, footers, what is hidden) never counts. What a class, id or role only hints at is
suspect: it is left out if the rest of the page has the article, but a hint on the element that holds the article itself
is overruled by how much of the page's prose it holds.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.shared import pages

#: Share of the page's mean content score that a node has to reach.
THRESHOLD = 0.2
#: What the prose outside a suspect part must come to, as a share of the prose in it, for the part to stay out; and if the
#: part's name is one that articles hardly ever bear.
WEAK_SHARE, STRONG_SHARE = 0.25, 0.05
#: Share of a page's prose that its article elements must hold to be taken as the article.
ARTICLE_SHARE = 0.25
#: Share of the largest article's prose that a further article element without a main heading must hold to be part of the text.
SECOND_SHARE = 0.25
#: Share of the content's prose that the content's subtree holds.
SUBTREE_SHARE = 0.8
#: Words from which on a paragraph that is one link is taken for a sentence, and letters that make a paragraph long.
LINK_WORDS, LONG = 4, 200
#: Blocks that are looked at to tell what follows a heading such as Discussion.
LOOK_AHEAD = 6
#: Elements nest no deeper; those below count as beside each other, as in browsers.
MOST_DEPTH = 512

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|<[!?/][^>]*>"
    r"|<(?P<cut>[a-zA-Z/!?][^>]*\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*)")
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")

# Elements by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
    "time tt u var wbr label ruby rt rp acronym".split()
)
NEVER = frozenset(
    "nav footer aside select option menu dialog head svg math object audio video canvas map datalist fieldset input iframe".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body table ul ol dl article section main div td th aside nav footer header form".split())
NEVER_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that hint at what is not the article.
WEAK_WORDS = frozenset(
    "promo promotion banner notice notices notification alert sidebar side menu footer foot share sharing social related recommended "
    "recommendations modal overlay search widget toolbar masthead topbar skip toc hidden rail teaser trending popular legal terms privacy "
    "disclaimer imprint impressum colophon signup login meta tags breadcrumb breadcrumbs".split()
)
#: Those that articles hardly ever bear. lnb, gnb and snb are the local, global and side menus of Korean sites.
STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr nav navbar navigation lnb gnb snb "
    "comment comments commentlist disqus reply replies respond newsletter subscribe subscription popup searchbox pagination pager copyright paywall".split()
)
#: Words in a name that speak of a layout around such parts, as in has-sidebar.
LAYOUT_WORDS = frozenset("has with no without layout columns".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Words that make an article element a comment, an advert or a teaser.
ARTICLE_MARKS = frozenset("comment comments reply replies ad advert sponsored promo related teaser".split())
#: Elements that hold others, and those whose blocks may be short.
STRUCTURE = frozenset("html body div section article main center".split())
LISTED = frozenset("ul ol dl li dt dd table caption thead tbody tfoot tr td th pre blockquote figcaption".split())
#: A line that begins the readers' part of a page, one that may as well head a part of the article, and one that claims rights.
COMMENTS_LINE = re.compile(r"(?:\d+ )?(?:reader(?:s'|s|'s)? )?(?:comments?|leave a (?:comment|reply)|join the discussion|kommentare|commentaires|comentarios|댓글)(?: ?\(?\d+\)?)?:?", re.I)
DISCUSSION_LINE = re.compile(r"(?:\d+ )?(?:reader(?:s'|s|'s)? )?(?:responses|replies|discussion)(?: ?\(?\d+\)?)?:?", re.I)
#: What stands around readers' comments.
COMMENT_SIGN = re.compile(r"\breply\b|\bsays\b|\bwrote\b|\b\d+ (?:minute|hour|day|week|month|year)s? ago\b|\blog ?in to\b|\bantworten\b|\brépondre\b|\bresponder\b|답글", re.I)
RIGHTS_LINE = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)

DROPPED = -1


def judged(tag: str, attributes: str, in_article: bool) -> tuple[bool, int, str]:
    """Whether an element is left out, how strongly its names hint at it (0 to 2), and its classes."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True, 0, ""
    hint, classes = 2 if tag == "form" else 0, ""
    if not attributes:
        return False, hint, classes
    for found in ATTRIBUTE.finditer(attributes):
        name, value = found.group(1).lower(), (found.group(2) or "").strip("\"'")
        if name == "hidden" and value.lower() != "until-found":
            return True, 0, ""
        if name == "aria-hidden" and value.lower() == "true":
            return True, 0, ""
        if name == "role":
            if value.lower() in NEVER_ROLES:
                return True, 0, ""
            hint = max(hint, {"form": 2, "banner": 1}.get(value.lower(), 0))
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, 0, ""
        elif name in ("class", "id"):
            if name == "class":
                classes = value
            for part in value.split():
                words = [w.lower() for w in NAME_PARTS.findall(part)]
                if not LAYOUT_WORDS.isdisjoint(words):
                    continue
                if tag in ARTICLE_TAGS:
                    hint = max(hint, 2 * (not ARTICLE_MARKS.isdisjoint(words)))
                elif not STRONG_WORDS.isdisjoint(words):
                    hint = 2
                elif not WEAK_WORDS.isdisjoint(words) or (tag not in HEADINGS and words == ["header"]):
                    hint = max(hint, 1)
    return False, 0 if tag in ("html", "body") else hint, classes


class Node(NamedTuple):
    """A text node: its path, the number of its block, whether it stands in a link, and the suspect and article elements around it (0: none)."""

    path: int
    block: int
    linked: bool
    suspect: int
    article: int
    heading: bool
    text: str


class Open(NamedTuple):
    """An element that is open: what the text in it would get."""

    tag: str
    path: int
    linked: bool
    suspect: int
    article: int
    heading: bool


class Page:
    """The text nodes of a page, in page order, and its suspect parts: of each the one around it and how strong the hint was."""

    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.suspects: list[tuple[int, int]] = [(0, 0)]
        self.titled: set[int] = set()  # articles with a main heading
        self.holders: set[int] = set()  # suspects with an article or a main heading in them
        self._paths: dict[tuple, int] = {}
        self.parents, self.tags = [0], [""]  # of each path
        self._articles = 0
        self._read(page)

    def _read(self, page: str) -> None:
        stack, count, beyond = [Open("", 0, False, 0, 0, False)], Counter(), 0
        block, at, size = 0, 0, len(page)

        def pop_to(depth: int) -> None:
            for x in stack[depth:]:
                count[x.tag] -= 1
            del stack[depth:]

        def say(text: str) -> None:
            top = stack[-1]
            if not text or top.suspect == DROPPED:
                return
            if text.isspace():
                self._space(block)
            else:
                self.nodes.append(Node(top.path, block, top.linked, top.suspect, top.article, top.heading, html.unescape(text)))

        while at < size:
            found = TOKEN.search(page, at)
            if found is None:
                say(page[at:])
                break
            say(page[at : found.start()])
            at = found.end()
            tag = found.group("tag")
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in INLINE and tag not in ("a", "br", "img", "button"):
                block += 1
            if found.group("close"):
                if beyond and tag not in VOID:
                    beyond -= 1
                elif count[tag]:
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth].tag == tag:
                            pop_to(depth)
                            break
                        if stack[depth].tag in SCOPES and tag in INLINE:
                            break
                continue
            if tag in CLOSES_P:
                if count["p"]:
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth].tag == "p":
                            pop_to(depth)
                            break
                        if stack[depth].tag in SCOPES:
                            break
            elif tag in CLOSES_SAME:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in CLOSES_SAME[tag]:
                        pop_to(depth)
                        if tag != "tr":
                            break
                    elif stack[depth].tag in SCOPES:
                        break
            if tag == "br":
                self._space(block)
            attributes = found.group("rest")
            if tag in RAW and not attributes.endswith("/"):
                end = raw_end(tag).search(page, at)
                at = size if end is None else end.start()
                close = page.find(">", at)
                at = size if close < 0 else close + 1
            elif tag not in VOID:
                if len(stack) < MOST_DEPTH:
                    stack.append(self._opened(tag, attributes, stack[-1]))
                    count[tag] += 1
                else:
                    beyond += 1

    def _space(self, block: int) -> None:
        if self.nodes and self.nodes[-1].block == block:
            self.nodes.append(self.nodes[-1]._replace(text=" "))

    def _opened(self, tag: str, attributes: str, around: Open) -> Open:
        suspect, path, article = around.suspect, around.path, around.article
        classes = ""
        if suspect != DROPPED:
            out, hint, classes = judged(tag, attributes, article > 0)
            if out:
                suspect = DROPPED
            elif hint:
                self.suspects.append((suspect, hint))
                suspect = len(self.suspects) - 1
            if suspect != DROPPED and (tag in ARTICLE_TAGS or tag == "h1"):
                inside = suspect
                while inside:
                    self.holders.add(inside)
                    inside = self.suspects[inside][0]
                if tag == "h1":
                    self.titled.add(article)
                elif tag == "article" or not article:
                    self._articles += 1
                    article = self._articles
        if tag not in INLINE:
            around_path, path = path, self._paths.setdefault((path, tag, classes), len(self._paths) + 1)
            if path == len(self.parents):
                self.parents.append(around_path)
                self.tags.append(tag)
        return Open(tag, path, around.linked or tag in ("a", "button"), suspect, article, around.heading or tag in HEADINGS)


@cache
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I)


def prose(node: Node) -> int:
    """How much a node counts as prose: the length of text that isn't a link; without any punctuation a quarter of it."""
    if node.linked or node.text.isspace():
        return 0
    return len(node.text) if PUNCTUATION.search(node.text) else len(node.text) // 4


def without_suspects(page: Page) -> list[Node]:
    """The nodes outside all suspect parts, but for those that hold the page's article."""
    own: Counter = Counter()
    for node in page.nodes:
        own[node.suspect] += prose(node)
    inside, children = own.copy(), {}
    for s in range(len(page.suspects) - 1, 0, -1):
        around = page.suspects[s][0]
        inside[around] += inside[s]
        children.setdefault(around, []).append(s)
    def key(s: int) -> tuple[int, int, int]:  # weak hints first, then what holds most
        return page.suspects[s][1], -inside[s], s

    opened, outside = {0}, own[0]
    waiting = [key(s) for s in children.get(0, [])]
    heapq.heapify(waiting)
    while waiting:
        s = heapq.heappop(waiting)[2]
        strong = page.suspects[s][1] == 2 and not (s in page.holders and outside == 0)
        if inside[s] and outside < (STRONG_SHARE if strong else WEAK_SHARE) * inside[s]:
            opened.add(s)
            outside += own[s]
            for c in children.get(s, []):
                heapq.heappush(waiting, key(c))
    return [n for n in page.nodes if n.suspect in opened]


def marked(page: Page, tags: frozenset[str]) -> list[bool]:
    """For each path whether it or a path around it is of one of the tags."""
    out = [False] * len(page.parents)
    for path in range(1, len(out)):
        out[path] = page.tags[path] in tags or out[page.parents[path]]
    return out


def article_of(page: Page, nodes: list[Node]) -> list[Node]:
    """The nodes of the page's article elements, if those hold enough of its prose; of several, those with a main heading and
    those that hold as much. A main heading before an article that has none of its own belongs to it.
    """
    own: Counter = Counter()
    for node in nodes:
        own[node.article] += prose(node)
    total = sum(own.values())
    for wanted in (page.titled - {0}, set(range(1, page._articles + 1))):
        largest = max((own[a] for a in wanted), default=0)
        wanted = wanted | {a for a in own if a and own[a] >= max(1, SECOND_SHARE * largest)} if wanted else wanted
        kept = [n for n in nodes if n.article in wanted]
        if kept and sum(map(prose, kept)) >= ARTICLE_SHARE * total:
            if page.titled.isdisjoint(wanted):
                title, first = marked(page, frozenset(("h1",))), nodes.index(kept[0])
                kept = [n for n in nodes[:first] if not n.article and title[n.path]] + kept
            return kept
    return nodes


def subtree(page: Page, nodes: list[Node], keep: list[bool]) -> int:
    """The path of the innermost element that holds nearly all content; elements beside it may have the same path."""
    inside = [0] * len(page.parents)
    for node, kept in zip(nodes, keep, strict=True):
        inside[node.path] += prose(node) if kept else 0
    for path in range(len(inside) - 1, 0, -1):
        inside[page.parents[path]] += inside[path]
    at = 0
    for path in range(1, len(inside)):  # those inside have larger numbers
        if page.parents[path] == at and page.tags[path] in STRUCTURE and inside[path] >= SUBTREE_SHARE * max(1, inside[0]):
            at = path
    return at


def lines_of(nodes: list[Node]) -> list[tuple[list[int], str]]:
    """The numbers of the nodes of each block, and its text with white space as one space."""
    out: list[tuple[list[int], list[str]]] = []
    last = None
    for i, node in enumerate(nodes):
        if node.block != last:
            out.append(([], []))
            last = node.block
        out[-1][0].append(i)
        out[-1][1].append(node.text)
    return [(numbers, " ".join("".join(parts).split())) for numbers, parts in out]


def closed(values: list[float]) -> list[float]:
    """Values smoothed along the page: what dips between higher neighbours is lifted halfway to the lower of them."""
    padded = [0.0, *values, 0.0]
    return [max(v, (v + min(padded[i], padded[i + 2])) / 2) for i, v in enumerate(values)]


def content_nodes(nodes: list[Node]) -> list[bool]:
    """Which nodes are content, by the ratios of their paths."""
    length: Counter = Counter()
    marks: Counter = Counter()
    count: Counter = Counter()
    for node in nodes:
        if not node.text.isspace():
            # link text says that a path is a list of links, so it adds nodes but no length
            length[node.path] += 0 if node.linked else len(node.text)
            marks[node.path] += 0 if node.linked else len(PUNCTUATION.findall(node.text))
            count[node.path] += 1
    text_ratio = closed([length[n.path] / max(1, count[n.path]) for n in nodes])
    mark_ratio = closed([marks[n.path] / max(1, count[n.path]) for n in nodes])
    score = [math.sqrt(t) * (1 + math.log1p(m)) for t, m in zip(text_ratio, mark_ratio, strict=True)]
    weight = [0 if n.linked else len(n.text) for n in nodes]
    total = sum(weight)
    if not total:
        return [False] * len(nodes)
    level = THRESHOLD * sum(s * w for s, w in zip(score, weight, strict=True)) / total
    return [s >= level for s in score]


def ends_text(lines: list[str], at: int, in_article: bool) -> bool:
    """Whether the line begins the readers' part of the page.

    A heading such as Comments does, unless a long paragraph without any sign of comments follows it within the article. One such as
    Discussion does only if what follows has signs of comments, or outside an article.
    """
    sure, perhaps = COMMENTS_LINE.fullmatch(lines[at]), DISCUSSION_LINE.fullmatch(lines[at])
    if not sure and not perhaps:
        return False
    after = [x for x in lines[at + 1 : at + 1 + LOOK_AHEAD] if x]
    signs = any(len(x) < LONG and COMMENT_SIGN.search(x) for x in after)
    if sure:
        return signs or not in_article or not after or len(after[0]) < LONG
    return signs


def main_text(page: str) -> str:
    """The article's text: white space within a block is one space, blocks are joined by a line end."""
    read = Page(page)
    nodes = article_of(read, without_suspects(read))
    keep = content_nodes(nodes)
    at = subtree(read, nodes, keep)
    whole = read.tags[at] in ("", "html", "body")  # the page itself is the subtree
    within, listed, pressed = [path == at for path in range(len(read.parents))], marked(read, LISTED), marked(read, frozenset(("button",)))
    for path in range(1, len(within)):
        within[path] = within[path] or within[read.parents[path]]
    blocks = lines_of(nodes)
    lines = [line for _, line in blocks]
    size, links, home = Counter(), Counter(), []
    for numbers, _ in blocks:
        path = nodes[numbers[0]].path
        while read.tags[path] in ("a", "button"):
            path = read.parents[path]
        home.append(path)
        size[path] += sum(len(nodes[i].text) for i in numbers)
        links[path] += sum(len(nodes[i].text) for i in numbers if nodes[i].linked)
    kept: list[str] = []
    headings: list[str] = []  # those that wait for what follows them
    for k, (numbers, line) in enumerate(blocks):
        if not line:
            continue
        article, path = nodes[numbers[0]].article > 0, home[k]
        if kept and ends_text(lines, k, article):
            break
        linked = sum(len(nodes[i].text) for i in numbers if nodes[i].linked)
        menu = 2 * linked > len(line) and not any(PUNCTUATION.search(nodes[i].text) for i in numbers if not nodes[i].linked)
        sentence = menu and line[-1] in ".!?"  # a paragraph of one link that is a sentence
        inside = within[path] and path != at and (not whole or article or (bool(kept) and (listed[path] or sentence)))
        if menu and inside and not all(pressed[nodes[i].path] or nodes[i].text.isspace() for i in numbers):
            # a paragraph that is one link says something; a list is a menu if most of it is links
            menu = 2 * links[path] > size[path] if listed[path] else len(line.split()) < LINK_WORDS
        if all(nodes[i].heading for i in numbers) and not menu:
            headings.append(line)
        elif (inside or any(keep[i] for i in numbers)) and not menu and (article or not RIGHTS_LINE.match(line)):
            kept += [*headings, line]
            headings.clear()
        else:
            headings.clear()
    if headings and not kept:  # a page of headings alone
        kept = headings
    return "\n".join(kept)


def extract_pages(rows: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of page_id, url, html.

    A null html gives an empty text; an html without content too. Page ids and urls pass through as
    they are, nulls included; repeated rows give a row each; other columns are not read.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                batch = whole.slice(i, 200)
                texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    slim = rows.select(F.col("page_id").cast("long"), "url", "html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages: page_id, url, text, n_chars."""
    return extract_pages(pages(spark, sf_dir))
