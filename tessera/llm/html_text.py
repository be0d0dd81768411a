"""Main text of HTML pages by composite text density.

Each page becomes a DOM tree with implied end tags. Elements that are not article text by
their tag or role (menus, headers, footers, sidebars, forms, scripts, styles) and boxes of reader
comments are cut first, save where one holds an article or main element, or, with no such
element outside it, most of the text: there density decides. A header inside an article is the
article's. A class or id that speaks of a notice, an advert or a box is a hint: it cuts only what is
rich in links or has fewer than three sentences, and nothing at all where that name stands on half of
the page's text, as the names of page builders do. For every node that stays, with C
characters, T tags, LC link characters and LT link tags below it,

    density = C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

where b is the body and zero counts are one. The score of a node is the sum of its
children's densities. Nodes are block elements: inline ones count as tags of their block.
The node with the greatest score holds the article; the smallest density on the path to it from
below the body is the threshold (the body's own, if it is that node). Starting at the body, every child at or
over the threshold is main text, and so is one of three sentences or more with under a tenth of links;
other children are searched in the same way. Strings and inline elements that
stand directly in a searched node are blocks of their own, by run or, where under a third of them
is links, all runs of the node as one. Of such a child the main element around its best-scored
node is taken, or its articles where that node is in one, else the child itself; where a third
of it is links, it is searched like others, and its best-scored node is taken in any case.

Behaviour: null html counts as empty; a page without text gives an empty string. Character
references are decoded, white space within a block is one space, blocks are joined in page
order by a blank line. Unclosed, misnested or truncated markup is closed as browsers do.
Rows that repeat are answered each, null page_id or url pass through, other columns are not
read, an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CUT_TAGS = frozenset("aside button canvas dialog footer form head header iframe input nav noscript object option script select style svg template textarea title".split())
#: Cut tags that may be wrapped around an article.
SOFT_TAGS = frozenset("aside dialog footer form header nav".split())
CUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
COMMENTS = frozenset("comment comments disqus".split())
#: First and last parts of class and id tokens: not-cut modifiers before a cut name, an article's own parts, and boxes after a cut name.
MODIFIERS = frozenset("has hide is no not show with without".split())
OWN_PARTS = frozenset("article content entry post story".split())
BOXES = frozenset("area articles bar block box buttons form inner item items left links list news posts right section slot stories text unit".split())
#: Start tags that end an open element of these kinds, unless a tag of the second set stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "a": ({"a"}, {"td", "table"})}
P_SCOPE = frozenset("body button caption html object table td th template".split())
NO_P = BLOCKS - {"p"}
NAME = re.compile(r"[A-Za-z]+")
#: Ends of sentences; words or else characters that make one; sentences of a block that no name cuts, and that count as text beside the article.
SENTENCE_END, SENTENCE_WORDS, SENTENCE_CHARS, TEXT_SENTENCES = re.compile(r"[.!?。！？](?:\s+|$)"), 4, 20, 3


class Node:
    __slots__ = ("tag", "parent", "block", "parts", "cut", "soft", "named", "chars", "tags", "link_chars", "link_tags", "sentences", "density", "score", "blocky", "depth", "held")

    def __init__(self, tag: str, parent: Node | None, cut: bool, soft: str = "", named: bool = False):
        self.tag, self.parent, self.cut, self.soft, self.named, self.parts = tag, parent, cut, soft, named, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.sentences = 0
        self.depth = 0 if parent is None else parent.depth + 1
        self.held = self if tag in ("article", "main") else None if parent is None else parent.held  # the nearest article or main, itself included
        self.density = self.score = 0.0
        self.blocky = tag in BLOCKS
        self.block = parent if parent is None or parent.tag in BLOCKS else parent.block  # the block element that it stands in


def named_cut(word: str) -> str:
    """The cut name that a class or id token is, ends with, or begins with before a box; empty if there is none."""
    parts = [x.lower() for x in NAME.findall(word) if len(x) > 1]
    if not parts or len(parts) > 1 and parts[0] in MODIFIERS:
        return ""
    if parts[-1] in CUT_NAMES and not (parts[-1] == "header" and len(parts) > 1 and parts[-2] in OWN_PARTS):
        return parts[-1]
    return parts[0] if parts[0] in CUT_NAMES and parts[-1] in BOXES else ""


def sentences_of(text: str) -> int:
    """Sentences that are long enough to be ones."""
    return sum(len(x) >= SENTENCE_CHARS or len(x.split()) >= SENTENCE_WORDS for x in SENTENCE_END.split(text)[:-1])


def cut_by(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> tuple[bool, str, bool]:
    """Whether an element is cut in any case; else the reason to cut it unless it is wrapped around the article; and whether that is a name only.

    inside: it stands in an article or main element, whose header is its own.
    """
    if tag in CUT_TAGS and tag not in SOFT_TAGS:
        return True, "", False
    if tag in ("html", "body", "main"):
        return False, "", False
    soft, named = tag if tag in SOFT_TAGS and not (tag == "header" and inside) else "", False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, "", False
        if name == "role" and value and value.lower() in CUT_ROLES and not (value.lower() == "banner" and inside):
            soft, named = soft if soft and not named else "role", False
        if name in ("class", "id") and value:
            for word in value.split():
                found = named_cut(word)
                if found and (tag != "article" or found in ("comment", "comments", "ad", "advert")) and not (found in ("header", "masthead") and inside):
                    if found in COMMENTS:
                        soft, named = found, False
                    elif not soft:
                        soft, named = found, True
    return False, soft, named


def settle_cuts(nodes: list[Node]) -> None:
    """Cut what has a reason for it and is not wrapped around the article; of what has a name alone, what doesn't read as text."""
    n_ = {id(n): [0, 0, 0, 0] for n in nodes}  # characters outside of links, those in links, sentences outside of links, articles and mains
    for n in reversed(nodes):
        if n.cut:
            continue
        own = n_[id(n)]
        strings = [x for x in n.parts if isinstance(x, str)]
        own[0] += sum(len(x.strip()) for x in strings)
        own[2] += sum(map(sentences_of, strings))
        if n.tag == "a":
            own[0], own[1], own[2] = 0, own[0] + own[1], 0
        if n.parent is not None:
            up = n_[id(n.parent)]
            up[0], up[1], up[2] = up[0] + own[0], up[1] + own[1], up[2] + own[2]
            if not (n.tag == "article" and n.soft):  # a comment or advert, with what it holds
                up[3] += own[3] + (n.tag in ("article", "main"))
    body = n_[id(nodes[0])]
    under: dict[str, int] = defaultdict(int)  # text that stands under each name
    outer: dict[int, frozenset] = {id(nodes[0]): frozenset()}
    for n in nodes[1:]:
        above = outer[id(n.parent)]
        if n.named and n.soft not in above:
            under[n.soft] += n_[id(n)][0]
            above = above | {n.soft}
        outer[id(n)] = above
    for n in nodes[1:]:
        text, links, sentences, holds = n_[id(n)]
        wraps = holds and not (n.tag == "article") or n.soft not in COMMENTS and body[3] == 0 and 2 * text > body[0]
        if n.named and not wraps:
            wraps = 2 * under[n.soft] >= body[0] or sentences >= TEXT_SENTENCES and 3 * links < text + links
        n.cut = n.cut or n.parent.cut or bool(n.soft) and not wraps


class TreeBuilder(HTMLParser):
    """The open elements as a stack, with the places of each tag in it, so that closing one never searches what stays open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body = Node("body", None, False)
        self.open, self.nodes = [self.body], [self.body]
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def _close(self, kinds: Iterable[str], stop: Iterable[str]) -> None:
        """Close the last open element of kinds with all in it, unless one of stop stands after it."""
        last = max((self.places[k][-1] for k in kinds if self.places[k]), default=0)
        if last and not any(self.places[k] and self.places[k][-1] > last for k in stop):
            self._cut_open(last)

    def _cut_open(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self._cut_open(1)
            return
        if tag in BLOCKS and self.places["p"]:
            self._close(("p",), P_SCOPE)
        if tag in ENDS:
            self._close(*ENDS[tag])
        node = Node(tag, self.open[-1], *cut_by(tag, attrs, self.open[-1].held is not None))
        node.cut = node.cut or self.open[-1].cut
        self.open[-1].parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._close((tag,), ())
        elif self.places[tag]:  # an inline end tag does not reach out of its block
            self._close((tag,), NO_P if tag != "head" else ())

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def density(n: Node, links: float) -> float:
    """The composite density of a node with characters; links: the share of link characters in the body."""
    c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
    base = math.log(math.log(c / max(c - lc, 1) * lc + links * c + math.e))
    return c / t * max(math.log(c / lc * t / lt), 0.0) / max(base, 1e-6)


def weigh(nodes: list[Node]) -> None:
    """Counts, densities and scores, from the leaves up: children come after their parent."""
    for n in reversed(nodes):
        if n.cut:
            continue
        for x in n.parts:
            if isinstance(x, str):
                n.chars, n.sentences = n.chars + len(x.strip()), n.sentences + sentences_of(x)
        if n.tag == "a":
            n.link_chars, n.link_tags, n.sentences = n.chars, n.link_tags + 1, 0
        if n.parent is not None:
            p = n.parent
            p.sentences += n.sentences
            p.blocky = p.blocky or n.blocky
            p.chars, p.tags, p.link_chars, p.link_tags = p.chars + n.chars, p.tags + n.tags + 1, p.link_chars + n.link_chars, p.link_tags + n.link_tags
    body = nodes[0]
    links = body.link_chars / max(body.chars, 1)
    for n in nodes:
        if not n.cut and n.chars and n.tag in BLOCKS:
            n.density = density(n, links)
            if n.block is not None:
                n.block.score += n.density


def run_of(parts: list) -> Node:
    """Strings and inline elements as a block."""
    run = Node("div", None, False)
    run.parts = parts
    for x in parts:
        if isinstance(x, str):
            run.chars += len(x.strip())
        else:
            run.chars, run.tags, run.link_chars, run.link_tags = run.chars + x.chars, run.tags + x.tags + 1, run.link_chars + x.link_chars, run.link_tags + x.link_tags
    return run


def units(n: Node, least: float, links: float) -> list[Node]:
    """The blocks in a node, in page order, and the runs of its own text that are at or over least, or are with the others."""
    runs, found, now = [], [], []
    for x in [*n.parts, None]:
        if isinstance(x, str) or x is not None and not x.cut and not x.blocky:
            now.append(x)
        elif x is None or not x.cut:
            if now:
                runs.append(run_of(now))
                found.append(runs[-1])
                now = []
            if x is not None:
                found.append(x)
    whole = run_of([x for r in runs for x in r.parts])
    every = whole.chars and whole.link_chars * 3 < whole.chars and density(whole, links) >= least
    for r in runs:
        r.density = math.inf if r.chars and every else density(r, links) if r.chars else 0.0
    return [x for x in found if x.parent is not None or x.chars and x.density >= least]


def articles(n: Node, best: Node) -> list[Node]:
    """The main element around the best-scored node of a subtree n; or the articles, if that is in one; or none."""
    held, p = None, best.held
    while p is not None and p.depth >= n.depth:  # of those around the best node only these are climbed
        held, p = p, p.parent.held if p.parent is not None else None
    if held is None or held.tag == "main":
        return [held] if held else []
    found, todo = [], [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.cut or not x.chars:
            continue
        if x is held or x.tag == "article" and x.link_chars * 3 < x.chars:
            found.append(x)
        else:
            todo += reversed(x.parts)
    return found


def content(nodes: list[Node]) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    body = nodes[0]
    best: dict[int, Node] = {}  # of every subtree its best-scored node, the outer one of equals
    for n in reversed(nodes):
        if not n.cut:
            own = best.get(id(n))
            top = n if own is None or n.score >= own.score else own
            best[id(n)] = top
            if n.parent is not None and (id(n.parent) not in best or top.score >= best[id(n.parent)].score):
                best[id(n.parent)] = top
    top = best[id(body)]
    if not top.score:
        return [body]
    least, n = top.density, top
    while n is not None and n is not body:
        least, n = min(least, n.density) if n.tag in BLOCKS else least, n.parent
    links = body.link_chars / max(body.chars, 1)
    found, todo, forced = [], [body] if top is body else units(body, least, links)[::-1], set()
    while todo:
        n = todo.pop()
        if n.cut or not n.chars:
            continue
        if n.parent is None and n is not body:  # a run
            found.append(n)
            continue
        text = n.sentences >= TEXT_SENTENCES and n.link_chars * 10 < n.chars
        if n.density >= least or text or id(n) in forced:
            own = best[id(n)]
            held = articles(n, own)
            if held or n.link_chars * 3 < n.chars or own is n or id(n) in forced:
                found += held or [n]
                continue
            forced.add(id(own))
        todo += reversed(units(n, least, links))
    return found


def blocks(subtrees: list[Node]) -> list[str]:
    done, now = [], []

    def end() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            done.append(text)

    for top in subtrees:
        end()
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                now.append(x)
            elif x.cut:
                continue
            elif x.tag == "br":
                now.append("\n")
            else:
                block = x.tag in BLOCKS
                if block:
                    end()
                    todo.append(None)
                todo += reversed(x.parts)
    end()
    return done


def main_text(html: str | None) -> str:
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    settle_cuts(builder.nodes)
    weigh(builder.nodes)
    return "\n\n".join(blocks(content(builder.nodes)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row for each page."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=schema.names)

    found = pages.select("page_id", "url", "html").mapInArrow(task, schema)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
