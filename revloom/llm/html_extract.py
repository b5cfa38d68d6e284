"""HTML extraction by tag-path ratios.

A page is cut into text nodes, each with the path of tags (and the first words of class and id) from the root to it. For each path, the length of its text and its punctuation are summed and divided by its
number of nodes; both ratios are smoothed over the paths' order in the page with a Gaussian and fused: the geometric mean of both as they are and both smoothed, times the path's weight, which is 0 for paths through elements that by tag, role, class or id
never hold the article (forms, menus, adverts, comments and so on), else 1. Paths whose fused ratio reaches the standard deviation of all weighted paths (scaled by THRESHOLD) are content.
The content's container is the deepest article or main element (else the deepest element that holds blocks) around all text of these
paths. The article is each block with text of these paths, and the container's headings before the last such block.

Text of a block-level element is a block; <br> and any white space are one space inside it.

Defined results: null or empty html, or a page without text, gives an empty text. Broken markup is read as browsers do in the main: unclosed elements end
with their parents, stray ends are ignored; a quotation mark of a tag that never closes is an ordinary character. A null page_id or url is passed on. Repeated rows give repeated results. An empty table
gives no rows. Only page_id, url and html are read. A page is read in one pass whose time and memory are in proportion to its length, however deep its elements.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)""")
HINT = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head script style noscript template title textarea select option button input form fieldset nav footer aside iframe object embed svg canvas audio video map dialog menu math".split())
#: An element of the left ends when one of the right begins, up to the nearest of the third.
ENDS = {"p": (BLOCK - {"html", "body", "head"}, frozenset("button table td th".split())), "li": ({"li"}, frozenset("ul ol menu".split())), "dt": ({"dt", "dd"}, frozenset(["dl"])), "dd": ({"dt", "dd"}, frozenset(["dl"]))}
ENDS |= {"tr": ({"tr", "tbody", "tfoot", "thead"}, frozenset(["table"])), "td": ({"td", "th", "tr", "tbody", "tfoot"}, frozenset(["table"])), "th": ({"td", "th", "tr", "tbody", "tfoot"}, frozenset(["table"])), "option": ({"option", "optgroup"}, frozenset(["select"]))}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tablist status".split())
#: Words of class and id names that mark what isn't the article.
SIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar aside rail widget widgets comment comments reply replies discussion disqus respond nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations recirc trending popular tags pager pagination paywall disclaimer copyright".split()
)
#: With one of these, a "header" is the article's own.
OWN_HEAD = frozenset("article post entry story content title headline".split())
SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
#: Elements that hold several blocks; a content's container is one of these, an article or main element where there is one.
HOLDERS = frozenset("html body article main section div center td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIGMA, RADIUS, THRESHOLD = 1.0, 2, 0.02


def marks(attributes: str) -> tuple[str, bool]:
    """What the path names an element by besides its tag, and whether its attributes say that it isn't the article."""
    name, off = "", False
    for key, value in HINT.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            got = [x.lower() for x in SPLIT.split(value) if x]
            name += "." + ".".join(got[:3]) if got else ""
            off = off or bool(SIDE.intersection(got) - ({"header"} if OWN_HEAD.intersection(got) else set()))
        elif key == "role":
            off = off or value.lower() in ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            off = True
    return name, off


def tags(page: str):
    """The page's texts and tags in order: (text, "", "", "") or ("", "/" or "", name, attributes), and where each ends. Elements of RAW are skipped whole."""
    pos, n, quotes = 0, len(page), True
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            yield page[pos:], "", "", ""
            return
        if at > pos:
            yield page[pos:at], "", "", ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = end + 3 if end >= 0 else n
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end = end if end >= 0 else n
            yield page[at + 9 : end], "", "", ""
            pos = end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            pos = end + 1 if end >= 0 else n
        elif not (m := NAME.match(page, at + 1)):
            yield "<", "", "", ""
            pos = at + 1
        else:
            got = ATTRIBUTES.match(page, m.end()) if quotes else None
            quotes = got is not None  # once a quotation mark stays open to the page's end, those after it do too
            end = got.end() if got else page.find(">", m.end())
            if end < 0:
                return
            pos, name = end + 1, m[2].lower()
            if name in RAW and not m[1]:
                stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, pos)
                if not stop:
                    return
                end = page.find(">", stop.start())
                pos = end + 1 if end >= 0 else n
            else:
                yield "", m[1], name, page[m.end() : end]


@dataclass
class Element:
    tag: str
    path: int
    number: int
    off: bool  # by its name, or one around it, not the article
    own: bool  # in an article or main element
    heading: bool
    below: int  # the place in the stack of the nearest element, itself included, that can be ended by another's start or stops that


@dataclass
class Page:
    """What nodes() finds: text nodes as (element's number, path, block, text), and for each element its parent, tag, last descendant; for each path whether its weight is 0."""

    texts: list[tuple[int, int, int, str]]
    parents: list[int]
    tags: list[str]
    lasts: list[int]
    off: list[bool]
    headings: list[bool]


def nodes(page: str) -> Page:
    got = Page([], [-1], [""], [0], [False], [False])
    paths: dict[tuple[int, str, bool], int] = {}
    stack, counts, block = [Element("", 0, 0, False, False, False, 0)], Counter(), 0

    def drop(k: int) -> None:
        for x in stack[k:]:
            counts[x.tag] -= 1
            got.lasts[x.number] = len(got.tags) - 1
        del stack[k:]

    for text, close, tag, attributes in tags(page):
        top = stack[-1]
        if not tag:
            got.texts.append((top.number, top.path, block, html.unescape(text)))
            continue
        if tag == "br":
            got.texts.append((top.number, top.path, block, " "))
            continue
        if tag in BLOCK:
            block += 1
        if close:
            if counts[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                drop(k)
            continue
        k = top.below
        while k > 0:
            x = stack[k].tag
            ends, stops = ENDS.get(x, ((), ()))
            if tag in ends:
                drop(k)
                break
            if x in stops or x not in ENDS or x in ("td", "th"):
                break
            k = stack[k - 1].below
        if tag in VOID or attributes.rstrip().endswith("/") and tag in ("path", "circle", "rect", "line"):
            continue
        top = stack[-1]
        name, side = marks(attributes)
        own = top.own or tag in ("article", "main")
        off = top.off or tag in NEVER or (tag == "header" and not top.own) or (side and tag not in ("html", "body", "article", "main"))
        key = (top.path, tag + name, off)
        if key not in paths:
            paths[key] = len(got.off)
            got.off.append(off)
        number = len(got.tags)
        got.parents.append(top.number)
        got.tags.append(tag)
        got.lasts.append(number)
        got.headings.append(top.heading or tag in HEADINGS)
        counts[tag] += 1
        stack.append(Element(tag, paths[key], number, off, own, got.headings[-1], len(stack) if tag in BLOCK or tag in ENDS else top.below))
    drop(1)
    got.lasts[0] = len(got.tags) - 1
    return got


def smooth(values: list[float]) -> list[float]:
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        got = [(w, values[i + k]) for k, w in zip(range(-RADIUS, RADIUS + 1), kernel, strict=True) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in got) / sum(w for w, _ in got))
    return out


def content_paths(got: Page) -> set[int]:
    """The paths whose fused ratios of text and punctuation, times their weight, stand out."""
    size: dict[int, list[int]] = {}
    for _, path, _, text in got.texts:
        if not got.off[path] and (s := text.strip()):
            x = size.setdefault(path, [0, 0, 0])
            x[0] += 1
            x[1] += len(s)
            x[2] += len(PUNCTUATION.findall(s))
    if not size:
        return set()
    text, signs = [v[1] / v[0] for v in size.values()], [(v[2] + 0.1) / v[0] for v in size.values()]
    fused = [math.sqrt(a * b * c * d) for a, b, c, d in zip(text, signs, smooth(text), smooth(signs), strict=True)]
    mean = sum(fused) / len(fused)
    cut = THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    cut = min(cut, max(fused))
    return {p for p, x in zip(size, fused, strict=True) if x >= cut}


def around(got: Page, number: int) -> list[int]:
    """The elements around one, from the root to itself."""
    out = [number]
    while out[-1]:
        out.append(got.parents[out[-1]])
    return out[::-1]


def main_text(page: str | None) -> str:
    got = nodes(page or "")
    paths = content_paths(got)
    content = [x for x in got.texts if x[1] in paths and x[3].strip()]
    if not content:
        return ""
    first, last = around(got, min(x[0] for x in content)), around(got, max(x[0] for x in content))
    common = [x for x, y in zip(first, last, strict=False) if x == y]
    named = [x for x in common if got.tags[x] in ("article", "main")]
    inside = (named or [x for x in common if got.tags[x] in HOLDERS or x == 0])[-1]
    chosen = {x[2] for x in content}
    end = max(chosen)
    blocks: dict[int, list[str]] = {}
    for number, path, block, text in got.texts:
        if path in paths or not got.off[path] and (block in chosen or block < end and inside <= number <= got.lasts[inside] and got.headings[number]):
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(s for x in blocks.values() if (s := " ".join("".join(x).split())))


def extract_batches(batches):
    for b in (part for whole in batches for part in slices(whole, 2)):
        texts = [main_text(x.decode("utf-8", "replace") if x is not None else None) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html")).mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
