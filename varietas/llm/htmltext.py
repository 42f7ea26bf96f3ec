"""Main text of web pages by tag-path ratios.

Every block of text on a page hangs on a path of tags from the root. Text length and punctuation are
summed per path and divided by the path's number of blocks; both ratios are smoothed along the page
among blocks that stand near each other in the tree, and fused with the path's share of the page's text into one
score. Paths whose score exceeds a share of the page's spread are content, and their blocks are chosen.
A block on another path goes with its siblings, or with those of what holds it, where most of their
text is chosen: a heading, a short line, a list.

What a page marks as menu, header, footer, sidebar, notice, advert, form or reader comment is input of
the ratios: such text counts nothing in them, link text little, and text outside the article or main
element of a page that has one a tenth. Words in class or id are no mark on what holds the article itself.
Scripts, styles, markup and hidden elements are no text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Fixed values of HTML: elements whose text is no text, that have no end, that form blocks, and that
#: end an open paragraph.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Elements, roles and words in class or id that mark what is not the article.
LEFT_OUT = frozenset("head nav header footer aside form menu button select dialog object audio video canvas label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments respond reply replies discussion disqus form search widget toolbar pagination pager tags toc skip".split()
)
#: Of these, the words for readers' comments, which may be longer than the article, and for headings' places.
REMARKS = frozenset("comment comments respond reply replies discussion disqus".split())
HEADER_MARKS = frozenset(("header", "masthead", "banner"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words before a mark, after it, and before a header, with which a name tells of a layout or of the article.
LAYOUT_BEFORE = frozenset("has with no not non without".split())
LAYOUT_AFTER = frozenset("enabled disabled open closed free layout".split())
ARTICLE_WORDS = frozenset("article content entry post story".split())
CONTAINERS = frozenset(("article", "main"))
PUNCTUATION = re.compile(r"[,.;:!?…。、，！？；：]")

#: Share of the scores' standard deviation that a path must exceed, and of the siblings' text with which a block goes.
SPREAD, HELD = 0.5, 0.5
#: Weights of link text, and of text outside the article.
LINK, OUTSIDE = 0.1, 0.1
#: How much blocks smooth each other whose parents are the same, one inside the other, or apart.
NEARNESS = (1.0, 0.5, 0.1)
#: Share of the page's text, comments aside, above which a marked element is the page itself, and the same for one of comments or
#: one whose whole name is a mark.
MOST, NEARLY_ALL = 0.5, 0.9
#: Weights of smoothing along the page.
KERNEL = np.exp(-np.arange(3) ** 2 / 2.0)


@dataclass
class Node:
    """A piece of text: its elements from the root (numbers), its tag path, its block, and if it is marked as no content."""

    chain: tuple[int, ...]
    path: str
    block: int
    text: str
    weak: bool


@dataclass
class Block:
    """A run of text between the borders of blocks: number, path and elements down to the block, weight of its text, punctuation."""

    number: int
    path: str
    chain: tuple[int, ...]
    size: float
    weight: float
    marks: float


SHOWN, WEAK, HIDDEN = 0, 1, 2


def _standing(tag: str, attributes: str, inside: list[tuple]) -> int:
    """If an element is shown, marked by its tag or role as no content, or hidden."""
    weak = tag in LEFT_OUT and not (tag == "header" and any(t in CONTAINERS for t, *_ in inside))
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HIDDEN
        weak = weak or name == "role" and value in ROLES
    return WEAK if weak else SHOWN


def _marks(tag: str, attributes: str, inside: list[tuple]) -> dict[str, bool]:
    """The words in class and id that mark an element as something else than the article, and if they are a whole name."""
    found: dict[str, bool] = {}
    if tag in ("html", "body", *CONTAINERS):
        return found
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() not in ("class", "id"):
            continue
        for token in next((v for v in values if v), "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            for i, word in enumerate(words):
                if word not in MARKS or LAYOUT_BEFORE.intersection(words[:i]) or LAYOUT_AFTER.intersection(words[i + 1 :]):
                    continue
                if word in HEADER_MARKS and (tag in HEADINGS or ARTICLE_WORDS.intersection(words[:i]) or any(t in CONTAINERS for t, *_ in inside)):
                    continue
                found[word] = found.get(word, False) or token == word
    return found


def _not_content(nodes: list[Node], marked: dict[int, tuple[bool, bool]]) -> set[int]:
    """The ``marked`` elements (number: of comments, by a whole name) save those that hold the article.

    An element holds it if it has the only article or main elements, or, on a page without such elsewhere,
    most of the text that isn't in comments; one of comments only if it has the page's h1 or main element, or
    nearly all text.
    """
    inside: dict[int, int] = {}
    holds: dict[int, set[str]] = {}
    full = []
    for n in nodes:
        if n.weak or n.text.isspace():
            continue
        tags, own = n.path.split("/"), [(k, e) for k, e in enumerate(n.chain) if e in marked]
        full.append((n, len(n.text.strip()), [e for _, e in own], CONTAINERS.isdisjoint(tags)))
        for k, e in own:
            inside[e] = inside.get(e, 0) + full[-1][1]
            holds.setdefault(e, set()).update(tags[k + 1 :])
    total = sum(length for _, length, _, _ in full)
    free = any(not (bare or own) for _, _, own, bare in full)
    out = set(inside)
    for e in inside:
        if marked[e][0] and (not holds[e].isdisjoint(("h1", "main")) or not free and inside[e] > NEARLY_ALL * total):
            out.discard(e)
    remarks = {e for e in out if marked[e][0]}
    spoken: dict[int, int] = {}
    total = 0
    for _, length, own, _ in full:
        if remarks.isdisjoint(own):
            total += length
            for e in own:
                spoken[e] = spoken.get(e, 0) + length
    articles = [own for _, _, own, bare in full if not bare and remarks.isdisjoint(own)]
    own_share = {e: NEARLY_ALL if marked[e][1] else MOST for e in out - remarks}
    held = [e for e in own_share if not holds[e].isdisjoint(CONTAINERS) or spoken.get(e, 0) > own_share[e] * total]
    for e in sorted(held, key=lambda e: (-inside[e], e)):
        if any(out.isdisjoint(own) for own in articles):
            break
        out.discard(e)
    return out


def text_nodes(page: str) -> list[Node]:
    """Text nodes of a page in page order, references decoded."""
    nodes: list[Node] = []
    marked: dict[int, tuple[bool, bool]] = {}
    stack: list[tuple[str, int, int]] = []
    number = block = at = 0
    skip_to = None
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not (stack and stack[-1][2] == HIDDEN):
            _add(nodes, stack, block, page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            names = [t for t, *_ in stack]
            if tag in names:
                k = len(names) - 1 - names[::-1].index(tag)
                del stack[k:]
            if tag in BLOCK:
                block += 1
            continue
        if tag in RAW:
            skip_to = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = skip_to.end() if skip_to else len(page)
            continue
        if tag in BLOCK:
            block += 1
            _end_paragraph(stack)
        for other in SELF_CLOSING.get(tag, ()):
            _end_sibling(stack, other, tag)
        if tag in VOID:
            if tag == "br" and not (stack and stack[-1][2] == HIDDEN):
                _add(nodes, stack, block, " ")
            continue
        number += 1
        out = max(stack[-1][2] if stack else SHOWN, _standing(tag, m[3], stack))
        if out == SHOWN and (marks := _marks(tag, m[3], stack)):
            marked[number] = marks.keys() <= REMARKS, any(marks.values())
        stack.append((tag, number, out))
    if at < len(page) and not (stack and stack[-1][2] == HIDDEN):
        _add(nodes, stack, block, page[at:])
    for out in [_not_content(nodes, marked)] if marked else []:
        for n in nodes:
            n.weak = n.weak or not out.isdisjoint(n.chain)
    return nodes


def _end_paragraph(stack: list[tuple]) -> None:
    """A block that begins in an open paragraph ends it, with what is open in it."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == "p":
            del stack[k:]
            return
        if stack[k][0] in BLOCK:
            return


def _end_sibling(stack: list[tuple], other: str, tag: str) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == other:
            del stack[k:]
            return
        if stack[k][0] in ("ul", "ol", "dl", "table", "select") or stack[k][0] == "tr" and tag in ("td", "th"):
            return


def _add(nodes: list[Node], stack: list[tuple], block: int, raw: str) -> None:
    nodes.append(Node(tuple(n for _, n, _ in stack), "/".join(t for t, *_ in stack), block, entities.unescape(raw), bool(stack) and stack[-1][2] == WEAK))


def blocks_of(nodes: list[Node]) -> list[Block]:
    """The blocks that hold text. Marked text weighs nothing, link text little."""
    out: list[Block] = []
    inside = any(not (n.weak or n.text.isspace()) and not CONTAINERS.isdisjoint(n.path.split("/")) for n in nodes)
    for n in nodes:
        tags = n.path.split("/") if n.path else []
        own = [(e, t) for e, t in zip(n.chain, tags, strict=True) if t in BLOCK]
        size = float(len("".join(n.text.split())))
        weight = 0.0 if n.weak else (LINK if "a" in tags else 1.0) * (OUTSIDE if inside and CONTAINERS.isdisjoint(tags) else 1.0)
        if not size:
            continue
        if not out or out[-1].number != n.block:
            out.append(Block(n.block, "/".join(t for _, t in own) + ("!" if n.weak else ""), tuple(e for e, _ in own), 0.0, 0.0, 0.0))
        block = out[-1]
        block.size, block.weight = block.size + size, block.weight + weight * size
        block.marks += weight * len(PUNCTUATION.findall(n.text))
    return out


def path_scores(blocks: list[Block]) -> dict[str, float]:
    """The fused score of each tag path."""
    paths: dict[str, list[int]] = {}
    for i, b in enumerate(blocks):
        paths.setdefault(b.path, []).append(i)
    text, marks = np.empty(len(blocks)), np.empty(len(blocks))
    for own in paths.values():
        text[own], marks[own] = sum(blocks[i].weight for i in own) / len(own), sum(blocks[i].marks for i in own) / len(own)
    nearness = _nearness(blocks)
    score = _smooth(text, nearness) * (1 + _smooth(marks, nearness))
    score[[b.weight == 0 for b in blocks]] = 0
    total = sum(b.weight for b in blocks) or 1.0
    return {p: float(score[own].mean()) * math.sqrt(sum(blocks[i].weight for i in own) / total) for p, own in paths.items()}


def content_blocks(blocks: list[Block]) -> set[int]:
    """Numbers of the blocks on content paths, and of those that go with their siblings."""
    score = path_scores(blocks)
    cut = SPREAD * float(np.std(list(score.values()))) if score else 0.0
    chosen = {b.number for b in blocks if score[b.path] > 0 and score[b.path] >= cut}
    sums: dict[int, list[float]] = {}
    for b in blocks:
        if b.weight:
            own = sums.setdefault(_parent(b), [0.0, 0.0])
            own[0] += b.size
            own[1] += b.size * (b.number in chosen)
    with_ = {e for e, (all_, own) in sums.items() if own >= HELD * all_ > 0}
    for b in blocks:
        above = b.chain[1:-1] if b.path.startswith("body") else b.chain[2:-1]
        if b.weight and (_parent(b) in with_ or not with_.isdisjoint(above)):
            chosen.add(b.number)
    return chosen


def _parent(b: Block) -> int:
    return b.chain[-2] if len(b.chain) > 1 else 0


def _nearness(blocks: list[Block]) -> np.ndarray:
    """For each block and the two after it, how near they are in the tree."""
    out = np.zeros((len(blocks), 3))
    out[:, 0] = 1.0
    for k in (1, 2):
        for i, (a, b) in enumerate(zip(blocks, blocks[k:], strict=False)):
            own, other = _parent(a), _parent(b)
            nested = own in b.chain[2:] or other in a.chain[2:]
            out[i, k] = NEARNESS[0] if own == other and len(a.chain) > 1 else NEARNESS[1] if nested else NEARNESS[2]
    return out


def _smooth(values: np.ndarray, nearness: np.ndarray) -> np.ndarray:
    """Gaussian means of two neighbours on either side, by nearness."""
    total, weight = values * KERNEL[0], np.full(len(values), KERNEL[0])
    for k in range(1, min(3, len(values))):
        w = KERNEL[k] * nearness[:-k, k]
        total[k:] += w * values[:-k]
        weight[k:] += w
        total[:-k] += w * values[k:]
        weight[:-k] += w
    return total / weight


def main_text(page: str) -> str:
    """The content's blocks, white space in each made single blanks, joined by line ends."""
    nodes = text_nodes(page)
    chosen = content_blocks(blocks_of(nodes))
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if n.block in chosen:
            blocks.setdefault(n.block, []).append(n.text)
    lines = (" ".join("".join(b).split()) for _, b in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages`` (page_id, url, html).

    Defined cases: a null or empty page, and one without content, gives an empty text; a page without
    tags is one block; unclosed elements end with what encloses them, an unclosed comment, script or
    tag with the page; null ids and urls pass through, repeated rows are rows like others; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(p) for p in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
