"""Main text of web pages by two passes of block rules.

A page becomes blocks of text, each with its length, the share of it in links, the share of its words that are
stop words, and what holds it.  The first pass decides the clear blocks by density and length; the second lets the
undecided ones take the label of the nearest decided neighbours, those in the same container first.  Where a block
stands is one feature among these: an article element lowers the density that is asked for, and text outside of the
articles has to be denser and longer where the articles hold most of what was accepted.  Prose that isn't the
article's (sidebars, notices, readers' comments) differs from it only by the container that holds it: such elements
and class names take their blocks out, unless hardly any text is left then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.bpe import slices, tidy

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be by for from has have in is it of on or that the this to was were with
    als auch auf aus bei das dem den der des die ein eine für im ist mit nicht sich sie und von zu zum zur
    au aux avec ce dans de des du elle en est et la le les ne par pas pour que qui sur un une
    al como con del el ella en es esta la las lo los más no para por que se su un una y""".split()
)
#: Elements whose content is never part of an article.
OUTSIDE = frozenset("nav footer aside form menu dialog button select option label datalist head title iframe object svg audio video canvas map".split())
#: Elements whose content is not text.
RAW = "script|style|noscript|template|textarea|xmp|noembed|noframes"
#: Elements that say where the article is.
INSIDE = frozenset(["article", "main"])
#: Elements whose class, id and role may name page furniture.
NAMED = frozenset("div section header table ul ol dl blockquote figure details fieldset".split())
#: Elements that nest and are followed; all others only break blocks or don't.
NESTING = OUTSIDE | INSIDE | frozenset("html body div section header table ul ol dl blockquote figure details fieldset".split())
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins del kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Names that stand for page furniture, and words that may stand beside these in one name ("site-footer").
FURNITURE = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent
    contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager
    pagination popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored
    subscribe subscription toolbar widget widgets""".split()
)
BESIDE = frozenset(
    """area articles bar block body bottom box buttons container entry form global head header icons inner item items left links
    list main message page panel post posts primary right secondary section site slot stories thread top unit wrap wrapper""".split()
)

_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """One block of text and what holds it."""

    text: str
    link_chars: int
    heading: bool
    article: bool  #: in an article or main element
    mark: str  #: why it may be page furniture: "element", "form", "name", "header", or "" for no reason
    depth: int  #: of the container that holds it
    dip: int  #: depth of the smallest container that holds both it and the block before it
    under: int = 0  #: of a block in a header: depth of the container that holds the header
    label: int = 0  #: 1 main text, -1 not, 0 undecided


def names_furniture(names: str, furniture: frozenset[str] = FURNITURE, beside: frozenset[str] = BESIDE) -> bool:
    """Whether one of the names, as a whole, stands for page furniture: "site-footer" does, "no-sidebar" doesn't."""
    for name in names.split():
        parts = [w for w in _PART.findall(name) if len(w) > 1]
        words = [w.lower() for w in parts]
        if any(w in furniture for w in words) and all(w in furniture or w in beside for w in words):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """The blocks of a page in page order; character references are decoded and white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, bool, str]] = []  # name, and what held before it: article, mark
    article, mark, links, dip, under = False, "", 0, 0, 0
    parts: list[str] = []
    linked: list[str] = []
    heading = False

    def close() -> None:
        nonlocal dip
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                link_chars = min(len(text), len(" ".join(unescape("".join(linked)).split())))
                out.append(Block(text, link_chars, heading, article, mark, len(stack), min(dip, len(stack)), under))
                dip = len(stack)
            parts.clear()
            linked.clear()

    def say(piece: str) -> None:
        if piece:
            parts.append(piece)
            if links:
                linked.append(piece)

    at = 0
    for m in _TOKEN.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, ending = name.lower(), bool(m["end"] or m["end2"])
        if name == "a":
            links = 0 if ending else 1
        if name in INLINE:
            continue
        close()
        links = 0 if name in NESTING else links
        heading = name in ("h1", "h2", "h3", "h4", "h5", "h6") and not ending
        if name not in NESTING:
            continue
        rest = m["rest"] or m["rest2"] or ""
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, article, mark = stack[k]
                    del stack[k:]
                    dip = min(dip, k)
                    break
        elif not rest.endswith("/"):
            top = not stack or stack[-1][0] in ("html", "body")
            stack.append((name, article, mark))
            if name == "form":
                mark = mark or "form"
            elif name in OUTSIDE or (name == "header" and top):
                mark = "element"
            elif name == "header" and not article and not mark:
                mark, under = "header", len(stack) - 1
            elif name in INSIDE:
                article = article or not mark
            elif name in NAMED and mark in ("", "form") and any(names_furniture(a[1] or a[2] or a[3] or "") for a in _ATTRIBUTE.finditer(rest)):
                mark = "name"
    say(html[at:])
    close()
    return out


def first_pass(found: list[Block], stop_words: frozenset[str], short: int, long: int, links: float, density: float) -> None:
    """Labels what is clear from a block's own length and densities."""

    def size(some: Iterator[Block]) -> int:
        return sum(len(b.text) for b in some)

    stops = []
    for b in found:
        words = _WORD.findall(b.text.lower())
        stops.append(sum(w in stop_words for w in words) / max(1, len(words)))
        if b.link_chars > links * len(b.text):
            b.label = -1
        elif len(b.text) >= short and not b.heading and stops[-1] >= (density / 2 if b.article else density):
            b.label = 1
    # the weakest evidence goes first where it would leave hardly any text: names, then forms
    for reason in ("name", "form"):
        free = [b for b in found if not b.mark]
        held = size(b for b in found if b.mark == reason and b.label == 1)
        if held >= long and not any(b.label == 1 for b in free) and held > 4 * size(b for b in free if b.label == 0):
            for b in found:
                b.mark = "" if b.mark == reason else b.mark
    # a header belongs to the text if its own container holds prose after it, as a page's header's doesn't
    prose: list[int] = []  # depths of the containers, of those around a block, that directly hold some after it
    for k in range(len(found) - 1, -1, -1):
        while prose and k + 1 < len(found) and prose[-1] > found[k + 1].dip:
            prose.pop()
        b = found[k]
        if b.mark == "header":
            b.mark = "" if b.under in prose else b.mark
        elif b.label == 1 and not b.mark and (not prose or prose[-1] < b.depth):
            prose.append(b.depth)
    for b in found:
        if b.mark:
            b.label = -1
    inside = size(b for b in found if b.label == 1 and b.article)
    outside = size(b for b in found if b.label == 1 and not b.article)
    if inside > outside or not outside and any(b.article and b.label == 0 for b in found):
        for b, s in zip(found, stops, strict=True):
            if not b.article and (b.label == 0 or len(b.text) < long or s < 2 * density):
                b.label = -1


def second_pass(found: list[Block], reach: int) -> None:
    """Gives undecided blocks the label of their nearest decided neighbours.

    Page furniture is no neighbour within a container.  Of a neighbour before and one after, that in the smaller common
    container counts, then the nearer one, at equal distance the main text.  Beyond the block's own container, both
    sides and furniture too, no farther than `reach` blocks, have to agree, and headings look ahead only.  In an
    article, nothing but a link list in its own container speaks against a block.  Where the page has no block of main text, all that is
    undecided is.
    """
    if not any(b.label > 0 for b in found):
        for b in found:
            b.label = 2 if b.label == 0 else b.label
        return
    n = len(found)
    own: list[list[tuple[int, int]]] = [[] for _ in found]  # (distance, label) within the block's container
    beyond: list[list[tuple[int, int]]] = [[] for _ in found]
    for ahead in (False, True):
        voter, low, other = None, 0, None
        for k in range(n - 1, -1, -1) if ahead else range(n):
            b = found[k]
            # the containers left between the former block and this one
            step = (found[k + 1].dip if k + 1 < n else 0) if ahead else b.dip
            low = min(low, step)
            if b.label:
                other = k
                if not b.mark:
                    voter, low = k, b.depth
                continue
            if voter is not None and min(low, b.depth) == b.depth:
                own[k].append((abs(k - voter), found[voter].label))
            elif other is not None and (ahead or not b.heading) and abs(k - other) <= reach:
                beyond[k].append((abs(k - other), found[other].label))
    for k, b in enumerate(found):
        if b.label:
            continue
        near = min(d for d, _ in own[k]) if own[k] else 0
        if own[k]:
            good = any(s > 0 for d, s in own[k] if d == near)
        elif b.article:
            good = True
        else:
            near = min((d for d, _ in beyond[k]), default=0)
            good = bool(beyond[k]) and all(s > 0 for d, s in beyond[k] if d == near)
        b.label = 2 if good else -1


def extract(html: str | None, stop_words: frozenset[str] = STOP_WORDS, short: int = 70, long: int = 200, links: float = 0.5, density: float = 0.12, reach: int = 3) -> str:
    """The main text, blocks in page order joined by one space; empty for null, empty or text-free pages.

    short, long: characters that a block of prose has at least, and that weaker evidence asks for.  links: the share of
    a block in links from which on it is a link list.  density: the share of stop words that prose has at least.
    """
    if not html:
        return ""
    found = blocks(html)
    first_pass(found, stop_words, short, long, links, density)
    second_pass(found, reach)
    return " ".join(b.text for b in found if b.label > 0)


def extract_text(df: DataFrame, html: str = "html", out: str = "text", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """Adds the main text of each page; never null.

    Null and empty pages have an empty text; pages of any length are read whole, in time that grows with their length.
    A column of the name `out` is replaced, all others are carried; repeated rows are independent.
    """
    df = df.drop(out) if out != html else df
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, html):
            texts = pa.array([extract(h, stop_words) for h in b.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), texts], schema.names)
        tidy()

    return df.mapInArrow(run, schema)
