"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of tags (with class) from the root
to its leaf. Per path two ratios are taken over its blocks: characters of text and
punctuation marks, each per block. Along the page both are smoothed over the
neighbouring blocks, fused as their product, and a path is content where the fused ratio
reaches ``THRESHOLD`` standard deviations. The smallest element that holds all blocks of the
content paths is the article, or the outermost <article> or <main> around it; its blocks,
except those inside boilerplate elements (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts), are the text. A form or a class word makes no element
boilerplate that holds most of the content paths' text; one that names comments does, unless
it holds all of it. White space inside a block is one space, blocks are joined by a blank line.

Edge cases: a null or empty page, and one without text, has an empty text and no paths;
unclosed and stray tags are tolerated; ties between paths need no rule, all that reach
the threshold count; repeated rows each give a row; an empty table gives an empty table.
Only the id, the URL and the page are read, so other columns may clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augmill.sources.tables import load, spread

from .registry import register

#: In standard deviations of the page's fused ratios.
THRESHOLD = 0.8
#: Weights of a block and of its neighbours when ratios are smoothed.
SMOOTH = (0.25, 0.5, 0.25)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "script style textarea title noscript iframe xmp noembed noframes head template svg math canvas object audio video map"
    " nav footer aside menu dialog button select option datalist input label fieldset legend".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th"
    " thead title tr ul".split())
#: Words of class, id and role that name boilerplate.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline captcha comment comments"
    " commentlist consent contentinfo complementary cookie cookies disqus discussion dialog disclaimer feedback footer footnav"
    " gdpr header hidden login masthead menu menubar modal nav navbar navigation navlinks newsletter notice notices notification"
    " overlay pager pagination popup privacy promo promoted promotion recommended related replies reply respond search share"
    " sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar tracking"
    " widget widgets".split())
#: Those of them whose text may well outweigh the article's.
TALK = frozenset("comment comments commentlist discussion disqus feedback replies reply respond".split())
#: A start tag that ends these open elements first, up to the given ancestors.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?¿¡…。、，；：！？]")


def _boilerplate(tag: str, attrs: str, inside_article: bool) -> tuple[bool, int, str]:
    """Whether the element is boilerplate in any case; whether it is unless it holds most (1) or all (2) of
    the content; its class for the path."""
    if tag in DROPPED:
        return True, 0, ""
    if not attrs.strip():
        return tag == "header" and not inside_article, int(tag == "form"), ""
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = " ".join(a.get(k, "") for k in ("class", "id", "role"))
    hints = HINTS.intersection(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names).lower())) if tag not in ("html", "body", "article", "main") else ()
    unless = 2 if not TALK.isdisjoint(hints) else int(bool(hints) or tag == "form")
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))
    return bool(hidden or (tag == "header" and not inside_article)), unless, a.get("class", "")


class Block:
    __slots__ = ("path", "chain", "text", "doubts", "main")

    def __init__(self, path, chain, text, doubts, main):
        self.path, self.chain, self.text, self.doubts, self.main = path, chain, text, doubts, main


def blocks(html: str) -> list[Block]:
    """The blocks of text outside what is boilerplate in any case, in page order, each with its tag path, the
    chain of its ancestor elements, those of them that may be boilerplate (serial number, 1 or 2), and the
    length of the chain down to the outermost <article> or <main> (0: none)."""
    out: list[Block] = []
    text: list[str] = []
    # open elements: (tag, path, serial number, boilerplate, inside an article, what may be boilerplate)
    stack: list[tuple[str, str, int, bool, bool, tuple]] = [("", "", 0, False, False, ())]
    serial = 0

    def flush():
        if text:
            plain = " ".join("".join(text).split())
            text.clear()
            if plain:
                k = len(stack) - 1
                while k and stack[k][0] not in BLOCKS:
                    k -= 1
                main = next((j + 1 for j, x in enumerate(stack[: k + 1]) if x[0] in ("article", "main")), 0)
                out.append(Block(stack[k][1], tuple(x[2] for x in stack[: k + 1]), plain, stack[-1][5], main))

    def add(chunk: str):
        if chunk and not stack[-1][3]:
            text.append(unescape(chunk))

    def close_to(k: int):
        if any(x[0] in BLOCKS or x[3] for x in stack[k:]) or stack[-1][5] != stack[k - 1][5]:
            flush()
        del stack[k:]

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] is not None and not stack[-1][3]:
                text.append(m[1])
            continue
        tag = tag.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close_to(k)
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            if tag in BLOCKS:
                flush()
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        if tag in CLOSES:
            ends, until = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in until:
                    break
                if stack[k][0] in ends:
                    close_to(k)
                    if tag != "tr":
                        break
        if tag in BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    close_to(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        top = stack[-1]
        inside = top[4] or tag in ("article", "main")
        bad, unless, name = _boilerplate(tag, m[4], top[4])
        if (bad or unless) and not top[3]:
            flush()
        if m[4].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        serial += 1
        stack.append((tag, f"{top[1]}/{tag}{'.' + '.'.join(name.split()) if name else ''}", serial, top[3] or bad, inside,
                      top[5] + ((serial, unless),) if unless else top[5]))
    del stack[1:]
    flush()
    return out


def content_paths(found: list[Block]) -> dict[str, float]:
    """The content paths of a page with their fused ratios."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        chars[b.path] += len(b.text)
        marks[b.path] += len(_PUNCT.findall(b.text))
        count[b.path] += 1
    ratio = lambda of: np.array([of[b.path] / count[b.path] for b in found])
    smooth = lambda v: np.convolve(np.pad(v, 1, "edge"), SMOOTH, "valid")
    fused = smooth(ratio(chars)) * smooth(ratio(marks) + 0.1)
    best: dict[str, float] = {}
    for b, x in zip(found, fused, strict=True):
        best[b.path] = max(best.get(b.path, 0.0), float(x))
    limit = min(THRESHOLD * float(fused.std()), max(best.values()))
    return {p: x for p, x in best.items() if x >= limit}


def clean(every: list[Block]) -> list[Block]:
    """The blocks outside boilerplate: what may be boilerplate is, unless it holds enough of the content paths' text."""
    if not any(b.doubts for b in every):
        return every
    paths = content_paths(every)
    weight: dict[tuple, int] = defaultdict(int)
    total = 0
    for b in every:
        if b.path in paths:
            total += len(b.text)
            for x in b.doubts:
                weight[x] += len(b.text)
    kept = {x for x, w in weight.items() if w == total or (x[1] == 1 and 2 * w > total)}
    return [b for b in every if kept.issuperset(b.doubts)]


def extract(html: str | None) -> tuple[str, list[str]]:
    """Main text and content paths of one page."""
    found = clean(blocks(html or ""))
    if not found:
        return "", []
    paths = content_paths(found)
    content = [b for b in found if b.path in paths]
    first, last = min(b.chain for b in content), max(b.chain for b in content)
    k = next((k for k, (x, y) in enumerate(zip(first, last, strict=False)) if x != y), min(len(first), len(last)))
    if 0 < content[0].main < k:
        k = content[0].main
    article = first[:k]
    inner = [b for b in found if b.chain[: len(article)] == article]
    while len(inner) == 1 and len(article) > 1:  # one paragraph isn't an article: take what encloses it
        article = article[:-1]
        inner = [b for b in found if b.chain[: len(article)] == article]
    return "\n\n".join(b.text for b in inner), sorted(paths)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, content_paths) of every row."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                got = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([t for t, _ in got], pa.string()),
                     pa.array([len(t) for t, _ in got], pa.int64()), pa.array([p for _, p in got], pa.list_(pa.string()))],
                    names=["page_id", "url", "text", "n_chars", "content_paths"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(
        work, "page_id bigint, url string, text string, n_chars bigint, content_paths array<string>")


@register("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spread(load(spark, sf_dir, "pages"), "page_id"))
