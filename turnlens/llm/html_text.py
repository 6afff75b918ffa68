"""Main text of web pages by the maximum-scoring contiguous region.

A page is read as a row of words and tags. A word scores the weight of its surroundings (the tags and
the class, id and role words of the elements around it), a tag costs something. One linear scan finds
the contiguous region with the highest sum; the words of the region whose own surroundings count as
content are the text.

Weights come from labelled pages: where a page marks its main text (``article`` or ``main``), the
words inside are content and all others are not. The weight of a mark is the logarithm of the ratio
of the two shares; marks in the lists below start with counts of their own, so that boilerplate
inside an article is known before it has been seen. The fit uses at most ``sample`` pages (those
with the smallest hash, copies once); every page is extracted whole.

An element with a listed mark is left out: comments, notices, adverts, menus and the like always, the
others as long as the mark's weight is negative. Not so the page's frame (html, body, main, an outer
article), of which listed words don't count at all. An element listed for its layout alone (a form, a
widget, a sidebar) that holds most of a page's words is not left out if nothing beside it holds text but
headings and elements that are left out. Compound class words have weights of their own, which decide
once labelled pages have them.

A page is read once, in time linear in its length however deep its elements lie: every element takes
over the state of the one around it.

Null and empty pages, and pages without words, give an empty text. Unclosed elements end with their
parent. Repeated rows are extracted each for itself, an empty table gives no rows, extra columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import bounded_batches

#: Pages that the weights are fitted on, at most.
SAMPLE = 5000

# HTML elements without content, elements that don't break a line of text, elements
# whose content is no text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small
                span strike strong sub sup time tt u var wbr""".split())
RAW = "script|style|noscript|template|textarea|title|svg|iframe|select|object|canvas"
# Marks of boilerplate and of content (tag names; words of class, id and role).
BOILERPLATE = set("""nav footer aside form button menu dialog fieldset label .nav .navbar .navigation .menu .footer
    .header .masthead .sidebar .aside .ad .ads .advert .advertisement .adverts .sponsor .sponsored .promo .promotion
    .banner .cookie .cookies .consent .notice .notices .alert .popup .modal .overlay .subscribe .newsletter .signup
    .login .share .sharing .social .related .recommended .recommendations .breadcrumb .breadcrumbs .pagination .pager
    .comment .comments .commentlist .reply .replies .respond .disqus .search .toolbar .tags .widget .copyright .legal
    .skip .complementary .contentinfo .form""".split())
CONTENT = set("article main p h1 h2 h3 h4 h5 h6 blockquote pre .article .content .post .entry .story .main .body".split())
# Elements that frame a page, first words of compound class words that tell
# a state or a subject, not what the element is.
FRAME = set("html body main".split())
STATES = set("has no not with without is category tag format status type".split())
# Marks of boilerplate whatever the weights say, and marks of mere layout.
ALWAYS = set("""nav footer menu .nav .navbar .navigation .menu .footer .ad .ads .advert .advertisement .adverts .sponsor .sponsored
    .promo .promotion .cookie .cookies .consent .notice .notices .alert .popup .subscribe .newsletter .signup .login
    .comment .comments .commentlist .reply .replies .respond .disqus""".split())
LAYOUT = set("form fieldset label aside .form .widget .sidebar .aside .overlay".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words that a listed mark counts before anything is seen, and the range of its weight, of the weight
#: of another class word and of another tag (tags such as div and li serve both sides).
PRIOR, LIMIT, WORD_LIMIT, TAG_LIMIT = 2000, 4.0, 2.0, 0.4
#: Within the region, stretches with a lower score are left out.
LEAST = -1.0
#: What a word scores before its surroundings count, the cost of a tag, and the most that one stretch of
#: words outside the content costs.
WORD, TAG_COST, STRETCH = 1.0, 0.2, 20

# The rest of a tag, where a quote opens only after an equals sign; the same of a self-closed one (a slash at the end of
# an unquoted value closes nothing).
REST = r"""(?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
CLOSED = r"""(?:\s+[^\s=>/"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*(?=\s)))?)*\s*/>"""
PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:{CLOSED}|{REST}(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z))"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>{REST})(?:>|\Z)",
    re.S | re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MARK_WORD = re.compile(r"[a-z]+")


def marks_of(name: str, attributes: str) -> list[str]:
    """Marks of an element: its name, the words of its class, id and role, and compounds of them."""
    marks = [name]
    if attributes and "=" in attributes:
        for groups in ATTRIBUTE.findall(attributes):
            for value in "".join(groups).lower().split():
                words = MARK_WORD.findall(value)
                if len(words) > 1:
                    marks.append(".-" + "-".join(words))
                    if words[0] in STATES or "." + words[0] in CONTENT and words[1:] == ["header"]:
                        continue
                marks.extend("." + w for w in words)
    return marks


class Element:
    """An element of a page: its marks, the element around it (a number, -1: none), whether marked main text lies around."""

    __slots__ = ("marks", "around", "inside")

    def __init__(self, marks: list[str], around: int, inside: bool):
        self.marks, self.around, self.inside = marks, around, inside

    @property
    def main(self) -> bool:
        return self.inside or self.marks[0] in ("article", "main")


class Stretch:
    """A stretch of text: its element (-1: none), whether it starts a block, tags before it."""

    __slots__ = ("text", "element", "breaks", "tags")

    def __init__(self, text: str, element: int, breaks: bool, tags: int):
        self.text, self.element, self.breaks, self.tags = text, element, breaks, tags


def parsed(page: str) -> tuple[list[Element], list[Stretch]]:
    """The elements of a page in the order in which they open, and its stretches of text."""
    elements: list[Element] = []
    out: list[Stretch] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    at, breaks, tags = 0, True, 0

    def text_until(end: int) -> None:
        nonlocal breaks, tags
        if end > at:
            out.append(Stretch(page[at:end], stack[-1][1] if stack else -1, breaks, tags))
            breaks, tags = False, 0

    def close(depth: int) -> None:
        for name, _ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]

    for m in PIECES.finditer(page):
        text_until(m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            breaks = breaks or bool(m["raw"])
            tags += bool(m["raw"])
            continue
        tags += 1
        breaks = breaks or name not in INLINE
        if m["end"]:
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth)
        elif name not in VOID and not m["rest"].endswith("/"):
            if name not in INLINE and stack:  # a block ends an open paragraph, an item ends its neighbour
                for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                    if stack[i][0] == "p" or stack[i][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            around = stack[-1][1] if stack else -1
            elements.append(Element(marks_of(name, m["rest"]), around, around >= 0 and elements[around].main))
            stack.append((name, len(elements) - 1))
            opened[name] += 1
    text_until(len(page))
    return elements, out


def listed_for(e: Element, weight: dict[str, float]) -> set[str]:
    """The marks for which an element is boilerplate; empty if it is none. A header outside the article is one."""
    own = e.marks
    if own[0] in FRAME or own[0] == "article" and not e.inside:
        return set()
    if own[0] == "header" and not e.inside:
        return {"header"}
    # compound words that labelled pages have decide for themselves
    if any(m.startswith(".-") and weight.get(m, 0.0) > 0 for m in own):
        return set()
    return {m for m in own if m in ALWAYS or m in BOILERPLATE and weight.get(m, -LIMIT) < 0}


def left_out(elements: list[Element], words: list[int], weight: dict[str, float]) -> tuple[list[bool], int]:
    """Whether each element is boilerplate itself, and the element rescued by its size (-1: none).

    ``words`` are the words directly in each element. An element listed for its layout alone is rescued if it
    holds most of the words and no others but headings lie outside all listed elements.
    """
    reasons = [listed_for(e, weight) for e in elements]
    out = [bool(r) for r in reasons]
    held = list(words)
    for i in range(len(elements) - 1, -1, -1):
        if elements[i].around >= 0:
            held[elements[i].around] += held[i]
    within, heading, plain, total = [False] * len(elements), [False] * len(elements), 0, sum(words)
    for i, e in enumerate(elements):
        within[i] = out[i] or e.around >= 0 and within[e.around]
        heading[i] = e.marks[0] in HEADINGS or e.around >= 0 and heading[e.around]
        if words[i] and not within[i] and not heading[i]:
            plain += words[i]
    if plain == 0:
        for i, r in enumerate(reasons):
            if r and r <= LAYOUT and 2 * held[i] > total and not (elements[i].around >= 0 and within[elements[i].around]):
                return out, i
    return out, -1


def counted(e: Element, rescued: bool) -> list[str]:
    """The marks of an element that score: of a frame those that aren't listed, of a rescued element no layout."""
    if e.marks[0] in FRAME or e.marks[0] == "article" and not e.inside:
        return [m for m in e.marks if m not in BOILERPLATE]
    return [m for m in e.marks if m not in LAYOUT] if rescued else e.marks


def scores(elements: list[Element], words: list[int], weight: dict[str, float]) -> tuple[list[float], list[bool]]:
    """For each element the weight of all different marks around its text, and whether boilerplate lies around it."""
    out, rescued = left_out(elements, words, weight)
    if rescued >= 0:
        out[rescued] = False
    around: Counter = Counter()  # marks of the open elements
    stack: list[tuple[int, set[str]]] = []
    total = [0.0] * len(elements)
    for i, e in enumerate(elements):
        while stack and stack[-1][0] != e.around:
            around.subtract(stack.pop()[1])
        own = set(counted(e, i == rescued))
        before = total[e.around] if e.around >= 0 else 0.0
        total[i] = before + sum(weight.get(m, 0.0) for m in sorted(own) if not around[m])
        around.update(own)
        stack.append((i, own))
        out[i] = out[i] or e.around >= 0 and out[e.around]
    return total, out


def page_counts(page: str) -> tuple[Counter, Counter]:
    """Words around each mark, within the marked main text and outside it; empty without such a mark."""
    elements, stretches = parsed(page)
    good, bad = Counter(), Counter()
    inside, outside = [0] * len(elements), [0] * len(elements)
    marked = False
    for s in stretches:
        n = len(s.text.split())
        if n and s.element >= 0:
            main = elements[s.element].main
            marked = marked or main
            (inside if main else outside)[s.element] += n
    if not marked:
        return good, bad
    for side, into in ((inside, good), (outside, bad)):
        held = list(side)
        for i in range(len(elements) - 1, -1, -1):
            if elements[i].around >= 0:
                held[elements[i].around] += held[i]
        # a mark that stands around several times counts each word once: at the outermost element that has it
        around: Counter = Counter()
        stack: list[tuple[int, set[str]]] = []
        for i, e in enumerate(elements):
            while stack and stack[-1][0] != e.around:
                around.subtract(stack.pop()[1])
            own = set(e.marks)
            for m in own:
                if not around[m] and held[i]:
                    into[m] += held[i]
            around.update(own)
            stack.append((i, own))
    return good, bad


def weights(good: dict[str, int], bad: dict[str, int]) -> dict[str, float]:
    """Weight of each mark: logarithm of the ratio of its shares of content and other words, limited."""
    all_good, all_bad = sum(good.values()) + PRIOR, sum(bad.values()) + PRIOR
    out = {}
    for mark in good.keys() | bad.keys() | BOILERPLATE | CONTENT:
        g = good.get(mark, 0) + (PRIOR if mark in CONTENT else 0) + 1
        b = bad.get(mark, 0) + (PRIOR if mark in BOILERPLATE else 0) + 1
        most = LIMIT if mark in BOILERPLATE or mark in CONTENT else WORD_LIMIT if mark[0] == "." else TAG_LIMIT
        out[mark] = max(-most, min(most, math.log(g / all_good) - math.log(b / all_bad)))
    return out


def main_text(page: str, weight: dict[str, float]) -> str:
    """The text of the best region."""
    elements, stretches = parsed(page)
    held = [0] * len(elements)
    for s in stretches:
        if s.element >= 0:
            held[s.element] += len(s.text.split())
    around, boilerplate = scores(elements, held, weight)
    items = []
    total = best = 0.0
    first, span = 0, (0, 0)
    for s in stretches:
        text = html.unescape(s.text)
        words = len(text.split())
        score = WORD + (around[s.element] if s.element >= 0 else 0.0)
        out = s.element >= 0 and boilerplate[s.element]
        score = -abs(score) if out else max(-LIMIT, min(LIMIT, score))
        items.append((text, s.breaks, words > 0 and not out and score > LEAST))
        total -= TAG_COST * s.tags if first < len(items) - 1 else 0.0
        if total < 0:
            total, first = 0.0, len(items) - 1
        total += score * words if score > 0 else max(score * words, -STRETCH)
        if total < 0:
            total, first = 0.0, len(items)
        elif total > best:
            best, span = total, (first, len(items))
    blocks: list[list[str]] = []
    for text, breaks, keep in items[span[0]:span[1]]:
        if breaks or not blocks:
            blocks.append([])
        if keep or not text.strip():
            blocks[-1].append(text)
    return " ".join(b for b in (" ".join("".join(parts).split()) for parts in blocks) if b)


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` different pages, those with the smallest hash of id and page."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(html_col).cast("string"))
    rows = pages.where(F.col(html_col).isNotNull()).select(key.alias("key"), F.col(html_col).cast("string").alias("html"))
    keys = rows.select("key").distinct().orderBy("key").limit(sample)  # at most ``sample`` numbers
    chosen = rows.join(F.broadcast(keys), "key", "left_semi").dropDuplicates(["key"]).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = Counter(), Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                g, n = page_counts(page or "")
                good.update(g)
                bad.update(n)
        names = sorted(good.keys() | bad.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([good[n] for n in names], pa.int64()),
                                          pa.array([bad[n] for n in names], pa.int64())], names=["mark", "good", "bad"])

    rows = chosen.mapInArrow(count, "mark string, good bigint, bad bigint").groupBy("mark") \
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")) \
        .orderBy(F.desc(F.col("good") + F.col("bad")), "mark").limit(sample).collect()
    return weights({r["mark"]: r["good"] for r in rows}, {r["mark"]: r["bad"] for r in rows})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 sample: int = SAMPLE) -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every row."""
    bounded_batches(pages.sparkSession)
    weight = fit_weights(pages, id_col, html_col, sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, weight) if p else "" for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")) \
        .mapInArrow(extract, f"id {kind}, url string, text string") \
        .select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                F.length("text").cast("long").alias("n_chars"))
