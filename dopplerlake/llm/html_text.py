"""Main-text extraction by line-block distribution (operator 7).

Method: markup is stripped to lines, one for each block element; scripts, styles, menus, forms and the other elements that
a main text is without leave empty lines. The length of a line is that of its text less twice that of its links. Lengths are
summed over sliding windows of `WINDOW` lines: a region opens at a surge, where the sum reaches `SURGE` times the geometric
mean of the page's lines (or the largest sum, if none does), and closes at a dive, where it falls below `DIVE` times that
mean. The regions, cut back to lines with half the length of the longest at either end, say where the main text lies: in the
page's articles (article or main elements, all of them) if half of the regions' weight is there, else in the innermost box
that holds them all. Of that place every block is kept, however short, since headings, lists and one-line paragraphs weigh
little in a window.

Headings that stand right before that place, with no other text between, belong to it.

An element is left out for what HTML says it is, or for a class, id or role that holds a word of `ALWAYS` and none of `UNLESS`
("post-comments", "cookie-law-info" go; "with-sidebar" and "comments-open" say something of what is inside), or of which every
word is in the lists below and one at least is in `BESIDE`: "related-posts" goes, "notice-period" and "related-work" stay. A
main element is never beside the main text, whatever is around it is called.

Null or empty html, and pages without text: empty text, zero characters. Unclosed tags end with their parents; a page that
breaks off inside a tag loses that tag only. Pages of links alone are measured by their links. Ties: a region opens at the
first line of the first window that reaches the threshold. Very long pages: whole, in time linear in their length. Repeated
rows: each gets its row. All other columns are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
#: Multiples of the geometric mean of a page's lines at which a region opens and closes.
SURGE = 1.5
DIVE = 0.75

#: Element names by their role in the HTML standard.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GONE = frozenset("nav footer aside form menu search dialog button select option textarea template noscript iframe svg canvas object head audio video map datalist".split())
SCOPE = frozenset(("article", "main"))
BOXES = frozenset("article body center div main section table tbody td tr".split())
#: Words of class, id or role that mark blocks beside the article, and words that say only where or how.
BESIDE = frozenset("ad ads advert adverts advertisement advertisements advertising alert alerts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer login menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended recommendations related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser teasers toolbar trending widget widgets".split())
ALWAYS = frozenset("ad ads adsense advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments cookie cookies disqus navbar newsletter pagination popup sidebar sponsored".split())
UNLESS = frozenset("closed disabled enabled has have hoc no not off on open policy recipe recipes with without".split())
PLAIN = frozenset("area articles bar block bottom box button buttons center container content fixed form global group inner item items latest left link links list main middle module outer page panel posts primary recent right row secondary section site slot small stories thread top unit wrap wrapper".split())
HEADING = frozenset(("header", "masthead"))
#: Of these, what also marks an article element as no article.
REMARKS = frozenset("comment comments disqus replies reply respond teaser teasers".split())

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^<>]*\Z")
HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[a-z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def hinted(attributes: str) -> set[str]:
    """Words in an element's class, id and role that count: of names made of listed words only all, of others those of ALWAYS."""
    out: set[str] = set()
    for m in HINT.finditer(attributes):
        for name in HUMP.sub("-", m[1] or m[2] or m[3] or "").lower().split():
            words = WORD.findall(name)
            if words and all(w in BESIDE or w in PLAIN or w in HEADING for w in words):
                out.update(words)
            elif not UNLESS.intersection(words):
                out.update(ALWAYS.intersection(words))
    return out


def lines_of(page: str) -> tuple[list[tuple[str, int, int, int, bool]], list[int]]:
    """(text, scope, characters in links, box, heading) of each block in page order, and each box's parent; what was left out
    becomes WINDOW empty lines."""
    page = RAW.sub("", page)
    out: list[tuple[str, int, int, int, bool]] = []
    parents = [0]
    stack: list[tuple[str, bool, int, int]] = []  # element, left out, scope, box
    buffer: list[str] = []
    links, in_link, at, scopes = 0, False, 0, 0
    left_out, scope, box = False, 0, 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append((text, scope, min(links, len(text)), box, any(x[0] in HEADINGS for x in stack[-2:])))
        links = 0

    def reset() -> None:
        nonlocal left_out, scope, box
        _, left_out, scope, box = stack[-1] if stack else ("", False, 0, 0)

    for m in TAG.finditer(page):
        if not left_out and m.start() > at:
            text = html.unescape(page[at : m.start()])
            buffer.append(text)
            links += len(text) if in_link else 0
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            buffer.append(" ")
            continue
        if name == "a":
            in_link = not m[1]
            continue
        if name not in BLOCK and name not in GONE:
            continue
        flush()
        if m[1]:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                was = left_out
                reset()
                if was and not left_out:
                    out += [("", scope, 0, box, False)] * WINDOW
            continue
        if name in VOID:
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
            reset()
        if name == "body" and left_out:
            stack.clear()
            reset()
        if left_out and (name == "main" or name in SCOPE and stack[-1][0] in ("nav", "head", "menu")):
            while stack and stack[-1][1]:
                stack.pop()
            reset()
        hints = hinted(m[3]) if m[3] else set()
        if name in ("body", "html", "main"):
            leaves = False
        elif name == "article":
            leaves = bool(hints & REMARKS)
        else:
            leaves = name in GONE or (name == "header" and not scope) or bool(hints & BESIDE) or (not scope and bool(hints & HEADING))
        if leaves and not left_out:
            out += [("", scope, 0, box, False)] * WINDOW
        if name in SCOPE and not scope:
            scopes += 1
            scope = scopes
        left_out = left_out or leaves
        if name in BOXES and not left_out:
            parents.append(box)
            box = len(parents) - 1
        stack.append((name, left_out, scope, box))
    if not left_out and at < len(page):
        buffer.append(html.unescape(page[at:]))
    flush()
    return out, parents


def regions(sizes: list[int], window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> list[tuple[int, int]]:
    """Line ranges from a surge to the next dive of the sums over sliding windows, cut back to long lines at either end."""
    weighing = [x for x in sizes if x]
    if not weighing:
        return []
    sums, total = [], 0
    for i, size in enumerate(sizes):  # the window that ends at line i
        total += size - (sizes[i - window] if i >= window else 0)
        sums.append(total)
    mean = math.exp(sum(map(math.log, weighing)) / len(weighing))
    high, low = min(surge * mean, max(sums)), min(dive * mean, max(sums))
    long = lambda lines: [i for i in lines if 2 * sizes[i] >= max(sizes[j] for j in lines)]
    out, opened = [], None
    for i, total in enumerate([*sums, 0]):
        if opened is None and total >= high:
            opened = long(range(max(0, i - window + 1), i + 1))[0]
        elif opened is not None and total < low:
            out.append((opened, long(range(max(opened, i - window), i))[-1] + 1))
            opened = None
    return out


def around(boxes: set[int], parents: list[int]) -> set[int]:
    """The innermost box that holds all of `boxes`, and everything in it. A box comes after its parent."""
    common = None
    for b in boxes:
        path = [b]
        while path[-1]:
            path.append(parents[path[-1]])
        path.reverse()
        if common is None:
            common = path
        else:
            common = [x for x, y in zip(common, path) if x == y]
    inside = {common[-1]} if common else set()
    for b in range(1, len(parents)):
        if parents[b] in inside:
            inside.add(b)
    return inside


def main_text(page: str) -> str:
    """The article's blocks joined by newlines; empty if there is no text."""
    lines, parents = lines_of(page)
    sizes = [max(0, len(text) - 2 * linked) for text, _, linked, _, _ in lines]
    if not any(sizes):
        sizes = [len(x[0]) for x in lines]
    dense = [i for a, b in regions(sizes) for i in range(a, b)]
    scoped = sum(sizes[i] for i in dense if lines[i][1])
    if 2 * scoped >= sum(sizes[i] for i in dense):
        return "\n".join(x[0] for x in lines if x[1] and x[0])
    boxes = around({lines[i][3] for i in dense if sizes[i]}, parents)
    kept = [i for i, x in enumerate(lines) if x[3] in boxes and x[0]]
    heads = []
    for i in range(min(kept, default=0) - 1, -1, -1):
        if lines[i][0] and not lines[i][4]:
            break
        heads += [lines[i][0]] if lines[i][0] else []
    return "\n".join([*heads[::-1], *(lines[i][0] for i in kept)])


def extract_text(pages: DataFrame, source: str = "html", target: str = "text") -> DataFrame:
    """Replaces column `source` by the main text of each page; all other columns are kept."""
    rest = [c for c in pages.columns if c not in (source, target)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(v or "") for v in b.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, target])

    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField(target, T.StringType())])
    return pages.select(*(F.col(f"`{c}`") for c in [*rest, source])).mapInArrow(run, schema)


def op7_html_text(pages: DataFrame) -> DataFrame:
    """Main text and its length for every page."""
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
