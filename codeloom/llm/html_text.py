"""HTML extraction by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Elements that end a block, whose content is no text, that hold boilerplate, and never closed.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style template textarea noscript title iframe".split())
HIDDEN = frozenset("nav footer aside form head select option button dialog menu svg object video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Words in class and id attributes, and roles, that mark boilerplate.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay share sharing social related recommended comment comments disqus footer header masthead copyright login signup search widget pagination pager toolbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Frequent words of four languages.
STOP = frozenset("the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so la de et le les des un une que est dans pour sur pas du au qui par plus ne se ce il elle en der die das und ist von zu den mit sich auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer el los las y del por con una su para lo como más pero sus al este sí porque".split())
#: Words that name a place or a kind of box: a class of marks and these is still a mark, as `site-header` or `comment-list`.
PLACES = frozenset("site page main top bottom left right global primary secondary box container wrapper wrap bar block list lists inner outer section area unit slot item items link links button buttons form panel content posts articles text big small mobile desktop sticky fixed".split())
SPACES = " \t\n\r\f"
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

SHORT, LONG = 70, 200
LINKED, BARELY_LINKED, STOPPED = 0.5, 0.1, 0.3


@dataclass
class Block:
    text: str
    linked: int
    in_article: bool
    heading: bool


def _marked(tag: str, attrs: str) -> bool:
    """Whether a role or a whole class or id marks the element: `ad` and `site-header` do, `entry-header` does not."""
    if tag in ("html", "body", "article", "main") or "=" not in attrs:
        return False
    for name, *values in ATTR.findall(attrs):
        for token in "".join(values).lower().split():
            if name.lower() == "role":
                if token in ROLES:
                    return True
            else:
                words = [w for w in re.split("[_-]+", token) if w]
                if words and all(w in MARKS or w in PLACES for w in words) and any(w in MARKS for w in words):
                    return True
    return False


def tags_of(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before the tag, name, whether it closes, attributes) of the tags of a page, and last (rest, "", ...).

    Comments, declarations and the content of elements that hold no text are left out. Every character is looked at a
    bounded number of times: a tag whose quotes never end is taken to end at its first `>`, and so are all after it.
    """
    at, n, quotes, text = 0, len(page), True, []
    ends: dict[str, re.Pattern] = {}
    while True:
        i = page.find("<", at)
        if i < 0:
            text.append(page[at:])
            break
        text.append(page[at:i])
        head = page[i + 1 : i + 2]
        if head in ("!", "?"):
            comment = page.startswith("<!--", i)
            j = page.find("-->", i + 4) if comment else page.find(">", i)
            if j < 0:
                break
            at = j + (3 if comment else 1)
            continue
        begin = i + 2 if head == "/" else i + 1
        if not (page[begin : begin + 1].isascii() and page[begin : begin + 1].isalpha()):
            text.append("<")
            at = i + 1
            continue
        stop = begin
        if quotes:
            # over quoted values, to the `>` that ends the tag
            while True:
                j = page.find(">", stop)
                marks = [k for k in (page.find('"', stop, j), page.find("'", stop, j)) if k >= 0]
                if j < 0 or not marks:
                    break
                close = page.find(page[min(marks)], min(marks) + 1)
                if close < 0:
                    quotes, j = False, page.find(">", begin)
                    break
                stop = close + 1
            if j < 0 and stop > begin:
                quotes, j = False, page.find(">", begin)
        else:
            j = page.find(">", begin)
        if j < 0:
            break
        inside = page[begin:j]
        size = next((k for k, c in enumerate(inside) if c in SPACES or c == "/"), len(inside))
        tag, attrs = inside[:size].lower(), inside[size:]
        yield "".join(text), tag, head == "/", attrs
        text, at = [], j + 1
        if head != "/" and tag in RAW:
            found = ends.setdefault(tag, re.compile(f"</{tag}(?![a-z0-9])", re.I)).search(page, at)
            j = page.find(">", found.end()) if found else -1
            if j < 0:
                break
            at = j + 1
        if at >= n:
            break
    yield "".join(text), "", False, ""


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order. Open elements are kept on a stack; a block ends where a block element begins or ends.
    What lies in hidden elements is no text, be they blocks or within a line."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # tag, inside hidden content, inside an article
    depth: Counter[str] = Counter()
    texts: list[str] = []
    linked, heading = 0, False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            out.append(Block(text, linked, stack[-1][2], heading))
        texts.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        depth[tag] -= 1
        return tag

    for before, tag, closes, attrs in tags_of(page):
        if before and not stack[-1][1]:
            text = html.unescape(before)
            texts.append(text)
            if depth["a"]:
                linked += len(text.strip())
        if tag in BLOCKS or not tag:
            flush()
        if closes:
            if depth[tag]:
                while pop() != tag:
                    pass
            if tag in CLOSED_BY_BLOCK:
                heading = False
            continue
        if tag in BLOCKS and stack[-1][0] in CLOSED_BY_BLOCK and tag != "br":
            pop()
            heading = False
        if not tag or tag in RAW or tag in VOID or (attrs.endswith("/") and tag not in BLOCKS):
            continue
        _, hidden, inside = stack[-1]
        hidden = hidden or tag in HIDDEN or (tag == "header" and not inside) or _marked(tag, attrs)
        stack.append((tag, hidden, inside or tag in ("article", "main")))
        depth[tag] += 1
        if tag in BLOCKS:
            heading = tag[0] == "h" and tag[1:].isdigit()
    return out


def decide(b: Block, prior: bool | None = None) -> bool | None:
    """First pass: content, boilerplate, or None where the block alone does not tell.

    Link density, stop-word density and length decide. The prior is where the page's article lies: outside of it (False)
    a block is boilerplate; inside (True) a block that is not mostly links needs no stop words to be content if it is
    long, and less length.
    """
    density = b.linked / len(b.text)
    if prior is False or density > LINKED:
        return False
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP for w in words) / len(words)
    if len(b.text) < SHORT:
        return None
    if stops >= STOPPED or prior:
        return True
    if len(b.text) < LONG or stops >= STOPPED / 2:
        return None
    return density <= BARELY_LINKED


def main_text(page: str | None) -> str:
    """The page's main text: content blocks in page order, joined by a blank.

    First pass: length, link density and stop-word density decide on blocks. Long blocks without stop words (other
    languages, tables, code) are content if barely linked. Where the page marks an article that holds at least as much
    text as the rules find outside it, that is a prior for them, and what lies outside goes. Second pass: undecided
    blocks take the label of the nearest decided neighbours (within the article, where it is the prior); where the
    nearest before and after differ, the closer counts, and at equal distance the block goes unless it is a heading
    before content. Without any decided neighbour a block stays.
    """
    found = blocks_of(page or "")
    plain = [decide(b) for b in found]
    inside = sum(len(b.text) for b in found if b.in_article and b.linked <= LINKED * len(b.text))
    outside = sum(len(b.text) for b, content in zip(found, plain, strict=True) if content and not b.in_article)
    if any(b.in_article for b in found) and inside >= outside:
        found = [b for b in found if b.in_article]
        first = [decide(b, True) for b in found]
    else:
        first = plain
    before, after = [None] * len(first), [None] * len(first)
    for order, near in ((range(len(first)), before), (range(len(first) - 1, -1, -1), after)):
        seen = None
        for i in order:
            near[i] = seen
            if first[i] is not None:
                seen = i
    kept = []
    for i, b in enumerate(found):
        label = first[i]
        if label is None:
            x, y = before[i], after[i]
            if x is None and y is None:
                label = True
            elif x is None or y is None or first[x] == first[y]:
                label = first[y if x is None else x]
            elif i - x != y - i:
                label = first[x if i - x < y - i else y]
            else:
                label = b.heading and bool(first[y])
        if label:
            kept.append(b.text)
    return " ".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of `pages` but `html_col`, with text and n_chars (code points).

    Null or empty html gives an empty text. Rows are independent: repeated rows get equal texts, nulls elsewhere
    change nothing; columns named text or n_chars are replaced. Empty input gives no rows.
    """
    small_batches(pages.sparkSession, 500)
    others = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    rows = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{f.name}`") for f in others]).alias("row"), F.col(html_col).alias("html"))
    schema = type(rows.schema)([rows.schema["row"]]).add("text", "string").add("n_chars", "long")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])

    return rows.mapInArrow(run, schema).select(*[F.col("row").getField(f.name).alias(f.name) for f in others], "text", "n_chars")


def op6_html_text(spark, sf_dir):
    from .common import table

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
