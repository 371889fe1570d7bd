"""Main text of web pages: two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides a block from its container, its
link density, its length and its density of stop words: menus, forms, notices, comments and the
like are boilerplate, so are blocks that are mostly links and long ones without stop words and without the end of a sentence; long blocks
rich in stop words are text, and the rest stays open. Pass two gives an open block the label of its nearest decided neighbours, first of those in the same element.

Where a page marks its main text with ``article`` or ``main``, both passes run over that container, and the mark is
a hint of weight: in it, only lists of links are boilerplate by their links, nothing is by its stop words, and what stays open counts as text.

On pages with hardly any known stop word (other languages) their density says nothing: blocks that are long or end a sentence
are text there. Characters of scripts without spaces count three times.

Edge cases: a null or empty page gives an empty text; markup that is never closed is read to the
end of the page; repeated pages are treated alike; every page is read whole, however long.
Each row is independent: no shuffle, bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages handled.
STOP_WORDS = frozenset("""
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were
de la le et les des en un une du que qui dans pour pas sur est au par plus ne se avec ce il sont
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat
que el los del las por con no una su para es al lo como más pero sus o este si ya todo
""".split())
# Elements that begin and end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
# Elements whose content is not shown as text of the page.
HIDDEN_TAGS = frozenset("script style noscript template textarea select svg math object iframe canvas audio video button datalist".split())
# Elements that hold no main text.
BOILER_TAGS = frozenset("nav footer aside form menu dialog head".split())
# Of these, the words that say so of an article itself.
ARTICLE_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsored|promo|comments?|reply|related|teaser)(?=$|[\s_-])", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ITEM_TAGS = frozenset(("li", "dt", "dd", "option"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
# Words in class, id or role that mark boilerplate.
BOILER_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsors?|sponsored|promos?|promotion|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|popup|modal|overlay|"
    r"sidebar|side-bar|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|site-header|page-header|topbar|toolbar|comments?|commentlist|disqus|respond|replies|"
    r"share|sharing|social|related|recommended|widget|login|search|pagination|pager|complementary|contentinfo|alert|alertdialog|disclaimer|legal|copyright)(?=$|[\s_-])",
    re.I,
)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
STRIPPED = re.compile(r"[^\W\d_]+")

LONG, SHORT, LINKED, DENSE, SPARSE = 200, 70, 0.33, 0.30, 0.12
#: Share of known stop words on a page from which their density counts.
KNOWN = 0.05
SENTENCE_END = re.compile(r"[.!?…。！？।؟][\"'”’»)\]]*$")
UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e00-\u0e7f]")
TEXT, BOILER, OPEN = "text", "boiler", "open"


def _marked(attributes: str, hint: re.Pattern = BOILER_HINT) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id", "role") and hint.search(value):
            return True
    return False


Block = tuple[str, int, bool, bool, bool, int]


class _Blocks:
    """Cuts a page into (text, characters in links, in boilerplate, in the main container, list item, number of its element)."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = False
        self.open: list[tuple[str, bool, bool, int]] = []  # name, boilerplate, main, number
        self.count = 0
        self.marked = False  # the paragraph itself is

    def text(self, piece: str) -> None:
        piece = unescape(piece)
        if self.in_link:
            self.linked += len("".join(piece.split()))
        self.parts.append(piece)

    def end(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append((text, self.linked, self.marked or any(x[1] for x in self.open), any(x[2] for x in self.open), any(x[0] in ITEM_TAGS for x in self.open[-2:]), next((x[3] for x in reversed(self.open) if x[0] not in HEADINGS), 0)))
        self.parts, self.linked, self.marked = [], 0, False

    def tag(self, name: str, closing: bool, attributes: str) -> None:
        if name == "a":
            self.in_link = not closing
        elif name == "br":
            self.parts.append(" ")
        if name not in BLOCK_TAGS:
            return
        self.end()
        self.in_link = False
        if name == "p":
            self.marked = not closing and _marked(attributes)
        if name in VOID_TAGS or name == "p":
            return
        if closing:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == name:
                    del self.open[i:]
                    break
        else:
            own = name in ("article", "main") and _marked(attributes, ARTICLE_HINT)
            main = name in ("article", "main") and not own and not any(x[1] for x in self.open)
            boiler = own or name in BOILER_TAGS or name == "header" and not any(x[2] for x in self.open) or name not in ("html", "body", "article", "main") and _marked(attributes)
            self.count += 1
            self.open.append((name, boiler, main, self.count))


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; hidden elements and comments left out."""
    out, at, n = _Blocks(), 0, len(page)
    lowered, strict = None, True
    while at < n:
        i = page.find("<", at)
        if i < 0:
            out.text(page[at:])
            break
        if i > at:
            out.text(page[at:i])
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = n if j < 0 else j + 3
            continue
        if page.startswith(("<!", "<?"), i):
            j = page.find(">", i)
            at = n if j < 0 else j + 1
            continue
        m = TAG.match(page, i) if strict else LOOSE.match(page, i)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[i : i + 3]):
                strict = False  # an open quote: from here on a tag ends at the next >, else each would search the rest
                j = page.find(">", i)
                at = n if j < 0 else j + 1
            else:
                out.text("<")
                at = i + 1
            continue
        name, closing, at = m[1].lower(), page[i + 1] == "/", m.end()
        # only foreign elements can close themselves
        if not closing and (name in HIDDEN_TAGS or name in RAW_TAGS) and not (name in ("svg", "math") and m[2].endswith("/")):
            lowered = lowered or page.lower()
            if len(lowered) != n:  # lower-casing changed the length: search as it is
                lowered = page
            j = lowered.find(f"</{name}", at)
            k = page.find(">", j) if j >= 0 else -1
            at = n if k < 0 else k + 1
            continue
        out.tag(name, closing, m[2])
    out.end()
    return out.blocks


def _stop_words(text: str) -> tuple[int, int]:
    """Stop words and words of a block."""
    words = STRIPPED.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _links(text: str, linked: int) -> bool:
    return linked > LINKED * max(1, len("".join(text.split())))


def _first_pass(text: str, linked: int, boiler: bool, known: bool) -> str:
    """The label of a block; ``known``: the page's language is one whose stop words count."""
    if boiler or _links(text, linked):
        return BOILER
    length = len(text) + 2 * len(UNSPACED.findall(text))
    if length < SHORT:
        return OPEN
    ends = bool(SENTENCE_END.search(text))
    if not known:
        return TEXT if ends or length >= LONG else OPEN
    stops, words = _stop_words(text)
    density = stops / max(1, words)
    if density >= DENSE or density >= SPARSE and length >= LONG:
        return TEXT
    return OPEN if density >= SPARSE or ends else BOILER


def _second_pass(labels: list[str], places: list[int], default: str) -> list[str]:
    """Open blocks take the label of the nearest decided one: of those in the same element, if it has any, else of all.

    Where both sides are as near and differ, of the text side. Where no block is text by itself, what stands around
    says nothing, and they get ``default``.
    """
    near: list[list[tuple[int, int, str]]] = [[] for _ in labels]
    inside: list[list[tuple[int, int, str]]] = [[] for _ in labels]
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last, last_inside = None, {}
        for i in order:
            if labels[i] != OPEN:
                last = last_inside[places[i]] = i
                continue
            for k, found in ((last, near[i]), (last_inside.get(places[i]), inside[i])):
                if k is not None:
                    found.append((abs(i - k), 0 if labels[k] == TEXT else 1, labels[k]))
    known = TEXT in labels
    return [label if label != OPEN else min(inside[i] or (near[i] if known else []), default=(0, 0, default))[2] for i, label in enumerate(labels)]


def main_text(page: str | None) -> str:
    """The text of a page's article, blocks joined by line breaks."""
    if not page:
        return ""
    blocks = blocks_of(page)
    plain = [_stop_words(text) for text, _, boiler, *_ in blocks if not boiler]
    known = sum(x for x, _ in plain) >= KNOWN * max(1, sum(n for _, n in plain))
    main = [b for b in blocks if b[3]]
    if main:
        lists = _link_lists(main)
        kept = [(b, _first_pass(b[0], 0, False, known)) for i, b in enumerate(main) if not b[2] and i not in lists]
        labels = _second_pass([OPEN if label == BOILER else label for _, label in kept], [b[5] for b, _ in kept], TEXT)
        return "\n".join(b[0] for (b, _), label in zip(kept, labels) if label == TEXT)
    labels = _second_pass([_first_pass(*b[:3], known) for b in blocks], [b[5] for b in blocks], TEXT)
    return "\n".join(b[0] for b, x in zip(blocks, labels) if x == TEXT)


def _link_lists(blocks: list[Block]) -> set[int]:
    """Neighbouring list items, two or more, that are mostly links."""
    out, run = set(), []
    for i, (text, linked, _, _, item, _) in enumerate([*blocks, ("", 0, False, False, False, 0)]):
        if item and _links(text, linked):
            run.append(i)
        else:
            out.update(run if len(run) > 1 else [])
            run = []
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = picked.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
