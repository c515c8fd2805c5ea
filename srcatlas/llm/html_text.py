"""Main text of web pages by two passes of block rules.

A tolerant scan cuts a page into blocks and drops raw elements and containers that name themselves as boilerplate
(menus, page headers, footers, sidebars, notices, adverts, forms, reader comments); forms, headers and names that only hint
at it stay where all of a page's running text is in them, and names that an article may have too (legal, social, related, promo)
where they hold a long text and the rest of the page next to none. Pass one labels a block by link density, length and stop-word
density: good, bad or undecided; a page without stop words of the listed languages is judged by length and links alone. In pass two an undecided block takes the label of its
nearest decided neighbours: good if both sides or the only decided side are good, or the nearer one is. Blocks inside
<article> or <main> are bad only for their links, and good if nothing around them is decided; of a page without such an
element and without a good block, the undecided blocks are the text.

Rows: null or empty html, and pages without main text, give the empty text. Null ids and urls stay null; repeated rows
give repeated results; other columns are ignored. Truncated tags, comments and raw elements end with the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare
from .textvec import slices

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were "
    "when we there can an your which their said if do will each about how up out them then she many some so these would her "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein "
    "le la les de des du et en un une est que qui dans pour pas sur au avec son ce il se par plus ne sont ou mais comme "
    "el los las y que en un una por con no se su para es al lo como más pero sus le ya o este sí porque esta entre cuando".split()
)
# Names in class, id or role attributes that mark boilerplate.
HINTS = frozenset(
    "nav navbar navigation menu menubar masthead footer sidebar aside ad ads advert advertisement adverts sponsor sponsored promo "
    "promotion cookie cookies consent notice gdpr popup modal comment comments commentlist disqus reply replies share sharing social "
    "related recommended breadcrumb breadcrumbs newsletter subscribe signup login pagination pager toolbar copyright legal "
    "complementary contentinfo".split()
)
# Names among them that an article may have for its subject or its place.
SUBJECTS = frozenset("ad ads advert advertisement adverts aside legal menu notice promo promotion related recommended share sharing social sponsor sponsored subscribe newsletter".split())
CERTAIN = HINTS - SUBJECTS
# Names that mark boilerplate unless they hold all of a page's text.
SOFT_HINTS = frozenset("header banner side alert overlay widget tags search form".split())
# First parts of names that tell of a layout, not of what is inside.
LAYOUT = frozenset("with has no without is not hide show".split())
#: Elements whose whole content is dropped.
DROPPED = frozenset("head nav footer aside noscript template iframe svg canvas object select button textarea dialog menu".split())
#: Elements that are dropped unless they hold all of a page's text; a header only outside of articles.
SOFT = frozenset("form fieldset header".split())
CONTAINERS = DROPPED | SOFT | frozenset("html body main article section div ul ol dl table figure details blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption pre figcaption hr address summary tbody thead title".split())

#: Attributes up to the tag's end: quoted values may hold `<` and `>`, a quote that is never shut is one character. Nothing is
#: tried twice, so a tag takes time linear in its length.
ATTRIBUTES = r"(?>\"[^\"]*\"|'[^']*'|[^>\"']++|[\"'])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|noembed|xmp)\b" + ATTRIBUTES + r"(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<shut>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*+)(?P<attrs>" + ATTRIBUTES + r")(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
UNSHOWN = re.compile(r"display\s*:\s*none")

SHORT, LONG, LINKED, STOPPED, UNSTOPPED = 70, 140, 0.34, 0.12, 0.04
SHOWN, MAYBE, NAMED, GONE = 0, 1, 2, 3


def hint(attrs: str) -> int:
    """What a tag's attributes say of its content: SHOWN, MAYBE boilerplate, NAMED as such, or GONE.

    Names count as a whole; of names with hyphens the first or last part only says MAYBE.
    """
    out = SHOWN
    for m in ATTRIBUTE.finditer(attrs) if attrs and not attrs.isspace() else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and UNSHOWN.search(value):
            return GONE
        for x in value.split() if name in ("class", "id", "role") else ():
            if x in CERTAIN:
                return GONE
            if x in SUBJECTS:
                out = NAMED
            parts = x.replace("_", "-").split("-")
            if x in SOFT_HINTS or len(parts) > 1 and parts[0] not in LAYOUT and (parts[0] in HINTS or parts[-1] in HINTS):
                out = max(out, MAYBE)
    return out


class Block:
    __slots__ = ("text", "links", "inside", "doubt", "label")

    def __init__(self, text: str, links: int, inside: bool, doubt: int):
        self.text, self.links, self.inside, self.doubt, self.label = text, links, inside, doubt, 0

    def runs(self, least: int = 1) -> bool:
        """Whether this is running text, of some length, rather than links."""
        return len(self.text) >= least and self.links <= LINKED * len(self.text)


def blocks(html: str) -> list[Block]:
    """Blocks outside dropped parts, in page order; doubt: SHOWN, MAYBE or NAMED, of the block and what it is in."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, SHOWN to GONE, inside an article
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    state = {"links": 0, "in_link": 0, "own": SHOWN}

    def end_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text and state["own"] != GONE:
                _, around, inside = stack[-1] if stack else ("", SHOWN, False)
                out.append(Block(text, state["links"], inside, max(around, state["own"])))
        state["links"], state["own"] = 0, SHOWN

    def take(text: str) -> None:
        if text and not (stack and stack[-1][1] == GONE):
            parts.append(text)
            if state["in_link"]:
                state["links"] += len(" ".join(text.split()))

    def pop_from(k: int) -> None:
        for tag, *_ in stack[k:]:
            open_tags[tag] -= 1
        del stack[k:]

    at = 0
    for m in TOKEN.finditer(html):
        take(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["raw"]:
                parts.append(" ") if parts else None
            continue
        tag, shut = tag.lower(), bool(m["shut"])
        if tag == "a":
            state["in_link"] = 0 if shut else 1
        elif tag == "br":
            parts.append(" ") if parts else None
        if tag not in BLOCKS:
            continue
        end_block()
        state["in_link"] = 0
        if tag not in CONTAINERS:
            state["own"] = SHOWN if shut else hint(m["attrs"])
        elif shut:
            if open_tags[tag]:
                pop_from(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
        else:
            if tag == "body" and open_tags["head"]:
                pop_from(next(k for k, s in enumerate(stack) if s[0] == "head"))
            _, around, inside = stack[-1] if stack else ("", SHOWN, False)
            inside = inside or tag in ("article", "main")
            named = hint(m["attrs"]) if tag not in ("html", "body", "article", "main") else SHOWN
            own = GONE if tag in DROPPED else max(named, MAYBE if tag in SOFT and not (tag == "header" and inside) else SHOWN)
            stack.append((tag, max(around, own), inside))
            open_tags[tag] += 1
    take(html[at:])
    end_block()
    return out


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def first_pass(b: Block, known: bool) -> int:
    """1 good, -1 bad, 0 undecided. known: the page is in a language with stop words; in others the length decides."""
    n = len(b.text)
    if b.links / n > LINKED:
        return -1 if not b.inside or b.links / n > 0.9 else 0
    if n < SHORT:
        return 0
    if not known:
        return 1 if n >= LONG else 0
    share = stop_share(b.text)
    if share >= STOPPED:
        return 1
    return -1 if share < UNSTOPPED and not b.inside else 0


def main_text(html: str | None) -> str:
    every = blocks(html) if html else []
    some = [b for b in every if b.doubt == SHOWN]
    # What may be boilerplate stays if it is all that a page says in running text.
    if not any(b.runs() for b in some):
        some = [b for b in every if b.doubt <= MAYBE]
    # So does what is named like it, if it is long and little is said outside of it.
    if not any(b.inside for b in some) and sum(len(b.text) for b in some if b.runs()) < LONG and any(b.runs(LONG) for b in every if b.doubt == NAMED):
        some = every
    prose = [b.text for b in some if b.runs(SHORT)]
    known = not prose or stop_share(" ".join(prose)) >= UNSTOPPED
    for b in some:
        b.label = first_pass(b, known)
    # Short text counts only where there is markup that could have set it apart.
    if some and "<" in html and not any(b.label > 0 or b.inside for b in some) and not ARTICLE.search(html):
        return "\n\n".join(b.text for b in some if b.label == 0)
    decided = [i for i, b in enumerate(some) if b.label]
    k, kept = 0, []
    for i, b in enumerate(some):
        while k < len(decided) and decided[k] < i:
            k += 1
        label = b.label
        if not label:
            before = decided[k - 1] if k else None
            after = decided[k] if k < len(decided) else None
            near = [j for j in (before, after) if j is not None and some[j].inside == b.inside]
            if not near:
                label = 1 if b.inside else -1
            else:
                label = some[min(near, key=lambda j: (abs(j - i), -some[j].label))].label
            if label < 0 and b.inside and b.links * 3 <= len(b.text):
                label = 1
        if label > 0:
            kept.append(b.text)
    return "\n\n".join(kept)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; no shuffle."""
    prepare(pages.sparkSession)
    some = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return some.mapInArrow(_rows, "page_id long, url string, text string, n_chars long")
