"""Main text of HTML pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass decides them by link density and length, in any
language; stop words break ties between text and links on pages whose language has a list. Short blocks stay open,
and the second pass gives these the label of their nearest decided neighbours.

Tags, roles, class names and ids are a prior of the first pass. Firm marks (menus, footers, comments, adverts, hidden
parts) set a block aside. Weak marks (sidebar, header, related, widget, share ...), which are as often names of a
layout, ask more of it, and so does a place outside the article. A mark on a container of the page's main article or
of most of its text says nothing. Only an article that holds a fair part of the page's text is a prior for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepanel.llm.common import slices

#: Tags that end a block, tags whose content is no text, containers and names of boilerplate.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes noscript xmp template svg math select option button object canvas audio video".split())
WEAK_TAGS = frozenset("header aside".split())
FIRM_TAGS = frozenset("nav footer form menu dialog search fieldset".split())
WEAK_ROLES = frozenset("banner complementary".split())
FIRM_ROLES = frozenset("navigation contentinfo search dialog alert menu menubar form alertdialog".split())
TITLE_WORDS = frozenset("header head".split())  # of an article they name the part with its title
WEAK_WORDS = TITLE_WORDS | frozenset(
    "promo promotion sidebar sidebars aside masthead topbar banner notice notices notification alert share sharing social related recommended "
    "toolbar widget widgets skip hidden foot teaser teasers".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
FIRM_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors nav navbar navigation menu menus breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login pagination pager copyright disclaimer".split()
)
ARTICLE_WORDS = COMMENT_WORDS | frozenset("ad ads advert adverts advertisement sponsor sponsored related teaser teasers".split())  # those that count on an article itself
MAIN_TAGS = ("article", "main")
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with be by at this from or have an they which not but "
    "der die das und ist zu den von mit ein eine nicht sich auf für dem im als auch es an werden aus er hat "
    "le la les de des et un une est en que qui dans pour pas sur au avec il ce ne se plus par du "
    "el los las y es del por con no una su para como más lo al se pero sus".split()
)
LINKS, FEW_LINKS, LONG, SPARSE = 0.5, 0.2, 140, 0.08
DOUBT = 3  # times the length that a block needs against a weak mark or outside the article
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Scripts that write a word in one or two signs; a sign counts as this many letters of an alphabet.
IDEOGRAPHS, SIGN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]"), 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|[^>]*+>?)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|([^\s=/>\"']+)")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
VOID = frozenset("hr".split())
CLOSED_BY = {"p": BLOCK_TAGS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), **{f"h{i}": BLOCK_TAGS for i in range(1, 7)}}


WEAK, FIRM, COMMENT = 1, 2, 3


@dataclass(eq=False)
class Place:
    """A container with its mark and the length of the running text in it."""

    tag: str
    mark: int = 0
    parent: Place | None = None
    prose: int = 0

    def around(self) -> Iterator[Place]:
        place = self
        while place is not None:
            yield place
            place = place.parent


@dataclass
class Block:
    tag: str
    place: Place
    text: list[str] = field(default_factory=list)
    linked: int = 0
    line: str = ""
    mark: int = 0
    main: bool = False


def _marked(tag: str, rest: str, inside_main: bool) -> int:
    """The mark that a tag opens by its name, role, class, id or visibility; the firmest counts, 0 for none."""
    mark = FIRM if tag in FIRM_TAGS else WEAK if tag in WEAK_TAGS and not (tag == "header" and inside_main) else 0
    if "=" not in rest and "hidden" not in rest:
        return mark
    for name, double, single, bare, alone in ATTRIBUTE.findall(rest):
        name, value = (name or alone).lower(), double or single or bare
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            mark = max(mark, FIRM)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            mark = max(mark, FIRM)
        elif name == "role":
            role = value.strip().lower()
            mark = max(mark, FIRM if role in FIRM_ROLES else WEAK if role in WEAK_ROLES else 0)
        elif name in ("class", "id") and tag not in ("body", "html"):
            words = {part.lower() for part in NAME_PARTS.findall(value)}
            if tag in MAIN_TAGS:
                words &= ARTICLE_WORDS
            elif inside_main or tag in HEADINGS:
                words -= TITLE_WORDS
            mark = max(mark, COMMENT if words & COMMENT_WORDS else FIRM if words & FIRM_WORDS else WEAK if words & WEAK_WORDS else 0)
    return mark


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order, white space as one space and character references decoded."""
    out: list[Block] = []
    stack = [Place("")]
    block, in_link, at = Block("", stack[0]), False, 0

    def flush() -> None:
        nonlocal block, in_link
        block.line = " ".join("".join(block.text).split())
        if block.line:
            out.append(block)
        block = Block(stack[-1].tag, stack[-1])

    def add(piece: str) -> None:
        if piece:
            text = unescape(piece) if "&" in piece else piece
            block.text.append(text)
            if in_link:
                block.linked += len("".join(text.split()))

    while at < len(page):
        token = TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            if token[0].startswith("<![CDATA["):
                add(token[0][9:].removesuffix("]]>"))
            continue
        if token["end"]:
            if tag == "a":
                in_link = False
            elif tag in BLOCK_TAGS:
                if any(p.tag == tag for p in stack):
                    while stack[-1].tag != tag:
                        stack.pop()
                    stack.pop()
                flush()
            continue
        if tag in RAW_TAGS:
            if not token["rest"].endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = close.start() if close else len(page)
            continue
        if tag == "a":
            in_link = True
        elif tag in ("br", "img", "wbr", "input"):
            block.text.append(" " if tag == "br" else "")
        elif tag in BLOCK_TAGS:
            while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
                stack.pop()
            if tag not in VOID:
                inside_main = any(p.tag in MAIN_TAGS for p in stack)
                stack.append(Place(tag, _marked(tag, token["rest"], inside_main), stack[-1]))
            flush()
    flush()
    return out


def _density(line: str) -> float:
    words = re.findall(r"[^\W\d_]+", line.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _size(line: str) -> int:
    """Length in letters of an alphabet."""
    return len(line) if line.isascii() else len(line) + (SIGN - 1) * len(IDEOGRAPHS.findall(line))


def _links(block: Block) -> float:
    return block.linked / max(1, len(block.line.replace(" ", "")))


def listed_language(blocks: list[Block]) -> bool:
    """Whether the stop words say anything on a page: its text outside link lists has enough of them."""
    return _density(" ".join(b.line for b in blocks if _links(b) <= LINKS)) >= SPARSE


GOOD, BAD, OPEN = 1, 0, -1


def _prose(block: Block) -> int:
    """Length of a block of running text, 0 for others."""
    size = _size(block.line)
    return size if size >= LONG and _links(block) <= FEW_LINKS else 0


def set_priors(blocks: list[Block]) -> bool:
    """Set the mark that counts for every block and whether it is in the page's article; whether there is one.

    A container's mark is void if it holds most of the page's text (comments: nearly all) and no heavier article is
    outside, or, for weak marks, the article with the most text.
    """
    prose = [_prose(b) for b in blocks]
    paths = [list(b.place.around()) for b in blocks]
    total = 0
    for path, size in zip(paths, prose):
        total += 0 if any(p.mark == COMMENT for p in path) else size
        for place in path if size else ():
            place.prose += size
    everything = sum(prose)
    articles = {p for path in paths for p in path if p.tag in MAIN_TAGS and not p.mark and p.prose}
    articles = {p for p in articles if all(q.mark != COMMENT for q in p.around())} or articles
    # of equally heavy ones the innermost, which is what an article in a main is
    heaviest = max(articles, key=lambda p: (p.prose, sum(1 for _ in p.around())), default=None)
    holders = set(heaviest.around()) if heaviest else set()

    def void(place: Place) -> bool:
        holds = place in holders
        if place.mark == COMMENT:
            return place.prose > 0.8 * everything and (holds or not heaviest)
        if place.mark == WEAK and holds:
            return True
        return 2 * place.prose > total and (not heaviest or holds or place.prose > 2 * heaviest.prose)

    for block, path in zip(blocks, paths):
        block.mark = max((p.mark for p in path if p.mark and not void(p)), default=0)
    for name in MAIN_TAGS:
        inside = [not b.mark and any(p.tag == name and not p.mark for p in path) for b, path in zip(blocks, paths)]
        own = sum(n for n, i in zip(prose, inside) if i)
        rest = sum(n for n, b, i in zip(prose, blocks, inside) if not i and not b.mark)
        if any(inside) and rest <= 2 * own:
            for block, i in zip(blocks, inside):
                block.main = i
            return True
    return False


def first_pass(block: Block, listed: bool, doubted: bool = False) -> int:
    """Label by links and length; between text and links stop words decide, if the page's language has a list.
    Short blocks of an article are bad only if they are lists of links or links without text; ``doubted`` blocks are
    good only if they are running text of ``DOUBT`` times the length."""
    links, size = _links(block), _size(block.line)
    if links > LINKS:
        kept = block.main and size < LONG and (block.tag in HEADINGS or (links <= 0.9 and block.tag != "li"))
        return OPEN if kept else BAD
    if size < LONG:
        return OPEN
    if doubted and (size < DOUBT * LONG or links > FEW_LINKS):
        return BAD
    if links <= FEW_LINKS or _density(block.line) >= SPARSE:
        return GOOD
    return BAD if listed else OPEN


def second_pass(blocks: list[Block], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided block; at equal distance a good one wins, and a heading looks
    ahead only. With nothing decided, text in an article is good and other text is bad."""
    before, after, last = [], [], None
    for i, label in enumerate(labels):
        if label != OPEN:
            last = i
        before.append(last)
    last = None
    for i in range(len(labels) - 1, -1, -1):
        if labels[i] != OPEN:
            last = i
        after.append(last)
    after.reverse()
    out = []
    for i, label in enumerate(labels):
        if label == OPEN:
            near = [j for j in (after[i], before[i]) if j is not None]
            if blocks[i].tag in HEADINGS and after[i] is not None:
                near = [after[i]]
            label = labels[min(near, key=lambda j: (abs(j - i), -labels[j]))] if near else (GOOD if blocks[i].main else BAD)
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """Good blocks in page order, joined by a line feed."""
    if not page:
        return ""
    blocks = blocks_of(page)
    article = set_priors(blocks)
    blocks = [b for b in blocks if b.mark < FIRM]
    listed, good = listed_language(blocks), set()
    # doubted blocks decide among themselves, so that the edges of a page do not follow the article next to them
    for doubted in (False, True):
        part = [i for i, b in enumerate(blocks) if (b.mark == WEAK or (article and not b.main)) == doubted]
        labels = second_pass([blocks[i] for i in part], [first_pass(blocks[i], listed, doubted) for i in part])
        good.update(i for i, label in zip(part, labels) if label == GOOD)
    return "\n".join(b.line for i, b in enumerate(blocks) if i in good)


def extract(df: DataFrame, html: str = "html", into: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` and the main text of the whole page; empty for null, empty or text-free pages.

    Pages are independent of each other, so repeated rows give repeated results, and an empty table gives no rows.
    Other columns are ignored. Broken markup is read as far as it goes: unclosed tags end with their container.
    """
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").cast("string").alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"`{into}` string"])

    def run(batches):
        for batch in slices(batches, "__html"):
            texts = [main_text(page) for page in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, into])

    return source.mapInArrow(run, schema)
