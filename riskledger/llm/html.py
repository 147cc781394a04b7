"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags. First pass, each block by itself: link density,
length and stop-word density make it good, bad, near-good or short. Blocks of elements that say
that they are not the article (navigation, footer, forms, adverts, comments and the like) are bad
from the start. Second pass: a block that is short or near-good takes the label of its nearest
decided neighbours. Good blocks are joined in page order.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = frozenset("head script style noscript template svg math canvas audio video object applet iframe frameset noframes noembed textarea select button datalist title map plaintext xmp".split())
#: Elements that are not the article by their meaning.
SIDE = frozenset("nav footer aside menu dialog search".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre dd li".split())
#: An open element of the first kind is closed by a new one of the second kind.
CLOSES = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class names and ids that mark a side block.
SIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot breadcrumb breadcrumbs commentlist consent cookie cookies copyright disqus disclaimer footer "
    "gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination paywall popup privacy promo rail share sharing sidebar "
    "sidenav signup skip social sponsor subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Such words mark a side block even on an article element, as lists of comments and teasers use it.
FOREIGN_NAMES = frozenset("ad ads advert comment comments promo promoted promotion recommended related replies reply responses sponsored teaser teasers".split())
#: Such words mark a side block outside the article only.
OUTER_NAMES = frozenset("banner banners header".split())
#: Inside the article a header holds its title.
ARTICLE = frozenset({"article", "main"})
NO_SIDE, WEAK, STRONG = 0, 1, 2

STOP_WORDS = frozenset(
    # English
    "a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its like more most my no not of on one only "
    "or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your "
    # German
    "aber als am an auch auf aus bei bin bis da dann das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im ist ja kann mit nach nicht noch nur "
    "oder sein sich sie sind so um und uns von vor war was wenn wie wir wird zu zum zur über "
    # French
    "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou où par pas pour qu que qui sa sans se "
    "ses son sont sur te tu un une vos votre vous être "
    # Spanish
    "al algo como con cuando del desde donde el ella ellas ellos entre era eres esa ese eso esta este esto fue ha hay la las lo los muy más nada ni nos o para pero poco por porque "
    "quien se sin sobre son su sus también tan un una uno y ya "
    # Italian, Portuguese, Dutch
    "che di gli non sono della nel alla come anche degli dei più questo um uma não os das dos em na no ao mais foi het een van niet met voor zijn dat op te aan er maar".split()
)

LINKS_MOST = 0.2
SHORT = 70
LONG = 200
STOP_LOW = 0.20
STOP_HIGH = 0.30
#: Notices of rights and the like are never good.
RIGHTS = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)", re.IGNORECASE)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[=\"'])*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+))|(?<![^\s\"'/])(hidden)(?=[\s/]|$)", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Class names of what surrounds a side block, or of a page without one.
_ABOUT = re.compile(r"^(?:has|with|no|without|js)[-_A-Z]")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Text between two block borders."""

    side: bool
    heading: bool
    inside: bool  # an article element
    prose: bool  # a paragraph or the like
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


def _side(name: str, attributes: str, inside: bool) -> int:
    """Does the start tag say that the element is not the article?

    STRONG: by its meaning. WEAK: by a name or as a form, unless an article stands inside it.
    """
    if name in SIDE or name == "header" and not inside:
        return STRONG
    found = WEAK if name in ("form", "fieldset") else NO_SIDE
    if not attributes.strip():
        return found
    for key, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if hidden or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return STRONG
        if key == "role" and value.lower() in SIDE_ROLES or key == "style" and _INVISIBLE.search(value):
            return STRONG
        if key in ("class", "id") and name not in ("body", "html"):
            words = {x.lower() for token in value.split() if not _ABOUT.match(token) for x in _NAME_PARTS.findall(token)}
            if words & FOREIGN_NAMES:
                return STRONG
            if name not in ARTICLE and (words & SIDE_NAMES or not inside and words & OUTER_NAMES):
                found = WEAK
    return found


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, dropped, side, in the article
    links = headings = 0
    now: Block | None = None
    at = 0
    n = len(page)

    def text(raw: str) -> None:
        nonlocal now
        if not raw or stack and stack[-1][1]:
            return
        if now is None:
            if raw.isspace():
                return
            held = next((x[0] for x in reversed(stack) if x[0] in BLOCK), "")
            now = Block(bool(stack and stack[-1][2]), headings > 0, bool(stack and stack[-1][3]), held in PROSE)
        if "&" in raw:
            raw = entities.unescape(raw)
        now.parts.append(raw)
        if links:
            now.linked += len(raw.strip())

    def border() -> None:
        nonlocal now
        if now is not None:
            now.text = _SPACE.sub(" ", "".join(now.parts)).strip()
            if now.text:
                out.append(now)
        now = None

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if name in BLOCK:
            border()
        if m[1]:
            if any(x[0] == name for x in reversed(stack)):
                while True:
                    last = stack.pop()[0]
                    links -= last == "a"
                    headings -= last in HEADING
                    if last == name:
                        break
                if name in DROPPED or name in BLOCK:
                    border()
            continue
        if name == "br":
            text(" ")
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        elif name in CLOSES and stack and stack[-1][0] in CLOSES[name]:
            stack.pop()
        elif name == "a" and links:  # a link inside a link closes the first
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "a":
                    del stack[k]
                    links -= 1
                    break
        if name in VOID or m[3].endswith("/") and name not in BLOCK and name not in RAW:
            continue
        _, dropped, side, inside = stack[-1] if stack else ("", False, NO_SIDE, False)
        own = _side(name, m[3], inside)
        if own > side and name not in BLOCK:
            border()  # an inline side element stands by itself
        side = own if name in ARTICLE and side == WEAK else max(side, own)
        stack.append((name, dropped or name in DROPPED, side, inside or name in ARTICLE))
        links += name == "a"
        headings += name in HEADING
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|$)", re.IGNORECASE).search(page, at)
            at = end.start() if end else n
    border()
    return out


def _density(text: str) -> float:
    """Share of stop words; texts without letters have 0."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(block: Block) -> str:
    """good, bad, near (good) or short, from the block alone."""
    if block.side or RIGHTS.match(block.text):
        return "bad"
    size = len(block.text)
    if block.linked > LINKS_MOST * size:
        return "bad" if block.linked > 0.5 * size or size >= SHORT else "short"
    if size < SHORT:
        return "short"
    density = _density(block.text)
    if density >= STOP_HIGH:
        return "good" if size > LONG or block.inside or block.prose else "near"
    # the article element vouches for long blocks in languages without a list of stop words
    return "near" if density >= STOP_LOW or block.inside else "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Good or not: undecided blocks inherit the label of the nearest decided block.

    A block of an article element asks only blocks of the element, and is good if none is decided. A
    heading asks only what follows. If good and bad are equally near, near-good blocks and paragraphs
    are good and others bad. Elsewhere a page without decided blocks keeps its near-good ones.
    """
    n = len(found)

    def nearest(order: range) -> list[tuple[int, str]]:
        """Distance and label of the last decided block on the way, outside and inside the article."""
        out: list[tuple[int, str]] = [(n, "")] * n
        last = {False: (-1, ""), True: (-1, "")}
        for i in order:
            at, label = last[found[i].inside]
            if label and (not found[i].inside or all_inside[max(i, at)] - all_inside[min(i, at)] == abs(i - at)):
                out[i] = (abs(i - at), label)
            if labels[i] in ("good", "bad"):
                if found[i].inside and not found[i].side:  # an advert in the article says nothing of its neighbours
                    last[True] = (i, labels[i])
                last[False] = (i, labels[i])
        return out

    all_inside = [0] * (n + 1)  # blocks of articles before each block
    for i, b in enumerate(found):
        all_inside[i + 1] = all_inside[i] + b.inside
    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for i, (block, label) in enumerate(zip(found, labels, strict=True)):
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        (far_b, b), (far_a, a) = before[i], after[i]
        if block.heading and a:
            chosen = a
        elif far_b == far_a and a != b:
            chosen = "good" if label == "near" or block.prose else "bad"
        else:
            chosen = b if far_b <= far_a else a
        out.append(chosen == "good" if chosen else block.inside or label == "near")
    return out


def main_text(page: str) -> list[str]:
    """The good blocks of a page."""
    found = blocks(page)
    labels = [first_pass(b) for b in found]
    good = second_pass(found, labels)
    return [b.text for b, ok in zip(found, good, strict=True) if ok]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (good blocks joined by line feeds), n_blocks.

    A null or empty page has an empty text. Repeated rows are kept; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_ = pc.fill_null(batch.column(2), "")
            for low in range(0, batch.num_rows, 512):
                found = [main_text(p) for p in pages_.slice(low, 512).to_pylist()]
                columns = [batch.column(0).slice(low, 512), batch.column(1).slice(low, 512)]
                columns += [pa.array(["\n".join(x) for x in found], pa.string()), pa.array([len(x) for x in found], pa.int32())]
                yield pa.record_batch(columns, ["id", "url", "text", "n_blocks"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {kind}, url string, text string, n_blocks int")
