"""Main-text extraction from HTML by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one classifies each block
by link density, length and stop-word density as good, bad or, when it is too
short to tell, ambiguous; blocks in navigation, adverts and the like are bad.
Pass two lets ambiguous blocks take the label of the nearest decided neighbours
in the same section: both sides alike decide; unlike sides leave it to the
nearer.  The edges of an article count as good neighbours, other edges as bad.

A page whose words are hardly ever function words of the known languages is judged by its sentence
ends in their place; and where no block is good, undecided blocks that read as sentences are the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The commonest function words of the corpus's languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with his they be at one have this from or had by not but what all were when we there can an your which their if will each about how up out them "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum "
    "de la le et les du un une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux cette ou mais nous sa "
    "el y los del las por con no su para al lo como más o pero sus me si sin sobre este ya entre cuando todo esta ser son".split()
)
# HTML's own element classes.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul title head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea iframe template".split())  # what stands in them is no text of the page
DROPPED_TAGS = frozenset("nav header footer aside form menu dialog head title select optgroup option".split())
MAIN_TAGS = frozenset(("article", "main"))
#: words in class, id or role that mark what is not main text
MARK = re.compile(r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|sidebar|side|nav\w*|menus?|breadcrumbs?|foot\w*|header|masthead|cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|comments?|replies|reply|disqus|widgets?|toolbar|login|search|complementary|contentinfo")
#: those among them that name a place on the page or a way to share it: a whole article may stand in such an element
PLACE = re.compile(r"sidebar|side|header|masthead|foot\w*|banners?|share|sharing|social|widgets?|toolbar|search|complementary|promo\w*|modal|popup")
#: words that name the article
STORY = frozenset("article articles post posts story stories entry main".split())
#: words that make it another one
ELSEWHERE = frozenset(("related", "recommended"))
#: words that say where or how, not what
NEUTRAL = frozenset("site page main top bottom left right center middle bar box block list lists item items wrapper wrap container section sections area slot unit inner outer content contents link links button buttons primary secondary global text title heading body row col column columns group module panel pane strip zone region mobile desktop large small sticky fixed sm md lg xs js post posts article articles entry thread threads feed form signup message count first last new old fluid full wide mini sub my the and of".split())
#: names that speak of something elsewhere on the page
STATE = re.compile(r"(?:no|has|with|without)[-_]\S+")
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</?[A-Za-z][^>=]*(?:=(?:\s*(?:\"[^\"]*\"|'[^']*'))?[^>=]*)*(?:>|\Z)|[^<]+|<", re.S)  # a quote opens a value only behind =
RAW_END = {tag: re.compile(f"(?i)</{tag}(?![a-z])[^>]*(?:>|\\Z)") for tag in RAW_TAGS}
ATTRIBUTE = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\u3002\uff01\uff1f\u0964\u061f\u06d4\u1362](?=\W|\Z)|[\u3002\uff01\uff1f]")


def marked(token: str) -> str | None:
    """What a start tag's class, id or role says of the element: "matter" that is not main text (notices, adverts, comments, forms), "mixed" with the article, its "place" beside it (sidebars, headers), or None.

    A name is judged by all its words: a marking word does not count where as many words speak of something else.
    """
    name_end = re.match(r"<[^\s/>]*", token).end()
    told = None
    for a in ATTRIBUTE.finditer(token, name_end):
        if a[1].lower() in ("class", "id", "role"):
            for name in (a[2] or a[3] or a[4] or "").split():
                if not STATE.fullmatch(name.lower()):
                    words = [w.lower().rstrip("0123456789") for w in _PART.split(name)]
                    hits = [w for w in words if MARK.fullmatch(w)]
                    others = sum(bool(w) and w not in NEUTRAL for w in words) - sum(w not in NEUTRAL for w in hits)
                    if len(hits) > others:
                        if all(PLACE.fullmatch(w) for w in hits):
                            told = told or "place"
                        elif STORY.isdisjoint(words) or not ELSEWHERE.isdisjoint(hits):
                            return "matter"
                        else:
                            told = "mixed"
    return told


class Drop:
    """An element that is no main text, by its tag or by a name."""

    __slots__ = ("why", "live")

    def __init__(self, why: str):
        self.why, self.live = why, True


class Block:
    """A block of text inside so many drops, the outermost first; its edges count as good inside an article."""

    __slots__ = ("text", "linked", "section", "good_edge", "drops")

    def __init__(self, section: int, good_edge: bool, drops: tuple[Drop, ...]):
        self.text, self.linked, self.section, self.good_edge, self.drops = [], 0, section, good_edge, drops

    @property
    def label(self) -> str | None:
        return "bad" if any(d.live for d in self.drops) else None


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[Drop, ...], bool, int]] = []  # tag, drops, inside an article, section
    sections, links, button = 0, 0, False
    current: Block | None = None
    at = 0
    while m := TOKEN.match(page, at):
        token, at = m.group(), m.end()
        if token[0] != "<" or token == "<":
            if button:
                continue
            if current is None:
                _, drops, main, section = stack[-1] if stack else ("", (), False, 0)
                current = Block(section, main, drops)
                out.append(current)
            current.text.append(token)
            current.linked += links and len(token.strip())
            continue
        if token[1] in "!?":
            continue
        closing = token[1] == "/"
        tag = re.match(r"[A-Za-z][^\s/>]*", token[2 if closing else 1 :]).group().lower()
        if tag in RAW_TAGS:
            if not closing and not token.endswith("/>"):  # no tags or quotes of the page stand in it
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag == "button":
            button = not closing
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            if current is not None:
                current.text.append(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        current, button = None, False  # a button that was left open ends with its block
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID_TAGS:
            continue
        if stack and stack[-1][0] == tag and tag in ("p", "li", "td", "tr", "th", "dd", "dt", "option"):
            stack.pop()
        elif tag != "p" and stack and stack[-1][0] == "p":
            stack.pop()
        _, drops, main, section = stack[-1] if stack else ("", (), False, 0)
        why = "tag" if tag in DROPPED_TAGS else marked(token) if "=" in token and tag not in ("html", "body", "main") else None
        if tag in MAIN_TAGS or why:
            sections += 1
            section = sections
        stack.append((tag, (*drops, Drop(why)) if why else drops, main or tag in MAIN_TAGS, section))
    return out


def rescue(found: list[tuple[Block, int]]) -> None:
    """Revive elements that were dropped by a name but hold the main part of the page's good text.  found: (block, characters of good text).

    An element named after a place is revived if it holds more than four times the good text outside all dropped elements and no article stands
    there; a mixed one if no text reads well there; one named after its matter if, besides, an article stands in it.  The
    largest comes first, of equal ones the outermost; what is dropped inside it stays so.
    """
    while True:
        outside = [(b, good) for b, good in found if b.label is None and good]
        free, article = sum(good for _, good in outside), any(b.good_edge for b, _ in outside)
        held: dict[int, list] = {}
        for b, good in found:
            live = [d for d in b.drops if d.live]
            if good and live and live[0].why != "tag":
                inner = held.setdefault(id(live[0]), [live[0], 0, False])
                inner[1] += good * (len(live) == 1 or all(d.why == "place" for d in live))
                inner[2] |= b.good_edge and len(live) == 1
        best = max(held.values(), key=lambda x: x[1], default=None)
        while best is not None and not (best[1] > 4 * free and not article if best[0].why == "place" else best[1] and not free and (best[2] or best[0].why == "mixed")):
            del held[id(best[0])]
            best = max(held.values(), key=lambda x: x[1], default=None)
        if best is None:
            return
        best[0].live = False


def classify(text: str, linked: int, *, short: int, long: int, max_link_density: float, low_stop: float, foreign: bool = False) -> str:
    """Pass one: good, bad, near (fit for text, only short) or ambiguous.  foreign: the page's language is not known, sentence ends stand for function words."""
    if linked > max_link_density * len(text):
        return "bad"
    if len(text) < short:
        return "ambiguous"
    if foreign:
        ends = len(SENTENCE_END.findall(text))
        return "ambiguous" if not ends else "good" if len(text) >= long and 300 * ends >= len(text) else "near"
    words = WORDS.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if density >= low_stop:
        return "good" if len(text) >= long else "near"
    return "ambiguous"


def reads_as_sentence(text: str) -> bool:
    """A few words with a function word among them or a sentence end behind them."""
    words = WORDS.findall(text.lower())
    return bool(SENTENCE_END.search(text[-3:])) and (len(words) >= 4 or len(text) >= 12) or len(words) >= 4 and any(w in STOP_WORDS for w in words)


def extract_text(page: str | None, *, short: int = 70, long: int = 200, max_link_density: float = 0.5, low_stop: float = 0.12) -> str:
    """The main text of one page; '' if there is none."""
    raw = [(SPACE.sub(" ", html.unescape("".join(b.text))).strip(), b) for b in blocks_of(page or "")]
    raw = [(text, b) for text, b in raw if text]
    live = [text for text, b in raw if b.label is None] or [text for text, b in raw if all(d.why != "tag" for d in b.drops)]
    words = [w for text in live for w in WORDS.findall(text.lower())]
    rules = {"short": short, "long": long, "max_link_density": max_link_density, "low_stop": low_stop, "foreign": sum(w in STOP_WORDS for w in words) < 0.03 * len(words)}
    labels = [classify(text, b.linked, **rules) for text, b in raw]
    if any(b.label for _, b in raw):
        rescue([(b, len(text) * (label in ("good", "near"))) for (text, b), label in zip(raw, labels)])
    found = [(text, b.label or label, b.section, b.good_edge) for (text, b), label in zip(raw, labels)]
    n = len(found)
    decided = [label in ("good", "bad") for _, label, _, _ in found]
    kept = []
    for i, (text, label, section, edge) in enumerate(found):
        if not decided[i]:
            sides = []
            for step in (-1, 1):
                j = i + step
                while 0 <= j < n and found[j][2] == section and not decided[j]:
                    j += step
                inside = 0 <= j < n and found[j][2] == section
                sides.append((found[j][1] if inside else "good" if edge else "bad", abs(j - i)))
            (before, far), (after, near) = sides
            if label == "near" and "good" in (before, after):  # fit for text, only short: one good side is enough
                label = "good"
            else:
                label = before if before == after or far <= near else after
        if label == "good":
            kept.append(text)
    if not kept:
        kept = [text for text, label, _, _ in found if label in ("near", "ambiguous") and reads_as_sentence(text)]
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",), **rules) -> DataFrame:
    """(id, carried columns, text) for every page.

    Null and empty html give ''.  Repeated rows and rows with null ids are extracted each, equal pages (ties) alike; an
    empty table gives no rows; columns not carried are ignored, whatever their names.  Broken
    markup (open tags, cut pages, stray '<' or quotes) is read as browsers mostly do.
    """
    source = pages.select(id_col, *carry, html_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = pa.array([extract_text(p, **rules) for p in part.column(part.num_columns - 1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], [*part.schema.names[:-1], "text"])

    return source.mapInArrow(run, schema)
