"""Main text of web pages: the maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, within_budget

#: Weights are learned from at most so many pages that mark their own content, whole ones, of
#: at most so many characters together.
MAX_LABELLED, LABELLED_CHARS = 500, 20_000_000
#: A word's score, and the range of a learned tag's.
WORD, LEAST_TAG, MOST_TAG = 1.0, -40.0, -0.1
#: Scores of tags that the labelled pages do not have: of text, of links, of structure, and
#: of the opening tag of boilerplate, whose words count nothing and are left out anyway.
TEXT_TAG, LINK_TAG, OTHER_TAG, BOILERPLATE_TAG = -0.1, -2.0, -4.0, -3.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Elements of HTML by what they hold.
_RAW = frozenset("script style noscript template textarea title svg annotation iframe object canvas".split())
_BOILERPLATE = frozenset("nav footer aside form header menu dialog button select head".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover".split())
#: Elements that stand inside a line and end no block.
_PHRASING = _INLINE | frozenset("picture audio video meter output progress button input select map area embed object iframe canvas svg noscript script style template source track annotation slot".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTENT = frozenset(("article", "main"))
#: Elements whose end tag may be left out: what the opening tag ends if no wall is between.
_ITEMS = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)), "optgroup": frozenset(("option", "optgroup"))}
_SECTIONS = ("thead", "tbody", "tfoot")
_CELLS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")} | dict.fromkeys(_SECTIONS, ("td", "th", "tr", *_SECTIONS))
#: Elements that an item's end passes through; all others are walls.
_LOOSE = _INLINE | frozenset(("p", "div", "address"))
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd figcaption td th".split())
_COMMENT_NAMES = re.compile(r"comments?|repl(?:y|ies)", re.I)
_BOILERPLATE_NAMES = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|header|masthead|menu|nav\w*|newsletter|notice|pagination|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|gdpr|modal|recommend\w*|replies|respond",
    re.I,
)
#: Words that beside such a name say where it stands or what holds it; beside any other word
#: (``share-price``, ``related-work``) a name is not boilerplate's.
_PLACES = frozenset(
    "site page main global local top bottom left right upper lower inner outer primary secondary sticky fixed mobile desktop wp block box area section container wrapper wrap row column col bar panel group body content text title heading list item items entry article post posts story stories link links button buttons btn icon icons form signup slot unit tower count number label thread tree author meta policy message overlay dialog".split()
)
_OWN = frozenset("article post entry story section content".split())
_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")

#: Names of what stands above a page, whose first heading is the site's.
_HEADS = re.compile(r"header|masthead|banner|toolbar", re.I)
#: An element of which more is links, whose blocks have fewer words on average, or which has fewer in all is no text.
MOST_LINKED, LEAST_WORDS, LEAST_TEXT = 0.5, 5, 25


@dataclass
class Element:
    """An element that may be boilerplate: the next one around it, and what it holds."""

    up: int
    sure: bool
    comments: bool = False
    head: bool = False
    words: int = 0
    linked: int = 0
    blocks: int = 0
    last: int = -1
    titled: bool = False


#: Key of a tag or "", text, block number, and whether boilerplate holds it.
Token = tuple[str, str, int, bool]


def _is_named(names: list[str], known: re.Pattern, in_content: bool) -> bool:
    """Whether one of an element's names is a known one, alone or beside words of place only.

    The header of an article, a section or a post is its own, not the site's.
    """
    for name in names:
        parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
        hits = [bool(known.fullmatch(p)) for p in parts]
        if any(hits) and all(h or p.lower() in _PLACES for p, h in zip(parts, hits, strict=True)):
            own = {p.lower() for p, h in zip(parts, hits, strict=True) if h} == {"header"} and (in_content or any(p.lower() in _OWN for p in parts))
            if not own:
                return True
    return False


def tokens(page: str) -> list[Token]:
    """Tags and texts of a page in order: key, text, block number and whether boilerplate holds it.

    The key of a tag is its name, after ``/`` if it closes and with ``!`` if boilerplate begins with it;
    its class, id and the like follow as keys of their own, after a dot.  Raw elements are left
    out with what they hold.  A closing tag ends the last open element of its name at any depth;
    ends that HTML lets out are implied for paragraphs, items of lists and menus, and parts of
    tables.  Elements that end no line (``picture``, ``svg``, ``script``) end no block.

    ``nav``, ``footer`` and the like are boilerplate.  An element that only a name or being a
    form speaks against is weighed by what it holds (``_removed``) once the page is read.
    """
    found: list[tuple[str, str, int, int, bool]] = []  # key, text, block, candidate around it, opens it
    elements: list[Element] = []
    contents: list[tuple[int, int, int]] = []  # words before, words after and candidate around each content element
    open_contents: list[tuple[int, int, int]] = []
    at = block = n_words = 0
    inside = -1  # the candidate around
    open_tags: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # of the open tags of each name
    walls: list[int] = []
    endless: set[str] = set()  # raw elements without an end from here on

    def end_from(i: int) -> None:
        """Ends the open tags from place ``i`` on; each is ended once, so a tag costs the same at any depth."""
        nonlocal inside
        while len(open_tags) > i:
            ended, own = open_tags.pop()
            if own >= 0:
                inside = elements[own].up
            places[ended].pop()
            if ended not in _LOOSE:
                walls.pop()
            if open_contents and open_contents[-1][0] == len(open_tags):
                _, before, around = open_contents.pop()
                contents.append((before, n_words, around))

    def last(*names: str) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def text(piece: str) -> None:
        nonlocal n_words
        if not piece:
            return
        piece = html.unescape(piece)
        found.append(("", piece, block, inside, False))
        n = len(piece.split())
        n_words += n
        if inside >= 0:
            e = elements[inside]
            e.words += n
            e.linked += n if places.get("a") else 0
            e.blocks += n > 0 and e.last != block
            e.last = block if n else e.last

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name, closing = m[1].lower(), m[0][1] == "/"
        if name not in _PHRASING:
            block += 1
        if name in _RAW and not closing and not m[2].endswith("/"):
            # What a raw element holds is no markup, so its end is looked for as it is.
            end = None if name in endless else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else len(page) if name in ("script", "style") else at
            continue
        if name == "br":
            found.append(("", " ", block, inside, False))
        if closing:
            if places.get(name):
                end_from(places[name][-1])
            found.append((f"/{name}", "", block, inside, False))
            continue
        names: list[str] = []
        for what, a, b, c in _ATTR.findall(m[2]):
            names += [a or b or c] if what.lower() == "aria-label" else (a or b or c).split()
        in_content = last(*_CONTENT) >= 0
        comment = name not in ("html", "body") and _is_named(names, _COMMENT_NAMES, in_content)
        named = comment or (name not in ("html", "body", *_CONTENT) and _is_named(names, _BOILERPLATE_NAMES, in_content))
        sure = (name in _BOILERPLATE and name != "form" and not (name == "header" and in_content)) or (name in ("label", "legend") and bool(places.get("form")))
        if name == "p":
            # A paragraph ends the one before it, and inline elements left open in it.
            while open_tags and (open_tags[-1][0] == "p" or open_tags[-1][0] in _INLINE):
                end_from(len(open_tags) - 1)
        elif name in _ITEMS:
            while walls and open_tags[walls[-1]][0] in _ITEMS[name]:
                end_from(walls[-1])
        elif name in _CELLS:
            while (i := last(*_CELLS[name])) > last("table"):
                end_from(i)
        own = -1
        if named or sure or name == "form":
            own = len(elements)
            elements.append(Element(inside, sure, comment, any(_HEADS.search(n) for n in names)))
        if name not in _VOID and not m[2].endswith("/"):
            if name in _CONTENT and not named:
                open_contents.append((len(open_tags), n_words, inside))
            places.setdefault(name, []).append(len(open_tags))
            if name not in _LOOSE:
                walls.append(len(open_tags))
            open_tags.append((name, own))
            if own >= 0:
                inside = own
        if name == "h1" and inside >= 0:
            elements[inside].titled = True
        around = own if own >= 0 else inside
        found.append((name, "", block, around, own >= 0))
        if name not in _CONTENT:
            found += [(f".{n}", "", block, around, False) for n in names]
    text(page[at:])
    end_from(0)
    gone = _removed(elements, contents, n_words)
    out: list[Token] = []
    for key, piece, b, e, opens in found:
        bad = e >= 0 and gone[e]
        if key[:1] != "." or not bad:
            first = opens and bad and not (elements[e].up >= 0 and gone[elements[e].up])
            out.append((key + "!" if first else key, piece, b, bad))
    return out


def _removed(elements: list[Element], contents: list[tuple[int, int, int]], n_words: int) -> list[bool]:
    """Whether each element goes, by its own or with one around it.

    Kept is what holds the page's largest ``article`` or ``main``.  If the page has none with
    a tenth of its words, kept is what holds most of the words that are neither in sure
    boilerplate nor in comments and is neither mostly links nor short pieces; and what holds the page's heading with a fifth of them,
    but for what stands above the page.
    """
    out = [False] * len(elements)
    # Whether an element goes in any case, with one around it, is known before its children's turn.
    for i, e in enumerate(elements):
        out[i] = e.sure or (e.up >= 0 and out[e.up])
    aside = list(out)
    for i, e in enumerate(elements):
        aside[i] = aside[i] or e.comments or (e.up >= 0 and aside[e.up])
    own = [0 if aside[i] else e.words for i, e in enumerate(elements)]
    linked = [0 if aside[i] else e.linked for i, e in enumerate(elements)]
    blocks = [0 if aside[i] else e.blocks for i, e in enumerate(elements)]
    titled = [e.titled for e in elements]
    whole = n_words - sum(e.words for i, e in enumerate(elements) if aside[i])
    for i in range(len(elements) - 1, -1, -1):
        up = elements[i].up
        if up >= 0:
            own[up] += own[i]
            linked[up] += linked[i]
            blocks[up] += blocks[i]
            titled[up] = titled[up] or titled[i]
    main = max((c for c in contents if not (c[2] >= 0 and out[c[2]])), key=lambda c: c[1] - c[0], default=None)
    if main is not None and 10 * (main[1] - main[0]) < n_words:
        main = None
    holds = set()
    at = main[2] if main else -1
    while at >= 0:
        holds.add(at)
        at = elements[at].up
    for i, e in enumerate(elements):
        if out[i] or (e.up >= 0 and out[e.up]):
            out[i] = True
        elif main is not None:
            out[i] = i not in holds
        else:
            text = linked[i] <= MOST_LINKED * own[i] and own[i] >= max(LEAST_WORDS * blocks[i], LEAST_TEXT)
            most = 2 * own[i] > whole and text and not e.comments
            titles = titled[i] and 5 * own[i] >= whole and text and not (e.head or e.comments)
            out[i] = not (most or titles)
    return out


def _content_range(found: list[Token]) -> tuple[int, int] | None:
    """Where the one content element of a page begins and ends, if it has one."""
    opened = [i for i, t in enumerate(found) if t[0] in _CONTENT]
    closed = [i for i, t in enumerate(found) if t[0].removeprefix("/") in _CONTENT and t[0][:1] == "/"]
    return (opened[0], closed[-1]) if len(opened) == 1 and len(closed) == 1 and opened[0] < closed[0] else None


def learn_weights(pages: list[str]) -> dict[str, float]:
    """Tag weights from pages whose one ``article`` or ``main`` element marks their content.

    A tag costs the words that its place outside the content outweighs: the log odds of
    being outside, times the mean number of words between two tags of the content.
    """
    inside, outside, words, tags = Counter(), Counter(), 0, 0
    for page in pages:
        found = tokens(page)
        if (span := _content_range(found)) is None:
            continue
        for i, (key, text, _, bad) in enumerate(found):
            within = span[0] < i < span[1]
            if bad:
                continue
            if key and key.lstrip("/") not in _CONTENT:
                (inside if within else outside)[key] += 1
                tags += within and key[0] != "."
            elif within:
                words += len(text.split())
    gap = min(max(words / max(1, tags), 2.0), 40.0)
    weights = {}
    for named in (False, True):  # names are weighed against names, tags against tags
        keys = [k for k in inside.keys() | outside.keys() if (k[0] == ".") == named]
        n_in, n_out = sum(inside[k] for k in keys) + 1, sum(outside[k] for k in keys) + 1
        for key in keys:
            odds = math.log(((outside[key] + 0.5) / n_out) / ((inside[key] + 0.5) / n_in))
            weights[key] = min(MOST_TAG, max(LEAST_TAG, -gap * odds))
    return weights


def _tag_score(key: str, weights: dict[str, float]) -> float:
    if key[0] == ".":
        return weights.get(key, MOST_TAG)
    name = key.lstrip("/")
    if name.endswith("!"):
        return BOILERPLATE_TAG
    default = LINK_TAG if name == "a" else TEXT_TAG if name in _TEXT or name in _PHRASING else OTHER_TAG
    return MOST_TAG if name in _CONTENT else weights.get(key, default)


def best_region(found: list[Token], weights: dict[str, float]) -> tuple[int, int]:
    """The contiguous run of tokens with the largest sum, by one scan; empty if no word scores.

    What boilerplate holds scores nothing, so content on both sides of it stays one run.
    """
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (key, text, _, bad) in enumerate(found):
        if total <= 0:
            total, start = 0.0, i
        if key.endswith("!") or not bad:
            total += _tag_score(key, weights) if key else WORD * len(text.split())
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best region, one a line, without boilerplate inside it.

    Character references are decoded and white space inside a block is one space.
    """
    found = tokens(page)
    a, b = best_region(found, weights)
    blocks: dict[int, list[str]] = {}
    for key, text, block, bad in found[a:b]:
        if not key and not bad:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``.

    Weights are learned from at most ``MAX_LABELLED`` pages that hold one ``article`` or
    ``main`` element, in the order of a hash, as far as whole ones fit into ``LABELLED_CHARS``
    characters; the tags themselves score nothing, so pages without them are read by the same weights.  A null or empty page, or one
    without words, has the empty text.  Pages of any length are read whole; repeated rows
    give repeated results; further columns are ignored.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marked = rows.where(F.rlike("html", F.lit("(?i)<(article|main)[\\s>]"))).select("html", F.xxhash64("html").alias("h"))
    # The limits are the bound of the sample that the weights are fitted on.
    sizes = marked.groupBy("h").agg(F.min(F.length("html")).alias("n")).orderBy("h").limit(MAX_LABELLED).collect()
    taken = within_budget([(r["h"], r["n"]) for r in sizes], LABELLED_CHARS)
    chosen = pages.sparkSession.createDataFrame([(h,) for h in taken], "h long")
    labelled = [r["html"] for r in marked.join(F.broadcast(chosen), "h").groupBy("h").agg(F.any_value("html").alias("html")).orderBy("h").collect()]
    weights = learn_weights(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
