"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of tags and texts. Each word scores a positive weight, each tag a negative one, and
the contiguous run of tokens with the largest sum is the content region, found by one linear scan. The
weights come from labelled pages: on pages that mark their article, a token is content or not, and a tag
costs its odds of standing outside, or next to nothing if it stands inside more often. A text of usual length weighs as much as one odds' worth, so
that a few words beyond a telling tag do not pay for crossing it. On a page that marks its article no tag within it has ever stood outside one,
so there all of them cost next to nothing.

Elements that are never content (menus, forms, scripts, notices ...), by name or by the words of their
class, id or role, are passed over inside and outside the region: neither their texts nor their tags score. An element of this kind that is never
closed ends at the next block; one that holds the page's article is passed over as little as the article. A header element is one of them
wherever it stands, so a title inside an article's own header is left out.
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

from soilspark.llm.sampling import sampled

LABELLED_PAGES = 2_000
RARE = 2  # tags that the labelled pages hold no more often say nothing
PARAGRAPHS = 3
INSIDE = -0.01  # of a word's weight: what a tag costs that stands in articles only

# fixed values: names and hints of HTML
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER_CONTENT = set("aside button canvas datalist dialog footer form head header iframe menu nav noscript object option script select style svg template textarea title".split())
# of a class: hints that count as its first or last part, and those that as its first part may name what a text is about
HINTS = set(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer masthead menu menubar nav navbar navigation newsletter "
    "pagination pager popup promo related sidebar sponsor sponsored subscribe toolbar widget".split()
)
LAST_HINTS = set("notice notification promotion promoted replies reply share sharing social".split())
AD_HOLDERS = set("banner block box container frame sense slot space spot unit wrap wrapper zone".split())  # after ad, in one word
ABOUT = set("active article closed free layout open page policy recipe recipes story".split())  # last parts that make more of a first part than a hint
COMMENTS = set("comment comments disqus replies reply".split())
# of a class: what only says that something is held, and what says how a page looks
HOLDERS = set("area bar block body box btn button buttons container content count form group head header holder icons inner item items link links list panel row section text title wrap wrapper".split())
STATES = set("has hide is no not show with without".split())
NEVER_SKIPPED = set("html body article main".split())
ROLES = set("banner navigation complementary contentinfo search form menu menubar toolbar alert dialog".split())

_OPENS = re.compile(r"<(?=[a-z/!?])", re.I)
_NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
_STOP = re.compile(r"[>\"']")
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_MARKED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _closing(page: str, at: int, dead: set[int]) -> int:
    """Where the tag whose attributes begin at ``at`` ends: the next ``>`` outside quotes, or if there is none the next one at all; one is there.

    ``dead`` are quotes from which no such end was found before, so that no part of a page is gone through again and again.
    """
    here, seen = at, []
    while (stop := _STOP.search(page, here)) is not None:
        if stop[0] == ">":
            return stop.start()
        if stop.start() in dead:
            break
        seen.append(stop.start())
        here = page.find(stop[0], stop.end()) + 1
        if not here:
            break
    dead.update(seen)
    return page.find(">", at)


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """(name, text or attributes, opens): a tag's name with ``/`` before it if it closes, or ``""`` and a text. Comments, scripts and styles are left out."""
    out: list[tuple[str, str, bool]] = []
    at, last, dead = 0, page.rfind(">"), set()
    look = 0
    while (m := _OPENS.search(page, look)) is not None:
        begin = m.start()
        tag = _NAME.match(page, begin)
        name = tag[2].lower() if tag else ""
        if page.startswith("<!--", begin):
            to = page.find("-->", begin + 4) + 3
            to, found = (to if to > 2 else len(page)), ("!", "", False)
        elif begin > last:  # no tag ends any more
            look = page.find("<!--", begin)
            if look < 0:
                break
            continue
        elif tag is None:
            if page[begin + 1] == "/":
                look = begin + 1
                continue
            to, found = page.find(">", begin) + 1, ("!", "", False)
        elif name in _RAW and not tag[1]:
            to = page.find(">", tag.end())
            to, found = (m.end() if (m := _RAW[name].search(page, to)) else len(page)), ("!", "", False)
        else:
            end = _closing(page, tag.end(), dead)
            rest = page[tag.end() : end]
            to, found = end + 1, (tag[1] + name, rest, not tag[1] and not rest.endswith("/") and name not in VOID)
        if begin > at:
            out.append(("", page[at:begin], False))
        out.append(found)
        at = look = to
    if at < len(page):
        out.append(("", page[at:], False))
    return out


def _kind(attributes: str) -> str:
    """``comments`` or ``other`` if a class, id or role names something that is never content, else nothing.

    Of a class or id like ``site-footer``, ``ad-slot`` or ``relatedPosts`` the first or last part has to be a hint; ``cookie-recipe`` (``ABOUT``), ``share-price``
    (``LAST_HINTS``: as a first part a hint only before a part that says what holds it, like ``share-buttons``) and ``has-sidebar`` (``STATES``) name none.
    """
    found = ""
    for m in _MARKED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            words = [w.lower() for w in _PARTS.findall(token)]
            if not words:
                continue
            first, last = words[0], words[-1]
            if m[1].lower() == "role":
                hint = first if first in ROLES else ""
            elif first in STATES:
                hint = ""
            elif last in HINTS or last in LAST_HINTS:
                hint = last
            elif first in HINTS and last not in ABOUT or first in LAST_HINTS and last in HOLDERS:
                hint = first
            else:
                hint = "ad" if first.startswith("ad") and first[2:] in AD_HOLDERS else ""
            if hint in COMMENTS:
                return "comments"
            found = found or ("other" if hint else "")
    return found


def _matched(items: list[tuple[str, str, bool]]) -> list[int]:
    """For each tag that opens an element, where the one that closes it stands; 0 if none does."""
    out = [0] * len(items)
    open_: dict[str, list[int]] = {}
    for i, (name, _, opens) in enumerate(items):
        if opens:
            open_.setdefault(name, []).append(i)
        elif name.startswith("/") and (waiting := open_.get(name[1:])):
            out[waiting.pop()] = i
    return out


def _article(items: list[tuple[str, str, bool]], closes: list[int], words: list[int]) -> tuple[int, int]:
    """Where the page's article opens and what follows it; (-1, -1) if the page marks none.

    It is the main element, or of the articles that stand neither in an aside nor in reader comments (else of all) the one of most words; an article that holds
    more than half of the main element's words goes before it.
    """
    apart, plain, beside = 0, [], []
    main = -1
    for i, (name, rest, opens) in enumerate(items):
        if not opens:
            continue
        if name == "article":
            (beside if i < apart else plain).append(i)
        elif name == "main":
            main = i if main < 0 else main
        elif i >= apart and (name == "aside" or "=" in rest and _kind(rest) == "comments"):
            apart = closes[i]
    past = lambda i: closes[i] + 1 if closes[i] else len(items)
    held = lambda i: words[past(i)] - words[i]
    best = max(plain or beside, key=lambda i: (held(i), -i), default=-1)
    if main >= 0 and not (main < best < past(main) and 2 * held(best) > held(main)):
        best = main
    return (best, past(best)) if best >= 0 else (-1, -1)


def skipped(items: list[tuple[str, str, bool]]) -> tuple[list[bool], int, int]:
    """Which tokens stand inside elements that are never content (the tags of these included), and where the page's article opens and ends.

    An element that holds the page's article is not one of them, whatever it is called; nor, on a page that marks no article, a form or an element with a hint
    (but for reader comments) that holds more than half of the page's words in ``PARAGRAPHS`` paragraphs or more.
    """
    out = [False] * len(items)
    closes = _matched(items)
    words, paragraphs = [0], [0]
    for name, text, opens in items:
        words.append(words[-1] + (0 if name else len(text.split())))
        paragraphs.append(paragraphs[-1] + (name == "p" and opens))
    article, past = _article(items, closes, words)
    i = 0
    while i < len(items):
        name, rest, opens = items[i]
        kind = ("other" if name in NEVER_CONTENT else name not in NEVER_SKIPPED and "=" in rest and _kind(rest)) if opens else ""
        if not kind:
            i += 1
            continue
        j = closes[i] + 1
        if closes[i]:
            main = article < 0 and kind != "comments" and (name == "form" or name not in NEVER_CONTENT) and 2 * (words[j] - words[i]) > words[-1] and paragraphs[j] - paragraphs[i] >= PARAGRAPHS
            if i < article < j or main:
                i += 1
                continue
        else:  # never closed
            j = i + 1
            while j < len(items) and (items[j][0] in ("", "!") or items[j][0].lstrip("/") in INLINE):
                j += 1
        out[i:j] = [True] * (j - i)
        i = j
    return out, article, past


def labelled(items: list[tuple[str, str, bool]]) -> list[bool] | None:
    """Which tokens stand inside the page's article; None if the page marks none."""
    for name in ("article", "main"):
        if any(t[0] == name for t in items):
            depth, out = 0, []
            for t in items:
                depth -= t[0] == "/" + name and depth > 0
                out.append(depth > 0)
                depth += t[0] == name and t[2]
            return out
    return None


def counted(page: str) -> Counter:
    """(kind, inside the article) -> number, of tags by name, of texts and of words; empty without article."""
    items = tokens(page)
    inside = labelled(items)
    found: Counter = Counter()
    for (name, text, _), within, skip in zip(items, inside or [], skipped(items)[0], strict=False):
        if name:
            found[name, within] += 1
        elif n := len(text.split()):
            found["#texts", within and not skip] += 1
            found["#words", within and not skip] += n
    return found


def weights(counts: Counter) -> dict[str, float]:
    """Positive for ``#word``, negative for tags and (``#tag``) for a tag that the labelled pages lack."""
    odds = {k: math.log((counts[k, True] + 0.5) / (counts[k, False] + 0.5)) for k in {k for k, _ in counts}}
    usual = (counts["#words", True] + 1) / (counts["#texts", True] + 1)
    word = max(1.0, odds.get("#words", 1.0)) / usual
    out = {k: min(v, 0.0) + INSIDE * word for k, v in odds.items() if not k.startswith("#")}
    inline = {k: max(v, -word) for k, v in out.items() if k.lstrip("/") in INLINE}  # a link or emphasis costs no more than a word
    return out | inline | {"#word": word, "#tag": -0.5}


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The main text: blocks in order, joined by an empty line."""
    items = tokens(page or "")
    skip, first, past = skipped(items)
    word, unknown = weight["#word"], weight["#tag"]
    best = (0.0, 0, 0)
    total, begin = 0.0, 0
    for i, (name, text, _) in enumerate(items):
        if skip[i]:
            score = 0.0
        elif not name:
            score = word * len(html.unescape(text).split())
        else:
            score = weight.get(name, unknown) if not first < i < past - 1 else INSIDE * word
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best[0]:
            best = (total, begin, i + 1)
    blocks: list[str] = []
    here: list[str] = []

    def close() -> None:
        if block := " ".join(html.unescape("".join(here)).split()):
            blocks.append(block)
        here.clear()

    for i in range(best[1], best[2]):
        name, text, _ = items[i]
        if name and name != "!" and name.lstrip("/") not in INLINE:
            close()
        elif not skip[i]:
            here.append(text if not name else " " if name.lstrip("/") == "br" else "")
    close()
    return "\n\n".join(blocks)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for page in batch.column(0):
            found += counted(page.as_py() or "")
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found]), pa.array([v for _, v in found]), pa.array(list(found.values()), type=pa.int64())], ["kind", "inside", "n"])


def train(pages: DataFrame, sample: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most ``sample`` labelled pages, of twice as many of the smallest hashes. Without any, every tag costs the same."""
    html_ = F.col("html")
    marked = html_.isNotNull() & F.lower(html_).rlike("<(article|main)[\\s>]")
    some = sampled(pages.select("page_id", "html"), ["page_id", "html"], 2 * sample, pages.count()).where(marked).limit(sample).select("html")
    rows = some.repartition(8).mapInArrow(_counts, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights(Counter({(r["kind"], r["inside"]): r["n"] for r in rows.where(F.col("n") > RARE).collect()}))


def main_text(pages: DataFrame, weight: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    Null html is empty and gives an empty text; page_id and url are passed on, null or not; repeated rows stay; an empty table gives no rows;
    other columns are left out. Pages of any length are scanned whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), weight) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
