"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks.  A block has its word count and link share, those
of the blocks before and after it, the kind of element it stands in, how much of its class
names tell of a place without main text, and how large and how linked the innermost such place
is.  A decision tree trained on the pages of :mod:`html_examples` weighs these; no name
decides by itself.  The trained tree is compiled to a column expression.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import html_examples
from tidemark.llm.common import field, ship

ship(__name__)

# Element names and the words of class, id and role that mark places without main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
HIDDEN_INLINE = frozenset("noscript template svg math iframe object select button canvas audio video datalist script style textarea".split())
HIDDEN = HIDDEN_INLINE | {"head", "dialog"}
ASIDE = frozenset("nav footer aside form menu".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
ITEMS = frozenset("li dt dd tr td th option".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot tr div section article main aside nav body".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notification alert popup modal overlay subscribe subscription newsletter signup signin login register share sharing social comment comments "
    "respond reply replies disqus discussion related recommended recommendations widget toolbar pagination pager copyright legal search contentinfo complementary form dialog skip".split()
)
OF_TEXT = frozenset("article entry post story content title section chapter".split())  # whose headers are main text
TEXT_NAMES = frozenset("article entry post story content chapter body main text".split())
FILLING = frozenset("list item items wrapper wrap box bar area block container inner outer left right top bottom side site page global col row section posts links form button".split())
NEUTRAL = frozenset("with has no without layout".split())
FEATURES = ("words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after", "heading", "scope", "aside", "named", "place_share", "place_links", "told")
BLOCKS = "array<struct<text: string, main: int, " + ", ".join(f"{f}: double" for f in FEATURES) + ">>"

PLACES = ("aside", "full", "part")

_TAG = re.compile(r"[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_PLACE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_UNSEEN = re.compile(r"""display\s*:\s*none|aria-hidden\s*=\s*["']?true|\shidden(?=[\s>/=])""", re.I)
_WORD = re.compile(r"[a-z]+")


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content) of each piece of a page in one pass; kinds are text, open and close."""
    at, size, quoted = 0, len(page), True
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        named = _NAME.match(page, start + 1)
        if not named and page[start + 1 : start + 2] not in ("!", "?", "/"):
            yield "text", "", page[at : start + 1]
            at = start + 1
            continue
        if start > at:
            yield "text", "", page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        end = page.find(">", start)
        if end < 0:
            return
        if named and quoted and re.search("[\"']", page[start:end]):
            whole = _TAG.match(page, start)
            quoted = whole is not None  # a quote that never ends: from here on a tag ends at its first >
            end = whole.end() - 1 if whole else end
        at = end + 1
        if not named:
            continue
        name, closing = named[1].lower(), page[start + 1] == "/"
        yield ("close" if closing else "open"), name, page[named.end() : end]
        if name in RAW and not closing:
            closed = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = closed.start() if closed else size


class _Page:
    """Collects the blocks of one page."""

    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.stack: list[tuple[str, str]] = []  # (name, mark): hidden, aside, full, part, main or nothing
        self.open: Counter = Counter()
        self.marks: Counter = Counter()
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.heading = self.labelled = False
        self.own = ""  # the mark of a paragraph
        self.inside = [0]  # numbers of the open places that are marked, the innermost last
        self.places = 0
        self.told = 0.0  # share of telling words in the last heading
        self.has_main = False

    def text(self, content: str) -> None:
        if not self.marks["hidden"]:
            content = html.unescape(content) if "&" in content else content
            self.parts.append(content)
            if self.open["a"]:
                self.linked.append(content)

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            words = text.count(" ") + 1
            linked = min(words, len(" ".join(self.linked).split()))
            if self.heading:
                heard = _WORD.findall(text.lower())
                self.told = sum(w in HINTS for w in heard) / max(1, len(heard))
            place = self.inside[-1]
            if self.own:
                self.places += 1
                place = self.places
            aside = self.marks["aside"] > 0 or self.own in ("aside", "hidden")
            named = 1.0 if self.marks["full"] or self.own == "full" else 0.5 if self.marks["part"] or self.own == "part" else 0.0
            self.blocks.append({
                "text": text, "main": int(self.labelled), "words": float(words), "link_share": linked / words, "heading": float(self.heading),
                "scope": float(bool(self.marks["main"])), "aside": float(aside), "named": named, "told": 0.0 if self.marks["main"] else self.told, "place": place, "linked": linked,
            })
        self.parts, self.linked, self.heading, self.own, self.labelled = [], [], False, "", False

    def _mark(self, name: str, attributes: str) -> str:
        if name in HIDDEN or (attributes and _UNSEEN.search(attributes)):
            return "hidden"
        if name in MAIN and not self.marks["aside"]:
            return "main"
        if name in ASIDE or (name == "header" and not self.marks["main"]):
            return "aside"
        if name in ("html", "body") or "=" not in attributes:
            return ""
        full = part = text = False
        for found in _PLACE.findall(attributes):
            for one in found.strip("\"'").lower().split():
                words = set(_WORD.findall(one))
                if not words or words & NEUTRAL:
                    continue
                banner = "header" in words and not words & OF_TEXT and not self.marks["main"]
                full |= bool(words & HINTS and words <= HINTS | FILLING | TEXT_NAMES) or banner
                part |= bool(words & HINTS)
                text |= words <= TEXT_NAMES
        return "full" if full and not text else "part" if full or part else ""

    def start(self, name: str, attributes: str) -> None:
        block = name not in INLINE and name not in HIDDEN_INLINE
        if name == "body":
            self.close("head")
        elif name == "a":
            self.close("a")
        if block:
            self.end_block()
        elif name == "br":
            self.text(" ")
        if name in VOID or name in RAW:
            return
        mark = self._mark(name, attributes)
        if name == "p":  # ends at the next block, so it needs no place in the stack
            self.own = mark if mark != "main" else ""
        else:
            if name in ITEMS and self.open[name]:
                for place in range(len(self.stack) - 1, -1, -1):
                    if self.stack[place][0] == name:
                        self.leave(place)
                        break
                    if self.stack[place][0] in LISTS:
                        break
            self.stack.append((name, mark))
            self.open[name] += 1
            self.marks[mark] += 1
            if mark in PLACES:
                self.places += 1
                self.inside.append(self.places)
            self.has_main |= mark == "main"
        if block:
            self.heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
            self.labelled = "data-main" in attributes

    def leave(self, place: int) -> None:
        for name, mark in self.stack[place:]:
            self.open[name] -= 1
            self.marks[mark] -= 1
            if mark in PLACES:
                self.inside.pop()
        del self.stack[place:]

    def close(self, name: str) -> None:
        if name not in INLINE and name not in HIDDEN_INLINE:
            self.end_block()
        if self.open[name]:
            place = len(self.stack) - 1
            while self.stack[place][0] != name:
                place -= 1
            self.leave(place)

    def finish(self) -> list[dict]:
        self.end_block()
        edge = {"words": 0.0, "link_share": 0.0}
        words, linked = Counter(), Counter()
        for block in self.blocks:
            words[block["place"]] += block["words"]
            linked[block["place"]] += block["linked"]
        total = sum(words.values())
        for i, block in enumerate(self.blocks):
            before, after = self.blocks[i - 1] if i else edge, self.blocks[i + 1] if i + 1 < len(self.blocks) else edge
            block |= {"words_before": before["words"], "link_share_before": before["link_share"], "words_after": after["words"], "link_share_after": after["link_share"]}
            block["scope"] = block["scope"] if self.has_main else 0.5
            place = block.pop("place")
            block["place_share"], block["place_links"] = (words[place] / total, linked[place] / words[place]) if place else (1.0, 0.0)
            del block["linked"]
        return self.blocks


def blocks(page: str | None) -> list[dict]:
    """The text blocks of a page in order, with their features."""
    found = _Page()
    for kind, name, content in _tokens(page or ""):
        if kind == "text":
            found.text(content)
        elif kind == "open":
            found.start(name, content)
        else:
            found.close(name)
    return found.finish()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "blocks": [blocks(x) for x in batch["html"]]})


def fit(spark: SparkSession, examples: tuple[str, ...] = html_examples.EXAMPLES, depth: int = 8) -> str:
    """The decision tree over the blocks of the labelled pages, as Spark ML's text form."""
    rows = [(float(b["main"]), Vectors.dense([b[f] for f in FEATURES])) for page in examples for b in blocks(page)]
    table = spark.createDataFrame(rows, ["label", "features"])
    return DecisionTreeClassifier(maxDepth=depth, seed=1, maxBins=64, minInstancesPerNode=12, minInfoGain=0.003).fit(table).toDebugString


def compile_tree(text: str, feature: dict[str, Column]) -> Column:
    """A column that is true where the tree predicts class 1."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node(at: int) -> tuple[Column, int]:
        if leaf := re.fullmatch(r"Predict: (.+)", lines[at]):
            return F.lit(float(leaf[1]) >= 0.5), at + 1
        number, bound = re.fullmatch(r"If \(feature (\d+) <= (.+)\)", lines[at]).groups()
        yes, at = node(at + 1)
        no, at = node(at + 1)  # past the Else line
        return F.when(feature[FEATURES[int(number)]] <= float(bound), yes).otherwise(no), at

    return node(0)[0]


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, n_blocks.

    One row per input row, from the whole html.  Null or empty html, and pages without main
    text, give an empty text; repeated rows give repeated results; a null url stays null;
    other columns are not read.
    """
    spark = pages.sparkSession
    tree = fit(spark)
    source = pages.select(field(pages, "page_id", "long").alias("page_id"), field(pages, "url", "string").alias("url"), field(pages, "html", "string").alias("html"))
    parsed = source.mapInPandas(_parse, f"page_id long, url string, blocks {BLOCKS}")
    kept = F.filter("blocks", lambda b: compile_tree(tree, {f: b[f] for f in FEATURES}))
    joined = parsed.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"), F.size("blocks").alias("n_blocks"))
    return joined.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
