"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is read once into blocks of text and the tags between them. Every word scores the sum
of the log-odds of where it stands (open elements, their class words, the block's own tag,
whether the block is mostly links); tags score negative. The log-odds come from labelled
pages: those of the table that mark their article with ``<article>`` or ``<main>``, of which
at most ``SAMPLE_PAGES`` are used, and a few fixed names known beforehand count as so many
labelled words. A linear scan finds the contiguous region with the highest sum; blocks inside
it whose own words score negative (an advert or a form within the article) are left out.

Names are only a first guess. Where the text that one element's name would leave out is much
longer than what the scan found, the article's element is named like something else, and the
page is scanned again with that name as evidence among the other weights. Words that say what an
element has or lacks (``has-sidebar``) name nothing, and ``article`` and ``main`` are what they
are whatever their class.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by an empty line. Null and empty pages give an empty text; markup that never closes
ends with the page; repeated pages are extracted alike.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 2_000
LIMIT = 4.0
BASE = 0.5
UNKNOWN_TAG = -0.2
KNOWN_WORDS = 500
NAMED_TIMES = 4  # times the text found, by which what names leave out makes a second scan

# Element names of HTML by their role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
LEAVES = frozenset("address blockquote center dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li p pre summary td th tr".split())
RAW = "script|style|noscript|template|textarea|iframe|object|select|svg|math|canvas|button|title|audio|video"
NOT_ARTICLE = frozenset("nav header footer aside form menu dialog fieldset".split())
# Class, id and role words that name what is not article text.
OUTER_WORDS = frozenset(
    """ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright
    dialog disclaimer disqus follow footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification
    overlay pagination pager popup promo promotion promoted recommended related reply replies respond search share sharing sidebar signup
    social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets comment comments discussion""".split()
)
TALK = frozenset("comment comments disqus reply replies respond".split())
# Words that make a class say what an element has, lacks or no longer is.
MODIFIERS = frozenset("has no with without is not hide non".split())
LACKING = frozenset("removed free less off none".split())
ARTICLE = frozenset(("article", "main"))
ARTICLE_WORDS = ("article", "main", "p", "h1", "h2", "blockquote", "pre")

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+(?:>.*?(?:</\1\b[^>]*+(?:>|\Z)|\Z)|\Z)|<(/?)([a-z][^\s/>]*+)((?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^'">])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PARTS = re.compile(r"[a-z0-9]+").findall


@dataclass
class Block:
    text: str
    keys: tuple[str, ...]
    words: int
    outer: bool  # inside an element that is something else than the article
    named: int  # number of the element around it that is only named like something else, or 0
    inside: bool  # inside a marked article
    tags: list[str] = field(default_factory=list)  # tags since the block before


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order, each with what stands around it."""
    out: list[Block] = []
    open_elements: list[tuple[str, tuple[str, ...], bool, int, bool, bool]] = []  # name, keys, outer, named, inside, talk
    page_itself = state = ("", (), False, 0, False, False)
    leaf, pieces, linked, in_link, tags = "", [], 0, False, []

    def flush() -> None:
        nonlocal pieces, linked, tags
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                words = text.count(" ") + 1
                keys = [*state[1], leaf] if leaf else [*state[1]]
                if 2 * linked > words:
                    keys.append("linked")
                out.append(Block(text, tuple(keys), words, state[2], 0 if state[2] else state[3], state[4], tags))
                tags = []
            pieces, linked = [], 0

    at = 0
    for found in TOKEN.finditer(page):
        if found.start() > at:
            text = page[at : found.start()]
            pieces.append(text)
            if in_link:
                linked += len(text.split())
        at = found.end()
        name = found[3]
        if name is None:
            continue
        name, closing = name.lower(), bool(found[2])
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name == "br":
                pieces.append(" ")
            continue
        flush()
        in_link = False
        tags.append(name)
        if name in LEAVES:
            leaf = "" if closing else name
            if closing or not found[4]:
                continue
        if closing:
            for depth in range(len(open_elements) - 1, -1, -1):
                if open_elements[depth][0] == name:
                    del open_elements[depth:]
                    state = open_elements[-1] if open_elements else page_itself
                    leaf = ""
                    break
            continue
        words = [PARTS(token) for groups in NAMES.findall(found[4]) for g in groups for token in g.lower().split()] if found[4] else []
        named = {w for token in words for w in token}
        guess = {w for token in words if token and token[0] not in MODIFIERS and token[-1] not in LACKING for w in token} & OUTER_WORDS
        if name in LEAVES:
            if not guess:
                continue
            open_elements = [e for e in open_elements if e[0] not in LEAVES]
        elif name in ("html", "body", "head"):
            continue
        elif not found[4].rstrip().endswith("/"):
            leaf = ""
        else:
            continue
        _, keys, outer, by_name, inside, talk = state
        talk = talk or bool(guess & TALK)
        if name in ARTICLE and not talk:
            outer, by_name, inside = False, 0, True
        elif guess - ({"header", "discussion"} if inside else set()):
            by_name = by_name or found.end()
        outer = outer or talk or (name in NOT_ARTICLE and not (inside and name == "header")) or bool(found[4] and HIDDEN.search(found[4]))
        state = (name, (*keys, name, *(f".{w}" for w in sorted(named))), outer, by_name, inside, talk)
        open_elements.append(state)
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


@dataclass
class Weights:
    keys: dict[str, float]
    tags: dict[str, float]

    def of_block(self, block: Block, doubted: int = 0) -> float:
        """The score of each word of a block; the names of the ``doubted`` element decide nothing."""
        total = BASE + sum(self.keys.get(k, 0.0) for k in set(block.keys))
        if block.outer or (block.named and block.named != doubted):  # left out in any case, so a long advert must not cut an article in two
            return -0.1
        return max(total, 1.0) if block.inside and not block.named else total

    def extract(self, page: str) -> str:
        """The page's main text."""
        blocks = blocks_of(page)
        found, words = self.region(blocks)
        apart = Counter()
        for b in blocks:
            if b.named and "linked" not in b.keys:
                apart[b.named] += b.words
        if apart and apart.most_common(1)[0][1] > NAMED_TIMES * words:
            found, _ = self.region(blocks, apart.most_common(1)[0][0])
        return found

    def region(self, blocks: list[Block], doubted: int = 0) -> tuple[str, int]:
        """(text, words) of the contiguous region with the highest sum."""
        best, top, total, start = 0.0, (0, 0), 0.0, 0
        scores = [self.of_block(b, doubted) for b in blocks]
        for i, (block, score) in enumerate(zip(blocks, scores, strict=True)):
            total += sum(self.tags.get(t, UNKNOWN_TAG) for t in block.tags)
            if total <= 0:  # the best region that ends here begins here
                total, start = 0.0, i
            total += score * block.words
            if total > best:
                best, top = total, (start, i + 1)
        begin, end = top
        kept = [b for b, s in zip(blocks[begin:end], scores[begin:end], strict=True) if s > 0]
        return "\n\n".join(b.text for b in kept), sum(b.words for b in kept)


def evidence(pages: list[str]) -> Counter:
    """Words by (kind, name, inside the marked article) over pages that mark one."""
    out: Counter = Counter()
    for page in pages:
        blocks = blocks_of(page)
        if not any(b.inside for b in blocks):
            continue
        for b in blocks:
            if b.outer or b.named:  # known by a fixed name; says nothing about the plain elements around it
                continue
            good = b.inside
            for k in set(b.keys):
                out["key", k, good] += b.words
            for t in b.tags:
                out["tag", t, good] += 1
    return out


def weights_from(counts: Counter) -> Weights:
    """Log-odds with the fixed names counted as so many labelled words."""
    counts = Counter(counts)
    for k in ARTICLE_WORDS:
        counts["key", k, True] += KNOWN_WORDS
    for k in (*NOT_ARTICLE, *(f".{w}" for w in OUTER_WORDS), "linked"):
        counts["key", k, False] += KNOWN_WORDS
    log: dict[str, dict[str, float]] = {"key": {}, "tag": {}}
    for kind, name in {(kind, name) for kind, name, _ in counts}:
        odds = float(np.log((counts[kind, name, True] + 10) / (counts[kind, name, False] + 10)))
        log[kind][name] = float(np.clip(odds, -LIMIT, LIMIT))
    return Weights(log["key"], {t: min(w, 0.0) - 0.1 for t, w in log["tag"].items()})


def learned(pages: DataFrame, key: str = "page_id", column: str = "html", sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most ``sample_pages`` pages that mark their article, those whose id hashes lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = evidence(batch.column(0).to_pylist())
            rows = [{"kind": k, "name": n, "inside": g, "words": w} for (k, n, g), w in counts.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("words", pa.int64())]))

    marked = F.lower(F.col(column)).rlike("<(article|main)[\\s>]")
    chosen = pages.filter(marked).select(F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("id")).orderBy("h", "id").limit(sample_pages)
    last = chosen.agg(F.max("h")).first()[0]
    if last is None:
        return weights_from(Counter())
    sample = pages.filter(marked & (F.xxhash64(F.col(key)) <= last)).select(F.col(column).alias("html"))
    rows = sample.mapInArrow(run, "kind string, name string, inside boolean, words long").groupBy("kind", "name", "inside").agg(F.sum("words").alias("words")).collect()
    return weights_from(Counter({(r.kind, r.name, r.inside): r.words for r in rows}))


def main_text(pages: DataFrame, weights: Weights, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; one pass without shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [shared.value.extract(v.as_py() or "") for v in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    chosen = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(column).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extracted(pages: DataFrame, **columns: str) -> DataFrame:
    """Learn the weights from the marked pages of the table and extract every page."""
    names = {k: v for k, v in columns.items() if k != "url"}
    return main_text(pages, learned(pages, **names), **columns)
