"""Main text of web pages: markup rules, then what a host's pages repeat, as its suffix array would show it.

Each page becomes blocks of words, in page order, without those that markup gives away: scripts, styles, forms, menus,
headers, footers, sidebars, notices, adverts and comments; what is in them goes with them, article cards too. Where a page's
articles have as many words as what is around them in its main element, or in all of the page if it has none, they are the main
text; else they are cards, and all of the main element or page is.

The token streams of a host's pages are then searched for substrings that distinct pages repeat: whole blocks, and any RUN words
or more within longer ones, wherever they begin. In a suffix array those are the neighbours that have RUN words in common. Such
neighbours are exactly the suffixes whose first RUN words are equal, so they are brought together by a hash of these and counted
as sums, which leaves a host of any size in many tasks; the order of suffixes that differ before is of no use here, and is not
made. First only suffixes that winnowing picks by content are counted, one at least of any RUN + PICK - 1 words in common; then
all suffixes of the blocks in which one of those repeats. What is covered by repeated runs is cut, from within blocks too, and
unique runs stay.

Pages alike in their main text count once, so copies of an article do not remove it. Within an article or main element only what
nearly all pages of a host repeat goes, since authors repeat themselves too; without one a share of them will do.

Pages are read two or three times, and neither pages nor texts are shuffled where the table of boilerplate is small, as Spark sees
from its files; else pages meet it by a join on the host. Null html counts as empty and gives an empty text. Pages without a host
share the empty one. Unclosed elements end with their surroundings, cut-off pages with their last character. Very long pages take
time in proportion to their length. Rows alike are extracted each on its own. Columns other than page_id, url and html aren't read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable
from .runs import BASE, Runs, least_at
from .url_filter import host_of

#: Words of a repeated run, and neighbours among which one suffix is picked.
RUN, PICK = 24, 9
#: At least so many of a host's distinct pages, and by zone (other, main, article) such a share of them, repeat boilerplate.
LEAST_PAGES = 3
LEAST_SHARE = (0.3, 0.9, 0.9)
OTHER, MAIN, ARTICLE = range(3)

#: Elements that hold no main text, elements that part blocks, and elements without content.
DROPPED = frozenset("nav footer aside form script style noscript template head title button select option textarea iframe svg object menu dialog canvas audio video label fieldset input".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Words in classes, ids and roles of elements that hold no main text.
TELLTALE = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner sidebar menu nav navbar navigation footer breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert comment comments respond disqus share sharing social newsletter subscribe subscription signup login popup modal overlay related recommended recommendations widget masthead toolbar pagination pager copyright legal search complementary contentinfo skip".split())
HEADERS = frozenset("header banner masthead".split())
#: Words beside those in whole names; headings; elements that end where the next of their kind begins.
PARTS = frozenset("box block container wrapper wrap area list item items link links bar unit slot inner outer top bottom left right section form button buttons posts stories".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd td th tr".split())

TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[!?/][^>]*>?)")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


def _telltale(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is left out for its class, id or role: within an article or main element only by a whole name, and only a block that is no heading."""
    for groups in NAMED.findall(attributes):
        for called in "".join(groups).lower().split():
            if not called.startswith(("has-", "with-", "no-", "is-")):
                words = {w for w in re.split(r"[^a-z]+", called) if w}
                if not inside and words & (TELLTALE | HEADERS):
                    return True
                if inside and words & TELLTALE and words <= TELLTALE | PARTS and name in BLOCKS and name not in HEADINGS:
                    return True
    return bool(HIDDEN.search(attributes))


Tag = tuple[int, int, str, bool, str]


def _tags(html: str) -> Iterator[Tag]:
    """start, end, name, whether it closes, attributes; an element whose content is no markup is one tag, without a name if it is a comment."""
    at = 0
    while m := TAG.search(html, at):
        at = m.end()
        if m[1]:
            close = html.find("-->", at - 2)
            at = len(html) if close < 0 else close + 3
            yield m.start(), at, "", False, ""
            continue
        name = (m[3] or "").lower()
        if name in RAW and not m[2]:
            close = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(html, at)
            at = len(html) if close is None else close.end()
        yield m.start(), at, name, bool(m[2]), m[4] or ""


def _partners(tags: list[Tag]) -> list[int]:
    """For each tag the number of the one that closes or opens its element; -1 where there is none."""
    partner, open_ = [-1] * len(tags), {}
    for i, (_, _, name, closes, _) in enumerate(tags):
        if not closes:
            open_.setdefault(name, []).append(i)
        elif open_.get(name):
            partner[i] = open_[name].pop()
            partner[partner[i]] = i
    return partner


def _after(tags: list[Tag], partner: list[int], i: int) -> int:
    """The first tag behind the element that tag i opens; one that is not closed ends with its surroundings."""
    name, closed = tags[i][2], partner[i]
    for k in range(i + 1, len(tags)):
        other, closes = tags[k][2], tags[k][3]
        if k == closed:
            return k + 1
        if closes:
            if other in ("article", "main", "body", "html") and -1 < partner[k] < i:
                return k
            if closed < 0 and name in ITEMS and other in ("ul", "ol", "table", "dl", "div", "section") and partner[k] < i:
                return k
        elif name == "p" and other in BLOCKS or closed < 0 and (other in ("article", "main") or name in ITEMS and other == name):
            return k
    return len(tags)


def _words(blocks: list[str]) -> int:
    return sum(b.count(" ") + 1 for b in blocks)


def blocks_of(html: str) -> tuple[int, list[str]]:
    """The zone of the main text and its blocks, each without white space but single blanks.

    Articles are the main text where they hold at least half of it; shorter ones are cards, which stay with what is around them.
    """
    found: list[tuple[int, bool, str]] = []
    run: list[str] = []
    depth = {"article": 0, "main": 0}
    tags = list(_tags(html))
    partner = _partners(tags)

    def flush() -> None:
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if text:
                found.append((ARTICLE if depth["article"] else MAIN if depth["main"] else OTHER, bool(depth["main"]), text))

    i = at = 0
    while i < len(tags):
        start, end, name, closes, attributes = tags[i]
        run.append(html[at:start])
        at, i = end, i + 1
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if name in RAW and not closes:
            continue
        if name in depth:
            depth[name] = max(0, depth[name] + (-1 if closes else 1))
        elif name == "br":
            run.append(" ")
        if closes or name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        inside = bool(depth["article"] or depth["main"])
        if name in DROPPED or name == "header" and not inside or name not in ("html", "body", "main") and attributes and _telltale(name, attributes, inside):
            if name in depth:
                depth[name] -= 1
            # An inline element is cut out of its block, which goes on.
            opened = i - 1
            i = _after(tags, partner, opened)
            at = (tags[i - 1][1] if i - 1 == partner[opened] else tags[i][0]) if i < len(tags) or i - 1 == partner[opened] else len(html)
    run.append(html[at:])
    flush()
    article, main, other = ([t for z, _, t in found if z == zone] for zone in (ARTICLE, MAIN, OTHER))
    if article and _words(article) >= _words(main or other):
        return ARTICLE, article
    if main:
        return MAIN, [t for _, held, t in found if held]
    return OTHER, [t for _, _, t in found]


class Suffixes:
    """The suffixes of a page's blocks by the hashes of their first RUN words; a shorter block has one, of all its words and its end."""

    def __init__(self, zone: int, blocks: list[str]):
        words = [b.split(" ") for b in blocks]
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = [w for block in words for w in block]
        hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.empty(0, np.uint64)
        runs, owner = Runs(hashed.view(np.int64)), np.repeat(np.arange(len(blocks)), self.sizes)
        begin, short = np.cumsum(self.sizes) - self.sizes, self.sizes < RUN
        every = runs.all(RUN)
        inside = np.flatnonzero(owner[: len(every)] == owner[RUN - 1 :]) if len(every) else np.empty(0, np.int64)
        whole = runs.at(begin[short], self.sizes[short]) ^ np.uint64(BASE)
        block = np.concatenate((owner[inside], np.flatnonzero(short)))
        order = np.argsort(block, kind="stable")
        #: For each suffix its block, its place there and its hash, in order.
        self.block = block[order]
        self.place = np.concatenate((inside - begin[owner[inside]], np.zeros(int(short.sum()), np.int64)))[order]
        self.hash = (np.concatenate((every[inside], whole))[order] ^ np.uint64((zone + 1) * 0x94D049BB133111EB % (1 << 64))).view(np.int64)

    def picked(self) -> np.ndarray:
        """Hashes of those that are the least of PICK neighbours of their block; of a block with fewer, all."""
        n = np.bincount(self.block, minlength=len(self.sizes))
        taken = (n < PICK)[self.block]
        if len(self.hash) >= PICK:
            taken[least_at(self.hash, PICK)[self.block[: len(self.block) - PICK + 1] == self.block[PICK - 1 :]]] = True
        return np.unique(self.hash[taken])

    def of_blocks_with(self, known: np.ndarray) -> np.ndarray:
        """Hashes of all suffixes of the blocks that have one of those known."""
        hit = np.unique(self.block[np.isin(self.hash, known)])
        return np.unique(self.hash[np.isin(self.block, hit)])


def unique_runs(zone: int, blocks: list[str], repeated: np.ndarray) -> list[str]:
    """The blocks without the words that repeated runs cover; blocks that are covered whole go."""
    suffixes = Suffixes(zone, blocks)
    hit = np.isin(suffixes.hash, repeated)
    if not hit.any():
        return blocks
    # Suffixes come in order of their blocks.
    places_hit, ends = suffixes.place[hit], np.searchsorted(suffixes.block[hit], np.arange(len(blocks) + 1))
    out = []
    for i, block in enumerate(blocks):
        places = places_hit[ends[i] : ends[i + 1]]
        if len(places):
            depth = np.zeros(int(suffixes.sizes[i]) + RUN + 1, dtype=np.int64)
            np.add.at(depth, places, 1)
            np.add.at(depth, places + RUN, -1)
            block = " ".join(w for w, covered in zip(block.split(" "), np.cumsum(depth).tolist(), strict=False) if not covered)
        if block:
            out.append(block)
    return out


def _digest(blocks: list[str]) -> bytes:
    return hashlib.sha256("\n".join(blocks).encode("utf-8", "replace")).digest()[:16]


_SUFFIXES = "zone int, digest binary, hashes array<long>"


def _sampled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        out = []
        for page in pages:
            zone, blocks = blocks_of(page or "")
            out.append((zone, _digest(blocks), Suffixes(zone, blocks).picked()))
        yield pd.DataFrame(out, columns=["zone", "digest", "hashes"])


def _whole(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """All suffixes of the blocks that have one of the repeated ones."""
    for pages, repeated in batches:
        out = []
        for page, hashes in zip(pages, repeated, strict=True):
            zone, blocks = blocks_of(page or "")
            out.append((zone, _digest(blocks), Suffixes(zone, blocks).of_blocks_with(np.asarray(hashes, dtype=np.int64))))
        yield pd.DataFrame(out, columns=["zone", "digest", "hashes"])


def _kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, repeated in batches:
        out = []
        for page, hashes in zip(pages, repeated, strict=True):
            zone, blocks = blocks_of(page or "")
            if hashes is not None and len(hashes):
                blocks = unique_runs(zone, blocks, np.asarray(hashes, dtype=np.int64))
            out.append("\n".join(blocks))
        yield pd.Series(out)


def _repeated(suffixes: DataFrame, least: DataFrame, name: str) -> DataFrame:
    """host and the hashes of suffixes that enough of its distinct pages have; hosts without any have no row."""
    once = suffixes.join(least.select("at", "zone").distinct(), ["at", "zone"], "left_semi").groupBy("at", "zone", "digest").agg(F.first("hashes").alias("hashes"))
    counted = once.select("at", "zone", F.explode("hashes").alias("hash")).groupBy("at", "zone", "hash").agg(F.count("*").alias("n"))
    # Per host and zone fewer than a page's suffixes over the share.
    return durable(counted.join(least, ["at", "zone"]).where("n >= least").groupBy("host").agg(F.collect_set("hash").alias("repeated")), name)


def boilerplate(pages: DataFrame) -> DataFrame:
    """host and the hashes of the suffixes that its distinct pages repeat."""
    pages = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    sampled = pages.select(F.xxhash64("host").alias("at"), "host", F.pandas_udf(_sampled, _SUFFIXES)("html").alias("s"))
    sampled = durable(sampled.select("at", "host", "s.*"), "suffixes")
    counted = sampled.groupBy("at", "host", "zone").agg(F.countDistinct("digest").alias("pages"))
    share = F.element_at(F.array(*map(F.lit, LEAST_SHARE)), F.col("zone") + 1)
    least = counted.select("at", "host", "zone", F.greatest(F.lit(float(LEAST_PAGES)), share * F.col("pages")).alias("least"), "pages").where("least <= pages")
    least = durable(least.drop("pages"), "hosts")
    seen = _repeated(sampled, least, "samples")
    # Then each suffix of the blocks that hold one of those.
    met = pages.join(seen.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"))
    whole = met.select(F.xxhash64("host").alias("at"), "host", F.pandas_udf(_whole, _SUFFIXES)("html", "repeated").alias("s"))
    return _repeated(durable(whole.select("at", "host", "s.*"), "whole"), least, "boilerplate")


def main_text(pages: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """page_id, url and text of every page."""
    repeated = (boilerplate(pages) if repeated is None else repeated).withColumnRenamed("host", "_host")
    joined = pages.select("page_id", "url", "html").join(repeated, host_of(F.col("url")) == F.col("_host"), "left")
    return joined.select("page_id", "url", F.pandas_udf(_kept, "string")(F.coalesce("html", F.lit("")), "repeated").alias("text"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
