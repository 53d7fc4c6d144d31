"""Main text of web pages: a host suffix array over page token streams, and the pages' own markup.

A page is parsed into blocks, and the words of all blocks of every page, content or not, make its token
stream; a page's stream is one string of its host's concatenation. Its suffixes are sorted to the depth of
``run`` words, which is all it takes to tell whether a run of that length stands in another page:
neighbours that share so many words are one group, and longer repeats are starts that follow each other.
Hosts fill shards of a bounded number of words, one array each; a host of more words is dealt over
several, whose groups, not suffixes, meet by a hash of their words. So neither a host nor a menu with a
third of all pages gathers in one task. Words covered by a run that distinct pages of the host share are
boilerplate; the other runs of a block are kept. Copies of a whole page are one page in this.

The markup is a check behind it: what it calls a menu, footer, advert or the like goes even if it is unique,
and the longest article of a page (or its main) stays whole even where other pages hold its passages.
What markup can't tell, the array decides: all of a page without an article or main, and further articles
of a page, teasers or posts, beside its longest.
"""

from __future__ import annotations

import collections
import hashlib
import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookreplay.llm.common import cut, parts_for

# HTML element names and the class, id and role words that mark boilerplate.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "object", "svg", "canvas", "audio", "video", "map", "head"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "meter", "output", "progress", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr", "img",
}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice",
    "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "comment", "comments", "disqus", "respond", "share", "sharing",
    "social", "related", "recommended", "widget", "toolbar", "contentinfo", "complementary", "search", "alert", "banner",
}
#: Parts of compound class names that say nothing of what they hold, and those that turn a name round.
PLAIN = {
    "area", "bar", "block", "body", "box", "button", "buttons", "container", "content", "element", "group", "holder", "icons", "inner", "item", "items", "label", "layer", "layout", "left", "link",
    "links", "list", "module", "outer", "panel", "placeholder", "region", "right", "row", "section", "slot", "text", "title", "top", "unit", "view", "wrap", "wrapper", "zone",
}
TURNED = {"no", "not", "without", "with", "has", "hide", "hidden", "is"}
#: Marks in compound names only, and only outside articles.
COMPOUND = {"header", "masthead"}
#: What a page's text stands in: class marks on these elements don't decide.
HOLDERS = {"html", "body", "main", "article"}
CLOSED_BY_SAME = {"li", "option", "tr", "td", "th", "dd", "dt", "thead", "tbody"}

TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
MARKED = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+))", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}

CONTENT, OPEN, BOILERPLATE = 2, 1, 0
#: Hosts of several shards are joined by broadcast up to this many, else by a shuffle.
BROADCAST_HOSTS = 100_000
#: Characters of html for each word, by which shards are planned before pages are parsed.
WORD_CHARS = 8
#: Words of a host whose runs meet in one task, and bits of a run's key beyond those that number the host's words.
SLICE_WORDS, SPARE_BITS = 2_000_000, 7
#: Numbers of the octets, and the base of the powers, in hashes of words.
OCTETS, BASE = np.random.RandomState(9).randint(0, 2**63, 256).astype("u8") * np.uint64(2) + np.uint64(1), 0xD1342543DE82EF95
SHARD = ["shard", "parts", "host", "page_id", "url", "times", "copy", "blocks"]


def marks_of(attributes: str) -> set[str]:
    """Whole names: search-results is not search."""
    return {w for m in MARKED.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}


def compound_of(names: set[str]) -> set[str]:
    """What compound names are called after: their last part that isn't plain. ad-container is an ad,
    search-results are results, and no-sidebar is nothing."""
    out = set()
    for name in names:
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if len(parts) < 2 or TURNED & set(parts):
            continue
        while len(parts) > 1 and parts[-1] in PLAIN:
            parts.pop()
        out.add(parts[-1])
    return out


class Element:
    """An element and what holds it. ``dropped`` is by tags, here or above; ``marked`` by its own class,
    unless it ``holds`` the page's main or longest article; ``named`` is a mark by a compound name, which also
    yields where the element holds more than half of the page's ``text``; ``outer`` is the outermost article."""

    __slots__ = ("tag", "up", "article", "main", "inside", "dropped", "marked", "named", "outer", "holds", "size", "text", "known")

    def __init__(self, tag: str, up: Element | None, marks: set[str]):
        self.tag, self.up = tag, up
        self.article, self.main = tag == "article" or "articlebody" in marks, tag == "main" or "main" in marks
        inside = up is not None and up.inside
        self.inside = inside or self.article or self.main
        self.dropped = up is not None and up.dropped or tag in DROPPED or tag == "header" and not inside
        self.marked = not (tag in HOLDERS or self.article or self.main) and bool(marks & MARKS)
        called = compound_of(marks - MARKS)
        self.named = not (tag in HOLDERS or self.article or self.main) and bool(called & MARKS or called & COMPOUND and not self.inside)
        self.outer = up.outer if up is not None and up.outer else self if self.article and not self.dropped else None
        self.holds, self.size, self.text, self.known = False, 0, 0, None

    def hold(self) -> None:
        x = self
        while x and not x.holds:
            x.holds, x = True, x.up

    def state(self, total: int) -> tuple[bool, bool, bool]:
        """In boilerplate, in an article, in main; asked once it is known what holds the text."""
        path, x = [], self
        while x and not x.known:
            path.append(x)
            x = x.up
        bad, article, main = x.known if x else (False, False, False)
        for x in reversed(path):
            bad = bad or x.dropped or not x.holds and (x.marked or x.named and 2 * x.text <= total)
            article, main = article or x.article and not bad, main or x.main and not bad
            x.known = bad, article, main
        return bad, article, main


def parse(page: str) -> list[tuple[int, str]]:
    """Blocks of a page in order: (CONTENT, OPEN or BOILERPLATE, text with single spaces).

    Content stands in the longest article, or in main where there is no article; further articles beside it are
    open, as they may be teasers of other pages or parts of this one. Broken markup is read as
    browsers do: elements left open end with what holds them, a tag cut off at the end is dropped.
    Marks on what holds a main or the longest article say nothing: a theme's body or wrapper may be
    called anything, while a list of related articles holds short ones."""
    blocks: list[tuple[str, Element | None]] = []
    buffer: list[str] = []
    stack: list[Element] = []
    mains: list[Element] = []

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            blocks.append((text, stack[-1] if stack else None))

    def close(at: int) -> None:
        if any(x.tag not in INLINE for x in stack[at:]):
            flush()
        del stack[at:]

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            buffer.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            buffer.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if k is not None:
                close(k)
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append(" ")
            continue
        if tag not in INLINE:
            flush()
            k = len(stack)
            while k and stack[k - 1].tag in INLINE:
                k -= 1
            if k and (stack[k - 1].tag == "p" or tag in CLOSED_BY_SAME and stack[k - 1].tag == tag):
                del stack[k - 1 :]
        elif m[4].rstrip().endswith("/"):
            continue
        stack.append(Element(tag, stack[-1] if stack else None, marks_of(m[4])))
        if stack[-1].main and not stack[-1].dropped:
            mains.append(stack[-1])
    flush()
    for text, x in blocks:
        if x and x.outer and not x.dropped:
            x.outer.size += len(text)
        while x:
            x.text, x = x.text + len(text), x.up
    total = sum(len(text) for text, _ in blocks)
    outers = [x.outer for _, x in blocks if x and x.outer]
    longest = max(outers, key=lambda x: x.size) if outers else None
    for x in [*mains, *([longest] if longest else [])]:
        x.hold()
    states = [(t, *(x.state(total) if x else (False, False, False)), x.outer if x else None) for t, x in blocks]
    inside = 2 if any(b[2] for b in states) else 3 if any(b[3] for b in states) else None
    further = lambda b: inside == 2 and b[4] is not longest
    kind = lambda b: BOILERPLATE if b[1] or inside and not b[inside] else OPEN if not inside or further(b) else CONTENT
    return [(kind(b), b[0]) for b in states]


def packed(values: np.ndarray) -> bytes:
    """Rising unsigned numbers as compressed bytes: differences, equal bytes of all of them side by side."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(steps.view("u1").reshape(-1, 8).T.tobytes(), 1)


def unpacked(held: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(held), "u1").reshape(8, -1).T.copy().view("u8").ravel(), dtype="u8")


def shards_of(pages: DataFrame, words_each: int) -> DataFrame:
    """shard, parts, host, page_id, url, times, copy, blocks for every page, dealt by shard.

    A host of more than ``words_each`` words, by the length of its html, is in several shards (``parts``); its pages are
    dealt by their hash. Equal rows of a batch are one row with so many ``times``. ``copy`` is equal for pages whose words
    outside boilerplate are equal. ``blocks`` is a compressed text: a line for each block, its kind before it."""
    held = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^/]*://([^/?#]*)", 1))
    held = held.withColumn("host", F.xxhash64(host)).withColumn("row", F.xxhash64("page_id", "url", "html"))
    sizes = cut(held.groupBy("host").agg(F.sum(F.ceil(F.length("html") / WORD_CHARS)).alias("words")), "sizes")
    total = sizes.agg(F.sum("words")).first()[0] or 0
    large = sizes.where(F.col("words") > words_each).select("host", F.ceil(F.col("words") / words_each).alias("parts"))
    held = held.join(F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large, "host", "left")
    n = parts_for(total, words_each)
    part = F.coalesce(F.pmod("row", "parts"), F.lit(0))
    held = held.select(F.pmod(F.pmod("host", F.lit(n)) + part, F.lit(n)).alias("shard"), F.coalesce("parts", F.lit(1)).alias("parts"), "host", "page_id", "url", "row", "html")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            first: dict[int, int] = {}
            times = collections.Counter(first.setdefault(x, i) for i, x in enumerate(b.column("row").to_pylist()))
            copies, out = [], []
            for i in times:
                blocks = parse(b.column("html")[i].as_py() or "")
                own = " ".join(t for k, t in blocks if k != BOILERPLATE)
                copies.append(int.from_bytes(hashlib.blake2b(own.encode(), digest_size=8).digest(), "little", signed=True))
                out.append(zstandard.compress("\n".join(f"{k}{t}" for k, t in blocks).encode()))
            more = [pa.array(list(times.values()), pa.int32()), pa.array(copies, pa.int64()), pa.array(out, pa.binary())]
            held = [b.column(c).take(pa.array(list(times), pa.int64())) for c in SHARD[:5]]
            yield pa.RecordBatch.from_arrays(held + more, names=SHARD)

    kinds = ("long", "long", "long", "string", "string", "int", "long", "binary")
    found = held.mapInArrow(read, ", ".join(f"{c} {k}" for c, k in zip(SHARD, kinds)))
    return found.repartition(n, "shard")


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    return np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, base % 2**64, "u8")]), dtype="u8")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def streams(held: pd.DataFrame) -> tuple[list[bytes], list[np.ndarray]]:
    """The pages' blocks, a line for each, and the token streams of all their words, content or not. A token is a hash of
    host and word, so hosts share a shard and no run. A word's hash is a sum of its octets' numbers times powers, taken
    from running sums over all octets."""
    pages = [zstandard.decompress(b) for b in held["blocks"]]
    octets = np.frombuffer(b"".join(b"\n" + b for b in pages if b) + b"\n", "u1")
    gaps = np.flatnonzero((octets == 32) | (octets == 10))
    begins = gaps[:-1] + 1 + (octets[gaps[:-1]] == 10)  # behind the kind that a line begins with
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(OCTETS[octets] * powers(BASE, len(octets) - 1), dtype="u8")])
    words = (sums[gaps[1:]] - sums[begins]) * powers(pow(BASE, -1, 2**64), len(octets) - 1)[begins]
    ends = np.cumsum([len(b) + 1 if b else 0 for b in pages])
    sizes = np.diff(np.searchsorted(begins, ends), prepend=0)
    tokens = mixed(mixed(words) ^ np.repeat(held["host"].to_numpy("i8").view("u8"), sizes)).view("i8")
    return pages, np.split(tokens, np.cumsum(sizes)[:-1]) if len(pages) else []


def ranks(values: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones. Values and their places are sorted as one number where
    they fit in it."""
    at = max(1, len(values)).bit_length()
    if not len(values) or values.min() < 0 or int(values.max()).bit_length() + at > 63:
        return np.unique(values, return_inverse=True)[1].astype("i8")
    held = np.sort(values << at | np.arange(len(values)))
    step = held >> at
    rank = np.empty(len(values), "i8")
    rank[held & ((1 << at) - 1)] = np.cumsum(np.concatenate([[0], step[1:] != step[:-1]]))
    return rank


def suffix_array(tokens: np.ndarray, starts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at ``starts`` in order of their first ``run`` tokens, and for each but the first
    whether it shares all of these with the one before it.

    Ranks by prefixes of 1, 2, 4, ... tokens are made from pairs of ranks of half the length; a last pair
    that overlaps gives any other length. Every start has ``run`` tokens from it on."""
    rank, length = ranks(tokens), 1
    while length < run:
        step = min(length, run - length)
        later = np.full(len(rank), -1, "i8")
        later[: len(rank) - step] = rank[step:]
        rank = ranks(rank * (len(rank) + 1) + later + 1)
        length += step
    order = starts[np.argsort(rank[starts], kind="stable")]
    return order, rank[order[1:]] == rank[order[:-1]]


def repeats(tokens: list[np.ndarray], copies: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """Of page streams laid end to end: the suffix array's starts in order, the page and place of each, the
    group of equal runs that it is in, and for each group its first start and its smallest and largest copy."""
    sizes = np.asarray([len(t) for t in tokens], "i8")
    begins = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum()) - begins[page]
    starts = np.flatnonzero(place + run <= sizes[page])
    if not len(starts):
        none = np.empty(0, "i8")
        return none, none, none, none, none, none, none
    order, same = suffix_array(np.concatenate(tokens), starts, run)
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    group = np.cumsum(np.concatenate([[0], ~same]))
    held = copies[page[order]]
    return order, page[order], place[order], group, order[heads], np.minimum.reduceat(held, heads), np.maximum.reduceat(held, heads)


def run_keys(tokens: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """A hash of the ``run`` tokens from each place on, by which arrays of one host compare their groups."""
    key = np.zeros(len(at), "u8")
    for k in range(run):
        key = (key ^ tokens[at + k].astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view("i8")


def sent_runs(held: pd.DataFrame, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a host's pages in a shard: the keys of all runs, rising, and the smallest and largest copy that holds
    each: the suffix array's groups, in the order of keys."""
    tokens = streams(held)[1]
    sizes = np.asarray([len(t) for t in tokens], "i8")
    page = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(page)) + run <= np.cumsum(sizes)[page])
    if not len(starts):
        return np.empty(0, "u8"), np.empty(0, "i8"), np.empty(0, "i8")
    keys = run_keys(np.concatenate(tokens), starts, run).view("u8")
    order = np.argsort(keys)
    keys, copies = keys[order], held["copy"].to_numpy("i8")[page[starts[order]]]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.minimum.reduceat(copies, heads), np.maximum.reduceat(copies, heads)


def messages(shard: int, keys: np.ndarray, bits: int, slices: int, **more: np.ndarray) -> pd.DataFrame:
    """A row for each slice of the range of keys of so many bits, which the first 24 of them tell. The largest copy goes as
    its difference from the smallest, mostly none."""
    place = (keys >> np.uint64(bits - 24)) * np.uint64(slices) >> np.uint64(24)
    at = np.searchsorted(place, np.arange(slices + 1, dtype="u8"))
    full = [i for i in range(slices) if at[i] < at[i + 1]]
    more |= {"high": more["low"] ^ more["high"]} if more else {}
    out = {"slice": full, "shard": [shard] * len(full), "keys": [packed(keys[at[i] : at[i + 1]]) for i in full]}
    return pd.DataFrame(out | {c: [zstandard.compress(more[c][at[i] : at[i + 1]].tobytes()) if c in more else None for i in full] for c in ("low", "high")})


def met(held: pd.DataFrame) -> pd.DataFrame:
    """shard, keys: what each shard sent of a slice that distinct copies hold, or distinct shards where no copies were sent."""
    keys = [unpacked(k) for k in held["keys"]]
    at = np.cumsum([0, *(len(k) for k in keys)])
    if held["low"].isna().any():
        low = high = np.repeat(held["shard"].to_numpy("i8"), np.diff(at))
    else:
        low, high = (np.concatenate([np.frombuffer(zstandard.decompress(x), "i8") for x in held[c]]) for c in ("low", "high"))
        high = low ^ high
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    heads = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    hit = np.minimum.reduceat(low[order], heads) != np.maximum.reduceat(high[order], heads)
    found = np.empty(len(flat), bool)
    found[order] = np.repeat(hit, np.diff(np.append(heads, len(flat))))
    out = [(s, packed(k[found[a:z]])) for s, k, a, z in zip(held["shard"], keys, at, at[1:]) if found[a:z].any()]
    return pd.DataFrame({"shard": [s for s, _ in out], "keys": [k for _, k in out]})


def runs_across(shards: DataFrame, run: int, words_each: int) -> DataFrame:
    """shard, keys: the runs that a shard of a host with several holds and that stand in distinct pages of the host.

    Shards send the first bits of their runs' keys, so many that few runs of a host meet by chance; of runs that met in
    another shard, whole keys and copies, which decide. So a run that one shard alone holds costs a few bits,
    and of an array's groups none is left out."""
    sent = "host long, slice long, shard long, keys binary, low binary, high binary"
    found = "host long, shard long, keys binary"

    def plan(parts: int) -> tuple[int, int]:
        """Bits of a host's first keys, and slices that they go to."""
        words = int(parts) * words_each
        return min(64, max(24, words.bit_length() + SPARE_BITS)), parts_for(words, SLICE_WORDS)

    def first(keys: np.ndarray, bits: int) -> np.ndarray:
        keys = keys >> np.uint64(64 - bits)
        return np.concatenate([keys[:1], keys[1:][keys[1:] != keys[:-1]]])

    def together(rows: list[pd.DataFrame], schema: str) -> pd.DataFrame:
        return pd.concat(rows) if rows else pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")})

    def ask(held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (host, parts), own in held[held["parts"] > 1].groupby(["host", "parts"]):
            bits, slices = plan(parts)
            out.append(messages(held["shard"].iloc[0], first(sent_runs(own, run)[0], bits), bits, slices).assign(host=host))
        return together(out, sent)

    def tell(held: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (host, parts), own in held[held["parts"] > 1].groupby(["host", "parts"]) if len(near) else []:
            asked = [unpacked(k) for k in near["keys"][near["host"] == host]]
            if asked:
                bits, slices = plan(parts)
                keys, low, high = sent_runs(own, run)
                hit = np.isin(keys >> np.uint64(64 - bits), np.concatenate(asked))
                out.append(messages(held["shard"].iloc[0], keys[hit], 64, slices, low=low[hit], high=high[hit]).assign(host=host))
        return together(out, sent)

    def meet(held: pd.DataFrame) -> pd.DataFrame:
        return met(held).assign(host=held["host"].iloc[0])

    near = shards.groupBy("shard").applyInPandas(ask, sent).groupBy("host", "slice").applyInPandas(meet, found)
    told = shards.groupBy("shard").cogroup(near.groupBy("shard")).applyInPandas(tell, sent)
    return told.groupBy("host", "slice").applyInPandas(meet, found)


def covered_words(starts: list[int], sizes: list[int], run: int) -> set[int]:
    """Places of the words that repeated runs cover. Starts that follow each other are one run, which covers a block's
    words where it holds the whole block or ``run`` words of it."""
    out: set[int] = set()
    ends = list(accumulate(sizes))
    i = 0
    while i < len(starts):
        k = i
        while k + 1 < len(starts) and starts[k + 1] == starts[k] + 1:
            k += 1
        lo, hi = starts[i], starts[k] + run
        for j in range(bisect_right(ends, lo), len(ends)):
            begin = ends[j] - sizes[j]
            if begin >= hi:
                break
            a, b = max(lo, begin), min(hi, ends[j])
            if b - a >= run or (a, b) == (begin, ends[j]):
                out.update(range(a, b))
        i = k + 1
    return out


def main_text(pages: DataFrame, run: int = 8, words_each: int = 262_144) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    A null or empty html has no text. Repeated rows, and pages of a host with the same words outside
    boilerplate, count as one page when runs are looked for, so a page is never boilerplate to its own
    copy; they are returned each. Pages without a host share the empty one. Other columns are not
    carried; an empty table gives no rows."""
    shards = shards_of(pages, words_each)

    def keep(held: pd.DataFrame, across: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return pd.DataFrame({"page_id": [], "url": [], "times": [], "text": []})
        pages_of, tokens = streams(held)
        starts, page, place, group, heads, low, high = repeats(tokens, held["copy"].to_numpy("i8"), run)
        repeated = low != high
        if len(across) and len(heads):
            keys = run_keys(np.concatenate(tokens), heads, run).view("u8")
            repeated |= np.isin(keys, np.concatenate([unpacked(k) for k in across["keys"]]))
        hit = repeated[group]
        order = np.argsort(starts[hit])  # by page and place
        page, place = page[hit][order], place[hit][order]
        ends = np.searchsorted(page, np.arange(len(tokens) + 1))
        out = []
        for i, blocks in enumerate(pages_of):
            of = [(int(x[0]), x[1:]) for x in blocks.decode().split("\n") if x]
            covered: set[int] = set()
            if ends[i] < ends[i + 1] and any(k == OPEN for k, _ in of):
                covered = covered_words(place[ends[i] : ends[i + 1]].tolist(), [t.count(" ") + 1 for _, t in of], run)
            at, kept = 0, []
            for kind, t in of:
                if kind == CONTENT or kind == OPEN and not covered:
                    kept.append(t)
                elif kind == OPEN:
                    kept += [w for j, w in enumerate(t.split(" "), at) if j not in covered]
                at += t.count(" ") + 1
            out.append(" ".join(kept))
        return held[["page_id", "url", "times"]].assign(text=out)

    across = runs_across(shards, run, words_each)
    found = shards.groupBy("shard").cogroup(across.groupBy("shard")).applyInPandas(keep, "page_id string, url string, times int, text string")
    found = found.withColumn("time", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
