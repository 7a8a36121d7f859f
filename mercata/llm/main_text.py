"""Main text of web pages: mark-up first, then a suffix array over each host's other text.

What a page itself marks as its article is its main text, and what it marks as
navigation, footer, advert and the like isn't. All its text outside an article
joins the host's token stream, a page's runs end to end. The stream's suffixes
are sorted over the whole cluster, cut to ``min_tokens`` tokens; neighbours
with an LCP of that length that lie on distinct pages are a repeated
substring. Tokens it covers are boilerplate: blocks without any mark (pages
without an article, bare divisions) lose them and keep their unique runs.

A host may hold a third of all pages: equal runs of a host are one row before
the sort, and the range partitions of the sort cut through a prefix that many
runs share; the two groups at a partition's ends are settled between
partitions afterwards.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from mercata.llm.common import shared_table

SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "textarea", "select", "button", "title"}
SIDE = {"nav", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Blocks that end where another block begins.
IMPLIED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Whole words of a class, id or role that say what a part of a page is.
SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs"
    r"|footer|header|masthead|sidebar|aside|complementary|contentinfo|widget|related|recommended|share|sharing|social|cookie|cookies|consent|notice|notices"
    r"|alert|popup|modal|newsletter|subscribe|signup|login|search|form|comment|comments|respond|disqus|replies|copyright|legal|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:$|[\s_-]?(?:body|content|text|main)?$)", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^<>\"']+|\"[^\"<]*\"|'[^'<]*'|\"[^\"]{0,4000}\"|'[^']{0,4000}')*+)>",
    re.S,
)
LOOSE = re.compile(r"</?[a-zA-Z][^<>]*(?:>|$)")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true)", re.I)

OPEN, ARTICLE, ASIDE = 0, 1, 2


def _mark(tag: str, attributes: str, inside: int) -> int:
    """What an element says about the text in it: OPEN, ARTICLE or ASIDE; an article ends at what isn't one."""
    if inside == ASIDE or tag in SIDE or (attributes and HIDDEN.search(attributes)):
        return ASIDE
    if tag in MAIN:
        # an article inside one may be a reader's comment, which its class says
        names = [" ".join(m) for m in NAMES.findall(attributes)] if attributes else []
        return ASIDE if any(SIDE_WORDS.search(x.strip()) for x in names) else ARTICLE
    if tag == "header":
        return inside if inside == ARTICLE else ASIDE
    if attributes and tag in BLOCKS and tag not in ("html", "body"):
        for m in NAMES.findall(attributes):
            name = "".join(m).strip()
            if SIDE_WORDS.search(name):
                return ASIDE
            if inside == OPEN and MAIN_WORDS.search(name):
                return ARTICLE
    return inside


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(mark, text) of a page's blocks in order; text is decoded, white space is one space."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    opened: Counter[str] = Counter()
    source, at = html or "", 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1][1], text))
            parts.clear()

    while at < len(source):
        m = TOKEN.search(source, at)
        end = m.start() if m else len(source)
        if end > at:
            piece = source[at:end]
            piece = LOOSE.sub(" ", piece) if "<" in piece else piece
            parts.append(unescape(piece) if "&" in piece else piece)
        if m is None:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag in BLOCKS:
                flush()
                if opened[tag]:  # what is still open inside ends with it
                    while stack[-1][0] != tag:
                        opened[stack.pop()[0]] -= 1
                    opened[stack.pop()[0]] -= 1
            continue
        attributes = m.group(3)
        if tag in SKIPPED:
            if tag == "head" or attributes.endswith("/"):
                if tag == "head":  # its title and scripts go with it
                    close = re.compile(r"</head\s*>|<body[\s>]", re.I).search(source, at)
                    at = close.start() if close else at
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close.end() if close else len(source)
            parts.append(" ")
            continue
        if tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            ends = [k for k in (len(stack) - 1, len(stack) - 2) if k > 0 and tag in IMPLIED.get(stack[k][0], ())]
            while ends and len(stack) > min(ends):
                opened[stack.pop()[0]] -= 1
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in BLOCKS:
            stack.append((tag, _mark(tag, attributes, stack[-1][1])))
            opened[tag] += 1
    flush()
    return out


def runs_of(parsed: list[tuple[int, str]]) -> list[list[int]]:
    """Places of the blocks outside articles, cut where an article comes between."""
    out: list[list[int]] = [[]]
    for place, (mark, _) in enumerate(parsed):
        if mark == ARTICLE:
            out.append([])
        else:
            out[-1].append(place)
    return [run for run in out if run]


def page_text(html: str | None, repeats: dict[int, list[int]], depth: int) -> tuple[str, int]:
    """Main text of a page, and the tokens that its unmarked blocks lost.

    ``repeats`` has, by the place of a run in the page, the tokens from which
    on ``depth`` tokens are repeated on the host.
    """
    parsed = blocks(html)
    kept = {place: text for place, (mark, text) in enumerate(parsed) if mark != ASIDE}
    lost = 0
    for nth, run in enumerate(runs_of(parsed)):
        words = [parsed[place][1].split(" ") for place in run]
        covered = np.zeros(sum(map(len, words)) + 1, dtype=np.int64)
        for i in repeats.get(nth, ()):
            covered[i] += 1
            covered[min(i + depth, len(covered) - 1)] -= 1
        gone, at = np.cumsum(covered) > 0, 0
        for place, own in zip(run, words, strict=True):
            if place in kept:
                kept[place] = " ".join(w for w, g in zip(own, gone[at : at + len(own)], strict=True) if not g)
                lost += int(gone[at : at + len(own)].sum())
            at += len(own)
    return "\n".join(text for _, text in sorted(kept.items()) if text), lost


RUNS = pa.schema([("host", pa.int64()), ("page", pa.int64()), ("nth", pa.int32()), ("run", pa.string()), ("open", pa.bool_())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for host, page, html in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
            parsed = blocks(html)
            for nth, run in enumerate(runs_of(parsed)):
                text, open_ = " ".join(parsed[i][1] for i in run), any(parsed[i][0] == OPEN for i in run)
                rows.append({"host": host, "page": page, "nth": nth, "run": text, "open": open_})
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, RUNS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, RUNS)


SUFFIXES = pa.schema([("host", pa.int64()), ("prefix", pa.binary()), ("run", pa.int64()), ("place", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
SUFFIX = "host long, prefix binary, run long, place int, low long, high long"


def _suffixes(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each run's suffixes of at least ``depth`` tokens, as 64-bit codes of their first ``depth`` tokens."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[str, bytes] = {}
        out: dict[str, list] = {c: [] for c in SUFFIXES.names}
        for b in batches:
            for host, run, name, low, high in zip(*(b.column(c).to_pylist() for c in ("host", "run", "id", "low", "high")), strict=True):
                words = run.split(" ")
                if len(code) > 200_000:
                    code.clear()
                raw = b"".join(code.get(w) or code.setdefault(w, xxhash.xxh3_64_digest(w.encode("utf-8", "surrogatepass"))) for w in words)
                # a very long run goes out in steps, so that its prefixes are never all held
                for at in range(0, len(words) - depth + 1, 10_000):
                    places = range(at, min(at + 10_000, len(words) - depth + 1))
                    out["prefix"] += [raw[8 * i : 8 * (i + depth)] for i in places]
                    out["place"] += places
                    for c, v in (("host", host), ("run", name), ("low", low), ("high", high)):
                        out[c] += [v] * len(places)
                    if len(out["place"]) >= 10_000:
                        yield pa.RecordBatch.from_pydict(out, SUFFIXES)
                        out = {c: [] for c in SUFFIXES.names}
        if out["place"]:
            yield pa.RecordBatch.from_pydict(out, SUFFIXES)

    return suffixes


def _repeats(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a partition of the suffix array, the suffixes with an LCP of ``depth`` on distinct pages.

    Suffixes of equal prefix follow one another. A partition's first and last
    such group may go on in its neighbours: their rows are told as ``edge``.
    """
    schema = pa.schema([*SUFFIXES, ("edge", pa.bool_())])

    def told(rows: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, edge))], schema=schema)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # the group that is open
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            host = b.column("host").to_numpy()
            prefix = np.frombuffer(b"".join(b.column("prefix").to_pylist()), dtype=np.uint64).reshape(-1, depth)
            equal = np.ones((b.num_rows, depth + 1), dtype=bool)
            equal[1:, :depth] = prefix[1:] == prefix[:-1]
            equal[:, depth] = False
            if waiting:
                before = np.frombuffer(waiting[-1].column("prefix")[-1].as_py(), dtype=np.uint64)
                equal[0, :depth] = (prefix[0] == before) & (host[0] == waiting[-1].column("host")[-1].as_py())
            else:
                equal[0] = False
            lcp = equal.argmin(axis=1)  # with the suffix before it
            lcp[1:][host[1:] != host[:-1]] = 0
            starts = np.flatnonzero(lcp < depth)
            lead = b.slice(0, int(starts[0]) if len(starts) else b.num_rows)
            if lead.num_rows:
                waiting.append(lead)
            if not len(starts):
                continue
            if waiting:
                low = min(int(np.min(r.column("low").to_numpy())) for r in waiting)
                if first or low != max(int(np.max(r.column("high").to_numpy())) for r in waiting):
                    yield from (told(r, first) for r in waiting)
                first = False
            elif len(starts) > 1:
                yield told(b.slice(int(starts[0]), int(starts[1] - starts[0])), True)
                starts, first = starts[1:], False
            if len(starts) > 1:
                begin, end = int(starts[0]), int(starts[-1])
                low = np.minimum.reduceat(b.column("low").to_numpy()[:end], starts[:-1])
                high = np.maximum.reduceat(b.column("high").to_numpy()[:end], starts[:-1])
                chosen = begin + np.flatnonzero(np.repeat(low != high, np.diff(starts)))
                if len(chosen):
                    yield told(b.take(pa.array(chosen)), False)
            waiting = [b.slice(int(starts[-1]))]
        yield from (told(r, True) for r in waiting)

    return repeats


def repeated_places(runs: DataFrame, min_tokens: int) -> DataFrame:
    """(host, run, places): where repeated substrings begin in each run, from one suffix array over all hosts.

    ``runs`` has (host, page, run); ``run`` in the result is the run's hash.
    """
    long = runs.where(F.size(F.split("run", " ")) >= min_tokens)
    # equal runs of a host are one row; its least and greatest page tell whether it lies on several
    distinct = long.groupBy("host", "run").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    suffixes = distinct.withColumn("id", F.xxhash64("run")).mapInArrow(_suffixes(min_tokens), SUFFIX)
    order = ["host", "prefix", "run", "place"]
    array = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    marks = shared_table(array.mapInArrow(_repeats(min_tokens), SUFFIX + ", edge boolean"), "repeats")
    # the groups at the ends of the partitions: at most two a partition
    edges = marks.where("edge").groupBy("host", "prefix").agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    across = marks.where("edge").join(F.broadcast(edges.where("_low <> _high")), ["host", "prefix"])
    found = marks.where("not edge").select("host", "run", "place").unionByName(across.select("host", "run", "place"))
    return found.groupBy("host", "run").agg(F.collect_list("place").alias("places"))


def extract(pages: DataFrame, min_tokens: int = 8, url: str = "url", html: str = "html") -> DataFrame:
    """Every page with its main ``text`` ('' if none) and ``n_removed``, tokens removed as repeated.

    Blocks of the article, as tags, classes, ids and roles tell, are kept
    whole, also where other pages repeat them. Menus, headers, footers,
    sidebars, notices, adverts, forms, comments, scripts and styles go. All
    other blocks lose the tokens that a substring of at least ``min_tokens``
    tokens covers which occurs, outside articles, on another page of the host;
    what is left of them stays. Character references are decoded, white space
    in a block becomes one space, blocks are joined by a newline.

    Null HTML is empty, and so is its text. Pages without a host in their URL
    (null, malformed) share one. Pages of equal HTML count as one page, so a
    copy isn't boilerplate. Rows that repeat stay. Other columns are kept;
    columns named ``text`` or ``n_removed`` are replaced. An empty table gives
    an empty result.
    """
    column = lambda c: F.col(f"`{c.replace('`', '``')}`")
    host = F.lower(F.regexp_extract(F.coalesce(column(url), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    names = [F.xxhash64(host).alias("host"), F.xxhash64(F.coalesce(column(html), F.lit(""))).alias("page")]
    read = pages.select(*names, column(html).alias("html"))
    runs = shared_table(read.mapInArrow(_runs, "host long, page long, nth int, run string, open boolean"), "page-runs")
    places = repeated_places(runs, min_tokens)
    # only unmarked blocks depend on what their host repeats
    open_ = runs.where("open").select("host", "page", "nth", F.xxhash64("run").alias("run")).distinct()
    repeats = open_.join(places, ["host", "run"]).groupBy("host", "page").agg(F.collect_list(F.struct("nth", "places")).alias("repeats"))
    # written, so that its size is known when the join is planned: without unmarked blocks no page moves
    repeats = shared_table(repeats, "page-repeats")
    kept = [c for c in pages.columns if c not in ("text", "n_removed")]
    if html not in kept:
        kept.append(html)
    # columns by place, so that none of the caller's names can clash with ours
    keyed = pages.select(*[column(c).alias(f"c{i}") for i, c in enumerate(kept)], *names)
    wide = keyed.join(repeats, ["host", "page"], "left").drop("host", "page")
    own = [c for c in kept if c in pages.columns and c not in ("text", "n_removed")]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = zip(b.column(kept.index(html)).to_pylist(), b.column(len(kept)).to_pylist(), strict=True)
            out = [page_text(h, {x["nth"]: x["places"] for x in r or ()}, min_tokens) for h, r in found]
            added = [pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *added], names=[*own, "text", "n_removed"])

    schema = StructType([StructField(c, pages.schema[c].dataType) for c in own]).add("text", "string").add("n_removed", "long")
    return wide.mapInArrow(texts, schema)
