"""Main text of web pages by nearest-URL page differencing, with markup beside it.

Every page is paired with the page of its host whose URL path is nearest in sorted
order; the text lines of the two are aligned by longest common subsequence, and the
shared ones, which the site's template put there, are deleted. Pages of one site
may quote each other or hold one article twice, so shared lines that stand inside a
marked article stay. Template lines that the neighbour happens not to share go by
markup that says what it is: navigation, footers, forms, adverts and the like; and
where a page marks its article, lines outside it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices
from .scratch import Scratch

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"<]*\"|'[^'<]*'|[^\"'>])*>|[^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# fixed values: HTML elements by what they hold, and the words of class, id and role that mark page furniture
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style textarea title xmp iframe noembed noframes nav footer aside form button select option template noscript dialog menu svg canvas object audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section select summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo complementary cookie cookies disclaimer disqus dialog feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
CLOSES = {"p": frozenset("address article aside blockquote dl div fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset(["tr"]), "option": frozenset(["option"])}


def _furniture(name: str, rest: str) -> bool:
    if name in ("html", "body", "main", "article"):
        marks = [m for m in _ATTRIBUTE.finditer(rest) if name == "article" and m[1].lower() in ("class", "id")]
        return any(re.match(r"comment(?:[-_]|$)", w, re.I) for m in marks for w in (m[2] or m[3] or m[4] or "").split())
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key in ("class", "id", "role") and any(w.lower() in FURNITURE for w in _PART.findall(value)):
            return True
    return False


#: What markup says of a line: furniture or outside the article; in the article; nothing.
LEFT_OUT, IN_ARTICLE, OPEN = range(3)


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """All text lines of a page in order, with what markup says of each."""
    page = page or ""
    one_article = len(re.findall(r"<article\b", page, re.I)) == 1
    # (text, furniture, in an article, in main)
    blocks: list[tuple[str, bool, bool, bool]] = []
    buffer: list[str] = []
    hidden: list[str] = []
    # open elements: (name, starts a dropped part, is an article, is a main)
    stack: list[tuple[str, bool, bool, bool]] = []
    dropped = articles = mains = 0
    in_header = in_heading = 0

    def settle():
        for part, furniture in ((hidden, True), (buffer, False)):
            text = " ".join(html.unescape("".join(part)).split()) if part else ""
            if text:
                blocks.append((text, furniture, articles > 0, mains > 0))
            part.clear()

    def pop():
        nonlocal dropped, articles, mains, in_header, in_heading
        name, drop, article, main = stack.pop()
        dropped -= drop
        articles -= article
        mains -= main
        in_header -= name == "header"
        in_heading -= name in HEADINGS

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            (buffer if not dropped and (not in_header or articles and in_heading) else hidden).append(page[at : m.start()])
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name in BLOCKS:
                settle()
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in BLOCKS:
            settle()
        if name == "br" or name in ("td", "th"):
            buffer.append(" ")
        while stack and name in CLOSES.get(stack[-1][0], ()):
            pop()
        if name == "body" or stack and stack[-1][0] == "head" and name in BLOCKS:
            while any(x[0] == "head" for x in stack):
                pop()
        if name in VOID or m["rest"].endswith("/>") and name not in BLOCKS:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            continue
        drop = name in DROPPED or _furniture(name, m["rest"])
        if name == "article" and one_article and not drop:
            while dropped:  # an element before the only article was never closed
                pop()
        stack.append((name, drop, name == "article" and not drop and not dropped, name == "main" and not drop and not dropped))
        dropped += drop
        articles += stack[-1][2]
        mains += stack[-1][3]
        in_header += name == "header"
        in_heading += name in HEADINGS
    if at < size:
        (buffer if not dropped and not in_header else hidden).append(page[at:])
    settle()
    for k in (2, 3):
        if any(b[k] and not b[1] for b in blocks):
            return [(b[0], IN_ARTICLE if b[k] and not b[1] else LEFT_OUT) for b in blocks]
    return [(b[0], LEFT_OUT if b[1] else OPEN) for b in blocks]


def address(url: str | None) -> tuple[str | None, str]:
    """Host and path without the parts that name the same page."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return None, ""
    path = re.sub(r"(?:/index)?\.(?:x?html?|php|aspx?)$", "", parts.path.rstrip("/"), flags=re.I)
    return (parts.hostname or None), path


def shared(own: list[int], other: list[int]) -> set[int]:
    """Positions in ``own`` that lie on a longest common subsequence with ``other``."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(other):
        places.setdefault(x, []).append(j)
    ends: list[int] = []  # the least last position in other of a common subsequence of each length
    chain: list[tuple] = []
    for i, x in enumerate(own):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    found, link = set(), chain[-1] if chain else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _print(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_PARSED = "page_id long, url string, host string, path string, lines array<string>, said binary, prints binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that markup does not leave out; of all lines what markup says, and a fingerprint."""
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary())
    names = [x.split()[0] for x in _PARSED.split(", ")]
    for part in slices(batches, 2, 256, 4 << 20):
        rows = []
        for page_id, url, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
            lines = lines_of(page)
            host, path = address(url)
            rows.append((page_id, url, host, path, [x for x, k in lines if k], bytes(k for _, k in lines), np.array([_print(x) for x, _ in lines], np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def deleted(prints: list[int], said: bytes, other: list[int]) -> tuple[list[int], int]:
    """Of the lines that markup does not leave out, the places of those that differencing deletes;
    and how many lines it deletes in all. Lines of a marked article stay."""
    gone = {i for i in shared(prints, other) if said[i] != IN_ARTICLE}
    open_ = [i for i, k in enumerate(said) if k]
    return [j for j, i in enumerate(open_) if i in gone], len(gone)


_GONE = "row long, gone array<int>, n_shared long, n_left_out long"


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64())
    for batch in batches:
        rows = []
        for row, prints, said, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, near = (np.frombuffer(x or b"", np.int64).tolist() for x in (prints, other))
            gone, n = deleted(own, said, near)
            # what only markup leaves out
            rows.append((row, gone, n, said.count(LEFT_OUT) - (n - len(gone))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _GONE.split(", ")])


def nearest(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, path, partner``: a row of the nearest other path of the host.

    Paths are sorted once, over all hosts, so a large host spreads over many partitions; ranks
    across partitions come from one count per partition.
    """
    paths = parsed.where("host is not null").groupBy("host", "path").agg(F.min("row").alias("row"))
    ordered = scratch.keep(paths.repartitionByRange("host", "path").sortWithinPartitions("host", "path").withColumn("at", F.monotonically_increasing_id()), "paths")
    part = F.shiftright("at", 33)
    # one row per partition of the sort
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = ordered.withColumn("part", part).join(F.broadcast(before), "part").select("host", "path", "row", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    ranked = scratch.keep(ranked, "ranked")

    def beside(step: int, name: str):
        return ranked.select((F.col("rank") + step).alias("rank"), F.col("host").alias(f"{name}_host"), F.struct(F.col("path"), F.col("row")).alias(name))

    near = ranked.join(beside(1, "back"), "rank", "left").join(beside(-1, "ahead"), "rank", "left")

    def common(name: str):
        other = F.col(f"{name}.path")
        # the common prefix: levenshtein-free, by the first position where the two differ
        length = F.expr(f"coalesce(array_position(transform(sequence(1, greatest(1, least(length(path), length({name}.path)))), i -> substring(path, i, 1) <> substring({name}.path, i, 1)), true) - 1, 0)")
        equal = F.when(F.col("path").startswith(other) | other.startswith(F.col("path")), F.least(F.length("path"), F.length(other)))
        return F.when(F.col(f"{name}_host") == F.col("host"), F.coalesce(equal.cast("long"), length.cast("long"))).otherwise(F.lit(-1).cast("long"))

    return near.select("host", "path", F.when((common("back") < 0) & (common("ahead") < 0), None).when(common("back") >= common("ahead"), F.col("back.row")).otherwise(F.col("ahead.row")).alias("partner"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared, n_left_out``, one row per row of ``pages``.

    ``n_shared`` counts the lines that differencing deletes, ``n_left_out`` those that only
    markup does. Null and empty pages give empty text. Pages without a readable host, or alone on
    their host, have no partner; markup alone cleans them. Pages that share a URL path are never
    partners: they may be one article. Repeated rows give repeated results; null page ids and
    further columns are allowed.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    parsed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_parse, _PARSED)
    parsed = scratch.keep(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")
    prints = parsed.select("row", "prints")
    paired = parsed.select("row", "host", "path", "prints", "said").join(nearest(parsed, scratch), ["host", "path"], "left")
    paired = paired.join(prints.select(F.col("row").alias("partner"), F.col("prints").alias("other")), "partner", "left")
    gone = scratch.keep(paired.select("row", "prints", "said", "other").mapInArrow(_difference, _GONE), "gone")
    kept = F.filter("lines", lambda x, i: ~F.array_contains("gone", i))
    out = parsed.select("row", "page_id", "url", "lines").join(gone, "row").withColumn("text", F.array_join(kept, "\n"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_left_out")


def op10_page_differencing(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
