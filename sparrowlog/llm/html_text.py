"""Main text of web pages by the runs that repeat over a host.

Pages are read into blocks, and a page's blocks are laid end to end.  Suffixes
of a host's pages that start with the same RUN tokens are one run, known by a
64-bit hash of the host and the tokens.  Runs on several pages of different
content are repeated.  Repeated runs beside the articles are boilerplate and are
removed with whatever they cover; unique runs stay, whether a page has a marked
article or not.  What stands in a page's marked article is boilerplate only if
the same run mostly stands outside of articles: articles that many pages share
are kept.

Runs are counted over the whole host, whatever its size.  Those that stand
outside of an article somewhere are counted first; only they can be boilerplate,
so a bitmap of them tells which runs inside are counted too.  Pages are parsed
again for each of these steps rather than shuffled.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, release, tidy, written
from ._text import Powers, byte_codes, mix, space_table, span_hashes, utf8, word_bounds
from .url_filters import host_of

#: Tokens of a run, pages it must be on.
RUN, PAGES = 8, 3
#: Most bits, as a power of two, of a map of runs.
MAP_BITS = 28

# Fixed values of HTML.
#: Elements whose content is text to a browser, up to their end tag or that of the page.
_RAW = "script|style|template|textarea|iframe|title"
#: Elements that are not for reading, with all they hold.
_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "noscript", "svg", "object", "canvas", "select", "button", "audio", "video", "map"}
_MAIN = {"article", "main"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What may stand in a head; another element ends a head that has no end tag.
_HEAD = {"base", "link", "meta", "title", "style", "script", "noscript", "template"}
#: Words of a class, id or role that tell what an element is for: wherever it stands, or outside of a marked article only.
_AWAY = "ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|cookies?|consent|gdpr|newsletter|subscribe|comments?|disqus|related|recommended|pagination|share|sharing|complementary"
_OUTER = "banner|promo(?:tion)?|header|masthead|footer|foot|aside|widget|notice|popup|modal|overlay|subscription|signup|login|social|recommendations|replies|respond|pager|toolbar|skip|contentinfo|alert|search|form|disclaimer|copyright|legal|tags"
_AWAY_NAME, _OUTER_NAME = (re.compile(rf"(?:^|[_-])(?:{words})(?:$|[_-])", re.I) for words in (_AWAY, _OUTER))
_ITEM = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(" + _RAW + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I | re.S)
_MARK = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")


def blocks_of(markup: str) -> list[tuple[str, bool]]:
    """(text, in the marked article) of each block of a page, in page order.

    Comments, scripts, styles and elements that are not for reading go, with
    all they hold.  An element that is never closed ends with its parent; one
    that is not for reading and never closed ends where an article begins.  In
    an article, names such as "legal" or "notice" make no boilerplate of an
    element; they only leave it to the repeated runs, as if it stood beside.
    """
    out: list[tuple[str, bool]] = []
    # name, whether all within goes, whether it is in the article, whether it is doubtful there
    stack: list[tuple[str, bool, bool, bool]] = []
    text: list[str] = []
    away = main = doubt = False
    ends: dict[str, int] = {}

    def closed(name: str, at: int) -> bool:
        """Whether an end tag of ``name`` comes after ``at``; looked up once a name."""
        if name not in ends:
            ends[name] = max((m.start() for m in re.finditer(rf"</{name}[\s>]", markup, re.I)), default=-1)
        return ends[name] > at

    def flush():
        if text:
            t = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if t:
                out.append((t, main and not doubt))

    def back(i: int):
        nonlocal away, main, doubt
        del stack[i:]
        _, away, main, doubt = stack[-1] if stack else ("", False, False, False)

    at = 0
    for m in _ITEM.finditer(markup):
        if m.start() > at and not away:
            text.append(markup[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if stack and stack[-1][0] == "head" and not m[2] and name not in _HEAD:
            back(len(stack) - 1)
        if name in _BLOCK or name == "br":
            if name == "br":
                if not away:
                    text.append(" ")
                continue
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    back(i)
                    break
                if stack[i][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                    break  # a stray end does not close the article
            continue
        if name in _VOID or m[4].endswith("/"):
            continue
        if name in _MAIN and away:
            open_ = next((i for i, e in enumerate(stack) if e[1]), 0)
            if stack[open_][0] in _ASIDE and not closed(stack[open_][0], m.start()):
                back(open_)
        if name == "p" or name == "li":  # an open one ends here
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    back(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        gone, here = away or name in _ASIDE or name == "head", doubt
        inside = main or name in _MAIN
        if not gone and m[4]:
            if name not in ("html", "body") and name not in _MAIN:
                names = [x for a, b, c in _MARK.findall(m[4]) for x in (a or b or c).split()]
                gone = any(_AWAY_NAME.search(x) for x in names)
                if not gone and any(_OUTER_NAME.search(x) for x in names):
                    gone, here = not inside, inside
            gone = gone or bool(_HIDDEN.search(m[4]))
            inside = inside or 'role="main"' in m[4]
        stack.append((name, gone, inside, here and name not in _MAIN))
        _, away, main, doubt = stack[-1]
    if at < len(markup) and not away:
        rest = markup[at:]
        cut = rest.rfind("<")
        text.append(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest)  # a tag that the end cut off
    flush()
    return out


def page_runs(blocks: list[tuple[str, bool]], host: int, codes: np.ndarray, space: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The run that starts at each token of a page, but the last RUN - 1, and whether it starts outside of an article."""
    data, off = utf8(pa.array([t for t, _ in blocks], pa.string()))
    s, e, block = word_bounds(data[off[0] : off[-1]], off - off[0], space)
    n = len(s) - RUN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    words = span_hashes(data[off[0] : off[-1]], s, e, codes, powers)
    run = np.full(n, host, np.int64).view(np.uint64)
    for i in range(RUN):
        run = mix(run + words[i : n + i])
    return run.view(np.int64), ~np.array([m for _, m in blocks], bool)[block[:n]]


def content_of(blocks: list[tuple[str, bool]]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(t for t, _ in blocks).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def without(blocks: list[tuple[str, bool]], gone: np.ndarray) -> str:
    """A page's text without the tokens that runs starting at ``gone`` cover."""
    kept, at = [], 0
    edges = np.zeros(sum(t.count(" ") + 1 for t, _ in blocks) + 1, np.int64)
    np.add.at(edges, gone, 1)
    np.add.at(edges, gone + RUN, -1)
    cut = np.cumsum(edges) > 0
    for t, _ in blocks:
        words = t.split(" ")
        t = " ".join(w for w, c in zip(words, cut[at : at + len(words)]) if not c)
        at += len(words)
        if t:
            kept.append(t)
    return "\n\n".join(kept)


def _bitmap(runs: DataFrame, n: int):
    """A broadcast bitmap of ``runs`` (run), of which there are ``n``, and its size; it may hold more where it fills up."""
    bits = 1 << min(MAP_BITS, max(20, (16 * n).bit_length()))
    marks = runs.select((F.pmod("run", F.lit(bits)) + 1).alias("s"))  # bitmap functions count from 1
    marks = marks.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    found = np.zeros(bits // 8 + 4096, np.uint8)
    for r in marks.toLocalIterator():  # at most bits / 32768 rows of 4 KB
        found[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return runs.sparkSession.sparkContext.broadcast(found), bits


def _on(found: np.ndarray, bits: int, runs: np.ndarray) -> np.ndarray:
    s = runs % bits
    return (found[s // 8] >> (s % 8).astype(np.uint8)) & 1 == 1


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for each row; text is empty where a page has none.

    A null body is an empty page; null URLs are a host of their own.  Repeated
    rows are rows of their own; pages of equal content count once where pages
    of a run are counted.
    """
    spark = bound_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.xxhash64(host_of(url), host_of(url).isNull()).alias("host"), F.col(body).alias("html"))
    rows = rows.withColumn("row", F.xxhash64("host", "key", "url")).select("row", "host", "html", "key", "url")

    def counts(inside: bool, found=None, bits: int = 0):
        """(run, content, n) of the runs that start outside of articles, or of those on the map that start inside."""

        def run(batches):
            powers, codes, space = Powers(), byte_codes(), space_table()
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    made, content = [np.zeros(0, np.int64)], []
                    for host, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                        blocks = blocks_of(x or "")
                        if not any(m == inside for _, m in blocks):
                            continue
                        runs, beside = page_runs(blocks, host, codes, space, powers)
                        runs = runs[beside != inside]
                        if inside:
                            runs = runs[_on(found.value, bits, runs)]
                        made.append(runs)
                        content.append(np.full(len(runs), content_of(blocks), np.int64))
                    pairs = np.stack([np.concatenate(made), np.concatenate([np.zeros(0, np.int64), *content])])
                    pairs, n = np.unique(pairs, axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n.astype(np.int64))], ["run", "content", "n"])

        return rows.select("row", "host", "html").mapInArrow(tidy(run), "run long, content long, n long").groupBy("run", "content").agg(F.sum("n").alias("n"))

    outside = written(counts(False).withColumn("beside", F.lit(True)), "outside")
    release(spark)
    marks, total = None, outside.count()
    if total:
        inside = counts(True, *_bitmap(outside, total)).withColumn("beside", F.lit(False))
        # A row for each content and place of a run; then a run's contents and places.
        each = outside.union(inside).groupBy("run", "content").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("beside"), F.col("n")).otherwise(0)).alias("out"))
        bad = each.groupBy("run").agg(F.count("*").alias("on"), F.sum("n").alias("n"), F.sum("out").alias("out"))
        bad = written(bad.where(f"on >= {PAGES} and 2 * out >= n").select("run"), "boilerplate")
        release(spark)
        total = bad.count()
        if total:
            found, bits = _bitmap(bad, total)

            def meet(batches):
                powers, codes, space = Powers(), byte_codes(), space_table()
                for b in batches:
                    for lo in range(0, b.num_rows, 256):
                        part = b.slice(lo, 256)
                        made, own = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                        for row, host, x in zip(*(part.column(i).to_pylist() for i in range(3))):
                            runs = np.unique(page_runs(blocks_of(x or ""), host, codes, space, powers)[0])
                            made.append(runs[_on(found.value, bits, runs)])
                            own.append(np.full(len(made[-1]), row, np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made)), pa.array(np.concatenate(own))], ["run", "row"])

            met = rows.select("row", "host", "html").mapInArrow(tidy(meet), "run long, row long")
            marks = written(met.join(bad, "run").groupBy("row").agg(F.collect_set("run").alias("runs")), "marks")
            release(spark)

    def cut(batches):
        powers, codes, space = Powers(), byte_codes(), space_table()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = []
                for host, x, bad in zip(*(part.column(i).to_pylist() for i in (1, 2, 5))):
                    blocks = blocks_of(x or "")
                    if bad:
                        runs = page_runs(blocks, host, codes, space, powers)[0]
                        texts.append(without(blocks, np.flatnonzero(np.isin(runs, np.array(bad, np.int64)))))
                    else:
                        texts.append("\n\n".join(t for t, _ in blocks))
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(4), pa.array(texts, pa.string())], ["key", "url", "text"])

    marked = rows.withColumn("runs", F.lit(None).cast("array<long>")) if marks is None else rows.join(marks, "row", "left").select("row", "host", "html", "key", "url", "runs")
    out = marked.mapInArrow(tidy(cut), "key long, url string, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
