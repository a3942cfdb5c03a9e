"""Main text of web pages: markup first, then a suffix array over each host's pages.

A page is cut into blocks of text.  Blocks inside chrome (navigation, headers,
footers, asides, forms, adverts, notices, comments, scripts) are told by their
markup.  The text of a page with an article element is the article's blocks that
are not chrome; copies of an article on other pages are still content.  All
other blocks of the host's pages become token streams, the streams are joined
and their suffixes sorted; a substring of at least ``min_tokens`` tokens that
occurs on two distinct pages is boilerplate.  Of a page without an article the
runs of blocks that stay unique are its text.

Pages of equal blocks on one host are one page, wherever they lie.  No task holds
a host of more than ``group_bytes`` of html: its windows of ``min_tokens`` tokens
are grouped by their hash and those on two distinct pages marked, which covers the
same tokens as the suffix array does.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewind.llm.common import attach, bounded, materialize, tasks
from tidewind.llm.paragraphs import rolling, word_hashes, word_spans

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'">]++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""",
    re.DOTALL,
)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object")}
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset label head title".split())
MAIN_TAGS = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies respond disqus share sharing "
    "social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager toolbar skip hidden".split()
)
# Words that only say what kind of box a name is of, and what a header may belong to without being chrome.
BOXES = frozenset(
    "area author bar block body box btn button buttons card cards center col column container content count date form group icon icons image img inner item items "
    "left link links list main meta outer panel posts articles stories right row section slot small tabs text thread title top bottom unit wrap wrapper".split()
)
CONTENT = frozenset("article chapter content entry paper post recipe report section story text".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def _chrome_name(word: str) -> bool:
    """Whether a class or id names chrome: by its last word that isn't a box, so ``share-buttons`` does and ``social-history`` doesn't."""
    parts = [p for p in re.split(r"[^a-z0-9]+", word) if p and not p[0].isdigit()]
    if not parts or parts[0] in ("has", "with", "no", "without"):
        return False
    while len(parts) > 1 and parts[-1] in BOXES:
        parts.pop()
    return parts[-1] in CHROME_NAMES and not (parts[-1] == "header" and not CONTENT.isdisjoint(parts))


def _chrome(tag: str, attrs: str) -> bool:
    if tag in CHROME_TAGS:
        return True
    if not attrs or attrs.isspace():
        return False
    for name, *values in ATTR.findall(attrs):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value.strip() in CHROME_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if any(map(_chrome_name, value.split())):
                return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, is chrome, is inside an article) of each block with text, in page order."""
    page = page or ""
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    main, skip, depth, at = 0, "", 0, 0

    def close() -> None:
        if text:
            words = "".join(text).split()
            text.clear()
            if words:
                out.append((" ".join(words), bool(skip), main > 0))

    while True:
        found = MARKUP.search(page, at)
        chars = page[at : found.start() if found else len(page)]
        if chars:
            text.append(entities.unescape(chars) if "&" in chars else chars)
        if not found:
            break
        at = found.end()
        tag = found["tag"]
        if not tag:
            continue
        tag, ends, attrs = tag.lower(), bool(found["end"]), found["attrs"]
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW_END:
            close()
            if not ends and not attrs.rstrip().endswith("/"):
                stop = RAW_END[tag].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag in INLINE and not skip and not (attrs and _chrome(tag, attrs)):
            continue
        if tag not in INLINE:
            close()
        if skip and tag in MAIN_TAGS and not ends and not main:
            skip = ""  # an unclosed menu doesn't swallow the article
        if skip:
            if tag == skip:
                depth += -1 if ends else 1
                if not depth:
                    close()
                    skip = ""
        elif not ends and tag not in VOID and not attrs.rstrip().endswith("/") and _chrome(tag, attrs):
            close()
            skip, depth = tag, 1
            continue
        if tag in MAIN_TAGS and not skip:
            main = max(0, main + (-1 if ends else 1))
    close()
    return out


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, length: int) -> np.ndarray:
    """Which tokens lie in a substring of ``length`` tokens or more that occurs on two distinct pages.

    The suffix array is sorted by its first ``length`` tokens (a power of two)
    by prefix doubling; neighbours of equal rank from distinct pages repeat, and
    overlapping windows make up the longer substrings.
    """
    n, rank, size = len(tokens), np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while size < length:
        after = np.full(n, -1, dtype=np.int64)
        after[: n - size] = rank[size:] if size < n else []
        after[: n - size][page[: n - size] != page[size:]] = -1
        pair = (rank << 32) + (after + 1)
        rank, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), size * 2
    whole = np.zeros(n, dtype=bool)
    if n >= length:
        whole[: n - length + 1] = page[: n - length + 1] == page[length - 1 :]
    order = np.argsort(rank, kind="stable")
    order = order[whole[order]]
    covered = np.zeros(n + 1, dtype=np.int64)
    if len(order):
        new = np.ones(len(order), dtype=bool)
        new[1:] = rank[order][1:] != rank[order][:-1]
        at = np.flatnonzero(new)
        low, high = np.minimum.reduceat(page[order], at), np.maximum.reduceat(page[order], at)
        starts = order[(low != high)[np.cumsum(new) - 1]]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + length, -1)
    return np.cumsum(covered)[:n] > 0


def extract(pages: DataFrame, min_tokens: int = 8, group_bytes: int = 2 << 20) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, text, n_boilerplate)``, one row per row.

    A null or empty page has an empty text.  A page without a host shares the
    host "".  Equal rows stay.  A block of a page without an article goes if over half
    of its tokens are boilerplate; a block that is chrome by its markup always
    goes.  n_boilerplate counts the tokens that the suffix array found repeated on
    such a page; it is null for a page with an article, whose text doesn't depend
    on other pages.  Broken markup ends at the end of the page.  Other columns are
    not read.  Pages with an article never leave their partition: only the blocks
    outside of articles are shuffled, of hosts that have a page without an article.
    ``group_bytes`` says how a host is read and changes no result.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                rows = []
                for page_id, url, page in pdf.iloc[at : at + 256].itertuples(index=False):
                    found = blocks(page)
                    loose, host = [b for b in found if not b[2]], host_of(url)
                    key = xxhash.xxh64_intdigest("\0".join([host, *(b[0] for b in found)]).encode("utf-8", "surrogatepass")) - (1 << 63)
                    core = len(loose) < len(found)
                    text = " ".join(t for t, chrome, main in found if main and not chrome) if core else None
                    rows.append((page_id, url, host, key, len(page or ""), core, text, [b[0] for b in loose], [b[1] for b in loose]))
                yield pd.DataFrame(rows, columns=["page_id", "url", "host", "key", "size", "core", "text", "loose", "chrome"])

    def page_of(page_id: int, url: str, loose: list[str], chrome: list[bool], again: np.ndarray) -> tuple:
        ends = np.cumsum([0, *(len(b.split()) for b in loose)])
        drop = [again[a:b].mean() > 0.5 for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return page_id, url, " ".join(b for b, c, d in zip(loose, chrome, drop, strict=True) if not c and not d), int(again.sum())

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, page, spans = [], [], {}
        for key, loose in zip(pdf["key"], pdf["loose"], strict=True):
            if key not in spans:
                words = " ".join(loose).split()
                page += [len(spans)] * len(words)
                spans[key] = (len(tokens), len(tokens) + len(words))
                tokens += [xxhash.xxh64_intdigest(w) >> 1 for w in words]
        again = repeated_tokens(np.array(tokens, dtype=np.int64), np.array(page), min_tokens) if tokens else np.zeros(0, dtype=bool)
        rows = [page_of(r.page_id, r.url, r.loose, r.chrome, again[slice(*spans[r.key])]) for r in pdf[~pdf["core"]].itertuples()]
        return pd.DataFrame(rows, columns=["page_id", "url", "text", "n_boilerplate"])

    def windows(host: str, loose: list[str]) -> np.ndarray:
        raw = " ".join(loose).encode("utf-8", "surrogatepass")
        return (rolling(word_hashes(raw, word_spans(raw)), min_tokens) ^ np.uint64(xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass")))).view(np.int64)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [np.unique(windows(host, loose)) for host, loose in zip(pdf["host"], pdf["loose"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "core": pdf["core"], "windows": made})

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                starts = np.flatnonzero(np.isin(windows(r.host, r.loose), r.marks)) if r.marks is not None else []
                covered = np.zeros(sum(len(b.split()) for b in r.loose) + 1, dtype=np.int64)
                np.add.at(covered, np.asarray(starts, dtype=np.int64), 1)
                np.add.at(covered, np.asarray(starts, dtype=np.int64) + min_tokens, -1)
                rows.append(page_of(r.page_id, r.url, r.loose, r.chrome, np.cumsum(covered)[:-1] > 0))
            yield pd.DataFrame(rows, columns=["page_id", "url", "text", "n_boilerplate"])

    source = bounded(pages).select(F.col("page_id").cast("long"), "url", "html")
    out = "page_id long, url string, text string, n_boilerplate long"
    whole = materialize(source.mapInPandas(parse, "page_id long, url string, host string, key long, size long, core boolean, text string, loose array<string>, chrome array<boolean>"))
    found, parsed = whole.where("core").select("page_id", "url", "text", F.lit(None).cast("long").alias("n_boilerplate")), whole.drop("text")
    hosts = parsed.groupBy("host").agg(F.count("*").alias("n"), F.sum("size").alias("host_size"), F.min("core").alias("all_core"))
    hosts = materialize(hosts.where("not all_core").select("host", "n", "host_size"))
    dealt = attach(parsed, hosts, "host", "n", parsed.count()).where("n is not null").drop("n")
    small = dealt.where(F.col("host_size") <= group_bytes).repartition(tasks(pages), "host").groupBy("host").applyInPandas(finish, out)
    found = found.unionByName(small)
    if hosts.where(F.col("host_size") > group_bytes).isEmpty():
        return found

    large = materialize(dealt.where(F.col("host_size") > group_bytes).drop("host_size"))
    made = materialize(large.select("key", "core", "host", "loose").mapInPandas(hashed, "key long, core boolean, windows array<long>"))
    each = made.select("key", F.explode("windows").alias("w"))
    shared = each.groupBy("w").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    shared = materialize(shared.select("w", "n"))
    alone = made.where("not core").select("key", F.explode("windows").alias("w"))
    marks = attach(alone, shared, "w", "n", each.count()).where("n is not null").groupBy("key").agg(F.collect_set("w").alias("marks"))
    bare = large.where("not core").drop("core")
    marks = materialize(bare.groupBy("key").count().join(marks, "key"))
    bare = attach(bare, marks, "key", "count", bare.count())
    return found.unionByName(bare.select("page_id", "url", "host", "loose", "chrome", "marks").mapInPandas(marked, out))
