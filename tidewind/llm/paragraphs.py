"""Substring deduplication: similar paragraphs by MinHash, and every exact run of words.

Paragraphs (lines of at least ``min_words`` words) get MinHash signatures over
shingles of five words, cut into bands that are tuned for high recall.  Equal
paragraphs count once.  Paragraphs that share a band collide; a star around the
smallest of each band bucket is enough to find the candidate components, so no
bucket is ever expanded into pairs.  Inside a candidate component the exact
Jaccard similarity of the shingle sets is verified, and the verified links'
components are the classes of repeated paragraphs.  Of a class that occurs in several
documents the first document keeps its paragraph, the others lose theirs.

Runs of ``run_words`` words are found wherever they lie, inside longer lines and
across lines.  Winnowing picks fingerprints of shorter windows of each text such
that two texts with a common run share at least one; only around fingerprints
that two documents share are all windows of ``run_words`` words hashed and
grouped.  The first document that has a window keeps it, the others lose the
words it covers.  Copies of a whole text meet by its hash and don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewind.llm.common import attach, bounded, chunks, discard, join_labels, materialize, parts, stream_groups, tidy
from tidewind.llm.components import connected_components

LAST = (1 << 63) - 1
STEP = np.uint64(0xD6E8FEB86659FD93)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that stand between words.
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Words in a fingerprint of a run.
ANCHOR = 16
#: Two hashes of 64 bits tell a run.
RUN = ["run", "check"]
#: A value for each byte at each of PLACES places in a word, none for blanks.
PLACES = 64
BYTES = np.where(BLANK, np.uint64(0), np.random.default_rng(5).integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64)).ravel()


def tune_bands(threshold: float, recall: float, rows: int = 5, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the fewest bands with which a pair at the threshold collides with at least that probability."""
    for bands in range(1, most + 1):
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("no such banding")


def word_spans(raw: bytes) -> np.ndarray:
    """(start, end) of each word, in bytes."""
    solid = np.diff(~BLANK[np.frombuffer(raw, dtype=np.uint8)], prepend=False, append=False)
    return np.flatnonzero(solid).reshape(-1, 2)


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(30))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[starts[i]:ends[i]]: sums of a value and its place, mixed together.

    No polynomial, so there are no sequences that agree whatever the values are.
    """
    sizes = ends - starts
    place = _ranges(np.zeros_like(sizes), sizes).astype(np.uint64)
    sums = np.zeros(len(place) + 1, dtype=np.uint64)
    np.cumsum(_mixed(values[_ranges(starts, sizes)] + place * STEP), out=sums[1:])
    upto = np.cumsum(sizes)
    return _mixed(sums[upto] - sums[upto - sizes] + sizes.astype(np.uint64))


def word_hashes(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words: sums of a value for each byte and place."""
    if not len(spans):
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(raw, dtype=np.uint8)[spans[0, 0] :]
    first = spans[:, 0] - spans[0, 0]
    place = np.arange(len(data)) - np.repeat(first, np.diff(first, append=len(data)))
    far = np.flatnonzero(place >= PLACES)
    values = BYTES[(place % PLACES) * 256 + data] if len(far) else BYTES[place * 256 + data]
    if len(far):
        values[far] = np.where(values[far] == 0, np.uint64(0), _mixed(values[far] + (place[far] // PLACES).astype(np.uint64) * STEP))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    end = spans[:, 1] - spans[0, 0]
    return _mixed(sums[end] - sums[first] + (end - first).astype(np.uint64))


def band_keys(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (one row per paragraph) of MinHash signatures with bands * rows permutations.

    A paragraph's shingles are ``flat`` from its start to the next one.
    """
    rng = np.random.default_rng(8)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out, product = np.empty((len(starts), bands), dtype=np.uint64), np.empty_like(flat)
    for band in range(bands):
        key = np.full(len(starts), band + 1, dtype=np.uint64)
        for r in range(band * rows, (band + 1) * rows):
            key = (key ^ np.minimum.reduceat(np.multiply(flat, factors[r], out=product), starts)) * MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out.view(np.int64)


def rolling(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` words, by doubling; halves are mixed at each step, so it is no polynomial."""
    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        h = left * STEP + right
        h ^= h >> np.uint64(32)
        return h * MIX

    part, size, done, n = hashes, 1, 0, max(0, len(hashes) - width + 1)
    out = np.full(n, seed, dtype=np.uint64)
    while n:
        if width & size:
            out = joined(out, part[done : done + n])
            done += size
        if size * 2 > width:
            break
        part, size = joined(part[:-size], part[size:]), size * 2
    out ^= out >> np.uint64(32)
    return out * MIX


def _slide(least: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values, size = least(values[:-size], values[size:]), size * 2
    return least(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def winnow(hashes: np.ndarray, width: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Which hashes are the least of some ``width`` neighbours: equal stretches of that many have one in common.

    Of the stretches only those count that are marked in ``whole``.
    """
    if len(hashes) < width:
        return np.zeros(len(hashes), dtype=bool)
    least = _slide(np.minimum, hashes, width)
    if whole is not None:
        least = np.where(whole, least, np.uint64(0))
    return (_slide(np.maximum, np.pad(least, width - 1), width) == hashes) & (hashes > 0)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of starts[i], starts[i] + 1, ... for ``sizes[i]`` numbers, in turn."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _units(docs: DataFrame, min_words: int, width: int, bands: int, rows: int, run_words: int) -> DataFrame:
    """``(rk, d, line, u, bands)`` of each paragraph: row key, doc_id (null last), line number, text hash, band keys;
    and of each text of ``run_words`` words or more, as line -1, the hash of its words and its distinct fingerprints.

    The words of many texts form one stream, so each step is a few passes over arrays.
    """
    size = min(ANCHOR, run_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(pdf):
                texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in part["text"]]
                raw = b"\n".join(texts)
                spans = word_spans(raw)
                hashes = word_hashes(raw, spans)
                # First words of lines and of texts, and the end.
                line_at = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1])
                text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
                words = np.searchsorted(spans[:, 0], line_at), np.searchsorted(spans[:, 0], text_at)
                low, high = words[0], np.append(words[0][1:], len(hashes))
                long = np.flatnonzero(high - low >= min_words)
                of = np.searchsorted(text_at, line_at[long], side="right") - 1
                number = long - np.searchsorted(line_at, text_at[of])
                sizes = high[long] - low[long] - width + 1
                pages = np.flatnonzero(np.diff(words[1]) >= run_words)
                if not len(long) and not len(pages):
                    continue
                keys: list[np.ndarray] = []
                if len(long):
                    keys += [*band_keys(rolling(hashes, width)[_ranges(low[long], sizes)], np.cumsum(sizes) - sizes, bands, rows)]
                first, last = words[1][pages], words[1][pages + 1]
                if len(pages):
                    prints = rolling(hashes, size)
                    inside = np.zeros(len(prints) - run_words + size, dtype=bool)
                    inside[_ranges(first, last - first - run_words + 1)] = True
                    picked = winnow(prints, run_words - size + 1, inside)
                    keys += [np.unique(prints[a:b][picked[a:b]]).view(np.int64) for a, b in zip(first, last, strict=True)]
                at = np.concatenate([of, pages])
                u = range_hashes(hashes, np.concatenate([low[long], first]), np.concatenate([high[long], last])).view(np.int64)
                line = np.concatenate([number, np.full(len(pages), -1)]).astype(np.int32)
                yield pd.DataFrame({"rk": part["rk"].to_numpy()[at], "d": part["d"].to_numpy()[at], "line": line, "u": u, "bands": keys})

    return bounded(docs).select("rk", "d", "text").mapInPandas(tidy(run), "rk long, d long, line int, u long, bands array<long>")


def _jaccard_links(sets: list[np.ndarray], asks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (asking, any) of the pairs of sets with a similarity of at least the threshold, blocks of shingles at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(asks), len(sets)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        low, high = np.searchsorted(column, [first, first + 4096])
        block = np.zeros((len(sets), 4096), dtype=np.float32)
        block[row[low:high], column[low:high] - first] = 1
        both += block[asks] @ block.T
    size = np.array([len(s) for s in sets], dtype=np.float32)
    a, b = np.nonzero(both >= threshold * (size[asks][:, None] + size[None, :] - both) - 1e-4)
    return asks[a], b


def _verified(payload: DataFrame, threshold: float, part_rows: int, files: int) -> tuple[DataFrame, list[DataFrame]]:
    """``payload(root, u, set)`` -> ``(a, b)``, links with the components of all links inside each root, and tables to discard.

    The first paragraph of a root is compared with all others: most copies of a
    template are similar to it, so one comparison settles them.  Only those that
    are not are compared with every paragraph of their root, in cells of at most
    ``part_rows`` askers and ``part_rows`` paragraphs.
    """
    size = lambda a, b: F.size(F.array_intersect(a, b))
    first = payload.groupBy("root").agg(F.min("u").alias("first"), F.count("*").alias("n"))
    heads = payload.join(first, "root").where(F.col("u") == F.col("first")).select("root", "first", "n", F.col("set").alias("head"))
    met = attach(payload, heads, "root", "n", payload.count()).where("u <> first")
    both = size("set", "head")
    alike = both >= F.lit(threshold) * (F.size("set") + F.size("head") - both) - 1e-9
    met = materialize(met.select("root", "first", "u", alike.alias("alike")), files)
    apart = met.where("not alike").groupBy("root").agg(F.count("*").alias("n_asks"))
    n = met.groupBy("root").agg((F.count("*") + 1).alias("n"))
    cells = lambda c: F.ceil(F.col(c) / part_rows).cast("int")
    groups = materialize(apart.join(n, "root").select("root", "n", cells("n_asks").alias("ask_parts"), cells("n").alias("all_parts")), files)
    rows = attach(payload, groups, "root", "n", payload.count()).where("ask_parts is not null")
    asking = met.where("not alike").select("u", F.lit(True).alias("asks"))
    salt = lambda c: F.pmod(F.xxhash64("u"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    whole = rows.select("root", "u", "set", F.lit(False).alias("asks"), every("ask_parts").alias("i"), salt("all_parts").alias("j"))
    asks = rows.join(asking, "u").select("root", "u", "set", "asks", salt("ask_parts").alias("i"), every("all_parts").alias("j"))

    def each(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        sets, asks, u, labels = list(pdf["set"]), pdf["asks"].to_numpy(dtype=bool), pdf["u"].to_numpy(), np.arange(len(pdf))
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            a, b = _jaccard_links(sets[low:high], np.flatnonzero(asks[low:high]), threshold)
            join_labels(labels, low + a, low + b)
        moved = np.flatnonzero(labels != np.arange(len(pdf)))
        out = pd.DataFrame({"a": u[moved], "b": u[labels[moved]]})
        return out[out["a"] != out["b"]]

    found = stream_groups(whole.unionByName(asks), ["root", "i", "j"], ["u"], each, "a long, b long")
    return found.unionByName(met.where("alike").select(F.col("u").alias("a"), F.col("first").alias("b"))), [met, groups]


def _spans(mark: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each stretch of true values."""
    edges = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def cut_runs(text: str, linked: list[int], gone_lines: list[int], shared: list[int], gone: list[int], run_words: int) -> tuple[str, int, int]:
    """The text without its gone lines and the runs that start at the gone words; its links and removals.

    Beside the lines count the windows that have no word in them; what a gone line
    leaves of a run is no run of ``run_words`` words any more, and stays.  A start of
    -1 is the whole text.  A line left without words goes with its line break.
    """
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    spans = word_spans(raw)
    line_at = np.cumsum([0, *(len(line) + 1 for line in lines)])
    ends = np.searchsorted(spans[:, 0], line_at)

    def mark(starts: list[int], without: list[int]) -> np.ndarray:
        apart = np.zeros(ends[-1], dtype=bool)
        for number in without:
            apart[ends[number] : ends[number + 1]] = True
        if -1 in starts:
            return ~apart
        at = np.array(starts, dtype=np.int64)
        before = np.cumsum(np.pad(apart, (1, 0)))
        at = at[before[at + run_words] == before[at]]
        steps = np.zeros(ends[-1] + 1, dtype=np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + run_words, -1)
        return np.cumsum(steps)[:-1] > 0

    lost, drop, rest = mark(gone, gone_lines), set(gone_lines), []
    n_lost, n_words = np.diff(np.cumsum(np.pad(lost, (1, 0)))[ends]).tolist(), np.diff(ends).tolist()
    for number, line in enumerate(lines):
        if number in drop or 0 < n_lost[number] == n_words[number]:
            continue
        if not n_lost[number]:
            rest.append(line)
            continue
        words, mine = spans[ends[number] : ends[number + 1]] - line_at[number], lost[ends[number] : ends[number + 1]]
        for first, end in reversed(_spans(mine)):
            low, high = (words[first][0], words[end][0]) if end < len(words) else (words[first - 1][1], words[end - 1][1])
            line = line[:low] + line[high:]
        rest.append(line)
    new = b"\n".join(rest).decode("utf-8", "surrogatepass")
    return new, len(linked) + len(_spans(mark(shared, linked))), len(gone_lines) + len(_spans(lost))


def _copies_and_wanted(pages: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """Tables: copies of whole texts, ``(rk, of, d)`` with the first document and its doc_id, and the
    fingerprints ``(of, d, prints, ord)`` that the first documents share with each other, ord rising with d and of.
    """
    firsts = pages.groupBy("u").agg(F.min(F.struct("d", "rk", "bands")).alias("first"), F.min("rk").alias("lo"), F.max("rk").alias("hi"), F.count("*").alias("n"))
    firsts = materialize(firsts, files)
    several = firsts.where("lo <> hi").select("u", "n", F.col("first.rk").alias("of"), F.col("first.d").alias("d"))
    copies = materialize(attach(pages.select("rk", "u"), several, "u", "n", pages.count()).where("of is not null").select("rk", "of", "d").distinct(), files)
    prints = firsts.select(F.col("first.rk").alias("of"), F.col("first.d").alias("d"), F.explode("first.bands").alias("print"))
    shared = materialize(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), files)
    found = attach(prints, shared, "print", "n", prints.count()).where("n is not null")
    wanted = found.groupBy("of", "d").agg(F.collect_list("print").alias("prints"))  # at most the fingerprints of a document
    wanted = materialize(wanted.orderBy("d", "of").withColumn("ord", F.monotonically_increasing_id()), files)
    discard(firsts, shared)
    return copies, wanted


def _run_fates(each: DataFrame, order: DataFrame, copies: DataFrame, files: int) -> DataFrame:
    """``each(ord, at, run, check)``, ``order(ord, of, d)`` -> table ``(rk, shared, gone, first, ids)`` of each document with repeated runs:

    starts of runs that another document has, of those that an earlier one has,
    the smallest doc_id of a run's first document, and these of the gone ones.
    """
    owner = each.groupBy(*RUN).agg(F.min("ord").alias("keep"), F.max("ord").alias("last"), F.count("*").alias("n"))
    owner = materialize(owner.where("keep <> last").select(*RUN, "n", "keep"), files)
    # One list a document: lists of arrays and sets beside each other would be sorted and merged one by one.
    found = attach(each, owner, RUN, "n", each.count()).where("keep is not null").groupBy("ord").agg(F.collect_list(F.struct("at", "keep")).alias("w"))
    lost = F.filter("w", lambda w: w["keep"] != F.col("ord"))
    single = found.select(
        "ord",
        F.col("w.at").alias("shared"),
        F.transform(lost, lambda w: w["at"]).alias("gone"),
        F.array_min("w.keep").alias("first"),
        F.array_distinct(F.transform(lost, lambda w: w["keep"])).alias("ids"),
    )
    single = materialize(single, files)
    named = order.select("ord", F.col("of").alias("rk"), "d")
    first = order.select(F.col("ord").alias("first"), F.col("d").alias("first_d"))
    sources = single.select("ord", F.explode("ids").alias("source")).join(order.select(F.col("ord").alias("source"), "d"), "source").where(F.col("d") != LAST)
    sources = sources.groupBy("ord").agg(F.collect_set("d").alias("ids"))
    no_ids = F.array().cast("array<long>")
    single = single.drop("ids").join(named, "ord").join(first, "first").join(sources, "ord", "left")
    single = materialize(single.select("rk", "shared", "gone", F.col("first_d").alias("first"), F.coalesce("ids", no_ids).alias("ids")), files)
    # A copy has the runs of its first document, and all other words from it.
    of = single.select(F.col("rk").alias("of"), "first", "ids")
    none, whole = F.array().cast("array<int>"), F.array(F.lit(-1))
    is_copy = F.col("rk") != F.col("of")
    copied = copies.join(of, "of", "left").select(
        "rk",
        whole.alias("shared"),
        F.when(is_copy, whole).otherwise(none).alias("gone"),
        F.least("first", "d").alias("first"),
        F.when(is_copy, F.array_union(F.coalesce("ids", no_ids), F.filter(F.array("d"), lambda d: d != LAST))).otherwise(no_ids).alias("ids"),
    )
    both = single.unionByName(copied).groupBy("rk")
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    out = materialize(both.agg(flat("shared"), flat("gone"), F.min("first").alias("first"), flat("ids")), files)
    discard(owner, single)
    return out


def repeated_paragraphs(docs: DataFrame, min_words: int = 20, width: int = 5, threshold: float = 0.8, recall: float = 0.99, part_rows: int = 512, run_words: int = 51) -> DataFrame:
    """All columns of ``docs`` (with doc_id and text), text without its repeated paragraphs and runs, plus

    class_id (smallest doc_id of a first document of the document's repeated
    paragraphs and runs, else its own), n_links (its paragraphs that also occur in
    another document, and its runs of ``run_words`` words or more outside of them),
    n_removed (paragraphs and such runs removed), source_doc_ids (first documents
    of these).  A document is told by doc_id and text, so repeated rows are the same
    document and fare alike; a null doc_id comes last.  Null texts stay null,
    empty ones empty; repeats inside one document stay, as do paragraphs of fewer
    than ``min_words`` words (no fewer than ``width``) outside of repeated runs and the rest, of fewer than
    ``run_words`` words, of a run that lost a paragraph.  Words are told apart by
    white space, in ASCII letters without case.  Columns of these names are
    replaced; names that start with ``_tw_`` are reserved.  No rows give no rows.
    """
    if min_words < width:
        raise ValueError("a paragraph needs the words of a shingle at least")
    bands, rows = tune_bands(threshold, recall)
    key = F.xxhash64("doc_id", "text")
    source = docs.select(key.alias("rk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), "text")
    seen = Observation()
    sizes = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")
    made = materialize(_units(source.observe(seen, *sizes), min_words, width, bands, rows, run_words))
    files = max(parts(seen.get["n"]), parts(seen.get["bytes"], 256 << 20))
    units, pages = made.where("line >= 0"), made.where("line < 0")
    copies, prints = _copies_and_wanted(pages, files)
    first = F.min(F.struct("d", "rk", "line", "bands")).alias("first")
    uniq = materialize(units.groupBy("u").agg(first, F.min("rk").alias("lo"), F.max("rk").alias("hi"), F.count("*").alias("n")), files)

    # Candidates: the paragraphs of a band bucket form a star around its smallest.
    banded = uniq.select("u", F.explode("first.bands").alias("key"))
    buckets = materialize(banded.groupBy("key").agg(F.min("u").alias("low"), F.max("u").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "low", "n"), files)
    star = attach(banded, buckets, "key", "n", bands * uniq.count()).where("low <> u")
    near = connected_components(star.select(F.col("u").alias("a"), F.col("low").alias("b")), files)
    discard(buckets)

    # Their shingle sets, read from one document that has the paragraph, and the windows around shared fingerprints.
    wanted = near.join(uniq, near["node"] == uniq["u"]).select(F.col("first.rk").alias("of"), F.struct(F.col("first.line").alias("line"), "u", "root").alias("w"))
    wanted = wanted.groupBy("of").agg(F.collect_list("w").alias("w"))  # at most the paragraphs of a document
    wanted = wanted.select("of", *[F.col(f"w.{c}").alias(f"{c}s") for c in ("line", "u", "root")])
    wanted = wanted.join(prints.select("of", "prints", "ord"), "of", "full")
    size = min(ANCHOR, run_words)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(pdf):
                sets, windows = [], []
                # The texts' words are one stream; only its windows that lie inside a text are looked at.
                texts = [t.encode("utf-8", "surrogatepass").lower() for t in part["text"]]
                raw = b"\n".join(texts)
                spans = word_spans(raw)
                stream = word_hashes(raw, spans)
                shingles = rolling(stream, width)
                line_at = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1, [len(raw) + 1]])
                ends = np.searchsorted(spans[:, 0], line_at)
                text_at = np.searchsorted(line_at, np.cumsum([0, *(len(t) + 1 for t in texts)]))
                for lines, us, roots, shared, number, first, last in zip(*(part[c] for c in ("lines", "us", "roots", "prints", "ord")), text_at[:-1], text_at[1:], strict=True):
                    if lines is not None:
                        for root, u, low, high in zip(roots, us, ends[first + lines], ends[first + lines + 1], strict=True):
                            sets.append((root, u, np.unique(shingles[low : high - width + 1]).view(np.int64)))
                    if shared is not None:
                        # Equal windows have the same least fingerprint.
                        hashes = stream[ends[first] : ends[last]]
                        least = _slide(np.minimum, rolling(hashes, size), run_words - size + 1)
                        at = np.flatnonzero(np.isin(least.view(np.int64), shared))
                        windows.append((number, at, rolling(hashes, run_words).view(np.int64)[at], rolling(_mixed(hashes), run_words, 1).view(np.int64)[at]))
                if sets:
                    made = pd.DataFrame(sets, columns=["root", "u", "set"])
                    yield made.assign(ord=None, at=None, run=None, check=None).astype({"ord": "Int64", "at": "Int32", "run": "Int64", "check": "Int64"})
                if windows:
                    number, at, run, check = zip(*windows, strict=True)
                    made = pd.DataFrame({"ord": np.repeat(np.array(number, dtype=np.int64), list(map(len, at))), "at": np.concatenate(at).astype(np.int32), "run": np.concatenate(run), "check": np.concatenate(check)})
                    made = made.assign(root=None, u=None, set=None).astype({"root": "Int64", "u": "Int64"})
                    yield made[["root", "u", "set", "ord", "at", *RUN]]

    payload = source.join(wanted, F.col("rk") == F.col("of")).select("rk", "text", "lines", "us", "roots", "prints", F.coalesce("ord", F.lit(-1)).alias("ord")).dropDuplicates(["rk"]).drop("rk")
    payload = materialize(payload.mapInPandas(tidy(cut), "root long, u long, set array<long>, ord long, at int, run long, check long"), 2 * files)
    runs = _run_fates(payload.where("ord is not null").select("ord", "at", *RUN), prints.select("ord", "of", "d"), copies, files)
    discard(prints, near)
    linked, spare = _verified(payload.where("u is not null").select("root", "u", "set"), threshold, part_rows, files)
    classes = connected_components(linked, files)
    discard(payload, copies, *spare)

    # The classes that occur in several documents, and what becomes of each paragraph.
    named = uniq.join(classes, uniq["u"] == classes["node"], "left").select("u", "n", "lo", "hi", F.col("first.d").alias("d"), F.col("first.rk").alias("rk"), F.coalesce("root", "u").alias("root"))
    named = materialize(named, files)
    discard(uniq, classes)
    kept = named.groupBy("root").agg(F.min(F.struct("d", "rk")).alias("keep"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    fate = materialize(named.select("root", "u", "n").join(kept, "root").select("u", "n", "keep"), files)
    found = attach(units.select("rk", "line", "u"), fate, "u", "n", units.count()).where("keep is not null")
    gone = F.col("keep.rk") != F.col("rk")
    per_doc = found.groupBy("rk").agg(
        F.min("keep.d").alias("class"),
        F.collect_set("line").alias("_tw_linked"),
        F.collect_set(F.when(gone, F.col("line"))).alias("_tw_gone"),
        F.collect_set(F.when(gone & (F.col("keep.d") != LAST), F.col("keep.d"))).alias("sources"),
    )
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    per_doc = per_doc.join(runs, "rk", "full").select(
        F.col("rk").alias("_tw_rk"),
        F.least("class", "first").alias("_tw_class"),
        none("_tw_linked", "int").alias("_tw_linked"),
        none("_tw_gone", "int").alias("_tw_gone"),
        F.col("shared").alias("_tw_shared"),
        F.col("gone").alias("_tw_runs"),
        F.array_sort(F.array_union(none("sources", "long"), none("ids", "long"))).alias("source_doc_ids"),
    )
    per_doc = materialize(per_doc, files)
    discard(made, named, fate, runs)

    @F.pandas_udf("text string, n_links long, n_removed long")
    def without(text: pd.Series, linked: pd.Series, lines: pd.Series, shared: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None else cut_runs(t, *map(list, lists), run_words) for t, *lists in zip(text, linked, lines, shared, runs, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_links", "n_removed"]).astype({"n_links": "Int64", "n_removed": "Int64"})

    out = docs.drop("class_id", "n_links", "n_removed", "source_doc_ids").withColumn("_tw_rk", key).join(per_doc, "_tw_rk", "left")
    # Only texts with repeated runs are read in Python; a filter of the caller's must not have them read again.
    lists = (F.when(F.col("_tw_shared").isNotNull(), F.col(c)) for c in ("text", "_tw_linked", "_tw_gone", "_tw_shared", "_tw_runs"))
    out = out.withColumn("_tw_cut", without.asNondeterministic()(*lists))
    rest = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("_tw_gone"), i))
    rest = F.when(F.size("_tw_gone") > 0, F.array_join(rest, "\n")).otherwise(F.col("text"))
    out = out.withColumn("text", F.coalesce("_tw_cut.text", rest))
    out = out.withColumn("class_id", F.coalesce(F.when(F.col("_tw_class") != LAST, F.col("_tw_class")), F.col("doc_id")))
    out = out.withColumn("n_links", F.coalesce("_tw_cut.n_links", F.greatest(F.size("_tw_linked"), F.lit(0)).cast("long")))
    out = out.withColumn("n_removed", F.coalesce("_tw_cut.n_removed", F.greatest(F.size("_tw_gone"), F.lit(0)).cast("long")))
    out = out.withColumn("source_doc_ids", F.coalesce("source_doc_ids", F.array().cast("array<long>")))
    return out.drop("_tw_rk", "_tw_class", "_tw_linked", "_tw_gone", "_tw_shared", "_tw_runs", "_tw_cut")
