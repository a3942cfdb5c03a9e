"""Vector code compression: product codebooks by Yinyang Lloyd rounds in exact integers.

Vectors are cut into equal consecutive parts and each part position has a
codebook.  The entries of a codebook are clustered into groups once.  With each
part goes its entry and, for each group, a lower bound of its distance to the
group's other entries.  When entries have moved, a group's bound falls by the
longest way of its entries; only groups whose bound doesn't exceed the distance
to the part's own entry are scanned.  Distances that decide are integers, so ties
are ties.

A round is one pass over a table in the shared folder that holds vectors, entries
and bounds: rows stay where they are, each task adds up its parts by entry, and
only these sums are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewind.llm.common import discard, materialize, tidy

#: Components of larger size are held at this.
MOST = 1 << 62


def integers(scaled: np.ndarray) -> np.ndarray:
    """floor of doubles as 64-bit integers."""
    return np.clip(np.floor(scaled), -MOST, MOST).astype(np.int64)


def _exact(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which squared distances are exact: doubles below 2 ** 53, 64-bit integers, Python's integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    bound = 4 * top * top * max(1, book.shape[1])
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    return x.astype(kind), book.astype(kind)


def grouped(book: np.ndarray, groups: int) -> list[np.ndarray]:
    """The entries of a codebook in so many clusters at most, each in ascending order."""
    points = book.astype(float)
    centres = points[:: max(1, len(points) // groups)][:groups]
    for _ in range(5):
        own = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return [found for g in range(len(centres)) if len(found := np.flatnonzero(own == g))]


def _below(x: np.ndarray) -> np.ndarray:
    """Floats of half the size, none above its double."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


def nearest(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], code: np.ndarray | None = None, bounds: np.ndarray | None = None, drift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance, bounds, distances computed) of each row of ``x``; ties go to the lower entry.

    ``code`` and ``bounds`` are those of the last round and ``drift`` says how far
    each entry has moved since; without them every group is scanned.
    """
    x, book = _exact(x, book)
    n = len(x)
    size_x, size_c = (x * x).sum(axis=1), (book * book).sum(axis=1)
    if code is None:
        code, best = np.zeros(n, dtype=np.int64), None
        bounds, scan = np.zeros((n, len(groups)), dtype=np.float32), np.ones((n, len(groups)), dtype=bool)
    else:
        own = book[code]
        best = ((x - own) * (x - own)).sum(axis=1)
        moved = np.array([drift[g].max() for g in groups])
        bounds = _below(bounds - moved)
        scan = bounds <= (_root(best) * (1 + 1e-9))[:, None]
    old, old_best, computed = code, best, n if best is not None else 0
    code, second = code.copy(), np.full((n, len(groups), 2), np.inf)
    found, at = {}, np.full((n, len(groups)), -1)
    for g, members in enumerate(groups):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        d = size_x[rows, None] - 2 * (x[rows] @ book[members].T) + size_c[members]
        computed += d.size
        first = d.argmin(axis=1).astype(np.int64)
        low = d[np.arange(len(rows)), first]
        found[g] = rows, low
        second[rows, g, 0], at[rows, g] = low.astype(float), members[first]
        if len(members) > 1:
            d[np.arange(len(rows)), first] = d.max() + 1
            second[rows, g, 1] = d.min(axis=1).astype(float)
    for g, (rows, low) in found.items():
        if best is None:
            best = np.empty(n, dtype=x.dtype)
            best[rows], code[rows] = low, at[rows, g]  # the first group scans all rows
            continue
        better = (low < best[rows]) | ((low == best[rows]) & (at[rows, g] < code[rows]))
        best[rows[better]], code[rows[better]] = low[better], at[rows[better], g]
    # The distance to the nearest entry of a group other than the part's own.
    fresh = np.sqrt(np.where(at == code[:, None], second[:, :, 1], second[:, :, 0]))
    bounds = np.where(at >= 0, _below(fresh * (1 - 1e-9)), bounds)
    if old_best is not None:
        of = np.empty(len(book), dtype=np.int64)
        for g, members in enumerate(groups):
            of[members] = g
        left = np.flatnonzero((code != old) & (at[np.arange(n), of[old]] < 0))
        bounds[left, of[old[left]]] = np.minimum(bounds[left, of[old[left]]], _below(_root(old_best[left]) * (1 - 1e-9)))
    return code, best, bounds.astype(np.float32), computed


def kept(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vector.isNotNull() & ~bad


def codebooks_sha256(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _packed(rows: list[np.ndarray], kind: str) -> pa.Array:
    return pa.array([r.astype(kind).tobytes() for r in rows], pa.binary())


def compress(vectors: DataFrame, carry: tuple[str, ...] = ("vec_id",), parts: int = 4, entries: int = 256, rounds: int = 4, groups: int = 16, scale: float = 1024.0) -> tuple[DataFrame, np.ndarray]:
    """``vectors(vec_id, embedding)`` -> ``(carried columns, code, error)`` of each kept row, and the codebooks.

    ``code`` is an array of one entry for each part, ``error`` the sum of squared
    distances (held at 64 bits); codebooks are integers [part, entry, position].
    Vectors that are null or hold null or non-finite components are dropped.
    Components become floor(scale * x), held within 2 ** 62.  Codebooks start as
    the vectors of the smallest vec_ids (null last, equal ids by their vectors), so
    there are fewer entries if there are fewer rows; repeated rows take part as
    often as they occur.  Vectors shorter than the longest, or than a multiple of
    ``parts``, count as filled with zeros; if all are empty, every code is 0.
    Carried columns named code or error give way to these, other columns are not
    read; no rows give no rows and empty codebooks.
    """
    carry = tuple(c for c in carry if c not in ("code", "error"))
    rows = vectors.where(kept(F.col("embedding"))).select(F.struct(*carry).alias("_tw_keep"), "vec_id", F.col("embedding").cast("array<double>").alias("_tw_v"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "_tw_v").limit(entries).select("_tw_v").collect()  # at most ``entries`` rows
    longest = rows.agg(F.max(F.size("_tw_v"))).first()[0] or 0
    width = -(-longest // parts)
    start = np.zeros((len(first), parts * width))
    for row, (v,) in zip(start, first, strict=True):
        row[: len(v)] = v
    books = integers(scale * start).reshape(len(first), parts, width).transpose(1, 0, 2)
    keep_type = rows.schema["_tw_keep"].dataType.simpleString()
    if not first:
        return rows.sparkSession.createDataFrame([], rows.schema["_tw_keep"].dataType).selectExpr("*", "cast(null as array<int>) as code", "0L as error"), books
    members = [grouped(book, groups) for book in books]

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        """Integers [row, component] of a batch of the source or of a table of ours."""
        column = batch.column("_tw_v")
        if pa.types.is_binary(column.type):
            return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(batch), parts * width)
        out, sizes = np.zeros((len(batch), parts * width)), np.diff(column.offsets.to_numpy())
        at = np.arange(parts * width) < sizes[:, None]
        out[at] = column.flatten().to_numpy(zero_copy_only=False)
        return integers(scale * out)

    def assigned(batch: pa.RecordBatch, x: np.ndarray, books: np.ndarray, drift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, total, n = np.empty((len(x), parts), dtype=np.int64), np.zeros(len(x), dtype=object), len(x)
        sizes = np.cumsum([0, *map(len, members)])
        if drift is not None:
            old = np.frombuffer(b"".join(batch.column("_tw_code").to_pylist()), dtype="<u2").reshape(n, parts).astype(np.int64)
            old_bounds = np.frombuffer(b"".join(batch.column("_tw_bounds").to_pylist()), dtype="<f4").reshape(n, sizes[-1])
        bounds = np.empty((n, sizes[-1]), dtype=np.float32)
        for p, book in enumerate(books):
            last = () if drift is None else (old[:, p], old_bounds[:, sizes[p] : sizes[p + 1]], drift[p])
            codes[:, p], far, bounds[:, sizes[p] : sizes[p + 1]], _ = nearest(x[:, p * width : (p + 1) * width], book, members[p], *last)
            total += far.astype(np.int64 if far.dtype != object else object).astype(object)
        return codes, np.array([min(int(t), (1 << 63) - 1) for t in total], dtype=np.int64), bounds

    def turn(books: np.ndarray, drift: np.ndarray | None):
        """A pass that assigns and adds up: rows with their new state, and for each used entry of the task its sum and count."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, used = np.zeros((parts, books.shape[1], width), dtype=object), np.zeros((parts, books.shape[1]), dtype=np.int64)
            keep = None
            for batch in batches:
                if not len(batch):
                    continue
                x, keep = matrix(batch), batch.column("_tw_keep")
                codes, _, bounds = assigned(batch, x, books, drift)
                for p in range(parts):
                    part, order = x[:, p * width : (p + 1) * width], np.argsort(codes[:, p], kind="stable")
                    entry, at, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                    safe = int(np.abs(part).max(initial=0)) * len(part) < 1 << 62
                    sums[p, entry] += np.add.reduceat(part[order].astype(np.int64 if safe else object), at, axis=0)
                    used[p, entry] += n
                none = pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.list_(pa.string()))
                yield pa.record_batch([keep, _packed(list(x), "<i8"), _packed(list(codes), "<u2"), _packed(list(bounds), "<f4"), *none], names=state)
            if keep is not None:
                p, entry = np.nonzero(used)
                n = len(p)
                said = [[str(used[i, j]), *map(str, sums[i, j])] for i, j in zip(p, entry, strict=True)]
                blank = pa.nulls(n, pa.binary())
                yield pa.record_batch([pa.nulls(n, keep.type), blank, blank, blank, pa.array(p * books.shape[1] + entry, pa.int32()), pa.array(said, pa.list_(pa.string()))], names=state)

        return run

    def final(books: np.ndarray, drift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    codes, error, _ = assigned(batch, matrix(batch), books, drift)
                    yield pa.record_batch([batch.column("_tw_keep"), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(error)], names=["_tw_keep", "code", "error"])

        return run

    state = ["_tw_keep", "_tw_v", "_tw_code", "_tw_bounds", "_tw_entry", "_tw_sums"]
    schema = f"_tw_keep {keep_type}, _tw_v binary, _tw_code binary, _tw_bounds binary, _tw_entry int, _tw_sums array<string>"
    table, drift = rows.select("_tw_keep", "_tw_v"), None
    for r in range(rounds):
        made = materialize(table.mapInArrow(tidy(turn(books, drift)), schema))
        if r:
            discard(before)
        before, table = made, made.where("_tw_entry is null").select(*state[:4])
        number = lambda i: F.sum(F.col("_tw_sums")[i].cast("decimal(38,0)")).alias(f"s{i}")
        found = made.where("_tw_entry is not null").groupBy("_tw_entry").agg(*[number(i) for i in range(width + 1)]).collect()  # a row for each entry
        new = books.copy()
        for row in found:
            p, j = divmod(row["_tw_entry"], books.shape[1])
            new[p, j] = [int(s) // int(row["s0"]) for s in row[2:]]
        way = (new.astype(object) - books.astype(object)).astype(float)
        books, drift = new, np.sqrt((way**2).sum(axis=2)) * (1 + 1e-9)
    out = table.mapInArrow(tidy(final(books, drift)), f"_tw_keep {keep_type}, code array<int>, error long")
    return out.select("_tw_keep.*", "code", "error"), books
