"""Packing documents into sequences: cutting stock by column generation.

A document's ids are cut into pieces of the sequence length and a rest. Lengths of pieces, rounded up to UNIT ids, make
a histogram (at most length / UNIT classes, whatever the size of the corpus). A linear program over patterns (how
many pieces of each class share a sequence) covers the histogram with the fewest sequences: new patterns
come from a knapsack dynamic program over the dual prices until the sequences are proved to be within a thousandth of the
program's optimum. Pattern counts are rounded
down, the classes left over (about as many sequences as there are classes, at any size) are packed by
first fit decreasing. Pieces, ranked within their class, are assigned to the patterns' places by rank.

A null text is its end id alone; equal rows are packed once each; an empty table gives an empty table. Only doc_id
and text are read. Padding is what the rounding leaves, below UNIT ids a piece, and the rests of the last patterns.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy
from .tokens import default_tokenizer, encoder, no_collections

LENGTH = 2048
UNIT = 8
END = 1
#: Pieces that are ranked in one window.
RANKED = 20_000


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best value of any multiset of sizes within room, and its counts."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes)
    sizes, values = sizes[order], values[order]
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(sizes, c, side="right")
        if k:
            got = best[c - sizes[:k]] + values[:k]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], took[c] = got[j], j
    counts, c = np.zeros(len(sizes), dtype=np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    out = np.zeros_like(counts)
    out[order] = counts
    return float(best[room]), out


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps; m is a few hundred."""
    m = len(a)
    w = np.hstack([a, np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(w[k:, k]).argmax())
        w[[k, p]] = w[[p, k]]
        w[k] /= w[k, k]
        f = w[:, k].copy()
        f[k] = 0
        at = np.flatnonzero(f)
        w[at] -= np.outer(f[at], w[k])
    return w[:, m:]


def fractional(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and fractional counts that cover demand, always within gap of the program's optimum, by its dual bound: revised
    simplex whose entering columns are priced by knapsack(). Products are written out, as threads of a BLAS don't pay here."""
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / (room // sizes))
    cost = np.ones(m)
    want = demand * (1 + 1e-9 * np.arange(1, m + 1) / m)  # against ties in the ratio test
    x = (inverse * want).sum(axis=1)
    for step in count():
        prices = (cost[:, None] * inverse).sum(axis=0)
        now = float((cost * x).sum())
        value, column = knapsack(np.maximum(prices, 0), sizes, room)
        slack = int(prices.argmin())
        enter = -np.eye(m)[slack] if -prices[slack] > value - 1 else column.astype(float)
        if max(value - 1, -prices[slack]) < 1e-7 or value > 0 and prices.min() > -1e-9 and now <= (1 + gap) * float((prices * want).sum()) / value:
            break
        along = (inverse * enter).sum(axis=1)
        up = along > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / along[up]
        out = int(ratio.argmin())
        x -= ratio[out] * along
        x[out] = ratio[out]
        basis[:, out] = enter
        cost[out] = 0.0 if enter.min() < 0 else 1.0
        if step % 100 == 99:
            inverse = _inverse(basis)
            x = (inverse * want).sum(axis=1)
        else:
            row = inverse[out] / along[out]
            inverse -= np.outer(along, row)
            inverse[out] = row
    real = cost > 0
    return basis[:, real].astype(np.int64), np.maximum(x[real], 0)


def patterns(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(count, {class: pieces}) that hold exactly the histogram's pieces."""
    out = [(histogram[room], {room: 1})] if histogram.get(room) else []
    classes = sorted((c for c, n in histogram.items() if n and c != room), reverse=True)
    if not classes:
        return out
    sizes, left = np.array(classes), np.array([histogram[c] for c in classes], dtype=np.int64)
    columns, counts = fractional(sizes, left.astype(float), room)
    for k in np.argsort(-counts, kind="stable"):
        used = columns[:, k] > 0
        n = min(int(counts[k] + 1e-6), int((left[used] // columns[used, k]).min()))
        if n > 0:
            out.append((n, {classes[i]: int(columns[i, k]) for i in np.flatnonzero(used)}))
            left -= n * columns[:, k]
    while left.any():
        space, pattern = room, {}
        for i, c in enumerate(classes):
            if n := min(int(left[i]), space // c):
                pattern[c] = n
                space -= n * c
        n = min(int(left[classes.index(c)]) // k for c, k in pattern.items())
        out.append((n, pattern))
        for c, k in pattern.items():
            left[classes.index(c)] -= n * k
    return out


def places(solution: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first rank of each of its patterns, the pattern's first sequence, pieces a sequence, first place."""
    table: dict[int, list] = {}
    sequence = 0
    for n, pattern in solution:
        place = 0
        for c, k in pattern.items():
            rows = table.setdefault(c, [])
            rank = rows[-1][0] + rows[-1][4] * rows[-1][2] if rows else 0
            rows.append((rank, sequence, k, place, n))
            place += k
        sequence += n
    return {c: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for c, rows in table.items()}


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece."""
    path, end = tokenizer or default_tokenizer(), END.to_bytes(4, "little")

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                with no_collections():
                    ids, name = enc.encode(text.as_py()) + end, name.as_py()
                n = len(ids) // 4
                rows += ((name, a, min(length, n - a), zlib.crc32(ids[4 * a : 4 * (a + length)]), n) for a in range(0, n, length))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    cut = materialize(pieces(docs, tokenizer, length), "pieces").withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    histogram = dict(cut.groupBy("class").count().collect())  # at most length / unit rows
    where = places(patterns(histogram, length // unit))
    buckets = max(1, sum(histogram.values()) // RANKED)
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy("class", "bucket").count().select("class", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(*order)) - 1)
    ranked = ranked.join(first, ["class", "bucket"]).select(*order[:2], "length", *order[2:], "class", (F.col("rank") + F.col("first")).alias("rank"))

    def assign(batches):
        for batch in batches:
            kinds, ranks = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sequence, place = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for c in np.unique(kinds).tolist():
                at = np.flatnonzero(kinds == c)
                since, start, k, shift, _ = where[c]
                p = np.searchsorted(since, ranks[at], side="right") - 1
                i = ranks[at] - since[p]
                sequence[at], place[at] = start[p] + i // k[p], shift[p] + i % k[p]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(place)], names=[*batch.schema.names[:5], "sequence_id", "place"])

    placed = ranked.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    so_far = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0))).drop("place")
