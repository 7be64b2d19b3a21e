"""SimHash near-duplicates by pivot distance tables.

A fingerprint has 64 bits or, for near copies that differ more, 128. Every distinct fingerprint is a node with a row in the
distance table: its Hamming distances to REFERENCES fixed fingerprints, computed once. Two fingerprints within radius r of each other
differ by r at most in every distance (triangle inequality), so a pair whose largest coordinate difference exceeds r is
discarded, and the bits of survivors alone are compared. A reference can't index: for random fingerprints a
coordinate difference is at most 4 with probability 0.6. So pairs to look at come from an equi-join on keys, each made of
some bits (a bit is the difference of the distances to the reference of that bit alone and to zero):

* links of fingerprints (`simhash_components`): the bits are dealt into g groups; fingerprints within r of each other agree on
  g - r whole groups at least, which are the keys, so no link is lost.
* links of texts (`drop_near_duplicates`): sets of word shingles with a Jaccard similarity of `similarity` or more. Their 128-bit
  fingerprints differ at 15 % of the bits on average where that is 0.8, which no whole groups survive; keys are random
  choices of bits, so many that a pair at exactly the threshold shares one with probability RECALL (near-certain above it). Pairs
  within a radius that nearly all such pairs keep are verified by their exact sets of shingles.

Within one key only a spanning forest of the links is emitted, which is all that components need (for texts
the forest of the shortest distances). Keys are counted first; one of more than BLOCK nodes is dealt out as pairs of blocks before
anything is sorted. Exact copies meet as one fingerprint first.

Nulls and texts without words have fingerprint zero and link like any other; a text with fewer words than a shingle is one
shingle; repeated rows share a fingerprint; a null doc_id is never a component id unless its component has no other; an
empty table gives an empty table. simhash_components reads only doc_id and text; drop_near_duplicates keeps all columns, of any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, discard, field, fresh, materialize, named, tidy, with_columns
from .components import components, contracted

BITS = 64
REFERENCES = 16
#: Nodes of one key that one task compares.
BLOCK = 20_000
#: Parts in which keys are counted before they are counted one by one.
COARSE = 1 << 14
#: Candidates by chance that a fingerprint may have on average.
CHANCE = 4
#: Groups up to this size compare all their pairs at once.
SMALL = 8
#: Words of a shingle, and the similarity of their sets from which on texts are near copies.
WORDS = 5
SIMILARITY = 0.8
#: 64-bit words of a fingerprint for links of texts, and the part of pairs at the very threshold that keys keep.
WIDE = 2
RECALL = 0.995
#: Bits of a hash by which texts that are no candidate's are left out: 1 MB of flags.
FILTER = 23


def _hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split know ASCII alone
    if not w:
        return np.empty(0, "<u8")
    grams = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    return np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")


def _majority(h: np.ndarray) -> int:
    """Signed 64 bits, each set if it is in over half of h."""
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 65_535):
        ones += np.unpackbits(h[k : k + 65_535].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """The signed 64-bit fingerprint of a text's word shingles, repeats included."""
    return _majority(_hashes(text, words))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    return np.unique(_hashes(text, words))


def wide_fingerprint(text: str | None, words: int = WORDS) -> tuple[int, ...]:
    """WIDE signed words of the fingerprint of a text's distinct shingles; further words come from their hashes, mixed."""
    h = shingles(text, words)
    out = [_majority(h)]
    for k in range(1, WIDE):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return tuple(out)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct values; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def references(words: int = 1, count: int = REFERENCES, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, (count, words), dtype=np.uint64)


def _signed(x: int) -> int:
    x = int(x)
    return x - (1 << 64) if x >> 63 else x


def with_table(nodes: DataFrame, words: int) -> DataFrame:
    """nodes (columns f0, f1, ...) and t0, t1: the distances to the references, a byte each."""
    refs = references(words)

    def packed(some: np.ndarray) -> Column:
        out = F.lit(0).cast("long")
        for k, ref in enumerate(some):
            distance = sum((F.bit_count(F.col(f"f{w}").bitwiseXOR(F.lit(_signed(ref[w])))) for w in range(words)), F.lit(0))
            out = out.bitwiseOR(F.shiftleft(distance.cast("long"), 8 * k))
        return out

    return nodes.withColumns({f"t{k}": packed(refs[8 * k : 8 * k + 8]) for k in range(REFERENCES // 8)})


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (a row of words) to each reference, as bytes."""
    return np.bitwise_count(fps[:, None, :] ^ refs[None, :, :]).sum(axis=2, dtype=np.uint8)


def coordinate_groups(n: int, radius: int) -> list[int]:
    """Masks of the coordinate groups that keys are made of: the fewest groups at which n random fingerprints have at
    most CHANCE candidates each by chance."""
    g = radius + 1
    while g < 16 and n * comb(g, g - radius) / 2 > CHANCE * 2.0 ** ((g - radius) * (BITS // g)):
        g += 1
    cuts = [round(k * BITS / g) for k in range(g + 1)]
    groups = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(groups, g - radius)]


def differing(similarity: float) -> float:
    """The share of bits at which fingerprints of sets with this Jaccard similarity differ on average: their angle."""
    return acos(2 * similarity / (1 + similarity)) / pi


def wide_radius(similarity: float) -> int:
    """The distance that fingerprints of sets at the threshold stay within, but for one pair in 30,000: four deviations."""
    n, p = WIDE * BITS, differing(similarity)
    return min(n, ceil(n * p + 4 * sqrt(n * p * (1 - p))))


def wide_masks(n: int, similarity: float, seed: int = 2) -> np.ndarray:
    """Masks (rows of WIDE words) of random bits: about as many bits as n nodes have, less two, and as many masks as RECALL asks for."""
    bits = max(8, ceil(log2(n + 1)) - 2)
    same = (1 - differing(similarity)) ** bits
    count = 1 if same > 1 - 1e-9 else ceil(log(1 - RECALL) / log(1 - same))
    rng = np.random.default_rng(seed)
    flags = np.zeros((count, WIDE * BITS), bool)
    for row in flags:
        row[rng.choice(WIDE * BITS, bits, replace=False)] = True
    return np.packbits(flags, axis=1, bitorder="little").view("<u8")


def survivors(table: np.ndarray, row: np.ndarray, radius: int) -> np.ndarray:
    """Rows of the table whose largest coordinate difference to row is radius at most, one reference after the other."""
    keep = np.arange(len(table))
    for k in range(table.shape[1]):
        keep = keep[np.abs(table[keep, k].astype(np.int16) - np.int16(row[k])) <= radius]
    return keep


def close_pairs(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are within radius: first by their tables, then survivors by their bits."""
    at = np.arange(len(a))
    for k in range(ta.shape[1]):
        at = at[np.abs(ta[at, k].astype(np.int16) - tb[at, k]) <= radius]
    near = np.zeros(len(a), dtype=bool)
    near[at] = np.bitwise_count(a[at] ^ b[at]).sum(axis=1) <= radius
    return near


def forest(fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a spanning forest of the links among fps. Breadth first: every step compares one fingerprint to
    those not reached yet, so a dense group costs few steps."""
    left = np.arange(len(fps))
    us, vs = [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        i = queue.pop()
        some = survivors(table[left], table[i], radius)
        some = some[np.bitwise_count(fps[left[some]] ^ fps[i]).sum(axis=1) <= radius]
        if len(some):
            found = left[some]
            us.append(np.full(len(found), i))
            vs.append(found)
            queue.extend(found.tolist())
            left = np.delete(left, some)
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def shortest_forest(fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a spanning forest of the links among fps that takes the shortest ones, grown from node to node."""
    left = np.arange(1, len(fps))
    best, parent = np.full(len(left), radius + 1), np.zeros(len(left), np.int64)
    us, vs, i = [], [], 0
    while len(left):
        some = survivors(table[left], table[i], radius)
        d = np.bitwise_count(fps[left[some]] ^ fps[i]).sum(axis=1, dtype=np.int64)
        less = d < best[some]
        best[some[less]], parent[some[less]] = d[less], i
        k = int(best.argmin())
        i = int(left[k])
        if best[k] <= radius:
            us.append(int(parent[k]))
            vs.append(i)
        left, best, parent = np.delete(left, k), np.delete(best, k), np.delete(parent, k)
    return np.array(us, np.int64), np.array(vs, np.int64)


def _link_groups(batches: Iterator[pa.RecordBatch], words: int, radius: int, grow=forest) -> Iterator[pa.RecordBatch]:
    """Edges u, v within groups: columns key, a, b (equal within a group, groups one after the other), node, words and table."""
    held: list[np.ndarray] = []

    def link(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        node = rows[:, 3]
        fps = np.ascontiguousarray(rows[:, 4 : 4 + words]).view(np.uint64)
        table = np.ascontiguousarray(rows[:, 4 + words :]).view(np.uint8)
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        few = ends - starts <= SMALL
        width = (ends - starts)[few]
        for lag in range(1, SMALL):
            a, n = starts[few][width > lag], width[width > lag] - lag
            if not len(a):
                break
            i = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            ok = close_pairs(fps[i], fps[i + lag], table[i], table[i + lag], radius)
            us.append(node[i[ok]])
            vs.append(node[i[ok] + lag])
        for a, b in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
            u, v = grow(fps[a:b], table[a:b], radius)
            us.append(node[a + u])
            vs.append(node[a + v])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    def cut(rows: np.ndarray) -> np.ndarray:
        return np.r_[0, np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1]

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        held.append(rows)
        if len(rows) and (held[0][0, :3] != rows[-1, :3]).any():  # the last group may go on in the next batch
            rows = np.concatenate(held)
            starts = cut(rows)
            held = [rows[starts[-1] :]]
            yield link(rows, starts[:-1], starts[1:])
    if held and len(rows := np.concatenate(held)):
        starts = cut(rows)
        yield link(rows, starts, np.r_[starts[1:], len(rows)])


def links(nodes: DataFrame, words: int, masks: np.ndarray, radius: int, block: int = BLOCK, grow=forest) -> DataFrame:
    """u, v: links of nodes (columns node, f0, ..., t0, t1) within radius that share the masked bits of some mask, a spanning forest
    for each key; written to the shared folder."""
    columns = ["node", *(f"f{w}" for w in range(words)), *(f"t{k}" for k in range(REFERENCES // 8))]
    keys = F.array(*(F.xxhash64(F.lit(k), *(F.col(f"f{w}").bitwiseAND(F.lit(_signed(m))) for w, m in enumerate(mask))) for k, mask in enumerate(masks)))
    rows = nodes.select(F.explode(keys).alias("key"), *columns)
    part = F.pmod("key", F.lit(COARSE))  # counted by parts of the keys first: no key of a small part is hot
    full = materialize(rows.groupBy(part.alias("part")).count().where(F.col("count") > block).select("part"), "full")
    some = rows.select("key").join(full, part == F.col("part"), "left_semi") if not full.isEmpty() else rows.select("key").limit(0)
    hot = materialize(some.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("blocks")), "hot")
    discard(full)
    zero = F.lit(0).cast("long")
    if hot.isEmpty():
        dealt = rows.select("key", zero.alias("a"), zero.alias("b"), *columns)
    else:  # a hot key's nodes are dealt to blocks, and every block meets every other
        rows = rows.join(hot, "key", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1).cast("long"))))
        rows = rows.withColumn("other", F.explode(F.sequence(zero, F.coalesce("blocks", F.lit(1).cast("long")) - 1)))
        dealt = rows.select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), *columns)
    group = ["key", "a", "b"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "node")
    found = materialize(dealt.mapInArrow(tidy(lambda it: _link_groups(it, words, radius, grow)), "u long, v long"), "links")
    discard(hot)
    return found


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and the smallest value of column least over the component of the node."""
    roots = components(edges)
    ends = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    own = ends.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("first"))
    linked = ends.join(own, "root").select("node", "first")
    return nodes.select("node", "least").join(linked, "node", "left").select("node", F.coalesce("first", "least").alias("first"))


def simhash_components(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every document."""
    prints = with_columns(docs.select("doc_id", "text"), lambda texts: [[fingerprint(t, words) for t in texts.to_pylist()]], ["text"], [field("node", "long")])
    prints = materialize(prints.select("doc_id", "node"), "prints")
    nodes = materialize(with_table(prints.groupBy("node").agg(F.min("doc_id").alias("least")).withColumn("f0", F.col("node")), 1), "nodes")
    masks = np.array(coordinate_groups(nodes.count(), radius), np.uint64)[:, None]
    first = classes(nodes, links(nodes, 1, masks, radius))
    return prints.join(first, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


_KEY = ["none", "id", "th"]


def _row_key() -> list[Column]:
    """What rows are known by: doc_id, nulls apart, and the text's hash."""
    return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("th")]


def _flags(wanted: DataFrame, bits: int = FILTER) -> np.ndarray:
    """A bit for each value that the last bits of th may have: whether a row of wanted has it, in words of 64."""
    at = F.shiftright(F.col("th").bitwiseAND((1 << bits) - 1), 6)
    words = wanted.groupBy(at.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(th & 63))")).alias("flags")).collect()  # 2^(bits - 6) rows at most
    out = np.zeros(1 << bits - 6, np.int64)
    out[[r.at for r in words]] = [r.flags for r in words]
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """node and set (sorted hashes of its shingles, as bytes) of the nodes in candidates u, v. Each node's set is made once, from its
    least row's text; a filter leaves out most other texts before anything is moved."""
    ends = candidates.select(F.col("u").alias("node")).unionByName(candidates.select(F.col("v").alias("node"))).distinct()
    wanted = materialize(nodes.join(ends, "node").select("node", "least.*"), "wanted")
    flags = _flags(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th = batch.column(2).to_numpy()
            some = batch.filter(pa.array(flags[(th >> 6) & (len(flags) - 1)] >> (th & 63) & 1 == 1))
            made = pa.array([shingles(t, words).tobytes() for t in some.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*some.columns[:3], made], names=[*_KEY, "set"])

    sets = docs.select(*_row_key(), "text").mapInArrow(tidy(run), "none boolean, id long, th long, set binary")
    return materialize(sets.join(wanted, _KEY).groupBy("node").agg(F.any_value("set").alias("set")), "sets")  # equal rows have equal sets


def similar_texts(sets: DataFrame, candidates: DataFrame, similarity: float) -> DataFrame:
    """The candidates u, v whose sets have that Jaccard similarity or more."""

    def judge(x: pa.Array, y: pa.Array) -> list[list[bool]]:
        return [[similarity_of(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")) >= similarity for a, b in zip(x, y, strict=True)]]

    pairs = candidates.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    one, two = (sets.select(F.col("node").alias(end), F.col("set").alias(name)) for end, name in (("u", "x"), ("v", "y")))
    both = pairs.join(one, "u").join(two, "v")
    return materialize(with_columns(both, judge, ["x", "y"], [field("same", "boolean")]).where("same").select("u", "v"), "similar")


def cross_links(fps: np.ndarray, table: np.ndarray, label: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> tuple[list[int], list[int]]:
    """Links (positions) that join all parts (equal labels) that any pair within radius and of that similarity joins: every such
    pair is judged unless its ends are joined already."""
    label, size = label.copy(), np.array([len(x) for x in sets])
    us, vs = [], []
    for i in range(len(fps) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i])]
        rest = rest[survivors(table[rest], table[i], radius)]
        for j in rest[np.bitwise_count(fps[rest] ^ fps[i]).sum(axis=1) <= radius].tolist():
            if label[j] != label[i] and similarity_of(sets[i], sets[j]) >= similarity:
                us.append(i)
                vs.append(j)
                label[label == label[j]] = label[i]
    return us, vs


def _cross_groups(batches: Iterator[pa.RecordBatch], words: int, radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Edges u, v of cross_links within groups: columns family, a, b (equal within a group, groups one after the other), node, label,
    words, table and set."""
    held: list[pa.Table] = []

    def link(group: pa.Table) -> pa.RecordBatch:
        rows = np.stack([c.to_numpy() for c in group.columns[3:-1]], axis=1)
        fps = np.ascontiguousarray(rows[:, 2 : 2 + words]).view(np.uint64)
        table = np.ascontiguousarray(rows[:, 2 + words :]).view(np.uint8)
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("set")]
        u, v = cross_links(fps, table, rows[:, 1], sets, radius, similarity)
        return pa.RecordBatch.from_arrays([pa.array(rows[u, 0], pa.int64()), pa.array(rows[v, 0], pa.int64())], names=["u", "v"])

    now = None
    for batch in batches:
        keys = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1)
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1] if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if held and tuple(keys[a]) != now:
                yield link(pa.concat_tables(held))
                held.clear()
            now = tuple(keys[a])
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield link(pa.concat_tables(held))


def missed_links(nodes: DataFrame, sets: DataFrame, candidates: DataFrame, similar: DataFrame, radius: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """u, v: links that the candidates' forests left out. A forest takes the shortest edges, and two texts may be similar where the edges
    between them are not. All pairs within radius of a group are in one component of candidates, so of every such component that the
    similar pairs leave in parts, pairs of different parts are judged."""
    family, part = (components(x).withColumnRenamed("root", name) for x, name in ((contracted(candidates), "family"), (similar, "label")))
    rows = sets.select("node").join(family, "node", "left").join(part, "node", "left")
    rows = rows.select("node", F.coalesce("family", "node").alias("family"), F.coalesce("label", "node").alias("label"))
    open_ = rows.groupBy("family").agg(F.count("*").alias("n"), F.min("label").alias("one"), F.max("label").alias("other")).where("one != other")
    open_ = materialize(open_.select("family", F.ceil(F.col("n") / block).alias("blocks")), "open")
    f, t = [f"f{w}" for w in range(WIDE)], [f"t{k}" for k in range(REFERENCES // 8)]
    zero = F.lit(0).cast("long")  # a large family's nodes are dealt to blocks, and every block meets every other
    rows = rows.join(open_, "family").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks")).withColumn("with", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    rows = rows.select("family", F.least("mine", "with").alias("a"), F.greatest("mine", "with").alias("b"), "node", "label")
    rows = rows.join(nodes.select("node", *f, *t), "node").join(sets, "node").select("family", "a", "b", "node", "label", *f, *t, "set")
    dealt = rows.repartition("family", "a", "b").sortWithinPartitions("family", "a", "b", "node")
    return materialize(dealt.mapInArrow(tidy(lambda it: _cross_groups(it, WIDE, radius, similarity)), "u long, v long"), "missed")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """none, id, th (see _row_key), n (rows) and first (the least such key) of every distinct row of doc_id and text, by components of
    similar texts."""
    texts = with_columns(docs.select("doc_id", "text"), lambda texts: list(zip(*(wide_fingerprint(t, words) for t in texts.to_pylist()), strict=True)) or [[]] * WIDE, ["text"], [field(f"f{w}", "long") for w in range(WIDE)])
    f = [f"f{w}" for w in range(WIDE)]
    prints = materialize(texts.select(*_row_key(), *f).groupBy(*_KEY, *f).agg(F.count("*").alias("n")), "prints")
    nodes = prints.groupBy(*f).agg(F.min(F.struct(*_KEY)).alias("least")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(with_table(nodes, WIDE), "nodes")
    radius = wide_radius(similarity)
    found = links(nodes, WIDE, wide_masks(nodes.count(), similarity), radius, grow=shortest_forest)
    sets = sets_of(docs, nodes, found, words)
    same = similar_texts(sets, found, similarity)
    same = same.unionByName(missed_links(nodes, sets, found, same, radius, similarity))
    first = materialize(classes(nodes, same), "classes")
    return prints.join(nodes.select("node", *f), f).join(first, "node").select(*_KEY, "n", "first")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """docs with one row of each component of near copies: that of the smallest doc_id, then of the smallest text hash, then of
    the smallest other columns (as JSON). A row whose doc_id is null counts as larger than any other."""
    rows = materialize(near_duplicate_classes(docs, similarity, words), "verdicts")
    own = F.struct(*_KEY) == F.col("first")
    known = fresh(docs, *_KEY)
    keyed = docs.withColumns({name: c for name, c in zip(known, _row_key(), strict=True)})
    listed = lambda which: materialize(rows.where(which).select(*_KEY), "listed").toDF(*known)
    gone, many = listed(~own | (F.col("n") > 1)), listed(own & (F.col("n") > 1))
    out = keyed.join(gone, known, "left_anti").select(*columns_of(docs))  # Catalyst broadcasts the list where its size is small
    if many.isEmpty():
        return out
    (rank,) = fresh(keyed, "rank")
    others = [named(c) for c in docs.columns if c not in ("doc_id", "text")]
    one = F.row_number().over(Window.partitionBy(*known).orderBy(F.to_json(F.struct(*others)) if others else F.lit(0)))
    equal = keyed.join(many, known, "left_semi").withColumn(rank, one).where(named(rank) == 1)
    return out.unionByName(equal.select(*columns_of(docs)))
