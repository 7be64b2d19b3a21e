"""Token-ID output: a Huffman-shaped wavelet matrix for every shard of token ids.

A shard file holds, for token ids of consecutive documents, its alphabet with counts, bit planes of the ids' Huffman codes
(first bit first; after each plane the ids are ordered stably by that bit, and those whose code ends there are left out), counts of ones
before every block, and the documents' ids and lengths. So a file has about as many bits as its ids' entropy, a few percent
of counts, and the alphabet. Codes are dealt so that in each plane's order the ids that end stand last. From the planes alone come the
token at a position, the count of a token before a position, the position of its k-th occurrence (all for many at once, by
rank and select), and the whole sequence.

Shards are rows of one written table, so any store that Spark reaches can hold them; documents are in ascending
doc_id order (nulls first, equal ids by text hash), range-partitioned by both. A shard ends with the document that
takes it to SHARD tokens or more; a document is never split. A null text is an end token alone. An empty table
gives no shards. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path
from .tokens import default_tokenizer, encoder, no_collections

MAGIC = b"WMX2"
BLOCK = 512
SHARD = 1 << 18
END = 0
#: Alphabets are counted by a table up to this id, else by sorting.
DIRECT = 1 << 22
#: For every byte and k, the place of its k-th set bit.
_PLACES = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _set = [i for i in range(8) if _b >> i & 1]
    _PLACES[_b, : len(_set)] = _set


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of Huffman codes for ascending counts, 1 at least. Trees and leaves are each taken in order, so no heap is needed."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    weights, parent = [*counts.tolist(), *[0] * (n - 1)], [0] * (2 * n - 1)
    leaf, tree = 0, n
    for made in range(n, 2 * n - 1):
        for _ in range(2):
            if leaf < n and (tree >= made or weights[leaf] <= weights[tree]):
                k, leaf = leaf, leaf + 1
            else:
                k, tree = tree, tree + 1
            weights[made] += weights[k]
            parent[k] = made
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return np.array(depth[:n])


def codes(ending: list[int]) -> list[np.ndarray]:
    """For each length, the codes that end there, in the order of the planes: the last of what is open at that depth."""
    opened, out = np.zeros(1, np.uint64), []
    for n in ending:
        opened = np.concatenate([opened * np.uint64(2), opened * np.uint64(2) + np.uint64(1)])
        out.append(opened[len(opened) - n :])
        opened = opened[: len(opened) - n]
    return out


def build(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The shard file of ids."""
    n, top = len(ids), int(ids.max(initial=0))
    if top < DIRECT:
        every = np.bincount(ids, minlength=1)
        tokens = np.flatnonzero(every)
        counts = every[tokens]
    else:
        tokens, counts = np.unique(ids, return_counts=True)
    order = np.argsort(counts, kind="stable")
    size = code_lengths(counts[order])[::-1]  # ascending now
    tokens, counts = tokens[order][::-1], counts[order][::-1]
    levels = int(size.max(initial=0))
    ending = np.bincount(size, minlength=levels + 1)[1:].tolist()
    kind = np.uint16 if levels <= 16 else np.uint32 if levels <= 32 else np.uint64
    width = 8 * kind().itemsize
    code = np.concatenate([c << np.uint64(width - k) for k, c in enumerate(codes(ending), 1)]).astype(kind) if levels else np.empty(0, kind)
    if top < DIRECT:
        table = np.zeros(top + 1, kind)
        table[tokens] = code
        x = table[ids]
    else:
        sort = np.argsort(tokens)
        x = code[sort][np.searchsorted(tokens[sort], ids)]
    planes, ranks, zeros, sizes = [], [], [], []
    done = np.r_[0, np.cumsum(ending)]
    for k in range(levels):
        ones = (x & kind(1 << (width - 1 - k))).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        packed = np.pad(packed, (0, -len(packed) % (BLOCK // 8)))
        some = np.bitwise_count(packed.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        planes.append(packed.tobytes())
        ranks.append(np.r_[np.uint32(0), np.cumsum(some, dtype=np.uint32)].astype("<u4").tobytes())
        low = np.compress(~ones, x)  # several times as fast as indexing by a mask
        zeros.append(len(low))
        sizes.append(len(x))
        x = np.concatenate([low, np.compress(ones, x)])[: len(x) - int(counts[done[k] : done[k + 1]].sum())]
    present = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = struct.pack("<4sIQQQ", MAGIC, levels, n, len(doc_ids), len(tokens)) + struct.pack(f"<{3 * levels}Q", *zeros, *sizes, *ending)
    return b"".join([head, tokens.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), present.tobytes(), names.tobytes(), np.asarray(lengths, dtype="<u8").tobytes(), *planes, *ranks])


class WaveletMatrix:
    """Reads a shard file."""

    def __init__(self, blob: bytes):
        magic, self.levels, self.n, docs, distinct = struct.unpack_from("<4sIQQQ", blob)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = 32
        numbers = struct.unpack_from(f"<{3 * self.levels}Q", blob, at)
        self.zeros, self.sizes, self.ending = numbers[: self.levels], [*numbers[self.levels : 2 * self.levels], 0], numbers[2 * self.levels :]
        at += 24 * self.levels
        #: Tokens by length of code, then in the order of the planes, and how often they occur.
        self.alphabet = np.frombuffer(blob, "<u4", distinct, at)
        self.counts = np.frombuffer(blob, "<u4", distinct, at + 4 * distinct)
        at += 8 * distinct
        present = np.frombuffer(blob, np.uint8, docs, at)
        names = np.frombuffer(blob, "<i8", docs, at + docs)
        self.doc_ids = [int(d) if p else None for d, p in zip(names, present, strict=True)]
        self.lengths = np.frombuffer(blob, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        blocks = [-(-m // BLOCK) for m in self.sizes[: self.levels]]
        self.planes, self.ranks = [], []
        for b in blocks:
            self.planes.append(np.frombuffer(blob, np.uint8, b * BLOCK // 8, at))
            at += b * BLOCK // 8
        for b in blocks:
            self.ranks.append(np.frombuffer(blob, "<u4", b + 1, at))
            at += 4 * (b + 1)
        self.of_code = codes(list(self.ending))
        self.done = np.r_[0, np.cumsum(self.ending, dtype=np.int64)].astype(np.int64)
        self._code: dict[int, tuple[int, int]] | None = None
        self._bytes: dict[int, np.ndarray] = {}
        self._none: dict[int, np.ndarray] = {}

    def _before(self, k: int) -> np.ndarray:
        """Ones of plane k before each byte; made once for many questions, from the block counts."""
        if k not in self._bytes:
            self._bytes[k] = np.r_[0, np.cumsum(np.bitwise_count(self.planes[k]), dtype=np.int64)]
        return self._bytes[k]

    def ones(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane k before each position."""
        byte = i >> 3
        some = self.planes[k][np.minimum(byte, len(self.planes[k]) - 1)]
        return self._before(k)[byte] + np.bitwise_count(some & ((1 << (i & 7)) - 1).astype(np.uint8))

    def _one(self, k: int, i: int) -> int:
        """The same for one position, from the counts before its block."""
        block = i // BLOCK
        part = self.planes[k][block * BLOCK // 8 : (i + 7) // 8]
        total = int(self.ranks[k][block]) + int(np.bitwise_count(part).sum())
        return total - (int(part[-1]) >> i % 8).bit_count() if i % 8 else total

    def bits(self, k: int, i: np.ndarray) -> np.ndarray:
        return self.planes[k][i >> 3] >> (i & 7).astype(np.uint8) & 1

    def select(self, k: int, bit: int, j: np.ndarray) -> np.ndarray:
        """Positions of the j-th (from 0) bits of that value in plane k."""
        before = self._before(k)
        if not bit:
            if k not in self._none:
                self._none[k] = 8 * np.arange(len(before)) - before
            before = self._none[k]
        byte = np.searchsorted(before, j, side="right") - 1
        some = self.planes[k][byte]
        return 8 * byte + _PLACES[some if bit else ~some, j - before[byte]]

    def code_of(self, token: int) -> tuple[int, int]:
        """Code and its length; length 0 where the token doesn't occur."""
        if self._code is None:
            self._code = {int(t): (int(c), k) for k in range(1, self.levels + 1) for t, c in zip(self.alphabet[self.done[k - 1] : self.done[k]], self.of_code[k - 1], strict=True)}
        return self._code.get(int(token), (0, 0))

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The tokens at positions."""
        i = np.asarray(positions, np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError("position beyond the sequence")
        out, at = np.zeros(len(i), np.uint32), np.arange(len(i))
        for k in range(self.levels):
            if not len(at):
                break
            bit, ones = self.bits(k, i).astype(bool), self.ones(k, i)
            i = np.where(bit, self.zeros[k] + ones, i - ones)
            ends = i >= self.sizes[k + 1]  # the code is complete: which leaf holds the place?
            if ends.any():
                a, b = self.done[k], self.done[k + 1]
                first = self.sizes[k + 1] + np.r_[0, np.cumsum(self.counts[a:b], dtype=np.int64)]
                out[at[ends]] = self.alphabet[a:b][np.searchsorted(first, i[ends], side="right") - 1]
                at, i = at[~ends], i[~ends]
        return out

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where the token's occurrences from a to b stand once its code is complete."""
        code, size = self.code_of(token)
        if not size:
            return 0, 0
        for k in range(size):
            x, y = self._one(k, a), self._one(k, b)
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if code >> (size - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of token from position a to b."""
        x, y = self._range(token, a, self.n if b is None else b)
        return y - x

    def locate(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        code, size = self.code_of(token)
        i = a + j
        for k in range(size - 1, -1, -1):
            bit = code >> (size - 1 - k) & 1
            i = int(self.select(k, bit, np.array([i - self.zeros[k] if bit else i]))[0])
        return i

    def repeats(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each stretch: its first token, how often the stretch has it, and where its second occurrence is (-1 without one): down
        the planes by rank, and up again by select."""
        first = self.access(starts)
        order = np.argsort(self.alphabet)
        leaf = order[np.searchsorted(self.alphabet[order], first)] if len(first) else np.empty(0, np.int64)
        code = np.concatenate([np.empty(0, np.uint64), *self.of_code]).astype(np.int64)[leaf]
        size = np.repeat(np.arange(1, self.levels + 1), self.ending)[leaf] if len(first) else leaf
        a, b = np.array(starts, np.int64), np.array(ends, np.int64)
        for k in range(self.levels):
            on = np.flatnonzero(size > k)
            bit, x, y = code[on] >> (size[on] - 1 - k) & 1, self.ones(k, a[on]), self.ones(k, b[on])
            a[on], b[on] = np.where(bit, self.zeros[k] + x, a[on] - x), np.where(bit, self.zeros[k] + y, b[on] - y)
        count, i = b - a, a + 1
        for k in range(self.levels - 1, -1, -1):
            on = np.flatnonzero((count > 1) & (size > k))
            bit = code[on] >> (size[on] - 1 - k) & 1
            for value in (0, 1):
                some = on[bit == value]
                i[some] = self.select(k, value, i[some] - value * self.zeros[k])
        return first, count, np.where(count > 1, i, -1)

    def tokens(self) -> np.ndarray:
        """The whole sequence: planes undone from the last to the first. What ends at a plane stands after the rest, leaf by leaf."""
        kind = np.uint16 if self.alphabet.max(initial=0) < 1 << 16 else np.uint32
        x = np.empty(0, kind)
        for k in range(self.levels - 1, -1, -1):
            a, b, size = self.done[k], self.done[k + 1], self.sizes[k]
            x = np.concatenate([x, np.repeat(self.alphabet[a:b].astype(kind), self.counts[a:b])])
            ones = np.unpackbits(self.planes[k], count=size, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~ones)] = x[: self.zeros[k]]
            y[np.flatnonzero(ones)] = x[self.zeros[k] :]
            x = y
        return x


READ = ["doc_id", "start", "n_tokens", "ids_crc32", "first_token", "first_token_count", "first_token_again"]
_FIELDS = "part int, shard int, first long, n_tokens long, file binary"


def _shards(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    part, end = TaskContext.get().partitionId(), END.to_bytes(4, "little")
    enc = encoder(path)
    shard = first = held = 0
    ids: list[bytes] = []
    lengths: list[int] = []
    names: list[int | None] = []

    def flush():
        nonlocal shard, first, held
        blob = build(np.frombuffer(b"".join(ids), "<u4"), np.array(lengths), names)
        row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], names=["part", "shard", "first", "n_tokens", "file"])
        shard, first, held = shard + 1, first + held, 0
        for x in (ids, lengths, names):
            x.clear()
        return row

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            with no_collections():
                got = enc.encode(text.as_py()) + end
            ids.append(got)
            names.append(name)
            lengths.append(len(got) // 4)
            held += lengths[-1]
            if held >= size:
                yield flush()
    if names:
        yield flush()


def write_shards(docs: DataFrame, to: str, tokenizer: str | None = None, size: int = SHARD) -> DataFrame:
    """Writes the shard files of docs under to and returns them as a table: part, shard, first (tokens of the part before), n_tokens, file."""
    path = tokenizer or default_tokenizer()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the hash parts documents of one id, too
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(lambda it: _shards(it, path, size), _FIELDS).write.option("parquet.block.size", 8 << 20).option("parquet.page.size.row.check.min", 1).parquet(to)
    return docs.sparkSession.read.schema(_FIELDS).parquet(to)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in shard files, from its whole sequence; first_token, how often the document has it
    and where it occurs again (ids after the start; null if never), by rank and select. The parts' sizes (a row for each
    partition) are gathered first."""
    parts = dict(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = {}, 0
    for part in sorted(parts):
        before[part], total = total, total + parts[part]

    def run(batches):
        encoder.cache_clear()  # a worker that wrote shards before needs its memo no more
        for batch in batches:
            for part, first, blob in zip(*(batch.column(k) for k in range(3)), strict=True):
                m = WaveletMatrix(blob.as_py())
                ids = m.tokens().astype("<u4")
                ends = np.cumsum(m.lengths)
                starts = ends - m.lengths
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                token, count, again = m.repeats(starts, ends)
                columns = [pa.array(m.doc_ids, pa.int64()), pa.array(starts + before[part.as_py()] + first.as_py()), pa.array(m.lengths), pa.array(crc, pa.int64())]
                columns += [pa.array(token.astype(np.int64)), pa.array(count), pa.array(again - starts, mask=again < 0)]
                yield pa.RecordBatch.from_arrays(columns, names=READ)

    return shards.select("part", "first", "file").mapInArrow(run, ", ".join(f"{c} long" for c in READ))


def token_files(docs: DataFrame, tokenizer: str | None = None, size: int = SHARD) -> DataFrame:
    """Shard files of docs in the shared folder, read back: see read_documents."""
    return read_documents(write_shards(docs, new_path(docs.sparkSession, "shards"), tokenizer, size))
