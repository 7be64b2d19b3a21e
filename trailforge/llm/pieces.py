"""SentencePiece encoding with the N best segmentations, and decoding.

The piece lattice of a text has a node for every position and an edge for every piece of the model that stands there,
weighted by the model's score; a character that is no piece is an edge of byte pieces, PENALTY below the lowest score of a piece
(runs of marks, which the model scores as hardly ever to be used, aside). The
best segmentations are those with the largest sums. Forward Viterbi scores are exact bounds on what a hypothesis can
still get, so backward A-star search pops complete segmentations in order of their scores.

Pieces have a word mark after their first character only where they are runs of marks, and no line end, so the lattice falls
apart before every run of marks and around every line end, and wherever two
characters stand next to each other in no piece. A chunk between such cuts is solved once per process and remembered. The N best of the text differ from its best
only in the N - 1 chunks whose second best costs least, so A-star runs over these, and their lists are merged in
order of the sums.

A null or empty text has no pieces and one segmentation, of score 0. Long texts cost time in proportion. Equal scores may
come in any order, always the same; repeated rows have equal results; an empty table gives an empty table; only
doc_id and text are read.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from bisect import insort
from functools import cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

from .common import field, with_columns

MARK = "▁"
PENALTY = 10.0
BEST = 4
#: Chunks remembered by each Python worker before the memo starts anew.
MEMO = 800_000
_CHUNK = re.compile(rf"\n|{MARK}*+[^{MARK}\n]++|{MARK}++")
#: Where no piece joins a Latin letter to a point or comma, words stand apart from these, too.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf"\n|{MARK}*+[{_LATIN}]++(?=[.,])|{MARK}*+[^{MARK}\n]++|{MARK}++")
_JOINED = re.compile(f"[{_LATIN}][.,]")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Encoder, decoder and memo over one model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[float, int]] = {}
        self.written: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.written.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                self.written.append(b"")
            else:
                self.written.append(piece.replace(MARK, " ").encode())
                if "\n" in piece or MARK in piece[1:] and piece.strip(MARK):
                    raise ValueError(f"piece {piece!r} would stand across the cuts between chunks")
                self.scores[piece] = (m.get_score(i), i)
        #: A piece's score, or None for what is only the start of longer pieces.
        self.starts: dict[str, float | None] = {x[:k]: None for x in self.scores for k in range(1, len(x))}
        self.starts |= {x: s for x, (s, _) in self.scores.items()}
        self.coded = {x: i.to_bytes(4, "little") for x, (_, i) in self.scores.items()}
        self.lowest = min(s for x, (s, _) in self.scores.items() if len(x) == 1 or x.strip(MARK)) - PENALTY
        #: Characters that stand next to each other in a piece; a lattice falls apart between any others.
        self.pairs = {x[k : k + 2] for x in self.scores for k in range(len(x) - 1)}
        self.chunk = _CHUNK if any(map(_JOINED.match, self.pairs)) else _WORD
        self.memo: dict[str, int] = {}
        self.parts: dict[str, tuple[float, float, bytes]] = {}
        self.forget()

    def forget(self) -> None:
        self.memo.clear()
        self.parts.clear()
        self.ids: list[bytes] = []
        #: For every remembered chunk its best score, what its second best lacks, and whether its ids decode to it.
        self.best, self.gap, self.same = np.zeros(1024), np.zeros(1024), np.zeros(1024, bool)
        self.several: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def edges(self, chunk: str) -> list[list[tuple[int, float]]]:
        """For every end, the (start, score) of pieces; unknown characters where no piece is one character long."""
        n, starts = len(chunk), self.starts
        into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                if (part := chunk[i:j]) not in starts:
                    break
                if (s := starts[part]) is not None:
                    into[j].append((i, s))
            if starts.get(chunk[i]) is None:
                into[i + 1].append((i, self.lowest))
        return into

    @staticmethod
    def forward(into: list[list[tuple[int, float]]]) -> tuple[list[float], list[int]]:
        """Viterbi: the best score up to every position, and the start of its last piece."""
        alpha, back = [0.0] * len(into), [0] * len(into)
        for j in range(1, len(into)):
            top = -np.inf
            for i, s in into[j]:
                if alpha[i] + s > top:
                    top, back[j] = alpha[i] + s, i
            alpha[j] = top
        return alpha, back

    def cuts_to_ids(self, chunk: str, cuts: list[int]) -> bytes:
        coded = self.coded
        parts = [chunk[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return b"".join([coded[x] if x in coded else self._bytes(x) for x in parts])

    def _bytes(self, x: str) -> bytes:
        return b"".join([self.byte_ids[b].to_bytes(4, "little") for b in x.encode("utf-8", "surrogatepass")])

    def solve(self, chunk: str) -> int:
        """Remembers the chunk's best score, ids, and how much less its second best has (infinite without one); all of
        these from its parts between characters that no piece joins."""
        pairs, parts = self.pairs, self.parts
        found, a = [], 0
        for k in range(1, len(chunk) + 1):
            if k == len(chunk) or chunk[k - 1 : k + 1] not in pairs:
                part = chunk[a:k]
                found.append(parts[part] if part in parts else self.solve_part(part))
                a = k
        if len(found) == 1:
            best, gap, ids = found[0]
        else:
            scores, gaps, ids_of = zip(*found, strict=True)
            best, gap, ids = sum(scores), min(gaps), b"".join(ids_of)
        k = self.memo[chunk] = len(self.ids)
        self.ids.append(ids)
        if k == len(self.best):
            self.best, self.gap, self.same = (np.concatenate([x, np.zeros_like(x)]) for x in (self.best, self.gap, self.same))
        self.best[k], self.gap[k] = best, gap
        self.same[k] = b"".join([self.written[i] for i in array("I", ids)]) == chunk.replace(MARK, " ").encode("utf-8", "surrogatepass")
        return k

    def solve_part(self, part: str) -> tuple[float, float, bytes]:
        """Score, gap and ids of a part: the two best scores up to every position, in one forward pass."""
        n, starts = len(part), self.starts
        one, two, back = [-np.inf] * (n + 1), [-np.inf] * (n + 1), [0] * (n + 1)
        one[0] = 0.0
        for i in range(n):
            x, y = one[i], two[i]
            for j in range(i + 1, n + 1):
                if (piece := part[i:j]) not in starts:
                    if j > i + 1:
                        break
                    s = None
                else:
                    s = starts[piece]
                if s is None:
                    if j > i + 1:
                        continue
                    s = self.lowest
                v = x + s
                if v > one[j]:
                    two[j] = max(one[j], y + s)
                    one[j], back[j] = v, i
                elif v > two[j]:
                    two[j] = v
        at, cuts = n, [n]
        while at:
            at = back[at]
            cuts.append(at)
        found = self.parts[part] = (one[n], one[n] - two[n], self.cuts_to_ids(part, cuts[::-1]))
        return found

    def astar(self, chunk: str, count: int) -> list[tuple[float, bytes]]:
        """The count best (score, ids) of a chunk, backward from its end. Open hypotheses stand for separate segmentations and
        their bounds are reached, so no more of them are held than segmentations are still wanted."""
        into = self.edges(chunk)
        alpha, _ = self.forward(into)
        opened: list[tuple] = [(-alpha[-1], 0, len(chunk), 0.0, None)]  # in the order of their bounds
        made, out = 0, []
        while opened and len(out) < count:
            _, _, at, so_far, path = opened.pop(0)
            if not at:
                cuts = [0]
                while path:
                    cuts.append(path[0])
                    path = path[1]
                out.append((so_far, self.cuts_to_ids(chunk, cuts)))
                continue
            wanted = count - len(out)
            for i, s in into[at]:
                bound = -(so_far + s + alpha[i])
                if len(opened) < wanted or bound < opened[wanted - 1][0]:
                    made += 1
                    insort(opened, (bound, made, i, so_far + s, (at, path)))
            del opened[wanted:]
        return out

    def _chunks(self, text: str) -> tuple[list[str], list[int]]:
        chunks = self.chunk.findall(MARK + text.replace(" ", MARK))
        if len(self.ids) > MEMO:
            self.forget()
        memo = self.memo
        at = list(map(memo.get, chunks))
        if None in at:
            at = [memo[c] if c in memo else self.solve(c) for c in chunks]
        return chunks, at

    def _several(self, chunk: str, count: int) -> list[tuple[float, bytes]]:
        found = self.several.get((chunk, count))
        if found is None:
            found = self.several[chunk, count] = self.astar(chunk, count)
        return found

    def encode(self, text: str | None, count: int = BEST) -> list[tuple[float, bytes]]:
        """The count best (score, ids as bytes of little-endian unsigned 32-bit integers) of a whole text."""
        return self.round_trip(text, count)[0]

    def round_trip(self, text: str | None, count: int = BEST) -> tuple[list[tuple[float, bytes]], bool]:
        """encode(), and whether the best ids, decoded chunk by chunk, are the text again."""
        if not text:
            return [(0.0, b"")], True
        chunks, at = self._chunks(text)
        where = np.array(at)
        total = float(self.best[where].sum())
        parts = list(map(self.ids.__getitem__, at))
        gaps = self.gap[where]
        same = MARK not in text and bool(self.same[where].all())
        cheap = np.arange(len(at)) if len(at) < count else np.argpartition(gaps, count - 2)[: count - 1] if count > 1 else []
        lists = [(k, found) for k in sorted(map(int, cheap)) if len(found := self._several(chunks[k], count)) > 1]
        heap: list[tuple] = [(-total, (0,) * len(lists))]
        seen, out = {heap[0][1]}, []
        while heap and len(out) < count:
            cost, ranks = heappop(heap)
            made = parts[:]
            for (k, found), r in zip(lists, ranks, strict=True):
                made[k] = found[r][1] if r else made[k]
            out.append((-cost, b"".join(made)))
            for x, (_, found) in enumerate(lists):
                r = ranks[x] + 1
                step = (*ranks[:x], r, *ranks[x + 1 :])
                if r < len(found) and step not in seen:
                    seen.add(step)
                    heappush(heap, (cost + found[r - 1][0] - found[r][0], step))
        return out, same

    def decode(self, ids: bytes) -> str:
        """The text of ids: marks are spaces, the first of which goes; byte pieces join to characters."""
        raw = b"".join(map(self.written.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@cache
def lattice(path: str) -> Lattice:
    """One for each process."""
    return Lattice(path)


def encode_documents(docs: DataFrame, model: str | None = None, count: int = BEST, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (best segmentation), n_pieces, ids_crc32, score, nbest_scores, nbest_crc32 and decoded_equal of every document."""
    path = model or default_model()

    def run(_, texts):
        gc.disable()  # nothing here makes cycles, and collections would walk the memo again and again
        lat, rows = lattice(path), []
        for text in texts.to_pylist():
            best, again = lat.round_trip(text, count)
            ids = best[0][1]
            row = (len(ids) // 4, zlib.crc32(ids), best[0][0], [s for s, _ in best], [zlib.crc32(x) for _, x in best], again)
            rows.append((*row, np.frombuffer(ids, "<u4").tolist()) if keep_ids else row)
        gc.enable()
        return list(zip(*rows, strict=True)) or [[]] * (6 + keep_ids)

    fields = [field("n_pieces", "long"), field("ids_crc32", "long"), field("score", "double"), field("nbest_scores", "array<double>"), field("nbest_crc32", "array<long>"), field("decoded_equal", "boolean")]
    if keep_ids:
        fields.append(field("ids", "array<long>"))
    return with_columns(docs.select("doc_id", "text"), run, ["doc_id", "text"], fields).drop("text")
