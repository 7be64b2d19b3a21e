import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailforge.llm import pieces as P

LAT = P.lattice(P.default_model())


@cache
def every(text):
    """All segmentations of a marked text as (score, ids), by recursion."""
    if not text:
        return [(0.0, ())]
    out, single = [], False
    for n in range(1, len(text) + 1):
        if text[:n] in LAT.scores:
            single = single or n == 1
            s, i = LAT.scores[text[:n]]
            out += [(s + x, (i, *y)) for x, y in every(text[n:])]
    if not single:
        out += [(LAT.lowest + x, (*(LAT.byte_ids[b] for b in text[0].encode()), *y)) for x, y in every(text[1:])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "er", " ", "\n", "a", "in", "é", "中", "\U0001f600", "x", "  "]), max_size=6).map("".join), st.integers(1, 6))
def test_nbest_against_all_segmentations(text, count):
    got = LAT.encode(text, count)
    marked = P.MARK + text.replace(" ", P.MARK) if text else ""
    want = sorted(every(marked), reverse=True)[:count]
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want], rel=1e-12)
    found = [tuple(np.frombuffer(b, "<u4").tolist()) for _, b in got]
    scores = {ids: s for s, ids in every(marked)}
    assert len(set(found)) == len(found) and [scores[f] for f in found] == pytest.approx([s for s, _ in got], rel=1e-12)
    assert all(LAT.decode(b) == text for _, b in got)


def test_runs_of_marks():
    assert len(every(P.MARK * 3)) == 4  # with the mark in front: two spaces
    got = LAT.encode("  ", 9)
    assert len(got) == 4 and {tuple(np.frombuffer(b, "<u4").tolist()) for _, b in got} == {ids for _, ids in every(P.MARK * 3)}
    assert all(LAT.decode(b) == "a  b   c" for _, b in LAT.encode("a  b   c", 8))
    text = "x" + " " * 20_000 + "y"
    assert [LAT.decode(b) for _, b in LAT.encode(text)] == [text] * 4


def test_memo_starts_anew(monkeypatch):
    text = "many different words here, and some more\nof them"
    want = LAT.encode(text)
    monkeypatch.setattr(P, "MEMO", 2)
    assert LAT.encode(text) == want == LAT.encode(text)


def test_library_decodes_the_same():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    for text in ("Hello  world\nfoo\tbar é 中", " lead and trail ", "\U0001f600"):
        for ids in (LAT.encode(text)[0][1], np.array(m.encode(text), "<u4").tobytes()):
            assert m.decode(np.frombuffer(ids, "<u4").tolist()) == text == LAT.decode(ids)


def test_tables(spark):
    texts = [None, "", "a b", "word " * 4000, "ends. Here, and\nthere:  é!", "x" * 30_000, "a b"]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in P.encode_documents(docs).collect()}
    for i, t in enumerate(texts):
        best = LAT.encode(t)
        assert got[i].ids == np.frombuffer(best[0][1], "<u4").tolist() and got[i].nbest_crc32 == [zlib.crc32(b) for _, b in best]
        assert got[i].decoded_equal and got[i].score == pytest.approx(got[i].nbest_scores[0]) and got[i].n_pieces == len(got[i].ids)
    assert P.encode_documents(docs.limit(0)).count() == 0
