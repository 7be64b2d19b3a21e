import zlib

import numpy as np
import pytest

from trailforge.llm import classifier as C


def test_gradients_are_slopes():
    net = C.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    docs = [C.chunks_of("abc def " * n + "xyz" * k) for n, k in ((1, 2), (40, 3), (90, 70))]
    rows, starts, y = np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])[:-1]], np.array([1.0, 0.0, 1.0])
    loss, g = net.gradients(rows, starts, y)
    rng = np.random.default_rng(0)
    for name, part in g.items():
        flat, d = net.p[name].ravel(), np.asarray(part).ravel()
        for i in rng.choice(np.flatnonzero(np.abs(d) > 1e-4), 3):
            old, eps = flat[i], 1e-5
            flat[i] = old + eps
            up = net.gradients(rows, starts, y)[0]
            flat[i] = old - eps
            down = net.gradients(rows, starts, y)[0]
            flat[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(d[i], rel=0.05, abs=2e-5), name


def plain_score(net, text):
    """The network by its definition, window by window."""
    raw = (text or "").encode()
    n = max(1, -(-len(raw) // C.CHUNK))
    data = raw + bytes(n * C.CHUNK + C.WIDTH - len(raw))
    chunks = []
    for c in range(n):
        best = [-float("inf")] * C.FILTERS
        for at in range(c * C.CHUNK, (c + 1) * C.CHUNK, C.STRIDE):
            for f in range(C.FILTERS):
                best[f] = max(best[f], sum(float(net.p["tables"][w][data[at + w]][f]) for w in range(C.WIDTH)))
        chunks.append([max(0.0, b + float(net.p["bias"][f])) for f, b in enumerate(best)])
    means = [sum(c[f] for c in chunks) / n for f in range(C.FILTERS)]
    tops = [max(c[f] for c in chunks) for f in range(C.FILTERS)]
    spreads = [(max(0.0, sum(c[f] ** 2 for c in chunks) / n - means[f] ** 2) + 1e-4) ** 0.5 for f in range(C.FILTERS)]
    x = [(v - c) / s for v, c, s in zip([*means, *tops, *spreads], net.center.tolist(), net.scale.tolist(), strict=True)]
    h = [np.tanh(sum(x[i] * float(net.p["w1"][i][j]) for i in range(len(x))) + float(net.p["b1"][j])) for j in range(C.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(a * float(b) for a, b in zip(h, net.p["w2"], strict=True)) + float(net.p["b2"][0]))))


def test_score_against_the_definition():
    net = C.train(["abc def " * 30, "#!" * 90, "some words here", None], [1, 0, 1, 0], passes=3)
    for text in (None, "", "é", "x" * 127 + "#", "word and word " * 25, "#" * 300):
        assert net.score(text) == pytest.approx(plain_score(net, text), rel=1e-3, abs=1e-5)


def test_sample_bounds_and_long_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (200_000 if i % 5 == 0 else 10)) for i in range(1, 41)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, quality int")
    free = sum(not C.held_out(i) for i in range(1, 41)) + (not C.held_out(3))
    rows = C.training_rows(docs, labels)
    assert len(rows) == free and any(len(t or "") == 200_000 for t, _ in rows)  # length alone keeps no row out
    few = C.training_rows(docs, labels, size=250_000)
    sizes = [len(t or "") for t, _ in few]
    assert few == rows[: len(few)] and sum(sizes) >= 250_000 > sum(sizes[:-1]) and len(C.training_rows(docs, labels, sample=4)) == 4
    whole = C.train(*zip(*few, strict=True), passes=2)
    monkeypatch.setattr(C, "AT_ONCE", 1000)
    parts = C.train(*zip(*few, strict=True), passes=2)
    assert whole.score("x y z") == pytest.approx(parts.score("x y z"), rel=1e-3)


def test_slices_cover_whole_texts(monkeypatch):
    net = C.Network()
    texts = [None, "", "é", "word " * 3000, "x" * 127 + "#", "y" * 200_000]
    whole = [net.score(t) for t in texts]
    monkeypatch.setattr(C, "SLICE", 7)
    assert [net.score(t) for t in texts] == pytest.approx(whole)
    late = "word " * 3000
    m = C.pooled(C.chunks_of(late + "@@@@@@"), net.p["tables"])
    assert len(m) == -(-len(late + "@@@@@@") // C.CHUNK) and not np.allclose(m[-1], C.pooled(C.chunks_of(late), net.p["tables"])[-1])


@pytest.mark.parametrize(("sf", "least"), [("/root/testdata/sf0.01", 0.85), ("/root/testdata/sf0.1", 0.97)])
def test_held_out_accuracy(spark, sf, least):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = C.classify(docs.withColumn("score", docs.doc_id), labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in got.collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = sum(r.predicted == truth[r.doc_id] for r in rows)
    assert right >= least * len(rows) and len(rows) > 50, (right, len(rows))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "a"), (1, ""), (7, "b" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (7, None), (None, 1), (1, 1), (7, 1)], "doc_id long, quality int")
    assert C.classify(docs, labels).count() == 4
    assert {r.score for r in C.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert C.classify(docs.limit(0), labels).count() == 0
