import numpy as np
import xxhash

from trailforge.llm import simhash as S
from trailforge.llm.components import components, contracted, stars


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return S._signed(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))


def grouped(pairs, alone=()):
    up = {x: x for x in alone}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    out = {}
    for x in list(up):
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def near(fps):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]


def test_fingerprint():
    for t in (None, "", " \n", "a", "A b c d", "a b c d e a b c d e", "é Ü x y z w", "x " * 500):
        assert S.fingerprint(t) == slow_fingerprint(t)


def clusters():
    rng = np.random.default_rng(3)
    fps = [int(rng.integers(0, 1 << 64, dtype=np.uint64)) for _ in range(40)]
    for x in list(fps):
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.append(x)
    return sorted({S._signed(x) for x in fps})


def test_tables_discard_pairs_and_lose_none():
    fps = clusters()
    f = np.array(fps, np.int64).view(np.uint64)[:, None]
    table = S.distance_table(f, S.references())
    assert table.tolist() == [[(x ^ int(r[0]) & (1 << 64) - 1).bit_count() if x >= 0 else ((x + (1 << 64)) ^ int(r[0])).bit_count() for r in S.references()] for x in fps]
    candidates = survived = linked = 0
    for i in range(len(fps)):
        keep = S.survivors(table[:i], table[i], 4)
        near_by = np.flatnonzero(np.bitwise_count(f[:i] ^ f[i])[:, 0] <= 4)
        assert set(near_by) <= set(keep)
        assert np.flatnonzero(S.close_pairs(f[:i], np.repeat(f[i : i + 1], i, axis=0), table[:i], np.repeat(table[i : i + 1], i, axis=0), 4)).tolist() == near_by.tolist()
        candidates, survived, linked = candidates + i, survived + len(keep), linked + len(near_by)
    assert 0 < linked <= survived < 0.05 * candidates


def test_keys_and_blocks_keep_every_link(spark):
    fps = clusters()
    want = grouped(near(fps))
    nodes = S.with_table(spark.createDataFrame([(x, x) for x in fps], "node long, f0 long"), 1)
    for block, n in ((20_000, 1), (20_000, 10**7), (9, 1)):  # nine nodes of a key are many: blocks
        masks = np.array(S.coordinate_groups(n, 4), np.uint64)[:, None]
        for grow in (S.forest, S.shortest_forest):
            assert grouped((r.u, r.v) for r in S.links(nodes, 1, masks, 4, block, grow).collect()) == want
    none = np.zeros((1, 1), np.uint64)  # one key for all
    assert grouped((r.u, r.v) for r in S.links(nodes, 1, none, 4, 50).collect()) == want


def test_shortest_forest_takes_the_shortest_edges():
    rng = np.random.default_rng(5)
    f = rng.integers(0, 1 << 64, (60, 2), dtype=np.uint64) & rng.integers(0, 1 << 64, (60, 2), dtype=np.uint64)
    table, d = S.distance_table(f, S.references(2)), np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
    for radius in (20, 40, 128):
        u, v = S.shortest_forest(f, table, radius)
        up, total = {}, []

        def find(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for x, i, j in sorted((int(d[i, j]), i, j) for i in range(60) for j in range(i) if d[i, j] <= radius):
            if find(i) != find(j):
                up[find(i)] = find(j)
                total.append(x)
        assert sorted(d[u, v].tolist()) == total


def words5(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(texts):
    """Pairs of keys whose texts have five-word shingles with a Jaccard similarity of 0.8 or more."""
    sets = {k: words5(t) for k, t in texts.items()}
    keys = list(sets)
    return [(a, b) for n, a in enumerate(keys) for b in keys[:n] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_near_copies_of_texts(spark):
    import random

    rng = random.Random(9)
    texts = {}
    for k in range(25):
        base = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(rng.randint(60, 500))]
        texts[len(texts)] = " ".join(base)
        for share in (0, 0.004, 0.01, 0.02, 0.03, 0.05, 0.2):  # words changed
            texts[len(texts)] = " ".join(f"new{rng.randint(0, 999)}" if rng.random() < share else w for w in base)
    pairs = alike(texts)
    groups = grouped(pairs, texts)
    docs = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, n long")
    kept = {r.doc_id for r in S.drop_near_duplicates(docs).collect()}
    first = {min(g) for g in groups}
    assert first <= kept  # nothing below the threshold is taken for a copy
    linked = sum(len(g) - 1 for g in groups)
    assert linked > 80 and len(kept - first) <= 0.02 * linked, (len(kept - first), linked)


def test_equal_rows_leave_one_and_always_the_same(spark):
    rows = [(1, "a b c", "z", 1), (1, "a b c", "y", 2), (1, "a b c", "y", 1), (None, "a b c", "x", 0), (1, "d", "x", 0), (2, None, "q", 0), (3, "", "q", 0), (None, "e f", "q", 5), (None, "e f", "q", 4)]
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, s string, n int").repartition(n)
        got = sorted(map(tuple, S.drop_near_duplicates(docs).collect()), key=repr)
        assert got == [(1, "a b c", "y", 1), (1, "d", "x", 0), (2, None, "q", 0), (None, "e f", "q", 4)]


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100), (300, 301)]
    got = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    want = {x: min(g) for g in grouped(pairs) for x in g if x != min(g)}
    assert {r.node: r.root for r in got} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


TEXTS = [None, "", "one two three four five six", "one two three four five six", " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(399)) + " other", "x", "y z"]


def test_query_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "fp") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "fp"), (None, "x", "")], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()}
    prints = {i: slow_fingerprint(t) for i, t in enumerate(TEXTS)}
    first = {x: min(i for i in prints if prints[i] in g) for g in grouped(near(sorted(set(prints.values()))), prints.values()) for x in g}
    want = {(i, f"{f & (1 << 64) - 1:016x}", first[f]) for i, f in prints.items()}
    x = slow_fingerprint("x")
    assert got == want | {(None, f"{x & (1 << 64) - 1:016x}", first[x])}
    assert S.simhash_components(docs.limit(0)).count() == 0 and S.drop_near_duplicates(docs.limit(0)).count() == 0


def test_links_that_the_forest_leaves_out_are_found(spark):
    rng = np.random.default_rng(4)
    f = rng.integers(0, 1 << 64, (1, 2), dtype=np.uint64).repeat(12, axis=0)
    f[1:, 0] ^= np.uint64(1) << np.arange(11, dtype=np.uint64)  # all within two bits: the forest is a star around the first
    nodes = S.with_table(spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(f.view(np.int64))], "node long, f0 long, f1 long"), 2)
    found = S.links(nodes, 2, np.zeros((1, 2), np.uint64), 20, grow=S.shortest_forest)
    assert {min(r.u, r.v) for r in found.collect()} == {0}
    common, other = np.arange(100, dtype="<u8"), np.arange(1000, 1100, dtype="<u8")  # the first is like none, the rest are like each other by twos
    texts = [other, *(np.sort(np.r_[common[:60] + 200 * (k // 2), 10**6 + k]).astype("<u8") for k in range(11))]
    sets = spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(texts)], "node long, set binary")
    same = S.similar_texts(sets, found, 0.8)
    assert same.count() == 0
    want = grouped([(k, j) for k in range(12) for j in range(k) if S.similarity_of(texts[k], texts[j]) >= 0.8])
    assert len(want) == 5
    for block in (20_000, 4):
        assert grouped((r.u, r.v) for r in S.missed_links(nodes, sets, found, same, 20, 0.8, block).collect()) == want


def test_stars_keep_components(spark):
    rng = np.random.default_rng(6)
    for n, m in ((1, 3), (50, 30), (200, 150), (200, 2000)):
        u, v = rng.integers(0, n, (2, m))
        a, b = stars(u, v)
        assert grouped(zip(a.tolist(), b.tolist(), strict=True)) == [g for g in grouped(zip(u.tolist(), v.tolist(), strict=True)) if len(g) > 1]
    chain = np.arange(500)[::-1]
    assert stars(chain[:-1], chain[1:])[0].tolist() == [0] * 499 and len(stars(chain[:0], chain[:0])[0]) == 0
    many = spark.createDataFrame([(k, k + 1 + j) for k in range(99) for j in range(2)], "u long, v long")
    assert contracted(many.coalesce(1)).distinct().count() == 100
