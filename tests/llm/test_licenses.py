import re
from math import ceil

from trailforge.llm import licenses as L


def words(text):
    return [w for w in re.split(L._GAP, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def slow(text):
    w = words(text)
    places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = {label for _, label in places}
    met = {}
    for name, t in L.TEMPLATES.items():
        reach, t = L.block_words(t), set(t.split())
        for a in range(len(w)):
            n = len(t & set(w[a : a + reach]))
            if n >= ceil(L.THRESHOLD * len(t) - 1e-9):
                met[name] = max(met.get(name, 0), n / len(t))
    at = [i for i, _ in places]
    score = 1.0 if places else max(met.values(), default=0.0)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | met.keys())), score)


def wrapped(text, between):
    w = text.split()
    return between.join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4))


def test_line_ends_make_no_difference(spark):
    texts = [x for t in L.TEMPLATES.values() for x in (t, wrapped(t, "\n"), wrapped(t, "\n# "))]
    got = {r.doc_id: (r.labels, r.score) for r in L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[k] == got[k + 1] == got[k + 2] and got[k][1] == 1.0 for k in range(0, len(texts), 3))


def test_scan_against_brute_force(spark):
    gpl = L.TEMPLATES["gpl-3"]
    texts = [
        None, "", "\n", "Released UNDER the MIT License.", "under the mit licenses", "x cc-by-nc y; CC BY NC cc by nc",
        "Apache License, Version 2.0\nlicensed under", "Licensed under the\nApache License, Version 2.0", gpl, " ".join(reversed(gpl.split())),
        gpl.replace("gnu", "new"), gpl.replace("gnu general", ""), gpl + " " + "filler " * 30_000, "all rights reserved, no rights reserved", "reserved all",
        L.TEMPLATES["mit-grant"].replace("charge", "cost") + " and the rest", "ünder the mit license K cc by nc", "the of and to " * 50,
    ]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (None, texts[5], "s", 1)], "doc_id long, text string, th string, b int")
    got = L.license_scan(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert tuple(r)[1:] == slow(texts[5 if r.doc_id is None else r.doc_id]), r
    assert L.license_scan(docs.limit(0)).count() == 0


def test_every_block_at_low_thresholds(spark):
    import random

    rng = random.Random(2)
    names = {f"t{k}": " ".join(rng.sample("abcdefghij", rng.randint(1, 7))) for k in range(6)}
    texts = ["\n".join(" ".join(rng.choices("abcdefghijxyz", k=rng.randint(0, 9))) for _ in range(4)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.3, 0.6, 1.0):
        want = set()
        for i, text in enumerate(texts):
            w = text.split()
            for name, t in names.items():
                t, reach = set(t.split()), L.block_words(t)
                for a in range(len(w)):
                    n = len(set(w[a : a + reach]) & t)
                    if w[a] in t and n >= ceil(threshold * len(t) - 1e-9):
                        want.add((i, a, name, n / len(t)))
        got = [(r.doc_id, r.block, r.template, r.containment) for r in L.template_blocks(docs, names, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want, threshold
