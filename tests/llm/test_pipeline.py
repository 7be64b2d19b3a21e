"""The pipeline against a plain version of every stage, and the corpus queries against their SQL."""

import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_rows import slow_counts, slow_dedup
from tests.llm.test_simhash import alike, grouped
from tests.llm.test_tokens_packing import ids_of
from trailforge.llm import pii, registry
from trailforge.llm.common import materialize

SF = "/root/testdata/sf0.001"


def slow_quality(docs):
    """Ids that stay; valid where no host is strict, which the test asserts."""
    fails, by = {}, {}
    for i, (text, source) in docs.items():
        n, _, symbols, lines, dup, rep = slow_counts(text)
        fails[i] = n < 50 or 100 * rep > 50 * n or 100 * symbols > 10 * n or 100 * dup > 30 * lines
        by.setdefault(source, []).append(fails[i])
    rates = [sum(x) / len(x) for x in by.values()]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / (len(rates) - 1)
    s = m * (1 - m) / v - 1
    assert all((sum(x) + m * s) / (len(x) + s) <= 0.5 for x in by.values())
    return [i for i in docs if not fails[i]]


def test_stages_against_plain_versions(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = source
    now = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "pii", "packing"]
    made = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "plain")
        made.append((name, docs))
        rows = docs.collect()
        if name == "quality rules":
            want = {i: now[i] for i in slow_quality(now)}
        elif name == "line dedup":
            order = sorted(now)
            slow = slow_dedup([now[i][0] for i in order])
            want = {i: (slow[k][2], now[i][1]) for k, i in enumerate(order) if not 0 < slow[k][1] == slow[k][0]}
        elif name == "near duplicates":
            groups = grouped(alike({i: t for i, (t, _) in now.items()}), now)
            want = {min(g): now[min(g)] for g in groups}
        elif name == "pii":
            w = pii.weights()
            want = {i: (pii.redact(t, pii.find(t, w)[1]), s) for i, (t, s) in now.items()}
        else:
            break
        assert docs.columns == source.columns
        assert {r.doc_id: (r.text, r.source) for r in rows} == want, name
        assert all(r.n_chars == len(r.text) for r in rows if now[r.doc_id][0] != r.text)
        assert 0 < len(want) <= len(now)
        now = want
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        b = ids_of(now[r.doc_id][0], 1)
        assert r.start == whole.get(r.doc_id, 0) and r.doc_tokens == len(b) // 4
        assert zlib.crc32(b[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        whole[r.doc_id] = r.start + r.length
    assert whole == {i: len(ids_of(t, 1)) // 4 for i, (t, _) in now.items()}
    final = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, final.collect())) == sorted(map(key, rows))


def test_stages_take_odd_tables(spark):
    from pyspark.sql import functions as F

    words = " ".join(f"word{k}" for k in range(80))
    long = " ".join(f"item{k % 5000}x{k // 5000}" for k in range(150_000)) + "\npassword=hunter2"
    rows = [
        (1, words, "en", "a.b", 5), (1, words, "en", "a.b", 5), (2, words + " more", None, None, None), (None, words.replace("word", "name"), "de", "c", 1), (None, words.replace("word", "name"), "de", "c", 1),
        (3, None, None, None, None), (4, "", "en", "a.b", 0), (5, " \n\t", "en", "a.b", 3), (6, long, "en", "c", len(long)), (7, "mail a@b.co " + words.replace("word", "term"), "fr", None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("a.b", "host", "strict", "rest", "__gone", "none", "id", "th", "node", "class", "start", "length"))))
    empty = docs.limit(0)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs, empty = materialize(stage(spark, docs, SF), "odd"), stage(spark, empty, SF)
        assert empty.collect() == []
        if name != "packing":
            got = docs.collect()
            assert docs.columns == empty.columns == columns and all(tuple(r)[5:] == tuple(range(12)) for r in got)
            kept[name] = sorted((-1 if r.doc_id is None else r.doc_id) for r in got)
    assert kept["quality rules"] == [-1, -1, 1, 1, 2, 6, 7]
    assert kept["line dedup"] == [-1, -1, 1, 1, 2, 6, 7]  # equal rows are one document, and the longer one is another line
    assert kept["near duplicates"] == kept["pii"] == [-1, 1, 6, 7]
    found = {r.doc_id for r in docs.collect()}
    assert found == {None, 1, 6, 7}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    made = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(made.columns)
    order = [made.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[k] for k in order)) for r in made.fetchall())


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 11)]
