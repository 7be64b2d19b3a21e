"""Quality rules, per document and per host.

Rules count failures of every document; failures are added up by host (the source column), host rates are
shrunk by a beta prior fitted to all hosts by the method of moments, and the verdict goes back to
the documents: on a host whose shrunk rate is above `max_rate`, documents are held to half the limits.

A null text has no words and fails; a null source is a host of its own; repeated rows are each judged
and each counted; an empty table gives an empty table. Only doc_id, text and source are read, other columns
pass through `filter_documents` untouched.
"""

from __future__ import annotations

from collections import Counter
from itertools import compress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, materialize, named, with_columns

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Hosts of which a table may be broadcast; above, the join is by shuffle.
BROADCAST_HOSTS = 50_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * 6
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split cuts at exactly the six ASCII spaces
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    flags = bytearray(len(words))
    for i in compress(range(len(windows)), (often[w] > 1 for w in windows)):
        flags[i] = flags[i + 1] = flags[i + 2] = 1
    return sum(flags)


def with_counts(docs: DataFrame) -> DataFrame:
    return with_columns(docs, lambda texts: list(zip(*map(measure, texts.to_pylist()), strict=True)) or [[]] * 6, ["text"], [field(c, "long") for c in COUNTS])


def _failures(share: float) -> F.Column:
    """Fails a rule, with the limits that base rules do not fix times share."""
    n, lines = F.col("n_words"), F.col("n_lines")
    return (
        (100 * F.col("n_repeat_words") > int(50 * share) * n)
        | (100 * F.col("n_symbols") > int(10 * share) * n)
        | (100 * F.col("n_dup_lines") > int(30 * share) * lines)
    )


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fails() -> F.Column:
    return base_failed() | _failures(1)


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n, failed, rate: per host the shrunk rate of documents that fail a rule (columns source and fails)."""
    hosts = judged.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("fails").cast("long")).alias("failed"))
    hosts = materialize(hosts, "hosts")
    raw = F.col("failed") / F.col("n")
    one = hosts.agg(F.count("*").alias("k"), F.avg(raw).alias("m"), F.var_samp(raw).alias("v")).first()
    a, b = beta_prior(one.k, one.m, one.v)
    return hosts.withColumn("rate", (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b)))


def beta_prior(k: int, mean: float | None, var: float | None) -> tuple[float, float]:
    """Method of moments; a flat prior where the hosts' rates have no spread that a beta can have."""
    if not k or not var or not 0 < mean < 1 or var >= mean * (1 - mean):
        return 1.0, 1.0
    s = mean * (1 - mean) / var - 1
    return mean * s, (1 - mean) * s


def _with_strict(judged: DataFrame, max_rate: float) -> DataFrame:
    """judged (columns source, fails and others) and strict: whether the host's rate is above max_rate. Strict hosts are
    joined: broadcast where they are counted and few, else by shuffle."""
    strict = host_rates(judged).where(F.col("rate") > max_rate).select("host", F.lit(True).alias("strict"))
    few = strict.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = judged.join(F.broadcast(strict) if few else strict, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.withColumn("strict", F.coalesce("strict", F.lit(False))).drop("host")


def quality_rules(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """doc_id, COUNTS but n_lines, base_failed, kept, n_lines and source of every document."""
    counts = with_counts(docs.select("doc_id", "source", "text")).drop("text").withColumn("fails", _fails())
    judged = _with_strict(materialize(counts, "quality"), max_rate)
    kept = ~(F.col("fails") | F.col("strict") & _failures(0.5))
    return judged.select("doc_id", *(c for c in COUNTS if c != "n_lines"), base_failed().alias("base_failed"), kept.alias("kept"), "n_lines", "source")


def filter_documents(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """The documents that quality_rules keeps, with all their columns. Texts are counted once: the table written meanwhile has
    the texts of documents that fail no rule, and of the others only what host rates need."""
    held = docs.select("source", "text", F.struct(*(named(c) for c in docs.columns if c != "text")).alias("rest"))
    counted = with_counts(held).withColumn("fails", _fails()).withColumn("close", _failures(0.5)).drop(*COUNTS)
    stays = ~F.col("fails")
    table = counted.select("source", "fails", "close", F.when(stays, F.col("text")).alias("text"), F.when(stays, F.col("rest")).alias("rest"))
    judged = _with_strict(materialize(table, "quality"), max_rate).where("not fails and not (strict and close)")
    return judged.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))
