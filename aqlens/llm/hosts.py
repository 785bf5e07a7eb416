"""Host-level quality rules.

Every document is held against a set of rules.  Failures are counted by host,
each rate is shrunk towards the rate of all documents with an empirical beta
prior, and the verdict on the host joins back to its documents: a document goes
where it fails a base rule itself or where its host fails some rule at a shrunk
rate above the limit.

The prior of a rule is that of a beta-binomial model whose correlation within
hosts is found by analysis of variance over all hosts: the more hosts differ
beyond chance, the weaker the prior.  Five sums over the host table give it.

Words are `[^\\x20\\x09-\\x0D]+`.  Words that repeat are those covered by a
window of five words that is found twice or more in the text; windows are
compared by a 64-bit hash within one text.  All of a text is counted within its
own row by built-in functions, so only one short row a document is shuffled.

Null texts count as empty (no words).  Documents without a host belong to none:
they are judged by the base rules alone and don't enter the prior.  Repeated
rows and ids each count as documents.  Columns other than those named are not
read.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqlens.llm.common import sized, written

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
# Shrunk rate of a rule's failures above which a host is rejected.
HOST_LIMIT = 0.5
# Hosts up to which their table goes to all tasks.
BROADCAST_HOSTS = 200_000

# The two base rules reject a document by themselves.
BASE = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
}
RULES = BASE | {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}


def _repeated(pairs: str) -> Column:
    """Words covered by the windows whose hash is found twice or more; ``pairs``
    holds (hash, place) in order, null where all hashes differ."""
    same = lambda x, j: F.coalesce(F.get(pairs, j)["hash"] == x["hash"], F.lit(False))
    twice = F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1))
    starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
    none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        starts,
        none,
        lambda acc, at: F.struct(
            at.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), at - acc["last"])).cast("long").alias("total")
        ),
    )
    return F.coalesce(covered["total"], F.lit(0).cast("long"))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: id, host, n_words, word_chars, n_symbols, n_lines
    (with a word), n_dup_lines (equal to an earlier line), n_repeat_words."""
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(host_col).alias("host"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    trimmed = F.btrim("text", F.lit(WHITE_CHARS))
    has_word = lambda line: F.btrim(line, F.lit(WHITE_CHARS)) != ""
    rows = rows.select(
        "id",
        "host",
        F.length(F.regexp_replace("text", WHITE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), has_word).alias("lines"),
        F.when(trimmed != "", F.split(trimmed, WHITE)).otherwise(F.array().cast("array<string>")).alias("words"),
    )
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    last = F.size("words") - WINDOW
    rows = rows.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(last > 0, F.transform(F.sequence(F.lit(0), last), window)).alias("windows"),
    )
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    rows = rows.withColumn("pairs", F.when(F.col("windows").isNotNull() & twice, pairs))
    return rows.withColumn("n_repeat_words", _repeated("pairs")).drop("windows", "pairs")


def _priors(hosts: DataFrame, rules: dict[str, str]) -> dict[str, tuple[float, float]]:
    """(mean, strength) of each rule's beta prior; only sums over hosts reach
    the driver.  Strength is counted in documents: 1 where hosts differ as much
    as they can, the number of all documents where they differ by chance only."""
    exact = lambda c: F.sum(c.cast("decimal(38,10)")).cast("double")
    sums = [F.count("*").alias("hosts"), exact(F.col("n")).alias("n"), exact(F.col("n") * F.col("n").cast("double")).alias("nn")]
    for rule in rules:
        k = F.col(f"k_{rule}")
        sums += [exact(k).alias(f"k_{rule}"), exact(k.cast("double") * k / F.col("n")).alias(f"kk_{rule}")]
    total = hosts.agg(*sums).first()
    found = {}
    for rule in rules:
        n, count = total["n"] or 0.0, total["hosts"]
        k, kk = total[f"k_{rule}"] or 0.0, total[f"kk_{rule}"] or 0.0
        mean = k / n if n else 0.0
        rho = 0.0
        if count > 1 and n > count:
            between = (kk - n * mean * mean) / (count - 1)
            within = (k - kk) / (n - count)
            size = (n - total["nn"] / n) / (count - 1)
            spread = between + (size - 1) * within
            rho = (between - within) / spread if spread > 0 else 0.0
        strength = (1 - rho) / rho if rho > 0 else n
        found[rule] = (mean, max(1.0, min(strength, n)))
    return found


def host_rates(rows: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """One row per host of ``rows`` (the columns of ``features``): host, n
    (documents) and, for each rule, k_<rule> (failures) and rate_<rule> (shrunk)."""
    rules = RULES if rules is None else rules
    counts = [F.count_if(F.expr(f"({test})")).alias(f"k_{rule}") for rule, test in rules.items()]
    hosts = rows.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *counts)
    hosts = written(hosts, "host-counts")
    rates = []
    for rule, (mean, strength) in _priors(hosts, rules).items():
        rates.append(((F.col(f"k_{rule}") + mean * strength) / (F.col("n") + strength)).alias(f"rate_{rule}"))
    return hosts.select("*", *rates)


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    rules: dict[str, str] | None = None,
    base: dict[str, str] | None = None,
    limit: float = HOST_LIMIT,
) -> DataFrame:
    """One row per input row: ``id_col``, ``host_col``, the counts of
    ``features``, base_failed, host_failed (names of the rules that its host
    fails) and kept.

    ``rules`` are conditions over the counts, by name; those of ``base`` reject
    a document by themselves.
    """
    rules, base = RULES if rules is None else rules, BASE if base is None else base
    rows = written(features(df, id_col, text_col, host_col), "host-features")
    failing = F.filter(
        F.array(*[F.when(F.col(f"rate_{rule}") > limit, F.lit(rule)) for rule in rules]).cast("array<string>"),
        lambda rule: rule.isNotNull(),
    )
    verdicts = host_rates(rows, rules).select(F.col("host").alias("judged"), failing.alias("host_failed"))
    verdicts = sized(written(verdicts, "host-verdicts"), BROADCAST_HOSTS)
    failed = F.expr(" OR ".join(f"({test})" for test in base.values()) or "false")
    none = F.array().cast("array<string>")
    rows = rows.join(verdicts, F.col("host") == F.col("judged"), "left").withColumn("base_failed", failed)
    host_failed = F.coalesce("host_failed", none)
    return rows.select(
        F.col("id").alias(id_col),
        F.col("host").alias(host_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        host_failed.alias("host_failed"),
        (~F.col("base_failed") & (F.size(host_failed) == 0)).alias("kept"),
    )
