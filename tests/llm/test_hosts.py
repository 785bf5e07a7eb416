import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import types as T

from aqlens.llm import hosts, queries

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)
    )


def _shrunk(by_host):
    """Beta-binomial rates from {host: (n, k)}, written out over the documents."""
    n, k = (sum(v[j] for v in by_host.values()) for j in (0, 1))
    mean, count = k / n, len(by_host)
    rho = 0.0
    if count > 1 and n > count:
        msb = sum(a * (b / a - mean) ** 2 for a, b in by_host.values()) / (count - 1)
        msw = sum(b * (1 - b / a) ** 2 + (a - b) * (b / a) ** 2 for a, b in by_host.values()) / (n - count)
        size = (n - sum(a * a for a, _ in by_host.values()) / n) / (count - 1)
        rho = (msb - msw) / (msb + (size - 1) * msw) if msb + (size - 1) * msw > 0 else 0.0
    strength = max(1.0, min((1 - rho) / rho if rho > 0 else n, n))
    return {h: (b + mean * strength) / (a + strength) for h, (a, b) in by_host.items()}


def _brute(rows):
    """(id, host) -> counts, base_failed, kept of every row, in plain Python."""
    tests = {
        "few_words": lambda w, c, s, li, d, r: w < 10,
        "repeats": lambda w, c, s, li, d, r: 100 * r > 20 * w,
        "symbols": lambda w, c, s, li, d, r: 10 * s > w,
        "dup_lines": lambda w, c, s, li, d, r: 100 * d > 30 * li,
        "word_length": lambda w, c, s, li, d, r: c < 3 * w or c > 10 * w,
    }
    each = [(i, h, _counts(t)) for i, t, h in rows]
    bad = set()
    for rule in tests.values():
        by = defaultdict(lambda: [0, 0])
        for _, h, c in each:
            if h is not None:
                by[h][0] += 1
                by[h][1] += rule(*c)
        if by:
            bad |= {h for h, rate in _shrunk(by).items() if rate > hosts.HOST_LIMIT}
    out = []
    for i, h, c in each:
        failed = tests["few_words"](*c) or tests["repeats"](*c)
        out.append((str(i), str(h), *c, failed, not failed and h not in bad))
    return sorted(out)


def _rows(df):
    return sorted((str(r["doc_id"]), str(r["source"]), *[r[c] for c in COUNTS], r["base_failed"], r["kept"]) for r in df.collect())


def test_odd_rows(spark, odd_docs, odd_rows, clash):
    assert _rows(hosts.judge(clash(odd_docs))) == _brute([(i, t, s) for i, t, _, s, _ in odd_rows])


def test_hosts_are_rejected_and_joined_back(spark):
    clean = "A clean sentence number {} with several ordinary words that nobody would ever reject today"
    spam = "$$$ %%% ### one {} two three four five six seven eight nine ten"
    docs = []
    for k in range(300):
        docs.append((k, clean.format(k), f"good{k % 6}"))
        docs.append((1000 + k, (spam if k % 10 else clean).format(k), "spam"))
    docs += [(2000, spam.format(0), "rare"), (2001, spam.format(1), None), (2002, None, "good0")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])
    out = hosts.judge(spark.createDataFrame(docs, schema))
    assert _rows(out) == _brute(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    # clean documents of a failing host go with it, others stay
    assert rows[1000]["host_failed"] == ["symbols"] and not rows[1000]["kept"] and not rows[1000]["base_failed"]
    assert all(rows[k]["kept"] for k in range(300)) and rows[2001]["kept"]
    rates = {r["host"]: r for r in hosts.host_rates(hosts.features(spark.createDataFrame(docs, schema))).collect()}
    assert None not in rates and rates["spam"]["k_symbols"] == 270
    # one document is no proof: its host's rate is drawn to that of all
    assert rates["rare"]["k_symbols"] == 1 and rates["rare"]["rate_symbols"] < 1
    want = _shrunk({h: (r["n"], r["k_symbols"]) for h, r in rates.items()})
    assert all(abs(rates[h]["rate_symbols"] - w) < 1e-9 for h, w in want.items())


def test_single_host_and_ties(spark):
    schema = "doc_id long, text string, source string"
    docs = [(1, "a b c d e a b c d e", "h"), (1, "a b c d e a b c d e", "h"), (2, "x " * 40, "h"), (3, "one two three four five " * 2 + "end\n\nend\n \nend", "h")]
    assert _rows(hosts.judge(spark.createDataFrame(docs, schema))) == _brute(docs)


def test_empty_table(no_docs):
    assert hosts.judge(no_docs).collect() == []


def test_no_python_on_the_main_path(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    for df in (hosts.judge(docs), hosts.features(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "RDD"))


def test_query_equals_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    got = queries.op12_host_rules(spark, sf_small)
    want = con.sql(queries.ORACLE["op12_host_rules"])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(want.project(", ".join(names)).fetchall())
