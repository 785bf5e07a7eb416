import html
import math
import random
import re
import timeit
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aqlens.llm import ann, langid, quality, queries


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows[:500]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.3)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([s < 0.3 for s in good]) < 0.02


def test_quality_odd_rows(spark, odd_docs, no_docs, clash):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (13, 0), (None, 1), (3, None), (7, 1), (99, 0)], "doc_id long, quality int")
    net = quality.train(odd_docs, labels, most=3)
    rows = quality.score(clash(odd_docs), net).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    empty = {round(r["score"], 9) for r in rows if r["doc_id"] in (3, 4)}
    assert len(empty) == 1
    kept = quality.keep_good(clash(odd_docs), net)
    assert kept.columns == clash(odd_docs).columns
    assert kept.count() == sum(r["predicted"] for r in rows)
    assert quality.score(no_docs, net).collect() == []
    unfitted = quality.train(odd_docs, labels.filter("false"))
    assert {r["score"] for r in quality.score(odd_docs, unfitted).collect()} == {0.5}


def test_pooling_covers_every_window():
    rng = np.random.default_rng(0)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), rng.normal(size=3 * quality.FILTERS), 0.0)
    texts = [b"", b"a", b"abcdef", b"x" * 127, b"y" * 133, bytes(range(256)) * 90, b"q" * 261]
    got, counts = net.pooled(texts)
    at = 0
    for t, n in zip(texts, counts.tolist()):
        d, valid = t + b"\0" * max(0, quality.WIDTH - len(t)), max(1, len(t) - quality.WIDTH + 1)
        conv = np.array([sum(net.taps[k][d[i + k]] for k in range(quality.WIDTH)) for i in range(valid)])
        blocks = -(-valid // quality.STRIDE)
        assert n == max(1, blocks - 1)
        for c in range(n):
            want = np.maximum(conv[c * quality.STRIDE : (c + 2) * quality.STRIDE].max(axis=0), 0)
            assert np.allclose(got[at + c], want, atol=1e-4)
        at += n


def vectors(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in row], 0) for i, row in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = ann.search(vectors(spark, x), F.col("id") % 50 == 0, k=10, centroids=16).collect()
    wide = x.astype(np.float64)
    hits = 0
    for q in range(0, 3000, 50):
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        score = wide @ wide[q]
        assert all(math.isclose(r["score"], score[r["vec_id"]], rel_tol=1e-12) for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:10].tolist()) & {r["vec_id"] for r in own})
    assert hits / 600 >= 0.9


def test_search_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [0.0, -1.0]), (10, []), (20, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    got = ann.search(df, F.col("id") % 10 == 0, k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [
        (0, 1, 20, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 1.0),
    ]
    assert ann.search(df.filter("false"), F.col("id") % 10 == 0, k=3).collect() == []
    assert ann.search(df.filter("vec_id = 0"), F.col("id") % 10 == 0, k=3).collect() == []


def test_walk_takes_cells_by_falling_sum():
    rng = np.random.default_rng(4)
    a, b, counts = rng.normal(size=7), rng.normal(size=5), rng.integers(0, 4, 35)
    met, least = ann.walk(a, b, counts, 20)
    sums = (a[:, None] + b[None, :]).ravel()
    assert met == np.argsort(-sums).tolist()[: len(met)] and math.isclose(least, sums[met[-1]])
    assert counts[met].sum() >= 20 > counts[met[:-1]].sum()


LANG_DOCS = [("en", "the cat and the dog went to the old house with their friends"), ("fr", "le chat et le chien sont dans la vieille maison avec leurs amis"), ("de", "die katze und der hund gehen mit ihren freunden in das alte haus"), (None, "xyz"), ("en", None)]


def test_language_fusion(spark):
    docs = spark.createDataFrame([(t, lang) for lang, t in LANG_DOCS * 3], "text string, lang string")
    pages = [
        (1, "https://a.example.fr/fr/x", '<html lang="fr"><script>the the the</script><p>le chat et la maison</p></html>'),
        (2, "https://a.example.fr/fr/y", "<html lang='fr'><p></p></html>"),
        (3, "https://b.example.de/de/y", "<html lang=de>der hund und die katze gehen</html>"),
        (4, "https://b.example.de/de/z", ""),
        (5, None, None), (None, "nonsense", "<p>the dog and the cat went to the house"),
        (6, "https://a.example.fr/fr/z", '<html lang="fr">leurs amis sont dans la maison</html>'),
        (6, "https://a.example.fr/fr/z", '<html lang="fr">leurs amis sont dans la maison</html>'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("zz")).withColumn("n", F.lit(1))
    rows = langid.identify(df, docs).collect()
    assert len(rows) == len(pages)
    got = {r["page_id"]: r for r in rows}
    assert {i: got[i]["lang"] for i in (1, 2, 3, 4, 6, None)} == {1: "fr", 2: "fr", 3: "de", 4: "de", 6: "fr", None: "en"}
    assert got[2]["text_lang"] is None and got[2]["declared"] == "fr" and got[4]["declared"] is None
    assert all(0 < r["probability"] <= 1 + 1e-12 for r in rows)
    want = brute_language(pages, LANG_DOCS * 3)
    for r in rows:
        lang, p = want[r["page_id"]]
        assert r["lang"] == lang and math.isclose(r["probability"], p, rel_tol=1e-9)
    assert langid.identify(df.filter("false"), docs).collect() == []
    assert [r["lang"] for r in langid.identify(df, docs.filter("false")).collect()] == [None] * len(pages)


def brute_language(pages, docs):
    """The same evidence, page by page in plain Python."""
    names = sorted({lang for lang, t in docs if lang and t is not None})
    k = len(names)
    counts = np.full((k, langid.BUCKETS), langid.SMOOTH)
    for lang, t in docs:
        if lang and t is not None:
            for b in langid.trigrams(t):
                counts[names.index(lang), b] += 1
    model = np.log(counts / counts.sum(axis=1, keepdims=True))
    seen = []
    for i, url, page in pages:
        at = langid.trigrams(langid.visible(page or ""))
        score = model[:, at].sum(axis=1) * min(1, langid.TEXT_TRIGRAMS / max(1, len(at)))
        seen.append((i, score, int(score.argmax()) if len(at) else None, langid.declared(page or ""), *langid.address(url)))
    tally = lambda rows: np.array([sum(r[2] == j for r in rows) for j in range(k)], float)
    total = tally(seen)
    overall = (total + 1) / (total.sum() + k)
    prior = lambda n, up: (n + langid.PRIOR_ROWS * up) / (n.sum() + langid.PRIOR_ROWS)
    out = {}
    for r in seen:
        i, score, best, decl, host, domain, top, suffix = r
        start = overall
        if host:
            above = prior(tally([s for s in seen if s[5] == domain]), prior(tally([s for s in seen if s[6] == top]), overall))
            own = tally([s for s in seen if s[4] == host])
            if best is not None:
                own[best] -= 1
            start = prior(own, above)
        fused = score + np.log(start)
        for place, value in ((3, decl), (7, suffix)):
            rows = [s for s in seen if s[place] == value and s[2] is not None]
            if value is not None and rows:
                n = tally(rows)
                share = (n.sum() + 1) / (total.sum() + 1)
                fused = fused + np.log((n + share * langid.EVIDENCE_ROWS) / (total + langid.EVIDENCE_ROWS))
        p = np.exp(fused - fused.max())
        out[i] = (names[int(fused.argmax())], 1 / p.sum())
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, sf_small, name):
    rows = queries.QUERIES[name](spark, sf_small)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_visible_text_and_declared_language_as_by_patterns():
    hidden = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
    tag = re.compile(r"<[^>]*>")
    says = [
        re.compile(r"""<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I),
        re.compile(r"""<meta\b[^>]*?content-language["'][^>]*?content\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I),
    ]
    bits = [
        "<script>", "</script >", "<SCRIPT src=x>", "</Script>", "<style", "</style>", "<!--", "-->", "a", "<", "> ", ">", "&amp;", " ",
        "<html lang=en>", "<html ", "xml:lang='de'", "lang=fr", "<meta content-language' ", "content = it", "<template>", "</template",
    ]
    pick = random.Random(5)
    for _ in range(20_000):
        page = "".join(pick.choice(bits) for _ in range(pick.randint(0, 14)))
        assert langid.visible(page) == html.unescape(tag.sub(" ", hidden.sub(" ", page)))
        found = says[0].search(page) or says[1].search(page)
        assert langid.declared(page) == (found[1].lower() if found else None)


@pytest.mark.parametrize("unit", ["<script ", "<", "<!--", "<html ", "<meta ", "<html lang ", "<style></style "])
def test_pages_are_scanned_in_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    assert min(timeit.repeat(lambda: (langid.visible(page), langid.declared(page)), number=1, repeat=2)) < 5
