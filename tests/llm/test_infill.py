import hashlib

import duckdb
import numpy as np
import pytest

from aqlens.llm import infill, queries


def _expected(i, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return n, "psm", a, b - a, f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def test_against_slicing(spark, odd_docs, odd_rows, clash):
    out = infill.restore(infill.transform(clash(odd_docs))).collect()
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in out)
    assert got == sorted((str(i), *_expected(i, t), t or "") for i, t, *_ in odd_rows)


def test_every_form_and_sentinels_in_texts(spark):
    rows = [(i, "aé日𝕏b<"[i % 5 :] * (i % 7) + (["", "<P>", "x<M>y", "<", ">"][i % 5])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in infill.restore(infill.transform(df)).collect()}
    assert {r["form"] for r in out.values()} == {"plain", "psm", "spm"}
    for i, t in rows:
        r = out[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == _expected(i, t)
        assert r["restored"] == t


def test_rotations_of_long_texts(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(infill, "STEP", 7)
    for _ in range(500):
        text = "".join(rng.choice(["a", "é", "日", "𝕏", "<", ">", "S"], rng.integers(1, 80)))
        if any(m in text for m in infill.Marks()):
            continue
        a, b = sorted(rng.integers(0, len(text) + 1, 2).tolist())
        for form, want in (
            ("psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"),
            ("spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"),
        ):
            out = infill.arranged(text.encode(), form, a, b - a)
            assert out.decode() == want
            assert infill.rebuilt(out, form).decode() == text


def test_own_sentinels(spark):
    marks = infill.Marks("[pre]", "[suf]", "[mid]")
    df = spark.createDataFrame([(i, f"text <P> {i} é") for i in range(50)], "doc_id long, text string")
    out = infill.transform(df, plain_share=0, spm_share=50, marks=marks)
    rows = infill.restore(out, marks=marks).collect()
    assert all(r["restored"] == f"text <P> {r['doc_id']} é" and "[mid]" in r["output"] for r in rows)
    for bad in (infill.Marks("aa", "bb", "ab"), infill.Marks("", "b", "c"), infill.Marks("xax", "a", "c")):
        with pytest.raises(ValueError):
            infill.transform(df, marks=bad)


def test_empty_table(no_docs):
    assert infill.restore(infill.transform(no_docs)).collect() == []


def test_query_equals_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    got = queries.op11_infill(spark, sf_small)
    want = con.sql(queries.ORACLE["op11_infill"])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    bag = lambda rows: sorted(tuple(map(str, (x if x is None or isinstance(x, str) else int(x) for x in r))) for r in rows)
    assert bag(got.select(names).collect()) == bag(want.project(", ".join(names)).fetchall())
