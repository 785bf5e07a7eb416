import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aqlens.llm import exact, graph, passages, simhash


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected_exact(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(str(i), str(keep), len(ids), sha) for i in ids]
    return sorted(out)


@pytest.mark.parametrize("id_bytes", [1, 16])
def test_exact_groups(odd_docs, odd_rows, clash, id_bytes):
    rows = exact.exact_dedup(clash(odd_docs), id_bytes=id_bytes).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in rows) == expected_exact(odd_rows)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in rows})  # one of each, repeated rows or not
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_rows_that_stay(odd_docs, odd_rows, clash):
    out = exact.drop_exact_duplicates(clash(odd_docs))
    assert out.columns == clash(odd_docs).columns
    rows = out.collect()
    assert sorted(norm(r["text"]) for r in rows) == sorted({norm(r[1]) for r in odd_rows})


def test_exact_empty(no_docs):
    assert exact.exact_dedup(no_docs).collect() == []
    assert exact.drop_exact_duplicates(no_docs).collect() == []


def test_cut_points_follow_the_content():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 60_000).astype(np.uint8).tobytes()
    ends = exact.cut_points(data)
    assert ends[-1] == len(data) and all(0 < b - a <= exact.MOST for a, b in zip([0] + ends, ends))
    moved = {e - 1000 for e in exact.cut_points(data[1000:][:0] + b"z" * 1000 + data)}
    assert len(moved & set(ends)) > 0.9 * len(ends)


def brute_fingerprint(text):
    import xxhash

    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    sh = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    value = 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hashes) > len(hashes):
            value |= 1 << b
    return value


def brute_components(fps, distance=4):
    ids = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = ids[a], ids[b]
                ids = [min(x, y) if i in (x, y) else i for i in ids]
    return ids


@pytest.mark.parametrize(("chain", "block"), [(2, 256), (1, 256), (2, 3)])
def test_links_connect_as_brute_force(spark, chain, block):
    rng = np.random.default_rng(chain)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:8]:
        for _ in range(12):
            y = int(x)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.links(df, 4, chain, block)
    roots = {r["node"]: r["root"] for r in graph.components(found, "a", "b").collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_near_duplicates(odd_docs, odd_rows, clash):
    rows = simhash.near_duplicates(clash(odd_docs)).collect()
    fps = [brute_fingerprint(r[1]) for r in odd_rows]
    comp = brute_components(fps)
    least: dict = {}
    for (i, *_), c in zip(odd_rows, comp):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = sorted((str(r[0]), f"{f:016x}", str(least[c])) for r, f, c in zip(odd_rows, fps, comp))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == want
    kept = simhash.drop_near_duplicates(clash(odd_docs))
    assert kept.columns == clash(odd_docs).columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == {x for x in least.values() if x is not None}


def test_rows_that_share_an_id_go_one_by_one(spark, clash):
    near, far = " ".join(words(80, 1)), " ".join(words(80, 2))
    rows = [(1, near), (2, near), (2, far), (3, far), (4, near)]
    kept = simhash.drop_near_duplicates(clash(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, near), (2, far)])


def test_near_duplicates_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.drop_near_duplicates(no_docs).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


def test_window_minima_and_compact_windows():
    rng = np.random.default_rng(2)
    values = passages._mix(rng.integers(0, 60, 300).astype(np.uint64), 5)
    minima = passages.window_minima(values, 10)
    assert minima.tolist() == [i + int(np.argmin(values[i : i + 10])) for i in range(291)]
    for c, (lo, hi) in passages.compact_windows(values, minima).items():
        assert (values[lo : hi + 1] >= values[c]).all() and lo <= c <= hi
        assert lo == 0 or values[lo - 1] <= values[c]
        assert hi == len(values) - 1 or values[hi + 1] < values[c]


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def test_passages(spark, odd_docs, no_docs, clash):
    shared, other = words(60, 1), words(55, 2)
    near = shared[:30] + ["changed"] + shared[31:]
    docs = {
        1: words(200, 3) + shared + words(100, 4),
        2: words(20, 5) + shared + words(300, 6) + other,
        3: other + words(50, 7),
        4: words(400, 8),
        5: words(80, 9) + shared[:40] + words(80, 10),  # too short
        6: words(33, 11) + shared + other,
        7: [],
    }
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(8, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_spans"], list(r["first_ids"]), r["spans"]) for r in passages.mark_passages(df).collect()}
    # spans reach over one-sided rests as long as the similarity holds
    assert set(i for i, g in got.items() if g[0]) == {2, 3, 6}
    assert got[2][1] == [1] and got[3][1] == [2] and set(got[6][1]) <= {1, 2}
    start, end, _ = map(int, got[2][2].split(":"))
    assert start <= 20 and end >= 80 and start >= 10 and end <= 90
    # one changed word breaks five tokens of the passage: its longer part is found
    changed = [" ".join(words(90, 20) + shared), " ".join(near + words(90, 21))]
    two = spark.createDataFrame(list(enumerate(changed)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_spans"] for r in passages.mark_passages(two, least=20).collect()} == {0: 0, 1: 1}
    odd = passages.mark_passages(clash(odd_docs))
    assert odd.count() == odd_docs.count()
    found = {r["doc_id"]: r["n_spans"] for r in odd.collect() if r["n_spans"]}
    assert {2, 8, 9, 12} <= set(found) and not {1, 3, 4, 5, 6, 10, 11} & set(found)
    assert passages.mark_passages(no_docs).collect() == []


def edited(passage, kind, at):
    new = {"insert": ["new", passage[at]], "delete": [], "change": ["new"]}[kind]
    return passage[:at] + new + passage[at + 1 :]


def near_pair(size, kind, seed):
    """Tokens of a text with an edited passage, and of an earlier one with it as it was."""
    passage = words(size, 3 * seed)
    late = words(60, 3 * seed + 1) + edited(passage, kind, size // 2) + words(60, 3 * seed + 2)
    early = words(40, 3 * seed + 10**6) + passage + words(70, 3 * seed + 2 * 10**6)
    return [passages.tokens(" ".join(w).encode()) for w in (late, early)]


def common_places(a, b):
    there = {}
    for sig, c, _, _ in zip(*passages.signatures(b)):
        there.setdefault(sig, c)
    return [(c, there[sig], lo, hi) for sig, c, lo, hi in zip(*(x.tolist() for x in passages.signatures(a))) if sig in there]


def brute_spans(a, b, places):
    least, reach = passages.LEAST, int(passages.LEAST / passages.SIMILARITY)
    covered = set()
    for c, other, lo, hi in places:
        near = b[max(0, other - reach) : other + reach + 1].tolist()
        for s in range(max(lo, c - least + 1), min(c, hi - least + 1) + 1):
            x = set(a[s : s + least].tolist())
            for p in range(len(near)):
                y: set = set()
                for t in near[p:]:
                    y.add(t)
                    if len(x & y) >= passages.SIMILARITY * len(x | y):
                        covered.update(range(s, s + least))
    return covered


@pytest.mark.parametrize("kind", ["insert", "delete", "change"])
def test_every_window_of_a_place_is_verified(kind):
    shared = found = 0
    for seed in range(150):
        a, b = near_pair(52, kind, seed)
        places = common_places(a, b)
        got = passages.similar_spans(a, b, places)
        shared, found = shared + bool(places), found + bool(got)
        if seed < 2 or not got:  # places that lie mostly beside the passage verify nothing
            assert brute_spans(a, b, places) <= {i for s, e in got for i in range(s, e)}
    assert shared > 100 and found >= 0.9 * shared


def test_repeated_tokens_count_once():
    rng = np.random.default_rng(3)
    for trial in range(60):
        x, y = (rng.integers(0, 9, n).astype(np.uint64) for n in (14, 25))
        got = passages._resembling(x, y, 8, 0.8).tolist()
        runs = [set(y[p:q].tolist()) for p in range(25) for q in range(p + 1, 26)]
        sets = [set(x[s : s + 8].tolist()) for s in range(7)]
        assert got == [any(len(u & r) >= 0.8 * len(u | r) for r in runs) for u in sets]


def marked(spark, docs):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    return {r["doc_id"]: (list(r["first_ids"]), r["spans"]) for r in passages.mark_passages(df).collect()}


def test_an_earlier_part_hides_no_exact_repeat(spark):
    """40 of 50 words in an earlier document share signatures but are too short."""
    docs, owner = {}, {}
    for k in range(120):
        passage = words(50, 7 * k)
        at = 3 * k
        docs[at] = words(30, 7 * k + 1) + passage[5:45] + words(30, 7 * k + 2)
        docs[at + 1] = words(30, 7 * k + 3) + passage + words(30, 7 * k + 4)
        docs[at + 2] = words(45, 7 * k + 5) + passage + words(20, 7 * k + 6)
        owner[at + 2] = at + 1
    got = marked(spark, docs)
    for i, (first_ids, spans) in got.items():
        assert first_ids == ([owner[i]] if i in owner else []), i
        if i in owner:
            start, end, _ = map(int, spans.split(":"))
            assert start <= 45 and end >= 95


def test_an_earlier_part_hides_no_near_repeat(spark):
    """The first documents with the signatures hold too little of the passage; a
    later one has all but a word of it."""
    docs, late = {}, []
    for k in range(40):
        passage, at = words(50, 17 * k), 10 * k + 1
        for j, part in enumerate((passage[12:40], passage[6:40], passage[10:44], passage)):
            docs[at + j] = words(30, 17 * k + 2 * j + 1) + part + words(30, 17 * k + 2 * j + 2)
        docs[at + 4] = words(45, 17 * k + 9) + edited(passage, "change", 25) + words(20, 17 * k + 10)
        late.append(at + 4)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {r["doc_id"]: list(r["first_ids"]) for r in passages.mark_passages(df).collect()}
    assert [i for i in late if got[i] != [i - 1]] == []


def test_a_part_in_all_documents_hides_no_near_copy(spark):
    """All have 30 words in common, which is too short, and every third is the one
    before it with a word changed."""
    part, docs, want = words(30, 1), {}, {}
    for k in range(120):
        own = words(40, 3 * k + 2) + part + words(40, 3 * k + 3)
        if k % 3 == 2:
            own = edited(docs[k - 1], "change", 20)
            want[k] = [k - 1]
        docs[k] = own
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = passages.mark_passages(df).collect()
    assert {r["doc_id"]: list(r["first_ids"]) for r in found if r["n_spans"]} == want


@pytest.mark.parametrize("kinds", [10**9, 3])
def test_places_of_a_signature_are_searched_like_pairs_one_by_one(kinds, monkeypatch):
    """Of each window the first earlier document that it resembles, as by a
    comparison with each; also for texts that repeat few tokens, in small blocks."""
    import pyarrow as pa

    monkeypatch.setattr(passages, "HOLDERS", 2)
    rng, least = np.random.default_rng(kinds % 97), 10
    base = [rng.integers(0, kinds, 25) for _ in range(3)]
    rows = []
    for sig in range(6):
        for k in range(9):
            text = base[int(rng.integers(3))].copy()
            at = rng.integers(0, 25, int(rng.integers(0, 7)))
            text[at] = rng.integers(0, kinds, len(at))
            asks = k > 0 and k % 4 != 3
            rows.append((sig, k // 2, 100 * sig + k, 12, 12, 4 if asks else -1, 20 if asks else -1, text))
    cols = [pa.array([r[x] for r in rows], pa.int64()) for x in range(7)]
    cut = [r[7].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : passages.TOKEN_WIDTH].tobytes() for r in rows]
    batch = pa.RecordBatch.from_arrays([*cols, pa.array(cut, pa.binary())], names=["sig", "id", "uid", "c", "at", "lo", "hi", "tokens"])
    whole = list(passages._whole_groups(batch.slice(k, 4) for k in range(0, len(rows), 4)))
    assert [len(set(b.column(0).to_pylist())) for b in whole] == [1] * 6
    got: dict = {}
    for part in whole:
        for ident, uid, first, s, e in passages.repeats_around(part, least, 0.8):
            for t in range(s, e - passages.WORDS + 1):
                got[uid, t] = min(first, got.get((uid, t), first))
    want: dict = {}
    for sig, ident, uid, c, at, lo, hi, text in rows:
        if lo >= 0:
            for other in rows:
                if other[0] == sig and other[1] < ident:
                    x, y = text[lo : hi + 1].astype(np.uint64), other[7].astype(np.uint64)
                    for s, e in passages.similar_spans(x, y, [(c - lo, at, 0, hi - lo)], least, 0.8):
                        for t in range(lo + s, lo + e):
                            want[uid, t] = min(other[1], want.get((uid, t), other[1]))
    assert len(want) > 50 and set(got) == set(want)
    assert all(got[k] >= want[k] for k in want) and sum(got[k] != want[k] for k in want) <= 0.1 * len(want)


def test_every_place_of_the_first_document_is_compared():
    """The passage stands after a part of it in the same document."""
    lost = 0
    for k in range(100):
        passage = words(52, 9 * k)
        b = passages.tokens(" ".join(passage[4:44] + words(80, 9 * k + 1) + passage + words(9, 9 * k + 2)).encode())
        a = passages.tokens(" ".join(words(30, 9 * k + 3) + edited(passage, "change", 26) + words(30, 9 * k + 4)).encode())
        there = passages._places_by_signature(b, passages.LEAST, passages.SIMILARITY, passages.HASHES)
        mine = list(zip(*(x.tolist() for x in passages.signatures(a))))
        every = [(c, o, lo, hi) for sig, c, lo, hi in mine for o in there.get(int(np.uint64(sig).view(np.int64)), ())]
        one = common_places(a, b)
        assert set(one) <= set(every)
        lost += bool(passages.similar_spans(a, b, every)) and not passages.similar_spans(a, b, one)
    assert lost > 0  # what the first place alone would miss


def test_spans_of_signatures_are_overlaps_of_compact_windows():
    token = passages.tokens(" ".join(words(400, 5)).encode())
    least = passages.LEAST
    own = [passages._mix(token, 2 + k) for k in (0, 1)]
    minima = [passages.window_minima(v) for v in own]
    trees = [passages.compact_windows(v, m) for v, m in zip(own, minima)]
    _, c, lo, hi = (x.tolist() for x in passages.signatures(token, hashes=2))
    for at, l, h in zip(c, lo, hi):
        x, y = minima[0][l], minima[1][l]
        assert x == at
        left, right = (f(trees[0][x][k], trees[1][y][k]) for k, f in enumerate((max, min)))
        assert (l, h) == (max(left, max(x, y) - least + 1), min(right, min(x, y) + least - 1))

def test_signatures_follow_from_the_runs_of_minima(monkeypatch):
    """No Python loop over the places; compact windows as by their definition."""

    def loop(*_):
        raise AssertionError("a loop over all places")

    monkeypatch.setattr(passages, "_tree", loop)
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 40, n).astype(np.uint64) for n in (5, 8, 9, 60, 200)]
    text, _, c, lo, hi = passages.signatures_of(texts, 8, 2)
    for i, token in enumerate(texts):
        own = [passages._mix(token, 2 + k) for k in (0, 1)]
        minima = [[s + int(np.argmin(v[s : s + 8])) for s in range(len(v) - 7)] for v in own]
        spans: dict[tuple[int, int], list[int]] = {}
        for s, both in enumerate(zip(*minima)):
            spans.setdefault(both, []).append(s)
        expected = sorted((a, s[0], s[-1] + 7) for (a, _), s in spans.items())
        here = text == i
        assert sorted(zip(c[here].tolist(), lo[here].tolist(), hi[here].tolist())) == expected


def test_words_are_hashed_as_one_array(monkeypatch):
    """XXH64 of every word, without a call for each short one."""
    import pyarrow as pa
    import xxhash

    own, long = xxhash.xxh64_intdigest, []
    texts = [None, b"", b" \n", " ".join("xY1é"[k % 4] * k for k in range(1, 70)).encode(), b" A b\tc\x0bd\x1ce  f g h\xff i ", b"a b c d", b"a b c d e"]
    expected = []
    for text in texts:
        h = [own(w) for w in (text or b"").lower().split()]
        rows = []
        for at in range(len(h) - 4):
            value = 0
            for x in h[at : at + 5]:
                value = (value * 0xD1342543DE82EF95 + x) % 2**64
            rows.append(value)
        expected.append(passages._mix(np.array(rows, np.uint64), 1).tolist())
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: long.append(len(w)) or own(w))
    assert [t.tolist() for t in passages.tokens_of(pa.array([b"x"] + texts, pa.binary()).slice(1))] == expected
    assert [passages.tokens(t).tolist() for t in texts] == expected
    assert min(long) >= 32
    assert passages.tokens_of(pa.array([], pa.binary())) == []


def test_shifts_are_compared_together():
    """Two texts with many runs in common, each under a shift of its own, are not
    compared one shift at a time."""
    rng = np.random.default_rng(8)
    b = rng.integers(0, 2**63, 8000).astype(np.uint64)
    a, places, runs = [], [], []
    for k in range(60):
        at = len(a)
        places.append((at + 20, 130 * k + 20, max(0, at - 20), at + 60))
        runs.append((at, at + 50))
        a += [*b[130 * k : 130 * k + 50], *rng.integers(0, 2**63, 80 + k).astype(np.uint64)]
    tried: list[int] = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            tried.append(1)
            return np.asarray(super().__getitem__(key))

    spans = passages.similar_spans(np.array(a, np.uint64), b.view(Counted), places, ordered=np.sort(b))
    assert len(spans) == 60
    assert all(s <= first and last <= e for (s, e), (first, last) in zip(spans, runs))
    assert len(tried) < 20  # of 60 shifts


def test_places_are_made_of_shared_signatures_only(spark):
    """The first pass brings signatures and ids alone; the second one leaves out
    what isn't shared before it leaves the task, and loses nothing that is."""
    docs = spark.createDataFrame(
        [(1, 11, " ".join(words(70, 1)).encode()), (2, 12, b"too short"), (3, 13, None), (4, 14, " ".join(words(900, 2)).encode())],
        "id long, uid long, text binary",
    )
    alone = passages._signature_rows(docs, passages.LEAST, passages.HASHES)
    assert alone.columns == ["sig", "id"]
    every = {r["sig"] for r in alone.collect()}
    for ids in ([1], [4], [1, 4]):
        several = alone.filter(alone["id"].isin(ids)).select("sig")
        places = passages._signature_rows(docs, passages.LEAST, passages.HASHES, several).collect()
        wanted = {r["sig"] for r in several.collect()}
        assert {r["uid"] - 10 for r in places if r["sig"] in wanted} == set(ids)
        assert wanted <= {r["sig"] for r in places}
        assert sum(r["sig"] not in wanted for r in places) <= 0.01 * len(every)
    assert passages._signature_rows(docs, passages.LEAST, passages.HASHES, alone.limit(0).select("sig")).collect() == []


def test_texts_that_repeat_themselves_are_compared_under_few_shifts(monkeypatch):
    """Every place of one text has every place of the other one as counterpart;
    where the first shifts show all windows, the others aren't tried."""
    line = np.random.default_rng(6).integers(0, 2**63, 50).astype(np.uint64)
    a, b = np.tile(line, 40), np.tile(line, 30)
    places = [(50 * i, 50 * j, max(0, 50 * i - 50), min(len(a) - 1, 50 * i + 50)) for i in range(40) for j in range(30)]
    tried: list[int] = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            tried.append(1)
            return np.asarray(super().__getitem__(key))

    assert passages.similar_spans(a, b.view(Counted), places, ordered=np.sort(b)) == [(0, len(a))]
    assert len(tried) < 20  # of 69 shifts


@pytest.mark.parametrize("kind", ["insert", "delete", "change"])
def test_recall_of_near_passages_at_the_production_setting(kind):
    found = sum(bool(passages.similar_spans(a, b, common_places(a, b))) for a, b in (near_pair(50, kind, seed) for seed in range(200)))
    assert found >= 0.985 * 200


def test_exact_oracle_at_small_scale(spark, sf_small):
    from aqlens.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    want = con.sql(queries.ORACLE["op2_exact_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op2_exact_dedup(spark, sf_small).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert want.equals(got[want.columns])


def test_passages_cover_exact_repeats(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    lower = lambda t: t.encode().lower().split()
    texts = {i: lower(t) for i, t in sorted(rows)}
    first: dict = {}
    need: dict = {i: set() for i in texts}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                need[i].update(range(k, k + 50))
    from aqlens.llm import queries

    got: dict = {i: set() for i in texts}
    for r in queries.op10_passages(spark, sf_small).collect():
        for s in filter(None, r["spans"].split(",")):
            a, b, _ = map(int, s.split(":"))
            got[r["doc_id"]].update(range(a, b))
    missed = sum(len(need[i] - got[i]) for i in texts)
    assert missed <= 0.001 * sum(map(len, need.values()))


def test_passage_tasks_give_memory_back(spark, monkeypatch):
    tasks = []
    monkeypatch.setattr(passages, "released", lambda run: tasks.append(run) or run, raising=False)
    assert len(marked(spark, {i: words(60, 1) if i else words(60, 2) for i in range(3)})) == 3
    assert len(tasks) == 3  # signatures, exact windows, open places
