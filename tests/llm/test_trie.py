import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aqlens.llm import queries, trie

TURN = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _conversations(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, role, digest, text))
    return {c: [(t[2], t[4]) for t in sorted(own)] for c, own in convs.items()}


def _rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def _nodes(convs):
    """Every node by its whole sequence, in plain Python."""
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
            if d:
                children[tuple(own[: d - 1])].add(tuple(own[:d]))
        ends[tuple(own)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = own + sum(saved[x] for x in children[node])
    rows = [
        (
            min(members[x]), len(x), min(members[x[:-1]]) if x else None, len(members[x]), len(children[x]), leaves[x], saved[x],
            hashlib.sha256(",".join(map(str, sorted(ends[x]))).encode()).hexdigest(),
        )
        for x in members
    ]
    return sorted(rows, key=str)


def _rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def _trie(df, **kw):
    return trie.prefix_trie(trie.turns(df), **kw)


@pytest.fixture(scope="module")
def talk():
    """Copies, conversations that end within others, long ones that part late,
    a common first turn, nulls, ties and repeated rows."""
    rows = []
    say = lambda c, texts, at=0: rows.extend((c, at + k, "user" if k % 2 == 0 else "bot", t) for k, t in enumerate(texts))
    long = [f"turn {k} of a long talk" for k in range(45)]
    for c in range(40):
        say(c, ["hello there", "hi", f"question {c % 7}", "answer"][: 1 + c % 4])
    for c in range(40, 52):
        say(c, long[: 20 + c % 3 * 8] + [f"end {c % 2}"])
    say(52, long)
    say(53, long)
    say(54, long[:44] + ["another end of words"])
    say(-3, ["hello there"])
    rows += [(60, None, "user", "before all"), (60, 1, "user", None), (60, 1, None, "x"), (60, 1, None, "x"), (60, 2, "bot", "")]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None), (61, 5, "user", "word " * 30_000), (62, 5, "user", "word " * 30_000)]
    return rows


@pytest.mark.parametrize("block", [1, 3, 8])
def test_against_whole_sequences(spark, talk, block, monkeypatch):
    monkeypatch.setattr(trie, "LOT", 2)
    monkeypatch.setattr(trie, "CHUNK", 8)
    df = spark.createDataFrame(talk, TURN).repartition(5)
    assert _rows(_trie(df, block=block)) == _nodes(_conversations(talk))


def test_beyond_the_broadcast_bounds(spark, talk, monkeypatch):
    monkeypatch.setattr(trie, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(talk, TURN)
    turned, convs = trie.with_shared_heads(trie.turns(df))
    assert _rows(trie.prefix_trie(turned, convs)) == _nodes(_rebuilt(_conversations(talk)))


def test_one_conversation_over_many_tasks(spark):
    rows = [(7, k, "user", f"t {k}") for k in range(3000)] + [(8, k, "user", f"t {k}") for k in range(2000)]
    df = spark.createDataFrame(rows, TURN)
    turned = trie.turns(df)
    assert {(r["conv"], r["n"]) for r in trie.lengths(turned).collect()} == {(7, 3000), (8, 2000)}
    got = {r["depth"]: r for r in trie.prefix_trie(turned).collect()}
    assert len(got) == 3001 and got[2000]["n_convs"] == 2 and got[2001]["n_convs"] == 1
    assert got[0]["saved_tokens"] == 4000 and got[1500]["saved_tokens"] == 2 * 501 and got[2001]["saved_tokens"] == 0
    assert got[2000]["ends_sha256"] == hashlib.sha256(b"8").hexdigest() and got[3000]["n_children"] == 0


def test_turnless_and_absent_bases(spark):
    rows = [(c, k, "user", f"{c} {k}") for c in (21, 22, 40, 41, 42, 43, 44, 45, 46, 47) for k in range(c % 4)]
    rows += [(19, 0, "user", "only")]
    df = spark.createDataFrame(rows, TURN)
    turned, convs = trie.with_shared_heads(trie.turns(df))
    want = _nodes(_rebuilt(_conversations(rows)))
    assert _rows(trie.prefix_trie(turned, convs)) == want


def test_empty_table_and_other_columns(spark, talk):
    none = spark.createDataFrame([], TURN)
    assert _trie(none).collect() == []
    turned, convs = trie.with_shared_heads(trie.turns(none))
    assert trie.prefix_trie(turned, convs).collect() == []
    clash = spark.createDataFrame(talk, TURN).select("*", *[F.lit(k).alias(n) for k, n in enumerate("conv depth digest words k at up leaf value part row".split())])
    assert _rows(_trie(clash)) == _nodes(_conversations(talk))


def test_query_equals_sql_and_brute_force(spark, sf_small):
    path = f"{sf_small}/conversations.parquet"
    got = queries.op13_prefix_trie(spark, sf_small)
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(path).collect()]
    assert _rows(got) == _nodes(_rebuilt(_conversations(rows)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}')")
    want = con.sql(queries.ORACLE["op13_prefix_trie"])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    bag = lambda rows: sorted(tuple(str(x if x is None or isinstance(x, str) else int(x)) for x in r) for r in rows)
    assert bag(got.select(names).collect()) == bag(want.project(", ".join(names)).fetchall())
