import random
import re

import numpy as np

from scrivana.llm import components, neardup
from scrivana.llm.common import Scratch


def brute(rows):
    sets, parent = {}, {}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def result(spark, df):
    return sorted(tuple(r) for r in neardup.near_duplicates(spark, df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def corpus(rng):
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 120))] for _ in range(5)]
    rows = []
    for i in range(150):
        w = list(base[0] if i < 60 else rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w).upper() if i % 9 == 0 else "\n".join(w)))
    return rows + [(200, None), (201, ""), (202, " \t"), (203, "one two"), (204, "One  TWO"), (205, "two one"), (206, "É a b c d"), (207, "é a b c d")]


def test_against_brute_force(spark, clashing, monkeypatch):
    rows = corpus(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert result(spark, clashing(df)) == want
    # blocks so small that every bucket has several of them
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert result(spark, df) == want


def test_edges(spark, docs):
    assert result(spark, docs([])) == []
    assert result(spark, docs([None, "", " "])) == [(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True)]
    twice = docs(["a b c d e f"]).union(docs(["a b c d e f"]))
    assert result(spark, twice) == [(0, 2, 0, True)] * 2


def test_texts_of_one_id(spark):
    """Rows of one id with unlike texts are documents of their own: each keeps its links."""
    rng = random.Random(3)
    a, b = ([f"w{rng.randint(0, 900)}" for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (7, near(a)), (8, near(b)), (2, near(near(b).split()[::1])), (None, " ".join(a)), (9, None), (9, "")]
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (5, 2), (5, 2), (5, 5), (7, 5), (8, 2), (9, 9), (9, 9)]
    assert len({r.component for r in got if r.doc_id == 5}) == 2


def test_long_texts(spark):
    rng = random.Random(4)
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:100_000], "x", *w[100_000:]])), (3, "one " * 300_000), (4, "one " * 200_000), (5, "z" * 10**6)]
    got = result(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r[2] for r in got] == [1, 1, 3, 3, 5]


def test_an_odd_member_meets_a_large_group_once(spark, monkeypatch):
    """One member of another component in a bucket of n costs some n rows, not n * n / BLOCK."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    n = 400
    signature = np.zeros(neardup.HASHES, dtype=np.uint32).tobytes()
    signed = spark.createDataFrame([(i, bytearray(signature)) for i in range(n + 1)], "node long, signature binary")
    members = spark.createDataFrame([(77, 0, i, -(-(n + 1) // 8), i % 8) for i in range(n + 1)], "bucket long, band int, node long, n_blocks int, block int")
    components = spark.createDataFrame([(i, 0) for i in range(n)], "node long, component long")
    rows = []
    by_groups = neardup.by_groups

    def counted(df, keys, run, schema):
        rows.append(df.count())
        return by_groups(df, keys, run, schema)

    monkeypatch.setattr(neardup, "by_groups", counted)
    docs = spark.createDataFrame([(i, f"same words in all of them {'more' if i == n else ''}") for i in range(n + 1)], "doc_id long, text string")
    classes = spark.createDataFrame([(bytearray(b"x"), i, i) for i in range(n + 1)], "digest binary, least long, node long")
    neardup.later_links(members, signed, components, docs, classes, Scratch(spark, "t"))
    assert rows[0] <= n + -(-n // 8) + 1


def test_components_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 300)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    top = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert got == {x: t for x, t in top.items() if x in got} and {x for x in top if top[x] != x} <= set(got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (100, 101)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r[0]: r[1] for r in components.connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components.connected_components(df.where("a < 0"), Scratch(spark, "t")).count() == 0
