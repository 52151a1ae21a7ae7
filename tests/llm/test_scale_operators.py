"""Shards, ranked search and hard negatives against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import lexical, negatives, sharding
from kindred.llm.common import stash


# --------------------------------------------------------------------------- shards
def sharded(spark, rows, ddl="doc_id long, text string, source string, lang string", **options):
    df = spark.createDataFrame(rows, ddl).repartition(5)
    return sharding.kd_shards(df, **{"dims": ["source", "lang", "doc_id"], **options})


def check_shards(rows, got, shards):
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return Counter({s: sum(r.size for r in got if r.shard == s) for s in range(shards)})


def test_shards_are_even_and_keep_equal_texts_together(spark):
    r = random.Random(1)
    rows = [(i, "x" * int(r.paretovariate(1.1) * 20 % 3000) + str(i), f"s{r.randrange(20)}", r.choice("abcd")) for i in range(3000)]
    rows += [(5000 + i, f"copy {i % 40}", f"s{i % 7}", "a") for i in range(400)]
    total = sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    got = sharded(spark, rows, shards=8).collect()
    size = check_shards(rows, got, 8)
    assert all(abs(s - total / 8) <= 3 * 3001 for s in size.values())
    at = defaultdict(set)
    for x in got:
        at[x.text].add(x.shard)
    assert all(len(s) == 1 for s in at.values())
    assert len(set(size.values())) > 1


def test_hot_copies_and_repeated_rows_are_split(spark):
    rows = [(7, "the same row", "s", "a")] * 1500 + [(i, "one hot text", f"s{i % 3}", "b") for i in range(1500)] + [(i, f"text number {i}", "s", None) for i in range(1000)]
    rows += [(None, None, None, None), (None, "", None, None), (3, "é" * 5, "s", "a")]
    size = check_shards(rows, sharded(spark, rows, shards=5).collect(), 5)
    assert max(size.values()) - min(size.values()) < 60


def plain_shards(rows, leaves):
    """Shard by row: widest dimension of a node as a part of the root's width, cut nearest to the goal."""
    value = {i: (float(zlib.crc32(s.encode())), float(d), math.log2(len(t) + 1)) for i, (d, t, s) in enumerate(rows)}
    lo, hi = ([f(v[k] for v in value.values()) for k in range(3)] for f in (min, max))
    q = {i: [int((v[k] - lo[k]) / (hi[k] - lo[k]) * (2**32 - 1)) for k in range(3)] for i, v in value.items()}
    out, width = {}, [max(1, max(v[k] for v in q.values()) - min(v[k] for v in q.values())) for k in range(3)]

    def cut(ids, first, leaves):
        if leaves == 1:
            out.update(dict.fromkeys(ids, first))
            return
        part = [(max(q[i][k] for i in ids) - min(q[i][k] for i in ids)) / width[k] for k in range(3)]
        k = part.index(max(part))
        ids = sorted(ids, key=lambda i: q[i][k])
        total = sum(len(rows[i][1]) + 1 for i in ids)
        goal, sums, n = total * (leaves // 2) / leaves, 0, 0
        while sums + len(rows[ids[n]][1]) + 1 < goal:
            sums += len(rows[ids[n]][1]) + 1
            n += 1
        if not goal - sums < sums + len(rows[ids[n]][1]) + 1 - goal:
            n += 1
        cut(ids[:n], first, leaves // 2)
        cut(ids[n:], first + leaves // 2, leaves - leaves // 2)

    cut(list(value), 0, leaves)
    return {rows[i][0]: s for i, s in out.items()}


@pytest.mark.parametrize("leaves", [2, 7, 8])
def test_tree_equals_plain_version(spark, leaves):
    r = random.Random(leaves)
    size = r.sample(range(40, 900), 300)  # no ties in any dimension
    rows = [(d, "y" * n, f"k{d}") for d, n in zip(r.sample(range(10**6), 300), size, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # each text is of its own and small against a shard's part only where groups are whole: every row stands for itself
    got = {x.doc_id: x.shard for x in sharding.kd_shards(df, shards=leaves, dims=["source", "doc_id"]).collect()}
    assert got == plain_shards(rows, leaves)


def test_shard_edges_and_files(spark, tmp_path):
    assert sharded(spark, [], shards=8).collect() == []
    assert {x.shard for x in sharded(spark, [(1, "only", "s", "a")], shards=8).collect()} <= set(range(8))
    rows = [(i, f"t{i}" * (i % 9), 5, "keep") for i in range(200)]
    got = sharded(spark, rows, "doc_id long, text string, shard int, _n string", dims=["doc_id"], target_bytes=300)
    assert got.columns == ["doc_id", "text", "_n", *sharding.OUT] and {x._n for x in got.collect()} == {"keep"}
    n = len({x.shard for x in got.collect()})
    assert n == -(-sum(len(x[1]) + 1 for x in rows) // 300)
    sharding.write_shards(stash(got), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((x.doc_id, x.shard, x.slot) for x in back) == sorted((x.doc_id, x.shard, x.slot) for x in got.collect())
    some = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int, _n string"), shards=4, columns=["_n"])
    assert some.columns == ["_n", *sharding.OUT] and some.count() == 200
    with pytest.raises(ValueError):
        sharding.kd_shards(got, shards=0)


# --------------------------------------------------------------------------- ranked search
def plain_search(docs, items, most=50):
    words = lambda t: re.findall(lexical.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(d, Counter(words(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        terms = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(words(text)) if df[t]}
        found = []
        for d, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // total if c else 0
            s = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in terms.items() if c[t])
            if s > 0:
                found.append((-s, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(found[:most])]
    return sorted(out, key=str)


def searched(spark, docs, items, **options):
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted(map(tuple, got.collect()), key=str)


def test_search_equals_plain_version(spark, monkeypatch):
    r = random.Random(2)
    vocab = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)] + ["Über", "naïve", "A1", "ÉCOLE", "日本", "x"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", "-", "_q"]) for _ in range(n))
    docs = [(i, text(int(r.paretovariate(0.8) * 4) % 400)) for i in range(1500)]
    docs += [(2000 + i, docs[3][1]) for i in range(200)] + [docs[3]] * 3 + [(None, docs[3][1]), (3000, None), (3001, ""), (3002, "... --"), (3003, text(40_000))]
    items = [(i, text(30)) for i in range(8)] + [(20, docs[3][1]), (21, None), (22, " ; "), (23, "nowhere to be seen"), (5, "w1 w1 W1")]
    items += [(30 + i, text(20) + " " + " ".join(f"missing{r.randrange(10**6)}" for _ in range(60))) for i in range(6)]
    want = plain_search(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, most=3) == plain_search(docs, items, 3)
    monkeypatch.setattr(lexical, "BLOCK", 60)  # several readings of the documents
    assert searched(spark, docs, items) == want


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a b")], []) == [] and searched(spark, [(1, None)], [(1, "a")]) == []
    extra = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, score string, item_id string")
    assert [tuple(x) for x in lexical.search(extra, spark.createDataFrame([(4, "b")], "item_id long, text string")).collect()] == plain_search([(1, "a b")], [(4, "b")])


def test_bounds_leave_documents_unopened():
    r = np.random.default_rng(3)
    size = r.integers(20, 400, 4000)
    t = np.repeat(np.arange(30), 400)
    d = np.concatenate([r.choice(4000, 400, replace=False) for _ in range(30)])
    f = r.integers(1, 4, len(d))
    f[5] = 500  # one document far above the others
    tree = lexical.MaxTree(t, d, f, 50 + size // 4, size, np.full(30, 900), 20)
    opened = []
    count, tree._children = tree._children, lambda level, e: (opened.append(level), count(level, e))[1]
    places = lexical.Places(1)
    tree.search(np.arange(3), places, np.arange(4000), np.zeros(4000, bool))
    add = 900 * ((10**9 * f) // (1000 * f + 20 * (50 + size[d] // 4)))
    total = np.bincount(d[t < 3], add[t < 3], 4000)
    assert places.score[0] == total.max() and places.id[0] == total.argmax()
    assert opened.count(1) < 4000 / lexical.LEAF / 4


# --------------------------------------------------------------------------- hard negatives
def plain_negatives(rows, positives=5, negatives=10):
    keep = [(n, i, lab, [math.floor(256 * float(x)) for x in v]) for n, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, lab, v in keep:
        if i % 100:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m, other) for m, j, other, w in keep if m != n)
        for ps, p, _, _ in [x for x in s if x[3] == lab][:positives]:
            fit = [x for x in s if x[3] != lab and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:negatives]
            out += [(i, p, k + 1, j, -ps, -ns) for k, (ns, j, _, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    got = negatives.mine_hard_negatives(df.repartition(3), F.col("vec_id") % 100 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_negatives_equal_plain_version(spark, monkeypatch):
    r = np.random.default_rng(5)
    center = r.normal(size=(4, 10))
    rows = []
    for i in range(600):
        lab = int(i % 3 and r.integers(4))  # one label has more than a third
        rows.append((i, (center[lab] * 0.3 + 0.2 + r.normal(size=10) * 0.2).astype(np.float32).tolist(), lab))
    rows += [rows[100], rows[100], rows[31], rows[31], (300, rows[7][1], 2)]  # repeated rows and ids
    rows += [(700, None, 1), (None, rows[0][1], 1), (701, rows[0][1], None), (800, [float("nan")] * 10, 1), (801, [None, 1.0], 1), (802, [float("inf")], 1), (900, [], 1), (903, [0.5, 0.5], 2), (904, [0.1] * 70, 3), (1000, rows[5][1], -7), (1100, [-1.0] * 10, 0)]
    want = plain_negatives(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    for name, size in (("ANCHORS", 3), ("ROWS", 40), ("GROUPS", 3)):  # many blocks
        monkeypatch.setattr(negatives, name, size)
    assert mined(spark, rows, dimensions=4) == want
    assert mined(spark, rows, "double", dimensions=3, positives=2, negatives=4) == plain_negatives(rows, 2, 4)


def test_negatives_of_large_numbers_are_exact(spark):
    rows = [(i, [3e4 + i / 7, -2e4 + i / 3, 1e4, float(i)], i % 2) for i in range(120)]
    assert mined(spark, rows, "double") == plain_negatives(rows) and mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == []
