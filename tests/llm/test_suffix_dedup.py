import hashlib
import random

import numpy as np
import pytest

from kindred.llm import suffix_dedup as S


def brute(docs, length):
    """(n_bytes, n_removed, n_spans, sha) per (id, text), by a dictionary of all strings."""
    first, out = {}, {}
    rows = sorted({(-(2**63) if i is None else i, t or "") for i, t in docs}, key=lambda x: x[0])
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (i, p))
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] != (i, p):
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-1]][: len(b)]).sum()) if len(b) else 0
        out[i, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "é", "ing", "a"]) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(40) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages)[r.randint(0, 30) :], text(r.randint(0, 30))]
        docs.append((i, " ".join(parts)))
    docs += [(n + i, docs[r.randrange(n)][1]) for i in range(10)]
    docs += [(n + 20, "ab" * 400), (n + 21, "z" * 700), (n + 22, "line of text\n" * 90), (n + 23, None), (n + 24, ""), (n + 25, "x" * 99), (n + 26, "y" * 100)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "split"), [(1, 20_000), (2, 3)])
def test_equals_brute_force(spark, seed, split):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(df, bucket=split).collect()}
    want = {i: v for (i, _), v in brute(docs, 100).items()}
    assert got == want


def test_long_texts_in_parts(spark):
    r = random.Random(5)
    t = "".join(r.choice("abcdefgh ") for _ in range(1_200_000))
    docs = [(1, t), (2, "zz" + t[500_000:600_000] + "yy" + t[1_150_000:])]
    got = {r.doc_id: r for r in S.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0
    assert (got[2].n_removed, got[2].n_spans, bytes(got[2].kept)) == (150_000, 2, b"zzyy")


def test_edges(spark):
    x = " ".join(str(i * 7919) for i in range(60))
    rows = [(None, x, "a"), (3, x, "b"), (3, x, "b"), (5, None, None), (6, "short", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    got = S.suffix_dedup(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.n_removed) for r in got] == [(None, len(x), 0), (3, len(x), len(x)), (3, len(x), len(x)), (5, 0, 0), (6, 5, 0)]
    assert S.suffix_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="length"):
        S.suffix_dedup(df, length=10)


def test_blind_tries_sort_suffixes():
    r = np.random.default_rng(0)
    base = r.integers(97, 99, 40).astype(np.uint8)
    rows, starts, data = 30, [], []
    for _ in range(rows):
        for _ in range(6):
            x = base.copy()
            x[r.integers(0, 40, 2)] = 99
            starts.append(len(data))
            data += x.tolist()
    data = np.array(data + [0] * 8, np.uint8)
    word = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))
    st = np.array(starts).reshape(rows, 6)
    order, lcp = S.blind_tries(data, word, st, 0, [0, 8, 16, 24, 32], 40)
    for i in range(rows):
        got = [data[st[i, o] : st[i, o] + 40].tobytes() for o in order[i]]
        assert got == sorted(got)
        for a, b, n in zip(got, got[1:], lcp[i], strict=False):
            assert n == next((k for k in range(40) if a[k] != b[k]), 40)


def test_clashing_columns_stay(spark):
    a = "".join(random.Random(1).choices("abcdefgh", k=150))
    rows = [(2, "x" + a), (1, a + "y"), (None, "")]
    df = spark.createDataFrame(rows, "_id long, _text string").selectExpr("*", "1 AS _th", "2 AS spans_", "3 AS n_bytes", "4 AS kept")
    got = S.suffix_dedup(df, doc_id="_id", text="_text", kept="text")
    assert got.columns == ["_id", "_text", "_th", "spans_", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
    assert {(g._id, g._th, g.spans_, g.n_bytes, g.n_removed, g.kept) for g in got.collect()} == {(None, 1, 2, 0, 0, ""), (1, 1, 2, 151, 0, a + "y"), (2, 1, 2, 151, 150, "x")}
