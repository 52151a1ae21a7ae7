"""Language, toxicity, packing, quality and licences against brute force, held-out accuracy and edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import language, licenses, packing, quality, toxicity
from kindred.llm.common import fold5

SYLLABLES = {"en": ["the", "ing", "er", "wh", "tion"], "de": ["sch", "ein", "ung", "ß", "ver"], "fr": ["eau", "eux", "é", "que", "oi"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy_and_edges(spark):
    r = random.Random(3)
    rows = [(i, prose(r, lang, r.randint(3, 400)), lang, "x") for i, lang in enumerate(r.choices(list(SYLLABLES), k=300))]
    rows += [(1000, None, "en", "x"), (1001, "12 !! 34", "de", "x"), (None, prose(r, "fr", 50), None, "x"), (1002, prose(r, "de", 30), None, "x"), (1002, rows[0][1], None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.identify_language(df, learn=fold5("doc_id") != 0).withColumn("held", fold5("doc_id") == 0).collect()
    held = [g for g in got if g.held and g.lang and g.text]
    assert len(got) == len(rows) and np.mean([g.lang == g.lang_pred for g in held]) > 0.95
    assert {(g.lang_pred, g.score) for g in got if g.doc_id in (1000, 1001)} == {("und", 0.0)}
    assert all(0 <= g.score <= 1 for g in got)
    assert {r.lang_pred for r in language.identify_language(df.where("lang is null")).collect()} == {"und"}
    assert language.identify_language(df.limit(0)).count() == 0


def test_language_long_texts_many_languages_and_clashing_columns(spark):
    r = random.Random(9)
    letters = [chr(97 + k) + chr(97 + (k * 7 + 3) % 26) for k in range(26)]
    names = [f"l{k:02}{v}" for k in range(26) for v in "abc"]  # more than 64
    word = lambda n: letters[int(n[1:3])] + n[3] * 2
    rows = [(i, " ".join([word(n)] * 40), n) for i, n in enumerate(names * 6)]
    rows += [(9000, ("noise " * 3 + word("l05b") + " ") * 60_000, None), (9001, rows[0][1], None), (9001, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS _text", "'z' AS _letter", "0 AS SCORE")
    texts, labels = language.sample(df, doc_id="doc_id", text="text", lang="lang", learn=F.lit(True), per_language=2, crop=50)
    assert set(labels) == set(names) and max(map(len, texts)) == 50 and max(labels.count(n) for n in names) == 2
    starts = df.where("lang IS NOT NULL").selectExpr("doc_id", "lang", "array_join(transform(sequence(1, 2000), x -> lpad(string(x), 4, '0')), ' ') AS text")
    at = [int(t[:4]) if t[:4].isdigit() else int(t.split()[1].decode()) for t in language.sample(starts.selectExpr("doc_id", "'one' AS lang", "concat('a ', text) AS text"), doc_id="doc_id", text="text", lang="lang", learn=F.lit(True), per_language=20, crop=50)[0]]
    assert len(at) == 20 and min(at) < 700 and max(at) > 1300  # crops of few rows out of many lie everywhere
    out = language.identify_language(df, per_language=2, crop=50)
    assert out.columns == ["doc_id", "text", "lang", "_text", "_letter", "lang_pred", "score"]
    got = out.where("doc_id >= 9000").collect()
    assert len(got) == 3 and len({g.score for g in got if g.doc_id == 9001}) == 1 and {(g._text, g._letter) for g in got} == {(1, "z")}


def test_convolution_equals_loops():
    net = language.train([b"abc def", b"xyz uvw"], ["a", "b"], steps=3)
    x = np.frombuffer(b"hello world of bytes", np.uint8)[None]
    z = np.full(len(net.bias), -np.inf)
    padded = np.r_[x[0], np.zeros(8, np.uint8)]
    for f in range(len(z)):
        width = language.WIDTHS[f // language._F]
        for t in range(x.shape[1]):
            z[f] = max(z[f], sum(float(net.embed[padded[t + j]] @ net.conv[j * language._E : (j + 1) * language._E, f]) for j in range(width)))
    s = np.maximum(z + net.bias, 0) @ net.out + net.out_bias
    p = np.exp(s - s.max())
    assert np.allclose(net.probabilities(x)[0], p / p.sum(), atol=1e-5)


def test_toxicity_finds_inflected_words(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        lang = r.choice(["en", "de"])
        words = prose(r, lang, r.randint(20, 200)).split()
        toxic = int(r.random() < 0.25)
        if toxic:
            for _ in range(max(1, len(words) // 20)):
                words.insert(r.randrange(len(words)), r.choice(["moron", "Moron,", "scumbag", "scumlike", "scumish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(900, None), (901, ""), (0, rows[0][1])]
    labels += [(5, None), (None, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, marks).withColumn("held", fold5("doc_id") == 0).collect()
    truth = dict(labels[:600])
    held = [g for g in got if g.held and g.doc_id in truth]
    assert np.mean([g.predicted == truth[g.doc_id] for g in held]) > 0.97
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got) and len(got) == len(rows)
    none = toxicity.score_toxicity(docs, marks.limit(0)).collect()
    assert {(g.score, g.predicted) for g in none} == {(0.0, 0)}
    assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0


def test_toxicity_of_short_and_wholly_toxic_texts(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words, toxic = prose(r, r.choice(["en", "de"]), r.randint(20, 100)).split(), int(r.random() < 0.3)
        for _ in range(max(2, len(words) // 10) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["moron", "scumbag", "trash"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    toxic = ["moron", "Trash, moron scumbag!", "the moron and the trash", "moron scumbag trash " * 40]
    rows += [(1000 + i, t) for i, t in enumerate(toxic)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {g.doc_id: g for g in toxicity.score_toxicity(docs, marks).where("doc_id >= 1000").collect()}
    assert all(g.evidence > 0.2 and g.predicted == 1 for g in got.values()), got


def brute_ratio(texts, words, context=toxicity.CONTEXT):
    """log p_toxic - log p_ordinary of each word, by dictionaries."""
    n, END = [{}, {}], 32
    split = lambda t: [w for w in (x.strip(b".,;:!?\"'()[]{}*#$%&|<>-_/\\~`^+=") for x in t.lower().encode().split()) if w]
    steps = lambda w: [((w[max(0, j - context) : j], min(j, context + 1)), w[j - 1] if j else END, w[j] if j < len(w) else END) for j in range(len(w) + 1)]
    for t, toxic in texts:
        for w in split(t):
            for u, v, x in steps(w):
                n[toxic][u, v, x] = n[toxic].get((u, v, x), 0) + 1
    both = {k: n[0].get(k, 0) + n[1].get(k, 0) for k in n[0].keys() | n[1].keys()}
    discount = lambda c: sum(v == 1 for v in c.values()) / max(1, sum(v == 1 for v in c.values()) + 2 * sum(v == 2 for v in c.values())) or 0.5
    d0, d1, d = discount(n[0]), discount(n[1]), discount(both)
    out = {}
    for word in words:
        s = 0.0
        for u, v, x in steps(word.encode()):
            total = [sum(c for k, c in m.items() if k[0] == u) for m in n]
            if not total[0] or not total[1] or (u, v, x) not in both:
                continue
            free = sum(k[1:] == (v, x) for k in both) / sum(k[1] == v for k in both)
            shared = (both[u, v, x] - d + d * sum(k[0] == u for k in both) * free) / sum(total)
            p = [(max(m.get((u, v, x), 0) - off, 0) + (toxicity.STRENGTH + off * sum(k[0] == u for k in m)) * shared) / (t + toxicity.STRENGTH) for m, off, t in zip(n, (d0, d1), total, strict=True)]
            s += math.log(p[1] / p[0])
        out[word] = s
    return out


def test_toxicity_evidence_equals_brute_force(spark):
    r = random.Random(3)
    texts = [(prose(r, r.choice(["en", "de", "fr"]), r.randint(1, 30)) + (" moron, (scumbag)" * (i % 4 == 0)), int(i % 4 == 0)) for i in range(80)]
    texts += [("", 1), ("antidisestablishmentarianism antidisestablishment " * 2, 0), ("antidisestablishmentarian 'anti'", 1)]
    train = spark.createDataFrame(texts, "_text string, _toxic int").repartition(4)
    ratios = toxicity.log_ratios(toxicity.count_events(train)).cache()
    words = ["moron", "scumbag", "scum", "the", "antidisestablishmentarianism", "unseenword"]
    want = brute_ratio(texts, words)
    docs = spark.createDataFrame([(w, w) for w in words] + [("all", " ".join(words)), ("none", " ... ")], "name string, text string")
    for blocks in (1, 3):  # the documents pass one block of the ratios after the other
        got = {g.name: g.e for g in toxicity.add_evidence(docs, ratios, blocks, "text", "e").collect()}
        for w in words:
            assert got[w] == pytest.approx(math.log1p(toxicity.RATE * math.expm1(want[w])), rel=1e-4, abs=1e-7), w
        assert got["all"] == pytest.approx(sum(got[w] for w in words) / len(words), rel=1e-6) and got["none"] == 0
    assert want["moron"] > 2 and abs(want["the"]) < 1


def test_toxicity_edge_cases(spark):
    r = random.Random(4)
    rows = [(i, prose(r, "en", 30) + (" moron trash" if i % 3 == 0 else "")) for i in range(300)]
    extra = [(1000, "moron"), (1000, "moron"), (1001, ""), (None, None), (1002, "word " * 300_000 + "moron " * 30_000), (1003, "x" * 2_000_000), (1004, "... !")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "doc_id AS _text", "'kept' AS _toxic", "1 AS SCORE", "2 AS _sums")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None), (None, 1), (1003, 7)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, marks, block=300)
    assert got.columns == ["doc_id", "text", "_text", "_toxic", "_sums", "evidence", "score", "predicted"]
    found = got.where("doc_id >= 1000 OR doc_id IS NULL").collect()
    assert len(found) == len(extra) and all(g["_toxic"] == "kept" and g["_text"] == g["doc_id"] for g in found)
    by = {g.doc_id: g for g in found}
    assert by[1000].predicted == 1 and by[1002].predicted == 1 and by[1001].evidence == by[None].evidence == by[1004].evidence == 0
    assert all(0 <= g.score <= 1 for g in found) and by[1001].predicted == 0 and by[1003].predicted == 0
    assert len({g.score for g in found if g.doc_id == 1000}) == 1


def test_toxicity_words():
    def of(t):
        b = np.frombuffer(t.encode(), np.uint8)
        return [bytes(b[s:e]).decode() for s, e, _ in zip(*toxicity.words(b, np.array([0, len(b)])), strict=True)]

    assert of("abc (abcd), 'x.y' -- ...") == ["abc", "abcd", "x.y"]
    assert of("ab今b-c 한국어말씀") == ["ab", "今b-", "b-c", "한국어말씀"]
    assert "笨蛋" in of("他是笨蛋") and len(of("今天天气很好")) == 6  # also at the end of a clause


def tokenizer():
    files = pytest.importorskip("public_tokenizers")
    return packing.byte_bpe(str(files.path("byte_bpe_50k.json")), str(files.path("byte_bpe_50k.tiktoken")), files.PATTERN), files


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    load, files = tokenizer()
    exact = Tokenizer.from_file(str(files.path("byte_bpe_50k.json")))
    r = random.Random(2)
    rows = [(i, prose(r, r.choice(list(SYLLABLES)), r.choice([0, 1, 5, 80, 400, 900]))) for i in range(60)]
    rows += [(70, None), (71, "<|endoftext|> x"), (72, "  a\n\n b\t\u00a0c "), (73, "日本語 🙂 \u200b"), (0, rows[0][1]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, tokenizer=load, size=64, group=200).collect()
    tokens = {}
    for i, t in rows:
        tokens.setdefault(i, []).append([*exact.encode(t or "", add_special_tokens=False).ids, 2])
    want = []
    for i, copies in tokens.items():
        for ids in copies:
            first = len(ids) % 64 or 64
            cuts = [0, *range(first, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
            want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(g[:5]) for g in got), key=key) == sorted(want, key=key)
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64
    total = sum(w[3] for w in want)
    assert len(by) <= 1.05 * total / 64 + 3
    assert packing.pack(df.limit(0), tokenizer=load).count() == 0


def test_sum_of_squares_choice():
    r = random.Random(1)
    s = packing.SumOfSquares(20)
    gaps = []
    for _ in range(400):
        n = r.randint(1, 20)
        before = list(gaps)
        _, off = s.place(n)
        options = [g for g in set(before) if g >= n]

        def after(g, n=n, before=before):
            left = list(before)
            left.remove(g)
            left += [g - n] if g > n else []
            return sum(left.count(x) ** 2 for x in set(left))

        if options:
            assert after(20 - off) == min(map(after, options))
            gaps.remove(20 - off)
        else:
            assert off == 0
        if 20 - off - n:
            gaps.append(20 - off - n)


def brute_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    cover = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            cover |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality_counts_and_verdicts(spark):
    r = random.Random(8)
    texts = [None, "", "\n\n", "a", "x\ny\nx\n\nx", "é ü\x0bb\u00a0c " * 4]
    for _ in range(120):
        line = prose(r, "fr", r.randint(1, 12))
        texts.append("\n".join(r.choice([line, prose(r, "de", r.randint(1, 9)), "# & |"]) for _ in range(r.randint(1, 12))))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)] + [(7, None)], "doc_id long, quality int")
    got = quality.quality_rules(df, labels).collect()
    assert len(got) == len(rows)
    for g in got:
        want = brute_counts(g.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, g.text
        assert g.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (g.base_failed and g.kept)
    assert quality.quality_rules(df.limit(0), labels).count() == 0


def test_binomial_bound_and_certification():
    for k, n in ((0, 50), (3, 200), (7, 100)):
        p = quality.upper_bound(k, n, 0.01)
        import math

        assert abs(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - 0.01) < 1e-6
    assert quality.upper_bound(30_000, 1_000_000, 0.01) == pytest.approx(0.0304, abs=1e-4) and quality.upper_bound(5, 5, 0.01) == 1
    table = quality.ladder({(0, 0, 2, 1): 20_000, (0, 0, 5, 1): 10, (0, 0, 60, 0): 500, (0, 0, 2, 0): 100})
    assert table[0, 0, 0] == 6 and table[0, 1, 0] == 3 and (table[0, :, 1:] == quality.BINS + 1).all() and (table[1:] == quality.BINS + 1).all()
    none = len(quality.LADDER)
    counts = {(0, none, 1): 995, (0, 1, 1): 1, (0, 3, 1): 40, (0, 0, 0): 9, (1, none, 1): 30, (2, none, 1): 600, (3, 0, 1): 9, (3, none, 1): 500}
    assert quality.certify(counts, 0.01, 0.05) == [2, -1, none - 1, -1, -1]


def brute_limits(rows, labels, risk, delta, third):
    """Cutoffs by trying every rung on every labelled text; ``rows`` are distinct ids with texts."""
    def stats(t):
        n, chars, sym, dup, rep = brute_counts(t)
        share = [sym / max(chars, 1), dup / (dup + 3), rep / max(n, 1), min(1, max(0, 1 - chars / max(n, 1) / 12))]
        return sum(n >= e for e in (50, 200, 800, 3200)), [min(int(x * 100), 100) for x in share], n < 10 or 100 * rep > 20 * n

    seen = [(third[i] == 0, labels[i], *stats(t)[:2]) for i, t in rows if i in labels and not stats(t)[2]]
    limits = []
    for s in range(5):
        choose, hold = ([(g, x) for c, g, k, x in seen if k == s and c == want] for want in (True, False))
        nested = []
        for share in quality.LADDER:
            cut = []
            for k in range(4):
                good, bad = ([x[k] for g, x in choose if g == want] for want in (1, 0))
                fits = [c for c in range(1, 101) if sum(v >= c for v in good) <= share * len(good) and sum(v >= c for v in bad) * len(good) > sum(v >= c for v in good) * len(bad)]
                cut.append(min(fits, default=101))
            nested.append(cut)
        best = [101] * 4
        for cut in nested:
            lost = sum(g == 1 and any(v >= c for v, c in zip(x, cut, strict=True)) for g, x in hold)
            n = sum(g for g, _ in hold)
            p = risk  # certified if so few losses are unlikely at this rate
            if not n or sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(lost + 1)) > delta / 5:
                break
            best = cut
        limits.append(best)
    return limits, stats


def test_quality_verdicts_equal_brute_force(spark):
    r = random.Random(21)
    rows = []
    for i in range(900):
        words = prose(r, r.choice(["en", "de", "fr"]), r.choice([12, 30, 45, 60, 120])).split()
        junk = r.random() < 0.3
        if junk:
            words = [w + r.choice(["###", "$", "%%", "", ""]) for w in words]
        rows.append((i, " ".join(words), int(not junk or r.random() < 0.01)))
    docs = spark.createDataFrame([x[:2] for x in rows] + [(5000, "# $ % " * 10), (None, None), (5001, "ab " * 400_000)], "doc_id long, text string").repartition(3).selectExpr("*", "7 AS _text", "8 AS KEPT")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows[:800]] + [(3, None), (None, 1)], "doc_id long, quality int")
    third = {x.id: x.k for x in spark.range(900).selectExpr("id", "pmod(xxhash64(id), 3) AS k").collect()}
    limits, stats = brute_limits([x[:2] for x in rows], {i: g for i, _, g in rows[:800]}, 0.05, 0.2, third)
    out = quality.quality_rules(docs, labels, risk=0.05, delta=0.2)
    assert out.columns == ["doc_id", "text", "_text", *quality._COUNTS, "base_failed", "kept"]
    got = {g.doc_id: g for g in out.collect()}
    assert len(got) == len(rows) + 3 and got[5001].base_failed and got[None].base_failed
    for i, t, _ in rows:
        s, x, failed = stats(t)
        assert got[i].kept == (not failed and all(v < c for v, c in zip(x, limits[s], strict=True))), i
    assert any(not g.kept and not g.base_failed for g in got.values())


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    messy = "Copyright (c) 2019 Some Body\nAll rights reserved.\n\n" + mit.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "non-infringement").replace("\n", "\r\n  ").replace('"', "“")
    rows = [(1, mit), (2, messy), (3, mit + " and more"), (4, None), (5, ""), (6, "released under the mit licence!"), (7, "Copyright 2020 x")]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.KNOWN).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "MIT notice", 7: None}


def test_licences_with_clashing_columns_long_and_repeated_texts(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, mit), (1, mit), (2, "word " * 400_000), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _digest", "2 AS DIGEST", "3 AS _own", "4 AS license")
    got = licenses.scan_licenses(df, licenses.KNOWN)
    assert got.columns == ["doc_id", "text", "_digest", "_own", "digest", "license", "is_license"]
    assert sorted((g.doc_id, g._digest, g._own, g.license or "") for g in got.collect()) == [(1, 1, 3, "MIT")] * 2 + [(2, 1, 3, ""), (3, 1, 3, "")]
    assert [g.license for g in licenses.scan_licenses(df.where("doc_id = 1").selectExpr("text AS license"), licenses.KNOWN, text="license").collect()] == ["MIT", "MIT"]
    assert licenses.scan_licenses(df.limit(0), licenses.KNOWN).count() == 0


def test_common_whole_licence_texts_are_known(spark):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    rows = [(n, "Copyright (c) 2020 Somebody\n\n" + licenses.KNOWN[n].upper().replace("\n", "\n  ")) for n in names]
    rows += [("", licenses.KNOWN[n][: len(licenses.KNOWN[n]) // 2]) for n in names]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "name string, text string"), licenses.KNOWN).collect()
    assert [(g.license or "", g.is_license) for g in got] == [(n, n != "") for n, _ in rows]
    duckdb = pytest.importorskip("duckdb")
    sql = f"SELECT sha256({licenses.canonical_sql('?')})"
    assert [g.digest for g in got] == [duckdb.execute(sql, [t]).fetchone()[0] for _, t in rows]
