import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from kindred.llm import common, queries


def test_stages_on_a_small_corpus(spark, tmp_path):
    r = random.Random(1)
    vocab = [f"{a}{b}{c}" for a in ("th", "er", "wh") for b in ("ing", "on", "at") for c in ("", "ed", "ly", "s")]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", str(r.randrange(90))]) for _ in range(n))
    base, item, shared = text(200), text(40), text(60)
    docs = [(i, text(80), "en", "s", 1) for i in range(20)]
    docs += [(30, base, "en", "s", 1), (31, base + " extra", "en", "s", 1), (32, text(30) + " " + item + " " + text(9), "en", "s", 1)]
    docs += [(40, text(50) + shared, "en", "s", 1), (41, text(50) + shared, "en", "s", 1), (50, None, "en", "s", 0), (51, "123 456", "en", "s", 7), (0, docs[0][1], "en", "s", 1)]
    docs += [(60 + i, "eau réeux " * 5 + text(20), "fr", "s", 1) for i in range(10)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    df, at = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, df, d)
        if name != P.STAGES[-1][0]:
            assert out.columns == df.columns and out.dtypes == df.dtypes
        out.write.parquet(f"{d}/{name}")
        df = spark.read.parquet(f"{d}/{name}")
        at[name] = [row.asDict() for row in df.collect()]
    ids = {name: {row["doc_id"] for row in rows} for name, rows in at.items()}
    assert ids["language_id"] == {x[0] for x in docs} - {50, 51}
    assert ids["ngram_jaccard_join"] == ids["language_id"] - {31} and len(at["ngram_jaccard_join"]) == len(ids["ngram_jaccard_join"])
    cut = {row["doc_id"]: row for row in at["suffix_dedup"]}
    assert shared in cut[40]["text"] and shared not in cut[41]["text"] and cut[41]["n_chars"] == len(cut[41]["text"])
    assert ids["benchmark_decontamination"] == ids["suffix_dedup"] - {32} == ids["best_fit_packing"]
    assert P.run(spark, d).agg(F.sum("length")).first() == spark.read.parquet(f"{d}/best_fit_packing").agg(F.sum("length")).first()


def test_run_passes_each_document_through_a_stage_once(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["the", "and", "there", "where", "tion", "thing"]) + r.choice(["", "s", "ed"]) + str(r.randrange(50)) for _ in range(n))
    docs = [(i, text(60), "en", 1) for i in range(120)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, text(40))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    passed = spark.sparkContext.accumulator(0)

    def counted(spark, docs, sf_dir):
        def rows(batches):
            for b in batches:
                passed.add(len(b))
                yield b

        out = P.language_stage(spark, docs, sf_dir)
        return out.mapInPandas(rows, out.schema)

    monkeypatch.setattr(P, "STAGES", [("language_id", counted), *P.STAGES[1:]])
    assert P.run(spark, d).select("doc_id").distinct().count() == 120
    assert passed.value == 120


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["kept", "_lang", "_score", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256", "lang_pred", "component_id", "n_links", "first", "n"]
    long = " ".join(f"longword{i}" for i in range(30_000))  # a very long text
    texts = ["the rest of the thing there " * 8 + str(i) for i in range(6)] + [long, None, ""]
    docs = [(i, t, "en", *[f"{c} {i}" for c in names]) for i, t in enumerate(texts)] + [(None, "another thing that was there and then not", "en", *["x"] * len(names))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in names))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = df.where("false")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert all(row[c] == (f"{c} {row.doc_id}" if row.doc_id is not None else "x") for row in out.collect() for c in names), name
        if name != "language_id":  # which needs rows to learn from
            assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_near_duplicate_stage_leaves_most_texts_in_place(spark, tmp_path):
    r = random.Random(2)
    docs = [(i, " ".join(f"{r.getrandbits(60):x}" for _ in range(200))) for i in range(500)]
    docs += [(600 + i, docs[i][1] + " end") for i in range(20)] + [docs[7], (None, docs[8][1]), (None, docs[9][1]), (8, "two of one id")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    out = P.near_duplicate_stage(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
    spark.sparkContext.setJobGroup("stage", "stage")
    out.write.parquet(f"{tmp_path}/out")
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in spark.sparkContext.statusTracker().getJobIdsForGroup("stage") for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    shuffled = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    got = sorted(((x.doc_id, x.text) for x in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == sorted([*docs[:500], *docs[-3:]], key=str)
    assert shuffled < 0.4 * sum(len(t) for _, t in docs)


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
    assert all(any(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14))


@pytest.mark.parametrize("stage", [P.language_stage, P.suffix_stage, P.decontamination_stage])
def test_what_a_stage_returns_reaches_python_in_small_batches(spark, tmp_path, stage):
    r = random.Random(5)
    docs = [(i, " ".join(f"the{r.randrange(10**6)}" for _ in range(2000)), "en", 1) for i in range(700)]  # 7 MB
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "no document holds this passage of text")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column("text").nbytes])], names=["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        got = [x.n for x in stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sum(got) > 6_000_000 and max(got) < 5_000_000


def test_a_worker_gives_back_what_a_task_has_freed():
    pinned = []

    def taken():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

    def rows(batches):
        yield from batches
        held = [np.ones(8_000) for _ in range(1000)]  # 64 MB of arrays that are too small to be mapped on their own
        pinned.append(held[-1])  # above what is freed, so that the C library does not shrink its heap unasked

    at = taken()
    assert list(common.released(rows)(iter([]))) == []
    assert taken() - at < 30
