"""The stages over a small table of planted cases, each against a plain restatement of its rule."""

import random

import corpus_pipeline
import pytest
from tidemark.llm import quality, secret_scan, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    items = [(i, text(40)) for i in range(5)]
    rows, labels = [], []
    for i in range(300):
        t = text(rng.randint(30, 200))
        good = i % 5 != 4
        if not good:
            t = (text(6).upper().replace(" ", "!! ") + " ") * 6
        labels.append((i, int(good), 0))
        rows.append([i, t, "en", f"src{i % 4}", len(t)])
    for i in range(300, 340):
        rows.append([i, rows[(i - 300) * 5][1], "en", "src0", 1])  # exact copies of good texts
    for i in range(340, 350):
        rows.append([i, text(20) + " " + items[i % 5][1] + " " + text(20), "en", "src1", 1])
    for i in range(350, 360):
        rows.append([i, text(60) + " password=abcdef123456 " + text(9), "en", "src2", 1])
    base = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_every_stage(spark, folder):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{k}")
        out = spark.read.parquet(f"{folder}/stage{k}")
        now = {r["doc_id"]: r["text"] for r in out.collect()}
        if k < 4:
            assert out.columns == docs.columns
            assert out.count() == len(now)
        if k == 0:
            assert set(now) == {i for i in seen if not (i < 300 and i % 5 == 4)}
        elif k == 1:
            first = {}
            for i in sorted(seen):
                first.setdefault(simhash.fingerprint(seen[i]), i)
            assert set(now) == set(first.values()) and not set(now) & set(range(300, 340))
        elif k == 2:
            assert set(seen) - set(now) == set(range(340, 350)) & set(seen)
        elif k == 3:
            assert set(now) == set(seen)
            assert {i for i in now if secret_scan.MASK in now[i]} == set(range(350, 360)) & set(seen)
            assert all(now[i] == seen[i] for i in now if i < 350)
        else:
            assert set(now) <= set(seen) and {"copy", "shuffle_key"} <= set(out.columns)
        docs, seen = out, now
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_quality_stage_keeps_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert kept.where("doc_id < 300 and doc_id % 5 <> 4").count() == 240


def test_edge_cases_of_every_stage(spark, folder, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, clashing columns, an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy string, `__key` int, score double"
    good = next(r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 0").collect())
    long = " ".join(f"{w}{i % 977}" for i, w in enumerate(good.split() * 300))
    own = good.replace(good.split()[3], "zzz") + " and more words of its own here"
    rows = [(1001, own), (1001, own), (1001, good + " token=abcdef12"), (None, own), (None, None), (1002, None), (1003, ""), (1004, long), (1005, "x"), (None, own)]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 300").collect()]
    docs = spark.createDataFrame([(i, t, None, None, None, "c", 7, 0.5) for i, t in rows], schema)
    for name, n in (("empty", 0), ("some", len(rows))):
        path = str(tmp_path / name)
        docs.limit(n).write.parquet(f"{path}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
        at, before = spark.read.parquet(f"{path}/documents.parquet"), n
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, at, path).write.parquet(f"{path}/{i}")
            at = spark.read.parquet(f"{path}/{i}")
            last = i == len(corpus_pipeline.STAGES) - 1
            assert at.columns == (docs.columns + ["copy_", "shuffle_key"] if last else docs.columns)
            assert last or at.count() <= before
            before = at.count()
        if n:
            texts = [r["text"] for r in spark.read.parquet(f"{path}/3").collect()]
            assert texts.count(good) <= texts.count(own) == 1 and texts.count(long) <= 1 and "token=abcdef12" not in " ".join(t or "" for t in texts)
            assert {(r["__key"], r["score"]) for r in at.collect()} <= {(7, 0.5)}
        else:
            assert before == 0
