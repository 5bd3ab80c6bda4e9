import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from leafclock.llm import common, mixing, quality_classifier, toxicity
from leafclock.sources.scratch import staged


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for i in range(300):
        text = prose(i if i % 10 else 0, 60 + (i % 40 if i % 10 else 0))
        if i % 5 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 7 == 3:
            text += " you vile grunk grunk!"
        rows.append((i, text, "en", "abc"[i % 3] if i % 11 else None, len(text)))
        labels.append((i, int(i % 5 != 1), int(i % 7 == 3)))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, "kaba " * 30_000, "en", "b", 1), (903, "one", "en", "b", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), "test")
        seen.append(docs)
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    first, good, clean, single, mix, tokens = ([tuple(r) for r in d.collect()] for d in seen)

    kept = {r.doc_id for r in quality_classifier.classify(seen[0], labels).where("predicted = 1").collect()}
    assert sorted(good, key=str) == sorted((r for r in first if r[0] in kept), key=str)
    assert not {r[0] for r in good if r[0] < 300 and r[0] % 5 == 1}
    kept = {r.doc_id for r in toxicity.classify(seen[1], labels).where("predicted = 0").collect()}
    assert sorted(clean, key=str) == sorted((r for r in good if r[0] in kept), key=str)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    groups = {}
    for r in sorted(clean):  # only copies are alike here
        s = shingles(r[1])
        groups.setdefault(s if s else r[0], r)
    assert sorted(single, key=str) == sorted(groups.values(), key=str)

    taken = {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    assert sorted(mix, key=str) == sorted((r for r in single for _ in range(taken[r[0]])), key=str)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in mix:
        ids = encoding.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), ids, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(tokens, key=str) == sorted(want, key=str)


def test_run_and_contract(spark, folder):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    n = corpus_pipeline.run(spark, folder).count()
    assert 0 < n
    names = {q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)}


def test_batches_are_short_and_workers_give_memory_back(spark, monkeypatch):
    rows = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 40000) AS text")

    def sized(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    n = [r.n for r in common.map_batches(rows, sized, "n long").collect()]
    assert sum(n) > 400 * 40_000 and max(n) < 3 << 20

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    found = {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, fn, schema: found.setdefault("fn", fn))
    common.map_batches(rows, lambda batches: batches, "n long")
    assert list(found["fn"](iter([1, 2]))) == [1, 2] and given == [1]


def test_a_task_of_the_tokenizer_has_one_worker(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = corpus_pipeline.tokenize(spark, docs, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
