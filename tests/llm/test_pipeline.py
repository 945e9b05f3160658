from __future__ import annotations

import random
import sys
from pathlib import Path

import cases


sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from recollect.llm import pieces, pii, quality  # noqa: E402


def tables(spark, folder, texts, extra=False):
    docs = cases.frame(spark, texts, extra)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "the one passage of the benchmark that must not be in any text of the corpus"), (2, None)],
                          "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def texts():
    rng = random.Random(8)
    clean = [cases.prose(rng, rng.randrange(60, 160), 3000) for _ in range(40)]
    return [*cases.ODD, *clean, *clean[:5], clean[6].replace(clean[6].split()[3], "other", 1), "spam spam spam spam spam " * 40,
            clean[7] + " the one passage, of the benchmark that must not be in any text of the corpus. " + clean[8],
            clean[9][:200] + " write to a.b@c.org now " + clean[10]]


def test_stages_follow_each_other(spark, tmp_path):
    docs = tables(spark, str(tmp_path), texts(), extra=True)
    rows = docs.collect()
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step = stage(spark, step, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert step.columns == docs.columns
            step.write.parquet(str(tmp_path / f"stage{i}"))
            step = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append(step.collect())
    good, single, apart, masked, last = seen
    counted = {(r.doc_id, r.n_words): r.kept for r in quality.judge(docs).collect()}
    words = lambda t: len(__import__("re").findall(cases.BLANK_WORD, t or ""))
    assert sorted(map(str, good)) == sorted(str(r) for r in rows if counted[(r.doc_id, words(r.text))])
    # one of each class: no two that stay are alike, and every one that went is like one that stayed
    sets = [cases.shingles(r.text) for r in single]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    assert not any(alike(a, b) for i, a in enumerate(sets) for b in sets[:i])
    assert all(any(alike(cases.shingles(r.text), b) for b in sets) for r in good)
    assert sorted(map(str, apart)) == sorted(str(r) for r in single if "passage" not in r.text)
    assert {r.doc_id: r.text for r in masked} == {r.doc_id: pii.mask(r.text, pii.Finder().spans(r.text)) for r in apart}
    assert any("[EMAIL]" in r.text for r in masked) and len(masked) == len(apart)
    with open(pieces.model_path(), "rb") as f:
        library = pieces.Encoder(f.read()).vocabulary.library
    want = {r.doc_id: library.encode(r.text, add_bos=True, add_eos=True) for r in masked}
    assert {r.doc_id: r.ids for r in last} == want and {r.doc_id: r.decoded for r in last} == {r.doc_id: r.text for r in masked}
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, last))


def test_empty_documents(spark, tmp_path):
    cases.frame(spark, ["a"]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    """A batch of whole texts fills no more than about a megabyte, whatever the number of its rows."""
    from recollect.session import BATCH_BYTES

    spark.createDataFrame([(1, "none")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(4000, numPartitions=1).selectExpr("id AS doc_id", "repeat('many words in one text ', 100) AS text", "'en' AS lang", "'a' AS source")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    was = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        for _, stage in corpus_pipeline.STAGES[2:]:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
            stage(spark, docs, str(tmp_path))
            assert max(r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect()) < 2 * BATCH_BYTES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", was)
