import corpus_pipeline
from tallyfold.llm import queries, toxicity
from tallyfold.llm.common import fresh_path

from . import test_jaccard, test_toxicity, test_wu_manber


def corpus(spark, rows, items, labels):
    path = fresh_path(spark, "test-corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain_versions(spark):
    rows, labels, plain = test_toxicity.made()
    items = [(k, " ".join(plain[(7 * k + j * j) % 120] for j in range(15))) for k in range(4)]
    rows += [(600, rows[1][1]), (601, rows[1][1]), (602, "Before that, " + items[2][1]), (603, 'a key: token = "0123456789abcdef0123456789abcdef01234567" ok'), (604, None), (605, "")]
    path = corpus(spark, rows, items, labels)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = fresh_path(spark, "test-stage")
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        after = {r.doc_id: r for r in docs.collect()}
        ids = {r.doc_id for r in before}
        pairs = [(r.doc_id, r.text) for r in before]
        if name == "toxicity":
            assert set(after) == ids - {k for k, x in labels if x}
        elif name == "near copies":
            assert set(after) == {c for _, n, c in test_jaccard.plain(pairs) if n} | {i for i, n, _ in test_jaccard.plain(pairs) if not n}
            assert 601 not in after and 600 not in after
        elif name == "decontamination":
            assert ids - set(after) == {r[0] for r in test_wu_manber.plain(pairs, items) if r[5]} and 602 not in after
        elif name == "secret scan":
            assert set(after) == ids and after[603].text == 'a key: token = "[secret]" ok'
            assert all(after[i].text == t for i, t in pairs if i != 603)
        else:
            assert set(after) == ids and after[604].n_tokens == 0
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_corpus(spark):
    path = corpus(spark, [], [], [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_all_are_registered():
    names = queries.registered()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert toxicity.LEAST_SCORE == 0.3
