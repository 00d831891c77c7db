"""The corpus pipeline stage by stage, against plain versions on its own input."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_jaccard import plain as plain_components
from .test_lines import plain as plain_lines

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, and the documents before them."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs)
    return out


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(d.columns == stages[0].columns and d.dtypes == stages[0].dtypes for d in stages[1:-1])


def test_quality_keeps_documents_whole_and_drops_junk(spark, stages):
    before = {r.doc_id: r for r in stages[0].collect()}
    after = {r.doc_id: r for r in stages[1].collect()}
    assert all(before[i] == r for i, r in after.items())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(i in after for i, q in quality.items() if q == 1)
    assert sum(i not in after for i, q in quality.items() if q == 0) >= 0.6 * sum(q == 0 for q in quality.values())


def test_lines(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    got = {r.doc_id: r for r in stages[2].collect()}
    want = {i: text for i, text, *_ in plain_lines(rows)}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_near_copies(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = sorted(i for i, (_, c) in plain_components(rows).items() if i == c)
    assert sorted(r.doc_id for r in stages[3].collect()) == want


def test_decontamination(spark, stages):
    from paperloom.llm.decontaminate import find_contamination

    gone = {r.doc_id for r in find_contamination(stages[3], spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert sorted(r.doc_id for r in stages[4].collect()) == sorted(r.doc_id for r in stages[3].collect() if r.doc_id not in gone)


def test_tokens(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = {r.doc_id: r for r in stages[5].collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert got[i].ids == library.encode(text, add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.ids)
    assert sorted(map(key, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(key, stages[5].collect()))


def test_odd_documents_pass_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    prose = next(r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en' and length(text) > 2000").orderBy("doc_id").collect() if r.doc_id in good)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "the an", "en", "s", 6), (3, "\n".join([prose] * 50), "en", "s", 1)]
    clash = ["_gone", "_salt", "_cost", "_lang", "_keep", "key", "h1", "_h1", "k1", "label", "size", "id", "fold"]
    for name, data in (("odd", rows), ("none", []), ("clash", [(*r, *range(len(clash))) for r in rows])):
        schema = schema if name != "clash" else ", ".join([schema, *(f"{c} int" for c in clash)])
        docs = spark.createDataFrame(data, schema)
        (tmp_path / name).mkdir()
        spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.columns
            stage(spark, docs, str(tmp_path / name)).write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
            assert stage is corpus_pipeline.tokens or docs.columns == before
            if name == "clash" and stage is not corpus_pipeline.tokens:
                assert {tuple(r[c] for c in clash) for r in docs.collect()} == {tuple(range(len(clash)))}
        assert docs.count() == (len(data) and 5)
