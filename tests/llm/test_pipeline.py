import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm import queries
from test_decontaminate import brute as brute_hits
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def written(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_stages_of_the_given_documents_against_plain_versions(spark, given, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), str(tmp_path / str(k)))
        results.append(docs.collect())
        assert docs.columns == (columns if k < 4 else ["doc_id", "n_tokens", "ids"]), name
    start, spoken, single, clean, safe, encoded = results
    # 1: whole rows stay, and whatever went has no letter or no clear language
    assert set(spoken) <= set(start) and len(spoken) >= 0.98 * len(start)
    # 2: the smallest id of each group
    rows = sorted(spoken, key=lambda r: r.doc_id)
    label = brute_components([brute_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in single) == [rows[k].doc_id for k in sorted(set(label))]
    # 3: no benchmark window
    items = given("sf0.001", "benchmark", "item_id, text")
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if not brute_hits(r.text, items)[1])
    # 4: tokens are gone, the rest is as it was
    token = re.compile(r'(?i)(token = ")[0-9a-f]{40}(")')
    before = {r.doc_id: r for r in clean}
    assert {r.doc_id: r.text for r in safe} == {k: token.sub(r"\1[secret]\2", r.text) for k, r in before.items()}
    assert all(r.n_chars == len(r.text) for r in safe)
    # 5: the library's ids
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in safe}
    assert {r.doc_id: list(r.ids) for r in encoded} == {k: library.encode(t, add_special_tokens=False).ids for k, t in texts.items()}


def test_run_chains_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and 0 < got.count() <= 200


@pytest.mark.parametrize("stage", range(5))
def test_every_stage_takes_unusual_documents(spark, documents, stage):
    text = "the cat and the dog went to the old house by the river and they were glad of it"
    docs = documents((1, text), (1, text), (2, None), (3, ""), (None, text), (4, "word of the day " * 40_000), (5, "123 456"), (6, text, None))
    _, function = corpus_pipeline.STAGES[stage]
    out = function(spark, docs, SF)
    if stage < 4:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() <= docs.count()
    assert function(spark, docs.limit(0), SF).count() == 0


def test_every_operator_is_registered_once():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "bpe_encoding"]
