import pathlib
import shutil

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, langid, simhash, toxicity
from tidemark.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_every_stage_equals_its_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out, _ = materialise(stage(spark, docs, SF), name)
        kept = {r["doc_id"] for r in out.collect()}
        if name == "language_id":
            model = langid.train(docs)
            got = {r["doc_id"]: model.describe(r["text"]) for r in before}
            assert kept == {i for i, (lang, _, known) in got.items() if lang != "und" and known >= corpus_pipeline.KNOWN_LETTERS} and len(kept) >= 0.97 * len(before)
        elif name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert kept == {r["doc_id"] for r in before if model.score(r["text"]) < 0.3}
        elif name == "simhash_near_dedup":
            prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in before}
            linked = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3}
            up = {i: i for i in prints}
            for _ in prints:
                for a, b in linked:
                    up[a] = up[b] = min(up[a], up[b])
            assert kept == {i for i in prints if up[i] == i}
        elif name == "benchmark_decontamination":
            items = [(str(r["item_id"]), decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            matcher = decontaminate.Matcher(items, 13)
            hit = {r["doc_id"]: (sum(b - a for a, b in matcher.scan(decontaminate.words_of(r["text"]))[0]), len(decontaminate.words_of(r["text"]))) for r in before}
            assert kept == {i for i, (h, n) in hit.items() if not (h and 20 * h >= n)}
        else:
            assert kept == {r["doc_id"] for r in before}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out


def test_language_stage_keeps_mixed_texts_and_rejects_unknown_scripts(spark):
    words = {"en": "the cat sat on the mat and the dog ran", "fr": "le chat est sur la table avec le chien", "es": "el gato duerme sobre la mesa con el perro"}
    rows = [(i, t, lang) for i, (lang, t) in enumerate(list(words.items()) * 8)]
    rows += [(100, " ".join(words.values()), None), (101, "кот сидит на столе и ест", None), (102, "кот сидит на столе и ест the cat", None), (103, "12 ?!", "en"), (104, None, "en"), (105, "", None)]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert kept == {*range(24), 100}


def test_rows_without_an_id_keep_one_of_a_class(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, c)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, a), (0, b), (2, c)])


def test_run_leaves_one_table(spark, tmp_path):
    from tidemark.llm.common import shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file://")) / "tidemark"
    before = set(folder.iterdir()) if folder.exists() else set()
    got = corpus_pipeline.run(spark, SF)
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == [corpus_pipeline.STAGES[-1][0]] and got.count()


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_tables_run_through(spark, odd_docs, no_docs, tmp_path, rows):
    (odd_docs if rows == "odd" else no_docs).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows == "odd" and {1, 5} <= {r["doc_id"] for r in got} or not got
