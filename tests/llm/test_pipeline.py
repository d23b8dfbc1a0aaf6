"""The pipeline's stages on a small table: each one's decision takes effect and clean rows stay."""

import corpus_pipeline
import pytest
from test_operators import DE, EN, docs_of, words

from sextant.sources.scratch import new_folder


@pytest.fixture(scope="module")
def folder(spark):
    where = new_folder(spark, "pipeline-test")
    item = "Who built the very first lighthouse on the long western shore. The three brothers built it."
    rows = [(k, f"{EN if k % 2 else DE} {words(30, 100 * k)}", "en" if k % 2 else "de", "ab"[k % 3 == 0]) for k in range(30)]
    rows += [(100, rows[1][1], "en", "a"), (101, "123 !!", None, "a"), (102, f"{words(40, 9000)} {item}", "en", "b"), (103, f"{EN} {words(40, 8000)} write to me@home.org", None, "b"), (104, None, None, None)]
    docs_of(spark, rows).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, None
    clean = set(range(30))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert clean <= ids, name
            gone = [{101, 104}, {100, 101, 104}, {100, 101, 102, 104}, {100, 101, 102, 104}][k]
            assert ids == (clean | {100, 101, 102, 103, 104}) - gone, name
            if name == "pii":
                row = docs.where("doc_id = 103").first()
                assert row.text.endswith("[EMAIL]") and row.n_chars == len(row.text) and row.lang == "en"
    assert {r.doc_id for r in docs.select("doc_id").collect()} == ids  # every source is covered once


def test_unlearned_languages_and_random_letters_go(spark):
    import random

    say = random.Random(3)
    prose = lambda syllables: " ".join("".join(say.choices(syllables, k=say.randint(1, 3))) for _ in range(60))
    tongues = {"en": "the and ing for tion was er on".split(), "de": "der und sch ein ich gen ver ung".split()}
    rows = [(k, prose(tongues["en" if k % 2 else "de"]), "en" if k % 2 else "de", "a") for k in range(60)]
    rows += [(100, prose("szcz wy owa nie prz ła ego ją".split()), None, "a"), (101, prose("kuk aan mat ylä joss oli sen hän".split()), None, "a"), (102, prose(list("abcdefghijklmnopqrstuvwxyz")), None, "a")]
    rows += [(200, prose(tongues["en"]) + " Kowalski 12 https://x.org/ " + prose(tongues["de"]), None, "a"), (201, "the and", None, "a")]
    got = {r.doc_id for r in corpus_pipeline.known_language(spark, docs_of(spark, rows), "").select("doc_id").collect()}
    assert got == {*range(60), 200, 201}


def test_near_copies_are_told_by_rows(spark):
    a, b, c = (words(40, 1000 * k) for k in range(1, 4))
    near = a.replace(a.split()[0], "else", 1)
    rows = [(1, a, "en", "s"), (1, a, "en", "t"), (5, a, "en", "s"), (5, b, "en", "s"), (None, a, None, None), (None, c, None, None), (None, c, "en", "s"), (1, near, "en", "s"), (7, near, "en", "s"), (8, "", "en", "s"), (8, None, "en", "s"), (9, c + " more", "en", "s")]
    docs = docs_of(spark, rows).repartition(3)
    got = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.select("doc_id", "text").collect()]
    texts = sorted(t or "" for _, t in left)
    assert len(left) == 5 and texts[:2] == ["", ""] and {t for t in texts[2:]} >= {b} and len({t for t in texts[2:]} & {a, near}) == 1 and {i for i, t in left if t in (a, near)} == {1}
    assert (9, c + " more") in left  # a row with an id is preferred to those without


def test_every_stage_with_repeats_nulls_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, words(20, 7000))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(k, f"{EN if k % 2 else DE} {words(20, 100 * k)}", "en" if k % 2 else "de", "ab"[k % 3 == 0]) for k in range(12)]
    rows += [(1, f"{EN} {words(25, 5000)}", "en", None), (None, f"{EN} {words(25, 6000)}", None, None), (None, None, None, None), (2, "", None, "a"), rows[3], rows[3]]
    for some in (rows, []):
        docs = docs_of(spark, some)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns + ["mixing"] * (name == "mixing")
        kept = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect()]
        assert sorted(map(str, kept)) == sorted(map(str, {(i, t) for i, t, *_ in some if t}))


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == 31
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "mixing"]
