"""Reading level: prose, held-out accuracy, both ways of a round."""

import duckdb
import pytest

from quern.llm.levels import reading_levels
from quern.llm.prose import english_words

LARGER = "/root/testdata/sf0.01"


def test_prose():
    text = "---\nname: x\n---\n# Heading words\n\nPlain words `code here` go (see `a.md`) on [link](b.md).\r\n\r\n```py\nno words\n```\n| a | b |\nid: x-1\n- [x] step one\nDie Datei ist neu, wenn sie da ist. An English end! 文書を見る。\n"
    assert english_words(text) == "plain words go on step one an english end".split()
    assert english_words("") == [] and english_words("```\nopen fence") == []


@pytest.fixture(scope="module")
def tables(spark):
    try:
        return spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/doc_level_sample.parquet")
    except Exception:  # noqa: BLE001
        pytest.skip("no test tables here")


def test_held_out_documents(spark, tables):
    documents, graded = tables
    rows = sorted((r["doc_id"], r["level"]) for r in graded.collect())
    right = n = 0
    for fold in (0, 1):
        seen = spark.createDataFrame([r for i, r in enumerate(rows) if i % 2 == fold], "doc_id bigint, level bigint")
        got = {r["doc_id"]: r["level"] for r in reading_levels(documents, seen).collect()}
        held = [r for i, r in enumerate(rows) if i % 2 != fold]
        right, n = right + sum(got.get(d) == level for d, level in held), n + len(held)
    assert right / n > 0.9


def test_joins_give_the_same(spark, tables):
    documents, graded = tables
    documents = documents.where("doc_id < 300")
    a = {r["doc_id"]: (round(r["difficulty"], 6), r["level"]) for r in reading_levels(documents, graded, 2).collect()}
    b = {r["doc_id"]: (round(r["difficulty"], 6), r["level"]) for r in reading_levels(documents, graded, 2, max_words=0).collect()}
    assert a == b and len(a) > 100


@pytest.mark.parametrize("max_words", [1000, 300_000])
def test_known_levels_stay(spark, tables, max_words):
    documents, graded = tables
    documents = documents.where("doc_id < 300")
    odd = graded.selectExpr("doc_id", "5 - level as level")  # as far from what the words say as can be
    mixed = graded.where("doc_id % 5 > 0").unionByName(odd.where("doc_id % 5 = 0"))
    got = {r["doc_id"]: (r["difficulty"], r["level"]) for r in reading_levels(documents, mixed, 3, max_words=max_words).collect()}
    known = {r["doc_id"]: r["level"] for r in mixed.collect() if r["doc_id"] in got}
    assert known and all(got[k] == (level, level) for k, level in known.items())


def test_language_of_a_sentence():
    assert english_words("The el dorado plan is on the un list.") == "the el dorado plan is on the un list".split()
    assert english_words("Cuando la tarea termina, el informe se guarda. When it ends, keep it. Fertig und gut.") == "when it ends keep it".split()
    assert english_words("Run tests. La prueba es un ejemplo. Wait. The end is near.") == "run tests the end is near".split()


def test_only_documents_with_prose(spark, sf_dir):
    con = duckdb.connect()
    texts = dict(con.execute(f"select doc_id, text from read_parquet('{sf_dir}/documents.parquet')").fetchall())
    documents, graded = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "doc_level_sample"))
    got = {r["doc_id"]: r["level"] for r in reading_levels(documents, graded).collect()}
    assert set(got) == {k for k, t in texts.items() if t and len(english_words(t)) >= 40} and set(got.values()) <= {1, 2, 3, 4}


def test_nothing_graded(spark):
    documents = spark.createDataFrame([(1, "word " * 50), (2, None), (3, "")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, level bigint")
    assert reading_levels(documents, none).count() == 0
    one = spark.createDataFrame([(1, 2)], "doc_id bigint, level bigint")
    assert [(r["doc_id"], r["level"]) for r in reading_levels(documents, one).collect()] == [(1, 2)] or reading_levels(documents, one).count() == 1
    assert reading_levels(documents.limit(0), one).count() == 0
