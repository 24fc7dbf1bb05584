"""Null ids beside ids that a double cannot hold, and ids that stand before several texts."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom.llm import crossent, langid, mixing, warc
from quantloom.llm.decontam import without_contaminated
from quantloom.llm.langid import accept_identified
from quantloom.llm.minmax import keep_one_of_each_group, near_duplicates

BIG = (1 << 53) + 1


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def near(text):
    return text + " and then one more"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, prose(1), "en"), (BIG, prose(2), "en"), (BIG + 2, prose(3), "fr"), (4, prose(4), "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))


def test_ids_beside_nulls(spark, docs):
    want = [None, 4, BIG, BIG + 2]
    assert ids(langid.identify(docs)) == want
    assert ids(crossent.cross_entropy_difference(docs, spark.createDataFrame([(BIG,)], "doc_id long"))) == want
    labels = spark.createDataFrame([(BIG, 1, 0), (4, 0, 0), (BIG + 2, 1, 1)], "doc_id long, quality int, toxic int")
    assert ids(mixing.mixing_rates(docs, labels)) == want
    assert ids(mixing.mixing_rates(docs, labels.limit(0))) == want
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.lit("same").alias("html")).where(f"page_id is null or page_id >= {BIG}")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {(None, "revisit", BIG), (BIG, "response", None), (BIG + 2, "revisit", BIG)}


def test_repeated_ids_with_other_texts_lose_no_link(spark):
    a, b = prose(11), prose(12)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b))]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_namesakes_tie_classes_that_have_other_representatives(spark):
    a, b = prose(13), prose(14)
    got = near_duplicates(spark.createDataFrame([(7, a), (7, b), (3, a), (5, b)], "doc_id long, text string"), percent=80).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (7, 3)} and len(got) == 4


def test_near_dedup_keeps_a_clean_namesake(spark):
    a, b = prose(15), prose(16)
    rows = [(1, a, 0), (2, near(a), 0), (2, b, 0), (2, b, 0), (None, near(a), 0), (9, prose(17), 1), (9, near(b), 1)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, i int")).collect()
        texts = {(r.doc_id, r.text) for r in got}
        assert len(got) == len(texts)
        assert {(1, a), (None, near(a)), (9, prose(17))} <= texts and (2, near(a)) not in texts
        assert ((2, b) in texts) != ((9, near(b)) in texts)


def test_language_and_contamination_judge_rows_by_their_text(spark):
    good, bad = prose(18), prose(19)
    rows = [(1, good, "en"), (1, "123", "en"), (None, good, None), (None, "456", None), (2, bad, "en"), (2, good, "en"), (None, bad, None), (3, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(((r.doc_id, r.text) for r in accept_identified(docs).collect()), key=str) == sorted([(1, good), (None, good), (2, bad), (2, good), (None, bad)], key=str)
    clean = without_contaminated(docs, spark.createDataFrame([(1, " ".join(bad.split()[10:30]))], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([(i, t) for i, t, _ in rows if t != bad], key=str)
    assert accept_identified(docs.limit(0)).count() == 0 and without_contaminated(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
