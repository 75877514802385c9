"""Columns of the caller keep their values whatever their names are."""

import pytest
from pyspark.sql import functions as F

from hopscope.llm import fm_index, html_text, mixing, ordinal_quality, ppm, quality_rules, simhash, suffix_dedup, url_filters, warc_zip

NAMES = "_h _hash _lines _rank _chunk h hashes lines rank chunk s1 s4 stratum th spans score_ template_ row _ given classes bits seg up rows words ahead allowed max_symbols long_words".split()


def table(spark, columns, rows):
    filled = [(*r, *[f"{k}" for k in range(len(NAMES))]) for r in rows]
    return spark.createDataFrame(filled, columns + "".join(f", `{c}` string" for c in NAMES))


def kept(found, n):
    rows = found.select(*[F.col(f"`{c}`") for c in NAMES]).collect()
    return len(rows) == n and all(tuple(r) == tuple(f"{k}" for k in range(len(NAMES))) for r in rows)


TEXT = "It was the first of the days that we had in the town and the weather had been as good as ever."


def test_operators_on_documents(spark):
    rows = [(1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (None, None, None, None), (2, "x " * 3000, "de", "b"), (3, "", "de", "b")]
    docs = table(spark, "doc_id long, text string, lang string, source string", rows)
    measured = quality_rules.measure(docs)
    assert kept(measured, 5)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    cutoffs = quality_rules.learn_cutoffs(measured, labels)
    assert kept(quality_rules.judge(measured, cutoffs), 5)
    mixed = mixing.mix(docs, F.length("text"))
    assert kept(mixed, 5) and kept(mixing.emit(mixed), mixed.agg(F.sum("copies")).first()[0])
    assert kept(simhash.drop_similar(docs), 3)
    assert kept(suffix_dedup.remove_repeats(docs, 50), 5)
    bench = spark.createDataFrame([(1, "first of the days that we had in the town and the")], "item_id long, text string")
    assert kept(fm_index.decontaminate(docs, bench), 5)
    grades = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, grade int")
    assert kept(ordinal_quality.score(docs, ordinal_quality.train(docs, grades, 1)), 5)
    assert kept(ppm.score_adaptive(docs), 5)
    assert ppm.score_corpus(docs, F.col("doc_id") == 1).count() == 5
    assert simhash.near_duplicates(docs).count() == simhash.similar_documents(docs).count() == suffix_dedup.repeat_digest(docs).count() == 5


def test_stratum_of_any_name(spark):
    docs = table(spark, "doc_id long, text string, lang string, source string", [(1, TEXT, "en", "a")])
    measured = quality_rules.measure(docs)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    cutoffs = quality_rules.learn_cutoffs(measured, labels, "stratum")
    assert kept(quality_rules.judge(measured, cutoffs, "stratum"), 1)


def test_operators_on_pages(spark):
    pages = table(spark, "page_id long, url string, html string", [(1, "http://a.com/de/1", "<p>x</p>"), (None, None, None), (1, "http://a.com/de/1", "<p>x</p>")])
    assert kept(url_filters.judge_urls(pages, [("block", "com/de/")]), 3)
    assert kept(html_text.extract(pages), 3)
    assert warc_zip.read_packages(warc_zip.write_packages(pages)).count() == 3


def test_page_ids_of_text(spark):
    ids = ["b", "a", "", None, "x y>", ".", "é\n"]
    pages = spark.createDataFrame([(i, "u", "same") for i in ids], "page_id string, url string, html string")
    got = warc_zip.read_packages(warc_zip.write_packages(pages), ids="string").collect()
    assert sorted(((r.page_id, r.refers_to) for r in got), key=repr) == sorted(((i, None if i == "" else "") for i in ids), key=repr)
    with pytest.raises(ValueError):
        warc_zip.read_packages(pages.limit(0), ids="float")


def test_items_without_id_are_one(spark):
    docs = spark.createDataFrame([(1, "one two three and four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two"), (None, "four five"), ("None", "three"), ("z", "seven")], "item_id string, text string")
    assert fm_index.contamination(docs, items).first().n_items == 2
