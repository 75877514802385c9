import re

import pytest

import corpus_pipeline
from hopscope.llm import oracle, queries

from ..checking import DATA, engine, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(spark, name):
    same(engine(), queries.queries()[name](spark, str(DATA)), SQL[name])


def test_every_operator_has_its_query():
    names = list(queries.queries())
    assert [re.match(r"op(\d+)_", n)[1] for n in names] == [str(k) for k in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "mixing"]


def test_scores_of_held_out_texts_beat_the_base(spark):
    rows = [r for r in queries.op1_ppm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_pages_keep_the_article_alone(spark):
    rows = queries.op8_html_text(spark, str(DATA)).collect()
    assert len(rows) == 50 and all(r.text and "<" not in r.text and r.n_chars == len(r.text) for r in rows)
