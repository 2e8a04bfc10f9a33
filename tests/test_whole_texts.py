import pytest

from verbascope.plans import catalog, views


@pytest.mark.parametrize("name", ["exact_span", "lemma_span"])
def test_spans_beyond_a_prefix(spark, small, name):
    assert catalog.QUERIES[name](spark, small).where("span_end > 200").count() > 0


def test_no_view_cuts_a_table():
    assert "text, 1, 200" not in str(views.VIEWS) and "997" not in str(catalog.ORACLES)
