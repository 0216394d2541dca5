import pytest

from larkspur.llm.queries import QUERIES

COLUMNS = {"p1_found": ["field", "name_a", "name_b"], "p5_found": ["feed_id", "segment", "language"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "sent_no", "start_char", "end_char"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(set(rows)) == len(rows)
