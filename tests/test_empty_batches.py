"""Batches without a match and empty dictionaries give NULL matches, not a failed job."""

import pytest

from turfline.operators.text import match_entity_longest


@pytest.mark.parametrize("names", [["zzzz"], []])
@pytest.mark.parametrize("ids", ["string", "long"])
def test_no_question_matches(spark, names, ids):
    questions = spark.createDataFrame([("1", "who scored"), ("2", "no name here"), ("3", None)], "query_id string, query string")
    questions = questions.withColumn("query_id", questions["query_id"].cast(ids))
    dictionary = spark.createDataFrame([(n,) for n in names], "web_name string")
    rows = match_entity_longest(questions, dictionary).collect()
    assert len(rows) == 3 and all(r["matched"] is None for r in rows)
