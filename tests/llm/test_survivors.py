"""Rows without an id and rows that repeat one: each goes or stays by its own text."""

import random

import pytest

from larder.llm import decontaminate, shingles, simhash

ROWS = "doc_id long, text string"


def words(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))


@pytest.mark.parametrize("first_of_each", [simhash.first_of_each, shingles.first_of_each])
def test_one_row_of_each_component_stays(spark, first_of_each):
    own = [words(60, i) for i in range(12)]
    rows = [(None, own[i]) for i in range(6)]  # unrelated texts, no ids
    rows += [(None, own[0]), (7, own[1]), (9, own[1])]  # copies of them
    rows += [(4, own[6]), (4, own[7]), (4, own[7])]  # an id with two texts
    rows += [(2, own[8]), (5, own[8]), (5, own[9])]  # the other text of 5 is a copy of 2
    kept = [tuple(r) for r in first_of_each(spark.createDataFrame(rows, ROWS)).collect()]
    want = [(None, own[i]) for i in (0, 2, 3, 4, 5)]
    want += [(7, own[1]), (4, own[6]), (4, own[7]), (2, own[8]), (5, own[9])]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_leaks_go_by_their_own_text(spark):
    item, clean = words(30, 50), [words(40, 60 + i) for i in range(3)]
    rows = [(None, clean[0]), (None, f"{clean[1]} {item}"), (3, clean[2]), (3, item), (4, item)]
    docs = spark.createDataFrame(rows, ROWS)
    kept = decontaminate.clean_documents(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, clean[0]), (3, clean[2])], key=str)
