"""Overlaps against all alignments by the rule alone, whatever the seeds are."""

from itertools import combinations

import pytest

from larder.llm import decontaminate
from test_decontaminate import found, words


def test_masks_see_every_way_to_replace_two_of_thirteen_words():
    for gone in combinations(range(13), 2):
        assert any(
            not {a + o for o in mask} & set(gone) for mask in decontaminate.MASKS for a in range(13 - max(mask))
        ), gone


@pytest.mark.parametrize("sizes", [(5, 6, 7, 8, 9), (10, 11, 12, 13)])
def test_all_replacements_that_the_rule_accepts_are_found(spark, sizes):
    items, docs, want = [], [], set()
    for n in sizes:
        item = words(n, n)
        items.append((n, " ".join(item)))
        for most in range(4):
            for gone in combinations(range(n), most):
                copy = [f"zz{i}" if i in gone else w for i, w in enumerate(item)]
                doc_id = len(docs)
                docs.append((doc_id, " ".join(words(3, 1000 + n) + copy + words(2, 2000 + n))))
                if n - most >= decontaminate.SHARE * n:
                    want.add((doc_id, n))
                if most and len(docs) % 5 == 0:  # cut at the end of a text
                    docs.append((doc_id + 1, " ".join(item[: n - most])))
                    if n - most >= decontaminate.SHARE * n:
                        want.add((doc_id + 1, n))
    assert set(found(spark, docs, items)) == want
