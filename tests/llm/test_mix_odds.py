"""Inclusion frequencies and targets of the Pareto mix."""

import random
from collections import defaultdict

import pytest


def _words(n):
    return " ".join(["w"] * n)


def test_inclusion_frequencies_follow_the_words(spark):
    from panelscope.llm.mixing import mix

    sizes = [5, 20, 60, 150, 400]
    rows = [(i, "s" if i % 3 else "t", _words(sizes[i % 5])) for i in range(9000)]
    found = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.6).collect()
    groups = defaultdict(list)
    for r in found:
        groups[(r.source, r.size)].append(r)
    for (source, size), members in groups.items():
        expected = members[0].expected
        assert all(abs(r.copies - expected) < 1 or r.copies == expected for r in members)
        share = sum(r.copies for r in members) / len(members)
        assert share == pytest.approx(expected, abs=4 * (0.25 / len(members)) ** 0.5), (source, size)
    for source in "st":
        rates = {size: groups[(source, size)][0].expected / size for size in sizes}
        below = [rate for size, rate in rates.items() if rate * size < 2]
        assert max(below) == pytest.approx(min(below))
        mine = [r for r in found if r.source == source]
        assert sum(r.expected * r.size for r in mine) == pytest.approx(mine[0].target)
        # one document closes the gap: at worst it is as far from 5 words as from 20
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=10)


def test_long_document_in_the_way_leaves_no_gap(spark):
    from panelscope.llm.mixing import mix

    rng = random.Random(4)
    for seed in ("a", "b", "c"):
        rows = [(0, "s", _words(3000))] + [(i, "s", _words(rng.randint(1, 200))) for i in range(1, 80)]
        found = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.7, seed=seed).collect()
        assert sum(r.taken for r in found) == pytest.approx(found[0].target, abs=10)
        assert all(r.copies <= 2 and r.taken == r.copies * r.size for r in found)


def test_whole_sources_and_sources_without_words(spark):
    from panelscope.llm.mixing import mix

    rows = [(1, "a", _words(1)), (2, "b", _words(1000)), (3, "b", _words(500)), (4, "c", None), (5, "c", ""), (6, None, _words(7))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.doc_id: r for r in mix(docs).collect()}
    assert found[1].copies == 2 and found[1].target == 2.0
    assert found[4].taken == found[5].taken == 0 and found[4].target == 0.0
    assert all(r.copies <= 2 for r in found.values())
    whole = mix(docs, share=2.0).collect()
    assert all(r.taken == 2 * r.size for r in whole)
    assert mix(docs.filter("false")).count() == 0
