"""Stages of the pipeline go by rows: ids that repeat, nulls, clashing names, equal rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(tag, n=80, change=()):
    return " ".join(f"{tag}{i}" + ("x" if i in change else "") for i in range(n))


def table(spark, rows, extra=True):
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
    for name in ("copies", "__row", "__rows", "row", "doc", "mark", "several", "root", "node", "kept", "at", "last") if extra else ():
        docs = docs.withColumn(name, F.lit("own"))
    return docs


def kept(rows):
    return sorted(((r.doc_id, r.text) for r in rows.collect()), key=str)


def test_near_duplicates_by_row(spark):
    import corpus_pipeline

    a, near, other = prose("a"), prose("a", change=(79,)), prose("b")
    docs = table(spark, [(1, a, "s"), (5, near, "s"), (5, other, "s"), (7, prose("c"), "s"), (7, prose("c"), "s"), (None, other, "s"), (8, None, "s"), (8, None, "s"), (9, "", None)])
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns and kept(left) == sorted([(1, a), (5, other), (7, prose("c")), (8, None), (9, "")], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.filter("false"), "").count() == 0


def test_links_of_rows_without_an_id(spark):
    from panelscope.llm.partenum import jaccard_components

    text = prose("a", 106)
    docs = spark.createDataFrame([(None, text), (1, text + " " + prose("b", 9)), (2, prose("c", 9) + " " + text)], "doc_id long, text string")
    assert {r.component_id for r in jaccard_components(docs).collect()} == {1}


def test_short_texts_are_not_signed():
    import numpy as np

    from panelscope.llm.partenum import band_starts, signatures

    rng = np.random.default_rng(1)
    assert not any(len(signatures(np.sort(rng.integers(0, 1 << 63, n, np.uint64)), band_starts())) for n in (1, 2, 3))


def test_outlines_bound_the_difference():
    import numpy as np

    from panelscope.llm.partenum import WIDE, outline

    rng = np.random.default_rng(4)
    for n in (10, 300, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        for share in (0.01, 0.1, 0.5):
            other = np.unique(np.concatenate([rng.permutation(base)[: int(n * (1 - share))], rng.integers(0, 1 << 63, int(n * share) + 1, np.uint64)]))
            apart = len(np.setxor1d(base, other))
            for words in (8, WIDE):
                bits = np.bitwise_count(outline(base, words).view(np.uint64) ^ outline(other, words).view(np.uint64)).sum()
                assert bits <= apart and (apart > 10 * words or bits > 0.8 * apart - 2)


def test_mixing_with_clashing_names_and_equal_rows(spark):
    import corpus_pipeline

    rows = [(i, prose(f"a{i}w", 20), "one") for i in range(30)] + [(50, prose("same", 10), "two")] * 40 + [(60, None, None), (61, "", "two")]
    docs = table(spark, rows)
    left = corpus_pipeline.mixing(spark, docs, "")
    found = Counter(r.doc_id for r in left.collect())
    assert left.columns == docs.columns and found[50] <= 80 and all(n <= 2 for i, n in found.items() if i != 50)
    assert corpus_pipeline.mixing(spark, docs.filter("false"), "").count() == 0


def test_one_of_equal_rows_closes_the_gap(spark):
    from panelscope.llm.mixing import mix

    docs = spark.createDataFrame([(1, "s", prose("w", 10))] * 40 + [(2, "t", prose("w", 100))], "doc_id long, source string, text string")
    found = mix(docs).collect()
    by_source = {r.source: r.target for r in found}
    for source, target in by_source.items():
        taken = sum(r.taken for r in found if r.source == source)
        assert abs(taken - target) <= (5 if source == "s" else 50), (source, taken, target)


@pytest.mark.parametrize("stage", ["quality", "line_dedup", "near_duplicates", "mixing"])
def test_stages_on_odd_tables(spark, stage):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(50_000))
    docs = table(spark, [(1, None, None), (2, "", "a"), (3, long, "a"), (3, long, "a"), (None, prose("z"), None), (4, prose("y"), "b"), (4, prose("x"), "b")])
    run = dict(corpus_pipeline.STAGES)[stage]
    found = run(spark, docs, "")
    assert found.columns == docs.columns and {r.text for r in found.collect()} >= {long, prose("y"), prose("x"), prose("z")} - ({prose("z")} if stage == "mixing" else set())
    assert run(spark, docs.filter("false"), "").count() == 0


def test_a_large_buckets_pairs_are_judged_in_arrays(spark):
    """Every possible pair of a bucket once, whatever the cells, without a row for each pair of its members."""
    import numpy as np

    from panelscope.llm import partenum

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (4, partenum.OUTLINE))
    far = rng.integers(0, 2**63, partenum.WIDE)
    rows, looks = [], {}
    for node in range(400):
        bits = base[node % 4].copy()
        for at in rng.integers(0, 40, 12):  # close to one of four outlines
            bits[at // 8] ^= 1 << int(at)
        size = int(rng.choice([60, 75, 800, 900]))
        wide = [int(v) for v in (far if node % 3 else ~far)] if size >= partenum.LARGE else None
        looks[node] = (size, [int(v) for v in bits], wide)
    buckets = {1: range(400), 2: range(0, 400, 2), 3: [7], **{10 + i: range(i, i + 5) for i in range(300)}}
    for sig, nodes in buckets.items():
        rows += [(sig, n, n // 6, looks[n], len(nodes)) for n in nodes]
    schema = "sig long, node long, root long, look struct<size:long,bits:array<long>,wide:array<long>>, members long"
    members = spark.createDataFrame(rows, schema).repartition(5)

    def apart(x, y):
        return sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y))

    def possible(u, v):
        (a, x, p), (b, y, q) = looks[u], looks[v]
        most = (partenum.DEN - partenum.NUM) * (a + b)
        weigh = partenum.DEN + partenum.NUM
        sizes = partenum.DEN * min(a, b) >= partenum.NUM * max(a, b)
        return sizes and weigh * apart(x, y) <= most and (p is None or q is None or weigh * apart(p, q) <= most)

    want = sorted((u, v) for u in range(400) for v in range(u + 1, 400) if u // 6 != v // 6 and possible(u, v))
    assert 1_000 < len(want) < 40_000
    for cell in (partenum.CELL, 64):
        found = partenum._between(members, cell)
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "MapInArrow" in plan
    assert partenum._between(members.limit(0)).count() == 0
