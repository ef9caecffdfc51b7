"""Operators against brute force and on odd tables: nulls, empty and long texts, repeated rows, no rows, clashing names."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
ODD = "doc_id long, text string, source string, row long, node long, hub string, kept string"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    line = "this line recurs in many documents of the table\n"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", "a"), (5, "one", "a"), (5, "one", "a"), (6, long, None), (7, long + " end", "b"), (None, "no id here at all", "b"), (None, None, None)]
    rows += [(100 + i, line + f"own words number {i} of this document", "a") for i in range(15)]
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], ODD)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def operators():
    from panelscope.llm import kneser_ney, line_rules, mixing, packing, partenum, pseudonyms, templates, token_count

    return {"mix": mixing.mix, "rules": line_rules.line_rules, "pack": packing.pack, "join": partenum.jaccard_components, "tokens": token_count.token_counts, "score": kneser_ney.score, "pseudonyms": pseudonyms.pseudonymise, "templates": templates.drop_recurring}


@pytest.mark.parametrize("name", list(operators()))
def test_odd_tables(odd, none, name):
    rows = operators()[name](odd)
    assert (rows.filter("start = 0") if name == "pack" else rows).count() == 25
    assert operators()[name](none).count() == 0


def test_mix_is_bounded(odd):
    from panelscope.llm.mixing import mix

    rows = mix(odd).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix(odd).collect()))


def test_components_of_copies(odd):
    from panelscope.llm.partenum import jaccard_components

    found = defaultdict(set)
    for r in jaccard_components(odd).collect():
        found[r.doc_id].add(r.component_id)
    assert found[4] == found[5] == {4} and found[6] == found[7] == {6} and found[1] == {1} and found[2] == {2}


def test_bands_and_signatures_meet():
    import numpy as np

    from panelscope.llm.partenum import band_starts, signatures

    rng, starts = np.random.default_rng(1), band_starts()
    for n in [*range(1, 40), 60, 100, 200, 400, 1000]:
        for _ in range(20):
            base = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            drop = rng.integers(0, int(0.15 * n) + 1)
            other = base[drop:] if rng.random() < 0.5 else np.unique(np.append(base[drop // 2 :], rng.integers(0, 1 << 63, drop // 2, np.uint64)))
            common = len(np.intersect1d(base, other))
            if not np.array_equal(base, other) and 100 * common >= 85 * (len(base) + len(other) - common):  # equal sets are one node
                assert len(np.intersect1d(signatures(base, starts), signatures(other, starts)))


def test_token_counts_and_pieces(documents):
    from tokenizers import Tokenizer

    from panelscope.llm.packing import pack
    from panelscope.llm.token_count import default_path, token_counts

    tokenizer = Tokenizer.from_file(default_path())
    more = documents.sparkSession.createDataFrame([(-1, "a<|endoftext|>b é\u0085c\x1cd ΑΣ İ"), (-2, "'s don't"), (-3, None)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(more)
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == {k: len(v) for k, v in ids.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(docs).collect():
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        own = (ids[r.doc_id] + [2])[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)) and r.doc_tokens == len(ids[r.doc_id]) + 1
    for key, found in [*((len(ids[k]) + 1, v) for k, v in pieces.items()), *((None, v) for v in sequences.values())]:
        end = 0
        for start, length in sorted(found):
            assert start == end
            end += length
        assert end == key if key else end <= 4096


def test_kneser_ney(documents):
    from panelscope.llm.kneser_ney import discounts, score

    texts = {r.doc_id: [*re.findall(WORD, low(r.text or "")), 0] for r in documents.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([1, *t], t))
    before, total, kinds = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, _), c in pairs.items():
        total[v] += c
        kinds[v][min(c, 3) - 1] += 1
    seen, words = Counter(pairs.values()), Counter(before.values())
    d, e = (discounts([x[i] for i in (1, 2, 3, 4)]) for x in (seen, words))
    rest = sum(e[min(c, 3) - 1] for c in before.values()) / (len(uni) + 1)

    def lower(w):
        c = before.get(w, 0)
        return ((c - e[min(c, 3) - 1] if c else 0) + rest) / len(pairs)

    def p(v, w):
        if not total.get(v):
            return lower(w)
        c = pairs.get((v, w), 0)
        return ((c - d[min(c, 3) - 1] if c else 0) + sum(x * y for x, y in zip(d, kinds[v])) * lower(w)) / total[v]

    n = sum(uni.values())
    for r in score(documents).collect():
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in uni for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((uni.get(w, 0) + 1) / (n + len(uni) + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(v, w)) for v, w in zip([1, *t], t)), rel_tol=1e-9)


def test_pages(spark, folder):
    import html

    from panelscope.llm.style_tree import main_text

    def truth(page):
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", body)) if x)

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    rows = main_text(pages.withColumn("host", F.lit(1)).withColumn("removed", F.lit("x"))).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    # a host whose template shows a notice on every page, in an element without a telling name
    site = [(i, "http://h.example/" + str(i), f"<body><div class=x>Always the same</div><div class=y><p>Own text {i} here</p></div>") for i in range(12)]
    site += [(50, None, None), (51, "rel", ""), (52, "http://h.example/", "<p>plain < text &amp; more<script>x</script>")]
    found = {r.page_id: r.text for r in main_text(spark.createDataFrame(site, "page_id long, url string, html string")).collect()}
    assert found[3] == "Own text 3 here" and found[50] == found[51] == "" and found[52] == "plain < text & more"
    assert main_text(pages.filter("false")).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    from panelscope.llm.style_tree import main_text

    page = lambda x: f"<body><div class=x>Always the same</div><div class=y><p>{x}</p><p>More of {x}</p></div>"
    site = [(i, f"http://h.example/{i}", page(f"text {min(i, 14)}")) for i in range(60)] + [(100 + i, f"http://small.example/{i}", page("one article")) for i in range(20)]
    found = {r.page_id: r.text for r in main_text(spark.createDataFrame(site, "page_id long, url string, html string").repartition(7)).collect()}
    assert all(found[i] == f"text {min(i, 14)}\nMore of text {min(i, 14)}" for i in range(60))
    assert all(found[100 + i] == "Always the same\none article\nMore of one article" for i in range(20))


def test_search(spark):
    from panelscope.llm import impact_index

    nan = float("nan")
    rows = [(0, [0.5, -0.25]), (50, [1.0, 1.0]), (3, [0.5, -0.25]), (4, [0.5, -0.25]), (5, None), (6, [nan, 1.0]), (7, [None, 1.0]), (8, []), (9, [2.0]), (None, [9.0, 9.0]), (10, [-3.0, 0.1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("rank", F.lit("x"))
    found = impact_index.top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 0] == [(9, 65536), (3, 20480), (4, 20480), (50, 16384), (8, 0)]
    assert impact_index.top_k(vectors.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_search_reads_few_postings(monkeypatch):
    import numpy as np

    from panelscope.llm import impact_index

    draw, added, count = np.random.default_rng(5), [], np.bincount
    values = np.floor(draw.normal(0, 32, (4000, 64)))
    values[:40], values[40:60, ::2], values[60:70] = values[0], 0, np.floor(draw.normal(0, 90, 64))
    index = impact_index.Index(draw.permutation(4000), values)

    def counted(x, *args, **kwargs):
        added.append(len(x))
        return count(x, *args, **kwargs)

    monkeypatch.setattr(np, "bincount", counted)
    queries = [*values[[0, 45, 65, *range(500, 540)]], np.zeros(64), np.eye(64)[3], -7 * np.eye(64)[9], np.floor(values[700] * 2.0**12), np.floor(values[701] * 2.0**40)]
    for at, query in enumerate(queries):
        ids, scores = index.top(query, own := int(index.ids[at]), 5)
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(v, query)), int(i)) for i, v in zip(index.ids, values) if i != own)[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == exact
    assert sum(added) < 0.9 * 43 * values.size  # two sums over nearly every posting before


def test_pseudonyms(spark):
    from panelscope.llm import pseudonyms

    texts = ["4111 1111 1111 1111", "a 4111111111111111.", "4111111111111112", "2024-02-29 29.02.2024", "300.1.1.1", "+1 (132) 555-1352", "Me.7@x.example me.7@x.example"]
    made = [r.cleaned for r in pseudonyms.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert made[0].replace(" ", "") == made[1][2:-1] != "4111111111111111" and made[2] == texts[2] and made[4] == texts[4]
    digits = [int(c) for c in reversed(made[1][2:-1])]
    assert sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits)) % 10 == 0
    one, two = made[3].split()
    assert one.split("-") == two.split(".")[::-1]
    assert made[6].split()[0].lower() == made[6].split()[1] and made[6].endswith("@x.example")
    back = spark.range(0, 146097, 41).withColumn("p", pseudonyms.permuted_number(F.col("id"), pseudonyms.DAYS, "t"))
    assert back.filter(pseudonyms.permuted_number(F.col("p"), pseudonyms.DAYS, "t", invert=True) != F.col("id")).count() == 0


def test_cards_beside_numbers(spark):
    from panelscope.llm import pseudonyms

    card, other = "4111111111111111", "378282246310005"
    forms = ["{} 12/27", "{} 123", "5 {}", "{}-737 x", "12 {} 12-27", "{} 2024-02-29", "{} 10.0.0.1", "{} 555-123-4567", "12345678901234567890 {}", "{} 12ab", "{} 4111 1111 1111 1112", "1 2 3 {} 45"]
    texts = [card, other, *[f.format(card) for f in forms], "4111 1111 1111 1111 123", f"{card} {other}", "4111111111111112 12", " ".join(["1234"] * 6000), "7 3"]
    rows = [(r.n_replaced, r.cleaned) for r in pseudonyms.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    new, second = rows[0][1], rows[1][1]
    assert new != card and second != other
    found = dict(zip(texts, rows))
    for form in forms:
        assert found[form.format(card)][1].startswith(form.format(new)[: form.index("{}") + 16]), form
        assert form.startswith("{} 2024") or form.startswith("{} 10.") or form.startswith("{} 555") or found[form.format(card)] == (1, form.format(new)), form
    assert all(found[f.format(card)][0] == 2 for f in forms if f.startswith(("{} 2024", "{} 10.", "{} 555")))
    spaced = found["4111 1111 1111 1111 123"][1]
    assert spaced.replace(" ", "") == new + "123" and spaced.endswith(" 123")
    assert found[f"{card} {other}"] == (2, f"{new} {second}") and found["4111111111111112 12"] == (0, "4111111111111112 12") and found["7 3"] == (0, "7 3")


def test_templates(odd):
    from panelscope.llm.templates import drop_recurring

    rows = {r.doc.doc_id: r for r in drop_recurring(odd).collect() if r.doc.doc_id and r.doc.doc_id >= 100}
    assert rows[100].cleaned == rows[100].doc.text  # the first of each template stays
    assert all(r.cleaned == "" and r.n_dropped == 2 for i, r in rows.items() if i > 100)


@pytest.mark.parametrize("shares", [(30, 30), (110, 12), (40, 40, 40)])
def test_several_templates_in_a_leaf(spark, shares):
    from panelscope.llm.templates import drop_recurring

    forms = ["the daily report lists open roads near {} with few delays", "the daily report was written for {} by our local staff", "the daily report can tell which {} team has won again"]
    rows = [(1000 * f + i, form.format("".join(chr(97 + int(c)) for c in str(7919 * (i + 1))))) for f, (form, n) in enumerate(zip(forms, shares)) for i in range(n)]
    rows += [(9000 + i, "the daily report " + " ".join(f"{chr(97 + i)}w{chr(97 + j)}" for j in range(7))) for i in range(9)]
    found = {r.doc.doc_id: r.n_dropped for r in drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, n in found.items() if not n} == {1000 * f for f in range(len(shares))} | {9000 + i for i in range(9)}


def _prose(i, n, tag=""):
    return [" ".join(f"{tag}{i}x{j}x{k}" for k in range(12)) for j in range(n)]


def test_line_limit_is_the_same_in_a_large_source(spark):
    import corpus_pipeline

    rows = [(i, "\n".join([*_prose(chr(97 + i % 26) * (1 + i // 26), 3), *["read more of this on our site"] * (i < 30)]), "hot") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs.withColumn("n_chars", F.length("text").cast("long")), "").collect()}
    assert len(found) == 2000 and sum("read more" in t for t in found.values()) <= 1 and all(found[i].startswith(rows[i][1].split("\n")[0]) for i in found)


def test_one_of_a_group_of_near_copies_remains(spark):
    import corpus_pipeline

    def copy(i):
        lines = _prose("copy", 10)
        lines[i % 10] += " changed " + "z" * (1 + i)
        return "\n".join(lines)

    rows = [(50 + i, copy(i), "s") for i in range(30)] + [(1, _prose("copy", 1)[0][:40], "s"), (None, copy(31), "s"), (200, "\n".join(_prose("alone", 3)), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    left = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, docs, ""), "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(50, copy(0)), (200, rows[-1][1])]


def test_pipeline(spark, folder, documents):
    import corpus_pipeline

    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == documents.columns, name
        docs = spark.createDataFrame(after.collect(), documents.schema)
    assert corpus_pipeline.run(spark, folder).agg(F.count_distinct("doc_id")).first()[0] == docs.select("doc_id").distinct().count()
