"""Hard negatives, best-two-fit packing and the Merkle manifest against brute force and on odd tables."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

ODD = "doc_id long, text string, source string, lang string, n_chars long, tree string, `group` long, at string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "a", "en", 3), (2, "", "a", "en", None), (3, " \n\t", None, "de", 0), (4, "one", "a", None, 1), (5, "one", "a", "en", 1), (5, "one", "a", "en", 1), (5, "one", "a", "en", 1), (6, long, None, "é", 7), (None, "no id here", "b", "en", 2), (None, None, None, None, None), (7, "", "", "", -5)]
    return spark.createDataFrame([(*r, "x", 2, "y") for r in rows], ODD)


# ---- token ids


def test_token_ids_of_odd_texts():
    from panelscope.llm import token_ids
    from panelscope.llm.token_count import default_path

    own = token_ids.Encoder(default_path())
    texts = [None, "", " \n", "a<|endoftext|>b é\u0085c\x1cd ΑΣ İ", "'s don't I'LL", "x́. A.B c... ... d?! 12, e2. F;", "x y. " * 300_000, "z" * 5000, "<| <|endoftext|> <|ENDOFTEXT|>"]
    for _ in range(2):
        for text, ids in zip(texts, own.texts(pa.array(texts)), strict=True):
            assert own.tokenizer.encode(text or "", add_special_tokens=False).ids == ids.tolist()
    limit, token_ids.KNOWN = token_ids.KNOWN, 5  # forgets at every batch
    try:
        assert [x.tolist() for x in own.texts(pa.array(["a b", "c, d e. f"] * 3))][4:] == [own.ids("a b").tolist(), own.ids("c, d e. f").tolist()]
    finally:
        token_ids.KNOWN = limit


# ---- best-two-fit


def plain_two_fit(sizes, capacity):
    """The sizes of each sequence, by looking at all pairs."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        own, room = [], capacity
        for size in list(left):
            if size <= room:
                own.append(size)
                left.remove(size)
                room -= size
        if room and len(own) > 1:
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if own[-1] < a + b <= room + own[-1]]
            if pairs:
                _, a, b = max(pairs)
                left.remove(a)
                left.remove(b)
                left = sorted([*left, own.pop()], reverse=True)
                own += [a, b]
        bins.append(own)
    return bins


def test_two_fit_equals_all_pairs():
    from panelscope.llm.two_fit import best_two_fit

    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([10, 50, 200])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 40))]
        found = defaultdict(list)
        for size, (sequence, offset) in zip(sizes, best_two_fit(sizes, capacity)):
            found[sequence].append((offset, size))
        got = [[size for _, size in sorted(found[s])] for s in range(len(found))]
        assert got == plain_two_fit(sizes, capacity)
        assert all(sum(own) <= capacity for own in got) and sorted(x for own in got for x in own) == sorted(sizes)
    # 60 and 30 leave 10: 30 makes room for 25 and 15
    assert best_two_fit([60, 30, 25, 15], 100) == [(0, 0), (1, 0), (0, 60), (0, 85)]


def test_pieces_and_sequences(spark, folder, odd):
    from tokenizers import Tokenizer

    from panelscope.llm import queries
    from panelscope.llm.token_count import default_path
    from panelscope.llm.two_fit import pack_two_fit

    tokenizer = Tokenizer.from_file(default_path())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = queries.op12_best_two_fit(spark, folder).collect()
    total, sequences = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == total[r.doc_id] == 2048 * r.piece and r.length == len(ids) and (r.length == 2048 or r.start + r.length == len(want[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        total[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert total == {k: len(v) for k, v in want.items()}
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.01 * sum(total.values()) / 2048 + 1

    found = pack_two_fit(odd).collect()
    assert sum(r.start == 0 for r in found) == 11 and {(r.doc_id, r.length) for r in found if r.doc_id in (1, 2, 7)} == {(1, 1), (2, 1), (7, 1)}
    assert sum(r.doc_id == 5 for r in found) == 3 and max(r.piece for r in found if r.doc_id == 6) > 100
    assert sorted(map(str, found)) == sorted(map(str, pack_two_fit(odd).collect()))
    assert pack_two_fit(odd.filter("false")).count() == 0


# ---- Merkle manifest


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root of rows (doc_id, source, lang, n_chars, text)."""
    digest = lambda *parts: sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(field, r))

    def climb(level):
        levels = [level]
        while len(level) > 1:
            level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
            levels.append(level)
        return levels

    def fold(own, number, levels):
        siblings = []
        for level in levels[:-1]:
            other = level[number ^ 1] if (number ^ 1) < len(level) else ""
            siblings.append(other)
            own = digest(other, own) if number % 2 else digest(own, other)
            number //= 2
        return own, siblings

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted([r for r in rows if r[2] == x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: climb([leaf(r) for r in own[x]]) for x in langs}
    top = climb([trees[x][-1][0] for x in langs])
    out = []
    for at, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            subroot, low = fold(leaf((*r[:3], r[3] + 1, r[4]) if changed else r), i, trees[x])
            folded, high = fold(subroot, at, top)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[x][-1][0], root, digest(*low, *high), folded, folded == root))
    return out


def test_layout_is_recursive():
    from panelscope.llm.merkle import address, layout

    for height in range(11):
        places = np.concatenate(layout(height))
        assert sorted(places.tolist()) == list(range((2 << height) - 1))
    # four levels: the upper two, then four subtrees of two levels, each in one piece
    assert [address(4, d, np.arange(1 << d)).tolist() for d in range(4)] == [[0], [1, 2], [3, 6, 9, 12], [4, 5, 7, 8, 10, 11, 13, 14]]


def test_manifest(spark, odd):
    from panelscope.llm.merkle import manifest

    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    more = [(100 + i, f"s{i % 3}", "en" if i % 3 else f"x-{i}", i, f"text {i} é") for i in range(150)]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, source string, lang string, n_chars long, text string"), allowMissingColumns=True)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest(docs, {"n_chars": F.col("n_chars") + 1}, tampered).collect()
    assert Counter(map(tuple, found)) == Counter(plain_manifest([tuple(r) for r in docs.select(*columns).collect()]))
    assert any(not r.verified for r in found) and manifest(odd.filter("false")).count() == 0
    assert all(r.verified for r in manifest(odd).collect())


@pytest.mark.parametrize("height", [1, 2, 3, 5])
def test_blocks_over_blocks_equal_one_tree(height):
    from panelscope.llm.merkle import Subtree, combine, height_of, path_fold

    for count in [*range(1, 20), 31, 32, 33, 97]:
        leaves = [sha256(str(i).encode()).digest() for i in range(count)]
        plain = leaves
        while len(plain) > 1:
            plain = [combine(*plain[i : i + 2]) for i in range(0, len(plain), 2)]
        paths, level = [[] for _ in leaves], leaves
        at = list(range(count))
        while True:
            size = min(height, height_of(len(level)))
            blocks = [Subtree(len(level[i : i + (1 << height)]), size).build(level[i : i + (1 << height)]) for i in range(0, len(level), 1 << height)]
            for i in range(count):
                paths[i] += blocks[at[i] >> height].siblings(at[i] & ((1 << height) - 1))
                at[i] >>= height
            level = [b.node(size, 0) for b in blocks]
            if len(level) == 1:
                break
        assert level == plain and all(path_fold(leaves[i], i, paths[i]) == plain[0] for i in range(count))


def test_manifest_of_several_levels_of_blocks(spark):
    from panelscope.llm.merkle import manifest

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") != 7, "en").alias("lang"), F.col("id").alias("n_chars"), F.lit("t").alias("text")).repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest(docs, {"n_chars": F.col("n_chars") + 1}, tampered).collect()
    assert Counter(map(tuple, found)) == Counter(plain_manifest([(i, "s", "en" if i != 7 else None, i, "t") for i in range(3000)]))


# ---- hard negatives


def plain_negatives(rows, anchor, k=5):
    fine = []
    for key, vector, label in rows:
        if key is not None and label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            fine.append((key, [int(np.floor(256 * float(x))) for x in vector], label))
    product = lambda a, b: max(1 - (1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))
    out, anchors = [], {}
    for row in fine:
        if anchor(row[0]):
            anchors[row[0]] = min(anchors.get(row[0], row), row, key=lambda r: (r[2], r[1]))
    for key, own, label in anchors.values():
        scored = sorted(((-product(own, v), i, x) for i, v, x in fine))
        positives = [(i, -s) for s, i, x in scored if x == label and i != key][:k]
        for i, top in positives:
            negatives = [(-s, j) for s, j, x in scored if x != label and 80 * top <= -100 * s <= 100 * top][:k]
            out += [(key, i, n + 1, j, top, s) for n, (s, j) in enumerate(negatives)]
    return Counter(out)


@pytest.mark.parametrize("scale", [1.0, 0.01, 2.0**19, 2.0**40])
def test_negatives_equal_all_pairs(spark, scale, monkeypatch):
    from panelscope.llm import angular_negatives

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6)) * 2
    rows = [(i, (scale * (centres[i % 4] + rng.normal(size=6) * (0.2 if i % 3 else 2))).tolist(), int(rng.integers(0, 3))) for i in range(240)]
    rows += [(i % 50, rows[i % 50][1], rows[i % 50][2]) for i in range(60)]  # repeated rows
    nan = float("nan")
    rows += [(None, [1.0] * 6, 1), (300, None, 1), (301, [1.0, None], 1), (302, [nan], 1), (303, [float("inf")], 1), (304, [1.0], None), (305, [], 1), (310, [0.0] * 6, 2), (320, [scale], 1), (30, [scale * 2.0] * 8, 0)]
    vectors = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<double>, label int, chunk string, block int, norm double").repartition(5)
    monkeypatch.setattr(angular_negatives, "BLOCK", 64)
    monkeypatch.setattr(angular_negatives, "CHUNK", 16)
    found = angular_negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0).collect()
    got = Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)
    assert got == plain_negatives(rows, lambda i: i % 10 == 0)
    assert angular_negatives.hard_negatives(vectors.filter("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold_and_prune():
    from panelscope.llm.angular_negatives import angles, bounds

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 16))
    rows = np.floor(256 * (np.repeat(centres, 200, 0) + 0.05 * rng.normal(size=(1000, 16))))
    rows[0], rows[1], rows[2] = 0, rows[3], -rows[3]
    unit = centres / np.linalg.norm(centres, axis=1)[:, None]
    stored, norms = angles(rows, unit), np.sqrt((rows**2).sum(1))
    kept = 0
    for i in range(0, 1000, 10):
        lower, upper = bounds(norms[i], stored[i], norms, stored)
        scores = rows @ rows[i]
        assert np.all(lower <= scores) and np.all(scores <= upper)
        kept += int((upper >= 0.9 * norms[i] ** 2).sum())
    assert kept < 0.35 * 100 * 1000
