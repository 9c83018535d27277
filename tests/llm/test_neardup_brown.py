import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from codelake.llm import brown, components, neardup

DOCS = "doc_id bigint, text string, row int, class string"


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(i, 200 + (i + 11) % 30) for i in range(200, 230)]
    edges += [(300, 300), (302, 301), (301, 302)]
    random.Random(1).shuffle(edges)
    found = {r.v: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {v: x for v, x in found.items() if v < 50} == dict.fromkeys(range(41), 0)
    assert all(found[v] == 100 for v in range(100, 160)) and all(found[v] == 200 for v in range(200, 230))
    assert found[301] == found[302] == 301 and 300 not in found
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def variants(seed, n, length, changes):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randrange(changes + 1)):
            words[r.randrange(length)] = f"v{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(
    ("block", "size", "words"), [(neardup.BLOCK_ROWS, neardup.BLOCK_BYTES, 5), (7, neardup.BLOCK_BYTES, 4), (neardup.BLOCK_ROWS, 4000, 5)]
)
def test_groups_are_those_of_brute_force(spark, monkeypatch, block, size, words):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
    texts = variants(1, 60, 120, 5) + variants(2, 40, 60, 4) + variants(3, 30, 200, 14) + variants(4, 20, 9, 1)
    texts += [t.upper() + " \n" for t in texts[:20]] + ["a b", "A  b", "a b c", "", None, " \n", "one two three four", "x " * 500, "x x x x x"]
    random.Random(9).shuffle(texts)
    rows = [(i * 7 % 1009, t, 1, "x") for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in neardup.groups(spark.createDataFrame(rows, DOCS), words=words).collect()}
    expected = brute.near_groups([x[:2] for x in rows], words)
    assert len(found) == len(rows)
    for (k, t, *_), top in zip(rows, expected, strict=True):
        assert found[k].n_shingles == len(brute.shingles(t, words)), (k, t)
        assert found[k].component_id == top, (k, t)


def test_rows_without_names_repeats_and_nothing(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long, 1, "x"), (5, long, 1, "x"), (5, long, 1, "x"), (3, long + " end", 1, "x"), (None, "another text here now", 1, "x"), (9, None, 1, "x"), (8, "", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in neardup.groups(docs).collect())
    assert found == [(0, 1, 0), (0, 36, 3), (3, 37, 3), (5, 36, 3), (5, 36, 3), (8, 0, 8), (9, 0, 9)]
    assert neardup.groups(docs.limit(0)).count() == 0


def test_one_of_each(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long, 1, "x"), (3, long, 1, "y"), (3, long, 1, "y"), (1, "a clean text of its own", 1, "z"), (None, None, 1, "n")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r["class"]) for r in kept.collect()) == [(0, "n"), (1, "z"), (3, "y")]


def test_one_of_each_when_files_are_split_differently_at_the_end(spark, tmp_path, monkeypatch):
    rows = [(100 - i, f"a clean text of its own number {i}", 1, "x") for i in range(40)] + [(i + 200, f"copied {i % 3} " * 9, 1, "y") for i in range(9)]
    spark.createDataFrame(rows, DOCS).repartition(7).write.parquet(str(tmp_path / "d"))
    grouped, conf = neardup.groups, "spark.sql.files.openCostInBytes"
    before = spark.conf.get(conf)

    def groups(*args, **kwargs):
        found = neardup.stored(grouped(*args, **kwargs), "found")
        spark.conf.set(conf, "128m")  # one file a task from now on, as after a change of executors
        return found

    monkeypatch.setattr(neardup, "groups", groups)
    try:
        spark.conf.set(conf, "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        kept = sorted(r.doc_id for r in neardup.one_of_each(spark.read.parquet(str(tmp_path / "d"))).collect())
    finally:
        spark.conf.set(conf, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert kept == sorted([100 - i for i in range(40)] + [200, 201, 202])


def test_likelihood_finds_the_similarity():
    r = np.random.default_rng(3)
    for size, shared in ((400, 360), (400, 200), (50, 48), (1000, 0)):
        pool = r.integers(0, 2**64, 2 * size, dtype=np.uint64)
        a, b = pool[:size], np.concatenate([pool[:shared], pool[size : 2 * size - shared]])
        regs = neardup.registers(np.concatenate([a, b]), np.array([0, size]))
        n = np.array([float(size)])
        true = shared / (2 * size - shared)
        assert abs(neardup.likeliest(regs[:1], regs[1:], n, n)[0] - true) < 5 * max(true * (1 - true), 0.02) ** 0.5 / neardup.REGISTERS**0.5
        merged = neardup.registers(np.concatenate([a, b]), np.array([0]))
        assert (merged[0] == np.maximum(regs[0], regs[1])).all()


def objective(matrix):
    return brown.xlogx(matrix).sum() - brown.xlogx(matrix.sum(axis=0)).sum() - brown.xlogx(matrix.sum(axis=1)).sum()


def test_gain_of_a_move_is_the_change_of_the_objective():
    r = np.random.default_rng(2)
    types, classes = 12, 4
    n = r.integers(0, 30, (types, types)).astype(float)
    cls = np.append(0, r.integers(1, classes, types - 1))

    def matrix(c):
        out = np.zeros((classes, classes))
        np.add.at(out, (c[:, None].repeat(types, 1), c[None, :].repeat(types, 0)), n)
        return out

    for t in range(1, types):
        left, right = (np.bincount(cls, x, classes).astype(float) for x in (n[:, t], n[t]))
        best, gain = brown.best_class(int(cls[t]), left, right, n[t, t], matrix(cls))
        moved = [objective(matrix(np.where(np.arange(types) == t, c, cls))) for c in range(1, classes)]
        assert best == 1 + int(np.argmax(moved)) or math.isclose(moved[best - 1], max(moved))
        assert math.isclose(gain, max(moved) - moved[cls[t] - 1], abs_tol=1e-6)


def test_many_types_find_the_classes_they_find_alone():
    r = np.random.default_rng(5)
    types, classes = 40, 6
    n = r.integers(0, 9, (types, types)) * (r.random((types, types)) < 0.3)
    cls = np.append(0, r.integers(1, classes, types - 1))
    matrix = np.zeros((classes, classes))
    np.add.at(matrix, (cls[:, None].repeat(types, 1), cls[None, :].repeat(types, 0)), n)
    rows, alone = [], []
    for t in range(1, types):
        left, right = (np.bincount(cls, x, classes).astype(float) for x in (n[:, t], n[t]))
        alone.append(brown.best_class(int(cls[t]), left, right, float(n[t, t]), matrix))
        left[cls[t]] -= n[t, t]
        right[cls[t]] -= n[t, t]
        counts = [*left, *right, n[t, t]]
        rows += [(t - 1, c, x) for c, x in enumerate(counts) if x]
    row, code, x = (np.array(v) for v in zip(*rows, strict=True))
    best, gain = brown.best_classes(np.arange(1, types), cls[1:], row, code, x.astype(float), matrix)
    assert best.tolist() == [b for b, _ in alone] and np.allclose(gain, [g for _, g in alone])


def test_words_below_the_lexicon_have_classes_of_their_own(spark):
    r = random.Random(6)
    rows = []
    for k in range(400):  # words of three kinds, all with one ending, each after the marks of its kind
        kind = k % 3
        rows.append((k, " ".join(f"start{'abc'[kind]} mark{'def'[kind]} w{kind}{r.randrange(40)}zz" for _ in range(20)), 1, "x"))
    held = [x for x in brown.score(spark.createDataFrame(rows, DOCS), classes=12, lexicon=20).collect() if x.held_out]
    # With one class for all words no token says which kind comes next: a third for the word and for the start after it.
    one_class = (math.log10(1 / 120) + math.log10(1 / 3)) * 20 / 61
    assert sum(x.score for x in held) / sum(x.n_tokens for x in held) > one_class + 0.1


def corpus():
    r = random.Random(4)
    kinds = [[f"{p}{c}{i}" for i in range(30)] for p, c in (("ab", "x"), ("cd", "y"), ("ef", "z"))]
    texts = []
    for k in range(300):
        words = kinds[k % 3]
        texts.append(" ".join(r.choice(words).title() if r.random() < 0.2 else r.choice(words) for _ in range(r.randrange(5, 40))))
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    return rows + [(900, None, 1, "x"), (901, "", 1, "x"), (902, "never Seen before", 1, "x"), (5, texts[5], 1, "x"), (None, "no name", 1, "x")]


def test_scores(spark):
    rows = corpus()
    found = brown.score(spark.createDataFrame(rows, DOCS), classes=6, lexicon=60, common=50).collect()
    assert len(found) == len(rows)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.LOWER)), "\n"]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    c = Counter(w for k, t, *_ in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    texts = {k: t for k, t, *_ in rows}
    ahead = 0
    for r in found:
        ws = tokens(texts[r.doc_id])
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)
        ahead += (r.score - r.base_score) if r.held_out else 0
    assert ahead > 0  # the classes say more about unseen texts than counts alone
    assert brown.score(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("common", [1 << 20, 40])
def test_scores_are_those_of_plain_python_with_the_same_classes(spark, common):
    """`common` of 40 leaves most words to the table: they move once, and scores are corrected for it."""
    r = random.Random(9)
    rows = corpus() + [(2000 + k, " ".join(r.choice("pqr") + str(r.randrange(9)) + r.choice(["aa", "bb"]) for _ in range(60)), 1, "x") for k in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    params = dict(classes=6, lexicon=60, common=common, least=3, rounds=3, most_parts=4, still=0.005)
    slim = docs.selectExpr("monotonically_increasing_id() AS row", "doc_id", "coalesce(crc32(cast(doc_id AS string)), 0) % 5 = 1 AS held_out", "coalesce(text, '') AS text")
    model, _ = brown.fit(slim, **params)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.LOWER)), "\n"]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    train = [tokens(t) for k, t, *_ in rows if not held(k)]
    c = Counter(w for ws in train for w in ws)
    every = sorted({w for _, t, *_ in rows for w in tokens(t)} - {"\n"})
    _, hashes, endings, _ = next(brown.hashed(pa.RecordBatch.from_pydict({"text": [" ".join(every)]})))
    own = {x.word: x.best for x in model.others.collect() if x.best is not None}
    at = model.types.of(hashes, endings)
    cls = {w: own.get(int(h), int(model.cls[t])) for w, h, t in zip(every, hashes, at, strict=True)} | {"\n": 0}
    assert bool(own) == (common == 40)
    matrix = np.zeros((7, 7))
    for ws in train:
        for a, b in zip(["\n", *ws], ws):  # noqa: B905
            matrix[cls[a], cls[b]] += 1
    assert (matrix == model.matrix).all()
    share = (matrix.sum(axis=0) + 1) / (matrix.sum() + 7)
    step = (matrix + share) / (matrix.sum(axis=1, keepdims=True) + 1)
    in_class = [[n for w, n in c.items() if cls[w] == k] for k in range(7)]
    score = lambda ws: sum(
        math.log10(step[cls[a], cls[b]]) + (b != "\n" and math.log10((c[b] + 0.5) / (sum(in_class[cls[b]]) + 0.5 * (len(in_class[cls[b]]) + 1))))
        for a, b in zip(["\n", *ws], ws)  # noqa: B905
    )
    want = sorted((k or 0, len(tokens(t)), score(tokens(t))) for k, t, *_ in rows)
    found = sorted((x.doc_id or 0, x.n_tokens, x.score) for x in brown.score(docs, **params).collect())
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in found], [x[2] for x in want], rtol=1e-9)


def test_nothing_to_train_on(spark):
    only = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1][:3]
    found = brown.score(spark.createDataFrame([(k, "some words", 1, "x") for k in only], DOCS), classes=3).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in found) and len(found) == 3
