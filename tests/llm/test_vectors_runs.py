"""Hard negatives, near-duplicate vectors and periodic runs against brute force on edge rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import negatives, queries, runs, vecdup

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, score int, class string"
EMPTY = [(0, None, 1), (1, [], 1), (2, [NAN, 1.0], 1), (3, [INF, 1.0], 1), (4, [None, 1.0], 1), (5, [0.0, 0.0], 1), (6, [1.0, 0.0], None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, None) for r in rows], SCHEMA)


def fits(row):
    return row[1] is not None and row[2] is not None and all(x is not None and math.isfinite(x) for x in row[1])


def dot(a, b):
    whole = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole(a), whole(b), strict=True))))


def brute_negatives(rows, positives=5, k=10, low=30, high=90):
    rows, out = [r for r in rows if fits(r)], []
    order = lambda t: (-t[0], t[1] is None, t[1] or 0, t[2])
    for i, a in enumerate(rows):
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(
            [(dot(a[1], b[1]), b[0], j, b[2] == a[2]) for j, b in enumerate(rows) if j != i and len(a[1]) == len(b[1])], key=order
        )
        for p in [s for s in scored if s[3]][:positives]:
            inside = [s for s in scored if not s[3] and low * p[0] <= 100 * s[0] <= high * p[0]][:k]
            out += [(a[0], p[1], r + 1, s[1], p[0], s[0]) for r, s in enumerate(inside)]
    return sorted(out, key=str)


def vectors(seed, n=300, dims=4, labels=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=dims))], int(rng.integers(labels))) for i in range(n)]
    rows += [(int(i), rows[i][1], rows[i][2]) for i in range(0, 60, 3)]  # repeated rows, anchors among them
    rows += [(None, rows[i][1], int(rng.integers(labels))) for i in range(5)]  # ties
    rows += [(1000 + i, rows[i][1], int(rng.integers(labels))) for i in range(40)]
    rows += [(2000 + 50 * i, [float(x) for x in np.float32(rng.normal(size=3))], 1 + i % 2) for i in range(20)]
    rows += [(3000 + i, [1e30 * (1 + i), -1e12, 5.0, 3e18], 1 + i % 3) for i in range(6)]
    return rows + EMPTY + [(4000, [], 1), (4100, [], 1), (4101, [], 2)]


@pytest.mark.parametrize("waves", [8 << 20, 200])
def test_negatives(spark, monkeypatch, waves):
    monkeypatch.setattr(negatives, "WAVE_BYTES", waves)
    rows = vectors(3, n=120) if waves == 200 else vectors(1)
    found = negatives.mine(frame(spark, rows).coalesce(1), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, found), key=str) == brute_negatives(rows)


def test_negatives_of_ties_and_nothing(spark):
    same = [(i, [1.0, 1.0], i % 2) for i in range(300)]
    found = negatives.mine(frame(spark, same).coalesce(1), F.col("vec_id") % 100 == 0, low=100, high=100).collect()
    expected = brute_negatives(same, low=100, high=100)
    assert expected and sorted(map(tuple, found), key=str) == expected
    assert negatives.mine(frame(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.mine(frame(spark, EMPTY), F.col("vec_id") % 100 == 0).collect() == []


def brute_links(rows, least=0.93):
    out = []
    usable = [fits(r) and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.abs(np.array(r[1], float)).max() if u else None for r, u in zip(rows, usable, strict=True)]
    unit = [u / np.sqrt((u * u).sum()) if u is not None else None for u in unit]
    near = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                near[i].append(j)
                near[j].append(i)
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [k for k in near[todo.pop()] if k not in seen]
            seen |= set(new)
            todo += new
        smallest = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((r[0], len(near[i]), smallest, r[0] == smallest))
    return sorted(out, key=str)


def clustered(seed):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, 8))
    rows = []
    for i in range(400):
        v = heads[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.05, 0.3, 0.6])
        rows.append((int(i), [float(x) for x in np.float32(v)], int(rng.integers(2))))
    rows += [(500 + i, rows[7][1], rows[7][2]) for i in range(120)]  # copies
    rows += [(700 + i, [1e-3 * x for x in rows[i][1]], rows[i][2]) for i in range(10)]
    return rows + [(None, *rows[9][1:]), (11, *rows[11][1:]), (None, [0.1, 0.2], 1)] + EMPTY + [(800, [1e30, 1.0], 1), (801, [2e30, 1.0], 1)]


@pytest.mark.parametrize("limits", [{}, {"cell_rows": 10, "block_bytes": 1000}, {"cell_rows": 60, "block_bytes": 2000, "rounds": 1}])
def test_near_duplicate_vectors(spark, limits):
    rows = clustered(5)
    found = vecdup.groups(frame(spark, rows), 0.93, **limits).collect()
    assert sorted(map(tuple, found), key=str) == brute_links(rows)


def test_near_duplicate_vectors_of_nothing(spark):
    assert vecdup.groups(frame(spark, [])).collect() == []
    found = vecdup.groups(frame(spark, EMPTY)).collect()
    assert sorted(map(tuple, found)) == [(i, 0, i, True) for i in range(7)]


def test_cells_keep_products_few():
    """Vectors around far centroids are guests nowhere."""
    c = np.eye(8)
    near = (c @ c.T)[0]
    sine = (near[0] - near[1:]) / np.sqrt(2)
    assert (sine > np.sqrt(1 - 0.93**2)).all()


def brute_runs(words, least_words=6, periods=4):
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(least_words, periods * q):
                w = words[s:j]
                if all(any(w[k] != w[k - p] for k in range(p, len(w))) for p in range(1, q)):
                    out.append((s, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text, loops=True):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if loops and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def texts():
    rng = np.random.default_rng(11)
    out = [None, "", " \t\n\x0b\r", "a", "a b", "a a a a a a", "A a A a A a A a", "a a a a a", "x é é é é é é y", "           "]
    out += [" ".join(rng.choice(list("ab"), rng.integers(1, 90))) for _ in range(120)]
    for _ in range(120):  # nested and neighbouring runs
        base = list(rng.choice(list("abc"), rng.integers(1, 9)))
        inner = base * int(rng.integers(1, 6)) + list(rng.choice(list("ab"), rng.integers(0, 3)))
        out.append(" \n".join(["z"] * int(rng.integers(0, 8)) + inner * int(rng.integers(1, 7)) + list(rng.choice(list("ab"), 4))))
    return out + [" ".join("abcd"[i % 4] for i in range(300)), " ".join(["long" * 50] * 40), "w " * 5000]


def test_runs(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a a a a a a a"), (3, "b b b b b b")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, runs string")
    found = runs.digest(runs.find_runs(runs.looped(docs))).collect()
    assert sorted(map(tuple, found), key=str) == sorted((brute_digest(*r) for r in rows), key=str)
    plain = runs.digest(runs.find_runs(docs)).collect()
    assert sorted(map(tuple, plain), key=str) == sorted((brute_digest(*r, loops=False) for r in rows), key=str)
    assert runs.find_runs(docs.limit(0)).collect() == []


def test_runs_of_long_texts(spark):
    """A text above the slice of 2 MB, one word above it, and a constant text of 600,000 words."""
    unit = [f"w{i}" for i in range(999)]
    rows = [(1, " ".join(unit * 600)), (2, "y" * (3 << 20) + " z" * 7), (3, "a " * 600_000), (4, "q")]
    found = {r.doc_id: r for r in runs.find_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [tuple(r) for r in found[1].runs] == [(0, 599_400, 999)] and found[1].collapsed == " ".join(unit)
    assert [tuple(r) for r in found[2].runs] == [(1, 7, 1)] and found[2].collapsed == "y" * (3 << 20) + " z"
    assert [tuple(r) for r in found[3].runs] == [(0, 600_000, 1)] and found[3].collapsed == "a"
    assert found[4].runs == [] and found[4].collapsed == "q"


def test_queries_on_edge_rows(spark, tmp_path):
    """The registered queries, on a folder with all the edge rows."""
    rows = [(r[0], r[1], r[2]) for r in vectors(2, n=150) if r[0] is not None]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    again = [(i, v, (label + 1) % 10 if label is not None and i % 7 == 0 else label) for i, v, label in rows]
    found = queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
    assert sorted(map(tuple, found.collect()), key=str) == brute_negatives(again)
    found = queries.QUERIES["op12_embedding_near_dedup"](spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, found.collect()), key=str) == brute_links(rows)
    docs = list(enumerate(texts()))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == sorted((brute_digest(*r) for r in docs), key=str)
