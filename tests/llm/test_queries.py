"""Registered queries on a folder of edge rows, every contract column against plain Python."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

import brute
from codelake.llm.queries import QUERIES

rng = random.Random(11)
SOME = [f"w{i}" for i in range(400)]
LONG = " ".join(rng.choice(SOME) for _ in range(700_000))  # above a slice of 2 MB
PARTS = ["password=hunter2hunter", "AKIA" + "Q7" * 8, "API_KEY : 'abcdefgh.ij'", "deadbeef" * 5, "é", "\n", "token=short", "x", "https://h.example/p"]


def _texts():
    near = [" ".join(rng.choice(SOME) for _ in range(120)) for _ in range(4)]
    copies = [t + f" tail{i}" for i, t in enumerate(near * 3)] + near + [near[0].upper()]
    marks = ["a <|endoftext|> b", "<|endoftext|>", "　  x", "Tab\tand\x0bmore\x1cno", "one", "one two three", "one two three", "\U0001f600 é" * 40]
    found = [" ".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30))) for _ in range(25)]
    long_near = LONG[: LONG.rindex(" ")] + " changed"
    return [None, "", " \n\t", "", None, *marks, *copies, *found, LONG, long_near]


DOCS = [(i * 7 % 100 + 100 * (i // 50), t) for i, t in enumerate(_texts())]
TEXT = {k: t or "" for k, t in DOCS}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("edge")
    assert len(TEXT) == len(DOCS)
    rows = [(k, t, "e", i) for i, (k, t) in enumerate(DOCS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, row string, shard int").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, None if i == 3 else "u", h) for i, h in enumerate(HTML)], "page_id bigint, url string, html string").write.parquet(
        f"{where}/pages.parquet"
    )
    return str(where)


HTML = [None, "", "<p>same</p>", "é" * 300_000, "<p>same</p>", None, "alone", "<p>same</p>", "\r\n\r\nWARC/1.1\r\n", "x" * 3_000_000]


@pytest.fixture(scope="module")
def ids():
    return dict(zip(TEXT, brute.ids_of(TEXT.values()), strict=True))


def test_op1(spark, folder, ids):
    found = QUERIES["op1_best_fit_packing"](spark, folder).collect()
    places, pieces = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == brute.crc_of(ids[r.doc_id][r.start : r.start + r.length])
    for k, x in ids.items():
        at = 0
        for i, (piece, start, length) in enumerate(sorted(pieces[k])):
            assert (piece, start) == (i, at) and (length == 1024 or i == 0)
            at += length
        assert at == len(x) and len(pieces[k]) == -(-len(x) // 1024)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= brute.best_fit_decreasing([r.length for r in found], 1024)


def test_op10(spark, folder, ids):
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_binary_records"](spark, folder).collect()}
    at, expected = 0, {}
    for k in sorted(ids):
        expected[k] = (at, len(ids[k]), brute.crc_of(ids[k]))
        at += len(ids[k])
    assert found == expected


def test_op2_base(spark, folder):
    tokens = {k: [*brute.words(t.translate(brute.LOWER)), None] for k, t in TEXT.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in TEXT}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = counts.total(), len(counts)
    found = QUERIES["op2_brown_scores"](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(TEXT)
    for r in found:
        ws = tokens[r.doc_id]
        base = math.fsum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        known = sum(counts[w] > 0 for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and math.isfinite(r.score)


def test_op3(spark, folder):
    found = QUERIES["op3_shards"](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(TEXT) and {r.law for r in found} == {"key"}
    slots = {}
    for r in found:
        raw = TEXT[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert (r.shard, r.grown_shard) == (brute.jump(r.doc_id, 16), brute.jump(r.doc_id, 17))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op4(spark, folder):
    found = {r.doc_id: r for r in QUERIES["op4_secret_scans"](spark, folder).collect()}
    assert sorted(found) == sorted(TEXT)
    for k, text in TEXT.items():
        spans = brute.base_spans(text)
        kinds = Counter(kind for _, _, kind, _ in spans)
        r = found[k]
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        lines = [f"{kind}:{start}:{end}" for start, _, kind, end in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(lines).encode()).hexdigest()
        assert Counter(lines) <= Counter(r.spans.split(","))


def test_op5(spark, folder):
    rows = sorted(TEXT.items())
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op5_near_duplicates"](spark, folder).collect()}
    groups = brute.near_groups(rows, 4)
    assert found == {k: (len(brute.shingles(t, 4)), g, g == k) for (k, t), g in zip(rows, groups, strict=True)}
    assert len(set(groups)) < len(rows)


def test_op6(spark, folder):
    found = {r.page_id: r for r in QUERIES["op6_warc"](spark, folder).collect()}
    top = {h or "": i for i, h in enumerate(HTML)}
    assert sorted(found) == list(range(len(HTML)))
    for i, h in enumerate(HTML):
        raw, r = (h or "").encode(), found[i]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = top[h or ""]
        expected = (len(raw), digest, "response", None) if first == i else (len(raw), digest, "revisit", first)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == expected
