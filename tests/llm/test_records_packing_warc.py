import base64
import gzip
import hashlib
import struct
import tracemalloc
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelake.llm import checksums, packing, records, warc
from codelake.llm.tokenids import Encoder, encoder

DOCS = "doc_id bigint, text string, part int, length string"
TEXTS = ["", None, " ", "\n\n", "a  b", "don't we'll\tgo", "é à\u0085 q  ", "日本 語。", "trail  ", "x" * 3000 + " y", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "<|endoftext", "a b <|endoftext|>",
         "a\x1cb \x1c c", "one, two. three! four? " * 200, "naïve façade—“quoted” ×÷"]


def docs(spark, texts=TEXTS, repeat=1):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] * repeat + [(None, "no id", 1, "x")]
    return spark.createDataFrame(rows, DOCS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Z9'.,!\n\t\r\x1c\xa0 　éß×日-s")), max_size=40), max_size=6))
def test_ids_are_the_tokenizers(texts):
    ids, sizes = encoder(brute.VOCABULARY).encode(pa.array(texts, pa.string()))
    expected = [x[:-1] for x in brute.ids_of(texts)]
    assert sizes.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]


def test_special_tokens_by_choice():
    texts = pa.array(["a <|endoftext|> b", None, "", "plain", "<|endoftext|>"])
    ids, sizes = encoder(brute.VOCABULARY).encode(texts)
    assert ids.tolist()[:4] == [64, 220, 50256, 275] and sizes.tolist()[-1] == 1
    ids, sizes = encoder(brute.VOCABULARY, ordinary=True).encode(texts)
    assert 50256 not in ids.tolist() and sizes.tolist()[1:3] == [0, 0]


def test_forgetting_changes_no_id():
    texts = [f"word{i} other{i % 7}" for i in range(200)]
    small = Encoder(brute.VOCABULARY, remembered=20)
    for part in (texts[:50], texts[50:], texts):
        ids, _ = small.encode(pa.array(part))
        assert ids.tolist() == [i for x in brute.ids_of(part) for i in x[:-1]]


def test_pieces_met_last_stay_remembered():
    small = Encoder(brute.VOCABULARY, remembered=100)
    learned = []
    learn = small._learn
    small._learn = lambda keys, *others: (learned.append(len(keys)), learn(keys, *others))
    for i in range(20):
        small.encode(pa.array([" ".join(["often", *(f"other{j}" for j in range(20)), *(f"new{i}x{j}" for j in range(10))])]))
        assert len(small.keys) <= 100 and len(small.flat) == small.size.sum()
    assert learned == [31, *[10] * 19]


def test_a_worker_holds_little_while_it_encodes():
    texts = pa.array([" ".join(f"w{i}x{j % 50}" for j in range(400)) for i in range(700)])
    known = encoder(brute.VOCABULARY)
    known.encode(texts)
    tracemalloc.start()
    ids, sizes = known.encode(texts)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int(sizes.sum()) == len(ids) > 500_000
    assert held < 24 << 20, held


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert plain_crc32c(b"123456789") == 0xE3069283
    sizes = np.array([0, 1, 2, 3, 255, 256, 257, 511, 512, 513, 1500])
    words = np.random.default_rng(1).integers(0, 65536, sizes.sum()).astype("<u2")
    at = np.append(0, np.cumsum(sizes))
    expected = [plain_crc32c(words[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
    assert checksums.crc32c(words, sizes).tolist() == expected


@pytest.mark.parametrize("width", [2, 4])
def test_records_round_trip(spark, tmp_path, width):
    written = records.write(docs(spark), brute.VOCABULARY, str(tmp_path / "out"), width=width)
    found = records.read(written, records.with_start(written.index), with_ids=True).collect()
    found.sort(key=lambda r: r.start)
    expected = [(None, "no id"), *enumerate(TEXTS)]
    ids = brute.ids_of([t for _, t in expected])
    assert [r.doc_id for r in found] == [k for k, _ in expected]
    assert [list(r.ids) for r in found] == ids and [r.ids_crc32 for r in found] == [brute.crc_of(x) for x in ids]
    assert [r.start for r in found] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    some = written.index.filter("doc_id % 3 = 1").orderBy("n_tokens")
    assert {r.doc_id: r.ids_crc32 for r in records.read(written, some).collect()} == {
        k: brute.crc_of(x) for (k, _), x in zip(expected, ids, strict=True) if k is not None and k % 3 == 1
    }
    # The frame itself, by the format's definition.
    file = sorted((tmp_path / "out/data").glob("*.rec"))[0].read_bytes()
    (length,) = struct.unpack_from("<Q", file)
    mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) % 2**32
    assert struct.unpack_from("<I", file, 8)[0] == mask(plain_crc32c(file[:8]))
    assert struct.unpack_from("<I", file, 12 + length)[0] == mask(plain_crc32c(file[12 : 12 + length]))


def test_records_damage_repeats_and_nothing(spark, tmp_path):
    written = records.write(docs(spark, ["same"], 30), brute.VOCABULARY, str(tmp_path / "a"))
    assert written.index.count() == 31
    file = next((tmp_path / "a/data").glob("*.rec"))
    data = bytearray(file.read_bytes())
    data[13] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        records.read(written).collect()
    none = records.write(docs(spark).limit(0), brute.VOCABULARY, str(tmp_path / "b"))
    assert records.read(none).count() == 0


def test_packing(spark):
    texts = TEXTS + [f"{'word ' * (i % 90)}{i}" for i in range(300)]
    found = packing.pack(docs(spark, texts), brute.VOCABULARY, capacity=64, with_ids=True).collect()
    ids = {k: x for k, x in zip([*range(len(texts)), None], brute.ids_of([*texts, "no id"]), strict=True)}
    lengths = [n for x in ids.values() for n in brute.cut_lengths(len(x), 64)]
    assert sorted(r.length for r in found) == sorted(lengths)
    by = {}
    for r in found:
        assert list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] and r.ids_crc32 == brute.crc_of(r.ids)
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, x in ids.items():
        mine = sorted((r.piece, r.start, r.length) for r in found if r.doc_id == k)
        assert [n for _, _, n in mine] == brute.cut_lengths(len(x), 64) and [p for p, _, _ in mine] == list(range(len(mine)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= brute.best_fit_decreasing(lengths, 64)
    assert packing.pack(docs(spark).limit(0), brute.VOCABULARY).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_supersteps_are_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    room, placed = {}, {}
    for length, first, count, sequence, each, offset in packing.supersteps(counts, 40):
        assert first == placed.get(length, 0)
        placed[length] = first + count
        for i in range(count):
            s, at = sequence + i // each, offset + i % each * length
            assert room.get(s, 0) == at
            room[s] = at + length
    assert placed == counts and all(n <= 40 for n in room.values())
    assert len(room) == brute.best_fit_decreasing(lengths, 40)


PAGES = "page_id bigint, url string, html string, refers_to int, chunk string"


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 300 + "<p>"
    rows = [(1, "http://a/\r\nX: y", "same", 0, ""), (5, None, "same", 0, ""), (3, "u", "same", 0, ""), (4, "u", big, 0, ""), (6, "u", None, 0, ""),
            (7, "u", "", 0, ""), (8, "u", "WARC/1.1\r\n\r\n", 0, ""), (9, "u", "twice", 0, ""), (9, "u", "twice", 0, ""), (None, "u", "same", 0, ""),
            (None, "u", "alone", 0, "")]
    pages = spark.createDataFrame(rows, PAGES)
    files = warc.write(pages, str(tmp_path / "w"), size=64)
    found = warc.read(files, size=50).collect()
    ends = [r for r in found if r.last]
    assert len(ends) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in ends)
    full = [(k, "response", 0) for k in (0, 4, 5, 7, 8, 9, 9)]
    assert kinds == sorted([*full, (0, "revisit", 5), (1, "revisit", 5), (3, "revisit", 5), (6, "revisit", 7)])
    raw = big.encode()
    chunks = sorted((r.chunk, r.data, r.bytes_so_far) for r in found if r.page_id == 4)
    assert b"".join(bytes(d) for _, d, _ in chunks) == raw and len(chunks) == -(-len(raw) // 50) and chunks[-1][2] == len(raw)
    for r in ends:
        html = next(h for k, _, h, *_ in rows if k == r.page_id) if r.page_id is not None else None
        if html is not None or r.page_id == 6:
            digest = base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
            assert r.payload_digest == digest and r.payload_bytes == len((html or "").encode())
            assert r.record_type == "revisit" or r.digest_so_far == digest
    file = sorted(Path(tmp_path / "w/data").glob("*.warc.gz"))[0]
    assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    large = warc.read(warc.write(pages, str(tmp_path / "v"), least=5)).filter("record_type = 'revisit'")
    assert large.count() == 0


def test_warc_chunks_that_are_shuffled_stay_in_order(spark, tmp_path):
    rows = [(i, "u", f"<p>{i % 7}</p>" * (1 + i % 7 * 40), 0, "") for i in range(60)] + [(1, "u", "other", 0, "")] + [(2, "u", "t" * 500, 0, "")] * 9
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    records = []
    for most in (0, 200_000):
        found = warc.read(warc.write(pages, str(tmp_path / f"m{most}"), size=64, most=most), size=64).collect()
        assert all(r.bytes_so_far <= r.payload_bytes for r in found)
        records.append(sorted((r.page_id, r.record_type, r.refers_to or -1, r.payload_bytes, r.payload_digest) for r in found if r.last))
    assert records[0] == records[1] and len(records[0]) == len(rows)
    assert sum(r[1] == "response" for r in records[0]) == 7 + 1 + 9


def test_warc_damage_and_nothing(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a payload", 0, "")], PAGES)
    files = warc.write(pages, str(tmp_path / "w"))
    assert warc.write(pages.limit(0), str(tmp_path / "n")).count() == 0
    path = Path(files.first().file)
    text = gzip.decompress(path.read_bytes()).replace(b"a payload", b"b payload")
    path.write_bytes(gzip.compress(text))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(files).collect()
