"""The pipeline against a brute-force version of all its stages."""

import random

import brute
import pytest

import corpus_pipeline
from codelake.llm import quality
from codelake.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, counts string, row int"


def prose(r, n):
    common = ["the", "of", "and", "to", "in"]
    return " ".join(r.choice(common) if r.random() < 0.4 else f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice('aeiou')}n" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    texts = [prose(r, r.choice([25, 60, 200])) for _ in range(40)]
    items = [prose(r, 30) for _ in range(4)]
    texts += [t.upper() for t in texts[:5]] + [t + " end" for t in texts[5:10]] + texts[10:14]
    texts += [f"{prose(r, 80)} {i} {prose(r, 80)}" for i in items]
    texts += [f"{prose(r, 30)} password=abcdefgh{i} {prose(r, 30)}" for i in range(3)]
    texts += [None, "", "too short", "### " * 40, f"{prose(r, 9)}\n" * 30, prose(r, 9000), "a" * 5000]
    rows = [(1000 - i, t, "en", "s", len(t or ""), "x", 1) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (9, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), [x[:2] for x in rows], [*enumerate(items)]


def test_every_stage_and_the_whole(spark, folder):
    path, rows, items = folder
    kept = [(k, t) for k, t in rows if brute.keeps_quality(t, quality.STOP_WORDS)]
    assert 10 < len(kept) < len(rows)
    after = {"quality_rules": kept}
    tops = brute.near_groups(kept, 5)
    after["near_duplicates"] = kept = [x for x, top in zip(kept, tops, strict=True) if x[0] == top]
    leaked = {k for k, _ in brute.contained_pairs(kept, items)}
    assert leaked
    after["benchmark_decontamination"] = kept = [x for x in kept if x[0] not in leaked]

    def redacted(text):
        for start, _, kind, end in reversed(brute.base_spans(text)):
            text = text[:start] + f"<{kind}>" + text[end:]
        return text

    after["secret_scans"] = kept = [(k, redacted(t)) for k, t in kept]
    assert any("<assign>" in t for _, t in kept)

    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = corpus_pipeline.stored(out, name)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(after[name]), name
    ids = dict(zip([k for k, _ in kept], brute.ids_of([t for _, t in kept]), strict=True))
    found = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.length for r in found) == sorted(n for x in ids.values() for n in brute.cut_lengths(len(x), 1024))
    assert all(r.ids_crc32 == brute.crc_of(ids[r.doc_id][r.start : r.start + r.length]) for r in found)
    assert len({r.sequence_id for r in found}) <= brute.best_fit_decreasing([r.length for r in found], 1024)


def test_languages_without_a_list_need_no_stop_words(spark):
    text = " ".join(f"слово{i} другое{i}" for i in range(40))
    langs = ["ru", None, "en", "de-AT", "ko"]
    rows = [(i, text, x, "s", len(text), "x", 1) for i, x in enumerate(langs)]
    kept = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4]


def test_nothing_in_nothing_out(spark, folder, tmp_path):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_number_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scans", "best_fit_packing",
    ]
