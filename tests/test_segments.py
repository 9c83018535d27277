"""Segments, kept counts, levels of postings, context by chunk, and streams whatever their order."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from codelake.operators.postings import corpus_stats, vocabulary
from codelake.operators.queries import parse_queries
from codelake.operators.small import settled
from codelake.operators.text_search import best_text, levels_of, planned_levels, request_words, score_text, top_text
from codelake.plans import corpora as C
from codelake.plans.index import index_from_files, open_index, purge, refresh, sweep
from codelake.plans.search import search, with_context
from codelake.schemas import RAW_FILES
from codelake.sources import store as S
from codelake.sources.store import IndexStore


def raw(spark, snapshot):
    rows = [("r", p, len(t), 1, bytearray(t, "utf-8"), None) for p, t in snapshot.items()]
    return spark.createDataFrame(rows, RAW_FILES).coalesce(1)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rare" + str(rng.randrange(9))]) for _ in range(n))


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def shown(index):
    out = {}
    for name in ("files", "chunks", "symbols", "postings"):
        frame = getattr(index, name)
        hidden = ("segment", "bucket", "mtime", "content_hash")
        out[name] = sorted(map(str, frame.select(*[c for c in frame.columns if c not in hidden]).collect()))
    return out


def counted(index):
    kept = {r.term: r.n for r in index.terms.groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0").collect()}
    recount = {r.term: r.df for r in vocabulary(index.postings).collect()}
    assert kept == recount and kept
    kept, recount = index.stats.first(), corpus_stats(index.chunks).first()
    assert (kept.n_chunks, kept.n_tokens) == (recount.n_chunks, recount.n_tokens)


def test_refreshes_write_what_changed_and_merges_keep_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MERGE_FACTOR", 3)
    rng = random.Random(3)
    where = str(tmp_path / "index")
    store = IndexStore(spark, where)
    snapshot = {f"d/f{i}.py": f"def f{i}(): pass\n# {words(rng, 300)}\n" for i in range(80)}
    refresh(spark, raw(spark, snapshot), where, "r", buckets=2, chunk_lines=3)
    full = size_of(where)
    for step in range(6):
        before = size_of(where)
        snapshot["d/f7.py"] = f"def g{step}(): pass\n# {words(rng, 30)}\n"
        if step % 2:
            del snapshot[f"d/f{step + 20}.py"]
            snapshot[f"d/new{step}.py"] = "x = 1\n" * step
        counters = refresh(spark, raw(spark, snapshot), where, "r", chunk_lines=99)
        assert counters["files_indexed"] == 1 + step % 2 and counters["files_deleted"] == step % 2
        now = store.snapshot()
        if step < 2:  # later ones may merge
            assert size_of(where) - before < full / 4
        assert len(now.segments) <= 6
        if step in (1, 5):
            counted(open_index(spark, where))
    fresh = str(tmp_path / "fresh")
    refresh(spark, raw(spark, snapshot), fresh, "r", buckets=2, chunk_lines=3)
    assert shown(open_index(spark, where)) == shown(open_index(spark, fresh))
    assert store.snapshot().n > 7  # merges made snapshots of their own
    due = list(store.snapshot().segments)
    store.merge(store.snapshot(), due)
    assert len(store.snapshot().segments) == 1 and store.snapshot().superseding == ()
    counted(open_index(spark, where))
    assert shown(open_index(spark, where)) == shown(open_index(spark, fresh))
    sizes = store.bytes_on_disk()
    for name, size in sizes.items():
        listed = f"{where}/{name}/segment={store.snapshot().ids[0]}"
        assert size == size_of(listed)
    assert sweep(spark, where, retention_seconds=3600) == 0  # readers may still use them
    assert sweep(spark, where, retention_seconds=0) > 0
    assert size_of(where) < 1.2 * sum(sizes.values())
    assert shown(open_index(spark, where)) == shown(open_index(spark, fresh))
    purge(spark, where)
    sweep(spark, where, retention_seconds=0)
    assert size_of(where) == 0 and open_index(spark, where).files.count() == 0


def test_levels_give_the_best_chunks_without_touching_all(spark, tmp_path, files_of):
    rng = random.Random(8)
    texts = {f"{'ab'[i % 2]}/f{i}.{'py' if i % 3 else 'md'}": words(rng, rng.randrange(1, 400)) + "\n" for i in range(300)}
    texts = {p: t + "some " * rng.randrange(1, 30) * (i % 5 < 2) for i, (p, t) in enumerate(texts.items())}
    texts |= {f"a/top{i}.py": "alpha some " * 40 + "\n" for i in range(12)}
    where = str(tmp_path / "index")
    refresh(spark, raw(spark, texts), where, "r", buckets=2)
    texts |= {"a/f1.py": "nothing\n", "b/more.py": "alpha " * 60 + "\n"}
    refresh(spark, raw(spark, texts), where, "r")
    asked = C.requests(spark, ("some", "some lang:python", "some path:b/", "alpha", "beta lang:python", "gamma path:a/", "rare3", "alpha beta", "alp*", '"alpha beta"', "nowhere", "^alpha"), 5, 0)
    index, plain = open_index(spark, where), index_from_files(files_of(texts))
    parsed = settled(parse_queries(asked), "parsed")
    columns = ["query_id", "path", "chunk_id", "score"]
    best = sorted(map(tuple, best_text(index, parsed, 5).select(*columns).collect()))
    for other in (index, plain):
        every = top_text(score_text(other, parsed), parsed, 5).select(*columns)
        assert sorted(map(tuple, every.collect())) == best
    assert len(best) > 30
    _, all_words = request_words(index, parsed.filter("text_query = 'some' AND lang_filter IS NULL AND path_filter IS NULL"))
    single = all_words.select("query_id", "term")
    levels = levels_of(index, parsed, single).collect()
    first, more = planned_levels(index, parsed, single, 5)
    read = {r.level for r in levels if r.first} | ({r.level for r in more.collect()} if more is not None else set())
    skipped = sum(r.n for r in levels if r.level not in read)
    assert skipped > 40 and first.count() == 5


def test_context_is_that_of_the_whole_file(spark, tmp_path):
    texts = {f"f{i}.py": "".join(f"# line {k} of {i}\n" for k in range(1, 8 + i)) + "def needle():\n    return 1\n" + "# tail\n" * i for i in range(14)}
    texts["odd.py"] = "# a\x0bb\n" * 9 + "def needle():\n    pass\n" + "# x\x1dy\n" * 5
    texts["short.py"] = "def needle(): pass"
    where = str(tmp_path / "index")
    refresh(spark, raw(spark, texts), where, "r", buckets=2, chunk_lines=3)
    for context in (0, 2, 10):
        asked = C.requests(spark, ("def:needle",), 50, context)
        index = open_index(spark, where)
        rows = with_context(index, search(index, asked), asked).collect()
        assert len(rows) == 16
        for r in rows:
            lines = texts[r.file_path].removesuffix("\n").split("\n")
            lo, hi = max(1, r.line_number - context), min(len(lines), r.line_number + context)
            expected = [f"{n:4d} | {lines[n - 1].rstrip()}" for n in range(lo, hi + 1)] if context else []
            assert list(r.context_lines) == expected


def test_prefixes_of_every_length(spark, tmp_path):
    texts = {"a.py": "cat catalog Cattle dog\n", "b.py": "c d\n", "é.py": "élan ca\n"}
    where = str(tmp_path / "index")
    refresh(spark, raw(spark, texts), where, "r", stem=False)
    asked = C.requests(spark, ("c*", "cat*", "catal*", "zzz*", "e*", "catalogs*"), 9, 0)
    index = open_index(spark, where)
    found = sorted((r.query_id, r.path) for r in score_text(index, settled(parse_queries(asked), "p")).collect())
    assert found == [(0, "a.py"), (0, "b.py"), (0, "é.py"), (1, "a.py"), (2, "a.py"), (4, "é.py")]


VERSIONS = [(1, "one", False), (2, "two", False), (3, None, True), (3, "three", False), (2, "TWO", False)]


@pytest.mark.parametrize("last", [VERSIONS, [*VERSIONS[:4], (4, "four", False)]])
def test_streamed_versions_in_all_orders(spark, tmp_path, last):
    """One path for each order of five versions; a batch brings one version of every path."""
    from codelake.plans.index import apply_delta
    from codelake.streaming.refresh import VERSIONS as SHAPE
    from codelake.streaming.refresh import plan_versions

    store = IndexStore(spark, str(tmp_path / "index"), 2)
    orders = list(itertools.permutations(range(5)))
    for k in range(5):
        rows = []
        for i, order in enumerate(orders):
            mtime, text, deleted = last[order[k]]
            rows.append(("r", f"p{i}.py", len(text or ""), mtime, bytearray(text.encode()) if text else None, deleted))
        batch = spark.createDataFrame(rows, SHAPE).coalesce(1)
        for _ in range(2 if k == 2 else 1):  # a batch that is replayed changes nothing
            now = store.snapshot()
            apply_delta(store, plan_versions(batch, store.table("files", now), store.table("deleted", now)))
    index = open_index(spark, store.directory)
    assert index.files.count() == (0 if last is VERSIONS else len(orders))
    texts = {r.content for r in index.chunks.select("content").collect()}
    assert texts == (set() if last is VERSIONS else {"four"})


def test_arrivals_are_files_by_bytes(spark, tmp_path, monkeypatch):
    """How many files, and so triggers, a stream brings follows from its contents, not from how many tasks wrote it."""
    from codelake.plans.registered import delta

    rows = spark.range(0, 200, 1, 32).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100).cast("binary").alias("content"))
    for name, at_most, files in (("few", delta.ARRIVING, 4), ("more", 2_000, 10)):
        monkeypatch.setattr(delta, "ARRIVING", at_most)
        delta.arrive(rows, str(tmp_path / name))
        assert len(list((tmp_path / name).glob("*.parquet"))) == files
        assert spark.read.parquet(str(tmp_path / name)).distinct().count() == 200
