"""What joins send to the driver, whatever Spark takes a written table's size to be."""

import pytest
from pyspark.sql import functions as F

from codelake.llm import components, neardup, secrets
from codelake.llm.scratch import joined, small, stored

MANY = 200_001  # one row more than is counted as small


def broadcasts(frame):
    return "Broadcast" in frame._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def named(spark):
    return stored(spark.range(MANY).select(F.col("id").alias("key"), (F.col("id") * 3).alias("of")), "named")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_copies_of_a_table_are_not_broadcast(spark, named, how):
    rows = spark.range(0, 2 * MANY, 1000).select(F.col("id").alias("key"))
    found = joined(rows, named, "key", how)
    assert not broadcasts(found)
    expected = {(k, 3 * k if k < MANY else None) for k in range(0, 2 * MANY, 1000) if how == "left" or k < MANY}
    assert sorted(map(tuple, found.collect())) == sorted(expected, key=lambda r: r[0])
    assert broadcasts(joined(rows, named.limit(1000), "key", how))


def test_a_table_beyond_the_count_is_not_broadcast(spark, named):
    rows = spark.range(0, MANY, 1000).select(F.col("id").alias("key"))
    found = rows.join(small(named), "key", "left")
    assert not broadcasts(found)
    assert sorted(map(tuple, found.collect())) == [(k, 3 * k) for k in range(0, MANY, 1000)]
    assert broadcasts(rows.join(small(named, MANY), "key"))


WORDS = "north south east west river stone cloud ember field glass harbor island jungle kettle ladder meadow".split()


def near_copies():
    texts = [" ".join(WORDS[(i * 7 + j * (i + 3)) % 16] + str(j % 5) for j in range(40)) for i in range(6)]
    return [(10 * i + k, f"{t} {'also ' * k}") for i, t in enumerate(texts) for k in range(4)]


def written_plans(monkeypatch, modules, run):
    """Whether each table that `run` writes is joined by broadcast, as if no table were counted to be small."""
    plans = {}

    def watched(frame, name):
        plans[name] = plans.get(name, False) or broadcasts(frame)
        return stored(frame, name)

    for module in modules:
        monkeypatch.setattr(module, "stored", watched)
        monkeypatch.setattr(module, "small", lambda frame, rows=0: small(frame, -1), raising=False)
    out = run()
    return out, plans


def test_buckets_and_labels_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    docs = spark.createDataFrame(near_copies(), "doc_id bigint, text string")
    expected = sorted(map(tuple, neardup.groups(docs, 4, 0.8).select("doc_id", "component_id").collect()))
    assert len({c for _, c in expected}) < len(expected)
    out, plans = written_plans(monkeypatch, (neardup, components), lambda: neardup.groups(docs, 4, 0.8))
    assert not any(plans[name] for name in ("members", "labelled", "askers", "parents", "labels", "edges")), plans
    assert sorted(map(tuple, out.select("doc_id", "component_id").collect())) == expected


def test_parts_of_secrets_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    text = "login: someone99 and then Abcdefghij0123456789Xyz at https://example.org/x"
    docs = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id bigint, text string")
    expected = sorted(map(str, secrets.scan(docs).select("doc_id", "spans").collect()))
    out, plans = written_plans(monkeypatch, (secrets,), lambda: secrets.scan(docs))
    assert plans["linked"] is False and not broadcasts(out)
    assert sorted(map(str, out.select("doc_id", "spans").collect())) == expected and "ident" in str(expected)
