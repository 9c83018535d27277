import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from codelake.llm import chat, quality, sharding

DOCS = "doc_id bigint, text string, shard int, n_words string"


def test_jump_hash_and_slots(spark):
    rows = [(k, "é" * (k % 5), 9, "x") for k in [*range(-3, 400), 2**62, -(2**63), -9208964101768337578, -4597278083340949674]] + [(7, "é" * 2, 9, "x")] * 50 + [(None, None, 9, "x")]
    found = sharding.shard(spark.createDataFrame(rows, DOCS), shards=16, cell_rows=3).collect()
    assert len(found) == len(rows)
    for r in found:
        key = r.doc_id or 0
        assert (r.shard, r.grown_shard, r.law) == (brute.jump(key, 16), brute.jump(key, 17), "key")
        assert r.grown_shard in (r.shard, 16)
    for s in range(16):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert next(r.size for r in found if r.doc_id is None) == 1
    places = {r.doc_id: (r.shard, r.grown_shard) for r in found}
    # Keys whose walk meets a quotient that six decimal places would round up.
    assert (places[-9208964101768337578], places[-4597278083340949674]) == ((4, 4), (8, 8))
    assert {r.size for r in found if r.doc_id == 7} == {5}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("a"))
    counts = {}
    for n in (1, 2, 5):
        rows = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(keys, shards=n).collect()}
        counts[n] = rows
        assert all(0 <= s < n and g in (s, n) for s, g in rows.values())
        assert abs(sum(g == n for _, g in rows.values()) - 3000 / (n + 1)) < 250
    assert {k: g for k, (_, g) in counts[1].items()} == {k: s for k, (s, _) in counts[2].items()}
    assert sharding.shard(keys.limit(0)).count() == 0


def test_quality_counts(spark):
    line = "one two three four five six seven eight nine"
    texts = [
        None, "", " \t\n", "word", f"{line}\n{line}\nother\n\n{line}", f"{line} {line} and more", "a\x0bb\x0cc\rd  e",
        "été # * $ % & | < > 日本語", "x " * 50, "same line\nsame line\n same line\n", " ".join(map(str, range(60))),
    ]
    docs = spark.createDataFrame([(i, t, 1, "kept") for i, t in enumerate(texts)] + [(4, texts[4], 1, "kept")], DOCS)
    found = quality.judge(docs).collect()
    assert len(found) == len(texts) + 1 and found[0].row.n_words == "kept"
    for r in found:
        t = texts[r.row.doc_id] or ""
        ws = brute.words(t)
        c = r.counts
        assert c.n_words == len(ws) and c.word_chars == sum(map(len, ws))
        assert c.n_symbols == sum(ch in "#*$%&|<>" for ch in t)
        assert c.n_dup_lines == brute.duplicate_lines(t)
        assert c.n_repeat_words == brute.repeated_words(t)
        assert ("words" in r.failed) == (len(ws) < 20)
        assert ("repeated_words" in r.failed) == (100 * c.n_repeat_words > 30 * len(ws))


def test_quality_verdicts(spark):
    good = "The house by the river was old and the people of the town liked to walk there in the evening with their friends."
    bad = {"symbols_per_word": " ".join(["###"] * 30 + ["the"] * 5), "stop_words": " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(60)),
           "letter_words": "the " + " ".join(str(i) for i in range(40)), "cut_lines": "\n".join(f"the line number {i} goes on and on ..." for i in range(6))}
    docs = spark.createDataFrame([("good", good), *bad.items()], "name string, text string")
    found = {r.row.name: r.failed for r in quality.judge(docs).collect()}
    assert found["good"] == []
    assert all(name in found[name] for name in bad)
    assert quality.judge(docs.limit(0)).count() == 0
    only = (quality.Rule("long", "n_words", high=30),)
    assert {r.row.name for r in quality.judge(docs, rules=only).collect() if r.failed} == set(bad)


TURNS = "conv_id bigint, turn bigint, role string, text string, example string"


@pytest.mark.parametrize("said", ["</s>[INST] ok [/INST]", "<|end|>", "\\<|end|>\\", "<", "a\\|b<\\|turn|>", "", None, "x\n<|text|>\n"])
def test_chat_reads_back_what_was_said(spark, said):
    rows = [(1, 0, "user", said, "e"), (1, 1, "assistant", said, "e"), (1, 2, "user", "b", "e"), (1, 3, "assistant", said, "e"), (1, 4, "user", "<", "e")]
    laid = chat.lay_out(spark.createDataFrame(rows, TURNS))
    examples = chat.expand(laid).cache()
    assert examples.count() == 3
    one = chat.digest(laid).first()
    text = said or ""
    turns = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows)
    assert one.n_turns == 5 and one.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert one.loss_chars == 2 * len(text) and one.loss_sha256 == hashlib.sha256((2 * text).encode()).hexdigest()
    for r in examples.collect():
        assert (r.loss_length > 0) == (r.example < 2 and text != "")
    read = examples.select(
        "example", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_start").cast("int"), F.col("loss_length")).alias("loss"),
    ).orderBy("example").collect()
    for r, upto in zip(read, (2, 4, 5), strict=True):
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3] or "") for x in rows[:upto]]
        assert r.loss == (text if upto < 5 else "")


def test_chat_cells_shift_what_they_hold(spark):
    """Cells of two turn numbers give the same turns as one cell, and both those of plain Python."""
    rng = random.Random(3)
    rows = [(c, rng.choice([None, -3, *range(12)]), rng.choice(["user", "assistant", "<|text|>"]), "x" * rng.randrange(9), "e")
            for c in (1, 1, 1, 2, 3) for _ in range(14)]
    conversations = spark.createDataFrame(rows, TURNS).repartition(3)
    want = []
    for c in (1, 2, 3):
        own = sorted((-(2**63) if t is None else t, role, text) for k, t, role, text, _ in rows if k == c)
        start = example = 0
        for i, (_, role, text) in enumerate(own):
            shown = f"<|turn|>{role.replace('<|', chr(60) + chr(92) + '|')}<|text|>{text}<|end|>"
            trained = role == "assistant"
            ends, loss = trained or i + 1 == len(own), len(text) if trained else 0
            mask = (example, start + len(shown) - len("<|end|>") - loss, loss) if ends else (None, None, None)
            want.append((c, i, start, shown, *mask))
            start, example = start + len(shown), example + trained
    for cell in (2, 1000):
        laid = chat.lay_out(conversations, cell=cell)
        found = laid.select("conv_id", "nth", "start", "formatted", "example", "loss_start", "loss_length").collect()
        assert sorted(map(tuple, found), key=lambda r: r[:2]) == want


def test_chat_examples_are_written_out(spark, monkeypatch):
    """Each example holds its whole context, and the digest is read from the written examples, not from the turns."""
    said = ["a", "<|end|>", "b", "", "c\\", "reply", "<"]
    rows = [(7, i, "assistant" if i % 2 else "user", text, "e") for i, text in enumerate(said)] + [(8, 0, "user", "x", "e")]
    laid = chat.lay_out(spark.createDataFrame(rows, TURNS))
    whole = {}
    for r in sorted(chat.write_out(laid).collect(), key=lambda r: (r.conv_id, r.example, r.nth)):
        whole.setdefault((r.conv_id, r.example), []).append(r)
    assert {k: len(v) for k, v in whole.items()} == {(7, 0): 2, (7, 1): 4, (7, 2): 6, (7, 3): 7, (8, 0): 1}
    texts = {(r.conv_id, r.example): r for r in chat.expand(laid).collect()}
    for key, parts in whole.items():
        assert [p.nth for p in parts] == list(range(len(parts)))
        assert texts[key].formatted == "".join(p.formatted for p in parts)
        assert [p.loss_start for p in parts] == [None] * (len(parts) - 1) + [texts[key].loss_start]
        assert {p.last for p in parts} == {key in ((7, 3), (8, 0))}
    sizes = {c: sum(len(r.formatted) for (conv, _), r in texts.items() if conv == c) for c in (7, 8)}
    assert {r.conv_id: r.formatted_chars for r in chat.digest(laid).collect()} == sizes
    written = chat.write_out(laid)
    monkeypatch.setattr(chat, "write_out", lambda turns: written.filter("conv_id = 8"))
    assert [r.conv_id for r in chat.digest(laid).collect()] == [8]


def test_chat_edges(spark):
    rows = [(None, 0, "assistant", "a", "e"), (None, 0, "user", "b", "e"), (2, 1, None, None, "e"), (3, None, "assistant", "y", "e"),
            (3, 1, "assistant", "x", "e"), (3, 1, "assistant", "x", "e"), (3, 1, "assistant", "w", "e")]
    found = chat.digest(chat.lay_out(spark.createDataFrame(rows, TURNS))).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in found) == [(0, 1, 0), (0, 1, 1), (2, 1, 0), (3, 4, 4)]
    three = next(r for r in found if r.conv_id == 3)
    assert three.loss_sha256 == hashlib.sha256(b"ywxx").hexdigest()
    assert chat.digest(chat.lay_out(spark.createDataFrame([], TURNS))).count() == 0
