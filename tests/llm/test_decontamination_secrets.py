import random

import brute
import pytest
from pyspark.sql import functions as F

from codelake.llm import decontamination, secrets

DOCS = "doc_id bigint, text string, item_id string, hashes int"
ITEMS = "item_id bigint, text string, doc_id string"


def sample(seed, n):
    r = random.Random(seed)
    return [r.choice("abcdefgh") + r.choice("klmnop") + str(r.randrange(60)) for _ in range(n)]


def test_containment_is_that_of_brute_force(spark):
    r = random.Random(5)
    items = [(i, " ".join(sample(i, n)), "x") for i, n in enumerate([5, 6, 9, 12, 20, 30, 60, 120, 4, 1])]
    items += [(20, None, "x"), (21, "", "x"), (22, items[3][1], "x")]
    docs = []
    for k in range(150):
        words = sample(1000 + k, r.choice([0, 10, 40, 800]))
        for item in r.sample(items[:8], 2):
            passage = item[1].split()
            for _ in range(r.randrange(4)):
                passage[r.randrange(len(passage))] = "changed"
            words[r.randrange(len(words) + 1) : 0] = passage[r.randrange(2) :]
        docs.append((k, r.choice([" ", "  \n", ", "]).join(words).upper(), "x", 1))
    items += [(30, "What is 7+5?", "x"), (31, "日本語の文章", "x"), (32, "WHAT is", "x"), (33, "5 extra", "x"), (34, "7 5", "x")]
    docs += [(300, "so, what is 7 + 5 then", "x", 1), (301, "what is 75", "x", 1), (302, "是 日本語の文章。", "x", 1), (303, "日本語の文章", "x", 1)]
    docs += [(304, "is what 7", "x", 1), (305, "what", "x", 1), (306, "w " * 300_000 + "what  IS", "x", 1), (None, "7 5", "x", 1)]
    docs += [(200, None, "x", 1), (201, "", "x", 1), (202, items[9][1], "x", 1), (203, items[6][1], "x", 1), (203, items[6][1], "x", 1)]
    found = decontamination.contained(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    pairs = [(x.doc_id, x.item_id) for x in found]
    assert len(pairs) == len(set(pairs)) and len(pairs) > 100
    assert set(pairs) == brute.contained_pairs([d[:2] for d in docs], [i[:2] for i in items])
    assert {(300, 30), (302, 31), (None, 34), (306, 32)} <= set(pairs)


def test_clean_keeps_columns_and_judges_rows(spark):
    leak = " ".join(sample(1, 20))
    rows = [(1, f"so {leak} it goes", "x", 1), (1, "a clean one", "x", 1), (None, leak, "x", 1), (None, None, "x", 1), (2, "", "x", 1)]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7, leak, "x")], ITEMS)
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([r for r in docs.collect() if leak not in (r.text or "")], key=str)
    assert decontamination.clean(docs, items.limit(0)).count() == 5
    assert decontamination.clean(docs.limit(0), items).count() == 0
    assert decontamination.contained(docs, items, least=1.0).count() == 2


KEY = "AKIA" + "Q" * 12
TEXTS = [
    None, "", "nothing here", f"x {KEY} y", "AKIAQ", "password=short", 'Password" : "abcdefgh', "token=token=abcdefgh123", "é api_key=日 apikey:aaaaaaaa",
    "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "0g" + "f" * 40, f"{KEY}{KEY} secret={KEY}", "paſſword=abcdefghi", "toKen=abcdefghi",
    "password=" + "a" * 5000,
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 0), (None, TEXTS[3], "x", 0)], DOCS)
    found = secrets.scan(docs).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        text = TEXTS[3 if r.doc_id is None else r.doc_id]
        assert [(s.start, s["rank"], s.kind, s.end) for s in r.base] == brute.base_spans(text)
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert secrets.scan(docs.limit(0)).count() == 0


VALUE = "aB3" + "dEfGh1jKlMnOpQrStUv"


@pytest.mark.parametrize(
    ("text", "weak"),
    [
        (f"{VALUE} alone", set()),
        (f"{KEY} then {VALUE}", {"value"}),
        (f"{KEY} {'far ' * 100}{VALUE}", set()),
        ("user=alice only", set()),
        ("user=alice and password=hunter2hunter2", {"ident"}),
        (f"client_id: abc123\n{VALUE}", {"ident", "value"}),
        ("see https://example.com/a", set()),
        (f"https://example.com/a {KEY}", set()),
        (f"https://example.com/a {KEY} password=abcdefgh1", {"endpoint"}),
        (f"mongodb://host/db user=alice {VALUE}", {"endpoint", "ident", "value"}),
    ],
)
def test_weak_parts_need_their_complements(spark, text, weak):
    rows = spark.createDataFrame([(1, "pad " * 90 + text, "x", 0), (1, "user=bob", "x", 0)], DOCS)
    found = [s.kind for r in secrets.scan(rows).collect() for s in r.spans if s["rank"] > 2]
    assert set(found) == weak and len(found) == len(weak)


def test_redaction(spark):
    rows = [(1, f"a {KEY} b", "x", 0), (1, "clean", "x", 0), (2, f"a {KEY} b", "x", 0), (2, f"a {KEY} b", "x", 0), (None, None, "x", 0), (None, "password=abcdefgh1!", "x", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.char_length("text"))
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r.text or "" for r in out.collect())) == ["", "<assign>!", "a <access> b", "a <access> b", "a <access> b", "clean"]
    assert out.filter("n_chars <> char_length(text)").count() == 0
    assert secrets.redact(docs.limit(0)).count() == 0
