"""Secret scans with multipart credential linking.

Patterns that are evidence by themselves (assignments, access identifiers, long hex runs) are reported as they stand.
Weak candidates (an account name, a mixed token, an address) are common in clean text; one is reported only if parts
that complete it to a credential stand within `scope` code points: a secret needs an identifier, an identifier a
secret, an address both. Parts are found inside each text by the regular-expression library and linked by an interval
join: scopes are cut into bins, parts meet in the bins they reach, and the gap between them decides.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.scratch import small, stored, whole

SCOPE = 200
KINDS = ("assign", "access", "hex", "ident", "value", "endpoint")
BASE = KINDS[:3]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "value": "secret", "endpoint": "endpoint"}
NEEDS = {"ident": ("secret",), "value": ("identifier",), "endpoint": ("identifier", "secret")}

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
IDENT = re.compile(
    r"""\b(?:access_?key(?:_?id)?|client_?id|account_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""",
    re.I | re.A,
)
VALUE = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"\b(?:https?|ftp|s3|gs|jdbc:[a-z]+|mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqps?)://[^\s\"'<>]+", re.I | re.A)

PART = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def parts_of(text: str) -> list[tuple[str, int, int]]:
    """All parts of a text as (kind, start, end) in code points, weak candidates that touch no base span included."""
    low = text.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    weak = []
    if "=" in text or ":" in text:
        weak += [("ident", *m.span()) for m in IDENT.finditer(text)]
        if "://" in text:
            weak += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if DIGIT.search(text):
        weak += [("value", *m.span()) for m in VALUE.finditer(text)]
    if weak:
        # Base spans and weak candidates are few per text, and both are walked in order of their starts.
        taken = sorted(f[1:] for f in found)
        at, reach = 0, -1
        for part in sorted(weak, key=lambda p: p[1:]):
            while at < len(taken) and taken[at][0] < part[2]:
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= part[1]:
                found.append(part)
    return found


DIGIT = re.compile(r"[0-9]")


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (row, doc_id, parts) per document; `row` numbers the rows, so repeated ids stay apart."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in parts_of(t)] if t else []
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(found, pa.list_(PART))], names=["row", "doc_id", "parts"]
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    )
    return rows.mapInArrow(find, "row bigint, doc_id bigint, parts array<struct<kind string, start int, end int>>")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates (row, kind, start, end) that other parts of the same row complete."""
    weak = [k for k in KINDS if k not in BASE]
    roles = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    spread = found.filter(F.exists("parts", lambda p: p["kind"].isin(weak)) & (F.size("parts") > 1)).select(
        "row", F.explode("parts").alias("p")
    )
    spread = stored(spread.select("row", "p.kind", "p.start", "p.end", roles[F.col("p.kind")].alias("role")), "parts")

    def bins(reach: int):
        low = F.floor((F.col("start") - reach) / scope)
        return F.explode(F.sequence(low, F.floor((F.col("end") + reach) / scope))).alias("bin")

    a = spread.filter(F.col("kind").isin(weak)).select("row", "kind", "start", "end", "role", bins(scope)).alias("a")
    b = small(spread.select("row", "start", "end", "role", bins(0)).alias("b"))
    near = a.join(
        b,
        (F.col("a.row") == F.col("b.row")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.role") != F.col("b.role"))
        & (F.col("b.start") - F.col("a.end") <= scope) & (F.col("a.start") - F.col("b.end") <= scope),
    )
    met = near.groupBy("a.row", "a.kind", "a.start", "a.end").agg(F.collect_set("b.role").alias("roles"))
    enough = F.lit(False)
    for kind, needs in NEEDS.items():
        enough = enough | ((F.col("kind") == kind) & (F.size(F.array_intersect("roles", F.array(*map(F.lit, needs)))) == len(needs)))
    return met.filter(enough).select("row", "kind", "start", "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row (row, doc_id, base, spans) per document: arrays of spans (start, rank, kind, end) in order.

    `base` has the spans that stand alone, `spans` these and the linked ones. Null and empty texts have none. Rows
    equal in id or text are scanned each; a null id stays null. Other columns are ignored; an empty table gives no rows.
    """
    found = stored(parts(docs, doc_id, text), "secrets")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def span(p):
        return F.struct(p["start"].alias("start"), rank[p["kind"]].alias("rank"), p["kind"].alias("kind"), p["end"].alias("end"))

    more = stored(
        linked(found, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")), "linked"
    )
    base = F.filter("parts", lambda p: p["kind"].isin(*BASE))
    rows = found.select("row", "doc_id", base.alias("found")).join(small(more), "row", "left")
    added = F.coalesce("more", F.array().cast("array<struct<kind string, start int, end int>>"))
    return rows.select(
        "row", "doc_id",
        F.array_sort(F.transform("found", span)).alias("base"),
        F.array_sort(F.transform(F.concat("found", added), span)).alias("spans"),
    )


def joined(spans):
    """Spans as `kind:start:end`, separated by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; n_chars, where there is one, follows.

    Documents without spans, null and empty texts among them, are left as they are. Overlapping spans are replaced
    together, under the first one's kind; of spans that start together, that of the kind listed first. Rows are numbered
    once and written with their numbers, so repeated rows and null ids are each cut by their own spans. A very long text
    is cut whole, in one task. An empty table gives no rows.
    """
    placed = docs.select(whole(docs).alias("row"), F.monotonically_increasing_id().alias("key"))
    keyed = stored(placed, "placed")
    found = scan(keyed.select("row.text", "key"), scope=scope, doc_id="key").filter(F.size("spans") > 0)
    found = stored(found.select(F.col("doc_id").alias("key"), "spans"), "redactions")

    @F.pandas_udf("string")
    def replaced(texts, spans):
        return texts.combine(spans, lambda t, s: t if s is None else cut(t, s))

    def cut(text, spans):
        out, done = [], 0
        for s in spans:
            if s["start"] >= done:
                out += [text[done : s["start"]], f"<{s['kind']}>"]
            done = max(done, s["end"])
        return "".join([*out, text[done:]])

    both = keyed.join(small(found), "key", "left").withColumn(
        "text", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(replaced("row.text", "spans"))
    )
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(size)
    return both.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
