"""Periodic runs of words by an online sparse dynamic program over diagonals.

Diagonal q holds the matches of a word with the word q places before it. A run of period q is a long unbroken stretch on
it: as long as words match, the stretch grows by one, and where they stop, the run is given out. Following every earlier
occurrence of every word would touch a number of diagonals that is quadratic in a frequent word, so only the diagonals
that can hold a run are active:

* In a run of smallest period q, a gram of at least q words occurs last exactly q places before, never nearer: a nearer
  occurrence would give the run a smaller period.
* So for grams of 1, 2, 4, ... words the nearest earlier occurrence of a word's gram is its only active diagonal. Grams of
  g words serve the periods from g/2 + 1 to g; a run of four periods has more than g/2 of them in a row, so none is missed.
* A stretch counts if it cannot be extended on its diagonal. One whose diagonal has been left for a nearer one before the
  words stopped matching has a smaller period and is no run of this one.

A gram of 2g words can only recur where both its halves do, so the places still looked at shrink quickly from one length
to the next. All words of a slice of texts go through a step together, as arrays.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.textkernel import lower_words, mixed, parts, ranges, span_hashes, utf8

LEAST_WORDS, LEAST_PERIODS = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs_of(codes: np.ndarray, first: np.ndarray, least_words: int, least_periods: int) -> tuple[np.ndarray, ...]:
    """(start, length, period) of all runs; `codes` are words, row r has those from first[r] to first[r + 1].

    `least_periods` of 4 or more: with fewer the nearest occurrence need not be the period.
    """
    if least_periods < 4:
        raise ValueError("at least four periods")
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end = first[:-1][row], first[1:][row]
    n = end - begin
    at = np.flatnonzero(n >= least_words)
    hashes = np.zeros(len(codes), np.uint64)
    hashes[at] = mixed(codes[at] ^ mixed(row[at].astype(np.uint64) + np.uint64(1)))  # rows share no gram
    again = np.zeros(len(codes), bool)
    found, g = [], 1
    while len(at):
        order = np.argsort(hashes[at], kind="stable")  # equal grams in order of place
        h, p = hashes[at][order], at[order]
        same = h[1:] == h[:-1]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][same]] = (p[1:] - p[:-1])[same]
        active = np.flatnonzero((lag > g // 2) & (lag <= g))
        if len(active):
            q = lag[active]
            head = np.append(True, (np.diff(at[active]) != 1) | (np.diff(q) != 0))
            heads = np.flatnonzero(head)
            q, start = q[heads], at[active][heads] - q[heads]
            stop = at[active][np.append(heads[1:], len(active)) - 1] + g
            long = stop - start >= np.maximum(least_words, least_periods * q)
            start, stop, q = start[long], stop[long], q[long]
            lo, hi = begin[start], end[start]
            closed = (start == lo) | (codes[np.maximum(start - 1, 0)] != codes[np.maximum(start - 1, 0) + q])
            closed &= (stop == hi) | (codes[np.minimum(stop, len(codes) - 1)] != codes[np.minimum(stop, len(codes) - 1) - q])
            found.append((start[closed], stop[closed] - start[closed], q[closed]))
        again[at] = False
        again[p[1:][same]] = True
        again[p[:-1][same]] = True
        # The next grams are for periods of g + 1 and more.
        at = at[again[at] & (at + 2 * g <= end[at]) & (n[at] >= least_periods * (g + 1))]
        at = at[again[at + g]]
        hashes[at] = mixed(hashes[at] * _STEP ^ hashes[at + g])
        g *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, one blank between two."""
    words = np.flatnonzero(keep)
    row_end = np.searchsorted(words, first)
    size = ends[words] - starts[words] + 1
    last = row_end[1:][row_end[1:] > row_end[:-1]] - 1
    size[last] -= 1
    flat = np.append(data, np.uint8(32))[ranges(starts[words], size)]
    upto = np.append(0, np.cumsum(size))
    blank = np.ones(len(words), bool)
    blank[last] = False
    flat[upto[1:][blank] - 1] = 32
    buffers = [None, pa.py_buffer(upto[row_end].astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]
    return pa.StringArray.from_buffers(len(first) - 1, buffers[1], buffers[2])


def find_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per document.

    Words are what stands between blanks and are told apart by 64-bit hashes of their bytes. `runs` are (start, length,
    period), by start, then period: stretches with that smallest period, of at least `least_words` words and
    `least_periods` periods, that neither neighbour extends. `collapsed` is the text without the words that follow the
    first period of some run, one blank between two words. Null and empty texts have no words, no runs, and collapse to
    the empty text. A row is judged alone: repeated rows and null ids are given as often as they stand there. A very long
    text is worked on whole, in one task, with about 150 bytes a word beside it. Other columns are ignored; an empty
    table gives no rows.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            data, offsets = utf8(batch.column("text"))
            _, starts, ends, first = lower_words(data, offsets)
            at, length, period = runs_of(span_hashes(data, starts, ends), first, least_words, least_periods)
            depth = np.zeros(len(starts) + 1, np.int64)
            np.add.at(depth, at + period, 1)
            np.add.at(depth, at + length, -1)
            keep = np.cumsum(depth)[:-1] == 0
            place = np.searchsorted(at, first)
            fields = [pa.array(c) for c in (at - np.repeat(first[:-1], np.diff(place)), length, period)]
            runs = pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(run)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), runs, joined_words(data, starts, ends, first, keep)],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shape = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(find, shape)


def looped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with the tail of a tenth of the texts repeating itself, by h = crc32 of the decimal doc_id.

    Where h % 10 = 0 and the text has n > 0 words, with g = h div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8), every
    word i >= a becomes word a + (i - a) % p, one blank between two words. A null doc_id has no h and stays as it is.
    """
    g = F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) div 10")

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        place = F.struct(words.alias("w"), a.alias("a"), p.alias("p"))

        def made(s: Column) -> Column:
            numbers = F.sequence(F.lit(0), F.size(s["w"]) - 1)
            there = F.transform(numbers, lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"]))))
            return F.array_join(there, " ")

        return F.transform(F.array(place), made)[0]

    # As a lambda's argument the words and the place are computed once, not once for each word.
    words = F.transform(F.array(F.expr(rf"regexp_extract_all(text, r'{WORD}', 0)")), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(""))[0]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 10 = 0") & F.col("text").isNotNull()
    return rows.select("doc_id", F.when(chosen, words).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Per document of `find_runs`: number of runs, the greatest one, and digests of the runs and of the collapsed text.

    The greatest run has the greatest length, then the smallest start, then the smallest period; nulls where there is none.
    """
    key = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.get(F.array_sort(key), F.lit(0))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    top = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return top.select(
        "doc_id", "n_runs", F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
