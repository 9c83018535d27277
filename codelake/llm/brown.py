"""Scores of documents under a Brown class-based bigram model.

p(word | word before) = p(class | class before) * p(word | class). Classes come from exchange clustering, which moves
types to the class that raises the likelihood of the class bigrams most. Types are the words that make up at least
1/`common` of the training tokens (so there are at most `common` of them, whatever the corpus) and occur `least` times,
and the endings of all other words. Words of at least 1/`lexicon` of the tokens (at most `lexicon`) and endings are
clustered first, one after another, by the driver; every other type starts in the class of its ending. Then Spark moves all
types, a part of them in each round: the tokens, written once as numbers of types, give each type's counts with the classes
beside it, and each type goes to its best class. A round that does not raise the likelihood is taken back; smaller parts
follow.

All other words that occur `least` times then move from the class of their ending to their own best one. They are a table:
their counts are added up by word, and the texts' words are joined with it. None of them has more than 1/`common` of the
tokens, so no key of these shuffles is hot. What their moves change in the class bigrams and in a text's score is worked
out from the moved words and the classes beside them. Driver and tasks hold the types and the matrix of classes, both
bounded by parameters; the table of words grows with the corpus.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.scratch import stored
from codelake.llm.textkernel import BLOCK, blocks, lower_words, mixed, parts, ranges, span_hashes, utf8

ENDINGS = 512
CLASSES = 64
SWEEPS = 12
SPREAD = 20_000  # counts that are tried in all classes together
PULL = 1.0  # pseudo-counts by which a transition leans on the share of its class
END_WORD = np.int64(zlib.crc32(b"end of a text"))  # stands for the end among the hashes of words
FOLDS, HELD_OUT = 5, 1
COUNTED = 4 * BLOCK  # bytes of text counted together before Spark adds up
GATHERED = 1 << 21  # tokens counted together
COUNTS = "key bigint, home int, counts array<bigint>"
MARK = np.isin(np.arange(256), list(b"!\"'(),-.:;?")).astype(np.int64)


@dataclass(frozen=True)
class Types:
    """Words by ascending hash with counts and endings. Type 0 is the end, then come the words, then the endings."""

    hashes: np.ndarray
    counts: np.ndarray
    endings: np.ndarray
    tokens: int  # of all words, and ends

    def __len__(self) -> int:
        return 1 + len(self.hashes) + ENDINGS

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return 1 + endings
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, 1 + at, 1 + len(self.hashes) + endings)


def hashed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch, hash and ending of each of their words, and the index of each row's first word."""
    data, offsets = utf8(batch.column("text"))
    for lo, hi in blocks(offsets):
        low, starts, ends, first = lower_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        last = ends - 1 - MARK[low[ends - 1]]  # a mark after the word says little about it
        tail = np.where(last >= starts, low[np.maximum(last, 0)], 0).astype(np.uint64) * np.uint64(256)
        tail += np.where(last > starts, low[np.maximum(last - 1, 0)], 0).astype(np.uint64)
        words = span_hashes(low, starts, ends).view(np.int64) if len(starts) else np.zeros(0, np.int64)
        yield batch.slice(lo, hi - lo), words, (mixed(tail) % np.uint64(ENDINGS)).astype(np.int64), first


def with_ends(values: np.ndarray, first: np.ndarray, end) -> np.ndarray:
    """The words of every row followed by its end."""
    n = np.diff(first)
    out = np.full(len(values) + len(n), end, values.dtype)
    out[ranges(first[:-1] + np.arange(len(n)), n)] = values
    return out


def word_counts(train: DataFrame) -> DataFrame:
    """(word, ending, n) of all words and of the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, COUNTED):
            found = [(with_ends(w, f, END_WORD), with_ends(e, f, 0)) for _, w, e, f in hashed(batch)]
            if not found:
                continue
            words, endings = (np.concatenate(x) for x in zip(*found, strict=True))
            code, keys = pd.factorize(words)
            of = np.zeros(len(keys), np.int64)
            of[code] = endings
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(of.astype(np.int32)), pa.array(np.bincount(code))], names=["word", "ending", "n"]
            )

    counted = train.select("text").mapInArrow(count, "word bigint, ending int, n bigint")
    return counted.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def numbered(rows: DataFrame, types: Types) -> DataFrame:
    """(row, doc_id, held_out, tokens, others): types of each text's words and its end, hashes of the words that are no type."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, endings, first in hashed(batch):
                kinds = types.of(words, endings)
                other = kinds > len(types.hashes)
                held = np.append(0, np.cumsum(other))[first]
                columns = [
                    *(part.column(c) for c in ("row", "doc_id", "held_out")),
                    as_lists(first + np.arange(len(first)), with_ends(kinds, first, 0).astype(np.int32)),
                    as_lists(held, words[other]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "tokens", "others"])

    return rows.mapInArrow(number, "row bigint, doc_id bigint, held_out boolean, tokens array<int>, others array<bigint>")


def as_lists(at: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def sizes(column: pa.ListArray) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def gathered(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[np.ndarray]]:
    """The lists of some texts in columns `names`, one text after the other; the first column bounds how many."""
    held, n = [[] for _ in names], 0
    for batch in batches:
        for of, c in zip(held, names, strict=True):
            of.append(batch.column(c).flatten().to_numpy())
        n += len(held[0][-1])
        if n >= GATHERED:
            yield [np.concatenate(x) for x in held]
            held, n = [[] for _ in names], 0
    if n:
        yield [np.concatenate(x) for x in held]


def bigrams(tokens: DataFrame, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n): how often group b follows group a, at most one row for each two; `of` gives the group of each type."""
    size = int(of.max()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (seq,) in gathered(batches, "tokens"):
            seq = of[seq].astype(np.int64)
            code, keys = pd.factorize(np.append(0, seq[:-1]) * size + seq)  # texts begin after an end
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(code))], names=["pair", "n"])

    found = tokens.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    found = found.toPandas().sort_values("pair")
    pair, n = (found[c].to_numpy(np.int64) for c in ("pair", "n"))
    return pair // size, pair % size, n


def counted(of: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, pa.ListArray]:
    """Each value of `of` once, and for it the list of code + codes * (how often it has that code)."""
    keys, n = np.unique(of * codes + code, return_counts=True)
    of = keys // codes
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return of[at], as_lists(np.append(at, len(of)), keys % codes + codes * n)


def summed(found: DataFrame, codes: int, least: int = 0) -> DataFrame:
    """(key, home, counts of struct (code, n)) from the lists of `counted`, for keys with `least` tokens or more."""
    # Packed as lists for the shuffle; all that follows is done where a key's rows are.
    found = found.repartition("key").select("key", "home", F.explode("counts").alias("x"))
    found = found.groupBy("key", (F.col("x") % codes).cast("int").alias("code")).agg(
        F.max("home").alias("home"), F.sum(F.expr(f"x div {codes}")).alias("n")
    )
    tokens = F.when((F.col("code") < codes // 2) | (F.col("code") == codes - 1), F.col("n"))  # one code before each
    found = found.groupBy("key").agg(
        F.max("home").alias("home"), F.collect_list(F.struct("code", "n")).alias("counts"), F.sum(tokens).alias("tokens")
    )
    return (found.filter(F.col("tokens") >= least) if least else found).drop("tokens")


def beside(tokens: DataFrame, cls: np.ndarray, part: int, parts: int, classes: int) -> DataFrame:
    """(key, home, counts) for one part of the types, key and home: code c counts class c before it, classes + 1 + c class c
    after it, and 2 * (classes + 1) the type itself after it, which the others leave out."""
    span = classes + 1
    codes = 2 * span + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (seq,) in gathered(batches, "tokens"):
            b = seq.astype(np.int64)
            a = np.append(0, b[:-1])
            same, asks = a == b, (b > 0) & (b % parts == part)
            before = np.where(same, 2 * span, cls[a])[asks]
            follows = (a > 0) & (a % parts == part) & ~same
            key, lists = counted(np.append(b[asks], a[follows]), np.append(before, (span + cls[b])[follows]), codes)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key.astype(np.int32)), lists], names=["key", "home", "counts"])

    return summed(tokens.mapInArrow(count, COUNTS), codes)


def beside_others(numbers: DataFrame, cls: np.ndarray, last: int, least: int, classes: int) -> DataFrame:
    """What `beside` gives, for the words that are no type (types above `last`): key is the word's hash, home its ending's type."""
    span = classes + 1
    codes = 2 * span + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, words in gathered(batches, "tokens", "others"):
            at = np.flatnonzero(seq > last)
            if not len(at):
                continue
            code, keys = pd.factorize(words)
            home = np.zeros(len(keys), np.int32)
            home[code] = seq[at]
            again = (np.diff(at) == 1) & (code[1:] == code[:-1])
            same, leads = np.append(False, again), ~np.append(again, False)
            before = np.where(same, 2 * span, cls[np.append(0, seq[:-1])[at]])
            after = span + cls[seq[at[leads] + 1]]  # a text's last token is its end
            key, lists = counted(np.append(code, code[leads]), np.append(before, after), codes)
            yield pa.RecordBatch.from_arrays([pa.array(keys[key]), pa.array(home[key]), lists], names=["key", "home", "counts"])

    return summed(numbers.select("tokens", "others").mapInArrow(count, COUNTS), codes, least)


def moves(counts: DataFrame, cls: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(key, best) for the keys of `beside` whose best class is another than that of their home."""
    span = len(matrix)
    codes = 2 * span + 1

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("counts")
            at = np.append(0, np.cumsum(sizes(lists)))
            flat = lists.flatten()
            code, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("code", "n"))
            keys, homes = batch.column("key").to_numpy(), batch.column("home").to_numpy()
            for lo, hi in blocks(at, SPREAD):
                row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                part = slice(at[lo], at[hi])
                order = np.argsort(row * codes + code[part], kind="stable")  # sums are the same whatever the order
                own = cls[homes[lo:hi]].astype(np.int64)
                best, gain = best_classes(keys[lo:hi], own, row[order], code[part][order], n[part][order].astype(float), matrix)
                goes = (best != own) & (gain > 1e-6)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo:hi][goes]), pa.array(best[goes].astype(np.int32))], names=["key", "best"]
                )

    return counts.mapInArrow(move, "key bigint, best int")


def occurrences(numbers: DataFrame, cls: np.ndarray, last: int, span: int) -> DataFrame:
    """(row, held_out, word, around) for each word that is no type; `around` packs its place in the text, the class of its
    ending, and the classes before and after it, each of `span` values."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sizes(batch.column("tokens"))
            seq = batch.column("tokens").flatten().to_numpy()
            at = np.flatnonzero(seq > last)
            of = np.repeat(np.arange(len(n)), n)[at]
            place = at - (np.cumsum(n) - n)[of]
            c = cls[seq].astype(np.int64)
            around = ((place * span + c[at]) * span + np.append(0, c[:-1])[at]) * span + c[at + 1]
            rows, held = (batch.column(x).to_numpy(zero_copy_only=False)[of] for x in ("row", "held_out"))
            words = batch.column("others").flatten()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(held.astype(bool)), words, pa.array(around)], names=["row", "held_out", "word", "around"]
            )

    return numbers.mapInArrow(find, "row bigint, held_out boolean, word bigint, around bigint")


def shifts(moved: pa.ListArray, span: int) -> tuple[np.ndarray, ...]:
    """What the moved words of some texts change: (text, class pair before, class pair after) for bigrams, and
    (text, class before, class after) for the words. `moved` holds span * around + the new class."""
    n = sizes(moved)
    of, x = np.repeat(np.arange(len(n)), n), moved.flatten().to_numpy()
    order = np.lexsort((x, of))
    of, x = of[order], x[order]
    best, after, before, home = x % span, x // span % span, x // span**2 % span, x // span**3 % span
    place = x // span**4
    joined = (of[1:] == of[:-1]) & (place[1:] == place[:-1] + 1)  # both words of the bigram are moved
    leads = np.ones(len(of), bool)
    leads[:-1] = ~joined
    now = before.copy()
    now[1:][joined] = best[:-1][joined]
    old = np.append(before * span + home, (home * span + after)[leads])
    new = np.append(now * span + best, (best * span + after)[leads])
    return np.append(of, of[leads]), old, new, of, home, best


def shifted_matrix(met: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """The bigrams of classes once the words have moved."""
    span = len(matrix)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(span * span, np.int64)
        for batch in batches:
            _, old, new, *_ = shifts(batch.column("moved"), span)
            total += np.bincount(new, minlength=span * span) - np.bincount(old, minlength=span * span)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    found = met.filter("NOT held_out").select("moved").mapInArrow(change, "pair bigint, n bigint")
    out = matrix.copy()
    for r in found.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most span * span rows
        out[r["pair"] // span, r["pair"] % span] += r["n"]
    return out


def likelihood(matrix: np.ndarray) -> float:
    return float(xlogx(matrix).sum() - xlogx(matrix.sum(axis=0)).sum() - xlogx(matrix.sum(axis=1)).sum())


def class_matrix(tokens: DataFrame, cls: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((classes + 1, classes + 1))
    a, b, n = bigrams(tokens, cls)
    out[a, b] = n
    return out


def clustered(
    tokens: DataFrame, types: Types, classes: int, lexicon: int, rounds: int, most_parts: int, still: float
) -> tuple[np.ndarray, np.ndarray, float]:
    """The class of each type, the bigrams of classes, and by how much a token the last round raised the likelihood."""
    n_words = len(types.hashes)
    heads = np.flatnonzero(types.counts * lexicon >= types.tokens)
    of = np.concatenate([[0], 1 + len(heads) + types.endings, 1 + len(heads) + np.arange(ENDINGS)]).astype(np.int32)
    of[1 + heads] = 1 + np.arange(len(heads))
    a, b, n = bigrams(tokens, of)
    cls = exchange(a, b, n, 1 + len(heads) + ENDINGS, classes)[of].astype(np.int16)
    matrix = class_matrix(tokens, cls, classes)
    held, parts, rise = likelihood(matrix), 2, 0.0
    for k in range(rounds if n_words else 0):
        found = moves(beside(tokens, cls, k % parts, parts, classes), cls, matrix).toPandas()  # at most one row a type
        after = cls.copy()
        after[found["key"].to_numpy(np.int64)] = found["best"].to_numpy(np.int16)
        made = class_matrix(tokens, after, classes)
        rise = likelihood(made) - held
        if rise > 0:
            cls, matrix, held = after, made, held + rise
        else:
            parts *= 2
        if 0 < rise < still * matrix.sum() or parts > most_parts:
            break
    return cls, matrix, rise / max(matrix.sum(), 1.0)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_class(own: int, left: np.ndarray, right: np.ndarray, itself: float, matrix: np.ndarray) -> tuple[int, float]:
    """The class in which a type raises the likelihood most, and by how much over where it is.

    `left[c]` and `right[c]` count its bigrams after and before class c, `itself` those with itself.
    """
    into, out = left.copy(), right.copy()
    into[own] -= itself
    out[own] -= itself
    m = matrix.copy()
    m[own, :] -= out
    m[:, own] -= into
    m[own, own] -= itself
    rows, columns = m.sum(axis=1) + into, m.sum(axis=0) + out  # the same wherever the type goes
    k = np.arange(len(m))
    gain = (xlogx(m + out) - xlogx(m)).sum(axis=1) + (xlogx(m + into[:, None]) - xlogx(m)).sum(axis=0)
    diagonal = m[k, k]
    gain -= xlogx(diagonal + out) + xlogx(diagonal + into) - xlogx(diagonal)
    gain += xlogx(diagonal + out + into + itself)
    gain -= xlogx(rows + out.sum() + itself) - xlogx(rows) + xlogx(columns + into.sum() + itself) - xlogx(columns)
    gain[0] = -np.inf  # the end keeps its class to itself
    best = int(gain.argmax())
    return best, float(gain[best] - gain[own])


def best_classes(
    types: np.ndarray, own: np.ndarray, row: np.ndarray, code: np.ndarray, n: np.ndarray, matrix: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """What best_class gives for many types, each on its own; `row` ascends and tells whose count (code, n) is.

    Classes that are equally good, as empty ones are, are shared out, so that types moved together don't all take one.
    """
    span, many = len(matrix), len(own)
    each = np.arange(many)
    into, out, itself = np.zeros((many, span)), np.zeros((many, span)), np.zeros(many)
    lead, follow, same = code < span, (code >= span) & (code < 2 * span), code == 2 * span
    into[row[lead], code[lead]] = n[lead]
    out[row[follow], code[follow] - span] = n[follow]
    itself[row[same]] = n[same]

    gain = np.zeros((many, span))
    for of, c, x, m, other in (
        (row[follow], code[follow] - span, n[follow], matrix.T, into),
        (row[lead], code[lead], n[lead], matrix, out),
    ):
        if not len(of):
            continue
        cells = m[c]  # for each count, its cell in every class the type may go to, without what the type has there now
        mine = c == own[of]
        cells[mine] -= other[of[mine]]
        cells[np.arange(len(of)), own[of]] -= x + np.where(mine, itself[of], 0)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        gain[of[starts]] += np.add.reduceat(xlogx(cells + x[:, None]) - xlogx(cells), starts, axis=0)
    diagonal = np.repeat(np.diag(matrix)[None, :], many, axis=0)
    diagonal[each, own] -= into[each, own] + out[each, own] + itself
    gain += xlogx(diagonal + out + into + itself[:, None]) - xlogx(diagonal + out) - xlogx(diagonal + into) + xlogx(diagonal)
    for sums, more in ((matrix.sum(axis=1), out), (matrix.sum(axis=0), into)):
        whole = more.sum(axis=1) + itself
        rest = np.repeat(sums[None, :], many, axis=0)
        rest[each, own] -= whole
        gain -= xlogx(rest + whole[:, None]) - xlogx(rest)
    gain[:, 0] = -np.inf
    tied = gain >= gain.max(axis=1, keepdims=True) - 1e-7
    pick = mixed(types.astype(np.uint64)) % tied.sum(axis=1).astype(np.uint64)
    best = (tied.cumsum(axis=1) > pick.astype(np.int64)[:, None]).argmax(axis=1)
    return best, gain[each, best] - gain[each, own]


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, types: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each type from its bigrams (a, b, n). Class 0 is the end's; the others start evenly filled.

    A sweep visits the types from the most frequent on and moves each to its best class at once; what a move changes in
    the counts of its neighbours is carried along. Sweeps end early if next to nothing moves.
    """
    cls = np.append(0, 1 + np.random.Generator(np.random.PCG64(11)).permutation(types - 1) % classes)
    left, right = np.zeros((types, classes + 1)), np.zeros((types, classes + 1))
    np.add.at(left, (b, cls[a]), n)
    np.add.at(right, (a, cls[b]), n)
    itself = np.bincount(a[a == b], n[a == b], types).astype(float)
    matrix = class_bigrams(a, b, n, cls, classes)
    after, before = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    after_at, before_at = (np.searchsorted(x, np.arange(types + 1)) for x in (a[after], b[before]))
    weight = left.sum(axis=1)
    order = [t for t in np.argsort(-weight, kind="stable").tolist() if t and weight[t]]
    for _ in range(sweeps):
        moved = 0
        for t in order:
            own = int(cls[t])
            best, gain = best_class(own, left[t], right[t], itself[t], matrix)
            if best == own or gain <= 1e-6:
                continue
            into, out = left[t].copy(), right[t].copy()
            into[own] -= itself[t]
            out[own] -= itself[t]
            for c, sign in ((own, -1), (best, 1)):
                matrix[c, :] += sign * out
                matrix[:, c] += sign * into
                matrix[c, c] += sign * itself[t]
                follow, lead = after[after_at[t] : after_at[t + 1]], before[before_at[t] : before_at[t + 1]]
                left[b[follow], c] += sign * n[follow]
                right[a[lead], c] += sign * n[lead]
            cls[t] = best
            moved += 1
        if moved <= len(order) // 100:
            break
    return cls


def class_bigrams(a: np.ndarray, b: np.ndarray, n: np.ndarray, cls: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((classes + 1, classes + 1))
    np.add.at(out, (cls[a], cls[b]), n)
    return out


@dataclass(frozen=True)
class Model:
    """`others` (word, ending, n, best) are the words that are no type; `best` is null where the ending's class stays.
    `met` (row, held_out, rare, n_rare, moved) is what the texts hold of them."""

    types: Types
    cls: np.ndarray
    matrix: np.ndarray
    others: DataFrame
    met: DataFrame
    rise: float
    tokens: int
    words: int


def fit(
    rows: DataFrame, classes: int, lexicon: int, common: int, least: int, rounds: int, most_parts: int, still: float
) -> tuple[Model, DataFrame]:
    """The model of the rows (row, doc_id, held_out, text) that are not held out, and all rows as `numbered`."""
    words = stored(word_counts(rows.filter(~F.col("held_out"))), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_words = total["n"], total["v"]
    bound = max(least, -(-n_all // common))
    words = words.filter(F.col("word") != int(END_WORD))
    frequent = words.filter(F.col("n") >= bound).toPandas().sort_values("word")  # at most `common` rows
    types = Types(frequent["word"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64), frequent["ending"].to_numpy(np.int64), n_all)
    last, span = len(types.hashes), classes + 1
    numbers = stored(numbered(rows, types), "numbered")
    train = numbers.filter(~F.col("held_out"))
    cls, matrix, rise = clustered(train.select("tokens"), types, classes, lexicon, rounds, most_parts, still)

    moved = stored(moves(beside_others(train, cls, last, least, classes), cls, matrix), "moved")
    others = words.filter(F.col("n") < bound).join(moved.withColumnRenamed("key", "word"), "word", "left")
    asked = occurrences(numbers, cls, last, span).join(others.select("word", "n", "best"), "word", "left")
    met = asked.groupBy("row", "held_out").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare"), F.count("n").alias("n_rare"),
        F.collect_list(F.col("around") * span + F.col("best")).alias("moved"),
    )
    met = stored(met, "met")
    after = shifted_matrix(met, matrix)
    if likelihood(after) > likelihood(matrix):
        matrix = after
    else:  # taken back
        others = others.withColumn("best", F.lit(None).cast("int"))
        met = met.withColumn("moved", F.array().cast("array<bigint>"))
    return Model(types, cls, matrix, others, met, rise, n_all, n_words), numbers


def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES, lexicon: int = 4096,
    common: int = 1 << 20, least: int = 10, rounds: int = 12, most_parts: int = 16, still: float = 0.005,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, last_rise.

    What the clustering takes its time for is stated by parameters: words of at least 1/`lexicon` of the training tokens
    are clustered one after another before the others (more of them: slower, and the driver holds their bigrams); words of
    at least 1/`common` take part in all rounds of the exchange (more of them: a longer list of types in driver and tasks, 24
    bytes each), the others move once, after it; words of at least `least` training occurrences have a class of their own,
    rarer ones that of their ending; the exchange ends with a round that raises the likelihood by less than `still` a token, after
    `rounds` rounds, or once the types are dealt into more than `most_parts` parts. `last_rise` is what the last round
    raised the likelihood by a token (natural logarithm; not above 0 if it was taken back): a run that `rounds` has cut
    short shows a value above `still`.

    Tokens are the words, lower-cased from A to Z, and one end. A document is held out of the training if the CRC-32 of
    its id as text leaves 1 modulo 5; a null id counts as 0 and is trained on. `base_score` is the add-a-half unigram
    log10 probability and `score` that of the class model. Null and empty texts are an end alone. Repeated rows are
    counted and scored each. Other columns are ignored; an empty table gives no rows, and if nothing is left to train
    on, all counts are 0. A very long text is counted and scored whole, in one task.
    """
    fold = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % FOLDS
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"),
        (fold == HELD_OUT).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    model, numbers = fit(rows, classes, lexicon, common, least, rounds, most_parts, still)
    types, cls, matrix, last, span = model.types, model.cls, model.matrix, len(model.types.hashes), classes + 1
    share = (matrix.sum(axis=0) + 1) / (matrix.sum() + span)
    step = np.log10((matrix + PULL * share) / (matrix.sum(axis=1, keepdims=True) + PULL))

    # Tokens and distinct words per class.
    room = np.zeros((span, 2))
    np.add.at(room, cls[1 : 1 + last], np.stack([types.counts, np.ones(last)], axis=1))
    grouped = model.others.groupBy("ending", "best").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    for r in grouped.collect():  # at most ENDINGS * (span + 1) rows
        room[cls[1 + last + r["ending"]] if r["best"] is None else r["best"]] += (r["n"], r["v"])
    size = np.log10(room[:, 0] + 0.5 * (room[:, 1] + 1))

    ends = numbers.filter(~F.col("held_out")).count()
    known = np.log10(types.counts + 0.5)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, many = sizes(batch.column("tokens")), batch.num_rows
            t, of = batch.column("tokens").flatten().to_numpy(), np.repeat(np.arange(many), n)
            path = cls[t]
            steps = step[np.append(0, path[:-1]), path] - np.where(t > 0, size[path], 0)
            common = (t > 0) & (t <= last)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row", "doc_id", "held_out")), pa.array(n.astype(np.int64)),
                    pa.array(np.bincount(of[common], minlength=many) + (ends > 0)),
                    pa.array(np.bincount(of[common], known[t[common] - 1], many).astype(float)),
                    pa.array(np.bincount(of, steps, many).astype(float)),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_common", "common", "classes"],
            )

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = step.ravel()
        for batch in batches:
            of, old, new, word, home, best = shifts(batch.column("moved"), span)
            gain = np.bincount(of, flat[new] - flat[old], batch.num_rows)
            gain = gain - np.bincount(word, size[best] - size[home], batch.num_rows)
            columns = [*(batch.column(c) for c in ("row", "rare", "n_rare")), pa.array(gain.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "rare", "n_rare", "shift"])

    judged = numbers.drop("others").mapInArrow(
        judge, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_common bigint, common double, classes double"
    )
    met = model.met.mapInArrow(correct, "row bigint, rare double, n_rare bigint, shift double")
    log_end = float(np.log10(ends + 0.5))
    log_all = float(np.log10(model.tokens + 0.5 * (model.words + 1)))
    counts = F.coalesce("rare", F.lit(0.0)) + F.col("common") + log_end
    out = judged.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (counts - F.col("n_tokens") * log_all).alias("base_score"),
        (counts - log_end + F.col("classes") + F.coalesce("shift", F.lit(0.0))).alias("score"), F.lit(model.rise).alias("last_rise"),
    )
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.withColumn("perplexity", perplexity)
