"""Token ids of whole batches of texts by the tokenizers library.

Byte-level vocabularies split a text before every blank that follows a non-blank, and between a letter and a mark,
whatever stands around them. So a batch is cut there, each distinct piece is encoded once, and the ids are gathered. Other vocabularies are encoded
text by text, and so are texts that spell an added token, such as `<|endoftext|>`, which a plain call gives as that
token's id. With `ordinary` they are read as any other text: a document cannot write an end into a sequence then.
"""

import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from codelake.llm.textkernel import blocks, ranges, span_hashes, utf8

# UTF-8 endings of blanks beyond ASCII: a cut after one of them is left out, which is always allowed.
WIDE_BLANK_ENDS = np.isin(np.arange(256), [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
WIDE_BLANK_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
LATIN_LETTER = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])  # after a byte 0xC3
ASCII_MARK = np.isin(np.arange(256), [b for b in b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"])  # not the apostrophe
TOGETHER = 512 << 10  # bytes of text whose pieces are looked up together
LONG = 200  # bytes of a piece that is encoded by the tokenizer's own call

_encoders: dict[tuple[str, int, bool], "Encoder"] = {}


def encoder(path: str, remembered: int = 300_000, ordinary: bool = False) -> "Encoder":
    """One encoder per Python worker; it remembers at most so many distinct pieces, and of a full table the half met last."""
    key = (path, remembered, ordinary)
    if key not in _encoders:
        _encoders[key] = Encoder(path, remembered, ordinary)
    return _encoders[key]


class Encoder:
    def __init__(self, path: str, remembered: int, ordinary: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t for t in spec.get("added_tokens") or [] if t["content"] and not (ordinary and t.get("special"))]
        self.added = "|".join(sorted(re.escape(t["content"]) for t in added))
        pre = spec.get("pre_tokenizer") or {}
        self.split = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec.get("normalizer") is None and spec["model"]["type"] == "BPE"
        )
        self.remembered = remembered
        self._forget()
        if self.split:
            shown = {}
            for c in map(chr, range(1, 0x800)):
                shown.update(zip(c.encode(), self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0], strict=True))
            self.shown = {b: shown.get(b, chr(b)) for b in range(256)}

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # in order; beside them where a piece's ids begin, their number, and when it was last met
        self.begin, self.size, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.flat, self.turn = np.zeros(0, np.uint32), 0

    def _keep_latest(self, number: int) -> None:
        """Forget the pieces met longest ago, all but at most so many, and none of those met in this turn."""
        limit = np.partition(self.met, -number)[-number] if 0 < number < len(self.met) else self.turn
        kept = (self.met > limit) | (self.met == self.turn)
        self.flat = self.flat[ranges(self.begin[kept], self.size[kept])]
        self.keys, self.size, self.met = self.keys[kept], self.size[kept], self.met[kept]
        self.begin = np.cumsum(self.size) - self.size

    def _ids(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        if len(raw) > LONG:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if text[text[0] == " " :].isalpha():  # the common case needs no splitting
            return [t.id for t in self.tokenizer.model.tokenize(raw.decode("latin-1").translate(self.shown))]
        out: list[int] = []
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            out += [t.id for t in self.tokenizer.model.tokenize(piece)]
        return out

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode the pieces data[start:end] and remember them."""
        width = ends - starts
        text = data[ranges(starts, width)]
        stop = np.cumsum(width)
        other = ~ASCII_LETTER[text]
        other[stop - width] &= text[stop - width] != 32
        plain = ~np.logical_or.reduceat(other, stop - width) & (width <= LONG)
        # Letters after a blank at most, the common case, need no splitting; a byte is shown as one character.
        raw = text.tobytes()
        shown, tokenize = raw.decode("latin-1").replace(" ", self.shown[32]), self.tokenizer.model.tokenize
        spans = zip((stop - width).tolist(), stop.tolist(), plain.tolist(), strict=True)
        new = [[t.id for t in tokenize(shown[a:b])] if easy else self._ids(raw[a:b]) for a, b, easy in spans]
        size = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(new), np.uint32, int(size.sum()))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        begin = len(self.flat) + np.cumsum(size) - size
        self.keys, self.begin = np.insert(self.keys, at, keys[order]), np.insert(self.begin, at, begin[order])
        self.size, self.met = np.insert(self.size, at, size[order]), np.insert(self.met, at, self.turn)
        self.flat = np.concatenate([self.flat, flat])

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        before, here = data[:-1], data[1:]
        after_letter = ASCII_LETTER[before]
        after_letter[1:] |= (data[:-2] == 0xC3) & LATIN_LETTER[before[1:]]
        at = np.flatnonzero(((here == 32) | (here == 10)) & (before > 32) | after_letter & ASCII_MARK[here]) + 1
        p = data[at - 1]
        wide = (p >= 0x80) & WIDE_BLANK_ENDS[p]
        wide &= WIDE_BLANK_LEADS[data[np.maximum(at - 2, 0)]] | WIDE_BLANK_LEADS[data[np.maximum(at - 3, 0)]]
        mark = np.zeros(len(data), bool)
        mark[at[~wide]] = True
        mark[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(mark)

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        back, keys = pd.factorize(span_hashes(data, starts, ends))
        self.turn += 1
        slot = np.searchsorted(self.keys, keys)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == keys[known]
        self.met[slot[known]] = self.turn
        if not known.all():
            missing = np.flatnonzero(~known)
            if len(self.keys) + len(missing) > self.remembered:
                self._keep_latest(self.remembered // 2)
            first = np.zeros(len(keys), np.int64)
            first[back[::-1]] = np.arange(len(back))[::-1]
            self._learn(keys[missing], data, starts[first[missing]], ends[first[missing]])
            slot = np.searchsorted(self.keys, keys)
        slot = slot[back]
        size = self.size[slot]
        ids = self.flat[ranges(self.begin[slot], size)]
        upto = np.concatenate(([0], np.cumsum(size)))
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def encode(self, column: pa.Array) -> "tuple[np.ndarray, np.ndarray]":
        """All ids of the column one after another (uint32), and the number of ids per row; a null is empty."""
        if not self.split:
            found = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes
        if self.added and (spelled := np.flatnonzero(pc.match_substring_regex(column, self.added).fill_null(False).to_numpy(False))).size:
            return self._mixed(column, spelled)
        data, offsets = utf8(column)
        done = [
            self._block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in blocks(offsets, TOGETHER)
        ]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _mixed(self, column: pa.Array, spelled: np.ndarray) -> "tuple[np.ndarray, np.ndarray]":
        """As `encode`, where the rows `spelled` hold an added token: those are encoded by one call each."""
        whole = np.zeros(len(column), bool)
        whole[spelled] = True
        ids, sizes = self.encode(pc.if_else(pa.array(whole), pa.scalar("", column.type), column))
        own = [self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids for i in spelled.tolist()]
        size = sizes.copy()
        size[spelled] = [len(x) for x in own]
        out = np.zeros(int(size.sum()), np.uint32)
        at = np.cumsum(size) - size
        out[ranges(at[~whole], size[~whole])] = ids
        for i, x in zip(spelled.tolist(), own, strict=True):
            out[at[i] : at[i] + len(x)] = x
        return out, size


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after every row."""
    out = np.full(len(ids) + len(sizes), end, np.uint32)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    out[ranges(starts, sizes)] = ids
    return out, sizes + 1
