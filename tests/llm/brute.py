"""Plain Python versions of the operators, for small inputs."""

import re
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def jump(key, shards):
    b, j, key = -1, 0, key % 2**64
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def repeated_words(text, window=8):
    ws = words(text)
    grams = [tuple(ws[i : i + window]) for i in range(len(ws) - window + 1)]
    many = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(window)})


def duplicate_lines(text):
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(lines) - len(set(lines))


def ids_of(texts, end=2):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc_of(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fitting:
            gaps[min(fitting)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def cut_lengths(total, capacity):
    count = -(-total // capacity)
    return [total - (count - 1) * capacity] + [capacity] * (count - 1)


def shingles(text, size):
    ws = words((text or "").translate(LOWER))
    return frozenset(tuple(ws[i : i + size]) for i in range(max(len(ws) - size + 1, 1))) if ws else frozenset()


def near_groups(rows, size, percent=80):
    """{position: smallest id of its component} for rows (id, text)."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids[top(i)] = min(ids.get(top(i), k), k)
    return [ids[top(i)] for i in range(len(rows))]


def item_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def contained_pairs(docs, items, size=5, least=0.8):
    def grams(ws, n):
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    out = set()
    held = [(k, item_words(t)) for k, t in docs]
    for item, text in items:
        ws = item_words(text)
        n = min(len(ws), size)
        wanted = grams(ws, n) if n else set()
        out |= {(k, item) for k, d in held if wanted and len(grams(d, n) & wanted) >= least * len(wanted) - 1e-9}
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def keeps_quality(text, stop_words):
    t = text or ""
    ws, lines = words(t), [x for x in t.split("\n") if words(x)]
    n, many = max(len(ws), 1), max(len(lines), 1)
    if len(ws) < 20 or 100 * repeated_words(t) > 30 * len(ws):
        return False
    if not 2 <= sum(map(len, ws)) / n <= 20 or sum(c in "#*$%&|<>" for c in t) / n > 0.3:
        return False
    if sum(any(c.isalpha() for c in w) for w in ws) / n < 0.5 or (len(ws) >= 50 and not any(w.lower() in stop_words for w in ws)):
        return False
    cut = sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*$", x)) for x in lines) / many
    bullets = sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines) / many
    return len(lines) < 4 or (duplicate_lines(t) / many <= 0.5 and cut <= 0.3 and bullets <= 0.9)
