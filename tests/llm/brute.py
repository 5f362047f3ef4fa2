"""Plain Python versions of the operators, and rows that are awkward for all of them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns of the awkward rows: those of documents, and some whose names the operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string, size long, mix_size string, sha string, bucket string, key long, low long, tid long, lang_pred string, n long"


def awkward_rows(seed: int = 5, many: int = 60) -> list[tuple]:
    """Null, empty, blank, repeated, near-equal, very long and odd texts, null ids, languages and sources."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeorstu") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    french = ["".join(rnd.choice("éèaiouxlmqu") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    prose = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    rows, at = [], 0

    def add(text, lang="en", source="a", number="next"):
        nonlocal at
        rows.append((at if number == "next" else number, text, lang, source, None, "x", 1, "y", "z", "b", 7, 8, 9, "p", 3))
        at += 1

    for k in range(many):
        add(prose(vocabulary, rnd.randint(12, 120)), "en", rnd.choice("abc"))
        add(prose(french, rnd.randint(12, 120)), "fr", rnd.choice(["b", "é", None]))
    base = prose(vocabulary, 150)
    for k in range(12):
        words = base.split()
        words[10 * k] = f"changed{k}"
        add(" ".join(words), "en", "c")
    for _ in range(3):
        add(base, "en", "a")
    passage = prose(vocabulary, 70)
    for k in range(4):
        add(prose(french, 20 + k) + "\n" + passage + "\n" + prose(french, 10), "fr", "b")
    add("same line here\n" * 30 + "end", None, None)
    add("aaaaaaaaaa" * 90, "en", "a")
    add(None)
    add("")
    add("  \t\n ")
    add("123 456 !!", "en", "d")
    add("one two")
    add("One TWO", "fr")
    add("É é \x85 nb\xa0sp <|endoftext|> don't ½ 𝔘 각", "fr", "𝔘")
    add(prose(vocabulary, 30_000), "en", "a")
    add(base, "en", "a", None)
    add(None, None, None, None)
    add(rows[0][1], "en", rows[0][3], 0)  # a repeated row
    add("another text under an id that is taken already by row one", "en", "a", 1)
    add("negative id of a short text", "en", "a", -3)
    return rows


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def near_sets(texts: list[str | None], n: int) -> list[frozenset]:
    found = []
    for text in texts:
        words = [w.encode().lower() for w in words_of(text)]
        found.append(frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset())
    return found


def near_components(rows: list[tuple[int | None, str | None]], n: int, percent: int) -> list[tuple]:
    """(id, set size, component, kept) of each row."""
    sets = near_sets([t for _, t in rows], n)
    members = defaultdict(list)
    for (number, _), s in zip(rows, sets, strict=True):
        members[s].append(number)
    keys = [s for s in members if s]
    up = list(range(len(keys)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(keys):
        common = Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(k)
        for j, m in common.items():
            if 100 * m >= percent * (len(s) + len(keys[j]) - m):
                up[top(k)] = top(j)
    least = {}
    for k, s in enumerate(keys):
        known = [x for x in members[s] if x is not None]
        least[top(k)] = min([*known, *([least[top(k)]] if least.get(top(k)) is not None else [])], default=None)
    label = {s: least[top(k)] for k, s in enumerate(keys)}
    out = []
    for (number, _), s in zip(rows, sets, strict=True):
        component = label.get(s) if s else number
        component = number if component is None else component
        out.append((number, len(s), component, number is not None and number == component))
    return out


def substring_removal(texts: list[str | None], span: int) -> list[tuple]:
    """(bytes, removed, spans, digest of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    starts = Counter(b[p : p + span] for b in data for p in range(len(b) - span + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if starts[b[p : p + span]] > 1:
                gone[p : p + span] = b"\x01" * span
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def targets(sizes: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Words to take of each source, resharing the excess until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        per = left / sum(weight[s] for s in free)
        full = [s for s in free if per * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: per * weight[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def backoff_scores(texts: list[str | None]) -> list[float]:
    words = [(t or "").encode().split() for t in texts]
    one, two = Counter(w for d in words for w in d), Counter(b for d in words for b in zip(d, d[1:], strict=False))
    total, out = sum(one.values()), []
    for d in words:
        own, pairs, score = Counter(d), Counter(zip(d, d[1:], strict=False)), 0.0
        for k, w in enumerate(d):
            s = math.log(max(one[w] - own[w], 0.5) / max(total - len(d), 1))
            if k:
                b = (d[k - 1], w)
                c = two[b] - pairs[b]
                s = math.log(c / (one[b[0]] - own[b[0]])) if c > 0 else s + math.log(0.4)
            score += s
        out.append(score)
    return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
