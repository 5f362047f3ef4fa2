"""Personal data: fixed patterns first, then what a semi-Markov conditional random field adds to them.

The field labels segments of a text as an entity of a kind or as outside. Candidate segments are those that could be an
entity in some spelling (the same checks as the patterns, other separators and brackets, words for ``@`` and dots); each is
scored by features of the whole segment: its group sizes, separators, lead, neighbours and what a cut at its ends would tear
apart. Dynamic programming over their boundaries picks the best set, kinds and ends together; a segment is bounded by its
kind's digits or labels, so the work is linear in the text.

The field is fitted on a bounded sample: matches of the patterns, as they stand and written in other spellings, alone and
side by side, and near misses (a changed digit, dates, tables of numbers, host names after a plain "at").
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.session import cut

KINDS = ("email", "ip", "card", "phone")
#: Fixed values of the patterns: least and most digits of a card and of a phone number, largest part of an address.
CARD_DIGITS, PHONE_DIGITS, LARGEST_PART = (14, 19), (10, 15), 255

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[str, int, int]


# --- the patterns --------------------------------------------------------------------------------------------------
def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern. Going left from each ``@`` visits a character once, however long its run is."""
    at, last = text.find("@"), 0
    while at >= 0:
        if host := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = host.end()
                yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start, then kind.

    Quantifiers give nothing back and addresses start where a number starts, which matches the same as the plain patterns
    without their quadratic time on long runs.
    """
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= LARGEST_PART for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 2 * CARD_DIGITS[1] and CARD_DIGITS[0] <= len(d := _only_digits(m.group())) <= CARD_DIGITS[1] and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum(map(str.isdigit, m.group())) <= PHONE_DIGITS[1]:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- candidate segments and their features -------------------------------------------------------------------------
_DOT = r"(?:\x20?[\[({]\x20?(?:\.|dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
_AT = re.compile(r"\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20|\x20?@\x20?")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?"
_DOTTED = re.compile(rf"({_DOT})({_LABEL})(?![A-Za-z0-9])")
_FIRST = re.compile(rf"{_LABEL}(?![A-Za-z0-9])")
_PIECE = re.compile(r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}\Z")
_LEFT_DOT = re.compile(rf"(?:{_DOT})\Z")
_SEPARATOR = re.compile(rf"[\x20\xa0.()\[\]/_‐-―-]{{1,4}}|{_DOT}")
_IP_DOT = re.compile(_DOT + r"|\x20\.\x20?|\.\x20")
_CARD_GAP = re.compile(r"[\x20\xa0._/‐-―-]|\x20{2,3}|\x20-\x20")
_PHONE_GAP = re.compile(r"[\x20\xa0./‐-―-]|\)\x20?|\x20\(|\)-|\x20-\x20|\.\x20?\(|-\(")


class Candidate:
    """A segment that may be an entity: where it is, its kind, and the features of the whole of it."""

    __slots__ = ("start", "end", "kind", "features")

    def __init__(self, start: int, end: int, kind: str, features: list[str]):
        self.start, self.end, self.kind = start, end, kind
        self.features = [f"{kind}:{f}" for f in ["bias", *features]]


def _beside(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    return "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else c if c in "=_/@#:;,.-+\"'()[]" else "mark"


def _numbers(text: str) -> list[Candidate]:
    groups = [m.span() for m in _DIGITS.finditer(text)]
    gaps: list[str | None] = [None] * (len(groups) + 1)
    for k in range(1, len(groups)):
        if groups[k][0] - groups[k - 1][1] <= 7 and _SEPARATOR.fullmatch(gap := text[groups[k - 1][1] : groups[k][0]]):
            gaps[k] = gap
    found = []
    for a, (start, _) in enumerate(groups):
        if start and (text[start - 1].isalnum() or text[start - 1] in "=@"):
            continue
        digits, sizes, between, ip, card, phone = "", [], [], True, True, True
        for b in range(a, len(groups)):
            first, end = groups[b]
            if end - first > CARD_DIGITS[1] or len(digits) + end - first > CARD_DIGITS[1]:
                break
            if b > a:
                if (gap := gaps[b]) is None:
                    break
                between.append(gap)
                ip, card, phone = ip and bool(_IP_DOT.fullmatch(gap)), card and bool(_CARD_GAP.fullmatch(gap)), phone and bool(_PHONE_GAP.fullmatch(gap))
                if not (ip or card or phone):
                    break
            digits += text[first:end]
            sizes.append(end - first)
            if end < len(text) and (text[end].isalnum() or text[end] == "@"):
                break
            kinds = []
            if ip and len(sizes) == 4 and max(sizes) <= 3 and all(int(text[x:y]) <= LARGEST_PART for x, y in groups[a : b + 1]):
                kinds.append("ip")
            if card and CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                kinds.append("card")
            if phone and PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1]:
                kinds.append("phone")
            for kind in kinds:
                lead = start
                while kind == "phone" and lead and start - lead < 2 and text[lead - 1] in "+(":
                    lead -= 1
                inside = text[lead:end]
                joined = gaps[b + 1] if b + 1 < len(groups) else None
                shape = "-".join(map(str, sizes)) if len(sizes) < 8 else "many"
                found.append(Candidate(lead, end, kind, [
                    f"shape={shape}", f"gaps={'|'.join(sorted(set(between)))}", f"same={len(set(between)) <= 1}", f"lead={text[lead:start]}",
                    f"left={gaps[a] is not None}:{_beside(text, lead - 1)}", f"right={joined is not None}:{_beside(text, end)}",
                    f"closed={inside.count('(') == inside.count(')')}", f"groups={min(len(sizes), 6)}", f"lead={text[lead:start]}:shape={shape}",
                    f"largest={max(sizes)}",
                ]))
    return found


def _written_emails(text: str) -> list[Candidate]:
    found = []
    for at in _AT.finditer(text):
        # Up to five labels to the right and three pieces to the left: every pair of ends is a candidate.
        label = _FIRST.match(text, at.end())
        ends, marks = [], []
        end = label.end() if label else -1
        while label and len(ends) < 5 and (m := _DOTTED.match(text, end)):
            end = m.end()
            marks.append(m.group(1).strip() if m.group(1) != "." else "plain")
            ends.append((end, tuple(sorted(set(marks))), m.group(2)))
        starts, left = [], at.start()
        while ends and len(starts) < 3 and (m := _PIECE.search(text, max(0, left - 65), left)):
            left = m.start()
            starts.append(left)
            dot = _LEFT_DOT.search(text, max(0, left - 8), left)
            if not dot or dot.group() == ".":
                break
            left = dot.start()
        mark = at.group().strip() or "at"
        for p, start in enumerate(starts):
            for k, (end, dots, last) in enumerate(ends):
                local = text[start : at.start()]
                found.append(Candidate(start, end, "email", [
                    f"at={mark}:{at.group()[:1] == ' '}", f"dots={dots}", f"at={mark}:dots={dots}", f"last={last.isalpha()}:{min(len(last), 5)}",
                    f"more-left={p + 1 < len(starts)}", f"more-right={k + 1 < len(ends)}", f"left={_beside(text, start - 1)}",
                    f"right={_beside(text, end)}", f"local={any(c.isdigit() for c in local)}", f"labels={k + 2}",
                ]))
    return found


_SIGNAL = re.compile(r"[0-9]|@|\b(?:at|AT)\b.{1,70}(?:dot|DOT|\.[A-Za-z])")


def candidates(text: str, taken: list[Span]) -> list[Candidate]:
    """Candidate segments that meet no taken span, by start."""
    if not _SIGNAL.search(text):
        return []
    found = sorted([*_numbers(text), *_written_emails(text)], key=lambda c: (c.start, c.end, KINDS.index(c.kind)))
    # Taken spans of several kinds may overlap: their union is a list of intervals apart from each other.
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in taken):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    before = [bisect_left(starts, c.end) - 1 for c in found]
    return [c for c, k in zip(found, before, strict=True) if k < 0 or ends[k] <= c.start]


# --- the field -----------------------------------------------------------------------------------------------------
OUTSIDE = len(KINDS)


class Lattice:
    """Boundaries of the candidates of a text in order, and the candidates as edges between them.

    An edge ends behind the blanks after its segment, so that segments side by side meet in one boundary; an outside step
    leads from each boundary to the next.
    """

    def __init__(self, text: str, found: list[Candidate]):
        def behind(end: int) -> int:
            while end < len(text) and text[end] == " ":
                end += 1
            return end

        ends = [behind(c.end) for c in found]
        self.points = sorted({c.start for c in found} | set(ends))
        place = {p: k for k, p in enumerate(self.points)}
        self.edges = [(place[c.start], place[e], KINDS.index(c.kind), c) for c, e in zip(found, ends, strict=True)]


class SpanField:
    """Weights of segment features and of neighbouring labels; a segmentation scores the sum of what it holds."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, c: Candidate) -> float:
        return sum(self.weights.get(f, 0.0) for f in c.features)

    def joins(self) -> list[list[float]]:
        """Score of a label after another, outside included."""
        return [[self.weights.get(f"{a}>{b}", 0.0) for b in range(OUTSIDE)] for a in range(OUTSIDE + 1)]

    def best(self, text: str, found: list[Candidate]) -> list[Candidate]:
        """The candidates of the best segmentation; outside wins ties."""
        if not found:
            return []
        lattice, joins = Lattice(text, found), self.joins()
        n = len(lattice.points)
        leaving: list[list] = [[] for _ in range(n)]
        for edge in lattice.edges:
            leaving[edge[0]].append(edge)
        value = [[-math.inf] * (OUTSIDE + 1) for _ in range(n)]
        back: list[list] = [[None] * (OUTSIDE + 1) for _ in range(n)]
        value[0][OUTSIDE] = 0.0
        for t in range(n):
            label = max(range(OUTSIDE, -1, -1), key=lambda y: value[t][y])
            if t + 1 < n and value[t][label] > value[t + 1][OUTSIDE]:
                value[t + 1][OUTSIDE], back[t + 1][OUTSIDE] = value[t][label], (t, label, None)
            for _, to, kind, c in leaving[t]:
                own = self.score(c)
                for y in range(OUTSIDE + 1):
                    if (v := value[t][y] + joins[y][kind] + own) > value[to][kind]:
                        value[to][kind], back[to][kind] = v, (t, y, c)
        at, label = n - 1, max(range(OUTSIDE, -1, -1), key=lambda y: value[n - 1][y])
        chosen = []
        while back[at][label]:
            at, label, c = back[at][label]
            if c:
                chosen.append(c)
        return chosen[::-1]

    def gradient(self, lattice: Lattice, gold: set[Span]) -> dict[str, float]:
        """Observed less expected features of the log-likelihood, by sums forward and backward over the boundaries."""
        joins, n = self.joins(), len(lattice.points)
        edges = [(*e, self.score(e[3])) for e in sorted(lattice.edges, key=lambda e: e[0])]
        leaving: list[list] = [[] for _ in range(n)]
        for e in edges:
            leaving[e[0]].append(e)
        ahead = np.full((n, OUTSIDE + 1), -np.inf)
        ahead[0, OUTSIDE] = 0.0
        for t in range(n):
            if t + 1 < n:
                ahead[t + 1, OUTSIDE] = np.logaddexp.reduce([*ahead[t], ahead[t + 1, OUTSIDE]])
            for _, to, kind, _, own in leaving[t]:
                for y in range(OUTSIDE + 1):
                    ahead[to, kind] = np.logaddexp(ahead[to, kind], ahead[t, y] + joins[y][kind] + own)
        behind = np.full((n, OUTSIDE + 1), -np.inf)
        behind[n - 1] = 0.0
        for t in range(n - 2, -1, -1):
            for y in range(OUTSIDE + 1):
                ways = [behind[t + 1, OUTSIDE]] + [joins[y][kind] + own + behind[to, kind] for _, to, kind, _, own in leaving[t]]
                behind[t, y] = np.logaddexp.reduce(ways)
        total = np.logaddexp.reduce(ahead[n - 1])
        out: dict[str, float] = {}
        label_at = {0: OUTSIDE}
        for t, to, kind, c, _ in edges:
            if (c.kind, c.start, c.end) in gold:
                label_at[to] = kind
        for t, to, kind, c, own in edges:
            true = (c.kind, c.start, c.end) in gold
            before = label_at.get(t, OUTSIDE)
            chance = 0.0
            for y in range(OUTSIDE + 1):
                p = math.exp(min(0.0, ahead[t, y] + joins[y][kind] + own + behind[to, kind] - total))
                chance += p
                change = (1.0 if true and y == before else 0.0) - p
                if abs(change) > 1e-9:
                    out[f"{y}>{kind}"] = out.get(f"{y}>{kind}", 0.0) + change
            if abs(change := (1.0 if true else 0.0) - chance) > 1e-9:
                for f in c.features:
                    out[f] = out.get(f, 0.0) + change
        return out


# --- fitting -------------------------------------------------------------------------------------------------------
def _regrouped(digits: str, sizes: list[int], gap: str) -> str:
    parts, at = [], 0
    for n in sizes:
        parts.append(digits[at : at + n])
        at += n
    return gap.join([p for p in [*parts, digits[at:]] if p])


def reshape(kind: str, text: str, rnd: random.Random) -> str:
    """Another entity of a kind whose shape varies: name and host of an address, sizes of its parts."""
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(2, 9)))
    if kind == "email":
        local = rnd.choice([word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{rnd.randint(1, 99)}"])
        return f"{local}@{'.'.join(word() for _ in range(rnd.choice([1, 1, 2])))}.{rnd.choice(['com', 'org', 'net', 'fr', 'de', 'es', 'co', 'io', 'edu', 'info'])}"
    if kind == "ip":
        return ".".join(str(rnd.randint(0, rnd.choice([9, 99, 255]))) for _ in range(4))
    return text


def respell(kind: str, text: str, rnd: random.Random) -> str:
    """Another spelling of a match of ``kind`` that the patterns do not find, or not as one."""
    if kind == "email":
        at = rnd.choice([" at ", " (at) ", "(at)", "[at]", " [at] ", " @ ", " AT ", "{at}", "<at>"])
        dot = " dot " if at == " at " else " DOT " if at == " AT " else rnd.choice([".", " dot ", "(dot)", " (dot) ", "[dot]", " [dot] ", "[.]"])
        local, host = text.split("@", 1)
        if at == " @ ":
            dot = "."
        return (local if rnd.random() < 0.5 or dot == "." else local.replace(".", dot)) + at + host.replace(".", dot)
    if kind == "ip":
        return text.replace(".", rnd.choice(["[.]", "(.)", " . ", "[dot]", "(dot)", " dot ", ". "]))
    digits = _only_digits(text)
    if kind == "card":
        return _regrouped(digits, [4] * 5, rnd.choice([".", "/", "_", "  ", "\xa0", " - ", "–"]))
    country, rest = digits[:-10], digits[-10:]
    a, b, c = rest[:3], rest[3:6], rest[6:]
    short = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"({a}) {b} {c}", f"{a}/{b}-{c}", _regrouped(rest, [2] * 5, " ")]
    return rnd.choice([*short, f"00{country or 1} {a} {b} {c}", f"+{country or 1}/{a}/{b}/{c}", f"+{country or 1}\xa0{a}\xa0{b}\xa0{c}"])


def near_miss(rnd: random.Random) -> str:
    """Text that has some of an entity's signs and is none."""
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdehilmnorstu") for _ in range(rnd.randint(3, 8)))
    part = lambda top: str(rnd.randint(0, top))
    day = f"{rnd.randint(1900, 2099)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}"
    return rnd.choice([
        day, f"{day} {rnd.randint(0, 23):02d}:{n(2)}", f"{day} {day}", f"{rnd.randint(1, 28):02d}.{rnd.randint(1, 12):02d}.{rnd.randint(1900, 2099)} {rnd.randint(0, 23):02d}.{n(2)}",
        " ".join(n(rnd.randint(1, 6)) for _ in range(rnd.randint(3, 12))), " ".join(f"{n(2)}.{n(rnd.randint(1, 5))}" for _ in range(rnd.randint(2, 6))),
        f"97{rnd.choice('89')}-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{part(20)}.{part(20)}.{part(20)}", ".".join(part(20) for _ in range(rnd.randint(5, 7))), n(rnd.randint(10, 13)),
        f"{word()} at {word()}.{rnd.choice(['com', 'org', 'net'])}", f"{word()} at www.{word()}.com/{word()}", f"{word()} at {word()}. {word()} dot", f"{rnd.randint(1900, 2099)}-{rnd.randint(1900, 2099)} {n(4)}",
        f"{n(4)}-{n(6)}-{n(2)}", f"{n(3)} {n(3)} {n(3)} {n(3)} {n(3)}", f"{part(9)}, {part(9)}, {part(99)}, {part(99)}", f"{rnd.choice('123')}{n(2)}.{n(3)}.{n(3)},{n(2)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)}",
        f"{n(1)} / {n(2)} / {n(4)} / {n(5)}", f"{n(5)}-{n(5)}-{n(5)}", f"{n(2)}-{n(4)}-{n(4)}-{n(2)}", f"{n(4)}-{n(4)}-{n(4)}-{n(4)}-{n(4)}",
    ])


def training_lattices(matches: list[tuple[str, str, str, str]], seed: int = 11) -> list[tuple[Lattice, set[Span]]]:
    """Lattices with the right spans, from (kind, text before, match, text after): plain, respelt, side by side, missed."""
    rnd, out = random.Random(seed), []

    def add(before: str, parts: list[tuple[str, str]], after: str, gap: str = " ") -> None:
        text, gold = before, set()
        for k, (kind, value) in enumerate(parts):
            text += gap if k else ""
            if kind:
                gold.add((kind, len(text), len(text) + len(value)))
            text += value
        lattice = Lattice(text + after, candidates(text + after, []))
        known = {(c.kind, c.start, c.end) for *_, c in lattice.edges}
        if lattice.edges and gold <= known:
            out.append((lattice, gold))

    for kind, before, match, after in matches:
        spelt = (kind, respell(kind, reshape(kind, match, rnd) if rnd.random() < 0.5 else match, rnd))
        other, _, second, _ = rnd.choice(matches)
        add(before, [(kind, match)], after)
        add(before, [spelt], after)
        add(before, [(kind, match), (other, second)], after)
        add(before, [spelt, (other, respell(other, second, rnd) if rnd.random() < 0.5 else second)], after)
        add(before, [("", near_miss(rnd))], after)
        add(before, [("", near_miss(rnd))], after)
    return out


def fit_field(matches: list[tuple[str, str, str, str]], rounds: int = 12, rate: float = 0.5, shrink: float = 2e-3) -> SpanField:
    """Stochastic gradient ascent with a step of its own for each feature; no matches give a field that adds nothing."""
    lattices, field, seen = training_lattices(matches), SpanField(), {}
    order, rnd = list(range(len(lattices))), random.Random(7)
    for _ in range(rounds):
        rnd.shuffle(order)
        for k in order:
            for f, g in field.gradient(*lattices[k]).items():
                g -= shrink * field.weights.get(f, 0.0)
                seen[f] = seen.get(f, 1.0) + g * g
                field.weights[f] = field.weights.get(f, 0.0) + rate * g / math.sqrt(seen[f])
    return field


def sample_matches(docs: DataFrame, documents: int = 20_000, per_kind: int = 150, around: int = 30) -> list[tuple[str, str, str, str]]:
    """At most ``per_kind`` matches of each kind with ``around`` characters on both sides, from about ``documents`` rows.

    Rows are chosen by a hash of id and text, matches by a hash of theirs; these two bounds are the only sampling.
    """
    rows = docs.select("doc_id", "text").where("text IS NOT NULL")
    total = max(1, docs.count())
    if total > documents:
        share = F.lit(documents / total * float(1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("spans")), F.lit(1 << 30)) < share)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for text in batch.column(0).to_pylist():
                for kind, a, b in base_spans(text):
                    if b - a <= 80:
                        before, after = text[max(0, a - around) : a], text[b : b + around]
                        order = hashlib.md5(f"{kind}{before}{text[a:b]}{after}".encode()).hexdigest()
                        held.append((kind, before, text[a:b], after, order))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*held, strict=True)] or [pa.array([], pa.string())] * 5, ["kind", "before", "match", "after", "by"])

    found = cut(rows.select("text").mapInArrow(collect, "kind string, before string, match string, after string, by string"), "matches")
    out = []
    for kind in KINDS:
        first = found.where(F.col("kind") == kind).dropDuplicates(["by"]).orderBy("by").limit(per_kind)
        # Text beside a match may hold other data; only what cannot be part of any is kept.
        out += [(r.kind, re.split(r"[0-9@+]", r.before)[-1].split("\n")[-1], r.match, re.split(r"[0-9@+(]", r.after)[0]) for r in first.collect()]
    return out


# --- documents -----------------------------------------------------------------------------------------------------
def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(text: str, field: SpanField) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and those with what the field adds, by start, then kind."""
    base = base_spans(text)
    added = [(c.kind, c.start, c.end) for c in field.best(text, candidates(text, base))]
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of the first in angle brackets."""
    parts, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def find_personal_data(docs: DataFrame, field: SpanField) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, masked_text`` of every whole text.

    The counts and the digest are of the patterns' matches; ``spans`` has those and the added ones, as ``kind:start:end``
    in code points, comma-joined. Added spans overlap no match and each other nowhere.

    Defined results: a null text is empty and its masked text null; an empty text has no spans; repeated rows and ids are
    judged one by one; where segmentations tie, fewer spans win; an empty table gives no rows; other columns are not read.
    """
    weights = dict(field.weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SpanField(weights)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                some = batch.slice(first, 500)
                texts = some.column(1).to_pylist()
                found = [all_spans(t or "", model) for t in texts]
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digests = [hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), *counts, pa.array(digests, pa.string()), pa.array([spelled(every) for _, every in found], pa.string()),
                        pa.array([len(every) - len(base) for base, every in found], pa.int64()),
                        pa.array([None if t is None else masked(t, every) for t, (_, every) in zip(texts, found, strict=True)], pa.string()),
                    ],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "masked_text"],
                )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(judge, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long, masked_text string")


def personal_data(docs: DataFrame, documents: int = 20_000, per_kind: int = 150) -> DataFrame:
    """``find_personal_data`` with a field fitted on matches in a sample of the same documents."""
    return find_personal_data(docs, fit_field(sample_matches(docs, documents, per_kind)))
