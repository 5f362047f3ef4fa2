"""Personal data: the patterns against plain regexes, the field against brute force over segmentations, held-out spellings."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import brute
import pytest

from kinlink.llm import pii, queries

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(text):
    found = [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m.group())]
    return sorted(found, key=lambda s: (s[1], list(PLAIN).index(s[0])))


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def matches(texts):
    found = []
    for t in texts:
        for kind, a, b in pii.base_spans(t or ""):
            found.append((kind, re.split(r"[0-9@+]", t[max(0, a - 30) : a])[-1].split("\n")[-1], t[a:b], re.split(r"[0-9@+(]", t[b : b + 30])[0]))
    random.Random(1).shuffle(found)
    return found


@pytest.fixture(scope="module")
def field(matches):
    return pii.fit_field(matches[: len(matches) // 2])


def test_patterns_match_the_plain_ones(texts):
    rnd = random.Random(4)
    odd = ["".join(rnd.choice("01259..@@-- +()ab_%é٣") for _ in range(rnd.randint(0, 60))) for _ in range(6000)]
    odd += ["a@b.c@d.e", "x@y", "..@-.-", "1.2.3.4.5.6.7.8.9", "0001.02.3.4", "+1" + " " * 50 + "2 345678901", "4012888888881881 4012888888881881"]
    for t in [*(t or "" for t in texts), *odd]:
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "1 ", "a@", "+", "+1 ", " ", "@", " at a.b ", "1 dot ", "(", "4012888888881881 "):
        text = unit * (300_000 // len(unit))
        base, every = pii.all_spans(text, pii.SpanField())
        assert every == base


def test_segmentation_is_the_best_of_all(field):
    rnd = random.Random(6)
    for _ in range(150):
        text = " ".join(rnd.choice([pii.near_miss(rnd), "+1 (269) 555-3296", "4524132264652876", "10.0.0.1", "a at b dot c dot de"]) for _ in range(2))
        found = pii.candidates(text, [])
        if not 0 < len(found) <= 12:
            continue
        weighted = pii.SpanField({**{f: rnd.uniform(-1, 1) for c in found for f in c.features}, **{f"{a}>{b}": rnd.uniform(-1, 1) for a in range(5) for b in range(4)}})

        def total(chosen, weighted=weighted, text=text):
            score, last_end, last = 0.0, 0, pii.OUTSIDE
            for c in chosen:
                if c.start < last_end:
                    return -math.inf
                beside = last != pii.OUTSIDE and not text[last_end : c.start].strip(" ")
                kind = pii.KINDS.index(c.kind)
                score += weighted.score(c) + weighted.weights[f"{last if beside else pii.OUTSIDE}>{kind}"]
                last_end, last = c.end, kind
            return score

        best = max(total(sorted(s, key=lambda c: c.start)) for n in range(4) for s in itertools.combinations(found, n))
        assert total(weighted.best(text, found)) >= best - 1e-9


def test_gradient_is_that_of_the_likelihood(matches):
    lattices = pii.training_lattices(matches[:6])
    lattice, gold = max(lattices, key=lambda x: len(x[0].edges) if len(x[0].edges) < 14 else 0)
    rnd = random.Random(2)
    weights = {f: rnd.uniform(-0.5, 0.5) for *_, c in lattice.edges for f in c.features} | {f"{a}>{b}": rnd.uniform(-0.5, 0.5) for a in range(5) for b in range(4)}

    def likelihood(w):
        model, joins, paths = pii.SpanField(w), pii.SpanField(w).joins(), []
        leaving = {}
        for e in lattice.edges:
            leaving.setdefault(e[0], []).append(e)

        def walk(t, label, score, chosen):
            if t == len(lattice.points) - 1:
                paths.append((score, frozenset(chosen)))
                return
            walk(t + 1, pii.OUTSIDE, score, chosen)
            for _, to, kind, c in leaving.get(t, []):
                walk(to, kind, score + joins[label][kind] + model.score(c), [*chosen, (c.kind, c.start, c.end)])

        walk(0, pii.OUTSIDE, 0.0, [])
        (right,) = [s for s, c in paths if c == frozenset(gold)]
        return right - math.log(sum(math.exp(s) for s, _ in paths))

    found = pii.SpanField(weights).gradient(lattice, gold)
    for f in rnd.sample(sorted(weights), 25):
        step = (likelihood({**weights, f: weights[f] + 1e-5}) - likelihood({**weights, f: weights[f] - 1e-5})) / 2e-5
        assert found.get(f, 0.0) == pytest.approx(step, abs=1e-5)


def test_held_out_spellings_and_near_misses(field, matches):
    rnd, found, wrong = random.Random(9), Counter(), 0
    for kind, before, match, after in matches[len(matches) // 2 :]:
        for _ in range(4):
            spelt = pii.respell(kind, match, rnd)
            _, every = pii.all_spans(before + spelt + after, field)
            found[kind, (kind, len(before), len(before) + len(spelt)) in every] += 1
    for kind in pii.KINDS:
        assert found[kind, True] >= 0.9 * (found[kind, True] + found[kind, False]), found
    for _ in range(1500):
        base, every = pii.all_spans(f"the word {pii.near_miss(rnd)} and more", field)
        wrong += len(every) - len(base)
    assert wrong <= 15


def test_numbers_side_by_side(field):
    text = "x +1 (269) 555-3296 4524132264652876 and"
    assert plain_spans(text) == []
    assert pii.all_spans(text, field)[1] == [("phone", 2, 19), ("card", 20, 36)]


def test_query_on_whole_table(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_personal_data"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        base = plain_spans(rows[r.doc_id])
        counts = Counter(k for k, *_ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        every = [s.split(":") for s in r.spans.split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in every} >= set(base) and len(every) == len(base) + r.n_added


def test_awkward_rows(spark, rows, docs, empty):
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows) and {r.spans for r in got} == {""}
    assert Counter((r.doc_id, r.masked_text) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert pii.personal_data(empty).collect() == []
    odd = [(None, "mail a@b.cd", "x"), (1, None, "y"), (1, "", "y"), (2, "9" * 2_000_000 + " 10.0.0.1 " + "é 😀 " * 200_000 + "z@y.x", "z")]
    df = spark.createDataFrame(odd, "doc_id long, text string, spans string")
    found = {(r.doc_id, r.spans): r.masked_text for r in pii.find_personal_data(df, pii.SpanField()).collect()}
    assert found[None, "email:5:11"] == "mail <EMAIL>" and found[1, ""] in (None, "") and len(found) == 3
    at = 2_000_010 + 800_000
    assert found[2, f"ip:2000001:2000009,email:{at}:{at + 5}"].endswith("😀 <EMAIL>")


def test_masked_text_of_overlapping_spans():
    text = "a +1 4012888888881881 b"
    spans = [("phone", 2, 9), ("card", 5, 21)]
    assert pii.masked(text, spans) == "a <PHONE> b"
    assert brute.WORD.findall(pii.masked(text, [])) == brute.WORD.findall(text)
