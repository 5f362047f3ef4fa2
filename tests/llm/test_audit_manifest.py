"""The filter audit and the Merkle manifest against plain Python, on awkward rows and with other parameters."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import brute
import pytest
from pyspark.sql import functions as F

from kinlink.llm import audit, manifest


# --- filter audit --------------------------------------------------------------------------------------------------
def failing(rows, marks):
    """(part, set of failing filters, good, toxic) of each row."""
    first = {}
    for number, text, *_ in rows:
        if number is not None:
            first[text or ""] = min(first.get(text or "", number), number)
    for number, text, lang, *_ in rows:
        t, words = text or "", brute.words_of(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": number is not None and first[t] < number,
        }
        yield lang or "", {f for f, x in fails.items() if x}, (number, "quality") in marks, (number, "toxic") in marks


def audited(rows, marks):
    parts = defaultdict(list)
    for part, *rest in failing(rows, marks):
        parts[part].append(rest)
    out = Counter()
    for part, docs in parts.items():
        total, found = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                found.append((f, ("".join(order), step, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out.update((part, *row, total[f]) for f, row in found)
    return out


def shown(df):
    return Counter(tuple(r) for r in df.select("part", "filter_order", "step", *audit.NUMBERS).collect())


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, int(k % 3 == 0), int(k % 7 == 0), "x") for k in range(0, 150, 2)] + [(4, 1, 1, "y"), (6, None, None, "z"), (None, 1, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def marked(labels):
    return {(r.doc_id, c) for r in labels.collect() for c in ("quality", "toxic") if r[c] == 1 and r.doc_id is not None}


def test_audit_on_awkward_rows(spark, rows, docs, labels):
    assert shown(audit.audit_filters(docs, labels)) == audited(rows, marked(labels))


def test_audit_of_copies_and_capitals(spark, labels):
    shout, long = "AB#C " * 3, " ".join(f"w{k}" for k in range(120))
    rows = [(k, shout, "en") for k in range(40)] + [(k, long, None if k % 2 else "fr") for k in range(40, 60)]
    rows += [(40, long, "fr"), (40, long, "fr"), (None, long, "fr"), (None, shout, ""), (7, None, "de"), (8, "", "de"), (99, long + " ABCDEFG" * 30, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert shown(audit.audit_filters(df, labels)) == audited(rows, marked(labels))


def test_audit_of_nothing(spark, empty, labels, rows, docs):
    assert audit.audit_filters(empty, labels).collect() == []
    assert shown(audit.audit_filters(docs, labels.limit(0))) == audited(rows, set())


def test_gray_walk_states():
    rnd = random.Random(3)
    cells = {m: (rnd.randint(0, 9), rnd.randint(0, 3)) for m in rnd.sample(range(16), 9)}
    states = audit.gray_walk(cells, 4)
    for chosen in range(16):
        left = [c for m, c in cells.items() if not m & chosen]
        assert states[chosen] == (sum(c[0] for c in left), sum(c[1] for c in left))


# --- Merkle manifest -----------------------------------------------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_levels(digests, arity):
    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + arity])) for i in range(0, len(low), arity)])
    return levels


def proof_steps(levels, place, arity):
    """(digests left of the node, right of it) of each level below the root."""
    for low in levels[:-1]:
        run = low[place // arity * arity : place // arity * arity + arity]
        yield "".join(run[: place % arity]), "".join(run[place % arity + 1 :])
        place //= arity


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def manifest_of(rows, arity):
    sources = defaultdict(list)
    for number, text, lang, source, n_chars, *_ in rows:
        leaf = leaf_of([number, source, lang, n_chars, text])
        changed = number is not None and zlib.crc32(str(number).encode()) % 5 == 0
        sources[source].append((number is not None, number or 0, leaf, leaf_of([number, source, lang, n_chars, lowered(text)]) if changed else leaf))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_levels([x[2] for x in sorted(sources[s])], arity) for s in order]
    top = tree_levels([t[-1][0] for t in trees], arity)
    out = Counter()
    for place, (s, tree) in enumerate(zip(order, trees, strict=True)):
        for k, (known, number, leaf, given) in enumerate(sorted(sources[s])):
            steps = [*proof_steps(tree, k, arity), *proof_steps(top, place, arity)]
            folded = given
            for left, right in steps:
                folded = sha(left + folded + right)
            out[(number if known else None, s, leaf, tree[-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0])] += 1
    return out


PROOF = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def proven(df, arity):
    rows = manifest.merkle_manifest(df, arity=arity, tampered=manifest.every_fifth(F.col("doc_id")))
    return Counter(tuple(r[c] for c in PROOF) for r in rows.collect())


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest_on_awkward_rows(rows, docs, arity):
    assert proven(docs, arity) == manifest_of(rows, arity)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [17, 1, 16, 256, 257], [0, 33] + [1] * 40])
def test_manifest_tree_shapes(spark, sizes):
    rows = [(100 * k - j, f"Text {k} {j}", None, None if j == 2 else f"s{j}", k) for j, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = manifest_of(rows, 16)
    assert proven(df.repartition(7), 16) == want
    assert sum(sizes) < 9 or {w[-1] for w in want} == {True, False}


def test_manifest_of_nothing_and_of_repeated_rows(spark, empty):
    assert manifest.merkle_manifest(empty).collect() == []
    rows = [(5, "same", "en", "a", 4)] * 40 + [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert proven(df, 16) == manifest_of(rows, 16)


def test_a_changed_row_changes_only_its_tree(spark):
    rows = [(k, f"text {k}", "en", "ab"[k % 2], 6) for k in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = {r.doc_id: r for r in manifest.merkle_manifest(spark.createDataFrame(rows, schema)).collect()}
    rows[8] = (8, "changed", "en", "a", 7)
    two = {r.doc_id: r for r in manifest.merkle_manifest(spark.createDataFrame(rows, schema)).collect()}
    assert all(r.verified for r in [*one.values(), *two.values()])
    assert one[0].subroot != two[0].subroot and one[0].root != two[0].root and one[1].subroot == two[1].subroot
    assert [k for k in one if one[k].leaf != two[k].leaf] == [8]
