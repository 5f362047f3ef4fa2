"""Registered queries of the subpackage: against their SQL, or against plain Python on the smallest tables."""

import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from compare import compare

from kinlink.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.SQL)
def test_query_against_sql(spark, duck, name):
    ok, note = compare(spark, duck, SF, queries.QUERIES[name], queries.SQL[name])
    assert ok, note


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def rows_of(spark, name, *columns):
    return Counter(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect())


def test_near_duplicates_query(spark, documents):
    got = rows_of(spark, "op9_near_duplicates", "doc_id", "n_shingles", "component_id", "kept")
    assert got == Counter(brute.near_components([d[:2] for d in documents], 4, 80))


def test_substring_query(spark, documents):
    got = rows_of(spark, "op6_substrings", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter((d[0], *w) for d, w in zip(documents, brute.substring_removal([d[1] for d in documents], 200), strict=True))


def test_token_query(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.word_vocabulary())
    want, start = Counter(), 0
    for number, text, _ in sorted(documents):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want[(number, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    assert rows_of(spark, "op3_token_ids", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_mixing_query(spark, documents):
    sizes = Counter()
    for _, text, source in documents:
        sizes[source] += len(brute.words_of(text))
    targets, taken = brute.targets(dict(sizes)), Counter()
    for r in queries.QUERIES["op10_mixing"](spark, SF).collect():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())


def test_score_query(spark, documents):
    got = {r.doc_id: r.log_score for r in queries.QUERIES["op7_lm_scores"](spark, SF).collect()}
    assert got == pytest.approx({d[0]: s for d, s in zip(documents, brute.backoff_scores([d[1] for d in documents]), strict=True)})


def test_leak_query_finds_every_verbatim_passage(spark, documents):
    from kinlink.llm.decontaminate import normal_words

    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    held = {d[0]: f" {' '.join(normal_words(d[1]))} " for d in documents}
    want = {(d, i.item_id) for d, words in held.items() for i in items if f" {' '.join(normal_words(i.text))} " in words}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_decontamination"](spark, SF).collect()}
    assert want and want <= got


def test_quality_query(spark, documents):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in queries.QUERIES["op5_quality_rules"](spark, SF).collect()}
    assert got == {d[0]: brute.statistics(d[1]) for d in documents}


def test_pipeline(spark, documents):
    """Every stage keeps what plain Python keeps, and the last tables add up."""
    import corpus_pipeline
    from kinlink.llm import decontaminate, mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {d[0]: d[1] for d in documents}
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda df: {r.doc_id for r in df.collect()}
    one = stages["language_id"](spark, docs, SF)
    assert one.columns == columns and kept(one) == set(texts)
    two = stages["near_duplicates"](spark, one, SF)
    assert two.columns == columns
    assert kept(two) == {r[0] for r in brute.near_components([d[:2] for d in documents], 5, 80) if r[3]}
    three = stages["decontamination"](spark, two, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    block = decontaminate.ItemBlock(items, 80)
    ids = sorted(kept(two))
    found = {ids[k] for k, *_ in block.search([texts[i] for i in ids], decontaminate.Vocabulary(block.words))}
    assert three.columns == columns and kept(three) == set(ids) - found
    four = stages["mixing"](spark, three, SF)
    copies = Counter(r.doc_id for r in four.collect())
    rounded = {r.doc_id: round(r.mix_taken / r.mix_size) for r in mixing.mix(three).collect() if r.mix_size}
    assert four.columns == columns and copies == {k: n for k, n in rounded.items() if n}
    five = stages["token_ids"](spark, four, SF).collect()
    assert Counter(r.doc_id for r in five) == copies
    assert sum(r.n_tokens for r in five) == max(r.start + r.n_tokens for r in five)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.start, r.ids_crc32) for r in five)
