"""Repeated substrings: every byte covered by a ``span``-byte string that also starts elsewhere, by sorted suffixes.

A suffix is a start position with the ``span`` bytes after it. Its leading token is its anchor: the ``gram``-byte string
with the smallest hash among those inside the span (the last of equal ones). Equal suffixes have equal anchors, so only
suffixes whose anchor occurs again can repeat; all others are left out before anything is sorted. Neighbouring suffixes
with the same anchor travel as one piece of text, so a suffix costs a few bytes instead of ``span``.

Spark's range partitioner samples splitters and deals the pieces by anchor. In each bucket the suffixes are sorted by
multikey quicksort on eight-byte digits: a digit splits every open group, suffixes left alone are closed, groups of two are
compared directly. Suffixes that stay together through the whole span repeat. Equal pieces are merged before (they repeat
as a whole), with the merge combined map-side. Buckets need no comparison across their boundaries, as an anchor never
straddles one; an anchor with more than ``hot`` different pieces is taken out and its suffixes are counted by digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import MOST_DIGESTS, attach_small
from kinlink.session import cut

#: Bytes handled at once; a longer text is cut into overlapping parts.
PART = 1 << 20
MIX = np.uint64(0xD6E8FEB86659FD93)
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def digits(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def gram_hashes(data: np.ndarray, gram: int = 32) -> np.ndarray:
    """Hash of the ``gram`` (a multiple of 8, up to 32) bytes from each position."""
    words, n = digits(data), len(data) - gram + 1
    total = np.zeros(n, np.uint64)
    for k in range(gram // 8):
        total ^= words[8 * k : 8 * k + n] * FACTORS[k]
        total ^= total >> np.uint64(31)
        total *= MIX
    return total ^ (total >> np.uint64(32))


def anchored_runs(parts: list[bytes], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring suffixes with one anchor: part, first suffix in the part, number of suffixes, anchor hash."""
    lengths = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    total = int(lengths.sum())
    if total < span:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(data[:total], gram)
    n, width = total - span + 1, span - gram + 1
    # Smallest (hash, last position) of each window of grams: running minima from both ends of fixed blocks.
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    padded = np.full(-(-len(order) // width) * width, np.uint64(2**64 - 1))
    padded[: len(order)] = order
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.uint64(0xFFFFFFFF) - (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF))).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), lengths)
    inside = part[:n] == part[span - 1 :]
    first = np.flatnonzero(inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([(anchor[1:] != anchor[:-1]) | ~inside[1:], [True]]))
    begins = np.cumsum(lengths) - lengths
    return part[first], first - begins[part[first]], last - first + 1, hashes[anchor[first]]


def in_parts(rows: list[tuple], span: int) -> Iterator[list[tuple]]:
    """Batches of (key, offset, bytes) of about ``PART`` bytes from (key, text) rows; suffixes are dealt once each."""
    held, size = [], 0
    for key, text in rows:
        data = (text or "").encode()
        for at in range(0, max(0, len(data) - span + 1), PART):
            held.append((key, at, data[at : at + PART + span - 1]))
            size += len(held[-1][2])
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


def repeating(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, span: int) -> np.ndarray:
    """Which suffixes equal another of their group in all ``span`` bytes (a multiple of 8): multikey quicksort."""
    words, found = digits(data), np.zeros(len(starts), bool)
    rows, group = np.arange(len(starts)), groups
    for digit in range(span // 8):
        values = words[starts[rows] + 8 * digit]
        order = np.lexsort((values, group))
        rows, values, group = rows[order], values[order], group[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (values[1:] != values[:-1])])
        group = np.cumsum(new)
        sizes = np.bincount(group)[group]
        pairs = rows[sizes == 2].reshape(-1, 2)
        for some in np.array_split(pairs, len(pairs) // 50_000 + 1):
            at = starts[some][:, :, None] + 8 * np.arange(digit + 1, span // 8)
            same = (words[at[:, 0]] == words[at[:, 1]]).all(1)
            found[some[same]] = True
        rows, group = rows[sizes > 2], group[sizes > 2]
        if not len(rows):
            return found
    found[rows] = True
    return found


def true_ranges(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of runs of true flags; a run ends where ``bounds`` marks a new piece."""
    first = np.flatnonzero(flags & (bounds | np.concatenate([[True], ~flags[:-1]])))
    last = np.flatnonzero(flags & np.concatenate([bounds[1:] | ~flags[1:], [True]]))
    return first, last


def marks_of(rows: list[tuple], span: int) -> pa.RecordBatch:
    """``digest, low, high`` ranges of repeating suffixes from complete groups of (anchor, digest, run, piece)."""
    pieces = [r[3] for r in rows]
    data = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    begins = np.cumsum([0, *map(len, pieces)])[:-1]
    runs = np.array([r[2] for r in rows], np.int64)
    group = np.cumsum(np.concatenate([[0], np.diff(np.array([r[0] for r in rows], np.int64)) != 0]))
    piece = np.repeat(np.arange(len(rows)), runs)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(runs) - runs, runs)
    found = repeating(data, begins[piece] + offset, group[piece], span)
    first, last = true_ranges(found, offset == 0)
    digests = pa.array([r[1] for r in rows], pa.binary()).take(pa.array(piece[first]))
    return pa.RecordBatch.from_arrays([digests, pa.array(offset[first]), pa.array(offset[last])], ["digest", "low", "high"])


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open byte ranges as maximal runs."""
    runs: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if runs and low <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], high))
        else:
            runs.append((low, high))
    return runs


def within(rows: DataFrame, keys: DataFrame, key: str, most: int = MOST_DIGESTS) -> DataFrame:
    """Rows with a key in ``keys``; up to ``most`` keys are broadcast, so that the others' texts are not shuffled."""
    return rows.join(F.broadcast(keys), key, "left_semi") if keys.count() <= most else rows


def repeated_pieces(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """``sha, start, run, anchor, digest, piece`` for runs of suffixes of ``sha, text`` whose anchor occurs again."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in in_parts(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), span):
                part, _, _, hashes = anchored_runs([p[2] for p in parts], span, gram)
                keys = np.array([p[0] for p in parts], np.int64)[part]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(keys)], ["anchor", "tid"])

    keyed = texts.withColumn("tid", F.xxhash64("text"))
    met = cut(keyed.select("tid", "text").mapInArrow(anchors, "anchor long, tid long"), "suffix-anchors")
    again = met.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # Two texts may share a key: they then look for each other's anchors as well, which finds nothing more.
    wanted = cut(met.join(again, "anchor").groupBy("tid").agg(F.collect_set("anchor").alias("anchors")), "suffix-wanted")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, rows, asked = (batch.column(k).to_pylist() for k in range(3))
            for parts in in_parts(list(enumerate(rows)), span):
                part, start, run, hashes = anchored_runs([p[2] for p in parts], span, gram)
                known = np.unique(np.concatenate([np.array(asked[k], np.int64) for k in {p[0] for p in parts}]))
                hold = np.isin(hashes.view(np.int64), known)
                part, start, run, hashes = part[hold], start[hold], run[hold], hashes[hold]
                cutout = [parts[i][2][s : s + n + span - 1] for i, s, n in zip(part.tolist(), start.tolist(), run.tolist(), strict=True)]
                digests = [hashlib.blake2b(c, digest_size=16).digest() for c in cutout]
                where = start + np.array([p[1] for p in parts], np.int64)[part]
                names = [shas[parts[i][0]] for i in part.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(where), pa.array(run), pa.array(hashes.view(np.int64)), pa.array(digests, pa.binary()), pa.array(cutout, pa.binary())],
                    ["sha", "start", "run", "anchor", "digest", "piece"],
                )

    asked = within(keyed, wanted.select("tid"), "tid").join(wanted, "tid").select("sha", "text", "anchors")
    return cut(asked.mapInArrow(pieces, "sha binary, start long, run long, anchor long, digest binary, piece binary"), "suffix-pieces")


def repeated_suffixes(pieces: DataFrame, span: int, hot: int) -> DataFrame:
    """``digest, low, high``: ranges of suffixes of a piece (by its digest) that repeat."""
    merged = pieces.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.first("run").alias("run"), F.first("piece").alias("piece"))
    merged = cut(merged, "suffix-merged")
    whole = merged.where("n > 1").select("digest", F.lit(0).cast("long").alias("low"), (F.col("run") - 1).alias("high"))
    sizes = cut(merged.groupBy("anchor").agg(F.count("*").alias("kinds")), "suffix-groups")
    shared = merged.join(sizes.where("kinds > 1"), "anchor").select("anchor", "digest", "run", "piece", "kinds")
    dealt = shared.where(F.col("kinds") <= hot).repartitionByRange("anchor").sortWithinPartitions("anchor")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, suffixes = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if suffixes > 200_000 and row[0] != held[-1][0]:
                    yield marks_of(held, span)
                    held, suffixes = [], 0
                held.append(row)
                suffixes += row[2]
        if held:
            yield marks_of(held, span)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, run, piece in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                each = [hashlib.blake2b(piece[i : i + span], digest_size=16).digest() for i in range(run)]
                yield pa.RecordBatch.from_arrays([pa.array(each, pa.binary()), pa.array([digest] * run, pa.binary()), pa.array(range(run), pa.int64())], ["suffix", "digest", "low"])

    columns = "anchor", "digest", "run", "piece"
    local = dealt.select(*columns).mapInArrow(sort, "digest binary, low long, high long")
    if sizes.where(F.col("kinds") > hot).isEmpty():
        return cut(whole.union(local), "suffix-marks")
    single = shared.where(F.col("kinds") > hot).select(*columns).mapInArrow(suffixes, "suffix binary, digest binary, low long")
    single = cut(single, "suffix-single")
    twice = single.groupBy("suffix").agg(F.count("*").alias("n")).where("n > 1").select("suffix")
    counted = single.join(twice, "suffix").select("digest", "low", F.col("low").alias("high"))
    return cut(whole.union(local).union(counted), "suffix-marks")


def remove_repeats(docs: DataFrame, span: int = 200, gram: int = 32, hot: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept_text`` of every row.

    Each byte of the UTF-8 text that a ``span``-byte string covers which also starts anywhere else goes; overlaps count,
    and strings are judged on the input. ``kept_text`` is the remaining bytes, null where they are all of them.

    Defined results: a null text is empty; texts shorter than ``span`` keep everything; of equal texts all bytes go (from
    ``span`` bytes on), rows that repeat an id included; null ids are ids; an empty table gives an empty result; other
    columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    copies = rows.where(F.col("n_bytes") >= span).groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    copies = cut(copies.where("copies > 1"), "suffix-copies")
    rows = attach_small(rows, copies, ["sha"], limit=MOST_DIGESTS)
    one = F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))
    pieces = repeated_pieces(rows.where(one & (F.col("n_bytes") >= span)).select("sha", "text"), span, gram)
    marks = repeated_suffixes(pieces, span, hot)
    spans = pieces.select("digest", "sha", "start").join(marks, "digest")
    spans = spans.select("sha", F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") + span).alias("high")).alias("span"))
    spans = cut(spans.groupBy("sha").agg(F.collect_list("span").alias("spans")), "suffix-spans")
    hexed = lambda c: F.lower(F.hex(c))
    none = F.lit(0).cast("long")

    def result(n_removed: Column, n_spans: Column, digest: Column, kept: Column) -> list[Column]:
        return [F.col("doc_id"), F.col("n_bytes"), n_removed.alias("n_removed"), n_spans.alias("n_spans"), digest.alias("kept_sha256"), kept.alias("kept_text")]

    gone = rows.where("copies IS NOT NULL").select(*result(F.col("n_bytes"), F.lit(1).cast("long"), F.lit(hashlib.sha256(b"").hexdigest()), F.lit(b"")))
    alone = rows.where("copies IS NULL")
    clean = alone.join(spans.select("sha"), "sha", "left_anti").select(*result(none, none, hexed(F.col("sha")), F.lit(None).cast("binary")))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = (batch.column(k) for k in range(3))
            removed, numbers, digests, kept = [], [], [], []
            for data, some in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
                data = data.encode()
                runs = merged_spans([(s["low"], s["high"]) for s in some])
                ends = [0, *[x for run in runs for x in run], len(data)]
                left = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                removed.append(len(data) - len(left))
                numbers.append(len(runs))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            sizes = [r + len(k) for r, k in zip(removed, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(numbers, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    held = within(alone, spans.select("sha"), "sha").join(spans, "sha").select(F.col("doc_id").cast("long"), "text", "spans")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
    return gone.union(clean).union(held.mapInArrow(drop, kinds))
