"""Token ids as binary shards: one concatenated id array a shard, document boundaries in Elias-Fano form.

Shard layout, all numbers little-endian: magic, seven 64-bit header fields (documents, documents without id, smallest
id, ids, bytes an id, bytes of each of the two boundary blocks), the block of document ids, the block of document ends,
the id array. A block is an Elias-Fano sequence: count, universe, low-bit width, then low bits, a count of ones for every
512 high bits, and the high bits.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import open_fs, returning_memory, stage_cache
from kinlink.session import cut, scratch_path

MAGIC = b"TOKSEQ01"
BLOCK = 512
#: Words of Latin letters are one pre-token in lower case; a mark after them is a second one.
MARKS = ".,;:!?"
PLAIN = re.compile("[a-zà-öø-ÿ]+")
#: The end of a text among its words, which hold no blank.
END = " "


class EliasFano:
    """A non-decreasing sequence of n numbers up to u in about n * (2 + log2(u / n)) bits, with select."""

    def __init__(self, n: int, universe: int, width: int, low: np.ndarray, ones: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.width, self.low, self.ones, self.high = n, universe, width, low, ones, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        width = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        size = -(-(n + (universe >> width) + 1) // BLOCK) * BLOCK
        marks = np.zeros(size, np.uint8)
        marks[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, universe, width, low, marks.reshape(-1, BLOCK).sum(1).astype("<u2"), np.packbits(marks, bitorder="little"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.universe, self.width, len(self.low), len(self.ones)], "<u8").tobytes()
        return head + self.low.tobytes() + self.ones.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, universe, width, lows, blocks = (int(x) for x in np.frombuffer(data, "<u8", 5))
        low = np.frombuffer(data, np.uint8, lows, 40)
        ones = np.frombuffer(data, "<u2", blocks, 40 + lows)
        return cls(n, universe, width, low, ones, np.frombuffer(data, np.uint8, blocks * BLOCK // 8, 40 + lows + 2 * blocks))

    def _low(self, first: int, count: int) -> np.ndarray:
        start, stop = first * self.width, (first + count) * self.width
        bits = np.unpackbits(self.low[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start]
        weights = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        return (bits.reshape(count, self.width).astype(np.uint64) * weights).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th number, from one block of high bits."""
        before = np.cumsum(self.ones, dtype=np.int64)
        block = int(np.searchsorted(before, i, "right"))
        rank = i - (int(before[block - 1]) if block else 0)
        bits = np.unpackbits(self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        high = block * BLOCK + int(np.flatnonzero(bits)[rank]) - i
        return (high << self.width) | int(self._low(i, 1)[0])

    def values(self) -> np.ndarray:
        """All numbers as signed 64-bit."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.int64) - np.arange(self.n)
        return (high << self.width) | self._low(0, self.n).astype(np.int64)


class _Slots(dict):
    """Word -> slot; a new word gets the next slot and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, word):
        self.waiting.append(word)
        self[word] = slot = len(self)
        return slot


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each distinct word once while it is remembered.

    White space separates pre-tokens of this vocabulary (its normaliser folds white space to blanks and its pattern drops
    them), so a text's ids are its words' ids in order. Only ASCII white space is cut at; other kinds reach the library.
    About ``most`` words are remembered; when there are more, those used several times stay.
    """

    def __init__(self, path: str, end_id: int, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.end_id, self.most = Tokenizer.from_file(path), end_id, most
        self.model, bytes_of = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: bytes_of.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.marks = {m: tuple(self.whole(m)) for m in MARKS} | {"": ()}
        self.forget()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.slots, self.chars = _Slots(), 0
        self.slots[END], self.slots[""] = 0, 1
        self.flat, self.starts, self.lengths = np.array([self.end_id], np.uint32), np.array([0, 1], np.uint32), np.array([1, 0], np.uint32)
        self.uses = np.zeros(2, np.uint32)

    def thin(self) -> None:
        """Forget the words used once or twice since the last time, or all if too many are left."""
        words, uses, flat = list(self.slots), self.uses, self.flat
        keep = np.flatnonzero(uses > 2)[2:]
        spans = [(self.starts[k], self.lengths[k]) for k in keep]
        self.forget()
        if len(keep) < self.most // 2 and sum(len(words[k]) for k in keep) < 20 * self.most:
            for slot, k in enumerate(keep, 2):
                self.slots[words[k]] = slot
            lengths = np.array([n for _, n in spans], np.uint32)
            self.starts = np.append(self.starts, 1 + np.cumsum(lengths, dtype=np.uint32) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.concatenate([self.flat, *[flat[a : a + n] for a, n in spans]])
            self.uses = np.zeros(len(self.lengths), np.uint32)
            self.chars = sum(len(words[k]) for k in keep)

    def learn(self, words: list[str]) -> None:
        """Append the ids of new words; the letters of plain words go to the library's model in lower case, once where that
        is a remembered word. Only words and their ids are held: what is kept beside them is memory of every worker.
        """
        flat, lengths, cores, model = [], [], {}, self.model
        slots, known = self.slots, len(self.starts)
        for word in words:
            mark = word[-1] if word[-1] in MARKS else ""
            core = (word[:-1] if mark else word).lower()
            ids = cores.get(core)
            if ids is None and PLAIN.fullmatch(core) and len(core) + len(mark) == len(word):
                slot = slots.get(core, known)
                if slot < known:
                    first = int(self.starts[slot])
                    ids = self.flat[first : first + int(self.lengths[slot])].tolist()
                else:
                    ids = [t.id for t in model.tokenize(core if core.isascii() else core.translate(self.as_bytes))]
                cores[core] = ids
            ids = self.whole(word) if ids is None else [*ids, *self.marks[mark]]
            flat += ids
            lengths.append(len(ids))
        sizes = np.array(lengths, np.uint32)
        self.starts = np.append(self.starts, np.uint32(len(self.flat)) + np.cumsum(sizes, dtype=np.uint32) - sizes)
        self.lengths = np.append(self.lengths, sizes)
        self.flat = np.append(self.flat, np.array(flat, np.uint32))
        self.uses = np.append(self.uses, np.zeros(len(words), np.uint32))
        self.chars += sum(map(len, words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the number of ids of each text with it."""
        words: list = []
        ends = []
        for text in texts:
            words += (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            words.append(END)
            ends.append(len(words))
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        if new := self.slots.waiting:
            self.learn(new)
            self.slots.waiting = []
        sizes = self.lengths[slots].astype(np.int64)
        starts = self.starts[slots].astype(np.int64)
        stops = np.cumsum(sizes)
        ids = self.flat[np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)]
        counts = np.diff(stops[np.array(ends, np.int64) - 1], prepend=0) if ends else np.zeros(0, np.int64)
        np.add.at(self.uses, slots, np.uint32(1))
        if len(self.slots) > self.most or self.chars > 40 * self.most:
            self.thin()
        return ids, counts


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: list[np.ndarray]) -> Iterator[bytes]:
    """The parts of a shard file; ids without a document id come first. ``ids`` are pieces of the array, written one by one."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    width = 2 if all(not len(some) or int(some.max()) < 65536 for some in ids) else 4
    blocks = [EliasFano.of(known.astype(np.uint64) - np.uint64(base % 2**64)).to_bytes(), EliasFano.of(np.cumsum(counts)).to_bytes()]
    head = [len(doc_ids), len(doc_ids) - len(known), base, sum(map(len, ids)), width, *map(len, blocks)]
    yield MAGIC + np.array(head, "<i8").tobytes()
    yield from blocks
    for some in ids:
        yield some.astype(f"<u{width}").tobytes()


class Shard:
    """Random access to a shard file by byte-range reads: only the header and the boundaries are held."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        head = self.file.read_at(64, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        self.n, self.unknown, self.base, self.n_ids, self.width, a, b = (int(x) for x in np.frombuffer(head, "<i8", 7, 8))
        self.docs, self.ends = EliasFano.from_bytes(self.file.read_at(a, 64)), EliasFano.from_bytes(self.file.read_at(b, 64 + a))
        self.body = 64 + a + b

    def ids(self, first: int, stop: int) -> np.ndarray:
        """Ids ``first`` to ``stop`` of the concatenated array."""
        data = self.file.read_at((stop - first) * self.width, self.body + first * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def doc_ids(self) -> list[int | None]:
        # Unsigned sums wrap, so ids on both sides of zero come back.
        known = (self.docs.values().astype(np.uint64) + np.uint64(self.base % 2**64)).astype(np.int64)
        return [None] * self.unknown + known.tolist()


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, most_ids: int = 8_000_000) -> DataFrame:
    """Encode ``text`` and write shards under ``folder`` in ascending ``doc_id`` order; returns the written manifest.

    Manifest: ``shard`` (its order), ``path``, ``n_docs``, ``n_ids``, ``first_id`` (ids in all shards before it), one row
    a shard. A range shuffle orders the documents; a shard ends after ``most_ids`` ids. A task that runs again writes new
    files, and only the files of finished tasks get into the manifest.

    Defined results: a null text is empty (only the end id); null ids come first; rows that repeat an id are ordered by
    text digest; an empty table gives an empty manifest; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").withColumn("_by", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_by").sortWithinPartitions("doc_id", "_by").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        # Model and words stay for this stage: a task's new words are most of its time, and the next one has many of them.
        kept, key = stage_cache(), ("encoder", vocabulary, end_id)
        encoder = kept.get(key) or kept.setdefault(key, WordEncoder(vocabulary, end_id))
        system, root = open_fs(folder)
        system.create_dir(root, recursive=True)
        doc_ids, counts, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{root}/{part:06d}-{piece:04d}-{uuid.uuid4().hex}.tok"
            with system.open_output_stream(name) as out:
                for data in shard_bytes(doc_ids, np.concatenate(counts), ids):
                    out.write(data)
            uri = f"{folder.rstrip('/')}/{name.rpartition('/')[2]}"
            return pa.RecordBatch.from_pydict({"part": [part], "piece": [piece], "path": [uri], "n_docs": [len(doc_ids)], "n_ids": [held]})

        for batch in batches:
            # About half a megabyte of text at a time, less for small shards: each call passes over the arrays of all remembered words.
            step = max(1, min(500, min(500_000, most_ids) * batch.num_rows // max(1, batch.column(1).nbytes)))
            for first in range(0, batch.num_rows, step):
                some = batch.slice(first, step)
                new, sizes = encoder.encode(some.column(1).to_pylist())
                doc_ids += some.column(0).to_pylist()
                counts.append(sizes)
                ids.append(new.astype(np.uint16) if not len(new) or int(new.max()) < 65536 else new)
                held += len(new)
                if held >= most_ids:
                    yield flush()
                    doc_ids, counts, ids, held, piece = [], [], [], 0, piece + 1
        if doc_ids:
            yield flush()

    made = cut(rows.mapInArrow(returning_memory(write), "part long, piece long, path string, n_docs long, n_ids long"), "token-shards")
    order = Window.orderBy("part", "piece")
    before = F.sum("n_ids").over(order) - F.col("n_ids")
    numbered = made.select((F.row_number().over(order) - 1).alias("shard"), "path", "n_docs", "n_ids", before.alias("first_id"))
    return cut(numbered, "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, shard, start, n_tokens, ids_crc32`` of every document, read back from the shard files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                ends = shard.ends.values()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                doc_ids = shard.doc_ids()
                for first in range(0, shard.n, 2000):
                    some = slice(first, min(first + 2000, shard.n))
                    at = int(starts[some][0])
                    ids = memoryview(shard.ids(at, int(ends[some][-1])).tobytes())
                    sums = [zlib.crc32(ids[4 * (a - at) : 4 * (b - at)]) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids[some], pa.int64()), pa.array([row["shard"]] * len(sums), pa.int32()),
                            pa.array(starts[some] + row["first_id"]), pa.array((ends - starts)[some]), pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
                    )

    shards = manifest.repartition(max(1, manifest.count()), "path").select("path", "shard", "first_id")
    return shards.mapInArrow(returning_memory(read), "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")


def token_rows(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the documents as shards (under ``folder``, default a fresh shared one) and read them back."""
    spark = docs.sparkSession
    return read_shards(write_shards(docs, vocabulary, folder or scratch_path(spark, "tokens"), end_id))
