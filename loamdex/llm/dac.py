"""Token ids in directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id; a bitmap says which ids go
on, and their next chunks make up level 1, and so on. With counts of set bits before every block of the bitmap
(the rank directory) any single id is read by one step a level, without decoding its neighbours.

A segment is a self-contained file image: magic, counts, then each level's bitmap, rank directory and chunks.
Segments are the binary column of a Parquet table, whose rows also say which documents a segment holds, so that
any store that Spark can write serves, and lost tasks leave nothing behind.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamdex.llm import text as T

MAGIC = b"DAC1"
CHUNK_BITS = 8
#: Bits of a bitmap between two entries of its rank directory.
RANK_EVERY = 512
#: Ids after which a segment is closed; documents stay whole.
SEGMENT_IDS = 1 << 20
#: Parts of text whose ids a task remembers before it starts anew.
REMEMBERED = 600_000
END_ID = 2

SEGMENTS = "shard int, seq int, doc_ids array<long>, n_tokens array<long>, ids long, payload binary"


def encode(ids: np.ndarray) -> bytes:
    """A segment's bytes for unsigned 32-bit ids."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        goes_on = rest >= (1 << CHUNK_BITS)
        levels.append((len(rest), np.packbits(goes_on, bitorder="little"), _directory(goes_on), (rest & 0xFF).astype(np.uint8)))
        if not goes_on.any():
            break
        rest = rest[goes_on] >> CHUNK_BITS
    head = MAGIC + struct.pack("<II", len(levels), RANK_EVERY) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(part.tobytes() for _, *parts in levels for part in parts)


def _directory(bits: np.ndarray) -> np.ndarray:
    blocks = -(-len(bits) // RANK_EVERY)
    ones = np.add.reduceat(bits, np.arange(blocks) * RANK_EVERY, dtype=np.int64) if blocks else np.zeros(0, np.int64)
    return (np.cumsum(ones) - ones).astype("<u4")


class Reader:
    """Random access to a segment's ids."""

    def __init__(self, payload: bytes | pa.Buffer):
        payload = memoryview(payload)
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        count, self.every = struct.unpack_from("<II", payload, 4)
        sizes = struct.unpack_from(f"<{count}Q", payload, 12)
        at, self.levels = 12 + 8 * count, []
        for n in sizes:
            bitmap, ranks = -(-n // 8), 4 * -(-n // self.every)
            self.levels.append(
                (
                    np.frombuffer(payload, np.uint8, bitmap, at),
                    np.frombuffer(payload, "<u4", ranks // 4, at + bitmap),
                    np.frombuffer(payload, np.uint8, n, at + bitmap + ranks),
                )
            )
            at += bitmap + ranks + n
        self.size = sizes[0]

    def at(self, i: int) -> int:
        """The id at place ``i``: a chunk, a bit and a rank on each level that the id reaches."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level, (bitmap, ranks, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                return value
            block = i // self.every
            between = bitmap[block * self.every // 8 : byte]
            i = int(ranks[block]) + int(np.bitwise_count(between).sum()) + (int(bitmap[byte]) & ((1 << bit) - 1)).bit_count()
        raise ValueError("the last level goes on")

    def all(self) -> np.ndarray:
        """Every id, in order."""
        out = np.zeros(self.size, np.uint32)
        place = np.arange(self.size)
        for level, (bitmap, _, chunks) in enumerate(self.levels):
            out[place] |= chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            place = place[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out


#: Where an ASCII letter meets an ASCII mark other than an apostrophe, this tokenizer's words always end.
_CUTS = (("\n", " "), (r"([a-z])([!-&(-/:-@\[-`{-~])", r"\1 \2"), (r"([!-&(-/:-@\[-`{-~])([a-z])", r"\1 \2"))


class Rows:
    """Remembered id lists by their text."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, keys: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        begin = len(self.place)
        self.place.update(zip(keys, range(begin, begin + len(keys))))
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])

    def get(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the given rows one after another, their sizes)."""
        n, first = self.sizes[place], (np.cumsum(self.sizes) - self.sizes)[place]
        upto = np.cumsum(n)
        return self.ids[np.arange(upto[-1] if len(n) else 0) + np.repeat(first - upto + n, n)], n


class Encoder:
    """Ids of whole texts. Text is cut at blanks, which the tokenizer drops, and between letters and marks; each distinct
    part is encoded once and remembered. ``direct`` encodes every text as one instead."""

    def __init__(self, file: str, direct: bool = False):
        self.tokenizer = Tokenizer.from_file(file)
        self.direct = direct
        self.known = Rows()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in made for i in x), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone are encoded many to a line, as each ends with the only id that closes a word."""
        plain = [w.isalpha() and (w.isascii() or w.lower().isalpha()) for w in words]
        lines = [w for w, p in zip(words, plain) if p]
        ids, _ = self._whole(["\n".join(lines[i : i + 1000]) for i in range(0, len(lines), 1000)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(lines):
            raise ValueError("this tokenizer doesn't close every word; encode with direct=True")
        self.known.add(lines, np.diff(stops, prepend=0), ids)
        rest = [w for w, p in zip(words, plain) if not p]
        ids, sizes = self._whole(rest)
        self.known.add(rest, sizes, ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.direct:
            return self._whole(texts.to_pylist())
        # a text that may hold one of the tokenizer's special strings is encoded as one
        special = pc.match_substring(texts, "<|")
        cut = pc.if_else(special, "", texts)
        cut = pc.ascii_lower(cut)
        for find, put in _CUTS:
            cut = pc.replace_substring_regex(cut, find, put)
        cut = pc.split_pattern(cut, " ")
        flat = cut.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        if len(self.known.place) > REMEMBERED:
            self.known = Rows()
        if fresh := [w for w in words if w not in self.known.place]:
            self._learn(fresh)
        place = np.fromiter(map(self.known.place.__getitem__, words), np.int64, len(words))
        ids, n = self.known.get(place[flat.indices.to_numpy()])
        offsets = cut.offsets.to_numpy()
        sizes = np.diff(np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]])
        whole = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        if len(whole):
            more, own = self._whole(texts.take(pa.array(whole)).to_pylist())
            ids = np.insert(ids, np.repeat((np.cumsum(sizes) - sizes)[whole], own), more)
            sizes[whole] = own
        return ids, sizes


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(file: str, direct: bool = False) -> Encoder:
    """This process's encoder; what it remembers serves later tasks too."""
    if (file, direct) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[file, direct] = Encoder(file, direct)
    return _encoders[file, direct]


def write(docs: DataFrame, file: str, path: str, end_id: int = END_ID, order: tuple[str, ...] = ("doc_id",), direct: bool = False) -> None:
    """Encode every whole text of ``docs`` and write segments to ``path`` in ascending order of ``order``.

    Each document's ids end with ``end_id``; a null or empty text has that id alone. Repeated ids of documents
    are written one after another, by text. Other columns are left out. An empty table writes no segment.
    """
    doc_id, keys = F.col("doc_id").cast("long").alias("doc_id"), [F.col(c) for c in order]
    rows = docs.select(doc_id, "text", *[c for c in order if c not in ("doc_id", "text")])
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "doc_id", "text").select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, own = TaskContext.get().partitionId(), 0, encoder(file, direct)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def segment() -> pa.RecordBatch:
            docs_of = [d for x in held for d in x[0]]
            counts = np.concatenate([x[1] for x in held])
            ids = np.concatenate([x[2] for x in held])
            columns = [
                pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([docs_of], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([encode(ids)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["shard", "seq", "doc_ids", "n_tokens", "ids", "payload"])

        for part, _ in T.steps(batches, size=1 << 22):
            ids, n = own.encode(part.column("text"))
            ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
            held.append((part.column("doc_id").to_pylist(), n + 1, ids))
            size += len(ids)
            if size >= SEGMENT_IDS:
                yield segment()
                held, size, seq = [], 0, seq + 1
        if held:
            yield segment()

    dealt.mapInArrow(run, SEGMENTS).write.parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, seq, ids, begin) of every segment, ``begin`` being the number of ids before it: sums of shards first, then within each shard."""
    slim = spark.read.schema(SEGMENTS).parquet(path).select("shard", "seq", "ids")
    shards = slim.groupBy("shard").agg(F.sum("ids").alias("own"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    shards = shards.select("shard", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return slim.join(shards, "shard").select("shard", "seq", "ids", (F.col("before") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("begin"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the written segments.

    Segments are decoded where they are read; only a row a document meets the segments' offsets. Repeated or null
    ids give the rows that were written, and files without segments none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = Reader(batch.column("payload")[row].as_buffer()).all().astype("<u4")
                n = np.array(batch.column("n_tokens")[row].as_py(), np.int64)
                end = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((end - n).tolist(), end.tolist())]
                own = [pa.array(np.full(len(n), batch.column(c)[row].as_py(), np.int32)) for c in ("shard", "seq")]
                yield pa.RecordBatch.from_arrays([*own, batch.column("doc_ids")[row].values, pa.array(end - n), pa.array(n), pa.array(crc, pa.int64())], ["shard", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SEGMENTS).parquet(path).select("shard", "seq", "doc_ids", "n_tokens", "payload")
    decoded = rows.mapInArrow(run, "shard int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return decoded.join(starts(spark, path), ["shard", "seq"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place, id) for each distinct place of the whole sequence in ``places``; null places and those outside it give no row.

    A place finds its segment by a bucket of the sequence. A segment's places are gathered, no more than it has
    ids, so that its payload is moved once at most, and only where it is asked for.
    """
    step = SEGMENT_IDS
    at = lambda c: F.floor(c / step)
    found = starts(spark, path).filter("ids > 0").withColumn("bucket", F.explode(F.sequence(at(F.col("begin")), at(F.col("begin") + F.col("ids") - 1))))
    wanted = places.select(F.col("place").cast("long").alias("place")).distinct().withColumn("bucket", at(F.col("place")))
    joined = wanted.join(found, "bucket").filter("place >= begin and place < begin + ids")
    listed = joined.groupBy("shard", "seq").agg(F.collect_list(F.struct("place", (F.col("place") - F.col("begin")).alias("local"))).alias("places"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                reader, asked = Reader(batch.column("payload")[row].as_buffer()), batch.column("places")[row].values
                ids = [reader.at(i) for i in asked.field("local").to_pylist()]
                yield pa.RecordBatch.from_arrays([asked.field("place"), pa.array(ids, pa.int64())], ["place", "id"])

    rows = spark.read.schema(SEGMENTS).parquet(path).select("shard", "seq", "payload")
    return rows.join(listed, ["shard", "seq"]).select("places", "payload").mapInArrow(run, "place long, id long")
