"""Token ids in directly addressable codes.

A segment holds the ids of consecutive documents. An id is cut into chunks of 8 bits, lowest first. Level 0 has the first chunk
of every id and a bitmap that tells which ids go on; level 1 has the second chunk of those ids, and so on. A rank directory
(number of ones before every 512th bit) finds an id's place in the next level, so ``Segment.at(i)`` reads one token with one
chunk, one bit and one rank for each level, without decoding its neighbours.

Files: a Parquet table in the shared folder with one row for each segment (order, ids before it in its range, documents, payload). Spark
commits it as a whole, any reader finds a segment by its order, and the place of a document by its segment's directory. Segments hold
at most ``SEGMENT_IDS`` ids, unless one document has more. A segment's place in the whole is its place in its range after the ranges
before, of which there are ``MOST_RANGES`` at most: that is all that the driver adds up.

Defined cases: null is the empty text and still gets the end id; ids of repeated doc_ids follow in order of the crc32 of their text, then
of the ids' bytes; a doc_id that fills several ranges is dealt to them in that order; a null doc_id comes first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.bpe import Words, id_code, packed_ids, tokenizer_path
from logloom.llm.common import documents, id_and_bytes, rows_to_batch, slices, written

SEGMENT_IDS = 1 << 20
#: Words that a task's table holds before it starts anew; an entry is a few bytes here.
KEPT_WORDS = 600_000
#: Documents in one range of doc_ids, which one task puts in order.
RANGE_DOCS = 2_000
#: Ranges there are at most; beyond, a range has more documents.
MOST_RANGES = 10_000
END_ID = 2
RANK = 512
SEGMENTS = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def pack(ids: np.ndarray) -> bytes:
    """Levels of chunks, each with its bitmap and rank directory."""
    left = ids
    out = []
    while True:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        each = np.add.reduceat(more, np.arange(0, len(left), RANK), dtype=np.int64) if len(left) else np.zeros(0, np.int64)
        ones = (np.cumsum(each) - each).astype("<u4")
        out.append(struct.pack("<III", len(left), len(bits), len(ones)) + (left & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ones.tobytes())
        left = left[more] >> 8
        if not len(left):
            return struct.pack("<I", len(out)) + b"".join(out)


class Segment:
    """Reads what ``pack`` wrote."""

    def __init__(self, data: bytes):
        (levels,) = struct.unpack_from("<I", data)
        at = 4
        self.levels = []
        for _ in range(levels):
            n, bits, ones = struct.unpack_from("<III", data, at)
            at += 12
            self.levels.append((np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, bits, at + n), np.frombuffer(data, "<u4", ones, at + n + bits)))
            at += n + bits + 4 * ones

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, i: int) -> int:
        """One id, by rank."""
        value = shift = 0
        for chunks, bits, ones in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK
            whole = bits[block * RANK // 8 : i >> 3]
            i = int(ones[block]) + int(np.bitwise_count(whole).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        out, where = self.levels[0][0].astype("<u4"), None
        for level, (chunks, bits, _) in enumerate(self.levels):
            if level:
                out[where] |= chunks.astype(np.uint32) << (8 * level)
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            where = where[more] if level else more
        return out


def ranges(docs: DataFrame, each: int = RANGE_DOCS) -> list[int]:
    """Bounds that cut the doc_ids into ranges of about ``each`` documents; reads the id column only. A frequent id is several bounds."""
    n = docs.count()
    parts = min(MOST_RANGES, max(1, -(-n // each)))
    if parts == 1:
        return []
    found = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    return sorted(found or [])


def range_of(bounds: np.ndarray, doc_id: int | None, text: int) -> int:
    """The range of a document, of which ``text`` is the crc32 of its text: an id that is several bounds has several ranges."""
    if doc_id is None:
        return 0
    low, high = np.searchsorted(bounds, doc_id, "left"), np.searchsorted(bounds, doc_id, "right")
    return int(low + (text * int(high - low + 1) >> 32))


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID, each: int = RANGE_DOCS) -> DataFrame:
    """Encodes ``docs``, puts the ids in order of doc_id and writes segments; returns the table as read back.

    Ids (2 bytes each if the vocabulary allows) are the only thing that is shuffled, by range of doc_id.
    """
    path = path or tokenizer_path()
    bounds = docs.sparkSession.sparkContext.broadcast(np.array(ranges(docs, each), np.int64))
    code = id_code(path, end_id)
    kind = "<u2" if code == "H" else "<u4"
    encoded = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("raw", pa.int64()), ("ids", pa.binary())])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words(path, packed_ids(code), bytes.__add__, limit=KEPT_WORDS)
        end = np.array([end_id], kind).tobytes()
        for doc_ids, texts in slices(batches, ("doc_id", "text")):
            sums = [zlib.crc32(t) for t in texts]
            yield rows_to_batch([(range_of(bounds.value, d, c), d, c, b"".join(map(table.lookup(), t.split())) + end) for d, c, t in zip(doc_ids, sums, texts, strict=True)], encoded)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, held, size = None, 0, 0, [], 0

        def flush():
            lengths = [len(x) // int(kind[-1]) for _, x in held]
            names, none = np.array([d or 0 for d, _ in held], "<i8"), np.array([d is None for d, _ in held])
            body = pack(np.frombuffer(b"".join(x for _, x in held), kind))
            payload = names.tobytes() + np.array(lengths, "<i8").tobytes() + none.tobytes() + body
            return rows_to_batch([(part, seq, before, len(held), sum(lengths), payload)], SEGMENTS)

        for parts, doc_ids, binaries in slices(batches, ("part", "doc_id", "ids")):
            for p, d, x in zip(parts, doc_ids, binaries, strict=True):
                n = len(x) // int(kind[-1])
                if held and (p != part or size + n > SEGMENT_IDS):
                    yield flush()
                    seq, before = (seq + 1, before + size) if p == part else (0, 0)
                    held, size = [], 0
                part = p
                held.append((d, x))
                size += n
        if held:
            yield flush()

    rows = id_and_bytes(docs).mapInArrow(ids, "part long, doc_id long, raw long, ids binary")
    rows = rows.repartition("part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "raw", "ids")
    return written(rows.mapInArrow(segments, "part long, seq long, before long, n_docs long, n_ids long, payload binary"), "ids", "none")


def starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each range, from the directory: one number for each of at most ``MOST_RANGES`` ranges."""
    at = 0
    out = {}
    for part, n in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():
        out[part] = at
        at += n
    return out


def read_ids(segments: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens and crc32 of its ids, from the files."""
    before = segments.sparkSession.sparkContext.broadcast(starts(segments))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, _, within, n_docs, _, payload = (batch.column(c)[i].as_py() for c in range(6))
                names = np.frombuffer(payload, "<i8", n_docs)
                lengths = np.frombuffer(payload, "<i8", n_docs, 8 * n_docs)
                none = np.frombuffer(payload, bool, n_docs, 16 * n_docs)
                ids = Segment(payload[17 * n_docs :]).all()
                ends = np.cumsum(lengths)
                first = before.value[part] + within
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64(), mask=none), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], schema=READ
                )

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(documents(spark, sf_dir)))
