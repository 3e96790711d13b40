"""Documents cut into blocks of words: what is learned about a word travels by distinct word of a block, never by token.

A block is some consecutive documents of a task with about ``size`` words together. Its different words are numbered, and its
documents are sequences of those numbers. Three steps join a word's data back by position:

1. ``requests``: each block sends its different words to their parts (by hash), one row for each part, and its documents' positions to
   itself.
2. A part answers every request in the request's order (``answered``); the positions pass through.
3. A block's answers meet its positions (``met``), sorted so that answers come first.

A word is in a request once for each block, however often the corpus repeats it, so no word makes a part heavy. Requests and
positions are compressed arrays. All rows are ordinary shuffled rows: what a lost executor held is made again by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from logloom.llm.common import LOWER, slices

#: Words in a block, about; a document of more is a block of its own.
BLOCK_WORDS = 3_000_000
#: Bytes of input (as Spark estimates them) for each part.
PART_BYTES = 8 << 20
MOST_PARTS = 1 << 16
#: Spark's estimate where it has none is larger.
UNKNOWN_BYTES = 1 << 60
#: Words in one row of positions.
POSITIONS_WORDS = 1 << 17
#: Kinds of rows, in the order in which a block gets them. What a part has to say about itself is passed on as a total.
TOTAL, MORE, REQUEST, POSITIONS, LAST = -2, -1, 0, 1, 2
ROWS = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
ROWS_SQL = "key long, block long, part int, kind int, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types, compressed; the bytes of wide numbers are laid out plane by plane."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), a.nbytes))], "<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).tolist()
    out, at = [], 8 + 16 * n
    for kind, size in zip(head[::2], head[1::2], strict=True):
        dtype = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size
    return out


def small(x: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in as few bytes as hold them."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def parts_for(docs: DataFrame) -> int:
    """Number of parts: the session's shuffle partitions, or more if the input is large."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < UNKNOWN_BYTES)
    return min(MOST_PARTS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES))


class Numbers(dict):
    """Words to numbers, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Block:
    """Documents' other columns, their sizes in words, the different words and every word's number."""

    def __init__(self, rows: list[tuple], sizes: list[int], words: list[bytes], at: np.ndarray):
        self.rows, self.sizes, self.words, self.at = rows, np.array(sizes, np.int64), words, at
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def renumbered(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words in the order that a block's answers restore: frequent words first (by power of two), within them by part.

        Returns that order, each word's part and its class in it; ``at`` follows. Frequent words get small numbers, which pack well.
        """
        uses = np.bincount(self.at, minlength=len(self.words))
        kind = 63 - np.floor(np.log2(np.maximum(uses, 1))).astype(np.uint8)
        part = (self.hashes % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((part, kind))
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        self.at = number[self.at]
        self.words = [self.words[i] for i in order.tolist()]
        self.hashes = self.hashes[order]
        return order, part[order], kind[order]


def blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], size: int = BLOCK_WORDS, lower: bool = False) -> Iterator[Block]:
    """Blocks of the rows of ``batches``, whose column ``text`` is bytes; ``columns`` are carried."""
    numbers, rows, sizes, at, n = Numbers(), [], [], [], 0
    for raws, *more in slices(batches, ("text", *columns)):
        for raw, *row in zip(raws, *more, strict=True):
            words = (raw.translate(LOWER) if lower else raw).split()
            at.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            rows.append(tuple(row))
            sizes.append(len(words))
            n += len(words)
            if n >= size:
                yield Block(rows, sizes, [*numbers], np.concatenate(at))
                numbers, rows, sizes, at, n = Numbers(), [], [], [], 0
    if rows:
        yield Block(rows, sizes, [*numbers], np.concatenate(at))


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every part with the places that belong to it, in their order."""
    part = part.astype(np.uint16)  # as few bits as MOST_PARTS needs are sorted by radix
    order = np.argsort(part, kind="stable")
    cuts = [0, *(np.flatnonzero(part[order][1:] != part[order][:-1]) + 1).tolist(), len(order)] if len(order) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(part[order[a]]), order[a:b]


def restored(kinds: list[np.ndarray]) -> np.ndarray:
    """Order by which the parts' answers, one part after another, become the block's words."""
    return np.argsort(np.concatenate(kinds), kind="stable") if kinds else np.zeros(0, np.int64)


def requests(docs: DataFrame, columns: tuple[str, ...], parts: int, ask: Callable, size: int = BLOCK_WORDS, lower: bool = False) -> DataFrame:
    """Step 1. ``ask(block, parts)`` yields (part, kind, payload) for the parts; what a block keeps for itself follows as ``LAST``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in blocks(batches, columns, size, lower):
            for part, kind, payload in ask(block, parts):
                yield batch_of([(number + part if kind == LAST else part, number, part, kind, payload)])
            for k, (a, b) in enumerate(chunks(len(block.at), POSITIONS_WORDS)):
                yield batch_of([(number + k, number, k, POSITIONS, pack(block.at[a:b]))])
            number += 1

    return docs.mapInArrow(run, ROWS_SQL)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)


def answered(asked: DataFrame, parts: int, run: Callable) -> DataFrame:
    """Step 2, ``run`` over the rows of each part."""
    return asked.repartition(parts, "key").mapInArrow(run, ROWS_SQL)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in range(5))


def together(answers: DataFrame, parts: int) -> DataFrame:
    """Step 3: a block's answers, by part, then its positions."""
    return answers.repartition(parts, "block").sortWithinPartitions("block", "kind", "part")


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple] | None, list[np.ndarray]]]:
    """Number, unpacked answers (kind, part, arrays) and own arrays of every block, the last of which are its positions. Totals have no answers."""
    answers: list[tuple] = []
    at: list[np.ndarray] = []
    for _, block, part, kind, payload in rows_of(batches):
        if kind == TOTAL:
            yield block, None, unpack(payload)
        elif kind == LAST:
            yield block, answers, [*unpack(payload), np.concatenate(at) if at else np.zeros(0, np.uint32)]
            answers, at = [], []
        elif kind == POSITIONS:
            at += unpack(payload)
        else:
            answers.append((kind, part, unpack(payload)))


def chunks(n: int, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


def sequences(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The values of the words ``at``, one after another, in pieces of bounded size."""
    for a, b in chunks(len(at)):
        some = lengths[at[a:b]]
        ends = np.cumsum(some)
        total = int(ends[-1])
        yield values[np.repeat(starts[at[a:b]] - (ends - some), some) + np.arange(total)]

