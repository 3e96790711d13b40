"""Language-model scoring by deleted interpolation.

A token's probability mixes maximum-likelihood estimates of order two, one and zero:

    p(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1)

where b is the bucket of the context's frequency c(v), a power of two. The weights of each bucket are learned by
expectation-maximisation on deleted (held-out) counts: every training token is taken out of the counts that predict it. Unknown words
share one outcome, so the probabilities of all outcomes sum to one. Every word is a context of its own, whatever its frequency.

How it runs, with counts over all training documents:
1. Texts are cut into blocks (``blocks``). A block sums its own counts first and sends each of its different words and word pairs once
   to the part that owns it, so a pair with a large share of all tokens is one number for each block, not a row for each token.
2. A part adds up its words and pairs over all blocks and answers each block in its own order.
3. A block's answers meet its documents' positions and are kept as a table: from here on tokens know their counts.
4. The weights are fitted on a histogram of the deleted estimates by bucket (its size doesn't depend on the input; an estimate differs
   from its cell's mean by a factor of 2 ** (1 / BINS) at most), and the same table gives each document's sums.

Only N, V, the number of documents and the weights are sent to every worker. Words are told apart by 64-bit hashes, pairs by 56 bits of a
hash of both and by the part that they fall to.

Defined cases: null and empty texts are one end token; without training documents every word is unknown; repeated rows repeat
their result; a null doc_id counts as the empty text in the fold; a context without training tokens leaves the lower orders.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import blocks as B
from logloom.llm.common import documents, fold, id_and_bytes, written

BLOCK_WORDS, EM_STEPS, BINS = 2_000_000, 60, 8
#: Bucket of a text's beginning, and the bin of an estimate that is zero.
BEGIN_BUCKET, ZERO_BIN = 63, 1023
#: Odd factors and marks of the beginning and the end in the hash of a pair.
MIX_V, MIX_W, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
COUNTED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("tokens", pa.int64()), ("words", pa.int64()), ("docs", pa.int64()), ("payload", pa.binary())])
COUNTED_SQL = "block long, kind int, tokens long, words long, docs long, payload binary"
CELLS = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("log2", pa.float64()), ("log1", pa.float64())])
OUT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


@dataclass(frozen=True)
class Totals:
    """Training tokens (with the ends), different ones, and documents."""

    tokens: int
    distinct: int
    docs: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))


class Tokens:
    """A block's tokens: word (its number, or ``ends`` for an end), context (or ``ends`` for a beginning), document and pair."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, words: int):
        self.ends, n = words, len(sizes)
        last = np.cumsum(sizes + 1) - 1
        self.word = np.empty(len(at) + n, np.int64)
        inner = np.ones(len(self.word), bool)
        inner[last] = False
        self.word[inner], self.word[last] = at, words
        self.doc = np.repeat(np.arange(n), sizes + 1)
        context = np.empty_like(self.word)
        context[:1], context[1:] = words, self.word[:-1]
        context[last[:-1] + 1] = words
        self.codes, self.pair = np.unique(context * (words + 1) + self.word, return_inverse=True)

    @property
    def first(self) -> np.ndarray:
        """Context of each different pair."""
        return self.codes // (self.ends + 1)

    @property
    def second(self) -> np.ndarray:
        return self.codes % (self.ends + 1)


def pair_parts(tokens: Tokens, short: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair, from 16 bits of either word's hash, which a block keeps."""
    of = np.append(short, np.uint16(0)).astype(np.uint64)
    mixed = of[tokens.first] * MIX_V + of[tokens.second] * MIX_W
    return ((mixed ^ mixed >> np.uint64(31)) * MIX >> np.uint64(33)) % np.uint64(parts)


def pair_keys(tokens: Tokens, hashes: np.ndarray) -> np.ndarray:
    mixed = np.append(hashes, BEGIN)[tokens.first] * MIX_V + np.append(hashes, END)[tokens.second] * MIX_W
    mixed = (mixed ^ mixed >> np.uint64(31)) * MIX
    return (mixed ^ mixed >> np.uint64(29)) >> np.uint64(8)


def ask(block: B.Block, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """A block's different words and pairs with their numbers in training documents, and what tells its documents."""
    _, part, kind = block.renumbered(parts)
    ids, held = zip(*block.rows, strict=True)
    tokens = Tokens(block.sizes, block.at, len(block.words))
    train = ~np.array(held, bool)[tokens.doc]
    uses = np.bincount(tokens.word[train], minlength=tokens.ends + 1)
    for p, places in B.by_part(part):
        yield p, B.REQUEST, B.pack(kind[places], block.hashes[places], B.small(uses[places]))
    short = (block.hashes & np.uint64(0xFFFF)).astype(np.uint16)
    keys, uses = pair_keys(tokens, block.hashes), np.bincount(tokens.pair[train], minlength=len(tokens.codes))
    for p, places in B.by_part(pair_parts(tokens, short, parts)):
        yield p, B.MORE, B.pack(keys[places], B.small(uses[places]))
    yield 0, B.LAST, B.pack(np.array([d or 0 for d in ids], np.int64), np.array([d is None for d in ids]), np.array(held, bool), block.sizes, short)


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts' words and pairs over all blocks. A part has each of a block's words and pairs once."""
    mine: dict[tuple[int, int], list[tuple[int, bytes]]] = defaultdict(list)
    for key, block, part, kind, payload in B.rows_of(batches):
        if kind in (B.REQUEST, B.MORE):
            mine[kind, part].append((block, payload))
        else:
            yield B.batch_of([(key, block, part, kind, payload)])
    while mine:
        (kind, part), rows = mine.popitem()
        got = [B.unpack(x) for _, x in rows]
        which, different = pd.factorize(np.concatenate([x[-2] for x in got]))
        total = np.bincount(which, np.concatenate([x[-1] for x in got]), minlength=len(different)).astype(np.int64)
        if kind == B.REQUEST:
            yield B.batch_of([(part, rows[0][0], part, B.TOTAL, B.pack(np.array([np.count_nonzero(total)])))])
        cuts = np.cumsum([len(x[-1]) for x in got])[:-1]
        for (block, _), x, counts in zip(rows, got, np.split(total[which], cuts), strict=True):
            yield B.batch_of([(part, block, part, kind, B.pack(*x[:-2], B.small(counts)))])


def counted(docs: DataFrame, size: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of documents with the counts of their words and pairs, and in ``tokens``, ``words`` and ``docs`` what adds up to the totals."""
    parts = B.parts_for(docs)
    source = id_and_bytes(docs, (fold(7) == 2).alias("held_out"))
    asked = B.requests(source, ("doc_id", "held_out"), parts, ask, size, lower=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers, arrays in B.by_block(batches):
            if answers is None:
                yield row_of((block, B.TOTAL, 0, int(arrays[0][0]), 0, b""))
                continue
            ids, none, held, sizes, short, at = arrays
            words, pairs = ([x for k, _, x in answers if k == kind] for kind in (B.REQUEST, B.MORE))
            of_word = np.concatenate([n for _, n in words]).astype(np.int64)[B.restored([k for k, _ in words])] if words else np.zeros(0, np.int64)
            tokens = Tokens(sizes, at, len(of_word))
            of_pair = np.empty(len(tokens.codes), np.int64)
            of_pair[np.argsort(pair_parts(tokens, short, parts).astype(np.uint16), kind="stable")] = np.concatenate([n for (n,) in pairs])
            payload = B.pack(ids, none, held, sizes, B.small(of_word), B.small(of_pair), at)
            yield row_of((block, B.LAST, int((sizes + 1)[~held].sum()), 0, int((~held).sum()), payload))

    return B.together(B.answered(asked, parts, added), parts).mapInArrow(run, COUNTED_SQL)


def row_of(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, COUNTED, strict=True)], schema=COUNTED)


def totals(table: DataFrame) -> Totals:
    n, v, d = table.agg(F.sum("tokens"), F.sum("words"), F.sum("docs")).first()
    return Totals(n or 0, (v or 0) + bool(d), d or 0)


class Counts:
    """A block of ``counted``, unpacked: counts of each word (then of the end) and of each different pair, its context and its word."""

    def __init__(self, payload: bytes, all_of: Totals):
        self.ids, self.none, self.held, self.sizes, words, pairs, at = B.unpack(payload)
        self.tokens = Tokens(self.sizes, at, len(words))
        self.word = np.append(words.astype(np.int64), all_of.docs)
        self.pair = pairs.astype(np.int64)
        first = self.tokens.first
        self.context, self.target = self.word[first], self.word[self.tokens.second]
        self.bucket = np.where(first == self.tokens.ends, BEGIN_BUCKET, np.log2(np.maximum(self.context, 1)).astype(np.int64))


def histogram(table: DataFrame, all_of: Totals) -> pd.DataFrame:
    """Deleted estimates of all training tokens, by bucket and by (quantised) size of either estimate: tokens and sums of logarithms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                c = Counts(payload.as_py(), all_of)
                n = np.bincount(c.tokens.pair[~c.held[c.tokens.doc]], minlength=len(c.pair))
                some = n > 0
                n = n[some]
                f2 = np.log2(c.pair[some] - 1 + 1e-300) - np.log2(np.maximum(c.context[some] - 1, 1))
                f1 = np.log2(c.target[some] - 1 + 1e-300) - np.log2(max(all_of.tokens - 1, 1))
                bins = [np.where(f > -100, np.floor(-f * BINS), ZERO_BIN).astype(np.int64) for f in (f2, f1)]
                which, cell = pd.factorize((c.bucket[some] * 1024 + bins[0]) * 1024 + bins[1])
                sums = [np.bincount(which, w, minlength=len(cell)) for w in (n, n * f2, n * f1)]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=CELLS)

    rows = table.where(F.col("kind") == B.LAST).select("payload").mapInArrow(run, "cell long, n long, log2 double, log1 double")
    return rows.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("log2").alias("log2"), F.sum("log1").alias("log1")).toPandas()


def weights(cells: pd.DataFrame, all_of: Totals) -> np.ndarray:
    """(64, 3) mixture weights of orders two, one and zero, by expectation-maximisation on the deleted estimates."""
    out = np.tile([0.0, 0.9, 0.1], (64, 1))
    cell, n = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float)
    zero = [(cell >> s & 1023) == ZERO_BIN for s in (10, 0)]
    f2, f1 = (np.where(z, 0, np.exp2(cells[c].to_numpy(float) / np.maximum(n, 1))) for z, c in zip(zero, ("log2", "log1"), strict=True))
    for b in np.unique(cell >> 20):
        here = cell >> 20 == b
        out[b] = mixed(np.stack((f2[here], f1[here], np.full(int(here.sum()), 1 / (all_of.distinct + 1))), 1), n[here])
    return out


def mixed(terms: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``terms`` that make tokens (``n`` of each row) likeliest."""
    now = np.array([0.4, 0.4, 0.2])
    for _ in range(EM_STEPS):
        post = terms * now
        now = (n[:, None] * post / post.sum(1, keepdims=True)).sum(0) / n.sum()
    return np.maximum(now, 1e-6) / np.maximum(now, 1e-6).sum()


def scores(table: DataFrame, all_of: Totals, mix: np.ndarray) -> DataFrame:
    """Rows of the result, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                c = Counts(payload.as_py(), all_of)
                lam = mix[c.bucket]
                lam = np.where((c.context > 0)[:, None], lam, lam * [0, 1, 1] / lam[:, 1:].sum(1, keepdims=True))
                p = lam[:, 0] * c.pair / np.maximum(c.context, 1) + lam[:, 1] * c.target / max(all_of.tokens, 1) + lam[:, 2] / (all_of.distinct + 1)
                of_doc = lambda x, c=c: np.bincount(c.tokens.doc, x, minlength=len(c.ids))
                base, known = of_doc(all_of.base(c.word)[c.tokens.word]), of_doc(c.word[c.tokens.word] > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, mask=c.none), pa.array(c.held), pa.array(c.sizes + 1), pa.array(known), pa.array(np.full(len(c.ids), all_of.tokens)), pa.array(base), pa.array(of_doc(np.log10(p)[c.tokens.pair]))],
                    schema=OUT,
                )

    rows = table.where(F.col("kind") == B.LAST).select("payload")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def interpolated_lm(docs: DataFrame, size: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    table = written(counted(docs, size), "lm-counts")
    all_of = totals(table)
    return scores(table, all_of, weights(histogram(table, all_of), all_of))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm(documents(spark, sf_dir))
