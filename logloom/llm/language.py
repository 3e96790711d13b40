"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary are the alphabet. A text's words (runs of letters, lower-cased, each with the vocabulary's
word mark in front) are independent, as no piece crosses a word's start; a word's probability in a language is the sum over all its
segmentations of the product of piece probabilities, by the forward algorithm. A text's score adds its words' logarithms and the
language's prior; the best language wins, with its posterior as score.

Piece probabilities are learned by expectation-maximisation (forward-backward over all segmentations) from the word counts of a
bounded sample: ``DOCS`` documents of each language, smallest hash of the id first. Each step runs on the executors over the
distributed word counts and brings back one number for each piece and language. Scoring is one narrow pass; a task keeps a table of
its distinct words, so each word's lattice is summed once.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without a learned language every text is ``und``; ties go
to the language that sorts first; null languages teach nothing; repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import documents, fold, id_and_bytes, rows_to_batch, slices, written

DOCS, STEPS = 1_500, 3
#: Probability of a character that is no piece, and weight of the uniform distribution mixed into every language.
UNKNOWN, FLOOR = 1e-7, 1e-3
KEPT_WORDS, LONG, MARK = 400_000, 40, "▁"
WORD = re.compile(r"[^\W\d_]+")
ROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lattice:
    """All segmentations of words into the vocabulary's pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        usable = sorted({p for p in names if WORD.fullmatch(p.removeprefix(MARK)) and p == p.lower() or p == MARK})
        self.pieces = {p: i for i, p in enumerate(usable)}
        self.size = len(self.pieces) + 1  # the last stands for any other character
        #: Every beginning of a piece: its piece if it is one itself, else -1.
        self.starts = {p[:n]: -1 for p in usable for n in range(1, len(p) + 1)} | self.pieces
        if max(map(len, usable)) >= 1 << 5 or self.size >= 1 << 16:
            raise ValueError("pieces are too long or too many for packed edges")

    def edges(self, word: str, number: int, out: list[int]) -> None:
        """Adds every piece in the marked word to ``out``, packed as end (24 bits), word (13), length (5) and piece (16)."""
        s, starts = MARK + word, self.starts
        n, low = len(s), number << 21
        for i in range(n):
            if starts.get(s[i], -1) < 0:
                out.append((i + 1) << 34 | low | 1 << 16 | self.size - 1)
            for j in range(i + 1, n + 1):
                piece = starts.get(s[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    out.append(j << 34 | low | (j - i) << 16 | piece)

    def batches(self, words: list[str]):
        """Words of like length together: (their places, longest, edge arrays sorted by end and word)."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 4096 and (end - at) * (len(words[order[end]]) + 2) < 200_000:
                end += 1
            places = order[at:end]
            packed: list[int] = []
            for w, k in enumerate(places):
                self.edges(words[k], w, packed)
            rows = np.sort(np.array(packed, np.int64))
            j = rows >> 34
            yield places, len(words[places[-1]]) + 1, j, rows >> 21 & 0x1FFF, j - (rows >> 16 & 0x1F), rows & 0xFFFF
            at = end

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Logarithm of each word's probability in each language: sums over all segmentations, rescaled as they go."""
        out = np.zeros((len(words), probs.shape[1]))
        for places, _, *edges in self.batches(words):
            alpha, shift = self._alpha(len(places), edges, probs)
            ends = np.array([len(words[k]) + 1 for k in places])
            at = np.arange(len(places))
            out[places] = np.log(alpha[at, ends]) + shift[at, ends]
        return out

    @staticmethod
    def _alpha(n: int, edges, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums (n, length + 1, languages) and their logarithmic scale; each place is scaled to a maximum of 1."""
        j, w, i, p = edges
        longest = int(j.max())
        alpha, shift = np.zeros((n, longest + 1, probs.shape[1])), np.zeros((n, longest + 1, probs.shape[1]))
        alpha[:, 0] = 1
        cuts = np.searchsorted(j, np.arange(longest + 2))
        terms = probs[p]
        for end in range(1, longest + 1):
            a, b = cuts[end], cuts[end + 1]
            if a == b:
                continue
            ww, ii = w[a:b], i[a:b]
            first = np.flatnonzero(np.append(True, ww[1:] != ww[:-1]))
            if longest <= LONG:  # too short to underflow
                alpha[ww[first], end] = np.add.reduceat(alpha[ww, ii] * terms[a:b], first)
                continue
            top = np.maximum.reduceat(shift[ww, ii], first)
            size = np.diff(np.append(first, b - a))
            total = np.add.reduceat(alpha[ww, ii] * np.exp(shift[ww, ii] - np.repeat(top, size, 0)) * terms[a:b], first)
            who = ww[first]
            scale = np.where(total > 0, total, 1)
            alpha[who, end], shift[who, end] = total / scale, top + np.log(scale)
        return alpha, shift

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, given (words, languages) counts."""
        out = np.zeros((self.size, probs.shape[1]))
        for places, _, j, w, i, p in self.batches(words):
            alpha, shift = self._alpha(len(places), (j, w, i, p), probs)
            ends = np.array([len(words[k]) + 1 for k in places])
            # Backward sums are forward sums of the reversed lattice.
            rj, ri = ends[w] - i, ends[w] - j
            order = np.lexsort((w, rj))
            beta, beta_shift = self._alpha(len(places), (rj[order], w[order], ri[order], p[order]), probs)
            at = np.arange(len(places))
            whole = np.log(alpha[at, ends]) + shift[at, ends]
            log = shift[w, i] + beta_shift[w, ends[w] - j] - whole[w]
            post = alpha[w, i] * probs[p] * beta[w, ends[w] - j] * np.exp(np.minimum(log, 700)) * counts[places][w]
            np.add.at(out, p, post)
        return out


def letters(raw: bytes) -> list[str]:
    """Runs of letters (Unicode category L), lower-cased. Numbers such as ½, ² or Ⅷ are no letters."""
    words = WORD.findall(raw.decode("utf-8", "replace").lower())
    if "".join(words).isalpha():
        return words
    return [part for w in words for part in (w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w)).split()]


def sample(docs: DataFrame, each: int) -> tuple[DataFrame | None, dict[str, int]]:
    """Ids and languages of at most ``each`` documents of every language, and the languages' numbers of documents."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(fold(3) != 1).select("doc_id", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    out = None
    for lang in sorted(sizes):
        part = known.where(F.col("lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each).distinct()
        out = part if out is None else out.unionByName(part)
    return out, sizes


def word_counts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """lang, word, n over the sample; counted within each task first."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raws, langs in slices(batches, ("text", "lang")):
            found: Counter = Counter()
            for raw, lang in zip(raws, langs, strict=True):
                found.update((lang, w) for w in letters(raw))
            yield rows_to_batch([(*k, n) for k, n in found.items()], schema)

    texts = id_and_bytes(docs, "lang").join(F.broadcast(chosen), ["doc_id", "lang"]).select("text", "lang")
    counts = texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return written(counts, "lang-words")


def learn(docs: DataFrame, path: str | None = None, each: int = DOCS, steps: int = STEPS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece probabilities (pieces, languages) and log priors."""
    path = path or vocabulary_path()
    chosen, sizes = sample(docs, each)
    langs = sorted(sizes)
    lattice = Lattice(path)
    probs = np.full((lattice.size, len(langs)), 1 / lattice.size)
    probs[-1] = UNKNOWN
    if chosen is None:
        return langs, probs, np.zeros(0)
    counts = word_counts(docs, chosen)
    schema = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])
    where = {lang: k for k, lang in enumerate(langs)}

    def step(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, now = Lattice(path), sent.value
            total = np.zeros_like(now)
            for batch in batches:
                names, words, ns = (batch.column(c).to_pylist() for c in range(3))
                number = {w: k for k, w in enumerate(dict.fromkeys(words))}
                n = np.zeros((len(number), len(langs)))
                np.add.at(n, ([number[w] for w in words], [where[x] for x in names]), ns)
                total += own.expected([*number], n, now)
            p, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(total[p, k], pa.float64())], schema=schema)

        return run

    for _ in range(steps):
        sent = docs.sparkSession.sparkContext.broadcast(probs)
        rows = counts.mapInArrow(step(sent), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros_like(probs)
        total[rows["piece"], rows["lang"]] = rows["n"]
        total[-1] = 0
        probs = (1 - FLOOR) * total / np.maximum(total.sum(0), 1e-300) + FLOOR / lattice.size
        probs[-1] = UNKNOWN
    priors = np.log([sizes[x] / sum(sizes.values()) for x in langs])
    return langs, probs, priors


def language(docs: DataFrame, path: str | None = None, each: int = DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred and score."""
    path = path or vocabulary_path()
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, path, each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, probs, priors = sent.value
        lattice = Lattice(path)
        table: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for ids, raws in slices(batches, ("doc_id", "text")):
            if len(table) > KEPT_WORDS:
                table, scores = {}, scores[:0]
            texts = [letters(raw) for raw in raws]
            new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in table]
            if new and langs:
                table.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                scores = np.concatenate((scores, lattice.forward(new, probs)))
            rows = []
            for doc_id, words in zip(ids, texts, strict=True):
                if not words or not langs:
                    rows.append((doc_id, "und", 0.0))
                    continue
                total = scores[[table[w] for w in words]].sum(0) + priors
                best = int(total.argmax())
                rows.append((doc_id, langs[best], float(1 / np.exp(total - total[best]).sum())))
            yield rows_to_batch(rows, ROW)

    found = id_and_bytes(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(documents(spark, sf_dir))
