"""BPE encoding and decoding through a table of distinct words.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its words one after another.
Words are split on ASCII white space (other white space stays inside a word and is left to the tokenizer).

1. Texts are split into blocks (``blocks``); each sends its different words to the parts that own them, a word to one part.
2. A part holds its share of the corpus's distinct words and encodes each of them once, whatever the number of blocks that ask for it.
3. The ids come back to the blocks and are joined to the documents by position.
4. Decoding joins every id of a document to its piece; the vocabulary is the small side and is at hand in every worker.

Neither a text nor a token crosses the network as such: a block's words travel once, its positions as packed numbers. A part's memory
is its share of the distinct words, so the number of parts (``blocks.parts_for``, the session's shuffle partitions at least) sets it.

Defined cases: null is the empty text; empty text has no ids and decodes to the empty text; a repeated row gives a repeated result;
a null doc_id stays null; further columns are ignored; null or empty ids decode to the empty text, an id without a piece to an
empty piece.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import blocks as B
from logloom.llm.common import documents, id_and_bytes, rows_to_batch, slices
from logloom.session import ensure_importable

#: Words that a table holds, if it is given no other limit, before it starts anew.
OWN_WORDS = 150_000
#: The parts into which the tokenizer cuts words of ASCII marks, digits and letters and of Latin-1 letters.
PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-/:-@\[-`{-~]+")
#: The characters by which byte-level vocabularies write bytes: printable Latin-1 ones as they are, the others from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
PROBES = ("hello", "World", "internationalization,", "x!!", "QUICK.?", "it's", "I'LL", "''s", "a1b22c", "École", "Straße-ñandú", "ÀÖØÞßÿ", "a|<b>", "#$%&*", "don't!?", "0x9f", "zzqxj***")
PROBES = tuple(w.encode() for w in PROBES)
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """A task's table of distinct words to entries (``make`` of a word's ids); a word that it lacks is encoded when it is looked up.

    The tokenizer parts most words by a simple rule: ASCII and Latin-1 letters in lower case, single digits, runs of marks and a few
    endings. Each such part goes to the tokenizer's model once, and the parts' entries are put together by ``join``. All other words
    are encoded as they are, and so is every word if the rule fails on ``PROBES`` for the given tokenizer.
    """

    def __init__(self, path: str, make, join, limit: int | None = OWN_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all it may use
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.make, self.join, self.most = make, join, limit
        self.simple = all([i for p in PARTS.findall(w.decode().lower().encode()) for i in self.ids_of(p)] == self.whole(w) for w in PROBES)

    def __missing__(self, word: bytes):
        low = word.lower() if word.isascii() else word.decode("utf-8", "replace").lower().encode()
        parts = PARTS.findall(low) if self.simple and b"<|" not in word else ()
        if len(parts) == 1 and len(parts[0]) == len(low):
            entry = self.of_part(low)
        elif sum(map(len, parts)) == len(low):
            entry = None
            for part in parts:
                found = self.of_part(part)
                entry = found if entry is None else self.join(entry, found)
        else:  # some character is none that the rule knows
            entry = self.make(self.whole(word))
        self[word] = entry
        return entry

    def of_part(self, part: bytes):
        """A part's entry is that of the word which it would be by itself."""
        found = self.get(part)
        if found is None:
            found = self[part] = self.make(self.ids_of(part))
        return found

    def __call__(self, words: list[bytes]) -> list:
        """The entries for ``words``, in order. A table that has grown too large starts anew first."""
        return [*map(self.lookup(), words)]

    def lookup(self):
        if self.most is not None and len(self) > self.most:
            self.clear()
        return self.__getitem__

    def ids_of(self, part: bytes) -> list[int]:
        text = part.decode() if part.isascii() else part.decode("latin-1").translate(BYTE_CHARS)
        return [t.id for t in self.model.tokenize(text)]

    def whole(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids


def pieces(path: str) -> list[str]:
    """The vocabulary's piece for every id: the small side of the id-to-piece join."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]


def id_code(path: str, more: int = 0) -> str:
    """Array type that holds every id of the vocabulary (and ``more``)."""
    from tokenizers import Tokenizer

    return "H" if max(Tokenizer.from_file(path).get_vocab_size(), more + 1) <= 1 << 16 else "I"


def packed_ids(code: str) -> Callable[[list[int]], bytes]:
    """Ids as little-endian bytes of two or four each."""
    little, kind = sys.byteorder == "little", f"<u{2 if code == 'H' else 4}"
    return lambda ids: array(code, ids).tobytes() if little else np.array(ids, kind).tobytes()


def ask(block: B.Block, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """A block's different words for each part, and its documents' ids and sizes."""
    _, part, kind = block.renumbered(parts)
    for p, places in B.by_part(part):
        words = np.frombuffer(b" ".join([block.words[i] for i in places.tolist()]), np.uint8)
        yield p, B.REQUEST, B.pack(kind[places], words)
    ids = [d for (d,) in block.rows]
    yield 0, B.LAST, B.pack(np.array([d or 0 for d in ids], np.int64), np.array([d is None for d in ids]), block.sizes)


def encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers a part's requests: every different word of the part is encoded when it is first asked for, and never again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = id_code(path)
        table = Words(path, packed_ids(code), bytes.__add__, limit=None)
        size = 2 if code == "H" else 4
        for key, block, part, kind, payload in B.rows_of(batches):
            if kind == B.REQUEST:
                kinds, words = B.unpack(payload)
                found = table(words.tobytes().split(b" "))
                lengths = np.fromiter(map(len, found), np.int64, len(found)) // size
                payload = B.pack(kinds, B.small(lengths), np.frombuffer(b"".join(found), f"<u{size}"))
            yield B.batch_of([(key, block, part, kind, payload)])

    return run


def by_document(docs: DataFrame, path: str, finish: Callable, schema: pa.Schema, kind: str, size: int = B.BLOCK_WORDS) -> DataFrame:
    """``finish()`` gives a function of (doc_id, pieces of the document's ids) that returns the document's row."""
    parts = B.parts_for(docs)
    asked = B.requests(id_and_bytes(docs), ("doc_id",), parts, ask, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = finish()
        for _, answers, (ids, none, sizes, at) in B.by_block(batches):
            kinds, lengths, values = zip(*(x for _, _, x in answers), strict=True) if answers else ((), (), ())
            order = B.restored(kinds)
            each = np.concatenate(lengths).astype(np.int64) if answers else np.zeros(0, np.int64)
            starts, each, flat = (np.cumsum(each) - each)[order], each[order], np.concatenate(values) if answers else np.zeros(0, np.uint16)
            ends = np.cumsum(sizes)
            rows = []
            for k, (doc, end) in enumerate(zip(ids.tolist(), ends.tolist(), strict=True)):
                rows.append(row(None if none[k] else doc, B.sequences(flat, starts, each, at[end - sizes[k] : end])))
                if len(rows) >= 256:
                    yield rows_to_batch(rows, schema)
                    rows = []
            yield rows_to_batch(rows, schema)

    return B.together(B.answered(asked, parts, encoder(path)), parts).mapInArrow(run, kind)


def encode(docs: DataFrame, path: str | None = None, size: int = B.BLOCK_WORDS) -> DataFrame:
    """doc_id and ids (array<int>) of every row of ``docs``."""

    def finish():
        return lambda doc, found: (doc, [i for some in found for i in some.tolist()])

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return by_document(docs, path or tokenizer_path(), finish, schema, "doc_id long, ids array<int>", size)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids): each id joined to its piece, in order."""
    path = path or tokenizer_path()
    ensure_importable(encoded.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        known = range(len(table))
        for docs, lists in slices(batches, ("doc_id", "ids")):
            yield rows_to_batch([(d, " ".join([table[i] if i in known else "" for i in ids or ()])) for d, ids in zip(docs, lists, strict=True)], schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, size: int = B.BLOCK_WORDS) -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the text that they decode to."""
    path = path or tokenizer_path()

    def finish():
        table = [p.encode() for p in pieces(path)]
        names = [str(i).encode() for i in range(len(table))]

        def row(doc, found):
            n, ids, text = 0, hashlib.sha256(), hashlib.sha256()
            for some in found:
                if n and len(some):
                    ids.update(b" ")
                    text.update(b" ")
                listed = some.tolist()
                ids.update(b" ".join([names[i] for i in listed]))
                text.update(b" ".join([table[i] for i in listed]))
                n += len(listed)
            return doc, n, ids.hexdigest(), text.hexdigest()

        return row

    return by_document(docs, path, finish, DIGEST, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", size)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
