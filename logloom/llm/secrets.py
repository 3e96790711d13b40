"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds the base kinds (assign, access, hex) and further candidates (key: long mixed tokens outside them).
Every candidate's value is hashed; the hashes are counted by distinct repositories and owners over the whole corpus. A document's
source is its owner; a different text is a repository (copies of a text are one). A value of ``COPIED_OWNERS`` owners, or of
``COPIED_REPOS`` repositories even of one owner, is a widely copied example; any other value that looks live (letters and digits,
enough entropy, no placeholder) is an owner's credential. Base spans always stay; a key span is added where its value is
owner-specific and live-looking.

Only ids, hashes and offsets are shuffled. Counts are made in three steps (distinct hash, owner and repository; by hash and owner; by
hash), each pre-aggregated; the verdict goes back to the candidates by a look-up that never gathers a frequent value's rows.

Defined cases: null and empty texts have no spans and the digest of the empty text; repeated rows repeat their result and count as one
owner; a null source counts as an owner of its own; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import BROADCAST_ROWS, LOWER, ROW, documents, id_and_bytes, keyed, looked_up, per_row, row_columns, same_row, written

#: The base kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "key")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
WORDS_OF_ASSIGN = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: The method's own candidates.
KEY = re.compile(rb"[A-Za-z0-9+/_-]{20,}")
ENTROPY, COPIED_OWNERS, COPIED_REPOS = 3.0, 3, 50
#: Characters of spans that are broadcast at most.
BROADCAST_CHARS = 16 << 20
PLACEHOLDERS = (b"example", b"placeholder", b"changeme", b"your", b"xxxx", b"0000", b"12345", b"abcdef")
SCANNED = pa.schema(
    [("row_id", pa.int64()), ("row_hash", pa.int64()), ("row_check", pa.int32()), ("owner", pa.string()), ("repo", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
     ("n_hex", pa.int64()), ("base_sha256", pa.string()),
     ("found", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("hash", pa.int64()), ("live", pa.bool_())])))]
)


def base_spans(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, end, kind, value) in bytes, by start and kind."""
    out = []
    low = raw.translate(LOWER)
    if any(w in low for w in WORDS_OF_ASSIGN):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(raw) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(raw) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(raw)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def key_spans(raw: bytes, base) -> list[tuple[int, int, int, bytes]]:
    """Long tokens with letters and digits that touch no base span."""
    out = []
    at = 0
    for m in KEY.finditer(raw):
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        clear = not any(b[0] < m.end() and m.start() < b[1] for b in base[at : at + 3])
        if clear and re.search(rb"[0-9]", m[0]) and re.search(rb"[A-Za-z]", m[0]):
            out.append((m.start(), m.end(), 3, m[0]))
    return out


def live_looking(value: bytes) -> bool:
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    low = value.lower()
    return entropy >= ENTROPY and any(48 <= b <= 57 for b in value) and not any(p in low for p in PLACEHOLDERS)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_row(doc_id, raw: bytes, row_hash, row_check, owner, repo) -> tuple:
    base = base_spans(raw)
    spans = base + key_spans(raw, base)
    if spans and not raw.isascii():
        points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        spans = [(int(points[a]), int(points[b]), k, v) for a, b, k, v in spans]
    counts = Counter(k for _, _, k, _ in base)
    digest = hashlib.sha256(joined([s[:3] for s in spans[: len(base)]]).encode()).hexdigest()
    found = [{"start": a, "end": b, "kind": k, "hash": xxhash.xxh64_intdigest(v) - (1 << 63), "live": live_looking(v)} for a, b, k, v in spans]
    return doc_id, row_hash, row_check, owner, repo, counts[0], counts[1], counts[2], digest, found


def scanned(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    more = [*row_columns()[1:], owner.cast("string").alias("owner"), repo.cast("string").alias("repo")]
    kind = "row_id long, row_hash long, row_check int, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start: long, end: long, kind: int, hash: long, live: boolean>>"
    return id_and_bytes(docs, *more).mapInArrow(per_row(scan_row, ("doc_id", "text", "row_hash", "row_check", "owner", "repo"), SCANNED), kind)


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners, n: distinct repositories and owners of every candidate value of the corpus, and its places."""
    once = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = once.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n"))


def widely_copied(owners: int = COPIED_OWNERS, repos: int = COPIED_REPOS) -> Column:
    """A value of many owners, or of so many repositories that not even one owner would keep a credential in all of them."""
    return (F.col("n_owners") >= owners) | (F.col("n_repos") >= repos)


def judged(docs: DataFrame, owner: Column | None = None, repo: Column | None = None, owners: int = COPIED_OWNERS, repos: int = COPIED_REPOS) -> tuple[DataFrame, DataFrame]:
    """Every row's scan, and the spans of the rows that have any (``ROW``, spans)."""
    owner = F.coalesce(F.col("source"), F.lit("")) if owner is None else owner
    repo = F.xxhash64(F.col("text")) if repo is None else repo
    table = written(scanned(docs, owner, repo), "scanned")
    one = written(table.where(F.size("found") > 0).select(*ROW, "owner", "repo", F.explode("found").alias("c")).select(*ROW, "owner", "repo", "c.*"), "candidates")
    verdict = written(ownership(one).select("hash", "n", widely_copied(owners, repos).alias("copied")), "ownership")
    added = F.col("live") & ~F.col("copied")
    span = F.struct("start", "kind", "end", "copied", added.alias("specific"))
    found = looked_up(one, verdict, "hash").where((F.col("kind") < 3) | added)
    return table, found.groupBy(*ROW).agg(F.array_sort(F.collect_set(span)).alias("spans"))


def span_text(spans: str = "spans") -> Column:
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, name), ",")


def secrets(docs: DataFrame, owner: Column | None = None, repo: Column | None = None, owners: int = COPIED_OWNERS, repos: int = COPIED_REPOS) -> DataFrame:
    """Per row of ``docs``: doc_id, base counts and digest, spans, and how many spans are copied examples or owner-specific."""
    table, spans = judged(docs, owner, repo, owners, repos)
    plain = table.drop("found", "owner", "repo")
    none = F.array().cast(spans.schema["spans"].dataType)
    out = plain.join(spans, same_row(plain, spans), "left").select(plain["row_id"].alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", none).alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", span_text().alias("spans"),
        F.size(F.filter("spans", lambda s: s["copied"])).alias("n_copied"), F.size(F.filter("spans", lambda s: s["specific"])).alias("n_specific"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with all their columns; every span of ``secrets`` (overlapping ones united) is replaced by ``mark``.

    n_chars, where it is a column, follows the text. A null text stays null. Texts stay where they are while the spans are few enough
    to be broadcast (counted); else the rows are shuffled once.
    """
    found = written(judged(docs)[1].select(*ROW, span_text().alias("cut_spans")), "spans")
    size = found.agg(F.count("*").alias("rows"), F.sum(F.length("cut_spans")).alias("chars")).first()
    few = size["rows"] <= BROADCAST_ROWS and (size["chars"] or 0) <= BROADCAST_CHARS
    whole = keyed(docs)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, s, mark) if s else t for t, s in zip(texts, spans, strict=True)], dtype=object)

    joined = whole.join(F.broadcast(found) if few else found, same_row(whole, found), "left").select("whole", "cut_spans")
    same, changed = joined.where("cut_spans is null").select("whole.*"), joined.where("cut_spans is not null")
    changed = changed.withColumn("cut_text", cut(F.col("whole.text"), F.col("cut_spans")))
    columns = {c: F.col("whole")[c] for c in docs.columns} | {"text": F.col("cut_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("cut_text").cast(docs.schema["n_chars"].dataType)
    return same.unionByName(changed.select(*[v.alias(c) for c, v in columns.items()]))


def without(text: str, spans: str, mark: str) -> str:
    out, at, covered = [], 0, -1
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if a >= covered:
            out += [text[at:a], mark]
        at = covered = max(covered, b)
    return "".join([*out, text[at:]])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))
