"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first those of its code points. Each level of the parse

1. gives a run of one name a name of its own,
2. tosses deterministic coins: a name's label is the lowest bit in which it differs from the name before
   it, with that bit's value; four rounds shrink the labels to six, and neighbours still differ,
3. starts a phrase at every label above both its neighbours, so phrases have 2 to 10 names,
4. names each phrase by a hash of the names in it.

What a phrase becomes depends on a few names around it alone, so equal stretches of text get equal
phrases, save near their ends, at whatever offset they stand. A fingerprint holds the name of the whole
text and a one-permutation sketch of the set of its phrases of level 2 and above (of level 1 too in texts
under 64 code points).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces
from .shared import written

#: Bins of a sketch, and bits kept of each bin's least phrase name.
BINS, SHORT, PIECE = 64, 64, 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _next_labels() -> np.ndarray:
    """Label of (own, left) for labels under 128, flattened."""
    own, left = np.arange(128)[:, None], np.arange(128)[None, :]
    differ = own ^ left
    lowest = np.bitwise_count((differ & -differ) - 1)
    return np.where(differ == 0, 0, 2 * lowest + (own >> np.minimum(lowest, 7) & 1)).astype(np.uint8).ravel()


LABELS = _next_labels()
SMALL = mix(np.arange(1 << 16, dtype=U) + U(0x51ED270B))
#: Weight of each place in a phrase or of a run's length: odd numbers of a fixed sequence.
PLACES = mix(np.arange(1, 4097, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def labels(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Six-valued labels of names that differ from their left neighbours; a text's first is set against its complement."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[starts] = ~names[starts]
    differ = names ^ left
    lowest = np.bitwise_count((differ & (~differ + U(1))) - U(1))
    label = 2 * lowest + ((names >> lowest.astype(U)) & U(1)).astype(np.uint8)
    for _ in range(3):
        pair = label.astype(np.uint16) << 7
        pair[1:] |= label[:-1]
        pair[starts] = label[starts].astype(np.uint16) << 7 | (label[starts] ^ 1)
        label = LABELS[pair]
    return label


def parse(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Name of every whole text, and its sketch: ``BINS`` 16-bit values each, 0 where a bin has no phrase."""
    n_docs = len(texts)
    length = np.fromiter(map(len, texts), np.int64, n_docs)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    names = SMALL[np.minimum(chars, 0xFFFF)]
    high = np.flatnonzero(chars > 0xFFFF)
    names[high] = mix(chars[high].astype(U) + U(0x51ED270B))
    doc = np.flatnonzero(length)  # texts still being parsed
    starts = (np.cumsum(length) - length)[doc]
    short = length < SHORT
    top = np.zeros(n_docs, U)
    least = np.full(n_docs * BINS, ~U(0))
    level = 0
    while len(doc):
        n = len(names)
        # runs
        new = np.ones(n, bool)
        new[1:] = names[1:] != names[:-1]
        new[starts] = True
        if not new.all():
            at = np.flatnonzero(new)
            run = np.diff(at, append=n)
            names, starts = names[at], np.searchsorted(at, starts)
            long = np.flatnonzero(run > 1)
            names[long] = mix(names[long] * U(0xD1342543DE82EF95) + run[long].astype(U) * U(0xA0761D6478BD642F))
            n = len(names)
        # phrases
        label = labels(names, starts)
        cut = np.zeros(n, bool)
        cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        cut[starts[1:] - 1] = False  # a text's last name starts no phrase
        cut[starts] = True
        at = np.flatnonzero(cut)
        size = np.diff(at, append=n)
        place = np.arange(n) - np.repeat(at, size)
        level += 1
        names = mix(np.add.reduceat(names * PLACES[place], at) ^ (size.astype(U) * U(0xE7037ED1A0B428DB)) ^ U(level))
        starts = np.searchsorted(at, starts)
        # what the sketch keeps
        count = np.diff(starts, append=len(names))
        owner = np.repeat(doc, count)
        done = count == 1
        top[doc[done]] = names[starts[done]]
        keep = np.ones(len(names), bool) if level > 1 else short[owner] | np.repeat(done, count)
        kept, whose = names[keep], owner[keep]
        np.minimum.at(least, whose * BINS + (kept >> U(58)).astype(np.int64), kept << U(6))
        if done.any():
            names = names[~np.repeat(done, count)]
            doc, count = doc[~done], count[~done]
            starts = np.cumsum(count) - count
    values = (mix(least) & U(0xFFFF)).astype(np.uint16)
    sketch = np.where(least == ~U(0), 0, np.maximum(values, 1)).astype(np.uint16).reshape(n_docs, BINS)
    return top, sketch


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of phrases in common (twice those shared over those of both) of rows of sketches.

    1 for equal texts, empty ones included; 0 if just one is empty.
    """
    some = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    shared = same / np.maximum(some, 1)
    return np.where(some == 0, 1.0, 2 * shared / (1 + shared))


def as_text(top: np.ndarray, sketch: np.ndarray) -> list[str]:
    """Fingerprints as text: 16 hex digits of the whole text's name, then four for each bin."""
    tops, bins = top.astype(">u8"), sketch.astype(">u2")
    return [tops[i : i + 1].tobytes().hex() + bins[i].tobytes().hex() for i in range(len(top))]


def sketch_of(fingerprint: str) -> np.ndarray:
    """The sketch within a fingerprint's text."""
    return np.frombuffer(bytes.fromhex(fingerprint[16:]), ">u2").astype(np.uint16)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row; null texts are empty, rows and null ids stay as they are."""

    def run(batches):
        for batch in batches:
            for lo, hi, own in pieces(batch.column(1), PIECE):
                rows = own.to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in rows], pa.int64()), pa.array(as_text(*parse(rows)))], ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited(own: str, following: str) -> str:
    """``own`` with its last half replaced by as many code points of ``following``."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
_NAMES = [*(x.split()[0] for x in RESULT.split(", ")), "part", "edge", "text"]


def _compared(ids: list, texts: list[str], parsed: tuple[np.ndarray, np.ndarray]) -> list[list]:
    """Result columns of every row but the last, each set against the row after it."""
    top, sketch = parsed
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    top2, sketch2 = parse(changed)
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return [ids[:-1], [len(t) for t in texts[:-1]], sha, as_text(top[:-1], sketch[:-1]), as_text(top2, sketch2), likeness(sketch[:-1], sketch2).tolist(), likeness(sketch[:-1], sketch[1:]).tolist()]


def compared_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document.

    The next is that of ascending ``doc_id`` (nulls first, ties by text; after the last comes the first; a lone
    document follows itself). Null texts are empty; repeated rows stay; an empty table gives an empty one; further
    columns are not read. Range partitions are compared within tasks; each hands out its first and last row,
    and those two rows a partition are matched across partitions afterwards.
    """
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        part, ids, texts = TaskContext.get().partitionId(), [], []
        parsed = (np.zeros(0, U), np.zeros((0, BINS), np.uint16))
        edge = lambda which: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([ids[-1], None, None, None, None, None, None, part, which, texts[-1]], _TYPES, strict=True)], _NAMES)
        for batch in batches:
            for lo, hi, own in pieces(batch.column(1), PIECE):
                first = not ids
                new_ids, new = batch.column(0).slice(lo, hi - lo).to_pylist(), own.to_pylist()
                if first:
                    ids, texts = new_ids[:1], new[:1]
                    yield edge(0)
                    ids, texts = [], []
                top, sketch = parse(new)
                ids, texts = ids + new_ids, texts + new
                parsed = np.concatenate((parsed[0], top)), np.concatenate((parsed[1], sketch))
                if len(ids) > 1:
                    rows = _compared(ids, texts, parsed)
                    n = len(ids) - 1
                    columns = [*rows, [part] * n, [None] * n, [None] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)
                ids, texts, parsed = ids[-1:], texts[-1:], (parsed[0][-1:], parsed[1][-1:])
        if ids:
            yield edge(1)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = written(ordered.mapInArrow(run, f"{RESULT}, part int, edge int, text string"), "fingerprints")
    edges = out.filter("edge is not null")
    parts = sorted(r.part for r in edges.filter("edge = 0").select("part").collect())  # one number a partition
    follow = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next_part int")
    last = edges.filter("edge = 1").select("part", "doc_id", "text").join(follow, "part")
    first = edges.filter("edge = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    pairs = last.join(first, "next_part").select("doc_id", "text", "next_text")

    def across(batches):
        for batch in batches:
            for i, own, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = _compared([i, None], [own, following], parse([own, following]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _TYPES, strict=False)], _NAMES[:7])

    return out.filter("edge is null").select(*_NAMES[:7]).unionByName(pairs.mapInArrow(across, RESULT))
