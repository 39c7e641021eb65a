"""Spelling variants: all pairs of words that one inserted, deleted or replaced letter sets apart, through pairs of trie nodes.

Every word is a path in a trie of prefixes and, read backwards, in a trie of suffixes. A node's number follows from its parent's
number, its depth and its letter, so all tasks give a node the same number and none holds a trie. The dictionary of a word of
n letters has n + 1 pairs (prefix node, suffix node) that meet between two letters, and n pairs that skip one letter. Words that
share a skipping pair differ by that letter alone; a word whose skipping pair is another's meeting pair has one letter
more. A letter of a run of equal ones is skipped for the longer word at the run's start only, so every pair of neighbours meets in
exactly one place, whose words are as many as the alphabet has letters, and one. Numbers have 64 bits; each pair found is
compared letter by letter, so results are exact.

Every join is a sort-merge join: Spark sizes these tables by their compressed files and does not see that a word has dozens of
node pairs, so by its own choice it would gather a table that grows with the vocabulary in the driver to broadcast it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces, releasing
from .fingerprints import U, mix
from .shared import discard, written

#: Text bytes searched at once; letters of words keyed at once; distinct words a task counts before it passes them on.
PIECE, LETTERS, COUNTED = 4 << 20, 1 << 18, 400_000
#: Bytes a word has at most for its checksum to be joined by table; longer ones are run through.
BY_TABLE = 64
LETTER = np.zeros(256, bool)
LETTER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Variants:
    """``letters`` and ``least`` occurrences that a word has at least; ``ratio`` by which its form is more frequent.

    Every occurrence whose checksum with its document's id is a multiple of ``every`` loses a letter first.
    """

    letters: int = 6
    least: int = 5
    ratio: int = 5
    every: int = 199


def _shifts() -> np.ndarray:
    """[n, k, b]: the checksum that byte b, as the k-th of a checksum, turns into when n zero bytes follow."""
    table = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    table ^= zlib.crc32(b"\0") ^ 0  # the linear part: what byte b adds to that of byte 0
    now = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]).astype(np.uint32)
    rows = [now]
    for _ in range(BY_TABLE):
        now = table[now & 0xFF] ^ now >> np.uint32(8)
        rows.append(now)
    return np.stack(rows)


SHIFTS = _shifts()


class Runs:
    """Maximal runs of letters from A-Z, a-z and U+00C0 to U+00FF in a batch of texts, A-Z lower-cased."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2] is not None and offsets[-1] > offsets[0]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
        offsets, n = offsets - offsets[0], len(data)
        lead = data == 0xC3  # U+00C0 to U+00FF are this byte and another
        inside = LETTER[data] | lead
        inside[1:] |= lead[:-1]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:n]
        closes[:-1] &= ~inside[1:] | first[1:n]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
        size = np.concatenate(([0], np.cumsum(ends - starts)))
        letters = LOWER[data[inside]]
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(size), pa.py_buffer(letters)).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)

    def edited(self, doc_ids: list[str], s: Variants) -> Counter:
        """Counts of the words, those with too few letters left out, after the deletions that ``s.every`` asks for."""
        if not len(self.code):
            return Counter()
        words = self.words.to_pylist()
        width = pc.binary_length(self.words).to_numpy(zero_copy_only=False)
        length = pc.utf8_length(self.words).to_numpy(zero_copy_only=False)
        own = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))
        heads = [f"{i}:".encode() for i in doc_ids]
        head = np.fromiter(map(zlib.crc32, heads), np.uint32, len(heads))
        keep = np.flatnonzero(length[self.code] >= s.letters)
        code, text = self.code[keep], self.text[keep]
        n, before = width[code], head[text]
        short = np.minimum(n, BY_TABLE)
        h = own[code] ^ SHIFTS[short, 0, before & 0xFF] ^ SHIFTS[short, 1, before >> 8 & 0xFF] ^ SHIFTS[short, 2, before >> 16 & 0xFF] ^ SHIFTS[short, 3, before >> 24]
        for i in np.flatnonzero(n > BY_TABLE):
            h[i] = zlib.crc32(words[code[i]].encode(), int(before[i]))
        hit = h % np.uint32(s.every) == 0
        counts = np.bincount(code[~hit], minlength=len(words))
        out = Counter({words[i]: int(counts[i]) for i in np.flatnonzero(counts).tolist()})
        for c, at in zip(code[hit].tolist(), (h[hit] % length[code[hit]]).tolist(), strict=True):
            if length[c] > s.letters:
                w = words[c]
                out[w[:at] + w[at + 1 :]] += 1
        return out


def word_counts(docs: DataFrame, s: Variants = Variants(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of every edited word of at least ``s.letters`` letters in all whole texts."""

    def run(batches):
        total: Counter = Counter()

        def told():
            words, counts = list(total), list(total.values())
            total.clear()
            for lo in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 20_000], pa.string()), pa.array(counts[lo : lo + 20_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for lo, hi, texts in pieces(batch.column(1), PIECE):
                total.update(Runs(texts).edited(batch.column(0).slice(lo, hi - lo).to_pylist(), s))
                if len(total) > COUNTED:
                    yield from told()
        yield from told()

    source = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(releasing(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def node_pairs(words: list[str]) -> tuple[np.ndarray, ...]:
    """(prefix node, suffix node, place, word number, kind) of all pairs of ``words`` (letters up to U+00FF, none empty).

    Kind 0 meets between two letters, 1 skips a letter, 2 skips the first of a run of equal letters.
    """
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    start, n = end - size, len(data)
    powers = np.full(n + 1, BASE, U)
    back = np.full(n + 1, INVERSE, U)
    powers[0] = back[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers[:n], out=sums[1:])

    def node(a, b):
        return mix((sums[b] - sums[a]) * back[a])

    skip = np.repeat(np.arange(len(words)), size)
    at = np.arange(n)
    opens = np.ones(n, bool)
    opens[1:] = data[1:] != data[:-1]
    opens[start] = True
    meet = np.repeat(np.arange(len(words)), size + 1)
    place = np.arange(n + len(words)) - np.repeat(start + np.arange(len(words)), size + 1)
    between = start[meet] + place
    return (
        np.concatenate((node(start[skip], at), node(start[meet], between))),
        np.concatenate((node(at + 1, end[skip]), node(between, end[meet]))),
        np.concatenate((at - start[skip], place)),
        np.concatenate((skip, meet)),
        np.concatenate((1 + opens.astype(np.int64), np.zeros(len(meet), np.int64))),
    )


def neighbours(words: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b``: all ordered pairs of near words of ``words`` (``word, n``; distinct words of letters up to U+00FF)."""
    known = written(words.select("word", "n", F.monotonically_increasing_id().alias("id")), "words")

    def run(batches):
        for batch in batches:
            for lo, hi, own in pieces(batch.column(1), LETTERS):
                prefix, suffix, at, word, kind = node_pairs(own.to_pylist())
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(word))
                yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(suffix.view(np.int64)), pa.array(at.astype(np.int32)), ids, pa.array(kind.astype(np.int8))], ["prefix", "suffix", "at", "id", "kind"])

    pairs = known.select("id", "word").mapInArrow(releasing(run), "prefix long, suffix long, at int, id long, kind byte")
    met = pairs.groupBy("prefix", "suffix", "at").agg(F.collect_list(F.struct("id", "kind")).alias("x")).filter(F.size("x") > 1)
    one = met.select("at", "x", F.explode("x").alias("a")).filter("a.kind > 0")
    two = one.select("at", "a", F.explode("x").alias("b")).filter("b.kind > 0 and a.id <> b.id or b.kind = 0 and a.kind = 2")
    found = two.select("at", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), (F.col("b.kind") > 0).alias("same_length"))
    a = known.select(F.col("id").alias("id_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = known.select(F.col("id").alias("id_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    rest = F.expr("substring(a, at + 2) = substring(b, if(same_length, at + 2, at + 1))")
    lengths = F.expr("char_length(a) = char_length(b) + if(same_length, 0, 1)")
    right = F.expr("substring(a, 1, at) = substring(b, 1, at)") & rest & lengths & F.expr("a <> b")
    links = written(found.join(a.hint("merge"), "id_a").join(b.hint("merge"), "id_b").filter(right).select("a", "b", "n_a", "n_b", "same_length"), "near-words")
    discard(known)
    shorter = links.filter("not same_length").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"))
    return links.select("a", "b", "n_a", "n_b").unionByName(shorter)


def variants(docs: DataFrame, s: Variants = Variants(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``s.letters`` letters and ``s.least`` occurrences.

    A word's form is its most frequent near word (ties: the smallest in code-point order) if that is ``s.ratio`` times as frequent;
    its root is where the forms lead. Each step multiplies the count, so the number of rounds is a logarithm of a logarithm
    of the largest. Null texts hold no words, a null id counts as the empty text in the checksum, repeated rows count
    each time, an empty table gives no rows, and further columns of ``docs`` are not read.
    """
    words = written(word_counts(docs, s, doc_id, text).filter(F.col("n") >= s.least), "vocabulary")
    best = F.min(F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("form")))
    near = neighbours(words).groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n_a").alias("n_a"))
    taken = F.when(-F.col("best.minus") >= s.ratio * F.col("n_a"), F.col("best.form"))
    near = written(near.select(F.col("a").alias("word"), "n_near", taken.alias("form"), F.when(taken.isNotNull(), -F.col("best.minus")).alias("form_n")), "forms")
    roots = written(near.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = written(roots.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(roots)
        roots = longer
        if longer.filter("moved").isEmpty():
            break
    out = words.join(near.hint("merge"), "word", "left").join(roots.select("word", "root").hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
