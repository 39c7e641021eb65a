"""Packing by powers of two: every document is cut into pieces whose lengths are its binary digits.

A document of 2,342 tokens makes two pieces of 1,024 and pieces of 256, 32, 4 and 2. Each piece is a sequence, so no sequence
holds tokens of two documents, none needs padding, and attention never reaches across a seam. Sequences of one
length form a bucket: they are numbered one after the other, longest bucket first, so that a trainer reads batches of equal length.

One pass tokenises and cuts. The numbers need only the count of each length in each task's output; those counts are summed in a
window of one row a task and length.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import pieces, releasing
from .shared import written
from .token_files import _byte_letters as byte_letters

#: Text bytes tokenised at once; ids of one Arrow batch; chunks kept between batches of a worker.
PIECE, BATCH_IDS, KEPT_CHUNKS = 4 << 20, 1 << 20, 400_000
#: Bytes of ASCII white space; of ASCII letters and digits; of ASCII punctuation before which a word ends for certain.
SPACE, ALNUM, STOP, SEEN = (np.zeros(256, bool) for _ in range(4))
SPACE[[*b" \t\n\x0b\x0c\r"]] = True
ALNUM[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
STOP[[*b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~']] = True
SEEN[0x21:0x7F] = True
#: The settings under which a text's ids are those of its chunks, one after the other.
BY_CHUNK = {"normalizer": None, "post_processor": None, "truncation": None, "padding": None}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")


class Chunks:
    """Token ids of whole texts by the tokenizers library, as it encodes them (names of added tokens in a text give those tokens).

    A byte-level tokenizer merges within the matches of its pattern only. A match always begins where white space follows a
    visible character, where a stop follows a letter or digit, and after a single line end, so a text's ids are those of its chunks
    between such places, in order. Each distinct chunk of a batch is encoded once, and a bounded cache serves the worker's next
    batches; a chunk of Latin letters is one match and goes to the library's model as it is. Texts that hold an added token's
    name, and all texts under other settings, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library, self.cache, self.letters = Tokenizer.from_file(path), {}, byte_letters()
        self.model = self.library.model
        added, before = spec["added_tokens"], spec["pre_tokenizer"] or {}
        self.width = "<u2" if max(self.library.get_vocab_size(), *(t["id"] + 1 for t in added), 1) <= 1 << 16 else "<u4"
        self.names = [t["content"] for t in added]
        self.by_chunk = (
            all(spec.get(k) == v for k, v in BY_CHUNK.items())
            and all(before.get(k) == v for k, v in BYTE_LEVEL.items())
            and spec["model"]["type"] == "BPE"
            and not any(spec["model"].get(k) for k in PLAIN_MODEL)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width == "<u2" else "I"
        return [array(kind, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        kind, out = "H" if self.width == "<u2" else "I", []
        for c in chunks:
            word = c[1:] if c[0] == " " else c
            if self.by_chunk and word.isalpha() and max(word) < "\u0250":
                mapped = c.replace(" ", self.letters[32]) if c.isascii() else c.encode().decode("latin-1").translate(self.letters)
                out.append(array(kind, [t.id for t in self.model.tokenize(mapped)]).tobytes())
            else:
                out.append(None)
        rest = iter(self.encode([c for c, o in zip(chunks, out, strict=True) if o is None]))
        return [next(rest) if o is None else o for o in out]

    def starts(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Bytes at which a chunk begins."""
        n = len(data)
        first = np.zeros(n + 1, bool)
        if n > 1:
            before, now = data[:-1], data[1:]
            letter = np.zeros(n - 1, bool)  # the last byte of a letter from U+00C0 to U+00FF
            letter[1:] = (data[:-2] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)
            seen = SEEN[before] | letter
            first[1:n] = SPACE[now] & seen | STOP[now] & (ALNUM[before] | letter)
            # a single line end between visible characters is a match of its own
            first[2:n] |= (before[1:] == 10) & seen[:-1] & SEEN[now[1:]]
        for i in np.flatnonzero(whole):
            first[offsets[i] : offsets[i + 1]] = False
        first[offsets] = True
        return np.flatnonzero(first[:n])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (large_string, no nulls) joined, and how many each text has."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[-1] == offsets[0]:
            return np.zeros(0, self.width), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        whole = np.full(len(texts), not self.by_chunk)
        for name in self.names:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        at = self.starts(data, offsets, whole)
        ends = np.append(at[1:], len(data))
        coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        found = [self.cache.get(c) for c in chunks]
        new = [i for i, got in enumerate(found) if got is None]
        for i, ids in zip(new, self.encode_chunks([chunks[i] for i in new]), strict=True):
            found[i] = ids
        if len(self.cache) < KEPT_CHUNKS:
            self.cache.update((chunks[i], found[i]) for i in new if len(chunks[i]) <= 64)
        size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.width).itemsize
        place = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(found), self.width)
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = size[index]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.arange(upto[-1]) + np.repeat(place[index] - upto[:-1], n)]
        assert ends[-1] == len(data)
        return ids, np.diff(upto[np.searchsorted(at, offsets)])


_chunks: dict[str, Chunks] = {}


def cut(totals: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all pieces of documents with ``totals`` tokens, longest first, and how many pieces each document has."""
    bits = limit.bit_length() - 1
    sizes = 1 << np.arange(bits, -1, -1)
    often = totals[:, None] >> np.arange(bits, -1, -1) & 1
    often[:, 0] = totals >> bits
    return np.repeat(np.tile(sizes, len(totals)), often.ravel()), often.sum(axis=1)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` (little-endian unsigned 32-bit) of every piece, with its task (``part``) and its
    ``place`` among the task's pieces of that length."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(batches):
        if tokenizer not in _chunks:
            _chunks[tokenizer] = Chunks(tokenizer)
        encode, part, seen = _chunks[tokenizer], TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo, hi, texts in pieces(batch.column(1), PIECE):
                own, counts = encode(texts)
                upto = np.concatenate(([0], np.cumsum(counts + 1)))
                ids = np.full(upto[-1], end_id, "<u4")
                ids[np.arange(len(own)) + np.repeat(np.arange(len(counts)), counts)] = own
                length, often = cut(counts + 1, limit)
                ends = np.cumsum(length)
                doc = np.repeat(np.arange(len(counts)), often)
                place = np.empty(len(length), np.int64)
                for size in np.unique(length).tolist():
                    there = np.flatnonzero(length == size)
                    place[there] = seen.get(size, 0) + np.arange(len(there))
                    seen[size] = seen.get(size, 0) + len(there)
                docs_of = batch.column(0).slice(lo, hi - lo)
                first = 0
                while first < len(length):
                    base = int(ends[first - 1]) if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, base + BATCH_IDS, "right")))
                    r = slice(first, last)
                    cells = pa.BinaryArray.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((4 * np.concatenate(([0], ends[r] - base))).astype(np.int32)), pa.py_buffer(ids[base : ends[last - 1]])])
                    columns = [docs_of.take(pa.array(doc[r])), *map(pa.array, (ends[r] - length[r] - upto[doc[r]], length[r], counts[doc[r]] + 1)), cells, pa.array(np.full(last - first, part, np.int64)), pa.array(place[r])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids", "part", "place"])
                    first = last

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(releasing(run), "doc_id long, start long, length long, doc_tokens long, ids binary, part long, place long")


def packed(docs: DataFrame, tokenizer: str, end_id: int, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a piece: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset, place``.

    ``sequence_id`` counts from 0 over all sequences, those of ``limit`` tokens first; ``place`` counts within a length. ``offset`` is 0
    and ``length`` the sequence's whole length, since a sequence holds one piece. Null texts count as empty: one sequence with just
    ``end_id``. Repeated rows and rows with a null id are packed as often as they occur; an empty table gives no rows; further columns
    of ``docs`` are not read. The numbers depend on how Spark deals ``docs`` to tasks, the pieces don't.
    """
    rows = written(cut_pieces(docs, tokenizer, end_id, limit, doc_id, text), "pieces")
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(counts.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before")), "starts")
    total, first = 0, []
    for r in starts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("length")).collect():  # a row for each power of two
        first += [F.lit(r.length), F.lit(total)]
        total += r.n
    base = F.create_map(*first)[F.col("length")] if first else F.lit(0)
    place = F.col("place") + F.col("before")
    out = rows.join(starts.drop("n"), ["length", "part"]).select("doc_id", "start", "length", "doc_tokens", "ids", (base + place).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), place.alias("place"))
    return out


def batches(rows: DataFrame, tokens: int) -> DataFrame:
    """``packed``'s rows with ``batch``: the sequences of one length and one batch number hold ``tokens`` tokens (the last of a length may
    hold fewer), for trainers that step through batches of equal lengths. ``tokens`` is at least the longest length."""
    return rows.withColumn("batch", F.floor(F.col("place") / F.floor(F.lit(tokens) / F.col("length"))).cast("long"))
