"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding.

File layout, little-endian, repeated until the end of the file::

    magic     4 bytes  b"FRV1"
    n_docs    uint32
    n_ids     uint64
    n_data    uint64
    doc_id    int64[n_docs]
    valid     uint8[n_docs]      0 where doc_id is null
    n_tokens  uint64[n_docs]
    control   uint8[ceil(n_ids/4)]   two bits per id: its bytes less one, first id lowest
    data      uint8[n_data]          each id's frequency rank in 1 to 4 bytes, little-endian

The most frequent id has rank 0, so most ids take a single byte. Control bytes are kept apart from
the data bytes; a 256-row table gives the lengths of four ids at once, so decoding is table lookup and
prefix sums in numpy.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import pieces
from .shared import filesystem, put, shared_dir

MAGIC, HEAD = b"FRV1", struct.Struct("<4sIQQ")
#: Text bytes tokenised at once; ids encoded in one block; words kept between batches of a worker.
PIECE, BLOCK_IDS, KEPT_WORDS = 4 << 20, 1 << 20, 350_000

LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


# ---- variable-length coding -------------------------------------------------------------------------
def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4", copy=False)
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    keep = np.arange(4, dtype=np.uint8) < size[:, None]
    return control, values.view(np.uint8).reshape(-1, 4)[keep]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values again: lengths by table lookup, places by prefix sum, bytes by one gather."""
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    if len(data) < size.sum(dtype=np.int64):
        raise ValueError("token file ends within a block")
    wide = np.zeros(len(data) + 3, np.uint32)
    wide[: len(data)] = data
    word = wide[at] | wide[at + 1] << 8 | wide[at + 2] << 16 | wide[at + 3] << 24
    return word & MASKS[size]


def block(doc_ids: list, counts: np.ndarray, ranks: np.ndarray) -> list[bytes]:
    control, data = pack(ranks)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    ids = np.array([0 if x is None else x for x in doc_ids], "<i8")
    return [HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data)), ids.tobytes(), known.tobytes(), counts.astype("<u8").tobytes(), control.tobytes(), data.tobytes()]


def blocks(read: Callable[[int], bytes]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, tokens of each, ranks of all) of every block that ``read`` yields."""
    while head := read(HEAD.size):
        magic, n_docs, n_ids, n_data = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token file")
        ids = np.frombuffer(read(8 * n_docs), "<i8").tolist()
        known = np.frombuffer(read(n_docs), np.uint8)
        counts = np.frombuffer(read(8 * n_docs), "<u8").astype(np.int64)
        control = np.frombuffer(read(-(-n_ids // 4)), np.uint8)
        data = np.frombuffer(read(n_data), np.uint8)
        yield [x if k else None for x, k in zip(ids, known, strict=True)], counts, unpack(control, data, n_ids)


# ---- tokenisation -----------------------------------------------------------------------------------
def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The settings under which a text's ids are those of its words, one after the other.
BY_WORD = {
    "normalizer": ["NFC", ("Replace", r"\s+", " "), "Lowercase"],
    "pre_tokenizer": [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", True), ("ByteLevel", False, False)],
}


def _settings(part: dict | None) -> list:
    """A normaliser or pre-tokeniser as a flat list."""
    if not part:
        return []
    kind = part["type"]
    if kind == "Sequence":
        return [x for p in part.get("normalizers") or part.get("pretokenizers") or [] for x in _settings(p)]
    more = {"Replace": ["content"], "Split": ["behavior", "invert"], "ByteLevel": ["add_prefix_space", "use_regex"]}.get(kind)
    pattern = [part["pattern"].get("Regex", part["pattern"])] if "pattern" in part else []
    return [(kind, *pattern, *(part[k] for k in more)) if more else kind]


class Words:
    """Token ids of whole texts by the tokenizers library, as it encodes them (names of added tokens in a text give those tokens).

    Where the tokenizer lower-cases, drops white space and ends its merges with each word, a text's ids are those of
    its pieces between spaces and line ends, in order. Each distinct piece of a batch is then encoded once, and frequent
    ones stay in a bounded cache for the next batches of the worker. With any other settings whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.model, self.letters, self.cache = self.whole.model, _byte_letters(), {}
        self.width = "<u2" if max(self.whole.get_vocab_size(), *(t["id"] + 1 for t in spec["added_tokens"]), 1) <= 1 << 16 else "<u4"
        added = spec["added_tokens"]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in added)
        model = spec["model"]
        merges = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        self.by_word = plain and merges and not spec["post_processor"] and {k: _settings(spec[k]) for k in BY_WORD} == BY_WORD
        #: Texts that lower-casing could change the ids of: combining marks compose with capitals, added tokens have exact names.
        self.exact = "|".join(["[\u0300-\u036f]", *(re.escape(t["content"]) for t in added)])

    def _texts(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of every word. A run of lower-case Latin letters is one unit of the model, so it skips the rest of the library."""
        out: list[bytes | None] = []
        for w in words:
            if w.isalpha() and max(w) < "\u0250" and w == w.lower():
                mapped = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
                out.append(np.array([t.id for t in self.model.tokenize(mapped)], self.width).tobytes())
            else:
                out.append(None)
        rest = iter(self._texts([w for w, o in zip(words, out, strict=True) if o is None]))
        return [next(rest) if o is None else o for o in out]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined, and how many each text has."""
        if not self.by_word:
            rows = self._texts(texts.to_pylist())
            return np.frombuffer(b"".join(rows), self.width), np.array([len(r) for r in rows], np.int64) // np.dtype(self.width).itemsize
        # Lower-casing ASCII and parting a comma or stop from the letter before it changes no id, and leaves
        # fewer distinct pieces.
        marked = pc.match_substring_regex(texts, self.exact, ignore_case=True)
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-zß-öø-ÿ])([.,])([ \n])", r"\1 \2\3")
        texts = pc.if_else(marked, texts, plain)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = [self.cache.get(w) for w in words]
        new = [i for i, got in enumerate(found) if got is None]
        for i, ids in zip(new, self.encode([words[i] for i in new]), strict=True):
            found[i] = ids
        if len(self.cache) < KEPT_WORDS:
            self.cache.update((words[i], found[i]) for i in new)
        unit = np.dtype(self.width).itemsize
        size = np.fromiter(map(len, found), np.int64, len(found)) // unit
        at = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(found), self.width)
        index = coded.indices.to_numpy(zero_copy_only=False)
        n, ends = size[index], np.cumsum(size[index])
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[index] - (ends - n), n)]
        words_upto = split.offsets.to_numpy()
        upto = np.concatenate(([0], ends))
        return ids, upto[words_upto[1:] - words_upto[0]] - upto[words_upto[:-1] - words_upto[0]]


_words: dict[str, Words] = {}


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian bytes, two or four an id) of each row, ``end_id`` last, rows kept in place."""

    def run(batches):
        if tokenizer not in _words:
            _words[tokenizer] = Words(tokenizer)
        words = _words[tokenizer]
        for batch in batches:
            for lo, hi, own in pieces(batch.column(1), PIECE):
                ids, counts = words(own)
                upto = np.concatenate(([0], np.cumsum(counts)))
                end = np.array([end_id], words.width).tobytes()
                rows = [ids[a:b].tobytes() + end for a, b in zip(upto[:-1], upto[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def ranks_of(ids: DataFrame, width: str, size: int) -> np.ndarray:
    """Rank of every id by falling count over all documents (ties: the smaller id first).

    Each task counts its ids; what reaches the driver is one row per id of the vocabulary.
    """

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            joined = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(joined, width), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(size, np.int64)
    n[counts["id"].to_numpy()] = counts["n"].to_numpy()
    rank = np.empty(size, np.uint32)
    rank[np.lexsort((np.arange(size), -n))] = np.arange(size, dtype=np.uint32)
    return rank


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write token files under ``path`` in ascending ``doc_id`` order (nulls first, ties by text).

    Null texts count as empty: just ``end_id``. No rows, no files but the list of them. Repeated rows are written as often as
    they occur; further columns of ``docs`` are not read. Files ``part-NNNNN.frv`` hold rising ranges of
    ``doc_id``; ``ranks.npy`` maps rank to id, ``files.parquet`` lists the files in order with their first id's place.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(end_id + 1, Tokenizer.from_file(tokenizer).get_vocab_size())
    width = "<u2" if size <= 1 << 16 else "<u4"
    raw = shared_dir(spark, "token-ids")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tokenised(ordered, tokenizer, end_id).write.option("compression", "zstd").parquet(raw)
    rank = ranks_of(spark.read.schema("doc_id long, ids binary").parquet(raw), width, size)
    ids_by_rank = np.argsort(rank).astype("<u4")
    put(f"{path}/ranks.npy", ids_by_rank.tobytes())
    spread = spark.sparkContext.broadcast(rank)

    def rewrite(batches):
        for batch in batches:
            for order, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out, total = f"{path}/part-{order:05d}.frv", [0, 0]

                def parts(name=name, total=total):
                    store, at = filesystem(name)
                    with store.open_input_file(at) as f:
                        for rows in pq.ParquetFile(f).iter_batches(512):
                            lengths = pc.binary_length(rows.column(1)).to_numpy(zero_copy_only=False) // np.dtype(width).itemsize
                            ids, first = rows.column(0).to_pylist(), 0
                            ends = np.cumsum(lengths)
                            while first < len(ids):
                                base = int(ends[first - 1]) if first else 0
                                last = max(first + 1, int(np.searchsorted(ends, base + BLOCK_IDS, "right")))
                                joined = np.frombuffer(b"".join(rows.column(1).slice(first, last - first).to_pylist()), width)
                                yield from block(ids[first:last], lengths[first:last], spread.value[joined])
                                total[0] += last - first
                                total[1] += len(joined)
                                first = last

                put(out, parts())
                yield pa.RecordBatch.from_arrays([pa.array([order]), pa.array([out]), pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.int64())], ["place", "file", "n_docs", "n_ids"])

    # Spark numbers part files by partition, and range partitions rise, so names sort as doc_ids do.
    names = sorted(x.getPath().toString() for x in _listed(spark, raw) if x.getPath().getName().startswith("part-"))
    rows = [(i, n) for i, n in enumerate(names)]
    files = spark.createDataFrame(rows, "place long, name string").repartition(max(1, len(rows)))
    done = files.mapInArrow(rewrite, "place long, file string, n_docs long, n_ids long")
    done.write.parquet(f"{path}/files.parquet")
    spread.unpersist()
    _delete(spark, raw)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files under ``path``: ``doc_id, start, n_tokens, ids`` (array of int), one task a file."""

    def decode(batches):
        store, at = filesystem(f"{path}/ranks.npy")
        with store.open_input_stream(at, compression=None) as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = filesystem(name)
                with store.open_input_stream(at, compression=None) as f:
                    for doc_ids, counts, ranks in blocks(f.read):
                        ends = np.cumsum(counts)
                        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(id_of[ranks].astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts), ids], ["doc_id", "start", "n_tokens", "ids"])
                        start += int(ends[-1]) if len(ends) else 0

    return _starts(spark, path).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_token_files``, with the checksum of each document's ids (unsigned 32-bit, little-endian) in their place."""

    def digest(batches):
        store, at = filesystem(f"{path}/ranks.npy")
        with store.open_input_stream(at, compression=None) as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = filesystem(name)
                with store.open_input_stream(at, compression=None) as f:
                    for doc_ids, counts, ranks in blocks(f.read):
                        data, ends = memoryview(id_of[ranks].tobytes()), np.cumsum(counts)
                        crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1]) if len(ends) else 0

    return _starts(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """File names with the ids before each; one row a file, so a prefix sum over them is a driver's matter."""
    schema = "place long, file string, n_docs long, n_ids long"
    rows, total, out = sorted(spark.read.schema(schema).parquet(f"{path}/files.parquet").collect()), 0, []
    for r in rows:
        out.append((r.file, total))
        total += r.n_ids
    return spark.createDataFrame(out, "file string, start long").repartition(max(1, len(out)))


def _listed(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
