"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the set of its runs of five words, each weighted by its damped count in the text and its rarity
in the corpus. Consistent weighted samples of two sets agree with the probability of their weighted Jaccard
similarity. Samples are banded; texts that share a band are candidates, and the similarity of a candidate
pair is worked out on the whole sets. Links of at least ``Near.least`` join texts to classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces, releasing
from .components import connected_components
from .fingerprints import U, mix
from .shared import discard, written
from .words import PIECE, WordBatch


@dataclass(frozen=True)
class Near:
    """``bands`` x ``rows`` samples: a pair at similarity 0.8 shares no band with probability (1-0.8^rows)^bands, 4 in 100,000.

    Document frequencies are counted for ``2^bucket_bits`` hash buckets, whatever the size of the corpus; a shingle
    in less than ``rare`` of all documents has full weight, twice that of one in all of them.
    """

    least: float = 0.8
    size: int = 5
    bands: int = 14
    rows: int = 3
    bucket_bits: int = 18
    rare: float = 1 / 256
    seed: int = 11
    block: int = 1024
    block_bytes: int = 48 << 20
    broadcast_ids: int = 200_000


#: Ranges of the shingles' hashes by which weights are summed to bound a pair's similarity.
RANGE_BITS = 8


# ---- weights ----------------------------------------------------------------------------------------
def _sets(texts: pa.Array, near: Near) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count) of every distinct shingle, by text and then shingle."""
    shingle, text = WordBatch(texts).shingles(near.size)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], shingle[at], np.diff(at, append=len(shingle))


def rarity(docs: DataFrame, near: Near) -> np.ndarray:
    """Weight from 1 to 2 of every bucket by its share of all documents; the table has a fixed size.

    Each task counts documents per bucket before anything is shuffled.
    """
    shift = U(64 - near.bucket_bits)

    def count(batches):
        total, n = np.zeros(1 << near.bucket_bits, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for lo, hi, own in pieces(batch.column(0), PIECE):
                text, shingle, _ = _sets(own, near)
                bucket = (shingle >> shift).astype(np.int64)
                pairs = np.unique(text << near.bucket_bits | bucket)
                total += np.bincount(pairs & ((1 << near.bucket_bits) - 1), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["bucket", "n"])

    sums = written(docs.select("text").mapInArrow(releasing(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "bucket-counts")
    n_docs = max(1, sums.filter("bucket = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    common = sums.filter((F.col("bucket") >= 0) & (F.col("n") > near.rare * n_docs)).toArrow()
    discard(sums)
    weight = np.full(1 << near.bucket_bits, 2.0, np.float32)
    share = np.minimum(common["n"].to_numpy() / n_docs, 1.0)
    weight[common["bucket"].to_numpy()] = 1 + np.minimum(1.0, np.log(share) / np.log(near.rare))
    if n_docs * near.rare < 1:  # so few documents that one is not rare: every bucket starts at one document's share
        weight[weight == 2] = 1 + np.log(1 / n_docs) / np.log(near.rare)
    return weight


def _weights(shingle: np.ndarray, count: np.ndarray, rare: np.ndarray, near: Near) -> np.ndarray:
    return (1 + np.log(count, dtype=np.float32)) * rare[(shingle >> U(64 - near.bucket_bits)).astype(np.int64)]


# ---- samples ----------------------------------------------------------------------------------------
class Sampler:
    """Consistent weighted samples. The random r, c (gamma) and beta (uniform) of a shingle and a sample come from
    a table of 2^16 rows that the product of the shingle with the sample's odd number picks; lower bits of the
    product break ties between shingles that pick one row, and name the shingle."""

    def __init__(self, near: Near):
        g = np.random.default_rng(near.seed)
        r, c, beta = g.gamma(2, 1, 1 << 16), g.gamma(2, 1, 1 << 16), g.random(1 << 16)
        self.inverse, self.beta, self.r = (1 / r).astype(np.float32), beta.astype(np.float32), r.astype(np.float32)
        self.a = (np.log(c) - r + r * beta).astype(np.float32)
        self.odd = g.integers(0, 1 << 63, near.bands * near.rows, dtype=np.int64).astype(U) * U(2) + U(1)
        self.near, self.tables = near, {}

    def _keys(self, log_weight, row) -> np.ndarray:
        """ln of the sampling value of each table row at a weight, as an order-keeping 32-bit key in the upper half."""
        t = np.floor(log_weight * self.inverse[row] + self.beta[row])
        value = self.a[row] - self.r[row] * t
        bits = value.astype(np.float32).view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        return ordered.astype(U) << U(32)

    def __call__(self, shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (sets x samples, 64-bit) of the non-empty sets that begin at ``starts``."""
        log_weight = np.log(weight)
        usual = float(np.median(log_weight[: 1 << 16])) if len(log_weight) else 0.0
        usual = np.float32(usual)
        if usual not in self.tables:
            if len(self.tables) > 64:
                self.tables.clear()
            self.tables[usual] = self._keys(usual, np.arange(1 << 16))
        table, other = self.tables[usual], np.flatnonzero(log_weight != usual)
        out = np.empty((len(starts), len(self.odd)), U)
        for k, odd in enumerate(self.odd):
            product = shingle * odd
            row = (product >> U(48)).astype(np.int64)
            key = table[row]
            key[other] = self._keys(log_weight[other], row[other])
            key |= (product >> U(16)) & U(0xFFFFFFFF)
            out[:, k] = np.minimum.reduceat(key, starts)
        return out


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _signatures(docs: DataFrame, rare: np.ndarray, near: Near) -> DataFrame:
    """``doc_id, hash, key, bands, samples`` of every row; equal sets have equal keys, texts without words equal keys if equal."""
    spread = docs.sparkSession.sparkContext.broadcast(rare)

    def run(batches):
        sampler = Sampler(near)
        for batch in batches:
            for lo, hi, own in pieces(batch.column(1), PIECE):
                text, shingle, count = _sets(own, near)
                weight = _weights(shingle, count, spread.value, near)
                full, starts = np.unique(text, return_index=True)
                n = hi - lo
                keys, bands, small = [b""] * n, [None] * n, [None] * n
                if len(full):
                    samples = sampler(shingle, weight, starts)
                    once = mix(shingle) * count.astype(U)
                    sums = np.stack([np.add.reduceat(once, starts), np.add.reduceat(mix(once + U(1)), starts)], 1)
                    mixed = np.zeros((len(full), near.bands), U)
                    for j in range(near.rows):
                        mixed = mix(mixed ^ samples[:, j :: near.rows]) * U(0xD1342543DE82EF95)
                    mixed = mix(mixed + np.arange(near.bands, dtype=U)).view(np.int64)
                    short = mix(samples).astype(np.uint32)
                    for i, t in enumerate(full.tolist()):
                        keys[t], bands[t], small[t] = sums[i].tobytes(), mixed[i], short[i].tobytes()
                for t in np.setdiff1d(np.arange(n), full).tolist():
                    keys[t] = b"text" + hashlib.blake2b(own[t].as_py().encode(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.binary())], ["doc_id", "hash", "key", "bands", "samples"])

    return docs.select("doc_id", "text", _text_hash("text").alias("hash")).mapInArrow(releasing(run), "doc_id long, hash long, key binary, bands array<long>, samples binary")


# ---- verification -----------------------------------------------------------------------------------
def _candidate_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, rare: np.ndarray, near: Near) -> DataFrame:
    """``node, shingles, weights`` of every node in ``wanted``, written once; arrays are packed and sorted by shingle.

    ``nodes`` names a row of each node by id and hash of its text, since one id may have several texts. Of rows that are equal in
    both, which have equal sets, one is kept; ids with one row need no look for that.
    """
    spread = docs.sparkSession.sparkContext.broadcast(rare)
    ids = written(wanted.join(nodes, "node").select("node", "doc_id", "hash", "repeated"), "candidates")
    few = ids.count() <= near.broadcast_ids
    texts = docs.withColumn("hash", _text_hash("text")).join(F.broadcast(ids) if few else ids, ["doc_id", "hash"])
    once = texts.filter("not repeated").select("node", "text")
    if not ids.filter("repeated").isEmpty():
        once = once.unionByName(texts.filter("repeated").groupBy("node").agg(F.first("text").alias("text")))

    def sets(batches):
        for batch in batches:
            for lo, hi, own in pieces(batch.column(1), PIECE):
                text, shingle, count = _sets(own, near)
                weight = _weights(shingle, count, spread.value, near)
                at = np.searchsorted(text, np.arange(hi - lo + 1))
                rows = [(shingle[x:y].tobytes(), weight[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["node", "shingles", "weights"])

    out = written(once.mapInArrow(releasing(sets), "node long, shingles binary, weights binary"), "candidate-sets", "lz4")
    discard(ids)
    return out


def _alike(x: np.ndarray, u: np.ndarray, y: np.ndarray, v: np.ndarray, least: float) -> bool:
    """Whether two weighted sets (sorted shingles and their weights) have a Jaccard similarity of at least ``least``."""
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = x[at] == y
    shared = np.minimum(u[at[both]], v[both]).sum(dtype=float)
    return bool(shared >= least * (u.sum(dtype=float) + v.sum(dtype=float) - shared) - 1e-9)


def _verified(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """``a, b`` of the pairs whose whole weighted sets are alike enough."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_s"), F.col("weights").alias(f"{c}_w")) for c in "ab")
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")

    def similar(batches):
        for batch in batches:
            read = lambda c, i, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)
            keep = [_alike(read("a_s", i, U), read("a_w", i, np.float32), read("b_s", i, U), read("b_w", i, np.float32), near.least) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "a_s", "a_w", "b_s", "b_w").mapInArrow(releasing(similar), "a long, b long").distinct()


def _groups(batches, n_keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal first ``n_keys`` columns, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
        cut = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if keys[lo] != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.Table.from_batches(held)


def _rest(members: DataFrame, known: DataFrame, labels: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """``a, b``: links between different components of one band, which the band's head doesn't show.

    ``members``: band, its size ``n``, its place among the node's bands, node; ``known``: node, bands, samples. Bands of two have been tried. Larger ones are
    dealt to blocks, small in rows and bytes, and pairs of blocks are compared, so no task holds a whole band. Within a pair
    of blocks the first band that two nodes share decides on them. Pairs whose weights, in all or summed by ranges of the
    shingles, bound their similarity below ``least`` are passed over; of all others the whole sets are compared in place, those
    with most equal samples first. What comes out is links, at most one for a node and a component.
    """
    marked = members.filter("n > 2").select("band", "place", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = marked.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    rows = written(marked.join(mixed, "band"), "mixed").join(known.join(sets.hint("merge"), "node").hint("merge"), "node")
    size = rows.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / near.block), F.ceil(F.sum(F.octet_length("shingles")) / near.block_bytes)).cast("int").alias("blocks"))
    rows = rows.join(size, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets every block once: with the smaller number first
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "place", "node", "component", "bands", "samples", "shingles", "weights")
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def compare(batches):
        for g in _groups(batches, 3):
            i, j, place = g["i"][0].as_py(), g["j"][0].as_py(), g["place"][0].as_py()
            own, node, part = g["own"].to_numpy(), g["node"].to_numpy(), g["component"].to_numpy()
            if len(set(part.tolist())) < 2:
                continue
            samples = np.frombuffer(b"".join(g["samples"].to_pylist()), np.uint32).reshape(len(node), -1)
            bands = g["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)[:, :place]
            sets_ = [np.frombuffer(b, U) for b in g["shingles"].to_pylist()]
            weights = [np.frombuffer(b, np.float32) for b in g["weights"].to_pylist()]
            size = [len(w) for w in weights]
            joined, owner = np.concatenate(weights), np.repeat(np.arange(len(node)), size)
            place_of = (np.concatenate(sets_) >> U(64 - RANGE_BITS)).astype(np.int64)
            ranges = np.bincount(owner << RANGE_BITS | place_of, joined, len(node) << RANGE_BITS).reshape(len(node), -1).astype(np.float32)
            total = np.bincount(owner, joined, len(node))
            share = near.least / (1 + near.least)  # of both weights, that the smaller weights of shared shingles have to sum up to
            out_a, out_b = [], []
            for x in np.flatnonzero(own == i).tolist():
                ys = np.flatnonzero((own == j) & (part != part[x]) & ((node > node[x]) if i == j else True))
                ys = ys[np.minimum(total[ys], total[x]) >= near.least * np.maximum(total[ys], total[x]) * (1 - 1e-5)]
                ys = ys[~(bands[ys] == bands[x]).any(axis=1)]
                ys = ys[np.minimum(ranges[ys], ranges[x]).sum(axis=1) >= share * (total[ys] + total[x]) * (1 - 1e-5)]
                score = (samples[ys] == samples[x]).mean(axis=1)
                linked = set()
                for y in ys[np.argsort(-score, kind="stable")].tolist():
                    if part[y] not in linked and _alike(sets_[x], weights[x], sets_[y], weights[y], near.least):
                        linked.add(part[y])
                        out_a.append(min(node[x], node[y]))
                        out_b.append(max(node[x], node[y]))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(releasing(compare), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, near: Near = Near(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id`` of every row: the smallest id of its class.

    Rows with equal shingle sets are one class from the start; what is compared then is one of each. Texts with
    fewer than five words are one shingle of all their words; texts without words (null, empty, only
    punctuation) are alike only if equal. Rows without an id take the class of their copies, or null. Rows that
    repeat an id have the class of their own text each; where unlike texts share an id that is the smallest of both their
    classes, these have one name. An empty table gives an empty one; further columns are not read.
    """
    return _classes(docs, near, doc_id, text).select("doc_id", "class_id")


def _classes(docs: DataFrame, near: Near, doc_id: str, text: str) -> DataFrame:
    """``doc_id, hash, class_id, component`` of every row; ``hash`` is that of its text, ``component`` the number of its class.

    What is compared and linked are distinct sets, each with a number of its own, so texts that share an id are told apart; a class
    gets its smallest id at the end.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rare = rarity(source, near)
    signed = written(_signatures(source, rare, near), "signatures")
    # equal sets have equal bands and samples, so any row's will do; tasks reduce before the shuffle
    sets = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by("hash", "doc_id").alias("hash"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("samples").alias("samples"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    nodes = sets.select("node", "doc_id", "hash", (F.col("n") > 1).alias("repeated"))
    members = sets.filter("doc_id is not null and bands is not null").select(F.posexplode("bands").alias("place", "band"), "node")
    # of a band's nodes the one that shares its bands with most others is its head, so a group's bands have few heads and links
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(members.join(sizes, "band"), "shared-bands")
    shared = members.groupBy("node").agg(F.sum("n").alias("shared"))
    heads = members.join(shared, "node").groupBy("band").agg(F.min(F.struct((-F.col("shared")).alias("first"), "node"))["node"].alias("a"))
    # a head stands in its own star, so the stars' second nodes are all candidates
    stars = written(members.select("band", F.col("node").alias("b")).join(heads, "band").select("a", "b").distinct(), "stars")
    packed = _candidate_sets(stars.select(F.col("b").alias("node")).distinct(), nodes, source, rare, near)
    links = written(_verified(stars.filter("a <> b"), packed, near), "links")
    labels = connected_components(links)
    rest = written(_rest(members, sets.select("node", "bands", "samples"), labels, packed, near), "rest")
    found = connected_components(links.unionByName(rest))
    discard(stars, packed, labels, rest, links, members)
    # only classes of several sets need their smallest id looked for
    linked = written(sets.select("key", "node", "doc_id").join(found, "node"), "linked")
    discard(found)
    least = linked.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    several = linked.join(least, "component").select("key", "component", "class_id")
    single = sets.join(linked.select("node"), "node", "left_anti").select("key", F.col("node").alias("component"), F.col("doc_id").alias("class_id"))
    return signed.select("doc_id", "hash", "key").join(several.unionByName(single), "key").select("doc_id", "hash", "class_id", "component")


def one_of_each(docs: DataFrame, near: Near = Near(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every class: that of the smallest id (of several texts of the class with this id, one; of equal rows, one).

    Unlike texts that share an id are classes of their own and stay. Of rows without an id, those whose class has one go, and equal
    texts among the others are kept once.
    """
    found = written(_classes(docs, near, doc_id, text), "classes")
    each = found.filter("doc_id is not null").groupBy("doc_id", "hash").agg(F.count("*").alias("n"), F.first("component").alias("component"))
    each = written(each, "texts")
    first = each.groupBy("component").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    # a class of one text loses nothing
    gone = each.join(first, "component").filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("hash") != F.col("first.hash")))
    gone = written(gone.select(F.col("doc_id").alias("__gone"), F.col("hash").alias("__hash")), "gone")
    key = F.col(doc_id).cast("long")
    kept = docs.filter(key.isNotNull()).join(F.broadcast(gone) if gone.count() <= near.broadcast_ids else gone, (key == F.col("__gone")) & (_text_hash(text) == F.col("__hash")), "left_anti")
    if not each.filter("n > 1").isEmpty():
        kept = kept.withColumn("__hash", _text_hash(text)).dropDuplicates([doc_id, "__hash"]).drop("__hash")
    if not found.filter("doc_id is null").isEmpty():
        named = docs.filter(key.isNotNull()).select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__h")).distinct()
        nameless = docs.filter(key.isNull()).withColumn("__h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(named, "__h", "left_anti")
        kept = kept.unionByName(nameless.dropDuplicates(["__h"]).drop("__h"))
    discard(found, each)
    return kept
