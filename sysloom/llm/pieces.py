"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text is written with the word-start mark for every space and one before the text, then cut into units
where no piece of the vocabulary can cross. The distinct units of a batch that have equal length form a
matrix of characters and advance together: hashes of their substrings probe the sorted keys of the pieces,
and vectorised maxima over the pieces ending at each place store backpointers.

What is maximal depends on the model's type. In a unigram model it is the sum of the pieces' scores. In a merge
(BPE) model scores are merge ranks and no sum: a segmentation is what merging yields exactly if each of its
pairs of neighbours is what merging their joined text yields. So a step from one piece to the next is open only
for such pairs, and the one path of open steps is the library's own segmentation.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces as cut
from .batches import releasing

#: Text bytes encoded at once, ids decoded at once, characters in one matrix, units kept between batches of a worker.
PIECE, IDS, CELLS, KEPT_UNITS = 3 << 19, 1 << 19, 1 << 17, 100_000
#: Longer units are not kept.
LONG = 48
#: Parts advance together as rows of a matrix if at least so many have one length and it is at most so long; others are walked through
#: by themselves, so many characters at a time, and keep so many pairs of pieces.
ROWS, WIDTH, STRETCH, KEPT_PAIRS = 128, 256, 1 << 14, 1 << 17
NOWHERE = -2
MARK = "▁"
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: How far below the worst piece an unknown character scores in a unigram model, as the library has it.
UNKNOWN_PENALTY = 10.0
#: Fixed values of the published model format: types of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.int64(1) << 40


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _hashes(chars: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row: column j holds that of the first j characters (arithmetic modulo 2^64)."""
    out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    for j in range(chars.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + (chars[:, j].astype(np.uint64) + np.uint64(1)) * SPREAD
    return out


class Model:
    """The pieces of a SentencePiece file as sorted keys.

    Text has to come as it is: a file with a normaliser,
    without the mark before a text, without byte pieces or with user-defined pieces is refused.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer, normalizer = (dict(_fields(b"".join(v for k, v in top if k == n))) for n in (2, 3))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a merge model")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("a model that rewrites texts; only the identity with a mark before each text is supported")
        rows = []  # name, score, type
        for k, v in top:
            if k == 1:
                p = dict(_fields(v))
                rows.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        if any(t == USER_DEFINED for _, _, t in rows) or sum(t == BYTE for _, _, t in rows) != 256:
            raise ValueError("user-defined pieces, or no byte pieces")
        surface = [bytes([int(n[3:5], 16)]) if t == BYTE else n.replace(MARK, " ").encode() if t == NORMAL else b"" for n, _, t in rows]
        self.byte_id = np.zeros(256, np.int32)
        for i, (n, _, t) in enumerate(rows):
            if t == BYTE:
                self.byte_id[int(n[3:5], 16)] = i
        #: All surfaces in one table, for decoding.
        self.size = np.array([len(s) for s in surface], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(surface), np.uint8)

        named = {n: (i, s) for i, (n, s, t) in enumerate(rows) if t == NORMAL and n}
        letters = sorted({c for n in named for c in n})
        names = letters + sorted(n for n in named if len(n) > 1)
        self.longest = max(map(len, names))
        lowest = min(s for _, s in named.values())
        self.ids = np.array([named[n][0] if n in named else -1 for n in names], np.int32)  # -1: a character by its bytes
        self.unknown = lowest - UNKNOWN_PENALTY
        self.scores = np.array([named[n][1] if n in named else self.unknown for n in names])
        self.lengths = np.array([len(n) for n in names])
        self.powers = np.array([pow(int(BASE), k, 1 << 64) for k in range(2 * self.longest + 1)], np.uint64)
        key = np.zeros(len(names), np.uint64)
        for length in set(self.lengths.tolist()):
            at = np.flatnonzero(self.lengths == length)
            key[at] = _hashes(np.array([[ord(c) for c in names[i]] for i in at], np.uint32))[:, length]
        self.key = key
        self.order = np.argsort(key)
        self.sorted = key[self.order]
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two pieces share a key")
        self.begun = np.zeros(1 << 21, bool)  # first bits that some key has; few probes get past them
        self.begun[(key >> np.uint64(43)).astype(np.int64)] = True
        if self.kind == BPE:
            self._splits(names, {n: s for n, (_, s) in named.items()})
        else:
            self.usable = np.ones(len(names), bool)
        # A unit may end before a mark that follows another character, and around line ends, unless a piece crosses there.
        if any(re.search(f"[^{MARK}]{MARK}", n) for n in names):
            raise ValueError("a piece of this vocabulary crosses words")
        self.lines = not any("\n" in n for n in names if len(n) > 1)
        self.joins = np.unique(np.array([ord(a) << 21 | ord(b) for n in names for a, b in zip(n[:-1], n[1:], strict=True)], np.int64))
        self.kept: dict[str, bytes] = {}
        self.parts_kept: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _splits(self, names: list[str], score: dict[str, float]) -> None:
        """The two pieces whose merge makes each piece; pieces that merging their own text does not yield are never used."""
        number = {n: i for i, n in enumerate(names)}
        self.left, self.right = np.arange(len(names)), np.arange(len(names))
        #: Turn of each piece's last merge; single characters come before all, equal scores have equal turns.
        self.turn = np.where(self.lengths > 1, np.unique(-self.scores, return_inverse=True)[1] + 1, 0)
        self.usable = np.ones(len(names), bool)
        for n in names:
            if len(n) > 1:
                parts = merged(n, score, until=2)
                if len(parts) == 2 and parts[0] in number and parts[1] in number:
                    self.left[number[n]], self.right[number[n]] = number[parts[0]], number[parts[1]]
                else:
                    self.usable[number[n]] = False

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Number of the piece of each key, ``NONE`` without one."""
        out = np.full(len(key), NONE)
        some = np.flatnonzero(self.begun[(key >> np.uint64(43)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, key[some]), len(self.sorted) - 1)
        hit = self.sorted[at] == key[some]
        out[some[hit]] = self.order[at[hit]]
        return out

    def _open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined texts of the pieces ``a`` and ``b`` leaves just these two (below 0: no piece, always open).

        Merges are undone from the latest one at the seam; the pair is broken if a merge across the seam would have come before.
        """
        ok, act = np.ones(len(a), bool), np.flatnonzero((a >= 0) & (b >= 0))
        a, b, limit = a[act], b[act], np.full(len(act), NONE)
        while len(act):
            length = self.lengths[b]
            across = self._find(self.key[a] * self.powers[length] + self.key[b])
            known = (across < NONE) & (self.lengths[a] + length <= self.longest)
            broken = known & (self.turn[np.where(known, across, 0)] < limit)
            ok[act[broken]] = False
            from_a, from_b = self.right[a] != a, self.left[b] != b
            use_a = from_a & ((self.turn[a] > self.turn[b]) | ~from_b)
            go = ~broken & (from_a | from_b)
            limit = np.where(use_a, self.turn[a], self.turn[b] + 1)[go]  # of equal turns the left one comes first
            a, b, act = np.where(use_a, self.right[a], a)[go], np.where(use_a, b, self.left[b])[go], act[go]
        return ok

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of each unit. Units are cut wherever no piece holds the two characters side by side (around
        line ends, before most marks and punctuation), and the distinct parts of all of them are searched together."""
        if not units:
            return []
        joined = "".join(units)
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum([len(u) for u in units])
        pair = c[:-1] << 21 | c[1:]
        near = np.minimum(np.searchsorted(self.joins, pair), len(self.joins) - 1)
        apart = self.joins[near] != pair if len(self.joins) else np.ones(len(pair), bool)
        apart = np.append(apart, True)
        apart[ends - 1] = True
        stop = np.flatnonzero(apart) + 1
        parts = [joined[x:y] for x, y in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
        index: dict[str, int] = {}
        of = np.array([index.setdefault(p, len(index)) for p in parts], np.int64)
        names, found = list(index), [self.parts_kept.get(p) for p in index]
        by_length = defaultdict(list)
        for i, (p, f) in enumerate(zip(names, found, strict=True)):
            if f is None:
                by_length[len(p)].append(i)
        if len(self.parts_kept) > KEPT_UNITS:
            self.parts_kept.clear()
        few = [i for length, own in by_length.items() if len(own) < ROWS or length > WIDTH for i in own]
        for i, ids in zip(few, self._walk([names[i] for i in few]), strict=True):
            found[i] = ids
            if len(names[i]) <= LONG:
                self.parts_kept[names[i]] = ids
        for length, own in by_length.items():
            if len(own) < ROWS or length > WIDTH:
                continue
            step = max(1, CELLS // length)
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                for i, ids in zip(some, self._equal("".join([names[i] for i in some]), length), strict=True):
                    found[i] = ids
                    if length <= LONG:
                        self.parts_kept[names[i]] = ids
        last = np.searchsorted(stop, ends, "right")
        lists = [found[i] for i in of.tolist()]
        return [lists[x] if y - x == 1 else b"".join(lists[x:y]) for x, y in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]

    def _equal(self, joined: str, length: int) -> list[bytes]:
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)
        n = len(chars)
        prefix = _hashes(chars)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), np.int32)
        piece = np.full((n, length + 1), -1, np.int64)  # -1: no piece, a character by its bytes
        for end in range(1, length + 1):
            found = []
            for size in range(min(end, self.longest), 0, -1):
                at = self._find(prefix[:, end] - prefix[:, end - size] * self.powers[size])
                rows = np.flatnonzero(at < NONE)
                rows = rows[self.usable[at[rows]] & (best[rows, end - size] > -np.inf)]
                found.append((rows, np.full(len(rows), end - size), at[rows]))
                if size == 1:
                    rest = np.flatnonzero((at == NONE) & (best[:, end - 1] > -np.inf))
                    found.append((rest, np.full(len(rest), end - 1), np.full(len(rest), -1)))
            row, start, which = (np.concatenate(c) for c in zip(*found, strict=True))
            if self.kind == BPE:
                ok = self._open(np.where(start > 0, piece[row, start], -1), which)
                row, start, which = row[ok], start[ok], which[ok]
                total = np.zeros(len(row))
            else:
                total = best[row, start] + np.where(which < 0, self.unknown, self.scores[which])
            # the highest total of each row; ties go to the longest piece, which stands first
            order = np.lexsort((-total, row))
            order = order[np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])] if len(order) else order
            best[row[order], end], back[row[order], end], piece[row[order], end] = total[order], start[order], which[order]
        return self._paths(chars, back, np.where(piece < 0, -1, self.ids[piece]))

    def _candidates(self, value: np.ndarray, part: np.ndarray, room: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, piece) of all pieces that end at a character from ``lo`` to ``hi``, by end, longest first; -1: no piece. Places count
        one more a part than characters."""
        key, out = np.zeros(hi - lo, np.uint64), []
        at = np.arange(lo, hi)
        for size in range(1, self.longest + 1):
            at = at[room[at] >= size]
            if not len(at):
                break
            key[at - lo] += value[at - size + 1] * self.powers[size - 1]
            which = self._find(key[at - lo])
            if size == 1:
                which[which == NONE] = -1
            hit = (which < NONE) & self.usable[np.where(which < NONE, which, 0)]
            end = at[hit] + part[at[hit]] + 1
            out.append((end, end - size, which[hit]))
        end, start, which = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((start, end))
        return end[order], start[order], which[order]

    def _learn_pairs(self, end: np.ndarray, start: np.ndarray, which: np.ndarray) -> None:
        """Decide on all pairs of neighbours among pieces that are sorted by ``end``, those that are not known yet in one call."""
        real = which >= 0
        end, start, which = end[real], start[real], which[real]
        lo, hi = np.searchsorted(end, start, "left"), np.searchsorted(end, start, "right")
        n = hi - lo
        before = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        codes = np.unique(which[before] * len(self.lengths) + np.repeat(which, n)).tolist()
        new = np.array([c for c in codes if c not in self.pairs], np.int64)
        if len(new):
            self.pairs.update(zip(new.tolist(), self._open(new // len(self.lengths), new % len(self.lengths)).tolist(), strict=True))

    def _walk(self, parts: list[str]) -> list[bytes]:
        """As ``_equal``, for parts of any lengths: pieces and open pairs are found for a stretch of characters at once, and
        the maxima are taken place by place. A part of any length takes time in proportion to it."""
        if not parts:
            return []
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        part = np.repeat(np.arange(len(parts)), size)
        begin = np.cumsum(size) - size
        room = np.arange(len(chars)) - begin[part] + 1
        value = (chars.astype(np.uint64) + np.uint64(1)) * SPREAD
        first = (begin + np.arange(len(parts))).tolist()
        last, back = array("q", [NOWHERE]) * (len(chars) + len(parts)), array("q", [0]) * (len(chars) + len(parts))
        best = array("d", [0.0]) * len(last) if self.kind == UNIGRAM else None
        for f in first:
            last[f] = -1
        for lo in range(0, len(chars), STRETCH):
            hi = min(len(chars), lo + STRETCH)
            end, start, which = self._candidates(value, part, room, lo, hi)
            steps = zip(end.tolist(), start.tolist(), which.tolist(), strict=True)
            if self.kind == UNIGRAM:
                score = np.where(which < 0, self.unknown, self.scores[which]).tolist()
                for (e, s, p), x in zip(steps, score, strict=True):
                    if last[s] != NOWHERE and (last[e] == NOWHERE or best[s] + x > best[e]):
                        last[e], back[e], best[e] = p, s, best[s] + x
                continue
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            here = lo + int(part[lo])
            tail = [q for q in range(max(0, here - self.longest), here + 1) if last[q] >= 0]
            self._learn_pairs(np.append(tail, end).astype(np.int64), np.append(np.full(len(tail), -1), start).astype(np.int64), np.append([last[q] for q in tail], which).astype(np.int64))
            known, n = self.pairs, len(self.lengths)
            for e, s, p in steps:
                if last[e] == NOWHERE:
                    a = last[s]
                    if a != NOWHERE and (a < 0 or p < 0 or known[a * n + p]):
                        last[e], back[e] = p, s
        out = []
        for f, b, k in zip(first, begin.tolist(), size.tolist(), strict=True):
            ids, at = [], f + k
            while at > f:
                if last[at] < 0 or self.ids[last[at]] < 0:
                    ids += reversed(self.byte_id[np.frombuffer(chr(chars[b + at - f - 1]).encode("utf-8", "surrogatepass"), np.uint8)].tolist())
                else:
                    ids.append(self.ids[last[at]])
                at = back[at]
            out.append(np.array(ids[::-1], "<i4").tobytes())
        return out

    def _paths(self, chars: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[bytes]:
        n, length = chars.shape
        rows, at = np.arange(n), np.full(n, length)
        steps = []  # (rows, end, piece) from the last token to the first
        while len(rows):
            steps.append((rows, at, piece[rows, at]))
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        row = np.concatenate([s[0] for s in steps])
        end = np.concatenate([s[1] for s in steps])
        ids = np.concatenate([s[2] for s in steps])
        order = np.lexsort((end, row))
        row, end, ids = row[order], end[order], ids[order]
        if (ids < 0).any():
            text = chars[row, end - 1]
            parts = [self.byte_id[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] if i < 0 else [i] for i, c in zip(ids.tolist(), text.tolist(), strict=True)]
            row = np.repeat(row, [len(p) for p in parts])
            ids = np.concatenate(parts).astype(np.int32)
        ends = np.cumsum(np.bincount(row, minlength=n)) * 4
        flat = ids.astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined, and how many each has (the empty text none). ``texts``: large_string without nulls.

        Between spaces a text falls into words; a word and the empty ones before it (further spaces) make a unit.
        """
        marked = pc.replace_substring(texts, MARK, " ")
        if self.lines:
            marked = pc.replace_substring(marked, "\n", " \n")  # a word that starts with a line end has no mark of its own
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        upto = split.offsets.to_numpy() - split.offsets[0].as_py()
        full = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        empty = np.array([not w for w in words], bool)[index]
        last = np.zeros(len(index), bool)
        last[upto[1:] - 1] = full
        at = np.flatnonzero(~empty | last)  # the last word of each unit
        text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, upto)))
        gap = at - np.maximum(upto[text], np.concatenate(([0], at[:-1] + 1))) if len(at) else at
        # a word alone is a unit of its own; words after further spaces are listed behind them
        found = list(map(self.kept.get, words))
        new = [i for i, f in enumerate(found) if f is None]
        wide = np.flatnonzero(gap)
        pair, unit = np.unique(gap[wide] * np.int64(len(words) + 1) + index[at[wide]], return_inverse=True)
        of = index[at].astype(np.int64)
        of[wide] = len(words) + unit
        marked_words = [words[i] if self.lines and words[i].startswith("\n") else MARK + words[i] for i in new]
        for g, i in zip((pair // (len(words) + 1)).tolist(), (pair % (len(words) + 1)).tolist(), strict=True):
            marked_words.append(MARK * (g if self.lines and words[i].startswith("\n") else g + 1) + words[i])
        got = self.encode_units(marked_words)
        if len(self.kept) > KEPT_UNITS:
            self.kept.clear()
        for i, ids in zip(new, got, strict=False):
            found[i] = ids
            if len(words[i]) <= LONG:
                self.kept[words[i]] = ids
        found += got[len(new) :]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(found), "<i4")
        n = size[of]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[of] - (ends - n), n)]
        return ids, np.bincount(text, n, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts again (large_string), without the space that encoding set before each; bytes that are no UTF-8 are replaced."""
        n = self.size[ids]
        ends = np.cumsum(n)
        data = self.table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.place[ids] - (ends - n), n)]
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        first = upto[:-1][upto[1:] > upto[:-1]]
        keep = np.ones(len(data), bool)
        keep[first[data[first] == 32]] = False
        upto = np.concatenate(([0], np.cumsum(keep)))[upto]
        data = data[keep].tobytes()
        out = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(data)])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.large_string())
        return out


def merged(text: str, score: dict[str, float], until: int = 1) -> list[str]:
    """What merging leaves of ``text``, best-scored neighbours first (ties: the leftmost), or its last ``until`` parts."""
    parts = list(text)
    while len(parts) > until:
        pairs = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in score]
        if not pairs:
            break
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


_models: dict[str, Model] = {}


def _model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids, n_tokens`` of every row of ``docs`` under the pieces of ``model``, a unigram or merge model; with
    ``decoded`` also the ``text`` that the ids decode to, without a second pass.

    ``ids`` are those that the library gives; characters without a piece become their UTF-8 bytes. (In a unigram model, of
    segmentations with equal scores that with the longest last piece is taken.) Null and empty texts have no ids; repeated
    rows and null ids are kept; an empty table gives an empty one; further columns are not read.
    """

    def run(batches):
        m = _model(model)
        for batch in batches:
            for lo, hi, own in cut(batch.column(1), PIECE):
                ids, counts = m.encode(own)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids))
                columns = {"doc_id": batch.column(0).slice(lo, hi - lo), "ids": lists, "n_tokens": pa.array(counts)}
                if decoded:
                    columns["text"] = m.decode(ids, counts).cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), "doc_id long, ids array<int>, n_tokens long" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``doc_id, text`` of every row of ids, and the columns that ``keep`` names. Null ids decode to the empty text.

    Encoding and decoding give every text back, save that a literal word-start mark returns as a space.
    """
    rows = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"), *keep)
    kept = [f for f in rows.schema.fields if f.name in keep]
    schema = ", ".join(["doc_id long", "text string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])

    def run(batches):
        m = _model(model)
        for batch in batches:
            counts = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, lo = np.cumsum(counts), 0
            while lo < len(counts):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - counts[lo] + IDS, "right")))
                some = batch.slice(lo, hi - lo)
                texts = m.decode(some.column(1).flatten().to_numpy(zero_copy_only=False), counts[lo:hi])
                yield pa.RecordBatch.from_arrays([some.column(0), texts.cast(pa.string()), *some.columns[2:]], ["doc_id", "text", *(f.name for f in kept)])
                lo = hi

    return rows.mapInArrow(releasing(run), schema)
