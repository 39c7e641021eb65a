"""Token counts by a linear longest-match automaton.

A trie holds the vocabulary. Every node has a failure link and the number of tokens that following it
pops; both are worked out once, breadth first. Counting then reads each character of a word once and
follows links where the trie has no edge, which takes time linear in the word's length, and never
builds a piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces

PIECE, KEPT_WORDS = 4 << 20, 400_000
#: Written before each word, as the piece vocabularies do.
WORD_START = "▁"


class Automaton:
    """Greedy longest-match token counts of words over ``vocabulary``.

    A character that no piece covers at its place counts one token per UTF-8 byte (byte fallback). To keep
    every link defined, such characters stand in the trie as pieces of that cost.
    """

    def __init__(self, vocabulary: Iterable[str]):
        cost: dict[str, int] = {p: 1 for p in vocabulary if p}
        for c in {c for p in cost for c in p}:
            cost.setdefault(c, len(c.encode("utf-8", "surrogatepass")))
        self.edges: list[dict[str, int]] = [{}]
        ends = [0]
        for piece, tokens in cost.items():
            at = 0
            for c in piece:
                if (to := self.edges[at].get(c)) is None:
                    to = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    ends.append(0)
                at = to
            ends[at] = tokens
        self.fail, self.popped = [0] * len(ends), [0] * len(ends)
        queue = deque((0, c, v) for c, v in self.edges[0].items())
        while queue:
            parent, c, v = queue.popleft()
            if ends[v]:  # the node is a piece: pop it and go on from the root
                self.popped[v] = ends[v]
            else:  # pop what the parent pops, then as long as the edge is missing
                z, n = self.fail[parent], self.popped[parent]
                while c not in self.edges[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                self.fail[v], self.popped[v] = self.edges[z][c], n
            queue.extend((v, d, w) for d, w in self.edges[v].items())

    def count(self, word: str) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        at = n = 0
        for c in word:
            while (to := edges[at].get(c)) is None:
                if not at:  # a character that the vocabulary lacks
                    n += len(c.encode("utf-8", "surrogatepass"))
                    break
                n += popped[at]
                at = fail[at]
            else:
                at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


_automata: dict[str, tuple[Automaton, dict[str, int]]] = {}


def _loaded(model: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a piece model and its worker's cache of frequent words; built once a worker."""
    if model not in _automata:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        normal = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
        _automata[model] = Automaton(normal), {}
    return _automata[model]


def counts_of(texts: pa.Array, automaton: Automaton, kept: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text; each distinct word of the batch is counted once."""
    split = pc.utf8_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words, tokens, new = coded.dictionary.to_pylist(), [], {}
    for w in words:
        n = kept.get(w)
        if n is None:
            n = new[w] = automaton.count(WORD_START + w) if w else 0
        tokens.append(n)
    if len(kept) < KEPT_WORDS:
        kept.update(new)
    index = coded.indices.to_numpy(zero_copy_only=False)
    each = np.array(tokens, np.int64)[index] if len(index) else np.zeros(0, np.int64)
    real = np.array([bool(w) for w in words], np.int64)[index] if len(index) else np.zeros(0, np.int64)
    at = split.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    upto = lambda x: np.concatenate(([0], np.cumsum(x)))
    n_tokens, n_words = upto(each), upto(real)
    return n_words[at[1:]] - n_words[at[:-1]], n_tokens[at[1:]] - n_tokens[at[:-1]]


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row of ``docs``.

    Words are runs without white space; each, with the word-start mark before it, is cut greedily into the
    longest pieces of ``model`` (a SentencePiece file). Null and empty texts have 0 words and 0 tokens;
    repeated rows and null ids are kept; an empty table gives an empty one; further columns are not read.
    """

    def run(batches):
        automaton, kept = _loaded(model)
        for batch in batches:
            for lo, hi, own in pieces(batch.column(1), PIECE):
                n_words, n_tokens = counts_of(own, automaton, kept)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words), pa.array(n_tokens)], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
