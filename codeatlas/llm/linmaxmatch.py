"""Token counts (operator 10): greedy longest-match word pieces counted by a linear automaton.

The vocabulary is a trie: word-initial pieces from one root, continuing pieces from another. Each node has a failure link to the node that
is reached when its longest matched prefix is cut into pieces, and the number of pieces popped on the way, so a word's count is found in
one pass over its characters, without building pieces. A word with a part that no piece covers counts as one unknown token.

Pieces are taken from a public byte-level vocabulary: those with the mark of a blank start words, the others continue them; words are
runs without ASCII white space, as UTF-8 bytes in the vocabulary's alphabet. Equal words of a batch are counted once.

Defined results: null and empty texts count 0. Repeated rows give one row each. Words of any length are counted whole. An empty table gives
an empty result. Other columns are ignored.
"""

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces
from .words import Words

KNOWN = 1_000_000  # words whose counts a task remembers


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-initial and continuing pieces of a file of ranks: tokens with one leading blank, and the others, none with white space inside."""
    first, later = [], []
    with open(path, "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0])
            body = token[1:] if token[:1] == b" " else token
            if body and not set(body) & set(b" \t\n\v\f\r"):
                (first if body is not token else later).append(body)
    return first, later


class Automaton:
    """edges[v]: next node by byte; fail[v]: where the rest of v goes once its pieces are popped, -1 for nowhere; pops[v]: their number."""

    def __init__(self, first: list[bytes], later: list[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]  # node 0 starts words, node 1 continues them
        piece = [False, False]
        for root, words in ((0, first), (1, later)):
            for w in words:
                v = root
                for c in w:
                    to = self.edges[v].get(c)
                    if to is None:
                        to = self.edges[v][c] = len(self.edges)
                        self.edges.append({})
                        piece.append(False)
                    v = to
                piece[v] = True
        self.fail, self.pops = [-1] * len(self.edges), [0] * len(self.edges)
        queue = [0, 1]
        for v in queue:  # breadth first: shorter prefixes are settled before
            for c, to in self.edges[v].items():
                if piece[to]:
                    self.fail[to], self.pops[to] = 1, 1
                else:
                    n, z = self.pops[v], self.fail[v]
                    while z >= 0 and c not in self.edges[z]:
                        n, z = n + self.pops[z], self.fail[z]
                    self.fail[to], self.pops[to] = (self.edges[z][c], n) if z >= 0 else (-1, 0)
                queue.append(to)

    def count(self, word: bytes) -> int:
        """The pieces of a word; 0 if it can't be cut into pieces."""
        edges, fail, pops, v, n = self.edges, self.fail, self.pops, 0, 0
        for c in word:
            to = edges[v].get(c)
            while to is None:
                n += pops[v]
                v = fail[v]
                if v < 0:
                    return 0
                to = edges[v].get(c)
            v = to
        while v != 1:
            n += pops[v]
            v = fail[v]
            if v < 0:
                return 0
        return n


@functools.cache
def automaton(path: str) -> Automaton:
    return Automaton(*vocabulary(path))


def counting(path: str):
    def run(batches):
        auto, known = automaton(path), {}
        for batch in batches:
            for rows, data, offsets in pieces(batch, most=1 << 22):
                w = Words(data, offsets)
                _, one, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
                raw, n = data.tobytes(), np.empty(len(one), np.int64)
                if len(known) > KNOWN:
                    known.clear()
                for k, (a, b) in enumerate(zip(w.starts[one].tolist(), w.ends[one].tolist(), strict=True)):
                    word = raw[a:b]
                    c = known.get(word)
                    if c is None:
                        c = known[word] = auto.count(word)
                    n[k] = c
                each, doc = n[back], w.doc()
                total = np.bincount(doc, np.maximum(each, 1), len(w.counts)).astype(np.int64)
                unknown = np.bincount(doc, each == 0, len(w.counts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(w.counts), pa.array(total), pa.array(unknown)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (words counted as one unknown token) for each row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(counting(path), "doc_id long, n_words long, n_tokens long, n_unknown long")
