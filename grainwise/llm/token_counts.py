"""Token counts under a unigram vocabulary, with forward scores shared in a trie.

The number of tokens of a pre-token is that of its best segmentation: the one
whose pieces have the greatest sum of log-probabilities. The distinct pre-tokens
of a slice of texts that are not counted yet are inserted in a trie of bytes, in
sorted order, so that those with a common prefix lie beside each other. The
forward score of a prefix (best sum over its segmentations, fewest pieces among
equals) depends on that prefix alone: it is computed once at its node and
shared by all pre-tokens below; the count of the node at which a
pre-token ends is stored.

The trie is built and scored depth by depth, all nodes of a depth at once in flat
arrays. A node also has the vocabulary's own trie nodes that are reached from earlier
places, so one byte costs one look-up of each in a table of (vocabulary node, byte).
A depth needs only the one above it, and nothing of the trie is kept but the
terminal counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import read_ranks
from .pretokens import Splitter
from .shared import map_slices

MEMORY_ENTRIES = 500_000
NOT_A_PIECE = np.nan


def zipf_scores(tokens: list[bytes]) -> dict[bytes, float]:
    """Log-probability of each token if its probability falls as 1 / (rank + 1)."""
    total = list(accumulate(1 / (rank + 1) for rank in range(len(tokens))))[-1] if tokens else 1.0
    return {token: -math.log((rank + 1) * total) for rank, token in enumerate(tokens)}


def _expanded(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of every run, one after the other."""
    return np.arange(number.sum()) + np.repeat(first - np.cumsum(number) + number, number)


class UnigramCounter:
    """Counts pieces of best segmentations. The vocabulary must hold every single byte that occurs."""

    def __init__(self, scores: dict[bytes, float]):
        below: list[dict[int, int]] = [{}]
        score: list[float] = [NOT_A_PIECE]
        for piece, own in scores.items():
            node = 0
            for byte in piece:
                child = below[node].get(byte)
                if child is None:
                    child = below[node][byte] = len(below)
                    below.append({})
                    score.append(NOT_A_PIECE)
                node = child
            score[node] = own
        steps = sorted((node * 256 + byte, child) for node, children in enumerate(below) for byte, child in children.items())
        self.steps = np.array([step for step, _ in steps], dtype=np.int64)
        self.leads_to = np.array([child for _, child in steps], dtype=np.int64)
        self.score = np.array(score)
        self.nodes_scored = 0
        self.known: dict[str, int] = {}

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The vocabulary's node one byte below each, -1 for none."""
        step = node * 256 + byte
        at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
        return np.where(self.steps[at] == step, self.leads_to[at], -1)

    def segment(self, pretokens: list[bytes]) -> np.ndarray:
        """Pieces of the best segmentation of each of the distinct, sorted, non-empty ``pretokens``."""
        lengths = np.array([len(p) for p in pretokens], dtype=np.int64)
        text = np.frombuffer(b"".join(pretokens), dtype=np.uint8)
        begin = np.cumsum(lengths) - lengths
        pieces = np.zeros(len(pretokens), dtype=np.int64)
        # Those that go on at this depth, and the node of each one's prefix.
        alive = np.arange(len(pretokens))
        node_of = np.zeros(len(pretokens), dtype=np.int64)
        # Of the nodes of the depth above: forward score, pieces used, and open vocabulary nodes (owner, node, score and pieces before it).
        best, used = np.zeros(1), np.zeros(1, dtype=np.int64)
        owner, open_node, base, taken = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64, np.int64))
        for depth in range(int(lengths.max(initial=0))):
            on = lengths[alive] > depth
            alive, node_of = alive[on], node_of[on]
            byte = text[begin[alive] + depth].astype(np.int64)
            # Neighbours in sorted order with the same prefix share its node.
            fresh = np.concatenate([[True], (node_of[1:] != node_of[:-1]) | (byte[1:] != byte[:-1])])
            first = np.flatnonzero(fresh)
            parent, own_byte = node_of[first], byte[first]
            node_of = np.cumsum(fresh) - 1
            self.nodes_scored += len(first)

            # A node goes on with what is open at its parent, and with a piece that begins there.
            run = np.searchsorted(owner, np.arange(len(best) + 1))
            number = np.diff(run)[parent] + 1
            at = _expanded(run[:-1][parent], number)
            last = np.cumsum(number) - 1
            inner = np.ones(len(at), dtype=bool)
            inner[last] = False
            child = np.repeat(np.arange(len(first)), number)
            came = np.zeros(len(at), dtype=np.int64)
            score_before, used_before = np.empty(len(at)), np.empty(len(at), dtype=np.int64)
            came[inner], score_before[inner], used_before[inner] = open_node[at[inner]], base[at[inner]], taken[at[inner]]
            score_before[last], used_before[last] = best[parent], used[parent]
            reached = self._next(came, own_byte[child])
            found = reached >= 0
            owner, open_node, base, taken = child[found], reached[found], score_before[found], used_before[found]

            best = np.full(len(first), -np.inf)
            used = np.zeros(len(first), dtype=np.int64)
            piece = self.score[open_node]
            ends = ~np.isnan(piece)
            if ends.any():
                of, total, count = owner[ends], base[ends] + piece[ends], taken[ends] + 1
                start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                highest = np.maximum.reduceat(total, start)
                best[of[start]] = highest
                fewest = np.where(total == np.repeat(highest, np.diff(np.append(start, len(of)))), count, np.iinfo(np.int64).max)
                used[of[start]] = np.minimum.reduceat(fewest, start)

            done = lengths[alive] == depth + 1
            if (best[node_of[done]] == -np.inf).any():
                raise ValueError("the vocabulary lacks a byte of the text")
            pieces[alive[done]] = used[node_of[done]]
        return pieces

    def count(self, met: set[str]) -> None:
        """Remember the counts of these pre-tokens."""
        new = met.difference(self.known)
        if len(self.known) + len(new) > MEMORY_ENTRIES:
            # Common pre-tokens are in every slice.
            self.known = {pretoken: self.known[pretoken] for pretoken in met.intersection(self.known)}
        if new:
            spelled = sorted((pretoken.encode("utf-8"), pretoken) for pretoken in new)
            counts = self.segment([b for b, _ in spelled])
            self.known.update(zip((pretoken for _, pretoken in spelled), counts.tolist()))

    def pieces(self, pretoken: str) -> int:
        self.count({pretoken})
        return self.known[pretoken]

    def totals(self, texts: Iterable[Iterable[list[str]]]) -> list[tuple[int, int]]:
        """(pieces, pre-tokens) of every text, given as lists of its pre-tokens."""
        texts = [list(blocks) for blocks in texts]
        self.count(set().union(*(block for blocks in texts for block in blocks)))
        of = self.known.__getitem__
        return [(sum(sum(map(of, block)) for block in blocks), sum(map(len, blocks))) for blocks in texts]


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(zipf_scores(read_ranks(path)))


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens of every whole text.

    One row for each input row, repeated rows included; a null or empty text
    counts 0. Counts of pre-tokens are kept over the texts of a Python worker;
    beyond MEMORY_ENTRIES only those of the present slice of texts stay, which
    changes no count.
    """

    def run(part: pa.RecordBatch, state) -> pa.RecordBatch:
        counts, split = state
        totals = counts.totals(split.blocks(text or "") for text in part.column("__text").to_pylist())
        arrays = [part.column("__id"), *(pa.array(c, type=pa.int64()) for c in zip(*totals))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "n_pretokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("__id"), docs["text"].alias("__text"))
    schema = f"doc_id {kind}, n_tokens bigint, n_pretokens bigint"
    return map_slices(rows, run, schema, "__text", lambda: (counter(path), Splitter(pattern)))
