"""Order-preserving packing of documents into sequences of bounded length.

The documents of one input partition, in their order, form a stream of tokens;
nothing is shuffled. The stream is taken in blocks of about BLOCK_TOKENS, cut
after a document. Within a block, dynamic programming over the places where a
cut is allowed (ends of documents and sentences, and regular places inside a
sentence longer than STEP) minimises

    padding + a penalty for every cut inside a document + a cost per sequence.

The best predecessor of a place lies in a sliding window of one sequence's
length. The cost of a transition is a term of its start plus a term of its end,
so the minimum over the window is the head of a monotone queue, and a block is
solved in time linear in its places. Sequences whose length is a power of two
need no padding; these are one further transition for each power.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .pretokens import Splitter
from .shared import text_slices, without_cycle_search

SEQUENCE_TOKENS = 2048
BLOCK_TOKENS = 1 << 19
STEP = 256
SENTENCE_CUT = 12
INNER_CUT = 96
SEQUENCE_COST = 8
LEAST_POWER = 1
MEMORY_ENTRIES = 1_000_000

DOCUMENT_END, SENTENCE_END, INSIDE = 0, 1, 2
SENTENCE_LAST = ".!?\n…。"
ENDS_SENTENCE = 1 << 31  # added to the id of a remembered token


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the
    characters from 256 on, in order.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in visible]
    return {byte: chr(byte) for byte in visible} | {byte: chr(256 + k) for k, byte in enumerate(hidden)}


class IdsOfPretokens:
    """Ids of whole texts by the ``tokenizers`` library, each distinct pre-token encoded once.

    Ids are kept as little-endian unsigned 32-bit bytes. With ``split_added``,
    the file's added tokens are found in a text first, as the library's encode
    does by default; without it, a string like theirs is ordinary text, as with
    the library's encode_special_tokens.
    """

    def __init__(self, path: str, pattern: str, split_added: bool = False):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.alphabet = _byte_alphabet()
        self.splitter = Splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.mark = re.compile(f"[{re.escape(SENTENCE_LAST)}]")
        self.spelled_marks = tuple(map(self._spelled, SENTENCE_LAST))
        self.added = self._added_tokens(tokenizer) if split_added else {}
        # The library takes the longest of those that begin at a place.
        longest_first = sorted(self.added, key=len, reverse=True)
        self.any_added = re.compile(f"({'|'.join(map(re.escape, longest_first))})")

    @staticmethod
    def _added_tokens(tokenizer) -> dict[str, bytes]:
        """Ids of the added tokens by their strings."""
        found = {}
        for i, token in tokenizer.get_added_tokens_decoder().items():
            if token.single_word or token.lstrip or token.rstrip or (token.normalized and tokenizer.normalizer):
                raise ValueError(f"added token {token.content!r} is matched by more than its string, which is not supported")
            if token.content:
                marked = i + ENDS_SENTENCE * token.content.endswith(tuple(SENTENCE_LAST))
                found[token.content] = np.array([marked], dtype="<u4").tobytes()
        return found

    def _spelled(self, text: str) -> str:
        return text.encode("utf-8").decode("latin-1").translate(self.alphabet)

    def _all_spelled(self, pretokens: list[str]) -> list[str]:
        """Pre-tokens in the vocabulary's characters, spelled in one go with a zero character between them."""
        joined = "\0".join(pretokens)
        if joined.count("\0") == len(pretokens) - 1:
            return self._spelled(joined).split(self.alphabet[0])
        return list(map(self._spelled, pretokens))

    def _sentence_ends(self, spelled: str) -> list[int]:
        """Tokens up to which a pre-token ends in a sentence mark, in whatever tokens that lies."""
        found, so_far = [], ""
        for k, token in enumerate(self.model.tokenize(spelled)):
            so_far += token.value
            if so_far.endswith(self.spelled_marks):
                found.append(k)
        return found

    def _learn(self, pretokens: list[str]) -> None:
        """Remember the ids of pre-tokens; ENDS_SENTENCE is added to the id of a token at which a sentence ends."""
        spelled = self._all_spelled(pretokens)
        tokenize = self.model.tokenize
        ids = [[token.id for token in tokenize(s)] for s in spelled]
        for k, pretoken in enumerate(pretokens):
            # Words and numbers hold no marks.
            if not pretoken[-1].isalnum() and self.mark.search(pretoken):
                for token in self._sentence_ends(spelled[k]):
                    ids[k][token] += ENDS_SENTENCE
        ends = list(accumulate(4 * len(own) for own in ids))
        stored = np.fromiter(chain.from_iterable(ids), dtype="<u4", count=ends[-1] // 4).tobytes()
        self.known.update(zip(pretokens, (stored[a:b] for a, b in zip([0, *ends], ends))))

    def _parts(self, text: str) -> list[list[str] | bytes]:
        """Pre-tokens of a text in lists, and the ids of its added tokens between them."""
        if not any(content in text for content in self.added):
            return list(self.splitter.blocks(text))
        parts: list[list[str] | bytes] = []
        for k, part in enumerate(self.any_added.split(text)):
            # Added tokens stand at the odd places.
            parts += [self.added[part]] if k % 2 else self.splitter.blocks(part)
        return parts

    def of_texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text, and the token offsets at which its sentences end; new pre-tokens of all are worked out together."""
        laid_out = [self._parts(text) for text in texts]
        met = set().union(*(part for parts in laid_out for part in parts if isinstance(part, list)))
        new = met.difference(self.known)
        if len(self.known) + len(new) > MEMORY_ENTRIES:
            # Common pre-tokens are in every slice.
            self.known = {pretoken: self.known[pretoken] for pretoken in met.intersection(self.known)}
        if new:
            self._learn(list(new))
        ids_of = self.known.__getitem__
        for parts in laid_out:
            found = b"".join([part if isinstance(part, bytes) else b"".join(map(ids_of, part)) for part in parts])
            marked = np.frombuffer(found, dtype="<u4")
            yield marked & np.uint32(ENDS_SENTENCE - 1), np.flatnonzero(marked >= ENDS_SENTENCE) + 1

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return next(self.of_texts([text]))


@lru_cache(maxsize=2)
def ids_of_pretokens(path: str, pattern: str, split_added: bool = False) -> IdsOfPretokens:
    """Built once in a Python worker and kept with what it has learnt."""
    return IdsOfPretokens(path, pattern, split_added)


def _distinct(runs: np.ndarray) -> np.ndarray:
    """Distinct numbers of a few runs in order, one after the other; a stable sort merges such runs."""
    ordered = np.sort(runs, kind="stable")
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def cut_places(lengths: np.ndarray, sentence_ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts of a block of documents, as token offsets in order, and the kind of each."""
    stops = np.cumsum(lengths)
    starts = stops - lengths
    inner = np.concatenate([ends[ends < length] + start for ends, length, start in zip(sentence_ends, lengths, starts)] or [stops])
    # Both are in order.
    places = _distinct(np.concatenate([stops[lengths > 0], inner]))
    gaps = np.diff(np.concatenate([[0], places]))
    wide = np.flatnonzero(gaps > STEP)
    if len(wide):
        steps = [np.arange(places[i] - gaps[i] + STEP, places[i], STEP) for i in wide]
        places = _distinct(np.concatenate([places, *steps]))
    kinds = np.full(len(places), INSIDE, dtype=np.int8)
    kinds[np.searchsorted(places, inner)] = SENTENCE_END
    kinds[np.searchsorted(places, stops[lengths > 0])] = DOCUMENT_END
    return places, kinds


def _unpadded(at: np.ndarray, powers: list[int]) -> tuple[list[int], list[int]]:
    """Starts of the sequences of ``powers`` tokens that end at each place, and where each place's starts begin; shorter sequences first."""
    index = np.full(at[-1] + 1, -1, dtype=np.int64)
    index[at] = np.arange(len(at))
    ends, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for power in powers:
        first = np.searchsorted(at, power)
        start = index[at[first:] - power]
        found = np.flatnonzero(start >= 0)
        ends.append(found + first)
        starts.append(start[found])
    end = np.concatenate(ends)
    order = np.argsort(end, kind="stable")
    return np.concatenate(starts)[order].tolist(), np.searchsorted(end[order], np.arange(len(at) + 1)).tolist()


def best_cuts(places: list[int], kinds: list[int], width: int = SEQUENCE_TOKENS, least_power: int = LEAST_POWER) -> list[int]:
    """The cheapest increasing cuts out of ``places`` (the last one included) with no gap over ``width``.

    Places must be increasing and lie at most ``width`` apart, the first from 0.
    Unpadded sequences have ``least_power`` tokens at least. Equal costs resolve
    towards the earliest start of the last sequence.
    """
    powers = [1 << k for k in range(width.bit_length()) if least_power <= 1 << k < width]
    offsets = np.array([0, *places], dtype=np.int64)
    at = offsets.tolist()
    unpadded, first = _unpadded(offsets, powers)
    # What a sequence that ends at a place costs besides its padding, and where one may begin at the earliest.
    penalty = np.array([0, SENTENCE_CUT, INNER_CUT], dtype=np.int64)[np.array(kinds, dtype=np.int64)] + SEQUENCE_COST
    earliest = np.searchsorted(offsets, offsets[1:] - width).tolist()
    cost, back = [0], [0]
    # The monotone queue: values and places, from ``head`` on.
    values, queued, head = [0], [0], 0
    for i, place, extra, start in zip(range(1, len(at)), places, penalty.tolist(), earliest):
        while queued[head] < start:
            head += 1
        origin = queued[head]
        best = values[head] + width - place
        if first[i] != first[i + 1]:
            for j in unpadded[first[i] : first[i + 1]]:
                if cost[j] < best:
                    best, origin = cost[j], j
        best += extra
        cost.append(best)
        back.append(origin)
        value = best + place
        while len(values) > head and values[-1] > value:
            values.pop()
            queued.pop()
        values.append(value)
        queued.append(i)
    cuts, head = [], len(at) - 1
    while head:
        cuts.append(at[head])
        head = back[head]
    return cuts[::-1]


def _pack_block(docs: list[tuple[object, np.ndarray, np.ndarray]], first_sequence: int) -> tuple[dict, int]:
    """Pieces of one block as columns, and the number of sequences they fill."""
    lengths = np.array([len(ids) for _, ids, _ in docs], dtype=np.int64)
    places, kinds = cut_places(lengths, [ends for _, _, ends in docs])
    cuts = best_cuts(places.tolist(), kinds.tolist())
    stops = np.cumsum(lengths)
    starts = stops - lengths
    edges = np.unique(np.concatenate([[0], cuts, stops]))
    begin, end = edges[:-1], edges[1:]
    owner = np.searchsorted(stops, begin, side="right")
    sequence = np.searchsorted(cuts, begin, side="right")
    sequence_start = np.concatenate([[0], cuts])[sequence]
    crcs = [
        zlib.crc32(docs[d][1][b - starts[d] : e - starts[d]].tobytes())
        for d, b, e in zip(owner.tolist(), begin.tolist(), end.tolist())
    ]
    columns = {
        "row": owner,
        "start": begin - starts[owner],
        "length": end - begin,
        "ids_crc32": np.array(crcs, dtype=np.int64),
        "doc_tokens": lengths[owner],
        "sequence_id": sequence + first_sequence,
        "offset": begin - sequence_start,
    }
    return columns, len(cuts)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, with_ids: bool = False, split_added: bool = False
) -> DataFrame:
    """One row per piece: which tokens of which document stand where in which sequence.

    A document's tokens are its text's ids and then ``end_id``; a null or empty
    text has that id alone. Every token lies in exactly one piece; pieces of a
    document follow each other, and documents follow each other in the order of
    their input partition. Repeated rows are packed once each. A sequence's
    number is the input partition's, times 2**32, plus its rank there. An empty
    table gives no rows. ``with_ids`` adds the ids of each piece; ``split_added``
    gives the added tokens of the tokenizer's file in a text their own ids.

    Read documents from a stored table: a task that is run again then meets the
    same rows in the same order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ids_of_pretokens(tokenizer_path, pattern, split_added)
        sequence = TaskContext.get().partitionId() << 32
        block: list[tuple[object, np.ndarray, np.ndarray]] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            with without_cycle_search():
                columns, used = _pack_block(block, sequence)
            sequence += used
            rows = columns.pop("row").tolist()
            arrays = [pa.array([block[r][0] for r in rows], type=kind)]
            arrays += [pa.array(np.asarray(c, dtype=np.int64)) for c in columns.values()]
            names = ["doc_id", *columns]
            if with_ids:
                spans = zip(rows, columns["start"].tolist(), columns["length"].tolist())
                arrays.append(pa.array([block[r][1][s : s + n].astype(np.int32) for r, s, n in spans], type=pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        kind = pa.int64()
        for part in text_slices(batches, "__text"):
            kind = part.column("__id").type
            with without_cycle_search():
                found = list(ids_of.of_texts([text or "" for text in part.column("__text").to_pylist()]))
            for doc_id, (ids, ends) in zip(part.column("__id").to_pylist(), found):
                block.append((doc_id, np.append(ids, np.uint32(end_id)), ends))
                tokens += len(ids) + 1
                if tokens >= BLOCK_TOKENS:
                    yield packed()
                    block, tokens = [], 0
        if block:
            yield packed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    )
    return docs.select(docs["doc_id"].alias("__id"), docs["text"].alias("__text")).mapInArrow(run, schema)
