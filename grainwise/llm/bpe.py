"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The bytes of a pre-token are mapped to Latin-1, one character a byte, and an
Aho-Corasick automaton over the vocabulary finds the longest token that begins
at each place. Encoding takes longest matches from the left. A token may follow
another only if the merges, run on the bytes of the two alone, end in exactly
that pair; if no token that fits leads on, the place is marked as a dead end
and the search steps back. Whether two tokens may be neighbours is worked out
once and remembered. Each place is left for good at most once, so encoding is
linear in the length of a pre-token, and its ids are those of the merges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import Splitter
from .shared import map_slices

MEMORY_ENTRIES = 500_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 bytes and rank on each line) in the order of their ranks."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranked]


class BytePairCoder:
    """Encodes pre-tokens to ids and ids to bytes for one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.shorter = [self._longest_proper_prefix(token) for token in tokens]
        self.made_of: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        for i in range(len(tokens)):
            self.made_of.append(self._last_merge(i))
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _longest_proper_prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            if (found := self.rank.get(token[:end])) is not None:
                return found
        return -1

    def _last_merge(self, i: int) -> tuple[int, int]:
        """The two tokens whose merge makes token i; (i, i) for a token that no merge makes."""
        token = self.tokens[i]
        left = self.shorter[i]
        while left >= 0:
            right = self.rank.get(token[len(self.tokens[left]) :])
            if right is not None and left < i and right < i and self._stay_apart(left, right):
                self.merged[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends in these two and not across their border.

        Undo the later of the two merges again and again; a pair at the border
        that would have merged earlier than what was undone so far breaks it.
        """
        before = len(self.tokens)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                return False
            if left > right:
                before, undone = left, self.made_of[left][1]
                if undone != left:
                    left = undone
                    continue
                before, undone = right + 1, self.made_of[right][0]
                if undone == right:
                    return True
                right = undone
            else:
                before, undone = right + 1, self.made_of[right][0]
                if undone != right:
                    right = undone
                    continue
                before, undone = left, self.made_of[left][1]
                if undone == left:
                    return True
                left = undone

    def _fits(self, left: int, right: int) -> bool:
        key = left * len(self.tokens) + right
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) >= MEMORY_ENTRIES:
                self.compatible.clear()
            found = self.compatible[key] = self._stay_apart(left, right)
        return found

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        whole = self.rank.get(piece)
        if whole is not None and self.made_of[whole] != (whole, whole):
            return (whole,)
        n = len(piece)
        longest = [-1] * n
        reach = [0] * n
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > reach[start]:
                reach[start], longest[start] = length, token
        open_end = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at = 0
        token = longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + len(self.tokens[token])
                if open_end[end] and (not out or self._fits(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif out:
                open_end[at] = 0
                token = out.pop()
                at -= len(self.tokens[token])
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return tuple(out)

    def encode(self, pretoken: str) -> tuple[int, ...]:
        """Ids of one pre-token, remembered while there is room."""
        found = self.known.get(pretoken)
        if found is None:
            found = self.encode_bytes(pretoken.encode("utf-8"))
            if len(pretoken) <= 64:
                if len(self.known) >= MEMORY_ENTRIES:
                    self.known.clear()
                self.known[pretoken] = found
        return found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str) -> BytePairCoder:
    """The coder of a rank file, built once in a Python worker."""
    return BytePairCoder(read_ranks(path))


def text_ids(bpe: BytePairCoder, splitter: Splitter, text: str) -> Iterator[list[int]]:
    """Ids of a whole text, block by block."""
    known, encode = bpe.known, bpe.encode
    for block in splitter.blocks(text):
        ids: list[int] = []
        add = ids.extend
        for pretoken in block:
            add(known.get(pretoken) or encode(pretoken))
        yield ids


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, a null text being empty."""

    def run(part: pa.RecordBatch, state) -> pa.RecordBatch:
        bpe, split = state
        ids = [[i for block in text_ids(bpe, split, t or "") for i in block] for t in part.column("__text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("__id"), pa.array(ids, type=pa.list_(pa.int32()))], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("__id"), docs[text].alias("__text"))
    return map_slices(rows, run, f"`{id_column}` {kind}, ids array<int>", "__text", lambda: (coder(path), Splitter(pattern)))


def decode_documents(encoded: DataFrame, path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, decoded): the bytes that a row's ids stand for; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                decoded = bpe.decode(one.column("__ids")[0].as_py() or ())
                yield pa.RecordBatch.from_arrays([one.column("__id"), pa.array([decoded], type=pa.binary())], names=[id_column, "decoded"])

    kind = encoded.schema[id_column].dataType.simpleString()
    rows = encoded.select(encoded[id_column].alias("__id"), encoded[ids].alias("__ids"))
    return rows.mapInArrow(run, f"`{id_column}` {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode its ids again and report digests of both.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one
    space) and decoded_sha256 (of the bytes that the ids decode to). One row for
    each input row, repeated rows included; a null or empty text has no tokens
    and both digests of no bytes. Ids and bytes go into the digests block by
    block, so a very long text needs no second copy.
    """

    def run(part: pa.RecordBatch, state) -> pa.RecordBatch:
        bpe, split, decimal = state
        counts, id_digests, byte_digests = [], [], []
        for text in part.column("__text").to_pylist():
            n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            for ids in text_ids(bpe, split, text or ""):
                if n and ids:
                    of_ids.update(b" ")
                of_ids.update(" ".join(map(decimal.__getitem__, ids)).encode())
                of_bytes.update(bpe.decode(ids))
                n += len(ids)
            counts.append(n)
            id_digests.append(of_ids.hexdigest())
            byte_digests.append(of_bytes.hexdigest())
        return pa.RecordBatch.from_arrays(
            [part.column("__id"), pa.array(counts, type=pa.int64()), pa.array(id_digests), pa.array(byte_digests)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    def setup():
        bpe = coder(path)
        return bpe, Splitter(pattern), [str(i) for i in range(len(bpe.tokens))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("__id"), docs["text"].alias("__text"))
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_slices(rows, run, schema, "__text", setup)
