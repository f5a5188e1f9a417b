"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is normalised as the model says (a space in front, spaces written as U+2581)
and cut into words that no piece of the vocabulary reaches across: between any two
characters that stand beside each other in no piece. The distinct new words of a slice
of texts are then encoded together. Their symbols lie in one flat numpy array, a word
being a segment of it. In every round

1. each word's smallest pair rank is a segmented minimum,
2. all pairs of that rank in a word merge at once, the leftmost first where they overlap,
3. the array is compacted, pairs beside a merge are ranked anew, and words without a pair left leave.

The library merges one pair at a time, the best score first and the leftmost among equals.
That is the same unless a merge makes a pair that is at least as good as the
round's (several pieces may share a score, and a piece may be made in several ways). Words in
which that happens merge their leftmost pair alone in that round.

The number of rounds of a word grows with its length, so a word of more than LONG
symbols is merged with a heap of its pairs, in the same order.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_slices

SPACE = "▁"
LONG = 2048
WHOLE_CHARS = 1 << 20
MEMORY_ENTRIES = 500_000
REMEMBERED_CHARS = 64
NO_PAIR = np.iinfo(np.int32).max

# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _replace_each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _replace_each_byte)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 2, 5):
            size = 8 if wire == 1 else 4
            if wire == 2:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} is not supported")
        yield key >> 3, value


class PieceModel:
    """The pieces of a model file, and how it normalises texts."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.add_prefix, squeeze, escape = True, True, True
        with open(path, "rb") as file:
            content = file.read()
        for number, value in _fields(content):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trained = dict(_fields(value))
                if trained.get(3, 1) != 2:
                    raise ValueError("only BPE models are supported")
                if trained.get(24, 0):
                    raise ValueError("spaces at the end of pieces are not supported")
                self.unknown_surface = trained.get(44, " ⁇ ".encode()).decode("utf-8")
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("models that map characters are not supported")
                self.add_prefix, squeeze, escape = bool(rules.get(3, 1)), rules.get(4, 1), rules.get(5, 1)
        if squeeze or not escape:
            raise ValueError("models that drop spaces or leave them unescaped are not supported")
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown = self.kinds.index(UNKNOWN)
        byte_ids = [i for i, kind in enumerate(self.kinds) if kind == BYTE]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in byte_ids}
        if self.byte_id and len(self.byte_id) != 256:
            raise ValueError("byte pieces must be complete")


class PieceCoder:
    """Encodes texts to ids and ids to texts for one model."""

    def __init__(self, model: PieceModel):
        self.model = model
        normal = {piece: i for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds)) if kind == NORMAL}
        # Symbols are the normal pieces, by their ids, and characters of pieces that are no pieces themselves.
        self.symbols = dict(normal)
        characters = {c for piece in normal for c in piece}
        for c in sorted(characters - normal.keys()):
            self.symbols[c] = len(model.pieces) + len(self.symbols) - len(normal)
        self.size = len(model.pieces) + len(self.symbols) - len(normal)
        self.of_character = np.full(0x110000, -1, dtype=np.int64)
        for c in characters:
            self.of_character[ord(c)] = self.symbols[c]

        best_first = np.unique([-model.scores[i] for i in normal.values()])
        self.rank = np.full(self.size, NO_PAIR, dtype=np.int32)
        for i in normal.values():
            self.rank[i] = np.searchsorted(best_first, -model.scores[i])
        made = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    made[left * self.size + right] = i
        self.pair_keys = np.array(sorted(made), dtype=np.int64)
        self.pair_makes = np.array([made[key] for key in sorted(made)], dtype=np.int64)

        # Which characters stand beside each other in some piece; the last row and column are all other characters.
        listed = sorted(characters)
        self.character_class = np.full(0x110000, len(listed), dtype=np.int32)
        self.character_class[[ord(c) for c in listed]] = np.arange(len(listed))
        self.beside = np.zeros((len(listed) + 1, len(listed) + 1), dtype=bool)
        for piece in normal:
            in_piece = self.character_class[[ord(c) for c in piece]]
            self.beside[in_piece[:-1], in_piece[1:]] = True
        self.controls = {i for i, kind in enumerate(model.kinds) if kind == CONTROL}
        self.surface = [self._surface(i) for i in range(len(model.pieces))]
        self.known: dict[str, bytes] = {}
        self.made: dict[int, int] = {}  # for the heap

    def _surface(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (self.model.unknown_surface if kind == UNKNOWN else piece.replace(SPACE, " ")).encode("utf-8")

    # Merging

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of every pair, and the symbol that it makes; NO_PAIR where it makes none."""
        keys = left * self.size + right
        if not len(self.pair_keys):
            return np.full(len(keys), NO_PAIR, np.int32), keys
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        makes = self.pair_makes[at]
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank[makes], NO_PAIR), makes

    def _merged(self, symbol, word, start, rank, makes, taken):
        """The arrays after the pairs that start at the places ``taken`` merged, and which places border on a merge."""
        symbol = np.where(taken, makes, symbol)
        stay = np.ones(len(symbol), dtype=bool)
        stay[1:] = ~taken[:-1]
        symbol, word, start = symbol[stay], word[stay], start[stay]
        rank, makes, new = rank[stay], makes[stay], taken[stay]
        again = new.copy()
        again[:-1] |= new[1:]
        again[-1] = False
        rank[-1] = NO_PAIR
        at = np.flatnonzero(again)
        inside = word[at] == word[at + 1]
        rank[at[~inside]] = NO_PAIR
        at = at[inside]
        rank[at], makes[at] = self._ranked(symbol[at], symbol[at + 1])
        return symbol, word, start, rank, makes, at

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols left of all words, the word of each and its first character in the joined words, in order; -1 is an unknown character."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        symbol = self.of_character[points]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        start = np.arange(len(symbol))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbol), NO_PAIR, dtype=np.int32)
        makes = np.zeros(len(symbol), dtype=np.int64)
        at = np.flatnonzero(word[:-1] == word[1:])
        rank[at], makes[at] = self._ranked(symbol[at], symbol[at + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), lengths)
            live = least < NO_PAIR
            if not live.all():
                done.append((symbol[~live], word[~live], start[~live]))
                symbol, word, start, rank, makes, least = (x[live] for x in (symbol, word, start, rank, makes, least))
                if not len(symbol):
                    break
            hit = rank == least
            places = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), places, 0))
            taken = hit & ((places - run_start) % 2 == 0)
            moved = self._merged(symbol, word, start, rank, makes, taken)
            surprised = self._surprised(symbol, word, makes, least, taken, moved)
            if len(surprised):
                at = np.flatnonzero(taken)
                leftmost = np.concatenate([[True], word[at][1:] != word[at][:-1]])
                taken[at[~leftmost & np.isin(word[at], surprised)]] = False
                moved = self._merged(symbol, word, start, rank, makes, taken)
            symbol, word, start, rank, makes, _ = moved
        if not done:
            return symbol, word, start
        symbol, word, start = (np.concatenate(column) for column in zip(*done))
        order = np.argsort(start, kind="stable")
        return symbol[order], word[order], start[order]

    def _surprised(self, symbol, word, makes, least, taken, moved) -> np.ndarray:
        """Words with several merges in which one makes a pair at least as good as the round's, for good or until the next merge."""
        at = np.flatnonzero(taken)
        several = np.unique(word[at[1:]][word[at[1:]] == word[at[:-1]]])
        if not len(several):
            return several
        _, word_after, _, rank_after, _, changed = moved
        bound = np.full(int(word[-1]) + 1, -1, dtype=np.int64)
        bound[word[at]] = least[at]
        found = [word_after[changed][rank_after[changed] <= bound[word_after[changed]]]]
        beside = at[:-1][(at[1:] == at[:-1] + 2) & (word[at[1:]] == word[at[:-1]])]
        rank, _ = self._ranked(makes[beside], symbol[beside + 2])
        found.append(word[beside][rank <= least[beside]])
        return np.intersect1d(np.concatenate(found), several)

    def merge_long(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge`` for one word, by a heap of its pairs."""
        symbol = self.of_character[np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)]
        ranks, makes = self._ranked(symbol[:-1], symbol[1:])
        heap = [(r, i, s, t, m) for i, (r, s, t, m) in enumerate(zip(ranks.tolist(), symbol[:-1].tolist(), symbol[1:].tolist(), makes.tolist())) if r < NO_PAIR]
        heapq.heapify(heap)
        if not self.made:
            self.made = dict(zip(self.pair_keys.tolist(), self.pair_makes.tolist()))
        symbols = symbol.tolist()
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        gone = -2

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
                m = self.made.get(symbols[i] * self.size + symbols[j])
                if m is not None:
                    heapq.heappush(heap, (int(self.rank[m]), i, symbols[i], symbols[j], m))

        while heap:
            _, i, s, t, m = heapq.heappop(heap)
            j = after[i] if symbols[i] == s else -1
            if j < 0 or symbols[j] != t:
                continue
            symbols[i], symbols[j] = m, gone
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        kept = [i for i, s in enumerate(symbols) if s != gone]
        return np.array([symbols[i] for i in kept], dtype=np.int64), np.array(kept, dtype=np.int64)

    # Words and texts

    def _with_unknown(self, symbol: list[int], start: list[int], text: str) -> bytes:
        """Ids of a word's symbols, an unknown character being its bytes or, without byte pieces, the unknown piece."""
        ids: list[int] = []
        for s, begin, end in zip(symbol, start, [*start[1:], len(text)]):
            if 0 <= s < len(self.model.pieces):
                ids.append(s)
            elif self.model.byte_id:
                ids += [self.model.byte_id[b] for b in text[begin:end].encode("utf-8")]
            else:
                ids.append(self.model.unknown)
        return np.array(ids, dtype="<i4").tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of every word as little-endian 32-bit numbers, the usual words merged together."""
        usual = [w for w in words if len(w) <= LONG]
        symbol, word, start = self.merge(usual)
        edges = np.searchsorted(word, np.arange(len(usual) + 1)).tolist()
        ids = symbol.astype("<i4").tobytes()
        found = {w: ids[4 * a : 4 * b] for w, a, b in zip(usual, edges, edges[1:])}
        odd = np.unique(word[(symbol < 0) | (symbol >= len(self.model.pieces))]).tolist()
        for k in odd:
            a, b = edges[k], edges[k + 1]
            found[usual[k]] = self._with_unknown(symbol[a:b].tolist(), (start[a:b] - start[a]).tolist(), usual[k])
        for w in words:
            if len(w) > LONG:
                merged, at = self.merge_long(w)
                found[w] = self._with_unknown(merged.tolist(), at.tolist(), w)
        return found

    def words(self, spaced: str) -> list[str]:
        """Cut between all characters that stand beside each other in no piece."""
        classes = self.character_class[np.frombuffer(spaced.encode("utf-32-le"), dtype=np.uint32)]
        cuts = (np.flatnonzero(~self.beside[classes[:-1], classes[1:]]) + 1).tolist()
        return [spaced[a:b] for a, b in zip([0, *cuts], [*cuts, len(spaced)])] if spaced else []

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The words of a text, normalised: in one list for a common text, in bounded lists for a very long one."""
        rest = SPACE if text and self.model.add_prefix else ""
        for at in range(0, len(text), WHOLE_CHARS):
            block = self.words(rest + text[at : at + WHOLE_CHARS].replace(" ", SPACE))
            if at + WHOLE_CHARS < len(text):
                rest = block.pop()
            if block:
                yield block

    def encode_texts(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text; words not remembered yet are encoded together, for all common texts at once."""
        texts = list(texts)
        short = [next(self.blocks(t), []) if len(t) <= WHOLE_CHARS else None for t in texts]
        fresh = self._learn(w for words in short if words for w in words)
        for text, words in zip(texts, short):
            if words is not None:
                yield self._joined(self._ids_of(words, fresh))
                continue
            parts = []
            for block in self.blocks(text):
                own = self._learn(block)
                parts += self._ids_of(block, own)
            yield self._joined(parts)

    def _ids_of(self, words: list[str], fresh: dict[str, bytes]) -> list[bytes]:
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            return [fresh.get(w) or self.known[w] for w in words]

    def _joined(self, parts: list[bytes]) -> np.ndarray:
        """Ids of a text; without byte pieces, neighbouring unknown characters are one."""
        ids = np.frombuffer(b"".join(parts), dtype="<i4")
        if self.model.byte_id:
            return ids
        unknown = ids == self.model.unknown
        return ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]

    def _learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of those words that are not remembered, now remembered if they are short."""
        new = list({w for w in words if w not in self.known})
        fresh = self.encode_words(new)
        if len(self.known) < MEMORY_ENTRIES:
            self.known.update((w, ids) for w, ids in fresh.items() if len(w) <= REMEMBERED_CHARS)
        return fresh

    def forget_if_full(self) -> None:
        """Start remembering anew; call between slices."""
        if len(self.known) >= MEMORY_ENTRIES:
            self.known.clear()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_texts([text])).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for, without the space in front; bytes that are no UTF-8 become U+FFFD, each its own."""
        runs: list[list[int]] = [[]]
        if self.controls.isdisjoint(ids):
            runs = [ids]
        else:
            # A control id has no text, but ends a character's bytes.
            for i in ids:
                runs.append([]) if i in self.controls else runs[-1].append(i)
            runs = [run for run in runs if run]
        surfaces = [b"".join(map(self.surface.__getitem__, run)) for run in runs]
        if self.model.add_prefix and runs and runs[0]:
            first = runs[0][0]
            if self.model.kinds[first] == NORMAL and self.model.pieces[first].startswith(SPACE):
                surfaces[0] = surfaces[0][1:]
        return "".join(text.decode("utf-8", errors="each-byte") for text in surfaces)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    """The coder of a model file, built once in a Python worker."""
    return PieceCoder(PieceModel(path))


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text, without begin and end ids; a null text is empty and has none."""

    def run(part: pa.RecordBatch, pieces: PieceCoder) -> pa.RecordBatch:
        pieces.forget_if_full()
        ids = list(pieces.encode_texts(t or "" for t in part.column("__text").to_pylist()))
        return pa.RecordBatch.from_arrays([part.column("__id"), pa.array(ids, type=pa.list_(pa.int32()))], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("__id"), docs[text].alias("__text"))
    return map_slices(rows, run, f"`{id_column}` {kind}, ids array<int>", "__text", lambda: coder(path))


def decode_documents(encoded: DataFrame, path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, decoded): the text that a row's ids stand for; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = coder(path)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                decoded = pieces.decode(one.column("__ids")[0].as_py() or [])
                yield pa.RecordBatch.from_arrays([one.column("__id"), pa.array([decoded], type=pa.string())], names=[id_column, "decoded"])

    kind = encoded.schema[id_column].dataType.simpleString()
    rows = encoded.select(encoded[id_column].alias("__id"), encoded[ids].alias("__ids"))
    return rows.mapInArrow(run, f"`{id_column}` {kind}, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text, decode its ids again and report digests of both.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas)
    and decoded_sha256 (of the decoded text in UTF-8). One row for each input
    row, repeated rows included; a null or empty text has no tokens and both
    digests of no bytes. An empty table gives no rows; other columns are ignored.
    """

    def run(part: pa.RecordBatch, state) -> pa.RecordBatch:
        pieces, decimal = state
        pieces.forget_if_full()
        counts, id_digests, text_digests = [], [], []
        for ids in pieces.encode_texts(t or "" for t in part.column("__text").to_pylist()):
            listed = ids.tolist()
            counts.append(len(listed))
            id_digests.append(hashlib.sha256(",".join(map(decimal.__getitem__, listed)).encode()).hexdigest())
            text_digests.append(hashlib.sha256(pieces.decode(listed).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [part.column("__id"), pa.array(counts, type=pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    def setup():
        pieces = coder(path)
        return pieces, [str(i) for i in range(len(pieces.model.pieces))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("__id"), docs["text"].alias("__text"))
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_slices(rows, run, schema, "__text", setup)
