"""Exact byte-pair encoding and decoding of whole texts with a public vocabulary.

Encoding backtracks instead of replaying merges.  An Aho-Corasick automaton over
all tokens proposes the longest token at each place; a token may follow another
only if replaying the merges would leave the border between the two (the
compatibility of a pair, worked out once and kept).  Where no token fits, the last
one gives way to its next shorter prefix.  The answer is the one that the merge
rules give, in time linear in the length of a word.

Decoding gathers token texts from one string through a table of offsets.

Words are split off at ASCII white space and each different word of a slice is
encoded once; no pattern of the vocabulary's splitter spans white space, so this
changes nothing.  What is remembered is bounded: when it is full, only what was met
again since the last time stays.  The vocabulary travels as flat arrays, for each
core of an executor has a worker that holds one.  Null and empty texts give no tokens and an empty decoded text;
repeated rows are encoded alike; an empty table gives no rows; other columns of
the table are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillscope.llm.texts import map_batches, release, split_words, text_slices

WORD_END = "</w>"
# Text encoded at once; its words, tokens and decoded text take some twenty times as much.
SLICE_BYTES = 1 << 19
# Rows that travel at once: no more than a few slices, for Spark and its worker both hold them.
BATCH_BYTES = 1 << 20
# Pairs whose compatibility, and words whose tokens, a task remembers before it forgets.
REMEMBERED = 3 << 16

# The splitter's pattern and the white space of Unicode.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


# Signs that often end a chunk; behind letters each is a piece of its own.
ENDS = ".,;:!?"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level vocabulary with word ends."""

    def __init__(self, definition: dict):
        model = definition["model"]
        ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in definition.get("added_tokens", [])}
        size = max([*ids.values(), *self.specials.values()]) + 1
        texts = [""] * size
        for text, i in [*ids.items(), *self.specials.items()]:
            texts[i] = text
        # Offset table: every token's text with the blank that joins tokens.
        self.table = pa.array([f"{text} ".encode() for text in texts], pa.large_binary())
        # A token as a string of symbols: byte b inside a word, 256 + b at its end.
        symbols = [""] * size
        for b, character in enumerate(byte_characters()):
            symbols[ids[character]] = chr(b)
            symbols[ids[character + WORD_END]] = chr(256 + b)
        # When a token comes into being: -1 for symbols, else the rank of its merge; and the merged two.
        self.born, self.left, self.right = (array("i", [-1]) * size for _ in range(3))
        self.pairs = array("q")
        for rank, (left, right) in enumerate(tuple(m) if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.pairs.append(pair[0] << 32 | pair[1])
            if not symbols[whole]:
                symbols[whole] = symbols[pair[0]] + symbols[pair[1]]
                self.born[whole], self.left[whole], self.right[whole] = rank, *pair
        self._symbols = "".join(symbols)
        self._edges = array("i", np.cumsum([0, *map(len, symbols)]).tolist())
        self._number_pairs()
        # Tokens in which the merges of their own symbols end.
        self.usable = array("i", (i for i in range(size) if symbols[i] and self._reachable(i)))

    def _number_pairs(self) -> None:
        self.rank = {pair: rank for rank, pair in enumerate(self.pairs)}

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "rank"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._number_pairs()

    def symbols(self, token: int) -> str:
        return self._symbols[self._edges[token] : self._edges[token + 1]]

    def sizes(self) -> np.ndarray:
        """Number of symbols of each token; 0 for special ones."""
        return np.diff(np.array(self._edges, np.int64))

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def _reachable(self, token: int) -> bool:
        """Whether the merges of the token's own symbols end in that token."""
        born = self.born[token]
        return born < 0 or self.compatible(self.left[token], self.right[token], before=born)

    def compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether the merges leave a border between two tokens (looking only at ranks below ``before``).

        Going back in time, the younger of the two tokens at the border falls
        apart.  The border is lost if the tokens beside it at some time are a pair
        that merges before either of them is taken up by its own neighbour.  Of
        equal merges the left one comes first.
        """
        born, rank = self.born, self.rank
        left_until = right_until = before if before is not None else len(rank)
        while True:
            merge = rank.get(left << 32 | right)
            if merge is not None and merge < left_until and (merge <= right_until if before is None else merge < right_until):
                return False
            if born[left] > born[right]:
                left_until = born[left]
                left = self.right[left]
            elif born[right] >= 0:
                right_until, before = born[right], None
                right = self.left[right]
            else:
                return True


class Encoder:
    """Encodes and decodes with one vocabulary; built anew in each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[int, bool] = {}
        self._start_afresh()
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for token in vocabulary.usable:
            self.automaton.add_word(vocabulary.symbols(token), token)
        self.automaton.make_automaton()
        self.sizes = vocabulary.sizes()
        self.size = self.sizes.tolist()
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.specials)) or r"(?!)")

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            known = self.known[key] = self.vocabulary.compatible(left, right)
        return known

    def _shorter(self, token: int) -> int | None:
        """The longest other token that this one starts with."""
        found = self.shorter.get(token, -1)
        if found == -1:
            symbols = self.vocabulary.symbols(token)
            found = None
            for end in range(len(symbols) - 1, 0, -1):
                if symbols[:end] in self.automaton:
                    found = self.automaton.get(symbols[:end])
                    break
            self.shorter[token] = found
        return found

    def backtrack(self, symbols: str) -> list[int]:
        """Tokens of one word, given as symbols."""
        length = len(symbols)
        longest: list[int] = [-1] * length
        size, known, shorten = self.size, self.known, self.shorter
        for end, token in self.automaton.iter(symbols):
            # Matches come by their ends, so a later one at the same start is longer.
            longest[end + 1 - size[token]] = token
        open_at = bytearray([1]) * (length + 1)
        tokens: list[int] = []
        place, token = 0, longest[0] if symbols else 0
        while place < length:
            end = place + size[token]
            if open_at[end]:
                fits = True
                if tokens:
                    fits = known.get(tokens[-1] << 32 | token)
                    if fits is None:
                        fits = self.fits(tokens[-1], token)
                if fits:
                    tokens.append(token)
                    place = end
                    if end < length:
                        token = longest[end]
                    continue
            shorter = shorten[token] if token in shorten else self._shorter(token)
            while shorter is None:
                # Nothing fits here: close this place and shorten the token before it.
                open_at[place] = 0
                token = tokens.pop()
                place -= size[token]
                shorter = self._shorter(token)
            token = shorter
        return tokens

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words (symbols, each with its end) one after another, and tokens per word."""
        found = list(self.automaton.iter_long("".join(words)))
        tokens = np.fromiter((t for _, t in found), np.int64, len(found))
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ends = np.cumsum(self.sizes[tokens])
        word = np.searchsorted(last, ends, side="left")
        inside = word[1:] == word[:-1]
        pairs, where = np.unique((tokens[:-1] << 32 | tokens[1:])[inside], return_inverse=True)
        good = np.fromiter((self.fits(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs), bool, len(pairs))
        bad = np.unique(word[1:][inside][~good[where]])
        counts = np.bincount(word, minlength=len(words))
        if not len(bad):
            return tokens, counts
        again = [self.backtrack(words[i]) for i in bad]
        keep = np.ones(len(words), bool)
        keep[bad] = False
        old_counts = counts.copy()
        counts[bad] = [len(t) for t in again]
        starts = np.cumsum(counts) - counts
        answer = np.empty(int(counts.sum()), np.int64)
        plain = keep[word]
        shift = (starts - (np.cumsum(old_counts) - old_counts))[word]
        answer[(np.arange(len(tokens)) + shift)[plain]] = tokens[plain]
        flat = np.fromiter((t for own in again for t in own), np.int64)
        spots = np.repeat(starts[bad], counts[bad]) + np.arange(len(flat)) - np.repeat(
            np.cumsum(counts[bad]) - counts[bad], counts[bad]
        )
        answer[spots] = flat
        return answer, counts

    def split(self, chunk: str) -> list[str]:
        """The splitter's pieces of a text without ASCII white space; special tokens stay as they are."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if chunk[-1] in ENDS and chunk.isascii() and chunk[:-1].isalpha():
            return [chunk[:-1].lower(), chunk[-1]]
        if "<|" in chunk:
            parts, at = [], 0
            for match in self.special.finditer(chunk):
                parts += self._plain_split(chunk[at : match.start()])
                parts.append(match.group())
                at = match.end()
            return parts + self._plain_split(chunk[at:])
        return self._plain_split(chunk)

    def _plain_split(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return self.pieces.findall(chunk.lower())
        # Letter by letter: a sigma at the end of a word gets no form of its own.
        return self.pieces.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def _start_afresh(self) -> None:
        """Nothing is remembered."""
        # Line of ``lists`` of each chunk (text between white space) and of each piece, see ``_learn``.
        self.rows: dict[str, int] = {}
        self.lists = _lists(np.zeros(1, np.int64), np.zeros(0, np.uint32))
        # Lines met again after the slice that brought them.
        self.met = np.zeros(0, bool)

    def _forget(self) -> None:
        """Keep what was met again; if that is more than half of what may be remembered, start afresh."""
        met = self.met.tolist()
        kept = {key: row for key, row in self.rows.items() if met[row]}
        if len(kept) > REMEMBERED // 2:
            return self._start_afresh()
        lines, row = np.unique(np.fromiter(kept.values(), np.int64, len(kept)), return_inverse=True)
        self.rows = dict(zip(kept, row.tolist(), strict=True))
        self.lists = self.lists.take(pa.array(lines))
        self.met = np.zeros(len(lines), bool)

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that were not met before and remember them.

        A chunk of small ASCII letters is a piece itself.  Other pieces are kept with
        a blank in front, which no chunk has.  A chunk of one piece shares its line.
        """
        rows, known = self.rows, len(self.lists)
        fresh: list[str] = []
        several: list[str] = []
        again: list[int] = []
        of_chunk: list[int] = []
        ends: list[int] = []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                pieces = [chunk if chunk.islower() else chunk.lower()]
            else:
                pieces = self.split(chunk)
            for piece in pieces:
                key = piece if piece.isalpha() and piece.isascii() else f" {piece}"
                row = rows.get(key)
                if row is None:
                    row = rows[key] = known + len(fresh)
                    fresh.append(piece)
                else:
                    again.append(row)
                of_chunk.append(row)
            if len(pieces) == 1:
                rows[chunk] = of_chunk.pop()
            else:
                several.append(chunk)
                ends.append(len(of_chunk))
        specials = self.vocabulary.specials
        plain = [p for p in fresh if p not in specials]
        raw = [p.encode().decode("latin-1") for p in plain]
        tokens, counts = self.encode_words([s[:-1] + chr(256 + ord(s[-1])) for s in raw])
        if len(plain) < len(fresh):
            lists = iter(np.split(tokens, np.cumsum(counts)[:-1]))
            own = [np.array([specials[p]]) if p in specials else next(lists) for p in fresh]
            tokens, counts = np.concatenate(own), np.array([len(o) for o in own])
        self.lists = _extended(self.lists, np.cumsum(counts), tokens)
        flat = self.lists.take(pa.array(of_chunk, pa.int64()))
        first = len(self.lists)
        self.lists = _extended(self.lists, flat.offsets.to_numpy()[np.array(ends, np.int64)], flat.flatten().to_numpy())
        rows.update(zip(several, range(first, len(self.lists)), strict=True))
        self._meet(np.array(again, np.int64), known)

    def _meet(self, rows: np.ndarray, known: int) -> None:
        """Mark lines that were there before this slice."""
        self.met = np.concatenate([self.met, np.zeros(len(self.lists) - len(self.met), bool)])
        self.met[rows[rows < known]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and where each text starts."""
        words = split_words(texts)
        if len(self.rows) > REMEMBERED:
            self._forget()
        rows, known = self.rows, len(self.lists)
        self._learn([chunk for chunk in words.vocabulary if chunk not in rows])
        codes = np.fromiter(map(rows.__getitem__, words.vocabulary), np.int64, len(words.vocabulary))
        self._meet(codes, known)
        every = self.lists.take(pa.array(codes[words.codes]))
        return every.flatten().to_numpy(), every.offsets.to_numpy()[words.starts]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Text of each row in UTF-8: token texts joined by blanks."""
        pieces = self.vocabulary.table.take(pa.array(ids, pa.int64()))
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)
        data = pieces.buffers()[2]
        data = memoryview(data) if data is not None else memoryview(b"")
        edges = offsets[starts] if len(ids) else np.zeros(len(starts), np.int64)
        return [bytes(data[a : max(a, b - 1)]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, pa.uint32()))


def _extended(lists: pa.LargeListArray, ends: np.ndarray, values: np.ndarray) -> pa.LargeListArray:
    """More lists after those there are."""
    offsets, old = lists.offsets.to_numpy(), lists.values.to_numpy()
    return _lists(np.concatenate([offsets, offsets[-1] + ends]), np.concatenate([old, values.astype(np.uint32)]))


def encode_batches(batches, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """doc_id, ids (list of int) and decoded text of each row."""
    encoder = Encoder(vocabulary)
    for batch in text_slices(batches, "text", SLICE_BYTES):
        ids, starts = encoder.encode(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
        decoded = pa.array(encoder.decode(ids, starts), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, decoded], names=["doc_id", "ids", "decoded"])
        del batch, ids, starts, lists, decoded
    # What the encoder remembers goes before the worker goes on to other work.
    del encoder
    release()


def digest_batches(encoded: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens and digests of what ``encode_batches`` gives."""
    for batch in encoded:
        lists, decoded = batch.column("ids"), batch.column("decoded")
        ids = memoryview(lists.flatten().to_numpy().astype("<u4").tobytes())
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids_digest = [hashlib.sha256(ids[4 * a : 4 * b]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        text_digest = [hashlib.sha256(t).hexdigest() for t in decoded.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(edges), pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _schema(documents: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *fields])


def encode_texts(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids, decoded of every row."""
    schema = _schema(
        documents, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())
    )
    return map_batches(documents.select("doc_id", "text"), lambda batches: encode_batches(batches, vocabulary), schema, BATCH_BYTES)


def encoding_digests(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, taken from its ids and decoded text."""
    schema = _schema(
        documents,
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    )
    return map_batches(
        documents.select("doc_id", "text"),
        lambda batches: digest_batches(encode_batches(batches, vocabulary)),
        schema,
        BATCH_BYTES,
    )


def encode_with_digests(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row."""
    schema = _schema(
        documents,
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    )

    def encode(batches):
        for batch in encode_batches(batches, vocabulary):
            for digests in digest_batches(iter([batch])):
                yield pa.RecordBatch.from_arrays(
                    [*digests.columns, batch.column("ids")], names=[*digests.schema.names, "ids"]
                )

    return map_batches(documents.select("doc_id", "text"), encode, schema, BATCH_BYTES)
