"""Fill-in-the-middle transformation by secondary sort.

A document is cut into units (a word with the white space before it, or white space
at the end) and two hashed cuts part it into prefix, middle and suffix.  No task puts
a transformed text together in memory: a document leaves as pieces of some units, keyed
by the document and the piece's place in the output.  The pieces are dealt by document
and sorted by key and place within each partition (``repartition`` with
``sortWithinPartitions``, the DataFrame form of repartitionAndSortWithinPartitions),
and the stream of pieces is the output: digests grow piece by piece.  For restoration
the sentinels met in that stream say which part a piece belongs to; its place in the
original follows from that and the form, and pieces are sorted once more by it.  A
plain document's output is in the original's order already, so that it is digested
twice in one stream.

Pieces travel compressed.  Memory is bounded by one Arrow batch of pieces; a text of
any length is one row where it is read, and pieces of at most ``PIECE`` bytes after that.

Null texts are empty and plain.  A document's key is its id, text length and two hashes
of its text; rows that are wholly equal send equal pieces, which come side by side, are
digested once and answered once for each row.  Ids may be null or shared.  A null id is
hashed as an empty one.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.texts import map_batches, release, text_slices

# The sentinels and the seed.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
SHARE, SPM_SHARE = 50, 80
FORMS = ("plain", "spm", "psm")
# Parts of a text, and the order in which each form puts them out, every part behind its sentinel.
ORDER = {"spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)), "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1))}
PART_OF = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
# Units of a piece, and its most bytes.
UNITS, PIECE = 4096, 1 << 16
# Pieces of a part; parts follow each other at this distance.
PLACES = 1 << 40

KEY = ["doc_id", "h1", "h2", "size"]


class Cut(NamedTuple):
    form: str
    units: int
    prefix_chars: int | None
    middle_chars: int | None
    parts: tuple[int, int, int, int]
    ends: np.ndarray


def unit_ends(text: bytes) -> np.ndarray:
    """Where each unit of a text ends, in bytes."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    last = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(last, len(raw)) if blank[-1] else last


def characters(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def cut(doc_id, text: bytes) -> Cut:
    """Form and borders of a document; depends on its id and text alone."""
    ends = unit_ends(text)
    n = len(ends)
    digest = sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not n or h3 % 100 >= SHARE or any(s in text for s in PART_OF):
        return Cut("plain", n, None, None, (0, len(text), len(text), len(text)), ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[i - 1]) if i else 0 for i in (first, second))
    form = "spm" if h4 % 100 < SPM_SHARE else "psm"
    return Cut(form, n, characters(text[:a]), characters(text[a:b]), (0, a, b, len(text)), ends)


def pieces(text: bytes, start: int, end: int, ends: np.ndarray) -> Iterator[bytes]:
    """A part of a text in pieces of at most ``UNITS`` units and ``PIECE`` bytes."""
    at = start
    while at < end:
        unit = int(np.searchsorted(ends, at, side="right"))
        by_units = int(ends[min(unit + UNITS, len(ends)) - 1])
        by_size = int(np.searchsorted(ends, at + PIECE, side="right"))
        # Whole units if one fits at all.
        stop = int(ends[by_size - 1]) if by_size and ends[by_size - 1] > at else at + PIECE
        stop = min(stop, by_units, end)
        yield text[at:stop]
        at = stop


def output_pieces(text: bytes, own: Cut) -> Iterator[tuple[int, bytes]]:
    """(place, piece) of a document's output; there is always one."""
    if own.form == "plain":
        yield 0, b""
        for i, piece in enumerate(pieces(text, 0, len(text), own.ends)):
            yield i + 1, piece
        return
    for number, (sentinel, part) in enumerate(ORDER[own.form]):
        yield number * PLACES, sentinel
        for i, piece in enumerate(pieces(text, own.parts[part], own.parts[part + 1], own.ends)):
            yield number * PLACES + i + 1, piece


def _schema(kind: T.DataType, more: str) -> T.StructType:
    key = [T.StructField("doc_id", kind), *(T.StructField(k, T.LongType()) for k in KEY[1:])]
    return T.StructType(key + T._parse_datatype_string(more).fields)


ABOUT = "n long, form string, prefix_chars long, middle_chars long"
CUT = f"{ABOUT}, place long, piece binary"
ASSEMBLED = f"{ABOUT}, place long, piece binary, output_sha256 string, restored_sha256 string, copies long"
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


class _Rows:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int) -> pa.RecordBatch | None:
        self.rows.append(row)
        self.bytes += size
        return self.flush() if len(self.rows) >= BATCH_ROWS or self.bytes >= BATCH_BYTES else None

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.bytes = [], 0
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _arrow(schema: T.StructType, doc_id: pa.DataType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, doc_id if i == 0 else kinds[f.dataType]) for i, f in enumerate(schema.fields)])


def cut_batches(batches, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Pieces of every document, keyed by document and place in the output."""
    pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    rows = None
    for batch in text_slices(batches, "text"):
        rows = rows or _Rows(_arrow(schema, batch.column("doc_id").type))
        keys = zip(*(batch.column(k).to_pylist() for k in KEY), strict=True)
        for key, value in zip(keys, batch.column("text"), strict=True):
            text = value.as_buffer()
            text = text.to_pybytes() if text is not None else b""
            own = cut(key[0], text)
            about = (*key, own.units, own.form, own.prefix_chars, own.middle_chars)
            for place, piece in output_pieces(text, own):
                packed = pack(piece) if piece else b""
                full = rows.add((*about, place, packed), len(packed) + 64)
                if full is not None:
                    yield full
    if rows is not None:
        yield rows.flush()


def stream(batches, columns: list[str]) -> Iterator[tuple]:
    """Rows of sorted batches, one by one."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _documents(batches) -> Iterator[tuple[tuple, Iterator[tuple[int, bytes, int]]]]:
    """Key of each document in a sorted stream, and place, piece and how many equal rows sent it."""
    columns = [*KEY, "n", "form", "prefix_chars", "middle_chars", "place", "piece"]

    def places(rows):
        for place, same in groupby(rows, key=lambda row: row[8]):
            piece = next(same)[9]
            yield place, piece, 1 + sum(1 for _ in same)

    for key, rows in groupby(stream(batches, columns), key=lambda row: row[:8]):
        yield key, places(rows)


def assemble_batches(batches, schema: T.StructType, doc_id: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Digest the output of every document and send transformed pieces on, keyed by their place in the original.

    A document's own row has place -1.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    rows = _Rows(_arrow(schema, doc_id))
    for about, places in _documents(batches):
        plain = about[5] == "plain"
        digest, part, copies = sha256(), None, 0
        for place, packed, copies in places:
            piece = unpack(packed) if packed else b""
            digest.update(piece)
            if plain:
                continue
            if place % PLACES == 0:
                # The output says itself which part begins here.
                part = PART_OF[piece]
                continue
            # Equal rows go on as one.
            full = rows.add((*about, part * PLACES + place % PLACES, packed, None, None, None), len(packed) + 64)
            if full is not None:
                yield full
        done = digest.hexdigest()
        full = rows.add((*about, -1, b"", done, done if plain else None, copies), 200)
        if full is not None:
            yield full
    yield rows.flush()
    release()


def restore_batches(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The answer of every document: its own row comes first, then its pieces in the original's order."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = _Rows(schema)
    columns = [*KEY, "n", "form", "prefix_chars", "middle_chars", "place", "piece", "output_sha256", "restored_sha256", "copies"]
    for about, own in groupby(stream(batches, columns), key=lambda row: row[:8]):
        digest, answer = sha256(), None
        for row in own:
            if row[8] == -1:
                answer = row
            else:
                digest.update(unpack(row[9]))
        restored = answer[11] or digest.hexdigest()
        for _ in range(answer[12]):
            full = rows.add((about[0], *about[4:], answer[10], restored), 200)
            if full is not None:
                yield full
    yield rows.flush()
    release()


def dealt(rows: DataFrame) -> DataFrame:
    """Secondary sort: by document, then by place."""
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "place")


def cut_documents(documents: DataFrame) -> DataFrame:
    """Pieces of all outputs: key, form, place and (compressed) piece, in no order."""
    schema = _schema(documents.schema["doc_id"].dataType, CUT)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.select(
        "doc_id",
        F.xxhash64(text).alias("h1"),
        F.hash(text).cast("long").alias("h2"),
        F.octet_length(text).cast("long").alias("size"),
        text.alias("text"),
    )
    return map_batches(keyed, lambda batches: cut_batches(batches, schema), schema)


def output_texts(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the transformed texts themselves."""
    kind = documents.schema["doc_id"].dataType
    cut_rows = cut_documents(documents)
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(f"{ABOUT}, output string").fields])

    def join(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        rows = _Rows(_arrow(schema, _arrow_kind(kind)))
        for about, places in _documents(batches):
            parts, copies = [], 0
            for _, packed, copies in places:
                parts.append(unpack(packed) if packed else b"")
            text = b"".join(parts).decode()
            for _ in range(copies):
                full = rows.add((about[0], *about[4:], text), len(text))
                if full is not None:
                    yield full
        yield rows.flush()

    return map_batches(dealt(cut_rows), join, schema)


def _arrow_kind(kind: T.DataType) -> pa.DataType:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    return kinds[kind]


def fill_in_middle(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    kind = documents.schema["doc_id"].dataType
    id_kind = _arrow_kind(kind)
    assembled_schema = _schema(kind, ASSEMBLED)
    fields = T._parse_datatype_string(f"{ABOUT}, output_sha256 string, restored_sha256 string").fields
    answer_schema = T.StructType([T.StructField("doc_id", kind), *fields])
    arrow = _arrow(answer_schema, id_kind)
    assembled = dealt(cut_documents(documents)).mapInArrow(
        lambda batches: assemble_batches(batches, assembled_schema, id_kind), assembled_schema
    )
    return dealt(assembled).mapInArrow(lambda batches: restore_batches(batches, arrow), answer_schema)
