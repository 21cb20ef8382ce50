"""Bounded samples of labelled documents, and the rows that stay out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of its letters."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(remainder("doc_id", modulus) == rest, F.lit(False))


def labelled(labels: DataFrame, label: str, modulus: int = 4, rest: int = 2) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of all ids that may be learned from, and the labels counted."""
    known = (
        labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", modulus) != rest))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    return known, {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}


def labelled_texts(documents: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, label, text of the documents with a label; one row per id, with its smallest text."""
    rows = documents.select("doc_id", "text").join(known, "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int = 4, rest: int = 2
) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` documents of each label: (doc_id, text, label), and the labels counted.

    Rows whose remainder is ``rest`` never enter.  The draw follows a hash of the
    id, so it is the same on every run.  A document labelled more than once has
    the highest of its labels; a document stored more than once enters once, with
    its smallest text.  Labels other than 0 and 1 and null ids are no labels.
    """
    known, counts = labelled(labels, label, modulus, rest)
    drawn = [
        known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    # Two times per_class narrow rows at most.
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))
    return labelled_texts(documents, ids), counts


# Parts of the range of a hash: fine enough to draw a few documents of many billions.
PARTS = 1 << 50


def drawn_by_hash(share: float | Column, *columns: str) -> Column:
    """Whether a row belongs to a ``share`` of all rows, by a hash of its columns."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS)) < share * PARTS


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marked for broadcast if it has at most so many (narrow) rows; they are counted first."""
    return F.broadcast(df) if df.count() <= rows else df
