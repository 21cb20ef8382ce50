"""Token counts per source, language and tokenizer version, kept up by signed deltas.

A batch of changes inserts, deletes or revises the counts of documents.  What it says
of a document and version replaces what the ledger last said of them: those amounts go
out, the new ones come in.  The signed sums per (source, lang, version) are added up by
``totals``; nothing is counted again.  Only ledger rows of the batch's own documents are
looked at, and once ``FOLD`` batches are in effect they are folded into one.

A batch is written to a folder of its own and takes effect by one row appended to the
list of commits, and so does a fold.  A batch that is in the list is not applied again,
and folders that never made it there are ignored, so a batch may be repeated after any
failure.  One writer at a time.

Within a batch the last kind of change per document and version counts, in the order
delete, insert, revise.  All rows of that kind that share an id count, repeated rows as
well, and later changes of that id replace them together; rows with a null id are such a
group.  An insert of a known document replaces its counts; a revision of an unknown one
inserts it; deleting an unknown one does nothing.  A text of any length is counted whole.
Null texts have no tokens; null sources and languages are values like others.  A group
whose documents have all gone is not listed.  An empty table gives no rows, other
columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.bpe import SLICE_BYTES, Encoder, Vocabulary
from tillscope.llm.texts import map_batches, text_slices

# Tokenizer versions as patterns: words between ASCII white space; letter runs, single digits and signs.
VERSIONS = {
    "words-v1": r"[^\x20\x09-\x0D]+",
    "pieces-v2": r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]",
}
KINDS = ["delete", "insert", "revise"]
GROUP = ["source", "lang", "version"]
DOCUMENT = ["doc_id", "version"]
FOLD = 16


def count_tokens(documents: DataFrame, kind: str, text: Column | None = None) -> DataFrame:
    """Changes (doc_id, kind, source, lang, version, tokens) that count documents with every version."""
    text = F.coalesce(text if text is not None else F.col("text"), F.lit(""))
    counted = F.array(
        *(
            F.struct(F.lit(name).alias("version"), F.regexp_count(text, F.lit(pattern)).cast("long").alias("tokens"))
            for name, pattern in VERSIONS.items()
        )
    )
    return documents.select("doc_id", "source", "lang", F.explode(counted).alias("count")).select(
        "doc_id", F.lit(kind).alias("kind"), "source", "lang", "count.version", "count.tokens"
    )


def count_encoded(documents: DataFrame, kind: str, vocabulary: Vocabulary, version: str) -> DataFrame:
    """The same changes with the number of ids that a public tokenizer gives, as one more version."""
    kept = documents.select("doc_id", "source", "lang", "text")

    def count(batches):
        encoder = Encoder(vocabulary)
        for batch in text_slices(batches, "text", SLICE_BYTES):
            _, starts = encoder.encode(batch.column("text"))
            columns = [*(batch.column(i) for i in range(3)), pa.array(np.diff(starts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "lang", "tokens"])

    schema = T.StructType([*kept.schema.fields[:3], T.StructField("tokens", T.LongType())])
    return map_batches(kept, count, schema).select(
        "doc_id", F.lit(kind).alias("kind"), "source", "lang", F.lit(version).alias("version"), "tokens"
    )


def withdraw(documents: DataFrame, versions: list[str] | None = None) -> DataFrame:
    """Changes that delete documents, whatever was counted for them; ``documents`` needs only ``doc_id``."""
    none = F.lit(None)
    return documents.select(
        "doc_id",
        F.lit("delete").alias("kind"),
        none.cast("string").alias("source"),
        none.cast("string").alias("lang"),
        F.explode(F.array(*map(F.lit, versions or VERSIONS))).alias("version"),
        none.cast("long").alias("tokens"),
    )


class TokenRollup:
    """Totals under a folder that all executors can reach."""

    COMMITS = "batch string, folder string, number int"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        spark.createDataFrame([], self.COMMITS).coalesce(1).write.mode("ignore").parquet(f"{root}/commits")

    def commits(self) -> DataFrame:
        """One row per batch in effect, and one without a name per fold of all batches up to its number."""
        return self.spark.read.schema(self.COMMITS).parquet(f"{self.root}/commits")

    def _state(self, batch: str | None = None) -> tuple[int, bool, list[str]]:
        """Last number, whether a batch is in effect, and folders in effect: the last fold and at most FOLD batches."""
        commits, named = self.commits(), F.col("batch").isNotNull()
        fold = F.max(F.when(~named, F.struct("number", "folder")))
        last, known, fold = commits.agg(F.max("number"), F.max(F.col("batch") == F.lit(batch)), fold).first()
        later = commits.where(named & (F.col("number") > (fold["number"] if fold else 0))).orderBy("number").collect()
        return last or 0, bool(known), [row["folder"] for row in ([fold] if fold else []) + later]

    def _read(self, part: str, folders: list[str]) -> DataFrame | None:
        paths = [f"{self.root}/{folder}/{part}" for folder in folders]
        return self.spark.read.parquet(*paths) if paths else None

    def _append(self, batch: str | None, folder: str, number: int) -> None:
        row = self.spark.createDataFrame([(batch, folder, number)], self.COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it has been applied before."""
        last, known, folders = self._state(batch)
        if known:
            return False
        if len(folders) >= FOLD:
            folders = [self._fold(last, folders)]
        before = self._read("ledger", folders)
        number, folder = last + 1, f"batch-{uuid.uuid4().hex}"
        _entries(changes, number).write.parquet(f"{self.root}/{folder}/ledger")
        now = self.spark.read.parquet(f"{self.root}/{folder}/ledger")
        _summed(_signed(now, before)).write.parquet(f"{self.root}/{folder}/delta")
        self._append(batch, folder, number)
        return True

    def fold(self) -> None:
        """Write the ledger and totals in effect to one folder that stands for all batches so far."""
        last, _, folders = self._state()
        if folders:
            self._fold(last, folders)

    def _fold(self, number: int, folders: list[str]) -> str:
        folder = f"fold-{uuid.uuid4().hex}"
        live = _latest(self._read("ledger", folders)).where("documents > 0")
        live.withColumn("number", F.lit(number)).write.parquet(f"{self.root}/{folder}/ledger")
        _totals(self._read("delta", folders)).write.parquet(f"{self.root}/{folder}/delta")
        self._append(None, folder, number)
        return folder

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens: the sums of all deltas in effect."""
        delta = self._read("delta", self._state()[2])
        if delta is None:
            return self.spark.createDataFrame(
                [], "source string, lang string, version string, documents long, tokens long"
            )
        return _totals(delta)


def _summed(amounts: DataFrame) -> DataFrame:
    return amounts.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


def _totals(deltas: DataFrame) -> DataFrame:
    return _summed(deltas).where((F.col("documents") != 0) | (F.col("tokens") != 0))


def _entries(changes: DataFrame, number: int) -> DataFrame:
    """What holds of each document and version from now on: a row per source and language, one of zeros if deleted.

    Rows that share all of these are added up before any other step, so one id may have any share of the rows.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    live = F.col("kind") != "delete"
    added = (
        changes.select(
            *DOCUMENT, rank.alias("rank"), *(F.when(live, F.col(name)).alias(name) for name in ("source", "lang")),
            live.cast("long").alias("documents"), F.when(live, F.col("tokens")).alias("tokens"),
        )
        .groupBy(*DOCUMENT, "rank", "source", "lang")
        .agg(F.sum("documents").alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    )
    last = F.max("rank").over(Window.partitionBy(*DOCUMENT))
    return added.withColumn("last", last).where("rank = last").drop("rank", "last").withColumn("number", F.lit(number))


def _latest(ledger: DataFrame) -> DataFrame:
    """The rows of the last batch that spoke of each document and version."""
    last = F.max("number").over(Window.partitionBy(*DOCUMENT))
    return ledger.withColumn("last", last).where("number = last").drop("last")


def _signed(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Signed amounts: plus what holds now, minus what held before of the same documents."""
    amounts = now.select(*GROUP, "documents", "tokens")
    if before is None:
        return amounts
    keys = now.select(*(F.col(name).alias(f"now_{name}") for name in DOCUMENT)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("now_doc_id")) & (F.col("version") == F.col("now_version"))
    held = _latest(before.join(keys, same, "left_semi"))
    return amounts.unionByName(held.select(*GROUP, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens")))
