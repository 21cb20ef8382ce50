"""Near-duplicate documents by DartMinHash signatures and banded joins.

Texts are weighted sets: shingles of five words (lower case, no punctuation at the
ends of words), each weighted by how often it occurs.  Two texts are near duplicates
if the weighted Jaccard similarity of these sets is ``SIMILARITY`` or more, and the
classes are the connected groups of near duplicates.

1. Every text is sketched in an Arrow task.  For each element, the plane of weight
   and rank is cut into cells of unit area that a hash fills with darts (Poisson with
   mean 1).  Darts below the element's weight count; each dart belongs to one of
   ``BANDS * ROWS`` coordinates and the one of lowest rank is kept there.  Only ranks
   are visited that are expected to hold enough darts for all coordinates; a text
   that lacks one is thrown at again with twice as many.
2. Texts with the same words are one node; copies are never compared.
3. Nodes that share a band form a bucket.  Each bucket is compared with its hub, the
   member that shares most in all its buckets, and similarity is worked out exactly
   from the shingles.  Members linked to the hub are in one class and need no
   comparison among themselves.
4. The rest is exact: in buckets that still hold several classes, members of
   different classes are compared in blocks of bounded size, each pair in the first band
   whose key it shares.  The distances to the hub rule out pairs by the triangle inequality,
   signatures rule out those whose agreement is far from the limit (more than four
   standard deviations), and what remains is again worked out exactly.  A block gives
   the links that join its classes; a link inside a class that is already joined adds
   nothing to it and is not given.
5. Classes are found by passing on the smallest node and jumping along the labels.

A pair just at the limit shares no band with a chance of 1 in 10,000, less above it.
Null and empty texts are copies of one another.  A text of fewer than five words has
one shingle.  Rows that share an id keep a row each, by their texts; null ids are
allowed; an empty table gives no rows; other columns are ignored, or kept as they are
by ``keep_one``.  Ties go to the smallest id;
a null id is kept only in a class without others.  Intermediate tables are written to the
shared folder, so a lost executor repeats only its own tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.labelled import small
from tillscope.llm.style import row_of
from tillscope.llm.texts import Words, bare, map_batches, mix, split_words, text_slices, word_hashes
from tillscope.session import scratch_path

SIMILARITY = 0.8
WIDTH = 5
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
# Expected darts per text: so many that about one text in twenty needs a second throw.
DARTS = COORDINATES * (np.log(COORDINATES) + 3)
# Agreement of signatures below which a pair is not looked at again.
AGREEMENT = SIMILARITY - 4.5 * np.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
BLOCK = 512
# Text sketched at once, and bytes of a batch that a task works on.
SKETCH_BYTES = 1 << 20
BATCH_BYTES = 16 << 20
# Chances of at most 0, 1, 2, ... darts in a cell.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the different shingles of each text, by row and hash."""
    hashes = word_hashes([bare(w) or w for w in words.vocabulary])
    own = np.concatenate([hashes[words.codes], np.zeros(WIDTH, np.uint64)])
    lengths = np.diff(words.starts)
    rows = row_of(words)
    place = np.arange(len(rows)) - words.starts[:-1][rows]
    first = np.flatnonzero(place < np.maximum(lengths - WIDTH + 1, 1)[rows])
    rows = rows[first]
    left = words.starts[1:][rows] - first
    key = np.zeros(len(first), np.uint64)
    for k in range(WIDTH):
        key = mix(key * np.uint64(31) + np.where(k < left, own[first + k], np.uint64(0)) + np.uint64(k + 1))
    order = np.lexsort((key, rows))
    rows, key = rows[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
    start = np.flatnonzero(new)
    return rows[start], key[start], np.diff(np.concatenate([start, [len(key)]]))


def throw_darts(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, darts: float = DARTS) -> np.ndarray:
    """Signatures (one line per row) of weighted sets; lines of rows without elements are 0."""
    signature = np.zeros((rows, COORDINATES), np.uint64)
    total = np.bincount(row, weight, rows)
    open_rows = total > 0
    while open_rows.any():
        chosen = open_rows[row]
        limit = np.where(open_rows, darts / np.where(total > 0, total, 1), 0.0)
        lowest, ids = _lowest(row[chosen], element[chosen], weight[chosen], limit, rows)
        whole = open_rows & np.isfinite(lowest).all(axis=1)
        signature[whole] = ids[whole]
        open_rows &= ~whole
        darts *= 2
    return signature


def _lowest(row, element, weight, limit, rows) -> tuple[np.ndarray, np.ndarray]:
    """Lowest rank and its dart, per row and coordinate, among darts with a rank below the row's limit."""
    lowest = np.full(rows * COORDINATES, np.inf)
    ids = np.zeros(rows * COORDINATES, np.uint64)
    highest = limit[row]
    parts = []
    for high in range(int(np.log2(1 + weight.max(initial=0))) + 1):
        for far in range(int(np.log2(1 + highest.max(initial=0))) + 1):
            base_weight, base_rank = 2.0**high - 1, 2.0**far - 1
            wide, tall = 2.0 ** (high - far), 2.0 ** (far - high)
            here = np.flatnonzero((weight > base_weight) & (highest > base_rank))
            if not len(here):
                continue
            across = np.minimum(2**far, np.ceil((weight[here] - base_weight) / wide)).astype(np.int64)
            along = np.minimum(2**high, np.ceil((highest[here] - base_rank) / tall)).astype(np.int64)
            cells = across * along
            owner = np.repeat(here, cells)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
            up, right = np.divmod(number, np.repeat(along, cells))
            level = np.uint64(((high << 8 | far) + 1) * 0x9E3779B97F4A7C15 % 2**64)
            cell = mix(element[owner] + level)
            cell = mix(cell ^ (up.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)))
            hits = np.searchsorted(POISSON, (cell >> np.uint64(11)) * 2.0**-53, side="right")
            owner, up, right, cell = (np.repeat(a, hits) for a in (owner, up, right, cell))
            dart = np.arange(len(owner)) - np.repeat(np.cumsum(hits) - hits, hits)
            spot = mix(cell + (dart.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
            rank = base_rank + (right + (spot >> np.uint64(11)) * 2.0**-53) * tall
            near = np.flatnonzero(rank < highest[owner])
            owner, up, spot, rank = owner[near], up[near], spot[near], rank[near]
            name = mix(spot)
            inside = base_weight + (up + (name >> np.uint64(32)) * 2.0**-32) * wide < weight[owner]
            parts.append((owner[inside], name[inside], rank[inside]))
    for owner, name, rank in parts:
        key = row[owner] * COORDINATES + (name & np.uint64(0xFFFFFFFF)).astype(np.int64) % COORDINATES
        np.minimum.at(lowest, key, rank)
    for owner, name, rank in parts:
        key = row[owner] * COORDINATES + (name & np.uint64(0xFFFFFFFF)).astype(np.int64) % COORDINATES
        first = rank == lowest[key]
        ids[key[first]] = name[first]
    return lowest.reshape(rows, COORDINATES), ids.reshape(rows, COORDINATES)


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, k::ROWS])
    return keys.view(np.int64)


def sketch_batches(batches) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash, digest of the words, band keys and short signature of each row."""
    for batch in text_slices(batches, "text", SKETCH_BYTES):
        words = split_words(batch.column("text"))
        hashes = word_hashes([bare(w) or w for w in words.vocabulary])[words.codes]
        edges = words.starts.tolist()
        digests = [
            hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest()
            for a, b in zip(edges[:-1], edges[1:], strict=True)
        ]
        row, element, count = shingles(words)
        signature = throw_darts(row, element, count.astype(np.float64), batch.num_rows)
        keys = band_keys(signature)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(batch.num_rows + 1) * BANDS, pa.int32()), pa.array(keys.ravel(), pa.int64())
        )
        # Bits that do not fix the coordinate, which is the lower half modulo COORDINATES.
        short = [line.tobytes() for line in (signature >> np.uint64(32) & np.uint64(255)).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(digests), lists, pa.array(short)],
            names=["doc_id", "text_hash", "digest", "bands", "short"],
        )


def element_batches(batches) -> Iterator[pa.RecordBatch]:
    """node and its elements: sorted 32-bit hashes of (shingle, number of its occurrence)."""
    for batch in text_slices(batches, "text", SKETCH_BYTES):
        row, element, count = shingles(split_words(batch.column("text")))
        every = np.repeat(np.arange(len(row)), count)
        turn = np.arange(len(every)) - np.repeat(np.cumsum(count) - count, count)
        packed = (mix(element[every] + turn.astype(np.uint64)) >> np.uint64(32)).astype("<u4")
        rows = row[every]
        order = np.lexsort((packed, rows))
        packed = packed[order]
        ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        values = [packed[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(values, pa.binary())], names=["node", "elements"]
        )


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of elements."""
    if not len(a) or not len(b):
        return 0.0
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def similarity_batches(batches) -> Iterator[pa.RecordBatch]:
    """a, b and their exact similarity, from the elements of both."""
    for batch in batches:
        values = np.zeros(batch.num_rows)
        for i, (a, b) in enumerate(zip(batch.column("left"), batch.column("right"), strict=True)):
            values[i] = _jaccard(np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(values)], names=["a", "b", "similarity"]
        )


def compare_block(members: pd.DataFrame) -> pd.DataFrame:
    """Links between the classes of a block (or of two blocks), as few as join what belongs together."""
    sides = [members[members.side == 0], members[members.side == 1]]
    alone = not (len(sides[0]) and len(sides[1]))
    one, two = (members, members) if alone else sides
    left, right = (np.frombuffer(b"".join(s.short), np.uint8).reshape(len(s), COORDINATES) for s in (one, two))
    # Without band keys every pair is compared here, also those that share an earlier band.
    keyed = "bands" in members
    keys = [np.array(s.bands.tolist(), np.int64).reshape(len(s), BANDS) for s in (one, two)] if keyed else []
    label, far = ([s[c].to_numpy() for s in (one, two)] for c in ("label", "distance"))
    size = [s.elements.map(len).to_numpy() for s in (one, two)]
    band = int(members.band.iloc[0])
    found = []
    for i in range(len(one)):
        same = (left[i] == right).mean(axis=1)
        fits = (same >= AGREEMENT) & (label[1] != label[0][i])
        # Unknown distances (NaN) rule nothing out.
        fits &= ~(np.abs(far[1] - far[0][i]) > 1 - SIMILARITY + 1e-9)
        fits &= np.minimum(size[1], size[0][i]) >= SIMILARITY * np.maximum(size[1], size[0][i])
        if alone:
            fits[: i + 1] = False
        at = np.flatnonzero(fits)
        # In an earlier band that they share, the pair is compared there; only the keys tell, as short signatures clash.
        if keyed:
            at = at[(keys[1][at] == keys[0][i]).argmax(axis=1) == band]
        found += zip(-same[at], [i] * len(at), at.tolist(), strict=True)
    above: dict[int, int] = {}

    def top(name: int) -> int:
        while name in above:
            name = above[name]
        return name

    elements = [[np.frombuffer(e, "<u4") for e in s.elements] for s in (one, two)]
    node = [s.node.tolist() for s in (one, two)]
    links = []
    for _, i, j in sorted(found):
        a, b = top(label[0][i]), top(label[1][j])
        if a != b and _jaccard(elements[0][i], elements[1][j]) >= SIMILARITY:
            above[max(a, b)] = min(a, b)
            links.append((node[0][i], node[1][j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


@contextmanager
def _batches_of(spark: SparkSession, size: int):
    """Arrow batches of at most this many bytes while something is written."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _batches_of(spark, BATCH_BYTES):
        df.write.parquet(path)
    return spark.read.parquet(path)


def sketch(documents: DataFrame) -> DataFrame:
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("text_hash", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("short", T.BinaryType()),
        ]
    )
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_batches(rows, sketch_batches, schema)


def _similar(pairs: DataFrame, elements: DataFrame, name: str) -> DataFrame:
    """Exact similarity of pairs of nodes."""
    both = pairs.join(elements.select(F.col("node").alias("a"), F.col("elements").alias("left")), "a").join(
        elements.select(F.col("node").alias("b"), F.col("elements").alias("right")), "b"
    )
    columns = both.select("a", "b", "left", "right")
    return _stored(columns.mapInArrow(similarity_batches, "a long, b long, similarity double"), name)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node is connected with."""
    both = _stored(
        links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        ).distinct(),
        "links",
    )
    labels = _stored(
        both.groupBy("u").agg(F.min("v").alias("low")).select(
            F.col("u").alias("node"), F.least("u", "low").alias("label")
        ),
        "labels",
    )
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("around"))
        )
        near = labels.join(around, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "around").alias("label")
        )
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = _stored(
            near.join(far, "label").select("node", "old", F.least("label", "next").alias("label")), "labels"
        )
        labels = moved.select("node", "label")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class_id, keep_hash, copies): the class of every row.

    ``class_id`` is the smallest id of the class.  The row to keep has that id and the
    text hash ``keep_hash``; ``copies`` counts the rows of the same id and text.
    """
    sketched = _stored(sketch(documents), "sketch")
    nodes = _stored(
        sketched.groupBy("digest")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("first"),
            F.first("bands").alias("bands"),
            F.first("short").alias("short"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    labels = _labels(documents, nodes)

    named = nodes.select("digest", "node", "first").join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    # Only classes of several nodes need to look for their smallest id.
    least = named.where(F.col("label") != F.col("node")).select("label").distinct()
    several = named.join(least, "label", "left_semi").groupBy("label").agg(F.min("first").alias("least"))
    classes = named.join(several, "label", "left").select("digest", F.coalesce("least", "first").alias("kept"))
    rows = sketched.groupBy("digest", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    return rows.join(classes, "digest").select(
        "doc_id", "text_hash", F.col("kept.doc_id").alias("class_id"), F.col("kept.text_hash").alias("keep_hash"), "copies"
    )


def _labels(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) of the nodes that are linked to others."""
    entries = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    shared = _stored(entries.join(sizes, "key"), "buckets")
    # The hub of a bucket shares most with others in all its buckets; equals by number.
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub"))
    rays = _stored(shared.join(hubs.select("key", F.col("hub.node").alias("hub")), "key"), "rays")
    star = rays.where(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()

    elements = _elements(documents, nodes, shared.select("node").distinct())
    known = _similar(star, elements, "similar")
    links = known.where(F.col("similarity") >= SIMILARITY).select("a", "b")
    labels = components(links)

    more = _rest(rays, known, labels, nodes, elements)
    if more.isEmpty():
        return labels
    return components(links.unionByName(more))


def _elements(documents: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Elements of the nodes that share a bucket, read again from one of their texts."""
    places = nodes.join(wanted, "node", "left_semi").select("node", "first.doc_id", "first.text_hash")
    places = small(places.withColumnRenamed("doc_id", "place"))
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("own_hash"))
    same = texts["doc_id"].eqNullSafe(places["place"]) & (texts["own_hash"] == places["text_hash"])
    found = texts.join(places, same).select("node", "text").mapInArrow(element_batches, "node long, elements binary")
    # Rows repeated with id and text give a node more than once.
    return _stored(found.groupBy("node").agg(F.min("elements").alias("elements")), "elements")


def _rest(rays: DataFrame, known: DataFrame, labels: DataFrame, nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Links between members of a bucket that are in different classes after the hubs."""
    distance = known.select(F.col("a").alias("node"), F.col("b").alias("hub"), (1 - F.col("similarity")).alias("distance"))
    members = (
        rays.where((F.col("size") > 2) & (F.col("node") != F.col("hub")))
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .join(distance, ["node", "hub"], "left")
        .join(elements.select("node", F.length("elements").alias("bytes")), "node")
    )
    members = _stored(members.select("key", "band", "node", "label", "distance", "bytes"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BATCH_BYTES)).cast("int")
    mixed = (
        members.groupBy("key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), blocks.alias("blocks"))
        .where(F.col("low") != F.col("high"))
        .select("key", "blocks")
    )
    rest = members.join(mixed, "key").join(nodes.select("node", "short", "bands"), "node").join(elements, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # A block meets itself and every other block of its bucket, each in a task of its own.
    dealt = (
        rest.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "band",
            "node",
            "label",
            F.coalesce("distance", F.lit(float("nan"))).alias("distance"),
            "short",
            "bands",
            "elements",
        )
    )
    found = dealt.groupBy("key", "low", "high").applyInPandas(compare_block, "a long, b long")
    return _stored(found.distinct(), "rest")


def duplicate_classes(documents: DataFrame) -> DataFrame:
    """doc_id and class_id of every row of the table."""
    rows = near_duplicates(documents)
    return rows.select("doc_id", "class_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n")).drop("n")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each class, all columns as they are."""
    rows = _stored(near_duplicates(documents), "classes")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("keep_hash"))
    out = _keys(rows.where(~kept | (F.col("copies") > 1)))
    repeated = _keys(rows.where(kept & (F.col("copies") > 1)))
    once = documents.join(out, _same(documents, out), "left_anti")
    again = documents.join(repeated, _same(documents, repeated), "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def _keys(rows: DataFrame) -> DataFrame:
    return small(rows.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")).distinct())


def _same(documents: DataFrame, keys: DataFrame):
    return documents["doc_id"].eqNullSafe(keys["key_id"]) & (F.xxhash64(documents["text"]) == keys["key_hash"])
