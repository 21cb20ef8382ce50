"""Licence scan: TF-IDF cosine of passages to templates, and inheritance along directories.

Passages of a file are its lines, its blocks (adjacent lines without an empty one between
them), the sentences of its blocks, and the whole text of a file named like a licence
file.  A passage and a template are sparse vectors of their terms, weighted by
(1 + ln(count)) * (ln((1 + templates) / (1 + templates with the term)) + 1); stop words
are no terms.  A passage is given the
template of the highest cosine among those it meets the needs of (versions, kinds), if
that is ``LIKE`` or more, and a file its best passage's.  Files named like a licence file
speak for their directory.  A file without a licence of its own takes that of the nearest
directory above it that has one.

Only built-in functions are used.  Equal passages are scored once.  Passages without
any anchor are not scored, and can't be like a template: the other terms of each
template weigh less than ``LIKE`` together.  Directories are joined with the directories
above them once each, and files with their directory by an equality join.

Null texts have no passages and null paths no directory.  Equal cosines go to the earlier
template.  A text of any length is read whole; the notices in it are found in its lines,
sentences and blocks.  Repeated rows get the same answer and keep a row each; an empty
table gives no rows; other columns are ignored.  Without templates nothing is found.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.labelled import small
from tillscope.llm.license_notices import STOP_WORDS, TERM, Template, common_licenses
from tillscope.session import scratch_path

LIKE = 0.6
# Documents that open or close with such a line are taken for licence files (``files_of``).
SIGNAL = r"(?i)licen[cs]|copyright|spdx|warrant|redistribut"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
EMPTY_LINES = r"\n[\x20\x09\x0D]*\n"
# A mark of punctuation, blanks, and what a sentence may start with; "v. 2.0" stays together.
SENTENCE_END = r"([.!?;])[\x20\x09-\x0D]+([^0-9\x20\x09-\x0D])"
CUT = "\x01"
# Words of other languages and single letters are anchors last.
FREQUENT = ["mit", "sa", "nd", "nc", "v", "c", "s", "d"]

TEMPLATES = common_licenses()


def terms_of(text: str) -> Counter:
    return Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP_WORDS)


def template_weights(templates: list[Template]) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Weight of each term of the templates, and each template's terms with unit-length weights."""
    counts = [terms_of(text) for _, text, _ in templates]
    held = Counter(term for own in counts for term in own)
    rarity = {term: math.log((1 + len(counts)) / (1 + n)) + 1 for term, n in held.items()}
    vectors = []
    for own in counts:
        weights = {t: (1 + math.log(n)) * rarity[t] for t, n in sorted(own.items())}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        vectors.append({t: w / norm for t, w in weights.items()})
    return rarity, vectors


def anchors_of(vector: dict[str, float], needs: tuple[tuple[str, ...], ...], rarity: dict[str, float]) -> set[str]:
    """Terms of which a passage holds one if it can be like the template.

    Either a group of needed terms, or what is left over when ``FREQUENT`` words, and then
    the terms that most templates share, are laid aside as long as a passage of them alone
    would stay under ``LIKE``.
    """
    aside, left = 0.0, set()
    for term in sorted(vector, key=lambda t: (t not in FREQUENT, rarity[t], t)):
        aside += vector[term] ** 2
        if aside >= (LIKE - 1e-3) ** 2:
            left.add(term)
    choices = [left, *map(set, needs)]
    return min(choices, key=lambda c: (sum(t in FREQUENT or len(t) == 1 for t in c), len(c)))


def anchor_pattern(templates: list[Template]) -> str:
    """Matches every lower-case passage that can be like a template."""
    rarity, vectors = template_weights(templates)
    anchors = {t for (_, _, needs), vector in zip(templates, vectors, strict=True) for t in anchors_of(vector, needs, rarity)}
    # Grouped by first letter, so that most words are left at once.
    letters = {initial: [t[1:] for t in sorted(anchors) if t[0] == initial] for initial in sorted({t[0] for t in anchors if t.isalpha()})}
    words = "|".join(f"{initial}(?:{'|'.join(rest)})" for initial, rest in letters.items())
    numbers = "|".join(re.escape(t) for t in sorted(anchors) if not t.isalpha())
    patterns = ([f"(?<![a-z])(?:{words})(?![a-z])"] if words else []) + ([f"(?<![0-9])(?:{numbers})"] if numbers else [])
    return "|".join(patterns) or "(?!)"


def needed_bits(needs: tuple[tuple[str, ...], ...]) -> dict[str, int]:
    """The bits of the groups that each term belongs to."""
    bits: dict[str, int] = {}
    for i, group in enumerate(needs):
        for term in group:
            bits[term] = bits.get(term, 0) | 1 << i
    return bits


def passages(files: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, key, passage): lower-case passages of files (row, path, text) that hold an anchor."""
    anchor = anchor_pattern(templates)
    texts = files.select("row", "path", F.lower("text").alias("text")).where(F.col("text").rlike(anchor))
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    blocks = texts.select(
        "row",
        F.posexplode(F.concat(whole, F.split("text", EMPTY_LINES))).alias("place", "block"),
        F.size(whole).alias("whole"),
    ).where(F.col("block").rlike(anchor))
    sentences = F.split(F.regexp_replace("block", SENTENCE_END, f"$1{CUT}$2"), CUT)
    parts = F.array_distinct(F.concat(F.array("block"), F.split("block", "\n"), sentences))
    own = F.when(F.col("place") < F.col("whole"), F.array("block")).otherwise(parts)
    found = blocks.select("row", F.explode(own).alias("passage")).where(F.col("passage").rlike(anchor))
    return found.select("row", F.sha2("passage", 256).alias("key"), "passage")


def match_passages(found: DataFrame, templates: list[Template]) -> DataFrame:
    """(key, best): the best template of each different passage that is like one, as (cosine, -number).

    Broadcast are the terms of the templates, a parameter of the call.
    """
    spark = found.sparkSession
    rarity, vectors = template_weights(templates)
    unknown = math.log(1 + len(templates)) + 1
    rows, wanted = [], []
    for number, ((_, _, needs), vector) in enumerate(zip(templates, vectors, strict=True)):
        bits = needed_bits(needs)
        rows += [(number, t, vector.get(t, 0.0), bits.get(t, 0)) for t in sorted({*vector, *bits})]
        wanted.append((number, (1 << len(needs)) - 1))
    known = {t: rarity.get(t, unknown) for _, t, _, _ in rows}
    weights = spark.createDataFrame(sorted(known.items()), "term string, rarity double")
    parts = spark.createDataFrame(rows, "number int, term string, part double, bits int")
    whole = spark.createDataFrame(wanted, "number int, wanted int")
    counted = (
        found.dropDuplicates(["key"])
        .select("key", F.explode(F.regexp_extract_all("passage", F.lit(TERM), F.lit(0))).alias("term"))
        .where(~F.col("term").isin(STOP_WORDS))
        .groupBy("key", "term")
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(weights), "term", "left")
        .withColumn("weight", (1 + F.log("n")) * F.coalesce("rarity", F.lit(unknown)))
    )
    square = F.col("weight") * F.col("weight")
    # Kept are terms of templates only, so the list of a passage is as short as their vocabulary.
    listed = counted.groupBy("key").agg(
        F.sum(square).alias("square"),
        F.sum(F.when(F.col("rarity").isNotNull(), square)).alias("shared"),
        F.collect_list(F.when(F.col("rarity").isNotNull(), F.struct("term", "weight"))).alias("terms"),
    )
    # No template is nearer than the passage's own terms that templates have.
    near = listed.where(F.col("shared") >= F.col("square") * (LIKE - 1e-3) ** 2)
    cosine = F.round(F.sum(F.col("weight") * F.col("part")) / F.sqrt(F.first("square")), 6)
    return (
        near.select("key", "square", F.explode("terms").alias("own"))
        .select("key", "square", "own.term", "own.weight")
        .join(F.broadcast(parts), "term")
        .groupBy("key", "number")
        .agg(cosine.alias("cosine"), F.bit_or("bits").alias("met"))
        .join(F.broadcast(whole), "number")
        .where((F.col("cosine") >= LIKE) & (F.col("met") == F.col("wanted")))
        .groupBy("key")
        .agg(F.max(F.struct("cosine", (-F.col("number")).alias("back"))).alias("best"))
    )


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, so that texts are scanned once for it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scan_licenses(files: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """path, license, origin, cosine, from_directory, with doc_id, for files (doc_id, path, text).

    ``origin`` is header, inherited or none; ``cosine`` that of the passage that decided.
    """
    templates = TEMPLATES if templates is None else templates
    names = F.array(*(F.lit(name) for name, _, _ in templates)) if templates else F.array().cast("array<string>")
    named = files.select("doc_id", "path", "text", F.xxhash64("path", "text").alias("row"))
    found = _stored(passages(named, templates), "passages")
    matched = small(_stored(match_passages(found, templates), "matched"))
    own = found.select("row", "key").join(matched, "key").groupBy("row").agg(F.max("best").alias("own"))
    placed = named.select("doc_id", "path", "row", _directory(F.col("path")).alias("directory"))
    known = _stored(placed.join(own, "row", "left").drop("row"), "files")

    speaking = (
        known.where(F.col("own").isNotNull() & F.col("path").rlike(LICENSE_FILE))
        .groupBy("directory")
        .agg(F.max("own").alias("spoken"))
        .withColumnRenamed("directory", "above")
    )
    steps = F.split("directory", "/")
    ancestors = (
        known.select("directory")
        .where(F.col("directory").isNotNull())
        .distinct()
        .select("directory", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth"))
        .withColumn("above", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
        .distinct()
    )
    nearest = (
        ancestors.join(speaking, "above")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "above", "spoken")).alias("nearest"))
    )
    decided = known.join(small(nearest, 200_000), "directory", "left")
    inherited = F.col("own").isNull() & F.col("nearest").isNotNull()
    choice = F.coalesce("own", "nearest.spoken")
    return decided.select(
        "doc_id",
        "path",
        F.when(choice.isNotNull(), F.get(names, -choice["back"])).alias("license"),
        F.when(F.col("own").isNotNull(), "header").when(inherited, "inherited").otherwise("none").alias("origin"),
        choice["cosine"].alias("cosine"),
        F.when(inherited, F.col("nearest.above")).alias("from_directory"),
    )


def files_of(documents: DataFrame) -> DataFrame:
    """Documents as files: a directory per source and thousand, and hundred, of ids.

    A document that opens or closes with a line on licences is a licence file of its
    place; every other keeps its id as a name.  Among the hundreds, those of a thousand
    that are divisible by 500 lie directly in the thousand's directory.
    """
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    hundred = F.floor(F.col("doc_id") / 100)
    first, last = F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1)
    name = F.when(
        F.col("text").rlike(SIGNAL) & (first.rlike(SIGNAL) | last.rlike(SIGNAL)), F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))
    ).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    inner = F.when(hundred % 5 != 0, hundred.cast("string"))
    return documents.select("doc_id", F.concat_ws("/", "source", thousand, inner, name).alias("path"), "text")
