"""Secret scans: fixed patterns, and character Markov models for strings that look random.

Three base patterns give spans: values assigned to telling names, access keys, and
long runs of hexadecimal digits.  The method adds long tokens that a first-order
Markov model of random strings explains better than one of ordinary identifiers: the
mean log-likelihood ratio of their character steps exceeds ``RATIO``.  Base spans are
cut out of such a token and each long piece that is left is judged.  Both models
are counted from labelled samples, and a step's probability falls back on the
frequency of its second character.

Only built-in functions are used.  Positions count code points, ends are exclusive.
Between the matches of a pattern lie the pieces that ``split`` gives, so running
lengths of pieces and matches are the positions.

A null text is an empty one and has no spans.  Tokens and texts of any length are
judged whole, in time that grows with their length.  Of spans with equal starts the
kind listed first comes first.  Rows are judged one by one, so
repeated ids and texts keep a row each; an empty table gives no rows; other columns
are ignored, or kept as they are by ``redact_secrets``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.columns import gathered
from tillscope.llm.labelled import drawn_by_hash, free_name

# The base patterns and the least length of what counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# Runs of 24 and more; shorter runs would be dropped.
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_CANDIDATE = 20
RATIO = 0.3
# Documents whose words are samples of ordinary identifiers, and generated random strings of each form.
SAMPLE_DOCUMENTS = 2000
RANDOM_STRINGS = 2000
BACK_OFF = 20.0
# Shapes of ordinary long tokens, of which documents may hold few: rules, numbers, dates and paths.
RULE_LENGTHS, NUMBERS, PATHS = 100, 300, 500
PATH_WORDS = (
    "usr local share lib bin etc var log home user opt tmp src main test tests java python site-packages path to some "
    "resource resources index data docs images static assets public config scripts build include common utils core "
    "api v1 v2 com org net www html en node_modules dist-packages models views project module version release"
).split()
PLACEHOLDER = "<secret>"

SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None, group: int = 0) -> Column:
    """Spans of a pattern's matches; ``keep`` is an expression on the array element ``x`` of ``group``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.arrays_zip(
        F.transform(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), F.length).alias("gap"),
        F.transform(found, F.length).alias("long"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("value"),
    )
    empty = F.array().cast(f"array<{SPAN}>")
    least = keep if keep is not None else F.lit(0)

    def step(at, one):
        start = at + one["gap"]
        end = start + one["long"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return end, F.when(one["value"] >= least, F.array(span)).otherwise(empty)

    return F.when(text.rlike(pattern), gathered(lengths, F.lit(0), step, f"array<{SPAN}>")).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns, by start and kind."""
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, F.lit(LEAST_ASSIGN), group=2),
            _spans(text, ACCESS, 1, F.lit(LEAST_ACCESS)),
            _spans(text, HEX, 2),
        )
    )


def labelled_samples(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(token, random): ordinary tokens of a bounded hash sample of documents, and random strings.

    Ordinary tokens have the alphabet of the candidates; shapes that few documents hold
    (rules, numbers, dates, paths) are added.

    Random strings are digests of running numbers in three forms; values that the
    base patterns find in the sampled documents are random too.  About
    ``sample_documents`` documents are drawn, whatever the size of the table.
    """
    spark = documents.sparkSession
    rows = documents.count()
    share = min(1.0, sample_documents / max(1, rows))
    drawn = documents.where(drawn_by_hash(share, "doc_id", "text")).select(
        F.coalesce("text", F.lit("")).alias("text")
    )
    ordinary = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")

    def labelled(tokens, random):
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(random).alias("random")))

    # Both labels from one reading of the texts.
    found = F.concat(
        labelled(F.regexp_extract_all(ordinary, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0)), False),
        labelled(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), True),
        labelled(F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), True),
    )
    held = drawn.select(F.inline(found))
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = spark.range(RANDOM_STRINGS).select(
        F.explode(
            F.array(digest, F.base64(F.unhex(digest)), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)))
        ).alias("token"),
        F.lit(True).alias("random"),
    )
    return held.unionByName(ordinary_shapes(spark)).unionByName(random)


def ordinary_shapes(spark: SparkSession) -> DataFrame:
    """(token, random): fixed rows of rules, numbers, dates and paths."""
    rules = spark.range(RULE_LENGTHS).select(
        F.explode(F.array(*(F.repeat(F.lit(c), F.col("id").cast("int") + 4) for c in "=/-_+"))).alias("token")
    )
    digest = F.sha2(F.concat(F.lit("number"), F.col("id").cast("string")), 256)
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 41).cast("int"))
    long = F.concat(F.conv(F.substring(digest, 1, 15), 16, 10), F.conv(F.substring(digest, 16, 15), 16, 10))
    numbers = spark.range(NUMBERS).select(
        F.explode(F.array(long, F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy/MM/dd"))).alias("token")
    )
    names = F.array(*map(F.lit, PATH_WORDS))

    def name(k):
        return F.get(names, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PATH_WORDS))).cast("int"))

    paths = spark.range(PATHS).select(
        F.concat(F.when(F.col("id") % 2 == 0, "/").otherwise(""), F.concat_ws("/", *(name(k) for k in range(5)))).alias("token")
    )
    return rules.unionByName(numbers).unionByName(paths).withColumn("random", F.lit(False))


def fit_ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each step between characters of ``ALPHABET`` (row by row).

    A step counts once per different token, so that no long or frequent token prevails.
    What is collected has at most one row per pair of characters and label.
    """
    steps = samples.select(
        "random", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"), "token"
    ).where(F.length("token") > 1)
    counted = (
        steps.select(
            "random", "token", F.expr("substr(token, i, 1)").alias("a"), F.expr("substr(token, i + 1, 1)").alias("b")
        )
        .distinct()
        .groupBy("random", "a", "b")
        .agg(F.count("*").alias("n"))
        .where(F.lit(ALPHABET).contains(F.col("a")) & F.lit(ALPHABET).contains(F.col("b")))
        .collect()
    )
    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    chance = {}
    for label in (False, True):
        pair = {(place[r["a"]], place[r["b"]]): r["n"] for r in counted if r["random"] == label}
        first, second = [0] * size, [0] * size
        for (a, b), n in pair.items():
            first[a] += n
            second[b] += n
        total = sum(second)
        alone = [(n + 1) / (total + size) for n in second]
        chance[label] = [
            (pair.get((a, b), 0) + BACK_OFF * alone[b]) / (first[a] + BACK_OFF) for a in range(size) for b in range(size)
        ]
    return [math.log(r / o) for r, o in zip(chance[True], chance[False], strict=True)]


def _ratio(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio of the steps of a token made of ``ALPHABET``, character by character."""

    def step(state, character):
        number = F.instr(F.lit(ALPHABET), character)
        ratio = F.element_at(ratios, (state["last"] - 1) * len(ALPHABET) + number)
        return F.struct(
            number.alias("last"), F.when(state["last"] > 0, state["sum"] + ratio).otherwise(state["sum"]).alias("sum")
        )

    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(token, ""), start, step, lambda state: state["sum"]) / (F.length(token) - 1)


PIECES = "array<struct<start:int,end:int,token:string>>"


def _pieces(base: Column, candidates: Column) -> Column:
    """What the base spans leave of each candidate (start, kind, end, token): (start, end, token) of long pieces.

    One walk over all spans by their starts; a candidate is closed by the next one.
    """
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit("").alias("token")))

    def piece(state, end):
        own = state["own"]
        start = F.greatest(state["at"], own["start"])
        end = F.least(end, own["end"])
        found = F.struct(
            start.alias("start"), end.alias("end"), F.substr(own["token"], start - own["start"] + 1, end - start).alias("token")
        )
        return F.when(end - start >= LEAST_CANDIDATE, F.array(found)).otherwise(F.array().cast(PIECES))

    def step(state, span):
        candidate = span["kind"] == 3
        end = F.when(candidate, state["own"]["end"]).otherwise(span["start"])
        after = F.struct(
            F.when(candidate, state["at"]).otherwise(F.greatest(state["at"], span["end"])).alias("at"),
            F.when(candidate, span).otherwise(state["own"]).alias("own"),
        )
        return after, piece(state, end)

    none = F.struct(F.lit(0).alias("start"), F.lit(3).alias("kind"), F.lit(0).alias("end"), F.lit("").alias("token"))
    start = F.struct(F.lit(0).alias("at"), none.alias("own"))
    ordered = F.array_sort(F.concat(spans, candidates))
    return gathered(ordered, start, step, PIECES, lambda state: piece(state, state["own"]["end"]))


def with_spans(documents: DataFrame, ratios: list[float], name: str = "_spans", base: str = "_base") -> DataFrame:
    """Add the base spans and all spans (arrays of start, kind, end), by start and kind."""
    long = free_name(documents, "_long")
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    candidates = F.zip_with(
        _spans(text, CANDIDATE, 3),
        tokens,
        lambda s, t: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), t.alias("token")),
    )
    found = documents.withColumn(base, base_spans(text)).withColumn(long, candidates)
    random = F.filter(_pieces(F.col(base), F.col(long)), lambda p: _ratio(p["token"], table) > RATIO)
    more = F.transform(random, lambda p: F.struct(p["start"].alias("start"), F.lit(3).alias("kind"), p["end"].alias("end")))
    none = F.array().cast(f"array<{SPAN}>")
    every = F.array_sort(F.concat(F.col(base), F.when(F.size(long) > 0, more).otherwise(none)))
    return found.withColumn(name, every).drop(long)


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def _number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def fit_secrets(documents: DataFrame) -> list[float]:
    return fit_ratios(labelled_samples(documents))


def find_secrets(documents: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """doc_id, counts per kind, digest of the base spans and all spans, for every row."""
    narrow = documents.select("doc_id", "text")
    found = with_spans(narrow, ratios if ratios is not None else fit_secrets(narrow))
    return found.select(
        "doc_id",
        *(_number(F.col("_base"), i).alias(f"n_{KINDS[i]}") for i in range(3)),
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.col("_spans")).alias("spans"),
        _number(F.col("_spans"), 3).alias("n_markov"),
    )


def redact_secrets(documents: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """All rows and columns, with every span of the text replaced by a placeholder.

    Overlapping spans become one placeholder.  Texts without a span stay as they are;
    ``n_chars``, where the table has it, follows the text.
    """
    spans, base = free_name(documents, "_spans"), free_name(documents, "_base")
    ratios = ratios if ratios is not None else fit_secrets(documents.select("doc_id", "text"))
    found = with_spans(documents, ratios, spans, base)
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state, span):
        # A span that begins inside the last one only moves its end.
        gap = F.substr(text, state["at"] + 1, span["start"] - state["at"])
        parts = F.when(
            (span["start"] < state["at"]), state["parts"]
        ).otherwise(F.concat(state["parts"], F.array(gap, F.lit(PLACEHOLDER))))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

    def finish(state):
        rest = F.substr(text, state["at"] + 1, F.length(text))
        return F.array_join(F.concat(state["parts"], F.array(rest)), "")

    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, add, finish)).otherwise(F.col("text"))
    result = found.withColumn("text", clean)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed = F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        result = result.withColumn("n_chars", changed)
    return result.select(*documents.columns)
