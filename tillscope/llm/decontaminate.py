"""Benchmark decontamination by canonical templates.

Words of documents and benchmark items are made canonical: numbers, names and units
after a number become typed placeholders, all else is lower case without punctuation;
white space of any kind and length is one blank.  Nothing tells a name from another
capital at the start of a sentence, so there are three forms: no word is a name, those
with a capital within a sentence are, and all with a capital are.  Windows of
``WINDOW`` canonical words of each form are hashed and joined, so a question that was
given other numbers or names still meets its item, and one in other case too as long
as its names are the same.  Where windows met, the values that stand in the placeholders (slots) are
looked up and checked: along one alignment of item and document, equal values of the
item must have equal values in the document (different ones may have equal values too,
as new numbers coincide).  Windows that hold an item value with several values in the
document are left out, but a window whose values are the item's own always counts.  A
template with fewer than ``LITERALS`` words that are no placeholders says too little:
such a window is looked for with the item's own values only, by a form of its own
that has no placeholders.  A document leaks an item when its consistent windows are
at least ``SHARE`` of the item's windows.

Only built-in functions are used.  Windows that met are written to the shared
folder before the slots are looked up.  Documents are never shuffled by their
windows as long as the benchmark has at most a million of them (counted first);
beyond that both sides are joined on the hash.  The same holds for the documents
whose slots are looked up.

Null texts have no words; a null or empty item is never found.  A very long text costs
time in proportion to its words.  Of equal windows of an item each counts.  An item shorter
than a window is looked for as one window of its own length.  Repeated rows and
ids count as one document per id and text; an empty table on either side gives no
rows; other columns are ignored or, by ``drop_leaks``, kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.columns import bound
from tillscope.llm.labelled import small
from tillscope.session import scratch_path

WINDOW = 8
SHARE = 0.5
# Words of a window that must not be placeholders for other values to be looked for.
LITERALS = 4
# Units that are placeholders after a number.
UNITS = (
    "mm cm m km g kg mg t l ml s sec min h d % inch inches ft feet yard yards mile miles lb lbs oz "
    "meter meters metre metres gram grams liter liters litre litres second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars euro euros cent cents usd eur degree degrees"
).split()

# Marks in front of a name, of a unit and of any other capital; no letter, digit or punctuation.
NAME, UNIT, CAPITAL = "\x04", "\x05", "\x06"
BODY = r"[\p{L}\p{N}]+(?:[.,'’-][\p{L}\p{N}]+)*"
WORD = f"[{NAME}{UNIT}{CAPITAL}]?{BODY}"
# What becomes one blank; marks that a text holds itself are blanks too.
SPACE = r"\s\x85\p{Z}\x04-\x06"
SPACES = rf"[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]"
# A capital after a blank that ends no sentence.  Here and below what comes first is what fails soonest.
WITHIN = r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;)] )"
LETTER = r"[\p{L}\p{N}]"
# Where a word may begin and end.
OPENS = rf"(?<!{LETTER}|{NAME}|{CAPITAL}|{LETTER}[.,'’-])"
CLOSES = rf"(?!{LETTER}|[.,'’-]{LETTER})"
# A capital at the start of any other word.
OTHER = rf"(?=\p{{Lu}}\p{{Ll}}){OPENS}"
NUMBER = rf"(?=[0-9]){OPENS}[0-9]{LETTER}*(?:[.,'’-]{LETTER}+)*"
MEASURED = rf"(?=0){OPENS}0([^\p{{L}}\p{{N}}{NAME}]{{1,3}})(?:{'|'.join(UNITS)}){CLOSES}"


def marked_text(text: Column) -> Column:
    """Lower case and single blanks, with a mark before every name and every other capital."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")
    return F.lower(F.regexp_replace(F.regexp_replace(text, WITHIN, NAME), OTHER, CAPITAL))


def canonical_text(marked: Column) -> Column:
    """The same words, marks kept, with placeholders for numbers and units after a number."""
    numbers = F.regexp_replace(marked, NUMBER, "0")
    units = F.regexp_replace(numbers, MEASURED, f"0$1{UNIT}u")
    return F.when(marked.rlike("[0-9]"), units).otherwise(marked)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


# Forms of a word: nothing is a name (0), those within a sentence are (1), or all capitals (2); VALUES has no
# placeholders at all.
FORMS, VALUES = (0, 1, 2), 3
# All marks sort before this.
LAST_MARK = "\x07"


def _hashes(canon: Column, plain: Column, forms: list[int]) -> Column:
    """Struct of arrays: the hashes of the words in each form, as ``f0``, ``f1``, ..."""
    name = F.xxhash64(F.lit(f"{NAME}x"))

    def bare(word: Column) -> Column:
        capital = word.startswith(NAME) | word.startswith(CAPITAL)
        return F.when((word < LAST_MARK) & capital, F.substring(word, 2, 1 << 30)).otherwise(word)

    def with_names(form: int, canon: Column, plainly: Column) -> Column:
        def chosen(word: Column, own: Column) -> Column:
            named = word.startswith(NAME) if form == 1 else word.startswith(NAME) | word.startswith(CAPITAL)
            return F.when((word < LAST_MARK) & named, name).otherwise(own)

        return F.zip_with(canon, plainly, chosen)

    def every(canon: Column, plainly: Column) -> Column:
        arrays = [plainly if form == 0 else with_names(form, canon, plainly) for form in forms if form != VALUES]
        if VALUES in forms:
            # Hashed apart from templates: there, 0 stands for any number.
            arrays.append(F.transform(plain, lambda w: F.xxhash64(w, F.lit(VALUES))))
        return F.struct(*(a.alias(f"f{form}") for a, form in zip(arrays, forms, strict=True)))

    return bound(canon, lambda c: bound(F.transform(c, lambda w: F.xxhash64(bare(w))), lambda h: every(c, h)))


def _windows(rows: DataFrame, columns: list[str], forms: list[int], widths: list[int]) -> DataFrame:
    """``columns``, form, place, width and hash of every window of the word hashes in ``hashes``.

    The words that follow each place are put beside it by zipping shifted arrays, so
    that windows are hashed in generated code instead of a lambda per window and word.
    Texts shorter than a width have no window of it.
    """
    widest = max(widths)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), F.col(f"hashes.f{k}").alias("words")) for k in forms)))
    words = rows.select(*columns, each.alias("own")).select(*columns, "own.form", "own.words")
    shifted = [F.slice("words", j + 1, F.size("words")).alias(f"c{j}") for j in range(widest)]
    cells = words.select(*columns, "form", F.posexplode(F.arrays_zip(*shifted)).alias("place", "cell"))
    hashes = [
        F.when(
            F.col(f"cell.c{width - 1}").isNotNull(),
            F.struct(F.lit(width).alias("width"), F.xxhash64(*(F.col(f"cell.c{j}") for j in range(width))).alias("hash")),
        )
        for width in widths
    ]
    window = hashes[0] if len(widths) == 1 else F.explode(F.array(*hashes))
    found = cells.select(*columns, "form", "place", window.alias("window"))
    return found.where("window IS NOT NULL").select(*columns, "form", "place", "window.*")


def _offsets(canon: Column, form: Column) -> Column:
    """Where placeholders stand in a window of canonical words, from its start."""
    every = F.transform(
        canon,
        lambda w, i: F.when(
            w.isin("0", f"{UNIT}u")
            | (w.startswith(NAME) & (form > 0))
            | (w.startswith(CAPITAL) & (form > 1)),
            i,
        ),
    )
    return F.filter(every, lambda i: i.isNotNull())


def _slots(plain: Column, place: Column, offsets: Column) -> Column:
    """Values in the placeholders of the window at ``place``."""
    return F.transform(offsets, lambda i: F.get(plain, place + i))


def _bare_words(marked: Column) -> Column:
    return words_of(F.translate(marked, NAME + CAPITAL, ""))


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, share): items that documents hold, one row per pair."""
    spark = documents.sparkSession
    marked = benchmark.select("item_id", marked_text(F.col("text")).alias("marked"))
    items = marked.select(
        "item_id", _bare_words(F.col("marked")).alias("plain"), words_of(canonical_text(F.col("marked"))).alias("canon")
    ).withColumn("width", F.least(F.size("canon"), F.lit(window)))
    widths = sorted(row[0] for row in items.where("width > 0").select("width").distinct().collect()) or [window]
    every = [*FORMS, VALUES]
    hashes = _hashes(F.col("canon"), F.col("plain"), every)
    placed = _windows(items.withColumn("hashes", hashes), ["item_id", "plain", "canon"], every, widths)
    # A short item is one window, a longer one has windows of the full width only.
    placed = placed.where(F.col("width") == F.least(F.size("canon"), F.lit(window)))
    canon = F.slice("canon", F.col("place") + 1, F.col("width"))

    def few(form: Column) -> Column:
        slots = F.size(_offsets(canon, form))
        return (slots > 0) & (F.col("width") - slots < LITERALS)

    # A window that says too little in some form is looked for with its values instead.
    own = F.when(F.col("form") == VALUES, few(F.lit(max(FORMS))) | few(F.lit(1)) | few(F.lit(0))).otherwise(~few(F.col("form")))
    offsets = F.when(F.col("form") == VALUES, F.array().cast("array<int>")).otherwise(_offsets(canon, F.col("form")))
    wanted = (
        placed.where(own)
        .withColumn("offsets", offsets)
        .withColumn("item_slots", _slots(F.col("plain"), F.col("place"), F.col("offsets")))
        # A window without names is the same in several forms.
        .groupBy("item_id", "width", "hash", F.col("place").alias("item_place"), "offsets", "item_slots")
        .agg(F.min("form").alias("form"))
    )
    forms = sorted({0} | {row[0] for row in wanted.select("form").distinct().collect()})
    wanted = wanted.drop("form")
    sizes = wanted.groupBy("item_id").agg(F.countDistinct("item_place").alias("in_item"))

    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    hashed = texts.select("doc_id", "text_hash", marked_text(F.col("text")).alias("marked")).select(
        "doc_id",
        "text_hash",
        _hashes(words_of(canonical_text(F.col("marked"))), _bare_words(F.col("marked")), forms).alias("hashes"),
    )
    found = _windows(hashed, ["doc_id", "text_hash"], forms, widths).drop("form")
    path = scratch_path(spark, "windows")
    found.join(small(wanted), ["width", "hash"]).drop("hash").write.parquet(path)
    # A window that is the same in several forms was met as often.
    met = spark.read.parquet(path).distinct()
    return _consistent(met, texts).groupBy("doc_id", "text_hash", "item_id").agg(
        F.countDistinct("item_place").alias("n_windows")
    ).join(small(sizes), "item_id").withColumn("share", F.col("n_windows") / F.col("in_item")).where(
        F.col("share") >= share
    ).select("doc_id", "text_hash", "item_id", "n_windows", "share")


def _consistent(met: DataFrame, texts: DataFrame) -> DataFrame:
    """The windows whose slots are the item's, or whose item values have one value each along their alignment."""
    document = ["doc_id", "text_hash"]
    along = [*document, "item_id", "shift"]
    met = met.withColumn("shift", F.col("place") - F.col("item_place"))
    without = met.where(F.size("item_slots") == 0)
    held = met.where(F.size("item_slots") > 0)
    keys = small(held.select(*document).distinct())
    same = [texts[c].eqNullSafe(keys[c]) for c in document]
    words = texts.join(keys, same, "left_semi").select(*document, _bare_words(marked_text(F.col("text"))).alias("plain"))
    same = [held[c].eqNullSafe(words[c]) for c in document]
    filled = (
        held.join(words, same)
        .select(*(held[c] for c in held.columns), "plain")
        .withColumn("slots", _slots(F.col("plain"), F.col("place"), F.col("offsets")))
        .drop("plain", "offsets")
    )
    same_values = F.col("slots") == F.col("item_slots")
    verbatim, other = filled.where(same_values), filled.where(~same_values)
    broken = (
        filled.select(*along, F.explode(F.arrays_zip("item_slots", "slots")).alias("pair"))
        .groupBy(*along, F.col("pair.item_slots").alias("value"))
        .agg(F.min("pair.slots").alias("least"), F.max("pair.slots").alias("most"))
        .where(F.col("least") != F.col("most"))
        .groupBy(*along)
        .agg(F.collect_set("value").alias("values"))
    )
    same = [other[c].eqNullSafe(broken[c]) for c in along]
    kept = other.join(broken, [*same, F.arrays_overlap(other["item_slots"], broken["values"])], "left_anti")
    columns = [*document, "item_id", "item_place"]
    return without.select(*columns).unionByName(verbatim.select(*columns)).unionByName(kept.select(*columns))


def leaked_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows found and their share, one row per document and item."""
    return (
        find_leaks(documents, benchmark)
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_windows").alias("n_windows"), F.max("share").alias("share"))
    )


def drop_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, all columns as they are."""
    leaks = find_leaks(documents, benchmark).select("doc_id", "text_hash").distinct()
    # Not a column of its own: the table may have one of any name.
    same = documents["doc_id"].eqNullSafe(leaks["doc_id"]) & (F.xxhash64(documents["text"]) == leaks["text_hash"])
    return documents.join(leaks, same, "left_anti")
