"""Raw sales exports as CSV: the text scan, the cleaned scan and the writer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.names import ROW_ORDER
from tillscope.operators.cleaning import clean
from tillscope.session import storing

_MALFORMED = "_malformed"
_OVERFLOW = "_overflow"
# Rows of a compressed file: some 200 MB of text.
FILE_ROWS = 1_000_000


def read_sales_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    *,
    multiline: bool = False,
    ragged: str = "raise",
    keep_order: bool = True,
) -> DataFrame:
    """Read exports with every cell as text; only the empty cell is null.

    ``columns`` prunes the scan to the named raw columns.  ``ragged`` says what a
    row with more cells than the header does: ``"raise"`` fails the query (empty
    surplus cells carry nothing and pass), ``"truncate"`` drops them (and lets the
    parser skip unread columns).  Short rows are filled with nulls.  Several files must share one
    header.  Quoted line breaks need ``multiline=True``, which stops Spark from
    splitting a file over tasks.  Headers with blank or repeated names are compared
    by one more pass over the lines, if there are several files.

    ``keep_order`` adds ``source_file`` (the path) and ``source_row``, which sort the
    rows as they stand in their files, the files in the order of their paths.
    """
    if ragged not in ("raise", "truncate"):
        raise ValueError(f"ragged must be 'raise' or 'truncate', not {ragged!r}")
    paths = [path] if isinstance(path, str) else list(path)
    options = {"inferSchema": False, "quote": '"', "escape": '"', "multiLine": multiline}
    first = spark.read.options(**options).csv(paths).first()
    if first is None:
        raise ValueError(f"no header in {paths}")
    header = _distinct_names(list(first))
    wanted = list(columns) if columns is not None else header
    missing = [name for name in wanted if name not in header]
    if missing:
        raise ValueError(f"columns not in the file: {missing}")

    # With plain names Spark itself checks the header of every file against them.
    # Repeated and blank ones it cannot tell apart, so those are read by position.
    plain = header == list(first) and len({name.lower() for name in header}) == len(header)
    if not plain:
        _require_one_header(spark, paths, list(first))
    cells = header if plain else [f"_c{i}" for i in range(len(header))]
    options |= {"header": True, "enforceSchema": not plain}
    schema = T.StructType([T.StructField(name, T.StringType()) for name in cells])
    if ragged == "raise":
        # A parser that skips unread columns does not count cells, so it must not skip.
        checked = T.StructType(schema.fields + [T.StructField(_MALFORMED, T.StringType())])
        reader = spark.read.schema(checked).options(**options, columnPruning=False)
        rows = reader.option("columnNameOfCorruptRecord", _MALFORMED).csv(paths)
    else:
        rows = spark.read.schema(schema).options(**options).csv(paths)
    chosen = [F.col(_quoted(cells[header.index(name)])).alias(name) for name in wanted]
    if keep_order:
        # The id grows along a file: its high bits are the split, its low bits the row.
        rows = rows.withColumn("source_file", F.col("_metadata.file_path")).withColumn(
            "source_row", F.monotonically_increasing_id()
        )
        chosen += [F.col(name) for name in ROW_ORDER]
    if ragged == "raise":
        rows = rows.where(_not_overlong(schema))
    return rows.select(*chosen)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _distinct_names(header: Sequence[str | None]) -> list[str]:
    """Blank headers named by position, repeated ones numbered: ``Tax``, ``Tax.1``, ``Tax.2``."""
    names, seen = [], Counter()
    for place, name in enumerate(header):
        name = name or f"Unnamed: {place}"
        names.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return names


def _require_one_header(spark: SparkSession, paths: Sequence[str], header: Sequence[str | None]) -> None:
    """ValueError unless the first line of every file has the same cells.

    Lines shrink to the first of each file in every task, so one row per file is shuffled.
    """
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place")
    )
    firsts = lines.groupBy("path").agg(F.min_by("value", "place").alias("line")).select("line").distinct()
    spare = ", ".join(f"c{i} STRING" for i in range(len(header) + 1))
    line = F.regexp_replace("line", "^\ufeff", "")
    cells = F.from_csv(line, spare, {"quote": '"', "escape": '"'})
    same = F.lit(True)
    for i, name in enumerate([*header, None]):
        same = same & cells[f"c{i}"].eqNullSafe(F.lit(name).cast("string"))
    other = firsts.where(~same).first()
    if other is not None:
        raise ValueError(f"files with different headers: {list(header)} and {other['line']!r}")


def _not_overlong(schema: T.StructType) -> Column:
    """True, or an error naming the line when it has more cells than the header.

    Spark keeps the text of every row whose cell count is off; only those few are
    parsed once more, with one column to spare.
    """
    line = F.col(_MALFORMED)
    spare = ", ".join(f"c{i} STRING" for i in range(len(schema.fields))) + f", {_OVERFLOW} STRING"
    surplus = F.from_csv(line, spare, {"quote": '"', "escape": '"'})[_OVERFLOW]
    # Naming a cell keeps the scan legal when a query needs none, as a count does.
    first = F.coalesce(F.col(_quoted(schema.fields[0].name)), F.lit(""))
    message = F.concat(F.lit("row "), first, F.lit(" has more cells than the header: "), line)
    return F.when(line.isNull() | surplus.isNull(), True).otherwise(F.raise_error(message).cast("boolean"))


def ingest_csv(spark: SparkSession, path: str | Sequence[str], **read_options) -> DataFrame:
    """Scan and clean: headers, private columns, timestamps, money and quantity, in that order."""
    return clean(read_sales_csv(spark, path, **read_options))


def write_sales_csv(df: DataFrame, path: str, *, mode: str = "errorifexists", compression: str = "none") -> None:
    """Write a directory of CSV files, each with a header; nulls become empty cells.

    A compressed file is read by one task, so files end after ``FILE_ROWS`` rows then.
    """
    options = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "compression": compression}
    if compression != "none":
        options["maxRecordsPerFile"] = FILE_ROWS
    with storing(df.sparkSession):
        df.write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="", **options).csv(path)
