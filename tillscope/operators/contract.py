"""The data contract of cleaned line items.

The rules are data.  All of them are checked in one pass over the rows and every
failing cell is reported, so a bad export is rejected with the full list of
reasons instead of the first one.  Columns the contract does not name are free.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.session import storing

FAILURE = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("failure_case", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Field:
    """One required column: its type family and its lower bound, if any."""

    name: str
    kind: str
    above: int | None = None
    at_least: int | None = None


# The required columns and their limits.  Discounts are not checked.
CONTRACT = (
    Field("transaction_id", "string"),
    Field("transaction_ts", "timestamp"),
    Field("date", "date"),
    Field("category", "string"),
    Field("item", "string"),
    Field("sku", "string"),
    Field("qty", "number", above=0),
    Field("gross_sales", "number", at_least=0),
    Field("net_sales", "number", at_least=0),
    Field("tax", "number", at_least=0),
)

_KINDS = {
    "string": (T.StringType,),
    "timestamp": (T.TimestampNTZType, T.TimestampType),
    "date": (T.DateType, T.TimestampNTZType, T.TimestampType),
    # Text is accepted where a number is required and coerced cell by cell.
    "number": (T.NumericType, T.StringType),
}


class ContractError(ValueError):
    """The data breaks the contract; ``summary`` holds the counts."""

    def __init__(self, summary):
        self.summary = summary
        super().__init__(
            f"validation failed: {summary['error_count']:,} issue(s) in {summary['row_count']:,} rows"
        )


def _failure(scope: str, column: str, check: str, case: Column) -> Column:
    return F.struct(
        F.lit(scope).alias("scope"),
        F.lit(column).alias("column"),
        F.lit(check).alias("check"),
        case.cast("string").alias("failure_case"),
    )


def _cell_rules(df: DataFrame, contract: Sequence[Field]) -> list[tuple[Column, Column]]:
    """When each rule is broken in a row, and the failure to report then."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rules = []
    for field in contract:
        if field.name not in types or not isinstance(types[field.name], _KINDS[field.kind]):
            continue
        cell = F.col(field.name)
        missing = cell.isNull()
        if field.kind == "number":
            value = cell
            if isinstance(types[field.name], T.StringType):
                value = cell.try_cast("double")
                check = _failure("column", field.name, "coerce_dtype('double')", cell)
                rules.append((cell.isNotNull() & value.isNull(), check))
            if not isinstance(types[field.name], (T.DecimalType, T.IntegralType)):
                # NaN is a missing number here, and it would pass any lower bound.
                missing = missing | F.isnan(value)
                value = F.when(~F.isnan(value), value)
            if field.above is not None:
                check = _failure("column", field.name, f"greater_than({field.above})", cell)
                rules.append((value <= field.above, check))
            if field.at_least is not None:
                check = _failure("column", field.name, f"greater_than_or_equal_to({field.at_least})", cell)
                rules.append((value < field.at_least, check))
        rules.append((missing, _failure("column", field.name, "not_nullable", F.lit(None))))
    return rules


def failure_mask(df: DataFrame, contract: Sequence[Field] = CONTRACT) -> Column:
    """One bit per cell rule, set where a row breaks it; 0 for a good row.

    What follows from it costs little per row: counts are ``bit_count``, and the
    texts of failures are made for rows whose mask is not 0 only.
    """
    rules = _cell_rules(df, contract)
    if len(rules) > 63:
        raise ValueError(f"{len(rules)} rules do not fit one mask")
    mask = F.lit(0).cast("bigint")
    for bit, (broken, _) in enumerate(rules):
        mask = mask + F.when(broken, F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
    return mask


def _cell_failures(df: DataFrame, contract: Sequence[Field], mask: Column) -> Column:
    """Per row, the array of its failing cells, from its mask."""
    found = [
        F.when(mask.bitwiseAND(F.lit(1 << bit)) != 0, failure) for bit, (_, failure) in enumerate(_cell_rules(df, contract))
    ]
    if not found:
        return F.array().cast(T.ArrayType(FAILURE))
    return F.array_compact(F.array(*found))


def _error_count(df: DataFrame, contract: Sequence[Field]) -> Column:
    """Failing cells over all rows."""
    return F.coalesce(F.sum(F.bit_count(failure_mask(df, contract))), F.lit(0))


def _mask_name(df: DataFrame) -> str:
    taken = {column.lower() for column in df.columns}
    return next(c for c in (f"_failed{i}" for i in range(len(taken) + 1)) if c not in taken)


def _masked(df: DataFrame, contract: Sequence[Field], name: str) -> DataFrame:
    """The rows with their mask as a column that is worked out once.

    A filter on a plain column would be moved below the parsing of the cells and repeat
    it for every rule; one on a generated column stays above.
    """
    return df.select("*", F.explode(F.array(failure_mask(df, contract))).alias(name))


def _schema_failures(df: DataFrame, contract: Sequence[Field]) -> list[tuple[str, str, str, str]]:
    """Missing columns and columns of the wrong type, from the schema alone."""
    types = {f.name: f.dataType for f in df.schema.fields}
    failures = []
    for field in contract:
        if field.name not in types:
            failures.append(("frame", field.name, "column_in_dataframe", field.name))
        elif not isinstance(types[field.name], _KINDS[field.kind]):
            failures.append(("column", field.name, f"dtype('{field.kind}')", types[field.name].simpleString()))
    return failures


def failures(df: DataFrame, row_id: Sequence[str] = (), contract: Sequence[Field] = CONTRACT) -> DataFrame:
    """One row per failing cell and per missing or mistyped column.

    ``row_id`` names columns that identify a row; they are null for failures of
    the frame itself.  A narrow pass: no shuffle.
    """
    mask = _mask_name(df)
    broken = _masked(df, contract, mask).where(F.col(mask) != 0)
    found = F.explode(_cell_failures(df, contract, F.col(mask))).alias("f")
    cells = broken.select(*row_id, found).select("f.*", *row_id)
    frame = _schema_failures(df, contract)
    if not frame:
        return cells
    table = df.sparkSession.createDataFrame(frame, FAILURE)
    return cells.unionByName(table, allowMissingColumns=True)


def summary(df: DataFrame, contract: Sequence[Field] = CONTRACT) -> DataFrame:
    """One row: is_valid, row_count, error_count."""
    of_frame = len(_schema_failures(df, contract))
    errors = _error_count(df, contract) + F.lit(of_frame)
    return df.agg(
        (errors == 0).alias("is_valid"),
        F.count("*").alias("row_count"),
        errors.cast("bigint").alias("error_count"),
    )


def require_valid(df: DataFrame, contract: Sequence[Field] = CONTRACT) -> DataFrame:
    """The same frame, or ContractError; the gate in front of the tables."""
    result = summary(df, contract).first().asDict()
    if not result["is_valid"]:
        raise ContractError(result)
    return df


def store_rows(df: DataFrame, path: str) -> DataFrame:
    with storing(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_valid(
    df: DataFrame,
    path: str,
    contract: Sequence[Field] = CONTRACT,
    *,
    store: Callable[[DataFrame, str], DataFrame] = store_rows,
) -> DataFrame:
    """Write the frame as Parquet and read it back, or ContractError.

    The contract is checked on the way, while the rows are written, so large
    text is parsed once and no second pass reads it for the check.  ``store`` is what
    writes and opens them.
    """
    if _schema_failures(df, contract):
        require_valid(df, contract)
    watch = Observation("contract")
    errors = _error_count(df, contract)
    watched = df.observe(watch, F.count(F.lit(1)).alias("row_count"), errors.cast("bigint").alias("error_count"))
    rows = store(watched, path)
    if watch.get["error_count"]:
        raise ContractError(watch.get)
    return rows


def _require_columns(df: DataFrame, contract: Sequence[Field]) -> None:
    broken = _schema_failures(df, contract)
    if broken:
        raise ValueError(f"columns missing or of the wrong type: {[f[1] for f in broken]}")


def mark_failures(df: DataFrame, contract: Sequence[Field] = CONTRACT) -> DataFrame:
    """The rows with the array of their failing cells in ``failures``, empty for good rows."""
    _require_columns(df, contract)
    mask = _mask_name(df)
    marked = df.withColumn(mask, failure_mask(df, contract))
    return marked.withColumn("failures", _cell_failures(df, contract, F.col(mask))).drop(mask)


def valid_rows(df: DataFrame, contract: Sequence[Field] = CONTRACT) -> DataFrame:
    """The rows that meet every cell rule."""
    _require_columns(df, contract)
    mask = _mask_name(df)
    return _masked(df, contract, mask).where(F.col(mask) == 0).drop(mask)


def split_valid(
    df: DataFrame, contract: Sequence[Field] = CONTRACT, *, staging: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every cell rule, and the others with their failures in ``failures``.

    For loads that set bad rows aside instead of rejecting the export.  A missing
    or mistyped column still rejects it.  The rows are written with their masks to
    ``staging`` if given, so that both halves read columns instead of parsing
    the text once each.
    """
    _require_columns(df, contract)
    mask = _mask_name(df)
    masked = _masked(df, contract, mask)
    if staging is not None:
        masked.write.mode("overwrite").parquet(staging)
        masked = df.sparkSession.read.parquet(staging)
    good = masked.where(F.col(mask) == 0).drop(mask)
    bad = masked.where(F.col(mask) != 0).withColumn("failures", _cell_failures(df, contract, F.col(mask)))
    return good, bad.drop(mask)


def private_columns_absent(df: DataFrame, private: Sequence[str]) -> bool:
    return not set(private) & set(df.columns)
