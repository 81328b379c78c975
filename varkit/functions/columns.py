"""Variable typing, roles, NaN folding and the wide-to-long reshape.

Every multi-variable operator in the package works on the *long* form
``(variable, value)`` produced by :func:`to_long` (a Spark ``unpivot``, planned as
an ``Expand``), so a single aggregate or window job covers all variables at once
instead of one job per column.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numerical_categorical_division(df: DataFrame, cols: Iterable[str] | None = None
                                   ) -> tuple[list[str], list[str]]:
    """Split columns into numeric and categorical names, keeping column order.

    Numeric means a Spark numeric type (byte .. long, float, double, decimal);
    everything else (string, boolean, date, timestamp, ...) is categorical.
    Only the schema is read; no job runs.
    """
    wanted = None if cols is None else set(cols)
    numerical, categorical = [], []
    for field in df.schema.fields:
        if wanted is not None and field.name not in wanted:
            continue
        (numerical if is_numeric_type(field.dataType) else categorical).append(field.name)
    return numerical, categorical


def roles_from_header(header) -> dict[str, str]:
    """Normalise a role declaration to ``{column: 'N' | 'C' | 'L'}``.

    ``header`` may be a dict, a one-row pandas DataFrame or a one-row Spark
    DataFrame whose cells hold the role marks.  Marks other than N, C and L are
    ignored.
    """
    if isinstance(header, Mapping):
        items = list(header.items())
    elif isinstance(header, DataFrame):
        row = header.limit(1).collect()[0]
        items = list(row.asDict().items())
    else:  # pandas
        items = [(c, header.iloc[0][c]) for c in header.columns]
    return {str(k): str(v) for k, v in items if str(v) in ("N", "C", "L")}


def split_roles(roles: Mapping[str, str]) -> tuple[list[str], list[str], str]:
    """Numeric columns, categorical columns and the label (first 'L' wins)."""
    by_mark: dict[str, list[str]] = {"N": [], "C": [], "L": []}
    for column, mark in roles.items():
        by_mark.setdefault(mark, []).append(column)
    if not by_mark["L"]:
        raise ValueError("roles declare no label column ('L')")
    return by_mark["N"], by_mark["C"], by_mark["L"][0]


def qcol(name: str) -> Column:
    """Column reference that works for any column name (dots, spaces, dashes)."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(c: Column) -> Column:
    """NULL for NaN, the value otherwise.  Spark aggregates treat NaN as a value
    (NaN is larger than every number), pandas treats it as missing."""
    return F.nanvl(c, F.lit(None).cast("double"))


def fold_nan(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in the float/double columns among ``cols`` (default: all)."""
    names = set(df.columns if cols is None else cols)
    exprs = []
    for field in df.schema.fields:
        c = qcol(field.name)
        if field.name in names and isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(field.dataType)).alias(field.name)
        exprs.append(c)
    return df.select(*exprs)


def numeric_value(df: DataFrame, name: str) -> Column:
    """A numeric column as double with NaN folded to NULL."""
    return nan_to_null(qcol(name).cast("double"))


def category_value(df: DataFrame, name: str) -> Column:
    """A categorical column as its string form (NaN of a float column folds to NULL)."""
    dt = df.schema[name].dataType
    c = qcol(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = nan_to_null(c)
    return c.cast("string")


def to_long(df: DataFrame, cols: list[str], *, kind: str = "numeric",
            id_cols: Iterable[str] = (), extra: Mapping[str, Column] | None = None,
            variable: str = "variable", value: str = "value") -> DataFrame:
    """Unpivot ``cols`` to rows ``(*id_cols, *extra, variable, value)``.

    ``kind='numeric'`` casts values to double and folds NaN to NULL;
    ``kind='categorical'`` casts values to string.  ``extra`` adds per-row
    columns (for example a label) that are repeated for every variable.
    Only the listed columns are selected first, so the parquet scan reads
    nothing else.
    """
    if not cols:
        raise ValueError("no columns to unpivot")
    conv = numeric_value if kind == "numeric" else category_value
    ids = [qcol(c) for c in id_cols]
    extras = [e.alias(n) for n, e in (extra or {}).items()]
    # Internal positional names avoid clashes with user column names.
    slots = [f"_v{i}" for i in range(len(cols))]
    wide = df.select(*ids, *extras, *[conv(df, c).alias(s) for c, s in zip(cols, slots)])
    keep = list(id_cols) + list((extra or {}).keys())
    long = wide.unpivot(keep, slots, "_slot", value)
    mapping = F.create_map(*[x for s, c in zip(slots, cols) for x in (F.lit(s), F.lit(c))])
    return long.select(*[qcol(c) for c in keep], mapping[F.col("_slot")].alias(variable), F.col(value))


def to_coded(df: DataFrame, cols: list[str], *, code: str = "code", value: str = "value") -> DataFrame:
    """Numeric columns as rows ``(code, value)``, the code being the column's place in ``cols``: the long form for
    work whose groups go by number, NULL values included."""
    return df.select(F.posexplode(F.array(*[numeric_value(df, c) for c in cols])).alias(code, value))


def variable_order(cols: list[str]) -> Column:
    """Literal map variable -> position, used to keep output rows in column order."""
    return F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])


# Percentile column names.  Fixed rule: 'p' followed by the shortest decimal
# form of 100 * pct, with '.' written as '_' (0.01 -> p1, 0.5 -> p50, 0.005 -> p0_5).
def pct_name(pct: float) -> str:
    d = (Decimal(repr(float(pct))) * 100).normalize()
    text = format(d, "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "p" + text.replace(".", "_")


def sigma_names(dev) -> tuple[str, str]:
    k = int(dev)
    return f"mean-{k}sigma", f"mean+{k}sigma"
