"""Feature engineering: calendar, category codes, one-hot, imputation,
alignment to a feature list, zero counts and the deterministic split."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.functions import exprs as X
from aqlens.operators.ordering import rank
from aqlens.operators.selection import medians
from aqlens.session import broadcast_if_bounded

# Most values that are spread to a column each.
ONE_HOT_COLUMNS = 2_000
# Code of a value that a code dimension doesn't hold, where -1 isn't allowed.
UNKNOWN_CODE = (1 << 31) - 1


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """year, month, day_of_year, season (name) and season_encoded."""
    d = F.col(date)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day_of_year": F.dayofyear(d),
            "season": X.season_name(F.month(d)),
            "season_encoded": X.season_code(F.month(d)),
        }
    )


def code_dimension(df: DataFrame, col: str) -> DataFrame:
    """Alphabetical code (0-based) of each distinct non-null value: a
    distributed rank of the distinct values (see ``aqlens.operators.ordering``)."""
    values = df.select(F.col(col).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    return rank(values, "_v", "_code", "codes").withColumn("_code", F.col("_code").cast("int"))


def attach_codes(
    df: DataFrame, codes: DataFrame, col: str, out: str | None = None, derived: bool = True, missing: int = -1
) -> DataFrame:
    """Join a code dimension (``_v``, ``_code``) onto ``col``; values missing
    from it get ``missing``.  The dimension is broadcast only after its size
    check."""
    dim = broadcast_if_bounded(codes, derived=derived)
    out = out or f"{col}_encoded"
    return df.join(dim, F.col(col) == dim["_v"], "left").withColumn(out, F.coalesce("_code", F.lit(missing))).drop("_v", "_code")


def default_code(codes: DataFrame, value: str, missing: int = -1) -> int:
    """Code of one value in a code dimension (one tiny lookup), else ``missing``."""
    row = codes.filter(F.col("_v") == value).select("_code").first()
    return row["_code"] if row is not None else missing


def attach_scoring_codes(df: DataFrame, codes: DataFrame, col: str = "city") -> DataFrame:
    """Scoring-time codes from the training dimension; a city unseen in
    training takes the default city's code (or -1 if that is unseen too)."""
    return attach_codes(df, codes, col, missing=default_code(codes, K.DEFAULT_CITY))


def with_codes(df: DataFrame, cols: Sequence[str], suffix: str = "_encoded") -> DataFrame:
    """Category codes joined back; missing values get -1."""
    for c in cols:
        df = attach_codes(df, code_dimension(df, c), c, f"{c}{suffix}")
    return df


def distinct_values(df: DataFrame, col: str) -> list:
    """Sorted distinct values of a category column, each to become a column.
    More than ONE_HOT_COLUMNS are refused: no schema holds them, one vector
    (``one_hot_vector``) does."""
    found = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(ONE_HOT_COLUMNS + 1).collect()
    if len(found) > ONE_HOT_COLUMNS:
        raise ValueError(f"{col} has more than {ONE_HOT_COLUMNS} values: use one_hot_vector")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, col: str, prefix: str | None = None, values: Sequence | None = None) -> DataFrame:
    """Boolean column per value (sorted); null input -> all false."""
    prefix = prefix or col
    values = list(values) if values is not None else distinct_values(df, col)
    names = one_hot_names(prefix, values)
    return df.withColumns({n: F.coalesce(F.col(col) == F.lit(v), F.lit(False)) for n, v in zip(names, values)})


def one_hot_encoder(codes: DataFrame, col: str, out: str) -> OneHotEncoderModel:
    """Encoder of the codes in column ``col`` into a sparse vector ``out`` with
    one place per value of the code dimension; any other code gives zeros."""
    encoder = OneHotEncoder(inputCols=[col], outputCols=[out], handleInvalid="keep", dropLast=True)
    return encoder.fit(codes.agg(F.coalesce(F.max("_code"), F.lit(0)).cast("double").alias(col)))


def one_hot_vector(df: DataFrame, col: str, out: str, codes: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``: one sparse vector of a category, its places in the
    alphabetical order of the values; null and unknown values are all zeros.
    The values stay in a distributed code table, whatever their number."""
    codes = code_dimension(df, col) if codes is None else codes
    coded = attach_codes(df, codes, col, "_place", missing=UNKNOWN_CODE)
    return one_hot_encoder(codes, "_place", out).transform(coded).drop("_place")


def one_hot_names(prefix: str, values: Sequence) -> list[str]:
    """Column names of the values; a name that is taken gets a number."""
    taken: dict[str, int] = {}
    out = []
    for v in values:
        name = one_hot_name(prefix, v)
        taken[name.lower()] = n = taken.get(name.lower(), 0) + 1
        out.append(name if n == 1 else f"{name}__{n}")
    return out


def one_hot_name(prefix: str, value) -> str:
    """Column name of a one-hot value; characters other than letters, digits
    and '_' become '_' so names need no quoting (PM2.5 -> PM2_5)."""
    return f"{prefix}_" + re.sub(r"[^0-9A-Za-z_]", "_", str(value))


def median_impute(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Fill nulls with the column median (exact by default, by radix selection
    over all columns at once; else ``percentile_approx``).  All-null columns
    stay null."""
    if exact:
        med = medians(df, cols)
    else:
        row = df.agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in cols]).first()
        med = {c: row[c] for c in cols}
    return df.fillna({c: float(v) for c, v in med.items() if v is not None})


def mean_impute(df: DataFrame, cols: Sequence[str], all_null_defaults: Mapping[str, float] | None = None) -> DataFrame:
    """Fill nulls with the column mean; an all-null column takes its default."""
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    fills = {}
    for c in cols:
        v = row[c]
        if v is None and all_null_defaults is not None:
            v = all_null_defaults.get(c, K.TARGET_FALLBACK_DEFAULT)
        if v is not None:
            fills[c] = float(v)
    return df.fillna(fills)


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns in the training order; absent features as 0; nulls as 0."""
    cols = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in features]
    return df.select(*keep, *cols).fillna(0.0, subset=list(features))


def zero_count(features: Sequence[str]):
    """Number of features equal to 0 in the row."""
    return sum(F.when(F.col(c) == 0, 1).otherwise(0) for c in features)


def split_bucket(*keys: str):
    """0..99 bucket from the first 32 bits of md5(key): stable across runs
    and engines."""
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    return (F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def with_split(df: DataFrame, keys: Sequence[str], test_pct: int = int(K.TEST_FRACTION * 100)) -> DataFrame:
    """Deterministic train/test split: bucket < test_pct is test."""
    return df.withColumn("is_test", split_bucket(*keys) < test_pct)
