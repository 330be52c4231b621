"""Source readers.

CSV files are read with every column as text, the missing-value tokens a
pandas-style reader recognises are turned into NULL (also in text
columns), and each column is then converted with ``try_cast`` to its
declared type, so a malformed number becomes NULL instead of failing the
job. Schemas are explicit: nothing is inferred.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import NA_TOKENS
from ..session import cut_lineage

_L, _D, _I, _S = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType()


def _schema(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Source file schemas: only the columns the pipeline reads.
SOURCE_SCHEMAS: dict[str, T.StructType] = {
    "hc_main": _schema([("SK_ID_CURR", _L), ("TARGET", _I), ("AMT_INCOME_TOTAL", _D), ("AMT_CREDIT", _D),
                        ("AMT_ANNUITY", _D), ("AMT_GOODS_PRICE", _D), ("CNT_FAM_MEMBERS", _D),
                        ("EXT_SOURCE_1", _D), ("EXT_SOURCE_2", _D), ("EXT_SOURCE_3", _D),
                        ("DAYS_BIRTH", _I), ("DAYS_EMPLOYED", _I), ("FLAG_OWN_CAR", _S), ("FLAG_OWN_REALTY", _S),
                        ("CNT_CHILDREN", _I), ("REGION_RATING_CLIENT", _I), ("REG_CITY_NOT_LIVE_CITY", _I),
                        ("FLAG_MOBIL", _I), ("NAME_CONTRACT_TYPE", _S), ("AMT_REQ_CREDIT_BUREAU_YEAR", _D)]),
    "hc_bureau": _schema([("SK_ID_BUREAU", _L), ("SK_ID_CURR", _L), ("CREDIT_DAY_OVERDUE", _I),
                          ("AMT_CREDIT_SUM_OVERDUE", _D), ("AMT_CREDIT_SUM_DEBT", _D), ("AMT_CREDIT_SUM", _D),
                          ("CREDIT_ACTIVE", _S)]),
    "hc_bureau_bal": _schema([("SK_ID_BUREAU", _L), ("STATUS", _S)]),
    "hc_installments": _schema([("SK_ID_CURR", _L), ("DAYS_ENTRY_PAYMENT", _D), ("DAYS_INSTALMENT", _D),
                                ("AMT_PAYMENT", _D), ("AMT_INSTALMENT", _D)]),
    "hc_pos": _schema([("SK_ID_CURR", _L), ("SK_DPD", _I), ("CNT_INSTALMENT", _D), ("CNT_INSTALMENT_FUTURE", _D)]),
    "hc_cc": _schema([("SK_ID_CURR", _L), ("AMT_BALANCE", _D), ("AMT_CREDIT_LIMIT_ACTUAL", _D),
                      ("AMT_PAYMENT_CURRENT", _D), ("AMT_INST_MIN_REGULARITY", _D), ("AMT_DRAWINGS_CURRENT", _D),
                      ("AMT_DRAWINGS_ATM_CURRENT", _D), ("SK_DPD", _I)]),
    "hc_prev": _schema([("SK_ID_PREV", _L), ("SK_ID_CURR", _L), ("NAME_CONTRACT_STATUS", _S)]),
    "gmsc": _schema([("_c0", _L), ("SeriousDlqin2yrs", _I), ("RevolvingUtilizationOfUnsecuredLines", _D),
                     ("age", _I), ("NumberOfTime30-59DaysPastDueNotWorse", _I), ("DebtRatio", _D),
                     ("MonthlyIncome", _D), ("NumberOfOpenCreditLinesAndLoans", _I), ("NumberOfTimes90DaysLate", _I),
                     ("NumberRealEstateLoansOrLines", _I), ("NumberOfTime60-89DaysPastDueNotWorse", _I),
                     ("NumberOfDependents", _D)]),
    "lc": _schema([("id", _L), ("loan_amnt", _D), ("term", _S), ("installment", _D), ("emp_length", _S),
                   ("home_ownership", _S), ("annual_inc", _D), ("loan_status", _S), ("purpose", _S), ("dti", _D),
                   ("delinq_2yrs", _D), ("open_acc", _D), ("revol_util", _S), ("total_acc", _D), ("revol_bal", _D),
                   ("tot_cur_bal", _D), ("num_accts_ever_120_pd", _D), ("pct_tl_nvr_dlq", _D), ("pub_rec", _D),
                   ("mort_acc", _D)]),
    "pkdd_loan": _schema([("loan_id", _L), ("account_id", _L), ("amount", _D), ("duration", _I),
                          ("payments", _D), ("status", _S)]),
    "pkdd_trans": _schema([("trans_id", _L), ("account_id", _L), ("type", _S), ("amount", _D), ("balance", _D)]),
    "pkdd_account": _schema([("account_id", _L)]),
}
# Wide patterns of a source: every column present with the prefix is read too.
SOURCE_PREFIXES: dict[str, dict[str, T.DataType]] = {
    "hc_main": {"FLAG_DOCUMENT_": _I, "AMT_REQ_CREDIT_BUREAU_": _D},
}
SOURCE_SEPARATOR = {"pkdd_loan": ";", "pkdd_trans": ";", "pkdd_account": ";"}


def null_tokens(c: Column) -> Column:
    """Text equal to a missing-value token becomes NULL."""
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                   header: bool = True, tolerant: bool = True,
                   prefixes: dict[str, T.DataType] | None = None) -> DataFrame:
    """CSV -> typed DataFrame. Columns of ``schema`` missing from the
    file are NULL when ``tolerant`` (S4), otherwise an error. Other columns are
    read if they start with one of ``prefixes``."""
    raw = (spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
           .option("inferSchema", False).csv(path))
    present = set(raw.columns)
    cols = []
    named = set(schema.fieldNames())
    wide = [T.StructField(c, t, True) for c in raw.columns if c not in named
            for p, t in (prefixes or {}).items() if c.startswith(p)]
    for f in schema.fields + wide:
        if f.name in present:
            txt = null_tokens(F.col(f"`{f.name}`"))
            cols.append((txt if isinstance(f.dataType, T.StringType) else _try_cast(txt, f.dataType)).alias(f.name))
        elif tolerant:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"column {f.name} missing from {path}")
    return raw.select(*cols)


def _try_cast(c: Column, t: T.DataType) -> Column:
    """Text -> type, NULL when unparseable. Integer columns are read
    exactly; text that only parses as a double ("3.0", from float-producing
    tools) counts if it is whole. Values out of range are NULL."""
    if isinstance(t, (T.IntegerType, T.LongType)):
        d = c.try_cast(T.DoubleType())
        whole = F.when(d == F.floor(d), d).try_cast(T.LongType())
        return F.coalesce(c.try_cast(T.LongType()), whole).try_cast(t)
    return c.try_cast(t)


def read_source(spark: SparkSession, key: str, path: str, tolerant: bool = True) -> DataFrame:
    """Read one of the twelve credit source files by its key (S1-S4). Loans of
    the peer-lending source get ids if the file has none (P3, D7)."""
    df = read_csv_typed(spark, path, SOURCE_SCHEMAS[key], sep=SOURCE_SEPARATOR.get(key, ","), tolerant=tolerant,
                        prefixes=SOURCE_PREFIXES.get(key))
    return with_ids(df) if key == "lc" else df


#: Column of the lines that can't be read.
_CORRUPT = "_corrupt_line"


def with_ids(df: DataFrame, col: str = "id") -> DataFrame:
    """Ids for a source file that has none. They are given once, at
    ingest, and written with the rows, so every later read sees the same."""
    if col in df.columns and not df.filter(F.col(col).isNotNull()).isEmpty():
        return df
    return cut_lineage(df.withColumn(col, F.monotonically_increasing_id()), f"with-{col}")


def index_column(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A file whose first, unnamed column is the row id arrives as _c0."""
    return df.withColumnRenamed("_c0", name) if "_c0" in df.columns else df


def normalise_header(name: str) -> str:
    """Strip, lower-case, spaces to underscores."""
    return name.strip().lower().replace(" ", "_")


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_header(c) for c in df.columns])


def read_request_batch(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """An uploaded applicant batch: all columns as text (coerced later,
    per field, with defaults), headers normalised, unreadable files fail.
    ``max_rows`` (off by default) rejects larger batches instead of
    truncating them."""
    df = (spark.read.option("header", True).option("mode", "FAILFAST").option("inferSchema", False).csv(path))
    df = normalise_headers(df)
    df = df.select(*[null_tokens(F.col(f"`{c}`")).alias(c) if c != "request_id" else F.col(c) for c in df.columns])
    if max_rows is not None:
        n = df.count()
        if n > max_rows:
            raise ValueError(f"batch has {n} rows, more than the allowed {max_rows}")
    return df


def read_lines_with_rejects(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """A delimited file with a header as (rows, rejects): all columns of the
    well-formed lines as text, and the lines with too few or too many fields or
    a quote that doesn't close, as (file, line). The lines are parsed once and
    written, so both sides are counted from the same read."""
    names = spark.read.option("header", True).option("sep", sep).option("escape", "\"").csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
    raw = (spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("escape", "\"")
           .option("columnNameOfCorruptRecord", _CORRUPT).csv(path).withColumn("_file", F.col("_metadata.file_path")))
    raw = cut_lineage(raw, "parsed-lines")
    bad = F.col(_CORRUPT).isNotNull()
    return raw.filter(~bad).select(*[F.col(f"`{n}`") for n in names]), raw.filter(bad).select(F.col("_file").alias("file"), F.col(_CORRUPT).alias("line"))


def read_request_batch_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S6 with a channel for what can't be read: the batch as ``read_request_batch``
    gives it, and its rejected lines, where the former fails on the first."""
    rows, rejects = read_lines_with_rejects(spark, path)
    rows = normalise_headers(rows)
    return rows.select(*[null_tokens(F.col(f"`{c}`")).alias(c) if c != "request_id" else F.col(c) for c in rows.columns]), rejects


def audit(spark: SparkSession, tables: dict[str, str], expected: dict[str, T.StructType] | None = None) -> DataFrame:
    """Per table: rows, columns, expected columns that are missing, bytes,
    and whether it is there at all (an absent one has NULL counts). Row counts
    are one aggregate per table (for parquet, answered from the footers)."""
    parts = []
    for name, path in tables.items():
        exp = expected.get(name) if expected else None
        try:
            df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            parts.append(spark.createDataFrame(
                [(name, None, None, sorted(exp.fieldNames()) if exp else [], None, False)],
                "table_name string, n_rows long, n_columns long, missing_columns array<string>, n_bytes long, present boolean"))
            continue
        missing = sorted(set(exp.fieldNames()) - set(df.columns)) if exp else []
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit(name).alias("table_name"), "n_rows",
                             F.lit(len(df.columns)).cast("long").alias("n_columns"),
                             F.array(*[F.lit(m) for m in missing]).cast("array<string>").alias("missing_columns"),
                             F.lit(file_bytes(spark, path)).cast("long").alias("n_bytes"), F.lit(True).alias("present")))
    return reduce(DataFrame.unionByName, parts)


def file_bytes(spark: SparkSession, path: str) -> int:
    """Total bytes of the files behind ``path`` (file listing only)."""
    df = spark.read.format("binaryFile").load(path).select("length")
    return int(df.agg(F.sum("length")).first()[0] or 0)
