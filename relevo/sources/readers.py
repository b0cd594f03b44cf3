"""Readers: projected and limited scans, fallback sources, SQL files, schema
application and row coercion (S1-S5, S8-S10, S12)."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relevo.functions.fixed import DEFAULT_NORM_PARAMS, VAL_SPLIT
from relevo.session import path_exists

SQL_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "sql")


def read_posts(spark: SparkSession, path: str, cols=("author", "subreddit", "body")) -> DataFrame:
    """Projected scan (S1): only ``cols`` reach the parquet reader."""
    return spark.read.parquet(path).select(*cols)


def index_source(df: DataFrame) -> DataFrame:
    """Rows to index (S2): five columns, non-NULL body."""
    return df.where(F.col("body").isNotNull()).select("id", "title", "body", "expertise_score", "utility_score")


def training_source(df: DataFrame, max_labelled_rows: int | None = None) -> DataFrame:
    """Training scan (S3): body, both features and label of the labelled rows.

    ``max_labelled_rows`` bounds the sample a classifier is fitted on (the
    lowest ids); without it all labelled rows are read.
    """
    x = df.where(F.col("label").isNotNull()).select("id", "body", "expertise_score", "utility_score", "label")
    return (x if max_labelled_rows is None else x.orderBy("id").limit(max_labelled_rows)).drop("id")


def holdout(df: DataFrame, share: float = VAL_SPLIT, seed: int = 42) -> DataFrame:
    """Positive hold-out rows (S4): ``label = 1`` in the validation share of the ids, which training never sees."""
    from relevo.operators.training import split

    return split(df.where(F.col("label") == 1), share, seed).where("is_validation").drop("is_validation")


def read_with_fallback(spark: SparkSession, *sources) -> DataFrame:
    """First source that loads (S5). A source is a callable ``spark -> DataFrame``
    or a JSON path (a JSON array file or JSON lines) read with ``POSTS_SCHEMA``.
    Only a source that is not there (no such path or table) is passed over; any
    other failure is raised, so that a fault never changes the source."""
    errors = []
    for src in sources:
        try:
            return src(spark) if isinstance(src, Callable) else read_posts_json(spark, src)
        except FileNotFoundError as e:
            errors.append(f"{src}: {e}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
                raise
            errors.append(f"{src}: {e.getCondition()}")
    raise FileNotFoundError("no data source available: " + "; ".join(errors))


POSTS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("expertise_score", T.DoubleType()),
    T.StructField("utility_score", T.DoubleType()), T.StructField("label", T.IntegerType()),
])


def read_posts_json(spark: SparkSession, path: str, schema=POSTS_SCHEMA, json_array: bool | None = None) -> DataFrame:
    """Posts from JSON: a ``.json`` document holding an array (multiLine) or a
    folder of JSON lines (what ``write_posts_json`` produces)."""
    if json_array is None:
        json_array = path.endswith(".json")
    return spark.read.schema(schema).option("multiLine", json_array).json(path)


def run_sql_file(spark: SparkSession, path: str, params: dict) -> DataFrame:
    """Run a parameterised SQL file (S8): named parameters are bound, never
    spliced into the text; a table is passed as ``IDENTIFIER(:name)``."""
    if not os.path.isabs(path):
        path = os.path.join(SQL_DIR, path)
    with open(path) as f:
        text = f.read()
    return spark.sql(text, args=params)


# suffix -> Spark type for dynamic fields (S9); longest suffix wins
DYNAMIC_SUFFIXES = {
    "_i": "int", "_l": "bigint", "_f": "float", "_d": "double", "_b": "boolean", "_s": "string",
    "_dt": "timestamp", "_t": "string", "_txt": "array<string>", "_is": "array<int>", "_ls": "array<bigint>",
    "_fs": "array<float>", "_ds": "array<double>", "_bs": "array<boolean>", "_ss": "array<string>",
    "_dts": "array<timestamp>", "_str": "array<string>", "_ws": "string",
}
# a text field in one language: *_txt_en, *_txt_fr, ...
LANGUAGE_FIELD = re.compile(r"_txt_[a-z]{2,3}$")
DECLARED_FIELDS = {"id": ("string", None), "expertise_score": ("double", 0.0), "utility_score": ("double", 0.0),
                   "content_vector": ("array<float>", None)}


def _field_type(name: str):
    if name in DECLARED_FIELDS:
        return DECLARED_FIELDS[name]
    if name.startswith("attr_"):
        return ("array<string>", None)
    if LANGUAGE_FIELD.search(name):
        return ("string", None)
    best = max((s for s in DYNAMIC_SUFFIXES if name.endswith(s)), key=len, default=None)
    return (DYNAMIC_SUFFIXES[best], None) if best else (None, None)


def apply_dynamic_types(df: DataFrame) -> DataFrame:
    """Apply the declared + suffix-typed schema.

    Columns are cast to the type their name declares (scalars wrapped in a
    one-element array for multi-valued types), declared defaults fill NULLs,
    rows without the required ``id`` are dropped, unknown names are dropped.
    """
    cols = []
    for f in df.schema.fields:
        typ, default = _field_type(f.name)
        if typ is None:
            continue
        c = F.col(f.name)
        if typ.startswith("array<") and not isinstance(f.dataType, T.ArrayType):
            c = F.when(c.isNull(), F.lit(None)).otherwise(F.array(c))
        c = c.try_cast(typ) if hasattr(c, "try_cast") else c.cast(typ)
        if default is not None:
            c = F.coalesce(c, F.lit(default))
        cols.append(c.alias(f.name))
    return df.select(*cols).where(F.col("id").isNotNull())


def coerce_documents(df: DataFrame) -> DataFrame:
    """Row coercion with defaults (S10): text fields to string ("" when
    missing), features to double (0.0 when missing)."""
    return df.select(
        F.col("id").cast("string").alias("id"),
        F.coalesce(F.col("title").cast("string"), F.lit("")).alias("title"),
        F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body"),
        F.coalesce(F.col("expertise_score").try_cast("double"), F.lit(0.0)).alias("expertise_score"),
        F.coalesce(F.col("utility_score").try_cast("double"), F.lit(0.0)).alias("utility_score"),
    )


def read_norm_params(spark: SparkSession, path: str) -> DataFrame:
    """Normalisation parameters from JSON (S12), one object in a file or a folder
    that ``write_norm_params`` wrote; the defaults when nothing is there.

    What is there must be one complete set: malformed text raises, and so do
    a missing value and a second row.
    """
    from relevo.operators.features import PARAM_COLS, PARAM_SCHEMA, params_frame

    if not path or not path_exists(spark, path):
        return params_frame(spark, DEFAULT_NORM_PARAMS)
    rows = (spark.read.schema(PARAM_SCHEMA).option("multiLine", path.endswith(".json")).option("mode", "FAILFAST")
            .json(path).limit(2).collect())
    if len(rows) != 1 or any(rows[0][c] is None for c in PARAM_COLS):
        raise ValueError(f"{path} does not hold one complete set of normalisation parameters")
    return params_frame(spark, rows[0].asDict())
