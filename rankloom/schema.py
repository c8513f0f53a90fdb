"""Declared schemas of the tables that the operators exchange."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _INT, _DOUBLE, _STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

CORPUS = _table(doc_id=_LONG, text=_STRING, embedding=T.ArrayType(T.FloatType()))
QUERIES = _table(query_id=_LONG, text=_STRING, embedding=T.ArrayType(T.FloatType()))
JUDGMENTS = _table(query_id=_LONG, doc_id=_LONG, pos=_INT, label=_DOUBLE, score=_DOUBLE)
CANDIDATES = _table(
    query_id=_LONG, doc_id=_LONG, bi_score=_DOUBLE, stage1_rank=_INT,
    cross_score=_DOUBLE, final_rank=_INT,
)
LABELED_LIST = _table(
    query_id=_LONG, docs=T.ArrayType(_STRING), labels=T.ArrayType(_DOUBLE)
)
LABELED_PAIR = _table(query=_STRING, passage=_STRING, label=_DOUBLE)
N_TUPLE = _table(anchor=_STRING, positive=_STRING, negatives=T.ArrayType(_STRING))
LETOR = _table(row_id=_LONG, qid=_STRING, label=_DOUBLE, features=T.ArrayType(_DOUBLE))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise if ``df`` lacks one of the columns."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df


def require_list(df: DataFrame, name: str) -> DataFrame:
    """Raise unless the column holds lists."""
    require_columns(df, name)
    if not isinstance(df.schema[name].dataType, T.ArrayType):
        raise ValueError(f"{name} must hold a list of values per row")
    return df
