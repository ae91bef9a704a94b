"""Shared helpers: scratch tables in the cluster's shared folder, text constants and table access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
WORD_SEPARATOR = r"[\x20\x09-\x0D]+"

#: Long words of a bit filter, at most: 64 bits each, 4 MB in all.
FILTER_WORDS = 1 << 18

_local_roots: dict[str, str] = {}
_scope = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir`` if the session names one.

    Only a single-machine session may fall back to a temporary folder; on a cluster the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        shared = _local_roots.setdefault(app, tempfile.mkdtemp(prefix="corpusforge-"))
    return f"{shared.rstrip('/')}/corpusforge-{spark.sparkContext.applicationId}"


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors. options: the
    writer's."""
    path = f"{scratch_root(df.sparkSession)}/{getattr(_scope, 'name', 'tables')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession, scope: str = "") -> None:
    """Remove every scratch table of this application, or of one scope; call it once their results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{scope}".rstrip("/"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope(name: str) -> Iterator[str]:
    """Tables saved by this thread meanwhile go to a scope of their own, which clear_scratch can remove by itself."""
    before = getattr(_scope, "name", "tables")
    _scope.name = f"{name}-{threading.get_ident()}"
    try:
        yield _scope.name
    finally:
        _scope.name = before


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """word, bits: at most FILTER_WORDS rows whatever the input, so they may be broadcast; see may_have."""
    marked = keys.select(_filter_word(key).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), _place(key)).alias("bit"))
    return marked.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _place(key: str) -> Column:
    return F.col(key).bitwiseAND(63).cast("int")


def _filter_word(key: str) -> Column:
    return F.shiftright(key, 6).bitwiseAND(FILTER_WORDS - 1)


def may_have(rows: DataFrame, key: str, filter_: DataFrame) -> DataFrame:
    """rows without most of those whose key (a hash: long) isn't among the filter's keys: it saves a shuffle of rows that a
    join would drop. A filter of very many keys drops none; the join decides in any case."""
    hit = F.expr("shiftrightunsigned(bits, place) & 1 = 1")
    marked = rows.withColumns({"word": _filter_word(key), "place": _place(key)})
    return marked.join(F.broadcast(filter_), "word").filter(hit).select(rows.columns)


_worker_state: dict[Any, Any] = {}


def worker_state(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks under a key. Spark uses workers again for other operators; what was kept
    under another key is given up first, so that a worker holds one operator's vocabulary, memo or model at a time."""
    if key not in _worker_state:
        _worker_state.clear()
        gc.collect()
        give_back()
        _worker_state[key] = make()
    return _worker_state[key]


def give_back() -> None:
    """Return memory that this Python worker has freed to the system, which other workers and the JVM may need."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def hash60(text: Column) -> Column:
    """The first 60 bits of a text's MD5 as a non-negative long; any SQL engine can compute the same."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as a long."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_SEPARATOR))).cast("long")
