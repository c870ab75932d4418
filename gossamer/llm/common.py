"""What the operators of this folder share: table access, staging and Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and all tasks run in this process (tests on one machine) a temporary
    folder takes its place; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "gossamer-shared")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cuts lineage: writes `df` as Parquet to the shared folder and reads it back.

    A lost executor then costs only the tasks that it was running.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    _STAGED.folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Staged(threading.local):
    """Folders that a thread has staged and not deleted; queries in other threads have their own."""

    def __init__(self):
        self.folders: list[str] = []


_STAGED = _Staged()


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """stage(make()); what was staged on the way is deleted, since nothing needs it any more."""
    before = len(_STAGED.folders)
    out = stage(make())
    spark, gone = out.sparkSession, _STAGED.folders[before:-1]
    del _STAGED.folders[before:]
    for folder in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores behind it as make it no column of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, schema: str, rows: Callable[[list], Iterator[dict]]) -> DataFrame:
    """mapInArrow where `rows` gets the columns of a batch as Python lists and yields column dicts."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema if isinstance(schema, StructType) else df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            for out in rows([c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


#: Entries that a worker keeps of each memo before it starts afresh (about 200 bytes each).
MEMO_ENTRIES = 300_000


_MEMOS: list[weakref.ref] = []
_OWNER = [""]


def claim(operator: str) -> None:
    """Empties all memos of this worker when another operator's tasks begin in it."""
    if _OWNER[0] != operator:
        _OWNER[0] = operator
        for memo in [m for ref in _MEMOS if (m := ref()) is not None]:
            memo.clear()


#: Bytes or letters of the longest key that a memo keeps.
MEMO_KEY = 256


class Memo(dict):
    """A dict that fills itself and starts afresh when full; long keys are not kept."""

    most = MEMO_ENTRIES

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make
        _MEMOS.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.make(key)
        if self.keep(value) and not (isinstance(key, (bytes, str)) and len(key) > MEMO_KEY):
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value

    def keep(self, value) -> bool:
        return True


def crc_fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def normal_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


#: Maps A-Z to a-z and every ASCII byte outside 0-9, a-z to a blank.
_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
