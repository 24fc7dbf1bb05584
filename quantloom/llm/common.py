"""What the operators of this package share: tables in the shared folder, checked broadcasts, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 64 << 20

U64 = np.uint64
FACTORS = _M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); in local mode a temporary one if unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-quantloom-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if its counted size is below BROADCAST_BYTES; otherwise as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def reserved(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def text_key(text: str) -> Column:
    """What tells a text from others without its id: two hashes and the length; null texts are one."""
    t = F.col(text).cast("string")
    return F.concat_ws(".", F.xxhash64(t), F.crc32(t.cast("binary")), F.octet_length(t))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the maximal runs of bytes other than 20 and 09-0D (bytes.lower and bytes.split do just that)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, computed once; emptied when it grows past its bound."""

    BOUND = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), U64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(33))) * _M1
    x = (x ^ (x >> U64(33))) * _M2
    return x ^ (x >> U64(33))


def shingle_hashes(h: np.ndarray, k: int = 5) -> np.ndarray:
    """One hash for each run of k word hashes; with fewer words, one hash for the whole sequence."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        acc = np.full(1, n, U64)
        for x in h:
            acc = mix(acc + x)
        return acc
    acc = np.full(n - k + 1, k, U64)
    for i in range(k):
        acc = mix(acc + h[i : n - k + 1 + i])
    return acc
