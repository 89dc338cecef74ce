"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import gc
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.session import checkpoint_dir, materialize

__all__ = ["table", "materialize", "lay_out", "worker_cache", "WordHash", "mix64", "shingle_hashes", "set_hash",
           "slices", "keep_rows", "pack_ints", "unpack_ints", "pack_bytes", "unpack_bytes", "delta", "doc_words", "bucket_below", "only", "crc_of_id"]

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone: whatever else a caller's table carries can
    then not clash with columns that an operator adds."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def lay_out(df: DataFrame, key: str, buckets: int, name: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """``df`` written once to the folder that the session names, in hash buckets of ``key``:
    whatever groups it by the key afterwards reads it where it lies, without an exchange.
    Without such a folder it is materialised.  With ``rows``, the table ``name`` as it is so far,
    it is added to that table (a union of tables would be dealt out anew)."""
    shared = checkpoint_dir(df.sparkSession)
    if not shared:
        done = materialize(df)
        return done if rows is None else rows.unionByName(done)
    name = name or f"laid_out_{uuid.uuid4().hex}"
    write = df.repartition(buckets, key).write.mode("error" if rows is None else "append")
    write.option("path", f"{shared.rstrip('/')}/{name}").bucketBy(buckets, key).saveAsTable(name)
    # Spark deletes the shuffle files of a finished step when the driver's garbage is collected; a
    # driver with room to spare would keep those of all steps on the executors' disks
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.table(name)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process, so that tables
    built by one task (vocabularies, automata) serve the following ones."""
    return sys.__dict__.setdefault("_termspark_llm", {}).setdefault(name, {})


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered while the map is small."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def slices(batches, rows: int = 256):
    """The rows of Arrow batches in small parts, so that of a batch of long texts only
    a few are Python objects at a time; memory of a batch that is done goes back."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
        give_back()


def give_back() -> None:
    """Returns memory that the worker's allocators keep for later: a worker outlives its task,
    and what it holds is missing elsewhere on its machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def keep_rows(df: DataFrame, column: str, start) -> DataFrame:
    """The rows of ``df``, all columns whatever their names, whose value of ``column`` as
    bytes (or None) is to be kept: ``start()``, called in each task, returns a function
    from a list of values to a list of booleans.  Rows pass the workers as slices of
    Arrow batches, so whole texts are Python objects a few at a time."""
    names = df.columns
    at = names.index(column)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        keep = start()
        for b in slices(batches):
            yield b.filter(pa.array(keep(b.column(at).cast(pa.binary()).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def doc_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes.lower and
    bytes.split touch exactly these ASCII characters."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[bytes], seen: WordHash, n: int = 5) -> np.ndarray:
    """The distinct n-word shingles as sorted 64-bit hashes; a text of fewer
    words is one shingle, and no words give an empty set."""
    k = len(words)
    if not k:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, k)
    if k < n:  # another seed per length: never equal to an n-word shingle
        acc = np.array([k], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for x in h:
            acc = mix64(acc ^ x)
        return acc
    acc = np.zeros(k - n + 1, np.uint64)
    for i in range(n):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + h[i:k - n + 1 + i]
        acc ^= acc >> np.uint64(29)
    return np.unique(mix64(acc))


def set_hash(s: np.ndarray) -> bytes:
    """128-bit fingerprint of a sorted set of hashes."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def bucket_below(col, bound: int, total: int):
    """Deterministic sample predicate: keeps about ``bound`` of ``total`` rows
    by the hash of a column; everything when there are fewer."""
    if total <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(7), col), F.lit(1 << 40)) < int((1 << 40) * bound / total)


def pack_ints(a: np.ndarray) -> bytes:
    """An integer array, byte planes apart, compressed."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(b: bytes, kind) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b) if b else b""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_bytes(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_bytes(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def delta(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))
