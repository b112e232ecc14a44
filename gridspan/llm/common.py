"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The bytes of [\x20\x09-\x0D], which separate words everywhere in this package.
SPACES = b" \t\n\x0b\x0c\r"

_U = np.uint64


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that gives its rows where there is one."""

    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(df: DataFrame) -> DataFrame:
    """``df`` itself, once the package is known to the session's Python workers.

    Functions that run in workers are sent by reference; Spark carries the package there, as
    ``--py-files`` would, once per session. The archive lies in the driver's temporary folder
    until the driver ends.
    """
    context = df.sparkSession.sparkContext
    if getattr(context, "_gridspan_shipped", False):
        return df
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    folder = os.path.realpath(tempfile.mkdtemp(prefix="gridspan-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "gridspan.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), root))
    context.addPyFile(archive)
    context._gridspan_shipped = True
    return df


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_row(df: DataFrame, **named: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside the named ones: no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in named.items()])


def unpack_row(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns], *more)


def row_type(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])


def id_order(name: str = "doc_id") -> list[Column]:
    """Ascending ids with null last."""
    return [F.col(name).isNull(), F.col(name)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Exclusive running sum."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts: flat arrays over one joined buffer.

    ``start`` and ``end`` are byte places in ``data``, ``doc`` the text a word belongs to, and
    ``first`` / ``count`` the words of each text. ``code`` is a 64-bit hash of the bytes: eight of them at a
    time, each step a bijection of the state that is not linear; BLAKE2 for words of over ``_LONG`` bytes.
    """

    _LONG = 512

    def __init__(self, texts: list[bytes], codes: bool = True):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        self.start, self.end = edge[0::2], edge[1::2]
        text_start = starts_of(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.text_start = text_start
        self.doc = np.searchsorted(text_start, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = starts_of(self.count)
        if codes:
            self.code = self._codes()

    def _codes(self) -> np.ndarray:
        size = self.end - self.start
        # the eight bytes from every place on, without a copy for each
        eights = np.ndarray((len(self.data),), "<u8", self.data + bytes(8), 0, (1,))
        code = mix64(size.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
        live, done = np.flatnonzero(size <= self._LONG), 0
        while len(live):
            left = size[live] - done
            piece = eights[self.start[live] + done]
            short = left < 8
            piece[short] &= (_U(1) << (left[short].astype(np.uint64) * _U(8))) - _U(1)
            code[live] = mix64(code[live] ^ piece)
            live, done = live[left > 8], done + 8
        for i in np.flatnonzero(size > self._LONG):
            word = self.data[self.start[i] : self.end[i]]
            code[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return code

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first word of every run of ``n`` words within one text, and the runs' hashes."""
        total = len(self.code)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        value = np.zeros(total - n + 1, np.uint64)
        step = _U(0xD6E8FEB86659FD93)
        with np.errstate(over="ignore"):
            for j in range(n):
                value = value * step + self.code[j : total - n + 1 + j]
        return at, mix64(value[at])


def texts_of(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow text column; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def portions(batch, column: int, limit: int = 1 << 20):
    """An Arrow batch in slices of about ``limit`` bytes of the text or binary ``column``; a longer cell is one alone.

    What a task holds beside the batch then follows from ``limit``, not from the number of rows in a batch.
    """
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size + 1
    if first < batch.num_rows:
        yield batch.slice(first)
