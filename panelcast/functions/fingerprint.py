"""Content fingerprints and snapshot equality."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship, written

#: Bytes of a file that one task hashes, and bytes that it holds.
PART, READ = 256 << 20, 8 << 20


def _as_text(df: DataFrame, name: str, exact: bool) -> Column:
    """One spelling per value, null as a bare mark: floating numbers as whole millionths and times to the second,
    or, if ``exact``, as the shortest text that reads back alike and as microseconds."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")

    def millionths(x: Column) -> Column:
        return F.round(x.cast("double") * 1_000_000).cast("decimal(38,0)").cast("string")

    if exact and kind.startswith("timestamp"):
        text = F.unix_micros(c.cast("timestamp")).cast("string")
    elif exact and kind.startswith("array<"):
        text = F.to_json(F.transform(c, lambda x: x.cast("string")), {"ignoreNullFields": "false"})
    elif exact:
        text = c.cast("string")
    elif kind in ("double", "float"):
        text = millionths(c)
    elif kind in ("array<float>", "array<double>"):
        text = F.array_join(F.transform(c, millionths), ";")
    elif kind.startswith("timestamp"):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit("="), text), F.lit("-"))  # the length keeps values apart


def table_fingerprint(df: DataFrame, exact: bool = False) -> DataFrame:
    """Order-insensitive: row count and the exact sum of 60 bits of each row's MD5, which other engines
    compute alike unless ``exact``. Partial sums combine map side, so it scales like a count."""
    row = F.md5(F.concat_ws("|", *[_as_text(df, c, exact) for c in df.columns]).cast("binary"))
    h = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("hash_sum"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file below a path; contents are not read. Spark's scans skip empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def _opened(path: str):
    from urllib.parse import quote
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, inside = fs.FileSystem.from_uri(quote(path, safe=":/"))
    return store.open_input_file(inside)


def _openssl():
    """The library behind ``hashlib``, whose SHA-256 state can be kept between tasks; None where it hides it."""
    import _hashlib
    import ctypes
    try:
        lib = ctypes.CDLL(_hashlib.__file__)
        calls = lib.SHA256_Init, lib.SHA256_Update, lib.SHA256_Final
    except (OSError, AttributeError):
        return None
    calls[1].argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    calls[0].argtypes, calls[2].argtypes = [ctypes.c_void_p], [ctypes.c_char_p, ctypes.c_void_p]
    return calls


def hashed_on(path: str, length: int, done: int, state: bytes | None, part: int) -> tuple[int, bytes | None, str | None]:
    """(done, state, digest) after at most ``part`` more bytes of a file, or after all of them without a state to keep."""
    import ctypes
    import hashlib
    calls = _openssl()
    plain = hashlib.sha256() if calls is None else None
    context = ctypes.create_string_buffer(state or b"", 128)  # SHA256_CTX takes 112 bytes
    if calls and state is None:
        calls[0](context)
    until = length if calls is None else min(length, done + part)
    with _opened(path) as source:
        source.seek(done)
        while done < until:
            piece = source.read(min(READ, until - done))
            if not piece:
                raise OSError(f"{path} ends at {done} of {length} bytes")
            plain.update(piece) if plain else calls[1](context, piece, len(piece))
            done += len(piece)
    if done < length:
        return done, context.raw, None
    if plain:
        return done, None, plain.hexdigest()
    digest = ctypes.create_string_buffer(32)
    calls[2](digest, context)
    return done, None, digest.raw.hex()


def digests(files: DataFrame, part: int = PART) -> DataFrame:
    """``files`` (path, length, more) with the SHA-256 of each. The hash of a file runs from its first byte to its last,
    so it passes from task to task: a round of tasks reads at most ``part`` bytes of every file and writes the states."""
    ship(files.sparkSession)
    longest = files.agg(F.max("length")).first()[0] or 0
    states = files.withColumns({"done": F.lit(0).cast("long"), "state": F.lit(None).cast("binary"), "sha256": F.lit(None).cast("string")})
    schema = states.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, r in batch.iterrows():
                if r["sha256"] is None:
                    batch.at[i, "done"], batch.at[i, "state"], batch.at[i, "sha256"] = hashed_on(r["path"], int(r["length"]), int(r["done"]), r["state"], part)
            yield batch

    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(max(1, -(-longest // part))):
        states = written(states.repartitionByRange(spread, "path").mapInPandas(run, schema), "digests")
    return states.drop("done", "state")


def file_fingerprints(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """(file, length, sha256) of every file below a path, of any length."""
    return digests(listed(spark, path), part).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


def combined_fingerprint(files: DataFrame) -> DataFrame:
    """(files, bytes, digest): order-insensitive over (file, sha256); partial sums combine map side."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("=", "file", "sha256").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum(h).cast("string").alias("digest"))


def snapshot_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only in ``left`` / only in ``right`` (multiset, both directions); 0 and 0 means equal."""
    cols = left.columns
    r = right.select(*[F.col(f"`{c}`") for c in cols])
    return left.exceptAll(r).agg(F.count(F.lit(1)).alias("left_only")).withColumn(
        "right_only", r.exceptAll(left).select(F.count(F.lit(1))).scalar())
