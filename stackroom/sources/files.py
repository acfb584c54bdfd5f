"""Sources: file trees and what can be read from their bytes without other software."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions import paths as P

HEAD_LIMIT, SNAPSHOT_LIMIT, TEXT_BYTES, TEXT_CHARS = 8 << 20, 256 << 20, 64 << 10, 8000
MEMBERS, MEMBER_BYTES, TAIL_BYTES = 4096, 512, 64 << 10
PCM_BATCH = 4 << 20  # samples that a batch of PCM chunks gathers


def scan_tree(spark: SparkSession, root: str, *, max_depth: int = 16, excluded_prefixes: list[str] = (), max_bytes: int | None = None) -> DataFrame:
    """``(path, modificationTime, length, content)`` of the files below ``root``, any file system Spark reads.

    Excluded directories and transient files drop out before contents are read; ``max_bytes``
    leaves out larger files. Batches are partitions, so nothing is held at once.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z0-9]+:/*", "/")
    clean = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    inner = F.when(F.startswith(clean, base), clean.substr(F.length(base) + 1, F.length(clean))).otherwise(clean)
    keep = ~P.excluded_directory(inner) & ~P.transient(clean) & (F.size(F.split(inner, "/")) - 1 <= max_depth)
    for prefix in excluded_prefixes:
        keep = keep & ~P.under(clean, prefix)
    if max_bytes is not None:
        keep = keep & (F.col("length") <= max_bytes)
    return rows.where(keep).withColumn("path", clean)


def identities(scanned: DataFrame) -> DataFrame:
    """File identities: whole-second times, kind and opaque id."""
    path = F.col("path")
    return scanned.select(P.opaque_id(path).alias("file_id"), "path", F.col("length").alias("size"), F.floor(F.col("modificationTime").cast("double")).cast("double").alias("mtime"), P.kind(path).alias("kind"))


def listing(scanned: DataFrame, limit: int | None = None) -> tuple[DataFrame, Column | bool]:
    """Sorted identities, and whether a limit cut them (then no sweep may follow)."""
    rows = identities(scanned).orderBy("path")
    if limit is None:
        return rows, False
    return rows.limit(limit), rows.limit(limit + 1).count() > limit


def head(content: Column, limit: int) -> Column:
    return F.substring(content, 1, min(limit, HEAD_LIMIT))


def read_slice(content: Column, offset: Column | int, length: int, cap: int = HEAD_LIMIT) -> Column:
    off = offset if isinstance(offset, Column) else F.lit(offset)
    return content.substr(off + 1, F.lit(min(length, cap)))


def complete(files: DataFrame, cap: int = SNAPSHOT_LIMIT) -> DataFrame:
    """Whole contents or nothing: larger files drop out."""
    return files.where(F.col("length") <= cap)


def snapshot_states(files: DataFrame, cap: int = SNAPSHOT_LIMIT) -> DataFrame:
    """``(path, state)`` of whole-file reads: ``complete``, ``too-large``, ``changed`` (the bytes read are not as many as listed) or ``unread``."""
    read = F.octet_length("content")
    state = F.when(F.col("length") > cap, "too-large").when(read.isNull(), "unread").when(read != F.col("length"), "changed").otherwise("complete")
    return files.select("path", state.alias("state"))


def text_sample(content: Column) -> Column:
    """First 64 KiB as UTF-8, without a character that the limit cuts, else as Latin-1; first 8000 characters."""
    part = F.substring(content, 1, TEXT_BYTES)
    whole = [part] + [F.when(F.octet_length(content) > TEXT_BYTES, F.substring(content, 1, TEXT_BYTES - k)) for k in (1, 2, 3)]
    utf8 = F.coalesce(*(F.when(F.is_valid_utf8(p.cast("string")), p.cast("string")) for p in whole), F.decode(part, "ISO-8859-1"))
    return F.substring(utf8, 1, TEXT_CHARS)


def metadata(files: DataFrame) -> DataFrame:
    """Identity columns as a string map."""
    return files.select("file_id", F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("mtime"), F.col("mtime").cast("string"), F.lit("kind"), F.col("kind"), F.lit("extension"), P.extension(F.col("path"))).alias("metadata"))


def zip_members(files: DataFrame) -> DataFrame:
    """``(path, members)`` from the central directory alone; unreadable archives have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "members": [member_names(bytes(c) if c is not None else b"") for c in pdf["content"]]})

    return files.select("path", "content").mapInPandas(read, "path string, members array<string>")


def member_names(data: bytes) -> list[str]:
    """Names in a ZIP's central directory, without opening a member."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - TAIL_BYTES - 22))
    if end < 0 or end + 22 > len(data):
        return []
    count, at = int.from_bytes(data[end + 10 : end + 12], "little"), int.from_bytes(data[end + 16 : end + 20], "little")
    out: list[str] = []
    while len(out) < min(count, MEMBERS) and data[at : at + 4] == b"PK\x01\x02" and at + 46 <= len(data):
        name, extra, note = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (28, 30, 32))
        raw = data[at + 46 : at + 46 + name]
        if 0 < name <= MEMBER_BYTES and len(raw) == name:
            out.append(raw.decode("utf-8", "replace"))
        at += 46 + name + extra + note
    return out


def wav_verdict(data: bytes) -> tuple[str, int, int, int, int]:
    """``(verdict, channels, rate, offset, length)`` of a RIFF/WAVE file; 16-bit PCM only, the last data chunk wins."""
    none = (0, 0, 0, 0)
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return ("not-riff", *none)
    at, form, found = 12, None, None
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data):
            return ("truncated", *none)
        if data[at : at + 4] == b"fmt " and size >= 16:
            form = tuple(int.from_bytes(data[at + 8 + a : at + 8 + b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
        elif data[at : at + 4] == b"data":
            found = (at + 8, size)
        at += 8 + size + size % 2
    if form is None or found is None:
        return ("truncated", *none)
    code, channels, rate, bits = form
    if code != 1 or bits != 16 or not channels or not rate:
        return ("unsupported", *none)
    return ("ok", channels, rate, *found)


def wav_headers(files: DataFrame) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [wav_verdict(bytes(c) if c is not None else b"") for c in pdf["content"]]
            yield pd.DataFrame(rows, columns=["verdict", "channels", "rate", "offset", "length"]).assign(path=pdf["path"].values)[["path", "verdict", "channels", "rate", "offset", "length"]]

    return files.select("path", "content").mapInPandas(read, "path string, verdict string, channels int, rate int, offset int, length int")


def pcm_chunks(files: DataFrame, *, rate: int = 16_000, seconds: float = 15.0) -> DataFrame:
    """``(path, chunk, start, samples)``: mono float samples at ``rate``, in pieces of ``seconds``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        columns = ["path", "chunk", "start", "samples"]
        for pdf in batches:
            rows, held = [], 0
            for path, content in zip(pdf["path"], pdf["content"]):
                data = bytes(content) if content is not None else b""
                verdict, channels, own, off, size = wav_verdict(data)
                if verdict != "ok":
                    continue
                raw = np.frombuffer(data[off : off + size - size % (2 * channels)], "<i2").reshape(-1, channels).mean(axis=1) / 32768.0
                n = int(len(raw) // (own / rate))
                mono = np.interp(np.arange(n) * (own / rate), np.arange(len(raw)), raw) if n else raw[:0]
                step = int(rate * seconds)
                for k in range(-(-len(mono) // step)):
                    rows.append((path, k, k * seconds, mono[k * step : (k + 1) * step].astype(np.float32)))
                    held += len(rows[-1][-1])
                    if held >= PCM_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(read, "path string, chunk int, start double, samples array<float>")
