"""Sources: trees of files, archives of files, and tables. Sinks: reports."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed, text
from sparkloom.operators import drift

def files(spark: SparkSession, root: str, kinds: tuple[str, ...] = fixed.AUDIT_ENDS, most_bytes: int = 2_000_000, most_files: int = 5_000) -> DataFrame:
    """(path, body, size) of the files below ``root`` with one of the extensions, the first ``most_files`` by path.

    Paths and sizes are listed first, without bodies; only files that are kept are read. Bytes that are no UTF-8 become
    the replacement character.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}")
    top = re.escape(root.split(":", 1)[-1].rstrip("/")).replace("/", "/+")
    relative = F.regexp_replace("path", f"^.*?{top}/+", "")
    dirs = F.split(relative, "/")
    entered = ~F.exists(dirs, lambda p: p.isin(*fixed.AUDIT_SKIPPED) | p.startswith(".venv"))
    listed = reader.load(root).select("path", "length").filter((F.col("length") <= most_bytes) & entered)
    chosen = [r["path"] for r in listed.orderBy("path").limit(most_files).collect()]
    if not chosen:
        return spark.createDataFrame([], "path string, body string, size long")
    found = spark.read.format("binaryFile").load(chosen)
    return found.select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("body"), F.col("length").alias("size"))


def safe_member(path: Column) -> Column:
    """Whether an archive member's path stays inside: relative, without backslashes and parent steps."""
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"\\|^[A-Za-z]:") & ~F.exists(F.split(path, "/"), lambda p: p == "..")


def members(archives: DataFrame, name: str, body: str, most_bytes: int = 300_000, total: int = 24_000_000, count: int = 1500, unwrap: bool = False) -> DataFrame:
    """(archive, path, data) of the regular files in tar.gz and zip archives, up to the bounds of each archive.

    Links, unsafe paths and skipped directories are left out; sizes are those read, not those declared. ``unwrap`` drops
    the one directory that holds all that a tar.gz has, and files beside it.
    """

    def walk(data: bytes) -> Iterator[tuple[str, bytes]]:
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if not info.is_dir() and (info.external_attr >> 28) != 0xA:
                        with z.open(info) as f:
                            yield info.filename, f.read(most_bytes + 1)
        elif data[:2] == b"\x1f\x8b":
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as t:
                for m in t:
                    if m.isreg():
                        yield m.name, t.extractfile(m).read(most_bytes + 1)

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for own, data in zip(frame["archive"], frame["data"], strict=True):
                used = kept = 0
                try:
                    for path, content in walk(bytes(data or b"")):
                        parts = path.replace("\\", "/").split("/")
                        bad = path.startswith("/") or ".." in parts or any(p in fixed.AUDIT_SKIPPED for p in parts)
                        bad = bad or (unwrap and data[:2] == b"\x1f\x8b" and len(parts) < 2)
                        if bad or len(content) > most_bytes:
                            continue
                        if used + len(content) > total or kept >= count:
                            break
                        used, kept = used + len(content), kept + 1
                        out.append((own, "/".join(parts[1:]) if unwrap and data[:2] == b"\x1f\x8b" else path, content))
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError):
                    continue
            yield pd.DataFrame(out, columns=["archive", "path", "data"])

    rows = archives.select(F.col(name).cast("string").alias("archive"), F.col(body).alias("data"))
    return rows.mapInPandas(expand, "archive string, path string, data binary")


def report(findings: DataFrame) -> DataFrame:
    """One row: findings in order as JSON, counts by severity with zeros, and the root of their evidence.

    The report is one document, so all its findings are in that row; ``tree.ordered`` cuts them first where that is too much.
    """
    order = F.struct(text.severity_rank(F.col("severity")).alias("rank"), "path", "line", "rule", "snippet", "snippet_sha256", "receipt", "severity")
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    gate = F.when(F.col("critical") > 0, "BLOCK").when(F.col("high") + F.col("medium") > 0, "REVIEW").otherwise("PASS")
    root = drift.root(findings, F.concat_ws(":", "path", F.col("line").cast("string"), "snippet_sha256")).select(F.col("root").alias("manifest_root"))
    whole = findings.agg(F.to_json(F.array_sort(F.collect_list(order))).alias("findings"), *counts)
    return whole.join(F.broadcast(root)).withColumn("gate", gate)  # one row beside one row
