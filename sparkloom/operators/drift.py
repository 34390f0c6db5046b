"""Drift between two snapshots, and evidence that can be checked again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sparkloom.functions import fixed, text


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, target, severity) of (fact, target, hash): added, removed, and modules whose hash differs."""
    a, b = old.select("fact", "target", F.col("hash").alias("was")).distinct(), new.select("fact", "target", F.col("hash").alias("now")).distinct()
    met = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["fact", "target"], "full_outer")
    prefix, added, removed = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for fact, (name, plus, minus) in fixed.DRIFT.items():
        here = F.col("fact") == fact
        prefix, added, removed = F.when(here, name).otherwise(prefix), F.when(here, plus).otherwise(added), F.when(here, minus).otherwise(removed)
    changed = (F.col("fact") == "modules") & ~F.col("was").eqNullSafe(F.col("now"))
    kind = F.when(F.col("a").isNull(), F.concat(prefix, F.lit("_added"))).when(F.col("b").isNull(), F.concat(prefix, F.lit("_removed"))).when(changed, "module_modified")
    sev = F.when(F.col("a").isNull(), added).when(F.col("b").isNull(), removed).otherwise("info")
    return met.select(kind.alias("kind"), "target", sev.alias("severity")).filter("kind is not null")


def watch_exit(drift: DataFrame) -> DataFrame:
    """(clean, breaking, exit_code): 1 if anything breaks, else 0."""
    return drift.agg((F.count("*") == 0).alias("clean"), F.count_if(F.col("severity") == "breaking").alias("breaking")).withColumn("exit_code", (F.col("breaking") > 0).cast("int"))


def verify(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """``findings`` (path, line, rule, snippet_sha256, receipt) with ``status`` against current (path, line, sha256) lines.

    A receipt that its own fields do not give is a mismatch; a path or line that is gone cannot be verified.
    """
    own = text.receipt(F.col("rule"), F.col("path"), F.col("line"), F.col("snippet_sha256"))
    met = findings.join(lines.select("path", "line", F.col("sha256").alias("now")), ["path", "line"], "left")
    status = F.when(F.col("receipt") != own, "mismatch").when(F.col("now").isNull(), "unverifiable").when(F.col("now") == F.col("snippet_sha256"), "verified").otherwise("stale")
    return met.withColumn("status", status).drop("now")


def manifest(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, sha256, md5, size) of each file."""
    return files.select(F.col(key).alias("key"), F.sha2(F.col(body), 256).alias("sha256"), F.md5(F.col(body)).alias("md5"), F.octet_length(body).cast("long").alias("size"))


def evidence_at(rows: DataFrame, own: Column, snippet: Column, most: int = 200) -> DataFrame:
    """(path, line, rule, snippet, snippet_sha256, file_sha256, receipt) of rows (path, line, rule, body), each a place in its own text.

    ``own`` is the whole line, null if the file does not have it, which gives nothing; the digest is of it, and ``snippet`` is cut.
    """
    met = rows.withColumn("own", own).filter("line >= 1 and own is not null")
    digest = F.sha2("own", 256)
    return met.select("path", "line", "rule", F.left(snippet, F.lit(most)).alias("snippet"), digest.alias("snippet_sha256"), F.sha2("body", 256).alias("file_sha256"), text.receipt(F.col("rule"), F.col("path"), F.col("line"), digest).alias("receipt"))


def evidence(places: DataFrame, files: DataFrame, most: int = 200) -> DataFrame:
    """The same of places (path, line, rule) in files (path, body); lines are those of ``text.lines``, snippets their start without blanks."""
    met = places.join(files.select("path", "body"), "path")
    return evidence_at(met, F.get(text.lines(F.col("body")), F.col("line") - 1), F.trim("own"), most)


def root(rows: DataFrame, entry: Column, *by: str) -> DataFrame:
    """(by, root, n): digest of each group's entries in order, one line each; without groups one row, of nothing that of the empty text.

    Entries are dealt by group, sorted, and fed to the digest one after the other, so no group is ever held as a whole.
    Without groups one task reads all entries, as a digest over all of them in order asks for.
    """
    keys = list(by)
    own = rows.select(*keys, entry.alias("entry"), F.lit(True).alias("real"))
    if not keys:  # a row that stands for none, so that there is a task even over nothing
        own = own.unionByName(rows.sparkSession.range(1).select(F.lit("").alias("entry"), F.lit(False).alias("real")))
    dealt = own.repartition(*keys) if keys else own.repartition(1)
    schema = StructType([*[own.schema[k] for k in keys], *StructType.fromDDL("root string, n bigint")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def close() -> None:
            out.append((*held[0], held[1].hexdigest(), held[2]))

        for batch in batches:
            lists = [batch.column(k).to_pylist() for k in (*keys, "entry", "real")]
            for *key, line, real in zip(*lists, strict=True):
                if not real:
                    continue
                if held is None or held[0] != key:
                    if held:
                        close()
                    held = [key, hashlib.sha256(), 0]
                held[1].update((b"\n" if held[2] else b"") + (line or "").encode("utf-8", "surrogatepass"))
                held[2] += 1
        if held:
            close()
        elif not keys:
            out.append((hashlib.sha256().hexdigest(), 0))
        columns = [list(x) for x in zip(*out, strict=True)] if out else [[] for _ in schema.fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], schema.fieldNames())

    return dealt.sortWithinPartitions(*keys, "entry").mapInArrow(walk, schema)


def manifest_root(rows: DataFrame, *by: str) -> DataFrame:
    """Digest of ``key:sha256:size`` lines in key order, for each group."""
    return root(rows, F.concat_ws(":", F.col("key").cast("string"), "sha256", F.col("size").cast("string")), *by)


def problems(declared: DataFrame, present: DataFrame) -> DataFrame:
    """(key, problem) between a manifest and what is there: missing, undeclared, or changed."""
    a, b = declared.select("key", F.col("sha256").alias("said")), present.select("key", F.col("sha256").alias("is"))
    met = a.join(b, "key", "full_outer")
    what = F.when(F.col("is").isNull(), "missing").when(F.col("said").isNull(), "undeclared").when(F.col("said") != F.col("is"), "changed")
    return met.select("key", what.alias("problem")).filter("problem is not null")
