"""What the operators of this subpackage share: tables, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000
#: Texts that a Python worker gets at once, at most.
BATCH = 1_000
#: Narrow rows of a file, where their number is known.
FILE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(rows: int) -> int:
    """Files for so many narrow rows. The local file system starts a process for each file it makes, so few rows take few."""
    return max(1, -(-rows // FILE_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder, so a lost executor costs no recomputation.

    The folder is the one the session names in ``spark.checkpoint.dir``; a folder of our own is set only where the session
    names none and runs on one machine, as in tests. A cluster without a shared folder is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-"))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Whole texts reach Python workers in small batches: lowers the session's limit to ``BATCH`` rows, if it is higher."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows of at most ``most`` bytes; else unhinted, to be shuffled.

    At most ``limit`` + 1 rows are looked at, so checking costs little whatever the size.
    """
    wide = {"string": F.octet_length, "binary": F.octet_length}
    each = [F.coalesce(wide[kind](c), F.lit(0)) if kind in wide else F.coalesce(F.size(c), F.lit(0)) * 24 if kind.startswith(("array", "map")) else F.lit(16) for c, kind in df.dtypes]
    n, size = df.limit(limit + 1).agg(F.count("*"), F.sum(reduce(Column.__add__, each).cast("long"))).first()
    return F.broadcast(df) if n <= limit and (size or 0) <= most else df


def utf8_bytes(text: Column) -> Column:
    """Bytes of the text in UTF-8; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
