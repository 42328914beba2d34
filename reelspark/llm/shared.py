"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words end at these characters: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, a local master gets a temporary one; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="reelspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there and any executor can read it.

    What was written is deleted when the application ends, since results may read it until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, as whole texts are long; a lower bound is left as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?[0-9]+)\s*([kmgt]?)i?b?", spark.conf.get(name).lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= most:
        spark.conf.set(name, most)


def kept_names(keep: list[str], own: tuple[str, ...]) -> list[str]:
    """The names under which an operator returns input columns: where its own columns bear the name, "_input" is appended."""
    seen, found = {c.lower() for c in own}, []
    for c in keep:
        while c.lower() in seen:
            c += "_input"
        seen.add(c.lower())
        found.append(c)
    return found


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, even if body uses it many times or in inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small_or_none(df: DataFrame, rows: int, most: int = 32 << 20) -> DataFrame:
    """df marked for broadcast if it has at most that many rows and about `most` bytes, which are counted first; df as it is otherwise."""
    held = [F.octet_length(F.col(c).cast("binary")) if t in ("string", "binary") else F.size(c) * 32 if t.startswith("array") else F.lit(8) for c, t in df.dtypes]
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.coalesce(h, F.lit(0)).cast("long") for h in held), F.lit(0).cast("long"))).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= rows and (seen["bytes"] or 0) <= most else df


def local_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small table of constants, built from literals."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
