"""Reading and writing tables, schemas and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "parquet")


def logical_type(dtype: T.DataType) -> str:
    """int, float, bool, string, datetime or object; anything else by its Spark name."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return "object"
    return dtype.simpleString()


def schema_list(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "dtype": logical_type(f.dataType)} for f in df.schema.fields]


def infer_schema(df: DataFrame) -> DataFrame:
    """(name, dtype) from the schema; no job."""
    rows = [(f.name, logical_type(f.dataType)) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, dtype string")


def pick_format(path: str, fmt: str | None = None) -> str:
    """The hint, else the file name ending."""
    chosen = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if chosen not in FORMATS:
        raise ValueError(f"unsupported format '{chosen}'; use one of {', '.join(FORMATS)}")
    return chosen


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (header; types inferred unless `schema` saves that pass) or Parquet; an empty table is refused."""
    chosen = pick_format(path, fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if chosen == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    df = reader.format(chosen).load(path)
    if not df.columns or df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def rows(spark: SparkSession, n: int) -> DataFrame:
    """Row source: `row_id` 0 .. n-1."""
    if n < 1:
        raise ValueError("at least one row is needed")
    return spark.range(n).withColumnRenamed("id", "row_id")


def load_source(spark: SparkSession, spec: dict) -> DataFrame:
    """A stored table ({"path", "format"}) or a generated one ({"rows", "columns", "context", "seed"})."""
    if "path" in spec:
        return read_table(spark, spec["path"], spec.get("format"), spec.get("schema"))
    if "rows" in spec:
        from tabulane.plans.generate import generate

        return generate(spark, spec["rows"], spec.get("columns", []), spec.get("context"), spec.get("seed", 0))
    raise ValueError("a source needs 'path' or 'rows'")


def write_table(df: DataFrame, path: str, fmt: str, seed: int | None = None, mode: str = "errorifexists") -> int:
    """Write CSV (header), JSON lines or Parquet; returns the row count, observed while writing.

    JSON also gets `<path>_metadata`: one record with rows, columns and seed.
    """
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported format '{fmt}'")
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(fmt).save(path)
    count = seen.get["rows"]
    if fmt == "json":
        record = [(count, df.columns, seed)]
        meta = df.sparkSession.createDataFrame(record, "rows long, columns array<string>, seed long")
        meta.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path.rstrip("/") + "_metadata")
    return count


WHOLE_FILE = 256 << 20  # larger files are read in pieces
PIECE = 8 << 20


def _streamed(piece: int):
    """Digests of whole files read `piece` bytes at a time, by any file system pyarrow knows."""

    def work(batches):
        import hashlib
        from urllib.parse import quote

        from pyarrow import fs

        for batch in batches:
            digests = []
            for path in batch["path"]:
                if path.startswith("file:"):
                    store, inside = fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
                else:
                    store, inside = fs.FileSystem.from_uri(quote(path, safe=":/@"))
                digest = hashlib.sha256()
                with store.open_input_stream(inside) as stream:
                    while part := stream.read(piece):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield batch.assign(sha256=digests)

    return work


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE_FILE, piece: int = PIECE) -> DataFrame:
    """(path, bytes, sha256) per file under `path`, hashed in parallel. Files of any size: those of more than `whole` bytes are read `piece` bytes
    at a time, so no task holds more than `whole` bytes of content. Each large file is a task of its own, since SHA-256 has no parallel form.
    Empty files give no row: Spark's readers pass over them."""
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole).select("path", F.col("length").alias("bytes"))
    return small.unionByName(large.mapInPandas(_streamed(piece), "path string, bytes long, sha256 string"))


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) per file under `path`, by `file_digests`."""
    return file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


def table_checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum) independent of row order, column order and partitioning.

    Each row, columns by name, is hashed; 52 bits of every hash are added up.
    """
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in sorted(df.columns)]
    bits = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *text)), 1, 13), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("checksum"))
