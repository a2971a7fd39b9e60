"""Incident CSV files: reading them as strings, whatever the layout, and writing the export."""

from __future__ import annotations

import csv as plain_csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.kinds import file_category

OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}


def read_file(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """A file's rows, all columns strings, with ``file_name`` and a row order ``seq``. Only columns that are used get parsed.

    Quoted texts may hold line breaks; then one task reads the file. A large file known to have none can be split
    among tasks with ``line_breaks=False``.
    """
    df = spark.read.options(**OPTIONS | {"multiLine": str(line_breaks).lower()}).csv(path, inferSchema=False)
    return df.withColumns({"file_name": F.col("_metadata.file_name"), "seq": F.monotonically_increasing_id()})


def read_declared(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """As read_file with the header given, so that no job looks at the files first."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.options(**OPTIONS).schema(schema).csv(path)
    return df.withColumns({"file_name": F.col("_metadata.file_name"), "seq": F.monotonically_increasing_id()})


MALFORMED = "__malformed"  # whether a record has more or fewer values than the header has names
BROADCAST_BLOCKS = 100_000  # of a few hundred bytes, sent to every executor at most; beyond, the join shuffles
HEADER_BYTES = 1 << 20  # a header is read from so many bytes


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names in a file's first record, each once; none for an empty file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(at)
    try:
        size = min(HEADER_BYTES, fs.getFileStatus(at).getLen())
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()
    names = next(plain_csv.reader(data.decode("utf-8-sig", errors="ignore").splitlines(keepends=True)), [])
    low = [n.lower() for n in names]  # names that are empty or repeat get their place, as Spark's reader does it
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


_BLOCKS = "file_path string, block long, odd boolean, lead string, closed boolean"
_RECORDS = "file_path string, seq long, record string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of lines: whether its quotes are odd in number, and its lines up to the first with an odd number, which end a record that began before."""
    path, block, odd, lead, closed = None, None, False, [], False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (path, block, odd, "\n".join(lead), closed)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    for batch in batches:
        for p, b, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            p, b, text = p.as_py(), b.as_py(), text.as_py()
            if (p, b) != (path, block):
                if path is not None:
                    yield done()
                path, block, odd, lead, closed = p, b, False, [], False
            if not closed:
                lead.append(text)
            if text.count('"') % 2:
                odd, closed = not odd, True
    if path is not None:
        yield done()


def _joined(blocks: pa.Table) -> pa.Table:
    """For each block of a file: whether it begins within quotes, and the lines of later blocks that end its last record."""
    blocks = blocks.sort_by("block")
    odd, lead, closed = (blocks[c].to_pylist() for c in ("odd", "lead", "closed"))
    inside, within = [], False
    for x in odd:
        inside.append(within)
        within ^= x
    tails: list[str | None] = [None] * len(odd)
    later: str | None = None  # what ends a record that is open at the end of this block
    for i in range(len(odd) - 1, -1, -1):
        tails[i] = later if inside[i] ^ odd[i] else None
        if inside[i]:
            later = lead[i] if closed[i] or later is None else lead[i] + "\n" + later
        else:
            later = None
    return pa.table({"file_path": blocks["file_path"], "block": blocks["block"], "inside": pa.array(inside, pa.bool_()), "tail": pa.array(tails, pa.string())})


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of the blocks in which they begin, in order. Where records end with CR LF, that is a line break within quotes too, as it is for Spark's reader."""
    path, block, skip, held, tail, number, opened, crlf = None, None, False, [], None, 0, False, False
    out: list[tuple] = []

    def done(more: list[str]) -> None:
        nonlocal number, held, crlf
        record = "\n".join(held + more)
        crlf = crlf or record.endswith("\r")
        out.append((path, block + number, record.removesuffix("\r").replace("\r\n", "\n") if crlf else record))
        number, held = number + 1, []

    for batch in batches:
        for p, b, text, inside, after in zip(*(batch.column(i) for i in range(5)), strict=True):
            p, b, text = p.as_py(), b.as_py(), text.as_py()
            if (p, b) != (path, block):
                if held:
                    done([tail] if tail is not None else [])
                crlf = crlf and p == path
                path, block, skip, tail, number, opened = p, b, bool(inside.as_py()), after.as_py(), 0, False
            odd = text.count('"') % 2
            if skip:
                skip = not odd
                continue
            held.append(text)
            opened ^= bool(odd)
            if not opened:
                done([])
        yield _as_records(out)
        out.clear()
    if held:
        done([tail] if tail is not None else [])
        yield _as_records(out)


def _as_records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file_path", "seq", "record"])


def read_split(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """The rows of files with this header, as ``read_declared`` gives them, each file being read by as many tasks as it has blocks.

    Line breaks within quotes are told from those between records by the number of quotes before them: each block
    counts its own, the counts are added up along each file, and then every block knows whether it begins within
    quotes. The end of a record that goes on in the next block, a line or a few, is the only text that moves. ``seq``
    follows the order of a file's records. Records that don't fit the header are kept and marked. A file must have its quotes in pairs, as CSV asks; ``read_file``
    reads others as one task.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    blocks = lines.mapInArrow(_blocks, _BLOCKS).groupBy("file_path").applyInArrow(_joined, "file_path string, block long, inside boolean, tail string")
    open_ones = blocks.where("inside or tail is not null").cache()
    few = open_ones.count() <= BROADCAST_BLOCKS
    if few:
        joined = lines.join(F.broadcast(open_ones), ["file_path", "block"], "left")
    else:
        joined = lines.withColumn("line", F.monotonically_increasing_id()).join(open_ones, ["file_path", "block"], "left").repartition("file_path", "block").sortWithinPartitions("file_path", "block", "line")
    records = joined.select("file_path", "block", "text", F.coalesce("inside", F.lit(False)).alias("inside"), "tail").mapInArrow(_records, _RECORDS)
    fields = ", ".join([*(f"c{i} string" for i in range(len(columns))), "broken string"])  # names may repeat or hold points
    options = {k: v for k, v in OPTIONS.items() if k != "header"} | {"columnNameOfCorruptRecord": "broken"}
    parsed = records.where("seq > 0 and record <> ''").select("file_path", "seq", F.from_csv("record", fields, options).alias("r"))
    name = F.element_at(F.split("file_path", "/"), -1)
    own = [F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)]
    return parsed.select(*own, F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file_name"), "seq", F.col("r.broken").isNotNull().alias(MALFORMED))


def list_files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(path, category) of the CSV files at a path, a file or a folder (not below it), by name; unknown kinds are left out."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at) if s.isFile()]
    names = sorted((p.getName(), p.toString()) for p in found if p.getName().lower().endswith(".csv"))
    if not names:
        return []
    kinds = spark.createDataFrame(names, "name string, path string").select("name", "path", file_category(F.col("name")).alias("kind"))
    return [(r.path, r.kind) for r in kinds.orderBy("name").collect() if r.kind != "unknown"]


def rename_files(spark: SparkSession, folder: str, name: str) -> None:
    """Gives the files that a writer left in a folder of its own names that say what they hold: name1.csv, name2.csv, ..."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts, 1):
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(at, part), spark._jvm.org.apache.hadoop.fs.Path(at, f"{name}{i}.csv"))


def write_export(df: DataFrame, path: str) -> None:
    """The export as CSV with a header, also when empty: CRLF, nulls as nothing, times in ISO form."""
    stamps = [c for c, t in df.dtypes if t.startswith("timestamp")]
    iso = df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c in stamps}) if stamps else df
    plain = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}  # writers trim by default
    iso.write.mode("overwrite").options(header="true", lineSep="\r\n", nullValue="", emptyValue="", quote='"', escape='"', **plain).csv(path)
