"""CSV tables: all-text scan with positions, and an order-keeping sink."""

from __future__ import annotations

import csv
import io
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabshift.functions.cells import na_to_null
from tabshift.functions.names import POS, col, data_columns, has_position
from tabshift.operators.order import placed_in_order
from tabshift.session import cut_lineage

DELIMITERS = ",;\t|"
SNIFFED_CHARACTERS = 4096
#: Rows of a written part file, about.
FILE_ROWS = 1 << 20
_ROW_BITS = 33
_BAD = "_bad_record"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
# files that are numbered by a broadcast table; 200 bytes each
_LISTED_FILES = 100_000


def _head(spark: SparkSession, path: str) -> str:
    """First characters of the first file by path. A line has its line feed at least, so
    as many lines as characters are always enough; longer ones are cut before they leave
    their task."""
    try:
        files = spark.read.format("binaryFile").load(path).select("_metadata.file_path")
        first = files.orderBy("file_path").first()
    except AnalysisException as exc:
        raise FileNotFoundError(path) from exc
    if first is None:
        return ""
    lines = spark.read.text(first[0]).select(F.substring("value", 1, SNIFFED_CHARACTERS))
    head = ""
    for n in (64, SNIFFED_CHARACTERS):
        head = "\n".join(r[0] for r in lines.limit(n).collect())[:SNIFFED_CHARACTERS]
        if len(head) == SNIFFED_CHARACTERS:
            break
    return head


def sniff_delimiter(head: str) -> str:
    """Delimiter guessed from the head of a file; a comma when in doubt."""
    try:
        return csv.Sniffer().sniff(head, delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def header_names(head: str, delimiter: str) -> list[str]:
    """Column names; repeated ones get `.1`, `.2` appended."""
    row = next(csv.reader(io.StringIO(head), delimiter=delimiter), [])
    taken: set[str] = set()
    names = []
    for i, name in enumerate(row):
        base = name or f"Unnamed: {i}"
        candidate, n = base, 0
        while candidate in taken or (n and candidate in row):
            n += 1
            candidate = f"{base}.{n}"
        taken.add(candidate)
        names.append(candidate)
    return names


def _not_too_long(delimiter: str, n_columns: int) -> Column:
    """Fails on a record with more fields than columns; true for any other. The parser
    keeps the text of records with a wrong number of fields."""
    unquoted = F.regexp_replace(_BAD, r'"(?:[^"]|"")*"', "")
    too_long = F.regexp_count(unquoted, F.lit(re.escape(delimiter))) >= n_columns
    error = F.concat(F.lit(f"more than {n_columns} fields in a row: "), F.substring(_BAD, 1, 200))
    # the reader refuses to give the text of bad records alone, so a cell is read as well
    cell_too = F.coalesce(F.length("c0"), F.lit(0)) >= 0
    return F.when(F.col(_BAD).isNotNull() & too_long, F.raise_error(error).cast("boolean")).otherwise(cell_too)


def _setting_bytes(spark: SparkSession, key: str) -> int:
    """Size setting such as `128MB` or `134217728b`."""
    number, unit = re.fullmatch(r"(\d+)([bkmg]?)i?b?", spark.conf.get(key).lower()).groups()
    return int(number) * _UNITS[unit]


def _block_bits(spark: SparkSession) -> int:
    """Splits of a file start at least 2**bits bytes apart: no split is smaller
    than both settings, except the last one of a file."""
    smallest = min(
        _setting_bytes(spark, "spark.sql.files.maxPartitionBytes"),
        _setting_bytes(spark, "spark.sql.files.openCostInBytes"),
    )
    return max(smallest.bit_length() - 1, 0)


def _file_offsets(spark: SparkSession, path: str, bits: int) -> DataFrame:
    """First block number per file, files in path order. Reads the listing only."""
    files = spark.read.format("binaryFile").load(path).select(
        "_metadata.file_path", "_metadata.file_size"
    )
    blocks = F.shiftright(F.col("file_size"), bits) + 1
    by_path = Window.partitionBy(F.lit(0)).orderBy("file_path")
    before = F.sum(blocks).over(by_path.rowsBetween(Window.unboundedPreceding, -1))
    return files.select("file_path", F.coalesce(before, F.lit(0)).alias("_base"))


def positioned(spark: SparkSession, path: str, raw: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """Position from (file, place of the split in the file, row in the split).
    The running row id alone follows the scheduling of splits, not the files."""
    bits = _block_bits(spark)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    scanned = raw.select(
        *[col(c) for c in names],
        F.col("_metadata.file_path").alias("_file"),
        F.shiftright(F.col("_metadata.file_block_start"), bits).alias("_block"),
        row.alias("_row"),
    )
    base = F.lit(0).cast("bigint")
    n_files = len(raw.inputFiles())
    if n_files > 1:
        offsets = _file_offsets(spark, path, bits)
        if n_files <= _LISTED_FILES:
            offsets = F.broadcast(offsets)
        scanned = scanned.join(offsets, F.col("_file") == F.col("file_path"))
        base = F.col("_base")
    position = F.shiftleft(base + F.col("_block"), _ROW_BITS) + F.col("_row")
    return scanned.select(*[col(c) for c in names], position.alias(POS), *keep)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(_text, _pos) of the records of splittable files whose quoted cells may hold line breaks.

    Lines are read by split. Whether a line begins inside a quoted cell is the parity of the
    quotes before it in its file: counted for each 2**16 lines first, by a prefix sum of those
    counts, and within such a group by a window. Lines on their own are records; of the others,
    the k-th and following up to the next line with an odd number of quotes are the k-th
    record that spans lines, whichever splits they are in."""
    lines = positioned(spark, path, spark.read.option("lineSep", "\n").text(path), ["value"], "_file")
    odd = (F.length("value") - F.length(F.translate("value", '"', ""))) % 2
    rows = lines.select("*", F.shiftright(POS, 16).alias("_g"), odd.cast("bigint").alias("_odd"))
    text = F.when(~F.col("value").isin("", "\r"), F.col(POS))
    # one row for 2**16 lines, written: the files are read once for it and once for the rows
    returned = F.when(F.col("value").endswith("\r"), F.col(POS))
    counts = cut_lineage(
        rows.groupBy("_g").agg(F.min("_file").alias("_file"), F.sum("_odd").alias("_n"), F.min(text).alias("_first"), F.min(returned).alias("_cr"))
    )
    in_file = Window.partitionBy("_file").orderBy("_g")
    before = F.coalesce(F.sum("_n").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = lambda c: F.min(c).over(Window.partitionBy("_file"))
    # where the first line ends in a carriage return, line breaks in cells are line feeds
    crlf = F.coalesce(least("_cr") == least("_first"), F.lit(False))
    groups = counts.select("_g", before.alias("_before"), least("_first").alias("_header"), crlf.alias("_crlf"))
    in_group = Window.partitionBy("_g").orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    odd_before = F.col("_before") + F.coalesce(F.sum("_odd").over(in_group), F.lit(0))
    ranked = rows.join(groups, "_g").select("value", POS, "_header", "_crlf", "_odd", odd_before.alias("_quotes"))
    inside = (F.col("_quotes") % 2 == 1) | (F.col("_odd") == 1)
    alone = ranked.filter(~inside).select("value", POS, "_header")
    parts = F.array_sort(F.collect_list(F.struct(POS, "value")))
    spanning = ranked.filter(inside).groupBy("_header", "_crlf", F.shiftright("_quotes", 1).alias("_k")).agg(parts.alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda x: x["value"]), "\n")
    joined = spanning.select(
        F.when(F.col("_crlf"), F.replace(whole, F.lit("\r\n"), F.lit("\n"))).otherwise(whole).alias("value"), F.col("_parts")[0][POS].alias(POS), "_header"
    )
    ended = F.regexp_replace("value", r"\r\z", "")
    # the first line with text of a file is its header; blank lines are no records
    return alone.union(joined).filter((F.col(POS) != F.col("_header")) & ~F.col("value").isin("", "\r")).select(ended.alias("_text"), POS)


def _is_large(spark: SparkSession, path: str) -> bool:
    """Whether a file has more than one split."""
    files = spark.read.format("binaryFile").load(path).select("_metadata.file_size")
    largest = files.agg(F.max("file_size")).first()[0] or 0
    return largest > _setting_bytes(spark, "spark.sql.files.maxPartitionBytes")


def read_table(
    spark: SparkSession, path: str, *, multi_line: bool = True, delimiter: str | None = None, split: bool | None = None
) -> DataFrame:
    """Lazy all-text table with positions; missing-value texts are null. A
    missing path raises FileNotFoundError. Rows with too few fields are padded, rows with
    too many fail the read. Quoted cells may hold line breaks. Files of more than one split
    are read by many tasks and their records put together again (`split` forces or forbids
    that), small ones by a task each. `multi_line=False` spares the work for tables that are
    known to have no line break in a cell."""
    head = _head(spark, path)
    delimiter = delimiter or sniff_delimiter(head)
    names = header_names(head, delimiter)
    if not names:
        return spark.createDataFrame([], T.StructType([T.StructField(POS, T.LongType())]))
    # positional stand-ins keep names with dots and quotes out of the reader
    plain = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*plain, _BAD]])
    options = {
        "sep": delimiter, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
        "columnNameOfCorruptRecord": _BAD,
        # a parser that skips columns does not notice that a row has too many
        "columnPruning": "false",
    }
    fits = _not_too_long(delimiter, len(plain))
    if multi_line and (_is_large(spark, path) if split is None else split):
        parsed = _records(spark, path).select(F.from_csv("_text", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"), POS)
        placed = parsed.select("r.*", POS).filter(fits)
    else:
        raw = spark.read.schema(schema).options(header=True, encoding="UTF-8", multiLine=multi_line, enforceSchema=True, **options).csv(path)
        placed = positioned(spark, path, raw.filter(fits), plain)
    return placed.select(*[na_to_null(F.col(c)).alias(n) for c, n in zip(plain, names)], POS)


def write_table(df: DataFrame, path: str) -> None:
    """Write a table in its order: header, null as empty, overwriting. The part
    files are in order, so reading the folder back gives the same sequence."""
    names = data_columns(df)
    ordered = placed_in_order(df, FILE_ROWS) if has_position(df) else df
    # a missing cell that is a whole row would be a blank line, which readers skip
    lone = len(names) == 1
    cells = [F.coalesce(col(c), F.lit("")).alias(c) if lone else col(c) for c in names]
    (
        ordered.select(*cells)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", '""' if lone else "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
