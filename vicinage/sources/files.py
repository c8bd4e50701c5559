"""File formats of expression data: wide tables, metadata, MatrixMarket with names beside it; and the metadata writer.

All results are long tables with explicit keys, so nothing depends on the order of rows or columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.shared import checkpointed, numbered


def read_wide(spark: SparkSession, path: str, sep: str = "\t", keep_zeros: bool = False) -> DataFrame:
    """(gene, cell_id, value) from a table (gzip too) with a gene column first and a column for each cell."""
    wide = spark.read.csv(path, sep=sep, header=True)
    gene, *cells = wide.columns
    long = wide.unpivot([gene], cells, "cell_id", "value").select(F.col(f"`{gene}`").alias("gene"), "cell_id", F.col("value").try_cast("double").alias("value"))
    return long if keep_zeros else long.filter(F.col("value").isNull() | (F.col("value") != 0))


def read_metadata(spark: SparkSession, path: str, numeric: tuple[str, ...] = ("x", "y"), sep: str = "\t") -> DataFrame:
    """A metadata table whose first column is the cell id; names get lower case, CellType becomes cell_type."""
    rows = spark.read.csv(path, sep=sep, header=True)
    first, *rest = rows.columns
    name = lambda c: {"celltype": "cell_type"}.get(c.lower(), c.lower())
    return rows.select(F.col(f"`{first}`").alias("cell_id"), *[(F.col(f"`{c}`").cast("double") if name(c) in numeric else F.col(f"`{c}`")).alias(name(c)) for c in rest])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of a text file, or of a folder of parts in the order of their names, numbered from 1. Spark reads a plain file in byte
    ranges, a gzip in one; of each range only the number of its lines reaches the driver."""
    block = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    lines = spark.read.text(path).select("value", block.alias("block"), F.monotonically_increasing_id().alias("at"))
    offsets, before = [], 0
    for r in lines.groupBy("block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many")).orderBy("block").collect():
        offsets.append((r["block"]["file"], r["block"]["start"], before - r["first"] + 1))
        before += r["many"]
    ranges = spark.createDataFrame(offsets, "file string, start long, shift long")  # a row for each range of a file
    there = (F.col("block.file") == F.col("file")) & (F.col("block.start") == F.col("start"))
    return lines.join(F.broadcast(ranges), there).select((F.col("at") + F.col("shift")).alias("n"), "value")


def read_lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(n, column): the lines of a text file, numbered from 1 in file order."""
    return numbered_lines(spark, path).withColumnRenamed("value", column)


def read_matrix_market(spark: SparkSession, path: str, rows: str | None = None, cols: str | None = None, row: str = "gene", col: str = "cell_id") -> DataFrame:
    """(row, col, value) of a coordinate file (plain, gzip, or a folder of parts), with names from files of lines, else numbers from 1.

    Names are joined by their number, however many they are. A pattern's values are 1; of symmetric and skew-symmetric matrices both halves are given;
    entries that a file repeats stay rows of their own. The size line is the first that is no comment.
    """
    lines = numbered_lines(spark, path)
    banner = [r["value"].lower().split() for r in lines.filter("n = 1").collect()]
    banner = banner[0] if banner and banner[0][:1] == ["%%matrixmarket"] else ["%%matrixmarket", "matrix", "coordinate", "real", "general"]
    if banner[1:3] != ["matrix", "coordinate"] or banner[3] == "complex":
        raise ValueError(f"cannot read a file of {' '.join(banner[1:])}: real, integer and pattern coordinates are read")
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = body.agg(F.min("n")).first()[0]  # one number
    p = F.split(F.trim("value"), r"\s+")
    entries = body.filter(F.col("n") > F.lit(size)).select(p[0].cast("long").alias("i"), p[1].cast("long").alias("j"), F.coalesce(F.try_element_at(p, F.lit(3)).cast("double"), F.lit(1.0)).alias("value"))
    if banner[4:5] in (["symmetric"], ["skew-symmetric"]):
        sign = 1 if banner[4] == "symmetric" else -1
        entries = entries.unionByName(entries.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (sign * F.col("value")).alias("value")))
    return _with_names(spark, entries, rows, cols, row, col)


def _with_names(spark: SparkSession, entries: DataFrame, rows: str | None, cols: str | None, row: str, col: str) -> DataFrame:
    for place, names, name in (("i", rows, row), ("j", cols, col)):
        if names is None:
            entries = entries.withColumnRenamed(place, name)
        else:
            entries = entries.join(read_lines(spark, names, name).withColumnRenamed("n", place), place).drop(place)
    return entries.select(row, col, "value")


def write_matrix_market(df: DataFrame, path: str, row: str = "gene", col: str = "cell_id", compression: str = "none") -> None:
    """Values (row, col, value) as a coordinate file of parts, which one after the other are one file, in ``path``/matrix, with the names of rows
    and columns, in their order, in ``path``/rows and ``path``/cols (parts too). Rows with a null name or value are left out."""
    kept = checkpointed(df.filter(F.col(row).isNotNull() & F.col(col).isNotNull() & F.col("value").isNotNull()).select(F.col(row).cast("string").alias("r"), F.col(col).cast("string").alias("c"), F.col("value").cast("double").alias("value")))
    names = {c: checkpointed(numbered(kept.select(c).distinct(), c)) for c in "rc"}
    for c, name in (("r", "rows"), ("c", "cols")):
        names[c].repartitionByRange("n").sortWithinPartitions("n").select(c).write.mode("overwrite").text(f"{path}/{name}", compression=compression)
    i, j = (names[c].withColumnRenamed("n", n) for c, n in (("r", "i"), ("c", "j")))
    entries = kept.join(i, "r").join(j, "c").select("i", "j", F.format_string("%d %d %s", "i", "j", F.col("value").cast("string")).alias("line"))
    spark = df.sparkSession
    head = ["%%MatrixMarket matrix coordinate real general", f"{names['r'].count()} {names['c'].count()} {kept.count()}"]
    top = spark.createDataFrame([(-2, 0, head[0]), (-1, 0, head[1])], "i long, j long, line string")  # of one range, as they are the first of all
    both = top.unionByName(entries).repartitionByRange(F.greatest("i", F.lit(0)), F.when(F.col("i") > 0, F.col("j")).otherwise(0)).sortWithinPartitions("i", "j")
    both.select("line").write.mode("overwrite").text(f"{path}/matrix", compression=compression)


def read_dense(spark: SparkSession, path: str, rows: str | None = None, cols: str | None = None, sep: str = "\t", row: str = "gene", col: str = "cell_id", keep_zeros: bool = False) -> DataFrame:
    """(row, col, value) of a table of numbers (plain or gzip) whose first line names the columns; other lines are one field longer if they begin with
    a name. Names from files of lines take the place of the table's own if they are as many; without any, rows have their number from 1.
    What is no number is null. Lines are split in tasks, so a table may have any number of columns that fits a line."""
    fields = F.transform(F.split("value", re.escape(sep), -1), lambda f: F.regexp_replace(f, '^"|"$', ""))
    lines = numbered_lines(spark, path).filter("value <> ''").select("n", fields.alias("f"))
    head, first = (lines.filter(F.col("n") == n).select(F.size("f")).first() for n in (1, 2))
    if head is None:
        raise ValueError("a table has a line of names")
    named = first is not None and first[0] == head[0] + 1
    values = F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))) if named else F.col("f")
    own = F.element_at("f", 1) if named else (F.col("n") - 1).cast("string")
    long = lines.filter("n > 1").select((F.col("n") - 1).alias("i"), own.alias("own"), F.posexplode(values).alias("j", "x"))
    long = long.select("i", "own", (F.col("j") + 1).cast("long").alias("j"), F.col("x").try_cast("double").alias("value"))
    many = {"i": lines.filter("n > 1").count(), "j": head[0]}
    given = {p: read_lines(spark, path, "name").withColumnRenamed("n", p) for p, path in (("i", rows), ("j", cols)) if path is not None}
    given = {p: names for p, names in given.items() if names.count() == many[p]}
    if "j" not in given:
        given["j"] = lines.filter("n = 1").select(F.posexplode("f").alias("j", "name")).select((F.col("j") + 1).cast("long").alias("j"), "name")
    long = long.join(given["j"].withColumnRenamed("name", col), "j")
    long = long.join(given["i"].withColumnRenamed("name", row), "i") if "i" in given else long.withColumnRenamed("own", row)
    return long.select(row, col, "value") if keep_zeros else long.select(row, col, "value").filter("value is null or value <> 0")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_metadata(df: DataFrame, path: str) -> None:
    """Cell or cluster metadata as a tab-separated table with a header (a folder of parts)."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def first_appearance(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with ``ord``, their place by first appearance under ``order``."""
    return df.groupBy(key).agg(F.min(order).alias("at")).withColumn("ord", F.row_number().over(Window.orderBy("at", key))).drop("at")
