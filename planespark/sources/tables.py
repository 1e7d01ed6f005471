"""Results tables as delimited text: a header, then a row a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAN = float("nan")
#: Column that holds a row of another width while it is read.
_BAD = "_other_width"


def write(rows: DataFrame, path: str, sep: str = ",") -> None:
    """Every file gets the header; cells that hold the separator or a quote are quoted, missing cells are written as NaN."""
    rows.write.options(header=True, sep=sep, escape='"', nullValue="NaN", emptyValue="").csv(path)


def separator(path: str) -> str:
    """Tabs for names that end in .txt, .tsv or .tab, else commas."""
    return "\t" if path.lower().rpartition(".")[2] in ("txt", "tsv", "tab") else ","


def read(spark: SparkSession, path: str, sep: str | None = None, numeric: list[str] | None = None, line_breaks: bool = True) -> DataFrame:
    """A table from one file or a folder of files that share their header; without ``sep`` the name tells it.

    A header of numbers alone is a row of data, and the columns are C1 to Cn. A
    leading column without a name holds row numbers and is dropped, a byte order
    mark is removed. Columns whose cells are all numbers or missing become
    numbers, with NaN for missing; the others stay texts. ``numeric`` names the
    columns of numbers where that is known and saves the pass that finds them.
    Quoted cells may hold line breaks; a file is then read by one task, so say
    ``line_breaks=False`` for large files without them. A repeated name gets its
    number behind it. A row with fewer cells than the header lacks the others,
    one with more is an error.
    """
    source = spark.read.options(sep=sep or separator(path), quote='"', escape='"', multiLine=line_breaks)
    first = source.csv(path).head()
    head = [(c or "").removeprefix("﻿").strip() for c in first or []]
    data = bool(head) and all(_number(c) for c in head)
    names = [f"C{k}" for k in range(1, len(head) + 1)] if data else [c or f"C{k}" for k, c in enumerate(head, 1)]
    seen: dict[str, int] = {}
    for k, c in enumerate(names):
        seen[c] = seen.get(c, 0) + 1
        names[k] = c if seen[c] == 1 else f"{c}_{seen[c]}"
    schema = ", ".join(f"`{c}` string" for c in names)
    rows = source.option("header", not data).option("mode", "PERMISSIVE").option("enforceSchema", True).schema(f"{schema}, `{_BAD}` string" if names else schema).option("columnNameOfCorruptRecord", _BAD).csv(path)
    if names:  # a row with other cells than the header: shorter ones are filled up, longer ones are an error
        longer = F.col(_BAD).isNotNull() & F.col(f"`{names[-1]}`").isNotNull()
        rows = rows.withColumn(names[0], F.when(longer, F.raise_error(F.concat(F.lit("more cells than the header: "), F.col(_BAD)))).otherwise(F.col(f"`{names[0]}`"))).drop(_BAD)
    if data:
        rows = rows.withColumn(names[0], F.regexp_replace(names[0], "^﻿", ""))
    elif head and not head[0]:
        rows, names = rows.drop(names[0]), names[1:]
    if numeric is None:
        missing = lambda c: F.col(f"`{c}`").isNull() | (F.col(f"`{c}`") == "NaN")
        found = rows.agg(*(F.coalesce(F.bool_and(missing(c) | F.col(f"`{c}`").try_cast("double").isNotNull()), F.lit(False)).alias(f"k{k}") for k, c in enumerate(names))).head() if names else ()
        numeric = [c for c, yes in zip(names, found, strict=True) if yes]
    value = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(NAN)).alias(c) if c in numeric else F.col(f"`{c}`")
    return rows.select(*map(value, names))


def _number(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return False
    return True
