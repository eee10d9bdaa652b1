"""Sheets as people save them: CSV of an unknown delimiter, with or without a byte order mark, some rows of which don't parse."""

from __future__ import annotations

import csv
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"
DELIMITERS = (";", ",", "\t", "|")
#: Lines of a file's head that are looked at.
HEAD = 50
BAD = "_bad"


@dataclass(frozen=True)
class Sheet:
    """A sheet's delimiter and header, the rows that parse, and the others: ``line`` as it was, and ``path`` of its file."""

    delimiter: str
    header: list[str]
    rows: DataFrame
    rejected: DataFrame


def delimiter_of(lines: list[str]) -> str:
    """The delimiter that cuts most lines into as many fields as the first, quotes minded; of equals the one that cuts more, then the first listed.

    Lines that none cuts have one field, and a comma does.
    """

    def fit(delimiter: str) -> tuple[float, int]:
        fields = [len(f) for f in csv.reader(lines, delimiter=delimiter) if f]
        if not fields or fields[0] < 2:
            return 0.0, 0
        return sum(n == fields[0] for n in fields) / len(fields), fields[0]

    best = max(DELIMITERS, key=lambda d: (*fit(d), -DELIMITERS.index(d)))
    return best if fit(best)[1] > 1 else ","


def names_of(line: str, delimiter: str) -> list[str]:
    """The header's names, trimmed; one that is missing or repeated gets its place."""
    names = [n.strip() for n in next(csv.reader([line], delimiter=delimiter), [])]
    seen = Counter(n.lower() for n in names)
    return [n if n and seen[n.lower()] == 1 else f"{n}_{i}".lstrip("_") if n else f"column_{i}" for i, n in enumerate(names)]


def read_sheet(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> Sheet:
    """One sheet of a file, or of the files in a folder, which have the same header.

    ``types`` are the Spark types of columns by name, in any case and order; others are text. A row that has more or fewer fields than the header, or a
    field that isn't of its type, is rejected whole, with its line; empty fields are null, empty lines no rows. A row is a
    line: quoted fields may hold delimiters, not line ends. A file that is empty gives no rows and no columns but ``types``'.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", f"^{BOM}", "").alias("line"), F.col("_metadata.file_path").alias("path"))
    head = [r["line"] for r in lines.filter(F.trim("line") != "").select("line").limit(HEAD).collect()]
    kinds = {k.lower(): v for k, v in (types or {}).items()}
    if not head:
        schema = ", ".join(f"`{k}` {v}" for k, v in (types or {}).items())
        return Sheet(",", [], spark.createDataFrame([], schema or "line string"), lines)
    delimiter = delimiter_of(head)
    header = names_of(head[0], delimiter)
    schema = ", ".join([*[f"`{n}` {kinds.get(n.lower(), 'string')}" for n in header], f"`{BAD}` string"])
    options = {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    data = lines.filter((F.col("line") != head[0]) & (F.trim("line") != ""))
    parsed = data.withColumn("_row", F.from_csv("line", F.lit(schema), options))
    return Sheet(delimiter, header, parsed.filter(f"_row.`{BAD}` is null").select(*[F.col(f"_row.`{n}`") for n in header]), parsed.filter(f"_row.`{BAD}` is not null").select("line", "path"))
