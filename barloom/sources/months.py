"""Tables of bars or features cut by month: what a change doesn't touch isn't read or written again.

A table is a versioned one whose folders are months; a month may have several, one from each change that only added to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.sources.versions import Part, Version, VersionedTable

MONTH = "_month"
#: Folders that a month may have before a change writes it anew.
MOST_FOLDERS = 8


def month(time: str | Column = "time") -> Column:
    return F.date_format(time, "yyyy-MM")


def month_of(key: str) -> str:
    return key.split("#")[0]


def written(table: VersionedTable, rows: DataFrame) -> Part:
    """``rows`` as files of a folder for each month, dealt by ranges of month and ticker and sorted by ticker and time."""
    dealt = rows.withColumn(MONTH, month()).repartitionByRange(MONTH, "ticker").sortWithinPartitions(MONTH, "ticker", "time")
    part, tag = table.write(dealt, MONTH), uuid.uuid4().hex[:8]
    return replace(part, folders={f"{k}#{tag}": f for k, f in part.folders.items()})


def between(first: str | None, last: str | None) -> Callable[[str], bool]:
    """Picks the folders of the months from ``first`` to ``last``, dates or months; rows without a time are in every span."""
    low, high = (first or "")[:7], (last or "9999-99")[:7]
    return lambda key: low <= month_of(key) <= high or not month_of(key)[:1].isdigit()


def changed(table: VersionedTable, base: Version, fresh: Part, stays: Callable[[DataFrame], DataFrame], goes: Callable[[DataFrame], DataFrame], reach: Callable[[str], bool], operation: str, batches: dict[str, int] | None = None, counts: dict[str, int] | None = None) -> Version:
    """Commit ``fresh`` rows on top of ``base`` without the old rows that ``goes`` picks and ``stays`` leaves out.

    Only folders that ``reach`` picks can hold such rows. Months that do hold some, and months of many folders, are written
    again with the rows that stay; all others keep their files.
    """
    old = base.parts[""]
    hit = {r[0] for r in goes(table.load(old, reach)).select(month().alias(MONTH)).distinct().collect()}  # a row for each month
    folders: dict[str, list[str]] = {}
    for key in old.folders:
        folders.setdefault(month_of(key), []).append(key)
    added = {month_of(k) for k in fresh.folders}
    again = {m for m, keys in folders.items() if m in hit or (None in hit and not m[:1].isdigit()) or (m in added and len(keys) >= MOST_FOLDERS)}
    kept = {k: f for k, f in old.folders.items() if month_of(k) not in again}
    rest = written(table, stays(table.load(old, lambda k: month_of(k) in again))).folders if again else {}
    schema = StructType([*StructType.fromJson(_json(old.schema)), *[f for f in StructType.fromJson(_json(fresh.schema)) if f.name not in StructType.fromJson(_json(old.schema)).names]])
    return table.commit(base.parts | {"": replace(old, schema=schema.json(), folders=kept | rest | fresh.folders)}, operation, base, batches, counts)


def _json(text: str) -> dict:
    import json

    return json.loads(text)


def merge(table: VersionedTable, new: DataFrame) -> Version:
    """Rows in place of a ticker's old ones from its first new one on; no table yet, all are new. Columns may be added."""
    base, fresh = table.version(), written(table, new)
    if base is None:
        return table.commit({"": fresh}, "merge", None)
    starts = table.load(fresh).groupBy("ticker").agg(F.min("time").alias("_from"))
    stay = F.expr("_from is null or time < _from")
    with_start = lambda old: old.join(starts, "ticker", "left")
    first = min((month_of(k) for k in fresh.folders if month_of(k)[:1].isdigit()), default=None)
    if first is None:
        return table.commit(base.parts | {"": replace(base.parts[""], folders=base.parts[""].folders | fresh.folders)}, "merge", base)
    return changed(table, base, fresh, lambda old: with_start(old).filter(stay).drop("_from"), lambda old: with_start(old).filter(~F.coalesce(stay, F.lit(False))), between(first, None), "merge")


def upsert(table: VersionedTable, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> Version | None:
    """Rows, one for each ticker and time, in place of old ones of the same ticker and time.

    A ``batch`` of a ``stream`` that is in the table already changes nothing: the number of the last one is committed with
    its rows.
    """
    base, batches = table.version(), {} if stream is None else {stream: batch}
    if stream is not None and base is not None and base.batches.get(stream, -1) >= batch:
        return None
    fresh = written(table, rows)
    numbers = {"rows": table.load(fresh).count()}  # from the files' footers
    if base is None:
        return table.commit({"": fresh}, "upsert", None, batches, numbers)
    keys = table.load(fresh).select("ticker", "time")
    touched = {month_of(k) for k in fresh.folders}
    return changed(table, base, fresh, lambda old: old.join(keys, ["ticker", "time"], "left_anti"), lambda old: old.join(keys, ["ticker", "time"], "left_semi"), lambda k: month_of(k) in touched, "upsert", batches, numbers)
