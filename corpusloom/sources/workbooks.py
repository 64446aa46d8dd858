"""Workbooks of two sheets as a source: any number of files, read where Spark reads them, a task per file and sheet.

Files come as (path, content), as Spark's ``binaryFile`` source gives them from any file system. A sheet is taken apart in its
task, row by row; its header must be the expected set of columns. All that follows is columns: cells get their types, a row
that can't be read is refused with every reason, and refusals that depend on other rows are joined back.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import free_names, looked_up, ship
from .readers import checked_rows, sheet_names, sheet_rows

ROWS = "path string, sheet string, row int, cells map<string,string>, error string"


@dataclass(frozen=True)
class Sheet:
    """A sheet's columns. ``cells`` gives a column's value from its text; where it gives none for a text that is there, the row is refused."""

    name: str
    columns: tuple[str, ...]
    required: tuple[str, ...] = ()
    cells: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sheet_errors(header: list, columns: tuple[str, ...], sheet: str) -> list[str]:
    """Why a header is not the expected set of columns, in whatever order."""
    named = [h for h in header if h not in (None, "")]
    out = [f"{sheet}: repeated column {h}" for h in sorted({h for h in named if named.count(h) > 1})]
    out += [f"{sheet}: missing column {c}" for c in columns if c not in named]
    return out + [f"{sheet}: unexpected column {h}" for h in sorted(set(named) - set(columns))]


def workbook_rows(files: DataFrame, sheets: list[Sheet]) -> DataFrame:
    """``ROWS``: each row that is not blank with its number in the sheet, or what is wrong with a file's structure (row 0)."""
    spark = files.sparkSession
    ship(spark)
    expected = {s.name: s.columns for s in sheets}
    dealt = files.select("path", "content", F.explode(F.array(*[F.lit(s.name) for s in sheets])).alias("sheet")).repartition("path", "sheet")

    def read(content, sheet):
        try:
            book = io.BytesIO(content or b"")
            with zipfile.ZipFile(book) as z:
                names = sheet_names(z)
            if sheet not in names:
                yield 0, None, f"{sheet}: missing sheet"
                return
            rows = sheet_rows(book, sheet)
            header = next(rows, [])
            errors = sheet_errors(header, expected[sheet], sheet)
            if errors:
                yield from ((0, None, e) for e in errors)
                return
            for n, cells in enumerate(rows, 2):
                if any(c not in (None, "") for c in cells):
                    yield n, [(h, c) for h, c in zip(header, cells) if h and c not in (None, "")], None
        except Exception as error:  # whatever is no workbook ends here: the file is refused, not the job
            yield 0, None, f"{sheet}: not a readable workbook ({type(error).__name__})"

    def run(batches):
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for i in range(batch.num_rows):  # one workbook at a time, not a batch of them
                path, content, sheet = (c[i].as_py() for c in batch.columns)
                lot = []
                for one in read(content, sheet):
                    lot.append((path, sheet, *one))
                    if len(lot) == 2000:
                        yield _batch(lot, kind)
                        lot = []
                if lot:
                    yield _batch(lot, kind)

    def _batch(lot, kind):
        types = (pa.string(), pa.string(), pa.int32(), kind, pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*lot), types)], names=["path", "sheet", "row", "cells", "error"])

    return dealt.mapInArrow(run, ROWS)


def structure_errors(rows: DataFrame) -> DataFrame:
    """(path, error): files with an error; none of their rows is taken."""
    return rows.where("error IS NOT NULL").select("path", "error")


def typed_rows(rows: DataFrame, sheet: Sheet, key: str | None = None, parent: str | None = None) -> DataFrame:
    """path, row, the sheet's columns, and ``reasons``: all that is wrong with the row; none means it is accepted.

    With ``key``, rows of a file that share an id are all refused, and with ``parent`` those whose parent is missing in
    the file or refused. Rows of a file whose structure is wrong, in any sheet, are left out.
    """
    bad = structure_errors(rows).select("path").distinct()
    got = rows.where((F.col("sheet") == sheet.name) & F.col("error").isNull()).join(bad, "path", "left_anti")
    said = {c: F.nullif(F.trim(F.try_element_at("cells", F.lit(c))), F.lit("")) for c in sheet.columns}
    value = {c: sheet.cells[c](x) if c in sheet.cells else x for c, x in said.items()}
    reasons = [F.when(said[c].isNull(), f"missing {c}") for c in sheet.required] + [F.when(said[c].isNotNull() & value[c].isNull(), f"unreadable {c}") for c in sheet.cells]
    got = got.select("path", "row", *[v.alias(c) for c, v in value.items()], F.array_compact(F.array(*reasons)).alias("reasons"))
    if key is None:
        return got
    own, up, first = free_names(got, "own_key", "up_key", "first_reasons")
    of_file = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct("path", F.col(c).alias("k"))))
    keyed = got.withColumnRenamed("reasons", first).withColumn(own, F.coalesce(of_file(key), F.to_json(F.struct("path", "row"))))
    if parent:
        keyed = keyed.withColumn(up, of_file(parent))
    # A refused parent is one with any reason: the first ones take part before parents are looked at.
    clean = checked_rows(keyed, own)
    clean = clean.withColumn(first, F.concat(first, "reasons")).drop("reasons")
    if parent:
        fine = clean.groupBy(F.col(own).alias("p_key")).agg(F.min(F.size(first) == 0).alias("p_fine"))
        clean = looked_up(clean, up, fine, "p_key")
        why = F.when(F.col(up).isNotNull() & F.col("p_key").isNull(), "orphan_parent").when(F.col(up).isNotNull() & ~F.col("p_fine"), "parent_rejected")
        clean = clean.withColumn(first, F.concat(first, F.array_compact(F.array(why)))).drop("p_key", "p_fine", up)
    return clean.drop(own).withColumnRenamed(first, "reasons")


def import_report(rows: DataFrame, typed: dict[str, DataFrame]) -> DataFrame:
    """(path, sheet, read, accepted, rejected): a row per file and sheet; what is accepted and rejected adds up to what was read."""
    parts = [df.groupBy("path").agg(F.count("*").alias("read"), F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.size("reasons") > 0).alias("rejected")).select("path", F.lit(name).alias("sheet"), "read", "accepted", "rejected") for name, df in typed.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """An XLSX file of text cells, sheet by sheet; None leaves a cell out."""

    def column(i: int) -> str:
        name = ""
        while i:
            i, rest = divmod(i - 1, 26)
            name = chr(65 + rest) + name
        return name

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = lambda n, row: "".join(f'<c r="{column(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for k, v in enumerate(row, 1) if v is not None)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>" + "".join(f'<row r="{n}">{cells(n, r)}</row>' for n, r in enumerate(rows, 1) if r) + "</sheetData></worksheet>")
    return out.getvalue()
