"""Writers: tables as text for people, dated snapshots, releases with a manifest, and workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, CRLF line ends."""
    df.write.option("quoteAll", True).option("lineSep", "\r\n").option("header", True).csv(path)


def write_snapshot(df: DataFrame, path: str, region: str, day: str, replace: bool = False) -> None:
    """One region's listing under its date; a day that is there is refused unless ``replace``."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(f"{path}/region={region}/date={day}")


def append_rows(df: DataFrame, path: str, by: str) -> None:
    """Appended JSON lines, one folder for each value of ``by`` (a week or a month), which readers prune."""
    df.write.mode("append").partitionBy(by).json(path)


def write_release(facts: DataFrame, path: str) -> DataFrame:
    """Facts as JSON lines by topic, and a manifest row for each topic: rows and an order-free digest."""
    facts.write.partitionBy("topic").json(f"{path}/facts")
    part = F.conv(F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in facts.columns])), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    manifest = facts.groupBy("topic").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).cast("decimal(38,0)").cast("string").alias("digest"))
    manifest.write.json(f"{path}/manifest")
    return manifest


def markdown_table(columns: list[str], rows: list[list[object]]) -> str:
    """For a report of few rows."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["---"] * len(columns), *rows]
    return "\n".join("| " + " | ".join(cell(c) for c in r) + " |" for r in lines)


def _column(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """Bytes of a workbook of small sheets; text that starts with = is a formula. The same input gives the same bytes."""
    parts, names = {}, list(sheets)
    for k, rows in enumerate(sheets.values(), 1):
        body = []
        for i, row in enumerate(rows, 1):
            cells = []
            for j, v in enumerate(row, 1):
                ref = f"{_column(j)}{i}"
                if v is None:
                    continue
                if isinstance(v, str) and v.startswith("="):
                    cells.append(f'<c r="{ref}"><f>{escape(v[1:])}</f></c>')
                elif isinstance(v, str):
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", v))}</t></is></c>')
                else:
                    cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            body.append(f'<row r="{i}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(body)}</sheetData></worksheet>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    listed = "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
    package = "http://schemas.openxmlformats.org/package/2006"
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{package}/relationships">{links}</Relationships>'
    parts["_rels/.rels"] = f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    sheet_types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1))
    parts["[Content_Types].xml"] = f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{sheet_types}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + parts[name])
    return out.getvalue()
