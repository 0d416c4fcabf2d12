"""Sinks: CSV tables for spreadsheets, the eight-table bundle, graph files, chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import archives as A

BUNDLE = ("results", "sources", "materials", "processes", "experiments", "calculations", "relationships", "evidence")


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None, bom: bool = False) -> None:
    """Ordered columns, blanks for nulls, CRLF line ends, cells that can't be taken for formulas.

    With ``bom`` each file starts with a byte-order mark, in its header line.
    """
    columns = columns or rows.columns
    out = A.csv_ready(rows, columns)
    if bom:
        out = out.withColumnRenamed(columns[0], "﻿" + columns[0])
    out.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def bundle(archives: DataFrame, include_quarantined: bool = False) -> dict[str, DataFrame]:
    """Results, records and evidence as eight tables; nested fields are JSON cells."""
    silver = A.silver(archives)
    flat = {n: silver[n] for n in BUNDLE if n not in ("results", "evidence")}
    text = lambda df: df.select(*(F.to_json(c).alias(c) if k.startswith(("array", "struct", "map", "variant")) else F.col(c) for c, k in df.dtypes))
    return {"results": A.all_results(archives, include_quarantined)} | {n: text(df) for n, df in flat.items()} | {"evidence": silver["evidence"]}


def write_bundle(archives: DataFrame, path: str, include_quarantined: bool = False, bom: bool = False) -> None:
    for name, df in bundle(archives, include_quarantined).items():
        write_csv(df, f"{path}/{name}", bom=bom)


def write_graph(archives: DataFrame, path: str) -> None:
    nodes, edges = A.graph(archives)
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_chart(rows: DataFrame, spec: DataFrame, path: str) -> None:
    """A chart's rows, its one-row specification and the records behind it."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/data")
    spec.write.mode("overwrite").json(f"{path}/spec")
