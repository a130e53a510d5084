"""Writers, and what a rerun may skip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Each table under its name; ``kind`` is parquet, json (lines), csv or orc."""
    for name, table in tables.items():
        table.write.mode(mode).format(kind).options(**({"header": True} if kind == "csv" else {})).save(f"{path}/{name}")


def write_texts(rows: DataFrame, path: str, text: str = "text") -> None:
    rows.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def append_annotations(rows: DataFrame, path: str) -> None:
    """Annotations are an append-only log; readers take the latest of each line."""
    rows.write.mode("append").parquet(path)


def unfinished(pages: DataFrame, manifest: DataFrame, by: str = "page", overwrite: bool = False) -> DataFrame:
    """Pages without a successful entry in the manifest. Manifest rows are written last, so a page that failed comes again."""
    return pages if overwrite else pages.join(manifest.filter("status = 'done'").select(by), by, "left_anti")


def report(title: str, sections: dict[str, DataFrame], most: int = 40) -> str:
    """A Markdown report: of each section at most ``most`` rows as a table."""
    out = [f"# {title}", ""]
    for name, table in sections.items():
        rows = table.limit(most).collect()
        out += [f"## {name}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |" for row in rows] + [""]
    return "\n".join(out)
