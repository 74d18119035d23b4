"""A sink for reports: tables as Markdown, LaTeX or text-exposition files, `df.write.format("report")`.

Each task writes the lines of its partition to a file of its own in a staging folder beside the target; the commit joins
the files of the tasks that succeeded, in the order of their partitions, and moves the whole into place. A failed task
or an aborted write leaves no target, and the one that was there before stays as it was.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import NumericType, StructType

#: Bytes that are copied at once when files are joined.
COPY = 1 << 20


def shown(value) -> str:
    """A value in a cell: null is empty, true and false in lower case, floats at full length."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else value.isoformat()
    return str(value)


def markdown_cell(value) -> str:
    return re.sub(r"\r\n|\r|\n", "<br>", shown(value).replace("\\", "\\\\").replace("|", "\\|"))


_TEX = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: "\\" + c for c in "&%$#_{}"}


def latex_cell(value) -> str:
    return " ".join("".join(_TEX.get(c, c) for c in shown(value)).splitlines())


def exposition_label(value) -> str:
    return shown(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


class Markdown:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.title = schema, options.get("title")

    def head(self) -> str:
        title = f"# {self.title}\n\n" if self.title else ""
        edge = " | ".join("---:" if isinstance(f.dataType, NumericType) else "---" for f in self.schema)
        return f"{title}| {' | '.join(markdown_cell(n) for n in self.schema.names)} |\n| {edge} |\n"

    def line(self, row) -> str:
        return f"| {' | '.join(map(markdown_cell, row))} |\n"

    def foot(self) -> str:
        return ""


class Latex(Markdown):
    def head(self) -> str:
        sides = "".join("r" if isinstance(f.dataType, NumericType) else "l" for f in self.schema)
        title = f"\\caption{{{latex_cell(self.title)}}}\n" if self.title else ""
        return f"\\begin{{table}}\n{title}\\begin{{tabular}}{{{sides}}}\n\\hline\n{' & '.join(latex_cell(n) for n in self.schema.names)} \\\\\n\\hline\n"

    def line(self, row) -> str:
        return f"{' & '.join(map(latex_cell, row))} \\\\\n"

    def foot(self) -> str:
        return "\\hline\n\\end{tabular}\n\\end{table}\n"


class Exposition:
    """Every numeric column is a metric with the other columns as labels; options: prefix, type (gauge or counter). A null
    value has no line, so all lines of a metric must stand together: one numeric column a file."""

    def __init__(self, schema: StructType, options: dict):
        values = [k for k, f in enumerate(schema) if isinstance(f.dataType, NumericType)]
        if len(values) != 1:
            raise ValueError("a metrics file holds one numeric column")
        self.names, self.at = schema.names, values[0]
        self.metric = re.sub(r"[^a-zA-Z0-9_:]", "_", options.get("prefix", "") + schema.names[self.at])
        self.type, self.help = options.get("type", "gauge"), options.get("title")

    def head(self) -> str:
        text = f"# HELP {self.metric} {exposition_label(self.help)}\n" if self.help else ""
        return f"{text}# TYPE {self.metric} {self.type}\n"

    def line(self, row) -> str:
        if row[self.at] is None:
            return ""
        labels = ",".join(f'{re.sub(r"[^a-zA-Z0-9_]", "_", n)}="{exposition_label(v)}"' for k, (n, v) in enumerate(zip(self.names, row)) if k != self.at)
        return f"{self.metric}{{{labels}}} {shown(row[self.at])}\n" if labels else f"{self.metric} {shown(row[self.at])}\n"

    def foot(self) -> str:
        return ""


KINDS = {"markdown": Markdown, "latex": Latex, "metrics": Exposition}


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class ReportWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        if "path" not in options:
            raise ValueError("a report needs a path")
        kind = options.get("kind", "markdown")
        if kind not in KINDS:
            raise ValueError(f"unknown kind of report: {kind}")
        self.uri, self.overwrite = options["path"], overwrite
        self.form = KINDS[kind](schema, options)
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _store(self) -> tuple[pafs.FileSystem, str, str]:
        store, path = pafs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri.removeprefix('file:')}")
        return store, path, f"{path.rsplit('/', 1)[0]}/{self.staging}"

    def write(self, iterator: Iterator) -> Part:
        store, _, staging = self._store()
        store.create_dir(staging)
        part = f"{staging}/{uuid.uuid4().hex}"
        rows = 0
        with store.open_output_stream(part) as out:
            for row in iterator:
                out.write(self.form.line(row).encode())
                rows += 1
        return Part(TaskContext.get().partitionId(), part, rows)

    def commit(self, messages: list) -> None:
        store, path, staging = self._store()
        try:
            if not self.overwrite and store.get_file_info(path).type != pafs.FileType.NotFound:
                raise FileExistsError(f"{path} is there already")
            store.create_dir(staging)
            whole = f"{staging}/whole"
            with store.open_output_stream(whole) as out:
                out.write(self.form.head().encode())
                for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                    with store.open_input_stream(part.path) as source:
                        while block := source.read(COPY):
                            out.write(block)
                out.write(self.form.foot().encode())
            if self.overwrite and store.get_file_info(path).type == pafs.FileType.File:
                store.delete_file(path)
            store.move(whole, path)
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        store, _, staging = self._store()
        if store.get_file_info(staging).type == pafs.FileType.Directory:
            store.delete_dir(staging)


class ReportSource(DataSource):
    """Options: path, kind (markdown, latex, metrics), title, and for metrics prefix and type."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(schema, dict(self.options), overwrite)


def write_report(rows: DataFrame, path: str, kind: str = "markdown", **options: str) -> None:
    """One file with the rows in the order of their partitions; what is at path is replaced when all is written."""
    rows.sparkSession.dataSource.register(ReportSource)
    rows.write.format("report").mode("overwrite").options(kind=kind, **options).save(path)


def read_markdown(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a Markdown table without escaped cells, empty cells as null."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    lines = spark.read.text(path).where("value like '| %'")
    cells = F.transform(F.split(F.regexp_extract("value", r"^\| (.*) \|$", 1), r" \| "), lambda x: F.trim(x))
    fields = _parse_datatype_string(schema).fields
    rows = lines.select(cells.alias("c")).where((F.get("c", 0) != F.lit(fields[0].name)) & ~F.get("c", 0).rlike("^-+:?$"))
    return rows.select(*(F.nullif(F.get("c", k), F.lit("")).cast(f.dataType).alias(f.name) for k, f in enumerate(fields)))
