"""Filing archives as a data source: one partition for each member, streamed in batches, filters applied before rows leave the reader."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import sys
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

# Columns of a statement file; those that every file must have.
COLUMNS = ("CNPJ_CIA", "CD_CVM", "DENOM_CIA", "DT_REFER", "VERSAO", "ORDEM_EXERC", "DT_INI_EXERC", "DT_FIM_EXERC", "CD_CONTA", "DS_CONTA", "VL_CONTA", "ST_CONTA_FIXA", "ESCALA_MOEDA", "MOEDA", "GRUPO_DFP", "COLUNA_DF")
REQUIRED = ("CNPJ_CIA", "CD_CVM", "DENOM_CIA", "DT_REFER", "VERSAO", "ORDEM_EXERC", "CD_CONTA", "DS_CONTA", "VL_CONTA")
SCOPES = ("con", "ind")

SCHEMA = "path string, member string, scope string, year int, line_no long, " + ", ".join(f"{c} string" for c in COLUMNS) + ", error string"
_ARROW = pa.schema([("path", pa.string()), ("member", pa.string()), ("scope", pa.string()), ("year", pa.int32()), ("line_no", pa.int64()), *[(c, pa.string()) for c in COLUMNS], ("error", pa.string())])
#: Columns that are known before a member is opened.
_NAMED = ("path", "member", "scope", "year")
#: Rows in a batch that leaves the reader, and bytes read at once to check a member.
BATCH, CHUNK = 8192, 1 << 20


class Member(InputPartition):
    """One member of an archive, or what is wrong with the archive."""

    def __init__(self, path: str, member: str | None, error: str | None):
        super().__init__(path)
        self.path, self.member, self.error = path, member, error

    def named(self) -> dict[str, object]:
        """Scope and year by the names: ``_con_`` or ``_ind_`` before the last year 19xx or 20xx of the member."""
        stem = (self.member or "").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        years = re.findall(r"(?<!\d)(?:19|20)\d{2}(?!\d)", stem)
        scope = next((s for s in SCOPES if s in stem.split("_")), None)
        return {"path": self.path, "member": self.member, "scope": scope, "year": int(years[-1]) if years else None}


def _open(path: str):
    """A seekable stream of a local or remote file; only the bytes that are asked for are read."""
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def _list(pattern: str) -> list[str]:
    """Files of a folder whose names match the last part of the pattern (``*`` and ``?``)."""
    folder, name = posixpath.split(pattern)
    fits = re.compile(re.escape(name).replace(r"\*", ".*").replace(r"\?", ".") + r"\Z")
    system, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    infos = system.get_file_info(fs.FileSelector(inner))
    return sorted(posixpath.join(folder, i.base_name) for i in infos if i.type == fs.FileType.File and fits.match(i.base_name))


class FilingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pattern = options["path"]
        self.members = options.get("members", r"\.csv\Z")
        self.expected = [e for e in options.get("expected", "").split(",") if e]
        self.least = int(options.get("leastBytes", "1024"))
        self.wanted: dict[str, set[object]] = {}

    def pushFilters(self, filters):  # noqa: N802 - the name is Spark's
        """Equality and membership of statement columns, scope and year are applied here; Spark keeps the others."""
        usable = {*COLUMNS, *_NAMED} - {"path"}
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name in usable:
                values -= {None}
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def _keeps(self, part: Member) -> bool:
        named = part.named()
        return all(named[n] in self.wanted[n] for n in _NAMED if n in self.wanted)

    def partitions(self) -> list[Member]:
        """Central directories are read here (names and sizes only), as a listing of files would be; members that no filter wants go."""
        found = [p for path in _list(self.pattern) for p in self._members(path)]
        return [p for p in found if self._keeps(p)] or [Member(self.pattern, None, "nothing")]

    def _members(self, path: str) -> list[Member]:
        with _open(path) as f:
            if f.size() < self.least:
                return [Member(path, None, "too_small")]
            try:
                with zipfile.ZipFile(f) as z:
                    names = z.namelist()
            except zipfile.BadZipFile:
                return [Member(path, None, "not_a_zip")]
        years = re.findall(r"(?<!\d)(?:19|20)\d{2}(?!\d)", path.rsplit("/", 1)[-1])
        wanted = {e.replace("{year}", years[-1] if years else "") for e in self.expected}
        mine = [n for n in names if re.search(self.members, n)]
        return [Member(path, n, None) for n in mine] if mine and wanted <= set(names) else [Member(path, None, "members_missing")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition.error == "nothing":
            return
        named = partition.named()
        error = partition.error or self._damage(partition)
        if error is None:
            with _open(partition.path) as f, zipfile.ZipFile(f) as z, z.open(partition.member) as raw:
                lines = csv.reader(io.TextIOWrapper(io.BufferedReader(raw), "iso-8859-1", newline=""), delimiter=";")
                head = next(lines, [])
                missing = [c for c in REQUIRED if c not in head]
                if not missing:
                    yield from self._batches(named, head, lines)
                    return
            error = "columns_missing: " + ", ".join(missing)
        if not any(c in self.wanted for c in COLUMNS):
            yield pa.RecordBatch.from_pylist([named | {"error": error}], schema=_ARROW)

    def _damage(self, partition: Member) -> str | None:
        """A member is read once to its end, where its checksum is compared, before any row of it is given out."""
        try:
            with _open(partition.path) as f, zipfile.ZipFile(f) as z, z.open(partition.member) as raw:
                while raw.read(CHUNK):
                    pass
        except (zipfile.BadZipFile, zlib.error, EOFError):
            return "bad_checksum"
        return None

    def _batches(self, named: dict[str, object], head: list[str], lines) -> Iterator[pa.RecordBatch]:
        at = {c: head.index(c) for c in COLUMNS if c in head}
        tests = [(at.get(c), values) for c, values in self.wanted.items() if c in COLUMNS]
        rows: list[list[str]] = []
        numbers: list[int] = []

        def batch() -> pa.RecordBatch:
            n = len(rows)
            cells = [pa.array([r[at[c]] or None for r in rows] if c in at else [None] * n, pa.string()) for c in COLUMNS]
            fixed = [pa.array([named[k]] * n, _ARROW.field(k).type) for k in _NAMED]
            return pa.RecordBatch.from_arrays([*fixed, pa.array(numbers, pa.int64()), *cells, pa.nulls(n, pa.string())], schema=_ARROW)

        for number, row in enumerate(lines, 1):
            if not row:
                continue
            row += [""] * (len(head) - len(row))
            if all(i is not None and row[i] in values for i, values in tests):
                rows.append(row)
                numbers.append(number)
                if len(rows) == BATCH:
                    yield batch()
                    rows, numbers = [], []
        if rows:
            yield batch()


class FilingArchives(DataSource):
    """``spark.read.format("filing_archives")``; options members (pattern), expected (names by comma), leastBytes."""

    @classmethod
    def name(cls) -> str:
        return "filing_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilingReader:
        return FilingReader(dict(self.options))


def read_filing_archives(spark: SparkSession, path: str, members: str = r"\.csv\Z", expected: tuple[str, ...] = (), least_bytes: int = 1024) -> DataFrame:
    """Rows of the statement files in ZIP archives, all columns as strings, with path, member, scope, year, line_no and error.

    ``path`` is a folder and a file name with ``*`` or ``?``, local or of any file system that Arrow opens. Every member is one
    partition and is streamed: a task holds one batch of rows, whatever the member's size. Equality and ``IN`` on columns of
    statements, scope, year or member are applied in the reader (by scope, year and member before anything is opened).

    One row with an error and without cells stands for an archive that is too small, no ZIP or lacks matching or ``expected``
    members (``{year}`` is the last year in the archive's name), and for a member with a failing checksum or without a
    required column; a filter on a column of statements leaves such rows out, as it would in SQL. Empty cells are null, short
    lines are filled with nulls, columns that statements do not have go, no matching file gives no row, repeated lines stay.
    Unlike ``expand_filing_archives``, a damaged member does not take the others of its archive with it.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilingArchives)
    return spark.read.format("filing_archives").options(members=members, expected=",".join(expected), leastBytes=least_bytes).load(path)
