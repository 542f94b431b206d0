"""Files as DataFrames."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FolioError, PlanError
from ..functions import text as X


def sources(spark: SparkSession, path: str, content: bool = False, recursive: bool = True) -> DataFrame:
    """path, name, suffix, length, modificationTime of files (and content, read only if asked for)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.withColumns({"name": X.base_name(F.col("path")), "suffix": X.suffix(F.col("path"))})
    return files if content else files.drop("content")


def with_sha256(files: DataFrame) -> DataFrame:
    return files.withColumn("source_sha256", F.sha2("content", 256))


#: How a page object of a PDF says what it is, and where streams of objects stand.
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_OBJECTS = re.compile(rb"/Type\s*/ObjStm\b.*?stream\r?\n(.*?)endstream", re.S)


def count_pages(content: bytes) -> int:
    """Pages of a PDF; PlanError where there are none to be read.

    They are counted by a PDF library where one is installed, else by their objects, in plain sight and in deflated object
    streams, which sees none in encrypted files.
    """
    try:
        import pypdf
    except ImportError:
        n = len(_PAGE.findall(content)) if content.startswith(b"%PDF") else 0
        for m in _OBJECTS.finditer(content) if content.startswith(b"%PDF") else ():
            try:
                n += len(_PAGE.findall(zlib.decompressobj().decompress(m[1])))
            except zlib.error:
                continue
    else:
        try:
            n = len(pypdf.PdfReader(io.BytesIO(content)).pages)
        except Exception as error:  # noqa: BLE001  the library has many of its own
            raise PlanError(str(error)) from error
    if not n:
        raise PlanError("no readable pages")
    return n


def page_counts(files: DataFrame, count: Callable[[bytes], int] = count_pages) -> DataFrame:
    """files(path, suffix, content) without content, with page_count and error; Office files have no count.

    Contents go through once: what else is wanted of them (their hash) is a column of files before.
    """
    rest = [f for f in files.schema if f.name not in ("content", "page_count", "error")]

    def one(content: bytes, suffix: str) -> tuple[int | None, str | None]:
        if suffix != ".pdf":
            return None, None
        try:
            return count(content), None
        except Exception as error:  # noqa: BLE001  a bad file is a row with an error
            return None, str(error)

    def run(batches):
        for batch in batches:
            found = [one(c, s) for s, c in zip(batch["suffix"], batch["content"])]
            yield batch[[f.name for f in rest]].assign(page_count=pd.array([n for n, _ in found], "Int32"), error=[e for _, e in found])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "page_count int, error string"])
    return files.select(*[f.name for f in rest], "content").mapInPandas(run, schema)


class Splitter(Protocol):
    """Counts the pages of a file, and cuts a range of them (1-based, inclusive) out as a file of its own."""

    def count(self, content: bytes) -> int: ...

    def cut(self, content: bytes, start: int, end: int) -> bytes: ...


class PdfSplitter:
    """Needs a PDF library on the executors to cut."""

    def count(self, content: bytes) -> int:
        return count_pages(content)

    def cut(self, content: bytes, start: int, end: int) -> bytes:
        try:
            import pypdf
        except ImportError as error:
            raise PlanError("cutting a PDF needs a PDF library") from error
        out = pypdf.PdfWriter()
        pages = pypdf.PdfReader(io.BytesIO(content)).pages
        for k in range(start - 1, end):
            out.add_page(pages[k])
        held = io.BytesIO()
        out.write(held)
        return held.getvalue()


def splits(files: DataFrame, splitter: Splitter, cap: int, target: int) -> DataFrame:
    """path, part_index, page_start, page_end, part_bytes and error of files(path, content, page_count) cut into ranges.

    Each range has cap pages at most, and its file target bytes at most: larger ones are cut in their middle, until a single
    page is still too large, which is an error of the file. The cut files aren't kept: who sends one cuts it again.
    """

    def ranges(content: bytes, n: int) -> list[tuple[int, int, int]]:
        todo, found = [(a, min(a + cap - 1, n)) for a in range(1, n + 1, cap)][::-1], []
        while todo:
            a, b = todo.pop()
            size = len(splitter.cut(content, a, b))
            if size <= target:
                found.append((a, b, size))
            elif a == b:
                raise PlanError(f"page {a} alone is too large")
            else:
                todo += [((a + b) // 2 + 1, b), (a, (a + b) // 2)]
        return found

    def run(batches):
        for batch in batches:
            for path, content, n in zip(batch["path"], batch["content"], batch["page_count"]):
                try:
                    rows = [(path, k, a, b, size, None) for k, (a, b, size) in enumerate(ranges(content, int(n)), 1)]
                except Exception as error:  # noqa: BLE001  a bad file is a row with an error
                    rows = [(path, None, None, None, None, str(error))]
                out = pd.DataFrame(rows, columns=["path", "part_index", "page_start", "page_end", "part_bytes", "error"])
                yield out.astype({c: "Int64" for c in ("part_index", "page_start", "page_end", "part_bytes")})

    return files.select("path", "content", "page_count").mapInPandas(run, "path string, part_index int, page_start int, page_end int, part_bytes long, error string")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and full_md of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("full_md"))


def members_text(members: DataFrame) -> DataFrame:
    """Members' content as stripped UTF-8 text."""
    return members.withColumn("text", X.strip(F.decode("content", "UTF-8")))


def one_job(rows: DataFrame, job_id: str) -> DataFrame:
    """The rows of a job; FolioError if there are none."""
    found = rows.where(F.col("job_id") == job_id)
    if found.isEmpty():
        raise FolioError(f"no such job: {job_id}")
    return found
