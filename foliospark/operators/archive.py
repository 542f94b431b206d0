"""Archives: members, safety of the whole archive, assets."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import text as X

#: Suffixes of images, and the bits that mark a symbolic link.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")
TYPE_BITS, LINK_BITS = 0o170000, 0o120000


def member_path(name: Column) -> Column:
    return F.replace(name, F.lit("\\"), F.lit("/"))


def is_symlink(external_attr: Column) -> Column:
    return F.shiftrightunsigned(external_attr, 16).bitwiseAND(F.lit(TYPE_BITS).cast("bigint")) == LINK_BITS


def member_is_safe(name: Column, external_attr: Column) -> Column:
    path = member_path(name)
    climbs = F.exists(F.split(path, "/"), lambda p: p == "..")
    return ~(path.startswith("/") | path.rlike("^[A-Za-z]:") | climbs | F.coalesce(is_symlink(external_attr), F.lit(False)))


def archive_safety(members: DataFrame) -> DataFrame:
    """archive, n_members and safe: one bad member makes the archive unsafe as a whole."""
    return members.groupBy("archive").agg(F.count("*").alias("n_members"), F.bool_and(member_is_safe(F.col("name"), F.col("external_attr"))).alias("safe"))


def safe_members(members: DataFrame, strict: bool = False) -> DataFrame:
    """Members of safe archives; with strict an unsafe archive fails the query."""
    judged = archive_safety(members).select("archive", "safe")
    both = members.join(judged, "archive")
    if strict:
        message = F.concat(F.lit("unsafe member in archive "), "archive")
        both = both.withColumn("safe", F.when(F.col("safe"), True).otherwise(F.raise_error(message).cast("boolean")))
    return both.where("safe").drop("safe")


#: Bytes that the members of one archive may have unpacked.
MAX_UNPACKED = 4 << 30
_BROKEN = (zipfile.BadZipFile, zlib.error, RuntimeError, OSError, EOFError, NotImplementedError, ValueError)


def listed(files: DataFrame) -> DataFrame:
    """files(path, content) with members, an array of name, external_attr and size, and error; nothing is unpacked."""
    rest = [f for f in files.schema if f.name not in ("members", "error")]

    def one(content: bytes) -> tuple[list | None, str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return [(i.filename, i.external_attr, i.file_size) for i in z.infolist() if not i.is_dir()], None
        except _BROKEN as error:
            return None, str(error) or type(error).__name__

    def run(batches):
        for batch in batches:
            found = [one(c) for c in batch["content"]]
            yield batch.assign(members=[None if m is None else [dict(zip(("name", "external_attr", "size"), x)) for x in m] for m, _ in found], error=[e for _, e in found])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "members array<struct<name:string,external_attr:bigint,size:bigint>>, error string"])
    return files.select(*[f.name for f in rest]).mapInPandas(run, schema)


def archive_error(members: Column, limit: int = MAX_UNPACKED) -> Column:
    """Why an archive with such members isn't unpacked, or null."""
    safe = F.forall(members, lambda m: member_is_safe(m["name"], m["external_attr"]))
    size = F.aggregate(members, F.lit(0).cast("bigint"), lambda a, m: a + m["size"])
    return F.when(~safe, "unsafe member").when(size > limit, "too large unpacked")


def unpacked(files: DataFrame, limit: int = MAX_UNPACKED) -> DataFrame:
    """archive, name, external_attr, content and error of the members of files(path, content).

    All names are looked at before anything is unpacked. An archive that is broken, unsafe or too large has one row, with an error.
    """
    seen = listed(files.select("path", "content"))
    judged = seen.withColumn("error", F.coalesce("error", archive_error(F.col("members"), limit))).drop("members")
    content = F.when(F.col("error").isNull(), F.col("content"))
    return read_members(judged.withColumn("content", content))


def read_members(files: DataFrame) -> DataFrame:
    """archive, name, external_attr and content of every member of files(path, content) that are ZIPs; broken ones have one row with an error.

    With a column error, archives that have one aren't read.
    """
    known = "error" in files.columns

    def run(batches):
        for batch in batches:
            for path, content, error in zip(batch["path"], batch["content"], batch["error"] if known else [None] * len(batch)):
                rows = [(path, None, None, None, error)]
                try:
                    if error is None:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            rows = [(path, i.filename, i.external_attr, z.read(i), None) for i in z.infolist() if not i.is_dir()]
                except _BROKEN as failure:
                    rows = [(path, None, None, None, str(failure) or type(failure).__name__)]
                yield pd.DataFrame(rows, columns=["archive", "name", "external_attr", "content", "error"]).astype({"external_attr": "Int64"})

    columns = ["path", "content", *(["error"] if known else [])]
    return files.select(*columns).mapInPandas(run, "archive string, name string, external_attr long, content binary, error string")


def result_parts(files: DataFrame, limit: int = MAX_UNPACKED) -> tuple[DataFrame, DataFrame]:
    """Of files(path, content) that are result archives: their texts (path, full_md, error), and their assets (path, relative_path, content).

    An asset's path is relative to the folder of the text; members outside of it aren't assets.
    """
    from .merge import only_text

    members = unpacked(files, limit)
    bad = members.where("error is not null").select(F.col("archive").alias("path"), F.lit(None).cast("string").alias("full_md"), "error")
    good = members.where("error is null")
    texts = only_text(good, ["archive"])
    folder = F.regexp_extract(member_path(F.col("name")), r"^(.*/)?[^/]*$", 1)
    home = good.where(member_path(F.col("name")).rlike(r"(^|/)full[.]md$")).groupBy("archive").agg(F.min(folder).alias("home"))
    inside = good.join(home, "archive").where(member_path(F.col("name")).startswith(F.col("home")) & ~member_path(F.col("name")).rlike(r"(^|/)full[.]md$"))
    assets = inside.select(F.col("archive").alias("path"), F.substr(member_path(F.col("name")), F.char_length("home") + 1).alias("relative_path"), "content")
    return texts.select(F.col("archive").alias("path"), "full_md", "error").unionByName(bad), assets


def used_assets(docs: DataFrame, assets: DataFrame, key: str | list[str], text: str, pattern: str = L.MARKDOWN_LINK) -> DataFrame:
    """Rows of assets(key, relative_path) that a text of the same key links to, each once."""
    keys = [key] if isinstance(key, str) else key
    wanted = docs.select(*keys, F.explode(F.array_distinct(L.linked_assets(F.col(text), pattern))).alias("relative_path")).distinct()
    return assets.join(wanted, [*keys, "relative_path"], "left_semi")


def images(members: DataFrame) -> DataFrame:
    """Members under assets/ that are images, with image_no, from 1 within each archive in the order of their path's parts."""
    found = members.where(F.col("name").rlike("(^|/)assets/") & X.suffix(F.col("name")).isin(*IMAGE_SUFFIXES))
    return found.withColumn("image_no", F.row_number().over(Window.partitionBy("archive").orderBy(F.split("name", "/"))))
