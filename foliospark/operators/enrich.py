"""Metadata of a document rendered under its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

HEADINGS = {"title": "Document metadata", "sections": "Sections", "entities": "Entities and terms", "cross_references": "Cross references", "tags": "Tags", "images": "Images"}


def _cell(value: Column) -> Column:
    return X.escape_pipe(X.strip(F.coalesce(value, F.lit(""))))


def _table(title: str, heads: list[str], rows: Column, fields: list[str]) -> Column:
    head = f"> ### {title}\n>\n> | {' | '.join(heads)} |\n> | {' | '.join(['----'] * len(heads))} |\n"
    lines = F.transform(rows, lambda r: F.concat(F.lit("> | "), F.concat_ws(" | ", *[_cell(r[f]) for f in fields]), F.lit(" |\n")))
    return F.when(F.size(rows) > 0, F.concat(F.lit(head), F.array_join(lines, ""), F.lit(">\n"))).otherwise("")


def metadata_block(text: Column, semantics: Column, images_json: Column, headings: dict[str, str] = HEADINGS) -> Column:
    """The text and under it a quoted block: sections, entities, references, tags, images; empty ones left out.

    semantics has the fields of schema.TEXT_SEMANTICS; images_json is the pretty JSON of a list, or null.
    """
    h = headings
    parts = [X.rstrip(text), F.lit(f"\n\n---\n\n> ## {h['title']}\n>\n")]
    parts.append(_table(h["sections"], ["Section", "Summary"], semantics["sections"], ["title", "summary"]))
    parts.append(_table(h["entities"], ["Name", "Type", "Description"], semantics["entities"], ["name", "type", "description"]))
    full = F.filter(semantics["cross_references"], lambda r: X.strip(r) != "")
    lines = F.array_join(F.transform(full, lambda r: F.concat(F.lit("> - "), X.strip(r), F.lit("\n"))), "")
    parts.append(F.when(F.size(semantics["cross_references"]) > 0, F.concat(F.lit(f"> ### {h['cross_references']}\n>\n"), lines, F.lit(">\n"))).otherwise(""))
    tags = F.concat(F.lit(f"> ### {h['tags']}\n>\n> "), X.render_tags(semantics["tags"]), F.lit("\n>\n"))
    parts.append(F.when(F.size(semantics["tags"]) > 0, tags).otherwise(""))
    shown = F.concat(F.lit(f"> ### {h['images']}\n>\n> ````json\n"), X.quoted(images_json), F.lit("\n> ````\n"))
    parts.append(F.when(images_json.isNotNull(), shown).otherwise(""))
    return F.concat(X.rstrip(F.concat(*[F.coalesce(p, F.lit("")) for p in parts])), F.lit("\n"))


IMAGE_FIELDS = {"type": "string", "summary": "string", "elements": "array<string>", "key_findings": "array<string>", "keywords": "array<string>"}


def image_semantics(answers: DataFrame, key: str) -> DataFrame:
    """key, file, the fields of schema.IMAGE_SEMANTICS and error of answers(key, file, answer, error_message)."""
    value = X.tolerant_json(F.col("answer"))
    fields = [F.try_variant_get(value, f"$.{name}", kind).alias(name) for name, kind in IMAGE_FIELDS.items()]
    return answers.select(key, "file", *fields, F.coalesce("error_message", F.when(value.isNull(), "the answer is no JSON")).alias("error"))


def image_outcomes(images: DataFrame, key: str) -> DataFrame:
    """key, n_ok, n_failed and images_json of images(key, file, error and fields): a failure is a row like any other."""
    fields = [c for c in images.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct("file", *[F.col(c) for c in fields if c != "file"])))
    out = images.groupBy(key).agg(F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), rows.alias("rows"))
    return out.select(key, "n_ok", "n_failed", F.to_json("rows", {"pretty": "true"}).alias("images_json"))


def enhance(docs: DataFrame, semantics: DataFrame, images: DataFrame, key: str = "job_id") -> DataFrame:
    """key, enhanced_md and enhance_error of docs(key, full_md): texts and images are two branches joined by key.

    semantics(key, semantics, error): a text that couldn't be analysed leaves its document without enhanced_md.
    """
    both = docs.join(semantics, key, "left").join(image_outcomes(images, key), key, "left")
    error = F.when(F.coalesce(F.col("full_md"), F.lit("")) == "", "no text").otherwise(F.col("error"))
    block = metadata_block(F.col("full_md"), F.col("semantics"), F.col("images_json"))
    return both.select(key, F.when(error.isNull(), block).alias("enhanced_md"), error.alias("enhance_error"))
