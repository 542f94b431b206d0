"""Scalar functions on names and texts, as Column expressions without Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an image of each suffix is, and what any other is taken for.
MIME = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp"}
DEFAULT_MIME = "image/jpeg"
#: The length a prompt's text is cut to, and what is put after it.
TEXT_LIMIT, CUT_MARK = 80_000, "\n\n[…truncated…]"


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def suffix(name: Column) -> Column:
    """The last suffix in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(name), r"^.+?(\.[^.]*)$", 1))


def safe_stem(name: Column, limit: int = 70) -> Column:
    """The name without its suffix, in ASCII letters, digits, and _ . - alone."""
    stem = F.regexp_replace(base_name(name), r"(?<=.)\.[^.]+$", "")
    plain = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_.-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, limit), F.lit("")), F.lit("document"))


def page_tag(start: Column, end: Column) -> Column:
    return F.format_string("p%04d-%04d", start, end)


def part_data_id(job_id: Column, index: Column, start: Column, end: Column) -> Column:
    ranged = (F.coalesce(start, F.lit(0)) != 0) & (F.coalesce(end, F.lit(0)) != 0)
    return F.concat(job_id, F.lit("."), F.when(ranged, page_tag(start, end)).otherwise(F.format_string("part-%04d", index)))


def part_file_name(name: Column, start: Column, end: Column) -> Column:
    """The name of a file that holds a range of pages."""
    return F.concat(safe_stem(name), F.lit("."), page_tag(start, end), F.lit(".pdf"))


def job_id(path: Column, sha256: Column) -> Column:
    """Stable: the same source is the same job."""
    return F.substring(F.sha2(F.concat_ws("\n", path, sha256), 256), 1, 32)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def strip_fences(text: Column) -> Column:
    """What stands in a fence of three backticks around the whole text, else the text, stripped."""
    bare = strip(text)
    inside = F.regexp_extract(bare, r"(?sU)^```(?:json)?\s*+(.*?)\s*```$", 1)
    return F.when(bare.rlike(r"(?sU)^```(?:json)?\s*+(.*?)\s*```$"), inside).otherwise(bare)


def _whole_json(text: Column) -> Column:
    """The text as a variant, null if more than one value stands in it: the parser alone overlooks what follows the first."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    closed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(alone & closed, F.try_variant_get(listed, "$[0]", "variant"))


def tolerant_json(text: Column) -> Column:
    """A variant: the text, or what reaches from its first brace to its last; null if neither is JSON."""
    body = strip_fences(text)
    return F.coalesce(_whole_json(body), _whole_json(F.regexp_extract(body, r"(?s)\{.*\}", 0)))


def chat_content(reply: Column) -> Column:
    """The message of a chat reply (JSON text): a string, or the texts of a list one after the other; else null."""
    path = "$.choices[0].message.content"
    parsed = F.try_parse_json(reply)
    plain = F.try_variant_get(parsed, path, "string")
    listed = F.try_variant_get(parsed, path, "array<variant>")
    texts = F.transform(listed, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")))
    return F.when(listed.isNotNull(), F.array_join(texts, "")).otherwise(F.when(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING", plain))


def escape_pipe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def render_tags(tags: Column) -> Column:
    """Tags as `#tag`, blank ones dropped, joined by a space."""
    full = F.filter(tags, lambda t: strip(t) != "")
    return F.array_join(F.transform(full, lambda t: F.concat(F.lit("`#"), strip(F.regexp_replace(t, "^#+", "")), F.lit("`"))), " ")


def quoted(text: Column) -> Column:
    """Each line behind "> "."""
    return F.regexp_replace(text, r"(?m)^", "> ")


def mime_of(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix(name)), F.lit(DEFAULT_MIME))


def base64_of(content: Column) -> Column:
    """Base64 on one line, whatever the session says of chunks."""
    return F.regexp_replace(F.base64(content), "[\r\n]+", "")


def data_url(name: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_of(name), F.lit(";base64,"), base64_of(content))


def truncated(text: Column, limit: int = TEXT_LIMIT) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(CUT_MARK))).otherwise(text)


def toml_string(text: Column) -> Column:
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def retry_delay(attempt: Column, cap: int, retry_after: Column | None = None) -> Column:
    """Seconds to wait after the attempt (from 0): what the server says in digits, else a power of two; without jitter."""
    own = F.least(F.pow(F.lit(2.0), attempt), F.lit(float(cap)))
    return own if retry_after is None else F.when(retry_after.rlike("^[0-9]+$"), retry_after.cast("double")).otherwise(own)


def prompt(template: str, text: Column, limit: int = TEXT_LIMIT) -> Column:
    """The template with {markdown} in it taken literally."""
    return F.replace(F.lit(template), F.lit("{markdown}"), truncated(strip(text), limit))
