"""Links in Markdown and HTML: finding, taking apart, and rewriting those whose target is a known asset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a link; before, target, and after are groups 1 to 3.
MARKDOWN_LINK = r"(!?\[[^\]]*\]\()([^)\s]+)((?:\s+[^)]*)?\))"
HTML_LINK = r"""(?i)(\b(?:src|href)\s*=\s*['"])([^'"]+)(['"])"""
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_parts(url: Column) -> Column:
    """scheme, netloc, path, query, fragment; empty where absent."""
    return F.struct(*[F.regexp_extract(url, f"(?s){_URL}", i + 1).alias(n) for i, n in enumerate(("scheme", "netloc", "path", "query", "fragment"))])


def bare_target(target: Column) -> Column:
    return F.regexp_replace(target, "^[<>]+|[<>]+$", "")


def unquoted(path: Column) -> Column:
    """Percent-decoded; a plus stays one, and what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def link_kind(target: Column) -> Column:
    """remote, rooted, anchor, data or relative."""
    bare = bare_target(target)
    parts = url_parts(bare)
    return (
        F.when(F.lower(bare).startswith("data:"), "data")
        .when(bare.startswith("#"), "anchor")
        .when((parts["scheme"] != "") | (parts["netloc"] != ""), "remote")
        .when(bare.startswith("/"), "rooted")
        .otherwise("relative")
    )


def normal_path(path: Column) -> Column:
    """Relative path with . taken out and .. taken back; null if it leaves its root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    state = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))

    def step(s: Column, p: Column) -> Column:
        up = p == ".."
        return F.struct(
            F.when(up, F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0)))).otherwise(F.concat(s["at"], F.array(p))).alias("at"),
            (s["inside"] & ~(up & (F.size(s["at"]) == 0))).alias("inside"),
        )

    return F.aggregate(parts, state, step, lambda s: F.when(s["inside"], F.array_join(s["at"], "/")))


def linked_assets(text: Column, pattern: str) -> Column:
    """Decoded, normalised paths of a text's relative links."""
    targets = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda t: link_kind(t) == "relative")
    return F.filter(F.transform(targets, lambda t: normal_path(unquoted(url_parts(bare_target(t))["path"]))), lambda p: p.isNotNull() & (p != ""))


def _rewritten(text: Column, pattern: str, assets: Column, folder: Column) -> Column:
    gaps = F.split(text, pattern, -1)
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in range(1, 4)]

    def target(t: Column) -> Column:
        parts = url_parts(bare_target(t))
        path = normal_path(unquoted(parts["path"]))
        query = F.when(parts["query"] != "", F.concat(F.lit("?"), parts["query"])).otherwise("")
        fragment = F.when(parts["fragment"] != "", F.concat(F.lit("#"), parts["fragment"])).otherwise("")
        known = (link_kind(t) == "relative") & F.coalesce(F.array_contains(assets, path), F.lit(False))
        return F.when(known, F.concat(folder, F.lit("/"), path, query, fragment)).otherwise(t)

    whole = F.arrays_zip(gaps.alias("gap"), *[f.alias(n) for f, n in zip(found, "abc")])
    pieces = F.transform(whole, lambda x: F.concat(x["gap"], F.coalesce(F.concat(x["a"], target(x["b"]), x["c"]), F.lit(""))))
    return F.array_join(pieces, "")


def rewrite_links(text: Column, assets: Column, part_index: Column) -> Column:
    """text with links to its assets (an array of relative paths) led to the part's own folder: Markdown first, then HTML."""
    folder = F.format_string("assets/part-%04d", part_index)
    assets = F.coalesce(assets, F.array().cast("array<string>"))
    return _rewritten(_rewritten(text, MARKDOWN_LINK, assets, folder), HTML_LINK, assets, folder)
