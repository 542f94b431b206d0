"""Secret scans by a trigram inverted index, in DataFrame operations only.

From each rule's regex a Boolean trigram query is derived: an AND over stretches of literal text,
each an OR over the strings the stretch may be, each an AND of trigrams. Posting lists are
kept in blocks of about `BLOCK_ROWS` documents, so a list is bounded whatever the table's size, and
hold the trigrams that some rule asks for. Intersecting and uniting them gives candidates,
whose whole texts are then scanned. A rule without mandatory trigrams scans all texts.

Spans are leftmost and don't overlap within a kind; start and end count code points, end exclusive.
What is matched but too short is dropped, though it has used up its text.

Defined results: a null text counts as empty; without spans the digest is that of the empty
string; rows without an id are scanned fully; rows that repeat an id each get their own result.
Other columns are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK_ROWS = 4096
MAX_BROADCAST_ROWS = 500_000
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    least: int
    ignore_case: bool = False
    #: A regex that any text with a span matches; cheaper than taking the text apart.
    guard: str | None = None
    #: Whether its spans count for base_sha256.
    base: bool = True

    @property
    def regex(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The patterns and least lengths of the three base kinds come first.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, guard=r"[0-9a-f]{24}"),
    # of well-known forms, beyond the base
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, base=False),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, base=False),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, base=False),
    Rule("login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", 0, 0, base=False),
)


# ---------------------------------------------------------------- queries from regexes


def _strings(node) -> set[str] | None:
    """All strings that a part of a regex may match, if they are few."""
    op, value = node
    if op is sre.LITERAL:
        return {chr(value)}
    if op is sre.IN:
        chars: set[str] = set()
        for kind, v in value:
            if kind is sre.LITERAL:
                chars.add(chr(v))
            elif kind is sre.RANGE and v[1] - v[0] < 4:
                chars.update(map(chr, range(v[0], v[1] + 1)))
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is sre.SUBPATTERN:
        return _all_strings(value[-1])
    if op is sre.BRANCH:
        each = [_all_strings(b) for b in value[1]]
        return set().union(*each) if all(e is not None for e in each) else None
    if op is sre.MAX_REPEAT and value[1] == 1 and value[0] == 0:
        one = _all_strings(value[2])
        return None if one is None else one | {""}
    return None


def _all_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> list[set[frozenset[str]]]:
    """An AND of ORs of ANDs of lower-case trigrams that every match contains; [] if there are none."""
    stretches, now = [], {""}
    for node in sre_parser.parse(pattern):
        more = _strings(node)
        if more is None or len(now) * len(more) > MAX_STRINGS:
            stretches.append(now)
            now = {""}
            if more is not None:
                now = more
            elif node[0] in (sre.SUBPATTERN,):
                stretches += [*_stretches_of(node[1][-1])]
        else:
            now = {a + b for a, b in product(now, more)}
    stretches.append(now)
    usable = [{s.lower() for s in x} for x in stretches if all(len(s) >= 3 for s in x)]
    each = [{frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in x} for x in usable]
    return [{a for a in x if not any(b < a for b in x)} for x in each]  # a OR (a AND b) is a


def _stretches_of(nodes):
    now = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(now) * len(more) > MAX_STRINGS:
            yield now
            now = more or {""}
        else:
            now = {a + b for a, b in product(now, more)}
    yield now


# ---------------------------------------------------------------- index


def trigram_index(docs: DataFrame, trigrams: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """block and its posting lists, a map from trigram to ids, over every row of docs(doc_id, text) with an id."""
    rows = docs.where("doc_id is not null")
    blocks = max(1, -(-rows.count() // block_rows))
    low = rows.select("doc_id", F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    each = low.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", F.explode(held).alias("trigram"))
    lists = each.groupBy("block", "trigram").agg(F.collect_set("doc_id").alias("ids"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))


def _evaluated(query: list[set[frozenset[str]]]) -> Column:
    def ids(t: str) -> Column:
        return F.coalesce(F.element_at("lists", F.lit(t)), F.array().cast("array<bigint>"))

    def all_of(trigrams: frozenset[str]) -> Column:
        return reduce(F.array_intersect, map(ids, sorted(trigrams)))

    def any_of(strings: set[frozenset[str]]) -> Column:
        return reduce(F.array_union, map(all_of, sorted(strings, key=sorted)))

    return reduce(F.array_intersect, map(any_of, query))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id and the kinds of rules that its trigrams allow, of the rules that have mandatory trigrams."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for s in q for x in s for t in x})
    index = trigram_index(docs, trigrams, block_rows)
    hits = F.array(*[F.struct(F.lit(kind).alias("kind"), _evaluated(q).alias("ids")) for kind, q in queries.items()])
    each = index.select(F.explode(hits).alias("hit")).select("hit.kind", F.explode("hit.ids").alias("doc_id"))
    return each.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


# ---------------------------------------------------------------- spans


_SPANS = "array<struct<start:bigint,place:int,kind:string,end:bigint>>"


def _matches(rule: Rule, wanted: Column) -> Column:
    """Length of the text before each match, of the match, and of its group; null where it isn't wanted."""
    text, regex = F.col("text"), F.lit(rule.regex)
    gaps = F.split(text, rule.regex, -1)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    valued = F.regexp_extract_all(text, regex, F.lit(rule.group))
    each = F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), F.transform(found, F.char_length).alias("n"), F.transform(valued, F.char_length).alias("v"))
    if rule.guard:
        wanted = wanted & text.rlike(rule.guard)
    return F.when(wanted, each)


def _spans(rule: Rule, order: int, each: Column) -> Column:
    """The rule's spans as an array of (start, order, kind, end), from its matches.

    Arrays are appended to in runs as long as the root of their number, so that a text with very many matches costs their
    number times that root, not its square.
    """
    width = F.ceil(F.sqrt(F.size(each))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(each) / width).cast("int") - 1), lambda r: F.slice(each, r * width + 1, width))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        end = begin + F.coalesce(x["n"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        out = F.when(x["v"] >= rule.least, F.concat(s["out"], F.array(span))).otherwise(s["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    begun = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))

    def moved(s: Column, run: Column) -> Column:
        spans = F.transform(run["out"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), x["place"].alias("place"), x["kind"].alias("kind"), (x["end"] + s["at"]).alias("end")))
        return F.struct((s["at"] + run["at"]).alias("at"), F.concat(s["out"], F.array(spans)).alias("out"))

    found = F.flatten(F.aggregate(F.transform(runs, lambda r: F.aggregate(r, start, step)), begun, moved)["out"])
    return F.when(each.isNotNull(), found).otherwise(F.array().cast(_SPANS))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of every row of docs(doc_id, text).

    Counts are columns n_<kind>, those of rules beyond the base last; base_sha256 is of the base rules' spans alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = cut(candidates(rows, rules, block_rows)).select(F.col("doc_id").alias("found_id"), "kinds")
    few = found.count() <= MAX_BROADCAST_ROWS
    rows = rows.join(F.broadcast(found) if few else found, F.col("doc_id") == F.col("found_id"), "left")
    each = []
    for rule in rules:
        indexed = bool(trigram_query(rule.pattern))
        allowed = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) | F.col("doc_id").isNull()
        each.append(_matches(rule, allowed if indexed else F.lit(True)).alias(f"m_{rule.kind}"))
    rows = rows.select("doc_id", *each)
    rows = rows.select("doc_id", *[_spans(rule, order, F.col(f"m_{rule.kind}")).alias(f"at_{rule.kind}") for order, rule in enumerate(rules)])

    def named(some: list[Rule]) -> Column:
        spans = F.array_sort(F.concat(F.array().cast(_SPANS), *[F.col(f"at_{r.kind}") for r in some]))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base, more = [r for r in rules if r.base], [r for r in rules if not r.base]
    counts = {r.kind: F.size(f"at_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules}
    return rows.select("doc_id", *[counts[r.kind] for r in base], F.sha2(named(base), 256).alias("base_sha256"), named(list(rules)).alias("spans"), *[counts[r.kind] for r in more])
