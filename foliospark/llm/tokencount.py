"""Token counts by section: documents are encoded once, token spans joined to section spans.

Each text goes through the byte-level tokenizer whole. Token lengths in bytes become spans of characters (a
token that begins inside a character begins at that character). Spans of tokens and of sections are
both sorted, so the interval join is one search for each token. A token that reaches beyond its section is
counted by the rule: "start" gives it to the section of its first character, "end" to that of its last.
Tokens in no section are counted apart.

Sections may be given as a column; by default they are the lines, each with its line feed.

Defined results: null and empty texts have no tokens; null or empty lists of sections leave all tokens outside;
sections are taken in order of their starts and mustn't overlap; rows that repeat an id each get their own
result. Other columns are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, list_array, tidied

RULES = ("start", "end")
_ENCODERS: dict = {}


def encoder(ranks: str | None = None):
    """The tokenizer and the bytes of each of its tokens, one for each worker."""
    if ranks not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            lengths[rank] = len(token)
        _ENCODERS[ranks] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), lengths
    return _ENCODERS[ranks]


def token_spans(text: str, ranks: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, first characters and ends (exclusive) of the tokens."""
    tokenizer, lengths = encoder(ranks)
    ids = np.array(tokenizer.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if len(ids) and ends[-1] != len(text):  # else every character is one byte
        begins = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        char = np.cumsum(begins) - 1
        return ids, char[starts], char[ends - 1] + 1
    return ids, starts, ends


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, int, int]:
    """Tokens of each section, tokens outside, and tokens that reach beyond their section."""
    if not len(lo):
        return np.zeros(0, np.int64), len(starts), 0
    at = starts if rule == "start" else ends - 1
    k = np.searchsorted(lo, at, "right") - 1
    held = (k >= 0) & (at < hi[np.maximum(k, 0)])
    k, a, b = k[held], starts[held], ends[held]
    crossing = int(((a < lo[k]) | (b > hi[k])).sum())
    return np.bincount(k, minlength=len(lo)), int((~held).sum()), crossing


def _lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in text.split("\n")], np.int64) + 1
    n[-1] -= 1
    n = n[n > 0]
    hi = np.cumsum(n)
    return hi - n, hi


def _counter(rule: str, ranks: str | None, given: bool):
    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            sections = batch.column(2).to_pylist() if given else None
            rows: list[tuple] = []
            flat, sizes = [np.zeros(0, np.int64)], []
            for k, text in enumerate(texts):
                if given:
                    spans = sorted((s["start"], s["end"]) for s in sections[k] or () if s and None not in s.values())
                    lo, hi = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
                else:
                    lo, hi = _lines(text)
                ids, starts, ends = token_spans(text, ranks)
                n, outside, crossing = attribute(starts, ends, lo, hi, rule)
                rows.append((len(ids), outside, crossing))
                flat.append(n)
                sizes.append(len(n))
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, list_array(np.concatenate(flat), np.array(sizes), pa.int64())], ["doc_id", "n_tokens", "n_outside", "n_crossing", "section_tokens"])

    return run


def count_tokens(docs: DataFrame, sections: str | None = None, rule: str = "start", ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_outside, n_crossing and section_tokens of every row of docs(doc_id, text).

    sections names a column array<struct<start, end>> of character spans.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    bounded_batches(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if sections:
        columns.append(F.col(sections).cast("array<struct<start:bigint,end:bigint>>").alias("sections"))
    rows = docs.select(*columns)
    return rows.mapInArrow(tidied(_counter(rule, ranks, bool(sections))), "doc_id long, n_tokens long, n_outside long, n_crossing long, section_tokens array<long>")
