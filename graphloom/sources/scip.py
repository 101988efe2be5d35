"""Decoding of code-intelligence indexes: protobuf wire format to entities and reference edges.

Only the fields read here are decoded: documents (2) with a relative path (1) and occurrences (2), and of those the
packed range (1), symbol (2) and roles (3; bit 1 marks a definition)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import entity_id
from ..operators.joins import containing
from ..plans.lineage import materialise

OCCURRENCES = "relative_path string, symbol string, line int, end_line int, definition boolean"


def varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[at]
        at += 1
        value |= (x & 0x7F) << shift
        if x < 0x80:
            return value, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message; fixed-width fields are skipped over."""
    at, end = 0, len(b)
    while at < end:
        key = b[at]
        key, at = (key, at + 1) if key < 0x80 else varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(b, at)
            yield key >> 3, value
        elif kind == 2:
            n = b[at] if at < end else 0x80
            n, at = (n, at + 1) if n < 0x80 else varint(b, at)
            yield key >> 3, b[at : at + n]
            at += n
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind}")


@lru_cache(1 << 16)
def occurrence(occ: bytes) -> tuple[str, int, int, bool]:
    """(symbol, first line, last line, definition), lines from 1 and 0 where there is no range.  Equal ones are frequent:
    the same symbol on the same line of many files."""
    span, symbol, roles = [], "", 0
    for n, v in fields(occ):
        if n == 1:
            at = 0
            while isinstance(v, bytes) and at < len(v):
                x, at = varint(v, at)
                span.append(x)
            if isinstance(v, int):
                span.append(v)
        elif n == 2:
            symbol = v.decode()
        elif n == 3:
            roles = v
    return symbol, span[0] + 1 if span else 0, (span[2] if len(span) > 3 else span[0]) + 1 if span else 0, bool(roles & 1)


def occurrences(index: bytes) -> Iterator[tuple[str, str, int, int, bool]]:
    """(path, symbol, first line, last line, definition), lines from 1; local symbols are left out."""
    for number, doc in fields(index):
        if number != 2:
            continue
        path, found = "", []
        for n, v in fields(doc):
            if n == 1:
                path = v.decode()
            elif n == 2:
                found.append(v)
        for occ in found:
            symbol, first, last, definition = occurrence(occ)
            if path and symbol and first and not symbol.startswith("local "):
                yield path, symbol, first, last, definition


def read_occurrences(files: DataFrame) -> DataFrame:
    """Occurrences of index files (content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p["content"]:
                yield pd.DataFrame(list(occurrences(bytes(content))), columns=[x.split()[0] for x in OCCURRENCES.split(", ")])

    return files.select("content").mapInPandas(run, OCCURRENCES)


def symbol_parts(symbol):
    """(kind, name) of the last descriptor of a symbol: name() or name(). methods, name# types, name. terms."""
    last = F.regexp_extract(symbol, r"([\w$<>`-]+(?:\(\)\.|\([^)]*\)\.|#|\.|/))$", 1)
    name = F.regexp_replace(F.regexp_extract(last, r"^`?([\w$<>-]+)`?", 1), "`", "")
    kind = F.when(last.rlike(r"\(.*\)\.$"), F.when(symbol.rlike(r"#[^#]*\)\.$"), "method").otherwise("function")).when(F.endswith(last, F.lit("#")), "class").when(F.endswith(last, F.lit(".")), "variable").otherwise("module")
    return kind, name


def decode(files: DataFrame, repo: str, packages: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of index files.  A reference leads from the entity that starts last at or before its line to
    the symbol's definition: a call for functions and methods, else a reference."""
    return linked(read_occurrences(files), repo, packages)


def linked(occ: DataFrame, repo: str, packages: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``decode`` of occurrences that are read already."""
    if packages:
        occ = occ.where(F.col("symbol").rlike("(?:^| )(?:" + "|".join(map(re.escape, packages)) + ") "))
    kind, name = symbol_parts(F.col("symbol"))
    occ = occ.withColumn("kind", kind).withColumn("name", name).where((F.col("kind") != "module") & (F.col("name") != ""))
    occ = materialise(occ, "occurrences")  # read and decoded once
    defs = occ.where("definition").withColumn("key", entity_id(F.lit(repo), F.col("relative_path"), F.col("kind"), F.col("name"), F.col("symbol")))
    ents = defs.groupBy("key", "kind", "name", F.col("relative_path").alias("file_path"), "symbol").agg(F.min("line").alias("start_line"), F.max("end_line").alias("end_line"))
    ents = materialise(ents, "defined")
    number = ents.withColumn("id", F.xxhash64("key"))
    refs = occ.where("not definition").select(F.col("relative_path").alias("file_path"), "symbol", "line", F.col("kind").alias("target_kind"))
    placed = containing(refs, number.select("file_path", "id", "start_line"), ["file_path"]).where("entity_id is not null")
    a = placed.join(number.select(F.col("id").alias("entity_id"), F.col("key").alias("src")), "entity_id")
    e = a.join(number.select("symbol", F.col("key").alias("dst")), "symbol").where("src <> dst")
    k = F.when(F.col("target_kind").isin("function", "method"), "calls").otherwise("references")
    return ents.select(F.col("key").alias("id"), "kind", "name", "file_path", "start_line", "end_line"), e.select("src", "dst", k.alias("kind")).distinct()
