"""Package roots of a workspace, pattern catalogs, and structural search by regular expression."""

from __future__ import annotations

import glob
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _globbed(root: str, patterns: list[str], marker: tuple[str, ...]) -> list[str]:
    keep, drop = [p for p in patterns if not p.startswith("!")], [p[1:] for p in patterns if p.startswith("!")]
    found = {os.path.relpath(d, root) for p in keep for d in glob.glob(os.path.join(root, p)) if any(os.path.exists(os.path.join(d, m)) for m in marker)}
    return sorted(found - {os.path.relpath(d, root) for p in drop for d in glob.glob(os.path.join(root, p))})


def _read(root: str, name: str) -> str | None:
    try:
        with open(os.path.join(root, name), encoding="utf-8") as f:
            return f.read()
    except OSError:
        return None


def package_roots(root: str) -> tuple[str, list[str]]:
    """(type, roots) of a checked-out workspace on the driver: pnpm, nx, lerna, yarn or npm, maven, gradle, single."""
    npm = ("package.json",)
    if (t := _read(root, "pnpm-workspace.yaml")) is not None:
        pats = re.findall(r"^\s*-\s*['\"]?([^'\"\n#]+?)['\"]?\s*$", t, re.M)
        if roots := _globbed(root, pats, npm):
            return "pnpm", [".", *[r for r in roots if r != "."]]
    if _read(root, "nx.json") is not None and (roots := _globbed(root, ["apps/*", "libs/*", "packages/*"], ("package.json", "project.json"))):
        return "nx", roots
    for name, key in (("lerna.json", "packages"), ("package.json", "workspaces")):
        if (t := _read(root, name)) is not None:
            try:
                pats = json.loads(t).get(key)
            except ValueError:
                pats = None
            pats = pats.get("packages") if isinstance(pats, dict) else pats
            if pats and (roots := _globbed(root, pats, npm)):
                kind = "lerna" if name == "lerna.json" else "yarn" if _read(root, "yarn.lock") is not None else "npm"
                return kind, roots
    if (t := _read(root, "pom.xml")) is not None and (mods := re.findall(r"<module>\s*([^<]+?)\s*</module>", t)):
        return "maven", sorted(m for m in mods if os.path.isdir(os.path.join(root, m)))
    for name in ("settings.gradle.kts", "settings.gradle"):
        if (t := _read(root, name)) is not None:
            mods = [m.strip(":").replace(":", "/") for line in re.findall(r"include\s*\(?([^)\n]*)", t) for m in re.findall(r"['\"]([^'\"]+)['\"]", line)]
            if mods := sorted(m for m in mods if os.path.isdir(os.path.join(root, m))):
                return "gradle", mods
    return "single", ["."]


CATALOG = "id string, name string, language string, regex string, severity string"


def load_catalog(spark: SparkSession, text: str) -> DataFrame:
    """A pattern catalog as a small table: a list of entries, as JSON or as YAML of that shape (``key: value`` lines)."""
    try:
        entries = json.loads(text)
    except ValueError:
        entries = []
        for chunk in re.split(r"(?m)^\s*-\s+(?=\w+:)", text)[1:]:
            pairs = re.findall(r"(?m)^\s*(\w+):\s*(.*?)\s*$", chunk)
            entries.append({k: re.sub(r"^(['\"])(.*)\1$", r"\2", v) for k, v in pairs})
    names = [x.split()[0] for x in CATALOG.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], CATALOG)


def scan_patterns(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Matches of a catalog's patterns in files (path, language, text): (pattern, path, line, severity).

    The catalog is small by its nature and is broadcast as one array; lines are tried against their language's entries."""
    rules = F.broadcast(catalog.agg(F.collect_list(F.struct("id", "language", "regex", "severity")).alias("rules")))
    lines = files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("n", "line")).join(rules, how="inner")
    hits = F.filter("rules", lambda r: (r["language"].isNull() | (r["language"] == F.col("language"))) & F.rlike(F.col("line"), r["regex"]))
    return lines.select("path", "n", F.explode(hits).alias("r")).select(F.col("r.id").alias("pattern"), "path", (F.col("n") + 1).alias("line"), "r.severity")


def naming_violations(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Entities whose name does not fit a naming rule (id, kind, regex) for their kind."""
    r = F.broadcast(rules.select(F.col("id").alias("rule"), F.col("kind").alias("r_kind"), "regex"))  # a rule set, by hand
    return entities.join(r, F.col("kind") == F.col("r_kind")).where(~F.rlike(F.col("name"), F.col("regex"))).select("rule", "id", "name")
