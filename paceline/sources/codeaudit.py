"""Audits of training code that uses this library: files are parsed where they lie, and rules ask for what they import and
call, not for how it is spelt."""

from __future__ import annotations

import ast
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "file string, kind string, value string"

#: Rules over facts: the kind of a fact, and a regular expression for all of its value.
RULES = {
    "imports": ("import", r"paceline(\..*)?"),
    "plans": ("call", r"planner\.plan|(.*\.)?plan_(ranks|stream)"),
    "checks_coverage": ("call", r"(.*\.)?(coverage|against_source)"),
    "brings_home": ("call", r"(.*\.)?(collect|toPandas)"),
    "pads": ("call", r"emit\.pad"),
    "measures_padding": ("call", r"emit\.padding"),
    "not_python": ("unparsed", r".*"),
}

#: What a reader of the code should look into: rules that a file meets, rules that it doesn't, and the advice.
ADVICE = [
    (("plans",), ("checks_coverage",), "samples that the plan drops are never counted: look at its coverage"),
    (("plans", "brings_home"), (), "a plan has a row for each sample: write it instead of bringing it to the driver"),
    (("pads",), ("measures_padding",), "groups are padded, but the share of padding isn't measured"),
    (("imports",), ("plans", "pads", "checks_coverage"), "the library is imported, but not used"),
]


def code_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of all Python files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(path)
    return files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))


def facts_of(text: str | None) -> set[tuple[str, str]]:
    """(kind, value) of one file: modules and names that it imports, dotted names that it calls, or that it is no Python."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {("unparsed", "")}
    out = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out |= {("import", x.name) for x in node.names}
        elif isinstance(node, ast.ImportFrom):
            out |= {("import", f"{node.module or '.'}.{x.name}") for x in node.names}
        elif isinstance(node, ast.Call):
            parts, at = [], node.func
            while isinstance(at, ast.Attribute):
                parts, at = [at.attr, *parts], at.value
            out.add(("call", ".".join([at.id, *parts] if isinstance(at, ast.Name) else parts)))
    return out


def code_facts(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """FACTS of a table of code, each once for a file."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *fact) for f, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for fact in sorted(facts_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["file", "kind", "value"])

    return files.select(F.col(file).cast("string").alias("file"), text).mapInArrow(apply, FACTS)


def met(facts: DataFrame, rules: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(file, rule), once for each rule that a file meets."""
    tests = [F.when((F.col("kind") == kind) & F.col("value").rlike(f"^(?:{rx})$"), F.lit(name)) for name, (kind, rx) in (rules or RULES).items()]
    return facts.select("file", F.explode(F.array_compact(F.array(*tests))).alias("rule")).distinct()


def advice(found: DataFrame, cases: list[tuple] | None = None) -> DataFrame:
    """(file, advice) from (file, rule)."""
    per = found.groupBy("file").agg(F.collect_set("rule").alias("rules"))  # as many as there are rules
    every = lambda names: functools.reduce(lambda a, b: a & b, [F.array_contains("rules", n) for n in names], F.lit(True))
    none = lambda names: functools.reduce(lambda a, b: a & b, [~F.array_contains("rules", n) for n in names], F.lit(True))
    said = [F.when(every(yes) & none(no), F.lit(text)) for yes, no, text in (cases or ADVICE)]
    return per.select("file", F.explode(F.array_compact(F.array(*said))).alias("advice"))
