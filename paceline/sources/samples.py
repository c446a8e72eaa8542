"""Sources: tables as canonical planner input (sample_id, rank, arrival_idx, length, n_patches)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paceline.operators.order import RANGE, numbered

NARROW = ("sample_id", "rank", "arrival_idx", "length", "n_patches")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Length of a text in words split at single spaces; null: 0."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.split(text, " "))).cast("long")


def arrivals(df: DataFrame, rank: Column, key: str, per_range: int = RANGE) -> DataFrame:
    """df with rank and arrival_idx, the place among the rows of its rank by `key`. No task holds a whole rank: one rank
    may be all of the table."""
    return numbered(df.withColumn("rank", rank.cast("int")), [F.col(key)], "arrival_idx", ("rank",), per_range)


def samples(df: DataFrame, sample_id: str, length: Column, world: int, patches: Column | None = None) -> DataFrame:
    """Canonical input, ranks by sample_id modulo the world size. Payload columns are left behind."""
    narrow = df.select(F.col(sample_id).cast("long").alias("sample_id"), length.cast("long").alias("length"), (F.lit(0) if patches is None else patches).cast("long").alias("n_patches"))
    return arrivals(narrow, F.pmod(F.col("sample_id"), F.lit(world)), "sample_id").select(*NARROW)


def document_samples(spark: SparkSession, sf_dir: str, world: int = 1) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return samples(docs, "doc_id", words(F.col("text")), world, F.pmod(F.col("doc_id"), F.lit(4)))


def synthetic_lengths(spark: SparkSession, n: int, seed: int = 7, vocabulary: int = 32000) -> DataFrame:
    """A long-tailed source: 72 % of lengths in [64, 384), 22 % in [384, 1400), the rest in [1400, 4096)."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    span = lambda a, b: F.floor(F.lit(a) + u(2) * (b - a)).cast("long")
    length = F.when(u(1) < 0.72, span(64, 384)).when(u(1) < 0.94, span(384, 1400)).otherwise(span(1400, 4096))
    tokens = F.transform(F.sequence(F.lit(0).cast("long"), F.col("length") - 1), lambda i: F.pmod(i + F.col("sample_id"), F.lit(vocabulary)))
    return spark.range(n).select(F.col("id").alias("sample_id"), length.alias("length")).withColumn("input_ids", tokens)


# Signs of the training frameworks.
FRAMEWORK_RULES = {
    "hf_trainer": r"\bTrainer\b|transformers\.Trainer|TrainingArguments",
    "llamafactory": r"(?i)llamafactory|LLaMA-Factory|llama_factory",
    "accelerate": r"\bAccelerator\b|accelerate\.",
    "lightning": r"lightning\.pytorch|pytorch_lightning|LightningModule|LightningDataModule",
    "pytorch_loop": r"DataLoader|loss\.backward\(|optimizer\.step\(",
}


def counted(found: DataFrame, rules: list[str], first: int = 8) -> DataFrame:
    """(rule, hits, names) of (rule, name): how many rows meet each rule, and the least `first` different names; tasks keep
    no more than these before anything is shuffled."""
    hits = found.groupBy("rule").agg(F.count(F.lit(1)).alias("hits"))
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("name"))
    names = found.distinct().withColumn("nth", nth).filter(F.col("nth") <= first)
    names = names.groupBy("rule").agg(F.array_sort(F.collect_list("name")).alias("names"))
    every = found.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return every.join(hits, "rule", "left").join(names, "rule", "left").fillna({"hits": 0})


def rule_audit(df: DataFrame, text: str, rules: dict[str, str], name: str | None = None, first: int = 8) -> DataFrame:
    """(rule, hits) for each regular expression over a text table; with the column `name` also the first so many names of
    the texts that it is found in, in order."""
    tests = F.array(*[F.when(F.col(text).rlike(rx), F.lit(rule)) for rule, rx in rules.items()])
    d = df.select(F.col(name).cast("string").alias("name") if name else F.lit("").alias("name"), F.explode(F.array_compact(tests)).alias("rule"))
    out = counted(d, list(rules), first)
    return out if name else out.drop("names")


def ready(df: DataFrame, tokens: str = "input_ids", declared: bool = False) -> DataFrame:
    """df if its rows are ready for grouping: a column of tokens, at any depth, or declared so; else a ValueError."""
    from pyspark.sql import types as T

    def holds(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(f.name == tokens or holds(f.dataType) for f in kind.fields)
        return isinstance(kind, T.ArrayType) and holds(kind.elementType)

    if not declared and not holds(df.schema):
        raise ValueError(f"no column {tokens!r}, not even nested: make tokens before grouping, or declare the rows ready")
    return df


def has_tokens(df: DataFrame, tokens: str = "input_ids") -> Column:
    """Whether a row has tokens that are not null, in a column of that name at any depth of structs and arrays."""
    from pyspark.sql import types as T

    def found(c: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.StructType):
            some = [c[f.name].isNotNull() if f.name == tokens else found(c[f.name], f.dataType) for f in kind.fields]
            some = [x for x in some if x is not None]
            return F.array_contains(F.array(*(F.coalesce(x, F.lit(False)) for x in some)), True) if some else None
        if isinstance(kind, T.ArrayType) and found(F.lit(None), kind.elementType) is not None:
            return F.exists(c, lambda x: F.coalesce(found(x, kind.elementType), F.lit(False)))
        return None

    out = found(F.struct(*(F.col(f"`{x}`") for x in df.columns)), df.schema)
    return F.lit(False) if out is None else F.coalesce(out, F.lit(False))
