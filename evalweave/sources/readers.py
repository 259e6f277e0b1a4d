"""Scans: JSON in its several layouts, CSV, subtitles, partition paths, sharded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.functions.semantics import first_nonempty
from evalweave.functions.text import options
from evalweave.functions.times import seconds


def json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file with an array of objects, or with one object as one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object a line; blank and malformed lines are left out."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def json_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """An array, if the first character that isn't blank is a bracket, else lines."""
    first = spark.read.text(path).select(F.substring(F.trim("value"), 1, 1).alias("c")).where("c <> ''").first()
    return json_array(spark, path, schema) if first and first.c == "[" else json_lines(spark, path, schema)


def keyed_document(spark: SparkSession, path: str, item: str, key: str = "video") -> DataFrame:
    """{key: [item, …]} as one row an item, with its key and place."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,array<{item}>>")).alias(key, "__items")).select(key, F.posexplode("__items").alias("place", "item")).select(key, "place", "item.*")


def matching_files(spark: SparkSession, path: str, pattern: str, schema: T.StructType | str, without: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """JSON files of a tree by name pattern, those whose path holds a listed word left out; column ``path`` tells the file."""
    rows = spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path).withColumn("path", F.input_file_name())
    for word in without:
        rows = rows.where(~F.contains("path", F.lit(word)))
    return rows


def path_parts(rows: DataFrame, names: list[str], path: str = "path") -> DataFrame:
    """The last folders of a path as columns, the one nearest to the file last."""
    parts = F.split(path, "/")
    return rows.withColumns({n: F.try_element_at(parts, F.lit(i - len(names) - 1)) for i, n in enumerate(names)})


def separated(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV with a header, all columns as text."""
    return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


_ARROW = r"(\d+:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d+:\d{2}:\d{2}[,.]\d{1,3})"


def cues(text: Column) -> Column:
    """Subtitle blocks of a text as array<struct<start, end, text>>; number lines may be missing."""
    blocks = F.filter(F.split(F.regexp_replace(text, "\r", ""), r"\n\s*\n"), lambda b: b.rlike(_ARROW))

    def cue(b: Column) -> Column:
        body = F.regexp_replace(b, rf"(?s)^.*?{_ARROW}[^\n]*\n?", "")
        return F.struct(seconds(F.regexp_extract(b, _ARROW, 1)).alias("start"), seconds(F.regexp_extract(b, _ARROW, 2)).alias("end"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))

    return F.transform(blocks, cue)


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """path, place, start, end, text of every cue of the files."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return whole.select("path", F.posexplode(cues(F.col("value"))).alias("place", "cue")).select("path", "place", "cue.*")


def eval_items(rows: DataFrame) -> DataFrame:
    """Items of several layouts under one schema: uid, question, answer_choices, ground_truth.

    Synonyms are tried in order; choices written into the question are taken out of it.
    """
    have = set(rows.columns)

    def any_of(*names: str) -> Column:
        return first_nonempty(*(F.col(n).cast("string") for n in names if n in have)) if have & set(names) else F.lit(None).cast("string")

    question = any_of("question", "query")
    asked, listed = options(question)
    inline = question.rlike(r"\(A\)")
    given = next((F.col(n) for n in ("answer_choices", "choices", "candidates") if n in have), F.array().cast("array<string>"))
    return rows.select(any_of("uid", "id", "qid").alias("uid"), F.when(inline, asked).otherwise(question).alias("question"), F.when(inline, listed).otherwise(given).alias("answer_choices"), any_of("ground_truth", "answer").alias("ground_truth"))


def by_quota(rows: DataFrame, category: str, order: list[Column], quota: dict[str, int], default: int = 0) -> DataFrame:
    """The first rows of each category, as many as its quota."""
    limit = F.lit(default)
    for name, n in quota.items():
        limit = F.when(F.col(category) == name, n).otherwise(limit)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("__n") <= limit).drop("__n")


def shard(place: Column, total: Column, index: Column | int, shards: int, kind: str = "strided") -> Column:
    """Is the row at a place from 0 in the shard? "strided" takes every n-th, "contiguous" rounds sizes up, "balanced" lets the first ones hold one more."""
    index = index if isinstance(index, Column) else F.lit(index)
    if kind == "strided":
        return place % shards == index
    if kind == "contiguous":
        return F.floor(place / F.greatest(F.lit(1), F.ceil(total / shards))) == index
    size, over = F.floor(total / shards), total % shards
    start = index * size + F.least(index, over)
    return (place >= start) & (place < start + size + F.when(index < over, 1).otherwise(0))
