"""Sinks: JSON, keyed documents, partitioned files, tables as text, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def json_arrays(rows: DataFrame, path: str, mode: str = "overwrite", most: int = 100_000) -> None:
    """Files that each hold one JSON array of up to ``most`` rows, in no order; "append" adds further files."""
    from pyspark.sql.types import StringType, StructField, StructType

    def wrap(parts):
        import pyarrow as pa

        held: list[str] = []
        for batch in parts:
            held += batch.column(0).to_pylist()
            while len(held) >= most:
                yield pa.RecordBatch.from_pydict({"value": [f"[{','.join(held[:most])}]"]})
                held = held[most:]
        if held:
            yield pa.RecordBatch.from_pydict({"value": [f"[{','.join(held)}]"]})

    lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.mapInArrow(wrap, StructType([StructField("value", StringType())])).write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def separated(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """One folder for each value of each key."""
    rows.write.mode("overwrite").partitionBy(*by).json(path)


def keyed(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """key and its items, an array of structs in order: a row for each entry of a keyed document."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.struct(*values).alias("__item"))))
    return rows.groupBy(key).agg(F.transform(items, lambda x: x["__item"]).alias("items"))


def keyed_json(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One line of JSON a key, {key: [item, …]}."""
    return keyed(rows, key, order, values).select(key, F.to_json(F.map_from_arrays(F.array(F.col(key).cast("string")), F.array("items"))).alias("value"))


def markdown_lines(rows: DataFrame, missing: str = "—") -> DataFrame:
    """Each row as a line of a Markdown table, ``line``; written as text it has any size."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown(rows: DataFrame, headers: list[str] | None = None, missing: str = "—", most: int = 1000) -> str:
    """A table of up to ``most`` rows as Markdown, made on the driver; a larger one is an error (see :func:`markdown_lines`)."""
    headers = headers or rows.columns
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows: write markdown_lines instead")
    lines = ["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers)]
    lines += ["| " + " | ".join(missing if v is None else str(v) for v in r) + " |" for r in found]
    return "\n".join(lines)


def bars(n: Column, peak: Column, width: int = 40) -> Column:
    """A bar of # scaled to the peak."""
    return F.repeat(F.lit("#"), F.coalesce(F.try_divide(n * width, peak), F.lit(0)).cast("int"))


def drop_manifest(before: DataFrame, after: DataFrame, key: str, reason: str) -> DataFrame:
    """The keys that a step dropped, with its name."""
    return before.select(key).join(after.select(key), key, "left_anti").select(key, F.lit(reason).alias("reason"))


def replace_atomically(rows: DataFrame, path: str) -> None:
    """Write beside the target, then swap by rename; a reader sees the old files or the new."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, target, old = (hadoop.Path(path + s) for s in (".new", "", ".old"))
    rows.write.mode("overwrite").parquet(path + ".new")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)
