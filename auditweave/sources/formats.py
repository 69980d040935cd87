"""Text formats as tables: LCOV, test-run JSON, SQL snapshots, scope files, snapshots of the graph."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.enums import trim_all
from ..functions.text import sql_identifier, sql_literal
from ..storage import cut


def lcov_lines(texts: DataFrame) -> DataFrame:
    """(id, text) -> (id, path, line_number, hit_count).  ``SF:`` at a line's front sets the file, a line
    ``end_of_record`` ends it; lines outside a file, unreadable ones and those without a hit are dropped.
    A text is split at its files first, so no order of lines is needed."""
    files = texts.select("id", F.explode(F.split("text", r"(?md)^(?=SF:)")).alias("f")).where(F.col("f").startswith("SF:"))
    own = files.select("id", trim_all(F.substring(F.substring_index("f", "\n", 1), 4, 1 << 30)).alias("path"), F.split("f", r"(?mdU)^end_of_record[^\S\n]*$")[0].alias("body"))
    rows = own.select("id", "path", F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").startswith("DA:"))
    parts = F.split(F.substring("line", 4, 1 << 30), ",")
    whole = lambda c, kind: F.when(trim_all(c).rlike(r"^[+-]?[0-9]+$"), trim_all(c).try_cast(kind))
    out = rows.select("id", "path", whole(parts[0], "int").alias("line_number"), whole(F.get(parts, F.lit(1)), "long").alias("hit_count"))
    return out.where("line_number IS NOT NULL AND hit_count > 0")


def run_summary(texts: DataFrame) -> DataFrame:
    """(id, text) of test-run JSON -> one row for each test: suite, test, status, reason, calls, reverts.
    Text that isn't JSON gives no rows."""
    v = F.try_parse_json("text")
    suites = texts.select("id", F.explode(F.try_variant_get(v, "$", "map<string,variant>")).alias("suite", "body"))
    tests = suites.select("id", "suite", F.explode(F.try_variant_get("body", "$.test_results", "map<string,variant>")).alias("test", "t"))

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get("t", path, kind)

    return tests.select(
        "id", "suite", "test", at("$.status", "string").alias("status"), at("$.reason", "string").alias("reason"),
        F.coalesce(at("$.kind.Invariant.calls", "long"), F.lit(0)).alias("calls"), F.coalesce(at("$.kind.Invariant.reverts", "long"), F.lit(0)).alias("reverts"),
    )


def counterexample_calls(texts: DataFrame) -> DataFrame:
    """Calls of ``counterexample.Sequence`` (a number, then a list of calls), in order."""
    v = F.try_parse_json("text")
    calls = F.try_variant_get(v, "$.counterexample.Sequence[1]", "array<struct<contract_name:string,function_name:string>>")
    return texts.select("id", F.posexplode(calls).alias("pos", "call")).select("id", "pos", "call.contract_name", "call.function_name")


def findings_json(texts: DataFrame) -> DataFrame:
    """External findings; a missing severity is Medium."""
    schema = "array<struct<contract:string,function:string,title:string,severity:string,description:string>>"
    return texts.select("id", F.posexplode(F.from_json("text", schema)).alias("pos", "f")).select("id", "pos", "f.contract", "f.function", "f.title", F.coalesce("f.severity", F.lit("Medium")).alias("severity"))


def insert_statements(df: DataFrame, table: str, dialect: str = "sqlite") -> DataFrame:
    """One INSERT a row."""
    head = f"INSERT INTO {sql_identifier(table, dialect)} ({', '.join(sql_identifier(c, dialect) for c in df.columns)}) VALUES ("

    def literal(name: str, kind: str) -> Column:
        if kind == "binary":
            return F.coalesce(F.concat(F.lit("X'"), F.hex(name), F.lit("'")), F.lit("NULL"))
        if kind == "string" or kind.startswith(("timestamp", "date")):
            return sql_literal(F.col(name).cast("string"), dialect)
        if kind == "boolean":
            return F.coalesce(F.col(name).cast("int").cast("string"), F.lit("NULL"))
        return F.coalesce(F.col(name).cast("string"), F.lit("NULL"))

    values = F.concat_ws(", ", *[literal(c, k) for c, k in df.dtypes])
    return df.select(F.concat(F.lit(head), values, F.lit(");")).alias("statement"))


def scope_globs(lines: list[str]) -> list[str]:
    """Lines of a scope file as globs: comments and blanks go, ``./`` and ``/`` in front too; a folder
    stands for all in it."""
    out = []
    for line in lines:
        s = line.split("#", 1)[0].strip().removeprefix("./").lstrip("/")
        if s:
            out.append(s + "**" if s.endswith("/") else s if "." in s.rsplit("/", 1)[-1] or "*" in s else s + "/**")
    return out


def source_files(spark: SparkSession, folder: str, globs: list[str] | None = None) -> DataFrame:
    """path and text of all files below a folder."""
    from ..functions.text import matches_any

    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where(matches_any(F.col("path"), ["**/" + g for g in globs])) if globs else files


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A snapshot: each table as JSON lines under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def import_tables(spark: SparkSession, schemas: dict, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}


def merge_tables(own: DataFrame, other: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Append ``other`` with new ids after the largest of ``own``: (all rows, map of old to new ids).
    Rows whose natural ``key`` is there already keep the id that is there."""
    most = own.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    there = own.groupBy(F.col(key).alias("_key")).agg(F.min("id").alias("there"))
    marked = other.join(there, other[key] == there["_key"], "left").drop("_key")
    fresh = marked.where("there IS NULL").drop("there")
    # ids of new rows count within ranges of the old id, then over the ranges: no single task holds all
    parts = cut(fresh.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id()))  # read twice: its ranges must not move
    sizes = parts.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    nth = F.row_number().over(W.partitionBy("part").orderBy("id"))
    numbered = parts.withColumn("nth", nth).join(sizes, "part").crossJoin(most).select("id", (F.col("most") + F.coalesce("before", F.lit(0)) + F.col("nth")).cast("int").alias("new_id"))
    mapped = marked.where("there IS NOT NULL").select("id", F.col("there").alias("new_id")).unionByName(numbered)
    new = fresh.join(numbered, "id").drop("id").withColumnRenamed("new_id", "id")
    return own.unionByName(new.select(*own.columns)), mapped


def snapshot_format(name: str) -> str:
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix in ("sql", "json"):
        return suffix
    raise ValueError(f"{name}: say whether it is sql or json")


def write_json(path: str, value) -> None:
    """Written beside and renamed, so a reader never sees half a file."""
    import os

    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True)
    os.replace(path + ".new", path)


def project_spec(text: str) -> tuple[str, str, str | None]:
    """``name:path[:platform]``."""
    name, path, *rest = text.split(":", 2)
    if not name or not path:
        raise ValueError("name:path[:platform] is expected")
    return name, path, rest[0] if rest else None
