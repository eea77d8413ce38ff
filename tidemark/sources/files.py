"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import unit_interval


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A landed table with declared columns, so that nothing is read to find them."""
    return spark.read.schema(schema).parquet(path)


def union_instances(feeds: Mapping[int, DataFrame]) -> DataFrame:
    """One cluster-wide relation from the same relation of every instance, tagged with ``inst_id``."""
    tagged = [df.withColumn("inst_id", F.lit(inst)) for inst, df in feeds.items()]
    return reduce(DataFrame.unionByName, tagged)


def random_columns(ids: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds three test numbers: whole 0 to 10, fraction 0 to 1, fraction 0 to 142.

    They depend on ``key`` and ``seed`` alone, so a task that runs again makes the same rows.
    """
    def draw(column: int):
        return unit_interval(F.col(key), f"{seed}.{column}")

    return ids.withColumn("num1", F.round(draw(1) * 10, 0).cast("bigint")).withColumn("num2", draw(2)).withColumn(
        "num3", draw(3) * 142
    )


def generate_series_table(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of test numbers, made in parallel."""
    return random_columns(spark.range(n), "id", seed).drop("id")


# What a null is written as. A text that begins with the mark's backslash gets one more.
_NULL = "\\N"


def _csv_options(file):
    """Quotes are doubled inside quotes, line breaks stay inside a field, and spaces at the ends are kept."""
    return (
        file.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", _NULL)
        .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )


def _texts(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def export_csv(df: DataFrame, path: str) -> None:
    """Writes a table as CSV files with a header; every text comes back as it was, empty ones and nulls apart."""
    marked = {c: F.when(F.col(c).startswith("\\"), F.concat(F.lit("\\"), F.col(c))).otherwise(F.col(c)) for c in _texts(df.schema)}
    _csv_options(df.withColumns(marked).write).option("quoteAll", True).csv(path)


def import_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Reads what :func:`export_csv` wrote."""
    rows = _csv_options(spark.read.schema(schema)).option("multiLine", True).csv(path)
    plain = {c: F.when(F.col(c).startswith("\\"), F.expr(f"substring(`{c}`, 2)")).otherwise(F.col(c)) for c in _texts(schema)}
    return rows.withColumns(plain)


def write_report(df: DataFrame, folder: str, report: str, run: str) -> None:
    """Writes a result to its place in the report folder; the same run and report written again replaces it."""
    df.write.mode("overwrite").parquet(f"{folder}/run={run}/report={report}")


def read_report(spark: SparkSession, folder: str, report: str, run: str) -> DataFrame:
    """One report of one run; only its partition is read."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/run={run}/report={report}")
    return rows.drop("run", "report")


_SIDE = T.StructType([T.StructField(n, T.StringType()) for n in ("DOMAIN", "IP", "NAME")])

# The two layouts of a rack description.
CATALOG = T.StructType([
    T.StructField("ADMIN", _SIDE), T.StructField("CLIENT", _SIDE), T.StructField("HOSTNAME", T.StringType()),
    T.StructField("ID", T.StringType()), T.StructField("TYPE", T.StringType()),
])
MACHINE = T.StructType([
    T.StructField(n, T.StringType()) for n in ("ADMINDOMAIN", "ADMINIP", "ADMINNAME", "HOSTNAME", "ID", "TYPE")
])

COMPONENT_FIELDS = (
    "admin_domain", "admin_ip", "admin_name", "client_domain", "client_ip", "client_name", "host_name", "id", "type",
)


def read_components_xml(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rack components from ``ITEM`` elements: a row for the admin side and, when it has a name and an address,
    one for the client side. ``kind`` is ``catalog`` or ``machine``."""
    none = F.lit(None).cast("string")
    reader = spark.read.format("xml").option("rowTag", "ITEM")
    if kind == "catalog":
        items = reader.schema(CATALOG).load(path)
        admin, client = F.col("ADMIN"), F.col("CLIENT")
    elif kind == "machine":
        items = reader.schema(MACHINE).load(path)
        admin = F.struct(F.col("ADMINDOMAIN").alias("DOMAIN"), F.col("ADMINIP").alias("IP"), F.col("ADMINNAME").alias("NAME"))
        client = F.struct(none.alias("DOMAIN"), none.alias("IP"), none.alias("NAME"))
    else:
        raise ValueError("kind is catalog or machine")

    def row(with_admin: bool, with_client: bool):
        parts = []
        for wanted, side in ((with_admin, admin), (with_client, client)):
            parts += [side[f] if wanted else none for f in ("DOMAIN", "IP", "NAME")]
        parts += [F.col("HOSTNAME"), F.col("ID"), F.col("TYPE")]
        return F.struct(*[part.alias(name) for part, name in zip(parts, COMPONENT_FIELDS)])

    named = items.filter(admin["NAME"].isNotNull())
    second = F.when(client["NAME"].isNotNull() & client["IP"].isNotNull(), row(False, True))
    rows = F.array_compact(F.array(row(True, False), second))
    return named.select(F.explode(rows).alias("c")).select("c.*")
