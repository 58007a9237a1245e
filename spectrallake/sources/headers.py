"""Headers of datasets: what a table of values is, where it comes from and what was done to it.

One row a dataset: dataset, title, source, quantity, units, data_type, axes (an array of name, units, kind, start, step,
size) and metadata (a map). A result takes its header from its input's and says what changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "dataset long, title string, source string, quantity string, units string, data_type string, "
    "axes array<struct<name:string,units:string,kind:string,start:double,step:double,size:int>>, metadata map<string,string>"
)


def like(headers: DataFrame, prefix: str, **changed: Column) -> DataFrame:
    """Headers of results: all of the input's, with its title as source, a title of its own and columns that differ."""
    out = headers.withColumns({"source": F.col("title"), "title": F.concat(F.lit(prefix), "title")})
    return out.withColumns(changed) if changed else out


def provenance(headers: DataFrame, method: str, **arguments) -> DataFrame:
    """Headers whose metadata says by what method and arguments the data were made; earlier entries of other names stay."""
    said = {"analysis": method, **{k: str(v) for k, v in sorted(arguments.items())}}
    new = F.create_map(*[F.lit(x) for pair in said.items() for x in pair])
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return headers.withColumn("metadata", F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(list(said))), new))


def axis_values(headers: DataFrame) -> DataFrame:
    """dataset, axis, i, value: the values along every axis."""
    a = headers.select("dataset", F.explode("axes").alias("a")).where("a.size > 0")
    return a.select("dataset", F.col("a.name").alias("axis"), F.col("a.start").alias("start"), F.col("a.step").alias("step"), F.explode(F.sequence(F.lit(0), F.col("a.size") - 1)).alias("i")).select("dataset", "axis", "i", (F.col("start") + F.col("i") * F.col("step")).alias("value"))
