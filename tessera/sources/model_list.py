"""Lists of models: class, file, threshold and an optional synset per line; quotes may hold spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELD = r'(?:"([^"]*)"|([^\s"#]\S*))'
_LINE = rf"^\s*(#?)\s*{_FIELD}\s+{_FIELD}\s+([-+]?[0-9.]+(?:[eE][-+]?\d+)?)(?:\s+{_FIELD})?\s*$"


def parse(lines: DataFrame, text: str) -> DataFrame:
    """Adds the fields. A line behind # that is a record otherwise is a disabled one; other remarks fall out."""

    def group(i: int):
        return F.regexp_extract(text, _LINE, i)

    def field(i: int):
        return F.when(group(i) != "", group(i)).otherwise(group(i + 1))

    found = lines.where(F.col(text).rlike(_LINE))
    return found.select("*", field(2).alias("classname"), field(4).alias("modelfile"), group(6).cast("double").alias("threshold"), F.nullif(field(7), F.lit("")).alias("synset"), (group(1) == "#").alias("disabled"))


def read(spark, path: str) -> DataFrame:
    """Records of a file; relative model files are taken from the list's folder."""
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    records = parse(spark.read.text(path), "value").drop("value")
    return records.withColumn("modelfile", F.when(F.col("modelfile").startswith("/"), F.col("modelfile")).otherwise(F.concat(F.lit(folder), "modelfile")))


def write(models: DataFrame, path: str) -> None:
    def quoted(c: str):
        return F.concat(F.lit('"'), c, F.lit('"'))

    line = F.concat(F.when(F.col("disabled"), F.lit("# ")).otherwise(F.lit("")), F.concat_ws(" ", quoted("classname"), quoted("modelfile"), F.col("threshold").cast("string"), "synset"))
    models.select(line.alias("value")).write.text(path)
