"""The match record, as a flat table and as an array for each read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT = T.StructType([T.StructField("direction", T.StringType()), T.StructField("group_id", T.IntegerType()), T.StructField("match_idx", T.IntegerType())])

#: fields of a match besides read_id, in the order of the text format
MATCH = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("read_len", "rel_dist_to_end", "read_start_bar", "read_end_bar", "read_start_flank", "read_end_flank", "bar_start", "bar_end")]
    + [T.StructField("match_type", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("flank_cost", "barcode_cost")]
    + [T.StructField("label", T.StringType()), T.StructField("strand", T.StringType()), T.StructField("cuts", T.ArrayType(CUT))]
)
FIELDS = [f.name for f in MATCH.fields]


def gathered(annotations: DataFrame, *others: str) -> DataFrame:
    """One row a read: read_id, matches (in order of anno_idx). others: columns that all rows of a read share."""
    annotations = annotations if "cuts" in annotations.columns else annotations.withColumn("cuts", F.lit(None).cast(MATCH["cuts"].dataType))
    rest = [F.first(c).alias(c) for c in others]
    match = F.struct("anno_idx", F.struct(*(F.col(n).cast(MATCH[n].dataType).alias(n) for n in FIELDS)).alias("m"))
    listed = annotations.groupBy("read_id").agg(F.array_sort(F.collect_list(match)).alias("listed"), *rest)
    return listed.select("read_id", F.transform("listed", lambda x: x["m"]).alias("matches"), *others)


def flat(reads: DataFrame, *others: str) -> DataFrame:
    """One row a match: read_id, the match's fields, anno_idx, others."""
    return reads.select("read_id", F.posexplode("matches").alias("anno_idx", "m"), *others).select("read_id", "m.*", "anno_idx", *others)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generated column is not put in for its uses again."""
    return df.withColumn(name, F.explode(F.array(value)))
