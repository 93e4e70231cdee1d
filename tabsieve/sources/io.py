"""Sources and sinks: CSV/parquet scans with explicit schemas, labelled loads,
reference tables, feature-block directories, table and audit-report writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_csv(spark: SparkSession, path: str, schema: str | None = None,
             header: bool = True) -> DataFrame:
    """Read CSV. With a schema the scan is single-pass and prunable; without one the
    types are inferred once (a full extra pass, as the reference's full-file inference)."""
    r = spark.read.option("header", header)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path)


def scan_csv_checked(spark: SparkSession, path: str, schema: str, out: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): rows that fit ``schema``, and the lines that do not (a value of another type, too few or too many
    fields) as (_file, line).

    One pass parses every column of every line and writes both as Parquet under ``out``, parted by whether a line fits:
    a plain scan would judge a line by the columns that a query happens to read.
    """
    bad = "_rejected_line"
    lines = (spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
             .schema(f"{schema}, {bad} string").csv(path))
    marked = lines.withColumns({"_file": F.when(F.col(bad).isNotNull(), F.input_file_name()), "_fits": F.col(bad).isNull()})
    marked.write.mode("overwrite").partitionBy("_fits").parquet(out)
    kept = spark.read.schema(marked.schema).parquet(out)
    return (kept.where("_fits").drop("_file", bad, "_fits"),
            kept.where("not _fits").select("_file", F.col(bad).alias("line")))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_labelled(df: DataFrame, target: str, time_col: str | None = None,
                  time_unit: str | None = None) -> DataFrame:
    """Keep rows with a known target (cast to int); optionally parse time and drop NULL times."""
    out = df.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("int"))
    if time_col is not None:
        if time_unit == "s":
            out = out.withColumn(time_col, F.timestamp_seconds(F.col(time_col)).cast("timestamp_ntz"))
        elif time_unit == "ms":
            out = out.withColumn(time_col, F.timestamp_millis(F.col(time_col)).cast("timestamp_ntz"))
        out = out.where(F.col(time_col).isNotNull())
    return out


def load_reference_table(spark: SparkSession, sf_dir: str | None = None,
                         path: str | None = None, schema: str | None = None) -> DataFrame:
    """Pickup-point style reference table (region, city, code).

    With ``path`` it reads a CSV with the first three columns; with the driver
    data it is derived from nation x region (both fixed-size dimensions).
    """
    if path is not None:
        df = scan_csv(spark, path, schema=schema)
        first = df.columns[:3]
        return df.select(*[F.col(c).alias(n) for c, n in zip(first, ["region", "city", "code"])])
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.col("r_name").alias("region"), F.col("n_name").alias("city"),
                    F.concat(F.lit("x-"), F.upper(F.substring("n_name", 1, 3)),
                             F.col("n_nationkey").cast("string")).alias("code")))


def scan_block_dir(spark: SparkSession, paths: list[str], key: str = "row_id",
                   schemas: list[str] | None = None, fmt: str = "csv") -> list[DataFrame]:
    """Read every feature block; each must carry the key column."""
    blocks = []
    for i, p in enumerate(paths):
        if fmt == "csv":
            b = scan_csv(spark, p, schema=schemas[i] if schemas else None)
        else:
            b = spark.read.parquet(p)
        if key not in b.columns:
            raise ValueError(f"block {p} has no {key} column")
        blocks.append(b)
    return blocks


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_audit_report(steps, path: str, target: str) -> None:
    """Findings of each step as JSON lines plus one step table (shapes before/after).

    ``steps`` is a list of (Findings, input DataFrame). Row counts come from a
    distributed ``count``; no row data passes through the driver.
    """
    spark = steps[0][1].sparkSession
    rows = []
    for i, (f, df_in) in enumerate(steps):
        n = df_in.count()
        f.table.withColumn("step", F.lit(i)).write.mode("overwrite").json(f"{path}/findings/{i}_{f.name}")
        after = len([c for c in df_in.columns if c not in f.drop])
        if not f.drop:
            rows.append((i, f.name, None, n, len(df_in.columns), after, target))
        for c in f.drop:
            rows.append((i, f.name, c, n, len(df_in.columns), after, target))
    spark.createDataFrame(rows, "step int, analyzer string, feature string, rows_before long, "
                                "cols_before int, cols_after int, target string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/steps")


def score_output(scored: DataFrame, id_col: str, prob_col: str = "probability",
                 index: int = 1, out: str = "score") -> DataFrame:
    """(id, score): one class probability out of the ML probability vector."""
    from pyspark.ml.functions import vector_to_array
    return scored.select(F.col(id_col).alias("id"),
                         vector_to_array(F.col(prob_col))[index].alias(out))
