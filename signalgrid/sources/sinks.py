"""Writers for converted data, metrics and predictions, and file fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TREE_FILES = 5_000_000


def write_dataset(cells: DataFrame, samples: DataFrame, folder: str, mode: str = "overwrite", dry_run: bool = False,
                  partition_by: Sequence[str] = ("task_id", "building_id")) -> None:
    """Write cells (partitioned) and the manifest.

    Modes: 'overwrite', or 'skip_existing', which appends only samples not yet in the
    stored manifest.
    """
    if dry_run:
        return
    spark = cells.sparkSession
    save = "overwrite"
    if mode == "skip_existing":
        done = spark.read.parquet(f"{folder}/samples").select("sample_id")
        cells = cells.join(done, "sample_id", "left_anti")
        samples = samples.join(done, "sample_id", "left_anti")
        save = "append"
    # Clustering by the partition columns and the sample avoids many small files, while a
    # large building still spreads over tasks.
    cells.repartition(*partition_by, "sample_id").write.mode(save).partitionBy(*partition_by).parquet(f"{folder}/cells")
    samples.write.mode(save).parquet(f"{folder}/samples")


def write_metrics(per_sample: DataFrame, final: DataFrame, folder: str, importances: DataFrame | None = None) -> None:
    """Per-sample metrics, the final table sorted by rate and error, and importances when present."""
    per_sample.write.mode("overwrite").parquet(f"{folder}/per_sample_metrics")
    final.orderBy("sparse_rate", "rmse").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/final_results")
    if importances is not None:
        importances.write.mode("overwrite").parquet(f"{folder}/feature_importances")


def write_predictions(predictions: DataFrame, folder: str, rate: float, seed: int) -> None:
    """Dense predictions of the primary (rate, seed), one folder per method."""
    chosen = predictions.where((F.col("rate") == float(rate)) & (F.col("seed") == int(seed)))
    chosen.write.mode("overwrite").partitionBy("method").parquet(f"{folder}/predictions")


def write_point_results(folds: DataFrame, points: DataFrame, pooled: DataFrame, summary: DataFrame, folder: str) -> None:
    """Fold metrics, point predictions, pooled metrics and a one-row JSON summary."""
    folds.write.mode("overwrite").option("header", True).csv(f"{folder}/fold_metrics")
    points.write.mode("overwrite").parquet(f"{folder}/point_predictions")
    pooled.write.mode("overwrite").option("header", True).csv(f"{folder}/pooled_metrics")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def fingerprints(files: DataFrame, path: str = "path", content: str = "content", exclude: Sequence[str] = ()) -> DataFrame:
    """MD5, SHA-256 and size of every file. `exclude` lists path parts to leave out."""
    keep = F.lit(True)
    for part in exclude:
        keep = keep & ~F.array_contains(F.split(path, "/"), part)
    return files.where(keep).select(
        F.col(path).alias("path"), F.md5(content).alias("md5"), F.sha2(content, 256).alias("sha256"),
        F.octet_length(content).cast("bigint").alias("bytes"))


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def sha256_lines(prints: DataFrame) -> DataFrame:
    """Manifest lines '<sha256>  <path>' for a checksum tool, in path order."""
    return prints.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def tree_hash(prints: DataFrame) -> DataFrame:
    """Number of files and SHA-256 of the ordered JSON list of their hashes.

    One digest over an ordered list is sequential by definition, so this takes one short
    line per file (never contents) and refuses trees beyond a stated file count.
    """
    if prints.limit(MAX_TREE_FILES + 1).count() > MAX_TREE_FILES:
        raise ValueError(f"a tree digest takes at most {MAX_TREE_FILES} files")
    item = F.format_string('{"md5": "%s", "path": "%s", "sha256": "%s"}', "md5", "path", "sha256")
    listed = prints.agg(F.count(F.lit(1)).alias("num_files"), F.array_sort(F.collect_list(F.struct("path", item.alias("item")))).alias("rows"))
    text = F.concat(F.lit("["), F.array_join(F.col("rows.item"), ", "), F.lit("]"))
    return listed.select("num_files", F.sha2(text, 256).alias("manifest_sha256"))
