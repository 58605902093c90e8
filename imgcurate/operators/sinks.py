"""Writing datasets, and accounts of a run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgcurate.operators.ranking import with_position
from imgcurate.session import delete_path
from imgcurate.sources.catalog import opened


def output_stem(filename: Column, index: Column, prefix: str = "") -> Column:
    """K1: the name without extension, with the prefix; else a numbered name."""
    named = F.coalesce(filename, F.lit("")) != ""
    stem = F.regexp_replace(filename, r"(?s)^(\.*[^.].*?)\.[^.]*$", "$1")
    numbered = F.format_string((prefix or "image_").replace("%", "%%") + "%04d", index)
    return F.when(named, F.concat(F.lit(prefix), stem)).otherwise(numbered)


def repeated_stems(df: DataFrame) -> DataFrame:
    """K2: stems that more than one row would write."""
    return df.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def manifest(df: DataFrame) -> DataFrame:
    """K2: one line per row: file name, stem, and caption where there is one."""
    return df.select(
        "image_id", "filename", "stem", F.nullif(F.coalesce("caption", F.lit("")), F.lit("")).alias("caption")
    )


def write_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = (), on_repeat: str = "error") -> None:
    """K2: Parquet under ``path/data`` and the manifest as JSON lines under ``path/manifest``.

    ``df`` is evaluated once, when the data is written; stems are checked and the
    manifest is made from what was written, so the two agree even if a model made
    the rows. A dataset is complete when it has a manifest. Rows with the same stem
    would overwrite each other as files, so they are refused, and the data deleted
    again, unless ``on_repeat`` is ``allow``.
    """
    spark = df.sparkSession
    df.write.partitionBy(*partition_by).parquet(f"{path}/data")
    rows = spark.read.schema(df.schema).parquet(f"{path}/data")
    if on_repeat == "error" and not repeated_stems(rows).isEmpty():
        delete_path(spark, f"{path}/data")
        raise ValueError("several rows have the same stem")
    manifest(rows).write.json(f"{path}/manifest")


def export_files(df: DataFrame, folder: str) -> None:
    """K2: write ``<stem>.png`` and, with a caption, ``<stem>.txt``, task by task.

    Each attempt of a task writes to a folder of its own below ``folder/_attempts``, which readers
    pass over. When all tasks are done, the files of those that succeeded are moved into place,
    again by tasks, and what failed attempts have left is deleted; so a retried or doubled task
    leaves neither half files nor foreign ones. A folder without ``_attempts`` is complete. Files
    of the same name are replaced.

    ``folder`` is a URI that every executor can open. A plain path is refused
    outside a local session, where each machine would fill a folder of its own.
    """
    spark = df.sparkSession
    if "://" not in folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a shared folder by its URI")
    run = f"_attempts/{uuid.uuid4().hex}"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        attempt = uuid.uuid4().hex
        system.create_dir(f"{base}/{run}/{attempt}", recursive=True)
        for rows in batches:
            for stem, encoded, caption in zip(rows["stem"].to_pylist(), rows["encoded"], rows["caption"].to_pylist()):
                with system.open_output_stream(f"{base}/{run}/{attempt}/{stem}.png") as out:
                    out.write(encoded.as_buffer())
                if caption:
                    with system.open_output_stream(f"{base}/{run}/{attempt}/{stem}.txt") as out:
                        out.write(caption.encode())
        yield pa.RecordBatch.from_pydict({"attempt": [attempt]})

    def publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = opened(folder)
        for rows in batches:
            for attempt in rows["attempt"]:
                # An attempt of this task that broke off has moved some of them already.
                for file in system.get_file_info(fs.FileSelector(f"{base}/{run}/{attempt}")):
                    system.move(file.path, f"{base}/{file.base_name}")
            yield rows

    # One row a task comes to the driver, and only of attempts that Spark has accepted.
    done = df.select("stem", "encoded", "caption").mapInArrow(save, "attempt string").collect()
    if done:
        spark.createDataFrame(done, "attempt string").repartition(len(done)).mapInPandas(publish, "attempt string").count()
    delete_path(spark, f"{folder}/_attempts")


def write_split(df: DataFrame, path: str, decision: Column, names: tuple[str, str] = ("kept", "rejected")) -> None:
    """K3: both sides of a decision in one write, partitioned by ``decision``."""
    side = F.when(decision, names[0]).otherwise(names[1])
    df.withColumn("decision", side).write.partitionBy("decision").parquet(path)


def run_counts(df: DataFrame, decision: str, by: Sequence[str] = ()) -> DataFrame:
    """K4: rows, and rows on both sides of a decision."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(decision).alias("kept_count"),
        F.count_if(~F.col(decision)).alias("rejected_count"),
    )


def throughput(runs: DataFrame) -> DataFrame:
    """K5: totals of ``runs(image_id, start_s, end_s, ok)``."""
    done = F.count(F.lit(1))
    elapsed = F.max("end_s") - F.min("start_s")
    return runs.agg(
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        elapsed.alias("elapsed_s"),
        (elapsed / done).alias("s_per_image"),
    )


def progress(runs: DataFrame) -> DataFrame:
    """K5: state of the run after every finished image: done, failed, speed and time left."""
    start = runs.agg(F.min("start_s")).scalar()
    failed = F.when(F.col("ok"), 0).otherwise(1)
    placed = with_position(
        runs.select("image_id", "end_s", "ok"), ["end_s", "image_id"], position="_pos", total="total", running={"failed": failed}
    )
    done = F.col("_pos") + 1
    per_image = (F.col("end_s") - start) / done
    return placed.select(
        "image_id",
        done.alias("done"),
        "failed",
        per_image.alias("s_per_image"),
        (per_image * (F.col("total") - done)).alias("eta_s"),
    )
