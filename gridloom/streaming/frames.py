"""Images as they arrive: a folder of anymap files as a stream, and operators on each frame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources import anymap

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def frames(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """Cells of every image that appears in a folder, per_trigger files a micro-batch: anymap.PX and the file's time."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(folder)

    def run(batches):
        for pdf in batches:
            for p, at, raw in zip(pdf.path, pdf.modificationTime, pdf.content, strict=True):
                for k, (_, samples) in enumerate(anymap.decode_all(bytes(raw))):
                    row, col = np.indices(samples.shape[:2])
                    yield pd.DataFrame({"image": p, "image_seq": k, "row": row.ravel(), "col": col.ravel(), "s": list(samples.reshape(-1, samples.shape[2])), "at": at})

    return files.select("path", "modificationTime", "content").mapInPandas(run, f"{anymap.PX}, at timestamp")


def levels_over_time(cells: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Histogram of the first plane by tumbling window of the files' time; later files than ``late`` don't count."""
    return cells.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), F.col("s")[0].alias("v")).agg(F.count("*").alias("n")).select("w.start", "w.end", "v", "n")


def each_batch(cells: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Any batch operator on the frames of every micro-batch; offsets are kept in checkpoint, so a restart goes on where it stopped."""
    return cells.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def group_of(frame: int, pattern: str = "IBBPBB") -> tuple[int, str]:
    """The group of pictures a frame is in, and its kind by the pattern."""
    return frame // len(pattern), pattern[frame % len(pattern)]
