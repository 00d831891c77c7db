"""An inbox of document XML: every new file is extracted once, and its graph appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import extract


def watch_inbox(spark: SparkSession, inbox: str, out: str, checkpoint: str, client=None, embedder=None) -> StreamingQuery:
    """Starts a query that extracts all files now in the inbox and stops; run again, it takes the new ones.

    Each batch is written below a folder of its number, so a batch that is repeated after a failure replaces its own output.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.xml").load(inbox)
    raw = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("paper_id"), F.decode("content", "UTF-8").alias("xml"))

    def take(batch: DataFrame, number: int) -> None:
        graph, calls = extract(batch, client, embedder, folder=f"{out}/work/{number}")
        for name, df in (("entities", graph.vertices), ("relationships", graph.edges), ("calls", calls)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return raw.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
