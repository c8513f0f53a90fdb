"""Documents that arrive as a stream.

Appending to a corpus is the one operation that meets data over time. Encoding
and pair features look at one row only, so they run on a stream unchanged and
need no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rankloom.plans.durable import shared_folder
from rankloom.sources.corpus import Encoder, build_corpus


def read_documents(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of new documents as a stream."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def stream_corpus(
    documents: DataFrame, encoder: Encoder, path: str, name: str, available_now: bool = True
) -> StreamingQuery:
    """Embed streamed documents and append them to the corpus at ``path``.

    Progress is kept under the shared checkpoint folder, by ``name``, so that a
    restart goes on where it stopped and no document is embedded into the
    corpus twice.
    """
    folder = f"{shared_folder(documents.sparkSession)}/streams/{name}"
    writer = (
        build_corpus(documents, encoder).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", folder).option("path", path).queryName(name)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
