"""Record files that grow, as Structured Streaming sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.sources.binary import FORMAT, register


def stream_records(spark: SparkSession, path: str, header: bool = True, start: int = 0) -> DataFrame:
    """Records appended to an uncompressed file, from record ``start`` on; each comes once, an incomplete one when it is whole."""
    register(spark)
    return spark.readStream.format(FORMAT).options(header=str(header).lower(), start=str(start)).load(path)


def running_barcode_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts per barcode so far, ``barcode, n_records``, as the Parquet table ``path``, replaced after each batch; the counts stay with
    the executors and the state store, never with the driver. A batch that is repeated after a failure writes the same."""
    counts = stream.groupBy("barcode").agg(F.count(F.lit(1)).alias("n_records"))
    return (
        counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
