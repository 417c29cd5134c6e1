"""Records counted once however often they were delivered."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the records of one file that stay together.
BLOCK_BITS = 12


def distinct_records(records: DataFrame, *columns: str) -> DataFrame:
    """One row for each record, with ``columns``: ``file_id, bucket, rec_no, *columns``.

    A record is a (``file_id``, ``rec_no``). Deliveries of a record are equal; rows without position, or against the rule, that differ in
    ``columns`` are different records. A null ``file_id`` or ``rec_no`` is a value like others. Other columns of ``records``
    are left out.

    One shuffle, by ``bucket``, which is the number of the partition: blocks of ``2**BLOCK_BITS`` positions are spread over as many buckets
    as there are shuffle partitions, so a file that holds most of the rows spreads as well. A later grouping by bucket, file and value
    needs no shuffle and leaves at most as many rows of a file's value as there are partitions, whatever the data.
    """
    buckets = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.shiftright(F.col("rec_no").cast("bigint"), BLOCK_BITS)
    bucket = F.pmod(F.xxhash64("file_id", block), F.lit(buckets)).cast("int").alias("bucket")
    return records.select("file_id", bucket, "rec_no", *columns).repartitionById(buckets, F.col("bucket")).distinct()
