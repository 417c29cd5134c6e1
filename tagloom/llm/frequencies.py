"""Occurrence and holder counts of all terms up to a length, from a distributed suffix array.

The suffixes of all token sequences, cut to ``n`` tokens, are range-sorted: the partitions together are the suffix array.
Neighbours that agree in their first k tokens form the common-prefix intervals of the k-grams. An interval's
weights add up to the k-gram's occurrences; its rows, less the rows whose sequence occurred before within the interval, are the
sequences that hold it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.distinct import distinct_records
from tagloom.operators.sorted_walk import whole_groups
from tagloom.session import written


def _intervals(n: int, token: pa.DataType, field: pa.DataType):
    """The walk over a sorted partition of (t1, field, t2.., tn, there2.., theren, doc, nodoc, weight)."""
    grams = [f"t{k + 1}" for k in range(n)]
    schema = pa.schema(
        [
            ("field", field), ("n", pa.int32()), *((g, token) for g in grams), ("edge_doc", pa.int64()), ("is_edge", pa.bool_()),
            ("is_doc", pa.bool_()), ("occurrences", pa.int64()), ("holders", pa.int64()),
        ]
    )

    def told_apart(docs: np.ndarray, null: np.ndarray) -> np.ndarray:
        """``docs`` with a number of its own for null."""
        if not null.any():
            return docs
        free = next(i for i in range(len(docs) + 1) if not (docs[~null] == i).any())
        return np.where(null, free, docs)

    def rows_before(docs: np.ndarray) -> np.ndarray:
        """Of each row the place of the row before of the same sequence, or -1; in the order of the deepest interval that is the neighbour."""
        before = np.full(len(docs), -1)
        if n == 1:
            same = np.flatnonzero(docs[1:] == docs[:-1])
            before[same + 1] = same
        else:
            by_doc = np.argsort(docs, kind="stable")
            same = docs[by_doc][1:] == docs[by_doc][:-1]
            before[by_doc[1:][same]] = by_doc[:-1][same]
        return before

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, first, last in whole_groups(batches, [0, 1]):
            tokens = [columns[0], *columns[2 : 1 + n]]
            there = [np.ones(len(tokens[0]), bool), *(x.astype(bool) for x in columns[1 + n : 2 * n])]
            fields, null, weights = columns[1], columns[-2].astype(bool), columns[-1]
            docs = told_apart(columns[-3], null)
            rows = len(docs)
            before = rows_before(docs)
            agree = np.append(False, fields[1:] == fields[:-1])
            for k in range(n):
                agree = agree & np.append(False, (tokens[k][1:] == tokens[k][:-1]) & there[k][1:] & there[k][:-1])
                starts = np.flatnonzero(~agree)
                ends = np.append(starts[1:], rows)
                held = np.add.reduceat((before < np.repeat(starts, ends - starts)).astype(np.int64), starts)
                total = np.add.reduceat(weights, starts)
                real = there[k][starts]
                open_ = (first & (starts == 0)) | (last & (ends == rows))
                edge_at: list[int] = []
                for lo, hi in zip(starts[open_ & real], ends[open_ & real]):
                    # An interval that may go on in the next partition: its sequences at the border come out by themselves.
                    inside = np.unique(docs[lo:hi], return_index=True)[1] + lo if k < n - 1 else np.unique([lo, hi - 1])
                    if k == n - 1 and docs[lo] == docs[hi - 1]:
                        inside = inside[:1]
                    held[np.searchsorted(starts, lo)] -= len(inside)
                    edge_at += inside.tolist()
                at = np.concatenate([starts[real], np.array(edge_at, np.int64)])
                extra = np.zeros(len(edge_at), np.int64)
                is_doc = np.append(np.zeros(real.sum(), bool), np.ones(len(edge_at), bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fields[at], field),
                        pa.array(np.full(len(at), k + 1, np.int32)),
                        *(pa.array(tokens[j][at], token) if j <= k else pa.nulls(len(at), token) for j in range(n)),
                        pa.array(docs[at], pa.int64(), mask=~is_doc | null[at]),
                        pa.array(np.append(open_[real], is_doc[real.sum() :])),
                        pa.array(is_doc),
                        pa.array(np.append(total[real], extra)),
                        pa.array(np.append(held[real], extra)),
                    ],
                    schema=schema,
                )

    return walk


def suffix_frequencies(suffixes: DataFrame, n: int = 1) -> DataFrame:
    """Of every k-gram, k up to ``n``: ``field, n, t1..tn, occurrences, holders``.

    ``suffixes`` has a row for each place of each sequence, or several equal ones of one sequence as one row:
    ``field`` (kinds of sequences, counted apart), ``t1..tn`` (the tokens from the place on, null past the sequence's end),
    ``doc`` (the sequence, bigint; null is a sequence like others), ``weight`` (places the row stands for). Rows without ``t1`` or
    ``field`` are left out. All rows of a k-gram may lie in any number of partitions; what may go on in another one is merged by k-gram.

    Suffixes are written before they are sorted, as a range sort reads its input twice. The sort key names the sequence as well, so that
    a term, however frequent, is cut between partitions.
    """
    spark = suffixes.sparkSession
    grams = [f"t{k + 1}" for k in range(n)]
    kinds = {f.name: f.dataType for f in suffixes.schema.fields}
    order = ["t1", "field", *grams[1:], "doc"]
    ready = suffixes.select("field", *grams, F.col("doc").cast("bigint"), F.col("weight").cast("bigint")).dropna(subset=["t1", "field"])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    there = (F.col(g).isNotNull().alias(f"there_{g}") for g in grams[1:])
    array = written(ready).repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("t1", "field", *grams[1:], *there, "doc", F.col("doc").isNull().alias("nodoc"), "weight")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    token, field = (kinds[c].simpleString() for c in ("t1", "field"))
    out = (
        f"field {field}, n int, " + "".join(f"{g} {token}, " for g in grams)
        + "edge_doc bigint, is_edge boolean, is_doc boolean, occurrences bigint, holders bigint"
    )
    walked = written(array.mapInArrow(_intervals(n, arrow[token], arrow[field]), out))
    names = ["field", "n", *grams]
    inner = walked.where("not is_edge").select(*names, "occurrences", "holders")
    edges = (
        walked.where("is_edge")
        .groupBy(*names, "is_doc", "edge_doc")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("holders").alias("holders"))
        .groupBy(*names)
        .agg(F.sum("occurrences").alias("occurrences"), (F.sum("holders") + F.count_if("is_doc")).alias("holders"))
    )
    return inner.unionByName(edges)


def text_suffixes(df: DataFrame, doc: str, tokens: str, n: int, field: str = "text") -> DataFrame:
    """Suffixes, cut to ``n`` tokens, of the token array ``tokens`` of each row; null and empty arrays have none.

    The windows of a row are cut before they become rows, so that none carries the whole array.
    """
    words = F.col(f"`{tokens}`")
    windows = F.transform(
        words, lambda word, at: F.struct(word.alias("t1"), *(F.get(words, at + k).alias(f"t{k + 1}") for k in range(1, n)))
    )
    grams = [f"t{k + 1}" for k in range(n)]
    cut = df.select(F.col(f"`{doc}`").alias("doc"), F.explode(windows).alias("__w")).select("doc", "__w.*")
    return cut.select(F.lit(field).alias("field"), *grams, "doc", F.lit(1).cast("bigint").alias("weight"))


def value_frequencies(records: DataFrame, fields: tuple[str, ...] = ("barcode", "index")) -> DataFrame:
    """Of every distinct value of each of ``fields``: ``field, value, n_records, n_files``.

    Records count once however often delivered (see ``distinct_records``); nulls are no values. A null ``file_id`` is a file like
    others. A file's equal values in one bucket of records become one weighted suffix, without a shuffle.
    """
    base = distinct_records(records, *fields)
    kinds = F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"`{f}`").alias("t1")) for i, f in enumerate(fields)))
    weighted = (
        base.select("file_id", "bucket", F.explode(kinds).alias("__f"))
        .select("file_id", "bucket", "__f.*")
        .where("t1 is not null")
        .groupBy("bucket", "file_id", "field", "t1")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    out = suffix_frequencies(weighted.select("field", "t1", F.col("file_id").alias("doc"), "weight"))
    return out.select(F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1).alias("field"), F.col("t1").alias("value"), F.col("occurrences").alias("n_records"), F.col("holders").alias("n_files"))
