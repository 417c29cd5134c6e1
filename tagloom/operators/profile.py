"""Column profile of record files: one range sort gives exact distincts, ranges, quantiles and Kolmogorov-Smirnov
distances between the loads of a library.

1. Records are made distinct, unpivoted to (file, column, value), counted within their buckets and written, so that the range sort,
   which reads its input twice, repeats none of it.
2. The counted values are range-sorted by (group, column, value). A group is a library's loads in order, cut every
   ``LOADS`` loads, with the last load of the cut before as context, so the state kept for a group is bounded.
   A value's rows, at most one for each file and bucket, lie in one partition.
3. Each sorted partition is walked once. Groups that lie wholly in it come out with their profile. The first and last
   group of a partition may go on in another; of these every value comes out with the cumulative counts in this
   partition of its own file and of the loads beside it.
4. Counts by partition, summed up in partition order, turn these into cumulative counts over all partitions, from
   which quantiles and distances are taken. There are at most two such groups of ``LOADS + 1`` files a partition.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.unsigned import ukey
from tagloom.operators.distinct import distinct_records
from tagloom.operators.sorted_walk import whole_groups
from tagloom.session import small, written

#: Loads of one library that are profiled together.
LOADS = 64
#: Shares of the non-null values at which quantiles are taken; a quantile is the least value that reaches the share.
QUANTILES = (0.25, 0.5, 0.75)
#: Classes by the lowest 4 bits.
CLASSES = 16
#: Values by the bases they need: 0 for zero, else half their bits, rounded up.
WIDTHS = 33

_STATS = (
    "n_values bigint, n_distinct bigint, min_value bigint, max_value bigint, quantiles array<bigint>, "
    "classes array<bigint>, widths array<bigint>, ks double"
)
_OUT = (
    f"kind int, pid int, gid bigint, c int, o int, {_STATS}, "
    "v bigint, n bigint, upto bigint, before_upto bigint, after_upto bigint"
)


def files_of(records: DataFrame, headers: DataFrame) -> DataFrame:
    """The files that have records, with their place among the loads of their library.

    ``file_id, library_id, load_no, bc_len, umi_len, gid, o, next_gid``: ``gid`` names the group of loads, ``o`` counts from 1
    in it; ``next_gid`` is the group in which the file is the context (``o`` 0), null for most. Repeated header rows
    count once; of rows that differ, the greatest by (library_id, load_no, bc_len, umi_len) holds. A file without header or
    library stands alone. Equal ``load_no`` are ordered by ``file_id``, null comes first.
    """
    there = records.select("file_id").dropna().distinct()
    heads = (
        headers.select("file_id", F.struct("library_id", "load_no", "bc_len", "umi_len").alias("__h"))
        .groupBy("file_id")
        .agg(F.max("__h").alias("__h"))
        .select("file_id", "__h.*")
    )
    lone = F.when(F.col("library_id").isNull(), F.col("file_id"))
    loads = Window.partitionBy("library_id", lone).orderBy("load_no", "file_id")
    ranked = there.join(heads, "file_id", "left").select(
        "*", (F.row_number().over(loads) - 1).alias("__r"), F.lead("file_id").over(loads).alias("__next")
    )
    group = F.first("file_id").over(
        Window.partitionBy("library_id", lone, F.floor(F.col("__r") / LOADS))
        .orderBy("__r")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = (F.col("__r") % LOADS == LOADS - 1) & F.col("__next").isNotNull()
    return ranked.select(
        "file_id", "library_id", "load_no", "bc_len", "umi_len",
        group.alias("gid"),
        (F.col("__r") % LOADS + 1).cast("int").alias("o"),
        F.when(last, F.col("__next")).alias("next_gid"),
    )


def _counts_to(values: np.ndarray, cum: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of sorted distinct ``values`` with cumulative counts ``cum``: the count of values up to each of ``at``."""
    place = np.searchsorted(values, at, "right")
    return np.where(place > 0, cum[place - 1], 0) if len(cum) else np.zeros(len(at), np.int64)


def walk_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 over one sorted partition of (gid, c, v, o, n, nil), ``v`` as unsigned key; ``nil`` marks counts of nulls.

    Rows out by ``kind``: 0 profiles, 1 values of groups that may go on elsewhere, 2 counts of nulls.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    names = [f.partition(" ")[0] for f in _OUT.split(", ")]
    types = {"kind": pa.int32(), "pid": pa.int32(), "c": pa.int32(), "o": pa.int32(), "ks": pa.float64()}
    types |= dict.fromkeys(("quantiles", "classes", "widths"), pa.list_(pa.int64()))
    schema = pa.schema([(x, types.get(x, pa.int64())) for x in names])

    def loads_of(v: np.ndarray, o: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By load: sorted distinct values, unsigned, and cumulative counts."""
        order = np.argsort(o, kind="stable")
        v, o, n = v[order], o[order], n[order]
        cuts = np.flatnonzero(np.diff(o)) + 1
        out = {}
        for lo, hi in zip((0, *cuts), (*cuts, len(o))):
            mine, counts = v[lo:hi], np.cumsum(n[lo:hi])
            ends = np.append(np.flatnonzero(mine[1:] != mine[:-1]), len(mine) - 1)
            out[int(o[lo])] = (mine[ends], counts[ends])
        return out

    def whole(gid: int, c: int, v: np.ndarray, o: np.ndarray, n: np.ndarray, rows: list[dict]) -> None:
        loads = loads_of(v, o, n)
        for k, (values, cum) in loads.items():
            if k == 0:
                continue
            total, own = int(cum[-1]), np.diff(cum, prepend=0)
            ks = None
            if k - 1 in loads:
                other, other_cum = loads[k - 1]
                ks = max(
                    np.abs(cum / total - _counts_to(other, other_cum, values) / other_cum[-1]).max(),
                    np.abs(_counts_to(values, cum, other) / total - other_cum / other_cum[-1]).max(),
                )
            ranks = [max(1, int(np.ceil(q * total))) for q in QUANTILES]
            rows.append({
                "kind": 0, "pid": pid, "gid": gid, "c": c, "o": k, "n_values": total, "n_distinct": len(values),
                "min_value": values[0].view(np.int64).item(), "max_value": values[-1].view(np.int64).item(),
                "quantiles": values[np.searchsorted(cum, ranks)].view(np.int64).tolist(),
                "classes": np.bincount((values & np.uint64(15)).astype(np.int64), own, CLASSES).astype(np.int64).tolist(),
                "widths": np.bincount(widths_of(values), own, WIDTHS).astype(np.int64).tolist(),
                "ks": None if ks is None else float(ks),
            })

    def parts(gid: int, c: int, v: np.ndarray, o: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        loads = loads_of(v, o, n)
        columns: dict[str, list[np.ndarray]] = {x: [] for x in ("o", "v", "n", "upto", "before_upto", "after_upto")}
        none = (np.empty(0, np.uint64), np.empty(0, np.int64))
        for k, (values, cum) in loads.items():
            columns["o"].append(np.full(len(values), k, np.int32))
            columns["v"].append(values.view(np.int64))
            columns["n"].append(np.diff(cum, prepend=0))
            columns["upto"].append(cum)
            columns["before_upto"].append(_counts_to(*loads.get(k - 1, none), values))
            columns["after_upto"].append(_counts_to(*loads.get(k + 1, none), values))
        size = sum(map(len, columns["o"]))
        fixed = {"kind": 1, "pid": pid, "gid": gid, "c": c}
        made = {x: pa.array(np.full(size, fixed[x])).cast(schema.field(x).type) for x in fixed}
        made |= {x: pa.array(np.concatenate(columns[x])) for x in columns}
        return pa.RecordBatch.from_arrays([made.get(x, pa.nulls(size, schema.field(x).type)) for x in names], schema=schema)

    def widths_of(values: np.ndarray) -> np.ndarray:
        limits = np.array([1 << (2 * i) for i in range(32)], dtype=np.uint64)
        return np.searchsorted(limits, values, "right")

    def work(held: list[np.ndarray], first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        gid, c, v, o, n, nil = held
        rows: list[dict] = []
        if nil.any():
            absent = {}
            for key, count in zip(zip(gid[nil].tolist(), c[nil].tolist(), o[nil].tolist()), n[nil].tolist()):
                absent[key] = absent.get(key, 0) + count
            rows += [{"kind": 2, "pid": pid, "gid": g, "c": k, "o": x, "n": count} for (g, k, x), count in absent.items()]
            gid, c, v, o, n = (x[~nil] for x in (gid, c, v, o, n))
        v = v.view(np.uint64) ^ np.uint64(1 << 63)
        cuts = np.flatnonzero((gid[1:] != gid[:-1]) | (c[1:] != c[:-1])) + 1
        edges = list(zip((0, *cuts), (*cuts, len(gid)))) if len(gid) else []
        for i, (lo, hi) in enumerate(edges):
            args = (int(gid[lo]), int(c[lo]), v[lo:hi], o[lo:hi], n[lo:hi])
            if (first and i == 0) or (last and i == len(edges) - 1):
                yield parts(*args)
            else:
                whole(*args, rows)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    for held, first, last in whole_groups(batches, [0, 1]):
        yield from work(held, first, last)


def _merge_parts(walked: DataFrame) -> DataFrame:
    """Step 4: profiles of the groups that lie in more than one partition, or could."""
    parts = walked.where("kind = 1").select("pid", "gid", "c", "o", "v", "n", "upto", "before_upto", "after_upto")
    local = parts.groupBy("gid", "c", "o", "pid").agg(F.sum("n").alias("n"))
    # Every file of a group gets a row for every partition of the group, with 0 where it has no value there.
    places = local.select("gid", "c", "pid").distinct()
    members = local.select("gid", "c", "o").distinct()
    grid = places.join(members, ["gid", "c"]).join(local, ["gid", "c", "o", "pid"], "left").fillna(0, ["n"])
    file = Window.partitionBy("gid", "c", "o")
    offsets = grid.select(
        "gid", "c", "o", "pid",
        F.sum("n").over(file).alias("total"),
        (F.sum("n").over(file.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("skip"),
    )
    offsets = written(offsets)
    n_offsets = offsets.count()

    def beside(step: int, tag: str) -> DataFrame:
        moved = offsets.select(
            "gid", "c", (F.col("o") + step).alias("o"), "pid", F.col("total").alias(f"{tag}_total"), F.col("skip").alias(f"{tag}_skip")
        )
        return small(moved, n_offsets)

    # At most 2 * (LOADS + 1) rows a partition.
    at = parts.join(beside(0, "own"), ["gid", "c", "o", "pid"])
    at = at.join(beside(1, "before"), ["gid", "c", "o", "pid"], "left").join(beside(-1, "after"), ["gid", "c", "o", "pid"], "left")
    rank = F.col("own_skip") + F.col("upto")
    share = rank / F.col("own_total")
    gap = {
        tag: F.abs(share - (F.col(f"{tag}_skip") + F.col(f"{tag}_upto")) / F.col(f"{tag}_total")) for tag in ("before", "after")
    }
    low = ukey(F.col("v"))
    quantiles = []
    for q in QUANTILES:
        want = F.greatest(F.ceil(F.col("own_total") * F.lit(q)), F.lit(1))
        quantiles.append(F.min(F.when(rank >= want, low)))
    width = F.ceil((F.lit(64) - _leading_zeros(F.col("v"))) / 2)
    own = at.groupBy("gid", "c", "o").agg(
        F.sum("n").alias("n_values"),
        F.count(F.lit(1)).alias("n_distinct"),
        ukey(F.min(low)).alias("min_value"),
        ukey(F.max(low)).alias("max_value"),
        F.array(*(ukey(q) for q in quantiles)).alias("quantiles"),
        F.array(*(F.sum(F.when(F.col("v").bitwiseAND(F.lit(15)) == i, F.col("n")).otherwise(0)) for i in range(CLASSES))).alias("classes"),
        F.array(*(F.sum(F.when(width == i, F.col("n")).otherwise(0)) for i in range(WIDTHS))).alias("widths"),
        F.max(gap["before"]).alias("ks_own"),
    )
    follow = at.where("after_total is not null").groupBy("gid", "c", (F.col("o") + 1).alias("o")).agg(F.max(gap["after"]).alias("ks_next"))
    return (
        own.join(follow, ["gid", "c", "o"], "left")
        .where("o > 0")
        .select("gid", "c", "o", *(x.partition(" ")[0] for x in _STATS.split(", ")[:-1]), F.greatest("ks_own", "ks_next").alias("ks"))
    )


def _leading_zeros(v: Column) -> Column:
    return F.lit(64) - F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def profile_files(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Profile of ``barcode`` and ``umi`` of every file that has records.

    ``file_id, column_name, library_id, load_no, declared_len, n_records, n_nulls, n_values, n_distinct, min_value, max_value,
    quantiles, classes, n_too_wide, prev_file_id, ks, class_shift``. Records count once however often delivered. Minimum, maximum
    and quantiles are unsigned values as BIGINT bits, null without values. ``declared_len`` is ``bc_len`` or ``umi_len``;
    ``n_too_wide`` counts values of more bases than that, null unless it is 1 to 32. ``prev_file_id`` is the file before
    of the library (next lower ``load_no`` that has records); ``ks`` is the Kolmogorov-Smirnov distance of the values to
    it, ``class_shift`` half the summed differences of the shares of values by their lowest 4 bits; both are null without values
    on either side. Rows with a null ``file_id`` belong to no file and are left out. Empty tables give no rows.
    """
    files = written(files_of(records, headers))
    n_files = files.count()
    base = distinct_records(records.where("file_id is not null"), "barcode", "umi")
    pairs = F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("barcode").alias("v")), F.struct(F.lit(1).alias("c"), F.col("umi").alias("v"))))
    counted = (
        base.select("file_id", "bucket", pairs.alias("__p"))
        .select("file_id", "bucket", "__p.*")
        .groupBy("bucket", "file_id", "c", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    homes = files.select("file_id", "gid", "o").unionByName(
        files.where("next_gid is not null").select("file_id", F.col("next_gid").alias("gid"), F.lit(0).alias("o"))
    )
    entries = written(
        counted.join(small(homes, n_files * 2), "file_id").select(
            "gid", "c", F.coalesce(ukey("v"), F.lit(-(1 << 63))).alias("v"), "o", "n", F.col("v").isNull().alias("nil")
        )
    )
    partitions = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(partitions, "gid", "c", "v").sortWithinPartitions("gid", "c", "v")
    walked = written(ordered.mapInArrow(walk_sorted, _OUT))
    nulls = walked.where("kind = 2 and o > 0").groupBy("gid", "c", "o").agg(F.sum("n").alias("n_nulls"))
    stats = walked.where("kind = 0").select("gid", "c", "o", *(x.partition(" ")[0] for x in _STATS.split(", ")))
    stats = stats.unionByName(_merge_parts(walked))
    both = F.explode(F.array(*(
        F.struct(
            F.lit(i).alias("c"), F.lit(name).alias("column_name"), F.col(length).alias("declared_len")
        )
        for i, (name, length) in enumerate((("barcode", "bc_len"), ("umi", "umi_len")))
    )))
    rows = (
        files.select("file_id", "library_id", "load_no", "gid", "o", both.alias("__c"))
        .select("file_id", "library_id", "load_no", "gid", "o", "__c.*")
        .join(stats, ["gid", "c", "o"], "left")
        .join(nulls, ["gid", "c", "o"], "left")
        .fillna(0, ["n_values", "n_distinct", "n_nulls"])
    )
    lone = F.when(F.col("library_id").isNull(), F.col("file_id"))
    loads = Window.partitionBy("library_id", lone, "c").orderBy("load_no", "file_id")
    rows = rows.withColumn("prev_file_id", F.lag("file_id").over(loads)).withColumn("__prev", F.lag("classes").over(loads))
    shares = lambda counts: F.transform(counts, lambda x: x / F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b))
    shift = F.aggregate(
        F.zip_with(shares(F.col("classes")), shares(F.col("__prev")), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b
    ) / 2
    wide = F.aggregate(F.slice("widths", F.col("declared_len") + 2, WIDTHS), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return rows.select(
        "file_id", "column_name", "library_id", "load_no", "declared_len",
        (F.col("n_values") + F.col("n_nulls")).alias("n_records"), "n_nulls", "n_values", "n_distinct",
        "min_value", "max_value", "quantiles", "classes",
        F.when(F.col("declared_len").between(1, 32), F.coalesce(wide, F.lit(0))).cast("bigint").alias("n_too_wide"),
        "prev_file_id", "ks", shift.alias("class_shift"),
    )
