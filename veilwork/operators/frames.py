"""Reshaping and ordering building blocks used by the other operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions.numeric import PROBS, is_integer_type, is_numeric_type, plain_text
from veilwork.functions.sizing import fits, maybe_broadcast
from veilwork.session import cut_lineage

_ROW_BITS = 33
_AGG_CHUNK = 40
#: Texts above this length are grouped by their SHA-256.
LONG_TEXT = 80
#: Bytes of cells that are counted at a time, and rows of counts that one task sorts or groups.
CHUNK_BYTES, TASK_ROWS = 64 << 20, 1_000_000


def cell(name: str) -> Column:
    """A top-level column, also when its name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def pinned(facts: DataFrame) -> DataFrame:
    """Column-level facts (a few rows per column) evaluated once, for steps that read them more than once."""
    return facts.sparkSession.createDataFrame(facts.collect(), facts.schema)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_integer_type(f.dataType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric_type(f.dataType)]


def text_cell(df: DataFrame, name: str) -> Column:
    return plain_text(cell(name), df.schema[name].dataType)


def number_cell(df: DataFrame, name: str) -> Column:
    return cell(name).cast("double")


def column_rows(df: DataFrame, columns: Sequence[str], fields) -> DataFrame:
    """One aggregate pass giving one output row per input column.

    ``fields(name)`` returns the aliased aggregate expressions of one column; wide tables are split into chunks to
    stay inside the code generator's method limit.
    """
    parts = []
    for start in range(0, len(columns), _AGG_CHUNK):
        chunk = columns[start : start + _AGG_CHUNK]
        structs = [F.struct(F.lit(c).alias("column"), *fields(c)) for c in chunk]
        parts.append(df.agg(F.array(*structs).alias("r")).select(F.inline("r")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def melt_text(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep.., column, value) with every cell as text; null cells are dropped."""
    picked = df.select(*[cell(k) for k in keep], *[text_cell(df, c).alias(c) for c in columns])
    long = picked.unpivot([cell(k) for k in keep], [cell(c) for c in columns], "column", "value")
    return long.where(F.col("value").isNotNull())


def melt_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep.., column, value) with every cell as double; null cells are dropped."""
    picked = df.select(*[cell(k) for k in keep], *[number_cell(df, c).alias(c) for c in columns])
    long = picked.unpivot([cell(k) for k in keep], [cell(c) for c in columns], "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(long: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Frequency of each value per column; partial aggregation runs before the only shuffle."""
    return long.groupBy(*keep, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def piece_counts(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), text: bool = False, tag: str | None = "column") -> DataFrame:
    """(keep.., column, value, n): frequencies inside chunks of the rows, so that a value may come in several rows.

    A task holds one chunk at a time, however many rows and different values it reads. Null and NaN cells are dropped.
    With ``text`` the cells are counted as text, long ones under their SHA-256; without a ``tag`` the column of names
    is left out.
    """
    names, kept = list(columns), list(keep)

    def shown(c: str) -> Column:
        value = text_cell(df, c)
        return F.when(F.length(value) > LONG_TEXT, F.sha2(value, 256)).otherwise(value) if text else number_cell(df, c)

    picked = df.select(*[cell(k).alias(f"_k{i}") for i, k in enumerate(kept)], *[shown(c).alias(f"_c{i}") for i, c in enumerate(names)])
    keys = [f"_k{i}" for i in range(len(kept))]
    most, label = CHUNK_BYTES, [] if tag is None else [T.StructField(tag, T.StringType())]
    fields = [T.StructField(k, picked.schema[f"_k{i}"].dataType) for i, k in enumerate(kept)]
    schema = T.StructType([*fields, *label, T.StructField("value", T.StringType() if text else T.DoubleType()), T.StructField("n", T.LongType())])
    heads = schema.names

    def tally(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for i, c in enumerate(names):
            value = table[f"_c{i}"]
            if text:
                some = pc.is_valid(value)
            else:
                # adding 0 makes one zero of both
                value = pc.add(value, 0.0)
                some = pc.fill_null(pc.invert(pc.is_nan(value)), False)
            if text or keys:
                part = pa.table([*[table[k] for k in keys], value], names=[*keys, "value"]).filter(some)
                found = part.group_by([*keys, "value"], use_threads=False).aggregate([([], "count_all")])
            else:
                ordered = np.sort(value.filter(some).to_numpy())
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
                found = pa.table([pa.array(ordered[first]), pa.array(np.diff(first, append=len(ordered)))], names=["value", "count_all"])
            own = [] if tag is None else [pa.repeat(pa.scalar(c, pa.string()), found.num_rows)]
            yield from pa.table([*[found[k] for k in keys], *own, found["value"], found["count_all"]], names=heads).combine_chunks().to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield from tally(held)
                held, size = [], 0
        if held:
            yield from tally(held)

    return picked.mapInArrow(count, schema)


def task_count(df: DataFrame) -> int:
    """Partitions for sorting or grouping a written table: enough for all cores, and at most ``TASK_ROWS`` rows in each."""
    rows = df.count()
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // 20_000), -(-rows // TASK_ROWS))


def whole_counts(pieces: DataFrame) -> DataFrame:
    """Counts of which each (key.., n) comes once, from written counts of chunks; no task groups more than its share."""
    keys = [c for c in pieces.columns if c not in ("n", "n_o", "n_s")]
    sums = [F.sum(c).alias(c) for c in pieces.columns if c not in keys]
    return pieces.repartition(task_count(pieces), *keys).groupBy(*keys).agg(*sums)


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    weights: Sequence[str],
    totals: bool = False,
    merge: bool = False,
) -> DataFrame:
    """Add ``before_<w>``: the sum of weight ``w`` over the rows that precede in ``order`` within ``groups``.

    The rows are range-sorted across the cluster and every sorted partition adds up its weights as they stream by, so
    no task holds a group. The sums of each group in each partition (one row per pair; a group lies in neighbouring
    partitions) give the offsets. The sorted rows are written first so that both reads see the same partitions.
    With ``totals`` the sum of the whole group comes along as ``total_<w>``, and its rows as ``total_rows``. With ``merge``
    rows that agree in ``groups`` and ``order`` become one row of their summed weights. Rows with a null group are left out.

    The rows are written before they are sorted, so that their number sets the number of tasks.
    """
    names, keys = list(weights), ["_part", *groups]
    frozen, offsets = _sorted_sums(df, groups, order, weights, merge)
    # written, so that its true size decides on the broadcast
    offsets = cut_lineage(offsets.select(*keys, *[f"_off_{x}" for x in names], *([*[f"total_{x}" for x in names], "total_rows"] if totals else [])))
    return frozen.join(maybe_broadcast(offsets), keys).select(
        *[cell(c) for c in df.columns],
        *[(F.col(f"_run_{x}") + F.col(f"_off_{x}")).alias(f"before_{x}") for x in names],
        *([*[f"total_{x}" for x in names], "total_rows"] if totals else []),
    )


def _sorted_sums(df: DataFrame, groups: Sequence[str], order: Sequence[str], weights: Sequence[str], merge: bool) -> tuple[DataFrame, DataFrame]:
    """The written sorted rows with ``_part`` and the sums ``_run_<w>`` inside the partition, and a row per partition and
    group: what to add to them (``_off_<w>``), their first value, the sum of the piece and the totals of the group."""
    names, keys, places = list(weights), ["_part", *groups], [*groups, *order]
    real = {x for x in names if isinstance(df.schema[x].dataType, (T.DoubleType, T.FloatType))}
    added = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType(), False)])
    for x in names:
        added = added.add(f"_run_{x}", T.DoubleType() if x in real else T.LongType())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # equal rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for k in places:
                column = batch.column(batch.schema.get_field_index(k))
                a, b = column.slice(1), column.slice(0, len(column) - 1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                new[1:] |= ~same.to_numpy(zero_copy_only=False)
            starts, columns = np.flatnonzero(new), []
            for x in batch.schema.names:
                column = batch.column(batch.schema.get_field_index(x))
                if x in names:
                    columns.append(pa.array(np.add.reduceat(column.fill_null(0).to_numpy(zero_copy_only=False), starts), column.type))
                else:
                    columns.append(column.take(pa.array(starts)))
            found = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            last = found.slice(found.num_rows - 1)
            yield found.slice(0, found.num_rows - 1)
        if last is not None:
            yield last

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = dict.fromkeys(names, 0)
        for batch in merged(batches) if merge else batches:
            columns = [*batch.columns]
            for x in names:
                w = batch.column(batch.schema.get_field_index(x)).cast(pa.float64() if x in real else pa.int64())
                w = w.fill_null(0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(np.concatenate([[sums[x]], w]).astype(w.dtype))
                sums[x] = upto[-1]
                columns.append(pa.array(upto[:-1]))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[f"_run_{x}" for x in names]])

    stored = cut_lineage(df)
    ranged = stored.repartitionByRange(task_count(stored), *places).sortWithinPartitions(*places)
    sorted_rows = ranged.withColumn("_part", F.spark_partition_id())
    frozen = cut_lineage(sorted_rows.mapInArrow(add_up, added))
    pieces = frozen.groupBy(*keys).agg(*[f for x in names for f in (F.sum(x).alias(f"_sum_{x}"), F.min(f"_run_{x}").alias(f"_min_{x}"))], F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = [(F.coalesce(F.sum(f"_sum_{x}").over(earlier), F.lit(0)) - F.col(f"_min_{x}")).alias(f"_off_{x}") for x in names]
    sums = [*[F.sum(f"_sum_{x}").over(whole).alias(f"total_{x}") for x in names], F.sum("_rows").over(whole).alias("total_rows")]
    return frozen, pieces.select("*", *shift, *sums)


def range_lookup(rows: DataFrame, slot: str, ranges: DataFrame, start: str, value: str) -> DataFrame:
    """``rows`` with the column ``value`` of the range their ``slot`` lies in; a range goes on to the next one's start.

    Range starts and slots are sorted together, once, and every slot takes the last value before it; the value
    that is open at the start of a partition comes from the partitions before (one row per partition). So neither a
    range that covers most slots nor a table of very many ranges is ever expanded, and equal slots are dealt over
    partitions by the hash of their row.
    """
    data = F.struct(*[cell(c) for c in rows.columns])
    nothing = F.lit(None)
    starts = ranges.select(cell(start).cast("long").alias("_slot"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"), cell(value).alias("_value"))
    asked = rows.select(cell(slot).cast("long").alias("_slot"), F.lit(1).alias("_kind"), F.xxhash64(*[cell(c) for c in rows.columns]).alias("_tie"), data.alias("_row"))
    both = starts.withColumn("_row", nothing.cast(asked.schema["_row"].dataType)).unionByName(
        asked.withColumn("_value", nothing.cast(starts.schema["_value"].dataType))
    )
    frozen = cut_lineage(both.orderBy("_slot", "_kind", "_tie").withColumn("_at", F.monotonically_increasing_id()))
    frozen = frozen.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    latest = frozen.groupBy("_part").agg(F.max_by("_value", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_open"))
    opened = latest.select("_part", F.last("_open", ignorenulls=True).over(across).alias("_open"))
    filled = frozen.join(F.broadcast(opened), "_part").withColumn("_value", F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_open")))
    return filled.where("_kind = 1").select(*[F.col("_row").getField(c).alias(c) for c in rows.columns], F.col("_value").alias(value))


def exact_quantiles(
    counts: DataFrame,
    groups: Sequence[str],
    probs: Iterable[float] = PROBS,
) -> DataFrame:
    """Linear-interpolation quantiles per group from value counts (groups.., value double, n long).

    A value may come in several rows. Returns groups plus ``total``, ``distinct`` and the array ``q``. The two order
    statistics of every level are found from running totals over the pre-aggregated values, so no task ever holds a
    whole column; only rows that may hold one of them are grouped.
    """
    probs = list(probs)
    if not groups:
        return exact_quantiles(counts.withColumn("_all", F.lit(0)), ["_all"], probs).drop("_all")
    frozen, offsets = _sorted_sums(counts.select(*groups, "value", "n"), groups, ["value"], ["n"], True)
    wanted = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("total_n") - 1)
        wanted += [F.struct(F.lit(f"lo{i}").alias("_pick"), F.floor(at).alias("_at")), F.struct(F.lit(f"hi{i}").alias("_pick"), F.ceil(at).alias("_at"))]
    # a row per level and side, only in the partition that holds it
    inside = (F.col("_at") - F.col("_off_n")).alias("_at")
    asked = offsets.select("_part", *groups, "total_n", "total_rows", "_off_n", "_min_n", "_sum_n", F.inline(F.array(*wanted)))
    asked = asked.select("_part", *groups, "total_n", "total_rows", "_min_n", "_sum_n", "_pick", inside)
    asked = cut_lineage(asked.where((F.col("_min_n") <= F.col("_at")) & (F.col("_at") < F.col("_min_n") + F.col("_sum_n"))).drop("_min_n", "_sum_n"))
    hits = frozen.join(maybe_broadcast(asked), ["_part", *groups]).where((F.col("_run_n") <= F.col("_at")) & (F.col("_at") < F.col("_run_n") + F.col("n")))
    picks = [F.max(F.when(F.col("_pick") == f"{side}{i}", F.col("value"))).alias(f"{side}{i}") for i in range(len(probs)) for side in ("lo", "hi")]
    found = hits.groupBy(*groups).agg(F.first("total_n").alias("total"), F.first("total_rows").alias("distinct"), *picks)
    levels = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("total") - 1)
        levels.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (at - F.floor(at)))
    return found.select(*groups, "total", "distinct", F.array(*levels).alias("q"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct) of the cells' texts. Long cells are grouped by their SHA-256 so that whole texts never travel.

    Doubles that are written out in full are grouped as numbers; only those near zero or large need their text.
    """
    real = [c for c in columns if isinstance(df.schema[c].dataType, T.DoubleType)]
    rest = [c for c in columns if c not in real]
    parts = []
    if rest:
        short = F.when(F.length("value") > LONG_TEXT, F.sha2("value", 256)).otherwise(F.col("value"))
        parts.append(melt_text(df, rest).select("column", short.alias("value")).distinct())
    if real:
        long = df.select(*[cell(c) for c in real]).unpivot([], [cell(c) for c in real], "column", "value").where("value is not null")
        # below the lower limit, cells may be rounded to one text; from the upper one on, texts have an exponent
        plain = F.abs("value").between(0.0011, 9_999_999)
        text = F.when(~plain, plain_text(F.col("value"), T.DoubleType()))
        keys = long.select("column", F.when(plain, F.col("value")).alias("value"), text.alias("text"))
        parts.append(keys.distinct())
    return reduce(DataFrame.union, [p.select("column") for p in parts]).groupBy("column").agg(F.count("*").alias("distinct"))


def hot_keys(left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., _share) of keys with more than 1/1000 of a one-in-16 sample of the rows: at most 1000, evaluated once."""
    part = left.select(*keys).sample(1 / 16, seed=1)
    counts = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = part.groupBy().agg(F.count(F.lit(1))).scalar()
    return pinned(counts.where(F.col("_n") * 1000 > total).select(*keys, (F.col("_n") / total).alias("_share")))


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, hot: DataFrame | None = None) -> DataFrame:
    """Equi-join of a possibly skewed ``left`` with a ``right`` that has one row per key.

    Rows of hot keys (given with their share, at most 1000 and evaluated, or found in a sample; missing one costs time,
    never rows) are split by a hash of the row, which a repeated task finds again, into parts of half an even partition;
    the matching right rows are repeated once per part. All other rows take the plain join. Null keys match nothing.
    """
    keys = list(keys)
    if fits(right, 8 << 20):
        return left.join(F.broadcast(right), keys, how)
    hot = hot_keys(left, keys) if hot is None else hot
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = (F.ceil(F.col("_share") * 2 * width) + 1).cast("int")
    hashed = [cell(f.name) for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.when(F.col("_share").isNotNull(), F.pmod(F.xxhash64(*hashed), parts)).otherwise(0).cast("int")
    marked = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt)
    copies = F.when(F.col("_share").isNotNull(), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies)).drop("_share")
    return marked.join(repeated, keys + ["_salt"], how).drop("_salt", "_share")


def rising_columns(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, rising): whether each numeric column never decreases in key order, without a one-task sort.

    Each range-sorted partition reports its first and last value and whether it is sorted inside; only those
    few rows (one per partition and column) are compared across partitions.
    """
    names = list(columns)
    ordered = df.select(cell(key).alias("_key"), *[number_cell(df, c).alias(c) for c in names])
    ordered = ordered.orderBy("_key")

    def edges(batches):
        state: dict[str, list] = {}
        first_key = None
        for pdf in batches:
            if not len(pdf):
                continue
            if first_key is None:
                first_key = pdf["_key"].iloc[0]
            for c in names:
                s = pdf[c].dropna()
                if not len(s):
                    continue
                ok = bool(s.is_monotonic_increasing)
                if c in state:
                    first, last, before = state[c]
                    state[c] = [first, float(s.iloc[-1]), before and ok and last <= float(s.iloc[0])]
                else:
                    state[c] = [float(s.iloc[0]), float(s.iloc[-1]), ok]
        rows = [(c, first_key, v[0], v[1], v[2]) for c, v in state.items()]
        yield pd.DataFrame(rows, columns=["column", "first_key", "head", "tail", "sorted"])

    key_type = ordered.schema["_key"].dataType.simpleString()
    parts = ordered.mapInPandas(
        edges, f"column string, first_key {key_type}, head double, tail double, sorted boolean"
    )
    w = Window.partitionBy("column").orderBy("first_key")
    joined = parts.withColumn("_prev", F.lag("tail").over(w))
    fine = F.col("sorted") & (F.col("_prev").isNull() | (F.col("_prev") <= F.col("head")))
    return joined.groupBy("column").agg(F.min(fine).alias("rising"))
