"""Ordered data: runs, gaps, grids, sessions, lookback, chunk merging, fills."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import repeated_content


#: Chunks that one task goes through in lookback.
LOOK_BLOCK = 20_000
#: Chunks that one task cuts in rechunk.
RECHUNK_BLOCK = 20_000
#: Conversations of at most so many rows are searched for change points together, of one length at a time, in arrays of at most so many numbers; so many rows are taken at once.
SHORT, SHORT_CELLS, TOGETHER = 512, 1 << 21, 100_000


def with_row_index(df: DataFrame, *order: str | Column, name: str = "index", partition: Sequence[str] = ()) -> DataFrame:
    """A 0-based index in the given order. Without a partition the rows are range-partitioned and counted, so none is ranked in one task."""
    if partition:
        return df.withColumn(name, (F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))
    from ..sources.tables import cut

    placed = cut(df.orderBy(*order).withColumn("_index_place", F.monotonically_increasing_id()), "row-index")
    part = F.shiftright("_index_place", 33).cast("int")
    counts = placed.groupBy(part.alias("_index_part")).agg(F.count("*").alias("_n"))
    starts = counts.selectExpr("_index_part", "sum(_n) over (order by _index_part) - _n as _index_start")
    # one row a partition, so broadcasting them is bounded by the number of tasks
    return placed.withColumn("_index_part", part).join(F.broadcast(starts), "_index_part").withColumn(name, F.col("_index_start") + F.col("_index_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_index_place", "_index_part", "_index_start")


def run_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], partition: Sequence[str] = (), name: str = "run") -> DataFrame:
    """Gaps and islands: a number that grows by one where any key differs from the row before (nulls are equal to each other)."""
    w = W.partitionBy(*partition).orderBy(*order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    changed = F.when(F.row_number().over(w) == 1, 1).when(same, 0).otherwise(1)
    return df.withColumn(name, F.sum(changed).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))


def squash_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], content: str, time: str, partition: Sequence[str] = ()) -> DataFrame:
    """Runs of equal rows as one: the first time, the count, and the content with how often it was sent."""
    grouped = run_ids(df, [*keys, content], order, partition).groupBy(*dict.fromkeys([*partition, "run", *keys, content]))
    out = grouped.agg(F.min(time).alias(time), F.count("*").alias("count"))
    return out.withColumn(content, repeated_content(F.col(content), F.col("count"))).drop("run")


def question_answers(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every user turn with the turn right after it if that is the assistant's, else ''."""
    w = W.partitionBy(conversation).orderBy(turn)
    answer = F.when(F.lead(role).over(w) == "assistant", F.coalesce(F.lead(text).over(w), F.lit(""))).otherwise(F.lit(""))
    return df.withColumn("answer", answer).where(F.col(role) == "user").select(conversation, turn, F.col(text).alias("question"), "answer")


def gaps(df: DataFrame, time: str, partition: Sequence[str], order: Sequence[str], name: str = "gap_s") -> DataFrame:
    """Seconds since the row before; 0 for the first."""
    w = W.partitionBy(*partition).orderBy(*order)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return df.withColumn(name, F.coalesce((micros - F.lag(micros).over(w)) / 1e6, F.lit(0.0)))


def hourly_grid(df: DataFrame, time: str, value: Column, name: str = "n", partition: Sequence[str] = ()) -> DataFrame:
    """Sums by hour on a grid without holes from the first to the last hour of each partition."""
    hours = df.groupBy(*partition, F.date_trunc("hour", time).alias("hour")).agg(F.sum(value).alias(name))
    bounds = (hours.groupBy(*partition) if partition else hours).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    grid = bounds.select(*partition, F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("hour"))
    return grid.join(hours, [*partition, "hour"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def gap_sessions(df: DataFrame, time: str, partition: Sequence[str], order: Sequence[str], gap_s: float, name: str = "session") -> DataFrame:
    """Sessions that end where the next row comes later than gap_s."""
    w = W.partitionBy(*partition).orderBy(*order)
    spaced = gaps(df, time, partition, order, "_gap")
    return spaced.withColumn(name, F.sum(F.when(F.col("_gap") > gap_s, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_gap")


def lookback(chunks: DataFrame, chunk: str = "chunk_id", start: str = "start_dt", end: str = "end_dt", partition: Sequence[str] = (), most: int = 10, always: int = 1, within: str = "INTERVAL 7 DAYS") -> DataFrame:
    """(chunk, prev, rank): earlier chunks of each by how late they ended: the latest `always`, and up to `most` that ended `within` before it starts.

    Chunks are taken in blocks in their order. The `most` latest ends of each block are merged from block to block, so each block knows those of all before it, and
    goes through its own rows with them: work grows with the chunks, not with their pairs, and no task holds more than a block or the blocks' short lists.
    """
    from ..sources.tables import cut

    types, epoch = dict(chunks.dtypes), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    micros = lambda c: F.timestamp_diff("MICROSECOND", epoch, F.col(c)) if types[c] == "timestamp_ntz" else F.unix_micros(F.col(c).cast("timestamp"))
    size = LOOK_BLOCK
    rows = with_row_index(chunks.select(*partition, F.col(chunk).alias("_c"), micros(start).alias("_s"), micros(end).alias("_e")), "_c", name="_i", partition=partition)
    rows = cut(rows.withColumn("_block", F.floor(F.col("_i") / size).cast("long")), "lookback-rows")
    kinds = dict(rows.dtypes)
    keys = "".join(f"{p} {kinds[p]}, " for p in partition)

    def latest(held: list, new: list) -> list:
        return sorted([*held, *new], key=lambda x: (-x[0], x[1]))[:most]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held, before = [], []
        for es, cs in zip(pdf.sort_values("_block")["_es"], pdf.sort_values("_block")["_cs"], strict=True):
            before.append(held)
            held = latest(held, list(zip(es, cs, strict=True)))
        out = pdf.sort_values("_block", ignore_index=True)[[*partition, "_block"]]
        return out.assign(_bes=[[x[0] for x in b] for b in before], _bcs=[[x[1] for x in b] for b in before])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in batches:
            n, prev, ends = np.zeros(len(pdf), dtype=np.int64), [], []
            for k, (i, c, e, es, cs) in enumerate(zip(pdf["_i"].tolist(), pdf["_c"].tolist(), pdf["_e"].tolist(), pdf["_bes"], pdf["_bcs"], strict=True)):
                if i % size == 0:  # a block begins
                    held = [] if es is None else [(-int(x), y) for x, y in zip(es, cs, strict=True)]
                n[k] = len(held)
                prev += [x[1] for x in held]
                ends += [-x[0] for x in held]
                if e is not None and e == e:
                    bisect.insort(held, (-int(e), c))
                    del held[most:]
            at = pdf[[*partition, "_c", "_s"]].iloc[np.repeat(np.arange(len(pdf)), n)].reset_index(drop=True)
            rank = np.arange(len(prev)) - np.repeat(np.cumsum(n) - n, n) + 1
            yield at.assign(prev=pd.Series(prev, dtype=None if prev else object), rank=rank, _pe=pd.Series(ends, dtype="int64"))

    joined = rows.withColumn("_bes", F.lit(None).cast("array<long>")).withColumn("_bcs", F.lit(None).cast(f"array<{kinds['_c']}>"))
    longer = rows.where(F.col("_i") == size).select(*partition, F.lit(True).alias("_longer"))
    if not longer.isEmpty():  # only what is longer than a block has anything to hand on
        same = lambda right: [rows[p].eqNullSafe(right[p]) for p in partition] or F.lit(True)
        ends = F.array_sort(F.collect_list(F.when(F.col("_e").isNotNull(), F.struct((-F.col("_e")).alias("e"), F.col("_c").alias("c")))))
        long = rows.join(longer, same(longer), "left_semi")
        tops = long.groupBy(*partition, "_block").agg(F.slice(ends, 1, most).alias("_t")).select(*partition, "_block", F.transform("_t", lambda x: -x["e"]).alias("_es"), F.transform("_t", lambda x: x["c"]).alias("_cs"))
        before = (tops.groupBy(*partition) if partition else tops.withColumn("_g", F.lit(0)).groupBy("_g")).applyInPandas(fold, f"{keys}_block long, _bes array<long>, _bcs array<{kinds['_c']}>")
        on = [rows["_block"] == before["_block"], *[rows[p].eqNullSafe(before[p]) for p in partition]]
        joined = rows.join(before, on, "left").select(*[rows[c] for c in rows.columns], "_bes", "_bcs")
    placed = joined.repartition(*partition, "_block").sortWithinPartitions(*partition, "_block", "_i")
    found = placed.mapInPandas(walk, f"{keys}_c {kinds['_c']}, _s long, prev {kinds['_c']}, rank long, _pe long")
    near = F.timestamp_micros("_s") - F.timestamp_micros("_pe") <= F.expr(within)
    return found.where((F.col("rank") <= always) | near).select(*partition, F.col("_c").alias(chunk), "prev", "rank")


def lookback_sorted(chunks: DataFrame, chunk: str, start: str, end: str, partition: Sequence[str], most: int = 10, always: int = 1, within: str = "INTERVAL 7 DAYS") -> DataFrame:
    """lookback for chunks whose ends grow with their ids: a window of the `most` rows before, no join."""
    w = W.partitionBy(*partition).orderBy(chunk).rowsBetween(-most, -1)
    before = F.reverse(F.array_sort(F.collect_list(F.struct(F.col(end).alias("e"), F.col(chunk).alias("c"))).over(w)))
    out = chunks.withColumn("_before", before).select(*partition, chunk, F.col(start).alias("_start"), F.posexplode("_before").alias("_k", "_p"))
    near = (F.col("_k") < always) | (F.col("_start") - F.col("_p.e") <= F.expr(within))
    return out.where(near).select(*partition, chunk, F.col("_p.c").alias("prev"), (F.col("_k") + 1).cast("long").alias("rank"))


def rechunk(chunks: DataFrame, least: int, chunk: str = "chunk_id", size: str = "n", order: str = "earliest", partition: Sequence[str] = ()) -> DataFrame:
    """(chunk, new_chunk): chunks below `least` flow into the next one until it is large enough; the last one stays.

    Chunks are taken in blocks in their order. What a block leaves open depends on what comes in alone, and only through where its first cut then falls, so a
    block is summed up as that function; the functions are applied one after the other, and every block is cut on its own with what comes in. No task holds more than a
    block, or the blocks' functions (at most as many steps each as chunks make up `least`). Where no partition is longer than a block, one fold does.
    """
    counts = (chunks.groupBy(*partition) if partition else chunks.groupBy()).agg(F.count("*").alias("n"))
    if counts.where(F.col("n") > RECHUNK_BLOCK).isEmpty():
        return rechunk_folded(chunks, least, chunk, size, order, partition)
    rows = chunks.select(*partition, F.col(chunk).alias("_c"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_n"), F.col(order).alias("_o"))
    rows = with_row_index(rows, "_o", "_c", name="_i", partition=partition).withColumn("_block", F.floor(F.col("_i") / RECHUNK_BLOCK).cast("long"))
    kinds = dict(rows.dtypes)
    keys, kind = "".join(f"{p} {kinds[p]}, " for p in partition), kinds["_c"]

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        total = np.cumsum(pdf["_n"].to_numpy(np.int64))
        before = np.append(0, total)
        ends = np.searchsorted(total, before[:-1] + least)  # where a run that starts at each chunk is cut
        left = np.append(before[-1] - before, 0)
        for k in range(len(pdf) - 1, -1, -1):
            if (cut_at := max(ends[k], k)) < len(pdf):
                left[k] = left[cut_at + 1]
        steps = min(int(np.searchsorted(total, least)) + 1, len(pdf))
        out = pdf[[*partition, "_block"]].iloc[:1].copy()
        return out.assign(_sums=[total[:steps]], _left=[left[1 : steps + 1]], _cuts=[pdf["_c"].to_numpy()[:steps]], _all=int(total[-1]), _last=pdf["_c"].iloc[-1])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, carry, come, first = pdf.sort_values("_block", ignore_index=True), 0, [], []
        for sums, left, cuts, whole in zip(pdf["_sums"], pdf["_left"], pdf["_cuts"], pdf["_all"], strict=True):
            come.append(carry)
            at = int(np.searchsorted(sums, least - carry))
            first.append(cuts[at] if at < len(sums) else None)
            carry = int(left[at]) if at < len(sums) else carry + int(whole)
        close, end = [], pdf["_last"].iloc[-1]
        for own in reversed(first):
            close.append(end)
            end = end if own is None else own
        return pdf[[*partition, "_block"]].assign(_come=come, _close=close[::-1])

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        acc, start, ids = int(pdf["_come"].iloc[0]), 0, pdf["_c"].to_numpy()
        new = np.full(len(pdf), pdf["_close"].iloc[0], dtype=ids.dtype)
        for k, n in enumerate(pdf["_n"].tolist()):
            acc += n
            if acc >= least:
                new[start : k + 1] = ids[k]
                acc, start = 0, k + 1
        return pdf[[*partition, "_c"]].assign(new_chunk=new)

    summed = rows.groupBy(*partition, "_block").applyInPandas(sum_up, f"{keys}_block long, _sums array<long>, _left array<long>, _cuts array<{kind}>, _all long, _last {kind}")
    known = (summed.groupBy(*partition) if partition else summed.withColumn("_g", F.lit(0)).groupBy("_g")).applyInPandas(follow, f"{keys}_block long, _come long, _close {kind}")
    on = [rows["_block"] == known["_block"], *[rows[p].eqNullSafe(known[p]) for p in partition]]
    joined = rows.join(known, on).select(*[rows[c] for c in rows.columns], "_come", "_close")
    out = joined.groupBy(*partition, "_block").applyInPandas(divide, f"{keys}_c {kind}, new_chunk {kind}")
    return out.withColumnRenamed("_c", chunk)


def rechunk_folded(chunks: DataFrame, least: int, chunk: str, size: str, order: str, partition: Sequence[str]) -> DataFrame:
    """rechunk with all chunks of a partition in one array."""
    c = F.struct(F.col(order).alias("o"), F.col(chunk).alias("c"), F.col(size).cast("long").alias("n"))
    kind = dict(chunks.dtypes)[chunk]
    state = f"struct(bigint(0) as acc, cast(array() as array<{kind}>) as open, cast(array() as array<struct<old: {kind}, new: {kind}>>) as done)"
    fold = f"""aggregate(all, {state}, (s, x) ->
        if(s.acc + x.n >= {int(least)} OR x.c = last.c,
           struct(bigint(0) as acc, cast(array() as array<{kind}>) as open, concat(s.done, transform(concat(s.open, array(x.c)), o -> struct(o as old, x.c as new))) as done),
           struct(s.acc + x.n as acc, concat(s.open, array(x.c)) as open, s.done as done)), s -> s.done)"""
    groups = chunks.groupBy(*partition) if partition else chunks.groupBy()
    folded = groups.agg(F.array_sort(F.collect_list(c)).alias("all")).withColumn("last", F.element_at("all", -1))
    return folded.select(*partition, F.explode(F.expr(fold)).alias("m")).select(*partition, F.col("m.old").alias(chunk), F.col("m.new").alias("new_chunk"))


def fill_both(df: DataFrame, column: str, order: Sequence[str], partition: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Nulls take the next value, else the one before."""
    w = W.partitionBy(*partition).orderBy(*order)
    ahead = F.first(column, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    behind = F.last(column, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name or column, F.coalesce(ahead, behind))


def rows_where(df: DataFrame, condition: Column, order: Sequence[str], partition: Sequence[str] = (), name: str = "row") -> DataFrame:
    """0-based numbers of the rows where condition holds, null elsewhere."""
    w = W.partitionBy(*partition, F.coalesce(condition, F.lit(False))).orderBy(*order)
    return df.withColumn(name, F.when(condition, F.row_number().over(w) - 1).cast("long"))


def running_count(df: DataFrame, column: str, partition: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.count(column).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def day_transcripts(df: DataFrame, conversation: Sequence[str], order: Sequence[str], line: Column) -> DataFrame:
    return df.withColumn("_line", line).groupBy(*conversation).agg(lists.ordered_concat(F.col("_line"), "\n", *[F.col(o) for o in order]).alias("transcript"), F.count("*").alias("n_lines"))


def segment(decide: Callable[[list[dict]], dict], first: int = 20, step: int = 19, force: int = 100):
    """For applyInPandas, a conversation at a time: grow a window until `decide` says SPLIT, or it has more than `force` rows; the rest is the last chunk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index", ignore_index=True)
        start, end, chunk = 0, first, 0
        ids, sentiments = np.zeros(len(pdf), dtype=np.int64), np.full(len(pdf), np.nan)
        while end < len(pdf):
            window = pdf.iloc[start:end]
            answer = decide(window.to_dict("records"))
            if answer.get("decision") == "SPLIT" or len(window) > force:
                ids[start:end], chunk = chunk, chunk + 1
                sentiments[start:end] = np.nan if answer.get("sentiment") is None else answer["sentiment"]
                start, end = end, end + first
            else:
                end += step
        ids[start:] = chunk
        return pdf.assign(chunk_id=ids, sentiment=sentiments)

    return run


def median_gap(x: np.ndarray) -> float:
    """Median of the squared differences of all pairs of numbers, in memory linear in them: their order is counted, not listed."""
    v = np.sort(np.asarray(x, dtype=float).ravel())
    v = v - v[0]
    pairs = len(v) * (len(v) - 1) // 2

    def kth(k: int) -> float:
        """The k-th smallest difference (from 1): the least number that at least k differences don't pass, by halving the range of doubles."""
        lo, hi = 0, int(np.float64(v[-1]).view(np.int64))
        while lo < hi:
            mid = (lo + hi) // 2
            reach = np.int64(mid).view(np.float64)
            within = np.searchsorted(v, v + reach, side="right") - np.arange(len(v)) - 1
            lo, hi = (lo, mid) if int(within.sum()) >= k else (mid + 1, hi)
        return float(np.int64(lo).view(np.float64))

    return (kth((pairs + 1) // 2) ** 2 + kth(pairs // 2 + 1) ** 2) / 2


def change_points(values: np.ndarray, least: int = 3, penalty: float | None = None) -> list[int]:
    """Ends of segments by exact pruned search (PELT) with a radial kernel; the kernel's width is the median distance.

    Kernel sums are kept for the segments that can still begin one, and grow by a row of the kernel with each number, so memory is linear, and time is the numbers times the
    span back to the oldest start that is not ruled out.
    """
    x = np.asarray(values, dtype=float).ravel()
    n = len(x)
    if n < 2 * least:
        return [n]
    gamma = 1 / m if (m := median_gap(x)) > 0 else 1.0
    own = np.exp(-1e-2)  # the kernel of a number with itself, as its argument is held to 0.01 to 100
    beta = np.log(n) if penalty is None else penalty
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -beta
    starts, sums = np.array([0]), np.array([0.0])
    for b in range(1, n + 1):
        lo = starts[0]
        row = np.exp(-np.clip((x[lo:b] - x[b - 1]) ** 2 * gamma, 1e-2, 1e2))
        sums = sums + 2 * np.cumsum(row[::-1])[::-1][starts - lo] - own
        if b >= least:
            long = b - starts >= least
            a = starts[long]
            total = best[a] + (b - a) * own - sums[long] / (b - a)
            found = int(total.argmin())
            best[b], last[b] = total[found] + beta, a[found]
            kept = ~long
            kept[long] = total <= best[b]
            starts, sums = starts[kept], sums[kept]
        if b >= least:
            starts, sums = np.append(starts, b), np.append(sums, 0.0)
    ends, b = [], n
    while b > 0:
        ends.append(b)
        b = last[b]
    return ends[::-1]


def short_change_points(x: np.ndarray, least: int = 3) -> list[list[int]]:
    """change_points of each row of x, all at once: the same search, with the starts that are ruled out as a mask."""
    count, n = x.shape
    if n < 2 * least:
        return [[n]] * count
    v = np.sort(x, axis=1)
    v = v - v[:, :1]
    i, j = np.triu_indices(n, 1)
    gaps_, pairs = v[:, j] - v[:, i], n * (n - 1) // 2
    mid = [(pairs + 1) // 2 - 1, pairs // 2]
    m = (np.partition(gaps_, mid, axis=1)[:, mid] ** 2).sum(1) / 2
    gamma, own, beta = np.where(m > 0, 1 / np.where(m > 0, m, 1), 1.0)[:, None], np.exp(-1e-2), np.log(n)
    best, last, sums, alive = np.full((count, n + 1), np.inf), np.zeros((count, n + 1), dtype=int), np.zeros((count, n + 1)), np.zeros((count, n + 1), dtype=bool)
    best[:, 0], alive[:, 0] = -beta, True
    for b in range(1, n + 1):
        row = np.exp(-np.clip((x[:, :b] - x[:, b - 1 : b]) ** 2 * gamma, 1e-2, 1e2))
        sums[:, :b] += 2 * np.cumsum(row[:, ::-1], axis=1)[:, ::-1] - own
        if b >= least:
            a = np.arange(b - least + 1)
            total = np.where(alive[:, : len(a)], best[:, : len(a)] + (b - a) * own - sums[:, : len(a)] / (b - a), np.inf)
            last[:, b] = total.argmin(1)
            best[:, b] = total[np.arange(count), last[:, b]] + beta
            alive[:, : len(a)] &= total <= best[:, b, None]
            alive[:, b] = True
    out = []
    for row in last.tolist():
        ends, b = [], n
        while b > 0:
            ends.append(b)
            b = row[b]
        out.append(ends[::-1])
    return out


def change_point_sessions(df: DataFrame, partition: Sequence[str], order: str, time: str, least: int = 3) -> DataFrame:
    """Sessions between change points of the time of rows, in memory linear in a conversation's rows. Short conversations of one length are searched together."""
    schema = df.withColumn("session", F.lit(0).cast("long")).schema

    def told(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        x, sizes = pdf[time].astype("int64").to_numpy() / 1e9 / 3600, np.diff(np.append(starts, len(pdf)))
        session = np.zeros(len(pdf), dtype=np.int64)
        for n in np.unique(sizes):
            at = starts[sizes == n]
            step = max(1, SHORT_CELLS // int(n * n)) if n <= SHORT else 1
            for k in range(0, len(at), step):
                rows = at[k : k + step, None] + np.arange(n)
                for places, ends in zip(rows, short_change_points(x[rows], least) if n <= SHORT else [change_points(x[rows[0]], least)], strict=True):
                    session[places] = np.searchsorted(ends, np.arange(n), side="right")
        return pdf.assign(session=session)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < TOGETHER:
                continue
            rows = pd.concat(held, ignore_index=True)
            starts = begins(rows)
            if starts[-1]:  # the last conversation may go on
                yield told(rows.iloc[: starts[-1]], starts[:-1])
            held, size = [rows.iloc[starts[-1] :]], 0
        if held and len(rows := pd.concat(held, ignore_index=True)):
            yield told(rows, begins(rows))

    def begins(rows: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(rows), dtype=bool)
        new[0] = True
        for c in partition:
            now, was = rows[c], rows[c].shift()
            new |= ((now != was) & ~(now.isna() & was.isna())).to_numpy()
        return np.flatnonzero(new)

    return df.repartition(*partition).sortWithinPartitions(*partition, order).mapInPandas(run, schema)
