"""Release windows and the attribution of dates to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def release_windows(records: DataFrame, keys: tuple[str, ...], start: str, tie: Column) -> DataFrame:
    """Half-open windows: each release ends where the next of its product and channel starts; the last is open."""
    return records.withColumn("window_end", F.lead(start).over(Window.partitionBy(*keys).orderBy(start, tie)))


def active_at(
    events: DataFrame, windows: DataFrame, keys: tuple[str, ...], moment: str, start: str, tie: str, payload: tuple[str, ...],
    parts: int = 1024, splits: int = 64, least: int = 100_000,
) -> DataFrame:
    """As-of join without pairs: the last window that starts at or before each event's moment.

    Events and window starts are put in one order per key; the last start seen
    is carried forward. Of windows that start together the last by ``tie``
    counts. A key that holds over a ``parts``-th of the rows (there are fewer
    than ``parts`` of them) and more than ``least`` is cut at quantiles of its own moments into up to
    ``splits`` stretches; the last start of each, an aggregate, is carried over
    the borders, so that no task orders a hot key whole. One shuffle of the
    rows, no candidate rows.
    """
    kept = [F.col(c) for c in events.columns if c not in keys]
    stream = events.select(*keys, F.col(moment).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(dict(windows.dtypes)[tie]).alias("tie"),
                           F.struct(*kept).alias("event"), F.lit(None).cast(_type(windows, payload)).alias("window"))
    starts = windows.select(*keys, F.col(start).alias("at"), F.lit(0).alias("kind"), F.col(tie).alias("tie"),
                            F.lit(None).cast(_type(events, tuple(c for c in events.columns if c not in keys))).alias("event"), F.struct(*payload).alias("window"))
    hot = _hot(events.select(*keys, F.col(moment).alias("at")).unionByName(windows.select(*keys, F.col(start).alias("at"))), keys, parts, splits, least)
    if hot is None:
        return _carried(stream.unionByName(starts).withColumn("stretch", F.lit(0)), keys, payload)
    hot = F.broadcast(hot)
    stretch = F.when(F.col("borders").isNotNull(), F.size(F.filter("borders", lambda b: b <= F.col("at")))).otherwise(0).alias("stretch")
    dealt = lambda rows: rows.join(hot, list(keys), "left").select(*rows.columns, stretch)
    starts = dealt(starts)
    # the last start of each stretch of a hot key, carried into the following ones up to the next that has one
    lasts = starts.join(hot, list(keys)).groupBy(*keys, "stretch").agg(F.max_by("window", F.struct("at", "tie")).alias("window"))
    until = F.coalesce(F.lead("stretch").over(Window.partitionBy(*keys).orderBy("stretch")), F.lit(splits))
    lasts = lasts.withColumn("until", until).where(F.col("until") > F.col("stretch")).withColumn("stretch", F.explode(F.sequence(F.col("stretch") + 1, "until")))
    rows = dealt(stream).unionByName(starts)
    nothing = [F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in ("at", "tie", "event")]
    rows = rows.unionByName(lasts.select(*keys, "stretch", "window", F.lit(-1).alias("kind"), *nothing))
    return _carried(rows, keys, payload)


def _carried(rows: DataFrame, keys: tuple[str, ...], payload: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*keys, "stretch").orderBy(F.col("kind") >= 0, "at", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("window", F.last("window", ignorenulls=True).over(order)).where("kind = 1")
    return carried.select(*keys, "event.*", *[F.col("window").getField(c).alias(c) for c in payload])


def _hot(moments: DataFrame, keys: tuple[str, ...], parts: int, splits: int, least: int) -> DataFrame | None:
    """The keys with over a ``parts``-th of the rows and the borders of their stretches, fewer than ``parts`` rows; or None."""
    counts = moments.groupBy(*keys).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    if most is None or most <= least or most * parts <= total:
        return None
    names = counts.where((F.col("n") * parts > F.lit(total)) & (F.col("n") > least)).select(*keys)
    shares = [i / splits for i in range(1, splits)]
    found = moments.join(F.broadcast(names), list(keys), "left_semi").groupBy(*keys)
    return found.agg(F.array_distinct(F.percentile_approx("at", shares, splits * 100)).alias("borders")).where("borders IS NOT NULL")


def _type(df: DataFrame, columns: tuple[str, ...]) -> str:
    types = dict(df.dtypes)
    return "struct<" + ",".join(f"`{c}`:{types[c]}" for c in columns) + ">"


def window_for_version(mentions: DataFrame, windows: DataFrame, product: str, version: str, channel: str) -> DataFrame:
    """The window of a version in its channel, else in any channel (the first to start; one without a start comes last).

    Windows are brought down to the first of each channel and of each version
    before the joins, so a mention meets one row of either.
    """
    named = windows.withColumnsRenamed({channel: "window_channel"})
    payload = [c for c in named.columns if c not in (product, version)]
    order = lambda start: F.struct(start.isNull(), start, F.col("window_channel"))
    own = named.groupBy(product, version, "window_channel").agg(F.min_by(F.struct(*payload), order(F.col("window_start"))).alias("_own"))
    first = own.groupBy(product, version).agg(F.min_by("_own", order(F.col("_own.window_start"))).alias("_first"))
    own = own.where("window_channel IS NOT NULL").withColumnsRenamed({"window_channel": channel})
    found = mentions.join(first, [product, version], "left").join(own, [product, version, channel], "left")
    picked = F.coalesce("_own", "_first")
    rest = [c for c in mentions.columns if c not in (product, version)]
    return found.select(product, version, *rest, *[picked[c].alias(c) for c in payload])


def carry_forward(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: Column, name: str, cleared: Column | None = None) -> DataFrame:
    """The last known value; where ``cleared`` holds nothing is carried on."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if cleared is None:
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(over))
    state = F.when(cleared, F.struct(F.lit(None).cast("string").alias("v"))).when(value.isNotNull(), F.struct(value.cast("string").alias("v")))
    return rows.withColumn(name, F.last(state, ignorenulls=True).over(over)["v"])


def sections(rows: DataFrame, key: str, headings: Column, text: Column) -> DataFrame:
    """``key, nth, heading, body``: each heading found in a text owns what follows up to the next.

    ``headings`` is an array of ``heading, start`` ordered by start (code points from 1).
    """
    opened = rows.select(key, text.alias("whole"), headings.alias("h")).select(key, "whole", "h", F.posexplode("h").alias("nth", "one"))
    end = F.coalesce(F.get("h", F.col("nth") + 1)["start"], F.length("whole") + 1)
    begin = F.col("one.start") + F.length("one.heading")
    return opened.select(key, "nth", F.col("one.heading").alias("heading"), F.substring("whole", begin, end - begin).alias("body"))


def context_lines(lines: DataFrame, key: str, pos: str, line: str, before: int, after: int) -> DataFrame:
    """Each line with those around it."""
    over = Window.partitionBy(key).orderBy(pos).rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list(line).over(over), "\n"))
