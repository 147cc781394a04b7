"""Moving and running aggregates that stay bounded when one key holds most rows.

A plain ``Window.partitionBy(key)`` puts a hot key into one task, and a sliding
frame re-reads its whole frame for every row. Here instead

* rows are first combined per (key, timestamp), so a key has at most one row per
  distinct timestamp;
* a key is cut into time buckets, and a bucket also receives the rows just outside
  its edges that its own frames reach (``halo``), so buckets are independent tasks;
* a frame sum is the difference of two growing frames, which is linear;
* a distinct count in a frame is the number of *runs* of a member that touch the
  frame: run starts up to its right edge minus run ends left of its left edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def _w(*keys: str):
    return Window.partitionBy(*keys)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """The join by two shuffles, for frames that grow with the input.

    Spark guesses the size of a stored frame by its files and of an exploded one by what it is made from. Many rows
    may look like few bytes, and a broadcast of them goes through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def halo(df: DataFrame, us: str, before: int, after: int, span: int) -> DataFrame:
    """Copy each row into every time bucket whose frames can reach it.

    Adds ``_tb`` (bucket) and ``_home`` (true on the row's own bucket). ``before``
    and ``after`` are how far frames look back and ahead.
    """
    span = max(span, before, after)
    own = F.floor(F.col(us) / F.lit(span)).cast("long")
    offset = F.col(us) - own * span
    copies = F.array_compact(
        F.array(
            own,
            F.when(F.lit(span) - offset <= before, own + 1),
            F.when(offset < after, own - 1),
        )
    )
    return df.withColumn("_own", own).withColumn("_tb", F.explode(copies)).withColumn("_home", F.col("_tb") == F.col("_own")).drop("_own")


def _between(total: Column, keys: list[str], us: str, before: int, after: int) -> Column:
    """Sum of ``total`` over [us-before, us+after] as a difference of growing frames."""
    w = _w(*keys).orderBy(us)
    upto = F.sum(total).over(w.rangeBetween(Window.unboundedPreceding, after))
    gone = F.sum(total).over(w.rangeBetween(Window.unboundedPreceding, -before - 1))
    return upto - F.coalesce(gone, F.lit(0).cast("long"))


def frame_sums(
    df: DataFrame,
    keys: list[str],
    us: str,
    measures: dict[str, tuple[Column, int, int]],
    span: int | None = None,
) -> DataFrame:
    """Per (keys, us): each measure summed over its own frame.

    ``measures[name] = (expression, before, after)``; frame bounds in microseconds,
    both inclusive. One row per distinct (keys, us); rows with a null key are left out.
    """
    before = max(b for _, b, _ in measures.values())
    after = max(a for _, _, a in measures.values())
    present = df
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    per_ts = present.groupBy(*keys, us).agg(*[F.sum(e).alias(n) for n, (e, _, _) in measures.items()])
    cut = halo(per_ts, us, before, after, span or 2 * max(before, after))
    part = [*keys, "_tb"]
    out = cut.select(
        *keys, us, "_home", *[_between(F.col(n), part, us, b, a).alias(n) for n, (_, b, a) in measures.items()]
    )
    return out.filter("_home").drop("_home")


def frame_distinct(
    df: DataFrame,
    keys: list[str],
    us: str,
    member: str,
    widths: dict[str, int],
    count: dict[str, int] | None = None,
    span: int | None = None,
) -> DataFrame:
    """Per (keys, us): distinct members in [us-w, us+w], and optionally row counts."""
    count = count or {}
    reach = max([*widths.values(), *count.values()])
    present = df
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    per_member = present.groupBy(*keys, member, us).agg(F.count("*").alias("_n"))
    cut = halo(per_member, us, reach, reach, span or 4 * reach)
    run = _w(*keys, "_tb", member).orderBy(us)
    gap_before = F.col(us) - F.lag(us).over(run)
    gap_after = F.lead(us).over(run) - F.col(us)
    flagged = cut.select(
        *keys,
        "_tb",
        us,
        "_home",
        "_n",
        *[F.coalesce(gap_before > 2 * w, F.lit(True)).cast("long").alias(f"_s_{n}") for n, w in widths.items()],
        *[F.coalesce(gap_after > 2 * w, F.lit(True)).cast("long").alias(f"_e_{n}") for n, w in widths.items()],
    )
    per_ts = flagged.groupBy(*keys, "_tb", us).agg(
        F.max("_home").alias("_home"),
        F.sum("_n").alias("_n"),
        *[F.sum(f"_{x}_{n}").alias(f"_{x}_{n}") for n in widths for x in "se"],
    )
    w0 = _w(*keys, "_tb").orderBy(us)
    zero = F.lit(0).cast("long")
    cols = [
        (
            F.sum(f"_s_{n}").over(w0.rangeBetween(Window.unboundedPreceding, w))
            - F.coalesce(F.sum(f"_e_{n}").over(w0.rangeBetween(Window.unboundedPreceding, -w - 1)), zero)
        ).alias(n)
        for n, w in widths.items()
    ]
    cols += [_between(F.col("_n"), [*keys, "_tb"], us, w, w).alias(n) for n, w in count.items()]
    return per_ts.select(*keys, us, "_home", *cols).filter("_home").drop("_home")


def arrival_frames(
    df: DataFrame,
    keys: list[str],
    us: str,
    row_id: str,
    member: str,
    distinct: dict[str, int],
    count: dict[str, int] | None = None,
    span: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: distinct members and rows among those that arrived in [us-w, us].

    Arrival order is (us, row_id); of rows with the same timestamp only those with a
    smaller or equal id count. Returns ``row_id``, the ``keep`` keys and the named columns.
    """
    count = count or {}
    reach = max([*distinct.values(), *count.values()])
    present = df
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    rows = present.select(*keys, us, row_id, member)
    per_member = rows.groupBy(*keys, member, us).agg(F.count("*").alias("_n"), F.min(row_id).alias("_first"))
    cut = halo(per_member, us, reach, 0, span or 4 * reach)
    run = _w(*keys, "_tb", member).orderBy(us)
    gap_before = F.col(us) - F.lag(us).over(run)
    gap_after = F.lead(us).over(run) - F.col(us)
    flagged = cut.select(
        *keys,
        member,
        "_tb",
        us,
        "_home",
        "_n",
        "_first",
        *[F.coalesce(gap_before > w, F.lit(True)).cast("long").alias(f"_s_{n}") for n, w in distinct.items()],
        *[F.coalesce(gap_after > w, F.lit(True)).cast("long").alias(f"_e_{n}") for n, w in distinct.items()],
    )
    per_ts = flagged.groupBy(*keys, "_tb", us).agg(
        F.max("_home").alias("_home"),
        F.sum("_n").alias("_n"),
        *[F.sum(f"_{x}_{n}").alias(f"_{x}_{n}") for n in distinct for x in "se"],
    )
    w0 = _w(*keys, "_tb").orderBy(us)
    zero = F.lit(0).cast("long")

    def upto(c: str, edge: int) -> Column:
        return F.coalesce(F.sum(c).over(w0.rangeBetween(Window.unboundedPreceding, edge)), zero)

    base = per_ts.select(
        *keys,
        us,
        "_home",
        *[(upto(f"_s_{n}", -1) - upto(f"_e_{n}", -w - 1)).alias(f"_d_{n}") for n, w in distinct.items()],
        *[(upto("_n", -1) - upto("_n", -w - 1)).alias(f"_c_{n}") for n, w in count.items()],
    ).filter("_home").drop("_home")
    starts = flagged.filter("_home").select(
        *keys, us, F.col("_first").alias(row_id), *[f"_s_{n}" for n in distinct]
    )
    tie = _w(*keys, us).orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.drop(member).join(starts, [*keys, us, row_id], "left").join(base, [*keys, us])
    return joined.select(
        row_id,
        *keep,
        *[(F.col(f"_d_{n}") + F.coalesce(F.sum(f"_s_{n}").over(tie), zero)).alias(n) for n in distinct],
        *[(F.col(f"_c_{n}") + F.count(F.lit(1)).over(tie)).alias(n) for n in count],
    )


def running_totals(
    df: DataFrame,
    keys: list[str],
    us: str,
    row_id: str,
    measures: dict[str, Column],
    span: int = 7 * DAY,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Running sums per key in (us, row_id) order, the row itself included.

    Two levels: a running sum inside each (key, time bucket) plus the total of the
    key's earlier buckets, so no task holds a whole key. Returns ``row_id``, the
    ``keep`` keys and the measures, to be joined back; ``df`` is read twice, so pass the base rows.
    """
    cut = df.select(
        *keys,
        us,
        row_id,
        F.floor(F.col(us) / F.lit(span)).cast("long").alias("_tb"),
        *[e.alias(f"_m_{n}") for n, e in measures.items()],
    )
    totals = cut.groupBy(*keys, "_tb").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in measures])
    earlier = _w(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_tb", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in measures]
    )
    local = _w(*keys, "_tb").orderBy(us, row_id).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(offsets, [*keys, "_tb"]).select(
        row_id, *keep, *[(F.sum(f"_m_{n}").over(local) + F.col(f"_o_{n}")).alias(n) for n in measures]
    )


def running_distinct(
    df: DataFrame, keys: list[str], us: str, row_id: str, member: str, name: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row: distinct members of the key seen up to the row; null keys are left out."""
    rows = df.select(*keys, member, us, row_id).na.drop(subset=keys)
    first = rows.groupBy(*keys, member).agg(F.min(F.struct(us, row_id)).alias("_f"))
    marks = first.select(*keys, F.col(f"_f.{row_id}").alias(row_id), F.lit(1).cast("long").alias("_new"))
    marked = rows.join(marks, [*keys, row_id], "left")
    return running_totals(marked, keys, us, row_id, {name: F.coalesce("_new", F.lit(0).cast("long"))}, keep=keep)


def by_kind(df: DataFrame, columns: list[str], keys: dict[str, Column]) -> DataFrame:
    """Long form: one line per row and key kind, as (columns, kind, key); empty keys drop out.

    Frames over several keys then share one shuffle chain over (kind, key).
    """
    each = [
        F.when(k.isNotNull() & (k != ""), F.struct(F.lit(n).alias("kind"), k.alias("key"))) for n, k in keys.items()
    ]
    return df.select(*columns, F.explode(F.array_compact(F.array(*each))).alias("_k")).select(*columns, "_k.kind", "_k.key")


def from_kind(long: DataFrame, row_id: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Back to one line per row: ``columns[name] = (kind, value column)``."""
    return long.groupBy(row_id).agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(n) for n, (k, c) in columns.items()])
