"""Exact quantiles and medians per group that no single task has to sort.

Spark's own ``percentile`` keeps the value counts of a group in one buffer and
interpolates linearly. Here the *nearest* value is needed for quartiles, and a
group may hold a third of all rows. So a quantile is selected in two scans:

1. Rows are counted per group and bin of the value. Bins are ordered like the
   values, and the counts are combined before they are shuffled, so what is
   shuffled does not grow with the rows. The counts are written down: a running
   sum over the few bins of a group tells which bin holds which rank.
2. The rows are read again, and only those in a (group, bin) that holds a wanted
   rank go on, to be sorted within their bin. Spark sends the wanted pairs to
   all tasks if the written counts are small, so nothing else is shuffled; else
   both sides are joined by group and bin.

The bins depend on the value alone, so no sample is involved. Counts of a fine
level add up to those of the levels above it, and other sums may ride along:
``bins`` of one scan can serve many reports. There is one program for all sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import name
from ..sources.shared import scratch_folder, stored

BINS_PER_OCTAVE = 64
# Every double above 0 has a binary exponent above -1075. So there are fewer
# than 140,000 bins in all.
_LOWEST = 1080 * BINS_PER_OCTAVE
_TOP = 2 * _LOWEST


def value_bin(value: str) -> str:
    """SQL for a bin number that never decreases as the value grows.

    Positive values get 64 bins per factor of two, negative ones mirror them,
    zero has a bin of its own. NaN is above everything, as in a sort, and null
    below.
    """
    size = f"abs({value})"
    octave = f"floor(log2({size}))"
    within = f"floor(({size} / pow(2D, {octave}) - 1) * {BINS_PER_OCTAVE})"
    number = f"({octave} * {BINS_PER_OCTAVE} + {within} + {_LOWEST})"
    infinity = "double('Infinity')"
    bins = (
        f"CASE WHEN {value} IS NULL THEN -{_TOP + 1}L WHEN isnan({value}) THEN {_TOP + 1}L "
        f"WHEN {value} = {infinity} THEN {_TOP}L WHEN {value} = -{infinity} THEN -{_TOP}L "
        f"WHEN {value} > 0 THEN {number} WHEN {value} < 0 THEN -{number} ELSE 0L END"
    )
    # Never null, and known to be: a join on it then adds no filter that would
    # be pushed below the counts and make them two different subplans.
    return f"coalesce({bins}, 0L)"


def bin_counts(
    df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[Column] = ()
) -> DataFrame:
    """(keys, _bin, sums, n): one written row per group and bin of ``value``.

    n counts the values; a group without any has one row with n = 0.
    """
    v = f"double({name(value)})"
    counted = df.groupBy(*keys, F.expr(value_bin(v)).alias("_bin")).agg(
        *sums, F.count(value).alias("n")
    )
    return stored(counted, scratch_folder(df.sparkSession, "bins"))


def selected(
    df: DataFrame,
    bins: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    method: str = "nearest",
    parent: Sequence[str] | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Quantiles per group of ``keys``, from the rows and the ``bin_counts`` of these.

    ``bins`` may have more keys. ``nearest`` takes the value of rank
    round((n-1)q), halves away from zero; ``linear`` interpolates between the
    two neighbours, so q=0.5 is the median. A group without a value gives null.

    With ``parent``, a part of the keys, the groups of those keys alone are
    added. Their rows have ``_is_parent`` 1 and null in the other keys. ``only``
    has the keys of the wanted groups; their parents still count all rows.
    """
    keys, above = [name(k) for k in keys], [name(k) for k in parent or ()]
    ranks, results = _ranks_and_results(quantiles, method)
    holds_rank = " OR ".join(f"({r} >= _end - _in_bin AND {r} < _end)" for r in ranks)

    def hits(groups: list[str]) -> str:
        """Per group the bins that hold a rank, with the values before them and in all."""
        plain = "".join(f"{g}, " for g in groups)
        by = f"PARTITION BY {', '.join(groups)}" if groups else ""
        dealt = f"DISTRIBUTE BY {', '.join(groups)}" if groups else ""
        wanted = ""
        if only is not None:
            same = " AND ".join(f"b.{g} <=> o.{g}" for g in groups) or "true"
            wanted = f"b LEFT SEMI JOIN {{only}} o ON {same}"
        return f"""
          SELECT {plain} _bin, _end - _in_bin AS _before, _size FROM (
            SELECT *, sum(_in_bin) OVER ({by} ORDER BY _bin) AS _end,
              sum(_in_bin) OVER ({by}) AS _size
            FROM (
              SELECT {plain} _bin, sum(n) AS _in_bin
              FROM (SELECT {plain} _bin, n FROM {{bins}} {wanted} {dealt})
              GROUP BY {plain} _bin
            )
          ) WHERE _size = 0 OR {holds_rank}
        """

    def matched(groups: list[str], side: str) -> str:
        return " AND ".join([*(f"r.{g} <=> {side}.{g}" for g in groups), f"r._bin = {side}._bin"])

    # A group without values matches with its nulls, which are no values: its row stays.
    listed = "".join(f"{k}, " for k in keys)
    ours = "".join(f"r.{k}, " for k in keys)
    if parent is None:
        near = f"""
        near AS (
          SELECT {ours} 0 AS _is_parent, r._bin, _before, _size, _v
          FROM {{rows}} r JOIN own o ON {matched(keys, "o")}
        ),
        """
    else:
        lifted = "".join(
            f"{k}, " if k in above else f"CASE WHEN x.level = 0 THEN {k} END AS {k}, " for k in keys
        )
        near = f"""
        family AS ({hits(above)}),
        near AS (
          SELECT {lifted} x.level AS _is_parent, _bin, x.before AS _before, x.size AS _size, _v
          FROM (
            SELECT {ours} r._bin, r._v, explode(filter(array(
                named_struct('level', 0, 'before', o._before, 'size', o._size),
                named_struct('level', 1, 'before', p._before, 'size', p._size)
              ), y -> y.size IS NOT NULL)) AS x
            FROM {{rows}} r LEFT JOIN own o ON {matched(keys, "o")} LEFT JOIN family p ON {matched(above, "p")}
            WHERE o._size IS NOT NULL OR p._size IS NOT NULL
          )
        ),
        """
    steps = [f"min(CASE WHEN _upto > {r} THEN _v END) AS _at{at}" for at, r in enumerate(ranks)]
    merged = ", ".join(f"min(_at{at}) AS _at{at}" for at in range(len(ranks)))
    shown = listed + ("_is_parent, " if parent is not None else "")
    value_now = f"double({name(value)})"
    rows = df.select(*[F.col(k) for k in keys], F.expr(f"{value_now} AS _v"), F.expr(f"{value_bin(value_now)} AS _bin"))
    frames = {"rows": rows, "bins": bins} | ({} if only is None else {"only": only})
    return df.sparkSession.sql(
        f"""
        WITH own AS ({hits(keys)}),
        {near}
        counts AS (
          SELECT {listed} _is_parent, _bin, _before, _size, _v, count(_v) AS n FROM near
          GROUP BY {listed} _is_parent, _bin, _before, _size, _v
        ),
        reached AS (
          SELECT {listed} _is_parent, _bin, _v, _size,
            _before + sum(n) OVER (PARTITION BY {listed} _is_parent, _bin ORDER BY _v) AS _upto
          FROM counts
        ),
        in_bins AS (
          SELECT {listed} _is_parent, _bin, max(_size) AS _size, {", ".join(steps)} FROM reached
          GROUP BY {listed} _is_parent, _bin
        ),
        picked AS (
          SELECT {shown} max(_size) AS _size, {merged}
          FROM (SELECT * FROM in_bins {f"DISTRIBUTE BY {', '.join(above or keys)}" if keys else ""})
          {f"GROUP BY {shown.rstrip(', ')}" if keys else ""}
        )
        SELECT {shown} {", ".join(results)} FROM picked
        """,
        **frames,
    )


def _ranks_and_results(
    quantiles: Mapping[str, float], method: str
) -> tuple[list[str], list[str]]:
    """SQL for the ranks to look up, from ``_size``, and for the results, from
    the values ``_at0``, ``_at1``, ... found at those ranks."""
    if method not in ("nearest", "linear"):
        raise ValueError(f"unknown method {method!r}")
    ranks, results = [], []
    for alias, q in quantiles.items():
        position, at = f"(_size - 1) * {float(q)!r}D", len(ranks)
        if method == "nearest":
            ranks.append(f"floor({position} + 0.5D)")
            results.append(f"_at{at} AS {name(alias)}")
        else:
            ranks += [f"floor({position})", f"ceil({position})"]
            part = f"({position} - floor({position}))"
            between = f"_at{at} * (1 - {part}) + _at{at + 1} * {part}"
            results.append(f"CASE WHEN {part} = 0 THEN _at{at} ELSE {between} END AS {name(alias)}")
    return ranks, results


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    method: str = "nearest",
) -> DataFrame:
    """One row per group, one column per quantile; see ``selected``. Counts bins when called."""
    return selected(df, bin_counts(df, keys, value), list(keys), value, quantiles, method)


def quantiles_with_parent(
    df: DataFrame,
    detail: Sequence[str],
    parent: Sequence[str],
    value: str,
    quantiles: Mapping[str, tuple[str, float]],
    method: str = "nearest",
    bins: DataFrame | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Quantiles of every (detail + parent) group next to those of its parent group.

    ``quantiles`` maps the name for the group to (name for its parent, q). Both
    levels come from the same two scans, from one if ``bins`` are there already.
    """
    keys = [*detail, *parent]
    own = {alias: q for alias, (_, q) in quantiles.items()}
    if bins is None:
        bins = bin_counts(df, keys, value)
    found = selected(df, bins, keys, value, own, method, list(parent), only)
    family = Window.partitionBy(*parent)
    above = [
        F.max(F.when(F.col("_is_parent") == 1, F.col(n))).over(family).alias(alias)
        for n, (alias, _) in quantiles.items()
    ]
    return found.select("*", *above).where("_is_parent = 0").drop("_is_parent")


def approx_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """The same shape from sketches of bounded size: one pass, small rank errors."""
    return df.groupBy(*keys).agg(
        *[F.percentile_approx(value, float(q), 10000).alias(n) for n, q in quantiles.items()]
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """Median per group: the mean of the two middle values."""
    return exact_quantiles(df, keys, value, {alias: 0.5}, "linear")


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal keys where null equals null, keeping the left keys.

    Which side is broadcast is left to the optimizer: it knows the sizes.
    """
    added = ", ".join(f"r.{name(n)}" for n in right.columns if n not in keys)
    on = " AND ".join(f"l.{name(k)} <=> r.{name(k)}" for k in keys) or "true"
    return left.sparkSession.sql(
        f"SELECT l.*, {added} FROM {{left}} l LEFT JOIN {{right}} r ON {on}",
        left=left,
        right=right,
    )
