"""Exact order statistics without a single-task window.

A window ``over (order by x)`` with no partition key, or one partitioned by a
two-valued label, sends a whole class to one task.  Exact quantiles, running
sums (ROC curve, AUC) and per-class ranks (stratified split) therefore go
through buckets of an order-preserving code:

* ``ordered_bits`` maps a number to a long that grows with it (sign, exponent and
  fraction as a floating-point number has them), a uniform hash is such a long
  already, and a string is taken four bytes at a time.  Codes are functions of the
  value alone, so there is nothing to sample, to collect or to write into the plan,
  and a recomputed task puts its rows in the same buckets.
* Running sums: totals per (group, code), the code being the upper 32 bits.  A job
  counts first whether a code holds more than ``BUCKET_ROWS`` rows (and a 2^16th of
  all rows, if that is more).  Such over-full codes get the next bits too, and so
  on; there are at most 2^16 of them in a round, so their list is kept in the shared
  folder and broadcast.  Running totals over codes are formed in two steps, within
  blocks of 2^16 codes and over the blocks.  A window per (group, code) gives the
  running value inside a bucket; offset plus local value is exact.
* Quantiles go from digit to digit of the code: counts per digit show which one
  holds the wanted position, and only its values are counted by the next digit.
  No value is put in order, a window holds the counts of one digit, and nothing
  runs while the plan is built.

Ordering keys must be non-null and NaN-free (the callers normalise NaN to NULL
and drop NULLs first).  Groups may be NULL; a NULL group is a group.  Rows that
are equal in the first ordering key share a bucket, so callers aggregate equal
keys first where they may be many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BITS = 16
#: A bucket with more rows is split further, if its key has more bits.
BUCKET_ROWS = 1 << 20
#: Bits of the digits of a 64-bit code by which quantiles are looked for, from the top.
DIGITS = (22, 21, 21)


def ordered_bits(x: Column) -> Column:
    """A double's sign, exponent and fraction as a long that grows with it; both zeros are 0."""
    size = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)
    near = F.floor(F.log2(size))
    exponent = near + F.when(power(near + 1) <= size, 1).otherwise(0) - F.when(power(near) > size, 1).otherwise(0)
    fraction = ((size / power(exponent) - 1) * float(1 << 52)).cast("long")
    normal = (exponent.cast("long") + 1023) * (1 << 52) + fraction
    bits = (F.when(size == 0, F.lit(0))
             .when(size == float("inf"), F.lit(2047 << 52))
             .when(size < 2.0 ** -1022, (size * 2.0 ** 537 * 2.0 ** 537).cast("long"))
             .otherwise(normal)).cast("long")
    return F.when(x < 0, -bits).otherwise(bits)


def _level(key: Column, kind: T.DataType, uniform: bool, k: int) -> Column | None:
    """The k-th code of 32 bits or fewer, the most significant first; numbers have two, strings any number."""
    low = (1 << 32) - 1
    if isinstance(kind, T.StringType) and not uniform:  # strings are compared by their UTF-8 bytes
        part = F.rpad(F.hex(F.substring(key.cast("binary"), 4 * k + 1, 4)), 8, "0")
        return F.conv(part, 16, 10).cast("long")
    if k > 1:
        return None
    if uniform:  # a 64-bit hash: its top 24 bits, then the next 32
        return F.shiftright(key, 8).bitwiseAND(low) if k else F.shiftright(key, 40)
    bits = ordered_bits(key.cast("double"))
    return bits.bitwiseAND(low) if k else F.shiftright(bits, 32)


def order_code(key: Column, kind: T.DataType, uniform: bool = False) -> Column:
    """A long that never decreases as ``key`` grows."""
    return _level(key, kind, uniform, 0)


def _join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the right side's keys are dropped."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def _running_totals(totals: DataFrame, group_cols: list[str], code: str, names: list[str]) -> DataFrame:
    """``totals`` (one row per group and code) with _off_<name>: the sum over all smaller codes."""
    totals = totals.withColumn("_block", F.shiftright(code, BLOCK_BITS))
    blocks = totals.groupBy(*group_cols, "_block").agg(*[F.sum(n).alias(f"_b_{n}") for n in names])
    before = Window.partitionBy(*group_cols).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*group_cols, "_block", *[
        F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in names])
    inside = Window.partitionBy(*group_cols, "_block").orderBy(code).rowsBetween(Window.unboundedPreceding, -1)
    local = totals.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in names])
    joined = _join_on(local, blocks, [*group_cols, "_block"])
    return joined.select(*[c for c in totals.columns if c != "_block"], *[
        (F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(f"_off_{n}") for n in names])


def _buckets(df: DataFrame, group_cols: list[str], key: str, weight_cols: list[str], uniform: bool, bucket_rows: int
             ) -> tuple[DataFrame, DataFrame, list[str]]:
    """``df`` with its buckets' codes, the buckets with the sums before them (_off_<i>), and the codes' names."""
    kind = df.schema[key].dataType
    text = isinstance(kind, T.StringType) and not uniform
    names = [f"_t{i}" for i in range(len(weight_cols))]
    offs = [f"_off_{n}" for n in names]
    sums = [F.sum(w).alias(n) for n, w in zip(names, weight_cols)] + [F.count(F.lit(1)).alias("_n")]
    placed, inside, codes, full, parts, limit = df, df, [], None, [], bucket_rows
    while True:
        k = len(codes)
        code = _level(F.col(key), kind, uniform, k).alias(f"_c{k}")
        # rows that can be told apart further: numbers by their second code, strings that go on
        rest = F.max(F.octet_length(key)) > 4 * (k + 1) if text else F.lit(k == 0)
        inside = inside.select("*", code)
        above, codes = codes, [*codes, f"_c{k}"]
        keys = [*group_cols, *codes]
        totals = inside.groupBy(*keys).agg(*sums, rest.alias("_more"))
        run = _running_totals(totals, [*group_cols, *above], codes[k], names)
        if full is None:
            placed = placed.select("*", code)
        else:  # within its over-full code: on top of that code's offset
            run = _join_on(run, full, [*group_cols, *above])
            run = run.select(*keys, *names, "_n", "_more", *[(F.col(o) + F.col(f"_up{o}")).alias(o) for o in offs])
            flagged = _join_on(placed, full.select(*group_cols, *above, F.lit(True).alias("_full")), [*group_cols, *above], "left")
            placed = flagged.select("*", F.when(F.col("_full"), code).otherwise(F.lit(-1)).alias(codes[k])).drop("_full")
        crowded = totals.where("_more").agg(F.max("_n").alias("most")).first()["most"] if _can_go_on(kind, uniform, k) else None
        if not crowded or crowded <= limit:
            parts.append((run, codes))
            break
        if k == 0:
            limit = max(bucket_rows, totals.agg(F.sum("_n")).first()[0] >> 16)
        # at most 2^16 codes hold more than a 2^16th of all rows each
        over = (F.col("_n") > limit) & F.col("_more")
        found = run.checkpoint()
        parts.append((found.where(~over), codes))
        full = F.broadcast(found.where(over).select(*keys, *[F.col(o).alias(f"_up{o}") for o in offs]))
        inside = _join_on(inside, full.select(*keys), keys)
    leaves = None
    for run, known in parts:
        part = run.select(*group_cols, *known, *[F.lit(-1).cast("long").alias(c) for c in codes[len(known):]], *offs)
        leaves = part if leaves is None else leaves.unionByName(part)
    return placed, leaves, codes


def _can_go_on(kind: T.DataType, uniform: bool, k: int) -> bool:
    return k == 0 or isinstance(kind, T.StringType) and not uniform


def running_sum(df: DataFrame, group_cols: list[str], order_cols: list[str], weight_cols: list[str],
                prefix: str = "cum_", uniform: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Inclusive running sums of ``weight_cols`` within each group, in order.

    ``group_cols + order_cols`` should identify a row (pre-aggregate to one
    row per order key otherwise).  ``uniform``: the first ordering key is a hash.
    A job counts the codes first.  No window holds more rows than ``bucket_rows`` or a
    2^16th of all, but for rows that are equal in the first ordering key (numbers beyond 2^53 count as
    equal if their doubles are).
    """
    placed, leaves, codes = _buckets(df, group_cols, order_cols[0], weight_cols, uniform, bucket_rows)
    local = Window.partitionBy(*group_cols, *codes).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_local = placed.select("*", *[F.sum(w).over(local).alias(f"_loc{i}") for i, w in enumerate(weight_cols)])
    joined = _join_on(with_local, leaves, [*group_cols, *codes])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_off__t{i}") + F.col(f"_loc{i}")).alias(f"{prefix}{w}") for i, w in enumerate(weight_cols)])


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str], name: str = "rank",
                uniform: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """0-based position of each row within its group; order must be total."""
    out = running_sum(df.withColumn("_one", F.lit(1)), group_cols, order_cols, ["_one"], "_cum", uniform, bucket_rows)
    return out.withColumn(name, F.col("_cum_one") - 1).drop("_one", "_cum_one")


def _long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) for the non-null values of ``columns`` as double."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids=[], values=columns, variableColumnName="column_name", valueColumnName="value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _digits(bits: Column) -> list[Column]:
    """The digits of a 64-bit code, from the top; the first keeps the sign."""
    out, below = [], 64
    for k, width in enumerate(DIGITS):
        below -= width
        part = F.shiftright(bits, below)
        out.append(part if k == 0 else part.bitwiseAND((1 << width) - 1))
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles: (column_name, prob, quantile).

    Position (n-1)p between the order statistics floor and ceil, as in
    numpy's default, DuckDB ``quantile_cont`` and Spark ``percentile``, but with
    a bounded state per task.  Values are counted by the first digit of their code;
    a window over the digits of a column (2^22 rows at most) finds those that hold
    the wanted positions.  Their values are counted by the next digit, and so on.
    """
    names = [f"_d{k}" for k in range(len(DIGITS))]
    values = _long_values(df, columns)
    values = values.select("*", *[d.alias(n) for d, n in zip(_digits(ordered_bits(F.col("value"))), names)])
    asked = None
    for k, digit in enumerate(names):
        parent = ["column_name", *names[:k]]
        within = Window.partitionBy(*parent)
        upto = within.orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        off = (F.sum("n").over(upto) - F.col("n")).alias("off")
        sums = [F.count(F.lit(1)).alias("n"), F.min("value").alias("value")]
        if asked is None:
            counts = values.groupBy(*parent, digit).agg(*sums).select("*", off, (F.sum("n").over(within) - 1).alias("top"))
            position = lambda p: F.col("top") * F.lit(float(p))
            wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"),
                                        (position(p) - F.floor(position(p))).alias("part"), at(position(p)).cast("long").alias("place"))
                               for p in probs for side, at in (("low", F.floor), ("high", F.ceil))])
        else:
            # two rows per column and probability at most
            near = values.join(F.broadcast(asked), parent)
            counts = near.groupBy(*parent, digit).agg(*sums, F.first("asked").alias("asked")).select("*", off)
            wanted = F.col("asked")
        holds = lambda w: (w["place"] >= F.col("off")) & (w["place"] < F.col("off") + F.col("n"))
        hits = counts.select(*parent, digit, "off", "value", F.filter(wanted, holds).alias("w")).where(F.size("w") > 0)
        if k < len(names) - 1:
            asked = hits.select(*parent, digit, F.transform("w", lambda w: w.withField("place", w["place"] - F.col("off"))).alias("asked"))
    found = hits.select("column_name", F.explode("w").alias("w"), "value")
    pair = found.groupBy("column_name", F.col("w.prob").alias("prob")).agg(
        F.max(F.when(F.col("w.side") == "low", F.col("value"))).alias("low"),
        F.max(F.when(F.col("w.side") == "high", F.col("value"))).alias("high"), F.max("w.part").alias("part"))
    return pair.select("column_name", "prob", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("quantile"))


def exact_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, median)."""
    return exact_quantiles(df, columns, [0.5]).select("column_name", F.col("quantile").alias("median"))


def most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mode, mode_count); ties -> smallest value, NULL excluded.

    (value, count) pairs come from a partial/final aggregate; ``min_by`` over
    them keeps one struct per task, so a hot value costs nothing extra.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        ids=[], values=columns, variableColumnName="column_name", valueColumnName="value")
    counts = long.where(F.col("value").isNotNull()).groupBy("column_name", "value") \
        .agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("neg_n"), F.col("value")))
    return counts.groupBy("column_name").agg(best.alias("b")).select(
        "column_name", F.col("b.value").alias("mode"), F.col("b.n").alias("mode_count"))

