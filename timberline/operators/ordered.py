"""Order-dependent columns over a stream, without putting a whole stream in one task.

A stream (all rows, or the rows of each ``by`` key) is in the order of ``keys``; the first key, a timestamp or a number,
cuts it into consecutive ranges of about RANGE_ROWS rows: at quantiles, and between them evenly. Every quantity is computed
inside the ranges by a window, and what the ranges before contribute comes from one small row a range and stream. Only
those small rows meet. A table that is small by the planner's estimate is one range, for which nothing is looked up, and
nothing is counted, before the one pass over it.

The first key must not be null; rows with a null one are put before all others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 400_000
# A table is small if its estimated size is at most so many bytes a row of one range.
SMALL_ROW_BYTES = 40
# Quantiles that are looked up; GROUP of them are searched at a time.
QUANTILES, GROUP = 256, 16
# Ranges whose small rows are broadcast.
SEND_RANGES = 100_000
_START, _END = Window.unboundedPreceding, Window.unboundedFollowing


def _number(key: str, kind: str) -> Column:
    low = F.lit(-(1 << 62)).cast("long")
    if kind.startswith("timestamp"):
        return F.coalesce(F.unix_micros(F.col(key).cast("timestamp")), low)
    return F.coalesce(F.col(key).cast("long"), low)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of df; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Ranges:
    """Consecutive ranges of numbers: between two cuts, ``fine`` ranges of equal width."""

    def __init__(self, cuts: Sequence[int] = (), fine: int = 1, top: int = 0):
        self.cuts, self.fine, self.top = list(cuts), fine, top

    @classmethod
    def of(cls, df: DataFrame, number: Column) -> Ranges:
        if estimated_bytes(df) <= RANGE_ROWS * SMALL_ROW_BYTES:
            return cls()
        at = [i / QUANTILES for i in range(1, QUANTILES)]
        found = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(number, at, 20 * QUANTILES).alias("q"), F.max(number).alias("top")).first()
        want = (found["n"] or 0) // RANGE_ROWS
        if want <= 1:
            return cls()
        picked = found["q"] if want >= QUANTILES else [found["q"][i * QUANTILES // want - 1] for i in range(1, want)]
        return cls(sorted(set(picked)), -(-want // QUANTILES), found["top"])

    @classmethod
    def by_key(cls, df: DataFrame, key: str) -> Ranges:
        """Of a column that is a stream's first key. They do for every stream made of these rows, or of some of them."""
        return cls.of(df, _number(key, dict(df.dtypes)[key]))

    def __len__(self) -> int:
        return (len(self.cuts) + 1) * self.fine

    def of_value(self, number: Column) -> Column:
        """The number of the range that a value lies in."""
        if not self.cuts:
            return F.lit(0)
        longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        groups = [self.cuts[i : i + GROUP] for i in range(0, len(self.cuts), GROUP)]
        upto = lambda array: F.size(F.filter(array, lambda c: c <= number))
        group = F.greatest(upto(longs([g[0] for g in groups])) - 1, F.lit(0))
        at = group * GROUP + upto(F.get(F.array(*[longs(g) for g in groups]), group))
        if self.fine == 1:
            return at
        low, high = F.get(longs([self.cuts[0], *self.cuts]), at).cast("double"), F.get(longs([*self.cuts, self.top]), at).cast("double")
        inside = F.floor((number.cast("double") - low) * self.fine / F.greatest(high - low, F.lit(1.0)))
        return (at * self.fine + F.when(at == 0, 0).otherwise(F.least(F.greatest(inside, F.lit(0)), F.lit(self.fine - 1)))).cast("int")


class Stream:
    """A DataFrame cut into ranges. Methods return new Streams; ``df`` gives the rows with the added columns."""

    def __init__(self, df: DataFrame, keys: Sequence[str], by: Sequence[str] = (), ranges: Ranges | None = None):
        self.keys, self.by = list(keys), list(by)
        self.number = _number(keys[0], dict(df.dtypes)[keys[0]])
        self.ranges = Ranges.of(df, self.number) if ranges is None else ranges
        self.one = not self.ranges.cuts
        self._df = df.withColumn("_range", self.ranges.of_value(self.number))

    def _with(self, df: DataFrame) -> Stream:
        new = object.__new__(Stream)
        new.__dict__.update(self.__dict__)
        new._df = df
        return new

    @property
    def df(self) -> DataFrame:
        return self._df.drop("_range")

    def inside(self):
        """The rows of a range and stream, in order."""
        return Window.partitionBy(*self.by, "_range").orderBy(*self.keys)

    def whole(self):
        """The rows of a range and stream, as a set."""
        return Window.partitionBy(*self.by, "_range")

    def _carry(self, values: Mapping[str, Column], over_ranges) -> DataFrame:
        """by, _range, and over_ranges(column, windows) of each of ``values`` aggregated a range."""
        small = self._df.groupBy(*self.by, "_range").agg(*[v.alias(k) for k, v in values.items()])
        order = Window.partitionBy(*(self.by or [F.lit(1)])).orderBy("_range")
        return small.select(*self.by, "_range", *[c.alias(k) for k, c in over_ranges(order.rowsBetween(_START, -1), order.rowsBetween(1, _END), order.rowsBetween(_START, _END)).items()])

    def _join(self, small: DataFrame) -> DataFrame:
        if not self.by:
            return self._df.join(F.broadcast(small) if len(self.ranges) <= SEND_RANGES else small, "_range")
        renamed = small.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(self.by)], F.col("_range").alias("_r"), *[c for c in small.columns if c not in (*self.by, "_range")])
        on = F.col("_range") == F.col("_r")
        for i, b in enumerate(self.by):
            on &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
        return self._df.join(renamed, on).drop("_r", *[f"_by{i}" for i in range(len(self.by))])

    def running_sums(self, values: Mapping[str, Column]) -> Stream:
        """For each value, a bigint (null: 0), its sum up to and with each row. All in one pass."""
        names = {out: f"_v{i}" for i, out in enumerate(values)}
        self = self._with(self._df.withColumns({names[out]: F.coalesce(v, F.lit(0)).cast("long") for out, v in values.items()}))
        sums = {out: F.sum(v).over(self.inside().rowsBetween(_START, 0)) for out, v in names.items()}
        if self.one:
            return self._with(self._df.withColumns({out: c.cast("long") for out, c in sums.items()}).drop(*names.values()))
        before = self._carry({f"_b{v}": F.sum(v) for v in names.values()}, lambda w, *_: {f"_b{v}": F.coalesce(F.sum(f"_b{v}").over(w), F.lit(0)) for v in names.values()})
        df = self._join(before).withColumns({out: (F.col(f"_b{names[out]}") + c).cast("long") for out, c in sums.items()})
        return self._with(df.drop(*names.values(), *[f"_b{v}" for v in names.values()]))

    def running_sum(self, value: Column, out: str) -> Stream:
        return self.running_sums({out: value})

    def position(self, out: str) -> Stream:
        """1 for the first row, and so on."""
        return self.running_sums({out: F.lit(1)})

    def last_before(self, value: Column, out: str, ignore_nulls: bool = False) -> Stream:
        """The value of the row before, or with ignore_nulls the last one before that isn't null."""
        self = self._with(self._df.withColumn("_v", value))
        boxed = F.struct(F.col("_v").alias("v"))
        here = F.last(F.when(F.col("_v").isNotNull(), boxed) if ignore_nulls else boxed, ignorenulls=True).over(self.inside().rowsBetween(_START, -1))
        if self.one:
            return self._with(self._df.withColumn(out, here["v"]).drop("_v"))
        order = F.struct(*self.keys)
        tail = F.max_by(boxed, F.when(F.col("_v").isNotNull(), order) if ignore_nulls else order)
        carried = self._carry({"_tail": tail}, lambda w, *_: {"_tail": F.last("_tail", ignorenulls=True).over(w)})
        return self._with(self._join(carried).withColumn(out, F.coalesce(here, F.col("_tail"))["v"]).drop("_tail", "_v"))

    def position_and_last(self, value: Column, position: str, last: str, total: str) -> Stream:
        """position() and last_before(value) in one pass, and the number of rows of the whole stream."""
        self = self._with(self._df.withColumn("_v", F.struct(value.alias("v"))))
        inside = self.inside()
        number, was, rows = F.row_number().over(inside).cast("long"), F.lag("_v").over(inside), F.count(F.lit(1)).over(self.whole())
        if self.one:
            return self._with(self._df.withColumns({position: number, last: was["v"], total: rows}).drop("_v"))
        before = self._carry(
            {"_count": F.count(F.lit(1)), "_tail": F.max_by("_v", F.struct(*self.keys))},
            lambda w, _, every: {"_count": F.coalesce(F.sum("_count").over(w), F.lit(0)), "_tail": F.last("_tail").over(w), total: F.sum("_count").over(every)},
        )
        df = self._join(before).withColumns({position: F.col("_count") + number, last: F.coalesce(was, F.col("_tail"))["v"]})
        return self._with(df.drop("_count", "_tail", "_v"))

    def next_of_ranges(self, value: Column, out: str) -> Stream:
        """The least value of all later ranges; null in a stream of one range."""
        if self.one:
            return self._with(self._df.withColumn(out, F.lit(None).cast("long")))
        return self._with(self._join(self._carry({out: F.min(value)}, lambda _, later, __: {out: F.min(out).over(later)})))

    def max_before(self, value: Column, out: str) -> Stream:
        """The greatest value of all rows before."""
        self = self._with(self._df.withColumn("_v", value))
        here = F.max("_v").over(self.inside().rowsBetween(_START, -1))
        if self.one:
            return self._with(self._df.withColumn(out, here).drop("_v"))
        top = self._carry({"_top": F.max("_v")}, lambda w, *_: {"_top": F.max("_top").over(w)})
        return self._with(self._join(top).withColumn(out, F.greatest(here, F.col("_top"))).drop("_top", "_v"))

    def trailing_count(self, seconds: float, out: str, same: Sequence[str] = (), peers: bool = False) -> Stream:
        """Rows not after this one in the stream whose first key (a timestamp) is at most ``seconds`` older; same: of equal values there.

        Of rows with an equal timestamp only those up to this one count, with ``peers`` all. The closed window reaches back into earlier
        ranges: a row is lent, without its other columns, to the range in which it goes out of reach; for the ranges
        between, which it reaches throughout, it is only counted.
        """
        width = round(seconds * 1_000_000)
        streams = [*self.by, *same]
        df = self._df.withColumn("_us", self.number)
        near = lambda part: F.count(F.lit(1)).over(Window.partitionBy(*streams, part).orderBy("_us").rangeBetween(-width, 0))
        equal = lambda part: Window.partitionBy(*streams, part, "_us")
        after = lambda part: F.count(F.lit(1)).over(equal(part)) - F.row_number().over(equal(part).orderBy(*self.keys))
        count = lambda part: near(part) if peers else near(part) - after(part)
        if self.one:
            return self._with(df.withColumn(out, count("_range").cast("long")).drop("_us"))
        df = df.withColumn("_out", self.ranges.of_value(F.col("_us") + width))
        rest = [c for c in self._df.columns if c not in (*streams, *self.keys, "_range")]
        places = F.when(F.col("_out") > F.col("_range"), F.array("_range", "_out")).otherwise(F.array("_range"))
        lent = df.select(*streams, *[k for k in self.keys if k not in streams], "_us", "_range", F.struct(*rest, F.lit(0)).alias("_row"), F.explode(places).alias("_in"))
        own = F.col("_in") == F.col("_range")
        lent = lent.withColumn("_row", F.when(own, F.col("_row")))
        counted = lent.withColumn(out, count("_in")).filter(own)
        # rows of earlier ranges that are in reach throughout a range: they come in after their own, and go out in _out
        spans = df.groupBy(*streams, "_range", "_out").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_out") > F.col("_range") + 1)
        steps = F.explode(F.array(F.struct((F.col("_range") + 1).alias("_at"), F.col("_n").alias("_d")), F.struct(F.col("_out").alias("_at"), (-F.col("_n")).alias("_d"))))
        steps = spans.select(*streams, steps.alias("_s")).select(*streams, "_s.*").groupBy(*streams, "_at").agg(F.sum("_d").alias("_d"))
        here = df.select(*streams, F.col("_range").alias("_at"), F.lit(0).cast("long").alias("_d")).distinct()
        through = Window.partitionBy(*(streams or [F.lit(1)])).orderBy("_at").rangeBetween(_START, 0)
        level = steps.unionByName(here).withColumn("_level", F.sum("_d").over(through)).select(*streams, F.col("_at").alias("_range"), "_level").distinct()
        base = self._with(counted)
        base.by = streams
        joined = base._join(level).withColumn(out, (F.col(out) + F.col("_level")).cast("long"))
        others = [c for c in self._df.columns if c not in rest]
        return self._with(joined.select(*others, *[F.col("_row")[c].alias(c) for c in rest], out))
