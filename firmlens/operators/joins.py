"""Join shapes: existence, latest before, intervals, as-of, nearest within a tolerance, several scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.frames import first_per_key, top_n_per_key


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def having(df: DataFrame, other: DataFrame, key: str | Sequence[str], condition: Column | None = None) -> DataFrame:
    """Rows with a match among the rows of ``other`` for which the condition holds."""
    return df.join(other if condition is None else other.filter(condition), _keys(key), "left_semi")


def lacking(df: DataFrame, other: DataFrame, key: str | Sequence[str], condition: Column | None = None) -> DataFrame:
    """Rows without such a match."""
    return df.join(other if condition is None else other.filter(condition), _keys(key), "left_anti")


def ticks(df: DataFrame, column: str) -> Column:
    """A date as days, a timestamp as microseconds, a whole number as it is."""
    kind = dict(df.dtypes)[column]
    if kind == "date":
        return F.unix_date(column).cast("long")
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.col(column).cast("long")


def latest_before(df: DataFrame, other: DataFrame, key: str, at: str, other_at: str, carry: Sequence[str], prefix: str = "before_") -> DataFrame:
    """Each row with the columns of the latest row of ``other`` of its key strictly before it; ties by the carried columns.

    Both tables lie in one window by key and time, so no row meets every earlier row of its key, and
    rows are carried whole: equal rows stay apart without a number or a hash. A null key or time finds nothing.
    """
    found = F.struct(F.col(other_at), *carry)
    right = other.filter(F.col(key).isNotNull() & F.col(other_at).isNotNull()).select(F.col(key).alias("_k"), ticks(other, other_at).alias("_t"), found.alias("_o"))
    left = df.select(F.col(key).alias("_k"), ticks(df, at).alias("_t"), F.struct(*df.columns).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    # rows with a null key have no right rows beside them: each goes its own way, not to one group
    order = Window.partitionBy("_k", F.when(F.col("_k").isNull(), F.xxhash64("_row"))).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("_best", F.when(F.col("_t").isNotNull(), F.max("_o").over(order))).filter(F.col("_row").isNotNull())
    return met.select("_row.*", *(F.col(f"_best.{c}").alias(prefix + c) for c in carry))


def active_at(spans: DataFrame, points: Sequence[str], start: str, end: str, point: str) -> DataFrame:
    """(span row, point) for every one of the days ``points`` (ISO dates, a short list of the caller's) inside a span.

    Ends are included and an open end reaches every point. Each span makes the list of its own points,
    so there is no join at all.
    """
    inside = F.filter(F.array(*(F.lit(p).cast("date") for p in points)), lambda p: (F.col(start) <= p) & (F.col(end).isNull() | (F.col(end) >= p)))
    return spans.withColumn(point, F.explode(inside))


def asof_join(df: DataFrame, key: str, at: str, carry: Sequence[str], min_gap_days: int, prefix: str = "prev_") -> DataFrame:
    """Each row with the columns of the latest row of its key at least ``min_gap_days`` before it.

    One window over the key: a range frame in days ends ``min_gap_days`` before the row, so there is
    no self join. Of rows of one day the greatest by the carried columns counts.
    """
    day = F.datediff(F.col(at), F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy(key).orderBy(day).rangeBetween(Window.unboundedPreceding, -min_gap_days)
    found = df.withColumn("_prev", F.max(F.struct(F.col(at), *[c for c in carry if c != at])).over(frame))
    return found.select(*df.columns, *(F.col(f"_prev.{c}").alias(prefix + c) for c in carry))


def last_start_before(events: DataFrame, spans: DataFrame, key: Sequence[str], at: str, start: str, out: str = "span_start") -> DataFrame:
    """Each event with the latest start of a span of its key that isn't after it.

    Events and starts lie in one window by key and time, so no event meets every span of its key.
    """
    names = list(events.columns)
    marked = events.select(*key, F.col(at).alias("_at"), F.lit(None).cast(spans.schema[start].dataType).alias("_start"), F.struct(*names).alias("_row"))
    starts = spans.filter(F.col(start).isNotNull()).select(*key, F.col(start).alias("_at"), F.col(start).alias("_start"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row")).distinct()
    order = Window.partitionBy(*key).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = marked.union(starts).withColumn(out, F.max("_start").over(order)).filter(F.col("_row").isNotNull())
    return found.select("_row.*", out)


def _near_pairs(left: DataFrame, right: DataFrame, key: str, at: str, other_at: str, lo: int, hi: int, carry: Sequence[str], order: Sequence[str], other_than: str | None) -> DataFrame:
    """Different (key, date, other_than) of ``left`` with the right rows that may be nearest to them."""
    than = [F.col(other_than).alias("_than")] if other_than else []
    r = right.select(F.col(key).alias("_k"), F.unix_date(F.to_date(other_at)).alias("_day"), *(F.col(c).alias(f"_o_{c}") for c in order), *(F.col(c).alias(f"_c_{c}") for c in carry), *than)
    r = r.filter("_day is not null" + (" and _than is not null" if other_than else ""))
    rank = [*(F.col(f"_o_{c}").desc_nulls_last() for c in order), *(F.col(f"_c_{c}").asc_nulls_last() for c in carry)]
    if other_than:  # whatever a left row's own value, the best row with another one is among the best two of different values
        r = first_per_key(r, ["_k", "_day", "_than"], rank)
        r = top_n_per_key(r, ["_k", "_day"], [*rank, F.asc("_than")], 2)
    else:
        r = first_per_key(r, ["_k", "_day"], rank)
    width = hi - lo + 1
    band = lambda day: F.floor(day / width).cast("long")
    by = list(dict.fromkeys([key, at, *([other_than] if other_than else [])]))
    asked = left.select(*by).distinct().withColumn("_of", F.unix_date(F.to_date(at)))
    bands = asked.withColumn("_band", F.explode(F.array_distinct(F.array(band(F.col("_of") + lo), band(F.col("_of") + hi)))))
    met = bands.join(r.withColumn("_b", band(F.col("_day"))), (F.col(key) == F.col("_k")) & (F.col("_band") == F.col("_b")) & (F.col("_day") - F.col("_of")).between(lo, hi))
    return met.filter(F.col("_than") != F.col(other_than)) if other_than else met


def nearest_join(left: DataFrame, right: DataFrame, key: str, at: str, other_at: str, lo: int, hi: int, carry: Sequence[str], order: Sequence[str] = (), other_than: str | None = None, prefix: str = "") -> DataFrame:
    """Each left row with the nearest right row of its key whose date lies from ``lo`` to ``hi`` days after it.

    Ties go to the row with the greatest ``order`` columns, then by the least carried ones. With
    ``other_than`` a right row with the same value there doesn't count. Dates lie in bands as wide as the
    tolerance; a date's window reaches into two of them, and rows meet by key and band. Of the right rows of a
    key and day only those that can win are left, at most two. So a key that holds all rows is spread over its
    bands, and pairs are bounded by the tolerance for each date, never by the rows of a key. What is found
    depends on the key, the date and the value alone: it is found once for each of these and joined back.
    """
    by = list(dict.fromkeys([key, at, *([other_than] if other_than else [])]))
    met = _near_pairs(left, right, key, at, other_at, lo, hi, carry, order, other_than)
    best = first_per_key(met, by, [F.abs(F.col("_day") - F.col("_of")), *(F.col(f"_o_{c}").desc_nulls_last() for c in order), *(F.col(f"_c_{c}").asc_nulls_last() for c in carry)])
    found = best.select(*(F.col(c).alias(f"_b_{c}") for c in by), *(F.col(f"_c_{c}").alias(prefix + c) for c in carry))
    same = [F.col(c) == F.col(f"_b_{c}") for c in by]
    return left.join(found, same, "left").drop(*(f"_b_{c}" for c in by))


#: An interval is cut into pieces of at least a quarter of its length: six at most.
_PIECES = 4


def _pieces(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points with the intervals of their key of which a piece lies in their stretch of time, a superset of those that hold them."""
    reach = points.agg(F.min(ticks(points, at)).alias("lo"), F.max(ticks(points, at)).alias("hi")).first()
    lo, hi = (0, -1) if reach["lo"] is None else (reach["lo"], reach["hi"])
    cut = intervals.withColumnRenamed(key, "_k").withColumns({"_s": F.greatest(ticks(intervals, start), F.lit(lo)), "_e": F.least(F.coalesce(ticks(intervals, end), F.lit(hi + 1)), F.lit(hi + 1))})
    cut = cut.filter("_s < _e and _k is not null").withColumn("_m", F.greatest(F.ceil(F.log2((F.col("_e") - F.col("_s")) / _PIECES)), F.lit(0)).cast("int"))
    sizes = sorted(r[0] for r in cut.select("_m").distinct().collect())  # powers of two, 63 at most
    laid = cut.withColumn("_cell", F.explode(F.sequence(F.expr("shiftright(_s, _m)"), F.expr("shiftright(_e - 1, _m)")))).drop("_s", "_e")
    t = ticks(points, at)
    cells = F.array(*(F.struct(F.lit(m).alias("_pm"), F.shiftright(t, m).alias("_pcell")) for m in sizes)) if sizes else F.array().cast("array<struct<_pm:int,_pcell:bigint>>")
    stood = points.select("*", F.inline(cells))
    return stood.join(laid, (F.col(key) == F.col("_k")) & (F.col("_pm") == F.col("_m")) & (F.col("_pcell") == F.col("_cell"))).drop("_pm", "_pcell", "_m", "_cell", "_k")


def within(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points joined to the intervals of their key that hold them: start included, end not; an open end holds all.

    Time is cut into stretches by powers of two. An interval is laid over the few stretches of the size that
    suits its length, a point lies in one stretch of each size that is in use, and the two meet by key, size
    and stretch, each pair once. So intervals long and short are found by equality, and a key that holds all
    rows is spread over time. The times' range and the sizes in use, a few numbers, are read beforehand.
    """
    return _pieces(points, intervals, key, at, start, end).filter((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end))))


def prefix_table(df: DataFrame, name: str, order: Sequence[Column], scope: Sequence[str] = (), least_words: int = 1, prefix: str = "prefix", exact: str = "exact") -> DataFrame:
    """For every beginning of whole words of a name the best row that has it: (scope, prefix, exact, the row's other columns).

    A row whose whole name it is comes before rows that only begin with it, then ``order`` decides, which must be
    total. Beginnings have at least ``least_words`` words; a whole name counts whatever its length. So who looks a
    name up finds it by equality, at most one row, and nothing that isn't a match is ever paired. Names are of
    single spaces; blank ones and null ones have no beginning.
    """
    words = F.split(F.col(name), " ")
    shorter = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.when((k >= least_words) | (k == F.size(words)), F.array_join(F.slice(words, F.lit(1), k), " ")))
    rows = df.filter(F.col(name) != "").withColumn(prefix, F.explode(F.array_compact(shorter)))
    return first_per_key(rows.withColumn(exact, F.col(prefix) == F.col(name)), [*scope, prefix], [F.desc(exact), *order])


def phrase_join(df: DataFrame, name: str, rules: Sequence[tuple[str, str]], id_col: str = "rule_id", whole_words: bool = True) -> DataFrame:
    """Each row with the id of the longest rule phrase that its name begins with, matched on different names only.

    ``rules`` are (id, phrase): a fixed list of the caller. The best rule is chosen per distinct name in
    one expression, so neither side is crossed with the other.
    """
    boundary = "( |$)" if whole_words else ""
    chain = F.lit(None).cast("string")
    for rule_id, phrase in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        hit = F.col(name).rlike("^" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in phrase) + boundary)
        chain = F.when(hit, F.lit(rule_id)).otherwise(chain)
    names = df.select(name).distinct().withColumn(id_col, chain)
    return df.join(names.withColumnRenamed(name, "_name"), F.col(name).eqNullSafe(F.col("_name")), "left").drop("_name")


def fingerprint_diff(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, change) with change one of added, removed, updated, unchanged."""
    o, n = old.select(F.col(key).alias("_o"), F.col(mark).alias("_om")), new.select(F.col(key).alias("_n"), F.col(mark).alias("_nm"))
    joined = o.join(n, F.col("_o") == F.col("_n"), "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_om").eqNullSafe(F.col("_nm")), "unchanged").otherwise("updated")
    return joined.select(F.coalesce("_n", "_o").alias(key), change.alias("change"))


def multi_scope_join(df: DataFrame, scopes: dict[str, str], listed: DataFrame, row: str, scope: str = "scope", value: str = "value", out: str = "scopes_hit") -> DataFrame:
    """Each row with the sorted scopes under which it is listed.

    ``scopes`` names the column that a scope looks at. Every row becomes its few candidate
    (scope, value) pairs and one equi join finds the listed ones, in place of a join on alternatives.
    """
    pairs = F.array(*(F.struct(F.lit(s).alias(scope), F.col(c).cast("string").alias(value)) for s, c in scopes.items()))
    wanted = df.select(F.col(row).alias("_row"), F.inline(pairs)).filter(F.col(value).isNotNull())
    hit = wanted.join(listed.select(scope, value).distinct(), [scope, value]).groupBy("_row").agg(F.array_sort(F.collect_set(scope)).alias(out))
    return df.join(hit, F.col(row) == F.col("_row"), "left").drop("_row")
