"""Hard-negative mining: for every anchor and positive the best rows of other labels in a window below the positive's score.

A row's score is the exact inner product of integer vectors (each component is floor(quantum * x)).
An anchor's positives are its best rows of the same label. A positive of score p admits negatives
from ``low`` to ``high`` hundredths of p. The windows of an anchor's positives overlap; their upper
limits cut the scores into disjoint slots. Every task keeps the best few rows of each slot, as does
the merge of the tasks' results, and since a window's best rows are among the best of its own slot
and all slots below, a merge of these slots in descending order answers all windows at once.

Anchors are a stated query set that meets all rows in blocks: rows and anchors are dealt to groups
of bounded size, and each pair of groups is one task's work. What tasks return is bounded by the
anchors, never by pairs.

Results:

* rows with a null label or vector, or a null or non-finite component, take no part; a null id is
  never an anchor and stands last in ties;
* an empty vector scores 0; of vectors of unequal length the shorter counts as filled with zeros;
* ties go to the smaller id; a repeated row counts as often as it is there, except as an anchor: of
  several anchors with one id the least by label and vector is it, and no row of its id is its
  positive or negative;
* a negative positive score admits nothing; anchors without positives and empty tables have no rows;
* scores beyond 64 bits are an error; input columns of other names are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.scratch import Scratch

#: Most rows and anchors of a pair of groups, on average.
ROWS, ANCHORS = 65_536, 65_536
#: Scores that a task holds at a time.
_TILE = 4_000_000
_LAST = np.iinfo(np.int64).max


def usable(label: str, vector: str) -> Column:
    """Rows that take part."""
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & sound


def _matrix(column: pa.ChunkedArray, width: int, quantum: float) -> np.ndarray:
    """The vectors as rows of floor(quantum * x), filled with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(np.asarray(lists.flatten(), np.float64) * quantum)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max([1, *(len(x) for c in columns for x in c)])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: no partial sum exceeds the product of the norms."""
    norm = lambda m: float(np.sqrt((m * m).sum(axis=1)).max(initial=0.0))
    bound = norm(a) * norm(b)
    if bound < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 1 << 52:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    out = whole(a) @ whole(b).T
    if max(map(abs, out.ravel()), default=0) > _LAST:
        raise ArithmeticError("a score needs more than 64 bits")
    return out.astype(np.int64)


def best(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the places ``at`` (ascending) the ``n`` of greatest value; the first places win ties. In no order."""
    if len(at) <= n:
        return at
    mine = values[at]
    least = np.partition(mine, len(at) - n)[len(at) - n]
    above = at[mine > least]
    return np.concatenate([above, at[mine == least][: n - len(above)]])


def _cells(rows: DataFrame, anchors: DataFrame, row_groups: int, anchor_groups: int, work, schema: str, quantum: float) -> DataFrame:
    """``work(anchor table, its products, row ids, row labels, tile's first anchor)`` for all pairs of groups.

    Ids decide the group; a row without one goes by its vector.
    """
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64(F.coalesce(F.col("vec_id"), F.xxhash64("vector", "label"))), F.lit(n)).cast("int")
    left = anchors.toDF(*anchors.columns).withColumns({"ag": place(anchor_groups), "rg": spread(row_groups)})
    right = rows.toDF(*rows.columns).withColumns({"rg": place(row_groups), "ag": spread(anchor_groups)})

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        empty = schema_arrow.empty_table()
        if not a.num_rows or not r.num_rows:
            return empty
        ids = r["vec_id"].fill_null(_LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        r, ids = r.take(pa.array(order)), ids[order]
        labels = r["label"].to_numpy()
        width = _width(a["vector"], r["vector"])
        b = _matrix(r["vector"], width, quantum)
        m = _matrix(a["vector"], width, quantum)
        step, out = max(1, _TILE // len(ids)), []
        for first in range(0, a.num_rows, step):
            part = a.slice(first, step)
            out += work(part, scores(m[first : first + step], b), ids, labels)
        if not out:
            return empty
        return pa.table([pa.array([x[k] for x in out], t.type) for k, t in enumerate(schema_arrow)], schema=schema_arrow)

    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema_arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return left.groupBy("ag", "rg").cogroup(right.groupBy("ag", "rg")).applyInArrow(run, schema)


def _held(value: int) -> int | None:
    return None if value == _LAST else int(value)


def _share(p: str, hundredths: int, up: bool) -> Column:
    """hundredths * p / 100, rounded up or down, for p >= 0, without a product that leaves 64 bits."""
    whole, rest = F.expr(f"{p} div 100"), F.expr(f"{p} % 100")
    return whole * hundredths + F.floor((rest * hundredths + (99 if up else 0)) / 100).cast("long")


def mine(df: DataFrame, scratch: Scratch, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, quantum: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are ids divisible by ``every``."""
    spark = df.sparkSession
    rows = df.filter(usable(label, vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    chosen = rows.filter(F.col("vec_id") % every == 0)
    anchors = chosen.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("_r")).select("vec_id", "_r.label", "_r.vector")
    n = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_groups, anchor_groups = max(-(-n["rows"] // ROWS), min(tasks, -(-n["rows"] // 256)), 1), max(-(-n["anchors"] // ANCHORS), 1)

    def same_label(a: pa.Table, s: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[tuple]:
        out, of = [], {int(x): np.flatnonzero(labels == x) for x in set(a["label"].to_pylist())}
        for i, (own, kind) in enumerate(zip(a["vec_id"].to_pylist(), a["label"].to_pylist())):
            at = of[kind]
            at = best(s[i], at[ids[at] != own], positives)
            out += [(own, int(s[i, k]), _held(ids[k])) for k in at.tolist()]
        return out

    found = _cells(rows, anchors, row_groups, anchor_groups, same_label, "anchor_id long, score long, other long", quantum)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    top = found.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= positives)
    windows = top.filter("score >= 0").withColumns({"upper": _share("score", high, False), "lower": _share("score", low, True)}).filter("lower <= upper")
    each = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("lower"), F.array_sort(F.collect_list(F.struct("_at", "other", "score", "upper", "lower"))).alias("pos"))
    each = scratch.save(each, "positives")  # the scores behind it are computed once
    asked = anchors.join(each.withColumnRenamed("anchor_id", "_a"), F.col("vec_id") == F.col("_a")).drop("_a")

    def other_labels(a: pa.Table, s: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[tuple]:
        out = []
        for i, (own, kind, uppers, lower) in enumerate(zip(a["vec_id"].to_pylist(), a["label"].to_pylist(), a["uppers"].to_pylist(), a["lower"].to_pylist())):
            at = np.flatnonzero((s[i] >= lower) & (s[i] <= uppers[0]) & (labels != kind) & (ids != own))
            # slot j: above uppers[j + 1], up to uppers[j]
            slot = len(uppers) - 1 - np.searchsorted(np.array(uppers[::-1]), s[i][at], side="left")
            for j in range(len(uppers)):
                out += [(own, j, int(s[i, k]), _held(ids[k])) for k in best(s[i], at[slot == j], negatives).tolist()]
        return out

    kept = _cells(rows, asked.drop("pos"), row_groups, anchor_groups, other_labels, "anchor_id long, slot int, score long, other long", quantum)
    within = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    slots = kept.withColumn("_at", F.row_number().over(within)).filter(F.col("_at") <= negatives)
    # at most positives * negatives rows an anchor
    gathered = slots.groupBy(F.col("anchor_id").alias("_a")).agg(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("other").isNull().alias("none"), "other", "slot")).alias("rows"))
    met = each.join(gathered, F.col("anchor_id") == F.col("_a")).select("anchor_id", "uppers", F.array_sort("rows").alias("rows"), F.explode("pos").alias("p"))
    own_slot = F.array_position("uppers", F.col("p.upper")) - 1
    merged = F.slice(F.filter("rows", lambda x: x["slot"] >= own_slot), 1, negatives)
    answer = F.filter(merged, lambda x: -x["less"] >= F.col("p.lower"))
    out = met.select("anchor_id", F.col("p.other").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(answer).alias("at", "x"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.other").alias("negative_id"), "positive_score", (-F.col("x.less")).alias("negative_score"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5
), m AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INT) AS rank
  FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3
"""
