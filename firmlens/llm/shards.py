"""Sharding by a k-d tree: rows are split at weighted medians of their widest metadata dimension until every leaf is a shard.

A node that stands for k shards is split so that its left part holds floor(k / 2) / k of its bytes;
the dimension is the one whose range within the node is the greatest share of the range over all rows.
The median is exact: rows are in order of the dimension and then of a hash of the row, and the
split lies at the row at which the sum of bytes comes nearest to the wanted one. It is found by
refinement: bytes are summed by bins of the range, the bin that holds the median is looked into
again until it is one value, and rows of one value go on by hash in the same way. So a source that
holds a third of all rows is divided like any other, without a sort and without a shuffle of
rows: each step sums over all tasks and the driver receives one row for each node. Every
shard's bytes differ from an equal share by less than the largest document or two.

Rows that are equal in all kept columns are counted before anything else and numbered, so copies
without distinct ids are divided too. ``shards`` fixes the number of leaves; with ``target_bytes``
it is the number of leaves of that size that all rows fill.

Results:

* a null text has size 1, as an empty one; null dimensions come first; nulls in other columns are values;
* a shard may be empty if there are fewer rows than shards; an empty table has no rows;
* equal texts are rows like others: they go where their metadata and hash put them;
* repeated rows are all kept, each with a slot of its own; reruns agree, whatever the partitions;
* an input column with the name of a new one gives way to it.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.scratch import Scratch
from .bpe import room

#: Bins of a refinement step.
BINS = 4096
#: Levels of the tree after which each row's node is written, which bounds the conditions of a plan.
_SETTLE = 4
#: Copies of a row that are numbered at a time.
_COPIES = 65_536


def size_of(text: str = "text") -> Column:
    """Bytes of the text in UTF-8 and one more; 1 for null."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def order_of(column: str) -> Column:
    """A text's first six bytes as a number, which keeps their order; -1 for null."""
    digits = F.rpad(F.hex(F.substring(F.col(column).cast("string").cast("binary"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("double"), F.lit(-1.0))


def number(column: str) -> Column:
    """A numeric dimension; null and what isn't a number come first."""
    value = F.col(column).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(-1e300)).otherwise(F.greatest(F.least(value, F.lit(1e300)), F.lit(-1e300)))


@dataclass
class _Node:
    """A node of the tree: its shards, the conditions on the way to it, and how far the search for its split has come."""

    number: int
    first: int
    leaves: int
    path: Column
    dim: int = 0
    target: float = 0.0
    below: float = 0.0
    lo: float = 0.0
    hi: float = 0.0
    value: float | None = None
    split: Column | None = None
    parts: list = field(default_factory=list)


def _bins(rows: DataFrame, open_nodes: list[_Node]) -> list:
    """Of each node the bin that holds its median: (node, before, w, lo, hi, n)."""
    x, bin_, inside = F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for q in open_nodes:
        own = F.col(f"_d{q.dim}") if q.value is None else F.col("_h")
        held = q.path & own.between(q.lo, q.hi) & (F.lit(True) if q.value is None else F.col(f"_d{q.dim}") == q.value)
        x, inside = F.when(held, own).otherwise(x), F.when(held, q.number).otherwise(inside)
        scale = BINS / (q.hi - q.lo) if q.hi > q.lo else 0.0
        bin_ = F.when(held, F.least(F.floor((own - q.lo) * scale), F.lit(BINS - 1)).cast("int")).otherwise(bin_)
    seen = rows.select(inside.alias("node"), bin_.alias("bin"), x.alias("x"), "_size").filter("node is not null")
    summed = seen.groupBy("node", "bin").agg(F.sum("_size").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))  # at most BINS rows a node
    wanted = F.lit(0.0)
    for q in open_nodes:
        wanted = F.when(F.col("node") == q.number, q.target - q.below).otherwise(wanted)
    placed = summed.withColumn("upto", upto).filter(F.col("upto") >= wanted)
    return placed.groupBy("node").agg(F.min_by(F.struct((F.col("upto") - F.col("w")).alias("before"), "w", "lo", "hi", "n"), "bin").alias("b")).select("node", "b.*").collect()


def _find(rows: DataFrame, nodes: list[_Node]) -> None:
    """Give every node its split, a condition that holds for its left rows."""
    waiting = list(nodes)
    while waiting:
        got = {r["node"]: r for r in _bins(rows, waiting)}
        after = []
        for q in waiting:
            r = got[q.number]
            q.below += r["before"]
            q.lo, q.hi = r["lo"], r["hi"]
            own = F.col(f"_d{q.dim}")
            nearer = q.below + r["w"] - q.target <= q.target - q.below
            if q.value is not None and q.lo == q.hi:
                tied = F.col("_h") <= q.lo if nearer else F.col("_h") < q.lo
                q.split = (own < q.value) | ((own == q.value) & tied)
            elif q.value is None and r["n"] == 1:
                q.split = own <= q.lo if nearer else own < q.lo
            else:
                if q.value is None and q.lo == q.hi:
                    q.value, q.lo, q.hi = q.lo, 0.0, 1.0
                after.append(q)
        waiting = after


def _tree(rows: DataFrame, n_dims: int, shards: int, scratch: Scratch) -> tuple[DataFrame, Column]:
    """The rows and the column of their shard."""
    limits = lambda k: [f(f"_d{k}").alias(f"{name}{k}") for name, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(*(c for k in range(n_dims) for c in limits(k)), F.sum("_size").alias("w")).first()
    nodes, level = [_Node(0, 0, shards, F.lit(True))], 0
    if whole["w"] is None:
        return rows, F.lit(0)
    while any(q.leaves > 1 for q in nodes):
        growing = [q for q in nodes if q.leaves > 1]
        at = F.lit(None).cast("int")
        for q in growing:
            at = F.when(q.path, q.number).otherwise(at)
        stats = rows.withColumn("node", at).filter("node is not null").groupBy("node").agg(*(c for k in range(n_dims) for c in limits(k)), F.sum("_size").alias("w"), F.count("*").alias("n")).collect()
        of, asked = {r["node"]: r for r in stats}, []
        for q in growing:
            if (r := of.get(q.number)) is None:  # no rows: its shards stay empty
                q.split = F.lit(True)
                continue
            spread = [(r[f"hi{k}"] - r[f"lo{k}"]) / (whole[f"hi{k}"] - whole[f"lo{k}"]) if whole[f"hi{k}"] > whole[f"lo{k}"] else 0.0 for k in range(n_dims)]
            q.dim = max(range(n_dims), key=lambda k: (spread[k], -k))
            q.target, q.lo, q.hi = r["w"] * (q.leaves // 2) / q.leaves, r[f"lo{q.dim}"], r[f"hi{q.dim}"]
            asked.append(q)
        _find(rows, asked)
        grown = []
        for q in nodes:
            if q.leaves == 1:
                grown.append(q)
                continue
            left = q.leaves // 2
            grown.append(_Node(0, q.first, left, q.path & q.split))
            grown.append(_Node(0, q.first + left, q.leaves - left, q.path & ~q.split))
        nodes = grown
        for k, q in enumerate(nodes):
            q.number = k
        level += 1
        if level % _SETTLE == 0 and any(q.leaves > 1 for q in nodes):
            rows = scratch.save(rows.withColumn("_node", _by_path(nodes, lambda q: q.number)), "nodes")
            for q in nodes:
                q.path = F.col("_node") == q.number
    return rows, _by_path(nodes, lambda q: q.first)


def _by_path(nodes: list[_Node], value) -> Column:
    out = F.lit(None).cast("int")
    for q in nodes:
        out = F.when(q.path, value(q)).otherwise(out)
    return out


def kd_shards(df: DataFrame, scratch: Scratch, dims: Mapping[str, Column], shards: int | None = None, target_bytes: int | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns but the text) with size, shard and slot, which runs from 0 in each shard.

    ``dims`` are the metadata dimensions, columns of numbers without nulls such as ``number`` and ``order_of`` make.
    """
    spark = df.sparkSession
    keep = room([c for c in df.columns if c != text] if keep is None else keep, "size", "shard", "slot")
    sized = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), size_of(text).alias("_size"), *(c.cast("double").alias(f"_d{i}") for i, c in enumerate(dims.values())))
    counted = sized.groupBy(*sized.columns).agg(F.count("*").alias("_n"))
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {_COPIES}"))))
    copies = chunks.withColumn("_copy", F.explode(F.sequence(F.col("_chunk") * _COPIES, F.least(F.col("_n"), (F.col("_chunk") + 1) * _COPIES) - 1)))
    mark = F.xxhash64(*(f"_k{i}" for i in range(len(keep))), "_copy").cast("double") / 18446744073709551616.0 + 0.5
    rows = scratch.save(copies.select(*sized.columns, "_copy", mark.alias("_h")), "rows")
    if shards is None:
        total = rows.agg(F.sum("_size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    rows, shard = _tree(rows, len(dims), shards, scratch)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumns({"_shard": shard, "_bucket": F.least(F.floor(F.col("_h") * buckets), F.lit(buckets - 1)).cast("int")})
    counts = placed.groupBy("_shard", "_bucket").agg(F.count("*").alias("_m"))
    earlier = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_shard").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_shard", "_bucket").orderBy("_h", *(f"_k{i}" for i in range(len(keep))), "_copy")
    numbered = placed.withColumn("_here", F.row_number().over(own)).join(before, (F.col("_shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    slot = (F.col("_before") + F.col("_here") - 1).cast("long")
    return numbered.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_size").alias("size"), F.col("_shard").cast("int").alias("shard"), slot.alias("slot"))
