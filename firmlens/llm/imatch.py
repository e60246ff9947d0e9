"""I-Match document fingerprints over several randomised lexicon subsets.

Terms are lower-case words, as 62-bit hashes. A first pass counts for every term the documents that
have it. The lexicon is the band of terms whose inverse document frequency ln(documents / frequency)
lies in ``BAND``. A term of the band is in one of e^7.5 documents at least, so however large the corpus
is, the lexicon has at most the mean number of terms of a document times e^7.5 of them. It travels as a
bit for each of its codes, a term's hash modulo a power of two that is ``ROOM`` times its number of terms
at least; a term that only shares a code with one of the lexicon is taken with it, the same everywhere.

A document's distinct terms are sorted and hashed as a whole, then those of the lexicon, and then those
in each of SERIES * DEPTH randomised subsets of the lexicon: in every series the subset at depth d
has dropped at random all but one in 4^d of the lexicon's terms, each a part of the subset before it.
The subsets are the same for all documents. Those that keep much tell small changes of short texts,
those that keep little find long texts that share most of their terms. The likeness of two
fingerprints is the share of equal hashes among the subsets in which either text has terms.

Null and empty texts have no terms; their fingerprints are equal, with likeness 1 to each other
and 0 to others. A text without terms of the lexicon has likeness 1 to those of the same terms and 0 to
others. Equal texts have equal fingerprints. An input column with the name of a new one gives
way to it. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bpe import room

#: Codes for each term of the lexicon, and codes at least.
ROOM, LEAST_CODES = 16, 1 << 16
#: Least and greatest inverse document frequency of the lexicon (natural logarithm).
BAND = (2.3, 7.5)
#: Series of subsets, and subsets in each; a term's hash has two bits for each of them.
SERIES, DEPTH = 4, 7
#: Bits of a term's hash.
BITS = 62


def terms(text: Column) -> Column:
    """Distinct term hashes of a text; an empty array for null."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    hashes = F.transform(F.split(bare, "[\\x20\\x09-\\x0D]+"), lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - BITS))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.array_distinct(hashes))


def lexicon(df: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> Column:
    """The codes of the terms in the band over all rows of ``df``, as a constant array of words of 64 flags."""
    found = df.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    documents = df.count()
    low, high = math.exp(-band[1]) * documents, math.exp(-band[0]) * documents
    inside = found.filter(F.col("n").between(max(math.ceil(low), 1), math.floor(high))).select("term").persist(StorageLevel.DISK_ONLY)
    codes = max(LEAST_CODES, 1 << max(0, ROOM * inside.count() - 1).bit_length())
    code = (F.col("term") % codes).cast("int")
    flag = F.expr(f"shiftleft(1L, cast(term % {codes} as int) % 64)")
    words = {r.word: r.flags for r in inside.groupBy(F.shiftright(code, 6).alias("word")).agg(F.bit_or(flag).alias("flags")).collect()}  # a bit or so for each of the lexicon's bounded number of terms
    inside.unpersist()
    return F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(codes // 64))), ",").cast("array<bigint>")


def in_lexicon(found: Column, flags: Column) -> Column:
    """The terms with codes in the lexicon."""
    codes = F.size(flags) * 64
    return F.filter(found, lambda t: F.getbit(F.get(flags, F.shiftright(t % codes, 6).cast("int")), (t % 64).cast("int")) == 1)


def with_fingerprint(df: DataFrame, text: str, flags: Column, out: str) -> DataFrame:
    """``df`` with the fingerprint of a text column: the hashes of all its terms, of those in the lexicon, and of those in each subset; null where it has none."""
    df = df.select(*room(df.columns, out))
    df = df.withColumn("_fl_all", F.sort_array(terms(F.col(text))))
    df = df.withColumn("_fl_lexicon", in_lexicon(F.col("_fl_all"), flags))
    last, names = ["_fl_lexicon"] * SERIES, ["_fl_all", "_fl_lexicon"]
    for depth in range(DEPTH):
        new = {f"_fl_{series}_{depth}": _thinned(last[series], series * DEPTH + depth) for series in range(SERIES)}
        df = df.withColumns(new)
        last = list(new)
        names += last
    hashes = [F.when(F.size(c) > 0, F.xxhash64(c)) for c in names]
    return df.withColumn(out, F.array(*hashes)).drop(*names)


def _thinned(subset: str, draw: int) -> Column:
    """One in four of the terms, by two bits of their hashes."""
    return F.filter(F.col(subset), lambda t: t.bitwiseAND(F.lit(3 << 2 * draw)) == 0)


def as_text(fp: Column) -> Column:
    """A fingerprint as a string: its hashes in hexadecimal, nothing for those that it hasn't."""
    return F.array_join(F.transform(fp, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit(""))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either text has terms, from 0 to 1."""
    alike = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False)).cast("int")))
    counted = F.array_compact(alike)
    return F.when(F.size(counted) > 0, F.aggregate(counted, F.lit(0), lambda s, v: s + v) / F.size(counted)).otherwise(F.lit(1.0))


def with_next(df: DataFrame, columns: list[str], doc_id: str = "doc_id", blocks: int | None = None, tie: str | None = None) -> DataFrame:
    """``df`` with next_<column> of the row that follows by ascending id; the first row follows the last.

    Rows are dealt to blocks between quantiles of the id, which are ids themselves; the first row
    of a block is also sent to the block before it. So a row moves once and no task holds more
    than a few blocks, whatever the ids are. Null ids come last; ``tie`` orders equal ids.
    """
    df = df.select(*room(df.columns, *(f"next_{c}" for c in columns)))
    n = blocks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(n)]
    found = df.agg(F.min(doc_id), F.percentile_approx(doc_id, shares, 100 * n)).first()  # n numbers
    bounds = sorted({found[0], *(found[1] or [])} - {None})
    if bounds:
        edges = F.array(*map(F.lit, bounds))
        own = F.when(F.col(doc_id).isNull(), F.lit(len(bounds))).otherwise(F.size(F.filter(edges, lambda b: b <= F.col(doc_id))))
        guest = F.when(own == 1, F.lit(len(bounds))).otherwise(own - 1)
        starts = F.array_contains(edges, F.col(doc_id))
        place = lambda block, is_guest: F.struct(block.cast("int").alias("block"), F.lit(is_guest).alias("guest"))
        to = F.when(starts, F.array(place(own, False), place(guest, True))).otherwise(F.array(place(own, False)))
    else:
        to = F.array(F.struct(F.lit(0).alias("block"), F.lit(False).alias("guest")))
    dealt = df.withColumn("_fl_to", F.explode(to)).withColumns({"_fl_block": F.col("_fl_to.block"), "_fl_guest": F.col("_fl_to.guest")}).drop("_fl_to")
    order = Window.partitionBy("_fl_block").orderBy("_fl_guest", F.col(doc_id).asc_nulls_last(), *([tie] if tie else []))
    every = F.struct(*columns)
    following = F.coalesce(F.lead(every).over(order), F.first(every).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = dealt.withColumn("_fl_next", following).filter(~F.col("_fl_guest"))
    return out.withColumns({f"next_{c}": F.col(f"_fl_next.{c}") for c in columns}).drop("_fl_next", "_fl_block", "_fl_guest")


def edited(text: Column, following: Column) -> Column:
    """A text whose last quarter is replaced by as much of the beginning of another."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))
