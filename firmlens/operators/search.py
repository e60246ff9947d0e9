"""Search over serving tables: declarative filters, sort orders, facets, pages, finders, queues and profiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..core.scratch import Scratch


def current(df: DataFrame, registry: DataFrame, source: str = "source_key", snapshot: str = "snapshot_id") -> DataFrame:
    """Rows of the newest snapshot of each source that has rows, by id."""
    newest = df.groupBy(source).agg(F.max(snapshot).alias(snapshot))
    known = newest.join(registry.select(source).distinct(), source, "left_semi")
    return df.join(known, [source, snapshot], "left_semi")


def latest_snapshot(registry: DataFrame, source: str = "source_key", snapshot: str = "id") -> DataFrame:
    """The registry's newest row of each source, by id and never by its published text."""
    rest = [c for c in registry.columns if c != source]
    return registry.groupBy(source).agg(F.max_by(F.struct(*rest), snapshot).alias("_r")).select(source, "_r.*")


#: What a filter of the search does with its value.
Filter = Callable[[DataFrame, object], DataFrame]


def where(make: Callable[[object], Column]) -> Filter:
    """A filter by a condition on the table itself."""
    return lambda df, value: df.filter(make(value))


def exists(other: DataFrame, key: str, make: Callable[[object], Column] | None = None, negate: Callable[[object], bool] = lambda v: v is False) -> Filter:
    """A filter by rows of another table: some match, or none where the value says no."""

    def apply(df: DataFrame, value: object) -> DataFrame:
        side = other if make is None or isinstance(value, bool) else other.filter(make(value))
        return df.join(side.select(key).distinct(), key, "left_anti" if negate(value) else "left_semi")

    return apply


def equals(column: str) -> Filter:
    return where(lambda v: F.col(column) == v)


def at_least(column: str) -> Filter:
    return where(lambda v: F.col(column) >= v)


def at_most(column: str) -> Filter:
    return where(lambda v: F.col(column) <= v)


def one_of(column: str) -> Filter:
    return where(lambda v: F.col(column).isin(*v))


def contains(column: str) -> Filter:
    return where(lambda v: F.lower(column).contains(str(v).lower()))


def ratio_between(part: str, whole: str) -> Filter:
    return where(lambda v: (F.col(part) / F.nullif(F.col(whole), F.lit(0))).between(*v))


def tri_state(column: str) -> Filter:
    """yes, no, or unknown for a flag that may be null."""
    return where(lambda v: F.col(column).isNull() if v is None else F.col(column) == v)


def above_below(column: str) -> Filter:
    """(least, below): the least included, the upper bound not; an open bound is null."""

    def make(v: tuple[float, float | None]) -> Column:
        low, high = v
        return (F.col(column) >= low) & (F.lit(True) if high is None else F.col(column) < high)

    return where(make)


def any_contains(columns: Sequence[str], whole: Sequence[str] = ()) -> Filter:
    """Some column holds the words, or one of ``whole`` is equal to them; nulls hold nothing."""

    def make(v: object) -> Column:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(c).contains(str(v).lower().strip()), F.lit(False))
        for c in whole:
            hit = hit | F.coalesce(F.col(c).cast("string") == str(v), F.lit(False))
        return hit

    return where(make)


def choice(options: Mapping[str, Filter]) -> Filter:
    """A filter by a word: the option of that name; a word that isn't one leaves all rows."""
    return lambda df, v: options[v](df, True) if v in options else df


def owner(column: str, me: str) -> Filter:
    """none (nobody), me, or part of an owner's name."""

    def make(v: str) -> Column:
        if v == "none":
            return F.coalesce(F.col(column), F.lit("")) == ""
        return F.col(column) == me if v == "me" else F.lower(column).contains(v.lower())

    return where(make)


def open_signals(events: DataFrame, actions: DataFrame, key: str, cutoff: str) -> DataFrame:
    """Keys with an event since the cutoff that is neither suppressed nor acted upon."""
    live = events.filter(~F.coalesce("suppressed", F.lit(False)) & (F.col("date") >= cutoff))
    return live.join(actions.filter("state is not null").select("event_id").distinct(), "event_id", "left_anti").select(key).distinct()


def reach_filters(contacts: DataFrame, key: str) -> Filter:
    """email, verified, phone, linkedin, or none (no personal address), by contacts (kind, person, is_role, source, verify_status, label)."""
    named = F.coalesce(F.col("person"), F.lit("")) != ""
    email = contacts.filter((F.col("kind") == "email") & named & ~F.coalesce("is_role", F.lit(False)))
    sure = email.filter((F.col("source") != "pattern") & ~F.coalesce("verify_status", F.lit("")).isin("invalid", "no_mail_server"))
    return choice(
        {
            "email": exists(sure, key),
            "verified": exists(contacts.filter("kind = 'email' and verify_status = 'valid'"), key),
            "phone": exists(contacts.filter((F.col("kind") == "phone") & named & F.col("label").isin("direct", "mobile")), key),
            "linkedin": exists(contacts.filter((F.col("kind") == "linkedin") & named), key),
            "none": exists(email, key, negate=lambda v: True),
        }
    )


def firm_filters(key: str, scores: DataFrame, members: DataFrame, signals: DataFrame, contacts: DataFrame, classes: DataFrame, me: str = "") -> dict[str, Filter]:
    """The filters of the list of firms (is_exempt, regulator, names, city, state, raum, status, owner, hires_12m).

    ``members`` has list_id, ``scores`` product and status, ``classes`` category; ``signals`` are keys as
    ``open_signals`` gives them.
    """
    scored = scores.filter("status = 'scored'")
    register = {"ERA": where(lambda _: F.col("is_exempt")), "all": lambda df, _: df} | {r: where(lambda _, r=r: ~F.col("is_exempt") & (F.col("regulator") == r)) for r in ("SEC", "STATE")}
    listed = lambda df, v: exists(scored, key, negate=lambda _: v == "none")(df, True) if v in ("any", "none") else exists(scored, key, lambda p: F.col("product") == p)(df, v)
    return {
        "q": any_contains(["legal_name", "business_name", "city"], [key]),
        "register": lambda df, v: register.get(v, where(lambda _: ~F.col("is_exempt")))(df, v),
        "state": equals("state"),
        "size": above_below("raum"),
        "list": listed,
        "member_of": exists(members, key, lambda v: F.col("list_id") == v),
        "status": equals("status"),
        "owner": owner("owner", me),
        "signal": choice({"open": exists(signals, key)}),
        "hires": at_least("hires_12m"),
        "reach": reach_filters(contacts, key),
        "category": exists(classes, key, lambda v: F.col("category") == v),
    }


def list_filters(key: str, signals: DataFrame, contacts: DataFrame, classes: DataFrame, postings: DataFrame, me: str = "") -> dict[str, Filter]:
    """The filters of a product's list: scored rows (product, state_of_score, coverage) with the columns of firms."""
    coverage = choice({"full": where(lambda _: F.col("coverage") >= 90), "most": where(lambda _: F.col("coverage") >= 70), "gaps": where(lambda _: F.col("coverage") < 70)})
    working = where(lambda v: ~F.coalesce("status", F.lit("")).isin("disqualified", "customer") if v == "open" else F.col("status") == v)
    return {
        "product": equals("product"),
        "state_of_score": equals("state_of_score"),
        "q": any_contains(["legal_name", "business_name", "city"], [key]),
        "state": equals("state"),
        "owner": owner("owner", me),
        "status": working,
        "signal": lambda df, v: exists(signals, key)(df, True) if v else df,
        "reach": reach_filters(contacts, key),
        "coverage": coverage,
        "size": at_least("raum"),
        "category": exists(classes, key, lambda v: F.col("category") == v),
        "hiring": lambda df, v: exists(postings.filter("active"), key)(df, True) if v else df,
    }


def people_filters(key: str, scores: DataFrame, as_of: str, title: Callable[[Column, str], Column]) -> dict[str, Filter]:
    """The filters of the list of people (name, firm, state, priority, is_leader, is_officer, start_date, cfp, cfa,
    has_disclosure, raum, category, src, desig, title); ``title`` tells whether a title fits typed words."""
    scored = scores.filter("status = 'scored'")
    return {
        "q": any_contains(["name", "firm"], [key]),
        "state": equals("state"),
        "on": lambda df, v: df.filter("priority is not null") if v == "any" else exists(scored, key, lambda p: F.col("product") == p)(df, v),
        "role": choice({"leader": where(lambda _: F.col("is_leader")), "officer": where(lambda _: F.col("is_officer"))}),
        "joined": where(lambda days: F.col("start_date") >= F.date_sub(F.lit(as_of).cast("date"), int(days))),
        "credential": choice({"cfp": where(lambda _: F.col("cfp")), "cfa": where(lambda _: F.col("cfa"))}),
        "disclosure": lambda df, v: df.filter("has_disclosure") if v else df,
        "size": at_least("raum"),
        "category": equals("category"),
        "src": equals("src"),
        "designations": where(lambda v: F.arrays_overlap("desig", F.array(*map(F.lit, v)))),
        "title": where(lambda v: title(F.col("title"), v)),
    }


#: The signal by which a reporting platform is known. Fixed values.
PLATFORM_SIGNAL = {"Black Diamond": "platform_black_diamond", "Orion": "platform_orion", "Tamarac": "platform_tamarac", "Addepar": "platform_addepar", "Advyzon": "platform_advyzon"}


def settled(spec: Mapping[str, object]) -> dict[str, object]:
    """A specification without empty values, with what belongs together in one: a product with its least score and
    coverage (which mean nothing without it, as ``on_lists`` means nothing beside it), signal types with their days."""
    given = {k: v for k, v in spec.items() if v is not None and v != "" and v != []}
    if "product" in given:
        given["product"] = (given["product"], given.get("min_score"), given.get("min_coverage"))
        given.pop("on_lists", None)
    if "signal_types" in given or "signal_days" in given:
        given["signal"] = (given.get("signal_types", []), int(given.get("signal_days") or 90))
    return {k: v for k, v in given.items() if k not in ("min_score", "min_coverage", "signal_types", "signal_days")}


def universe_filters(key: str, tables: Mapping[str, DataFrame], as_of: Column, me: str = "") -> dict[str, Filter]:
    """The filters of the search of all firms, for a specification that is ``settled``.

    Firms have legal_name, business_name, city, state, raum, hnw_aum, iar_count, regulator, private_funds (flag),
    hires_12m, departures_12m, owner and status. ``tables`` are scores (product, status, score, coverage), scope (firms on a list),
    mail (platform), tags (tag, present), site (signal), custodians (custodian), contacts (kind, person, is_role,
    confidence, verify_status), triggers (trigger_type, date, suppressed) and filers (status), each with the key.
    """
    t = tables

    def on_product(df: DataFrame, value: object) -> DataFrame:
        name, score, coverage = value
        held = t["scores"].filter((F.col("status") == "scored") & (F.col("product") == name))
        for column, least in (("score", score), ("coverage", coverage)):
            held = held if least is None else held.filter(F.col(column) >= float(least))
        return having_key(df, held)

    def having_key(df: DataFrame, side: DataFrame, how: str = "left_semi") -> DataFrame:
        return df.join(side.select(key).distinct(), key, how)

    def uses(names: Sequence[str]) -> DataFrame:
        said = t["tags"].filter(F.col("tag").isin(*names) & F.coalesce("present", F.lit(False)))
        return said.select(key).union(t["site"].filter(F.col("signal").isin(*names)).select(key))

    def with_all_tags(df: DataFrame, tags: Sequence[str]) -> DataFrame:
        for tag in tags:
            df = having_key(df, t["tags"].filter((F.col("tag") == tag) & F.coalesce("present", F.lit(False))))
        return df

    def with_signal(df: DataFrame, value: object) -> DataFrame:
        types, days = value
        live = t["triggers"].filter(~F.coalesce("suppressed", F.lit(False)) & (F.col("date") >= F.date_sub(as_of, days)))
        return having_key(df, live.filter(F.col("trigger_type").isin(*types)) if types else live)

    def owned(v: str) -> Column:
        if v.lower() == "me" and me:
            return F.col("owner") == me
        return F.coalesce("owner", F.lit("")) == "" if v.lower() in ("unclaimed", "nobody", "none") else F.lower("owner").contains(v.lower())

    email = t["contacts"].filter("kind = 'email'")
    person = email.filter((F.coalesce("person", F.lit("")) != "") & ~F.coalesce("is_role", F.lit(False)) & (F.col("confidence") >= 60) & ~F.coalesce("verify_status", F.lit("")).isin("invalid", "no_mail_server"))
    filed = t["filers"].filter(F.col("status").isin("auto", "confirmed"))
    share = lambda v: v / 100 if v > 1 else v
    states = lambda v: [s.strip().upper()[:2] for s in v if s and s.strip()]
    return {
        "product": on_product,
        "on_lists": lambda df, v: having_key(df, t["scope"]) if v else df,
        "states": lambda df, v: df.filter(F.col("state").isin(*states(v))) if states(v) else df,
        "city": contains("city"),
        "name": any_contains(["legal_name", "business_name"]),
        "min_aum": at_least("raum"),
        "max_aum": at_most("raum"),
        "min_hnw_share": where(lambda v: (F.col("raum") > 0) & (F.coalesce("hnw_aum", F.lit(0)) / F.nullif(F.col("raum"), F.lit(0)) >= share(float(v)))),
        "min_advisors": at_least("iar_count"),
        "max_advisors": at_most("iar_count"),
        "mail_platform": exists(t["mail"], key, lambda v: F.col("platform") == v),
        "reporting_platform": lambda df, v: having_key(df, uses([PLATFORM_SIGNAL[v]])) if v in PLATFORM_SIGNAL else df,
        "custodian": exists(t["custodians"], key, lambda v: F.lower("custodian").contains(v.lower())),
        "platforms_any": lambda df, v: having_key(df, uses(v)),
        "brochure_tags": with_all_tags,
        "has_personal_email": lambda df, v: having_key(df, person) if v else df,
        "has_verified_email": lambda df, v: having_key(df, email.filter("verify_status = 'valid'")) if v else df,
        "min_hires_12m": at_least("hires_12m"),
        "min_departures_12m": at_least("departures_12m"),
        "signal": with_signal,
        "registration": lambda df, v: df.filter(F.col("regulator") == v) if v in ("SEC", "STATE") else df,
        "private_funds": tri_state("private_funds"),
        "files_13f": lambda df, v: having_key(df, filed, "left_semi" if v else "left_anti"),
        "owner": where(owned),
        "status": equals("status"),
    }


def search(df: DataFrame, filters: Mapping[str, Filter], spec: Mapping[str, object]) -> tuple[DataFrame, list[str]]:
    """The rows for which every filter of the spec holds, and a description of what was applied.

    Only the tables that the spec names are joined, by existence, so rows never multiply.
    """
    said = []
    for name, value in spec.items():
        if name not in filters:
            raise ValueError(f"there is no filter {name}")
        df = filters[name](df, value)
        said.append(f"{name}: {value}")
    return df, said


#: The orders of the lists: (column, descending); nulls come last and the key breaks ties. Fixed values.
SORTS: dict[str, list[tuple[str, bool]]] = {
    "score": [("score", True), ("raum", True)],
    "aum": [("raum", True)],
    "hires": [("hires_12m", True), ("raum", True)],
    "growth": [("net_12m", True), ("raum", True)],
    "advisors": [("iar_count", True)],
    "signal": [("last_signal", True)],
    "name": [("legal_name", False)],
}


def sort_spec(name: str) -> list[tuple[str, bool]]:
    """An order by its name; by score if there is none of that name."""
    return SORTS.get(name, SORTS["score"])


def _orders(sort: Sequence[tuple[str, bool]], key: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in sort] + [F.asc_nulls_last(key)]


def ordered(df: DataFrame, sort: Sequence[tuple[str, bool]], key: str) -> DataFrame:
    """Rows by (column, descending), nulls last, the key last."""
    return df.orderBy(*_orders(sort, key))


#: A page that ends up to this row is taken from the top rows of every task.
SHALLOW = 10_000


def page(df: DataFrame, sort: Sequence[tuple[str, bool]], key: str, number: int, per: int, shallow: int = SHALLOW) -> DataFrame:
    """A page of the sorted rows; the limit is the operator's meaning.

    Near the top every task gives its first rows. Further down the rows are dealt to ranges of the order
    (``Pages``), and only those that hold the page are read.
    """
    if number * per <= shallow:
        return ordered(df, sort, key).offset((number - 1) * per).limit(per)
    return Pages(df, sort, key).page(number, per)


class Pages:
    """All rows in the written ranges of an order, with the number of rows before each; any page reads a few ranges.

    The key tells all rows apart. What the driver holds is one number for each range, of which there are
    ``ranges``, by default as many as shuffle partitions.
    """

    def __init__(self, df: DataFrame, sort: Sequence[tuple[str, bool]], key: str, ranges: int | None = None):
        spark = df.sparkSession
        self.columns, self.orders = df.columns, _orders(sort, key)
        parts = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = df.repartitionByRange(parts, *self.orders).withColumn("_range", F.spark_partition_id())
        path = Scratch(spark, "pages").where("ranges")
        dealt.write.partitionBy("_range").parquet(path)
        self.rows = spark.read.schema(dealt.schema).parquet(path)
        counts = dict(map(tuple, self.rows.groupBy("_range").agg(F.count("*")).collect()))
        self.begins, self.total = {}, 0
        for k in sorted(counts):
            self.begins[k] = self.total
            self.total += counts[k]

    def between(self, first: int, upto: int) -> DataFrame:
        """Rows from place ``first`` (the first is 0) to before ``upto``, in order."""
        edges = [*self.begins.items()]
        ends = [b for _, b in edges[1:]] + [self.total]
        held = [(k, b) for (k, b), e in zip(edges, ends) if b < upto and e > first]
        if not held:
            return self.rows.limit(0).select(*self.columns)
        some = self.rows.filter(F.col("_range").isin([k for k, _ in held]))
        before = F.lit(0)
        for k, b in held:
            before = F.when(F.col("_range") == k, b).otherwise(before)
        place = before + F.row_number().over(Window.partitionBy("_range").orderBy(*self.orders)) - 1
        return some.withColumn("_place", place).filter(F.col("_place").between(first, upto - 1)).orderBy("_place").select(*self.columns)

    def page(self, number: int, per: int) -> DataFrame:
        return self.between((number - 1) * per, number * per)


def after(df: DataFrame, sort: Sequence[tuple[str, bool]], key: str, last: Mapping[str, object] | None, per: int) -> DataFrame:
    """The ``per`` rows that follow the row with the values ``last`` of the sort columns and the key; from the top without one.

    A filter and the top rows of every task: a page costs the same wherever it is.
    """
    if last is not None:
        further, same = F.lit(False), F.lit(True)
        for c, down in [*sort, (key, False)]:
            v = last[c]
            if v is not None:  # nulls are last: nothing comes after one but by the next columns
                beyond = (F.col(c) < v) if down else (F.col(c) > v)
                further = further | (same & (beyond | F.col(c).isNull()))
            same = same & F.col(c).eqNullSafe(F.lit(v))
        df = df.filter(further)
    return ordered(df, sort, key).limit(per)


class TextIndex:
    """Names by the three-letter pieces they hold, so that a search for a part of a name reads a few files.

    Every row gives one posting (piece, key, name) for each different piece of its name in lower case; postings lie in
    ``buckets`` folders by a hash of the piece, sorted by piece, with a table of counts. A search takes the rarest of its own pieces, reads
    that piece's rows and keeps the names that hold the whole text, so it gives what a scan gives. A text of under three
    letters has no piece: the names themselves are scanned.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.names = spark.read.parquet(f"{path}/names")
        kind = self.names.schema["key"].dataType.simpleString()
        self._schemas = {"postings": f"piece string, key {kind}, name string, bucket int", "counts": "piece string, n long, bucket int"}

    @staticmethod
    def _pieces(name: Column) -> Column:
        low = F.lower(name)
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))

    @classmethod
    def build(cls, df: DataFrame, key: str, name: str, path: str, buckets: int = 64) -> TextIndex:
        spark = df.sparkSession
        rows = df.filter(F.col(name).isNotNull()).select(F.col(key).alias("key"), F.col(name).alias("name"))
        rows.write.parquet(f"{path}/names")
        held = spark.read.schema(rows.schema).parquet(f"{path}/names")
        posts = held.filter(F.char_length("name") >= 3).select(F.explode(cls._pieces(F.col("name"))).alias("piece"), "key", "name")
        placed = posts.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)).cast("int"))
        # a piece that very many names hold is split over tasks; each file is in order of pieces, so its blocks are skipped by their limits
        placed.hint("rebalance", "bucket", "piece").sortWithinPartitions("bucket", "piece").write.partitionBy("bucket").parquet(f"{path}/postings")
        out = cls(spark, path, buckets)
        out._table("postings").groupBy("bucket", "piece").agg(F.count("*").alias("n")).write.partitionBy("bucket").parquet(f"{path}/counts")
        return out

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schemas[name]).parquet(f"{self.path}/{name}")

    def _at(self, table: str, pieces: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(p,) for p in pieces], "piece string")
        buckets = [r[0] for r in asked.select(F.pmod(F.xxhash64("piece"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        return self._table(table).filter(F.col("bucket").isin(buckets) & F.col("piece").isin(pieces))

    def rarest(self, text: str) -> str | None:
        """The piece of the text that fewest names hold; None if one of its pieces is in no name."""
        low = text.lower()
        pieces = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        counts = {r.piece: r.n for r in self._at("counts", pieces).collect()}  # one row for each piece of the text
        return min(pieces, key=lambda p: (counts[p], p)) if len(counts) == len(pieces) else None

    def search(self, text: str) -> DataFrame:
        """(key, name) of all names that hold the text, in any case."""
        holds = F.lower("name").contains(text.lower())
        if len(text.lower()) < 3:
            return self.names.filter(holds)
        piece = self.rarest(text)
        if piece is None:
            return self.names.limit(0)
        return self._at("postings", [piece]).filter(holds).select("key", "name")

    def filter_by(self, key: str) -> Filter:
        """A filter of a search by part of a name, by way of the index."""
        return lambda df, value: df.join(self.search(str(value)).select(F.col("key").alias("_held")), F.col(key) == F.col("_held"), "left_semi")


def facet_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row: rows in all and for which each condition holds, in one pass."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def array_facets(df: DataFrame, column: str, tags: Sequence[str] | None = None) -> DataFrame:
    """(tag, n) of an array column, of some tags or all; a row counts once for a tag."""
    rows = df.select(F.explode(F.array_distinct(column)).alias("tag"))
    return (rows if tags is None else rows.filter(F.col("tag").isin(*tags))).groupBy("tag").agg(F.count("*").alias("n"))


def watch_alerts(events: DataFrame, watched: DataFrame, actions: DataFrame, entity: str, n: int = 6) -> DataFrame:
    """The newest open events of watched entities; a report of ``n`` rows."""
    rows = events.join(watched.select(entity).distinct(), entity, "left_semi").join(actions.select("event_id").distinct(), "event_id", "left_anti")
    return rows.orderBy(F.desc("date"), F.asc("event_id")).limit(n)


def find_any(tables: Sequence[tuple[str, DataFrame, str, str]], query: str, n: int) -> DataFrame:
    """(kind, id, name) whose name holds the query, names that begin with it first; a report of ``n`` rows."""
    out = None
    for kind, df, key, name in tables:
        part = df.filter(F.lower(name).contains(query.lower())).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(name).alias("name"))
        out = part if out is None else out.union(part)
    return out.orderBy(~F.lower("name").startswith(query.lower()), "name", "kind", "id").limit(n)


def review_queue(decisions: DataFrame, scores: DataFrame, evidence: DataFrame, entity: str, least: float = 50) -> DataFrame:
    """Open decisions of entities that score at least ``least``, with the rows of evidence behind them, most first."""
    kept = decisions.filter("status = 'review'").join(scores.filter(F.col("score") >= least).select(entity).distinct(), entity, "left_semi")
    n = evidence.groupBy(entity).agg(F.count("*").alias("n_evidence"))
    return kept.join(n, entity, "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))).orderBy(F.desc("n_evidence"), F.asc(entity))


def entity_profile(base: DataFrame, parts: Mapping[str, tuple[DataFrame, Sequence[Column], Sequence[str], int]], entity: str) -> DataFrame:
    """Every entity with nested rows of its other tables: name -> (table, order, columns, most rows).

    Rows are ranked per entity before they are gathered, so no array is longer than its limit; the
    limit is the profile's meaning.
    """
    from ..core.frames import top_n_per_key

    for name, (df, order, columns, n) in parts.items():
        top = top_n_per_key(df, entity, order, n, "_place")
        rows = top.groupBy(F.col(entity).alias("_e")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.struct(*columns).alias("r")))), lambda x: x["r"]).alias(name))
        base = base.join(rows, F.col(entity) == F.col("_e"), "left").drop("_e")
    return base


def dashboard(universe: DataFrame, scores: DataFrame, moves: DataFrame, entity: str, as_of: Column, top: int = 6) -> DataFrame:
    """(section, key, n, value) of a start page: counts of the universe, each list's figures and first entities, moves of the last 30 and 365 days."""
    row = lambda section, key, n, value: [F.lit(section).alias("section"), key.cast("string").alias("key"), n.cast("long").alias("n"), value.cast("double").alias("value")]
    none = F.lit(None)
    a = universe.agg(F.count("*").alias("c")).select(*row("universe", F.lit("entities"), F.col("c"), none))
    b = scores.filter("status = 'scored'").groupBy("product").agg(F.count("*").alias("c"), F.avg("coverage").alias("v")).select(*row("list", F.col("product"), F.col("c"), F.round("v", 4)))
    c = scores.filter((F.col("status") == "scored") & (F.col("rank") <= top)).select(*row("top", F.concat_ws(":", "product", F.col("rank").cast("string")), F.col(entity), F.col("score")))
    age = F.datediff(as_of, F.col("date"))
    d = moves.groupBy("kind").agg(F.count_if(age.between(0, 30)).alias("c"), F.count_if(age.between(0, 365)).alias("v")).select(*row("moves", F.col("kind"), F.col("c"), F.col("v")))
    return a.unionByName(b).unionByName(c).unionByName(d)


def home(firms: DataFrame, scope: DataFrame, scores: DataFrame, fresh: DataFrame, contacts: DataFrame, moves: DataFrame, events: DataFrame, team: DataFrame, as_of: Column, entity: str = "entity_id", large: int = 500, top: int = 6, newest: int = 14) -> DataFrame:
    """(section, key, n, value) of the whole start page; its tops are reports of a few rows.

    universe: firms that register, those of the SEC, exempt ones, assets and firms on a list. list: for each product its
    scored firms and mean coverage; strong: scores from 60; fresh: firms with a signal nobody has acted on. top: the first firms of each
    product with whether a person's address there is verified. reach: named people with an address, verified addresses, guesses, direct
    lines and phones. moves and signals: the newest of listed firms, moves only of firms with up to ``large`` people. hiring:
    the listed firms of that size with most hires. state: listed firms. pipeline: firms by status.
    """
    cell = lambda section, key, n, value=None: [F.lit(section).alias("section"), key.cast("string").alias("key"), n.cast("long").alias("n"), (F.lit(None) if value is None else value).cast("double").alias("value")]
    pair = lambda *p: F.inline(F.array(*(F.struct(F.lit(k).alias("k"), n.cast("long").alias("n")) for k, n in p)))
    listed = firms.join(scope, entity)
    scored = scores.filter("status = 'scored'")
    email, phone, named = F.col("kind") == "email", F.col("kind") == "phone", F.coalesce(F.col("person"), F.lit("")) != ""
    sure = contacts.filter(email & named & ~F.coalesce("is_role", F.lit(False)) & (F.col("verify_status") == "valid")).select(F.col(entity).alias("_v")).distinct()
    parts = [
        firms.agg(F.count_if(~F.col("is_exempt")).alias("a"), F.count_if(~F.col("is_exempt") & (F.col("regulator") == "SEC")).alias("b"), F.count_if(F.col("is_exempt")).alias("c"), F.sum(F.when(~F.col("is_exempt"), F.col("raum"))).alias("v")).select(pair(("firms", F.col("a")), ("firms_sec", F.col("b")), ("exempt", F.col("c"))), "v").select(*cell("universe", F.col("k"), F.col("n"), F.when(F.col("k") == "firms", F.col("v")))),
        scope.agg(F.count("*").alias("n")).select(*cell("universe", F.lit("listed"), F.col("n"))),
        scored.groupBy("product").agg(F.count("*").alias("n"), F.avg("coverage").alias("v")).select(*cell("list", F.col("product"), F.col("n"), F.round("v", 4))),
        scored.groupBy("product").agg(F.count_if(F.col("score") >= 60).alias("n")).select(*cell("strong", F.col("product"), F.col("n"))),
        scored.join(fresh.select(entity).distinct(), entity, "left_semi").groupBy("product").agg(F.count("*").alias("n")).select(*cell("fresh", F.col("product"), F.col("n"))),
        scored.filter(F.col("rank") <= top).join(sure, F.col(entity) == F.col("_v"), "left").select(*cell("top", F.concat_ws(":", "product", F.col("rank").cast("string")), F.col(entity), F.col("_v").isNotNull().cast("int"))),
        contacts.agg(
            F.count_distinct(F.when(email & named & ~F.coalesce("is_role", F.lit(False)), F.struct(entity, "person"))).alias("a"), F.count_if(email & (F.col("verify_status") == "valid")).alias("b"),
            F.count_if(email & (F.col("source") == "pattern") & F.col("verify_status").isin("unverified", "queued")).alias("c"), F.count_if(phone & named).alias("d"), F.count_if(phone).alias("e"),
        ).select(pair(("named_email", F.col("a")), ("verified", F.col("b")), ("candidates", F.col("c")), ("direct", F.col("d")), ("phones", F.col("e")))).select(*cell("reach", F.col("k"), F.col("n"))),
        moves.join(scope, entity).join(team.select(entity, "headcount"), entity, "left").filter(F.datediff(as_of, F.col("date")).between(0, 60) & (F.coalesce("headcount", F.lit(0)) <= large)).orderBy(F.desc("date"), F.desc("priority"), F.asc("move_id")).limit(newest).select(*cell("moves", F.col("move_id"), F.col(entity))),
        events.filter(~F.coalesce("suppressed", F.lit(False)) & F.datediff(as_of, F.col("date")).between(0, 60)).join(scope, entity).orderBy(F.desc("date"), F.desc("priority"), F.asc("event_id")).limit(newest).select(*cell("signals", F.col("event_id"), F.col(entity))),
        team.join(scope, entity).filter((F.col("hires_12m") >= 2) & (F.col("headcount") <= large)).orderBy(F.desc("hires_12m"), F.desc("priority"), F.asc(entity)).limit(top).select(*cell("hiring", F.col(entity), F.col("hires_12m"))),
        listed.filter("state is not null").groupBy("state").agg(F.count("*").alias("n")).select(*cell("state", F.col("state"), F.col("n"))),
        firms.filter("status is not null").groupBy("status").agg(F.count("*").alias("n")).select(*cell("pipeline", F.col("status"), F.col("n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
