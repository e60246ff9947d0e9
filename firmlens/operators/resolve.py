"""Entity resolution: names, aliases, cascades, people within organisations, conventions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.frames import first_per_key, mode_by
from ..core.scratch import Scratch
from ..functions.names import CREDENTIALS, fold_accents, parse_name
from .joins import prefix_table

#: Confidence by kind of key and agreement of states, the penalty of ambiguity, and the bands. Fixed values.
MATCH = {"exact": (0.95, 0.45, 0.78), "generic": (0.72, 0.25, 0.55), "ambiguous": 0.20, "auto": 0.85, "review": 0.50}


def match_entities(left: DataFrame, right: DataFrame, left_id: str, right_id: str, exact: str = "exact_key", generic: str = "generic_key", state: str = "state", cfg: Mapping = MATCH) -> DataFrame:
    """(left_id, right_id, method, confidence, status): exact key first, else generic key, by state and ambiguity.

    Two equi joins; a left row that has an exact partner takes no generic one. Either side having
    several partners costs the ambiguity penalty. Blank keys match nothing.
    """
    r = right.select(F.col(right_id), F.col(exact).alias("_re"), F.col(generic).alias("_rg"), F.col(state).alias("_rs"))
    rows = left.select(left_id, exact, generic, F.col(state).alias("_ls"))
    by_exact = rows.filter(F.col(exact) != "").join(r, F.col(exact) == F.col("_re")).select(left_id, right_id, "_ls", "_rs", F.lit("exact").alias("method"))
    rest = rows.join(by_exact.select(left_id).distinct(), left_id, "left_anti").filter(F.col(generic) != "")
    by_generic = rest.join(r, F.col(generic) == F.col("_rg")).select(left_id, right_id, "_ls", "_rs", F.lit("generic").alias("method"))
    met = by_exact.union(by_generic)
    n_left, n_right = F.count("*").over(Window.partitionBy(left_id)), F.count("*").over(Window.partitionBy(right_id))

    def level(kind: str) -> Column:
        agree, conflict, unknown = cfg[kind]
        return F.when(F.col("_ls").isNull() | F.col("_rs").isNull(), unknown).when(F.col("_ls") == F.col("_rs"), agree).otherwise(conflict)

    base = F.when(F.col("method") == "exact", level("exact")).otherwise(level("generic"))
    scored = met.withColumn("_n", F.greatest(n_left, n_right)).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - F.when(F.col("_n") > 1, cfg["ambiguous"]).otherwise(0.0))), 3))
    status = F.when(F.col("confidence") >= cfg["auto"], "auto").when(F.col("confidence") >= cfg["review"], "review").otherwise("rejected")
    return scored.select(left_id, right_id, "method", "confidence", status.alias("status"))


def match_classes(left: DataFrame, right: DataFrame, left_id: str, right_id: str, exact: str = "exact_key", generic: str = "generic_key", state: str = "state", cfg: Mapping = MATCH) -> DataFrame:
    """The matches of ``match_entities`` without the product of keys that many rows of both sides share.

    (method, key, left_state, relation, n_left, n_right, left_id, right_id, confidence, status). A key that one row of
    either side has gives pairs, with their ids. All other keys give classes without ids: the left rows of a key
    and state and, by relation, the right rows that agree with it, conflict, or of which one state is unknown. Their
    members are the rows with that key and state; all pairs of a class have one confidence, as each member has
    several partners. Left rows that have an exact partner take no part by the generic key.

    States are counted for each key on both sides before they meet, so there are at most three rows for each
    (key, left state) and the result is in proportion to the rows, however many of them share a key.
    """
    rows = left.select(F.col(left_id).alias("left_id"), F.col(exact).alias("e"), F.col(generic).alias("g"), F.col(state).alias("s"))
    others = right.select(F.col(right_id).alias("right_id"), F.col(exact).alias("re"), F.col(generic).alias("rg"), F.col(state).alias("rs"))
    exact_keys = others.filter("re <> ''").select(F.col("re").alias("e")).distinct()
    sides = {"exact": (rows.filter("e <> ''"), "e", "re"), "generic": (rows.join(exact_keys.filter("e <> ''"), "e", "left_anti").filter("g <> ''"), "g", "rg")}

    def level(kind: str, relation: Column) -> Column:
        agree, conflict, unknown = cfg[kind]
        return F.when(relation == "unknown", unknown).when(relation == "agree", agree).otherwise(conflict)

    def rated(kind: str, several: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), level(kind, F.col("relation")) - F.when(several, cfg["ambiguous"]).otherwise(0.0))), 3)

    # in how many pairs a right row is: by its exact key, and by its generic key with the left rows that are left
    partners = others
    for kind, (side, key, own) in sides.items():
        n = side.groupBy(F.col(key).alias(f"_{kind}")).agg(F.count("*").alias(f"n_{kind}"))
        partners = partners.join(n, F.col(own) == F.col(f"_{kind}"), "left")
    partners = partners.select("right_id", "re", "rg", "rs", (F.coalesce("n_exact", F.lit(0)) + F.coalesce("n_generic", F.lit(0))).alias("n_partners"))

    out = None
    for kind, (side, key, own) in sides.items():
        classes = side.groupBy(F.col(key).alias("key"), F.col("s").alias("left_state")).agg(F.count("*").alias("n_left"))
        met = others.filter(F.col(own) != "").groupBy(F.col(own).alias("rkey"), F.col("rs").alias("right_state")).agg(F.count("*").alias("n"))
        whole = met.groupBy("rkey").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("right_state").isNull(), F.col("n")).otherwise(0)).alias("none"))
        sums = classes.groupBy(F.col("key").alias("lkey")).agg(F.sum("n_left").alias("all_left")).join(whole, F.col("lkey") == F.col("rkey")).select("lkey", "all_left", "all", "none")
        many = sums.filter((F.col("all_left") > 1) & (F.col("all") > 1))
        same = met.filter("right_state is not null").select(F.col("rkey").alias("sk"), F.col("right_state").alias("ss"), F.col("n").alias("same"))
        counted = classes.join(many, F.col("key") == F.col("lkey")).join(same, (F.col("key") == F.col("sk")) & (F.col("left_state") == F.col("ss")), "left").withColumn("same", F.coalesce("same", F.lit(0)))
        unknown = F.when(F.col("left_state").isNull(), F.col("all")).otherwise(F.col("none"))
        found = F.array(*(F.struct(F.lit(r).alias("relation"), n.cast("long").alias("n_right")) for r, n in (("agree", F.col("same")), ("conflict", F.col("all") - F.col("same") - unknown), ("unknown", unknown))))
        wide = counted.select("key", "left_state", "n_left", F.inline(found)).filter("n_right > 0")
        wide = wide.select(F.lit(kind).alias("method"), "key", "left_state", "relation", "n_left", "n_right", F.lit(None).cast(rows.schema["left_id"].dataType).alias("left_id"), F.lit(None).cast(others.schema["right_id"].dataType).alias("right_id"), rated(kind, F.lit(True)).alias("confidence"))
        # one side of these keys has one row, so they join without a product
        few = sums.filter((F.col("all_left") == 1) | (F.col("all") == 1)).withColumnRenamed("all", "n_own")
        ones = side.join(few, F.col(key) == F.col("lkey")).join(partners, F.col(key) == F.col(own))
        relation = F.when(F.col("s").isNull() | F.col("rs").isNull(), "unknown").when(F.col("s") == F.col("rs"), "agree").otherwise("conflict")
        single = ones.withColumn("relation", relation).select(F.lit(kind).alias("method"), F.col(key).alias("key"), F.col("s").alias("left_state"), "relation", F.lit(1).cast("long").alias("n_left"), F.lit(1).cast("long").alias("n_right"), "left_id", "right_id", rated(kind, F.greatest("n_own", "n_partners") > 1).alias("confidence"))
        out = wide.union(single) if out is None else out.union(wide).union(single)
    status = F.when(F.col("confidence") >= cfg["auto"], "auto").when(F.col("confidence") >= cfg["review"], "review").otherwise("rejected")
    return out.withColumn("status", status)


def overlay(matches: DataFrame, key: str) -> DataFrame:
    """Keys with an automatic match."""
    return matches.filter("status = 'auto'").select(key).distinct()


def alias_match(df: DataFrame, name: str, rules: Sequence[tuple[str, str]], out: str = "alias_id") -> DataFrame:
    """Each row with the id of the longest (id, prefix) that its name begins with at a word's end; on different names only."""
    from .joins import phrase_join

    return phrase_join(df, name, rules, out)


def effective_entity(df: DataFrame, entity: str, date: str, merges: Sequence[tuple[str, str, str]], out: str = "effective") -> DataFrame:
    """A becomes B from a day on: ``merges`` are (A, B, day); a missing date counts as after."""
    chain = F.col(entity)
    for a, b, day in merges:
        chain = F.when((F.col(entity) == a) & (F.col(date).isNull() | (F.col(date) >= F.lit(day).cast("date"))), F.lit(b)).otherwise(chain)
    return df.withColumn(out, chain)


def concentration(df: DataFrame, entity: str, date: str, category: str, amount: str, platform: str, merges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(entity, total, platform_amount, share, primary, n) at each entity's latest date.

    The primary is the largest category before merging, named after it; it is null if all amounts are zero.
    """
    latest = df.groupBy(entity).agg(F.max(date).alias("_latest"))
    rows = df.join(latest, [entity]).filter(F.col(date) == F.col("_latest"))
    raw = rows.groupBy(entity, category).agg(F.sum(amount).alias("amount"), F.max(date).alias(date), F.count("*").alias("n"))
    named = effective_entity(raw, category, date, merges)
    out = named.groupBy(entity).agg(
        F.sum("amount").alias("total"),
        F.sum(F.when(F.col("effective") == platform, F.col("amount")).otherwise(0)).alias("platform_amount"),
        F.min(F.struct((-F.col("amount")).alias("less"), F.col(category).alias("c"), "effective")).alias("_p"),
        F.sum("n").alias("n"),
    )
    share = F.col("platform_amount") / F.nullif(F.col("total"), F.lit(0))
    return out.select(entity, "total", "platform_amount", F.round(share.cast("double"), 6).alias("share"), F.when(F.col("total") != 0, F.col("_p.effective")).alias("primary"), "n")


def unique_only(df: DataFrame, key: str | Sequence[str], value: str) -> DataFrame:
    """(key, value) of keys that belong to one value only."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.countDistinct(value).alias("_n")).filter("_n = 1").drop("_n")


def cascade_match(records: DataFrame, record: str, steps: Sequence[tuple[str, Sequence[str], DataFrame, float]], target: str) -> DataFrame:
    """Each record with target, method and confidence of the first step that finds one.

    A step is (method, key columns, lookup with one row per key, confidence).
    """
    out, found = records, []
    for i, (method, keys, lookup, confidence) in enumerate(steps):
        side = lookup.select(*(F.col(k).alias(f"_k{i}_{k}") for k in keys), F.col(target).alias(f"_t{i}"))
        cond = [F.col(k) == F.col(f"_k{i}_{k}") for k in keys]
        out = out.join(side, cond, "left").drop(*(f"_k{i}_{k}" for k in keys))
        found.append(F.when(F.col(f"_t{i}").isNotNull(), F.struct(F.col(f"_t{i}").alias(target), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))))
    best = F.coalesce(*found)
    return out.withColumn("_best", best).drop(*(f"_t{i}" for i in range(len(steps)))).select(*records.columns, "_best.*")


def ambiguous_keys(df: DataFrame, scope: str, key: str, person: str) -> DataFrame:
    """(scope, key, people) of keys that several people of one scope share, which serve neither."""
    return df.groupBy(scope, key).agg(F.countDistinct(person).alias("people")).filter("people > 1")


def local_part_patterns(first: Column, last: Column) -> dict[str, Column]:
    """Twelve ways to make the local part of an address from a name. Fixed values."""
    f, l, fi, li = F.lower(first), F.lower(last), F.lower(F.substring(first, 1, 1)), F.lower(F.substring(last, 1, 1))
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return {
        "first.last": join(f, ".", l), "flast": join(fi, l), "first": f, "firstlast": join(f, l), "first_last": join(f, "_", l), "last": l,
        "f.last": join(fi, ".", l), "firstl": join(f, li), "last.first": join(l, ".", f), "lastf": join(l, fi), "first-last": join(f, "-", l), "fl": join(fi, li),
    }


def learn_pattern(pairs: DataFrame, org: str, first: str, last: str, address: str) -> DataFrame:
    """(org, pattern, n): the way in which most of an organisation's addresses are made."""
    local = F.lower(F.split_part(F.col(address), F.lit("@"), F.lit(1)))
    candidates = F.array(*(F.when(c == local, F.lit(name)) for name, c in local_part_patterns(F.col(first), F.col(last)).items()))
    labelled = pairs.select(org, F.get(F.filter(candidates, lambda x: x.isNotNull()), F.lit(0)).alias("pattern"))
    return mode_by(labelled, org, "pattern")


def org_domain(addresses: DataFrame, websites: DataFrame, org: str, domain: str, trust: str, deny: Sequence[str]) -> DataFrame:
    """(org, domain): the most trusted published address's domain, else the website's host; free mail and social hosts denied."""
    a = addresses.select(org, F.lower(domain).alias("domain"), F.col(trust).alias("rank"))
    w = websites.select(org, F.lower(domain).alias("domain"), F.lit(-1).alias("rank"))
    rows = a.unionByName(w).filter(F.col("domain").isNotNull() & ~F.col("domain").isin(*deny))
    return first_per_key(rows.groupBy(org, "domain", "rank").agg(F.count("*").alias("n")), org, [F.desc("rank"), F.desc("n"), F.asc("domain")]).select(org, "domain")


def place_set(frames: Sequence[DataFrame], entity: str, state: str) -> DataFrame:
    """(entity, states): the different valid states over several sources."""
    out = frames[0].select(entity, state)
    for f in frames[1:]:
        out = out.union(f.select(entity, state))
    return out.filter(F.upper(state).rlike("^[A-Z]{2}$")).distinct().groupBy(entity).agg(F.array_sort(F.collect_set(F.upper(state))).alias("states"))


#: Words before a surname that are no surname of their own. Fixed values.
PARTICLES = ("DE", "LA", "LE", "DEL", "DELLA", "DA", "DI", "DU", "DOS", "VAN", "VON", "DER", "DEN", "TER", "ST", "SAN", "BIN", "AL", "EL")


def _parts(name: Column) -> Column:
    """The words of a name in upper case, letters only; none of a null."""
    words = F.split(F.regexp_replace(F.upper(fold_accents(F.coalesce(name, F.lit("")))), "[^A-Z]+", " "), " ")
    return F.filter(words, lambda w: w != "")


def _first_points(a: Column, b: Column, nicknames: Sequence[tuple[str, str]]) -> Column:
    """4 for equal first names, 3 for a nickname, 1 for an initial of the other, 2 for its beginning, else 0."""
    nick = F.lit(False)
    for x, y in nicknames:
        x, y = x.upper(), y.upper()
        nick = nick | ((a == x) & (b == y)) | ((a == y) & (b == x))
    initial = (F.length(a) == 1) | (F.length(b) == 1)
    stem = (F.least(F.length(a), F.length(b)) >= 3) & (a.startswith(b) | b.startswith(a))
    points = F.when(a == b, 4).when(nick, 3).when(initial, F.when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 1).otherwise(0)).when(stem, 2).otherwise(0)
    return F.coalesce(F.when((a != "") & (b != ""), points), F.lit(0))


def match_people(names: DataFrame, roster: DataFrame, org: str, nicknames: Sequence[tuple[str, str]] = (), least: float = 3.0) -> DataFrame:
    """Names (name_id, org, first, middle, last) to people of the roster (person, org, first, middle, last, current): a unique best or nothing.

    Candidates share the organisation and a word of the surname (or all of it without spaces, the last
    middle name before it included), so a roster is never crossed. The surname gives 2 points if equal,
    1 for a shared word of three letters; the first name 4 if equal, 3 as a nickname, 2 by its beginning,
    1 as an initial. Who goes by a middle name gets 2 and no test of middle names. Equal middle names add
    1, equal initials of them 0.5, different ones rule out. A current person adds 0.5. With a column
    other_names (array) a person is also met under those, for 0.25 less.
    """
    some = F.array(F.struct(F.col("first").alias("first"), F.col("middle").alias("middle"), F.col("last").alias("last"), F.lit(False).alias("alias")))
    if "other_names" in roster.columns:
        others = F.transform(F.coalesce("other_names", F.array().cast("array<string>")), lambda x: F.struct(parse_name(x)["first"].alias("first"), parse_name(x)["middle"].alias("middle"), parse_name(x)["last"].alias("last"), F.lit(True).alias("alias")))
        some = F.concat(some, others)
    head = lambda c: F.coalesce(F.get(_parts(c), F.lit(0)), F.lit(""))
    known = roster.select(F.col(org).alias("_org"), "person", F.coalesce("current", F.lit(False)).alias("current"), F.inline(some)).select("_org", "person", "current", "alias", head(F.col("first")).alias("_f"), _parts(F.col("middle")).alias("_m"), _parts(F.col("last")).alias("_l"))
    asked = names.select("name_id", org, head(F.col("first")).alias("f"), _parts(F.col("middle")).alias("m"), _parts(F.col("last")).alias("l")).withColumn("alt", F.when(F.size("m") > 0, F.concat(F.element_at("m", -1), F.array_join("l", ""))))
    words = lambda c: F.filter(c, lambda w: (F.length(w) >= 3) & ~w.isin(*PARTICLES))
    whole = lambda c: F.array(F.array_join(c, ""))
    n = asked.withColumn("k", F.explode(F.array_distinct(F.filter(F.concat(words("l"), whole("l"), F.array("alt")), lambda w: w != ""))))
    r = known.withColumn("_k", F.explode(F.array_distinct(F.filter(F.concat(words("_l"), whole("_l")), lambda w: w != ""))))
    met = n.join(r, (F.col(org) == F.col("_org")) & (F.col("k") == F.col("_k"))).drop("k", "_k").distinct()
    joined = F.array_join("_l", "")
    via = F.coalesce((joined != F.array_join("l", "")) & (joined == F.col("alt")), F.lit(False))
    last = F.when((joined == F.array_join("l", "")) | via, 2).when(F.arrays_overlap(words("l"), words("_l")), 1).otherwise(0)
    own = F.when(via, F.slice("m", 1, F.greatest(F.size("m") - 1, F.lit(0)))).otherwise(F.col("m"))
    placed = met.withColumns({"last": last, "own": own}).withColumn("plain", _first_points(F.col("f"), F.col("_f"), nicknames))
    called = (_first_points(F.col("f"), F.coalesce(F.get("_m", F.lit(0)), F.lit("")), nicknames) >= 3) | (_first_points(F.coalesce(F.get("own", F.lit(0)), F.lit("")), F.col("_f"), nicknames) >= 3)
    first = F.when(F.col("plain") > 0, F.col("plain")).when(called, 2).otherwise(0)
    initials = lambda c: F.transform(c, lambda w: F.substring(w, 1, 1))
    middle = F.when((F.col("plain") == 0) | (F.size("own") == 0) | (F.size("_m") == 0), 0.0).when(F.arrays_overlap("own", "_m"), 1.0).when(F.arrays_overlap(initials("own"), initials("_m")), 0.5)
    rated = placed.withColumns({"first": first, "middle": middle}).filter((F.col("last") > 0) & (F.col("first") > 0) & (F.col("first") + F.col("last") >= 3) & F.col("middle").isNotNull())
    points = F.col("first") + F.col("last") + F.col("middle") + F.when(F.col("current"), 0.5).otherwise(0.0) - F.when(F.col("alias"), 0.25).otherwise(0.0)
    of = rated.groupBy("name_id", "person").agg(F.max(points).alias("score")).filter(F.col("score") >= least)
    best = of.groupBy("name_id").agg(F.max("score").alias("score"), F.max_by("person", F.struct("score", "person")).alias("person"), F.collect_list("score").alias("_all"))
    return best.filter(F.size(F.filter("_all", lambda s: s == F.col("score"))) == 1).select("name_id", "person", "score")


def observe_ids(holdings: DataFrame, patterns: Sequence[tuple[str, str]], prior: DataFrame, id_col: str, name: str, document: str) -> DataFrame:
    """(target, id, documents, verified): the id seen in most documents under a target's name pattern; a verified prior id stays."""
    hits = F.filter(F.array(*(F.when(F.col(name).rlike(p), F.lit(t)) for t, p in patterns)), lambda x: x.isNotNull())
    seen = holdings.select(id_col, document, F.explode(hits).alias("target")).groupBy("target", id_col).agg(F.countDistinct(document).alias("documents"))
    top = first_per_key(seen, "target", [F.desc("documents"), F.asc(id_col)])
    joined = top.join(prior.select("target", F.col(id_col).alias("_prior"), "verified"), "target", "full")
    keep = F.coalesce(F.col("verified"), F.lit(False))
    return joined.select("target", F.when(keep, F.col("_prior")).otherwise(F.coalesce(F.col(id_col), F.col("_prior"))).alias(id_col), F.coalesce("documents", F.lit(0)).alias("documents"), keep.alias("verified"))


def attach_phone(people: DataFrame, offices: DataFrame, main: DataFrame, org: str, place: str) -> DataFrame:
    """People (person, org, place) with phone and confidence: the main line at the main place (60), else the
    office of their place with most staff (70 if it has one number, 60 if several), else the main line (55)."""
    main_ = main.select(F.col(org).alias("_o"), F.col(place).alias("_main"), F.col("phone").alias("_line"))
    by = offices.groupBy(F.col(org).alias("_oo"), F.col(place).alias("_op")).agg(F.max_by("phone", F.struct("staff", "phone")).alias("_office"), F.countDistinct("phone").alias("_n"))
    joined = people.join(main_, F.col(org) == F.col("_o"), "left").join(by, (F.col(org) == F.col("_oo")) & (F.col(place) == F.col("_op")), "left")
    choice = F.coalesce(
        F.when((F.col(place) == F.col("_main")) & F.col("_line").isNotNull(), F.struct(F.col("_line").alias("phone"), F.lit(60).alias("confidence"))),
        F.when(F.col("_office").isNotNull(), F.struct(F.col("_office").alias("phone"), F.when(F.col("_n") == 1, 70).otherwise(60).alias("confidence"))),
        F.when(F.col("_line").isNotNull(), F.struct(F.col("_line").alias("phone"), F.lit(55).alias("confidence"))),
    )
    return joined.select(*people.columns, choice["phone"].alias("phone"), choice["confidence"].alias("confidence"))


#: Levels of a fit between a profile's slug and a person's name.
STRONG, WEAK = 2, 1


#: Letters of middle names that may stand between a given name and a surname that are run together.
_BETWEEN = 12


def _slug_keys(slug: Column) -> Column:
    """The names that a slug may spell: [(level, key)], key 'first|last'.

    Of several words any may be the first name and any other, or two neighbours together, the last. A single word is
    cut: its beginning and its end are the names in either order, with some letters of middle names between them; or, weakly, an initial and
    the rest. Ids that sites append, and credentials, are no words.
    """
    raw = F.filter(F.split(F.lower(fold_accents(F.coalesce(slug, F.lit("")))), "[^a-z0-9]+"), lambda w: ~w.rlike("^[0-9a-f]*[0-9][0-9a-f]*$"))
    words = F.filter(F.transform(raw, lambda w: F.regexp_replace(w, "[0-9]+", "")), lambda w: (w != "") & ~w.isin(*(c.lower() for c in CREDENTIALS)))
    both = lambda first, last: F.array(*(F.struct(F.lit(level).alias("level"), F.concat(first, F.lit("|"), last).alias("key")) for level in (STRONG, WEAK)))
    n_words = F.size(words)
    spots = lambda c: F.when(c > 0, F.sequence(F.lit(1), c)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get(words, i - 1)
    pairs = F.flatten(F.flatten(F.transform(spots(n_words), lambda i: F.transform(F.filter(spots(n_words), lambda j: j != i), lambda j: both(word(i), word(j))))))
    joined = F.flatten(F.flatten(F.transform(spots(n_words), lambda i: F.transform(F.filter(spots(n_words - 1), lambda j: (j != i) & (j + 1 != i)), lambda j: both(word(i), F.concat(word(j), word(j + 1)))))))
    one = F.get(words, F.lit(0))
    n = F.char_length(one)
    rest = lambda k: F.substring(one, k + 1, n)
    beginning = lambda k: F.substring(one, F.lit(1), k)
    cuts = F.flatten(F.flatten(F.transform(spots(n - 1), lambda i: F.transform(F.filter(spots(n - 1), lambda j: (j >= i) & (j <= i + _BETWEEN)), lambda j: both(beginning(i), rest(j))))))
    turned = F.flatten(F.transform(spots(n - 1), lambda i: both(rest(i), beginning(i))))
    # a weak fit of a single word leaves no letter over
    level = lambda x: F.struct(x["level"].alias("level"), x["key"].alias("key"))
    tight = F.filter(cuts, lambda x: (x["level"] == STRONG) | (F.char_length(x["key"]) == n + 1))
    return F.array_distinct(F.transform(F.when(n_words > 1, F.concat(pairs, joined)).otherwise(F.concat(tight, turned)), level))


def _person_keys(first: Column, middle: Column, last: Column, nicknames: Sequence[tuple[str, str]]) -> Column:
    """The keys of a person: given names of two letters and more with the surname or a part of it, strong; the initial or a middle name with it, weak."""
    plain = lambda c: F.regexp_replace(F.lower(fold_accents(F.coalesce(c, F.lit("")))), "[^a-z]+", "")
    parts = lambda c, by: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), plain), lambda w: w != "")
    f = plain(first)
    called = F.array(f, *(F.when(f == a.lower(), F.lit(b.lower())) for x, y in nicknames for a, b in ((x, y), (y, x))))
    given = F.filter(F.array_distinct(F.array_compact(called)), lambda w: F.char_length(w) > 1)
    lasts = F.filter(F.array_distinct(F.concat(F.array(plain(last)), F.filter(parts(last, "-"), lambda w: F.char_length(w) > 1))), lambda w: w != "")
    faint = F.filter(F.array_distinct(F.concat(F.array(F.substring(f, 1, 1)), parts(middle, " "), F.transform(parts(middle, " "), lambda w: F.substring(w, 1, 1)))), lambda w: w != "")
    with_last = lambda level, names: F.flatten(F.transform(names, lambda a: F.transform(lasts, lambda b: F.struct(F.lit(level).alias("level"), F.concat(a, F.lit("|"), b).alias("key")))))
    return F.array_distinct(F.concat(with_last(STRONG, given), with_last(WEAK, faint)))


def assign_profiles(profiles: DataFrame, people: DataFrame, org: str, scratch: Scratch, slug: str = "slug", person: str = "person", first: str = "first", last: str = "last", middle: str | None = None, nicknames: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(org, slug, person, status) of page profiles given to people one to one: matched by given name and surname, probable by initial or middle name and surname.

    Within an organisation a slug and a person choose each other if each is the other's only fit of the better
    level; both leave, and the rest choose again until nobody is chosen. So no person has two slugs
    and no slug two people, and what stays tied stays open. Names are letters only, without accents; a name of which a part is empty fits nothing.

    Slugs and people meet by the keys that a slug may spell, and only as counts for each key, so
    a name that very many share costs its rows, not their product.
    """
    keys = _person_keys(F.col(first), F.lit(None).cast("string") if middle is None else F.col(middle), F.col(last), nicknames)
    keyed = people.filter(F.col(org).isNotNull()).select(F.col(org).alias("org"), F.col(person).alias("who"), F.inline(keys)).distinct()
    spelled = profiles.filter(F.col(org).isNotNull() & F.col(slug).isNotNull()).select(F.col(org).alias("org"), F.col(slug).alias("who")).distinct().select("org", "who", F.inline(_slug_keys(F.col("who"))))
    # only keys of both sides matter
    both = scratch.save(spelled.select("org", "level", "key").distinct().join(keyed.select("org", "level", "key").distinct(), ["org", "level", "key"]), "keys")
    sides = [scratch.save(side.join(both, ["org", "level", "key"], "left_semi"), "side") for side in (spelled, keyed)]

    def choices(own: DataFrame, other: DataFrame, names: tuple[str, str]) -> DataFrame:
        counted = other.groupBy("org", "level", "key").agg(F.countDistinct("who").alias("n"), F.min("who").alias("one"))
        met = own.join(counted, ["org", "level", "key"])
        best = met.groupBy("org", "who").agg(F.max("level").alias("level")).withColumnsRenamed({"org": "_org", "who": "_who", "level": "_level"})
        top = met.join(best, (F.col("org") == F.col("_org")) & (F.col("who") == F.col("_who")) & (F.col("level") == F.col("_level")))
        # several keys may lead to one person: then the least and greatest are equal
        only = top.groupBy("org", "who", "level").agg(F.max("n").alias("n"), F.min("one").alias("low"), F.max("one").alias("high")).filter("n = 1 and low = high")
        return only.select("org", F.col("who").alias(names[0]), F.col("low").alias(names[1]), "level")

    given, slugs, persons = None, *sides
    while True:
        by_slug, by_person = choices(slugs, persons, ("slug", "person")), choices(persons, slugs, ("person", "slug"))
        agreed = scratch.save(by_slug.join(by_person, ["org", "slug", "person", "level"]), "agreed")
        if agreed.isEmpty():
            break
        given = agreed if given is None else given.union(agreed)
        slugs = scratch.save(slugs.join(agreed.select("org", F.col("slug").alias("who")), ["org", "who"], "left_anti"), "slugs")
        persons = scratch.save(persons.join(agreed.select("org", F.col("person").alias("who")), ["org", "who"], "left_anti"), "persons")
    given = agreed if given is None else given
    return given.select(F.col("org").alias(org), "slug", "person", F.when(F.col("level") == STRONG, "matched").otherwise("probable").alias("status"))


def mutual_best(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """Of scored pairs those that choose each other: each is the other's only best; they leave, and the rest choose again until nobody is chosen.

    No ``a`` and no ``b`` is in two rows of the result; ties stay open. Every round is two aggregations over the pairs that are left.
    """
    left = scratch.save(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(score).alias("score")).filter("a is not null and b is not null").groupBy("a", "b").agg(F.max("score").alias("score")), "edges")
    given = None
    while True:
        sides = []
        for own, other in (("a", "b"), ("b", "a")):
            top = left.groupBy(own).agg(F.max("score").alias("score"))
            sides.append(left.join(top, [own, "score"]).groupBy(own, "score").agg(F.count("*").alias("n"), F.min(other).alias(other)).filter("n = 1").select("a", "b", "score"))
        agreed = scratch.save(sides[0].join(sides[1], ["a", "b", "score"]), "agreed")
        if agreed.isEmpty():
            break
        given = agreed if given is None else given.union(agreed)
        left = scratch.save(left.join(agreed.select("a"), "a", "left_anti").join(agreed.select("b"), "b", "left_anti"), "edges")
    given = agreed if given is None else given
    return given.select(F.col("a").alias(a), F.col("b").alias(b), F.col("score").alias(score))


#: Words of firms' names that tell nothing about which firm it is. Fixed values.
FIRM_WORDS = ("advisors", "advisers", "advisory", "and", "asset", "associates", "capital", "co", "company", "corp", "financial", "fund", "funds", "group", "holdings", "inc", "investment", "investments", "llc", "llp", "lp", "ltd", "management", "of", "partners", "planning", "services", "the", "trust", "wealth")


def judge_results(results: DataFrame, people: DataFrame, taken: DataFrame, scratch: Scratch) -> DataFrame:
    """(person, url, status) of search results (person, url, title, snippet) for people (person, first, last, firm, domain), one to one.

    The name fits strongly if first and last name stand in the title, weakly if the last name does behind the
    first's initial. The firm's name without the words that firms share is strong evidence as a phrase in title or snippet
    (unless it is one short word), one of its words or its domain's name is weak; words of the person's own name are no
    evidence. Strong and strong is matched, weak and weak nothing, else probable. A url that is taken is out; a
    person and a url choose each other if each is the other's only best, so no url serves two people.
    """
    flat = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(fold_accents(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " ")), F.lit(" "))
    p = people.select(F.col("person").alias("_p"), F.trim(flat(F.col("first"))).alias("_f"), F.trim(flat(F.col("last"))).alias("_l"), F.filter(F.split(F.trim(flat(F.col("firm"))), " "), lambda w: ~w.isin(*FIRM_WORDS) & (w != "")).alias("_core"), F.trim(flat(F.split_part(F.coalesce("domain", F.lit("")), F.lit("."), F.lit(1)))).alias("_domain"))
    joined = results.join(taken.select("url").distinct(), "url", "left_anti").join(p, F.col("person") == F.col("_p"))
    has = lambda text, phrase: (phrase != "") & text.contains(F.concat(F.lit(" "), phrase, F.lit(" ")))
    title = flat(F.col("title"))
    whole = F.concat(title, flat(F.col("snippet")))
    name = F.when(has(title, F.col("_f")) & has(title, F.col("_l")), STRONG).when(has(title, F.col("_l")) & (F.col("_f") != "") & F.rlike(title, F.concat(F.lit(" "), F.substring("_f", 1, 1), F.lit(" (.* )?"), F.col("_l"), F.lit(" "))), WEAK)
    foreign = F.filter("_core", lambda w: (w != F.col("_f")) & (w != F.col("_l")))
    phrase = F.array_join("_core", " ")
    strong = (F.size(foreign) > 0) & has(whole, phrase) & ((F.size("_core") > 1) | (F.char_length(phrase) >= 5))
    some = F.exists(foreign, lambda w: (F.char_length(w) >= 3) & has(whole, w)) | ((F.char_length("_domain") >= 5) & F.replace(whole, F.lit(" "), F.lit("")).contains(F.replace(F.col("_domain"), F.lit(" "), F.lit(""))) & ~F.col("_domain").contains(F.col("_l")))
    firm = F.when(strong, STRONG).when(some, WEAK)
    rated = joined.withColumns({"_name": name, "_firm": firm}).withColumn("score", F.col("_name") + F.col("_firm")).filter("score > 2")  # null without either
    chosen = mutual_best(rated.select("person", "url", "score"), scratch, "person", "url")
    return chosen.select("person", "url", F.when(F.col("score") == 2 * STRONG, "matched").otherwise("probable").alias("status"))


def controlling_parent(owners: DataFrame, known: DataFrame, entity: str, name_key: str) -> DataFrame:
    """(entity, parent, code) of the known owner with the highest ownership code; control first on ties, then the strongest name."""
    met = owners.join(known.select(F.col(name_key).alias("_k"), "parent", "strength"), F.col(name_key) == F.col("_k"))
    return first_per_key(met, entity, [F.desc("code"), F.desc("control"), F.desc("strength"), F.asc("parent")]).select(entity, "parent", "code")


def resolve_history_org(history: DataFrame, regs: DataFrame, person: str, name_key: str, org: str) -> DataFrame:
    """History rows with the org of the same person's registration whose name is equal, or of which they are a prefix of two words or more.

    Every beginning of a registered name is a key with its best org, so a history row meets one row by equality.
    """
    r = regs.select(F.col(person).alias("_bp"), F.col(name_key).alias("_n"), F.col(org).alias("_org")).distinct()
    best = prefix_table(r, "_n", [F.asc_nulls_last("_org"), F.asc("_n")], ["_bp"], least_words=2, prefix="_bn").select("_bp", "_bn", F.col("_org").alias(org))
    return history.drop(org).join(best, (F.col(person) == F.col("_bp")) & (F.col(name_key) == F.col("_bn")), "left").select(*(c for c in history.columns if c != org), org)


def known_entity(df: DataFrame, name: str, named: Sequence[tuple[str, str]], patterns: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows with the known entity in their name and the strength of the match, null without one.

    ``named`` are (entity, phrase), found between word ends in the normalised name; the longest wins.
    ``patterns`` are (entity, expression); a phrase beats them by 1,000. Both are fixed lists of the
    caller's, so the best is one expression for each different name and nothing is crossed. Ties go to the
    entity that comes first by name.
    """
    plain = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " ")), F.lit(" "))
    hits = [F.when(plain(F.col(name)).contains(plain(F.lit(phrase))), F.struct(F.lit(1000 + len(phrase)).alias("strength"), F.lit(entity).alias("entity"))) for entity, phrase in named]
    hits += [F.when(F.col(name).rlike(f"(?i){pattern}"), F.struct(F.lit(len(pattern)).alias("strength"), F.lit(entity).alias("entity"))) for entity, pattern in patterns]
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    best = F.get(F.array_sort(F.transform(found, lambda h: F.struct((-h["strength"]).alias("less"), h["entity"].alias("entity"), h["strength"].alias("strength")))), F.lit(0))
    names = df.select(name).distinct().withColumn("_best", best).withColumnRenamed(name, "_name")
    joined = df.join(names, F.col(name).eqNullSafe(F.col("_name")), "left")
    return joined.select(*df.columns, F.col("_best.entity").alias("known_entity"), F.col("_best.strength").alias("known_strength"))


def officer_titles(roster: DataFrame, officers: DataFrame, org: str, name: str = "name", title: str = "title") -> DataFrame:
    """Roster rows with the title of the organisation's officer of the same surname and first three letters of the first name.

    Officers are filed as LAST, FIRST, MIDDLE. Of several the title that comes first is taken; a name
    without a part has no title. Letters of all scripts count, accents too; marks don't.
    """
    letters = lambda c: F.regexp_replace(F.upper(c), "[^\\p{L}]", "")
    key = lambda last, first: F.concat_ws("|", F.nullif(letters(last), F.lit("")), F.nullif(F.left(letters(first), F.lit(3)), F.lit("")))
    whole = lambda c: F.when(c.contains("|"), c)
    filed = lambda i: F.trim(F.split_part(F.col(name), F.lit(","), F.lit(i)))
    known = officers.select(F.col(org).alias("_org"), whole(key(filed(1), filed(2))).alias("_key"), F.col(title).alias("_title")).filter("_key is not null").groupBy("_org", "_key").agg(F.min("_title").alias("officer_title"))
    rows = roster.withColumn("_k", whole(key(F.col("last"), F.col("first"))))
    return rows.join(known, (F.col(org) == F.col("_org")) & (F.col("_k") == F.col("_key")), "left").select(*roster.columns, "officer_title")
