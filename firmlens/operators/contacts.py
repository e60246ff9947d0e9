"""Contact consolidation: normalised values, merge with provenance, best per person, suppression, eligibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.frames import first_per_key
from .joins import multi_scope_join

#: Local parts of shared inboxes. Fixed values.
ROLE_INBOXES = ("info", "contact", "admin", "office", "support", "sales", "hello", "help", "compliance", "hr", "jobs", "marketing", "service", "team")
KEY = ("entity", "person", "kind", "value")


def normalise(kind: Column, value: Column) -> Column:
    """Emails in lower case, US phones as ten digits, profile addresses as host and path; null if it isn't one."""
    email = F.regexp_extract(F.lower(F.trim(value)), r"^(?:mailto:)?([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})$", 1)
    phone = F.regexp_extract(F.regexp_replace(F.regexp_replace(value, "(?i)(ext|x)\\.? *[0-9]+$", ""), "[^0-9]", ""), "^1?([2-9][0-9]{9})$", 1)
    profile = F.regexp_extract(F.lower(F.trim(value)), r"^(?:https?://)?(?:www\.)?([a-z0-9.-]+/(?:in|company)/[^/?#]+)", 1)
    return F.nullif(F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "profile", profile).otherwise(F.trim(value)), F.lit(""))


def is_role(kind: Column, value: Column) -> Column:
    """Whether an address is a shared inbox."""
    return (kind == "email") & F.split_part(value, F.lit("@"), F.lit(1)).isin(*ROLE_INBOXES)


def normalise_contacts(df: DataFrame) -> DataFrame:
    """A contact table with values normalised, is_role, and what isn't a value left out; on different values only."""
    values = df.select("kind", F.col("value").alias("raw")).distinct().withColumn("_v", normalise(F.col("kind"), F.col("raw"))).withColumnRenamed("kind", "_k")
    joined = df.join(values, (F.col("kind") == F.col("_k")) & (F.col("value") == F.col("raw"))).filter(F.col("_v").isNotNull())
    return joined.withColumn("value", F.col("_v")).drop("_v", "_k", "raw").withColumn("is_role", is_role(F.col("kind"), F.col("value")))


def merge_contacts(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (entity, person, kind, value): the highest confidence with its source, all sources, the first label and title.

    Both have KEY, confidence, source, label, title, seen (an order of arrival).
    """
    cols = [*KEY, "confidence", "source", "label", "title", "seen"]
    rows = old.select(*cols).unionByName(new.select(*cols))
    return rows.groupBy(*KEY).agg(
        F.max("confidence").alias("confidence"),
        F.max_by("source", F.struct("confidence", (-F.col("seen")).alias("s"), "source")).alias("source"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min_by("label", F.when(F.col("label").isNotNull(), F.struct("seen", "label"))).alias("label"),
        F.min_by("title", F.when(F.col("title").isNotNull(), F.struct("seen", "title"))).alias("title"),
        F.min("seen").alias("seen"),
    )


def drop_firm_copies(df: DataFrame, shared: Column | None = None) -> DataFrame:
    """Rows without those of the firm alone whose value a person has; shared lines stay."""
    own = df.filter(F.col("person").isNotNull()).select("entity", "kind", "value").distinct()
    firm = F.col("person").isNull() & ~F.coalesce(shared if shared is not None else F.lit(False), F.lit(False))
    return df.filter(~firm).unionByName(df.filter(firm).join(own, ["entity", "kind", "value"], "left_anti").select(*df.columns))


def usable(df: DataFrame) -> DataFrame:
    """Phones and profiles always; emails if verified, or published and not failed."""
    published = ~F.array_contains("sources", "guess") | (F.size("sources") > 1)
    ok = (F.col("verify_status") == "valid") | (published & ~F.coalesce(F.col("verify_status") == "invalid", F.lit(False)))
    return df.filter(F.col("kind").isin("phone", "profile") | ((F.col("kind") == "email") & F.coalesce(ok, F.lit(False))))


def best_contacts(df: DataFrame) -> DataFrame:
    """(entity, person, email, phone, profile): the most confident of each kind, own before shared inboxes, the oldest on ties; one aggregation."""
    rank = F.struct((~F.coalesce("is_role", F.lit(False))).alias("own"), "confidence", (-F.col("seen")).alias("old"), "value")
    best = lambda kind: F.max_by("value", F.when(F.col("kind") == kind, rank)).alias(kind)
    return df.filter(F.col("person").isNotNull()).groupBy("entity", "person").agg(best("email"), best("phone"), best("profile"))


def contact_flags(df: DataFrame) -> DataFrame:
    """How each entity can be reached: personal and verified addresses, inboxes, guesses, direct lines, any phone."""
    email, phone, own = F.col("kind") == "email", F.col("kind") == "phone", F.col("person").isNotNull()
    return df.groupBy("entity").agg(
        F.countDistinct(F.when(email & own & ~F.col("is_role"), F.col("value"))).alias("personal"),
        F.countDistinct(F.when(email & (F.col("verify_status") == "valid"), F.col("value"))).alias("verified"),
        F.countDistinct(F.when(email & F.col("is_role"), F.col("value"))).alias("inbox"),
        F.count_if(email & (F.col("source") == "guess")).alias("guess"),
        F.countDistinct(F.when(phone & own, F.col("value"))).alias("direct"),
        F.max(phone).alias("phone"),
    )


def coverage(people: DataFrame, best: DataFrame) -> DataFrame:
    """One row: people, and those with an email, a phone, a profile, and any."""
    j = people.select("entity", "person").distinct().join(best, ["entity", "person"], "left")
    has = lambda c: F.col(c).isNotNull()
    return j.agg(F.count("*").alias("people"), F.count_if(has("email")).alias("email"), F.count_if(has("phone")).alias("phone"), F.count_if(has("profile")).alias("profile"), F.count_if(has("email") | has("phone")).alias("reachable"))


def apply_verdicts(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Confidence at least 95 for a valid address, 0 for an invalid one; ``verdicts`` has value and verdict, one row each."""
    v = verdicts.select(F.col("value").alias("_v"), "verdict")
    j = df.join(v, (F.col("kind") == "email") & (F.col("value") == F.col("_v")), "left")
    points = F.when(F.col("verdict") == "valid", F.greatest("confidence", F.lit(95))).when(F.col("verdict") == "invalid", 0).otherwise(F.col("confidence"))
    return j.withColumns({"confidence": points, "verify_status": F.coalesce("verdict", "verify_status")}).drop("_v", "verdict")


def retire(df: DataFrame, source: str, run: int, stamp: str = "seen") -> DataFrame:
    """Rows without those that a source no longer derives, unless another source vouches; the source itself goes from their lists."""
    stale = F.array_contains("sources", source) & (F.col(stamp) < run)
    others = F.array_except("sources", F.array(F.lit(source)))
    return df.filter(~stale | (F.size(others) > 0)).withColumn("sources", F.when(stale, others).otherwise(F.col("sources")))


def contact_rows(df: DataFrame) -> DataFrame:
    """Rows for export: one per address with the person's phone, people with a phone only, shared inboxes last."""
    mails = df.filter("kind = 'email'").groupBy("entity", "value").agg(F.min("person").alias("person"), F.max("is_role").alias("is_role"), F.max("confidence").alias("confidence"))
    phones = df.filter("kind = 'phone' and person is not null").groupBy("entity", "person").agg(F.max_by("value", F.struct("confidence", "value")).alias("phone"))
    with_phone = mails.join(phones.withColumnsRenamed({"entity": "_e", "person": "_p"}), (F.col("entity") == F.col("_e")) & (F.col("person") == F.col("_p")), "left").select("entity", "person", F.col("value").alias("email"), "phone", "is_role", "confidence")
    lone = phones.join(mails.select("entity", "person").distinct(), ["entity", "person"], "left_anti").select("entity", "person", F.lit(None).cast("string").alias("email"), "phone", F.lit(False).alias("is_role"), F.lit(0).alias("confidence"))
    rows = with_phone.unionByName(lone)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.asc("is_role"), F.col("email").isNull(), F.desc("confidence"), F.asc_nulls_last("email"), F.asc_nulls_last("person"))))


#: Scopes in which a person can be on the list, the strongest first. Fixed values.
SCOPES = ("opt_out", "firm", "person", "individual", "email", "domain", "phone")


def suppress(people: DataFrame, listed: DataFrame, scopes: Mapping[str, str], row: str) -> DataFrame:
    """People with suppressed_by, the strongest scope under which they are listed; entries that were lifted don't count."""
    live = listed.filter(F.col("lifted_at").isNull()) if "lifted_at" in listed.columns else listed
    marked = multi_scope_join(people, dict(scopes), live, row)
    first = F.get(F.filter(F.array(*map(F.lit, SCOPES)), lambda s: F.array_contains("scopes_hit", s)), F.lit(0))
    return marked.withColumn("suppressed_by", first).drop("scopes_hit")


def eligibility(people: DataFrame, row: str, individual: str, address: str, order: Sequence[Column], history: DataFrame, cool_days: int, as_of: Column) -> DataFrame:
    """People with one reason in rule order, or eligible: suppressed, no address, sent lately, individual or address taken by one before.

    ``people`` has suppressed_by; ``history`` has the individual and sent_on. A missing individual takes
    nothing and is taken by none; such rows are dealt by their own row, not as one key.
    """
    last = history.groupBy(F.col(individual).alias("_i")).agg(F.max("sent_on").alias("_sent"))
    j = people.join(last, F.col(individual) == F.col("_i"), "left")
    early = (
        F.when(F.col("suppressed_by").isNotNull(), F.concat(F.lit("suppressed: "), F.col("suppressed_by")))
        .when(F.col(address).isNull(), "no address")
        .when(F.datediff(as_of, F.col("_sent")) < cool_days, "sent lately")
    )
    marked = j.withColumn("_early", early)
    open_ = F.col("_early").isNull()
    alone = lambda c: F.when(F.col(c).isNull(), F.col(row).cast("string"))
    nth = lambda c, of: F.row_number().over(Window.partitionBy(c, alone(c), of).orderBy(*order, F.asc(row)))
    # an address counts only among those that are first for their individual
    one = marked.withColumn("_nth", nth(individual, open_))
    two = one.withColumn("_alive", open_ & (F.col("_nth") == 1)).withColumn("_at", nth(address, F.col("_alive")))
    why = F.coalesce("_early", F.when(F.col("_nth") > 1, "individual already in this batch"), F.when(F.col("_at") > 1, "address already in this batch"), F.lit("eligible"))
    return two.select(*people.columns, why.alias("reason"))


def people_index(roster: DataFrame, officers: DataFrame, web: DataFrame, best: DataFrame, scores: DataFrame, tags: DataFrame) -> DataFrame:
    """The serving table of people: roster, then officers, then web people whose name isn't there yet, with best contacts, scores and tags.

    All three have entity, person, name_key, title.
    """
    cols = ["entity", "person", "name_key", "title"]
    parts = [f.select(*cols, F.lit(name).alias("origin"), F.lit(i).alias("_rank")) for i, (name, f) in enumerate((("roster", roster), ("officer", officers), ("web", web)))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    one = first_per_key(rows, ["entity", "name_key"], [F.asc("_rank"), F.asc_nulls_last("title"), F.asc("person")]).drop("_rank")
    return one.join(best, ["entity", "person"], "left").join(scores, "entity", "left").join(tags, "title", "left")
