"""Rule-based classification: segments, mixes, decision lists, titles to roles and tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core.frames import first_per_key

#: Ratios that split competitors from prospects, and the size beyond which a low ratio is still ambiguous. Fixed values.
SEGMENT = {"competitor": 0.5, "prospect": 0.15, "very_large": 1e9, "absolute": 1e8}


def segment(value: Column, whole: Column, sponsor: Column, cfg: Mapping = SEGMENT) -> Column:
    """struct(segment, rationale): the sponsor gate first, then no value, then the ratio, then absolute size without a total."""
    ratio = value / F.nullif(whole, F.lit(0))
    kind = (
        F.when(F.coalesce(sponsor, F.lit(False)), "sponsor")
        .when(F.coalesce(value, F.lit(0)) == 0, F.when(whole.isNull(), "ambiguous").otherwise("unraised"))
        .when(ratio >= cfg["competitor"], "competitor")
        .when(ratio < cfg["prospect"], F.when(value >= cfg["very_large"], "ambiguous").otherwise("prospect"))
        .when(ratio.isNotNull(), "ambiguous")
        .otherwise(F.when(value >= cfg["absolute"], "competitor").otherwise("ambiguous"))
    )
    text = F.when(ratio.isNotNull(), F.format_string("%.4f of total", ratio.cast("double"))).otherwise(F.lit("no total"))
    return F.struct(kind.alias("segment"), text.alias("rationale"))


def mix(columns: Sequence[str], fallback: Sequence[str] | None = None) -> Column:
    """struct(basis, shares): shares of categories by amount, else by count; null without either."""

    def shares(cols: Sequence[str], basis: str) -> Column:
        total = sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0))
        parts = F.array(*(F.struct(F.lit(c).alias("key"), F.round((F.coalesce(F.col(c), F.lit(0)) / total).cast("double"), 6).alias("share")) for c in cols))
        return F.when(total > 0, F.struct(F.lit(basis).alias("basis"), F.map_from_entries(parts).alias("shares")))

    by = shares(columns, "amount")
    return F.coalesce(by, shares(fallback, "count")) if fallback else by


def decision_list(rules: Sequence[tuple[Column, str, int, Sequence[tuple[Column, str]]]], otherwise: str = "unknown") -> Column:
    """struct(category, confidence, evidence) of the first rule that holds, with up to four lines of its evidence.

    A rule is (condition, category, confidence, [(condition, line)]).
    """
    verdict = F.struct(F.lit(otherwise).alias("category"), F.lit(0).alias("confidence"), F.array().cast("array<string>").alias("evidence"))
    for condition, category, confidence, lines in reversed(list(rules)):
        shown = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in lines)) if lines else F.array().cast("array<string>")
        own = F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.slice(F.filter(shown, lambda x: x.isNotNull()), 1, 4).alias("evidence"))
        verdict = F.when(F.coalesce(condition, F.lit(False)), own).otherwise(verdict)
    return verdict


def multi_label(labels: Mapping[str, Column]) -> Column:
    """The names of the labels that hold, in their order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in labels.items())), lambda x: x.isNotNull())


def merge_verdict(old: DataFrame, new: DataFrame, entity: str) -> DataFrame:
    """(entity, category, confidence, source, changed): a manual verdict stays at 100, a model's while rules are under 50, else the rules'.

    ``old`` has entity, category, confidence, source; ``new`` entity, category, confidence.
    """
    o = old.select(F.col(entity).alias("_e"), F.col("category").alias("_c"), F.col("confidence").alias("_q"), F.col("source").alias("_s"))
    j = new.join(o, F.col(entity) == F.col("_e"), "full")
    manual = F.col("_s") == "manual"
    model = (F.col("_s") == "model") & (F.coalesce("confidence", F.lit(0)) < 50)
    keep = F.coalesce(manual | model | F.col("category").isNull(), F.lit(False))
    pick = lambda a, b: F.when(keep, F.col(a)).otherwise(F.col(b))
    out = j.select(F.coalesce(entity, "_e").alias(entity), pick("_c", "category").alias("category"), F.when(F.coalesce(manual, F.lit(False)), 100).otherwise(pick("_q", "confidence")).alias("confidence"), F.when(keep, F.col("_s")).otherwise("rules").alias("source"), "_c", "_q", "_s")
    changed = ~(F.col("category").eqNullSafe(F.col("_c")) & F.col("confidence").eqNullSafe(F.col("_q")) & F.col("source").eqNullSafe(F.col("_s")))
    return out.withColumn("changed", changed).drop("_c", "_q", "_s")


def rule_of(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first (name, pattern) that the text matches."""
    chain = F.lit(otherwise).cast("string")
    for name, pattern in reversed(list(rules)):
        chain = F.when(text.rlike(pattern), F.lit(name)).otherwise(chain)
    return chain


def role_of(df: DataFrame, title: str, stored: DataFrame, rules: Sequence[tuple[str, str]], out: str = "role", otherwise: str = "other") -> DataFrame:
    """Rows with the role of their title: the stored map (title, role) first, else the first rule; on different titles only."""
    titles = df.select(F.lower(F.trim(title)).alias("_t")).distinct()
    known = stored.select(F.lower(F.trim("title")).alias("_t"), F.col("role").alias("_stored")).groupBy("_t").agg(F.min("_stored").alias("_stored"))
    decided = titles.join(known, "_t", "left").select("_t", F.coalesce("_stored", rule_of(F.col("_t"), rules, otherwise)).alias(out))
    return df.join(decided, F.lower(F.trim(title)).eqNullSafe(F.col("_t")), "left").drop("_t")


def clean_title(title: Column, most: int = 60) -> Column:
    """A title without marks and doubled spaces, shouting put to capitals, cut at a word's end."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(title, "[^\\p{L}\\p{N}&/,.' -]+", " "), "\\s+", " "))
    cased = F.when(plain == F.upper(plain), F.initcap(plain)).otherwise(plain)
    return F.when(F.char_length(cased) <= most, cased).otherwise(F.regexp_extract(cased, f"^(.{{1,{most}}})(?= )", 1))


def title_matches(title: Column, query: str) -> Column:
    """Typed search: commas are OR, words AND, each word begins a word of the title."""
    words = F.split(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), " ")
    some = F.lit(False)
    for part in query.lower().split(","):
        every = F.lit(bool(part.strip()))
        for word in part.split():
            every = every & _begins(words, word)
        some = some | every
    return some


def _begins(words: Column, start: str) -> Column:
    return F.exists(words, lambda w: w.startswith(start))


def designations(df: DataFrame, title: str, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]], abbreviations: Mapping[str, str], out: str = "tags") -> DataFrame:
    """Rows with the sorted tags of their title: (tag, any of these phrases, none of those), on different titles only.

    Words are spelled out before they are compared; a phrase's words begin consecutive words.
    """
    titles = df.select(title).distinct()
    plain = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))
    words = F.split(plain, " ")
    chain = lambda w: _spelled(w, abbreviations)
    spelled = F.concat(F.lit(" "), F.array_join(F.transform(words, chain), " "), F.lit(" "))
    hit = lambda p: F.col("_s").rlike(" " + "[a-z0-9]* ".join(p.lower().split()) + "[a-z0-9]* ")
    any_of = lambda ps: _or([hit(p) for p in ps])
    tags = F.array(*(F.when(any_of(yes) & ~any_of(no), F.lit(tag)) for tag, yes, no in rules))
    tagged = titles.withColumn("_s", spelled).select(F.col(title).alias("_t"), F.array_sort(F.filter(tags, lambda x: x.isNotNull())).alias(out))
    return df.join(tagged, F.col(title).eqNullSafe(F.col("_t")), "left").drop("_t")


def _spelled(word: Column, abbreviations: Mapping[str, str]) -> Column:
    chain = word
    for short, whole in abbreviations.items():
        chain = F.when(word == short, F.lit(whole)).otherwise(chain)
    return chain


def _or(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def icp_roles(df: DataFrame, title: str, rules: Sequence[tuple[str, str, bool]], person: str) -> DataFrame:
    """(person, product, primary) of the first (product, pattern, primary) that a title matches, primary rules first."""
    spots = F.array(*(F.when(F.lower(title).rlike(p), F.struct(F.lit(product).alias("product"), F.lit(primary).alias("primary"), F.lit(i).alias("rule"))) for i, (product, p, primary) in enumerate(rules)))
    rows = df.select(person, F.inline(F.filter(spots, lambda s: s.isNotNull())))
    return first_per_key(rows, [person, "product"], [F.desc("primary"), F.asc("rule")]).select(person, "product", "primary")


#: Functions of job titles, in order of rule. Fixed values.
JOB_FUNCTIONS = (
    ("compliance", r"\bcompliance\b"), ("operations", r"\boperations?\b|client service"), ("portfolio", r"portfolio|investment (analyst|associate)|\btrader\b"),
    ("advisor", r"advis[eo]r|wealth manager|financial planner"), ("marketing", r"marketing|communications"), ("sales", r"\bsales\b|business development"),
    ("technology", r"engineer|developer|technology|data"), ("executive", r"\bchief\b|president|director|partner"),
)


def job_function(title: Column) -> Column:
    """The function of a job title by ordered rules."""
    return rule_of(F.lower(title), JOB_FUNCTIONS, "other")
