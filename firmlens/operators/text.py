"""Text and pages: phrase tags with sections and negation, page signals, contacts on pages, structured data, listings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.frames import first_per_key

#: Words before a phrase that deny it. Fixed values.
NEGATION = ("not", "no", "never", "does not", "do not", "without", "neither")
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_PHONE = r"(?:\+?1[-. ]?)?\(?([2-9][0-9]{2})\)?[-. ]([0-9]{3})[-. ]([0-9]{4})(?![0-9])"


def sentences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, place, sentence) of all sentences."""
    parts = F.split(F.regexp_replace(F.col(text), "\\s+", " "), "(?<=[.!?]) ")
    return docs.select(F.col(doc_id).alias("doc"), F.posexplode(parts).alias("place", "sentence")).filter(F.trim("sentence") != "")


def section_at(sents: DataFrame, pattern: str = "^Item ([0-9]+)") -> DataFrame:
    """Sentences with the number of the last section heading at or before them."""
    heading = F.nullif(F.regexp_extract("sentence", pattern, 1), F.lit(""))
    order = Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return sents.withColumn("section", F.last(heading, True).over(order).cast("int"))


def phrase_count(text: Column, phrase: str) -> Column:
    """How often a phrase occurs, overlapping itself too."""
    return F.regexp_count(text, F.lit(f"(?={_quoted(phrase)})"))


def _quoted(phrase: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase.lower())


def tag_documents(docs: DataFrame, vocabulary: Sequence[tuple[str, Sequence[str]]], doc_id: str = "doc_id", text: str = "text", bonus_sections: Sequence[int] = (4, 8), words: int = 25) -> DataFrame:
    """(doc, tag, hits, phrases, negated, confidence, section, snippet) by (tag, phrases).

    A phrase of three words or more is specific (0.9), of two 0.7, of one 0.5; each hit up to five adds
    0.02, a hit in a bonus section 0.05; a tag with negated hits only counts 0.6 of that. Confidence is 1
    at most. The best sentence is the most specific one, the earliest on ties. Sentences are split once
    and phrases are counted in one expression per tag, so nothing is crossed.
    """
    rows = section_at(sentences(docs, doc_id, text))
    low = F.lower(F.col("sentence"))
    spec = lambda p: 0.9 if len(p.split()) >= 3 else 0.7 if len(p.split()) == 2 else 0.5
    spots = F.array(*(F.struct(F.lit(tag).alias("tag"), F.lit(p).alias("phrase"), F.lit(spec(p)).alias("spec"), phrase_count(F.col("_low"), p).alias("n")) for tag, phrases in vocabulary for p in phrases))
    any_phrase = "|".join(_quoted(p) for _, phrases in vocabulary for p in phrases)
    hit = rows.withColumn("_low", low).filter(F.col("_low").rlike(any_phrase))
    denied = F.col("_low").rlike("\\b(" + "|".join(NEGATION) + ")\\b")
    found = hit.select("doc", "place", "section", "sentence", denied.alias("denied"), F.inline(F.filter(spots, lambda s: s["n"] > 0)))
    clean = ~F.col("denied")
    by = found.groupBy("doc", "tag").agg(
        F.sum("n").alias("hits"),
        F.countDistinct("phrase").alias("phrases"),
        F.sum(F.when(F.col("denied"), F.col("n")).otherwise(0)).alias("negated"),
        F.max("spec").alias("_spec"),
        F.max(F.coalesce(F.col("section").isin(*bonus_sections), F.lit(False))).alias("_bonus"),
        F.max(F.struct(clean.alias("clean"), "spec", (-F.col("place")).alias("early"), "section", "sentence")).alias("_best"),
    )
    value = F.col("_spec") + 0.02 * F.least(F.col("hits"), F.lit(5)) + F.when(F.col("_bonus"), 0.05).otherwise(0.0)
    value = value * F.when(F.col("negated") == F.col("hits"), 0.6).otherwise(1.0)
    return by.select("doc", "tag", "hits", "phrases", "negated", F.round(F.least(F.lit(1.0), value), 4).alias("confidence"), F.col("_best.section").alias("section"), cap_words(F.col("_best.sentence"), words).alias("snippet"))


def cap_words(text: Column, n: int) -> Column:
    """The first ``n`` words."""
    parts = F.split(F.trim(text), " ")
    return F.when(F.size(parts) <= n, F.trim(text)).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit(" …")))


def negations(tags: DataFrame, decided: DataFrame) -> DataFrame:
    """Tags whose hits are all negated and that nobody has decided yet."""
    return tags.filter("negated = hits").join(decided.select("doc", "tag").distinct(), ["doc", "tag"], "left_anti")


def stale_documents(docs: DataFrame, tagged: DataFrame, doc_id: str, version: int) -> DataFrame:
    """Documents not tagged with this version of the vocabulary or a later one."""
    return docs.join(tagged.filter(F.col("version") >= version).select(doc_id).distinct(), doc_id, "left_anti")


def anchors(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, place, href, label) of all links."""
    tags = F.regexp_extract_all(html, F.lit("(?is)(<a\\s[^>]*>.*?</a>)"), F.lit(1))
    rows = pages.select(page_id, F.posexplode(tags).alias("place", "tag"))
    href = F.regexp_extract("tag", "(?is)href\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)
    return rows.select(page_id, "place", href.alias("href"), F.trim(F.regexp_replace(F.regexp_replace("tag", "<[^>]*>", " "), "\\s+", " ")).alias("label"))


def page_signals(pages: DataFrame, patterns: Sequence[tuple[str, str]], entity: str, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(entity, signal, page_id, evidence): the first link whose address or label matches a signal's pattern, first page first."""
    links = anchors(pages, page_id, html).join(pages.select(F.col(page_id).alias("_p"), F.col(entity).alias("_e")), F.col(page_id) == F.col("_p"))
    hits = F.array(*(F.when(F.lower("href").rlike(p) | F.lower("label").rlike(p), F.lit(s)) for s, p in patterns))
    rows = links.select(F.col("_e").alias(entity), page_id, "place", F.col("href").alias("evidence"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("signal"))
    return rows.groupBy(entity, "signal").agg(F.min(F.struct(page_id, "place", "evidence")).alias("_f")).select(entity, "signal", f"_f.{page_id}", "_f.evidence")


#: Parts of addresses that aren't a person's or a firm's. Fixed values.
DROP_EMAIL = r"(\.(png|jpg|jpeg|gif|svg|css|js)$)|^(example|test|noreply|no-reply)@|@(example|sentry)\."


def emails_in(text: Column) -> Column:
    """Different addresses of a text in lower case, without files and samples."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({_EMAIL})"), F.lit(1)), lambda x: F.lower(F.rtrim(x))))
    return F.filter(found, lambda x: ~x.rlike(DROP_EMAIL))


def decode_cfemail(code: Column) -> Column:
    """An address encoded as hexadecimal bytes xor the first."""
    byte = lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int")
    key = F.conv(F.substring(code, 1, 2), 16, 10).cast("int")
    places = F.sequence(F.lit(3), F.greatest(F.length(code) - 1, F.lit(3)), F.lit(2))
    return F.when(F.length(code) >= 4, F.lower(F.array_join(F.transform(places, lambda i: F.char(byte(i).bitwiseXOR(key))), "")))


def page_emails(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, email, method, confidence): mailto 85, encoded 85, plain text 70, obfuscated 50; the best method of an address.

    Addresses on the page's own domain, or visible to a reader, stay; others go.
    """
    visible = F.regexp_replace(F.regexp_replace(F.col(html), "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " ")
    plain = F.regexp_replace(F.regexp_replace(visible, "(?i)\\s*[\\[(]\\s*at\\s*[\\])]\\s*", "@"), "(?i)\\s*[\\[(]\\s*dot\\s*[\\])]\\s*", ".")
    tagged = lambda method, points, arr, seen: F.transform(arr, lambda e: F.struct(F.lit(method).alias("method"), F.lit(points).alias("confidence"), e.alias("email"), F.lit(seen).alias("visible")))
    mail = F.transform(F.regexp_extract_all(html, F.lit("(?i)mailto:([^\"'?>\\s]+)"), F.lit(1)), lambda x: F.lower(x))
    coded = F.transform(F.regexp_extract_all(html, F.lit("data-cfemail=[\"']([0-9a-fA-F]+)"), F.lit(1)), decode_cfemail)
    every = F.concat(tagged("mailto", 85, mail, True), tagged("encoded", 85, coded, True), tagged("plain", 70, emails_in(visible), True), tagged("obfuscated", 50, F.array_except(emails_in(plain), emails_in(visible)), True), tagged("hidden", 50, F.array_except(emails_in(F.col(html)), emails_in(visible)), False))
    rows = pages.select(page_id, F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "").alias("_host"), F.inline(every))
    good = rows.filter(F.col("email").rlike(f"^{_EMAIL}$") & ~F.col("email").rlike(DROP_EMAIL) & (F.col("visible") | F.col("email").endswith(F.concat(F.lit("@"), F.col("_host")))))
    return first_per_key(good, [page_id, "email"], [F.desc("confidence"), F.asc("method")]).select(page_id, "email", "method", "confidence")


#: What the words before a number say of it, most specific first. Fixed values.
PHONE_LABELS = (("fax", r"\bfax\b|\bf:"), ("direct", r"\bdirect\b|\bd:"), ("mobile", r"\b(mobile|cell)\b|\bm:"), ("office", r"\b(office|phone|tel|call)\b|\bp:"))


def page_phones(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, phone, label) of numbers of the US form; the most specific label of a number, faxes left out."""
    framed = F.regexp_replace(F.col(html), "(?is)<(script|style|noscript)[^>]*>.*?</\\1>", " ")
    text = F.regexp_replace(F.regexp_replace(framed, "(?i)href=[\"']tel:([^\"']+)[\"']", "> tel $1 <"), "<[^>]*>", " ")
    spots = F.regexp_extract_all(text, F.lit(f"(.{{0,24}}{_PHONE})"), F.lit(1))
    rows = pages.select(page_id, F.explode(spots).alias("spot"))
    digits = F.concat(F.regexp_extract("spot", _PHONE + "$", 1), F.regexp_extract("spot", _PHONE + "$", 2), F.regexp_extract("spot", _PHONE + "$", 3))
    rank, label = F.lit(len(PHONE_LABELS)), F.lit("plain")
    for i, (name, pattern) in reversed(list(enumerate(PHONE_LABELS))):
        at = F.lower("spot").rlike(pattern)
        rank, label = F.when(at, i).otherwise(rank), F.when(at, name).otherwise(label)
    best = first_per_key(rows.select(page_id, digits.alias("phone"), rank.alias("_rank"), label.alias("label")), [page_id, "phone"], [F.asc("_rank")])
    return best.filter("label <> 'fax'").select(page_id, "phone", "label")


def page_jsonld(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, type, name, title, email, phone) of people and organisations in JSON-LD blocks, single, listed or in a graph."""
    blocks = F.regexp_extract_all(html, F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), F.lit(1))
    parsed = pages.select(page_id, F.explode(blocks).alias("block")).select(page_id, F.try_parse_json("block").alias("v")).filter(F.col("v").isNotNull())
    path = lambda c, p, t="string": F.try_variant_get(c, p, t)
    listed = F.coalesce(path("v", "$.@graph", "array<variant>"), path("v", "$", "array<variant>"), F.array("v"))
    items = parsed.select(page_id, F.explode(listed).alias("o"))
    kind = F.coalesce(path("o", "$['@type']"), path("o", "$['@type'][0]"))
    return items.select(page_id, kind.alias("type"), path("o", "$.name").alias("name"), path("o", "$.jobTitle").alias("title"), F.lower(F.regexp_replace(path("o", "$.email"), "^mailto:", "")).alias("email"), path("o", "$.telephone").alias("phone")).filter(F.col("type").isin("Person", "Organization", "LocalBusiness", "FinancialService") & F.col("name").isNotNull())


class _Cards(HTMLParser):
    """Texts and links of elements that repeat under one class."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.closed: dict[str, list[dict]] = {}

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "input", "hr", "meta", "link"):
            return
        a = dict(attrs)
        self.stack.append({"tag": tag, "class": a.get("class") or "", "text": [], "href": a.get("href")})
        if a.get("href"):
            for e in self.stack:
                e["href"] = e["href"] or a["href"]

    def handle_data(self, data):
        if data.strip():
            for e in self.stack:
                e["text"].append(" ".join(data.split()))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k]["tag"] == tag:
                e = self.stack[k]
                del self.stack[k:]
                self.closed.setdefault(f"{tag}.{e['class']}", []).append(e)
                return


def _cards(html: str, least: int) -> list[tuple[str, str, str | None]]:
    """(kind, text, href) of the repeated elements with the most text under one class."""
    p = _Cards()
    try:
        p.feed(html or "")
    except AssertionError:  # malformed declarations
        return []
    groups = [(k, es) for k, es in p.closed.items() if len(es) >= least and sum(bool(e["text"]) for e in es) >= least]
    if not groups:
        return []
    kind, found = max(groups, key=lambda g: (sum(len(" ".join(e["text"])) for e in g[1]), g[0]))
    return [(kind, " | ".join(e["text"]), e["href"]) for e in found if e["text"]]


def record_key(*cols: Column) -> Column:
    """sha1 of the fields in lower case."""
    return F.sha1(F.concat_ws("\u0001", *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in cols)).cast("binary"))


def page_cards(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = 3) -> DataFrame:
    """(page_id, kind, text, href, key) of repeated cards, one row per key and page.

    The page's tree needs a parser, so this one operator runs Python, in Arrow batches.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            rows = [(i, *card) for i, h in zip(frame[page_id], frame[html]) for card in _cards(h, least)]
            yield pd.DataFrame(rows, columns=[page_id, "kind", "text", "href"])

    kind = pages.schema[page_id].dataType.simpleString()
    found = pages.select(page_id, html).mapInPandas(run, f"{page_id} {kind}, kind string, text string, href string")
    return found.withColumn("key", record_key(F.col("kind"), F.col("text"), F.col("href"))).dropDuplicates([page_id, "key"])


#: Words of job titles, and of menus that look like them. Fixed values.
ROLE_WORDS = r"\b(advisor|adviser|analyst|associate|manager|director|officer|planner|assistant|engineer|counsel|trader|specialist|coordinator)\b"
MENU_WORDS = r"\b(our|meet|about|contact|home|login|learn|read|more|team|services)\b"


def page_roles(pages: DataFrame, page_id: str = "page_id", html: str = "html", most: int = 80) -> DataFrame:
    """(page_id, title, none_open) of job titles in headings and links; none_open where the page says so."""
    spots = F.regexp_extract_all(html, F.lit("(?is)<(?:h[1-6]|a|li|strong)\\b[^>]*>(.*?)</(?:h[1-6]|a|li|strong)>"), F.lit(1))
    none = F.lower(html).rlike("no (current |open )?(openings|positions|vacancies)")
    clean = F.trim(F.regexp_replace(F.regexp_replace("spot", "<[^>]*>", " "), "\\s+", " "))
    rows = pages.select(page_id, none.alias("none_open"), F.explode_outer(spots).alias("spot")).withColumn("title", clean)
    good = F.lower("title").rlike(ROLE_WORDS) & ~F.lower("title").rlike(MENU_WORDS) & (F.char_length("title") <= most) & F.col("title").rlike("^[A-Z]")
    titles = rows.filter(good).groupBy(page_id, F.lower("title").alias("_t")).agg(F.min("title").alias("title"), F.max("none_open").alias("none_open"))
    return titles.drop("_t")


def board_postings(results: DataFrame, firms: DataFrame, entity: str) -> DataFrame:
    """Postings (url, title, firm_key, states, remote) of firms (entity, core, states): equal core name, a state in common or remote."""
    f = firms.select(entity, F.col("core").alias("_core"), F.col("states").alias("_states"))
    return results.join(f, F.col("firm_key") == F.col("_core")).filter(F.coalesce("remote", F.lit(False)) | F.arrays_overlap("states", "_states")).drop("_core", "_states")


def document_contacts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int | None = 60, n: int | None = 5, deny: str = r"@(sec|finra)\.|\.gov$") -> DataFrame:
    """(doc, kind, value, place, context) of the first emails and phones of a cover page with their line.

    The cover page is the document's first lines; that limit is the operator's meaning. None for ``lines``
    reads whole documents, None for ``n`` gives all.
    """
    whole = F.split(F.col(text), "\n")
    rows = docs.select(F.col(doc_id).alias("doc"), F.posexplode(whole if lines is None else F.slice(whole, 1, lines)).alias("line", "context"))
    mail = F.transform(emails_in(F.col("context")), lambda e: F.struct(F.lit("email").alias("kind"), e.alias("value")))
    call = F.transform(F.regexp_extract_all("context", F.lit(f"({_PHONE})"), F.lit(1)), lambda p: F.struct(F.lit("phone").alias("kind"), F.regexp_replace(p, "[^0-9]", "").alias("value")))
    found = rows.select("doc", "line", cap_words(F.col("context"), 30).alias("context"), F.inline(F.concat(mail, call))).filter(~F.col("value").rlike(deny))
    first = found.groupBy("doc", "kind", "value").agg(F.min(F.struct("line", "context")).alias("_f"))
    place = F.row_number().over(Window.partitionBy("doc", "kind").orderBy("_f.line", "value"))
    placed = first.withColumn("place", place)
    return (placed if n is None else placed.filter(F.col("place") <= n)).select("doc", "kind", "value", "place", F.col("_f.context").alias("context"))


def source_counts(records: DataFrame, source: str, *flags: tuple[str, Column]) -> DataFrame:
    """Records of each source, and those with each of some properties."""
    return records.groupBy(source).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in flags))


def settle_shared(hits: DataFrame, org: str, person: str, value: str, main: DataFrame, chrome: Column, personal: Column) -> DataFrame:
    """Hits with level org or person: a value beside two people, in the page's frame, or equal to the main line is the org's; ``personal`` ones never."""
    shared = hits.groupBy(org, value).agg(F.countDistinct(person).alias("_n")).withColumnsRenamed({org: "_o", value: "_v"})
    lines = main.select(F.col(org).alias("_mo"), F.col(value).alias("_mv")).distinct()
    j = hits.join(shared, (F.col(org) == F.col("_o")) & (F.col(value) == F.col("_v"))).join(lines, (F.col(org) == F.col("_mo")) & (F.col(value) == F.col("_mv")), "left")
    of_org = ((F.col("_n") >= 2) | chrome | F.col("_mv").isNotNull()) & ~personal
    return j.withColumn("level", F.when(of_org, "org").otherwise("person")).select(*hits.columns, "level")


def attribute_leftovers(addresses: DataFrame, people: DataFrame, org: str, address: str) -> DataFrame:
    """(org, address, person) of addresses that fit exactly one person of the org by some convention."""
    from .resolve import local_part_patterns

    forms = people.select(F.col(org).alias("_o"), "person", F.explode(F.array_distinct(F.array(*local_part_patterns(F.col("first"), F.col("last")).values()))).alias("_l")).distinct()
    met = addresses.join(forms, (F.col(org) == F.col("_o")) & (F.lower(F.split_part(F.col(address), F.lit("@"), F.lit(1))) == F.col("_l")))
    return met.groupBy(org, address).agg(F.min("person").alias("person"), F.countDistinct("person").alias("_n")).filter("_n = 1").drop("_n")


def consolidate_pages(hits: DataFrame, org: str, person: str, rank: str, columns: Sequence[str]) -> DataFrame:
    """One row for each (org, person) with the best value of each column over all pages, by rank, then by value."""
    best = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(rank, c))).alias(c) for c in columns]
    return hits.groupBy(org, person).agg(*best)


def org_profile(pages: DataFrame, org: str, slug: str, keys: Column, chrome: Column) -> DataFrame:
    """(org, profile): the only one, else those that carry the org's name, else the one in the page's frame; more than two left is none."""
    rows = pages.select(org, slug, keys.alias("named"), chrome.alias("framed")).distinct()
    by = rows.groupBy(org).agg(F.count_distinct(slug).alias("n"), F.count_if("named").alias("n_named"), F.min(F.when(F.col("named"), F.col(slug))).alias("p_named"), F.count_if("framed").alias("n_framed"), F.min(F.when(F.col("framed"), F.col(slug))).alias("p_framed"), F.min(slug).alias("p"))
    pick = F.when(F.col("n") == 1, F.col("p")).when(F.col("n_named").between(1, 2), F.col("p_named")).when(F.col("n_framed") == 1, F.col("p_framed"))
    return by.withColumn("profile", pick).filter(F.col("profile").isNotNull()).select(org, "profile")


def posting_lifecycle(old: DataFrame, seen: DataFrame, reads: DataFrame, as_of: Column, key: Sequence[str], source: str) -> DataFrame:
    """Postings with first_seen, last_seen and closed after a read: those of a source read well and not seen again are closed.

    ``reads`` has the source and whether the read was ok; an unreachable source changes nothing.
    """
    ok = reads.filter("ok").select(F.col(source).alias("_s")).distinct()
    n = seen.select(*(F.col(k).alias(f"_{k}") for k in key), F.col(source).alias("_source")).distinct()
    j = old.join(n, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key] + [F.col(source) == F.col("_source")], "full")
    full = j.withColumn(source, F.coalesce(source, "_source")).withColumns({k: F.coalesce(k, f"_{k}") for k in key})
    marked = full.join(ok, F.col(source) == F.col("_s"), "left")
    again = F.col("_source").isNotNull()
    closed = F.when(again, F.lit(False)).when(F.col("_s").isNotNull(), F.lit(True)).otherwise(F.coalesce("closed", F.lit(False)))
    return marked.select(*key, source, F.coalesce("first_seen", as_of).alias("first_seen"), F.when(again, as_of).otherwise(F.col("last_seen")).alias("last_seen"), closed.alias("closed"))
