"""Pages of a site: the frame that its pages share, and phones and job titles outside of it.

A page is cut into fragments at block-level tags. A fragment that a good part of a site's pages have is the
site's frame, as is what stands in nav, header, footer and aside. The fragments of a site's frame number at
most the fragments of an average page divided by the share, so they travel as one array for each site.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core.frames import first_per_key

#: What no reader sees. No look-behind and no back-reference, so that other engines read the same patterns.
HIDDEN = "(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>|<template\\b[^>]*>.*?</template\\s*>"
#: Elements of a page's frame.
FRAMING = "(?is)<nav\\b[^>]*>.*?</nav\\s*>|<header\\b[^>]*>.*?</header\\s*>|<footer\\b[^>]*>.*?</footer\\s*>|<aside\\b[^>]*>.*?</aside\\s*>"
#: Tags at which a page is cut.
BLOCKS = "(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|section|table|tbody|td|th|title|tr|ul)\\b[^>]*>"


def site_of(url: Column) -> Column:
    """A page's host in lower case without www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def fragments(html: Column) -> Column:
    """The pieces between block-level tags, white space squeezed, blank ones left out."""
    return F.filter(F.transform(F.split(html, BLOCKS), lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: x != "")


def cut_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, site, body, framing): the fragments outside and inside framing elements; a null page has none."""
    seen = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HIDDEN, " ")
    outside = fragments(F.regexp_replace(seen, FRAMING, "<br>"))
    inside = F.flatten(F.transform(F.regexp_extract_all(seen, F.lit(FRAMING), F.lit(0)), fragments))
    return pages.select(page_id, site_of(F.col(url)).alias("site"), outside.alias("body"), inside.alias("framing"))


def site_frames(cut: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """(site, n_pages, frame): hashes of the body fragments that at least ``share`` of a site's pages have; only of sites of ``least`` pages."""
    marked = cut.filter(F.col("site").isNotNull()).select("site", F.array_distinct(F.transform("body", lambda x: F.xxhash64(x))).alias("h"))
    sizes = marked.groupBy("site").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least)
    counted = marked.select("site", F.explode("h").alias("h")).groupBy("site", "h").agg(F.count("*").alias("n"))
    often = counted.join(sizes, "site").filter(F.col("n") >= share * F.col("n_pages"))
    return often.groupBy("site").agg(F.max("n_pages").alias("n_pages"), F.sort_array(F.collect_list("h")).alias("frame"))


def split_frame(cut: DataFrame, frames: DataFrame) -> DataFrame:
    """``cut`` with the fragments of the site's frame moved from body to framing, in the order of the page."""
    joined = cut.join(frames.select(F.col("site").alias("_site"), "frame"), F.col("site") == F.col("_site"), "left").drop("_site")
    framed = lambda x: F.coalesce(F.array_contains("frame", F.xxhash64(x)), F.lit(False))
    moved = joined.withColumns({"_own": F.filter("body", lambda x: ~framed(x)), "_moved": F.filter("body", framed)})
    return moved.select(*(c for c in cut.columns if c not in ("body", "framing")), F.col("_own").alias("body"), F.concat("_moved", "framing").alias("framing"))


# --- phones ------------------------------------------------------------------------------------

_NUMBER = r"(?:\+?1[-. ]?)?\(?([2-9][0-9]{2})\)?[-. ]{1,2}([0-9]{3})[-. ]([0-9]{4})"
_EXTENSION = r"(?:\s*,?\s*(?:extension|ext\.?|x|#)\s*([0-9]{1,6}))?"
#: Words by a number and what they make it. Fixed values.
PHONE_WORDS = {
    "fax": ("fax", "facsimile"), "mobile": ("mobile", "cell", "cellular", "mob"), "direct": ("direct", "direct line", "dir", "desk"), "toll_free": ("toll free", "toll-free", "tollfree"),
    "main": ("main", "switchboard", "headquarters"), "office": ("office", "tel", "telephone", "phone", "ph", "work", "call"),
}
#: Letters before a colon, dot or bracket that stand for one of them. Fixed values.
PHONE_LETTERS = {"f": "fax", "m": "mobile", "c": "mobile", "d": "direct", "p": "office", "t": "office", "o": "office"}
#: The most specific first; a number without a label comes last. Fixed values.
PHONE_RANK = ("direct", "mobile", "toll_free", "office", "main")
#: Area codes that nobody pays for. Fixed values.
TOLL_FREE = ("800", "833", "844", "855", "866", "877", "888")


def _label(before: Column, after: Column) -> Column:
    """The label by the word that stands last before a number, else by the one right after it; null without one."""
    names = {w: label for label, words in PHONE_WORDS.items() for w in words}
    spoken = "|".join(sorted(names, key=len, reverse=True))
    at_end = F.regexp_extract(F.lower(before), rf"(?s)^.*(?:\b({spoken})\b|(?:^|[\s|,;(\[])([fmcdpto])\s*[:.)\]])", 0)
    word = F.regexp_extract(at_end, rf"\b({spoken})\b[^a-z]*$", 1)
    letter = F.regexp_extract(at_end, r"(?:^|[\s|,;(\[])([fmcdpto])\s*[:.)\]]$", 1)
    next_word = F.regexp_extract(F.lower(after), rf"^\s*[(\[]?\s*({spoken})\b", 1)

    def of(found: Column, table: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for key, label in table.items():
            out = F.when(found == key, label).otherwise(out)
        return out

    return F.coalesce(of(letter, PHONE_LETTERS), of(word, names), of(next_word, names))


def _ending(text: Column, n: int) -> Column:
    """The last n characters and the one before them, without the word that their limit cuts or touches."""
    return F.when(F.char_length(text) <= n, text).otherwise(F.regexp_replace(F.right(text, F.lit(n + 1)), r"^[\p{L}\p{M}\p{N}_]+", ""))


def _beginning(text: Column, n: int) -> Column:
    """The first n characters and the one behind them, without the word that their limit cuts or touches."""
    return F.when(F.char_length(text) <= n, text).otherwise(F.regexp_replace(F.left(text, F.lit(n + 1)), r"[\p{L}\p{M}\p{N}_]+$", ""))


def numbers_in(line: Column, toll_free: Sequence[str] = TOLL_FREE, whole: bool = True) -> Column:
    """[(number, extension, label)] of the numbers of the US form in a fragment; number has ten digits, extension and label may be null.

    A label's word is looked for in the 30 characters before a number, back to the number before, and in the 20 after it; a
    word that these limits cut is none. Numbers with one of the area codes ``toll_free`` have that label; ``whole`` leaves out numbers that more digits follow.
    """
    text = F.regexp_replace(F.regexp_replace(line, "(?i)href=[\"']tel:([^\"'?]+)[^\"']*[\"']", "> $1 <"), "<[^>]*>", " ")
    marked = F.split(F.regexp_replace(text, _NUMBER + _EXTENSION + ("(?![0-9])" if whole else ""), "\u0001$1$2$3;$4\u0002"), "\u0001")
    tail = lambda part: F.substring_index(part, "\u0002", -1)

    def one(part: Column, i: Column) -> Column:
        before, after = _ending(tail(F.get(marked, i)), 30), _beginning(tail(part), 20)
        head = F.substring_index(part, "\u0002", 1)
        number = F.substring_index(head, ";", 1)
        label = _label(before, after)
        label = F.when((label.isNull() | (label != "fax")) & F.substring(number, 1, 3).isin(*toll_free), "toll_free").otherwise(label)
        return F.struct(number.alias("number"), F.nullif(F.substring_index(head, ";", -1), F.lit("")).alias("extension"), label.alias("label"))

    return F.transform(F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))), one)


def site_phones(cut: DataFrame, page_id: str = "page_id", toll_free: Sequence[str] = TOLL_FREE, whole: bool = True) -> DataFrame:
    """(page_id, number, extension, label) of the numbers in a page's body, of pages as ``split_frame`` gives them.

    A number that is called a fax anywhere on the page is out, one with several labels keeps the most specific. A
    number with an extension is a person's own; the same number without it, on that page or in its frame, is the
    switchboard behind it and is left out, as are all other numbers of the frame. ``toll_free`` and ``whole`` as in ``numbers_in``.
    """
    found = lambda c: cut.select(page_id, F.explode(F.flatten(F.transform(c, lambda x: numbers_in(x, toll_free, whole)))).alias("p")).select(page_id, "p.*")
    rank = F.lit(len(PHONE_RANK))
    for i, label in enumerate(PHONE_RANK):
        rank = F.when(F.col("label") == label, i).otherwise(rank)
    here = found("body").withColumn("_rank", rank)
    fax = here.filter("label = 'fax'").select(page_id, "number", F.coalesce("extension", F.lit("")).alias("_x")).distinct()
    best = first_per_key(here.filter("label is null or label <> 'fax'").withColumn("_x", F.coalesce("extension", F.lit(""))), [page_id, "number", "_x"], [F.asc("_rank")]).join(fax, [page_id, "number", "_x"], "left_anti")
    behind = best.filter("_x <> ''").select(page_id, "number").union(found("framing").select(page_id, "number")).distinct()
    bare = best.filter("_x = ''").join(behind, [page_id, "number"], "left_anti")
    return bare.union(best.filter("_x <> ''")).select(page_id, "number", "extension", "label")


# --- job titles --------------------------------------------------------------------------------

#: Words that name a role, singular; most may have an s. Fixed values.
ROLES = (
    "advisor", "adviser", "planner", "paraplanner", "analyst", "associate", "assistant", "administrator", "manager", "trader", "accountant", "bookkeeper", "preparer", "director", "specialist",
    "coordinator", "intern", "internship", "officer", "engineer", "developer", "receptionist", "consultant", "representative", "controller", "strategist", "cfo", "coo", "cco", "cio", "cto", "head of",
    "vice president", "recruiter", "paralegal", "attorney", "counsel", "csa", "liaison", "generalist", "architect", "team lead", "lead",
)
#: Of these an s makes a word of its own or of no opening. Fixed values.
SINGULAR = ("cfo", "coo", "cco", "cio", "cto", "csa")
#: Of these a plural at the end names a kind of people. Fixed values.
PLURALS = ("advisor", "adviser", "planner", "paraplanner", "analyst", "associate", "assistant", "administrator", "manager", "trader", "accountant", "specialist", "coordinator", "intern", "internship", "officer", "engineer", "developer", "consultant", "representative", "strategist", "recruiter", "director")
#: Words of menus, benefits and pages that are no role. Fixed values.
NOT_ROLES = (
    "our team", "meet", "about us", "learn more", "apply now", "apply today", "benefits", "culture", "why join", "contact", "privacy", "cookie", "login", "log in", "sign in", "subscribe", "newsletter", "blog",
    "news", "insights", "services", "how we", "our story", "testimonials", "disclosure", "disclosures", "form adv", "read more", "view all", "see all", "back to", "board of", "leadership team", "management team",
    "our advisors", "for advisors", "lead generation", "securities offered", "advisory services", "financial professional", "financial professionals", "our people", "our staff", "bonus", "bonuses", "assistance",
    "reimbursement", "tuition", "paid time off", "pto", "holiday", "holidays", "parental leave", "perks", "wellness program", "opportunity", "opportunities",
    "find an advisor", "find an adviser", "become an advisor", "become a client", "registered representative of", "registered representatives of", "referral bonus", "referral program", "401k",
)
#: First words of a call to action or a sentence. Fixed values.
LEADS = (
    "we", "our", "you", "your", "join", "this", "the", "a", "an", "interested", "click", "email", "send", "to", "become", "search", "explore", "view", "find", "see", "browse", "learn", "discover", "apply", "meet",
    "work", "start", "build", "grow", "why", "how", "what", "who", "where", "when", "careers", "career", "current", "open", "all", "more", "about", "submit", "upload", "read", "get", "contact", "featured", "back", "return",
)
#: Small words of titles, the limits of a title's length, and what may stand before one. Fixed values.
JOINING = ("and", "of", "for", "to", "the", "in", "at", "on", "with", "a", "an", "or", "&")
SHORTEST, LONGEST = 6, 90
_BEFORE = r"(?i)^(spotlight|now hiring|hiring|new|featured|urgent|open role|opening)\s*[:|-]\s*"
#: Keys under which pages carry titles as data. Fixed values.
TITLE_KEYS = ("JobTitle", "jobTitle", "jobOpeningName", "PostingTitle", "postingTitle")


def is_title(text: Column) -> Column:
    """Whether a short text reads as the title of an opening."""
    low = F.lower(text)
    any_of = lambda words: rf"\b({'|'.join(words)})\b"
    word = F.split(text, " +")
    role = rf"\b(?:(?:{'|'.join(r for r in ROLES if r not in SINGULAR)})s?|{'|'.join(SINGULAR)})\b"
    person = F.regexp_extract(text, r"^[A-Z][a-z]+(?: [A-Z]\.?)? [A-Z][a-zA-Z'-]+(?:,| [-|] )", 0)
    small = F.filter(word, lambda w: w.rlike("^[a-z]") & ~w.isin(*JOINING))
    return (
        F.char_length(text).between(SHORTEST, LONGEST)
        & low.rlike(role)
        & ~low.rlike(any_of(NOT_ROLES))
        & ((person == "") | F.lower(person).rlike(role))
        & (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) <= 10)
        & ~text.rlike(r"[.:]$|[?!]|@|www\.")
        & ~low.contains("http")
        & ~low.rlike(rf"\b({'|'.join(PLURALS)})s\s*$")
        & ~text.rlike("[a-z]{3,}[A-Z][a-z]")
        & (F.size(small) < 3)
        & ~F.lower(F.get(word, F.lit(0))).isin(*LEADS)
        & ~low.rlike("^(if you|are you|life at)")
    )


def carried_titles(html: Column, keys: Sequence[str] = TITLE_KEYS) -> Column:
    """Titles that a page's scripts carry as data, escapes of JSON undone."""
    raw = F.regexp_extract_all(html, F.lit(rf'"(?:{"|".join(keys)})"\s*:\s*("(?:[^"\\]|\\.){{1,200}}")'), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.trim(F.regexp_replace(F.coalesce(F.try_variant_get(F.try_parse_json(x), "$", "string"), F.lit("")), "\\s+", " "))), is_title)


def site_roles(pages: DataFrame, cut: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, title, carried) of the openings that a page lists outside its frame, or carries as data; one row for a title in any case.

    ``cut`` are the pages as ``split_frame`` gives them; ``carried`` tells that a title is in the data only.
    """
    shown = F.transform("body", lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "\\s+", " ")), _BEFORE, ""))
    seen = cut.select(page_id, F.explode(F.filter(shown, is_title)).alias("title"), F.lit(False).alias("carried"))
    data = pages.select(page_id, F.explode(carried_titles(F.col(html))).alias("title"), F.lit(True).alias("carried"))
    each = seen.union(data).groupBy(page_id, F.lower("title").alias("_t")).agg(F.min(F.struct("carried", "title")).alias("b"))
    return each.select(page_id, "b.title", "b.carried")
