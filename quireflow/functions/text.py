"""Tokens, terms, labels and patterns as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: words that carry no meaning, for each kind of search -------------------------------------------

TEXT_STOPWORDS = (
    "a an and are as at be by can do does for from how i if in is it my of on or should the to what when where which "
    "with you your"
).split()
TABLE_STOPWORDS = "a an and are do does for from how i in is it of on or the to what when where which with".split()
ANSWER_STOPWORDS = "a an and are do does for from how i in is it my of on should the to use what when where which with".split()
TABLE_ANSWER_STOPWORDS = "a an and are do does for from how i in is it much of on or should the to what when where which with".split()
GRAPH_STOPWORDS = "a an and are as at be by do does for from how i if in is it my of on or the to what when where which with you your".split()

# --- Fixed values: patterns, for regular expression engines without look-around ------------------------------------

PLAIN_TOKEN = "[A-Za-z0-9]+"
JOINED_TOKEN = "[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
SAFETY = r"(?i)^\s*(WARNING|CAUTION|NOTE)\s*:"
NUMBERED = r"(?i)^\s*(?:STEP\s+)?\d+[.)]\s+"
STEP_LINE = r"(?i)^\s*(?:step\s+)?(\d+)[.)]\s+(.+?)\s*$"
PROCEDURE_QUERY = r"(?i)^\s*(?:how\s+(?:do|can|should)\b|which\s+tools?\b|what\s+steps?\b)"
PROCEDURE_CONTENT = (
    r"(?i)(?:^|\n)\s*(?:\d+[.)]|step\s+\d+)\s+|(?:^|[.!?]\s+)(?:open|press|remove|install|select|pull|push|turn|unlock|lock|"
    r"move|connect|disconnect|insert|lift|lower|check|make sure|use)\b"
)
PROCEDURE_SECTION = r"(?i)\b(?:adjusting|enabling|installing|opening|removing|replacing|switching|using)\b"
ROUTE_TABLE = (
    r"(?i)\b(?:capacity|specification|specifications|torque|pressure|how many|how much|weight|load|voltage|fluid|gallon|"
    r"liter|litre|lb|kg|nm|n-m|psi)\b"
)
ROUTE_GRAPH = (
    r"(?i)\b(?:and then|before|after|requires?|steps?|procedure|warning|caution|symbol|indicator|means?|related|shown|"
    r"illustrated|what happens|how does)\b"
)
ROUTE_PROCEDURE = (
    r"(?i)^\s*(?:how|which tools?|what steps?|where)\b|\b(?:adjust|open|close|remove|install|replace|switch|reset|connect|"
    r"disconnect|charge|start|stop|lock|unlock)\b"
)
ROUTE_CLAUSES = r"(?i)\b(?:and|then|also|before|after)\b"
ACTION = (
    r"(?i)\b(?:adjust(?:ing)?|charg(?:e|ing)|check(?:ing)?|clos(?:e|ing)|connect(?:ing)?|disconnect(?:ing)?|fasten(?:ing)?|"
    r"install(?:ing)?|locat(?:e|ing)|lock(?:ing)?|open(?:ing)?|operat(?:e|ing)|program(?:ming)?|remov(?:e|ing)|"
    r"replac(?:e|ing)|reset(?:ting)?|select(?:ing)?|set(?:ting)?|start(?:ing)?|stop(?:ping)?|switch(?:ing)?|"
    r"unlock(?:ing)?|using)\b"
)
SPECIFICATION = r"(?i)\b(?:capacity|capacities|specification|specifications|torque|pressure|dimension|fluid|weight|load|voltage|amperage)\b"
SYMBOL = r"(?i)\b(?:symbol|symbols|indicator|indicators|warning light|tell-?tale)\b"
ACTION_PREFIX = (
    r"(?i)^(?:how (?:do|does) |what is |adjusting |charging |checking |closing |connecting |disconnecting |"
    r"fastening and unfastening |identifying |installing |locating |locking and unlocking |opening |operating |programming |"
    r"removing and installing |removing |replacing |resetting |selecting |setting |starting and stopping |starting |"
    r"stopping |switching |unlocking |using )"
)
VARIANT_SUFFIX = r"(?i)\s*-\s*(?:vehicles?|excluding|including|with|without)\b.*$"

# ---------------------------------------------------------------------------------------------------------------------


def words_of(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column, pattern: str) -> Column:
    """All matches, extracted first and lowered after, as letters outside ASCII part tokens. No pattern here matches a
    space, so joining and splitting at spaces lowers all at once, inside generated code."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1)
    return F.array_remove(F.split(F.lower(F.array_join(found, " ")), " "), F.lit(""))


def search_terms(query: Column, stopwords: Iterable[str] = TEXT_STOPWORDS) -> Column:
    """Distinct terms of a query, in order: without stopwords and single letters, or all tokens if none is left."""
    found = tokens(query, PLAIN_TOKEN)
    kept = F.filter(found, lambda t: ~F.array_contains(words_of(stopwords), t) & ((F.length(t) > 1) | t.rlike("^[0-9]$")))
    return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(found))


def query_words(query: str, stopwords: Iterable[str] = TEXT_STOPWORDS) -> list[str]:
    """``search_terms`` of one query, outside a plan."""
    found = [t.lower() for t in re.findall(PLAIN_TOKEN, query)]
    kept = [t for t in found if t not in stopwords and (len(t) > 1 or t.isdigit())]
    return list(dict.fromkeys(kept or found))


def match_expression(query: Column, stopwords: Iterable[str] = TEXT_STOPWORDS) -> Column:
    """The terms as quoted alternatives; null if there is none."""
    terms = search_terms(query, stopwords)
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def dense_words(text: Column) -> Column:
    """The words dense terms are made of."""
    return F.filter(tokens(text, PLAIN_TOKEN), lambda t: ~F.array_contains(words_of(TEXT_STOPWORDS), t) & ((F.length(t) > 1) | t.rlike("^[0-9]$")))


def with_pairs(kept: Column) -> Column:
    """Words, then pairs of neighbours among them. Give a column, not an expression, as it is read several times."""
    size = F.size(kept)
    pairs = F.zip_with(F.slice(kept, 1, F.greatest(size - 1, F.lit(0))), F.slice(kept, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.when(size > 1, F.concat(kept, pairs)).otherwise(kept)


def dense_terms(text: Column) -> Column:
    """Filtered single terms, then pairs of neighbours among them."""
    return with_pairs(dense_words(text))


def stem(token: Column) -> Column:
    """ing, ed, es or s cut off; the first ending that fits, if enough is left."""
    t, n = F.lower(token), F.length(token)
    return (
        F.when((n > 5) & t.endswith("ing"), F.left(t, n - 3))
        .when((n > 4) & t.endswith("ed"), F.left(t, n - 2))
        .when((n > 4) & t.endswith("es"), F.left(t, n - 2))
        .when((n > 3) & t.endswith("s"), F.left(t, n - 1))
        .otherwise(t)
    )


def answer_terms(text: Column) -> Column:
    """Distinct stems of more than one letter that are no stopwords."""
    stems = F.transform(F.array_distinct(tokens(text, JOINED_TOKEN)), stem)
    return F.array_except(F.filter(stems, lambda t: F.length(t) > 1), words_of(ANSWER_STOPWORDS))


def plain_terms(text: Column, stopwords: Iterable[str], pattern: str = PLAIN_TOKEN) -> Column:
    return F.filter(F.array_except(tokens(text, pattern), words_of(stopwords)), lambda t: F.length(t) > 1)


def coverage(wanted: Column, had: Column) -> Column:
    """Share of the wanted terms that are there; 0 if none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, had)) / F.size(wanted)).otherwise(F.lit(0.0))


def compact(text: Column, limit: int, mark: str = "...", collapse: bool = True) -> Column:
    """At most ``limit`` characters, cut before the last space, with a mark where cut."""
    value = F.btrim(F.regexp_replace(text, r"\s+", " ")) if collapse else F.btrim(text, F.lit(" \t\r\n"))
    head = F.left(value, F.lit(limit))
    whole = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r"(?s)^(.*) .*$", "$1")).otherwise(head)
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.rtrim(whole), F.lit(mark)))


def chunk_kind(content: Column) -> Column:
    safety = F.lower(F.regexp_extract(content, SAFETY, 1))
    return F.when(safety != "", safety).when(content.rlike(NUMBERED), F.lit("steps")).otherwise(F.lit("text"))


def section_text(path: Column) -> Column:
    return F.array_join(path, " > ")


def section_label(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.btrim(F.element_at(path, -1))).otherwise(F.lit("Unsectioned evidence"))


def component_label(path: Column) -> Column:
    label = section_label(path)
    bare = F.btrim(F.regexp_replace(F.regexp_replace(label, VARIANT_SUFFIX, ""), ACTION_PREFIX, ""), F.lit(" -:"))
    return F.when(bare != "", bare).otherwise(label)


def model_variants(model: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array(model, F.replace(model, F.lit("-"), F.lit(" ")), F.replace(model, F.lit("-"), F.lit("")), F.replace(model, F.lit(" "), F.lit("")))))


def metadata_text(prefix: str = "") -> Column:
    """Names of the vehicle and the manual as one searches for them."""
    c = lambda n: F.col(prefix + n)
    spaced = lambda n: F.replace(c(n), F.lit("_"), F.lit(" "))
    return F.concat_ws(" ", c("brand"), F.array_join(model_variants(c("model")), " "), c("year"), c("region"), c("language"), spaced("manual_type"), spaced("doc_id"))


def page_label(pages: Column) -> Column:
    """One page, or first and last with an en dash."""
    low, high = F.array_min(pages).cast("string"), F.array_max(pages).cast("string")
    return F.when(F.size(pages) == 1, low).otherwise(F.concat(low, F.lit("–"), high))


def source_label(path: Column, pages: Column) -> Column:
    return F.concat(F.col("brand"), F.lit(" "), F.col("model"), F.lit(" Owner's Manual ("), F.col("year"), F.lit("), "), section_text(path), F.lit(", physical PDF p."), page_label(pages))


def graph_source_label(path: Column, pages: Column) -> Column:
    """As ``source_label``, with all pages parted by commas; without pages nothing is said of them."""
    listed = F.when(F.size(pages) > 0, F.concat(F.lit(", physical PDF p."), F.array_join(F.transform(pages, lambda p: p.cast("string")), ","))).otherwise("")
    return F.concat(F.col("brand"), F.lit(" "), F.col("model"), F.lit(" Owner's Manual ("), F.col("year"), F.lit("), "), section_text(path), listed)


def is_procedural(query: Column) -> Column:
    return query.rlike(PROCEDURE_QUERY)


def supports_procedure(kind: Column, path: Column, content: Column) -> Column:
    return (kind == "steps") | content.rlike(PROCEDURE_CONTENT) | F.array_join(path, " ").rlike(PROCEDURE_SECTION)


def steps_of(content: Column, force: Column) -> Column:
    """Texts of the numbered lines by number (equal numbers in order), at most 20; without any and if forced, the
    non-blank lines without bullets when there are 1 to 20, else the compacted whole; else none."""
    lines = F.split(content, r"\r\n|\n|\r")
    numbered = F.filter(
        F.transform(lines, lambda s, i: F.struct(F.regexp_extract(s, STEP_LINE, 1).alias("n"), i.alias("i"), F.btrim(F.regexp_extract(s, STEP_LINE, 2)).alias("s"))),
        lambda x: x["n"] != "",
    )
    ordered = F.array_sort(F.transform(numbered, lambda x: F.struct(x["n"].cast("bigint").alias("n"), x["i"].alias("i"), x["s"].alias("s"))))
    picked = F.filter(F.transform(F.slice(ordered, 1, 20), lambda x: x["s"]), lambda s: s != "")
    bare = F.transform(F.filter(lines, lambda s: F.btrim(s, F.lit(" \t")) != ""), lambda s: F.btrim(F.regexp_replace(s, "^\\s*[-*•]\\s*", "")))
    whole = F.when(F.btrim(content) != "", F.array(compact(content, 500))).otherwise(F.array().cast("array<string>"))
    forced = F.when((F.size(bare) >= 1) & (F.size(bare) <= 20), bare).otherwise(whole)
    return F.when(F.size(numbered) > 0, picked).when(force, forced).otherwise(F.array().cast("array<string>"))


def citations_valid(answer: Column, n_evidence: Column, refusal: str) -> Column:
    """At least one [n], and every n a piece of evidence; a refusal's exact text passes."""
    cited = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda c: c.cast("int"))
    fine = (F.size(cited) > 0) & F.forall(cited, lambda c: (c >= 1) & (c <= n_evidence))
    return fine | (F.btrim(answer) == refusal)


def hybrid_conflict(section: Column, query: Column) -> Column:
    s, q = F.lower(section), F.lower(query)
    return F.contains(s, F.lit("excluding")) & F.contains(s, F.lit("hybrid")) & F.contains(q, F.lit("hybrid")) & ~q.rlike(r"\b(?:non[- ]hybrid|excluding\s+(?:the\s+)?hybrid)\b")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:hex20 of the SHA-256 of the parts as a JSON list of strings."""
    quoted = [F.to_json(F.array(p.cast("string"))) for p in parts]
    inner = F.concat_ws(",", *[F.substring(q, 2, 1_000_000_000).substr(F.lit(1), F.length(q) - 2) for q in quoted])
    return F.concat(F.lit(prefix + ":"), F.left(F.sha2(F.concat(F.lit("["), inner, F.lit("]")), 256), F.lit(20)))
