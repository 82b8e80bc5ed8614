"""The text functions once more, as SQL for the checking engine."""

from __future__ import annotations

from quireflow.functions import text as T


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def tokens(text: str, pattern: str = T.PLAIN_TOKEN) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), {lit('(' + pattern + ')')}, 1), lambda t: lower(t))"


def distinct(items: str) -> str:
    """Distinct items in order."""
    return f"list_filter({items}, lambda t, i: list_position({items}, t) = i)"


def search_terms(text: str, stopwords=T.TEXT_STOPWORDS) -> str:
    found = tokens(text)
    kept = f"list_filter({found}, lambda t: NOT list_contains({words(stopwords)}, t) AND (length(t) > 1 OR regexp_matches(t, '^[0-9]$')))"
    return distinct(f"(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {found} END)")


def stem(t: str) -> str:
    return (
        f"(CASE WHEN length({t}) > 5 AND {t} LIKE '%ing' THEN left({t}, length({t}) - 3) WHEN length({t}) > 4 AND {t} LIKE '%ed' THEN left({t}, length({t}) - 2) "
        f"WHEN length({t}) > 4 AND {t} LIKE '%es' THEN left({t}, length({t}) - 2) WHEN length({t}) > 3 AND {t} LIKE '%s' THEN left({t}, length({t}) - 1) ELSE {t} END)"
    )


def answer_terms(text: str) -> str:
    stems = f"list_transform({tokens(text, T.JOINED_TOKEN)}, lambda u: {stem('u')})"
    return f"list_distinct(list_filter({stems}, lambda v: NOT list_contains({words(T.ANSWER_STOPWORDS)}, v) AND length(v) > 1))"


def plain_terms(text: str, stopwords, pattern: str = T.PLAIN_TOKEN) -> str:
    return f"list_distinct(list_filter({tokens(text, pattern)}, lambda v: NOT list_contains({words(stopwords)}, v) AND length(v) > 1))"


def coverage(wanted: str, had: str) -> str:
    return f"(CASE WHEN len({wanted}) > 0 THEN len(list_intersect({wanted}, {had})) / len({wanted}) ELSE 0.0 END)"


def compact(text: str, limit: int, mark: str = "...", collapse: bool = True) -> str:
    value = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))" if collapse else f"trim({text}, ' ' || chr(9) || chr(13) || chr(10))"
    head = f"left({value}, {limit})"
    return f"(CASE WHEN length({value}) <= {limit} THEN {value} ELSE rtrim(CASE WHEN contains({head}, ' ') THEN regexp_replace({head}, '(?s)^(.*) .*$', '\\1') ELSE {head} END) || {lit(mark)} END)"


def chunk_kind(text: str) -> str:
    return f"(CASE WHEN regexp_extract({text}, {lit(T.SAFETY)}, 1) <> '' THEN lower(regexp_extract({text}, {lit(T.SAFETY)}, 1)) WHEN regexp_matches({text}, {lit(T.NUMBERED)}) THEN 'steps' ELSE 'text' END)"


def section_label(path: str) -> str:
    return f"(CASE WHEN len({path}) > 0 THEN trim({path}[-1]) ELSE 'Unsectioned evidence' END)"


def component_label(path: str) -> str:
    bare = f"trim(regexp_replace(regexp_replace({section_label(path)}, {lit(T.VARIANT_SUFFIX)}, ''), {lit(T.ACTION_PREFIX)}, ''), ' -:')"
    return f"(CASE WHEN {bare} <> '' THEN {bare} ELSE {section_label(path)} END)"


def metadata_text(p: str = "") -> str:
    variants = f"array_to_string(list_sort(list_distinct([{p}model, replace({p}model, '-', ' '), replace({p}model, '-', ''), replace({p}model, ' ', '')])), ' ')"
    return f"concat_ws(' ', {p}brand, {variants}, {p}year, {p}region, {p}language, replace({p}manual_type, '_', ' '), replace({p}doc_id, '_', ' '))"


def page_label(pages: str) -> str:
    return f"(CASE WHEN len({pages}) = 1 THEN list_min({pages})::VARCHAR ELSE list_min({pages}) || '–' || list_max({pages}) END)"


def source_label(path: str, pages: str, p: str = "") -> str:
    return f"{p}brand || ' ' || {p}model || ' Owner''s Manual (' || {p}year || '), ' || array_to_string({path}, ' > ') || ', physical PDF p.' || {page_label(pages)}"


def first(table: str, key: str, columns: str) -> str:
    """First arrivals of a table; ties go to the smallest values."""
    return f"(SELECT {columns} FROM {table} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at, brand, model, year, region, language) = 1)"
