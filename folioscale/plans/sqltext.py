"""Pieces of DuckDB SQL that express the scalar functions."""

from __future__ import annotations

import unicodedata
from functools import cache

RANK = "case lower(regexp_replace(tier, '^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g')) when 'core' then 0 when '核心' then 0 when 'important' then 1 when '重要' then 1 else 2 end"


def strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g')"


@cache
def decomposed() -> tuple[str, str]:
    """Two SQL lists: characters outside ASCII, and their NFKD forms. Hangul is left out."""
    chars = [chr(code) for code in (*range(0xA0, 0x3400), *range(0xF900, 0xFFF0)) if unicodedata.category(chr(code)) not in ("Cn", "Co", "Cs")]
    pairs = [(char, unicodedata.normalize("NFKD", char)) for char in chars]
    pairs = [(char, form) for char, form in pairs if form != char]
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    return "[" + ", ".join(quote(char) for char, _ in pairs) + "]", "[" + ", ".join(quote(form) for _, form in pairs) + "]"


def nfkd_table() -> str:
    """A common table expression `nf` with the map `m` of decompositions."""
    chars, forms = decomposed()
    return f"nf as (select map({chars}, {forms}) m)"


def normalize(expression: str) -> str:
    """Of a query that also reads `nf`."""
    low = strip(f"lower({expression})")
    flat = f"array_to_string(list_transform(regexp_extract_all({low}, '(?s).'), lambda c: coalesce(m[c], c)), '')"
    return f"trim(regexp_replace(regexp_replace({flat}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '[\\s\\x{{3000}}]+', ' ', 'g'))"


def lead_author(expression: str) -> str:
    return strip(f"lower(split_part(split_part(coalesce({expression}, ''), ',', 1), ';', 1))")


def dedup_key(author: str, year: str, title: str, length: int) -> str:
    return f"concat_ws('|', {lead_author(author)}, coalesce(cast({year} as varchar), ''), left(coalesce({normalize(title)}, ''), {length}))"


def quota_group(tag: str) -> str:
    return f"case when {tag} like 'METHOD%' then 'METHOD' when {tag} like 'GAP%' then 'GAP' when {tag} like 'DISC%' then 'DISC' else {tag} end"


def stats_group(tag: str) -> str:
    return f"case when {strip(tag)} like 'BG%' then 'BG' else {quota_group(strip(tag))} end"


def is_cnki(*fields: str) -> str:
    return f"case when source_type in ('cnki', 'wos') then source_type = 'cnki' else {' or '.join(f'''coalesce(regexp_matches({f}, '[一-鿿]'), false)''' for f in fields)} end"


def screened(length: int = 80) -> str:
    """CTEs ending in `rows`: the screened records."""
    key = dedup_key("first_author", "year", "title", length)
    return f"{nfkd_table()}, rows as (select paper_id as ord, direction::bigint as direction, title, first_author, year, journal, {RANK} as rank, {is_cnki('title', 'first_author', 'journal')} as is_cnki, {key} as key from papers, nf where direction is not null)"


CITATION_KEY = """
case when regexp_matches(raw, '[一-鿿]') then 'cn' || lower(printf('%x', unicode(raw))) when regexp_replace(lower(raw), '[^a-z]', '', 'g') = '' then 'unknown' else regexp_replace(lower(raw), '[^a-z]', '', 'g') end
|| coalesce(cast(year as varchar), '') || coalesce(left(list_filter(words, lambda w: not list_contains(stop, w))[1], 1), left(words[1], 1), 'x')"""


#: Words passed over in titles, written out for the SQL.
_PASSED_OVER = "a an and are as at be been before between but by can could did do does during after for from had has have how if in into is it its may might must no nor not of on or shall should so than that the then these this those through to was were what when where which who whom why will with would"


def citation_keys(table: str, author: str, year: str, title: str, ident: str) -> str:
    """CTE `keyed` with (id, citation_key) of a table."""
    stop = f"string_split('{_PASSED_OVER}', ' ')"
    raw = strip(f"regexp_replace({strip(f'''split_part(split_part(coalesce({author}, ''), ',', 1), ';', 1)''')}, '\\s+[A-Z]\\.?$', '')")
    return f"parts as (select {ident} as id, {raw} as raw, {year} as year, regexp_extract_all(lower(coalesce({title}, '')), '[a-z]+') as words, {stop} as stop from {table}), keyed as (select id, {CITATION_KEY} as citation_key from parts)"
