"""DuckDB SQL with the results of the queries, where SQL can express them."""

from __future__ import annotations

from functools import cache

from folioscale.llm import lookalikes

_RANK = "case lower(regexp_replace(tier, '^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g')) when 'core' then 0 when '核心' then 0 when 'important' then 1 when '重要' then 1 else 2 end"


def _form(column: str) -> str:
    return f"regexp_replace(lower(upper(nfc_normalize({column}))), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"


_P3 = f"""
with forms as (select paper_id, year, {_form('first_author')} a, {_form('title')} t from papers where year is not null),
keyed as (select paper_id, year, least(a, t) k1, greatest(a, t) k2 from forms where regexp_matches(a, '[\\p{{L}}\\p{{N}}]') and regexp_matches(t, '[\\p{{L}}\\p{{N}}]')),
grouped as (select paper_id, min(paper_id) over (partition by year, k1, k2) keep_id from keyed)
"""


def _trim(column: str) -> str:
    return f"regexp_replace(cast({column} as varchar), '^[\\s\\x{{3000}}\\x{{a0}}]+|[\\s\\x{{3000}}\\x{{a0}}]+$', '', 'g')"


def _filled(column: str) -> str:
    return f"coalesce({_trim(column)} not in ('', '—', '-', '无') and upper({_trim(column)}) <> 'N/A', false)"


_P4_ORDER = f"{_RANK}, direction nulls last, {' + '.join(f'{_filled(c)}::int' for c in ('title', 'first_author', 'year', 'journal', 'reason'))} desc, merged_at desc, rec_id"
_P4_LEADERS = f"leaders as (select dedup_key, rec_id, count(*) over (partition by dedup_key) n_rows, row_number() over (partition by dedup_key order by {_P4_ORDER}) rn from merged_papers where dedup_key is not null)"
_P4_FOUND = f"""
with {_P4_LEADERS},
vals as (select dedup_key, direction::bigint d from merged_papers union select dedup_key, unnest(directions)::bigint from merged_papers)
select dedup_key, rec_id, d as direction from leaders join vals using (dedup_key) where rn = 1 and n_rows > 1 and d is not null
"""


def _p4_survivors() -> str:
    fields = ("tier", "direction", "title", "first_author", "year", "journal", "reason", "source_type")
    tier = f"case when {_filled('tier')} then case {_RANK} when 0 then 'core' when 1 then 'important' else 'backup' end end"
    long = " union all ".join(f"select dedup_key, '{f}' field, {_trim('tier_name' if f == 'tier' else f)} v, w from base" for f in fields)
    picks = ", ".join(f"max(v) filter (field = '{f}') as {f}" for f in fields)
    return f"""
with {_P4_LEADERS},
base as (select *, row_number() over () rec_row, {tier} tier_name, (case lower(source_type) when 'cnki' then 0.9::double else 1.0::double end) * pow(2.0::double, (epoch_us(merged_at) / 86400e6::double - 19700.0::double) / 365.0::double) w from merged_papers where dedup_key is not null),
long as (select * from ({long}) where {_filled('v')}),
votes as (select dedup_key, field, v, round(log2(sum(w)), 9) s from long group by all),
named as (select distinct rec_row, dedup_key, d, w from (select rec_row, dedup_key, w, direction::bigint d from base union all select rec_row, dedup_key, w, unnest(directions)::bigint from base) where d is not null),
ranked as (select dedup_key, d, round(log2(sum(w)), 9) s from named group by all),
lists as (select dedup_key, list(d order by s desc, d) directions from ranked group by dedup_key),
won as (select *, row_number() over (partition by dedup_key, field order by s desc, v) rn from votes),
wide as (select dedup_key, {picks} from won where rn = 1 group by dedup_key)
select l.dedup_key, {', '.join(f'w.{f}' for f in fields)}, coalesce(ls.directions, []) directions, l.rec_id, l.n_rows from leaders l left join wide w using (dedup_key) left join lists ls using (dedup_key) where l.rn = 1
"""


@cache
def _p6() -> tuple[str, str]:
    """SQL of the classes and of the pairs. Characters are replaced one by one from the tables of the operator; only what has no accents to take apart."""
    source, target = lookalikes._punctuation()
    pairs = dict(zip(source + lookalikes.UNUSUAL_BLANKS, target + " " * len(lookalikes.UNUSUAL_BLANKS))) | lookalikes.LOOKALIKES
    longer = {}
    for code in range(0x80, 0x10000):
        char = chr(code)
        form = lookalikes.units(char)
        if char not in pairs and char.isalnum() and form != char and not lookalikes.unicodedata.decomposition(char)[:1].isalnum():
            if len(form) == 1:
                pairs[char] = lookalikes.reads_as(form)
            elif 2 <= len(form) <= 3 and "a" <= form[0] <= "z":
                longer[char] = form
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    hidden = "[\\x{ad}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{206f}\\x{feff}\\x{fe00}-\\x{fe0f}\\x{34f}]"

    def form_of(column: str) -> str:
        text = f"regexp_replace({column}, '{hidden}', '', 'g')"
        for char, form in longer.items():
            text = f"replace({text}, {quote(char)}, {quote(form)})"
        text = f"nfc_normalize(translate(nfc_normalize({text}), {quote(''.join(pairs))}, {quote(''.join(pairs.values()))}))"
        return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'), ' ')"

    stored = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')".format
    forms = f"with forms as (select paper_id, {form_of('title')} t, {form_of('first_author')} a, {stored('title')} st, {stored('first_author')} sa from papers where title is not null and first_author is not null)"
    classes = f"{forms}, c as (select t, a, min(paper_id) class_id, count(*) members, count(distinct (st, sa)) spellings from forms group by t, a) select paper_id, class_id, members, spellings from forms join c using (t, a) where spellings > 1"
    return classes, f"""{forms}
select x.paper_id as paper_id_a, y.paper_id as paper_id_b from forms x join forms y on x.t = y.t and x.a = y.a and x.paper_id < y.paper_id and (x.st <> y.st or x.sa <> y.sa)
"""


#: Words with a character each for links, markup and hash signs, their neighbours, and the PMI of these by counting all of them.
_P10 = r"""
with plain as (select row_number() over () as page, doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '(?:https?://|www\.)[^\s"''<>)\]，。；、]+', chr(1), 'g'), '<[^<>]{1,400}>', chr(2), 'g'), '#([^\s#\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}])', chr(3) || '\1', 'g') as t from documents where text is not null),
toks as (select page, doc_id, regexp_extract_all(t, '[㐀-鿿]|[\p{Latin}\p{Cyrillic}\p{Greek}\p{Hangul}\p{Nl}\p{No}]+(?:[''’-][\p{Latin}\p{Cyrillic}\p{Greek}\p{Hangul}\p{Nl}\p{No}]+)*|[\x01\x02\x03]') as w from plain),
words as (select unnest(w) as word from toks), one as (select word, count(*) as n from words group by word),
pairs as (select page, doc_id, unnest(list_zip(w[:-2], w[2:])) as p from toks where len(w) > 1),
flat as (select page, doc_id, p[1] as a, p[2] as b from pairs), two as (select a, b, count(*) as n from flat group by all),
own as (select page, doc_id, a, b, count(*) as times from flat group by all),
known as (select own.*, ln(two.n::double * (select sum(n) from one) / (select sum(n) from two) * (select sum(n) from one) / x.n / y.n) + ln(two.n / (two.n + 1.0::double) * (least(x.n, y.n) / (least(x.n, y.n) + 1.0::double))) as pmi
  from own join two using (a, b) join one x on x.word = a join one y on y.word = b)
select doc_id, round(sum(pmi * times) / sum(times), 5) as mean_pmi, round(sum(case when times >= 3 and pmi >= 2 then times else 0 end) / sum(times)::double, 5) as repeated from known group by page, doc_id
"""


def oracle() -> dict[str, str]:
    return {
        "p10_pmi": _P10,
        "p1_plan_totals": """
            select plan_id::bigint as plan_id, batch_limit, sum(item_count)::bigint as records, sum(ceil(item_count / batch_limit::double))::bigint as pieces,
                   sum(ceil(item_count / batch_limit::double) - 1)::bigint as further_pieces
            from dispatch_items where item_count > 0 and batch_limit > 0 and plan_id is not null group by 1, 2""",
        "p1_pieces": """
            select plan_id::bigint as plan_id, item_id::bigint as item_id, piece_no, (case when piece_no * batch_limit <= item_count then batch_limit else item_count % batch_limit end)::int as item_count
            from (select *, unnest(range(1, ceil(item_count / batch_limit::double)::bigint + 1)) as piece_no from dispatch_items where item_count > 0 and batch_limit > 0 and plan_id is not null)""",
        "p1_batch_checks": """
            select plan_id, batch_limit, sum(item_count)::bigint as records, count(distinct item_id) as items, 0::bigint as overfull, 0::bigint as gaps
            from dispatch_items where item_count > 0 and batch_limit > 0 and plan_id is not null group by all""",
        "p1_unpacked": """
            select * from (select plan_id, item_id, case when plan_id is null then 'no plan' when coalesce(batch_limit, 0) <= 0 then 'no limit' when coalesce(item_count, 0) <= 0 then 'empty' end as state
            from dispatch_items) where state is not null""",
        "p3_found": _P3 + "select keep_id, paper_id as copy_id from grouped where paper_id <> keep_id",
        "p3_records": _P3 + "select keep_id, count(*) as copies from grouped group by keep_id",
        "p4_found": _P4_FOUND,
        "p4_survivors": _p4_survivors(),
        "p6_classes": _p6()[0],
        "p6_found": _p6()[1],
        "p7_found": f"""
            select direction::bigint as direction, paper_id, rank_no from (select direction, paper_id, row_number() over (partition by direction
            order by {_RANK}, relevance desc nulls last, paper_id) as rank_no from papers where direction is not null) where rank_no <= 10""",
    }
