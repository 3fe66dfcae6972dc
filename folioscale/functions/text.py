"""Scalar functions on bibliographic text, as Spark columns.

Everything runs in the JVM except the NFKD step of `normalize`, which Spark
does not offer: it is one Arrow-batched function that only sees texts with
characters outside ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words passed over when the first word of a title is taken.
STOP_WORDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or",
    "is", "are", "was", "were", "be", "been", "by", "with", "from",
    "as", "into", "through", "during", "before", "after", "between",
    "how", "what", "when", "where", "which", "who", "whom", "why",
    "do", "does", "did", "has", "have", "had", "can", "could",
    "will", "would", "shall", "should", "may", "might", "must",
    "not", "no", "nor", "but", "if", "then", "than", "so",
    "its", "it", "this", "that", "these", "those",
)
#: Small Chinese words passed over likewise.
CJK_STOP = "的了是在有和与及其对从以为被把将而也都能要不"
#: Authors that stand for none.
PLACEHOLDER_AUTHORS = ("unknown", "unk", "n/a", "na", "tbd", "anon", "anonymous", "")
CJK = r"[\x{4e00}-\x{9fff}]"
#: What a record without a value carries.
_BLANKS = r"^[\s\x{3000}]+|[\s\x{3000}]+$"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


@F.pandas_udf(T.StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFKD", text), na_action="ignore")


def strip(column: Column | str) -> Column:
    """Blanks of any width removed at both ends."""
    return F.regexp_replace(_c(column), _BLANKS, "")


def normalize(column: Column | str) -> Column:
    """Lower case, decomposed, with anything but letters, digits and _ as single blanks. Null gives null."""
    low = strip(F.lower(_c(column)))
    wide = low.rlike(r"[^\x00-\x7f]")
    flat = F.when(wide, _nfkd(F.when(wide, low))).otherwise(low)
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"[^\p{L}\p{N}_\s]", " "), r"[\s\x{3000}]+", " "))


def lead_author(column: Column | str) -> Column:
    """The author before the first comma or semicolon, lower case; null counts as empty."""
    return strip(F.lower(F.split(F.split(F.coalesce(_c(column), F.lit("")), ",")[0], ";")[0]))


def dedup_key(author: Column | str, year: Column | str, title: Column | str, length: int) -> Column:
    """author|year|title, the title normalised and cut to `length` (80 when screening, 40 in the pool)."""
    return F.concat_ws("|", lead_author(author), F.coalesce(_c(year).cast("string"), F.lit("")), F.left(F.coalesce(normalize(title), F.lit("")), F.lit(length)))


def report_key(author: Column | str, year: Column | str, title: Column | str) -> Column:
    """author_year_title of reports, not normalised."""
    return F.concat_ws("_", F.lower(F.coalesce(_c(author), F.lit(""))), F.coalesce(_c(year).cast("string"), F.lit("")), F.lower(F.left(F.coalesce(_c(title), F.lit("")), F.lit(40))))


def has_cjk(column: Column | str) -> Column:
    """Whether there is a Chinese character; false for null."""
    return F.coalesce(_c(column).rlike(CJK), F.lit(False))


def source_type(declared: Column | str, *fields: Column | str) -> Column:
    """wos or cnki as declared, else by Chinese characters in the fields."""
    guess = F.lit(False)
    for field in fields:
        guess = guess | has_cjk(field)
    return F.when(_c(declared).isin("cnki", "wos"), _c(declared)).when(guess, "cnki").otherwise("wos")


#: Chinese surnames of two characters.
COMPOUND_SURNAMES = ("欧阳", "司马", "上官", "诸葛", "司徒", "令狐", "宇文", "长孙", "慕容", "皇甫", "东方", "端木", "公孙", "南宫", "独孤", "赫连")


def citation_key(author: Column | str, year: Column | str, title: Column | str, pinyin: dict[str, str] | None = None) -> Column:
    """Surname, year and first letter of the first content word.

    pinyin maps Chinese characters to their spelling. Of a character it does
    not have, a surname gives cn and its code point, and a title x.
    """
    raw = strip(F.split(F.split(F.coalesce(_c(author), F.lit("")), ",")[0], ";")[0])
    raw = strip(F.regexp_replace(raw, r"\s+[A-Z]\.?$", ""))
    latin = F.regexp_replace(F.lower(raw), r"[^a-z]", "")
    spelled = lambda char: F.try_element_at(F.create_map(*[F.lit(x) for pair in pinyin.items() for x in pair]), char) if pinyin else F.lit(None).cast("string")
    first, second = F.left(raw, F.lit(1)), F.substring(raw, 2, 1)
    own = F.coalesce(F.when(F.left(raw, F.lit(2)).isin(*COMPOUND_SURNAMES), F.concat(spelled(first), spelled(second))), spelled(first), F.concat(F.lit("cn"), F.lower(F.hex(F.ascii(raw)))))
    surname = F.when(raw.rlike(CJK), own).when(latin == "", "unknown").otherwise(latin)
    words = F.regexp_extract_all(F.lower(F.coalesce(_c(title), F.lit(""))), F.lit("([a-z]+)"), 1)
    content = F.filter(words, lambda word: ~word.isin(*STOP_WORDS))
    chinese = F.filter(F.split(F.coalesce(_c(title), F.lit("")), ""), lambda char: char.rlike(CJK) & ~F.lit(CJK_STOP).contains(char))
    initial = F.coalesce(F.left(F.get(content, F.lit(0)), F.lit(1)), F.left(F.get(words, F.lit(0)), F.lit(1)), F.left(spelled(F.get(chinese, F.lit(0))), F.lit(1)), F.lit("x"))
    return F.concat(surname, F.coalesce(_c(year).cast("string"), F.lit("")), initial)


def year_in(column: Column | str) -> Column:
    """The first year of the 20th or 21st century in a text, else empty."""
    return F.regexp_extract(F.coalesce(_c(column), F.lit("")), r"((?:19|20)\d{2})", 1)


def record_year(date: Column | str, issued: Column | str, url: Column | str, doi: Column | str) -> Column:
    """The year of a record: date, issue date, two places in the URL, DOI; the last two within 1900 to 2100."""
    pick = lambda column, pattern: F.nullif(F.regexp_extract(F.coalesce(_c(column), F.lit("")), pattern, 1), F.lit(""))
    within = lambda year: F.when(year.cast("int").between(1900, 2100), year)
    return F.coalesce(pick(date, r"(\d{4})"), pick(issued, r"(\d{4})"), pick(url, r"\.(\d{4})\d{4}\.\d+\.\d+$"), within(pick(url, r"/(\d{4})\d+\.\d+")), within(pick(doi, r"\.(\d{4})\d*\.")))


def pages(column: Column | str) -> Column:
    """struct(first, last) of a page range; last is empty if there is no dash."""
    parts = F.split(strip(column), "[-–—]", 2)
    return F.struct(strip(F.get(parts, F.lit(0))).alias("first"), F.coalesce(strip(F.get(parts, F.lit(1))), F.lit("")).alias("last"))


def keywords(column: Column | str) -> Column:
    """Keywords between semicolons of either width, without blanks and empty ones."""
    return F.filter(F.transform(F.split(_c(column), "[;；]"), strip), lambda word: word != "")


def quota_group(tag: Column | str) -> Column:
    """METHOD, GAP and DISC tags by their prefix, others as they are."""
    tag = _c(tag)
    return F.when(tag.startswith("METHOD"), "METHOD").when(tag.startswith("GAP"), "GAP").when(tag.startswith("DISC"), "DISC").otherwise(tag)


def stats_group(tag: Column | str) -> Column:
    """As quota_group, blanks aside, with all BG variants as BG."""
    tag = strip(tag)
    return F.when(tag.startswith("BG"), "BG").otherwise(quota_group(tag))


def pool_file(tag: Column | str) -> Column:
    """The pool file of a tag."""
    return F.concat(quota_group(tag), F.lit(".md"))


def grade(column: Column | str) -> Column:
    """Chinese grade of a spelling; others only without blanks."""
    key = F.lower(strip(column))
    return F.when(key.isin("核心", "core"), "核心").when(key.isin("重要", "important"), "重要").when(key.isin("备选", "backup"), "备选").otherwise(strip(column))


def short_name(column: Column | str) -> Column:
    """A name for files: parentheses dropped, unsafe characters as _, ten characters, else unknown."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(_c(column), F.lit("")), r"[（(][^）)]*[）)]", ""), r'[/\\:*?"<>|]', "_")
    short = strip(F.left(strip(flat), F.lit(10)))
    return F.when(short == "", "unknown").otherwise(short)


def table_cell(column: Column | str) -> Column:
    """Fit for a pipe table: | as /, line ends as blanks."""
    return F.regexp_replace(F.translate(F.coalesce(_c(column), F.lit("")), "|", "/"), r"\r?\n", " ")


def bibtex_escape(column: Column | str) -> Column:
    """& % # _ with a backslash."""
    return F.regexp_replace(_c(column), r"([&%#_])", r"\\$1")


def issn_list(column: Column | str) -> Column:
    """ISSNs in upper case without blanks and empty ones."""
    return F.filter(F.transform(_c(column), lambda x: F.upper(strip(x))), lambda x: x != "")


def zone(column: Column | str) -> Column:
    """The leading digit of a zone, else 9."""
    return F.coalesce(F.nullif(F.regexp_extract(strip(F.coalesce(_c(column), F.lit(""))), r"^(\d)", 1), F.lit("")).cast("int"), F.lit(9))


def answer_kept(column: Column | str) -> Column:
    """Whether a screening answer keeps a record: its label, then excluding before including words, else kept."""
    text = strip(F.coalesce(_c(column), F.lit("")))
    return F.when(text.startswith("1"), True).when(text.startswith("0"), False).when(text.rlike(r"不相关|无关|标注[为:：]?\s*0"), False).otherwise(True)


def decision(column: Column | str) -> Column:
    """The decision of a letter."""
    low = F.lower(F.coalesce(_c(column), F.lit("")))
    return (
        F.when(low.contains("major revision"), "Major Revision").when(low.contains("minor revision"), "Minor Revision")
        .when(low.contains("reject") & low.contains("resubmit"), "Reject & Resubmit").when(low.contains("reject"), "Reject").when(low.contains("accept"), "Accept").otherwise("Unknown")
    )


def section_form(column: Column | str) -> Column:
    """A section title for matching: & as and, numbering, articles and punctuation dropped."""
    low = F.regexp_replace(strip(F.lower(F.coalesce(_c(column), F.lit("")))), "&", "and")
    words = F.split(strip(F.regexp_replace(low, r"^\d+(\.\d+)*\.?\s*", "")), r"\s+")
    kept = F.array_join(F.filter(words, lambda word: ~word.isin("a", "an", "the")), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def rate_status(rate: Column) -> Column:
    """Sign of a rate in per cent: from 80 met, from 50 short, else missed."""
    return F.when(rate >= 80, "✅").when(rate >= 50, "⚠️").otherwise("❌")


def key_year_agrees(key: Column | str, year: Column | str) -> Column:
    """Whether the year in a citation key is that of its entry; null if either has none."""
    own = F.nullif(F.regexp_extract(F.coalesce(_c(key), F.lit("")), r"(\d{4})", 1), F.lit(""))
    return own == F.nullif(F.regexp_extract(F.coalesce(_c(year).cast("string"), F.lit("")), r"(\d{4})", 1), F.lit(""))


#: Words left out of short file names.
SLUG_STOP = tuple("a an the of in on for and or to with by from at is are was were be been its their this that these those as it not but into through between among using based via towards toward".split())


def slug(column: Column | str, words: int = 4, length: int = 40) -> Column:
    """The first content words in lower case joined by _."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(column), F.lit(""))), F.lit("([a-z]+)"), 1)
    return F.left(F.array_join(F.slice(F.filter(found, lambda word: ~word.isin(*SLUG_STOP)), 1, words), "_"), F.lit(length))


def difference_part(column: Column | str, markers: tuple[str, ...] = ("差异：", "差异:", "区别：", "区别:"), length: int = 120) -> Column:
    """The text after the first marker that occurs, else the whole, cut to a length."""
    text = F.coalesce(_c(column), F.lit(""))
    out = text
    for marker in reversed(markers):
        out = F.when(text.contains(marker), F.substring_index(text, marker, -1)).otherwise(out)
    return F.left(strip(out), F.lit(length))


def short_title(column: Column | str, length: int = 10) -> Column:
    """A title of few characters as it is, else its first clause that short; null if there is none."""
    title = strip(column)
    return F.when(F.length(title) <= length, title).otherwise(F.get(F.filter(F.split(title, r"[，。：；！？,.:;!?—-]+"), lambda part: (F.length(part) > 0) & (F.length(part) <= length)), F.lit(0)))


def doi(column: Column | str) -> Column:
    """A DOI without resolver and blanks; null if empty."""
    return F.nullif(F.regexp_replace(strip(_c(column)), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), F.lit(""))


def stem(column: Column | str) -> Column:
    """A RIS file name without the suffixes of screening."""
    return F.regexp_replace(_c(column), r"(_zone\d+)?(_llm)?\.ris$", "")


def content_mode(*columns: Column | str) -> Column:
    """The first content mode named, the columns in order of authority; null means the work must stop."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(_c(column), F.lit("")), r"(?:模式|mode)\s*[:：=]\s*(改写|展开|新增|重组)", 1), F.lit("")) for column in columns])


def idea_score(novelty: Column, contribution: Column, feasibility: Column) -> Column:
    """Weighted score of an idea, at most 25."""
    return 2 * novelty + 2 * contribution + feasibility


def review_score(novelty: Column, contribution: Column, feasibility: Column, timeliness: Column, presentation: Column) -> Column:
    """Weighted score of a review, at most 80."""
    return 2 * novelty + 2 * contribution + 1.5 * feasibility + timeliness + 1.5 * presentation


def volume_label(column: Column | str, default_date: str = "2026") -> Column:
    """Vol{n}_{Month_Year} of a volume heading, with unknown and a default date for what is missing."""
    text = F.coalesce(_c(column), F.lit(""))
    number = F.nullif(F.regexp_extract(text, r"[Vv]ol(?:ume)?\.?\s*(\d+)", 1), F.lit(""))
    date = F.nullif(F.regexp_extract(text, r"((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})", 1), F.lit(""))
    return F.concat(F.lit("Vol"), F.coalesce(number, F.lit("unknown")), F.lit("_"), F.coalesce(F.replace(date, F.lit(" "), F.lit("_")), F.lit(default_date)))


def palette(colours: Column | str, allowed: tuple[str, ...]) -> Column:
    """FULL, PARTIAL or NONE of the colours allowed; N/A without colours."""
    upper = F.array_distinct(F.transform(F.coalesce(_c(colours), F.array().cast("array<string>")), lambda x: F.upper(x)))
    hits = F.size(F.array_intersect(upper, F.array(*[F.lit(x.upper()) for x in allowed])))
    return F.when(F.size(upper) == 0, "N/A").when(hits == F.size(upper), "FULL").when(hits > 0, "PARTIAL").otherwise("NONE")
