"""Text audits by countable rules: sentences, paragraphs, phrases and patterns.

All of them are expressions over one document, so they need no shuffle but
for sums; rule tables are literal columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Connecting words, and the additive ones among them.
TRANSITIONS = r"(?i)\b(?:therefore|moreover|furthermore|additionally|meanwhile|hence|consequently|besides|in addition)\b"
ADDITIVE = r"(?i)\b(?:moreover|furthermore|additionally|besides|in addition)\b"
STUDY = r"(?:^|[.!?]\s+)This (?:study|paper|research)\b"
EXISTS = r"(?i)\bthere (?:is|are|was|were|exists?)\b"
FILLERS = r"(?i)\b(?:very|extremely|highly|greatly|basically|actually|essentially|obviously|clearly|certainly|indeed)\b"
RESPECTIVELY = r"(?i)\brespectively\b"
PASSIVE = r"(?i)\b(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?\w+(?:ed|en)\b"
BAD_START = r"^(?:\d|Fig\.)"
#: Chinese phrases and how often a chapter may have them.
PHRASE_CAPS = {"(?:已有|现有)研究表明": 2, "鲜有研究关注|较少有研究": 1, "丰富了[^，。]{0,20}理论体系": 1, "填补了[^，。]{0,20}空白": 0, "具有重要的(?:理论|实践)意义": 1, "研究发现": 2, "本文认为|本研究认为": 1, "此外|另外": 2, "综上所述": 1, "一方面": 2}
#: Frequent Chinese words that three paragraphs in a row should not all have.
FREQUENT = ("研究", "表明", "重要", "影响", "提出", "基于", "促进", "显著", "关注", "探讨")
#: What a manuscript must have, by pattern, and how bad its absence is.
STRUCTURE = [
    ("Abstract", r"\\begin\{abstract\}", "red"), ("Keywords", r"\\begin\{keyword\}|\\keywords", "red"), ("Introduction", r"(?i)\\section\*?\{Introduction", "red"), ("Conclusion", r"(?i)\\section\*?\{Conclusion", "red"),
    ("References", r"\\bibliography|\\begin\{thebibliography\}", "red"), ("Acknowledgments", r"(?i)\\section\*\{Acknowledg", "yellow"), ("Author contributions", r"(?i)CRediT|Author contribution", "yellow"), ("Declaration of interest", r"(?i)declaration|conflict", "yellow"),
]
#: Left-over marks of unfinished work.
RESIDUE = r"(?i)\btodo\b|XXX|FIXME|\bTBD\b|\\textcolor\{red\}|\?\?\?"
#: Groups of words that must not be published.
BLOCKLIST = {
    "privacy": "大学|学术|教师|老师|科研|学院|课题|讲师|副教授|学者|博士|论文|教授|研究方法",
    "workload": "凌晨[0-9]|深夜[0-9]|每天[0-9]+小时|[0-9]+ 个 skill|[0-9]+ 个项目|[0-9]+ 篇论文|每周[0-9]",
    "metrics": "SSCI|SCI|影响因子|引用量|项目编号|课题号|青基|国基|自科|社科",
    "platform": "推特|Twitter|X\\.com|YouTube|油管|Facebook|脸书|Instagram|Reddit|TikTok|Discord",
    "region": "台湾|台北|台中|台南|高雄|香港|澳门|新疆|西藏",
    "episode": "EP[0-9]+|S[0-9]+E[0-9]+|第[一二三四五六七八九十百0-9]+集|第[0-9]+期",
    "jargon": "杏仁核|amygdala|前额叶|cortisol|肾上腺素|多巴胺|serotonin|神经质|prefrontal|血清素|皮质醇|海马体|hippocampus",
}
#: Files each publisher wants.
PUBLISHER_FILES = {"elsevier": ("coverletter", "declaration", "highlights", "titlepage"), "asce": ("coverletter",), "emerald": ("coverletter", "titlepage"), "sage": ("coverletter",), "ieee": ("coverletter",), "wiley": ("coverletter", "titlepage")}


def sentences(text: Column) -> Column:
    """Sentences of a text, cut after . ! ? before blanks; without empty ones."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n"), lambda part: F.trim(part) != "")


def zh_sentences(text: Column) -> Column:
    return F.filter(F.split(text, "[。！？\n]"), lambda part: F.trim(part) != "")


def paragraphs(text: Column) -> Column:
    """Paragraphs: what stands between empty lines."""
    return F.filter(F.split(text, r"\n\s*\n"), lambda part: F.trim(part) != "")


def words(text: Column) -> Column:
    """Number of words between blanks."""
    return F.regexp_count(text, F.lit(r"\S+"))


def long_sentences(docs: DataFrame, text: str, most: int = 35) -> Column:
    return F.size(F.filter(sentences(F.col(text)), lambda s: words(s) > most)).cast("long")


def paragraph_flags(text: Column) -> dict[str, Column]:
    """Per document, how many paragraphs break each rule."""
    parts = paragraphs(text)
    over = lambda pattern, most: F.size(F.filter(parts, lambda p: F.regexp_count(p, F.lit(pattern)) > most)).cast("long")
    return {
        "em_dashes": over("---|—", 1), "transitions": over(TRANSITIONS, 2), "additive": over(ADDITIVE, 1), "study_subjects": over(STUDY, 2), "existential": over(EXISTS, 0), "fillers": over(FILLERS, 1), "respectively": over(RESPECTIVELY, 0),
    }


def passive_paragraphs(text: Column, most: float = 0.6) -> Column:
    """Paragraphs of which more than this share of sentences looks passive (a pattern, so an estimate)."""
    return F.size(F.filter(paragraphs(text), lambda p: F.size(F.filter(sentences(p), lambda s: s.rlike(PASSIVE))) > most * F.size(sentences(p)))).cast("long")


def phrase_excess(text: Column) -> Column:
    """struct array (phrase, n, cap) of the phrases above their caps."""
    rows = [F.struct(F.lit(phrase).alias("phrase"), F.regexp_count(text, F.lit(phrase)).alias("n"), F.lit(cap).alias("cap")) for phrase, cap in PHRASE_CAPS.items()]
    return F.filter(F.array(*rows), lambda row: row["n"] > row["cap"])


def missing_structure(text: Column) -> Column:
    """struct array (part, severity) of what a manuscript lacks."""
    rows = [F.when(~text.rlike(pattern), F.struct(F.lit(part).alias("part"), F.lit(severity).alias("severity"))) for part, pattern, severity in STRUCTURE]
    return F.array_compact(F.array(*rows))


def prevalence(share: Column, present: Column) -> Column:
    """What a feature's share among benchmark papers asks for if it is missing."""
    return F.when(present, "ok").when(share >= 0.6, "must fix").when(share >= 0.3, "strengthen").otherwise("pre-empt")


def within_budget(actual: Column, planned: Column, tolerance: float) -> Column:
    """Whether a word count keeps to its plan within a share; null without a plan."""
    return F.when(planned > 0, F.abs(actual / planned - 1) <= tolerance)


def missing_files(submissions: DataFrame, publisher: str, files: str) -> DataFrame:
    """Rows with the wanted files they lack."""
    table = F.create_map(*[x for name, wanted in PUBLISHER_FILES.items() for x in (F.lit(name), F.array(*[F.lit(w) for w in wanted]))])
    return submissions.withColumn("missing", F.array_except(F.coalesce(table[F.lower(F.col(publisher))], F.array().cast("array<string>")), F.coalesce(F.col(files), F.array().cast("array<string>"))))


def listed_words(lines: DataFrame, words: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, line_no, word): lines that hold a word of a list (column word); blank words and those after # are comments.

    The list is that of one run, a few hundred words, so it is held as a literal.
    """
    wanted = sorted({row.word.strip() for row in words.where("word is not null").select("word").distinct().collect()} - {""})
    wanted = [word for word in wanted if not word.startswith("#")]
    if not wanted:
        return lines.select(by, "line_no", F.lit("").alias("word")).where(F.lit(False))
    held = F.filter(F.array(*[F.lit(word) for word in wanted]), lambda word: F.contains("line", word))
    return lines.select(by, "line_no", F.explode(held).alias("word"))


#: Parts of a manuscript and the words each should have at least.
LEAST_WORDS = {"Conclusion": 150, "Abstract": 120}


def short_parts(parts: DataFrame, part: str, text: str) -> DataFrame:
    """Parts named in LEAST_WORDS with their words, whether these are too few, and whether marks of unfinished work are left."""
    least = F.create_map(*[F.lit(x) for pair in LEAST_WORDS.items() for x in pair])[F.col(part)]
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\\[A-Za-z]+\*?(?:\[[^\]]*\])*|[{}%]", " ")
    n = words(plain).cast("long")
    return parts.where(least.isNotNull()).withColumns({"words": n, "short": n < least, "unfinished": F.coalesce(F.col(text).rlike(RESIDUE), F.lit(False))})
