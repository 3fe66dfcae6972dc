"""Template residue, filler, error pages and script notices in place of content.

Fields are cut into lines. All lines, with their digits masked, are counted by
the hosts they come from in one pre-aggregated pass; a form of words that makes
up a certain share of all lines and that no host has mostly to itself is
boilerplate and is subtracted. Both conditions are shares, so a line is judged
alike in a small and in a large table. The residual is searched for evidence:
placeholders left open, filler, messages of tools and sites, notices that
scripts are needed, and words of such messages that ordinary notes also use,
unless the line has a reference to a section, which an unfilled note lacks.
Since residue may recur as well, the distinct lines of boilerplate are searched
too, and those with unmistakable evidence (template syntax, tracebacks, status
pages) are protected from the subtraction. Keys are read by their form; a key
of no real form that several hosts have is residue too, since a key names one
work. (Keys of real form collide by chance, so their counts tell nothing.)
The words of filler are learned from the corpus: beside those of the well-known
passage, words are filler that are mostly found in company of its first two,
and a run of them is evidence, so invented Latin needs no list.

Defined results: null, blank and missing-value marks (—, -, N/A, 无) are no
evidence; a record is excluded once, whatever the number of its fields with
evidence; very long fields are searched whole.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.runtime import cut_lineage

#: A form of words is boilerplate if it makes up at least 1/RECURS of all lines (so at most RECURS are) ...
RECURS = 500
#: ... and no host has more than 1/SPREAD of its lines beyond the host's own share of all lines, and it was seen this often at least.
SPREAD = 8
#: A key of no real form is residue if at least this many hosts have it.
KEY_HOSTS = 2

#: Names of slots in templates.
SLOTS = r"(?:scen(?:e|ario)s?|usage|chapter|section(?:_no)?|claim(?:_text)?|title|author|surname|year|letter|key|cite_?key|bib_?key|citation_key|text|name|value|reason|[a-z]+[._][a-z._]+|row\[\d+\]|[^\s<>\[\]{}]*(?:章节|论点|观点|场景|填写|题名|引用键|文献键|此处)[^\s<>\[\]{}]*)"
#: Template syntax that is never content.
PLACEHOLDERS = [
    r"\{\{.*?\}\}", r"\{%.*?%\}", r"<%.*?%>", r"[$#]\{[^{}]*\}", r"@@[^@]+@@", r"%\([^()]+\)[sS]", r"«[^«»]+»", r"\\VAR\{",
    r"(?i)\[TODO\b[^\]]*\]", r"《请填写[^》]*》", r"(?<!\\[a-zA-Z]{1,20})\{\s*" + SLOTS + r"\s*\}", r"(?i)<\s*" + SLOTS + r"\s*>", r"(?i)\[\s*" + SLOTS + r"\s*\]",
    r"【[^】]*】", r"(?<![A-Za-z0-9])__[^_\s]{1,40}(?:_[^_\s]+)*__(?![A-Za-z])", r"%[A-Za-z\u4e00-\u9fff][\w.\[\]\u4e00-\u9fff]*%", r"_{4,}|第_+章",
    r"(?i)</?(?:div|span|p|br|noscript|script|html|body|td|li|ul|a|b|i|font|table)\b[^<>]*>|<!--|<!doctype|&nbsp;",
    r"(?<![A-Za-z])X{2,}(?![A-Za-z])(?=\s*(?:节|章|的|$|[，。；,;.]))|(?<![A-Za-z])[XN]\.[XN](?:\.[XN])?(?![A-Za-z])|第[？?Xx]+章|支撑X+|XXXX",
    r"（格式：|(?i:one sentence: where and why)|章节号 节",
]
#: Messages of tools and sites.
MESSAGES = [
    r"(?i)\b[45]\d\d\s+(?:not found|forbidden|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|unauthori[sz]ed|bad request)",
    r"(?i)\b(?:error|http)\s*[45]\d\d\b|internal server error|upstream connect error|too many requests|^access denied\W*$|access to this \w+ is denied",
    r"Traceback \(most recent|(?i:traceback \(most)|\b(?i:[a-z]\w*(?:error|exception)):|(?i)exception in thread|fatal error:|request timed out|api error|parse error at",
    r"(?i)your session at .* has expired|page cannot be found|could not find (?:that|the|this) page|(?:record|page|document) you (?:asked|requested|are looking)\b.*(?:does not exist|not found)",
    r"(?i)subscription required|(?:sign|log) in to .* to (?:read|view|continue)|down for maintenance|verify (?:that )?you are (?:a )?human|checking your browser|redirecting, please wait|^\W*loading(?:…|\.{3})",
    r"(?i)as requested, here is|as an ai\b|sure, here is|好的，我将|作为(?:一个)?AI",
    r"请求超时|页面不存在|不存在或已被移除|数据库连接失败|系统繁忙|会话已过期|请(?:先)?登录后|没有权限查看|完成安全验证|拖动滑块|页面加载中|维护中，暂停服务|解析失败：|详情加载失败|服务不可用|网关超时",
]
#: Notices that scripts (or cookies) are needed.
SCRIPTS = [
    r"(?i)(?:enable|requires?|turn on|activate|without|allow)\b[^.;；]{0,40}\b(?:javascript|scripts?|scripting|cookies)\b|javascript is (?:disabled|required|turned off)|your browser is out of date",
    r"(?i)(?:未启用|请启用|请开启|需要启用)\s*JavaScript|需要脚本支持|脚本被拦截|启用脚本|浏览器不支持脚本",
]
#: The words of the well-known filler passage (small words of living languages left out).
PASSAGE = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit laborum".split()
)
#: A word is filler if at least this share of the lines that have it, two at least, name the passage; a run of so many is evidence.
FILLER_SHARE, FILLER_RUN = 0.25, 3
#: Filler of other kinds: the passage named, repeated units, keyboard runs.
FILLER = [
    r"(?i)\blorem[\s_]*ipsum\b",
    r"^[\s*>-]*(\S)\1{2,}[\s!.。…]*$", r"(?:^|[\s；;。，*>-])(\S{1,6}?)(?:\s?\1){3,}(?:$|[\s；;。，.!>…])", r"(?:^|[\s；;。，*>-])(\S{2,8}?)(?:\s?\1){2,}(?:$|[\s；;。，.!>…])", r"(?i)\bblah blah\b|\basdf asdf\b|\bqwer qwer\b",
]
#: What stands alone where content should be; a number, a name in brackets or punctuation may follow.
_ALONE = (
    r"todo|tbd|fixme|fill in later|to be (?:filled|added|completed)|coming soon|placeholder(?: text)?|sample text(?:, do not publish)?|your text goes here|insert \w+ here|replace this text\b.*|"
    r"#ref!|#n/a|#value!|#name\?|\[object object\]|<nil>|\(null\)|默认文本|默认引用场景|占位符?|占位文字|待补充?|待填写?|后补|待定稿后补|暂缺，稍后填写|同上模板|模板内容，勿删|请在此处填写.*|在这里输入内容|此处为占位文字.*|示例：.*|一句话说明该文献用在哪里|以下为引用场景模板.*"
)
_TAIL = r"[\s!！.。…>）)，,;；*]*(?:\d+|[(（][\w.\- ]{1,20}[)）]|（\d+字以内）)?[\s!！.。…>*]*$"
ALONE = r"(?i)^[\s*>#-]*(?:" + _ALONE + r"|none|null|undefined|nan)(?:[;,\s]+(?:undefined|nan|null))*" + _TAIL
#: The same at the end of other content, where it cannot be a word of it.
AT_END = r"(?i)[\s；;。，](?:" + _ALONE + r"|none|null|undefined|nan|loading(?:…|\.{3}))" + _TAIL
#: Words of such messages that notes use as well.
AMBIGUOUS = r"(?i)\b(?:error|denied|unavailable|timed out|not found|forbidden)\b|错误|失败|占位|填写|无法(?:显示|加载|访问)|敬请期待"
#: A reference to a section or question, which a real note has.
REFERENCE = r"\d+(?:\.\d+)*\s*[节章]|第\d+章|(?i:section|in|discussion|method|chapter)\s+\d|RQ\d"
#: Where a field is cut into lines.
LINES = r"[\r\n]+|；"

#: Citation keys: a form real keys have, whatever their case and suffix.
REAL_KEY = r"^[A-Za-z\u00c0-\u024f\u4e00-\u9fff][A-Za-z\u00c0-\u024f\u4e00-\u9fff'’.+:-]*[0-9a-fA-F]{0,5}_?(?:1[89]|20)_?\d{2}[A-Za-z]{0,3}(?:[-_:][A-Za-z0-9]{1,3})?$"
#: Keys that stand for a key.
FALSE_KEYS = r"(?i)^\W*(?:todo|tbd|fixme|xxx+|test|foo|bar|asdf|qwerty?|abc\d*|key|example|sample|dummy|lorem_?ipsum|placeholder|undefined|nan|null|none|error)[\W_\d]*(?:key|test|foo|bar|nan|undefined|placeholder|\d)*\W*$|(?i)(?:^|[_-])(?:key|citekey|bibkey)_(?:here|goes_here|placeholder)|your[-_]key|citekey_placeholder|(?i)^author_?year|(?i)^(?:author|surname)y{4}|(?i)^todo-|(?i)^(?:none|nan|null|undefined)\d{4}|^(?:填写|示例|待定?|待填写?|待补充?|占位)(?:key)?$|作者年份首字母|(?i)enable-?javascript|(?i)^error\d+|(?i)undefinednan"



def _matches(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | text.rlike(pattern)
    return out


def missing(text: Column) -> Column:
    """Null, blank, or only a mark for a missing value."""
    return text.isNull() | F.regexp_replace(text, r"^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$", "").isin("", "—", "-", "N/A", "无")


def evident(line: Column) -> Column:
    """Unmistakable evidence in a line."""
    return _matches(line, PLACEHOLDERS + MESSAGES + SCRIPTS + FILLER + [ALONE, AT_END])


def false_key(key: Column) -> Column:
    """Whether a citation key holds residue: evidence as in a text, or a word that stands for a key. Forms of real keys pass."""
    return (~key.rlike(REAL_KEY) | key.contains("__")) & (evident(key) | key.rlike(FALSE_KEYS)) | key.rlike(r"^(?i:none|nan|null|undefined|todo|tbd|fixme|xxx+|lorem|lastname)[-_]?\d{4}")


def masked(line: Column) -> Column:
    """A line as it is counted: digits masked, blanks and case evened."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"\d+(?:\.\d+)*", "0"), r"[\s\x{3000}]+", " ")))


def residue(df: DataFrame, id_col: str, key: str | None, texts: list[str], host: str) -> DataFrame:
    """(id) of the records to exclude. `texts` are searched as lines, `key` as a citation key; `host` names where a record is from."""
    rows = df.select(F.col(id_col).alias("id"), F.col(host).alias("host"), *([F.col(key).alias("key")] if key else []), F.array(*[F.col(name) for name in texts]).alias("texts"))
    lines = rows.select("id", "host", F.explode("texts").alias("text")).where(~missing(F.col("text"))).select("id", "host", F.explode(F.split("text", LINES)).alias("line")).where(~missing(F.col("line")))
    # read several times below
    lines = cut_lineage(lines.withColumn("form", masked(F.col("line"))))
    boilerplate = F.broadcast(shared_forms(lines))
    # every distinct line is looked at once: in the residual for any evidence, among boilerplate for unmistakable one
    distinct = cut_lineage(lines.select("line", "form").distinct())
    line = F.col("line")
    residual = distinct.join(boilerplate, "form", "left_anti").where(evident(line) | line.rlike(AMBIGUOUS) & ~line.rlike(REFERENCE))
    protected = distinct.join(boilerplate, "form", "left_semi").where(evident(line))
    filler = distinct.join(filler_forms(distinct.select("form").distinct()), "form", "left_semi")
    evidence = residual.select("line").unionByName(protected.select("line")).unionByName(filler.select("line")).distinct()
    found = lines.join(evidence, "line", "left_semi").select("id")
    if key:
        keys = rows.where(~missing(F.col("key"))).select("id", "host", F.trim("key").alias("key"))
        odd = keys.where(~F.col("key").rlike(REAL_KEY) & F.col("host").isNotNull())
        common = odd.groupBy("key", "host").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("hosts")).where(F.col("hosts") >= KEY_HOSTS)
        found = found.unionByName(keys.where(false_key(F.col("key"))).select("id")).unionByName(keys.where(~F.col("key").rlike(REAL_KEY)).join(common, "key", "left_semi").select("id"))
    return found.distinct()


def filler_forms(forms: DataFrame) -> DataFrame:
    """(form) of the distinct forms of lines that have a run of filler words, learned by whose company words keep."""
    # what is not a Latin word keeps its place, so that it ends a run
    tokens = F.regexp_extract_all("form", F.lit(r"([a-z]+|[^a-z\s])"), 1)
    named = F.col("form").rlike(r"\b(?:lorem|ipsum)\b") & ~F.col("form").rlike(REFERENCE)
    latin = forms.where(F.col("form").rlike(r"[a-z]+(?:\s+[a-z]+){%d}" % (FILLER_RUN - 1))).select("form", tokens.alias("words"), named.alias("named"))
    words = latin.select("named", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("named").alias("k"))
    known = (F.col("n") >= 2) & (F.col("k") >= FILLER_SHARE * F.col("n")) & F.col("word").rlike("^[a-z]{3,}$")
    learned = words.where(known | F.col("word").isin(*PASSAGE)).select("word")
    placed = latin.select("form", F.posexplode("words").alias("at", "word")).join(learned, "word").groupBy("form").agg(F.collect_set("at").alias("places"))
    run = F.exists("places", lambda i: reduce(and_, [F.array_contains("places", i + k) for k in range(1, FILLER_RUN)]))
    return placed.where(run).select("form")


def shared_forms(lines: DataFrame) -> DataFrame:
    """(form) of the boilerplate among lines (host, form), at most RECURS; hosts are counted exactly."""
    by_host = cut_lineage(lines.groupBy("form", F.coalesce("host", F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("n")))
    total = by_host.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = by_host.groupBy("host").agg((F.sum("n") / F.lit(total)).alias("share"))
    excess = by_host.join(shares, "host").groupBy("form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.collect_list(F.struct("n", "share")).alias("parts"))
    even = F.forall("parts", lambda part: part["n"] <= F.col("n") * (part["share"] + 1 / SPREAD))
    return excess.where((F.col("n") >= SPREAD) & (F.col("n") * RECURS >= total) & (F.col("hosts") > 1) & even).select("form")
