"""Queries over manuscripts, letters and notes: audits, sections, citations, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.operators import audits, letters, matching, sequences
from folioscale.operators import search as search_dsl
from folioscale.plans.registry import Registry
from folioscale.runtime import read_table

registry = Registry()
query = registry.query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SENTENCES = "list_filter(string_split(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ') <> '')".format
_PARAGRAPHS = "list_filter(regexp_split_to_array({}, '\\n\\s*\\n'), lambda x: trim(x, ' ') <> '')".format
_WORDS = "len(regexp_extract_all({}, '\\S+'))".format


#: Patterns of the rules, written out for the SQL.
_ADDITIVE = "(?i)\\b(?:in addition|moreover|furthermore|additionally|besides)\\b"
_TRANSITIONS = "(?i)\\b(?:in addition|moreover|furthermore|additionally|besides|therefore|meanwhile|hence|consequently)\\b"
_STUDY = "(?:^|[.!?]\\s+)This (?:research|paper|study)\\b"
_EXISTS = "(?i)\\bthere (?:are|is|were|was|exists|exist)\\b"
_FILLERS = "(?i)\\b(?:actually|basically|certainly|clearly|essentially|extremely|greatly|highly|indeed|obviously|very)\\b"
_RESPECTIVELY = "(?i)\\brespectively\\b"
_PASSIVE = "(?i)\\b(?:was|were|is|are|been|being|be)\\s+(?:\\w+ly\\s+)?\\w+(?:en|ed)\\b"
_UNFINISHED = "(?i)\\btbd\\b|\\btodo\\b|xxx|fixme|\\\\textcolor\\{red\\}|\\?\\?\\?"
_JUNK = "(?i)^(?:from|to|sent|date|subject|cc):\\s+|^(?:content-type|mime-version):|^manuscript\\s+(?:manager|central)\\s+url|^https?://\\S+editorial\\S*$|^(?:-{5,}|={5,}|\\*{5,}|_{5,})$|^(?:powered\\s+by|scholarone)\\s+|^editorial\\s+manager|^\\d{1,2}/\\d{1,2}/\\d{2,4}\\s+\\d{1,2}:\\d{2}"
_REVIEWER = "(?i)(?:referee|reviewer)\\s*(?:#?\\s*(\\d+)|\\((\\d+)\\))"
_ASSOCIATE = "(?i)(?:handling|associate)\\s+editor|\\bae\\b"
_EDITOR = "(?i)decision|comments?\\s+(?:for|to)\\s+(?:the\\s+)?author|dear\\s+(?:dr|prof|mr|ms|author)|editor"
_KIND = "(?i){}\\s+(?:comment|revision|issue|point|concern)"
_NUMBERED = "^\\s*(?:\\(\\d+\\)\\s+|\\d+[.)]\\s+|#\\d+\\s+|(?:Comment|Point|Issue)\\s*#?\\s*\\d+)"
_BLOCKED = {
    "privacy": "大学|学术|教师|老师|科研|学院|课题|讲师|副教授|学者|博士|论文|教授|研究方法", "workload": "(?:凌晨|深夜|每周)[0-9]|每天[0-9]+小时|[0-9]+ (?:个 skill|个项目|篇论文)", "metrics": "SCI|影响因子|引用量|项目编号|课题号|青基|国基|自科|社科",
    "platform": "推特|Twitter|X\\.com|YouTube|油管|Facebook|脸书|Instagram|Reddit|TikTok|Discord", "region": "台[湾北中南]|高雄|香港|澳门|新疆|西藏", "episode": "(?:EP|S[0-9]+E)[0-9]+|第[0-9一二三四五六七八九十百]+集|第[0-9]+期", "jargon": "杏仁核|前额叶|肾上腺素|多巴胺|神经质|血清素|皮质醇|海马体|amygdala|cortisol|serotonin|prefrontal|hippocampus",
}
_CAPS = [("(?:已有|现有)研究表明", 2), ("鲜有研究关注|较少有研究", 1), ("丰富了[^，。]{0,20}理论体系", 1), ("填补了[^，。]{0,20}空白", 0), ("具有重要的(?:理论|实践)意义", 1), ("研究发现", 2), ("本文认为|本研究认为", 1), ("此外|另外", 2), ("综上所述", 1), ("一方面", 2)]
_PARTS = [
    ("Abstract", "\\\\begin\\{abstract\\}", "red"), ("Keywords", "\\\\begin\\{keyword\\}|\\\\keywords", "red"), ("Introduction", "(?i)\\\\section\\*?\\{introduction", "red"), ("Conclusion", "(?i)\\\\section\\*?\\{conclusion", "red"),
    ("References", "\\\\bibliography|\\\\begin\\{thebibliography\\}", "red"), ("Acknowledgments", "(?i)\\\\section\\*\\{acknowledg", "yellow"), ("Author contributions", "(?i)credit|author contribution", "yellow"), ("Declaration of interest", "(?i)declaration|conflict", "yellow"),
]


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_q(pattern)}))"


@query(f"select doc_id, len({_SENTENCES('text')})::bigint as sentences, len(list_filter({_SENTENCES('text')}, lambda s: {_WORDS('s')} > 35))::bigint as long_sentences from documents where text is not null")
def long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where("text is not null")
    return docs.select("doc_id", F.size(audits.sentences(F.col("text"))).cast("long").alias("sentences"), audits.long_sentences(docs, "text").alias("long_sentences"))


def _over(pattern: str, most: int) -> str:
    return f"len(list_filter({_PARAGRAPHS('text')}, lambda p: {_count('p', pattern)} > {most}))::bigint"


@query(
    f"select doc_id, {_over('---|—', 1)} as em_dashes, {_over(_TRANSITIONS, 2)} as transitions, {_over(_ADDITIVE, 1)} as additive, {_over(_STUDY, 2)} as study_subjects, {_over(_EXISTS, 0)} as existential, {_over(_FILLERS, 1)} as fillers, {_over(_RESPECTIVELY, 0)} as respectively from documents where text is not null"
)
def paragraph_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where("text is not null")
    return docs.select("doc_id", *[flag.alias(name) for name, flag in audits.paragraph_flags(F.col("text")).items()])


@query(f"select doc_id, len(list_filter({_PARAGRAPHS('text')}, lambda p: len(list_filter({_SENTENCES('p')}, lambda s: regexp_matches(s, {_q(_PASSIVE)}))) > 0.6 * len({_SENTENCES('p')})))::bigint as passive from documents where text is not null")
def passive_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", audits.passive_paragraphs(F.col("text")).alias("passive"))


@query("select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ') <> '' and regexp_matches(x, '\\\\cite'))) / nullif(len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ') <> '')), 0)::double as density from documents where text is not null")
def citation_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = audits.sentences(F.col("text"))
    share = F.size(F.filter(parts, lambda s: s.rlike(r"\\cite"))) / F.nullif(F.size(parts), F.lit(0)).cast("double")
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", share.alias("density"))


@query("""
    with s as (select doc_id, list_transform(list_filter(regexp_split_to_array(text, '[。！？\\n]'), lambda x: trim(x, ' ') <> ''), lambda x: length(x)) as n from documents where lang = 'zh' and text is not null)
    select doc_id, len(n)::bigint as sentences, coalesce(list_min(n) <= 15 and list_max(n) >= 45, false) as varied from s""")
def zh_sentence_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.transform(audits.zh_sentences(F.col("text")), F.length)
    return _docs(spark, sf_dir).where("lang = 'zh' and text is not null").select("doc_id", F.size(lengths).cast("long").alias("sentences"), F.coalesce((F.array_min(lengths) <= 15) & (F.array_max(lengths) >= 45), F.lit(False)).alias("varied"))


_PHRASES = " union all ".join(f"select doc_id, {_q(phrase)} as phrase, {_count('text', phrase)}::bigint as n, {cap} as cap from documents where text is not null" for phrase, cap in _CAPS)


@query(f"select * from ({_PHRASES}) where n > cap")
def phrase_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.explode(audits.phrase_excess(F.col("text"))).alias("p"))
    return rows.select("doc_id", "p.phrase", F.col("p.n").cast("long").alias("n"), "p.cap")


_STRUCTURE = " union all ".join(f"select doc_id, '{part}' as part, '{severity}' as severity from documents where source like 'manuscript%' and text is not null and not regexp_matches(text, {_q(pattern)})" for part, pattern, severity in _PARTS)


@query(f"select * from ({_STRUCTURE})")
def structure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).where("source like 'manuscript%' and text is not null").select("doc_id", F.explode(audits.missing_structure(F.col("text"))).alias("m"))
    return rows.select("doc_id", "m.part", "m.severity")


@query(f"with m as ({_STRUCTURE}) select source, count(*) filter (severity = 'red') as red, count(*) filter (severity = 'yellow') as yellow, count(*) filter (severity = 'red') = 0 as ready from m join (select doc_id, source from documents) using (doc_id) group by source")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure_check(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count_if(F.col("severity") == "red").alias("red"), F.count_if(F.col("severity") == "yellow").alias("yellow"), (F.count_if(F.col("severity") == "red") == 0).alias("ready"))


_LINES = "(select doc_id, generate_subscripts(ls, 1)::bigint as line_no, unnest(ls) as line from (select doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) as ls from documents where text is not null))"


@query(f"select doc_id, line_no, line from {_LINES} where regexp_matches(line, {_q(_UNFINISHED)})")
def placeholder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = letters.lines(_docs(spark, sf_dir), "doc_id", "text").where(F.col("line").rlike(audits.RESIDUE))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


_BLOCK = " union all ".join(f"select '{group}' as rule, count(*) filter (regexp_matches(line, {_q(pattern)})) as hits from {_LINES}" for group, pattern in _BLOCKED.items())


@query(_BLOCK)
def blocklist_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = letters.lines(_docs(spark, sf_dir), "doc_id", "text")
    counts = rows.agg(*[F.count_if(F.col("line").rlike(pattern)).alias(group) for group, pattern in audits.BLOCKLIST.items()])
    return counts.unpivot([], list(audits.BLOCKLIST), "rule", "hits")


_SECTIONS = f"""sec as (select *, row_number() over (partition by doc_id order by line_no) as node from (select doc_id, line_no, line, regexp_extract(line, '^[^%]*?\\\\(section|subsection|subsubsection)\\*?\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', 1) as cmd,
 regexp_extract(line, '^[^%]*?\\\\(section|subsection|subsubsection)\\*?\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', 2) as title from {_LINES}) where cmd <> ''),
 tree as (select doc_id, node, case cmd when 'section' then 1 when 'subsection' then 2 else 3 end as level, title, line_no from sec)"""


@query(f"with {_SECTIONS} select * from tree")
def latex_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters.latex_sections(_docs(spark, sf_dir), "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


@query(
    f"""with {_SECTIONS}, par as (select t.*, (select max(u.node) from tree u where u.doc_id = t.doc_id and u.node < t.node and u.level < t.level) as parent from tree t)
    select doc_id, node, level, parent, lag(node) over w as preceding, lead(node) over w as following from par window w as (partition by doc_id, parent, level order by node)"""
)
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = letters.latex_sections(_docs(spark, sf_dir), "doc_id", "text")
    return sequences.link_tree(nodes, "doc_id", "node", "level").select("doc_id", "node", "level", "parent", "preceding", "following")


_CITES = f"""cit as (select doc_id, line_no, line, nullif(regexp_extract(line, '\\\\(section|subsection)\\*?\\{{', 1), '') as cmd, regexp_extract(line, '\\\\(?:section|subsection)\\*?\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', 1) as head from {_LINES} where not regexp_matches(line, '^\\s*%')),
 fwd as (select *, last_value(case when cmd = 'section' then head end ignore nulls) over w as section, last_value(case when cmd = 'section' then '' when cmd = 'subsection' then head end ignore nulls) over w as subsection from cit window w as (partition by doc_id order by line_no rows unbounded preceding)),
 ky as (select doc_id, trim(unnest(string_split(grp, ','))) as key, section, nullif(subsection, '') as subsection, line_no from (select *, unnest(regexp_extract_all(line, '\\\\(?:cite|citep|citet|citeN|parencite|textcite)\\*?(?:\\[[^\\]]*\\])*\\{{([^}}]*)\\}}', 1)) as grp from fwd where cmd is null))"""


@query(f"with {_CITES} select * from ky where key <> ''")
def latex_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = letters.latex_citations(_docs(spark, sf_dir), "doc_id", "text")
    return rows.select("doc_id", "key", "section", "subsection", F.col("line_no").cast("long").alias("line_no"))


@query(
    f"""with {_CITES}, c as (select distinct key from ky where key <> ''), l as (select distinct citation_key as key from pool_entries where citation_key is not null)
    select key, 'missing' as problem, 'error' as severity from c where key not in (select key from l) union all select key, 'unused', 'warning' from l where key not in (select key from c)"""
)
def ghost_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys cited in documents against keys of the citation pool."""
    cited = letters.latex_citations(_docs(spark, sf_dir), "doc_id", "text").select("key")
    return matching.reference_check(cited, read_table(spark, sf_dir, "pool_entries").select(F.col("citation_key").alias("key")), "key")


@query("""
    with d as (select distinct unnest(regexp_extract_all(text, '\\\\label\\{([^}]*)\\}', 1)) as label from documents), r as (select distinct unnest(regexp_extract_all(text, '\\\\(?:ref|eqref|autoref|cref)\\{([^}]*)\\}', 1)) as label from documents)
    select label, 'missing' as problem, 'error' as severity from r where label not in (select label from d) union all select label, 'unused', 'warning' from d where label not in (select label from r)""")
def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    defined, used = letters.labels_and_refs(_docs(spark, sf_dir), "doc_id", "text")
    return matching.reference_check(used, defined, "label")


@query("select doc_id, case when lower(text) like '%major revision%' then 'Major Revision' when lower(text) like '%minor revision%' then 'Minor Revision' when lower(text) like '%reject%' and lower(text) like '%resubmit%' then 'Reject & Resubmit' when lower(text) like '%reject%' then 'Reject' when lower(text) like '%accept%' then 'Accept' else 'Unknown' end as decision from documents where source = 'decision_letters'")
def decision_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("source = 'decision_letters'").select("doc_id", X.decision("text").alias("decision"))


_LETTER = f"""ln as (select l.doc_id, line_no, line, trim(line, ' ') as bare from {_LINES} l join documents d using (doc_id) where source = 'decision_letters' and not regexp_matches(line, {_q(_JUNK)})),
 op as (select *, nullif(coalesce(nullif(regexp_extract(bare, {_q(_REVIEWER)}, 1), ''), regexp_extract(bare, {_q(_REVIEWER)}, 2)), '') as num, regexp_matches(bare, {_q(_ASSOCIATE)}) as is_ae, regexp_matches(bare, {_q(_EDITOR)}) as is_ed from ln),
 pt as (select *, last_value(case when num is not null then 'reviewer:' || num when is_ae then 'ae:' end ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as part from op),
 ed as (select *, sum((part is null and is_ed)::int) over (partition by doc_id order by line_no rows unbounded preceding) as eds from pt),
 rl as (select doc_id, line_no, line, bare, coalesce(split_part(part, ':', 1), case when eds > 0 then 'editor' else 'preamble' end) as role, nullif(split_part(part, ':', 2), '')::int as number from ed where num is null and not is_ae and not (part is null and is_ed and eds = 1))"""


@query(f"with {_LETTER} select doc_id, role, number, count(*) as lines from rl group by all")
def letter_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = letters.letter_lines(_docs(spark, sf_dir).where("source = 'decision_letters'"), "doc_id", "text")
    return rows.groupBy("doc_id", "role", "number").agg(F.count(F.lit(1)).alias("lines"))


COMMENTS = f"""{_LETTER}, rv as (select *, case when regexp_matches(bare, {_q(_KIND.format('major'))}) then 'major' when regexp_matches(bare, {_q(_KIND.format('minor'))}) then 'minor' end as heading from rl where role = 'reviewer'),
 nb as (select *, heading is null and regexp_matches(bare, {_q(_NUMBERED)}) as numbered from rv),
 ty as (select *, coalesce(last_value(heading ignore nulls) over w, 'major') as type, sum((numbered or heading is not null)::int) over w as block from nb window w as (partition by doc_id, number order by line_no rows unbounded preceding)),
 tx as (select doc_id, number, block, type, trim(string_agg(case when numbered then trim(regexp_replace(bare, {_q(_NUMBERED)}, ''), ' ') else line end, chr(10) order by line_no), ' ') as text from ty where heading is null group by all)"""


@query(f"with {COMMENTS} select doc_id, number, 'R' || number || case when type = 'minor' then '-m' else '-' end || row_number() over (partition by doc_id, number, type order by block) as comment_id, type from tx where length(text) >= 5")
def comment_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters.comments(_docs(spark, sf_dir).where("source = 'decision_letters'"), "doc_id", "text").select("doc_id", "number", "comment_id", "type")


@query(f"with {COMMENTS} select number, count(*) filter (type = 'major') as major, count(*) filter (type = 'minor') as minor, count(distinct doc_id) as letters from tx where length(text) >= 5 group by number")
def reviewer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = letters.comments(_docs(spark, sf_dir).where("source = 'decision_letters'"), "doc_id", "text")
    return rows.groupBy("number").agg(F.count_if(F.col("type") == "major").alias("major"), F.count_if(F.col("type") == "minor").alias("minor"), F.countDistinct("doc_id").alias("letters"))


#: Field names of screening blocks.
FIELDS = {"级别": "tier", "tier": "tier", "作者": "author", "author": "author", "authors": "author", "标题": "title", "title": "title", "年份": "year", "year": "year", "期刊": "journal", "journal": "journal", "理由": "reason", "reason": "reason"}
_FIELD_CASE = "case lower(k) " + " ".join(f"when '{a}' then '{b}'" for a, b in FIELDS.items()) + " end"
_KV = "^\\s*[-*]?\\s*([^\\s：:]+)\\s*[：:]\\s*(.+)$"


@query(
    f"""with ln as (select l.doc_id, line_no, line from {_LINES} l join documents d using (doc_id) where (source like 'screening%' or source like 'pool_notes%') and trim(line, ' ') <> ''),
    bl as (select *, sum((regexp_matches(line, '^\\s*###\\s'))::int) over (partition by doc_id order by line_no rows unbounded preceding) as block from ln),
    kv as (select doc_id, block, {_FIELD_CASE} as key, trim(regexp_extract(replace(line, '**', ''), '{_KV}', 2), ' ') as value, line_no from (select *, regexp_extract(replace(line, '**', ''), '{_KV}', 1) as k from bl where block > 0)),
    la as (select doc_id, block, key, arg_max(value, line_no) as value from kv where key is not null group by all),
    ti as (select doc_id, block, trim(regexp_replace(line, '^\\s*###\\s+', ''), ' ') as title from bl where block > 0 and regexp_matches(line, '^\\s*###\\s'))
    select ti.doc_id, ti.block, any_value(ti.title) as title, max(value) filter (key = 'author') as author, max(value) filter (key = 'year') as year, max(value) filter (key = 'tier') as tier, (max(value) filter (key = 'reason')) is not null as has_reason from ti left join la using (doc_id, block) group by ti.doc_id, ti.block"""
)
def screening_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where("source like 'screening%' or source like 'pool_notes%'")
    rows = letters.key_values(docs, "doc_id", "text", FIELDS)
    pick = lambda name: F.try_element_at("fields", F.lit(name))
    return rows.select("doc_id", "block", "title", pick("author").alias("author"), pick("year").alias("year"), pick("tier").alias("tier"), pick("reason").isNotNull().alias("has_reason"))


_SEARCH = '(TS=("bridge inspection" OR "carbon account*") AND TS=panel) OR TI=("urban heat" NOT scoping)'


@query(r"""
    select paper_id from papers where ((regexp_matches(' ' || lower(coalesce(title, '') || ' ' || coalesce(reason, '')) || ' ', '[^\p{L}\p{N}]bridge inspection[^\p{L}\p{N}]') or regexp_matches(' ' || lower(coalesce(title, '') || ' ' || coalesce(reason, '')) || ' ', '[^\p{L}\p{N}]carbon account[\p{L}\p{N}]*[^\p{L}\p{N}]'))
    and regexp_matches(' ' || lower(coalesce(title, '') || ' ' || coalesce(reason, '')) || ' ', '[^\p{L}\p{N}]panel[^\p{L}\p{N}]')) or (regexp_matches(' ' || lower(coalesce(title, '')) || ' ', '[^\p{L}\p{N}]urban heat[^\p{L}\p{N}]') and not regexp_matches(' ' || lower(coalesce(title, '')) || ' ', '[^\p{L}\p{N}]scoping[^\p{L}\p{N}]'))""")
def boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = read_table(spark, sf_dir, "papers")
    topic = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("reason", F.lit("")))
    return papers.where(search_dsl.web_search(_SEARCH, F.coalesce("title", F.lit("")), topic)).select("paper_id")


@query("select paper_id from papers where ((contains(lower(title), '绿色创新') and contains(lower(title), '面板数据')) or contains(lower(title), '知识溢出')) and not coalesce(contains(lower(journal), '学报'), false) and year between 2015 and 2024")
def cnki_boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = read_table(spark, sf_dir, "papers")
    search = "(TI %= '绿色创新*面板数据' OR TI %= '知识溢出') NOT JN % '学报' AND YE BETWEEN ('2015','2024')"
    return papers.where(search_dsl.cnki_search(search, {"TI": [F.col("title")], "JN": [F.col("journal")]}, F.col("year"))).select("paper_id")


@query(
    f"""with p as (select doc_id, generate_subscripts(ps, 1) as n, unnest(ps) as par from (select doc_id, {_PARAGRAPHS("regexp_replace(text, '\\r\\n?', chr(10), 'g')")} as ps from documents where lang = 'zh' and text is not null)),
    f as (select doc_id, n, w, contains(par, w) as has from p, (select unnest([{', '.join(repr(w) for w in audits.FREQUENT)}]) as w)),
    r as (select *, lag(has) over v as h1, lag(has, 2) over v as h2 from f window v as (partition by doc_id, w order by n))
    select doc_id, w as word, count(*) as runs from r where has and h1 and h2 group by all"""
)
def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words in three paragraphs in a row."""
    docs = _docs(spark, sf_dir).where("lang = 'zh' and text is not null")
    pars = docs.select("doc_id", F.posexplode(audits.paragraphs(F.regexp_replace("text", "\r\n?", "\n"))).alias("n", "par"))
    flags = pars.select("doc_id", "n", F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.contains("par", F.lit(w)).alias("has")) for w in audits.FREQUENT])).alias("f")).select("doc_id", "n", "f.word", "f.has")
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id", "word").orderBy("n")
    runs = flags.withColumns({"h1": F.lag("has").over(order), "h2": F.lag("has", 2).over(order)}).where("has and h1 and h2")
    return runs.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("runs"))


@query("""
    with s as (select doc_id, generate_subscripts(ss, 1) as n, unnest(ss) as s from (select doc_id, list_filter(regexp_split_to_array(text, '[。！？\\n]'), lambda x: trim(x, ' ') <> '') as ss from documents where lang = 'zh' and text is not null)),
    l as (select *, length(s) as len, abs(length(s) - lag(length(s)) over (partition by doc_id order by n)) <= 5 as same from s),
    r as (select *, sum((not coalesce(same, false))::int) over (partition by doc_id order by n rows unbounded preceding) as run from l)
    select doc_id, min(n)::int as run_start, count(*) as length from r group by doc_id, run having count(*) > 3""")
def similar_length_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than three sentences in a row of nearly one length."""
    docs = _docs(spark, sf_dir).where("lang = 'zh' and text is not null")
    rows = docs.select("doc_id", F.posexplode(audits.zh_sentences(F.col("text"))).alias("n", "s")).withColumns({"n": F.col("n") + 1, "len": F.length("s")})
    same = F.abs(F.col("len") - sequences.previous("len", "doc_id", "n")) <= 5
    return sequences.runs(rows.withColumn("same", same), F.col("same"), "doc_id", "n", 4)
