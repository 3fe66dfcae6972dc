"""Which spellings of a name mean the same person or organisation.

Distinct names are parsed with the help of the corpus: given names and common
words of organisations are those that many names share. What is left (the
family name, the place of an organisation) becomes a vector of character
n-grams weighted by inverse frequency. Candidates come from two equality
joins: a sparse one on the rarest long n-grams of the vectors, as many as a
pair above the least cosine must share one of; and, since slips may leave too
few n-grams whole for that, one on what is left of a head when a letter (or
two, of long heads) is dropped, which misses no pair within these edits.
Names whose heads are equal or such candidates confirmed by their edits, and
whose given names may be the same, form a graph; within each of its components
average-linkage clustering, on the cosine of heads times the agreement of given
names, thresholded at LINK, decides which belong together.

Defined results: null and blank names take no part; equal names are always
together; a name of initials only joins the name it agrees with best; an
initial agrees with every given name it may stand for; two different given
names, familiar forms aside, never agree, nor do two bodies of one place.
Clusters are rows (id, cluster), so copies are not expanded into pairs.

Bounds: given names and organisation words are those with more than
1/COMMON_SHARE of all tokens, so there are at most COMMON_SHARE of each;
weights of n-grams are known for those in more than 1/COMMON_SHARE of the
heads. Linkage holds only the pairs that agree at all: a name of an initial
agrees with all names of that letter, others with those of one given name, so
a component's pairs grow with its names, not with their square.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.llm.pairs import pairs_within
from folioscale.operators.graph import connected_components
from folioscale.runtime import attach_group, cut_lineage

#: A token is common if it makes up more than 1/COMMON_SHARE of the tokens of its kind.
COMMON_SHARE = 3_000
#: A given name one edit from a common one is a slip if the common one is this many times as frequent.
SLIP_RATIO = 4
#: Length of character n-grams, and the least cosine of joined heads (two edits leave few n-grams of a word whole).
GRAM, LEAST_COSINE = 4, 0.12
#: Two edits join heads of at least this length only if one is this many times as frequent as the other, which is then taken for a slip.
TWO_EDITS, TWO_EDITS_RATIO = 8, 3
#: Heads beyond this length are compared by stretches instead of dropped letters.
LONG = 32
#: Shorter heads are joined only if equal: one edit makes another name of them.
LEAST_HEAD = 5
#: Agreement of an initial with a name, and the least mean similarity of clusters that are merged.
INITIAL, LINK = 0.6, 0.42
#: Length of the n-grams of which the similarity of heads is the cosine, and the edits beyond which it is 0.
LINK_GRAM, FAR = 2, 3

#: Familiar forms and the names they stand for.
FAMILIAR = {
    "alex": "alexander", "al": "albert", "andy": "andrew", "drew": "andrew", "tony": "anthony", "bart": "bartholomew", "ben": "benjamin", "benny": "benjamin", "charlie": "charles", "chuck": "charles", "chris": "christopher", "kit": "christopher",
    "dan": "daniel", "danny": "daniel", "dave": "david", "davy": "david", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward", "teddy": "edward", "fred": "frederick", "freddy": "frederick", "gabe": "gabriel", "jeff": "jeffrey", "geoff": "geoffrey", "greg": "gregory",
    "hank": "henry", "harry": "henry", "jack": "john", "johnny": "john", "jake": "jacob", "jim": "james", "jimmy": "james", "jamie": "james", "joe": "joseph", "joey": "joseph", "jon": "jonathan", "josh": "joshua", "ken": "kenneth", "kenny": "kenneth", "larry": "lawrence", "len": "leonard", "lenny": "leonard",
    "matt": "matthew", "max": "maximilian", "mike": "michael", "mick": "michael", "mickey": "michael", "nat": "nathaniel", "nate": "nathan", "nick": "nicholas", "nicky": "nicholas", "pete": "peter", "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "dick": "richard",
    "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "ron": "ronald", "ronnie": "ronald", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "steven": "stephen", "stu": "stuart", "tim": "timothy", "timmy": "timothy", "tom": "thomas", "tommy": "thomas", "vic": "victor", "vince": "vincent",
    "walt": "walter", "wally": "walter", "will": "william", "bill": "william", "billy": "william", "willy": "william", "zach": "zachary", "zack": "zachary",
    "abby": "abigail", "mandy": "amanda", "angie": "angela", "barb": "barbara", "carrie": "caroline", "cathy": "catherine", "cindy": "cynthia", "connie": "constance", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dora": "theodora", "thea": "theodora", "dot": "dorothy", "dottie": "dorothy", "ellie": "eleanor", "nell": "eleanor",
    "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "libby": "elizabeth", "gwen": "gwendolyn", "jackie": "jacqueline", "jan": "janet", "jen": "jennifer", "jenny": "jennifer", "jess": "jessica", "jessie": "jessica", "jo": "joanna", "judy": "judith",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine", "kitty": "katherine", "kim": "kimberly", "lucy": "lucia", "maggie": "margaret", "meg": "margaret", "peg": "margaret", "peggy": "margaret", "molly": "mary", "polly": "mary", "mel": "melanie", "millie": "mildred",
    "nan": "ann", "nancy": "ann", "annie": "ann", "pam": "pamela", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "becky": "rebecca", "becca": "rebecca", "sally": "sarah", "sandy": "sandra", "sue": "susan", "susie": "susan", "suzy": "susan", "tess": "theresa", "terry": "theresa", "tina": "christina",
    "val": "valerie", "vicky": "victoria", "vickie": "victoria", "tori": "victoria", "viv": "vivian", "wendy": "gwendolyn", "winnie": "winifred",
}
#: Traditional forms of characters frequent in names, and their simplified forms.
TRADITIONAL = (
    "陳陈張张趙赵錢钱孫孙鄭郑馮冯蔣蒋韓韩楊杨許许呂吕吳吴劉刘黃黄羅罗謝谢鄧邓葉叶蘇苏盧卢賈贾鄒邹陸陆龍龙萬万湯汤賴赖顧顾龐庞閻阎藍蓝駱骆嚴严齊齐聶聂歐欧關关"
    "偉伟華华國国東东軍军麗丽蘭兰紅红傑杰興兴榮荣貴贵慶庆義义遠远鐵铁寧宁長长豐丰銅铜雲云銀银順顺嶺岭錫锡楓枫鳳凤鵬鹏飛飞馬马魯鲁鴻鸿鶴鹤劍剑維维綱纲緒绪綠绿靜静韻韵"
    "蓮莲蓋盖蘆芦瑤瑶瑋玮璽玺寶宝賢贤賓宾達达運运進进連连邁迈醫医鈞钧鋒锋鋼钢錦锦鎮镇鑫鑫陽阳隊队際际霽霁項项頌颂頡颉顏颜風风書书曉晓曄晔棟栋樹树橋桥權权歡欢氣气澤泽漢汉"
    "滿满瀟潇瀾澜濤涛濟济潤润燦灿煥焕爾尔獻献琺珐瓊琼畫画盡尽禮礼穎颖穀谷筆笔節节範范紀纪純纯紹绍結结經经績绩聖圣聰聪肅肃舉举莊庄蔭荫薩萨藝艺虛虚衛卫見见觀观記记詩诗誠诚"
)
_SIMPLE = {ord(old): new for old, new in zip(TRADITIONAL[::2], TRADITIONAL[1::2])}
#: Words that name a kind of organisation, with their short forms; and small words left out.
KINDS = {
    "institute": "institute inst institut instituto institution", "centre": "centre center cent ctr centro", "department": "department dep dept departement departamento", "society": "society soc societe sociedad", "university": "university univ universitat universite universidad", "college": "college coll",
    "laboratory": "laboratory lab labs laboratories", "agency": "agency agcy", "ministry": "ministry min", "office": "office off", "bureau": "bureau", "council": "council", "committee": "committee comm", "association": "association assoc assn", "academy": "academy acad", "foundation": "foundation found fdn", "commission": "commission",
    "school": "school sch", "faculty": "faculty fac", "group": "group grp", "company": "company corp inc ltd llc gmbh", "organisation": "organisation organization org", "authority": "authority", "service": "service services", "network": "network", "consortium": "consortium", "union": "union", "board": "board",
}
_KIND = {short: kind for kind, forms in KINDS.items() for short in forms.split()}
#: Kinds that mark an organisation wherever they stand (others only in braces or beside one of these).
_MARKS = {"institute", "centre", "department", "society", "university", "college", "laboratory", "agency", "ministry", "council", "association", "academy", "foundation", "commission", "bureau", "committee", "consortium"}
_SMALL = frozenset("the of for and a an de la du des der die das et y e und".split())
_TITLES = frozenset("dr prof professor mr mrs ms sir dame".split())
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?")
_HAN = re.compile("[㐀-鿿]")


def first_author(full: str) -> str:
    """The first name of a BibTeX author list; a name in braces may hold the word and."""
    full = full.strip()
    depth = 0
    for at, char in enumerate(full):
        if char == "{":
            depth += 1
        elif char == "}":
            depth = max(0, depth - 1)
        elif char.isspace() and depth == 0 and re.match(r"\s+and\s", full[at : at + 12]):
            return full[:at].strip()
    return full


def fold(name: str) -> str:
    """Lower case, narrow, without accents; traditional characters simplified; initials kept apart from words by their capitals."""
    name = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", name).translate(_SIMPLE))
    return "".join(char for char in name if not unicodedata.combining(char))


def close(a: str, b: str) -> bool:
    """At most one letter added, dropped, changed, or exchanged with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    if len(a) == len(b):
        return a[at + 1 :] == b[at + 1 :] or a[at : at + 2] == b[at : at + 2][::-1] and a[at + 2 :] == b[at + 2 :]
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return longer[at + 1 :] == shorter[at:]


def edits(a: str, b: str, most: int = 2) -> int:
    """Letters added, dropped, changed or exchanged with their neighbour; most + 1 if there are more. The time grows with the length only."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    beyond = most + 1
    # rows of the usual table, of which only cells within `most` of the diagonal can count
    before: dict[int, int] = {}
    last = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                row[j] = i
                continue
            y = b[j - 1]
            cost = min(last.get(j, beyond) + 1, row.get(j - 1, beyond) + 1, last.get(j - 1, beyond) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before.get(j - 2, beyond) + 1)
            row[j] = cost
        if min(row.values()) > most:
            return beyond
        before, last = last, row
    return min(last.get(len(b), beyond), beyond)


def is_organisation(name: str) -> bool:
    words = [token.rstrip(".").lower() for token in _TOKEN.findall(name)]
    return name.lstrip().startswith("{") or len(words) > 2 and any(_KIND.get(word) in _MARKS for word in words)


class Words:
    """What the corpus knows: how often given names and words of organisations occur."""

    def __init__(self, given: dict[str, int], common: dict[str, int]) -> None:
        self.given, self.common = given, common
        self._near: dict[str, str] = {}
        self._twice: dict[str, str] = {}
        self._long: dict[str, str] = {}
        self._long: dict[str, str] = {}
        self._by_length: dict[int, list[str]] = {}
        for word in given:
            self._by_length.setdefault(len(word), []).append(word)

    def given_name(self, word: str) -> str:
        """A given name with familiar forms and slips undone."""
        if word in FAMILIAR:
            return FAMILIAR[word]
        if word not in self._near:
            own = self.given.get(word, 1)
            found = [other for size in (len(word) - 1, len(word), len(word) + 1) for other in self._by_length.get(size, ()) if other != word and self.given[other] >= SLIP_RATIO * own and close(word, other)] if len(word) > 3 else []
            best = max(found, key=self.given.__getitem__, default=word)
            self._near[word] = FAMILIAR.get(best, best)
        return self._near[word]

    def slipped(self, word: str) -> str:
        """As given_name, for a word in the place of a given name, which may have two slips."""
        name = self.given_name(word)
        if name != word or word in self.given or len(word) < 4:
            return name
        if word not in self._twice:
            found = [other for size in range(len(word) - 2, len(word) + 3) for other in self._by_length.get(size, ()) if size > 3 and self.given[other] > 1 and edits(word, other) == 2]
            best = max(found, key=self.given.__getitem__, default=word)
            self._twice[word] = FAMILIAR.get(best, best)
        return self._twice[word]

    def is_given(self, word: str) -> bool:
        return word in self.given or word in FAMILIAR or self.given_name(word) in self.given

    def written_out(self, word: str) -> str:
        """A short form as the commonest word of organisations that it begins."""
        if word not in self._long:
            longer = [other for other in self.common if len(other) > len(word) >= 3 and other.startswith(word)]
            self._long[word] = max(longer, key=lambda other: (self.common[other], other), default=word)
        return self._long[word]

    def parse(self, name: str) -> tuple[str, str, str, str] | None:
        """(kind, head, given, middle) of a folded name."""
        if _HAN.search(name):
            han = "".join(_HAN.findall(name))
            return ("han", han, "", "")
        if is_organisation(name):
            return self._organisation(name)
        return self._person(name)

    def _organisation(self, name: str) -> tuple[str, str, str, str] | None:
        """Head is the rarest word, as a rule the place; short forms and words of kinds are never the head."""
        body, rest = [], []
        for token in _TOKEN.findall(name):
            word = token.rstrip(".").lower()
            if word in _KIND:
                body.append(_KIND[word])
            elif token.endswith("."):
                body.append(self.written_out(word))
            elif word not in _SMALL:
                rest.append(word)
        if not rest and not body:
            return None
        head = min(rest, key=lambda word: (self.common.get(word, 0), -len(word), word), default="")
        if not head:
            return ("organisation", " ".join(sorted(set(body))), "", "")
        return ("organisation", head, " ".join(sorted({*body, *rest} - {head})), "")

    def _person(self, name: str) -> tuple[str, str, str, str] | None:
        family, comma, given = name.partition(",")
        if comma and _TOKEN.search(given):
            head = " ".join(token.rstrip(".").lower() for token in _TOKEN.findall(family))
            names = self._names(_TOKEN.findall(given))
            return ("person", head, *names) if head else None
        tokens = _TOKEN.findall(name)
        if len(tokens) > 2 and tokens[0].rstrip(".").lower() in _TITLES or len(tokens) == 2 and tokens[0].rstrip(".").lower() in {"dr", "prof"} and tokens[0][0].isupper() and len(tokens[0]) > 2:
            tokens = tokens[1:]
        words = [token.rstrip(".") for token in tokens]
        long = [at for at, word in enumerate(words) if len(word) > 2 or len(words) == 1 or len(word) == 2 and not word.isupper() and not tokens[at].endswith(".")]
        if not long:
            long = [max(range(len(words)), key=lambda at: len(words[at]))] if words else []
        if not long:
            return None
        # the family name is the word that is no given name; of several, the longest
        strange = [at for at in long if not self.is_given(words[at].lower())] or long
        at = max(strange, key=lambda at: (len(words[at]), at)) if len(long) > 1 else long[0]
        return ("person", words[at].lower(), *self._names(tokens[:at] + tokens[at + 1 :]))

    def _names(self, tokens: list[str]) -> tuple[str, str]:
        """The given name (or its initial) and the initial of the next."""
        parts: list[str] = []
        for at, token in enumerate(tokens):
            word = token.rstrip(".")
            if at == 0 and len(tokens) > 1 and word.lower() in _TITLES and len(word) > 1:
                continue
            if len(word) == 2 and (word.isupper() or word.lower() not in FAMILIAR and word.lower() not in self.given):
                parts += list(word.lower())
            else:
                parts.append(word.lower())
        if not parts:
            return "", ""
        first = self.slipped(parts[0]) if len(parts[0]) > 1 else parts[0]
        return first, parts[1][0] if len(parts) > 1 else ""


def _agreement(a: tuple[str, str], b: tuple[str, str]) -> float:
    """How well (given, middle) of two names agree; 0 if they are different people."""
    (given_a, middle_a), (given_b, middle_b) = a, b
    if not given_a or not given_b:
        return 0.0 if given_a != given_b else 1.0
    if given_a == given_b:
        score = 1.0
    elif len(given_a) == 1 and given_b.startswith(given_a) or len(given_b) == 1 and given_a.startswith(given_b):
        score = INITIAL
    else:
        return 0.0
    if middle_a and middle_b:
        return min(1.0, score + 0.25) if middle_a == middle_b else (0.2 if score < 1 else 0.5)
    return score


def average_linkage(similarity: dict[tuple[int, int], float], weights: list[float], least: float) -> list[int]:
    """Cluster numbers (the smallest member); the two clusters of greatest mean similarity are merged while it is at least `least`.

    similarity holds the pairs (i, j), i < j, that are not 0. Of equal means
    the pair with more rows is merged first.
    """
    label = list(range(len(weights)))
    members = [[i] for i in label]
    heavy = list(weights)
    sums: list[dict[int, float]] = [{} for _ in label]
    heap: list[tuple[float, float, int, int]] = []

    def push(i: int, j: int) -> None:
        mean = round(sums[i][j] / (len(members[i]) * len(members[j])), 9)
        if mean >= least:
            heappush(heap, (-mean, -(heavy[i] + heavy[j]), min(i, j), max(i, j)))

    for (i, j), value in similarity.items():
        sums[i][j] = sums[j][i] = value
        push(i, j)
    while heap:
        mean, weight, i, j = heappop(heap)
        # what was pushed before a merger is stale
        if j not in sums[i] or weight != -(heavy[i] + heavy[j]) or -mean != round(sums[i][j] / (len(members[i]) * len(members[j])), 9):
            continue
        for k, value in sums[j].items():
            del sums[k][j]
            if k != i:
                sums[i][k] = sums[k][i] = sums[i].get(k, 0.0) + value
        sums[j] = {}
        members[i] += members[j]
        members[j] = []
        heavy[i] += heavy[j]
        for k in sums[i]:
            push(i, k)
    for i, own in enumerate(members):
        for member in own:
            label[member] = i
    return label


class Cosine:
    """Cosine of n-gram vectors of heads, weighted by inverse frequency among the heads."""

    def __init__(self, heads: int, frequency: dict[str, int]) -> None:
        self.heads, self.frequency = max(1, heads), frequency
        self._vectors: dict[str, dict[str, float]] = {}

    def vector(self, head: str) -> dict[str, float]:
        if head not in self._vectors:
            if len(self._vectors) > 100_000:
                self._vectors.clear()
            tf = Counter(grams(head))
            raw = {gram: n * (math.log(self.heads / min(self.heads, self.frequency.get(gram, 1))) + 1) for gram, n in tf.items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            self._vectors[head] = {gram: w / norm for gram, w in raw.items()}
        return self._vectors[head]

    def __call__(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        v, w = self.vector(a), self.vector(b)
        return sum(x * w[gram] for gram, x in v.items() if gram in w)

    def agreement(self, a: str, b: str) -> float:
        """The root of the cosine, since a slip spoils two or three n-grams; 0 of heads with more than FAR edits."""
        cosine = self(a, b)
        return 0.0 if cosine <= 0.0 or a != b and edits(a, b, FAR) > FAR else math.sqrt(min(1.0, cosine))


def grams(head: str, n: int = LINK_GRAM) -> list[str]:
    padded = f"^{head}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _cosine(heads: DataFrame) -> Cosine:
    """The weights of n-grams in more than 1/COMMON_SHARE of the heads (kind, head); rarer ones have the greatest weight."""
    padded = F.concat(F.lit("^"), "head", F.lit("$"))
    found = heads.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("head") + 3 - LINK_GRAM), lambda i: F.substring(padded, i, LINK_GRAM)))).alias("gram"))
    total = heads.count()
    return Cosine(total, {row.gram: row.n for row in found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, total / COMMON_SHARE)).collect()})


def similar_heads(heads: DataFrame, least: float = LEAST_COSINE, gram: int = GRAM, starts: DataFrame | None = None) -> DataFrame:
    """(kind, a, b), a < b: candidates among heads of one kind, all within four edits whose n-gram vectors have at least this cosine.

    With starts (kind, head, start), only heads that have a start in common
    are compared; the weights are those of all heads.

    Exact: a vector's n-grams are ordered by rarity and only those are indexed
    before which the remaining norm falls under the least cosine, since two
    vectors that share none of them cannot reach it.
    """
    padded = F.concat(F.lit("^"), "head", F.lit("$"))
    grams = heads.where(F.length("head") >= gram - 1).select("kind", "head", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("head") + 2 - gram + 1), lambda i: F.substring(padded, i, gram))).alias("at", "gram")).groupBy("kind", "head", "gram").agg(F.count(F.lit(1)).alias("tf"), F.min("at").alias("first"), F.max("at").alias("last"))
    total = heads.groupBy("kind").agg(F.count(F.lit(1)).alias("heads"))
    frequency = grams.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("df"))
    weighted = grams.join(frequency, ["kind", "gram"]).join(F.broadcast(total), "kind").withColumn("w", F.col("tf") * (F.log(F.col("heads") / F.col("df")) + 1.0))
    norm = Window.partitionBy("kind", "head")
    rare_first = norm.orderBy(F.col("w").desc(), "gram").rowsBetween(Window.unboundedPreceding, -1)
    unit = weighted.withColumn("share", F.col("w") * F.col("w") / F.sum(F.col("w") * F.col("w")).over(norm))
    index = cut_lineage(unit.withColumn("before", F.coalesce(F.sum("share").over(rare_first), F.lit(0.0))).where(F.lit(1.0) - F.col("before") >= least * least).select("kind", "head", "gram", "first", "last"))
    keys = ["kind", "gram"]
    if starts is not None:
        index, keys = index.join(starts.select("kind", "head", "start").distinct(), ["kind", "head"]), ["kind", "gram", "start"]
    left = index.select(*keys, F.col("head").alias("a"), F.col("first").alias("first_a"), F.col("last").alias("last_a"))
    right = index.select(*keys, F.col("head").alias("b"), F.col("first").alias("first_b"), F.col("last").alias("last_b"))
    # two edits move an n-gram by two places at most; an exchange counts as two
    near = "a < b AND abs(length(a) - length(b)) <= 2 AND first_a <= last_b + 2 AND first_b <= last_a + 2"
    return left.join(right, keys).where(near).where("levenshtein(a, b, 4) >= 0").select("kind", "a", "b").distinct()


def dropped(head: str) -> set[str]:
    """A head with up to one letter dropped, or two if it is long enough for two edits."""
    found = {head}
    for _ in range(2 if len(head) >= TWO_EDITS else 1):
        found |= {word[:at] + word[at + 1 :] for word in found for at in range(len(word))}
    return found


def _drops(word: Column) -> Column:
    """The words that dropping one letter leaves."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _stretches(word: Column) -> Column:
    """Fifths of a long word, each also shifted by up to two letters, with their number and length.

    Two edits touch four of five neighbouring fifths at most and shift the
    fifth by two letters at most. Words whose lengths differ by up to two
    letters have a length of fifths in common.
    """
    sizes = F.array_distinct(F.transform(F.sequence(F.length(word) - 2, F.length(word) + 2), lambda n: F.floor(n / 5).cast("int")))
    at = lambda k, j: F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda shift: F.concat_ws("|", k, j, F.substring(word, F.greatest(j * k + 1 + shift, F.lit(1)), k)))
    return F.flatten(F.transform(sizes, lambda k: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: at(k, j)))))


def near_heads(heads: DataFrame) -> DataFrame:
    """(kind, a, b), a < b: heads of one kind that two edits may join (one, of short heads), and a few others.

    Exact: each edit, an exchange of neighbours included, is undone by dropping
    one letter at most from each side, so heads that _slip accepts become equal
    by dropping letters; of heads beyond LONG, whose ways to drop two letters
    are too many, a fifth is left whole.
    """
    none = F.array().cast("array<string>")
    size = F.length("head")
    once = _drops(F.col("head"))
    twice = F.when(size >= TWO_EDITS, F.flatten(F.transform(once, _drops))).otherwise(none)
    shorter = F.when(size <= LONG + 2, F.concat(F.array("head"), once, twice)).otherwise(none)
    longer = F.when(size > LONG - 2, _stretches(F.col("head"))).otherwise(none)
    # equal hashes of different words only add candidates
    hashes = F.array_distinct(F.transform(F.concat(shorter, longer), lambda word: F.xxhash64(word)))
    partitions = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = heads.where(size >= LEAST_HEAD).select("kind", "head").repartition(partitions, "head").select("kind", "head", F.explode(hashes).alias("word"))
    groups = words.groupBy("kind", "word").agg(F.collect_set("head").alias("group")).where(F.size("group") > 1)
    beyond = lambda a: F.filter("group", lambda b: (a < b) & (F.abs(F.length(a) - F.length(b)) <= 2))
    pairs = F.flatten(F.transform("group", lambda a: F.transform(beyond(a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return groups.select("kind", F.explode(pairs).alias("p")).select("kind", "p.a", "p.b").distinct()


def _common(names: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Given names and words of organisations with more than 1/COMMON_SHARE of all tokens of their kind, by count; at most COMMON_SHARE of each."""
    counts = cut_lineage(names.mapInArrow(_tokens, "kind string, token string, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")))
    found: dict[str, dict[str, int]] = {"given": {}, "organisation": {}}
    total = {row.kind: row.n for row in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = F.coalesce(*[F.when(F.col("kind") == kind, n / COMMON_SHARE) for kind, n in total.items()], F.lit(0.0))
    for row in counts.where((F.col("n") > least) & (F.col("n") > 1)).collect():
        found[row.kind][row.token] = row.n
    return found["given"], found["organisation"]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, token, n) of names (name, n): given names after a comma, and the words of organisations."""
    for batch in batches:
        out: list[tuple[str, str, int]] = []
        for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if _HAN.search(name):
                continue
            if is_organisation(name):
                words = [token.lower() for token in _TOKEN.findall(name) if not token.endswith(".")]
                out += [("organisation", word, n) for word in words if word not in _SMALL and len(word) > 2]
            elif "," in name:
                out += [("given", token.rstrip(".").lower(), n) for token in _TOKEN.findall(name.partition(",")[2]) if len(token.rstrip(".")) > 2]
        kinds, tokens, counts = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], names=["kind", "token", "n"])


def clusters(rows: DataFrame, id_col: str, authors: str) -> DataFrame:
    """(id, cluster): rows whose first-listed author is the same person or organisation share a cluster."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(first_author(full)) for full in batch.column(1).to_pylist()], pa.string())], names=["id", "name"])

    written = rows.select(F.col(id_col).cast("long").alias("id"), F.col(authors).alias("full")).where(F.length(F.trim("full")) > 0)
    named = cut_lineage(written.mapInArrow(read, "id long, name string").where("length(name) > 0"))
    names = cut_lineage(named.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    words = Words(*_common(names))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            parsed = [words.parse(text) or ("other", text, "", "") for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([part[i] for part in parsed], pa.string()) for i in range(4)]], names=["name", "n", "kind", "head", "given", "middle"])

    parsed = cut_lineage(names.mapInArrow(parse, "name string, n long, kind string, head string, given string, middle string"))
    forms = parsed.groupBy("kind", "head", "given", "middle").agg(F.sum("n").alias("n"))
    # names of one head agree only if their given names begin alike (organisations: if their bodies are equal)
    start = F.when(F.col("kind") == "person", F.substring("given", 1, 1)).otherwise(F.col("given"))
    forms = cut_lineage(forms.withColumn("start", start).withColumn("form", F.concat_ws("\x1f", "kind", "head", "given", "middle")))
    blocks = cut_lineage(forms.groupBy("kind", "start", "head").agg(F.min("form").alias("first")))
    heads = cut_lineage(forms.where(F.col("kind").isin("person", "organisation")).groupBy("kind", "head").agg(F.sum("n").alias("n")))
    candidates = similar_heads(heads, starts=blocks).unionByName(near_heads(heads)).distinct()
    joined, cosine = _slips(candidates, heads), _cosine(heads)
    sides = joined.join(blocks.withColumnsRenamed({"head": "a", "first": "form_a"}), ["kind", "a"]).join(blocks.withColumnsRenamed({"head": "b", "first": "form_b"}), ["kind", "b", "start"])
    # components are those of blocks (kind, start, head), whose first form names them
    component = connected_components(blocks.select(F.col("first").alias("id")), sides.select(F.col("form_a").alias("a"), F.col("form_b").alias("b")))
    placed = forms.join(blocks, ["kind", "start", "head"]).join(component.withColumnsRenamed({"id": "first"}), "first")
    settled = placed.select("component", "form", "head", "given", "middle", "n").repartition("component").sortWithinPartitions("component").mapInArrow(lambda batches: _settle_all(batches, cosine), "form string, cluster string")
    of_name = parsed.select("name", "n", F.concat_ws("\x1f", "kind", "head", "given", "middle").alias("form")).join(settled, "form").select("name", "n", "cluster")
    return attach_group(named, of_name, ["name"], "n").select("id", "cluster")


def _slips(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs of heads one edit apart, or two if one of them is rare beside the other."""
    counts = heads.select("kind", "head", "n")
    known = pairs.join(counts.withColumnsRenamed({"head": "a", "n": "n_a"}), ["kind", "a"]).join(counts.withColumnsRenamed({"head": "b", "n": "n_b"}), ["kind", "b"]).select("kind", "a", "b", "n_a", "n_b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            yield batch.filter(pa.array([_slip(a, b, n_a, n_b) for _, a, b, n_a, n_b in zip(*columns)], pa.bool_()))

    return known.mapInArrow(keep, known.schema).select("kind", "a", "b")


def _slip(a: str, b: str, n_a: int, n_b: int) -> bool:
    if close(a, b):
        return min(len(a), len(b)) >= LEAST_HEAD
    return min(len(a), len(b)) >= TWO_EDITS and max(n_a, n_b) >= TWO_EDITS_RATIO * min(n_a, n_b) and edits(a, b) == 2


def _settle_all(batches: Iterator[pa.RecordBatch], cosine: Cosine) -> Iterator[pa.RecordBatch]:
    """Clusters of components that come one after the other; a component may go over several batches."""
    rows: list[tuple] = []
    last = None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for component, *row in zip(*(column.to_pylist() for column in batch.columns)):
            if component != last and rows:
                done += settle(rows, cosine)
                rows = []
            last = component
            rows.append(tuple(row))
        yield _pairs(done)
    yield _pairs(settle(rows, cosine))


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    forms, clusters_ = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(clusters_, pa.string())], names=["form", "cluster"])


def settle(component: list[tuple[str, str, str, str, int]], cosine: Cosine) -> list[tuple[str, str]]:
    """(form, cluster) of the rows (form, head, given, middle, n) of a component; each cluster is named by its first form."""
    if len(component) < 2:
        return [(row[0], row[0]) for row in component]
    rows = sorted(component)
    by_given: dict[str, list[int]] = {}
    for i, (_, _, given, _, _) in enumerate(rows):
        by_given.setdefault(given, []).append(i)
    heads: dict[tuple[str, str], float] = {}
    similarity: dict[tuple[int, int], float] = {}

    def compare(i: int, j: int) -> None:
        agreement = _agreement(rows[i][2:4], rows[j][2:4])
        if agreement:
            pair = (rows[i][1], rows[j][1])
            if pair not in heads:
                heads[pair] = cosine.agreement(*pair)
            if heads[pair]:
                similarity[min(i, j), max(i, j)] = heads[pair] * agreement

    for given, own in by_given.items():
        for i, j in combinations(own, 2):
            compare(i, j)
        if len(given) > 1:
            for i in by_given.get(given[0], ()):
                for j in own:
                    compare(i, j)
    label = average_linkage(similarity, [row[4] for row in rows], LINK)
    return [(row[0], rows[k][0]) for row, k in zip(rows, label)]


def same_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs within clusters."""
    return pairs_within(cut_lineage(found), "cluster", "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
