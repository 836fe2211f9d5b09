"""Queries: what words and quotes mean, over every row of lineitem, each composed from the row's columns.

A row's numbers choose the parts of its words, in thousands of forms; the expressions that put
them together are read alike by Spark and DuckDB. The oracles tell the answer from the parts that were
chosen, by rule, not from the words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.catalog import query
from taleweave.functions import kin, looks, names, text
from taleweave.operators import checks, ledger
from taleweave.plans.projections import table

_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
#: Numbers of a row that choose parts, so that the choices don't move together.
A, B, C, D = "(l_partkey * 7 + l_suppkey)", "(l_orderkey + l_partkey)", "(l_suppkey * 3 + l_linenumber)", "(l_orderkey * 5 + l_linenumber * 11 + l_partkey)"


def _pick(number: str, words: list | tuple) -> str:
    """The word that a number chooses."""
    return f"split_part('{'|'.join(words)}', '|', cast({number} % {len(words)} as int) + 1)"


def _by(number: str, *forms: str) -> str:
    """The expression that a number chooses."""
    return f"(case {number} % {len(forms)} " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end)"


def _rows(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_ID.split(", "), *[f"{v} as `{k}`" for k, v in columns.items()])


def _sql(rules: dict[str, str], **columns: str) -> str:
    """DuckDB SQL for the composed columns and, over them and the row's numbers, the answers by rule."""
    given = ", ".join(f'{v} as "{k}"' for k, v in columns.items())
    return f"select {_ID}, {', '.join(f'{chr(34)}{k}{chr(34)}' for k in columns)}, {', '.join(f'{v} as {chr(34)}{k}{chr(34)}' for k, v in rules.items())} from (select *, {given} from lineitem)"


_KIN_WORDS = [w for ws in kin.TERMS.values() for w in ws.split()]
_RELATION_OF = {w: r for r, ws in kin.TERMS.items() for w in ws.split()}
_RANKS, _ENDS = ["", "大", "三", "亲", ""], ["", "大人", "们", ""]
_FIRST = f"{_pick(D, _RANKS)} || {_pick(A, _KIN_WORDS)} || {_pick(C, _ENDS)}"
_TERM = {"term": _by(B, _FIRST, f"{_FIRST} || '的' || {_pick(D, _KIN_WORDS)}", f"{_pick(A, ['甲', '石', '无'])} || {_pick(C, _KIN_WORDS)}")}


def _relation(word: str) -> str:
    """What a word without its ending names: itself, or without the ranks before it."""
    table_of = lambda x: f"(select max(r) from words where w = {x})"
    return f"coalesce({table_of(word)}, case when {word} not in ('儿', '孙') and ltrim({word}, '{kin.RANK}') not in ('儿', '孙') or {word} in ('儿', '孙') then {table_of(f"ltrim({word}, '{kin.RANK}')")} end)"


_WORDS_SQL = "words as (select * from (values " + ", ".join(f"('{w}', '{r}')" for w, r in _RELATION_OF.items()) + ") t(w, r)), pairs as (select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in kin.compositions().items()) + ") t(k, r))"
_NO_KIN = "'" + "|".join(kin.NOT_KIN + kin.COLLECTIVE) + "'"


@query(f"""with {_WORDS_SQL}, t as (select *, {_TERM['term']} as term from lineitem),
s as (select *, regexp_replace(regexp_replace(split_part(term, '的', 1), '大人$', ''), '们$', '') as one, regexp_replace(regexp_replace(split_part(term, '的', 2), '大人$', ''), '们$', '') as two from t),
u as (select distinct term, one, two from s), r as (select *, {_relation('one')} as r1, {_relation('two')} as r2 from u)
select {', '.join('s.' + c for c in _ID.split(', '))}, s.term, case when regexp_matches(s.term, {_NO_KIN}) then null when contains(s.term, '的') then (select max(p.r) from pairs p where p.k = r1 || '|' || r2) else r1 end as relation from s join r using (term)""")
def kin_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that every row's word names: ranks, endings, chains of two."""
    return _rows(spark, sf_dir, **_TERM).select("*", kin.term_relation(F.col("term")).alias("relation"))


_SURNAMES, _GIVEN, _OTHERS = ["沈", "林", "顾", "苏", "白"], ["墨", "舟", "衡", "璃", "岳", "川"], ["铁匠", "清风", "阿福"]
_NAME, _NAME2 = f"{_pick(A, _SURNAMES)} || {_pick(B, _GIVEN)}", f"{_pick(C, _SURNAMES)} || {_pick(D, _GIVEN)}"
_PLAIN_TITLES = [t for t in names.TITLES if len(t) > 1 and t not in names.SUFFIXES]
_MENTION_FORMS = [
    (_NAME, "false"), (f"{_NAME} || {_pick(C, _GIVEN)}", "false"), (f"{_pick(A, ['那', '这', '此', '该', '那个'])} || {_pick(B, names.SUFFIXES)}", "true"), (f"{_pick(A, ['黑衣', '白发', '无名'])} || {_pick(B, names.SUFFIXES)}", "true"),
    (f"{_NAME} || {_pick(D, ['和', '与', '跟', '及', '同'])} || {_NAME2}", "true"), (f"{_pick(A, ['一', '三', '几', '十'])} || {_pick(B, ['个', '名', '位', '群'])} || {_pick(C, ['刀修', '剑客', '旅人'])}", "true"),
    (f"{_pick(A, ['七', '十五', '二十', '33'])} || '岁的' || {_NAME}", "true"), (_pick(A, names.GENERIC), "true"), (f"{_pick(A, ['他', '我', '你的', '您', '咱'])} || {_pick(B, _KIN_WORDS)}", "true"), (f"{_NAME} || {_pick(C, names.GROUPS)}", "true"),
    (f"{_pick(A, ['Anna', 'Bo', 'Cyr'])} || ' ' || {_pick(B, ['Petrova', 'Li', 'von Ost'])} || case when {D} % 4 = 0 then ' of the Hill' else '' end", f"({D} % 4 = 0)"),
    (f"{_NAME} || {_NAME2} || {_NAME} || {_NAME2} || {_pick(A, _GIVEN)}", "true"), (f"{_pick(A, _SURNAMES)} || {_pick(B, ['长老', '掌门', '将军', '道长', '捕头'])}", "false"), (f"{_pick(A, ['某', '其中', '另一', '为首'])} || {_pick(B, ['书生', '剑客', '旅人'])}", "true"),
]
_MENTION = {"mention": _by(D, *[f for f, _ in _MENTION_FORMS])}


@query(_sql({"generic": _by(D, *[a for _, a in _MENTION_FORMS])}, **_MENTION))
def generic_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all rows' mentions can't be names."""
    return _rows(spark, sf_dir, **_MENTION).select("*", names.is_generic(F.col("mention")).alias("generic"))


_PAIR_FORMS = [
    (_NAME, f"{_pick(C, ['小', '欧阳'])} || {_NAME}", "true"), (f"{_NAME} || {_pick(D, _GIVEN)}", _NAME, "true"), (f"{_pick(A, _SURNAMES)} || {_pick(B, _GIVEN)} || '云'", f"{_pick(C, _SURNAMES)} || {_pick(B, _GIVEN)} || '石'", "true"),
    (f"{_pick(A, _SURNAMES)} || {_pick(C, _PLAIN_TITLES)}", _NAME, "true"), (f"{_pick(C, ['老', '小', '阿'])} || {_pick(A, _SURNAMES)}", _NAME, "true"), (f"{_pick(A, _SURNAMES)} || '思远'", f"{_pick(A, _SURNAMES)} || '采薇'", "false"),
    (_pick(A, _OTHERS), f"{_pick(B, _SURNAMES)} || {_pick(C, _GIVEN)}", "false"), (f"{_pick(A, _GIVEN)} || '儿'", f"{_pick(B, _SURNAMES)} || {_pick(A, _GIVEN)}", "true"),
]
_PAIR = {"alias": _by(D, *[a for a, _, _ in _PAIR_FORMS]), "name": _by(D, *[n for _, n, _ in _PAIR_FORMS])}


@query(_sql({"same": _by(D, *[s for _, _, s in _PAIR_FORMS])}, **_PAIR))
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every row's two names are one person's by their form."""
    return _rows(spark, sf_dir, **_PAIR).select("*", names.shares_name(F.col("alias"), F.col("name")).alias("same"))


_SHADES, _SHADE_OF = [w for w, _ in looks.COLOUR_WORDS], [c for _, c in looks.COLOUR_WORDS]
_BODY, _BODY_OF = [c for chars in looks.PARTS.values() for c in chars], [part for part, chars in looks.PARTS.items() for _ in chars]
_LOOK = {
    "quote": _by(B, f"{_pick(A, _SHADES)} || {_pick(C, _BODY)} || '，' || {_pick(D, _SHADES)} || {_pick(B, _BODY)}", f"'她有' || {_pick(A, _SHADES)} || '的' || {_pick(C, _BODY)}", f"'没有' || {_pick(C, _BODY)}", f"'异色的' || {_pick(C, _BODY)}"),
    "part": _pick("(l_linenumber + l_partkey)", ["eye_color", "hair_color"]),
}
_TWO = f"[{_pick(A, _SHADE_OF)}, {_pick(D, _SHADE_OF)}]"
_ITS = f"{_pick(C, _BODY_OF)} = part"


@query(_sql({"colours": _by(B, f"list_sort(list_distinct({_TWO}))", f"[{_pick(A, _SHADE_OF)}]", "[]", "['异色']"), "described": _by(B, f"({_ITS} or {_pick(B, _BODY_OF)} = part)", f"({_ITS})", "false", "false")}, **_LOOK))
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in every row's quote, and whose they are."""
    return _rows(spark, sf_dir, **_LOOK).select("*", looks.colours_in(F.col("quote")).alias("colours"), looks.describes("quote", "part").alias("described"))


_YEARS = _pick(A, ["二十", "四十", "九", "十五", "33", "108", "三百"])
_GUARD_FORMS = [  # kind, quote, valid
    ("'absolute_age'", f"{_NAME} || '已经' || {_YEARS} || '岁了'", "(value is not null and value <= 100000)"), ("'absolute_age'", f"'等了' || {_YEARS} || '年'", "false"), ("'absolute_age'", f"{_NAME} || '不到' || {_YEARS} || '岁'", "false"), ("'absolute_age'", f"'连' || {_YEARS} || '岁都没到'", "false"),
    ("'life_stage'", "'少女'", "stage is not null"), ("'birth_year'", f"'生于' || {_YEARS} || '年'", "true"),
]
_SPAN_FORMS = [(f"{a} || {_YEARS} || '年' || {b}", ahead) for a, b, ahead in (("'再过'", "''", "true"), ("'过去了'", "''", "false"), ("'如果能等'", "'的话'", "true"), ("'少说已过了'", "''", "false"), ("'约定'", "'之后'", "true"), ("'一晃'", "''", "false"), ("'在'", "'之内'", "true"))]
_GUARD = {
    "kind": _by(D, *[k for k, _, _ in _GUARD_FORMS]), "quote": _by(D, *[q for _, q, _ in _GUARD_FORMS]), "value": f"(case when {B} % 7 = 3 then null when {B} % 7 = 5 then 100001.0E0 else {B} % 150 * 1.0E0 end)", "stage": f"(case when {C} % 3 = 0 then null else 'teen' end)",
    "span_kind": _pick(C, ["advance", "future", "short", "retrospective"]), "span_quote": _by(A, *[q for q, _ in _SPAN_FORMS]), "years": f"(case when {D} % 5 = 0 then 0.05E0 else {D} % 9 * 1.0E0 end)",
}


@query(_sql({"valid": _by(D, *[v for _, _, v in _GUARD_FORMS]), "relabelled": f"case when span_kind <> 'advance' then span_kind when {_by(A, *[a for _, a in _SPAN_FORMS])} then 'future' when years < 1.0 / 12 then 'short' else 'advance' end"}, **_GUARD))
def statement_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's statement kept or not, and its span relabelled."""
    c = F.col
    return _rows(spark, sf_dir, **_GUARD).select("*", text.valid_age(c("kind"), c("quote"), c("value"), c("stage")).alias("valid"), text.span_kind(c("span_kind"), c("span_quote"), c("years")).alias("relabelled"))


_SIDE, _LIMB, _FILL, _SCAR = _pick(A, ["左", "右", ""]), _pick(B, ["手", "臂", "脸", "肩", "背", "小腿"]), _pick(C, ["半边", "边", "侧", ""]), _pick(D, ["刀疤", "烙印", "胎记", "红痣", "疤·旧"])
_MARK = {"value": _by("(l_linenumber + l_suppkey)", f"{_SIDE} || {_FILL} || {_LIMB} || '·' || {_SCAR}", f"{_LIMB} || {_SIDE} || {_FILL} || ' · ' || {_SCAR}", f"{_SIDE} || {_LIMB} || {_SCAR.replace('疤·旧', '旧疤')}", "null")}
_HAS = f"((l_linenumber + l_suppkey) % 4 < 2 and {_SIDE} <> '')"


@query(_sql({"side": f"case when {_HAS} then {_SIDE} end", "part": f"case when {_HAS} then {_LIMB} end", "kind": f"case when {_HAS} then {_SCAR} end"}, **_MARK))
def mark_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side, part and kind of every row's mark."""
    return checks.marks(_rows(spark, sf_dir, **_MARK))


_TRAIT = {
    "attribute": _pick(C, ["eye_color", "hair_color", "mark"]),
    "value": f"(case when {C} % 3 = 2 then {_by(A, _LIMB + " || '·' || " + _SCAR, _SCAR.replace('疤·旧', '旧疤'), "' '")} else {_pick(D, [*looks.COLOURS, '橙'])} end)",
    "quote": f"{_pick(A, _SHADES)} || {_pick(B, _BODY)} || {_pick(D, ['', '很美', '的人'])}",
}


@query(_sql({
    "valid": f"case when attribute = 'mark' then contains(value, '·') else value <> '橙' and {_pick(B, _BODY_OF)} = attribute end", "colour": f"case when attribute <> 'mark' then {_pick(A, _SHADE_OF)} end"}, **_TRAIT))
def character_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every row's statement about looks stands, and the colour that its quote gives (F16)."""
    rows = _rows(spark, sf_dir, **_TRAIT)
    colour = F.when(F.col("attribute").isin("eye_color", "hair_color"), looks.named_colour(F.col("value"), F.col("quote")))
    return rows.select("*", looks.valid_trait(F.col("attribute"), F.col("value"), F.col("quote"), F.lit(False)).alias("valid"), colour.alias("colour"))


#: Words of two characters that begin with no rank, and what each says.
_SURE = [(w, r) for w, r in _RELATION_OF.items() if len(w) == 2 and w[0] not in kin.RANK and not any(x in w for x in kin.NOT_KIN + kin.COLLECTIVE)]
_CALL = _pick(A, [w for w, _ in _SURE])
_KIN_FORMS = [("other || '的' || term || '来了'", "true"), ("'他是' || other || term", "true"), (f"other || {_pick(B, [w for w, _ in _SURE])} || '的' || term || '来了'", f"({_pick(B, [w for w, _ in _SURE])} = term)"), (f"{_pick(B, [w for w, _ in _SURE][:20])} || '没有提到'", f"contains({_pick(B, [w for w, _ in _SURE][:20])}, term)"), ("other || '的三' || term || '走了'", "true")]
_PEOPLE = {"term": _CALL, "collective": f"({C} % 5 = 0)", "mention": _by(B, _NAME, "'爹娘'", _NAME2), "other": f"(case when {D} % 6 = 0 then {_by(B, _NAME, _NAME, _NAME2)} else {_pick(C, _SURNAMES)} || '青山' end)"}
_SAID = _by(D, *[q for q, _ in _KIN_FORMS])
_STANDS = f"(not collective and {_by(D, *[s for _, s in _KIN_FORMS])})"


@query(f"""select {_ID}, term, collective, mention, other, quote, case when {_STANDS} then {_pick(A, [r for _, r in _SURE])} end as relation, {_STANDS} and mention <> '爹娘' and mention <> other as valid
from (select *, {_SAID} as quote from (select *, {', '.join(f'{v} as "{k}"' for k, v in _PEOPLE.items())} from lineitem))""")
def kinship_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation that every row's statement gives, and whether it stands."""
    people = table(spark, sf_dir, "lineitem").selectExpr("*", *[f"{v} as `{k}`" for k, v in _PEOPLE.items()])
    rows = people.selectExpr(*_ID.split(", "), *_PEOPLE, f"{_SAID} as quote")
    c, none = F.col, F.lit(None).cast("string")
    rows = rows.withColumn("relation", kin.stated_relation(c("term"), c("quote"), c("collective")))
    return rows.select("*", kin.valid_kinship(c("relation"), F.lit(False), c("mention"), none, c("other"), none, c("quote")).alias("valid"))


_CODE = f"(400 + {A} % 150)"
_NOTE = _pick(D, ["see the docs", "try again", "bad payload"])
_MESSAGE_FORMS = [
    (f"'Error code: ' || cast({_CODE} as varchar(9)) || ' - ' || {_NOTE}", f"case when {_CODE} = 429 then 'rate_limit' when {_CODE} between 401 and 403 then 'auth' when {_CODE} >= 500 then 'server' else 'bad_request' end"),
    (f"'Request timeout: ' || {_NOTE}", "'network'"), (f"'blocked by ' || {_pick(B, ['content_filter', 'Content Filter', 'ContentFilter', 'content-filter'])} || cast({_CODE} as varchar(9))", "'content_filter'"), (f"{_pick(B, ['Rate limit', 'rate_limit', 'RateLimit'])} || ' reached, ' || {_NOTE}", "'rate_limit'"),
    (f"{_pick(B, ['Unauthorized', 'Incorrect API key', 'Insufficient Balance'])} || ', ' || {_NOTE}", "'auth'"), (f"{_pick(C, ['Connection reset', 'connection refused'])} || ', ' || {_NOTE}", "'network'"), (f"'x' || cast({_CODE} as varchar(9)) || ' ' || {_NOTE}", "'bad_request'"),
]
_ERROR = {"message": _by(C, *[m for m, _ in _MESSAGE_FORMS])}


@query(_sql({"kind": _by(C, *[k for _, k in _MESSAGE_FORMS])}, **_ERROR))
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider errors by class."""
    return _rows(spark, sf_dir, **_ERROR).select("*", ledger.error_kind().alias("kind"))
