"""Blood relations: what each says of a pair, and the words that name them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (relation, label, generations of A above B, link, side, sex of A, sex of B, is A older).
RELATIONS = [
    ("father", "父亲", 1, "parent", None, "M", None, None),
    ("mother", "母亲", 1, "parent", None, "F", None, None),
    ("son", "儿子", -1, "parent", None, "M", None, None),
    ("daughter", "女儿", -1, "parent", None, "F", None, None),
    ("elder_brother", "哥哥", 0, "sibling", None, "M", None, True),
    ("younger_brother", "弟弟", 0, "sibling", None, "M", None, False),
    ("elder_sister", "姐姐", 0, "sibling", None, "F", None, True),
    ("younger_sister", "妹妹", 0, "sibling", None, "F", None, False),
    ("brother", "兄弟（长幼不明）", 0, "sibling", None, "M", None, None),
    ("sister", "姐妹（长幼不明）", 0, "sibling", None, "F", None, None),
    ("paternal_grandfather", "祖父 / 爷爷", 2, "grand", "paternal", "M", None, None),
    ("paternal_grandmother", "祖母 / 奶奶", 2, "grand", "paternal", "F", None, None),
    ("maternal_grandfather", "外祖父 / 外公 / 姥爷", 2, "grand", "maternal", "M", None, None),
    ("maternal_grandmother", "外祖母 / 外婆 / 姥姥", 2, "grand", "maternal", "F", None, None),
    ("grandson", "孙子", -2, "grand", "paternal", "M", None, None),
    ("granddaughter", "孙女", -2, "grand", "paternal", "F", None, None),
    ("daughters_son", "外孙", -2, "grand", "maternal", "M", None, None),
    ("daughters_daughter", "外孙女", -2, "grand", "maternal", "F", None, None),
    ("paternal_uncle", "伯父 / 叔叔", 1, "uncle", "paternal", "M", None, None),
    ("paternal_aunt", "姑姑", 1, "uncle", "paternal", "F", None, None),
    ("maternal_uncle", "舅舅", 1, "uncle", "maternal", "M", None, None),
    ("maternal_aunt", "姨妈 / 姨母", 1, "uncle", "maternal", "F", None, None),
    ("nephew", "侄子", -1, "uncle", "paternal", "M", None, None),
    ("niece", "侄女", -1, "uncle", "paternal", "F", None, None),
    ("sisters_son", "外甥", -1, "uncle", "maternal", "M", None, None),
    ("sisters_daughter", "外甥女", -1, "uncle", "maternal", "F", None, None),
    ("tang_cousin", "堂兄弟姐妹", 0, "cousin", "堂", None, None, None),
    ("biao_cousin", "表兄弟姐妹", 0, "cousin", "表", None, None, None),
]

#: A relation that can't hold beside each one.
CONTRARY = {
    "father": "paternal_uncle", "mother": "maternal_aunt", "son": "nephew", "daughter": "niece",
    "elder_brother": "younger_brother", "younger_brother": "elder_brother", "elder_sister": "younger_sister", "younger_sister": "elder_sister",
    "paternal_uncle": "maternal_uncle", "maternal_uncle": "paternal_uncle", "paternal_aunt": "maternal_aunt", "maternal_aunt": "paternal_aunt",
    "paternal_grandfather": "father", "maternal_grandfather": "father",
}

#: The words for each relation.
TERMS = {
    "father": "父亲 父 爹 爹爹 阿爹 爸 爸爸 老爸 家父 生父 先父 令尊 父王 父皇 爹地",
    "mother": "母亲 母 娘 娘亲 阿娘 妈 妈妈 老妈 家母 生母 先母 令堂 母后 母妃 额娘",
    "son": "儿子 儿 犬子 长子 次子 幼子 独子 令郎 世子",
    "daughter": "女儿 闺女 长女 次女 幼女 独女 小女 令爱 千金",
    "elder_brother": "哥哥 哥 兄长 兄 胞兄 家兄 王兄 皇兄",
    "younger_brother": "弟弟 弟 胞弟 舍弟 王弟 皇弟",
    "elder_sister": "姐姐 姐 胞姐 家姐 阿姐",
    "younger_sister": "妹妹 妹 胞妹 舍妹",
    "brother": "兄弟",
    "sister": "姐妹",
    "paternal_grandfather": "爷爷 爷 祖父 家祖 阿爷 皇爷爷",
    "paternal_grandmother": "奶奶 祖母 阿奶",
    "maternal_grandfather": "外公 外祖父 姥爷 外祖",
    "maternal_grandmother": "外婆 外祖母 姥姥",
    "grandson": "孙子 孙儿 孙",
    "granddaughter": "孙女",
    "daughters_son": "外孙",
    "daughters_daughter": "外孙女",
    "paternal_uncle": "伯父 伯伯 伯 叔叔 叔父 叔",
    "paternal_aunt": "姑姑 姑妈 姑母 姑",
    "maternal_uncle": "舅舅 舅父 舅",
    "maternal_aunt": "姨妈 姨母 姨娘 姨",
    "nephew": "侄子 侄儿 侄",
    "niece": "侄女",
    "sisters_son": "外甥",
    "sisters_daughter": "外甥女",
    "tang_cousin": "堂兄 堂哥 堂弟 堂姐 堂妹 堂兄弟 堂姐妹",
    "biao_cousin": "表兄 表哥 表弟 表姐 表妹 表兄弟 表姐妹",
}
#: Words for two people at once; words that only look like kin; ranks before a word.
COLLECTIVE = "父子 父女 母子 母女 兄弟俩 姐弟 兄妹 姐妹俩 夫妇 夫妻 爹娘 父母 爸妈 双亲 祖孙 叔侄 舅甥 兄弟们 姐妹们".split()
NOT_KIN = "小姐 老子 老弟 老兄 兄台 贤弟 贤兄 大姐头 老爷 少爷 王爷 姑娘 大娘".split()
RANK = "大二三四五六七八九十小老亲胞皇族幺"


def compositions() -> dict[str, str]:
    """"first|second" -> the relation of a relative's relative, from what the relations say.

    A parent's sibling is an uncle or aunt of the parent's side, a parent's parent a grandparent,
    a sibling's child a nephew or niece by the sibling's sex, a child's child a grandchild by the
    child's sex, and an uncle's or aunt's child a cousin, of the own clan only for the father's brother.
    """
    sex = {r[0]: r[5] for r in RELATIONS}
    siblings = [r[0] for r in RELATIONS if r[3] == "sibling"]
    out = {}
    for parent, side in (("father", "paternal"), ("mother", "maternal")):
        out |= {f"{parent}|{s}": f"{side}_{'uncle' if sex[s] == 'M' else 'aunt'}" for s in siblings}
        out |= {f"{parent}|{p}": f"{side}_grand{p}" for p in ("father", "mother")}
    for child in ("son", "daughter"):
        boy = child == "son"
        out |= {f"{s}|{child}": ("nephew" if boy else "niece") if sex[s] == "M" else f"sisters_{child}" for s in siblings}
        out |= {f"son|{child}": f"grand{child}", f"daughter|{child}": f"daughters_{child}", f"paternal_uncle|{child}": "tang_cousin"}
        out |= {f"{x}|{child}": "biao_cousin" for x in ("paternal_aunt", "maternal_uncle", "maternal_aunt")}
    return out


def _as_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _any_of(words: list[str]) -> str:
    """A pattern that finds any of the words: a class for the first characters, then the words that hold no shorter one."""
    least = sorted(w for w in set(words) if not any(v in w for v in set(words) - {w}))
    return f"(?=[{''.join(sorted({w[0] for w in least}))}])(?:{'|'.join(least)})"


_RELATION = {w: r for r, ws in TERMS.items() for w in ws.split()}
_NO_TERM, _TWO, _KIN_TERM = _any_of(NOT_KIN + COLLECTIVE), _any_of(COLLECTIVE), _any_of(list(_RELATION))
#: What (?U)\s is.
_SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _known(word: Column) -> Column:
    """The word of the list that a word without chains is, its ending and the ranks before it aside; else null. A hashed set tells, not a walk through the list."""
    word = F.regexp_replace(word, "们?(?:大人)?$", "")
    bare = F.ltrim(word, F.lit(RANK))
    return F.when(word.isin(*_RELATION), word).when(bare.isin(*[w for w in _RELATION if w not in ("儿", "孙")]), bare)


def _chain(term: Column) -> Column:
    words, composed = _as_map(_RELATION), _as_map(compositions())
    steps = F.transform(F.split(term, "的", -1), lambda word: words[_known(word)])
    return F.aggregate(F.slice(steps, 2, 99), F.element_at(steps, 1), lambda a, x: composed[F.concat_ws("|", F.coalesce(a, F.lit("?")), F.coalesce(x, F.lit("?")))])


def term_relation(term: Column) -> Column:
    """The blood relation that a word names, chains ("母亲的哥哥") composed step by step; else null."""
    trimmed = F.btrim(term, F.lit(_SPACES))
    known = (F.length(trimmed) > 0) & ~trimmed.rlike(_NO_TERM)
    return F.when(known, F.when(trimmed.contains("的"), _chain(trimmed)).otherwise(_as_map(_RELATION)[_known(trimmed)]))


def names_kin(term: Column) -> Column:
    """Whether a word names a blood relation; false for null."""
    trimmed = F.btrim(term, F.lit(_SPACES))
    found = F.when(trimmed.contains("的"), _chain(trimmed).isNotNull()).otherwise(_known(trimmed).isNotNull())
    return F.coalesce(F.when(found, ~trimmed.rlike(_NO_TERM)), F.lit(False))


def stated_relation(term: Column, quote: Column, collective: Column) -> Column:
    """The relation that a statement gives, or null: a word for two people, an unknown word, one that
    the quote doesn't have, or the end of a chain taken alone.

    A chain's end has a kin word and 的 before it; a kin word of one character counts only alone or
    behind a pronoun. Ranks in front of the term go with it.
    """
    relation = term_relation(F.trim(term))
    at = F.call_function("instr", quote, F.trim(term))
    before = F.rtrim(F.substring(quote, F.lit(1), at - 1), F.lit(RANK))
    owner = F.regexp_replace(before, "的$", "")
    ends = [F.when(F.length(owner) >= n, F.substring(owner, -n, n)) for n in (2, 3, 4)]
    single = F.when((F.length(owner) == 1) | owner.rlike("[我你他她其咱俺].$"), F.substring(owner, -1, 1))
    chained = F.lit(False)
    for word in [*ends, single]:
        chained = chained | names_kin(word)
    return F.when(~collective & (at > 0) & ~(before.endswith("的") & chained), relation)


def valid_kinship(relation: Column, not_blood: Column, mention: Column, name: Column, other: Column, other_name: Column, quote: Column) -> Column:
    """Whether a kinship statement can stand: by blood, between two different people, in a quote with a kin word."""
    people = lambda who, known: known.isNotNull() | ~(names_kin(who) | who.rlike(_TWO))
    plain = lambda x: F.lower(F.regexp_replace(x, "[\\s\\p{P}\\p{Z}\\p{C}]", ""))
    return relation.isNotNull() & ~not_blood & people(mention, name) & people(other, other_name) & (plain(mention) != plain(other)) & quote.rlike(_KIN_TERM)
