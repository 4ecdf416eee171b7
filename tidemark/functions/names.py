"""Forms of names as column expressions: what is a name and what a title, cores without titles, short forms, relatedness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for anyone.
PRONOUNS = "i me my he him his she her it we us you they them myself himself herself someone somebody nobody everyone stranger 他 她 它 他们 她们 我 你 您 我们 你们 咱们 自己 人家 对方 此人 那人 这人 有人 某人 众人 来人 旁人 别人 他人 路人 大家 所有人 其他人 其余人 另一人 一人 二人 两人 三人 神秘人"
# Kinship words, titles and trades that can mean anyone.
GENERIC_LATIN = (
    "father mother dad mum mom papa mamma son daughter husband wife sir madam ma'am miss mister mrs mr lady lord gentleman gentlemen doctor physician surgeon lawyer attorney clerk servant maid housekeeper cook butler "
    "footman coachman landlord landlady master mistress boy girl child baby man woman men women lad lass fellow brother sister uncle aunt nephew niece cousin grandfather grandmother grandpa grandma king queen prince princess "
    "duke duchess earl count countess baron baroness captain colonel general major sergeant soldier officer constable inspector judge magistrate prisoner convict parson vicar priest clergyman curate reverend bishop nurse governess "
    "schoolmaster teacher pupil student friend neighbour neighbor visitor guest host hostess stranger bride bridegroom widow widower orphan beggar driver porter waiter waitress shopkeeper merchant sailor fisherman farmer blacksmith "
    "smith guard keeper doorman secretary partner person people creature figure thing one other others"
)
GENERIC_HAN = "父亲 母亲 爸爸 妈妈 爹 娘 儿子 女儿 丈夫 妻子 太太 夫人 先生 老爷 小姐 姑娘 少女 女孩 少年 男孩 青年 少爷 医生 大夫 校长 老师 神父 堂长 老板 老板娘 仆人 女仆 老头子 老太太 老头 孩子 哥哥 姐姐 弟弟 妹妹 叔叔 伯父 舅舅 姑妈 姨妈 祖父 祖母 爷爷 奶奶 外公 外婆 公公 婆婆 岳父 岳母 丈人 主人 客人 新娘 新郎 寡妇 邻居 朋友 同学 学生 病人 国王 王后 皇帝 公爵 伯爵 侯爵 男爵 大人 老人 年轻人 女人 男人 女婿 媳妇 儿媳 闺女 商人 妇人 男子 女子 内人 仆役 听差 差役 守卫 向导 和尚 尼姑"
# What may stand before a description, titles before and after names, words of names that tell nothing.
LEADING = "the a an this that these those my his her their our your old young little poor dear good elder younger"
TITLES = "mr mrs miss ms dr sir lady lord uncle aunt captain capt master mister madame madam monsieur mademoiselle father mother brother sister old young little professor colonel major general reverend rev"
SUFFIXES = "先生 太太 夫人 小姐 老爹 老头子 老头 嫂子 大妈 大娘 大爷 老爷 少爷 姑娘 女士 博士 医生 律师 师傅 掌柜 老板 公子 奶奶 大师 禅师 法师 道长 真人 长老 师兄 师姐 师弟 师妹 师父 大哥 大姐 爷 嫂 娘"
EMPTY_WORDS = "the of a an and de la le du von van old young little mr mrs miss sir lady lord"
GROUPS_HAN, GROUPS_LATIN = "夫妇|夫妻|们|一家|俩|的", r"(?:^|[^a-z])(?:and|family|brothers|sisters|folks|people)(?:[^a-z]|$)|'s(?:[^a-z]|$)"

HAN = r"[\x{3400}-\x{9fff}]"
LEADING_PATTERN = "^(?:(?:" + "|".join(LEADING.split()) + r")\s+)+"
TITLE_PATTERN = "(?i)^(?:(?:" + "|".join(TITLES.split()) + r")\.?\s+)+"
SUFFIX_PATTERN = "(?:" + "|".join(SUFFIXES.split()) + ")$"


def is_latin(name: Column) -> Column:
    """Holds a basic Latin letter and no ideograph; false for null."""
    return F.coalesce(name.rlike("[A-Za-z]") & ~name.rlike(HAN), F.lit(False))


def _described(name: Column) -> Column:
    return F.regexp_replace(F.rtrim(F.lower(F.trim(name)), F.lit(".")), LEADING_PATTERN, "")


def is_pronoun(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin(*PRONOUNS.split()), F.lit(False))


def is_generic(name: Column) -> Column:
    """A kinship word, title or trade rather than a name; false for null."""
    latin, bare = GENERIC_LATIN.split(), _described(name)
    western = bare.isin(*latin, *PRONOUNS.split()) | F.rtrim(bare, F.lit("s")).isin(*latin)
    han = F.trim(name).isin(*GENERIC_HAN.split()) | F.regexp_replace(F.trim(name), "^[他她的老小]+", "").isin(*GENERIC_HAN.split())
    return F.coalesce(F.when(is_latin(name), western).otherwise(han), F.lit(False))


def is_good_alias(name: Column) -> Column:
    """A name or nickname: no pronoun, no kinship word, no couple, group or description; false for null and blank."""
    han = F.regexp_replace(name, "^[他她的老小未]+", "").isin(*GENERIC_HAN.split())
    group = F.when(is_latin(name), F.lower(name).rlike(GROUPS_LATIN)).otherwise(name.rlike(GROUPS_HAN))
    return F.coalesce((F.trim(name) != "") & ~is_pronoun(name) & ~is_generic(name) & ~han & ~group, F.lit(False))


def core(name: Column) -> Column:
    """The name without titles; empty where nothing was taken off or hardly anything is left."""
    bare = F.when(is_latin(name), F.regexp_replace(name, TITLE_PATTERN, "")).otherwise(F.regexp_replace(name, SUFFIX_PATTERN, ""))
    return F.when((F.length(bare) >= 2) & (bare != name), bare).otherwise(F.lit(""))


def tokens(name: Column) -> Column:
    """Distinct words of a Latin name in lower case, without those that tell nothing."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"([a-z][a-z'’\-]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*EMPTY_WORDS.split())))


def short_forms(name: Column) -> Column:
    """Parts by which a full name may go: words of Latin names of two or more, parts around a middle dot, Han names without the surname."""
    bare = F.when(core(name) != "", core(name)).otherwise(name)
    parts = F.filter(F.split(bare, r"\s+"), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*EMPTY_WORDS.split()))
    none = F.array().cast("array<string>")
    dotted = F.filter(F.split(name, "·"), lambda w: F.length(w) >= 2)
    han = F.when(name.rlike(SUFFIX_PATTERN), none).when(name.contains("·"), dotted).when(F.length(name).between(3, 4), F.array(F.substring(name, 2, 9))).otherwise(none)
    return F.array_distinct(F.when(is_latin(name), F.when(F.size(parts) > 1, parts).otherwise(none)).otherwise(han))
