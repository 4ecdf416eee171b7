"""Variant spellings of names: merge-and-rematch resolution.

Every entity (an id within a scope, such as a person of a book) starts as a profile of its spellings. Profiles that share a
full-name key merge; the merged profile has the union of the spellings, and so of surnames, given names and
initials; richer profiles then re-enter the blocks of (surname, initial) and (surname, short form), where an
abbreviated spelling joins the profile that is alone in explaining it. The full-name keys of a merged profile are those of its members, so in these
blocks nothing new could be found. What was ambiguous between two profiles can be settled once
they have merged, so this goes on until no further merge occurs.

Keys, not pairs: a block links its members to its smallest one, so a block of n members makes n links, and a
hot block is aggregated before it is shuffled. Typing errors are met by classes of words: words of one scope that become equal when
one letter is left out belong together. Groups are closed by connected_groups.

Known name forms: order (with or without comma), case, accents, titles, middle initials, initials for given names, nicknames
(listed, or a shortened given name), missing blanks, Han names in either script, with
homophones or in pinyin, abbreviated and reordered organisations. Epithets, trades, titles, bare surnames and bare forenames link nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.groups import connected_groups
from tidemark.session import cut

# Fixed values.
TITLES = "dr doctor prof professor hon honourable capt captain judge rev reverend pilot sir lady lord mr mrs miss ms mme mlle madame monsieur docteur capitaine juge pilote maître master mistress colonel col major lieutenant lt sergeant sgt general gen inspector"
HAN_TITLES = "先生 姑娘 大人 夫人 小姐 公子 师傅 師傅 老师 老師 太太 老爷 老爺 掌柜 博士"
ARTICLES = "the le la les un une der die das old young"
#: Surnames of two characters with their readings, which are not always those of the characters; then forms in traditional characters whose readings are not.
READINGS = "万俟 moqi 上官 shangguan 东方 dongfang 令狐 linghu 公冶 gongye 公孙 gongsun 司徒 situ 司空 sikong 司马 sima 呼延 huyan 夏侯 xiahou 太叔 taishu 宇文 yuwen 宗政 zongzheng 尉迟 yuchi 慕容 murong 拓跋 tuoba 欧阳 ouyang 淳于 chunyu 澹台 tantai 濮阳 puyang 申屠 shentu 皇甫 huangfu 端木 duanmu 第五 diwu 纳兰 nalan 诸葛 zhuge 赫连 helian 轩辕 xuanyuan 钟离 zhongli 长孙 zhangsun 闻人 wenren 独孤 dugu 单于 chanyu 鲜于 xianyu"
READINGS += " 萬俟 moqi 尉遲 yuchi 澹臺 tantai 長孫 zhangsun 單于 chanyu 鮮于 xianyu"
#: Words that tell kinds of organisations, and the French ones by their English ones. Abbreviations follow a rule, see Parser.abbreviates.
ORGANISATIONS = "company university order guild bank society brothers sons academy institute association museum college hospital theatre library savings shipping trading"
ORGANISATIONS_FRENCH = "compagnie company cie company université university ordre order guilde guild banque bank société society fils sons théâtre theatre"
ORGANISATION_FILLERS = "the of and & + limited ltd le la les des de du et s"
ELDER, YOUNGER = "elder aîné ancien sr senior", "younger jeune cadet jr junior"
#: Between the words of an organisation that may be its head.
HEADS = "\x02"
#: Letters from which a word may have a letter left out, and of the short forms of a given name.
LEAST_FUZZY, SHORT_FORMS = 5, (2, 3, 4, 5)


def _plain(word: str) -> str:
    """Lower case, without accents, apostrophes and hyphens."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if c.isalnum())


class Parser:
    """Reads spellings; made in the worker."""

    def __init__(self, pinyin: dict[str, str]) -> None:
        import regex

        self.regex, self.pinyin = regex, pinyin
        self.titles, self.articles = {_plain(t) for t in TITLES.split()}, set(ARTICLES.split())
        self.fillers = {f for f in ORGANISATION_FILLERS.split()}
        french = ORGANISATIONS_FRENCH.split()
        self.organisation = {word: word for word in ORGANISATIONS.split()} | {_plain(w): head for w, head in zip(french[::2], french[1::2])}
        self.readings = dict(zip(READINGS.split()[::2], READINGS.split()[1::2]))
        self.romanised = set(self.readings.values())
        self.han = regex.compile(r"\p{Han}")
        self.joint = regex.compile(r"(?<=\p{Ll}\p{Ll})(?=\p{Lu}\p{Ll})")

    def skeleton(self, word: str) -> bool:
        """Whether a word has no vowel after its first letter, as abbreviations by omission have (Svgs, Gld)."""
        return len(word) > 1 and not self.regex.search(r"[aeiouy]", word[1:])

    def abbreviates(self, short: str, full: str) -> bool:
        """Beginnings of three letters or more (Univ, Ord; also Co, which is too common to miss), and skeletons whose letters follow each other in the full word from its first letter on (Shpg)."""
        if short[0] != full[0] or len(short) >= len(full):
            return False
        if full.startswith(short) and (len(short) > 2 or short == "co"):
            return True
        letters = iter(full)
        return self.skeleton(short) and all(c in letters for c in short)

    def read_han(self, text: str) -> str:
        return self.readings.get(text) or "".join(self.pinyin.get(c, c) for c in text)

    def parse(self, spelling: str | None) -> tuple[str, str, str, str] | None:
        """kind, x, y, extra of a spelling, or None where it is no evidence.

        Of organisations x holds every word that may be the head; see _with_heads.
        full: two words of a person's name in unknown order (extra: e or y for the Elder and the Younger); exact: the same, and the words
        are compared without tolerance; given: given name x and surname y; initial: initial x and surname y; organisation: head word x, kind of organisation y.
        """
        if not spelling or not (text := unicodedata.normalize("NFKC", spelling).strip()):
            return None
        if self.han.search(text):
            return self._han(text)
        words = [w for w in self.regex.split(r"[\s,]+", text.replace("’", "'")) if w]
        kinds = [self._organisation(w) for w in words]
        if any(kinds) and len(words) > 1:
            heads = [_plain(w) for w, k in zip(words, kinds) if not k and w.casefold().strip(".'") not in self.fillers]
            heads = [w for w in heads if w and not self.skeleton(w)] or [w for w in heads if w]
            return ("organisation", HEADS.join(heads), " ".join(sorted({k for k in kinds if k})), "") if heads else None
        return self._person(text)

    def _organisation(self, word: str) -> str | None:
        plain = _plain(word)
        if plain in self.organisation:
            return self.organisation[plain]
        if len(plain) < 2 or plain in self.fillers or plain in self.articles or plain in self.titles or plain in self.romanised:
            return None
        for full, head in self.organisation.items():
            if self.abbreviates(plain, full):
                return head
            # One letter wrong in a long word.
            if len(plain) >= 6 <= len(full) and abs(len(full) - len(plain)) <= 1 and full[0] == plain[0] and not _variants(full).isdisjoint(_variants(plain)):
                return head
        return None

    def _han(self, text: str) -> tuple[str, str, str, str] | None:
        for title in HAN_TITLES.split():
            text = text.removesuffix(title)
        text = self.regex.sub(r"[\s·•・‧]", "", text)
        if not self.regex.fullmatch(r"\p{Han}{2,4}", text) or "的" in text or text[0] == "那":
            return None
        surname = 2 if len(text) == 4 or len(text) == 3 and self.read_han(text[:2]) in self.romanised else 1
        return "exact", self.read_han(text[surname:]), self.read_han(text[:surname]), ""

    def _person(self, text: str) -> tuple[str, str, str, str] | None:
        extra = ""
        parts = [p.split() for p in self.regex.split(r"\s*,\s*", self.joint.sub(" ", text)) if p.strip()]
        cleaned: list[list[str]] = []
        for part in parts:
            if (last := _plain(part[-1])) and len(part) + len(parts) > 2:
                for mark, known in (("e", ELDER), ("y", YOUNGER)):
                    if last in {_plain(k) for k in known.split()}:
                        extra, part = mark, part[:-1]
            part = part[:-1] if extra and part and part[-1].casefold().strip("'") in ("the", "l", "le", "la") else part
            if part:
                cleaned.append(part)
        if not cleaned or cleaned[0][0].casefold() in self.articles or self.regex.match(r"(?i)l'", cleaned[0][0]):
            return None
        words = [[w for w in map(_plain, part) if w and w not in self.titles] for part in cleaned]
        words = [w for w in words if w]
        if not words:
            return None
        full = [[w for w in part if len(w) > 1] for part in words]
        flat, initials = [w for part in full for w in part], [w for part in words for w in part if len(w) == 1]
        if len(flat) >= 2:
            if not self.romanised.isdisjoint(flat):
                return "exact", flat[0], flat[-1], extra
            if len(words) > 1 and full[0] and full[1]:
                return "given", full[1][0], full[0][-1], extra
            return "full", flat[0], flat[-1], extra
        return ("initial", initials[0], flat[0], extra) if flat and initials else None


def _variants(word: str) -> set[str]:
    """The word, and with one letter left out where it is long enough."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) >= LEAST_FUZZY else set())


def _stem(given: str) -> str | None:
    """The stem of a short form of a given name: Algy, Thad, Millie."""
    for ending in ("ie", "y", "i"):
        if given.endswith(ending) and len(given) - len(ending) >= 2:
            given = given[: -len(ending)]
            return given[:-1] if len(given) > 2 and given[-1] == given[-2] else given
    return given if 2 <= len(given) <= 4 else None


def pinyin_table(df: DataFrame) -> dict[str, str]:
    """Toneless pinyin of the unified ideographs, by the rules of the transliterator that Spark ships; a table of fixed size. Raises where the class is missing, as Han variants would be lost."""
    points = "".join(f"{chr(c)}\n" for c in range(0x4E00, 0xA000))
    rules = df.sparkSession._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII; Lower")
    return {chr(0x4E00 + i): p for i, p in enumerate(rules.transliterate(points).split("\n")[:-1])}


def _with_heads(parsed: DataFrame) -> DataFrame:
    """Organisations with one head word: of a name's words the one that the fewest entities share, so that trades (Lamplighters) are none; of equals the longest."""
    many = parsed.where((F.col("kind") == "organisation") & F.col("x").contains(HEADS))
    every = parsed.where("kind = 'organisation'").select("scope", "entity", F.explode(F.split("x", HEADS)).alias("word")).distinct()
    shared = every.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = many.select("scope", "entity", "x", "y", F.explode(F.split("x", HEADS)).alias("word")).join(shared, "word")
    chosen = words.groupBy("scope", "entity", "x", "y").agg(F.min(F.struct("n", -F.length("word"), "word"))["word"].alias("x1"))
    rest = parsed.where(~((F.col("kind") == "organisation") & F.col("x").contains(HEADS)))
    return rest.unionByName(chosen.select("scope", "entity", F.lit("organisation").alias("kind"), F.col("x1").alias("x"), "y", F.lit("").alias("extra"))).distinct()


def _parsed(spellings: DataFrame) -> DataFrame:
    """scope, entity, kind, x, y, extra of every spelling that is evidence."""
    pinyin = spellings.sparkSession.sparkContext.broadcast(pinyin_table(spellings))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(pinyin.value)
        for batch in batches:
            rows = [(s, e, *p) for s, e, text in batch.itertuples(index=False) if (p := parser.parse(text))]
            yield pd.DataFrame(rows, columns=["scope", "entity", "kind", "x", "y", "extra"])

    return spellings.select("scope", "entity", "spelling").distinct().mapInPandas(parse, "scope string, entity string, kind string, x string, y string, extra string").distinct()


def _word_classes(parsed: DataFrame, nicknames: DataFrame) -> DataFrame:
    """scope, word, class: words of a scope that differ by a typing error have one class (the smallest word). Only words that have company are listed."""
    words = parsed.where("kind not in ('exact', 'initial')").select("scope", F.explode(F.array("x", F.when(F.col("kind") != "organisation", F.col("y")))).alias("word"))
    words = words.unionByName(parsed.where("kind = 'initial'").select("scope", F.col("y").alias("word"))).where("word is not null").distinct()
    formal = words.join(nicknames.withColumnRenamed("nickname", "word"), "word").select("scope", F.col("formal").alias("word"))
    words = words.unionByName(formal).distinct()
    shorter = F.when(F.length("word") >= LEAST_FUZZY, F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))).otherwise(F.array().cast("array<string>"))
    variants = words.select("scope", "word", F.explode(F.array_distinct(F.concat(F.array("word"), shorter))).alias("variant"))
    # The scope and the word make one value, so that groups stay within a scope.
    own = F.concat_ws("\x00", "scope", "word")
    least = variants.groupBy("scope", "variant").agg(F.min(own).alias("a"), F.max(own).alias("z")).where("a <> z").select("scope", "variant", "a")
    links = variants.join(least, ["scope", "variant"]).select("a", own.alias("b"))
    classes = connected_groups(links)
    return classes.select(F.substring_index("member", "\x00", 1).alias("scope"), F.substring_index("member", "\x00", -1).alias("word"), F.substring_index("group_id", "\x00", -1).alias("class"))


def _star(keyed: DataFrame, *key: str) -> DataFrame:
    """a, b: each member of a block with the block's smallest."""
    least = keyed.groupBy(*key).agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select(*key, "a")
    return keyed.join(least, list(key)).where("node <> a").select("a", F.col("node").alias("b")).distinct()


def resolve(spellings: DataFrame, nicknames: DataFrame) -> DataFrame:
    """scope, member, group_id of the entities that share their group with another.

    spellings: scope, entity, spelling, introduces (true in the records that introduce the entity; entities that none introduces take no
    part). nicknames: formal, nickname (may be empty or incomplete). Other columns are ignored. Null or blank
    spellings, scopes and entities link nothing; repeated rows count once; names are read whole; an empty table gives an empty table. group_id is
    the smallest entity of the group.
    """
    spellings = spellings.where("scope is not null and entity is not null")
    spellings = spellings.join(spellings.where("introduces").select("scope", "entity").distinct(), ["scope", "entity"], "left_semi")
    plain = F.udf(lambda s: _plain(s) if s else None, "string")
    nick = nicknames.where("formal is not null and nickname is not null").select(plain("formal").alias("formal"), plain("nickname").alias("nickname")).distinct()
    parsed = cut(_with_heads(cut(_parsed(spellings))))
    classes = cut(_word_classes(parsed, nick))
    rows = parsed.withColumn("node", F.concat_ws("\x00", "scope", "entity"))
    as_class = lambda name: classes.select("scope", F.col("word").alias(name), F.col("class").alias(f"c{name}"))
    # Both orders of a name whose order is unknown: given name x, surname y.
    full = rows.where("kind in ('full', 'given')")
    full = full.unionByName(rows.where("kind = 'full'").select("scope", "entity", "kind", F.col("y").alias("x"), F.col("x").alias("y"), "extra", "node"))
    full = full.join(nick.withColumnRenamed("nickname", "x"), "x", "left")
    full = full.select("scope", "node", "x", "y", "extra", F.explode(F.array_distinct(F.array("x", F.coalesce("formal", "x")))).alias("g"))
    full = full.join(as_class("g"), ["scope", "g"], "left").join(as_class("y"), ["scope", "y"], "left")
    full = cut(full.select("scope", "node", "x", "g", "extra", F.coalesce("cg", "g").alias("cg"), F.coalesce("cy", "y").alias("cy")).distinct())
    organisations = rows.where("kind = 'organisation'").join(as_class("x"), ["scope", "x"], "left")
    keyed = (
        full.select("scope", "node", F.concat_ws("\x01", F.lit("p"), F.least("cg", "cy"), F.greatest("cg", "cy"), "extra").alias("key"))
        .unionByName(rows.where("kind = 'exact'").select("scope", "node", F.concat_ws("\x01", F.lit("x"), F.least("x", "y"), F.greatest("x", "y"), "extra").alias("key")))
        .unionByName(organisations.select("scope", "node", F.concat_ws("\x01", F.lit("o"), F.coalesce("cx", "x"), "y").alias("key")))
    )
    links = cut(_star(keyed.distinct(), "scope", "key"))
    # Blocks of what a full name explains: (surname, initial) and (surname, short form).
    tags = F.array_distinct(F.flatten(F.array(F.array(F.concat(F.lit("i"), F.substring("x", 1, 1)), F.concat(F.lit("i"), F.substring("g", 1, 1))), F.when(F.length("g") >= 5, F.array(*(F.concat(F.lit("s"), F.substring("g", 1, n)) for n in SHORT_FORMS))).otherwise(F.array().cast("array<string>")))))
    stem = F.udf(_stem, "string")
    short = full.withColumn("stem", stem("x"))
    explains = cut(short.select("scope", "node", "cy", F.explode(F.when(F.col("stem").isNull() | (F.length("x") > 5), tags).otherwise(F.filter(tags, lambda t: t.startswith("i")))).alias("tag")).distinct())
    weak = rows.where("kind = 'initial'").join(as_class("y"), ["scope", "y"], "left").select("scope", "node", F.coalesce("cy", "y").alias("cy"), F.concat(F.lit("i"), "x").alias("tag"))
    weak = cut(weak.unionByName(short.where("stem is not null and x = g").select("scope", "node", "cy", F.concat(F.lit("s"), "stem").alias("tag"))).distinct())
    groups = cut(connected_groups(links))
    while True:
        of = groups.select(F.col("member").alias("node"), "group_id")
        lead = F.coalesce("group_id", "node")
        profiles = explains.join(of, "node", "left").groupBy("scope", "cy", "tag").agg(F.min(lead).alias("a"), F.max(lead).alias("z"))
        asking = weak.join(of, "node", "left").select("scope", "cy", "tag", lead.alias("node")).distinct()
        alone = asking.join(profiles, ["scope", "cy", "tag"]).where("a = z and node <> a").select("a", F.col("node").alias("b"))
        # Abbreviations that no full name explains belong together.
        orphans = asking.where("tag like 'i%'").join(profiles, ["scope", "cy", "tag"], "left_anti")
        more = cut(alone.unionByName(_star(orphans, "scope", "cy", "tag")).distinct())
        if more.isEmpty():
            break
        # Merge the groups that are linked now, by their leads; entities outside groups lead themselves.
        leads = connected_groups(more).select(F.col("member").alias("group_id"), F.col("group_id").alias("_lead"))
        joined = groups.join(leads, "group_id", "left").select("member", F.coalesce("_lead", "group_id").alias("group_id"))
        single = leads.select(F.col("group_id").alias("member"), F.col("_lead").alias("group_id")).join(groups.select("member"), "member", "left_anti")
        groups = cut(joined.unionByName(single))
    own = lambda c: F.substring_index(c, "\x00", -1)
    return groups.select(F.substring_index("member", "\x00", 1).alias("scope"), own("member").alias("member"), own("group_id").alias("group_id"))


def pairs_of_groups(groups: DataFrame) -> DataFrame:
    """person_a < person_b: all pairs of one group, also where only a third id links them. Groups are the spellings of one entity."""
    a, b = (groups.select("scope", "group_id", F.col("member").alias(name)) for name in ("person_a", "person_b"))
    return a.join(b, ["scope", "group_id"]).where("person_a < person_b").select("person_a", "person_b").distinct()
