"""Text cut off by field limits.

Each unclosed text gets one score: the odds that its length was censored, times the odds that its end is no place to stop.

Endings. In each sentence of the corpus, after every word, contexts of four lengths are counted: the sentence so far with names and
numbers masked, its last few words, its last two and its last one; and how often the sentence stops there. The share of stops at a text's end is
estimated from the longest context to the shortest, each smoothed by the next shorter one, so no context is too rare or too
frequent to be used. What a text itself contributes is taken off.

Stems. A last word that after the same word (almost) never stands whole, where longer words that begin with it do, is a stem: rates
decide, so a stem does not turn into a word because a large corpus holds it somewhere. So is a word that is nowhere whole at all.
Open ends count as stops only where the last word is no stem.

Lengths. For each source, field, script (Han or not) and unit of length a log-normal distribution, right-censored at the candidate limit, is fitted by
maximum likelihood (the censored part by expectation-maximisation) to the lengths of the distinct texts. The posterior that a value of exactly that
length was censored is one minus the expected uncensored count over the count found.

What trails a cut (dots, blanks, replacement characters, a backslash, an open bracket) is set aside first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, spread


@dataclass(frozen=True)
class Limits:
    """Thresholds, alike at every size of the corpus."""

    prior: float = 0.1  #: share of unclosed texts that are cut, away from the limits
    at_limit: float = 0.5  #: and at a length whose posterior is 1
    shorter: float = 10.0  #: weight of the next shorter context, in occurrences
    reach: float = 0.3  #: of the values as long as a limit or longer, so many at least lie at it beyond what is expected
    whole: float = 0.01  #: a word that stands whole less often than this share of its longer words is a stem
    first_word: float = 0.004  #: a first word of this share of the texts is no name; so at most 250 words qualify


LIMITS = Limits()
#: Words (or ideographs) of the contexts between the whole sentence and the last word.
SHORT, SHORT_HAN = (4, 2), (6, 3)
#: Levels of the keys of an end: contexts from long to short, the last word, the beginnings of longer words.
CONTEXTS, WORD, LONGER = 4, 4, 5

# Chinese surnames of two characters.
HAN_SURNAMES = "万俟 上官 东方 令狐 公冶 公孙 司徒 司空 司马 呼延 夏侯 太叔 宇文 宗政 尉迟 慕容 拓跋 欧阳 淳于 澹台 濮阳 申屠 皇甫 端木 第五 纳兰 诸葛 赫连 轩辕 钟离 长孙 闻人 独孤"

HAN_NAME, OPENS, CLOSES = "\x03", "\x04", "\x05"


class _Reader:
    """Splits texts into masked sentences; made in the worker."""

    def __init__(self, first_words: set[str]) -> None:
        import regex

        self.first_words = first_words
        self.trail = regex.compile(r"(?:\s|�|\\|\[|…|\.{2,}|\()+$")
        self.han_name = regex.compile(rf"(?:{'|'.join(HAN_SURNAMES.split())})·?\p{{Han}}{{2}}")
        self.epithet = regex.compile(r"(\b(?:[Tt]he [\p{Ll}-]+ [\p{Ll}-]+ of|l[ea] [\p{Ll}-]+(?: [\p{Ll}-]+)? de) )(?=\p{Lu})")
        self.token = regex.compile(r"[\x03-\x05]|\p{Han}|[\p{L}\p{M}]+(?:[’'\-][\p{L}\p{M}]+)*[’']?|\d+|[^\s\p{L}\d]")
        self.end = regex.compile(r"[.!?。！？…]")
        self.closed = regex.compile(r"[.!?。！？…][\"”»’)\]」』）]*$")
        self.is_han = regex.compile(r"\p{Han}")

    def core(self, text: str) -> str:
        return self.trail.sub("", text)

    def sentences(self, core: str) -> list[list[tuple[str, str, tuple[str, ...]]]]:
        """Each sentence as (word, masked word before, keys of its contexts, from long to short) after each of its words.

        A name takes the place of the epithet before it ("the tall clerk of Wick"), whose own words have contexts too.
        """
        found: list[list[tuple[str, str, tuple[str, ...]]]] = []
        steps: list[tuple[str, str, tuple[str, ...]]] = []
        masked: list[str] = []
        kept, words = 0, 0
        marked = self.epithet.sub(rf"{OPENS}\1{CLOSES}", self.han_name.sub(HAN_NAME, core))
        for token in self.token.findall(marked):
            if token == OPENS:
                kept = len(masked)
            elif token == CLOSES:
                del masked[kept:]
            elif self.end.match(token):
                if steps:
                    found.append(steps)
                steps, masked, kept, words = [], [], 0, 0
            else:
                before = masked[-1] if masked else ""
                if token == HAN_NAME or token[0].isupper() and (words > 0 or token not in self.first_words):
                    if before != "N":
                        masked.append("N")
                else:
                    masked.append("0" if token[0].isdigit() else token.lower())
                words += 1
                steps.append((token, before, self.contexts(masked)))
        return [*found, steps] if steps else found

    def contexts(self, masked: list[str]) -> tuple[str, str, str, str]:
        """Keys of the contexts that end with the last word."""
        long, short = SHORT_HAN if self.is_han.match(masked[-1]) or len(masked) > 1 and self.is_han.match(masked[-2]) else SHORT
        return "0" + "\t".join(masked), "1" + "\t".join(masked[-long:]), "2" + "\t".join(masked[-short:]), "3" + masked[-1]

    def is_word(self, token: str) -> bool:
        return token[0].isalpha() and not self.is_han.match(token)


def _key(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _counts(texts: DataFrame, first_words: set[str]) -> DataFrame:
    """key, n, ends: of every context, how often it occurs and how often its sentence is closed there; n of every whole word ("w" + word) and of the beginnings of
    longer words after a word ("p" + word before + beginning). The open end of a text counts nowhere. Rows of the field "" are names, which only give words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(first_words)
        n: dict[str, int] = {}
        ends: dict[str, int] = {}
        pairs: dict[tuple[str, str], int] = {}

        def flush() -> pd.DataFrame:
            for (before, word), times in pairs.items():
                for i in range(1, len(word)):
                    key = f"p{before}\t{word[:i]}"
                    n[key] = n.get(key, 0) + times
            out = pd.DataFrame({"key": [_key(k) for k in n], "n": list(n.values()), "ends": [ends.get(k, 0) for k in n]})
            n.clear(), ends.clear(), pairs.clear()
            return out

        for batch in batches:
            for field, text in zip(batch["field"], batch["text"]):
                if not field:
                    for token in reader.token.findall(text):
                        n["w" + token.casefold()] = n.get("w" + token.casefold(), 0) + 1
                    continue
                core = reader.core(text)
                sentences = reader.sentences(core)
                for k, steps in enumerate(sentences):
                    unclosed = k == len(sentences) - 1 and not reader.closed.search(core)
                    for token, before, keys in steps[:-1] if unclosed else steps:
                        n["w" + token.casefold()] = n.get("w" + token.casefold(), 0) + 1
                        for key in keys:
                            n[key] = n.get(key, 0) + 1
                        if reader.is_word(token):
                            pairs[before, token] = pairs.get((before, token), 0) + 1
                    for key in () if unclosed else steps[-1][2]:
                        ends[key] = ends.get(key, 0) + 1
            if len(n) + len(pairs) > 400_000:
                yield flush()
        yield flush()

    return texts.mapInPandas(count, "key long, n long, ends long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def _endings(texts: DataFrame, first_words: set[str]) -> DataFrame:
    """rec_id, level, key for the end of every text that is not closed: its contexts and, where the last word is made of letters, the keys of the word and of longer words."""

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(first_words)
        for batch in batches:
            rows = []
            for rec, text in zip(batch["rec_id"], batch["text"]):
                core = reader.core(text)
                sentences = [] if reader.closed.search(core) else reader.sentences(core)
                if sentences:
                    word, before, keys = sentences[-1][-1]
                    rows += [(rec, level, _key(key)) for level, key in enumerate(keys)]
                    if reader.is_word(word):
                        rows += [(rec, WORD, _key("w" + word.casefold())), (rec, LONGER, _key(f"p{before}\t{word}"))]
            yield pd.DataFrame(rows, columns=["rec_id", "level", "key"]).astype({"rec_id": "int64", "level": "int32", "key": "int64"})

    return texts.mapInPandas(end, "rec_id long, level int, key long")


def _with(asked: DataFrame, table: DataFrame, uses: DataFrame, total: int, *columns: str) -> DataFrame:
    """asked with columns of the table by key (0 where it has none). Keys that many texts ask for are joined by broadcast: each has a thousandth of all
    rows or more, so there are at most 1,000."""
    hot = table.join(uses.where(F.col("uses") > max(1000, total // 1000)).select("key"), "key", "left_semi").select("key", *(F.col(c).alias(f"hot_{c}") for c in columns), F.lit(True).alias("hot"))
    first = asked.join(F.broadcast(hot), "key", "left")
    rest = first.where("hot is null").select(*asked.columns).join(table.select("key", *columns), "key", "left")
    both = rest.unionByName(first.where("hot").select(*asked.columns, *(F.col(f"hot_{c}").alias(c) for c in columns)))
    return both.na.fill(0, list(columns))


def _ends(asked: DataFrame, counts: DataFrame, limits: Limits) -> DataFrame:
    """rec_id, stem, stops of every unclosed text: whether its last word is a stem, and the smoothed share of stops at its end."""
    uses = cut(asked.groupBy("key").agg(F.count(F.lit(1)).alias("uses")))
    total = uses.agg(F.sum("uses")).first()[0] or 0
    counts = cut(counts.join(uses.select("key"), "key", "left_semi"))
    at = lambda level, c: F.max(F.when(F.col("level") == level, F.col(c)))
    known = cut(_with(asked, counts, uses, total, "n", "ends"))
    judged = known.groupBy("rec_id").agg(at(2, "n").alias("here"), at(WORD, "n").alias("word"), at(LONGER, "n").alias("longer"))
    stems = judged.select("rec_id", (F.coalesce(F.col("word") == 0, F.lit(False)) | F.coalesce((F.col("longer") > 0) & (F.col("here") < limits.whole * F.col("longer")), F.lit(False))).alias("stem"))
    flagged = cut(known.where(F.col("level") < CONTEXTS).join(stems, "rec_id"))
    opens = flagged.groupBy("key").agg(F.count(F.when(~F.col("stem"), 1)).alias("open"))
    rows = _with(flagged, opens, uses, total, "open")
    one = rows.groupBy("rec_id").agg(F.first("stem").alias("stem"), F.map_from_entries(F.collect_list(F.struct("level", F.struct("n", "ends", "open")))).alias("m"))
    stops = F.lit(0.5)
    for level in reversed(range(CONTEXTS)):  # the text itself is one of the open ends
        own = F.col("m")[level]
        others = F.greatest(own["open"] - 1, F.lit(0))
        weight = limits.shorter if level < CONTEXTS - 1 else 1.0
        stops = (own["ends"] + others + weight * stops) / (own["n"] + others + weight)
    return one.select("rec_id", "stem", stops.alias("stops"))


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limit: int, rounds: int = 30) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood, where the values at the limit are censored (at least the limit) and longer ones are as measured."""
    x, w = np.log(lengths.astype(float)), counts.astype(float)
    at = lengths == limit
    mean, deviation = np.average(x, weights=w), max(0.05, math.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w)))
    c = math.log(limit)
    for _ in range(rounds):
        z = (c - mean) / deviation
        tail = max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
        hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        first = mean + deviation * hazard
        second = deviation**2 * (1 + z * hazard - hazard**2) + first**2
        e1, e2 = np.where(at, first, x), np.where(at, second, x**2)
        mean = np.average(e1, weights=w)
        deviation = max(0.05, math.sqrt(max(0.0, np.average(e2, weights=w) - mean**2)))
    return mean, deviation


def limit_posteriors(part: pd.DataFrame, reach: float = LIMITS.reach) -> pd.DataFrame:
    """For one source, field, script and unit (length, n): the posterior that values of a length were censored there, for the lengths that stand out.

    A limit leaves few longer values: a length counts only if the values in excess of the expected are at least the share ``reach`` of them and the longer ones.
    """
    part = part.sort_values("length")
    lengths, counts = part["length"].to_numpy(), part["n"].to_numpy()
    near = [(counts[(np.abs(lengths - v) <= 5) & (lengths != v)].sum()) / 10 for v in lengths]
    rows = []
    for v, n, beside in zip(lengths, counts, near):
        if v > 1 and n >= 5 and n >= 3 * (beside + 1):
            mean, deviation = fit_censored(lengths, counts, int(v))
            density = math.exp(-(((math.log(v) - mean) / deviation) ** 2) / 2) / (deviation * v * math.sqrt(2 * math.pi))
            expected = max(beside, counts.sum() * density)
            if n - expected >= reach * (n - expected + counts[lengths > v].sum()):
                rows.append((int(v), max(0.0, 1 - expected / n)))
    own = part[["source", "field", "han", "unit"]].iloc[0]
    out = pd.DataFrame({"length": [r[0] for r in rows], "posterior": [r[1] for r in rows]}).astype({"length": "int64", "posterior": "float64"})
    return out.assign(**own)[["source", "field", "han", "unit", "length", "posterior"]]


def judge_texts(texts: DataFrame, names: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """rec_id, source, cut of every record with a text that is not blank.

    texts: rec_id, source, field, text. names: spelling, the proper names that texts mention (may be empty). Other columns are
    ignored. Null and blank texts have no row; a null source is a source of its own; a record delivered twice counts once; texts
    are read whole. An empty table gives an empty table.
    """
    texts = texts.select("rec_id", F.coalesce("source", F.lit("\x00")).alias("source"), "field", "text").where(r"text rlike '[^\\s\\p{Z}]'").withColumn("field", F.coalesce("field", F.lit("?")))
    texts = spread(texts, "rec_id")
    first = texts.select(F.regexp_extract("text", r"^\s*(\S+)", 1).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = first.agg(F.sum("n")).first()[0] or 0
    first_words = {row.w for row in first.where(F.col("n") >= max(2, limits.first_word * total)).collect()}
    spelled = names.where("spelling is not null").select(F.lit("").alias("field"), F.col("spelling").alias("text"))
    counts = _counts(texts.select("field", "text").unionByName(spelled), first_words)
    ends = _ends(cut(_endings(texts.select("rec_id", "text"), first_words).distinct()), counts, limits)
    measures = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").cast("long").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").cast("long").alias("length"))))
    own = ["source", "field", "han"]
    sized = texts.select("rec_id", "source", "field", F.col("text").rlike(r"\p{IsHan}").alias("han"), F.xxhash64("text").alias("h"), measures.alias("m")).select("rec_id", *own, "h", "m.*")
    # A stock phrase that comes again and again is no limit: each distinct text counts once.
    histogram = sized.groupBy(*own, "unit", "length").agg(F.countDistinct("h").alias("n"))
    at = histogram.groupBy(*own, "unit").applyInPandas(lambda part: limit_posteriors(part, limits.reach), "source string, field string, han boolean, unit string, length long, posterior double")
    censored = sized.join(at, [*own, "unit", "length"]).groupBy("rec_id").agg(F.max("posterior").alias("posterior"))
    joined = texts.select("rec_id", "source").distinct().join(ends, "rec_id", "left").join(censored, "rec_id", "left")
    prior = limits.prior + (limits.at_limit - limits.prior) * F.coalesce("posterior", F.lit(0.0))
    odds = prior / (1 - prior) * (1 - F.col("stops")) / F.greatest("stops", F.lit(1e-9))
    return joined.select("rec_id", F.when(F.col("source") != "\x00", F.col("source")).alias("source"), (F.coalesce("stem", F.lit(False)) | F.coalesce(odds > 1, F.lit(False))).alias("cut"))


def rates(judged: DataFrame) -> DataFrame:
    """model, texts, cut, share of each source; a null source is a source of its own."""
    return judged.groupBy(F.col("source").alias("model")).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
