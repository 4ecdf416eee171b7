"""Keyword-stuffed and link-list pages.

A page is stuffed where clause structure is missing and what stands in its place is repetition, links or tags.

Clause structure: the share of characters in sentences (several words up to a final mark) and in the lines of a contents list.
Repetition: a suffix automaton over the page's words; at each word the longest substring that ends there and
occurs elsewhere in the page is maximal on the left; the union of these is the covered part.
Corpus evidence: words that the corpus uses in fragments and hardly ever in sentences ("epub", "slipcase"), counted over
all distinct texts. A cast or an inventory repeats itself as much as spam does, but its words also live in sentences.

Pseudo-sentences: keyword stuffing also comes with full stops ("Get discount code now, discount code today."), so clause structure
acquits no page by itself. Parts that hold a fragment word are keyed; where they make up most of the page, fragment words are a good part of
their characters, and repeats cover the different ones among them (a refrain counts once), the page is stuffed whatever its clauses.

The automaton is built only for pages whose clause structure is missing or that consist mostly of keyed parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut, spread


@dataclass(frozen=True)
class Limits:
    """Thresholds of the judgement, alike at every size of the corpus."""

    clause_share: float = 0.35  #: at or above this share of characters in sentences a page is a case only by its keyed parts
    keyed_share: float = 0.5  #: of the page's characters, how much must lie in parts with a fragment word
    keyed_words: float = 0.15  #: of the keyed parts' characters, how much must be fragment words
    fragment_share: float = 0.5  #: of the fragments' characters, how much must lie in units with a link, tag or fragment word
    link_share: float = 0.5  #: of the fragments' characters, how much must lie in units with a link or tag where little repeats
    covered: float = 0.3  #: share of the fragments' characters that repeats cover
    least_words: int = 6  #: fragments of fewer words prove nothing
    sentence_use: float = 0.3  #: a fragment word occurs in sentences in less than this share of its texts
    least_texts: int = 3  #: a fragment word occurs in so many distinct texts at least,
    least_text_share: float = 0.001  #: and in this share of them: at most 1,000 times the mean number of words of a text can qualify


    least_links: int = 3  #: fewer links and tags make no list of links


LIMITS = Limits()
LINK, TAG = "\x01", "\x02"


class _Text:
    """Compiled patterns; made in the worker."""

    def __init__(self) -> None:
        import regex

        self.link = regex.compile(r"<a\s[^>]*>|</a>|(?:https?://|www\.)[^\s)\]>\"|]+|\b[\w-]+(?:\.[\w-]+)+/[^\s)\]>\"|]*")
        self.tag = regex.compile(r"[#＃][\p{L}\p{N}_][\p{L}\p{M}\p{N}_]*")
        self.between = regex.compile(r"(?<=[.!?。！？…][\"”»’)\]」』]?)(?:\s+|(?=[\p{Han}“「『«—]))")
        self.closed = regex.compile(r"[.!?。！？…][\"”»’)\]」』 ]*$")
        self.contents = regex.compile(r"[.·…]{4,}\s*\d+\s*$")
        self.word = regex.compile(r"[\x01\x02]|\p{Han}|[\p{L}\p{M}][\p{L}\p{M}_’'-]*|\d+")
        self.han = regex.compile(r"\p{Han}+")
        self.unit = regex.compile(r"\s*(?:\n|\||,|;|、|，|；|·|•|\s[-–—/]\s)\s*")

    def cue_words(self, part: str) -> set[str]:
        """Words of a part in lower case; runs of ideographs, which have no word bounds, as their pairs."""
        runs = self.han.findall(part)
        words = set(self.word.findall((self.han.sub(" ", part) if runs else part).lower()))
        for run in runs:
            words.update(map("".join, zip(run, run[1:])) if len(run) > 1 else run)
        return words

    def cue_size(self, part: str, cues: set[str]) -> tuple[int, int]:
        """Characters of the words of a part, and those of them in fragment words."""
        words = self.word.findall(self.han.sub(" ", part))
        total, found = sum(map(len, words)), sum(len(w) for w in words if w.lower() in cues)
        for run in self.han.findall(part):
            places = {i for k in range(max(1, len(run) - 1)) if run[k : k + 2] in cues for i in range(k, min(k + 2, len(run)))}
            total, found = total + len(run), found + len(places)
        return total, found

    def marked(self, text: str) -> str:
        """The text with a character in place of each link and tag; the patterns are only tried where what they need occurs."""
        if "/" in text or "www." in text or "<a" in text:
            text = self.link.sub(LINK, text)
        return self.tag.sub(TAG, text) if "#" in text or "＃" in text else text

    def evidence(self, text: str, cues: set[str]) -> bool:
        """Whether any link, tag or fragment word occurs; the words of the parts are among those of the whole text."""
        return self.marked(text) != text or not cues.isdisjoint(self.cue_words(text))

    def size(self, part: str) -> int:
        """Characters of a part; an ideograph counts as two, a link or tag as a fixed length."""
        return len(part) + sum(map(len, self.han.findall(part))) + 24 * (part.count(LINK) + part.count(TAG))

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """Sentences (and contents lines) and other fragments of a text, links and tags replaced by one character each."""
        sentences, fragments = [], []
        for line in self.marked(text).split("\n"):
            if self.contents.search(line):
                sentences.append(line)
                continue
            for part in self.between.split(line):
                if part := part.strip():
                    words = self.word.findall(part)
                    marked = part.count(LINK) + part.count(TAG)
                    (sentences if len(words) >= 3 and marked * 3 <= len(words) and self.closed.search(part) else fragments).append(part)
        return sentences, fragments


_TEXT: _Text | None = None


def _text() -> _Text:
    global _TEXT
    _TEXT = _TEXT or _Text()
    return _TEXT


def covered_by_repeats(words: list[str], least: int = 2) -> float:
    """Share of the characters of a list of words that lie in substrings of at least ``least`` words occurring twice or more."""
    if len(words) < 2 * least:
        return 0.0
    # Suffix automaton: per state its transitions, suffix link, length and number of end positions.
    go: list[dict[str, int]] = [{}]
    link, length, times, ends = [-1], [0], [0], []
    last = 0
    for w in words:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        times.append(1)
        p = last
        while p >= 0 and w not in go[p]:
            go[p][w] = new
            p = link[p]
        if p >= 0:
            q = go[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                times.append(0)
                while p >= 0 and go[p].get(w) == q:
                    go[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
        ends.append(new)
    for state in sorted(range(1, len(go)), key=length.__getitem__, reverse=True):
        if link[state] > 0:
            times[link[state]] += times[state]
    # Longest repeated substring that ends at a word: the first state on the suffix path with two end positions.
    longest = [0] * len(go)
    for state in sorted(range(1, len(go)), key=length.__getitem__):
        longest[state] = length[state] if times[state] > 1 else longest[link[state]]
    covered, reach = 0, len(words)
    for i in range(len(words) - 1, -1, -1):
        n = longest[ends[i]]
        if n >= least:
            reach = min(reach, i - n + 1)
        if i >= reach:
            covered += len(words[i])
    return covered / max(1, sum(map(len, words)))


def keyed_cover(parts: list[str], cues: set[str], limits: Limits = LIMITS) -> float:
    """Share of the characters of the different keyed parts that repeats, or fragment words that recur, cover; 0 for pages that do not consist mostly of keyed parts."""
    t = _text()
    sizes = list(map(t.size, parts))
    spare = sum(sizes) * (1 - limits.keyed_share)
    keyed = []
    for part, n in zip(parts, sizes, strict=True):
        if not cues.isdisjoint(t.cue_words(part)):
            keyed.append(part)
        elif (spare := spare - n) < 0:
            return 0.0
    total, found = map(sum, zip((0, 0), *(t.cue_size(part, cues) for part in keyed), strict=True))
    if found < limits.keyed_words * max(1, total):
        return 0.0
    words = [w.lower() for part in dict.fromkeys(keyed) for w in t.word.findall(part)]
    if len(words) < limits.least_words:
        return 0.0
    # A keyword of one word is no repeat of two words: such words count by themselves where they recur.
    recurring = sum(len(w) * n for w, n in Counter(words).items() if n > 1 and w in cues)
    return max(covered_by_repeats(words), recurring / sum(map(len, words)))


def judge_text(text: str | None, cues: set[str], limits: Limits = LIMITS) -> tuple[bool, float, float, float]:
    """stuffed, clause share, share of fragments with a link, tag or fragment word, covered share; null, empty and blank texts are no case.

    A page without any link, tag or fragment word cannot be stuffed by any rule below; it is not taken apart, and its shares are 0.
    """
    if not text or not text.strip():
        return False, 0.0, 0.0, 0.0
    t = _text()
    if not t.evidence(text, cues):
        return False, 0.0, 0.0, 0.0
    sentences, fragments = t.parts(text)
    rest, whole = sum(map(t.size, fragments)), sum(map(t.size, sentences))
    clauses = whole / max(1, rest + whole)
    if clauses >= limits.clause_share:
        covered = keyed_cover(sentences + fragments, cues, limits)
        return covered >= limits.covered, clauses, 0.0, covered
    marked = linked = links = total = 0
    words: list[str] = []
    for fragment in fragments:
        for unit in t.unit.split(fragment):
            n, own = t.size(unit), unit.count(LINK) + unit.count(TAG)
            total, links = total + n, links + own
            linked += n * (own > 0)
            marked += n * (own > 0 or not cues.isdisjoint(t.cue_words(unit)))
            words += [w.lower() for w in t.word.findall(unit)]
    fragment_share, link_share = marked / max(1, total), linked / max(1, total)
    covered = covered_by_repeats(words)
    stuffed = len(words) >= limits.least_words and (fragment_share >= limits.fragment_share and covered >= limits.covered or link_share >= limits.link_share and links >= limits.least_links)
    stuffed = stuffed or keyed_cover(sentences + fragments, cues, limits) >= limits.covered
    return stuffed, clauses, fragment_share, covered


def fragment_words(docs: DataFrame, limits: Limits = LIMITS) -> set[str]:
    """Words that the corpus uses in fragments, not in sentences, by the number of distinct texts.

    The set is bounded whatever the corpus: see Limits.least_text_share.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, inside, outside, texts = _text(), Counter(), Counter(), 0

        def flush() -> pd.DataFrame:
            keys = list(inside.keys() | outside.keys())
            out = pd.DataFrame({"word": [*keys, ""], "inside": [*(inside[k] for k in keys), texts], "outside": [*(outside[k] for k in keys), 0]})
            inside.clear(), outside.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                sentences, fragments = t.parts(text)
                # One line each: no word and no pair of ideographs crosses the end of a line.
                inside.update(t.cue_words("\n".join(sentences)))
                outside.update(t.cue_words("\n".join(fragments)))
                texts += 1
            if len(inside) + len(outside) > 500_000:
                yield flush()
                texts = 0
        yield flush()

    distinct = docs.where(F.trim("text") != "").select("text", F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(1), "text").alias("_g")).dropDuplicates(["_h", "_g"]).select("text")
    counts = distinct.mapInPandas(count, "word string, inside long, outside long").groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    counts = cut(counts.where(f"word = '' or outside >= {limits.least_texts} and inside < {limits.sentence_use} * (inside + outside)"))
    # The number of texts comes as the row of the empty word, so one pass serves both.
    texts = counts.where("word = ''").agg(F.sum("inside")).first()[0] or 0
    rows = counts.where((F.col("word") != "") & (F.col("outside") >= limits.least_text_share * texts)).select("word").collect()
    return {row.word for row in rows} - {LINK, TAG}


def judge(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, stuffed, clauses, fragments, covered of every document (doc_id, text; other columns are ignored).

    Null, empty and blank texts are not stuffed. Rows are judged one by one: repeated texts get the same judgement, repeated rows
    give one row. Texts are judged whole.
    """
    docs = docs.select("doc_id", "text")
    cues = fragment_words(docs, limits)

    @F.pandas_udf(T.StructType([T.StructField("stuffed", T.BooleanType()), *(T.StructField(n, T.DoubleType()) for n in ("clauses", "fragments", "covered"))]))
    def verdict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge_text(text, cues, limits) for text in texts], columns=["stuffed", "clauses", "fragments", "covered"])

    # Not deterministic only in name: else a filter on the verdict would have it computed twice.
    verdict = verdict.asNondeterministic()
    return spread(docs, "doc_id").select("doc_id", verdict("text").alias("v")).select("doc_id", "v.*").distinct()
