"""Missing or wrong document language labels (problem 10).

Method: prediction by partial matching. Per language a variable-order context
tree over the bytes of words (order ``ORDER``, escapes by method C, contexts start
at the word's border) is counted once on a bounded sample of labelled documents
and then frozen. The exact code length of a word under each language is the
evidence; a word's code length depends on nothing else, so it is computed once
per distinct word and worker. A text is cut into units at punctuation; the
cheapest path of languages over the units, with a price for each change, gives
the segments, and the posterior odds of the code lengths give the confidence.

The sample takes at most ``SAMPLE_DOCS`` documents per language by a hash of the
id. Labels of the sample may be wrong, so the model is fitted twice, the second
time on the sample documents whose label the first model agrees with. Everything
else is done for every document, whole, in one pass without a shuffle.

Defined results: null and empty texts, and texts of code, log lines, numbers or
single names alone, have no words of a language and give no segment; words with
digits or code signs count for no language.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "pt", "ru", "vi", "zh")
ORDER = 5
SAMPLE_DOCS = 300
SAMPLE_CHARS = 8_000
CAP_BITS = 12.0
CHANGE_BITS = 25.0
UNIT_WORDS = 12
TEXTS = 500

# Cyrillic letters that look like Latin ones, and the Latin ones.
_ALIKE = str.maketrans("аеорсухіјѕһ", "aeopcyxijsh")

# Names of the languages in ISO 639-2 and as words.
NAMES = {
    "de": ("deu", "ger", "german", "deutsch"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "castellano", "español", "espanol"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "ru": ("rus", "russian", "русский"),
    "vi": ("vie", "vietnamese", "tiếng việt"),
    "zh": ("zho", "chi", "chinese", "cmn", "中文"),
}
_CODES = {n: c for c, names in NAMES.items() for n in (c, *names)}

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_CODE_LINE = re.compile(
    r"(?m)^[ \t]*(?:[|$].*|\{.*|(?:\d{4}-\d\d-\d\d|\d\d:\d\d|\[\d).*|(?:python\d?|pip|def|class|import|from|return|for|if|while|sudo|git|cd|ls|select|INFO|WARN(?:ING)?|ERROR|DEBUG)\b[^\n]*[=(){}\[\];/\\].*|(?:\w+=\S+[ \t,]*)+)$",
    re.I,
)
# signs without which no line is code
_CODE_SIGN = re.compile(r"[|$={}\[\]();/\\]|\d\d:\d\d|\d{4}-\d\d")
_TAGS = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_CODE_WORD = re.compile(r"(?<!\S)[^\s\d_=/\\{}<>|@#$%^*~`]*[\d_=/\\{}<>|@#$%^*~`]\S*")
_TOKEN = re.compile(r"[㐀-䶿一-鿿]|[^\W\d_㐀-䶿一-鿿]+|[.,;:!?\n。，；：！？、()\"]")
_MARKS = re.compile("[̀-ͯ]")


def label_code(label: str | None) -> str | None:
    """One of the eight codes for any usual spelling, the bare label for another language, None where it says nothing."""
    if label is None:
        return None
    bare = label.strip().lower()
    code = _CODES.get(bare) or _CODES.get(re.split(r"[-_ ]", bare)[0])
    if code:
        return code
    return bare if re.fullmatch(r"[a-z]{2,3}([-_].*)?", bare) and bare not in ("und", "xx", "xxx", "zxx", "mis", "mul", "na", "nil", "tbd") else None


def prose(text: str) -> str:
    """The text with code, log lines and code-like words blanked out; every offset stays."""
    def blank(m: re.Match) -> str:
        x = m.group()
        return " " * len(x) if "\n" not in x else re.sub(r"[^\n]", " ", x)

    if "```" in text or "~~~" in text:
        text = _FENCE.sub(blank, text)
    if "<" in text:
        text = _TAGS.sub(blank, text)
    if _CODE_SIGN.search(text):
        text = _CODE_LINE.sub(blank, text)
    return _CODE_WORD.sub(blank, text)


def word_counts(text: str | None) -> Counter:
    if not text:
        return Counter()
    return Counter(w for w in _TOKEN.findall(prose(unicodedata.normalize("NFC", text)).lower()) if w[0].isalpha())


def _key(context: bytes) -> int:
    """A context of up to five bytes and its length as one number."""
    return int.from_bytes(context, "big") | (len(context) + 1) << 40


def _spelling(token: str) -> str | None:
    """The word to be coded; None for punctuation and for words of look-alike letters only."""
    if not token[0].isalpha():
        return None
    latin = token.translate(_ALIKE)
    if latin == token:
        return token
    if any(c.isascii() for c in token):
        return latin
    return None if latin.isascii() else token


class ContextTrees:
    """Frozen counts of all languages and the code lengths under them."""

    def __init__(self, counts: dict[str, Counter]):
        found: list[dict[int, int]] = []
        for lang in LANGUAGES:
            words: Counter = Counter()
            for w, n in counts.get(lang, {}).items():
                words[w] += n
                plain = _MARKS.sub("", unicodedata.normalize("NFD", w))
                if plain != w:
                    words[plain] += max(1, n // 4)
            seen: dict[int, int] = {}
            for w, n in words.items():
                b = f" {w} ".encode()
                for i in range(1, len(b)):
                    for o in range(min(ORDER, i) + 1):
                        k = _key(b[i - o : i]) << 8 | b[i]
                        seen[k] = seen.get(k, 0) + n
            found.append(seen)
        # one row per context (and per context and symbol) for all languages
        self.pairs = np.array(sorted({k for x in found for k in x}), np.int64)
        n = np.array([[x.get(k, 0) for x in found] for k in self.pairs.tolist()], np.float64).reshape(-1, len(LANGUAGES))
        self.contexts, at = np.unique(self.pairs >> 8, return_inverse=True)
        total, kinds = np.zeros((len(self.contexts), len(LANGUAGES))), np.zeros((len(self.contexts), len(LANGUAGES)))
        np.add.at(total, at, n)
        np.add.at(kinds, at, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            # method C: an escape counts as often as there are different symbols; a context not seen costs nothing
            self.escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
            self.symbol = np.where(n > 0, -np.log2(n / (total + kinds)[at]), np.nan)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = np.zeros((0, len(LANGUAGES)))
        self.is_word = np.zeros(0, bool)

    def bits(self, words: list[str]) -> np.ndarray:
        """Exact code lengths of words, one row per word and one column per language."""
        coded = [f" {w} ".encode() for w in words]
        size = np.array([len(b) for b in coded])
        text = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        place = np.arange(len(text)) - np.repeat(start, size)
        keys = [np.zeros(len(text), np.int64)]
        for o in range(1, ORDER + 1):
            before = np.zeros(len(text), np.int64)
            before[o:] = text[:-o]
            keys.append(keys[-1] | before << 8 * (o - 1))
        cost = np.zeros((len(text), len(LANGUAGES)))
        open_ = np.ones(cost.shape, bool)
        open_[start] = False
        for o in range(ORDER, -1, -1):
            key = keys[o] | (o + 1) << 40
            at = np.flatnonzero((place >= max(o, 1)))
            c = np.minimum(np.searchsorted(self.contexts, key[at]), len(self.contexts) - 1)
            known = self.contexts[c] == key[at]
            at, c = at[known], c[known]
            pair = key[at] << 8 | text[at]
            p = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = np.where((self.pairs[p] == pair)[:, None], self.symbol[p], np.nan)
            was, got = open_[at], ~np.isnan(hit)
            cost[at] += np.where(was, np.where(got, hit, self.escape[c]), 0.0)
            open_[at] = was & ~got
        cost[open_] += 8.0
        return np.add.reduceat(cost, start, axis=0)

    def learn(self, tokens: set[str]) -> None:
        """Evidence of new tokens: the bits that each language costs more than the cheapest, at most ``CAP_BITS``; zeros for punctuation and for words of look-alike letters only."""
        if len(self.known) > 500_000:
            self.clear()
        new = [t for t in tokens if t not in self.known]
        if not new:
            return
        spelt = [_spelling(t) for t in new]
        rows = np.zeros((len(new), len(LANGUAGES)))
        at = [i for i, w in enumerate(spelt) if w]
        if at and len(self.pairs):
            b = self.bits([spelt[i] for i in at])
            rows[at] = np.minimum(b - b.min(axis=1, keepdims=True), CAP_BITS)
        self.known.update(zip(new, range(len(self.held), len(self.held) + len(new)), strict=True))
        self.held = np.concatenate([self.held, rows])
        self.is_word = np.concatenate([self.is_word, [t[0].isalpha() for t in new]])

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """Rows of learnt tokens in ``held`` and ``is_word``."""
        return np.array(list(map(self.known.__getitem__, tokens)), np.int64)

    def best(self, words: Counter) -> str | None:
        if not words:
            return None
        self.learn(set(words))
        ids = self.numbers(list(words))
        return LANGUAGES[int(np.argmin(np.array(list(words.values())) @ self.held[ids]))]


def _units(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words, and where among them units begin and end: between punctuation, at most ``UNIT_WORDS`` words."""
    at = np.flatnonzero(is_word)
    piece = np.cumsum(~is_word)[at]
    place = np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = piece[1:] != piece[:-1]
    begin = np.flatnonzero(new | ((place - np.maximum.accumulate(np.where(new, place, 0))) % UNIT_WORDS == 0))
    return at, begin, np.append(begin[1:], len(at))


def _path(cost: np.ndarray, change: float = CHANGE_BITS) -> np.ndarray:
    """Cheapest languages over units."""
    n, k = cost.shape
    back = np.zeros((n, k), np.int8)
    best = cost[0].copy()
    for i in range(1, n):
        m = int(np.argmin(best))
        stay = best <= best[m] + change
        back[i] = np.where(stay, np.arange(k), m)
        best = np.where(stay, best, best[m] + change) + cost[i]
    out = np.empty(n, np.int8)
    out[-1] = np.argmin(best)
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


_MODELS: dict[str, ContextTrees] = {}


def _model(name: str, counts: dict[str, dict[str, int]]) -> ContextTrees:
    """One model per Python worker, with the code lengths it has computed, for all tasks that the worker runs."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = ContextTrees({c: Counter(w) for c, w in counts.items()})
    return _MODELS[name]


def segments(model: ContextTrees, text: str | None) -> list[tuple[int, int, str, float, int]]:
    """(start, end, language, confidence, words) of the stretches of a text, offsets in characters of the NFC text."""
    return next(all_segments(model, [text]))


def all_segments(model: ContextTrees, texts: list[str | None]) -> Iterator[list[tuple[int, int, str, float, int]]]:
    """:func:`segments` of many texts; new words are learnt for all of them at once."""
    low = [prose(unicodedata.normalize("NFC", t)).lower() if t else "" for t in texts]
    tokens = [_TOKEN.findall(t) for t in low]
    model.learn({w for x in tokens for w in x})
    for t, plain, words in zip(texts, low, tokens, strict=True):
        yield _stretches(model, t, plain, words) if words else []


def _stretches(model: ContextTrees, text: str, low: str, tokens: list[str]) -> list[tuple[int, int, str, float, int]]:
    ids = model.numbers(tokens)
    at, begin, end = _units(model.is_word[ids])
    if not len(at):
        return []
    cost = np.add.reduceat(model.held[ids[at]], begin, axis=0)
    best = int(np.argmin(cost.sum(axis=0)))
    # where no run of units can pay for a change, the whole text has one language
    if np.maximum(cost[:, best] - cost.min(axis=1), 0).sum() <= CHANGE_BITS:
        path = np.full(len(begin), best)
        spans = None
    else:
        path = _path(cost)
        spans = [m.span() for m in _TOKEN.finditer(low)] if (path != path[0]).any() else None
    edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        c = cost[a:b].sum(axis=0)
        lang = int(path[a])
        first, last = at[begin[a]], at[end[b - 1] - 1]
        odds = np.exp2(-np.clip(c - c[lang], -60, 60))
        where = (spans[first][0], spans[last][1]) if spans else (0, len(text))
        out.append((*where, LANGUAGES[lang], float(1 / odds.sum()), int(end[b - 1] - begin[a])))
    return out


def labelled_sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language, chosen by a hash of the id; a bounded set on the driver."""
    code = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]+|[^\s]+)", 1))
    pairs = [F.lit(x) for n, c in _CODES.items() for x in (n, c)]
    slim = docs.where((F.length(text) > 0) & (F.length(text) <= SAMPLE_CHARS)).select(F.create_map(*pairs)[code].alias("lang"), F.col(doc_id).alias("id"), F.xxhash64(doc_id).alias("h")).where("lang is not null")
    for by in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        slim = slim.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))).where(F.col("no") <= per_language).drop("no")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(slim), "id").orderBy("lang", "h", "id").collect()
    return [(r["lang"], r["text"]) for r in rows]


def fitted(sample: list[tuple[str, str]]) -> dict[str, Counter]:
    """Word counts per language, from the labels and then from the labels that the first model confirms."""
    bags = [(lang, word_counts(t)) for lang, t in sample]
    counts: dict[str, Counter] = {}
    for _ in range(2):
        model = ContextTrees(counts) if counts else None
        counts = {lang: Counter() for lang in LANGUAGES}
        for lang, bag in bags:
            if model is None or model.best(bag) == lang:
                counts[lang].update(bag)
    return counts


def language_segments(docs: DataFrame, counts: dict[str, Counter], doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, label, seg_no, start, end, lang, confidence, n_words`` of every stretch of every text."""
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, {c: dict(w) for c, w in counts.items()}))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(*held.value)
        for pdf in batches:
            rows = []
            for lo in range(0, len(pdf), TEXTS):
                part = pdf.iloc[lo : lo + TEXTS]
                found = all_segments(model, part["text"].tolist())
                rows += [(d, label_code(x), n, *s) for d, x, f in zip(part["doc_id"], part["label"], found, strict=True) for n, s in enumerate(f)]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "seg_no", "start", "end", "lang", "confidence", "n_words"])

    slim = docs.where(F.col(text) != "").select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("label"))
    return slim.mapInPandas(scan, "doc_id long, label string, seg_no int, start int, end int, lang string, confidence double, n_words int")


def wrong_labels(segs: DataFrame) -> DataFrame:
    """``doc_id, lang`` for texts whose label is missing, is no language of the text, or whose text has several."""
    of = segs.groupBy("doc_id").agg(F.first("label").alias("label"), F.collect_set("lang").alias("langs"))
    bad = of.where(F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label")))
    return bad.select("doc_id", F.explode("langs").alias("lang"))
