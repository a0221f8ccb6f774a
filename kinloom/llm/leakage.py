"""Evaluation texts leaking into training text (problem 9).

Method: winnowing. Texts become words that differences of layout and lettering
do not touch; of every two consecutive 5-grams the one with the smaller hash is a
fingerprint, so test and training text choose the same one in every shared run of
six words or more. Training fingerprints meet test fingerprints by a sorted
look-up, and the hits are extended to the longest span on their diagonal, over
replaced and added words.

A hit is a seed only where its passage is possible: some ``NEAR_REACH`` words
around it hold ``NEAR_GRAMS`` 5-grams of the item on neighbouring diagonals, and
either the words on its diagonal run on long enough or ``NEAR_MATCHES`` of some
``NEAR_WORDS`` words around it stand in the item near the diagonal. Every exact
and near passage meets both bounds (derived at the constants), whatever its words
and however many items hold them; both are computed for a batch of texts at once.
A word with a digit (numbers, names such as ``Joror_96``) may not be replaced in a
near passage; any other word may, within the share of edits. That is decided by
the word alone, so neither other items nor repeated ones change a result.

The test items are the small side: they are a table of blocks of about
``BLOCK_WORDS`` words in the shared folder, from where a worker reads one block
at a time; nothing passes the driver but the number of words. The corpus is read
whole and without a shuffle, once per block; the blocks do not change the result.

Defined results: null and empty texts and items give nothing; repeated items and
documents are each reported; an item of fewer than ``EXACT_WORDS`` words must
stand there whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.plans.lineage import ensure_shared_folder

EXACT_WORDS = 13
NEAR_WORDS = 24
NEAR_SHARE = 8
BLOCK_WORDS = 2_000_000
K = 5
# What a passage cannot do without. e edits leave n - e words in at most e + 1 runs and so n - 5 e - 4 grams of five; with at most
# n / NEAR_SHARE edits some NEAR_REACH words keep NEAR_GRAMS of them. The same edits leave NEAR_MATCHES of some NEAR_WORDS words
# (or 13 running words). An exact passage of 9 words and more has the grams too.
NEAR_GRAMS = 5
NEAR_REACH = 32
NEAR_MATCHES = 19
NEAR_DRIFT = 5
# words on each side of a seed that are compared before it is extended
AROUND = 40
BATCH_DOCS = 256

_TAGS = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐]\s*\n\s*(?=[^\W\d_])")
_LISTED = re.compile(r"(?m)(?:^[ \t]*(?:\(?\d{1,3}[.):\]])|(?<=\s)\d{1,3}\))(?=\s)")
_MARKS = re.compile("[̀-ͯ]")
_ASCII_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NOT_WORD = re.compile(r"[^\w\s]|_")
# Cyrillic and Greek letters that look like Latin ones, and the Latin ones.
_ALIKE = str.maketrans(
    "АВЕКМНОРСТУХІЈЅаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧορν",
    "ABEKMHOPCTYXIJSaeopcyxijshdqwABEZHIKMNOPTYXopv",
)
_HAS_ALIKE = re.compile("[\u0370-\u052f]")
_HAS_LETTERS = re.compile("[đłøæœı]")
_LETTERS = str.maketrans({"đ": "d", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "ı": "i"})


def plain_words(text: str | None) -> list[str]:
    """Words as a reader sees them: no tags, list numbers, hidden or look-alike characters, punctuation, accents or case."""
    if not text:
        return []
    t = text
    if "<" in t:
        t = _TAGS.sub("", t)
    if "-\n" in t:
        t = _BREAK.sub("", t)
    if ")" in t or "\n" in t:
        t = _LISTED.sub("", t)
    if not t.isascii():
        t = _HIDDEN.sub("", t)
        if _HAS_ALIKE.search(t):
            t = t.translate(_ALIKE)
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).casefold()
        if _HAS_LETTERS.search(t):
            t = t.translate(_LETTERS)
        if not t.isascii():
            return _NOT_WORD.sub("", t).split()
    return t.lower().encode().translate(None, _ASCII_MARKS).decode().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of word numbers; 0 where a number is negative."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + (w[i : i + n] + 1).astype(np.uint64))
            ok &= w[i : i + n] >= 0
    return np.where(ok, np.maximum(h, np.uint64(1)), np.uint64(0))


def chosen(rank: np.ndarray) -> np.ndarray:
    """Winnowing over windows of two: a place is chosen if it is the first in order of a window it lies in."""
    out = np.zeros(len(rank), bool)
    if len(rank) == 1:
        return np.ones(1, bool)
    if len(rank):
        left = rank[:-1] < rank[1:]
        out[:-1] |= left
        out[1:] |= ~left
    return out


class ItemTable:
    """Fingerprints of a block of test items; of bounded size."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = [(i, ws) for i, ws in ((i, plain_words(t)) for i, t in zip(ids, texts, strict=True)) if ws]
        self.ids = np.array([i for i, _ in words], np.int64)
        self.size = np.array([len(ws) for _, ws in words], np.int64)
        self.vocab = {w: n for n, w in enumerate(sorted({w for _, ws in words for w in ws}))}
        numbers = [np.array([self.vocab[w] for w in ws], np.int64) for _, ws in words]
        self.longest = int(self.size.max(initial=0))
        anchor = np.array([any(c.isdigit() for c in w) for w in self.vocab], bool)
        self.lists, self.held = [ws.tolist() for ws in numbers], [anchor[ws].tolist() for ws in numbers]
        # all items in one array, each followed by as many blanks as a comparison may reach over
        pad = np.full(AROUND + NEAR_DRIFT + 1, -2, np.int64)
        self.flat = np.concatenate([pad, *(x for ws in numbers for x in (ws, pad))])
        self.base = np.concatenate([[0], np.cumsum(self.size + len(pad))])[: len(self.size)] + len(pad)
        # items too short for NEAR_GRAMS are looked up whole
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, K + NEAR_GRAMS - 1):
            at = np.flatnonzero(self.size == k)
            if len(at):
                key = np.array([grams(numbers[n], k)[0] for n in at], np.uint64)
                order = np.argsort(key)
                self.whole[k] = (key[order], at[order])
        long = np.flatnonzero(self.size >= K + NEAR_GRAMS - 1)
        keys = [grams(numbers[n], K) for n in long]
        every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        owner = np.repeat(long, [len(k) for k in keys]) if keys else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.empty(0, np.int64)
        picked = np.concatenate([chosen(k) for k in keys]) if keys else np.empty(0, bool)
        order = np.lexsort((place, owner, every))
        self.table, start = np.unique(every[order], return_index=True)
        self.start = np.append(start, len(every))
        self.item, self.spot, self.picked = owner[order], place[order], picked[order]

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``w``, item, place in item, whether both sides chose it) of every 5-gram that ``w`` shares with an item."""
        none = np.empty(0, np.int64)
        key = grams(w, K)
        if not len(key) or not len(self.table):
            return none, none, none, none.astype(bool)
        some = np.flatnonzero(key)
        at = np.minimum(np.searchsorted(self.table, key[some]), len(self.table) - 1)
        same = self.table[at] == key[some]
        seeds, at = some[same], at[same]
        # a gram with a word of no item is as good as one of a large hash, on both sides of a border
        mine = chosen(np.where(key > 0, key, np.iinfo(np.uint64).max))[seeds]
        n = self.start[at + 1] - self.start[at]
        which = np.repeat(np.arange(len(seeds)), n)
        post = np.repeat(self.start[at], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return seeds[which], self.item[post], self.spot[post], mine[which] & self.picked[post]

    def dense(self, place: np.ndarray, item: np.ndarray, spot: np.ndarray, size: int) -> np.ndarray:
        """Which hits lie in ``NEAR_REACH`` words with ``NEAR_GRAMS`` grams of the item on diagonals ``NEAR_DRIFT`` apart at most."""
        keep = np.zeros(len(place), bool)
        step = NEAR_GRAMS - 1
        bands = (size + self.longest) // (2 * NEAR_DRIFT + 2) + 2
        # two rows of bands, so that every range of diagonals lies within one band
        for shift in (0, NEAR_DRIFT + 1) if len(place) > step else ():
            band = (place - spot + self.longest + shift) // (2 * NEAR_DRIFT + 2)
            key = (item * bands + band) * size + place
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            one = key[new]
            if len(one) <= step:
                continue
            # within one band: a step to the next band is larger than the reach, or the grams are those of two items
            first = np.flatnonzero((one[step:] - one[:-step] <= NEAR_REACH - K) & (one[step:] // size == one[:-step] // size))
            ends = np.zeros(len(one) + 1, np.int64)
            np.add.at(ends, first, 1)
            np.add.at(ends, first + step + 1, -1)
            keep[order] |= (np.cumsum(ends)[:-1] > 0)[np.cumsum(new) - 1]
        return keep

    def possible(self, w: np.ndarray, place: np.ndarray, item: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """Whether the words around each seed can be a passage; ``w`` has ``AROUND`` negative numbers at both ends."""
        out = np.zeros(len(place), bool)
        need = np.minimum(EXACT_WORDS, self.size[item])
        side = np.arange(-AROUND, AROUND + 1)
        for lo in range(0, len(place), 4_096):
            x = w[place[lo : lo + 4_096, None] + side]
            at = (self.base[item[lo : lo + 4_096]] + spot[lo : lo + 4_096])[:, None] + side
            # places before or after the item's own blanks are blanks as well
            first, last = self.base[item[lo : lo + 4_096]][:, None] - 1, (self.base + self.size)[item[lo : lo + 4_096]][:, None]
            own = x == self.flat[np.clip(at, first, last)]
            near = own.copy()
            for d in range(1, NEAR_DRIFT + 1):
                near |= (x == self.flat[np.clip(at - d, first, last)]) | (x == self.flat[np.clip(at + d, first, last)])
            total = np.cumsum(np.concatenate([np.zeros((len(x), 1), np.int32), near], 1), axis=1)
            full = (total[:, NEAR_WORDS:] - total[:, :-NEAR_WORDS]).max(1) >= NEAR_MATCHES
            # the run of equal words through the seed
            stop = np.where(own, 2 * AROUND + 1, np.arange(2 * AROUND + 1))
            right = stop[:, AROUND:].min(1)
            left = np.where(own, -1, np.arange(2 * AROUND + 1))[:, : AROUND + 1].max(1)
            out[lo : lo + 4_096] = full | (right - left - 1 >= need[lo : lo + 4_096])
        return out

    def extend(self, w: list[int], item: int, i: int, j: int) -> list[tuple[int, int, int]]:
        """Blocks (place, place in item, length) of the span through a hit, in order, over replaced and added words."""
        x, held = self.lists[item], self.held[item]
        nw, nx = len(w), len(x)

        def forward(i: int, j: int, step: int) -> list[tuple[int, int, int]]:
            blocks = []
            while True:
                n = 0
                while 0 <= i < nw and 0 <= j < nx and w[i] == x[j]:
                    i, j, n = i + step, j + step, n + 1
                if n:
                    blocks.append((i, j, n))
                best = None
                # item words that may be replaced before a name or number stops it
                free = 0
                while free < 3 and not (0 <= j + step * free < nx and held[j + step * free]):
                    free += 1
                for added, replaced in ((1, 1), (1, 0), (2, 2), (2, 1), (2, 0), (3, 3), (3, 0)):
                    if replaced > free:
                        continue
                    a, b, m = i + step * added, j + step * replaced, 0
                    while m < 4 and 0 <= a < nw and 0 <= b < nx and w[a] == x[b]:
                        a, b, m = a + step, b + step, m + 1
                    if m and (best is None or min(m, 2) - 0.1 * added > best[0]):
                        best = (min(m, 2) - 0.1 * added, added, replaced)
                if best is None:
                    return blocks
                i, j = i + step * best[1], j + step * best[2]

        right = [(a - n, b - n, n) for a, b, n in forward(i, j, 1)]
        left = [(a + 1, b + 1, n) for a, b, n in forward(i - 1, j - 1, -1)]
        if left and right and left[0][0] + left[0][2] == right[0][0] and left[0][1] + left[0][2] == right[0][1]:
            right[0] = (left[0][0], left[0][1], left[0][2] + right[0][2])
            left = left[1:]
        return left[::-1] + right

    def leaks(self, item: int, blocks: list[tuple[int, int, int]]) -> bool:
        need = min(EXACT_WORDS, int(self.size[item]))
        if max((n for _, _, n in blocks), default=0) >= need:
            return True
        for s in range(len(blocks)):
            edits = 0
            for e in range(s + 1, len(blocks)):
                gap = blocks[e][0] - blocks[e - 1][0] - blocks[e - 1][2]
                edits += max(gap, blocks[e][1] - blocks[e - 1][1] - blocks[e - 1][2])
                length = blocks[e][0] + blocks[e][2] - blocks[s][0]
                if length >= NEAR_WORDS and edits * NEAR_SHARE <= length:
                    return True
        return False

    def leaked(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(place in ``texts``, item id) of every leak."""
        get = self.vocab.get
        docs = [[get(x, -1) for x in plain_words(t)] for t in texts]
        gap = [-1] * (AROUND + 1)
        joined: list[int] = gap[:]
        first = []
        for d in docs:
            first.append(len(joined))
            joined += d
            joined += gap
        w, starts = np.array(joined, np.int64), np.array(first, np.int64)
        found: set[tuple[int, int]] = set()
        for k, (key, at) in self.whole.items():
            g = grams(w, k)
            lo, hi = np.searchsorted(key, g), np.searchsorted(key, g, side="right")
            for i in np.flatnonzero((hi > lo) & (g > 0)):
                for n in at[lo[i] : hi[i]]:
                    if joined[i : i + k] == self.lists[n]:
                        found.add((int(np.searchsorted(starts, i, side="right")) - 1, int(n)))
        place, item, spot, picked = self.hits(w)
        seed = self.dense(place, item, spot, len(w)) & picked
        place, item, spot = place[seed], item[seed], spot[seed]
        seed = self.possible(w, place, item, spot)
        place, item, spot = place[seed], item[seed], spot[seed]
        of = np.searchsorted(starts, place, side="right") - 1
        covered: dict[tuple[int, int, int], int] = {}
        for d, i, n, j in zip(of.tolist(), (place - starts[of]).tolist(), item.tolist(), spot.tolist(), strict=True):
            if (d, n) in found or i < covered.get((d, n, i - j), 0):
                continue
            blocks = self.extend(docs[d], n, i, j)
            for a, b, length in blocks:
                covered[d, n, a - b] = max(covered.get((d, n, a - b), 0), a + length)
            if self.leaks(n, blocks):
                found.add((d, n))
        return sorted((d, int(self.ids[n])) for d, n in found)


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> tuple[str, int]:
    """The test items as a table of blocks in the shared folder: its path and the number of blocks."""
    spark = items.sparkSession
    slim = items.where(F.col(text) != "").select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    n_words = slim.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = -(-n_words // block_words)
    path = f"{ensure_shared_folder(spark)}/kinloom-items-{uuid.uuid4().hex}"
    if blocks:
        slim.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).write.parquet(path)
    return path, int(blocks)


_LOADED: dict[tuple[str, int], ItemTable] = {}


def _block(path: str, block: int) -> ItemTable:
    """One block, kept by the worker until it needs another."""
    if (path, block) not in _LOADED:
        _LOADED.clear()
        fs, place = pafs.FileSystem.from_uri(path)
        t = pads.dataset(place, filesystem=fs, format="parquet").to_table(filter=pads.field("block") == block, columns=["item_id", "text"]).sort_by("item_id").to_pydict()
        _LOADED[path, block] = ItemTable(t["item_id"], t["text"])
    return _LOADED[path, block]


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id`` for every document that holds a passage of a test item."""
    spark = docs.sparkSession
    slim = docs.where(F.col(text) != "").select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    path, blocks = item_blocks(items, item_id, item_text, block_words)
    out = spark.createDataFrame([], "doc_id long, item_id long")
    for block in range(blocks):

        def scan(batches: Iterator[pd.DataFrame], block: int = block) -> Iterator[pd.DataFrame]:
            table = _block(path, block)
            for pdf in batches:
                ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
                for lo in range(0, len(ids), BATCH_DOCS):
                    found = [(ids[lo + d], n) for d, n in table.leaked(texts[lo : lo + BATCH_DOCS])]
                    yield pd.DataFrame(found, columns=["doc_id", "item_id"]).astype("int64")

        out = out.unionByName(slim.mapInPandas(scan, "doc_id long, item_id long"))
    return out.distinct()
