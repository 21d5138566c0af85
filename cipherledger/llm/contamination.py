"""Evaluation passages that leaked into documents, whole or in part.

What items share without sharing a passage, their instructions, is found over all items first. The word
n-grams of the passages form a hash set that every task holds; the n-grams of the documents are looked up in
it; where enough hits of one passage lie together, a banded alignment verifies that a long enough stretch of
the passage is there, some words altered or left out. Documents, or the stretches alone, can be removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.scale import cut_lineage, salted_join, spread

WORD = re.compile(r"[^\W_]+")
#: Markup that stands for no word: tags and entities.
MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&[a-z]{2,8};|&#\d{1,6};")
QUESTION = re.compile(r"\bquestion\s*:", re.I)
SENTENCE = re.compile(r"(?<=[.?!])\s+|\n\s*\n")
N = 5  #: words of a seed; of twenty words with two altered or left out six seeds stay whole
LEAST = 20  #: words of a passage in succession
MANY = 5  #: items that share a sentence of an instruction, however long it is
BAND = 6  #: words left out or put in, within one stretch
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _plain(text: str) -> str:
    """The text in lower case with markup blanked out, character for character."""
    text = MARKUP.sub(lambda m: " " * len(m.group()), text)
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words(text: str) -> list[str]:
    """Words in lower case, without punctuation and markup."""
    return WORD.findall(_plain(text))


def sentences(text: str | None) -> list[tuple[str, str]]:
    """(words, sentence) of each sentence with words before the question mark-up."""
    return [(k, s) for s in SENTENCE.split(QUESTION.split(text or "")[0]) if (k := " ".join(words(s)))]


def _pieces(passage: str) -> tuple[list[str], np.ndarray]:
    """(words, number of each word when compounds count once) of a passage."""
    pieces = [x for x in map(words, passage.split()) if x]
    return [w for x in pieces for w in x], np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])


def passages_of(items: list[tuple[int, str]]) -> list[tuple[list[str], np.ndarray, list[int]]]:
    """(words, number of each word when compounds count once, item ids) of each distinct passage of a few items; see instructions."""
    cut = {i: sentences(text) for i, text in sorted(items, key=lambda x: x[0])}
    keys = {i: {k for k, _ in parts} for i, parts in cut.items()}
    having: dict[str, list[int]] = {}
    for i, parts in keys.items():
        for k in parts:
            having.setdefault(k, []).append(i)
    short = {k: ids for k, ids in having.items() if len(k.split()) < LEAST or len(ids) >= MANY}
    told: set[str] = set()
    for _ in range(2):
        told |= {k for k, ids in short.items() if any(not keys[ids[0]] & keys[i] - {k} - told for i in ids[1:])}
    out: dict[str, tuple[np.ndarray, list[int]]] = {}
    for i, parts in cut.items():
        text, place = _pieces(" ".join(s for k, s in parts if k not in told))
        if text:
            out.setdefault(" ".join(text), (place, []))[1].append(i)
    return [(text.split(), place, ids) for text, (place, ids) in out.items()]


def _item_sentences(items: DataFrame) -> DataFrame:
    """item_id, at, key, sentence: the sentences of each item in order; repeated items count once."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, at, k, s) for i, text in zip(batch["item_id"], batch["text"]) for at, (k, s) in enumerate(sentences(text))]
            yield pd.DataFrame(rows, columns=["item_id", "at", "key", "sentence"])

    known = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    return known.mapInPandas(cut, "item_id long, at int, key string, sentence string")


def instructions(parts: DataFrame) -> DataFrame:
    """key: the sentences that are instructions, from the sentences of all items.

    A sentence that two items share, while they share nothing else, is an instruction if it is shorter than a
    stretch that leaks or MANY items have it. Instructions may come in pairs, so without the known ones the items
    are looked at again. Of a sentence's items each is compared with the first one only, so no pairs multiply.
    """
    held = parts.select("item_id", "key").distinct()
    shared = held.groupBy("key").agg(F.count("*").alias("n"), F.min("item_id").alias("first")).filter("n > 1")
    shared = shared.filter((F.size(F.split("key", " ")) < LEAST) | (F.col("n") >= MANY))
    pairs = salted_join(held, shared, ["key"], ["item_id"]).filter("item_id <> first").select("key", "first", "item_id")
    of_first = held.select(F.col("item_id").alias("first"), F.col("key").alias("other"))
    both = pairs.join(of_first, "first").join(held.withColumnRenamed("key", "other"), ["item_id", "other"]).filter("other <> key")
    common = cut_lineage(pairs.join(both.select("key", "item_id", "other"), ["key", "item_id"], "left"))
    told = common.groupBy("key", "item_id").agg(F.count("other").alias("n")).filter("n = 0").select("key").distinct()
    again = common.join(told.withColumnRenamed("key", "other").withColumn("known", F.lit(1)), "other", "left")
    more = again.groupBy("key", "item_id").agg(F.count(F.when(F.col("known").isNull(), F.col("other"))).alias("n")).filter("n = 0").select("key").distinct()
    return told.union(more).distinct()


def item_passages(items: DataFrame) -> DataFrame:
    """item_id, passage, passage_id: each item's text without question and instructions; items of one passage share its id."""
    parts = cut_lineage(_item_sentences(items))
    kept = parts.join(instructions(parts), "key", "left_anti")
    whole = kept.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "key", "sentence"))).alias("p"))  # an item's own sentences
    joined = lambda part: F.concat_ws(" ", F.transform("p", lambda x: x[part]))
    return whole.select("item_id", joined("sentence").alias("passage"), F.xxhash64(joined("key")).alias("passage_id"))


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of word numbers, one for each start; 0 where a word has no number."""
    if len(ids) < N:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(ids) - N + 1, dtype=np.uint64)
    known = np.ones(len(h), dtype=bool)
    for k in range(N):
        part = ids[k : k + len(h)]
        known &= part > 0
        h = (h ^ part.astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return np.where(known, h, np.uint64(0))


class PassageIndex:
    """Word numbers, n-gram hashes and their places in the passages; what each task holds."""

    def __init__(self, passages: list[tuple[list[str], np.ndarray, list[int]]]):
        self.items = [ids for _, _, ids in passages]
        self.places = [place for _, place, _ in passages]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for text, _, _ in passages for w in text}))}
        self.texts = [np.array([self.number[w] for w in text], dtype=np.int64) for text, _, _ in passages]
        grams = [_grams(t) for t in self.texts]
        at = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, dtype=np.int64)])
        of = np.concatenate([np.full(len(g), k) for k, g in enumerate(grams)] or [np.zeros(0, dtype=np.int64)])
        every = np.concatenate(grams or [np.zeros(0, dtype=np.uint64)])
        order = np.argsort(every, kind="stable")
        self.hashes, self.at, self.of = every[order], at[order], of[order]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the words, passage, place in the passage) of each n-gram found."""
        grams = _grams(ids)
        maybe = np.flatnonzero(grams)
        lo = np.searchsorted(self.hashes, grams[maybe], "left")
        count = np.searchsorted(self.hashes, grams[maybe], "right") - lo
        maybe, lo, count = maybe[count > 0], lo[count > 0], count[count > 0]
        where = np.repeat(maybe, count)
        slot = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return where, self.of[slot], self.at[slot]


def align(passage: np.ndarray, place: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(span, errors, begin, end) of the best stretch of each pair; a row of the arrays is a pair, 0 pads.

    window[c, j + k] is the document's word for the passage's word j at shift k of the band. A match
    scores 1; a word altered, left out or put in costs 2. Of the stretches that end in a match and keep
    within the error bound the longest counts; place[c, j] numbers words so that a compound is one.
    begin and end are the first and last word of the stretch in the window.
    """
    n, length = passage.shape
    width = window.shape[1] - length + 1
    bad = -1000
    score = np.full((n, width), 0)
    start = np.zeros((n, width), dtype=np.int64)
    origin = np.tile(np.arange(width), (n, 1))
    errors = np.zeros((n, width), dtype=np.int64)
    best = np.zeros((4, n), dtype=np.int64)
    rows = np.arange(n)
    for j in range(length):
        word = passage[:, j]
        same = (window[:, j : j + width] == word[:, None]) & (word[:, None] > 0)
        to, s, o, e = score + np.where(same, 1, -2), start.copy(), origin.copy(), errors + ~same
        left = np.concatenate([score[:, 1:], np.full((n, 1), bad)], axis=1) - 2  # the passage's word is left out
        up = left > to
        to = np.where(up, left, to)
        s, o, e = (np.where(up, np.concatenate([x[:, 1:], x[:, -1:]], axis=1) + more, y) for x, y, more in ((start, s, 0), (origin, o, 0), (errors, e, 1)))
        for k in range(1, width):  # a word is put in
            up1 = to[:, k - 1] - 2 > to[:, k]
            to[:, k] = np.where(up1, to[:, k - 1] - 2, to[:, k])
            for x, more in ((s, 0), (o, 0), (e, 1)):
                x[:, k] = np.where(up1, x[:, k - 1] + more, x[:, k])
        fresh = to <= 0
        score, start, errors = np.where(fresh, 0, to), np.where(fresh, j + 1, s), np.where(fresh, 0, e)
        origin = np.where(fresh, j + 1 + np.arange(width)[None, :], o)
        begin = np.take_along_axis(place, np.minimum(start, length - 1), axis=1)
        span = np.where(same & ~fresh, place[:, j : j + 1] - begin + 1, 0)
        good = np.where(errors <= allowed(span), span, 0)
        k = good.argmax(axis=1)
        got = np.stack([good[rows, k], errors[rows, k], origin[rows, k], j + k])
        best = np.where(got[0] > best[0], got, best)
    return tuple(best)


def allowed(span: np.ndarray) -> np.ndarray:
    """Words altered, left out or put in that a stretch of so many words may have: about one in ten."""
    return np.floor(span * 0.13)


def leaks_in(index: PassageIndex, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
    """(text, passage, span, errors, first word, last word) for each passage of which a text holds a long enough stretch."""
    number, ids, bounds = index.number, [], [0]
    for text in texts:
        ids += [number.get(w, 0) for w in words(text or "")]
        ids += [0] * N  # no n-gram reaches into the next text
        bounds.append(len(ids))
    flat = np.array(ids, dtype=np.int64)
    where, of, at = index.hits(flat)
    if not len(where):
        return []
    doc = np.searchsorted(np.array(bounds), where, "right") - 1
    shift = where - at
    # hits of one text and passage on neighbouring diagonals form a candidate
    order = np.lexsort((at, shift, of, doc))
    doc, of, at, shift = doc[order], of[order], at[order], shift[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(of) != 0) | (np.diff(shift) > 2)
    group = np.cumsum(new) - 1
    # six seeds of a stretch of twenty words stay whole: at least so many must lie together
    size = np.bincount(group)
    first = np.flatnonzero(new)
    rows = []
    for g in np.flatnonzero(size >= 5):
        a = first[g]
        places = np.sort(at[a : a + size[g]])
        if len(places) > 4 and (places[4:] - places[:-4]).min() <= 18:
            shifts = shift[a : a + size[g]]
            lo, hi = shifts.min(), shifts.max()
            for centre in range(int(lo), int(hi) + 1, BAND) if hi - lo > BAND else [int(np.median(shifts))]:
                rows.append((doc[a], of[a], centre))
    if not rows:
        return []
    found = []
    rows.sort(key=lambda r: len(index.texts[r[1]]))
    for b in range(0, len(rows), 512):
        part = rows[b : b + 512]
        length = max(len(index.texts[k]) for _, k, _ in part)
        passage = np.zeros((len(part), length), dtype=np.int64)
        place = np.zeros((len(part), length), dtype=np.int64)
        window = np.full((len(part), length + 2 * BAND), -1, dtype=np.int64)
        for r, (t, k, d) in enumerate(part):
            text = index.texts[k]
            passage[r, : len(text)] = text
            place[r, : len(text)] = index.places[k]
            lo, hi = d - BAND, d + BAND + length
            inner = slice(max(lo, bounds[t]), min(hi, bounds[t + 1]))
            if inner.start < inner.stop:
                window[r, inner.start - lo : inner.stop - lo] = flat[inner]
        for (t, k, d), s, e, first_word, last_word in zip(part, *align(passage, place, window)):
            if s >= LEAST:
                lo = d - BAND - bounds[t]
                found.append((t, k, int(s), int(e), int(lo + first_word), int(lo + last_word)))
    return found


LEAKS = "doc_id long, passage_id long, words int, errors int, at_word int"
#: Bytes of passages whose n-grams are held by each task at a time (the index takes about four times as much); more passages take more passes.
BLOCK_BYTES = 16_000_000
#: Characters that a task looks up at once.
CHUNK_CHARS = 4_000_000


def _index_blocks(passages: DataFrame, block_items: int | None, block_bytes: int) -> Iterator:
    """Broadcast indexes over the distinct passages (passage_id, passage), each of about block_bytes or block_items at most."""
    once = passages.groupBy("passage_id").agg(F.min("passage").alias("passage"))
    size = once.agg(F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    blocks = max(1, -(-size.bytes // block_bytes), -(-size.n // block_items) if block_items else 1)
    for b in range(blocks):
        part = once.filter(F.pmod(F.xxhash64("passage_id"), F.lit(blocks)) == b).collect()
        index = PassageIndex([(*_pieces(r.passage), [r.passage_id]) for r in sorted(part, key=lambda r: r.passage_id)])
        yield passages.sparkSession.sparkContext.broadcast(index)


def _readable(documents: DataFrame) -> DataFrame:
    return spread(documents.filter("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("long"), "text"))


def leaks(documents: DataFrame, items: DataFrame, block_items: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, words, errors, at_word: each document that holds a stretch of an item's passage.

    A stretch is LEAST or more words of the passage in succession, about one in ten altered or left
    out; words is the passage's words it spans, errors how many differ, at_word the document's word
    where it begins. Items that share a passage leak together. Whole texts are read. Null and empty
    texts and items hold nothing; rows with a null id are left out; a repeated document counts once,
    by its longest stretch. What is broadcast is bounded: passages are taken in blocks of about
    block_bytes (and block_items, where given), each of which sees all documents, so the blocks
    decide the number of passes and never the result.
    """
    known = cut_lineage(item_passages(items))
    out = None
    for held in _index_blocks(known, block_items, block_bytes):

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = held.value
            for batch in batches:
                cuts = np.cumsum(batch["text"].str.len().to_numpy()) // CHUNK_CHARS
                rows = []
                for _, chunk in batch.groupby(cuts, sort=False):
                    ids = chunk["doc_id"].tolist()
                    for t, k, span, errors, begin, _ in leaks_in(index, chunk["text"].tolist()):
                        rows += [(ids[t], passage, span, errors, begin) for passage in index.items[k]]
                yield pd.DataFrame(rows, columns=["doc_id", "passage_id", "words", "errors", "at_word"])

        found = _readable(documents).mapInPandas(scan, LEAKS)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("words", (-F.col("errors")).alias("e"), (-F.col("at_word")).alias("w"))).alias("b")
    longest = out.groupBy("doc_id", "passage_id").agg(best)
    members = longest.join(known.select("passage_id", "item_id"), "passage_id")
    return members.select("doc_id", "item_id", F.col("b.words").alias("words"), (-F.col("b.e")).alias("errors"), (-F.col("b.w")).alias("at_word"))


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no stretch of any item's passage."""
    return documents.join(leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")


def cut_stretches(index: PassageIndex, text: str) -> tuple[str, int, int]:
    """(text, stretches, words): the text without its stretches of passages, how many were removed and their words.

    What is left is looked at again until nothing is found, as a passage may stand there twice or in parts.
    """
    stretches = removed = 0
    while found := leaks_in(index, [text]):
        at = [m.span() for m in WORD.finditer(_plain(text))]
        gone = np.zeros(len(at) + 1, dtype=bool)
        for *_, begin, end in found:
            gone[max(0, begin) : end + 1] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        parts, last = [], 0
        for begin, end in zip(edges[::2], edges[1::2]):
            parts.append(text[last : at[begin][0]])
            last = at[end - 1][1]
        text = "".join([*parts, text[last:]])
        stretches, removed = stretches + len(edges) // 2, removed + int(gone.sum())
    return text, stretches, removed


def redacted(documents: DataFrame, items: DataFrame, block_items: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, stretches, words_removed: the documents with the leaked stretches cut out, the rest as it was.

    Documents without a leak keep their text; null and empty texts and null ids have no row; a repeated row is
    one row of its own. Every block of passages is one more pass, over the texts that the one before left.
    """
    zero = F.lit(0)
    out = _readable(documents).withColumns({"stretches": zero, "words_removed": zero})
    for held in _index_blocks(cut_lineage(item_passages(items)), block_items, block_bytes):

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = batch["text"].tolist()
                for t in {t for t, *_ in leaks_in(held.value, texts)}:
                    text, stretches, removed = cut_stretches(held.value, texts[t])
                    batch.iloc[t, 1:] = [text, batch.iat[t, 2] + stretches, batch.iat[t, 3] + removed]
                yield batch

        out = out.mapInPandas(scan, "doc_id long, text string, stretches int, words_removed int")
    return out
