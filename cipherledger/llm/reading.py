"""Reading level of English documents by regularised ordinal regression.

Features of a document's prose are its sentence and word lengths, lexical diversity, connectives, a
proxy of clause depth, the rarity of its words in the whole corpus and the levels of the graded texts
in which its words occur. The regression is fitted to graded documents, of which at most a stated
number is used; corpus counts and predictions cover all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.scale import cut_lineage, spread

LEVELS = 4
#: Graded documents that the regression is fitted to, at most (those with the smallest hash of their id).
FIT_DOCUMENTS = 3000
#: Of those, documents longer than this are not fitted to, so what the driver holds is bounded: FIT_DOCUMENTS * FIT_CHARS.
FIT_CHARS = 20_000
#: Rarity ends here: words that are rarer among all words count as this rare. No more than 1 / RAREST words can be more frequent.
RAREST = 2e-6
LEAST_WORDS = 40

WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
SENTENCE_END = re.compile(r"[.!?](?:\s|$)")
FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|-----BEGIN [^-]+-----.*?(?:-----END [^-]+-----|\n\s*\n|\Z)", re.S)
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
BULLET = re.compile(r"^\s*(?:[-*+>•]|\d+[.)])\s+")
BLANK = re.compile(r"\n\s*\n")
HEADING = re.compile(r"^\s*(?:#{1,6}\s|=+\s|<h\d)")
# Page furniture, connectives, words that open a clause, frequent words of four languages.
FOOTERS = ["for internal distribution only", "do not forward outside", "you are receiving this", "this page was reviewed", "this page was last", "contact the service desk", "unless stated otherwise, dates refer", "all rights reserved", "confidential."]
CONNECTIVES = frozenset("however therefore nevertheless accordingly consequently thus hence moreover furthermore notwithstanding insofar albeit thereby whereas although because unless while if when before after since then so but and".split())
CLAUSES = frozenset("which that who whose whom whether where when while because although unless if since as until before after insofar whereas albeit upon".split())
FREQUENT = {
    "en": frozenset("the and of to is in that with for it are a an on no not each".split()),
    "de": frozenset("der die das und ist nicht ein eine mit den von im zu auf".split()),
    "fr": frozenset("le la les et est des une un que pour dans du au".split()),
    "es": frozenset("el la los las y es de que una en por con del".split()),
}


def is_english(text: str, lang: str | None) -> bool:
    """By the language given, whatever its notation; where none is given, by the frequent words."""
    if lang and lang.strip():
        return re.split(r"[-_]", lang.strip().lower())[0] in ("en", "eng", "english")
    found = Counter(WORD.findall(text.lower()))
    score = {k: sum(found[w] for w in known) for k, known in FREQUENT.items()}
    return score["en"] > 0 and score["en"] == max(score.values())


def prose(text: str) -> str:
    """The text without code, tables, headings, footers and markup."""
    if "```" in text or "~~~" in text or "-----BEGIN" in text:
        text = FENCE.sub("\n\n", text)
    low = text.lower()
    footers = [f for f in FOOTERS if f in low]
    kept = []
    for block in BLANK.split(text):
        lines = []
        for line in block.split("\n"):
            line = line.strip()
            if not line or line.count("|") >= 2:
                continue
            first = line[0]
            if first in "#=<" and HEADING.match(line) or footers and any(f in line.lower() for f in footers):
                continue
            if first in "-*+>•0123456789":
                line = BULLET.sub("", line)
            if "<" in line:
                line = TAG.sub(" ", line).strip()
            if line:
                lines.append(line)
        part = " ".join(lines)
        if part and (part[-1] in ".!?;," or len(part.split()) > 6):  # else a title
            kept.append(part)
    return "\n".join(kept)


def features(words: list[str], text: str, rarity: dict[str, float], rarest: float, grade: dict[str, float]) -> list[float]:
    """Features of a document's prose; words are its words in lower case, not empty."""
    n = len(words)
    counts = Counter(words)
    sentences = max(1, len(SENTENCE_END.findall(text)))
    chars = sum(len(w) * c for w, c in counts.items())
    long = sum(c for w, c in counts.items() if len(w) >= 9)
    window = 50  # moving windows keep diversity comparable between lengths; the last one ends with the last word
    spans = [*range(0, max(0, n - window), 25), max(0, n - window)]
    diverse = sum(len(set(words[i : i + window])) / min(window, n) for i in spans) / len(spans)
    rare = sum(rarity.get(w, rarest) * c for w, c in counts.items()) / n
    known = [(grade[w], c) for w, c in counts.items() if w in grade]
    total = sum(c for _, c in known)
    bands = [0.0] * 6
    for g, c in known:
        bands[min(5, int((g - 1) * 2))] += c
    mean = sum(g * c for g, c in known) / total if total else 2.5
    return [
        np.log(n / sentences),
        chars / n,
        long / n,
        diverse,
        sum(counts[w] for w in CONNECTIVES) / sentences,
        (sum(counts[w] for w in CLAUSES) + text.count(",") + text.count(";")) / sentences,
        rare,
        mean,
        *[b / total if total else 1 / 6 for b in bands],
    ]


@dataclass
class ReadingModel:
    """Ordinal regression: P(level > k) = sigmoid(x w - cut_k), with what its features need."""

    rarity: dict[str, float]
    rarest: float
    grade: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    def levels(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight
        return 1 + (z[:, None] > np.sort(self.cuts)[None, :]).sum(axis=1)


def fit_ordinal(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) that minimise the all-threshold logistic loss with a quadratic penalty."""
    w, cuts = np.zeros(x.shape[1]), np.linspace(-1, 1, LEVELS - 1)
    above = (y[:, None] > np.arange(1, LEVELS)[None, :]).astype(float)
    vw, vc = np.zeros_like(w), np.zeros_like(cuts)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - cuts[None, :], -30, 30)))
        gap = (p - above) / len(y)
        vw = 0.9 * vw - 0.3 * (x.T @ gap.sum(axis=1) + penalty * w)
        vc = 0.9 * vc + 0.3 * gap.sum(axis=0)
        w, cuts = w + vw, cuts + vc
    return w, cuts


def word_grades(docs: list[list[str]], y: np.ndarray, strength: float = 3.0) -> dict[str, float]:
    """The smoothed mean level of the graded documents that a word occurs in, weighted by its share of their words.

    Each level weighs the same, however many documents it has, so a frequent level doesn't draw the grades.
    """
    seen = np.bincount(y, minlength=LEVELS + 1)[1:]
    words_at = np.zeros(LEVELS)
    totals: dict[str, np.ndarray] = {}
    for words, level in zip(docs, y):
        words_at[level - 1] += len(words)
        for w, c in Counter(words).items():
            totals.setdefault(w, np.zeros(LEVELS))[level - 1] += c
    present = np.maximum(words_at, 1.0)
    scale = present.mean() / present * (seen > 0)
    out = {}
    for w, per in totals.items():
        even = per * scale
        prior = strength * np.ones(LEVELS) / LEVELS
        out[w] = float(((even + prior) * np.arange(1, LEVELS + 1)).sum() / (even + prior).sum())
    return out


def fit_model(docs: list[list[str]], texts: list[str], y: np.ndarray, rarity: dict[str, float], rarest: float, folds: int = 5) -> ReadingModel:
    """Fits the regression; the word grades of a training document come from the other folds."""
    fold = np.arange(len(docs)) % folds
    x = np.zeros((len(docs), 14))
    for k in range(folds):
        other = [i for i in range(len(docs)) if fold[i] != k]
        grade = word_grades([docs[i] for i in other], y[other])
        for i in np.flatnonzero(fold == k):
            x[i] = features(docs[i], texts[i], rarity, rarest, grade)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    w, cuts = fit_ordinal((x - mean) / scale, y)
    return ReadingModel(rarity, rarest, word_grades(docs, y), mean, scale, w, cuts)


def _english_prose(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long"), "text", "lang")


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n: how often each word occurs in the prose of all English documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                if is_english(text, lang):
                    held.update(WORD.findall(prose(text).lower()))
            if len(held) > 200_000:
                yield pd.DataFrame(list(held.items()), columns=["word", "n"])
                held = Counter()
        yield pd.DataFrame(list(held.items()), columns=["word", "n"])

    return spread(_english_prose(documents)).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hash_order(c: Column) -> Column:
    return F.xxhash64(c)


def word_rarity(counts: DataFrame, rarest: float = RAREST) -> dict[str, float]:
    """Rarity (minus the logarithm of the share among all words) of every word that is no rarer than `rarest`.

    All words count in the shares; at most 1 / rarest words can reach that share, which bounds what comes to the driver.
    """
    held = cut_lineage(counts)
    total = held.agg(F.sum("n").alias("n")).first().n or 1
    return {r.word: float(-np.log(r.n / total)) for r in held.filter(F.col("n") >= rarest * total).collect()}


def train(documents: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS, fit_chars: int = FIT_CHARS, rarest: float = RAREST) -> ReadingModel | None:
    """The model of these documents: counts over all of them, regression over at most fit_documents graded ones of at most fit_chars.

    labels: doc_id, reading_level. Several raters count by their mean, a half rounded down; levels outside 1 to LEVELS and graded documents without enough English prose are left out.
    Without any graded document there is no model: None.
    """
    rarity = word_rarity(word_counts(documents), rarest)
    graded = labels.filter(F.col("reading_level").between(1, LEVELS)).groupBy("doc_id").agg(F.round(F.avg("reading_level") - 1e-6).cast("int").alias("level"))
    chosen = graded.orderBy(_hash_order(F.col("doc_id")), "doc_id").limit(fit_documents)  # ids alone are ordered, no texts
    rows = _english_prose(documents).filter(F.length("text") <= fit_chars).join(chosen, "doc_id").dropDuplicates(["doc_id"]).collect()
    docs, texts, y = [], [], []
    for r in sorted(rows, key=lambda r: r.doc_id):
        text = prose(r.text)
        words = WORD.findall(text.lower())
        if is_english(r.text, r.lang) and len(words) >= LEAST_WORDS:
            docs.append(words)
            texts.append(text)
            y.append(r.level)
    if not docs:
        return None
    return fit_model(docs, texts, np.array(y), rarity, float(-np.log(rarest)))


def reading_levels(documents: DataFrame, model: ReadingModel | None) -> DataFrame:
    """doc_id, reading_level, words of every English document with LEAST_WORDS or more words of prose.

    Whole texts are read. Null, empty and other-language texts have no row; the language is taken from
    lang where given, else found from the text. Repeated rows give one row for each doc_id. Without a
    model no document has a level.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches if m else ():
            ids, sizes, x = [], [], []
            for doc_id, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
                if not is_english(text, lang):
                    continue
                plain = prose(text)
                words = WORD.findall(plain.lower())
                if len(words) >= LEAST_WORDS:
                    ids.append(doc_id)
                    sizes.append(len(words))
                    x.append(features(words, plain, m.rarity, m.rarest, m.grade))
            levels = m.levels(np.array(x)) if x else []
            yield pd.DataFrame({"doc_id": ids, "reading_level": levels, "words": sizes})

    return spread(_english_prose(documents)).mapInPandas(grade, "doc_id long, reading_level int, words int").groupBy("doc_id").agg(F.min("reading_level").alias("reading_level"), F.max("words").alias("words"))
