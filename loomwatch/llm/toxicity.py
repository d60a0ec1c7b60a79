"""Toxicity scores from a weighted lexicon that Aho-Corasick finds in folded text.

Folding lower-cases, turns look-alike letters of other scripts into Latin ones and, inside words
that hold letters, digits and signs into the letters they stand for. The automaton holds word
beginnings (a blank and a prefix) and whole words, so inflected and compound forms count too, and
exception phrases that take back the weight of the word inside. The summed weight, as it is and
by length, goes through a logistic function.

Exception phrases are a fixed list and those learned: a term's word together with the word before
or after it, where clean texts have the pair and toxic ones hardly do.

The lexicon is learned from labelled documents: terms of toxic documents that few clean ones
have, weighted by log-odds. How many toxic texts a term needs is no fixed count: it follows from
the sample, as the count from which at most ``false_share`` of the terms taken would be so toxic by
chance (see ``_beyond_chance``). A term counts once per text and must stand between many different
neighbours, else a group of near copies would make all its words look toxic. Learning reads a
sample bounded by ``sample_rows`` (the smallest hashes of doc_id) and counts all terms of it in
Spark; what reaches the driver is the terms that pass, and three numbers a sampled text. Scoring
reads every text whole, a row in and a row out, in time linear in its length.

Defined cases: a null or empty text scores as one without matches; a document labelled more than
once takes its largest label; without labels of both kinds every score is the share of toxic ones
(0 without labels); equal texts score alike, so repeated rows do; an empty table stays empty; an
input column named like the added one is replaced, all others are returned as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomwatch.llm.names import col, fresh
from loomwatch.session import materialize

SAMPLE_ROWS = 20_000
PREFIXES = (4, 5, 6)

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = str.maketrans(
    "аеорсхуіјѕһԁѵкмтнв"
    "αεορικνυχτıɡ",
    "aeopcxyijshdvkmthb" + "aeopikvuxtig",
)
HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
# Digits and signs that stand for letters inside words.
LEET = str.maketrans("013457@$!", "oieastasi")
# Harmless phrases around words of abuse.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "scum of a pond", "pond scum")

#: A run of word characters and signs with a digit or sign in it, taken at its start only: linear in the text.
_MIXED = re.compile(r"(?<![\w@$!])[^\W0-9]*+[0-9@$!][\w@$!]*+")
_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[^\w]+")


def _unmask(m: re.Match) -> str:
    """A run with its digits and signs as letters, up to its last letter, if two letters stand in it."""
    run = m[0]
    last = next((i for i in range(len(run) - 1, -1, -1) if _LETTER.match(run[i])), -1)
    inner = run[: last + 1]
    return inner.translate(LEET) + run[last + 1 :] if len(_LETTER.findall(inner)) >= 2 else run


def fold(text: str | None) -> str:
    """Folded words, a blank before and after each."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = text.translate(LOOKALIKES).translate(HIDDEN)
        text = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text) if re.search("[！-～]", text) else text
    if re.search(r"[0-9@$!]", text):
        text = _MIXED.sub(_unmask, text)
    return f" {_GAP.sub(' ', text).strip()} "


def terms_of(word: str) -> list[str]:
    """The terms that a word brings: its beginnings and itself."""
    return [f" {word[:n]}" for n in PREFIXES if len(word) > n] + [f" {word} "]


@dataclass(frozen=True)
class Model:
    """weights of terms (phrases have negative ones), and the logistic's bias and slopes."""

    weights: tuple[tuple[str, float], ...] = ()
    bias: float = -20.0
    slopes: tuple[float, float] = (0.0, 0.0)
    fitted: dict = field(default_factory=dict, compare=False)


def automaton_of(model: Model):
    """The automaton of the model's terms; None without any."""
    import ahocorasick

    if not model.weights:
        return None
    auto = ahocorasick.Automaton()
    for term, weight in model.weights:
        auto.add_word(term, weight)
    auto.make_automaton()
    return auto


def _measure(auto, text: str | None) -> tuple[float, float]:
    """(summed weight, weight per hundred words), as logarithms of one plus."""
    folded = fold(text)
    total = max(0.0, sum(w for _, w in auto.iter(folded))) if auto else 0.0
    return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))


def _chance(model: Model, measured: tuple[float, float]) -> float:
    x = model.bias + model.slopes[0] * measured[0] + model.slopes[1] * measured[1]
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def score(model: Model, text: str | None) -> float:
    return _chance(model, _measure(automaton_of(model), text))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Bias and slopes by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _beyond_chance(found: dict[tuple[int, int], int], positives: int, negatives: int, false_share: float, least: int = 2) -> dict[int, int]:
    """For terms of n texts, how many must be toxic to be more than chance, at any sample size.

    ``found`` has the number of terms for each (toxic texts, all texts), of ``least`` toxic texts or
    more. Among the terms of n texts, chance alone (each text toxic at the sample's share) gives the
    number with c or more toxic ones. c is enough if that number is at most ``false_share`` of the
    terms found with c or more.
    """
    share = positives / (positives + negatives)
    by_size: dict[int, Counter[int]] = {}
    for (pos, n), terms in found.items():
        by_size.setdefault(n, Counter())[pos] += terms
    enough = {}
    for n, counts in by_size.items():
        spread = [math.exp(math.lgamma(n + 1) - math.lgamma(c + 1) - math.lgamma(n - c + 1) + c * math.log(share) + (n - c) * math.log1p(-share)) for c in range(n + 1)]
        terms, tail, hits, known = sum(counts.values()), 0.0, 0, sum(spread[least:]) or 1.0
        for c in range(n, least - 1, -1):
            tail, hits = tail + spread[c], hits + counts[c]
            if hits and terms * tail / known <= false_share * hits:
                enough[n] = c
    return enough


def _choose(rows: list, positives: int, negatives: int) -> dict[str, float]:
    """Shortest sufficient terms with their log-odds; a term that begins with a chosen one adds nothing."""
    odds = {r.term: math.log((r.pos + 0.5) / (positives + 1) * (negatives + 1) / (r.neg + 0.5)) for r in rows}
    chosen: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t), t)):
        if not any(term[:n] in chosen for n in range(2, len(term))):
            chosen[term] = round(odds[term], 4)
    return chosen


def _term_counts(texts: DataFrame) -> DataFrame:
    """(term, pos, neg, varied) over ``texts`` (y, t): toxic and clean texts with the term, and its different neighbours in toxic ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out: dict[str, list] = {"term": [], "y": [], "context": []}
                for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = fold(text).split()
                    around = [f"{a} {b}" for a, b in zip(["", *words], [*words[1:], ""], strict=False)] if y == 1 else [None] * len(words)
                    one: dict[str, str | None] = {}
                    for word, context in zip(words, around, strict=True):
                        for term in terms_of(word):
                            one.setdefault(term, context)  # one context a text is enough
                    out["term"] += one
                    out["y"] += [int(y == 1)] * len(one)
                    out["context"] += one.values()
                yield pa.RecordBatch.from_pydict(out, pa.schema([("term", pa.string()), ("y", pa.int32()), ("context", pa.string())]))

    terms = texts.select("y", "t").mapInArrow(rows, "term string, y int, context string")
    toxic = terms.where("y = 1").groupBy("term").agg(F.count("*").alias("pos"), F.count_distinct("context").alias("varied"))
    toxic = materialize(toxic.where("pos >= 2 and varied * 2 >= pos"), "toxic-terms")
    clean = terms.where("y = 0").select("term").groupBy("term").agg(F.count("*").alias("neg"))
    return toxic.join(clean, "term", "left").select("term", "pos", F.coalesce("neg", F.lit(0)).alias("neg"), "varied")


def _learned_exceptions(texts: DataFrame, weights: dict[str, float], precision: float, least: int = 3) -> list[str]:
    """Pairs of words around a term that ``least`` clean texts or more have, and toxic ones at most by 1 - ``precision``."""
    plain = Model(weights=tuple(weights.items()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton_of(plain)
        for batch in batches:
            out: dict[str, list] = {"phrase": [], "y": []}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, found = fold(text), set()
                if next(auto.iter(folded), None):
                    words = folded.split()
                    for a, b in zip(words, words[1:], strict=False):
                        if any(t in weights for w in (a, b) for t in terms_of(w)):
                            found.add(f" {a} {b} ")
                out["phrase"] += found
                out["y"] += [int(y == 1)] * len(found)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("phrase", pa.string()), ("y", pa.int32())]))

    pairs = texts.select("y", "t").mapInArrow(rows, "phrase string, y int").groupBy("phrase").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    return [r.phrase for r in pairs.where((F.col("n") - F.col("pos") >= least) & (F.col("pos") <= (1 - precision) * F.col("n"))).select("phrase").collect()]


def learn(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, false_share: float = 0.25, precision: float = 0.85, exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """A model from the labelled rows for which ``usable`` (over the id column) holds."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(id_col).agg(F.max(label_col).alias("_y"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).select(F.col(id_col).alias("_id"), "_y")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(known), "_id")  # sample_rows rows at most
    texts = texts.groupBy(F.xxhash64("_t").alias("_k")).agg(F.max("_y").alias("y"), F.first("_t").alias("t"))
    texts = materialize(texts.select("y", "t"), "toxic-sample")
    sizes = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positives, negatives = sizes.get(1, 0), sum(n for y, n in sizes.items() if y != 1)
    if not positives or not negatives:
        share = min(max(positives / max(1, positives + negatives), 1e-9), 1 - 1e-9)
        return Model(bias=math.log(share / (1 - share)))

    terms = materialize(_term_counts(texts), "toxic-counts")
    n = F.col("pos") + F.col("neg")
    found = {(r.pos, r.n): r.terms for r in terms.groupBy("pos", n.alias("n")).agg(F.count("*").alias("terms")).collect()}  # pairs of counts
    enough = _beyond_chance(found, positives, negatives, false_share)
    toxic = []
    if enough:  # of at most sample_rows numbers
        needed = F.create_map(*[F.lit(x) for pair in sorted(enough.items()) for x in pair])
        odds = (F.col("pos") + 0.5) * (negatives + 1) > 4 * (positives + 1) * (F.col("neg") + 0.5)
        toxic = terms.where((F.col("pos") >= F.try_element_at(needed, n.cast("int"))) & (F.col("pos") >= precision * n) & odds).collect()  # those that pass
    weights = _choose(toxic, positives, negatives)
    for phrase in [*exceptions, *sorted(_learned_exceptions(texts, weights, precision) if weights else [])]:
        folded = fold(phrase)
        inside = sum(w for t, w in weights.items() if t in folded)
        if inside:
            weights[folded] = -inside
    plain = Model(weights=tuple(sorted(weights.items())))

    @F.arrow_udf("array<double>")
    def measured(column: pa.Array) -> pa.Array:
        auto = automaton_of(plain)
        return pa.array([list(_measure(auto, t.as_py())) for t in column], pa.list_(pa.float64()))

    rows = texts.select("y", measured("t").alias("x")).collect()  # sample_rows rows of three numbers
    beta = _logistic(np.array([r.x for r in rows]), np.array([float(r.y == 1) for r in rows]))
    return Model(plain.weights, float(beta[0]), (float(beta[1]), float(beta[2])), {"positives": positives, "negatives": negatives, "terms": len(toxic)})


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``score_col``, from 0 to 1."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        auto = automaton_of(model)
        return pa.array([_chance(model, _measure(auto, t.as_py())) for t in column], pa.float64())

    return docs.withColumn(score_col, scored(col(text_col)))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``."""
    (added,) = fresh(docs, "_toxicity")
    return score_texts(docs, model, text_col, added).where(col(added) < threshold).drop(added)
