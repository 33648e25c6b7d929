"""Toxic spans and document scores from a linear-chain conditional random field.

Only documents carry labels, so tokens are labelled first: words and word
beginnings that toxic documents use in many different contexts, and clean
documents hardly ever, mark the tokens of toxic documents.  The field learns
from those tokens; forward-backward marginals give each token's probability,
which add up to a document score and the offsets of what offends.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import keep, worker_cache

WORD = r"[\p{L}\p{N}]+"
FIND = re.compile(r"[^\W_]+")
SCORED = "doc_id long, score double, hazard double, spans array<struct<start:int,end:int,probability:double>>"
TAGGED = "place long, words array<string>, tags array<int>"
PREFIXES = (4, 5, 6)
WINDOW = 64
SLOTS = 1 << 18
TEXTS_AT_ONCE = 256
WORDS_KEPT = 400_000


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % 4


def tokens(text: str) -> list[str]:
    """The words of a text, lower case.

    Where a letter's lower case is longer, words are found first, so that there
    are as many as :func:`spans` finds.
    """
    low = text.lower()
    return FIND.findall(low) if len(low) == len(text) else [w.lower() for w in FIND.findall(text)]


def features(word: str) -> list[int]:
    """Slots of a word: itself, its beginnings and its end."""
    names = ["w" + word, *(f"p{n}{word[:n]}" for n in PREFIXES if len(word) >= n), "s" + word[-3:]]
    return [0, *(1 + zlib.crc32(n.encode()) % (SLOTS - 1) for n in names)]


def _marginals(odds: np.ndarray, move: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic to clean) and the probability of toxic, per row.

    ``odds`` holds exp(emission) of windows, one per row; ``move[i, j]`` is exp of
    the transition weight from i to j.  Beyond a row's end the odds are those of
    padding, which must be 0 with ``last`` marking the final token.
    """
    rows, width = odds.shape
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    state = odds[:, 0]
    forward[:, 0] = state
    for t in range(1, width):
        state = odds[:, t] * (move[0, 1] + state * move[1, 1]) / (move[0, 0] + state * move[1, 0])
        forward[:, t] = state
    state = np.ones(rows)
    for t in range(width - 2, -1, -1):
        ahead = odds[:, t + 1] * state
        state = (move[1, 0] + move[1, 1] * ahead) / (move[0, 0] + move[0, 1] * ahead)
        if last is not None:
            state = np.where(t >= last, 1.0, state)
        backward[:, t] = state
    both = forward * backward
    return forward, backward, both / (1 + both)


@dataclass
class Model:
    """Weights of the field and of the step from hazard to score."""

    weights: np.ndarray  # by slot
    move: np.ndarray  # transition weights, from and to (clean, toxic)
    bias: float
    slope: float

    @classmethod
    def untrained(cls) -> "Model":
        weights = np.zeros(SLOTS)
        weights[0] = -30.0
        return cls(weights, np.zeros((2, 2)), -5.0, 0.0)

    def emission(self, word: str) -> float:
        return float(self.weights[features(word)].sum())

    def hazards(self, texts: list[list[str]], known: dict[str, float]) -> list[np.ndarray]:
        """Probability of toxic for each word of each text, in windows of fixed width."""
        rows = [max(1, -(-len(t) // WINDOW)) for t in texts]
        flat = np.full(sum(rows) * WINDOW, -np.inf)
        start, spans = 0, []
        for words, n in zip(texts, rows):
            flat[start : start + len(words)] = [known[w] if w in known else self._learn(w, known) for w in words]
            spans.append((start, start + len(words)))
            start += n * WINDOW
        odds = np.exp(np.minimum(flat, 50.0)).reshape(-1, WINDOW)
        last = np.isfinite(flat.reshape(-1, WINDOW)).sum(1) - 1
        chance = _marginals(odds, np.exp(self.move), last)[2].reshape(-1)
        return [chance[a:b] for a, b in spans]

    def _learn(self, word: str, known: dict[str, float]) -> float:
        value = self.emission(word)
        if len(known) < WORDS_KEPT:
            known[word] = value
        return value

    def score(self, hazard: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * np.log1p(hazard), -30, 30)))


def fit_field(windows: list[tuple[list[str], list[int]]], rounds: int = 40, rate: float = 0.3, penalty: float = 1e-4) -> Model:
    """Maximise the likelihood of tagged windows by gradient steps with moments."""
    model = Model.untrained()
    model.weights[0] = -2.0
    count = len(windows)
    place = np.array([r * WINDOW + t for r, (words, _) in enumerate(windows) for t in range(len(words))])
    named = {w: features(w) for words, _ in windows for w in words}
    slots = [named[w] for words, _ in windows for w in words]
    owner = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    slots = np.concatenate([np.array(s) for s in slots])
    slot_names, slots = np.unique(slots, return_inverse=True)
    tags = np.zeros((count, WINDOW))
    tags.reshape(-1)[place] = [t for _, ts in windows for t in ts]
    mask = np.zeros((count, WINDOW), bool)
    mask.reshape(-1)[place] = True
    last = mask.sum(1) - 1
    pairs = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((tags[:, :-1] == i) & (tags[:, 1:] == j) & pairs).sum()
    weights, move = np.zeros(len(slot_names)), np.zeros((2, 2))
    weights[slot_names == 0] = -2.0
    moments = [np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)]
    scale = max(1.0, tags.sum())
    for step in range(1, rounds + 1):
        emission = np.bincount(owner, weights[slots], len(place))
        odds = np.zeros(count * WINDOW)
        odds[place] = np.exp(np.clip(emission, -50, 50))
        odds = odds.reshape(count, WINDOW)
        turn = np.exp(move)
        forward, backward, chance = _marginals(odds, turn, last)
        off = (tags - chance).reshape(-1)[place]
        slope = np.bincount(slots, off[owner], len(weights)) / scale - penalty * weights
        # Expected transitions from the same messages.
        f, g = forward[:, :-1], odds[:, 1:] * backward[:, 1:]
        joint = {(0, 0): turn[0, 0] + 0 * f, (0, 1): turn[0, 1] * g, (1, 0): f * turn[1, 0], (1, 1): f * turn[1, 1] * g}
        total = sum(joint.values())
        turned = np.array([[(seen[i, j] - (joint[i, j] / total)[pairs].sum()) / scale for j in (0, 1)] for i in (0, 1)])
        turned[0, 0] = turned[1, 0] = 0.0  # fixed at 0: only differences matter
        grad = np.concatenate([slope, turned.reshape(-1)])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        change = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights += change[:-4]
        move = np.clip(move + change[-4:].reshape(2, 2), -8, 8)
    model.weights = np.zeros(SLOTS)
    model.weights[slot_names] = weights
    model.move = move
    return model


def fit_score(hazard: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic step from hazard to label, by Newton's method with a weak prior."""
    x = np.stack([np.ones(len(hazard)), np.log1p(hazard)], 1)
    w = np.array([-2.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (toxic - p) - 0.01 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(w[0]), float(max(w[1], 0.0))


def telling_words(labelled: DataFrame, least_z: float = 2.6) -> tuple[set[str], set[str]]:
    """Words and word beginnings that speak for toxic documents.

    Counts run over all given rows.  A word counts once per toxic document, but no
    oftener than it is followed by different words there, so that copies of one
    document add nothing.
    """
    words = labelled.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("ws"))
    sizes = words.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = sizes["t"] or 0, sizes["c"] or 0
    if not toxic or not clean:
        return set(), set()
    spoken = words.where("toxic = 1")
    pairs = spoken.select(F.explode(F.arrays_zip(F.col("ws").alias("w"), F.slice("ws", 2, F.greatest(F.size("ws"), F.lit(1))).alias("next"))).alias("p"))
    contexts = pairs.select(F.col("p.w").alias("w"), F.col("p.next").alias("next")).distinct().groupBy("w").agg(F.count("*").alias("n"))
    each = words.select("toxic", F.explode(F.array_distinct("ws")).alias("w"))
    texts = each.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    said = F.coalesce(F.least("t", "n"), F.lit(0))
    counts = keep(texts.join(contexts, "w", "left").select("w", said.alias("t"), "c", F.col("n").isNotNull().alias("said")), "words")

    def telling(table: DataFrame) -> set[str]:
        odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
        z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
        best = table.withColumn("z", z).where((F.col("z") >= least_z) & (odds >= 2.0) & (F.col("t") >= 4))
        return {r["w"] for r in best.select("w").collect()}

    starts = F.explode(F.filter(F.array(*(F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in PREFIXES)), lambda p: p.isNotNull()))
    several = counts.select(starts.alias("w"), "t", "c", F.col("said").cast("int").alias("kinds"))
    several = several.groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("kinds").alias("kinds")).where("kinds >= 3")
    return telling(counts.where("said")), telling(several)


def _first(tagged: DataFrame, most: int) -> DataFrame:
    """The ``most`` windows with the smallest places, which are crc32 values.

    Places below a cut four times as wide as needed on average are looked at, so
    that what is ordered does not grow with the documents; should too few lie
    there, all are.
    """
    there = tagged.count()
    cut = (1 << 32) * 4 * most // max(there, 1)
    near = tagged.where(F.col("place") < cut)
    if there > 4 * most and near.count() < most:
        near = tagged
    return near.orderBy("place", "words").limit(most)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """``doc_id, text, toxic, fold`` of at most ``most`` labelled documents outside the held-out fold.

    Ids are chosen by hash among the labels, before any text is read; they are so
    few that each task gets them all and texts stay where they are.  An id that
    several documents have counts with the first of their texts.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold("doc_id")).where("fold <> 2")
    chosen = F.broadcast(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.join(chosen, "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", windows: int = 6000, labelled_rows: int = 16000) -> Model:
    """Fit on labelled documents of all folds but the held-out one.

    At most ``labelled_rows`` of them, chosen by hash, teach all there is: telling
    words; the field, on at most ``windows`` windows of 64 words, half of them with
    tagged words, from two folds; the step to the score, on the third.  Without
    both labels the model scores everything low.
    """
    labelled = keep(labelled_texts(docs, labels, id_col, text_col, labelled_rows), "labelled")
    words, starts = telling_words(labelled)
    if not words and not starts:
        return Model.untrained()
    sizes = sorted({len(s) for s in starts})

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, toxic in zip(*(batch[n].to_pylist() for n in ("doc_id", "text", "toxic"))):
                found, rows = tokens(text), []
                for at in range(0, len(found), WINDOW):
                    part = found[at : at + WINDOW]
                    tags = [int(bool(toxic) and (w in words or any(w[:n] in starts for n in sizes))) for w in part]
                    rows.append({"place": zlib.crc32(f"{doc_id}:{at}".encode()), "words": part, "tags": tags})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("place", pa.int64()), ("words", pa.list_(pa.string())), ("tags", pa.list_(pa.int32()))]))

    tagged = keep(labelled.where("fold <> 3").select("doc_id", "text", "toxic").mapInArrow(tag, TAGGED), "tagged")
    has = F.array_max("tags") == 1
    some = [_first(tagged.where(c), windows // 2).select("words", "tags").toArrow().to_pylist() for c in (has, ~has)]
    model = fit_field([(r["words"], r["tags"]) for rows in some for r in rows]) if some[0] else Model.untrained()
    held = labelled.where("fold = 3")
    sample = score(held, model).select("doc_id", "hazard").join(held.select("doc_id", "toxic"), "doc_id").toArrow()
    if len(sample):
        model.bias, model.slope = fit_score(sample["hazard"].to_numpy(), sample["toxic"].to_numpy().astype(float))
    return model


class Scorer:
    """A model as tasks carry it: only weights that are not zero."""

    def __init__(self, model: Model):
        slots = np.flatnonzero(model.weights)
        self.sparse = (slots, model.weights[slots], model.move, model.bias, model.slope)
        self.key = zlib.crc32(model.weights.tobytes() + model.move.tobytes())

    def thaw(self) -> tuple[Model, dict[str, float]]:
        weights = np.zeros(SLOTS)
        weights[self.sparse[0]] = self.sparse[1]
        return Model(weights, *self.sparse[2:]), {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Score and hazard of each text, and the chance of each of its words."""
        field, known = worker_cache(("toxicity", self.key), self.thaw)
        chances = field.hazards([tokens(t or "") for t in texts], known)
        hazard = np.array([-np.log1p(-np.minimum(c, 1 - 1e-12)).sum() for c in chances])
        return Model(np.zeros(0), *self.sparse[2:]).score(hazard), hazard, chances


def spans(text: str, chance: np.ndarray, least: float) -> list[dict]:
    """Runs of adjacent words that are likely toxic, in code points of the text."""
    out: list[dict] = []
    if not (chance >= least).any():
        return out
    before = False
    low = text.lower()
    for match, p in zip(FIND.finditer(text if len(low) != len(text) else low), chance.tolist()):
        if p >= least and before:
            out[-1] |= {"end": match.end(), "probability": max(p, out[-1]["probability"])}
        elif p >= least:
            out.append({"start": match.start(), "end": match.end(), "probability": p})
        before = p >= least
    return out


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Score, hazard and offending spans of each document: one row per row.

    A span runs over adjacent words with a probability of at least ``least``;
    offsets count code points of the text.  The hazard is the expected number of
    toxic words on a log scale that never saturates.  Null and empty texts have
    hazard 0 and the lowest score.  Other columns are left out.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scorer = Scorer(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = part["text"].to_pylist()
                scores, hazard, chances = scorer(texts)
                found = [spans(t or "", c, least) for t, c in zip(texts, chances)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores), pa.array(hazard), pa.array(found, span)], names=["doc_id", "score", "hazard", "spans"])

    return plain.mapInArrow(run, SCORED)


def below(docs: DataFrame, model: Model, threshold: float, *, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    scorer = Scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                yield part.filter(pa.array(scorer(part[text_col].to_pylist())[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def judged(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """Train on the labelled part of the documents and score them all."""
    out = score(docs, train(docs, labels))
    held = F.coalesce(fold("doc_id") == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
