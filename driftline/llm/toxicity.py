"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import crc32_fold
from driftline.llm.linear import fit_logistic, sigmoid

#: Labelled documents that voters and models are fitted to, at most, and words the classifier may know.
SAMPLE, VOCABULARY = 5000, 4000
#: Seed lexicons (fixed values).
LEXICONS = {
    "insult": "idiot idiots moron morons stupid dumb fool fools imbecile loser losers clown clowns jerk dork cretin".split(),
    "contempt": "worthless pathetic disgusting useless ugly filthy revolting hopeless ridiculous".split(),
    "dehumanising": "scum trash garbage vermin filth pig pigs rat rats parasite parasites cockroach cockroaches subhuman".split(),
    "profane": "fuck fucking fucker shit shitty bullshit bitch bastard asshole dick cunt crap damn whore slut".split(),
    "threat": "kill murder die hang shoot stab destroy burn hurt choke".split(),
    "spanish": "idiota imbécil estúpido estúpida basura asqueroso asquerosa mierda puta gilipollas cabrón inútil escoria patético".split(),
    "french": "idiote imbécile stupide connard connasse ordure merde salope putain débile nul pathétique dégoûtant racaille".split(),
    "german": "idiotin dumm dummkopf arschloch abschaum scheiße hurensohn schlampe trottel versager widerlich wertlos müll".split(),
}
SECOND_PERSON = frozenset("you your you're youre ur u tu te ti tú usted vous toi du dich dir sie".split())
WANTS = frozenset("should must deserve deserves hope wish will gonna".split())
TOKEN = re.compile(r"\w+")
#: Learned lexicons: groups of words whose share of toxic documents is far above their share of others.
#: Besides whole words, their first STEM letters (marked by a star) can be in them, so that forms never seen count too.
GROUPS, MIN_DOCS, MIN_LIFT, STEM = 6, 4, 12.0, 5
ABSTAIN = -1


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


@dataclass
class Voters:
    """Lexicon and pattern voters; each says 1 (toxic), 0 or abstains."""

    learned: list[frozenset] = field(default_factory=list)

    def __post_init__(self):
        self.groups: dict[str, list[int]] = {}
        lexicons = [*map(frozenset, LEXICONS.values()), *self.learned]
        for i, lexicon in enumerate(lexicons):
            for word in lexicon:
                self.groups.setdefault(word, []).append(i)
        self.lexicons = len(lexicons)
        self.stems = frozenset(w[:-1] for w in self.groups if w.endswith("*"))
        self.strong = frozenset().union(*(frozenset(LEXICONS[k]) for k in LEXICONS if k != "threat"), *self.learned)

    #: After the lexicons: several strong words, many for the length, addressed to someone, a wish to harm, shouted, none at all.
    PATTERNS = 6

    @property
    def count(self) -> int:
        return self.lexicons + self.PATTERNS

    def vote(self, words: list[str], text: str) -> tuple[np.ndarray, np.ndarray]:
        """Votes, and the number of hits behind each."""
        hits = np.zeros(self.count)
        places, strong = [], []
        groups, stems, present = self.groups, self.stems, set(words)
        known = {}
        for word in present:
            found = groups.get(word, [])
            if word[:STEM] in stems and len(word) > STEM:
                found = [*found, *groups[word[:STEM] + "*"]]
            if found:
                known[word] = found
        if known:
            for at, word in enumerate(words):
                if word in known:
                    for i in known[word]:
                        hits[i] += 1
                    places.append(at)
                    if word in self.strong or word[:STEM] in stems:
                        strong.append(at)
        votes = np.full(self.count, ABSTAIN, np.int8)
        votes[: self.lexicons][hits[: self.lexicons] > 0] = 1
        p = self.lexicons
        near = lambda at, wanted, reach: any(w in wanted for w in words[max(0, at - reach) : at + reach + 1])
        hits[p] = max(0, len(strong) - 1)
        hits[p + 1] = 100 * len(strong) / len(words) if words and len(strong) / len(words) > 0.01 else 0
        hits[p + 2] = sum(near(at, SECOND_PERSON, 3) for at in strong)
        hits[p + 3] = sum(near(at, SECOND_PERSON, 4) and near(at, WANTS, 4) for at in places if words[at] in LEXICONS["threat"])
        hits[p + 4] = sum(1 for word in {words[at] for at in strong} if word.upper() + "!" in text)
        for i in range(5):
            if hits[p + i] > 0:
                votes[p + i] = 1
        if not strong:
            hits[p + 5], votes[p + 5] = 1, 0
        return votes, hits


def learned_lexicons(words: list[set[str]], toxic: np.ndarray) -> list[frozenset]:
    """Words that mark toxic documents, in GROUPS groups of like strength."""
    bad, all_docs = Counter(), Counter()
    least = max(MIN_DOCS, round(toxic.sum() / 100))
    for found, y in zip(words, toxic, strict=True):
        found = found | {w[:STEM] + "*" for w in found if len(w) > STEM}
        all_docs.update(found)
        if y:
            bad.update(found)
    p, n = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    lift = {w: ((k + 0.1) / p) / ((all_docs[w] - k + 0.1 * n / p) / n) for w, k in bad.items() if k >= least}
    strong = sorted((w for w, x in lift.items() if x >= MIN_LIFT and bad[w] >= 0.6 * all_docs[w]), key=lambda w: (-lift[w] * math.log(bad[w]), w))
    return [frozenset(part) for part in np.array_split(np.array(strong, object), GROUPS) if len(part)]


class LabelModel:
    """A latent label behind the votes: accuracies and correlations by expectation-maximisation.

    Nothing but the votes and the share of toxic documents (`balance`) is known to it. The first
    guess is the majority of a document's votes, where voters that fire together share one vote.
    Each voter has a rate of each vote under each label, learned from how it agrees with the
    others; a voter is taken to be no worse than chance. Voters that agree beyond what the label explains would be counted twice, so in each round pairwise
    correlations of the votes given the label are estimated and a voter's evidence is divided by
    one plus the sum of its positive ones.
    """

    def __init__(self, votes: np.ndarray, balance: float, rounds: int = 25):
        self.prior = float(np.clip(balance, 1e-3, 1 - 1e-3))
        shown = np.stack([votes == v for v in (ABSTAIN, 0, 1)], axis=2).astype(float)  # documents, voters, votes
        fired = shown[:, :, 2]
        centred = fired - fired.mean(0)
        spread = np.sqrt((centred**2).mean(0)) + 1e-9
        together = centred.T @ centred / len(votes) / np.outer(spread, spread)
        np.fill_diagonal(together, 0)
        weight = 1 / (1 + (np.clip(together, 0, 1) ** 2).sum(1))
        yes, no = fired @ weight, shown[:, :, 1] @ weight
        self.posterior = np.where(yes + no > 0, 0.05 + 0.9 * (yes > no), self.prior)
        for _ in range(rounds):
            p = np.stack([1 - self.posterior, self.posterior])
            self.rates = np.stack([(np.einsum("d,dvk->vk", w, shown) + 0.5) / (w.sum() + 1.5) for w in p])
            expected = sum(w[:, None] * self.rates[y][None, :, 2] for y, w in enumerate(p))
            rest = fired - expected
            scale = np.sqrt((rest**2).mean(0)) + 1e-3
            correlation = (rest.T @ rest) / len(votes) / np.outer(scale, scale)
            np.fill_diagonal(correlation, 0)
            self.shares = 1 / (1 + np.clip(correlation, 0, 1).sum(1))
            self.accuracies = self.rates[1, :, 2] / (self.rates[1, :, 2] + self.rates[0, :, 2])
            evidence = np.log(self.rates[1] / self.rates[0])
            # a vote never speaks for the other label, and an abstention never for label 1
            evidence = np.stack([np.minimum(evidence[:, 0], 0), np.minimum(evidence[:, 1], 0), np.maximum(evidence[:, 2], 0)], 1)
            odds = math.log(self.prior / (1 - self.prior)) + np.einsum("dvk,vk->d", shown, evidence * self.shares[:, None])
            self.posterior = sigmoid(odds)


class Scorer:
    """A linear classifier over voters' hits and word frequencies, fitted to the label model's posteriors.

    `toxic` has the labels of the first texts; they choose the words of the learned lexicons and give the
    share of toxic documents. The label model and the classifier see the votes of all texts and no label.
    """

    def __init__(self, texts: list[str | None], toxic: np.ndarray, vocabulary: int = VOCABULARY):
        read = [tokens(t) for t in texts]
        sets = [set(w) for w in read]
        self.voters = Voters(learned_lexicons(sets[: len(toxic)], toxic))
        df = Counter(w for s in sets for w in s)
        self.index = {w: i for i, w in enumerate(w for w, n in sorted(df.most_common(vocabulary)) if n >= 5)}
        votes, rows = zip(*(self.describe(w, t or "") for w, t in zip(read, texts, strict=True)), strict=True)
        self.model = LabelModel(np.stack(votes), float(toxic.mean()))
        x = np.zeros((len(rows), self.voters.count + len(self.index) + 1), np.float32)
        x[:, -1] = 1
        for i, (dense, at, value) in enumerate(rows):
            x[i, : len(dense)] = dense
            x[i, at] = value
        p = self.model.posterior.astype(np.float32)
        self.weights = fit_logistic(x, p)

    def describe(self, words: list[str], text: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        votes, hits = self.voters.vote(words, text)
        dense = np.concatenate([np.minimum(hits, 1) + 0.3 * np.log1p(hits)])
        index = self.index
        found = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        at, times = np.unique(found[found >= 0], return_counts=True)
        value = np.sqrt(times)
        if len(value):
            value = 0.3 * value / np.linalg.norm(value)
        return votes, (dense, at + self.voters.count, value)

    def score(self, text: str | None) -> float:
        words = tokens(text)
        _, (dense, at, value) = self.describe(words, text or "")
        w = self.weights
        return float(sigmoid(dense @ w[: len(dense)] + value @ w[at] + w[-1]))


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> pd.DataFrame:
    """At most `sample` labelled ids outside the held-out fold, those with the smallest seeded hashes, with one text each (the least, if an id repeats)."""
    place = F.xxhash64(F.lit("toxicity sample"), F.col("id").cast("string"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (crc32_fold(F.col("id")) != 0))
    chosen = known.groupBy("id").agg(F.max("toxic").alias("toxic")).select("*", place.alias("place")).orderBy("place").limit(sample)
    # `chosen` has `sample` rows of three numbers at most
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(chosen), "id")
    return texts.groupBy("id", "toxic", "place").agg(F.min("body").alias("body")).toPandas().sort_values("place")


def unlabelled_sample(df: DataFrame, id_col: str, text_col: str, sample: int) -> list[str | None]:
    """At most `sample` texts outside the held-out fold, those with the smallest seeded hashes of their ids; their labels, if any, are not read."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where(crc32_fold(F.col("id")) != 0)
    place = F.xxhash64(F.lit("toxicity texts"), F.col("id").cast("string"), F.col("body"))
    return [r["body"] for r in rows.select(place.alias("place"), "body").orderBy("place").limit(sample).collect()]


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Scorer | None:
    got = labelled_sample(df, labels, id_col, text_col, label_col, sample)
    if got.empty:
        return None
    texts = [t if isinstance(t, str) else None for t in got["body"]]
    return Scorer(texts + unlabelled_sample(df, id_col, text_col, max(1, sample // 5)), got["toxic"].to_numpy(float))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Voters are seed lexicons, lexicons of words that mark the toxic ones in a sample of labelled documents
    outside the held-out fold, and patterns. A generative label model learns their accuracies
    and correlations from how their votes agree over that sample and further texts, without any
    label, and a linear classifier on its posteriors scores each whole text from nothing but itself. Null and empty texts get the score of a text without words; without any labelled
    document every score is 0. Rows that repeat are scored alike; no rows give no rows; other
    columns are ignored. Scoring has no shuffle; the sample's ids, bounded by `sample`, are broadcast.
    """
    scorer = fit(df, labels, id_col, text_col, label_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [scorer.score(text) if scorer else 0.0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), (crc32_fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
