"""Language identification: family first, then pairwise support vector machines within it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from driftline.llm.common import crc32_fold
from driftline.llm.linear import fit_svm, sigmoid

UNKNOWN = "und"
#: Documents a language may have in the sample that the machines are fitted to.
SAMPLE_PER_LANGUAGE = 600
#: Languages that are learned, those with most labelled documents, and documents of all of them in the sample.
MOST_LANGUAGES, SAMPLE = 100, 20_000
DIMENSIONS = 4096
#: Languages close to each other (fixed values); one that is not listed is a family by itself.
FAMILIES = {
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indo-aryan": ["hi", "mr", "ne", "bn", "gu", "pa", "ur"],
    "austronesian": ["id", "ms", "jv", "tl"],
}


def family(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), f"only {language}")


@cache
def letter_table() -> np.ndarray:
    """Code point -> code point of its lower case if it is a letter, else that of a space."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


def features(text: str) -> np.ndarray | None:
    """Hashed frequencies of one to three characters in a row, of length 1; letters in lower case, all else a space. None without letters."""
    points = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    inside = points != 32
    if not inside.any():
        return None
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # of several spaces one
    c = np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint32)
    one = c * np.uint32(2654435761)
    two = one[:-1] ^ (c[1:] * np.uint32(2246822519))
    three = two[:-1] * np.uint32(3266489917) + c[2:] * np.uint32(668265263)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    counts = sum(np.bincount((h * np.uint32(374761393)) >> shift, minlength=DIMENSIONS) for h in (one, two, three))
    v = np.sqrt(counts).astype(np.float32)
    return v / np.linalg.norm(v)


class PairVotes:
    """One-versus-one machines over a few classes."""

    def __init__(self, names: list[str], x: np.ndarray, labels: np.ndarray):
        self.names = names
        self.pairs = list(combinations(range(len(names)), 2))
        fitted = []
        for a, b in self.pairs:
            rows = np.isin(labels, [names[a], names[b]])
            fitted.append(fit_svm(x[rows], np.where(labels[rows] == names[a], 1.0, -1.0).astype(np.float32)))
        self.weights = np.array(fitted, np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def choose(self, v: np.ndarray) -> tuple[str, float]:
        """The class with most votes, ties by the sum of margins, and its confidence: its weakest pair's margin through a logistic curve."""
        if not self.pairs:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ v + self.weights[:, -1]
        votes, sums, least = np.zeros(len(self.names)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for (a, b), m in zip(self.pairs, margins, strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(range(len(self.names)), key=lambda i: (votes[i], sums[i]))
        return self.names[best], float(sigmoid(4 * least[best]))


class Hierarchy:
    """Family by one-versus-one machines over families, then language by those of the family."""

    def __init__(self, x: np.ndarray, languages: np.ndarray):
        families = np.array([family(x) for x in languages])
        self.families = PairVotes(sorted(set(families)), x, families)
        self.within = {f: PairVotes(sorted(set(languages[families == f])), x[families == f], languages[families == f]) for f in self.families.names}

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text) if text else None
        if v is None:
            return UNKNOWN, 0.0
        chosen, sure = self.families.choose(v)
        language, within = self.within[chosen].choose(v)
        return language, min(sure, within)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Hierarchy | None:
    """Machines fitted to labelled documents outside the held-out fold: of each of the MOST_LANGUAGES most frequent languages at most `per_language`, and SAMPLE in all, those with the smallest seeded hash."""
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (crc32_fold(F.col("id")) != 0) & F.col("body").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return None
    per_language = min(per_language, SAMPLE // len(counts))
    place = F.xxhash64(F.lit("language sample"), F.col("id").cast("string"), F.col("body"))
    shares = {lang: min(1.0, (1.3 * per_language + 20) / n) for lang, n in counts.items()}
    bounds = F.create_map(*[F.lit(x) for lang, share in shares.items() for x in (lang, min(2**63 - 1, int(-(2**63) + share * (2**64 - 1))))])
    within = place <= bounds[F.col("lang")]  # null, so left out, for other languages

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text.as_py()) for text in batch.column(2)]  # one text at a time, as whole batches of them weigh much
            raw = pa.array([None if v is None else v.astype(np.float16).tobytes() for v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], names=["place", "lang", "v"])

    sample = labelled.where(within).select(place.alias("place"), "lang", "body").mapInArrow(vectors, "place long, lang string, v binary")
    got = sample.where("v IS NOT NULL").toPandas().sort_values(["lang", "place"]).groupby("lang").head(per_language)
    if got.empty:
        return None
    x = np.stack([np.frombuffer(v, np.float16) for v in got["v"]]).astype(np.float32)
    return Hierarchy(x, got["lang"].to_numpy(str))


def identify(df: DataFrame, model: Hierarchy | None, text_col: str = "text") -> DataFrame:
    """`df` (whose columns are kept, but for any of these two names) with lang_pred and score of each whole text.

    The prediction reads nothing but the text. Null, empty and letterless texts are `und` with
    score 0, as is everything if there was nothing to learn from. Rows that repeat are judged
    alike; no rows give no rows. No shuffle; the machines (a few dozen kB) go with the tasks.
    """
    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text) if model else (UNKNOWN, 0.0) for text in (t.as_py() for t in batch.column(text_at))]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "lang_pred", "score"])

    rows = df.select(*names)
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, learned from `df` itself (see fit and identify)."""
    model = fit(df, id_col, text_col, lang_col, per_language)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return identify(rows, model).select(F.col("id").alias(id_col), (crc32_fold(F.col("id")) == 0).alias("held_out"), "lang_pred", "score")
