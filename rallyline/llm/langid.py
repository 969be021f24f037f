"""Language identification by hierarchical discrimination: the family first, then the languages within it.

Features are a text's hashed character trigrams.  One-versus-one linear support vector machines vote for the family;
others, one for each pair of languages of that family, tell the close languages apart.  Families are a fixed table, and
a language outside it is a family of its own.

The machines are fitted on a bounded sample: about `per_language` documents of each language (a documented parameter),
taken by a hash of the id, each pair by a task of its own.  Counting and predicting cover every document.

Defined results: `und` with score 0 for null text or text without a letter; a null lang teaches nothing; with one known
language it is predicted for every text with letters, with none `und`; rows that repeat a doc_id are predicted each; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import ROW, durable, numbered, settled

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
#: Hashed features; documents of a language that the machines are fitted on, about.
DIM, PER_LANGUAGE = 2048, 800


def has_letter(text: str) -> bool:
    """Whether a character of the categories L is in the text."""
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed trigrams, a vector of length one."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    with np.errstate(over="ignore"):
        mixed = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA6B)) ^ (points[2:] * np.uint32(0xC2B2AE35))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = np.bincount((mixed >> np.uint32(21)).astype(np.int64), minlength=DIM)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> np.ndarray:
    """A linear support vector machine (squared hinge, classes weighed alike) by accelerated gradient steps; last: bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = v = np.zeros(x.shape[1])
    step = 1 / (2 * 2.0 + ridge)  # rows have a squared length of two
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (ridge * v - 2 * x.T @ (weight * slack * y))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Level:
    """One-versus-one machines among the names; pairs holds (i, j), and a positive margin is a vote for i."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The name with most votes (margins decide ties), and a score from its least margin."""
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        soft = 1 / (1 + np.exp(-4 * margins))
        votes = np.zeros((len(x), len(self.names)))
        least = np.ones((len(x), len(self.names)))
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += (margins[:, k] > 0) + 1e-3 * soft[:, k]
            votes[:, j] += (margins[:, k] <= 0) + 1e-3 * (1 - soft[:, k])
            least[:, i] = np.minimum(least[:, i], soft[:, k])
            least[:, j] = np.minimum(least[:, j], 1 - soft[:, k])
        best = votes.argmax(1)
        return best, least[np.arange(len(x)), best]


@dataclass
class Hierarchy:
    families: Level
    languages: dict[str, Level]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        best, score = self.families.predict(x)
        names, score = [""] * len(x), score.copy()
        for k in np.unique(best):
            rows = np.flatnonzero(best == k)
            level = self.languages[self.families.names[k]]
            inner, sure = level.predict(x[rows])
            score[rows] *= sure
            for r, i in zip(rows, inner, strict=True):
                names[r] = level.names[i]
        return names, score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Hierarchy | None:
    rows = numbered(settled(docs)).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return None
    shares = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n))])
    # by row: rows without an id, or equal ones, must not be drawn together
    drawn = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "text", F.col(ROW)["at"]), F.lit(1_000_000)) < F.element_at(shares, F.col("lang")) * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            made = [features(texts[i]).astype(np.float16).tobytes() for i in keep]
            langs = [batch.column(0)[i].as_py() for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(made, pa.binary())], ["lang", "x"])

    sample = durable(rows.where(drawn).select("lang", "text").mapInArrow(run, "lang string, x binary"))
    return trained(sample, [r["lang"] for r in sample.select("lang").distinct().collect()])


def trained(sample: DataFrame, langs: list[str]) -> Hierarchy | None:
    """The machines, from rows (lang, x): each pair of families, and of languages in a family, is fitted by a task of its own.

    Only the machines come to the driver, 8 KB for each pair.
    """
    if not langs:
        return None
    family = {lang: FAMILY.get(lang, lang) for lang in langs}
    members = {f: sorted(lang for lang in langs if family[lang] == f) for f in sorted(set(family.values()))}
    levels = {None: list(members)} | members
    pairs = [(level, i, j) for level, names in levels.items() for i, j in combinations(range(len(names)), 2)]
    sides = [
        (lang, n, 1.0 if name == levels[level][i] else -1.0)
        for n, (level, i, j) in enumerate(pairs)
        for lang in langs
        for name in (family[lang] if level is None else lang,)
        if name in (levels[level][i], levels[level][j])
    ]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])  # the same machine, whatever order the rows come in
        x = np.stack([np.frombuffer(b, np.float16) for b in rows["x"]]).astype(np.float32)
        return pd.DataFrame({"pair": [rows["pair"].iloc[0]], "w": [machine(x, rows["y"].to_numpy()).tobytes()]})

    made = {}
    if pairs:
        sided = sample.sparkSession.createDataFrame(sides, "side string, pair int, y double")
        dealt = sample.join(F.broadcast(sided), F.col("lang") == F.col("side")).select("pair", "y", "x")
        made = {r["pair"]: np.frombuffer(r["w"]) for r in dealt.groupBy("pair").applyInPandas(one, "pair int, w binary").collect()}

    def level(at: str | None) -> Level:
        own = [(n, i, j) for n, (of, i, j) in enumerate(pairs) if of == at]
        return Level(levels[at], [(i, j) for _, i, j in own], np.array([made[n] for n, *_ in own]).reshape(len(own), DIM + 1))

    return Hierarchy(level(None), {f: level(f) for f in members})


def predicted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [t.as_py() for t in part.column(2)]
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
                keep = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
                if keep:
                    found, sure = model.predict(np.stack([features(texts[i]) for i in keep]))
                    for i, name, s in zip(keep, found, sure, strict=True):
                        names[i], scores[i] = name, float(s)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"]
                )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
