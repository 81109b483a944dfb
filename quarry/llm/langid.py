"""Language identification in two steps: the language family, then the language within the family.

A text's features are hashed counts of its byte pairs and triples in lower case, square-rooted and of length one, over the
whole text. One linear support vector machine for each pair of families votes for the family; inside it, one for each
pair of its languages (one versus one) votes for the language. Every language is learned, from a bounded number of documents;
machines are fitted in numpy in tasks, those of a family or of two blocks of families together. Prediction is one
matrix product per group of texts in the tasks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import table, utf8

FEATURES = 2048
#: At most so many documents of each language are used for fitting, those with the smallest hash of their id.
PER_LANGUAGE = 1200
#: At most so many documents in all: where there are many languages each has fewer, but every one has some.
SAMPLE = 24_000
#: Codes without a named family that are families of their own; more than so many are dealt to about as many families as
#: each then has languages, in order of their codes, so that machines don't grow with the square of the languages.
OWN_FAMILIES = 32
#: Families in a block; a task fits the machines of two blocks.
BLOCK = 16
#: Families of common language codes; for a code that isn't named here see above.
FAMILIES = {
    "romance": "fr es it pt ro ca gl oc",
    "germanic": "de en nl sv da no nb nn is af lb",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "semitic": "ar he am mt",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "dravidian": "ta te kn ml",
    "sino-tibetan": "zh my bo",
}
FAMILY = "family:"
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def families_of(langs: list[str]) -> dict[str, str]:
    """The family of each language."""
    own = sorted(lang for lang in set(langs) if family(lang) == lang)
    size = math.isqrt(len(own)) + 1
    dealt = {lang: f"other {i // size}" for i, lang in enumerate(own)} if len(own) > OWN_FAMILIES else {}
    return {lang: dealt.get(lang, family(lang)) for lang in langs}


def features(raw: bytes) -> np.ndarray:
    low = _LOWER[np.frombuffer(b" " + raw + b" ", dtype=np.uint8)].astype(np.uint32)
    pairs = low[:-1] * np.uint32(2654435761) ^ low[1:] * np.uint32(2246822519)
    triples = pairs[:-1] ^ (low[2:] + np.uint32(1)) * np.uint32(3266489917)
    counts = np.zeros(FEATURES, dtype=np.int64)
    for codes in (pairs, triples):
        codes = (codes ^ (codes >> np.uint32(15))) * np.uint32(2246822519)
        counts += np.bincount(codes >> np.uint32(21), minlength=FEATURES)
    out = np.sqrt(counts, dtype=np.float32)
    return out / max(np.linalg.norm(out), 1e-9)


def fit_machine(x: np.ndarray, y: np.ndarray, epochs: int = 12, penalty: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Weights (the last one is the bias) of a linear support vector machine for ``y`` of -1 and 1.

    Averaged stochastic subgradient steps on the squared hinge loss over small batches; both kinds weigh the same.
    """
    rng = np.random.default_rng(seed)
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 32):
            rows = order[i : i + 32]
            slack = np.maximum(0, 1 - y[rows] * (x[rows] @ w)) * weight[rows]
            t += 1
            w += 2.0 / (1 + 0.002 * t) * ((slack * y[rows]) @ x[rows] / len(rows) - penalty * w)
            mean += (w - mean) / t
    return mean


@dataclass
class LanguageModel:
    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, FEATURES + 1), dtype=np.float32))

    @classmethod
    def of(cls, langs: list[str]) -> LanguageModel:
        """The families and languages, without machines yet."""
        members: dict[str, list[str]] = defaultdict(list)
        for lang, name in sorted(families_of(langs).items()):
            members[name].append(lang)
        return cls(sorted(members), dict(members))

    def jobs(self) -> list[list[tuple[str, str]]]:
        """The pairs that need a machine, in groups that share rows."""
        blocks = [[FAMILY + f for f in self.families[i : i + BLOCK]] for i in range(0, len(self.families), BLOCK)]
        out = [list(combinations(names, 2)) for names in (*blocks, *(self.members[f] for f in self.families))]
        out += [list(product(a, b)) for a, b in combinations(blocks, 2)]
        return [pairs for pairs in out if pairs]

    def _vote(self, names: list[str], prefix: str, margins: dict) -> tuple[str, float]:
        """The name with the most votes and the mean confidence of its machines; ties go to the larger sum of margins."""
        votes = {n: [0, 0.0] for n in names}
        for a, b in combinations(names, 2):
            m = margins[prefix + a, prefix + b]
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = max(names, key=lambda n: (*votes[n], n))
        against = [margins.get((prefix + best, prefix + n), -margins.get((prefix + n, prefix + best), 0)) for n in names if n != best]
        sure = [1 / (1 + np.exp(-np.clip(2 * m, -50, 50))) for m in against]
        return best, float(np.mean(sure)) if sure else 1.0

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        out = []
        for row in margins:
            by_pair = dict(zip(self.pairs, row.tolist()))
            chosen, sure = self._vote(self.families, FAMILY, by_pair)
            lang, inside = self._vote(self.members[chosen], "", by_pair)
            out.append((lang, min(1.0, max(0.0, sure * inside))))
        return out

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id, lang_pred, score`` of every row; ``und`` and 0 for a null text or one without a letter."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    texts = part.column(1).to_pylist()
                    known = [i for i, t in enumerate(texts) if any(map(str.isalpha, t.decode("utf-8", "replace")))]
                    got: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
                    if known and model.families:
                        for i, answer in zip(known, model.predict(np.stack([features(texts[i]) for i in known]))):
                            got[i] = answer
                    columns = [part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

        rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("raw"))
        return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on ``docs`` with non-null ``lang``; texts that are null or empty teach nothing.

    Of a language's ids those with a small hash are taken, in each partition before anything moves, so that few are ranked
    however many rows a language has; of rows that repeat an id, one. Features go to the tasks that fit a group of machines; the driver has the machines only.
    Without any labelled row the model knows no language and answers ``und``.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & (F.length(text) > 0))
    counted = labelled.groupBy(F.col(lang).alias("lang")).agg(F.approx_count_distinct(F.col(key).cast("long"), 0.02).alias("n")).collect()
    langs = sorted(r.lang for r in counted)
    model = LanguageModel.of(langs)
    jobs, family_of = model.jobs(), families_of(langs)
    if not jobs:
        return model
    per_language = max(1, min(per_language, SAMPLE // len(langs)))
    # A hash below the language's share leaves about twice the ids that are wanted, whatever their number, to be ranked.
    most = {r.lang: int((1 << 63) * min(1.0, (2 * per_language + 20) / max(1.0, 0.9 * r.n))) for r in counted}
    limits = docs.sparkSession.createDataFrame([(name, cut - 1) for name, cut in most.items()], "lang string, most long")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    ids = labelled.select(F.col(lang).alias("lang"), F.col(key).cast("long").alias("id"), F.xxhash64(F.col(key).cast("long")).bitwiseAND((1 << 63) - 1).alias("h"))
    ids = ids.join(F.broadcast(limits), "lang").filter(F.col("h") <= F.col("most")).drop("most").distinct()
    chosen = ids.withColumn("nth", nth).filter(F.col("nth") <= per_language).select("lang", "id")
    needed = defaultdict(list)
    for job, pairs in enumerate(jobs):
        for name in sorted({n for pair in pairs for n in pair}):
            needed[name].append(job)
    jobs_of = {name: needed[name] + needed[FAMILY + family_of[name]] for name in langs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                wanted = [(i, job) for i, name in enumerate(part.column(0).to_pylist()) for job in jobs_of[name]]
                x = pa.array([features(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())
                rows = pa.array([i for i, _ in wanted], pa.int64())
                columns = [pa.array([job for _, job in wanted], pa.int32()), part.column(0).take(rows), part.column(2).take(rows), x.take(rows)]
                yield pa.RecordBatch.from_arrays(columns, ["job", "lang", "id", "x"])

    def fit_job(found: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found, sort_keys=[("id", "ascending"), ("x", "ascending")]))
        x = np.frombuffer(b"".join(found.column("x").to_pylist()), dtype=np.float32).reshape(-1, FEATURES)
        names, pairs = found.column("lang").to_pylist(), jobs[found.column("job")[0].as_py()]
        level = np.array([FAMILY + family_of[n] for n in names] if pairs[0][0].startswith(FAMILY) else names)
        machines = []
        for a, b in pairs:
            used = (level == a) | (level == b)
            machines.append(fit_machine(x[used], np.where(level[used] == a, 1.0, -1.0)).astype(np.float32).tobytes())
        return pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "w": pa.array(machines, pa.binary())})

    rows = labelled.select(F.col(lang).alias("lang"), utf8(text).alias("raw"), F.col(key).cast("long").alias("id"))
    rows = rows.join(F.broadcast(chosen), ["lang", "id"], "left_semi").select("lang", "raw", "id")
    # One row of each id: however often one is repeated, a machine is fitted to as many rows as were chosen.
    nth = F.row_number().over(Window.partitionBy("lang", "id").orderBy(F.xxhash64("raw"), "raw"))
    rows = rows.withColumn("nth", nth).filter("nth = 1").drop("nth")
    shares = rows.mapInArrow(run, "job int, lang string, id long, x binary")
    fitted = shares.groupBy("job").applyInArrow(fit_job, "a string, b string, w binary").toArrow()
    model.pairs = list(zip(fitted.column("a").to_pylist(), fitted.column("b").to_pylist()))
    model.weights = np.frombuffer(b"".join(fitted.column("w").to_pylist()), dtype=np.float32).reshape(-1, FEATURES + 1)
    return model


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(documents.filter(~out))
    return model.score(documents).select("doc_id", out.alias("held_out"), "lang_pred", "score")
