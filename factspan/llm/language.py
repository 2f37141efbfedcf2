"""Language of whole texts, family first and then the languages within the family.

A text is its letters, lowered, with every other run as one gap; its features are hashed
1- to 3-grams of that, square-rooted and scaled to length 1. Linear support vector machines
(squared hinge) tell each family from the rest, and one machine for every two languages of a
family votes between them. The machines are fitted in tasks, one each, on a bounded sample:
at most ``per_language`` documents of a language (documented limit; all rows are predicted).

The machines only tell the learned languages apart. Whether a text is in any of them is told by its
evidence: the mean logarithm of its features' shares in the language where it is largest. Either half
of the sample is judged by the other; what lies below the median by more than three times the way to
the lowest hundredth is in no known language. Of fewer than ``FEW`` documents no limit can be learned.

Defined cases: a null text, or one without letters, is ``und`` with score 0; so is every text
when nothing could be learned. Of a language alone in its family the family decides. Equal votes
go to the larger sum of margins, then to the name that sorts first. Rows without a label, or
with a null text or id, teach nothing; null ids are predicted like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.llm.shared import batches, bounded_sample
from factspan.session import stage

UNDETERMINED = "und"
DIMENSIONS = 1 << 14
PER_LANGUAGE = 500
LEAST = 0.2
FEW = 20

# Languages by family. A language not named here is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}

_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(indices, values) of a text's unit vector; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of a run of other characters the first stays, as the gap
    chars = np.where(letter, points, 0)[kept].astype(np.uint64)
    chars = np.concatenate([np.zeros(1, np.uint64), chars, np.zeros(1, np.uint64)])
    counts = np.zeros(DIMENSIONS, np.int64)
    rolled = np.zeros(len(chars), np.uint64)
    for n in (1, 2, 3):
        rolled = rolled[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :] + np.uint64(n)
        spread = (rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        counts += np.bincount(spread.view(np.int64), minlength=DIMENSIONS)
    where = np.flatnonzero(counts)
    values = np.sqrt(counts[where]).astype(np.float32)
    return where.astype(np.int32), values / np.float32(np.sqrt(float((values**2).sum())))


def fit_machine(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights and, last, the bias of a linear machine; classes weigh the same."""
    at = np.concatenate(rows)
    x = np.concatenate(values).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    penalty, step = 1e-4, 1 / 4.0002
    w, ahead, momentum = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), 1.0
    for _ in range(rounds):
        margin = np.bincount(row, x * ahead[at], len(rows)) + ahead[-1]
        pull = -2 * share * sign * np.maximum(0, 1 - sign * margin)
        grad = np.append(np.bincount(at, x * pull[row], DIMENSIONS), pull.sum())
        grad[:-1] += penalty * ahead[:-1]
        new = ahead - step * grad
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / faster * (new - w), new, faster
    return w


def profile(rows: list[np.ndarray], values: list[np.ndarray], langs: list[str]) -> np.ndarray:
    """Logarithms of every feature's share, a column per language."""
    out = []
    for lang in sorted(set(langs)):
        own = [i for i, x in enumerate(langs) if x == lang]
        sums = np.bincount(
            np.concatenate([rows[i] for i in own]),
            np.concatenate([values[i] for i in own]).astype(np.float64) ** 2, DIMENSIONS,
        )
        out.append(np.log((sums / len(own) + 0.05 / DIMENSIONS) / 1.05))
    return np.stack(out, axis=1).astype(np.float32)


def evidence(profiles: np.ndarray, where: np.ndarray, values: np.ndarray) -> float:
    return float((values**2 @ profiles[where]).max())


def least_evidence(rows: list[np.ndarray], values: list[np.ndarray], langs: list[str]) -> float:
    """The evidence below which a text is in none of the languages; equal texts are in the same half."""
    half = np.array([int(r.sum()) % 2 for r in rows])
    if len(rows) < FEW or not 0 < half.sum() < len(rows):
        return -np.inf
    found: list[float] = []
    for other in (0, 1):
        learn = np.flatnonzero(half == other).tolist()
        profiles = profile([rows[i] for i in learn], [values[i] for i in learn], [langs[i] for i in learn])
        found += [evidence(profiles, rows[i], values[i]) for i in np.flatnonzero(half != other).tolist()]
    low, middle = np.quantile(found, [0.01, 0.5])
    return float(middle - 3 * (middle - low))


def _squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))


@dataclass(frozen=True)
class Model:
    """Machines in order: one per family where there are several, then one per pair in a family.

    Its size is bounded by the languages, 64 KB a machine.
    """

    families: tuple[tuple[str, tuple[str, ...]], ...]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    profiles: np.ndarray | None = None
    limit: float = -np.inf

    def known(self, text: str | None, least: float) -> bool:
        """Whether a text is in one of the languages, with a score of at least ``least``."""
        found = features(text) if self.families else None
        if found is None or (self.profiles is not None and evidence(self.profiles, *found) < self.limit):
            return False
        return self._told(found)[1] >= least

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text) if self.families else None
        return (UNDETERMINED, 0.0) if found is None else self._told(found)

    def _told(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[str, float]:
        where, values = found
        margins = values @ self.weights[where] + self.weights[-1]
        name, sure, first = 0, 1.0, 0
        if len(self.families) > 1:
            first = len(self.families)
            odds = _squash(margins[:first])
            name = int(np.argmax(margins[:first]))
            sure = float(odds[name] / odds.sum())
        languages = self.families[name][1]
        votes, sums, shares = (dict.fromkeys(languages, 0.0) for _ in range(3))
        for (a, b), margin in zip(self.pairs, margins[first:], strict=True):
            if a in votes:
                votes[a if margin >= 0 else b] += 1
                sums[a] += margin
                sums[b] -= margin
                p = float(_squash(margin))
                shares[a] += p
                shares[b] += 1 - p
        best = min(languages, key=lambda v: (-votes[v], -sums[v], v))
        within = shares[best] / (len(languages) - 1) if len(languages) > 1 else 1.0
        return best, float(sure * within)


def fit(labelled: DataFrame, *, per_language: int = PER_LANGUAGE, seed: int = 3, profiled: bool = False) -> Model:
    """Model from rows (id, text, lang); ``profiled`` to learn what is in none of the languages as well."""
    known = labelled.where("id is not null and text is not null and lang is not null")
    chosen = bounded_sample(known, "lang", per_language, seed, "id").select("id", "text", "lang")

    def vectors(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            got = [(lang, features(text)) for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist())]
            full = [(lang, f) for lang, f in got if f]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in full], pa.string()),
                 pa.array([f[0] for _, f in full], pa.list_(pa.int32())),
                 pa.array([f[1] for _, f in full], pa.list_(pa.float32()))],
                names=["lang", "at", "x"],
            )

    sample = stage(batches(chosen).mapInArrow(vectors, "lang string, at array<int>, x array<float>"), "language_sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    of = {lang: name for name, langs in FAMILIES.items() for lang in langs}
    grouped: dict[str, list[str]] = {}
    for lang in languages:
        grouped.setdefault(of.get(lang, lang), []).append(lang)
    families = tuple((name, tuple(langs)) for name, langs in sorted(grouped.items()))
    pairs = tuple(p for _, langs in families for p in combinations(langs, 2))
    tasks: list[tuple[tuple[str, ...], tuple[str, ...]]] = []
    if len(families) > 1:
        tasks += [(langs, tuple(x for x in languages if x not in langs)) for _, langs in families]
    tasks += [((a,), (b,)) for a, b in pairs]
    if not tasks and not (profiled and languages):
        return Model(families, pairs, np.zeros((DIMENSIONS + 1, 0)))

    def train(group: pa.Table) -> pa.Table:
        machine = group["machine"][0].as_py()
        at, x = (group[c].combine_chunks() for c in ("at", "x"))
        if machine < 0:
            all_ = [v.values.to_numpy() for v in at], [v.values.to_numpy() for v in x], group["lang"].to_pylist()
            w = np.append(profile(*all_).astype(np.float64), least_evidence(*all_))
            return pa.table({"machine": pa.array([machine], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})
        sign = group["sign"].to_numpy().astype(np.float64)
        w = fit_machine([v.values.to_numpy() for v in at], [v.values.to_numpy() for v in x], sign)
        return pa.table({"machine": pa.array([machine], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})

    signs = sample.sparkSession.createDataFrame(
        [(i, lang, s) for i, (yes, no) in enumerate(tasks) for langs, s in ((yes, 1), (no, -1)) for lang in langs]
        + [(-1, lang, 1) for lang in languages if profiled],
        "machine int, lang string, sign int",
    )
    fitted = sample.join(signs, "lang").groupBy("machine").applyInArrow(train, "machine int, w binary").collect()
    got = {r["machine"]: np.frombuffer(r["w"]) for r in fitted}
    last = got.pop(-1, None)
    weights = np.stack([got[k] for k in sorted(got)], axis=1) if got else np.zeros((DIMENSIONS + 1, 0))
    if last is None:
        return Model(families, pairs, weights.astype(np.float32))
    profiles = last[:-1].reshape(DIMENSIONS, -1).astype(np.float32)
    return Model(families, pairs, weights.astype(np.float32), profiles, float(last[-1]))


def predict(docs: DataFrame, model: Model, columns: dict[str, Column], schema: str) -> DataFrame:
    """``columns`` of every row (``__text`` among them) with (lang_pred, score) in place of ``__text``."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            got = [model.predict(t.as_py()) for t in batch["__text"]]
            rest = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in rest), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())],
                names=[*rest, "lang_pred", "score"],
            )

    chosen = docs.select(*(c.alias(n) for n, c in columns.items()))
    return batches(chosen).mapInArrow(run, f"{schema}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, *, least: float = LEAST, text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is in a known language, with a score of at least ``least``."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            yield batch.filter(pa.array([model.known(t.as_py(), least) for t in batch[text_column]], pa.bool_()))

    return batches(docs).mapInArrow(run, docs.schema)


def identify(
    docs: DataFrame, learn: Column, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """(id, lang_pred, score) of every row of ``docs``, learned from its rows where ``learn`` holds."""
    labelled = docs.where(learn).select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    )
    model = fit(labelled, per_language=per_language)
    return predict(docs, model, {"id": F.col(id_column).cast("long"), "__text": F.col(text_column)}, "id bigint")
