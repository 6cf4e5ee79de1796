"""Quality classifier by co-training two views of a document.

The text view sees characters, character pairs and word and line statistics of
the whole text; the metadata view sees the other columns (source, language,
length). Each is a logistic regression. In every round each view labels all
unlabelled rows where it is confident, and the other view learns from those
pseudo-labels: from a bounded number of them, drawn in equal shares from the
kinds of metadata, so that rare kinds are heard. At the end each view's log-odds
are calibrated on labelled rows that neither has learned from, and the calibrated
log-odds add up, less the prior's. What is fitted on is bounded; all rows are
judged in every round and scored at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.sources.state import discard, materialize

from ._skew import probable
from .langid import level

#: Labelled rows, and rows with pseudo-labels in each round, that are fitted on, about; they are drawn by a hash of the row.
MAX_LABELLED, MAX_POOL = 8_000, 8_000
#: Kinds of metadata that pseudo-labels are drawn from in equal shares: hashes of the columns that are no numbers.
CELLS = 64
ROUNDS, CONFIDENT = 3, 0.97
PAIRS, META = 128, 64
#: Bytes of a text that are counted at once.
AT_ONCE = 1 << 20


def text_features(text: str) -> np.ndarray:
    """Shares of ASCII characters and hashed byte pairs, and statistics of words and lines."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ones, twos = np.zeros(256), np.zeros(PAIRS)
    for at in range(0, len(raw), AT_ONCE):
        part = raw[at : at + AT_ONCE + 1]
        ones += np.bincount(part[:AT_ONCE], minlength=256)
        code = part[:-1].astype(np.int32) * 251 + part[1:]
        twos += np.bincount(code % PAIRS, minlength=PAIRS)
    n = max(len(raw), 1)
    words, lines = text.split(), text.split("\n")
    w = max(len(words), 1)
    stats = [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(text) / w,
        len(set(words)) / w,
        len(set(lines)) / len(lines),
        np.log1p(max(map(len, lines))),
        np.log1p(max(map(len, words), default=0)),
        sum(x[-1] in ".!?" for x in words) / w,
        sum(x.isalpha() for x in words) / w,
        sum(x.isupper() for x in words) / w,
    ]
    shares = np.append(ones[:128], ones[128:].sum()) / n
    return np.concatenate([np.sqrt(shares), np.sqrt(twos / n), stats]).astype(np.float32)


def meta_features(values: tuple) -> np.ndarray:
    """Hashed indicators of texts, logarithms of numbers; a null is an indicator of its own."""
    out = np.zeros(META + 2 * len(values), np.float32)
    for i, v in enumerate(values):
        if isinstance(v, int | float) and v == v:
            out[META + 2 * i] = np.sign(v) * np.log1p(abs(v))
            out[META + 2 * i + 1] = out[META + 2 * i] ** 2
        else:
            out[xxhash.xxh3_64_intdigest(f"{i}={v}") % META] = 1
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised columns, with a ridge penalty; Newton steps."""

    ridge: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), self.ridge)
        penalty[-1] = 1e-6
        for _ in range(15):
            p = _sigmoid(z @ w)
            slope = z.T @ (p - y) + penalty * w
            if np.abs(slope).max() < 1e-4 * len(y):
                break
            hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            w -= np.linalg.solve(hessian, slope)
        self.weights = w
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that a * score + b are calibrated log-odds; the score's sign is not turned."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    width = score.std() or 1.0
    own = Logistic(ridge=0.1).fit((score / width)[:, None], y)
    a = own.weights[0] / own.scale[0] / width
    b = own.weights[1] - own.weights[0] * own.mean[0] / own.scale[0]
    return (float(a), float(b)) if a > 0 else (0.0, _log_odds(y))


def _log_odds(y: np.ndarray) -> float:
    share = (y.sum() + 0.5) / (len(y) + 1)
    return float(np.log(share / (1 - share)))


@dataclass
class Model:
    """Two views, how they are calibrated, and the prior log-odds; views is empty if nothing could be learned."""

    views: list[Logistic]
    scales: list[tuple[float, float]]
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """The probability of quality 1 of each row."""
        if not self.views:
            return np.full(len(text), float(_sigmoid(np.array(self.prior))))
        parts = [a * v.log_odds(x) + b for v, (a, b), x in zip(self.views, self.scales, (text, meta), strict=True)]
        return _sigmoid(parts[0] + parts[1] - self.prior)


Views = tuple[list[Logistic], list[tuple[float, float]]]


def judged(views: Views, data: tuple[np.ndarray, np.ndarray], confident: float) -> list[np.ndarray]:
    """For each view, 1 or 0 for rows where it is confident of a label, else -1."""
    out = []
    for v, (a, b), x in zip(*views, data, strict=True):
        p = _sigmoid(a * v.log_odds(x) + b)
        out.append(np.where(p >= confident, 1, np.where(p <= 1 - confident, 0, -1)))
    return out


def co_train(
    text: np.ndarray,
    meta: np.ndarray,
    y: np.ndarray,
    held: np.ndarray,
    rounds: int = ROUNDS,
    confident: float = CONFIDENT,
    pool: Callable[[Views], list[tuple[np.ndarray, np.ndarray]]] | None = None,
) -> Model:
    """Fit on rows with y 0 or 1 (y is -1 for unlabelled ones); rows marked in `held` are kept for calibration.

    pool gives for each view the features and pseudo-labels that the other one
    teaches it; by default they come from the unlabelled rows of the arrays.
    Without rows of both classes to learn from, the model gives every row the
    share of class 1.
    """
    known, free = np.flatnonzero((y >= 0) & ~held), np.flatnonzero(y < 0)
    check = np.flatnonzero((y >= 0) & held)
    labelled = y[y >= 0]
    if len(known) == 0 or y[known].min() == y[known].max():
        return Model([], [], _log_odds(labelled) if len(labelled) else 0.0)
    if len(check) == 0 or y[check].min() == y[check].max():
        check = known
    data = (text, meta)

    def own_pool(views: Views) -> list[tuple[np.ndarray, np.ndarray]]:
        told = judged(views, (text[free], meta[free]), confident)
        return [(x[free][told[1 - k] >= 0], told[1 - k][told[1 - k] >= 0]) for k, x in enumerate(data)]

    lent: list[tuple[np.ndarray, np.ndarray]] = [(x[:0], y[:0]) for x in data]
    for turn in range(rounds + 1):
        views = [Logistic().fit(np.concatenate([x[known], more]), np.concatenate([y[known], labels])) for x, (more, labels) in zip(data, lent, strict=True)]
        scales = [platt(v.log_odds(x[check]), y[check]) for v, x in zip(views, data, strict=True)]
        if turn < rounds:
            lent = (pool or own_pool)((views, scales))
    return Model(views, scales, _log_odds(y[check]))


def _features(texts: pa.Array, metas: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_features(t.as_py() or "") for t in texts])
    meta = np.array([meta_features(v) for v in zip(*(m.to_pylist() for m in metas), strict=True)])
    return text, meta


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of features as bytes, with half the digits: sums over rows do not need more."""
    return pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def _cell(values: tuple) -> int:
    return xxhash.xxh3_64_intdigest(repr([None if isinstance(v, int | float) else v for v in values])) % CELLS


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"), label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> Model:
    """A model from about max_labelled rows of docs with a label 0 or 1, and pseudo-labels of all other rows.

    All other rows are judged in every round; about max_pool pseudo-labels for
    each view are learned from. Null labels count as none; where an id has several
    labels, the least counts. Rows alike in id, text and metadata count once.
    """
    told = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).cast("int").alias("y"))
    names = [f"m{k}" for k in range(len(meta_cols))]
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), *[F.col(c).alias(n) for n, c in zip(names, meta_cols, strict=True)])
    rows = rows.withColumn("h", F.xxhash64("i", "t", *names))
    known = rows.select("i").join(told, "i").count()
    share = min(1.0, max_labelled / max(known, 1))
    drawn = rows.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    # Tickets are drawn before texts are moved, and rows that surely have no label are not moved.
    drawn = probable(drawn, F.xxhash64(F.coalesce(F.col("i").cast("string"), F.lit(""))), told.select(F.xxhash64(F.col("i").cast("string")))).filter("_maybe").drop("_maybe").join(told, "i")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                metas = [b[n] for n in names]
                cells = [_cell(v) for v in zip(*(m.to_pylist() for m in metas), strict=True)]
                yield pa.RecordBatch.from_arrays([b["i"], b["y"], b["h"], pa.array(cells, pa.int32()), *map(_packed, _features(b["t"], metas))], ["i", "y", "h", "cell", "text", "meta"])

    schema = f"i {kind}, y int, h long, cell int, text binary, meta binary"
    sample = drawn.dropDuplicates(["h"]).mapInArrow(run, schema).toArrow()  # bounded by max_labelled
    if not sample.num_rows:
        return Model([], [], 0.0)
    sample = sample.sort_by("h")  # so that partitioning changes nothing
    text, meta = _unpacked(sample["text"]), _unpacked(sample["meta"])
    held = np.array([xxhash.xxh3_64_intdigest(str(i)) % 4 == 0 for i in sample["i"].to_pylist()])
    own = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in sample["h"].to_pylist()], "h long"))  # max_labelled rows, about
    free = materialize(rows.join(own, "h", "left_anti").withColumn("y", F.lit(None).cast("int")).mapInArrow(run, schema), "pool")

    def pool(views: Views) -> list[tuple[np.ndarray, np.ndarray]]:
        """What each view learns from the other: counts of confident rows by cell tell the shares that are drawn."""
        now = docs.sparkSession.sparkContext.broadcast(views)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    for view, label in enumerate(judged(now.value, (_unpacked(b["text"]), _unpacked(b["meta"])), CONFIDENT)):
                        at = pa.array(np.flatnonzero(label >= 0))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view, np.int32)), pa.array(label[label >= 0].astype(np.int32)), b["cell"].take(at), b["h"].take(at), b["meta" if view == 0 else "text"].take(at)], ["view", "label", "cell", "h", "x"])

        sure = free.mapInArrow(judge, "view int, label int, cell int, h long, x binary")
        sizes = sure.groupBy("view", "label", "cell").agg(F.approx_count_distinct("h").alias("n")).collect()  # at most 4 * CELLS rows
        tickets = []
        for view in (0, 1):
            counts = [r for r in sizes if r["view"] == view]
            each = level([r["n"] for r in counts], max_pool)
            tickets += [(view, r["label"], r["cell"], int(min(1.0, each / max(r["n"], 1)) * (1 << 30))) for r in counts]
        if not tickets:
            return [(x[:0], np.zeros(0, np.int64)) for x in (text, meta)]
        limits = F.broadcast(docs.sparkSession.createDataFrame(tickets, "view int, label int, cell int, least long"))
        got = sure.join(limits, ["view", "label", "cell"]).filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.col("least")).select("view", "label", "h", "x").dropDuplicates(["view", "h"]).toArrow()
        got = got.sort_by("h")  # about max_pool rows for each view
        out = []
        for taught, width in ((0, text.shape[1]), (1, meta.shape[1])):
            mine = got.filter(pa.compute.equal(got["view"], 1 - taught))
            out.append((_unpacked(mine["x"]) if mine.num_rows else np.zeros((0, width), np.float32), np.array(mine["label"].to_pylist(), np.int64)))
        return out

    y = np.array(sample["y"].to_pylist())
    model = co_train(text, meta, y, held, pool=pool)
    discard(free)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"), keep: float | None = None) -> DataFrame:
    """docs with quality_score double (a column of that name is replaced); with `keep`, only rows that score as much.

    Null text is scored as the empty text, null metadata as values of their own.
    Equal rows get equal scores. An empty table gives an empty result.
    """
    docs = docs.drop("quality_score")
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = held.value.score(*_features(b.column(names.index(text_col)), [b.column(names.index(c)) for c in meta_cols]))
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*names, "quality_score"])
            yield out if keep is None else out.filter(pa.array(p >= keep))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, quality_score double")
