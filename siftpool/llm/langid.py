"""Language identification: multinomial naive Bayes over hashed character n-grams.

n-grams of 1 to ORDER characters of the lower-cased text are hashed into
BUCKETS. Training counts them for each language over a bounded, documented
sample of labelled rows, drawn by language; the matrix of log-probabilities
(BUCKETS x languages) is broadcast in blocks of BLOCK languages, and whole texts
are scored batch by batch in numpy. All languages are learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import mix

ORDER, BUCKETS = 3, 1 << 14
#: About so many labelled rows are learned from: as many of each language as there are, or equal shares.
MAX_TRAIN_ROWS = 20_000
#: Languages whose log-probabilities are collected and broadcast together: 64 KB each.
BLOCK = 256
UNKNOWN = "und"
#: Characters handled at once.
AT_ONCE = 1 << 16


def bucket_counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, n-gram counts by bucket) in pieces; a row's counts are the sum over its pieces.

    Long texts are cut into pieces that overlap, so every n-gram counts once.
    """
    for row, text in enumerate(texts):
        low = text.lower()
        for at in range(0, max(len(low), 1), AT_ONCE):
            codes = np.frombuffer(low[at : at + AT_ONCE + ORDER - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            n = min(AT_ONCE, len(low) - at)
            yield row, np.bincount(_buckets(codes, n), minlength=BUCKETS)


def _buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """Buckets of all n-grams that begin in the first n characters."""
    out, value = [], np.zeros(len(codes), np.uint64)
    for k in range(ORDER):
        size = min(n, len(codes) - k)
        if size <= 0:
            break
        value = value[:size] * np.uint64(0x100000001B3) + codes[k : k + size] + np.uint64(1)
        out.append((mix(value) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Model:
    """Languages and the log-probabilities of buckets, with the log-priors."""

    def __init__(self, languages: list[str], counts: np.ndarray, rows: np.ndarray, total: float | None = None) -> None:
        """total: rows of all languages, where these are not all."""
        self.languages = languages
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
        self.prior = np.log(rows / (total or rows.sum()))

    def posteriors(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, n-grams, log of prior times likelihood by language) of each text that has a letter."""
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.languages:
            return
        total = np.zeros((len(rows), len(self.languages)))
        size = np.zeros(len(rows))
        short: list[tuple[int, np.ndarray]] = []

        def score() -> None:
            """Sum the log-probabilities of the pieces' n-grams in one gather."""
            if short:
                at = np.cumsum([0, *(len(b) for _, b in short)])
                sums = np.add.reduceat(self.log[np.concatenate([b for _, b in short])], at[:-1], axis=0, dtype=np.float64)
                for (r, b), s in zip(short, sums, strict=True):
                    total[r] += s
                    size[r] += len(b)
                short.clear()

        held, room = 0, max(AT_ONCE * 16 // max(len(self.languages), 16), 1)
        for r, i in enumerate(rows):
            low = texts[i].lower()
            for at in range(0, len(low), room):
                codes = np.frombuffer(low[at : at + room + ORDER - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                n = min(room, len(low) - at)
                short.append((r, _buckets(codes, n)))
                held += n
                if held >= room:
                    score()
                    held = 0
        score()
        for r, i in enumerate(rows):
            yield i, int(size[r]), self.prior + total[r]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is the posterior with the evidence of n n-grams weighed as of sqrt(n)."""
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for i, n, log in self.posteriors(texts):
            best = int(np.argmax(log))
            languages[i], scores[i] = self.languages[best], float(1 / np.exp((log - log[best]) / np.sqrt(max(n, 1))).sum())
        return languages, scores


def level(sizes: list[int], most: int) -> int:
    """The largest c with sum(min(size, c)) <= most, at least 1: how many rows of each language are drawn."""
    left, many = most, len(sizes)
    for n in sorted(sizes):
        if n * many > left:
            return max(left // many, 1)
        left, many = left - n, many - 1
    return max(sizes, default=1)


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> list[Model]:
    """Models of the languages, BLOCK in each, from the labelled rows of docs for which `learn` is true.

    Null texts and labels are not learned from. If there are more than max_rows
    rows, each language gives an equal number on average, or all it has, drawn by
    the hash of id, label and text; every language gives one row on average at
    least. Priors count all rows. The driver holds 64 KB for each language.
    Without any labelled row the one model knows no language and calls every text
    UNKNOWN.
    """
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    known = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return [Model([], np.zeros((1, BUCKETS)), np.ones(1))]
    each, total = level(list(known.values()), max_rows), float(sum(known.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, labels = b[0].to_pylist(), b[1].to_pylist()
            for row, n in bucket_counts(texts):
                own = sums.setdefault(labels[row], np.zeros(BUCKETS, np.int64))
                own += n
        for label, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(n[at])], ["l", "b", "n"])

    models, names = [], sorted(known)
    for low in range(0, len(names), BLOCK):
        own = names[low : low + BLOCK]
        tickets = F.create_map(*(F.lit(v) for x in own for v in (x, int(min(1.0, each / known[x]) * (1 << 30)))))
        drawn = rows.filter(F.col("l").isin(own)).filter(F.pmod(F.xxhash64("i", "l", "t"), F.lit(1 << 30)) < tickets[F.col("l")]).select("t", "l")
        place = {x: i for i, x in enumerate(own)}
        counts = np.zeros((len(own), BUCKETS))
        # At most BLOCK * BUCKETS rows.
        for batch in drawn.mapInArrow(count, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow().to_batches():
            for label, b, n in zip(batch["l"].to_pylist(), batch["b"].to_pylist(), batch["n"].to_pylist(), strict=True):
                counts[place[label], b] = n
        models.append(Model(own, counts, np.array([known[x] for x in own], float), total))
    return models


def predict(docs: DataFrame, models: list[Model], text_col: str = "text") -> DataFrame:
    """docs with lang_pred string and score double; columns of these names are replaced.

    UNKNOWN with score 0 if the text is null or has no letter. Only the text is
    read. Repeated rows get equal answers; an empty table gives an empty result.
    With several models the best languages of each are compared, a pass for each.
    """
    kept = docs.drop("lang_pred", "score")

    def told(model: Model) -> Column:
        held = docs.sparkSession.sparkContext.broadcast(model)

        def run(series: Iterator) -> Iterator:
            import pandas as pd

            for texts in series:
                out = pd.DataFrame({"log": None, "lang": UNKNOWN, "rest": 0.0, "root": 1.0}, index=range(len(texts)))
                got = list(held.value.posteriors([t if isinstance(t, str) else None for t in texts]))
                if got:
                    best = [int(np.argmax(log)) for _, _, log in got]
                    root = [float(np.sqrt(max(n, 1))) for _, n, _ in got]
                    values = zip((float(log[k]) for k, (_, _, log) in zip(best, got, strict=True)), (held.value.languages[k] for k in best), (float(np.exp((log - log[k]) / r).sum()) for k, r, (_, _, log) in zip(best, root, got, strict=True)), root, strict=True)
                    out.loc[[i for i, _, _ in got]] = list(values)
                out["log"] = out["log"].astype(float)
                yield out

        return F.pandas_udf(run, "log double, lang string, rest double, root double", F.PandasUDFType.SCALAR_ITER)(F.col(text_col))

    out = kept
    for k, model in enumerate(models):
        out = out.withColumn(f"_told{k}", told(model))
    each = [F.col(f"_told{k}") for k in range(len(models))]
    top = each[0]
    for one in each[1:]:  # of equal ones the first in the order of names
        top = F.when(one["log"] > top["log"], one).otherwise(top)
    log, lang = top["log"], top["lang"]
    rest = sum((e["rest"] * F.exp((e["log"] - log) / e["root"]) for e in each[1:]), each[0]["rest"] * F.exp((each[0]["log"] - log) / each[0]["root"]))
    return out.select(*kept.columns, lang.alias("lang_pred"), F.when(log.isNull() | F.isnan(log), 0.0).otherwise(1.0 / rest).alias("score"))
