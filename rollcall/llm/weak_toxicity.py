"""Toxicity by weak supervision.

1. From a bounded sample of labelled training rows (``MAX_LABELLED``, those with
   the least hash of their id), words and word beginnings that toxic texts have
   far more often become voters, beside a fixed lexicon and patterns of the
   whole text. A voter votes toxic or abstains; it speaks up where its word stands at all,
   or only where the word has some weight in the text, whichever tells more.
2. A generative label model with a hidden label is fitted to the votes by
   expectation and maximisation: how often each voter is right when it speaks up. The
   given label is one more voter, whose accuracy is ``LABEL_TRUST``. Correlations that the
   hidden label leaves unexplained are estimated from the residuals of the votes;
   voters that say the same in a text share one voice there. One more voter, silence,
   votes clean where no voting word occurs.
3. A linear (logistic) classifier on words and word beginnings, each by its presence and
   by its weight in the text, is trained on the model's posterior labels, and scores every
   whole text.

Training rows are those whose crc32 of the id as text leaves another remainder by
three than 1; the other rows are held out. Labels, languages, sources and ids
are no inputs of a score.

Defined cases: a null text is an empty one; its score is that of a text without
features. Null labels and labels without a document are ignored; of several
labels of one document the highest holds, and of several rows of one id the text that
comes first in their order is learnt from. Without training rows of both labels no
classifier can be fitted, and all texts get the score ``PRIOR``. Repeated rows are
scored alike. Of an empty table the result is empty. Other columns are kept; one named
score, in upper or lower case, gives way.

The model's size is a parameter, ``max_features`` and ``max_voters``: features beyond
it are those whose rates on toxic and clean texts differ least.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .prefix_tree import _spread
from .runtime import discard, documents, lean, row_columns, row_of, schema_with, written

#: Labelled rows that are learnt from at most; 12 bytes of each are broadcast, and their texts are written once.
MAX_LABELLED = 12_000
#: The model's size; so many are collected and sent to all workers.
MAX_VOTERS, MAX_FEATURES = 400, 3000
#: Texts of the sample that a feature has to stand in.
LEAST_TEXTS = 3
#: The logarithm of a voter's rates on toxic and clean texts, at least.
LEAST_ODDS = 2.0
THRESHOLD, PRIOR = 0.7, 0.01
#: Standard errors by which a feature's rates on toxic and clean texts have to differ.
LEAST_PULL = 6.0
#: Weight of a feature in a text from which it is loud there.
LOUD = 0.25
#: How often a given label is taken to be right.
LABEL_TRUST = 0.95
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)
LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "dumb", "imbecile", "bastard", "pig", "filth", "vermin", "freak", "ugly", "hate", "kill")
PATTERNS = ("shouting", "exclaiming", "symbols")


def _salt(kind: int) -> np.uint64:
    return np.uint64(0x51ED0000 + kind)


def _word_features(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return tb.mix(tb.run_hashes(data, ends - [len(x) for x in raw], ends) ^ _salt(0))


def text_features(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text: the number of the text, the feature's hash (or, if ``wanted`` is given, its place in that sorted array), and its weight.

    The weight is the percentage of the text's words that have the feature, less a little for the first of them (one may be chance), and 1 at most.
    """
    low = tb.lowered(data)
    starts, ends = tb.runs(tb.WORDISH[low], off)
    words = tb.run_hashes(low, starts, ends)
    of = tb.text_of(starts, off)
    distinct, first, inverse = np.unique(words, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    found, owner = [tb.mix(distinct ^ _salt(0))], [np.arange(len(distinct))]
    for n in BEGINNINGS:
        longer = np.flatnonzero(e - s > n)
        found.append(tb.mix(tb.run_hashes(low, s[longer], s[longer] + n) ^ _salt(n)))
        owner.append(longer)
    feature, owner = np.concatenate(found), np.concatenate(owner)
    if wanted is not None:
        place = np.minimum(np.searchsorted(wanted, feature), max(0, len(wanted) - 1))
        hit = wanted[place] == feature if len(wanted) else np.zeros(len(feature), dtype=bool)
        feature, owner = place[hit].astype(np.uint64), owner[hit]
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    count = np.bincount(owner, minlength=len(distinct))
    begin = np.cumsum(count) - count
    times = count[inverse]
    text, feature = np.repeat(of, times), feature[_spread(begin[inverse], times)]
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    if not len(text):
        return text, feature, np.zeros(0)
    head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])]))
    often = np.diff(np.append(head, len(text)))
    text, feature = text[head], feature[head]
    return text, feature, np.minimum(1.0, 100 * (often - 0.6) / tb.count_by_text(of, len(off) - 1)[text])


def pattern_votes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each pattern holds for each text."""
    letters = np.maximum(tb.sums_by_text(tb.LETTER[data], off), 1)
    size = np.maximum(np.diff(off), 1)
    return np.stack([
        tb.sums_by_text(tb.UPPER[data], off) > 0.5 * letters,
        100 * tb.sums_by_text(data == 33, off) > size,
        20 * tb.sums_by_text(tb.byte_set(b"#*$%&|<>")[data], off) > size,
    ], axis=1)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


@dataclass
class Classifier:
    features: np.ndarray
    #: of the features' weights in a text, one for each, then of their presence
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = np.full(len(off) - 1, self.bias)
        m = len(self.features)
        if m:
            text, place, share = text_features(data, off, self.features)
            place = place.astype(np.int64)
            z += np.bincount(text, weights=self.weights[place] * share + self.weights[m + place], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class LabelModel:
    #: how often a voter is right when it speaks up; the last voter votes clean, the others toxic
    accuracy: np.ndarray
    #: what each two voters say alike beyond the hidden label
    alike: np.ndarray
    prior: float

    @property
    def voice(self) -> np.ndarray:
        """The part of its voice that each voter has where all speak."""
        return 1 / (1 + self.alike.sum(axis=0))

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None, trust: float = LABEL_TRUST) -> np.ndarray:
        """The probability of toxic. A voter that abstains says nothing and takes nothing of the others' voice; labels vote besides if they are given."""
        base = np.log(self.prior / (1 - self.prior))
        toxic = self.accuracy.copy()
        toxic[-1] = 1 - toxic[-1]
        z = base + (votes / (1 + votes @ self.alike)) @ (np.log(toxic / (1 - toxic)) - base)
        z = np.clip(z, -30, 30)
        if labels is not None:
            z = z + np.log(trust / (1 - trust)) * (2 * labels - 1)
        return 1 / (1 + np.exp(-z))


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, trust: float = LABEL_TRUST) -> LabelModel:
    """Accuracies of voters, and the share of each in what correlated voters say together.

    Expectation and maximisation over a hidden label, on which the labels of the
    training rows vote too.
    """
    n, m = votes.shape
    votes = votes.astype(np.float64)
    spoken = votes.sum(axis=0)
    r = np.minimum(votes[:, :-1].sum(axis=1) / 2, 0.95) * 0.98 + 0.01
    model = LabelModel(np.full(m, 0.5), np.zeros((m, m)), float(np.clip(labels.mean(), 1e-4, 0.9)))
    for k in range(rounds):
        right = (r @ votes + model.prior) / (spoken + 1)
        right[-1] = 1 - right[-1]
        model.accuracy = np.clip(right, 1e-3, 1 - 1e-3)
        model.prior = float(np.clip((r.sum() + 0.5) / (n + 1), 1e-4, 0.9))
        if k >= 2:
            # what of the votes the hidden label leaves unexplained
            p, q = (r @ votes) / max(r.sum(), 1e-9), ((1 - r) @ votes) / max((1 - r).sum(), 1e-9)
            left = votes - np.outer(r, p) - np.outer(1 - r, q)
            scale = np.sqrt((left**2).sum(axis=0)) + 1e-9
            corr = (left.T @ left) / np.outer(scale, scale)
            np.fill_diagonal(corr, 0)
            model.alike = np.where(corr > 0.2, corr, 0)
            # silence never speaks along with another voter
            model.alike[-1], model.alike[:, -1] = 0, 0
        r = model.posterior(votes, labels, trust)
    return model


def fit_linear(text: np.ndarray, place: np.ndarray, share: np.ndarray, n: int, m: int, target: np.ndarray, steps: int = 300, ridge: float = 4e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on the weights of features by Adam; all texts weigh alike."""
    w, b = np.zeros(m + 1), 0.0
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    rate = float(np.clip(target.mean(), 0.01, 0.99))
    weight = np.full(n, 1 / n)
    w[m] = np.log(rate / (1 - rate))
    for k in range(1, steps + 1):
        z = np.bincount(text, weights=w[place] * share, minlength=n) + w[m]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.append(np.bincount(place, weights=g[text] * share, minlength=m), g.sum())
        grad[:m] += ridge * w[:m]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= 0.15 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-9)
    b = float(w[m])
    return w[:m], b


def _feature_counts(sample: DataFrame) -> DataFrame:
    """In how many toxic and clean texts of the sample each feature stands (toxic, clean) and is loud (loud_toxic, loud_clean)."""
    names = ["toxic", "clean", "loud_toxic", "loud_clean"]

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            found = []
            for lo, _, data, off in tb.slices(batch.column(0)):
                text, feature, share = text_features(data, off)
                found.append((feature, toxic[lo + text], share >= LOUD))
            if found:
                feature, is_toxic, loud = (np.concatenate(x) for x in zip(*found))
                keys, inverse = np.unique(feature, return_inverse=True)
                counts = [np.bincount(inverse[mask], minlength=len(keys)).astype(np.int64) for mask in (is_toxic, ~is_toxic, is_toxic & loud, ~is_toxic & loud)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], names=["feature", *names])

    rows = sample.select("text", "toxic").mapInArrow(lean(run), "feature long, toxic long, clean long, loud_toxic long, loud_clean long")
    return rows.groupBy("feature").agg(*[F.sum(x).alias(x) for x in names])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, max_voters: int = MAX_VOTERS
) -> Classifier:
    """Fits the label model and the classifier to training rows of ``labels`` (doc_id, toxic)."""
    nothing = Classifier(np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log(PRIOR / (1 - PRIOR))))
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").alias("toxic"))
    # labels without a document take no place
    chosen = chosen.join(docs.select(F.col(id_col).cast("long").alias("__id")), "__id", "left_semi")
    chosen = docs.sparkSession.createDataFrame(chosen.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled).toArrow(), chosen.schema)
    sample = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id")
    # a row for each id, however often it stands in the table; written, since it is read three times
    paths: list[str] = []
    sample = written(sample.groupBy("__id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic"), "labelled", paths)
    by_class = {bool(t): n for t, n in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = by_class.get(True, 0), by_class.get(False, 0)
    if not n_toxic or not n_clean:
        discard(docs.sparkSession, paths)
        return nothing
    n = n_toxic + n_clean

    def tells(toxic: str, clean: str) -> tuple[Column, Column]:
        """How many standard errors the rates on toxic and clean texts are apart, and the logarithm of their ratio."""
        rate_toxic, rate_clean = (F.col(toxic) + 0.5) / (n_toxic + 1), (F.col(clean) + 0.5) / (n_clean + 1)
        rate = (F.col(toxic) + F.col(clean) + 1) / (n + 2)
        return (rate_toxic - rate_clean) / F.sqrt(rate * (1 - rate) * (1 / n_toxic + 1 / n_clean)), F.log(rate_toxic / rate_clean)

    (any_pull, any_odds), (loud_pull, loud_odds) = tells("toxic", "clean"), tells("loud_toxic", "loud_clean")
    counts = _feature_counts(sample).withColumn("loud", F.abs(loud_pull) > F.abs(any_pull))
    counts = counts.select(
        "feature", "loud", F.when(F.col("loud"), F.col("loud_toxic")).otherwise(F.col("toxic")).alias("toxic"), F.when(F.col("loud"), F.col("loud_clean")).otherwise(F.col("clean")).alias("clean"),
        F.when(F.col("loud"), loud_pull).otherwise(any_pull).alias("pull"), F.when(F.col("loud"), loud_odds).otherwise(any_odds).alias("odds"),
    )
    best = counts.where((F.col("toxic") + F.col("clean") >= LEAST_TEXTS) & (F.abs("pull") >= LEAST_PULL)).orderBy(F.desc(F.abs("pull")), "feature").limit(max_features).collect()
    hashes = lambda rows: np.array([r["feature"] for r in rows], dtype=np.int64).view(np.uint64)
    fixed = _word_features(list(LEXICON))
    features = np.unique(np.concatenate([hashes(best), fixed]))
    m = len(features)
    only_loud = np.zeros(m, dtype=bool)
    only_loud[np.searchsorted(features, hashes(best))] = [r["loud"] for r in best]
    strong = [r for r in best if r["odds"] > LEAST_ODDS and r["toxic"] >= LEAST_TEXTS][:max_voters]
    voters = np.unique(np.concatenate([hashes(strong), fixed]))

    def gather(batches):
        for batch in batches:
            for lo, hi, data, off in tb.slices(batch.column(0)):
                n = len(off) - 1
                of, place, share = text_features(data, off, features)
                at = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(place.astype(np.int32)))
                shares = pa.ListArray.from_arrays(at, pa.array(share.astype(np.float32)))
                patterns = pattern_votes(data, off).astype(np.int32) @ (1 << np.arange(len(PATTERNS)))
                yield pa.RecordBatch.from_arrays([lists, shares, pa.array(patterns.astype(np.int32)), batch.column(1).slice(lo, hi - lo)], names=["places", "shares", "patterns", "toxic"])

    # at most max_labelled rows of at most max_features small numbers
    rows = sample.mapInArrow(lean(gather), "places array<int>, shares array<float>, patterns int, toxic int").toArrow()
    discard(docs.sparkSession, paths)
    lists = pa.concat_arrays(rows["places"].chunks)
    n = len(lists)
    place = lists.flatten().to_numpy().astype(np.int64)
    share = pa.concat_arrays(rows["shares"].chunks).flatten().to_numpy().astype(np.float64)
    of = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    # voters: words and word beginnings, patterns, and silence, which votes clean where not even a quiet word of a voter occurs
    votes = np.zeros((n, len(voters) + len(PATTERNS) + 1), dtype=np.float32)
    seat = np.full(m, -1, dtype=np.int64)
    seat[np.searchsorted(features, voters)] = np.arange(len(voters))
    spoken = (seat[place] >= 0) & ((share >= LOUD) | ~only_loud[place])
    votes[of[spoken], seat[place[spoken]]] = 1
    bits = rows["patterns"].to_numpy()
    for k in range(len(PATTERNS)):
        votes[:, len(voters) + k] = (bits >> k) & 1
    votes[:, -1] = np.bincount(of[seat[place] >= 0], minlength=n) == 0
    truth = rows["toxic"].to_numpy().astype(np.float64)
    target = fit_label_model(votes, truth).posterior(votes, truth)
    weights, bias = fit_linear(np.concatenate([of, of]), np.concatenate([place, place + m]), np.concatenate([share, np.ones(len(share))]), n, 2 * m, target)
    return Classifier(features, weights, bias)


def with_scores(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and score. The model is broadcast: at most max_features and the lexicon."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(row_of(docs, "score"), F.col(text).alias("__text"))

    def run(batches):
        for batch in batches:
            parts = [shared.value.scores(data, off) for _, _, data, off in tb.slices(batch.column(1))]
            yield tb.with_columns(batch, {"score": pa.array(np.concatenate(parts) if parts else np.zeros(0))})

    scored = rows.mapInArrow(lean(run), schema_with(rows, [T.StructField("score", T.DoubleType())]))
    return scored.select(*row_columns(docs, "score"), "score")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with the columns of ``docs``."""
    model = fit(docs, labels, id_col, text)
    rows = docs.select(row_of(docs), F.col(text).alias("__text"))
    return with_scores(rows, model, "__text").where(F.col("score") < threshold).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, read_labels(spark, sf_dir))
    return with_scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
