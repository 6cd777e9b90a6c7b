"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. A lexicon is mined from labelled rows (never held out): words and word beginnings that stand
   in toxic texts far more often than in others. At most ``TOXIC_ROWS`` and ``CLEAN_ROWS``
   labelled rows are read for it, by hash.
2. Voters fire or stay silent on every whole text: a fixed list of insults, groups of the mined
   lexicon, and patterns of layout. One pass over all texts writes the votes as a bit mask and
   the lexicon entries found.
3. The label model is a mixture of two classes in which each voter depends on one other (a
   tree of largest conditional mutual information): it estimates how accurate the voters are and
   how they are correlated. It is fitted by expectation maximisation on the counts of all masks,
   of which there are at most 2^voters at any size; given labels enter as one more voter
   whose errors are estimated too.
4. A logistic regression on the lexicon entries and on how many words they make up, fitted to the posterior labels of at most
   ``FIT_ROWS`` rows, scores every text.

Inputs of a score are the text alone. Cases: null and empty texts have no features and get the
score of the intercept; rows without a doc_id are left out; repeated rows give a row each; a
doc_id with several labels counts as toxic if one says so; null labels are no labels; other
columns are ignored; without any toxic labelled row there is no lexicon but the fixed list; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocara.llm.common import materialize

TOXIC_ROWS = 2500
CLEAN_ROWS = 6000
FIT_ROWS = 30_000
LEXICON = 2500
#: An entry must be this much likelier in toxic texts (log odds), by this likelihood ratio.
LEAST_ODDS = 2.0
LEAST_RATIO = 20.0
PREFIXES = range(3, 9)
# Insults.
INSULTS = ("bastard", "clown", "creep", "disgusting", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
_WORD = re.compile(r"\w+")
_SHOUT = re.compile(r"[A-ZÀ-ÖØ-Þ]{3,}[.,]?!!")
_NOISE = re.compile(r"(?:###|\$\$\$|%%%|&&&|\*\*\*)")
GROUPS = 6
#: Votes on how many different words of a text, and what share of them, are in the lexicon.
MANY, SHARE = (2,), (0.01, 0.02, 0.03, 0.05)
#: Insults, groups of the lexicon, counts and shares, two patterns.
VOTERS = 1 + GROUPS + len(MANY) + len(SHARE) + 2
#: Features besides the entries: at least so many words, at least such a share of them.
COUNTS, SHARES = (1, 2, 3, 4, 6, 10), (0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.06, 0.1)

#: Words a worker remembers the lexicon entries of, per task.
REMEMBERED = 50_000


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def features(text: str | None) -> set[str]:
    """Words of a text, and their beginnings with a mark."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for word in words:
        out.update(word[:n] + "*" for n in PREFIXES if n < len(word) + 1)
    return out


def _feature_counts(only: dict[str, int] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                found = features(text)
                counts.update(found if only is None else found.intersection(only))
                if len(counts) > 300_000:
                    yield pd.DataFrame({"feature": list(counts), "n": list(counts.values())})
                    counts = Counter()
        yield pd.DataFrame({"feature": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype=np.int64)})

    return run


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        least = [sorted(zlib.crc32(w.encode()) for w in set(_WORD.findall((t or "").lower())))[:2] for t in batch["text"]]
        yield pd.DataFrame({"sketch": ["-".join(map(str, x)) for x in least], "text": batch["text"]})


def _apart(rows: DataFrame) -> DataFrame:
    """One text of each group that agrees in its two least word hashes: a large group of copies
    would put all its words into the lexicon."""
    return rows.mapInPandas(_sketched, "sketch string, text string").groupBy("sketch").agg(F.min("text").alias("text")).select("text")


def mine(labelled: DataFrame) -> dict[str, int]:
    """Entry -> voter group. ``labelled``: text, toxic."""
    toxic = materialize(labelled.where("toxic = 1").select("text").transform(_apart), "toxic")
    clean = materialize(labelled.where("toxic = 0").select("text").transform(_apart), "clean")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return {}
    least = max(3, n_toxic // 250)
    often = toxic.mapInPandas(_feature_counts(None), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # no more entries than the bounded rows can hold, and far fewer that are frequent
    hits = {r["feature"]: r["n"] for r in often.orderBy(F.desc("n"), "feature").limit(60_000).collect()}
    misses = {r["feature"]: r["n"] for r in clean.mapInPandas(_feature_counts(hits), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    chosen = []
    for feature, a in hits.items():
        b = misses.get(feature, 0)
        odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
        rate = (a + b) / (n_toxic + n_clean)
        ratio = 2 * sum(n * np.log(n / (rate * of)) for n, of in ((a, n_toxic), (b, n_clean), (n_toxic - a, n_toxic * (1 / rate - 1)), (n_clean - b, n_clean * (1 / rate - 1))) if n > 0 and rate < 1)
        if odds > LEAST_ODDS and ratio > LEAST_RATIO:
            chosen.append((ratio, feature))
    chosen.sort(key=lambda x: (-x[0], x[1]))
    return {feature: zlib.crc32(feature[:3].encode()) % GROUPS for _, feature in chosen[:LEXICON]}


def _votes(lexicon: dict[str, int]):
    number = {feature: i for i, feature in enumerate(lexicon)}
    group = list(lexicon.values())
    insults = set(INSULTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            masks, found = [], []
            for text in batch["text"]:
                text = text or ""
                words = set(_WORD.findall(text.lower()))
                entries: set[int] = set()
                listed = 0
                for word in words:
                    hit = known.get(word)
                    if hit is None:
                        names = [word, *(word[:n] + "*" for n in PREFIXES if n <= len(word))]
                        hit = known[word] = tuple(number[x] for x in names if x in number)
                        if len(known) > REMEMBERED:
                            known = {}
                    if hit:
                        entries.update(hit)
                        listed += 1
                share = listed / max(len(words), 1)
                mask = int(not insults.isdisjoint(words))
                for entry in entries:
                    mask |= 2 << group[entry]
                more = [*(listed >= n for n in MANY), *(share >= x for x in SHARE), len(_SHOUT.findall(text)) > 5, len(_NOISE.findall(text)) > 5]
                mask |= sum(vote << (1 + GROUPS + i) for i, vote in enumerate(more))
                extra = [*(listed >= n for n in COUNTS), *(share >= x for x in SHARES)]
                masks.append(mask)
                found.append(np.array([*sorted(entries), *(len(group) + i for i, on in enumerate(extra) if on)], dtype=np.int32))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "mask": masks, "entries": found})

    return run


class LabelModel:
    """Two classes; voters form a tree. Probabilities: ``prior`` of class 1, ``table[y, j, parent
    vote]`` = probability that voter j fires, ``error[y]`` = probability that a label is wrong."""

    def __init__(self, votes: np.ndarray, unlabelled: np.ndarray, clean: np.ndarray, toxic: np.ndarray, rounds: int = 40):
        self.error = np.array([0.05, 0.05])
        self.prior = min(0.5, max(0.02, (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 10)))
        firing = votes[:, 1 + GROUPS : 1 + GROUPS + len(MANY) + len(SHARE)].sum(axis=1) + votes[:, 0]
        known = toxic + clean
        start = np.where(known > 0, (toxic + 0.2) / (known + 1), np.clip(firing / 4, 0.02, 0.98))
        weight = unlabelled + known
        self._learn(votes, weight * start, weight * (1 - start))
        for _ in range(rounds):
            p = self.posterior(votes)
            with_one = p * (1 - self.error[1]) / (p * (1 - self.error[1]) + (1 - p) * self.error[0])
            with_zero = p * self.error[1] / (p * self.error[1] + (1 - p) * (1 - self.error[0]))
            one = unlabelled * p + toxic * with_one + clean * with_zero
            zero = weight - one
            total = max(weight.sum(), 1)
            self.prior = float(np.clip(one.sum() / total, 0.002, 0.9))
            if known.sum():
                self.error = np.array(
                    [
                        ((toxic * (1 - with_one)).sum() + 1) / ((toxic * (1 - with_one)).sum() + (clean * (1 - with_zero)).sum() + 50),
                        ((clean * with_zero).sum() + 1) / ((clean * with_zero).sum() + (toxic * with_one).sum() + 50),
                    ]
                ).clip(0.001, 0.3)
            self._learn(votes, one, zero)

    def _learn(self, votes: np.ndarray, one: np.ndarray, zero: np.ndarray) -> None:
        n = votes.shape[1]
        joint = np.empty((2, n, n, 2, 2))
        for y, weight in ((0, zero), (1, one)):
            for a in (0, 1):
                for b in (0, 1):
                    joint[y, :, :, a, b] = ((votes == a) * weight[:, None]).T @ (votes == b) + 0.25
        share = joint / joint.sum(axis=(3, 4), keepdims=True)
        left, right = share.sum(axis=4, keepdims=True), share.sum(axis=3, keepdims=True)
        mutual = (share * np.log(share / (left * right))).sum(axis=(3, 4))
        strength = (mutual * np.array([zero.sum(), one.sum()])[:, None, None]).sum(axis=0)
        self.parent = np.full(n, -1)
        inside, outside = [0], set(range(1, n))
        while outside:
            j, k = max(((j, k) for j in outside for k in inside), key=lambda x: (strength[x[0], x[1]], -x[0], -x[1]))
            self.parent[j] = k
            inside.append(j)
            outside.discard(j)
        self.table = np.empty((2, n, 2))
        for j in range(n):
            k = self.parent[j]
            pair = joint[:, j, k] if k >= 0 else np.stack([np.stack((joint[:, j, j].sum(axis=2)[:, a],) * 2, axis=1) for a in (0, 1)], axis=1)
            self.table[:, j] = pair[:, 1] / pair.sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of votes."""
        given = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        logs = []
        for y, prior in ((0, 1 - self.prior), (1, self.prior)):
            fire = self.table[y][np.arange(votes.shape[1]), given]
            logs.append(np.log(prior) + np.log(np.where(votes == 1, fire, 1 - fire)).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def fit_linear(entries: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of entries by Adam, with a small quadratic penalty."""
    row = np.repeat(np.arange(len(entries)), [len(e) for e in entries])
    column = np.concatenate(entries).astype(np.int64) if len(entries) and len(row) else np.zeros(0, dtype=np.int64)
    w, b = np.zeros(size + 1), np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)) if len(target) else -2.0
    w[size] = b
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1 if len(target) else 1):
        z = np.bincount(row, w[column], minlength=len(target)) + w[size]
        d = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g = np.append(np.bincount(column, d[row], minlength=size), d.sum()) / len(target)
        g[:size] += 2e-5 * w[:size]
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w -= 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:size], float(w[size])


def _scored(weights: np.ndarray, intercept: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = np.array([1 / (1 + np.exp(-np.clip(weights[e].sum() + intercept, -40, 40))) for e in batch["entries"]], dtype=np.float64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = materialize(known.where(~held_out(F.col("doc_id"))), "labels")
    drawn = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # at most TOXIC_ROWS + CLEAN_ROWS ids, so whole texts need not be shuffled to find their label
    sample = F.broadcast(drawn(1, TOXIC_ROWS).union(drawn(0, CLEAN_ROWS)))
    lexicon = mine(materialize(rows.join(sample, "doc_id").select("text", "toxic"), "sample"))
    votes = materialize(rows.mapInPandas(_votes(lexicon), "doc_id long, mask int, entries array<int>"), "votes")
    votes = votes.withColumn("held_out", held_out(F.col("doc_id")))
    # the smallest mask counts as often as any: at most 2^VOTERS rows leave
    seen = votes.select("doc_id", "mask").join(known, "doc_id", "left").groupBy("mask").agg(
        F.count(F.when(F.col("toxic").isNull(), 1)).alias("u"), F.count(F.when(F.col("toxic") == 0, 1)).alias("c"), F.count(F.when(F.col("toxic") == 1, 1)).alias("t")
    )
    seen = seen.toPandas()
    bits = lambda mask: (np.asarray(mask, dtype=np.int64)[:, None] >> np.arange(VOTERS)) & 1
    model = LabelModel(bits(seen["mask"]), *(seen[c].to_numpy(np.float64) for c in "uct"))
    sample = votes.where(~F.col("held_out")).orderBy(F.xxhash64("doc_id", "mask"), "doc_id").limit(FIT_ROWS).join(known, "doc_id", "left").toPandas()
    p = model.posterior(bits(sample["mask"]))
    e0, e1 = model.error
    label = sample["toxic"].to_numpy(dtype=np.float64, na_value=np.nan)
    p = np.where(label == 1, p * (1 - e1) / (p * (1 - e1) + (1 - p) * e0), np.where(label == 0, p * e1 / (p * e1 + (1 - p) * (1 - e0)), p))
    weights, intercept = fit_linear(list(sample["entries"]), p, len(lexicon) + len(COUNTS) + len(SHARES))
    return votes.select("doc_id", "held_out", "entries").mapInPandas(_scored(weights, intercept), "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that are not predicted toxic."""
    bad = score_toxicity(documents, labels).where("predicted = 1").select("doc_id").distinct()
    return documents.join(materialize(bad, "toxic").hint("merge"), "doc_id", "left_anti").select(documents.columns)
