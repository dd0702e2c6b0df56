"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TextBuffer, begin_task, held_out, text_groups

#: Hash space of the terms: 2^20.
BITS = 20
#: At most so many labelled rows of each class are learned from, the ones with the lowest hash of doc_id, ...
SAMPLE = 4000
#: ... and of these, in that order, whole rows until a class has so many terms; its first row counts in any case.
SAMPLE_TERMS = 4_000_000
#: Beginnings of words, in bytes, that are terms besides the words.
STEMS = (3, 5, 7)
FACTORS = 8
#: Terms learn at a pace, none is left out: weights by how surely a term tells the classes apart (half the pace at
#: SURE standard deviations), factors by how many learned rows hold it (half at OFTEN).
SURE, OFTEN = 1.0, 20.0


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term: each word, and its beginnings of STEMS bytes where it is longer."""
    buf = TextBuffer(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(buf.first))
    length = buf.end - buf.start
    who, where = [text], [buf.h(buf.start, buf.end, 1)]
    for k in STEMS:
        some = length > k
        a = buf.start[some]
        who.append(text[some])
        where.append(buf.h(a, a + k, k))
    return np.concatenate(who), (np.concatenate(where) >> np.uint64(64 - BITS)).astype(np.int64)


def _buckets(texts: list[str]):
    """Distinct buckets of each text."""
    for lo, hi in text_groups(texts):
        text, bucket = _hashed(texts[lo:hi])
        pair = np.unique((text << BITS) | bucket)
        cut = np.searchsorted(pair >> BITS, np.arange(hi - lo + 1))
        for a, b in zip(cut[:-1], cut[1:]):
            yield (pair[a:b] & ((1 << BITS) - 1)).astype(np.int32)


@dataclass
class FactorizationMachine:
    """score = sigmoid(w0 + sum w + sum over pairs of <v, v'>) over the distinct terms of a text.

    Every bucket that a learned row holds has a weight and factors; others weigh nothing.
    """

    slot: np.ndarray  # bucket -> term, -1 where no learned row holds it
    w0: float
    w: np.ndarray
    v: np.ndarray

    @classmethod
    def fit(cls, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 1.0, vrate: float = 0.002, batch: int = 64, decay: float = 1e-4, seed: int = 0) -> FactorizationMachine:
        """docs: buckets of each text; y: 0 or 1; weight: of each row. Gradient steps on the terms of a few rows at a time, always in one order."""
        prior = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.01
        w0 = float(np.log(prior / (1 - prior)))
        slot = np.full(1 << BITS, -1, np.int32)
        if not (y == 1).any() or not (y == 0).any():
            return cls(slot, w0, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
        terms = np.unique(np.concatenate(docs))
        slot[terms] = np.arange(len(terms))
        has = [np.bincount(slot[np.concatenate([d for d, t in zip(docs, y) if t == c])], minlength=len(terms)) for c in (0, 1)]
        n0, n1 = int((y == 0).sum()), int((y == 1).sum())
        p = (has[0] + has[1]) / (n0 + n1)
        z = np.abs(has[1] / n1 - has[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        pace = z * z * z / (z * z + SURE * SURE)
        pace /= max(pace.max(), 1e-9)
        often = (has[0] + has[1]) / (has[0] + has[1] + OFTEN)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(docs))
        blocks = []
        for lo in range(0, len(order), batch):
            some = order[lo: lo + batch]
            at = slot[np.concatenate([docs[i] for i in some])]
            each, spot = np.unique(at, return_inverse=True)
            n = np.array([len(docs[i]) for i in some])
            full = n > 0
            row = np.repeat(np.arange(len(some)), n)
            turn = np.argsort(spot, kind="stable")
            blocks.append((some, full, (np.cumsum(n) - n)[full], each, spot.astype(np.int32), row[turn].astype(np.int32), np.searchsorted(spot[turn], np.arange(len(each)))))
        w, v = np.zeros(len(terms), np.float32), rng.normal(0, 0.01, (len(terms), FACTORS)).astype(np.float32)
        sv = np.full((len(terms), FACTORS), 1e-2, np.float32)
        pace, often = pace.astype(np.float32), often.astype(np.float32)
        weight = weight / weight.mean()
        mean, seen = [0.0, np.zeros_like(w), np.zeros_like(v)], 0
        for epoch in range(epochs):
            for i in rng.permutation(len(blocks)):
                some, full, start, each, spot, row, first = blocks[i]
                mine, lin = v[each] * often[each][:, None], w[each] * pace[each]
                s, f = np.zeros((len(some), FACTORS), np.float32), np.full(len(some), w0)
                if len(start):
                    s[full] = np.add.reduceat(mine[spot], start, axis=0)
                    f[full] += np.add.reduceat((lin - 0.5 * (mine * mine).sum(1))[spot], start)
                f += 0.5 * (s * s).sum(1)
                g = (weight[some] * (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y[some])).astype(np.float32)
                total = np.add.reduceat(g[row], first) if len(first) else np.zeros(0, np.float32)
                dv = np.add.reduceat((g[:, None] * s)[row], first, axis=0) if len(first) else np.zeros((0, FACTORS), np.float32)
                dv = dv - total[:, None] * mine
                dv = dv * often[each][:, None] + decay * v[each]
                sv[each] += dv * dv
                w[each] -= rate * (total * pace[each] + decay * w[each])
                v[each] -= vrate * dv / np.sqrt(sv[each])
                w0 -= rate * g.mean()
            if 2 * epoch >= epochs:  # the mean of the later passes hangs less on the order of the rows
                mean, seen = [m + x for m, x in zip(mean, (w0, w, v))], seen + 1
        w0, w, v = (m / max(1, seen) for m in mean)
        return cls(slot, float(w0), (w * pace).astype(np.float32), (v * often[:, None]).astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in text_groups(texts):
            n = hi - lo
            text, bucket = _hashed(texts[lo:hi])
            term = self.slot[bucket]
            known = term >= 0
            pair = np.unique(text[known] * (1 << BITS) + term[known])
            text, term = pair >> BITS, pair & ((1 << BITS) - 1)
            f = self.w0 + np.bincount(text, self.w[term], n)
            for k in range(self.v.shape[1]):
                v = self.v[term, k].astype(np.float64)
                f += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_terms: int = SAMPLE_TERMS) -> FactorizationMachine:
    """Learns from labelled rows that aren't held out, at most `sample` of each class; rows count by their class's true share.

    Null labels and null ids are left out; of repeated labels of a document the larger holds. Whole texts are read; a
    class's rows are taken in hash order while those before hold fewer than `sample_terms` distinct terms in all. With
    no or one class the machine gives one score to all. Ids of any type.
    """
    known = labels.where(labels["toxic"].isNotNull() & ~held_out(labels["doc_id"])).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    pick = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        pick = one if pick is None else pick.union(one)
    texts = docs.select(docs["doc_id"].alias("k"), docs["text"].alias("t")).join(F.broadcast(pick), F.col("k") == F.col("doc_id"))  # 2 x sample rows

    def hashed(batches):
        begin_task("toxicity")
        for b in batches:
            found = list(_buckets([t or "" for t in b.column(2).to_pylist()]))
            yield pa.record_batch({"h": b.column(0), "y": b.column(1), "n": pa.array([len(x) for x in found], pa.int64()), "b": pa.array([x.tobytes() for x in found], pa.binary())})

    rows = texts.select(F.xxhash64("k").alias("h"), "y", "t").mapInArrow(hashed, "h long, y int, n long, b binary")
    before = F.sum("n").over(Window.partitionBy("y").orderBy("h", "b").rowsBetween(Window.unboundedPreceding, -1))
    rows = sorted(rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_terms).select("h", "y", "b").collect())
    y = np.array([r[1] for r in rows])
    weight = np.array([n[c] / max(1, (y == c).sum()) for c in y], float)
    return FactorizationMachine.fit([np.frombuffer(r[2], np.int32) for r in rows], y, weight)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from its whole text alone.

    Null text counts as empty; an empty text has no terms and gets the machine's bias. Repeated rows get the same score.
    A null doc_id counts as held out. A very long text is scored whole, by itself. Empty table: no rows. Other columns
    are ignored.
    """
    machine = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, sample))

    def score(batches):
        begin_task("toxicity")
        for b in batches:
            s = machine.value.scores([t or "" for t in b.column(2).to_pylist()])
            yield pa.record_batch({"doc_id": b.column(0), "held_out": b.column(1), "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    rows = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("h"), docs["text"])
    return rows.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_harmless(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs, with its own columns, whatever their names, without those predicted toxic.

    Null and empty texts get the machine's bias, so they stay unless most learned rows are toxic; repeated rows stay or
    go together; all stay if nothing can be learned. Empty table: no rows.
    """
    machine = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, sample))
    at = docs.columns.index("text")

    def keep(batches):
        begin_task("toxicity")
        for b in batches:
            yield b.filter(pa.array(machine.value.scores([t or "" for t in b.column(at).to_pylist()]) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
