"""Language of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TextBuffer, begin_task, held_out, text_groups

WORD_BITS, GRAM_BITS = 18, 16
#: About so many documents of each language are learned from (those under a hash threshold), ...
SAMPLE = 500
#: ... and of these, in hash order, whole texts until all languages together have so many bytes; a language's first counts in any case.
SAMPLE_BYTES = 4_000_000
#: Learned texts are cut into windows of so many words, the last of a text may be shorter; none is left out.
WINDOW = 12
#: A training sequence is so many windows. In each pass every window is in one sequence of its language and one of any.
MIX = 4
#: Weights in all, languages times hash buckets, stay under 2^WEIGHT_BITS: beyond 32 languages the buckets get fewer.
WEIGHT_BITS = 23
#: The limits of so many languages are broadcast (under 10 MB); those of more meet the rows in a shuffle.
MOST_SENT = 100_000
LETTER = re.compile(r"[^\W\d_]")
_FLOOR = 1e-9


class Words:
    """Features of all words of some texts: lexicon (the word), affixes of 2 and 3 bytes, byte trigrams."""

    def __init__(self, texts: list[str], less: int = 0):
        """less: bits by which the hash spaces are smaller."""
        buf = TextBuffer(texts)
        a, e = buf.start, buf.end
        spots = ((a, e, 1), (a, np.minimum(a + 2, e), 2), (a, np.minimum(a + 3, e), 3), (np.maximum(e - 2, a), e, 4), (np.maximum(e - 3, a), e, 5))
        self.fixed = [(buf.h(s, t, k) >> np.uint64(64 - WORD_BITS + less)).astype(np.int32) for s, t, k in spots]
        x = np.where(TextBuffer._TABLE[buf.bytes], buf.bytes, 32).astype(np.uint32)
        gram = (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAM_BITS + less)).astype(np.int32)
        self.length = e - a
        self.gram = gram[_ragged(a, self.length) - 1]  # the trigram around each byte of a word
        self.first = buf.first

    def __len__(self) -> int:
        return len(self.length)

    @classmethod
    def joined(cls, parts: list[Words]) -> Words:
        out = object.__new__(cls)
        out.fixed = [np.concatenate(f) for f in zip(*(p.fixed for p in parts))]
        out.length, out.gram = np.concatenate([p.length for p in parts]), np.concatenate([p.gram for p in parts])
        ends = np.cumsum([0, *(len(p) for p in parts)])
        out.first = np.concatenate([[0], *(p.first[1:] + n for p, n in zip(parts, ends))])
        return out

    def take(self, at: np.ndarray, begin: np.ndarray) -> Words:
        """The words at these places; begin: where each word's trigrams begin."""
        out = object.__new__(Words)
        out.fixed = [f[at] for f in self.fixed]
        out.length = self.length[at]
        out.gram = self.gram[_ragged(begin[at], out.length)]
        return out


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (length of them) of each run, one run after the other."""
    return np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)


@dataclass
class LanguageField:
    """Emission weights by feature and language, and a transition matrix (rows: from, log scale)."""

    langs: list[str]
    word: np.ndarray
    gram: np.ndarray
    move: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """log scores (words, languages)."""
        e = sum(self.word[i] for i in w.fixed)
        if len(w):
            e = e + np.add.reduceat(self.gram[w.gram], np.cumsum(w.length) - w.length, axis=0)
        return e.astype(np.float64)

    @staticmethod
    def _passes(e: np.ndarray, t: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward and backward messages; e (sequences, steps, languages), t not in logs, live: the steps a sequence has."""
        n, steps, k = e.shape
        f, b = np.empty_like(e), np.ones_like(e)
        at = np.full((n, k), 1 / k)
        for i in range(steps):
            at = (at @ t) * e[:, i]
            at /= at.sum(1, keepdims=True)
            f[:, i] = at
        at = np.ones((n, k))
        for i in range(steps - 1, 0, -1):
            at = np.where(live[:, i, None], (at * e[:, i]) @ t.T, 1.0)
            at /= at.sum(1, keepdims=True)
            b[:, i - 1] = at
        return f, b

    @classmethod
    def fit(cls, langs: list[str], words: Words, sequences: list[np.ndarray], y: np.ndarray, less: int = 0, epochs: int = 2, rate: float = 0.3, batch: int = 128) -> LanguageField:
        """sequences: places of their words, each with one at least; y: language of each word. AdaGrad on the log-likelihood."""
        k = len(langs)
        m = cls(langs, np.zeros((1 << WORD_BITS - less, k), np.float32), np.zeros((1 << GRAM_BITS - less, k), np.float32), np.zeros((k, k), np.float32))
        sums = [np.full_like(x, 1e-2) for x in (m.word, m.gram, m.move)]
        begin = np.cumsum(words.length) - words.length
        eye = np.eye(k)
        for _ in range(epochs):
            for lo in range(0, len(sequences), batch):
                some = sequences[lo: lo + batch]
                size = np.array([len(q) for q in some])
                n, steps = len(some), int(size.max())
                live = np.arange(steps) < size[:, None]
                at = np.concatenate(some)
                part = words.take(at, begin)
                e = np.ones((n, steps, k))
                x = m.emissions(part)
                e[live] = np.exp(x - x.max(-1, keepdims=True)).clip(_FLOOR)
                t = np.exp(m.move - m.move.max()).astype(np.float64)
                f, b = cls._passes(e, t, live)
                post = f * b
                post /= post.sum(-1, keepdims=True)
                gold = eye[y[at]]
                d = (gold - post[live]) / n
                true = np.zeros((n, steps, k))
                true[live] = gold
                both = live[:, 1:]
                left, right = f[:, :-1][both], (e * b)[:, 1:][both]
                left = left / ((left @ t) * right).sum(-1, keepdims=True)
                moves = (true[:, :-1][both].T @ true[:, 1:][both] - t * (left.T @ right)) / n
                moves += t / t.sum(0) * (true[:, 0] - post[:, 0]).mean(0)  # a chain starts from any language alike
                m.move += cls._step(moves.astype(np.float32) - 1e-3 * m.move, sums[2], rate)
                for table, past, index, grad in ((m.word, sums[0], np.concatenate(part.fixed), np.tile(d, (len(part.fixed), 1))), (m.gram, sums[1], part.gram, np.repeat(d, part.length, axis=0))):
                    turn = np.argsort(index, kind="stable")
                    spot = np.flatnonzero(np.diff(index[turn], prepend=-1))
                    each = index[turn[spot]]
                    g = np.add.reduceat(grad.astype(np.float32)[turn], spot, axis=0)
                    held = past[each]
                    table[each] += cls._step(g, held, rate)
                    past[each] = held
        return m

    @staticmethod
    def _step(g: np.ndarray, past: np.ndarray, rate: float) -> np.ndarray:
        past += g * g
        return rate * g / np.sqrt(past)

    def posteriors(self, w: Words, block: int = 32) -> np.ndarray:
        """P(language) of every word, by forward-backward over each text's whole chain.

        Blocks of words are first multiplied up side by side, then the texts' blocks are joined in order, then the
        words inside all blocks are done side by side: the same result as word by word, in few array steps.
        """
        k, n = len(self.langs), len(w)
        if not n:
            return np.zeros((0, k))
        block = max(block, k)  # so the blocks' matrices stay as large as the words' scores
        e = self.emissions(w)
        e = np.exp(e - e.max(1, keepdims=True)).clip(_FLOOR)
        t = np.exp(self.move - self.move.max()).astype(np.float64)
        size = np.diff(w.first)
        blocks = -(-size // block)  # of each text
        of = np.repeat(np.arange(len(size)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = w.first[of] + nth * block
        length = np.minimum(block, w.first[of + 1] - begin)
        order = np.argsort(-length, kind="stable")  # full blocks first
        begin, length = begin[order], length[order]
        whole = np.tile(np.eye(k), (len(of), 1, 1))
        for s in range(block):
            live = int(np.searchsorted(-length, -s, "left"))
            x = (whole[:live].reshape(-1, k) @ t).reshape(live, k, k) * e[begin[:live] + s][:, None, :]
            whole[:live] = x / x.max((1, 2), keepdims=True) if s % 4 == 3 else x
        whole /= whole.max((1, 2), keepdims=True)
        place = np.empty(len(of), np.int64)
        place[order] = np.arange(len(of))
        first = np.cumsum(blocks) - blocks
        ranked = np.argsort(-blocks, kind="stable")
        counts = blocks[ranked]
        enter, leave = np.empty((len(of), k)), np.empty((len(of), k))
        at = np.full((len(size), k), 1 / k)
        for j in range(int(counts[0])):
            live = int(np.searchsorted(-counts, -j, "left"))
            spot = place[first[ranked[:live]] + j]
            enter[spot] = at[:live]
            x = np.einsum("nk,nkl->nl", at[:live], whole[spot])
            at[:live] = x / x.sum(1, keepdims=True)
        at = np.full((len(size), k), 1 / k)
        for j in range(int(counts[0]) - 1, -1, -1):
            live = int(np.searchsorted(-counts, -j, "left"))
            spot = place[first[ranked[:live]] + j]
            leave[spot] = at[:live]
            x = np.einsum("nkl,nl->nk", whole[spot], at[:live])
            at[:live] = x / x.sum(1, keepdims=True)
        f, b = np.empty((n, k)), np.empty((n, k))
        at = enter
        for s in range(block):
            live = int(np.searchsorted(-length, -s, "left"))
            x = (at[:live] @ t) * e[begin[:live] + s]
            at[:live] = x = x / x.sum(1, keepdims=True)
            f[begin[:live] + s] = x
        at = leave
        for s in range(block - 1, -1, -1):
            live = int(np.searchsorted(-length, -s, "left"))
            b[begin[:live] + s] = at[:live]
            x = (at[:live] * e[begin[:live] + s]) @ t.T
            at[:live] = x / x.sum(1, keepdims=True)
        post = f * b
        return post / post.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its mean probability over the words of each text; und and 0 if null or without a letter."""
        plain = [t or "" for t in texts]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        for lo, hi in text_groups(plain):
            w = Words(plain[lo:hi], WORD_BITS - int(math.log2(len(self.word))))
            post = self.posteriors(w)
            some = np.flatnonzero(np.diff(w.first))
            if not len(some):
                continue
            mean = np.add.reduceat(post, w.first[some], axis=0) / np.diff(w.first)[some][:, None]
            best = mean.argmax(1)
            for i, c, m in zip(some + lo, best, mean):
                if LETTER.search(plain[i]):
                    lang[i], score[i] = self.langs[c], min(1.0, m[c])
        return lang, score


def fit_language(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = 0) -> LanguageField:
    """Learns from text and lang of rows that aren't held out and have both; lang is the label of each word of a row.

    Every lang value whose sampled rows hold a word is learned, short texts and unspaced ones too, each sampled text whole.
    """
    known = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"])).select(F.xxhash64(docs["doc_id"], F.lit(seed)).alias("h"), docs["lang"].alias("lang"), docs["text"].alias("text"))
    counts = known.groupBy("lang").count().collect()  # a row a language
    limits = docs.sparkSession.createDataFrame([(r[0], int(min(1, sample / r[1]) * (1 << 30))) for r in counts], "l string, most long")
    limits = F.broadcast(limits) if len(counts) <= MOST_SENT else limits
    picked = known.join(limits, F.col("lang") == F.col("l")).where(F.pmod("h", F.lit(1 << 30)) < F.col("most"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1))
    share = sample_bytes / max(1, len(counts))
    rows = picked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < share).select("h", "lang", "text").collect()
    return learn([r[2] for r in sorted(rows)], [r[1] for r in sorted(rows)], seed)


def learn(texts: list[str], labels: list[str], seed: int = 0) -> LanguageField:
    """A field from whole texts and the language of each; languages without a word are left out."""
    less = max(0, math.ceil(math.log2(max(1, len(set(labels)))) + WORD_BITS - WEIGHT_BITS))
    parts = [Words(texts[lo:hi], less) for lo, hi in text_groups(texts)]
    words = Words.joined(parts) if parts else None
    size = np.diff(words.first) if parts else np.zeros(0, int)
    langs = sorted({c for c, n in zip(labels, size) if n})
    if not langs:
        return LanguageField([], np.zeros((1 << WORD_BITS, 0), np.float32), np.zeros((1 << GRAM_BITS, 0), np.float32), np.zeros((0, 0), np.float32))
    code = {c: i for i, c in enumerate(langs)}
    y = np.repeat([code.get(c, 0) for c in labels], size)
    windows = [np.arange(a, min(a + WINDOW, e)) for s, e in zip(words.first[:-1], words.first[1:]) for a in range(s, e, WINDOW)]
    of = np.array([y[w[0]] for w in windows])
    rng = np.random.default_rng(seed)
    sequences = []
    for pool in [*(np.flatnonzero(of == c) for c in range(len(langs))), np.arange(len(windows))]:
        pool = rng.permutation(pool)
        sequences += [np.concatenate([windows[i] for i in pool[a: a + MIX]]) for a in range(0, len(pool), MIX)]
    sequences = [sequences[i] for i in rng.permutation(len(sequences))]
    return LanguageField.fit(langs, words, sequences, y, less)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its whole text alone.

    Null text or none with a letter: und, score 0; so are all if no row can be learned from. On a tie the language
    first in order wins. Repeated rows get the same; a null doc_id counts as held out. A very long text is read whole,
    by itself. Ids of any type. Empty table: no rows. Other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit_language(docs, sample))

    def name(batches):
        begin_task("language")
        for b in batches:
            lang, score = field.value.predict(b.column(2).to_pylist())
            yield pa.record_batch({"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": pa.array(lang, pa.string()), "score": score})

    rows = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("h"), docs["text"])
    return rows.mapInArrow(name, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_known_language(docs: DataFrame, least: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """docs, with its own columns, whatever their names, without those of no language: und, or a score under `least`.

    Null, empty and letterless texts go; if no row can be learned from, all go. Repeated rows stay or go together.
    Empty table: no rows.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit_language(docs, sample))
    at = docs.columns.index("text")

    def keep(batches):
        begin_task("language")
        for b in batches:
            lang, score = field.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array((np.array(lang) != "und") & (score >= least)))

    return docs.mapInArrow(keep, docs.schema)
