"""N-best SentencePiece segmentation: forward Viterbi scores as exact heuristics of a backward A* search."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_groups

SPACE = "▁"
#: Segments kept by one worker; at this many the cache starts anew.
CACHE_SEGMENTS = 800_000
#: A byte piece costs so much more than the worst ordinary piece: bytes only where no piece fits.
BYTE_PENALTY = 10.0
#: Scores under this mark pieces that training never ranked; they count like the worst ranked one.
RESERVED = -1e8
#: Segments up to this length are learned many at a time, so many a step; longer ones and small rests one by one.
STEP_CHARS, STEP_SEGMENTS, LEAST_STEP = 40, 4096, 48
LETTERS = r"[A-Za-z\u00c0-\u024f]"
_RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")

_models: dict[tuple[str, int], PieceModel] = {}


class Trie:
    """The pieces' beginnings as states (0: none yet), followed by many characters in one step.

    Steps (state, character) are in a table by a hash; those whose place is taken are in a sorted list.
    """

    _BITS, _MIX = 20, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, prefix: dict[str, tuple | None]):
        state = {"": 0} | {p: i for i, p in enumerate(sorted(prefix), 1)}
        #: id of the piece that a state is, or -1
        self.piece = np.full(len(state), -1, np.int32)
        keys, to = np.empty(len(prefix), np.int64), np.empty(len(prefix), np.int32)
        for k, (p, hit) in enumerate(prefix.items()):
            keys[k], to[k] = state[p[:-1]] << 21 | ord(p[-1]), state[p]
            if hit:
                self.piece[state[p]] = hit[1][0]
        self.longest = max(map(len, prefix), default=1)
        self.keys, self.to = np.full(1 << self._BITS, -1, np.int64), np.zeros(1 << self._BITS, np.int32)
        at = self._place(keys)
        self.keys[at], self.to[at] = keys, to
        rest = np.flatnonzero(self.keys[at] != keys)
        rest = rest[np.argsort(keys[rest])]
        self.rest, self.rest_to = np.append(keys[rest], np.iinfo(np.int64).max), np.append(to[rest], 0)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self._MIX >> np.uint64(64 - self._BITS)).view(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after one more character, 0 where no piece begins so."""
        keys = state.astype(np.int64) << 21 | char
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.to[at], 0)
        other = np.flatnonzero((held != keys) & (held >= 0))
        found = np.searchsorted(self.rest, keys[other])
        same = self.rest[found] == keys[other]
        out[other[same]] = self.rest_to[found[same]]
        return out


class PieceModel:
    """Pieces, their scores and byte pieces of a SentencePiece model without text normalisation.

    A text is written with a mark in front and marks for its spaces. A segmentation's score is the sum of its pieces'
    scores. No piece holds a mark after another character (else texts aren't cut), so a text's segments, each a run of
    marks and what follows, are independent, and each distinct one is searched once.
    """

    def __init__(self, path: str, n: int):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.n, self.text, self.piece, self.byte = n, [], {}, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            self.text.append(b"" if sp.is_control(i) else p.replace(SPACE, " ").encode())
            if sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[p] = (sp.get_score(i), (i,))
        self.byte_id = np.array([self.byte.get(b, -2) for b in range(128)], np.int32)
        usual = min((s for s, _ in self.piece.values() if s > RESERVED), default=0.0)
        self.piece = {p: (max(s, usual), i) for p, (s, i) in self.piece.items()}
        self.byte_score = usual - BYTE_PENALTY
        #: every beginning of a piece: the piece's score and id, or None if it isn't a piece itself
        self.prefix = {p[:k]: self.piece.get(p[:k]) for p in self.piece for k in range(1, len(p) + 1)}
        self.trie = Trie(self.prefix)
        self.score = np.full(len(self.text), float("-inf"))
        for score, (i,) in self.piece.values():
            self.score[i] = score
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        # places inside a segment that no piece spans: before such a mark after a letter, and around line breaks
        closers = "".join(c for c in ".,;:!?" if not any(re.search(LETTERS + re.escape(c), p) for p in self.piece))
        around = r"|(?<=\n)|(?=\n)" if not any("\n" in p for p in self.piece) else ""
        self.joints = re.compile((f"(?<={LETTERS})(?=[{re.escape(closers)}])" if closers else r"(?!)") + around)
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.piece)
        self.known: dict[str, tuple[float, bytes, float]] = {}

    def _forward(self, s: str, into: list[list] | None = None) -> tuple[list[float], float, tuple[int, ...]]:
        """The best score of each prefix, how far the second best way is, the best ids; into gets the lattice's edges by their end."""
        size, get = len(s), self.prefix.get
        low = float("-inf")
        best, second, back = [low] * (size + 1), [low] * (size + 1), [None] * (size + 1)
        best[0] = 0.0
        for a in range(size):
            at, next_at = best[a], second[a]
            one = e = a + 1
            while e <= size:
                hit = get(s[a:e], 0)
                if hit == 0 and e > one:
                    break
                if not hit and e == one:  # no piece for the character itself
                    stop = hit == 0
                    raw = s[a].encode("utf-8", "surrogatepass")
                    hit = self.byte_score * len(raw), tuple([self.byte[b] for b in raw])
                else:
                    stop = False
                if hit:
                    score = at + hit[0]
                    held = best[e]
                    if score > held:
                        two = next_at + hit[0]
                        best[e], second[e], back[e] = score, held if held > two else two, (a, hit[1])
                    elif score > second[e]:
                        second[e] = score
                    if into is not None:
                        into[e].append((a, *hit))
                if stop:
                    break
                e += 1
        ids, e = [], size
        while e:
            e, part = back[e]
            ids.append(part)
        return best, best[size] - second[size], tuple([i for part in reversed(ids) for i in part])

    def search(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of s, best first: A* from the end of s, bounded exactly by the forward scores.

        Of equal scores the forward pass's own way is first, then as the search reaches them.
        """
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(s) + 1)]
        best, _, first = self._forward(s, into)
        out, turn = [], 0
        heap: list = [(-best[len(s)], 0, len(s), 0.0, None)]  # bound, order, position, score behind, path behind
        while heap and len(out) < n:
            bound, _, at, behind, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((-bound, tuple(ids)))
                continue
            for a, score, ids in into[at]:
                turn += 1
                heapq.heappush(heap, (-(best[a] + score + behind), turn, a, score + behind, (ids, path)))
        if out[0][1] != first:
            out = [(out[0][0], first), *(x for x in out if x[1] != first)][:n]
        return out

    def _learn(self, s: str) -> tuple[float, bytes, float]:
        """Score and ids of the best, distance to the second best; from the segment's parts where no piece spans a place."""
        parts = [s] if s[1:].isalpha() else [p for p in self.joints.split(s) if p]
        if len(parts) > 1:
            return self._join(s, [self.known.get(p) or self._learn(p) for p in parts])
        best, gap, ids = self._forward(s)
        self.known[s] = out = (best[-1], array("i", ids).tobytes(), gap)
        return out

    def learn_many(self, segments: set[str]) -> None:
        """What _learn learns, of all new ones among the segments, with one forward pass over many at a time."""
        known, plain, made = self.known, set(), []
        for s in segments:
            if s in known:
                continue
            if not s[1:].isalpha():
                parts = [p for p in self.joints.split(s) if p]
                if len(parts) > 1:
                    made.append((s, parts))
                    plain.update(parts)
                    continue
            plain.add(s)
        plain = [s for s in plain if s not in known]
        short = sorted([s for s in plain if len(s) <= STEP_CHARS], key=len)
        for k in range(0, len(short), STEP_SEGMENTS):
            some = short[k: k + STEP_SEGMENTS]
            if len(some) >= LEAST_STEP:
                self._forward_many(some)
        for s in plain:
            if s not in known:
                self._learn(s)
        for s, parts in made:
            self._join(s, [known[p] for p in parts])

    def _join(self, s: str, found: list[tuple[float, bytes, float]]) -> tuple[float, bytes, float]:
        self.known[s] = out = (sum([f[0] for f in found]), b"".join([f[1] for f in found]), min([f[2] for f in found]))
        return out

    def _forward_many(self, segments: list[str]) -> None:
        """_forward over segments side by side, place by place; those with bytes of a longer character are left out.

        Rows are places in the segment, columns are segments; what stands behind a segment's end is not read.
        """
        n, sizes = len(segments), np.fromiter(map(len, segments), np.int64, len(segments))
        width, column = int(sizes.max()), np.arange(len(segments))
        flat = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        char = np.zeros((width, n), np.int64)
        char[at, np.repeat(column, sizes)] = flat
        char = char.ravel()
        deepest = min(width, self.trie.longest)
        ids = np.full((deepest + 1, width * n), -1, np.int32)
        start, state = np.arange(width * n), np.zeros(width * n, np.int32)
        for d in range(1, deepest + 1):
            state = self.trie.step(state, char[start + (d - 1) * n])
            alive = state > 0
            start, state = start[alive], state[alive]
            ids[d, start] = self.trie.piece[state]
            inside = start + d * n < width * n
            start, state = start[inside], state[inside]
        scores = np.where(ids >= 0, self.score[ids], -np.inf)
        raw = np.flatnonzero(ids[1] < 0)
        scores[1, raw] = self.byte_score * (1 + (char[raw] > 0x7F) + (char[raw] > 0x7FF) + (char[raw] > 0xFFFF))
        ids[1, raw] = np.where(char[raw] < 128, self.byte_id[char[raw] & 127], -2)
        ids, scores = ids.reshape(-1, width, n), scores.reshape(-1, width, n)
        some = (ids != -1).any(axis=2)
        best, second = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        back = np.zeros((width + 1, n), np.int64)
        best[0] = 0.0
        for e in range(1, width + 1):
            b, t, from_ = best[e], second[e], back[e]
            for d in range(min(e, deepest), 0, -1):
                if not some[d, e - d]:
                    continue
                score = best[e - d] + scores[d, e - d]
                better = score > b
                t[:] = np.where(better, np.maximum(b, second[e - d] + scores[d, e - d]), np.maximum(t, score))
                from_[better] = d
                np.maximum(b, score, out=b)
        token, place, live = np.full((n, width), -1, np.int32), sizes.copy(), column
        while len(live):
            d = back[place[live], live]
            place[live] -= d
            token[live, place[live]] = ids[d, place[live], live]
            live = live[place[live] > 0]
        whole = ~(token == -2).any(axis=1)
        last = np.cumsum((token >= 0).sum(axis=1)) * 4
        data = token[token >= 0].astype("<i4").tobytes()
        total = best[sizes, column]
        gap = total - second[sizes, column]
        for s, ok, f, a, z, g in zip(segments, whole.tolist(), total.tolist(), [0, *last[:-1].tolist()], last.tolist(), gap.tolist()):
            if ok:
                self.known[s] = (f, data[a:z], g)

    def _choices(self, s: str) -> list[tuple[float, bytes]]:
        """Loss and ids of the n best of a segment."""
        found = self.search(s, self.n)
        return [(found[0][0] - f, array("i", ids).tobytes()) for f, ids in found]

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            return [SPACE + text.replace(" ", SPACE)]
        parts = text.split(" ")
        if "" in parts or SPACE in text:
            return _RUN.findall(SPACE + text.replace(" ", SPACE))
        return [SPACE + p for p in parts]

    def nbest(self, text: str) -> list[tuple[float, bytes]]:
        """Up to n segmentations of a whole text as (score, ids as 32-bit integers), best first.

        Segments are independent, so only the n - 1 whose second choice costs least can differ from their best.
        """
        return [(score, b"".join(spans)) for score, spans in self.nbest_of([text])[0]]

    def nbest_of(self, texts: list[str]) -> list[list[tuple[float, list[bytes]]]]:
        """nbest of each text, ids in spans that a text's segmentations share; the segments of all are learned together."""
        if len(self.known) > CACHE_SEGMENTS:
            self.known = {}
        cuts = [self.segments(t) for t in texts]
        self.learn_many(set().union(*cuts))
        return [self._nbest(cut) for cut in cuts]

    def _nbest(self, cut: list[str]) -> list[tuple[float, list[bytes]]]:
        if not cut:
            return [(0, [])]
        scores, ids, gaps = zip(*map(self.known.__getitem__, cut))
        score = sum(scores)
        if self.n == 1:
            return [(score, [b"".join(ids)])]
        gap = np.array(gaps)
        some = np.argsort(gap, kind="stable")[: self.n - 1] if len(gap) < 64 else np.argpartition(gap, self.n - 2)[: self.n - 1]
        some = sorted(some.tolist()) if len(gap) >= 64 else some.tolist()
        ways = {i: self._choices(cut[i]) for i in some}
        best: list[tuple[float, tuple]] = [(0.0, ())]
        for i, choices in ways.items():
            best = sorted((loss + g, (*chosen, (i, k))) for loss, chosen in best for k, (g, _) in enumerate(choices))[: self.n]
        places = sorted(ways)
        between = [b"".join(ids[a:z]) for a, z in zip([0, *(i + 1 for i in places)], [*places, len(ids)])]
        out = []
        for nth, (loss, chosen) in enumerate(best):
            pick = dict(chosen)
            spans = [between[0]]
            for i, after in zip(places, between[1:]):
                spans += (ways[i][pick[i]][1] if nth else ids[i], after)
            out.append((score - loss if nth else score, spans))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: marks become spaces, the mark in front goes, byte pieces join to UTF-8 (wrong bytes: U+FFFD)."""
        return self.decode_spans([ids], {})

    def decode_spans(self, spans: list[bytes], known: dict[bytes, bytes]) -> str:
        """The text of the spans' ids in a row; known keeps what each span stands for, for others that share it."""
        for ids in spans:
            if ids not in known:
                known[ids] = b"".join(map(self.text.__getitem__, array("i", ids)))
        return b"".join(map(known.__getitem__, spans))[1:].decode("utf-8", "replace")


def piece_model(path: str, n: int) -> PieceModel:
    if (path, n) not in _models:
        _models[path, n] = PieceModel(path, n)
    return _models[path, n]


def segment_nbest(docs: DataFrame, model: str, n: int = 4, with_ids: bool = True) -> DataFrame:
    """doc_id, rank (from 1), score, n_tokens, ids_crc32, decoded_crc32 and, with_ids, ids: the n best segmentations.

    ids_crc32: of the ids as little-endian 32-bit integers; decoded_crc32: of the decoded text in UTF-8. A text with
    fewer segmentations has fewer rows. Null and empty texts have one, without ids, of score 0. Repeated rows and null
    ids are documents of their own. Empty table: no rows. A very long text is segmented whole; of
    equal scores the forward pass's own way is first, then as the search reaches them. Other columns are ignored.
    """
    def work(batches):
        m = piece_model(model, n)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in text_groups(texts, 2_000_000):
                row, rank, score, size, crc, text, ids = ([] for _ in range(7))
                for i, ways in zip(range(lo, hi), m.nbest_of(texts[lo:hi])):
                    told: dict[bytes, bytes] = {}
                    for r, (s, spans) in enumerate(ways, 1):
                        raw = b"".join(spans)
                        row.append(i)
                        rank.append(r)
                        score.append(s)
                        size.append(len(raw) // 4)
                        crc.append(zlib.crc32(raw))
                        text.append(zlib.crc32(m.decode_spans(spans, told).encode()))
                        if with_ids:
                            ids.append(np.frombuffer(raw, np.int32))
                out = {"doc_id": b.column(0).take(pa.array(row, pa.int32())), "rank": pa.array(rank, pa.int32()), "score": pa.array(score, pa.float64()), "n_tokens": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "decoded_crc32": pa.array(text, pa.int64())}
                yield pa.record_batch(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(work, f"doc_id {kind}, rank int, score double, n_tokens long, ids_crc32 long, decoded_crc32 long" + ", ids array<int>" * with_ids)
