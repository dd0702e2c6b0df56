"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import io
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streetloom.llm import common, components, embeddings, exact, language, packing, pieces, sharding, simhash, token_files, tokens, toxicity, urls
from streetloom.llm.cqf import CountingQuotientFilter
from streetloom.llm.tokens import Encoder

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, piece string, fp string"
LONG = "the quick brown fox jumps over the lazy dog and runs away from it all. " * 400
TEXTS = [(1, "a b c d e"), (2, " a b\tc d e"), (3, None), (4, ""), (5, " \n"), (6, LONG), (7, LONG + " End"), (8, "12 34"), (8, "12 34"), (None, "né  à la carte"), (9, "a  b\u00a0c "), (10, "x" * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if t else None, "s", 0, "k", "p", "f") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_encoder_is_the_library():
    texts = ["", " ", "a", " a ", "a  b", "\n\na b", "don't 's", "x <|endoftext|> y", "a\x1c b", "é\u00a0 f", LONG]
    assert [e + b"\2\0\0\0" for e in Encoder(BPE).encode(texts)] == [ids_of(t) for t in texts]
    assert len(ids_of("hello <|endoftext|> world")) == 4 * 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "word", "\n", "é", "<|", "endoftext|>", "  ", "1"]), max_size=8), max_size=5))
def test_encoder_with_added_tokens(texts):
    texts = ["".join(t) for t in texts]
    enc = test_encoder_with_added_tokens.__dict__.setdefault("enc", Encoder(BPE))
    assert [e + b"\2\0\0\0" for e in enc.encode(texts)] == [ids_of(t) for t in texts]


class _Counted:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, model):
        self.own, self.texts = model, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.own.encode_batch_fast(texts, **more)


def test_known_words_with_marks_are_not_encoded_again():
    enc = Encoder(BPE)
    enc.encode(["Anders eder, \u00e9der onthe. Onthe", "on.\neder"])
    for name in {"model", "words"} & vars(enc).keys():
        setattr(enc, name, _Counted(getattr(enc, name)))
    texts = ["Anders onthe, eder. onthe.\neder, \u00e9der.", "on eder\neder"]
    assert [e + b"\2\0\0\0" for e in enc.encode(texts)] == [ids_of(t) for t in texts]
    assert not {w for name in {"model", "words"} & vars(enc).keys() for t in getattr(enc, name).texts for w in re.findall(r"\w+", t.replace("\u0120", " "))} & {"eder", "onthe", "\u00e9der"}


def test_encoder_on_odd_words():
    """Marks, line breaks and letters in any order, in a cache that forgets early."""
    some = [" ", " ", " ", "\n", "a", "word", "Eder", "\u00e9t\u00e9", "\u00df", "\u00d7", "\u0250", ".", ",", "!", "?", ":", "'s", "don't", "12", "\u00a0", "\t", "\r", "\x1c", "\u4e2d", "\U0001f600", "\u0301", "\u0120", "-", "<|endoftext|>"]
    rng, enc = np.random.default_rng(3), Encoder(BPE)
    for _ in range(500):
        enc.limit = int(rng.choice([2, 10, 1000]))
        texts = ["".join(rng.choice(some, rng.integers(0, 15))) for _ in range(rng.integers(0, 7))]
        assert [np.frombuffer(e, "<u4").tolist() for e in enc.encode(texts)] == [enc.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_worker_lets_go_of_other_operators():
    """A worker goes from stage to stage of the pipeline: the encoder's cache must not stay while others work."""
    import weakref

    enc = tokens.encoder(BPE)
    assert tokens.encoder(BPE) is enc
    held = weakref.ref(enc)
    del enc
    common.begin_task("language")
    assert held() is None


def test_stages_let_go_of_what_the_driver_keeps(spark, docs):
    """The driver goes through all stages too: neither Python's tables nor the JVM's garbage may stay for the next stage."""
    import gc
    import corpus_pipeline

    common.TextBuffer(["a" * 100])
    assert len(common.TextBuffer._pow) > 1
    jvm = spark.sparkContext._jvm
    thing = jvm.java.lang.Object()
    held = jvm.java.lang.ref.WeakReference(thing)
    del thing
    gc.collect()
    corpus_pipeline.best_fit_packing(spark, docs, "")
    assert len(common.TextBuffer._pow) == 1
    assert held.get() is None


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, BPE, 64).collect()
    want = sorted((i or -1, len(b := ids_of(t)) // 4, zlib.crc32(b)) for i, t in TEXTS)
    assert sum(r.length for r in rows) == sum(w[1] for w in want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.piece == 0 or r.length == 64
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(empty, BPE, 64).count() == 0


def test_packed_pieces_are_the_documents_ids(docs):
    """start, length and crc32 of every piece against the whole ids cut by hand, and sequences against the least number possible."""
    rows = packing.pack_documents(docs, BPE, 64).collect()
    want = []
    for i, t in TEXTS:
        raw = ids_of(t)
        n, at = len(raw) // 4, 0
        size = (n - 1) % 64 + 1
        while at < n:
            want.append((i, at, size, zlib.crc32(raw[4 * at: 4 * (at + size)])))
            at, size = at + size, 64
    none = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(none((r.doc_id, r.start, r.length, r.ids_crc32)) for r in rows) == sorted(map(none, want))
    pieces_of = {}
    for r in rows:
        pieces_of.setdefault((r.doc_id, r.start), set()).add(r.piece)
    assert all(r.piece == -(-r.start // 64) for r in rows)
    least = -(-sum(r.length for r in rows) // 64)
    assert least <= len({r.sequence_id for r in rows}) <= least + 1


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 40), st.lists(st.integers(1, 40), max_size=60))
def test_plan_holds_all_items(capacity, sizes):
    count = np.bincount([min(s, capacity) for s in sizes], minlength=capacity + 1)
    used = np.zeros(capacity + 1, int)
    for n, b in packing.plan_bins(count, capacity):
        assert sum(b) <= capacity
        for s in b:
            used[s] += n
    assert (used == count).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(2, 9), min_size=1, max_size=7))
def test_dominated_sets_keep_the_optimum(sizes):
    def least(items):
        best = len(items)
        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= 10:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1:]])
            go(i + 1, [*bins, items[i]])
        go(0, [])
        return best
    count = np.bincount(sizes, minlength=11)
    fixed = packing.reduce_dominated(count, 10)
    rest = [s for s in range(11) for _ in range(count[s])]
    assert sum(n for n, _ in fixed) + least(rest) == least(sizes)


def test_token_files(docs, empty):
    got = sorted(map(tuple, token_files.token_output(docs, BPE).collect()), key=lambda r: r[1])
    order = sorted(TEXTS, key=lambda r: -1 if r[0] is None else r[0])
    at = 0
    for (i, start, n, crc), (j, t) in zip(got, order, strict=True):
        raw = ids_of(t)
        assert (i, start, n, crc) == (j, at, len(raw) // 4, zlib.crc32(raw))
        at += n
    assert token_files.token_output(empty, BPE).count() == 0


def test_token_file_damage():
    out = io.BytesIO()
    w = token_files.Writer(out, frame_bytes=64)
    for i in range(20):
        w.add(i, np.arange(i, dtype="<u4").tobytes())
    w.close()
    raw = bytearray(out.getvalue())
    r = token_files.Reader(io.BytesIO(bytes(raw)), len(raw))
    assert [len(r.ids(i)) // 4 for i in range(20)] == list(range(20)) and len(r.table) > 3
    raw[int(r.begin[2]) + 8] ^= 255
    r = token_files.Reader(io.BytesIO(bytes(raw)), len(raw))
    assert bytes(r.ids(1)) == np.arange(1, dtype="<u4").tobytes()
    with pytest.raises(Exception):
        r.read_frame(2)


def test_sharding(docs, empty):
    rows = sharding.shard_rows(docs, 4).collect()
    assert len(rows) == len(TEXTS)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS}
    assert sharding.shard_rows(empty, 4).count() == 0


def test_shards_are_the_highest_scores(spark):
    """The winner of each key by hand: md5 and a logarithm, weighted, with one more shard too."""
    def winner(key, weights):
        def score(k):
            u = (int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return -weights[k] / math.log(u)
        return max(range(len(weights)), key=lambda k: (score(k), -k))

    d = spark.createDataFrame([(i, "x") for i in range(300)] + [(None, "x")], "doc_id long, text string")
    for weights in ([1.0] * 8, [1.0, 3.0, 0.5]):
        for r in sharding.shard_rows(d, weights).collect():
            key = "" if r.doc_id is None else r.doc_id
            assert (r.shard, r.grown_shard) == (winner(key, weights), winner(key, [*weights, 1.0]))


def test_shard_weights(spark):
    d = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    n = {r[0]: r[1] for r in sharding.shard_rows(d, [1, 3]).groupBy("shard").count().collect()}
    assert abs(n[1] / 4000 - 0.75) < 0.03


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(size=16) * (0.03 if i % 3 else 0.2)).tolist(), i % 2) for i in range(200)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] + [1.0] * 15, 0), (205, rows[1][1], None), (206, [1.0, None], 0), (207, [1e300] * 16, 0), (208, [1e-300] * 16, 0), (209, [], 1)]
    return rows


@pytest.mark.parametrize("block_rows", [embeddings.BLOCK_ROWS, 7])
def test_embeddings(spark, block_rows):
    rows = vectors()
    got = {r.vec_id: r for r in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98, block_rows).collect()}
    ok = {i: np.array(e) / np.max(np.abs(e)) for i, e, lab in rows if lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e)}
    label = {r[0]: r[2] for r in rows}
    link = {i: {j for j in ok if j != i and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.98 * np.linalg.norm(ok[i]) * np.linalg.norm(ok[j])} for i in ok}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in link.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(link.get(i, ())), min(seen), i == min(seen)), i


def test_embeddings_in_cells():
    """Vectors over many cells and bands: pairs found against all pairs, at cosines from 0.98 on."""
    rng = np.random.default_rng(8)
    n, dims = 6000, 64
    base = rng.normal(size=(n, dims))
    base[n // 2:] = base[: n // 2] / np.linalg.norm(base[: n // 2], axis=1, keepdims=True) + rng.normal(size=(n // 2, dims)) * rng.uniform(0.2, 0.206, (n // 2, 1)) / 8
    unit = embeddings._unit(base)
    many, bits = embeddings.bands(n * 20, 0.98)  # as many bits as a label of 120,000 has
    cells = (unit @ embeddings.directions(dims, many * bits, 11) > 0).reshape(n, many, bits) @ (1 << np.arange(bits))
    p, half = unit @ embeddings.directions(dims, embeddings.PROJECTIONS, 7), embeddings.half_window(0.98, dims)
    found, compared = [], 0
    for band in range(many):
        for c in np.unique(cells[:, band]):
            at = np.flatnonzero(cells[:, band] == c)
            compared += len(at) ** 2
            sums, *_ = embeddings._meet(unit[at], p[at], cells[at], np.ones(len(at), np.int64), np.zeros(len(at), np.int64), band, half, 0.98)
            found.append(np.repeat(at, sums))
    links = np.bincount(np.concatenate(found), minlength=n)
    true = (unit @ unit.T >= 0.98).sum(1) - 1
    assert true.sum() > 2000 and (links <= true).all() and links.sum() >= 0.999 * true.sum()
    assert compared < 0.05 * n * n


def test_embeddings_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string, hash long, cls string, band int, n long, low long"
    rows = [(1, [1.0, 0.0], "x", 1, "c", 0, 0, 0), (1, [1.0, 0.0], "x", 1, "c", 0, 0, 0), (2, [2.0, 0.0], "x", 1, "c", 0, 0, 0), (3, [0.0, 1.0], "x", 1, "c", 0, 0, 0), (4, [1.0, 0.0], "y", 1, "c", 0, 0, 0), (5, [1.0, 0.0, 0.0], "x", 1, "c", 0, 0, 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.link_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    assert embeddings.link_vectors(spark.createDataFrame([], schema)).count() == 0


def test_components_by_shuffles(spark):
    rng = np.random.default_rng(0)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(12)] + [(None, 1)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(e, "a long, b long"), local_edges=0).collect()}
    root = {x: x for p in e if None not in p for x in p}
    for _ in root:
        for a, b in e:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] and None not in p for p in e)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12))
def test_nbest_is_brute_force(units):
    m = test_nbest_is_brute_force.__dict__.setdefault("m", pieces.PieceModel(PIECES, 4))
    s = pieces.SPACE + "".join({1: "th", 2: "e", 3: "in", 4: "g", 5: "ñ", 6: "日"}[u] for u in units)[:9]
    found = []
    def go(i, score):
        if i == len(s):
            found.append(score)
            return
        single = False
        for e in range(i + 1, len(s) + 1):
            if s[i:e] in m.piece:
                single |= e == i + 1
                go(e, score + m.piece[s[i:e]][0])
        if not single:
            go(i + 1, score + m.byte_score * len(s[i].encode()))
    go(0, 0.0)
    best = m.nbest(s[1:]) if len(s) > 1 else []
    assert [x for x, _ in best] == sorted(found, reverse=True)[:4] or len(s) == 1
    assert all(m.decode(ids) == s[1:] for _, ids in best)


def test_segment_nbest(docs, empty):
    rows = pieces.segment_nbest(docs, PIECES, 3).collect()
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.decoded_crc32 in {zlib.crc32((t or "").encode()) for i, t in TEXTS if i == r.doc_id}
    assert sum(r["rank"] == 1 for r in rows) == len(TEXTS)
    assert pieces.segment_nbest(empty, PIECES, 3).count() == 0


def test_toxicity(spark, docs, empty):
    rows = [(i, ("you awful zork " if i % 4 == 0 else "you kind soul ") + f"word{i % 7} text", int(i % 4 == 0)) for i in range(600)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, labels).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.keep_harmless(d, labels).count() == 450
    scores = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(scores) == len(TEXTS) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_interactions_are_learned():
    """Toxic if both or neither of two words stand in a text: no word tells the classes apart by itself."""
    rng, texts, y = np.random.default_rng(0), [], []
    for i in range(4000):
        texts.append(" ".join([*(f"f{j}" for j in rng.integers(0, 300, 12)), *(["insult"] if i % 4 in (0, 1) else []), *(["group"] if i % 4 in (0, 2) else [])]))
        y.append(int(i % 4 in (0, 3)))
    m = toxicity.FactorizationMachine.fit(list(toxicity._buckets(texts[:3000])), np.array(y[:3000]), np.ones(3000), epochs=30, vrate=0.005)
    assert ((m.scores(texts[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    words = toxicity.FactorizationMachine(m.slot, m.w0, m.w, np.zeros_like(m.v))
    assert ((words.scores(texts[3000:]) >= 0.5) == y[3000:]).mean() < 0.6


def test_machine_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    texts = ["", "you awful zork", "zork zork you", "kind soul " * 40]
    found = [set(b.tolist()) for b in toxicity._buckets(texts)]
    terms = sorted(set().union(*found))
    slot = np.full(1 << toxicity.BITS, -1, np.int32)
    slot[terms[1:]] = np.arange(len(terms) - 1)  # one term is unknown
    m = toxicity.FactorizationMachine(slot, -0.3, rng.normal(size=len(terms) - 1), rng.normal(size=(len(terms) - 1, toxicity.FACTORS)))
    for score, f in zip(m.scores(texts), found):
        t = [int(slot[b]) for b in f if slot[b] >= 0]
        z = m.w0 + sum(m.w[i] for i in t) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(t, 2))
        assert abs(score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score_toxicity(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.9 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.01


def test_toxicity_keeps_odd_rows(spark):
    rows = [(f"i{k}", "you awful zork" if k % 4 == 0 else "you kind soul", "x", 1) for k in range(200)]
    odd = [(None, "you kind soul", "x", 1), ("e", None, "x", 1), ("e", "", "x", 1), ("e", "", "x", 1), ("long", "kind soul " * 30000, "x", 1), ("long2", "awful zork " * 30000, "x", 1)]
    d = spark.createDataFrame(rows + odd, "doc_id string, text string, score string, predicted int")
    labels = spark.createDataFrame([(r[0], int(r[1] == "you awful zork")) for r in rows], "doc_id string, toxic int")
    kept = toxicity.keep_harmless(d, labels)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or "", r.text or "") for r in kept.collect()) == sorted((i or "", t or "") for i, t, *_ in rows + odd if "awful" not in (t or ""))


def test_simhash(spark, docs, empty):
    base = [f"w{i}" for i in range(300)]
    more = [(100 + k, " ".join([*base[:150 + k], "changed", *base[151 + k:]]).upper(), None, None, 0, "", "", "") for k in range(12)]
    d = docs.union(spark.createDataFrame(more, SCHEMA))
    texts = [*TEXTS, *((r[0], r[1]) for r in more)]
    fps = [simhash.fingerprint(t or "") for _, t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    want = sorted((str(i), f"{f:016x}", str(min((texts[j][0] for j in range(len(texts)) if comp[j] == c and texts[j][0] is not None), default=None))) for (i, _), f, c in zip(texts, fps, comp))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_groups(d).collect()) == want
    kept = simhash.keep_one_of_group(d, shingle=4)
    assert kept.columns == d.columns and kept.count() == len(set(comp))
    assert simhash.near_groups(empty).count() == 0


def test_pipeline_drops_all_similar(spark):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    texts = ["", "one two", "One  two", None, "a b c d e f", "a b c d e f g"]
    for size in (12, 40, 120, 400):
        for _ in range(12):
            base = [f"w{k}" for k in rng.integers(0, 5000, size)]
            texts.append(" ".join(base))
            for changes in (1, size // 60 + 1, size // 40 + 1):
                other = list(base)
                for at in rng.choice(size, changes, replace=False):
                    other[at] = "new"
                texts.append(" ".join([*other, "tail"] if changes % 2 else other))
    same = [f"x{k}" for k in range(100)]  # a large group, all sharing text with one another
    texts += [" ".join([*same[:at], "odd", *same[at + 1:]]) for at in range(0, 100, 3)]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    fps = [simhash.fingerprint(t or "", 5) for t in texts]
    comp, far = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4 and sets[i]
            far += bool(alike) and (fps[i] ^ fps[j]).bit_count() > 4
            if alike or (fps[i] ^ fps[j]).bit_count() <= 4:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    assert far > 20  # pairs that the fingerprints alone don't show
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.simhash_neardup(spark, d, "")
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))
    assert corpus_pipeline.simhash_neardup(spark, d.limit(0), "").count() == 0


def test_fingerprint_by_hand():
    import xxhash

    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c d", "b c d é", "c d é a", "d é a b")]
    assert simhash.fingerprint("A  b\tc D é a\x0bb") == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > 4)
    assert simhash.fingerprint(" \n") == 0 and simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_exact(docs, empty):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in TEXTS]
    rows = exact.dedup_rows(docs).collect()
    for r in rows:
        i = next(k for k, (d, t) in enumerate(TEXTS) if d == r.doc_id and hashlib.sha256(norm[k].encode()).hexdigest() == r.text_sha256)
        group = [TEXTS[k] for k in range(len(TEXTS)) if norm[k] == norm[i]]
        assert r.group_size == len(group)
        assert r.keep_id == min(group, key=lambda g: (-len(g[1] or ""), g[0] is None, g[0]))[0]
    assert sum(r.kept for r in rows) == len(set(norm)) == exact.keep_first_copies(docs).count()
    assert exact.dedup_rows(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5) | st.integers(2**64 - 4, 2**64 - 1), max_size=60), max_size=4))
def test_counting_quotient_filter(parts):
    filters = [CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(np.array(p, np.uint64)).to_bytes()) for p in parts]
    fp, n = CountingQuotientFilter.merge(filters).items()
    want = {}
    for x in (x for p in parts for x in p):
        want[x] = want.get(x, 0) + 1
    assert dict(zip(fp.tolist(), n.tolist())) == want


def test_urls(spark):
    cases = [("https://a.example.com/en/9", "com/en/", "block"), ("https://A.Example.COM/en/71?x", "example.com/en/7", "allow"), ("http://example.net/de/81#t", "example.net/de/8", "block"), ("x://net/de/", "net/de/", "block"), ("x://evil.org/x.com/en/", None, "allow"),
             ("http://xcom/en/", None, "allow"), ("nothing", None, "allow"), (None, None, "allow"), ("http://com?/en/", None, "allow"), ("http://é.org/es/", "org/es/", "block")]
    d = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(d).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.judge_urls(d.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab/*?", min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.text("ab/", max_size=12), max_size=6))
def test_automaton_is_regex(globs, texts):
    def regex(g):
        host, out = True, ""
        for part in re.split(r"(\*+)", g):
            if part.startswith("*"):
                out += "[^/]*" if host else ".*"
            else:
                for c in part:
                    host = host and c != "/"
                    out += "." if c == "?" else re.escape(c)
        return out
    got = urls.ShiftAnd(globs).matches([t.encode() for t in texts])
    assert got.tolist() == [[re.fullmatch(regex(g), t) is not None for g in globs] for t in texts]


def test_language(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 100").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    odd = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert odd[3] == odd[4] == odd[5] == odd[8] == "und"
    assert language.identify(empty).count() == 0 and language.keep_known_language(empty).count() == 0


def test_forward_backward_is_word_by_word():
    rng = np.random.default_rng(1)
    f = language.LanguageField(list("abc"), rng.normal(size=(1 << language.WORD_BITS, 3)).astype(np.float32), rng.normal(size=(1 << language.GRAM_BITS, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32))
    texts = [" ".join(f"w{k * k % 17}" for k in range(n)) for n in (1, 0, 31, 32, 33, 150)]
    w = language.Words(texts)
    got = f.posteriors(w)
    e, t = np.exp(f.emissions(w)), np.exp(f.move.astype(float))
    for a, b in zip(w.first[:-1], w.first[1:]):
        if a < b:
            x, y = f._passes(np.exp(f.emissions(w)[a:b] - f.emissions(w)[a:b].max(1, keepdims=True))[None], t, np.ones((1, b - a), bool))
            p = (x * y)[0]
            assert np.allclose(got[a:b], p / p.sum(1, keepdims=True), atol=1e-6)
    assert len(e) == len(got)


def test_posteriors_are_sums_over_all_paths():
    rng = np.random.default_rng(2)
    f = language.LanguageField(list("abc"), rng.normal(size=(1 << language.WORD_BITS, 3)).astype(np.float32), rng.normal(size=(1 << language.GRAM_BITS, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32))
    texts = ["one", "one two three", "", "a b c d e f"]
    w = language.Words(texts)
    e, got = f.emissions(w), f.posteriors(w)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if a == b:
            continue
        total = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            weight = np.exp(f.move[:, path[0]]).sum() * np.exp(sum(e[a + i, c] for i, c in enumerate(path)) + sum(f.move[c, d] for c, d in zip(path, path[1:])))
            for i, c in enumerate(path):
                total[i, c] += weight
        if b > a:
            assert np.allclose(got[a:b], total / total.sum(1, keepdims=True), atol=1e-6)


def test_short_and_unspaced_texts_are_learned():
    words = {"en": "the small house where is cat dog here now water", "de": "das kleine haus wo ist die katze hund hier jetzt"}
    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice(words[c].split(), 4)), c) for c in ("en", "de") for _ in range(40)]
    m = language.learn(*map(list, zip(*rows)))
    assert m.predict([t for t, _ in rows])[0] == [c for _, c in rows]
    rows = [("これは日本語の文章です今日は天気がいいので散歩に行きましょう" * 3, "ja")] * 30 + [("this is a text about the weather and so on " * 3, "en")] * 30
    m = language.learn(*map(list, zip(*rows)))
    assert m.predict([t for t, _ in rows] + ["日本語です", "weather"])[0] == [c for _, c in rows] + ["ja", "en"]
    none = language.learn(["", "12 "[2:]], ["en", "de"])
    assert none.langs == [] and none.predict(["hello", None])[0] == ["und", "und"]


def test_rare_languages_and_last_words_are_learned():
    langs = [f"l{i:03}" for i in range(90)]
    rows = [(" ".join(f"w{i}x{j}" for j in range(14)), c) for i, c in enumerate(langs) for _ in range(2)]
    m = language.learn(*map(list, zip(*rows)))
    assert m.langs == langs and m.word.size <= 1 << language.WEIGHT_BITS
    assert m.predict([f"w{i}x12 w{i}x13" for i in range(90)])[0] == langs  # words after the last full window


def test_language_of_odd_tables(spark):
    rows = [("a", "the small house", "en", 1.0), ("b", "das kleine haus", "de", 2.0), ("b", "das kleine haus", "de", 2.0), (None, "the", None, 0.0), ("c", "the small the " * 5000, "en", 0.0), ("d", "", "xx", 0.0)] + [(f"k{i}", ("the house", "das haus")[i % 2], ("en", "de")[i % 2], 0.0) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id string, text string, lang string, score double")
    got = sorted((r.doc_id or "", r.lang_pred) for r in language.identify(d).collect())
    assert got == sorted((i or "", "und" if not t else "en" if t.startswith("the") else "de") for i, t, *_ in rows)
    assert language.keep_known_language(d).columns == d.columns and language.keep_known_language(d).count() == len(rows) - 1


def test_stages_on_odd_tables(spark, docs, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, empty tables: each stage's rows by hand."""
    import corpus_pipeline

    spark.createDataFrame([(1, 0), (6, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
    rows = lambda d: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in d.collect())
    lettered = [r for r in TEXTS if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert rows(stages["language_id"](spark, docs, str(tmp_path))) == sorted(map(key, lettered))
    assert rows(stages["toxicity"](spark, docs, str(tmp_path))) == sorted(map(key, TEXTS))  # one class only: nothing is learned
    best = {}
    for i, t in sorted(TEXTS, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0])):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), (i, t))
    assert rows(stages["exact_dedup"](spark, docs, str(tmp_path))) == sorted(map(key, best.values()))
    near = rows(stages["simhash_neardup"](spark, docs, str(tmp_path)))
    wordless = sorted(i for i, t in TEXTS if not (t or "").split())
    assert [i for i, t in near if not t.split()] == wordless[:1] and sum(i in (6, 7) for i, _ in near) == 1 and sum(i == 8 for i, _ in near) == 1
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == empty.columns)


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "simhash_neardup", "best_fit_packing"]
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, d, sf), name)
        assert out.columns == d.columns
        was, now = {r.doc_id: r.text for r in d.collect()}, {r.doc_id for r in out.collect()}
        if name == "exact_dedup":
            norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t) for i, t in was.items()}
            best = {}
            for i in sorted(was, key=lambda i: (-len(was[i]), i)):
                best.setdefault(norm[i], i)
            assert now == set(best.values())
        d = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == {r.doc_id for r in d.collect()}
