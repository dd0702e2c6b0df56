"""Pairs by the similarity of their shingle sets against all pairs, and how many rows a group of copies makes."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from streetloom.llm import shingles, simhash
from streetloom.llm.common import local_components

LEAST = 0.8


def _table(sets, comp=None):
    """The rows of shared prefix tokens of sets, as shingle_links deals them."""
    common = np.unique(np.concatenate(sets), return_counts=True)
    first = [shingles.prefix(s, (common[0], common[1].astype(np.int32)), LEAST) for s in sets]
    held = dict(zip(*np.unique(np.concatenate(first), return_counts=True), strict=True))
    rows = []
    for sid, (s, p) in enumerate(zip(sets, first, strict=True)):
        own = [(at, int(t)) for at, t in enumerate(p) if held[t] > 1]
        for k, (at, t) in enumerate(own):
            rows.append((t, at, len(s), sid, sid if comp is None else comp[sid], *(own[k - b - 1][1] if k > b else t for b in range(shingles.BEFORE))))
    columns = list(zip(*rows, strict=True))
    kinds = ("int64", "int32", "int32", "int64", "int64", *["int64"] * shingles.BEFORE)
    return pa.table({c: pa.array(x, kind) for c, x, kind in zip(("token", "at", "n", "sid", "comp", *(f"b{k}" for k in range(shingles.BEFORE))), columns, kinds, strict=True)})


def _alike_pairs(sets):
    out = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        both = len(np.intersect1d(a, b))
        if both >= LEAST * (len(a) + len(b) - both) - 1e-9:
            out.add((i, j))
    return out


def _sets(rng, groups=12, copies=9):
    sets = []
    for _ in range(groups):
        base = rng.choice(1 << 20, rng.integers(5, 120), False)
        for _ in range(copies):
            s = base[rng.random(len(base)) > rng.uniform(0, 0.25)]
            sets.append(np.unique(np.concatenate([s, rng.choice(1 << 20, rng.integers(0, 4)), rng.choice(30, 3)])).astype(np.uint64))
    return sets


@pytest.mark.parametrize("seed", range(6))
def test_all_pairs_are_listed_once_or_more(seed):
    sets = _sets(np.random.default_rng(seed))
    wanted = _alike_pairs(sets)
    out = shingles._alike(_table(sets), LEAST, "all")
    assert wanted and wanted <= set(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
    comp = [i // 9 if i % 3 else i + 1000 for i in range(len(sets))]
    out = shingles._alike(_table(sets, comp), LEAST, "all")
    found = set(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
    assert {p for p in wanted if comp[p[0]] != comp[p[1]]} <= found
    assert all(comp[a] != comp[b] for a, b in found)


def test_a_pair_is_listed_at_few_of_its_tokens(monkeypatch):
    monkeypatch.setattr(shingles, "STEP_PAIRS", 7)
    rng = np.random.default_rng(1)
    base = rng.choice(1 << 40, 2000, False)
    sets = [np.unique(np.append(base[rng.random(2000) > 0.02], rng.choice(1 << 40, 20))).astype(np.uint64) for _ in range(12)]
    table = _table(sets)
    made = sum(len(shingles._alike(table.filter(pa.array(table["token"].to_numpy() % 50 == k)), LEAST, "all")) for k in range(50))
    assert 66 <= made <= 3 * 66  # 66 pairs with hundreds of tokens in common, dealt to 50 tasks: some 3,000 rows if each task lists them


def test_a_connected_group_makes_no_rows():
    rng = np.random.default_rng(2)
    base = rng.choice(1 << 40, 100, False)
    sets = [np.unique(np.append(base[rng.random(100) > 0.03], rng.choice(1 << 40, 2))).astype(np.uint64) for _ in range(300)]
    comp = [0] * 299 + [299]
    assert len(shingles._alike(_table(sets, comp), LEAST, "all")) <= 600
    near = shingles._alike(_table(sets), LEAST, "next")
    node, root = local_components(near["a"].to_numpy(), near["b"].to_numpy())
    assert len(node) == 300 and not root.any()  # neighbours differ from token to token, so they connect the group


def test_groups_of_near_copies_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = []
    for _ in range(6):
        base = rng.choice(words, 150)
        for _ in range(25):
            t = base.copy()
            at = rng.choice(150, rng.integers(0, 7), False)
            t[at] = rng.choice(words, len(at))
            texts.append(" ".join(t))
    sets = [shingles.hash_set(shingles.hashes(shingles.split(t), 5)) for t in texts]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    links = _alike_pairs(sets) | {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4}
    a, b = (np.array(x) for x in zip(*links, *((i, i) for i in range(len(texts))), strict=True))
    node, root = local_components(a, b)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.keep_one_of_group(docs, shingle=5, radius=4, least=LEAST).collect()}
    assert kept == set(root.tolist()) and 6 < len(kept) < 150
