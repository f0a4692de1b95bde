"""Top products, similar texts, repeats, line chunks and containment against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablecare.llm import containment, line_chunks, repeats, similar_texts, top_products
from tablecare.llm import components as components_module
from tablecare.llm.components import components

from .conftest import prose


# top products

def best(rows, k=5, every=5):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, list(v)) for i, v in sorted(set((i, tuple(v)) for i, v in whole))]
    out = set()
    for i, q in whole:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_top_products(spark, spread, monkeypatch):
    monkeypatch.setattr(top_products, "BUCKET", 16)
    monkeypatch.setattr(top_products, "STEEP", 0.3)
    random_ = np.random.default_rng(5)
    rows = [(i, (random_.normal(size=6) * np.exp(spread * random_.normal())).astype(np.float32).astype(float).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(12)]  # ties
    rows += [(300, None), (301, []), (302, [1.0, None]), (303, [1.0, float("nan")] * 3), (304, [float("inf")] * 6), (305, [0.0] * 6), (None, [1.0] * 6), rows[0], (310, [1.0, 2.0]), (315, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<double>, rank int, length double")
    from pyspark.sql import functions as F

    found = top_products.top_products(df, F.col("vec_id") % 5 == 0)
    assert {tuple(r) for r in found.collect()} == best(rows)
    assert top_products.top_products(df.limit(0), F.col("vec_id") % 5 == 0).isEmpty()


@pytest.mark.parametrize("strength", [3.0, 30.0, 1000.0])
def test_one_dominating_coordinate(strength, monkeypatch):
    monkeypatch.setattr(top_products, "BUCKET", 8)
    random_ = np.random.default_rng(11)
    whole = np.floor(256 * random_.normal(size=(400, 6)))
    whole[np.arange(400), random_.integers(0, 6, 400)] *= strength * random_.choice([-1, 1], 400)
    whole = np.vstack([whole, [[25600, 0, 0, 0, 0, 0], [25856, 0, 0, 0, 0, 0], [25344, 12544, 0, 0, 0, 0]]])
    lengths = np.sqrt((whole * whole).sum(1))
    order = np.argsort(-lengths, kind="stable")
    pack = lambda v, i: top_products.Packed({"dim": 6, "ids": i.astype("<i8").tobytes(), "lengths": np.sqrt((v * v).sum(1)).tobytes(), "vectors": v.tobytes()})
    best_ = top_products.Best(pack(whole, np.arange(len(whole))), 5, np.full(len(whole), -np.inf))
    best_.scan(pack(whole[order], order))
    scores = (whole @ whole.T).astype(np.int64)
    want = {(q, c, scores[q, c]) for q in range(len(whole)) for c in sorted((c for c in range(len(whole)) if c != q), key=lambda c: (-scores[q, c], c))[:5]}
    assert set(zip(best_.q.tolist(), best_.ids.tolist(), best_.scores.tolist())) == want


def test_products_are_exact():
    a = np.array([[2.0**40, 1.0]])
    assert top_products.products(a, np.array([[2.0**20, 3.0]]))[0, 0] == 2**60 + 3


# components

def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 100), (7, 7), (101, 100)]
    found = {tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 104)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


# similar texts

def classes(rows, size, percent):
    def shingle_set(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
        return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, x), (j, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= percent * len(x | y):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def family(seed, n, copies, edits):
    r, base = random.Random(seed), prose(seed, n).split(" ")
    for k in range(copies):
        words = list(base)
        for _ in range(edits[k % len(edits)]):
            words[r.randrange(n)] = f"new{r.randrange(10**9)}"
        yield " ".join(words)


def test_similar_texts(frame, odd):
    texts = [*family(3, 200, 40, [0, 1, 2, 3, 4, 6]), *family(4, 90, 30, [1, 2]), *family(5, 12, 10, [0, 1]), *[prose(9, 60) + " " + prose(50 + k, 80) for k in range(30)]]
    rows = odd + [(100 + i, t) for i, t in enumerate(texts)] + [(900, texts[0].upper())]
    got = similar_texts.similar_components(frame(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == classes(rows, 3, 90)
    assert similar_texts.similar_components(frame([])).isEmpty()


def near_family(seed, n, most):
    """Texts of 400 words, each with up to ``most`` words of a common one replaced."""
    r, base = random.Random(seed), [f"w{seed}x{k}" for k in range(400)]
    for i in range(n):
        own = list(base)
        for k in r.sample(range(400), r.randint(1, most)):
            own[k] = f"new{seed}x{i}x{k}"
        yield " ".join(own)


def test_shingles_that_the_same_texts_share_are_met_once(frame):
    base = prose(77, 400).split()
    other = [f"other{k}" if k % 60 == 7 else w for k, w in enumerate(base)]  # too many to link, prefix shingles in common
    join = similar_texts.Join(frame([(1, " ".join(base)), (2, " ".join(other))]), "doc_id", "text", 3, 90)
    assert join.links().isEmpty()
    assert (join.spots, join.pairs) == (2, 1)


def test_families_are_connected_in_turns_before_pairs_are_made(frame, monkeypatch):
    turns, to_one = [], similar_texts.Join._to_one
    monkeypatch.setattr(similar_texts, "CROWDED", 0)
    monkeypatch.setattr(similar_texts.Join, "_to_one", lambda self, left, placed, turn: turns.append(self.pairs) or to_one(self, left, placed, turn))
    rows = list(enumerate(near_family(1, 30, 6)))
    got = similar_texts.similar_components(frame(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == classes(rows, 3, 90)
    assert turns


def test_one_of_each_group_stays(frame, odd):
    rows = [r for r in odd if r[0] != 7] + [(100 + i, t) for i, t in enumerate(family(6, 150, 30, [0, 1, 3, 5, 9]))]
    kept = similar_texts.keep_one(frame(rows))
    assert kept.columns == frame(rows).columns
    want = [(i, n, c) for i, n, c in classes(rows, 5, 80) if i == c]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _, _ in want), key=str)


def test_one_row_stays_of_equal_ids_and_texts(frame):
    t, u = prose(60, 80), prose(61, 80)
    near = u + " more"
    kept = lambda rows: sorted((r["doc_id"], r["text"]) for r in similar_texts.keep_one(frame(rows)).collect())
    assert kept([(1, t), (5, t), (5, u), (7, near), (9, t), (9, t)]) == [(1, t), (5, u)]
    assert kept([(3, t)] * 3) == [(3, t)]
    assert len(kept([(3, t), (3, t + " x")])) == 1
    assert kept([(2, ""), (2, ""), (4, t)]) == [(2, ""), (2, ""), (4, t)]


# repeats

def removed(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    starts = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if starts[t[i : i + least]] > 1:
                gone[i : i + least] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("members", [1000, 2])
def test_repeats(frame, odd, members, monkeypatch):
    monkeypatch.setattr(repeats, "MEMBERS", members)
    passage, other = prose(70, 60), prose(71, 45)
    rows = [r for r in odd if r[0] != 13]
    for k in range(25):
        cut = passage[: 150 + 5 * k]
        rows.append((100 + k, f"{prose(200 + k, 30)} {cut} {prose(300 + k, 20)}{other if k % 3 else other[k:]} {prose(400 + k, 30)}"))
    rows += [(200, "ab" * 400), (201, "x" * 199), (202, "y" * 200), (203, "y" * 200), (204, passage + passage), (205, "é" * 150 + "z")]
    assert sorted((tuple(r) for r in repeats.removal_digests(frame(rows)).collect()), key=str) == removed(rows, 200)
    assert repeats.removal_digests(frame([])).isEmpty()


def test_texts_longer_than_a_piece(frame, monkeypatch):
    monkeypatch.setattr(repeats, "PLACE_BITS", 10)
    rows = [(1, prose(1, 900)), (2, prose(2, 300) + prose(1, 900)[700:2900])]
    assert sorted((tuple(r) for r in repeats.removal_digests(frame(rows)).collect()), key=str) == removed(rows, 200)


def test_maximal_repeats():
    members = [(b"xabc", b"defgh"), (b"yabc", b"defgi"), (b"zabc", b"dexxx"), (b"abc", b"defgh")]
    found = {(left, right, tuple(sorted(run))) for left, right, run in repeats.maximal_repeats(members, 4)}
    assert found == {(3, 2, (0, 1, 2, 3)), (3, 4, (0, 1, 3)), (3, 5, (0, 3))}


# line chunks

def chunks_removed(rows):
    seen, kept = set(), {}
    blank = lambda line: not line.strip(" \t\r")
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = (text or "").split("\n"), set()
        for i, chunk in enumerate(zip(lines, lines[1:])):
            if blank(chunk[0]) and blank(chunk[1]):
                continue
            if chunk in seen:
                gone |= {i, i + 1}
            seen.add(chunk)
        kept[doc_id, text] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return sorted(((i, kept[i, t]) for i, t in rows), key=str)


def test_line_chunks(frame, odd):
    block = "\n".join(prose(600 + k, 6) for k in range(12))
    rows = odd + [(100 + k, f"{prose(700 + k, 5)}\n{block}\n{prose(800 + k, 5)}\n" * (1 + k % 2)) for k in range(12)] + [(300, "\n".join(["same"] * 5000)), (301, "\n".join(str(k) for k in range(5000)))]
    rows += [(400 + k, f"{prose(900 + k, 4)}\n\n\n \t\n{prose(950 + k, 4)}\n\n\n") for k in range(3)]  # blank lines stay
    done = line_chunks.remove_repeats(frame(rows), counts=True)
    assert done.columns == [*frame(rows).columns, "n_lines", "n_removed"]
    got = done.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == chunks_removed(rows)
    assert all(r["n_lines"] >= r["n_removed"] >= 0 for r in got) and sum(r["n_removed"] for r in got) > 50
    assert {r["n_removed"] for r in got if 400 <= (r["doc_id"] or 0) < 403} == {0}
    assert line_chunks.remove_repeats(frame([])).isEmpty()


@pytest.mark.parametrize("size", [2, 3, 4, 6, 10, 20])
def test_line_passages_go_whole(frame, size):
    """Passages of every length, each in two texts with other lines around it, leave the second one to the last line."""
    passage = lambda k: [prose(5000 + 100 * k + i, 12) for i in range(size)]
    own = lambda k: prose(90_000 + k, 12)
    rows = [(2 * k + side, "\n".join([own(10 * k + 2 * side), *passage(k), own(10 * k + 2 * side + 1)])) for k in range(20) for side in (0, 1)]
    got = {r["doc_id"]: r["text"] for r in line_chunks.remove_repeats(frame(rows)).collect()}
    for k in range(20):
        assert got[2 * k] == rows[2 * k][1] and got[2 * k + 1] == f"{own(10 * k + 2)}\n{own(10 * k + 3)}"


def test_chunks_of_equal_hashes_and_other_bytes_stay(frame):
    from pyspark.sql import functions as F

    rows = [(1, "a\nb"), (2, "c\nd"), (3, "e\nf"), (4, "e\nf")]
    chunks = line_chunks.chunk_table(frame(rows)).withColumns({"one": F.when(F.col("k_id") < 3, 0).otherwise(1), "two": F.lit(0)})
    assert [tuple(r) for r in line_chunks._unequal(frame(rows), chunks, "doc_id", "text").collect()] == [(0, 0)]


# containment

def test_leaks(spark, frame, odd):
    items = [(1, prose(1, 30)), (2, "One two"), (3, None), (4, ""), (5, prose(5, 12)), (6, prose(5, 12)), (7, "solo"), (8, prose(8, 40))]
    w = items[7][1].split(" ")
    broken = " ".join([*w[:20], "CHANGED", *w[21:]])  # 5 of 36 shingles fewer: over 80 %
    rows = odd + [(100, "Intro. " + items[4][1].upper() + "! " + prose(99, 500)), (101, broken), (102, " ".join(w[:22])), (103, prose(77, 100) + " " + items[0][1])]
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, n int, shingle string")
    words = lambda t: [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]

    def own(t, size):
        x = words(t)
        return {tuple(x[k : k + size]) for k in range(len(x) - size + 1)}

    want = set()
    for (d, t), (i, s) in itertools.product(rows, items):
        n = min(5, len(words(s)))
        if n and 100 * len(own(s, n) & own(t, n)) >= 80 * len(own(s, n)):
            want.add((d, i, len(own(s, n) & own(t, n)), len(own(s, n))))
    got = containment.find_leaks(frame(rows), benchmark).select("doc_id", "item_id", "n_shared", "n_item").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {(100, 5), (100, 6), (101, 8), (103, 1)} <= {(d, i) for d, i, *_ in want} and (102, 8) not in {(d, i) for d, i, *_ in want}
    kept = containment.drop_leaks(frame(rows), benchmark)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in {x[0] for x in want}), key=str)
    assert containment.find_leaks(frame(rows), benchmark.limit(0)).isEmpty()
    assert containment.find_leaks(frame([]), benchmark).isEmpty()


def test_stars_take_no_further_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components_module, "cut_lineage", lambda df, own=components_module.cut_lineage: written.append(1) or own(df))
    star = spark.createDataFrame([(k, 0) for k in range(1, 30)] + [(7, 0), (41, 40)], "a long, b long")
    assert sorted(map(tuple, components(star).collect())) == [(k, 0) for k in range(30)] + [(40, 40), (41, 40)]
    assert len(written) == 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 70), (100, 80)], "a long, b long")
    assert sorted(map(tuple, components(chain).collect())) == [(k, 0) for k in range(61)] + [(70, 70), (80, 70), (100, 70)]
    assert components(star.where("a < 0")).isEmpty()
