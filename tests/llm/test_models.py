"""Toxicity and suffix tree: held-out accuracy, exact base scores, distributions that add up."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tablecare.llm import suffix_tree, toxicity

from .conftest import WORDS, prose


# toxicity

def labelled(n, seed=0):
    """Texts toxic by a word, or only by two that are harmless apart."""
    r, rows, marks = random.Random(seed), [], []
    for i in range(n):
        words = prose(seed + i, r.randrange(20, 120)).split(" ")
        kind = i % 20
        added = {0: ["Vile!"], 1: ["vileness,"], 2: ["dirty", "grobs"], 3: ["dirty"], 4: ["grobs"]}.get(kind, [])
        for w in added:
            words.insert(r.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        marks.append((i, int(kind in (0, 1, 2))))
    return rows, marks


def test_toxicity(spark, frame, odd):
    rows, marks = labelled(1800)
    rows += [(9000 + k, t) for k, (_, t) in enumerate(odd)] + [(None, "vile"), rows[0]]
    labels = spark.createDataFrame([(i, t, 1, "x") for i, t in marks] + [(None, 1, 1, "x"), (3, None, 1, "x")], "doc_id bigint, toxic int, quality int, text string")
    docs = frame(rows)
    machine = toxicity.fit(docs, labels)
    found = toxicity.score(docs, machine).collect()
    assert len(found) == len(rows)
    truth, held = dict(marks), 0
    for r in found:
        remainder = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3
        assert r["held_out"] == (remainder == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        held += r["held_out"] and r["doc_id"] in truth and r["predicted"] == truth[r["doc_id"]]
    total = sum(zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in marks)
    assert held / (total + (zlib.crc32(b"0") % 3 == 1)) > 0.95  # the pair of words too, which no sum of single weights tells
    kept = toxicity.keep_clean(docs, machine)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in found)


def test_every_telling_term_is_chosen(spark, frame):
    """More insults than a fixed number of terms would hold, in texts made as those learned from."""
    r = random.Random(4)
    insult = lambda k: f"{k:03d}q"
    rows = [(i, prose(3000 + i, 30) + "".join(" " + insult(k) for k in r.sample(range(900), 12)) * (i % 2)) for i in range(3600)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    machine = toxicity.fit(frame(rows), labels)
    buckets = {int(toxicity.terms(pa.array([insult(k)]))[0][0]) for k in range(900)}
    assert len(buckets) > 800 and len(buckets & set(machine.chosen.tolist())) > 0.95 * len(buckets)
    scores = machine.score(pa.array([" ".join([prose(9000 + k, 30), *(insult((k + j) % 900) for j in range(12))]) for k in range(900)]))
    assert (scores >= toxicity.THRESHOLD).mean() > 0.95


def test_toxicity_without_labels(spark, frame):
    docs = frame([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    scores = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert [r["score"] for r in scores] == [0.5, 0.5] and not any(r["predicted"] for r in scores)
    one_kind = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, one_kind)).collect())
    assert toxicity.score(frame([]), toxicity.fit(frame([]), none)).isEmpty()


def test_scores_follow_the_formula():
    random_ = np.random.default_rng(1)
    machine = toxicity.Machine(np.arange(4), -1.0, random_.normal(size=4), random_.normal(size=(4, toxicity.FACTORS)))
    got = machine.of(np.array([0, 1, 3, 2]), np.array([0, 3, 4, 4]))
    for score, own in zip(got, ([0, 1, 3], [2], [])):
        raw = -1.0 + sum(machine.weights[i] for i in own) + sum(machine.factors[i] @ machine.factors[j] for i in own for j in own if i < j)
        assert math.isclose(score, 1 / (1 + math.exp(-raw)))


def test_buckets_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["Vile, vile things", "", "ab abcdefg", "é1 É1"]
    alone = [set(toxicity.terms(pa.array([t]))[0].tolist()) for t in texts]
    together, bounds = toxicity.terms(pa.array(texts))
    assert [set(together[a:b].tolist()) for a, b in zip(bounds, bounds[1:])] == alone and not alone[1]


# suffix tree

def words_of(text):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(low)), None]


def sentences(n, seed=0):
    """Texts in which what follows a word depends on the two before."""
    r, rows = random.Random(seed), []
    for i in range(n):
        words = [r.choice(WORDS[:8]), r.choice(WORDS[:8])]
        for _ in range(r.randrange(10, 60)):
            k = WORDS.index(words[-1]) * 3 + WORDS.index(words[-2])
            words.append(WORDS[k % 8] if r.random() < 0.8 else r.choice(WORDS[:8]))
        rows.append((i, " ".join(words) + f" Rare{i}"))
    return rows


def test_suffix_tree(frame, odd):
    rows = sentences(400) + [(1000 + k, t) for k, (_, t) in enumerate(odd)] + [(None, "x")]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    total, distinct = sum(counts.values()), len(counts)
    got = suffix_tree.score(frame(rows)).collect()
    key = lambda x: str(x[:4])
    want = sorted(((i, held(i), len(words_of(t)), sum(counts[w] > 0 for w in words_of(t)), sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words_of(t))) for i, t in rows), key=key)
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key)
    assert [f[:4] for f in found] == [w[:4] for w in want]
    assert all(math.isclose(f[4], w[4], rel_tol=1e-9) for f, w in zip(found, want))
    assert {r["train_tokens"] for r in got} == {total}
    own = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own) + 0.15 * sum(r["n_tokens"] for r in own)
    assert suffix_tree.score(frame([])).isEmpty()


def test_without_training_texts(frame):
    unseen = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = suffix_tree.score(frame([(unseen, "a b")])).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)


def test_every_state_gives_a_distribution():
    """Over all symbols, the probabilities after any context add up to 1."""
    words = np.sort(np.array([3, 9, 12, 40], np.uint64))
    found = pa.table({"word": pa.array(words.view(np.int64)), "c": pa.array([30, 50, 20, 100])})
    tree = suffix_tree.Tree.of_symbols(found, 260, 30)
    base = tree.base
    tree.deepen(pa.table({"key": pa.array([0 * base + 1, 1 * base + 2, 3 * base + 3]), "n": pa.array([25, 18, 60])}))
    tree.deepen(pa.table({"key": pa.array([0 * base + 2, 1 * base + 4]), "n": pa.array([20, 3])}))
    every = np.arange(base)
    for spelled in ([0], [1], [3], [0, 1], [1, 2]):
        p = tree.root()[every]
        for length in range(1, len(spelled) + 1):
            state = tree.lookup(np.tile(spelled[-length:], (base, 1)))
            p = tree.refined(length - 1, state, every, p)
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)


def tree_scores(rows, held):
    """Scores of the texts by the tree in memory, all words being symbols, counted here."""
    hashes = {w: k + 1 for k, w in enumerate(sorted({w for _, t in rows for w in words_of(t) if w}))}
    hashes[None] = int(suffix_tree.END)
    texts = [([hashes[w] for w in words_of(t)], held(i)) for i, t in rows]
    counts = Counter(w for t, out in texts if not out for w in t)
    total, distinct = sum(counts.values()), len(counts)
    table_ = pa.table({"word": pa.array(np.array(list(counts), np.uint64).view(np.int64)), "c": pa.array(list(counts.values()))})
    tree = suffix_tree.Tree.of_symbols(table_, total, distinct)
    number = {w: k for k, w in enumerate(tree.words.tolist())}
    texts = [([number.get(w, tree.base - 1) for w in t], out, [(counts[w] + 0.1) / (total + 0.1 * (distinct + 1)) for w in t]) for t, out in texts]
    place = lambda t, i, d: int(tree.lookup(np.array([t[i - d : i]]))[0])
    for depth in range(1, suffix_tree.DEPTH + 1):
        runs = Counter((tuple(t[i - depth : i]), t[i]) for t, out, _ in texts if not out for i in range(depth, len(t)))
        found = sorted((place([*c], depth, depth) * tree.base + w, n) for (c, w), n in runs.items() if n >= suffix_tree.NEXT_LEAST and place([*c], depth, depth) >= 0)
        if not tree.deepen(pa.table({"key": pa.array([k for k, _ in found], pa.int64()), "n": pa.array([n for _, n in found], pa.int64())})):
            break
    out = []
    for t, _, base in texts:
        sum_ = 0.0
        for i, w in enumerate(t):
            p = np.array([base[i]])
            for d in range(1, min(i, len(tree.states)) + 1):
                p = tree.refined(d - 1, np.array([place(t, i, d)]), np.array([w]), p)
            sum_ += math.log10(p[0])
        out.append(sum_)
    return out, tree


def test_tables_give_the_scores_of_the_tree_in_memory(frame):
    rows = sentences(250, seed=3)
    want, tree = tree_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 10 == 0)
    assert all(s.any() for s in tree.states[:2]) and len(tree.states) > 1
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(frame(rows)).collect()}
    assert all(math.isclose(got[i], w, rel_tol=1e-9) for (i, _), w in zip(rows, want))


def test_the_tree_does_not_shrink_beside_a_larger_corpus(frame):
    """A context of few occurrences counts alike however many other tokens there are."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    few = [(1000 + k, f"x{k} quaint zebra y{k}") for k in range(60)] + [(held, "quaint zebra")]
    other = [(5000 + k, " ".join(str((7 * k + j * j) % 4999) for j in range(4000))) for k in range(300)]
    gain = {r["doc_id"]: r["score"] - r["base_score"] for r in suffix_tree.score(frame(few + other)).collect()}
    assert gain[held] > 3


def test_keys_come_back_from_their_steps():
    random = np.random.default_rng(3)
    keys = np.unique(np.concatenate([random.integers(0, 2**64, 5000, dtype=np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)]))
    for bits in (4, 12, 20):
        ranges, cuts = suffix_tree._cut(keys, bits)
        packed = suffix_tree._spaced(keys, cuts).to_pylist()
        assert np.array_equal(np.concatenate([suffix_tree._joined(p) for p in packed]), keys)
        assert all((suffix_tree._joined(p) >> np.uint64(64 - bits) == r).all() for r, p in zip(ranges.astype(np.uint64), packed, strict=True))
    assert suffix_tree._joined(suffix_tree._spaced(np.array([7], np.uint64), np.array([0, 1])).to_pylist()[0]).tolist() == [7]


def test_continuations_of_a_range_add_up_over_blocks():
    ctx, after = np.array([5, 5, 9], "<u8"), np.array([1, 2, 1], "<u8")
    rows = [(0, ctx.tobytes(), after.tobytes(), np.array([3, 1, 2], "<u4").tobytes()), (0, ctx[:2].tobytes(), after[:2].tobytes(), np.array([1, 2], "<u4").tobytes())]
    part = pa.table({name: pa.array([r[k] for r in rows]) for k, name in enumerate(("range", "ctx", "next", "n"))})
    assert suffix_tree._merged(part).to_pylist() == [{"ctx": 5, "next": 1, "n": 4}]


def test_blocks_are_scored_in_portions(spark, frame, monkeypatch):
    rows = [(i, prose(i % 7, 60) + f" rare{i // 3}") for i in range(120)]
    want = {tuple(r) for r in suffix_tree.score(frame(rows)).collect()}
    monkeypatch.setattr(suffix_tree, "PORTION_LEAST", 1)
    assert {tuple(r) for r in suffix_tree.score(frame(rows)).collect()} == want
    blocks = spark.createDataFrame([(k << 32 | j,) for k in range(5) for j in range(3)], "block long")
    parts = [[r["block"] for r in p.collect()] for p in suffix_tree._portions(blocks, 15)]
    assert len(parts) == suffix_tree.PORTIONS and sorted(sum(parts, [])) == sorted(r["block"] for r in blocks.collect())
    assert max(map(len, parts)) <= 5


def test_the_model_is_dealt_out_twice_at_most(frame, monkeypatch):
    rows, asked, scored = [(i, prose(i % 7, 60)) for i in range(120)], [], []
    for name, seen in (("_asked", asked), ("_scores", scored)):
        monkeypatch.setattr(suffix_tree, name, lambda *a, own=getattr(suffix_tree, name), seen=seen: seen.append(1) or own(*a))
    monkeypatch.setattr(suffix_tree, "_spans", lambda blocks, made, most: [(None, 0), (0, None)][:most])
    assert suffix_tree.score(frame(rows)).count() == 120
    assert (len(asked), len(scored)) == (2, 4)


def test_continuations_are_handed_on_in_parts(spark):
    words = np.unique(np.random.default_rng(5).integers(0, 2**64, 300, dtype=np.uint64))
    places = np.random.default_rng(6).integers(0, len(words), 4000).astype("<u4")
    row = {"held": [False, True], "bounds": [0, 3000, 4000], "places": places.tobytes(), "words": words.astype("<u8").tobytes()}
    every = suffix_tree.Sieve(16, spark.sparkContext.broadcast(np.full(1 << 13, 255, np.uint8)))
    parts = list(suffix_tree._continuations(every, 1, 6)([pa.RecordBatch.from_pylist([row])]))
    assert max(p.num_rows for p in parts) <= suffix_tree.HANDED < sum(p.num_rows for p in parts)
    got = Counter()
    for part in pa.Table.from_batches(parts).to_pylist():
        for c, w, n in zip(*(np.frombuffer(part[k], t).tolist() for k, t in (("ctx", "<u8"), ("next", "<u8"), ("n", "<u4"))), strict=True):
            got[c, w] += n
    tokens = words[places[:3000]]
    single = suffix_tree._extended(np.zeros(2999, np.uint64), tokens[:-1])
    assert got == Counter(zip(single.tolist(), tokens[1:].tolist(), strict=True))


def test_values_are_placed_in_any_order():
    random = np.random.default_rng(4)
    ordered = np.unique(random.integers(0, 2**64, 9000, dtype=np.uint64))
    values = random.permutation(np.concatenate([ordered, ordered + np.uint64(1)]))
    where = {int(x): k for k, x in enumerate(ordered)}
    assert suffix_tree._place(ordered, values).tolist() == [where.get(int(x), -1) for x in values]


def test_words_add_up_over_blocks():
    blocks = [([3, 9, 2**63 + 1], [2, 0, 5]), ([3, 4], [1, 7])]
    batch = pa.RecordBatch.from_pylist([{"words": np.array(w, "<u8").tobytes(), "counts": np.array(n, "<i8").tobytes()} for w, n in blocks])
    packed = pa.Table.from_batches(suffix_tree._dictionary(1)([batch]))
    got = [r for k in (0, 1) for r in suffix_tree._summed(packed.take([i for i, x in enumerate(packed["range"].to_pylist()) if x == k])).to_pylist()]
    assert got == [{"word": 3, "c": 3}, {"word": 4, "c": 7}, {"word": 1 - 2**63, "c": 5}]
