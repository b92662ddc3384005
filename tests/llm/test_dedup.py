"""Substring, near, exact and paragraph dedup against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from conftest_values import low, null_first

from specforge.llm import exact_dedup, links, near_dedup, paragraphs, suffix_dedup


def removed_bytes(texts, length):
    seen, out = set(), []
    for i, t in sorted(((null_first(i), (t or "").encode()) for i, t in texts)):
        gone = np.zeros(len(t) + 1, int)
        for j in range(len(t) - length + 1):
            w = t[j : j + length]
            if w in seen:
                gone[j] += 1
                gone[j + length] -= 1
            seen.add(w)
        out.append((i, t, np.cumsum(gone)[:-1] > 0))
    return out


def test_suffix_dedup_is_exact(docs, texts):
    want = sorted((i, len(t), bytes(b for b, g in zip(t, gone, strict=True) if not g)) for i, t, gone in removed_bytes(texts, suffix_dedup.LENGTH))
    got = sorted((null_first(r["doc_id"]), r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want


def test_suffix_dedup_spans(docs):
    for r in suffix_dedup.remove_repeats(docs).collect():
        assert r["n_bytes"] - sum(s["end"] - s["start"] for s in r["spans"]) == len(r["kept"])
        assert all(a["end"] < b["start"] for a, b in itertools.pairwise(r["spans"]))


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    """A line shorter than a string in every document, its surroundings shared by some; every anchor is hot."""
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", 0)
    monkeypatch.setattr(suffix_dedup, "LEAST_BYTES", 3000)
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefg ") for _ in range(n))
    line, edges = text(77), [text(12), text(40)]
    texts = [(i, text(r.randrange(120)) + r.choice(edges) + line + r.choice(edges) + text(r.randrange(120))) for i in range(90)]
    want = sorted((i, len(t), bytes(b for b, g in zip(t, gone, strict=True) if not g)) for i, t, gone in removed_bytes(texts, suffix_dedup.LENGTH))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want and any(len(kept) < n for _, n, kept in want)


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(5)
    for k in (1, 2, 3, 5, 8):
        runs = []
        for _ in range(k):
            strings = sorted(bytes(r.choice(b"ab") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 30)))
            prefixes = [0, *(suffix_dedup._common(a, b, 0) for a, b in itertools.pairwise(strings))][: len(strings)]
            runs.append((strings, prefixes))
        source, common = suffix_dedup.merge_runs(runs)
        nxt = [iter(s) for s, _ in runs]
        merged = [next(nxt[s]) for s in source]
        assert merged == sorted(x for s, _ in runs for x in s)
        assert common[1:] == [suffix_dedup._common(a, b, 0) for a, b in itertools.pairwise(merged)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_classes_match_all_pairs(docs, texts, size):
    sets = []
    for i, t in texts:
        w = low(t).encode().split()
        n = min(size, len(w))
        sets.append((null_first(i), frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a][1] & sets[b][1])
        if sets[a][1] and sets[b][1] and 100 * both >= 80 * (len(sets[a][1]) + len(sets[b][1]) - both):
            parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(i, least.get(find(n), i))
    want = sorted((i, len(s), least[find(n)]) for n, (i, s) in enumerate(sets))
    got = sorted((null_first(r["doc_id"]), r["n_shingles"], null_first(r["component"])) for r in near_dedup.near_classes(docs, size).collect())
    assert got == want


def test_many_near_copies_are_linked(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(400):
        words = list(base)
        for _ in range(3):
            words[r.randrange(80)] = f"x{r.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    got = near_dedup.near_classes(spark.createDataFrame(texts, "doc_id long, text string"), 2)
    want = len({find for find in _components(texts, 2)})
    assert got.select("component").distinct().count() == want


def _components(texts, size):
    sets = {i: {tuple(t.split()[j : j + size]) for j in range(len(t.split()) - size + 1)} for i, t in texts}
    label = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label.values()


def test_sketch_likelihood_and_merge():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        values = np.unique(r.integers(0, 2**63, 3000, np.uint64))
        n = len(values)
        cut = int(n * (1 - share) / 2)
        a, b = values[: n - cut], values[cut:]
        u, v, both = (near_dedup.sketch(x, np.zeros(len(x), np.int64), 1) for x in (a, b, values))
        assert (np.maximum(u, v) == both).all() or (np.minimum(u, v) == both).all()
        true = len(np.intersect1d(a, b)) / n
        assert abs(near_dedup.likeliest(u, v, np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.12


def test_exact_dedup(docs, texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(null_first(i))
    want = sorted((null_first(i), max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    rows = exact_dedup.mark(docs).collect()
    assert sorted((null_first(r["doc_id"]), null_first(r["keep_id"]), r["group_size"], r["sha"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


@pytest.mark.parametrize("keep", [exact_dedup.keep_one, near_dedup.keep_one])
def test_extra_columns_with_clashing_names_stay_as_they_are(spark, docs, keep):
    from pyspark.sql import functions as F

    clash = docs.withColumns({c: F.concat(F.lit(f"own {c} "), F.coalesce("text", F.lit(""))) for c in ("did", "sha", "_did", "K", "n", "label", "component")})
    rows = keep(clash)
    assert rows.columns == clash.columns
    for r in rows.collect():
        assert all(r[c] == f"own {c} {r['text'] or ''}" for c in ("did", "sha", "_did", "K", "n", "label", "component"))


def test_golomb_round_trip():
    r = np.random.default_rng(2)
    for values in (np.empty(0, np.uint64), np.array([0, 0, 5, 2**64 - 1], np.uint64), np.sort(r.integers(0, 2**63, 5000, np.uint64))):
        assert (exact_dedup.golomb_decode(len(values), *exact_dedup.golomb_encode(values)) == values).all()


def test_paragraphs_find_a_passage_inside_other_text(docs):
    rows = {r["doc_id"]: r for r in paragraphs.remove_repeats(docs).collect() if r["doc_id"] not in (6, 17, None)}
    assert rows[9]["n_removed"] == 0 and 30 <= rows[10]["n_removed"] <= 75 and rows[10]["origins"] == [9]
    assert rows[7]["n_removed"] == 120 and rows[8]["n_removed"] > 60
    for i in (1, 2, 3, 4, 11, 13):
        assert rows[i]["n_removed"] == 0 and rows[i]["spans"] == []


def test_paragraphs_near_lines(spark):
    a = " ".join(f"p{i}" for i in range(60))
    b = a.replace("p30 ", "q30 ")
    rows = paragraphs.remove_repeats(spark.createDataFrame([(1, a), (2, f"short line\n{b}\nend")], "doc_id long, text string"))
    kept = {r["doc_id"]: r["kept"] for r in rows.collect()}
    assert kept == {1: a, 2: "short line\n\nend"}


@pytest.mark.parametrize(("size", "most"), [(2, 14), (5, 6)])
def test_a_crowd_around_the_limit_loses_no_link(spark, size, most):
    """Variants of one text whose similarities lie on both sides of 0.8."""
    r = random.Random(7)
    base = [f"w{r.randrange(60)}" for _ in range(120)]
    texts = []
    for i in range(500):
        words = list(base)
        for _ in range(r.randrange(most)):
            words[r.randrange(120)] = f"x{r.randrange(40)}"
        texts.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component"] for r in near_dedup.near_classes(spark.createDataFrame(texts, "doc_id long, text string"), size).collect()}
    label = dict(zip([i for i, _ in texts], _components(texts, size), strict=True))
    assert len(set(label.values())) > 3
    assert got == label


def test_word_hashes():
    texts = [b"", b" one two\tone\n", b"x" * 9000 + b" " + b"x" * 9001 + b" one", "\u00e9\u00a0t two".encode()]
    for t in texts:
        starts, ends, hashes = links.words_of(t)
        assert [t[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == t.split()
        assert len(set(hashes.tolist())) == len(set(t.split()))
    assert links.words_of(b"a b one")[2][2] == links.words_of(b"one")[2][0]


def test_shingle_sets():
    r = random.Random(2)
    texts = [" ".join(r.choice("abc") for _ in range(n)).encode() for n in (0, 1, 1, 2, 3, 40, 0, 40)]
    for size in (2, 5):
        hashes, unit, units, _ = links.whole(texts)
        sets = links.Sets(hashes, unit, units, size)
        want = [{tuple(w[j : j + min(size, len(w))]) for j in range(max(1, len(w) - size + 1))} if w else set() for w in (t.split() for t in texts)]
        assert sets.n.tolist() == [len(x) for x in want]
        for a, b in itertools.combinations(range(len(texts)), 2):
            assert (sets.key[a] == sets.key[b]) == (want[a] == want[b])
            assert len(np.intersect1d(sets.of(a), sets.of(b))) == len(want[a] & want[b])


def test_natural_paragraphs_join_wrapped_lines():
    def cut(text):
        hashes, unit, units, _ = paragraphs.paragraphs([text.encode()])
        return [(unit == u).sum() for u in range(units)]

    n = paragraphs.LEAST_WORDS
    line = lambda k: " ".join("w" * k).strip()
    assert cut(line(n)) == [n]
    assert cut(line(n - 1)) == []
    assert cut(f"{line(n - 5)}\n{line(5)}\n\n{line(n - 1)}\n \n{line(3)}") == [n]
    assert cut(f"title\n{line(n + 2)}\n{line(n)}\nshort") == [n + 2, n]


def test_paragraphs_find_every_long_shared_run(spark):
    """A run of PASSAGE + WINDOW - 1 words, wherever it stands."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(paragraphs.PASSAGE + paragraphs.WINDOW - 1)]
    texts = [(0, " ".join(shared))]
    for i in range(1, 60):
        parts = [word() for _ in range(r.randrange(80))], shared, [word() for _ in range(r.randrange(80))]
        texts.append((i, " ".join(sum(parts, []))))
    rows = paragraphs.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(r["n_removed"] >= paragraphs.PASSAGE and 0 in r["origins"] for r in rows if r["doc_id"])


@pytest.mark.parametrize("run", [exact_dedup.mark, near_dedup.near_classes, paragraphs.remove_repeats, suffix_dedup.remove_repeats])
def test_empty_tables(run, nothing):
    assert run(nothing).count() == 0
