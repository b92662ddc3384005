"""Prefix-tree join, conversation trie and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_values import low, null_first

from specforge.llm import jaccard_join, prefix_trie, variants

# ---------------------------------------------------------------------------------------------- prefix-tree join


def components(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and 100 * len(x & y) >= percent * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for i, (did, _) in enumerate(sets):
        least[find(i)].append(did)
    return sorted((did, len(s), min(least[find(i)])) for i, (did, s) in enumerate(sets))


def shingled(texts, size):
    out = []
    for i, t in texts:
        w = low(t).encode().split()
        n = min(size, len(w))
        out.append((null_first(i), frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()))
    return out


def joined(docs, size, percent):
    return sorted((null_first(r["doc_id"]), r["n_shingles"], null_first(r["component"])) for r in jaccard_join.similar_sets(docs, size, percent).collect())


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (2, 60)])
def test_similar_sets_match_all_pairs(docs, texts, size, percent):
    assert joined(docs, size, percent) == components(shingled(texts, size), percent)


def crowd(n=120):
    """Pages of one template with fields of few values and edits: some linked, many just under the limit."""
    r = random.Random(3)
    template = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        words = list(template)
        for at in r.sample(range(60), r.choice([0, 1, 1, 2, 3])):
            words[at] = f"v{r.randrange(4)}"
        words += [f"own{i}"] * r.randrange(2)
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [7, 1000])
def test_crowds_are_joined_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = crowd()
    want = components(shingled(texts, 4), 85)
    assert 10 < len({c for _, _, c in want}) < 110
    assert joined(spark.createDataFrame(texts, "doc_id long, text string"), 4, 85) == want


def test_tree_finds_all_partners():
    r = np.random.default_rng(7)
    strings = [np.unique(r.integers(0, 40, r.integers(1, 25))) for _ in range(150)]
    sizes = np.array([len(s) + int(r.integers(0, 3)) for s in strings])
    tree = jaccard_join.Tree(strings, sizes)
    for q in range(150):
        found = sorted(int(tree.order[row]) for row in tree.near(strings[q], int(sizes[q]), 60, lambda lo, hi: False))
        want = []
        for i in range(150):
            both = len(np.intersect1d(strings[q], strings[i]))
            if 100 * both >= 60 * (sizes[q] + sizes[i] - both):
                want.append(i)
        assert found == want


def test_similar_sets_of_nothing(nothing):
    assert jaccard_join.similar_sets(nothing).collect() == []


# -------------------------------------------------------------------------------------------- conversation trie


def trie_by_hand(rows, every=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(x)] for c, x in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
            if d:
                children[x[: d - 1]].add(x[:d])

    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def in_trie(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c string, piece int"))
    return sorted(map(tuple, got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def test_prefix_trie_matches_all_prefixes(spark):
    r = random.Random(11)
    rows = []
    for c in [*range(60), *range(100, 140), 250, 777, -5, 10**12]:
        for turn in range(r.randrange(1, 9)):
            rows.append((c, r.choice([turn, turn, None]), r.choice(["user", "user", None]), r.choice(["hello", "hello", "hello", "née", "", None, "x" * 50])))
    long = [(i, "user" if i % 2 else "assistant", "same" if i < 130 else f"t{i}") for i in range(200)]
    for c, n in ((1001, 200), (1002, 200), (1003, 131), (1004, 140), (1005, 64)):
        rows += [(c, i, role, text if i < n - 3 else f"{text} {c}") for i, role, text in long[:n]]
    rows += [rows[0], rows[0], (None, 1, "user", "of no conversation"), (5, 10**6, "user", "long " * 20_000)]
    assert in_trie(spark, [(*row, "other", 1) for row in rows]) == trie_by_hand(rows)


def test_prefix_trie_of_equal_and_turnless_conversations(spark):
    equal = [(c, t, "user", f"turn {t}") for c in range(300, 340) for t in range(7)]
    none = [c for c in range(401, 500) if zlib.crc32(str(c).encode()) % 6 >= 2][:3]
    rows = equal + [(c, 1, "user", "only") for c in none]
    want = trie_by_hand(rows)
    assert in_trie(spark, [(*row, "other", 1) for row in rows]) == want
    assert in_trie(spark, []) == []


def test_fattest_numbers(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie._fattest(prefix_trie.F.col("a"), prefix_trie.F.col("b")).alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x) for r in got)


# -------------------------------------------------------------------------------------------- spelling variants


def variants_by_hand(counts, times=2):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, facts = {}, {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        facts[w] = (n, len(around))
    out = []
    for w, (n, near_words) in facts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near_words, counts.get(form[w])))
    return sorted(out, key=repr)


def vocabulary_by_hand(texts):
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_match_all_pairs(spark):
    r = random.Random(2)
    counts = {}
    for _ in range(300):
        w = "".join(r.choice("abcà") for _ in range(r.randrange(5, 8)))
        counts[w] = r.choice([3, 4, 6, 7, 13, 30, 61])
    counts |= {"helllo": 5, "hello": 20, "heello": 9, "x" * 3000: 3, "x" * 3001: 7, "éàçèù": 4}
    rows = [(w,) for w, n in counts.items() for _ in range(n)] + [(None,), ("abcd",), ("lonely",), ("lonely",)]
    got = variants.spelling_variants(spark.createDataFrame(rows, "word string").repartition(3)).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == variants_by_hand(counts)


def test_words_of_documents(docs, texts):
    words = "straße naïve Colour color colour coluor behaviour BEHAVIOR".split()
    more = [*texts, *((100 + i, " ".join(random.Random(i).choices(words, k=60)) + " ×÷ 漢字abcdef") for i in range(40))]
    frame = docs.sparkSession.createDataFrame([(i, t, "x") for i, t in more], "doc_id long, text string, word string")
    got = variants.spelling_variants(variants.spoken(frame)).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == variants_by_hand(vocabulary_by_hand(more))


def test_variants_of_nothing(spark, nothing):
    assert variants.spelling_variants(variants.spoken(nothing)).collect() == []
