"""Conversions of units against a walk over exact fractions; synonym pairs against the same steps in plain Python."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from specforge.operators import synonyms as Y
from specforge.operators import units as U


def walked(edges, preferred=()):
    near = defaultdict(list)
    for a, b, f in edges:
        near[a].append((b, 1 / f))
        near[b].append((a, f))
    out, seen = {}, set()
    for start in near:
        if start in seen:
            continue
        group, todo = {start: Fraction(1)}, [start]  # how many of the unit make one of `start`
        while todo:
            x = todo.pop()
            for y, step in near[x]:
                if y not in group:
                    group[y] = group[x] / step
                    todo.append(y)
        good = all(group[b] == group[a] / step for a in group for b, step in near[a])
        first = min(group, key=lambda u: (u not in preferred, u))
        out |= {u: (first, float(group[first] / group[u]) if good else None, good) for u in group}
        seen |= set(group)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_closure_equals_a_walk(spark, seed):
    r = random.Random(seed)
    edges = []
    for group in range(12):
        true = {f"g{group}u{r.random()}": Fraction(r.randint(1, 9), r.randint(1, 9)) for _ in range(r.randint(2, 9))}
        names = list(true)
        pairs = list(zip(names, names[1:])) + [r.sample(names, 2) for _ in range(3)]
        edges += [(a, b, true[a] / true[b] * (r.choice([1, 2]) if i == 0 and group % 3 == 0 else 1)) for i, (a, b) in enumerate(pairs)]
    chain = [f"n{x}" for x in r.sample(range(1000), 60)]  # names in no order along a long chain
    edges += [(a, b, Fraction(r.choice([1, 2]), r.choice([1, 2]))) for a, b in zip(chain, chain[1:])]
    edges += [("hub", f"leaf{i}", Fraction(i + 1)) for i in range(80)] + [("self", "self", Fraction(2)), ("same", "same", Fraction(1))]
    given = spark.createDataFrame([(a, b, float(f)) for a, b, f in edges + edges[:5]], "unit string, other string, factor double")
    got = {x["unit"]: (x["canonical"], x["factor"], x["consistent"]) for x in U.unit_closure(given, ("leaf7",)).collect()}
    want = walked(edges, ("leaf7",))
    assert got.keys() == want.keys()
    for u, (root, factor, good) in want.items():
        assert got[u][0] == root and got[u][2] == good, u
        assert (got[u][1] is None) == (factor is None) and (factor is None or math.isclose(got[u][1], factor, rel_tol=1e-9)), u
    assert {x[2] for x in want.values()} == {True, False}


def test_fixed_units_and_rows(spark):
    closed = U.unit_closure(U.conversions(spark).withColumn("root", F.lit("x")))
    assert closed.filter("not consistent").isEmpty()
    rows = spark.createDataFrame([(1, " ШТ. ", 3.0), (2, "км", 2.0), (3, "см", 50.0), (4, "рулон", 7.0), (5, None, 1.0), (6, "", None), (6, "", None)], "canonical_unit int, unit string, n double")
    got = U.in_canonical_units(rows, closed, quantity=F.col("n"), price=F.col("n")).collect()
    assert sorted(((x["unit"] or "", x["canonical_unit"], x["canonical_quantity"], x["canonical_price"]) for x in got), key=repr) == sorted(
        [(" ШТ. ", "pcs", 3.0, 3.0), ("км", "m", 2000.0, 0.002), ("см", "m", 0.5, 5000.0), ("рулон", "рулон", 7.0, 7.0), ("", None, 1.0, 1.0), ("", None, None, None), ("", None, None, None)], key=repr
    )


def test_conversions_that_are_none(spark):
    bad = [(None, "a", 1.0), ("a", "", 1.0), ("a", "b", 0.0), ("a", "b", -1.0), ("a", "b", float("nan")), ("a", "b", float("inf")), ("a", "b", None)]
    given = spark.createDataFrame(bad, "unit string, other string, factor double")
    assert U.unit_closure(given).collect() == []
    assert U.unit_closure(given.limit(0)).collect() == []


def aligned(decisions, least, rounds):
    lines = Counter()
    for a, b in decisions:
        a, b = ({w for w in (x or "").lower().split() if not any(ch.isdigit() for ch in w)} for x in (a, b))
        if a - b and b - a:
            lines[frozenset(a - b), frozenset(b - a)] += 1
    co, nq, nc, total = Counter(), Counter(), Counter(), sum(lines.values())
    for (a, b), n in lines.items():
        for q in a:
            nq[q] += n
            co.update({(q, c): n for c in b})
        nc.update({c: n for c in b})
    co = {k: n for k, n in co.items() if n >= least}
    t = {(q, c): 1 / sum(1 for k in co if k[1] == c) for q, c in co}
    for _ in range(rounds):
        x = Counter()
        for (a, b), n in lines.items():
            for q in a:
                near = [c for c in b if (q, c) in co]
                whole = sum(t[q, c] for c in near)
                for c in near:
                    x[q, c] += n * t[q, c] / whole
        by = Counter()
        for (_, c), v in x.items():
            by[c] += v
        t = {(q, c): v / by[c] for (q, c), v in x.items()}
    out = {}
    for (q, c), o in co.items():
        table = [(o, nq[q], nc[c]), (nq[q] - o, nq[q], total - nc[c]), (nc[c] - o, total - nq[q], nc[c]), (total - nq[q] - nc[c] + o, total - nq[q], total - nc[c])]
        g = 2 * sum(v * math.log(v * total / (r * k)) for v, r, k in table if v)
        if o * total > nq[q] * nc[c] and g >= Y.SIGNIFICANT and t[q, c] >= Y.PROBABLE:
            out[q, c] = (o, round(t[q, c], 6), round(g, 4))
    return out


def test_pairs_equal_the_steps_in_python(spark):
    r = random.Random(8)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    other = {w: "s" + w for w in words[:12]}  # twelve words that lines call otherwise
    decisions = []
    for _ in range(600):
        chosen = r.sample(words, r.randint(2, 5))
        asked = [other.get(w, w) if r.random() < 0.8 else w for w in chosen]
        decisions.append((" ".join(asked + r.sample(["noise", "код77", "x9"], 1)), " ".join(chosen if r.random() < 0.9 else r.sample(words, 3)) + " 5мм"))
    decisions += [(None, "a b"), ("a b", None), ("", ""), ("same words", "same words"), ("Винт " * 20_000 + "м", "болт м")] + [("винт стальной", "БОЛТ стальной")] * 30
    frame = spark.createDataFrame([(1, a, b) for a, b in decisions], "n int, query string, chosen string")
    got = {(x["query_word"], x["chosen_word"]): (x["together"], x["probability"], x["likelihood_ratio"]) for x in Y.synonym_pairs(frame).collect()}
    want = aligned(decisions, Y.LEAST, Y.ROUNDS)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-4)
    assert {(s, w) for w, s in other.items()} | {("винт", "болт")} <= got.keys() and got["винт", "болт"][0] == 31
    assert Y.synonym_pairs(frame.limit(0)).collect() == []
