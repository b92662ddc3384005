"""Fingerprints, mixing, language model, toxicity, tokens and licences against brute force."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from conftest_values import low, null_first
from pyspark.sql import functions as F

from specforge.llm import bpe, common, fingerprint, language_model, licences, mixing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_bpe_equals_tiktoken_and_round_trips(docs, texts):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted((null_first(i), tuple(public.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts)
    rows = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert sorted((null_first(r["doc_id"]), tuple(r["ids"]), bytes(r["content"])) for r in rows) == want
    digests = {(r["n_tokens"], r["ids_sha256"]) for r in bpe.digests(docs, path, pattern).collect()}
    assert digests == {(len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for _, ids, _ in want}


def words_of(r, n):
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 14))) for _ in range(n)]


def test_bpe_merges_new_short_matches_together(monkeypatch):
    path, pattern = bpe.public_vocabulary()
    encoder, alone = bpe.Encoder(path, pattern), []
    one = bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: alone.append(piece) or one(piece, ranks))
    r = random.Random(5)
    ids = bpe._encoded(encoder, [" ".join(words_of(r, 50)) for _ in range(40)] + ["x" * 40])
    assert len(ids) == 41 and all(piece in encoder.ranks or len(piece) > bpe.FAN for piece in alone) and any(len(piece) > bpe.FAN for piece in alone)


@pytest.mark.parametrize("remembered, together", [(80_000, 4096), (10, 3), (0, 1)])
def test_bpe_merged_together_equals_tiktoken(monkeypatch, remembered, together):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    monkeypatch.setattr(bpe, "TOGETHER", together)
    r = random.Random(6)
    odd = ["\x00" * k for k in range(1, 18)] + ["".join(chr(r.choice([0, 1, 0x41, 0xE9, 0x7FF, 0x6F22, 0x1F642, 0x10FFFF])) for _ in range(r.randint(1, 6))) for _ in range(300)]
    texts = ["", *odd, "aaaa aaaaaaaaaaaaaaa aaaaaaaaaaaaaaaa aaaaaaaaaaaaaaaaa", *(" ".join(words_of(r, 30)) for _ in range(10))]
    encoder = bpe.Encoder(path, pattern)
    for _ in range(3):
        r.shuffle(texts)
        for a in range(0, len(texts), 50):
            part = texts[a : a + 50]
            ids = bpe._encoded(encoder, part)
            assert ids.to_pylist() == [public.encode_ordinary(t) for t in part]
            assert [bytes(b) for b in bpe._decoded(encoder, ids).to_pylist()] == [t.encode() for t in part]
            assert len(encoder.known) <= max(remembered, len({m for t in part for m in encoder.find(t)}))


def test_fingerprints_follow_generalised_jaccard(docs, texts):
    ordered = sorted(((null_first(i), t or "") for i, t in texts), reverse=True)
    count = lambda t: collections.Counter(WORD.findall(low(t)))
    like = lambda a, b: sum((count(a) & count(b)).values()) / max(1, sum((count(a) | count(b)).values())) if count(a) or count(b) else 1.0
    want = []
    for (i, t), (_, u) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(t, edited), like(t, u)))
    got = sorted(((null_first(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in fingerprint.compare_edited(docs).collect()), reverse=True)
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want)
    a, b = (np.array([x[3:] for x in sorted(rows, key=lambda x: x[:3])]) for rows in (got, want))
    assert np.abs(a - b).mean() < 0.06


@pytest.mark.parametrize("size", [1, 3])
def test_fingerprints_with_many_buckets(docs, texts, monkeypatch, size):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", size)
    test_fingerprints_follow_generalised_jaccard(docs, texts)


@pytest.mark.parametrize("odd", [[None], [2**62, -(2**62)], [7] * 3000, [None] * 3000])
def test_fingerprints_are_dealt_evenly(spark, odd):
    ids = [*range(3000), *odd]
    table = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = fingerprint.compare_edited(common.settle(table))  # plans on files differ from those on local rows
    rows = rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.collect_list("doc_id").alias("ids")).collect()
    assert sum(r["n"] for r in rows) == len(ids) and max(r["n"] for r in rows) < 0.8 * len(ids)
    assert collections.Counter(i for r in rows for i in r["ids"]) == collections.Counter(i for i in ids if i is not None)


def test_equal_texts_have_equal_fingerprints(docs, texts):
    found = fingerprint.compare_edited(docs).collect()
    by_id = {r["doc_id"]: r["fingerprint"] for r in found}
    assert by_id[6] == by_id[7] == by_id[15] and by_id[4] == by_id[5] and by_id[1] == by_id[2] == by_id[3] == ""


def filled(sizes):
    """Targets of the sources by filling in rounds."""
    total, order = sum(sizes.values()), [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, free, target = total, set(order), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s] + 1e-9]:
        for s in over:
            target[s] = 3 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}


def test_mixing_targets_and_copies(docs, texts, spark):
    rows = mixing.plan(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    assert len(rows) == len(texts) and all(r["source_size"] == sizes[r["source"]] for r in rows)
    target = filled(sizes)
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert r["target"] == pytest.approx(target[r["source"]])
        assert math.floor(rate - 1e-9) <= r["copies"] <= min(3, math.ceil(rate + 1e-9))
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == sum(r["copies"] for r in rows)


def test_the_mixture_is_the_plan_where_ids_repeat_over_sources(spark):
    texts = [(i % 7, "word " * (1 + i % 5) + str(i % 3), ["x", "y", None][i % 3] if i % 4 else "big", "a", "b") for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string, origin string, copies string")
    taken = sorted((repr(r["source"]), r["n"]) for r in mixing.plan(docs).groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect() if r["n"])
    assert len(taken) > 2 and len({n for _, n in taken}) > 1
    assert sorted((repr(r["source"]), r["count"]) for r in mixing.mix(docs).groupBy("source").count().collect()) == taken


def test_mixing_takes_extra_copies_as_often_as_the_fraction_says(spark):
    texts = [(i, "w " * (5 + i % 40), f"s{i % 7}") for i in range(6000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = mixing.plan(docs).collect()
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        rate = mine[0]["target"] / mine[0]["source_size"]
        fraction = rate - math.floor(rate)
        extra = sum(r["copies"] - math.floor(rate) for r in mine)
        assert abs(extra - len(mine) * fraction) <= 4 * math.sqrt(len(mine) * fraction * (1 - fraction)) + 1e-6
        words = sum(r["size"] * r["copies"] for r in mine)
        assert abs(words / mine[0]["target"] - 1) < 0.1
    assert mixing.plan(docs).exceptAll(mixing.plan(docs)).isEmpty()


@pytest.mark.parametrize(("sizes", "want"), [([10] * 6, [5, 10, 15] * 2), ([10, 20, 30], [10, 20, 30]), ([1, 1, 100], [3, 3, 96]), ([0, 0], [0, 0])])
def test_mixing_targets_where_sources_tie(spark, sizes, want):
    table = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(table).orderBy("source").collect()]
    assert got == pytest.approx(want)
    assert sum(got) == pytest.approx(sum(sizes))


def test_mixing_equals_its_sql(spark, data, docs, texts, tmp_path):
    import duckdb

    clash = docs.withColumns({"did": F.lit("a"), "digest": F.lit("b"), "copies": F.lit("c"), "copy": F.lit("d")})
    assert mixing.mix(clash).columns == clash.columns and mixing.mix(clash).count() == mixing.mix(docs).count()
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (data, str(tmp_path)):
        db = duckdb.connect()
        source = f"{folder}/documents.parquet"
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{source}{'/*.parquet' if folder != data else ''}'")
        order = lambda rows: sorted(tuple((v is None, v) for v in r) for r in rows)
        want = order(db.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP4_SQL})").fetchall())
        assert order(map(tuple, mixing.op4_mixing(spark, folder).collect())) == want


def test_language_model_base_and_gain(docs, texts, spark, data):
    rows = {null_first(r["doc_id"]): r for r in language_model.score(docs, language_model.train(docs, rounds=1)).collect()}
    tokens = [(null_first(i), (t or "").encode().lower().split() + [b"\n"]) for i, t in texts]
    c = collections.Counter(w for _, t in tokens for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens:
        if i not in (6, 17, null_first(None)):
            assert rows[i]["n_tokens"] == len(t) and rows[i]["n_known"] == len(t)
            assert rows[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    real = language_model.op5_language_model(spark, data).toPandas()
    held = real[real.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert list(real.held_out) == [zlib.crc32(str(i).encode()) % 7 == 2 for i in real.doc_id]


def test_language_model_score_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_model.train(docs, rounds=2)
    assert len(model.likelihoods) >= 2 and model.likelihoods == sorted(model.likelihoods)
    lex, weight, last = model.lexicon, model.class_weight, language_model._END
    class_of = lambda w: int(lex.classes[lex.ids[w]]) if w in lex.ids else language_model._ending(w)
    counts = {r["word"].encode(): r["c"] for r in model.counts.collect()} | {b"\n": model.texts}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs.select("doc_id", "text").collect()}
    bigrams = np.zeros_like(model.bigrams)
    for t in texts.values():
        cs = [last, *map(class_of, t)]
        np.add.at(bigrams, (cs[:-1], cs[1:]), 1)
    assert (bigrams == model.bigrams).all()
    into = bigrams.sum(0)
    moves = (bigrams + language_model.PRIOR * into / into.sum()) / (bigrams.sum(1, keepdims=True) + language_model.PRIOR)
    rows = {r["doc_id"]: r["score"] for r in language_model.score(docs, model).collect()}
    for i, t in list(texts.items())[:60]:
        want, before = 0.0, last
        for w in t:
            k, c = class_of(w), counts.get(w, 0)
            want += math.log10(weight * moves[before, k] * c / into[k] + (1 - weight) * (c + 1) / (model.tokens + model.types + 1))
            before = k
        assert rows[i] == pytest.approx(want, rel=1e-5)


def test_language_model_counts_are_summed_over_tasks(spark, data):
    """Sparse words, rare words and many tasks: counts behind and before a word are those of the whole corpus."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(200).repartition(7)
    one, many = (language_model.train(d, rounds=1) for d in (docs.coalesce(1), docs))
    assert (one.bigrams == many.bigrams).all() and (one.lexicon.classes == many.lexicon.classes).all()


def test_class_bigrams_are_a_distribution():
    r = np.random.default_rng(1)
    bigrams = r.integers(0, 9, (language_model._ALL, language_model._ALL))
    own, behind, ahead = 3, bigrams[3].copy(), bigrams[:, 3].copy()
    best = language_model.best_class(own, behind, ahead, int(bigrams[3, 3]), bigrams)
    assert 0 <= best < language_model.CLASSES


def test_exchange_picks_the_likelier_class():
    n = language_model._ALL
    bigrams = np.full((n, n), 20, np.int64)
    bigrams[1, 2] = 500
    bigrams[2, 1] = 500
    bigrams[5, 6] = bigrams[6, 5] = 300
    behind, ahead = np.zeros(n, np.int64), np.zeros(n, np.int64)
    behind[2], ahead[2] = 40, 40
    bigrams[5] += behind
    bigrams[:, 5] += ahead
    assert language_model.best_class(5, behind, ahead, 0, bigrams) == 1


def test_toxicity_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    scored = toxicity.op6_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    assert scored.score.between(0, 1).all()
    known = scored[~scored.held_out]
    clean = scored[scored.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.97 and known[known.toxic == 1].predicted.mean() > 0.6


def test_toxicity_without_labels_is_constant(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.fit(docs, none).score(docs, ["doc_id"]).collect()} == {0.0}
    one = spark.createDataFrame([(6, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.fit(docs, one).score(docs, ["doc_id"]).collect()} == {1.0}


def test_word_forms():
    assert toxicity.word_form("1d10t!!") == ("idiot", True) and toxicity.word_form("Scum,") == ("scum", False)
    assert toxicity.word_form("st-up.id") == ("stupid", True) and toxicity.word_form("123")[1] is False


def test_licences_base_places_and_labels(docs, texts, spark):
    more = [
        (100, "MIT License, mit license\nMIT LICENSE mit  license"), (101, "General Public-License; the Apache license"), (102, "mit licenses"), (103, None),
        (104, "All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (105, "rights all reserved"),
    ]
    both = spark.createDataFrame([(i, t) for i, t in [*texts, *more]], "doc_id long, text string")
    rows = sorted(licences.scan(both).collect(), key=lambda r: (null_first(r["doc_id"]), r["n_words"]))
    want = []
    for i, t in [*texts, *more]:
        w = licences.phrase_words(t or "")
        at = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p in licences.BASE}
        places = sorted(k for x in at.values() for k in x)
        want.append((null_first(i), len(w), len(places), places[0] if places else None, places[-1] if places else None, sorted({licences.BASE[p] for p, x in at.items() if x})))
    got = [(null_first(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows]
    assert got == sorted(want, key=lambda x: x[:2])
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[104]["labels"] == ["mit", "proprietary"] and by_id[104]["score"] == 1.0
    assert by_id[105]["labels"] == [] and by_id[105]["score"] == 0.0
    assert all(set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 for r in rows)


def test_licences_of_every_document_are_found(spark):
    table = spark.createDataFrame([(i, f"All rights reserved. Text {i}") for i in range(4)], "doc_id long, text string")
    assert [(r["labels"], r["score"]) for r in licences.scan(table).collect()] == [(["proprietary"], 1.0)] * 4


def test_licences_of_a_file_with_all_notices(spark):
    notices = [t for _, t, _ in licences.TEMPLATES]
    # the other rows make some words of every template frequent and others rare
    rows = [(0, "\n".join(notices)), *((i, "plain text of the software") for i in range(1, 40)), (40, " ".join(sorted({w for t in notices for w in t.split()})) + " " + notices[0])]
    by_id = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by_id[0]["labels"] == sorted({x for x, _, _ in licences.TEMPLATES}) and by_id[0]["score"] == pytest.approx(1.0)
    assert by_id[1]["labels"] == [] and by_id[40]["labels"] == ["mit"] and by_id[40]["score"] == pytest.approx(1.0)


def test_licences_of_a_very_long_file_take_linear_time(spark):
    """50,000 licence words in one file: the work for a posting may not grow with the file."""
    vocabulary = sorted({w for _, t, _ in licences.TEMPLATES for w in t.split()})
    r = random.Random(3)
    text = " ".join(r.choice(vocabulary) for _ in range(50_000)) + " " + licences.TEMPLATES[12][1]
    table = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")
    began = time.monotonic()
    by_id = {r["doc_id"]: r for r in licences.scan(table).collect()}
    assert time.monotonic() - began < 60
    assert "bsd" in by_id[1]["labels"] and by_id[1]["n_words"] == 50_000 + len(licences.TEMPLATES[12][1].split())
    assert by_id[2]["labels"] == by_id[3]["labels"] == []


def test_licence_labels_equal_brute_force(spark):
    """Several licences in a file, notices in most files, words left out, changed and put in."""
    r = random.Random(5)
    texts = []
    for i in range(150):
        parts = [licences.TEMPLATES[12][1].split()] if i % 10 else []
        for _ in range(r.randrange(4)):
            words = r.choice(licences.TEMPLATES)[1].split()
            for _ in range(r.randrange(4)):
                k = r.randrange(len(words))
                words[k : k + r.randrange(2)] = [r.choice(["x", "the", "license", "software"])] * r.randrange(2)
            parts.append(words)
        parts.append([r.choice(["plain", "text", "of", "the", "software", "permission"]) for _ in range(r.randrange(30))])
        r.shuffle(parts)
        texts.append((i, " ".join(" ".join(p) for p in parts)))
    words = {i: licences.phrase_words(t) for i, t in texts}
    df = collections.Counter(w for x in words.values() for w in set(x))
    idf = {w: math.log(1 + (len(texts) + 1) / max(1, df[w])) for _, t, _ in licences.TEMPLATES for w in t.split()}
    want = {}
    for i, x in words.items():
        labels = {v for p, v in licences.BASE.items() if f" {p} " in f" {' '.join(x)} "}
        best = 0.0
        for label, text, key in licences.TEMPLATES:
            t, k = text.split(), key.split()
            used = set(sorted(set(t), key=lambda w: (-idf[w], w))[: licences.LOOKED_UP])
            at = next(j for j in range(len(t)) if t[j : j + len(k)] == k)
            whole = sum(idf[w] for w in t if w in used)
            for shift in range(-len(t), len(x)):
                there = [w for j, w in enumerate(t) if w in used and 0 <= j + shift < len(x) and x[j + shift] == w]
                share = sum(idf[w] for w in there) / whole
                if share >= licences.LEAST_SHARE and at + shift >= 0 and x[at + shift : at + shift + len(k)] == k:
                    labels.add(label)
                    best = max(best, min(1.0, share))
        want[i] = (sorted(labels), pytest.approx(best))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want and len({str(v[0]) for v in want.values()}) > 10


def test_empty_tables(nothing, spark):
    path, pattern = bpe.public_vocabulary()
    assert fingerprint.compare_edited(nothing).count() == 0
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    assert bpe.digests(nothing, path, pattern).count() == 0
    assert licences.scan(nothing).count() == 0
    assert language_model.score(nothing, language_model.train(nothing)).count() == 0


def test_pipeline_stages_agree_with_brute_force(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, data)
    assert clean.columns == columns
    clean = clean.cache()
    rows = clean.toPandas()
    assert len(rows) >= 0.7 * docs.count()
    kept = stages["exact_dedup"](spark, clean, data).toPandas()
    assert set(kept.doc_id) == set(rows.groupby("text").doc_id.max())
    near = stages["near_dedup"](spark, clean, data).toPandas()
    assert list(near.columns) == columns and 0 < len(near) <= rows.text.nunique()
    mixed = stages["mixing"](spark, clean, data)
    assert mixed.columns == columns and set(r["doc_id"] for r in mixed.select("doc_id").collect()) <= set(rows.doc_id)
    assert stages["bpe"](spark, clean, data).count() == len(rows)


def test_pipeline_equals_brute_force(spark):
    """All stages on the smallest table: what the classifier keeps is taken from its scores, the rest is computed here."""
    import corpus_pipeline
    import tiktoken

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet").filter(~toxicity.held_out()))
    clean = {r["doc_id"] for r in model.score(docs, ["doc_id"]).collect() if r["score"] < toxicity.REJECT}
    rows = {r["doc_id"]: (r["text"] or "", r["source"]) for r in docs.collect() if r["doc_id"] in clean}
    last = {t: i for i, (t, _) in sorted(rows.items())}
    rows = {i: rows[i] for i in last.values()}
    sets = {}
    for i, (t, _) in rows.items():
        w = low(t).encode().split()
        sets[i] = {tuple(w[j : j + min(5, len(w))]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both) and root(a) != root(b):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = {i: x for i, x in rows.items() if root(i) == i}
    n = {i: len(WORD.findall(t)) for i, (t, _) in rows.items()}
    sizes = collections.Counter()
    for i, (_, s) in rows.items():
        sizes[s] += n[i]
    target = filled(sizes)
    path, pattern = bpe.public_vocabulary()
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = collections.Counter()
    for i, (t, s) in rows.items():
        rate = min(target[s] / sizes[s], 3.0) if sizes[s] else 0.0
        drawn = int(hashlib.md5(f"{mixing.SEED} {i}".encode()).hexdigest()[:13], 16) / 2**52
        tokens = public.encode_ordinary(t)
        row = (i, len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        want[row] += math.floor(rate) + (drawn < rate - math.floor(rate))
    got = collections.Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, data).collect())
    assert got == +want
