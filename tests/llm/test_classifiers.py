import math
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import quality, toxicity
from quarrymill.llm.common import held_out
from quarrymill.llm.training import labelled_sample
from quarrymill.sources import read_table

SF = "/root/testdata/sf0.01"
CASES = [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)]


@pytest.fixture(scope="module")
def tables(spark):
    return read_table(spark, SF, "documents"), read_table(spark, SF, "labels")


@pytest.mark.parametrize("module,label,threshold", CASES)
def test_held_out_accuracy(tables, module, label, threshold):
    docs, labels = tables
    model = module.fit(docs, labels)
    scored = module.score_documents(docs, model, threshold)
    assert scored.count() == docs.count()
    both = scored.join(labels, "doc_id").where("held_out").select("predicted", F.col(label).alias("y")).toPandas()
    assert len(both) > 50 and (both["predicted"] == both["y"]).mean() >= 0.95
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0


@pytest.mark.parametrize("module,label,threshold", CASES)
def test_odd_documents(tables, odd, none, module, label, threshold):
    model = module.fit(*tables)
    got = module.score_documents(odd, model, threshold).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by_id[7]) == 1 and by_id[2] == by_id[3] and by_id[1] == by_id[7]  # null is empty; equal texts, equal scores
    assert module.score_documents(none, model).collect() == []


@pytest.mark.parametrize("module,label,threshold", CASES)
def test_without_labels(spark, odd, module, label, threshold):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in module.score_documents(odd, module.fit(odd, empty)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 1) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    keep = module.keep_good if module is quality else module.keep_clean
    assert keep(odd, module.fit(odd, empty)).count() == keep(odd, module.fit(odd, one)).count() == odd.count()
    assert all(r["score"] > 0.5 for r in module.score_documents(odd, module.fit(odd, one)).collect())


def test_labels_of_held_out_rows_are_not_learned(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_sample_bounds(tables):
    docs, labels = tables
    few = labelled_sample(docs, labels, "quality", per_class=10, max_chars=10**9)
    assert len(few) == 20 and few["y"].sum() == 10
    short = labelled_sample(docs, labels, "quality", per_class=1000, max_chars=20000)
    assert 0 < short["text"].str.len().sum() <= 20000
    again = labelled_sample(docs.repartition(7), labels, "quality", per_class=10, max_chars=10**9)
    assert few.equals(again)


def test_attention_finds_the_passage(tables):
    model = quality.fit(*tables)
    clean = tables[0].join(tables[1], "doc_id").where("quality = 1 and n_chars between 3000 and 4000 and lang = 'en'").first()["text"]
    junk = "".join(f"word{i}%%% thing{i}### " for i in range(200))
    assert model.scores([clean])[0] > 0.5 > model.scores([junk])[0]


def test_filters_keep_columns(tables, odd):
    docs, labels = tables
    for kept in (quality.keep_good(odd, quality.fit(docs, labels)), toxicity.keep_clean(odd, toxicity.fit(docs, labels))):
        assert kept.columns == odd.columns
        kept.collect()


@pytest.mark.parametrize("long", [(0,), (1,), (0, 1)])
def test_a_text_beyond_the_budget_does_not_end_the_sample(spark, long):
    ids = [r["id"] for r in spark.range(200).where(~held_out(F.col("id"))).orderBy(F.xxhash64("id", F.lit(2025)), "id").collect()]
    y = {i: k % 2 for k, i in enumerate(ids)}
    over = {ids[k] for k in long}  # first in the order of the hash
    docs = spark.createDataFrame([(i, "x" * (5000 if i in over else 10)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, v in y.items()], "doc_id long, good int")
    got = labelled_sample(docs, labels, "good", 1000, 4000)
    assert len(got) == len(ids) - len(over) and set(got["text"].str.len()) == {10} and set(got["y"]) == {0, 1}
    only = labelled_sample(docs.where(F.length("text") > 10), labels, "good", 1000, 4000)
    assert sorted(only["y"]) == sorted({y[i] for i in over})


def test_repeated_ids_give_one_text_each(spark):
    rows = [(i, f"text {i} {k}") for i in range(60) for k in range(4)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 1 - i % 2) for i in range(0, 60, 7)], "doc_id long, good int")
    one = labelled_sample(docs.repartition(7), labels, "good", 1000, 10**6)
    assert one.equals(labelled_sample(docs.orderBy(F.desc("text")).coalesce(1), labels, "good", 1000, 10**6))
    ids = one["text"].str.split().str[1]
    assert ids.is_unique and len(one) == spark.range(60).where(~held_out(F.col("id"))).count()
    few = labelled_sample(docs, labels, "good", 1000, 40)
    assert 0 < few["text"].str.len().sum() <= 40


def plain_sample(docs, labels, per_class):
    """Which ids are in the sample, in plain Python but for the hash of their order."""
    order = {r["id"]: r["h"] for r in labels.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", F.lit(2025)).alias("h")).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = []
    for y in (0, 1):
        own = sorted((order[r["doc_id"]], r["doc_id"]) for r in labels.collect() if r["toxic"] == y and zlib.crc32(str(r["doc_id"]).encode()) % 5)
        out += [(h, texts[i], y) for h, i in own[:per_class] if i in texts]
    return [(t, y) for _, t, y in sorted(out)]


def test_sample_is_that_of_plain_python(tables):
    docs, labels = tables
    got = labelled_sample(docs, labels, "toxic", per_class=30, max_chars=10**9)
    assert list(zip(got["text"], got["y"], strict=True)) == plain_sample(docs, labels, 30)


TEXTS = ["", "a", "Ab cd!", "plain words stand here, plain words.", "日本語 é ñ 12", "x" * 1200, "the the the cat %%% sat 12 " * 60]


def test_passages_counted_by_hand():
    """What passages have that can be counted plainly: shares of letters, digits and blanks, upper case, byte pairs, repeated words."""
    vectors, bags = quality.encode(TEXTS)
    assert bags.tolist() == [max(1, -(-len(t.encode()) // quality.PASSAGE)) for t in TEXTS]
    at = 0
    for t, n in zip(TEXTS, bags, strict=True):
        raw = t.encode()
        for k in range(n):
            part, v = raw[k * quality.PASSAGE : (k + 1) * quality.PASSAGE], vectors[at]
            size = max(1, len(part))
            for letter in range(26):
                assert v[letter] == pytest.approx(sum(b | 32 == 97 + letter and chr(b).isalpha() and b < 128 for b in part) / size, abs=1e-6)
            assert v[26] == pytest.approx(sum(48 <= b < 58 for b in part) / size, abs=1e-6)
            assert v[59] == pytest.approx(sum(b in (32, 9) for b in part) / size, abs=1e-6)
            assert v[64] == pytest.approx(sum(65 <= b < 91 for b in part) / size, abs=1e-6)
            pairs = {}
            for a, b in zip(part, part[1:]):  # noqa: B905
                h = (a * 257 + b) * 2654435761 % 2**32 >> 22
                pairs[h] = pairs.get(h, 0) + 1
            total = max(1, sum(pairs.values()))
            assert v[65] == pytest.approx(math.sqrt(sum((c / total) ** 2 for c in pairs.values())), abs=1e-5)
            assert v[66] == pytest.approx(len(pairs) / min(size, 1024), abs=1e-6)
            at += 1


def plain_score(model, text):
    """The score by the formula, number by number."""
    vectors, _ = quality.encode([text])
    p, sigmoid = model.p, lambda x: 1 / (1 + math.exp(-x))
    h = [[(float(x) - m) / s for x, m, s in zip(v, model.mean, model.scale, strict=True)] for v in vectors]
    gates = []
    for v in h:
        terms = [math.tanh(sum(x * w for x, w in zip(v, p["V"][:, u], strict=True))) * sigmoid(sum(x * w for x, w in zip(v, p["U"][:, u], strict=True))) for u in range(p["V"].shape[1])]
        gates.append(math.exp(sum(t * w for t, w in zip(terms, p["w"], strict=True))))
    weights = [g / sum(gates) for g in gates]
    z = [sum(a * v[j] for a, v in zip(weights, h, strict=True)) for j in range(quality.WIDTH)]
    return sigmoid(sum(c * x for c, x in zip(p["c"], z, strict=True)) + p["b"][0])


def test_attention_score_number_by_number(tables):
    model = quality.fit(*tables, per_class=60, epochs=2)
    assert [model.scores([t])[0] for t in TEXTS] == pytest.approx([plain_score(model, t) for t in TEXTS], abs=1e-5)


def test_gradients_are_differences():
    rng = np.random.default_rng(0)
    bags, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    h = rng.normal(0, 1, (6, quality.WIDTH))
    p = {"V": rng.normal(0, 0.2, (quality.WIDTH, 3)), "U": rng.normal(0, 0.2, (quality.WIDTH, 3)), "w": rng.normal(0, 1, 3), "c": rng.normal(0, 0.3, quality.WIDTH), "b": np.array([0.1])}

    def loss():
        logit = quality._forward(p, h, bags)["logit"]
        return float(np.mean(np.logaddexp(0, logit) - y * logit)) + 0.5e-4 * sum(float((p[k] ** 2).sum()) for k in ("V", "U", "c"))

    for name, g in quality._gradients(p, h, bags, y, 1e-4).items():
        for place in [tuple(rng.integers(0, d) for d in g.shape) for _ in range(6)]:
            kept, e = p[name][place], 1e-5
            p[name][place] = kept + e
            up = loss()
            p[name][place] = kept - e
            down = loss()
            p[name][place] = kept
            assert g[place] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def plain_buckets(text):
    """The buckets of a text's 3-, 4- and 5-grams, one character at a time."""
    codes = [ord(c) for c in f"  {text.lower()}  "]
    mul = lambda x, m: x * int(m) % 2**32
    found = set()
    for i in range(len(codes)):
        h = mul(codes[i], toxicity._MIX[0])
        for n in range(2, max(toxicity.ORDERS) + 1):
            if i + n > len(codes):
                break
            h = (mul(h ^ h >> 15, toxicity._MIX[1]) + mul(codes[i + n - 1], toxicity._MIX[0])) % 2**32
            if n in toxicity.ORDERS:
                found.add((h ^ h >> 13) >> 32 - toxicity.BITS)
    return found


def test_buckets_ratios_and_scores_by_hand(tables):
    rows, buckets = toxicity.buckets(TEXTS)
    got = {i: set() for i in range(len(TEXTS))}
    for r, b in zip(rows.tolist(), buckets.tolist(), strict=True):
        got[r].add(b)
    assert got == {i: plain_buckets(t) for i, t in enumerate(TEXTS)}
    toxic, other = np.array([5.0, 0.0, 2.0]), np.array([1.0, 3.0, 2.0])
    assert toxicity.log_count_ratio(toxic, other) == pytest.approx([math.log((a + 1) / 10 / ((b + 1) / 9)) for a, b in zip(toxic, other, strict=True)])
    model = toxicity.fit(*tables)
    for t, score in zip(TEXTS, model.scores(TEXTS), strict=True):
        assert score == pytest.approx(1 / (1 + math.exp(-model.bias - sum(float(model.weights[b]) for b in plain_buckets(t)))), abs=1e-6)


def test_weights_go_with_the_ratio(tables):
    """Every weight is a bucket's log-count ratio times what the regression gave it: 0 where no bucket differs enough."""
    docs, labels = tables
    sample = labelled_sample(docs, labels, "toxic", 4000, 24_000_000)
    counts = [{}, {}]
    for t, y in zip(sample["text"], sample["y"], strict=True):
        for b in plain_buckets(t[:400]):
            counts[y][b] = counts[y].get(b, 0) + 1
    model = toxicity.fit(docs.withColumn("text", F.substring("text", 1, 400)), labels)
    n = [int((sample["y"] == y).sum()) for y in (0, 1)]
    for b in np.flatnonzero(model.weights).tolist():
        s0, s1 = counts[0].get(b, 0) / n[0], counts[1].get(b, 0) / n[1]
        mean = (counts[0].get(b, 0) + counts[1].get(b, 0)) / sum(n)
        assert abs(s1 - s0) / math.sqrt(mean * (1 - mean) * (1 / n[0] + 1 / n[1])) >= 5 - 1e-9


LONG = ["word and more words of it, word word\n" * 40, "x" * 5000, " " * 3000, ("ab " * 700 + "y" * 2100 + " ") * 2, "é😀 Σ σς " * 300, "Σ" * 900, "a", "", " \n"]


@pytest.mark.parametrize("passages", [1, 2, 3])
def test_pieces_of_a_long_text_give_the_vectors_of_the_whole(monkeypatch, passages):
    whole, sizes = quality.encode(LONG)
    draw = np.random.default_rng(passages)
    p = {"V": draw.normal(0, 0.1, (quality.WIDTH, 8)), "U": draw.normal(0, 0.1, (quality.WIDTH, 8)), "w": draw.normal(0, 1, 8), "c": draw.normal(0, 0.2, quality.WIDTH), "b": np.array([0.1])}
    model = quality.QualityModel(whole.mean(axis=0), whole.std(axis=0) + 0.02, p)
    scores = model.scores(LONG)
    monkeypatch.setattr(quality, "PIECE", passages * quality.PASSAGE)
    pieces, again = quality.encode(LONG)
    assert np.array_equal(sizes, again) and np.array_equal(whole, pieces)
    assert np.abs(model.scores(LONG) - scores).max() <= 2e-9


def test_a_text_is_scored_alike_in_any_company():
    starts = np.cumsum([0, *quality.encode(LONG)[1]])
    together = quality.encode(LONG)[0]
    for i, text in enumerate(LONG):
        assert np.array_equal(quality.encode([text])[0], together[starts[i] : starts[i + 1]])
    assert not quality.encode([""])[0].any()


@pytest.mark.parametrize("chars", [1, 7, 1000])
def test_pieces_of_a_long_text_have_its_n_grams(chars):
    keep = np.random.default_rng(chars).random(1 << toxicity.BITS) < 0.5
    for only in (None, keep):
        row, bucket = toxicity.buckets(LONG, only)
        again, same = toxicity.buckets(LONG, only, chars)
        assert np.array_equal(row, again) and np.array_equal(bucket, same)


def test_work_space_does_not_grow_with_a_text():
    text = "some words stand here and 12 more " * 600_000
    p = {"V": np.zeros((quality.WIDTH, 24)), "U": np.zeros((quality.WIDTH, 24)), "w": np.zeros(24), "c": np.ones(quality.WIDTH), "b": np.zeros(1)}
    models = quality.QualityModel(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), p), toxicity.ToxicityModel(np.ones(1 << toxicity.BITS, np.float32), 0.0)
    for model in models:
        tracemalloc.start()
        assert len(model.scores([text])) == 1
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # a copy or two of the text, and the space of one piece
        assert peak < 3 * len(text) + 60_000_000
