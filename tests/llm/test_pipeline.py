import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quarrymill.llm import pii, quality, queries, toxicity
from quarrymill.llm.spans import replaced
from quarrymill.sources import read_table
from tests.llm.test_near_copies import brute


def test_stages_in_turn(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == columns, name
        assert 0.5 * before < out.count() <= before
        docs, before = out, out.count()
    assert docs.select("doc_id").distinct().count() == before


def by_hand(spark, sf_dir):
    """doc_id -> text that the stages before the last leave, row by row."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = quality.fit(docs, labels)
    texts = {i: t for i, t in texts.items() if good.scores([t])[0] >= 0.3}
    kept = docs.where(docs.doc_id.isin(list(texts)))
    clean = toxicity.fit(kept, labels)
    texts = {i: t for i, t in texts.items() if clean.scores([t])[0] < 0.5}
    least = brute(sorted(texts.items()))
    texts = {i: t for i, t in texts.items() if least[i] == i}
    private = pii.fit(docs.where(docs.doc_id.isin(list(texts))))
    return {i: replaced(t, private.spans(t)[1]) for i, t in texts.items()}


def test_run_is_that_of_single_rows(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    want = {}
    for i, t in by_hand(spark, sf_dir).items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[i, k] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in places.values():
        assert [a for a, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() and sum(n for _, n in v) <= 2048


def test_redacted_texts(spark, sf_dir):
    rows = [(1, "write to a.b@c.org or +1 (415) 555-0100, now"), (2, None), (3, ""), (4, "10.0.0.1 and 4111 1111 1111 1111.")]
    stage = dict(corpus_pipeline.STAGES)["pii"]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage(spark, spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_chars long"), sf_dir).collect()}
    assert got == {1: ("write to [EMAIL] or [PHONE], now", 32), 2: (None, None), 3: ("", 0), 4: ("[IP] and [CARD].", 16)}


def test_empty_table(spark, none, tmp_path, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)
    read_table(spark, sf_dir, "documents").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    read_table(spark, sf_dir, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents_pass_through(spark, odd, sf_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd.columns
        docs.collect()


def test_every_operator_is_registered():
    found = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert found == set(range(1, 14))
