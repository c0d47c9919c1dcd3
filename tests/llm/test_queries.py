"""The registered queries on small tables against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concord.llm import decontaminate, langid, quality, queries, tokens
from tests.llm.test_operators import DOCS, LONG, TEXTS, brute_hits, classes_of, slow_fingerprint

R = random.Random(17)
POOLS = {"en": "the and this with from that have would there water house".split(), "de": "und der nicht mit eine haben würde auch über wasser haus".split()}
ITEMS = [("a", " ".join(R.choices(POOLS["en"], k=14))), ("b", "Über das Haus"), ("c", None), ("a", "Über das Haus"), (None, " ".join(R.choices(POOLS["de"], k=10)))]


def texts():
    out = [*TEXTS]
    for i in range(60):
        out.append(" ".join(R.choices(POOLS["en" if i % 2 else "de"], k=R.randint(5, 40))) + ("!! | " * 3 if i % 3 == 0 else "."))
    out += [out[20], out[21] + " x", f"So: {ITEMS[0][1]}.", f"{ITEMS[4][1]} über das haus", "Über, das HAUS"]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    body = texts()
    rows = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t)) for i, t in enumerate(body)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("fp", "score", "spans", "items", "piece", "length", "file", "ordinal", "hits")})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(len(body)) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, body


def run(spark, tables, name):
    return queries.queries()[name](spark, tables[0]).collect()


def test_packing(spark, tables):
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    want, held, rows = {}, {}, run(spark, tables, "op1_best_fit_packing")
    for i, t in enumerate(tables[1]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(held) == -(-sum(n for _, n, _ in want.values()) // 2048)


def test_language(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    model = langid.fit(docs, ~langid.held_out())
    for r in run(spark, tables, "op3_language_id"):
        words = langid.words_of(tables[1][r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = np.sum([langid.forward(w, model.weights, model.floor, model.longest) for w in words], axis=0)
        assert r.lang_pred == model.languages[int(total.argmax())] and r.score == pytest.approx(1 / np.exp(total - total.max()).sum())


def test_near_duplicates(spark, tables):
    prints = [slow_fingerprint(t) for t in tables[1]]
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, tables, "op4_simhash_near_dedup")}
    assert rows == {i: (f"{fp:016x}", c) for i, (fp, c) in enumerate(zip(prints, classes_of(prints)))}


def test_decontamination(spark, tables):
    rows = run(spark, tables, "op7_benchmark_decontamination")
    assert len(rows) == len(tables[1]) and any(r.n_items > 1 for r in rows)
    for r in rows:
        n, hit, items = brute_hits(tables[1][r.doc_id], ITEMS)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0)
    assert decontaminate.WINDOW == 10


def test_token_counts(spark, tables):
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    tok.encode_special_tokens = True
    rows = run(spark, tables, "op8_token_counts")
    assert {r.doc_id: (r.n_tokens, r.closed) for r in rows} == {i: (len(tok.encode(t or "", add_special_tokens=False).ids), True) for i, t in enumerate(tables[1])}


def test_quality(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables[0]}/{n}.parquet") for n in ("documents", "labels"))
    m = quality.fit(docs, labels, ~langid.held_out())
    for r in run(spark, tables, "op10_quality_classifier"):
        text = tables[1][r.doc_id]
        if text == LONG or len(text or "") > 4000:
            continue
        at, stats = quality._features(text, None if text is None else len(text), quality.Words())
        x = np.clip((np.array(stats) - m.mean) / m.scale, -8, 8)
        parts = [(1 / at.size, m.linear[b], m.factors[b]) for b in at] + [(v, m.linear[quality.BUCKETS + k], m.factors[quality.BUCKETS + k]) for k, v in enumerate(x)]
        logit = m.bias + sum(v * w for v, w, _ in parts)
        logit += sum(a * b * float(f @ g) for i, (a, _, f) in enumerate(parts) for b, _, g in parts[:i])
        assert r.score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9) and r.predicted == int(r.score >= 0.7)
