"""Exact deduplication: the filter, its index, and the result against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import exactdedup
from concord.llm.cuckoo import DIGEST, CuckooFilter

SCHEMA = "doc_id long, text string"
TEXTS = ["", None, " ", "\n\t", "a", "a ", " a", "a  b", "a\n\x0bb", "a b", "a b", "é x", "é x", "x " * 40_000, "x  " * 40_000, *["hot text"] * 700, *[f"text {i}" for i in range(150)], *[f"text  {i}" for i in range(0, 150, 3)]]


def digests(numbers):
    return np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in numbers), np.uint8).reshape(-1, DIGEST)


@pytest.mark.parametrize("expected", [0, 4000])
def test_filter_against_a_counter(expected):
    r, live, table = random.Random(expected), Counter(), CuckooFilter(expected)
    for _ in range(30):
        some = [r.randrange(3000) for _ in range(r.randrange(400))]
        table.insert(digests(some), np.ones(len(some), np.int64))
        live.update(some)
        gone = r.sample(sorted(live.elements()), min(live.total(), r.randrange(250)))
        table.delete(digests(gone), np.ones(len(gone), np.int64))
        live.subtract(gone)
    table = CuckooFilter.from_row(*table.to_row())
    at = table.find(digests(range(3000)))
    assert [int(table.counts[k]) if k >= 0 else 0 for k in at] == [live[i] for i in range(3000)]
    assert table.may_hold(digests(range(3000)))[at >= 0].all() and len(table) == sum(n > 0 for n in live.values())
    assert table.may_hold(digests(range(10_000, 30_000))).mean() < 0.002
    assert (table.prints > 0).sum() == len(table)
    with pytest.raises(ValueError):
        table.delete(digests([99_999]), np.array([1]))


def test_filter_with_equal_prints_overflows_and_is_resized_from_its_keys():
    own = digests(range(64)).copy()
    own[:, :3] = 7  # one print, and places that agree in their last byte
    table = CuckooFilter()
    table.insert(own, np.arange(1, 65))
    assert table.resized and (table.counts[table.find(own)] == np.arange(1, 65)).all()


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return Counter(out)


@pytest.mark.parametrize("length, most, bucket", [(32, 1 << 20, 256), (32, 0, 50), (1, 1 << 20, 30)])
def test_against_brute_force(spark, length, most, bucket):
    rows = [(None if i % 90 == 17 else i - i % 60 % 2, t) for i, t in enumerate(TEXTS)]  # ids that repeat, and none
    random.Random(length).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("digest", "key", "group", "keep_id", "group_size", "kept", "first_text", "_row", "_part", "_to", "other")})
    found = exactdedup.deduplicate(docs.repartition(3), length=length, most=most, bucket_rows=bucket)
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_empty_table(spark):
    found = exactdedup.deduplicate(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_index_with_insertions_and_deletions(spark):
    frame = lambda rows: exactdedup.members_of(spark.createDataFrame(rows, SCHEMA))
    rows = [(i, f"t{i % 40}") for i in range(100)] + [(None, "none")]
    index = exactdedup.build(frame(rows), shard_rows=16)
    index = exactdedup.insert(index, frame([(1000 + i, f"t{i}") for i in range(35, 2000)]))
    index = exactdedup.delete(index, spark.createDataFrame([(i,) for i in [*range(0, 100, 7), 1036, 5, 5, None, 77777]], "id long"))
    left = [(i, t) for i, t in rows if i is not None and i % 7 and i != 5] + [(1000 + i, f"t{i}") for i in range(35, 2000) if i != 36]
    want = Counter(hashlib.sha256(t.encode()).digest() for _, t in left)
    held = {}
    for r in index.shards.collect():
        table = CuckooFilter.from_row(r.prints, r["keys"], r.digests, r["counts"])
        held |= {d.tobytes(): int(n) for d, n in zip(table.digests, table.counts) if n}
        assert (table.counts[table.find(table.digests[table.counts > 0])] > 0).all()
    assert held == want
    assert Counter((r.doc_id, bytes(r.digest)) for r in index.members.collect()) == Counter((i, hashlib.sha256(t.encode()).digest()) for i, t in left)
    may = exactdedup.copied(index)
    assert {bytes(r.digest) for r in index.members.filter(may(F.col("digest"))).collect()} >= {d for d, n in want.items() if n > 1}


def test_query(spark, tmp_path):
    from concord.llm import queries

    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert Counter(map(tuple, queries.queries()["op13_exact_dedup"](spark, f"file://{tmp_path}").collect())) == brute(rows)
