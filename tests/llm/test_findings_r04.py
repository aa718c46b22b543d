"""Suffix-order dedup sends blocks of rows and orders only suffixes at one distance from their anchors."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_round3 import passages, removed, runs  # noqa: F401
from tidewatch.llm import suffixes

DOCS = "doc_id long, text string"


def test_owners_by_column_equal_brute_force():
    rnd, reach = random.Random(4), 4
    for _ in range(100):
        count, letters = rnd.randint(0, 40), rnd.choice([b"ab", b"a\x00", b"abc"])
        at = np.array([rnd.randint(0, reach) for _ in range(count)], dtype=np.uint8)
        windows = np.array([rnd.randint(1, a + 1) for a in at.tolist()], dtype=np.uint8)
        group, owners = (np.array([rnd.randint(0, n) for _ in range(count)], dtype=np.int64) for n in (2, 9))
        left, right = np.zeros((count, reach), np.uint8), np.zeros((count, reach), np.uint8)
        held, window = {}, {}
        for i, (a, n) in enumerate(zip(at.tolist(), windows.tolist())):
            left[i, reach - a:] = [rnd.choice(letters) for _ in range(a)]
            right[i, :n - 1 + reach - a] = [rnd.choice(letters) for _ in range(n - 1 + reach - a)]
            for k in range(a - n + 1, a + 1):
                window[i, k] = group[i], k, bytes(left[i, reach - k:]), bytes(right[i, :reach - k])
                held[window[i, k]] = min(held.get(window[i, k], 99), owners[i])
        got = suffixes.owners_by_column(group, left, right, at, windows, owners)
        assert got.shape == (count, reach + 1)
        for i in range(count):
            for k in range(reach + 1):
                assert got[i, k] == (held[window[i, k]] if (i, k) in window else np.iinfo(np.int64).max)


@pytest.mark.parametrize("hot", [suffixes.HOT, 2, 1])
def test_many_buckets_equal_brute_force(spark, passages, monkeypatch, hot):  # noqa: F811
    monkeypatch.setattr(suffixes, "BUCKET", 1500)  # dozens of buckets for pieces, several for cuts
    want = removed(passages)
    rows = suffixes.report(spark.createDataFrame(passages, DOCS).repartition(3), hot=hot).collect()
    expect = Counter((d, len((t or "").encode()), len(want[d, t]), runs(want[d, t])) for d, t in passages)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rows) == expect


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_a_task_sends_a_block_for_each_bucket(spark, hot):
    line = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{i} {line} {i}") for i in range(300)], DOCS).coalesce(1)
    docs, buckets = suffixes._documents(df, "doc_id", "text"), 4
    anchors = suffixes.repeated_anchors(docs, buckets, hot)
    wide = np.sort(np.array([(r.bucket << 32) | r.anchor for r in anchors.where("hot").collect()], dtype=np.uint64))
    assert (len(wide) > 0) == (hot == 1)
    sent = suffixes.occurrences(docs, suffixes.bitmap(anchors), wide, buckets)
    # one row a piece before: thousands
    assert sent.count() <= 3 * 2 * buckets
    held = sent.groupBy((F.col("bucket") < buckets).alias("pieces")).agg(F.sum("n").alias("n")).collect()
    n = {r.pieces: r.n for r in held}
    # of the line's pieces only those of the first document are sent, and the two at the ends of each text
    assert n[False] > (5 if hot > 1 else 1) * n[True]
