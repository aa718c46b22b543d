"""Suffix-order dedup, target resampling and source divergence against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import LOWER
from tidewatch.llm import divergence, resample, suffixes

DOCS = "doc_id long, text string, lang string, source string, start int, score string"


def removed(docs, depth=50):
    """{(id, text): covered bytes} under strings of an earlier document; docs is [(id, text)]."""
    first = {}
    for doc, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - depth + 1):
            k = b[i:i + depth]
            first[k] = min(first.get(k, math.inf), math.inf if doc is None else doc)
    out = {}
    for doc, text in docs:
        b, gone = (text or "").encode(), set()
        for i in range(len(b) - depth + 1):
            if first[b[i:i + depth]] < (math.inf if doc is None else doc):
                gone.update(range(i, i + depth))
        out[doc, text] = gone
    return out


def runs(gone):
    return sum(1 for i in gone if i - 1 not in gone)


@pytest.fixture(scope="module")
def passages():
    rnd = random.Random(5)
    vocabulary = ["ab", "tide", "ökonom", "日本", "watch", "x" * 70, "\n", "the", "sea"]
    make = lambda n: " ".join(rnd.choice(vocabulary) + str(rnd.randint(0, 40)) for _ in range(n))
    shared = [make(12) for _ in range(6)]
    docs = [(i, make(rnd.randint(0, 30)) + rnd.choice(shared) + make(rnd.randint(0, 20)) + rnd.choice(shared)) for i in range(60)]
    docs += [(60, docs[3][1]), (61, docs[3][1][7:]), (62, None), (63, ""), (64, "short"), (65, "a" * 400), (66, "a" * 120), (None, docs[5][1]),
             (None, docs[5][1]), (7, "again " + docs[9][1]), (67, "y" * 49 + shared[0]), (68, (make(3000) + shared[1]) * 2)]
    return docs


def test_suffix_dedup_equals_brute_force(spark, passages):
    df = spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in passages], DOCS)
    want = removed(passages)
    for hot in (suffixes.HOT, 1):  # 1: every anchor with two pieces goes by windows
        rows = suffixes.report(df.repartition(5), hot=hot).collect()
        assert len(rows) == len(passages)
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
        expect = Counter()
        for doc, text in passages:
            b, gone = (text or "").encode(), want[doc, text]
            kept = bytes(x for i, x in enumerate(b) if i not in gone)
            expect[doc, len(b), len(gone), runs(gone), hashlib.sha256(kept).hexdigest()] += 1
        assert got == expect
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in rows}
    assert spans[60] == [(0, len(passages[3][1].encode()))]


def test_suffix_dedup_texts_and_empty_table(spark, passages):
    df = spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in passages], DOCS)
    out = suffixes.dedup(df)
    assert out.columns == df.columns
    want = removed(passages)
    expect = Counter()
    for doc, text in passages:
        kept = None if text is None else bytes(x for i, x in enumerate(text.encode()) if i not in want[doc, text]).decode("utf-8", "ignore")
        expect[doc, kept] += 1
    assert Counter((r.doc_id, r.text) for r in out.collect()) == expect
    assert suffixes.report(df.limit(0)).collect() == [] and suffixes.dedup(df.limit(0)).collect() == []


def test_column_wise_order_finds_owners():
    rnd = random.Random(2)
    for _ in range(200):
        letters = rnd.choice([b"ab", b"a\x00", bytes(range(256))])
        strings = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(rnd.randint(1, 8))]
        owners, depth = np.array([rnd.randint(0, 5) for _ in strings]), rnd.choice([2, 3, 5])
        for s, got in zip(strings, suffixes.earliest_owners(strings, owners, depth)):
            assert got.tolist() == [min(o for t, o in zip(strings, owners) if s[i:i + depth] in t) for i in range(len(s) - depth + 1)]


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def plain_scores(docs, target, buckets=10_000, seed=7):
    def features(text):
        w = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = (Counter(f for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * total_s / (float(s[b] + 1) * total_t))) for b in range(buckets)}
    out = []
    for doc, text in docs:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    return out


def test_resampling_equals_the_plain_version(spark):
    rnd = random.Random(3)
    vocabulary = ["tide", "WATCH", "naïve", "x1", "日本", "a", "w" * 90, "sea-level", "B2B"]
    docs = [(i * 7 % 101, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for i in range(101)]
    docs += [(200, None), (201, ""), (202, "?!"), (None, " ".join(vocabulary * 4)), (None, " ".join(vocabulary * 4)), (203, "tide " * 40_000)]
    target = [" ".join(rnd.choice(vocabulary[:4]) for _ in range(50)) for _ in range(5)] + [None]
    df = spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in docs], DOCS).repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    want = plain_scores(docs, target)
    order = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for percent in (25, 100, 1, 0):
        rows = resample.resample(df, goal, percent).collect()
        assert Counter(tuple(r[k] for k in ("doc_id", "n_words", "n_features", "weight", "score")) for r in rows) == Counter(want)
        drawn = sorted((r["rank"], r.doc_id) for r in rows if r["rank"] is not None)
        assert drawn == [(i + 1, r[0]) for i, r in enumerate(order[:len(order) * percent // 100])]
    ranked = resample.resample(df, goal)
    kept = resample.drawn_documents(df, ranked)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in ranked.where("rank is not null").collect()}
    assert resample.resample(df.limit(0), goal).collect() == []
    assert resample.resample(df, goal.limit(0)).where("rank is not null").count() == len(order) // 4


def test_ties_with_the_cut_go_to_smaller_ids(spark):
    rows = [(i, 0, 30, 10, 5, 100) for i in range(40)] + [(i, 0, 30, 10, 5, 200) for i in (50, 51, 52)] + [(None, i, 30, 10, 5, 100) for i in (1, 2, 3)] + [(99, 0, 19, 10, 5, 900)]
    scored = spark.createDataFrame(rows, "doc_id long, tie long, n_words long, n_features long, weight long, score long")
    for percent in (25, 90, 97):
        drawn = sorted((r["rank"], r.doc_id) for r in resample.draw(scored, percent).collect() if r["rank"] is not None)
        order = [50, 51, 52, *range(40), None, None, None][:46 * percent // 100]
        assert [d for _, d in drawn] == order and [k for k, _ in drawn] == list(range(1, len(order) + 1))


def plain_audit(docs, min_docs, top=10):
    said = [(lang or "", source or "", Counter(words(text, r"[^\x00-\x60\x7B-\x7F]+"))) for lang, source, text in docs]
    out = []
    for lang in {s[0] for s in said}:
        here = [s for s in said if s[0] == lang]
        often = Counter(t for s in here for t in s[2])
        kept = [t for t, n in often.items() if n >= min_docs]
        count = {src: Counter() for _, src, _ in here}
        for _, src, c in here:
            count[src].update({t: c[t] for t in kept if c[t]})
        whole = sum(count.values(), Counter())

        def p(c):
            total = sum(c.values())
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        prob, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            pairs = [(-sum(f(prob[s][t], prob[o][t]) for t in kept), o.encode(), o) for o in count if o != s]
            terms = [(-f(prob[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and prob[s][t] > q[t]]
            out += [(lang, s, part, item, -v, i + 1) for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for i, (v, _, item) in enumerate(rows)]
    return sorted(out)


@pytest.fixture(scope="module")
def sources():
    rnd = random.Random(4)
    vocabulary = ["Tide", "watch", "naïve", "日本", "É", "sea", "don't", "b2b"] + ["w" + chr(97 + i) for i in range(20)]
    docs = [(rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "", "ü", None, "z"]), " ".join(rnd.choices(vocabulary, range(1, 29), k=rnd.randint(0, 25)))) for _ in range(120)]
    return docs + [("fr", "alone", "rare words here"), ("en", "silent", None), ("es", "p", ""), ("es", "q", "12 34"), ("en", "twice", docs[0][2]), ("en", "twice", docs[0][2])]


@pytest.mark.parametrize("bits", [64, 3])  # three bits: every digest is shared by several terms
def test_divergence_equals_the_plain_version(spark, sources, bits, monkeypatch):
    df = spark.createDataFrame([(i, t, lang, src, 1, "z") for i, (lang, src, t) in enumerate(sources)], DOCS).repartition(4)
    if bits == 3:
        monkeypatch.setattr(divergence, "BLOCK_ROWS", 40)
    for min_docs in (10, 1):
        got = sorted(tuple(r) for r in divergence.audit(df, min_docs, bits=bits).collect())
        assert got == plain_audit(sources, min_docs)


def test_divergence_of_many_sources_and_no_rows(spark, sources, monkeypatch):
    docs = [("en", f"s{i}", t) for i, (_, _, t) in enumerate(sources) if i < 40]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    monkeypatch.setattr(divergence, "TILE", 7)
    monkeypatch.setattr(divergence, "CELLS", 20)
    groups = divergence._groups(*(lambda d: (d, divergence.kept_terms(d, 2)[0]))(divergence._plain(df, "lang", "source", "text")))
    assert groups.count() == 40
    got = sorted(tuple(r) for r in divergence.audit(df, 2).collect())
    assert got == plain_audit(docs, 2)
    assert divergence.audit(df.limit(0)).collect() == []
    assert divergence.audit(df.where(F.lit(False)).union(spark.createDataFrame([(None, None, None)], df.schema))).collect() == []


def test_surrogates_keep_distinctness_coreference_and_format(spark):
    """Random entities against plain Python facts: one replacement an entity,
    no two alike, none real, domains too, the text around them untouched."""
    import random
    import re

    from tidewatch.llm import surrogates
    rng = random.Random(5)

    def card() -> str:
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if _luhn(body + c))

    word = lambda n: "".join(rng.choice("bcdfghkmnprst") for _ in range(n))
    hosts = [f"{word(4)}{k}.co" for k in range(150)]
    pools = {"email": [f"{word(5)}{k}@{rng.choice(hosts)}" for k in range(400)],
             "ip": [f"10.{k}.{k * 7 % 256}.9" for k in range(60)], "card": [card() for _ in range(60)],
             "phone": [f"+1 (2{k:02d}) 555-{1000 + k}" for k in range(60)]}
    rows, mentions = [], {}
    for doc in range(300):
        picked = [(kind, rng.choice(pool)) for kind, pool in pools.items() for _ in range(rng.randint(0, 3))]
        rng.shuffle(picked)
        mentions[doc] = picked
        rows.append((doc, " ".join(f"w{i} {e} ," for i, (_, e) in enumerate(picked)) + " end"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    new, domains = {}, {}
    for r in surrogates.report(df, "key").collect():
        shape = re.escape(rows[r.doc_id][1])
        for _, e in mentions[r.doc_id]:
            shape = shape.replace(re.escape(e), r"(.+?)", 1)
        got = re.fullmatch(shape, r.text)
        assert got and r.n_entities == len(mentions[r.doc_id])
        for (kind, e), w in zip(mentions[r.doc_id], got.groups()):
            assert new.setdefault((kind, e), w) == w
            assert kind == "ip" or re.sub(r"[a-z]+", "a", re.sub(r"\d", "0", e)) == re.sub(r"[a-z]+", "a", re.sub(r"\d", "0", w)), (e, w)
            assert kind != "card" or (_luhn(w) and w[0] == e[0])
            if kind == "email":
                assert domains.setdefault(e.split("@")[1], w.split("@")[1]) == w.split("@")[1]
    for kind, pool in pools.items():
        mine = [w for (k, _), w in new.items() if k == kind]
        assert len(mine) == len(set(mine)) and not set(mine) & {e for k, e in new if k == kind}
    assert len(domains) == len(set(domains.values())) > 100 and not set(domains.values()) & set(domains)


def _luhn(digits: str) -> bool:
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
