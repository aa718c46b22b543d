"""Line dedup, paragraph dedup, n-gram Jaccard join, mixing, search, surrogates
and the pipeline against plain Python versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import jaccard, lines, mixing, paragraphs, search, surrogates


def prose(rng, n, words=400):
    return " ".join(f"w{i}" for i in rng.integers(0, words, n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, nulls, empties, one long text."""
    rng = np.random.default_rng(5)
    docs = [prose(rng, int(n)) for n in rng.integers(1, 120, 60)]
    passage, short = prose(rng, 60), "All rights kept here now"
    for i in range(0, 30, 3):
        docs[i] = f"{docs[i]}\n{passage}\n{short}\nThe.\n{docs[i + 1][:40]}"
    for i in range(30, 40):  # near copies of one text, each with another word changed
        w = docs[30].split() if len(docs[30].split()) > 60 else (docs[30] + " " + prose(rng, 90)).split()
        if i > 30:
            w[i] = f"x{i}"
        docs.append(" ".join(w))
    docs += [docs[3], docs[3], docs[5].upper(), "a b", "A  B", "a b c", None, "", " \n ", "\n\n" + passage, prose(rng, 30_000, 90_000)]
    return dict(enumerate(docs))


def frame(spark, corpus, more=()):
    rows = [(k, t, "a", "b", 1, 2) for k, t in corpus.items()] + [(*m, "a", "b", 1, 2) for m in more]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, _key string, line int, n int")


def test_lines(spark, corpus):
    df = frame(spark, corpus, [(3, corpus[3])])
    want = brute.later_lines({k: t for k, t in corpus.items() if k != 80} | {80: corpus[80][:10]})
    got = {(r.doc_id, int(x)) for r in lines.report(df).collect() for x in r.deleted_lines.split(",") if x}
    assert got == {w for w in want if w[0] != 80}
    out = lines.dedup(df)
    assert out.columns == df.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    for k, t in corpus.items():
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in got)
        gone = {w for w in got if w[0] == k}
        if gone and not brute.WORD.search(left):
            assert k not in kept
        else:
            assert kept[k] == left
    assert lines.report(df.limit(0)).collect() == [] and lines.dedup(df.limit(0)).collect() == []


def test_line_runs_of_many_lines(spark):
    body = [f"l{i}" for i in range(23)]  # short lines count only as a run
    docs = {0: "\n".join(body), 1: "\n".join(["x", *body[2:9], "y", *body[11:23]]), 2: "\n".join(body[4:7]), 3: "\n".join(body * 3), 4: "l1\nl1\nl1\nl1\nl1\nl1\nl1"}
    df = spark.createDataFrame([*docs.items(), (None, "l0\nl1\nl2\nl3\nl4\nl5")], "doc_id long, text string")
    want = brute.later_lines({-1: "l0\nl1\nl2\nl3\nl4\nl5", **docs})
    got = {(-1 if r.doc_id is None else r.doc_id, int(x)) for r in lines.report(df).collect() for x in r.deleted_lines.split(",") if x}
    assert got == want and (1, 1) in got and not [g for g in got if g[0] == 2]


def test_paragraphs(spark, corpus):
    df = frame(spark, corpus, [(3, corpus[3]), (None, corpus[3])])
    places = {(k, i): (a, b) for k, t in corpus.items() for i, a, b in brute.paragraphs(t)}
    want = {p: f for p, f in brute.linked_components({(k, i): brute.shingles(corpus[k][a:b]) for (k, i), (a, b) in places.items()}).items() if p != f}
    rows = paragraphs.repeated_paragraphs(df).collect()
    got = {(r.doc_id, r.piece): (r.first_doc_id, r.first_piece) for r in rows if r.doc_id is not None}
    assert got == want and len(want) > 30
    assert {r.piece for r in rows if r.doc_id is None} == {i for i, _, _ in brute.paragraphs(corpus[3])}
    assert all((r.start, r.end) == places[r.doc_id, r.piece] for r in rows if r.doc_id is not None)
    assert paragraphs.repeated_paragraphs(df.limit(0)).collect() == []


def test_paragraph_dedup(spark, corpus):
    df = frame(spark, corpus, [(3, corpus[3]), (None, corpus[3]), (5, "another text of the same id")])
    places = {(k, i): (a, b) for k, t in corpus.items() for i, a, b in brute.paragraphs(t)}
    first = brute.linked_components({(k, i): brute.shingles(corpus[k][a:b]) for (k, i), (a, b) in places.items()})
    want = {}
    for k, t in corpus.items():
        gone = [places[p] for p, f in first.items() if p[0] == k and f != p]
        want[k] = t and "".join(c for i, c in enumerate(t) if not any(a <= i < b for a, b in gone))
    out = paragraphs.dedup(df)
    rows = out.collect()
    assert out.columns == df.columns and len(rows) == len(corpus) + 3
    assert all(r.text == want[r.doc_id] for r in rows if r.doc_id not in (None, 5))
    assert [r.text for r in rows if r.doc_id is None] == [corpus[3]]
    assert {r.text for r in rows if r.doc_id == 5} == {corpus[5], "another text of the same id"}


def test_passages_across_and_inside_lines(spark):
    """Passages of 51 to 90 words, planted anywhere and with other line breaks, are found."""
    rng = np.random.default_rng(8)
    docs, planted = {}, {}
    for i in range(60):
        passage = prose(rng, int(rng.integers(51, 91)), 50_000).split(" ")
        for d in (2 * i, 2 * i + 1):
            body = prose(rng, 150, 50_000).split(" ")
            at = int(rng.integers(0, 150))
            words = [*body[:at], *passage, *body[at:]]
            docs[d] = "".join(w + (" " if rng.integers(9) else "\n") for w in words)
        planted[2 * i + 1] = (len(" ".join(words[:at])), len(" ".join(words[:at + len(passage)])))
    for d in range(120, 160):
        docs[d] = prose(rng, 200, 50_000)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    rows = paragraphs.repeated_paragraphs(df).collect()
    assert {r.doc_id for r in rows} <= set(planted)
    assert len({r.doc_id for r in rows}) >= 57
    for r in rows:
        assert r.first_doc_id == r.doc_id - 1
        begin, end = planted[r.doc_id]  # a near copy may hold a few words beside the passage
        assert min(r.end, end) - max(r.start, begin) >= 0.7 * (r.end - r.start)


def test_paragraphs_of_a_templated_family(spark):
    """Pairs of notices link (12 of 14 shingles) inside a family that does not (11 of 15)."""
    base = [f"t{i}" for i in range(17)]
    docs = {}
    for i in np.random.default_rng(4).permutation(300).tolist():
        docs[i] = " ".join([f"pair{i // 2}", *base[1:-1], f"n{i}"])
    want = {k: c for k, c in brute.linked_components({k: brute.shingles(t) for k, t in docs.items()}).items() if k != c}
    assert want == {i: i - 1 for i in range(1, 300, 2)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.first_doc_id for r in paragraphs.repeated_paragraphs(df).collect()} == want


def test_jaccard(spark, corpus):
    df = frame(spark, corpus, [(3, corpus[3]), (None, corpus[3]), (None, "nowhere else a text")])
    sets = {k: brute.shingles(t) for k, t in corpus.items()}
    want = brute.linked_components({k: s for k, s in sets.items() if s}) | {k: k for k, s in sets.items() if not s}
    rows = jaccard.jaccard_components(df).collect()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in rows if r.doc_id is not None} == {k: len(s) for k, s in sets.items()}
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["3", "None"]
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([k for k in want if want[k] == k] + [3])
    assert jaccard.jaccard_components(df.limit(0)).collect() == []


def test_jaccard_large_group_of_near_copies(spark, monkeypatch):
    """Hot shingles, leaders, parts and chunks come into play."""
    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    rng = np.random.default_rng(9)
    base = prose(rng, 100).split()
    docs = {}
    for i in range(120):
        w = list(base)
        for j in rng.integers(0, 100, int(rng.integers(0, 5))):
            w[j] = f"y{i}"
        docs[i] = " ".join(w)
    for i in range(120, 150):  # a chain that drifts away
        w = docs[i - 1].split()
        w[(i * 7) % 100] = f"z{i}"
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute.linked_components({k: brute.shingles(t) for k, t in docs.items()})
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == want


def test_mixing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, int(rng.integers(0, 80))), s) for i, s in enumerate(["b"] * 200 + ["a"] * 20 + [None] * 90 + ["C"] * 60 + ["é"] * 2)]
    rows += [(5, rows[5][1], "b"), (None, None, "b"), (900, "", "empty")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, copies int, _nth string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        rate = (sum(size.values()) - sum(target.values())) / (sum(weight[s] for s in free) or 1)
        over = {s for s in free if rate * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= {s: rate * weight[s] for s in free}
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in order:
        assert abs(taken[s] - target[s]) <= 80 + 1e-6
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    out = mixing.emit(df, mixing.mix(df))
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert Counter(r.doc_id for r in out.collect()) == {k: v for k, v in sum((Counter({r.doc_id: r.copies}) for r in got), Counter()).items() if v}
    assert mixing.mix(df.limit(0)).collect() == []


def test_search(spark, corpus):
    docs = {k: t for k, t in corpus.items()}
    df = spark.createDataFrame([*docs.items(), (3, docs[3]), (None, docs[4])], "id long, text string")
    terms = {k: Counter(brute.WORD.findall((t or "").translate(brute.LOWER))) for k, t in docs.items()}
    rows = [*terms.items(), (3, terms[3])]
    n, mean = len(rows), sum(sum(c.values()) for _, c in rows) / len(rows)
    df_ = Counter(t for _, c in rows for t in c)
    queries = df.where("id in (0, 3, 30, 76, 77, 80)").dropDuplicates(["id"])
    got = {}
    for r in search.search(df, queries, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 5)))
    for q in (0, 3, 30, 80):
        scored = []
        for k, c in rows:
            length = sum(c.values())
            s = sum(m * math.log(1 + (n - df_[t] + .5) / (df_[t] + .5)) * c[t] * 2.2 / (c[t] + 1.2 * (.25 + .75 * length / mean)) for t, m in terms[q].items() if t in c)
            if s:
                scored.append((-round(s, 6), k))
        assert got[q] == [(k, round(-s, 5)) for s, k in sorted(scored)[:7]]
    assert set(got) == {0, 3, 30, 80}
    assert search.search(df.limit(0), queries).collect() == [] and search.search(df, queries.limit(0)).collect() == []


def test_search_prunes_without_loss(spark):
    import pyarrow as pa
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{i}" for i in rng.zipf(1.4, int(rng.integers(5, 60))) if i < 4000) or "t1" for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = search.build_index(df.coalesce(1)).collect()
    assert sum(r.n_docs for r in rows) == 1500
    batch = search.Batch([(q, *[x.astype(kind).tobytes() for x, kind in zip(list(search._counted(pa.record_batch({"i": [0], "text": [texts[q]]})))[0][:2], (np.uint64, np.int64))]) for q in range(40)])
    batch.idf[:] = 1.0
    table = pa.RecordBatch.from_pylist([r.asDict() for r in rows])
    asked = [(at, batch.idf[at] * c) for at, c in zip(batch.at, batch.count)]
    none = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked)
    best, everything = none, none
    for i in range(table.num_rows):
        shard = search.Shard(table, i, batch)
        best = shard.search(asked[:7], 10, best[:7]) + shard.search(asked[7:], 10, best[7:])
        everything = shard.search(asked, 10_000, everything)
    for x, y in zip(best, everything):
        assert x[1].tolist() == y[1][:10].tolist() and x[0].tolist() == y[0][:10].tolist()


PRIVATE = [(1, "Mail Ann.Lee@Mail5.Example.com or ann.lee@mail5.example.com, bob@mail5.example.com. +1 (564) 555-4526 and +1 564-555-4526 and 196.7.2.8 and 999.1.1.1 Card 4539 5787 6362 1486 x 4539578763621486."),
           (2, "Mrs. Anna Smith met Mr. Smith and MRS. X. Mrs. ANNA SMITH. г-жа Иванова Анна. Herr Müller-Lüdenscheidt 4539578763621487"), (3, None), (4, ""),
           (5, "clean 12 34 f0ddae3b09ae356cbefecdd3232fa5489bb400d6"), (None, "a@b.co b@b.co c@b.co"), (1, "bob@mail5.example.com"), (6, " ".join(f"{c}@b.co" for c in "abcdefghijklmnop"))]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_surrogates(spark):
    df = spark.createDataFrame([(*r, 7, "x") for r in PRIVATE], "doc_id long, text string, n_chars int, _new string")
    out = surrogates.pseudonymize(df, "key")
    assert out.columns == df.columns and out.count() == len(PRIVATE)
    new = {(r.doc_id, len(r.text or "")): r.text for r in out.collect()}
    text = next(r.text for r in out.collect() if r.doc_id == 1 and r.text.startswith("Mail"))
    mails = re.findall(r"[\w.]+@[\w.]+\w", text)
    assert mails[0].lower() == mails[1] and mails[0][0].isupper() and mails[0] not in PRIVATE[0][1]
    assert {m.split("@")[1].lower() for m in mails} == {mails[2].split("@")[1]} and mails[2] != "bob@mail5.example.com"
    phones = re.findall(r"\+1 \(?(\d{3})\)?[ -](\d{3}-\d{4})", text)
    assert phones[0] == phones[1] and "555-4526" not in text
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", text)
    assert cards[0].replace(" ", "") == cards[1] != "4539578763621486" and luhn(cards[1]) and cards[1][0] == "4"
    assert "999.1.1.1" in text and "196.7.2.8" not in text
    named = next(r.text for r in out.collect() if r.doc_id == 2)
    first = re.match(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) and MRS\. X\. Mrs\. (\w+) (\w+)\. г-жа ([а-я]+) ([а-я]+)\. Herr (\w+)-(\w+) 4539578763621487", named, re.I)
    assert first and first[1] in surrogates.FIRST_NAMES["f", "latin"] and (first[1].upper(), first[2].upper()) == (first[4], first[5])
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id in (3, 4, 5)) == [(3, None), (4, ""), (5, PRIVATE[4][1])]
    many = next(r.text for r in out.collect() if r.doc_id == 6).split()
    assert len(set(many)) == 16 and not set(many) & set(PRIVATE[7][1].split())
    assert {r.text for r in out.collect() if r.doc_id is None}.pop().split() == many[:3]
    again = {(r.doc_id, len(r.text or "")): r.text for r in surrogates.pseudonymize(df, "key").collect()}
    assert again == new and surrogates.pseudonymize(df, "other").collect() != out.collect()
    assert surrogates.replaced(df.limit(0), "key").collect() == []


def test_surrogates_of_a_full_shape(spark):
    """No replacement of four digits is left, so numbers grow; +1000 is no telephone number."""
    text = " ".join(f"+123 {i:04d}" for i in range(10_000)) + " +1000 +12 345"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    new = surrogates.pseudonymize(df, "key").first().text
    assert new.endswith(" +1000 +12 345")
    numbers = re.findall(r"\+123 (\d+)", new)
    assert len(numbers) == len(set(numbers)) == 10_000 and min(map(len, numbers)) > 4


def test_surrogates_refer_to_one_another(spark):
    rows = [(1, "Mrs. Anna Smith came. Then Mrs. Smith left, and Anna Smith or SMITH called +1 (564) 555-4526, 564-555-4526 and +15645554526."),
            (2, "Smith and Anna stay here."), (3, "Prof. Dr. Anna Smith wrote to Mr. Smith and Mrs. Greta Smith. Anna's")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    new = {r.doc_id: r.text for r in surrogates.pseudonymize(df, "key").collect()}
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) came\. Then Mrs\. (\w+) left, and (\w+) (\w+) or (\w+) called \+1 \((\d+)\) (\d+)-(\d+), (\d+)-(\d+)-(\d+) and \+1(\d+)\.", new[1])
    assert m and m[1] == m[4] in surrogates.FIRST_NAMES["f", "latin"] and m[2] == m[3] == m[5] != "Smith" and m[6] == m[2].upper()
    assert m[7] + m[8] + m[9] == m[10] + m[11] + m[12] == m[13] != "5645554526"
    assert new[2] == rows[1][1]
    n = re.fullmatch(r"Prof\. Dr\. (\w+) (\w+) wrote to Mr\. (\w+) and Mrs\. (\w+) (\w+)\. (\w+)'s", new[3])
    assert n and n[1] == n[6] == m[1] != n[4] and n[2] == n[3] == n[5] == m[2]


def test_surrogates_report_every_document(spark):
    df = spark.createDataFrame([(*r, 7) for r in PRIVATE], "doc_id long, text string, n int")
    rows = surrogates.report(df, "key").collect()
    assert len(rows) == len(PRIVATE)
    assert {(r.doc_id, r.n_entities, r.kinds, r.text) for r in rows if r.doc_id in (3, 4, 5)} == {(k, 0, "", t) for k, t in PRIVATE[2:5]}
    assert Counter(map(str, surrogates.pseudonymize(df, "key").select("doc_id", "text").collect())) == Counter(str(r) for r in surrogates.report(df, "key").select("doc_id", "text").collect())


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "source_mixing", "bpe_encode_decode"]
    df = spark.createDataFrame([(k, t, "en", f"s{k % 4}", len(t or "")) for k, t in corpus.items()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in corpus], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = {k: t for k, t in corpus.items() if brute.statistics(t)[0] >= 10 and 5 * brute.statistics(t)[4] <= brute.statistics(t)[0]}
    gone = brute.later_lines({k: t for k, t in good.items() if len(t) < 100_000})
    cut = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in good.items()}
    cut = {k: t for k, t in cut.items() if brute.WORD.search(t)}
    comps = brute.linked_components({k: s for k, t in cut.items() if (s := brute.shingles(t))})
    left = {k: t for k, t in cut.items() if comps.get(k, k) == k}
    assert {r.doc_id for r in out} <= set(left)
    from tidewatch.llm import bpe
    enc = bpe.loaded(bpe.read_vocabulary(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY)))
    total = sum(len(t.split()) for t in left.values())
    assert abs(sum(len(left[r.doc_id].split()) for r in out) - total) < 0.5 * total
    for r in out:
        assert r.token_ids == np.frombuffer(enc.encode(left[r.doc_id]), "<u4").tolist() and r.n_chars == len(left[r.doc_id])
