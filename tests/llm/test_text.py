"""Tokenisation, chat formatting, secret scan and quality rules."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from tests.llm import brute
from tidewatch.llm import bpe, chat, quality, secrets
from tidewatch.llm.common import Words, part_sets

SPEC = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [None, "", " ", "Hello, World's 42!", "a<|endoftext|>b <|startoftext|>", "ΑΣΑ ΑΣ İstanbul", "x\x1cy\x85z\xa0w 'S'T", "é ﬁ ½ ² 日本語 🙂🙂 a‍b",
         "word " * 50_000, "ab" * 30_000, "İİ\n\n\tz", "Hello, World's 42!"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_equals_the_library(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (1, "twice", "y")], "doc_id long, text string, n_tokens string")
    rows = bpe.round_trip(df, SPEC).collect()
    assert len(rows) == len(TEXTS) + 2
    by = {r.doc_id: r for r in rows[:len(TEXTS)]}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
        assert tuple(by[i])[1:] == want, repr(t)[:60]
    assert bpe.round_trip(df.limit(0), SPEC).collect() == []
    coded = bpe.decode(bpe.encode(df, SPEC), SPEC)
    assert coded.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    got = {r.doc_id: r.decoded for r in coded.collect()}
    assert sha(got[3].encode()) == by[3].decoded_sha256
    checked = {r.doc_id: r for r in bpe.encode_checked(df, SPEC).collect()}
    assert checked[3].decoded_sha256 == by[3].decoded_sha256 and checked[3].n_tokens == len(checked[3].token_ids)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cn", "Cs"]), max_size=60))
def test_bpe_any_text(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    enc = bpe.loaded(SPEC)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids
    assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_short_pieces_need_no_heap_and_long_ones_agree(monkeypatch):
    words = ["unbelievable", "thwhndly", "aaaaaaa", "é日本", "x", "ofthonthering" * 2]
    with monkeypatch.context() as m:
        m.setattr(bpe.heapq, "heapify", lambda heap: pytest.fail("a heap for a short piece"))
        enc = bpe.Bpe(SPEC)
        short = [enc.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [bpe.Bpe(SPEC).merge(w) for w in words] == short


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.text(alphabet="<|\\[]/sINTim_endok>\n é", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    out, spans, rewrites = chat.locate(turns, chat.tagged)
    assert not rewrites and chat.parse_tagged(out) == turns
    for (role, text), s in zip(turns, spans):
        assert chat.unescape(out[s[2]:s[3]]) == text
    body = chat.escape("".join(t for _, t in turns))
    assert not any(c in body for c in ("<|", "[INST]", "</s>", "<<SYS>>"))


def test_chat_rewriting_template_is_found():
    def forgetful(turns):  # earlier assistant turns lose their thoughts
        return "".join(f"[{r}]{t if i == len(turns) - 1 else t.split('#')[-1]}\n" for i, (r, t) in enumerate(turns))
    turns = [("user", "a"), ("assistant", "think#b"), ("user", "c"), ("assistant", "think#d")]
    out, spans, rewrites = chat.locate(turns, forgetful)
    assert rewrites and spans[0] is not None and spans[1] is None and spans[3] is None or spans[3] and out[spans[3][2]:spans[3][3]] == "think#d"


def test_chat_table(spark):
    probe = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "two", 0), (1, 0, "user", "one", 0), (2, None, None, None, 0), (None, 0, "user", "n", 0), (1, 1, "assistant", "two", 0),
            (-1, 0, "user", probe, 0), (-1, 1, "assistant", probe, 0), (3, 0, "assistant", "z" * 300_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, None, -1}
    assert got[1].n_turns == 3 and got[1].loss_chars == 6
    assert got[1].turns_sha256 == sha(b"user\none\nassistant\ntwo\nassistant\ntwo\n")
    assert got[2].turns_sha256 == sha(b"\n\n") and got[2].loss_sha256 == sha(b"")
    assert got[-1].loss_sha256 == sha(probe.encode()) and got[-1].loss_chars == len(probe)
    assert got[3].loss_chars == 300_000
    assert chat.format_conversations(df.limit(0)).collect() == []


def key_of(body):
    return b"ghp_" + body + secrets.checksum(body)


SECRETS = [None, "", "token = abc", "Token: 'abcdef12' secret=zz api_key:\"é\" APIKEY=1234567", "passwordtoken=longenough token=token=abcdef",
           "AKIA" + "A" * 16 + " AKIAAKIA" + "0" * 10 + " akia" + "A" * 20, "é" * 5 + "0123456789abcdef" * 2 + "g" + "f" * 23, "f0" * 100_000,
           "ü " + key_of(b"a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5").decode() + " " + "ghp_" + "x" * 36, "api key = 123456 token:  =  abcdefg"]


def test_secrets_equal_plain_patterns(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(SECRETS)] + [(2, SECRETS[3], 1)], "doc_id long, text string, spans int")
    rows = secrets.digests(secrets.scan_secrets(df)).collect()
    assert len(rows) == len(SECRETS) + 1
    for r in rows[:len(SECRETS)]:
        want = brute.base_secrets(SECRETS[r.doc_id])
        assert r.base_sha256 == sha(",".join(want).encode()), (r, want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
    assert rows[8].spans.count("github") == 1
    assert secrets.scan_secrets(df.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "secret", "API_key", "apikey", "AKIA", "=", ":", " ", "'", '"', "abcdef", "ABC123", "é", "0" * 12, "zz"]), max_size=20).map("".join))
def test_secret_spans(text):
    assert [f"{k}:{a}:{b}" for a, b, k in secrets.scan(text) if k in secrets.KINDS[:3]] == brute.base_secrets(text)


def test_word_hashes_and_shingles():
    texts = [None, "", "a b", "The quick brown fox jumps over the lazy dog", "long" * 40 + " é ü", "x\x0by\x0cz\n\n  w v u", "The quick brown fox jumps"]
    w = Words(pa.array(texts), lower=True)
    s, bounds = w.shingles()
    sizes = [len(x) for x in part_sets(s, bounds)]
    assert sizes == [len(brute.shingles(t)) for t in texts]
    assert [len(brute.WORD.findall(t or "")) for t in texts] == np.diff(w.bounds).tolist()


QUALITY = [None, "", "one two", "w " * 30, "a b c d e f g h i j\n" * 3, "Plain words follow each other here and there without any end in sight\nnew line", "é ü # % $ | <x> a b c d e f",
           "x" * 100_000 + " and so on for ten words or more it goes on"]


def test_quality_statistics_and_limits(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(QUALITY)] + [(None, QUALITY[5], 0), (5, QUALITY[5], 0)], "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.judge(df, none).collect()
    assert len(rows) == len(QUALITY) + 2
    for r in rows:
        if r.doc_id is None:
            continue
        want = brute.statistics(QUALITY[r.doc_id])
        assert tuple(r[s] for s in quality.STATISTICS) == want, (QUALITY[r.doc_id] or "")[:30]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)
    assert quality.keep(df, none).columns == df.columns
    assert sorted(r.doc_id or -1 for r in quality.keep(df, none).collect()) == sorted(r.doc_id or -1 for r in rows if r.kept)
    assert quality.judge(df.limit(0), none).collect() == []


def test_quality_learns_from_labels(spark):
    rng = np.random.default_rng(1)
    words = ["amber", "stone", "river", "cloud", "table", "green", "seven", "light", "paper", "onion"]
    good = [" ".join(rng.choice(words, 60)) for _ in range(120)]
    bad = [" ".join(w + "%%%" for w in rng.choice(words, 60)) for _ in range(15)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(135) if i % 2 == 0] + [(None, 1), (0, None)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.judge(df, labels).where("kept").collect()}
    assert len([i for i in range(120) if i in kept]) >= 118 and not [i for i in range(120, 135) if i in kept]
    assert {r.doc_id for r in quality.keep(df, labels).collect()} == kept
