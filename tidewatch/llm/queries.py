"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, chat, divergence, jaccard, lines, mixing, paragraphs, quality, resample, search, secrets, suffixes, surrogates
from tidewatch.llm.common import read_table
from tidewatch.llm.registry import ORACLES, QUERIES, register  # noqa: F401

VOCABULARY = "word_bpe_49k.json"

# DuckDB: words and five-word shingles of a text, ASCII letters in lower case.
_WORDS = ("list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[\\x20\\x09-\\x0D]+'), lambda x: x <> '')")
_SHINGLES = ("case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) "
             "when len(w) > 0 then [array_to_string(w, ' ')] else [] end")
#: From parts (node, w): sets, links of 80 % and more, and the smallest node that links lead to.
_LINKED = f"""sets as (select distinct node, unnest({_SHINGLES}) as s from parts),
sizes as (select node, count(*) as n from sets group by node),
shared as (select a.node as a, b.node as b, count(*) as c from sets a join sets b using (s) where a.node < b.node group by 1, 2),
links as (select a, b from shared join sizes x on a = x.node join sizes y on b = y.node where 100 * c >= 80 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach(node, comp) as (select node, node from sizes union select e.b, r.comp from reach r join edges e on r.node = e.a),
comps as (select node, min(comp) as comp from reach group by node)"""


@register("op2_bpe_encode_decode")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), vocabulary)


PROBE = "</s>[INST] ok [/INST]"


@register("op4_chat_formatting", sql=r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
told as (  -- a turn adds its tags, its role and text, and a backslash per control string
  select *, 12 + length(role) + 1 + length(text) + 11
    + len(regexp_extract_all(text, '[<\[]\\*(?:\||s>|/s>|<SYS>>|</SYS>>|/?INST\]|/?AVAILABLE_TOOLS\]|start_of_turn>|end_of_turn>|bos>|eos>)')) as chars
  from said)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from told group by conv_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")),
                             F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"))))
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), said.alias("s")).select(
        "conv_id", "s.turn", "s.role", F.lit(PROBE).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


@register("op5_source_mixing", sql="""
with words as (
  select doc_id, source,
         coalesce(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0)::bigint as size
  from documents),
per as (
  select source, sum(size)::bigint as source_size, count(*) as n_docs,
         ((row_number() over (order by source is null, source) - 1) % 3 + 1)::double as weight
  from words group by source),
caps as (
  select *, 3.0::double * source_size as cap,
         sum(source_size) over () as total,
         coalesce(sum(3.0::double * source_size) over (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as cap_before,
         sum(weight) over (order by source_size / weight, source is null, source rows between current row and unbounded following) as weight_left
  from per),
rate as (
  select max((total - cap_before) / weight_left) filter (where (total - cap_before) / weight_left * weight <= cap) as r
  from caps),
targets as (
  select source, source_size, least(coalesce(r, 0) * weight, cap) as target,
         case when source_size > 0 then least(coalesce(r, 0) * weight, cap) / source_size else 0 end as expected,
         (('0x' || substr(md5('42:' || coalesce('s' || source, 'n')), 1, 8))::bigint) / 4294967296.0::double as draw
  from caps, rate),
placed as (
  select w.*, t.source_size, t.target, t.expected, t.draw,
         row_number() over (partition by w.source order by w.size, w.doc_id) - 1 as k
  from words w join targets t on w.source is not distinct from t.source)
select doc_id, size, source_size, target,
       size * (floor((k + 1) * expected + draw) - floor(k * expected + draw))::bigint as taken
from placed""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@register("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_secrets(read_table(spark, sf_dir, "documents", "doc_id", "text")))


@register("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATISTICS, "base_failed", "kept", "score")


@register("op9_ngram_jaccard_join", sql=f"""
with recursive parts as (select doc_id as node, {_WORDS.format("text")} as w from documents), {_LINKED}
select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, coalesce(c.comp, d.doc_id) as component_id
from documents d left join sizes z on d.doc_id = z.node left join comps c on d.doc_id = c.node""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op3_line_dedup", sql="""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as content,
         unnest(range(len(string_split(text, chr(10))))) as line
  from documents where text <> ''),
counted as (
  select *, len(list_filter(string_split_regex(content, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as words from lines),
sums as (
  select *, sum(words) over (partition by doc_id order by line) as upto,
         sum(words) over (partition by doc_id order by line) - words as before
  from counted),
windows as (  -- shortest windows of five words, forwards from i and backwards from j
  select i.doc_id, i.line as first, j.line as last
  from sums i join sums j on i.doc_id = j.doc_id and j.line >= i.line
   and j.upto - i.before >= 5 and (j.before - i.before < 5 or j.upto - i.upto < 5)
  where (j.before - i.before < 5 and j.words > 0) or (j.upto - i.upto < 5 and i.words > 0)),
contents as (
  select w.*, array_to_string(string_split(d.text, chr(10))[w.first + 1 : w.last + 1], chr(10)) as content
  from windows w join documents d using (doc_id)),
later as (
  select doc_id, first, last,
         row_number() over (partition by content, last - first order by doc_id, first) as nth
  from contents),
deleted as (
  select distinct doc_id, unnest(range(first, last + 1)) as line from later where nth > 1),
per as (
  select doc_id, count(*) as n_deleted, string_agg(line::varchar, ',' order by line) as deleted_lines from deleted group by doc_id)
select d.doc_id, case when text <> '' then len(string_split(text, chr(10))) else 0 end::bigint as n_lines,
       coalesce(n_deleted, 0)::bigint as n_deleted, coalesce(deleted_lines, '') as deleted_lines
from documents d left join per p on d.doc_id = p.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op10_pii_surrogates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return surrogates.report(docs, key="tidewatch")


@register("op1_substring_dedup", sql=rf"""
with recursive segments as (  -- a word with the white space before it
  select doc_id, unnest(s) as seg, unnest(range(len(s))) as i
  from (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') as s from documents)),
words as (
  select doc_id, i, regexp_replace(seg, '^[\x20\x09-\x0D]+', '') as word, sum(length(seg)) over (partition by doc_id order by i)::bigint as upto from segments),
numbers as (  -- from the length and the first eight bytes
  select word, list_reduce(list_prepend(length(x) // 2, list_transform(range(8), lambda j: case when 2 * j < length(x) then ('0x' || substr(x, 2 * j + 1, 2))::bigint else 0 end)),
                           lambda h, b: (h * 257 + b) % 2147483647) as h
  from (select distinct word, hex(encode(word)) as x from words)),
drawn as (
  select doc_id, i, word, upto, count(*) over (partition by doc_id) as n,
         ((h * h) % 2147483647 * 48271 + coalesce(lead((h * h) % 2147483647) over (partition by doc_id order by i), 0) * 16807) % 2147483647 as draw
  from words join numbers using (word)),
cuts as (
  select *, i = 0 or (i > 10 and n - i > 10 and draw < min(draw) over (partition by doc_id order by i rows between 10 preceding and 1 preceding)
                      and draw <= min(draw) over (partition by doc_id order by i rows between 1 following and 10 following)) as cut
  from drawn),
placed as (select *, sum(cut::int) over (partition by doc_id order by i)::bigint - 1 as piece from cuts),
parts as (
  select row(doc_id, piece) as node, doc_id, piece, list(word order by i) as w, min(upto - length(word)) as start, max(upto) as "end"
  from placed group by doc_id, piece having count(*) >= 5),
{_LINKED}
select doc_id, piece, start, "end", c.comp[1] as first_doc_id, c.comp[2] as first_piece
from parts p join comps c on p.node = c.node where c.comp <> p.node""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op7_exact_topk_search", sql="""
with words as (
  select doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as term
  from documents),
tf as (select doc_id, term, count(*) as tf from words group by doc_id, term),
lengths as (select doc_id, sum(tf) as len from tf group by doc_id),
stats as (select (select count(*) from documents) as n, (select sum(len) from lengths) / (select count(*) from documents)::double as mean),
idf as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, stats group by term, n),
scores as (
  select q.doc_id as query_id, d.doc_id,
         round(sum(q.tf * i.idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * l.len / s.mean))), 6) as score
  from tf q join idf i on i.term = q.term join tf d on d.term = q.term join lengths l on l.doc_id = d.doc_id, stats s
  where q.doc_id % 100 = 0 group by q.doc_id, d.doc_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores)
select query_id, rank, doc_id, score from ranked where rank <= 10""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", F.col("doc_id").alias("id"), "text")
    return search.search(docs, docs.where("id % 100 = 0"), k=10)


# DuckDB: lower-case letters and digits (or letters alone) and non-ASCII, as lists of words.
_ALNUM = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LETTERS = _ALNUM.replace("\\x2F\\x3A-\\x60", "\\x60")


@register("op12_target_resampling", sql=f"""
with crc_table as (  -- next state of crc32 for each byte
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select unnest(range(256)) as i)),
words as (
  select true as own, doc_id as id, {_ALNUM} as w from documents union all select false, item_id, {_ALNUM} from benchmark),
counted as (
  select own, id, len(w) as n_words, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) as feature from words),
features as (select own, id, feature, count(*) as n from counted group by all),
names as (select feature, hex(encode(feature)) as h from (select distinct feature from features)),
buckets as (
  select feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
                                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from names, crc_table),
per as (
  select bucket, coalesce(sum(n) filter (where own), 0) as s, coalesce(sum(n) filter (where not own), 0) as t from features join buckets using (feature) group by bucket),
gains as (
  select bucket, floor(1000 * ln(((t + 1)::double * ((select sum(s) from per) + 10000)::double)
                                 / ((s + 1)::double * ((select sum(t) from per) + 10000)::double)))::bigint as gain from per),
weights as (select id, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n)::double)::bigint as weight
            from features join buckets using (feature) join gains using (bucket) where own group by id),
scored as (
  select doc_id, n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0)
         + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score,
         coalesce(weight, 0) as weight
  from (select id as doc_id, len(w) as n_words from words where own) d left join weights on id = doc_id),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_words >= 20)
select s.doc_id, n_features, weight, score, case when rank <= 25 * n // 100 then rank end::bigint as rank
from scored s left join ranked using (doc_id)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "text")
    return resample.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


@register("op13_source_divergence", sql=f"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LETTERS} as w from documents),
said as (select d, lang, source, unnest(w) as term from docs),
kept as (select lang, term, count(*) as n from said group by all having count(distinct d) >= 10),
size as (select l.lang, count(term) as v, coalesce(sum(n), 0) as total from (select distinct lang from docs) l left join kept k on k.lang = l.lang group by 1),
counts as (select lang, source, term, count(*) as n from said semi join kept using (lang, term) group by all),
groups as (select g.lang, g.source, coalesce(sum(n), 0) as total from (select distinct lang, source from docs) g left join counts c on c.lang = g.lang and c.source = g.source group by 1, 2),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.total + 2 * v) as p,
         1 + 1000000000::hugeint * (k.n + 2) // (s.total + 2 * v) as q
  from groups g join size s on s.lang = g.lang join kept k on k.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item,
         coalesce((select sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) from p x join p y on y.lang = x.lang and y.term = x.term
                   where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
  from groups a join groups b on b.lang = a.lang and b.source <> a.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank
  from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents", "lang", "source", "text"))


@register("op11_suffix_array_dedup", sql="""
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (  -- from every byte, 50 bytes as hex digits
  select doc_id, unnest(range(length(h) // 2)) as i, unnest(list_transform(range(length(h) // 2), lambda i: substr(h, 2 * i + 1, 100))) as w from texts),
owners as (select w, min(doc_id) as first from windows where length(w) = 100 group by w),
marked as (select doc_id, i, left(w, 2) as byte, case when first < doc_id then i end as mark from windows left join owners using (w)),
covered as (select doc_id, i, byte, coalesce(max(mark) over (partition by doc_id order by i) > i - 50, false) as gone from marked),
edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as starts from covered),
per as (select doc_id, count(*) as n, count(*) filter (where gone) as removed, count(*) filter (where starts) as spans,
               coalesce(string_agg(byte, '' order by i) filter (where not gone), '') as kept from edges group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, ''))) as kept_sha256
from texts d left join per using (doc_id)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.report(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
