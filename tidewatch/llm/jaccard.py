"""Exact n-gram Jaccard self-join with a token-group matrix.

The set of a document is its distinct five-word shingles.  Two documents link
when shared * 100 >= 80 * union.  Steps, all over whole texts:

1. Shingle frequencies: every task counts its shingles and ships them packed,
   a hash range per row; ranges are merged and shingles in ``HOT_FROM`` or
   more documents are listed (at most ``HOT_LIMIT`` of them, the most
   frequent; the list only shapes the order below, never the result).
2. Order: rare shingles first, hot ones last by frequency, then by hash.  Of n
   shingles the first n - ceil(0.8 n) + k are a document's front, where
   k = 1 + n / 20; two linked documents share at least the smaller k
   shingles of their fronts.  Equal sets are one class.
3. Groups: classes with the same smallest shingle (the smallest hot one where
   the front reaches the hot ones) form a group of similar documents.
4. Token-group matrix: (shingle, group) rows with the range of set sizes; a
   class meets the groups that hold enough shingles of its front and a
   fitting size.
5. Blocks of a group's members and the classes that meet it are solved in
   tasks: the union of the members' shingles bounds the overlap, only groups
   with a sufficient bound are opened, and pairs not yet connected are
   compared exactly.  Large groups are first compared with a leader, the class
   with the greatest share of hot shingles; the parts that it connects are
   not compared within themselves again, and chunks hold a large part or a
   pool of small ones.
6. Links are joined into components; classes get all their documents back.

A null or empty text, or one without words, has an empty set and links with
nothing.  A document without an id takes the component of the documents with
the same set, and has a null component if there are none.  Rows with one id
are one document with several texts.  An empty table gives an empty table.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.components import connected_components
from tidewatch.llm.common import Words, mix, part_sets, shared_count, slices
from tidewatch.session import materialize

PERCENT = 80
HOT_FROM, HOT_LIMIT = 24, 1 << 20
FLUSH = 500_000  # shingles that a task holds before it ships them
MEMBERS, QUERIES = 256, 2048  # classes of one block
BROADCAST_ROWS = 500_000  # wanted documents up to which their ids are broadcast


def need(n):
    """Shingles that a linked document shares at least, of n."""
    return (n * PERCENT + 99) // 100


def least_shared(n):
    """Shingles that the fronts of two linked documents share at least, by the
    size of the smaller one."""
    return 1 + n // 20


def linked(shared: int, n: int, m: int) -> bool:
    return shared * 100 >= PERCENT * (n + m - shared)


def _sets(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    return part_sets(*Words(b.column(b.schema.get_field_index("text")), lower=True).shingles())


def range_bits(docs: DataFrame) -> int:
    """Hash ranges: about a thousand documents' worth of shingles in each."""
    return max(5, min(24, int(docs.count() // 1000).bit_length()))


def _cut(t: np.ndarray, extra: np.ndarray, where: np.ndarray) -> Iterator[tuple]:
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(t) else np.zeros(0, int)
    for a, e in zip(first, [*first[1:], len(t)]):
        yield int(where[a]), t[a:e].tobytes(), extra[a:e].tobytes()


def _packed_counts(tokens: list[np.ndarray], bits: int) -> list[tuple]:
    """(range, sorted shingles, counts) of what a task holds; the range's bits
    and the 32 after them name a shingle."""
    t, n = np.unique(np.concatenate(tokens) >> np.uint64(32 - bits), return_counts=True)
    return list(_cut(t.astype(np.uint32), n.astype(np.uint32), t >> np.uint64(32)))


def packed_pairs(tokens: np.ndarray, keys: np.ndarray, bits: int) -> list[tuple]:
    """(range, sorted tokens, their keys) without repeated pairs."""
    order = np.lexsort((keys, tokens))
    t, k = tokens[order], keys[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    t, k = t[new], k[new]
    return list(_cut(t, k, t >> np.uint64(64 - bits)))


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    r, t, x = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(t, pa.binary()), pa.array(x, pa.binary())], names=["range", "tokens", "extra"])


PACKED = "range int, tokens binary, extra binary"


def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and keys of one range, ordered, without repeated pairs."""
    tok = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()])
    key = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("extra").to_pylist()])
    order = np.lexsort((key, tok))
    tok, key = tok[order], key[order]
    new = np.ones(len(tok), dtype=bool)
    new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
    return tok[new], key[new]


def hot_shingles(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle names ascending, document counts), HOT_LIMIT at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in slices(batches, "text"):
            for s in _sets(b):
                held.append(s)
                n += len(s)
            if n >= FLUSH:
                yield packed_rows(_packed_counts(held, bits))
                held, n = [], 0
        if n:
            yield packed_rows(_packed_counts(held, bits))

    def merge(t: pa.Table) -> pa.Table:
        tok = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("tokens").to_pylist()])
        cnt = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("extra").to_pylist()])
        order = np.argsort(tok, kind="stable")
        tok, cnt = tok[order], cnt[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        total = np.add.reduceat(cnt, first)
        hot = total >= HOT_FROM
        name = (t.column("range")[0].as_py() << 32) | tok[first][hot].astype(np.int64)
        return pa.table({"name": pa.array(name, pa.int64()), "df": pa.array(total[hot], pa.int64())})

    hot = materialize(docs.select("text").mapInArrow(count, PACKED).groupBy("range").applyInArrow(merge, "name long, df long"), "hot")
    level = F.floor(F.log2("df"))
    per = dict(hot.groupBy(level.alias("l")).count().collect())  # one row per power of two
    least, n = HOT_FROM, sum(per.values())
    for k in sorted(per):
        if n <= HOT_LIMIT:
            break
        n, least = n - per[k], 2 ** (k + 1)
    rows = hot.where(F.col("df") >= least).orderBy("name").collect()
    return np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=np.int64)


def document_sets(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """(id, n, class, check, grp, heat, rare, hot): class and check are halves of
    the digest of the set, heat its share of hot shingles, rare and hot the
    shingles of its front."""
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, dfs = held.value
        for b in slices(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for s in _sets(b):
                n = len(s)
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                front = n - need(n) + least_shared(n) if n else 0
                rare, heat = s, 0.0
                if n and len(names):
                    name = s >> np.uint64(32 - bits)
                    at = np.searchsorted(names, name)
                    at[at == len(names)] = 0
                    is_hot = names[at] == name
                    if is_hot.any():
                        rare, often, df = s[~is_hot], s[is_hot], dfs[at[is_hot]]
                        heat = len(often) / n
                often_front = s[:0]
                if n and len(rare) < front:
                    often_front = often[np.lexsort((often, df))][: front - len(rare)]
                    group = often[np.argmin(mix(often))]
                else:
                    group = s[0] if n else np.uint64(0)
                for c, v in zip(out, (n, int(digest[0]), int(digest[1]), int(np.int64(group.astype(np.int64))), heat, rare[:front].tobytes(), often_front.tobytes())):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, types))],
                                             names=["id", "n", "class", "check", "grp", "heat", "rare", "hot"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, class long, check long, grp long, heat double, rare binary, hot binary")


def shared_fronts(sets: DataFrame, bits: int) -> DataFrame:
    """(token, class): shingles in the fronts of two or more classes."""
    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, n = [], [], 0
        for b in batches:
            for k, r in zip(b.column("class").to_numpy(), b.column("rare").to_pylist()):
                t = np.frombuffer(r, np.uint64)
                tokens.append(t)
                keys.append(np.full(len(t), k, np.int64))
                n += len(t)
                if n >= FLUSH:
                    yield packed_rows(packed_pairs(np.concatenate(tokens), np.concatenate(keys), bits))
                    tokens, keys, n = [], [], 0
        if n:
            yield packed_rows(packed_pairs(np.concatenate(tokens), np.concatenate(keys), bits))

    def meet(t: pa.Table) -> pa.Table:
        tok, key = unpacked(t)
        same = tok[1:] == tok[:-1]
        twice = np.zeros(len(tok), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        return pa.table({"token": pa.array(tok[twice].view(np.int64)), "class": pa.array(key[twice])})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, h in zip(b.column("class").to_pylist(), b.column("hot").to_pylist()):
                t = np.frombuffer(h, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), k, np.int64))], names=["token", "class"])

    rare = sets.select("class", "rare").mapInArrow(ship, PACKED).groupBy("range").applyInArrow(meet, "token long, class long")
    hot = sets.where(F.length("hot") > 0).select("class", "hot").mapInArrow(spread, "token long, class long").distinct()
    return rare.union(hot)


def verified(pairs: DataFrame) -> DataFrame:
    """Links (a, b) among rows (a, b, set_a, set_b)."""
    pairs = pairs.select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(linked(shared_count(x, y), len(x), len(y)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, pairs.select("a", "b").schema)


def _solve(t: pa.Table) -> pa.Table:
    """Links between the asking and the member classes of each block that
    connect different parts."""
    part = t.column("part").to_numpy()
    block = t.column("block").to_numpy()
    member = t.column("member").to_numpy(zero_copy_only=False)
    ids = t.column("id").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
    size = np.array([len(s) for s in sets])
    order = np.lexsort((ids, block))
    edges = []
    for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        inside, asking = rows[member[rows]], rows[~member[rows]]
        if not len(inside) or not len(asking):
            continue
        union = np.unique(np.concatenate([sets[i] for i in inside]))
        root = {int(p): int(p) for p in part[rows]} | {int(i): int(p) for i, p in zip(ids[rows], part[rows])}

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for q in asking:
            n = size[q]
            if shared_count(sets[q], union) < need(n):
                continue  # the group is not opened
            for m in inside[(ids[inside] < ids[q]) & (size[inside] * 100 >= PERCENT * n) & (n * 100 >= PERCENT * size[inside])]:
                a, b = top(int(ids[q])), top(int(ids[m]))
                if a != b and linked(shared_count(sets[q], sets[m]), n, size[m]):
                    root[max(a, b)] = min(a, b)
                    edges.append((int(ids[m]), int(ids[q])))
    a, b = zip(*edges) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: (key, n_shingles, component_id)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    bits = range_bits(docs)
    sets = materialize(document_sets(docs, hot_shingles(docs, bits), bits), "sets")
    # two sets with one half of the digest in common meet below, and are compared exactly
    classes = sets.where("n > 0").groupBy("class", "check").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.min("grp").alias("grp"), F.max("heat").alias("heat"))
    classes = materialize(classes, "classes")

    known = classes.where("id is not null").drop("check")
    fronts = materialize(shared_fronts(sets.where("n > 0"), bits).join(known, "class").distinct(), "fronts")
    matrix = fronts.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("id").alias("first"))
    ask = fronts.select("token", "id", "n", F.col("grp").alias("own"))
    fits = (F.col("high") * 100 >= PERCENT * F.col("n")) & (F.col("low") * PERCENT <= 100 * F.col("n")) & (F.col("first") < F.col("id"))
    met = ask.join(matrix, "token").where(fits).groupBy("id", "n", "grp").agg(F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"))
    enough = F.col("shared") >= 1 + F.floor(F.least("n", "low") / 20)
    meets = materialize(met.where(enough).select("id", "grp"), "meets")
    members = materialize(fronts.select("id", "class", "grp", "heat").distinct().join(meets.select("grp").distinct(), "grp", "left_semi"), "members")

    wanted = members.select("id", "class").union(meets.select("id").distinct().join(fronts.select("id", "class").distinct(), "id")).distinct()
    wanted = materialize(wanted, "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if few else wanted, "id")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own = [s.tobytes() for s in _sets(b)]
            is_class = [int(np.frombuffer(hashlib.blake2b(s, digest_size=16).digest(), np.int64)[0]) for s in own]
            keep = pa.array([c == k for c, k in zip(is_class, b.column("class").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.binary())], names=["id", "set"]).filter(keep)

    full = materialize(texts.select("id", "class", "text").mapInArrow(shingled, "id long, set binary"), "full")

    # large groups: a leader connects what it can before anything else is compared
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.max_by("id", F.struct("heat", -F.col("id"))).alias("leader"))
    sizes = materialize(sizes, "sizes")
    large = sizes.where(F.col("members") > MEMBERS)
    empty = spark.createDataFrame([], "a long, b long")
    if large.isEmpty():
        links, own = empty, None
    else:
        pairs = (meets.union(members.select("id", "grp")).distinct().join(large, "grp")
                 .where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
        pairs = pairs.join(full.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(full.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        links = materialize(verified(pairs), "leader_links")
        own = connected_components(links)

    def part(df: DataFrame) -> DataFrame:
        """With ``part``: the component that leaders have made, or the document itself."""
        if own is None:
            return df.withColumn("part", F.col("id"))
        return df.join(own.select(F.col("node").alias("id"), F.col("comp").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))

    # blocks: the members of a group, of a large group those of a large part or of a pool of small parts, in chunks
    inside = materialize(part(members.join(sizes, "grp")), "inside")
    parts = inside.where(F.col("members") > MEMBERS).groupBy("grp", "part").count().where(F.col("count") >= MEMBERS // 2)
    inside = inside.join(parts.select("grp", "part", F.col("part").alias("pool")), ["grp", "part"], "left")
    pools = materialize(inside.groupBy("grp", "pool").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("chunks")), "pools")
    alike = lambda x, y, *names: [x[n].eqNullSafe(y[n]) for n in names]
    inside = inside.join(pools, alike(inside, pools, "grp", "pool")).select(inside["grp"], inside["pool"], "id", "part", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"))
    inside = materialize(inside, "inside")
    asked = meets.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("asks"))
    blocks = inside.groupBy("grp", "pool", "chunk").agg(F.min("id").alias("first")).join(asked, "grp")
    asking = (part(meets).join(blocks, "grp")
              .where((F.col("first") < F.col("id")) & (F.col("pool").isNull() | (F.col("pool") != F.col("part"))))
              .withColumn("ask", F.pmod(F.xxhash64("id", F.lit(7)), F.col("asks"))))
    asking = materialize(asking.select("grp", "pool", "chunk", "ask", "id", "part"), "asking")
    used = asking.select("grp", "pool", "chunk", "ask").distinct()
    filled = used.join(inside, alike(used, inside, "grp", "pool", "chunk")).select(used["grp"], used["pool"], used["chunk"], "ask", "id", "part")
    rows = filled.withColumn("member", F.lit(True)).union(asking.withColumn("member", F.lit(False)))
    rows = rows.select(F.xxhash64("grp", "pool", "chunk", "ask").alias("block"), "member", "id", "part").join(full, "id")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(wanted.count() // 2000))
    found = (rows.withColumn("bucket", F.pmod("block", F.lit(buckets))).groupBy("bucket")
             .applyInArrow(_solve, "a long, b long"))
    comps = connected_components(links.union(materialize(found, "links")))
    of_class = (classes.select("class", "check", F.col("id").alias("rep")).join(comps, F.col("rep") == F.col("node"), "left")
                .select("class", "check", F.coalesce("comp", "rep").alias("component_id")))
    out = sets.select("id", "n", "class", "check").join(of_class, ["class", "check"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are linked to one with a smaller id.
    Rows without an id stay; of rows with one id all stay or all go."""
    gone = jaccard_components(docs, key, text).where(F.col(key) > F.col("component_id")).select(F.col(key).alias("_gone")).distinct()
    gone = materialize(gone, "gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs[key] == gone["_gone"], "left_anti")
