"""Exact n-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; two link when 4 * intersection >= 3 * union (0.75); the result is each document's
component. Similar documents are partitioned into groups, each group's token union is one row for each token and group
(the matrix), the overlap of a query with the groups is bounded from the matrix, and only qualifying groups are opened.

1. Equal sets become one class (rows carry the class, not the document), so copies cost nothing further.
2. Of every class the n - ceil(0.75 n) + l(n) tokens of least hash are dealt by token (tokens that two classes of a batch hold
   are known to be shared and send two witnesses only, so no token gathers rows without bound). Linked sets share at least
   min(l) of these, so a class with fewer tokens that any other class holds has no link and leaves.
3. The rest fetch their whole sets and are grouped by their least shared token. A group is opened and solved exactly in
   memory: a query from outside the largest component is compared with all members by an inverted index, until no two
   components with unasked members are left. A large group is dealt into chunks that all hold the same pivots. What the
   matrix of step 4 leaves is grouped by two other keys once more.
4. The matrix: a query is asked further only if at least min(l) of its dealt tokens, and then at least ceil(0.75 n) of all
   its tokens, are held by other components. Those left are partitioned into groups of similar sets, a row for each token
   and group is the group's union; the rarest n - ceil(0.75 n) + 1 of a query's shared tokens must meet a group's union
   for the group to be opened, and the members of an opened group are compared exactly, in memory.

A class is named by a 128-bit hash of its set, and by a number of its own from step 3 on; shingles are 64-bit hashes. Only
step 2 tells classes apart by 64 bits: two classes that share these look for partners together.

Nothing is capped: every step keeps all that can link. Defined results: null text is empty; an empty set links with
nothing; with fewer than five words the whole sequence is one shingle; whole texts count, however long; rows without doc_id
are returned alone, with a null component; rows that repeat a doc_id are each returned, by their own text; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import at_end, byte_texts, docs_of, empty, pieces, staged
from voxlake.llm.components import components
from voxlake.llm.sieve import only_maybe
from voxlake.llm.substring_dedup import _shared_hashes, rolling

SHINGLE, CHUNK, PIVOTS = 5, 2000, 16
#: Rows of two or three numbers that a join may broadcast: about 40 MB.
BROADCAST_ROWS = 500_000
_SALT = np.uint64(0xD6E8FEB86659FD93)


def least_overlap(n: int) -> int:
    """Tokens that a set of n must share with any set it links to."""
    return -(-3 * n // 4)


def extra(n: int) -> int:
    return max(1, 2 * n // 25)


def least_dealt(n: int) -> int:
    """Dealt tokens that a set of n must share with any set it links to."""
    return extra(least_overlap(n))


def shingle_set(text: bytes, cache: dict, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.lower().split()  # bytes: only A-Z change
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    return np.unique(rolling(hashes, k)) if n >= k else rolling(hashes * _SALT + np.uint64(n), n)


def _each(batches: Iterator[pa.RecordBatch]):
    cache = _shared_hashes()
    for whole in batches:
        for batch in pieces(whole):
            yield batch, [shingle_set(t, cache) for t in byte_texts(batch)]


_CLASSES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("rest", pa.int64())])


def _class_of(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit name in two halves."""
    name = xxhash.xxh3_128_intdigest(s.tobytes())
    return (name >> 64) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield empty(_CLASSES)
    for batch, sets in _each(batches):
        names = list(map(_class_of, sets))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1))], schema=_CLASSES)


#: Kinds of dealt rows: a token of a class; one that two classes of the batch hold; such a token's two witnesses.
ROW, KNOWN, WITNESS = range(3)
_DEALT = pa.schema([("token", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("kind", pa.int32())])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch, sets in _each(batches):
        tokens, sigs, sizes = [], [], []
        for s, doc in zip(sets, batch.column("doc_id").to_pylist()):
            n = len(s)
            if not n or doc is None or (sig := _class_of(s)[0]) in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add(sig)
            tokens.append(s[: n - least_overlap(n) + extra(n)])
            sigs.append(sig)
            sizes.append(n)
        if tokens:
            repeat = list(map(len, tokens))
            token, sig, n = np.concatenate(tokens).view(np.int64), np.repeat(sigs, repeat), np.repeat(np.array(sizes, np.int32), repeat)
            order = np.argsort(token, kind="stable")  # a class holds a token once, so neighbours are of two classes
            same = token[order][1:] == token[order][:-1]
            many = np.r_[same, False] | np.r_[False, same]
            head = np.r_[same, False] & ~np.r_[False, same]
            first = order[head]
            second = order[np.flatnonzero(head) + 1]
            kind = np.zeros(len(token), np.int32)
            kind[order[many]] = KNOWN
            pick = np.r_[np.arange(len(token)), first, second]
            kind = np.r_[kind, np.full(2 * len(first), WITNESS, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(token[pick]), pa.array(sig[pick]), pa.array(n[pick]), pa.array(kind)], schema=_DEALT)


_SETS = pa.schema([("sig", pa.int64()), ("tokens", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets of classes, under their number."""
    yield empty(_SETS)
    for batch, sets in _each(batches):
        asked = zip(*(batch.column(c).to_pylist() for c in ("node", "sig", "rest")))
        own = [(node, s.tobytes()) for (node, *name), s in zip(asked, sets) if tuple(name) == _class_of(s)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], f.type) for k, f in enumerate(_SETS)], schema=_SETS)


def links(n_a: int, n_b: np.ndarray, shared: np.ndarray) -> np.ndarray:
    return 4 * shared >= 3 * (n_a + n_b - shared)


class Index:
    """Tokens of some sets with their owners, for counting what a query shares with each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array(list(map(len, sets)))
        owners, tokens = np.repeat(np.arange(len(sets)), self.sizes), np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], owners[order]

    def shared(self, query: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        spans = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
        return np.bincount(self.owners[at], minlength=len(self.sizes))


def solve_group(sets: list[np.ndarray]) -> list[int]:
    """The component of each set, as the number of one member."""
    index, m = Index(sets), len(sets)
    comp, asked = np.arange(m), np.zeros(m, bool)
    while True:
        left = np.flatnonzero(~asked)
        found, counts = np.unique(comp[left], return_counts=True)
        if len(found) < 2:
            return comp.tolist()
        largest = found[counts.argmax()]
        q = int(left[comp[left] != largest][0])
        asked[q] = True
        hit = np.flatnonzero(links(int(index.sizes[q]), index.sizes, index.shared(sets[q])))
        comp[np.isin(comp, comp[hit])] = comp[q]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _solve(table: pa.Table) -> pa.Table:
    """Edges that join the members of each group of one bucket."""
    groups: dict[tuple, list[int]] = {}
    for row, key in enumerate(zip(table.column("grp").to_pylist(), table.column("chunk").to_pylist())):
        groups.setdefault(key, []).append(row)
    sigs, data = table.column("sig").to_pylist(), table.column("tokens").to_pylist()
    a, b = [], []
    for rows in groups.values():
        if len(rows) > 1:
            for row, other in zip(rows, solve_group([np.frombuffer(data[r], np.uint64) for r in rows])):
                if row != rows[other]:
                    a.append(sigs[row])
                    b.append(sigs[rows[other]])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def _open(table: pa.Table) -> pa.Table:
    """Edges from the queries of an opened group to one linked member of each other component."""
    rows = {0: [], 1: []}
    for row, query in enumerate(table.column("query").to_pylist()):
        rows[query].append(row)
    sigs, comps, data = (table.column(c).to_pylist() for c in ("sig", "comp", "tokens"))
    a, b = [], []
    if rows[0] and rows[1]:
        index = Index([np.frombuffer(data[r], np.uint64) for r in rows[0]])
        held = np.array([comps[r] for r in rows[0]])
        for q in rows[1]:
            s = np.frombuffer(data[q], np.uint64)
            hit = np.flatnonzero(links(len(s), index.sizes, index.shared(s)) & (held != comps[q]))
            for comp in np.unique(held[hit]) if len(hit) else ():
                a.append(sigs[q])
                b.append(sigs[rows[0][int(hit[held[hit] == comp][0])]])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, sig, n, comp) of whole sets."""
    for batch in batches:
        sets = [np.frombuffer(t, np.int64) for t in batch.column("tokens").to_pylist()]
        repeat = list(map(len, sets))
        many = lambda c: np.repeat(np.array(batch.column(c).to_pylist(), np.int64), repeat)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(many("sig")), pa.array(np.repeat(np.array(repeat, np.int32), repeat)), pa.array(many("comp"))], names=["token", "sig", "n", "comp"])


def _several(rows: DataFrame, what: str) -> DataFrame:
    """Rows whose token is held by more than one `what`, with the number `df` of rows that hold it.

    Minima are combined before the shuffle, and the join with them may be split where one token has many rows.
    """
    held = rows.groupBy("token").agg(F.min(what).alias("_lo"), F.max(what).alias("_hi"), F.count("*").alias("df")).where("_lo <> _hi")
    return rows.join(held.select("token", "df"), "token")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast df (a few numbers a row) if it is known to be small; else the join is Spark's choice."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _round(sets: DataFrame, keyed: DataFrame, n: int) -> DataFrame:
    """Edges found inside groups. sets: (sig, tokens); keyed: (sig, grp), n rows. A large group is dealt into chunks, and
    each of them also gets the group's pivots."""
    buckets = max(1, -(-n // CHUNK))
    sizes = keyed.groupBy("grp").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    sizes = staged(sizes)
    large = sizes.count()
    own = F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int")
    dealt = keyed.join(_small(sizes, large), "grp", "left").select("sig", "grp", F.coalesce(own, F.lit(0)).alias("chunk"))
    if large:
        order = Window.partitionBy("grp").orderBy("sig")
        pivots = keyed.join(_small(sizes, large), "grp").withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS)
        others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != own)
        dealt = dealt.unionByName(pivots.select("sig", "grp", F.explode(others).alias("chunk")))
    bucket = F.when(F.col("chunk") > 0, F.xxhash64("grp", "chunk")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    members = sets.join(_small(dealt.withColumn("bucket", bucket), n), "sig").select("bucket", "grp", "chunk", "sig", "tokens")
    return members.groupBy("bucket").applyInArrow(_solve, "a long, b long")


def _run(f):
    return lambda batches: at_end(f(batches))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    docs = docs_of(docs)
    classes = staged(docs.mapInArrow(_run(_classes), "doc_id long, n long, sig long, rest long"))
    firsts = classes.where("n > 0 and doc_id is not null").groupBy("sig", "rest").agg(F.min("doc_id").alias("first"), F.min("n").cast("int").alias("n"))
    overlap = F.ceil(F.col("n") * 3 / 4).cast("int")
    dealt_least = F.greatest(F.lit(1), F.floor(2 * overlap / 25).cast("int"))

    # classes that may have a link
    spread = docs.mapInArrow(_run(_deal), "token long, sig long, n int, kind int")
    # a token that many hold comes as two witnesses of each batch; rows known to share theirs are dealt anywhere
    lone = F.when(F.col("kind") == KNOWN, F.xxhash64("token", "sig")).otherwise(F.col("token"))
    dealt = spread.withColumn("at", lone)
    w = Window.partitionBy("at")
    dealt = dealt.withColumn("_lo", F.min("sig").over(w)).withColumn("_hi", F.max("sig").over(w))
    dealt = dealt.where((F.col("kind") == KNOWN) | (F.col("kind") == ROW) & (F.col("_lo") != F.col("_hi")))
    asked = dealt.groupBy("sig", "n").agg(F.collect_set("token").alias("dealt")).where(F.size("dealt") >= dealt_least)
    named = staged(asked.join(firsts, ["sig", "n"]).withColumn("node", F.monotonically_increasing_id()))
    n_asked = named.count()
    mine, _ = only_maybe(docs, "doc_id", named, "first", n_asked)
    texts = mine.join(_small(named.select(F.col("first").alias("doc_id"), "node", "sig", "rest"), n_asked), "doc_id").select("doc_id", "text", "node", "sig", "rest")
    sets = staged(texts.mapInArrow(_run(_sets), "sig long, tokens binary"))
    asked = named.select(F.col("node").alias("sig"), "n", "dealt")  # from here on a class goes by its number

    # groups by the least dealt token
    edges = staged(_round(sets, asked.select("sig", F.array_min("dealt").alias("grp")), n_asked))
    solved = components(edges)
    comp_of = staged(asked.select("sig").join(solved.withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("comp", "sig").alias("comp")))

    # the matrix of tokens and components: queries that other components' unions may cover
    matrix = _several(asked.select("sig", "n", F.explode("dealt").alias("token")).join(_small(comp_of, n_asked), "sig"), "comp")
    suspects = staged(matrix.groupBy("sig", "n").count().where(F.col("count") >= dealt_least).select("sig").join(comp_of, "sig"))
    n_suspects = suspects.count()
    whole = staged(_several(sets.join(_small(suspects, n_suspects), "sig").mapInArrow(_spread, "token long, sig long, n int, comp long"), "comp"))
    held = staged(whole.groupBy("sig", "n").agg(F.count("*").alias("shared"), *(F.min(F.xxhash64("token", F.lit(k))).alias(f"g{k}") for k in (7, 8))).where(F.col("shared") >= overlap))
    n_held = held.count()

    # once more by two other keys, only for what is left
    keyed = held.select("sig", F.explode(F.array("g7", "g8")).alias("grp")).distinct()
    edges = staged(edges.unionByName(_round(sets.join(_small(held.select("sig"), n_held), "sig", "left_semi"), keyed, 2 * n_held)))
    solved = components(edges)
    comp_of = staged(held.select("sig", "n", "shared").join(solved.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "n", "shared", F.coalesce("comp", "sig").alias("comp")))
    near = whole.select("token", "sig").join(_small(comp_of.drop("shared"), n_held), "sig")
    again = _several(near, "comp").withColumn("shared", F.count("*").over(Window.partitionBy("sig"))).where(F.col("shared") >= overlap)
    rare = again.withColumn("r", F.row_number().over(Window.partitionBy("sig").orderBy("df", "token"))).where(F.col("r") <= F.col("shared") - overlap + 1)
    # groups of similar ones (one key together, as long as a group's size allows), and which of them a query opens
    groups = max(1, -(-n_held // CHUNK))
    crowd = staged(held.groupBy("g7").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")).where("parts > 1"))
    placed = held.select("sig", "g7").join(_small(crowd, crowd.count()), "g7", "left")
    place = F.pmod(F.xxhash64("g7", F.coalesce(F.pmod(F.xxhash64("sig"), F.col("parts")), F.lit(0))), F.lit(groups)).cast("int")
    placed = staged(placed.select("sig", place.alias("own")))
    rare = staged(rare.select("token", "sig", "comp").join(_small(placed, n_held), "sig"))
    unions = rare.groupBy("token", F.col("own").alias("grp")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    opened = rare.join(unions, "token").where("grp >= own and not (lo = comp and hi = comp)").select("sig", "comp", "grp").distinct()
    holds = rare.select("sig", "comp", F.col("own").alias("grp")).distinct()
    both = staged(opened.withColumn("query", F.lit(1)).unionByName(holds.withColumn("query", F.lit(0))))
    asks = both.where("query = 1").groupBy("grp").agg(F.ceil(F.count("*") / (4 * CHUNK)).cast("int").alias("parts"))
    mine = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda c: (F.col("query") == 0) | (c == F.pmod(F.xxhash64("sig"), F.col("parts"))))
    both = both.join(F.broadcast(asks), "grp").withColumn("part", F.explode(mine)) if groups <= BROADCAST_ROWS else both.join(asks, "grp").withColumn("part", F.explode(mine))
    late = sets.join(_small(both, both.count()), "sig").groupBy("grp", "part").applyInArrow(_open, "a long, b long")
    final = components(edges.unionByName(late))

    # classes to documents; those in no component are their own
    rooted = named.select("node", "sig", "rest", "first").join(final, "node")
    roots = rooted.groupBy("comp").agg(F.min("first").alias("root"))
    joined = rooted.join(roots, "comp").select("sig", "rest", "root")
    own = firsts.join(joined, ["sig", "rest"], "left").select("sig", "rest", F.coalesce("root", "first").alias("component_id"))
    out = classes.join(own, ["sig", "rest"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
