"""Substring deduplication with repeated-phrase automata.

A word is removed when a window of `window` consecutive words covers it and the same word sequence
starts earlier (smaller doc_id, or same document and smaller start); windows are judged on the input.

Plan, every step linear in the input:
1. each document is cut at content-defined anchors: every window picks the k-word gram of least hash in it, so equal
   windows pick equal anchors; neighbouring windows with one anchor form a run (one row for about eight words). Windows
   that repeat an earlier one of their own document are settled at once, once their words are compared;
2. runs whose anchor occurs nowhere else are dropped (one shuffle on the anchor; runs whose anchor recurs within a batch
   are settled there and send one witness, so a passage that a third of the documents share stays a few rows);
3. the surviving runs fetch their words; equal runs are pre-aggregated to (words, first place, number);
4. runs are sharded by anchor. A shard confirms the recurring windows, joins neighbouring ones with neighbouring first
   places to phrases, compiles the phrases into a pyahocorasick automaton over word numbers and streams its runs through
   it to locate every occurrence;
5. located phrases that start earlier elsewhere become removed spans, joined back to the documents. A bounded bitmap of
   the documents that matter lets the others pass the joins of steps 3 and 5 by.

Exact copies of whole texts never reach steps 1 to 4: all but the first are removed as a whole, so a copied text that
holds a third of the rows costs one row for each task.

Defined results: null text counts as empty; documents shorter than the window lose nothing; whole texts are read, however
long; rows without a doc_id are returned whole and remove nothing elsewhere; of documents with the same words the one of
smallest doc_id keeps them; an empty table gives no rows; other columns are ignored, whatever their names. doc_id should be
unique: rows that repeat a doc_id are each returned, and share the spans found for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import at_end, byte_texts, cached, docs_of, empty, pieces, staged
from voxlake.llm.sieve import only_maybe

WINDOW, GRAM = 20, 6
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))


class _Hashes(dict):
    """64-bit hashes of words; forgets all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _shared_hashes() -> _Hashes:
    return cached(_Hashes, _Hashes)


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k neighbouring values."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 3:
        r = np.zeros(n, np.uint64)
        for j in range(k):
            r *= _MULT
            r += x[j : j + n]
    else:  # differences of prefix sums, modulo 2^64; the multiplier is odd, so its powers have inverses
        powers = np.full(len(x), _MULT, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers, out=sums[1:])
        r = sums[k:] - sums[:-k]
        inverse = np.full(n, _INVERSE, np.uint64)
        inverse[0] = 1
        r *= np.multiply.accumulate(inverse, out=inverse)
    r ^= r >> np.uint64(31)
    r *= np.uint64(0xBF58476D1CE4E5B9)
    r ^= r >> np.uint64(29)
    return r


def repeated_inside(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window the first one of the same owner (document number) with its hash; itself, where it is the first."""
    keys = hashes ^ (owner.astype(np.uint64) * _MULT)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.arange(len(keys))
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        places = np.flatnonzero(twice[at] == keys)
        order = places[np.argsort(keys[places], kind="stable")]
        head = np.r_[True, keys[order][1:] != keys[order][:-1]]
        out[order] = order[head][np.cumsum(head) - 1]
    return out


def same_words(words: list[bytes], first: int, later: int, n: int, window: int) -> bool:
    """Whether n windows from `later` on hold the words of those from `first` on."""
    return words[first : first + n + window - 1] == words[later : later + n + window - 1]


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Where each stretch of `width` values has its least one (high 40 bits count, then the place)."""
    n = len(values) - width + 1
    places = np.uint64((1 << 24) - 1)
    out = np.empty(n, np.int64)
    for begin in range(0, n, 1 << 23):
        part = values[begin : min(n, begin + (1 << 23)) + width - 1]
        keys, reach = (part & ~places) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * reach <= width:
            keys = np.minimum(keys[:-reach], keys[reach:])
            reach *= 2
        if width > reach:
            keys = np.minimum(keys[: len(keys) - (width - reach)], keys[width - reach :])
        out[begin : begin + len(keys)] = (keys & places).astype(np.int64) + begin
    return out


def runs_of(hashes: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of concatenated documents: (anchor, document number, first window, windows) of runs, and the last three of spans
    of windows that seem to repeat earlier ones of their document, with the first of these."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    counts = np.maximum(sizes - window + 1, 0)
    total = int(counts.sum())
    owner = np.repeat(np.arange(len(sizes)), counts)
    local = np.arange(total) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
    place = local + starts[owner]
    n = max(0, len(hashes) - window + 1)
    if not total:
        none = np.zeros(0, np.int64)
        return (none.view(np.uint64), none, none, none), (none, none, none, none)
    grams = rolling(hashes, gram)
    at = least_places(grams, window - gram + 1)
    source = repeated_inside(rolling(hashes, window)[place], owner)
    again = source != np.arange(total)

    def grouped(rows: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.r_[True, breaks | (np.diff(local[rows]) != 1) | (np.diff(owner[rows]) != 0)]) if len(rows) else np.zeros(0, int)
        return rows[cut], np.diff(np.r_[cut, len(rows)]), cut

    rows = np.flatnonzero(~again)
    first, many, _ = grouped(rows, np.diff(at[place[rows]]) != 0)
    spans = np.flatnonzero(again)
    begin, long, _ = grouped(spans, np.diff(source[spans]) != 1)
    return (grams[at[place[first]]], owner[first], local[first], many), (owner[begin], local[begin], long, local[source[begin]])


def singles(split: dict[int, list[bytes]], owner: np.ndarray, lo: np.ndarray, n: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Windows of spans as runs of one window each, anchored like any other by their gram of least hash."""
    rows = [(d, j) for d, a, m in zip(owner.tolist(), lo.tolist(), n.tolist()) for j in range(a, a + m)]
    anchors = []
    for d, j in rows:
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in split[d][j : j + window]], np.uint64)
        grams = rolling(hashes, gram)
        anchors.append(grams[least_places(grams, window - gram + 1)[0]])
    d, j = np.array(rows, np.int64).reshape(-1, 2).T
    return np.array(anchors, np.uint64), d, j, np.ones(len(rows), np.int64)


#: Kinds of scanned rows: a run; a run whose anchor recurs among the documents at hand; such an anchor once, as a witness
#: for runs elsewhere; windows that repeat earlier ones of their document; a whole text (its 128-bit hash in three columns).
RUN, KNOWN, WITNESS, INSIDE, TEXT = range(5)
_RUNS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("kind", pa.int32())])


def _rows(anchor: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip((anchor, doc, lo, n, kind), _RUNS)], schema=_RUNS)


def _scan(window: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = _shared_hashes(), {}
        for whole in batches:
            for batch in pieces(whole):
                ids, arrays, every, keys, texts = [], [], [], [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch)):
                    key = xxhash.xxh3_128_digest(text)
                    if doc is not None:
                        every.append(doc)
                        keys.append(key)
                    if doc is None or seen.get(key, doc + 1) <= doc:
                        continue  # an earlier copy of this text has gone through
                    if len(seen) < 500_000:
                        seen[key] = doc
                    words = text.split()
                    if len(words) >= window:
                        ids.append(doc)
                        texts.append(text)
                        arrays.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
                parts = np.frombuffer(b"".join(keys), "<i4").reshape(-1, 4)
                yield _rows(np.ascontiguousarray(parts[:, :2]).view("<i8").ravel(), np.array(every, np.int64), parts[:, 2], parts[:, 3], np.full(len(every), TEXT))
                if not ids:
                    continue
                docs = np.array(ids)
                (anchor, owner, lo, n), (owner2, lo2, n2, first2) = runs_of(np.concatenate(arrays), np.array(list(map(len, arrays))), window, gram)
                split = {d: texts[d].split() for d in set(owner2.tolist())}
                true = np.array([same_words(split[d], f, l, m, window) for d, f, l, m in zip(*(c.tolist() for c in (owner2, first2, lo2, n2)))], bool)
                if not true.all():  # one hash for different words: these windows go on as runs of their own
                    extra = singles(split, owner2[~true], lo2[~true], n2[~true], window, gram)
                    anchor, owner, lo, n = (np.concatenate(c) for c in zip((anchor, owner, lo, n), extra))
                    owner2, lo2, n2 = owner2[true], lo2[true], n2[true]
                anchor = anchor.view(np.int64)
                found, first, which, times = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
                yield _rows(anchor, docs[owner], lo, n, np.where(times[which] > 1, KNOWN, RUN))
                seen_here = first[times > 1]
                yield _rows(anchor[seen_here], docs[owner[seen_here]], lo[seen_here], n[seen_here], np.full(len(seen_here), WITNESS))
                yield _rows(np.zeros(len(lo2), np.int64), docs[owner2], lo2, n2, np.full(len(lo2), INSIDE))

    return scan


_REGIONS = pa.schema([("anchor", pa.int64()), ("key", pa.binary()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("words", pa.binary())])


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 500, 8):
                rows = []
                for doc, text, runs in zip(batch.column("doc_id").to_pylist(), byte_texts(batch), batch.column("runs").to_pylist()):
                    words = text.split()
                    for run in runs:
                        region = b" ".join(words[run["lo"] : run["lo"] + run["n"] + window - 1])
                        rows.append((run["anchor"], xxhash.xxh3_128_digest(region), doc, run["lo"], region))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REGIONS)], schema=_REGIONS)

    return cut


def _single(window: int):
    """Runs as one run for each window; a window's hash becomes its anchor."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, lo, region in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lo", "words"))):
                words = region.split(b" ")
                for j in range(len(words) - window + 1):
                    part = b" ".join(words[j : j + window])
                    rows.append((xxhash.xxh3_64_intdigest(part) - (1 << 63), xxhash.xxh3_128_digest(part), doc, lo + j, part))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REGIONS)], schema=_REGIONS)

    return single


def _distinct(regions: DataFrame) -> DataFrame:
    """Equal runs as one, with their first place and number."""
    same = regions.groupBy("anchor", "key").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.count("*").alias("copies"), F.any_value("words").alias("words"))
    return same.select("anchor", "key", "first.doc_id", "first.lo", "copies", "words")


_PHRASE = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("doc", pa.int64()), ("first", pa.int32())])
_FOUND = pa.schema([("anchor", pa.int64()), ("key", pa.binary()), ("phrases", pa.list_(_PHRASE))])


def _confirm(numbers: np.ndarray, sizes: np.ndarray, docs: np.ndarray, los: np.ndarray, copies: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Phrases of the runs of one shard, as (begin, windows, length, first document, first start); begin and length
    count in the concatenated numbers. A phrase is a longest stretch of windows that occur more than once and whose
    first places follow one another."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    counts = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    local = np.arange(int(counts.sum())) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
    place = local + starts[owner]
    if not len(place):
        return []
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    one, two = rolling(mixed, window)[place], rolling(mixed * _MULT ^ (mixed >> np.uint64(17)), window)[place]
    doc, at = docs[owner], los[owner] + local
    order = np.lexsort((at, doc, two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    heads, group = order[new], np.cumsum(new) - 1
    often = np.empty(len(order), bool)
    often[order] = (np.bincount(group, copies[owner[order]]) > 1)[group]
    first_doc, first_at = np.empty_like(doc), np.empty_like(at)
    first_doc[order], first_at[order] = doc[heads][group], at[heads][group]
    rows = np.flatnonzero(often)
    if not len(rows):
        return []
    follows = (np.diff(rows) == 1) & (np.diff(owner[rows]) == 0) & (np.diff(first_doc[rows]) == 0) & (np.diff(first_at[rows]) == 1)
    cut = np.flatnonzero(np.r_[True, ~follows])
    long = np.diff(np.r_[cut, len(rows)])
    rows = rows[cut]
    return list(zip(place[rows].tolist(), long.tolist(), (long + window - 1).tolist(), first_doc[rows].tolist(), first_at[rows].tolist()))


def _locate(window: int):
    def locate(table: pa.Table) -> pa.Table:
        """One shard: confirm phrases, compile the automaton, stream the runs."""
        numbers = _Numbers()
        texts = [tuple(map(numbers.__getitem__, t.split())) for t in table.column("words").to_pylist()]
        flat = [x for t in texts for x in t]
        column = lambda c: np.array(table.column(c).to_pylist(), np.int64)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for begin, n, length, doc, at in _confirm(np.array(flat, np.int64), np.array(list(map(len, texts))), column("doc_id"), column("lo"), column("copies"), window):
            automaton.add_word(tuple(flat[begin : begin + length]), (n, doc, at))
        ends, ats, ns, docs, firsts = [0], [], [], [], []
        if len(automaton):
            automaton.make_automaton()
        for words in texts:
            if len(automaton):
                located = [(end - window + 2 - n, -n, doc, at) for end, (n, doc, at) in automaton.iter(words)]
                if len(located) > 1:
                    located.sort()
                reach = 0
                for begin, n, doc, at in located:  # phrases inside a longer one say the same
                    if begin - n > reach:
                        reach = begin - n
                        ats.append(begin), ns.append(-n), docs.append(doc), firsts.append(at)
            ends.append(len(ats))
        struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((ats, ns, docs, firsts), _PHRASE)], fields=list(_PHRASE))
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
        return pa.table([table.column("anchor"), table.column("key"), found], schema=pa.schema([*list(_FOUND)[:2], pa.field("phrases", found.type)]))

    return locate


class _Numbers(dict):
    """Numbers of words, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _remove(window: int, marked: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield empty(_KEPT)
        for whole in batches:
            for batch in pieces(whole, 1000, 8):
                rows, nothing = [], [None] * batch.num_rows
                spans_of, copy_of = (batch.column(c).to_pylist() if marked else nothing for c in ("spans", "copy"))
                for doc, text, spans, copy in zip(batch.column("doc_id").to_pylist(), byte_texts(batch), spans_of, copy_of):
                    words = text.split()
                    n, kept = len(words), words
                    if copy and n >= window:
                        kept = []
                    elif spans:
                        edges = np.zeros(n + 1, np.int64)
                        s = np.array([(x["lo"], x["lo"] + x["n"] + window - 1) for part in spans for x in part])
                        s = s[s[:, 1] <= n]
                        np.add.at(edges, s[:, 0], 1)
                        np.add.at(edges, s[:, 1], -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:n]) == 0)]
                    rows.append((doc, n, n - len(kept), b" ".join(kept).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KEPT)], schema=_KEPT)

    return remove


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_regions: int = 20_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of docs; kept words are joined by one space.

    shard_regions: distinct runs in one automaton, about; the number of shards follows the input. An anchor with more
    different surroundings than that is split into its windows.
    """
    docs = docs_of(docs)
    scanned = staged(docs.mapInArrow(lambda batches: at_end(_scan(window, gram)(batches)), "anchor long, doc_id long, lo int, n int, kind int"))
    near = Window.partitionBy("anchor").orderBy("doc_id", "lo")
    lone = scanned.where(F.col("kind").isin(RUN, WITNESS)).withColumn("before", F.lag("lo").over(near)).withColumn("after", F.lead("lo").over(near))
    lone = lone.where(F.col("kind") == RUN).where("before is not null or after is not null").select("doc_id", "anchor", "lo", "n")
    runs = lone.unionByName(scanned.where(F.col("kind") == KNOWN).select("doc_id", "anchor", "lo", "n"))
    runs = staged(runs.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "lo", "n")).alias("runs")))
    asked, _ = only_maybe(docs, "doc_id", runs, "doc_id", runs.count())
    regions = staged(asked.join(runs, "doc_id").mapInArrow(_cut(window), "anchor long, key binary, doc_id long, lo int, words binary"))
    distinct = staged(_distinct(regions))
    crowded = staged(distinct.groupBy("anchor").count().where(F.col("count") > shard_regions).select("anchor"))
    if crowded.count():  # too many surroundings of one anchor for a shard: its windows go on by themselves
        single = staged(regions.join(crowded, "anchor").mapInArrow(_single(window), regions.schema))
        regions = staged(regions.join(crowded, "anchor", "left_anti").unionByName(single))
        distinct = staged(distinct.join(crowded, "anchor", "left_anti").select(*distinct.columns).unionByName(_distinct(single)))
    shards = max(1, -(-distinct.count() // shard_regions))
    found = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard")
    found = found.applyInArrow(_locate(window), "anchor long, key binary, phrases array<struct<at: int, n: int, doc: long, first: int>>").where(F.size("phrases") > 0)
    places = regions.select("anchor", "key", "doc_id", "lo").join(found, ["anchor", "key"])
    later = F.filter("phrases", lambda p: (p["doc"] < F.col("doc_id")) | ((p["doc"] == F.col("doc_id")) & (p["first"] < F.col("lo") + p["at"])))
    spans = places.select("doc_id", F.transform(later, lambda p: F.struct((p["at"] + F.col("lo")).alias("lo"), p["n"].alias("n"))).alias("spans")).where(F.size("spans") > 0)
    inside = scanned.where(F.col("kind") == INSIDE).select("doc_id", F.array(F.struct("lo", "n")).alias("spans"))
    # whole texts that an earlier document has too
    keyed = scanned.where(F.col("kind") == TEXT)
    firsts = keyed.groupBy("anchor", "lo", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = keyed.join(firsts, ["anchor", "lo", "n"]).where("doc_id > first").select("doc_id")
    marks = spans.unionByName(inside).withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    marks = staged(marks.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"), F.bool_or("copy").alias("copy")))
    changed, whole = only_maybe(docs, "doc_id", marks, "doc_id", marks.count())
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return changed.join(marks, "doc_id", "left").mapInArrow(_remove(window, True), schema).unionAll(whole.mapInArrow(_remove(window, False), schema))
