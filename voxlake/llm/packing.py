"""Best-fit packing of documents into sequences by bin completion.

Piece lengths are integers up to the sequence size, so the whole packing problem is a histogram of at most `size`
numbers, whatever the corpus. The driver plans on that histogram only: a plan is a list of (filling, how often). Every
filling of the search uses up at least one length, and a filling has fewer than sqrt(2 * size) different lengths, which
bounds the plan (4096 fillings of 90 lengths for 4096 tokens). Executors then rank the pieces of a length (salted, so a
length that a third of the pieces share is spread) and look their places up in the plan.

The search: take the largest piece left and enumerate the undominated fillings around it, over every number of every
length; least waste first, apply a filling as often as the counts allow, then less often; prune a branch when sequences so
far plus the waste bound of the rest cannot beat the incumbent; backtrack. The first incumbent is best-fit decreasing,
and dives that deviate once come before the search, since backtracking alone changes only the last choices of a long plan.

Effort is bounded: by `nodes` for the dives and again for the search, by DIVE_STEPS or NODE_STEPS steps of enumeration at
a node and by SEARCH_STEPS in the whole search. Within that the search is exhaustive; beyond it the plan is the best found. It is always whole.

Defined results: null text counts as empty; a document always ends with the end id, so each has at least one piece; texts
of any length are cut into pieces of `size` tokens, the last one shorter; rows that repeat a doc_id are each packed, and so
are rows without one; pieces of one length are interchangeable, their order is that of (doc_id, piece, checksum); an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import gc
import random
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import at_end, docs_of, empty, pieces, staged
from voxlake.llm.tokens import word_ids

SIZE, END_ID = 4096, 1
#: Rows and megabytes of text that are tokenised at once.
SLICE_ROWS, SLICE_MB = 1000, 4
#: What a worker may hold when a task ends, so that it keeps its words.
IDS_MB = 340
#: Steps of enumeration at a node of a dive, at a node of the search, and in all nodes of the search.
DIVE_STEPS, NODE_STEPS, SEARCH_STEPS = 100, 4_000, 400_000
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit_decreasing(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing on a histogram: equal sequences are kept together with their number."""
    groups: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))  # by room left
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per, fill, many = size // length, (), left // (size // length)
                if not many:
                    per, many = left, 1
                room = size
            else:
                room = rooms[at]
                fill, have = next(iter(groups[room].items()))
                per = min(room // length, left)
                many = min(have, left // per)
                groups[room][fill] -= many
                if not groups[room][fill]:
                    del groups[room][fill]
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            left -= per * many
            room -= per * length
            if room not in groups:
                bisect.insort(rooms, room)
            groups[room][(*fill, (length, per))] += many
    return [(fill, many) for found in groups.values() for fill, many in found.items()]


def dominated(chosen: tuple[tuple[int, int], ...], waste: int, spare: int) -> bool:
    """Whether a piece that is left would do better in the place of some chosen ones, whose sum is at most its length.

    spare: bit k is set if a piece of length k is left beside the chosen ones.
    """
    one, more = 0, 0  # sums of exactly one and of at least two chosen pieces, as bits
    for length, number in chosen:
        for _ in range(number):
            more |= (one | more) << length
            one |= 1 << length
    reach, width = (1 | one | more) << 1, 1  # what exceeds a sum by 1 to `waste`
    if not waste:
        reach = 0
    while width < waste:
        step = min(width, waste - width)
        reach |= reach << step
        width += step
    return bool(spare & (more | reach))


def fillings(lengths: list[int], counts: dict[int, int], room: int, most: int | None, steps: int) -> tuple[list[tuple[int, tuple[tuple[int, int], ...]]], int]:
    """Undominated fillings of room, as (waste, ((length, number), ...)), least waste first, and the steps left.

    lengths are sorted ascending. Every number of every length is tried, large ones first. No steps left: some may be missing.
    most: keep so many, and stop when so many without waste are known.
    """
    found: list[tuple[int, tuple]] = []
    budget, exact, end = [steps], [0], bisect.bisect_right(lengths, room)
    lengths = lengths[:end]
    reach = [0, *accumulate(k * counts[k] for k in lengths)]
    every = sum(1 << k for k in lengths)

    def leaf(room: int, chosen: tuple) -> bool:
        used_up = sum(1 << k for k, n in chosen if n == counts[k])
        if not dominated(chosen, room, every & ~used_up):
            found.append((room, chosen))
            exact[0] += not room
        return most is not None and exact[0] >= most

    def grow(room: int, below: int, chosen: tuple, skipped: int) -> bool:
        """skipped: the least length of which pieces are left over so far. True: enough fillings are known."""
        at = bisect.bisect_right(lengths, room, 0, below) - 1
        if at < 0:
            return room < skipped and leaf(room, chosen)
        for i in range(at, -1, -1):
            length = lengths[i]
            if i < at:
                skipped = min(skipped, lengths[i + 1])
            if room - reach[i + 1] >= skipped:  # all smaller pieces leave room for one that was skipped
                return False
            for number in range(min(room // length, counts[length]), 0, -1):
                if budget[0] <= 0:
                    return True
                budget[0] -= 1
                if grow(room - number * length, i, (*chosen, (length, number)), skipped if number == counts[length] else min(skipped, length)):
                    return True
        return False

    grow(room, len(lengths), (), room + 1)
    if not found:  # no steps left: what fits, largest first
        rest, chosen = room, []
        at = len(lengths) - 1
        while at >= 0:
            number = min(rest // lengths[at], counts[lengths[at]])
            if number:
                chosen.append((lengths[at], number))
                rest -= number * lengths[at]
            at = bisect.bisect_right(lengths, rest, 0, at) - 1
        found.append((rest, tuple(chosen)))
    found.sort(key=lambda x: (x[0], tuple(-a for a, _ in x[1])))
    return found[:most], budget[0]


def least_sequences(counts: dict[int, int], size: int) -> int:
    """A lower bound: by waste, with pieces over half (and those that fit beside none of a length) alone in their sequences."""
    lengths = sorted(counts)
    small = [k for k in lengths if 2 * k <= size]
    large = lengths[len(small) :]
    n_large, best = sum(counts[k] for k in large), -(-sum(k * n for k, n in counts.items()) // size)
    # threshold: pieces below it are left out, large ones that leave less room than it are full
    space, total, j = sum((size - k) * counts[k] for k in large), sum(k * counts[k] for k in small), len(large)
    for least in [0, *small]:
        while j and size - large[j - 1] < least:
            j -= 1
            space -= (size - large[j]) * counts[large[j]]
        best = max(best, n_large + max(0, -(-(total - space) // size)))
        total -= least * counts.get(least, 0)
    return best


def plan_packing(counts: dict[int, int], size: int = SIZE, nodes: int = 20_000) -> Plan:
    """The least sequences found for a histogram of lengths; optimal when it meets the bound or the search ends by itself."""
    counts = {k: v for k, v in counts.items() if v}
    best = best_fit_decreasing(counts, size)
    total = sum(k * v for k, v in counts.items())
    bound, best_n = least_sequences(counts, size), sum(m for _, m in best)
    if best_n <= bound:
        return best
    left, lengths, path = dict(counts), sorted(counts), []  # path: (need, many, lengths that it used up)
    used, rest, steps = 0, total, nodes * DIVE_STEPS
    key, names = 0, {k: random.Random(k).getrandbits(120) for k in counts}  # names a state by the pieces that are gone

    def choices(most: int | None, per: int) -> list[dict[int, int]]:
        nonlocal steps
        top = lengths[-1]
        left[top] -= 1
        given = min(per, steps)
        found, unused = fillings(lengths if left[top] else lengths[:-1], left, size - top, most, given)
        left[top] += 1
        steps -= given - unused
        out = []
        for _, chosen in found:
            need = dict(chosen)
            need[top] = need.get(top, 0) + 1
            out.append(need)
        return out

    def take(need: dict[int, int], many: int) -> None:
        nonlocal used, rest, key
        gone = []
        for k, n in need.items():
            left[k] -= n * many
            rest -= k * n * many
            key += names[k] * n * many
            if not left[k]:
                lengths.pop(bisect.bisect_left(lengths, k))
                gone.append(k)
                del left[k]
        used += many
        path.append((need, many, gone))

    def undo() -> None:
        nonlocal used, rest, key
        need, many, gone = path.pop()
        for k in gone:
            left[k] = 0
            bisect.insort(lengths, k)
        for k, n in need.items():
            left[k] += n * many
            rest += k * n * many
            key -= names[k] * n * many
        used -= many

    def hopeless() -> bool:
        return used + -(-rest // size) >= best_n or len(lengths) <= 256 and used + least_sequences(left, size) >= best_n

    def keep() -> None:
        nonlocal best, best_n
        if not lengths and used < best_n:
            best, best_n = [(tuple(need.items()), many) for need, many, _ in path], used

    # dives that take the second filling at one depth
    effort, at = nodes, -1
    while best_n > bound and effort > 0 and at < 64:
        while lengths and effort > 0 and steps > 0 and not used + -(-rest // size) >= best_n:
            effort -= 1
            found = choices(2 if len(path) == at else 1, DIVE_STEPS)
            need = found[min(len(found) - 1, int(len(path) == at))]
            take(need, min(left[k] // n for k, n in need.items()))
        keep()
        while path:
            undo()
        at += 1

    # depth first, with backtracking
    def children() -> Iterator[tuple[dict[int, int], int]]:
        found = choices(None, NODE_STEPS)
        for need in found:
            for many in range(min(left[k] // n for k, n in need.items()), 0, -1):
                yield need, many

    effort, steps, seen = nodes, SEARCH_STEPS, {}
    stack = [children()]
    while stack and best_n > bound and effort > 0 and steps > 0:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if path:
                undo()
            continue
        effort -= 1
        take(*child)
        keep()
        if not lengths or hopeless() or seen.get(key, used + 1) <= used:
            undo()
            continue
        seen[key] = used
        stack.append(children())
    return best


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _encode(path: str, size: int, keep_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(path), END_ID.to_bytes(4, "little")
        schema = _PIECES if keep_ids else pa.schema(list(_PIECES)[:-1])
        yield empty(schema)
        gc.disable()  # lists of words come and go by the million, and none refers back
        try:
            for whole in batches:
                for batch in pieces(whole, SLICE_ROWS, SLICE_MB):
                    rows = []
                    for doc, data in zip(batch.column("doc_id").to_pylist(), ids_of.encode_batch(batch.column("text").to_pylist())):
                        data += end
                        for piece, at in enumerate(range(0, len(data), 4 * size)):
                            part = data[at : at + 4 * size]
                            rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(schema)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        finally:
            gc.enable()

    return lambda batches: at_end(encode(batches), IDS_MB)


def _place(plan: Plan):
    """Looks places up: by length, the ranks at which a new filling begins, and what that filling says."""
    begins, says = defaultdict(list), defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for filling, many in plan:
        offset = 0
        for length, number in filling:
            begins[length].append(taken[length])
            says[length].append((base, number, offset))
            taken[length] += number * many
            offset += number * length
        base += many
    begins, says = {k: np.array(v) for k, v in begins.items()}, {k: np.array(v) for k, v in says.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                at = np.searchsorted(begins[length], ranks[rows], "right") - 1
                first, number, start = says[length][at].T
                inside = ranks[rows] - begins[length][at]
                sequence[rows] = first + inside // number
                offset[rows] = start + inside % number * length
            names = [n for n in batch.schema.names if n not in ("rank", "salt")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return place


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, keep_ids: bool = False, rows_per_salt: int = 20_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of every row of docs.

    path: vocabulary file; keep_ids: carry the token ids of a piece, little-endian 32-bit, as binary.
    """
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    cut = staged(docs_of(docs).mapInArrow(_encode(path, size, keep_ids), columns))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    plan = plan_packing(counts, size)
    salts = max(1, sum(counts.values()) // rows_per_salt)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    key = Window.partitionBy("length", "salt")
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("row", F.row_number().over(key.orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("row") - 1).drop("before", "row")
    ranked = ranked.select(*cut.columns, "rank")
    return ranked.mapInArrow(_place(plan), columns + ", sequence_id long, offset long")
