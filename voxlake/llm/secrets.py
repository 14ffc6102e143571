"""Secret scans by token efficiency.

Three base patterns find assignments, access keys and long hexadecimal runs. The method adds spans of kind `random`:
character runs that a tiktoken vocabulary compresses badly (few characters a token) look random. Known digests (lengths
of MD5, SHA-1, SHA-2), UUIDs and runs without a letter are excluded first, and what has no digit must be compressed worse and
be longer, so that plain words, numbers and identifiers stay clean. A run is judged as a whole and, where that is not
random, by its parts between / = _ -, so that a path in front does not hide a key; neighbouring parts that are all
compressed badly are judged together first. A random span inside a base span is not repeated.

Defined results: null text counts as empty; every row of the input is returned, rows that repeat a doc_id each by its own
text; whole texts are read, and a run is judged whole however long; spans that begin together stand in the order of KINDS;
an empty table gives no rows; other columns are ignored by `find_secrets` and carried by `redact_secrets`; offsets are code
points, end exclusive.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import at_end, bounded_batches, cached, docs_of, empty, pieces

KINDS = ("assign", "access", "hex", "random")
#: Fixed values of the base patterns.
ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Lengths of hexadecimal digests in common use.
DIGESTS = frozenset({32, 40, 48, 56, 64, 96, 128})
#: Least length of a run without inner separators or a part, of a run with them, and of one
#: without a digit in the case of a word.
LEAST, LEAST_RUN, LEAST_LETTERS = 12, 16, 16
#: What has no digit must stay below this share of the ratio; parts judged together need one so long.
LETTERS, LEAST_PART = 0.85, 8
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PART = re.compile(r"[A-Za-z0-9+]+")
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
ONLY_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def written(run: str) -> bool:
    """Whether its case is that of a word."""
    return run.islower() or run.isupper() or run.istitle()


class Scanner:
    def __init__(self, path: str, ratio: float):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ratio = ratio

    def random(self, run: str) -> bool:
        if not _LETTER.search(run) or (len(run) in DIGESTS and ONLY_HEX.fullmatch(run)):
            return False
        ratio = self.ratio
        if not _DIGIT.search(run):
            if (len(run) < LEAST_LETTERS and written(run)) or max(map(len, PART.findall(run))) < LEAST_PART:
                return False
            ratio *= LETTERS
        return len(run) < ratio * len(self.encoding.encode_ordinary(run))

    def randoms(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of what is random in a run; identifiers are cut out first."""
        at, found = 0, []
        for m in UUID.finditer(run):
            found += self._judged(run, at, m.start())
            at = m.end()
        return found + self._judged(run, at, len(run))

    def _judged(self, text: str, begin: int, end: int) -> list[tuple[int, int]]:
        run = text[begin:end]
        return [(begin + a, begin + b) for a, b in self._random_parts(run)] if len(run) >= LEAST else []

    def _random_parts(self, run: str) -> list[tuple[int, int]]:
        parts = [m.span() for m in PART.finditer(run)]
        if (len(run) >= LEAST_RUN or len(parts) == 1) and self.random(run):
            return [(0, len(run))]
        if parts == [(0, len(run))]:
            return []
        groups: list[list[tuple[int, int]]] = [[]]  # neighbours that the vocabulary compresses badly, however short
        for a, b in parts:
            bad = b - a < self.ratio * len(self.encoding.encode_ordinary(run[a:b]))
            groups[-1].append((a, b)) if bad else groups.append([])
        found = []
        for group in filter(None, groups):
            a, b = group[0][0], group[-1][1]
            if b - a >= LEAST and max(y - x for x, y in group) >= LEAST_PART and self.random(run[a:b]):
                found.append((a, b))
            else:
                found += [(x, y) for x, y in group if y - x >= LEAST and self.random(run[x:y])]
        return found

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end), sorted."""
        spans = []
        if ":" in text or "=" in text:
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base = sorted((a, b) for a, _, b in spans)
        begins, reach = [a for a, _ in base], list(itertools.accumulate((b for _, b in base), max))
        for m in CANDIDATE.finditer(text):
            if len(m[0]) < LEAST_LETTERS and m[0].isalpha() and written(m[0]):  # most long words
                continue
            for a, b in self.randoms(m[0]):
                a, b = m.start() + a, m.start() + b
                k = bisect.bisect_right(begins, a)
                if not (k and reach[k - 1] >= b):
                    spans.append((a, 3, b))
        spans.sort()
        return spans


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def find_secrets(docs: DataFrame, path: str, ratio: float = 2.0) -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end>>) of every row; spans by start, then kind as listed in KINDS.

    path: a .tiktoken vocabulary; ratio: characters a token below which a run counts as random.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = cached((Scanner, path, ratio), lambda: Scanner(path, ratio))
        yield empty(_SPANS)
        for whole in batches:
            for batch in pieces(whole):
                found = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in scan(t)] for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS.field(1).type)], schema=_SPANS)

    return docs_of(docs).mapInArrow(lambda batches: at_end(run(batches)), "doc_id long, spans array<struct<start: long, kind: string, end: long>>")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, path: str, ratio: float = 2.0, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text` replaced by the mask; overlapping spans make one mask.

    All columns and rows stay; `n_chars`, where there is one, becomes the new length of changed texts.
    """
    bounded_batches(docs.sparkSession)
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = cached((Scanner, path, ratio), lambda: Scanner(path, ratio))
        for whole in batches:
            for batch in pieces(whole):
                texts = batch.column(at).to_pylist()
                lengths = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
                for row, text in enumerate(texts):
                    spans = scan(text) if text else []
                    if not spans:
                        continue
                    out, end = [], 0
                    for a, _, b in spans:
                        if a >= end:
                            out += [text[end:a], mask]
                        end = max(end, b)
                    texts[row] = "".join([*out, text[end:]])
                    if lengths:
                        lengths[row] = len(texts[row])
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if lengths:
                    k = batch.schema.names.index("n_chars")
                    columns[k] = pa.array(lengths, batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lambda batches: at_end(run(batches)), schema)
