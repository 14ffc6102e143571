"""Token counts and token ids under the public vocabularies.

`count_tokens` merges byte pairs with a heap over a linked list: the adjacent pair of lowest rank is popped again and
again, and the count of a piece is its initial symbols minus its merges; no identifier is made. Counts of pieces are
kept in a cache of bounded size. Pieces come from the library's pre-tokenizer pattern; a text with characters whose
classes differ between Unicode versions is cut by the library's own pre-tokenizer.

Defined results: null text counts as empty and has no tokens; whole texts are counted, however long; special strings inside
a text count as the library counts them; every row is returned, rows that repeat a doc_id or have none each by its own text;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voxlake.llm.common import at_end, cached, docs_of, empty, pieces

#: Words whose counts a worker remembers, words whose ids it does, and the letters of the longest.
CACHE, IDS_CACHE, LONG = 900_000, 600_000, 64
#: What a worker that counts may hold when a task ends, so that it keeps its words.
COUNTS_MB = 400
#: Words that the library encodes at once.
TOGETHER = 4096
#: Beyond these characters the pattern engines may follow different Unicode versions.
_NEWER = regex.compile("[^\\x00-\u0557]")
_LATIN = re.compile("[^\\x00-\u012f\u0131-\u017f]")


def latin_only(pattern: str) -> re.Pattern:
    """The same pattern for the faster engine, right for texts within _LATIN: classes are spelled out."""

    def spelled(kind: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(0x180) if regex.match(kind, chr(c)))

    classes = {r"\s": spelled(r"\s"), r"\p{L}": spelled(r"\p{L}"), r"\p{N}": spelled(r"\p{N}")}
    pattern = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(classes.values())}]")
    for name, members in classes.items():
        pattern = pattern.replace(name, f"[{members}]")
    return re.compile(pattern.replace(r"\S", f"[^{classes[chr(92) + 's']}]"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PairMerger(dict):
    """Token counts of pieces, by piece."""

    def __init__(self, spec: dict):
        super().__init__()
        merges = (m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        # the printable stand-ins of bytes: printable Latin-1 stands for itself, the rest follows from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = [b for b in range(256) if b not in set(plain)]
        self.symbols = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode())
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = n
        return n

    def count(self, data: bytes) -> int:
        symbols, ranks = [self.symbols[b] for b in data], self.ranks
        n = len(symbols)
        if n < 2:
            return n
        heap = []
        for i in range(n - 1):
            rank = ranks.get(f"{symbols[i]} {symbols[i + 1]}")
            if rank is not None:
                heap.append((rank, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            merges += 1
            symbols[i] = a = a + b
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(f"{a} {symbols[k]}")) is not None:
                    heapq.heappush(heap, (rank, i, a, symbols[k]))
            h = before[i]
            if h >= 0 and (rank := ranks.get(f"{symbols[h]} {a}")) is not None:
                heapq.heappush(heap, (rank, h, symbols[h], a))
        return n - merges


class TokenCounter:
    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.merger = PairMerger(spec)
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.split_latin = latin_only(public_tokenizers.PATTERN)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None

    def __call__(self, text: str) -> int:
        total, parts = 0, [text]
        if self.special and "<|" in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        lookup = self.merger.__getitem__
        for part in parts:
            if not _LATIN.search(part) and len(part) <= 1 << 21:
                found = self.split_latin.findall(part)
            elif _NEWER.search(part):
                found = [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
            elif len(part) > 1 << 21:
                found = (m.group() for m in self.split.finditer(part))
            else:
                found = self.split.findall(part)
            total += sum(map(lookup, found))
        return total


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        yield empty(_COUNTS)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counter(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, schema=_COUNTS)

    counted = docs_of(docs).mapInArrow(lambda bs: at_end(run(p for b in bs for p in pieces(b)), COUNTS_MB), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", counted.n_tokens > limit)


class WordIds(dict):
    """Little-endian 32-bit ids of a word, by word, for vocabularies whose words are encoded one by one."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.split = latin_only(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words.difference(self) if len(w) <= LONG]
        if len(self) + len(new) > IDS_CACHE:
            self.clear()
            new = [w for w in words if len(w) <= LONG]
        for at in range(0, len(new), TOGETHER):  # what the library returns for a word is large
            part = new[at : at + TOGETHER]
            for word, found in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                self[word] = array("I", found.ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as the library gives them."""
        plain = [None if "<|" in t or _LATIN.search(t) else self.split.findall(t.lower()) for t in texts]
        self.learn(set().union(*(words for words in plain if words)))
        lookup = self.__getitem__
        return [b"".join(map(lookup, words)) if words is not None else array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes() for t, words in zip(texts, plain)]


def word_ids(path: str) -> WordIds:
    return cached((WordIds, path), lambda: WordIds(path))


def token_counter(path: str) -> TokenCounter:
    return cached((TokenCounter, path), lambda: TokenCounter(path))
