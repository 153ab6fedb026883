"""Token counts by byte-pair merging, without making any token ids.

A text is cut at the vocabulary's special strings, each of which is one token, and then into words by the byte-level
pattern. A word starts as its UTF-8 bytes, in a linked list; a heap holds the adjacent pairs that some merge names, by rank
and place. The lowest is popped again and again and its two symbols become one. The word's count is its bytes less the
merges made. Words recur, so each worker keeps the counts of words it has met, up to a bound.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of which a worker keeps the counts; beyond that it starts anew. Longer words than KEPT_LENGTH aren't kept.
KEPT_WORDS, KEPT_LENGTH = 1 << 20, 64
#: Texts of more characters are cut into words one by one, so that their words never stand in memory together.
STREAMED = 1 << 20

#: Fixed value: the byte-level cut into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ``regex`` and the tokenizer's library know different Unicode versions, but agree in these ranges; texts with other
#: characters are cut by the library (a test compares the two over all characters in the ranges).
_SURE = re.compile(r"[^\x00-\u0557\u2000-\u208e\u20a0-\ua7cd\uac00-\ud7a3]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    hidden = iter(range(256))
    return [chr(b) if shown else chr(256 + next(hidden)) for b, shown in enumerate(prints)]


class TokenCounter:
    """Counts the tokens of texts under a byte-level vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            parsed = json.load(lines)
        model, before = parsed["model"], parsed["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if model.get("type", "BPE") != "BPE" or not plain or parsed["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} holds no plain byte-level byte-pair vocabulary")
        ids = model["vocab"]
        self.first = [ids[c] for c in byte_symbols()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[left] << 32 | ids[right], (rank, ids[left + right]))
        special = sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = regex.compile(WORD_PATTERN)
        self.kept: dict[str, int] = {}
        self.path = path
        self._library = None

    def word(self, text: str) -> int:
        """The tokens of one word: its bytes less its merges."""
        symbols = [self.first[b] for b in text.encode("utf-8", "replace")]
        n, merges = len(symbols), self.merges
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            found = merges.get(symbols[at] << 32 | symbols[at + 1])
            if found:
                heap.append((found[0], at, found[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            rank, at, made = heapq.heappop(heap)
            right = after[at]
            if symbols[at] < 0 or right >= n or merges.get(symbols[at] << 32 | symbols[right]) != (rank, made):
                continue  # one of the two has been merged since
            symbols[at], symbols[right] = made, -1
            count -= 1
            beyond = after[at] = after[right]
            if beyond < n:
                before[beyond] = at
                found = merges.get(made << 32 | symbols[beyond])
                if found:
                    heapq.heappush(heap, (found[0], at, found[1]))
            left = before[at]
            if left >= 0:
                found = merges.get(symbols[left] << 32 | made)
                if found:
                    heapq.heappush(heap, (found[0], left, found[1]))
        return count

    def cut(self, text: str) -> Iterator[str] | list[str]:
        """The words of a text without special strings."""
        if _SURE.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.words.findall(text) if len(text) <= STREAMED else (m.group() for m in self.words.finditer(text))

    def count(self, text: str) -> int:
        parts, total = [text], 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        kept = self.kept
        for part in parts:
            for word in self.cut(part):
                n = kept.get(word)
                if n is None:
                    n = self.word(word)
                    if len(word) <= KEPT_LENGTH:
                        if len(kept) >= KEPT_WORDS:
                            kept.clear()
                        kept[word] = n
                total += n
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def count_tokens(docs: DataFrame, limit: int = 512, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document's whole text; one pass, no shuffle.

    ``over_limit``: more than ``limit`` tokens. A null text counts as empty: 0 bytes and tokens; white space is tokens
    like any other text. Repeated rows are counted each, null ids are kept, an empty table gives no rows. Very long texts
    are cut into words one at a time; one very long word takes memory in proportion to its bytes. Only doc_id and text are
    taken, so further columns and their names don't matter. Where the vocabulary file isn't on every executor, it fails.
    """
    vocabulary = vocabulary or default_vocabulary()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            ids, texts = batch.columns
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            n_tokens = pa.array((count(t.as_py() or "") for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, n_bytes, n_tokens, pc.greater(n_tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
