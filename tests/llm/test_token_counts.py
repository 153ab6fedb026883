import json
import sys

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meadowlark.llm import token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
library = Tokenizer.from_file(PATH)
own = token_counts.TokenCounter(PATH)


def expected(text):
    return len(library.encode(text, add_special_tokens=False).ids)


piece = st.one_of(
    st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "'s", "'ll", " the", "  ", "\n\n", "\t", "\x1c", "\x85", "\xa0", "—", "漢字", "٣", "é", "é", "\U00010940", "ՙ"]),
    st.text(max_size=8),
    st.text("ab e\n", max_size=30),
)


@settings(max_examples=500, deadline=None)
@given(st.lists(piece, max_size=20).map("".join))
def test_equals_library(text):
    assert own.count(text) == expected(text)


def naive(symbols, ranks):
    """Merging by the definition: the lowest pair, the leftmost of equal ones, until none is left."""
    while True:
        found = [(ranks[p], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not found:
            return len(symbols)
        k = min(found)[1]
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text("aeinorst", max_size=40), st.text(max_size=12)))
def test_word_equals_naive_merging(word):
    symbols = token_counts.byte_symbols()
    merges = {tuple(m): k for k, m in enumerate(json.load(open(PATH, encoding="utf-8"))["model"]["merges"])}
    assert own.word(word) == naive([symbols[b] for b in word.encode()], merges)


def test_long_words_and_texts(monkeypatch):
    for text in ("x" * 70_000, "ab" * 20_000, "the cat " * 20_000, " " * 30_000, "\n" * 9_999 + "a"):
        assert own.count(text) == expected(text)
    monkeypatch.setattr(token_counts, "STREAMED", 10)
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 5)
    text = "Some words, more words; and <|endoftext|> others' words, over and over: 12,345."
    assert token_counts.TokenCounter(PATH).count(text) == expected(text)


def test_cuts_agree_over_all_sure_characters():
    """Both cuts over every character that the pattern is trusted with, beside a letter, a digit and a sign."""
    sure = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and not token_counts._SURE.search(chr(c))]
    assert len(sure) > 40_000
    for k in range(0, len(sure), 512):
        text = "".join(f"a{c}1{c}!{c}\n" for c in sure[k : k + 512])
        assert own.words.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.TokenCounter(str(public_tokenizers.path("word_bpe_49k.json")))


def test_tables(spark, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("n_chars", "n_tokens")
    rows = token_counts.count_tokens(docs).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), expected(r["text"] or "")) for r in odd_docs.collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order([tuple(r) for r in rows]) == order([(*w, w[2] > 512) for w in want])
    assert token_counts.count_tokens(no_docs).collect() == []
    assert {r["over_limit"] for r in token_counts.count_tokens(odd_docs, limit=0).collect() if r["n_tokens"]} == {True}
