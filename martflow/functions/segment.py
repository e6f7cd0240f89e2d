"""Cutting text without spaces into the words of a dictionary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_WORDS = 2_000_000   # a dictionary beyond this does not fit a task; ``load`` refuses it

Trie = dict


def trie_of(words) -> Trie:
    """Nested dictionaries by letter; the empty string marks the end of a word."""
    root: Trie = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        if word:
            node[""] = True
    return root


def longest_matches(text: str, root: Trie) -> Iterator[str]:
    """From the left, at each place the longest dictionary word; letters that begin
    none are passed over."""
    at, n = 0, len(text)
    while at < n:
        node, end, i = root, 0, at
        while i < n and (node := node.get(text[i])) is not None:
            i += 1
            if "" in node:
                end = i
        if end:
            yield text[at:end]
        at = end or at + 1


def load(dictionary: DataFrame, column: str) -> list[str]:
    """The dictionary's words, lower-cased; refuses one larger than ``MAX_WORDS``."""
    words = dictionary.select(F.lower(column).alias("word")).where("word <> ''").distinct().limit(MAX_WORDS + 1)
    found = [r.word for r in words.collect()]
    if len(found) > MAX_WORDS:
        raise ValueError(f"a dictionary of more than {MAX_WORDS} words")
    return sorted(found)


def dictionary_words(words: list[str]) -> Callable[[Column], Column]:
    """A splitter for ``operators.stats.keywords``: texts to arrays of dictionary words,
    in Arrow batches.  The trie is built once per task; null gives no words."""
    tries: list[Trie] = []

    @F.arrow_udf("array<string>")
    def apply(texts: pa.Array) -> pa.Array:
        if not tries:
            tries.append(trie_of(words))
        cut = [[] if t is None else list(longest_matches(t.lower(), tries[0])) for t in texts.to_pylist()]
        return pa.array(cut, pa.list_(pa.string()))

    return apply


def register_dictionary_function(spark: SparkSession, words: list[str], name: str = "ik_cut") -> None:
    """The same for SQL: ``explode(ik_cut(text))``, or ``LATERAL explode(ik_cut(text)) t(word)``."""
    spark.udf.register(name, dictionary_words(words))
