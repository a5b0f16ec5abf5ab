"""What can be swapped: each is a function of columns or DataFrames, with an offline default in the library."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame


class Tokenizer(Protocol):
    """Text to an array of tokens (default: ``functions.text.tokens``)."""

    def __call__(self, text: Column) -> Column: ...


class Chunker(Protocol):
    """Text to an array of chunks (default: ``functions.chunking.chunks_of``)."""

    def __call__(self, text: Column) -> Column: ...


class Embedder(Protocol):
    """Text to a vector (default: ``operators.ingest.hashing_embedder``)."""

    def __call__(self, text: Column) -> Column: ...


class Reranker(Protocol):
    """Query and content to a score in 0 .. 1 (default: ``plans.hybrid.lexical_reranker``)."""

    def __call__(self, query: Column, content: Column) -> Column: ...


class Retriever(Protocol):
    """Queries to ranked hits (query_id, chunk_id, rank, score)."""

    def __call__(self, queries: DataFrame, k: int) -> DataFrame: ...


class Summariser(Protocol):
    """Contents of the messages left out, in order, to one text (default: ``operators.conversation.extract``)."""

    def __call__(self, contents: Column) -> Column: ...


class Contextualiser(Protocol):
    """Document and chunk to a prefix for the chunk (default: none)."""

    def __call__(self, document: Column, chunk: Column) -> Column: ...
