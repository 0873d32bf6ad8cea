"""Texts put into containers of a fixed number of tokens by harmonic packing.

A text's length decides its class: class k holds lengths in (capacity/(k+1), capacity/k], and each of its containers takes
exactly k texts of the class, so containers are filled without looking at one another, in every partition on its own.  Plain
harmonic packing leaves up to a fifth unused on such texts; here the space that a container's fixed texts leave goes to the
longest texts of later classes that fit, before those classes get containers themselves.  Nothing is shuffled: what travels
between the tokenizer and the packing is an id and a length.

A text longer than the capacity is split into full containers and one rest, which is packed like any other text.

Cases: null texts and null ids are left out; an empty text has no tokens and gets no container; texts of equal length are taken in
the order of their ids, so a partition is packed the same way each time; rows repeated under one id are packed each.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.runtime import durable, ship_package

#: Classes 1 to CLASSES - 1 have a fixed count; the last holds all shorter texts and fills its containers as they come.
CLASSES = 8
#: Texts of a partition packed together; what a task holds is bounded by this, and at most a few containers per so many texts stay partly empty.
AT_ONCE = 1 << 20
_loaded: dict[tuple[str, str], Callable[[list[str]], list[int]]] = {}


def split_pattern() -> str:
    """The pattern that comes with the vocabulary files of this machine."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_counter(path: str, kind: str, pattern: str | None = None) -> Callable[[list[str]], list[int]]:
    """How many tokens each text has under the vocabulary file at `path`; `kind` is tokenizers, tiktoken or sentencepiece.

    A tiktoken file doesn't hold the `pattern` that splits a text before its bytes are merged; it is a parameter.
    """
    if (path, kind) in _loaded:
        return _loaded[path, kind]
    if kind == "tokenizers":
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        count = lambda texts: [len(e.ids) for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    elif kind == "tiktoken":
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        made = tiktoken.Encoding("own", pat_str=pattern or split_pattern(), mergeable_ranks=ranks, special_tokens={})
        count = lambda texts: [len(made.encode_ordinary(t)) for t in texts]
    elif kind == "sentencepiece":
        import sentencepiece

        made = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda texts: [len(x) for x in made.encode(texts, num_threads=1)]
    else:
        raise ValueError(f"no tokenizer library {kind!r}")
    return _loaded.setdefault((path, kind), count)


def lengths(texts: DataFrame, id_col: str, text_col: str, tokenizer: str, kind: str = "tiktoken", pattern: str | None = None) -> DataFrame:
    """(`id_col`, `tokens`) of every text that isn't null. The file `tokenizer` is read here and sent to the executors."""
    ship_package(texts.sparkSession)
    pattern = pattern or (split_pattern() if kind == "tiktoken" else None)
    texts.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles

        count = token_counter(SparkFiles.get(name), kind, pattern)
        for rows in batches:
            yield pd.DataFrame({id_col: rows["_id"].to_numpy(), "tokens": np.array(count(rows["_text"].tolist()), dtype=np.int64)})

    picked = texts.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_id is not null and _text is not null")
    return picked.mapInPandas(counted, T.StructType([T.StructField(id_col, texts.schema[id_col].dataType), T.StructField("tokens", T.LongType())]))


def pack_sizes(sizes: np.ndarray, capacity: int, classes: int = CLASSES) -> np.ndarray:
    """Container number of each size (1..capacity) of one partition."""
    where = np.empty(len(sizes), dtype=np.int64)
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        stock[sizes[i]].append(i)
    # below[s]: the longest length up to s that may be in stock; emptied lengths are skipped for good
    below = [s if stock[s] else s - 1 for s in range(capacity + 1)]

    def longest(space: int) -> int:
        s = space
        while s > 0 and not stock[s]:
            if below[s] == s:
                below[s] = s - 1
            if (t := below[s]) > 0 and not stock[t] and below[t] < t:
                below[s] = below[t]
            s = below[s]
        return max(s, 0)

    number = -1
    for k in range(1, classes + 1):
        # class k: k of its texts to a container, longest first; what space they leave goes to the longest shorter texts that fit
        low = capacity // (k + 1) if k < classes else 0
        while (size := longest(capacity // k)) > low:
            number, space, own = number + 1, capacity, 0
            while size > low and own < k or k == classes and size > 0:
                where[stock[size].pop()] = number
                space, own = space - size, own + 1
                size = longest(min(space, capacity // k))
            while (size := longest(min(space, low))) > 0:
                where[stock[size].pop()] = number
                space -= size
    return where


def pack(measured: DataFrame, id_col: str, size_col: str, capacity: int, *, classes: int = CLASSES) -> DataFrame:
    """Pieces (`id_col`, `piece`, `size`) with their `container`, a text of at most `capacity` being one piece.

    Containers are numbered apart by partition; each partition leaves at most one container a class partly filled.
    """
    if capacity < 1 or classes < 2:
        raise ValueError("capacity must be positive and there must be two classes at least")
    ship_package(measured.sparkSession)
    kind = measured.schema[id_col].dataType

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, parts, waiting = TaskContext.get().partitionId() << 40, [], 0
        for rows in batches:
            parts.append(rows)
            waiting += len(rows)
            if waiting >= AT_ONCE:
                yield fill(parts, base)
                base, parts, waiting = base + (AT_ONCE << 8), [], 0
        if waiting:
            yield fill(parts, base)

    def fill(parts: list[pd.DataFrame], base: int) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True).sort_values(["_size", "_id"], kind="stable", ignore_index=True)
        sizes = rows["_size"].to_numpy()
        pieces = -(-sizes // capacity)
        at = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.where(piece < pieces[at] - 1, capacity, sizes[at] - (pieces[at] - 1) * capacity)
        return pd.DataFrame({id_col: rows["_id"].to_numpy()[at], "piece": piece, "size": size, "container": base + pack_sizes(size, capacity, classes)})

    picked = measured.where(F.col(size_col) > 0).select(F.col(id_col).alias("_id"), F.col(size_col).cast("long").alias("_size"))
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("piece", "size", "container"))])
    return picked.mapInPandas(filled, schema)


def pack_texts(texts: DataFrame, id_col: str, text_col: str, tokenizer: str, kind: str = "tiktoken", capacity: int = 1_024, pattern: str | None = None) -> DataFrame:
    """Every text's pieces and containers, measured by a public tokenizer. The lengths are written once, so that a lost
    executor can't number containers of one partition twice in different ways."""
    return pack(durable(lengths(texts, id_col, text_col, tokenizer, kind, pattern), "token-lengths"), id_col, "tokens", capacity)
