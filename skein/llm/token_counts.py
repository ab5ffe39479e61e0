"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import column, pieces

#: Pre-tokenizer pattern of the byte-level rank files: a fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text longer than this many code points is encoded in parts.
PART = 1 << 16
#: Bytes of text in one batch of the encoder.
BATCH_BYTES = 1 << 18
#: A run of white space from so many characters on is too deep for tiktoken's own splitter.
_BLANK = re.compile(r"\s{20000}")
#: A letter or digit, a space, another one: every supported pre-tokenizer ends a token before that space.
_SAFE = re.compile("[A-Za-z0-9](?= [A-Za-z0-9])")


def split_safely(text: str, most: int = PART) -> list[str]:
    """Parts of about ``most`` code points that end where a token must end; a
    text without such a place stays whole."""
    parts, at = [], 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if not m:
            break
        parts.append(text[at : m.end()])
        at = m.end()
    parts.append(text[at:])
    return parts


@lru_cache(maxsize=4)
def encoder(path: str, specials: str | None = None) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts.

    ``.json``: the tokenizers library, a batch of parts a call.  ``.model``: the
    sentencepiece library, whose texts are never split.  ``.tiktoken``:
    byte-level ranks, a text a call; ``specials`` names a tokenizers JSON whose
    added tokens count as one wherever their strings occur, as that library
    does by default.
    """
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        added = []
        if specials:
            with open(specials, encoding="utf-8") as f:
                added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        import regex

        plain = regex.compile(BYTE_LEVEL)

        def one(text: str) -> int:
            if _BLANK.search(text):
                return sum(len(core._encode_single_piece(m.group().encode())) for m in plain.finditer(text))
            return len(core.encode_ordinary(text))

        cut = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

        def count(texts: list[str]) -> list[int]:
            out = []
            for text in texts:
                n, run = 0, [text]
                if cut and cut.search(text):
                    run = cut.split(text)
                    n = len(run) - 1
                out.append(n + sum(one(p) for r in run for p in split_safely(r)))
            return out

    elif path.endswith(".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()

        def count(texts: list[str]) -> list[int]:
            parts = [split_safely(x) for x in texts]
            sizes = iter([len(e) for e in t.encode_batch_fast([p for x in parts for p in x], add_special_tokens=False)])
            return [sum(next(sizes) for _ in x) for x in parts]

    elif path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)

        def count(texts: list[str]) -> list[int]:
            return [len(x) for x in sp.encode(texts, num_threads=1)]

    else:
        raise ValueError(f"no tokenizer library for {path}")
    return count


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, specials: str | None = None, limit: int = 512) -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``,
    ``over_limit`` (more tokens than ``limit``).

    No begin, end or added tokens, no truncation.  A null text counts as empty:
    0 bytes, 0 tokens.  A null id stays null, and repeated rows are counted each
    for itself.  A very long text is encoded in parts where a token must end;
    without such a place (one long run) it is encoded whole.  Other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = column(batch.column(1))
            data = raw.tobytes()
            tokens = np.zeros(batch.num_rows, np.int64)
            for i, j in pieces(off, BATCH_BYTES):  # balanced by bytes, not rows
                at = off[i : j + 1].tolist()
                tokens[i:j] = encoder(path, specials)([data[a:b].decode() for a, b in zip(at, at[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
