"""Encoding and decoding a corpus with a public byte-level BPE."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the rank file of the tokenizer lies; a parameter of every operator here.
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts longer than this many characters are split at safe boundaries into parts of about this length.
LONG_TEXT = 20_000

_SPACE = " \t\n\v\f\r\x85\xa0  -     　"
_LONG_RUN = re.compile(f"[{_SPACE}]{{1000,}}")
#: A new token always starts at white space after a visible character, whatever stands before or after.
_BOUNDARY = re.compile(r"(?<=[!-~])[ \n]")


@lru_cache(maxsize=4)
def encoding(rank_file: str = RANK_FILE):
    """The encoding of a rank file, built once per Python worker; it has no special tokens."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a long text whose encodings concatenate to the encoding of the text.

    A part is (characters, whole): a whole part is one long run of white space and one piece for the
    merges. White space before a visible character gives its last character to what follows, so such a run ends
    one character early; the run at the end of the text is whole.
    """
    at = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((p, False) for p in _visible_parts(text[at : run.start()]))
        yield text[run.start() : end], True
        at = end
    yield from ((p, False) for p in _visible_parts(text[at:]))


def _visible_parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > LONG_TEXT:
        cut = _BOUNDARY.search(text, at + LONG_TEXT)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def encode(text: str | None, enc) -> list[int]:
    """Token ids of a text; none for an empty or null one. Names of special tokens are ordinary text."""
    if not text:
        return []
    if len(text) <= LONG_TEXT:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part, whole in _parts(text):
        out += enc._core_bpe.encode_single_piece(part.encode()) if whole else enc.encode_ordinary(part)
    return out


def decode_bytes(ids, enc) -> bytes:
    """The raw bytes of token ids; a cut inside a character leaves an incomplete sequence."""
    return enc.decode_bytes(list(ids))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row.

    Empty and null texts give an empty list, a null id stays null, repeated rows stay repeated and other columns are
    ignored. The encoding runs where the rows lie, without a shuffle.
    """

    def run(batches):
        enc = encoding(rank_file)
        for b in batches:
            lists = [encode(t, enc) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, type=pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """``id_col`` and ``n_tokens`` (bigint) of every row; 0 for empty and null texts."""

    def run(batches):
        enc = encoding(rank_file)
        for b in batches:
            n = [len(encode(t, enc)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str = RANK_FILE) -> DataFrame:
    """``id_col``, ``raw`` (the bytes of the ids) and ``text`` of every row.

    Bytes that are not UTF-8 become U+FFFD in ``text``; ``raw`` always holds exactly what was encoded. A null list
    gives empty bytes.
    """

    def run(batches):
        enc = encoding(rank_file)
        for b in batches:
            raw = [decode_bytes(ids or [], enc) for ids in b.column(1).to_pylist()]
            text = [r.decode("utf-8", errors="replace") for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(raw, type=pa.binary()), pa.array(text, type=pa.string())], names=[id_col, "raw", "text"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, raw binary, text string")
