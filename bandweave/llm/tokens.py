"""Token counts by the whole-token shortcut, and a byte-level encoder that gives a tokenizer file's ids.

Both read a public tokenizer file and give exactly the ids (or counts) of the `tokenizers` library. Their fast paths are
taken for texts made of characters on which the libraries' Unicode tables cannot differ; any other text, and any text that
holds a special token's string, is encoded by the `tokenizers` library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches

LIMIT = 2048
#: Merged words, and their characters, that a worker remembers; the memory is emptied when it is full.
REMEMBERED, REMEMBERED_CHARACTERS = 300_000, 16 << 20
#: A character beyond which a text goes to the library: all but tab, newline, carriage return, ASCII, Latin letters and signs.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]")
#: The pre-token patterns of the two tokenizer files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _setting(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others
    take the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(path: str) -> tuple[dict[bytes, int], list[str]] | None:
    """The bytes of each token, and the special tokens' strings. None if the merges are not in the order of their results' ids (then
    ids are no ranks), or the file splits texts otherwise."""
    setting = _setting(path)
    model, alphabet = setting["model"], byte_alphabet()
    special = {t["content"]: t["id"] for t in setting["added_tokens"]}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merged]
    plain = setting["normalizer"] is None and setting["pre_tokenizer"].get("type") == "ByteLevel" and not setting["pre_tokenizer"]["add_prefix_space"]
    if not plain or made != sorted(set(made)) or len(made) + 256 != len(model["vocab"]) - len(special.keys() & model["vocab"].keys()):
        return None
    return {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}, list(special)


def _ordinary(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    import tiktoken

    return tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(4)  # a worker keeps it from task to task
def byte_level_encoder(path: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids, as the library gives them without added special tokens.

    If the file's merges are in the order of their results' ids, the ids are ranks, and a rank-based encoder gives the same
    merges; a file for which that doesn't hold is left to the library.
    """
    held: list = []

    def slow(text: str) -> list[int]:
        if not held:
            held.append(_library(path))
        return held[0].encode(text, add_special_tokens=False).ids

    known = _ranks(path)
    if known is None:
        return slow
    fast, marks = _ordinary(known[0]), re.compile("|".join(map(re.escape, known[1])) or r"(?!)")

    def encode(text: str) -> list[int]:
        return slow(text) if UNUSUAL.search(text) or marks.search(text) else fast(text)

    return encode


@lru_cache(4)
def byte_level_offsets(path: str) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """A function from a text to its ids and their offsets (rows of start and end, in code points), as the library gives them where
    strings of special tokens are ordinary text. Tokens that hold parts of a character reach over the whole of it."""
    held: list = []

    def slow(text: str) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            held.append(_library(path))
            held[0].encode_special_tokens = True
        got = held[0].encode(text, add_special_tokens=False)
        return np.array(got.ids, np.int32), np.array(got.offsets, np.int64).reshape(-1, 2)

    known = _ranks(path)
    if known is None:
        return slow
    fast = _ordinary(known[0])
    size = np.zeros(max(known[0].values()) + 1, np.int64)
    for token, i in known[0].items():
        size[i] = len(token)

    def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
        if UNUSUAL.search(text):
            return slow(text)
        ids = np.array(fast(text), np.int32)
        ends = np.cumsum(size[ids])
        offsets = np.stack([ends - size[ids], ends], 1)
        if not text.isascii():
            place = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1  # of each byte's character
            offsets = np.stack([place[offsets[:, 0]], place[offsets[:, 1] - 1] + 1], 1).reshape(-1, 2)
        return ids, offsets

    return encode


def whole_tokens(path: str) -> frozenset[str]:
    """The words that encode alone as the single token of their own entry: every vocabulary string that ends a word is
    encoded by the library, and kept if exactly its own id comes back."""
    alphabet, library = byte_alphabet(), _library(path)
    own: dict[str, int] = {}
    for token, i in _setting(path)["model"]["vocab"].items():
        if token.endswith("</w>"):
            try:
                own[bytes(alphabet[c] for c in token[:-4]).decode()] = i
            except (KeyError, UnicodeDecodeError):
                continue
    words = list(own)
    return frozenset(w for w, e in zip(words, library.encode_batch(words, add_special_tokens=False)) if e.ids == [own[w]])


def _pre_tokens_known(setting: dict) -> bool:
    """Whether the file normalises and splits texts as the fast path does: composed, lower case, white space dropped, WORD_PATTERN."""
    normal, split, model = setting["normalizer"] or {}, setting["pre_tokenizer"] or {}, setting["model"]
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    splits = [(x["type"], x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space")) for x in split.get("pretokenizers", [])]
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and splits == [("Split", {"Regex": WORD_PATTERN}, "Removed", True, None), ("ByteLevel", None, None, None, False)]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"]
    )


class Counter(dict):
    """Tokens of a pre-token: one for a proven whole token, else as many as the library's merges leave. A file that splits texts in
    another way than this one knows is left to the library."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__()
        self.library, self.whole = _library(path), whole
        setting = _setting(path)
        self.marks = re.compile("|".join(re.escape(t["content"]) for t in setting["added_tokens"]) or r"(?!)")
        self.words = regex.compile(WORD_PATTERN).findall
        self.known, self.size = _pre_tokens_known(setting), 0

    def __missing__(self, word: str) -> int:
        n = 1 if word in self.whole else len(self.library.encode(word, add_special_tokens=False).ids)
        if len(self) >= REMEMBERED or self.size + len(word) > REMEMBERED_CHARACTERS:
            self.clear()
            self.size = 0
        self.size += len(word)
        self[word] = n
        return n

    def count(self, text: str) -> int:
        if not self.known or UNUSUAL.search(text) or self.marks.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.words(text.lower())))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no bytes and no tokens. Rows that repeat a doc_id are each counted; a null doc_id stays null.
    An empty table gives an empty result. The tokenizer file at `path` must be present on every executor.
    """
    whole = whole_tokens(path)

    def run(batches):
        counter = Counter(path, whole)
        for batch in batches:
            for part in blocks([batch], "text"):
                n = [counter.count(t) if t else 0 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
