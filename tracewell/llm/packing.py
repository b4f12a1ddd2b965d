"""Packing of tokenised documents into sequences of bounded length.

Documents fall into randomised groups of bounded size; each group is packed
by itself, first-fit decreasing, with a tournament tree over the bins that
holds the largest room below each node, so the first bin with enough room is
found in a logarithmic walk. Documents longer than a sequence are cut into
full sequences and a rest; only rests share bins.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.store import save

CAPACITY, END_ID = 2048, 1
#: Documents of one group; its pieces are packed in one task.
GROUP_DOCS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# Fixed value: the pattern by which byte-level vocabularies of this kind cut a text before merging.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def plain_byte_level(file: dict) -> bool:
    """Whether the file's ids are those of merging bytes in the order of ids, after cutting by PRETOKENS, with nothing before or between."""
    model, cut_, special = file["model"], file["pre_tokenizer"] or {}, file["added_tokens"]
    if model.get("type") != "BPE" or cut_.get("type") != "ByteLevel" or file["normalizer"] is not None:
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if cut_.get("add_prefix_space") or not cut_.get("use_regex", True) or any(t["single_word"] or t["lstrip"] or t["rstrip"] or not t["special"] for t in special):
        return False
    own = model["vocab"].keys() - {t["content"] for t in special}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    return len(own) == 256 + len(merged) and own >= set(byte_letters()) and all(a < b for a, b in zip([255, *merged], merged, strict=False))


@cache
def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def own_tokens(path: str) -> dict[bytes, int]:
    """The bytes of each token of a byte-level file, but the special ones."""
    file, byte = load(path), {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"] for t in file["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level file; special tokens stand for their strings."""
    own = {i: x for x, i in own_tokens(path).items()} | {t["id"]: t["content"].encode() for t in load(path)["added_tokens"]}
    return [own.get(i, b"") for i in range(max(own) + 1)]


def splits_at_spaces(path: str) -> bool:
    """Whether the ids of a text are those of its parts, cut before each space between two characters that aren't white space."""
    return plain_byte_level(load(path))


@cache
def library(path: str, special: bool) -> Callable[[str], np.ndarray]:
    """The ids of a text by the tokenizers library; ``special``: whether special tokens' strings in a text are those tokens."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not special
    return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def encoder(path: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """The ids of a text by the tokenizer file at ``path``, without special tokens of its own around them.

    A plain byte-level file goes to tiktoken, which merges the same way with a
    fraction of the work; any other file to the tokenizers library. A text
    with a run of white space that is too long for tiktoken's pattern goes to
    that library too.
    """
    file = load(path)
    if not plain_byte_level(file):
        return library(path, special)
    import tiktoken

    names = {t["content"]: t["id"] for t in file["added_tokens"]}
    model = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=own_tokens(path), special_tokens=names)
    load.cache_clear()
    allowed = "all" if special else set()

    def ids(text: str) -> np.ndarray:
        try:
            return model.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except ValueError:
            return library(path, special)(text)

    return ids


def encode(text: str, path: str) -> bytes:
    """The ids of a whole text as little-endian 32-bit words."""
    return encoder(path)(text).astype("<u4").tobytes()


def cut(path: str, capacity: int, end_id: int):
    """mapInArrow from (doc_id, text) to PIECES."""
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "", path) + end
                salt += 1
                for a in range(0, len(ids), 4 * capacity):
                    piece = ids[a : a + 4 * capacity]
                    rows.append((doc, a // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, salt))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 6)], names=names)

    return run


class Bins:
    """Bins in order of opening, under a tournament tree of their room."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes ``size`` from the first bin with that much room; its number."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        room[i] -= size
        bin_ = i - self.leaves
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return bin_


def pack_group(group: pa.Table, capacity: int, number: int) -> pa.Table:
    """PACKED of one group of pieces; its sequences have the ids from number << 40 on."""
    group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("salt", "ascending")])
    bins, fill, ids, offsets = Bins(len(group), capacity), {}, [], []
    for size in group["length"].to_pylist():
        at = bins.place(size)
        ids.append((number << 40) + at)
        offsets.append(fill.get(at, 0))
        fill[at] = offsets[-1] + size
    return group.drop_columns(["group", "salt"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """PACKED: each piece of each row of ``docs`` (doc_id, text), with its place.

    A document's ids are those of the tokenizer at ``path`` (a file that every
    executor has), then ``end_id``; a null or empty text has that id alone.
    Every id is in one piece. Rows with equal ids or texts are packed as
    separate documents; a null doc_id stays null. An empty table gives an
    empty result. The group of a document is a hash of its id and its place
    in its partition, so no id is hot; a group has about ``group_docs``. The
    pieces are written before they are grouped, so a task that is run again
    finds the same places.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = save(docs.mapInArrow(cut(path, capacity, end_id), PIECES), "pieces")
    groups = max(1, -(-pieces.filter("start = 0").count() // group_docs))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(groups)))

    return pieces.groupBy("group").applyInArrow(lambda key, group: pack_group(group, capacity, key[0].as_py()), PACKED)
