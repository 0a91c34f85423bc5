"""Cost-balanced packing of token ids into sequences.

A partition of the documents is packed as it is read, in groups of at most GROUP_TOKENS tokens: no shuffle, bounded memory,
and a lost task gives the same rows again. Within a group, whole sequences are cut off long documents; the rests, in
descending order of cost (linear plus quadratic: LINEAR * n + QUADRATIC * n * n, the quadratic part for attention within a
document), each go to the sequence of the lowest cost that has room. There are just as many sequences as the tokens need: a
rest that is longer than the room fills it and goes on with the next one. The tokens that would be padded at the group's end
wait for the next group, so that only a partition's last sequence can have padding.

Null texts are empty: one token, the separator. Null keys stay null, and rows with equal keys are packed each by itself. Rests of
equal cost go in the order of the rows. A very long text is encoded whole and cut into sequences; a group holds it and no more. Only
the key and the text are read, so that no other column can clash. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE, GROUP_TOKENS = 1024, 1 << 21
LINEAR, QUADRATIC = 1024.0, 1.0
SEPARATOR = 0
#: Runs of white space (Unicode's, as the vocabulary's pattern means it) that are too long for a pattern which looks ahead.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
#: Rows that an Arrow batch has at most decide how much text waits in memory.
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE vocabulary file (tokenizers' JSON) as text -> list of ids, by tiktoken: the same ids at five times the speed.

    The file's added tokens in a text have their own ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # byte-level BPE writes byte b as a printable character: itself where it is one, else the next code point from 256
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    whole = tiktoken.Encoding("space", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})  # all of a run is one piece
    return partial(with_long_space, partial(encoding.encode, allowed_special=set(special), disallowed_special=()), whole.encode, tuple(special))


def with_long_space(encode, piece, special: tuple[str, ...], text: str) -> list[int]:
    """encode(text), where long runs of white space are cut out as the pattern would cut them.

    A run is a piece of its own, but for its last character, which goes with what follows; where nothing follows, or a special token, all is.
    """
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) or text.startswith(special, run.end()) else run.end() - 1
        out += encode(text[at : run.start()])
        out += piece(text[run.start() : end])
        at = end
    return out + encode(text[at:]) if out or at else encode(text)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], last: bool, size: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int]], int, list[tuple[int, int]]]:
    """(item, start, length, sequence, offset) of each piece; the number of sequences; (item, start) of what is left to the next group, none if last."""
    pieces, rests, n = [], [], 0
    for item, length in enumerate(lengths):
        for start in range(0, length - size + 1, size):
            pieces.append((item, start, size, n, 0))
            n += 1
        if length % size:
            rests.append((length % size, item, length - length % size))
    rests.sort(key=lambda r: (-r[0], r[1]))
    left = []
    if not last:  # the smallest rests wait, as many as it takes for the others to fill whole sequences
        over = sum(r[0] for r in rests) % size
        while over > 0 and rests:
            length, item, start = rests.pop()
            keep = max(0, length - over)
            over -= length - keep
            left.append((item, start + keep))
            if keep:
                rests.append((keep, item, start))
                rests.sort(key=lambda r: (-r[0], r[1]))
                break
    total = sum(r[0] for r in rests)
    heap = [(0.0, n + i, 0) for i in range(-(-total // size))]
    n += len(heap)
    for length, item, start in rests:
        while length:
            spent, sequence, used = heapq.heappop(heap)
            take = min(length, size - used)
            pieces.append((item, start, take, sequence, used))
            start, length = start + take, length - take
            if used + take < size:
                heapq.heappush(heap, (spent + cost(take), sequence, used + take))
    return pieces, n, left


def pack_documents(documents: DataFrame, vocabulary: str, separator: int = SEPARATOR, size: int = SEQUENCE, name: str = "doc_id") -> DataFrame:
    """One row a piece: the document's key (column `name`, of any type), start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def packed(batches):
        encode = encoder(vocabulary)
        first = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []  # key, tokens before, tokens of the document, ids

        def flush(last: bool):
            nonlocal waiting, first
            pieces, n, left = pack([len(w[3]) for w in waiting], last, size)
            keys, out = [], []
            for item, start, length, sequence, offset in pieces:
                key, before, tokens, ids = waiting[item]
                keys.append(key)
                out.append((before + start, length, zlib.crc32(ids[start : start + length].tobytes()), tokens, first + sequence, offset))
            waiting = [(waiting[i][0], waiting[i][1] + start, waiting[i][2], waiting[i][3][start:]) for i, start in left]
            first += n
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(keys, kept), *(pa.array(c, pa.int64()) for c in columns)], [name, *PIECES.replace(" long", "").split(", ")])

        held, kept = 0, pa.null()
        for batch in batches:
            kept = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(separator)
                waiting.append((key, 0, len(ids), np.array(ids, "<u4")))
                held += len(ids)
                if held >= GROUP_TOKENS:
                    yield flush(False)
                    held = sum(len(w[3]) for w in waiting)
        if waiting:
            yield flush(True)

    kind = documents.schema[name].dataType.simpleString()
    return documents.select(name, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(packed, f"`{name}` {kind}, {PIECES}")
