"""Packing: order-preserving dynamic programming over cuts at document and sentence boundaries."""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
END = 0  # the id after each document
SENTENCE_COST = 2  # what a cut inside a document costs, in padded positions
HARD_COST = 12  # the same inside a sentence
HARD_STEP = 32  # sentences may be cut at multiples of this, of which the length is one too
BLOCK = 1 << 19  # ids that one run of the dynamic programme covers, more only for one longer document
_SEQUENCE_BITS = 33

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Ids of texts as the tokenizer file gives them.

    Texts of Latin letters go through the merge ranks of the same vocabulary, which give the same ids in
    less than half of the time; texts with other scripts or a special token's string, and tokenizers
    without such ranks, go through the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sentence_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            # the byte-level spelling of a line feed is U+010A
            self.sentence_end[i] = token.endswith((".", "!", "?", "Ċ"))
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join(["[\u0250-\U0010ffff]", *map(re.escape, special)]))
        self.fast = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a text with ``END`` after them."""
        if self.fast is None or self.other.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(END)
        return np.array(ids, np.uint32)


def cuts(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, with their costs; 0 is always the first, ``len(ids)`` the last."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[::HARD_STEP] = HARD_COST
    cost[1:][sentence_end[ids]] = SENTENCE_COST
    cost[ends] = 0
    cost[[0, len(ids)]] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_windows(at: list[int], cost: list[int], length: int = LENGTH) -> list[int]:
    """Cut positions of least padding plus cost; consecutive positions are at most ``length`` apart.

    ``f[j] = cost[j] + length - at[j] + min(f[i] + at[i])`` over ``at[j] - length <= at[i] < at[j]``. The
    minimum comes from a queue in which ``f[i] + at[i]`` rises, so each position enters and leaves once.
    """
    keys, before = [0] * len(at), [0] * len(at)
    queue = deque([0])
    keys[0] = at[0]
    for j in range(1, len(at)):
        here = at[j]
        oldest = here - length
        while at[queue[0]] < oldest:
            queue.popleft()
        i = queue[0]
        before[j] = i
        key = keys[i] + length + cost[j]  # f[j] + at[j]
        keys[j] = key
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    path, j = [], len(at) - 1
    while j:
        path.append(at[j])
        j = before[j]
    path.append(at[0])
    return path[::-1]


def tail(start: int, stop: int) -> list[int]:
    """Cuts of the last window: powers of two if those cuts cost less than its padding."""
    rest = stop - start
    parts = [1 << b for b in range(rest.bit_length()) if rest >> b & 1][::-1]
    if (len(parts) - 1) * HARD_COST >= LENGTH - rest:
        return []
    return [start + int(x) for x in np.cumsum(parts)[:-1]]


_IDS: dict[tuple, Ids] = {}  # one per worker and tokenizer


def pack(documents: DataFrame, tokenizer: str, ranks: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most ``LENGTH`` ids; the order of the input is kept.

    Each task packs the documents it reads, in their order, as one stream: there is no shuffle, and
    ids never leave their task. A stream is cut in blocks of about ``BLOCK`` ids; the last window of a
    block opens the next one, so only the last window of a task is short. That one is cut into powers of
    two, which need no padding, where this costs less. Sequence ids are the number of the partition
    and a running number; a lost task makes the same again, as its input split is the same.

    ``tokenizer`` is the path of a byte-level tokenizer file, which every executor can read, and
    ``ranks``, if given, that of the same vocabulary as merge ranks (see ``Ids``). A null text
    is an empty one: a document of the closing id alone. Null or repeated ids are kept as they are,
    each row is a document of its own. An empty table gives no pieces. Other columns are not read.
    """

    def pieces(doc_ids: list, docs: list[np.ndarray], done: int, path: list[int], first: int, partition: int) -> pd.DataFrame:
        """Pieces of a block; its first document has given ``done`` ids to earlier sequences."""
        sizes = np.array([len(d) for d in docs], np.int64)
        ids = np.concatenate(docs)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.asarray(path, np.int64)  # from 0 to the last cut
        edges = np.unique(np.concatenate([starts[starts < bounds[-1]], bounds]))
        left, right = edges[:-1], edges[1:]
        doc = np.searchsorted(starts, left, "right") - 1
        window = np.searchsorted(bounds, left, "right") - 1
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        return pd.DataFrame(
            {
                "doc_id": pd.Series([doc_ids[d][0] for d in doc], dtype="object"),
                "start": left - starts[doc] + np.where(doc == 0, done, 0),
                "length": right - left,
                "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(left.tolist(), right.tolist())],
                "doc_tokens": [doc_ids[d][1] for d in doc],
                "sequence_id": (partition << _SEQUENCE_BITS) + first + window,
                "offset": left - bounds[window],
            }
        )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (tokenizer, ranks) not in _IDS:
            _IDS[tokenizer, ranks] = Ids(tokenizer, ranks)
        encode = _IDS[tokenizer, ranks]
        partition = TaskContext.get().partitionId()
        heads: list[tuple] = []
        docs: list[np.ndarray] = []
        done = held = sequences = 0

        def flush(last: bool) -> pd.DataFrame | None:
            nonlocal heads, docs, done, held, sequences
            ids = np.concatenate(docs)
            at, cost = cuts(ids, np.cumsum([len(d) for d in docs]), encode.sentence_end)
            path = best_windows(at.tolist(), cost.tolist())
            if last:
                path[-1:] = [*tail(path[-2], path[-1]), path[-1]]
            else:
                path = path[:-1]  # the last window stays open
            if len(path) < 2:
                return None
            out = pieces(heads, docs, done, path, sequences, partition)
            sequences += len(path) - 1
            # what the open window holds is the next block's beginning
            taken = path[-1]
            while docs and taken >= len(docs[0]):
                taken -= len(docs[0])
                heads, docs, done = heads[1:], docs[1:], 0
            if docs and taken:
                docs[0] = docs[0][taken:]
                done += taken
            held = sum(len(d) for d in docs)
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text if isinstance(text, str) else "")
                heads.append((None if doc_id is None else int(doc_id), len(ids)))
                docs.append(ids)
                held += len(ids)
                if held >= BLOCK and (out := flush(False)) is not None:
                    yield out
        if docs:
            yield flush(True)

    # as text, a null among ids does not turn them into floating-point numbers
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(work, SCHEMA)


def query(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
