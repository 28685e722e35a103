"""Packing of tokenised documents into near-equal windows by Karmarkar-Karp multiway differencing.

One pass, no shuffle: every task tokenises its rows, cuts documents into pieces, and closes a batch of
windows whenever its pieces fill ``batch_windows`` windows. Memory is bounded by one batch and a
megabyte of texts, or one longer text.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.words import slices

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
    "sequence_tokens long"
)


class WordTokenizer:
    """Ids of whole texts, equal to the tokenizer's own, with the ids of frequent words remembered.

    A text of Latin-1 characters is cut where the vocabulary's pre-tokenizer cuts; words not seen before go
    to the tokenizer many at a time, and the last id of each ends a word. Any other text goes to the
    tokenizer whole, and so does every text if the tokenizer's settings are others than those below.
    """

    # The settings of a tokenizer file for which the cuts hold.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

    LETTER, DIGIT, BLANK = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
    PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{DIGIT}]|[^{LETTER}{DIGIT}{BLANK}]+")

    def __init__(self, path: str, end_id: int, limit: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.end = np.array([end_id], "<u4").tobytes()
        settings = json.loads(self.tokenizer.to_str())
        model = {k: v for k, v in settings["model"].items() if k not in ("vocab", "merges")}
        cuts = {"type": "Sequence", "pretokenizers": [self.SPLIT, self.BYTES]}
        self.known_settings = (settings["normalizer"], settings["pre_tokenizer"], model, settings["truncation"]) == (self.NORMALIZER, cuts, self.MODEL, None)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # for pieces that are cut and in lower case already
        self.by_piece = Tokenizer.from_file(path)
        self.by_piece.normalizer = None
        self.by_piece.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not remembered."""
        out: dict[str, bytes] = {}
        for at in range(0, len(new), 500):
            part = new[at : at + 500]
            (coded,) = self.by_piece.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("pieces and ids do not agree")
            data = ids.tobytes()
            out.update((w, data[a:b]) for w, a, b in zip(part, [0, *ends], ends))
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then the end id. Null counts as empty."""
        get, found, missing = self.known.get, [], []
        for text in texts:
            text = text or ""
            try:
                text.encode("latin-1")
                by_piece = self.known_settings and not any(s in text for s in self.special)
            except UnicodeEncodeError:
                by_piece = False
            if not by_piece:
                found.append([self._whole(text)])
                continue
            pieces = self.PIECES.findall(text.lower())
            ids = list(map(get, pieces))
            if None in ids:
                missing.append((ids, [(k, pieces[k]) for k, x in enumerate(ids) if x is None]))
            found.append(ids)
        if missing:
            fresh = self._learn(list({w for _, at in missing for _, w in at}))
            for ids, at in missing:
                for k, w in at:
                    ids[k] = fresh[w]
            if len(self.known) < self.limit:
                self.known.update(fresh)
        return [b"".join(ids) + self.end for ids in found]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: ``windows`` lists of positions in ``sizes`` with near-equal sums.

    A partial partition is its window sums, sorted from largest to smallest less the smallest. The two with
    the widest spread merge, the largest sums of one onto the smallest of the other, until one is left.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    # windows of a partial partition are held sparsely: only those with pieces, largest first
    heap = [(-s, i, [s], [(i,)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        na, nb = len(a), len(b)
        total = na + nb
        if total <= windows:
            sums, parts = a + b, pa_ + pb
        else:  # the smallest of a (from its end) meet the largest of b
            over = total - windows
            sums, parts = a[: na - over], pa_[: na - over]
            if over <= nb:
                met = [(a[na - 1 - k] + b[k], pa_[na - 1 - k] + pb[k]) for k in range(over)]
                sums, parts = sums + b[over:] + [m[0] for m in met], parts + pb[over:] + [m[1] for m in met]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, parts = [sums[k] for k in order], [parts[k] for k in order]
        if len(sums) == windows and sums[-1]:
            low = sums[-1]
            sums = [s - low for s in sums]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, count, sums, parts))
        count += 1
    return [list(p) for p in heap[0][3]] if heap else []


def pack_batch(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of positions whose sums stay within ``capacity``; their number rises while one exceeds it."""
    total = sum(lengths)
    windows = max(1, -(-total // capacity))
    while True:
        packed = [w for w in differencing(lengths, windows) if w]
        if all(sum(lengths[i] for i in w) <= capacity for w in packed):
            return packed
        windows += max(1, windows // 256)


def _cut(n: int, capacity: int, least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Full windows of a document, and its other pieces: halves, quarters, ... of a window, no smaller than
    ``least``, then what is left. Pieces of few sizes fill windows evenly, the small rests level them."""
    full = [(at, capacity) for at in range(0, n - capacity + 1, capacity)]
    at, rest, size = len(full) * capacity, [], capacity // 2
    while size >= least:
        if n - at >= size:
            rest.append((at, size))
            at += size
        size //= 2
    if at < n:
        rest.append((at, n - at))
    return full, rest


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    least: int = 128,
    batch_windows: int = 128,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece of a document with its place in a sequence.

    Documents are cut into full windows and smaller pieces (see ``_cut``); pieces of about ``batch_windows``
    windows at a time are spread by multiway differencing. Null and empty texts are the end
    id alone. Repeated rows are packed as often as they stand there; a null ``doc_id`` is kept. Other columns
    of ``docs`` are not read. An empty table gives no pieces. Sequence ids are unique, not gapless: the high
    32 bits are the input partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_path, end_id)
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # doc, start, length, crc, doc_tokens
        held_tokens = 0
        rows: list[tuple] = []

        def close() -> None:
            nonlocal sequence, held_tokens
            for window in pack_batch([p[2] for p in held], capacity) if held else []:
                window.sort()
                total, offset = sum(held[i][2] for i in window), 0
                for i in window:
                    rows.append((*held[i], sequence, offset, total))
                    offset += held[i][2]
                sequence += 1
            held.clear()
            held_tokens = 0

        for batch in batches:
            for part in slices(batch, 1):
                for doc, data in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    n = len(data) // 4
                    view = memoryview(data)
                    full, rest = _cut(n, capacity, least)
                    for start, length in full:
                        crc = zlib.crc32(view[4 * start : 4 * (start + length)])
                        rows.append((doc, start, length, crc, n, sequence, 0, length))
                        sequence += 1
                    for start, length in rest:
                        held.append((doc, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n))
                        held_tokens += length
                    if held_tokens >= batch_windows * capacity:
                        close()
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows.clear()
        close()
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> WordTokenizer:
    """One per Python worker: the remembered words serve its later tasks too."""
    return WordTokenizer(path, end_id)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=NAMES)
