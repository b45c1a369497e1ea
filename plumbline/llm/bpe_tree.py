"""Operator 6: byte-level BPE encoding and decoding by monoid tree reduction.

A piece is encoded by halves, recursively. Two neighbours are joined by encoding a window of tokens around their
boundary anew; the window grows until the token pairs at both its ends are stable, that is, until encoding the bytes
of each pair alone gives the pair back. A token sequence is the encoding of its bytes exactly if every neighbouring
pair is stable, so the tokens outside the window are proven final. Decoding concatenates bytes up the same tree.

Cases: null and empty texts have no ids and decode to no bytes; repeated rows give repeated results; an empty table
gives no rows; other columns of the input are not read. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import share_file, share_package, shared_path
from plumbline.llm.tokens import pieces, segments, units

#: Longest piece, in bytes, that is merged directly; longer ones are halved.
LEAF = 24
NO_RANK = 1 << 62
#: Bytes that a task's remembered pieces and units take at most, about, beside those of one segment: half of them by
#: texts seen of late. An entry's own share, beside its text, ids and bytes, is about OVERHEAD.
KEPT_BYTES, OVERHEAD = 160_000_000, 200


class TreeCodec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        #: Ranks of all pairs of bytes, by first and second byte.
        self.first = [[self.ranks.get(bytes((x, y)), NO_RANK) for y in range(256)] for x in range(256)]
        self.stable = lru_cache(maxsize=50_000)(self._stable)
        #: Packed ids and decoded bytes of pieces and units seen of late, and of those before; used ones come back.
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.kept_bytes = 0

    def _merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first, over a short piece: each merge changes two neighbouring ranks."""
        ranks, get, first, cut = self.ranks, self.ranks.get, self.first, list(range(len(piece) + 1))
        pair = [first[x][y] for x, y in zip(piece, piece[1:])]  # noqa: B905
        while pair and (low := min(pair)) != NO_RANK:
            i = pair.index(low)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(piece[cut[i] : cut[i + 2]], NO_RANK)
            if i:
                pair[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], NO_RANK)
        return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]  # noqa: B905

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same over a long window, with a heap."""
        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, -1
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _direct(self, piece: bytes) -> list[int]:
        return self._merge(piece) if len(piece) <= 64 else self._merge_long(piece)

    def _stable(self, a: int, b: int) -> bool:
        return self._direct(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: the encoding of two neighbours from their encodings."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            window = self._direct(b"".join(map(self.bytes_of.__getitem__, left[-a:] + right[:b])))
            before = a == len(left) or self.stable(left[-a - 1], window[0])
            after = b == len(right) or self.stable(window[-1], right[b])
            if before and after:
                return left[:-a] + window + right[b:]
            if not before:
                a = min(len(left), 2 * a)
            if not after:
                b = min(len(right), 2 * b)

    def encode_tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self._merge(piece)
        half = len(piece) // 2
        return self.join(self.encode_tree(piece[:half]), self.encode_tree(piece[half:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return self.encode_tree(piece) if whole is None else [whole]

    def decode_tree(self, ids: list[int]) -> bytes:
        if len(ids) <= 8:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode_tree(ids[:half]) + self.decode_tree(ids[half:])

    def look_up(self, text: str, is_piece: bool = False) -> tuple[bytes, bytes]:
        """Packed ids and decoded bytes of a piece or unit; those of a unit are its pieces', one after the other."""
        found = self.known.get(text) or self.older.get(text)
        if found is None:
            parts = [text] if is_piece else pieces(self.pattern, text)
            if parts == [text]:
                ids = self.encode_piece(text.encode("utf-8", "surrogatepass"))
                found = struct.pack(f"<{len(ids)}I", *ids), self.decode_tree(ids)
            else:
                own = [self.look_up(p, is_piece=True) for p in parts]
                found = b"".join([f[0] for f in own]), b"".join([f[1] for f in own])
        self.known[text] = found
        # A text takes up to four bytes a character.
        self.kept_bytes += OVERHEAD + 4 * len(text) + len(found[0]) + len(found[1])
        return found

    def parts(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """Packed ids and decoded bytes of the text, segment by segment."""
        for segment in segments(text):
            if self.kept_bytes > KEPT_BYTES // 2:
                self.known, self.older, self.kept_bytes = {}, self.known, 0
            own, known = units(segment), self.known
            for u in set(own).difference(known):
                self.look_up(u)
            found = [known[u] for u in own]
            yield b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def forget(self) -> None:
        """A worker lives on between tasks and stages; what it remembers of texts would stay beside theirs."""
        self.known, self.older, self.kept_bytes = {}, {}, 0


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TreeCodec:
    return TreeCodec(path, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, matches for every row, with keep_ids also the ids themselves.

    vocabulary: path of a rank file; pattern: what splits a text before merging; matches: the ids decode to the text.
    """
    share_package(docs.sparkSession)
    vocabulary = share_file(docs.sparkSession, vocabulary)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(shared_path(vocabulary), pattern)
        try:
            for batch in batches:
                rows = []
                for text in batch.column("text").to_pylist():
                    ids, decoded, n, same, kept = hashlib.sha256(), hashlib.sha256(), 0, hashlib.sha256(), []
                    for packed, raw in tree.parts(text):
                        ids.update(packed)
                        decoded.update(raw)
                        n += len(packed) // 4
                        if keep_ids:
                            kept.append(np.frombuffer(packed, "<u4"))
                    same.update(text.encode("utf-8", "surrogatepass"))
                    rows.append((n, ids.hexdigest(), decoded.hexdigest(), same.digest() == decoded.digest(), np.concatenate(kept).astype(np.int32) if kept else None))
                n, a, b, same, kept = zip(*rows, strict=True) if rows else ((),) * 5
                columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "matches"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            tree.forget()

    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, matches boolean" + ", ids array<int>" * keep_ids
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the decoded bytes of an array of ids; null ids decode to no bytes."""
    share_package(encoded.sparkSession)
    vocabulary = share_file(encoded.sparkSession, vocabulary)
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(shared_path(vocabulary), pattern)
        for batch in batches:
            raw = [tree.decode_tree(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["id", "bytes"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
