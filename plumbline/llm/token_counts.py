"""Operator 1: token counts by rank-synchronous array merging.

Pre-tokens of many documents are held as one ragged numpy array of symbols. In every round each sequence finds its
lowest-rank pair and merges all places of that pair at once, for all sequences together; the symbols left when no
sequence has a pair in the vocabulary are its tokens. A sequence of LONG symbols or more has arrays of its own, with
links between neighbours and its places sorted by rank, so that a round costs what it changes and not what is there.
Counts of units already seen are kept per Python worker, KEPT_UNITS of them and KEPT_CHARS characters at most.

Cases: null and empty texts have 0 tokens; repeated rows give repeated results; an empty table gives no rows; other
columns of the input are not read. Special tokens written in a text count as one token each, the library's default.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_pieces, share_file, share_package, shared_path
from plumbline.llm.tokens import pieces, segments, units

#: The pre-tokenizer's pattern that the vocabulary file names by "use_regex".
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.iinfo(np.int32).max
#: Entries that a worker keeps of units already counted.
KEPT_UNITS, KEPT_CHARS = 400_000, 50_000_000
#: Symbols from which a sequence is merged by itself.
LONG = 1024


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """A vocabulary file's merges as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.kept_chars = 0

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def long_count(self, piece: bytes) -> int:
        """How many symbols one long pre-token ends with: its lowest rank merges at all its places, round by round."""
        symbols = self.byte_id[np.frombuffer(piece, np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.append(self.pair_ranks(symbols[:-1], symbols[1:]), NO_RANK)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(places: np.ndarray) -> None:
            """Sorts places into the lists of their ranks."""
            own = ranks[places]
            order = np.argsort(own, kind="stable")
            order = order[: np.searchsorted(own[order], NO_RANK)]
            places, own = places[order], own[order]
            cuts = np.flatnonzero(np.diff(own)) + 1
            for part, rank in zip(np.split(places, cuts), own[np.r_[0, cuts]].tolist() if len(own) else [], strict=False):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(part)

        offer(np.arange(n - 1))
        left = n
        while heap:
            rank = heapq.heappop(heap)
            found = waiting.pop(rank)
            place = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            # A place whose pair has changed since has another rank, or none if its symbol is gone.
            place = place[ranks[place] == rank]
            if not len(place):
                continue
            # Of overlapping places, as in a run of one symbol, the first, third and so on merge.
            head = np.r_[True, after[place[:-1]] != place[1:]]
            run_start = np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run_start) % 2 == 0]
            gone = after[place]
            ranks[gone] = NO_RANK
            symbols[place] = self.merged[rank]
            onward = after[gone]
            after[place] = onward
            inside = onward < n
            before[onward[inside]] = place[inside]
            ranks[place[~inside]] = NO_RANK
            left -= len(place)
            previous = before[place]
            changed = np.union1d(place[inside], previous[previous >= 0])
            ranks[changed] = self.pair_ranks(symbols[changed], symbols[after[changed]])
            offer(changed)
        return left

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each pre-token ends with."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if (long := np.flatnonzero(sizes >= LONG)).size:
            found = np.zeros(len(pieces), np.int64)
            found[long] = [self.long_count(pieces[i]) for i in long]
            short = np.flatnonzero(sizes < LONG)
            found[short] = self.counts([pieces[i] for i in short])
            return found
        found = sizes.copy()
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        while len(symbols) > 1:
            ranks = np.full(len(symbols), NO_RANK, np.int32)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            ranks[inside] = self.pair_ranks(symbols[inside], symbols[inside + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            here = ranks == np.repeat(lowest, lengths)
            live = np.repeat(lowest < NO_RANK, lengths)
            found[owner[starts]] = lengths
            here &= live
            # Of overlapping places, as in a run of one symbol, the first, third and so on merge.
            place = np.flatnonzero(here)
            if not len(place):
                break
            head = np.r_[True, np.diff(place) != 1]
            run_start = place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
            place = place[(place - run_start) % 2 == 0]
            symbols[place] = self.merged[ranks[place]]
            live[place + 1] = False
            symbols, owner = symbols[live], owner[live]
            # Sequences that have just ended keep their count: it was set above, and merging ones set it next round.
            found[owner] = np.bincount(owner, minlength=len(pieces))[owner]
        return found

    def learn(self, fresh: list[str]) -> None:
        found, sizes = [], []
        for unit in fresh:
            parts = pieces(self.pattern, unit)
            sizes.append(len(parts))
            found.extend(p.encode("utf-8", "surrogatepass") for p in parts)
        ends = np.cumsum(sizes)
        total = np.r_[0, np.cumsum(self.counts(found))]
        self.known.update(zip(fresh, (total[ends] - total[ends - sizes]).tolist(), strict=True))
        self.kept_chars += sum(map(len, fresh))

    def count_all(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for start, end in in_pieces(texts):
            waiting = []
            for i in range(start, end):
                text = texts[i]
                if self.special is not None:
                    parts = self.special.split(text)
                    out[i] += len(parts) - 1
                else:
                    parts = [text]
                for part in parts:
                    for segment in segments(part):
                        waiting.append((i, units(segment)))
                        if len(segment) > 500_000:
                            self._settle(waiting, out)
            self._settle(waiting, out)
        return out

    def _settle(self, waiting: list[tuple[int, list[str]]], out: list[int]) -> None:
        known = self.known
        if len(known) > KEPT_UNITS or self.kept_chars > KEPT_CHARS:
            known.clear()
            self.kept_chars = 0
        fresh = list(set().union(*(u for _, u in waiting)).difference(known))
        if fresh:
            self.learn(fresh)
        for i, own in waiting:
            out[i] += sum(map(known.__getitem__, own))
        waiting.clear()


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit for every row; vocabulary: path of a byte-level BPE .json file."""
    share_package(docs.sparkSession)
    vocabulary = share_file(docs.sparkSession, vocabulary)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merges(shared_path(vocabulary))
        for batch in batches:
            n = counter.count_all(batch.column("text").to_pylist())
            size = pa.compute.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401  run() names it as pa.compute

    kind = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
