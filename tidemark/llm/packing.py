"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Each partition packs a bounded number of pieces on its own, so nothing meets in one
place and at most part of one sequence per partition is lost.  Within a partition the
lengths form a histogram.  Around the largest unpacked piece, fillings of the rest of its
sequence are enumerated depth first, longest piece first, which leaves out fillings
dominated by a longer piece that fits; branches whose waste bound is not below the
incumbent are pruned.  A first packing uses each best filling as often as the histogram
allows.  Where it has more sequences than the total length needs, whole packings are
searched: the few best fillings of the largest piece are branched on, used as often as they
last or once, while the waste stays within what a given number of sequences leaves.  Both
searches have node limits, so the least number of sequences is not guaranteed.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import cut, field, lean, ship, worker_state

ship(__name__)

CAPACITY, PIECES_PER_PARTITION, NODES, CACHED_WORDS, TOGETHER = 2048, 10_000, 400, 400_000, 64
#: Fillings branched on for each sequence, and nodes of the search for a whole packing.
FILLINGS, SEARCHED = 4, 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Texts with special-token strings, or with separators that only Python counts as white space, are encoded whole.
#: So are texts with a capital sigma, whose lower case depends on its place.
WHOLE = re.compile(r"<\||[\x1c-\x1f\u03a3]")
#: Punctuation at the end of a word is a pre-token of its own.
ENDINGS = ".,;:!?%&*$#|"


def default_tokenizer() -> str:
    """The installed vocabulary file that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never joins tokens across it, or between letters
    and punctuation, so ids of a text are those of its words in order.  Words seen before
    come from bounded tables.  New words of letters are encoded in one call and told apart by
    the mark that ends a word's last token.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_stems(self, stems: list[str]) -> None:
        """Words of lower-case letters: each is one pre-token."""
        ids = np.asarray(self.tokenizer.encode(" ".join(stems), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(stems):
            raw, starts = ids.tobytes(), [0, *(4 * ends[:-1]).tolist()]
            self.stems.update((w, raw[i:j]) for w, i, j in zip(stems, starts, (4 * ends).tolist(), strict=True))
        else:  # a letter that normalises to more than letters
            self.stems.update((w, self._whole(w)) for w in stems)

    def learn(self, words: list[str]) -> None:
        if len(self.words) + len(words) > self.limit:
            self.words.clear()
        if len(self.stems) + len(words) > self.limit:
            self.stems = {"": b""}
        split, new = [], {}
        for word in words:
            stem = word.rstrip(ENDINGS)
            if stem and not stem.isalpha():
                self.words[word] = self._whole(word)
                continue
            end = word[len(stem) :]
            split.append((word, stem, end))
            if stem not in self.stems:
                new[stem] = None
            if end not in self.stems:
                self.stems[end] = self._whole(end)
        if new:
            self._learn_stems(list(new))
        stems = self.stems
        self.words.update((word, stems[stem] + stems[end]) for word, stem, end in split)

    @staticmethod
    def _split(text: str) -> list[str] | None:
        """Lower-case words, or none where lower-casing or composing the whole differs from doing so by word."""
        low = text.lower()
        if WHOLE.search(text) or not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
            return None
        return low.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a few texts."""
        plain = [self._split(t) for t in texts]
        found = set().union(*filter(None, plain))
        missing = found.difference(self.words)
        if missing and len(self.words) + len(missing) > self.limit:
            self.words.clear()
            missing = found
        if missing:
            self.learn(list(missing))
        known = self.words
        return [self._whole(t) if words is None else b"".join(map(known.__getitem__, words)) for t, words in zip(texts, plain, strict=True)]


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_state(f"encoder {path}", lambda: Encoder(path))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch["text"]]
            encoded = (ids for at in range(0, len(texts), TOGETHER) for ids in encoder.encode(texts[at : at + TOGETHER]))
            for doc_id, ids in zip(batch["doc_id"], encoded, strict=True):
                ids = ids + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every document: its ids and ``end_id``, cut after each ``capacity`` ids."""
    source = docs.select(field(docs, "doc_id", "long").alias("doc_id"), field(docs, "text", "string").alias("text"))
    return source.mapInPandas(lean(_cut(tokenizer, end_id, capacity)), PIECES)


class Filler:
    """Fillings of one sequence from a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int = NODES):
        self.left, self.capacity, self.nodes = Counter(counts), capacity, nodes
        self.lengths = sorted(self.left)

    def best_fit(self, room: int) -> tuple[int, list[int]]:
        """Always the longest piece that fits: the incumbent."""
        filling, used = [], Counter()
        at = bisect_right(self.lengths, room) - 1
        while at >= 0:
            length = self.lengths[at]
            take = min(room // length, self.left[length] - used[length])
            filling += [length] * take
            used[length] += take
            room -= take * length
            at = min(at, bisect_right(self.lengths, room)) - 1
        return room, filling

    def fill(self, room: int) -> list[int]:
        """A filling of least waste, as far as the node limit lets it be proved."""
        self.best, self.filling = self.best_fit(room)
        self.volume = list(np.cumsum([x * self.left[x] for x in self.lengths])) if len(self.lengths) < 128 else None
        self.used, self.visited = Counter(), 0
        if self.best:
            self._branch(room, len(self.lengths), [])
        return self.filling

    def _free(self, length: int) -> bool:
        return self.left[length] > self.used[length]

    def _branch(self, room: int, below: int, chosen: list[int]) -> None:
        self.visited += 1
        if room < self.best:
            self.best, self.filling = room, list(chosen)
        at = min(bisect_right(self.lengths, room), below) - 1
        while at >= 0 and self.best and self.visited <= self.nodes:
            length = self.lengths[at]
            if self.volume is not None and room - self.volume[at] >= self.best:
                return  # all shorter pieces together leave no less waste
            if self._free(length):
                self.used[length] += 1
                self._branch(room - length, at + 1, [*chosen, length])
                self.used[length] -= 1
            at -= 1

    def fillings(self, room: int, most: int, keep: int = FILLINGS) -> list[tuple[int, list[int]]]:
        """Up to ``keep`` fillings that nothing left fits into, with a waste of at most ``most``, the least first."""
        self.found, self.most, self.keep, self.visited = [], most, keep, 0
        self.volume = list(np.cumsum([x * self.left[x] for x in self.lengths])) if len(self.lengths) < 128 else None
        self.used = Counter()
        self._offer(*self.best_fit(room))
        self._collect(room, len(self.lengths), [])
        return self.found

    def _offer(self, waste: int, filling: list[int]) -> None:
        if waste <= self.most and (waste, filling) not in self.found:
            self.found = sorted([*self.found, (waste, filling)], key=lambda f: f[0])[: self.keep]
            if len(self.found) == self.keep:
                self.most = self.found[-1][0] - 1  # later ones must be better

    def _collect(self, room: int, below: int, chosen: list[int]) -> None:
        self.visited += 1
        fitting = bisect_right(self.lengths, room)
        if room <= self.most and not any(self._free(x) for x in self.lengths[:fitting]):
            self._offer(room, chosen)
        at = min(fitting, below) - 1
        while at >= 0 and self.most >= 0 and self.visited <= self.nodes:
            length = self.lengths[at]
            if self.volume is not None and room - self.volume[at] > self.most:
                return
            if self._free(length):
                self.used[length] += 1
                self._collect(room - length, at + 1, [*chosen, length])
                self.used[length] -= 1
            at -= 1

    def around_largest(self, find) -> tuple[int, object]:
        """The largest piece, and what ``find`` says of the rest of its sequence without it."""
        largest = self.lengths[-1]
        self.left[largest] -= 1
        spare = self.left[largest] > 0
        if not spare:
            self.lengths.pop()
        found = find(self.capacity - largest)
        if not spare:
            self.lengths.append(largest)
        self.left[largest] += 1
        return largest, found

    def lasts(self, pattern: list[int]) -> int:
        return min(self.left[x] // n for x, n in Counter(pattern).items())

    def put_back(self, pattern: list[int], times: int) -> None:
        for x, n in Counter(pattern).items():
            if not self.left[x]:
                insort(self.lengths, x)
            self.left[x] += n * times

    def take(self, pattern: list[int], times: int | None = None) -> int:
        """Use a pattern so many times, or as often as its pieces last."""
        need = Counter(pattern)
        times = times or self.lasts(pattern)
        for x, n in need.items():
            self.left[x] -= n * times
            if not self.left[x]:
                del self.left[x]
                self.lengths.pop(bisect_right(self.lengths, x) - 1)
        return times


def within(counts: dict[int, int], capacity: int, sequences: int, nodes: int, searched: int) -> tuple[list[tuple[list[int], int]] | None, int]:
    """(a packing in at most so many sequences, if one was found; nodes searched)."""
    filler, spent, failed = Filler(counts, capacity, nodes), 0, set()
    spare = sequences * capacity - sum(x * n for x, n in counts.items())

    def choices() -> list[tuple[list[int], int, int]]:
        nonlocal spent
        largest, found = filler.around_largest(lambda room: filler.fillings(room, spare))
        spent += filler.visited
        often = [([largest, *f], min(filler.lasts([largest, *f]), spare // waste if waste else len(f) + counts[largest]), waste) for waste, f in found]
        return [*often, *((p, 1, waste) for p, times, waste in often if times > 1)][::-1]

    # Levels of the search: state, choices left, choice in use.
    levels: list[list] = []
    while True:
        if not filler.lengths:
            return [level[2][:2] for level in levels], spent
        state = (spare, *sorted(filler.left.items())) if len(filler.lengths) <= 64 else None
        levels.append([state, [] if state in failed else choices(), None])
        while not levels[-1][1]:
            if levels[-1][0] is not None:
                failed.add(levels[-1][0])
            levels.pop()
            if not levels:
                return None, spent
            pattern, times, waste = levels[-1][2]
            filler.put_back(pattern, times)
            spare += waste * times
        if spent > searched:
            return None, spent
        pattern, times, waste = levels[-1][2] = levels[-1][1].pop()
        filler.take(pattern, times)
        spare -= waste * times


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, searched: int = SEARCHED) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is used, packing every piece."""
    filler, patterns = Filler(counts, capacity, nodes), []
    while filler.lengths:
        largest, filling = filler.around_largest(filler.fill)
        pattern = [largest, *filling]
        patterns.append((pattern, filler.take(pattern)))
    needed = max(-(-sum(x * n for x, n in counts.items()) // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))
    for sequences in range(needed, sum(times for _, times in patterns)):
        found, spent = within(counts, capacity, sequences, nodes, searched // 2)
        if found is not None:
            return found
        searched -= spent
        if searched <= 0:
            break
    return patterns


def _pack(capacity: int, nodes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # one partition: PIECES_PER_PARTITION narrow rows
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        following = {x: int(np.searchsorted(lengths, x)) for x in counts}
        sequence, offset = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
        number = TaskContext.get().partitionId() << 32
        for pattern, times in complete(counts, capacity, nodes):
            for _ in range(times):
                at = 0
                for length in pattern:
                    row = following[length]
                    following[length] = row + 1
                    sequence[row], offset[row] = number, at
                    at += length
                number += 1
        yield rows.assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, nodes: int = NODES) -> DataFrame:
    """Place every piece of every document in a sequence of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null
    text is empty and gives one piece holding ``end_id``; a null doc_id stays null; repeated
    rows are packed each; an empty table gives no rows; other columns are not read.
    """
    found = cut(pieces(docs, tokenizer, end_id, capacity))
    partitions = max(1, -(-found.count() // per_partition))
    return found.repartition(partitions).mapInPandas(_pack(capacity, nodes), PACKED)
