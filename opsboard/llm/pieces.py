"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text becomes a lattice: its arcs are vocabulary pieces and single characters, and its encoding is the best
path. In a unigram model an arc weighs its piece's score and any arc may follow any other. In a BPE model all
arcs weigh nothing, and an arc may follow another only if merging the two alone gives them back; exactly one
path has such pairs only, the one that merging the whole text gives. At each position only the best path to
it counts, so one pass finds it.

A document longer than `chunk_chars` is split into chunks. The state at a cut is the arc over the character
before it; both neighbours list the possible ones from the same few characters. Each chunk gives a matrix of
best scores from any state at its start to any at its end. The matrices are combined associatively, first
within blocks of `FAN` chunks, then over a document's blocks, from which the states at the block borders, then
at the chunk borders follow; then every chunk is traced back for itself. A string holds at most 2^31
characters, hence at most 2^31 / (chunk_chars * FAN) blocks of one document meet.

No piece has a space after another character, so the lattice falls apart at the start of each word. It also
does between characters that no piece brings together, like letters and punctuation in most models: characters
that stand side by side in some piece are of one group, and a word ends where the group changes. Words are
solved once and remembered.

Defined results: a null text has null ids, an empty one none; a character without a piece becomes its bytes;
equal long texts are encoded once; repeated documents are returned each; extra columns are kept by `encode`
unless they bear the name of an output column. U+2581 decodes as a space, as in the original library.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard.llm.common import fresh, ship, sliced, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 16_384
FAN = 64
SPACE = "▁"
MOST_CACHED = 100_000  # words, and pairs of pieces
PAIR_BITS = 18  # pairs of ids told apart lie in so many slots, as a power of two
MOST_KEPT = 50_000  # of them when a task is over: the worker lives on, and other operators need its memory
AT_ONCE = 1 << 20  # possible arcs of the words solved together, which are of much the same length
TOGETHER = 2_000_000  # characters whose words are solved together
LONGEST_WORD = 32  # of the words that are solved many at a time
MOST_GROUPS = 16  # of characters that words are told apart by; the characters of all others count as one
_NORMAL, _BYTE, _UNIGRAM, _BPE = 1, 6, 1, 2
# What lies between spaces, or a line break: no piece holds one, so it stands alone as well.
_WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_BREAK = re.compile(f"(?<=[^{SPACE}]){SPACE}")  # where a word begins behind another
NONE = -np.inf
_BASE = 0x9E3779B97F4A7C15


class Numbers(dict):
    """The number of each word, in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Lattice(dict):
    """Encoder and decoder of one model; as a dict it remembers the ids of words, as bytes of int32."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        form, trainer = model.normalizer_spec, model.trainer_spec
        if form.precompiled_charsmap or not form.add_dummy_prefix or form.remove_extra_whitespaces or not trainer.byte_fallback:
            raise ValueError("only models with identity normalisation, a leading space and byte fallback")
        if trainer.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models")
        self.bpe = trainer.model_type == _BPE
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("only models whose pieces stay within words")
        if any("\n" in p for p in self.ids):
            raise ValueError("only models without pieces across lines")
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.score.values()) - 10
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == _BYTE}
        of_byte = {k: bytes([b]) for b, k in self.bytes.items()}
        self.surface = [
            of_byte.get(k, p.piece.encode() if p.type == _NORMAL else b" \xe2\x81\x87 " if p.type == 2 else b"")
            for k, p in enumerate(model.pieces)
        ]
        self.table = np.frombuffer(b"".join(self.surface), np.uint8)  # all surfaces, one after the other
        self.sizes = np.array([len(x) for x in self.surface], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.word = re.compile(self._pattern(self.ids))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        ranks = {score: k for k, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.piece = {k: p for p, k in self.ids.items()}
        # by hash times an odd number, whose upper bits tell short pieces apart as well
        ordered = sorted((self._hash(p) * _BASE % (1 << 64), k) for p, k in self.ids.items())
        self.hashes = np.array([h for h, _ in ordered], np.uint64)
        self.of_hash = np.array([k for _, k in ordered], np.int64)
        if len(np.unique(self.hashes)) < len(ordered):
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)  # most characters' runs are no piece; this tells so at once
        slots = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.maybe[slots] = True
        self.least_of = np.searchsorted(slots, np.arange(1 << 20)).astype(np.int32)  # where the hashes of a slot begin
        self.most_in_slot = int(np.bincount(slots).max())
        self.weights = np.array([self.score.get(p.piece, self.unknown) for p in model.pieces])
        # pairs of ids already told apart, by a slot of their own; a pair that finds another in its slot takes it
        self.pair_key, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.order = {p: ranks[score] for p, score in self.score.items()}  # the lower, the earlier it merges
        # For pairs told apart many at once, by number: the ids, then characters that only occur within pieces.
        self.number = {**self.ids, **{c: len(model.pieces) + k for k, c in enumerate(sorted(set("".join(self.ids)) - self.ids.keys()))}}
        n = len(model.pieces) + len(self.number) - len(self.ids)
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self.hash_of, self.power_of = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.rank_of = np.full(n, -1, np.int64)  # -1 for a single character
        self.half_of = np.full((2, n), -2, np.int64)  # -1 for a piece that never merges, -2 where not looked up yet
        names = list(self.number)
        at = np.array([self.number[p] for p in names])
        self.name = dict(zip(at.tolist(), names, strict=True))
        self.hash_of[at] = [self._hash(p) for p in names]
        self.power_of[at] = self.powers[[len(p) for p in names]]
        self.rank_of[at] = [self.order[p] if len(p) > 1 else -1 for p in names]

    @staticmethod
    def _pattern(pieces: Iterable[str]) -> str:
        """A word: spaces, then characters of one group, those that are neighbours in pieces, or of none."""
        root: dict[str, str] = {}

        def found(c: str) -> str:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for piece in pieces:
            inner = piece.lstrip(SPACE)
            for a, b in zip(inner, inner[1:], strict=False):
                root[found(a)] = found(b)
        groups: dict[str, list[str]] = {}
        for c in root:
            groups.setdefault(found(c), []).append(c)
        sets = ["".join(map(re.escape, sorted(g))) for g in sorted(groups.values(), key=len, reverse=True)[:MOST_GROUPS]]
        kinds = "|".join([*(f"[{g}]+" for g in sets), f"[^{''.join(sets)}{SPACE}\n]+"])
        return f"{SPACE}*(?:{kinds})|{SPACE}+|\n"

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best neighbours merge first, of equals the leftmost."""
        parts = list(text)
        while True:
            scored = [(-s, k) for k in range(len(parts) - 1) if (s := self.score.get(parts[k] + parts[k + 1])) is not None]
            if not scored:
                return parts
            k = min(scored)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def halved(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merge last when `piece` is merged alone; none if it never becomes one."""
        if piece not in self.halves:
            parts = list(piece)
            while len(parts) > 2:
                scored = [(-s, k) for k in range(len(parts) - 1) if (s := self.score.get(parts[k] + parts[k + 1])) is not None]
                if not scored:
                    break
                k = min(scored)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[piece]

    def fits(self, piece: str, after: str) -> bool:
        """Whether merging the two alone gives them back: `merged(piece + after) == [piece, after]`.

        Merges are undone, the latest first. Had a merge across the border come before one that is undone, it
        would have been made instead; of equal ones the left one comes first.
        """
        limit, order = len(self.order) + 1, self.order
        while True:
            if order.get(piece + after, limit) < limit:
                return False
            left, right = (order[p] if len(p) > 1 else -1 for p in (piece, after))
            if left < 0 and right < 0:
                return True
            halves = self.halved(piece if left > right else after)
            if halves is None:
                return False
            if left > right:
                limit, piece = left, halves[1]
            else:
                limit, after = right + 1, halves[0]

    def _id_of(self, hashes: np.ndarray) -> np.ndarray:
        """The ids of the pieces with these hashes, -1 where there is none."""
        ids, mixed = np.full(len(hashes), -1, np.int64), hashes * np.uint64(_BASE)
        slots = mixed >> np.uint64(44)
        some = np.flatnonzero(self.maybe[slots])
        wanted, at = mixed[some], self.least_of[slots[some]]
        for _ in range(self.most_in_slot - 1):
            at = np.minimum(at + (self.hashes[at] < wanted), len(self.hashes) - 1)
        true = self.hashes[at] == wanted
        ids[some[true]] = self.of_hash[at[true]]
        return ids

    def _halves_of(self, numbers: np.ndarray, side: int) -> np.ndarray:
        """halved for numbers of pieces: the numbers of their left (0) or right (1) parts, -1 where there are none."""
        for k in set(numbers[self.half_of[0, numbers] == -2].tolist()):
            halves = self.halved(self.name[k])
            self.half_of[:, k] = [self.number[p] for p in halves] if halves else -1
        return self.half_of[side, numbers]

    def fits_all(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """fits for arrays of ids."""
        told, at = np.zeros(len(before), bool), np.arange(len(before))
        limit = np.full(len(before), len(self.order) + 1, np.int64)
        while at.size:
            merged = self._id_of(self.hash_of[before] * self.power_of[after] + self.hash_of[after])
            left, right = self.rank_of[before], self.rank_of[after]
            good = (merged < 0) | (self.rank_of[merged] >= limit)
            single = (left < 0) & (right < 0)
            told[at[good & single]] = True
            going = np.flatnonzero(good & ~single)
            at, before, after, limit, left, right = (x[going] for x in (at, before, after, limit, left, right))
            first = left > right
            before, limit = before.copy(), np.where(first, left, right + 1)
            before[first] = self._halves_of(before[first], 1)
            after[~first] = self._halves_of(after[~first], 0)
            left_over = np.flatnonzero((before >= 0) & (after >= 0))
            at, before, after, limit = (x[left_over] for x in (at, before, after, limit))
        return told

    def may_follow(self, piece: str | None, after: str) -> bool:
        if piece is None or not self.bpe:
            return True
        if (known := self.pairs.get((piece, after))) is None:
            if len(self.pairs) >= MOST_CACHED:
                self.pairs.clear()
            known = self.pairs[self._own(piece), self._own(after)] = self.fits(piece, after)
        return known

    def _own(self, arc: str) -> str:
        """A piece as the model holds it, so that what is remembered has no copies of it."""
        return self.piece[self.ids[arc]] if arc in self.ids else arc

    def weight(self, piece: str) -> float:
        return 0.0 if self.bpe else self.score.get(piece, self.unknown)

    def walk(self, text: str, start: int, stop: int, piece: str | None) -> tuple[list, list, list]:
        """Best paths from `start`, where `piece` ended: for each position up to `stop` its score, last piece, step."""
        n = stop - start
        best, last, ids, longest = [NONE] * (n + 1), [None] * (n + 1), self.ids, self.longest
        best[0], last[0] = 0.0, piece
        for end in range(1, n + 1):
            for before in range(end - longest if end > longest else 0, end):
                arc = text[start + before : start + end]
                if (arc in ids or before == end - 1) and best[before] > NONE and self.may_follow(last[before], arc):
                    if self.bpe:
                        best[end], last[end] = 0.0, arc
                        break
                    if (score := best[before] + self.weight(arc)) > best[end]:
                        best[end], last[end] = score, arc
        return best, last, [len(p) if p else 0 for p in last]

    def path(self, text: str, start: int, stop: int, piece: str | None) -> list[str]:
        """The arcs of the best path from `start` to `stop`."""
        _, last, _ = self.walk(text, start, stop, piece)
        arcs, at = [], stop - start
        while at > 0:
            arcs.append(last[at])
            at -= len(last[at])
        return arcs[::-1]

    def numbers(self, arcs: list[str]) -> list[int]:
        found = []
        for arc in arcs:
            if arc in self.ids:
                found.append(self.ids[arc])
            else:
                found += (self.bytes[b] for b in arc.encode("utf-8", "replace"))
        return found

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_CACHED:
            self.clear()
        ids = array("i", self.numbers(self.path(word, 0, len(word), None))).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    @staticmethod
    def _hash(piece: str) -> int:
        total = 0
        for c in piece:
            total = (total * _BASE + ord(c) + 1) % (1 << 64)
        return total

    def _together(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """may_follow for arrays of ids; -1 is the start of a text, -2 a character without a piece."""
        allowed = np.ones(before.shape, bool)
        some = np.flatnonzero((before >= 0) & (after >= 0))
        key = before[some] << 32 | after[some]
        slot = ((key.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        fits, missing = self.pair_fits[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(missing):
            new, which = np.unique(key[missing], return_inverse=True)
            told = self.fits_all(new >> 32, new & 0xFFFFFFFF)
            fits[missing] = told[which]
            self.pair_key[slot[missing]], self.pair_fits[slot[missing]] = key[missing], fits[missing]
        allowed[some] = fits
        return allowed

    def _only_paths(self, arcs: np.ndarray, last: np.ndarray, step: np.ndarray, reach: np.ndarray) -> None:
        """In a BPE lattice one path reaches a position: the first arc that fits is its last one."""
        n = len(arcs)
        for end in range(1, n + 1):
            least = max(0, end - self.longest)
            held = arcs[least:end, end, : reach[end]]
            starts, rows = np.nonzero(held != -1)
            ids = held[starts, rows].astype(np.int64)
            starts += least
            fits = np.flatnonzero(self._together(last[starts, rows].astype(np.int64), ids))[::-1]  # of one word, the first is written last
            rows, starts = rows[fits], starts[fits]
            last[end, rows], step[end, rows] = ids[fits], end - starts

    def _best_paths(self, arcs: np.ndarray, last: np.ndarray, step: np.ndarray) -> None:
        """In a unigram lattice the best score decides; of equal ones the longer arc, as in `walk`."""
        n, _, m = arcs.shape
        best = np.full((n + 1, m), NONE)
        best[0] = 0
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                ids = arcs[start, end]
                score = best[start] + np.where(ids >= 0, self.weights[ids], self.unknown)
                better = (ids != -1) & (score > best[end])
                best[end][better], last[end][better], step[end][better] = score[better], ids[better], end - start

    def _solved(self, words: list[str]) -> list[bytes]:
        """The ids of words, the longest first: the same best paths as `walk`, all words a step at a time."""
        sizes = np.array([len(w) for w in words])
        m, n, base = len(words), len(words[0]), np.uint64(_BASE)
        reach = np.searchsorted(-sizes, -np.arange(n + 1), "right")  # how many words are that long
        chars = np.ascontiguousarray(np.array(words, f"U{n}").view(np.uint32).reshape(-1, n).T).astype(np.uint64) + np.uint64(1)
        arcs = np.full((n, n + 1, m), -1, np.int32)  # by start and end
        for start in range(n):
            total = np.zeros(m, np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                total = total[: reach[end]] * base + chars[end - 1, : reach[end]]
                arcs[start, end, : reach[end]] = self._id_of(total)
            one = arcs[start, start + 1, : reach[start + 1]]
            one[one < 0] = -2
        last, step = np.full((n + 1, m), -1, np.int32), np.zeros((n + 1, m), np.int16)
        if self.bpe:
            self._only_paths(arcs, last, step, reach)
        else:
            self._best_paths(arcs, last, step)
        out, at, count = np.zeros((m, n), np.int32), sizes.copy(), np.zeros(m, np.int64)
        strange = np.zeros(m, bool)
        while (going := np.flatnonzero(at > 0)).size:
            ids = last[at[going], going]
            strange[going] |= ids < 0
            count[going] += 1
            out[going, n - count[going]] = ids
            at[going] -= step[at[going], going]
        return [
            np.array(self.numbers(self.path(w, 0, len(w), None)), np.int32).tobytes() if odd else row[n - c :].tobytes()
            for w, row, c, odd in zip(words, out, count.tolist(), strange.tolist(), strict=True)
        ]

    def learn(self, texts: list[str]) -> None:
        """Solve the words of normalised texts that are not known yet, those of much the same length together."""
        self._looked_up(texts)

    def _looked_up(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of the words of each text. A word is held once; until it is solved, texts are numbers of words."""
        numbers = Numbers()
        parts = [array("i", map(numbers.__getitem__, self.word.findall(t))) for t in texts]
        words = list(numbers)
        known = list(map(self.get, words))
        missing = [k for k, ids in enumerate(known) if ids is None]
        new = [words[k] for k in missing]
        if len(self) + len(new) > MOST_CACHED:  # words at hand are kept, the common ones among them
            kept = {w: ids for w, ids in zip(words, known, strict=True) if ids is not None}
            self.clear()
            self.update(kept)
        short, at = sorted((w for w in new if len(w) <= LONGEST_WORD), key=len, reverse=True), 0
        while at < len(short):
            n = len(short[at])
            part = short[at : at + max(1, AT_ONCE // (n * (n + 1)))]
            self.update(zip(part, self._solved(part), strict=True))
            at += len(part)
        for k in missing:
            known[k] = self[words[k]]
        return [b"".join(map(known.__getitem__, part)) for part in parts]

    def rest(self) -> None:
        """Forget words and pairs at the end of a task, if they are many."""
        if len(self) > MOST_KEPT:
            self.clear()
        if len(self.pairs) > MOST_KEPT:
            self.pairs.clear()
        pa.default_memory_pool().release_unused()

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        found = self.words_all(normal(t) if t else "" for t in texts)
        return (None if text is None else ids for text, ids in zip(texts, found, strict=True))

    def words_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of normalised texts that begin and end with whole words."""
        return [np.frombuffer(ids, np.int32) for ids in self._looked_up(texts)]

    def words(self, text: str) -> np.ndarray:
        return self.words_all([text])[0]

    def encode(self, text: str) -> np.ndarray:
        return self.words(normal(text)) if text else np.zeros(0, np.int32)

    def decode(self, ids) -> str:
        return self.decode_all(np.array(ids, np.int64), [len(ids)])[0]

    def decode_all(self, ids: np.ndarray, sizes: list[int]) -> list[str]:
        """The texts of ids laid end to end, `sizes` of each text."""
        long = self.sizes[ids]
        ends = np.cumsum(long)
        # where each byte lies in the table: its piece's place, and how far it is into the piece
        raw = self.table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - ends + long, long)].tobytes()
        stops = np.concatenate(([0], ends))[np.cumsum([0, *sizes])].tolist()
        return [raw[a:b].decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ") for a, b in zip(stops, stops[1:], strict=False)]

    # Chunks: `text` holds the characters [offset, offset + len(text)) of the document around a chunk.

    def states(self, text: str, cut: int, end: int) -> list[tuple[int, str]]:
        """Arcs over the character before `cut`, as (start, piece); none reaches beyond `end`."""
        found = []
        for start in range(max(0, cut - self.longest), cut):
            for stop in range(cut, min(end, start + self.longest) + 1):
                arc = text[start:stop]
                if stop - start == 1 or arc in self.ids:
                    found.append((start, arc))
        return found

    def _ends(self, text: str, cut: int, stop: int, states_out: list, begin: int, piece: str | None):
        """Scores from a path that has reached `begin` by `piece` to each state at `stop`, and that path's walk."""
        best, last, _ = self.walk(text, begin, stop, piece)
        scores = [
            best[s - begin] + self.weight(arc) if s >= begin and best[s - begin] > NONE and self.may_follow(last[s - begin], arc) else NONE
            for s, arc in states_out
        ]
        return scores, last

    def transfer(self, text: str, cut: int, stop: int, first: bool, final: bool) -> np.ndarray:
        """Best scores from each state at `cut` to each at `stop`; what all paths share is left out."""
        into = [(cut, None)] if first else self.states(text, cut, len(text))
        out = [(s, a) for s, a in self.states(text, stop, len(text)) if not final or s + len(a) == stop]
        heads = self._outer_breaks(text, cut, stop) if self.bpe else self._breaks(text, cut, stop)
        matrix = np.full((len(into), len(out)), NONE)
        tail = None
        for k, (start, arc) in enumerate(into):
            begin = start + len(arc or "")
            for j, state in enumerate(out):
                if state == (start, arc):
                    matrix[k, j] = 0.0
            later = next((h for h in heads if h >= begin), None)
            if begin > stop:
                continue
            if later is None or later == heads[-1] and later <= begin:
                scores, _ = self._ends(text, cut, stop, out, begin, arc)
            else:
                reach = self.walk(text, begin, later, arc)[0][-1]
                if tail is None:
                    tail = np.array(self._ends(text, cut, stop, out, heads[-1], None)[0])
                shift = 0.0 if self.bpe else sum(self._cost(text, a, b) for a, b in zip(heads, heads[1:], strict=False) if a >= later)
                scores = reach + shift + tail
            matrix[k] = np.maximum(matrix[k], scores)
        return matrix

    def _cost(self, text: str, start: int, stop: int) -> float:
        return self.walk(text, start, stop, None)[0][-1]

    def _breaks(self, text: str, cut: int, stop: int) -> list[int]:
        """Positions strictly inside the chunk where a word begins: all paths pass them."""
        return [m.start() for m in _BREAK.finditer(text, cut + self.longest, stop)]

    def _outer_breaks(self, text: str, cut: int, stop: int) -> list[int]:
        """The first and the last one of them."""
        found = _BREAK.search(text, cut + self.longest, stop)
        if not found:
            return []
        first, last = found.start(), text.rindex(SPACE, 0, stop)
        while text[last - 1] == SPACE:
            last -= 1
        return [first, last] if last > first else [first]

    def traced(self, text: str, cut: int, stop: int, first: bool, final: bool, state_in: int, state_out: int) -> np.ndarray:
        """The ids of the arcs that begin in the chunk, given the states at its ends."""
        return self.traced_all([(text, cut, stop, first, final, state_in, state_out)])[0]

    def traced_all(self, rows: list[tuple]) -> list[np.ndarray]:
        """traced for many chunks, the whole words of all of them together."""
        ends = [self._traced_ends(*row) for row in rows]
        return [
            np.concatenate([np.array(head, np.int32), inner, np.array(tail, np.int32)])
            for (head, _, tail), inner in zip(ends, self.words_all([words for _, words, _ in ends]), strict=True)
        ]

    def _traced_ends(self, text: str, cut: int, stop: int, first: bool, final: bool, state_in: int, state_out: int) -> tuple[list[int], str, list[int]]:
        """The ids before the first word that begins in the chunk, the words up to the last one, the ids from there."""
        start, arc = (cut, None) if first else self.states(text, cut, len(text))[state_in]
        out = [(s, a) for s, a in self.states(text, stop, len(text)) if not final or s + len(a) == stop][state_out]
        if out == (start, arc):
            return [], "", []
        begin = start + len(arc or "")
        heads = self._outer_breaks(text, cut, out[0] + 1)  # no state at `cut` reaches beyond the first
        if not heads:
            return self.numbers([*self.path(text, begin, out[0], arc), out[1]]), "", []
        tail = self.numbers([*self.path(text, heads[-1], out[0], None), out[1]])
        return self.numbers(self.path(text, begin, heads[0], arc)), text[heads[0] : heads[-1]], tail


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


@lru_cache(maxsize=2)
def _lattice(digest: str, proto) -> Lattice:
    return Lattice(proto.value)


class Model:
    """The model file, read once by the driver (its size is the vocabulary's) and sent to every executor."""

    def __init__(self, spark: SparkSession, path: str = MODEL):
        with open(path, "rb") as file:
            content = file.read()
        self.digest, self.proto = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def lattice(self) -> Lattice:
        return _lattice(self.digest, self.proto)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def _packed(matrix: np.ndarray) -> bytes:
    return np.array(matrix.shape, np.int32).tobytes() + matrix.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64, offset=8).reshape(np.frombuffer(data, np.int32, 2))


def back(matrices: list[np.ndarray], first: int, last: int | None) -> list[tuple[int, int]]:
    """States at the ends of each matrix on the best path from state `first` (to `last`, or the best end)."""
    forward = [matrices[0][first]]
    for m in matrices[1:]:
        forward.append((forward[-1][:, None] + m).max(axis=0))
    at, found = int(forward[-1].argmax()) if last is None else last, []
    for k in range(len(matrices) - 1, 0, -1):
        before = int((forward[k - 1] + matrices[k][:, at]).argmax())
        found.append((before, at))
        at = before
    return [*((first, at),), *found[::-1]]


def _in_order(group: pa.Table, by: str) -> list[np.ndarray]:
    """The matrices of a group's rows, ordered by a number."""
    data = group["matrix"].to_pylist()
    return [_unpacked(data[k]) for k in np.argsort(group[by].to_numpy())]


def _with_states(group: pa.Table, by: str, states: list[tuple[int, int]]) -> pa.Table:
    """The digest, the number and the states of rows ordered by that number."""
    into, out = (pa.array(x, pa.int32()) for x in zip(*states, strict=True))
    return pa.table([group["digest"], pa.array(np.sort(group[by].to_numpy())), into, out], ["digest", by, "into", "out"])


_CHUNK = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("cut", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
        T.StructField("final", T.BooleanType()),
    ]
)


def chunks(texts: DataFrame, model: Model, chunk_chars: int) -> DataFrame:
    """Rows of a frame (digest, text) as overlapping chunks of the normalised text."""

    def run(batches):
        longest = model.lattice().longest
        for batch in batches:
            for digest, text in zip(batch.column("digest"), batch.column("text"), strict=True):
                whole, rows = normal(text.as_py()), []
                for number, cut in enumerate(range(0, len(whole), chunk_chars)):
                    stop, offset = min(len(whole), cut + chunk_chars), max(0, cut - longest)
                    body = whole[offset : min(len(whole), stop + longest)]
                    rows.append((digest.as_py(), number, body, cut - offset, stop - offset, stop == len(whole)))
                    if len(rows) == 64 or rows[-1][-1]:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _CHUNK_ARROW, strict=True)], schema=_CHUNK_ARROW)
                        rows = []

    return texts.mapInArrow(run, _CHUNK)


_CHUNK_ARROW = pa.schema(
    [("digest", pa.binary()), ("chunk", pa.int32()), ("body", pa.string()), ("cut", pa.int32()), ("stop", pa.int32()), ("final", pa.bool_())]
)


def scanned(texts: DataFrame, model: Model, chunk_chars: int) -> DataFrame:
    """digest, chunk and ids of each chunk of the distinct texts."""
    # One shuffle spreads the chunks and makes equal texts one.
    pieces = chunks(texts, model, chunk_chars).groupBy("digest", "chunk").agg(
        *(F.first(c).alias(c) for c in ("body", "cut", "stop", "final"))
    )

    def matrices(batches):
        lattice = model.lattice()
        for batch in sliced(batches, TOGETHER):
            rows = batch.to_pylist()
            made = [_packed(lattice.transfer(r["body"], r["cut"], r["stop"], r["chunk"] == 0, r["final"])) for r in rows]
            done = pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "matrix"])
            del batch, rows, made
            yield done
            del done
        lattice.rest()

    schema = T.StructType([*_CHUNK.fields, T.StructField("matrix", T.BinaryType())])
    whole = written(pieces.select(*_CHUNK.names).mapInArrow(matrices, schema), "chunks")
    small = whole.select("digest", "chunk", (F.col("chunk") / FAN).cast("int").alias("block"), "matrix")

    def combined(group: pa.Table) -> pa.Table:
        matrices = _in_order(group, "chunk")
        total = matrices[0]
        for matrix in matrices[1:]:
            total = product(total, matrix)
        first = group.slice(0, 1)
        return pa.table([first["digest"], first["block"], pa.array([_packed(total)], pa.binary())], ["digest", "block", "matrix"])

    blocks = small.groupBy("digest", "block").applyInArrow(combined, "digest binary, block int, matrix binary")

    def of_blocks(group: pa.Table) -> pa.Table:
        return _with_states(group, "block", back(_in_order(group, "block"), 0, None))

    ends = blocks.groupBy("digest").applyInArrow(of_blocks, "digest binary, block int, into int, out int")

    def of_chunks(group: pa.Table) -> pa.Table:
        states = back(_in_order(group, "chunk"), group["into"][0].as_py(), group["out"][0].as_py())
        return _with_states(group, "chunk", states)

    chosen = small.join(ends, ["digest", "block"]).groupBy("digest", "block").applyInArrow(of_chunks, "digest binary, chunk int, into int, out int")

    def trace(batches):
        lattice = model.lattice()
        for batch in sliced(batches, TOGETHER):
            rows = batch.to_pylist()
            ids = lattice.traced_all([(r["body"], r["cut"], r["stop"], r["chunk"] == 0, r["final"], r["into"], r["out"]) for r in rows])
            done = pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("chunk"), _lists(ids)], ["digest", "chunk", "ids"])
            del batch, rows, ids
            yield done
            del done
        lattice.rest()

    return whole.drop("matrix").join(chosen, ["digest", "chunk"]).mapInArrow(trace, "digest binary, chunk int, ids array<int>")


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([0 if r is None else len(r) for r in rows], out=offsets[1:])
    values = np.concatenate([np.zeros(0, np.int32), *(r for r in rows if r is not None)])
    mask = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=mask)


def encode(docs: DataFrame, model: str = MODEL, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """`docs` with `ids`, the encoding of its text."""
    ship(docs.sparkSession)
    sent = Model(docs.sparkSession, model)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "ids"))
    names, long = docs.columns, F.length("text") > chunk_chars - 1  # the leading space counts

    def run(batches):
        lattice = sent.lattice()
        for batch in sliced(batches, TOGETHER):
            ids = list(lattice.encode_all(batch.column("text").to_pylist()))
            done = pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], [*names, "ids"])
            del batch, ids  # else the batch is held while the next one is read
            yield done
            del done
        lattice.rest()

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    short = docs.filter(F.coalesce(~long, F.lit(True))).mapInArrow(run, schema)
    key = fresh(names, "digest")
    others = docs.filter(long).withColumn(key, F.unhex(F.sha2("text", 256)))
    parts = scanned(others.select(F.col(key).alias("digest"), "text"), sent, chunk_chars)
    joined = parts.groupBy("digest").agg(F.flatten(F.array_sort(F.collect_list(F.struct("chunk", "ids")))["ids"]).alias("ids"))
    whole = others.join(joined.withColumnRenamed("digest", key), key).select(*names, "ids")
    return short.unionAll(whole)


def decode(encoded: DataFrame, ids: str = "ids", added: str = "decoded", model: str = MODEL) -> DataFrame:
    """`encoded` with the text of its ids (null for null)."""
    ship(encoded.sparkSession)
    sent = Model(encoded.sparkSession, model)
    encoded = encoded.select(*(F.col(f"`{c}`") for c in encoded.columns if c.lower() != added.lower()))

    def run(batches):
        lattice = sent.lattice()
        for batch in sliced(batches, TOGETHER):
            column = batch.column(ids)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
            texts = lattice.decode_all(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            done = pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))], [*batch.schema.names, added])
            del batch, column, texts
            yield done
            del done

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(added, T.StringType())]))
