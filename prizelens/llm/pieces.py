"""SentencePiece encoding with seeded merge-dropout, and decoding.

The agenda of candidate merges is worked off by score as the library does, but a candidate
is skipped when a keyed hash of the seed, the document, the place of the text unit in it,
the place of the candidate and the merged length falls below the dropout rate. So the same
seed gives the same pieces on any machine, every occurrence of a unit draws afresh, and all
decode to the same text.

Texts are cut into units where no piece of the vocabulary reaches across (before spaces
that follow something else, around line feeds, between letters and marks; the loader looks
these up in the vocabulary).
A worker remembers forms of units that come again by the candidates that they skip: an
occurrence starts at the form that skips none, hashes the merges that led to it, and goes on
to the form that also skips the first of them that it must; ids are gathered from the forms
by place. Beyond ``DEPTH`` skips, or where it is met for the first time, a unit is segmented
by itself.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from prizelens.llm.common import worker_memo

DEPTH = 2  # skips that remembered forms have at most
AT_ONCE = 100_000  # occurrences worked on together, which bounds a task's memory
MEMO_UNITS = 200_000  # a full memo is emptied and fills again; results do not depend on it
TEXTS = 500  # encoded together
TOGETHER, SHORT = 4_096, 64  # units segmented side by side, and their length at most
SPACE = "▁"  # how the vocabulary writes a space
MASK = (1 << 64) - 1
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?#$%&*|"


LENGTHS = 2 * SHORT  # a candidate's code is its place times this, plus its length
NONE = np.int32(2**31 - 1)  # the rank of a pair that makes no piece


def spread(codes: np.ndarray) -> np.ndarray:
    """What a candidate adds to a key before it is hashed, as in ``Pieces.segment``."""
    place = (codes // LENGTHS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return place + (codes % LENGTHS).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def skipped(h: np.ndarray, below: int) -> np.ndarray:
    """Which candidates are skipped, of keys plus ``spread``."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)) < below


def gathered(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ``values[first : first + count]``, one after the other."""
    return values[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]


class Pieces:
    """A BPE model with byte fallback; spaces are kept as spaces inside."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        byte_ids: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(SPACE, " ")
                self.ids[text] = i
                self.scores[text] = model.get_score(i)
                self.bytes_of.append(text.encode())
        if len(byte_ids) < 256:
            raise ValueError("the model has no byte fallback, so it cannot decode every text")
        if any(" " in t.lstrip(" ") for t in self.ids):
            raise ValueError("a piece reaches across a space")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.pair_tables()
        self.piece_bytes: pa.Array | None = None
        self.unit = self.unit_pattern()
        self.forget()

    @classmethod
    def of_worker(cls, path: str) -> Pieces:
        memo = worker_memo("pieces")
        if path not in memo:
            memo[path] = cls(path)
        return memo[path]

    def forget(self) -> None:
        """Empty the memo. Form 0 stands for units that are not remembered."""
        self.root: dict[str, int] = {}  # 0: met once
        self.unit_of = [""]
        self.skips = np.full((1, DEPTH), -1, np.int64)
        # Ids and merges of all forms, one after the other, and how many each form has.
        self.out, self.n_out = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.merges, self.count = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.first = self.first_out = np.zeros(1, np.int64)
        # What each merge adds to a key, and the form that also skips it (0: not known).
        self.spread, self.child = spread(self.merges), np.zeros(0, np.int64)

    def segment(self, unit: str, key: int, below: int) -> list[int]:
        """Ids of one unit; candidates whose hash with ``key`` is under ``below`` are skipped."""
        scores, symbols, n = self.scores, list(unit), len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            score = scores.get(unit[i : i + 2])
            if score is not None:
                agenda.append((-score, i, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            left = symbols[i]
            j = after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != size:
                continue
            if below:
                h = (key + i * 0x9E3779B97F4A7C15 + size * 0xC2B2AE3D27D4EB4F) & MASK
                h = ((h ^ (h >> 31)) * 0xD6E8FEB86659FD93) & MASK
                if (h ^ (h >> 32)) & 0xFFFFFFFF < below:
                    continue
            symbols[i] = left = left + symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                score = scores.get(left + symbols[k])
                if score is not None:
                    heapq.heappush(agenda, (-score, i, size + len(symbols[k])))
            b = before[i]
            if b >= 0:
                score = scores.get(symbols[b] + left)
                if score is not None:
                    heapq.heappush(agenda, (-score, b, size + len(symbols[b])))
        return self.numbers([s for s in symbols if s])

    def numbers(self, symbols: list[str]) -> list[int]:
        """Ids of symbols; of their bytes where they are no piece."""
        out = list(map(self.ids.get, symbols))
        if None not in out:
            return out
        return [i for s, n in zip(symbols, out) for i in ([self.byte_ids[b] for b in s.encode()] if n is None else [n])]

    def unit_pattern(self) -> re.Pattern:
        """Cuts before spaces, around line feeds and between a letter and a mark, each
        only as far as no piece of the vocabulary reaches across."""
        after_letter = {c for t in self.ids for c in re.findall(f"(?<=[{LETTERS}]).", t, re.S)}
        marks = "".join(re.escape(c) for c in MARKS if c not in after_letter)
        words = f" *[{LETTERS}]+(?=[{marks}])|" if marks else ""
        if any("\n" in t and len(t) > 1 for t in self.ids):
            return re.compile(words + r" +[^ ]*|[^ ]+")
        return re.compile(words + r" +[^ \n]*|[^ \n]+|\n")

    def pair_tables(self) -> None:
        """Symbols by number (pieces, then characters that are none), the ids that stand for
        them, and what pairs of them make."""
        n = len(self.bytes_of)
        self.number_of = np.full(0x110000, -1, np.int32)  # by code point; -1: not met yet
        for t, i in self.ids.items():
            if len(t) == 1:
                self.number_of[ord(t)] = i
        self.run, self.n_run = np.arange(n, dtype=np.int32), np.ones(n, np.int64)
        self.first_run = np.arange(n)
        self.numbered(np.array(sorted({ord(c) for t in self.ids for c in t}), np.int64))
        number = lambda t: self.ids.get(t, int(self.number_of[ord(t)]) if len(t) == 1 else None)
        # Ties in score are ties in rank; the rank of no piece stands last.
        costs, ranks = np.unique([-self.scores.get(t, 0) for t in self.ids], return_inverse=True)
        self.rank = np.full(n + 1, NONE, np.int32)
        self.rank[list(self.ids.values())] = ranks
        made = {
            (left << 32) | right: i
            for t, i in self.ids.items() for k in range(1, len(t))
            if (left := number(t[:k])) is not None and (right := number(t[k:])) is not None
        }
        keys, values = np.array(list(made), np.int64), np.array(list(made.values()), np.int32)
        # Hash tables: what finds its slot taken goes on to the next.
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        bits = max(4, len(keys).bit_length() + 2)
        while len(keys):
            times = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables) * 0xD6E8FEB86659FD93 & MASK)
            shift = np.uint64(64 - bits)
            slot, first = np.unique((keys.view(np.uint64) * times) >> shift, return_index=True)
            table, value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            table[slot], value[slot] = keys[first], values[first]
            self.tables.append((times, shift, table, value))
            keys, values, bits = np.delete(keys, first), np.delete(values, first), max(4, bits - 2)

    def numbered(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; characters that are no piece get theirs when first met."""
        found = self.number_of[points]
        if found.size and found.min() < 0:
            new = np.unique(points[found < 0])
            ids = [[self.byte_ids[b] for b in chr(c).encode()] for c in new.tolist()]
            self.number_of[new] = len(self.n_run) + np.arange(len(new))
            self.run = np.concatenate([self.run, np.array(list(chain.from_iterable(ids)), np.int32)])
            self.n_run = np.concatenate([self.n_run, np.array(list(map(len, ids)), np.int64)])
            self.first_run = np.cumsum(self.n_run) - self.n_run
            found = self.number_of[points]
        return found

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols make; -1 where there is none."""
        key = (left.astype(np.int64) << 32) | right
        key[(left < 0) | (right < 0)] = -2
        out = np.full(len(key), -1, np.int32)
        rest, wanted = slice(None), key
        for times, shift, table, value in self.tables:
            slot = (wanted.view(np.uint64) * times) >> shift
            there = table[slot]
            same = there == wanted
            out[rest] = np.where(same, value[slot], -1)
            go = np.flatnonzero(~same & (there >= 0))
            if not len(go):
                break
            rest = go if isinstance(rest, slice) else rest[go]
            wanted = wanted[go]
        return out

    def segment_many(
        self, units: list[str], keys: np.ndarray | None, below: int, skips: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``segment`` of many short units side by side: one agenda per row.

        With ``skips`` (codes of candidates per row) these are skipped instead. Ids and their
        number per row; codes of the merges made and their number per row.
        """
        n, size = len(units), np.fromiter(map(len, units), np.int64, len(units))
        width = int(size.max()) + 1  # the last place stays empty
        points = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        sym = np.full((n, width), -1, np.int32)
        sym[np.arange(width) < size[:, None]] = self.numbered(points)
        sym = sym.ravel()
        made = np.append(self.pairs(sym[:-1], sym[1:]), np.int32(-1))
        cost, rows, trail = self.rank[made].reshape(n, width), np.arange(n), []
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width)
        while len(rows):
            i = cost.argmin(1)
            go = cost[np.arange(len(rows)), i] < NONE
            if not go.all():  # rows without candidates are done
                rows, cost, i = rows[go], cost[go], i[go]
                if not len(rows):
                    break
            place = rows * width + i
            code = i * LENGTHS + after[after[place]] - place
            if skips is not None:
                skip = (skips[rows] == code[:, None]).any(1)
            else:
                skip = skipped(keys[rows] + spread(code), below) if below else np.zeros(len(rows), bool)
            flat = cost.ravel()
            own = np.arange(len(rows)) * width
            if skip.any():
                flat[own[skip] + i[skip]] = NONE
                keep = ~skip
                own, i, place, code = own[keep], i[keep], place[keep], code[keep]
                trail.append((rows[keep], code))
            else:
                trail.append((rows, code))
            new, gone = made[place], after[place]
            end, shift = after[gone], own - (place - i)  # from a place to its cost
            sym[place], sym[gone] = new, -1
            after[place], before[end] = end, place
            flat[gone + shift] = NONE
            made[place] = right = self.pairs(new, sym[end])
            flat[place + shift] = self.rank[right]
            inner = np.flatnonzero(i > 0)
            at = before[place[inner]]
            made[at] = left = self.pairs(sym[at], new[inner])
            flat[at + shift[inner]] = self.rank[left]
        alive = np.flatnonzero(sym >= 0)
        found = sym[alive]
        n_ids = self.n_run[found]
        ids = gathered(self.run, self.first_run[found], n_ids)
        counts = np.bincount(alive // width, n_ids, n).astype(np.int64)
        made_by = np.concatenate([t[0] for t in trail] or [np.zeros(0, np.int64)])
        codes = np.concatenate([t[1] for t in trail] or [np.zeros(0, np.int64)])
        return ids, counts, codes[np.argsort(made_by, kind="stable")], np.bincount(made_by, minlength=n)

    def learn(self, units: list[str], skips: np.ndarray) -> np.ndarray:
        """Remember the forms of short units with their skips, those of like length together;
        their numbers."""
        order = np.argsort(np.fromiter(map(len, units), np.int64, len(units)), kind="stable")
        numbers = np.empty(len(units), np.int64)
        numbers[order] = np.arange(len(self.unit_of), len(self.unit_of) + len(units))
        units, skips = [units[k] for k in order.tolist()], skips[order]
        parts = [(self.out, self.n_out, self.merges, self.count)]
        for at in range(0, len(units), TOGETHER):
            parts.append(self.segment_many(units[at : at + TOGETHER], None, 0, skips[at : at + TOGETHER]))
        self.unit_of += units
        self.skips = np.concatenate([self.skips, skips])
        self.out, self.n_out, self.merges, self.count = map(np.concatenate, zip(*parts))
        new = self.merges[len(self.spread) :]
        self.spread = np.concatenate([self.spread, spread(new)])
        self.child = np.concatenate([self.child, np.zeros(len(new), np.int64)])
        self.first_out, self.first = np.cumsum(self.n_out) - self.n_out, np.cumsum(self.count) - self.count
        return numbers

    def alone(self, units: list[str], keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that are not remembered: ids and their numbers."""
        order = np.argsort(np.fromiter(map(len, units), np.int64, len(units)), kind="stable")
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(order), TOGETHER):
            part = order[at : at + TOGETHER]
            some = [units[k] for k in part.tolist()]
            if len(some[-1]) <= SHORT:
                found, count, *_ = self.segment_many(some, keys[part], below)
            else:
                lists = [self.segment(u, k, below) for u, k in zip(some, keys[part].tolist())]
                count = np.fromiter(map(len, lists), np.int64, len(lists))
                found = np.fromiter(chain.from_iterable(lists), np.int32, count.sum())
            ids.append(found)
            counts.append(count)
        values, count = np.concatenate(ids), np.concatenate(counts)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return gathered(values, (np.cumsum(count) - count)[back], count[back]), count[back]

    def occurrences(self, units: list[str], keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, each with its own key, one after the other, and their numbers."""
        if max(len(self.unit_of), len(self.root) // 2) >= MEMO_UNITS:
            self.forget()
        form = np.fromiter(map(self.root.get, units, repeat(0)), np.int64, len(units))
        unknown = np.flatnonzero(form == 0)
        asked = [units[k] for k in unknown.tolist()]
        # A unit is remembered when it comes again; many never do.
        times = Counter(u for u in asked if len(u) <= SHORT)
        new = [u for u, n in times.items() if n > 1 or u in self.root]
        self.root.update(zip(times, repeat(0)))
        self.root.update(zip(new, self.learn(new, np.full((len(new), DEPTH), -1, np.int64)).tolist()))
        form[unknown] = np.fromiter(map(self.root.get, asked, repeat(0)), np.int64, len(asked))
        alone, left = np.flatnonzero(form == 0), np.arange(len(units))
        for depth in range(DEPTH + 1 if below else 0):
            own = form[left]
            count = self.count[own]
            who = np.repeat(np.arange(len(left)), count)
            merge = np.arange(len(who)) + (self.first[own] - (np.cumsum(count) - count))[who]
            hit = np.flatnonzero(skipped(keys[left][who] + self.spread[merge], below))
            who = who[hit]
            first = np.diff(who, prepend=-1) > 0  # of each
            left, merge = left[who[first]], merge[hit[first]]
            if depth == DEPTH:
                alone = np.concatenate([alone, left])
                break
            missing = self.child[merge] == 0
            new, at = np.unique(merge[missing], return_index=True)
            parents = form[left[missing][at]]
            skips = self.skips[parents]
            skips[:, depth] = self.merges[new]
            numbers = self.learn([self.unit_of[k] for k in parents.tolist()], skips)
            self.child[new] = numbers
            form[left] = self.child[merge]
        # What is not remembered is segmented by itself and stands behind the forms.
        found, n_found = self.alone([units[k] for k in alone.tolist()], keys[alone], below)
        values = np.concatenate([self.out, found])
        first, count = self.first_out[form], self.n_out[form]
        first[alone], count[alone] = len(self.out) + np.cumsum(n_found) - n_found, n_found
        return gathered(values, first, count), count

    def draws(self, n: int, doc: int, seed: int) -> np.ndarray:
        """The key of each of a document's units."""
        x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x += np.uint64(xxhash.xxh3_64_intdigest(doc.to_bytes(8, "little", signed=True), seed))
        for _ in range(2):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def encode_many(
        self, texts: list[str], docs: list[int], seed: int, dropout: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and their numbers. ``docs`` key the draws."""
        below = round(dropout * (1 << 32))
        # The model's dummy prefix stands before every text.
        cut = [self.unit.findall(" " + text) if text else [] for text in texts]
        units = list(chain.from_iterable(cut))
        keys = np.concatenate([np.zeros(0, np.uint64), *(self.draws(len(x), d, seed) for x, d in zip(cut, docs))])
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(units), AT_ONCE):
            some, count = self.occurrences(units[at : at + AT_ONCE], keys[at : at + AT_ONCE], below)
            ids.append(some)
            counts.append(count)
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        return np.concatenate(ids), np.diff(upto[ends], prepend=0)

    def encode(self, text: str, doc: int, seed: int, dropout: float) -> bytes:
        return self.encode_many([text], [doc], seed, dropout)[0].astype("<i4").tobytes()

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids. Null: null."""
        if self.piece_bytes is None:
            self.piece_bytes = pa.array(self.bytes_of, pa.large_binary())
        # Bytes of pieces taken one after the other are the texts, one after the other.
        whole = self.piece_bytes.take(ids.flatten())
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        places = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1]
        starts = pa.array(places[np.concatenate([[0], ends])])
        texts = pa.LargeStringArray.from_buffers(len(ids), starts.buffers()[1], whole.buffers()[2])
        texts.validate(full=True)
        texts = pc.if_else(ids.is_valid(), texts, None)
        prefixed = pc.starts_with(texts, " ")
        return pc.if_else(prefixed, pc.utf8_slice_codeunits(texts, 1), texts).cast(pa.string())


def encode_pieces(path: str, seed: int, dropout: float):
    """A column function of text and key: ids of every whole text.

    Null text: null; empty text: no ids; a null key draws as -1.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array, keys: pa.Array) -> pa.Array:
        pieces = Pieces.of_worker(path)
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for first in range(0, len(texts), TEXTS):
            some = [t or "" for t in texts.slice(first, TEXTS).to_pylist()]
            docs = [-1 if k is None else k for k in keys.slice(first, TEXTS).to_pylist()]
            ids, count = pieces.encode_many(some, docs, seed, dropout)
            parts.append(ids)
            counts.append(count)
        offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)), mask=texts.is_null())

    return encode


def decode_pieces(path: str):
    """A column function from ids back to the text. Null: null."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return Pieces.of_worker(path).decode(ids)

    return decode


def encoded(text: Column, key: Column, path: str, seed: int = 1, dropout: float = 0.1) -> Column:
    return encode_pieces(path, seed, dropout)(text, key.cast("long"))


def decoded(ids: Column, path: str) -> Column:
    return decode_pieces(path)(ids)
