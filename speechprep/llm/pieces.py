"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into units (runs of letters, or of other characters, with the spaces before them), which no piece
crosses. For the units of a corpus the lattice is relational: substrings of bounded length are exploded and joined
with the piece table, the edges are grouped by unit, and a higher-order ``aggregate`` folds Viterbi's recursion over
the ends of each. The most frequent units, as many as fit a fixed bound, are encoded so and sent to the tasks; a task
folds the same recursion over the units it meets beyond them, so each has the same pieces whichever way it went.

What is maximised follows the kind of model. In a merge model a piece's score tells how early its merge comes, and
its right segmentation is the one that early merges lead to, the leftmost first among equal ones. A piece therefore
weighs the list of all merges that build it (score and place, as one number), best first; weights add up by putting
lists together in order, and compare from the front. The best sum is what the merges themselves arrive at.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechprep.llm.common import Shared
from speechprep.session import settled

MARK = "▁"
#: How many units are sent to the tasks, and how long they may be.
SENT, SENT_CHARS = 200_000, 48
#: Bytes of further units that a worker remembers, about: ENTRY for each and what it holds.
UNIT_BYTES, ENTRY = 80 << 20, 200
#: Bytes of ids in a batch that leaves a task.
OUT_BYTES = 4 << 20
#: Words that a task counts before it hands the counts of their units on; words of several units that a worker remembers.
COUNTED, JOINED = 400_000, 1 << 16
MOST_PIECES = 1_000_000
#: Units whose lengths differ by less than LIKE are folded together, so many characters at once; the edges of two characters and more of such a unit, and no edge.
LIKE, FOLDED, EDGES, NO_EDGE = 4, 1 << 15, 62, -(1 << 62)
#: Characters of texts, and words of them, that are encoded at once; ids that are decoded at once.
TEXT_CHARS, TEXT_WORDS, DECODED = 1 << 19, 1 << 17, 1 << 16
#: No merge: less than any key. What is no beginning of a piece: no code, no merges, nothing goes on.
NONE, ABSENT = -(1 << 80), (-1, [], None)
#: Places in a word; scores down to -1e9 then still fit 64 bits.
PLACES = 1 << 32


def merge_keys(piece: str, scores: dict[str, tuple[int, int]]) -> list[int]:
    """The merges made inside a piece, best first: the pair with the best score, leftmost, again and again.

    Each is one number, larger for better scores and then for places further left.
    """
    parts, made = list(piece), []
    while len(parts) > 1:
        pairs = [(scores[a + b][1], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
        if not pairs:
            break
        score, k = max(pairs)
        made.append(score * PLACES - sum(map(len, parts[:-k])))
        parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
    return sorted(made, reverse=True)


def unit_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Units of a word (marks instead of spaces): marks with what follows them, runs of letters, runs of the rest.

    A letter that stands beside other characters in a piece counts as one of these, so that no piece crosses units.
    """
    joining = {"_"}
    while True:
        also = re.escape("".join(sorted(joining)))
        letters, rest = rf"[^\W\d{also}]+", rf"(?:[^\w{MARK}\n]|[\d{also}])+"
        units = re.compile(rf"\n|{MARK}+(?:{letters}|{rest})?|{letters}|{rest}")
        crossing = "".join(p for p in pieces if units.findall(p) != [p])
        more = set(re.findall(rf"[^\W\d{also}]", crossing))
        if not more:
            return units
        joining |= more


def unit_test(units: re.Pattern) -> Callable[[str], bool]:
    """Whether a word is one unit. Most are letters after a mark, which needs no pattern where no letter counts as joining."""
    base = unit_pattern(()).pattern
    joins = any(c.isalpha() for c in set(units.pattern) - set(base))
    plain = not joins and units.fullmatch("a" + "".join(c for c in base if c.isalpha())) is not None

    def whole(word: str) -> bool:
        return plain and word[word[:1] == MARK :].isalpha() or units.fullmatch(word) is not None

    return whole


class Pieces:
    """The tables of a model: id and weight of each piece, bytes of each id, ids of single bytes."""

    def __init__(self, model: bytes):
        self.model = model
        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        scores: dict[str, tuple[int, int]] = {}
        self.raw: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(reader.get_piece_size()):
            piece = reader.id_to_piece(i)
            if reader.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif reader.is_control(i) or reader.is_unknown(i):
                self.raw.append(b"")
            else:
                scores[piece] = (i, int(reader.get_score(i)))
                self.raw.append(piece.replace(MARK, " ").encode())
        if len(scores) > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        #: Id and weight; pieces that their own merges do not lead to can stand in no text.
        self.table: dict[str, tuple[int, list[int]]] = {}
        for piece, (i, _) in scores.items():
            weight = merge_keys(piece, scores)
            if len(weight) == len(piece) - 1:
                self.table[piece] = (i, weight)
        for piece in self.table:
            if "\n" in piece or MARK in piece.lstrip(MARK):
                raise ValueError(f"a piece crosses words: {piece!r}")
        #: The bytes of all ids, and where those of each begin and how many they are.
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.sizes = np.array([len(raw) for raw in self.raw], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.longest = max(map(len, self.table))
        self.units = unit_pattern(self.table)
        self.whole = unit_test(self.units)
        #: By first character, pieces and beginnings of pieces: id (-1 for no piece), weight, and the same by the next
        #: character (None where no piece goes on).
        beginnings = {p[:k] for p in self.table for k in range(1, 1 + len(p))}
        following: dict[str, dict] = {}
        for p in sorted(beginnings, key=len, reverse=True):
            step = (*self.table.get(p, (-1, [])), following.pop(p, None))
            following.setdefault(p[:-1], {})[p[-1]] = step
        self.steps: dict[str, tuple] = following.get("", {})
        self.lattice = Lattice(self.table, scores) if self.longest < 64 else None


class Lattice:
    """The pieces as arrays: an automaton that reads many units at once, and how each piece is put together.

    A state is a beginning of pieces. The last merge of a piece joins two parts that have the pieces' merges inside them,
    so the merges of a piece that stands in a unit are edges of the unit's lattice too.
    """

    def __init__(self, table: dict[str, tuple[int, list[int]]], scores: dict[str, tuple[int, int]]):
        alphabet = sorted({c for piece in table for c in piece})
        self.kinds = np.zeros(ord(alphabet[-1]) + 2, np.int64)  # the last for all characters beyond
        self.kinds[[ord(c) for c in alphabet]] = np.arange(1, 1 + len(alphabet))
        self.width = 1 + len(alphabet)
        states = {"": 0}
        for piece in table:
            for k in range(1, 1 + len(piece)):
                states.setdefault(piece[:k], len(states))
        kind = {c: k for k, c in enumerate(alphabet, 1)}
        keys = np.array([states[p[:-1]] * self.width + kind[p[-1]] for p in states if p], np.int64)
        self.shift = 64 - max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.next = np.full(len(self.keys), -1, np.int32)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):  # linear probing: of the keys that want a free slot, one has it
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[left[free]]
            self.next[at[free]] = left[free] + 1
            lost = self.keys[at] != keys[left]
            left, at = left[lost], (at[lost] + 1) & (len(self.keys) - 1)
        #: By state: id (-1 for no piece), length of the first of its two parts, place of its score, best first.
        self.ids, self.first, self.rank = (np.full(len(states), -1, np.int32), *np.zeros((2, len(states)), np.int64))
        ranks = {score: k for k, score in enumerate(sorted({score for _, score in scores.values()}, reverse=True))}
        shared = Counter(score for piece, (_, score) in scores.items() if len(piece) > 1)
        #: Where another merge has the same score, so that score and place do not tell merges apart.
        self.alike = np.zeros(len(states), bool)
        for piece, (i, weight) in table.items():
            self.ids[states[piece]] = i
            if weight:
                score = scores[piece][1]
                self.rank[states[piece]] = ranks[score]
                for k in range(1, len(piece)):
                    parts = table.get(piece[:k], ABSENT)[1] + [key - k for key in table.get(piece[k:], ABSENT)[1]]
                    if len(parts) == len(weight) - 1 and sorted([*parts, score * PLACES], reverse=True) == weight:
                        self.first[states[piece]] = k
                        break
                self.alike[states[piece]] = shared[score] > 1 or not self.first[states[piece]]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def step(self, states: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The states after these characters, -1 where no piece goes on so."""
        keys = states * self.width + kinds
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.next[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.next[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def fold(self, chars: np.ndarray, lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over units, a row of code points each, filled up: codes as ``fold`` has them, one unit after the other;
        how many a unit has; and which units are left out, their codes not being right: those that have too many edges, or
        one like others.

        A sum of merges is a whole number here: a unit's edges of two characters and more are put in order, best first,
        and have a bit each. The weight of an edge is its bit and the weights of its two parts.
        """
        units, n = chars.shape
        longest = min(longest, n)
        kinds = self.kinds[np.minimum(chars, len(self.kinds) - 1)]
        kinds[np.arange(n) >= lengths[:, None]] = 0
        # By length less 1 and start: weight and code of each unit's edge. A single character is always one.
        weights = np.full((longest, n, units), NO_EDGE, np.int64)
        codes = np.empty((longest, n, units), np.int32)
        weights[0] = 0
        unit, start = np.repeat(np.arange(units), n), np.tile(np.arange(n), units)
        state, found = np.zeros(units * n, np.int64), []
        for size in range(1, longest + 1):
            state = self.step(state, kinds[unit, start + size - 1])
            here = state >= 0
            if size == 1:
                ids = np.where(here, self.ids[state], -1)
                codes[0, start, unit] = np.where(ids >= 0, ids, -1 - chars[unit, start].astype(np.int32))
            here &= start + size <= n
            unit, start, state = unit[here], start[here], state[here]
            if size > 1:
                piece = self.ids[state] >= 0
                found.append((unit[piece], start[piece], state[piece]))
                codes[size - 1, start[piece], unit[piece]] = self.ids[state[piece]]
            more = start + size < n
            unit, start, state = unit[more], start[more], state[more]
        out = np.zeros(units, bool)
        if found:
            unit, start, state = map(np.concatenate, zip(*found))
            size = np.repeat(np.arange(2, 2 + len(found)), [len(some) for some, _, _ in found])
            order = np.argsort((unit * (int(self.rank.max()) + 1) + self.rank[state]) * n + start)
            edges = np.bincount(unit, minlength=units)
            out = edges > EDGES
            out[unit[self.alike[state]]] = True
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order)) - np.repeat(np.cumsum(edges) - edges, edges)
            bits = np.int64(1) << np.maximum(EDGES - 1 - place, 0)
            for k in range(2, 2 + len(found)):
                own = np.flatnonzero(size == k)
                u, s, first = unit[own], start[own], self.first[state[own]]
                weights[k - 1, s, u] = bits[own] + weights[first - 1, s, u] + weights[k - first - 1, s + first, u]
        best, last = np.full((n + 1, units), NO_EDGE, np.int64), np.ones((n + 1, units), np.int64)
        best[0] = 0
        for end in range(1, n + 1):
            for size in range(min(longest, end), 0, -1):  # a later start wins among equal sums
                sums = best[end - size] + weights[size - 1, end - size]
                better = sums >= best[end]
                np.copyto(best[end], sums, where=better)
                np.copyto(last[end], size, where=better)
        ends, at, some = np.zeros((units, n + 1), bool), lengths, np.arange(units)
        while len(some):
            ends[some, at] = True
            at = at - last[at, some]
            some, at = some[at > 0], at[at > 0]
        unit, end = np.nonzero(ends)
        size = last[end, unit]
        return codes[size - 1, end - size, unit], ends.sum(axis=1), out



def pack(pieces: Pieces, codes: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers; a code below 0 is a character to be spelt in bytes."""
    if min(codes, default=0) >= 0:
        return struct.pack(f"<{len(codes)}i", *codes)
    ids = []
    for code in codes:
        if code >= 0:
            ids.append(code)
        else:
            ids += [pieces.byte_ids[b] for b in chr(-1 - code).encode("utf-8", "surrogatepass")]
    return np.array(ids, "<i4").tobytes()


def fold(pieces: Pieces, word: str) -> list[int]:
    """Viterbi over one word: the best sum of weights; of equal sums the latest start of the last piece.

    Sums compare from the front, so an edge whose best merge is worse than that of the sum already found is passed by
    before its sum is put together.
    """
    n = len(word)
    sums: list = [[]] + [None] * n
    tops, starts, codes = [NONE] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for start in range(n):
        weight, best = sums[start], tops[start]
        steps = pieces.steps
        for end in range(start + 1, n + 1):
            code, more, steps = steps.get(word[end - 1], ABSENT)
            if code >= 0 or end - start == 1:
                top = more[0] - start if more else NONE
                if best > top:
                    top = best
                if sums[end] is None or top >= tops[end]:
                    if not more:
                        here = weight
                    elif weight:
                        here = sorted(weight + [key - start for key in more], reverse=True)
                    else:
                        here = [key - start for key in more] if start else more
                    # A later start wins among equal sums.
                    if sums[end] is None or here >= sums[end]:
                        sums[end], tops[end], starts[end] = here, top, start
                        codes[end] = code if code >= 0 else -1 - ord(word[start])
            if steps is None:
                break
    out, at = [], n
    while at:
        out.append(codes[at])
        at = starts[at]
    return out[::-1]


def fold_all(pieces: Pieces, units: Iterable[str]) -> dict[str, bytes]:
    """Packed ids of distinct units, as ``fold`` finds them: units of like length are folded together.

    Left to ``fold`` are long units, those with too many edges, and those with pieces of one score.
    """
    out: dict[str, bytes] = {}
    sizes: dict[int, list[str]] = {}
    for unit in units:
        sizes.setdefault(-(-len(unit) // LIKE) * LIKE, []).append(unit)
    for size, like in sizes.items():
        if not 0 < size <= SENT_CHARS or pieces.lattice is None:
            out.update((unit, pack(pieces, fold(pieces, unit))) for unit in like)
            continue
        most = FOLDED // size
        for k in range(0, len(like), most):
            some = like[k : k + most]
            chars = np.array(some, f"<U{size}").view("<u4").reshape(len(some), size)
            lengths = np.array(list(map(len, some)))
            codes, counts, left = pieces.lattice.fold(chars, lengths, pieces.longest)
            ends = np.cumsum(counts)
            spelt = np.zeros(len(some), bool)
            spelt[np.searchsorted(ends, np.flatnonzero(codes < 0), side="right")] = True
            raw, cuts = codes.astype("<i4").tobytes(), [0, *(4 * ends).tolist()]
            out.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
            for at in np.flatnonzero(spelt & ~left).tolist():
                out[some[at]] = pack(pieces, np.frombuffer(out[some[at]], "<i4").tolist())
            for at in np.flatnonzero(left).tolist():
                out[some[at]] = pack(pieces, fold(pieces, some[at]))
    return out


def lattice_encode(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, codes) for distinct words of a column ``word`` (marks instead of spaces): the relational lattice."""
    spark = words.sparkSession
    rows = [(piece, i, weight) for piece, (i, weight) in pieces.table.items()]
    table = F.broadcast(spark.createDataFrame(rows, "piece string, id int, weight array<bigint>"))  # MOST_PIECES at most
    no_weight = F.array().cast("array<bigint>")
    n = F.length("word")
    starts = words.filter(n > 0).select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    reach = F.least(F.lit(pieces.longest), n - F.col("start"))
    parts = starts.select("word", "start", F.explode(F.sequence(F.lit(1), reach)).alias("size"))
    parts = parts.select(
        "word", "start", "size", F.expr("substring(word, start + 1, size)").alias("piece")
    )
    edges = parts.join(table, "piece", "left").filter("id is not null or size = 1").select(
        "word", "start", (F.col("start") + F.col("size")).alias("end"),
        F.coalesce(F.transform("weight", lambda key: key - F.col("start")), no_weight).alias("weight"),
        F.coalesce("id", -1 - F.ascii("piece")).alias("code"),
    )
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct("start", "end", "weight", "code")).alias("edges"))
    best = F.aggregate(
        F.sequence(F.lit(1), F.length("word")),
        F.array(F.struct(no_weight.alias("weight"), F.lit(0).alias("start"), F.lit(0).alias("code"))),
        lambda done, end: F.concat(done, F.array(F.array_max(F.transform(
            F.filter("edges", lambda e: e["end"] == end),
            lambda e: F.struct(
                F.sort_array(F.concat(F.get(done, e["start"])["weight"], e["weight"]), asc=False).alias("weight"),
                e["start"].alias("start"), e["code"].alias("code"),
            ),
        )))),
    )
    folded = grouped.select("word", best.alias("best"))
    back = F.aggregate(
        "best",
        F.struct((F.size("best") - 1).alias("at"), F.array().cast("array<int>").alias("codes")),
        lambda s, _: F.when(s["at"] == 0, s).otherwise(F.struct(
            F.get("best", s["at"])["start"].alias("at"),
            F.concat(F.array(F.get("best", s["at"])["code"]), s["codes"]).alias("codes"),
        )),
    )
    return folded.select("word", back["codes"].alias("codes"))


def split_units(text: str, units: re.Pattern) -> list[str]:
    """The units of a text, spaces as marks; the text starts as if a space stood before it."""
    return units.findall((" " + text).replace(" ", MARK)) if text else []


def split_words(text: str, units: re.Pattern) -> list[str]:
    """A text in order as words and line breaks, whose units are those of the text; as units where marks stand side by side."""
    if not text or text[0] == " " or "  " in text or MARK in text:
        return split_units(text, units)
    return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")


def unit_counts(texts: DataFrame, units: re.Pattern) -> DataFrame:
    """(word, n) for the units of a column ``text``, counted in each task before the shuffle.

    Words are counted first, and each distinct one is cut into its units when counts are handed on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        whole = unit_test(units)

        def out() -> Iterator[pa.RecordBatch]:
            for word in [word for word in seen if not whole(word)]:
                n = seen.pop(word)
                for unit in units.findall(word):
                    seen[unit] += n
            items = iter([(u, n) for u, n in seen.items() if len(u) <= SENT_CHARS])
            while some := list(islice(items, 50_000)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([u for u, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"]
                )
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                words = split_words(text.as_py() or "", units)
                if max(map(len, words), default=0) > SENT_CHARS:  # whole lines without a space are not held
                    words = [u for w in words for u in (units.findall(w) if len(w) > SENT_CHARS else [w])]
                seen.update(words)
                if len(seen) > COUNTED:
                    yield from out()
        yield from out()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_units(texts: DataFrame, units: re.Pattern, most: int = SENT) -> DataFrame:
    """The units that occur at least twice and so often that no more than ``most`` do, as a column ``word``."""
    counts = settled(unit_counts(texts, units).filter("n > 1"), "word-counts")
    least, total = None, 0
    levels = counts.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count("*").alias("words"))
    for row in levels.orderBy(F.desc("n")).toLocalIterator():  # at most as many levels as units are sent
        total += row.words
        if total > most:
            break
        least = row.n
    return counts.filter(F.col("n") >= least if least else F.lit(False)).select("word")


def encode_units(texts: DataFrame, pieces: Pieces, most: int = SENT) -> dict[str, bytes]:
    """Packed ids of the frequent units by the relational lattice; ``most`` bounds the table."""
    found = lattice_encode(frequent_units(texts, pieces.units, most), pieces).toArrow()
    return {w.as_py(): pack(pieces, c.as_py()) for w, c in zip(found.column("word"), found.column("codes"))}


class Encoder(dict):
    """Packed ids by unit: those sent, and those folded since, of which the older half is let go when they are too many;
    and by word of several units, all of which are let go when they are too many."""

    def __init__(self, pieces: Pieces, sent: dict[str, bytes]):
        super().__init__(sent)
        self.pieces, self.held = pieces, 0
        self.recent: list[str] = []
        self.older: dict[str, bytes] = {}
        self.joined: list[str] = []

    def words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of distinct words and of new units in them; units that are not remembered are folded together."""
        units, whole, out, new, several = self.pieces.units, self.pieces.whole, {}, set(), {}
        for word in words:
            known = self.get(word)
            if known is not None:
                out[word] = known
            elif whole(word):
                new.add(word)
            else:
                several[word] = units.findall(word)
                new.update(several[word])
        new = {unit for unit in new if unit not in self}
        found = {unit: self.older[unit] for unit in new & self.older.keys()}
        found |= fold_all(self.pieces, new.difference(found))
        out |= found
        for word, parts in several.items():
            out[word] = b"".join([found[unit] if unit in found else self[unit] for unit in parts])
        self._remember(found, [(word, out[word]) for word in several])
        return out

    def _remember(self, units: dict[str, bytes], words: list[tuple[str, bytes]]) -> None:
        for unit, packed in units.items():
            if len(unit) <= SENT_CHARS:
                self.held += ENTRY + len(unit) + len(packed)
                if 2 * self.held > UNIT_BYTES:
                    self.older = {u: self.pop(u) for u in self.recent}
                    self.recent, self.held = [], 0
                self[unit] = packed
                self.recent.append(unit)
        for word, packed in words:
            if len(word) <= SENT_CHARS:
                if len(self.joined) >= JOINED:
                    for w in self.joined:
                        del self[w]
                    self.joined.clear()
                self[word] = packed
                self.joined.append(word)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the words of all are held at once, and looked up ``TEXT_WORDS`` at a time."""
        words, ends, packed = [], [], []
        for text in texts:
            words += split_words(text, self.pieces.units)
            ends.append(len(words))
        for k in range(0, len(words), TEXT_WORDS):
            some = words[k : k + TEXT_WORDS]
            packed += map(self.words(dict.fromkeys(some)).__getitem__, some)
        return [b"".join(packed[a:b]) for a, b in zip([0, *ends], ends)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def decode(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of ids: pieces joined, bytes put together, the space before the text taken off."""
    parts = []
    for k in range(0, len(ids), DECODED):
        some = ids[k : k + DECODED]
        sizes = pieces.sizes[some]
        shifts = pieces.begins[some] - np.cumsum(sizes) + sizes
        parts.append(pieces.bytes[np.repeat(shifts, sizes) + np.arange(sizes.sum())].tobytes())
    joined = b"".join(parts).decode("utf-8", "replace")
    return joined[1:] if joined.startswith(" ") else joined


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", most: int = SENT) -> DataFrame:
    """doc_id and ids (array<int>), one row per row of ``df``. Null and empty texts have no ids.

    The model's weights are maximised, spaces are marks, one is put before the text, nothing is normalised, and
    characters that are no piece are spelt in bytes. Repeated rows get equal ids. Other columns are not read.
    Counting units and encoding the frequent ones are jobs that run when this is called.
    """
    return _with_encoder(df, model, id_col, text_col, most, "doc_id long, ids array<int>", None)


def encode_digest(
    df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", most: int = SENT
) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives the text).

    As ``encode``, and ids are decoded and digested in the task that made them. A null text counts as empty. Texts
    that hold the mark itself (U+2581) decode to spaces there, and so do not come back.
    """

    def digest(encoder: Encoder, text: str, packed: bytes) -> tuple:
        back = decode(encoder.pieces, np.frombuffer(packed, "<i4"))
        return len(packed) // 4, zlib.crc32(packed), back == text

    return _with_encoder(
        df, model, id_col, text_col, most,
        "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean", digest,
    )


def few_texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, null as empty, some ``TEXT_CHARS`` at once or one longer text."""
    docs, texts, chars = [], [], 0
    for doc, text in zip(batch.column(0), batch.column(1)):
        text = text.as_py() or ""
        if texts and chars + len(text) > TEXT_CHARS:
            yield docs, texts
            docs, texts, chars = [], [], 0
        docs.append(doc.as_py())
        texts.append(text)
        chars += 64 + len(text)
    if texts:
        yield docs, texts


def _with_encoder(df, model, id_col, text_col, most, schema, digest) -> DataFrame:
    """Encode whole texts in their tasks; ids stay packed until they leave as Arrow buffers, a few megabytes at once."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = Shared(df.sparkSession, (model, encode_units(texts, Pieces(model), most)))
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_()]

    def table(docs: list, packed: list[bytes], more: list[tuple]) -> pa.RecordBatch:
        ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
        ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
        columns = [pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), ids)]
        columns += [pa.array(column, kind) for column, kind in zip(zip(*more), kinds)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.made("piece_encoders", lambda value: Encoder(Pieces(value[0]), value[1]))
        docs, packed, more, held = [], [], [], 0
        for batch in batches:
            for ids, some in few_texts(batch):
                for doc, text, codes in zip(ids, some, encoder.encode_all(some)):
                    docs.append(doc)
                    packed.append(codes)
                    held += 64 + len(codes)
                    if digest:
                        more.append(digest(encoder, text, codes))
                    if held >= OUT_BYTES:
                        yield table(docs, packed, more)
                        docs, packed, more, held = [], [], [], 0
        if docs:
            yield table(docs, packed, more)

    return texts.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids; null ids give null. Ids outside the model fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            texts = [None if ids.as_py() is None else decode(pieces, np.array(ids.as_py(), int)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
