"""Byte-pair training in Spark: pieces and the counts of their pairs stay in tables, and merges are chosen in rounds.

Two stages, as superword training has them: pieces of words first, then, with the merges so far kept, pieces that may
span words.

A round takes as many merges as one after the other would choose anyway. Pieces are cut where two neighbours are rarer than
the pairs of the round; what is left, counted, is small, and merges are chosen in it one after the other for as long as they
are commoner than all that was cut: a pair across a cut stands at most where those neighbours stood. Then one pass over the
pieces makes all merges of the round, and what that changes is added to the counts by pair. The driver sees the first
CANDIDATES pairs and at most RUN_SYMBOLS symbols of runs in a round.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.plans import staging
from gristmill.plans.shipping import ship

#: Pairs that the driver looks at in a round, and symbols in the runs of those pairs; a round of fewer pairs has fewer.
CANDIDATES = 1 << 15
RUN_SYMBOLS = 1 << 20
#: Pairs that the first round tries, and all of a round in which no cut is possible.
APART = 256
#: Runs that a task counts before it passes them on.
RUNS_HELD = 1 << 18

# What the pre-tokenizer sets apart in each stage.
WORD_PIECES = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+|"
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*|"
    r"\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)
SPAN_PIECES = r"\p{N}{1,3}| ?[^\s\p{L}\p{N}]{2,}[\r\n/]*| +(?!\S)"
#: Characters that no match of a pattern begins with, where it is worth while to pass them over without a look ahead.
PLAIN = {SPAN_PIECES: r"\p{L}"}


def isolated(pattern: str) -> str:
    """A pattern whose matches are those of `pattern` and all that lies between them."""
    plain = f"{PLAIN[pattern]}++|" if pattern in PLAIN else ""
    return f"(?:{pattern})|(?:{plain}(?!{pattern})[\\s\\S])++"


def pieces(text: Column | str, pattern: str = WORD_PIECES) -> Column:
    return F.regexp_extract_all(text, F.lit(isolated(pattern)), F.lit(0))


def piece_counts(df: DataFrame, text: str = "text", pattern: str = WORD_PIECES) -> DataFrame:
    """(piece, n) of a corpus; all of them, as what is rare as a whole has pairs that are not."""
    spread = df.select(F.explode(pieces(F.col(text), pattern)).alias("piece"))
    return spread.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """(a, b, n): neighbouring bytes in pieces (piece, n), as two hex digits each."""
    hexes = counts.select("n", F.regexp_extract_all(F.hex(F.encode("piece", "UTF-8")), F.lit("(..)"), F.lit(1)).alias("h")).where(F.size("h") > 1)
    pairs = hexes.select("n", F.explode(F.arrays_zip(F.slice("h", F.lit(1), F.size("h") - 1).alias("a"), F.slice("h", F.lit(2), F.size("h") - 1).alias("b"))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.sum("n").cast("long").alias("n"))


def learn(counts: dict[str, int], merges: int, inherited: list[tuple[bytes, bytes]] = (), least: int = 1) -> list[tuple[bytes, bytes]]:
    """The merges, inherited ones first, of the commonest pair each time; equal counts go to the smaller pair.

    For pieces that are at hand; learn_in_rounds() is for those of a corpus.
    """
    words = [([bytes([b]) for b in p.encode()], n) for p, n in counts.items()]
    out = list(inherited)
    for pair in inherited:
        words = [(apply(w, pair), n) for w, n in words]
    return out + list(islice(chosen(words, least), max(0, merges - len(out))))


def chosen(words: list[tuple[list[bytes], int]], least: int) -> Iterator[tuple[bytes, bytes]]:
    """The commonest pair of words each time, as long as there are so many; words are changed."""
    tally: Counter = Counter()
    where: dict[tuple[bytes, bytes], set[int]] = defaultdict(set)
    for i, (w, n) in enumerate(words):
        for pair in zip(w, w[1:]):
            tally[pair] += n
            where[pair].add(i)
    # every count that a pair has had stands in the heap; those that are no longer true are passed over
    heap = [(-n, pair) for pair, n in tally.items()]
    heapify(heap)
    while heap:
        n, best = heappop(heap)
        if tally.get(best, 0) != -n:
            continue
        if -n < least:
            break
        yield best
        changed = set()
        for i in sorted(where.pop(best)):
            w, n = words[i]
            for pair in zip(w, w[1:]):
                tally[pair] -= n
                where[pair].discard(i)
                changed.add(pair)
            w = apply(w, best)
            words[i] = (w, n)
            for pair in zip(w, w[1:]):
                tally[pair] += n
                where[pair].add(i)
                changed.add(pair)
        for pair in changed:
            if tally[pair] > 0:
                heappush(heap, (-tally[pair], pair))
            else:
                del tally[pair]
                where.pop(pair, None)


def apply(word: list[bytes], pair: tuple[bytes, bytes]) -> list[bytes]:
    out, i = [], 0
    while i < len(word):
        if i + 1 < len(word) and (word[i], word[i + 1]) == pair:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


def ranked(word: list[bytes], rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """A word after all merges, by rank."""
    while len(word) > 1:
        best = min(zip(word, word[1:], strict=False), key=lambda p: rank.get(p, 1 << 60))
        if best not in rank:
            break
        word = apply(word, best)
    return word


class Symbols:
    """Numbers of byte strings: the 256 bytes, then what merges make, once where two make the same."""

    def __init__(self, merges: Iterable[tuple[bytes, bytes]] = ()):
        self.bytes = [bytes([b]) for b in range(256)]
        self.number = {v: i for i, v in enumerate(self.bytes)}
        for pair in merges:
            self.add(pair)

    def add(self, pair: tuple[bytes, bytes]) -> int:
        made = pair[0] + pair[1]
        if made not in self.number:
            self.number[made] = len(self.bytes)
            self.bytes.append(made)
        return self.number[made]

    def numbers(self, pairs: Iterable[tuple[bytes, bytes]]) -> list[tuple[int, int, int]]:
        """(a, b, what they make) of pairs; one whose parts are unknown is in no piece."""
        return [(self.number.get(a, -1), self.number.get(b, -1), self.add((a, b))) for a, b in pairs]


def spread(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a batch's pieces one after the other, and for each the piece that it is in."""
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def gathered(x: np.ndarray, owner: np.ndarray, pieces: int) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=pieces)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32, copy=False)))


def met(x: np.ndarray, owner: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where a pair stands."""
    at = np.flatnonzero(x[:-1] == a)
    return at[(x[at + 1] == b) & (owner[at + 1] == owner[at])]


def among(x: np.ndarray, owner: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether each symbol but the last and the next are one of the pairs of sorted numbers, in one piece."""
    if not len(codes) or len(x) < 2:
        return np.zeros(max(0, len(x) - 1), bool)
    code = x[:-1].astype(np.int64) << 32 | x[1:]
    return (codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code) & (owner[:-1] == owner[1:])


def stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First symbols and ends of the longest runs that are held together."""
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1


class Merger:
    """Makes many merges (a, b, made) at once: symbols that no merge can bring together are cut apart, and each run is merged once.

    By rank, as ranked() has it, or, if `once`, one merge after the other and none again.
    """

    def __init__(self, merges: list[tuple[int, int, int]], within: Iterable[int], once: bool = False):
        self.once, self.made, self.rank = once, [m for _, _, m in merges], {}
        for i, (a, b, _) in enumerate(merges):
            self.rank.setdefault((a, b), i)
        # neighbours that stand in what is made, as numbers
        self.codes = np.array(sorted(set(within)), np.int64)
        self.known: dict[bytes, bytes] = {}

    def one(self, word: list[int]) -> list[int]:
        rank, after, before = self.rank, list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank]
        heapify(heap)
        while heap:
            r, here = heap[0][0], []
            while heap and heap[0][0] == r:
                here.append(heappop(heap)[1])
            for i in here:
                j = after[i]
                # merged meanwhile, or with another neighbour
                if word[i] < 0 or j >= len(word) or rank.get((word[i], word[j])) != r:
                    continue
                word[i], word[j], after[i] = self.made[r], -1, after[j]
                if after[j] < len(word):
                    before[after[j]] = i
                for k in (before[i], i):
                    if k >= 0 and after[k] < len(word):
                        new = rank.get((word[k], word[after[k]]))
                        if new is not None and (new > r or not self.once):
                            heappush(heap, (new, k))
        return [w for w in word if w >= 0]

    def all(self, x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols and pieces after the merges; which of the symbols before and after are in runs that changed."""
        first, end = stretches(among(x, owner, self.codes))
        raw, known, out, at, sizes = x.tobytes(), self.known, [], 0, []
        if len(known) > RUNS_HELD:
            known.clear()
        for a, b in zip((first * 4).tolist(), (end * 4).tolist()):
            run = raw[a:b]
            made = known.get(run)
            if made is None:
                made = known[run] = np.array(self.one(np.frombuffer(run, np.int32).tolist()), np.int32).tobytes()
            out += raw[at:a], made
            sizes.append(len(made) // 4)
            at = b
        out.append(raw[at:])
        lost = end - first - np.array(sizes, np.int64)
        changed, left = np.zeros(len(x) + 1, np.int8), np.ones(len(x), bool)
        changed[first[lost > 0]] += 1
        changed[end[lost > 0]] -= 1
        changed = np.cumsum(changed[:-1], dtype=np.int8).astype(bool)
        left[np.repeat(end - np.cumsum(lost), lost) + np.arange(lost.sum())] = False
        return np.frombuffer(b"".join(out), np.int32), owner[left], changed, changed[left]


def tally(x: np.ndarray, owner: np.ndarray, n: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, n): neighbouring symbols as one number each, with their pieces' counts; only those with a symbol that is asked for."""
    same = owner[:-1] == owner[1:]
    at = np.flatnonzero(same if of is None else same & (of[:-1] | of[1:]))
    return x[at].astype(np.int64) << 32 | x[at + 1], n[owner[at]]


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers once, with the sum of their counts; none where that is 0."""
    if not len(code):
        return code, n
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(code) != 0)))
    total = np.add.reduceat(n, first)
    return code[first][total != 0], total[total != 0]


PIECES = "n long, parts array<int>, delta array<struct<a: binary, b: binary, n: long>>"


def counted(n: pa.Array, parts: pa.Array, code: np.ndarray, change: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """PIECES of a batch; its first row has what all of them add to the counts of pairs."""
    a, b = names.take(pa.array(code >> 32)), names.take(pa.array(code & 0xFFFFFFFF))
    offsets = np.full(len(parts) + 1, len(code), np.int32)
    offsets[0] = 0
    delta = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([a, b, pa.array(change, pa.int64())], ["a", "b", "n"]))
    return pa.RecordBatch.from_arrays([n, parts, delta], ["n", "parts", "delta"])


def spelt(counts: DataFrame, inherited: list[tuple[bytes, bytes]]) -> DataFrame:
    """PIECES of pieces (piece, n) as bytes, with the inherited merges made as in ranked(), and all their pairs as a change."""
    symbols = Symbols(inherited)
    merges, names = symbols.numbers(inherited), pa.array(symbols.bytes, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(merges, (a[-1] << 32 | b[0] for a, b in inherited))
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            x = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.int32)
            owner, n = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at)), batch.column(0).to_numpy(zero_copy_only=False)
            x, owner, _, _ = merger.all(x, owner)
            yield counted(batch.column(0), gathered(x, owner, len(texts)), *summed(*tally(x, owner, n)), names)

    ship(counts.sparkSession)
    return counts.select(F.col("n").cast("long").alias("n"), F.col("piece").cast("string").alias("piece")).mapInArrow(run, PIECES)


def runs(pieces: DataFrame, active: list[tuple[bytes, bytes]], symbols: Symbols) -> DataFrame:
    """(run, n): the symbols, four bytes each, of the longest parts of pieces in which all neighbours are active pairs."""
    codes = np.array(sorted(symbols.number[a] << 32 | symbols.number[b] for a, b in active), np.int64)

    def passed(found: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["run", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            n, (x, owner) = batch.column(0).to_numpy(zero_copy_only=False), spread(batch.column(1))
            first, end = stretches(among(x, owner, codes))
            raw = x.tobytes()
            for a, b, k in zip((first * 4).tolist(), (end * 4).tolist(), n[owner[first]].tolist()):
                found[raw[a:b]] = found.get(raw[a:b], 0) + k
            if len(found) > RUNS_HELD:
                yield passed(found)
                found = {}
        yield passed(found)

    return pieces.select("n", "parts").mapInArrow(run, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))


def settled(found: pa.Table, floor: int, room: int, symbols: Symbols) -> list[tuple[bytes, bytes]]:
    """The merges of runs down to a count that no pair across a cut reaches.

    It holds as long as a symbol begins and ends with the same ones of the round's first; the merge that breaks that is the last.
    """
    words = [([symbols.bytes[i] for i in np.frombuffer(w, np.int32)], n) for w, n in zip(found["run"].to_pylist(), found["n"].to_pylist())]
    ends: dict[bytes, tuple[bytes, bytes]] = {}
    out: dict[tuple[bytes, bytes], None] = {}
    for a, b in islice(chosen(words, floor), room):
        if (a, b) in out:
            break
        out[a, b] = None
        made, new = a + b, (ends.get(a, (a, a))[0], ends.get(b, (b, b))[1])
        if ends.setdefault(made, (made, made) if made in symbols.number else new) != new:
            break
    return list(out)


def neighbours(pieces: DataFrame, pairs: list[tuple[bytes, bytes]], symbols: Symbols) -> dict[tuple[bytes, bytes], int]:
    """For each pair the most that a pair which its merge makes can count."""
    wanted = [(symbols.number[a], symbols.number[b]) for a, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [], []
        for batch in batches:
            n, (x, owner) = batch.column(0).to_numpy(zero_copy_only=False), spread(batch.column(1))
            for k, pair in enumerate(wanted):
                at = met(x, owner, *pair)
                before, after = at[at > 0], at[at < len(x) - 2]
                before, after = before[owner[before - 1] == owner[before]], after[owner[after + 2] == owner[after]]
                found[0].append(np.concatenate((x[before - 1] * 2 + 1, x[after + 2] * 2)).astype(np.int64) << 32 | k)
                found[1].append(np.concatenate((n[owner[before]], n[owner[after]])))
            if len(found[0]) > 4096:
                found = tuple([x] for x in summed(*map(np.concatenate, found)))
        code, n = summed(*map(np.concatenate, found)) if found[0] else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(code >> 32), pa.array(n, pa.int64())], ["k", "x", "n"])

    each = pieces.select("n", "parts").mapInArrow(run, "k int, x long, n long").groupBy("k", "x").agg(F.sum("n").alias("n"))
    return {pairs[r["k"]]: r["n"] for r in each.groupBy("k").agg(F.max("n").alias("n")).collect()}  # a row for each of the pairs


def independent(top: list[tuple[int, tuple[bytes, bytes]]]) -> list[tuple[int, tuple[bytes, bytes]]]:
    """The first of the commonest pairs, up to one that has a part, or is a part of what is made, in common with one before."""
    used: set[bytes] = set()
    out = []
    for n, (a, b) in top:
        if {a, b, a + b} & used:
            break
        used |= {a, b, a + b}
        out.append((n, (a, b)))
    return out


def merged(pieces: DataFrame, batch_: list[tuple[bytes, bytes]], symbols: Symbols) -> DataFrame:
    """PIECES after merges, one after the other, and what the runs that changed add to the counts of pairs."""
    merges = symbols.numbers(batch_)
    names = pa.array(symbols.bytes, pa.binary())
    within, first, last = set(), {}, {}
    for a, b, made in merges:
        within.add(last.get(a, a) << 32 | first.get(b, b))
        first.setdefault(made, first.get(a, a))
        last.setdefault(made, last.get(b, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(merges, within, once=True)
        for batch in batches:
            n, (x, owner) = batch.column(0).to_numpy(zero_copy_only=False), spread(batch.column(1))
            y, left, old, new = merger.all(x, owner)
            gone, come = tally(x, owner, n, old), tally(y, left, n, new)
            change = summed(np.concatenate((gone[0], come[0])), np.concatenate((-gone[1], come[1])))
            yield counted(batch.column(0), gathered(y, left, len(n)), *change, names)

    return pieces.select("n", "parts").mapInArrow(run, PIECES)


def learn_in_rounds(counts: DataFrame, merges: int, inherited: list[tuple[bytes, bytes]] = (), least: int = 1) -> list[tuple[bytes, bytes]]:
    """learn() of pieces (piece, n) that stay in Spark: the same merges."""
    out, size = list(inherited), APART
    symbols = Symbols(out)
    pieces = staging.keep(spelt(counts, out))
    pairs = staging.keep(changes(pieces).groupBy("a", "b").agg(F.sum("n").alias("n")))
    while len(out) < merges:
        first = pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(CANDIDATES + 1).collect()
        if not first:
            break
        top = [(r["n"], (bytes(r["a"]), bytes(r["b"]))) for r in first]
        batch, size = round_(pieces, top, merges - len(out), symbols, least, size)
        out += batch
        if len(out) == merges:
            break
        before = pieces, pairs
        pieces = staging.keep(merged(pieces, batch, symbols))
        pairs = staging.keep(pairs.unionByName(changes(pieces)).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0"))
        staging.drop(*before)
    staging.drop(pieces, pairs)
    return out


def round_(pieces: DataFrame, top: list[tuple[int, tuple[bytes, bytes]]], room: int, symbols: Symbols, least: int, size: int) -> tuple[list[tuple[bytes, bytes]], int]:
    """The merges of a round from its commonest pairs, and how many pairs the next may begin with."""
    while True:
        floor = top[size][0] + 1 if len(top) > size else least
        active = [pair for n, pair in top if n >= floor]
        if len(active) < 2:
            # too many pairs are as common as the first, or its runs are too long
            return apart(pieces, top, room, symbols), max(size, 16)
        found = staging.keep(runs(pieces, active, symbols))
        held = found.agg(F.sum(F.length("run")).alias("n")).first()["n"] // 4
        rows = found.toArrow() if held <= RUN_SYMBOLS else None
        staging.drop(found)
        if rows is not None:
            return settled(rows, floor, room, symbols), min(CANDIDATES, size * (4 if held * 8 < RUN_SYMBOLS else 2 if held * 3 < RUN_SYMBOLS else 1))
        size = min(size, len(active)) // 3


def apart(pieces: DataFrame, top: list[tuple[int, tuple[bytes, bytes]]], room: int, symbols: Symbols) -> list[tuple[bytes, bytes]]:
    """Merges that share no part, as long as no pair that one makes can be as common as the next."""
    top = independent(top[:APART])[:room]
    bound = neighbours(pieces, [p for _, p in top], symbols) if len(top) > 1 else {}
    batch, most = [], 0
    for n, pair in top:
        if batch and most >= n:
            break
        batch.append(pair)
        most = max(most, bound.get(pair, 0))
    return batch


def changes(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.explode("delta").alias("d")).select("d.a", "d.b", "d.n")


def train(df: DataFrame, vocab: int, text: str = "text", first_share: float = 0.8, least: int = 2, special: tuple[str, ...] = ()) -> list[tuple[bytes, bytes]]:
    """Merges of a two-stage vocabulary of so many ids: bytes, special tokens, the first stage's share, then the rest."""
    room = vocab - 256 - len(special)
    out: list[tuple[bytes, bytes]] = []
    for pattern, goal in ((WORD_PIECES, int(room * first_share)), (SPAN_PIECES, room)):
        out = learn_in_rounds(piece_counts(df, text, pattern), goal, out, least)
    return out


class MergeTokenizer:
    """Byte-level BPE from learnt merges."""

    def __init__(self, merges: list[tuple[bytes, bytes]], pattern: str = SPAN_PIECES, special: tuple[str, ...] = ()):
        import regex

        self.rank = {p: i for i, p in enumerate(merges)}
        self.pattern = regex.compile(isolated(pattern))
        vocab = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        self.ids = {}
        for v in vocab:
            self.ids.setdefault(v, len(self.ids))
        self.bytes = {i: v for v, i in self.ids.items()}
        self.special = {s: len(self.ids) + i for i, s in enumerate(special)}
        self.vocab_size = len(self.ids) + len(self.special)

    def encode(self, text: str) -> list[int]:
        out = []
        for piece in self.pattern.findall(text):
            out += [self.ids[w] for w in ranked([bytes([b]) for b in piece.encode()], self.rank)]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


def save(merges: list[tuple[bytes, bytes]], path: str | Path) -> None:
    Path(path).write_text(json.dumps([[a.hex(), b.hex()] for a, b in merges]), encoding="utf-8")


def load(path: str | Path) -> list[tuple[bytes, bytes]]:
    return [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in json.loads(Path(path).read_text(encoding="utf-8"))]


def train_or_load(df: DataFrame, path: str | Path, vocab: int, force: bool = False, **options) -> list[tuple[bytes, bytes]]:
    """The merges in a file on the driver, trained and kept there if there are none or force is set."""
    if force or not Path(path).exists():
        save(train(df, vocab, **options), path)
    return load(path)
