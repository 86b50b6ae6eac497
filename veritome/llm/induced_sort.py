"""External suffix sorting by recursive induction, with common-prefix values.

The input is a collection of strings in one mapped byte array, each ended by 0xFF
(which UTF-8 never holds).  Everything that grows with it lies in unnamed files
that the operating system removes with the task: the symbols, the ordered parts,
and the priority queues, which keep at most ``memory`` bytes of waiting tuples and
write the rest out.  A string itself is held whole.

One level sorts like this.  Suffixes are smaller (S) or larger (L) than the one
after them; an S after an L is a seed.  The stretch from a seed to the next is cut
into pieces of a few symbols with their kinds, packed into 64 bits; an external
merge sort of the pieces names them, and the names form the strings of the next
level, which is sorted the same way, down to strings of one name.  That gives the
order of the seeds, from which L suffixes are induced upwards and then S suffixes
downwards: a tuple leaves the queue in order of (symbol, time of entry), and the
suffix one place before it enters.  Equal suffixes of different strings may come
in any order.

On the bytes the tuples also carry the common prefix with the tuple that entered
before them: one more than the least common prefix met between the two that let
them in, up to ``CAP``.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

#: Common prefixes are exact up to here.
CAP = 64
#: Bytes that follow the text in the mapped array.
PAD = CAP + 8
END = 0xFF
#: Bytes of waiting tuples that stay in memory.
MEMORY = 16 << 20
#: Memory for each tuple of a block; small blocks let in few tuples of their own and stay in the processor's cache.
_TUPLE = 384


class Work:
    """What one sort may hold in memory, and what it did."""

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.block = memory, max(16, memory // _TUPLE)
        self.levels = self.spilled = 0


class Column:
    """An array in an unnamed file: appended to, then mapped."""

    def __init__(self, kind) -> None:
        self.kind, self.size, self.file = np.dtype(kind), 0, tempfile.TemporaryFile()

    def append(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, self.kind).data)
        self.size += len(values)

    def mapped(self, mode: str = "r") -> np.ndarray:
        self.file.flush()
        return np.asarray(np.memmap(self.file, self.kind, mode, shape=(self.size,))) if self.size else np.empty(0, self.kind)

    @classmethod
    def blank(cls, kind, size: int) -> Column:
        """A column of zeros."""
        out = cls(kind)
        out.size = size
        out.file.truncate(size * out.kind.itemsize)
        return out


def _places(n: int):
    """A type for positions below n."""
    return np.uint32 if n < 1 << 32 else np.int64


class SymbolQueues:
    """A priority queue of (position, common prefix) tuples with few priorities: a symbol each, first come first served."""

    def __init__(self, symbols: int, work: Work) -> None:
        self.held: list[deque] = [deque() for _ in range(symbols)]
        self.stored: list[deque] = [deque() for _ in range(symbols)]
        self.work, self.used, self.file = work, 0, None

    def push(self, symbol: int, position: np.ndarray, common: np.ndarray) -> None:
        self.held[symbol].append((position, common))
        self.used += 9 * len(position)
        if self.used > self.work.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, parts in enumerate(self.held):
            if parts:
                position, common = (np.concatenate(x) for x in zip(*parts))
                self.stored[symbol].append((self.file.tell(), len(position), 0))
                self.file.write(position.tobytes())
                self.file.write(common.tobytes())
                self.work.spilled += 9 * len(position)
                parts.clear()
        self.used = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """About a block of the symbol's tuples, oldest first."""
        most, parts = self.work.block, []
        while most > 0 and self.stored[symbol]:
            at, size, done = self.stored[symbol].popleft()
            n = min(most, size - done)
            self.file.seek(at + 8 * done)
            position = np.frombuffer(self.file.read(8 * n), np.int64)
            self.file.seek(at + 8 * size + done)
            parts.append((position, np.frombuffer(self.file.read(n), np.uint8)))
            if done + n < size:
                self.stored[symbol].appendleft((at, size, done + n))
            most -= n
        while most > 0 and self.held[symbol]:
            parts.append(self.held[symbol].popleft())
            most -= len(parts[-1][0])
            self.used -= 9 * len(parts[-1][0])
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.uint8)
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


class RunQueue:
    """A priority queue of (symbol, position) with any number of priorities: sorted runs in a file, and what has come since."""

    def __init__(self, work: Work) -> None:
        self.work, self.runs, self.fresh, self.waiting, self.ordered = work, [], [], 0, True

    def push(self, symbol: np.ndarray, position: np.ndarray) -> None:
        if not len(symbol):
            return
        self.fresh.append((symbol, position))
        self.ordered = False
        self.waiting += len(symbol)
        if 16 * self.waiting > self.work.memory:
            symbol, position = self._merged()
            columns = Column(np.int64), Column(np.int64)
            columns[0].append(symbol)
            columns[1].append(position)
            self.work.spilled += 16 * len(symbol)
            self.runs.append([*(c.mapped() for c in columns), 0])
            self.fresh, self.waiting = [], 0

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        """What is not yet in a run, ordered; kept so, as one part."""
        if not self.fresh:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if not self.ordered:
            symbol, position = (np.concatenate(x) for x in zip(*self.fresh))
            order = np.argsort(symbol, kind="stable")
            self.fresh, self.ordered = [(symbol[order], position[order])], True
        return self.fresh[0]

    def _stretches(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        return [*map(tuple, self.runs), (*self._merged(), 0)]

    def least(self) -> int | None:
        return min((int(s[at]) for s, _, at in self._stretches() if at < len(s)), default=None)

    def bound(self, most: int) -> int | None:
        """A symbol before which no more than ``most`` tuples wait; None if that holds for all."""
        live = [(s, at) for s, _, at in self._stretches() if at < len(s)]
        share = max(1, most // max(1, len(live)))
        return min((int(s[at + share]) for s, at in live if at + share < len(s)), default=None)

    def take(self, until: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tuples with symbols before ``until`` by symbol and time; at most ``most`` (for one symbol, whose tuples are in time order)."""
        out = []
        for run in [*self.runs, None]:
            symbol, position, at = run if run else (*self._merged(), 0)
            end = int(np.searchsorted(symbol[at:], until)) + at
            if most is not None:
                end = min(end, at + most)
                most -= end - at
            out.append((np.array(symbol[at:end]), np.array(position[at:end])))
            if run:
                run[2] = end
            elif len(symbol):
                self.fresh, self.waiting = ([(symbol[end:], position[end:])], len(symbol) - end) if end < len(symbol) else ([], 0)
        self.runs = [r for r in self.runs if r[2] < len(r[0])]
        symbol, position = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(symbol, kind="stable")
        return symbol[order], position[order]


# ---- kinds, pieces and names -------------------------------------------------


def small(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S; strings end with 0, so does the text."""
    n = len(text)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    rises[-1] = 1
    turn = np.where(rises != 0, np.arange(n), n)
    return rises[np.minimum.accumulate(turn[::-1])[::-1]] > 0


def _chunks(n: int, is_end: Callable[[int, int], np.ndarray], step: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole strings."""
    lo = 0
    while lo < n:
        hi, reach = min(n, lo + step), step
        while hi < n:
            ends = np.flatnonzero(is_end(hi - 1, min(n, hi - 1 + reach)))
            if len(ends):
                hi += int(ends[0])
                break
            hi, reach = min(n, hi + reach), 2 * reach
        yield lo, hi
        lo = hi


class Level:
    """Symbols with their kinds (2 * symbol + S) of one level, and its seeds cut into pieces."""

    def __init__(self, chunks: Iterator[np.ndarray], kind, symbols: int, size: int, work: Work) -> None:
        """``chunks`` are whole strings of symbols, the very first symbol an end."""
        self.work, self.symbols = work, symbols
        self.bits = (2 * symbols + 1).bit_length()
        self.span = 63 // self.bits
        work.levels += 1
        coded, self.starts = Column(kind), Column(_places(size))
        keys, self.ends, self.longest, at = [], Column(_places(size)), 0, 0
        held: list = []

        def run() -> None:
            key, place = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            columns = Column(np.int64), Column(_places(size))
            columns[0].append(key[order])
            columns[1].append(place[order])
            keys.append([*(c.mapped() for c in columns), 0])
            held.clear()

        for text in chunks:
            s = small(text)
            value = 2 * text.astype(np.int64) + s
            coded.append(value)
            seed = np.flatnonzero(s[1:] & ~s[:-1]) + 1
            self.ends.append(at + seed[text[seed] == 0])
            if len(seed):
                start, key, most = self._pieces(text, value, seed)
                self.longest = max(self.longest, most)
                held.append((key, np.arange(self.starts.size, self.starts.size + len(key))))
                self.starts.append(at + start)
                if sum(len(k) for k, _ in held) >= work.block:
                    run()
            at += len(text)
        if held:
            run()
        self.runs, self.coded, self.size = keys, coded.mapped(), at

    def _pieces(self, text: np.ndarray, value: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Start and packed symbols of each piece, and the most pieces of a string."""
        is_end = text[seed] == 0
        following = np.append(seed[1:], seed[-1] + 1)
        many = np.where(is_end, 1, -(-(following - seed) // self.span))
        first = np.cumsum(many) - many
        k = np.arange(many.sum()) - np.repeat(first, many)
        start = np.repeat(seed, many) + self.span * k
        stop = np.where(np.repeat(is_end, many), start, np.repeat(following, many))  # the last symbol that a piece may hold
        key, n = np.zeros(len(start), np.int64), len(value)
        for j in range(self.span):
            symbol = value[np.minimum(start + j, n - 1)]
            key = (key << self.bits) | np.where(start + j <= stop, symbol, 0)
        closing = np.flatnonzero(np.repeat(is_end, many))
        return start, key, int(np.diff(closing, prepend=-1).max(initial=0)) - 1

    def names(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Pieces in order, the name of each piece in text order (ends are 0), and the number of names."""
        n, block = self.starts.size, self.work.block
        ordered, named = Column(_places(n)), Column.blank(np.uint32 if n < 1 << 31 else np.int64, n)
        name, last, count = named.mapped("r+"), None, 0
        while runs := [r for r in self.runs if r[2] < len(r[0])]:
            share = max(1, block // len(runs))
            least = min(int(k[at]) for k, _, at in runs)
            bound = min((int(k[at + share]) for k, _, at in runs if at + share < len(k)), default=1 << 63)
            parts = []
            for run in runs:
                key, place, at = run
                rest = key[at : at + share]
                # Keys before the bound; of a key that fills a share, a share of every run.
                end = at + int(np.searchsorted(rest, least, "right") if least == bound else np.searchsorted(rest, bound))
                parts.append((key[at:end], place[at:end]))
                run[2] = end
            key, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last is None or key[0] != last
            name[place] = count + np.cumsum(new) - 1
            ordered.append(place)
            count += int(new.sum())
            last = key[-1]
        self.runs = []  # their files go
        return ordered.mapped(), name, count


# ---- induction ---------------------------------------------------------------


def _reversed(column: np.ndarray, block: int) -> Iterator[np.ndarray]:
    for hi in range(len(column), 0, -block):
        yield column[max(0, hi - block) : hi][::-1].astype(np.int64)


def _forward(column: np.ndarray, block: int) -> Iterator[np.ndarray]:
    for lo in range(0, len(column), block):
        yield column[lo : lo + block].astype(np.int64)


class _Seeds:
    """Positions in order with their priorities, taken block after block."""

    def __init__(self, blocks: Iterator[np.ndarray], priority: Callable[[np.ndarray], np.ndarray]) -> None:
        self.blocks, self.priority = blocks, priority
        self.position = self.symbol = np.empty(0, np.int64)
        self._fill()

    def _fill(self) -> None:
        while not len(self.position) and (block := next(self.blocks, None)) is not None:
            self.position, self.symbol = block, self.priority(block)

    def take(self, until: int) -> tuple[np.ndarray, np.ndarray]:
        """Those before ``until`` that are at hand: all of them if the next one is not before ``until``."""
        end = int(np.searchsorted(self.symbol, until))
        out = self.symbol[:end], self.position[:end]
        self.symbol, self.position = self.symbol[end:], self.position[end:]
        self._fill()
        return out


def _induce_names(level: Level, seeds: Iterator[np.ndarray], down: bool) -> Column:
    """One pass over a level of names: L suffixes upwards from the seeds, or S suffixes downwards from the L suffixes.

    Upwards gives the L suffixes in order, downwards all suffixes from the largest on.
    """
    coded, work, top = level.coded, level.work, level.symbols
    out, queue = Column(_places(level.size)), RunQueue(work)

    def priority(position: np.ndarray) -> np.ndarray:
        symbol = (coded[position] >> 1).astype(np.int64)
        return top - symbol if down else symbol

    def before(position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the tuples let in the suffix before them, that suffix and its priority."""
        value = coded[position - 1]
        which = np.flatnonzero(((value & 1) == down) & (value > 1))
        symbol = (value[which] >> 1).astype(np.int64)
        return which, position[which] - 1, top - symbol if down else symbol

    given = _Seeds(seeds, priority)
    while True:
        least = min((x for x in (queue.least(), int(given.symbol[0]) if len(given.symbol) else None) if x is not None), default=None)
        if least is None:
            return out
        bounds = [queue.bound(work.block), int(given.symbol[-1]) if len(given.symbol) else None]
        until = min((b for b in bounds if b is not None), default=top + 1)
        if until <= least:  # one symbol fills a block: first come first served, then its seeds
            while True:
                symbol, position = queue.take(least + 1, work.block)
                if not len(position):
                    break
                out.append(position)
                _, found, rank = before(position)
                queue.push(rank, found)
            while len(given.symbol) and given.symbol[0] == least:
                _, position = given.take(least + 1)
                if down:
                    out.append(position)
                _, found, rank = before(position)
                queue.push(rank, found)
            continue
        symbol, position = queue.take(until)
        own, seed = given.take(until)
        which, found, rank = before(np.concatenate([position, seed]))
        size, depth, later, within = len(symbol) + len(own), 0, [], []
        while len(which):
            here = rank < until
            later.append((which[~here], found[~here], rank[~here]))
            which, found, rank = which[here], found[here], rank[here]
            if len(which):
                within.append((which, found, rank))
                depth += 1
                after, more, again = before(found)
                which, found, rank, size = size + after, more, again, size + len(found)
        # Tuples let in within the block follow, of one symbol, those that waited and precede the seeds, in the order of what let them in.
        cause, inside, rank = (np.concatenate(x) for x in zip(*within)) if within else (np.empty(0, np.int64),) * 3
        waited, let_in, last = 3 * (symbol - least), 3 * (rank - least) + 1, 3 * (own - least) + 2
        ranks = np.sort(let_in)
        place = np.concatenate([
            np.arange(len(symbol)) + np.searchsorted(ranks, waited) + np.searchsorted(last, waited),
            np.arange(len(own)) + np.searchsorted(ranks, last) + np.searchsorted(waited, last),
            np.zeros(len(cause), np.int64),
        ])
        slots = np.arange(len(ranks)) + np.searchsorted(waited, ranks) + np.searchsorted(last, ranks)
        inner = place[len(symbol) + len(own) :]
        inner[np.argsort(let_in)] = slots
        for _ in range(depth):  # each round settles one more step of what let in what
            now = np.argsort((let_in << 32) + place[cause])
            settled = bool((inner[now] == slots).all())
            inner[now] = slots
            if settled:
                break
        final = np.empty(len(place), np.int64)
        final[place] = np.concatenate([position, seed, inside])
        if not down:
            is_seed = np.zeros(len(place), bool)
            is_seed[place[len(symbol) : len(symbol) + len(own)]] = True
            final = final[~is_seed]
        out.append(final)
        if later:
            which, found, rank = (np.concatenate(x) for x in zip(*later))
            late = np.argsort(place[which])
            queue.push(rank[late], found[late])


def _order_names(chunks: Iterator[np.ndarray], symbols: int, size: int, work: Work) -> Column:
    """All suffixes of strings of names, from the largest on."""
    level = Level(chunks, np.uint32 if symbols < 1 << 30 else np.int64, symbols, size, work)
    seeds = _order_seeds(level)
    large = _induce_names(level, seeds, False)
    return _induce_names(level, _reversed(large.mapped(), work.block), True)


def _order_seeds(level: Level) -> Iterator[np.ndarray]:
    """The level's seeds in order, ends first."""
    block, coded = level.work.block, level.coded
    ordered, name, count = level.names()
    starts, ends = level.starts.mapped(), level.ends.mapped()

    def is_seed(position: np.ndarray) -> np.ndarray:
        return position[(coded[position] & 1 == 1) & (coded[position - 1] & 1 == 0)]

    if count - 1 < len(starts) - len(ends) and level.longest > 1:

        def chunks() -> Iterator[np.ndarray]:
            yield np.zeros(1, np.int64)
            for lo, hi in _chunks(len(name), lambda a, b: name[a:b] == 0, block):
                yield name[lo:hi].astype(np.int64)

        order = _order_names(chunks(), count, len(name) + 1, level.work).mapped()
        pieces = (p[name[p - 1] > 0] - 1 for p in _reversed(order, block))
    else:  # names tell all pieces apart, or each string has one
        pieces = (p[name[p] > 0] for p in _forward(ordered, block))
    yield from _forward(ends, block)
    for some in pieces:
        yield is_seed(starts[some].astype(np.int64))


def _range_minima(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Minima of half-open, non-empty ranges of a byte array."""
    n, rows = len(values), [values]
    while 2 << (len(rows) - 1) <= n:
        half = 1 << (len(rows) - 1)
        row = np.full(n, CAP, np.uint8)
        np.minimum(rows[-1][: n - half], rows[-1][half:], out=row[: n - half])
        rows.append(row)
    flat = np.concatenate(rows)
    # frexp gives the place of the highest bit exactly.
    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        power = np.frexp((hi - lo).astype(np.float64))[1] - 1
        at = power * n
        return np.minimum(flat[at + lo], flat[at + hi - (1 << power)])

    return least


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the bytes at ``a`` and ``b``, up to ``CAP``; ``words`` has the eight bytes from each place on."""
    out, live = np.full(len(a), CAP, np.uint8), np.arange(len(a))
    for k in range(0, CAP, 8):
        x = words[a[live] + k] ^ words[b[live] + k]
        differ = np.flatnonzero(x)
        y = x[differ]
        out[live[differ]] = k + (np.bitwise_count((y & -y) - np.uint64(1)) >> 3)
        live = np.delete(live, differ)
        if not len(live):
            break
    return out


def sort_suffixes(raw: np.ndarray, emit: Callable[[np.ndarray, np.ndarray], None], work: Work) -> None:
    """Suffixes of the strings in ``raw``, from the largest on, block after block.

    ``raw`` is 0xFF, then each string with 0xFF after it, then ``PAD`` more bytes.
    ``emit`` gets positions and each one's common prefix with the suffix before it.
    """
    n, block = len(raw) - PAD, work.block
    if n < 2:
        return
    words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    chunks = ((raw[lo:hi].astype(np.int64) + 1) & 0xFF for lo, hi in _chunks(n, lambda a, b: raw[a:b] == END, block))
    level = Level(chunks, np.uint16, 256, n, work)
    coded = level.coded
    large, large_common, sizes = Column(_places(n)), Column(np.uint8), np.zeros(257, np.int64)

    def passer(down: bool) -> tuple[SymbolQueues, Callable]:
        queues, met = SymbolQueues(256, work), np.full(256, -1, np.int64)

        def scan(position: np.ndarray, common: np.ndarray) -> None:
            """Lets in the suffixes before the scanned ones."""
            value = coded[position - 1]
            at = np.flatnonzero(((value & 1) == down) & (value > 1))
            symbol = value[at] >> 1
            order = np.argsort(symbol, kind="stable")
            symbol, at = symbol[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(at) else at
            present = symbol[first].astype(np.int64)
            if len(at):
                lo = np.zeros(len(at), np.int64)
                lo[1:] = at[:-1] + 1
                lo[first] = 0
                least = _range_minima(common)(lo, at + 1).astype(np.int64)
                least[first] = np.minimum(least[first], met[present])
                value = np.where(least < 0, 0, np.minimum(least + 1, CAP)).astype(np.uint8)
            # met: the least common prefix since the last entry of each symbol, -1 before the first.
            np.minimum(met, int(common.min()), out=met)
            bounds = [*first.tolist(), len(at)]
            if len(at):
                rest = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(CAP))
                met[present] = rest[at[np.array(bounds[1:]) - 1] + 1]
            entering = position[at] - 1
            for s, a, b in zip(present.tolist(), bounds, bounds[1:]):
                queues.push(s, entering[a:b], value[a:b])

        return queues, scan

    def seeds() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Seeds in order with their common prefixes."""
        last = None
        for position in _order_seeds(level):
            if not len(position):
                continue
            previous = np.concatenate([[position[0] if last is None else last], position[:-1]])
            yield position, np.where(coded[position] == 1, 0, common_prefix(words, previous, position)).astype(np.uint8)
            last = position[-1]

    def pair(a: int, b: int) -> int:
        return int(common_prefix(words, np.array([a]), np.array([b]))[0])

    queues, scan = passer(False)
    given = seeds()
    position, common = next(given, (np.empty(0, np.int64), np.empty(0, np.uint8)))
    for symbol in range(256):
        last = None
        while True:
            some, shared = queues.take(symbol)
            if not len(some):
                break
            if last is None:
                shared = shared.copy()
                shared[0] = 0
            large.append(some)
            large_common.append(shared)
            sizes[symbol] += len(some)
            last = int(some[-1])
            scan(some, shared)
        fresh = True
        while len(position) and coded[position[0]] >> 1 == symbol:
            end = int(np.searchsorted(coded[position] >> 1, symbol, "right"))
            some, shared = position[:end], common[:end].copy()
            if fresh:
                shared[0] = 0 if last is None or symbol == 0 else pair(last, int(some[0]))
                fresh = False
            scan(some, shared)
            position, common = position[end:], common[end:]
            if not len(position):
                position, common = next(given, (position, common))

    queues, scan = passer(True)
    all_large, all_common, end = large.mapped(), large_common.mapped(), large.size
    for symbol in range(255, 0, -1):
        last = None
        while True:
            some, shared = queues.take(symbol)
            if not len(some):
                break
            if last is None:
                shared = shared.copy()
                shared[0] = 0
            last = int(some[-1])
            emit(some, shared)
            scan(some, shared)
        begin, following = end - int(sizes[symbol]), None
        for hi in range(end, begin, -block):
            lo = max(begin, hi - block)
            some = all_large[lo:hi][::-1].astype(np.int64)
            # Going down, a suffix's neighbour is the larger one, which holds their common prefix.
            shared = np.empty(hi - lo, np.uint8)
            shared[1:] = all_common[lo + 1 : hi][::-1]
            shared[0] = following if following is not None else pair(last, int(some[0])) if last is not None else 0
            following = int(all_common[lo])
            emit(some, shared)
            scan(some, shared)
        end = begin
