"""Token counts by a deterministic finite-state transducer that is compiled from a merge list.

After any prefix of a word, one token ends there in the encoding of that prefix; a further token fits after it exactly
if the two, encoded together, stay as they are. So the encoding of the prefix that is one symbol longer follows from the
tokens that end at the last few positions: those at which a token that is still open may have begun. A state is that
list, with the token counts at its positions less the count at the first; there are finitely many, since tokens are
bounded. A transition is annotated with the number of tokens emitted, by which the count at the first position grows,
and the last symbol of a word emits the rest. States are compiled when a text first asks for them and kept up to a bound.

A stretch of symbols maps each state before it to the state after it and the tokens emitted between. Such maps compose, so a
text is cut into chunks whose maps are made each for itself, and a prefix scan composes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

from .bpe import LongWord, Memo, MergeTable, WordTokenizer, load

#: Symbols of a word's last byte are numbered from here, as they differ from others.
LAST = 256
#: Chunks whose maps are composed at a time.
GROUP = 64
#: States that are kept before they are compiled anew.
STATES = 120_000
#: Bytes of what short words gave that are kept (see Memo).
REMEMBERED = 40 << 20
#: The state before a word: no token is open.
START = (b"", ((-1, 0),))


class State(dict):
    """Transitions by symbol: for a byte the next state and the tokens emitted, for a last byte the tokens emitted.

    open: the longest end of the prefix with which some token begins. ends: for each position from the start of open on,
    the token that ends there (-1: none, a word's start) and how many tokens more than at the first position.
    """

    __slots__ = ("machine", "open", "ends")

    def __init__(self, machine: Transducer, open_: bytes, ends: tuple[tuple[int, int], ...]) -> None:
        self.machine, self.open, self.ends = machine, open_, ends

    @property
    def key(self) -> Key:
        return self.open, self.ends

    def __missing__(self, symbol: int):  # noqa: ANN204
        self[symbol] = found = self.machine.step(self, symbol)
        return found


class Transducer:
    def __init__(self, table: MergeTable, states: int = STATES) -> None:
        self.table, self.most = table, states
        same = table.base == table.final
        self.inner: dict[bytes, int] = {}  # tokens by their bytes, within a word and at its end
        self.outer: dict[bytes, int] = self.inner if same else {}
        made = {*table.made, *table.base, *table.final}
        for token in made:
            whole = self._alone(token)
            if whole is not None:
                (self.outer if whole else self.inner)[table.bytes[token]] = token
        self.starts = {t[:k] for t in (*self.inner, *self.outer) for k in range(1, len(t))}
        self.reset()

    def _alone(self, token: int) -> bool | None:
        """Whether a token ends a word, if its own bytes give it back; None for a token that no text gives."""
        raw, table = self.table.bytes[token], self.table
        inner = [table.base[b] for b in raw]
        if table.merge([*inner]) == [token]:
            return False
        return True if table.merge([*inner[:-1], table.final[raw[-1]]]) == [token] else None

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.pairs: dict[int, bool] = {}
        self.points: dict[tuple[int, int], tuple[int, int]] = {}  # so that states share them
        self.start = self.state(START)

    def state(self, key: Key) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, *key)
        return found

    def fits(self, first: int, second: int, last: bool) -> bool:
        """Whether the two tokens stay as they are beside each other; last: the second ends the word."""
        key = (first << 22 | second) << 1 | last
        found = self.pairs.get(key)
        if found is None:
            table = self.table
            symbols = [table.base[b] for b in table.bytes[first] + table.bytes[second]]
            if last:
                symbols[-1] = table.final[table.bytes[second][-1]]
            found = self.pairs[key] = table.merge(symbols) == [first, second]
        return found

    def step(self, state: State, symbol: int):  # noqa: ANN201
        last = symbol >= LAST
        text = state.open + bytes([symbol - LAST if last else symbol])
        tokens = self.outer if last else self.inner
        for at in range(len(text)):  # where the token that ends now begins; one alone fits
            token = tokens.get(text[at:])
            if token is not None and ((before := state.ends[at])[0] < 0 or self.fits(before[0], token, last)):
                count = before[1] + 1
                break
        else:
            raise AssertionError("a single byte is a token, so some token ends here")
        if last:
            return count
        cut = next((k for k in range(len(text)) if text[k:] in self.starts), len(text))
        ends = (*state.ends, (token, count))[cut:]
        gone = ends[0][1]
        return self.state((text[cut:], tuple(self.points.setdefault(x, x) for x in [(t, n - gone) for t, n in ends]))), gone

    def run(self, state: State, raw: bytes) -> tuple[State, int]:
        """The state after some bytes within a word, and the tokens emitted."""
        n = 0
        for b in raw:
            state, emitted = state[b]
            n += emitted
        return state, n

    def end(self, state: State, last: int) -> int:
        """The tokens emitted by a word's last byte."""
        return state[LAST + last]

    def count(self, word: bytes) -> int:
        """Tokens of a word."""
        state, n = self.run(self.start, word[:-1])
        return n + state[LAST + word[-1]]


class Chunk(NamedTuple):
    """A stretch of the symbols of a text: head continues a word that began before, and ends it if head_ends; then whole
    words; then tail, the beginning of a word that goes on behind. Special strings are counted apart."""

    words: list[str]
    head: bytes = b""
    head_ends: bool = False
    tail: bytes = b""
    special: int = 0


#: The state of a transducer, told apart from others by its values, so that maps of any process fit together.
Key = tuple[bytes, tuple[tuple[int, int], ...]]
#: What a chunk does: from the state before it to the state after it and the tokens emitted between.
StateMap = dict[Key, tuple[Key, int]]


def compose(a: StateMap, b: StateMap) -> StateMap:
    """The map of a and then b; associative. b must have the states that a can end in."""
    return {s: (b[e][0], n + b[e][1]) for s, (e, n) in a.items()}


def scan(maps: list[StateMap]) -> list[StateMap]:
    """The maps of all prefixes. Each round composes neighbours a distance apart, which doubles: a round's compositions don't
    depend on each other, and there are as many rounds as the logarithm of the number of maps."""
    maps, apart = list(maps), 1
    while apart < len(maps):
        maps = maps[:apart] + [compose(maps[i - apart], maps[i]) for i in range(apart, len(maps))]
        apart *= 2
    return maps


class Counter:
    """Counts the tokens of texts. A text is cut into chunks, whose state maps are composed by a prefix scan.

    The last symbol of a word brings the transducer to its start, so a chunk that begins with a word has a map from that one
    state. A chunk that a long word is cut for gets a map from the state that the bytes before the cut lead to, whatever
    stood before these; where the state turns out to be another, the map gets that one, too.
    remember: what short words gave is kept and not worked out again.
    """

    def __init__(self, tokenizer: WordTokenizer, remember: bool = True) -> None:
        self.tokenizer, self.machine = tokenizer, Transducer(tokenizer.table)
        self._memo: Memo | None = Memo(self._word, REMEMBERED) if remember else None
        self.look = 2 * tokenizer.table.longest

    def _word(self, word: str) -> int:
        return self.machine.count(word.encode("utf-8", "surrogateescape"))

    def chunks(self, text: str) -> Iterator[Chunk]:
        for piece, special in self.tokenizer.pieces(text):
            if special is not None:
                yield Chunk([], special=1)
                continue
            for words in self.tokenizer.words(piece):
                if not isinstance(words, LongWord):
                    yield Chunk(words)
                    continue
                parts = words.pieces()  # two at least
                yield Chunk([], tail=next(parts))
                held = next(parts)
                for part in parts:
                    yield Chunk([], head=held)
                    held = part
                yield Chunk([], head=held, head_ends=True)

    def extend(self, found: StateMap, chunk: Chunk, before: Key) -> None:
        """Puts into the map of a chunk what it does from a state."""
        machine = self.machine
        state, n = machine.state(before), chunk.special
        if chunk.head:
            if not chunk.head_ends:
                state, more = machine.run(state, chunk.head)
                found[before] = state.key, n + more
                return
            state, more = machine.run(state, chunk.head[:-1])
            n += more + machine.end(state, chunk.head[-1])
        elif before != START:
            raise ValueError("a word goes on, but the chunk does not continue one")
        n += sum(map(self._word if self._memo is None else self._memo.__getitem__, chunk.words))
        state, more = machine.run(machine.start, chunk.tail)
        found[before] = state.key, n + more

    def maps(self, chunks: list[Chunk], before: Key) -> list[StateMap]:
        """The state maps of chunks that follow each other, each with all states that those before it can end in."""
        out: list[StateMap] = [{} for _ in chunks]
        for i, chunk in enumerate(chunks):  # each for itself
            if not i:
                self.extend(out[i], chunk, before)
            elif not chunk.head:
                self.extend(out[i], chunk, START)
            else:
                seen = (chunks[i - 1].tail or chunks[i - 1].head)[-self.look :]
                self.extend(out[i], chunk, self.machine.run(self.machine.start, seen)[0].key)
        missing = True
        while missing:
            missing = False
            for i in range(1, len(chunks)):
                for after, _ in list(out[i - 1].values()):
                    if after not in out[i]:
                        self.extend(out[i], chunks[i], after)
                        missing = True
        return out

    def count(self, text: str | None) -> int:
        machine = self.machine
        if len(machine.states) > machine.most:
            machine.reset()
        total, state, chunks = 0, START, self.chunks(text or "")
        while group := list(islice(chunks, GROUP)):
            state, n = scan(self.maps(group, state))[-1][state]
            total += n
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """The counter of a tokenizer file, once a Python worker."""
    return Counter(load(path))
