"""Token counts by a tokenizer compiled into a finite-state transducer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import bytebpe

LIMIT = 1024
#: Characters of a chunk, and compiled states a worker keeps before it starts anew.
CHUNK, MOST_STATES = 16_384, 400_000

CONTRACTIONS = {"s": {""}, "t": {""}, "m": {""}, "d": {""}, "r": {"e"}, "v": {"e"}, "l": {"l"}}


class Kinds(dict):
    """char -> L (letter), N (number), O (other) or W (white space), as the library's own split has it: what does not part from one of a kind is of it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def __missing__(self, char: str) -> str:
        found = self[char] = next((kind for kind, one in (("L", "a"), ("N", "1"), ("O", "!")) if len(self.pieces(one + char)) == 1), "W")
        return found


class Pieces:
    """The merges as a deterministic automaton over bytes.

    A merged encoding is the one sequence whose neighbours would not merge differently by
    themselves, and every prefix of it is the encoding of its own bytes. So the last token of a
    prefix is its one suffix token that gets along with the last token of what is before.

    Whether two tokens get along depends on the left one only through its threats: the tokens
    that would merge onto some right-hand part of it before the merge that uses that part up. So
    a state holds, for each start that a later token may still reach back to (the bytes since
    then begin some token), those bytes, the threats that still fit them, and the count then
    relative to now: finitely many states. A transition's number is the change of the count.
    """

    def __init__(self, bpe: bytebpe.ByteBpe):
        never = len(bpe.merges)
        self.begin = {token[:n] for token in bpe.ids for n in range(1, len(token))}
        self.onto: dict[bytes, list[tuple[int, bytes]]] = {}
        for (x, y), rank in bpe.merges.items():
            self.onto.setdefault(x, []).append((rank, y))
        made = {x + y: (x, y, rank) for (x, y), rank in bpe.merges.items()}
        #: token -> its left-hand and right-hand parts with the rank of the merge that uses each up
        self.left: dict[bytes, dict[bytes, int]] = {}
        self.right: dict[bytes, dict[bytes, int]] = {}
        for token in sorted(bpe.ids, key=lambda t: made[t][2] if t in made else -1):
            self.left[token], self.right[token] = {token: never}, {token: never}
            if token in made:
                x, y, rank = made[token]
                self.left[token] |= {part: min(r, rank) for part, r in self.left[x].items()}
                self.right[token] |= {part: min(r, rank) for part, r in self.right[y].items()}
        self.of_token: dict[bytes, frozenset] = {}
        self.states: dict[tuple, PieceState] = {}
        self.start = self.state(((b"", frozenset(), 0),))

    def state(self, key: tuple) -> PieceState:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = PieceState(self, key)
        return found

    def threats(self, token: bytes) -> frozenset:
        """(token to the right, rank) of the merges that come before the use of the part they need."""
        found = self.of_token.get(token)
        if found is None:
            first: dict[bytes, int] = {}
            for part, used in self.right[token].items():
                for rank, y in self.onto.get(part, ()):
                    if rank < used and rank < first.get(y, rank + 1):
                        first[y] = rank
            found = self.of_token[token] = frozenset(first.items())
        return found

    def step(self, key: tuple, byte: bytes) -> tuple[tuple, int]:
        last = change = None
        reach = []
        for since, threats, count in key:
            grown = since + byte
            left = self.left.get(grown)
            if last is None and left is not None and not any(y in left and rank <= left[y] for y, rank in threats):
                last, change = grown, count + 1
            if grown in self.begin:
                if threats:
                    threats = frozenset(x for x in threats if x[0].startswith(grown) or grown.startswith(x[0]))
                reach.append((grown, threats, count))
        return (*((s, t, c - change) for s, t, c in reach), (b"", self.threats(last), 0)), change


class PieceState:
    """key: (bytes since the start, threats, count then minus now) of each start within reach."""

    __slots__ = ("key", "owner")

    def __init__(self, owner: Pieces, key: tuple):
        self.owner, self.key = owner, key

    def feed(self, text: str) -> tuple[PieceState, int]:
        key, count, step = self.key, 0, self.owner.step
        for byte in text.encode("utf-8", "surrogatepass"):
            key, change = step(key, bytes((byte,)))
            count += change
        return self.owner.state(key), count


class Transducer:
    """The split into pieces and the merges together, over characters.

    A state is (mode, state of the open piece, held-back characters). Modes: B nothing open; L, N
    and O a run of letters, numbers and others; W white space, its last character held back, as
    it may belong to the next piece; A an apostrophe that began a piece, then perhaps the first
    letter of a two-letter contraction. States and transitions are made when first met.
    """

    def __init__(self, bpe: bytebpe.ByteBpe, most: int = MOST_STATES):
        self.bpe, self.most, self.kinds = bpe, most, Kinds(bpe.path)
        self.reset()

    def reset(self) -> None:
        self.pieces = Pieces(self.bpe)
        self.states: dict[tuple, State] = {}
        self.begin = self.state("B", self.pieces.start, "")
        self.after_space = self.state("W", self.pieces.start, " ")

    def full(self) -> bool:
        return len(self.states) + len(self.pieces.states) > self.most

    def state(self, mode: str, piece: PieceState, held: str) -> State:
        key = (mode, id(piece), held)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, mode, piece, held)
        return found

    def opened(self, char: str, lead: str) -> tuple[State, int]:
        """A piece that begins with `lead` (a space or nothing) and `char`, which is no white space."""
        piece, count = self.pieces.start.feed(lead + char)
        return self.state("A" if char == "'" and not lead else self.kinds[char], piece, ""), count

    def step(self, state: State, char: str) -> tuple[State, int]:
        mode, piece, held, to = state.mode, state.piece, state.held, self.kinds[char]
        if mode == "W":
            if to == "W":
                piece, count = piece.feed(held)
                return self.state("W", piece, char), count
            if held == " ":
                return self.opened(char, " ")
            after, count = self.opened(char, "")
            return after, count + self.pieces.start.feed(held)[1]
        if mode == "A" and held:
            if char in CONTRACTIONS[held]:
                return self.begin, piece.feed(held + char)[1]
            letters, count = self.pieces.start.feed(held)
            after, more = self.step(self.state("L", letters, ""), char)
            return after, count + more
        if mode == "A" and char in CONTRACTIONS:
            if "" in CONTRACTIONS[char]:
                return self.begin, piece.feed(char)[1]
            return self.state("A", piece, char), 0
        if to == "W":
            return self.state("W", self.pieces.start, char), 0
        if to == mode or (mode == "A" and to == "O"):
            piece, count = piece.feed(char)
            return self.state(to, piece, ""), count
        return self.opened(char, "")

    def ending(self, state: State) -> int:
        """What the end of the text adds."""
        if state.mode == "W":
            return state.piece.feed(state.held)[1]
        return self.pieces.start.feed(state.held)[1] if state.held else 0


class State(dict):
    """char -> (next state, emitted tokens)."""

    __slots__ = ("owner", "mode", "piece", "held")

    def __init__(self, owner: Transducer, mode: str, piece: PieceState, held: str):
        self.owner, self.mode, self.piece, self.held = owner, mode, piece, held

    def __missing__(self, char: str) -> tuple[State, int]:
        found = self[char] = self.owner.step(self, char)
        return found

    def run(self, text: str) -> tuple[State, int]:
        state, count = self, 0
        for char in text:
            state, emitted = state[char]
            count += emitted
        return state, count


class Span:
    """A chunk as a map from the state before it to the state after it and the tokens emitted.

    Where the kind of characters changes, the state after the second one is the same whatever was
    before: it opens a piece (or, if a space, may belong to the next one). So the map is: read
    `head` from the given state, then add `count` and go to `state`. A chunk without such a place
    has only a head.
    """

    __slots__ = ("head", "count", "state")

    def __init__(self, head: str, count: int = 0, state: State | None = None):
        self.head, self.count, self.state = head, count, state

    @classmethod
    def of(cls, transducer: Transducer, chunk: str) -> Span:
        kinds = transducer.kinds
        for at in range(1, len(chunk)):
            a, b = chunk[at - 1], chunk[at]
            before, after = kinds[a], kinds[b]
            if before == after or before == "W" or a == "'":
                continue
            if b == " ":
                start = transducer.after_space
            elif after != "W":
                start = transducer.opened(b, "")[0]
            else:
                continue
            state, count = start.run(chunk[at + 1 :])
            return cls(chunk[: at + 1], count, state)
        return cls(chunk)

    def then(self, other: Span) -> Span:
        """Composition of the maps, which is associative."""
        if self.state is None:
            return Span(self.head + other.head, other.count, other.state)
        state, count = self.state.run(other.head)
        return Span(self.head, self.count + count + other.count, state if other.state is None else other.state)

    def apply(self, state: State) -> tuple[State, int]:
        after, count = state.run(self.head)
        return (after, count) if self.state is None else (self.state, count + self.count)


def prefix_scan(spans: list[Span]) -> list[Span]:
    """The composition of each prefix of `spans`: of neighbours, of the pairs' prefixes, then of those between; in each step all compositions are independent."""
    if len(spans) < 2:
        return list(spans)
    pairs = prefix_scan([a.then(b) for a, b in zip(spans[::2], spans[1::2], strict=False)])
    return [spans[0], *(pairs[i // 2] if i % 2 else pairs[i // 2 - 1].then(spans[i]) for i in range(1, len(spans)))]


class Counter:
    """Token counts of texts as the tokenizers library has them: special strings in a text are one token each."""

    def __init__(self, path: str, chunk: int = CHUNK, most: int = MOST_STATES):
        bpe = bytebpe.load(path)
        self.transducer, self.chunk, self.special = Transducer(bpe, most), chunk, bpe.special_split

    def spans(self, text: str) -> list[Span]:
        """Maps of the chunks; one without a place that fixes its state is read on from the map before it."""
        out: list[Span] = []
        heads: list[str] = []
        for i in range(0, len(text), self.chunk):
            span = Span.of(self.transducer, text[i : i + self.chunk])
            if span.state is None:
                if out:
                    out[-1] = out[-1].then(span)
                else:
                    heads.append(span.head)
            else:
                out.append(Span("".join(heads) + span.head, span.count, span.state))
                heads = []
        return out or [Span("".join(heads))]

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if self.transducer.full():
            self.transducer.reset()
        state, count = prefix_scan(self.spans(text))[-1].apply(self.transducer.begin)
        return count + self.transducer.ending(state)

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return sum(map(self.plain, parts)) + len(parts) - 1


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit.

    The tokenizer at `path` is compiled to a transducer whose transitions carry token counts; each
    text's chunks become state maps, which compose in any grouping. Null and empty texts have 0
    bytes and tokens; texts of any length are read whole; rows that repeat are counted alike; no
    rows give no rows; other columns are ignored. There is no shuffle, and a worker's compiled
    states are bounded: it starts anew beyond that bound, with the same results.
    """
    path = path or bytebpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            tokens = pa.array([count(text) for text in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("body"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
