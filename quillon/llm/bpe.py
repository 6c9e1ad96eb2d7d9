"""Byte-pair encoding and decoding as streaming transducers.

`Encoder.feed` takes text in pieces of any size and gives the token ids that
no later text can change; `finish` gives the rest.  A word of the splitting
pattern is final once the text goes on HOLD characters past it.  Its bytes go
through `ByteStream`, which keeps, for every position, the last token of the
prefix that ends there: it is the one token whose pair with the token before it
the merges leave alone.  The merge list bounds what a later byte can change: no
merge makes a token of more than LOOKAHEAD bytes (the longest sum of two parts
over all merges), so any later token begins within the last LOOKAHEAD
positions.  A boundary that all parses alive in that window share is final, and
everything before it is emitted and forgotten.  Memory does not grow with the
text.  What the automaton and the merges have answered once is kept with the
state or token asked, in tables of bounded size.

Words met before come from a memo of bounded size.  The new words of several
texts go through the transducer in order, so that each goes on from where it
leaves the one before: what the transducer has at a position depends on the
bytes up to there alone.

`Decoder` turns ids back into text through a UTF-8 state machine that keeps at
most three pending bytes and puts U+FFFD for each maximal broken part.

Null and empty texts encode to no token and decode to the empty text.  Very long
texts go through in pieces; repeated rows get equal values.  An empty table
gives an empty result.  Only doc_id, text and the columns kept are read,
whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import json
import re
import weakref
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain
from operator import getitem, itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_type, map_rows

#: Fixed values of byte-level BPE: the split pattern and the printable bytes that stand for themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+"""
#: Characters with which LATIN might split otherwise: underscores, superscripts, fractions, separators, and all beyond Latin letters.
BEYOND = "[_\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]"
PRINTABLE = (*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1))

CHUNK = 1 << 16
#: Characters of the texts whose words are looked up together.
GROUP = 1 << 19
#: Words that the memo holds, and their bytes at most.
CACHED, CACHED_BYTES = 3 << 15, 128
#: Moves by way of shorter states that the automaton keeps, and answers whether two tokens stay apart.
MOVES, ANSWERS = 1 << 18, 1 << 18


def content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, to its byte: other bytes take letters from U+0100 on, in order."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """Vocabulary and merges of a tokenizers file, given by its path or as its bytes; share: the memo holds that part of its words, and of texts looked up together."""

    def __init__(self, source: str | bytes, share: float = 1):
        self.cached, self.group = int(CACHED * share), int(GROUP * share)
        data = json.loads(source if isinstance(source, bytes) else content(source))
        letters, vocabulary = byte_letters(), data["model"]["vocab"]
        as_bytes = str.maketrans({c: chr(b) for c, b in letters.items()})
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for word, i in vocabulary.items():
            if word not in self.special:
                self.bytes_of[i] = word.translate(as_bytes).encode("latin-1")
        self.single = [vocabulary[c] for c in sorted(letters, key=letters.get)]
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        #: By token, both tokens of the merge that makes it, and its rank; -1: no merge does.
        self.parts, self.rank_of = (array("i", [-1]) * size, array("i", [-1]) * size), array("i", [-1]) * size
        self.unclear: set[int] = set()
        #: How far back a later token can reach: the longest that a merge makes.
        self.lookahead = 1
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merges[x, y] = rank
            self.made.append(made)
            # a token that two merges make, or that one makes before its parts, has no single derivation
            if self.rank_of[made] >= 0 or any(i in self.unclear or len(part) > 1 and self.rank_of[i] < 0 for i, part in ((x, a), (y, b))):
                self.unclear.add(made)
            self.parts[0][made], self.parts[1][made], self.rank_of[made] = x, y, rank
            self.lookahead = max(self.lookahead, len(a) + len(b))
        self.none = len(self.made)
        self.hold = max([16, *(len(s) + 3 for s in self.special)])
        self.any_split, self.latin_split, self.beyond = regex.compile(PATTERN), re.compile(LATIN), re.compile(BEYOND)
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.root = self.automaton([*self.single, *self.made])
        self.words = Words(self)
        self.names = [str(i) for i in range(size)]
        #: Tokens met, with what apart() has said of them and those after them, and how many answers there are.
        self.afters: dict[int, After] = {}
        self.answers = 0
        self.before_all = self.after(-1)

    def automaton(self, tokens: list[int]) -> State:
        """A state for each beginning of a token, with its moves by byte; returns that of the empty beginning."""
        kept = [0]
        root = State(kept)
        for token in tokens:
            state = root
            for byte in self.bytes_of[token]:
                to = state.get(byte)
                if to is None:
                    to = state[byte] = State(kept)
                state = to
            state.ends = ((token, len(self.bytes_of[token])),)
        todo = [root]
        for state in todo:  # by length, so that shorter beginnings are done
            for byte, to in state.items():
                todo.append(to)
                to.fall = root if state is root else state.fall.along(byte)
                to.ends += to.fall.ends
        return root

    def merge(self, data: bytes) -> list[int]:
        """The merges applied lowest rank first, leftmost first."""
        ids = [self.single[b] for b in data]
        merges, none = self.merges, self.none
        ranks = [merges.get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = (self.made[best],)
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), none)
        return ids

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at the token's first (side 0) or last (side 1) byte while the merges make it, each with the rank of the merge that ends it."""
        known, ends = [], self.none
        while token >= 0:
            known.append((token, ends))
            token, ends = self.parts[side][token], self.rank_of[token]
        known.reverse()
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave the two tokens as they are, side by side; a < 0: b alone.

        Merges come in the order of their ranks, the leftmost first, so it is enough to follow what stands on either side of the
        boundary and to see whether a merge over it comes before the one that ends either side.
        """
        before, after = self.after(a), self.after(b)
        if a < 0 or not after.whole:
            return after.whole
        if before.unclear or after.unclear:
            return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        left, right, i, j, none, merges = before.right, after.left, 0, 0, self.none, self.merges
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            over = merges.get((x, y), none)
            if over < none and over < x_ends and over <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == none:
                    return True
                i += 1
            else:
                j += 1

    def after(self, token: int) -> After:
        known = self.afters.get(token)
        if known is None:
            known = self.afters[token] = After(self, token)
        return known

    def split(self, text: str) -> list[str]:
        """The words of the pattern; Latin text takes a cheaper form of it that splits such text alike."""
        return (self.any_split if self.beyond.search(text) else self.latin_split).findall(text)

    def ids(self, words: list[str]) -> list[int]:
        return self.all_ids([words])[0]

    def all_ids(self, texts: list[list[str]]) -> list[list[int]]:
        """Ids of several texts, each given as its words."""
        self.words.learn(chain.from_iterable(texts))
        ids = [list(chain.from_iterable(map(self.words.__getitem__, words))) for words in texts]
        self.words.shrink()
        return ids


class Words(dict):
    """Ids of words already met; what is met again soon outlives the others when the table is full."""

    def __init__(self, model: Model):
        self.model, self.old = weakref.proxy(model), {}  # no cycle: a task's tables go when it ends

    def learn(self, words: Iterable[str]) -> None:
        new, in_order = set(words).difference(self), InOrder(self.model)
        for word in sorted(new):  # the order of the code points is that of the bytes
            ids = self.old.get(word)
            if ids is None:
                data = word.encode("utf-8", "surrogatepass")
                if len(data) > CACHED_BYTES:
                    continue
                ids = tuple(in_order.word(data))
            self[word] = ids

    def __missing__(self, word: str) -> list[int]:
        """Of words that are too long to keep."""
        stream = ByteStream(self.model)
        return stream.feed(word.encode("utf-8", "surrogatepass")) + stream.finish()

    def shrink(self) -> None:
        if len(self) >= self.model.cached:
            self.old = dict(self)
            self.clear()


class State(dict):
    """A beginning of a token: by byte the beginning that is reached, the longest other one that ends it, and the tokens that end it with their sizes, the longest first."""

    __slots__ = ("ends", "fall", "kept")

    def __init__(self, kept: list[int]):
        self.kept, self.fall, self.ends = kept, None, ()  # kept: how many moves by way of shorter states all states have

    def along(self, byte: int) -> State:
        state = self
        while (to := state.get(byte)) is None:  # single bytes are tokens, so the empty beginning has a move
            state = state.fall
        return to

    def __missing__(self, byte: int) -> State:
        to = self.fall.along(byte)
        if self.kept[0] < MOVES:
            self.kept[0] += 1
            self[byte] = to
        return to


class After(dict):
    """A token, and what the merges say of each token after it: that one's After if they leave both as they are, else None."""

    __slots__ = ("left", "model", "right", "size", "token", "unclear", "whole")

    def __init__(self, model: Model, token: int):
        data = model.bytes_of[token] if token >= 0 else b""
        self.model, self.token, self.size, self.unclear = model, token, len(data), token in model.unclear
        self.left, self.right = (model.edge(token, side) for side in (0, 1))
        self.whole = model.merge(data) == [token]  # whether the merges make the token of its own bytes

    def __missing__(self, token: int) -> After | None:
        model = self.model
        if model.answers >= ANSWERS:
            model.answers = 0
            for row in model.afters.values():
                row.clear()
        model.answers += 1
        known = self[token] = model.afters[token] if model.apart(self.token, token) else None
        return known


class Dead(dict):
    """Stands where no parse ends."""

    __slots__ = ()

    def __missing__(self, token: int) -> None:
        return None


DEAD = Dead()


def follow(state: State, data: bytes, last: list[After]) -> list[State]:
    """The states after each of the bytes, the given one before them; adds to last the last token of each prefix that ends there."""
    states = list(accumulate(data, getitem, initial=state))
    add = last.append
    for state in states[1:]:
        for token, size in state.ends:
            if (row := last[-size][token]) is not None:
                add(row)
                break
        else:
            add(DEAD)
    return states


def traced(last: list[After], upto: int) -> list[int]:
    """The ids of the parse that ends at a position."""
    ids = []
    while upto:
        row = last[upto]
        ids.append(row.token)
        upto -= row.size
    ids.reverse()
    return ids


class InOrder:
    """The transducer over whole words in order: of each only what comes after the beginning shared with the one before."""

    def __init__(self, model: Model):
        self.data, self.states, self.last = b"", [model.root], [model.before_all]

    def word(self, data: bytes) -> list[int]:
        same = 0
        for a, b in zip(self.data, data):
            if a != b:
                break
            same += 1
        del self.last[same + 1 :]  # the first is what stands before the word
        self.states[same:] = follow(self.states[same], data[same:], self.last)
        self.data = data
        return traced(self.last, len(data))


class ByteStream:
    """The transducer inside one word: bytes in, stable ids out."""

    def __init__(self, model: Model):
        self.model = model
        self.last = [model.before_all]  # from the last final boundary on: last token of the prefix that ends at each position, DEAD: no parse; the first is the token before the boundary
        self.state = model.root

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        ahead = self.model.lookahead
        for at in range(0, len(data), ahead):
            self.state = follow(self.state, data[at : at + ahead], self.last)[-1]
            if len(self.last) > 4 * ahead and (stable := self.stable()):
                out += self.emit(stable)
        return out

    def stable(self) -> int:
        """The last boundary that all parses alive in the lookahead share; 0: none."""
        n, last = len(self.last) - 1, self.last
        alive = {p for p in range(max(1, n - self.model.lookahead + 1), n + 1) if last[p] is not DEAD}
        while len(alive) > 1:
            p = max(alive)
            alive.remove(p)
            alive.add(p - last[p].size if p else 0)
            if 0 in alive:
                return 0
        return alive.pop()

    def emit(self, upto: int) -> list[int]:
        ids = traced(self.last, upto)
        del self.last[:upto]
        return ids

    def finish(self) -> list[int]:
        return self.emit(len(self.last) - 1)


class Encoder:
    """Text in pieces to ids."""

    #: Kinds of words that can go on for ever, with what one more character of each is.
    RUNS = tuple(regex.compile(p) for p in (r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+", r"\s+"))
    MORE = tuple(regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*"))

    def __init__(self, model: Model):
        self.model, self.rest = model, ""
        self.run: tuple[int, ByteStream] | None = None

    def feed(self, text: str, last: bool = False) -> list[int]:
        self.rest += text
        out: list[int] = []
        if self.model.special_split is not None and any(s in self.rest for s in self.model.special):
            *parts, self.rest = self.model.special_split.split(self.rest)
            for i, part in enumerate(parts):
                if i % 2:
                    out.append(self.model.special[part])
                else:
                    out += self.plain(part, True)
        if last:
            part, self.rest = self.rest, ""
            return out + self.plain(part, True)
        keep = max(0, len(self.rest) - self.model.hold)
        part, held = self.rest[:keep], self.rest[keep:]
        return out + self.plain(part, False, held)

    def plain(self, text: str, last: bool, held: str = "") -> list[int]:
        """Ids of the words of text that are final; what is not goes to self.rest, before held."""
        out: list[int] = []
        if self.run is not None:
            kind, stream = self.run
            whole = text + held
            end = self.MORE[kind].match(whole).end()
            if end < len(whole) or last:
                if kind == 3 and end < len(whole):
                    end -= 1  # the last space of a run goes with what follows
                    if end < 0:
                        raise AssertionError("a run of spaces holds one back")
                out += stream.feed(whole[:end].encode("utf-8", "surrogatepass"))
                out += stream.finish()
                self.run = None
                text, held = (whole[end:], "") if last else (whole[end : max(end, len(text))], whole[max(end, len(text)) :])
            else:
                stop = max(0, min(end, len(text)))
                out += stream.feed(text[:stop].encode("utf-8", "surrogatepass"))
                self.rest = held if not last else self.rest
                return out
        if last:
            return out + self.model.ids(self.model.split(text))
        words = self.model.split(text + held)
        tail = 0
        while words and tail < len(held):
            tail += len(words.pop())
        whole = text + held
        begin = len(whole) - tail
        out += self.model.ids(words)
        self.rest = whole[begin:]
        if len(self.rest) > 4 * CHUNK:  # one word, still open: its bytes go on to the transducer
            for kind, run in enumerate(self.RUNS):
                m = run.match(self.rest)
                if m and m.end() == len(self.rest):
                    stream = ByteStream(self.model)
                    stop = len(self.rest) - self.model.hold
                    out += stream.feed(self.rest[:stop].encode("utf-8", "surrogatepass"))
                    self.run, self.rest = (kind, stream), self.rest[stop:]
                    break
        return out

    def finish(self) -> list[int]:
        return self.feed("", True)


def utf8_machine() -> tuple[bytes, list[list[int]]]:
    """Byte classes and moves: state 0 is between characters, 1 broken, the others wait for continuation bytes."""
    names = ["done", "broken", "one", "two", "three", "after_e0", "after_ed", "after_f0", "after_f4"]
    at = {n: i for i, n in enumerate(names)}
    moves = [[1] * 256 for _ in names]
    for first, last, to in ((0, 0x7F, "done"), (0xC2, 0xDF, "one"), (0xE0, 0xE0, "after_e0"), (0xE1, 0xEC, "two"), (0xED, 0xED, "after_ed"), (0xEE, 0xEF, "two"), (0xF0, 0xF0, "after_f0"), (0xF1, 0xF3, "three"), (0xF4, 0xF4, "after_f4")):
        for b in range(first, last + 1):
            moves[0][b] = at[to]
    for state, first, last, to in (("one", 0x80, 0xBF, "done"), ("two", 0x80, 0xBF, "one"), ("three", 0x80, 0xBF, "two"), ("after_e0", 0xA0, 0xBF, "one"), ("after_ed", 0x80, 0x9F, "one"), ("after_f0", 0x90, 0xBF, "two"), ("after_f4", 0x80, 0x8F, "two")):
        for b in range(first, last + 1):
            moves[at[state]][b] = at[to]
    return names, moves


def picked(values: list, at: list[int]) -> tuple:
    """The values at each of the positions."""
    return itemgetter(*at)(values) if len(at) > 1 else tuple(values[i] for i in at)


class Decoder:
    """Ids in pieces to text."""

    NAMES, MOVES = utf8_machine()

    def __init__(self, model: Model):
        self.model, self.state, self.pending = model, 0, bytearray()

    def feed(self, ids: list[int]) -> str:
        data = b"".join(picked(self.model.bytes_of, ids))
        if self.state == 0:
            try:
                return data.decode("utf-8")  # the machine would stay on its good paths and end between characters
            except UnicodeDecodeError:
                pass
        out, moves = [], self.MOVES
        for b in data:
            to = moves[self.state][b]
            if to == 1:
                if self.state:
                    out.append("�")
                    self.pending.clear()
                    to = moves[0][b]
                if to == 1:
                    out.append("�")
                    self.state = 0
                    continue
            self.pending.append(b)
            self.state = to
            if to == 0:
                out.append(self.pending.decode("utf-8"))
                self.pending.clear()
        return "".join(out)

    def finish(self) -> str:
        rest = "�" if self.state else ""
        self.state = 0
        self.pending.clear()
        return rest


def encode(model: Model, text: str | None) -> list[int]:
    if not text:
        return []
    encoder = Encoder(model)
    ids: list[int] = []
    for i in range(0, len(text), CHUNK):
        ids += encoder.feed(text[i : i + CHUNK]) if i + CHUNK < len(text) else encoder.feed(text[i:], True)
    return ids


def encode_all(model: Model, texts: Iterable[str | None]) -> Iterator[list[int]]:
    """Ids of each text; the words of short ones without special tokens are looked up together."""
    waiting: list[list[str]] = []
    size = 0
    for text in texts:
        text = text or ""
        alone = len(text) > CHUNK or any(s in text for s in model.special)
        if alone or size + len(text) > model.group:
            yield from model.all_ids(waiting)
            waiting, size = [], 0
        if alone:
            yield encode(model, text)
        else:
            waiting.append(model.split(text))
            size += len(text)
    yield from model.all_ids(waiting)


def decode(model: Model, ids: list[int]) -> str:
    decoder = Decoder(model)
    return "".join(decoder.feed(ids[i : i + 4096]) for i in range(0, len(ids), 4096)) + decoder.finish()


def round_trip(documents: DataFrame, vocabulary: str, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and the ids, and string columns kept) of every document; vocabulary: a tokenizers file, read here and sent to the executors."""
    shipped = documents.sparkSession.sparkContext.broadcast(content(vocabulary))

    def make():
        model = Model(shipped.value, 1 / 6 if with_ids else 1)  # rows with ids are long, and in the pipeline executors have little memory left

        def rows(doc_ids, texts, *rest):
            for doc_id, ids, *kept in zip(doc_ids, encode_all(model, texts), *rest):
                back = decode(model, ids)
                said = hashlib.sha256(",".join(picked(model.names, ids)).encode()).hexdigest()
                out = (doc_id, len(ids), said, hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                yield (*out, ids, *kept) if with_ids else (*out, *kept)

        return rows

    kind, arrow = id_type(documents)
    fields = [("doc_id", arrow), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    fields += [(c, pa.string()) for c in keep]
    ddl += "".join(f", {c} string" for c in keep)
    return map_rows(documents, ["doc_id", "text", *keep], make, fields, ddl, together=True)
