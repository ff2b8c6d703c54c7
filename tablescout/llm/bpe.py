"""BPE encoding and decoding by tree concatenation.

A text is cut into leaves of LEAF characters wherever these end, all leaves are
encoded at once, and halves are joined level by level: the text in a window
around the cut is encoded anew, and the window grows until what it has at its
ends is exactly what both halves have there.  Within a leaf, ASCII white space
separates pieces, which the tokenizer drops and no token spans; the equal pieces
of a step are numbered and encoded once, many in one string.  An unbroken piece of over PIECE characters is a
tree of its own, joined token by token: there a sequence of tokens is the BPE
encoding if each pair of neighbours, encoded alone, stays that pair."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from tablescout.llm.common import give_back, returning

#: Characters of a leaf of a text, and of an unbroken piece that is encoded at once.
LEAF, PIECE = 2048, 512
#: Characters whose pieces are encoded together, pieces that are encoded as one string, texts whose leaves are joined together, and ids that are handed over together.
STEP, STRING, JOINED, HANDED = 1 << 20, 500, 64, 200_000


_SPACES = b" \t\n\v\f\r"
_SPACE, _LETTER = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (_SPACES, bytes([*range(65, 91), *range(97, 123)])))
#: The first byte of U+00C0 to U+00FF, and the second ones of those that are no letters.
_LATIN, _SIGNS = 0xC3, (0x97, 0xB7)


def latin(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words in UTF-8, which bytes are of letters up to U+00FF, and the words with these in lower case."""
    first = (data == _LATIN) & ~np.isin(np.concatenate((data[1:], data[:1])), _SIGNS)
    second = np.concatenate((first[-1:], first[:-1]))
    upper = (data >= 65) & (data <= 90) | second & (data <= 0x9E)
    return _LETTER[data] | first | second, data + (upper * np.uint8(32))


def supported(spec: dict) -> bool:
    """Whether a tokenizer's file is of the kind that this module encodes: BPE
    with word ends over byte-level pre-tokens that hold no white space, lower
    case, NFC, special tokens as they stand, decoded by joining with spaces."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = cut.get("pretokenizers", [])
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    split = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and "\\s" in str(steps[0]["pattern"]) and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    marks = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    return bool(plain and split and marks and kinds == ["NFC", "Replace", "Lowercase"] and spec.get("decoder") is None and spec.get("post_processor") is None)


@lru_cache(maxsize=4)
def described(path: str) -> tuple[str, dict[str, int], int]:
    """Of a tokenizer's file: how words end, special tokens, and the number of ids; an error if it isn't `supported`."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not supported(spec):
        raise ValueError(f"{path}: not a tokenizer that tree concatenation is written for")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return spec["model"]["end_of_word_suffix"], special, 1 + max([*spec["model"]["vocab"].values(), *special.values()])


def separator(special: dict[str, int]) -> str | None:
    """A special token that stays whole, and makes no other one, whatever stands on its two sides."""
    for m in special:
        if not any(s != m and (m in s or s in m) or any(m.startswith(s[k:]) for k in range(1, len(s))) or any(s.startswith(m[k:]) for k in range(1, len(m))) for s in special):
            return m
    return None


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of flat[start : start + size], one behind the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Strings that lie one behind the other in data."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass
class Half:
    """A part of a text: the numbers of its pieces, and whether it starts and ends within a piece."""

    pieces: list[int]
    opens: bool
    ends: bool


class Pieces:
    """The pieces of a step: those of its leaves, each kind once, and what joins
    add.  A piece's ids lie in `flat`; size -1: not encoded, long and unbroken."""

    def __init__(self, texts: pa.LargeBinaryArray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.texts, self.flat, self.starts, self.sizes = texts, flat, starts, sizes
        self.clear()

    def clear(self) -> None:
        """Forgets what joins have added."""
        self.more: list[tuple[bytes, tuple[int, ...] | None]] = []

    def text(self, k: int) -> bytes:
        return self.texts[k].as_py() if k < len(self.texts) else self.more[k - len(self.texts)][0]

    def ids(self, k: int) -> tuple[int, ...] | None:
        if k >= len(self.texts):
            return self.more[k - len(self.texts)][1]
        return tuple(self.flat[self.starts[k] : self.starts[k] + self.sizes[k]].tolist()) if self.sizes[k] >= 0 else None

    def add(self, text: bytes, ids: tuple[int, ...] | None) -> int:
        self.more.append((text, ids))
        return len(self.texts) + len(self.more) - 1

    def ids_open(self, k: int) -> bool:
        return self.sizes[k] < 0 if k < len(self.texts) else self.more[k - len(self.texts)][1] is None

    def all_ids(self, pieces: np.ndarray, long) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece given how many ids it has, and all ids; long(text) has those of pieces that aren't encoded."""
        own, number = pieces < len(self.texts), pieces - len(self.texts)
        at = np.where(own, pieces, 0)
        starts, sizes = self.starts[at], self.sizes[at]
        left = set(number[~own].tolist())  # others went into larger ones
        added = [() if j not in left else long(text) if ids is None else ids for j, (text, ids) in enumerate(self.more)]
        for k in np.unique(pieces[own & (sizes < 0)]).tolist():
            number[pieces == k] = len(added)
            added.append(long(self.text(k)))
        count = np.array(list(map(len, added)), np.int64)
        begin, made = len(self.flat) + np.cumsum(count) - count, number >= 0
        starts[made], sizes[made] = begin[number[made]], count[number[made]]
        flat = np.concatenate((self.flat, np.fromiter((i for ids in added for i in ids), np.int32)))
        return sizes, ragged(flat, starts, sizes)


class TreeBPE:
    """Encodes and decodes exactly as the tokenizer in `path`; raises an error if that isn't `supported`."""

    def __init__(self, path: str, leaf: int = LEAF, piece: int = PIECE):
        self.suffix, self.special, size = described(path)
        self.path, self.leaf, self.piece, self.joins, self.tokenizer = path, leaf, piece, 0, Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.final = Tokenizer(self.tokenizer.model)  # text that ends a word; of the same tables
        self.words = Tokenizer(self.tokenizer.model)  # words of letters
        self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.between = separator(self.special)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        # the text of a token, and that of its id, a space behind
        self.digits, self.names = (pa.array([f"{x} ".encode() for x in kind], pa.large_binary()) for kind in (range(size), names))
        self.ending, self.parting = np.array([x.endswith(self.suffix) for x in names]), np.array([x == self.between for x in names])
        self.marks = {m.encode(): self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,;:!?"}

    @cached_property
    def middle(self) -> Tokenizer:
        """For text that goes on."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return Tokenizer(BPE(vocab=model["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]))

    # -- unbroken pieces

    def _plain(self, texts: list[str], final: bool) -> list[list[str]]:
        return [e.tokens for e in (self.final if final else self.middle).encode_batch(texts, add_special_tokens=False)]

    def _text(self, token: str, final: bool) -> str:
        return token[: -len(self.suffix)] if final and token.endswith(self.suffix) else token

    def _agree(self, a: str, b: str, final: bool) -> bool:
        return self._plain([a + self._text(b, final)], final)[0] == [a, b]

    def join(self, left: list[str], right: list[str], final: bool) -> list[str]:
        """Tokens of both texts together; final: the right one ends the word."""
        if not left or not right:
            return left or right
        width = 1
        while True:
            i, j = min(width, len(left)), min(width, len(right))
            ends = final and j == len(right)
            tail = right[:j]
            text = "".join(left[len(left) - i :]) + "".join(tail[:-1]) + self._text(tail[-1], ends)
            new = self._plain([text], ends)[0]
            before, after = left[: len(left) - i], right[j:]
            if (not before or self._agree(before[-1], new[0], ends and len(new) == 1)) and (not after or self._agree(new[-1], after[0], final and len(after) == 1)):
                return before + new + after
            width *= 2

    def tree(self, text: str) -> list[str]:
        """Tokens of one pre-token of any length."""
        parts = [text[i : i + self.piece] for i in range(0, len(text), self.piece)]
        level = self._plain(parts[:-1], False) + self._plain(parts[-1:], True)
        while len(level) > 1:
            pairs = [(level[k], level[k + 1] if k + 1 < len(level) else [], k + 2 >= len(level)) for k in range(0, len(level), 2)]
            level = [self.join(*p) for p in pairs]
        return level[0]

    def long(self, text: str) -> list[str]:
        """Tokens of a long piece without white space."""
        out: list[str] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                part = self.tokenizer.normalizer.normalize_str(part)
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    out += self.tree(word) if len(word) > self.piece else self._plain([word], True)[0]
        return out

    # -- texts

    def _together(self, tokenizer: Tokenizer, between: bytes, pieces: list[bytes], closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has; STRING pieces are encoded as one string, in which ids that are `closing` close each."""
        flat, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for lo in range(0, len(pieces), STRING):  # one after the other: the library's results are many times as large as ids
            part = pieces[lo : lo + STRING]
            got = np.array(tokenizer.encode_batch_fast([(between.join(part) + between).decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(closing[got])
            if len(ends) != len(part) or ends[-1] != len(got) - 1:
                raise RuntimeError("pieces encoded together came out in another number")
            flat.append(got)
            sizes.append(np.diff(ends, prepend=-1))
        return np.concatenate(flat), np.concatenate(sizes)

    def _encoded(self, texts: pa.LargeBinaryArray) -> Pieces:
        """Pieces, each kind once.  Letters up to U+00FF, with or without one mark
        behind, need no normalising or cutting: lower-cased, they are one pre-token."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        size = np.diff(offsets)
        letter, lower = latin(data)
        letters = np.concatenate(([0], np.cumsum(letter)))
        letters = letters[offsets[1:]] - letters[offsets[:-1]]
        last = data[offsets[1:] - 1] if len(texts) else data[:0]
        short = size <= self.piece
        marked = short & (size > 1) & (letters == size - 1) & np.isin(last, np.frombuffer(b"".join(self.marks), np.uint8))
        plain = short & (letters == size)
        other = np.flatnonzero(short & ~plain & ~marked)
        # words of letters, with marks as words of their own
        word = np.flatnonzero(plain | marked)
        width = size[word] - marked[word]
        cores = binaries(ragged(lower, offsets[word], width), width).dictionary_encode()
        flat, sizes = self._together(self.words, b" ", cores.dictionary.to_pylist(), self.ending)
        starts = np.cumsum(sizes) - sizes
        core = np.full(len(texts), -1)
        core[word] = cores.indices.to_numpy()
        begin, count = np.zeros(len(texts), np.int64), np.where(short, 0, -1)
        begin[plain], count[plain] = starts[core[plain]], sizes[core[plain]]
        flats, held = [flat], len(flat)

        def put(where: np.ndarray, ids: np.ndarray, sizes: np.ndarray, room: np.ndarray | int = 0) -> None:
            """room: ids behind each piece that aren't its own."""
            nonlocal held
            begin[where], count[where] = held + np.cumsum(sizes) - sizes, sizes - room
            flats.append(ids)
            held += len(ids)

        for m, ids in self.marks.items():
            where = np.flatnonzero(marked & (last == m[0]))
            n, end = sizes[core[where]], np.full((len(where), 1), len(flat))
            both = np.concatenate((starts[core[where]][:, None], end), 1).reshape(-1), np.concatenate((n[:, None], np.full((len(where), 1), len(ids))), 1).reshape(-1)
            put(where, ragged(np.concatenate((flat, np.array(ids, np.int32))), *both), n + len(ids))
        alone = texts.take(pa.array(other)).to_pylist()
        if self.between:
            free = np.ones(len(alone), bool)
            special = [x.encode() for x in self.special]
            if any(x in b" ".join(alone) for x in special):
                free[:] = [not any(x in w for x in special) for w in alone]
            put(other[free], *self._together(self.tokenizer, self.between.encode(), [w for w, f in zip(alone, free.tolist(), strict=True) if f], self.parting), 1)
            alone, other = [w for w, f in zip(alone, free.tolist(), strict=True) if not f], other[~free]
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in alone], add_special_tokens=False)]
        put(other, np.array([i for ids in got for i in ids], np.int32), np.array(list(map(len, got)), np.int64))
        return Pieces(texts, np.concatenate(flats), begin, count)

    def encode_ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        step, size = [], 0
        for text in texts:
            step.append(text)
            size += len(text)
            if size > STEP:
                yield from self._step(step)
                step, size = [], 0
        yield from self._step(step)

    def encode_many(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of tokens, ids and tokens, joined by spaces (the decoded text)."""
        for ids in self.encode_ids(texts):
            yield len(ids), *(x.decode() for x in self.written(ids))

    def written(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Ids, and tokens, joined by spaces."""
        if not len(ids):
            return b"", b""
        digits, names = (kind.take(pa.array(ids)) for kind in (self.digits, self.names))
        return tuple(x.buffers()[2].to_pybytes()[: x.buffers()[1].size and int(np.frombuffer(x.buffers()[1], np.int64)[len(ids)]) - 1] for x in (digits, names))

    def _step(self, texts: list[str]) -> Iterator[np.ndarray]:
        leaves = [text[i : i + self.leaf].encode("utf-8", "surrogatepass") for text in texts for i in range(0, len(text), self.leaf)]
        many = [-(-len(text) // self.leaf) for text in texts]
        sides = [(t[0] not in _SPACES, t[-1] not in _SPACES) for t in leaves]
        places = np.cumsum([0, *(len(t) + 1 for t in leaves)])
        data = np.frombuffer(b" ".join(leaves), np.uint8)
        del leaves
        inside = ~_SPACE[data]
        edges = np.diff(inside.view(np.int8), prepend=0, append=0)
        starts = np.flatnonzero(edges == 1)
        words = binaries(data[inside], np.flatnonzero(edges == -1) - starts).dictionary_encode()
        cuts = np.searchsorted(starts, places).tolist()
        del data, inside, edges, starts, places
        pieces, number = self._encoded(words.dictionary), words.indices.to_numpy()
        leaf = 0
        for lo in range(0, len(many), JOINED):
            group = []
            for n in many[lo : lo + JOINED]:
                group.append([Half(number[cuts[k] : cuts[k + 1]].tolist(), *sides[k]) for k in range(leaf, leaf + n)])
                leaf += n
            yield from self._joined(group, pieces)
            pieces.clear()

    def _joined(self, group: list[list[Half]], pieces: Pieces) -> Iterator[np.ndarray]:
        """The ids of each text, given its leaves."""
        while any(len(halves) > 1 for halves in group):
            pairs = [(halves[k], halves[k + 1]) for halves in group for k in range(0, len(halves) - 1, 2)]
            joined = iter(self.concatenated(pairs, pieces))
            group = [[next(joined) if k + 1 < len(halves) else halves[k] for k in range(0, len(halves), 2)] for halves in group]
        every = [np.array(h.pieces, np.int64) for halves in group for h in (halves or [Half([], False, False)])]
        counts, ids = pieces.all_ids(np.concatenate(every), self._long_ids)
        bounds = np.concatenate(([0], np.cumsum(counts)))[np.cumsum([0, *map(len, every)])].tolist()
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            yield ids[lo:hi]

    def _long_ids(self, piece: bytes) -> tuple[int, ...]:
        return tuple([self.tokenizer.token_to_id(t) for t in self.long(piece.decode("utf-8", "surrogatepass"))])

    def concatenated(self, pairs: list[tuple[Half, Half]], pieces: Pieces) -> list[Half]:
        """Each pair as one half.  All windows that are still open are encoded together; each is a piece then."""
        out: list[Half | None] = [None] * len(pairs)
        todo = []
        for k, (a, b) in enumerate(pairs):
            inside = a.ends and b.opens and bool(a.pieces) and bool(b.pieces)
            if not a.pieces or not b.pieces:
                out[k] = Half(a.pieces + b.pieces, a.opens, b.ends)
                continue
            left, right = pieces.text(a.pieces[-1]), pieces.text(b.pieces[0])
            unknown = pieces.ids_open(a.pieces[-1]) or pieces.ids_open(b.pieces[0])
            if inside and (unknown or len(left) + len(right) > self.piece and b" " not in left and b" " not in right):
                out[k] = Half([*a.pieces[:-1], pieces.add(left + right, None), *b.pieces[1:]], a.opens, b.ends)
            elif unknown:
                out[k] = Half(a.pieces + b.pieces, a.opens, b.ends)
            else:
                todo.append((k, inside, 1))
        while todo:
            windows = []
            for k, inside, width in todo:
                a, b = pairs[k]
                left, right = self._edge(a.pieces[: -width - 1 : -1], pieces)[::-1], self._edge(b.pieces[:width], pieces)
                windows.append((left, right, b" ".join(map(pieces.text, left)) + (b"" if inside else b" ") + b" ".join(map(pieces.text, right))))
            encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for _, _, w in windows], add_special_tokens=False)
            again = []
            for (k, inside, width), (left, right, text), e in zip(todo, windows, encoded, strict=True):
                (a, b), ids = pairs[k], tuple(e.ids)
                i, j = len(left), len(right)
                before, after = pieces.ids(left[0]), pieces.ids(right[-1])
                # the outermost pieces must come out as in the halves, unless a half or a long piece ends there
                fine = (i < width or (i > 1 or not inside) and ids[: len(before)] == before) and (j < width or (j > 1 or not inside) and ids[len(ids) - len(after) :] == after)
                if fine:
                    self.joins += 1
                    out[k] = Half([*a.pieces[: len(a.pieces) - i], pieces.add(text, ids), *b.pieces[j:]], a.opens, b.ends)
                else:
                    again.append((k, inside, width * 2))
            todo = again
        return out

    @staticmethod
    def _edge(numbers: list[int], pieces: Pieces) -> list[int]:
        """The first pieces, as far as they are encoded."""
        n = 0
        while n < len(numbers) and not pieces.ids_open(numbers[n]):
            n += 1
        return numbers[:n]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, with_ids: bool = True, with_decoded: bool | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by spaces),
    decoded_sha256 and, with_ids, ids (array<int>) and, with_decoded (if not
    given, as with_ids), decoded; a row for each row.

    path: the tokenizer's file, at the same place on every executor; None: the
    installed public one.  Null texts are empty; an empty text has no tokens
    and decodes to an empty text.  Ids may be null or repeat.  Other columns of
    docs are not looked at."""
    with_decoded = with_ids if with_decoded is None else with_decoded
    wanted = [True] * 4 + [with_ids, with_decoded]
    columns = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string()), ("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())]
    names, kinds, types = zip(*[c for c, w in zip(columns, wanted, strict=True) if w], strict=True)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeBPE(path or default_path(), leaf)  # of this task: Spark keeps workers, whose tables would add up
        give_back()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                rows, held = [], 0
                for doc, numbers in zip(part.column(0).to_pylist(), encoder.encode_ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    n, (ids, decoded) = len(numbers), encoder.written(numbers)
                    row = (doc, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), numbers, decoded.decode() if with_decoded else None)
                    rows.append(tuple([x for x, w in zip(row, wanted, strict=True) if w]))
                    held += n
                    if held > HANDED:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)
                rows, held = [], 0
                give_back()

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(returning(run), schema)
