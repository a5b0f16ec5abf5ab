"""Token ids of whole texts through the tokenizers library, one library call for each distinct unit.

A text is cut where the library's own splitting cannot depend on what stands
on the other side, each distinct unit is encoded once by the library and the
texts' ids are put together from the units' ids.
"""

from __future__ import annotations

import array
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import islice, repeat
from operator import methodcaller

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import HELD, slices

#: Units longer than this many characters are not kept in a cache.
LONG_UNIT = 64
#: Marks that are one word for the library where nothing but such marks follows letters.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
#: New units that go to the library as one text.
TOGETHER = 1 << 14
SPACE_RUN = re.compile(r"\s ")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
BLANKS = re.compile(r"[ \n]+")


def spaced_units(text: str) -> list[str]:
    """Units for byte-level splitting, in which a single space belongs to the word after it.

    Cuts stand before each space that follows a non-space: there every
    pre-token ends, whatever follows.
    """
    if SPACE_RUN.search(text):
        return BEFORE_SPACE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def word_units(text: str) -> list[str]:
    """Units for splitting that drops white space: what stands between spaces and line feeds."""
    return BLANKS.split(text)


#: How tokenizer files of the two kinds split text into words.
BYTE_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOWER_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: What the two find in printable ASCII.
ASCII_BYTE_WORDS = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+| +(?![^ ])| +""")
ASCII_LOWER_WORDS = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^ A-Za-z0-9]+""")
#: Characters that such a file's normaliser changes in nothing but their case, one by one.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Ids of words by the library's model alone, as bytes; a word is what the file's pattern finds, so many units share one."""

    def __init__(self, model):
        self.model, self.letters = model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            shown = word.replace(" ", self.letters[32])  # each other such byte stands for itself
        else:
            shown = word.encode().decode("latin1").translate(self.letters)
        ids = self[word] = array.array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids


class UnitEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the library's for the whole text.

    A new unit goes word by word to the library's model where the file's kind is
    known and the unit is plain, and through the whole library otherwise. Units
    met lately are kept in two generations of at most ``most`` each, some 250 MB in all.
    """

    def __init__(self, path: str, units: Callable[[str], list[str]], most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.of_word = WordIds(self.library.model)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # a unit without any first character of an added token holds none
        first = {t["content"][0] for t in spec["added_tokens"]}
        self.added = re.compile(f"[{re.escape(''.join(sorted(first)))}]") if first else None
        self.tokens = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if first else None
        self.words, self.lower = self._kind(spec)
        self.ascii_words = ASCII_LOWER_WORDS if self.lower else ASCII_BYTE_WORDS
        self.marks_apart = self.words is not None and not self.lower and not any(c.isalpha() or c in MARKS for c in first)
        self.begins = None  # by id, whether the token begins with a space
        if self.words is not None and not self.lower:
            blank, vocab = byte_letters()[32], self.library.get_vocab(with_added_tokens=True)
            self.begins = np.zeros(1 + max(vocab.values()), bool)
            self.begins[[i for t, i in vocab.items() if t.startswith(blank)]] = True
        self.units, self.most = units, most
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _kind(spec: dict):
        """The word pattern, and whether text is lower-cased; no pattern for files of other kinds."""
        split, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if norm is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"):
            return regex.compile(BYTE_WORDS), False
        steps = [(x["type"], x.get("pattern", {}).get("Regex")) for x in split.get("pretokenizers", [])]
        if norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps == [("Split", LOWER_WORDS), ("ByteLevel", None)]:
            return regex.compile(LOWER_WORDS), True
        return None, False

    def _encode(self, unit: str) -> bytes:
        if self.words is None or self.added and self.added.search(unit) or self.lower and not PLAIN.fullmatch(unit):
            return array.array("I", self.library.encode(unit, add_special_tokens=False).ids).tobytes()
        text = unit.lower() if self.lower else unit
        if (text[1:] if text[:1] == " " else text).isalpha():
            return self.of_word[text]  # letters alone are one word
        words = self.ascii_words if text.isascii() and text.isprintable() else self.words
        return b"".join(map(self.of_word.__getitem__, words.findall(text)))

    def _plain(self, units: list[str]) -> bool:
        """Whether each unit begins with a space, holds no other, doesn't end with white space, and none holds an added token."""
        text = "".join(units)
        return self.begins is not None and {u[:1] for u in units} == {" "} and text.count(" ") == len(units) and not any(map(str.isspace, {u[-1] for u in units})) and not (self.tokens and self.tokens.search(text))

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of plain units encoded as one text: a word ends before each space, and only there does a token begin with one."""
        ids = np.array(self.library.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))

    def many(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The units in another order, their ids (uint32) one after the other and how many each has; plain units go to the library many at a time."""
        short, order, ids, sizes = [], [], [], []
        odd = [u for u in units if len(u) > LONG_UNIT or short.append(u)]
        for at in range(0, len(short), TOGETHER):
            own = short[at : at + TOGETHER]
            if not self._plain(own):
                odd += [u for u in own if not self._plain([u])]
                own = [u for u in own if self._plain([u])]
            if own:
                found = self._together(own)
                order += own
                ids.append(found[0])
                sizes.append(found[1])
        raw = [self._encode(u) for u in odd]
        ids.append(np.frombuffer(b"".join(raw), "<u4"))
        sizes.append(np.array([len(x) >> 2 for x in raw], np.int64))
        return order + odd, np.concatenate(ids), np.concatenate(sizes)

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids = self._encode(unit)
        if len(unit) <= LONG_UNIT:
            self[unit] = ids
        return ids

    def head(self, unit: str) -> bytes:
        """A text's first unit, which is kept as any other."""
        return self[unit]

    def __call__(self, texts: list[str]) -> list[bytes]:
        get, out = self.__getitem__, []
        for t in texts:
            if len(self) > self.most:
                self.older = dict(self)
                self.clear()
            if len(self.of_word) > self.most // 2:
                self.of_word.clear()
            out.append(b"".join(map(get, self.units(t))))
        return out


def encoder(path: str, units: Callable[[str], list[str]]) -> UnitEncoder:
    """One encoder for each tokenizer file in a Python worker, kept from task to task."""
    return HELD.of("tokens", (path, units.__name__), lambda: UnitEncoder(path, units))


def distinct(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the place of its value among the distinct ones, and these as objects."""
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)


def runs_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, so many as its size, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class SpacedTable(dict):
    """Ids of whole columns of texts by the units of ``spaced_units``: each slice's distinct pieces are looked up, and ids are put together as arrays.

    What stands behind a space is kept by its place in a table of ids; when the
    table holds ``most`` pieces, it begins anew with its first quarter. Texts with a space behind white
    space and each text's beginning go through the encoder.
    """

    def __init__(self, encode: UnitEncoder, most: int = 1_200_000):
        self.encode, self.most = encode, most
        self.ids, self.sizes = array.array("I"), array.array("I")

    def keep(self, n: int) -> None:
        """Drop all but the first ``n`` pieces, among which are the frequent ones."""
        names = list(islice(self, n))
        self.clear()
        self.update(zip(names, range(n), strict=True))
        del self.sizes[n:]
        del self.ids[sum(self.sizes) :]

    def places(self, names: np.ndarray) -> np.ndarray:
        """Places of distinct pieces in the table; new ones are encoded together."""
        found = np.fromiter(map(self.get, names, repeat(-1)), np.int64, len(names))
        unmet = found < 0
        if unmet.any():
            new = names[unmet]
            self.learn(new)
            found[unmet] = np.fromiter(map(self.__getitem__, new), np.int64, len(new))
        return found

    def learn(self, new: np.ndarray) -> None:
        """Encode new pieces. Of letters and marks behind them, two words to the library, the letters are looked up by themselves."""
        letters = np.array([x.rstrip(MARKS) for x in new], object)
        sizes = np.fromiter(map(len, letters), np.int64, len(new))
        marked = (sizes < np.fromiter(map(len, new), np.int64, len(new))) & np.fromiter(map(str.isalpha, letters), bool, len(new)) & self.encode.marks_apart
        letters, behind = letters[marked], new[marked]
        units, ids, own = self.encode.many([" " + x for x in {*new[~marked], *set(letters).difference(self)}])
        self.add([u[1:] for u in units], ids, own)
        if len(behind):
            tails = [x[n:] for x, n in zip(behind, sizes[marked].tolist(), strict=True)]
            raw = {t: self.encode._encode(t) for t in set(tails)}
            at = dict(zip(raw, range(len(self.sizes), len(self.sizes) + len(raw)), strict=True))
            own = np.concatenate([np.array(self.sizes, np.int64), np.array([len(x) >> 2 for x in raw.values()], np.int64)])
            starts, table = np.cumsum(own) - own, np.frombuffer(self.ids.tobytes() + b"".join(raw.values()), "<u4")
            both = np.stack([np.fromiter(map(m.__getitem__, x), np.int64, len(behind)) for m, x in ((self, letters), (at, tails))], axis=1)
            self.add(behind, table[runs_of(starts[both].ravel(), own[both].ravel())], own[both].sum(axis=1))

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.sizes)
        self.ids.frombytes(ids.tobytes())
        self.sizes.frombytes(sizes.astype("<u4").tobytes())
        self.update(zip(pieces, range(at, at + len(pieces)), strict=True))

    def __call__(self, column: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids (uint32), each text's followed by ``end``, and where each ends."""
        if len(self) > self.most:
            self.keep(self.most // 4)
        texts, n = column.fill_null(""), len(column)
        lists = pc.split_pattern(texts, " ")
        first = lists.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(first) - first
        codes, names = distinct(lists.flatten())
        row = np.zeros(len(codes), np.int64)
        row[first[1:]] = 1
        row = np.cumsum(row)
        begins, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        begins[first], last[first[1:] - 1], last[-1:] = True, True, True
        empty, blank = names == "", np.zeros(len(names), bool)
        for x in {x[-1:] for x in names}:
            if not x or x.isspace():
                blank |= np.fromiter(map(methodcaller("endswith", x), names), bool, len(names)) if x else empty
        apart = np.zeros(n, bool)  # texts with a space behind white space
        apart[row[blank[codes] & ~last & ~(begins & empty[codes])]] = True
        rest = ~begins & ~apart[row]
        used = np.zeros(len(names), bool)
        used[codes[rest]] = True
        place = np.zeros(len(names), np.int64)
        place[used] = self.places(names[used])
        heads = [self.encode([texts[k].as_py()])[0] if apart[k] else self.encode.head(names[codes[first[k]]]) for k in range(n)]
        own = np.array([len(x) >> 2 for x in heads], np.int64)
        table, sizes = np.frombuffer(self.ids.tobytes() + b"".join(heads), "<u4"), np.array(self.sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        taken = begins | rest
        at, begins = place[codes[taken]], begins[taken]
        starts, sizes = starts[at] if len(starts) else np.zeros(len(at), np.int64), sizes[at] if len(sizes) else np.zeros(len(at), np.int64)
        starts[begins], sizes[begins] = len(self.ids) + np.cumsum(own) - own, own
        ends = np.cumsum(np.bincount(row[taken], weights=sizes, minlength=n).astype(np.int64) + len(end))
        out, kept = np.empty(int(ends[-1]) if n else 0, "<u4"), np.ones(int(ends[-1]) if n else 0, bool)
        for k, x in enumerate(end):
            out[ends - len(end) + k], kept[ends - len(end) + k] = x, False
        out[kept] = table[runs_of(starts, sizes)]
        return out, ends


def spaced_table(path: str) -> SpacedTable:
    """One table for each tokenizer file in a Python worker, kept from task to task."""
    encode = encoder(path, spaced_units)
    return HELD.of("tokens", (path, "table"), lambda: SpacedTable(encode))


def encoded(batches: Iterator[pa.RecordBatch], encode: UnitEncoder, text_col: str, end_id: int | None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches with each text's ids (uint32), the end id appended."""
    end = b"" if end_id is None else array.array("I", [end_id]).tobytes()
    for batch in batches:
        for part in slices(batch, text_col):
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            yield part, [np.frombuffer(ids + end, "<u4") for ids in encode(texts)]
