"""Token ids of whole texts by the tokenizers library, cached per white-space delimited unit."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import worker_cache

# White space of the vocabularies' splitting pattern (the Unicode property), as fixed values.
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# No match of the splitting pattern crosses the border of such a unit, so units can be encoded one by one.
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
TOGETHER = 1 << 22  # bytes of texts that are encoded together
LONGEST = 64  # ids of a word that is kept beyond the limit of words


class Recent(dict):
    """A cache in two generations: once the young one holds ``limit`` entries it becomes the old one, whose entries come
    back as they are asked for again. So what is frequent stays, and at most about twice the limit is held."""

    limit = 250_000

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def age(self, limit: int) -> None:
        if len(self) > limit:
            self.old = dict(self)
            self.clear()


class Units(Recent):
    """Unit to its ids as little-endian unsigned 32-bit bytes."""

    def ids(self, text: str) -> bytes:
        self.age(self.limit)
        return b"".join(map(self.__getitem__, UNIT.findall(text)))


def irregular(piece: str) -> bool:
    """What lies between two blanks is empty or has white space at an end, so a blank is no border of units there."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` of these starts and lengths, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


class WordStore:
    """Ids of words in arrays: words are looked up many at a time, and one takes some 50 bytes."""

    def __init__(self):
        self.words, self.ids = pa.array([], pa.string()), np.empty(0, "<u4")
        self.lengths, self.used, self.turn = np.empty(0, np.int64), np.empty(0, np.int64), 0

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def rows(self, words: pa.Array, encode: Callable[[str], bytes], limit: int) -> np.ndarray:
        """Places of different words; new ones are encoded and added. Beyond ``limit`` the words that were not asked for of
        late are dropped first, and long ones."""
        self.turn += 1
        if len(self.words) > limit:
            self._keep((self.used >= np.partition(self.used, -(limit // 2))[-(limit // 2)]) & (self.lengths <= LONGEST))
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null().to_numpy(False)
        rows = found.fill_null(0).to_numpy().astype(np.int64)
        self.used[rows[~new]] = self.turn
        if new.any():
            rows[new] = len(self.words) + np.arange(int(new.sum()))
            added = words.filter(pa.array(new))
            ids = list(map(encode, added.to_pylist()))
            self.words = pa.concat_arrays([self.words, added])
            self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), "<u4"))
            self.lengths = np.append(self.lengths, np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
            self.used = np.append(self.used, np.full(len(ids), self.turn))
        return rows

    def _keep(self, kept: np.ndarray) -> None:
        self.ids = gathered(self.ids, self.starts[kept], self.lengths[kept])
        self.words = self.words.filter(pa.array(kept))
        self.lengths, self.used = self.lengths[kept], self.used[kept]


def byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write bytes as characters: printable ones as themselves, the others, in order, from 256
    on. Keys are the code points of a text whose bytes were read as Latin-1."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class LibraryUnits(Units):
    """Ids by a byte-level vocabulary of the tokenizers library.

    The library's model encodes each match of the splitting pattern once. A blank between two characters that are no white
    space begins a unit, so texts without other blanks are cut by a plain search for blanks, many texts at a time, and only
    different pieces are split into words. With ``encode_special_tokens`` (the library's
    name for it) added tokens in a text are ordinary text; without it, as the library does by default, they are cut out
    of the whole text first and what lies between is encoded.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, encode_special_tokens: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        whole = Tokenizer.from_file(path)
        if whole.normalizer is not None or "ByteLevel(add_prefix_space=False" not in repr(whole.pre_tokenizer):
            raise ValueError("units are independent for byte-level vocabularies without a normalizer only")
        self._split, self._model, self._words = regex.compile(pattern).findall, whole.model, Recent()
        self._store = WordStore()
        self._characters = byte_characters()
        self._added, self._added_ids = None, {}
        added = whole.get_added_tokens_decoder()
        if added and not encode_special_tokens:
            if any(t.lstrip or t.rstrip or t.single_word or t.normalized or not t.special for t in added.values()):
                raise ValueError("added tokens are matched as plain special strings only")
            self._added_ids = {t.content: struct.pack("<I", i) for i, t in added.items()}
            longest_first = sorted(self._added_ids, key=len, reverse=True)
            self._added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split

    def ids(self, text: str) -> bytes:
        return self.texts(pa.array([text], pa.string()))[0]

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts; a null text counts as empty. All are held at once, so the caller bounds them."""
        texts = texts.cast(pa.string()).fill_null("")
        added = {i for token in self._added_ids for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(False)).tolist()}
        if not added:
            return self.ordinary(texts)
        others = [i for i in range(len(texts)) if i not in added]
        out = dict(zip(others, self.ordinary(texts.take(pa.array(others, pa.int64()))), strict=True))
        for i in added:
            parts = self._added(texts[i].as_py())  # texts and added tokens by turns
            found = [b""] * len(parts)
            found[::2] = self.ordinary(pa.array(parts[::2], pa.string()))
            found[1::2] = [self._added_ids[token] for token in parts[1::2]]
            out[i] = b"".join(found)
        return [out[i] for i in range(len(texts))]

    def ordinary(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        begins = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()  # each text has a first piece, which may be empty
        flat = cut.flatten()
        firsts = flat.take(pa.array(begins)).to_pylist()
        after = np.ones(len(flat), bool)
        after[begins] = False
        coded = flat.filter(pa.array(after)).dictionary_encode()
        pieces = listed(coded.dictionary)
        odd = np.fromiter(map(irregular, pieces), bool, len(pieces))
        codes = np.empty(len(flat), np.int64)
        codes[after] = coded.indices.to_numpy()
        codes[begins] = len(pieces) + np.arange(len(texts))
        sizes = np.diff(np.append(begins, len(flat)))
        del cut, flat, after, coded
        plain = np.array([f != "" and f[-1].isspace() for f in firsts])
        if odd.any():
            plain |= np.logical_or.reduceat(np.append(odd, np.zeros(len(texts), bool))[codes], begins)
        rows = np.flatnonzero(plain).tolist()
        heads = [b"" if skip else self.plain_ids(first) for first, skip in zip(firsts, plain.tolist(), strict=True)]
        ids, lengths = self._pieces(pieces, odd)
        ids = np.append(ids, np.frombuffer(b"".join(heads), "<u4"))
        lengths = np.append(lengths, [len(h) // 4 for h in heads])
        starts = np.cumsum(lengths) - lengths
        if rows:  # their texts are encoded on their own
            codes = np.where(np.repeat(plain, sizes), len(lengths), codes)
            lengths, starts = np.append(lengths, 0), np.append(starts, 0)
        each = lengths[codes]
        data = gathered(ids, starts[codes], each).tobytes()
        borders = (4 * np.append(0, np.cumsum(np.add.reduceat(each, begins)))).tolist()
        out = [data[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
        for i in rows:
            out[i] = self.plain_ids(texts[i].as_py())
        return out

    def _pieces(self, pieces: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, each with a blank before it, one after the other, and their numbers; odd pieces have none.

        One search finds the words of all pieces, as no word crosses a blank that stands alone.
        """
        lengths = np.zeros(len(pieces), np.int64)
        regular = [p for p, skip in zip(pieces, odd.tolist(), strict=True) if not skip] if odd.any() else pieces
        if not regular:
            return np.empty(0, "<u4"), lengths
        coded = pa.array(self._split(" " + " ".join(regular)), pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        starts = np.flatnonzero(pc.starts_with(coded.dictionary, " ").to_numpy(False)[codes])  # a piece has only that blank
        rows = self._store.rows(coded.dictionary, self._tokenized, 2 * self.limit)[codes]
        lengths[~odd] = np.add.reduceat(self._store.lengths[rows], starts)
        return gathered(self._store.ids, self._store.starts[rows], self._store.lengths[rows]), lengths

    def plain_ids(self, text: str) -> bytes:
        return super().ids(text)

    def encoded(self, unit: str) -> bytes:
        words = self._split(unit)
        if len(words) == 1:  # kept as a unit, so not as a word too
            return self._tokenized(words[0])
        self._words.age(self.limit)
        return b"".join([self._words.get(w) or self._word(w) for w in words])

    def __missing__(self, unit: str) -> bytes:
        value = self[unit] = self.old.get(unit) or self.encoded(unit)
        return value

    def _word(self, word: str) -> bytes:
        value = self._words[word] = self._words.old.get(word) or self._tokenized(word)
        return value

    def _tokenized(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            word = word.replace(" ", self._characters[0x20])  # the only one of them not written as itself
        else:
            word = word.encode().decode("latin-1").translate(self._characters)
        found = [t.id for t in self._model.tokenize(word)]
        return struct.pack(f"<{len(found)}I", *found)


def library_units(path: str, encode_special_tokens: bool = True) -> LibraryUnits:
    name = f"units:{path}:{encode_special_tokens}"
    return worker_cache(name, lambda: LibraryUnits(path, encode_special_tokens=encode_special_tokens))


def listed(pieces: pa.Array) -> list[str]:
    """Strings without blanks as a list, by way of one long string."""
    if not len(pieces):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return pc.binary_join(one, " ")[0].as_py().split(" ")


def encoded_rows(batches: Iterator[pa.RecordBatch], units: LibraryUnits) -> Iterator[tuple[list, list[bytes]]]:
    """Ids of documents and the token ids of their texts (first and second column), about ``TOGETHER`` bytes of texts at a
    time."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            held = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, held + TOGETHER, "right")))
            part = batch.slice(start, stop - start)
            yield part.column(0).to_pylist(), units.texts(part.column(1))
            start = stop
