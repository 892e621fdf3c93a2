"""Whole-text encoding with a public tokenizer whose pieces never cross white space."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the pattern of such a tokenizer ends: runs of letters, single numerals, runs of anything else but white space.
RUNS = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Punctuation that the tokenizer cuts from letters before it and keeps in one run; not the apostrophe.
TAILS = ".,;:!?#$%&*"


def _is_latin(text: str) -> bool:
    """Whether all letters are their own composed form, and lower case has the same length and is the same everywhere."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Encodes texts to ids, word by word through a bounded cache.

    Exact for tokenizers that drop white space and cut there before anything else (``word_bpe_49k.json``): the ids of a
    text are those of its words in turn. Only U+0020 and U+000A are cut here; words that hold other white space go to
    the library as they are. Arrow gives each word of a batch of texts its number, so that only the distinct ones of the
    batch are looked up, and numpy lays out their ids. The cache has two generations of ``cache_words`` / 2 words: when
    the young one is full it becomes the old one, from which words that occur again are taken over. Words over LONGEST
    characters aren't kept, so that text without spaces doesn't fill it: its size is bounded in bytes, too.
    """

    LONGEST = 48

    def __init__(self, path: str, cache_words: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._refuse_if_unfit(path)
        self.dtype = _narrowest(self.tokenizer)
        self.most = max(1, cache_words // 2)
        self.old: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.whole = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.bare = self._bare()

    def _refuse_if_unfit(self, path: str) -> None:
        """An error for a tokenizer that keeps white space in its ids, or whose pieces cross it."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        for text in (" ", "\n", " a", "a ", "the end", "a\nb", "of  the\n\nend. "):
            if ids(text) != [i for word in text.split() for i in ids(word)]:
                raise ValueError(f"{path} does not drop white space: texts can't be encoded word by word")

    def _bare(self) -> tuple | None:
        """What takes the place of normalizer and pattern for words that either leaves as they are: lower-case letters of
        Latin-1, or a tail. None if the tokenizer isn't of the kind that cuts runs of letters and of other marks."""
        from tokenizers import normalizers, pre_tokenizers

        rules = json.loads(self.tokenizer.to_str())
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or not steps[0]["pattern"].get("Regex", "").endswith(RUNS) or None in self.whole:
            return None
        cut = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        return normalizers.Sequence([]), pre_tokenizers.Sequence(cut)

    def _encoded(self, bare: bool, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, many at a time; words that would be taken for a separator, or hold one, by themselves.
        bare: without normalizer and pattern; one tokenizer does both, since its vocabulary is what takes memory."""
        if bare:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.bare
        try:
            return self._ids_of(bare, words)
        finally:
            if bare:
                self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.whole

    def _ids_of(self, bare: bool, words: list[str]) -> dict[str, bytes]:
        ids = lambda x: self.tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids
        found = {}
        if not bare:
            odd = [w for w in words if self.mark is None or "\x01" in w or "<|" in w or not w]
            found = {w: np.array(ids(w), self.dtype).tobytes() for w in odd}
            words = [w for w in words if w not in found] if odd else words
        size = np.dtype(self.dtype).itemsize
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            laid = np.array(ids(" \x01 ".join(part)), self.dtype)
            ends = (np.flatnonzero(laid == self.mark) * size).tolist()
            raw, start = laid.tobytes(), 0
            if len(ends) != len(part) - 1:
                raise ValueError("the separator is not a token of its own")
            for w, end in zip(part, [*ends, len(raw)], strict=True):
                found[w] = raw[start:end]
                start = end + size
        return found

    def _lookup(self, bare: bool, words: list[str]) -> list[bytes]:
        values = list(map(self.young.get, words))
        absent = [i for i, v in enumerate(values) if v is None]
        if absent:
            known = list(map(self.old.get, [words[i] for i in absent]))
            found = self._encoded(bare, [words[i] for i, v in zip(absent, known, strict=True) if v is None])
            for i, v in zip(absent, known, strict=True):
                w = words[i]
                values[i] = v = found[w] if v is None else v
                if len(w) <= self.LONGEST:
                    self.young[w] = v
            if len(self.young) > self.most:
                self.old, self.young = self.young, {}
        return values

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after another, and the number of each.

        Most words are letters of Latin-1 with a tail of punctuation: the lower-case letters and the tail are each looked
        up once, without normalizer and pattern.
        """
        values, units = [b""], np.zeros((len(words), 2), np.int64)
        simple = np.zeros(len(words), bool)
        if self.bare:
            stems = pc.utf8_rtrim(words, characters=TAILS)
            lows, lengths = pc.utf8_lower(stems), np.asarray(pc.binary_length(words))
            tail = lengths - np.asarray(pc.binary_length(stems))
            data, starts = _bytes(words)
            beyond = np.concatenate(([0], np.cumsum(data >= 0xC4)))  # first bytes of characters beyond Latin-1
            simple = np.asarray(pc.utf8_is_alpha(lows)) & (beyond[starts + lengths] == beyond[starts]) & (tail <= 8)
            own = lows.filter(pa.array(simple)).dictionary_encode()
            units[simple, 0] = np.asarray(own.indices) + len(values)
            values += self._lookup(True, own.dictionary.to_pylist())
            code, ends = np.zeros(len(words), np.uint64), starts + lengths
            for k in range(8):
                here = np.flatnonzero(simple & (tail > k))
                code[here] |= data[ends[here] - k - 1].astype(np.uint64) << np.uint64(8 * k)
            kinds, which = np.unique(code, return_inverse=True)
            tails = [int(x).to_bytes(8, "big").lstrip(b"\0").decode() for x in kinds]
            units[simple, 1] = (which + len(values))[simple]
            values += [self._lookup(True, [x])[0] if x else b"" for x in tails]
        units[~simple, 0] = np.arange(len(values), len(values) + int((~simple).sum()))
        values += self._lookup(False, words.filter(pa.array(~simple)).to_pylist())
        ids = np.frombuffer(b"".join(values), self.dtype)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // ids.itemsize
        return laid_out(ids, sizes, units.ravel()), sizes[units].sum(axis=1)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each text's followed by end_id if there is one; the number of each.
        A null counts as empty. The ids are of type dtype, or wide enough for end_id."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        flat = split.flatten().dictionary_encode()
        ids, sizes = self._words(flat.dictionary)
        which = np.asarray(flat.indices)
        bounds = np.concatenate(([0], np.cumsum(sizes[which])))
        counts = np.diff(np.concatenate(([0], bounds[np.cumsum(np.asarray(pc.list_value_length(split)))])))
        laid = laid_out(ids, sizes, which)
        if end_id is not None:
            if end_id >> 8 * laid.itemsize:
                laid = laid.astype("<u4")
            laid, counts = np.insert(laid, np.cumsum(counts), end_id), counts + 1
        return laid, counts

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


def laid_out(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """The runs of ids of the given numbers one after another; run i has sizes[i] ids. By blocks, to bound the indices."""
    starts, out = np.cumsum(sizes) - sizes, [ids[:0]]
    for at in range(0, len(which), block):
        some = which[at : at + block]
        n = sizes[some]
        out.append(ids[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
    return np.concatenate(out)


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each string starts."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1].astype(np.int64)


def slices(texts: pa.Array, max_bytes: int = 3 << 20, max_rows: int = 8192) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of rows with at most max_bytes bytes of text, or one row with more."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + max_rows, int(np.searchsorted(ends, before + max_bytes, side="right"))))
        yield at, stop - at
        at = stop


def id_type(path: str, *ids: int) -> str:
    """The narrower of "<u2" and "<u4" that holds all ids of a tokenizer and those given."""
    from tokenizers import Tokenizer

    return _narrowest(Tokenizer.from_file(path), *ids)


def _narrowest(tokenizer, *ids: int) -> str:
    most = max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
    return "<u2" if max(most, *ids, 0) < 1 << 16 else "<u4"


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process: its cache outlives a task."""
    return WordEncoder(path)
