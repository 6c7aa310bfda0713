"""Token ids of whole texts with the vocabulary files of public tokenizers, for code inside tasks."""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

# in Python these four are white space, for the tokenizers they are not
_ODD = re.compile("[\x1c-\x1f]")
# White space beyond ASCII: a text that has some is cut by `_PIECES` instead of `_cuts`.
_FAR_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Cuts that no token crosses: before one white space that a word follows, and around longer runs.
# The patterns of both vocabularies match inside these pieces what they match in the whole text.
_PIECES = re.compile(r"\s+(?=\s\S)|[ \n]?\S+|\s+")
# letters from U+00C0 to U+023F without the two signs among them and U+0130, which is lowered to a letter and a mark
_WORD = re.compile(
    rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])+"
)
_WHITE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[33:127] = _MARK
_KIND[list(b" \t\n\v\f\r")] = _WHITE
_KIND[list(b"0123456789")] = _DIGIT
# the lead bytes of those letters, and the bytes that follow a lead
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _LETTER

# the public byte alphabet: printable bytes stand for themselves, the others for letters from 256 on
_LETTERS = np.arange(256, dtype="<u2")
_HIDDEN = [b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)}]
_LETTERS[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
# between words that are asked together
_LETTERS[ord("\n")] = ord("\n")
_TOGETHER = 200
# bytes of texts that are cut at once
_AT_ONCE = 8 << 20


def _cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin, the texts being UTF-8 bytes one after the other from `starts` on.

    Besides the cuts of `_PIECES`: before a line break's word and wherever letters, digits and
    marks meet, except between an apostrophe and letters. Runs with characters that are neither
    ASCII nor the letters of `_WORD` stay whole.
    """
    kind = _KIND[raw]
    lead, next_ = raw[:-1], raw[1:]
    signs = (lead == 0xC3) & ((next_ == 0x97) | (next_ == 0xB7)) | (lead == 0xC4) & (next_ == 0xB0)
    kind[:-1][signs] = _OTHER
    white = kind == _WHITE
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[starts] = True
    ends, begins = begins[1:], begins[:-1]
    cut = np.ones(len(raw), dtype=bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut[1:] &= ~((lead == ord("'")) & (kind[1:] == _LETTER))
    other = kind == _OTHER
    if other.any():
        run = begins.copy()
        run[1:] |= white[1:] != white[:-1]
        number = np.cumsum(run, dtype=np.int32)
        whole = np.zeros(len(raw) + 1, dtype=bool)
        whole[number[other]] = True
        cut &= run | ~whole[number]
    cut[1:] &= (lead != ord(" ")) | white[1:]
    # the last white space of a run goes with what follows it
    cut[:-1] |= white[:-1] & ~white[1:] & ~ends[:-1]
    return np.flatnonzero(cut | begins)


class PieceEncoder:
    """Encodes texts piece by piece and remembers the ids of pieces in two generations.

    Texts are cut and their pieces made distinct many at a time, in numpy and Arrow. Words recur,
    so a dictionary hit replaces most of the merging. When the young generation holds `remember`
    pieces it becomes the old one, and the old one goes; a piece that is met again moves back.
    `words_only` is for vocabularies that drop white space.
    """

    def __init__(self, vocabulary: str, words_only: bool, remember: int = 100_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._words_only = words_only
        self._remember = remember
        #: ids fit in two bytes
        self.width = vocabulary_width(vocabulary)
        self._type = np.dtype(f"<u{self.width}")
        # the same model without normalising and pattern, for words in the byte alphabet
        self._bare = Tokenizer(self._tokenizer.model)
        self._bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        ids = self._tokenizer.get_vocab()
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None) or ""
        self._bytes = np.zeros(max(ids.values(), default=0) + 1, dtype=np.int64)
        for token, number in ids.items():
            self._bytes[number] = len(token.removesuffix(suffix))
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self._type).tobytes() for e in found]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of Latin letters, each with at most a space before it.

        Such a word is one unit for the tokenizer's pattern, so its model can be asked without it:
        normalising lowers words, and the byte alphabet is applied here. Many words are one call;
        tokens spell out their words, so the bytes they stand for say where a word ends.
        """
        asked = [b"\n".join(words[at : at + _TOGETHER]) for at in range(0, len(words), _TOGETHER)]
        if self._words_only:
            # normalising lowers letter by letter
            asked = [a.replace(b" ", b"").decode().lower().encode() for a in asked]
        spelled = [_LETTERS[np.frombuffer(a, dtype=np.uint8)].tobytes().decode("utf-16-le") for a in asked]
        found = self._bare.encode_batch_fast(spelled, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=self._type) for e in found])
        spoken = np.cumsum(self._bytes[ids])
        wanted = np.cumsum([len(w) for a in asked for w in a.split(b"\n")])
        last = np.searchsorted(spoken, wanted)
        if not len(spoken) or spoken[-1] != wanted[-1] or (spoken[last] != wanted).any():
            # no alphabet of bytes
            return self._plain([w.decode() for w in words])
        raw, ends = ids.tobytes(), ((last + 1) * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self._young.get, pieces))
        if None not in found:
            return found
        missing = [n for n, ids in enumerate(found) if ids is None]
        words, others = [], []
        for n in missing:
            found[n] = self._old.get(pieces[n])
            if found[n] is None:
                (words if _WORD.fullmatch(pieces[n]) else others).append(n)
        for numbers, encode in ((words, self._words), (others, lambda some: self._plain([p.decode() for p in some]))):
            if numbers:
                for n, ids in zip(numbers, encode([pieces[n] for n in numbers])):
                    found[n] = ids
        if len(self._young) + len(missing) > self._remember:
            self._old, self._young = self._young, dict(zip(pieces, found))
        else:
            self._young.update((pieces[n], found[n]) for n in missing)
        return found

    def _portion(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens."""
        column = pa.array(texts, pa.string())
        far = np.zeros(len(texts), dtype=bool)
        if not self._words_only:
            far = pc.match_substring_regex(column, _FAR_SPACE).to_numpy(zero_copy_only=False)
        near = column.filter(pa.array(~far))
        sizes = pc.binary_length(near).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        raw = np.frombuffer(b"" if not starts[-1] else near.buffers()[2], dtype=np.uint8)[: starts[-1]]
        cuts = np.append(_cuts(raw, starts), len(raw)) if len(raw) else np.zeros(1, dtype=np.int64)
        layout = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)]
        pieces = [pa.Array.from_buffers(pa.binary(), len(cuts) - 1, layout)]
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~far] = np.diff(np.searchsorted(cuts, starts))
        order = [*np.flatnonzero(~far)]
        for n in np.flatnonzero(far):
            cut = [p.encode() for p in _PIECES.findall(texts[n])]
            counts[n] = len(cut)
            pieces.append(pa.array(cut, pa.binary()))
            order.append(n)
        coded = pa.concat_arrays(pieces).dictionary_encode()
        flat = pa.array(self._ids(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        bounds = ends[np.concatenate([[0], np.cumsum(counts[order])])].tolist()
        payload = memoryview(flat.buffers()[2] or b"")
        found = [b""] * len(texts)
        for n, low, high in zip(order, bounds, bounds[1:]):
            found[n] = bytes(payload[low:high])
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of `width` bytes; null counts as empty."""
        found = [b""] * len(texts)
        held, size = [], 0

        def take():
            for n, ids in zip(held, self._portion([texts[n] for n in held])):
                found[n] = ids

        for n, text in enumerate(texts):
            if not text:
                continue
            if _ODD.search(text) or any(s in text for s in self._special):
                found[n] = self._plain([text])[0]
                continue
            if held and size + len(text) > _AT_ONCE:
                take()
                held, size = [], 0
            held.append(n)
            size += len(text)
        if held:
            take()
        return found

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def shared_encoder(vocabulary: str, words_only: bool) -> PieceEncoder:
    """One encoder for all tasks that a Python worker runs."""
    key = (vocabulary, words_only)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(vocabulary, words_only)
    return _ENCODERS[key]


def vocabulary_path(name: str) -> str:
    """A path as it is, or a name among the installed vocabularies."""
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def vocabulary_width(vocabulary: str) -> int:
    """Bytes of an id."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(vocabulary_path(vocabulary)).get_vocab_size() <= 1 << 16 else 4
