"""Token ids of whole texts, by a public tokenizer file.

White space never enters a token of the word-level vocabulary used here, so the ids of a text
are the ids of its pieces between spaces and line feeds, one after another. Arrow tells the different pieces of a
chunk apart and puts their ids back in order; the tokenizers library sees each different piece of a chunk, and a bounded
memory of a worker spares it the commonest. Nothing that a worker holds grows with its input: the memory has a number
of pieces of a bounded length, pieces go to the library in short lists, and a very long text goes through in stretches.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ends each document.
END_ID = 2
#: Pieces that a worker remembers at most, and the longest piece remembered.
KEEP_PIECES, KEEP_CHARS = 200_000, 64
#: Characters handed to the library at once; bytes of text, and rows, that are encoded at once.
AT_ONCE, STRETCH, CHUNK_ROWS = 1 << 14, 1 << 22, 8192
#: Letters of words that are encoded in lower case and apart from marks after them, as pattern and one by one.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
EACH_LETTER = "".join(chr(c) for c in range(256) if re.match(f"[{LETTERS}]", chr(c)))
#: Marks that may follow a word.
MARKS = ".,;:!?|*%&$#)"
WORD = f"^[{LETTERS}]{{1,{KEEP_CHARS}}}[{re.escape(MARKS)}]{{0,{KEEP_CHARS}}}$"
#: Where a very long piece can be cut: no token goes from a digit, comma or semicolon on to a letter or digit.
_SEAM = re.compile("(?<=[0-9,;])(?=[A-Za-z0-9])")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """Ids of the pieces of the chunk before, as words that are common come in every chunk."""

    def __init__(self):
        self.last: dict[str, bytes] = {}

    def of(self, pieces: pa.Array, encode) -> pa.Array:
        """Ids of different pieces; ``encode`` takes a list of those not remembered."""
        names = _strings(pieces)
        out = list(map(self.last.get, names))
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(missing, encode([names[i] for i in missing])):
            out[i] = ids
        self.last = {p: ids for p, ids in zip(names[:KEEP_PIECES], out) if len(p) <= KEEP_CHARS}
        return pa.array(out, pa.large_binary())


def _strings(pieces: pa.Array) -> list[str]:
    return pieces.to_numpy(zero_copy_only=False).tolist()


def _lists(pieces: list[str]):
    """Short lists of pieces, AT_ONCE characters or one piece in each."""
    lo = size = 0
    for i, p in enumerate(pieces):
        if size and size + len(p) > AT_ONCE:
            yield pieces[lo:i]
            lo, size = i, 0
        size += len(p) + 1
    if lo < len(pieces):
        yield pieces[lo:]


class Encoder:
    """Encodes texts to little-endian ids, two bytes an id where the vocabulary allows."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        #: A special token that can stand between pieces: found literally, eats no neighbours.
        self.mark = next((s for s in special if s.startswith("<|") and s.count("<") == 1), None)
        self.mark_id = special.get(self.mark)
        self.words, self.marks, self.others = Memory(), Memory(), Memory()
        #: The same model over words of small letters, told apart by spaces alone.
        self.small = Tokenizer.from_file(path)
        self.small.normalizer = normalizers.Sequence([])
        self.small.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ending = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.is_end = np.array([bool(ending) and (self.tokenizer.id_to_token(i) or "").endswith(ending) for i in range(vocabulary)])
        one, *parts = self._whole(["Ab c, d\n e", "Ab", "c,", "d", "e"])
        #: Whether white space parts tokens and leaves none; else whole texts go to the library.
        self.parted = one == b"".join(parts)
        self.plain = self.parted and self._is_plain()

    def _is_plain(self) -> bool:
        """Whether words of LETTERS may be encoded in lower case, apart from marks after them, and told by their last token."""
        words = ["a", "the", "Éaster", "ÀÖØÞ", "öøÿß", "Zoë", "qzxv" * 12, EACH_LETTER[:60], EACH_LETTER[60:]]
        lower, marks = [w.lower() for w in words], ["", MARKS, ".", ",;"]
        seams = self._whole(["a1,b2;C30", *_SEAM.split("a1,b2;C30")])
        try:
            fast = self._small_words(lower)
        except ValueError:
            return False
        if seams[0] != b"".join(seams[1:]):
            return False
        return all(a == f and b == f + m for w, f in zip(words, fast) for x, m in zip(marks, self._whole(marks)) for a, b in [self._whole([w, w + x])])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, ids: list[int], ends: np.ndarray, past: int, n: int) -> list[bytes]:
        """The ids of n pieces in one list; ``ends`` are the places after each, ``past`` what to leave out between them."""
        if len(ends) != n:
            raise ValueError("the tokenizer does not keep pieces apart")
        raw, size = np.array(ids, self.dtype).tobytes(), self.dtype.itemsize
        hi = (ends * size).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + past * size for e in hi[:-1])], hi)]

    def _small_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for part in _lists(words):
            ids = self.small.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            out += self._parts(ids, np.flatnonzero(self.is_end[ids]) + 1, 0, len(part))
        return out

    def _any(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for part in _lists(pieces):
            if len(part) == 1 and len(part[0]) > AT_ONCE:
                out.append(b"".join(self._whole([s])[0] for s in (_SEAM.split(part[0]) if self.plain else part)))
            elif self.mark is None or any(self.mark in p for p in part):
                out += self._whole(part)
            else:
                ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids)
                out += self._parts(ids, np.append(np.flatnonzero(ids == self.mark_id), len(ids)), 1, len(part))
        return out

    def _numbered(self, pieces: pa.Array, memory: Memory, encode) -> pa.Array:
        each = pieces.dictionary_encode()
        return memory.of(each.dictionary, encode).take(each.indices)

    def _pieces(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(ids of different pieces, and last the end id; place of each piece's among them)."""
        end = pa.array([np.array([END_ID], self.dtype).tobytes()], pa.large_binary())
        if not self.plain:
            return pa.concat_arrays([self.others.of(pieces, self._any), end]), np.arange(len(pieces))
        is_word = pc.match_substring_regex(pieces, WORD)
        words, others = pc.utf8_lower(pieces.filter(is_word)), pieces.filter(pc.invert(is_word))
        stems = self._numbered(pc.ascii_rtrim(words, MARKS), self.words, self._small_words)
        marks = self._numbered(pc.utf8_ltrim(words, EACH_LETTER), self.marks, self._any)
        out = [pc.binary_join_element_wise(stems, marks, pa.scalar(b"", pa.large_binary())), self.others.of(others, self._any), end]
        flags = is_word.to_numpy(zero_copy_only=False)
        return pa.concat_arrays(out), np.where(flags, np.cumsum(flags) - 1, len(words) + np.cumsum(~flags) - 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, end of each text's ids), each text with the end id; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if self.parted and len(texts) == 1 and texts.nbytes > 2 * STRETCH and len(stretches := list(_stretches(texts[0].as_py()))) > 1:
            ids = np.concatenate([*(self.encode(pa.array([s]))[0][:-1] for s in stretches), np.array([END_ID], self.dtype)])
            return ids, np.array([len(ids)])
        if not self.parted:
            ids = [self._whole([t])[0] + np.array([END_ID], self.dtype).tobytes() for t in texts.to_pylist()]
            return np.frombuffer(b"".join(ids), self.dtype), np.cumsum(np.array([len(x) for x in ids], np.int64)) // self.dtype.itemsize
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        numbered = lists.flatten().dictionary_encode()
        ids, places = self._pieces(numbered.dictionary)
        pieces = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        codes = np.insert(places[numbered.indices.to_numpy()].astype(np.int32), pieces, len(ids) - 1)
        taken = ids.take(pa.array(codes))
        _, at, raw = taken.buffers()
        ends = np.frombuffer(at, np.int64, len(codes) + 1)[pieces + np.arange(1, len(texts) + 1)] // self.dtype.itemsize
        return np.frombuffer(raw, self.dtype, int(ends[-1]) if len(ends) else 0), ends


def _stretches(text: str):
    """A very long text in parts that end at white space where there is any."""
    lo = 0
    while lo < len(text):
        hi = lo + STRETCH
        if hi < len(text):
            hi = max(text.rfind(" ", lo, hi), text.rfind("\n", lo, hi)) + 1 or next((m for m in (text.find(" ", hi), text.find("\n", hi)) if m >= 0), len(text) - 1) + 1
        yield text[lo:hi]
        lo = hi


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process; workers are reused, so it outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(texts, chars: int = 1 << 20, rows: int = 1024):
    """(first, past) of small stretches of a string column, so that memory follows texts, not batches."""
    lo, size = 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > lo and size + n > chars:
            yield lo, i
            lo, size = i, 0
        size += n
        if i + 1 - lo >= rows or i + 1 == len(sizes):
            yield lo, i + 1
            lo, size = i + 1, 0


def chunks(batch, chars: int = 1 << 20, rows: int = 64):
    """(doc ids, texts) of an Arrow batch in small lists."""
    for lo, hi in cuts(batch.column(1), chars, rows):
        yield batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()
