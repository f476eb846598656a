"""Token ids of whole texts with a public tokenizer, encoding every distinct word once.

The given tokenizers never join characters across white space in front of a word,
nor a letter with what follows a run of letters, so a text's ids are the ids of its
pieces in order. Pieces repeat, so those of a group of texts are counted as an Arrow
dictionary, their ids are kept in a table of bounded size, and the library encodes
only pieces that are not in it; a plain word goes to the library's BPE model
directly, since it is one word of the library's own split. Texts in which a cut could
matter (a special token's string, white space beyond ASCII) go to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text_arrays import utf8

#: Pieces whose ids a worker keeps while a task runs (some 50 MB). A full table is left as it is, or begun anew once it no longer serves.
MOST_PIECES = 250_000
#: Longer pieces are encoded but not kept.
LONGEST_KEPT = 64
#: A worker encodes texts in groups of about so many bytes.
GROUP_CHARS = 1 << 20
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces that are one word of the library's split: of every given tokenizer, and of those whose words take the space.
_WORD = re.compile(f" ?[{_LETTERS}]+")
_SPACED_WORD = re.compile(f" ?(?:[{_LETTERS}]+|[0-9]+|[!-/:-@\\[-`{{-~]+)")
_BYTES = np.arange(256)
_ASCII_LETTER = (_BYTES | 32 >= 97) & (_BYTES | 32 <= 122) & (_BYTES < 128)
_ASCII_OTHER = (_BYTES < 128) & ~_ASCII_LETTER
#: White space that texts are cut at.
_GAP = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
#: Second bytes of the letters À to ÿ, whose first is 0xC3.
_LATIN = (_BYTES >= 0x80) & (_BYTES <= 0xBF) & (_BYTES != 0x97) & (_BYTES != 0xB7)
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False).ids`` does.

    ``spaced``: a word's piece takes the space in front of it (byte-level
    vocabularies); otherwise white space and case leave no trace in the ids.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced = spaced
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        odd = "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and not (c < 128 and _GAP[c]))
        self.unsafe = "|".join([*added, f"[{odd}]"])
        self.plain = (_SPACED_WORD if spaced else _WORD).fullmatch
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(32, 256) if _WORD.fullmatch(f"a{chr(c)}") or c == 32}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)

    def whole(self, text: str) -> np.ndarray:
        """The library's ids of a text."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _new(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids plain words and then other pieces have, and their ids, flat."""
        tokens = [self.model.tokenize(self._shown(p)) for p in words]
        found = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in others]
        sizes = np.fromiter(map(len, chain(tokens, found)), np.int64, count=len(words) + len(others))
        ids = chain(map(attrgetter("id"), chain.from_iterable(tokens)), chain.from_iterable(found))
        return sizes, np.fromiter(ids, np.uint32, count=int(sizes.sum()))

    def _shown(self, piece: str) -> str:
        """A plain word as the library's model takes it."""
        word = piece if self.spaced else piece.lstrip(" ").lower()
        return word.replace(" ", self.shown[32]) if word.isascii() else word.translate(self.shown)

    def _keep(self, names: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        short = np.fromiter(map(LONGEST_KEPT.__ge__, map(len, names)), bool, count=len(names))
        if not short.all():
            ids, sizes = ids[np.repeat(short, sizes)], sizes[short]
            names = [p for p in names if len(p) <= LONGEST_KEPT]
        n = len(self.known)
        if n + len(names) > MOST_PIECES:
            return
        begin = int(self.starts[n])
        if begin + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        if n + len(names) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(names)), np.int64)])
        self.flat[begin : begin + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(names)] = begin + np.cumsum(sizes)
        self.known.update(zip(names, range(n, n + len(names)), strict=True))

    def _starts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pieces start in the bytes of texts without unsafe places; ``rows`` holds the texts' offsets."""
        gap, row = _GAP[data], np.zeros(len(data) + 1, dtype=bool)
        row[rows] = True
        cut = row.copy()
        if self.spaced:  # of white space in front of a word, the last is split off: a space goes to the word, others stand alone
            last = gap[:-1] & ~gap[1:] & ~row[1:-1]
            cut[:-2] |= last
            cut[1:-1] |= gap[1:] & ~gap[:-1] | last & (data[:-1] != 32)
        else:
            cut[:-1] |= gap
        letter = _ASCII_LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
        cut[1:-1] |= letter[:-1] & _ASCII_OTHER[data[1:]]
        return np.flatnonzero(cut[:-1])

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = pc.fill_null(column.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(column, self.unsafe).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(column)
        for i in np.flatnonzero(unsafe).tolist():
            out[i] = self.whole(column[i].as_py())
        safe = np.flatnonzero(~unsafe)
        data, rows = utf8(column.filter(pa.array(~unsafe)) if len(safe) < len(column) else column)
        if not self.spaced:
            data = np.where(_GAP[data], np.uint8(32), data)
        group = rows[:-1] // GROUP_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(safe)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids, ends = self._group(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a])
            for i, start, end in zip(safe[a:b].tolist(), ends, ends[1:], strict=False):
                out[i] = ids[start:end]
        return out

    def _group(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Ids of texts, flat, and the offset of each text's ids and their end."""
        begin = self._starts(data, rows)
        if not len(begin):
            return np.zeros(0, np.uint32), [0] * len(rows)
        ranges = np.append(begin, len(data))
        pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ranges), pa.py_buffer(data)).dictionary_encode()
        names, index = pieces.dictionary.to_numpy(zero_copy_only=False), pieces.indices.to_numpy()
        at = np.fromiter(map(self.known.get, names.tolist(), repeat(-1)), dtype=np.int64, count=len(names))
        if len(self.known) > MOST_PIECES // 2 and np.count_nonzero((at < 0)[index]) > len(index) // 2:
            self.forget()
            at = np.full(len(names), -1)
        starts, sizes, flat = self.starts[at], self.starts[at + 1] - self.starts[at], self.flat
        missing = np.flatnonzero(at < 0)
        if len(missing):  # ids of this group's new pieces stand behind the table's
            plain = np.fromiter(map(bool, map(self.plain, names[missing].tolist())), bool, count=len(missing))
            words, others = missing[plain], missing[~plain]
            own, new = self._new(names[words].tolist(), names[others].tolist())
            missing, base = np.concatenate([words, others]), int(self.starts[len(self.known)])
            flat = np.concatenate([self.flat[:base], new])
            starts[missing], sizes[missing] = base + np.cumsum(own) - own, own
            self._keep(names[missing].tolist(), own, new)
        starts, sizes = starts[index], sizes[index]
        ends = np.cumsum(sizes)
        ids = flat[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)]
        return ids, np.concatenate(([0], ends))[np.searchsorted(begin, rows)].tolist()


def encoder(path: str, spaced: bool) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, spaced)
    return _ENCODERS[path]
