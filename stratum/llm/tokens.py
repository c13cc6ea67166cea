"""Token ids of whole texts, a column at a time, with the tokenizers library and bounded caches.

A text is cut at single spaces. In the two kinds of vocabulary known here the library never lets a token cross such a
cut (a space starts the next token, or is dropped), so the ids of the pieces, one after the other, are the ids of the
text. Arrow cuts a column of texts and numbers its distinct pieces; each distinct piece is encoded once, and the ids of
all texts are gathered by number. Plain words, and words with one sign behind them, need the library's model only.

Where cutting does not hold the library's whole encoder is used: for a text that holds an added token (which the
library maps to one id wherever it stands), for pieces with letters beyond Latin, and for all texts of another kind of
vocabulary. In a byte-level vocabulary a cut is made only before a character that is not white space.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

CACHE_ENTRIES, SLICE_BYTES = 500_000, 4 << 20
_ENCODERS: dict[str, "ColumnEncoder"] = {}

#: How the two kinds of vocabulary part a text.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LOWER_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters up to Latin Extended-B; the dotted capital I is left out, as its lower case is two characters.
LATIN = regex.compile(r"[\x00-įı-ɏ]*")
#: Letters up to Latin-1 with a run of signs behind them, once, or twice with a line's end between: each run of letters
#: and each run of signs is one part for both kinds.
LETTERS, SIGNS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+", string.punctuation
_RUN = LETTERS + r"[!-/:-@\[-`{-~]*"
PLAIN = rf"^{_RUN}(\n{_RUN})?$"
#: A space before white space or the end: no cut for byte-level vocabularies.
WIDE_GAP = r" ([\t-\r\x1c- ]|\x{85}|\x{a0}|\x{1680}|[\x{2000}-\x{200a}]|\x{2028}|\x{2029}|\x{202f}|\x{205f}|\x{3000}|$)"
_CUT = re.compile(r" (?=\S)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


def _kind(tokenizer) -> str:
    """"byte", "lower" or "other"."""
    told = json.loads(tokenizer.to_str())
    pre, norm = told.get("pre_tokenizer") or {}, told.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    steps = [x.get("type") for x in pre.get("pretokenizers", [])]
    folds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    if steps == ["Split", "ByteLevel"] and folds == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0]["pattern"].get("Regex") == LOWER_WORDS.pattern:
        return "lower"
    return "other"


assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are packed as little-endian 32-bit integers"


class Pool:
    """Ids of numbered entries, one after the other; names lead to numbers. Entry 0 is empty."""

    def __init__(self, entries: int):
        self.entries, self.numbers, self.ids, self.ends = entries, {}, array("I"), array("q", [0, 0])

    def number(self, names: list[str], make: Callable[[str], list[int]]) -> np.ndarray:
        """The numbers of distinct names; make gives the ids of new ones. Beyond the bound, names are no longer kept."""
        found = list(map(self.numbers.get, names))
        if None in found:
            new = [name for name, n in zip(names, found) if n is None]
            made = list(map(make, new))
            first = len(self.ends) - 1
            self.ids.extend(chain.from_iterable(made))
            self.ends.extend((np.cumsum(np.fromiter(map(len, made), dtype=np.int64, count=len(made))) + self.ends[-1]).tolist())
            self.numbers.update(zip(new[: max(0, self.entries - len(self.numbers))], range(first, first + len(new))))
            fresh = iter(range(first, first + len(new)))
            found = [next(fresh) if n is None else n for n in found]
        return np.array(found, dtype=np.int64)

    def forget(self) -> None:
        """Drops entries whose names are not kept; they are the last ones."""
        known = len(self.numbers) + 1
        if len(self.ends) > known + 1:
            del self.ends[known + 1 :]
            del self.ids[self.ends[-1] :]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries, one after the other, and how many each has."""
        return gather(np.frombuffer(self.ids, dtype=np.uint32), np.frombuffer(self.ends, dtype=np.int64), numbers)


def gather(values: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[ends[i] : ends[i + 1]] for each i of numbers, one after the other, and their lengths."""
    first = ends[numbers]
    lengths = ends[numbers + 1] - first
    upto = np.cumsum(lengths)
    total = int(upto[-1]) if len(upto) else 0
    if not total:
        return np.zeros(0, dtype=np.uint32), lengths
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64  # half the memory for slices of ordinary size
    at = np.repeat((first - upto + lengths).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at], lengths


class ColumnEncoder:
    """Encodes Arrow columns of texts with one vocabulary."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.model = _kind(self.tokenizer), self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.characters = byte_characters()
        self.latin1 = {i: c for i, c in self.characters.items() if c != chr(i)}
        self.words, self.heads, self.parts = Pool(cache_entries), Pool(cache_entries // 8), Pool(cache_entries // 8)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _modelled(self, shown: str) -> list[int]:
        return [t.id for t in self.model.tokenize(shown)]

    def _shown(self, text: str) -> str:
        return text if text.isascii() and text.isalnum() else text.encode().decode("latin-1").translate(self.latin1)

    def _part(self, part: str) -> list[int]:
        number = self.parts.numbers.get(part)
        if number is None:
            ids = self._modelled(self._shown(part))
            self.parts.number([part], lambda _: ids)
            self.parts.forget()
            return ids
        return self.parts.ids[self.parts.ends[number] : self.parts.ends[number + 1]]

    def _stretch(self, text: str) -> list[int]:
        """Ids of a stretch of text that starts and ends at a cut."""
        if not LATIN.fullmatch(text):
            return self._whole(text)
        out: list[int] = []
        for part in BYTE_LEVEL.findall(text) if self.kind == "byte" else LOWER_WORDS.findall(text.lower()):
            out.extend(self._part(part))
        return out

    def _word(self, name: str) -> list[int]:
        """Ids of a run of letters; for byte-level vocabularies a space stands before it, or the end of a line."""
        if self.kind == "lower":
            return self._modelled(self._shown(name))
        return self._modelled(self._shown(name[1:])) if name[0] == "\n" else self._modelled("Ġ" + self._shown(name))

    def _distinct(self, pieces: pa.Array) -> np.ndarray:
        """Entry numbers of each piece behind a cut: word, signs, line's end, word, signs; or the piece and nothing."""
        out, plain = np.zeros((len(pieces), 5), dtype=np.int64), pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False)
        if plain.any():
            cut = pc.split_pattern(pieces.filter(pa.array(plain)), "\n")
            bounds, runs = cut.offsets.to_numpy(), cut.values
            second = np.ones(len(runs), dtype=bool)
            second[bounds[:-1]] = False
            core = pc.utf8_rtrim(runs, characters=SIGNS)
            if self.kind == "lower":
                core = pc.utf8_lower(core)
            elif second.any():
                core = pc.binary_join_element_wise(pc.if_else(pa.array(second), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())), core, pa.scalar("", pa.large_string()))
            core = core.dictionary_encode()
            word = self.words.number(core.dictionary.to_pylist(), self._word)[core.indices.to_numpy()]
            signs = pc.replace_substring_regex(runs, "^" + LETTERS, "").dictionary_encode()
            names = ["\t" + x for x in signs.dictionary.to_pylist()]
            sign = self.words.number(names, lambda x: self._part(x[1:]) if len(x) > 1 else [])[signs.indices.to_numpy()]
            at = np.flatnonzero(plain)
            out[at, 0], out[at, 1] = word[bounds[:-1]], sign[bounds[:-1]]
            at = at[np.diff(bounds) == 2]
            out[at, 2], out[at, 3], out[at, 4] = self.words.number(["\t\n"], lambda x: self._stretch(x[1:]))[0], word[second], sign[second]
        if not plain.all():
            lead = " " if self.kind == "byte" else ""
            out[~plain, 0] = self.words.number([" " + p for p in pieces.filter(pa.array(~plain)).to_pylist()], lambda p: self._stretch(lead + p[1:]))
        return out

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per text, of texts that can be cut at every space."""
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        return self._pieces(cut.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])), bounds - bounds[0])

    def _pieces(self, pieces: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per text; text i has pieces[bounds[i] : bounds[i + 1]], one at least."""
        coded = pieces.dictionary_encode()
        index, distinct = coded.indices.to_numpy().copy(), coded.dictionary
        ids, lengths = self.words.gather(self._distinct(distinct).ravel())
        lengths = lengths.reshape(len(distinct), -1).sum(axis=1)
        if self.kind == "byte":  # no space stands before a text's first piece
            heads = pieces.take(pa.array(bounds[:-1])).dictionary_encode()
            head_ids, head_lengths = self.heads.gather(self.heads.number(heads.dictionary.to_pylist(), self._stretch))
            index[bounds[:-1]] = len(distinct) + heads.indices.to_numpy()
            ids, lengths = np.concatenate((ids, head_ids)), np.concatenate((lengths, head_lengths))
            self.heads.forget()
        self.words.forget()
        out, counts = gather(ids, np.concatenate(([0], np.cumsum(lengths))), index)
        return out, np.add.reduceat(counts, bounds[:-1])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per text."""
        odd = np.zeros(len(texts), dtype=bool) if self.kind != "other" else np.ones(len(texts), dtype=bool)
        for content in self.added:
            odd |= pc.match_substring(texts, content, ignore_case=True).to_numpy(zero_copy_only=False)
        wide = ~odd & pc.match_substring_regex(texts, WIDE_GAP).to_numpy(zero_copy_only=False) if self.kind == "byte" else np.zeros(len(texts), dtype=bool)
        done = []
        if plain := len(texts) - int(odd.sum()) - int(wide.sum()):
            rest = ~odd & ~wide
            done.append((np.flatnonzero(rest), *self._cut(texts if plain == len(texts) else texts.filter(pa.array(rest)))))
        if wide.any():
            parts = [_CUT.split(t) for t in texts.filter(pa.array(wide)).to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            done.append((np.flatnonzero(wide), *self._pieces(pa.array([x for p in parts for x in p], type=pa.large_string()), bounds)))
        if odd.any():
            each = [np.array(self._whole(t), dtype=np.uint32) for t in texts.filter(pa.array(odd)).to_pylist()]
            done.append((np.flatnonzero(odd), np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)))
        if len(done) == 1:
            return done[0][1:]
        counts, values, order = np.zeros(len(texts), dtype=np.int64), np.concatenate([d[1] for d in done]), np.concatenate([d[0] for d in done])
        lengths = np.concatenate([d[2] for d in done])
        counts[order] = lengths
        return gather(values, np.concatenate(([0], np.cumsum(lengths))), np.argsort(order, kind="stable"))[0], counts

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of texts, ids, bounds of each text's ids) for slices of bounded size; null is empty; end_id, if given,
        is put behind each text."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
            ids, counts = self._slice(pc.fill_null(texts.slice(at, to - at).cast(pa.large_string()), ""))
            bounds = np.concatenate(([0], np.cumsum(counts)))
            if end_id is not None:
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
            yield to - at, ids.astype("<u4", copy=False), bounds
            at = to
        pa.default_memory_pool().release_unused()  # or two workers hold what each once needed

    def one(self, text: str | None) -> list[int]:
        """The ids of one text."""
        return next(self.encode(pa.array([text], type=pa.string())))[1].tolist()


def encoder(path: str) -> ColumnEncoder:
    """One encoder per Python worker, so that its caches serve all of the worker's tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ColumnEncoder(path)
    return _ENCODERS[path]
