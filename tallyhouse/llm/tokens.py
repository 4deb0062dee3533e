"""Token ids of whole texts with the tokenizers library, each distinct word encoded once.

Both supported kinds of tokenizer never let a token cross a lone space or newline, so texts are cut
there by Arrow, whose hash tables find the distinct words of a block and those that a worker has
met before; only the others go to the library. Any other kind of tokenizer or text is encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by one worker, some 10 MB; beyond it the half that fewer blocks had goes.
CACHE_WORDS = 300_000
#: Bytes of text that are cut into words at a time; a longer word makes a longer block.
BLOCK_BYTES = 4 << 20

#: White space of any alphabet.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: Runs of white space, and white space at an end, have tokens of their own.
_SPACED = rf"\A{_SPACE}|{_SPACE}{_SPACE}|{_SPACE}\z"
_WORD_NORMALIZERS = ("NFC", "Replace", "Lowercase")


def _kind(spec: dict) -> str:
    """byte: a token may begin with one space. word: white space is dropped. whole: unknown."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("model", {}).get("type") != "BPE":
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    split = (pre.get("pretokenizers") or [{}])[0]
    kinds = tuple(x["type"] for x in (norm or {}).get("normalizers", []))
    dropped = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    if dropped and kinds == _WORD_NORMALIZERS and "[^\\s" in split["pattern"].get("Regex", ""):
        return "word"
    return "whole"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = _kind(spec)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.line = self._ids("\n")
        self.tails: dict[str, list[int]] = {}
        # The words that were met, how many blocks had each, and where its ids lie in the pool.
        self.words, self.met = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.starts, self.counts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        """Ids of a word that follows a space, or with its newline of one that begins a line."""
        lead, head = " " if self.kind == "byte" else "", []
        if word[:1] == "\n":
            word, lead, head = word[1:], "", self.line
        core = word.rstrip(".,")
        # Letters below U+0250 are composed already and have plain lower-case forms, but for U+0130.
        if not core.isalpha() or not core.isascii() and (max(core) >= "ɐ" or "İ" in core):
            return head + self._ids(lead + word) if word else head
        shown = core.lower() if self.kind == "word" else core
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(self.letters)
        ids = [x.id for x in self.model.tokenize("Ġ" + shown if lead else shown)]
        if len(core) < len(word):
            tail = word[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self._ids(tail)
            ids += self.tails[tail]
        return head + ids

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of some distinct words stands among the known ones, which it joins if it is new."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            found, counts = array("I"), []
            for word in fresh.to_pylist():
                ids = self._word(word)
                counts.append(len(ids))
                found.extend(ids)
            at[new] = len(self.words) + np.arange(len(new))
            sizes = np.array(counts, np.int64)
            self.starts = np.r_[self.starts, len(self.pool) + np.cumsum(sizes) - sizes]
            self.counts, self.met = np.r_[self.counts, sizes], np.r_[self.met, np.zeros(len(new), np.int64)]
            self.pool = np.r_[self.pool, np.frombuffer(found, np.uint32)]
            self.words = pa.concat_arrays([self.words, fresh])
        self.met[at] += 1
        return at

    def _forget(self) -> None:
        if len(self.words) > CACHE_WORDS:
            keep = np.sort(np.argsort(-self.met, kind="stable")[: CACHE_WORDS // 2])
            starts, counts = self.starts[keep], self.counts[keep]
            self.words, self.met, self.counts = self.words.take(pa.array(keep)), self.met[keep] // 2, counts
            self.pool = self.pool[_spans(starts, counts)]
            self.starts = np.cumsum(counts) - counts
        if len(self.tails) > 10_000:
            self.tails.clear()

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts that each begin with a space or newline, and where each text's ids begin and end."""
        self._forget()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.kind == "byte" else " "), " ")
        coded = lists.flatten().dictionary_encode()
        # What stands before the first of two separators is no word and has no ids.
        words = coded.dictionary
        real = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)
        starts, counts = np.zeros((2, len(words)), np.int64)
        at = self._places(words.take(pa.array(real)))
        starts[real], counts[real] = self.starts[at], self.counts[at]
        which = coded.indices.to_numpy()
        ids = self.pool[_spans(starts[which], counts[which])]
        ends = np.r_[0, np.cumsum(counts[which])]
        offsets = lists.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        odd = np.full(len(texts), self.kind == "whole")
        # Special tokens may have spaces around or in them that count.
        for sign in self.special:
            odd |= pc.match_substring(texts, sign).to_numpy(zero_copy_only=False)
        if self.kind == "byte":
            odd |= pc.match_substring_regex(texts, _SPACED).to_numpy(zero_copy_only=False)
        out = [b""] * len(texts)
        for i in np.flatnonzero(odd & (sizes > 0)).tolist():
            out[i] = array("I", self._ids(texts[i].as_py())).tobytes()
        quick = np.flatnonzero(~odd & (sizes > 0))
        long = sizes[quick] > BLOCK_BYTES
        for i in quick[long].tolist():
            out[i] = self._long(texts[i].as_py())
        quick = quick[~long]
        total = np.cumsum(sizes[quick])
        at = 0
        while at < len(quick):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
            mine = quick[at:upto]
            # A first word is one after a newline, whose ids are dropped again.
            ids, ends = self._block(pc.binary_join_element_wise("\n", texts.take(pa.array(mine)), ""))
            drop = len(self.line) if self.kind == "byte" else 0
            for k, i in enumerate(mine.tolist()):
                out[i] = ids[ends[k] + drop : ends[k + 1]].tobytes()
            at = upto
        return out

    def _long(self, text: str) -> bytes:
        """A text longer than a block, cut before separators."""
        out, at = [], 0
        while at < len(text):
            upto = min(len(text), at + BLOCK_BYTES)
            if upto < len(text):
                upto = min((x for x in (text.find(" ", upto), text.find("\n", upto)) if x >= 0), default=len(text))
            ids, _ = self._block(pa.array([text[at:upto] if at else "\n" + text[:upto]], pa.string()))
            out.append(ids[0 if at or self.kind == "word" else len(self.line) :].tobytes())
            at = upto
        return b"".join(out)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, whose cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
