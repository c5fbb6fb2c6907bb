"""Splitting of texts at places where a public tokenizer always splits, with remembered words.

Encoding a whole text gives the same ids as joining the ids of its chunks, as long as every cut
is a boundary of the tokenizer's own splitting. Each worker then merges every different word once
instead of once per occurrence.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import regex

from webstrata.llm.common import Memo, held

#: Fixed value: the splitting pattern of byte-level vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space between two other characters; the byte-level pattern always starts a word there.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: First character beyond the Latin blocks, whose letters and cases no library disagrees about.
_BEYOND_LATIN = "ɐ"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: Marks that end a word of letters and stand alone in every splitting used here.
_ENDS = frozenset(".,;:!?")


def _ended(c: str) -> bool:
    """A word of plain letters, whose normal form has letters only, and one of those marks."""
    return c[-1:] in _ENDS and c[:-1].isalpha() and (c.isascii() or max(c) < "İ")


class SpacedChunks:
    """Values of the chunks of a text under the byte-level splitting pattern.

    A space between two non-spaces always starts a new word together with what follows it, and a
    line feed between two non-spaces is always a word of its own. ``make(chunk)`` gets chunks with
    their leading space. Values must be addable (bytes or counts). Texts with longer runs of white
    space are cut at safe spaces only.
    """

    def __init__(self, make: Callable, entries: int):
        line_feed = make("\n")

        def edge(c: str) -> bool:
            return not c or c[0].isspace() or c[-1].isspace()

        def first(c: str):
            if _ended(c):
                return self.first[c[:-1]] + self.first[c[-1]]
            return None if edge(c) else make(c)

        def later(c: str):
            if _ended(c):
                return self.later[c[:-1]] + self.first[c[-1]]
            if c[:1] == "\n":
                rest = self.first[c[1:]]
                return None if rest is None else line_feed + rest
            return None if edge(c) else make(" " + c)

        self.first = Memo(first, entries // 2)
        self.later = Memo(later, entries)
        self.runs = Memo(make, entries // 4)

    def reduce(self, text: str, join: Callable):
        """``join`` of the values of all chunks; it must fail with TypeError on None."""
        if not text:
            return join(())
        head, *rest = text.replace("\n", " \n").split(" ")
        try:
            return join([self.first[head], *map(self.later.__getitem__, rest)])
        except TypeError:  # white space next to a cut
            head, *rest = _SAFE.split(text)
            return join([self.runs[head], *[self.runs[" " + c] for c in rest]])


class BareChunks:
    """Values of the chunks of a text for a lower-casing tokenizer that drops white space and never joins across it."""

    def __init__(self, make: Callable, entries: int):
        def value(c: str):
            if _ended(c):
                return self.memo[c[:-1]] + self.memo[c[-1]]
            if c.isascii() and c.isalpha() and not c.islower():
                return self.memo[c.lower()]
            return make(c)

        self.memo = Memo(value, entries)

    def reduce(self, text: str, join: Callable):
        return join(list(map(self.memo.__getitem__, text.replace("\n", " ").split(" "))))


#: Latin-1 bytes of common texts: no control characters but tab and line ends, no odd spaces.
_COMMON = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
_SPACES = bytes(0x20 if b in b"\t\n\r" else b for b in range(256))


def common(text: str) -> bool:
    """Whether a text has Latin-1 letters and marks only, and no run of 100 spaces; other texts go chunk by chunk."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not data.translate(None, _COMMON) and b" " * 100 not in data.translate(_SPACES)


def latin_classes(pattern: str) -> str:
    """A splitting pattern with the Latin-1 letters and numbers spelt out in its character classes."""
    of = lambda kind: "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
    return pattern.replace("\\p{L}", of("L")).replace("\\p{N}", of("N"))


class WholeTexts:
    """Ids of whole common texts by a byte-pair merger over the vocabulary's own merges.

    ``ranks`` holds the symbols in the order of merging. A word end is written as a zero byte behind
    the word; the symbols that hold one come first, so that it joins the last character before
    anything else does. A symbol that its own text does not merge into is never reached and left out.
    """

    def __init__(self, spec: dict, tokenize: Callable, split: str, lower: bool):
        import tiktoken

        vocab, ending = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        shown = {c: b for b, c in byte_symbols().items()}
        raw = lambda t: bytes(shown[c] for c in t)
        order = [raw(c) for c in shown]
        if ending:
            order += [b"\0" + b"\0"] + [raw(c) + b"\0" for c in shown if raw(c) != b"\0"]
        ids = {raw(c): vocab[c] for c in shown if c in vocab}
        ids |= {raw(c) + b"\0": vocab[c + ending] for c in shown if ending and c + ending in vocab}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            whole = a + b
            bare = whole.removesuffix(ending) if ending else whole
            if (whole != bare or not ending) and [t.id for t in tokenize(bare)] != [vocab[whole]]:
                continue
            key = raw(bare) + (b"\0" if whole != bare else b"")
            order.append(key)
            ids[key] = vocab[whole]
        ranks: dict[bytes, int] = {}
        for key in order:
            ranks.setdefault(key, len(ranks))
        self.ids = np.array([ids.get(key, 0) for key in ranks], "<u4")
        pattern = r"[^\x00]+\x00" if ending else split
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = re.compile(latin_classes(split)).findall if ending else None
        self.lower = lower

    def __call__(self, text: str) -> np.ndarray:
        if self.lower:
            text = text.lower()
        if self.words:
            text = "\0".join([*self.words(text), ""])
        return self.ids[self.encode(text)]


class Encoder:
    """Ids of texts under a vocabulary file of the tokenizers library, as little-endian bytes.

    Texts of Latin letters and common marks are merged whole. In others, words of Latin letters are
    split here and merged by the library's model; a chunk with any other character, or with what may
    be a special string, is encoded by the whole library.
    """

    def __init__(self, vocabulary: str, entries: int):
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer = Tokenizer.from_file(vocabulary)
        merges, symbols = tokenizer.model.tokenize, byte_symbols()
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        kind = f"<u{self.width}"
        of_id = [k.to_bytes(self.width, "little") for k in range(size)]
        marks = [t["content"][:2] for t in spec.get("added_tokens", ())]

        def merge(word: str) -> bytes:
            mapped = word.encode().decode("latin-1").translate(symbols)
            return b"".join([of_id[t.id] for t in merges(mapped)])

        def whole(chunk: str) -> bytes:
            return np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, kind).tobytes()

        pre, normal = spec["pre_tokenizer"], None
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None:
            split, chunks = regex.compile(BYTE_LEVEL).findall, SpacedChunks
        elif [p["type"] for p in pre.get("pretokenizers", ())] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed":
            split, chunks = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"]).findall, BareChunks
            normal = tokenizer.normalizer.normalize_str
        else:
            raise ValueError(f"{vocabulary}: neither byte-level nor white-space dropping")

        def make(chunk: str) -> bytes:
            if not chunk:
                return b""
            if not chunk.isascii() and max(chunk) >= _BEYOND_LATIN:
                return whole(chunk)
            if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) and (not normal or chunk.isascii()):  # one word
                return merge(chunk.lower() if normal else chunk)
            if any(m in chunk for m in marks):
                return whole(chunk)
            return b"".join([merge(w) for w in split(normal(chunk) if normal else chunk)])

        self.chunks, self.kind, self.marks = chunks(make, entries), kind, marks
        self.whole = WholeTexts(spec, merges, split.__self__.pattern, lower=normal is not None)

    def encode(self, text: str) -> bytes:
        if not common(text) or any(m in text for m in self.marks):
            return self.chunks.reduce(text, b"".join)
        return self.whole(text).astype(self.kind).tobytes()


def encoder(vocabulary: str, entries: int = 180_000) -> Encoder:
    """The worker's encoder, remembering up to four times ``entries`` chunks."""
    return held(("encoder", vocabulary, entries), lambda: Encoder(vocabulary, entries))
