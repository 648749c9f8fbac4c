"""Token ids of texts by a public tokenizer file, with a memory of words.

Some tokenizers treat every word between white space by itself. For these the ids of a text are
the ids of its words, one after the other, and a word that was seen before costs one look-up.
Whether a file is of that kind is read from the file; texts go to any other one whole.
"""

from __future__ import annotations

import json
import os
import struct
import sys
from collections.abc import Iterator
from functools import cached_property
from types import ModuleType

import numpy as np
import pandas as pd
import regex

#: Words that a Python worker remembers in each of its two generations (about 60 MB).
REMEMBERED = 400_000
#: Words that are encoded at a time.
TOGETHER = 64
#: Letters below this need no normal form beyond lower case.
PLAIN_LETTERS = "ɐ"


def _by_words(spec: dict) -> str | None:
    """The pattern of a word's parts, where the file is of the kind that treats words apart: it
    lower-cases, splits by a pattern that never holds white space, drops what is between, and marks
    the end of each part. None for any other file."""
    normal, split, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    if steps != [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]:
        return None
    parts = split.get("pretokenizers", [])
    if [p.get("type") for p in parts] != ["Split", "ByteLevel"]:
        return None
    cut, level = parts
    pattern = (cut.get("pattern") or {}).get("Regex")
    kept = cut.get("behavior") == "Removed" and cut.get("invert") is True
    level_plain = not level.get("add_prefix_space") and level.get("use_regex") is False
    marked = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout")
    if not (pattern and kept and level_plain and marked and spec.get("post_processor") is None):
        return None
    if any(added.get("lstrip") or added.get("rstrip") or "<|" not in added["content"] for added in spec.get("added_tokens", [])):
        return None
    return pattern if regex.search(pattern, " \t\n\v\f\r\x85\xa0 ") is None else None


def _byte_letters() -> dict[int, str]:
    """What a byte-level vocabulary writes for each byte: printable ones stand for themselves, the
    others, in order, for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """``Encoder(path, end_id)(texts)``: the ids of each UTF-8 text as little-endian unsigned
    32-bit integers, with ``end_id`` (where given) after them.

    With a tokenizer by words, chunks between ASCII white space are looked up; so that there are
    fewer different ones, A-Z are lower-cased and a full stop or comma between an ASCII letter and
    white space is a chunk of its own. The ids stay the same. What a chunk's parts are is told by
    the file's own pattern; chunks with letters that need more than lower case, or with what may be
    a special token, go to the whole tokenizer."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path = path
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.pattern = _by_words(spec)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if self.pattern:
            self.parts = regex.compile(self.pattern).findall
            self.letters = _byte_letters()
            spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.words = Tokenizer.from_str(json.dumps(spec))
            vocabulary, close = self.words.get_vocab(), spec["model"]["end_of_word_suffix"]
            self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.closes[[i for piece, i in vocabulary.items() if piece.endswith(close)]] = True

    @staticmethod
    def chunks(texts: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The chunks of all texts, and the number of them up to the end of each text."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lower = b"<|" not in data.tobytes()  # special tokens are told by case
        mark = ((data[1:-1] == 46) | (data[1:-1] == 44)) & _LETTER[data[:-2]] & _SPACE[data[2:]]
        points = np.flatnonzero(mark) + 1
        cut = np.insert(_LOWER[data] if lower else data, points, 32)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        ends += np.searchsorted(points, ends)
        space = _SPACE[cut]
        begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        return cut.tobytes().split(), np.searchsorted(begins, ends).tolist()

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk. Parts of chunks are encoded many at a time and told apart by the
        pieces that close a part."""
        out: list[bytes | None] = [None] * len(chunks)
        for start in range(0, len(chunks), TOGETHER):
            numbers, ends, written, count = [], [], [], 0
            for k in range(start, min(start + TOGETHER, len(chunks))):
                word = chunks[k].decode("utf-8").lower()
                ascii_only = word.isascii()
                if (ascii_only or max(word) < PLAIN_LETTERS) and "<|" not in word:
                    parts = [word] if word.isalpha() else self.parts(word)
                    written += parts if ascii_only else [p.encode().decode("latin-1").translate(self.letters) for p in parts]
                    count += len(parts)
                    numbers.append(k)
                    ends.append(count)
            ids = np.array(self.words.encode_batch_fast([" ".join(written)], add_special_tokens=False)[0].ids, dtype="<u4")
            closed = np.flatnonzero(self.closes[ids]) + 1
            if len(closed) == len(written) and (not len(ids) or closed[-1] == len(ids)):
                raw, at, bounds = ids.tobytes(), 0, [0, *(4 * closed).tolist()]
                for k, end in zip(numbers, ends, strict=True):
                    out[k] = raw[at : bounds[end]]
                    at = bounds[end]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.whole([chunks[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.pattern:
            return [ids + self.end for ids in self.whole(texts)]
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        chunks, ends = self.chunks(texts)
        known, old = self.young, self.old
        found = [*map(known.get, chunks)]
        unknown = [k for k, ids in enumerate(found) if ids is None]
        if unknown:
            fresh = {chunks[k] for k in unknown}
            again = fresh & old.keys()
            known.update((x, old[x]) for x in again)
            fresh = [*(fresh - again)]
            known.update(zip(fresh, self.encode(fresh), strict=True))
            for k in unknown:
                found[k] = known[chunks[k]]
        return [b"".join(found[start:end]) + self.end for start, end in zip([0, *ends[:-1]], ends, strict=True)]


def worker_encoder(path: str, end_id: int | None) -> Encoder:
    """The encoder of this Python worker: the words that one task has met are known to the next.
    This package is sent along with each task, so what must outlive one is kept outside it."""
    held = sys.modules.setdefault("gradewell_worker_memory", ModuleType("gradewell_worker_memory")).__dict__
    return held.setdefault("encoders", {}).get((path, end_id)) or held["encoders"].setdefault((path, end_id), Encoder(path, end_id))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_batches(texts: pd.Series, most: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of ``texts`` as UTF-8 (null: empty) of about ``most`` bytes, each with its first place."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.encode("utf-8", "replace") if text else b"")
        size += len(held[-1])
        if size > most:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held
