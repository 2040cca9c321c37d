"""Byte-level BPE ids as the tokenizers library gives them for a tokenizer file, made by a faster encoder of the same vocabulary.

The ranks and the special tokens come from the tokenizer's JSON file; the pattern that splits a text before the merges is that of the
library's byte-level pre-tokeniser, which the file names but doesn't spell out. Special tokens' strings in a text are ids of their
own, as the library has it by default (encode), or ordinary text (ordinary).

A run of white space of any length is one pre-token but for its last character, where a word follows. The pattern finds that by
going back through the run, which needs a stack as deep as the run is long, so long runs are cut out and merged by themselves.

Parity. Tests hold the ids of whole tables against the tokenizers library; Audit does so within a job, for texts of every batch that
their hashes choose, and a difference fails the job.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: The file that operators use unless told otherwise.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: White space as the pattern has it; runs of twice LONG characters or more are cut out.
WHITE = "\t-\r \x85\xa0  -     　"
LONG = 4096
_LONG, _RUN, _IS = re.compile(f"[{WHITE}]{{{LONG}}}"), re.compile(f"[{WHITE}]+"), re.compile(f"[{WHITE}]")
#: One text of so many is audited, and one of every batch at least; of a longer text a stretch of so many characters.
AUDITED, AUDIT_CHARS = 128, 1 << 14


def _byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies spell the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str = BYTE_BPE) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE file; its special tokens' strings are ids of their own, as the file says."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
        raise ValueError(f"{path} isn't a plain byte-level BPE")
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _stretches(text: str, special: tuple[str, ...]) -> Iterator[tuple[bool, str]]:
    """(whether it is one pre-token of white space, part) of the text, in order. A part's pre-tokens are those it has in the whole text."""
    done = at = 0
    while at + LONG <= len(text):  # a run of twice LONG characters holds all of one of these
        if _LONG.match(text, at):
            start, end = at, _RUN.match(text, at).end()
            while start > done and _IS.match(text, start - 1):
                start -= 1
            end -= end < len(text) and not text.startswith(special, end)  # the last character goes with a word that follows
            if start > done:
                yield False, text[done:start]
            yield True, text[start:end]
            done = end
            at += -(-(end - at) // LONG) * LONG
        else:
            at += LONG
    if done < len(text) or not text:
        yield False, text[done:]


def _joined(text: str, path: str, plain, special: tuple[str, ...] = ()) -> np.ndarray:
    if len(text) < LONG:
        return plain(text)
    parts = [np.array(byte_bpe(path)._encode_single_piece(part), dtype=np.uint32) if white else plain(part) for white, part in _stretches(text, special)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode(text: str, path: str = BYTE_BPE) -> np.ndarray:
    """The ids of a text as unsigned 32-bit numbers."""
    return _joined(text, path, lambda t: byte_bpe(path).encode_to_numpy(t, allowed_special="all"), tuple(byte_bpe(path).special_tokens_set))


def ordinary(text: str, path: str = BYTE_BPE) -> np.ndarray:
    """The ids of a text in which no string is special."""
    return _joined(text, path, lambda t: byte_bpe(path).encode_to_numpy(t, disallowed_special=()))


@functools.lru_cache(maxsize=4)
def library(path: str = BYTE_BPE, special: bool = True) -> Tokenizer:
    """The tokenizers library's own tokenizer of the file."""
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = not special
    return out


class ParityError(ValueError):
    """The two libraries give different ids."""


def audited(texts: list[str]) -> Iterator[tuple[int, str]]:
    """(place, text or a stretch of it) of the texts that are audited: chosen, as stretches are, by hashes alone."""
    sums = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
    least = min(range(len(texts)), key=sums.__getitem__, default=None)
    for i, (text, h) in enumerate(zip(texts, sums, strict=True)):
        if i == least or h % AUDITED == 0:
            at = (h // AUDITED) % max(1, len(text) - AUDIT_CHARS + 1)
            yield i, text[at : at + AUDIT_CHARS]


def audit(texts: list[str], path: str = BYTE_BPE, special: bool = True) -> None:
    """Holds the ids of the audited ones of a batch's texts against the tokenizers library's."""
    own = encode if special else ordinary
    for _, part in audited(texts):
        if library(path, special).encode(part, add_special_tokens=False).ids != own(part, path).tolist():
            raise ParityError(repr(part[:200]))
