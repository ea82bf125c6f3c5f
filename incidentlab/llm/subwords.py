"""Encoders of the public tokenizer files, and the bytes that their ids stand for.

Special tokens are never added, and their strings inside a text are ordinary text.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable

Encode = Callable[[str], list[int]]

#: Texts that both libraries of byte-level BPE cut at the same places, whatever their Unicode tables.
_LATIN = re.compile("[\t\n\r\x20-\x7e¡-ſ]*")
_loaded: dict = {}


def is_latin(text: str) -> bool:
    return _LATIN.fullmatch(text) is not None


def byte_level(tokenizer: str, ranks: str | None = None, pattern: str | None = None) -> Encode:
    """Text to ids of a tokenizer file. With ``ranks`` (the same vocabulary in the other library's
    format) and its ``pattern``, plain Latin texts are encoded at a third of the time."""
    if (tokenizer, ranks) not in _loaded:
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(tokenizer)
        plain.encode_special_tokens = True
        fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ordinary", pat_str=pattern, mergeable_ranks=merges,
                                     special_tokens={})

        def encode(text: str) -> list[int]:
            if fast and _LATIN.fullmatch(text):
                return fast.encode_ordinary(text)
            return plain.encode(text, add_special_tokens=False).ids

        _loaded[tokenizer, ranks] = encode
    return _loaded[tokenizer, ranks]


def byte_level_spelling(tokenizer: str) -> list[bytes]:
    """The bytes of every id. Byte-level entries write the bytes of visible characters as these
    characters and the others, in order, as the characters from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(tokenizer) as file:
        vocabulary = json.load(file)["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, number in vocabulary.items():
        out[number] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else (
            entry.encode())
    return out


def pieces(model: str) -> Encode:
    """Text to ids of a piece model."""
    if model not in _loaded:
        import sentencepiece

        _loaded[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _loaded[model].encode


def piece_spelling(model: str) -> list[bytes]:
    """The bytes of every piece: U+2581 stands for a space, ``<0xHH>`` for the byte HH."""
    pieces(model)
    loaded = _loaded[model]
    out = []
    for number in range(loaded.get_piece_size()):
        piece = loaded.id_to_piece(number)
        out.append(bytes([int(piece[3:5], 16)]) if loaded.is_byte(number)
                   else piece.replace("▁", " ").encode())
    return out
