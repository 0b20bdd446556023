"""Where the public vocabulary files are, and the byte alphabet of byte-level vocabularies."""

from __future__ import annotations

import functools


def vocab_path(name: str) -> str:
    """The installed file of a public tokenizer; looked up on the machine that reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_alphabet() -> tuple[str, ...]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that Latin-1 prints stand for themselves; the others take the code
    points from 256 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return tuple(chr(b if b in printable else next(spare)) for b in range(256))


def spelled(data: bytes) -> str:
    alphabet = byte_alphabet()
    return "".join([alphabet[b] for b in data])
