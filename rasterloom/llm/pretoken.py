"""Vectorised pre-tokenisation by the public byte-level BPE pattern.

The pattern's alternatives are contractions, then runs of letters, numbers or other marks with one optional blank
before them, then white space (its last character stays back when text follows). Each is found from runs of one
character class over all texts of a part at once.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

from .common import U64, mix64, span_hashes

LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3


@cache
def classes() -> np.ndarray:
    """Class of every code point, from the regex library's own tables."""
    out = np.full(0x110000, OTHER, np.uint8)
    for at in range(0, len(out), 1 << 14):  # block by block, so little memory is held at once
        every = "".join(chr(c) for c in range(at, min(at + (1 << 14), len(out))) if not 0xD800 <= c < 0xE000)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
            out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    return out


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens of a part (with the end of the bytes last), and each text's offsets among them."""
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    head = np.flatnonzero((data & 0xC0) != 0x80)  # byte position of each character
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    kind = classes()[cp]
    coff = np.searchsorted(head, off)  # each text's first character
    new_text = np.zeros(n + 1, bool)
    new_text[coff] = True
    run = np.ones(n, bool)  # a run of one class begins
    run[1:] = (kind[1:] != kind[:-1]) | new_text[1:n]
    cut = run.copy()
    space = kind == BLANK
    last = np.ones(n, bool)  # last character of its run
    last[:-1] = run[1:]
    # the last blank of a run leaves the run if text follows; a plain blank then joins what follows
    follows = np.zeros(n, bool)
    follows[:-1] = ~new_text[1:n]
    leave = np.flatnonzero(space & last & follows)
    cut[leave] = True
    joins = leave[cp[leave] == 32]
    cut[joins + 1] = False
    # contractions: a lone apostrophe at the start of a match, then one of the endings
    lone = np.flatnonzero((cp == 39) & run & last & follows)
    if len(lone):
        before = np.zeros(len(lone), bool)
        has = lone > 0
        before[has] = (cp[lone[has] - 1] == 32) & ~new_text[lone[has]]
        lone = lone[~before]
        pad = np.concatenate((cp, np.zeros(3, np.uint32)))
        stop = np.append(coff[1:], n)[np.searchsorted(coff, lone, "right") - 1]
        a, b = pad[lone + 1], np.where(lone + 2 < stop, pad[lone + 2], 0)
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((one, 1), (two & ~one, 2)):
            p = lone[hit]
            cut[p + 1] = False
            end = p + 1 + size
            # what is left of the letters begins anew
            inside = end[end < n]
            cut[inside] |= ~new_text[inside] & (kind[inside] == LETTER)
    starts = np.flatnonzero(cut)
    return np.append(head[starts], n_bytes), np.searchsorted(starts, coff)


def pretoken_keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A key for each pre-token: the bytes and the length themselves, mixed by a bijection, for up to seven bytes; a hash
    for longer ones."""
    if len(starts) < 2:
        return np.zeros(0, U64)
    s, size = starts[:-1], np.diff(starts)
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))  # from each byte
    short = np.minimum(size, 7).astype(U64)
    keys = mix64((eight[s] & ((U64(1) << (short * U64(8))) - U64(1))) | (short << U64(56)))
    long = np.flatnonzero(size > 7)
    keys[long] = span_hashes(data, s[long], starts[long + 1])
    return keys
