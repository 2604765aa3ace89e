"""Splits text into chunks that byte-level BPE can encode one by one, and remembers their ids.

The pre-token pattern of the vocabulary joins a space only to what follows it, a white-space run
gives up its last character before anything else, and letters never join with what is not a letter
(contractions start at an apostrophe). So a cut before a space that follows other than white space,
a cut beside a white-space run, and a cut between a Latin letter and one of ``PUNCTUATION`` always
fall between two pre-tokens. Chunks cut there are encoded alone, with the same ids, and a corpus
has few distinct ones. The memory is bounded to ``MEMORY`` chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: Unicode's White_Space, as a class of the re module.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f"
PUNCTUATION = ".,;:!?#$%&*|"
CHUNK = re.compile(
    f" ?[{LETTERS}]+(?=[{SPACE}{PUNCTUATION}]|\\Z)"
    f"|(?<=[{LETTERS}])[{PUNCTUATION}]+(?=[{SPACE}]|\\Z)"
    f"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
MEMORY = 1_000_000
LONG = 64


class Memo:
    """ids (little-endian unsigned 32-bit, as bytes) of a chunk, by an encoder of many chunks at a time.

    Two generations: what has not been met since the younger one was begun goes when it is full.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], memory: int = MEMORY):
        self.encode, self.memory = encode, memory
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        parts = CHUNK.findall(text)
        found = list(map(self.young.get, parts))
        if None not in found:
            return b"".join(found)
        places = [i for i, x in enumerate(found) if x is None]
        missed = dict.fromkeys([parts[i] for i in places])
        known = {p: x for p in missed if (x := self.old.get(p)) is not None}
        new = [p for p in missed if p not in known]
        known.update(zip(new, self.encode(new)))
        for i in places:
            found[i] = known[parts[i]]
        if len(self.young) + len(known) > self.memory // 2:
            self.old, self.young = self.young, {}
        if len(known) <= self.memory // 2:
            self.young.update((p, v) for p, v in known.items() if len(p) <= LONG)
        return b"".join(found)
