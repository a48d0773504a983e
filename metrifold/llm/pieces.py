"""Splitting texts where no pre-token can reach across, and worker caches over the parts.

In the pre-token pattern of the byte-level vocabularies white space only ever begins a pre-token or stands
alone. So a single space between two other characters always begins one, line feeds between two others stand
apart, and so does one mark of punctuation after a letter and before white space. A text can be cut there and its
parts encoded one by one, those after a space with the space that leads them. A part that is empty, or has white space (in the wide sense of ``str.isspace``) at its
edge or a special token's opening anywhere, is not clean: its text takes the whole-text way.

Caches are bounded in bytes, and a worker holds those of one operator at a time (``hold``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc

#: The pattern for which the cuts are proven; fixed value.
SAFE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MARK = r"([A-Za-zÀ-ÖØ-öø-ɏΑ-Ρα-ωА-я])([.,!?;:])( |\n|$)"
_FEED = r"(\n+)(\S)"
_ENTRY = 160  # bytes of an entry beside its value

_held: dict = {}


def hold(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this worker until another key is asked for; caches of other operators are let go."""
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        if key:
            _held[key] = make()
    return _held.get(key)


def let_go() -> None:
    """Drop whatever caches this worker still holds."""
    hold((), lambda: None)


class Bounded(dict):
    """A cache in two generations of at most ``mb`` megabytes together.

    A key is kept when it is met for the second time (by a filter of ``hash`` bits), so that what occurs once does
    not drive out the rest; keys of over 64 characters are never kept. With ``at_once`` a key is kept when it is first met,
    for a tier below another cache: there the second meeting finds it.
    """

    def __init__(self, mb: float, value_bytes: int = 40, at_once: bool = False):
        super().__init__()
        self.at_once = at_once
        self.most, self.old, self.met = int(mb * (1 << 19)) // (_ENTRY + value_bytes), {}, bytearray(1 << 20)

    def find(self, key: str):
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self[key] = value
        return value

    def keep(self, key: str, value) -> None:
        at = hash(key) & 0xFFFFF
        if not self.at_once and not self.met[at]:
            self.met[at] = 1
        elif len(key) <= 64:
            if len(self) >= self.most:
                self.old, self.met = dict(self), bytearray(1 << 20)
                self.clear()
            self[key] = value


def _marked(texts: list[str]) -> list[str]:
    """The texts with a space before and after what can be cut off a part: \\0 leads marks and line feeds, \\1 what no space led."""
    cut = pc.replace_substring_regex(pa.array(texts, pa.string()), _MARK, "\\1 \0\\2\\3")
    return pc.replace_substring_regex(cut, _FEED, " \0\\1 \1\\2").to_pylist()


class PartCache:
    """Values of texts' parts. ``led`` gives the values of parts that a space leads, in order, ``bare`` that of one that none leads, ``add`` the value of several together.

    ``table`` is a first tier of led parts that is never evicted.
    """

    def __init__(self, led: Callable[[list[str]], list], bare: Callable[[str], Any], add: Callable[[list], Any], mb: float = 48, special: str = "<|", table: dict | None = None):
        self.led, self.bare, self.add, self.special, self.table = led, bare, add, special, table
        self.cache = Bounded(mb)

    def _clean(self, part: str) -> bool:
        if part[:1] == "\0":
            return True
        part = part.removeprefix("\1")
        return bool(part) and not part[0].isspace() and not part[-1].isspace() and self.special not in part

    def _single(self, part: str):
        """The value of a part that begins with \\0 or \\1; of several line feeds the last is a pre-token of its own."""
        if part[0] == "\1" or len(part) == 2:
            return self.bare(part[1:])
        return self.add([self.bare(part[1:-1]), self.bare(part[-1])])

    def _rows(self, texts: tuple[str, ...]) -> list[list | None]:
        cache = self.cache
        near = (self.table or cache).get
        out: list[list | None] = []
        gaps: list[tuple[list, int, str]] = []
        want: dict[str, Any] = {}
        for text, marked in zip(texts, _marked(texts), strict=True):
            parts = ("\1" + marked).split(" ")
            row: list | None = list(map(near, parts))
            if "\0" in text or "\1" in text:
                row = None
            elif None in row:
                for i in [i for i, value in enumerate(row) if value is None]:
                    part = parts[i]
                    value = cache.find(part)
                    if value is not None:
                        row[i] = value
                    elif part in want or self._clean(part):
                        want[part] = None
                        gaps.append((row, i, part))
                    else:
                        row = None
                        break
            out.append(row)
        led = [part for part in want if part[0] not in "\0\1"]
        want |= zip(led, self.led(led) if led else (), strict=True)
        for part, value in want.items():
            if value is None:
                want[part] = value = self._single(part)
            cache.keep(part, value)
        for row, i, part in gaps:
            row[i] = want[part]
        return out

    def values(self, texts: list[str], at_once: int = 64) -> Iterator[Any]:
        """The value of each text, None where it can't be cut."""
        for some in batched(texts, at_once):
            yield from (None if row is None else self.add(row) for row in self._rows(some))
