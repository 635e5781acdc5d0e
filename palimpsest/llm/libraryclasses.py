"""What the tokenizer libraries hold each code point to be, found out by asking them.

The libraries' pattern engines, Python's `unicodedata` and the `regex` module each have tables of another Unicode
version, so the same pattern cuts some texts differently. Here each library's own engine is run over all code points;
its answers are what the operators go by. The driver asks, once a process, and sends the answers along with the tasks
(`packed`, `install`: some kB).
"""

from __future__ import annotations

import pickle
import zlib
from functools import lru_cache

import numpy as np
import regex

SIZE = 0x110000
OTHER, LETTER, NUMBER, SPACE = range(4)
PROPERTIES = {LETTER: r"\p{L}", NUMBER: r"\p{N}", SPACE: r"\s"}
#: Code points of each class, alike in all engines, that no pattern names: they stand in for others of their class.
STAND_INS = {LETTER: "é", NUMBER: "²", SPACE: "\u00a0", OTHER: "☃"}


@lru_cache(maxsize=1)
def every_character() -> str:
    """All code points but surrogates, in order."""
    return "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, SIZE)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _tiktoken_matches(pattern: str, text: str) -> str:
    """What the pattern engine of tiktoken finds in text, run together."""
    import tiktoken

    single = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(single.encode_ordinary(text)).decode()


def _tokenizers_pieces(pattern: str, text: str, keep: bool) -> list[str]:
    """What the pattern engine of tokenizers cuts text into: its matches, with `keep` also what lies between."""
    from tokenizers import Regex, pre_tokenizers

    cut = pre_tokenizers.Split(Regex(pattern), "isolated") if keep else pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    return [x for x, _ in cut.pre_tokenize_str(text)]


def _classes(matches) -> np.ndarray:
    out = np.zeros(SIZE, np.uint8)
    for k, pattern in PROPERTIES.items():
        out[code_points(matches(pattern))] = k
    return out


def _by_tokenizers() -> np.ndarray:
    """One pass cuts all code points into runs of one class, a second tells the classes of the runs' first ones."""
    runs = _tokenizers_pieces("|".join(f"(?:{p})+" for p in PROPERTIES.values()), every_character(), True)
    firsts, out = "".join(r[0] for r in runs), np.zeros(SIZE, np.uint8)
    for k, pattern in PROPERTIES.items():
        own = set("".join(_tokenizers_pieces(f"(?:{pattern})+", firsts, False)))
        out[code_points("".join(r for r in runs if r[0] in own))] = k
    return out


def _one_by_one(normalizer) -> dict[int, str]:
    """Code point to text, for each that a normalizer changes when it stands alone."""
    line = "\n".join(every_character().replace("\n", ""))
    done = normalizer.normalize_str(line).split("\n")
    return {ord(c): x for c, x in zip(line.split("\n"), done) if c != x}


def _unlike_python() -> np.ndarray:
    import unicodedata

    from tokenizers import normalizers

    low, nfc = _one_by_one(normalizers.Lowercase()), _one_by_one(normalizers.NFC())
    out = np.zeros(SIZE, bool)
    for c in every_character()[128:]:
        i, kind = ord(c), unicodedata.category(c)
        out[i] = kind[0] == "M" or kind == "Cn" or low.get(i, c) != c.lower() or nfc.get(i, c) != unicodedata.normalize("NFC", c)
    return out


ASKED = {
    "tiktoken": lambda: _classes(lambda p: _tiktoken_matches(p, every_character())),
    "tokenizers": _by_tokenizers,
    "regex": lambda: _classes(lambda p: "".join(regex.findall(f"(?:{p})+", every_character()))),
    "unlike_python": _unlike_python,
}
_KNOWN: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _KNOWN:
        _KNOWN[name] = ASKED[name]()
    return _KNOWN[name]


def packed(*names: str) -> bytes:
    """The named tables of this process, to be installed in others."""
    return zlib.compress(pickle.dumps({n: _table(n) for n in names}))


@lru_cache(maxsize=8)
def install(tables: bytes) -> None:
    for name, table in pickle.loads(zlib.decompress(tables)).items():
        _KNOWN.setdefault(name, table)


def classes(engine: str) -> np.ndarray:
    """The class of every code point in the pattern engine of tiktoken, tokenizers or regex."""
    return _table(engine)


def unlike_python() -> np.ndarray:
    """Code points for which Python's NFC or lower-casing is not known to be that of tokenizers.

    Those are the ones that either changes differently, or that Python doesn't know; and all marks, because their order
    and what they combine with depend on each library's own tables.
    """
    return _table("unlike_python")


class Alike:
    """Texts in which each code point that `regex` and a library hold to be of different classes has a stand-in.

    A pattern of L, N, S and plain ASCII then cuts the stand-in as that library cuts the text, at the same places.
    """

    def __init__(self, engine: str):
        own, other = classes(engine), classes("regex")
        self.differs = own != other
        self.table = {int(i): STAND_INS[int(own[i])] for i in np.flatnonzero(self.differs)}

    def __call__(self, text: str) -> str:
        if text.isascii() or not self.differs[code_points(text)].any():
            return text
        return text.translate(self.table)


@lru_cache(maxsize=None)
def alike(engine: str) -> Alike:
    return Alike(engine)


def properties_only(pattern: str) -> bool:
    """Whether a pattern asks for nothing but the properties above (and negations of them) and plain ASCII."""
    return pattern.isascii() and set(regex.findall(r"\\[a-zA-Z](?:\{[^}]*\})?", pattern)) <= {r"\p{L}", r"\p{N}", r"\s", r"\S", r"\r", r"\n", r"\t"} and "(?i" not in pattern
