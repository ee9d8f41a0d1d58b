"""Texts as stretches without white space, and these as parts that a vocabulary encodes each on its own; each is looked up once for a batch.

Arrow splits the texts of a batch and numbers their different parts, so Python handles only parts that are new to the worker; everything for each
word of a text is a gather over arrays.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern that a vocabulary file must have for its texts to part here, and its normalisers. Fixed values.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
#: Letters below U+0180 compose with nothing inside a word and have a lower case of one letter, but for the dotted capital I.
PLAIN = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Letters with punctuation behind: two parts. Apostrophes may begin a part with letters, angle brackets a special token.
WORD = f"^(?P<word>[{PLAIN}]+)(?P<tail>[!\"#$%&()*+,\\-./:;=?@\\[\\\\\\]^_`{{|}}~]*)$"


def apart(library) -> None:
    """Refuses a `tokenizers` Tokenizer whose texts don't part as they do here."""
    normal, split = (json.loads(s.__getstate__()) if s else {} for s in (library.normalizer, library.pre_tokenizer))
    steps, first = normal.get("normalizers", []), (split.get("pretokenizers") or [split])[0]
    fine = [s["type"] for s in steps] == NORMALISERS and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
    fine &= first.get("type") == "Split" and first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
    if not fine or any(t.content[0] != "<" or any(c.isspace() for c in t.content) or t.lstrip or t.rstrip or t.single_word for t in library.get_added_tokens_decoder().values()):
        raise ValueError("this vocabulary's texts part in another way; files with the pattern and the normalisers named in stretches.py can be read")


def _different(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(where each text's parts begin and end, n + 1 places; numbers of the parts, in order; the different parts). Null texts are empty; a part may be empty."""
    cut = pc.ascii_split_whitespace(texts.fill_null(""))
    ends = cut.offsets.to_numpy()
    number, stretches = _different(cut.values.slice(ends[0], ends[-1] - ends[0]))
    found = pc.extract_regex(stretches, WORD)
    words = pc.if_else(found.is_valid(), pc.utf8_lower(pc.struct_field(found, "word")), stretches)
    part, parts = _different(pa.concat_arrays([words, pc.fill_null(pc.struct_field(found, "tail"), "")]))
    pairs = part.reshape(2, -1).T[number]
    return 2 * (ends.astype(np.int64) - ends[0]), pairs.ravel(), parts.to_pylist()


class Codes:
    """Arrays of numbers for parts, as one flat store; the first `most` parts stay in it, others last for a batch."""

    def __init__(self, make: Callable[[list[str]], Iterable[np.ndarray | list[int]]], most: int = 120_000):
        self.make, self.most = make, most
        self.place: dict[str, int] = {}
        self.starts, self.counts, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count) of each part in the flat store, and the store."""
        at = np.fromiter(map(self.place.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.starts[at], self.counts[at], self.flat
        words = [parts[k] for k in new.tolist()]
        made = list(self.make(words))
        counts = np.fromiter(map(len, made), np.int32, len(made))
        flat = np.concatenate([np.asarray(x, np.uint32) for x in made]) if len(made) < 64 else np.fromiter((i for x in made for i in x), np.uint32, int(counts.sum()))
        starts = (len(self.flat) + np.concatenate([[0], np.cumsum(counts)[:-1]])).astype(np.int32)
        at[new] = len(self.starts) + np.arange(len(new))
        every = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])
        room = min(self.most - len(self.place), len(words))
        if room > 0:
            self.place.update(zip(words[:room], range(len(self.starts), len(self.starts) + room)))
            held = len(self.flat) + int(counts[:room].sum())
            self.starts, self.counts, self.flat = every[0][: len(self.starts) + room].copy(), every[1][: len(self.counts) + room].copy(), every[2][:held].copy()
        return every[0][at], every[1][at], every[2]


def gathered(ends: np.ndarray, numbers: np.ndarray, starts: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each text's codes begin and end, the codes of all texts)."""
    n = counts[numbers]
    reach = np.zeros(len(n) + 1, np.int32)  # a batch is bounded in bytes, so 32 bits hold its number of codes
    np.cumsum(n, out=reach[1:])
    place = np.repeat(starts[numbers] - reach[:-1], n)
    place += np.arange(reach[-1], dtype=np.int32)
    return reach[ends], flat[place]
