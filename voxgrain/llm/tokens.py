"""Token ids of texts by a tokenizer file, as little-endian 32-bit bytes."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np

CACHED_PIECES = 900_000
"""About so many pieces of text have their ids remembered by a worker before it starts anew."""

RUN = 256
"""New words that are encoded in one call."""

WORD = re.compile(r"[^\s\0]+")
SIGNS = ".,;:!?*$#%"

BEFORE_BLANK = re.compile(r"(?<=\S)(?=[ \n])")
BLANK_AFTER_BLANK = re.compile(r"\s[ \n]")


class Encoder:
    """Encodes texts piece by piece and remembers the pieces.

    A text is cut before each blank or line break that follows a character other than white space.
    The tokenizers this is made for (byte-level and word-end BPE) never build a token across such a
    place, so the joined ids are those of the whole text. A text that holds the string of a special
    token is encoded as a whole, as the tokenizer takes it for that token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        # Pieces hold no special tokens, whatever their words.
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        # Byte-level vocabularies mark the first id of a word by its blank, word-end ones its last.
        tokens = self.tokenizer.get_vocab()
        starts, ends = ([i for t, i in tokens.items() if found(t)] for found in (lambda t: t[0] == "\u0120", lambda t: t.endswith("</w>")))
        self.at_start = not ends
        self.marked = np.zeros(max(tokens.values(), default=0) + 1, bool)
        self.marked[starts if self.at_start else ends] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [any(token in text for token in self.special) for text in texts]
        if not any(whole):
            return self._by_pieces(texts)
        plain = iter(self._by_pieces([t for t, special in zip(texts, whole) if not special]))
        return [np.array(self._exact.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if special else next(plain) for t, special in zip(texts, whole)]

    @functools.cached_property
    def _exact(self):
        """The tokenizer as its file has it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        pieces = [self._any(t) if BLANK_AFTER_BLANK.search(t) or "\0" in t else self._simple(t) for t in texts]
        known = self.known
        unknown = list(set().union(*pieces) - known.keys())
        if len(known) + len(unknown) > CACHED_PIECES:
            known.clear()
            unknown = list(set().union(*pieces))
        self._learn(unknown)
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def _learn(self, unknown: list[str]) -> None:
        """Remember the ids of new pieces; words are encoded many in a call."""
        others = []
        groups: dict[int, list[str]] = {}
        for piece in unknown:
            groups.setdefault(self._marks(piece), []).append(piece)
        for marks, words in groups.items():
            if not marks:
                others += words
                continue
            runs = [words[i:i + RUN] for i in range(0, len(words), RUN)]
            for start in range(0, len(runs), 64):
                some = runs[start:start + 64]
                for run, ids in zip(some, self._ids([" " + " ".join(run) for run in some])):
                    others += self._split(run, ids, marks)
        for start in range(0, len(others), 1024):
            some = others[start:start + 1024]
            told = [p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p for p in some]
            for piece, ids in zip(some, self._ids(told)):
                self.known[piece] = ids.tobytes()

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(found.ids, "<u4")

    def _marks(self, piece: str) -> int:
        """How many marked ids a word has at least, and as a rule at most; none if that is not known.

        Where ids mark a word's start, every run of characters that are not white space has one.
        Where they mark an end, letters have one, and signs behind them another.
        """
        if self.at_start:
            return int(WORD.fullmatch(piece) is not None)
        if piece.isalpha():
            return 1
        return 2 if piece.rstrip(SIGNS).isalpha() else 0

    def _split(self, run: list[str], ids: np.ndarray, marks: int) -> list[str]:
        """Remember each word's share of the ids of a run, or give the words back if the shares are not clear.

        Every word has at least ``marks`` marked ids; as many as that in all means no word has more.
        """
        places = np.flatnonzero(self.marked[ids])
        if len(places) != marks * len(run) or len(ids) and places[0 if self.at_start else -1] != (0 if self.at_start else len(ids) - 1):
            return run
        first = places if self.at_start else np.r_[0, places[marks - 1:-1:marks] + 1]
        data, cuts = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
        self.known.update(zip(run, map(data.__getitem__, map(slice, cuts, cuts[1:]))))
        return []

    # A piece is remembered without its leading blank; one that stands for itself has a zero in front.

    @staticmethod
    def _any(text: str) -> list[str]:
        return ["\0" + p for p in BEFORE_BLANK.split(text)]

    @staticmethod
    def _simple(text: str) -> list[str]:
        """The same cut where no blank follows white space, with fast string methods."""
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\0" + pieces[0]
        return pieces


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def forget() -> None:
    """Give up what this worker remembers of its tokenizers, when it goes on with other work."""
    encoder.cache_clear()
