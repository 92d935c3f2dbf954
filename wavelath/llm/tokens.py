"""Whole texts to token ids with the tokenizers library, each distinct piece encoded once.

Both tokenizers cut a text into pieces before they merge, and never merge across
white space. So texts are cut at white space in numpy, each distinct piece goes to
the library once per worker (kept by a 64-bit hash), and the ids of a text are its
pieces' ids in a row. A text that holds an opening of a special string, rare white
space, or over a megabyte goes to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from . import spans

#: Unicode's White_Space, which the libraries' \s means.
WHITE = " \t\n\x0b\x0c\r\x85\xa0  -     　"
ASCII = " \t\n\x0b\x0c\r"
#: White space that is cut at only by the library.
RARE = re.compile(f"[{WHITE.translate(dict.fromkeys(map(ord, ASCII)))}]")
OPENING = "<|"
#: Pieces encoded in one call.
GROUP = 2000


class Store:
    """Ragged rows of ids, grown a group at a time."""

    def __init__(self):
        self.ids, self.first, self.used, self.rows = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.rows + len(sizes) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[self.rows + 1 : self.rows + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used, self.rows = self.used + len(ids), self.rows + len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows end to end, and where each row ends."""
        first = self.first[rows]
        sizes = self.first[rows + 1] - first
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0)
        place += np.repeat(first - (ends - sizes), sizes)
        return self.ids[place], ends


class Encoder:
    """ids(texts): one uint32 array per text, equal to the library's ids for the whole text.

    words: the tokenizer drops white space, so that words alone are pieces.
    """

    def __init__(self, path: str, words: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cut = spans.words if words else spans.pieces
        self.words = words
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix("</w>"))  # a character of a byte-level token stands for a byte
        self.table = spans.Table(self._learn, self._forget)

    def _forget(self) -> None:
        self.store = Store()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        run = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [np.array(x.ids, np.uint32) for x in run(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Encodes pieces that the library cuts apart again side by side, others one by one."""
        fit = np.array([self.words or (p[0] == 32 and len(p) > 1) for p in new])
        rows, order = Store(), np.concatenate([np.flatnonzero(fit), np.flatnonzero(~fit)])
        beside, n = [new[k] for k in order.tolist()], int(fit.sum())
        for i in range(0, n, GROUP):
            rows.add(*(self._beside(beside[i : min(n, i + GROUP)])))
        if n < len(new):
            rows.add(*self._singly(beside[n:]))
        ids, ends = rows.take(np.argsort(order))
        self.store.add(ids, np.diff(ends, prepend=0))

    def _singly(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = self.encode([p.decode("utf-8", "surrogatepass") for p in part])
        return np.concatenate(rows), np.array([len(x) for x in rows])

    def _beside(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces encoded in one call, parted where the pieces' bytes end; one by one if that doesn't come out."""
        (ids,) = self.encode([(b" " if self.words else b"").join(part).decode("utf-8", "surrogatepass")])
        ends, have = np.cumsum([len(p) for p in part]), np.cumsum(self.width[ids])
        stop = np.searchsorted(have, ends)
        if len(ids) and have[-1] == ends[-1] and (have[stop] == ends).all():
            return ids, np.diff(stop + 1, prepend=0)
        return self._singly(part)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = {k for k, t in enumerate(texts) if OPENING in t or len(raws[k]) >= spans.SPAN or RARE.search(t)}
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for k in whole:
            (out[k],) = self.encode([texts[k]])
        plain = [k for k in range(len(texts)) if k not in whole]
        for group in spans.grouped([raws[k] for k in plain]):
            raw, ends = spans.joined([raws[plain[k]] for k in group])
            start, stop = self.cut(raw)
            ids, after = self.store.take(self.table.numbers(raw, start, stop))
            cuts = np.concatenate([[0], after])[np.searchsorted(start, ends)]
            for k, i, j in zip(group, np.concatenate([[0], cuts[:-1]]).tolist(), cuts.tolist(), strict=True):
                out[plain[k]] = ids[i:j]
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words: bool = False) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = Encoder(path, words)
    return _ENCODERS[path, words]


def vocabulary(name: str) -> str:
    """Where the box has a public vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
