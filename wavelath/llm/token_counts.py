"""Token counts by rank-synchronous merging of ragged numpy arrays.

A batch's new pre-tokens stand as rows of one flat array of symbols. In every
step each row looks up the ranks of its neighbouring pairs, takes its lowest
rank, and merges that pair's occurrences from the left, all rows at once; a row
leaves when no pair of it has a rank. The symbols that remain are its tokens. Ranks are looked up anew
only beside merges.

null text: empty, 0 bytes and 0 tokens. Very long texts: cut at white space; a very long word is a row like any other. Repeated rows: counted each. No rows: no rows. Only doc_id
and text are read, so further columns, whatever their names, don't matter. A vocabulary file that isn't plain
byte-level BPE is refused.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, with_default
from . import spans
from .tokens import RARE, WHITE

#: The byte-level pre-tokenizer's pattern (fixed value, from the vocabulary files' own description).
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(spare)
        spare += b not in plain
    return out


def check(spec: dict) -> None:
    """Refuses a vocabulary whose counts would differ from what is done here."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    cut = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    marks = all(not t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    if spec.get("normalizer") or not plain or not cut or not marks:
        raise ValueError("not a plain byte-level BPE vocabulary")


class Merges:
    """The merge table of a byte-level vocabulary file, and counts made with it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int64), made
        self.special_of = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.table = spans.Table(self._learn, self._forget)

    def _forget(self) -> None:
        self.known = np.zeros(0, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where a pair has none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], len(self.keys))

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        out = sizes.copy()
        none = len(self.keys)
        row = np.repeat(np.arange(len(raw)), sizes)
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        rank = np.full(len(sym), none, np.int64)
        changed = np.arange(len(sym))
        while len(sym) > 1:
            changed = changed[changed + 1 < len(sym)]
            inside = row[changed] == row[changed + 1]
            rank[changed] = none
            changed = changed[inside]
            rank[changed] = self.ranks(sym[changed], sym[changed + 1])
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(rank, heads)
            size = np.diff(np.r_[heads, len(row)])
            hit = np.flatnonzero((rank == np.repeat(least, size)) & (rank < none))
            if not len(hit):
                break
            # Of hits side by side (a a a) the first, third ... merge.
            run = np.r_[True, np.diff(hit) != 1]
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            out -= np.bincount(row[hit], minlength=len(out))
            stay = np.repeat(least < none, size)
            stay[hit + 1] = False
            rank[hit] = -1  # a mark: what stands beside a merge is looked up again
            rank[np.maximum(hit - 1, 0)] = -1
            row, sym, rank = row[stay], sym[stay], rank[stay]
            changed = np.flatnonzero(rank < 0)
            if len(rank):
                rank[-1] = none
        return out

    def _learn(self, new: list[bytes]) -> None:
        self.known = np.concatenate([self.known, self.pieces([p.decode("utf-8", "surrogatepass") for p in new])])

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece, of any length and white space."""
        words = [PATTERN.findall(p) for p in pieces]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for x in words for w in x], np.int64)
        ends = np.cumsum([len(x) for x in words])
        sums = np.concatenate([[0], np.cumsum(self.counts(list(number))[flat])]) if number else np.zeros(1, np.int64)
        return np.diff(sums[ends], prepend=0)

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string counts as one, and cuts the text before all else."""
        parts, owner = [], []
        out = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = self.special_of.split(t) if self.special else [t]
            out[k] = len(own) - 1
            parts += own
            owner += [k] * len(own)
        raws = [p.encode("utf-8", "surrogatepass") for p in parts]
        whole = {k for k, p in enumerate(parts) if len(raws[k]) >= spans.SPAN or RARE.search(p)}
        for k in whole:
            out[owner[k]] += self.pieces([parts[k]])[0]
        plain = [k for k in range(len(parts)) if k not in whole]
        for group in spans.grouped([raws[k] for k in plain]):
            raw, ends = spans.joined([raws[plain[k]] for k in group])
            start, stop = spans.pieces(raw)
            numbers = self.table.numbers(raw, start, stop)
            sums = np.concatenate([[0], np.cumsum(self.known[numbers])])[np.searchsorted(start, ends)]
            np.add.at(out, [owner[plain[k]] for k in group], np.diff(sums, prepend=0))
        return out.tolist()


_MERGES: dict[str, Merges] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs' key (as doc_id), n_bytes (UTF-8) and n_tokens under the byte-level vocabulary at path."""
    small_batches(docs.sparkSession)

    def run(batches):
        merges = _MERGES.setdefault(path, None) or _MERGES.update({path: Merges(path)}) or _MERGES[path]
        for b in batches:
            texts = with_default(b, "text")
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(merges.texts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.selectExpr(f"`{key}` as doc_id", f"`{text}` as text").mapInArrow(run, SCHEMA)
