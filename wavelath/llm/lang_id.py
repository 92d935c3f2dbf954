"""Language identification by rank-order profiles of character n-grams.

A profile is the most frequent 1- to 3-grams of a language in rank order. A
document's own most frequent n-grams are compared with each profile by the
out-of-place distance: the sum of the differences of ranks, PROFILE for an n-gram
that the profile lacks. The nearest language wins, ties by the language's name.

Characters are folded: letters of lower case, all else a space; an n-gram is named by
its code points, 21 bits each, so that letters of every script stay apart. Profiles are
learned from a bounded sample: at most about SAMPLE documents a language, chosen
by a hash of their key; every document is scored over its whole text. A document meets only the profiles
that hold its n-grams, so the work doesn't grow with the number of languages.

null text, empty text or no letter: und, score 0. null lang: not learned from. Very long texts: read in parts, counts summed.
Repeated rows: scored each. No documents to learn from: und for all. No rows: no rows. Only
the named columns are read, so others, whatever their names, don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged, with_default

#: Documents of one language to learn from, on average at most.
SAMPLE = 2000
PROFILE = 400
#: n-grams of a document that are compared.
TOP = 300
#: Bits of a code point, the code of what is no letter, and codes of a text that are counted at once.
BITS, BLANK, SPAN = 21, 1, 1 << 20
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def codes(text: str) -> np.ndarray:
    """Code points of a text's letters, one BLANK around each run of them; empty without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[c], c, np.uint32(BLANK))
    c = np.concatenate([[BLANK], c, [BLANK]]).astype(np.uint32)
    keep = (c[1:] > BLANK) | (c[:-1] > BLANK)
    c = np.concatenate([c[:1], c[1:][keep]])
    return c if len(c) > 1 else c[:0]


def summed(ids: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and the sums of n (1 each) over them."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n is None:
        ids = np.sort(ids)
    else:
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], n[order]
    heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[heads], np.diff(np.r_[heads, len(ids)]) if n is None else np.add.reduceat(n, heads)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams with a letter and how often each occurs."""
    c = codes(text).astype(np.int64)
    found = []
    for at in range(0, len(c), SPAN):
        own = c[at : at + SPAN + 2]
        two = own[:-1] << BITS | own[1:]
        three = two[:-1] << BITS | own[2:]
        one = own[:SPAN]
        found.append(summed(np.concatenate([one[one > BLANK], two[:SPAN], three[:SPAN]])))
    if len(found) == 1:
        return found[0]
    return summed(*(np.concatenate([f[k] for f in found]) for k in (0, 1))) if found else summed(np.zeros(0, np.int64))


def ranked(ids: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """The top n-grams by falling count, ties by code."""
    return ids[np.argsort(-n, kind="stable")[:top]]


def sampled(docs: DataFrame, key: str, most: int) -> DataFrame:
    """Rows (lang, ...) of each language with probability most / its rows, by a hash of the key."""
    sizes = docs.groupBy("lang").agg((F.lit(float(most)) / F.count("*")).alias("__share"))
    chance = F.pmod(F.xxhash64(key, F.lit("profile")), F.lit(1 << 30)) / float(1 << 30)
    # Written first: one row a language, of a size that is known when the join is planned, so that texts aren't shuffled for it.
    return docs.withColumn("__chance", chance).join(staged(sizes, "languages"), "lang").where(F.col("__chance") < F.col("__share"))


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Each language's n-grams in rank order, from rows with a language."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(key).alias("__key"))
    rows = sampled(known, "__key", sample).select("lang", "text")

    def run(batches):
        for b in batches:
            own: dict[str, list] = {}
            for name, t in zip(b.column("lang").to_pylist(), with_default(b, "text"), strict=True):
                own.setdefault(name, []).append(grams(t))
            for name, parts in own.items():
                ids, n = summed(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # PROFILE rows a language are all that goes to the driver.
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE).orderBy("lang", "rank").select("lang", "gram").collect()
    out: dict[str, list] = {}
    for r in best:
        out.setdefault(r["lang"], []).append(r["gram"])
    return {name: np.array(x, np.int64) for name, x in out.items()}


class Profiles:
    """All profiles as one ascending array of n-grams, with language and rank of each."""

    def __init__(self, learned: dict[str, np.ndarray]):
        self.names = sorted(learned)
        gram = np.concatenate([np.zeros(0, np.int64), *(learned[n] for n in self.names)])
        owner = np.repeat(np.arange(len(self.names)), [len(learned[n]) for n in self.names])
        rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(learned[n])) for n in self.names)])
        order = np.argsort(gram, kind="stable")
        self.gram, self.owner, self.rank = gram[order], owner[order], rank[order]

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of each profile to n-grams in rank order."""
        first, last = np.searchsorted(self.gram, own, "left"), np.searchsorted(self.gram, own, "right")
        n = last - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        near = PROFILE - np.minimum(np.abs(self.rank[at] - np.repeat(np.arange(len(own)), n)), PROFILE)
        return PROFILE * len(own) - np.bincount(self.owner[at], near, len(self.names)).astype(np.int64)

    def predict(self, text: str) -> tuple[str, float]:
        """The language and how near it is: 1 less its distance over the greatest possible one."""
        own = ranked(*grams(text), TOP)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        gap = self.distances(own)
        best = int(gap.argmin())
        return self.names[best], 1.0 - float(gap[best]) / (PROFILE * len(own))


def identify(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score of every text."""
    small_batches(docs.sparkSession)

    def run(batches):
        profiles = Profiles(learned)
        for b in batches:
            found = [profiles.predict(t) for t in with_default(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr(f"`{key}` as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents whose crc32 modulo 4 is not 2."""
    fold = F.coalesce(fold_of(F.col("doc_id"), 4), F.lit(0))
    learned = learn(docs.where(fold != 2))
    rows = identify(docs, learned)
    return rows.select("doc_id", (F.coalesce(fold_of(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")
