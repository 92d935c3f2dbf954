"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters of WIDTH bytes run over the text at every STRIDE-th
byte, and overlapping chunks that cover the whole text pool each filter's
rectified response by its maximum. A hidden layer reads a chunk's maxima and how
full the chunk is; a document's features are the greatest and the mean of the hidden units over
its chunks, which a logistic unit combines into one probability. All layers
are learned here by Adam on a bounded sample: at most about SAMPLE labelled documents and SAMPLE_BYTES of
their texts, whole ones, in the order of a hash of their key. Scores read every byte of every text.

null or empty text: one chunk of padding, so a score like any other. Very long texts: in pieces of whole chunks. Documents
without a label are scored and not learned from. Repeated rows: scored each. Labels of
one kind alone: every score is 0.982 (label 1) or 0.018 (label 0); no labels: 0.5. No rows: no rows. Only
the named columns are read, so others, whatever their names, don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, with_default
from .lang_id import fold_of

#: Labelled documents to learn from, on average at most.
SAMPLE = 4000
#: Bytes of texts to learn from at most; they are held by the driver.
SAMPLE_BYTES = 64_000_000
DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 2, 20, 16
#: Filter positions in a chunk, and how far the next chunk starts.
CHUNK, STEP = 256, 224
EPOCHS, BATCH, RATE, DECAY = 8, 16, 0.01, 1e-3
PAD = 0
#: Bytes of a batch of texts scored at once.
AT_ONCE = 1 << 18


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray  # FILTERS
    inner: np.ndarray  # FILTERS + 1 x HIDDEN
    inner_bias: np.ndarray  # HIDDEN
    out: np.ndarray  # 2 * HIDDEN
    offset: np.ndarray  # 1

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.inner, self.inner_bias, self.out, self.offset]


def fresh(seed: int = 11) -> Network:
    r = np.random.default_rng(seed)
    f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    none = lambda n: np.zeros(n, np.float32)
    return Network(f(256, DIM, scale=0.5), f(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5), none(FILTERS), f(FILTERS + 1, HIDDEN, scale=(FILTERS / 2) ** -0.5), none(HIDDEN), f(2 * HIDDEN, scale=0.2), none(1))


def padded(text: str) -> np.ndarray:
    """A text's bytes, at least one filter wide and of whole strides."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(WIDTH, WIDTH + -(-(len(raw) - WIDTH) // STRIDE) * STRIDE)
    return np.concatenate([raw, np.full(n - len(raw), PAD, np.uint8)])


def responses(net: Network, raw: np.ndarray) -> np.ndarray:
    """Response of each filter at each position of raw (before bias and rectifier)."""
    e = net.embed[raw]
    n = (len(raw) - WIDTH) // STRIDE + 1
    view = np.lib.stride_tricks.as_strided(e, (n, WIDTH * DIM), (STRIDE * DIM * e.itemsize, e.itemsize), writeable=False)
    return view @ net.filters


def chunks(n: int) -> np.ndarray:
    """Starts of the chunks that cover n positions."""
    return np.arange(0, max(1, n - (CHUNK - STEP)), STEP)


def pooled(r: np.ndarray) -> np.ndarray:
    """Maxima of responses in each chunk."""
    starts = chunks(len(r))
    blocks = np.maximum.reduceat(r, starts, axis=0)
    # reduceat ends a block where the next begins: the overlap is added.
    for k in range(len(starts) - 1):
        np.maximum(blocks[k], r[starts[k + 1] : starts[k] + CHUNK].max(0), out=blocks[k])
    return blocks


def inputs(maxima: np.ndarray, positions: int) -> np.ndarray:
    """What the hidden layer reads of each chunk."""
    fill = np.minimum(CHUNK, positions - chunks(positions)) / CHUNK
    return np.concatenate([maxima, fill[:, None].astype(maxima.dtype)], 1)


def features(net: Network, raw: np.ndarray) -> np.ndarray:
    """Greatest and mean of each hidden unit; long texts go through in pieces of whole chunks."""
    positions = (len(raw) - WIDTH) // STRIDE + 1
    span = AT_ONCE // STEP // STRIDE * STEP
    best = []
    for at in range(0, max(1, positions - (CHUNK - STEP)), span):
        part = raw[at * STRIDE : (min(positions, at + span + CHUNK - STEP) - 1) * STRIDE + WIDTH]
        best.append(pooled(responses(net, part)))
    h = np.maximum(inputs(np.maximum(np.concatenate(best) + net.bias, 0), positions) @ net.inner + net.inner_bias, 0)
    return np.concatenate([h.max(0), h.mean(0)])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score(net: Network, text: str) -> float:
    return float(sigmoid(features(net, padded(text)) @ net.out + net.offset[0]))


def gradients(net: Network, raw: np.ndarray, label: int) -> list[np.ndarray]:
    """Of the logistic loss on one text; only positions that a maximum chose take part."""
    r = responses(net, raw)
    starts = chunks(len(r))
    where = np.stack([s + r[s : s + CHUNK].argmax(0) for s in starts])
    cols = np.arange(FILTERS)
    top = r[where, cols] + net.bias
    z = inputs(np.maximum(top, 0), len(r))
    h = np.maximum(z @ net.inner + net.inner_bias, 0)
    feats = np.concatenate([h.max(0), h.mean(0)])
    d = sigmoid(feats @ net.out + net.offset[0]) - label
    g_h = np.repeat((d * net.out[HIDDEN:] / len(starts))[None], len(starts), 0)
    g_h[h.argmax(0), np.arange(HIDDEN)] += d * net.out[:HIDDEN]
    g_h *= h > 0
    g_m = (g_h @ net.inner[:-1].T) * (top > 0)
    k, f = np.nonzero(g_m)
    g, at = g_m[k, f], where[k, f] * STRIDE
    seen = raw[at[:, None] + np.arange(WIDTH)]
    g_filters, g_embed, g_bias = np.zeros_like(net.filters), np.zeros_like(net.embed), np.zeros_like(net.bias)
    np.add.at(g_filters.T, f, g[:, None] * net.embed[seen].reshape(len(at), WIDTH * DIM))
    np.add.at(g_embed, seen.ravel(), (g[:, None] * net.filters.T[f]).reshape(-1, DIM))
    np.add.at(g_bias, f, g)
    return [g_embed, g_filters, g_bias, z.T @ g_h, g_h.sum(0), (d * feats).astype(np.float32), np.array([d], np.float32)]


def train(rows: list[tuple[str, int]], seed: int = 11) -> Network:
    """A network learned from (text, label 0 or 1); of a single label, or none, a constant one."""
    net = fresh(seed)
    labels = [y for _, y in rows]
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.offset[:] = 0.0 if not rows else (4.0 if labels[0] else -4.0)
        return net
    data = [(padded(t), y) for t, y in rows]
    share = sum(labels) / len(labels)
    weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    order = np.random.default_rng(seed)
    first, second, step = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()], 0
    total = EPOCHS * -(-len(data) // BATCH)
    for _ in range(EPOCHS):
        mixed = order.permutation(len(data))
        for b in range(0, len(data), BATCH):
            picked = mixed[b : b + BATCH]
            sums = [np.zeros_like(a) for a in net.arrays()]
            for k in picked:
                raw, y = data[k]
                for s, g in zip(sums, gradients(net, raw, y), strict=True):
                    s += weight[y] * g / len(picked)
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for a, g, m, v in zip(net.arrays(), sums, first, second, strict=True):
                g = g + DECAY * a
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> list[tuple[str, int]]:
    """A bounded sample of (text, label) in a fixed order; at most about sample rows reach the driver, so they are broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, sample / n) if n else 0.0
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # The sample alone, in one order, until the bytes are reached.
    order = Window.orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", "text", "y")
    rows = rows.withColumn("__sum", F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__sum") <= SAMPLE_BYTES).collect()
    return [(r["text"], int(r["y"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"], r["y"]))]


def classify(docs: DataFrame, net: Network, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and score of every text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([score(net, t) for t in with_default(b, "text")], pa.float64())], ["doc_id", "score"])

    return docs.selectExpr(f"`{key}` as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned from rows whose crc32 modulo 3 is not 1."""
    held = F.coalesce(fold_of(F.col("doc_id"), 3), F.lit(0)) == 1
    net = train(labelled(docs, labels.where(~held)))
    rows = classify(docs, net)
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
