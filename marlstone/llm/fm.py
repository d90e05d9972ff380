"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2), put through a
logistic function: all pairwise interactions of rank ``RANK`` in time linear in the features.  Learning
takes at most ``max_rows`` labelled rows (a documented bound; the rows of least hash, so the choice does
not depend on the partitions) and runs on the driver over their feature indices, never over texts.

Defined results: a null text counts as empty and is scored; null ids keep their row, and are not held
out; repeated ids give repeated rows; a label row repeated counts once, conflicting ones as the larger;
without labels of both classes every score is the share of label 1, or 0.5.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _base as B

WORD_BITS, RANK, BINS = 17, 6, 24
MAX_ROWS, EPOCHS, BATCH, RATE, DECAY = 12_000, 8, 64, 0.08, 1e-4


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:  # about 30 MB; several workers share an executor
            self.clear()
        slot = self[word] = xxhash.xxh64_intdigest(word) & ((1 << WORD_BITS) - 1)
        return slot


_SLOTS = _Slots()
_KEEP = {name: bytes(sorted(set(range(256)) - set(chars))) for name, chars in {"symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digit": b"0123456789", "stop": b".?", "comma": b",;:", "shout": b"!", "bar": b"|", "high": bytes(range(128, 256)), "url": b"/@"}.items()}


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(2 * np.log2(1 + x)))


def _share_bin(x: float) -> int:
    """Shares on a scale that is fine near 0."""
    return min(BINS - 1, int(BINS * max(0.0, x) ** 0.4))


def structure(text: bytes, words: list[bytes]) -> list[int]:
    """The bin of each statistic."""
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    out = [_log_bin(len(words)), _log_bin(len(lines)), min(BINS - 1, size // n)]
    out += [_share_bin(len(text.translate(None, _KEEP[k])) / size) for k in _KEEP]
    out += [_share_bin(1 - len(set(lines)) / max(1, len(lines))), _share_bin(1 - len(counts) / n), _share_bin(max(counts.values(), default=0) / n)]
    pairs = len(set(zip(words, words[1:], strict=False)))
    out += [_share_bin(1 - pairs / max(1, n - 1)), _share_bin(sum(w[-1:] in b".!?" for w in words) / n), _log_bin(n / max(1, len(lines)))]
    return out


N_STATS = len(structure(b"a b", [b"a", b"b"]))
META_AT = (1 << WORD_BITS) + N_STATS * BINS
SIZE = META_AT + (1 << 12)


def features(text: str | None, meta: list) -> tuple[np.ndarray, np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    slots = {_SLOTS[w] for w in set(raw.lower().split())}
    idx = np.fromiter(slots, np.int32, len(slots))
    idx.sort()
    bins = [(1 << WORD_BITS) + i * BINS + b for i, b in enumerate(structure(raw, words))]
    for i, m in enumerate(meta):
        if m is not None:
            name = f"{i}:{_log_bin(m)}" if isinstance(m, int | float) and not isinstance(m, bool) else f"{i}:={m}"
            bins.append(META_AT + (xxhash.xxh64_intdigest(name.encode()) & 4095))
    val = np.r_[np.full(len(idx), 1 / np.sqrt(max(1, len(idx))), np.float32), np.full(len(bins), 1 / np.sqrt(len(bins)), np.float32)]
    return np.r_[idx, np.array(bins, np.int32)].astype(np.int32), val


class Machine:
    """Parameters of about 4 MB, sent to every executor."""

    def __init__(self, base: float = 0.5):
        self.w0 = float(np.log(base / (1 - base)))
        self.w = np.zeros(SIZE, np.float32)
        self.v = np.random.default_rng(7).normal(0, 0.02, (SIZE, RANK)).astype(np.float32)
        self.fixed = True

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.v[idx] * val[:, None]
        s = np.add.reduceat(x, starts, axis=0)
        z = self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * (s * s - np.add.reduceat(x * x, starts, axis=0)).sum(1)
        return z.astype(np.float64), x, s

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.fixed:
            return np.full(len(rows), 1 / (1 + np.exp(-self.w0)))
        out = []
        for idx, val in rows:  # one text at a time: its score cannot depend on its neighbours, and memory is bounded
            out.append(self.raw(idx, val, np.zeros(1, np.int64))[0][0])
        return 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -40, 40)))

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
        if len(set(y.tolist())) < 2:
            return self
        self.fixed = False
        gw, gv, g0 = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                idx, val = (np.concatenate([rows[i][k] for i in own]) for k in (0, 1))
                lens = np.array([len(rows[i][0]) for i in own])
                z, x, s = self.raw(idx, val, np.cumsum(lens) - lens)
                g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]).astype(np.float32) / len(own)
                each = np.repeat(g, lens) * val
                dv = each[:, None] * (np.repeat(s, lens, axis=0) - x)
                used, where = np.unique(idx, return_inverse=True)
                sw, sv = np.zeros(len(used), np.float32), np.zeros((len(used), RANK), np.float32)
                np.add.at(sw, where, each)
                np.add.at(sv, where, dv)
                sw += DECAY * self.w[used]
                sv += DECAY * self.v[used]
                gw[used] += sw * sw
                gv[used] += sv * sv
                g0 += float(g.sum()) ** 2
                self.w[used] -= RATE * sw / np.sqrt(gw[used])
                self.v[used] -= RATE * sv / np.sqrt(gv[used])
                self.w0 -= RATE * float(g.sum()) / np.sqrt(g0)
        return self


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), max_rows: int = MAX_ROWS) -> Machine:
    """Learn from the labelled rows that are not held out, ``max_rows`` of them at most."""
    B.tune(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(m).alias(f"meta{i}") for i, m in enumerate(metadata)))
    picked = picked.join(F.broadcast(known), "id").select("id", "y", "text", *(f"meta{i}" for i in range(len(metadata))))  # at most max_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            idx = [features(t, list(m))[0].tobytes() for t, *m in zip(*cols[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(idx, pa.binary())], names=["y", "idx"])

    found = picked.mapInArrow(run, "y int, idx binary").collect()  # indices of max_rows rows
    rows, y = [], []
    for r in sorted(found, key=lambda r: (xxhash.xxh64_intdigest(r.idx), r.idx)):
        idx = np.frombuffer(r.idx, np.int32)
        n = int((idx < (1 << WORD_BITS)).sum())
        rows.append((idx, np.r_[np.full(n, 1 / np.sqrt(max(1, n)), np.float32), np.full(len(idx) - n, 1 / np.sqrt(max(1, len(idx) - n)), np.float32)]))
        y.append(r.y)
    y = np.array(y, np.float32)
    base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    return Machine(base).learn(rows, y)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, score double, predicted int), one for each input row."""
    spark = B.tune(docs.sparkSession)
    share = spark.sparkContext.broadcast(machine)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            s = share.value.score([features(t, list(m)) for _, t, *m in zip(*cols, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col, *metadata).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text", metadata: tuple[str, ...] = (), least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is ``least`` or more."""
    spark = B.tune(docs.sparkSession)
    share = spark.sparkContext.broadcast(machine)  # of fixed size
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, *meta = (batch.column(names.index(c)).to_pylist() for c in (text_col, *metadata))
            s = share.value.score([features(t, list(m)) for t, *m in zip(text, *meta, strict=True)])
            yield batch.filter(pa.array(s >= least))

    return docs.mapInArrow(run, docs.schema)


def op2_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents")
    out = score(docs, train(docs, B.table(spark, sf_dir, "labels"), metadata=("n_chars",)), metadata=("n_chars",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
