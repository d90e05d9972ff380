"""Substring deduplication by recompression.

A document's words are symbols.  A round names the maximal runs of equal symbols, splits the alphabet in
two by a bit of each name, and names every left-right pair.  A name is a 64-bit digest of what it stands
for, so the naming is global with no dictionary to exchange: equal word sequences get equal symbols
wherever they stand, except near their ends.  For each symbol the parser keeps the span of words on which
its existence depends; an occurrence of that span anywhere has the symbol.  A window of ``width`` words
is represented by the symbol of least key among the highest symbols whose spans lie inside it (by itself
if there is none), which is the same choice in each occurrence.

Three packed exchanges (see _base) follow: (1) which keys occur in two documents, (2) for the windows of
those keys, whether a smaller document has the same window, verified by a second digest of all its
words; (3) the answers are applied where the text is.  Each document is judged on the input.

Defined results: null texts have no words; rows with a null id are neither compared nor changed; rows
that share an id are one document for the comparison; ids are whole numbers.  Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _base as B
from marlstone.llm.minhash import mix, word_hashes

ROUNDS, WIDTH = 2, 13
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        _POWERS[base] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n + n // 4, b, np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS[base]


class Spans:
    """Digests of any span of a sequence of hashes, alike wherever the span stands."""

    def __init__(self, h: np.ndarray, base: int):
        up, self.down = _powers(base, len(h) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])


def rounds(h: np.ndarray, edge: np.ndarray, n_rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds (name, first and last+1 place of the words it depends on), in order."""
    sym, ed = h, edge
    lo = np.arange(len(h), dtype=np.int64)
    hi = lo + 1
    for level in range(n_rounds):
        first = np.r_[True, (sym[1:] != sym[:-1]) | ed[1:] | ed[:-1]]
        start = np.flatnonzero(first)
        end = np.r_[start[1:], len(sym)]
        count = end - start
        name = np.where(count > 1, mix(sym[start] * _MIX + count.astype(np.uint64)), sym[start])
        lo, hi, ed = lo[np.maximum(start - 1, 0)], hi[np.minimum(end, len(sym) - 1)], ed[start]
        left = mix(name + np.uint64(level + 1)) >> np.uint64(63) == 1
        pair = left[:-1] & ~left[1:] & ~ed[:-1] & ~ed[1:]
        opens, closes = np.r_[pair, False], np.r_[False, pair]
        after, before = np.r_[np.arange(1, len(name)), len(name) - 1], np.r_[0, np.arange(len(name) - 1)]
        sym = np.where(opens, mix(name * _MIX ^ mix(name[after] + _MIX)), name)
        hi = np.where(opens | left, hi[after], hi)
        lo = np.where(~opens & ~left, lo[before], lo)
        keep = ~closes
        sym, lo, hi, ed = sym[keep], lo[keep], hi[keep], ed[keep]
    return sym[~ed], lo[~ed], hi[~ed]


class Parsed:
    """A chunk's words in one sequence with an edge before, between and after the documents."""

    def __init__(self, texts: list[bytes | None], width: int):
        hs = [word_hashes(t or b"") for t in texts]
        self.n_words = np.array([len(x) for x in hs], np.int64)
        self.starts = np.cumsum(self.n_words + 1) - self.n_words
        size = int(self.n_words.sum()) + len(texts) + 1
        edge = np.ones(size, bool)
        h = mix(np.arange(size, dtype=np.uint64) * _MIX + np.uint64(5))
        for s, x in zip(self.starts, hs, strict=True):
            h[s : s + len(x)] = x
            edge[s : s + len(x)] = False
        self.doc = np.cumsum(edge) - 1
        self.width = width
        edges = np.r_[0, np.cumsum(edge)]
        s = np.arange(max(0, size - width + 1))
        self.at = s[edges[s + width] == edges[s]]  # where windows start
        keys, whole = Spans(h, _BASES[0]), Spans(h, _BASES[1])
        self.digest = whole.of(self.at, self.at + width)
        sym, lo, hi = rounds(h, edge, ROUNDS)
        fits = (hi - lo <= width) & (edges[hi] == edges[lo])
        sym, lo, hi = sym[fits], lo[fits], hi[fits]
        key = mix(keys.of(lo, hi) * _MIX ^ sym)
        a, b = np.searchsorted(lo, self.at), np.searchsorted(hi, self.at + width, "right")
        best, chosen = np.full(len(self.at), np.iinfo(np.uint64).max), np.full(len(self.at), -1)
        for k in range(int((b - a).max(initial=0))):
            i = a + k
            here = np.flatnonzero(i < b)
            v = key[i[here]]
            less = v < best[here]
            best[here[less]], chosen[here[less]] = v[less], i[here[less]]
        own = chosen < 0
        self.key = np.where(own, mix(keys.of(self.at, self.at + width) + np.uint64(1)), best)
        # each symbol counts once, however many windows it represents
        new = np.r_[True, chosen[1:] != chosen[:-1]] | own if len(own) else own
        self.occ_key, self.occ_doc = self.key[new], self.doc[self.at[new]]


def _by_bucket(sorted_keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    at = (sorted_keys >> np.uint64(17)) % np.uint64(n)
    order = np.argsort(at, kind="stable")
    if not len(at):
        return
    cut = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
    for s, e in zip(cut, np.r_[cut[1:], len(at)], strict=True):
        yield int(at[order[s]]), order[s:e]


def _answers(keys: np.ndarray, n: int, got: list | None) -> np.ndarray:
    """The bits told for sorted keys, in their order."""
    told = {x["bucket"]: x["bits"] for x in got or []}
    out = np.zeros(len(keys), bool)
    for b, own in _by_bucket(keys, n):
        if b not in told:
            raise RuntimeError("a recomputed chunk differs from the one that was asked about; run again")
        out[own] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=len(own)).astype(bool)
    return out


ASKED = "bucket int, chunk string, keys binary, extra binary"


def _ask(chunk: str, keys: np.ndarray, n: int, extra) -> pa.RecordBatch:
    rows = [(b, chunk, B.pack_sorted(keys[own]), extra(own)) for b, own in _by_bucket(keys, n)]
    kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "chunk", "keys", "extra"])


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _documents(ids: list, texts: list) -> tuple:
    return [i["id"] for i in ids], [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], [i["rest"] for i in ids]


def _ask_keys(n: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.flat(batches):
            ids, texts, _ = B.unpack(row["payload"])
            p = Parsed(texts, width)
            order = np.argsort(p.occ_key, kind="stable")
            k, d = p.occ_key[order], p.occ_doc[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
            many = np.add.reduceat(np.r_[(k[1:] == k[:-1]) & (d[1:] != d[:-1]), False].astype(np.int64), first) > 0 if len(k) else np.zeros(0, bool)
            yield _ask(row["chunk"], k[first], n, lambda own: _bits(many[own]))  # noqa: B023
            del p, order, k, d, first, many
            B.trim()

    return run


def _tell(rows: list[tuple[str, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for chunk, bucket, flags in rows:
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([_bits(flags)], pa.binary())], names=["to", "bucket", "bits"])


def _shared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(r["chunk"], B.unpack_sorted(r["keys"]), r["extra"]) for r in B.flat(batches)]
    everything = np.sort(np.concatenate([k for _, k, _ in rows]))
    twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
    out = []
    for chunk, k, many in rows:
        i = np.minimum(np.searchsorted(twice, k), max(len(twice) - 1, 0))
        found = twice[i] == k if len(twice) else np.zeros(len(k), bool)
        out.append((chunk, key[0].as_py(), found | np.unpackbits(np.frombuffer(many, np.uint8), count=len(k)).astype(bool)))
    yield from _tell(out)


def _candidates(p: Parsed, ids: list, n: int, got: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows whose symbol two documents share: places in p.at, digests, ids of their documents."""
    keys = np.unique(p.occ_key)
    shared = keys[_answers(keys, n, got)]
    i = np.minimum(np.searchsorted(shared, p.key), max(len(shared) - 1, 0))
    known = np.array([x is not None for x in ids], bool)
    doc = p.doc[p.at]
    pick = np.flatnonzero((shared[i] == p.key) & known[doc]) if len(shared) else np.zeros(0, int)
    return pick, p.digest[pick], np.array([x or 0 for x in ids], np.int64)[doc[pick]]


def _least(digest: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, digest))
    d = digest[order]
    first = np.r_[True, d[1:] != d[:-1]] if len(d) else np.zeros(0, bool)
    return d[first], ids[order][first]


def _ask_windows(n: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.flat(batches):
            ids, texts, _ = B.unpack(row["payload"])
            _, digest, docs = _candidates(Parsed(texts, width), ids, n, row["got"])
            d, least = _least(digest, docs)
            yield _ask(row["chunk"], d, n, lambda own: B.pack(least[own], 1))  # noqa: B023
            del digest, docs, d, least
            B.trim()

    return run


def _smaller(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(r["chunk"], B.unpack_sorted(r["keys"]), B.unpack(r["extra"])) for r in B.flat(batches)]
    d, least = _least(np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]))
    yield from _tell([(chunk, key[0].as_py(), least[np.searchsorted(d, own)] < ids) for chunk, own, ids in rows])


def _apply(n: int, width: int, names: list[str], outputs: tuple[str, ...]):
    want_kept, want_clean = "kept_text" in outputs, "clean_text" in outputs

    def rows(held: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.flat(batches):
            ids, texts, rest = B.unpack(row["payload"])
            p = Parsed(texts, width)
            pick, digest, docs = _candidates(p, ids, n, row["got"])
            d, least = _least(digest, docs)
            smaller = _answers(d, n, row["told"])
            i = np.searchsorted(d, digest)
            hit = p.at[pick[smaller[i] | (least[i] < docs)]] if len(d) else pick
            cover = np.zeros(len(p.doc) + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + width, -1)
            gone = np.cumsum(cover)[:-1] > 0
            held = []
            for doc_id, text, other, s, k in zip(ids, texts, rest, p.starts.tolist(), p.n_words.tolist(), strict=True):
                w, g = (text or b"").split(), gone[s : s + k]
                kept = w if not g.any() else [x for x, out in zip(w, g.tolist(), strict=True) if not out]
                changed = len(kept) < k
                joined = b" ".join(kept).decode("utf-8", "surrogatepass") if want_kept or want_clean and changed else None
                clean = None if text is None or not want_clean else joined if changed else text.decode("utf-8", "surrogatepass")
                joined = joined if want_kept else None
                held.append((doc_id, k, k - len(kept), joined, clean, other))
                if len(held) == B.ARROW_ROWS:
                    yield rows(held)
                    held = []
            if held:
                yield rows(held)
            del p, pick, digest, docs, d, least, smaller, i, hit, cover, gone, held, texts
            B.trim()

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep: tuple[str, ...] = (), outputs: tuple[str, ...] = ("kept_text", "clean_text")) -> DataFrame:
    """Rows (id, n_words long, n_removed long, *outputs, *keep), one for each input row.

    ``kept_text`` has the kept words joined by one space; ``clean_text`` is the text as it was (null too)
    where nothing was removed, else the same.
    """
    spark = B.tune(df.sparkSession)
    n = B.buckets(spark)
    others = df.select(*(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep))).schema
    rest = F.to_json(F.struct(*(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)))) if keep else F.lit(None).cast("string")
    docs = df.select(F.struct(F.col(id_col).cast("long").alias("id"), rest.alias("rest")).alias("id"), F.col(text_col).alias("text"))
    chunks = docs.mapInArrow(B.chunked(_documents, B.CHUNK_BYTES // 2), "chunk string, payload binary").repartition(F.col("chunk"))

    def told(asked: DataFrame, answer, name: str) -> DataFrame:
        rows = asked.groupBy("bucket").applyInArrow(answer, "to string, bucket int, bits binary")
        return rows.groupBy("to").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    got = told(chunks.mapInArrow(_ask_keys(n, width), ASKED), _shared, "got")
    with_got = chunks.join(got.hint("shuffle_hash"), F.col("chunk") == F.col("to"), "left").select("chunk", "payload", "got")
    smaller = told(with_got.mapInArrow(_ask_windows(n, width), ASKED), _smaller, "told")
    both = with_got.join(smaller.hint("shuffle_hash"), F.col("chunk") == F.col("to"), "left").select("payload", "got", "told")
    names = ["id", "n_words", "n_removed", "kept_text", "clean_text", "rest"]
    out = both.mapInArrow(_apply(n, width, names, outputs), "id long, n_words long, n_removed long, kept_text string, clean_text string, rest string")
    back = [F.from_json("rest", others).getField(f"keep{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", *outputs, *back)


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(B.table(spark, sf_dir, "documents"), outputs=("kept_text",))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\x0C\r]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+12] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
lead AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM lead WHERE least < doc_id)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.j) AS t FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
