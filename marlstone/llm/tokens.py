"""Byte-level BPE: encoding and decoding by a global distinct-word shuffle, and token counts with a whole-token shortcut.

Nulls in the text count as empty texts; null or repeated ids are kept, one result row for each input
row; columns other than the two named are left alone (they do not reach the result).  An empty table
gives an empty result.  Texts are never cut.
"""

from __future__ import annotations

import base64
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _base as B

# --- encoding and decoding -----------------------------------------------------------------------


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, and its rank, on each line.  Read on the driver; bounded by the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_STATE: dict = {}


def _kept(key: tuple, make):
    """One object for each worker process and key."""
    if key not in _STATE:
        _STATE[key] = make()
    return _STATE[key]


def _pretokens(pattern: str, n_buckets: int):
    """For a chunk: ids, tokens of each text, the number of each pre-token's word in order of appearance, the words by bucket, their numbers in that order."""

    def make(ids: list, texts: list) -> tuple:
        find, seen, lens, idx = regex.compile(pattern).findall, {}, [], []
        for text in texts:
            found = find(text or "")
            lens.append(len(found))
            for w in found:
                if w not in seen:
                    seen[w] = len(seen)
            idx.append(np.fromiter(map(seen.__getitem__, found), np.uint32, len(found)))
        raw = [w.encode("utf-8", "surrogatepass") for w in seen]
        at = [_bucket(w, n_buckets) for w in raw]
        # words sorted within their bucket compress: neighbours share their first bytes
        order = np.array(sorted(range(len(raw)), key=lambda i: (at[i], raw[i])), np.uint32)
        lists: dict[int, list[bytes]] = {}
        for i in order.tolist():
            lists.setdefault(at[i], []).append(raw[i])
        lists = {b: _join_words(words) for b, words in lists.items()}
        return ids, lens, B.planes(np.concatenate(idx) if idx else np.zeros(0, np.uint32)), lists, B.planes(order)

    return make


def _join_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return B.planes(np.fromiter(map(len, words), np.uint32, len(words))), b"".join(words)


def _split_words(joined: tuple[bytes, bytes]) -> list[bytes]:
    ends = np.cumsum(B.unplanes(joined[0]), dtype=np.int64).tolist()
    return [joined[1][s:e] for s, e in zip([0, *ends], ends, strict=False)]


def _bucket(word: bytes, n: int) -> int:
    import zlib

    return zlib.crc32(word) % n


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in B.flat(batches):
        lists = B.unpack(row["payload"])[3]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(lists), pa.int32()), pa.array([row["chunk"]] * len(lists), pa.string()), pa.array([B.pack(x) for x in lists.values()], pa.binary())],
            names=["bucket", "chunk", "blob"],
        )


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """Rows (id, n_tokens long, ids binary: the token ids as little-endian unsigned 32-bit numbers).

    Pre-tokens keep their positions inside the chunk; each chunk sends its distinct words to their
    buckets, a bucket encodes each distinct word of the corpus once, and the ids are joined back to
    the chunk and put together by position.
    """
    spark = B.tune(df.sparkSession)
    n = n_buckets or B.buckets(spark)
    table = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary, 50 thousand entries

    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, memo = _kept(("bpe", pattern, len(table.value)), lambda: _encoder(table.value, pattern)), {}
        for row in B.flat(batches):
            ids = []
            for w in _split_words(B.unpack(row["blob"])):
                if w not in memo:
                    memo[w] = enc._core_bpe.encode_single_piece(w)
                ids.append(memo[w])
            counts = np.fromiter(map(len, ids), np.uint32, len(ids))
            joined = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([key[0].as_py()], pa.int32()), pa.array([B.pack((B.planes(counts), B.planes(joined)))], pa.binary())], names=["chunk_", "bucket", "ids"])

    def assemble(batches):
        for row in B.flat(batches):
            doc_ids, lens, packed, lists, packed_order = B.unpack(row["payload"])
            order, seen = B.unplanes(packed_order), B.unplanes(packed)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            got = {x["bucket"]: x["ids"] for x in row["got"] or []}
            if got.keys() != lists.keys():
                raise RuntimeError("a recomputed chunk differs from the one that was encoded; run again")
            parts = [tuple(map(B.unplanes, B.unpack(got[b]))) for b in sorted(got)]
            counts = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint32)
            joined = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
            starts = np.cumsum(counts, dtype=np.int64) - counts
            at, ids, sizes, blobs = 0, [], [], []
            for doc_id, k in zip(doc_ids, lens, strict=True):
                own = place[seen[at : at + k]]
                at += k
                out = joined[_spread(starts[own], counts[own].astype(np.int64))].astype("<u4")
                ids.append(doc_id)
                sizes.append(len(out))
                blobs.append(out.tobytes())
                if len(ids) == B.ARROW_ROWS:
                    yield _rows(ids, sizes, blobs)
                    ids, sizes, blobs = [], [], []
            if ids:
                yield _rows(ids, sizes, blobs)

    kind = df.schema[id_col].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())

    def _rows(ids, sizes, blobs):
        return pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=[id_col, "n_tokens", "ids"])

    docs = df.select(id_col, text_col)
    chunks = docs.mapInArrow(B.chunked(_pretokens(pattern, n), 2 * B.CHUNK_BYTES, level=6), "chunk string, payload binary").repartition(F.col("chunk"))
    asked = chunks.mapInArrow(_requests, "bucket int, chunk string, blob binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "chunk_ string, bucket int, ids binary")
    got = told.groupBy("chunk_").agg(F.collect_list(F.struct("bucket", "ids")).alias("got"))
    both = chunks.join(got.hint("shuffle_hash"), F.col("chunk") == F.col("chunk_"), "left").select("payload", "got")
    return both.mapInArrow(assemble, f"{id_col} {kind}, n_tokens long, ids binary")


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Replace nothing, add ``decoded`` binary: the bytes of the tokens, from the token-byte table (null ids give null)."""
    spark = df.sparkSession
    size = max(ranks.values(), default=-1) + 1
    rows = [b""] * size
    for token, rank in ranks.items():
        rows[rank] = token
    lens = np.fromiter(map(len, rows), np.int64, size)
    share = spark.sparkContext.broadcast((b"".join(rows), lens))  # bounded by the vocabulary

    def run(batches):
        joined, counts = share.value
        data, starts = np.frombuffer(joined, np.uint8), np.cumsum(counts) - counts
        for batch in batches:
            out = []
            for blob in batch.column(ids_col).to_pylist():
                if blob is None:
                    out.append(None)
                else:
                    ids = np.frombuffer(blob, "<u4")
                    out.append(data[_spread(starts[ids], counts[ids])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, decoded binary")


# --- counting ------------------------------------------------------------------------------------


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_count(parts: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens left when the pair of lowest rank, leftmost first, is merged until none is left."""
    while len(parts) > 1:
        best = min(((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
    return len(parts)


#: How byte-level vocabularies split a text before merging (a fixed value of the format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counting:
    """Counts for one byte-level tokenizer file: the strings proven to encode alone as one token, and the merges for the rest."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if model.get("type") != "BPE" or not plain or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("the shortcut is proven for plain byte-level BPE only; use count_by_library")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in white space are not supported")
        self.merges = [tuple(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(self.merges)}
        self.vocab, self.model = model["vocab"], None
        chars = _byte_chars()
        self.chars = str.maketrans({chr(b): c for b, c in chars.items()})
        back = {c: bytes([b]) for b, c in chars.items()}
        self.whole: set[str] = set()
        for token in model["vocab"]:
            if all(c in back for c in token) and merge_count(list(token), self.ranks) == 1:
                try:
                    self.whole.add(b"".join(back[c] for c in token).decode("utf-8"))
                except UnicodeDecodeError:  # a part of a character: never a pre-token
                    pass
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.memo: dict[str, int] = {}
        self.find = regex.compile(BYTE_LEVEL).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, word: str) -> int:
        n = self.memo.get(word)
        if n is None:
            if len(self.memo) >= 200_000:
                self.memo.clear()
            raw = word.encode("utf-8").decode("latin-1").translate(self.chars)
            n = self.memo[word] = len(self._model().tokenize(raw)) if len(raw) < 400 else merge_long(raw, self.ranks)
        return n

    def _model(self):
        """The library's merges alone, without its split; made by each worker at its first word that is not whole."""
        if self.model is None:
            from tokenizers import models

            self.model = models.BPE(vocab=self.vocab, merges=self.merges, cache_capacity=0)
        return self.model

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = [text]
        n = 0
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            n = len(parts) - 1
        for part in parts:
            for word, k in Counter(self.find(part)).items():
                n += k if word in self.whole else k * self.merged(word)
        return n


def merge_long(raw: str, ranks: dict[tuple[str, str], int]) -> int:
    """merge_count for long pieces: a heap of pairs over a linked list, so that no text costs the square of its length."""
    import heapq

    part, after, before = list(raw), [*range(1, len(raw)), -1], [*range(-1, len(raw) - 1)]
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(part, part[1:], strict=False)) if p in ranks]
    heapq.heapify(heap)
    left = len(part)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if part[i] != a or j < 0 or part[j] != b:
            continue
        part[i], part[j], after[i] = a + b, "", after[j]
        if after[j] >= 0:
            before[after[j]] = i
        left -= 1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (part[x], part[y]) in ranks:
                heapq.heappush(heap, (ranks[part[x], part[y]], x, part[x], part[y]))
    return left


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Rows (id, n_bytes long, n_tokens long, over_limit boolean: n_tokens > limit), as the library of the file counts.

    Plain byte-level ``.json`` files take the whole-token shortcut; other ``.json`` and ``.model`` files are
    counted by their library.  The file is read on the driver and sent to the executors (bounded: one vocabulary).
    """
    spark = B.tune(df.sparkSession)
    with open(path, "rb") as f:
        raw = f.read()
    kind, value = "model", raw
    if path.endswith(".json"):
        try:
            kind, value = "shortcut", Counting(json.loads(raw))  # proven here once, not by each worker
        except ValueError:
            kind = "json"
    share = spark.sparkContext.broadcast(value)

    def counter():
        if kind == "shortcut":
            return share.value.count
        if kind == "json":
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(share.value.decode())
            t.no_truncation()
            t.no_padding()
            return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=share.value)
        return lambda text: len(p.encode(text or "", num_threads=1))

    def run(batches):
        count = _kept(("count", path), counter)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [count(t) for t in texts]
            size = [len((t or "").encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


# --- the registered queries ----------------------------------------------------------------------


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"))
    both = decode(encode(B.table(spark, sf_dir, "documents"), ranks, P.PATTERN), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(B.table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
