"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

Two collections of ``M`` small hashes (each of ``R`` minhashes) give ``M * M`` tables: the key of table
(i, j) combines hash i of the first collection with hash j of the second, so 2*M*R minhashes do the work
of M*M*2*R.  Documents with equal sets are one representative.  Keys are exchanged packed (see _base).

A key that ``GROUP`` documents or fewer share gives all its pairs; one that more share gives a star, and
its holders meet again under ``DEEP`` longer keys, pairs of six-minhash hashes made of the same minhashes,
which split families that only share a template.  A chunk with more than GROUP holders of a key sends
its smallest alone, so a key that a third of all documents hold costs one entry a chunk.

A pair must agree in ``LEAST`` of the 2*M*R minhashes; then full sets decide, and only links that they
confirm join documents: (a) stars, (b) the other pairs whose ends the stars have not joined, (c) of families
that still share a longer key with more than GROUP documents, every member outside the family's largest
part, as a stated query set in blocks, against all members of the family, by minhashes of a byte each and then,
where these are near, by full sets in the block.
No link of a pair that shares a key is lost for want of a partner.  With the default 144 tables of 6 minhashes a
pair of similarity 0.8 exactly shares no key with a chance of 4 in 10,000; if all keys that it shares are
crowded, it shares no longer one with 13 in 1,000 (520 of 40,000 simulated pairs); it agrees in too few minhashes
with 6 in 100,000.

Defined results: a null or empty text has no shingles and links with nothing; a null id keeps its row
with a null component; rows that share an id are one document, whose links are those of all its texts.
Ids must be whole numbers.  Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _base as B

M, R = 12, 3
N = 2 * M * R  # minhashes of a document; at 0.8 a pair agrees in 57.6 of them on average
LEAST = 44
GROUP, BLOCK, WIDE, ASKED = 16, 128, 512, 256  # documents of a key that are paired; members of a lead, sketches and asked texts of a block
DEEP, HALF = 360, 60  # longer keys, and the six-minhash hashes of each half that they pair
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:  # about 30 MB; several workers share an executor
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    w = text.split()
    return np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of the whole sequence if it is shorter."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = mix(s * _MIX + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _MIX)
    return x[:n] | np.uint64(1), x[n:]


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _seeds(N)
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            subs = iter(())
            if full:
                joined, starts = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
                least = np.zeros((len(full), N), np.uint32)
                for k in range(N):
                    h = mix(joined * mul[k] + add[k]) if k % R == 0 else joined * mul[k] ^ (joined >> np.uint64(17))
                    least[:, k] = (mix(np.minimum.reduceat(h, starts)) >> np.uint64(32)).astype(np.uint32)
                subs = iter(least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([next(subs).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                names=["id", "digest", "n", "sub"],
            )

    return run


def _folded(least: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of the minhashes at each row of places."""
    out = np.zeros((len(least), len(places)), np.uint64)
    for k in range(places.shape[1]):
        out = mix(out * _MIX + least[:, places[:, k]])
    return out


def _table_keys(least: np.ndarray) -> np.ndarray:
    """All keys (u_i, v_j) of each row."""
    small = _folded(least, np.arange(N).reshape(2 * M, R))
    u, v = small[:, :M], small[:, M:]
    tag = np.arange(M * M, dtype=np.uint64).reshape(1, M, M) * _MIX
    return mix(mix(u[:, :, None] + tag) ^ v[:, None, :] * _MIX).reshape(len(least), -1)


def _deep_keys(least: np.ndarray) -> np.ndarray:
    """The longer keys: pairs of six-minhash hashes, one of each half."""
    rnd = np.random.default_rng(7)  # part of the rule, as the seeds are
    halves = [np.stack([rnd.permutation(N // 2)[:6] for _ in range(HALF)]) + k * (N // 2) for k in (0, 1)]
    of = [np.concatenate([rnd.permutation(HALF) for _ in range(DEEP // HALF)]) for _ in halves]
    u, v = (_folded(least, h)[:, o] for h, o in zip(halves, of, strict=True))
    return mix(mix(u + np.arange(DEEP, dtype=np.uint64) * _MIX) ^ v * _MIX)


def _groups(keys: np.ndarray, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by (key, id) without repeats: ids, flags, and start and size of each key's group."""
    order = np.lexsort((~many, ids, keys))
    keys, ids, many = keys[order], ids[order], many[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])] if len(keys) else np.zeros(0, bool)
    keys, ids, many = keys[new], ids[new], many[new]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys, ids, many, start, np.diff(np.r_[start, len(keys)])


def _stars(ids: np.ndarray, start: np.ndarray, size: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Distinct (smallest, other) pairs of the picked groups."""
    own = np.repeat(pick, size)
    lead = np.repeat(ids[start], size)[own]
    return np.unique(np.stack([lead, ids[own]], 1)[lead != ids[own]], axis=0)


def _publish(n_buckets: int, keys_of, limit: int = 4096):
    def rows(ids: list, subs: list) -> pa.RecordBatch:
        k = keys_of(np.frombuffer(b"".join(subs), np.uint32).reshape(len(subs), N))
        own = np.repeat(np.array(ids, np.int64), k.shape[1])
        keys, own, many, start, size = _groups(k.reshape(-1), own, np.zeros(len(own), bool))
        pairs = _stars(own, start, size, size > GROUP)
        many = np.repeat(size > GROUP, size)
        stay = ~many
        stay[start] = True
        keys, own, many = keys[stay], own[stay], many[stay]
        at = keys % np.uint64(n_buckets)
        out = []
        for b in np.unique(at):
            here = at == b
            out.append((int(b), B.pack_sorted(keys[here]), B.pack((own[here], np.packbits(many[here])), 1), b""))
        out[0] = (*out[0][:3], B.pack(pairs, 1))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3))], names=["bucket", "keys", "ids", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, subs = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            subs += batch.column(1).to_pylist()
            if len(ids) >= limit:
                yield rows(ids, subs)
                ids, subs = [], []
                B.trim()
        if ids:
            yield rows(ids, subs)
            B.trim()

    return run


STAR, PAIR, LARGE = 0, 1, 2


def _meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's keys: the stars and other pairs of groups of GROUP at most, and the stars of larger ones."""
    keys, ids, many, out = [], [], [], {STAR: [], PAIR: [], LARGE: []}
    for row in B.flat(batches):
        keys.append(B.unpack_sorted(row["keys"]))
        own, bits = B.unpack(row["ids"])
        ids.append(own)
        many.append(np.unpackbits(bits, count=len(own)).astype(bool))
        if row["pairs"]:
            out[LARGE].append(B.unpack(row["pairs"]))
    _, ids, many, start, size = _groups(np.concatenate(keys), np.concatenate(ids), np.concatenate(many))
    del keys
    B.trim()
    large = size > GROUP
    large[np.repeat(np.arange(len(size)), size)[many]] = True
    out[LARGE].append(_stars(ids, start, size, large))
    for g in range(2, GROUP + 1):
        at = start[(size == g) & ~large]
        for i in range(g - 1):
            for j in range(i + 1, g):
                out[PAIR if i else STAR].append(np.stack([ids[at + i], ids[at + j]], 1))
    for kind, found in out.items():
        p = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        for i in range(0, len(p), 10_000):
            own = p[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(np.full(len(own), kind, np.int32))], names=["a", "b", "kind"])


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of sketches, those that agree in LEAST places."""
    return (x == y).sum(1) >= LEAST


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, kind, sketch of a, sketch of b), the pairs that are near."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, N) for i in (3, 4))
        keep = pa.array(_near(x, y))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(3)], names=["a", "b", "kind"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte of each minhash."""
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).astype(np.uint8).reshape(-1, N)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], names=["id", "sketch", "n"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) as (id, component: the smallest id), by alternating large and small stars.

    Each round is written to the shared folder.  A vertex with many neighbours is reduced by partial minimums;
    what the large star's minimums are joined to is not aggregated in the same stage, so a hot vertex's rows can
    be split.  The driver sees two numbers a round; a round's tables go when the next one's are written.
    """
    e = B.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        least = B.written(e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        size, most = least.agg(F.count(F.lit(1)), F.max("n")).first()
        low = F.broadcast(least) if size <= B.HELD else least
        if not size or most == 1 and not e.join(low, e["v"] == low["w"], "left_semi").take(1):
            B.dropped(least)
            break  # nothing hangs on two, and nothing on what hangs
        # large star: what hangs on v moves to the smallest that v has
        moved = B.written(e.join(low, e["v"] == low["w"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        low = moved.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = moved.join(low, moved["u"] == low["w"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        done, e = e, B.written(small.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        B.dropped(done, least, moved)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((x, y), key=len)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def _check(width: int, percent: int):
    """Of rows (z: block of a lead, id, lead boolean, text), the members linked to their lead."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads, members = {}, {}
        for batch in batches:
            for z, i, lead, text in zip(*(batch.column(c).to_pylist() for c in ("z", "id", "lead", "text")), strict=True):
                (leads if lead else members).setdefault(z, []).append((i, text))
        out = set()
        for z, own in members.items():
            to = [(i, shingles(t, width)) for i, t in leads[z]]
            for i, text in own:
                s = shingles(text, width)
                out |= {(lead, i) for lead, x in to if _linked(x, s, percent)}
        leads.clear(), members.clear()
        B.trim()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """Of a written table of pairs (a, b), which goes, those that are linked, written; a lead of many pairs is dealt into blocks."""
    n = B.buckets(pairs.sparkSession)
    leads = B.written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > BLOCK), "hot")
    hot = B.held(leads)
    block = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("many", F.lit(1)) / BLOCK))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.xxhash64("a", block).alias("z"))
    member = dealt.join(docs, dealt["b"] == docs["id"]).select("z", "id", F.lit(False).alias("lead"), "text")
    lead = dealt.select("a", "z").distinct().join(docs, F.col("a") == docs["id"]).select("z", "id", F.lit(True).alias("lead"), "text")
    rows = member.unionByName(lead).select(F.pmod("z", F.lit(8 * n)).alias("g"), "z", "id", "lead", "text")
    out = B.written(rows.groupBy("g").applyInArrow(_check(width, percent), "a long, b long"), name)
    B.dropped(pairs, leads)
    return out


def _families(edges: DataFrame, parts: DataFrame, sketch: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of different parts in families: each member outside its family's largest part against all members."""
    member = components(edges).toDF("id", "z").join(parts, "id", "left").select("z", "id", F.coalesce("component", "id").alias("part"))
    member = B.written(member, "families")
    largest = member.groupBy("z", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("z").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.sum("n").alias("size"))
    member = B.written(member.join(B.held(B.written(largest)), "z").join(sketch, "id").select("z", "id", "part", "main", "size", "sketch"), "members")
    asked = member.filter("part <> main")
    n_asked = B.held(B.written(asked.groupBy("z").agg(F.ceil(F.count(F.lit(1)) / WIDE).alias("nq"))))
    slot = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    blocks = F.ceil(F.col("size") / WIDE)
    left = asked.join(n_asked, "z").select("z", "id", "part", "sketch", slot(F.col("nq"), 3).alias("qb"), every(blocks).alias("mb"), F.lit(True).alias("q"))
    right = member.join(n_asked, "z").select("z", "id", "part", "sketch", every(F.col("nq")).alias("qb"), slot(blocks, 5).alias("mb"), F.lit(False).alias("q"))

    def near(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, id, part, asked, near) of at most ASKED asked documents and the members near one of them; near has a bit for each asked."""
        held, x = [[], [], []], []
        for batch in batches:
            for own, c in zip(held, ("id", "part", "q"), strict=True):
                own.append(batch.column(c).to_numpy(zero_copy_only=False))
            x.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, N))
        ids, part, q, x = *(np.concatenate(own) for own in held), np.concatenate(x)
        at, mem = np.flatnonzero(q), np.flatnonzero(~q)
        cols = np.ascontiguousarray(x[mem].T)
        for s in range(0, len(at), ASKED):
            own = at[s : s + ASKED]
            bits = np.zeros((len(mem), ASKED), bool)
            for j, i in enumerate(own):
                agree = np.zeros(len(mem), np.uint8)
                for k in range(N):
                    agree += cols[k] == x[i, k]
                bits[:, j] = (agree >= LEAST) & (part[mem] != part[i])
            some, used = np.flatnonzero(bits.any(1)), np.flatnonzero(bits.any(0))
            packed = np.packbits(bits[some], axis=1)
            rows = np.r_[own[used], mem[some]]
            block = ":".join(str(k.as_py()) for k in key) + f":{s}"
            told = [int(j).to_bytes(2, "big") for j in used] + [r.tobytes() for r in packed]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.string()), pa.array(ids[rows]), pa.array(part[rows]), pa.array(q[rows]), pa.array(told, pa.binary())], names=["block", "id", "part", "q", "near"])

    def links(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, members, root, out = {}, [], {}, []
        for batch in batches:
            for i, p, q, told, text in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "q", "near", "text")), strict=True):
                if q:
                    asked.setdefault(int.from_bytes(told, "big"), []).append((i, p, shingles(text, width)))
                else:
                    members.append((i, p, told, text))

        def find(p):
            while root.get(p, p) != p:
                p = root[p]
            return p

        for i, p, told, text in members:
            s = shingles(text, width)
            for j in np.flatnonzero(np.unpackbits(np.frombuffer(told, np.uint8))).tolist():
                for a, pa_, x in asked[j]:
                    if find(p) != find(pa_) and _linked(x, s, percent):
                        root[find(p)] = find(pa_)
                        out.append((a, i))
        asked.clear(), members.clear()
        B.trim()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    pairs = left.unionByName(right).groupBy("z", "qb", "mb").applyInArrow(near, "block string, id long, part long, q boolean, near binary")
    return pairs.join(texts, "id").groupBy("block").applyInArrow(links, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id, n_shingles long, component_id, kept boolean: id = component_id), one for each input row."""
    spark = B.tune(df.sparkSession)
    n = B.buckets(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = B.written(docs.mapInArrow(_signatures(width), "id long, digest binary, n long, sub binary"), "sig")
    rep = sig.filter("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "n", "sub")).alias("r"))
    rep = B.written(rep.select("digest", "r.*"), "rep")
    texts = docs.filter("id IS NOT NULL")
    sketch = rep.select("id", "sub", "n").mapInArrow(_sketches, "id long, sketch binary, n long")

    def met(subs: DataFrame, keys_of, name: str) -> DataFrame:
        sent = subs.mapInArrow(_publish(n, keys_of), "bucket int, keys binary, ids binary, pairs binary")
        pairs = sent.groupBy("bucket").applyInArrow(_meet, "a long, b long, kind int")
        return B.written(pairs.groupBy("a", "b").agg(F.min("kind").alias("kind"), F.max("kind").alias("most")), name)

    def near(pairs: DataFrame) -> DataFrame:
        x = sketch.select(F.col("id").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("nx"))
        y = sketch.select(F.col("id").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("ny"))
        both = pairs.join(x, "a").join(y, "b").filter(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
        return both.select("a", "b", "kind", "x", "y").mapInArrow(_alike, "a long, b long, kind int")

    first = met(rep.select("id", "sub"), _table_keys, "pairs")
    large = first.filter(F.col("most") == LARGE)
    crowd = B.written(large.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "crowd")
    deep = B.written(rep.select("id", "sub").join(B.held(crowd), "id"), "deep")
    second = met(deep, _deep_keys, "deep_pairs")
    pairs = first.unionByName(second).groupBy("a", "b").agg(F.min("kind").alias("kind"))
    pairs = B.written(near(pairs).groupBy("a", "b").agg(F.min("kind").alias("kind")), "near")
    crowded = B.written(second.filter(F.col("most") == LARGE).select("a", "b"), "crowded")
    ends = B.written(pairs.select("a", "b").unionByName(crowded).select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    texts = B.written(texts.join(B.held(ends), "id"), "texts")
    B.dropped(first, crowd, deep, second, ends)
    # (a) stars; (b) other pairs of parts that the stars did not join; (c) families that no key splits
    stars = _confirmed(B.written(pairs.filter(F.col("kind") != PAIR).select("a", "b")), texts, width, percent, "stars")
    parts = B.written(components(stars), "parts")
    label = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"part_{c}"))
    other = pairs.filter(F.col("kind") == PAIR).join(label("a"), "a", "left").join(label("b"), "b", "left").filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
    more = _confirmed(B.written(other.select("a", "b"), "others"), texts, width, percent, "more")
    if crowded.take(1):
        more = more.unionByName(B.written(_families(crowded, parts, sketch, texts, width, percent), "links"))
    whole = components(more.unionByName(parts.toDF("a", "b"))) if more.take(1) else parts
    B.dropped(pairs, crowded, texts, stars)
    out = sig.select("id", "digest", "n").join(rep.select("digest", F.col("id").alias("rep")), "digest", "left").join(whole.toDF("rep", "component"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(B.table(spark, sf_dir, "documents"), width=2)


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\x0C\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, w[i:i+1] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1)
      UNION ALL SELECT doc_id, w AS k FROM d WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
