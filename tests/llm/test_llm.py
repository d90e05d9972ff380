"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import gzip
import io
import itertools
import json
import random
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import _base, fm, lines, minhash, quotes, recompress, spaced, tokens, warc, wrapper

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, extra=()):
    """Documents with columns whose names clash with the operators' own."""
    rows = [((i if ids is None else ids[i]), t, "en", f"src{i % 2}" if t != "nosource" else None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "key", "chunk", "h", "z", "at", "digest", "component"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def split(t):
    return (t or "").encode().split()


NASTY = [None, "", " ", "\n\t", "a", "it's  a test <|endoftext|> é中文 \x85 ok", "x" * 5000, "9" * 700 + " " * 300, "don't\n\n\nstop   ", "\U0001f600 ‍ zwj", "a" * 3 + "\x1c" + "b"]


# --- 1 -------------------------------------------------------------------------------------------


def repeat_words(w):
    seen, cover = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {j for i in at for j in range(i, i + 8)}
    return len(cover)


def test_line_counts(spark):
    rnd = random.Random(1)
    texts = [*NASTY, "nosource", *(" ".join(rnd.choice("ab#") for _ in range(n)) for n in (7, 8, 9, 30, 60)), "x y\nx y\n\n \nz", "one two three four five six seven eight " * 5]
    got = lines.line_quality(documents(spark, texts)).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts, strict=True):
        w = (t or "").encode().split()
        own = [x for x in (t or "").split("\n") if x.encode().split()]
        joined = b"".join(w).decode()
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), len(joined), sum(c in lines.SYMBOLS for c in joined), len(own) - len(set(own)), repeat_words(w)), t


def test_frequent_lines_go(spark):
    letters = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))  # noqa: E731  digits count as alike
    body = [" ".join(f"{letters(i)}x{letters(j)}" for j in range(30)) for i in range(40)]
    texts = [f"Common  line {i}\n{b}" for i, b in enumerate(body)] + ["common LINE 7\nshort"] * 3
    out = {r.doc_id: r for r in lines.line_quality(documents(spark, texts).withColumn("source", F.lit("h")), max_docs=5).collect()}
    assert all(out[i].kept and out[i].clean_text == body[i] and out[i].removed_lines == [0] for i in range(40))
    assert not out[40].kept
    copies = lines.line_quality(documents(spark, [body[0]] * 30).withColumn("source", F.lit("h")), max_docs=5).collect()
    assert all(r.kept for r in copies)


# --- 2 -------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["the", "river", "moves", "past", "old", "towns,"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY", "now!!", "$$$", "click", "%%%"]) for _ in range(60))
    texts = [good() if i % 2 else bad() for i in range(300)] + [None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    m = fm.train(docs, labels)
    got = {r.doc_id: r for r in fm.score(docs, m).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = {r.doc_id for r in docs.filter(fm.held_out(F.col("doc_id"))).collect() if r.doc_id < 300}
    assert 50 < len(held) < 150
    assert np.mean([got[i].predicted == i % 2 for i in held]) > 0.95
    again = {r.doc_id: r.score for r in fm.score(docs.repartition(7), m).collect()}
    assert again == {i: r.score for i, r in got.items()}
    flat = fm.score(docs, fm.train(docs, labels.limit(0))).collect()
    assert {r.score for r in flat} == {0.5}


def test_interactions_equal_the_sum_over_pairs():
    m = fm.Machine()
    m.fixed = False
    idx, val = np.array([3, 9, 40], np.int32), np.array([1, 0.5, 2], np.float32)
    m.w[idx] = [0.1, 0.2, -0.3]
    z = m.raw(idx, val, np.zeros(1, np.int64))[0][0]
    pairs = sum(float(m.v[idx[a]] @ m.v[idx[b]]) * val[a] * val[b] for a in range(3) for b in range(a + 1, 3))
    assert abs(z - (m.w0 + float((m.w[idx] * val).sum()) + pairs)) < 1e-5


# --- 3 -------------------------------------------------------------------------------------------


def brute_repeats(docs, width):
    first = {}
    for i, t in docs:
        w = split(t)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        w = split(t)
        gone = set()
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s : s + width])] < i:
                gone |= set(range(s, s + width))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    rnd = random.Random(seed)
    # few words and long runs: the hard cases of recompression
    base = [" ".join(rnd.choice("aab"[: 2 + seed % 2] if rnd.random() < 0.5 else "abcdef") for _ in range(rnd.randint(0, 80))) for _ in range(40)]
    texts = [*base]
    for _ in range(30):
        a, b = rnd.choice(base).split(), rnd.choice(base).split()
        i, j = rnd.randint(0, len(a)), rnd.randint(0, len(b))
        texts.append(" ".join(a[i:] + b[:j]) + "\n" + " ".join(["z"] * rnd.randint(0, 40)))
    texts += [None, "", "a " * 50, "a " * 60, " ".join(f"w{i}" for i in range(3000))] * 2
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    ids[3] = None
    ids[5] = ids[6]
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)]
    got = recompress.remove_repeats(documents(spark, texts, ids).repartition(5)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(brute_repeats(rows, 13), key=key)
    assert all(r.clean_text == r.kept_text or not r.n_removed for r in got)


def test_symbols_do_not_depend_on_the_surroundings():
    rnd = np.random.default_rng(3)
    inner = rnd.integers(0, 3, 40).astype(np.uint64)
    seen = []
    for k in range(6):
        left, right = rnd.integers(0, 3, 5 + k).astype(np.uint64), rnd.integers(0, 3, 7).astype(np.uint64)
        h = minhash.mix(np.r_[left, inner, right] + np.uint64(9))
        edge = np.zeros(len(h), bool)
        edge[[0, -1]] = True
        sym, lo, hi = recompress.rounds(h, edge, 3)
        inside = (lo >= len(left)) & (hi <= len(left) + len(inner))
        seen.append({(int(s), int(a) - len(left), int(b) - len(left)) for s, a, b in zip(sym[inside], lo[inside], hi[inside], strict=True)})
    assert seen[0] and all(x == seen[0] for x in seen)


# --- 4 -------------------------------------------------------------------------------------------


def test_leaks(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [" ".join(word() for _ in range(40)) for _ in range(5)] + ["Only five words, in here", None, ""]
    clean = [" ".join(word() for _ in range(200)) for _ in range(10)]
    hurt = items[1].split()
    for i in range(4, 40, 7):
        hurt[i] = "changed"
    texts = [*clean, f"{clean[0]} {items[0].upper()}! {clean[1]}", f"{clean[2]}\n{' '.join(hurt)}", items[2], f"x ONLY five, words in here y", None, "", items[3][: len(items[3]) // 3]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("h", F.lit(1))
    for limit in (spaced.MAX_BROADCAST, 0):
        got = {(r.doc_id, r.item_id): r for r in spaced.find_leaks(documents(spark, texts), bench, max_broadcast=limit).collect()}
        assert set(got) == {(10, 0), (11, 1), (12, 2), (13, 5)}
        assert got[10, 0].overlap == 1.0 and got[10, 0].start == 200
        assert (got[11, 1].n_match, got[11, 1].item_words) == (40 - 6, 40)
    assert spaced.find_leaks(documents(spark, texts).limit(0), bench).count() == 0
    assert spaced.find_leaks(documents(spark, texts), bench.limit(0)).count() == 0


def sliding_overlaps(texts, items, least=0.5):
    """Without masks: each item laid on each place of each text; the best (agreement, -start) of those that count."""
    out = {}
    for d, t in enumerate(texts):
        for k, x in enumerate(items):
            w, g = t.split(), x.split()
            best = max((sum(w[s + i] == g[i] for i in range(len(g)) if 0 <= s + i < len(w)), -s) for s in range(-len(g), len(w)))
            if best[0] >= least * len(g):
                out[d, k] = best
    return out


def test_leaks_recall_against_sliding(spark):
    rnd = random.Random(44)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [" ".join(word() for _ in range(n)) for n in (9, 10, 11, 13, 14, 15, 16, 17, 18, 20, 25, 31, 38, 47, 59)]
    texts = []
    for x in items:
        g = x.split()
        for share in (0.5, 0.5, 0.55, 0.6, 0.7):
            stay = set(rnd.sample(range(len(g)), -(-int(share * 100 * len(g)) // 100)))
            texts.append(" ".join([word() for _ in range(30)] + [w if i in stay else word() for i, w in enumerate(g)] + [word() for _ in range(30)]))
    want = sliding_overlaps(texts, items)
    assert len(want) >= len(texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_match, -r.start) for r in spaced.find_leaks(documents(spark, texts), bench).collect()}
    assert {k: got.get(k) for k in want} == want


def test_leaks_of_parts_and_shifted_copies(spark):
    rnd = random.Random(45)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    pad = lambda n=30: [word() for _ in range(n)]
    items = [pad(59), pad(40), pad(40), pad(59)]
    shifted = [*items[1][:13], word(), *items[1][13:27], word(), *items[1][27:]]
    dropped = [w for i, w in enumerate(items[2]) if i not in (13, 27)]
    texts = [pad() + items[0][10:35] + pad(), pad() + shifted + pad(), pad() + dropped + pad(), pad() + items[3][:13] + pad(), pad(90)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for limit in (spaced.MAX_BROADCAST, 0):
        got = {(r.doc_id, r.item_id): r for r in spaced.find_leaks(documents(spark, [" ".join(t) for t in texts]), bench, max_broadcast=limit).collect()}
        assert set(got) == {(0, 0), (1, 1), (2, 2)}
        assert (got[0, 0].n_match, got[1, 1].n_match, got[2, 2].n_match) == (25, 40, 38)
        assert got[0, 0].start == 20


# --- 5 and 10 ------------------------------------------------------------------------------------


def test_encoding_round_trip(spark):
    ranks = tokens.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*NASTY, "same words here", "same words here"]
    got = tokens.decode(tokens.encode(documents(spark, texts).repartition(3), ranks, P.PATTERN), ranks).collect()
    assert len(got) == len(texts)
    for r in got:
        want = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, bytes(r.ids)) == (len(want), struct.pack(f"<{len(want)}I", *want))
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    assert tokens.encode(documents(spark, texts).limit(0), ranks, P.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, name):
    rnd = random.Random(5)
    parts = ["a", "the", " ", "<|endoftext|>", "é", "\n", "'s", "9", "$", "中", "\x85", "zq", "  ", "Ünder"]
    texts = [*NASTY, *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(200))]
    if name.endswith(".json"):
        t = Tokenizer.from_file(P.path(name))
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda x: len(p.encode(x))
    got = {r.doc_id: r for r in tokens.count_tokens(documents(spark, texts), P.path(name), limit=10).collect()}
    for i, x in enumerate(texts):
        n = count(x or "")
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((x or "").encode()), n > 10), x


def test_whole_tokens_are_proven():
    with open(P.path("byte_bpe_50k.json")) as f:
        c = tokens.Counting(json.load(f))
    assert len(c.whole) > 45_000
    for x in ("ab" * 900, "the" * 500, "é" * 450):
        raw = x.encode().decode("latin-1").translate(c.chars)
        assert tokens.merge_long(raw, c.ranks) == tokens.merge_count(list(raw), c.ranks)


# --- 6 -------------------------------------------------------------------------------------------


def test_archives(spark):
    pages = [(1, "http://a/\n x", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "z" * 200_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (2, "u", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit("clash"))
    folder = _base.shared_dir(spark)
    archives = warc.write(df.repartition(3), folder)
    members = warc.normalise(archives, folder)
    assert sum(r.n_records for r in archives.collect()) == sum(r.n_records for r in members.collect()) == len(pages)
    got = warc.read(members).collect()
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = sorted(str((i, len((h or "").encode()), warc.digest32((h or "").encode()), "response" if i == last[h or ""] else "revisit", None if i == last[h or ""] else last[h or ""])) for i, _, h in pages)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == want
    for r in members.collect():
        raw = open(r.path, "rb").read()
        assert gzip.decompress(raw).count(b"WARC-Record-ID") == r.n_records
    assert warc.read(warc.normalise(warc.write(df.limit(0), f"{folder}/none"), f"{folder}/none")).count() == 0


def test_records_of_any_gzip():
    recs = [warc.record(i, "u", b"p" * i, None, False) for i in range(50)]
    for data in (gzip.compress(b"".join(recs)), b"".join(map(gzip.compress, recs))):
        assert [whole for _, whole in warc.records(io.BytesIO(data))] == recs
    with pytest.raises(ValueError, match="inside"):
        list(warc.records(io.BytesIO(gzip.compress(recs[3][:-9]))))


# --- 7 -------------------------------------------------------------------------------------------


def brute_components(docs, width, percent):
    sets = []
    for i, t in docs:
        w = [x.lower() for x in split(t)]
        k = min(width, len(w))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rnd = random.Random(width)
    word = lambda: rnd.choice(["the", "of"]) if rnd.random() < 0.2 else f"w{rnd.randint(0, 3000)}"
    texts = [None, "", " ", "one", "ONE", "one two", "x " * 40, "x " * 50]
    for size, copies, edits in ((300, 5, 3), (60, 4, 2), (200, 160, 12), (400, 90, 30)):  # two of them over SMALL
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(size)] = word()
            texts.append(" ".join(w))
    texts += texts[8:20]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    ids[9], ids[0] = None, 10_000
    rows = list(zip(ids, texts, strict=True))
    got = minhash.near_duplicates(documents(spark, texts, ids).repartition(4), width=width).collect()
    key = lambda r: str(tuple(r))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows, width, 80), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(documents(spark, texts).limit(0)).count() == 0


def test_families_of_a_template_lose_no_link(spark):
    rnd = random.Random(77)
    word = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = []
    for n, shared, own in ((300, 165, 35), (300, 121, 80)):  # shingle similarity 0.7 and 0.43: more than GROUP share a longer key, or only a short one
        template = word(shared)
        family = [template + word(own) for _ in range(n)]
        for k in range(8):
            d = list(family[k * 30])
            d[-5] = d[-20] = f"edit{k}"
            family.append(d)
        texts += family
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(documents(spark, [t for _, t in rows]), width=2).collect()
    want = brute_components(rows, 2, 80)
    assert sum(i != c for i, _, c in want) >= 16
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_links_of_members_that_the_smallest_rejects(spark):
    """Smaller documents hold all keys of a pair, each overlapping it too little to be linked; the pair stays linked."""
    rnd = random.Random(78)
    word = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts, pairs = [], []
    for _ in range(4):
        a = word(200)
        b = [f"x{w}" if i in (20, 60, 100, 140, 180, 30, 90, 150, 75) else w for i, w in enumerate(a)]
        pairs += [a, b]
        for _ in range(400):
            s = rnd.randrange(120)
            texts.append(rnd.choice((a, b))[s : s + 80] + word(120))
    texts = [" ".join(t) for t in texts + pairs]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts).repartition(4), width=2).filter("NOT kept").collect()}
    assert got == {1600 + 2 * k + 1: 1600 + 2 * k for k in range(4)}


def test_key_groups_of_chunks():
    """What a chunk reduces and a bucket meets again gives every pair of small groups, and stars that connect large ones."""
    rnd = np.random.default_rng(9)
    least = rnd.integers(0, 2**32, (60, minhash.N), dtype=np.uint32)
    least[:30] = least[0]
    least[30:33] = least[30]
    least[33] = least[34]
    subs = pa.array([r.tobytes() for r in least], pa.binary())
    halves = [(np.r_[0:20, 30, 33, 35:60], 4096), (np.r_[20:30, 31, 32, 34], 4096)]
    sent = [row for own, limit in halves for b in minhash._publish(1, minhash._table_keys, limit)([pa.RecordBatch.from_arrays([pa.array(own), subs.take(pa.array(own))], names=["id", "sub"])]) for row in b.to_pylist()]
    out = {tuple(x.values()) for b in minhash._meet((pa.scalar(0),), [pa.RecordBatch.from_pylist(sent)]) for x in b.to_pylist()}
    assert {x for x in out if x[2] != minhash.LARGE} == {(30, 31, 0), (30, 32, 0), (31, 32, 1), (33, 34, 0)}
    assert {x[:2] for x in out if x[2] == minhash.LARGE} == {(0, i) for i in range(1, 30)}


def test_components_of_a_long_path(spark):
    n = 300
    e = spark.createDataFrame([(i, (i * 7 + 7) % n) for i in range(0, 0)] + [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = {r.id: r.component for r in minhash.components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    """What near_duplicates wrote on its way is deleted but for what its result reads, which can be read more than once."""
    monkeypatch.setattr(_base, "shared_root", lambda spark: str(tmp_path))
    rnd = random.Random(79)
    base = [[f"w{rnd.randrange(10**6)}" for _ in range(60)] for _ in range(20)]
    texts = [" ".join(w[: 60 - k]) for w in base for k in range(4)]
    out = minhash.near_duplicates(documents(spark, texts), width=2)
    for _ in range(2):
        assert {r.component_id for r in out.collect()} == set(range(0, 80, 4))
    left = {p.name for d in tmp_path.iterdir() for p in d.iterdir()}
    assert {"sig", "rep"} <= left and not {"pairs", "deep", "deep_pairs", "near", "ends", "texts", "stars", "hot", "others", "crowd", "crowded"} & left


# --- 8 -------------------------------------------------------------------------------------------


def page(title, body, i):
    return f"""<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p><article>no</article>";</script></head><body class="post sidebar-none"><header><a href="/">Site</a></header>
<nav><ul><li><a>Home {i}</a></li><li><a>News</a></li></ul></nav><div class="cookie-notice">We use cookies</div><aside><div>Side {i}<div>deep</div></div></aside><div class="ad">Buy {i}</div>
<article><h1>{title}</h1>{body}<p>Follow us for more stories.</p><form><input value="x">Mail</form></article>
<section id="comments"><article><p>Reader {i} says no</p></article></section><footer>&copy; {i}</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}?x", page(f"Title {i}", f"<p>First &amp; <b>bold</b>\n  text {i}.<br><p>Open para {'long ' * 20}{i}", i)) for i in range(6)]
    rows += [(10, None, None), (11, "http://one.example/", page("Alone", "<p>Only page.</p>", 11)), (12, "http://two.example/", "<p>No frame &#233;<p>at all<ul><li>x<li>y</ul>"), (13, "bad", "<article><p>cut sh"), (14, "bad", "")]
    got = {r.page_id: r for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit(1))).collect()}
    for i in range(6):
        # the closing line is the template's: all pages of the host have it
        assert got[i].text == f"Title {i}\nFirst & bold text {i}.\nOpen para {'long ' * 20}{i}"
    assert got[11].text == "Alone\nOnly page.\nFollow us for more stories."
    assert got[12].text == "No frame é\nat all\nx\ny"
    assert (got[10].text, got[13].text, got[14].text) == ("", "cut sh", "")
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_constants_of_all_pages(spark):
    site = lambda host, n, title: [(f"http://{host}/{i}", f"<html><head><title>{title(i)}</title></head><body><article><h1>H {host} {i}</h1><p>{f'body {i} ' * 40}</p><h6>Follow us</h6></article></body></html>") for i in range(n)]
    own = lambda i: f"T{i}"
    urls = [x for h in range(12) for x in site(f"four{h}", 4, own)] + site("same", 6, lambda i: "Site")
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(urls)], "page_id long, url string, html string")
    got = {r.url: r.text for r in wrapper.main_text(pages).collect()}
    for u, h in urls:
        if h and "<h1>" in h:
            assert "Follow us" not in got[u] and "body" in got[u], u
    alike = spark.createDataFrame([(i, "http://copy/", urls[0][1]) for i in range(9)], pages.schema)
    assert all("Follow us" in r.text for r in wrapper.main_text(alike).collect())


def test_constants_of_sections_and_odd_pages(spark):
    full = lambda host, i, extra="": (f"http://{host}/{i}", f"<title>T{i}</title><article><h1>H {host} {i}</h1><p>{f'body {i} ' * 40}</p>{extra}<h6>Follow us</h6></article>")
    urls = [full("part", i, "<h4>Live updates</h4>" if i < 5 else "") for i in range(40)] + [full("odd", i) for i in range(6)]
    urls += [("http://odd/a", None), ("http://odd/b", ""), ("http://odd/c", "<p>Gone</p>"), ("http://odd/d", "<article>Hi<h6>Follow us</h6></article>")]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(urls)], "page_id long, url string, html string")
    got = {r.url: r.text for r in wrapper.main_text(pages).collect()}
    for u, h in urls:
        if h and "<h1>" in h:
            assert "Follow us" not in got[u] and "Live" not in got[u] and "body" in got[u], u
    # a page that is mostly constants keeps them, and takes them from no other
    assert (got["http://odd/a"], got["http://odd/c"], got["http://odd/d"]) == ("", "Gone", "Hi\nFollow us")


def soup_site(host, n, rnd):
    """Pages without any telling tag, class or id, and the text that each is about."""
    word = lambda k: " ".join("".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(k))
    out = []
    for i in range(n):
        body = [word(rnd.randint(5, 60)) for _ in range(rnd.randint(1, 6))]
        title, links = word(4), "".join(f"<li><a href=x>{word(2)}</a></li>" for _ in range(rnd.randint(2, 9)))
        extra = f"<div class=b{i}>{word(5)}</div>" if i % 3 == 0 else ""
        paragraphs = "".join(f"<p>{p}" + ("</p>" if i % 2 else "") for p in body)
        html = f"<html><body><div><ul>{links}</ul></div><div><span>{word(6)}</span></div>{extra}<div class=c1><h1>{title}</h1><div>{paragraphs}<h6>Follow us</h6></div><ul><li><a>{word(9)}</a></li></ul></div><div><div>{word(7)}</div></div></body></html>"
        out.append((f"http://{host}/{i}", html, "\n".join([title, *body])))
    return out


def test_wrapper_alone_finds_the_article(spark):
    """No names help here: slots, menus and constants of the inferred wrapper decide; without it no page comes out right."""
    rnd = random.Random(8)
    site = soup_site("soup", 40, rnd) + soup_site("few", 3, rnd)
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(site)], "page_id long, url string, html string")
    got = {r.url: r.text for r in wrapper.main_text(pages).collect()}
    assert all(got[u] == want for u, _, want in site[:40])
    assert not any(wrapper.extract(h) == want for _, h, want in site)
    known = wrapper.unpacked({r.host: bytes(r.wrapper) for r in wrapper.wrappers(pages).collect()}["soup"])
    assert known.field == "html>body>div.c0" and "'Follow us'" in str(known) and "?" in str(known) and ")+" in str(known)


def test_aligned_slots_decide_the_title(spark):
    """Teasers' headings are on every page too and are longer together; only the alignment tells that the title is one slot."""
    rnd, site = random.Random(38), []
    word = lambda n: " ".join(rnd.choice("abcdefghij") * rnd.randint(2, 9) for _ in range(n))
    for i in range(24):
        title, body = word(4), [word(40) for _ in range(3 + i % 4)]
        teasers = "".join(f"<h3>{word(9)}</h3><p>{word(3)}</p>" for _ in range(2 + i % 3))
        site.append((i, f"http://t/{i}", f"<html><body><div class=x><div class=a><h2>{title}</h2>{''.join(f'<p>{b}</p>' for b in body)}</div><div class=b>{teasers}</div></div></body></html>", "\n".join([title, *body])))
    pages = spark.createDataFrame([r[:3] for r in site], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(pages).collect()}
    assert got == {r[0]: r[3] for r in site}


def test_wrappers_joined_by_host(spark, monkeypatch):
    rnd = random.Random(18)
    site = soup_site("soup", 12, rnd) + soup_site("two", 12, rnd)
    rows = [(i, u, h) for i, (u, h, _) in enumerate(site)] + [(0, *site[0][:2]), (None, None, None), (99, "http://soup/x", f"<p>{'long ' * 200_000}")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    small = sorted(map(str, wrapper.main_text(pages).collect()))
    monkeypatch.setattr(wrapper, "MAX_BROADCAST", -1)
    assert sorted(map(str, wrapper.main_text(pages).collect())) == small and len(small) == len(rows)
    assert wrapper.main_text(pages.limit(0)).count() == 0


def brute_nodes(pages):
    """Places that all pages have, and whether they repeat in one, without any alignment."""
    each = [[b.path for b in wrapper.places(p)] for p in pages]
    every = set.intersection(*map(set, each))
    return {p: any(sum(1 for _ in g) > 1 for own in each for k, g in itertools.groupby(own) if k == p) for p in every}


def test_alignment_against_places():
    rnd = random.Random(28)
    pages = [h for _, h, _ in soup_site("s", 9, rnd)]
    nodes = wrapper.learn(pages)
    want = brute_nodes(pages)
    kept = {wrapper._loose(s): s.endswith(")+") for s, _, optional in nodes if not optional}
    assert kept == {p: r for p, r in want.items() if p in kept} and set(want) - set(kept) <= {wrapper._loose(s) for s, _, _ in nodes}


def test_text_after_open_elements_and_short_articles_stay():
    assert wrapper.extract('<article><p class="ad">Buy<p>Real 1</p><p>Real 2</p></article>') == "Real 1\nReal 2"
    assert wrapper.extract('<article><p class="ad"><b>Buy</b> now</p>Tail<ul><li class="ad">Buy<ul><li>this</ul><li>Real</ul><p>End</article>') == "Tail\nReal\nEnd"
    assert wrapper.extract('<article><ul><li class="ad">Buy</ul><table><tr><td class="ad">Buy<td>Cell<tr class="ad"><td>x<tr><td>Row</table>End</article>') == "Cell\nRow\nEnd"
    assert wrapper.extract('<article>One<div class="ad">Buy</article><article>Two</article>') == "One\nTwo"
    assert wrapper.extract(f"<article>{'long ' * 50}</article><article>Short</article>").endswith("\nShort")


def test_wrapper_is_union_free():
    one, two = [("<p", "a"), ("<h", "same")], [("<p", "b"), ("<p", "c"), ("<h", "same"), ("<x", "new")]
    w = wrapper.infer(wrapper.infer(None, wrapper.fold(one)), wrapper.fold(two))
    assert w == [("(<p)+", None, False), ("<h", "same", False), ("<x", "new", True)]


# --- 9 -------------------------------------------------------------------------------------------


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How are you today?\nSecond line here"),
        (1, 1, "assistant", "> how  are you TODAY?\nFine, thanks"),
        (1, 2, "user", ">> How are you today?\n> Fine, thanks\nGood to hear"),
        (1, 3, "user", "> never said\nodd"),
        (1, 4, "assistant", "> Second line here\nlate reply"),
        (2, 0, "user", "> Fine, thanks\nother conversation"),
        (3, None, "user", "> Fine"),
        (None, 1, "user", None),
        (4, 0, "user", ""),
        (1, 4, "assistant", "> Second line here\nlate reply"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("thread", F.lit("clash")).withColumn("top", F.lit(1))
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    assert quotes.link_quotes(df).count() == len(rows)
    at = lambda c, t: (got[c, t].reply_to, got[c, t].thread, got[c, t].depth, got[c, t].n_quoted, got[c, t].clean_text)
    assert at(1, 1) == (0, 0, 1, 1, "Fine, thanks")
    assert at(1, 2) == (1, 0, 2, 2, "Good to hear")
    assert at(1, 3) == (None, 3, 0, 1, "odd")
    assert at(1, 4) == (0, 0, 1, 1, "late reply")
    assert at(2, 0) == (None, 0, 0, 1, "other conversation")
    assert at(4, 0) == (None, 0, 0, 0, "")
    assert [got[1, t].place for t in (0, 1, 2, 4, 3)] == [0, 1, 2, 3, 4] and got[3, None].place is None
    deep = [(9, 0, "m0")] + [(9, i, f"> m{i - 1}\nm{i}") for i in range(1, 20)]
    out = quotes.link_quotes(spark.createDataFrame(deep, "conv_id long, turn long, text string")).collect()
    assert {r.turn: (r.thread, r.depth) for r in out} == {i: (0, i) for i in range(20)}
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_quoted_passages_against_sql(spark):
    """Nested, re-wrapped, partial and repeated quotes: what the registered SQL gives."""
    import duckdb

    rnd = random.Random(99)
    vocabulary = [f"w{i}" for i in range(60)] + ["Yes", "NO", "ok."]
    rows = []
    for conv in range(30):
        own: list[list[str]] = []
        for turn in range(rnd.randint(1, 40)):
            lines = []
            for _ in range(rnd.randint(0, 3)):
                if own and rnd.random() < 0.7:
                    src, depth = rnd.choice(own), rnd.randint(1, 3)
                    i = rnd.randrange(len(src) + 1)
                    part, cut = src[i : i + rnd.randint(1, 30)], rnd.randint(1, 9)
                    lines += [">" * depth + rnd.choice(["", " ", "> "]) + " ".join(part[k : k + cut]).upper() for k in range(0, len(part), cut)]
                lines.append(rnd.choice(["", "  ", "said so", "> unknown words of none here at all"]))
            body = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
            own.append(body)
            lines += [" ".join(body[k : k + 11]) for k in range(0, len(body), 11)]
            rows.append((conv, turn * rnd.choice((1, 700)), rnd.choice(("user", "assistant")), "\n".join(lines)))
    rows += [(None, 1, "user", "> x"), (3, None, "user", None), rows[5], (rows[5][0], rows[5][1], "user", "another text"), (50, 0, None, None)]
    rows += [(60, t, "user", f"message {t} has words of its own here\n> message {t - 1} has words\n> of its own here") for t in range(3000)]
    kind = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, kind).repartition(5)
    linked = quotes.link_quotes(df, keep=("role",))
    names = sorted(linked.columns)
    got = sorted(str([r[c] for c in names]) for r in linked.collect())
    con = duckdb.connect()
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    cur = con.execute(quotes.OP9_SQL)
    at = [[d[0] for d in cur.description].index(c) for c in names]
    assert got == sorted(str([r[i] for i in at]) for r in cur.fetchall())
    built = {(r.conv_id, r.part): r.messages for r in quotes.conversations(linked).collect()}
    assert [m.turn for p in range(3) for m in built[60, p]] == list(range(3000)) and [len(built[60, p]) for p in range(3)] == [1000] * 3
    assert all(">" not in (m.text or "") for ms in built.values() for m in ms)


# --- all -----------------------------------------------------------------------------------------


def odd_documents(spark):
    """Repeated rows, ids that several texts share, null ids and texts, a very long text, ties, clashing columns."""
    rnd = random.Random(3)
    words = lambda n: " ".join(f"w{rnd.randrange(500)}" for _ in range(n))
    t, long = words(60), words(60_000)
    rows = [(1, t), (1, t), (1, words(40)), (None, t), (None, None), (2, ""), (3, long), (4, t), (5, long + " end"), (6, "x" * 300_000)]
    return rows, documents(spark, [x for _, x in rows], [i for i, _ in rows])


def odd_operators(spark):
    ranks = tokens.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (3, 1, 1), (4, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    return {
        "lines": lines.line_quality,
        "fm": lambda d: fm.score(d, fm.train(d, labels)),
        "recompress": recompress.remove_repeats,
        "bpe": lambda d: tokens.decode(tokens.encode(d, ranks, P.PATTERN), ranks),
        "minhash": minhash.near_duplicates,
        "counts": lambda d: tokens.count_tokens(d, P.path("byte_bpe_50k.json")),
    }


@pytest.mark.parametrize("name", ["lines", "fm", "recompress", "bpe", "minhash", "counts"])
def test_odd_tables(spark, name):
    rows, docs = odd_documents(spark)
    run = odd_operators(spark)[name]
    got = run(docs.repartition(3)).collect()
    key = lambda r: str(r.doc_id)
    assert sorted(map(key, got)) == sorted(str(i) for i, _ in rows)
    again = run(docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert run(docs.limit(0)).count() == 0


def test_odd_leaks(spark):
    rows, docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (1, rows[2][1]), (None, rows[0][1]), (7, None), (8, "")], "item_id long, text string")
    each = [sorted(map(str, spaced.find_leaks(docs, bench, max_broadcast=limit).collect())) for limit in (spaced.MAX_BROADCAST, 0)]
    assert each[0] == each[1]
    assert {(r.doc_id, r.item_id) for r in spaced.find_leaks(docs, bench).collect()} == {(1, 1), (None, 1), (4, 1), (1, None), (None, None), (4, None)}


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a b c d e f " * 30_000), (1, 0, "user", "a b c d e f " * 30_000), (1, 1, None, "> a b c d e f a b c\nfine"), (1, 1, "user", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit("clash")).withColumn("level", F.lit(1)).withColumn("place", F.lit("x"))
    got = quotes.link_quotes(df, keep=("role",)).collect()
    assert len(got) == len(rows)
    assert sorted((r.turn, r.place, r.reply_to) for r in got if r.conv_id == 1) == [(0, 0, None), (0, 0, None), (1, 1, 0), (1, 2, 0)]
    assert quotes.conversations(quotes.link_quotes(df, keep=("role",))).count() == 1
