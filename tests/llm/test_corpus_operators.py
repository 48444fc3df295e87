"""Substring removal, shingle join, packing, media, mixing, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fileledger.llm import graph, media_store, packing, quality_rules, secret_scan, shingle_join, source_mixing, substring_dedup, topics
from fileledger.llm.entries import QUERIES
from fileledger.llm.kernel import slices
from tests.llm.conftest import SF, frame, words

# ---- substring removal


def brute_removed(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + window] for b in raw for p in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(b), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), kept))
    return out


def brute_passages(texts, window):
    """(runs, words) of each text that lie in windows of words found in another text too."""
    split = [quality_words(t) for t in texts]
    owners = defaultdict(set)
    for i, w in enumerate(split):
        for p in range(len(w) - window + 1):
            owners[tuple(w[p : p + window])].add(i)
    out = []
    for w in split:
        met = np.zeros(len(w) + 1, bool)
        for p in range(len(w) - window + 1):
            if len(owners[tuple(w[p : p + window])]) > 1:
                met[p : p + window] = True
        out.append((int((met[:-1] & ~met[1:]).sum()), int(met.sum())))
    return out


def spliced(rng, n_texts, window):
    """Texts that share stretches of lengths around the window, at many offsets, with small edits."""
    pool = [words(rng, 300, 50) for _ in range(4)]
    out = []
    for _ in range(n_texts):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            n = max(1, window + rng.randint(-3, 30))
            at = rng.randrange(max(1, len(p) - n))
            piece = p[at : at + n]
            if rng.random() < 0.3:
                k = rng.randrange(len(piece))
                piece = piece[:k] + "é" + piece[k + 1 :]
            parts.append(rng.choice(["", "q", words(rng, 5)]) + piece)
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_substrings_against_brute_force(spark, seed, odd_texts, monkeypatch):
    rng = random.Random(seed)
    window = 120
    texts = spliced(rng, 60, window) + [t for t in odd_texts if t is None or len(t) < 10_000] + ["ab" * 400, "ab" * 90 + "c"]
    texts += texts[:3]
    if seed:
        monkeypatch.setattr(substring_dedup, "WIDE_BUCKET", 2)  # buckets of three kinds go the way of the largest
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4]), r[5], r[6]) for r in substring_dedup.remove_repeats(frame(spark, texts).repartition(3), window, 12).collect()}
    assert got == {i: (*a, *b) for i, (a, b) in enumerate(zip(brute_removed(texts, window), brute_passages(texts, 12)))}


def test_each_text_of_an_id_is_cut_by_its_own_spans(spark):
    rng = random.Random(4)
    shared, rest = words(rng, 100, 10**9), [words(rng, 150, 10**9) for _ in range(3)]
    rows = [(1, rest[0]), (1, shared + rest[1]), (2, rest[2] + shared), (2, None), (None, shared)]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = Counter((r.doc_id, bytes(r.kept).decode()) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
        assert got == Counter({(1, rest[0]): 1, (1, rest[1]): 1, (2, rest[2]): 1, (2, ""): 1, (None, shared): 1})


def test_repeated_windows_by_suffix_order():
    rng = random.Random(8)
    for window in (90, 85, 91, 48, 37) * 4:
        bodies = [bytes(rng.choice(b"ab") for _ in range(4)) + b"x" * rng.randint(0, 2) + bytes(rng.choice(b"ab") for _ in range(2)) + b"y" * window for _ in range(rng.randint(1, 9))]
        anchors = np.array([b.index(b"y") for b in bodies])
        buckets, sure = np.zeros(len(bodies), np.int64), np.array([rng.random() < 0.2 for _ in bodies], np.int64)
        got = substring_dedup.repeated_windows(bodies, anchors, buckets, sure, window)
        count = Counter((b[p : p + window], p - a) for b, a in zip(bodies, anchors.tolist()) for p in range(len(b) - window + 1))
        known = {(b[p : p + window], p - a) for b, a, s in zip(bodies, anchors.tolist(), sure) if s for p in range(len(b) - window + 1)}
        for b, a, s, g in zip(bodies, anchors.tolist(), sure, got):
            want = [] if s else [p for p in range(len(b) - window + 1) if count[b[p : p + window], p - a] > 1 or (b[p : p + window], p - a) in known]
            assert sorted(g.tolist()) == want


def test_long_texts_repeat_across_pieces(spark):
    rng = random.Random(2)
    long, bit = words(rng, 260_000, 10**9), words(rng, 120, 10**9)[:800]
    at = substring_dedup.PIECE - 300
    text = long[:at] + bit + long[at:]
    assert len(text.encode()) > 2 * substring_dedup.PIECE
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(frame(spark, [text, "z" + bit])).collect()}
    assert got == {0: (len(bit), 1), 1: (len(bit), 1)}


def test_substring_query(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute_removed([r.text for r in rows], 400))}
    passages = {r.doc_id: w for r, w in zip(rows, brute_passages([r.text for r in rows], substring_dedup.PASSAGE_WORDS))}
    for r in QUERIES["op2_substring_dedup"](spark, SF).collect():
        assert (r.n_passages, r.n_passage_words) == passages[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (*want[r.doc_id][:3], hashlib.sha256(want[r.doc_id][3]).hexdigest())
    assert substring_dedup.remove_repeats(documents.limit(0)).count() == 0


# ---- shingle join


def shingle_set(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in quality_words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def quality_words(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    pairs = {(i, j) for members in by.values() for i in members for j in members if i < j}
    for i, j in pairs:
        common = len(sets[i] & sets[j])
        if 100 * common >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng):
    """Chains of near-copies at every distance around the threshold, shared passages, exact copies, letter case."""
    out = []
    for _ in range(14):
        n = rng.choice([6, 9, 14, 40, 150])
        base = [f"b{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(rng.randint(1, 8)):
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.randrange(len(base))
                base = base[:k] + rng.choice([[], [f"e{rng.randrange(10**6)}"], [base[k], "add"]]) + base[k + 1 :] or ["z"]
            out.append(" ".join(base))
    passage = " ".join(f"p{i}" for i in range(60))
    out += [f"{passage} {words(rng, k)}" for k in (3, 5, 9, 12, 15, 18, 20, 22, 40, 90) for _ in range(4)]
    out += [out[0].upper(), out[1], out[1], out[5] + "  "]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_against_brute_force(spark, seed, odd_texts, monkeypatch):
    if seed:
        for name, value in {"BLOCK_DOCS": 3, "BLOCK_SHINGLES": 100, "HOME_DOCS": 2, "SALT_ROWS": 3, "HEAVY_AT": 2, "COUNT_AT_ONCE": 500 * seed}.items():
            monkeypatch.setattr(shingle_join, name, value)
    if seed == 2:
        monkeypatch.setattr(shingle_join, "LEADERS", 0)  # all is left to the banded tiles
    rng = random.Random(seed)
    texts = near_copies(rng) + odd_texts + ["one two", "One TWO", "a b c d", "a b c d e"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.link_components(frame(spark, texts).repartition(3)).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_bitmap_bounds_hold():
    rng, refused = np.random.default_rng(0), 0
    for _ in range(300):
        both = np.unique(rng.integers(0, 1 << 62, rng.integers(0, 900), dtype=np.uint64))
        x, y = np.sort(np.unique(np.concatenate([both, rng.integers(0, 1 << 62, rng.integers(1, 400), dtype=np.uint64)]))), np.sort(np.unique(np.concatenate([both, rng.integers(0, 1 << 62, rng.integers(1, 400), dtype=np.uint64)])))
        bits = [shingle_join.bitmaps(v, np.array([0, len(v)]))[0] for v in (x, y)]
        may = shingle_join.may_link(np.array([len(x), len(y)]), bits, np.array([0]), np.array([1]))[0]
        common = len(np.intersect1d(x, y))
        link = 100 * common >= 75 * (len(x) + len(y) - common)
        assert shingle_join.linked(x, y) == link
        assert may or not link
        refused += not may
    assert refused > 100


@pytest.mark.parametrize("seed", range(3))
def test_ids_of_several_texts_keep_every_link(spark, seed):
    """An id counts as one document with the links of all its texts, whatever the order of rows."""
    rng = random.Random(seed)
    rows, want = [], {}
    for k in range(12):
        base, other = words(rng, 60), words(rng, rng.choice([60, 62, 300]))
        near, near_other = base + " tail", other + " tail"
        rows += [(10 * k, base), (10 * k + 1, near), (10 * k + 1, other), (10 * k + 2, other if k % 2 else near_other), (10 * k + 3, words(rng, 40))]
        want |= {10 * k: 10 * k, 10 * k + 1: 10 * k, 10 * k + 2: 10 * k, 10 * k + 3: 10 * k + 3}
    rng.shuffle(rows)
    got = {(r.doc_id, r.component_id) for r in shingle_join.link_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == set(want.items())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_link_rules(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    assert Counter((r.doc_id, r.component_id) for r in shingle_join.link_components(df).collect()) == {(None, None): 1, (1, 1): 1, (2, 1): 2}
    assert shingle_join.link_components(df.limit(0)).count() == 0


# ---- packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def check_pack(rows, texts, limit=1024):
    full = Tokenizer.from_file(TOKENIZER)
    ids = [full.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == np.array(ids[d], "<u4").tobytes()
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist() and all(p.doc_tokens == len(ids[d]) and len(p.ids) == 4 * p.length for p in pieces)
    padding = total = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        n = sum(p.length for p in pieces)
        assert n <= limit
        total += n
        padding += 0 if n & (n - 1) == 0 else limit - n
    return padding / total


def test_packing(spark, documents, odd_texts):
    texts = odd_texts + ["a <|endoftext|> b", " lead", "two  spaces \n x", "it's we'll x", "　  y", "x\u0085 y z\u001c w", "don't 12 34!!"] + [r.text for r in documents.orderBy("doc_id").collect()]
    df = frame(spark, texts)
    assert check_pack(packing.pack_documents(df.coalesce(1), TOKENIZER).collect(), texts) < 0.02
    check_pack(packing.pack_documents(df.repartition(5), TOKENIZER, limit=64).collect(), texts, 64)
    assert packing.pack_documents(df.limit(0), TOKENIZER).count() == 0


def test_packing_blocks(spark, documents, monkeypatch):
    texts = [r.text for r in documents.orderBy("doc_id").collect()]
    df = frame(spark, texts).coalesce(1)
    encoder = packing.ByteEncoder(TOKENIZER)
    for piece in slices(pa.array(texts), 40_000):  # slices must not change ids
        ids, bounds = encoder.encode(piece)
        for i in range(0, len(piece), 7):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.full.encode(texts[piece.first + i], add_special_tokens=False).ids
    assert check_pack(packing.pack_documents(df, TOKENIZER).collect(), texts) < 0.02


def test_encoding_with_a_short_memory(monkeypatch, odd_texts):
    rng = random.Random(9)
    special = sorted(t.content for t in Tokenizer.from_file(TOKENIZER).get_added_tokens_decoder().values())
    texts = [words(rng, 80, 60) for _ in range(30)] + [f"a {x} b {x}c  d" for x in special] + [t for t in odd_texts if t and len(t) < 10_000]
    monkeypatch.setattr(packing, "CACHE_MOST", 40)
    encoder, full = packing.ByteEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for piece in slices(pa.array(texts), 600):
        ids, bounds = encoder.encode(piece)
        for i in range(len(piece)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == full.encode(texts[piece.first + i], add_special_tokens=False).ids


def test_cuts_are_best():
    rng = random.Random(4)
    for _ in range(200):
        limit, n = 16, rng.randint(1, 12)
        position = np.cumsum([rng.randint(1, 9) for _ in range(n)]).tolist()
        penalty = [rng.choice([0.0, 3.0, 7.0]) for _ in range(n)]

        def cost(cuts):
            at, c = 0, 0.0
            for k in cuts:
                if position[k] - at > limit:
                    return float("inf")
                c += limit - (position[k] - at) + penalty[k]
                at = position[k]
            return c

        best = min(cost([*[k for k in range(n - 1) if m >> k & 1], n - 1]) for m in range(1 << (n - 1)))
        assert cost(packing.choose_cuts(position, penalty, limit)) == best


# ---- media


def test_media_round_trip(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(media_store, "ARCHIVE_BYTES", 3000)
    texts = odd_texts + [words(random.Random(1), 300) for _ in range(40)]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in media_store.round_trip(df.union(df.limit(1))).collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert media_store.decode_image(media_store.encode_image(raw)) == (payload, len(raw))
        assert got[i].media_sha256 == hashlib.sha256(media_store.encode_image(raw)).hexdigest() and got[i].feature == media_store.feature_of(payload)
    assert media_store.round_trip(df.limit(0)).count() == 0


def test_ranges_and_retries(spark, tmp_path):
    df = frame(spark, [words(random.Random(i), 200) for i in range(30)]).coalesce(1)
    folder = f"file://{tmp_path}/m"
    assert media_store.store(df, folder) == 1
    for size in (500, 4000, 1 << 30):
        r = media_store.ArchiveReader({"path": folder, "rangeBytes": str(size)})
        parts = r.partitions()
        assert len(parts) == max(1, -(-parts[0].parts[0].size // size))
        assert sorted(x for p in parts for b in r.read(p) for x in b.column("offset").to_pylist()) == sorted({x for p in parts for b in r.read(p) for x in b.column("offset").to_pylist()})
        assert sum(b.num_rows for p in parts for b in r.read(p)) == 30

    import zipfile

    path = parts[0].parts[0].archive
    infos = zipfile.ZipFile(path).infolist()

    class Flaky:
        """A file whose handle number `opened` fails at offsets until enough handles have been tried."""

        def __init__(self, real, bad):
            self.real, self.bad = real, bad

        def read_at(self, n, at):
            if self.bad.get(at, 0):
                self.bad[at] -= 1
                raise OSError("gone")
            return self.real.read_at(n, at)

        def close(self):
            self.real.close()

    class Store:
        def __init__(self, bad):
            self.bad, self.opened = bad, 0

        def open_input_file(self, p):
            self.opened += 1
            return Flaky(media_store.filesystem(folder)[0].open_input_file(p), self.bad)

    store = Store({infos[3].header_offset: 2})
    with media_store._Archive(store, path, 4) as archive:
        got = [archive.tried(lambda f: media_store._member(f, i), i.filename) for i in infos]  # noqa: B023
    assert [t for _, t in got] == [3 if i is infos[3] else 1 for i in infos]
    assert [m for m, _ in got] == [zipfile.ZipFile(path).read(i) for i in infos]
    assert store.opened == 3  # the handle that served again goes on serving
    with media_store._Archive(Store({infos[3].header_offset: 99}), path, 2) as archive, pytest.raises(OSError, match=infos[3].filename):
        archive.tried(lambda f: media_store._member(f, infos[3]), infos[3].filename)
    assert media_store.filesystem("file:///tmp/x")[1] == "/tmp/x"


# ---- mixing


def test_raking_meets_targets():
    rng = np.random.default_rng(1)
    cells = [(s, l, t) for s in "abc" for l in ("en", "de") for t in ("t0", "t1")]
    tokens = rng.integers(1000, 9000, len(cells)).astype(float)
    mix = source_mixing.Mix(fraction=0.2, targets={"source": {"a": 0.5, "b": 0.25, "c": 0.25}})
    p = source_mixing.rake(cells, tokens, mix)
    assert (p <= 1).all() and (p > 0).all()
    taken = tokens * p
    share = {s: sum(v for c, v in zip(cells, taken) if c[0] == s) / taken.sum() for s in "abc"}
    assert all(abs(share[s] - w) < 1e-4 for s, w in (("a", 0.5), ("b", 0.25), ("c", 0.25)))
    assert abs(taken.sum() / tokens.sum() - 0.2) < 1e-4
    # Plain proportional fitting, margin by margin, ends at the same point.
    q = np.full(len(cells), 0.2)
    for _ in range(2000):
        for k, name in enumerate(source_mixing.MARGINS):
            names = sorted({c[k] for c in cells})
            have = np.array([tokens[[c[k] == n for c in cells]].sum() for n in names])
            want = (have / tokens.sum()) ** mix.tempering
            want = want / want.sum() if name not in mix.targets else np.array([mix.targets[name][n] for n in names])
            for n, w in zip(names, want):
                at = np.array([c[k] == n for c in cells])
                q[at] *= w * tokens.sum() * 0.2 / (tokens[at] * q[at]).sum()
    assert np.allclose(p, q, atol=1e-5)


def test_mixing_rules(spark, documents, odd_texts):
    df = frame(spark, odd_texts)
    got = source_mixing.calibrated(df).collect()
    assert len(got) == len(odd_texts) and all(0 < r.probability <= 1 for r in got)
    assert source_mixing.calibrated(df.limit(0)).count() == 0 and source_mixing.take(df.limit(0)).count() == 0
    flags = {r.doc_id: r.selected for r in source_mixing.calibrated(documents).collect()}
    taken = source_mixing.take(documents)
    assert taken.columns == documents.columns and {r.doc_id for r in taken.collect()} == {d for d, x in flags.items() if x}
    all_rows = source_mixing.calibrated(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas()
    expected = (all_rows.n_tokens * all_rows.probability).sum()
    assert abs(all_rows[all_rows.selected].n_tokens.sum() / expected - 1) < 0.05
    assert abs(expected / all_rows.n_tokens.sum() - source_mixing.Mix().fraction) < 0.01


def test_joined_probabilities_take_the_same_rows(spark, documents, monkeypatch):
    docs = documents.withColumn("probability", F.lit("x"))  # a clashing name
    mix = source_mixing.Mix(0.5)
    few = Counter(map(tuple, source_mixing.take(docs.drop("probability"), mix).collect()))
    monkeypatch.setattr(source_mixing, "BROADCAST_CELLS", 0)
    assert Counter(map(tuple, source_mixing.take(docs.drop("probability"), mix).collect())) == few
    assert Counter(tuple(r)[:-1] for r in source_mixing.take(docs, mix).collect()) == few


def test_every_category_is_raked(spark):
    """400 sources: the lightest have targets of their own, and a target for no tokens is an error."""
    rows = [(i, "word " * (2 if i % 400 == 399 else 3), "en", f"s{i % 400}", "") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, topic string")
    mix = source_mixing.Mix(fraction=0.1, targets={"source": {"s399": 0.005}})
    got = source_mixing.calibrated(docs, mix).collect()
    expected = Counter()
    for r in got:
        expected[r.source] += r.n_tokens * r.probability
    assert len(expected) == 400 and abs(expected["s399"] / expected.total() - 0.005) < 1e-6
    assert {r.doc_id for r in source_mixing.take(docs, mix).collect()} == {r.doc_id for r in got if r.selected}
    with pytest.raises(ValueError, match="nowhere"):
        source_mixing.calibrated(docs, source_mixing.Mix(targets={"source": {"nowhere": 0.5}}))


def test_topics(spark):
    """Texts of one vocabulary share a topic, whatever their language; a topic column is taken as it is."""
    rng = random.Random(8)
    vocabulary = [["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(7)) for _ in range(40)] for _ in range(8)]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 8]) for _ in range(60)), ("en", "de")[i // 8 % 2], "s") for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r.topic for r in source_mixing.calibrated(docs).collect()}
    most = [Counter(found[i] for i in range(k, 480, 8)).most_common(1)[0] for k in range(8)]
    assert len({t for t, _ in most}) >= 7 and sum(n for _, n in most) > 0.9 * 480
    named = docs.withColumn("topic", F.when(F.col("doc_id") < 240, F.concat(F.lit("subject"), F.col("doc_id") % 3)))
    got = source_mixing.calibrated(named).collect()
    assert all(r.topic == (f"subject{r.doc_id % 3}" if r.doc_id < 240 else "") for r in got)
    taken = source_mixing.take(named)
    assert taken.columns == named.columns and {r.doc_id for r in taken.collect()} == {r.doc_id for r in got if r.selected}


def test_topics_count_every_document(spark):
    """Weights, means, centres and leads read again over all of more documents than one block holds, however they are dealt out."""
    rng = random.Random(9)
    vocabulary = [["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(7)) for _ in range(30)] for _ in range(8)]
    texts = [" ".join(rng.choice(vocabulary[k if rng.random() < 0.7 else rng.randrange(8)]) for _ in range(rng.randrange(20, 60))) for k in (min(rng.randrange(9), 7) for _ in range(4500))] + ["", "one two", None]
    langs = [("en", "de", None, "fr")[rng.randrange(4)] for _ in texts[:-4]] + ["xx"] * 4
    docs = spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate(zip(texts, langs))], "doc_id bigint, text string, lang string, source string")
    found = source_mixing.fit_topics(docs)
    again = source_mixing.fit_topics(docs.repartition(7))
    assert all(np.array_equal(getattr(found, k), getattr(again, k)) for k in ("weight", "centres", "lead"))
    assert set(found.means) == {"", "en", "de", "fr", "xx"}

    counts = np.vstack([source_mixing.count_words(p)[0] for p in slices(pa.array(texts))])
    weight = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1
    assert np.array_equal(found.weight, weight)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    x, of = unit(np.sqrt(counts) * weight), np.array([lang or "" for lang in langs])
    for lang, mean in found.means.items():
        assert np.allclose(mean, x[of == lang].mean(axis=0), atol=1e-8)
        x[of == lang] -= mean
    x, words = unit(x)[counts.any(axis=1)], counts.sum(axis=1)[counts.any(axis=1)]
    likes = x @ found.centres.T
    near = likes.argmax(axis=1)
    assert np.allclose(unit(np.stack([x[near == k].sum(axis=0) for k in range(8)])), found.centres, atol=1e-4)
    share = lambda lead: np.bincount((likes + lead).argmax(axis=1), weights=words, minlength=8) / words.sum()
    assert np.ptp(share(found.lead)) < 0.01 < np.ptp(share(0))


def test_mixing_reads_texts_once(spark):
    """Measures come from the cells of the fit; take, which gives whole rows back, reads them once more and keeps what calibrated selects."""
    rows = [(i, " ".join(f"{'alpha bravo gamma delta sigma omega'.split()[(i * j) % 6]}{i % 7}" for j in range(1, 12)), ("en", "de")[i % 2], "ab"[i % 3 == 0]) for i in range(300)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs = docs.mapInArrow(counted, docs.schema)
    chosen = {r.doc_id for r in source_mixing.calibrated(docs).where("selected").collect()}
    assert read.value == 300 and 0 < len(chosen) < 300
    assert {r.doc_id for r in source_mixing.take(docs).collect()} == chosen
    assert read.value == 900


def test_cells_of_frequent_words():
    """Counts on both sides of what a cell holds are kept, beside texts that have none."""
    texts = ["alpha " * 63 + "bravo", "", "alpha " * 64 + "gamma " * 5000, "delta", "bravo " * 65]
    counts = np.vstack([topics.count_words(p)[0] for p in slices(pa.array(texts))])
    weight = np.linspace(0.5, 2, topics.BUCKETS)
    cells = topics.cells_of(*topics._coded(counts)[:3], weight)
    got = np.zeros(counts.shape)
    got[cells.doc, cells.at] = cells.value
    x = np.sqrt(counts) * weight
    assert np.allclose(got, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), rtol=1e-12, atol=0)


def test_topics_of_few_texts_and_many_languages(spark, monkeypatch):
    """No topic more than there are profiles; rare languages share a mean; whatever has no profile takes the topic of most lead."""
    rows = [(i, ("alpha alpha bravo", "gamma delta delta", "sigma sigma omega")[i % 3], "en", "s") for i in range(60)] + [(100 + i, "alpha gamma", f"l{i}", "s") for i in range(40)] + [(200, "", "en", "s"), (201, None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    alone = source_mixing.fit_topics(docs)
    assert len(alone.means) == 42 and len(alone.centres) == 3
    topic = {r.id: r.topic for r in source_mixing.measure(docs, topics=alone).collect()}
    assert len({topic[i] for i in range(60)}) == 3 and {topic[i] for i in range(100, 140)} | {topic[200], topic[201]} == {f"t{alone.lead.argmax()}"}
    monkeypatch.setattr(topics, "MOST_LANGS", 10)
    shared = source_mixing.fit_topics(docs)
    assert set(shared.means) == {"", "en"} and np.allclose(shared.means["en"], alone.means["en"])
    none = source_mixing.fit_topics(docs.where("text is null or text = ''"))
    assert none.centres.shape == (1, topics.BUCKETS) and not none.centres.any()


def filled(share, have, wanted):
    """Water-filling in plain steps: the category shortest of its share is made whole, one at a time."""
    whole = {}
    while True:
        rest = {k: v for k, v in share.items() if k not in whole}
        left = wanted - sum(whole.values())
        want = {k: v / sum(rest.values()) * left for k, v in rest.items()}
        short = max((k for k in want if want[k] > have[k] * (1 + 1e-12)), key=lambda k: want[k] / have[k], default=None)
        if short is None:
            return whole | want
        whole[short] = have[short]


def test_rare_categories_are_taken_whole():
    tokens = np.array([800.0, 100.0, 80.0, 20.0])
    cells = [("a", "en", "t0"), ("b", "en", "t0"), ("a", "es", "t0"), ("b", "es", "t0")]
    fit = source_mixing.fit_mix(cells, tokens, source_mixing.Mix(fraction=0.9))
    assert np.allclose(fit.p, [0.875, 1, 1, 1], atol=1e-4) and abs(fit.fraction - 0.9) < 1e-4
    for k, by in enumerate((("a", "b"), ("en", "es"))):
        have = {n: sum(t for c, t in zip(cells, tokens) if c[k] == n) for n in by}
        share = {n: have[n] ** 0.7 / sum(v**0.7 for v in have.values()) for n in by}
        aim = filled(share, have, 900)
        for margin, name, n, asked, aimed, reached in fit.shares:
            if name in by:
                assert (n, asked, aimed) == (have[name], pytest.approx(share[name]), pytest.approx(aim[name] / 900))
                assert reached == pytest.approx(aimed, abs=1e-4)


@pytest.mark.parametrize("tokens", [10**6, 10**9, 10**12])
def test_one_token_of_a_rare_language_does_not_shrink_the_mix(tokens):
    fit = source_mixing.fit_mix([("a", "en", "t"), ("b", "en", "t"), ("a", "xx", "t")], np.array([tokens, tokens / 3, 1.0]), source_mixing.Mix(fraction=0.9))
    assert abs(fit.fraction - 0.9) < 1e-3 and fit.p[2] > 0.999


def test_water_filling_against_plain_steps():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        have = rng.exponential(size=n) ** 3 * 1000 + 1e-3
        share = (have / have.sum()) ** rng.uniform(0, 1)
        share /= share.sum()
        f = rng.uniform(0.05, 1)
        got = source_mixing._reachable(share, have, f * have.sum()) * f * have.sum()
        want = filled(dict(enumerate(share)), dict(enumerate(have)), f * have.sum())
        assert np.allclose(got, [want[k] for k in range(n)], rtol=1e-6)


def test_measures_read_again(spark, documents):
    """Tokens and topics of every document in plain Python, word by word."""
    topics = source_mixing.fit_topics(documents)
    bucket = {}

    def buckets(word):
        if word not in bucket:
            bucket[word] = int(source_mixing.split_words(next(source_mixing.slices(pa.array([word.decode()]))), fold_case=True).hash[0] % np.uint64(source_mixing.BUCKETS))
        return bucket[word]

    def unit(x):
        return x / max(math.sqrt(sum(v * v for v in x)), 1e-12)

    want = {}
    for r in documents.collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())
        counts = Counter(buckets(w) for w in words if len(w) >= 5)
        x = np.zeros(source_mixing.BUCKETS)
        for b, n in counts.items():
            x[b] = math.sqrt(n) * topics.weight[b]
        x = unit(unit(x) - topics.means.get(r.lang or "", topics.means[""])) if counts else np.zeros(source_mixing.BUCKETS)
        likes = [sum(a * c for a, c in zip(x, centre)) + lead for centre, lead in zip(topics.centres, topics.lead)]
        want[r.doc_id] = (len(words), [f"t{k}" for k, v in enumerate(likes) if v > max(likes) - 1e-9])
    for r in source_mixing.measure(documents, topics=topics).collect():
        assert r.n_tokens == want[r.id][0] and r.topic in want[r.id][1]


def test_shares_as_rows(spark):
    rows = [(i, "word " * 10, "en" if i % 50 else "xx", "ab"[i % 2], "t") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, topic string")
    found = {(r.margin, r.category): r for r in source_mixing.shares(source_mixing.measure(docs), source_mixing.Mix(fraction=0.9)).collect()}
    assert set(found) == {("source", "a"), ("source", "b"), ("lang", "en"), ("lang", "xx"), ("topic", "t")}
    xx = found["lang", "xx"]
    assert xx.n_tokens == 200 and xx.asked > 0.06 and xx.aimed == pytest.approx(200 / 9000) and xx.reached == pytest.approx(xx.aimed, rel=1e-3)


def test_rows_without_id_are_drawn_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "en", "a", "t") for i in range(2000)] + [(None, "same", "en", "a", "t")] * 2, "doc_id bigint, text string, lang string, source string, topic string")
    taken = source_mixing.take(docs, source_mixing.Mix(fraction=0.5))
    assert 900 < taken.count() < 1100 and taken.where("text = 'same'").count() in (0, 2)
    assert source_mixing.calibrated(docs, source_mixing.Mix(fraction=0.5)).where("selected").count() == taken.count()


def test_mixing_of_empty_texts(spark):
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(("", None, " \n") * 50)], "doc_id bigint, text string, lang string, source string")
    rows = source_mixing.calibrated(docs, source_mixing.Mix(fraction=0.6)).collect()
    assert {(r.probability, r.n_tokens) for r in rows} == {(0.6, 0)} and 60 < sum(r.selected for r in rows) < 120


def test_pipeline_mixing_reaches_its_shares(spark):
    """Shares of expected and of sampled words, counted here, against tempered ones of which rare categories are whole."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    p = {r.doc_id: r.probability for r in source_mixing.calibrated(docs, corpus_pipeline.MIX).collect()}
    taken = {r.doc_id for r in corpus_pipeline.mixing(spark, docs, SF).select("doc_id").collect()}
    rows = [(r.doc_id, r.source or "", r.lang or "", len((r.text or "").encode().split())) for r in docs.collect()]
    total = sum(r[3] for r in rows)
    wanted = corpus_pipeline.MIX.fraction * total
    for k in (1, 2):
        have, expected, sampled = Counter(), Counter(), Counter()
        for r in rows:
            have[r[k]] += r[3]
            expected[r[k]] += r[3] * p[r[0]]
            sampled[r[k]] += r[3] * (r[0] in taken)
        z = sum((v / total) ** 0.7 for v in have.values())
        want = filled({n: (v / total) ** 0.7 / z for n, v in have.items()}, have, wanted)
        assert all(abs(expected[n] - w) < 0.005 * wanted for n, w in want.items())
        assert all(abs(sampled[n] - w) < 0.012 * wanted for n, w in want.items())
    assert abs(expected.total() / total - corpus_pipeline.MIX.fraction) < 0.005


# ---- pipeline


def test_pipeline_against_brute_force(spark, documents):
    """Each stage's rows follow from the one before; the last are held against texts recomputed here."""
    docs = documents.collect()
    kept = {r.doc_id for r in QUERIES["op7_quality_rules"](spark, SF).where("kept").collect()}
    rows = [r for r in docs if r.doc_id in kept]
    tops = brute_components([r.text for r in rows])
    rows = [r for i, r in enumerate(rows) if tops[i][1] == i]
    texts = {}
    for r in rows:
        spans, at, out = secret_scan.scan(r.text), 0, ""
        for s, k, e in spans:
            if s >= at:
                out += r.text[at:s] + f"[{secret_scan.KINDS[k]}]"
            at = max(at, e)
        texts[r.doc_id] = out + r.text[at:]
    staged = spark.createDataFrame([(r.doc_id, texts[r.doc_id], r.lang, r.source, r.n_chars) for r in rows], documents.schema)
    chosen = {r.doc_id for r in source_mixing.calibrated(staged, corpus_pipeline.MIX).where("selected").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    full = Tokenizer.from_file(TOKENIZER)
    want = {d: len(full.encode(texts[d], add_special_tokens=False).ids) + 1 for d in chosen}
    seen = Counter()
    for r in got:
        seen[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert seen == want


def test_stages_keep_columns_and_survive_odd_tables(spark, odd_texts):
    df = frame(spark, odd_texts)
    df = df.union(df.limit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.count() <= df.count(), name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), SF).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, "some words " * 30 if i else "short", "en", "a", 1, f"mine{i}", "p") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _text_hash_of_row string, `_text_hash` string")
    kept = dict(corpus_pipeline.STAGES)["quality_rules"](spark, df, SF)
    assert kept.columns == df.columns and {(r.doc_id, r._text_hash_of_row) for r in kept.collect()} <= {(i, f"mine{i}") for i in range(3)}


def test_few_ranges_of_many_archives(monkeypatch, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "manifest").mkdir()
    rng = random.Random(2)
    sizes = [rng.choice((10, 300, 5000)) for _ in range(500)]
    pq.write_table(pa.table({"archive": [f"a{i:04}" for i in range(500)], "bytes": sizes}), tmp_path / "manifest" / "m.parquet")
    monkeypatch.setattr(media_store, "MOST_RANGES", 40)
    parts = media_store.ArchiveReader({"path": f"file://{tmp_path}", "rangeBytes": "100"}).partitions()
    assert len(parts) <= 40
    by = Counter()
    for p in parts:
        for r in p.parts:
            by[r.archive.rpartition("/")[2]] += r.end - r.start
    assert by == {f"a{i:04}": n for i, n in enumerate(sizes)}


def test_stages_judge_rows_without_id_and_keep_one_of_repeats(spark):
    rng = random.Random(6)
    good, other = words(rng, 120, 10**9), words(rng, 120, 10**9)
    rows = [(None, "short"), (None, good), (1, good), (1, good), (2, good + " more"), (3, other), (3, "x y")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    judged = stages["quality_rules"](spark, df, SF)
    assert Counter((r.doc_id, r.text) for r in judged.collect()) == Counter(x for x in rows if x[1] not in ("short", "x y"))
    once = stages["near_duplicates"](spark, df, SF)
    assert Counter((r.doc_id, r.text) for r in once.collect()) == Counter([(None, "short"), (None, good), (1, good), (3, other), (3, "x y")])
