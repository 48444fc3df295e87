"""Chat formatting, secret scans, quality rules, toxicity, language ID."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fileledger.llm import chat_format, language_id, quality_rules, secret_scan, toxicity
from fileledger.llm.entries import QUERIES
from fileledger.llm.kernel import slices
from tests.llm.conftest import SF, frame, words

# ---- chat formatting


def test_chat_round_trip_with_parts(spark):
    part = lambda kind, text=None, uri=None, amount=None: (kind, text, uri, amount)
    hostile = "\\ <turn user>\n</turn>\n \\l \\s \\g <image:0:1/> \\\\"
    rows = [
        (1, 1, "assistant", [part("text", hostile), part("image", uri="i.png", amount=784.0 * 3), part("text", "end")], "x"),
        (1, 0, "user", [part("audio", uri="a.wav", amount=2.0), part("document", uri="d.pdf", amount=2.0), part("odd", uri="o")], "x"),
        (2, 0, "user", None, "x"),
        (2, 1, "assistant", [part("text", None)], "x"),
        (3, None, None, [part("text", "q")], "x"),
        (3, None, None, [part("text", "q")], "x"),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>, formatted string")
    out = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    turns = chat_format.parse(out[1].formatted)
    assert [r for r, _ in turns] == ["user", "assistant"]
    assert turns[1][1] == hostile + "<image:1:3/>" + "end"
    loss = [chat_format.unescape(out[1].formatted[s.start : s.end]) for s in out[1].loss_spans]
    assert loss == [hostile, "end"]
    assert [(a.kind, a.uri, a.tokens) for a in out[1].attachments] == [("audio", "a.wav", 50), ("document", "d.pdf", 2048), ("odd", "o", 0), ("image", "i.png", 3)]
    assert all(out[1].formatted[a.start : a.end].startswith("<") for a in out[1].attachments)
    assert chat_format.parse(out[2].formatted) == [("user", ""), ("assistant", "")]
    assert chat_format.parse(out[3].formatted) == [("", "q"), ("", "q")]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_query(spark):
    got = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, SF).collect()}
    said = "\\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-7].loss_chars == len(said)


# ---- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def checked(prefix, rng):
    body = "".join(rng.choice(secret_scan._DIGITS) for _ in range(30))
    n, tail = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        tail = secret_scan._DIGITS[r] + tail
    return prefix + body + tail.rjust(6, "0")


def test_scan_against_patterns():
    rng = random.Random(3)
    bits = ["password", "PassWord=", "token: ", "secret='", "api_key", "apikey=", "abc123", "=", ":", '"', " ", "é", "AKIA", "AKIA" + "Z9" * 9, "0f" * 12, "deadbeef", "\n", "passwd==", "tokentoken="]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [x for x in secret_scan.scan(text) if x[1] < 3] == brute_secrets(text), text


def test_checksums():
    rng = random.Random(1)
    good = checked("ghp_", rng)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    text = f"x {good} {bad} {checked('npm_', rng)} card: 4111 1111 1111 1111 card 4111111111111112 IBAN GB82 WEST 1234 5698 7654 32"
    assert Counter(secret_scan.KINDS[k] for _, k, _ in secret_scan.scan(text)) == {"forge": 1, "registry": 1, "card": 1, "iban": 1}


def test_secret_tables(spark, documents, odd_texts):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in QUERIES["op8_secret_scan"](spark, SF).collect():
        base = brute_secrets(texts[r.doc_id])
        spans = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
    df = frame(spark, [*odd_texts, "token=abcdef12 and " + "ab" * 20])
    assert sum(len(r.secrets) for r in secret_scan.find_secrets(df).collect()) == 2
    red = secret_scan.redact_secrets(df, length_col="n_chars")
    assert red.columns == df.columns
    got = [r.text for r in red.orderBy("doc_id").collect()]
    assert got[:-1] == odd_texts and got[-1] == "[assign] and [hex]"
    assert secret_scan.find_secrets(df.limit(0)).count() == 0 and secret_scan.redact_secrets(df.limit(0)).count() == 0


# ---- quality rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(text):
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    mark = [False] * len(w)
    for i in range(len(w) - 4):
        if five[tuple(w[i : i + 5])] > 1:
            mark[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(mark)


def test_counts(spark, documents, odd_texts):
    rng = random.Random(5)
    texts = odd_texts + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) + rng.choice(["", "\n", "\na b\na b\n"]) for _ in range(200)] + [r.text for r in documents.collect()]
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.count_rules(frame(spark, texts)).collect()}
    assert got == {i: brute_counts(t or "") for i, t in enumerate(texts)}


def test_forest_and_threshold():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 0.05, (600, 5)) ** 2
    bad = good[:60] + np.eye(5)[rng.integers(0, 5, 60)]
    x = np.concatenate([good, bad])
    is_good = np.arange(660) < 600
    f = quality_rules.fit_forest(x)
    s = f.scores(x)
    t = quality_rules.calibrate(s, is_good)
    assert (s[is_good] > t).mean() <= 0.01 and (s[~is_good] > t).mean() > 0.9
    one = x[:1]
    node, depth = 0, 0.0
    for t_ in range(len(f.column)):  # a plain walk gives the same lengths
        node = 0
        while f.column[t_, node] >= 0:
            node = f.left[t_, node] + (one[0, f.column[t_, node]] >= f.value[t_, node])
        depth += f.length[t_, node]
    assert abs(f.path_lengths(one)[0] - depth / len(f.column)) < 1e-9


def test_judging(spark, labels, odd_texts):
    df = frame(spark, odd_texts, first=10_000)
    got = quality_rules.judge(df, labels)
    assert got.count() == len(odd_texts) and got.where("kept and n_words < 10").count() == 0
    assert quality_rules.judge(df.limit(0), labels).count() == 0
    assert quality_rules.judge(df, labels.limit(0)).where("not kept and not base_failed").count() == 0
    q = QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert q[q.quality == 1].kept.mean() > 0.99 and q[q.quality == 0].kept.mean() < 0.3


def test_ranks_by_digits(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 400), np.zeros(200), [-0.0, 1e-300, -1e300, 5.0, 5.0]])
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "a double, b double").repartition(5)
    ranks = [0, 1, 17, 300, 400, len(x) - 1]
    got = quality_rules.order_statistics(df, [(c, r) for c in (0, 1) for r in ranks])
    assert got == [*np.sort(x)[ranks], *np.sort(-x)[ranks]]


def test_every_labelled_row_fills_the_trees(spark, monkeypatch):
    """25 000 good rows of one kind and 30 of another: bands, trees and threshold against all of them in plain numpy."""
    monkeypatch.setattr(quality_rules, "TREES", 8)
    rng = random.Random(1)
    row = lambda i: (i, 1 if i < 25_030 else 0, 100 + rng.randrange(50), 500, rng.randrange(4) if i < 25_000 else 90, 0, 0, 10, rng.randrange(20), 5)
    rows = [row(i) for i in range(25_060)]
    names = (*quality_rules.COUNTS, *quality_rules.MORE)
    bands, forest, threshold = quality_rules.fit(spark.createDataFrame(rows, ", ".join(["doc_id bigint, quality int", *(f"{n} bigint" for n in names)])))
    x = quality_rules.statistics({n: np.array([r[i + 2] for r in rows]) for i, n in enumerate(names)})
    good = np.arange(len(rows)) < 25_030
    want = quality_rules.fit_bands(x[good])
    for got, plain in ((bands.low, want.low), (bands.high, want.high), (bands.unit, want.unit)):
        assert np.allclose(got, plain)
    e, n = want.beyond(x[good]), 25_030
    for t in range(8):

        def check(at, level, part):
            mass = len(part) * 64 / n
            if mass <= 1 or level == 8:
                assert forest.column[t, at] == -1 and forest.length[t, at] == pytest.approx(level + quality_rules._expected_of(mass))
                return
            below = part[:, forest.column[t, at]] < forest.value[t, at]
            check(forest.left[t, at], level + 1, part[below])
            check(forest.left[t, at] + 1, level + 1, part[~below])

        check(0, 0, e)
    assert threshold == quality_rules.calibrate(forest.scores(want.beyond(x)), good)


def test_judging_sees_every_statistic(spark, labels):
    """Texts that pass the base rules and hold no symbol: repeated short lines, one-letter words, words run together."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "er", "on", "the", "st", "re"]) for _ in range(rng.randint(1, 3)))
    lines = "\n".join(x for _ in range(60) for x in (" ".join(word() for _ in range(8)) + ".", "Buy now."))
    letters = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
    joined = " ".join("".join(word() for _ in range(8)) for _ in range(80))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    df = docs.union(spark.createDataFrame([(-1, lines), (-2, letters), (-3, joined)], docs.schema))
    got = quality_rules.judge(df, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")).where("doc_id < 0").collect()
    assert [(r.base_failed, r.kept) for r in got] == [(False, False)] * 3


# ---- toxicity


def test_gradients():
    rng = np.random.default_rng(2)
    s = toxicity.windows_of(next(slices(pa.array(["the quick brown fox " * 12, "idiot you are, an idiot!", "a"]))))
    net = toxicity.Network(np.zeros(toxicity.WORDS, np.float32), np.ones(toxicity.WORDS, bool))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y, w = np.array([0.0, 1, 0, 1, 0])[: len(s.windows)], np.ones(len(s.windows))
    g = net.gradients(s, s.windows, y, w)

    def loss():
        z = net.forward(net.inputs(s), s.windows)
        return np.mean(np.logaddexp(0, z) - y * z)

    for name in ("wf", "uf", "bf", "wb", "ub", "wa", "va", "wo", "word", "char"):
        v = net.p[name]
        hot = np.argwhere(np.abs(g[name]) > 1e-7)
        for at in map(tuple, hot[rng.choice(len(hot), min(3, len(hot)), replace=False)]):
            old, eps = v[at], 1e-3
            v[at] = old + eps
            up = loss()
            v[at] = old - eps
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-4 + 0.02 * abs(g[name][at]), (name, at)


def test_windows_cover_every_word():
    rng = random.Random(0)
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        s = toxicity.windows_of(next(slices(pa.array([words(rng, n).replace("\n", " ")]))))
        seen = s.windows[s.windows >= 0]
        assert len(np.unique(seen)) == len(s.bucket)
        assert len(s.windows) == (0 if n == 0 else max(1, -(-(n - toxicity.WINDOW) // toxicity.STRIDE) + 1))


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op9_toxicity"](spark, d).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    h = got[got.held_out].merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    hit = h[h.predicted == 1].toxic.mean(), h[h.toxic == 1].predicted.mean()
    assert min(hit) > 0.75, hit


def test_toxicity_rules(spark, labels, odd_texts):
    df = frame(spark, odd_texts, first=50_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(df.select("doc_id", "text"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got[50_000] == got[50_001] == got[50_002] < 0.3 and got[50_003] == got[50_004]
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(df, labels.limit(0)).collect()} == {0.0}


# ---- language ID


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op6_language_id"](spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").where(language_id.held_out(F.col("doc_id")))
    j = docs.select("doc_id", F.col("lang").alias("truth")).join(got, "doc_id")
    assert j.where("lang = truth").count() >= 0.97 * j.count()
    assert got.count() == 1250


def test_evidence_decides_where_text_is_silent(spark, odd_texts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = language_id.fit(docs)
    de, en = (docs.where(f"lang = '{x}'").limit(30).collect() for x in ("de", "en"))
    page = lambda i, host, lang, text: (i, f"https://{host}/p", f'<html lang="{lang}"><script>the and of</script><p>{text}</p></html>')
    rows = [page(i, "x.haus.de", "de", r.text) for i, r in enumerate(de)] + [page(100 + i, "x.house.com", "en", r.text) for i, r in enumerate(en)]
    rows += [page(900, "x.haus.de", "", ""), page(901, "y.house.com", "", ""), page(902, "z.none.org", "de", ""), (903, None, None)]
    p = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.lang for r in language_id.fuse(language_id.page_rows(p).drop("url", "html"), langs, table).collect()}
    assert (got[900], got[901], got[902]) == ("de", "en", "de") and got[903] in langs
    odd = language_id.fuse(language_id.document_rows(frame(spark, odd_texts).select("doc_id", "text", "source")).drop("source"), langs, table)
    assert odd.count() == len(odd_texts) and odd.where("lang is null").count() == 0
    none = language_id.fuse(language_id.document_rows(frame(spark, ["a"]).select("doc_id", "text", "source")).drop("source"), *language_id.fit(docs.limit(0)))
    assert none.first().lang == "und"


def brute_fusion(rows, langs, like):
    """rows (key, text, declared, suffix, host, domain) -> language and confidence, one row at a time."""
    n = len(langs)
    texts = []
    for _, text, *_ in rows:
        b = text.encode().lower().replace(b"\n", b" ")
        grams = [b[i : i + 3] for i in range(len(b) - 2)]
        plain = lambda c: c >= 128 or 97 <= c <= 122 or c == 32
        grams = [g for g in grams if all(map(plain, g)) and any(c > 32 for c in g)]
        bucket = [int(language_id._trigrams(next(iter(slices(pa.array([g.decode("latin-1")]).cast(pa.binary()).view(pa.string())))))[0][0]) if max(g) < 128 else None for g in grams]
        assert None not in bucket  # plain letters only in this test
        score = np.array([sum(like[k, x] for x in bucket) for k in range(n)]) * min(len(bucket), language_id.TEXT_WEIGHT) / max(len(bucket), 1)
        p = np.exp(score - score.max())
        texts.append(p / p.sum())
    sums = {}
    for (_, _, declared, suffix, host, domain), p in zip(rows, texts):
        for key in (("all",), ("declared", declared), ("suffix", suffix), ("host", host, domain), ("domain", domain)):
            sums[key] = sums.get(key, 0) + p
    prior = (sums["all",] + 1) / (sums["all",].sum() + n)
    out = {}
    for (key, _, declared, suffix, host, domain), p in zip(rows, texts):
        smooth = lambda k, towards: (np.maximum(sums[k] - p, 0) + language_id.SMOOTHING * towards) / (max(sums[k].sum() - 1, 0) + language_id.SMOOTHING)  # noqa: B023, E731
        by_host = smooth(("host", host, domain), smooth(("domain", domain), prior))
        score = np.log(np.maximum(p, 1e-12)) + np.log(np.maximum(by_host, language_id.FLOOR))
        for k in (("declared", declared), ("suffix", suffix)):
            if k[1]:
                score = score + np.log(np.maximum(smooth(k, prior) / prior, language_id.FLOOR))
        w = np.exp(score - score.max())
        out[key] = (langs[int(score.argmax())], round(float(1 / w.sum()), 6), langs[int(p.argmax())])
    return out


def test_fusion_against_brute_force(spark):
    rng = random.Random(12)
    letters = {f"l{k:02d}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for k in range(70)}
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))
    train = [(text(x, 60), x) for x in letters for _ in range(2)]
    langs, like = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    assert langs == sorted(letters)
    rows = []
    for i in range(120):
        lang = rng.choice(langs)
        host = rng.choice(["a.x.org", "b.x.org", "c.y.de", ""])
        rows.append((i, text(lang, rng.choice([0, 1, 3, 30])), rng.choice(["", lang, "zz"]), rng.choice(["", "de", "org"]), host, host[2:]))
    df = spark.createDataFrame([(r[0], r[1], False, *r[2:]) for r in rows], "doc_id bigint, text string, is_markup boolean, declared string, suffix string, host string, domain string")
    got = {r.doc_id: (r.lang, r.confidence, r.text_lang) for r in language_id.fuse(df, langs, like.astype(np.float32)).collect()}
    want = brute_fusion(rows, langs, like.astype(np.float32))
    for key, (lang, confidence, text_lang) in want.items():
        assert got[key][0] == lang and abs(got[key][1] - confidence) < 1e-4, (key, got[key], want[key])
        assert got[key][2] == text_lang or not rows[key][1]


def plain_score(model, text):
    """The score of one text, window by window and step by step, without any of the operator's kernels but the hash of a word."""
    piece = next(iter(slices(pa.array([text]))))
    s = toxicity.windows_of(piece)
    p, h, best = model.network.p, toxicity.HIDDEN, None
    sig = lambda x: 1 / (1 + np.exp(-x))
    found = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)}))
    starts = range(0, max(1, len(found) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if found else []
    index = {}
    for row in s.windows:
        index |= {int(k): None for k in row if k >= 0}
    assert len(index) == len(set(found)) and len(s.windows) == len(starts)
    vector = {k: np.concatenate([p["word"][s.bucket[k]], p["char"][s.trigrams[s.by_word[k] : s.by_word[k + 1]]].mean(axis=0)]) for k in index}
    for row, start in zip(s.windows, starts):
        start = min(start, max(0, len(found) - toxicity.WINDOW))
        words_here = found[start : start + toxicity.WINDOW]
        assert sum(k >= 0 for k in row) == len(words_here)
        xs = [vector[int(k)] for k in row if k >= 0]
        states = []
        for way in "fb":
            state, out = np.zeros(h), []
            for x in xs if way == "f" else xs[::-1]:
                g, hu = x @ p[f"w{way}"] + p[f"b{way}"], state @ p[f"u{way}"]
                z, r = sig(g[:h] + hu[:h]), sig(g[h : 2 * h] + hu[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * hu[2 * h :])
                out.append(state)
            states.append(out if way == "f" else out[::-1])
        hidden = np.array([np.concatenate(pair) for pair in zip(*states)])
        energy = np.tanh(hidden @ p["wa"]) @ p["va"]
        weight = np.exp(energy - energy.max())
        logit = float((weight / weight.sum()) @ hidden @ p["wo"] + p["bo"][0])
        best = logit if best is None else max(best, logit)
    return model.empty if best is None else float(sig(model.slope * best + model.offset))


def test_scores_against_a_plain_reading(spark, documents, labels):
    model = toxicity.fit(documents, labels)
    texts = [r.text for r in documents.where("text is not null").orderBy("doc_id").limit(25).collect()] + ["", "one", "Ünï cödé " * 40, "same " * 33]
    got = np.concatenate([model.scores(q) for q in slices(pa.array(texts))])
    for text, score in zip(texts, got):
        assert abs(plain_score(model, text) - score) < 1e-4


def test_toxic_labels_that_differ_and_repeat(spark):
    """One toxic label of several decides, and a repeated one counts once."""
    rng = random.Random(11)
    docs = frame(spark, [words(rng, 60, 300) + (" vile" * 3 if i % 4 == 0 else "") for i in range(200)])
    once = [(i, int(i % 4 == 0)) for i in range(200)]
    schema = "doc_id bigint, toxic int"
    plain = spark.createDataFrame(once, schema)
    twice = spark.createDataFrame(once + [(i, 0) for i in range(0, 200, 4)] + once[:40] + [(None, 1)], schema)
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()} for labels in (plain, twice))
    assert a == b and len(a) == 200


def test_quality_verdicts_read_again(spark, documents, labels):
    """Statistics, bands, walks through the trees and the threshold of every document in plain Python, against the operator's verdicts."""
    names = (*quality_rules.COUNTS, *quality_rules.MORE)
    counted = quality_rules.count_rules(documents, "doc_id", "text", ())
    rows = {r.doc_id: r.asDict() for r in counted.collect()}
    good = {r.doc_id: r.quality == 1 for r in labels.collect()}

    def plain_statistics(r):
        words, chars = max(r["n_words"], 1), max(r["word_chars"], 1)
        rate = lambda x, by: math.sqrt(min(x / by, 4.0))
        return [rate(r["n_symbols"], words), rate(r["n_marks"], words), rate(r["n_repeat_words"], words), rate(r["n_upper"], chars), rate(r["n_dup_lines"], max(r["n_lines"], 1)), math.log(chars / words), math.log(words)]

    failed = lambda r: r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
    fit = [i for i in rows if i in good and not failed(rows[i])]
    bands, forest, threshold = quality_rules.fit(counted.join(labels.select("doc_id", "quality"), "doc_id"))

    def quantile(values, q):
        v = sorted(values)
        at = q * (len(v) - 1)
        k = int(at)
        return v[k] + (v[min(k + 1, len(v) - 1)] - v[k]) * (at - k)

    stats = {i: plain_statistics(r) for i, r in rows.items()}
    for c in range(7):
        low, high = (quantile([stats[i][c] for i in fit if good[i]], q) for q in (quality_rules.BAND, 1 - quality_rules.BAND))
        assert bands.low[c] == pytest.approx(low) and bands.high[c] == pytest.approx(high) and bands.unit[c] == pytest.approx(max((high - low) / 4, quality_rules.LEAST_UNIT))

    def score(x):
        e = [max(lo - v, v - hi, 0.0) / u for v, lo, hi, u in zip(x, bands.low, bands.high, bands.unit)]
        e = [v / (1 + v) for v in e]
        total = 0.0
        for column, value, left, length in zip(forest.column, forest.value, forest.left, forest.length):
            at = 0
            while column[at] >= 0:
                at = left[at] + (1 if e[column[at]] >= value[at] else 0)
            total += length[at]
        return 2.0 ** (-total / len(forest.column) / forest.scale)

    scores = {i: score(x) for i, x in stats.items()}
    kept_good = sorted(scores[i] for i in fit if good[i])
    limit = kept_good[min(len(kept_good) - 1, math.ceil(quality_rules.KEEP_GOOD * len(kept_good)) - 1)]
    assert threshold == pytest.approx(limit if any(scores[i] > limit for i in fit if not good[i]) else math.inf)
    assert set(names) <= set(next(iter(rows.values())))
    for r in quality_rules.judge(documents, labels).collect():
        assert r.score == pytest.approx(scores[r.doc_id]) and r.base_failed == failed(rows[r.doc_id])
        assert r.kept == (not r.base_failed and not scores[r.doc_id] > threshold)
