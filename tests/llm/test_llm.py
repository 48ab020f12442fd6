"""The ten operators against brute force, exact round trips and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.llm import decontaminate, license_scan, line_dedup, near_dup, packing, quality_classifier, quality_rules, substring_dedup, toxicity, url_rules
from docmill.llm.sampling import held_out

tok = pytest.importorskip("public_tokenizers")
JSON, RANKS = tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken")

ODD = [None, "", " ", "\n\n", "a", "é ß 日本 語", "x\x00y", "word " * 3000, "don't  it's\t\r\n½ ²", "a1b2 <|endoftext|>"]


def docs_of(spark, texts, **more):
    names = ["doc_id", "text", *more]
    rows = list(zip(range(len(texts)), texts, *more.values(), strict=True))
    kinds = "doc_id long, text string" + "".join(f", {n} {'long' if n == 'n_words' else 'string'}" for n in more)
    return spark.createDataFrame([tuple(r) for r in rows], kinds).select(*names)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [make(rng.randint(1, 120)) for _ in range(60)]
    passage = make(70)
    texts += [make(30) + " " + passage + " " + make(rng.randint(0, 30)) for _ in range(4)]
    texts += [texts[3], texts[3], texts[5] + " tail"]
    for base in texts[:6]:
        words = base.split()
        for _ in range(3):
            copy = words[:]
            if len(copy) > 20:
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    line = make(9)
    texts += [make(8) + f"\n{line} {i}\n" + make(8) for i in range(14)]
    return texts + ODD


# ---------------------------------------------------------------- 1 and 8: classifiers


def test_quality_ranks_held_out_texts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(40, 120))) + "." for _ in range(300)]
    bad = [("BUY " + word().upper() + "!! ") * rng.randint(20, 60) for _ in range(60)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(360)], "doc_id long, quality int")
    out = held_out("doc_id", 5, 0)
    rows = quality_classifier.score(docs, quality_classifier.fit(docs, labels.where(~out))).where(out).select("doc_id", "score").collect()
    assert min(r.score for r in rows if r.doc_id < 300) > max(r.score for r in rows if r.doc_id >= 300)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_without_positives_and_odd_texts(spark):
    docs = docs_of(spark, ODD, score=["x"] * len(ODD))
    assert quality_classifier.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert [r.score for r in quality_classifier.score(docs, None).collect()] == [0.5] * len(ODD)
    x = quality_classifier.statistics(pa.array(ODD))
    assert x.shape == (len(ODD), quality_classifier.N_FEATURES) and np.isfinite(x).all()


def test_toxicity_finds_words_anywhere(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(200)]
    make = lambda bad: " ".join(([rng.choice(vocab) for _ in range(rng.randint(5, 80))] + (["moron"] if bad else [])))
    texts = [make(i % 4 == 0) for i in range(400)]
    docs = docs_of(spark, texts, lang=["en" if i % 2 else "de" for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = held_out("doc_id", 3, 1)
    model = toxicity.fit(docs, labels.where(~out), least_of_lang=10)
    rows = toxicity.score(docs, model).where(out).collect()
    assert sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in rows) >= 0.95 * len(rows)
    assert set(model.by_lang) <= {"en", "de"}
    odd = toxicity.score(docs_of(spark, ODD, score=["x"] * len(ODD)), model).collect()
    assert len(odd) == len(ODD) and len({r.score for r in odd if not (r.text or "").strip()}) == 1


def test_rare_languages_get_their_own_threshold(spark):
    rng = random.Random(12)
    make = lambda bad: " ".join([f"w{rng.randint(0, 200)}" for _ in range(rng.randint(5, 40))] + (["moron"] if bad else []))
    langs = ["es" if i % 5 == 0 else "xx" if i % 399 == 1 else "en" for i in range(2000)]
    docs = docs_of(spark, [make(i % 4 == 0) for i in range(2000)], lang=langs)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample_rows=400, least_of_lang=40)
    assert set(model.by_lang) == {"en", "es"}
    rows = toxicity.score(docs, model).collect()
    assert sum(r.toxic_by_lang == (r.doc_id % 4 == 0) for r in rows) >= 0.95 * len(rows)


def test_statistics_equal_a_plain_count():
    texts = [t or "" for t in ODD] + ["A b b c! a b c\n\na b c\nA b", "{x}=1.5; 20%\n" * 3]
    got = quality_classifier.statistics(pa.array(texts))
    classes = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "!?", "|", ".,;:", "\n", " \t", None, "{}[]()=/\\_@"]
    for row, t in zip(got, texts, strict=True):
        raw = t.encode()
        ws = [w for w in re.split(rb"[\x00\x20\x09-\x0d]+", raw) if w]
        lines = [x for x in re.split(rb"[\x00\n]+", raw) if x]
        n, size = max(1, len(ws)), max(1, len(raw))
        three = {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)}
        wanted = [sum(b >= 0x80 if c is None else b in c.encode() for b in raw) / size for c in classes]
        wanted += [np.log1p(len(ws)) / 10, sum(map(len, ws)) / n / 10, len(set(ws)) / n, sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n]
        assert np.allclose(row[: len(wanted) + 1], [*wanted, len(three) / n])
        wanted = [1 - len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, ws), default=0)) / 5, np.log1p(len(raw)) / 15, np.log1p(len(ws) / max(1, len(lines))) / 8]
        wanted[0] = wanted[0] if lines else 1.0
        assert np.allclose(row[-4:], wanted)


def test_quality_is_the_same_in_another_process(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) + ("!!" * (i % 5)) for i in range(120)]
    docs = docs_of(spark, texts).withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    labels = docs.select("doc_id", (F.length("text") % 2).alias("quality"))
    a, b = (quality_classifier.fit(docs.repartition(n), labels) for n in (1, 5))
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("hidden", "out", "out_bias"))
    assert "hash(" not in __import__("inspect").getsource(quality_classifier.fit).replace("xxhash64(", "")  # Python's hash of text changes with the process


def test_negative_risk_below_zero_is_climbed(monkeypatch):
    """Both terms of R_u(-) - prior R_p(-) have a slope there, as numerical differences have."""
    rng = np.random.default_rng(2)
    pos, unl, seen = rng.normal(2, 1, (300, 4)), rng.normal(-2, 1, (300, 4)), []
    kept = quality_classifier.backward
    monkeypatch.setattr(quality_classifier, "backward", lambda m, x, slope: (seen.append(slope), kept(m, x, slope))[1])
    quality_classifier.fit_pu(pos, unl, 0.9, steps=300)
    climbs = [(p, u) for p, u in zip(seen[::2], seen[1::2], strict=True) if (u < 0).all()]
    assert climbs and all((p > 0).all() for p, _ in climbs)


def test_forward_pass_equals_plain_loops():
    rng = np.random.default_rng(6)
    model = toxicity.train([], np.zeros(0, int), epochs=0)
    for a in (model.words, model.prefixes, *model.filters, model.bias, model.out):
        a += rng.normal(0, 0.3, a.shape).astype(np.float32)
    off = np.array([0, 0, 1, 3, 3, 20, 22])
    ids, pre = rng.integers(0, 50, 22), rng.integers(0, 50, 22)
    got, at = model.pooled(ids, pre, off), 0
    for f in model.filters:
        width, dims, n = f.shape
        for r in range(len(off) - 1):
            own = range(off[r], off[r + 1])
            for k in range(n):
                best = 0.0
                for start in own:
                    if start + width <= off[r + 1]:
                        z = float(model.bias[at + k]) + sum(float(model.words[ids[start + j]][d] + model.prefixes[pre[start + j]][d]) * float(f[j, d, k]) for j in range(width) for d in range(dims))
                        best = max(best, z)
                assert abs(got[r, at + k] - best) < 1e-4
        at += n


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    model = toxicity.train([], np.zeros(0, int), epochs=0)
    for a in (model.words, model.prefixes, *model.filters, model.out):
        a += rng.normal(0, 0.3, a.shape).astype(np.float32)
    ids, pre, off, y = rng.integers(0, 9, 20), rng.integers(0, 9, 20), np.array([0, 1, 8, 8, 20]), np.array([1, 0, 1, 0], np.float32)
    bias = np.zeros(1, np.float32)

    def loss():
        p = toxicity.sigmoid(model.pooled(ids, pre, off).astype(float) @ model.out + bias[0])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 0.5e-4 * sum((f.astype(float) ** 2).sum() for f in model.filters)

    grads = toxicity.gradients(model, bias, ids, pre, off, y)
    for array, grad, at in ((model.words, grads[0], (int(ids[3]), 1)), (model.filters[1], grads[3], (1, 2, 3)), (model.prefixes, grads[1], (int(pre[9]), 0))):
        before, step = array[at], 1e-2
        array[at] = before + step
        up = loss()
        array[at] = before - step
        down = loss()
        array[at] = before
        assert abs((up - down) / (2 * step) - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_one_class_of_labels(spark):
    docs = docs_of(spark, ["a b", "c"])
    model = toxicity.fit(docs, spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int"))
    assert all(abs(r.score - 0.25) < 1e-6 for r in toxicity.score(docs, model).collect())


# ---------------------------------------------------------------- 2: licenses


def test_licenses(spark):
    mit, apache = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["apache-2.0-line"]
    worn = mit.replace("free of charge", "gratis").replace("without limitation ", "")
    texts = ["intro " * 50 + worn + " end", f"{apache}\nx y z\n{apache}", "the license of the work under version", "All rights reserved. All rights reserved.", *ODD]
    rows = {r.doc_id: r.license_matches for r in license_scan.scan_licenses(docs_of(spark, texts, license_words=["x"] * len(texts))).collect()}
    assert [m.template for m in rows[0]] == ["mit"] and 0.9 < rows[0][0].coverage < 1 and rows[0][0].from_word == 50
    assert [m.template for m in rows[1]].count("apache-2.0-line") == 2 and rows[2] == []
    assert len(rows[3]) == 2 and all(rows[i] == [] for i in range(4, len(texts)))


def test_licenses_equal_exhaustive_alignment(spark):
    """Of templates and stretches without repeated words, patience alignment is a longest common subsequence: every stretch is tried."""
    rng = random.Random(13)
    templates = {"a": " ".join(f"a{i}" for i in range(10)), "b": " ".join(f"b{i}" for i in range(6)), "none": "", "c": "c0"}
    texts = []
    for n in range(120):
        own = [f"x{rng.randrange(50)}{n}" for _ in range(rng.randint(0, 25))]
        for name in rng.sample(["a", "b", "c"], rng.randint(0, 3)):
            notice = [w for w in templates[name].split() if rng.random() < 0.85]
            if rng.random() < 0.3:
                rng.shuffle(notice)
            for k in range(rng.randint(0, 3)):
                notice.insert(rng.randint(0, len(notice)), f"y{k}{n}")
            at = rng.randint(0, len(own))
            own[at:at] = notice
        texts.append(" ".join(own))

    def common(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if u == v else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    wanted = set()
    for k, t in enumerate(texts):
        ws = t.split()
        for name, template in templates.items():
            own = template.split()
            reach = -(-3 * len(own) // 2) + 2
            if own and any(common(own, ws[i : i + reach]) >= 0.8 * len(own) - 1e-9 for i in range(len(ws))):
                wanted.add((k, name))
    rows = license_scan.scan_licenses(docs_of(spark, texts), templates).collect()
    assert {(r.doc_id, m.template) for r in rows for m in r.license_matches} == wanted and len(wanted) > 60


def test_licenses_in_groups_and_hot_words(spark, monkeypatch):
    texts = [t for t in license_scan.TEMPLATES.values()] + ["license the version software " * 4000, "", None]
    docs = docs_of(spark, texts, matches=["m"] * len(texts))
    one = license_scan.scan_licenses(docs).collect()
    monkeypatch.setattr(license_scan, "TEMPLATE_WORDS", 40)
    several = license_scan.scan_licenses(docs)
    assert several.columns == ["doc_id", "text", "matches", "license_words", "license_matches"]
    assert {r.doc_id: r.license_matches for r in several.collect()} == {r.doc_id: r.license_matches for r in one}
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_alignment_is_an_increasing_matching():
    rng = random.Random(3)
    for _ in range(200):
        a, b = [rng.randrange(8) for _ in range(rng.randint(0, 12))], [rng.randrange(8) for _ in range(rng.randint(0, 12))]
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert len(license_scan.align([1, 2, 3, 4], [9, 1, 9, 2, 3, 9, 4])) == 4


# ---------------------------------------------------------------- 3: urls


def test_url_rules(spark):
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "", "/void/"), ("allow", "net", "/")], url_rules.RULES_SCHEMA)
    urls = ["HTTP://A.Example.NET/en/x?q", "http://b.net/", "http://b.net", "http://notexample.com/de/", "https://example.com/de/#a", "x.org/fr/", None, "", "ftp://org/fr/y", "a://h/void/", "s://:///de/", "http://q?u=://net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("x"))
    for limit in (url_rules.BROADCAST_BYTES, 0):
        rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules, broadcast_bytes=limit).collect()}
        assert rows[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and rows[1] == ("b.net", "/", "net/", "block")
        assert rows[2] == ("b.net", "", None, "allow") and rows[3][2] is None and rows[4][2:] == ("example.com/de/", "block")
        assert rows[5] == rows[6] == rows[7] == ("", "", None, "allow") and rows[8][2:] == ("org/fr/", "allow") and rows[9][2] is None
        assert rows[11][:2] == ("q", "")
    assert url_rules.judge_urls(pages, rules.limit(0)).where("rule is null").count() == len(urls)
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


# ---------------------------------------------------------------- 4: packing


def test_ids_equal_the_tokenizer(corpus):
    encoder = packing.PieceEncoder(JSON, RANKS)
    texts = [t or "" for t in corpus] + ["  lead", "two  gaps\n\nand\n tail \n", "x" * 5000, "\n \n y", "ʼn Ɏ ɏ ×÷", "a\u00a0b\u3000c"]
    got = [ids for _, ids in encoder.encode(pa.array(texts))]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in encoder.tok.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_keep_their_ids(corpus):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    texts = [t or "" for t in corpus] + ["<|endoftext|>", "a<|endoftext|>b", "x <|endoftext|> <|endoftext|>y", "<|endof", "text|> z", "<|endoftext|"]
    got = [ids for _, ids in packing.PieceEncoder(JSON, RANKS).encode(pa.array(texts))]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert plain.encode("a <|endoftext|>", add_special_tokens=False).ids[-1] == 50256


def test_packing_round_trip(spark, corpus):
    docs = docs_of(spark, corpus + [" ".join(corpus[:60])] * 3)
    rows = packing.pack_documents(docs.repartition(3), JSON, RANKS, window=128, block_docs=40, with_ids=True).collect()
    encoder = packing.PieceEncoder(JSON, RANKS)
    by = collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        by[r.doc_id].append(r)
    for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
        own = sorted(by[i], key=lambda r: r.start)
        ids = encoder.tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 128
    assert 128 * len(sequences) - sum(r.length for r in rows) < 128 * 6  # one short sequence a block at most
    assert packing.pack_documents(docs.limit(0), JSON, RANKS).count() == 0


def test_windows_are_those_of_the_rounded_counts():
    """At the production window: what comes before the greedy residual is what the least squares say, rounded."""
    rng = np.random.default_rng(3)
    lengths = np.exp(rng.normal(5.6, 0.8, 6000)).astype(int) % 1023 + 1
    histogram = np.bincount(lengths, minlength=1025)
    combos = packing.combinations(np.unique(lengths), 1024)
    x = packing.solve_counts(combos, histogram)
    use = np.zeros(1025)
    for side in combos.T:
        np.add.at(use, side, x)
    use[0] = 0
    assert np.linalg.norm(use - histogram) < 0.1 * np.linalg.norm(histogram)
    first = packing.rounded(x, combos, histogram)
    assert (np.abs(first - x) < 1).mean() > 0.99 and first.sum() <= round(x.sum())
    times = packing.repeat_counts(combos, histogram)
    assert (times >= first).all() and times.sum() > 0.85 * lengths.sum() / 1024
    packed = packing.Packer(1024).pack(lengths)
    wanted = collections.Counter(tuple(sorted(s for s in c if s)) for c, n in zip(combos.tolist(), times.tolist(), strict=True) for _ in range(n))
    made = collections.Counter(tuple(sorted(n for _, _, n in seq)) for seq in packed[: times.sum()])
    assert made == wanted and all(first == 0 and n == lengths[i] for seq in packed[: times.sum()] for i, first, n in seq)
    used = collections.Counter()
    for seq in packed:
        assert sum(n for _, _, n in seq) <= 1024
        for i, _, n in seq:
            used[i] += n
    assert used == dict(enumerate(lengths.tolist())) and len(packed) == -(-int(lengths.sum()) // 1024)


def test_combinations_fill_the_window():
    combos = packing.combinations(np.array([1, 3, 4, 6, 9]), 10)
    assert {tuple(c) for c in combos.tolist()} == {(0, 1, 9), (0, 4, 6), (1, 3, 6), (3, 3, 4)}
    x = packing.solve_counts(combos, np.bincount([1] * 5 + [9] * 5, minlength=11).astype(float))
    assert abs(x[[tuple(c) for c in combos.tolist()].index((0, 1, 9))] - 5) < 0.5


# ---------------------------------------------------------------- 5: decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_decontamination(spark, corpus):
    rng = random.Random(4)
    items = [(str(i), " ".join(words(t)[:rng.randint(1, 40)])) for i, t in enumerate(corpus[:60:2])] + [("void", "!!"), ("none", None), (None, corpus[0])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = docs_of(spark, [*corpus, (corpus[2] or "").upper()], n_words=[7] * (len(corpus) + 1))
    wanted = {}
    for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
        ws, hit, found = words(t), set(), set()
        for item, text in items:
            own = words(text)
            n = min(13, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n and item is not None else set()
            for k in range(len(ws) - n + 1) if windows else ():
                if tuple(ws[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item)
        wanted[i] = (len(ws), len(hit), sorted(found))
    for size in (1 << 20, 400):  # in one block, and in several passes
        marked = decontaminate.mark_occurrences(docs, bench, block_bytes=size).select("doc_id", "n_words", decontaminate.n_hit().alias("h"), "items").collect()
        assert {r.doc_id: (r.n_words, r.h, r["items"]) for r in marked} == wanted
    assert decontaminate.mark_occurrences(docs, bench.limit(0)).where(decontaminate.n_hit() > 0).count() == 0
    assert decontaminate.mark_occurrences(docs.limit(0), bench).count() == 0


# ---------------------------------------------------------------- 6: near duplicates


def test_signature_is_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        keys = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
        row = np.concatenate((np.zeros((a > 0).sum()), np.ones((b > 0).sum()))).astype(int)
        s = near_dup.bag_min_hash(row, np.concatenate((keys[a > 0], keys[b > 0])), np.concatenate((a[a > 0], b[b > 0])), 2, 512)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def bag_of(text):
    """Five-word runs and their counts, from the definition."""
    ws = words(text)
    return collections.Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else collections.Counter()


def classes_of(texts):
    """Least index of each text's class: identical, or weighted Jaccard similarity of 0.8 or more, by union."""
    bags, parent = [bag_of(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if texts[i] == texts[j] or (both and both >= 0.8 * sum((bags[i] | bags[j]).values())):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_duplicates(spark, corpus):
    texts = [t or "" for t in corpus]
    wanted = classes_of(texts)
    docs = docs_of(spark, corpus)
    _, rows = near_dup.classes(docs.repartition(3))
    assert {r.doc_id: r.class_id for r in rows.collect()} == dict(enumerate(wanted))
    kept = near_dup.keep_one(docs.union(docs).withColumn("extra", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted)) and "extra" in kept.columns
    assert near_dup.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_large_buckets_lose_no_link(spark, block):
    """A large group of near copies and one of texts that share most of a passage, whatever the size of a block."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for edits, base in ((2, 60), (1, 60), (6, 90)):
        own = [word() for _ in range(base)]
        for _ in range(40):
            copy = own[:]
            for k in rng.sample(range(base), rng.randint(0, edits)):
                copy[k] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    _, rows = near_dup.classes(docs_of(spark, texts).repartition(5), block=block)
    assert {r.doc_id: r.class_id for r in rows.collect()} == dict(enumerate(classes_of(texts)))


def test_near_duplicates_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    wanted = classes_of([t for _, t in docs])
    _, rows = near_dup.classes(spark.read.parquet(f"{folder}/documents.parquet"))
    assert {r.doc_id: r.class_id for r in rows.collect()} == {docs[i][0]: docs[c][0] for i, c in enumerate(wanted)}


def test_which_copy_stays(spark):
    rows = [(2, "a b", "y", 1), (1, "a b", "z", 2), (1, "a b", "x", 3), (None, "c", "k", 4), (None, None, "n", 5), (7, "", "m", 6)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, key string, _first int"))
    assert kept.columns == ["doc_id", "text", "key", "_first"]
    assert sorted(kept.collect(), key=lambda r: r.key) == [(None, "c", "k", 4), (7, "", "m", 6), (1, "a b", "x", 3)]


# ---------------------------------------------------------------- 7: rules


def test_ledger(spark):
    texts = ["kata " * 60, "a b c " * 30, "x | y | z " * 20, *ODD]
    entries = quality_rules.ledger(docs_of(spark, texts, n_words=[1] * len(texts)))
    for r in entries.collect():
        t = texts[r.doc_id] or ""
        ws = re.findall("[^\x20\x09-\x0d]+", t)
        tri = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
        covered = {k + j for k in range(len(ws) - 2) if tri[tuple(ws[k : k + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(ws), len(covered), sum(map(len, ws)))
    v1, v2 = quality_rules.apply_policy(entries, "v1"), quality_rules.apply_policy(entries, "v2")
    assert v2.where("kept").count() <= v1.where("kept").count()
    table = {r.rule: r for r in quality_rules.ablation(entries, "v1").collect()}
    bits = [r.fail_bits & quality_rules.mask_of("v1") for r in entries.collect()]
    assert table["few_words"].n_failing == sum(b & 1 for b in bits) and table["few_words"].n_only == sum(b == 1 for b in bits)
    assert quality_rules.ablation(entries.limit(0), "v1").first().n_docs == 0


# ---------------------------------------------------------------- 9: substrings


def test_substrings(spark, corpus):
    texts = [t or "" for t in corpus] + ["ab" * 300, "z" * 250]
    raw = [t.encode() for t in texts]
    for window, gram, most in ((60, 20, 8192), (60, 20, 2), (200, 40, 8192)):
        count = collections.Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
        wanted = {}
        for b in raw:
            gone = np.zeros(len(b) + 1, int)
            for i in range(len(b) - window + 1):
                if count[b[i : i + window]] > 1:
                    gone[i] += 1
                    gone[i + window] -= 1
            cut = np.cumsum(gone)[: len(b)] > 0
            wanted[hashlib.sha256(b).digest()] = (len(b), bytes(x for x, c in zip(b, cut, strict=True) if not c), int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum()))
        rows = substring_dedup.repeated_substrings(docs_of(spark, texts), window=window, gram=gram, group_runs=most).collect()
        assert {bytes(r.text_key): (r.n_bytes, bytes(r.kept), len(r.span_from)) for r in rows} == wanted
    assert substring_dedup.repeated_substrings(docs_of(spark, texts).limit(0)).count() == 0


def test_segments_own_each_window_once():
    offs = np.array([0, 5, 5 + 3 * substring_dedup.SEGMENT])
    rows, bases, cuts = substring_dedup.segments(offs, 200)
    starts = [int(b + k) for r, b, (x, y) in zip(rows, bases, cuts, strict=True) if r == 1 for k in (0, y - x - 200)]
    assert starts[0] == 0 and starts[-1] == 3 * substring_dedup.SEGMENT - 200
    assert all(b - a == 1 for a, b in zip(starts[1::2], starts[2::2], strict=False))


# ---------------------------------------------------------------- 10: lines


def test_lines(spark, corpus):
    texts = [t for t in corpus if t is not None]
    mask = lambda t: "<*>" if re.search("[0-9]", t) else t
    split = lambda s: [x for x in re.split(r"[\x20\x09-\x0D]+", s) if x]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    leaves, lines = collections.defaultdict(set), []
    for t in first:
        for n, line in enumerate(t.split("\n")):
            if ts := split(line):
                leaf = (len(ts), *map(mask, ts[:4]))
                leaves[leaf].add(t)
                lines.append((leaf, t, n, tuple(map(mask, ts))))
    lines = [x for x in lines if len(leaves[x[0]]) >= 10]
    support = collections.Counter((leaf, p, x) for leaf, _, _, ts in lines for p, x in enumerate(ts))
    marked = [(leaf, tuple(x if x != "<*>" and support[leaf, p, x] >= 10 else None for p, x in enumerate(ts)), t, n) for leaf, t, n, ts in lines]
    where = collections.defaultdict(set)
    for leaf, template, t, _ in marked:
        where[leaf, template].add(t)
    lost = collections.Counter()
    for leaf, template, t, _ in marked:
        own = where[leaf, template]
        if len(own) >= 10 and sum(x is not None for x in template) * 2 >= len(template) and first[t] != min(first[x] for x in own):
            lost[t] += 1
    docs = docs_of(spark, texts)
    rows = line_dedup.drop_recurring_lines(docs.repartition(3), keep_first=True).collect()
    assert {r.doc_id: r.n_dropped for r in rows} == {i: lost[t] for i, t in enumerate(texts)} and sum(lost.values()) == 13
    assert {r.doc_id: r.text for r in rows if not r.n_dropped} == {i: t for i, t in enumerate(texts) if not lost[t]}
    odd = line_dedup.drop_recurring_lines(docs_of(spark, ODD, n_words=[3] * len(ODD))).collect()
    assert {r.doc_id: (r.text, r.n_words) for r in odd} == {i: (t, 3) for i, t in enumerate(ODD)}
    assert line_dedup.drop_recurring_lines(docs.limit(0)).count() == 0


def test_long_lines_recur_from_the_second_text(spark):
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, short, twice = make(52), make(19), make(20)
    texts = [f"{make(6)}\n{passage}\n{make(7)}" for _ in range(8)] + [f"{short}\n{make(5)}" for _ in range(9)]
    texts += [f"{make(4)}\n{twice}", f"{twice} end\n{make(4)}", f"{twice}\n{make(4)}", f"{make(30)}\n{make(3)}", f"{make(30)}\n{make(3)}"]
    texts += [texts[-1]] * 3  # copies alone are not a second text
    rows = line_dedup.drop_recurring_lines(docs_of(spark, texts).repartition(3), keep_first=True).collect()
    lost = {r.doc_id: r.n_dropped for r in rows if r.n_dropped}
    assert lost == {**dict.fromkeys(range(1, 8), 1), 19: 1}
    assert {r.doc_id: r.text for r in rows} == {i: t.replace(passage + "\n", "") if 1 <= i < 8 else t.replace(twice + "\n", "") if i == 19 else t for i, t in enumerate(texts)}


def test_copies_of_the_keeper_lose_its_lines(spark):
    passage = " ".join(f"w{chr(97 + i)}" for i in range(26))
    head, other = f"head\n{passage}", f"other\n{passage}\nend"
    texts = [head, other, head, other, head, "alone\nhere"]
    rows = line_dedup.drop_recurring_lines(docs_of(spark, texts).repartition(3), keep_first=True).collect()
    assert {r.doc_id: (r.text, r.n_dropped) for r in rows} == {0: (head, 0), 1: ("other\nend", 1), 2: ("head", 1), 3: ("other\nend", 1), 4: ("head", 1), 5: (texts[5], 0)}
    bare = line_dedup.drop_recurring_lines(docs_of(spark, texts)).collect()
    assert {r.doc_id: r.n_dropped for r in bare} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    nulls = docs_of(spark, texts[:3]).withColumn("doc_id", F.expr("nullif(doc_id, 2)"))
    assert sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.drop_recurring_lines(nulls, keep_first=True).collect()) == [("0", 0), ("1", 1), ("None", 1)]
    alike = line_dedup.drop_recurring_lines(docs_of(spark, texts), keep_first=True, keep_copies=True).collect()
    assert {r.doc_id: r.n_dropped for r in alike} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0}


def test_identical_lines_recur_whatever_their_digits(spark):
    row = "030 1234 55 2024-05-01 call"
    texts = [f"top {chr(97 + i)} x\n{row}\nmore {chr(97 + i)}" for i in range(10)] + ["lone\n77 88 99 11"] * 12
    rows = line_dedup.drop_recurring_lines(docs_of(spark, texts).repartition(3), keep_first=True).collect()
    assert {r.doc_id: r.n_dropped for r in rows} == {i: int(1 <= i < 10) for i in range(len(texts))}
    assert all(r.n_dropped == 0 for r in line_dedup.drop_recurring_lines(docs_of(spark, texts[:9] + texts[10:])).collect())


# ---------------------------------------------------------------- edge cases of all


def runs(spark):
    """name -> docs -> result, with small models where there are any."""
    words_ = [f"w{i}" for i in range(30)]
    rng = random.Random(3)
    base = docs_of(spark, [" ".join(rng.choice(words_) for _ in range(20)) + (" moron" if i % 4 == 0 else "") for i in range(80)], lang=["en"] * 80)
    toxic = toxicity.fit(base, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int"))
    quality = quality_classifier.fit(base, spark.createDataFrame([(i, int(i % 2)) for i in range(80)], "doc_id long, quality int"))
    bench = spark.createDataFrame([("a", "some words that are nowhere")], "item_id string, text string")
    return {
        1: lambda d: quality_classifier.score(d, quality),
        2: lambda d: license_scan.scan_licenses(d),
        4: lambda d: packing.pack_documents(d, JSON, RANKS),
        5: lambda d: decontaminate.mark_occurrences(d, bench),
        6: lambda d: near_dup.classes(d)[1],
        7: lambda d: quality_rules.apply_policy(quality_rules.ledger(d), "v2"),
        8: lambda d: toxicity.score(d, toxic),
        9: lambda d: substring_dedup.repeated_substrings(d),
        10: lambda d: line_dedup.drop_recurring_lines(d),
    }


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 8, 9, 10])
def test_null_ids_long_texts_and_empty_tables(spark, n):
    run = runs(spark)[n]
    long = " ".join(f"word{i % 977} x{i}" for i in range(120_000)) + "\nend"  # above one slice
    assert len(long) > 1 << 20
    kind = "doc_id long, text string, lang string"
    rows = [(None, "a b c", "en"), (None, None, None), (None, "a b c", "en"), (1, long, "de"), (2, "", "fr"), (3, None, "en")]
    out = run(spark.createDataFrame(rows, kind)).collect()
    if n == 9:
        assert {r.n_bytes for r in out} == {5, 0, len(long)}
    elif n == 4:
        assert collections.Counter(r.doc_id for r in out if r.start == 0) == {None: 3, 1: 1, 2: 1, 3: 1}
        assert sum(r.length for r in out if r.doc_id == 1) == next(r.doc_tokens for r in out if r.doc_id == 1) > 120_000
    else:
        assert collections.Counter(r.doc_id for r in out) == {None: 3, 1: 1, 2: 1, 3: 1}
    if n == 6:
        assert {r.class_id for r in out if r.doc_id in (2, 3)} == {2}
    assert run(spark.createDataFrame([], kind)).count() == 0


def test_no_labels_and_no_documents(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit(none, labels) is None
    model = toxicity.fit(none, labels)
    assert toxicity.score(none, model).count() == 0 and toxicity.score(docs_of(spark, ["a"]), model).count() == 1


def test_substrings_of_long_texts_at_production_sizes(spark):
    """A text above one slice, its near copy, a hot passage in many texts: against a plain set of windows."""
    rng = random.Random(11)
    noise = lambda n: bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(n))
    long, hot = noise(1_200_000), noise(420)
    texts = [long, long[:600_000] + b"CHANGED" + long[600_000:], *[noise(rng.randint(0, 300)) + hot + noise(rng.randint(0, 300)) for _ in range(60)], b"q" * 5000, noise(900)]
    seen, again = set(), set()
    for b in texts:
        for i in range(len(b) - 199):
            h = hash(b[i : i + 200])
            (again if h in seen else seen).add(h)
    wanted = {}
    for b in texts:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if hash(b[i : i + 200]) in again:
                gone[i] += 1
                gone[i + 200] -= 1
        cut = np.cumsum(gone)[: len(b)] > 0
        wanted[hashlib.sha256(b).digest()] = int(cut.sum())
    for most in (8192, 8):
        rows = substring_dedup.repeated_substrings(docs_of(spark, [b.decode() for b in texts]).repartition(4), group_runs=most).collect()
        assert {bytes(r.text_key): r.n_bytes - len(r.kept) for r in rows} == wanted


def test_suffixes_with_lying_hashes(monkeypatch):
    """Where every hash is the same the block is placed by its bytes, and the repeats are still right."""
    monkeypatch.setattr(substring_dedup, "range_hash", lambda sums, a, b: np.zeros(len(a), np.uint64))
    data = np.frombuffer(b"xxGGyyxxGGyyzzGGyyxxGGww", np.uint8)
    offs, group = np.array([0, 6, 12, 18, 24]), np.zeros(4, np.int64)
    rel, low, high = np.full(4, 2), np.zeros(4, np.int64), np.full(4, 2)
    least, most = substring_dedup.repeats_in(data, offs, group, rel, low, high, 4)
    assert least.tolist() == [0, 0, 0, 2] and most.tolist() == [2, 2, 0, 2]
