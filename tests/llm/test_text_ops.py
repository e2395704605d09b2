"""Operators on single texts against brute force, the library and exact round trips."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from widecairn.llm import fingerprint, pii, quality_fm, sentencepiece_bpe, toxicity
from widecairn.llm._words import MinHasher, WordHashes, band_keys, shingle_set
from widecairn.llm.queries import tokenizer_bytes

SF = "/root/testdata/sf0.001"
TRICKY = [(1, None), (2, ""), (3, " "), (4, "a  b\n\n c▁d"), (5, "x" * 50_000), (6, "mail a.b@c.example.org now"), (6, "mail a.b@c.example.org now"), (None, "no id"), (8, "\x00�\U0001f600 é ñ"), (9, "word " * 20_000)]


@pytest.fixture(scope="module")
def tricky(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' outputs."""
    return spark.createDataFrame([(i, t, 0.5, "x", 1) for i, t in TRICKY], "doc_id long, text string, score double, ids string, n_tokens int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# -- SentencePiece ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=tokenizer_bytes())


@pytest.fixture(scope="module")
def encoder():
    return sentencepiece_bpe.Encoder(tokenizer_bytes())


def test_encoding_equals_the_library(library, encoder):
    r = random.Random(1)
    some = [" ", "  ", "▁", "a", "the", "ing", "\n", "\r", ";", ")", "\t", "é", "日本", "\U0001f600", "�", "\x00", "<s>", "<0x0A>", "123", "....", "});", "    ", "é", " ", "　", "²", "”", "—"]
    for _ in range(4000):
        t = "".join(r.choice(some) if r.random() < 0.6 else r.choice(encoder.v.pieces[260:]).replace("▁", " ") for _ in range(r.randint(0, 20)))
        ids = encoder.encode(t)
        assert ids == library.encode(t), repr(t)
        assert encoder.decoder.decode(ids) == library.decode(ids), repr(t)


def test_runs_of_spaces(library, encoder):
    for n in [*range(70), 255, 1000, 4095]:
        for end in ("", "a", "\n"):
            assert encoder.encode(" " * n + end) == library.encode(" " * n + end), (n, end)


def test_long_parts_and_invalid_bytes(library, encoder):
    t = "".join(random.Random(2).choice("abcdefghij") for _ in range(50_000))
    assert encoder.encode(t) == library.encode(t)
    r = random.Random(3)
    for _ in range(500):
        ids = [r.randrange(3, 259) if r.random() < 0.7 else r.randrange(3, 32_000) for _ in range(r.randint(0, 12))]
        assert encoder.decoder.decode(ids) == library.decode(ids)


def test_encode_decode_rows(spark, tricky, docs, library):
    for df in (tricky, docs, docs.limit(0)):
        got = sorted((tuple(r) for r in sentencepiece_bpe.encode_decode(df, tokenizer_bytes()).collect()), key=repr)
        want = []
        for i, t in df.select("doc_id", "text").collect():
            ids = library.encode(t or "")
            text = library.decode(ids) if ids else ""
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
        assert got == sorted(want, key=repr)


# -- fingerprints -------------------------------------------------------------------------


def true_jaccard(a, b, n=5):
    x, y = ({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if (w := t.lower().split()) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def test_fingerprint_query(spark, tricky, docs):
    nulls = spark.createDataFrame([(None, f"text {k} of no one {k * k}") for k in range(100)] + [(k, "x") for k in range(100)], "doc_id long, text string")
    for df in (docs, tricky, docs.limit(1), docs.limit(0), nulls):
        hashed = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, hashed[r.text] if r.doc_id is None else r.doc_id, r.text or ""))
        want, near = [], {}
        for k, r in enumerate(rows):
            a, b = r.text or "", rows[(k + 1) % len(rows)].text or ""
            edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
            want.append((r.doc_id, len(a), hashlib.sha256(edited.encode()).hexdigest()))
            near[r.doc_id] = (true_jaccard(a, edited), true_jaccard(a, b), max(len(a.split()), 1))
        got = fingerprint.edited_pairs(df).collect()
        assert sorted([tuple(r)[:3] for r in got], key=repr) == sorted(want, key=repr)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        if len(got) > 100 and df is docs:
            # Of n shingles about n / ONE_IN are kept: four standard deviations.
            for r in got:
                e, x, n = near[r.doc_id]
                if n > 100:
                    assert abs(r.near_edited - e) < 2 / (n / fingerprint.ONE_IN) ** 0.5 and abs(r.near_next - x) < 2 / (n / fingerprint.ONE_IN) ** 0.5
            off = [r.near_edited - near[r.doc_id][0] for r in got if near[r.doc_id][2] > 100]
            assert abs(np.mean(off)) < 0.02 and np.mean(np.abs(off)) < 0.08
    with pytest.raises(TypeError):
        fingerprint.edited_pairs(spark.createDataFrame([("a", "t")], "doc_id string, text string"))


def test_sketches():
    cache, r = WordHashes(), random.Random(5)
    words = [str(r.random()) for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:6000])
    x, y = (fingerprint.sketch(shingle_set(t, cache)) for t in (a, b))
    assert abs(fingerprint.jaccard(x, y) - 1 / 3) < 0.06
    part = fingerprint.sketch(shingle_set(" ".join(words[100:400]), cache))
    assert fingerprint.containment(part, x) == 1.0 and fingerprint.containment(x, part) < 0.15
    assert fingerprint.merge(x, y).tolist() == np.union1d(x, y).tolist()
    assert fingerprint.from_string(fingerprint.to_string(x)).tolist() == x.tolist()
    empty = fingerprint.sketch(shingle_set("", cache))
    assert fingerprint.jaccard(empty, empty) == 1 and fingerprint.jaccard(empty, x) == 0 and fingerprint.to_string(empty) == ""


# -- personal data ------------------------------------------------------------------------


def spans_by_rule(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(pii.EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(pii.IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    for rule, kind, lo, hi in ((pii.CARD, 2, 12, 19), (pii.PHONE, 3, 9, 15)):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m.group())
            if lo <= len(d) <= hi and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans(docs):
    r = random.Random(3)
    for _ in range(8000):
        t = "".join(r.choice(["1", "25", "255", "256", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "4493951748931821", "x@y.z", "é", "\n", "1.2.3.4", "00"]) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(t) == spans_by_rule(t), repr(t)
    for r in docs.collect():
        assert pii.base_spans(r.text) == spans_by_rule(r.text)


def test_long_digits_are_fast():
    assert pii.base_spans("7" * 200_000 + "." * 1000) == []


def test_added_spans():
    trees, thresholds = pii.fitted()
    found, y = pii.examples(2000, 77)
    p = trees.predict(np.array([pii.features(*e) for e in found]))
    hit = p >= np.array([thresholds[e[1][1]] for e in found])
    assert y[hit].mean() > 0.95 and hit[y > 0].mean() > 0.85
    text = "call me: (415) 555-0199 or write joe (at) site (dot) org"
    spans = pii.added_spans(text, pii.base_spans(text), trees, thresholds)
    assert pii.redact(text, spans) == "call me: <PHONE> or write <EMAIL>"


def test_added_spans_in_real_texts():
    """Of base spans rewritten to forms that no base rule finds, most are found; in the texts as they are nothing is added to numbers that are no cards."""
    import duckdb

    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    trees, thresholds = pii.fitted()
    r, found, total, wrong = random.Random(4), Counter(), Counter(), 0
    for text in texts:
        base = pii.base_spans(text)
        wrong += len(pii.added_spans(text, base, trees, thresholds))
        for a, kind, b in base:
            old = text[a:b]
            if kind == 0:
                new = old.replace("@", r.choice((" (at) ", "[at]", " at "))).replace(".com", r.choice((" (dot) com", " dot com", ".com")))
            elif kind == 2:
                new = ".".join(old[k : k + 4] for k in range(0, 16, 4))
            elif kind == 3:
                d = re.sub("[^0-9]", "", old)[-10:]
                new = r.choice((f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}"))
            else:
                continue
            changed = text[:a] + new + text[b:]
            spans = pii.added_spans(changed, pii.base_spans(changed), trees, thresholds)
            total[kind] += 1
            found[kind] += any(k == kind and s <= a + 1 and e >= a + len(new) - 1 for s, k, e in spans)
    assert wrong <= 2 and all(found[k] >= 0.8 * total[k] > 0 for k in (0, 2, 3)), (wrong, found, total)


def test_numbers_side_by_side():
    trees, thresholds = pii.fitted()
    for text, want in (
        ("jane (at) example.com", ["jane (at) example.com"]),
        ("call 212-555-0100 / 212-555-0199", ["212-555-0100", "212-555-0199"]),
        ("ring 2021 212-555-0100", ["212-555-0100"]),
        ("call 2125550100 now", ["2125550100"]),
        ("host 2001:db8::ff00:42:8329 is", ["2001:db8::ff00:42:8329"]),
    ):
        assert [text[a:b] for a, _, b in sorted(pii.added_spans(text, [], trees, thresholds))] == want


def test_number_spans_are_all_runs_of_groups():
    r = random.Random(2)
    for _ in range(2000):
        t = "".join(r.choice(["12", "345", "6789", "1", " ", "-", ".", "(", ")", " a ", "    "]) for _ in range(r.randint(1, 14)))
        groups = [m.span() for m in re.finditer("[0-9]+", t)]
        want = set()
        for i in range(len(groups)):
            for j in range(i, len(groups)):
                between = [t[x[1] : y[0]] for x, y in zip(groups[i:j], groups[i + 1 : j + 1])]
                n = sum(b - a for a, b in groups[i : j + 1])
                if all(re.fullmatch(r"[ ().\-/]{1,3}", x) for x in between):
                    start, end = groups[i][0], groups[j][1]
                    want |= {(start - (t[start - 1 : start] == "("), 3, end)} if 7 <= n <= 15 else set()
                    want |= {(start, 2, end)} if 12 <= n <= 19 else set()
        assert set(pii.number_spans(t)) == want, repr(t)


def test_spelled_at_equals_a_rule():
    r = random.Random(8)
    rule = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\}|(?<=\s)at(?=\s))\s?", re.I)
    for _ in range(5000):
        t = "".join(r.choice(["at", "AT", "aT", " ", "  ", "\n", "(", ")", "[at]", "{at}", "(at)", "x", "jo"]) for _ in range(r.randint(0, 9)))
        got = list(pii.spelled_at(t))
        for m in rule.finditer(t):
            assert m.span() in got or any(a < m.end() and m.start() < b for a, b in got), repr(t)
        assert all(re.fullmatch(rule, t[a:b]) or re.fullmatch(r"\s[aA][tT]\s", t[a:b]) for a, b in got), repr(t)


def test_free_intervals():
    r = random.Random(6)
    for _ in range(300):
        some = [(a, a + r.randint(1, 9)) for a in (r.randrange(100) for _ in range(6))]
        t = pii.Taken(some)
        for _ in range(30):
            a = r.randrange(110)
            b = a + r.randint(1, 9)
            free = all(b <= x or a >= y for x, y in some)
            assert t.free(a, b) == free
            if free:
                t.add(a, b)
                some.append((a, b))


def test_many_numbers_take_linear_time():
    import time

    trees, thresholds = pii.fitted()
    took = []
    for n in (500, 4000):
        text = " ".join(f"212-555-{k % 10000:04d}" for k in range(n))
        began = time.perf_counter()
        assert len(pii.added_spans(text, [], trees, thresholds)) > 0.9 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]


def test_find_pii(tricky, docs):
    for df in (tricky, docs, docs.limit(0)):
        got = pii.find_pii(df).collect()
        assert len(got) == df.count()
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in got:
            base = spans_by_rule(texts[r.doc_id])
            line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
            assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
            assert set(line.split(",")) - {""} <= set(r.spans.split(","))
            assert not base or r.redacted != texts[r.doc_id]
    changed = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert len(changed) == docs.count() and all(len(r.text) == r.n_chars and not spans_by_rule(r.text) for r in changed.values())


# -- classifiers ----------------------------------------------------------------------------


def area(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    n = y.sum()
    return (rank[y > 0].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_toxicity(spark, tricky):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    chain = toxicity.fit_on(docs, labels.where(~held))
    got = toxicity.score(docs, chain).join(labels.drop("quality").withColumnRenamed("toxic", "mark"), "doc_id").where(held).toPandas()
    y = got["mark"].to_numpy()
    assert area(y, got.p_toxic.to_numpy()) > 0.9
    assert got.toxic[y == 0].mean() < 0.01 and got.toxic[y > 0].mean() >= 0.8
    odd = toxicity.score(tricky, chain).collect()
    assert len(odd) == tricky.count() and all(0 <= r.p_toxic <= 1 for r in odd)
    assert toxicity.accepted(tricky, chain).columns == tricky.columns
    none = toxicity.fit_on(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("toxic or p_toxic > 0").count() == 0


def test_chain_equals_plain_arithmetic(spark, docs, labels):
    """Every probability of every document by dictionaries: each link adds up its words' weights and the earlier links' probabilities."""
    import math

    chain = toxicity.fit_on(docs, labels)
    n = len(chain.vocabulary)
    for r in toxicity.score(docs, chain).collect():
        words = set(re.findall(r"[^\W\d_]+", docs_text(docs)[r.doc_id].lower()))
        has = words | {w[:k] for w in words for k in (4, 5, 6, 7) if len(w) > k}
        p = []
        for w in chain.weights:
            z = w[-1] + sum(w[k] for k, v in enumerate(chain.vocabulary) if v in has) + sum(q * w[n + k] for k, q in enumerate(p))
            p.append(1 / (1 + math.exp(-min(30, max(-30, z)))))
        assert [r[f"p_{c}"] for c in toxicity.CATEGORIES] == pytest.approx(p, abs=1e-9)
        assert r.toxic == (p[-1] >= chain.threshold)


_texts: dict = {}


def docs_text(docs):
    if not _texts:
        _texts.update({r.doc_id: r.text for r in docs.collect()})
    return _texts


def test_out_of_fold_probabilities():
    """A row's probability comes from a fit without its fold: its own mark can't change it."""
    rng = np.random.default_rng(3)
    x, fold = (rng.random((200, 6)) < 0.4).astype(np.float32), np.arange(200) % toxicity.FOLDS
    y = ((x[:, 0] + rng.random(200)) > 0.9).astype(float)
    w, out = toxicity.fit_link(x, y, fold)
    other = y.copy()
    other[fold == 2] = 1 - other[fold == 2]
    w2, out2 = toxicity.fit_link(x, other, fold)
    assert np.allclose(out[fold == 2], out2[fold == 2], atol=1e-5) and not np.allclose(out[fold != 2], out2[fold != 2], atol=1e-3)
    assert not np.allclose(w, w2, atol=1e-3)


def test_kinds_and_later_links():
    """Three sorts of toxic texts become three kinds, and the last link uses what the first say."""
    r = random.Random(1)
    sorts, texts, y, own = [["red", "rose"], ["sun", "sand"], ["ice", "iron"]], [], [], []
    for k in range(900):
        bad = k % 3 == 0
        sort = (k // 3) % 3
        texts.append("\n".join({f"w{r.randrange(300)}x" for _ in range(20)} | (set(sorts[sort]) if bad else set())))
        y.append(float(bad))
        own.append(sort if bad else -1)
    seen = toxicity.Texts(texts)
    words = toxicity.select_words(seen, np.array(y))
    x = np.array([[w in s for w in words] for s in seen], dtype=np.float32)
    kind = toxicity.kinds_of(x, np.array(y))
    assert len(set(zip(own, kind.tolist()))) == 4 and set(kind.tolist()) == {-1, 0, 1, 2}
    chain = toxicity.fit_chain(seen, np.array(y), list(range(900)))
    assert (chain.weights[-1][len(chain.vocabulary) : -1] > 0).all()
    assert toxicity.Scorer(chain)("Red rose")[-1] > 0.5 > toxicity.Scorer(chain)("w1x w2x w3x")[-1]


def test_quality(spark, tricky):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machine = quality_fm.fit_on(docs, labels)
    got = quality_fm.score(docs, machine).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert 0.15 < len(held) / len(got) < 0.35
    assert area(held.quality.to_numpy(), held.score.to_numpy()) > 0.95
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    odd = quality_fm.score(tricky, machine).collect()
    assert len(odd) == tricky.count() and all(0 <= r.score <= 1 for r in odd)
    # What held-out rows are marked as changes no score.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_fm.score(docs, quality_fm.fit_on(docs, turned)).collect()}
    assert all(again[r.doc_id] == r.score for r in got.itertuples())
    none = quality_fm.fit_on(docs, labels.limit(0))
    assert quality_fm.score(docs, none).where("score <> 0.5").count() == 0


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine([], 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    i, x = np.array([1, 4, 7, 9]), rng.normal(size=4)
    want = 0.3 + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(4) for b in range(a + 1, 4))
    assert abs(m.raw(i, x)[0] - want) < 1e-9


# -- hashes ---------------------------------------------------------------------------------


def test_minhash_estimates_jaccard():
    cache, r = WordHashes(), random.Random(9)
    words = [str(r.random()) for _ in range(3000)]
    a, b = shingle_set(" ".join(words[:2000]), cache), shingle_set(" ".join(words[1000:]), cache)
    h = MinHasher(2000)
    assert abs((h(a) == h(b)).mean() - 1 / 3) < 0.05
    starts = np.array([0, 3, 4, 900, 1500])
    want = [h(x) for x in np.split(a, starts[1:])]
    assert all((h.segments(a, starts, n) == want).all() for n in (64, 100, 1000, 65536))
    assert len(shingle_set("one two", cache)) == 1 and len(shingle_set(" ", cache)) == 0
    assert band_keys(h(a), 5).shape == (1, 400)
