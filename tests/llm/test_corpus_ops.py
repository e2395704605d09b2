"""Operators over whole tables against brute force."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from widecairn.llm import hnsw, jaccard_join, lm_score, mixing, substring_dedup
from widecairn.llm._bayes import least_matches, posterior_reaches
from widecairn.llm._components import connected_components
from widecairn.llm._linkage import shared_counts
from widecairn.llm._words import MinHasher, WordHashes, band_keys, shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- mixing ---------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [7, 1, 1, 1], [1, 2, 3, 4, 5, 6], [97, 2, 1], [333, 333, 334]])
def test_one_period_is_pfair(weights):
    total, had = sum(weights), [0] * len(weights)
    for t, s in enumerate(mixing.period(weights), 1):
        had[s] += 1
        assert all(abs(Fraction(t * a, total) - h) < 1 for a, h in zip(weights, had)), t
    assert had == weights


def simulated(weights, blocks):
    """Slot by slot: the released block with the earliest deadline; a source whose blocks are used up leaves its slots empty."""
    had, out, total, t = [0] * len(weights), {}, sum(weights), 0
    while any(h < n for h, n in zip(had, blocks)):
        ready = [s for s in range(len(weights)) if had[s] * total // weights[s] <= t]
        s = min(ready, key=lambda s: (-(-(had[s] + 1) * total // weights[s]), s))
        if had[s] < blocks[s]:
            out[t] = (s, had[s])
        had[s] += 1
        t += 1
    return out


def test_mix_equals_simulation(spark):
    r = random.Random(2)
    sizes = {"a": 230, "b": 41, None: 77, "c": 3}
    rows = [(k * 10 + len(rows_), s, "clash") for rows_ in [[]] for s, n in sizes.items() for k in (r.randrange(10**6) for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string, _mix string")
    weights = {"a": 10, "b": 6, None: 4, "c": 2}
    got = mixing.mix(df, weights, block_rows=4)
    assert got.columns == ["doc_id", "source", "_mix"]
    got = got.select("doc_id", "source", "_mix.*").toPandas()
    names = sorted(sizes, key=lambda s: (s is not None, s or ""))
    want = simulated([weights[s] // 2 for s in names], [-(-sizes[s] // 4) for s in names])
    blocks = got.groupby("slot").agg(source=("source", "first"), block=("block", "first"), n=("source", lambda x: len(set(map(str, x)))), release=("release", "first"), deadline=("deadline", "first"))
    assert {t: (names.index(None if s != s or s is None else s), b) for t, s, b in zip(blocks.index, blocks.source, blocks.block)} == want
    assert (blocks.n == 1).all() and (blocks.release <= blocks.index).all() and (blocks.index < blocks.deadline).all()
    assert got.position.is_unique and len(got) == len(rows)
    assert Counter(map(str, got.source.where(got.source.notna(), None))) == Counter(str(s) for s, n in sizes.items() for _ in range(n))


def test_mix_of_many_sources(spark):
    """10,000 sources, and weights with a sum far beyond a period."""
    import time

    df = spark.range(30_000).selectExpr("id AS doc_id", "concat('s', cast(floor(sqrt(id * 3333)) AS string)) AS source")
    n = df.select("source").distinct().count()
    began = time.perf_counter()
    got = mixing.mix(df, keep=False).select("source", "_mix.*").toPandas()
    assert n > 8_000 and time.perf_counter() - began < 60
    assert len(got) == 30_000 and got.position.is_unique and (got.release <= got.slot).all() and (got.slot < got.deadline).all()
    few = spark.range(300).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS source")
    got = mixing.mix(few, {"a": 10**12, "b": 2 * 10**12 + 1}, keep=False).select("source", "_mix.*").toPandas()
    assert got.position.is_unique and len(got) == 300
    assert abs((got[got.slot < 30].source == "a").sum() - 80) <= 8


def test_mix_over_groups_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    monkeypatch.setattr(mixing, "GROUP_BUCKETS", 4)
    monkeypatch.setattr(mixing, "SENT_SLOTS", 0)
    df = spark.range(500).selectExpr("IF(id % 5 = 0, NULL, id) AS doc_id", "IF(id % 4 = 0, 'x', 'y') AS source", "id AS other")
    got = mixing.mix(df).select("source", "other", "_mix.*").toPandas()
    assert sorted(got.other) == list(range(500)) and got.position.is_unique
    for s, n in (("x", 125), ("y", 375)):
        own = got[got.source == s]
        assert Counter(own.block) == Counter(k // 8 for k in range(n))


def test_mix_odd_tables(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(None, None, None), (1, "a", "t"), (1, "a", "t" * 3_000_000), (None, "a", "")], "doc_id long, source string, text string")
    got = mixing.mix(same)
    assert got.columns == ["doc_id", "source", "text", "_mix"] and got.select("_mix.position").distinct().count() == 4
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": -1})
    ordered = mixing.written_order(mixing.mix(docs), docs.columns)
    assert ordered.columns == docs.columns and ordered.count() == docs.count()


def shuffles(df):
    """Shuffles of a plan that has not run."""
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("parts", ["1", "4", "60"])
def test_rows_in_the_order_of_the_mixture(spark, docs, monkeypatch, tmp_path, parts):
    """Row for row the order of mix's positions, and rows of one id or none at places of their source; also with whole rows numbered."""
    odd = spark.range(700).selectExpr("IF(id % 3 = 0, NULL, id % 50) AS `doc id`", "IF(id % 7 = 0, NULL, concat('s', id % 2)) AS source", "id AS _tie", "repeat('x', CAST(id AS INT)) AS `te.xt`")
    odd.repartition(3).write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    had = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for weights in (None, {"s0": 9, "s1": 1}):
            want = [r[:-1] for r in sorted(map(tuple, mixing.mix(docs, weights).select(*docs.columns, "_mix.position").collect()), key=lambda r: r[-1])]
            assert [tuple(r) for r in mixing.in_order(docs, weights).collect()] == want
            want = sorted(mixing.mix(odd, weights, id_col="doc id").collect(), key=lambda r: r._mix.position)
            for cuts in (mixing.SENT_CUTS, 0):
                with monkeypatch.context() as m:
                    m.setattr(mixing, "SENT_CUTS", cuts)
                    got = mixing.in_order(odd, weights, id_col="doc id")
                    assert got.columns == odd.columns
                    got = got.collect()
                assert [r.source for r in got] == [r.source for r in want] and sorted(r._tie for r in got) == list(range(700))
        assert mixing.in_order(docs.limit(0)).count() == 0 and mixing.in_order(docs.limit(1)).count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_partitions_of_the_mixture_are_even(spark):
    """No two neighbours share a partition."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "concat('s', floor(sqrt(id % 30))) AS source")
    had = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        sizes = mixing.in_order(df).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert len(sizes) == 20 and max(r[1] for r in sizes) < 1100


def test_mixing_stage_shuffles_texts_once(spark, docs):
    import corpus_pipeline as p

    assert shuffles(p.mix_sources(spark, docs, SF)) == 1


# -- joins of similar texts --------------------------------------------------------------------


def test_posterior():
    assert posterior_reaches(0, 0, 0.8) == pytest.approx(0.2)
    assert posterior_reaches(10, 10, 0.8) > 0.9 > 0.1 > posterior_reaches(4, 10, 0.8)
    steps = least_matches(60, 30, 0.8, 1e-6)
    assert [n for n, _ in steps] == [30, 60] and 0 < steps[0][1] < 24


def test_shared_counts_both_ways():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, 80)).astype(np.uint64) for _ in range(40)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40), indexing="ij"))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert shared_counts(sets, sets, i, j).tolist() == want
    assert shared_counts(sets, sets, i[:5], j[:5]).tolist() == want[:5]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2000 + k) for k in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    edges += [(3000, 3400), *((k, k - 1) for k in range(3400, 3001, -1))] + [(4000 + k, 4000 + (k + 1) % 100) for k in range(100)]
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_rounds_on_long_chains(spark, monkeypatch):
    """1 - n, n - n-1, ..., 3 - 2: the smallest number meets the others from the far end."""
    from widecairn.llm import _components

    rounds = []
    monkeypatch.setattr(_components, "_star", lambda links, large, f=_components._star: rounds.append(large) or f(links, large))
    n = 1000
    chain = spark.createDataFrame([(1, n), *((k, k - 1) for k in range(n, 2, -1))], "a long, b long")
    assert {r.root for r in connected_components(chain).collect()} == {1}
    assert sum(rounds) <= 16


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if i is not None and w:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, where = Counter(), defaultdict(set)
    for i, s in sets.items():
        for g in s:
            where[g].add(i)
    for i, s in sets.items():
        for j in set().union(*(where[g] for g in s)):
            if j > i and len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in root}


def test_jaccard_join(spark, docs):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    made = []
    for k in range(150):  # a group of near copies, some equal, some too far apart
        w = list(base)
        for _ in range(r.choice((0, 0, 1, 2, 4, 9))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        made.append((10_000 + k, " ".join(w)))
    odd = [(20_000, None), (20_001, ""), (20_002, "one two"), (20_003, "One  TWO"), (20_004, "w " * 5000), (20_005, "w " * 7000), (None, "one two"), (20_006, "dup " * 3), (20_006, "dup " * 3)]
    rows = [tuple(x) for x in docs.select("doc_id", "text").collect()] + made + odd
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, n_links int, class_id int")
    got = jaccard_join.similarity_classes(df).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    assert {x.doc_id: (x.class_id, x.n_links) for x in got if x.doc_id is not None} == want
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} == {c for c, _ in want.values()} | {None}
    assert jaccard_join.similarity_classes(df.limit(0)).count() == 0


def test_one_row_of_each_group(spark):
    """Repeated rows go, rows without an id or words stay, and so do different texts of the kept id."""
    t, u = "a text of some seven words", "quite another text under the same id"
    rows = [(1, t), (1, t), (1, f" {t.upper()} "), (1, u), (2, t), (None, t), (None, t), (3, ""), (3, ""), (4, None), (5, "only here")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _id int")
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, " ".join((r.text or "").lower().split())) for r in kept.collect())
    assert got == Counter({(1, t): 1, (1, u): 1, (None, t): 2, (3, ""): 1, (4, ""): 1, (5, "only here"): 1})


def test_any_column_names_but_integer_ids(spark):
    rows = [(k, f"text {k % 3} of no great length but some", "s") for k in range(9)]
    df = spark.createDataFrame(rows, "`doc id` long, `a.text` string, `so urce` string")
    assert jaccard_join.similarity_classes(df, "doc id", "a.text").columns[0] == "doc id"
    assert substring_dedup.repeated_spans(df, "doc id", "a.text").count() == 9
    assert mixing.mix(df, None, "so urce", "doc id").count() == 9
    target = df.select("doc id").limit(3)
    assert lm_score.score(df, target, *lm_score.fit(df, target, "doc id", "a.text"), "doc id", "a.text").columns[0] == "doc id"
    text_ids = df.withColumn("doc id", F.lit("x"))
    for f in (jaccard_join.similarity_classes, substring_dedup.repeated_spans):
        with pytest.raises(TypeError):
            f(text_ids, "doc id", "a.text")


def test_nothing_is_left_behind(spark, tmp_path, monkeypatch):
    """An operator's own tables are deleted when it ends and when it fails."""
    from pathlib import Path

    from widecairn.llm import _frames

    monkeypatch.setattr(_frames, "shared_dir", lambda spark: str(tmp_path))
    df = spark.createDataFrame([(k, f"text {k % 3} of no great length but some") for k in range(9)], "doc_id long, text string")
    jaccard_join.similarity_classes(df).count()
    assert {p.name.split("-")[0] for p in Path(tmp_path, "widecairn").iterdir()} <= {"classes", "code"}
    with pytest.raises(RuntimeError):
        with _frames.Scratch() as scratch:
            scratch.stored(df, "failing")
            raise RuntimeError
    assert not [p for p in Path(tmp_path, "widecairn").iterdir() if p.name.startswith("failing")]


def test_families_of_near_copies(spark, monkeypatch):
    """Tight and loose groups around several texts, with strangers in their buckets: all links against brute force, and few rows sent."""
    from widecairn.llm import _linkage

    monkeypatch.setattr(_linkage, "BLOCK_SETS", 32)
    monkeypatch.setattr(_linkage, "LARGE", 8)
    sent = []
    monkeypatch.setattr(_linkage.Scratch, "stored", lambda self, df, name, f=_linkage.Scratch.stored: sent.append((name, f(self, df, name))) or sent[-1][1])
    r = random.Random(15)
    rows = []
    for group, (edits, n) in enumerate((((0, 1, 1, 2), 200), ((3, 5, 7, 9), 90), ((1, 12), 60))):
        base = [f"g{group}w{r.randrange(10**6)}" for _ in range(160)]
        for k in range(n):
            w = list(base)
            for _ in range(r.choice(edits)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((1000 * group + k, " ".join(w)))
    rows += rows[5:9] + rows[210:212]  # repeated rows
    want = brute_classes(rows)
    got = jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in got} == want
    assert [n for n, _ in sent].count("families") == 1
    # An id with two texts, one in a group and one elsewhere, ties the two together and changes no other links.
    more = [*rows, (3, "another text that stands alone here"), (2005, rows[220][1])]
    got = jaccard_join.similarity_classes(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert {x.class_id for x in got if x.doc_id < 300} == {0} and {x.class_id for x in got if 2000 <= x.doc_id or 1000 <= x.doc_id < 1100} <= {1000, *(i for i, (c, _) in want.items() if c == i), min(want[2005][0], want[rows[220][0]][0])}


def test_tight_groups_are_not_compared(spark):
    """20,000 near copies of one text: every pair is linked, and no set is sent more than a few times."""
    base = " ".join(f"w{k}" for k in range(300))
    df = spark.range(20_000).selectExpr("id AS doc_id", f"concat('x', id, ' ', '{base}') AS text")
    got = jaccard_join.similarity_classes(df).groupBy("class_id", "n_links").count().collect()
    assert [tuple(r) for r in got] == [(0, 19_999, 20_000)]


def test_blocks_of_large_buckets(spark, monkeypatch):
    from widecairn.llm import _linkage

    monkeypatch.setattr(_linkage, "BLOCK_SETS", 16)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(90):
        w = list(base)
        w[r.randrange(len(w))] = f"x{k}"
        rows.append((k, " ".join(w)))
    got = jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in got} == brute_classes(rows)


# -- substring dedup ---------------------------------------------------------------------------


def passage(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_tuned_bands():
    bands, rows = substring_dedup.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands <= 8


def test_repeated_passages(spark):
    r = random.Random(6)
    p, q, near = passage(r, 60), passage(r, 70), passage(r, 60).split()
    changed = list(near)
    changed[30] = "other"
    rows = [(k, "\n".join(passage(r, 15) for _ in range(4))) for k in range(30)]
    rows += [(100, f"{passage(r, 10)}\n{p}\n{passage(r, 10)}"), (101, f"{p}\n{passage(r, 30)}"), (102, f"{passage(r, 25)} {q} {passage(r, 9)}"), (103, f"{passage(r, 12)} {q} {passage(r, 40)}")]
    rows += [(104, " ".join(near)), (105, f"{passage(r, 8)}\n{' '.join(changed)}"), (106, f"{passage(r, 40)}\n" * 3), (107, None), (108, ""), (None, p), (109, "x" * 9000), (110, "short line\n" * 50)]
    wrapped = passage(r, 80).split()
    rows += [(120, passage(r, 20) + "\n" + "\n".join(" ".join(wrapped[k : k + 8]) for k in range(0, 80, 8))), (121, "\n".join(" ".join(wrapped[k : k + 11]) for k in range(0, 80, 11)) + "\n\n" + passage(r, 12))]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, keeper_ids string")
    got = {x.doc_id: x for x in substring_dedup.repeated_spans(df).collect()}
    texts = dict(rows)
    assert len(got) == len(rows)
    assert {i for i, x in got.items() if x.n_removed} == {101, 103, 105, 121}
    assert [got[i].keeper_ids for i in (101, 103, 105, 121)] == [[100], [102], [104], [120]]
    assert got[101].removed_spans == f"0:{len(p)}"
    a, e = map(int, got[103].removed_spans.split(":"))
    assert texts[103][a:e] in q and e - a > len(q) / 2
    left = {x.doc_id: x.text for x in substring_dedup.without_repeats(df).collect()}
    assert p not in left[101] and left[100] == texts[100] and left[107] == ""
    assert substring_dedup.repeated_spans(df.limit(0)).count() == 0


def test_units_equal_line_by_line():
    """Keys, places and band keys of many lines at once are those of each line alone, and windows those of each text alone."""
    r = random.Random(7)
    texts = [passage(r, 25), "  " + passage(r, 40).replace(" ", "  ", 3) + "\t", f"{passage(r, 5)}\n{passage(r, 90).upper()}\n\n{passage(r, 33)} \u0130x", "", "x " * 100, passage(r, 19), "a b " * 60]
    cache, hasher = WordHashes(), MinHasher(14)
    u = substring_dedup.Units(texts, cache)
    want = [(d, *line) for d, t in enumerate(texts) for line in substring_dedup.lines_of(t)]
    assert [(d, a, a + n) for d, a, n in zip(u.doc, u.start, u.size)] == [w[:3] for w in want]
    bands = u.band_keys(hasher, 2)
    one = lambda h: substring_dedup.keys_of(h, np.array([0]), np.array([len(h)]))[0]
    for row, (_, _, _, words) in enumerate(want):
        assert u.keys[row] == one(cache.array(words))
        assert bands[row].tolist() == band_keys(hasher(shingle_set(" ".join(words), cache)), 2)[0].tolist()
    found = [(d, s, n, k) for d, s, n, k in zip(u.window_doc.tolist(), u.window_start.tolist(), u.window_size.tolist(), u.window_keys.tolist())]
    alone = []
    for d, t in enumerate(texts):
        h = cache.array(t.lower().split())
        for a, e in zip(*substring_dedup.windows_of(h, np.zeros(len(h), dtype=np.int64))):
            alone.append((d, int(one(h[a:e]))))
            assert 20 <= e - a < 28
    assert [(d, k) for d, _, _, k in sorted(found)] != [] and sorted((d, k) for d, _, _, k in found) == sorted(alone)
    for d, s, n, k in found:
        assert k == one(cache.array(texts[d][s : s + n].lower().split()))


def test_any_passage_of_50_words_has_a_common_window():
    r = random.Random(9)
    cache = WordHashes()
    for _ in range(400):
        p = passage(r, 50).split()
        keys = []
        for _ in range(2):
            h = cache.array([*passage(r, r.randint(1, 60)).split(), *p, *passage(r, r.randint(1, 60)).split()])
            keys.append(set(substring_dedup.keys_of(h, *substring_dedup.windows_of(h, np.zeros(len(h), dtype=np.int64))).tolist()))
        assert keys[0] & keys[1]


def words_at(text):
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\S+", text)]


def brute_repeats(rows):
    """By id: the words that lie in a run of 50 words, and those in a run of 20 or in a similar line of at least 20, that a document with a smaller id holds."""
    runs: dict[int, dict] = {20: {}, 50: {}}
    for i, t in sorted(rows):
        w = [x[2] for x in words_at(t)]
        for n, first in runs.items():
            for k in range(len(w) - n + 1):
                first.setdefault(tuple(w[k : k + n]), i)
    lines = defaultdict(set)
    for i, t in rows:
        for line in t.lower().split("\n"):
            if len(line.split()) >= 5:
                lines[tuple(line.split())].add(i)
    names, shingles, where = list(lines), [], defaultdict(list)
    for k, w in enumerate(names):
        shingles.append({w[j : j + 5] for j in range(len(w) - 4)})
        for g in shingles[-1]:
            where[g].append(k)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(shingles):
        for j in {j for g in s for j in where[g] if j < k}:
            if len(s & shingles[j]) >= 0.8 * len(s | shingles[j]):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, w in enumerate(names):
        least[find(k)] = min(least.get(find(k), 1 << 62), *lines[w])
    keeper = {w: least[find(k)] for k, w in enumerate(names)}
    must, may = defaultdict(set), defaultdict(set)
    for i, t in rows:
        w = [x[2] for x in words_at(t)]
        for n, out in ((50, must), (20, may)):
            for k in range(len(w) - n + 1):
                if runs[n][tuple(w[k : k + n])] < i:
                    out[i].update(range(k, k + n))
        at = 0
        for line in t.lower().split("\n"):
            n = tuple(line.split())
            if len(n) >= 20 and keeper[n] < i:
                may[i].update(range(at, at + len(n)))
                must[i].update(range(at, at + len(n)))
            at += len(n)
    return must, may


def test_removals_against_brute_force(spark, docs):
    """Nothing goes that isn't a similar line or within a run of 20 words of another document; every repeated run of 50 words is met."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    must, may = brute_repeats(rows)
    whole = total = 0
    for x in substring_dedup.repeated_spans(docs).collect():
        spans = [tuple(map(int, s.split(":"))) for s in x.removed_spans.split(",") if s]
        gone = {k for k, (a, e, _) in enumerate(words_at(dict(rows)[x.doc_id])) if any(p <= a and e <= q for p, q in spans)}
        assert gone <= may[x.doc_id], x.doc_id
        assert bool(gone) >= bool(must[x.doc_id]), x.doc_id
        whole += len(gone & must[x.doc_id])
        total += len(must[x.doc_id])
    assert total and whole >= 0.9 * total


def test_short_phrases_of_many_documents_stay(spark):
    """A text made of 13-word pieces, each from another document, loses nothing."""
    r = random.Random(12)
    pieces = [passage(r, 13) for _ in range(24)]
    rows = [(k, f"{passage(r, 30)} {p} {passage(r, 30)}") for k, p in enumerate(pieces)] + [(100, " ".join(pieces))]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.n_removed == 0 for x in got)


def test_texts_of_one_id_lose_only_what_they_repeat(spark):
    r = random.Random(13)
    p, own = passage(r, 60), passage(r, 90)
    rows = [(1, p), (2, f"{passage(r, 9)} {p}"), (2, own), (2, own), *[(3, f"{passage(r, 30)} {p}")] * 2]
    df = spark.createDataFrame(rows, "`doc id` long, `a text` string")
    got = defaultdict(list)
    for x in substring_dedup.without_repeats(df, "doc id", "a text").collect():
        got[x["doc id"]].append(x["a text"])
    assert got[1] == [p] and own in got[2] and len(got[2]) == 3
    assert sum(p not in t for t in got[2]) == 3 and len(set(got[3])) == 1 and p not in got[3][0]


def test_short_repeated_lines_are_reported(spark):
    r = random.Random(14)
    line = passage(r, 9)
    rows = [(k, f"{passage(r, 30)}\n{line}\n{passage(r, 30)}") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(x.n_removed, x.n_short) for x in sorted(substring_dedup.repeated_spans(df).collect())] == [(0, 0), (0, 1), (0, 1)]
    assert [x.n_removed for x in sorted(substring_dedup.repeated_spans(df, removed_words=5).collect())] == [0, 1, 1]


# -- language models -----------------------------------------------------------------------------


def plain_losses(rows, target):
    """(id, tokens, background loss, target loss) of each row by dictionaries."""
    tokens = [(i, [None, *(t or "").lower().split(), None]) for i, t in rows]
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for i, x in tokens:
        for m in range(1 + (i in target)):
            one[m].update(x[1:])
            two[m].update(zip(x, x[1:]))
    size = len(one[0].keys() | {None}) + 1  # and the unknown token
    out = []
    for i, x in tokens:
        own1, own2, want = Counter(x[1:]), Counter(zip(x, x[1:])), []
        for m in range(2):
            held = 1 if m == 0 else i in target
            n_all, loss = sum(one[m].values()) - held * (len(x) - 1), 0.0
            for a, b in zip(x, x[1:]):
                pair = (two[m][a, b] - held * own2[a, b]) / max(one[m][a] - held * own1[a], 1)
                loss -= np.log(lm_score.BIGRAM * pair + (1 - lm_score.BIGRAM) * (one[m][b] - held * own1[b] + lm_score.ADDED) / (n_all + lm_score.ADDED * size))
            want.append(loss / (len(x) - 1))
        out.append((i, len(x) - 1, *want))
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_lm_equals_dictionaries(spark, sf):
    """Every row, with nulls, empty and very long texts, repeated rows, and columns named as the results."""
    labels = spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    odd = [(9000, None), (9001, ""), (None, "the of"), (9002, "twice the same"), (9002, "twice the same"), (9003, "long of the " * 40_000)]
    df = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("doc_id", "text", "'x' AS score", "1 AS n_tokens")
    target = {x.doc_id for x in labels.collect()}
    got = lm_score.score(df, labels, *lm_score.fit(df, labels)).collect()
    want = plain_losses([(r.doc_id, r.text) for r in df.collect()], target)
    assert len(got) == len(want)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], round(r[2], 6))
    for r, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert r[:2] == w[:2] and r[2:4] == pytest.approx(w[2:], abs=1e-9) and r[4] == pytest.approx(w[3] - w[2], abs=1e-9)


def test_lm_counts_are_exact(spark, docs, monkeypatch):
    """Every count is the count by brute force, over many chunks and parts."""
    monkeypatch.setattr(lm_score, "CHUNK", 5000, raising=False)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    df = docs.select("doc_id", "text").repartition(3)
    words, models = lm_score.fit(df, labels)
    x = {i: ["", *(t or "").lower().split(), ""] for i, t in df.collect()}
    target = {r.doc_id for r in labels.collect()} & set(x)
    for m, name in enumerate(("loss_background", "loss_target")):
        some = target if m else set(x)
        one, two = Counter(w for i in some for w in x[i][1:]), Counter(p for i in some for p in zip(x[i], x[i][1:]))
        for r in lm_score.score(df, labels, words, models).collect():
            own, held = x[r.doc_id], r.doc_id in some
            own1, own2 = (Counter(own[1:]), Counter(zip(own, own[1:]))) if held else (Counter(), Counter())
            n, loss = sum(one.values()) - sum(own1.values()), 0.0
            for a, b in zip(own, own[1:]):
                pair = (two[a, b] - own2[a, b]) / max(one[a] - own1[a], 1)
                loss -= np.log(lm_score.BIGRAM * pair + (1 - lm_score.BIGRAM) * (one[b] - own1[b] + lm_score.ADDED) / (n + lm_score.ADDED * (len(words) + 2)))
            assert r[name] == pytest.approx(loss / (len(own) - 1), abs=1e-9)


def test_lm_keeps_rare_words(spark):
    """A word that is rarer than one in 2**18 tokens is still told from another."""
    df = spark.createDataFrame([(k, "the of " * 15_000) for k in range(20)] + [(100, "zebra quagga"), (101, "zebra quagga"), (102, "ibex okapi"), (103, "ibex okapi")], "doc_id long, text string")
    target = spark.createDataFrame([(100,), (101,)], "doc_id long")
    words, models = lm_score.fit(df, target)
    assert list(words) == sorted(["the", "of", "zebra", "quagga", "ibex", "okapi"]) and models.size == len(words) + 2
    got = {r.doc_id: r for r in lm_score.score(df, target, words, models).collect()}
    assert got[100].score < got[102].score - 1 and got[100].score == got[101].score


def test_lm_prefers_the_target(spark):
    r = random.Random(4)
    text = lambda words: " ".join(r.choice(words) for _ in range(60))
    a, b = ["sun", "moon", "star", "sky"], ["cat", "dog", "cow", "sky"]
    rows = [(k, text(a if k % 2 else b)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(k,) for k in range(1, 60, 2)], "doc_id long")
    got = lm_score.score(df, target, *lm_score.fit(df, target)).collect()
    assert max(x.score for x in got if x.doc_id % 2) < min(x.score for x in got if not x.doc_id % 2)
    assert lm_score.score(df.limit(0), target, *lm_score.fit(df.limit(0), target)).count() == 0


# -- nearest neighbours -----------------------------------------------------------------------------


def brute_nearest(rows, q, v, k):
    found = [(float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v)]
    return sorted(set(found))[:k]


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    index = hnsw.build_index(df, shard=100)
    got = hnsw.search(index, df.where("vec_id % 20 = 0")).collect()
    hit = total = 0
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    vectors = dict(rows)
    assert set(by) == {i for i, _ in rows if i % 20 == 0}
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        want = brute_nearest(rows, q, vectors[q], 10)
        hit += len({i for _, i in want} & {r.vec_id for r in found})
        total += 10
        for r in found:
            assert r.score == pytest.approx(float(np.linalg.norm(np.array(vectors[r.vec_id]) - np.array(vectors[q]))), abs=1e-12)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
    assert hit / total >= 0.9


def test_recall_of_whole_shards(spark):
    """20,000 vectors without clusters in five shards of the production size, searched with the production width."""
    r = np.random.default_rng(3)
    x = r.normal(size=(20_000, 32)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(set)
    for row in hnsw.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got[row.query_id].add(row.vec_id)
    y, hit = x.astype(np.float64), 0
    for q, found in got.items():
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(found & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 200 and hit / 2000 >= 0.95


def test_ties_of_different_vectors_go_to_smaller_ids(spark):
    """More vectors at one distance than a search keeps."""
    rows = [(0, [1.0] * 300)] + [(k, [1.0 + 3.0 * (j == (k * 7) % 300) for j in range(300)]) for k in range(1, 290)] + [(1000 + k, [30.0 + k] * 300) for k in range(20)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(k, k, 3.0) for k in range(1, 11)]


def test_graph_links():
    """No node has more neighbours than its level allows, none is its own, and all are on the level."""
    r = np.random.default_rng(5)
    x, level = r.normal(size=(700, 8)), np.minimum((-np.log(r.random(700)) / np.log(4)).astype(int), 4)
    g = hnsw.Graph.build(x, level, m=6, ef=30)
    assert len(g.levels) == level.max() + 1
    for k, (nodes, table) in enumerate(g.levels):
        assert table.shape[1] == (12 if k == 0 else 6) and set(nodes.tolist()) >= set(np.flatnonzero(level >= k).tolist())
        for node, js in zip(nodes.tolist(), table):
            js = js[js >= 0].tolist()
            assert node not in js and len(set(js)) == len(js) and set(js) <= set(nodes.tolist())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []), (None, [1.0, 1.0]), (11, [1.0, 0.0, 0.0]), (200, [0.0, 1.0]), (200, [0.0, 1.0])]
    rows += [(1000 + k, [1.0, 0.0]) for k in range(1, 60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string")
    good = [(i, v) for i, v in rows if i is not None and i not in (5, 6, 7, 8, 9, 10)]
    got = defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        want = brute_nearest(good, q, dict(good)[q], 10)
        assert [(s, i) for _, s, i in sorted(found)] == want
    assert hnsw.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_copies_go_without_a_shuffle_of_texts(spark, docs):
    """However small Spark's own limit for broadcasts."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert shuffles(jaccard_join.one_of_each(docs.where("doc_id % 2 = 0"))) <= 1  # of the ids that go
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


@pytest.mark.parametrize("kind", ["long", "int", "byte"])
@pytest.mark.parametrize("most", [1 << 20, 3])
def test_rows_without_dropped_ids(spark, monkeypatch, kind, most):
    monkeypatch.setattr(jaccard_join, "SENT_MASKS", most)
    r, edge = random.Random(5), {"long": 2**63, "int": 2**31, "byte": 128}[kind]
    ids = [None, None, -edge, edge - 1, *range(-130 if edge > 128 else -70, -60), -1, 0, 63, 64, 64] + [r.randrange(-100, 100) for _ in range(200)]
    df = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], f"_own int, `doc id` {kind}")
    gone = {-edge, 64, -64, *r.sample(range(-100, 100), 60)}
    got = jaccard_join.without(df, "doc id", spark.createDataFrame([(i,) for i in [*gone, None, 64]], f"`doc id` {kind}"))
    assert got.schema == df.schema
    assert sorted(tuple(x)[0] for x in got.collect()) == [k for k, i in enumerate(ids) if i is None or i not in gone]


# -- pipeline -----------------------------------------------------------------------------------------


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    from widecairn.llm import pii, toxicity
    from widecairn.llm._frames import stored

    assert p.ORACLE_SQL is None and len(p.STAGES) == 5
    chain = toxicity.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer, rows = toxicity.Scorer(chain), [tuple(r) for r in docs.collect()]
    want = [r for r in rows if scorer(r[1])[-1] < chain.threshold]
    classes = brute_classes([(r[0], r[1]) for r in want])
    want = [r for r in want if classes[r[0]][0] == r[0]]
    now, sizes = docs, []
    for _, stage in p.STAGES[:-1]:
        now = stored(stage(spark, now, SF))
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[1:] == [len(want)] * 3 and sizes[0] >= sizes[1]
    trees = pii.fitted()
    texts = {}
    for r in want:
        base = pii.base_spans(r[1])
        texts[r[0]] = pii.redact(r[1], [*base, *pii.added_spans(r[1], base, *trees)])
    assert {r.doc_id: (r.text, r.n_chars) for r in now.collect()} == {i: (t, len(t)) for i, t in texts.items()}
    last = p.run(spark, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in last.collect()} == set(texts)
