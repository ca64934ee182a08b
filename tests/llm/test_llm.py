"""The text operators against plain versions on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables,
clashing extra columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import common, language_id, licenses, line_dedup, mixing, ngram_join, packing, pivot_search, quality, toxicity, winnowing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("al", "be", "cor", "du", "en", "fi") for b in ("ra", "to", "mi", "no", "sta", "per")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(1)
    texts = [None, "", "   \n ", "one", "Two words", prose(rng, 3000)]
    base = prose(rng, 120)
    for k in range(30):  # near copies of one text, exact copies among them
        ws = base.split()
        for _ in range(k % 6):
            ws[rng.randrange(len(ws))] = rng.choice(WORDS)
        texts.append(" ".join(ws))
    texts += [prose(rng, rng.randint(5, 60)) + "\n" + rng.choice(["Released under the MIT License.", base[:80], base[:79] + "x"]) for _ in range(40)]
    texts += [texts[7], texts[7], "mit LICENSE, Apache-License; (general) public\nlicense x", "größe ÉTÉ MIT License mit license"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 % 101, t, "en", f"s{k % 3}", None) for k, t in enumerate(corpus())]
    return spark.createDataFrame(rows + [(None, "text of no id", None, None, 4)], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_components(texts, n, percent):
    sets = {}
    for i, t in texts:
        w = ngram_join.words_of(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, empty, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, n, percent).collect()}
    assert got.pop(None)[1] is None
    assert got == plain_components([(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()], n, percent)
    assert ngram_join.join(empty, n, percent).count() == 0


def near_family(rng, members, length, most):
    """Texts that differ from one base in up to `most` words each, at random or runs of them."""
    base, out = [f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(length)], []
    for _ in range(members):
        ws = list(base)
        for _ in range(rng.randint(0, most)):
            k = rng.randrange(length)
            ws[k : k + rng.randint(1, 4)] = [f"{rng.choice(WORDS)}{rng.randrange(40)}"]
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_of_large_families(spark, monkeypatch, n, percent, small):
    """A family of 260 near copies, a common passage, exact copies and strangers, with one flush and block and with many."""
    if small:
        for name, value in {"FLUSH": 2000, "FRAGMENT": 100, "SALTS": 3, "CHUNK": 16}.items():
            monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(12)
    texts = near_family(rng, 260, 90, 5)
    passage = prose(rng, 60)
    texts += [f"{prose(rng, k)} {passage} {prose(rng, 12 - k)}" for k in range(12)] + texts[:30] + [prose(rng, 70) for _ in range(20)]
    rng.shuffle(texts)
    rows = [(k * 7 % 331, t) for k, t in enumerate(texts)]
    assert len({i for i, _ in rows}) == len(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash")).withColumn("node", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, n, percent).collect()}
    want = plain_components(rows, n, percent)
    assert got == want and 1 < len({c for _, c in want.values()}) < len(rows) - 100


def test_ngram_join_of_repeated_ids(spark):
    """Rows of one id are one node: 1 and 3 meet through the two texts of 2."""
    rng = random.Random(13)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, None), (5, c)]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (5, 4)]


def test_block_links_whatever_can_link():
    rng = np.random.default_rng(3)
    for percent, size in [(p, s) for p in (80, 90) for s in (9, 10, 40, 333)]:
        for extra in range(size * 100 // percent - size + 1):
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            need = -(-percent * (2 * len(x) + extra) // (100 + percent))
            for both in (need, need - 1):
                y = np.unique(np.concatenate([x[len(x) - both :], rng.integers(0, 1 << 63, len(x) + extra - both).astype(np.uint64)]))
                got = ngram_join.link_block([1, 2], [x, y], np.array([len(x), len(y)]), np.arange(2), percent, None)
                assert bool(got) == (100 * both >= percent * (len(x) + len(y) - both))


def test_planes():
    rng = np.random.default_rng(4)
    for size in (0, 1, 1000):
        g = np.sort(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        assert (ngram_join.unplanes(ngram_join.planes(g)) == g).all()


def test_winnowing(docs, empty, spark):
    rows = {r.doc_id: r for r in winnowing.digest(docs).collect()}
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    prints = defaultdict(set)
    for (i, t), (_, nxt) in zip(texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints[t].add(rows[i].fingerprint)
        assert 0 <= rows[i].near_edited <= 1 and (rows[i].near_next == 1) == (nxt == t or set(f.split(":")[0] for f in rows[i].fingerprint.split()) == set(f.split(":")[0] for f in plain_print(rows, texts, nxt)))
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {""}
    assert winnowing.digest(empty).count() == 0
    # the match guarantee: any window + k - 1 words in a row have a chosen gram in common
    rng = random.Random(4)
    passage = prose(rng, winnowing.WINDOW + winnowing.K - 1)
    pair = spark.createDataFrame([(1, f"{prose(rng, 30)} {passage} {prose(rng, 9)}"), (2, f"{prose(rng, 7)} {passage} {prose(rng, 31)}")], "i int, text string")
    a, b = ({v for v in r.h} for r in pair.select(winnowing.hashes(winnowing.chosen(F.col("text"))).alias("h")).collect())
    assert a & b


def plain_print(rows, texts, text):
    return next(rows[i].fingerprint.split() for i, t in texts if t == text)


@pytest.mark.parametrize(("k", "window"), [(5, 8), (1, 1), (2, 4), (3, 5), (7, 3), (8, 9)])
def test_winnowing_against_plain_minima(spark, k, window):
    import xxhash

    def plain(text):
        low = text.lower().strip(" \t\n\r\f\x0b")
        h = [int(np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), 42)))) % winnowing.PRIME for w in low.split()] if low else []
        value = lambda ws: sum(x * pow(winnowing.BASE, len(ws) - 1 - j, winnowing.PRIME) for j, x in enumerate(ws)) % winnowing.PRIME
        grams = [value(h[i : i + k]) for i in range(len(h) - k + 1)] or ([value(h)] if h else [])
        out = []
        for i in range(max(1, len(grams) - window + 1) if grams else 0):
            part = grams[i : i + window]
            at = max(j for j, g in enumerate(part) if g == min(part)) + i
            if (grams[at], at) not in out:
                out.append((grams[at], at))
        return " ".join(f"{g:X}:{at}" for g, at in out)

    rng = random.Random(16)
    texts = ["", " \n", "one", "A b", "a a a a a a a a a a a a", *(" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(30)), prose(rng, 2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", winnowing.as_text(winnowing.chosen(F.col("text"), k, window)).alias("p"))
    assert {r.i: r.p for r in rows.collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_order_of_many_buckets(spark, monkeypatch):
    """Next documents across bucket bounds, with negative, repeated and null ids, and columns of clashing names."""
    monkeypatch.setattr(winnowing, "BUCKET_ROWS", 3)
    rows = [(i, f"text {i}") for i in (-50, -3, 0, 1, 2, 5, 5, 5, 9, 1 << 40, None, None)] + [(i, f"more {i}") for i in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select(*(F.lit(1).alias(c) for c in ("bucket", "ghost", "fp")), "*", F.lit(2).alias("edited")).repartition(4)
    got = {(r.doc_id, r.edited_sha256) for r in winnowing.digest(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = set()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.add((i, hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert got == want


def test_rightmost_ties(spark):
    got = spark.createDataFrame([("a a a a a a a a a a a a a",)], "text string").select(winnowing.as_text(winnowing.chosen(F.col("text"), 2, 4)).alias("p")).first().p
    assert [int(x.split(":")[1]) for x in got.split()] == list(range(3, 12))


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.digest(docs.withColumn("found", F.lit(1))).collect()}
    import re

    low = str.maketrans(licenses.UPPER, licenses.LOWER)
    for r in docs.collect():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r.text or "").translate(low))
        at = [k for _, p in licenses.BASE for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        base = {label for label, p in licenses.BASE for k in range(len(words)) if tuple(words[k : k + len(p)]) == p}
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)))
        assert base <= set(g.labels.split(",")) | {""} and 0 <= g.score <= 1
    assert licenses.digest(empty).count() == 0


def test_license_templates(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "All rights\n reserved", "license", "permission is hereby denied, free of charge", licenses.TEMPLATES[13][1].upper()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [r.labels for r in licenses.digest(rows).orderBy("doc_id").collect()] == ["cc-by-nc", "proprietary", "", "", "bsd"]


def test_every_template_is_found(spark):
    """Each notice within other words, its own words apart by any separators; without a mandatory phrase it is not found."""
    rng = random.Random(15)
    rows = []
    for k, (_, text, _) in enumerate(licenses.TEMPLATES):
        words = text.split()
        rows.append((2 * k, f"{prose(rng, 9)} {''.join(w + rng.choice([' ', chr(10) + ' * ', '  --  ', ', ', ' /// ']) for w in words)} {prose(rng, 9)}"))
        rows.append((2 * k + 1, " ".join(w for w in words for w in (w, "zz"))))
    got = {r.doc_id: r for r in licenses.digest(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[2 * k].labels.split(",") and got[2 * k].score >= licenses.LEAST_SHARE
        assert got[2 * k + 1].labels == ""
    odd = spark.createDataFrame([(1, "under CC  --  BY-NC 4.0 terms"), (2, "Licensed\n#\n#   under CC ... BY ... SA 4.0")], "doc_id int, text string")
    assert [r.labels for r in licenses.digest(odd).orderBy("doc_id").collect()] == ["cc-by-nc", "cc-by-sa"]


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(q[-1] + 1, p[j + 1] + 1, p[j] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(2)
    for tau in (1, 2, 4):
        pairs = []
        for _ in range(200):
            a = [rng.choice("ab") for _ in range(rng.randint(9, 80))]
            b = list(a)
            for _ in range(rng.randint(0, tau + 2)):
                k = rng.randrange(len(b))
                b[k : k + rng.randint(0, 1)] = rng.choice(["", "c", "b"])
            pairs.append(("".join(a), "".join(b) + "abababab"[: max(0, 8 - len(b))]))
        got = line_dedup.within([(line_dedup.code_points(a), line_dedup.code_points(b)) for a, b in pairs], tau)
        assert got.tolist() == [plain(a, b) <= tau for a, b in pairs]


def test_line_dedup(docs, empty, spark):
    line = "this is a line of enough length to count"
    rows = [(1, f"short\n{line}\nend"), (2, f"{line[:-1]}\nshort"), (3, f"x{line} \n{line.replace('enough', 'plenty')}"), (3, f"x{line} \n{line.replace('enough', 'plenty')}"), (4, None), (None, line), (5, ""), (6, line.replace("line", "lane"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = df.select(*(F.lit("clash").alias(c) for c in ("n_lines", "_gone", "id", "component")), "*", *(F.lit(1).alias(c) for c in ("n_dropped", "kept", "class", line_dedup.GONE)))
    got = line_dedup.dedup(clash)
    assert got.columns == ["_gone", "id", "component", "doc_id", "text", "kept", "class", "n_lines", "n_dropped"]
    got = common.stored(got, "t")
    assert sorted(((r.doc_id or 0, r.text or "", r.n_dropped) for r in got.collect())) == sorted([(0, line, 0), (1, rows[0][1], 0), (2, "short", 1), (3, line.replace("enough", "plenty"), 1), (3, line.replace("enough", "plenty"), 1), (4, "", 0), (5, "", 0), (6, "", 1)])
    assert line_dedup.dedup(empty).count() == 0


def plain_dedup(rows, tau, least):
    """Texts without later lines of a class, classes by comparing all lines with each other."""

    def near(a, b):
        if abs(len(a) - len(b)) > tau:
            return False
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(q[-1] + 1, p[j + 1] + 1, p[j] + (x != y)))
            p = q
        return p[-1] <= tau

    every = sorted({w for _, t in rows for x in t.split("\n") if len(w := x.strip(line_dedup.BLANK)) >= least})
    root = {x: x for x in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(every):
        for b in every[:k]:
            if find(a) != find(b) and near(a, b):
                root[find(a)] = find(b)
    met, out = set(), []
    for i, t in sorted(rows):
        stay = []
        for x in t.split("\n"):
            w = x.strip(line_dedup.BLANK)
            if len(w) < least or find(w) not in met:
                stay.append(x)
            if len(w) >= least:
                met.add(find(w))
        out.append((i, "\n".join(stay)))
    return out


def test_line_dedup_against_all_pairs(spark):
    """Families larger than a chunk, chains of edits, and one text of many lines that go."""
    rng = random.Random(14)
    bases, lines = [prose(rng, 7) for _ in range(3)], []
    for _ in range(110):
        x = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(x))
            x[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
        lines.append("".join(x))
    assert max(Counter(min(bases, key=lambda b: abs(len(b) - len(x))) for x in lines).values()) > 16
    rows = [(k, "\n".join(rng.choice([*lines, "short", prose(rng, 6)]) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 4)))) for k in range(60)]
    rows.append((60, "\n".join(rng.choice(lines) for _ in range(3000))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    old, line_dedup.CHUNK = line_dedup.CHUNK, 16
    try:
        got = sorted((r.doc_id, r.text) for r in line_dedup.dedup(df).collect())
    finally:
        line_dedup.CHUNK = old
    assert got == plain_dedup(rows, line_dedup.TAU, line_dedup.LEAST)


def test_samples_are_bounded(spark):
    rows = [(k, "x" * (10 * k + 1), 1, 1) for k in range(40)] + [(40, None, 1, 1), (41, "y" * 100_000, 0, 0)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _, _ in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id bigint, quality int, toxic int")
    got = common.labelled_sample(docs, labels, "toxic", 3, 1, 1000, most_chars=3000)
    assert 2000 < sum(len(t) for t, _, _ in got) <= 3000 and any(t == "" for t, _, _ in got) == (zlib.crc32(b"40") % 3 != 1)
    assert common.bounded_texts(docs.where("doc_id = 41"), 10) == []


def test_a_cluster_needs_a_shared_folder():
    class Spark:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Spark.conf)

    with pytest.raises(RuntimeError):
        common.shared_dir(Spark)


def test_pivot_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)).astype(np.float32))] + [(1000 + i, [0.5] * 6) for i in range(40)]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [float("nan")] * 6), (2004, [None] * 6), (None, [1.0] * 6), (50, None)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    ids, x = np.array([r[0] for r in rows]), np.floor(256 * np.array([r[1] for r in rows]))
    got = defaultdict(list)
    for r in pivot_search.search(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for q in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        assert got[q] == [(int(ids[k]), int(s[k])) for k in np.lexsort((ids, -s))[:5]]
    assert pivot_search.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert pivot_search.search(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("equal", [0, 900])
def test_pivot_search_in_rounds(spark, monkeypatch, equal):
    """Many blocks, rings, chunks and rounds; clustered vectors of which most are never met, and a third that are equal."""
    for name, value in {"BLOCK": 64, "QUERIES": 20, "SAMPLE": 600}.items():
        monkeypatch.setattr(pivot_search, name, value)
    rng = np.random.default_rng(2)
    centers = 3 * rng.normal(size=(12, 8))
    x = centers[rng.integers(0, 12, 2000)] + 0.05 * rng.normal(size=(2000, 8))
    x = np.concatenate([x, np.tile(x[:1], (equal, 1))]).astype(np.float32)
    ids = np.append(np.arange(len(x) - 1), 7)  # id 7 twice
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id bigint, embedding array<float>").repartition(4)
    visits, got, v = [], defaultdict(list), np.floor(256 * x.astype(float))
    for r in pivot_search.search(df, F.col("vec_id") % 20 == 0, 5, visits).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q in got:
        s = v @ v[ids == q][0]
        own = ids != q
        order = np.lexsort((ids[own], -s[own]))[:5]
        assert got[q] == [(int(i), int(z)) for i, z in zip(ids[own][order], s[own][order])]
    assert len(visits) > 1 and sum(visits) < 0.5 * len(got) * len(x)


def test_language_id(spark, empty):
    rng = random.Random(5)
    langs = {"aa": "uvo xen pil grat".split(), "bb": "ösk hamm trub lind".split()}
    rows = [(i, " ".join(rng.choice(langs[k]) + rng.choice(["", "en", "is"]) for _ in range(30)), k) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ²!"), (4, "uvoen"), (5, "hammtrub" * 3000)], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert [got[k][0] for k in range(1, 6)] == ["und", "und", "und", "aa", "bb"] and got[1][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    held = language_id.identify(df, model).where("lang = lang_pred").count()
    assert held == 200
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"} and language_id.identify(empty, model).count() == 0


def test_language_sample_keeps_every_language(spark):
    rng = random.Random(6)
    langs = {"aa": "uvo xen pil grat".split(), "bb": "ösk hamm trub lind".split(), "cc": "zyw qoj kyx vuq".split()}
    rows = [(i, " ".join(rng.choice(langs[k]) for _ in range(20)), k) for i in range(3000) for k in ["cc" if i % 500 == 7 else ("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language_id.fit(df, most=20, least=5).langs == ["aa", "bb", "cc"]  # six of 3,000 documents
    long = df.where("doc_id < 200").union(spark.createDataFrame([(k, f"{t} " * 5000, "bb") for k, t in enumerate(langs["bb"], 5000)], df.schema))
    assert language_id.fit(long, most_chars=19_000).langs == ["aa", "bb", "cc"]
    model = language_id.fit(long, most_chars=19_000)  # less than any of the long texts: all others are learned from
    assert set(langs["aa"] + langs["bb"] + langs["cc"]) <= set(model.words)


def test_classifiers(spark, empty):
    rng = random.Random(6)
    texts = [(prose(rng, 40) + (" vile fool" if k % 4 == 0 else "") + f" {prose(rng, 20)}", int(k % 4 == 0), "en") for k in range(400)]
    model = toxicity.learn(texts)
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)] + [(900, None), (901, ""), (902, "vile fool " * 5000)], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert sum((got[k] >= toxicity.THRESHOLD) == y for k, (_, y, _) in enumerate(texts)) >= 390
    assert got[900] == got[901] < toxicity.THRESHOLD and got[902] >= toxicity.THRESHOLD and all(0 <= s <= 1 for s in got.values())
    assert toxicity.learn([]) is None and {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    texts = [((prose(rng, 40) if k % 4 else " ".join(w + "$$$" for w in prose(rng, 40).split())), int(k % 4 > 0), "en") for k in range(300)]
    model = quality.learn(texts)
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)] + [(900, None), (901, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert sum((got[k] >= quality.THRESHOLD) == y for k, (_, y, _) in enumerate(texts)) >= 295 and got[900] == got[901]
    assert quality.learn([]) is None and quality.score(empty, model).count() == 0


ODD_TEXTS = [None, "", " \n\t ", "123 ²!", "x", "Ärger uvo UVO", "uvo " * 4000, "vile fool\nvile fool", "a,b.c? d!", "http://x.y | $$$ \ud83d\ude00"]


def plain_language(model, text):
    """Word by word, with no arrays of several words."""
    words = language_id.WORD.findall((text or "").lower())
    if not any(c.isalpha() for c in text or "") or not words:
        return "und", 0.0
    total = [0.0] * len(model.langs)
    for w in words:
        if w in model.words:
            row = [float(x) for x in model.logs[model.words[w]]]
        else:
            row = [0.0] * len(model.langs)
            for n in range(5, 0, -1):
                grams = [f" {w} "[i : i + n] for i in range(len(w) + 2 - n + 1)]
                known = [model.logs[model.grams[g]] for g in grams if g in model.grams]
                if known:
                    row = [sum(float(k[j]) for k in known) / len(known) for j in range(len(row))]
                    break
        total = [a + b for a, b in zip(total, row)]
    mean = [x / len(words) for x in total]
    best = max(range(len(mean)), key=lambda j: (mean[j], -j))
    power = min(20, len(words))
    return model.langs[best], 1 / sum(np.exp((x - mean[best]) * power) for x in mean)


def test_language_against_a_plain_scorer(spark):
    rng = random.Random(15)
    langs = {"aa": "uvo xen pil grat", "bb": "ösk hamm trub lind uvo", "cc": "zyw qoj kyx vuq"}
    pairs = [(" ".join(rng.choice(langs[k].split()) + rng.choice(["", "en", "is"]) for _ in range(12)), k) for k in langs for _ in range(40)]
    model = language_id.learn(pairs)
    counts = {k: Counter(w for t, lang in pairs if lang == k for w in t.split()) for k in langs}
    for w in ("uvo", "xenen", "kyxis"):  # log frequencies by language, an absent word as half a one
        want = [np.log(max(counts[k][w], 0.5) / sum(counts[k].values())) for k in sorted(langs)]
        assert np.allclose(model.logs[model.words[w]], want, atol=1e-5)
    texts = ODD_TEXTS + [t for t, _ in pairs[::7]] + [" ".join(rng.choice("uvoxen hammlind zywqo pilpil ösken q é".split()) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in language_id.identify(df, model).collect():
        lang, share = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - share) < 1e-5


def plain_toxicity(model, text):
    """Every window of every filter by itself."""
    ids = toxicity.ids_of(text, toxicity.Buckets())
    most = max(toxicity.WIDTHS) - 1
    padded, z, at = ids + [0] * (2 * most), float(model.out_bias), 0
    for f, b in zip(model.filters, model.bias):
        for c in range(toxicity.FILTERS):
            windows = [sum(float(model.emb[padded[p + j]] @ f[j][:, c]) for j in range(len(f))) for p in range(len(ids) + most)]
            z += max(0.0, max(windows) + float(b[c])) * float(model.out[at])
            at += 1
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    votes = sum((model.votes[i].astype(float) for i in ids), np.zeros(model.votes.shape[1]))
    cut = model.cuts[int(np.argmax(votes))]
    return toxicity.THRESHOLD * p / cut if p < cut else toxicity.THRESHOLD + (1 - toxicity.THRESHOLD) * (p - cut) / (1 - cut)


def test_toxicity_against_a_plain_scorer(spark):
    rng = random.Random(16)
    rows = [(prose(rng, 20) + (" vile fool" if k % 3 == 0 else "") + f" {prose(rng, 10)}", int(k % 3 == 0), ("en", "de")[k % 2]) for k in range(200)]
    model = toxicity.learn(rows)
    texts = ODD_TEXTS + [t for t, _, _ in rows[::5]] + ["vile", "fool vile", prose(rng, 1) + " vile fool"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in toxicity.score(df, model).collect():
        assert abs(r.score - plain_toxicity(model, texts[r.doc_id])) < 1e-4


def plain_quality(text):
    """The features, character by character."""
    t = text or ""
    words, size, lines = t.split(), len(t.encode("utf-8", "replace")), t.split("\n")
    if not words:
        return [0.0] * quality.FEATURES
    def some(of):
        return sum(c in of for c in t)
    upper, lower, n = some("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), some("abcdefghijklmnopqrstuvwxyz"), len(words)
    beyond = size - sum(ord(c) < 128 for c in t)
    log = np.log1p
    return [
        upper / max(1, upper + lower + beyond / 2), some("0123456789") / size, some(quality.SYMBOLS.decode()) / size, some(",.") / n, some(".") / n, beyond / size, log(n), size / n / 10,
        len(set(words)) / n, 1 - len(set(lines)) / len(lines), log(n / len(lines)), some(" ") / n, some("?") / n, sum(w.endswith((".", "!", "?")) for w in lines) / len(lines), min(1, 20 / n),
    ]


def test_quality_against_a_plain_scorer(spark):
    rng = random.Random(17)
    rows = [((prose(rng, 30 + k % 20) + ".") if k % 3 else " ".join(w + rng.choice(["$", "#", ""]) for w in [rng.choice(WORDS)] * 30), int(k % 3 > 0), "en") for k in range(240)]
    model = quality.learn(rows)
    x, y = np.array([plain_quality(t) for t, _, _ in rows]), np.array([q for _, q, _ in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    strength = ((x - mean) / scale) @ model.weights
    gaps = strength[y == 1][:, None] - strength[y == 0][None]  # all pairs, not the drawn ones
    assert np.log1p(np.exp(-gaps)).mean() < 0.05 and (gaps > 0).mean() > 0.99
    texts = ODD_TEXTS + [t for t, _, _ in rows[::5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in quality.score(df, model).collect():
        s = float((((np.array(plain_quality(texts[r.doc_id])) - mean) / scale) * model.weights).sum())
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(s - model.cut + np.log(0.3 / 0.7), -30, 30)))) < 1e-6


CLASHES = "fingerprint edited_fingerprint near_next component_id n_shingles labels base_labels n_words score sampled probability weight topic tokens start length offset sequence_id doc_tokens n_lines n_dropped lang_pred held_out _hash _size _gone _stay rank key bucket n count next".split()


@pytest.mark.parametrize("name", ["digest", "join", "licenses", "mix", "dedup", "pack", "identify", "toxicity", "quality"])
def test_clashing_columns_and_repeated_rows(spark, docs, empty, name, tmp_path):
    """Columns named as those an operator adds change nothing, repeated rows are rows, the result can be written."""
    from kindred.llm.queries import default_tokenizer

    texts = [("aa", "uvo xen pil"), ("bb", "ösk hamm trub")] * 4
    model = language_id.learn(texts)
    run = {
        "digest": winnowing.digest, "join": lambda d: ngram_join.join(d, 3, 90), "licenses": licenses.digest, "mix": mixing.mix, "dedup": line_dedup.dedup,
        "pack": lambda d: packing.pack(d, default_tokenizer()), "identify": lambda d: language_id.identify(d, model), "toxicity": lambda d: toxicity.score(d, None), "quality": lambda d: quality.score(d, None),
    }[name]
    rows = docs.union(docs.where("doc_id % 4 = 0"))
    more = rows.select("*", *(F.lit("clash").alias(c) for c in CLASHES))

    def result(d, path):
        out = run(d)
        out = out.select(*[c for c in plain if c in out.columns]) if (plain := names) else out
        out.write.parquet(str(tmp_path / path))
        return Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / path)).collect())

    names = run(rows).columns
    want, got = result(rows, "plain"), result(more, "more")
    assert want == got and sum(want.values()) >= (rows.count() if name != "pack" else 1)
    assert run(empty.select("*", *(F.lit("clash").alias(c) for c in CLASHES))).count() == 0


def test_labelled_sample_keeps_the_fold(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "en") for k in range(60)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1, None) for k in range(60)] + [(None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {int(t[1:]) for t, _, _ in common.labelled_sample(docs, labels, "quality", 5, 0, 1000)}
    assert got == {k for k in range(60) if zlib.crc32(str(k).encode()) % 5 != 0}


def test_rake_and_calibrate():
    import pandas as pd

    rng = np.random.default_rng(7)
    cells = pd.DataFrame([(a, b, rng.integers(1, 99)) for a in "xyz" for b in "uv"], columns=["source", "lang", "tokens"])
    goal = {"source": {"x": 0.5, "y": 0.3, "z": 0.2}, "lang": {"u": 0.6, "v": 0.4}}
    w = mixing.rake(cells, goal)
    for d in goal:
        share = (w * cells.tokens).groupby(cells[d]).sum() / (w * cells.tokens).sum()
        assert share.to_dict() == pytest.approx(goal[d])
    p = mixing.calibrate(cells.tokens.to_numpy(float), w, 0.6)
    assert p.max() <= 1 and (p * cells.tokens).sum() == pytest.approx(0.6 * cells.tokens.sum())


def test_mix(docs, empty):
    rows = mixing.mix(docs.withColumn("weight", F.lit("clash")), budget=0.5).collect()
    assert len(rows) == docs.count() and {r.sampled for r in rows} == {True, False}
    assert all(0 <= r.probability <= 1 and 0 <= r.topic < mixing.TOPICS for r in rows) and len({r.topic for r in rows}) > 1
    for r in docs.collect():
        own = next(x for x in rows if x.doc_id == r.doc_id)
        assert own.n_tokens == len(ngram_join.words_of(r.text))  # words between ASCII white space
    assert all(r.sampled for r in mixing.mix(docs, budget=1.0).collect()) and mixing.mix(empty).count() == 0


def balanced_topics():
    """The fullest of eight groups of hash buckets: topics of about one size, in all sources."""
    centers = np.zeros((8, mixing.TERMS))
    centers[np.arange(mixing.TERMS) % 8, np.arange(mixing.TERMS)] = 1
    return mixing.Topics(np.ones(mixing.TERMS), centers)


def test_mix_rakes_every_source(spark):
    """More than 64 sources, named and not, and one each called null and other beside a null one."""
    rng = random.Random(3)
    names = [f"s{k:03}" for k in range(90)] + ["other", "null", None]
    rows = [(i * 97 + k, prose(rng, 5 + k % 7), "en", x) for k, x in enumerate(names) for i in range(1 + (k < 64))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = {"source": {"s000": 3.0, "s089": 2.0, None: 1.0, "s001": 0.0}}
    got = [mixing.mix(df, budget=0.1, targets=targets, most_cells=n, topics=balanced_topics()).collect() for n in (mixing.CELLS, 0)]  # on the driver, as a table
    tokens = Counter()
    for r in got[0]:
        tokens[r.source] += r.n_tokens
    tempered = {x: n**0.7 for x, n in tokens.items()}
    share = {x: v / sum(tempered.values()) for x, v in tempered.items()}
    rest = sum(share[x] for x in targets["source"])
    want = {x: rest * targets["source"][x] / 6.0 if x in targets["source"] else share[x] for x in share}
    for rows in got:
        now = Counter()
        for r in rows:
            now[r.source] += r.weight * r.n_tokens
        total = sum(now.values())
        assert {x: now[x] / total for x in names} == pytest.approx(want, abs=1e-5)
        assert sum(r.probability * r.n_tokens for r in rows) == pytest.approx(0.1 * sum(tokens.values()), rel=1e-5)
        assert {r.source for r in rows if r.probability == 0} == {"s001"}
    assert {r.doc_id: r.probability for r in got[1]} == pytest.approx({r.doc_id: r.probability for r in got[0]}, abs=1e-5)


def test_caps_keep_the_marginals(spark):
    """Where probabilities are capped, the marginals still hold, on the driver and as a table."""
    rng = random.Random(9)
    rows = [(i, prose(rng, 20), rng.choice("uuuuuv"), rng.choice("xxxxyyz")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    every = []
    for n in (mixing.CELLS, 0):
        got = mixing.mix(df, budget=0.7, temper=0.8, most_cells=n, topics=balanced_topics()).collect()
        every.append({r.doc_id: r.probability for r in got})
        assert max(every[-1].values()) == pytest.approx(1.0) and len(set(every[-1].values())) > 3
        for of in (lambda r: r.source, lambda r: r.lang, lambda r: r.topic):
            tokens, expected = Counter(), Counter()
            for r in got:
                tokens[of(r)] += r.n_tokens
                expected[of(r)] += r.probability * r.n_tokens
            total, tempered = sum(tokens.values()), sum(t**0.8 for t in tokens.values())
            want = {k: 0.7 * total * t**0.8 / tempered for k, t in tokens.items()}
            assert all(want[k] <= t for k, t in tokens.items())  # can be met
            assert dict(expected) == pytest.approx(want, rel=1e-4)
    assert every[1] == pytest.approx(every[0], abs=1e-4)


def test_topics_part_subjects(spark):
    """Texts of three vocabularies fall into clusters of their own, whatever common words they share; equal texts together."""
    rng = random.Random(17)
    common_words = [prose(rng, 1) + "ation" for _ in range(20)]
    subjects = [[f"{rng.choice(WORDS)}{rng.choice(WORDS)}{x}" for _ in range(30)] for x in "xyz"]
    rows = [(k, " ".join(rng.choice(subjects[k % 3] if rng.random() < 0.5 else common_words) for _ in range(40))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    topics = mixing.learn_topics(df, topics=3)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "a b c"), (1003, rows[0][1])], "doc_id bigint, text string")
    got = {r.doc_id: (r.topic, r.n_tokens) for r in mixing.with_topics(df.union(odd), topics).collect()}
    met = Counter((k % 3, got[k][0]) for k in range(300))
    assert len({t for _, t in met}) == 3 and sum(max(met[s, t] for t in range(3)) for s in range(3)) >= 290
    assert [got[k][1] for k in range(300)] == [40] * 300 and [got[k] for k in (1000, 1001, 1002)] == [(0, 0), (0, 0), (0, 3)] and got[1003] == got[0]


def test_sample_meets_the_marginals(spark):
    """The documents that are sampled, not only the expected ones, have the target shares of each source."""
    rng = random.Random(18)
    rows = [(i, prose(rng, rng.randint(5, 40)), "en", rng.choice("aaaaaabbc")) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    goal = {"a": 0.3, "b": 0.3, "c": 0.4}
    kept, tokens = Counter(), Counter()
    for r in mixing.mix(df, budget=0.25, targets={"source": goal}).collect():
        tokens[r.source] += r.n_tokens
        kept[r.source] += r.n_tokens * r.sampled
    total = sum(tokens.values())
    assert sum(kept.values()) == pytest.approx(0.25 * total, rel=0.06)
    for x, share in goal.items():
        assert kept[x] / sum(kept.values()) == pytest.approx(share, abs=0.03)


def test_patterns_hold_the_demand():
    rng = np.random.default_rng(8)
    for _ in range(5):
        demand = {int(s): int(d) for s, d in zip(range(1, 65), rng.integers(0, 60, 64))}
        plan, held = packing.patterns(demand), Counter()
        for pattern, times in plan:
            assert sum(s * a for s, a in pattern.items()) <= 64
            for s, a in pattern.items():
                held[s] += a * times
        assert held == Counter({s: d for s, d in demand.items() if d})
        # a proven lower bound (Martello and Toth's L2)
        count = lambda ok: sum(d for s, d in demand.items() if ok(s))
        least = max(count(lambda s: s > 64 - k) + max(count(lambda s: 32 < s <= 64 - k), -(-sum(s * d for s, d in demand.items() if k <= s <= 64 - k) // 64)) for k in range(33))
        assert sum(t for _, t in plan) <= 1.005 * least + 2


def test_pack(docs, empty):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for capacity in (4096, 256):
        rows = packing.pack(docs, path, capacity=capacity).collect()
        texts, pieces, sequences = {r.doc_id: r.text for r in docs.collect()}, defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        assert set(pieces) == set(texts)
        for i, ps in pieces.items():
            ids, at = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4"), 0
            for r in sorted(ps, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        for ps in sequences.values():
            at = 0
            for r in sorted(ps, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at == capacity or (at < capacity and at & (at - 1) == 0)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(name):
    """Word by word through a small cache; a tokenizer that keeps white space is run on whole texts."""
    import pyarrow as pa

    path = pytest.importorskip("public_tokenizers").path(name)
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(path), packing.Encoder(path, most=400), random.Random(9)
    assert e.by_word == (name == "word_bpe_49k.json")
    texts = ["It's a dog's... we've!! x²³ a,b.c é̀. x　y <|endoftext|> z", "\x1ca b", "", None, " \n", "%%%a!!b??", "Straße, ÀÉ. 1,234.5", "İstanbul ΑΣ ǅ ﬁ", "a\u2028b\u0085c\u200bd \u0301e"]
    texts += ["".join(rng.choice("ab' .,!é1ßÉ́² -s t'll") for _ in range(60)) for _ in range(300)]
    end = np.array([2, 3], e.kind)
    for some in (texts[:50], texts[50:51], texts[51:], [], [None]):
        ids, starts = e.encode(pa.array([None, *some], pa.string())[1:], end)
        for k, x in enumerate(some):
            assert ids[starts[k] : starts[k + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2, 3]
        assert len(starts) == len(some) + 1 and starts[-1] == len(ids)


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline as P

    docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    rows, n = common.table(spark, str(tmp_path), "documents"), docs.count()
    for name, stage in P.STAGES:
        rows = common.stored(stage(spark, rows, str(tmp_path)), "t")
        if name != P.STAGES[-1][0]:
            assert rows.columns == list(common.DOCUMENT_COLUMNS) and rows.count() <= n
            n = rows.count()
            if name == "n-gram Jaccard join":
                got = plain_components([(r.doc_id, r.text) for r in rows.collect()], 5, 80)
                assert all(i == c for i, (_, c) in got.items())
    assert rows.select("doc_id").distinct().count() == n
    assert P.run(spark, str(tmp_path)).count() == rows.count()


def beyond_sample(spark, most, total, seed):
    """The ids below total that a sample of `most` rows by this seed would leave out."""
    share = common.hashed_share(F.col("id"), seed)
    return {r.id for r in spark.range(total).where(share >= most / total).collect()}


def test_quality_learns_from_every_labelled_row(spark, tmp_path):
    """Label 0 is only in rows that a sample of 4,000 leaves out."""
    from kindred.llm.queries import op4_quality

    rng, learned = random.Random(31), {k for k in range(6000) if zlib.crc32(str(k).encode()) % 5 != 0}
    bad = beyond_sample(spark, 4000 * 6000 / len(learned), 6000, 7) & learned
    assert len(bad) > 500
    rows = [(k, prose(rng, 12) if k not in bad else " ".join(w + "$$" for w in prose(rng, 12).split())) for k in range(6000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k not in bad)) for k in range(6000)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op4_quality(spark, str(tmp_path)).collect()}
    assert len(got) == 6000 and sum(got[k].predicted == (k not in bad) for k in got) >= 5950


def test_quality_fit_is_learn_over_a_table(spark, empty):
    """However the table is split; gradient and curvature are those of plain sums over all pairs."""
    rng = random.Random(32)
    rows = [((prose(rng, 20 + k % 30) + ".") if rng.random() < 0.6 + 0.3 * (k % 3 > 0) else " ".join(w + rng.choice(["$", ""]) for w in prose(rng, 25).split()), int(k % 3 > 0), "") for k in range(200)]
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y, _) in enumerate(rows)] + [(None, 0), (5, None)], "doc_id bigint, quality int")
    want = quality.learn([r for k, r in enumerate(rows) if zlib.crc32(str(k).encode()) % 5 != 0])
    for n in (1, 4):
        got = quality.fit(quality.featured(df.repartition(n)), labels, "quality", 5, 0)
        assert (got.mean == want.mean).all() and (got.scale == want.scale).all() and (got.weights == want.weights).all() and got.cut == want.cut
    assert quality.fit(quality.featured(empty), labels, "quality", 5, 0) is None
    x = np.array([quality.features(t) for t, _, _ in rows])
    z, y = (x - want.mean) / want.scale, np.array([y for _, y, _ in rows])
    for w in (np.zeros(quality.FEATURES), want.weights / 2, want.weights):
        pairs = quality.Pairs(quality.tally(np.rint(z * quality.UNIT).astype(np.int64), y, w), w)
        d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, quality.FEATURES)
        wrong = 1 / (1 + np.exp(d @ w))
        assert pairs.loss == pytest.approx(np.log1p(np.exp(-(d @ w))).mean() + 5e-4 * (w @ w), abs=1e-3)
        assert np.allclose(pairs.gradient, -(d * wrong[:, None]).mean(axis=0) + 1e-3 * w, atol=2e-3)
        assert np.allclose(pairs.curve, (d * (wrong * (1 - wrong))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), atol=0.03)


def test_topics_are_learned_from_every_text(spark):
    """One vocabulary is only in texts that a sample of 2,000 leaves out; its words and its cluster are known all the same."""
    rng, late = random.Random(33), beyond_sample(spark, 2000, 3000, 23)
    subjects = [[f"{rng.choice(WORDS)}{rng.choice(WORDS)}{x}" for _ in range(30)] for x in "xyz"]
    kind = {k: 2 if k in late and k % 2 else k % 4 // 2 for k in range(3000)}
    rows = [(k, " ".join(rng.choice(subjects[kind[k]]) for _ in range(20))) for k in range(3000)]
    df = spark.createDataFrame(rows + [(3001, None), (3002, ""), (3003, "a b")], "doc_id bigint, text string")
    topics = [mixing.learn_topics(df.repartition(n), topics=3) for n in (1, 4)]
    holders = Counter(b for _, t in rows for b in {zlib.crc32(w.encode()) % mixing.TERMS for w in t.split()})
    assert np.allclose(topics[0].rare, [np.log(3001 / (holders[b] + 1)) + 1e-3 for b in range(mixing.TERMS)])
    assert np.allclose(topics[0].centers, topics[1].centers)
    met = Counter((kind[r.doc_id], r.topic) for r in mixing.with_topics(df, topics[0]).where("doc_id < 3000").collect())
    assert len({t for _, t in met}) == 3 and all(max(met[s, t] for t in range(3)) >= 0.97 * sum(met[s, t] for t in range(3)) for s in range(3))


def test_packed_counts():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (40, mixing.TERMS)) * (rng.random((40, 1)) < 0.8) * rng.choice([1, 1 << 33], (40, mixing.TERMS))
    got = mixing.packed(counts.astype(float))
    assert (mixing.unpacked(got) == counts).all() and (mixing.unpacked(got.slice(7, 11)) == counts[7:18]).all() and mixing.unpacked(got.slice(40)).shape == (0, mixing.TERMS)


def test_stored_drops_what_finished_steps_left(spark):
    """Plans and broadcasts in cycles go when a table is stored, not whenever the collector happens to run."""
    import gc
    import weakref

    class Held:
        pass

    x = Held()
    x.own, gone = x, weakref.ref(x)
    gc.disable()
    try:
        del x
        getattr(common, "HELD_BACK", {}).clear()
        common.forget(common.stored(spark.range(3), "three"))
        assert gone() is None
    finally:
        gc.enable()
    ids = spark.range(500).select(F.xxhash64("id").alias("h"))
    held = common.bit_filter(ids, "h", bits=14)
    assert common.may_hold(held, np.array([r.h for r in ids.collect()])).all()
