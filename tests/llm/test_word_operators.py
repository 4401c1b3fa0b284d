"""Periodic runs, spelling variants, language mixtures: brute force, odd rows, held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, LOWER, WORD, corpus, frame, prose

EDGE = [(None, "no id here no id here"), (7001, None), (7002, ""), (7003, " \n\t "), (7004, "12 34 !! 😀"), (7005, "same text"), (7005, "same text"),
        (7006, "loop " * 5000), (7007, "a b c " * 3000 + "d " + "a b c " * 3000), (7008, prose(random.Random(5), 30_000))]


def clashing(spark, rows):
    from pyspark.sql import functions as F
    return frame(spark, rows).withColumns({c: F.lit("x") for c in ("runs", "word", "n", "form", "root", "n_words", "best", "letters", "held_out", "score", "bucket")})


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- 11 runs ------------------------------------------------------------------

def runs_of(w, least):
    """All runs by trying every period: (start, length, period)."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x + q < len(w):
            if w[x] == w[x + q]:
                y = x
                while y + q < len(w) and w[y] == w[y + q]:
                    y += 1
                if y + q - x >= max(least, 2 * q):
                    found.setdefault((x, y + q), q)
                x = y
            x += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def found_runs(texts, least):
    from auditlens.llm.periodic_runs import find_runs
    bounds = np.cumsum([0] + [len(w) for w in texts])
    out = [[] for _ in texts]
    for s, e, q in zip(*find_runs(np.array(list(itertools.chain(*texts)), np.int64), bounds, least), strict=True):
        d = int(np.searchsorted(bounds, s, side="right")) - 1
        out[d].append((s - bounds[d], e - s, q))
    return [sorted((int(s), int(n), int(q)) for s, n, q in x) for x in out]


def test_every_binary_word_up_to_13():
    for n in range(14):
        words = [list(x) for x in itertools.product([0, 1], repeat=n)]
        for w, got in zip(words, found_runs(words, 2), strict=True):
            assert got == runs_of(w, 2), w


def _periodic_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(200))]
    if kind == 1:  # Fibonacci word: many overlapping runs
        a, b = [0], [0, 1]
        while len(b) < 250:
            a, b = b, b + a
        i = rng.randrange(40)
        return b[i:i + rng.randrange(250)]
    if kind == 2:
        out = []
        while len(out) < 200:
            p = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
            out += (p * 30)[:rng.randrange(1, 80)]
        return out
    p = [rng.randrange(2) for _ in range(rng.randrange(1, 6))]  # runs inside the period of a run
    out = (p * 30)[:rng.randrange(5, 70)] * rng.randrange(2, 5)
    for _ in range(rng.randrange(3)):
        out[rng.randrange(len(out))] = 7
    return out


def test_runs_of_periodic_words():
    rng = random.Random(3)
    for _ in range(200):
        words = [_periodic_words(rng) for _ in range(4)]
        for least in (2, 12):
            for w, got in zip(words, found_runs(words, least), strict=True):
                assert got == runs_of(w, least), w


def run_digest_of(doc, text):
    w = WORD.findall(text or "")
    if doc is not None and w and (h := zlib.crc32(str(doc).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = runs_of(w, 12)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    return (doc, len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_run_digest_against_brute_force(spark):
    from auditlens.llm.periodic_runs import run_digest
    rng = random.Random(9)
    rows = [r for r in corpus(n=60) if len(r[1] or "") < 20_000] + [r for r in EDGE if len(r[1] or "") < 20_000]
    rows += [(500 + i, " ".join(f"w{x}é" for x in _periodic_words(rng))) for i in range(60)] + [(600, "a\tb\x0bc\nd " * 9 + "\xa0 z")]
    got = run_digest(clashing(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert plain(got) == sorted((run_digest_of(*r) for r in rows), key=repr)
    assert run_digest(spark.createDataFrame([], DOCS)).collect() == []


def test_long_texts(spark):
    from auditlens.llm.periodic_runs import periodic_runs
    got = {r["doc_id"]: r for r in periodic_runs(frame(spark, EDGE)).collect()}
    assert [tuple(r) for r in got[7006]["runs"]] == [(0, 5000, 1)] and got[7006]["collapsed"] == "loop"
    assert [tuple(r) for r in got[7007]["runs"]] == [(0, 9000, 3), (9001, 9000, 3)]
    assert got[7001]["runs"] == [] and got[7001]["collapsed"] == "" and got[7008]["n_words"] == 30_000


# -- 12 spelling variants -------------------------------------------------------

def variants_of(rows, alphabet_word=re.compile("[A-Za-zÀ-ÿ]+")):
    count = Counter()
    for doc, text in rows:
        for w in alphabet_word.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    v = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(set)
    for a, b in itertools.combinations(v, 2):
        if abs(len(a) - len(b)) > 1 or not close(a, b):
            continue
        near[a].add(b)
        near[b].add(a)
    form = {}
    for w, n in v.items():
        top = min(((-v[x], x) for x in near[w]), default=None)
        form[w] = top[1] if top and -top[0] >= 5 * n else None
    out = []
    for w, n in v.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), v[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def close(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def words_with_variants(seed=2, n=25):
    """Words with edits at every place, chains of forms, ties and equal letters in a row."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(6, 10))) for _ in range(n)] + ["aaaaaaa", "aaaaaab", "bookkeeper", "ÀÀÀÀÀÀÀ", "×÷ÿÿßß"]
    out = []
    for w in base:
        out += [w] * rng.choice([5, 30, 200])
        for _ in range(4):
            i = rng.randrange(len(w))
            x = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcÿà") + w[i:], w[:i] + rng.choice("abzÀÿ") + w[i + 1:]])
            out += [x] * rng.choice([4, 5, 6, 25])
    for w, k in (("chaining", 625), ("chainind", 125), ("chaininx", 25), ("chainixx", 5), ("CHAINING", 3), ("tieword", 40), ("tiewora", 40), ("tieworz", 8)):
        out += [w] * k
    rng.shuffle(out)
    return [(i, " ".join(out[i * 20:i * 20 + 20])) for i in range(-(-len(out) // 20))]


@pytest.mark.parametrize("small", [False, True])
def test_variants_against_all_pairs(spark, monkeypatch, small):
    from auditlens.llm import spelling_variants as S
    if small:  # several shards a length and several rounds
        monkeypatch.setattr(S, "SHARD_BYTES", 64)
        monkeypatch.setattr(S, "ROUND_BYTES", 256)
        monkeypatch.setattr(S, "EDITS", 400)
    rows = words_with_variants() + [r for r in EDGE if len(r[1] or "") < 50_000] + [(None, None), (8000, "longest" * 400 + " ")] + [(8001, "longest" * 400)] * 6
    got = S.variant_groups(clashing(spark, rows).repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert plain(got) == variants_of(rows)
    assert any(r["form"] and r["root"] != r["form"] for r in got.collect())


def test_variants_of_nothing(spark):
    from auditlens.llm.spelling_variants import variant_groups
    assert variant_groups(spark.createDataFrame([], DOCS)).collect() == []
    assert variant_groups(frame(spark, [(1, None), (2, "short one"), (3, "")])).collect() == []


def test_filter_has_no_false_negatives_and_few_false_positives():
    from auditlens.llm import spelling_variants as S
    rng = np.random.default_rng(1)
    keys, others = rng.integers(0, 2**63, 20_000).astype(np.uint64), rng.integers(0, 2**63, 200_000).astype(np.uint64)
    (plan,) = S._plan({8: len(keys)})
    shards, blocks, _ = plan[8]
    bits = np.zeros(8 * blocks, np.uint64)
    S._set(bits, S._split(keys, shards)[1])
    assert len(S._holds(bits, S._split(keys, shards)[1])) == len(keys)
    assert len(S._holds(bits, S._split(others, shards)[1])) < 0.01 * len(others)


def test_filter_rounds_hold_their_bound():
    from auditlens.llm import spelling_variants as S
    rounds = S._plan({n: 30_000_000 for n in range(6, 16)})
    assert len(rounds) > 1
    assert all(sum(64 * blocks * len(here) for _, blocks, here in r.values()) <= S.ROUND_BYTES for r in rounds)
    for length in range(6, 16):
        here = [s for r in rounds if length in r for s in r[length][2]]
        assert sorted(here) == list(range(len(here))) and all(r[length][0] == len(here) for r in rounds if length in r)


# -- 13 languages -----------------------------------------------------------------

#: Letters of three made-up languages.
TONGUES = {"xa": "abcdef ", "xb": "uvwxyz ", "xc": "дежзик "}


def tongue(rng, lang, n):
    return "".join(rng.choice(TONGUES[lang]) for _ in range(n)).strip() or TONGUES[lang][0]


def test_mixture_shares_by_em():
    """Proportions and likelihood against a plain EM over single n-grams."""
    from auditlens.llm.language_mixture import _mix
    rng = np.random.default_rng(4)
    p, c = rng.random((12, 3)), rng.integers(1, 5, 12).astype(float)
    doc, first = np.array([0] * 5 + [1] * 7), np.array([0, 5])
    share, ll = _mix(p, c, first, doc, np.full((2, 3), 1 / 3), 25)
    for d, (lo, hi) in enumerate([(0, 5), (5, 12)]):
        want = np.full(3, 1 / 3)
        for _ in range(25):
            mass = np.zeros(3)
            for i in range(lo, hi):
                mass += c[i] * want * p[i] / (want @ p[i])
            want = mass / mass.sum()
        assert np.allclose(share[d], want) and np.isclose(ll[d], sum(c[i] * np.log(want @ p[i]) for i in range(lo, hi)))


def test_languages_and_mixtures(spark, monkeypatch):
    from pyspark.sql import functions as F

    from auditlens.llm import language_mixture as L
    rng = random.Random(6)
    rows = [(i, tongue(rng, lang, rng.randrange(30, 400)), lang) for i in range(300) for lang in [rng.choice(list(TONGUES))]]
    mixed = [(1000 + i, tongue(rng, "xa", 300) + " " + tongue(rng, "xb", 150), None) for i in range(20)]
    odd = [(2000, None, "xa"), (2001, "", "xa"), (2002, " 12 !? 😀", "xb"), (None, "abc def", "xa"), (2003, "abcd", None), (2003, "abcd", None),
           (2004, tongue(rng, "xb", 200_000), "xb"), (2005, "漢字", None), (2006, "ABC DEF", None)]
    docs = spark.createDataFrame([(i, t, x) for i, t, x in rows + mixed + odd], "doc_id long, text string, lang string").withColumns(
        {c: F.lit("x") for c in ("letters", "held_out", "score", "n", "bucket")})
    got = L.identify_languages(docs.repartition(4))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "languages"]
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not r["languages"])
    assert sum(map(len, by.values())) == len(rows + mixed + odd)
    assert all(by[i][0]["lang_pred"] == lang and len(by[i][0]["languages"]) == 1 for i, _, lang in rows)
    for i, _, _ in mixed:
        assert [x["lang"] for x in by[i][0]["languages"]] == ["xa", "xb"] and 0.55 < by[i][0]["score"] < 0.8
    assert [by[i][0]["lang_pred"] for i in (2000, 2001, 2002)] == ["und"] * 3 and by[2000][0]["score"] == 0
    assert [r["lang_pred"] for r in by[2003]] == ["xa", "xa"] and by[2004][0]["lang_pred"] == "xb" and by[2006][0]["lang_pred"] == "xa"
    monkeypatch.setattr(L, "CELLS", 1000)  # small pieces give the same result
    assert {r["doc_id"]: r["lang_pred"] for r in L.identify_languages(docs).collect()} == {i: r[0]["lang_pred"] for i, r in by.items()}


def test_no_language_to_learn(spark):
    from auditlens.llm.language_mixture import identify_languages
    got = identify_languages(spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert identify_languages(spark.createDataFrame([], DOCS)).collect() == []


def test_prediction_reads_the_text_alone(spark):
    """Held-out rows: other labels, sources and ids of the same remainder change nothing."""
    from auditlens.llm.language_mixture import identify_languages
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    assert plain(identify_languages(docs)) == plain(identify_languages(other))


def test_held_out_accuracy(spark):
    from auditlens.llm.language_mixture import identify_languages
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
