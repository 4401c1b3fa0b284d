"""Small corpora with odd rows, and plain brute-force versions of the operators."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents from (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(rng, n, vocabulary=600):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=40):
    """Originals, exact and near copies, a passage that many share, and odd rows."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.randrange(60, 200))) for i in range(n)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(15)]
    for i in range(15):
        words = rows[7][1].split()
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, f"{prose(rng, 30)}\n{passage} {prose(rng, 30)}") for i in range(10)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "ab ab"), (405, "x " * 3000), (406, prose(rng, 20_000)),
             (407, "same"), (408, "same"), (409, "Ünï ✓ 漢字 😀 word " * 20)]
    return rows


def repeats(rows, window=50):
    """{doc_id: (n_words, n_removed, kept words)} for unique doc_ids."""
    first, out, texts = {}, {}, sorted((i, WORD.findall(t or "")) for i, t in rows)
    for i, w in texts:
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), i)
    for i, w in texts:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = len(w), len(gone), [x for p, x in enumerate(w) if p not in gone]
    return out


def base_figures(text):
    """Base figures of the quality rules."""
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def similar(rows, size=5, threshold=0.8):
    """[(class_id, n_links)] by row."""
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    where, root, links = defaultdict(list), list(range(len(rows))), [0] * len(rows)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in where[g] if j > i)
        for j, k in common.items():
            if 10 * k >= round(10 * threshold) * (len(s) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [(least.get(find(i)), links[i]) for i in range(len(rows))]


def contamination(rows, items, size=10):
    """{row number: (n_words, n_hit, sorted item ids)}."""
    windows = defaultdict(set)
    for item, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        if w:
            for i in range(max(1, len(w) - size + 1)):
                windows[tuple(w[i:i + size])].add(item)
    lengths, out = {len(k) for k in windows}, {}
    for row, (_, t) in enumerate(rows):
        w, hit, found = BENCH_WORD.findall((t or "").translate(LOWER)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out[row] = len(w), len(hit), sorted(str(x) for x in found if x is not None)
    return out


def digits(m):
    return re.sub("[^0-9]", "", m)


def luhn(x):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PLAIN for m in re.finditer(p, text or "") if ok(m.group())]
