"""HTML extraction, token files, token attribution, line quality, PII, decontamination, substring dedup, Jaccard join."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, base_figures, base_spans, contamination, corpus, frame, prose, repeats, similar

from auditlens.llm import kernels as K


def clashing(spark, rows):
    """The corpus with extra columns named like the operators' own ones."""
    from pyspark.sql import functions as F
    return frame(spark, rows).withColumns({c: F.lit("x") for c in ("kept", "n_words", "k1", "node", "shard", "start", "__row", "at", "row")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- kernels ----------------------------------------------------------------

def test_words_match_the_plain_pattern():
    from helpers import WORD
    texts = ["a b", "", "  x\t\ty\x0bz ", "é ñ😀 \xa0q", "last", "\n", "one two"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    hashes, starts, ends, bounds = K.words_of(data, offsets, 0, len(texts))
    got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [WORD.findall(t) for t in texts]
    assert len(set(hashes)) == len({w for t in got for w in t})


def test_long_text_hashes_like_short_ones(monkeypatch):
    words = [f"w{i % 97}é" for i in range(5000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    whole = K.hash_words(data, np.array([0, len(data)]))[2]
    monkeypatch.setattr(K, "CHUNK_BYTES", 100)
    assert (K.hash_words(data, np.array([0, len(data)]))[2] == whole).all()


# -- 1 html -----------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav><!-- x > y -->
<div class="cookie-notice">We use cookies, a lot of them, and this text is long.</div><aside>Side text that is long as well</aside>
<article><h1>Head &amp; title</h1><p><b>First para<br>line two &nbsp; end.<p>Second &lt;para&gt; with <a href=y>a link</a> inside.</p>
<form>Your name <input></form><ul><li>One<li>Two</ul><div class="comments"><p>Great post! Long comment here, very long indeed.</p></div></article>
<div id="sidebar"><p>Related things to read, quite a few words here.</p></div><footer>&copy; somebody</footer></body></html>"""


def test_article_text():
    from auditlens.llm.html_extract import main_text
    assert main_text(PAGE).split("\n\n") == ["Head & title", "First para line two end.", "Second <para> with a link inside.", "One", "Two"]


def test_density_picks_the_text_without_marked_article():
    from auditlens.llm.html_extract import main_text
    body = "".join(f"<p>{prose(random.Random(i), 40)}</p>" for i in range(4))
    links = "<div>" + "".join(f"<span><a href=/{i}>short {i}</a></span>" for i in range(30)) + "</div>"
    got = main_text(f"<body>{links}<div><h2>Title</h2>{body}</div>{links}</body>")
    assert got.startswith("Title\n\n") and "short" not in got and got.count("\n\n") == 4


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<div><div>", "</p></div>", "<script>never closed", "<!-- never closed", "<p>" * 3000 + "x"])
def test_odd_html_does_not_fail(html):
    from auditlens.llm.html_extract import main_text
    assert isinstance(main_text(html), str)


ARTICLE = "<article><h1>Title</h1><p>First paragraph of some length.</p><p>Second paragraph, longer than the first one.</p></article>"


@pytest.mark.parametrize("name", ["layout with-sidebar", "post comments-open", "no-menu-page", "page-header", "alert-text", "social-history",
                                  "sidebar", "comments", "cookie-notice", "widget"])
def test_names_never_drop_the_article(name):
    """Brute force: every element around and in the article takes the name, as class or id; the text stays the same."""
    import re

    from auditlens.llm.html_extract import main_text
    want = ["Title", "First paragraph of some length.", "Second paragraph, longer than the first one."]
    page = f"<body><nav><a href=/>Home</a></nav><div><section>{ARTICLE}</section></div><footer>f</footer></body>"
    plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
    for html in (page, plain):
        assert main_text(html).split("\n\n") == want
        for at in re.finditer("<(div|section|article|h1|p)>", html):
            for attr in ("class", "id"):
                assert main_text(f"{html[:at.end() - 1]} {attr}='{name}'>{html[at.end():]}").split("\n\n") == want, (at, attr)


def test_partly_marked_section_stays_and_furniture_goes():
    from auditlens.llm.html_extract import main_text
    html = ARTICLE.replace("</article>", "<section class='social-history'><p>Aside fact.</p></section><div class='share'>Share it</div></article>")
    assert main_text(html).split("\n\n")[3:] == ["Aside fact."]
    titled = ARTICLE.replace("<h1>Title</h1>", "<div class='banner'><h2><a href=/>Title</a></h2></div>")
    assert main_text(titled).startswith("Title\n\nFirst")
    assert main_text(f"<body><div class='ad'>{prose(random.Random(1), 90)}</div>{ARTICLE}").startswith("Title\n\nFirst")  # beside the article
    assert main_text(f"<body><div class='widget'>{prose(random.Random(1), 90)}</div><p>x</p>").startswith(prose(random.Random(1), 90))


@pytest.mark.parametrize("start", ["<html><head><title>T</title></head><body>", "<html><head><title>T</title><body>", "<head><meta charset=x><title>T</title>",
                                   "<title>T</title><body>", "<title>T</title>", "<head><title>T</title><style>p{}</style><link rel=x><script>1</script>",
                                   "", "<body>", "<head>", "<head><noscript><div>pixel</div></noscript>", "<head><noscript><img src=x><body>"])
@pytest.mark.parametrize("end", ["", "</body></html>"])
def test_optional_head_and_body_tags(start, end):
    from auditlens.llm.html_extract import main_text
    assert main_text(start + ARTICLE + end).split("\n\n") == ["Title", "First paragraph of some length.", "Second paragraph, longer than the first one."]
    assert main_text(f"{start}Bare text of the page.{end}").endswith("Bare text of the page.")


def test_extract_rows(spark):
    from auditlens.llm.html_extract import extract_main_text
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    rows = extract_main_text(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == sorted([(1, len(rows[0].text)), (1, len(rows[0].text)), (2, 0), (0, 0)])
    assert extract_main_text(pages.limit(0)).count() == 0


# -- 2 and 6 tokens ---------------------------------------------------------

ODD_TEXTS = ["a  b", "\n\n x\n  y z ", " lead", "trail ", "it's ''s 'll", "a\xa0 b c  d", "", "x", "\t \n", "日本 語  テ", "a\x1c b", "<|endoftext|> a", "😀 é",
             "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|", "end. <|endoftext|>\n", "a\u2003 b\u3000  c", "f(x)=y_1;z's", "word,,word!,", "a" * 300, "\x85 b"]


def plain_tokenizer():
    from tokenizers import Tokenizer

    from auditlens.llm.tokenizing import tokenizer_path
    return Tokenizer.from_file(tokenizer_path())


def test_cached_pieces_give_the_ids_of_whole_texts():
    from auditlens.llm.tokenizing import PieceEncoder, tokenizer_path
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice([" ", "\n", "a", "'s", "é", ".", "12", "\t"]) for _ in range(60)) for _ in range(200)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in plain_tokenizer().encode_batch(texts, add_special_tokens=False)]
    enc = PieceEncoder(tokenizer_path())
    assert enc.encode(texts) == want
    assert enc.encode(texts[::-1]) == want[::-1]  # from the cache
    assert enc.count(pa.array([*texts, None])).tolist() == [len(w) // 4 for w in want] + [0]
    assert enc.encode([]) == [] and enc.encode(["", ""]) == [b"", b""]


def test_texts_without_spaces_do_not_fill_the_cache(monkeypatch):
    """Kept pieces are short and bounded by bytes; what is not kept encodes to the same ids."""
    from auditlens.llm import tokenizing as T
    enc, rng = T.PieceEncoder(T.tokenizer_path()), random.Random(3)
    long = ["".join(rng.choice("日本語テキスト0123456789abcdef") for _ in range(5000)) for _ in range(40)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in plain_tokenizer().encode_batch(long, add_special_tokens=False)]
    assert enc.encode(long) == want and enc.encode(long) == want
    assert enc.cache_bytes() < 10_000 and len(enc.ids) < 8 * sum(len(w) // 4 for w in want) + (1 << 17)
    monkeypatch.setattr(T, "CACHE_BYTES", 200_000)
    words = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(500)) for _ in range(20)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in plain_tokenizer().encode_batch(words, add_special_tokens=False)]
    for text, ids in zip(words, want, strict=True):
        assert enc.encode([text]) == [ids]
        assert enc.cache_bytes() < 200_000 + 500 * 400


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    from auditlens.llm.token_files import pack_chunk, unpack_chunk
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000, 1001, 5000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        payload, sizes = pack_chunk(ids, planes, block=1000)
        assert (unpack_chunk(payload, sizes, n, planes, block=1000) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(spark, planes, tmp_path):
    from auditlens.llm.token_files import chunk_index, read_token_files, write_token_files
    rows = corpus() + [(None, "no id"), (3, "again three")] + list(enumerate(ODD_TEXTS, 500))
    path = f"file://{tmp_path}/ids"
    write_token_files(clashing(spark, rows), path, planes=planes, block=512, chunk=2000)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in read_token_files(spark, path, digest_only=False).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (at, doc, n, crc, ids), (want, text), e in zip(got, order, plain_tokenizer().encode_batch([t or "" for _, t in order], add_special_tokens=False), strict=True):
        full = e.ids + [2]
        assert (at, doc, n, ids) == (start, want, len(full), full)
        assert crc == zlib.crc32(np.asarray(full, "<u4").tobytes())
        start += n
    index = chunk_index(spark, path).orderBy("first").collect()
    assert index[0]["first"] == 0 and sum(r.n_ids for r in index) == start
    write_token_files(empty(spark), f"{path}-empty")
    assert read_token_files(spark, f"{path}-empty").count() == 0


def test_many_texts_of_one_id_are_several_shards(spark, tmp_path):
    from auditlens.llm.token_files import read_token_files, write_token_files
    rows = [(7 if i % 2 else None, f"text {i} " + prose(random.Random(i), 20)) for i in range(400)]
    path = f"file://{tmp_path}/ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few bytes: they would be one partition
    try:
        write_token_files(frame(spark, rows), path, chunk=200)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    shards = {r.shard: r.n for r in spark.read.parquet(path).groupBy("shard").agg({"n_ids": "sum"}).toDF("shard", "n").collect()}
    assert len(shards) >= 4 and max(shards.values()) < sum(shards.values()) / 2
    got = [r.ids for r in sorted(read_token_files(spark, path, digest_only=False).collect(), key=lambda r: r.start)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [e.ids + [2] for e in plain_tokenizer().encode_batch([t for _, t in order], add_special_tokens=False)]


def test_attribution_against_a_loop_over_tokens(spark):
    """Majority by bytes, token by token, from the library's own offsets of pieces."""
    from auditlens.llm.token_attribution import count_tokens
    from auditlens.llm.tokenizing import PieceEncoder, tokenizer_path
    sizes = PieceEncoder(tokenizer_path()).byte_lengths()
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS + ["one\ntwo é\n\n  three\r\nfour 😀\n", "a\n\n\nb"]) if t]
    got = {(r.doc_id, r.section): r.n_tokens for r in count_tokens(frame(spark, rows)).collect()}
    for i, text in rows:
        lines, want = text.encode().split(b"\n"), Counter()
        bounds = np.cumsum([0] + [len(x) + 1 for x in lines])
        bounds[-1] = len(text.encode())
        if len(bounds) > 2 and bounds[-1] == bounds[-2]:
            bounds = bounds[:-1]
        at = 0
        for token in plain_tokenizer().encode(text, add_special_tokens=False).ids:
            share = [max(0, min(at + sizes[token], b) - max(at, a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            want[int(np.argmax(share))] += 1
            at += sizes[token]
        assert {s: n for (d, s), n in got.items() if d == i and n} == dict(want), text


def test_attribution_rules(spark):
    from auditlens.llm.token_attribution import attribute, count_tokens
    ends, bounds = np.array([2, 6, 7]), np.array([0, 3, 7])
    assert attribute(ends, bounds, "start").tolist() == [2, 1]      # 2..6 begins in the first section
    assert attribute(ends, bounds, "majority").tolist() == [1, 2]   # three of its four bytes are in the second
    assert attribute(np.array([4]), np.array([0, 2, 4]), "majority").tolist() == [1, 0]  # a tie goes to the earlier one
    rows = corpus() + list(enumerate(ODD_TEXTS, 500)) + [(None, "no id"), (3, "again")]
    got = count_tokens(clashing(spark, rows)).collect()
    total = sum(len(e.ids) for e in plain_tokenizer().encode_batch([t or "" for _, t in rows], add_special_tokens=False))
    assert sum(r.n_tokens for r in got) == total
    text = dict(rows)[300]
    lines = [(r.char_start, r.char_end) for r in sorted((r for r in got if r.doc_id == 300), key=lambda r: r.section)]
    assert [text[a:b] for a, b in lines] == text.splitlines(keepends=True)
    assert count_tokens(empty(spark)).count() == 0


def test_attribution_to_given_spans(spark):
    from auditlens.llm.token_attribution import count_tokens
    df = spark.createDataFrame([(1, "title é body text", [(0, 5), (8, 17)]), (2, "ab", []), (3, None, None)],
                               "doc_id long, text string, spans array<struct<start:long,end:long>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in count_tokens(df, spans="spans").collect()}
    n = [len(e.ids) for e in plain_tokenizer().encode_batch(["title é body text", "ab"], add_special_tokens=False)]
    assert got[1, 0] == 1 and sum(v for (d, _), v in got.items() if d == 1) == n[0] and got[2, None] == n[1] and (3, 0) not in got


# -- 4 substring dedup ------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_windows_go(spark, seed):
    from auditlens.llm.substring_dedup import remove_repeats
    rows = corpus(seed)
    got = {r.doc_id: r for r in remove_repeats(clashing(spark, rows)).collect()}
    for doc, (n, gone, kept) in repeats(rows).items():
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept_sha256) == (n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()), doc
    assert sum(r.n_removed for r in got.values()) > 1000


def test_substring_dedup_odd_rows(spark):
    from auditlens.llm.substring_dedup import remove_repeats
    text = prose(random.Random(3), 120)
    got = remove_repeats(frame(spark, [(5, text), (5, text), (7, text), (None, text), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (-1, 0), (5, 0), (5, 0), (7, 120)]
    assert remove_repeats(empty(spark)).count() == 0


# -- 5 line quality ---------------------------------------------------------

def labelled(seed=1, n=60):
    rng, rows = random.Random(seed), []
    for i in range(n):
        good = "\n".join(f"{prose(rng, 12).capitalize()}." for _ in range(6))
        bad = "\n".join(" | ".join(f"{w.upper()}$$" for w in prose(rng, 12).split()) for _ in range(6))
        rows += [(2 * i, good, 1), (2 * i + 1, bad, 0)]
    return rows


def test_quality_figures_and_verdict(spark):
    from auditlens.llm.line_quality import judge_documents, keep_documents
    train = labelled()
    rows = corpus() + [(1000 + i, t) for i, t, _ in labelled(9)] + [(None, "a\na\n" * 30)] + [(900, "#*$%&|<> x\nx\nx\n \nx")]
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in train] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = clashing(spark, [(i, t) for i, t, _ in train]).unionByName(clashing(spark, [(i + 10_000 if i is not None else None, t) for i, t in rows]))
    got = {r.doc_id: r for r in judge_documents(docs, labels).collect()}
    for i, t in rows:
        r, want = got[i + 10_000 if i is not None else None], base_figures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    held_out = [(got[11_000 + i].kept, q) for i, _, q in labelled(9) if not got[11_000 + i].base_failed]
    assert sum(k == bool(q) for k, q in held_out) / len(held_out) > 0.95
    kept = keep_documents(docs, docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in judge_documents(docs, labels).collect())


def test_quality_without_labels(spark):
    from auditlens.llm.line_quality import judge_documents
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in judge_documents(frame(spark, [(1, prose(random.Random(1), 50)), (2, "short"), (3, None)]), none).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert judge_documents(empty(spark), none).count() == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    from auditlens.llm.line_quality import EDGES, WIDTH, LineModel, viterbi
    rng = np.random.default_rng(2)
    model = LineModel(np.zeros((len(EDGES), WIDTH)), rng.normal(size=2), rng.normal(size=(2, 2)))
    emissions, bounds = rng.normal(size=18), np.array([0, 5, 5, 6, 18])
    got = viterbi(model, emissions, bounds)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        def score(path, a=a):
            return model.start[path[0]] + sum(emissions[a + t] * y for t, y in enumerate(path)) + sum(model.step[x, y] for x, y in zip(path, path[1:], strict=False))
        if b > a:
            assert tuple(got[a:b]) == max(product((0, 1), repeat=b - a), key=score)


# -- 7 jaccard join ---------------------------------------------------------

@pytest.mark.parametrize("block", [1500, 4])
def test_links_and_groups(spark, block):
    from auditlens.llm.jaccard_join import similar_documents
    rows = [r for r in corpus() if r[0] != 406]
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar_documents(clashing(spark, rows), block=block).collect()}
    assert got == {r[0]: w for r, w in zip(rows, similar(rows), strict=True)}


def test_band_count_meets_the_recall():
    from auditlens.llm.jaccard_join import bands_for
    for rows in (2, 4, 6):
        b = bands_for(0.8, rows, 0.9999)
        assert 1 - (1 - 0.8**rows) ** b >= 0.9999 > 1 - (1 - 0.8**rows) ** (b - 1)


def test_jaccard_odd_rows_and_stage(spark):
    from auditlens.llm.jaccard_join import keep_one_per_group, similar_documents
    text = prose(random.Random(4), 60)
    df = clashing(spark, [(5, text), (5, text), (7, text + " more"), (None, text), (8, None), (9, ""), (10, "two words"), (11, "two words"), (12, "other thing")])
    got = sorted((r.doc_id or -1, r.class_id, r.n_links) for r in similar_documents(df).collect())
    assert got == [(-1, 5, 3), (5, 5, 3), (5, 5, 3), (7, 5, 3), (8, 8, 0), (9, 9, 0), (10, 10, 1), (11, 10, 1), (12, 12, 0)]
    kept = keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 5, 8, 9, 10, 12]
    assert similar_documents(empty(spark)).count() == 0


def test_one_row_per_group_under_repeated_and_null_ids(spark):
    from auditlens.llm.jaccard_join import keep_one_per_group
    a, b, c, d = (prose(random.Random(i), 60) for i in range(20, 24))
    rows = [(1, a), (2, a + " more"), (2, b),           # another text under the doc_id of a near copy stays
            (3, c), (3, c + " more"), (3, c), (4, c),   # different near copies under the least doc_id: one
            (None, d), (None, d + " more"), (None, d),  # copies without any doc_id: one
            (None, b), (None, b),                       # and one beside a named row
            (6, " "), (6, " "), (None, None), (None, None)]
    got = [(r.doc_id, r.text) for r in keep_one_per_group(clashing(spark, rows)).collect()]
    group = {t: n for n, x in enumerate((a, b, c, d)) for t in (x, x + " more")}
    assert sorted((i or 0, group.get(t, "-1" if t else "-2")) for i, t in got if t in group) == [(0, 1), (0, 3), (1, 0), (2, 1), (3, 2)]
    assert sorted((i or 0, t or "") for i, t in got if t not in group) == [(0, ""), (0, ""), (6, " "), (6, " ")]


# -- 8 personal data --------------------------------------------------------

PII_TEXTS = [
    "mail a.b+c@d-e.co.uk, x@y.z@w.v and a@b.c_x@d.e; no@domain @x.y a@b", "ip 10.0.0.1 1.2.3.4.5.6.7.8 999.1.1.1 256.1.1.1 000.00.0255.1 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 5500005555555559 12345678901234567890", "call +49 (170) 123-4567 or +1.2 or +12345678901234567 +1 23",
    "é😀 4111111111111111 ñ a@b.cd", "iban DE89 3704 0044 0532 0130 00 and DE89370400440532013001", "ssn 123-45-6789 and 123-45-6789" + " x" * 40 + " 123-45-6789",
    "9" * 30_000, "a." * 20_000 + "@", "+1" + " " * 20_000, "1-" * 20_000 + "1", "a@b" + ".c" * 20_000, "", None, "4111111111111111" * 2]


def test_pii_spans(spark):
    from auditlens.llm.pii import find_pii
    rows = list(enumerate(PII_TEXTS)) + [(None, PII_TEXTS[0]), (0, PII_TEXTS[0])]
    got = find_pii(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        want = base_spans(t)
        r = by[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t and t[:60]
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in ("email", "ip", "card", "phone")] == want
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in ("email:", "ip:", "card:", "phone:"))
    assert [s.split(":")[0] for s in by[5].spans.split(",")][-1] == "iban" and by[5].n_added == 1
    assert by[6].n_added == 1  # only the first number has a context word near
    assert find_pii(empty(spark)).count() == 0


IBANS = {"DE89370400440532013000 Please": (0, 22), "pay to DE89370400440532013000. BIC COBADEFFXXX.": (7, 29), "DE89370400440532013000 BIC COBADEFFXXX.": (0, 22),
         "GB82 WEST 1234 5698 7654 32 I agree": (0, 27), "DE89370400440532013000 2024": (0, 22), "DE89 3704 0044 0532 0130 00 AB 12 CD": (0, 27),
         "BE20 DE89 3704 0044 0532 0130 00 X": (5, 32),  # a false start does not hide the number behind it
         "x NO9386011117947 OK": (2, 17), "DE89370400440532013000A": None, "DE89 3704 0044 0532 0130": None, "DE8937040044053201300 0 Please": (0, 23),
         "DE89370400440532013001 Please": None}


def test_ibans_end_where_their_length_says(spark):
    from auditlens.llm.pii import find_pii, redact
    df = frame(spark, list(enumerate(IBANS)) + [(99, "DE89370400440532013000 GB82WEST12345698765432 DE89370400440532013000")])
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in find_pii(df).collect()}
    assert [got[i] for i in range(len(IBANS))] == [[f"iban:{at[0]}:{at[1]}"] if at else [] for at in IBANS.values()]
    assert got[99] == ["iban:0:22", "iban:23:45", "iban:46:68"]
    out = {r.doc_id: r.text for r in redact(df).collect()}
    assert out[0] == "[IBAN] Please" and out[3] == "[IBAN] I agree" and out[99] == "[IBAN] [IBAN] [IBAN]" and out[6] == "BE20 [IBAN] X"


def test_ibans_of_unlisted_countries_by_prefix(spark):
    from auditlens.llm.pii import IBAN_LENGTHS, find_pii

    def checked(code, bban):
        number = int("".join(str(int(c, 36)) for c in bban + code + "00"))
        return f"{code}{98 - number % 97:02}{bban}"

    rng = random.Random(3)
    texts = [checked(code, "".join(rng.choice("0123456789ABCDEFGH") for _ in range(n - 4))) for code, n in [*IBAN_LENGTHS.items(), ("ZZ", 15), ("ZZ", 23), ("XY", 34)]]
    got = {r.doc_id: r.spans for r in find_pii(frame(spark, [(i, f"é {t} Ab cd") for i, t in enumerate(texts)])).collect()}
    assert all(f"iban:2:{2 + len(t)}" in got[i] for i, t in enumerate(texts))


def test_redaction(spark):
    from auditlens.llm.pii import redact
    df = clashing(spark, list(enumerate(PII_TEXTS)))
    out = redact(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert all(not base_spans(t) for t in got.values())
    assert got[4] == "é😀 [CARD] ñ [EMAIL]" and got[13] is None and got[7] == PII_TEXTS[7]


# -- 9 decontamination ------------------------------------------------------

def test_item_windows_found(spark):
    from auditlens.llm.decontamination import drop_contaminated, find_contamination
    rng = random.Random(6)
    items = [(i, prose(rng, 25)) for i in range(8)] + [(20, "rare pair"), (21, ""), (22, None), (None, prose(rng, 12)), (23, prose(rng, 10)), (23, prose(rng, 10))]
    rows = [r for r in corpus() if r[0] != 406]
    rows += [(500 + i, f"{prose(rng, 20)}. {items[i % 8][1].upper().replace(' ', ', ')} {prose(rng, 9)}") for i in range(10)]
    rows += [(600, "a Rare-Pair here, rare, pair and rare"), (601, items[13][1]), (602, items[0][1]), (602, items[1][1]), (None, items[2][1]), (603, "rare")]
    docs, bench = clashing(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, kept string")
    want = contamination(rows, items)
    for limit in (1 << 20, 2_000):  # one block, many blocks
        got = find_contamination(docs, bench, limit=limit).collect()
        flat = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
        assert flat == sorted((-1 if i is None else i, n, h, len(it), hashlib.sha256(",".join(it).encode()).hexdigest(), h > 0)
                              for (i, _), (n, h, it) in zip(rows, want.values(), strict=True))
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(h == 0 for _, h, _ in want.values())
    assert find_contamination(empty(spark), bench).count() == 0
    assert not find_contamination(docs, bench.limit(0)).where("contaminated").count()


def test_repeats_with_many_texts_under_one_id_and_a_hot_passage(spark, monkeypatch):
    """A third of the rows share one doc_id, most rows one passage; rows of one id do not count as earlier than each other."""
    from auditlens.llm import substring_dedup as S
    rng = random.Random(12)
    passage, other = prose(rng, 90), prose(rng, 70)
    rows = [(7, f"{prose(rng, 30)} {passage} {prose(rng, 20)}") for _ in range(60)] + [(7, rows7) for rows7 in [f"{other} same"] * 3]
    rows += [(100 + i, f"{prose(rng, 10)} {passage if i % 4 else other} {prose(rng, 10)}") for i in range(100)] + [(3, other), (None, passage)]
    first, want = {}, []
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 49):
            if i is not None:
                key = tuple(w[p:p + 50])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w, gone = t.split(), set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p:p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for parts in (1000, 3):  # with the passage's keys broadcast, and dealt out
        monkeypatch.setattr(S, "HOT_PARTS", parts)
        got = S.remove_repeats(frame(spark, rows)).drop("kept_text").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_repeats_of_nothing(spark):
    from auditlens.llm.substring_dedup import remove_repeats
    assert remove_repeats(empty(spark)).count() == 0
    assert [r.n_removed for r in remove_repeats(frame(spark, [(1, "short"), (1, "short")])).collect()] == [0, 0]


# -- 1 html: forms, comments, brute-force densities ---------------------------------

COMMENT = "<p>Great post, I could not agree more with every single word of it, thank you so much for writing this.</p>"
BODY_TEXT = ["Title", "First paragraph of some length.", "Second paragraph, longer than the first one."]


def test_a_form_around_the_page_is_not_furniture():
    from auditlens.llm.html_extract import main_text
    paragraphs = "".join(f"<p>{prose(random.Random(i), 40)}</p>" for i in range(3))
    want = "\n\n".join(prose(random.Random(i), 40) for i in range(3))
    assert main_text(f"<body><form action='./default.aspx' id='aspnetForm'><input type=hidden value=x><div>{ARTICLE}</div></form></body>").split("\n\n") == BODY_TEXT
    assert main_text(f"<body><form id='form1'><div><h2>Head</h2>{paragraphs}</div><button>Send</button></form></body>") == "Head\n\n" + want
    assert main_text(f"<body><form id='form1'><div>{paragraphs}</div></form></body>") == want
    inner = "<form class='contact'><h3>Write to us</h3><p>Your message will be read by somebody.</p><input></form>"
    assert "Write" not in main_text(f"<body><div><h2>Head</h2>{paragraphs}</div>{inner}</body>")
    assert "Write" not in main_text(f"<body><article><h2>Head</h2>{paragraphs}{inner}</article></body>")


@pytest.mark.parametrize("name", ["comments", "comments-area", "comment-list", "disqus_thread", "post-comments"])
@pytest.mark.parametrize("item", ["{}", "<article class='comment'><h4>Somebody says</h4>{}</article>", "<article>{}</article>", "<ul><li class='comment-item'>{}</li></ul>"])
@pytest.mark.parametrize("many", [1, 30])
def test_reader_comments_go_whatever_their_size(name, item, many):
    from auditlens.llm.html_extract import main_text
    comments = f"<section id='{name}'><h3>Comments</h3>{''.join(item.format(COMMENT) for _ in range(many))}</section>"
    assert main_text(f"<body><div>{ARTICLE}{comments}</div></body>").split("\n\n") == BODY_TEXT
    assert main_text(f"<body><div>{ARTICLE.replace('</article>', comments + '</article>')}</div></body>").split("\n\n") == BODY_TEXT
    paragraphs = [prose(random.Random(i), 60) for i in range(4)]
    plain = "<h1>Head</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    assert main_text(f"<body><div class='post comments-open'>{plain}{comments}</div></body>").split("\n\n") == ["Head", *paragraphs]


def test_an_article_below_a_comment_name_stays():
    from auditlens.llm.html_extract import main_text
    inner = f"<div class='comments'>{COMMENT * 3}</div>"
    for page in (f"<div class='comment-page'>{ARTICLE}{inner}</div>", f"<div class='comment'>{ARTICLE.replace('</article>', inner + '</article>')}</div>"):
        assert main_text(f"<body>{page}</body>").split("\n\n") == BODY_TEXT
    assert main_text(f"<body><div class='comments'>{COMMENT}</div></body>") == COMMENT[3:-4]  # nothing else on the page
    code = "<pre>x = 1 <span class='comment'># why</span></pre>"
    assert "# why" in main_text(f"<body>{ARTICLE.replace('</article>', code + '</article>')}</body>")


def test_density_and_choice_by_brute_force():
    """Random unmarked pages: the subtree by its definition, from counts over whole subtrees."""
    import math

    from auditlens.llm import html_extract as H
    rng = random.Random(17)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["p", "a", "span", "div"]), [prose(rng, rng.randrange(0, 25))]
        return rng.choice(["div", "section", "span", "a"]) if depth < 4 else "div", [rng.choice([grow(depth - 1), prose(rng, rng.randrange(4))]) for _ in range(rng.randrange(1, 5))]

    def html(node):
        return node if isinstance(node, str) else f"<{node[0]}>{' '.join(map(html, node[1]))}</{node[0]}>"

    def walk(node):
        yield node
        for x in node.parts:
            if not isinstance(x, str):
                yield from walk(x)

    for _ in range(80):
        parser = H._Builder()
        parser.feed("<body>" + html(grow(5)) + "</body>")
        parser.close()
        nodes = parser.order
        body = next(n for n in nodes if n.tag == "body")

        def counts(n):
            text = lambda x, linked: sum(len("".join(p.split())) * (linked or not only) if isinstance(p, str) else text(p, linked or p.tag == "a") for p in x.parts)
            only = False
            chars = text(n, False)
            only = True
            links = text(n, n.tag == "a")
            below = [x for x in walk(n) if x is not n]
            return chars, links, len(below), sum(x.tag == "a" for x in below)

        facts = {n: counts(n) for n in nodes}
        total = facts[body]

        def density(n):
            c, lc, t, lt = facts[n]
            if not c:
                return 0.0
            base = math.log(c / max(1, c - lc) * lc + total[1] / max(1, total[0]) * c + math.e)
            inner = max(1.0, c / (lc or 1) * (t or 1) / (lt or 1))
            return c / (t or 1) * math.log(inner) / math.log(max(base, 1.0001)) if base > 1 else 0.0

        d = {n: density(n) for n in nodes}
        score = {n: sum(d[x] for x in n.parts if not isinstance(x, str)) for n in nodes}
        best = max(nodes, key=lambda n: score[n])
        if score[best] > 0:
            path, at = [best], best
            while at is not body and at.parent is not None:
                at = at.parent
                path.append(at)
            least = min(d[x] for i, x in enumerate(path) if i == 0 or d[x])
            best = max((n for n in nodes if d[n] >= least), key=lambda n: score[n])
        else:
            best = body
        assert H.main_text("<body>" + html_of(body) + "</body>") == "\n\n".join(H._blocks(best))


def html_of(body):
    return "".join(x if isinstance(x, str) else f"<{x.tag}>{html_of(x)}</{x.tag}>" for x in body.parts)


def test_rows_without_ids_meet_their_own_text_only(spark):
    """Classes of rows without a doc_id join one text each, not every such row."""
    from auditlens.llm import jaccard_join as J
    rng = random.Random(21)
    base = prose(rng, 60).split()
    near = []
    for i in range(30):
        w = list(base)
        w[i] = f"e{i}"
        near.append((None, " ".join(w)))
    rows = near + [(None, prose(rng, 60)) for _ in range(30)] + [(5, " ".join(base)), (5, prose(rng, 40))]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in J.similar_documents(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(((d, c, n) for (d, _), (c, n) in zip(rows, similar(rows), strict=True)), key=repr)
    docs = frame(spark, rows).select("doc_id", "text")
    signed = J.signatures(docs.withColumn("source", J._row_name()), 5, 5, 4, ("source",)).collect()
    assert len({(r.source.unnamed, r.source.id, r.source.t1, r.source.t2) for r in signed}) == len(rows)


def test_components_that_do_not_converge_raise(spark):
    from auditlens.llm.common import components
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long"), "t", max_rounds=1)


def test_the_training_sample_is_bounded_by_documents(spark, monkeypatch):
    """A labelled doc_id that stands for many rows is one training document."""
    from auditlens.llm import line_quality as Q
    rng = random.Random(2)
    rows = [(1, f"{prose(rng, 30)}\n{prose(rng, 30)}.") for _ in range(300)] + [(2, "### $$$ ||| ***\n" * 5 + str(i)) for i in range(300)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(Q, "train", lambda docs, marks, **k: seen.append(len(docs)))
    Q.fit(frame(spark, rows).select("doc_id", "text"), labels)
    assert seen == [2]


def _kept(rows, similar_rows):
    """One row a group, as the stage keeps them, for rows with distinct ids and texts with words."""
    return sorted(i for (i, _), (c, _) in zip(rows, similar_rows, strict=True) if i == c)


@pytest.mark.parametrize("block", [4, 1500])
def test_groups_by_representatives_lose_no_link(spark, block):
    """Chains of edits (the ends are not alike), a large group around one text, and groups beside it."""
    from auditlens.llm.jaccard_join import keep_one_per_group
    rng = random.Random(41)
    rows, base = [], prose(rng, 90, 4000).split()
    for i in range(60):  # a chain: each differs from the one before by a word, neighbours are alike, the ends are not
        base = list(base)
        base[i] = f"chain{i}"
        rows.append((i, " ".join(base)))
    hub = prose(rng, 100, 4000).split()
    for i in range(40):
        w = list(hub)
        w[2 * i] = f"edit{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, prose(rng, 80, 4000)) for i in range(20)]
    rng.shuffle(rows)
    want = _kept(rows, similar(rows))
    got = sorted(r.doc_id for r in keep_one_per_group(frame(spark, rows), block=block).collect())
    assert got == want


def test_rows_verified_grow_in_line_with_a_hot_group(spark):
    """One group of near copies of one text: pairs checked per member stay the same."""
    from pyspark.sql import functions as F

    from auditlens.llm import jaccard_join as J
    checked = []
    for m in (80, 240):
        rng = random.Random(5)
        hub = prose(rng, 400, 4000).split()
        rows = []
        for i in range(m):
            w = list(hub)
            w[i] = f"edit{i}"
            rows.append((i, " ".join(w)))
        docs = frame(spark, rows).select("doc_id", "text").withColumn("source", J._row_name())
        signed = J.signatures(docs, 5, J.bands_for(), J.ROWS, ("doc_id", "source")).withColumn("k", F.struct("k1", "k2"))
        classes = signed.groupBy("k").agg(F.min("source").alias("source"), F.count("*").alias("copies"), F.first("bands").alias("bands")).persist()
        stars = J._stars(classes.select("k", F.posexplode("bands").alias("band", "h")))
        checked.append(stars.count())
        connected = J.connect_classes(docs, classes, 0.8, 5, 20)
        assert connected.where("node <> root").select("node").distinct().count() >= m - 1
        # nothing was left for the blocks: every row is a verified star
        assert connected.count() <= stars.count()
        classes.unpersist()
    assert checked[1] / 240 < 1.5 * checked[0] / 80
