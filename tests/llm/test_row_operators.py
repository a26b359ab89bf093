"""URL filters, HTML extraction, language ID, SentencePiece, packing and top-k against brute force."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyspark.llm import bit_sliced_topk, html_extract, language_id, packing, sentencepiece_codec, url_filter
from tallyspark.llm.queries import URL_RULES

SP_PATH = public_tokenizers.path("piece_bpe_32k.model")
BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, n_tokens string, rule string"
LONG = " ".join(f"wort{k % 977}" for k in range(60_000))
TEXTS = [None, "", " ", "Hello, world! It's fine.\nBye.", "a", LONG, "é 日本 🙂 ﬁ <s> ▁x  y\t\x1cz", "same text here", "same text here"]


def documents(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "x", "y") for i, t in enumerate(texts)], DOCS)


# URL filters

URLS = [None, "", "no scheme", "http://NET", "http://a.net/x", "https://www.Example.NET/en/1?q#f", "http://example.net/english",
        "http://example.net/en", "http://notexample.net/", "x://example.com/de/1", "http://a.example.com/fr/", "http://org/fr/x",
        "http://a.b.org/fr", "http://net.org/fr/", "http://net:80/", "http://a.net?x/en/", "http://a..net/", "://net/", "http://ÄX.net/a"]


def slow_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, h, p in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (h.count("."), len(p), verdict == "allow")
            if best is None or rank > best[0]:
                best = rank, h + p, verdict
    return host, path, best[1] if best else None, best[2] if best else default


def test_url_rules(spark):
    rules = URL_RULES + [("block", "a.net", "/x"), ("allow", "example.net", "/en/1"), ("block", "example.com", "/"),
                         ("block", "org", "/fr/"), ("allow", "b.org", "/f")]
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(4, URLS[4])], "page_id long, url string")
    got = url_filter.judge_urls(pages, rules).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == slow_verdict(URLS[r.page_id], rules)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, [], default="block").collect()} == {"block"}


def test_pages_with_clashing_columns(spark):
    """Columns of a table that bear the names of results change nothing."""
    names = ["host", "path", "rule", "verdict", "text", "n_chars", "id", "value"]
    pages = [(k, u, f"<html><body><article><p>Page {k} of a book with a few words in it.</p></article></body></html>" if k % 3 else None)
             for k, u in enumerate(URLS)]
    plain = spark.createDataFrame(pages, "page_id long, url string, html string")
    odd = spark.createDataFrame([(*p, *([f"no {p[0]}"] * len(names))) for p in pages],
                                "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    for run in (lambda t: url_filter.judge_urls(t, URL_RULES).select("page_id", "host", "path", "rule", "verdict"),
                lambda t: html_extract.extract_main_text(t).select("page_id", "url", "text", "n_chars")):
        assert sorted(map(str, run(odd).collect())) == sorted(map(str, run(plain).collect()))
        assert run(odd.limit(0)).count() == 0


def test_url_rules_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RULES_PER_BLOCK", 1)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for r in url_filter.judge_urls(pages, URL_RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == slow_verdict(URLS[r.page_id], URL_RULES)


# HTML extraction

BODY = "<p>First  &amp; foremost, a long sentence stands here, with commas.</p><p><b>Second.<br><p>Third one, longer than that; really."
WANT = "First & foremost, a long sentence stands here, with commas.\nSecond.\nThird one, longer than that; really."


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a>Menu</a></li></ul></nav><article>{BODY}</article><footer>F</footer></body></html>",
    f"<html><head><title>T</title><body><header>Site, name.</header><div class='sidebar'>Side, bar.</div><div id=main>{BODY}</div><div class=\"comments\"><p>Nice, text!</p></div>",
    f"<body><script>var a='</p>';</script><!-- <p>no</p> --><div class='cookie-notice'>We use, cookies.</div><main>{BODY}<form><p>Mail, please.</p></form><aside>Ad.</aside></main>",
    f"<article>{BODY}<div class='ad'>Buy, now, this, thing, here, it, is, cheap.</div></article>",
])
def test_main_text(page):
    assert html_extract.main_text(page) == WANT


def test_html_edges(spark):
    pages = [None, "", "plain text only", "<p>unclosed", "<", "<!-- open", "<script>x", "<a title=\"x > y\">in</a> text", "&lt;b&gt; &#228;&nbsp;x"]
    rows = spark.createDataFrame([(i, "u", p, 7) for i, p in enumerate(pages)] + [(2, "u", pages[2], 7)],
                                 "page_id long, url string, html string, n_chars int")
    got = html_extract.extract_main_text(rows).orderBy("page_id").collect()
    assert [r.text for r in got] == ["", "", "plain text only", "plain text only", "unclosed", "<", "", "", "in text", "<b> ä x"]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_main_text(rows.limit(0)).count() == 0
    long = "<article>" + "<p>Some words, and more of them, here.</p>" * 20_000 + "</article>"
    assert html_extract.main_text(long).count("\n") == 19_999


def test_pages_keep_their_article(spark, sf):
    """Held against the pages' own article element."""
    import html
    import re
    rows = html_extract.extract_main_text(spark.read.parquet(f"{sf}/pages.parquet"), keep=("page_id", "html")).collect()
    for r in rows:
        inner = re.sub(r"<br>|</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


LEAD = "A lead of one sentence, set before the body of this page."
LONG_BODY = "".join(f"<p>Paragraph {k} of the long text, which goes on, and on; it ends here.</p>" for k in range(12))
LONG_WANT = "\n".join(f"Paragraph {k} of the long text, which goes on, and on; it ends here." for k in range(12))
SHORT = "<p>A section of its own, with a sentence, or two; no more than that.</p>"
SHORT_WANT = "A section of its own, with a sentence, or two; no more than that."


@pytest.mark.parametrize("page, want", [
    (f"<nav>Menu</nav><article><h1>Title</h1><p>{LEAD}</p><div class=body>{LONG_BODY}</div></article><footer>F</footer>",
     f"Title\n{LEAD}\n{LONG_WANT}"),
    (f"<main><section><h2>One</h2>{LONG_BODY}</section><section><h2>Two</h2>{SHORT}</section></main>", f"One\n{LONG_WANT}\nTwo\n{SHORT_WANT}"),
    (f"<article><div class=a>{SHORT}</div><blockquote>{LONG_BODY}</blockquote><p>End.</p></article>", f"{SHORT_WANT}\n{LONG_WANT}\nEnd."),
    (f"<body><div>Home Shop Contact</div><h1>Title</h1><div class=top>{SHORT}</div><div class=body>{LONG_BODY}</div><div class=last>{SHORT}"
     "</div><div>Copyright 2020.</div>", f"Title\n{SHORT_WANT}\n{LONG_WANT}\n{SHORT_WANT}"),
    (f"<div>Home Shop</div><table><tr><td>{SHORT}</td></tr><tr><td class=x>{LONG_BODY}</td></tr></table>", f"{SHORT_WANT}\n{LONG_WANT}"),
])
def test_nothing_of_the_article_is_dropped(page, want):
    assert html_extract.main_text(page) == want


# Language ID

def test_languages_of_long_texts_only(spark):
    """Languages whose labelled texts are all long, labelled rows without an id, copies of one text."""
    german, english = "der die das und nicht mit auch sich ", "the and of with from that this have "
    train = [(None, german * 400 + f"nummer{k} " * 5, "de") for k in range(20)] + [(k, english * 400 + f"number{k} ", "en") for k in range(20)]
    train += [(None, "le la les des une avec pour dans ", "fr")] * 3000
    train += [(None, f"le chat et le chien sont dans la maison avec des enfants {k}", "fr") for k in range(900)]
    labelled = spark.createDataFrame([(i, t, k, "x", "y") for i, t, k in train], DOCS)
    found = language_id.dictionaries(labelled, "doc_id", "text", "lang")
    assert set(found) == {"de", "en", "fr"} and b"chien" in found["fr"]
    assert found["fr"].count(b"le la les") == 1 or found["fr"].count(b"le la les") == 0
    got = language_id.identify(documents(spark, [german, english, german * 3000]), labelled).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["de", "en", "de"]
    sample = language_id.sampled(labelled, "doc_id", "text", "lang")
    assert max(len(texts) for texts in sample.values()) <= language_id.SAMPLE_PER_LANGUAGE
    assert max(len(t) for texts in sample.values() for t in texts) <= language_id.SAMPLE_CHARS


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = language_id.held_out(docs["doc_id"])
    got = {r.doc_id: r for r in language_id.identify(docs, docs.where(~held)).collect()}
    rows = docs.where(held & docs["lang"].isNotNull()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    texts = [None, "", "123 !? ...", "der die das und nicht", "the and of with from", LONG, "²½ ٣"]
    train = [("der die das und nicht mit auch sich " * 3, "de"), ("the and of with from that this have " * 3, "en")]
    labelled = spark.createDataFrame([(100 + i, t, k, "x", "y") for i, (t, k) in enumerate(train * 40)] + [(1, None, "fr", "", ""), (2, "x", None, "", "")], DOCS)
    got = [r.lang_pred for r in language_id.identify(documents(spark, texts), labelled).orderBy("doc_id").collect()]
    assert got[:5] == ["und", "und", "und", "de", "en"] and got[6] == "und"
    kept = [r.doc_id for r in language_id.keep_certain(documents(spark, texts), labelled).collect()]
    assert {3, 4} <= set(kept) and not {0, 1, 2, 6} & set(kept)
    nothing = language_id.identify(documents(spark, texts), labelled.limit(0)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(texts)
    assert language_id.identify(documents(spark, texts).limit(0), labelled).count() == 0


# SentencePiece

ALPHABET = ["▁", " ", "  ", "\n", "\t", "a", "er", "the", "ing", "é", "ß", "日", "本", "ﬁ", "🙂", "́", "<s>", ".", ",", "!!", "1", "23", "\x00",
            "\x85", "　", "The", "tion", "##", "&&", "ccc", "((", "<0x41>"]


def test_codec_equals_library(sf):
    import pyarrow.parquet as pq
    codec = sentencepiece_codec.load(SP_PATH)
    model = sentencepiece.SentencePieceProcessor(model_file=SP_PATH)
    draw = random.Random(5)
    texts = pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()[:150]
    texts += ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(15))) for _ in range(3000)] + [t for t in TEXTS if t is not None]
    for t in texts:
        ids = model.encode(t, add_bos=True, add_eos=True)
        packed, decoded = codec.encode_packed(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids and decoded == model.decode(ids) and codec.decode(ids) == decoded


def test_codec_rows(spark, monkeypatch):
    got = sentencepiece_codec.encode_documents(documents(spark, TEXTS), SP_PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got[:2]] == [2, 2] and got[7][1:] == got[8][1:] and len(got) == len(TEXTS)
    assert sentencepiece_codec.encode_documents(documents(spark, TEXTS).limit(0), SP_PATH).count() == 0
    small = sentencepiece_codec.Codec(SP_PATH)
    monkeypatch.setattr(sentencepiece_codec, "CACHE_ENTRIES", 50)  # caches that keep being emptied change nothing
    assert small.encode_packed(LONG) == sentencepiece_codec.load(SP_PATH).encode_packed(LONG)


def test_codec_keeps_text_only_where_it_differs(monkeypatch):
    """Units that decode to themselves are kept once, so twice as many fit; the bound holds."""
    codec = sentencepiece_codec.Codec(SP_PATH)
    assert codec.encode_packed("plain words, \U0001F642 and a\n\ttab")[1] == "plain words, \U0001F642 and a\n\ttab"
    assert codec.packed and not codec.decoded and not codec.atom_ids.keys() & codec.packed.keys() - {"\n"}
    monkeypatch.setattr(sentencepiece_codec, "CACHE_ENTRIES", 50)
    for k in range(300):
        codec.encode_packed(f"word{k} of w{k * k}")
        assert len(codec.packed) <= 100


# Packing

def slow_cut(places, costs, window):
    best, back = [0.0], [0]
    for j in range(1, len(places)):
        options = []
        for i in range(j):
            n = places[j] - places[i]
            if n <= window:
                options.append((best[i] + (0 if n & (n - 1) == 0 else window - n), i))
        value, i = min(options, key=lambda o: o[0])
        best.append(value + costs[j])
        back.append(i)
    return best[-1]


def total_cost(places, costs, cuts, window):
    value, i = 0.0, 0
    for j in cuts:
        n = places[j] - places[i]
        assert n <= window
        value += (0 if n & (n - 1) == 0 else window - n) + costs[j]
        i = j
    return value


def test_cut_is_optimal():
    draw = random.Random(3)
    for _ in range(200):
        places = np.cumsum([0] + [draw.randrange(1, 20) for _ in range(draw.randrange(1, 40))])
        costs = np.array([draw.choice([0.0, 3.0, 9.0]) for _ in places])
        cuts = packing.cut(places, costs, 32)
        assert cuts[-1] == len(places) - 1
        assert abs(total_cost(places.tolist(), costs, cuts, 32) - slow_cut(places.tolist(), costs, 32)) < 1e-6


def check_pieces(rows, ids_of):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, want in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    padding = 0
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding


def test_packing_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(TEXTS, 10**6)), "doc_id long, text string"))
    library = Tokenizer.from_file(BPE_PATH)
    library.encode_special_tokens = True
    want = {r.doc_id: (library.encode(r.text, add_special_tokens=False).ids if r.text else []) + [1] for r in docs.collect()}
    padding = check_pieces(packing.pack_documents(docs, BPE_PATH).collect(), want)
    assert padding <= 0.03 * sum(map(len, want.values()))
    assert packing.pack_documents(docs.limit(0), BPE_PATH).count() == 0


def test_encoder_equals_library():
    library = Tokenizer.from_file(BPE_PATH)
    library.encode_special_tokens = True
    draw, encoder = random.Random(2), packing.load(BPE_PATH)
    alphabet = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "er", "'s", "'", "the", "é", "日", "1", "23", "!", "##", "<|endoftext|>", "\x00", "　"]
    for _ in range(3000):
        t = "".join(draw.choice(alphabet) for _ in range(draw.randrange(12)))
        assert encoder.ids(t)[:-1].tolist() == library.encode(t, add_special_tokens=False).ids


def test_added_tokens_are_one_id(spark):
    """The library as it is, without a switch."""
    library = Tokenizer.from_file(BPE_PATH)
    draw, encoder = random.Random(6), packing.load(BPE_PATH)
    alphabet = [" ", "  ", "\n", "\t", "a", "er", "'s", "the", "é", "日", "12", "!", "<|", "|>", "<|endoftext|>", "<|endoftext|>"]
    texts = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(12))) for _ in range(2000)]
    for t in texts:
        assert encoder.whole_ids(t)[:-1].tolist() == library.encode(t, add_special_tokens=False).ids
    want = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    check_pieces(packing.pack_documents(documents(spark, texts), BPE_PATH).collect(), want)


def test_stretches_do_not_change_what_is_packed():
    draw = random.Random(4)
    ends = np.array([False, False, False, True])
    docs = [(i, np.array([draw.randrange(4) for _ in range(draw.choice([1, 5, 300]))], "<u4")) for i in range(400)]
    for stretch in (200, 1000, 10**6):
        pieces = list(packing.shard_pieces(iter(docs), ends, 1, window=32, stretch=stretch))
        at = dict.fromkeys(range(400), 0)
        for doc, start, length, _, total, _, _ in pieces:
            assert start == at[doc] and total == len(docs[doc][1])
            at[doc] += length
        assert all(at[i] == len(x) for i, x in docs)


# Exact top-k

def slow_top_k(rows, k, every):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, dims", [(0.3, 8), (40.0, 3), (0.001, 5), (0.0, 2)])
def test_top_k(spark, scale, dims):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(size=dims) * scale).tolist()) for i in range(700)]
    rows += [(900 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2010, [None] * dims), (2020, [float("nan")] * dims), (2030, [float("inf")] * dims), (2040, []),
             (2050, [1.0] * (dims + 1)), (2060, [2.0] * (dims + 1)), (None, rows[0][1])]
    vectors = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    want = slow_top_k(rows, 10, 10)
    assert sorted(map(tuple, bit_sliced_topk.top_k(vectors, every=10).collect())) == want
    assert sorted(map(tuple, bit_sliced_topk.top_k(vectors, every=10, queries_per_block=20).collect())) == want


def test_top_k_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert bit_sliced_topk.top_k(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.5]), (1, [1e30, -1e30]), (2, [0.0, 0.0])], schema)
    assert [(r["rank"], r.vec_id) for r in bit_sliced_topk.top_k(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_top_k_beyond_the_index(spark):
    """Components of 1e5 to 1e12, alone and among small ones; scores that leave the range of a long."""
    draw = np.random.default_rng(4)
    rows = [(i, (draw.normal(size=5) * 10.0 ** draw.choice([0, 2, 5, 6, 12], p=[.4, .2, .2, .1, .1])).tolist()) for i in range(400)]
    rows += [(500 + i, rows[i][1]) for i in range(30)] + [(1000, [100000.0] + [0.0] * 4), (1001, [200000.0] + [0.0] * 4)]
    want = []
    for q, x in rows:
        if q % 10:
            continue
        scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(x, y)))), i)
                  for i, y in rows if i != q]
        best = sorted(scores, key=lambda s: (-s[0], s[1]))[:10]
        want += [(q, k, i, s) for k, (s, i) in enumerate(best, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, bit_sliced_topk.top_k(vectors, every=10).collect())) == sorted(want)
    assert sorted(map(tuple, bit_sliced_topk.top_k(vectors, every=10, queries_per_block=15).collect())) == sorted(want)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [100000.0, 0.0]), (2, [200000.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in bit_sliced_topk.top_k(few).orderBy("rank").collect()] == [
        (2, 209_715_200_000), (1, 104_857_600_000)]


SENTENCE = "This is a sentence of the article, with commas, and it goes on for a while. " * 3


@pytest.mark.parametrize("page, want", [
    ('<div class="page sidebar-right"><article><p>{}</p></article><div class="sidebar">no</div></div>', ["{}"]),
    ('<div class="left-nav-layout"><main><p>{}</p></main></div>', ["{}"]),
    ('<article><p title="a hidden gem">{}</p></article>', ["{}"]),
    ('<article><p>{0}</p><p class="related-work">{0}</p><li class="menu-item">{0}</li><p class="search-method">{0}</p></article>', ["{0}"] * 4),
    ('<article><p>{} x <span class="ad"><span>Buy</span> ADVERT</span> y.</p></article>', ["{} x y."]),
    ('<article><p>{} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>', ["{} x=2 holds."]),
    ('<body><article><p>Short one.</p></article><div><p>{0}</p><p>{0}</p></div></body>', ["Short one."]),
    ('<article><p hidden>no</p><p aria-hidden=true>no</p><p style="display: none">no</p><p>{}</p><div class="related-posts"><p>no</p></div></article>',
     ["{}"]),
    ('<div class="menu">no</div><div class="comments"><article><p>{0}</p></article></div><article><p>{0}</p></article>', ["{}"]),
])
def test_names_do_not_cost_article_text(page, want):
    assert html_extract.main_text(page.format(SENTENCE)) == "\n".join(w.format(SENTENCE.strip()) for w in want)
