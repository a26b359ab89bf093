"""Near, line and substring dedup, quality rules and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, perplexity, shingle_dedup, simhash_dedup, substring_dedup
from tallyspark.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, fingerprint string, n_words string, lines string, rank string"


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", "a", "b", "c", "d") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# Components

def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash

def slow_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(prints):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_fingerprints_and_groups(spark):
    draw = random.Random(7)
    base = [draw.choice(["alpha", "beta", "Gamma", "delta", "é", "日"]) + str(draw.randrange(40)) for _ in range(400)]
    texts = [None, "", " \t", "one", "One", "two words", "ONE TWO THREE", " ".join(base), " ".join(base).upper(), " ".join(base)]
    for k in range(30):
        words = list(base)
        words[draw.randrange(400)] = "changed"
        texts.append("\n".join(words))
    texts.append("word " * 50_000)
    ids = list(range(len(texts)))
    ids[4], ids[9] = None, 7  # a null id, a repeated id
    got = simhash_dedup.near_duplicates(documents(spark, texts, ids)).collect()
    prints = [slow_print(t) for t in texts]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{p:016x}") for i, p in zip(ids, prints, strict=True))
    roots = slow_roots(prints)
    least = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    for r in got:
        assert r.component_id == least.get(roots[int(r.fingerprint, 16)])
    assert simhash_dedup.near_duplicates(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("chunk, stretch", [(2048, 1 << 16), (64, 1 << 16), (16, 40)])
def test_index_finds_every_link(spark, monkeypatch, chunk, stretch):
    """Dense groups, small chunks that cut them, groups that go on in another task."""
    draw = random.Random(chunk)
    codes = {draw.getrandbits(64) for _ in range(300)}
    for centre in (0, (1 << 64) - 1, draw.getrandbits(64)):
        for _ in range(150):
            code = centre
            for _ in range(draw.randrange(1, 9)):
                code ^= 1 << draw.randrange(64)
            codes.add(code)
    monkeypatch.setattr(simhash_dedup, "CHUNK", chunk)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        found = connected_components(simhash_dedup.link_fingerprints(spark.createDataFrame(signed, "fp long").repartition(4))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in found}
    groups, want = {}, {}
    for c, r in slow_roots(list(codes)).items():
        groups.setdefault(got.get(c, c), set()).add(c)
        want.setdefault(r, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


# Near copies of the pipeline

def slow_similar(texts):
    """Components of Jaccard similarity >= 0.8 over five-word shingles, by all pairs."""
    sets = []
    for t in texts:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            x, y = sets[a], sets[b]
            if x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_near_copies_of_the_pipeline_stage(spark):
    """Changed words far beyond three bits; groups, copies, short and odd texts."""
    import corpus_pipeline
    draw = random.Random(11)
    texts = [None, "", " ", "one two", "One two", "one two three four five", "one two three four six"]
    for k in range(25):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([40, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(draw.randrange(1, 4)):
            words = list(base)
            for _ in range(max(1, len(base) // draw.choice([60, 50, 35, 20]))):
                words[draw.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts.append(texts[8].upper())
    root = slow_similar(texts)
    got = {r.doc_id: r.component_id for r in shingle_dedup.similar_documents(documents(spark, texts)).collect()}
    assert got == dict(enumerate(root))
    bits = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert sum(bits[i] == i for i in bits) > len(set(root))  # three bits leave near copies
    docs = documents(spark, texts).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1))
    assert {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == set(root)


def test_links_of_operator_4_are_judged_by_the_stage(spark, monkeypatch):
    """The stage takes the operator's links as candidates, keeps similar ones and no others."""
    import corpus_pipeline
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "changed"]), " ".join(base[:30]), "other words altogether", " ".join(base).upper(), None]
    docs = documents(spark, texts).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1)).unionByName(
        documents(spark, texts[:1]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit("s")).withColumn(
            "n_chars", F.lit(1)))
    judged, real = [], shingle_dedup.similar_documents

    def similar(rows, **more):
        judged.append({tuple(r) for r in more["candidates"].collect()})
        return real(rows, **more)
    monkeypatch.setattr(shingle_dedup, "similar_documents", similar)
    bits = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs).where("doc_id IS NOT NULL").collect()}
    stay = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    assert judged == [{(a, b) for a, b in bits.items() if a != b}] and (4, 0) in judged[0]
    assert stay == {None, 0, 2, 3, 5}


def test_pairs_of_a_large_key_are_judged(spark, monkeypatch):
    """Twins among many texts of one template share keys with far more others than the first and the last of a key."""
    import corpus_pipeline
    draw = random.Random(5)
    frame = [f"t{k}" for k in range(300)]
    texts = []
    for k in range(30):
        words = list(frame)
        for at in draw.sample(range(5, 295), 4):
            words[at] = f"own{k}x{at}"
        twin = list(words)
        for at in draw.sample(range(5, 295), 5):
            twin[at] = f"twin{k}x{at}"
        texts += [" ".join(words), " ".join(twin)]
    root = slow_similar(texts)
    assert len(set(root)) > 10
    docs = documents(spark, texts).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1))
    monkeypatch.setattr(shingle_dedup, "PART", 8)
    assert {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == set(root)


def test_brought_candidates_are_judged(spark):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "changed"]), " ".join(base[:30])]
    keyed = shingle_dedup.keyed_sets(documents(spark, texts), "doc_id", "text")
    nodes = {r.doc_id: r.node for r in keyed.collect()}
    given = spark.createDataFrame([(1, 0), (2, 0), (1, 1), (1, 9), (None, 0)], "a long, b long")
    found = {tuple(r) for r in shingle_dedup.candidate_nodes(keyed, given).collect()}
    assert found == {tuple(sorted((nodes[0], nodes[1])))}  # the short text by its size, the others for want of a partner


# Anchors of the substring dedup

def test_texts_are_parsed_once(spark, monkeypatch):
    """Anchors are counted on the phrases that a single pass wrote; none of its tables stays."""
    names, keep = [], substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, name: names.append(name) or keep(df, name))
    text = " ".join(f"w{k}" for k in range(60))
    spans = substring_dedup.repeated_spans(substring_dedup.documents(documents(spark, [text, "a " + text, None, "b"]), "doc_id", "text"))
    assert {r.id for r in spans.collect()} == {1}
    assert names[:3] == ["parsed", "anchors", "phrases"] and not hasattr(substring_dedup, "count_anchors")


def test_anchors():
    """Runs of one length hash as any others; a phrase's anchor is the least run of its first and its last window, the leftmost of equals."""
    draw = random.Random(8)
    texts = [" ".join(draw.choices("abcd", k=draw.randrange(60))).encode() for _ in range(30)] + [None, b"", b"a " * 300]
    parsed = substring_dedup.Parsed(texts, substring_dedup.WordHashes())
    doc, anchors, first, last = parsed.anchored()
    at = np.arange(parsed.total - 5)
    grams = parsed.rolling[0].of(at, at + 6)
    assert (parsed.rolling[0].of_all(6) == grams).all()
    assert anchors.tolist() == [int(min(grams[k:k + 15])) for k in first] == [int(min(grams[k:k + 15])) for k in last]
    values = np.array(draw.choices(range(5), k=200), np.uint64)
    assert substring_dedup.least_in_span(values, 15).tolist() == [k + int(np.argmin(values[k:k + 15])) for k in range(186)]
    assert [len(x) for x in substring_dedup.Parsed([b"a b"], substring_dedup.WordHashes()).phrases()] == [0] * 5


# Bags of the quality rules

def test_bags_are_counted_in_slices(monkeypatch):
    """Pairs of a bag do not depend on the slices, memory does; they come back from the parts they are packed in."""
    import tracemalloc

    import numpy as np
    draw = random.Random(3)
    wide = ["".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(700)) for _ in range(20)]
    for texts in (["a", "abc abc\x00 é", "€ x", "a a a a a"], wide):
        want = Counter()
        for d, t in enumerate(texts):
            whole = (perplexity.START * 4 + t + perplexity.END).replace("\x00", "\uffff")
            want.update((d, whole[k:k + 5]) for k in range(len(whole) - 4))
        for size in (1, 1 << 20):
            monkeypatch.setattr(perplexity, "SLICE", size)
            monkeypatch.setattr(perplexity, "PART", 3 * size)
            grams, doc, gram, counts = perplexity.bag_counts(texts)
            assert {(d, grams[g]): c for d, g, c in zip(doc.tolist(), gram.tolist(), counts.tolist(), strict=True)} == want
            trained = np.bincount(gram, counts, len(grams)).astype(np.int64)
            packed = perplexity.pack_pairs(doc, gram, counts, trained, len(texts))
            back = {(d, grams[g]): c for part in perplexity.unpack_pairs(packed, trained, len(texts))
                    for d, g, c in zip(*(x.tolist() for x in part), strict=True)}
            assert back == want
    monkeypatch.setattr(perplexity, "SLICE", 1 << 16)
    texts = [" ".join(draw.choices(["one", "two", "three", "four"], k=100)) for _ in range(5000)]
    tracemalloc.start()
    perplexity.fill_bag(0, None, 0, [(k, t, (100, 0, 0, 0, 0), False) for k, t in enumerate(texts)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * sum(map(len, texts))  # 47 bytes a character where a bag was counted at once


def test_bags_take_less_than_their_texts():
    """A bag holds its words compressed and each n-gram once, no (document, n-gram) pairs; n-grams are those of ``bag_counts``."""
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8))) for _ in range(2000)]
    rows = [(k, " ".join(draw.choices(words, k=300)), (300, 0, 0, 0, 0), k % 3 == 0) for k in range(400)] + [(None, "", (0, 0, 0, 0, 0), True)]
    bag = perplexity.fill_bag(7, "xx", 1, rows).to_pylist()[0]
    texts = [t for _, t, _, _ in rows if t]
    grams, doc, gram, counts = perplexity.bag_counts(texts)
    assert bag["grams"] == grams
    assert bag["trained"] == np.bincount(gram, counts * (doc % 3 != 0), len(grams)).tolist()
    packed = sum(len(x) for v in bag.values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, bytes))
    assert packed < 0.5 * sum(map(len, texts))  # 0.54 with pairs


def test_bags_ask_each_range_once(spark):
    """One packed row per bag and hash range goes out and comes back, not one per n-gram; values are Spark's for the same hashes."""
    rows = [(k, f"some words of bag {k} and more of them", (9, 0, 0, 0, 0), False) for k in range(50)]
    bags = spark.createDataFrame([perplexity.fill_bag(b, lang, 0, rows).to_pylist()[0] for b, lang in ((1, "xx"), (2, None))], perplexity.BAG)
    parts = bags.select("model", F.explode("grams").alias("part"))
    values = parts.select(F.xxhash64("model", "part").alias("h"), (F.crc32("part") % 1000).alias("cost"))
    wanted = perplexity.ask_ranges(bags, 3)
    assert wanted.count() <= 2 * 8 < parts.count() and wanted.agg(F.sum("n")).head()[0] == parts.count()
    got = perplexity.answer_ranges(wanted, values, 3).orderBy("bag", "shard").collect()
    import zlib
    for bag in bags.collect():
        order = np.argsort(perplexity.gram_hashes(bag.model, bag.grams))
        want = [zlib.crc32(bag.grams[k].encode()) % 1000 for k in order]
        mine = [np.frombuffer(perplexity.zstandard.ZstdDecompressor().decompress(r.costs), np.uint8).reshape(4, -1).T for r in got if r.bag == bag.bag]
        assert np.ascontiguousarray(np.concatenate(mine)).view("<u4").ravel().tolist() == want


def test_bags_are_finished_without_pairs(monkeypatch):
    """Sums of costs are those of the (document, n-gram) pairs, whether windows are ranked by tables or sorted (op10)."""
    draw = random.Random(11)
    words = ["".join(draw.choice("abc\u00e9\u4e2d\U0001f600\x00") for _ in range(draw.randrange(1, 5))) for _ in range(60)]
    texts = [" ".join(draw.choices(words, k=draw.randrange(1, 40))) for _ in range(50)] + ["a", "a"]
    grams, doc, gram, counts = perplexity.bag_counts(texts)
    cost = np.array([zlib.crc32(g.encode()) % 1000 for g in grams])
    joint = np.array([g[-2] == " " for g in grams])[gram]
    want = [np.bincount(doc, x, len(texts)).tolist() for x in (counts * cost[gram], counts * cost[gram] * joint, counts * joint)]
    for table, size in ((0, 1), (0, 1 << 20), (1 << 24, 40), (1 << 24, 1 << 20), (3000, 100)):
        monkeypatch.setattr(perplexity, "TABLE", table)
        monkeypatch.setattr(perplexity, "SLICE", size)
        again = perplexity.bag_counts(texts)
        assert again[0] == grams and all((a == b).all() for a, b in zip(again[1:], (doc, gram, counts), strict=True))
        got = perplexity.bag_sums(texts, lambda g: np.array([zlib.crc32(x.encode()) % 1000 for x in g]))
        assert [x.tolist() for x in got] == want
    monkeypatch.setattr(perplexity, "counted_pairs", None)  # no pair is sorted for it
    perplexity.bag_sums(texts, lambda g: np.ones(len(g), np.int64))


def test_grams_of_several_files_are_summed_in_a_task(spark, tmp_path, monkeypatch):
    """N-grams that the bags of different files share are dealt out once a task, not once a file (op10)."""
    rows = [(k, f"some words of bag {k % 3}", (9, 0, 0, 0, 0), False) for k in range(10)]
    bags = [perplexity.fill_bag(b, "xx", b % 2, rows).to_pylist()[0] for b in range(64)]
    spark.createDataFrame(bags, perplexity.BAG).repartition(64).write.parquet(str(tmp_path / "bags"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        stored = spark.read.schema(perplexity.BAG).parquet(str(tmp_path / "bags"))
        assert stored.rdd.getNumPartitions() > 32
        plans = []
        monkeypatch.setattr(perplexity, "written", lambda df, name: plans.append(df) or df)
        got = {(r.model, r.part): (r.teaches, r.n) for r in perplexity.count_grams(stored).collect()}
        assert "Coalesce" in plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    one = dict(zip(bags[0]["grams"], bags[0]["trained"], strict=True))
    assert got == {(f"{f}:xx", g): (f"{1 - f}:xx", 32 * n) for f in (0, 1) for g, n in one.items()}


# Line dedup

def slow_lines(rows, m):
    """All maximal runs of lines that start earlier as well, by comparing every two places; runs of m words count."""
    seen, gone = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        at = [(k, line) for k, line in enumerate(text.split("\n")) if WORD.search(line)]
        lines = [line for _, line in at]
        sizes = [len(WORD.findall(line)) for line in lines]
        for k, line in enumerate(lines):
            longest = 0
            for other, p in seen.setdefault(line, []):
                n = 0
                while k + n < len(lines) and p + n < len(other) and lines[k + n] == other[p + n]:
                    n += 1
                longest = max(longest, n)
            if longest and sum(sizes[k:k + longest]) >= m:
                gone.setdefault(i, set()).update(x for x, _ in at[k:k + longest])
            seen[line].append((lines, k))
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in rows]


@pytest.mark.parametrize("m", [1, 2, 3, 5, 11])
def test_line_runs(spark, m):
    draw = random.Random(m)
    rows = [(i, "\n".join(draw.choice(["a", "b", "c c", "", " ", f"l{draw.randrange(30)}", "one long line " * draw.randrange(1, 5)]) for _ in range(draw.randrange(25))))
            for i in range(60)]
    rows += [(60, None), (61, ""), (62, "x\nx\nx\nx\nx\nx"), (63, rows[3][1]), (None, rows[3][1]), (64, "l1\n" * 300)]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    want = sorted(slow_lines(rows, m), key=str)
    assert sorted(((r.doc_id, r.text) for r in line_dedup.remove_repeated_lines(docs, min_words=m).collect()), key=str) == want
    assert sorted(((r.doc_id, r.text) for r in line_dedup.clean(docs, min_words=m).collect()), key=str) == want
    assert line_dedup.remove_repeated_lines(docs.limit(0), min_words=m).count() == 0


# Substring dedup

def slow_substrings(rows, n=substring_dedup.WINDOW):
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = set()
        for k in range(len(words) - n + 1):
            run = tuple(words[k:k + n])
            if run in seen:
                gone.update(range(k, k + n))
            seen.add(run)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept
    return out


@pytest.mark.parametrize("vocabulary", [2, 6, 5000])
def test_repeated_words(spark, vocabulary):
    draw = random.Random(vocabulary)
    word = lambda: f"w{draw.randrange(vocabulary)}"
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 40, 90)]
    rows = []
    for i in range(80):
        words = [word() for _ in range(draw.randrange(60))]
        for p in draw.sample(passages, draw.randrange(4)):
            a = draw.randrange(0, len(p) // 2)
            words += p[a:draw.randrange(a + 1, len(p) + 1)] + [word() for _ in range(draw.randrange(4))] + p
        rows.append((i, draw.choice([" ", "\n", "\t\x0b "]).join(words)))
    rows += [(90, None), (91, ""), (92, rows[5][1]), (93, "a " * 3000), (94, "a\x1cb " * 21), (95, "é日" + rows[5][1])]
    want = slow_substrings(rows)
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = substring_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: v[:3] for i, v in want.items()} and len(got) == len(rows)
    texts = {r.doc_id: r.text for r in substring_dedup.shorten(docs).collect()}
    for i, t in rows:
        assert WORD.findall(texts[i] or "") == want[i][3] and (want[i][1] or texts[i] == t)


def test_repeated_words_edges(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = documents(spark, [text, text, text, text], [1, 1, None, 2])
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [("1", 0), ("1", 0), ("2", 30), ("None", 0)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert substring_dedup.shorten(docs).columns == docs.columns and substring_dedup.shorten(docs).count() == 4


# Quality rules

def slow_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) for d in range(3) if windows[tuple(words[k:k + 3])] > 1}
    n = len(words)
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_base_rules(spark):
    draw = random.Random(9)
    texts = [None, "", " ", "#", "a\na\n a\n\n\n", "é日🙂 %% <b>", "x y z x y z", "x x x x", " ".join(f"w{k}" for k in range(50)),
             " ".join(f"w{k % 10}" for k in range(60)), "long " * 30_000]
    texts += [" ".join(draw.choice("abc") * draw.randrange(1, 3) for _ in range(draw.randrange(80))) for _ in range(40)]
    got = perplexity.judge(documents(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:7] for r in got] == [slow_base(t) for t in texts]
    assert not any(r.kept for r in got if r.base_failed)
    assert perplexity.judge(documents(spark, []).limit(0)).count() == 0


class SlowKneserNey:
    """Modified Kneser-Ney with plain dictionaries."""

    def __init__(self, texts, order):
        self.order, top = order, Counter()
        for t in texts:
            p = self.padded(t)
            top.update(p[i:i + order] for i in range(len(p) - order + 1))
        self.levels = [top]
        for _ in range(order - 1):
            self.levels.append(Counter(g[1:] for g in self.levels[-1]))
        self.levels.reverse()
        self.followers = [defaultdict(list) for _ in self.levels]
        for level, by in zip(self.levels, self.followers):
            for g, c in level.items():
                by[g[:-1]].append(c)
        self.discounts = []
        for level in self.levels:
            n = [max(1, sum(c == k for c in level.values())) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            self.discounts.append([min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3)])

    def padded(self, text):
        return perplexity.START * (self.order - 1) + " ".join(text.split()) + perplexity.END

    def probability(self, gram):
        if not gram:
            return 1 / perplexity.VOCABULARY
        below, k = self.probability(gram[1:]), len(gram) - 1
        same, d = self.followers[k].get(gram[:-1]), self.discounts[k]
        if not same:
            return below
        c = self.levels[k].get(gram, 0)
        back = sum(d[min(x, 3) - 1] for x in same) / sum(same)
        return (max(c - d[min(c, 3) - 1], 0) / sum(same) if c else 0) + back * below

    def values(self, text):
        p, n = self.padded(text), self.order
        logs = [(p[i + n - 2] == " ", -np.log(self.probability(p[i:i + n]))) for i in range(len(p) - n + 1)]
        at_joints = [v for joint, v in logs if joint]
        return np.mean([v for _, v in logs]), np.mean(at_joints) if at_joints else None


def slow_verdicts(rows):
    """Row number to (kept, perplexity, joint perplexity), by definition."""
    failed = [slow_base(t)[-1] for t, _ in rows]
    fold = [perplexity.fold_of(t.encode() if t else None) for t, _ in rows]
    out, groups = {}, defaultdict(list)
    for i, (t, lang) in enumerate(rows):
        groups[lang, fold[i]].append(i)
    for (lang, f), members in groups.items():
        model = SlowKneserNey([rows[i][0] for i in groups.get((lang, 1 - f), []) if not failed[i]], perplexity.ORDER)
        values = {i: model.values(rows[i][0]) if (rows[i][0] or "").split() else (None, None) for i in members}
        good = [i for i in members if not failed[i]]
        inside = {i: not failed[i] for i in members}
        for at, width in ((0, perplexity.WIDTH), (1, perplexity.JOINT_WIDTH)):
            x = sorted(values[i][at] for i in good)
            if x:
                width *= 1 + 4 / len(x) ** 0.5
                low, middle, high = (x[max(0, int(np.ceil(q * len(x))) - 1)] for q in (0.25, 0.5, 0.75))
                for i in good:
                    inside[i] &= (middle - width * max(middle - low, 0.01) - 1e-9 <= values[i][at]
                                  <= middle + width * max(high - middle, 0.01) + 1e-9)
        out.update({i: (inside[i], *values[i]) for i in members})
    return out


def test_verdicts_by_definition(spark):
    """Perplexities and ``kept`` against plain Kneser-Ney: two languages, no language, copies, odd rows, wide alphabets."""
    draw = random.Random(11)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 6))) for _ in range(40)]
    wide = [chr(0x4E00 + k) + chr(0x4E00 + 7 * k) for k in range(3000)]

    def prose(vocabulary, n):
        return ". ".join(" ".join(draw.choice(vocabulary) for _ in range(8)) for _ in range(n // 8))

    rows = [(prose(words, draw.randrange(40, 160)), lang) for lang in ("xx", "yy", None) for _ in range(18)]
    rows += [(prose(wide, 400), "zh") for _ in range(8)]
    rows += [(rows[0][0], "xx"), (rows[0][0], "xx"), ("".join(sorted(rows[1][0])) + " q" * 60, "xx"), (None, "xx"), ("", None),
             (" ", "yy"), ("one", "yy"), ("a\x00b \x00 " * 30, "yy"), (prose(words, 120), "alone"), (prose(["zz", "q\U0001F642"], 90), "xx")]
    data = spark.createDataFrame([(i, t, lang, "m", 1, "v", 2) for i, (t, lang) in enumerate(rows)],
                                 "doc_id long, text string, lang string, model string, bag int, value string, n int").repartition(3)
    got = {r.doc_id: r for r in perplexity.judge(data).collect()}
    want = slow_verdicts(rows)
    assert set(got) == set(want)
    for i, (kept, *values) in want.items():
        assert got[i].kept == kept, i
        for mine, value in zip((got[i].perplexity, got[i].joint_perplexity), values):
            assert (mine is None) == (value is None) and (value is None or abs(np.log(mine) - value) < 1e-6), i
    assert any(not k for k, *_ in want.values()) and sum(k for k, *_ in want.values()) > 50


def test_equal_perplexities_stay(spark):
    """A band around equal values keeps them; rows that repeat, ids or not, get one verdict; long texts and odd ids pass through."""
    text = " ".join(f"word{k % 60} and" for k in range(60))
    rows = [(1, text, "en"), (1, text, "en"), (None, text, "en"), (2, text, "en"), (3, text + " " + text[::-1] * 400, "fr"), (None, None, None)]
    got = perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r.n_words == 120]
    assert len(same) == 4 and len({r.perplexity for r in same}) == 1
    assert all(r.kept == (not r.base_failed) for r in got)


def test_hash_arrays_of_many_ranges(spark, monkeypatch):
    """The same values, however many hash arrays the model has."""
    draw = random.Random(5)
    docs = documents(spark, [" ".join(draw.choice(["ab", "ba", "cab", "dab.", "Xa"]) for _ in range(70)) for _ in range(30)])
    whole = {r.doc_id: r.perplexity for r in perplexity.judge(docs).collect()}
    monkeypatch.setattr(perplexity, "SHARD", 16)
    cut = {r.doc_id: r.perplexity for r in perplexity.judge(docs).collect()}
    assert cut.keys() == whole.keys() and all(abs(cut[i] - whole[i]) < 1e-9 for i in whole)


def test_outliers_go_and_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    noise = [(10**6 + k, " ".join(f"qz{k}x{j * 7919 % 1000}jj" for j in range(80)), "en") for k in range(3)]
    long = docs.where("lang = 'en' AND n_chars > 900").orderBy("doc_id").limit(5).collect()
    draw = random.Random(2)
    noise += [(2 * 10**6 + r.doc_id, " ".join("".join(draw.sample(w, len(w))) for w in r.text.split()), "en") for r in long]
    docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(noise, "doc_id long, text string, lang string"))
    got = perplexity.judge(docs).collect()
    assert not any(r.kept for r in got if r.doc_id >= 10**6)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    fine = [r.kept for r in got if not r.base_failed and r.doc_id in good]
    assert sum(fine) >= 0.97 * len(fine)


# Pipeline

def test_stages(spark, sf):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        seen.append(docs)
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    assert len(texts[1]) >= 0.97 * len(texts[0])
    assert texts[2] == dict(slow_lines(sorted(texts[1].items()), line_dedup.MIN_WORDS))
    ids = sorted(texts[2])
    assert set(texts[3]) == {ids[r] for r in slow_similar([texts[2][i] for i in ids])}
    want = slow_substrings(sorted(texts[3].items()))
    assert {i: WORD.findall(t) for i, t in texts[4].items()} == {i: v[3] for i, v in want.items()}
    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    whole = corpus_pipeline.run(spark, sf).collect()
    digest = lambda rows: Counter((r.doc_id, r.doc_tokens, r.ids_crc32 if r.length == r.doc_tokens else 0) for r in rows if not r.start)
    assert {d for d, *_ in digest(packed)} == {d for d, *_ in digest(whole)} == set(texts[4])


def test_stages_with_odd_rows(spark):
    import corpus_pipeline
    rows = [(None, "the cat and the dog are here today", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0),
            (3, "the cat and the dog", "en", "s", 1), (3, "the cat and the dog", "en", "s", 1), (4, "le chat et le chien", "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, data, "").count()
