"""Cross-tokenizer alignment against the libraries and loops over all token pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyspark.llm import token_alignment
from tallyspark.llm.queries import op12_token_alignment

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
LETTERS = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xA1, 0xAD)), *map(chr, range(0xAE, 0x100))]
BYTE_OF = {c: ord(c) for c in LETTERS}
BYTE_OF |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in LETTERS)}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def slow_tokens(libraries, text):
    a, b = libraries
    if not text:
        return [], [], [], []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(BYTE_OF[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in ids_b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], [], []
    return ids_a, ids_b, bytes_a, bytes_b


def slow_alignment(libraries, docs):
    linked, rows, in_docs = [], [], Counter()
    for doc_id, text in docs:
        ids_a, ids_b, bytes_a, bytes_b = slow_tokens(libraries, text)
        ranges_a, ranges_b = [], []
        for ranges, parts in ((ranges_a, bytes_a), (ranges_b, bytes_b)):
            at = 0
            for part in parts:
                ranges.append((at, at + len(part)))
                at += len(part)
        ends = {e for _, e in ranges_a} & {e for _, e in ranges_b}
        groups, group_a, group_b, j = [], [], [], 0
        links = []
        for k, (start, end) in enumerate(ranges_a):
            group_a.append(ids_a[k])
            if end in ends:
                while j < len(ranges_b) and ranges_b[j][1] <= end:
                    group_b.append(ids_b[j])
                    j += 1
                groups.append(",".join(map(str, group_a)) + "|" + ",".join(map(str, group_b)))
                group_a, group_b = [], []
        first = 0
        for k, (start, end) in enumerate(ranges_a):
            while first < len(ranges_b) and ranges_b[first][1] <= start:
                first += 1
            m = first
            while m < len(ranges_b) and ranges_b[m][0] < end:
                links.append((ids_a[k], ids_b[m]))
                m += 1
        in_docs.update(set(links))
        linked.append(links)
        rows.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links),
                     hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (a, _), n in in_docs.items():
        best[a] = max(best[a], n)
    return sorted(((*r[:5], sum(in_docs[x] == best[x[0]] for x in links), sum(in_docs[x] for x in links), r[5])
                   for r, links in zip(rows, linked, strict=True)), key=str)


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


TEXTS = [None, "", " ", "  a", "Hello, world! It's fine.\nBye.", "é 日本 🙂 ﬁ <s> y\t\x1cz </s><unk> <0x41>", "no ▁ piece mark",
         "<|endoftext|> is plain <|endoftext|>", "same text here", "same text here", "internationalization unbelievably " * 40,
         "x" * 4000, "​  \x00 \r\n", "Ωμέγα 𝒳𝒴 ᚠᛇᚻ", "a" * 30 + "\n" * 30, "0123456789 12,345.678"]


@pytest.mark.parametrize("chunk", [1, 300, 1 << 21])
def test_alignment(spark, libraries, chunk):
    docs = [*enumerate(TEXTS), (4, TEXTS[4]), (None, "no id")]
    df = spark.createDataFrame([(*d, "x", 1, [1]) for d in docs], "doc_id long, text string, pairs string, chunk int, links array<int>")
    want = slow_alignment(libraries, docs)
    assert found(token_alignment.align_documents(df.repartition(3), BPE, PIECE, chunk_bytes=chunk)) == want
    assert token_alignment.align_documents(df.limit(0), BPE, PIECE).count() == 0


def test_given_documents(spark, libraries, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = found(op12_token_alignment(spark, sf))
    assert got == slow_alignment(libraries, docs)
    assert sum(r[1] > 0 for r in got) > 100


def test_pointer_jumping():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.randrange(1, 200)
        ends_a, ends_b = (np.array(sorted({*rng.sample(range(1, size + 1), rng.randrange(size)), size})) for _ in range(2))
        label = token_alignment.group_labels(ends_a, ends_b)
        common = sorted({*ends_a.tolist()} & {*ends_b.tolist()})
        for k, end in enumerate([*ends_a.tolist(), *ends_b.tolist()]):
            assert ends_a[label[k]] == min(c for c in common if c >= end)


def test_common_pair_and_empty_corpus(spark, libraries):
    docs = [(k, "common words " + "ab"[k % 2] * (k % 5)) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    assert found(token_alignment.align_documents(df, BPE, PIECE, chunk_bytes=100)) == slow_alignment(libraries, docs)
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert found(token_alignment.align_documents(empty, BPE, PIECE)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
