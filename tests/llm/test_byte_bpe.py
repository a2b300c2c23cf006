import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from cloakframe.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stitching():
    rng = random.Random(0)
    pattern = byte_bpe.codec(PATH, P.PATTERN).pattern
    for _ in range(400):
        s = "".join(rng.choice(["a", "b", " ", "\n", "'s", "1", "!", "é", "  ", "x" * 30, " " * 20]) for _ in range(rng.randint(1, 200)))
        size, over = rng.choice([(20, 5), (7, 3), (50, 10), (16, 1)])
        n = max(1, -(-(len(s) - over) // size))
        chunks = [s[k * size : k * size + size + over] for k in range(n)]
        found = [byte_bpe.boundaries(pattern, c, k == n - 1) for k, c in enumerate(chunks)]
        assert byte_bpe.stitch(pattern, chunks, found, size) == pattern.findall(s)


def digests(reference, t):
    ids = np.array(reference.encode_ordinary(t or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk", [byte_bpe.CHUNK_CHARS, 40])
def test_as_tiktoken(make_docs, corpus, reference, chunk):
    rows = corpus + [(1000, "😀中文 " * 500), (1001, " " * 700 + "a" * 900)]
    out = byte_bpe.encode_digests(make_docs(rows), PATH, P.PATTERN, chunk_chars=chunk, overlap=min(10, chunk)).collect()
    assert {tuple(r) for r in out} == {(i, *digests(reference, t)) for i, t in rows} and len(out) == len(rows)


def test_encode_decode(make_docs, corpus):
    ids = byte_bpe.encode(make_docs(corpus), PATH, P.PATTERN)
    back = byte_bpe.decode(ids, PATH, P.PATTERN).withColumn("text", F.col("bytes").cast("string"))
    assert {(r.doc_id, r.text) for r in back.collect()} == set(corpus)


def test_empty_and_repeated(make_docs):
    assert byte_bpe.encode_digests(make_docs([]), PATH, P.PATTERN).count() == 0
    assert byte_bpe.encode_digests(make_docs([(1, "a b " * 50)] * 2), PATH, P.PATTERN, chunk_chars=20, overlap=5).count() == 2
