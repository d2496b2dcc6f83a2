"""Chunked BPE against the library on whole texts."""

import base64
import hashlib
import random
import sys

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floodgauge.llm import bpe


def library():
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = library()


def test_matches_equal_the_library_for_every_code_point():
    own = bpe.Vocabulary(open(bpe.RANKS, "rb").read())
    bad = []
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        t = f"a{chr(c)}1{chr(c)} {chr(c)}"
        if own.ids(bpe.pieces(t)).tolist() != LIBRARY.encode_ordinary(t):
            bad.append(hex(c))
    assert not bad, (len(bad), bad[:20])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t.'sé中 -"), max_size=120), st.integers(3, 17), st.integers(1, 9))
def test_stitched_boundaries_equal_those_of_the_whole(text, size, overlap):
    parts = [(k, last, chunk, bpe.ends(chunk)) for k, last, chunk in bpe.chunks(text, size, overlap)]
    got = [s[a:b] for s, own in bpe.stitched(parts, size) for a, b in zip([0, *own], own)]
    assert got == bpe.pieces(text)


def test_digests_and_round_trip(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab  \n.'sé中1-") for _ in range(draw.choice((0, 5, 90, 700)))) for _ in range(60)]
    texts += ["x" * 5000, " " * 3000 + "y", "<|endoftext|>" * 30, "a b" * 4000, None, "", texts[5], texts[5]]
    df = spark.createDataFrame([(i if i % 9 else 3, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("key", F.lit("k"))
    want = []
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i if i % 9 else 3, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for size, overlap in ((100, 20), (bpe.CHUNK, bpe.OVERLAP)):
        assert sorted(map(tuple, bpe.digests(df.repartition(3), size=size, overlap=overlap).collect())) == sorted(want)
    back = bpe.decoded(bpe.encoded(df, size=100, overlap=20)).groupBy("key", "id").agg(F.array_sort(F.collect_list(F.struct("part", "bytes"))).alias("p")).where("key is not null").collect()
    assert sorted(b"".join(p.bytes for p in r.p).decode() for r in back) == sorted(t for t in texts if t and len(t) > 100)


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_equals_library(spark, folder):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9_byte_bpe(spark, folder).collect()}
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(d.text or "")
        assert got.pop(d.doc_id) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
    assert not got
