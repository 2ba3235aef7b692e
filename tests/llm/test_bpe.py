import base64

import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.Coder(bpe.read_ranks(PATH))
ALPHABET = "ab srtvlemd'SR 1²\n\t 　é.!,漢́\x00\x1f🙂"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=40), max_size=4))
def test_pieces_and_ids_as_the_pattern_and_library(texts):
    for text, pieces in zip(texts, OWN.pieces(texts), strict=True):
        assert [p[2].decode() for p in pieces] == regex.findall(public_tokenizers.PATTERN, text)
        assert [i for p in pieces for i in p[3]] == TIK.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert OWN.encode(text) == TIK.encode_ordinary(text)
    assert OWN.decode(OWN.encode(text)) == text.encode()


def test_long_pieces():
    for text in ("a" * 5000, "abcde" * 700, "é" * 900 + " " * 2000 + "x", "漢字" * 300, "'" * 400):
        assert OWN.encode(text) == TIK.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "It's we'll\n\n 'tis"), (3, "It's we'll\n\n 'tis"), (None, "x y"), (5, "q" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    found = bpe.encode(docs, PATH).collect()
    assert len(found) == 6
    for r in found:
        text = next(t or "" for d, t in rows if d == r.doc_id)
        assert r.ids == TIK.encode_ordinary(text) and r.decoded == text and r.n_tokens == len(r.ids)
        at = [len(TIK.decode_bytes(r.ids[:k])) for k in range(len(r.ids))] if len(text) < 1000 else r.offsets
        assert r.offsets == at
    assert bpe.digest(docs.limit(0), PATH).collect() == []
