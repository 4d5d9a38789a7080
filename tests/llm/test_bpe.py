import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from veilspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n=600):
    r = random.Random(5)
    alphabet = ["'", "'s", "'re", "'ll", "'LL", " ", "  ", "\n", "\r\n", "\t", " ", "　", "\x1c", "a", "re", "Zq", "é", "ß", "ж", "漢", "7", "42",
                "²", "½", "!", "...", "🙂", "🇩🇪", "é", "​", "<|endoftext|>", "don't", "we've", "\U00016d45", "\U000116d3", "_", "-"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_classes_are_those_of_the_library():
    points = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    table = bpe.class_table()
    single = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}", bpe.LETTER), (r"\p{N}", bpe.NUMBER), (r"\s", bpe.BLANK)):
        found = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(points)
        assert {ord(c) for c in bytes(found).decode()} == {i for i in np.flatnonzero(table == kind) if not 0xD800 <= i < 0xE000}


def test_ids_are_those_of_the_library(library):
    vocabulary = bpe.vocabulary_of(PATH)
    texts = random_texts()
    data = [t.encode() for t in texts]
    borders = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    ids, counts = vocabulary.encode(b"".join(data), borders)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(texts):
        own = ids[cuts[i] : cuts[i + 1]]
        assert own.tolist() == library.encode_ordinary(t), repr(t)
        assert vocabulary.decode(own)[0].tobytes() == data[i]


@pytest.mark.parametrize("text", ["ab" * 3000 + " 'twas", "x" * 2500, "word's\n\n  end " * 4000, "漢字かな " * 3000 + "\n\n"])
def test_long_texts_in_parts(spark, library, text):
    vocabulary = bpe.vocabulary_of(PATH)
    parts = list(bpe._cut(text.encode(), 1000))
    assert b"".join(parts) == text.encode()
    ids = [i for p in parts for i in vocabulary.encode(p, np.array([0, len(p)]))[0].tolist()]
    assert ids == library.encode_ordinary(text)


def test_digests_round_trip_and_edge_cases(spark, library):
    texts = [None, "", " ", "It's 7 o'clock.\n", "It's 7 o'clock.\n", "ab" * 2000, *random_texts(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, "It's 7 o'clock.\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.token_digests(docs, PATH).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    ids = bpe.encode(docs, PATH)
    back = {(r.doc_id, r.bytes.decode()) for r in bpe.decode(ids, PATH).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    for r in ids.where("doc_id = 3").collect():
        text = "It's 7 o'clock.\n".encode()
        ends = [*r.offsets[1:], len(text)]
        assert [library.decode_single_token_bytes(i) for i in r.ids] == [text[a:b] for a, b in zip(r.offsets, ends)]
    assert bpe.token_digests(docs.limit(0), PATH).count() == 0
