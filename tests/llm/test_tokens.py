import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from textloom.llm import bpe, packing, words

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


def texts():
    random.seed(1)
    made = ["".join(random.choice("ab \nÉÄ1!?éΣ\x1c\x85​　 ") for _ in range(random.randint(0, 60))) for _ in range(400)]
    return made + ["", " ", "a" * 5000, " " * 3000, "日本語テキスト😀" * 50, "ΑΣ ΟΔΟΣ", "<|endoftext|> x", "á ́b", "İstanbul", "can't  won't I'LL", "it's 12345 ١٢٣", "the quick brown fox, jumps.\n\n  over"]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_bpe_is_that_of_the_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(RANKS, P.PATTERN)
    data, cuts = words.data_of(pa.array(texts()))
    ids, counts = encoder.encode(data, cuts)
    assert split(ids, counts) == [library.encode_ordinary(t) for t in texts()]
    back, at = bpe.decode_block(encoder.table, ids, counts)
    assert [back[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == texts()


def test_encode_and_decode_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello world ünï", "z"), (3, "hello world ünï", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in out] == ["", "", rows[2][1], rows[2][1]]
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_words_are_those_of_the_library():
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    got = packing.WordTokenizer(WORDS).encode(*words.data_of(pa.array(texts())))
    assert split(*got) == [e.ids for e in library.encode_batch(texts(), add_special_tokens=False)]


@pytest.mark.parametrize("length", [7, 4096])
def test_packing(spark, length):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = packing.pack(df, WORDS, length=length).collect()
    flat = {}
    for r in out:
        ids = np.frombuffer(bytes(r["ids"]), "<u2")
        assert len(ids) == r["length"] and zlib.crc32(ids.astype("<u4")) == r["ids_crc32"]
        assert r["offset"] + r["length"] <= length
        flat.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(flat) == list(range(len(flat)))
    for s, parts in flat.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or s == max(flat)
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r["length"] for r in out) == total
    assert packing.pack(df.limit(0), WORDS).count() == 0
