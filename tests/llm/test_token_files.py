import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from gradelattice.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("start", T.StringType()), T.StructField("ids", T.StringType())])
ODD = ["x <|endoftext|> y", "İ i̇ ǅ é", "don't can't 'll", "　 á b c", "\x1c\x1f a\x85b", "Á\nB\tc\r\nd", "😀 12.5% ΑΣ Σ", "", " ", None,
       "same", "same", "word " * 3000]


def brute(rows):
    whole, out, start = tf.Encoder(PATH, False), [], 0
    for i, text in sorted(rows):
        ids = np.frombuffer(whole.encode([text])[0], "<u2").astype("<u4").tolist() + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_words_encode_as_whole_texts():
    words, whole = tf.Encoder(PATH, True), tf.Encoder(PATH, False)
    letters = ["x".join(map(chr, range(a, a + 64))) for a in range(32, 0xD7C0, 64)]
    for text in [*ODD, *letters, "A, b. c., d.. e,f", "\u212a\u212b\u2126", "<|EndOfText|> <|endoftext|>x"]:
        assert words.encode([text]) == whole.encode([text])


@pytest.mark.parametrize("length", [1, 7, 2048])
def test_round_trip(spark, length):
    rows = [(3 * k - 5, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows[::-1]], SCHEMA)
    manifest = tf.write_token_files(docs, PATH, end_id=1, length=length, by_words=True)
    got = [tuple(r) for r in tf.read_documents(manifest).orderBy("doc_id").collect()]
    assert got == brute(rows)


def test_sequences_are_views_with_masks(spark):
    docs = spark.createDataFrame([(1, "a b c", None, None), (2, "d " * 40, None, None)], SCHEMA).coalesce(1)
    shards = tf.write_token_files(docs, PATH, end_id=1, length=16, by_words=True).collect()
    assert sum(r.n_tokens for r in shards) == 45
    for r in shards:
        shard = tf.Shard(r.ids_path)
        masks = [shard.sequence(k)[1] for k in range(-(-r.n_tokens // 16))]
        assert sum(sum(m.to_pylist()) for m in masks) == r.n_tokens
        ids = shard.sequence(0)[0].to_numpy(zero_copy_only=True)
        assert len(ids) == 16 and not ids.flags.owndata


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tf.read_documents(tf.write_token_files(empty, PATH, end_id=1)).count() == 0
    docs = spark.createDataFrame([(None, "a", None, None), (1, "b", None, None), (1, "b", None, None)], SCHEMA)
    got = tf.read_documents(tf.write_token_files(docs, PATH, end_id=1, by_words=True)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1] and [r.start for r in got] == [0, 2, 4]
