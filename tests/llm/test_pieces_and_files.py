import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import DATA
from granary.llm import pieces, token_files
from odd import ROWS, empty, key, table

public = pytest.importorskip("public_tokenizers")
MODEL, WORDS = public.path("piece_bpe_32k.model"), public.path("word_bpe_49k.json")


def random_texts(n, seed):
    draw = random.Random(seed)
    alphabet = [*"abcdefghij the  \n\t.,▁éü漢字日本😀ﬁΣ\x00\r　́'", "  ", "<s>", "the", "ing", "\n\n", "it's", "<|endoftext|>"]
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(n)] + ["a" * 500, "ab" * 300, "=" * 77, " " * 40, ""]


def test_pieces_are_those_of_the_library():
    import sentencepiece

    sp, model, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load_model(MODEL), random_texts(3000, 1)
    want = sp.encode(texts, add_bos=True, add_eos=True)
    got = model.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert model.decode(got) == [sp.decode(x) for x in want]


def test_query_on_all_documents_is_the_library(spark):
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = pieces.op2_sentencepiece(spark, str(DATA)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert key(got) == key(want)


def test_encode_decode_of_odd_rows(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = pieces.encode_decode(table(spark), MODEL)
    want = [(i, len(ids := sp.encode(t or "", add_bos=True, add_eos=True)), np.array(ids, "<u4").tobytes(), sp.decode(ids)) for i, t, _ in ROWS]
    assert key(out.select("doc_id", "n_tokens", F.col("ids"), "decoded").collect()) == key([(i, n, bytearray(b), d) for i, n, b, d in want])
    assert out.filter("shard = 7").count() == len(ROWS) and pieces.encode_decode(empty(spark), MODEL).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 49408, 2**32])
def test_blocks_round_trip(n, high):
    draw = np.random.default_rng(n + high)
    ids = draw.integers(0, high, n)
    ids[draw.random(n) < 0.03] = 2**32 - 1
    image = token_files.TokenImage(token_files.write_image([5, None], np.array([n // 2, n - n // 2]), ids))
    assert (image.ids() == ids).all() and image.doc_ids == [5, None] and image.counts.sum() == n
    assert (image.ids(100, 700) == ids[100:700]).all()


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    texts = random_texts(3000, 2)
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    ids, counts = token_files.load_encoder(WORDS).encode(pa.array(texts), None)
    assert token_files.load_encoder(WORDS).by_words and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_files_of_another_tokenizer_go_to_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    texts = random_texts(50, 5)
    want = [np.array([*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = token_files.write_token_files(df, path, str(tmp_path / "b")).orderBy("doc_id").collect()
    assert [bytes(r["ids"]) for r in found] == want and not token_files.load_encoder(path).by_words


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(WORDS), 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert key(token_files.op7_token_files(spark, str(DATA)).collect()) == key(expected(docs))


def test_files_of_odd_rows(spark, tmp_path):
    found = token_files.write_token_files(table(spark), WORDS, str(tmp_path / "f"), partitions=3)
    got = found.orderBy("start").select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sum(r["n_tokens"] for r in got) == sum(x[2] for x in expected([(i, t) for i, t, _ in ROWS]))
    assert [r["start"] for r in got] == np.r_[0, np.cumsum([r["n_tokens"] for r in got])[:-1]].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert token_files.write_token_files(empty(spark), WORDS, str(tmp_path / "e")).count() == 0


def test_small_files_split_between_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 100)
    rows = [(i, f"word{i} " * 40) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert key(token_files.write_token_files(df, WORDS, str(tmp_path / "s")).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()) == key(expected(rows))
