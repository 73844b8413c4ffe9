"""Token-ID files in patched frame-of-reference blocks."""

from __future__ import annotations

import json
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, partitions_for, shared_dir
from .pieces import slices

#: Ids in a block; ids after which a file is closed at the next end of a document; share of a block packed at its width.
BLOCK, FILE_IDS, PERCENTILE = 512, 1 << 20, 90
#: Bytes of texts that are encoded at a time.
SLICE_BYTES = 4_000_000
MAGIC = b"TPFR0001"
HEADER = struct.Struct("<8sIQI")  # magic, documents, ids, blocks
BLOCK_HEAD = np.dtype([("least", "<u4"), ("n", "<u2"), ("width", "u1"), ("unused", "u1"), ("exceptions", "<u4")])


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)  # 0 for 0


def turned(x: np.ndarray) -> np.ndarray:
    """Each run of eight bytes read as an 8 x 8 matrix of bits, turned over its diagonal (turning twice gives it back)."""
    x = np.ascontiguousarray(x).view("<u8")
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(shift))
    return x.view(np.uint8)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Each block: head; values less the block's minimum, packed at its width; places (u2) and high parts (u4) of exceptions.

    The width is the PERCENTILE-th percentile of the values' bit lengths; wider values keep their low bits in the packed
    part, and their place and high part are in the exception list. The packed part holds a plane of BLOCK bits for each
    bit of the width, lowest first.
    """
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return []
    table = np.full(n_blocks * BLOCK, ids[-1], "<u4")
    table[: len(ids)] = ids
    table = table.reshape(n_blocks, BLOCK)
    least = table.min(axis=1)
    table -= least[:, None]
    at = BLOCK * PERCENTILE // 100
    widths = bit_lengths(np.partition(table, at, axis=1)[:, at]).astype(int)
    sizes = np.full(n_blocks, BLOCK)
    sizes[-1] = len(ids) - (n_blocks - 1) * BLOCK
    high = table >> widths[:, None].astype(np.uint64)
    high.ravel()[len(ids) :] = 0
    block, place = np.nonzero(high)
    high, place = high[block, place].astype("<u4"), place.astype("<u2")
    planes = np.empty((n_blocks, 32, BLOCK // 8), np.uint8)
    for k in range(-(-int(widths.max()) // 8)):  # byte k of all values gives planes 8k to 8k + 7
        bits = turned((table >> np.uint32(8 * k)).astype(np.uint8)).reshape(n_blocks, BLOCK // 8, 8)
        planes[:, 8 * k : 8 * k + 8] = bits.transpose(0, 2, 1)
    heads = np.zeros(n_blocks, BLOCK_HEAD)
    heads["least"], heads["n"], heads["width"], heads["exceptions"] = least, sizes, widths, np.bincount(block, minlength=n_blocks)
    ends = np.cumsum(heads["exceptions"].astype(int))
    return [
        heads[i].tobytes() + planes[i, :w].tobytes() + place[e - n : e].tobytes() + high[e - n : e].tobytes()
        for i, (w, e, n) in enumerate(zip(widths.tolist(), ends.tolist(), heads["exceptions"].tolist()))
    ]


def unpack_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of consecutive blocks."""
    if not blocks:
        return np.zeros(0, np.uint32)
    at = BLOCK_HEAD.itemsize
    heads = np.frombuffer(b"".join(b[:at] for b in blocks), BLOCK_HEAD)
    widths = heads["width"].astype(int)
    whole = BLOCK * (-(-int(widths.max()) // 8) * 8) // 8  # planes of all blocks padded to the same whole bytes
    raw = b"".join(b[at : at + BLOCK * w // 8].ljust(whole, b"\0") for b, w in zip(blocks, widths.tolist()))
    planes = np.frombuffer(raw, np.uint8).reshape(len(blocks), whole * 8 // BLOCK, BLOCK // 8)
    table = np.zeros((len(blocks), BLOCK), np.uint32)
    for k in range(planes.shape[1] // 8):
        part = turned(planes[:, 8 * k : 8 * k + 8].transpose(0, 2, 1)).reshape(len(blocks), BLOCK)
        table |= part.astype(np.uint32) << np.uint32(8 * k)
    for b in np.flatnonzero(heads["exceptions"]).tolist():
        start, k = at + BLOCK * widths[b] // 8, int(heads["exceptions"][b])
        places = np.frombuffer(blocks[b], "<u2", k, start)
        table[b, places] |= (np.frombuffer(blocks[b], "<u4", k, start + 2 * k).astype(np.int64) << widths[b]).astype(np.uint32)
    table += heads["least"][:, None]
    return table.ravel()[: int(heads["n"].sum())]


def write_image(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: header; document ids (i8) with a null map; their numbers of ids (u8); block starts (u8); the blocks."""
    blocks = pack_blocks(ids)
    starts = np.r_[0, np.cumsum([len(b) for b in blocks])].astype("<u8")
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([HEADER.pack(MAGIC, len(doc_ids), len(ids), len(blocks)), keys.tobytes(), nulls.tobytes(), counts.astype("<u8").tobytes(), starts.tobytes(), *blocks])


class TokenImage:
    """Reads a file: its documents, all ids, or the ids of a stretch by way of the block index."""

    def __init__(self, raw: bytes):
        magic, n_docs, self.n_ids, n_blocks = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        keys = np.frombuffer(raw, "<i8", n_docs, at).tolist()
        at += 8 * n_docs
        nulls = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n_docs // 8), at), bitorder="little")
        self.doc_ids = [None if null else k for k, null in zip(keys, nulls)]
        at += -(-n_docs // 8)
        self.counts = np.frombuffer(raw, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.starts = np.frombuffer(raw, "<u8", n_blocks + 1, at).astype(np.int64) + at + 8 * (n_blocks + 1)
        self.raw = raw

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (end - 1) // BLOCK
        blocks = [self.raw[a:b] for a, b in zip(self.starts[first : last + 1], self.starts[first + 1 : last + 2])]
        return unpack_blocks(blocks)[start - first * BLOCK : end - first * BLOCK]


#: The normaliser and pre-tokenizer under which white space ends words and vanishes (fixed values).
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split", "behavior": "Removed", "invert": True,
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Texts on which a word-wise encoder is held against the library when it is loaded.
PROBES = [
    "", " ", "Ein  Wort,\tnoch eins.\r\nIT'S they'll 12,5 % (a-b) <|endoftext|>x", "É é E\u0301 İstanbul ΣΑΣ ﬁ Straße", "a\u00a0b\u3000c\u200bd",
    "日本語 한국어 ไทย עברית", "x.y!! ##;: --- ...", "😀 a😀b", "ǅ ß ﬀ \x0b\x0c", "l'été d'une naïve coöperation", "supercalifragilistic " * 3,
]


def taken(ids: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids`` (of the lengths, one behind the other) in the order asked for, and their lengths."""
    starts, n = np.cumsum(lengths) - lengths, lengths[order]
    ends = np.cumsum(n)
    if not len(ends):
        return ids[:0], n
    return ids[np.repeat(starts[order] - (ends - n), n) + np.arange(ends[-1])], n


def listed(words: pa.Array) -> list[str]:
    """The words as Python strings (they hold no line break)."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n")


class WordEncoder:
    """Encodes texts with a tokenizers file: different words once, then all texts by taking their words' ids.

    Where the file has the normaliser and pre-tokenizer above, ASCII white space ends every word and is dropped,
    normalisation never reaches across it, and signs behind a run of letters are a run of their own. For any other file,
    or if a probe text comes out differently, whole texts go to the library.
    """

    #: Runs of letters that a worker remembers, and words that are encoded together.
    CACHE, TOGETHER = 700_000, 500
    #: Signs that end a word's run of letters and form a run of their own behind it.
    SIGNS = ".,!$%&*#|;:?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        model, vocabulary = spec["model"], self.tokenizer.get_vocab()
        self.cache: dict[str, bytes] = {"": b""}
        self.by_words = (
            spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and not spec["truncation"] and not spec["padding"]
            and model["type"] == "BPE" and not model["dropout"] and model["end_of_word_suffix"] == "</w>" and not model["continuing_subword_prefix"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] or t["content"].isalpha() for t in spec["added_tokens"])
        )
        if self.by_words:
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            self.plain = Tokenizer(self.tokenizer.model)  # for lower-case ASCII letters there is nothing else to do
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            ids, counts = self.encode(pa.array(PROBES), None)
            self.by_words = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in self.tokenizer.encode_batch_fast(PROBES, add_special_tokens=False)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, tokenizer, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many in one call: each should end with one word end, else they're encoded singly."""
        out = []
        for i in range(0, len(words), self.TOGETHER):
            part = words[i : i + self.TOGETHER]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                out += self.whole(part)
            else:
                raw = ids.tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return out

    def learn(self, words: list[str]) -> None:
        plain, foreign, odd = [], [], []
        for w in words:
            (odd if not w.isalpha() else plain if w.isascii() else foreign).append(w)
        self.cache.update(zip(plain, self.together(self.plain, plain)))
        self.cache.update(zip(foreign, self.together(self.tokenizer, foreign)))
        self.cache.update(zip(odd, self.whole(odd)))

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one word's behind the other's, and how many each has."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        names = listed(words)
        if len(self.cache) > self.CACHE:
            self.cache = {"": b""}
        missing = [w for w in names if w not in self.cache]
        if missing:
            self.learn(missing)
        raw = list(map(self.cache.__getitem__, names))
        return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null), one text's behind the other's, and how many each has."""
        end = np.array([] if end_id is None else [end_id], "<u4")
        if not self.by_words:
            parts = [np.r_[np.frombuffer(x, "<u4"), end].astype("<u4") for x in self.whole(texts.to_pylist())]
            return np.concatenate(parts or [end[:0]]), np.array([len(x) for x in parts], np.int64)
        split = pc.ascii_split_whitespace(texts)
        n_words = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        # a word's run of letters and the signs behind it are looked up apart
        core = pc.utf8_rtrim(words, self.SIGNS)
        letters = pc.utf8_is_alpha(core)
        core = pc.if_else(letters, pc.ascii_lower(core), words)
        cut = np.flatnonzero(pc.and_(letters, pc.not_equal(pc.binary_length(core), pc.binary_length(words))).to_numpy(zero_copy_only=False))
        at = pa.array(cut)
        tails = pa.array([w[n:] for w, n in zip(listed(words.take(at)), pc.utf8_length(core.take(at)).to_pylist())], pa.string()).dictionary_encode()
        cores = core.dictionary_encode()
        core_ids, core_lengths = self.ids_of(cores.dictionary)
        tail_ids, tail_lengths = self.ids_of(tails.dictionary)
        tail_of = np.full(len(words), len(cores.dictionary) + len(tails.dictionary))  # the last, empty run
        tail_of[cut] = tails.indices.to_numpy() + len(cores.dictionary)
        runs = np.stack([cores.indices.to_numpy(), tail_of], axis=1).ravel()
        ids, lengths = taken(np.r_[core_ids, tail_ids], np.r_[core_lengths, tail_lengths, 0], runs)
        lengths = lengths.reshape(-1, 2).sum(axis=1)
        # the end id is one more word behind each text
        order = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(n_words), len(words))
        out, each = taken(np.r_[ids, end].astype("<u4"), np.r_[lengths, len(end)], order)
        ends = np.cumsum(each)[np.cumsum(n_words + 1) - 1]
        return out, np.diff(np.r_[0, ends])


@lru_cache(maxsize=2)
def load_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


FILES = "part int, file_no int, first_id long, n_ids long, n_docs int, content binary"


def write_token_files(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text: str = "text", *, end_id: int | None = 1, partitions: int | None = None) -> DataFrame:
    """Encode documents in ascending id order and write their ids as token files under ``path``; returns read_token_files.

    Rows are range-partitioned by id and sorted; each partition writes files of about FILE_IDS ids, whole documents
    each. ``path`` becomes a Parquet table with a file's image per row (content) and its partition, number and place, so
    any store that Spark writes to will do, and a lost task is written again as a whole.

    Null texts are empty (the end id only); null ids come first; rows of one id stand in the order of their texts'
    hashes; equal rows are written each; an empty table gives an empty one. Other columns aren't written.
    """
    spark = df.sparkSession
    n = partitions or partitions_for(df)
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ordered = rows.repartitionByRange(n, F.col("_id").asc_nulls_first(), F.xxhash64("_text")).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.xxhash64("_text"))

    def run(batches):
        encoder, part = load_encoder(tokenizer), TaskContext.get().partitionId()
        keys, counts, held, n_held, first, number = [], [], [], 0, 0, 0

        def close():
            ids = np.concatenate(held)
            image = write_image(keys, np.array(counts, np.int64), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(keys)], pa.int32()), pa.array([image], pa.binary())],
                names=["part", "file_no", "first_id", "n_ids", "n_docs", "content"],
            )

        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for a, b in slices(pc.binary_length(texts).to_pylist(), SLICE_BYTES):
                coded, sizes = encoder.encode(texts.slice(a, b - a), end_id)
                done = 0
                for key, size in zip(ids[a:b], sizes.tolist()):
                    keys.append(key)
                    counts.append(size)
                    n_held += size
                    if n_held >= FILE_IDS:
                        upto = done + n_held - sum(map(len, held))
                        held.append(coded[done:upto])
                        yield close()
                        done, first, number = upto, first + n_held, number + 1
                        keys, counts, held, n_held = [], [], [], 0
                held.append(coded[done:])
        if keys:
            yield close()

    ordered.mapInArrow(run, FILES).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)
    return read_token_files(spark, path, id_col)


def read_token_files(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids (binary, u4 LE)."""
    files = spark.read.schema(FILES).parquet(path)
    over = Window.orderBy("part")  # one row per partition that wrote
    starts = files.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", (F.sum("_n").over(over) - F.col("_n")).alias("_before"))

    def run(batches):
        for batch in batches:
            for part, first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                image = TokenImage(raw.as_py())
                ids, ends = image.ids().astype("<u4"), np.cumsum(image.counts)
                begins = ends - image.counts
                flat = ids.tobytes()
                k = len(ends)
                for i in range(0, k, 1000):
                    a, b = begins[i : i + 1000], ends[i : i + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(a), pa.int32()), pa.array(image.doc_ids[i : i + 1000], pa.int64()), pa.array(first + a, pa.int64()), pa.array(b - a, pa.int64()), pa.array([flat[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())],
                        names=["part", "_id", "_start", "n_tokens", "ids"],
                    )

    rows = files.select("part", "first_id", "content").mapInArrow(run, "part int, _id long, _start long, n_tokens long, ids binary")
    placed = rows.join(F.broadcast(starts), "part")
    return placed.select(F.col("_id").alias(id_col), (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids")


def op7_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Contract query: writes the files of all documents into the shared folder and reads them back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    read = write_token_files(documents(spark, sf_dir), tokenizer, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
