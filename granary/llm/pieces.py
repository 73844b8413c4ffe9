"""SentencePiece BPE by vectorised merge rounds over flat symbol arrays."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

SPACE = "▁"  # the model's sign for a blank
#: Words whose ids a worker remembers, and characters of texts that it handles at a time.
CACHE_WORDS, SLICE_CHARS = 120_000, 1_000_000
#: Symbols are piece ids, or BEYOND + code point for a character that is no piece; pairs are keyed left << 22 | right.
BEYOND, SHIFT = 1 << 20, 22
NEVER = np.iinfo(np.int64).max


class PieceModel:
    """Tables of a SentencePiece BPE model: its normal pieces, which pairs of symbols merge into which, and bytes of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in normal}
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        # rank 0 merges first; pieces of one score share a rank
        levels, rank = np.unique(-scores, return_inverse=True)
        self.char_id = np.arange(0x110000, dtype=np.int64) + BEYOND
        for p, i in pieces.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i

        def symbol(s: str) -> int | None:
            return pieces.get(s, BEYOND + ord(s) if len(s) == 1 else None)

        merges, touching = {}, set()
        for p, i in pieces.items():
            for k in range(1, len(p)):
                touching.add(ord(p[k - 1]) << SHIFT | ord(p[k]))
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is not None and right is not None:
                    merges[left << SHIFT | right] = i
        self.pair_keys = np.array(sorted(merges), np.int64)
        self.pair_ids = np.array([merges[k] for k in sorted(merges)], np.int64)
        self.ranks = np.r_[rank[self.pair_ids].astype(np.int64), NEVER]  # place -1, no pair, is the last
        #: Characters that stand side by side in some piece; between others no merge can reach.
        self.touching = np.array(sorted(touching), np.int64)
        self.splits_at_blank = not any(p[k] == SPACE != p[k - 1] for p in pieces for k in range(1, len(p)))
        self.splits_at_newline = not any("\n" in p for p in pieces if len(p) > 1)
        # a piece is merged everywhere at once unless it can grow by a merge that would have come earlier
        shared = np.bincount(rank[normal], minlength=len(levels)) > 1
        self.at_once = ~shared[rank]
        for key, i in merges.items():
            for part in (key >> SHIFT, key & ((1 << SHIFT) - 1)):
                if part < BEYOND and rank[i] < rank[part]:
                    self.at_once[part] = False
        byte_ids = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.byte_id = np.array([byte_ids.get(f"<0x{b:02X}>", self.unk) for b in range(256)], np.int64)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(byte_ids.values())] = True
        surface = [b""] * n
        for p, i in pieces.items():
            surface[i] = p.replace(SPACE, " ").encode()
        for p, i in byte_ids.items():
            surface[i] = bytes([int(p[3:5], 16)])
        surface[self.unk] = " ⁇ ".encode()
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.r_[0, np.cumsum(self.surface_len)[:-1]]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        if self.splits_at_blank:
            self.words = re.compile(r"\n| *[^ \n]+| +" if self.splits_at_newline else r" *[^ ]+| +")
        else:
            self.words = re.compile(r".+", re.DOTALL)
        self.cache: dict[str, bytes] = {}

    def find(self, keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
        """Places of keys in sorted_keys, -1 where absent."""
        if not len(sorted_keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, at, -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after their merges, and the word each belongs to. Blanks are those of the model's sign."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        if not len(chars):
            return chars, word
        symbols, ranked = self.char_id[chars], self.ranks
        # segments: stretches that no merge can leave
        new = np.r_[True, (word[1:] != word[:-1]) | (self.find(chars[:-1] << SHIFT | chars[1:], self.touching) < 0)]
        segment, at = np.cumsum(new) - 1, np.arange(len(symbols))
        out_symbol, out_at = [], []

        def places(i: np.ndarray) -> np.ndarray:
            """Places in the table of the pairs that start at i; -1 across segments."""
            j = np.minimum(i + 1, len(symbols) - 1)
            found = self.find(symbols[i] << SHIFT | symbols[j], self.pair_keys)
            found[(j == i) | (segment[i] != segment[j])] = -1
            return found

        place = places(np.arange(len(symbols)))
        while len(symbols):
            ranks = ranked[place]
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            best = np.minimum.reduceat(ranks, starts)
            least = np.repeat(best, np.diff(np.r_[starts, len(symbols)]))
            stay = least != NEVER
            if not stay.all():  # compaction: segments without a pair leave
                out_symbol.append(symbols[~stay])
                out_at.append(at[~stay])
                symbols, segment, at, place, ranks, least = (x[stay] for x in (symbols, segment, at, place, ranks, least))
                if not len(symbols):
                    break
            hits = np.flatnonzero(ranks == least)
            # in a run of overlapping pairs every second one merges, from the left
            fresh = np.r_[True, hits[1:] != hits[:-1] + 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
            merged = self.pair_ids[place[hits]]
            go = np.r_[True, segment[hits[1:]] != segment[hits[:-1]]] | self.at_once[merged]
            hits, merged = hits[go], merged[go]
            symbols[hits] = merged
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            symbols, segment, at, place = (x[stay] for x in (symbols, segment, at, place))
            moved = hits - np.arange(len(hits))  # where the merged symbols are now
            place[moved] = places(moved)
            before = moved[moved > 0] - 1
            place[before] = places(before)
        symbols, at = np.concatenate(out_symbol), np.concatenate(out_at)
        order = np.argsort(at, kind="stable")
        return symbols[order], word[at[order]]

    def learn(self, words: list[str]) -> None:
        """Put the ids of words into the cache."""
        symbols, word = self.merge([w.replace(" ", SPACE) for w in words])
        far = np.flatnonzero(symbols >= BEYOND)
        if len(far):  # characters that are no piece: their UTF-8 bytes
            raw = [chr(c).encode() for c in (symbols[far] - BEYOND).tolist()]
            times = np.ones(len(symbols), np.int64)
            times[far] = [len(b) for b in raw]
            word = np.repeat(word, times)
            where = np.repeat(symbols >= BEYOND, times)
            symbols = np.repeat(symbols, times)
            symbols[where] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        flat = symbols.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        start = 0
        for w, end in zip(words, ends.tolist()):
            self.cache[w] = flat[start:end]
            start = end

    def encode(self, texts: list[str], bos: bool = True, eos: bool = True) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        head = np.array([self.bos] if bos else [], "<u4").tobytes()
        tail = np.array([self.eos] if eos else [], "<u4").tobytes()
        split = [self.words.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        missing = list({w for ws in split for w in ws if w not in self.cache})
        if missing:
            self.learn(missing)
        get = self.cache.__getitem__
        return [head + b"".join(map(get, ws)) + tail for ws in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of encoded ids: control ids vanish, the blank that encoding put in front is taken off."""
        out = []
        for raw in ids:
            x = np.frombuffer(raw, "<u4").astype(np.int64)
            x = x[(x != self.bos) & (x != self.eos)]
            lengths = self.surface_len[x]
            total = int(lengths.sum())
            skip = np.repeat(self.surface_start[x] - (np.cumsum(lengths) - lengths), lengths)
            text = self.surface[skip + np.arange(total)].tobytes()
            if len(x) and not self.is_byte[x[0]] and text[:1] == b" ":
                text = text[1:]
            try:
                out.append(text.decode())
            except UnicodeDecodeError:
                out.append(text.decode("utf-8", "replace"))
        return out


#: Texts on which a model is held against the library when it is loaded.
PROBES = [
    "", " ", "  two  blanks ", "Ein Wort, noch eins.\r\n\tIT'S 12,5 % (a-b)", "É é E\u0301 İstanbul ΣΑΣ ﬁ ½ Straße", "a\u00a0b\u3000c\u200bd", "日本語 한국어 ไทย עברית",
    "😀 a😀b", "<s> </s> <unk> ▁ ▁▁a", "\x00\x01 ￿", "ab" * 40 + "=" * 33 + "a" * 50, "\n\n \n x",
]


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    """The model's tables; fails for a model whose ids they don't give (normalisation rules, pieces of its user, unigrams)."""
    import sentencepiece

    model, library = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    want = library.encode(PROBES, add_bos=True, add_eos=True)
    got = model.encode(PROBES)
    if [np.frombuffer(x, "<u4").tolist() for x in got] != want or model.decode(got) != [library.decode(x) for x in want]:
        raise ValueError(f"{path}: not a byte-fallback BPE model without normalisation rules")
    return model


def slices(lengths: list[int], limit: int = SLICE_CHARS):
    """(start, end) of stretches whose lengths sum up to about the limit."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encode_decode(df: DataFrame, model: str, text: str = "text", *, bos: bool = True, eos: bool = True, decode: bool = True) -> DataFrame:
    """Add ids (binary, little-endian unsigned 32-bit), n_tokens and, if asked for, decoded (the text that the ids give).

    Ids are those of the sentencepiece library for the BPE model at ``model`` (a path that every worker can read).
    A null text is empty: it has the begin and end ids only and decodes to ''. Each row is handled by itself, so ties,
    equal rows and empty tables need no rule. Columns ids, n_tokens and decoded are replaced, others carried along.
    """
    df = df.drop("ids", "n_tokens", "decoded")
    schema = T.StructType(list(df.schema.fields) + [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    if decode:
        schema = schema.add("decoded", T.StringType())

    def run(batches):
        m = load_model(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                ids = m.encode([t or "" for t in column.slice(a, b - a).to_pylist()], bos, eos)
                new = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                names = part.schema.names + ["ids", "n_tokens"]
                if decode:
                    new.append(pa.array(m.decode(ids), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(part.columns + new, names=names)

    return df.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Contract query over every row of documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = encode_decode(docs, model or default_model())
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
