"""Token ids of a corpus in files of grammar-compressed blocks.

Documents go in ascending id order, or in that of another column, into shards, one per range of it.  A shard is a sequence of blocks; a block holds
whole documents, about `repair.BLOCK_IDS` ids, as a grammar: rules, their expansion lengths and the remaining symbols,
beside the ids and lengths of its documents.  The files are Parquet, written by Spark's own committer to whatever store
the path names, so a lost executor costs its unfinished block files alone; the table of blocks is the index.

Encoding uses the tokenizers library.  A text is cut where the tokenizer's own split can be foretold (before single
spaces; further into runs of letters, with one white space before, and what lies between them), each distinct word and
piece is encoded once per worker, and a text in which a cut might not be safe is encoded whole.  The memory of words and
of pieces is bounded; what does not fit is encoded again each time.

Defined results: a null text counts as empty and is the end id alone; a null id sorts first; repeated rows are stored as
often as they come, rows of one id side by side, in the order of their texts within a range; an empty table gives an empty result; other columns
are left out.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repair
from .shared import release_memory, written

END = 0
#: Words that a worker remembers, and a quarter as many pieces of words: about 120 MB.
REMEMBERED = 650_000
BLOCKS = "shard int, block int, n_ids long, doc_ids array<long>, doc_lengths array<long>, base int, rules binary, lengths binary, symbols binary"

_SPACE = " \t\n\r\x0b\x0c   -     　"
_LETTERS = rf"[{_SPACE}]?[^\W\d_]+(?:'[^\W\d_]+)*"
_PIECE = re.compile(rf"{_LETTERS}|[\W\d_]+?(?={_LETTERS}|\Z)", re.DOTALL)
#: Where an apostrophe may begin a token of its own.
_APOSTROPHE = re.compile(r"(?<![^\W\d_])'(?=[dlmrstv])", re.IGNORECASE)
#: White space to one library only, and the start of a special token.
_ODD = ("<|", "\x85", "\x1c", "\x1d", "\x1e", "\x1f")


def _symbols() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


_SYMBOLS = _symbols()


class Encoder:
    """Encodes texts with one tokenizer file, remembering words and pieces of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        config = json.loads(self.tokenizer.to_str())
        split = config["pre_tokenizer"] or {}
        #: Whether texts can be cut as described above; else every text is encoded whole.
        self.cuts = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not config["normalizer"] and not config["post_processor"]
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.words: dict[str, bytes] = {}  # without the space before
        self.pieces: dict[str, bytes] = {}

    def _one(self, piece: str) -> bytes:
        """The ids of a run of letters with a space or nothing before it, which the tokenizer takes as one unit."""
        symbols = piece.replace(" ", _SYMBOLS[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(_SYMBOLS)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _by_pieces(self, text: str) -> bytes:
        known, found = self.pieces, []
        for x in _PIECE.findall(text):
            ids = known.get(x)
            if ids is None:
                # letters to Python's expressions, but not to the tokenizer: numbers such as superscripts
                if x[-1].isalnum() and not x[-1].isdecimal() and not x.strip().replace("'", "").isalpha():
                    return self._plain(text)
                if (x[1:] if x[0] == " " else x).isalpha():
                    ids = self._one(x)
                elif x[0] == "\n" and x[1:].isalpha():
                    ids = self._plain("\n") + self._one(x[1:])  # only a single space goes with the letters after it
                else:
                    ids = self._plain(x)
                if len(known) < REMEMBERED // 4:
                    known[x] = ids
            found.append(ids)
        return b"".join(found)

    def _words(self, words: list[str], needed: np.ndarray) -> list[bytes | None]:
        """The ids of words with the space before them; None if a word's neighbours could matter, or it is not needed."""
        known = self.words
        found = list(map(known.get, words))
        for i in np.flatnonzero(needed).tolist():
            if found[i] is None:
                word = words[i]
                core = word.rstrip(".,")
                if core.isalpha():
                    # most words are letters with at most a mark behind, and letters and mark are units of their own
                    ids = known.get(core) or self._one(" " + core)
                    if len(core) < len(word):
                        if len(known) < REMEMBERED:
                            known[core] = ids
                        mark = word[len(core) :]
                        ids += self.pieces.get(mark) or self._by_pieces(mark)
                elif not word or word[0].isspace() or word[-1].isspace():
                    continue
                else:
                    ids = self._by_pieces(" " + word)
                found[i] = ids
                if len(known) < REMEMBERED:
                    known[word] = ids
        return found

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text.

        A space between two other characters always begins a token, so words can be encoded one by one, and each
        distinct word of a batch once.
        """
        if not len(texts):
            return []
        if not self.cuts:
            return [np.frombuffer(self._plain(t), np.uint32) for t in texts.to_pylist()]
        lists = pc.split_pattern(texts, " ")
        words = pc.dictionary_encode(lists.flatten())
        which = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        first = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        first = np.concatenate([[0], first[:-1]])
        own = np.bincount(which, minlength=len(words.dictionary)) > np.bincount(which[first], minlength=len(words.dictionary))
        table = self._words(words.dictionary.to_pylist(), own)
        unsafe = np.array([ids is None for ids in table])
        heads = pc.list_element(lists, 0).to_pylist()
        marked = np.zeros(len(table), bool)
        for mark in (*_ODD, "'"):
            marked |= pc.match_substring(words.dictionary, mark).to_numpy(zero_copy_only=False)
        odd = np.logical_or.reduceat(marked[which], first)
        at_fault = unsafe[which]
        at_fault[first] = False
        bad = np.logical_or.reduceat(at_fault, first)
        table = [ids or b"" for ids in table]
        empty = len(table)
        table.append(b"")
        stop = np.concatenate([first[1:], [len(which)]])
        for i, head in enumerate(heads):
            if odd[i] or bad[i] or not head or head[-1].isspace():
                text = texts[i].as_py()
                odd_one = any(x in text for x in _ODD) or _APOSTROPHE.search(text)
                whole = odd_one or bad[i] or not head or head[-1].isspace()
                if whole:
                    which[first[i] : stop[i]] = empty
                    table.append(self._plain(text) if odd_one else self._by_pieces(text))
                else:
                    table.append(self._by_pieces(head))
            else:
                table.append(self._by_pieces(head))
            which[first[i]] = len(table) - 1
        sizes = np.array([len(x) >> 2 for x in table], np.int64)
        flat = np.frombuffer(b"".join(table), np.uint32)
        ids = flat[_ranges((np.cumsum(sizes) - sizes)[which], sizes[which])]
        ends = np.cumsum(np.add.reduceat(sizes[which], first))
        return np.split(ids, ends[:-1])

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    shift = (starts - (np.cumsum(sizes) - sizes)).astype(np.int32)
    out = np.repeat(shift, sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; it outlives the task, so later tasks know its pieces."""
    home = sys.modules.setdefault("_kerbline_encoders", types.ModuleType("_kerbline_encoders"))
    if path not in home.__dict__:
        home.__dict__[path] = Encoder(path)
    return home.__dict__[path]


def blocks_of(docs: Iterable[tuple[int, np.ndarray]], most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Whole documents in groups of about `most` ids."""
    keys: list[int] = []
    parts: list[np.ndarray] = []
    held = 0
    for key, ids in docs:
        if held and held + len(ids) > most:
            yield keys, parts
            keys, parts, held = [], [], 0
        keys.append(key)
        parts.append(ids)
        held += len(ids)
    if keys:
        yield keys, parts


def slices(texts: pa.Array, most: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """Offset and length of runs of texts with about `most` bytes."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(group)) + 1):
        if len(at):
            yield int(at[0]), len(at)


def _encode_shard(path: str, end: int):
    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("base", pa.int32())]
        + [(k, pa.binary()) for k in ("rules", "lengths", "symbols")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of small objects, none of them in cycles
        encode = encoder(path)
        shard = TaskContext.get().partitionId()
        last = np.array([end], np.uint32)

        def texts() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for piece in slices(batch.column(1)):
                    yield from zip(batch.column(0).slice(*piece).to_pylist(), encode.batch(batch.column(1).slice(*piece)), strict=True)

        for number, (keys, parts) in enumerate(blocks_of(texts(), repair.BLOCK_IDS)):
            ids = np.concatenate([x for part in parts for x in (part, last)])
            packed = repair.compress(ids, encode.base)
            row = {"shard": shard, "block": number, "n_ids": len(ids), "doc_ids": keys, "doc_lengths": [len(p) + 1 for p in parts], "base": packed.base}
            yield pa.RecordBatch.from_pylist([row | {k: getattr(packed, k).tobytes() for k in ("rules", "lengths", "symbols")}], schema)
        gc.enable()
        release_memory()

    return run


def encode(docs: DataFrame, tokenizer_file: str, *, key: str = "doc_id", text: str = "text", order: str | None = None, end: int = END) -> DataFrame:
    """The rows of the file format, one per block; rows go in the order of the given column, or of their ids."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.col(order).alias("place")] if order else []))
    by = ["place", "key"] if order else ["key"]
    # the place in the input parts the rows of one id, and costs the sample of the ranges no text
    ordered = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*by, "_at").sortWithinPartitions(*by, "text").select("key", "text")
    return ordered.mapInArrow(_encode_shard(tokenizer_file, end), BLOCKS)


def unpacked(row) -> repair.Block:
    array = lambda k: np.frombuffer(row[k], np.uint32)
    return repair.Block(int(row["base"]), array("rules").reshape(-1, 2), array("lengths"), array("symbols"))


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, row in batch.iterrows():
            ids = repair.Decoder(unpacked(row)).whole().astype("<u4", copy=False)
            sizes = np.asarray(row["doc_lengths"], np.int64)
            ends = np.cumsum(sizes)
            sums = [zlib.crc32(ids[a:b].data) for a, b in zip(ends - sizes, ends, strict=True)]
            keys = pd.array([None if k is None or k != k else int(k) for k in row["doc_ids"]], dtype="Int64")
            yield pd.DataFrame({"shard": row["shard"], "block": row["block"], "key": keys, "offset": ends - sizes, "n_tokens": sizes, "ids_crc32": sums})


def starts(blocks: DataFrame) -> DataFrame:
    """shard, block, _start: the ids in all blocks before it."""
    before = lambda window: F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_shard = blocks.select("shard", "block", "n_ids").withColumn("_in_shard", before(Window.partitionBy("shard").orderBy("block")))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).withColumn("_before", before(Window.orderBy("shard"))).select("shard", "_before")
    return in_shard.join(shards, "shard").select("shard", "block", (F.col("_before") + F.col("_in_shard")).alias("_start"))


def index(blocks: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32."""
    facts = blocks.select("shard", "block", "doc_ids", "doc_lengths", "base", "rules", "lengths", "symbols").mapInPandas(
        _facts, "shard int, block int, key long, offset long, n_tokens long, ids_crc32 long"
    )
    placed = facts.join(starts(blocks), ["shard", "block"])
    return placed.select(F.col("key").alias(key), (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, tokenizer_file: str, path: str | None = None, **options) -> DataFrame:
    """Writes the files, to the shared work folder if no path is given, and returns the table of blocks read from them."""
    encoded = encode(docs, tokenizer_file, **options)
    if path is None:
        return written(encoded, "tokens")[0]
    encoded.write.parquet(path)
    return docs.sparkSession.read.schema(BLOCKS).parquet(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return index(store(docs, default_tokenizer()))
