"""Benchmark decontamination by winnowing.

Texts become words and words become 64-bit hashes.  Of every `window` consecutive k-grams the one with the least hash
is kept (all of them on a tie): any two texts that share `k + window - 1` consecutive words keep the same k-gram within
the shared part, so joining the kept fingerprints of documents and benchmark items misses no span of that length.  A
joined pair is then extended word by word to both sides, and counts when the common run reaches the wanted length.

An item shorter than that length is one window of its own; for each such length n the same code runs with k = n and
a window of one k-gram, which keeps every n-gram.

Everything is a DataFrame expression.  Texts are never shuffled: arrays of hashes are cut into overlapping segments of
bounded length, fingerprints carry the few words around them that an extension can need, and the benchmark's
fingerprints are broadcast in blocks of at most `BLOCK` rows of a fixed size, one after another, however many there are;
documents are read once for each block and for each length of short items.  Which items hold a fingerprint is joined to
the hits alone, so an item's fingerprints may be as common as they like.  Only hits are shuffled, by document.

Defined results: a null text has no words; items without words match nothing; repeated rows of the documents give
repeated rows; a repeated item id counts once; empty tables give empty results, or no hits; other columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

LENGTH = 10
K = 5
#: Fingerprints of the benchmark that are broadcast at a time: two numbers and the hashes of at most 15 words, 200 bytes.
BLOCK = 200_000
#: Words of a document that are handled as one array.
SEGMENT = 8192

_UPPER = "".join(map(chr, range(65, 91)))


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case: runs of ASCII digits, ASCII letters and characters beyond ASCII."""
    whole = F.coalesce(text, F.lit(""))
    # lower() also changes letters beyond ASCII, which must stay as they are
    lowered = F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _range(first: int, count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(first), count.cast("int") - 1 + first)).otherwise(F.array().cast("array<int>"))


def _extreme(f, values: list[Column]) -> Column:
    return f(*values) if len(values) > 1 else values[0]


def fingerprints(texts: DataFrame, *, keys: list[str], text: str, k: int, length: int, always: bool) -> DataFrame:
    """The kept k-grams: keys, n (words of the text), h (hash; null on a text's first row if `always`), pos, ctx.

    ctx holds the hashes of the words from `length - k` before the k-gram to as many after it, null beyond the ends.
    """
    window = length - k + 1
    reach = length - k
    step = SEGMENT
    df = texts.select(*keys, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("_w"))
    n = F.size("_w")
    pieces = F.when(n <= step + length - 1, F.array(F.col("_w"))).otherwise(
        F.transform(_range(0, F.ceil((n - (length - 1)) / step)), lambda s: F.slice(F.col("_w"), s * step + 1, F.lit(step + length - 1)))
    )
    df = df.select(*keys, n.alias("n"), F.posexplode(pieces).alias("_segment", "_w"))
    gram = lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(k)])
    df = df.withColumn("_h", F.transform(_range(0, F.size("_w") - (k - 1)), gram))
    least = lambda i: _extreme(F.least, [F.get("_h", i + j) for j in range(window)])
    df = df.withColumn("_m", F.transform(_range(0, F.size("_h") - (window - 1)), least))
    of_windows = lambda p: _extreme(F.greatest, [F.get("_m", p - j) for j in range(window)])
    df = df.withColumn("_p", F.filter(_range(0, F.size("_h")), lambda p: F.get("_h", p) == of_windows(p)))
    around = lambda p: F.array(*[F.get("_w", p + j) for j in range(-reach, k + reach)])
    prints = F.transform("_p", lambda p: F.struct(F.get("_h", p).alias("h"), (F.col("_segment") * step + p).alias("pos"), around(p).alias("ctx")))
    if always:
        mark = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("pos"), F.lit(None).cast("array<long>").alias("ctx")))
        prints = F.when(F.col("_segment") == 0, F.concat(mark, prints)).otherwise(prints)
    return df.select(*keys, "n", F.explode(prints).alias("_f")).select(*keys, "n", "_f.h", "_f.pos", "_f.ctx")


def _same(i: int) -> Column:
    return F.coalesce(F.get("ctx", F.lit(i)) == F.get("b_ctx", F.lit(i)), F.lit(False))


def _run(indices: list[int]) -> Column:
    """How many of the positions agree, from the first on without a gap."""
    out = F.lit(len(indices))
    for taken, i in reversed(list(enumerate(indices))):
        out = F.when(~_same(i), F.lit(taken)).otherwise(out)
    return out


def _hits(docs: DataFrame, grams: DataFrame, *, keys: list[str], text: str, k: int, length: int, marks: bool) -> DataFrame:
    """Runs of `length` or more common words around joined fingerprints: keys, n, pos, first, last, gram."""
    reach = length - k
    left, right = _run(list(range(reach - 1, -1, -1))), _run(list(range(reach + k, k + 2 * reach)))
    enough = reduce(lambda a, b: a & b, (_same(i) for i in range(reach, reach + k)), left + right + k >= length)
    prints = fingerprints(docs, keys=keys, text=text, k=k, length=length, always=marks)
    joined = prints.join(F.broadcast(grams), (F.col("h") == F.col("b_h")) & enough, "left" if marks else "inner")
    joined = joined.filter((F.col("pos") < 0) | F.col("b_h").isNotNull())
    return joined.select(*keys, "n", "pos", (F.col("pos") - left).alias("first"), (F.col("pos") + k - 1 + right).alias("last"), "gram")


def _grams(items: DataFrame, *, item: str, text: str, k: int, length: int) -> DataFrame:
    """Which items hold which fingerprints: b_h, b_ctx, gram (a hash of both), item."""
    prints = fingerprints(items, keys=[item], text=text, k=k, length=length, always=False)
    if length < LENGTH:
        prints = prints.filter(F.col("n") == length)
    gram = F.xxhash64(F.lit(length), F.col("h"), F.col("ctx"))
    return prints.select(F.col("h").alias("b_h"), F.col("ctx").alias("b_ctx"), gram.alias("gram"), F.col(item).cast("string").alias("item")).distinct()


def covered(runs: Column) -> Column:
    """How many positions an array of struct(first, last) covers."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))

    def add(acc: Column, run: Column) -> Column:
        more = F.greatest(F.lit(0), run["last"] - F.greatest(run["first"], acc["last"] + 1) + 1)
        return F.struct(F.greatest(acc["last"], run["last"]).alias("last"), (acc["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(runs), start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """Per document: key, n_words, n_hit (words inside a shared window), runs (first and last word), items (ids as strings)."""
    keyed = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text"))
    keys = ["_key", "_text_hash"]
    common = {"keys": keys, "text": "_text"}
    sizes = items.select(F.size(words(F.col(text))).alias("n")).filter(F.col("n").between(1, LENGTH - 1)).distinct().collect()
    found, members = [], []
    for short in [None, *sorted(row["n"] for row in sizes)]:
        scheme = {"k": short or k, "length": short or LENGTH}
        held = cut(_grams(items, item=item, text=text, **scheme), "grams")
        members.append(held.select("gram", "item"))
        grams = held.select("b_h", "b_ctx", "gram").distinct()
        blocks = max(1, -(-grams.count() // BLOCK))
        for block in range(blocks):
            part = grams.filter(F.pmod(F.xxhash64("b_h"), F.lit(blocks)) == block) if blocks > 1 else grams
            found.append(_hits(keyed, part, marks=not short and not block, **common, **scheme))
    every = reduce(DataFrame.unionByName, found)
    run = F.when(F.col("pos") >= 0, F.struct("first", "last"))
    one = every.groupBy(*keys).agg(F.max("n").alias("n_words"), F.count_if(F.col("pos") < 0).alias("_rows"), F.collect_set(run).alias("runs"), F.collect_set("gram").alias("_grams"))
    one = cut(one.withColumn("n_hit", covered(F.col("runs"))), "judged")
    hits = one.filter(F.size("_grams") > 0).select(F.col("_key").alias("_k"), F.col("_text_hash").alias("_t"), F.explode("_grams").alias("gram"))
    named = hits.join(reduce(DataFrame.unionByName, members), "gram").groupBy("_k", "_t").agg(F.collect_set("item").alias("items"))
    one = one.join(named, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_text_hash") == F.col("_t")), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return one.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).select(F.col("_key").alias(key), "n_words", "n_hit", "runs", "items")


def decontaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", most_share: float = 0.0, **options) -> DataFrame:
    """The documents of which at most `most_share` of the words are inside shared windows, with their own columns."""
    judged = contamination(docs, items, key=key, **options).filter(F.col("n_hit") > F.col("n_words") * most_share)
    dirty = judged.select(F.col(key).alias("_dirty")).distinct()
    return docs.join(dirty, docs[key].eqNullSafe(dirty["_dirty"]), "left_anti")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contamination(docs, items)
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
