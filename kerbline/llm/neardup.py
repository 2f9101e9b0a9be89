"""Near-duplicate documents by a signature-coordinate inverted join.

A document is a set of word shingles with a MinHash signature of `COORDINATES` numbers.  Each (coordinate, value) pair
is a token; a document is posted under its tokens, and two documents are candidates if they collide on `MATCH` or more.

Prefix and skip merging keep the posting lists short.  Tokens are put in order of rarity.  Of two documents with at
least `MATCH` common tokens, each has one among the other's first `COORDINATES - MATCH + 1`, so only these are posted.
A token that one document alone has is counted but never posted, and a document with fewer than `MATCH` shared tokens
can have no partner and leaves at once.

Equal sets become one class before anything else.  Lists are merged without writing out the pairs of a list:
1. every class meets the least one of each of its lists; the one it collides with most often is verified;
2. a class outside the largest component of its lists meets members drawn from three of them;
3. what is still apart is compared in full, neighbourhood by neighbourhood: a list without a component of two is one,
   and so is a component with all that share its lists; there every class outside the component meets every other.  So
   no link between two components is lost.  Small neighbourhoods are written out as pairs; large ones are dealt out to
   blocks, block meets block in a task of its own, and only links are written.  Both ways ask the same of a pair.
Pairs go on to the full sets if their signatures have `MATCH` equal coordinates, and only texts of such pairs are read
again.
Verified means: 100 * intersection >= percent * union on the full sets of hashes.

With a similarity of exactly 0.8 a pair has fewer than 26 of 48 matches with a probability of about 2e-5 (binomial), and
with more similarity less.

Defined results: a text that is null or has no words has an empty set and is linked with nothing; rows that share an id
are one document, and links of any of its texts count; a null id is in the component of an equal set, if there is one,
and else has a null component and is kept; each input row gives one result row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.iterate import components
from .shared import cut, release_memory
from .shingles import hash_family, set_name, shingle_set, signature

COORDINATES = 48
MATCH = 26
#: Neighbourhoods of up to so many classes are written out as pairs, larger ones compared in blocks; the links are the same.
PAIRED = 64
#: Classes of a block.
BLOCK = 600
PREFIX = COORDINATES - MATCH + 1
SEED = 41

FEATURES = "key long, n int, name string, signature array<int>"


def _features(width: int):
    family = hash_family(COORDINATES, SEED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            yield pd.DataFrame(
                {"key": batch["key"], "n": [len(s) for s in sets], "name": [set_name(s) if len(s) else None for s in sets], "signature": [signature(s, family).view(np.int32) if len(s) else None for s in sets]}
            )
        release_memory()

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "shingles": [shingle_set(t, width).view(np.int64) for t in batch["text"]]})
        release_memory()

    return run


def features(docs: DataFrame, *, key: str, text: str, width: int) -> DataFrame:
    """Size, name and signature of each document's set."""
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(_features(width), FEATURES)


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """Classes that can have a partner, with the tokens they are posted under: key, n, band, signature, prefix.

    Sets whose sizes differ by more than the similarity allows cannot be linked, so a token is dropped if no other class
    of its band of sizes and the two neighbours holds it.  What stays is in order of the holders in all bands: two
    classes can only rely on each other's prefixes if they order their common tokens alike.
    """
    band = F.floor(F.log("n") / F.log(F.lit(100.000001 / percent))).cast("int")
    tokens = classes.select("key", band.alias("band"), F.posexplode("signature").alias("_at", "_value"))
    tokens = tokens.select("key", "band", (F.shiftleft(F.col("_at").cast("long"), 32) + F.col("_value").cast("long") + (1 << 31)).alias("token"))
    counts = tokens.groupBy("token", "band").agg(F.count(F.lit(1)).alias("_n"))
    shared = counts.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", "_n"))).alias("_bands"), F.sum("_n").alias("_all")).filter("_all > 1")
    near = lambda shift: F.coalesce(F.try_element_at("_bands", F.col("band") + shift), F.lit(0))
    held = tokens.join(shared, "token").filter(near(-1) + near(0) + near(1) > 1).select("key", "band", "token", "_all")
    held = held.groupBy("key", "band").agg(F.collect_list(F.struct("_all", "token")).alias("_held")).filter(F.size("_held") >= MATCH)
    alone = F.lit(COORDINATES) - F.size("_held")
    able = held.select("key", "band", F.transform(F.slice(F.array_sort("_held"), F.lit(1), F.lit(PREFIX) - alone), lambda x: x["token"]).alias("prefix"))
    return classes.join(able, "key").select("key", "n", "band", "signature", "prefix")


def posting_lists(able: DataFrame) -> DataFrame:
    """One row per class and list: a list is a token and a band, and a class is in those of its own band and the next.

    Linked classes are in bands at most one apart, so they meet in the list of the higher band, where at least one of
    them is at home.
    """
    spread = able.select("key", "n", "band", F.explode("prefix").alias("_token")).select("key", "n", "band", "_token", F.explode(F.array(F.lit(True), F.lit(False))).alias("home"))
    return spread.select("key", "n", "home", F.xxhash64("_token", F.when(F.col("home"), F.col("band")).otherwise(F.col("band") + 1)).alias("list"))


def matches(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def plausible(pairs: DataFrame, able: DataFrame) -> DataFrame:
    """The pairs (a, b) with enough equal coordinates."""
    one = able.select(F.col("key").alias("a"), F.col("signature").alias("_a"))
    two = able.select(F.col("key").alias("b"), F.col("signature").alias("_b"))
    return pairs.join(one, "a").join(two, "b").filter(matches(F.col("_a"), F.col("_b")) >= MATCH).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("key").alias("a"), F.col("shingles").alias("_sa"))
    two = sets.select(F.col("key").alias("b"), F.col("shingles").alias("_sb"))
    common = F.size(F.array_intersect("_sa", "_sb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("_c"), (F.size("_sa") + F.size("_sb")).alias("_n"))
    return joined.filter(F.lit(100) * F.col("_c") >= F.lit(percent) * (F.col("_n") - F.col("_c"))).select("a", "b")


def _fits(percent: int, one: str = "_na", two: str = "_nb") -> Column:
    return F.lit(100) * F.least(one, two) >= F.lit(percent) * F.greatest(one, two)


def first_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """Each class with the head of one of its lists, the one it collides with most often."""
    heads = posted.groupBy("list").agg(F.min_by(F.struct("key", "n"), "key").alias("_b"), F.count(F.lit(1)).alias("_count")).filter("_count > 1")
    met = posted.join(heads.select("list", F.col("_b.key").alias("b"), F.col("_b.n").alias("_nb")), "list").withColumnRenamed("n", "_na").filter((F.col("key") != F.col("b")) & _fits(percent))
    met = met.groupBy(F.col("key").alias("a"), "b").agg(F.count(F.lit(1)).alias("_n"))
    return met.groupBy("a").agg(F.max_by("b", F.struct("_n", -F.col("b"))).alias("b"))


def split_lists(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of lists that hold more than one component: list, key, n, home, label, main, main_n.

    main is the component with most entries in the list.
    """
    named = posted.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = cut(named, "named")
    sizes = named.groupBy("list", "label").agg(F.count(F.lit(1)).alias("_n"))
    split = sizes.groupBy("list").agg(F.max_by("label", F.struct("_n", -F.col("label"))).alias("main"), F.max("_n").alias("main_n"), F.count(F.lit(1)).alias("_groups"))
    return cut(named.join(split.filter("_groups > 1").drop("_groups"), "list"), "split-lists")


def second_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each class outside its list's main component with members of that, drawn from three of its lists."""
    clustered = entries.filter("main_n > 1")
    drawn = clustered.filter("label = main").groupBy("list").agg(F.min_by(F.struct("key", "n"), F.xxhash64("key", "list")).alias("_b"))
    met = clustered.filter("label <> main").join(drawn, "list").select(F.col("key").alias("a"), F.col("n").alias("_na"), F.col("_b.key").alias("b"), F.col("_b.n").alias("_nb"), F.xxhash64("list").alias("_at"))
    draws = met.filter(_fits(percent)).groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("_at", "b"))), 1, 3).alias("_draws"))
    return draws.select("a", F.explode("_draws").alias("_d")).select("a", F.col("_d.b").alias("b")).distinct()


def neighbourhoods(entries: DataFrame) -> DataFrame:
    """Classes that still have to meet: place, key, n, label, home, outside, _size (of the place), _outside (how many).

    A place is a list without a component of two, in which all are outside; or a component with all that share a list
    with it.  Two classes meet if they have different labels, one of them is outside, and one is at home.
    """
    clustered = F.col("main_n") > 1
    place = F.when(clustered, F.xxhash64(F.lit(1), F.col("main"))).otherwise(F.xxhash64(F.lit(0), F.col("list")))
    held = entries.select(place.alias("place"), "key", "n", "label", (clustered | F.col("home")).alias("home"), (~clustered | (F.col("label") != F.col("main"))).alias("outside"))
    held = cut(held.distinct(), "neighbourhoods")
    sizes = held.groupBy("place").agg(F.count(F.lit(1)).alias("_size"), F.count_if("outside").alias("_outside"))
    return cut(held.join(sizes.filter("_outside > 0"), "place"), "neighbourhoods")


def third_pairs(around: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """The pairs that meet in small neighbourhoods and have enough equal coordinates."""
    near = around.filter(F.col("_size") <= PAIRED)
    one = near.filter("outside").select("place", F.col("key").alias("a"), F.col("label").alias("_la"), F.col("n").alias("_na"), F.col("home").alias("_ha"))
    two = near.select("place", F.col("key").alias("b"), F.col("label").alias("_lb"), F.col("n").alias("_nb"), F.col("home").alias("_hb"), F.col("outside").alias("_ob"))
    once = ~F.col("_ob") | (F.col("a") < F.col("b"))
    met = one.join(two, "place").filter((F.col("_la") != F.col("_lb")) & once & (F.col("_ha") | F.col("_hb")) & _fits(percent))
    return plausible(met.select("a", "b").distinct(), able)


def _common(percent: int):
    """Links between two blocks of a neighbourhood, from their full sets.

    Rows come sorted by meeting, with one block's classes before those of the other, which are all outside.  Links that
    the others already imply are left out: each one given joins two components that were apart.
    """

    def links(group: pd.DataFrame) -> pd.DataFrame:
        own, outside = group[~group["asks"]], group[group["asks"]]
        if not len(own) or not len(outside):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sizes = own["shingles"].map(len).to_numpy()
        flat = np.concatenate(own["shingles"].to_list())
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(own)), sizes)[order]
        signatures, keys, at_home = np.stack(own["signature"].to_list()), own["key"].to_numpy(), own["home"].to_numpy(bool)
        labels, parts = np.unique(np.concatenate([own["label"].to_numpy(), outside["label"].to_numpy()]), return_inverse=True)
        group_of = np.arange(len(labels))
        mine_at, their_at = parts[: len(own)], parts[len(own) :]
        a, b = [], []
        for key, part, home, mine, signed in zip(outside["key"], their_at, outside["home"], outside["shingles"], outside["signature"], strict=True):
            low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            runs = high - low
            at = np.arange(int(runs.sum())) + np.repeat(low - (np.cumsum(runs) - runs), runs)
            both = np.bincount(owner[at], minlength=len(own))
            hit = np.flatnonzero((100 * both >= percent * (len(mine) + sizes - both)) & (home | at_home) & (group_of[mine_at] != group_of[part]))
            hit = hit[(signatures[hit] == signed).sum(axis=1) >= MATCH]
            for group, i in zip(*np.unique(group_of[mine_at[hit]], return_index=True), strict=True):
                a.append(key)
                b.append(int(keys[hit[i]]))
                group_of[group_of == group] = group_of[part]
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for meeting, part in batch.groupby("meeting", sort=False):
                if held and held[0]["meeting"].iloc[0] != meeting:
                    yield links(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield links(pd.concat(held))
        release_memory()

    return run


def links_around(around: DataFrame, able: DataFrame, texts: DataFrame, *, width: int, percent: int) -> DataFrame:
    """Links in large neighbourhoods, without writing out pairs: their classes are dealt out to blocks, those outside to
    blocks of their own, and each block of the latter meets each of the former in a task of its own."""
    large = cut(around.filter(F.col("_size") > PAIRED), "large")  # its own size decides how texts are joined
    sets = texts.join(large.select("key").distinct(), "key", "left_semi").mapInPandas(_sets(width), "key long, shingles array<long>")
    blocks, askers = F.ceil(F.col("_size") / BLOCK).cast("int"), F.ceil(F.col("_outside") / BLOCK).cast("int")
    dealt = large.join(cut(sets, "sets"), "key").join(able.select("key", "signature"), "key").withColumns({"_blocks": blocks, "_askers": askers})
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = dealt.select("*", F.lit(False).alias("asks"), F.pmod(F.xxhash64("key"), "_blocks").alias("_b"), all_of("_askers").alias("_c"))
    asking = dealt.filter("outside").select("*", F.lit(True).alias("asks"), all_of("_blocks").alias("_b"), F.pmod(F.xxhash64(F.lit(1), "key"), "_askers").alias("_c"))
    columns = [F.xxhash64("place", F.col("_b").cast("long"), F.col("_c").cast("long")).alias("meeting"), "asks", "key", "label", "home", "signature", "shingles"]
    rows = own.select(*columns).unionByName(asking.select(*columns)).repartition("meeting").sortWithinPartitions("meeting", "asks")
    return rows.mapInPandas(_common(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the least id that links reach), kept."""
    facts = cut(features(docs, key=key, text=text, width=width), "features")
    classes = facts.filter("n > 0 AND key IS NOT NULL").groupBy("name").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = cut(classes, "classes")
    able = cut(postings(classes, percent), "postings")
    posted = cut(posting_lists(able), "lists")
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        sets = texts.join(ends, "key", "left_semi").mapInPandas(_sets(width), "key long, shingles array<long>")
        return cut(verified(pairs, cut(sets, "sets"), percent), "links")

    links = links_of(plausible(first_pairs(posted, percent), able))
    more = links_of(plausible(second_pairs(split_lists(posted, components(links)), percent), able))
    links = links.unionByName(more)
    around = neighbourhoods(split_lists(posted, components(links)))
    more = links_of(third_pairs(around, able, percent))
    whole = cut(links_around(around, able, texts, width=width, percent=percent), "links")
    labels = components(links.unionByName(more).unionByName(whole))
    named = classes.select("name", F.col("key").alias("node")).join(labels, "node", "left").select("name", F.coalesce("label", "node").alias("_component"))
    joined = facts.select("key", "n", "name").join(named, "name", "left")
    component = F.coalesce("_component", "key")
    return joined.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2)
