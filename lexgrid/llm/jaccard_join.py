"""N-gram Jaccard join: texts whose sets of word shingles overlap enough are linked, and links make components.

T-occurrence search in the manner of DivideSkip. Two linked sets share T shingles at least, T by their sizes. All sets order
their shingles in one way, rare ones first, and are posted in the inverted lists of the first n - T + 1 only. For each set the
short lists are merged with a heap that counts how often other sets occur; those that can still reach T then have the shingles
left out of the merge, the ones of long lists, probed by binary search.

Equal sets are one class throughout. Before the search, sets of a list are compared with the list's most central set and
contracted into components where that links them, then with the next central one, as long as this pays; only sets of
different components are searched. So a group of near copies is not expanded into its pairs, and no link between different
components is missed.

The order is by the number of sets that hold a shingle, counted over all sets that may have a partner. Which may have one is
told by a first count over short prefixes in the order of the codes: a set with a partner has several of these shingles in
common with others. Both counts cover all documents and take one shuffle by the shingle. Shingles that are common already among
SAMPLE sets stay out of it, so no task gets a common one: the first count knows them to be shared, and the order, which any
rule may give, puts them last, by their number in the sample.

Style: Arrow functions make the sets (vectorised over the bytes, in pieces of PIECE), merge and probe; DataFrame functions
count, join and find components by alternating large and small stars, on tables written to the shared folder. Nothing about
all documents reaches the driver. Shingles are told apart by 64-bit codes. Classes have 128 bits; half of them name a class,
and if two classes had one name all would be named anew.

Defined cases: null and blank texts have no shingles and link with nothing; a text of fewer words than a shingle is one shingle.
Equal rows are equal sets and share a component. A repeated id with different texts gives a row for each. An empty table gives
no rows. Whole texts are read, however long. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import count, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.llm.common import BROADCAST_ROWS, Workspace, lower_ascii, words

#: A list is short up to SHORT sets. Rounds of central sets go on while the search would read over WORTH entries for each posted one.
WORDS, PERCENT, SHORT, WORTH = 5, 80, 64, 8
#: A shingle is common if so many of the sets in a sample of that size hold it.
COMMON, SAMPLE = 10, 20_000
#: Bytes hashed at once.
PIECE = 2**20

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[32, *range(9, 14)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
BLANK = re.compile(rb"[ \t-\r]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes start, and their codes: polynomials in the lower-cased bytes."""
    b = LOWERED[np.frombuffer(data, dtype=np.uint8)]
    blank = IS_BLANK[b]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    place = np.zeros(len(b), dtype=np.int64)
    place[starts[0] :] = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    place[blank] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, MULTIPLIER))
    terms = np.where(blank, np.uint64(0), (b.astype(np.uint64) + np.uint64(1)) * powers[place])
    return starts, mixed(np.add.reduceat(terms, starts))


def text_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word codes of all texts, and where each text's begin."""
    data = b" ".join(texts)
    starts, codes, at = [], [], 0
    while at < len(data):
        cut = BLANK.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        s, c = word_codes(data[at:end])
        starts.append(s + at)
        codes.append(c)
        at = end
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not starts:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    return np.concatenate(codes), np.searchsorted(np.concatenate(starts), ends)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct codes (64 bits, signed) of each text's shingles."""

    def chain(parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(parts[0]), len(parts), dtype=np.uint64)
        for p in parts:
            h = mixed(h * MULTIPLIER + p)
        return h.view(np.int64)

    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= PIECE):
            n += len(texts[j]) + 1
            j += 1
        w, first = text_codes(texts[i:j])
        several = chain([w[k : len(w) - size + 1 + k] for k in range(size)]) if len(w) >= size else None
        for a, b in zip(first, first[1:]):
            if b - a >= size:
                yield np.unique(several[a : b - size + 1])
            else:
                yield chain([w[k : k + 1] for k in range(a, b)]) if b > a else np.zeros(0, dtype=np.int64)
        i = j


def name(codes: np.ndarray, salt: int) -> tuple[int, int]:
    """128 bits that tell sets apart, as two longs."""
    return tuple(np.frombuffer(hashlib.blake2b(codes.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest(), dtype=np.int64).tolist())


def told(rows: DataFrame, size: int, percent: int, salt: int) -> DataFrame:
    """(id, c, c2, n, prefix) of (id, text): the set's names and size, and the smallest codes, as many as the first count posts."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            names, sizes, prefixes = [], [], []
            for s in shingle_sets(texts, size):
                names.append(name(s, salt))
                sizes.append(len(s))
                prefixes.append(s[: first_posted(len(s), percent)])
            both = np.array(names, dtype=np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, prefixes)]).astype(np.int32), np.concatenate([np.zeros(0, dtype=np.int64), *prefixes]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes, pa.int32()), lists], names=["id", "c", "c2", "n", "prefix"])

    return rows.mapInArrow(run, f"id {kind}, c long, c2 long, n int, prefix array<long>")


def full_sets(rows: DataFrame, size: int, salt: int) -> DataFrame:
    """(c, n, arr) of (text): whole sets of texts that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for s in shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], size) if len(s)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate([np.zeros(0, dtype=np.int64), *found]))
            yield pa.RecordBatch.from_arrays([pa.array([name(s, salt)[0] for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int32()), lists], names=["c", "n", "arr"])

    return rows.select("text").mapInArrow(run, "c long, n int, arr array<long>")


def share_of(n: int, percent: int) -> int:
    """The smallest overlap of a set of this size with a partner, and the smallest size of a partner."""
    return -(-n * percent // 100)


def met_twice(n: int) -> int:
    """How many shingles of the first count's prefix a set of this size must share with a partner."""
    return max(1, n // 10)


def first_posted(n: int, percent: int) -> int:
    """How many shingles the first count posts: with so many, two linked sets share met_twice of the smaller one's size."""
    return min(n, n - share_of(n, percent) + met_twice(n))


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """T: the smallest overlap with which sets of these sizes are linked."""
    return F.ceil((a + b) * percent / (100.0 + percent) - 1e-9)


def either(df: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A join with a table of keys, broadcast if a count finds them few."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, on, how)


def shared(entries: DataFrame, n_sets: int, space: Workspace) -> DataFrame:
    """Those of the entries (c, h, ...) whose h stands in two sets or more, with m, their number, and common, whether m counts the sample only."""
    step = max(1, n_sets // SAMPLE)
    common = space.keep(entries.where(F.pmod("c", F.lit(step)) == 0).groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") >= COMMON))
    rest = either(entries, common, "h", "left_anti").withColumn("m", F.count("*").over(W.partitionBy("h"))).where("m > 1")
    return either(entries, common, "h", "inner").withColumn("common", F.lit(True)).unionByName(rest.withColumn("common", F.lit(False)))


def connect(edges: DataFrame, space: Workspace) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the smallest vertex of its component. Alternates large and small stars."""
    now = space.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = space.keep(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        new = space.keep(small)
        was, sign = sign, new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()
        space.drop(now, large)
        now = new
        if sign == was:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))


def verify(pairs: DataFrame, sets: DataFrame, space: Workspace, percent: int) -> DataFrame:
    """Of the distinct pairs (a, b) of classes, those linked: the smaller set is probed in the larger by binary search."""
    one = pairs.join(sets.select(F.col("c").alias("a"), F.col("arr").alias("x")), "a")
    two = one.join(sets.select(F.col("c").alias("b"), F.col("arr").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for k in ("x", "y"):
                col = batch.column(k)
                sides.append((col.offsets.to_numpy(), col.values.to_numpy()))
            (xo, xv), (yo, yv) = sides
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                linked[i] = int((y[at] == x).sum()) * (100 + percent) >= (len(x) + len(y)) * percent
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return space.keep(two.mapInArrow(run, "a long, b long"))


def fits(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Whether sets of these sizes that meet at these places of theirs can reach the overlap with what is left of both."""
    return F.least(n1 - p1, n2 - p2) >= least_overlap(n1, n2, percent)


def merge_short(queries: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of (a, n, r, other, lists): each of the lists is (pos, ids, places, roots), sorted by ids.

    A heap merges the ids of all lists of a query. One that occurs k times, last at some places of both sets, can share k and
    what follows these places; up to `other` further ones may lie before, in lists that are not merged here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for a, n, r, others, lists in zip(*(batch.column(k).to_pylist() for k in ("a", "n", "r", "other", "lists"))):
                streams = [zip(x["ids"], x["places"], x["roots"], repeat(x["pos"])) for x in lists]
                for b, met in groupby(heapq.merge(*streams), key=lambda e: e[0]):
                    k, last_a, last_b, other, m = 0, -1, -1, r, 0
                    for _, place, other, pos in met:
                        m, at = place >> 32, place & 0xFFFFFFFF
                        if min(n - pos, m - at) >= -(-(n + m) * percent // (100 + percent)):
                            k, last_a, last_b = k + 1, max(last_a, pos), max(last_b, at)
                    if k and other != r:
                        least = -(-(n + m) * percent // (100 + percent))
                        if k + others + min(n - 1 - last_a, m - 1 - last_b) >= least:
                            left.append(min(a, b))
                            right.append(max(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return queries.select("a", "n", "r", "other", "lists").mapInArrow(run, "a long, b long")


def class_links(sets: DataFrame, space: Workspace, percent: int) -> DataFrame:
    """(v, root) for the classes in components of two or more, of whole sets (c, n, arr)."""
    entries = sets.select("c", "n", F.explode("arr").alias("h"))
    found = shared(entries, sets.count(), space).groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("common", "m", "h"))).alias("g"))
    # Shingles of no other set come first, then shared ones by their counts.
    alone = F.col("n") - F.size("g")
    posted = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    posts = found.where(alone < posted).select("c", "n", alone.alias("start"), F.posexplode(F.slice("g", F.lit(1), (posted - alone).cast("int"))).alias("i", "e"))
    posts = space.keep(posts.select(F.col("e.h").alias("h"), "c", "n", (F.col("start") + F.col("i")).cast("int").alias("pos")))
    # An entry is of use if the smallest set of its list is not too large for what is left of it.
    reach = F.floor(((F.col("n") - F.col("pos")) * (100 + percent) - F.col("n") * percent) / float(percent) + 1e-9)
    low = posts.groupBy("h").agg(F.min("n").alias("low"), F.count("*").alias("m")).where("m > 1")
    useful = space.keep(posts.join(low, "h").where(reach >= F.col("low")).drop("low", "m"))
    space.drop(posts)
    # The most central class of a list: the one that meets most others over all its lists.
    sizes = useful.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    several = space.keep(useful.join(sizes, "h"))
    degree = several.groupBy("c").agg(F.sum("m").alias("deg"))
    posts = space.keep(several.join(degree, "c").select("h", "c", "n", "pos", "deg"))
    space.drop(useful, several)
    edges, roots, now = None, None, space.keep(posts.withColumn("r", F.col("c")))
    while True:
        tops = now.groupBy("h", "r").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "r")).alias("top"), F.sum("k").alias("m"), F.count("*").alias("roots"))
        open_ = space.keep(tops.where("roots > 1").select("h", "m", F.col("top.r").alias("main"), (F.col("m") - F.col("top.k")).alias("minor")))
        work = open_.agg(F.sum(F.col("m") * F.col("minor"))).first()[0]
        if work is None:
            return roots if roots is not None else sets.select(F.col("c").alias("v"), F.col("c").alias("root")).limit(0)
        if roots is not None and (not linked or work <= WORTH * now.count()):
            break
        centre = now.join(open_.select("h"), "h").groupBy("h").agg(F.max(F.struct("deg", "c", "r", "n", "pos")).alias("t")).select("h", "t.c", "t.r", "t.n", "t.pos").toDF("h", "b", "r2", "n2", "pos2")
        centre = space.keep(centre)
        star = now.join(centre, "h").where((F.col("r") != F.col("r2")) & fits(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), percent))
        found = verify(star.select(F.col("c").alias("a"), "b").distinct(), sets, space, percent)
        linked = not found.isEmpty()
        edges = found if edges is None else edges.unionByName(found)
        roots = connect(edges, space)
        # All pairs of a centre in its list are settled, so it leaves the list.
        rest = now.drop("r").join(centre.select("h", F.col("b").alias("c")), ["h", "c"], "left_anti")
        was, now = now, space.keep(rest.join(roots.withColumnRenamed("v", "c"), "c", "left").select("h", "c", "n", "pos", "deg", F.coalesce("root", "c").alias("r")))
        space.drop(was, centre, open_)
    # The search: in each open list, entries of other components than the main one against all.
    live = space.keep(now.join(open_, "h"))
    minor = live.where(F.col("r") != F.col("main"))
    short = F.col("m") <= SHORT
    member = F.struct("c", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("place"), "r")
    lists = live.where(short).groupBy("h").agg(F.sort_array(F.collect_list(member)).alias("e"))
    one = F.struct("pos", F.col("e.c").alias("ids"), F.col("e.place").alias("places"), F.col("e.r").alias("roots"))
    # Lists that a query does not merge: long ones, and those in which it is of the main component and met by the others.
    n_all = live.groupBy(F.col("c").alias("a")).agg(F.count("*").cast("int").alias("all"))
    queries = minor.where(short).join(lists, "h").groupBy(F.col("c").alias("a"), "n", "r").agg(F.collect_list(one).alias("lists"))
    queries = queries.join(n_all, "a").withColumn("other", F.col("all") - F.size("lists"))
    candidates = merge_short(queries, percent)
    # Long lists are not merged: entries that can still reach T in one are probed as they are.
    left, right = minor.where(~short), live.where(~short).select("h", *[F.col(x).alias(x + "2") for x in ("c", "n", "pos", "r")])
    once = (F.col("r2") == F.col("main")) | (F.col("c") < F.col("c2"))
    met = left.join(right, "h").where((F.col("r") != F.col("r2")) & once & fits(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), percent))
    pairs = candidates.unionByName(met.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b"))).distinct()
    found = verify(space.keep(pairs), sets, space, percent)
    return connect(edges.unionByName(found), space)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """(key, n_shingles, class_id, component_id): class_id is the smallest id with the same set, component_id that of its component."""
    space = Workspace(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    for salt in count():
        all_ = space.keep(told(rows, size, percent, salt))
        filled = all_.where("n > 0")
        classes = space.keep(filled.groupBy("c", "c2").agg(F.min("id").alias("class"), F.first("n").alias("n")))
        if classes.groupBy("c").count().where("count > 1").isEmpty():
            break
        space.drop(all_, classes)
    copies = filled.join(classes.select("c", "class"), "c").where("NOT (id <=> class)").select("id", "c").distinct()
    kept = either(filled, copies, ["id", "c"], "left_anti").select("c", F.explode("prefix").alias("h"))
    # The first count: which sets share enough of their prefixes with others.
    hits = shared(kept, classes.count(), space).groupBy("c").agg(F.count("*").alias("k")).join(classes.select("c", "n"), "c")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100.0 - 1e-9) / 10))
    met = space.keep(hits.where(F.col("k") >= least).select("c"))
    firsts = space.keep(classes.join(met, "c").select(F.col("class").alias("first")).distinct())
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(firsts) if few else firsts, F.col("id").eqNullSafe(F.col("first")), "left_semi")
    sets = space.keep(full_sets(texts, size, salt).join(met, "c", "left_semi").dropDuplicates(["c"]))
    space.drop(firsts, met)
    roots = class_links(sets, space, percent)
    named = classes.join(roots, classes["c"] == roots["v"], "left").withColumn("root", F.coalesce("root", "c")).select("c", "class", "root")
    lows = named.groupBy("root").agg(F.min("class").alias("component"))
    ids = space.keep(named.join(lows, "root").select("c", "class", "component"))
    # A text without shingles is alone.
    out = filled.join(ids, "c").select("id", "n", "class", "component").unionByName(all_.where("n = 0").select("id", "n", F.col("id").alias("class"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("class").alias("class_id"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """The documents of which none with a smaller id is in their component, with the columns they came with; of rows that repeat an id and its words one stays."""
    found = components(docs, key, text, percent, size)
    gone = found.where(f"`{key}` <> component_id").select(key).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = either(docs, gone, key, "left_anti").select(*columns)
    again = found.where("n_shingles > 0").groupBy(key, "class_id").count().where("count > 1").select(key).distinct()
    if again.isEmpty():
        return kept
    told_words = F.array_join(words(lower_ascii(F.col(f"`{text}`"))), " ")
    some = either(kept, again, key, "left_semi").select(F.struct(*columns).alias("row"), F.col(f"`{key}`").alias("k"), told_words.alias("w"))
    once = some.where("w <> ''").dropDuplicates(["k", "w"]).unionByName(some.where("w = ''"))
    return either(kept, again, key, "left_anti").select(*columns).unionByName(once.select("row.*"))
