"""Exact n-gram Jaccard join of whole texts with signature trees, as components of linked documents.

1. A text becomes the set of 64-bit hashes of its word shingles. Equal sets form a class, known by a 128-bit digest
   and stood for by its smallest doc_id; partial aggregation collapses copies before the shuffle.
2. Sets are dealt into blocks that no link crosses. All tokens have one order: common ones last, then by hash. A set
   keeps its first tokens, enough that two linked sets share a known number of kept ones (see Bounds). Each kept token
   learns how many sets keep it, which orders them anew, rarest first; a set then names so many of its rarest that two
   linked sets name a token in common. Tokens that one set alone keeps are never named, so a text with enough of its own
   drops out here, whatever passages it shares with others. Blocks are the components of naming a token in common.
3. Within a block, signature trees are built over the whole sets and traversed against each other (signature_tree).
   A block too large for one task is cut into runs of bounded size by set size: each run is joined with itself, some
   sets of every run with each other, and what is not yet in the block's largest component with every run whose sizes
   are close enough. No pair list is built anywhere, and a large group of near copies costs one pass.
4. Components of the links, by alternating large and small stars over tables in the shared folder.

No key gathers a large part of the rows in one task: the tokens that a sample shows to be common are ordered last
without being counted by a shuffle, sets that name a token are reduced to one in each task before they meet, and hot
centres of stars are joined by broadcast.

Edge cases: texts without words have no shingles and are linked with nothing; a text of fewer words than a shingle is
one shingle; copies are linked; rows that repeat an id are one node that holds the sets of all its rows; rows with a
null id take the component of an equal text, else null; texts are read whole; extra columns are ignored, whatever their
names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import ROW, Scratch, map_batches, whole_row
from lexweave.llm.signature_tree import SignatureJoin

#: Tokens of the sets that one task holds of one side of a join (8 bytes each).
RUN_TOKENS = 500_000

#: Sets of each run, in the mean, that go on to the next level of units.
PIVOTS = 40

#: Bits of the id bitmap that is broadcast to skip documents without a block: 16 for each id, 32 MB at most. Beyond that
#: more documents pass than need to, with the same result.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 20, 1 << 28

#: Words whose hash a worker remembers, and texts by which it knows repeated rows, at most.
REMEMBERED = 100_000

#: Common shingles are sought in some SAMPLED texts, whatever the input; they are those that SEEN or more of them have, the
#: MOST_COMMON most frequent at most (8 bytes each, broadcast). They only order tokens: any choice gives the same links.
SAMPLED, SEEN, MOST_COMMON = 20_000, 6, 1_000_000

#: Named tokens that a task gathers before it passes on one set for each.
GATHERED = 500_000

#: Least degree of a hot centre of stars, and how many there are at most (16 bytes each, broadcast).
HOT_DEGREE, MOST_HOT = 1_000, 20_000

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S29)) * _P2
    return x ^ (x >> _S32)


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text: A-Z in lower case, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # in bytes: ASCII case and white space only
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))] if words else [], dtype=np.uint64)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = mixed((out + one[i : i + n]) * _P1)
    return np.unique(out)


class Bounds:
    """How many tokens of a set of n are kept, and how many kept ones it shares with any set that it links to.

    Let A and B link at p percent, and A be the larger one, of n tokens. At least p n / 100 tokens are common. A set keeps
    all but d n / 100 of its tokens (rounded down), the first ones in a common order. If the kept ones of A end first,
    those that B does not keep are among the n - p n / 100 that it has not, and n - d n / 100 - (n - p n / 100) are left; if
    those of B end first, no fewer are left, as B keeps all but d n / 100 or fewer. So they share (p - d) n / 100.
    """

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("similarity must be 50 to 100 percent")
        #: Kept are three times what may differ: a set then has to share two thirds of them.
        self.dropped = max(0, min(99, 100 - 3 * (100 - percent)))
        self.needed = percent - self.dropped

    def kept(self, n):
        return n - self.dropped * n // 100

    def least(self, n):
        return -(-self.needed * n // 100)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def set_digests(documents: DataFrame, *, size: int) -> DataFrame:
    """doc_id, n_shingles and the digest of the set (null: empty) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(text, size, hashes) for text in batch.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None for own in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "n_shingles", "digest"])

    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {_type(documents, 'doc_id')}, n_shingles bigint, digest binary")


def common_shingles(documents: DataFrame, classes: DataFrame, *, size: int, sampled: int = SAMPLED) -> np.ndarray:
    """Sorted hashes of the shingles that many of a sample of the texts of classes have, by the hash of the id."""
    step = max(1, classes.count() // sampled)
    some = lambda df, c: df.where(F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(step)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(text, size, hashes) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], names=["token"])

    chosen = among(some(documents, "doc_id"), some(classes, "rep").select("rep"))
    scratch = Scratch(documents.sparkSession)
    counted = map_batches(chosen.select("text"), run, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counted = scratch.written(counted.where(F.col("n") >= SEEN), "sampled-tokens")
    least, total = SEEN, 0
    for n, tokens in sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True):  # no more rows than SAMPLED texts
        total += tokens
        if total > MOST_COMMON:
            least = n + 1
            break
    tokens = counted.where(F.col("n") >= least).select("token").toArrow()["token"].to_numpy()  # MOST_COMMON at most
    scratch.close()
    return np.sort(tokens.view(np.uint64))


class Seen:
    """Rows of equal id and text that follow each other in a task: all but the first are skipped."""

    def __init__(self):
        self.keys: set = set()

    def __call__(self, doc_id, own: np.ndarray) -> bool:
        key = (doc_id, xxhash.xxh3_64_intdigest(own.tobytes()))
        if key in self.keys:
            return True
        if len(self.keys) >= REMEMBERED:
            self.keys.clear()
        self.keys.add(key)
        return False


#: The count of a token that is common.
UNCOUNTED = 2**31 - 1


def kept_tokens(documents: DataFrame, classes: DataFrame, common: np.ndarray, *, size: int, percent: int) -> DataFrame:
    """node, token and common: the kept tokens of the texts of classes (and of a few copies of them)."""
    shared = documents.sparkSession.sparkContext.broadcast(common.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bounds, seen = WordHashes(), Bounds(percent), Seen()
        frequent = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            nodes, tokens, flags = [], [], []
            for node, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = shingles(text, size, hashes)
                if not len(own) or seen(node, own):
                    continue
                keep = int(bounds.kept(len(own)))
                if len(frequent):
                    at = np.searchsorted(frequent, own)
                    at[at == len(frequent)] = 0
                    is_common = frequent[at] == own
                    rare = own[~is_common][:keep]
                    rest = own[is_common][: keep - len(rare)]
                else:
                    rare, rest = own[:keep], own[:0]
                nodes.append(np.full(keep, node, np.int64))
                tokens += [rare, rest]
                flags += [np.zeros(len(rare), bool), np.ones(len(rest), bool)]
            joined = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)])
            yield pa.RecordBatch.from_arrays([pa.array(joined(nodes, np.int64)), pa.array(joined(tokens, np.uint64).view(np.int64)), pa.array(joined(flags, bool))], names=["node", "token", "common"])

    chosen = among(documents.select("doc_id", "text"), classes.select("rep"))
    return map_batches(chosen, run, "node bigint, token bigint, common boolean")


def named_tokens(counted: DataFrame, percent: int) -> DataFrame:
    """counted: node, n, token, for each class a row with n = 0 and its set's size as token, and a row for each kept token
    that n > 1 sets keep. token, a, b: a set that names a token (b null), or two sets that do (token is then of no use).
    """

    def combined(token: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        """One set for each token, and that the others name it too."""
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        first = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.empty(0, bool)
        head = node[np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))] if len(node) else node
        edges = np.unique(np.stack([node[~first], head[~first]]), axis=1) if len(node) else np.empty((2, 0), np.int64)
        edges = edges[:, edges[0] != edges[1]]
        spread = mixed(edges[0].astype(np.uint64) * _P1 + edges[1].astype(np.uint64)).view(np.int64)
        b = pa.array(np.concatenate([node[first], edges[1]]), mask=np.concatenate([np.ones(int(first.sum()), bool), np.zeros(edges.shape[1], bool)]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([token[first], spread])), pa.array(np.concatenate([node[first], edges[0]])), b], names=["token", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, named, gathered = Bounds(percent), [], 0
        node = n = token = np.empty(0, np.int64)

        def choose(node: np.ndarray, n: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(node):
                return token, node
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(node)]]))
            known = n[starts] == 0  # else no class: a copy that passed the filter
            shared = sizes - 1
            most = np.where(known, shared - bounds.least(np.where(known, token[starts], 1)) + 1, -1)
            place = np.arange(len(node)) - np.repeat(starts, sizes)
            chosen = (n > 0) & (place <= np.repeat(most, sizes))
            return token[chosen], node[chosen]

        for batch in batches:
            node, n, token = (np.concatenate([old, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for old, c in ((node, "node"), (n, "n"), (token, "token")))
            if not len(node):
                continue
            last = int(np.searchsorted(node, node[-1]))  # rows of the last node may go on in the next batch
            named.append(choose(node[:last], n[:last], token[:last]))
            node, n, token = node[last:], n[last:], token[last:]
            gathered += len(named[-1][0])
            if gathered >= GATHERED:
                yield combined(*map(np.concatenate, zip(*named)))
                named, gathered = [], 0
        named.append(choose(node, n, token))
        yield combined(*map(np.concatenate, zip(*named)))

    dealt = counted.select("node", "n", "token").repartition("node").sortWithinPartitions("node", "n", "token")
    return map_batches(dealt, run, "token bigint, a bigint, b bigint")


def candidate_edges(documents: DataFrame, classes: DataFrame, common: np.ndarray, *, size: int, percent: int) -> DataFrame:
    """a, b: stars whose components are the blocks. classes: rep, n_shingles."""
    kept = kept_tokens(documents, classes, common, size=size, percent=percent)
    # common tokens are not counted: dealt by node, so that no task gets them all
    by = F.when(F.col("common"), F.xxhash64("node", "token")).otherwise(F.col("token"))
    count = F.count(F.lit(1)).over(Window.partitionBy("key"))
    counted = kept.select("node", "token", "common", by.alias("key")).select("node", F.when(F.col("common"), F.lit(UNCOUNTED)).otherwise(count).cast("int").alias("n"), "token").where("n > 1")
    heads = classes.select(F.col("rep").alias("node"), F.lit(0).alias("n"), F.col("n_shingles").alias("token"))
    named = named_tokens(heads.unionByName(counted), percent)
    # each task has reduced a token to one set, so a window holds a row for each task at most
    first = F.min("a").over(Window.partitionBy("token"))
    return named.select("a", F.coalesce("b", first).alias("b")).where("a <> b").distinct()


def with_least(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """edges with m of least (key, m, degree). Keys with many edges are joined by broadcast, so that no task gets all edges
    of one; as their degrees add up to the number of edges, there are MOST_HOT at most."""
    total = least.agg(F.sum("degree")).first()[0] or 0
    hot = F.col("degree") > max(HOT_DEGREE, total // MOST_HOT)
    name = lambda df: df.select(F.col(key).alias("_key"), "m")
    known = edges.join(F.broadcast(name(least.where(hot))), F.col(key) == F.col("_key"), "left")
    cold = known.where("m is null").select(*edges.columns).join(name(least.where(~hot)), F.col(key) == F.col("_key"))
    return known.where("m is not null").select(*edges.columns, "m").unionByName(cold.select(*edges.columns, "m"))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for each node of edges (a, b) that is not its own root.

    Alternating stars: every round writes tables in the shared folder and removes those before; the rounds grow with the
    logarithm of the input.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("degree")), "least")
        large = scratch.written(with_least(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-stars")
        low = scratch.written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")), "low")
        moved = with_least(large, low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.written(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
        scratch.remove(edges, least, large, low)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def in_filter(key: Column, ids: DataFrame, df: DataFrame) -> DataFrame:
    """df with `maybe` (df has no such column): false for rows whose key is surely not among ids (one column), true for all
    that are there and a few others. The filter is a bitmap of bounded size."""
    bits = LEAST_FILTER_BITS
    n = ids.count()
    while bits < MOST_FILTER_BITS and bits < 16 * n:
        bits *= 2
    slot = lambda c: F.pmod(F.xxhash64(c.cast("bigint")), F.lit(bits))
    own = slot(F.col(ids.columns[0]))
    flags = ids.groupBy(F.bitmap_bucket_number(own).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("_bits"))
    joined = df.join(F.broadcast(flags), F.bitmap_bucket_number(slot(key)) == F.col("_bucket"), "left")
    at = F.bitmap_bit_position(slot(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2
    return joined.withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_bits")


def among(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose id is among ids (one column), and of a few others."""
    return in_filter(F.col("doc_id"), ids, documents.select("doc_id", "text")).where("maybe").select("doc_id", "text")


def sets_of(documents: DataFrame, ids: DataFrame, *, size: int) -> DataFrame:
    """node and hashes (8 bytes each, sorted) of the documents among ids, and of a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), Seen()
        for batch in batches:
            found = [(node, shingles(text, size, hashes)) for node, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            found = [(node, own.tobytes()) for node, own in found if not seen(node, own)]
            yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in found], pa.int64()), pa.array([own for _, own in found], pa.binary())], names=["node", "hashes"])

    return map_batches(among(documents, ids), run, "node bigint, hashes binary")


def joined_units(rows: DataFrame, percent: int) -> DataFrame:
    """rows: block, i, j (the unit), side (0, or 1 for the second tree), node, hashes. Edges (a, b) of each unit: the
    links' components. A unit has at most two sides of bounded size, and tasks hold one unit at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(sides: tuple[list, list]) -> pa.RecordBatch:
            join = SignatureJoin(percent)
            left, right = (join.tree(side) for side in sides)
            join.join(left, left if right is None else right)
            links = join.links()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

        unit, sides = None, ([], [])
        for batch in batches:
            for block, i, j, side, node, hashes in zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j", "side", "node", "hashes"))):
                if (block, i, j) != unit:
                    if sides[0]:
                        yield solved(sides)
                    unit, sides = (block, i, j), ([], [])
                sides[side].append((node, np.frombuffer(hashes, np.uint64)))
        if sides[0]:
            yield solved(sides)

    dealt = rows.select("block", "i", "j", "side", "node", "hashes").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "side")
    return map_batches(dealt, run, "a bigint, b bigint")


def block_links(scratch: Scratch, sets: DataFrame, blocks: DataFrame, percent: int, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """sets: node, hashes. blocks: node, block. Node and root of every node that is not the root of its component."""
    tokens = F.octet_length("hashes") / 8
    sized = scratch.written(sets.join(blocks, "node").select("block", "node", "hashes", tokens.cast("bigint").alias("n")), "block-sets")
    weights = sized.groupBy("block").agg(F.sum("n").alias("weight"))
    hot = scratch.written(weights.where(F.col("weight") > run_tokens).select(F.col("block").alias("hot"), "weight"), "hot-blocks")
    none = F.lit(0).cast("bigint")
    calm = sized.join(hot, F.col("block") == F.col("hot"), "left_anti").select("block", none.alias("i"), none.alias("j"), F.lit(0).alias("side"), "node", "hashes")
    links = joined_units(calm, percent).select(F.col("a").alias("node"), F.col("b").alias("root"))
    if hot.isEmpty():
        return links
    return links.unionByName(components(hot_links(scratch, sized, hot, percent, run_tokens)))


def hot_links(scratch: Scratch, sized: DataFrame, hot: DataFrame, percent: int, run_tokens: int) -> DataFrame:
    """Edges (a, b) of the blocks that are too large for one task."""
    large = sized.join(hot, F.col("block") == F.col("hot")).drop("hot")
    # runs by size of set: buckets of sizes are added up, so no task sorts a block; a bucket beyond a run is dealt by hash
    buckets = large.groupBy("block", F.floor(F.log("n") * 20).alias("bucket")).agg(F.sum("n").alias("tokens"), F.min("n").alias("low"), F.max("n").alias("high"))
    cut = buckets.select("block", "bucket", "low", "high", F.ceil(F.col("tokens") / run_tokens).alias("pieces"))
    named = lambda piece: F.col("bucket") * 1_000_000 + piece
    in_run = F.pmod(F.xxhash64("node"), F.col("pieces"))
    placed = scratch.written(large.withColumn("bucket", F.floor(F.log("n") * 20)).join(cut, ["block", "bucket"]).select("block", named(in_run).alias("run"), "low", "high", "node", "n", "hashes"), "runs")
    runs = scratch.written(cut.select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), "bucket", "low", "high").select("block", named(F.col("piece")).alias("run"), "low", "high"), "run-list")
    own = placed.select("block", F.col("run").alias("i"), F.col("run").alias("j"), F.lit(0).alias("side"), "node", "hashes")
    first = scratch.written(joined_units(own.unionByName(pivots(placed, run_tokens)), percent), "run-links")
    roots = scratch.written(components(first), "run-roots")
    labelled = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    most = labelled.groupBy("block", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("block").agg(F.max_by("root", "size").alias("main"))
    rest = scratch.written(labelled.join(most, "block").where("root <> main").select("block", "run", "low", "high", "node", "hashes"), "rest")
    queries = rest.select("block", F.col("run").alias("q"), F.col("low").alias("q_low"), F.col("high").alias("q_high")).distinct()
    close = (F.col("high") * 100 >= F.col("q_low") * percent) & (F.col("q_high") * 100 >= F.col("low") * percent)
    pairs = scratch.written(queries.join(runs, "block").where(close & (F.col("q") != F.col("run"))).select("block", "q", "run"), "run-pairs")
    asked = rest.withColumnRenamed("run", "q").join(pairs, ["block", "q"]).select("block", F.col("q").alias("i"), F.col("run").alias("j"), F.lit(0).alias("side"), "node", "hashes")
    against = placed.join(pairs, ["block", "run"]).select("block", F.col("q").alias("i"), F.col("run").alias("j"), F.lit(1).alias("side"), "node", "hashes")
    return first.unionByName(joined_units(asked.unionByName(against), percent))


def pivots(placed: DataFrame, run_tokens: int) -> DataFrame:
    """Units in which some sets of all runs of a block meet, those of near sizes together. Level by level a fixed part of
    the sets goes on, chosen and dealt by hash, until what is left of a block fits in one unit; no unit is larger than a
    run, and all levels together have no more sets than the runs."""
    near = placed.withColumn("near", F.floor(F.log("n") * 4))
    pieces = near.groupBy("block", "near").agg(F.ceil(F.sum("n") / run_tokens).cast("bigint").alias("pieces"))
    each = F.greatest(F.lit(2), F.floor(F.lit(run_tokens / PIVOTS) / F.exp((F.col("near") + 1) / 4))).cast("double")
    part = lambda level: F.pow(each, level.cast("double"))
    left = lambda level: F.ceil(F.col("pieces") / part(level))
    chosen = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    levels = F.filter(F.sequence(F.lit(1), F.lit(40)), lambda level: (chosen * part(level) < 1) & ((level == 1) | (left(level - 1) > 1)))
    dealt = near.join(pieces, ["block", "near"]).select("block", "near", "pieces", "node", "hashes", F.explode_outer(levels).alias("level")).where("level is not null")
    unit = F.col("near") * 1_000_000_000 + F.pmod(F.xxhash64("node", "level"), left(F.col("level")))
    return dealt.select("block", (-F.col("level")).cast("bigint").alias("i"), unit.cast("bigint").alias("j"), F.lit(0).alias("side"), "node", "hashes")


def link_documents(documents: DataFrame, *, size: int, percent: int, run_tokens: int = RUN_TOKENS, sampled: int = SAMPLED) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents link when 100 times the common shingles are at least
    `percent` times all their shingles; component_id is the smallest doc_id reachable by links."""
    scratch = Scratch(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    rows = scratch.written(set_digests(documents, size=size), "set-digests")
    repeated = rows.where("doc_id is not null and digest is not null").groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("several"))
    if repeated.where("several").isEmpty():
        out = linked_rows(scratch, documents, rows, size=size, percent=percent, run_tokens=run_tokens, sampled=sampled)
    else:
        out = linked_repeated(scratch, documents, size=size, percent=percent, run_tokens=run_tokens, sampled=sampled)
    result = scratch.written(out, "linked")
    scratch.close(result)
    return result


def linked_rows(scratch: Scratch, documents: DataFrame, rows: DataFrame, *, size: int, percent: int, run_tokens: int, sampled: int) -> DataFrame:
    """link_documents for rows (of set_digests) where an id has one text."""
    ids = rows.where("doc_id is not null and digest is not null")
    classes = scratch.written(ids.groupBy("digest").agg(F.min("doc_id").cast("bigint").alias("rep"), F.first("n_shingles").alias("n_shingles")), "classes")
    known = documents.where("doc_id is not null")
    common = common_shingles(known, classes, size=size, sampled=sampled)
    stars = scratch.written(components(candidate_edges(known, classes, common, size=size, percent=percent)), "candidates")
    roots = stars.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("block"))
    blocks = scratch.written(stars.select("node", F.col("root").alias("block")).unionByName(roots), "blocks")
    links = scratch.written(block_links(scratch, sets_of(known, blocks.select("node"), size=size), blocks, percent, run_tokens), "links")
    labels = classes.select("digest", "rep").join(links, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", F.col("doc_id").cast("bigint")).alias("component_id"))


def linked_repeated(scratch: Scratch, documents: DataFrame, *, size: int, percent: int, run_tokens: int, sampled: int) -> DataFrame:
    """link_documents where an id has several texts: rows are numbered and linked, and components that share an id are one."""
    numbered = scratch.written(documents.select(F.monotonically_increasing_id().alias("n"), "doc_id", "text"), "numbered")
    alone = numbered.where("doc_id is not null").select(F.col("n").alias("doc_id"), "text")
    rows = scratch.written(set_digests(alone, size=size), "row-digests")
    found = scratch.written(linked_rows(scratch, alone, rows, size=size, percent=percent, run_tokens=run_tokens, sampled=sampled).select(F.col("doc_id").alias("n"), "n_shingles", "component_id"), "row-links")
    named = scratch.written(numbered.select("n", "doc_id").join(found, "n"), "named-rows")
    with_words = named.where("n_shingles > 0")
    least = with_words.groupBy("doc_id").agg(F.min("component_id").alias("least"))
    roots = components(with_words.join(least, "doc_id").select(F.col("component_id").alias("a"), F.col("least").alias("b")))
    merged = scratch.written(with_words.join(roots, F.col("component_id") == F.col("node"), "left").select("n", "doc_id", "n_shingles", F.coalesce("root", "component_id").alias("component")), "merged-rows")
    labels = merged.groupBy("component").agg(F.min("doc_id").cast("bigint").alias("component_id"))
    known = merged.join(labels, "component")
    digests = scratch.written(set_digests(numbered.where("doc_id is null").select(F.col("n").alias("doc_id"), "text"), size=size), "null-digests")
    of_text = rows.join(known.select(F.col("n").alias("doc_id"), "component_id"), "doc_id").groupBy("digest").agg(F.min("component_id").alias("component_id"))
    nameless = digests.join(of_text, "digest", "left").select(F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"), "n_shingles", "component_id")
    empty = named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").cast("bigint").alias("component_id"))
    return known.select("doc_id", "n_shingles", "component_id").unionByName(empty).unionByName(nameless)


def keep_one(documents: DataFrame, *, size: int, percent: int) -> DataFrame:
    """The rows of documents but for all documents of each component other than the one with the smallest id. Of the rows
    that repeat that id the one with the smallest text (then the smallest JSON) stays; rows without an id, or
    without a shingle, all stay. Columns stay, whatever their names.

    Only documents that the id bitmap cannot clear are shuffled: those that go, those with a repeated id, and a few more.
    """
    linked = link_documents(documents, size=size, percent=percent)
    found = linked.where("doc_id is not null and n_shingles > 0").select("doc_id", "component_id")
    scratch = Scratch(documents.sparkSession)
    per_id = scratch.written(found.groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("n")).where("component <> doc_id or n > 1"), "duplicates")
    empty = F.coalesce(~F.col(f"{ROW}.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    marked = in_filter(F.col(f"{ROW}.doc_id"), per_id.select("doc_id"), documents.select(whole_row(documents)))
    clear = marked.where(~F.col("maybe")).select(ROW)
    doubt = marked.where("maybe").select(ROW, empty.alias("empty")).join(per_id.withColumnRenamed("doc_id", "id"), F.col(f"{ROW}.doc_id") == F.col("id"), "left")
    single = doubt.where("id is null or empty").select(ROW)
    repeated = doubt.where("component = id and not empty").groupBy("id").agg(F.min_by(ROW, F.struct(f"{ROW}.text", F.to_json(ROW))).alias(ROW)).select(ROW)
    return clear.unionByName(single).unionByName(repeated).select(f"{ROW}.*")
