"""Operator 10, n-gram Jaccard join with signature trees, and the classes that its links make.

A text's set holds the 64-bit hashes of its distinct word shingles. Texts with equal sets are one
entry. Two sets that reach the threshold share one of the first (1 - t) of their shingles in any
common order, so entries meet in buckets of those shingles; shingles that many texts share come last
in the order, which keeps buckets small. Buckets with the same entries are one bucket, with the number of its
shingles. Each bucket has a signature tree (nodes with OR-combined bitmaps and size ranges, entries in order of
size), traversed against itself; a node pair falls where its largest possible overlap misses the
threshold. A pair out of buckets of up to ``leaf`` entries must also meet in as many shingles as prefixes of
partners share. Pairs that pass are verified exactly.

A bucket of near copies has a square of pairs, but classes need fewer links: the first traversal skips
what its own earlier pairs connect and marks buckets where it skipped something. Where verified links
leave such a bucket in several classes, a second traversal returns every pair between classes. So no
link between classes is lost, and no group is expanded into all pairs. Buckets over ``block`` entries
are cut into blocks by size, and dealt as those pairs of blocks whose sizes are within reach. A shingle, a set or a
class of over ``hot`` rows is looked up by broadcast, so that none of them fills a task.

Defined results: a null text, or one without words, has an empty set and is alone; fewer words than the
shingle size make one shingle of all; repeated rows and ids return as often as they occur; an empty
table gives an empty result; further columns are ignored. Long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, small_batches, stage
from .components import components

#: Sets from SMALL_SET on must share SHARED shingles of their prefixes, smaller ones one.
SMALL_SET, SHARED = 40, 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> 64-bit hash of its lower-cased form; forgets all beyond ``limit`` words."""

    def __init__(self, limit: int = 250_000):
        import xxhash

        self.hash, self.limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        self[word] = h = self.hash(word.translate(_LOWER))
        return h

    def of(self, text: str | None) -> np.ndarray:
        """The hashes of a text's words, in order."""
        if len(self) > self.limit:
            self.clear()
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles of the given word hashes, repeated ones too."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    h = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        h = (h ^ (h >> np.uint64(32))) * _ODD + words[k : n - width + 1 + k]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shared_least(n: int) -> int:
    """How many shingles of their prefixes two sets must share, by the size of the smaller; see ``prefix_length``."""
    return SHARED if n >= SMALL_SET else 1


def prefix_length(n: int, percent: int) -> int:
    """How many shingles of a set must be looked at so that no partner is missed.

    Partners have ceil(t n) common shingles; the l-th of them in any common order lies among the first
    n - ceil(t n) + l of either set, so partners share l shingles of prefixes of that length.
    """
    return n - -(-percent * n // 100) + shared_least(n) if n else 0


def _width(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n: the next power of two from 3 n on, 64 to 65536.

    The more bits, the fewer shingles share one, and the closer the possible overlap is to the true one. With half of these
    bits, a group of near copies that verified links leave in several classes has a square of pairs to verify.
    """
    return 1 << np.clip(np.ceil(np.log2(3 * np.maximum(n, 1))), 6, 16).astype(np.int64)


def _bitmap(values: np.ndarray) -> bytes:
    bits = np.zeros(int(_width(np.array([len(values)]))[0]), bool)
    bits[(values & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def common_shingles(docs: DataFrame, text: str, size: int, local: int = 3, least: int = 64, most: int = 200_000) -> np.ndarray:
    """Shingles of at least ``least`` occurrences, sorted; at most the ``most`` commonest.

    They only set the order of shingles: any order gives the same result, so leaving some out costs
    time alone. Each block of a task counts; what occurs ``local`` times there is added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held, count = [], 0

        def counted() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= local
            return pa.RecordBatch.from_arrays([pa.array(v[keep].view(np.int64)), pa.array(c[keep])], names=["token", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for said in batch.slice(at, 1000).column(0).to_pylist():
                    held.append(_shingles(hashes.of(said), size))
                    count += len(held[-1])
                if count > 2_500_000:
                    yield counted()
                    held, count = [], 0
        if held:
            yield counted()

    counts = docs.select(F.col(text).alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).select("token").collect()
    return np.sort(np.array([r["token"] for r in top], np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, key: str, text: str, size: int, percent: int, common: np.ndarray | None) -> DataFrame:
    """key, n, digest, and with ``common`` prefix and bitmap (null where the task has had an equal set), else the set."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())])
    schema.add("shingles", T.ArrayType(T.LongType()))
    if common is not None:
        schema.add("bitmap", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, digests, lists, bitmaps = [], [], [], []
                for said in part.column(1).to_pylist():
                    own = np.unique(_shingles(hashes.of(said), size))
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    n.append(len(own))
                    digests.append(digest)
                    if common is None:
                        lists.append(own.view(np.int64))
                        continue
                    if digest in seen or not len(own):
                        lists.append(None)
                        bitmaps.append(None)
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(digest)
                    late = np.zeros(len(own), bool)
                    if len(common):
                        late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
                    lists.append(np.concatenate([own[~late], own[late]])[: prefix_length(len(own), percent)].view(np.int64))
                    bitmaps.append(_bitmap(own))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols if common is None else [*cols, pa.array(bitmaps, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


class _Bucket:
    """Entries of one bucket in order of size, and the signature tree over them."""

    def __init__(self, n: np.ndarray, bits: list[np.ndarray], percent: int, leaf: int = 16):
        self.n, self.percent, self.leaf = n, percent, leaf
        words = min(len(b) for b in bits)
        self.bits = np.stack([b.reshape(-1, words) if len(b) == words else np.bitwise_or.reduce(b.reshape(-1, words), axis=0)[None] for b in bits])[:, 0] if len(n) else None
        self.extra = n - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.levels = [self._nodes(np.arange(0, len(n), leaf), np.minimum(np.arange(leaf, len(n) + leaf, leaf), len(n)))]
        while len(self.levels[-1][0]) > leaf:
            below = self.levels[-1]
            at = np.arange(0, len(below[0]), leaf)
            self.levels.append(self._nodes(below[0][at], below[1][np.minimum(at + leaf, len(below[0])) - 1]))

    def _nodes(self, first: np.ndarray, past: np.ndarray) -> tuple:
        """First and past entry, OR of bitmaps, smallest and largest size, and largest surplus of shingles over bits."""
        return first, past, np.bitwise_or.reduceat(self.bits, first, axis=0), self.n[first], self.n[past - 1], np.maximum.reduceat(self.extra, first)

    def _possible(self, x: tuple, i: int, y: tuple, js: np.ndarray) -> np.ndarray:
        """Whether nodes i of x and js of y may hold a pair, by the largest overlap their bitmaps and sizes allow."""
        both = np.bitwise_count(x[2][i] & y[2][js]).sum(1).astype(np.int64) + np.minimum(x[5][i], y[5][js])
        most = np.minimum(np.minimum(x[4][i], y[4][js]), both)
        return 100 * most >= self.percent * (x[3][i] + y[3][js] - most)

    def node_pairs(self) -> Iterator[tuple[int, int, int, int]]:
        """Entry ranges of the leaf pairs that survive the traversal of the tree against itself."""
        top = len(self.levels) - 1
        open_ = [(top, i, top, np.arange(i, len(self.levels[top][0]))) for i in range(len(self.levels[top][0]) - 1, -1, -1)]
        while open_:
            level, i, _, js = open_.pop()
            x = self.levels[level]
            for j in js[self._possible(x, i, x, js)].tolist():
                if not level:
                    yield x[0][i], x[1][i], x[0][j], x[1][j]
                    continue
                last = len(self.levels[level - 1][0])
                mine = range(i * self.leaf, min((i + 1) * self.leaf, last))
                theirs = np.arange(j * self.leaf, min((j + 1) * self.leaf, last))
                open_ += [(level - 1, a, level - 1, theirs[theirs >= a] if i == j else theirs) for a in mine]

    def pairs(self, label: np.ndarray, side: np.ndarray | None, spanning: bool, first: Callable[[int, int], bool] = lambda i, j: True) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
        """Entry pairs of different labels that may reach the threshold, and the groups in which some were skipped.

        ``first``: whether this is the bucket to return a pair, of those where it meets.

        ``side``: only pairs of different sides, in a task for two blocks; ``spanning``: each pair joins
        its labels, and pairs of one label are skipped.
        """
        out, skipped, label = [], set(), label.copy()
        for a, b, c, d in self.node_pairs():
            if spanning and label[a] == label[c] and (label[a:b] == label[a]).all() and (label[c:d] == label[a]).all():
                if a != c or b - a > 1:
                    skipped.add(int(a))
                continue
            inter = np.bitwise_count(self.bits[a:b, None] & self.bits[None, c:d]).sum(2).astype(np.int64)
            most = inter + np.minimum(self.extra[a:b, None], self.extra[None, c:d])
            most = np.minimum(most, np.minimum(self.n[a:b, None], self.n[None, c:d]))
            ok = 100 * most >= self.percent * (self.n[a:b, None] + self.n[None, c:d] - most)
            if a == c:
                ok &= np.arange(a, b)[:, None] < np.arange(c, d)[None]
            if side is not None:
                ok &= side[a:b, None] != side[None, c:d]
            found = np.argwhere(ok)
            if spanning:
                found = found[np.argsort(-(most[ok] * 1000 // np.maximum(self.n[a:b, None] + self.n[None, c:d], 1)[ok]), kind="stable")]
            for i, j in found.tolist():
                i, j = a + i, c + j
                if label[i] == label[j]:
                    skipped.add(i)
                    continue
                if not first(i, j):
                    continue
                out.append((i, j))
                if spanning:
                    label[label == label[j]] = label[i]
        return out, [np.flatnonzero(label == x) for x in np.unique(label[sorted(skipped)])] if spanning else []


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets; rows come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(c).to_numpy() for c in (0, 1, 2)]
        turns = np.flatnonzero((ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1]) | (ids[2][1:] != ids[2][:-1])) + 1
        first = np.array([x[0] for x in ids])
        if held and (first != [held[-1].column(c)[-1].as_py() for c in (0, 1, 2)]).any():
            yield pa.Table.from_batches(held)
            held = []
        if not len(turns):
            held.append(batch)
            continue
        if held:
            yield pa.Table.from_batches([*held, batch.slice(0, turns[0])])
            held = []
            batch = batch.slice(turns[0])
            turns = turns - turns[0]
            turns = turns[turns > 0]
            if not len(turns):
                held = [batch]
                continue
        yield pa.Table.from_batches([batch.slice(0, turns[-1])])
        held = [batch.slice(turns[-1])]
    if held:
        yield pa.Table.from_batches(held)


def tree_pairs(rows: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """a, b, token, met: pairs to verify (token null) with the number of the bucket's shingles, and with ``spanning`` the
    members a of groups (token, b null) that pairs connect, where others were skipped.

    ``rows``: token, x, y (block pair), own (block), id, label, n, bitmap[, tokens][, weight]. With ``tokens``, the entry's
    buckets, a pair comes only from the first bucket where it meets. Pairs of sets that need share but one shingle
    have met often enough.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = F.col("tokens") if "tokens" in rows.columns else F.lit(None).cast("array<long>").alias("tokens")
    weight = F.col("weight") if "weight" in rows.columns else F.lit(SHARED).alias("weight")
    dealt = rows.select("token", "x", "y", "own", "id", "label", "n", "bitmap", tokens, weight.cast("long")).repartition(parts, "token", "x", "y").sortWithinPartitions("token", "x", "y", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for table in _bucket_rows(batches):
            token, x, y, own, ids, label, n = (table.column(c).to_numpy() for c in range(7))
            maps, weights = table.column(7).to_pylist(), table.column(9).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(token)]])
            found: list[tuple[int, int, int]] = []
            groups: list[np.ndarray] = []
            bits = [np.frombuffer(m, np.uint64) for m in maps]
            lists = [None if t is None else set(t) for t in table.column(8).to_pylist()]
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s < 2 or (label[s:e] == label[s]).all():
                    continue
                # Runs of sizes within reach of each other: no pair crosses from one run to the next.
                cuts = [s, *(s + 1 + np.flatnonzero(100 * n[s : e - 1] < percent * n[s + 1 : e])).tolist(), e]
                for p, q in zip(cuts, cuts[1:]):
                    if q - p < 2:
                        continue
                    here = int(token[p])
                    first = (lambda i, j, p=p, here=here: min(lists[p + i] & lists[p + j]) == here) if lists[p] is not None else (lambda i, j: True)
                    pairs, grown = _Bucket(n[p:q], bits[p:q], percent).pairs(label[p:q], None if x[p] == y[p] else own[p:q], spanning, first)
                    found += [(p + i, p + j, int(weights[p]) if n[p + i] >= SMALL_SET else SHARED) for i, j in pairs]
                    groups += [p + m for m in grown]
            a, b = (ids[[k[c] for k in found]] if found else np.zeros(0, np.int64) for c in (0, 1))
            member = np.concatenate([*groups, np.zeros(0, np.int64)]).astype(np.int64)
            # A group's name: the bucket and the group's first member.
            names = [xxhash.xxh3_64_intdigest(b"%d,%d,%d,%d" % (token[m[0]], x[m[0]], y[m[0]], ids[m[0]])) for m in groups]
            named = np.repeat(np.array(names, np.uint64).view(np.int64), [len(m) for m in groups]) if groups else np.zeros(0, np.int64)
            no_token = np.arange(len(a) + len(member)) < len(a)
            cols = [pa.array(np.concatenate([np.minimum(a, b), ids[member]])), pa.array(np.concatenate([np.maximum(a, b), np.zeros(len(member), np.int64)]), mask=~no_token), pa.array(np.concatenate([np.zeros(len(a), np.int64), named]), mask=no_token)]
            met = pa.array(np.array([k[2] for k in found] + [0] * len(member), np.int64), mask=~no_token)
            yield pa.RecordBatch.from_arrays([*cols, met], names=["a", "b", "token", "met"])

    return dealt.mapInArrow(run, "a long, b long, token long, met long")


def _blocks(rows: DataFrame, block: int, percent: int) -> DataFrame:
    """The rows of each bucket once, or where a bucket has over ``block`` rows, once for each pair of its blocks with sizes within reach.

    Blocks are ranges of (size, hash of id), so that many rows of one size are several blocks.
    """
    most = rows.agg(F.max("df")).first()[0] or 0
    if most <= block:
        return rows.withColumns({c: F.lit(0) for c in ("own", "x", "y")})
    place = F.col("n") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    large = stage(rows.filter(F.col("df") > block).withColumn("place", place), "large")
    at = F.expr(f"transform(sequence(1, cast(ceil(df / {block}.0) as int) - 1), i -> i / ceil(df / {block}.0))")
    # One row per bucket over ``block``; percentiles of each are merged from those of tasks.
    fine = -(-most // block)
    steps = F.percentile_approx("place", [k / fine for k in range(fine + 1)], max(10_000, 10 * fine))
    cuts = large.groupBy("token", "df").agg(steps.alias("steps"))
    cuts = cuts.select("token", F.transform(at, lambda q: F.element_at("steps", (F.round(q * fine) + 1).cast("int"))).alias("cuts"))
    cuts = stage(cuts.withColumn("cuts", F.array_sort(F.array_distinct("cuts"))), "cuts")
    out = large.join(F.broadcast(cuts) if cuts.count() <= 10_000 else cuts, "token")
    out = out.withColumn("own", F.size(F.filter("cuts", lambda c: c <= F.col("place"))))
    # Block i reaches from cut i - 1 to cut i; of two blocks the lower one's largest size must reach the upper one's smallest.
    reach = f"filter(sequence(0, size(cuts)), j -> j = own or 100 * ceil(cuts[least(own, j)]) >= {percent} * floor(cuts[greatest(own, j) - 1]))"
    out = out.withColumn("other", F.explode(F.expr(reach)))
    out = out.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    plain = rows.filter(F.col("df") <= block).withColumns({c: F.lit(0) for c in ("own", "x", "y")})
    return plain.unionByName(out.select(*plain.columns))


def _found(rows: DataFrame, table: DataFrame, key: str, own: str, often: str, hot: int, small: int, inner: bool) -> DataFrame:
    """Join of many rows to a staged ``table`` of one row per key. Keys whose column ``often`` exceeds ``hot`` are broadcast, if they
    are at most ``small``, and the rows that have them are spread by their ``own`` column, so that none of these keys fills a task."""
    kind = "inner" if inner else "left"
    stars = table.filter(F.col(often) > hot)
    if not 0 < stars.count() <= small:
        return rows.join(table, key, kind)
    more = [c for c in table.columns if c != key]
    stars = stars.select(F.col(key).alias("_key"), F.struct(*more).alias("_star"))
    out = rows.join(F.broadcast(stars), F.col(key) == F.col("_key"), "left").drop("_key")
    spread = F.xxhash64(own, F.lit(11))
    none = spread if dict(rows.dtypes)[key] == "bigint" else F.sha2(spread.cast("string"), 256).cast("binary")
    rest = table.filter(F.col(often) <= hot).select(F.col(key).alias("_key"), F.struct(*more).alias("_rest"))
    out = out.withColumn("_at", F.when(F.col("_star").isNull(), F.col(key)).otherwise(none)).join(rest, F.col("_at") == F.col("_key"), "left")
    out = out.withColumn("_both", F.coalesce("_star", "_rest"))
    out = out.filter("_both is not null") if inner else out
    return out.select(*[F.col(c) for c in rows.columns], *[F.col(f"_both.{c}").alias(c) for c in more])


def bucket_rows(entries: DataFrame, hot: int, small: int, slots: int = 1 << 18) -> DataFrame:
    """token, id, n, df, weight: the entries of each distinct bucket of two or more; ``weight`` shingles have these entries.

    Most shingles are one entry's alone. A bitmap of those that are not, of ``slots`` rows of 64 bits however many there are, keeps the
    rows of most others out of the join.
    """
    rows = entries.select("id", "n", F.explode("shingles").alias("token"))
    shared = stage(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    slot, bit = f"token & {slots - 1}L", "shiftleft(1L, cast(shiftrightunsigned(token, 40) & 63 as int))"
    bits = stage(shared.groupBy(F.expr(slot).alias("slot")).agg(F.expr(f"bit_or({bit})").alias("bits")), "bits")
    likely = rows.join(F.broadcast(bits), F.expr(slot) == F.col("slot")).filter(f"bits & {bit} != 0").select("id", "n", "token")
    meets = stage(_found(likely, shared, "token", "id", "df", hot, small, True), "meets")
    same = meets.groupBy("token", "df").agg(F.bit_xor(F.xxhash64("id")).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("g"))
    same = stage(same.groupBy("df", "h", "g").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("weight")).select("token", "df", "weight"), "buckets")
    out = stage(_found(meets.select("id", "n", "token"), same, "token", "id", "df", hot, small, True).select("token", "id", "n", "df", "weight"), "members")
    discard(shared, bits, meets, same)
    return out


def within_reach(few: DataFrame, percent: int) -> DataFrame:
    """The rows of small buckets, without entries whose size is out of reach of both neighbours in size: a tree has no
    partner for these, so their bitmaps need not be dealt."""
    by_size = Window.partitionBy("token").orderBy("n", "id")
    near = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    return few.withColumn("_near", near).filter("_near").drop("_near")


def _verified(pairs: DataFrame, entries: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int, small: int = 200_000) -> DataFrame:
    """pairs with ``linked``: whether the whole sets reach the threshold. Only the texts of candidates are hashed again."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = stage(entries.join(ids, "id").select("id", F.col("key").alias("_key"), F.col("digest").alias("_digest")), "wanted")
    few = wanted.select("_key").distinct()
    if wanted.count() <= small:
        few, wanted = F.broadcast(few), F.broadcast(wanted)
    again = docs.select(key, text).join(few, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    sets = shingle_sets(again, key, text, size, percent, None)
    # Both joins below read this one exchange by id.
    sets = sets.join(wanted, sets["key"].eqNullSafe(wanted["_key"]) & (sets["digest"] == wanted["_digest"])).select("id", "shingles").dropDuplicates(["id"])
    one = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("p")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("q")), "b")
    both = F.size(F.array_intersect("p", "q"))
    return stage(two.select("a", "b", (F.lit(100) * both >= F.lit(percent) * (F.size("p") + F.size("q") - both)).alias("linked")), "verified")


def _of(entries: DataFrame, rows: DataFrame, small: int) -> DataFrame:
    """The entries that ``rows`` name: where those are at most ``small``, their ids go to the entries, not all entries to the ids."""
    ids = stage(rows.select("id").distinct(), "ids")
    return entries.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= small else entries


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, block: int = 4000, small: int = 500_000, leaf: int = 16, hot: int = 1000) -> DataFrame:
    """key, n_shingles, component_id (smallest key of the class), one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    common = common_shingles(docs, text, size)
    made = shingle_sets(docs, key, text, size, percent, common).withColumn("id", F.monotonically_increasing_id())
    made = stage(made, "shingles")
    # An entry is the first row of a distinct set; of the rows that tasks have kept, others are left out.
    slim = made.select("id", "key", "n", "digest", F.col("bitmap").isNotNull().alias("kept"))
    first = stage(slim.filter("n > 0").groupBy("digest").agg(F.min("id").alias("entry"), F.count(F.lit(1)).alias("rows")), "first")
    # Empty sets meet no entry; each keeps to itself instead of all to one task.
    slim = slim.withColumn("digest", F.when(F.col("n") > 0, F.col("digest")).otherwise(F.col("id").cast("string").cast("binary")))
    owned = stage(_found(slim, first, "digest", "id", "rows", hot, small, False).select("id", "key", "n", "kept", "entry"), "owned")
    discard(first)
    extra = owned.filter("kept and id != entry").select("id")
    extra = F.broadcast(extra) if extra.count() <= small else extra
    entries = made.filter("bitmap is not null").join(extra, "id", "left_anti").select("id", "key", "digest", "n", "shingles", "bitmap")
    members = bucket_rows(entries, hot, small)
    few = stage(within_reach(members.filter(F.col("df") <= leaf), percent), "few")
    rows = few.withColumn("label", F.col("id")).withColumns({c: F.lit(0) for c in ("x", "y", "own")})
    close = tree_pairs(rows.join(_of(entries, few, small).select("id", "bitmap"), "id"), percent, False)
    close = stage(close.groupBy("a", "b").agg(F.sum("met").alias("met")).filter(F.col("met") >= SHARED).select("a", "b"), "close")
    many = members.filter(F.col("df") > leaf).drop("weight")
    rows = many.withColumn("label", F.col("id")).join(_of(entries, many, small).select("id", "bitmap"), "id")
    rows = _blocks(rows, block, percent)
    pairs = stage(tree_pairs(rows, percent, True), "pairs")
    close = stage(close.union(pairs.filter("b is not null").select("a", "b")).distinct(), "close")
    discard(members, few)
    tried = _verified(close, entries, docs, key, text, size, percent)
    links = tried.filter("linked").select("a", "b")
    roots = components(links)
    groups = pairs.filter("b is null").select(F.col("a").alias("id"), "token")
    if not groups.isEmpty() and not tried.filter("not linked").isEmpty():
        # Groups whose members the verified links leave in several classes.
        again = groups.join(roots, "id", "left").select("id", "token", F.coalesce("root", "id").alias("label"))
        split = stage(again.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("token"), "split")
        split = F.broadcast(split) if split.count() <= small else split
        again = stage(again.join(split, "token", "left_semi"), "again")
        again = again.join(again.groupBy("id").agg(F.collect_list("token").alias("tokens")), "id").join(_of(entries, again, small).select("id", "n", "bitmap"), "id")
        again = again.withColumns({c: F.lit(0) for c in ("x", "y", "own")})
        more = tree_pairs(again, percent, False).select("a", "b").distinct()
        more = stage(more.join(tried.filter("not linked").select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            found = _verified(more, entries, docs, key, text, size, percent).filter("linked").select("a", "b")
            roots = components(links.union(found))
    roots = roots.select(F.col("id").alias("entry"), "root")
    if roots.count() <= small:
        roots = F.broadcast(roots)
    else:
        # Many rows of one set: they look its root up by broadcast.
        roots = stage(roots.join(owned.groupBy("entry").agg(F.count(F.lit(1)).alias("rows")), "entry"), "roots")
    owned = owned.select("id", "key", "n", F.coalesce("entry", -1 - F.col("id")).alias("entry"))
    owned = owned.join(roots, "entry", "left") if "rows" not in roots.columns else _found(owned, roots, "entry", "id", "rows", hot, small, False)
    owned = stage(owned.select("id", "key", "n", F.coalesce("root", "entry").alias("class")), "owned")
    least = stage(owned.groupBy("class").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "least")
    out = _found(owned, least, "class", "id", "rows", hot, small, False)
    out = out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component_id"))
    discard(made)
    return out


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, small: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest key stays.

    Of several rows with one key one stays; rows with a null key stay, as nothing names them.
    """
    found = stage(near_duplicate_classes(docs.select(key, text), key, text, size, percent), "classes")
    kept = F.max((F.col("component_id") == F.col(key)).cast("int"))
    by_key = stage(found.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(kept.alias("kept"), F.count(F.lit(1)).alias("rows")), "keys")
    gone, again = by_key.filter("kept = 0").select("_key"), by_key.filter("kept = 1 and rows > 1").select("_key")

    def against(ids: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        few = ids.count() <= small
        return rows.join(F.broadcast(ids) if few else ids, F.col(key) == F.col("_key"), how)

    out = against(gone, "left_anti", docs)
    if again.isEmpty():
        return out
    return against(again, "left_anti", out).unionByName(against(again, "left_semi", out).dropDuplicates([key]))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 4-word shingles, Jaccard 0.85."""
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, x FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}
ORACLES = {"op10_ngram_jaccard": ORACLE}
